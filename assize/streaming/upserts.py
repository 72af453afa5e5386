"""A catalog kept from a stream of edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.sources.shared import dropped, shared_folder


def keep_catalog(edits: DataFrame, at: str, key: str = "name", order: str = "ord"):
    """A streaming query that keeps the catalog of all edits so far in versions below `at`, one for each batch.

    A version is the last entry of each key by `order`, at the least place its key has had; `_last` is the place of the last edit,
    so edits that are delivered late change no newer entry. A batch that runs again writes its version again, from the one before
    it: nothing is counted twice, and no state lies in memory. The last two versions stay. Start and await it as any other stream."""
    spark = edits.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        now = batch.withColumn("_first", F.col(order)).withColumnRenamed(order, "_last")
        if number:
            before = spark.read.parquet(f"{at}/catalog/version={number - 1}")
            now = before.unionByName(now)
        others = [c for c in now.columns if c not in (key, "_first", "_last")]
        last = F.max_by(F.struct("_last", *others), "_last").alias("v")
        now.groupBy(key).agg(F.min("_first").alias("_first"), last).select(key, "_first", "v.*").write.mode("overwrite").parquet(f"{at}/catalog/version={number}")
        if number > 1:
            dropped(spark, f"{at}/catalog/version={number - 2}")

    return edits.writeStream.option("checkpointLocation", f"{at}/checkpoint").foreachBatch(apply).trigger(availableNow=True)


def newest_catalog(spark: SparkSession, at: str, order: str = "ord") -> DataFrame:
    """The last version that `keep_catalog` wrote below `at`."""
    newest = spark.read.parquet(f"{at}/catalog").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{at}/catalog/version={newest}").withColumnRenamed("_first", order).drop("_last")


def upserted_in_batches(parts: list[DataFrame], key: str = "name", order: str = "ord") -> DataFrame:
    """The catalog after each of `parts` was delivered and used up in turn: what `catalog.upserted` makes of all of them."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    at, edits = shared_folder(spark), shared_folder(spark)
    for part in parts:
        part.write.mode("append").parquet(edits)
        keep_catalog(spark.readStream.schema(schema).parquet(edits), at, key, order).start().awaitTermination()
    return newest_catalog(spark, at, order).select(parts[0].columns)
