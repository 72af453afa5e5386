"""Rule books and transcripts in files, read as a batch or as a stream by Spark's own text source: any store that Spark can open,
partitions by files and blocks, and a stream's offsets in its checkpoint. A folder that gets a new file is read on from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.operators.catalog import book_from_json, book_json


def write_books(statutes: DataFrame, at: str, by: str) -> None:
    """A file {"statutes": [...]} for each value of the column `by`, in a folder of its own below `at`."""
    book_json(statutes, (by,)).write.mode("append").partitionBy(by).option("compression", "none").text(at)


def read_books(spark: SparkSession, at: str, stream: bool = False) -> DataFrame:
    """The statutes of all files below `at`, each a whole JSON text, as (file, ord, name, ...). Of one name in a file the last entry
    holds, at the place of the first. As a stream: all entries as they stand, since later ones can't be waited for."""
    reader = spark.readStream.schema("value string") if stream else spark.read
    texts = reader.option("recursiveFileLookup", True).text(at, wholetext=True)
    return book_from_json(texts.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json")), by=("file",), last=not stream)


ANSWER = "call_idx int, raw string"


def write_transcript(answers: DataFrame, at: str, case: str = "case_id") -> None:
    """A line {"case_id": ..., "call_idx": ..., "raw": ...} for each answer, in the rows' own partitions."""
    answers.select(F.to_json(F.struct(F.col(case).alias("case_id"), "call_idx", "raw")).alias("value")).write.mode("append").text(at)


def read_transcript(spark: SparkSession, at: str, stream: bool = False, case_type: str = "bigint") -> DataFrame:
    """(file, case_id, call_idx, raw, malformed) of the lines below `at`. `malformed` is null, or the line if it isn't an answer with
    all three fields, which are null then: such lines are set apart by a filter and never stop a job. Blank lines are none."""
    c = F.col
    reader = spark.readStream.schema("value string") if stream else spark.read
    lines = reader.text(at).select(c("_metadata.file_path").alias("file"), c("value")).where(F.trim("value") != "")
    schema = f"case_id {case_type}, {ANSWER}, _bad string"
    said = lines.withColumn("a", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    whole = c("a._bad").isNull() & c("a.case_id").isNotNull() & c("a.call_idx").isNotNull() & c("a.raw").isNotNull()
    return said.select("file", *(F.when(whole, c(f"a.{n}")).alias(n) for n in ("case_id", "call_idx", "raw")), F.when(~whole, c("value")).alias("malformed"))
