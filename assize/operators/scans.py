"""Scans along an order within keys, where one key may hold any share of the rows.

Rows are cut into blocks of neighbours by (keys, order), a written table. Within a block a window does the work; what a block
passes on is a row of its own, a window over these finds what arrives at each block, and a join hands it to the block's rows. No
task sees more than a block of a key's rows, or one row for each of its blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assize.sources.shared import kept

BLOCK_ROWS = 100_000


def in_blocks(rows: DataFrame, keys: list[str], order: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`rows` with `_block`, in about one block for each `block_rows` rows; blocks are in order of (keys, order), and a key may
    have many."""
    n = rows.count()
    return kept(rows.repartitionByRange(max(1, -(-n // block_rows)), *keys, *order).withColumn("_block", F.spark_partition_id()))


def _arriving(local: DataFrame, summary: DataFrame, keys: list[str], what: str) -> DataFrame:
    """`local` with column `what` of the summary of its (block, keys)."""
    held = summary.select(F.col("_block").alias("_b"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), what)
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("_block") == F.col("_b"))
    return local.join(held, same).drop("_b", *(f"_k{i}" for i in range(len(keys))))


def numbered_in_order(rows: DataFrame, order: list[str], number: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`rows` with `number`, their place in the order from 0, without gaps. The order must be total."""
    placed = in_blocks(rows.withColumn("_all", F.lit(0)), ["_all"], order, block_rows)
    before = Window.partitionBy("_all").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_block", "_all").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    local = placed.withColumn(number, F.row_number().over(Window.partitionBy("_block").orderBy(*order)) - 1)
    return _arriving(local, starts, ["_all"], "_start").withColumn(number, F.col(number) + F.col("_start")).drop("_block", "_all", "_start")


def carried(rows: DataFrame, keys: list[str], order: list[str], value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`rows` with `value` replaced by its last value that is not null, up to and including the row: an as-of join, for rows and
    versions in one table. The order must be total."""
    c = F.col
    placed = in_blocks(rows, keys, order, block_rows)
    inside = Window.partitionBy("_block", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(c(value).isNotNull(), F.struct(*order, c(value).alias("_v"))))["_v"].alias("_last")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    summary = placed.groupBy("_block", *keys).agg(last).withColumn("_arrives", F.last("_last", ignorenulls=True).over(before))
    local = placed.withColumn(value, F.last(value, ignorenulls=True).over(inside))
    return _arriving(local, summary, keys, "_arrives").withColumn(value, F.coalesce(value, "_arrives")).drop("_block", "_arrives")


def stall_scan(rows: DataFrame, key: str | list[str] | None, order: list[str], fp: str, threshold: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What `stalls.stall_runs` gives: `rows` with `run` and `stalled`, for keys of any size. No key (None) is one order of all
    rows, as for a court that counts over all its cases.

    A block passes on its first and last fingerprint, the lengths of the runs at its ends, and whether it is one run; such
    summaries can be joined in order: a run that fills a block goes on with what arrived there. Blank and null fingerprints
    have run 0 and change nothing. The order must be total."""
    c = F.col
    keys = ["_all"] if key is None else [key] if isinstance(key, str) else key
    seen = rows.withColumn("_all", F.lit(0)) if key is None else rows
    filled = F.coalesce(c(fp), F.lit("")) != ""
    placed = in_blocks(seen.where(filled), keys, order, block_rows)
    inside = Window.partitionBy("_block", *keys).orderBy(*order)
    local = placed.withColumn("_new", F.coalesce((F.lag(fp).over(inside) != c(fp)).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.withColumn("run", F.row_number().over(Window.partitionBy("_block", *keys, "_island").orderBy(*order)))
    at = F.struct(*order)
    ends = local.groupBy("_block", *keys).agg(F.min_by(fp, at).alias("_first"), F.max_by(fp, at).alias("_final"), F.max_by("run", at).alias("_suffix"), (F.max("_island") == 1).alias("_whole"))
    blocks = Window.partitionBy(*keys).orderBy("_block")
    ends = ends.withColumn("_goes_on", F.coalesce(F.lag("_final").over(blocks) == c("_first"), F.lit(False)))
    # The run at a block's end reaches back over all blocks that are one run and go on.
    ends = ends.withColumn("_chain", F.sum((~(c("_whole") & c("_goes_on"))).cast("int")).over(blocks.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("_open", F.sum("_suffix").over(Window.partitionBy(*keys, "_chain").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("_arrives", F.when(c("_goes_on"), F.lag("_open").over(blocks)).otherwise(F.lit(0)))
    run = (c("run") + F.when(c("_island") == 1, c("_arrives")).otherwise(F.lit(0))).cast("long")
    done = _arriving(local, ends, keys, "_arrives").withColumn("run", run).select(*rows.columns, "run")
    return done.unionByName(rows.where(~filled).withColumn("run", F.lit(0).cast("long"))).withColumn("stalled", c("run") >= threshold)
