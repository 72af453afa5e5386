"""Stalls: the same non-blank fingerprint `threshold` times in a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stall_runs(rows: DataFrame, key: str | list[str], order: list[str], fp: str, threshold: int = 2) -> DataFrame:
    """`rows` with `run` (length of the current run of equal fingerprints) and `stalled`. Blank and null fingerprints have
    run 0 and change nothing: the run goes on behind them.

    Runs are islands: a window by key, no collection of a key's rows."""
    keys = [key] if isinstance(key, str) else key
    filled = F.coalesce(F.col(fp), F.lit("")) != ""
    seen = rows.withColumn("_filled", filled.cast("int"))
    # Blank rows get a partition of their own, so that neighbours are filled rows.
    w = Window.partitionBy(*keys, "_filled").orderBy(*order)
    changed = F.coalesce((F.lag(fp).over(w) != F.col(fp)).cast("int"), F.lit(1))
    islands = seen.withColumn("_new", changed).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*keys, "_filled", "_island").orderBy(*order))
    return islands.withColumn("run", F.when(F.col("_filled") == 1, place).otherwise(F.lit(0))).withColumn("stalled", (F.col("run") >= threshold)).drop("_filled", "_new", "_island")


def run_step(state: Column, fp: Column) -> Column:
    """One step of the detector on struct<last string, run int>: for folds over an ordered array."""
    next_run = F.when(state["last"].eqNullSafe(fp), state["run"] + 1).otherwise(F.lit(1))
    blank = F.coalesce(fp, F.lit("")) == ""
    return F.struct(F.when(blank, state["last"]).otherwise(fp).alias("last"), F.when(blank, state["run"]).otherwise(next_run).alias("run"))


def stall_counts(fps: Column, threshold: int = 2) -> Column:
    """How many entries of an ordered array of fingerprints stall, by a fold."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("hits"))

    def step(s: Column, fp: Column) -> Column:
        n = run_step(s, fp)
        hit = (F.coalesce(fp, F.lit("")) != "") & (n["run"] >= threshold)
        return F.struct(n["last"].alias("last"), n["run"].alias("run"), (s["hits"] + hit.cast("int")).alias("hits"))

    return F.aggregate(fps, start, step, lambda s: s["hits"])


def first_stalls(rows: DataFrame, key: str, order: list[str], fp: str, threshold: int = 2) -> DataFrame:
    """The first stalled row of each key."""
    hits = stall_runs(rows, key, order, fp, threshold).where("stalled")
    others = [c for c in hits.columns if c != key]
    return hits.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in others))
