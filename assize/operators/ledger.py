"""A ledger of answers: a table by the hash of judge and prompt. What it knows is not asked again, by no case and no hearing."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.operators.adjudicate import judge_with
from assize.sources.shared import dropped

ENTRY = "key string, raw string"


@dataclass(frozen=True)
class Judge:
    """A judge by name: answers are kept under it, so a judge that may answer otherwise needs another name."""

    name: str
    ask: Callable[[list[str]], list[str]]

    def key(self, prompt: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{len(self.name)}:{self.name}"), prompt), 256)


class Ledger:
    """Answers in a folder that all executors share. Several hearings may use one ledger, one after the other or at once.

    Answers are appended by task, as soon as a task has all of its own: a job that dies leaves what its finished tasks have
    asked, and only the rest is asked when it runs again. If two hearings ask the same at once, one of the two answers holds
    for everyone from then on who reads both (the lesser text)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self) -> DataFrame:
        """All answers so far. Each asking has a folder of its own, and a read names them all: Spark takes two scans of one folder
        in a plan for equal, even if files have come in between."""
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(context._jsc.hadoopConfiguration())
        found = sorted(f.getPath().toString() for f in files.listStatus(at)) if files.exists(at) else []
        return self.spark.read.schema(ENTRY).parquet(*found) if found else self.spark.createDataFrame([], ENTRY)

    def answers(self) -> DataFrame:
        """(key, raw), each key once."""
        return self._read().groupBy("key").agg(F.min("raw").alias("raw"))

    def known(self) -> DataFrame:
        """Keys, repeated ones too: for anti-joins, which read no answer."""
        return self._read().select("key")

    def size(self) -> int:
        return self.known().distinct().count()

    def drop(self) -> None:
        dropped(self.spark, self.path)

    def ask(self, rows: DataFrame, judge: Judge, prompt: str = "prompt") -> None:
        """Afterwards the ledger has the judge's answer to every prompt of `rows`. Each distinct prompt is asked once."""
        wanted = rows.where(F.col(prompt).isNotNull()).select(judge.key(F.col(prompt)).alias("key"), F.col(prompt).alias("prompt"))
        new = wanted.groupBy("key").agg(F.first("prompt").alias("prompt")).join(self.known(), "key", "left_anti")
        # An exact number of tasks: prompts are small and answers slow, so their bytes say nothing. (By the key itself the planner
        # would take the join's partitions, and put small ones together.)
        dealt = new.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("key"))
        asked = judge_with(dealt, judge.ask).select("key", "raw")
        asked.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.path}/{uuid.uuid4().hex}")

    def answered(self, rows: DataFrame, judge: Judge, prompt: str = "prompt", out: str = "raw", read: Callable[[Column], Column] | None = None) -> DataFrame:
        """`rows` with the judge's answers from the ledger, as `read` reads them (the texts by default); null without a prompt. An
        answer is read once, however many rows have its prompt; those meet few answers, and the adaptive planner splits them."""
        said = self.answers().select(F.col("key").alias("_key"), (read or (lambda raw: raw))(F.col("raw")).alias(out))
        return rows.join(said, judge.key(F.col(prompt)) == F.col("_key"), "left").drop("_key")
