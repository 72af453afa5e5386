"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import inspect
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word and white space of the contracts: ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Arrow batches of so many rows and about so many bytes: a Python task holds one batch of texts at a time, and rows that
    are packed arrays of a few MB each don't meet in one batch by the hundred MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where that is not set, a local session gets one of this machine;
    on a cluster executors would not see it, so that is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = Path(tempfile.mkdtemp(prefix="assize-")).as_uri()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the same shared folder: columnar and compressed, for what has many rows."""
    return Table(df).read()


class Table:
    """A table in the shared folder that can be dropped once nothing reads it any more."""

    def __init__(self, df: DataFrame):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{shared_folder(self.spark).rstrip('/')}/{uuid.uuid4().hex}"
        df.write.parquet(self.path)

    @classmethod
    def place(cls, spark: SparkSession) -> Table:
        """A new place in the shared folder, for files of another kind."""
        made = cls.__new__(cls)
        made.spark, made.path = spark, f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
        return made

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is written here are removed at once, and not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidied(df: DataFrame) -> Table:
    """A table whose shuffles go once it is written."""
    with tidy(df.sparkSession):
        return Table(df)


class Sharded(Table):
    """A table in the shared folder, bucketed by its column `shard`: rows that meet it by shard are shuffled, its own are not."""

    def __init__(self, spark: SparkSession, shards: int):
        self.spark, self.shards, self.parts = spark, shards, 0
        self.name = f"assize_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(spark).rstrip('/')}/{self.name}"

    def add(self, df: DataFrame) -> Sharded:
        with tidy(self.spark):
            df.write.format("parquet").mode("append").bucketBy(self.shards, "shard").option("path", self.path).saveAsTable(self.name)
        self.parts += 1
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        super().drop()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def unsigned(name: str, value: int) -> int:
    """A Spark long has the bits of an unsigned 64-bit number."""
    if not 0 <= value < 1 << 64:
        raise ValueError(f"{name} is not an unsigned 64-bit number")
    return value - (1 << 64) if value >> 63 else value


# ---------------------------------------------------------------- ragged byte arrays, in tasks

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_SYMBOLS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads entropy of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """64-bit polynomial hashes of any substring of a byte buffer, from prefix sums.

    The symbol at i weighs M**-i; times M**start, a substring's hash depends on its bytes alone."""

    _powers = _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Rolling._powers) < n:
            size = max(n, 1 << 20)
            for name, factor in (("_inverse", np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))), ("_powers", _MULTIPLIER)):
                powers = np.full(size, factor, np.uint64)
                powers[0] = 1
                setattr(Rolling, name, np.cumprod(powers, dtype=np.uint64))
        self.back = Rolling._powers
        self.n = n
        self.sums = np.zeros(n, np.uint64)
        weighed = _SYMBOLS[data]
        weighed *= Rolling._inverse[: n - 1]
        np.cumsum(weighed, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]."""
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all substrings of k bytes, by their start."""
        if self.n - 1 < k:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[k:] - self.sums[:-k]) * self.back[: self.n - k])


def chunks(columns: Iterable[tuple], size: int) -> Iterator[list[tuple]]:
    """Rows, whose last field is bytes, in lists of about `size` bytes; a longer row stands alone."""
    held, total = [], 0
    for row in columns:
        if held and total + len(row[-1]) > size:
            yield held
            held, total = [], 0
        held.append(row)
        total += len(row[-1])
    if held:
        yield held


def lean(run):
    """The task function `run`, which gives its memory back at the end of a partition: a Python worker outlives its tasks,
    and what one stage has freed but still holds would count against the next."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            Rolling._powers = Rolling._inverse = np.ones(1, np.uint64)
            release()

    return inner


def lean_group(run):
    """A function of a group's tables, which gives its memory back after each group. Nothing there hangs together in circles."""

    def inner(key, *tables):
        try:
            return run(key, *tables)
        finally:
            release(circles=False)

    # Spark tells functions with and without a key, and those of one table and of two, by their arguments.
    inner.__signature__ = inspect.signature(run)
    return inner


def release(circles: bool = True) -> None:
    import ctypes

    import pyarrow

    if circles:
        gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def packed(a: np.ndarray) -> bytes:
    """Bytes of an array, its byte planes apart, compressed: sorted or small numbers take little."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")


def unpacked(blob: bytes, dtype) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(dtype).ravel()


# ---------------------------------------------------------------- arrays within a row, DataFrame functions only


def let(value: Column, body) -> Column:
    """body(value), where value is evaluated once for the row however often the body uses it, lambdas included."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The contracts' words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shifted(a: Column, b: Column, by: int, join) -> Column:
    """join(a[i], b[i + by]) for every i that b reaches."""
    n = F.size(b) - by
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, by + 1, n), join)


def rolled(hashes: Column, k: int) -> Column:
    """Hashes of all windows of k elements, of an array of k or more. Windows of 2, 4, ... come from two of half the size each,
    so an element is hashed once, and a window by one step for each bit of k."""
    pair = lambda x, y: F.xxhash64(x, y)

    def step(done: Column | None, width: int, power: Column, size: int) -> Column:
        if k & size:
            done, width = (power if done is None else shifted(done, power, width, pair)), width + size
        if 2 * size > k:
            return done
        more = lambda p, d: let(shifted(p, p, size, pair), lambda q: step(d, width, q, 2 * size))
        return more(power, None) if done is None else let(done, lambda d: more(power, d))

    return let(hashes, lambda h: step(None, 0, h, 1))
