"""Document fingerprints by winnowing (DataFrame operations only).

A text's words give k-word hashes; of every `window` consecutive hashes the least is chosen, the rightmost of equals, and
kept with its place. Any passage of at least `window + k - 1` words that two texts share leaves a common hash in both.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, rolled, shifted, table, words_of

K, WINDOW = 5, 16
#: Hashes are compared by their upper 36 bits; the lower 28 order equal ones by place.
PLACES = (1 << 28) - 1
#: Rows that stand side by side in a window, the most such cells (their bounds are a constant of the plan), and cells a task.
CELL_ROWS, MOST_CELLS, TASK_CELLS = 256, 4096, 4
LEAST = -(1 << 63)


def _lesser(x: Column, y: Column) -> Column:
    return F.least(x, y)


def least_of_windows(values: Column, window: int) -> Column:
    """The least of every `window` consecutive values, of an array of so many or more: by windows of 2, 4, ... values, the last
    two of which overlap."""

    def step(least: Column, size: int) -> Column:
        if 2 * size > window:
            return least if size == window else shifted(least, least, window - size, _lesser)
        return let(shifted(least, least, size, _lesser), lambda q: step(q, 2 * size))

    return let(values, lambda v: step(v, 1))


def winnowed(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """array<struct<pos int, hash long>>, by place. A text of fewer than k words gives one hash of all its words; a text
    without words, or null, gives none."""

    def chosen(hashes: Column) -> Column:
        keys = F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~PLACES)).bitwiseOR(F.lit(PLACES).cast("long") - i))

        def least(ks: Column) -> Column:
            n = F.size(ks)
            return F.when(n == 0, F.array().cast("array<bigint>")).when(n <= window, F.array(F.array_min(ks))).otherwise(least_of_windows(ks, window))

        places = F.transform(F.array_distinct(let(keys, least)), lambda s: (F.lit(PLACES).cast("long") - s.bitwiseAND(F.lit(PLACES).cast("long"))).cast("int"))
        return F.transform(places, lambda p: F.struct(p.alias("pos"), F.get(hashes, p).alias("hash")))

    def hashed(words: Column) -> Column:
        short = F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(words)))
        return let(F.when(F.size(words) >= k, rolled(F.transform(words, lambda w: F.xxhash64(w)), k)).otherwise(short), chosen)

    return let(words_of(text.cast("string")), hashed)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints' sets of hashes; 1 for two empty ones."""
    sets = F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b"))

    def of(s: Column) -> Column:
        both = F.size(F.array_intersect(s["a"], s["b"]))
        either = F.size(s["a"]) + F.size(s["b"])
        return F.when(either == 0, F.lit(1.0)).otherwise(both / (either - both))

    return let(sets, of)


def fingerprint_text(marks: Column) -> Column:
    """The chosen hashes in order, 8 hexadecimal digits each."""
    return F.array_join(F.transform(marks, lambda m: F.lpad(F.lower(F.hex(F.shiftrightunsigned(m["hash"], 32))), 8, "0")), "")


def _cell(rank: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of the bounds (in order) are not above `rank`, by binary search."""
    if not bounds:
        return F.lit(0)
    known = F.from_json(F.lit(json.dumps([{"k": k, "h": h} for k, h in bounds])), "array<struct<k:bigint,h:bigint>>")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    further = lambda at, by: F.when((at + by <= len(bounds)) & (F.element_at(known, F.least(at + by, F.lit(len(bounds)))) <= rank), at + by).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def cell_bounds(rows: DataFrame, cell_rows: int) -> tuple[int, list[tuple[int, int]]]:
    """(cells, the least (k, h) of each but the first), by quantiles of a sample of (k, h): about 16 pairs for each cell come to
    the driver. Pairs are drawn by id and text together: null texts, and one text under many ids, are drawn like all others."""
    n = rows.count()
    cells = min(MOST_CELLS, -(-n // cell_rows))
    if cells <= 1:
        return cells, []
    some = rows.select("k", "h").where(F.pmod(F.xxhash64("k", "h"), F.lit(max(1, n // (16 * cells)))) == 0).distinct().orderBy("k", "h").limit(64 * MOST_CELLS).collect()
    return cells, sorted({(some[i * len(some) // cells].k, some[i * len(some) // cells].h) for i in range(1, cells)}) if some else []


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """`docs` with next_<text_col>: the text of the next row by descending id (null ids last; ties by the text's hash, then the
    text), after the last row that of the first. Repeated rows follow one another. Other columns pass through, whatever their
    names; one named next_<text_col> is replaced.

    Rows are cut into cells of neighbouring (id, hash of the text), whose bounds are quantiles of a sample of these pairs, so
    dense, sparse and repeated ids, null texts and one text under many ids all give cells of about `cell_rows` rows (more beyond
    MOST_CELLS times as many rows: 4096 cells for a million rows, and for more); the sample decides the cells and no result. Rows
    with one id and one text share a cell, however many they are. In a cell a window finds the next row; only each cell's top text moves, to the cell above it."""
    c = F.col
    new = f"next_{text_col}"
    names = [n for n in docs.columns if n != new]
    rows = docs.select(*(c(n).alias(f"c{i}") for i, n in enumerate(names)), c(text_col).cast("string").alias("t"), F.coalesce(c(id_col).cast("long"), F.lit(LEAST)).alias("k"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    cells, bounds = cell_bounds(rows, cell_rows)
    rank = F.struct("k", "h")
    rows = rows.withColumn("cell", _cell(rank, bounds))
    # Rows are small and what follows is not: the number of tasks follows the rows, not the bytes.
    dealt = rows.repartition(-(-max(1, cells) // TASK_CELLS), "cell")
    tops = rows.groupBy("cell").agg(F.max(F.struct("k", "h", "t")).alias("top"))
    # One row for each cell, MOST_CELLS at most: the cell above each receives its top text, above the highest stands the lowest.
    every = Window.orderBy("cell")
    arriving = tops.select(F.coalesce(F.lead("cell").over(every), F.min("cell").over(Window.partitionBy())).alias("cell"), c("top.t").alias("arrived"))
    here = Window.partitionBy("cell").orderBy(F.desc("k"), F.desc("h"), F.desc("t"))
    # A null text is a text: what is ahead is told from nothing ahead by the struct.
    joined = dealt.withColumn("ahead", F.lead(F.struct("t")).over(here)).join(arriving, "cell", "left")
    return joined.select(*(c(f"c{i}").alias(n) for i, n in enumerate(names)), F.when(c("ahead").isNotNull(), c("ahead.t")).otherwise(c("arrived")).alias(new))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every text, of its edited text and of the next document's, with their likeness, and the places
    (in words) of the text's own marks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = with_next(docs).withColumn("edited", edited)
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), winnowed(F.col("text")).alias("marks"), winnowed(F.col("edited")).alias("edited_marks"), winnowed(F.col("next_text")).alias("next_marks"))
    # What is shown of each hash is what is compared.
    hashes = lambda name: F.transform(F.col(name)["hash"], lambda h: F.shiftrightunsigned(h, 32))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("marks")).alias("fingerprint"), fingerprint_text(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(hashes("marks"), hashes("edited_marks")).alias("near_edited"), likeness(hashes("marks"), hashes("next_marks")).alias("near_next"),
        F.array_join(F.col("marks")["pos"].cast("array<string>"), ",").alias("places"), F.size("marks").cast("long").alias("n_marks"),
    )
