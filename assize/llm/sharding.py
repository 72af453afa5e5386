"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame operations only).

Every shard owns `vnodes` points on a ring of 64-bit hashes; a key belongs to the first point clockwise. A shard takes
at most its capacity; the keys beyond it continue clockwise to the next points whose shards have room. The walk is not
simulated key by key: the ring is cut into a bounded number of units, counts per unit give, by prefix sums, how many keys
stay, overflow and arrive, and since overflow is served in ring order, the k-th overflowing key takes the k-th free place.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table, utf8_bytes

#: Cells that cut the ring besides the virtual nodes, and parts of each piece by a second hash. Both only spread work.
CELLS, SALTS = 128, 8


def _signed(u: int) -> int:
    return u - (1 << 63)


def ring(spark: SparkSession, n_shards: int, vnodes: int, cells: int = CELLS) -> DataFrame:
    """Pieces (piece, cell, lo, hi, shard) of the ring in order: at most n_shards * vnodes + cells + 1 rows.

    Bounds are inclusive, in the order of signed longs. The last arc wraps round to the first point."""
    points = (
        spark.range(n_shards).select(F.col("id").cast("int").alias("shard"))
        .withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))))
        .select(F.xxhash64(F.lit("ring"), "shard", "v").alias("hi"), "shard")
        .groupBy("hi").agg(F.min("shard").alias("shard"))
    )
    step = (1 << 64) // cells
    edges = spark.createDataFrame([(_signed(step * (i + 1) - 1 if i < cells - 1 else (1 << 64) - 1),) for i in range(cells)], "hi long")
    ends = edges.join(points, "hi", "full_outer")
    whole = Window.orderBy("hi")  # a bounded table: n_shards * vnodes + cells rows
    return (
        ends.select(
            "hi",
            F.first("shard", ignorenulls=True).over(whole.rowsBetween(0, Window.unboundedFollowing)).alias("shard"),
            (F.lag("hi").over(whole) + 1).alias("lo"),
            (F.row_number().over(whole) - 1).alias("piece"),
            F.first("shard", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("wrap"),
        )
        .select(
            F.col("piece").cast("long"), F.coalesce("lo", F.lit(-(1 << 63))).alias("lo"), "hi", F.coalesce("shard", "wrap").alias("shard"),
            _cell(F.col("hi"), cells).alias("cell"),
        )
    )


def _cell(h: Column, cells: int) -> Column:
    bits = cells.bit_length() - 1
    return F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)


def bounded_load_shards(
    rows: DataFrame, key: list[str], n_shards: int, vnodes: int = 16, slack: float = 0.0, salt: Column | None = None, tie: list[str] | None = None, cells: int = CELLS
) -> DataFrame:
    """`rows` with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard).

    A shard takes at most ceil((1 + slack) * n / n_shards) rows; with slack 0 the first n mod n_shards shards take one
    row more than the others, so counts are at most one apart. `salt` splits keys that hold very many rows (a number from
    0 to SALTS - 1). Null keys hash like any other key; repeated rows take places of their own; an empty table gives an
    empty result. Columns named shard or slot in `rows` are replaced; all others pass through.
    """
    if cells & (cells - 1):
        raise ValueError("cells must be a power of 2")
    spark = rows.sparkSession
    tie = tie or key
    rows = rows.drop("shard", "slot")
    names = rows.columns
    pieces = ring(spark, n_shards, vnodes, cells).select(*(F.col(c).alias(f"_{c}") for c in ("piece", "lo", "hi", "shard", "cell")))
    # The ring's size is fixed by its parameters: it may be broadcast.
    keyed = rows.withColumns({"_h": F.xxhash64(F.lit(7), *key), "_salt": (salt if salt is not None else F.lit(0)).cast("int")})
    keyed = keyed.withColumn("_c", _cell(F.col("_h"), cells))
    placed = durable(
        keyed.join(F.broadcast(pieces), (F.col("_c") == F.col("_cell")) & F.col("_h").between(F.col("_lo"), F.col("_hi")))
        .select(*names, "_h", (F.col("_piece") * SALTS + F.col("_salt")).alias("_unit"), F.col("_shard").alias("_home"))
    )
    plan = _plan(spark, placed.groupBy("_unit").agg(F.count("*").alias("n"), F.first("_home").alias("home")), n_shards, slack)
    ranked = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_unit").orderBy("_h", *tie)) - 1)
    return (
        ranked.join(plan, (F.col("_unit") == F.col("unit")) & (F.col("_r") >= F.col("from")) & (F.col("_r") < F.col("till")))
        .select(*names, F.col("to_shard").alias("shard"), (F.col("to_slot") + F.col("_r") - F.col("from")).alias("slot"))
    )


def _plan(spark: SparkSession, counts: DataFrame, n_shards: int, slack: float) -> DataFrame:
    """Where each range of ranks [from, till) of a unit goes. All tables here are bounded by the number of units."""
    order = Window.orderBy("_unit")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy())
    share = F.floor(total / n_shards)
    even = share + (F.col("home") < total % n_shards).cast("long")
    cap = even if slack == 0 else F.ceil((1 + F.lit(slack)) * total / n_shards)
    own = Window.partitionBy("home").orderBy("_unit")
    # Shards without a key still offer their room: they stand at the end of the ring, before the wrap.
    empty = spark.range(n_shards).select(F.col("id").cast("int").alias("home")).join(counts.select("home").distinct(), "home", "left_anti")
    units = counts.unionByName(empty.select((F.lit(1 << 40) + F.col("home")).alias("_unit"), F.lit(0).cast("long").alias("n"), "home"))
    loads = (
        units.withColumn("cap", cap.cast("long"))
        .withColumns({"demand": F.sum("n").over(Window.partitionBy("home")), "sofar": F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "units": F.count("*").over(Window.partitionBy("home")), "nth": F.row_number().over(own) - 1})
        .withColumn("kept", F.greatest(F.lit(0), F.least("n", F.col("cap") - F.col("sofar"))))
        .withColumn("room", F.greatest(F.lit(0), F.col("cap") - F.col("demand")))
        # A shard's room lies evenly at its units.
        .withColumn("spare", F.floor((F.col("nth") + 1) * F.col("room") / F.col("units")) - F.floor(F.col("nth") * F.col("room") / F.col("units")))
        .withColumn("over", F.col("n") - F.col("kept"))
    )
    # The ring is opened where the running excess is least: from there on, no walk passes the opening.
    flow = loads.withColumn("excess", F.sum(F.col("over") - F.col("spare")).over(upto))
    opening = F.min(F.struct("excess", "_unit")).over(Window.partitionBy())["_unit"]
    flow = flow.withColumn("turn", (F.col("_unit") <= opening).cast("int")).drop("excess")
    around = Window.orderBy("turn", "_unit")
    till = around.rowsBetween(Window.unboundedPreceding, 0)
    flow = flow.withColumn("p", F.sum(F.col("over") - F.col("spare")).over(till))
    flow = flow.withColumn("carry", F.col("p") - F.least(F.lit(0), F.min("p").over(till)))
    flow = flow.withColumn("taken", F.coalesce(F.lag("carry").over(around), F.lit(0)) + F.col("over") - F.col("carry"))
    flow = flow.withColumns({"over_to": F.sum("over").over(till), "taken_to": F.sum("taken").over(till)})
    shards = Window.partitionBy("home").orderBy("turn", "_unit")
    flow = flow.withColumns({
        "kept_base": F.coalesce(F.sum("kept").over(Window.partitionBy("home").orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "taken_base": F.coalesce(F.sum("taken").over(shards.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("kept").over(Window.partitionBy("home")),
    })
    flow = durable(flow)
    stay = flow.where("kept > 0").select(F.col("_unit").alias("unit"), F.lit(0).cast("long").alias("from"), F.col("kept").alias("till"), F.col("home").alias("to_shard"), F.col("kept_base").alias("to_slot"))
    # Two partitions of the same range of overflow ranks, by origin and by place: their common refinement.
    leave = flow.where("over > 0").select(F.col("over_to").alias("end"), F.col("_unit"), F.col("kept"), (F.col("over_to") - F.col("over")).alias("o0"))
    arrive = flow.where("taken > 0").select(F.col("taken_to").alias("end"), F.col("home"), F.col("taken_base"), (F.col("taken_to") - F.col("taken")).alias("t0"))
    marks = leave.select("end", F.struct("_unit", "kept", "o0").alias("l"), F.lit(None).cast("struct<home:int,taken_base:bigint,t0:bigint>").alias("a")).unionByName(
        arrive.select("end", F.lit(None).cast("struct<_unit:bigint,kept:bigint,o0:bigint>").alias("l"), F.struct("home", "taken_base", "t0").alias("a"))
    ).groupBy("end").agg(F.max("l").alias("l"), F.max("a").alias("a"))
    ahead = Window.orderBy("end").rowsBetween(0, Window.unboundedFollowing)
    move = (
        marks.select("end", F.coalesce(F.lag("end").over(Window.orderBy("end")), F.lit(0)).alias("start"), F.first("l", True).over(ahead).alias("l"), F.first("a", True).over(ahead).alias("a"))
        .where("l is not null and a is not null and end > start")
        .select(F.col("l._unit").alias("unit"), (F.col("l.kept") + F.col("start") - F.col("l.o0")).alias("from"), (F.col("l.kept") + F.col("end") - F.col("l.o0")).alias("till"), F.col("a.home").alias("to_shard"), (F.col("a.taken_base") + F.col("start") - F.col("a.t0")).alias("to_slot"))
    )
    return stay.unionByName(move)


SHARDS = 24


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose counts are at most one apart (law `rows`)."""
    text = F.col("text").cast("string")
    rows = table(spark, sf_dir, "documents").select("doc_id", (utf8_bytes(text) + 8).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    placed = bounded_load_shards(rows, ["doc_id"], SHARDS, salt=F.pmod(F.col("text_crc32"), F.lit(SALTS)), tie=["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def capacity(n: int, n_shards: int, slack: float) -> int:
    """The most rows that a shard takes."""
    return ceil((1 + slack) * n / n_shards)
