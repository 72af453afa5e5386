"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are regrouped so that correlated ones stand together, and cut into m parts. If thresholds T of the parts sum to
radius - m + 1, any two fingerprints within the radius lie within T[i] of each other on some part i. So
they meet at a value halfway between them, if each probes all values within T[i] / 2, rounded up. The parts and their
thresholds are chosen by dynamic programming on the candidate counts that histograms of all fingerprints foretell. Exact
copies are one fingerprint from the start; candidates meet in buckets, are verified on all 64 bits, and leave a bucket only
as stars of its components, however many pairs it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import chain, combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rolling, Table, chunks, durable, lean, mixed, table, written
from .components import star_components

SHINGLE, RADIUS, SEED = 4, 4, 42
BLOCKS, WIDTH = 8, 8
#: Rows of a bucket that one task compares; a larger bucket is cut into blocks, each pair of which is compared.
BUCKET_ROWS = 8192
#: Relative costs of moving one probe and of comparing one pair.
PROBE_COST, PAIR_COST = 1.0, 0.002


# ---------------------------------------------------------------- fingerprints


#: For each byte its eight bits as eight counters of one byte each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _votes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of hashes: a bit is 1 if over half of them have it.

    Bits are counted in byte-wide lanes over pieces of at most 255 hashes, then by run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    pieces = -(-sizes[full] // 255)
    first = np.cumsum(pieces) - pieces
    starts = np.repeat(np.cumsum(sizes[full]) - sizes[full], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.empty((len(full), 64), np.int64)
    for i in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, i]], starts).view(np.uint8).reshape(-1, 8)
        ones[:, 8 * i : 8 * i + 8] = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    out[full] = ((2 * ones > sizes[full][:, None]) * weights).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long): the bits of each whole text's SimHash over its k-word shingles, repeats included, A-Z lowered.
    Fewer words make one shingle; a text without words, or null, has the fingerprint 0. Ids may be null or repeat. Nothing
    is shuffled."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                hashes: list[int] = []
                sizes = []
                for t in b.column(1).to_pylist():
                    words = t.encode().lower().split() if t else []
                    joined = b" ".join(words)
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                    n = max(min(len(words), 1), len(words) - k + 1)
                    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist() if n else []
                    found = [xxh64_intdigest(joined[x:y], SEED) for x, y in zip(starts, ends[len(words) - n :].tolist() if n else [])] if n != 1 else [xxh64_intdigest(joined, SEED)]
                    hashes += found
                    sizes.append(len(found))
                fp = _votes(np.array(hashes, np.uint64), np.array(sizes, np.int64))
                yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(lean(run), f"id {docs.schema[id_col].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- the plan: bits, parts, thresholds


def _matrix(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j both (64 x 64), summed on Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((64, 64), np.int64)
        for b in batches:
            bits = _bits(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
            both += np.rint(bits.T @ bits).astype(np.int64)
            total += len(bits)
        yield pa.record_batch([pa.array(np.arange(-1, 4096)), pa.array(np.concatenate([[total], both.ravel()]))], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    found = {r.cell: r.n for r in rows}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(4096)], np.int64).reshape(64, 64)


def _bits(values: np.ndarray) -> np.ndarray:
    """(n, 64) bits, bit 63 first."""
    return np.unpackbits(values.astype(np.int64).view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def bit_order(n: int, both: np.ndarray) -> list[int]:
    """The 64 bits (as columns of _bits) in blocks of WIDTH: each block starts with the free bit most correlated with the
    others, and takes the free bits most correlated with what it holds."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, order = set(range(64)), []
    for _ in range(BLOCKS):
        block = [max(sorted(free), key=lambda i: corr[i, sorted(free)].sum())]
        free.discard(block[0])
        while len(block) < WIDTH:
            block.append(max(sorted(free), key=lambda i: corr[i, block].sum()))
            free.discard(block[-1])
        order += block
    return order


def _distances(fps: DataFrame, order: list[int]) -> np.ndarray:
    """For each block the share of pairs of fingerprints at each distance on it, from the block's histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((BLOCKS, 1 << WIDTH), np.int64)
        for b in batches:
            values = _blocks(b.column(0).to_numpy(zero_copy_only=False), order)
            for i in range(BLOCKS):
                counts[i] += np.bincount(values[:, i], minlength=1 << WIDTH)
        yield pa.record_batch([pa.array(np.arange(counts.size)), pa.array(counts.ravel())], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 2048 rows
    counts = np.zeros(BLOCKS << WIDTH)
    for r in rows:
        counts[r.cell] = r.n
    share = counts.reshape(BLOCKS, -1) / max(1.0, counts.sum() / BLOCKS)
    apart = np.bitwise_count(np.arange(1 << WIDTH)[:, None] ^ np.arange(1 << WIDTH)[None, :])
    return np.array([[(np.outer(s, s) * (apart == d)).sum() for d in range(WIDTH + 1)] for s in share])


def _blocks(values: np.ndarray, order: list[int]) -> np.ndarray:
    """(n, BLOCKS) values of the blocks of regrouped bits."""
    return np.packbits(_bits(values)[:, order], axis=1)


def reach(threshold: int) -> int:
    """How far each of two values probes, so that both meet somewhere if they differ in `threshold` bits at most."""
    return (threshold + 1) // 2


def ball(width: int, r: int) -> int:
    """Values that differ from one of `width` bits in r at most."""
    return sum(comb(width, i) for i in range(r + 1))


def meetings(width: int, r: int, d: int) -> int:
    """At how many values two meet that differ in d of `width` bits and probe up to r bits each."""
    return sum(comb(d, i) * comb(width - d, j) for i in range(d + 1) for j in range(r + 1) if i + j <= r and d - i + j <= r)


def allocate(n: int, distances: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(first block, blocks, threshold) of each part; thresholds sum to radius - parts + 1. A threshold of -1 leaves a
    part out. Dynamic programming over thresholds, for every cut of the blocks into parts of near-equal width."""
    best = None
    for m in range(1, BLOCKS + 1):
        total = radius - m + 1
        sizes = [BLOCKS // m + (i < BLOCKS % m) for i in range(m)]
        firsts = np.cumsum([0, *sizes[:-1]]).tolist()
        if m * -1 > total:
            continue
        state = {0: (0.0, ())}
        for first, size in zip(firsts, sizes):
            law = np.ones(1)
            for d in distances[first : first + size]:
                law = np.convolve(law, d)
            width = size * WIDTH
            following: dict = {}
            for used, (cost, chosen) in state.items():
                for t in range(-1, min(radius, width) + 1):
                    r = reach(t)
                    probes = ball(width, r) if t >= 0 else 0
                    if probes > 5000:
                        break
                    met = sum(law[d] * meetings(width, r, d) for d in range(2 * r + 1) if d <= width) if t >= 0 else 0.0
                    more = n * probes * PROBE_COST + PAIR_COST * n * (n - 1) / 2 * met
                    key = used + t
                    if key not in following or cost + more < following[key][0]:
                        following[key] = (cost + more, (*chosen, t))
            state = following
        # Thresholds start from -1 each, and radius - m + 1 is what they sum to.
        if total in state and (best is None or state[total][0] < best[0]):
            best = (state[total][0], [(f, s, t) for f, s, t in zip(firsts, sizes, state[total][1]) if t >= 0])
    if best is None:
        raise ValueError("no allocation of thresholds")
    return best[1]


# ---------------------------------------------------------------- probing and verifying


def _probes(fps: DataFrame, order: list[int], parts: list[tuple[int, int, int]]) -> DataFrame:
    """(key, fp): a key for the value of each part, and for every value within reach of its threshold. Keys are small numbers
    where parts are narrow, which compresses well; two values of one key would be compared in vain, no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = []
        for _, size, t in parts:
            bits = [np.uint64(1) << np.uint64(i) for i in range(size * WIDTH)]
            masks.append(np.array([sum(c, np.uint64(0)) for r in range(reach(t) + 1) for c in combinations(bits, r)], np.uint64))
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                fp = whole.slice(at, 2000).column(0).to_numpy(zero_copy_only=False)
                blocks = _blocks(fp, order).astype(np.uint64)
                for i, (first, size, _) in enumerate(parts):
                    value = np.zeros(len(fp), np.uint64)
                    for j in range(first, first + size):
                        value = (value << np.uint64(WIDTH)) | blocks[:, j]
                    near = value[:, None] ^ masks[i][None, :]
                    key = near.ravel() * np.uint64(len(parts)) + np.uint64(i)
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.repeat(fp, near.shape[1]))], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _stars(fp: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Every fingerprint of one bucket with the least of its component there: a search that compares each found row with the
    unvisited only."""
    a, b = [], []
    left = fp  # in order
    while len(left) > 1:
        least, left = left[0], left[1:]
        front = [least]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= radius
            if near.any():
                found = left[near]
                a.append(np.full(len(found), least))
                b.append(found)
                front.extend(found)
                left = left[~near]
    return a, b


def _links_of(keys: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Components within buckets, as (least, member); rows come sorted by bucket. Small buckets are compared all at once, row
    with i-th next row, and the least of what is linked spreads along the links."""
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1])]))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    for s, n in zip(starts[sizes > 48], sizes[sizes > 48]):
        x, y = _stars(np.unique(fp[s : s + n]), radius)
        a += x
        b += y
    small = np.repeat(sizes <= 48, sizes)
    x, group = fp[small], np.repeat(np.arange(len(sizes)), sizes)[small]
    left, right = [], []
    for lag in range(1, 48):
        same = group[lag:] == group[:-lag]
        if not same.any():
            break
        hit = np.flatnonzero(same & (np.bitwise_count(x[lag:] ^ x[:-lag]) <= radius))
        left.append(hit)
        right.append(hit + lag)
    if left:
        i, j, least = np.concatenate(left), np.concatenate(right), x.copy()
        while len(i):
            low = np.minimum(least[i], least[j])
            if (low == least[i]).all() and (low == least[j]).all():
                break
            np.minimum.at(least, i, low)
            np.minimum.at(least, j, low)
        a.append(least[least != x])
        b.append(x[least != x])
    return (np.concatenate(a) if a else np.zeros(0, np.uint64)), (np.concatenate(b) if b else np.zeros(0, np.uint64))


def _verified(units: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """(a, b) of the components within the units. Rows must be partitioned by the unit's keys and sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(names: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _links_of(names, fp, radius)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
            return pa.record_batch([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], ["a", "b"])

        kept_names, kept_fp = np.zeros(0, [(k, np.int64) for k in keys]), np.zeros(0, np.uint64)
        for batch in batches:
            names = np.empty(batch.num_rows, kept_names.dtype)
            for k in keys:
                names[k] = batch.column(k).to_numpy(zero_copy_only=False)
            names = np.concatenate([kept_names, names])
            fp = np.concatenate([kept_fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            # The last bucket may go on in the next batch.
            cut = len(names) - 1 - int(np.argmax((names[::-1] != names[-1]))) + 1 if (names != names[-1]).any() else 0
            if cut:
                yield out(names[:cut], fp[:cut])
            kept_names, kept_fp = names[cut:], fp[cut:]
        if len(kept_names):
            yield out(kept_names, kept_fp)

    return units.select(*keys, "fp").mapInArrow(run, "a long, b long")


def hamming_links(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp), whose components are those of all pairs within `radius`: in each bucket
    the members of a component with its least one, so that a dense group leaves about one row for each member, not for each
    pair or bucket.

    No pair is lost: a bucket larger than `bucket_rows` is cut into blocks, and every two of its blocks are compared."""
    n, both = _matrix(fps)
    order = bit_order(n, both)
    parts = allocate(n, _distances(fps, order), radius)
    probes = _probes(fps, order, parts)
    counts = probes.groupBy("key").agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") > bucket_rows).select(F.col("key").alias("k"), F.ceil(F.col("n") / (bucket_rows // 2)).cast("int").alias("g"))
    hot = durable(hot)
    rows, keys = probes, ["key"]
    if not hot.isEmpty():
        mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
        rows = rows.join(hot, F.col("key") == F.col("k"), "left")
        # Block i meets block j in the unit (min, max); a bucket that is not hot is one unit.
        units = F.when(F.col("g").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.least(mine, j).cast("long") * (1 << 31) + F.greatest(mine, j))
        )
        rows, keys = rows.select("key", F.explode(units).alias("unit"), "fp"), ["key", "unit"]
    found = _verified(rows.repartition(*keys).sortWithinPartitions(*keys), keys, radius)
    # Buckets have leasts of their own: a member is linked with the least of these, and so are they. No member has more of
    # them than probes.
    leasts = found.groupBy("b").agg(F.collect_set("a").alias("leasts")).withColumn("least", F.array_min("leasts"))
    return leasts.select(F.col("least").alias("a"), F.explode(F.array_append("leasts", F.col("b"))).alias("b")).where("a <> b").distinct()


def near_duplicate_classes(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id_col, fp, component_id) of every row: the smallest id that links of at most `radius` differing bits reach.

    Rows without words, null texts included, share the fingerprint 0. Null ids get a class like any other row and never
    name one, unless a class has no other id; repeated rows stay. All other columns are left out, whatever their names. An
    empty table gives an empty result."""
    marked = durable(fingerprints(docs, k, id_col, text_col))
    distinct = durable(marked.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    roots = star_components(hamming_links(distinct, radius, bucket_rows)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = rooted.join(names, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(id_col, "fp", "component_id")


# ---------------------------------------------------------------- near copies, verified on exact shingle sets

#: SimHashes of independent seeds: a pair of likeness 0.8 is about 9.7 bits apart on average under each of them, and has to
#: lie within the radius under one.
NEAR_SEEDS, NEAR_RADIUS, NEAR_FEATURE = (1, 2, 3), 10, 2
#: A class of at most so many texts and bytes is settled by one task; of a larger one this much leads a round.
GROUP_ROWS, GROUP_BYTES = 2048, 16 << 20
#: Min-hashes of a band, and bands: texts of likeness 0.8 share one of these with probability 0.997.
BAND, BANDS = 3, 8
SALTS = 64


def _word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return Rolling(np.frombuffer(b"".join(words), np.uint8)).of(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if words else np.zeros(0, np.uint64)


def _shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the distinct k-word windows, in order; of all words if they are fewer."""
    k = max(1, min(k, len(words)))
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(1, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : n + i]
    return np.unique(mixed(h + np.uint64(k)))


def _marks(docs: DataFrame, id_type: str, feature: int, seeds: tuple[int, ...]) -> DataFrame:
    """(id, h, size, f0, f1, ...) of (id, text): a 128-bit hash of the text, its bytes, and a SimHash of its distinct shingles
    for each seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = ((i, t.as_py().encode()) for i, t in enumerate(b.column(1)))
            for part in chunks(rows, 1 << 20):
                sets = [_shingle_set(_word_hashes(t), feature) for _, t in part]
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                flat = np.concatenate(sets)
                fps = [_votes(mixed(flat ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), sizes) for seed in seeds]
                digests = pa.array([blake2b(t, digest_size=16).digest() for _, t in part], pa.binary())
                lengths = pa.array([len(t) for _, t in part], pa.int64())
                yield pa.record_batch([b.column(0).take(pa.array([r[0] for r in part])), digests, lengths, *(pa.array(f.view(np.int64)) for f in fps)], ["id", "h", "size", *(f"f{i}" for i in range(len(seeds)))])

    return docs.select("id", "text").mapInArrow(lean(run), f"id {id_type}, h binary, size long" + "".join(f", f{i} long" for i in range(len(seeds))))


def _linked(firsts: DataFrame, fp: str, radius: int, bucket_rows: int) -> DataFrame:
    """(a, b): links of texts (node) whose fingerprints in the column `fp` lie within the radius, enough of them for the
    components."""
    named = written(firsts.groupBy(F.col(fp).alias("fp")).agg(F.min("node").alias("node"), F.count("*").alias("n")))
    same = firsts.join(named.where("n > 1").select(F.col("fp").alias(fp), F.col("node").alias("b")), fp).where("node <> b").select(F.col("node").alias("a"), "b")
    near = hamming_links(named.select("fp"), radius, bucket_rows)
    for side in ("a", "b"):
        near = near.join(named.select(F.col("fp").alias(side), F.col("node").alias(f"{side}_node")), side).drop(side)
    return same.union(near.select("a_node", "b_node"))


class _Led:
    """The texts of one group that stay so far, by their shingles."""

    def __init__(self):
        self.sizes: list[int] = []
        self.holders: dict[int, list[int]] = {}

    def like(self, shingles: list[int], likeness: float) -> bool:
        found = [x for x in map(self.holders.get, shingles) if x is not None]
        if not found:
            return False
        if len(self.sizes) == 1:
            both, sizes = np.array([len(found)]), np.array(self.sizes)
        else:
            both, sizes = np.bincount(np.fromiter(chain.from_iterable(found), np.int64), minlength=len(self.sizes)), np.array(self.sizes)
        return bool((both >= likeness * (len(shingles) + sizes - both) - 1e-9).any())

    def add(self, shingles: list[int]) -> None:
        for s in shingles:
            self.holders.setdefault(s, []).append(len(self.sizes))
        self.sizes.append(len(shingles))


GIVEN, OPEN, ASKED = 0, 1, 2


def _settled(rows: DataFrame, id_type: str, words: int, likeness: float) -> DataFrame:
    """(id) of the rows of (unit, mode, d, id, text) that are like a text of their unit that stays.

    Units are streamed in the order of (mode, d, id): GIVEN texts stay, an OPEN one stays unless an earlier text that stays is
    like it, ASKED ones are only compared. A task holds the shingles of one unit's staying texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, led = None, _Led()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                gone = []
                for i, (u, mode, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist())):
                    if u != unit:
                        unit, led = u, _Led()
                    shingles = _shingle_set(_word_hashes(text.encode()), words).tolist()
                    if mode != GIVEN and led.like(shingles, likeness):
                        gone.append(i)
                    elif mode != ASKED:
                        led.add(shingles)
                yield pa.record_batch([b.column(2).take(pa.array(gone, pa.int64()))], ["id"])

    # Equal units have equal hashes; units of one hash and one place would follow one another, not mix.
    dealt = rows.repartition("unit").sortWithinPartitions("unit", "mode", "d", "id")
    return dealt.select("unit", "mode", "id", "text").mapInArrow(lean(run), f"id {id_type}")


def _banded(members: DataFrame, words: int) -> DataFrame:
    """(class, key, node) of (class, node, text): a key for each band of min-hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mixed(np.arange(1, BAND * BANDS + 1, dtype=np.uint64))
        for b in batches:
            keys = []
            for text in b.column(2).to_pylist():
                s = _shingle_set(_word_hashes(text.encode()), words)
                least = np.array([mixed(s ^ x).min() for x in salts]).reshape(BANDS, BAND)
                h = np.arange(BANDS, dtype=np.uint64)
                for i in range(BAND):
                    h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + least[:, i])
                keys.append(h.view(np.int64))
            n = len(keys)
            flat = pa.array(np.concatenate(keys) if n else np.zeros(0, np.int64))
            again = pa.array(np.repeat(np.arange(n), BANDS))
            yield pa.record_batch([b.column(0).take(again), flat, b.column(1).take(again)], ["class", "key", "node"])

    return members.select("class", "node", "text").mapInArrow(lean(run), "class long, key long, node long")


def _shared_bands(keys: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of members (class, key, node) that share a key. The least node of each key
    leads it; a member is linked with the least of its keys' leaders, and so are these leaders: about one link for each
    member of a group that shares its keys."""
    keys = written(keys)
    leaders = keys.groupBy("class", "key").agg(F.min("node").alias("leader"))
    led = written(keys.join(leaders, ["class", "key"]).select("node", "leader"))
    first = led.groupBy("node").agg(F.min("leader").alias("b"))
    return first.select(F.col("node").alias("a"), "b").union(led.join(first, "node").select(F.col("leader").alias("a"), "b")).distinct()


def _middles(members: DataFrame) -> DataFrame:
    """(class, n, bytes, middle) of (class, size, f0): the majority of each bit of the class's fingerprints."""
    bit = lambda i: F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")
    c = F.col
    held = members.groupBy("class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *(F.sum((c("f0").bitwiseAND(bit(i)) != 0).cast("long")).alias(f"b{i}") for i in range(64)))
    middle = F.lit(0).cast("long")
    for i in range(64):
        middle = middle.bitwiseOR(F.when(2 * c(f"b{i}") > c("n"), bit(i)).otherwise(F.lit(0).cast("long")))
    return held.select("class", "n", "bytes", middle.alias("middle"))


def staying(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, likeness: float = 0.8, seeds: tuple[int, ...] = NEAR_SEEDS, radius: int = NEAR_RADIUS, bucket_rows: int = BUCKET_ROWS, group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id_col) of the rows that stay, so that one of each group of near copies does: every other text equals one that stays,
    or the sets of their `words`-word shingles (A-Z lowered) have a Jaccard likeness of at least `likeness`; no two texts that
    stay and were candidates of each other do.

    Candidates are texts in one class of links within `radius` bits under any of several SimHashes (one for each seed) over
    distinct two-word shingles. A class is settled on exact shingle sets: the texts nearest to the middle of the class lead,
    and only a text that stays drops others. A class of up to `group_rows` texts and `group_bytes` bytes is settled by one
    task. A larger one is first taken apart where its members share no band of min-hashes; what is still larger is settled in
    rounds: the next `group_rows` texts (or `group_bytes`) settle among themselves, then all others are compared with those
    of them that stay, in blocks. No pairs are written, and every round settles its leaders and all that are like them.

    Of equal texts the row with the least id stays. Rows without an id are left out of the result and lead nothing; rows
    that share an id stay together if one of them does. Null texts count as empty, texts without words are like one another.
    Other columns are not read, whatever their names; an empty table gives an empty result."""
    c = F.col
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(c(id_col).isNotNull()).select(c(id_col).alias("id"), F.coalesce(c(text_col).cast("string"), F.lit("")).alias("text"))
    fps = [f"f{i}" for i in range(len(seeds))]
    marks = _marks(rows, id_type, NEAR_FEATURE, seeds)
    firsts = written(marks.groupBy("h").agg(F.min("id").alias("id"), F.first("size").alias("size"), *(F.first(f).alias(f) for f in fps)).select("id", F.xxhash64("h").alias("node"), "size", *fps))
    # One fingerprint after another: the shuffle of one's probes can go before the next one's is made.
    found = [Table(_linked(firsts, f, radius, bucket_rows)) for f in fps]
    roots = star_components(reduce(DataFrame.union, (t.read() for t in found)))
    for t in found:
        t.drop()
    members = written(firsts.join(roots, "node").select(c("root").alias("class"), "node", "id", "size", "f0"))

    def ordered(some: DataFrame) -> DataFrame:
        """With the class's n and bytes, and the distance from its middle."""
        return some.join(_middles(some), "class").withColumn("d", F.bit_count(c("f0").bitwiseXOR(c("middle"))))

    def texts(some: DataFrame) -> DataFrame:
        return rows.join(some, "id")

    def settle(some: DataFrame) -> DataFrame:
        return _settled(some, id_type, words, likeness)

    fits = (c("n") <= group_rows) & (c("bytes") <= group_bytes)
    sized = written(ordered(members))
    gone = settle(texts(sized.where(fits).select("id", c("class").alias("unit"), F.lit(OPEN).alias("mode"), "d")))
    large = sized.where(~fits)
    if not large.isEmpty():
        parts = star_components(_shared_bands(_banded(texts(large.select("id", "class", "node")), words)))
        apart = written(ordered(large.select("node", "id", "size", "f0").join(parts.select("node", c("root").alias("class")), "node").select("class", "node", "id", "size", "f0")))
        gone = gone.union(settle(texts(apart.where(fits).select("id", c("class").alias("unit"), F.lit(OPEN).alias("mode"), "d"))))
        left = Table(apart.where(~fits).select("class", "id", "size", "d"))
        while not left.read().isEmpty():
            gone_now, left_now = _round(left.read(), texts, settle, group_rows, group_bytes)
            left.drop()
            gone, left = gone.union(gone_now), left_now
    return firsts.select("id").join(gone.distinct(), "id", "left_anti").select(c("id").alias(id_col))


def _round(left: DataFrame, texts, settle, group_rows: int, group_bytes: int) -> tuple[DataFrame, Table]:
    """One round over the open texts (class, id, size, d) of large classes: (ids that go, what stays open)."""
    c = F.col
    first = Window.partitionBy("class", "salt").orderBy("d", "id")
    order = Window.partitionBy("class").orderBy("d", "id")
    some = left.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("nth", F.row_number().over(first)).where(c("nth") <= group_rows)
    some = some.withColumns({"nth": F.row_number().over(order), "before": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    heads = written(some.where((c("nth") <= group_rows) & (F.coalesce("before", F.lit(0)) < group_bytes)).select("class", "id", "d"))
    beaten = written(settle(texts(heads.select("id", c("class").alias("unit"), F.lit(OPEN).alias("mode"), "d"))))
    leaders = heads.join(beaten, "id", "left_anti")
    rest = left.join(heads.select("id"), "id", "left_anti")
    blocks = rest.groupBy("class").agg(F.ceil(F.sum("size") / group_bytes).cast("int").alias("blocks"))
    # Each block of the other texts meets all leaders of its class.
    unit = lambda block: F.xxhash64("class", block)
    asked = rest.join(F.broadcast(blocks), "class").select("id", unit(F.pmod(F.xxhash64("id"), c("blocks")).cast("int")).alias("unit"), F.lit(ASKED).alias("mode"), "d")
    given = texts(leaders.select("id", "class", "d")).join(F.broadcast(blocks), "class").withColumn("block", F.explode(F.sequence(F.lit(0), c("blocks") - 1)))
    given = given.select("id", "text", unit(c("block")).alias("unit"), F.lit(GIVEN).alias("mode"), "d")
    dropped = written(settle(texts(asked).unionByName(given)))
    return beaten.union(dropped), Table(rest.join(dropped, "id", "left_anti").select("class", "id", "size", "d"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    rows = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def hot_blocks(n: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Blocks that a bucket of n rows is cut into."""
    return 1 if n <= bucket_rows else ceil(n / (bucket_rows // 2))
