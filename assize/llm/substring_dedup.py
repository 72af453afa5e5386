"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every string of `length` bytes is dealt by its anchor: the k-gram of least hash in it, the leftmost of equals. Equal strings
have equal anchors, and neighbouring strings mostly share one, so a text falls into segments (runs of strings with one
anchor) that meet the segments of other texts only where their anchors are equal. Segments with an anchor of their own
repeat nothing and are dropped; equal segments are one segment with its earliest place. The different segments that share
an anchor are dealt to shards, each shard's transform is built by a task of its own, and the transforms of a bucket are
merged: their interleaving is refined from prefixes of h bytes to h + STRIDE until it is sorted by `length` bytes. The
common prefixes found on the way give the intervals of repeated strings, without sorting the suffixes anew.

An anchor that stands in very many different surroundings would make one large bucket. Such hot anchors are found in a
sample of the texts, which decides this plan and no result: under a hot anchor every string is a segment of its own, whose
anchor is the whole string, so that its strings are dealt evenly and meet only their equals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rolling, chunks, durable, lean, mixed, packed, table, unpacked

LENGTH, GRAM = 100, 32
#: Bytes of text that a task hashes at once, of segments in one shard, and shards in one bucket.
CHUNK_BYTES, SHARD_BYTES, SHARDS = 1 << 20, 1 << 16, 4
STRIDE = 4
#: Buckets that one task merges, on average.
TASK_BUCKETS = 4
#: Anchors whose segments hold more bytes than this are hot, as one in SAMPLED texts foretells; so many of them at most.
HOT_BYTES, SAMPLED, HOT_ANCHORS = 2 << 20, 64, 1 << 16


# ---------------------------------------------------------------- segments


def _anchors(h: np.ndarray, span: int) -> np.ndarray:
    """For each start the index of the least of `span` consecutive hashes, the leftmost of equals."""
    at, least = np.arange(len(h), dtype=np.int32), h
    width = 1
    while width < span:
        step = min(width, span - width)
        left = least[:-step] <= least[step:]
        at, least = np.where(left, at[:-step], at[step:]), np.minimum(least[:-step], least[step:])
        width += step
    return at


def _segments(rows: list[tuple], length: int, gram: int, hot: np.ndarray) -> list[np.ndarray]:
    """For texts laid end to end: owner, start, strings, anchor hash and content hash of each segment. `hot`: anchor hashes,
    in order."""
    sizes = np.array([len(r[-1]) for r in rows], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(r[-1] for r in rows), np.uint8)
    if len(data) < length:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    rolling = Rolling(data)
    h = rolling.windows(gram)
    anchor = _anchors(h, length - gram + 1)
    owner = np.repeat(np.arange(len(rows)), sizes)[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= ends[owner]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
    if len(hot):
        new |= hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)][anchor] == h[anchor]
    starts = np.flatnonzero(new & valid)
    # A segment ends before the next start or the first string that leaves its text.
    marks = np.flatnonzero(new | ~valid)
    stops = np.append(marks, len(anchor))[np.searchsorted(marks, starts, side="right")]
    n = stops - starts
    content = rolling.of(starts, starts + n + length - 1) + (anchor[starts] - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = h[anchor[starts]]
    if len(hot):
        key = np.where(hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key, mixed(content), key)
    return [owner[starts], starts - (ends - sizes)[owner[starts]], n, key, content]


def _earliest(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, sub: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True for the earliest of equal segments."""
    order = np.lexsort((at, sub, doc, content, anchor))
    a, c = anchor[order], content[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    out = np.empty(len(order), bool)
    out[order] = first
    return out


def segments(docs: DataFrame, length: int, gram: int, hot: np.ndarray) -> DataFrame:
    """(anchor, content, doc, sub, at, late) of texts given as (doc long, sub long, text binary), which (doc, sub) name.

    `at` is start << 8 | strings. Of equal segments of one chunk only the earliest needs to be compared with other chunks: the
    others are `late` already, and get keys that spread them evenly."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, sub = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            rows = ((i, t) for i, t in enumerate(x.as_py() for x in b.column(2)) if len(t) >= length)
            for part in chunks(rows, CHUNK_BYTES):
                owner, start, n, anchor, content = _segments(part, length, gram, shared.value)
                row = np.array([r[0] for r in part], np.int64)[owner]
                d, u, at = doc[row], sub[row], (start << 8) | n
                late = ~_earliest(anchor, content, d, u, at)
                anchor = np.where(late, mixed((d ^ u).view(np.uint64) + at.view(np.uint64)), anchor)
                content = np.where(late, np.uint64(0), content)
                yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(d), pa.array(u), pa.array(at), pa.array(late)], ["anchor", "content", "doc", "sub", "at", "late"])

    return docs.mapInArrow(lean(run), "anchor long, content long, doc long, sub long, at long, late boolean")


def hot_anchors(docs: DataFrame, length: int, gram: int) -> np.ndarray:
    """Hashes of the anchors, in order, whose different segments are likely to hold more than HOT_BYTES. HOT_ANCHORS rows at
    most come to the driver; which they are changes no result."""
    some = docs.where(F.pmod(F.xxhash64("doc", "sub"), F.lit(SAMPLED)) == 0)
    held = segments(some, length, gram, np.zeros(0, np.uint64)).where("not late").groupBy("anchor").agg(F.sum(F.col("at").bitwiseAND(F.lit(0xFF)) + (length - 1)).alias("bytes"))
    found = held.where(F.col("bytes") * SAMPLED > HOT_BYTES).orderBy(F.desc("bytes"), "anchor").limit(HOT_ANCHORS).select("anchor").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


# ---------------------------------------------------------------- a shard's transform


def rotations(symbols: np.ndarray) -> np.ndarray:
    """The cyclic rotations in order, by prefix doubling; one symbol (the end) must be unique."""
    n = len(symbols)
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | np.roll(symbols, -i).astype(np.uint64)
    step = 7
    while True:
        # Equal keys get equal ranks, so their order need not be kept.
        order = np.argsort(key)
        found = key[order]
        places = np.zeros(n, np.uint64)
        np.cumsum(found[1:] != found[:-1], out=places[1:])
        rank = np.empty(n, np.uint64)
        rank[order] = places
        if places[-1] == n - 1:
            return order
        key = rank * np.uint64(n) + np.roll(rank, -step)
        step *= 2


def transform_of(symbols: np.ndarray) -> np.ndarray:
    """For each rotation in order the symbol before it."""
    return symbols[rotations(symbols) - 1]


def _build(group: pd.DataFrame) -> pd.DataFrame:
    """One row for a shard: its transform and its segments. The order itself need not travel: the transform has it."""
    texts = group["bytes"].tolist()
    symbols = np.append(np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + np.uint16(1), np.uint16(0))
    row = {
        "bucket": group["bucket"].iloc[0], "shard": group["shard"].iloc[0], "transform": packed(transform_of(symbols)),
        "sizes": packed(np.array([len(t) for t in texts], np.int32)), **{c: packed(group[c].to_numpy(np.int64)) for c in ("doc", "sub", "at")},
    }
    return pd.DataFrame([row])


_SHARD = "bucket long, shard int, transform binary, sizes binary, doc binary, sub binary, at binary"


def steps_back(transform: np.ndarray) -> np.ndarray:
    """For each rotation the place, in the same order, of the rotation that starts one symbol earlier."""
    out = np.empty(len(transform), np.int64)
    out[np.argsort(transform, kind="stable")] = np.arange(len(transform))
    return out


def starts_of(transform: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Where each rotation starts: its steps back to the rotation that the end stands before, by pointer doubling."""
    nxt, far = back.copy(), np.ones(len(back), np.int64)
    first = int(np.flatnonzero(transform == 0)[0])
    nxt[first], far[first] = first, 0
    for _ in range(max(1, len(back)).bit_length()):
        far += far[nxt]
        nxt = nxt[nxt]
    return far


def before(transform: np.ndarray, back: np.ndarray, stride: int) -> np.ndarray:
    """For each rotation the `stride` symbols before it as one number, the nearest in the lowest bits."""
    out, at = np.zeros(len(transform), np.uint64), np.arange(len(transform))
    for i in range(stride):
        out |= transform[at].astype(np.uint64) << np.uint64(9 * i)
        at = back[at]
    return out


# ---------------------------------------------------------------- merging


def merged(transforms: list[np.ndarray], length: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Merges shards' transforms: (rotation, block) by place of the merged order.

    Rotations are numbered shard by shard, each shard in its own order; rotations of one block agree on `length` symbols.
    Only the interleaving (whose shard stands at a place) is kept between steps: a stable sort of the places by the
    symbols before them turns an order by h symbols into one by h + stride, and blocks split where those symbols or the
    blocks behind them differ."""
    sizes = [len(t) for t in transforms]
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint8 if len(sizes) <= 256 else np.uint16), sizes)
    block = np.zeros(len(shard), np.int32)
    whole = np.concatenate(transforms)

    def codes(values: np.ndarray) -> np.ndarray:
        found, code = np.unique(values, return_inverse=True)
        return code.astype(np.uint16 if len(found) <= 1 << 16 else np.uint32)

    steps = [codes(whole)] * (length // stride)
    if rest := length % stride:
        steps.append(codes(whole & np.uint64((1 << (9 * rest)) - 1)))
    rotation = np.argsort(shard, kind="stable")
    numbered = np.arange(len(shard))
    place = np.empty(len(shard), np.int64)
    place[rotation] = numbered
    for code in steps:
        here = code[place]
        order = np.argsort(here, kind="stable")
        shard, here, block = shard[order], here[order], block[order]
        changes = (here[1:] != here[:-1]) | (block[1:] != block[:-1])
        block = np.zeros(len(shard), np.int32)
        np.cumsum(changes, out=block[1:])
        place = np.empty(len(shard), np.int64)
        place[np.argsort(shard, kind="stable")] = numbered
    return place, block


def _merge(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Repeated strings of a bucket, as (doc, sub, at)."""
        group = group.sort_values("shard")
        transforms = [unpacked(x, np.uint16) for x in group["transform"]]
        backs = [steps_back(t) for t in transforms]
        rotation, block = merged([before(t, b, STRIDE) for t, b in zip(transforms, backs)], length)
        # Where each rotation lies: its segment, and its offset there; -1 for the shards' ends.
        segment, offset, doc, sub, at, base = [], [], [], [], [], 0
        for t, b, (_, r) in zip(transforms, backs, group.iterrows()):
            order, sizes = starts_of(t, b), unpacked(r["sizes"], np.int32).astype(np.int64)
            owner = np.append(np.repeat(np.arange(len(sizes)), sizes), -1)
            inside = np.append(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), 0)
            segment.append(np.where(owner[order] >= 0, owner[order] + base, -1))
            offset.append(inside[order])
            for kept, name in ((doc, "doc"), (sub, "sub"), (at, "at")):
                kept.append(unpacked(r[name], np.int64))
            base += len(sizes)
        segment, offset = np.concatenate(segment)[rotation], np.concatenate(offset)[rotation]
        doc, sub, at = np.concatenate(doc), np.concatenate(sub), np.concatenate(at)
        strings = at & 0xFF
        valid = (segment >= 0) & (offset < np.where(segment >= 0, strings[segment], 0))
        segment, offset, block = segment[valid], offset[valid], block[valid]
        twice = np.bincount(block)[block] > 1 if len(block) else np.zeros(0, bool)
        segment, offset, block = segment[twice], offset[twice], block[twice]
        place = (at[segment] >> 8) + offset
        by = np.lexsort((place, sub[segment], doc[segment], block))
        late = np.ones(len(by), bool)
        late[: 1] = False
        late[1:] = block[by][1:] == block[by][:-1]
        # Neighbouring strings of one segment leave as one run.
        segment, offset = segment[by][late], offset[by][late]
        by = np.lexsort((offset, segment))
        segment, offset = segment[by], offset[by]
        new = np.ones(len(by), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (offset[1:] != offset[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(by)))
        s = segment[first]
        return pd.DataFrame({"doc": doc[s], "sub": sub[s], "at": ((at[s] >> 8) + offset[first] << 8) | n})

    return run


# ---------------------------------------------------------------- the operator


def _cut(length: int, mode: str, as_text: bool = False):
    """A mapInArrow function over (doc, sub, text, ats): the bytes of each segment, or what is left of the text."""

    def spans(ats: list[int]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in sorted(ats):
            start = at >> 8
            end = start + (at & 0xFF) + length - 1
            if out and start <= out[-1][1]:
                out[-1][1] = max(out[-1][1], end)
            else:
                out.append([start, end])
        return out

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                b = whole.slice(lo, 200)
                doc, sub, anchor, content, at, cut = [], [], [], [], [], []
                for d, u, z, found in zip(*(b.column(n).to_pylist() for n in ("doc", "sub", "zipped", "found"))):
                    t = unzip(z)
                    for f in found:
                        start = f["at"] >> 8
                        for x, v in ((doc, d), (sub, u), (anchor, f["anchor"]), (content, f["content"]), (at, f["at"]), (cut, t[start : start + (f["at"] & 0xFF) + length - 1])):
                            x.append(v)
                yield pa.record_batch([*(pa.array(x, pa.int64()) for x in (doc, sub, at, anchor, content)), pa.array(cut, pa.binary())], ["doc", "sub", "at", "anchor", "content", "bytes"])

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                b = whole.slice(lo, 200)
                texts, kept, removed, runs = [], [], [], []
                for z, ats in zip(b.column("zipped").to_pylist(), b.column("ats").to_pylist()):
                    texts.append(None if z is None else unzip(z))
                    t, cut, at, parts = texts[-1] or b"", spans(ats or []), 0, []
                    for x, y in cut:
                        parts.append(t[at:x])
                        at = y
                    kept.append(b"".join([*parts, t[at:]]))
                    removed.append(len(t) - len(kept[-1]))
                    runs.append(len(cut))
                left_over = pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                others = [(n, c) for n, c in zip(b.schema.names, b.columns) if n[0] == "c"]
                made = [("text", pa.array(texts, pa.binary()).cast(pa.string())), ("kept", left_over), ("n_removed", pa.array(removed, pa.int64())), ("n_spans", pa.array(runs, pa.int64()))]
                yield pa.record_batch([c for _, c in others + made], [n for n, _ in others + made])

    return {"pieces": pieces, "left": left}[mode]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """`docs` with kept (binary: the UTF-8 bytes left; with as_text a string, without the bytes of cut characters), n_removed and n_spans.

    A byte goes if a string of `length` bytes covers it that also starts earlier: in a smaller id, or in the same text.
    Texts are bytes, so what is left need not be UTF-8. Null texts count as empty. Ids are 0 or more; a null id comes
    before all others, such rows in the order of their texts' hashes; rows that share an id are ordered by their texts'
    hashes, and rows of equal id and text count once and get equal results. Columns named kept, n_removed or n_spans are
    replaced; all others pass through."""
    if not gram <= length <= gram + 254:
        raise ValueError("length must lie between gram and gram + 254")
    docs = docs.drop("kept", "n_removed", "n_spans")
    names = docs.columns
    others = [n for n in names if n != text_col]
    text = F.col(text_col).cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    doc = F.coalesce(F.col(id_col).cast("long"), F.shiftrightunsigned(F.xxhash64(raw), 1) + F.lit(-(1 << 63)))
    # Only where ids repeat do rows need the hash of their text to be told apart, and equal ones to be one.
    repeat = not docs.select(doc.alias("doc")).groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    place = {"doc": doc, "sub": F.xxhash64(raw) if repeat else F.lit(0).cast("long")}
    once = (lambda rows: rows.dropDuplicates(["doc", "sub"])) if repeat else (lambda rows: rows)
    laid = once(docs.select(*(v.alias(k) for k, v in place.items()), raw.alias("text")))
    same, by_anchor = Window.partitionBy("anchor", "content").orderBy("doc", "sub", "at"), Window.partitionBy("anchor")
    hot, size = hot_anchors(laid, length, gram), F.sum(F.col("at").bitwiseAND(F.lit(0xFF)) + (length - 1))
    while True:
        met = segments(laid, length, gram, hot)
        ranked = met.repartition("anchor").withColumn("nth", F.row_number().over(same))
        ranked = ranked.withColumns({"n": F.count("*").over(by_anchor), "low": F.min("content").over(by_anchor), "high": F.max("content").over(by_anchor)})
        repeated = durable(ranked.where("late or n > 1").where("late or nth > 1 or low < high").select(F.when(~F.col("late") & (F.col("nth") == 1), F.col("anchor")).alias("anchor"), "content", "doc", "sub", "at"))
        late = repeated.where("anchor is null").select("doc", "sub", "at")
        firsts = repeated.where("anchor is not null")
        # What was not foretold, a phrase that one unsampled text repeats, say, is counted here and dealt by string as well.
        over = firsts.groupBy("anchor").agg(size.alias("bytes")).where(F.col("bytes") > HOT_BYTES).orderBy(F.desc("bytes"), "anchor").limit(HOT_ANCHORS).select("anchor").toArrow()
        found = np.setdiff1d(over.column(0).to_numpy().astype(np.int64).view(np.uint64), hot)
        if not len(found):
            break
        hot = np.union1d(hot, found)
    total = firsts.agg(size).first()[0] or 0
    buckets = max(1, -(-total // (SHARD_BYTES * SHARDS)))
    tasks = -(-buckets // TASK_BUCKETS)
    wanted = firsts.groupBy("doc", "sub").agg(F.collect_set(F.struct("anchor", "content", "at")).alias("found"))
    # Texts travel compressed. Both joins below read the same columns by the same keys, so that one shuffle may serve both.
    held = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(others)), *(v.alias(k) for k, v in place.items()), text.alias("text"))
    kinds = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(others))
    zipped = held.mapInArrow(lean(_zip), f"{kinds}doc long, sub long, zipped binary")
    cut = once(zipped).join(wanted, ["doc", "sub"]).mapInArrow(lean(_cut(length, "pieces")), "doc long, sub long, at long, anchor long, content long, bytes binary")
    dealt = cut.select(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket"), F.pmod(F.xxhash64("content"), F.lit(SHARDS)).cast("int").alias("shard"), "doc", "sub", "at", "bytes")
    # The number of tasks follows the bytes to be merged, not the size of what is shuffled, which is compressed.
    built = dealt.repartition(tasks, "bucket", "shard").groupBy("bucket", "shard").applyInPandas(_build, _SHARD)
    found = built.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(_merge(length), "doc long, sub long, at long")
    gone = late.union(found).groupBy("doc", "sub").agg(F.collect_set("at").alias("ats"))
    out = zipped.join(gone, ["doc", "sub"], "left").mapInArrow(lean(_cut(length, "left", as_text)), f"{kinds}text string, kept {'string' if as_text else 'binary'}, n_removed long, n_spans long")
    back = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {text_col: F.col("text")}
    return out.select(*(back[c].alias(c) for c in names), "kept", "n_removed", "n_spans")


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's texts, compressed one by one."""
    shrink = zstandard.ZstdCompressor(level=3).compress
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            b = whole.slice(lo, 500)
            texts = [None if t is None else shrink(t.encode()) for t in b.column("text").to_pylist()]
            yield pa.record_batch([*b.columns[:-1], pa.array(texts, pa.binary())], [*b.schema.names[:-1], "zipped"])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document after its repeated 100-byte strings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = remove_repeats(docs)
    return rows.select("doc_id", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
