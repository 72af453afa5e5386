"""Byte-level BPE encoding and decoding by a two-tier lookup.

A minimal perfect hash answers, for all new pre-tokens of a batch at once, whether a pre-token is itself in the
vocabulary. What it misses is merged by a heap of ranked pairs over a linked list of its bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, lean, mixed, table
from .pretokens import Memory, compiled, made, pieces, shipped


class PerfectHash:
    """A minimal perfect hash of byte strings: hash, displace, and place single-key buckets directly."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        self.n = len(keys)
        self.buckets = max(1, self.n // per_bucket)
        hashes = self.hashed(keys)
        if len(np.unique(hashes)) < self.n:
            raise ValueError("two keys have one hash")
        #: Per bucket: a displacement (0 or more), or -1 - slot if its only key has that slot.
        self.displaced = np.zeros(self.buckets, np.int64)
        self.key_at = np.zeros(self.n, np.int64)
        self.hash_at = np.zeros(self.n, np.uint64)
        bucket = (hashes >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1))
        groups = sorted(np.split(order, starts[1:]), key=len, reverse=True) if self.n else []
        taken = np.zeros(self.n, bool)
        free = None
        for group in groups:
            b = int(bucket[group[0]])
            if len(group) == 1:
                free = iter(np.flatnonzero(~taken).tolist()) if free is None else free
                slots = np.array([next(free)])
                self.displaced[b] = -1 - slots[0]
            else:
                d, slots = self.displacement(hashes[group], taken)
                self.displaced[b] = d
            taken[slots] = True
            self.key_at[slots], self.hash_at[slots] = group, hashes[group]

    def displacement(self, hashes: np.ndarray, taken: np.ndarray, tries: int = 32) -> tuple[int, np.ndarray]:
        """The first displacement that sends the hashes to different free slots."""
        first = 0
        while True:
            slots = self.slot(hashes, np.arange(first, first + tries, dtype=np.uint64)[:, None])
            fits = ~taken[slots].any(axis=1)
            for i in np.flatnonzero(fits):
                if len(set(slots[i].tolist())) == len(hashes):
                    return first + int(i), slots[i]
            first += tries

    @staticmethod
    def hashed(keys: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        ends = np.cumsum(sizes)
        return mixed(Rolling(np.frombuffer(b"".join(keys), np.uint8)).of(ends - sizes, ends) + sizes.astype(np.uint64))

    def slot(self, hashes: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mixed(hashes + d * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each key the index of a stored key of the same hash, or -1."""
        h = self.hashed(keys)
        d = self.displaced[((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)]
        at = np.where(d < 0, -1 - d, self.slot(h, np.maximum(d, 0).astype(np.uint64)))
        return np.where(self.hash_at[at] == h, self.key_at[at], -1)


class ByteBpe:
    """Encodes and decodes texts by a table of ranks."""

    def __init__(self, vocabulary: bytes, pattern: str, whole: PerfectHash | None = None):
        pairs = [line.split() for line in vocabulary.splitlines() if line]
        self.tokens = [base64.b64decode(a) for a, _ in pairs]
        self.ids = np.array([int(b) for _, b in pairs], np.int64)
        self.ranks = dict(zip(self.tokens, self.ids.tolist()))
        self.whole = whole or PerfectHash(self.tokens)
        self.pattern = compiled(pattern)
        self.pretokens, self.pieces = Memory(), Memory()
        #: Rank of each pair of bytes, -1 if it has none.
        self.pair_ranks = np.array([self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)], np.int64)
        self.ends = [*range(1, 65)]
        self.id_bytes = {t: i.to_bytes(4, "little") for t, i in self.ranks.items()}
        #: All tokens end to end, and by id where each lies.
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.size_of, self.start_of = (np.zeros(int(self.ids.max(initial=-1)) + 1, np.int64) for _ in range(2))
        self.size_of[self.ids], self.start_of[self.ids] = sizes, np.cumsum(sizes) - sizes

    def heaps(self, tokens: list[bytes]) -> tuple[int, Iterator[tuple[list[int], list[int]]]]:
        """An entry is rank << shift | place. For each pre-token: the entries of its pairs of bytes by place (-1: no pair), and
        a heap of them. All are sorted at once, as an ordered list is a heap."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        shift = max(13, int(sizes.max(initial=0)).bit_length())
        data = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64)
        ends, owner = np.cumsum(sizes), np.repeat(np.arange(len(tokens)), sizes)
        entries = np.full(len(data), -1, np.int64)
        entries[:-1] = self.pair_ranks[(data[:-1] << 8) | data[1:]]
        entries[ends[sizes > 0] - 1] = -1
        at = np.flatnonzero(entries >= 0)
        owner = owner[at]
        entries[at] = (entries[at] << shift) | (at - (ends - sizes)[owner])
        heap = entries[at][np.lexsort((entries[at], owner))].tolist()
        entries, ends = entries.tolist(), ends.tolist()
        cuts = np.cumsum(np.bincount(owner, minlength=len(tokens))).tolist()
        return shift, ((entries[lo:hi], heap[first:last]) for lo, hi, first, last in zip([0, *ends], ends, [0, *cuts], cuts))

    def merged(self, token: bytes, live: list[int], heap: list[int], shift: int) -> bytes:
        """Ids of a pre-token that is no token itself: lowest rank first, the leftmost of equals. An entry of the heap holds
        while it is its place's."""
        n, known, pop, push, mask = len(token), self.ranks.get, heapq.heappop, heapq.heappush, (1 << shift) - 1
        end, before = self.ends[:n] if n <= len(self.ends) else [*range(1, n + 1)], [*range(-1, n - 1)]
        while heap:
            entry = pop(heap)
            i = entry & mask
            if live[i] != entry:
                continue
            j = end[i]
            end[i] = stop = end[j]
            live[j] = -1
            if stop < n:
                before[stop] = i
                if (r := known(token[i : end[stop]])) is None:
                    live[i] = -1
                else:
                    live[i] = r = (r << shift) | i
                    push(heap, r)
            else:
                live[i] = -1
            if (p := before[i]) >= 0:
                if (r := known(token[p:stop])) is None:
                    live[p] = -1
                else:
                    live[p] = r = (r << shift) | p
                    push(heap, r)
        ids, out, i = self.id_bytes, [], 0
        while i < n:
            stop = end[i]
            out.append(ids[token[i:stop]])
            i = stop
        return b"".join(out)

    def of_pretokens(self, new: list[str]) -> list[bytes]:
        raw = [t.encode() for t in new]
        tokens, ids = self.tokens, self.id_bytes
        out = [ids[t] if at >= 0 and tokens[at] == t else None for t, at in zip(raw, self.whole.find(raw).tolist())]
        apart = [t for t, x in zip(raw, out) if x is None]
        shift, heaps = self.heaps(apart)
        made = (self.merged(t, live, heap, shift) for t, (live, heap) in zip(apart, heaps))
        return [next(made) if x is None else x for x in out]

    def of_pieces(self, new: list[str]) -> list[bytes]:
        split = list(map(self.pattern.findall, new))
        self.pretokens.learn(chain.from_iterable(split), self.of_pretokens)
        get = self.pretokens.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def encoded(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [pieces(t) if t else [] for t in texts]
        self.pieces.learn(chain.from_iterable(filter(None, cut)), self.of_pieces)
        get = self.pieces.__getitem__
        return [b"".join(map(get, c)) if c is not None else self.of_pieces([t])[0] for t, c in zip(texts, cut)]

    def decoded(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4")
        sizes = self.size_of[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.start_of[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def _tasks(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str, text_col: str, outputs: str, row, slice_rows: int) -> DataFrame:
    data = shipped(docs.sparkSession, vocabulary_path)
    # Built once; about 24 bytes for each of the vocabulary's entries, whose file's size shipped() has checked.
    whole = docs.sparkSession.sparkContext.broadcast(PerfectHash([base64.b64decode(x.split()[0]) for x in data.value.splitlines() if x]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("value"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {outputs}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = made("byte_bpe" + pattern, data.value, lambda d: ByteBpe(d, pattern, whole.value))
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                b = batch.slice(at, slice_rows)
                columns = list(zip(*row(bpe, b.column(1).to_pylist())))
                kinds = [pa.binary() if isinstance(x[0], bytes) else pa.string() if isinstance(x[0], str) else pa.int64() for x in columns]
                yield pa.record_batch([b.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds))], ["id", *(o.split()[0] for o in outputs.split(", "))])

    return rows.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 500) -> DataFrame:
    """(id_col, ids binary): the token ids of every whole text, as little-endian unsigned 32-bit integers; null texts
    count as empty, and an empty text has no ids. Ids of rows may be null or repeat. Nothing is shuffled."""
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return _tasks(docs, vocabulary_path, pattern, id_col, text_col, "ids binary", lambda bpe, texts: [(x,) for x in bpe.encoded(texts)], slice_rows)


def decode(encoded: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", slice_rows: int = 500) -> DataFrame:
    """(id_col, bytes binary): the inverse of encode; null ids count as none."""
    return _tasks(encoded, vocabulary_path, pattern, id_col, ids_col, "bytes binary", lambda bpe, rows: [(bpe.decoded(x or b""),) for x in rows], slice_rows)


def _digests(bpe: ByteBpe, texts: list[str | None]) -> list[tuple]:
    return [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decoded(ids)).hexdigest()) for ids in bpe.encoded(texts)]


def round_trip(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 500) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded in one pass: ids stay in the task."""
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return _tasks(docs, vocabulary_path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests, slice_rows)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, and digests of ids and of the decoded bytes, for every whole document."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
