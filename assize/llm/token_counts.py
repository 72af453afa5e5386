"""Token counts of byte-level BPE by rank-synchronous array merging.

All unseen pre-tokens of a batch lie in one ragged array of symbols. In every round each of them applies its lowest-rank
pair at all its places, left to right; what no pair fits is finished, and its surviving symbols are its token count.
A merge's product only takes part in pairs of higher rank, so a round equals that many single merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table
from .pretokens import Memory, compiled, made, pieces, shipped

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 512


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class ArrayMerger:
    """Counts tokens of many byte strings at once."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        ids = spec["model"]["vocab"]
        stand_in = byte_symbols()
        self.first = np.array([ids[stand_in[b]] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.products = np.array([ids[a + b] for a, b in merges], np.int64)
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]

    def ranked(self, symbols: np.ndarray) -> np.ndarray:
        """Rank of each symbol with the next one; len(keys) if they don't merge. The last symbol pairs with none."""
        out = np.full(len(symbols), len(self.keys), np.int64)
        if len(symbols) > 1:
            pairs = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            out[:-1] = np.where(self.keys[at] == pairs, self.ranks[at], len(self.keys))
        return out

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        none = len(self.keys)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = np.zeros(len(tokens), np.int64)
        who = np.flatnonzero(sizes)
        sizes = sizes[who]
        symbols = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        while len(who):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            rank = self.ranked(symbols)
            rank[ends - 1] = none
            least = np.minimum.reduceat(rank, starts)
            going = least < none
            out[who[~going]] = sizes[~going]
            if not going.any():
                break
            live = np.repeat(going, sizes)
            hit = np.flatnonzero((rank == np.repeat(least, sizes)) & live)
            # In a run of overlapping places (the pair of a symbol with itself) every second one merges.
            breaks = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            hit = hit[(hit - np.repeat(hit[breaks], np.diff(breaks, append=len(hit)))) % 2 == 0]
            symbols[hit] = self.products[rank[hit]]
            live[hit + 1] = False
            gone = np.zeros(len(symbols), np.int64)
            gone[hit + 1] = 1
            sizes = (sizes - np.add.reduceat(gone, starts))[going]
            symbols, who = symbols[live], who[going]
        return out


class TokenCounter:
    """Counts of whole texts, with memories of pre-tokens and of the pieces between spaces."""

    def __init__(self, vocabulary: bytes):
        import re

        self.merger = ArrayMerger(vocabulary)
        self.pattern = compiled(PATTERN)
        self.pretokens, self.pieces = Memory(), Memory()
        self.special = re.compile("|".join(map(re.escape, sorted(self.merger.specials, key=len, reverse=True)))) if self.merger.specials else None

    def of_pieces(self, new: list[str]) -> list[int]:
        split = [self.pattern.findall(p) for p in new]
        self.pretokens.learn((t for s in split for t in s), lambda ts: self.merger.counts([t.encode() for t in ts]).tolist())
        get = self.pretokens.__getitem__
        return [sum(map(get, s)) for s in split]

    def of_texts(self, texts: list[str | None]) -> list[int]:
        specials, cuts, whole = [], [], []
        for t in texts:
            plain = self.special.split(t) if t and self.special else [t or ""]
            specials.append(len(plain) - 1)
            cut = [pieces(p) for p in plain]
            whole.append([p for p, c in zip(plain, cut) if c is None])
            cuts.append([p for c in cut if c for p in c])
        self.pieces.learn((p for c in cuts for p in c), self.of_pieces)
        get = self.pieces.__getitem__
        return [n + sum(map(get, c)) + (sum(self.of_pieces(w)) if w else 0) for n, c, w in zip(specials, cuts, whole)]


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 500) -> DataFrame:
    """(id_col, n_bytes, n_tokens) of every row. Null and empty texts have no bytes and no tokens; ids may be null or
    repeat; rows keep their partition, so nothing is shuffled. Special tokens' strings inside texts count one each."""
    data = shipped(docs.sparkSession, vocabulary_path)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = made("token_counts", data.value, TokenCounter)
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                b = whole.slice(at, slice_rows)
                n = counter.of_texts(b.column(2).to_pylist())
                yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(lean(run), f"id {id_type}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole document, and whether it is over the limit of 512 tokens."""
    import public_tokenizers

    rows = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.withColumn("over_limit", F.col("n_tokens") > LIMIT)
