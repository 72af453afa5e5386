"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition packs its pieces best-fit, longest first. Bins that are nearly full are final; the underfull ones go on as
items of their own to the next round, where the partitions of `fan_in` groups meet in one, until one group is left.
"""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, lean, table
from .pretokens import PUNCTUATION, Memory, made, shipped

CAPACITY, END_ID = 4096, 1


class WordTokenizer:
    """Ids of whole texts by the tokenizers library; what stands between white space is looked up once and remembered.

    New words go to the library many at a time, with a mark between them that is a token of its own. Of a word of lower-case
    letters, with or without punctuation behind, the normaliser changes nothing and the letters are one pre-token: those go to
    the library's model without its regular expressions, and the vocabulary itself says where one ends."""

    MARK, TOGETHER = "|", 64
    LETTERS, PUNCTUATION = re.compile("[a-zß-öø-ÿ]+"), PUNCTUATION.encode()
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    #: Words, and bytes in them, that a worker remembers: some 200 bytes a word with its ids, so 200 MB if words have 10 bytes.
    REMEMBERED = 1_500_000, 10 << 20

    def __init__(self, vocabulary: bytes, known: bytes | None = None):
        """`known`: what another one of the same vocabulary has kept."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary.decode())
        self.words = Memory(*self.REMEMBERED)
        if known:
            self.words.recall(pickle.loads(zstandard.decompress(known)))
        mark = self.library.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.plain = self.of_model()

    def of_model(self):
        """The library for words of letters alone; None if the vocabulary's rules aren't those that this knows."""
        from tokenizers import Tokenizer, pre_tokenizers

        rules = lambda x: json.loads(x.__getstate__()) if x is not None else {}
        first, *rest = rules(self.library.pre_tokenizer).get("pretokenizers", [{}])
        as_known = first.get("pattern") == {"Regex": self.SPLIT} and first.get("invert") and first.get("behavior") == "Removed" and [x["type"] for x in rest] == ["ByteLevel"]
        if not as_known or rules(self.library.normalizer).get("normalizers") != self.NORMALIZERS or not getattr(self.library.model, "end_of_word_suffix", None):
            return None
        suffix, ids = self.library.model.end_of_word_suffix, self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[i for t, i in ids.items() if t.endswith(suffix)]] = True
        plain = Tokenizer(self.library.model)
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return plain

    def kept(self) -> bytes:
        """The words asked for again, with their ids."""
        return zstandard.compress(pickle.dumps(self.words.frequent()), 1)

    def of_library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def of_marked(self, words: list[str]) -> dict[str, bytes]:
        apart = [w for w in words if self.mark is None or self.MARK in w]
        out = dict(zip(apart, self.of_library(apart)))
        plain = [w for w in words if w not in out] if apart else words
        groups = [plain[i : i + self.TOGETHER] for i in range(0, len(plain), self.TOGETHER)]
        for group, ids in zip(groups, self.of_library([f" {self.MARK} ".join(g) for g in groups])):
            at = 0
            for word, end in zip(group, [*np.flatnonzero(np.frombuffer(ids, np.uint32) == self.mark).tolist(), len(ids) // 4]):
                out[word] = ids[4 * at : 4 * end]
                at = end + 1
        return out

    def of_letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        texts = [b" ".join(words[i : i + self.TOGETHER]).decode() for i in range(0, len(words), self.TOGETHER)]
        ids = b"".join(array("I", e.ids).tobytes() for e in self.plain.encode_batch_fast(texts, add_special_tokens=False))
        ends = (4 * np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)]) + 4).tolist()
        if len(ends) != len(words):
            raise ValueError("a word has not one end")
        return {w: ids[lo:hi] for w, lo, hi in zip(words, [0, *ends], ends)}

    def of_words(self, new: list[bytes]) -> list[bytes]:
        # Punctuation after letters is a pre-token of its own.
        letters, known, ends, plain, others = self.LETTERS.fullmatch, self.words, {}, set(), set()
        stems = [w.rstrip(self.PUNCTUATION) for w in new] if self.plain is not None else []
        for i, stem in enumerate(stems):
            if stem.isalpha() or not stem.isascii() and letters(stem.decode()):
                if stem not in known:
                    plain.add(stem)
                if len(stem) < len(new[i]):
                    ends[i] = new[i][len(stem) :]
            else:
                stems[i] = new[i]
                others.add(new[i])
        stems, others = stems or new, {*others, *ends.values()} if stems else set(new)
        texts = {w.decode(): w for w in others}
        ids = self.of_letters([*plain]) | {texts[t]: x for t, x in self.of_marked([*texts]).items()}
        out = [ids[s] if s in ids else known[s] for s in stems]
        for i, end in ends.items():
            out[i] += ids[end]
        return out

    def of_texts(self, texts: list[str | None]) -> list[bytes]:
        """The vocabulary ignores case and white space, so words are ASCII-lowered and cut at ASCII white space first;
        texts in which a special token's string may occur go to the library whole."""
        raw = [(t or "").encode() for t in texts]
        cut = [None if b"<|" in r else r.lower().split() for r in raw]
        self.words.learn(set().union(*filter(None, cut)), self.of_words)
        get = self.words.__getitem__
        return [self.of_library([t])[0] if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut)]


#: What this worker's tokenizers have kept, by vocabulary.
_kept: dict[bytes, bytes] = {}


def _of_documents(docs: DataFrame, vocabulary_path: str, capacity: int, id_col: str, text_col: str, with_ids: bool, slice_rows: int, lasting: bool) -> tuple:
    """The rows (id, text), a mapInArrow function that makes pieces of them, and these' schema."""
    data = shipped(docs.sparkSession, vocabulary_path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = hashlib.sha1(data.value).digest()
        tokenizer = made("word_tokenizer", data.value, WordTokenizer) if lasting else WordTokenizer(data.value, _kept.get(name))
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                b = whole.slice(at, slice_rows)
                owner, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, found in enumerate(tokenizer.of_texts(b.column(1).to_pylist())):
                    found += end
                    for k, first in enumerate(range(0, len(found), 4 * capacity)):
                        part = found[first : first + 4 * capacity]
                        for x, v in ((owner, i), (piece, k), (start, first // 4), (length, len(part) // 4), (crc, zlib.crc32(part)), (ids, part)):
                            x.append(v)
                columns = [b.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.record_batch(columns + [pa.array(ids, pa.binary())] * with_ids, names)
        if not lasting:
            _kept[name] = tokenizer.kept()

    return rows, run, schema


def token_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, slice_rows: int = 500, lasting: bool = True) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]) of every document: its ids and END_ID, cut only if longer than
    `capacity`. A null or empty text has the one id END_ID. Ids may be null or repeat. Nothing is shuffled. Workers keep
    their tokenizer if it is `lasting`; if not, the words asked for again alone, compressed, and their memory is others'."""
    rows, run, schema = _of_documents(docs, vocabulary_path, capacity, id_col, text_col, with_ids, slice_rows, lasting)
    return rows.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill: longest first, into the bin with the least room that fits."""
    bins, offsets, fills = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if left := room - n:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _packer(length_col: str, capacity: int, closed_room: int, carry: int, level: int):
    """A mapInArrow function that packs a partition: adds bin, offset, bin_fill and open (on a bin's first item).

    Of the bins with more than `closed_room` left the `carry` emptiest go on. More would save no bin: two bins of one
    best-fit packing never fit into one, so one at most is half full or less; a group of partitions thus has one such bin for
    each of them to place, and more carried bins than that, each with more room than any bin that stays behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        lengths = rows.column(length_col).to_numpy()
        if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
            raise ValueError(f"lengths must lie between 1 and {capacity}")
        bins, offsets, fills = best_fit(lengths, capacity)
        underfull = np.flatnonzero(capacity - fills > closed_room)
        open_bins = np.zeros(len(fills), bool)
        open_bins[underfull[np.argsort(fills[underfull], kind="stable")[:carry]]] = True
        names = (level << 56) + (TaskContext.get().partitionId() << 32) + bins
        new = {"bin": names, "offset": offsets, "bin_fill": fills[bins], "open": open_bins[bins] & (offsets == 0)}
        for name, value in new.items():
            rows = rows.append_column(name, pa.array(value))
        yield from rows.to_batches(max_chunksize=10_000)

    return run


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, closed_room: int = 8, fan_in: int = 16) -> DataFrame:
    """`pieces` with sequence_id and offset (gapless from 0 in each sequence); no sequence exceeds `capacity`.

    Every row takes its own place, repeated and null-keyed rows too; lengths are 1 to `capacity`, others raise. Columns
    named sequence_id or offset are replaced, all others pass through; an empty table gives an empty result."""
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    inner = pieces.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)))
    length = f"c{names.index(length_col)}"
    schema = ", ".join(f"{c} {t}" for c, t in inner.dtypes)
    first = inner.mapInArrow(_packer(length, capacity, closed_room, 2 * fan_in, 1), f"{schema}, {_PLACE}")
    return _rounds(first, inner.columns, capacity, closed_room, fan_in).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "sequence_id", "offset")


def packed_documents(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 500, lasting: bool = True, closed_room: int = 8, fan_in: int = 16) -> DataFrame:
    """pack(token_pieces(docs)) without ids. One Python worker does both for a partition: with a second one in the same task
    the two change places from task to task, so that twice as many remember words and each sees half of them."""
    rows, run, schema = _of_documents(docs, vocabulary_path, capacity, id_col, text_col, False, slice_rows, lasting)
    placing = _packer("length", capacity, closed_room, 2 * fan_in, 1)
    first = rows.mapInArrow(lean(lambda batches: placing(run(batches))), f"{schema}, {_PLACE}")
    return _rounds(first, ["id", "piece", "start", "length", "ids_crc32"], capacity, closed_room, fan_in).withColumnRenamed("id", id_col)


#: What a packer adds to its rows.
_PLACE = "bin long, offset long, bin_fill long, open boolean"


def _rounds(first: DataFrame, columns: list[str], capacity: int, closed_room: int, fan_in: int) -> DataFrame:
    """`columns`, sequence_id and offset of pieces that are packed by partition."""
    carry, placed = 2 * fan_in, durable(first)
    groups = placed.rdd.getNumPartitions()
    items = placed.where("open").select(F.col("bin").alias("child"), F.col("bin_fill").alias("length"))
    result = placed.select(*columns, "bin", "offset")
    level = 2
    while groups > 1:
        groups = -(-groups // fan_in)
        moved = durable(items.coalesce(groups).mapInArrow(_packer("length", capacity, closed_room, carry, level), f"child long, length long, {_PLACE}"))
        step = moved.select("child", F.col("bin").alias("into"), F.col("offset").alias("shift"))
        result = result.join(step, result["bin"] == step["child"], "left").select(
            *columns, F.coalesce("into", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
        )
        items = moved.where("open").select(F.col("bin").alias("child"), F.col("bin_fill").alias("length"))
        level += 1
    return result.select(*columns, F.col("bin").alias("sequence_id"), "offset")


def op4_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, by piece."""
    import public_tokenizers

    packed = packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
