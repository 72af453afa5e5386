"""Quality classifier: per-document perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of order 3: trigrams of words, interpolated with continuation bigrams, continuation unigrams and a uniform
share for unknown words, with the three discounts of the modified method at each order; all trusted documents of the training
half fit it. N-grams are counted, valued and kept in packed arrays, a row for each shard of keys: pairs meet there with what
the shards of the vocabulary say of their words, triples go from the shard of their last pair to that of their first with p2.

A document's log probability is a sum of independent lookups: for each word log p1(w) + log gamma(w), for each bigram
log(1 + (N - D) / (C gamma(c) p1(w))) + log gamma(bigram), for each trigram log(1 + (n - D) / (C gamma(c) p2(w))), and nothing
for what the model lacks. So each task turns a chunk of texts into one compressed list of (key, documents) for each shard, and
a shard answers with partial sums by document. The most frequent keys, a fixed number, are answered on the spot; a Bloom
filter of fixed size keeps many n-grams that the model lacks from being sent. Documents are scored in slices, one after
another, so that the requests of one are gone before the next, and a shard answers the requests of a bounded number of input
partitions at a time. Rejected is what lies above a quantile of the trusted documents of its own language.

A mean over a whole text hides a few hostile words in ordinary prose. So a document has a second score, its worst word: the
largest log ratio of a word's Kneser-Ney unigram probability in labelled toxic text to that in trusted text. Words of all
languages count together there; a bounded table of the words with the largest ratios is looked up on the spot, and the
shards answer for all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from .common import Rolling, Sharded, Table, chunks, durable, lean, lean_group, mixed, packed, shuffle_partitions, table, tidied, unpacked

#: Slices of the shards whose n-grams are valued one after another, and slices of the documents that are scored one after
#: another: the shuffles of one go before the next.
SLICES, SCORED_SLICES = 4, 6
#: Training ids that are broadcast to find their texts; more are joined.
BROADCAST_IDS = 1 << 20
QUANTILE = 0.995
#: A language's threshold counts as many documents as calibrate it, and that of all languages together as this many.
PRIOR_DOCS = 100
#: Languages whose table of thresholds is broadcast; more are joined.
BROADCAST_LANGUAGES = 10_000
#: A score counts this many tokens of its language's mean, so that a few words alone don't reject a document.
PRIOR_TOKENS = 20
CHUNK_BYTES, HOT_KEYS, BLOOM_BITS = 3 << 20, 65536, 1 << 27
#: Input partitions whose requests to a shard meet in one group, at most: with more of them there are more slices.
BLOCK_PARTITIONS = 64
#: Words whose contrast of toxic and trusted text is looked up on the spot, those with the largest; shards answer for the rest.
CONTRAST_WORDS = 65536
#: What tells the key of a word's contrast from that of the word, besides the parts that the model has.
_CONTRAST = np.uint64(0x5DEECE66D)
#: What a key is looked up for: an n-gram of several words, a word, a word's contrast.
SEVERAL, WORD, CONTRAST = 0, 1, 2
#: What an entry of the model is.
SINGLE, PAIR, TRIPLE = 0, 1, 2
_BEGIN, _END = np.uint64(0x1234567), np.uint64(0x7654321)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _roots(langs: list[str | None]) -> np.ndarray:
    """One number for each language; null is a language of its own."""
    names = [("" if x is None else "=" + x).encode() for x in langs]
    ends = np.cumsum(np.fromiter(map(len, names), np.int64, len(names)))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return mixed(Rolling(np.frombuffer(b"".join(names), np.uint8)).of(starts, ends) + np.uint64(1)) if names else np.zeros(0, np.uint64)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = 1 << 18) -> np.ndarray:
    """Hashes of the words of a buffer, of about `size` bytes of it at a time: prefix sums take many times their bytes."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + size, side="right")))
        out[at:to] = Rolling(data[lo : ends[to - 1]]).of(starts[at:to] - lo, ends[at:to] - lo)
        at = to
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word, with a begin and an end for each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    word = ~space
    starts = np.flatnonzero(word & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], word[:-1]]))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    hashes = _hashes(data, starts, ends)
    n = np.bincount(owner, minlength=len(texts))
    doc = np.repeat(np.arange(len(texts)), n + 2)
    first = np.cumsum(n + 2) - (n + 2)
    keys = np.empty(len(doc), np.uint64)
    inner = np.ones(len(doc), bool)
    inner[first] = inner[first + n + 1] = False
    keys[inner] = hashes
    keys[first], keys[first + n + 1] = _BEGIN, _END
    return doc, keys


def word_keys(texts: list[bytes], roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of every word, with a begin and an end for each text; keys depend on the language."""
    doc, hashes = word_hashes(texts)
    return doc, mixed(hashes ^ roots[doc])


def _joined(a: np.ndarray, b: np.ndarray, order: int) -> np.ndarray:
    """Keys of n-grams of `order`, from those of all but the last word and of the last."""
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(order))


def _followed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of triples, from those of their first pairs and of their last words; their upper 16 bits, which say the shard, are the pair's."""
    return _joined(before, word, 3) & np.uint64((1 << 48) - 1) | before & ~np.uint64((1 << 48) - 1)


def ngram_keys(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of every bigram and trigram, in the same key space."""
    pairs = _joined(keys[:-1], keys[1:], 2)
    two, three = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    return np.concatenate([doc[1:][two], doc[2:][three]]), np.concatenate([pairs[two], _followed(pairs[:-1][three], keys[2:][three])])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i, (lang, text) in enumerate(zip(batch.column("lang"), batch.column("text"))):
        yield i, lang.as_py(), (text.as_py() or "").encode()


# ---------------------------------------------------------------- the model


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the keys' upper 16 bits."""
    return ((keys >> np.uint64(48)) * np.uint64(shards) >> np.uint64(16)).astype(np.int64)


def _cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in sorted keys, and their end."""
    return np.append(np.searchsorted(keys, _bounds(shards)), len(keys))


def _ascending(a: np.ndarray) -> bytes:
    return packed(np.diff(a, prepend=a.dtype.type(0)))


def _summed(blob: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpacked(blob, dtype), dtype=dtype)


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins."""
    if not len(sorted_columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_columns])]))


def _ordered(pair: np.ndarray, a: np.ndarray, words: int) -> np.ndarray:
    """The order by pairs of so many words, then by `a`, which is one more at most."""
    return np.argsort(pair * (words + 1) + a) if words < 1 << 20 else np.lexsort((a, pair))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(x), f.type) for x, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def _binaries(*names: str) -> list:
    return [(x, pa.binary()) for x in names]


#: Words of a part of the n-grams (sorted), their languages' roots, and which is whose.
_WORDS = _binaries("words", "langs", "lang_of")
#: N-grams as places in `words`: context, word, and one more than the word before, 0 where a text begins.
_GRAMS = pa.schema([("shard", pa.int32()), *_WORDS, *_binaries("b", "c", "a", "n")])
#: A shard's n-grams, each pair once: `sizes` says how many triples it has. h3 and h2 count the triples and pairs that occur 1 to 4 times.
_SHARD = pa.schema([("shard", pa.int32()), ("shards", pa.int32()), *_WORDS, *_binaries("b", "c", "sizes", "a", "n"), ("h3", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64()))])
#: Of each word: pairs it begins by their types (all, and how many have 1, 2, more), its uses as a context; pairs it ends, its uses.
_COUNTS = ("total", "t1", "t2", "t3", "uses", "types", "weight")
_PARTS = pa.schema([("shard", pa.int32()), ("source", pa.int32()), *_WORDS, *_binaries(*_COUNTS)])
_VOCABULARY = pa.schema([("shard", pa.int32()), ("shards", pa.int32()), *_WORDS, *_binaries(*_COUNTS), ("sources", pa.list_(pa.int32())), ("picks", pa.list_(pa.binary())), ("h1", pa.list_(pa.int64()))])
_OF_WORDS = pa.schema([("shard", pa.int32()), ("part", pa.int32()), *_binaries("total", "freed", "p1")])
#: Entries on their way to their shard: words, pairs, and triples with the key of their first pair.
_ENTRIES = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), *_binaries("before", "keys", "value", "weight")])
#: The model: a row or more for each shard, with its most frequent keys and its share of the Bloom filter.
_MODEL = pa.schema([("shard", pa.int32()), ("shards", pa.int32()), *_binaries("keys", "value", "hot_keys", "hot_values", "bloom")])


def _languages(roots: np.ndarray) -> tuple[bytes, bytes]:
    langs, lang_of = np.unique(roots, return_inverse=True)
    return packed(langs), packed(lang_of.astype(np.uint32))


def _roots_of(row: dict) -> np.ndarray:
    return unpacked(row["langs"], np.uint64)[unpacked(row["lang_of"], np.uint32)]


def _histogram(n: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5].tolist()


def ngram_counts(docs: DataFrame, triples: bool = True) -> DataFrame:
    """How often each word follows each two, of texts given as (lang, text): packed, a row for each shard of pairs; without
    `triples` the pairs alone."""
    shards = shuffle_partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(_rows(batch), CHUNK_BYTES):
                roots = _roots([r[1] for r in part])
                doc, keys = word_keys([r[2] for r in part], roots)
                at = np.flatnonzero(doc[1:] == doc[:-1])
                begins = np.concatenate([[True], doc[1:] != doc[:-1]])[at]
                words, first, place = np.unique(keys, return_index=True, return_inverse=True)
                of_word, place = roots[doc[first]], place.astype(np.int64)
                shard = _shard(_joined(keys[at], keys[at + 1], 2), shards).astype(np.uint16)
                pair = place[at] * len(words) + place[at + 1]
                a = np.where(begins, 0, place[at - 1] + 1) if triples else np.zeros(len(at), np.int64)
                del doc, keys, at, begins, place
                order = _ordered(pair, a, len(words))
                order = order[np.argsort(shard[order], kind="stable")]
                shard, pair, a = shard[order], pair[order], a[order]
                del order
                first = _starts(pair, a)
                n = np.diff(np.append(first, len(pair))).astype(np.uint64)
                b, c, a = pair[first] // len(words), pair[first] % len(words), a[first]
                cuts, rows = np.searchsorted(shard[first], np.arange(shards + 1)), []
                # One more than a word's place in the chunk, so that a word before may be none; and its place in a shard.
                local, has = np.zeros(len(words) + 1, np.uint32), np.zeros(len(words) + 1, bool)
                for s in range(shards):
                    lo, hi = cuts[s], cuts[s + 1]
                    if lo < hi:
                        has[:] = False
                        has[b[lo:hi] + 1] = has[c[lo:hi] + 1] = has[a[lo:hi]] = True
                        own = np.flatnonzero(has[1:])
                        local[own + 1] = np.arange(1, len(own) + 1)
                        rows.append((s, _ascending(words[own]), *_languages(of_word[own]), _ascending(local[b[lo:hi] + 1] - np.uint32(1)), packed(local[c[lo:hi] + 1] - np.uint32(1)), packed(local[a[lo:hi]]), packed(n[lo:hi])))
                yield _batch(_GRAMS, rows)

    def merged(key: tuple, grams: pa.Table) -> pa.Table:
        rows = grams.to_pylist()
        held = [_summed(r["words"], np.uint64) for r in rows]
        words = np.unique(np.concatenate(held))
        of_word, columns = np.zeros(len(words), np.uint64), []
        for row, own in zip(rows, held):
            at = np.searchsorted(words, own)
            of_word[at] = _roots_of(row)
            a = unpacked(row["a"], np.uint32).astype(np.int64)
            pair = at[_summed(row["b"], np.uint32)] * len(words) + at[unpacked(row["c"], np.uint32)]
            columns.append((pair, np.where(a > 0, at[np.maximum(a - 1, 0)] + 1, 0), unpacked(row["n"], np.uint64)))
        pair, a, n = (np.concatenate(x) for x in zip(*columns))
        order = _ordered(pair, a, len(words))
        pair, a = pair[order], a[order]
        first = _starts(pair, a)
        pair, a, n = pair[first], a[first], _sums(n[order], first)
        first = _starts(pair)
        types = _sums(np.where(a == 0, n, 1).astype(np.uint64), first)
        sizes = np.diff(np.append(first, len(pair))).astype(np.uint32)
        b, c = ((x(pair[first], len(words))).astype(np.uint32) for x in (np.floor_divide, np.remainder))
        row = (key[0].as_py(), shards, _ascending(words), *_languages(of_word), _ascending(b), packed(c), packed(sizes), packed(a.astype(np.uint32)), packed(n), _histogram(n[a > 0]), _histogram(types))
        return pa.Table.from_batches([_batch(_SHARD, [row])])

    parts = docs.select("lang", "text").mapInArrow(lean(run), from_arrow_schema(_GRAMS))
    return parts.groupBy("shard").applyInArrow(lean_group(merged), from_arrow_schema(_SHARD))


def _grams(row: dict) -> tuple[np.ndarray, ...]:
    """(words, b, c, sizes, a, n, types, weight) of a shard; types and weight of its pairs."""
    b, c, sizes, a = _summed(row["b"], np.uint32), *(unpacked(row[x], np.uint32) for x in ("c", "sizes", "a"))
    n = unpacked(row["n"], np.uint64)
    first = np.cumsum(sizes, dtype=np.int64) - sizes
    types = _sums(np.where(a == 0, n, 1).astype(np.uint64), first)
    return _summed(row["words"], np.uint64), b.astype(np.int64), c.astype(np.int64), sizes, a.astype(np.int64), n, types, _sums(n, first)


def discounts(counts_of_counts: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts of the modified method, from how many n-grams occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (max(counts_of_counts.get(i, 0), 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return tuple(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))


def _counted(rows: DataFrame, column: str) -> tuple[float, float, float]:
    found = rows.select(*(F.sum(F.col(column)[i]).alias(f"n{i}") for i in range(4))).first()  # one row
    return discounts({i + 1: found[i] or 0 for i in range(4)})


def _discount(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3).astype(np.int64)]


def vocabulary(counts: DataFrame) -> DataFrame:
    """What all shards of `ngram_counts` count of each word, in shards of words; `picks` are the words that a source has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, b, c, _, _, _, types, weight = _grams(row)
                each = lambda at, w=None: np.bincount(at, w, minlength=len(words)).astype(np.uint64)  # noqa: E731, B023
                counted = [each(b, types), each(b[types == 1]), each(b[types == 2]), each(b[types > 2]), each(b, weight), each(c), each(c, weight)]
                of_word, cuts = _roots_of(row), _cuts(words, row["shards"])
                spans = [(s, cuts[s], cuts[s + 1]) for s in range(row["shards"]) if cuts[s] < cuts[s + 1]]
                yield _batch(_PARTS, [(s, row["shard"], _ascending(words[lo:hi]), *_languages(of_word[lo:hi]), *(packed(x[lo:hi]) for x in counted)) for s, lo, hi in spans])

    shards = shuffle_partitions(counts.sparkSession)

    def merged(key: tuple, parts: pa.Table) -> pa.Table:
        rows = parts.to_pylist()
        held = [_summed(r["words"], np.uint64) for r in rows]
        words = np.unique(np.concatenate(held))
        of_word, sums, picks = np.zeros(len(words), np.uint64), [np.zeros(len(words), np.uint64) for _ in _COUNTS], []
        for row, own in zip(rows, held):
            at = np.searchsorted(words, own)
            of_word[at] = _roots_of(row)
            for into, name in zip(sums, _COUNTS):
                into[at] += unpacked(row[name], np.uint64)
            picks.append(_ascending(at.astype(np.uint32)))
        row = (key[0].as_py(), shards, _ascending(words), *_languages(of_word), *map(packed, sums), [r["source"] for r in rows], picks, _histogram(sums[_COUNTS.index("types")]))
        return pa.Table.from_batches([_batch(_VOCABULARY, [row])])

    parts = counts.mapInArrow(lean(run), from_arrow_schema(_PARTS))
    return parts.groupBy("shard").applyInArrow(lean_group(merged), from_arrow_schema(_VOCABULARY))


def _totals(words: DataFrame) -> DataFrame:
    """(root, all_types, words, n1, n2, n3) of a vocabulary: a row for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                types = unpacked(row["types"], np.uint64)
                langs, lang_of = np.unique(_roots_of(row), return_inverse=True)
                each = lambda of, w=None: np.bincount(lang_of[of], w, minlength=len(langs)).astype(np.int64)  # noqa: E731, B023
                yield pa.record_batch([pa.array(langs.view(np.int64)), *(pa.array(x) for x in (each(types > 0, types[types > 0]), each(types > 0), each(types == 1), each(types == 2), each(types > 2)))], ["root", "all_types", "words", "n1", "n2", "n3"])

    rows = words.mapInArrow(run, "root long, all_types long, words long, n1 long, n2 long, n3 long")
    return rows.groupBy("root").agg(*(F.sum(x).alias(x) for x in ("all_types", "words", "n1", "n2", "n3")))


def kneser_ney(counts: DataFrame, texts: Table | None = None) -> tuple[Sharded, DataFrame]:
    """The model of `ngram_counts`, a packed row for each shard of keys, and for each root the log probability of a word it
    lacks (root, unknown). `texts`, a table, is dropped once they are counted."""
    spark = counts.sparkSession
    shards = shuffle_partitions(spark)
    counted = Sharded(spark, shards).add(counts)
    if texts is not None:
        texts.drop()
    counts = counted.read()
    known = tidied(vocabulary(counts))
    words = known.read()
    d3, d2, d1 = _counted(counts, "h3"), _counted(counts, "h2"), _counted(words, "h1")
    # One row for each language of the training half.
    share = sum(F.col(f"n{i}") * F.lit(x) for i, x in enumerate(d1, 1)) / F.col("all_types") / (F.col("words") + 1)
    roots = durable(_totals(words).select("root", "all_types", share.alias("share")))
    law = {r["root"]: (r["all_types"], r["share"]) for r in roots.collect()}

    def valued(row: dict) -> tuple[np.ndarray, ...]:
        langs = [law[int(x)] for x in unpacked(row["langs"], np.uint64).view(np.int64)]
        lang_of = unpacked(row["lang_of"], np.uint32)
        all_types, least = (np.array([x[i] for x in langs], np.float64)[lang_of] for i in (0, 1))
        counts = {x: unpacked(row[x], np.uint64) for x in _COUNTS}
        p1 = (counts["types"] - _discount(counts["types"], d1)) / all_types + least
        return counts, p1, sum(counts[f"t{i}"] * x for i, x in enumerate(d2, 1))

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts, p1, freed = valued(row)
                picks = [_summed(x, np.uint32) for x in row["picks"]]
                yield _batch(_OF_WORDS, [(s, row["shard"], packed(counts["total"][at]), packed(freed[at]), packed(p1[at])) for s, at in zip(row["sources"], picks)])

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts, p1, freed = valued(row)
                ends, begins = counts["types"] > 0, counts["total"] > 0
                value = np.log(np.where(ends, p1, 1.0)) + np.log(np.where(begins, freed, 1.0) / np.where(begins, counts["total"], 1))
                yield _batch(_ENTRIES, [(row["shard"], SINGLE, None, row["words"], packed(value.astype(np.float32)), packed(np.where(ends, counts["weight"], counts["uses"])))])

    def entries(part: int, shards: int):
        def run(key: tuple, grams: pa.Table, answers: pa.Table) -> pa.Table:
            (row,) = grams.to_pylist()
            words, b, c, sizes, a, n, types, weight = _grams(row)
            answers = sorted(answers.to_pylist(), key=lambda r: r["part"])
            total, freed, p1 = (np.concatenate([unpacked(r[x], kind) for r in answers]) for x, kind in (("total", np.uint64), ("freed", np.float64), ("p1", np.float64)))
            pairs, more, rest = _joined(words[b], words[c], 2), types - _discount(types, d2), freed[b] * p1[c]
            out = []
            if row["shard"] % SLICES == part:
                order = np.argsort(pairs)
                out.append((row["shard"], PAIR, None, _ascending(pairs[order]), packed(np.log1p(more / rest)[order].astype(np.float32)), packed(weight[order])))
            of, full = np.repeat(np.arange(len(pairs)), sizes), a > 0
            of, a, n = of[full], a[full] - 1, n[full]
            before = _joined(words[a], words[b[of]], 2)
            mine = _shard(before, shards) % SLICES == part
            of, n, before = of[mine], n[mine], before[mine]
            order = np.argsort(before)
            of, n, before = of[order], n[order], before[order]
            keys, p2 = _followed(before, words[c[of]]), ((more + rest) / total[b])[of].astype(np.float32)
            cuts = _cuts(before, shards)
            for s in range(shards):
                lo, hi = cuts[s], cuts[s + 1]
                if lo < hi:
                    out.append((s, TRIPLE, _ascending(before[lo:hi]), packed(keys[lo:hi]), packed(p2[lo:hi]), packed(n[lo:hi])))
            return pa.Table.from_batches([_batch(_ENTRIES, out)])

        return run

    def built(key: tuple, parts: pa.Table) -> pa.Table:
        held: dict[int, list] = {SINGLE: [], PAIR: [], TRIPLE: []}
        for r in parts.to_pylist():
            keys = unpacked(r["keys"], np.uint64) if r["kind"] == TRIPLE else _summed(r["keys"], np.uint64)
            held[r["kind"]].append((keys, unpacked(r["value"], np.float32).astype(np.float64), unpacked(r["weight"], np.uint64), _summed(r["before"], np.uint64) if r["before"] else keys[:0]))
        none = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        single, pair, triple = ([np.concatenate(x) for x in zip(none, *held[k])] for k in (SINGLE, PAIR, TRIPLE))
        order = np.argsort(triple[3])
        keys, p2, n, before = (x[order] for x in triple)
        first, freed = _starts(before), _discount(n, d3)
        total, left = _sums(n, first), _sums(freed, first)
        each = np.repeat(left, np.diff(np.append(first, len(before))))
        # A pair before a word occurs itself.
        pair[1][np.searchsorted(pair[0], before[first])] += np.log(left / total)
        several = np.concatenate([pair[0], keys]), np.concatenate([pair[1], np.log1p((n - freed) / (each * p2))]), np.concatenate([pair[2], n])
        return pa.Table.from_batches([_model_row(key[0].as_py(), shards, *(np.concatenate(x) for x in zip(single[:3], several)), several[0])])

    model, unigrams = Sharded(spark, shards), words.mapInArrow(lean(singles), from_arrow_schema(_ENTRIES))
    for part in range(SLICES):
        grams = counts.groupBy("shard").cogroup(words.mapInArrow(lean(of_words), from_arrow_schema(_OF_WORDS)).groupBy("shard")).applyInArrow(lean_group(entries(part, shards)), from_arrow_schema(_ENTRIES))
        both = grams.unionByName(unigrams.where(F.col("shard") % SLICES == part))
        model.add(both.groupBy("shard").applyInArrow(lean_group(built), from_arrow_schema(_MODEL)))
    for t in (counted, known):
        t.drop()
    return model, roots.select("root", F.log("share").alias("unknown"))


def _model_row(shard: int, shards: int, keys: np.ndarray, values: np.ndarray, weight: np.ndarray, filtered: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(keys)
    keys, values, weight = keys[order], values[order].astype(np.float32), weight[order]
    # Keys are dealt by hash, so the shards' most frequent are nearly those of all. Which are answered on the spot changes no score.
    hot = np.sort(np.argsort(weight, kind="stable")[::-1][: max(1, HOT_KEYS // shards)])
    hot = hot[weight[hot] > 0]
    bits = np.zeros(_filter_bits(shards), np.uint8)
    bits[(filtered % np.uint64(len(bits))).astype(np.int64)] = 1
    return _batch(_MODEL, [(shard, shards, _ascending(keys), packed(values), packed(keys[hot]), packed(values[hot]), packed(np.packbits(bits)))])


def contrasts(toxic: DataFrame, trusted: DataFrame) -> DataFrame:
    """(key, contrast) of the words of toxic text, of texts given as (text): log of the Kneser-Ney unigram probability there
    over that in trusted text, which has an unknown word's share for what it lacks. Keys are those of the null language."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                types = unpacked(row["types"], np.uint64).astype(np.int64)
                yield pa.record_batch([pa.array(_summed(row["words"], np.uint64)[types > 0].view(np.int64)), pa.array(types[types > 0])], ["key", "types"])

    def types(texts: DataFrame, name: str) -> tuple:
        counted = tidied(ngram_counts(texts.select(F.lit(None).cast("string").alias("lang"), "text"), triples=False))
        words = tidied(vocabulary(counted.read())).read()
        counted.drop()
        d = _counted(words, "h1")
        total = _totals(words).first()  # one row, as there is one language
        all_types = total["all_types"] if total else 0
        share = sum(total[f"n{i}"] * x for i, x in enumerate(d, 1)) / all_types / (total["words"] + 1) if all_types else 1.0
        less = F.when(F.col(name) == 1, F.lit(d[0])).when(F.col(name) == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
        return words.mapInArrow(rows, "key long, types long").withColumnRenamed("types", name), F.coalesce((F.col(name) - less) / F.lit(float(all_types or 1)), F.lit(0.0)) + F.lit(float(share))

    (bad, p_bad), (good, p_good) = types(toxic, "bad"), types(trusted, "good")
    return bad.join(good, "key", "left").select("key", F.log(p_bad / p_good).alias("contrast"))


# ---------------------------------------------------------------- scoring


def _filter_bits(shards: int) -> int:
    """Bits of a shard's share of the Bloom filter."""
    return max(8, BLOOM_BITS // shards // 8 * 8)


def _passing(bloom: np.ndarray, keys: np.ndarray, shards: int) -> np.ndarray:
    size = _filter_bits(shards)
    place = _shard(keys, shards) * size + (keys % np.uint64(size)).astype(np.int64)
    return (bloom[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


class _Among:
    """Sorted keys, with a small filter before their search."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.filter = keys, np.zeros(1 << 20, bool)
        self.filter[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of `keys` are among them, and their places."""
        some = np.flatnonzero(self.filter[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(some) or not len(self.keys):
            return some[:0], some[:0]
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        hit = self.keys[at] == keys[some]
        return some[hit], at[hit]


def _bounds(shards: int) -> np.ndarray:
    """The least key of each shard."""
    return np.array([-(-(i << 16) // shards) << 48 for i in range(shards)], np.uint64)


def _on_the_spot(model: DataFrame, shards: int) -> tuple[np.ndarray, ...]:
    """(keys, values, bits) of the most frequent keys and the Bloom filter: HOT_KEYS and BLOOM_BITS at most come to the driver."""
    size = _filter_bits(shards) // 8
    keys, values, bits = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)], np.zeros(size * shards, np.uint8)
    for r in model.select("shard", "hot_keys", "hot_values", "bloom").collect():
        keys.append(unpacked(r["hot_keys"], np.uint64))
        values.append(unpacked(r["hot_values"], np.float32))
        bits[r["shard"] * size : (r["shard"] + 1) * size] |= unpacked(r["bloom"], np.uint8)
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(keys)
    return keys[order], values[order], bits


def _requests(hot_keys, hot_values, bloom, unknown, bad_keys, bad_values, salt: np.uint64 | None, shards: int):
    """A mapInArrow function: for each chunk a header row for each document, with what is known on the spot, and for each
    shard the keys to look up with the documents that hold them. Headers go to any shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        (no_lang,) = _roots([None])
        among_hot, among_bad = _Among(hot_keys.value), _Among(bad_keys.value)
        for b in batches:
            for part in chunks(_rows(b), CHUNK_BYTES):
                for at in range(0, len(part), 65536):
                    some = part[at : at + 65536]
                    rows = [r[0] for r in some]
                    roots = _roots([r[1] for r in some])
                    doc, hashes = word_hashes([r[2] for r in some])
                    keys = mixed(hashes ^ roots[doc])
                    tokens = np.bincount(doc, minlength=len(some)) - 1
                    worst = np.zeros(len(some))
                    if len(bad_keys.value):
                        is_bad, bad = among_bad.find(mixed(hashes ^ no_lang))
                        np.maximum.at(worst, doc[is_bad], bad_values.value[bad])
                    least = np.array([unknown.value.get(int(r), 0.0) for r in roots.view(np.int64)])
                    pair_doc, pairs = ngram_keys(doc, keys)
                    maybe = _passing(bloom.value, pairs, shards)
                    bad_doc, further = doc[:0], keys[:0]
                    if salt is not None:
                        further = mixed(mixed(hashes ^ no_lang) ^ salt)
                        perhaps = _passing(bloom.value, further, shards)
                        bad_doc, further = doc[perhaps], further[perhaps]
                    all_doc = np.concatenate([doc, pair_doc[maybe], bad_doc])
                    all_keys = np.concatenate([keys, pairs[maybe], further])
                    kinds = np.repeat(np.array([WORD, SEVERAL, CONTRAST], np.uint8), [len(doc), int(maybe.sum()), len(further)])
                    del hashes, keys, pair_doc, pairs, maybe, bad_doc, further
                    single = kinds == WORD
                    # Every word counts as unknown until a lookup corrects it.
                    known = np.bincount(doc, least[doc], minlength=len(some))
                    # The table of frequent keys is searched once for each distinct key, in order.
                    order = np.argsort(all_keys)
                    in_order = all_keys[order]
                    first = _starts(in_order)
                    is_hot, hot = among_hot.find(in_order[first])
                    each = np.diff(np.append(first, len(in_order)))
                    found = np.zeros(len(first), bool)
                    found[is_hot] = True
                    on_spot, others = (order[np.repeat(x, each)] for x in (found, ~found))
                    gain = np.repeat(hot_values.value[hot], each[is_hot]) - np.where(single[on_spot], least[all_doc[on_spot]], 0.0)
                    known += np.bincount(all_doc[on_spot], gain, minlength=len(some))
                    cold_doc, cold, kind = all_doc[others], all_keys[others], kinds[others]
                    del all_doc, all_keys, kinds, single, order, in_order, on_spot, others, gain, each
                    first = _starts(cold)
                    cuts = _cuts(cold[first], shards)
                    ends = np.append(first, len(cold))
                    names, blobs = [], []
                    for s in range(shards):
                        lo, hi = cuts[s], cuts[s + 1]
                        if lo < hi:
                            distinct = cold[first[lo:hi]]
                            names.append(s)
                            blobs.append((_ascending(distinct), packed(np.diff(ends[lo : hi + 1]).astype(np.uint32)), packed(cold_doc[ends[lo] : ends[hi]].astype(np.uint16)), packed(kind[first[lo:hi]])))
                    column = lambda values, kind: pa.array(values, kind)
                    n = len(names)
                    ids = b.column("id").take(pa.array(rows))
                    yield pa.record_batch(
                        [
                            column([(serial >> 32) % shards] * len(some) + names, pa.int32()), column([serial] * (len(some) + n), pa.int64()), column([*range(len(some)), *[-1] * n], pa.int32()),
                            pa.concat_arrays([ids, pa.nulls(n, ids.type)]), pa.concat_arrays([b.column("lang").take(pa.array(rows)), pa.nulls(n, pa.string())]),
                            column([*tokens.tolist(), *[None] * n], pa.int64()), column([*known.tolist(), *[None] * n], pa.float64()), column([*least.tolist(), *[None] * n], pa.float64()), column([*worst.tolist(), *[None] * n], pa.float64()),
                            *(column([None] * len(some) + [x[i] for x in blobs], pa.binary()) for i in range(4)),
                        ],
                        ["shard", "chunk", "row", "id", "lang", "tokens", "known", "least", "worst", "gaps", "counts", "docs", "kinds"],
                    )
                    serial += 1

    return run


_REQUEST = "shard int, chunk long, row int, id {id}, lang string, tokens long, known double, least double, worst double, gaps binary, counts binary, docs binary, kinds binary"


def _by_key(keys: pa.ChunkedArray, values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    found = keys.to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], values.to_numpy()[order]


def _answer(kinds: pa.Schema):
    def run(key: tuple, model: pa.Table, requests: pa.Table) -> pa.Table:
        """A shard's partial sums, one row for each chunk: its documents, their sums, and how many of their words were found,
        which stop being unknown. The chunks' headers pass through."""
        heads = requests.filter(pc.is_null(requests.column("gaps")))
        asks = requests.filter(pc.is_valid(requests.column("gaps")))
        shard = model.select(["keys", "value"]).to_pylist()
        keys = np.concatenate([np.zeros(0, np.uint64), *(_summed(r["keys"], np.uint64) for r in shard)])
        values = np.concatenate([np.zeros(0, np.float32), *(unpacked(r["value"], np.float32) for r in shard)])
        if len(shard) > 1:
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
        out: list[tuple] = []
        for chunk, gaps, counts, docs, kind in zip(*(asks.column(n).to_pylist() for n in ("chunk", "gaps", "counts", "docs", "kinds"))) if len(keys) else ():
            asked = np.cumsum(unpacked(gaps, np.uint64), dtype=np.uint64)
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            hit = keys[at] == asked
            n = unpacked(counts, np.uint32).astype(np.int64)
            each = np.repeat(hit, n)
            doc = unpacked(docs, np.uint16).astype(np.int64)[each]
            value = np.repeat(np.where(hit, values[at], 0.0), n)[each]
            kind = np.repeat(unpacked(kind, np.uint8), n)[each]
            touched, bad = np.unique(doc), kind == CONTRAST
            sums, singles, worsts = np.bincount(doc, np.where(bad, 0.0, value)), np.bincount(doc, kind == WORD), np.zeros(len(touched))
            np.maximum.at(worsts, np.searchsorted(touched, doc[bad]), value[bad])
            out.append((chunk, packed(touched.astype(np.uint16)), packed(sums[touched]), packed(singles[touched].astype(np.uint32)), packed(worsts)))
        parts = dict(zip(("chunk", "rows", "sums", "singles", "worsts"), zip(*out))) if out else {}
        tables = []
        for n, columns in ((heads.num_rows, {c: heads.column(c) for c in heads.column_names if c in kinds.names}), (len(out), parts)):
            tables.append(pa.table([pa.chunked_array([columns[f.name]], f.type) if isinstance(columns.get(f.name), tuple) else columns[f.name].cast(f.type) if f.name in columns else pa.chunked_array([pa.nulls(n, f.type)]) for f in kinds], schema=kinds))
        return pa.concat_tables(tables)

    return run


def _gathered(kinds: pa.Schema):
    def run(chunk: pa.Table) -> pa.Table:
        """A chunk's documents with the sums of all shards' parts: at most 65,536 headers and a part for each shard."""
        heads, parts = chunk.filter(pc.is_null(chunk.column("rows"))), chunk.filter(pc.is_valid(chunk.column("rows")))
        size = heads.num_rows
        each = [np.concatenate([np.zeros(0, kind), *(unpacked(x, kind) for x in parts.column(name).to_pylist())]) for name, kind in (("rows", np.uint16), ("sums", np.float64), ("singles", np.uint32), ("worsts", np.float64))]
        sums, singles = np.bincount(each[0], each[1], minlength=size), np.bincount(each[0], each[2].astype(np.int64), minlength=size).astype(np.int64)
        at = heads.column("row").to_numpy()
        worst = np.zeros(size)
        np.maximum.at(worst, each[0].astype(np.int64), each[3])
        new = {"part": pa.array(sums[at], pa.float64()), "found": pa.array(singles[at], pa.int64()), "worst": pa.array(np.maximum(heads.column("worst").to_numpy(), worst[at]), pa.float64())}
        return pa.table([new[f.name] if f.name in new else heads.column(f.name) for f in kinds], schema=kinds)

    return run


def scored(docs: DataFrame, model: Sharded, unknown: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", contrast: DataFrame | None = None) -> DataFrame:
    """(id_col, lang, n_tokens, log_p, worst) of every document; n_tokens counts the end of the text, worst is the largest
    contrast (key, contrast) of its words, 0 at least. The model takes up the contrasts that are not looked up on the spot."""
    spark = docs.sparkSession
    context = spark.sparkContext
    shards = model.shards
    lowest = {r["root"]: r["unknown"] for r in unknown.collect()}  # one row for each language of the training half
    bad_keys, bad_values, salt = np.zeros(0, np.uint64), np.zeros(0), None
    if contrast is not None:
        positive = tidied(contrast.where("contrast > 0").select("key", F.col("contrast").cast("float").alias("contrast"))).read()
        bad = positive.orderBy(F.desc("contrast"), "key").limit(CONTRAST_WORDS).toArrow()
        bad_keys, bad_values = _by_key(bad.column("key"), bad.column("contrast"))
        if positive.count() > len(bad_keys):
            salt = _CONTRAST + np.uint64(model.parts)

            def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    keys = mixed(b.column(0).to_numpy().view(np.uint64) ^ salt)
                    yield pa.record_batch([pa.array(keys.view(np.int64)), b.column(1)], ["key", "value"])

            # The table on the spot holds the largest; those of its least contrast may be in both.
            rest = positive.where(F.col("contrast") <= F.lit(float(bad_values.min()))).select("key", "contrast").mapInArrow(moved, "key long, value float")

            def in_rows(key: tuple, rows: pa.Table) -> pa.Table:
                keys, values = _by_key(rows.column("key"), rows.column("value"))
                return pa.Table.from_batches([_model_row(key[0].as_py(), shards, keys, values, np.zeros(len(keys), np.uint64), keys)])

            of_key = F.shiftright(F.shiftrightunsigned("key", 48) * shards, 16).cast("int").alias("shard")
            model.add(rest.select(of_key, "key", "value").groupBy("shard").applyInArrow(lean_group(in_rows), from_arrow_schema(_MODEL)))
    shared = [context.broadcast(x) for x in (*_on_the_spot(model.read(), shards), lowest, bad_keys, bad_values)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    head = [("row", pa.int32()), ("id", id_type), ("lang", pa.string()), ("tokens", pa.int64()), ("known", pa.float64()), ("least", pa.float64()), ("worst", pa.float64())]
    answered = pa.schema([("chunk", pa.int64()), *head, ("rows", pa.binary()), ("sums", pa.binary()), ("singles", pa.binary()), ("worsts", pa.binary())])
    summed = pa.schema([*head[1:], ("part", pa.float64()), ("found", pa.int64())])
    partitions = max(1, rows.rdd.getNumPartitions())
    slices = max(min(SCORED_SLICES, partitions), -(-partitions // BLOCK_PARTITIONS))
    requests, of_shard, done = lean(_requests(*shared, salt, shards)), model.read().select("shard", "keys", "value"), []
    for i in range(slices):
        asked = rows.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == i).mapInArrow(requests, _REQUEST.format(id=docs.schema[id_col].dataType.simpleString()))
        # Headers and requests take one shuffle by shard, headers and answers one by chunk: nothing is computed or kept twice.
        answers = of_shard.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(lean_group(_answer(answered)), from_arrow_schema(answered))
        done.append(tidied(answers.groupBy("chunk").applyInArrow(_gathered(summed), from_arrow_schema(summed))).read())
    joined = reduce(DataFrame.union, done)
    log_p = F.col("known") + F.col("part") - F.col("found") * F.col("least")
    # A language that the model has not seen has no probability for unknown words, and no score.
    return joined.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), F.col("tokens").alias("n_tokens"), F.when(F.col("least") < 0, log_p).alias("log_p"), "worst")


def drawn(labels: DataFrame, train_docs: int | None = None, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids (_t) of labels (id_col, quality, toxic): trusted ones that train, all other trusted ones, toxic ones that train.

    Trusted are quality 1 and not toxic, nulls are not. Half of the trusted ids train, the fold of a hash: the others set the
    thresholds, which need text that the model hasn't seen. No threshold is taken from toxic text, so all toxic ids train. If
    `train_docs` is given, it says how many of a kind at most, in the order of another hash."""
    ids = lambda kind: labels.where(kind).select(F.col(id_col).alias("_t")).where("_t is not null").distinct()
    half = F.pmod(F.xxhash64("_t", F.lit("fold")), F.lit(2))
    some = lambda of: of if train_docs is None else durable(of.orderBy(F.xxhash64("_t", F.lit("train")), "_t").limit(train_docs))
    trusted = ids((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    chosen = some(trusted.where(half == 0))
    others = trusted.where(half != 0) if train_docs is None else trusted.join(chosen, "_t", "left_anti")
    return chosen, others, some(ids(F.col("toxic") == 1))


def _bounded(rows: DataFrame, most: int = BROADCAST_LANGUAGES) -> DataFrame:
    """A table with a row for each language, say, to be broadcast if these are few."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def classify(docs: DataFrame, labels: DataFrame, train_docs: int | None = None, model_docs: int | None = None, quantile: float = QUANTILE, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", labelled: str | None = None, label_col: str | None = None) -> DataFrame:
    """(id_col, lang_col, n_tokens, perplexity, score, threshold, worst, limit, kept) of every document.

    labels: (id_col, quality, toxic). `drawn` says which ids train the models of trusted and of toxic text, whole texts each
    (`model_docs`: so many of the trusted ones fit the trigrams at most, all if not given); all other trusted
    ids calibrate: `threshold` and `limit` are the quantiles of their `score` and `worst` in the document's language, drawn
    towards those of all languages together, which weigh as much as PRIOR_DOCS documents: a language with few trusted
    documents has nearly the common ones, one without any has these. `score` is the mean negative log probability with PRIOR_TOKENS tokens of the
    language's mean, `worst` the largest contrast of toxic to trusted text in one word. A document above either is rejected.
    Without a model or calibration for its language a document is kept by that score; a null language is a language of its
    own; empty and null texts score their end alone; repeated rows get equal results, null ids too.

    Labels name documents by their column `label_col`, which is matched with `labelled` of `docs` (a field of a struct id,
    say); both are `id_col` if not given."""
    labelled, label_col = labelled or id_col, label_col or id_col
    chosen, calibrating, bad = drawn(labels, train_docs, label_col)
    texts = docs.select(F.col(labelled).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    fits = chosen.withColumn("fits", F.lit(True)) if model_docs is None else chosen.join(chosen.orderBy(F.xxhash64("_t", F.lit("train")), "_t").limit(model_docs).withColumn("fits", F.lit(True)), "_t", "left")
    marked = tidied(fits.select("_t", F.lit(False).alias("bad"), F.coalesce("fits", F.lit(False)).alias("fits")).union(bad.select("_t", F.lit(True), F.lit(False)))).read()
    # The texts of both kinds, found in one pass.
    found = tidied(texts.join(_bounded(marked, BROADCAST_IDS), F.col("id") == F.col("_t")).select("lang", "text", "bad", "fits"))
    samples = found.read()
    contrast = contrasts(samples.where("bad"), samples.where("not bad"))
    values, unknown = kneser_ney(ngram_counts(samples.where("fits")), found)
    scores = durable(scored(docs, values, unknown, id_col, lang_col, text_col, contrast).withColumn("_lang", F.coalesce(F.concat(F.lit("="), F.col(lang_col)), F.lit(""))))
    values.drop()
    known = scores.where("log_p is not null").join(calibrating, F.col(labelled) == F.col("_t"), "left_semi")
    known = durable(known.select("_lang", "n_tokens", "log_p", "worst"))
    # Sums and quantiles are combined on the way: no task holds a language's rows.
    cut = lambda name: F.percentile_approx(name, quantile, 100_000)
    shrunk = lambda mean: (-F.col("log_p") + PRIOR_TOKENS * mean) / (F.col("n_tokens") + PRIOR_TOKENS)
    means = durable(known.groupBy("_lang").agg(F.sum("log_p").alias("all"), F.sum("n_tokens").alias("tokens"))).withColumn("mean", -F.col("all") / F.col("tokens")).select("_lang", "mean", "all", "tokens")
    own = known.join(_bounded(means), "_lang").withColumn("score", shrunk(F.col("mean")))
    law = durable(own.groupBy("_lang").agg(F.first("mean").alias("mean"), F.count("*").alias("n"), cut("score").alias("own"), cut("worst").alias("own_worst")))
    every = means.agg((-F.sum("all") / F.sum("tokens")).alias("mean")).first()  # one row each
    pooled = own.agg(cut("score").alias("score"), cut("worst").alias("worst")).first()
    mixed_in = lambda name, of_all: F.coalesce((F.col("n") * F.col(name) + PRIOR_DOCS * F.lit(of_all).cast("double")) / (F.col("n") + PRIOR_DOCS), F.lit(of_all).cast("double"))
    rows = scores.join(_bounded(law), "_lang", "left").withColumn("score", shrunk(F.coalesce("mean", F.lit(every["mean"]).cast("double"))))
    rows = rows.withColumn("threshold", mixed_in("own", pooled["score"])).withColumn("limit", mixed_in("own_worst", pooled["worst"]))
    within = lambda a, b: F.coalesce(F.col(a) <= F.col(b), F.lit(True))
    return rows.select(
        id_col, lang_col, "n_tokens", F.exp(-F.col("log_p") / F.col("n_tokens")).alias("perplexity"), "score", "threshold", "worst", "limit",
        (within("score", "threshold") & within("worst", "limit")).alias("kept"),
    )


def op8_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of trusted text, its most toxic word, and whether its language's
    thresholds keep it."""
    rows = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "lang", "n_tokens", F.round("perplexity", 3).alias("perplexity"), F.round("threshold", 3).alias("threshold"), F.round("worst", 3).alias("worst_word"), F.round("limit", 3).alias("worst_limit"), "kept")
