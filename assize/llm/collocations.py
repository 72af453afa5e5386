"""Phrase collocations by Rabin-Karp fingerprints.

Prefix polynomials over a block of text give the fingerprint of every n-gram from two sums. Tasks add up fingerprints, each with
a pointer to a document that has it, the shuffle adds up theirs, and only n-grams all of whose parts are frequent go through it: a
Bloom filter of the frequent parts, of a fixed size whatever the corpus, drops most of the others and no frequent one. Frequent
phrases are materialised from the documents their pointers name. Within a task every occurrence is compared with the text its
fingerprint stands for there; tasks pass on a second fingerprint of these texts, and where two differ, a further pass counts the
fingerprint's occurrences by their texts. So collisions and false positives cost rows and change nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rolling, lean, mixed, shuffle_partitions, table, written

#: Phrases have 2 to so many words and occur at least so often; so many of a language are returned.
MOST_WORDS, LEAST, MOST = 5, 100, 2000
#: A phrase goes if a longer one that holds it has so many hundredths of its occurrences.
WITHIN = 100
#: The text a task works on at once, and what it adds up before it hands rows on.
BLOCK_BYTES, HELD_KEYS, HELD_TEXTS = 2 << 20, 1_000_000, 200_000
#: Bits of the Bloom filters, as a power of 2: 8 MB.
FILTER_BITS = 26
UNKNOWN_LANG = "und"

_ENDS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(_ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_part_end = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
_following = re.compile(rb"[ \t]*(?:[^ \t.,;:!?\n\x0b\x0c\r]+[ \t]*){0,%d}" % (MOST_WORDS - 1))


def segments(data: bytes, size: int = BLOCK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(own, part): a text in parts of about `size` bytes. Phrases never cross the end of a piece, so parts end there; a longer
    piece is cut between words, and the part goes on for the words that phrases begun in its first `own` bytes may need. A
    longer word stays whole."""
    at, n = 0, len(data)
    while n - at > size:
        cut = max(data.rfind(bytes([x]), at, at + size) for x in _ENDS)
        if cut > at:
            yield cut + 1 - at, data[at : cut + 1]
            at = cut + 1
            continue
        cut = max(data.rfind(b" ", at + 1, at + size), data.rfind(b"\t", at + 1, at + size))
        if cut < 0:
            found = _part_end.search(data, at + size)
            cut = found.start() if found else n
        yield cut - at, data[at : max(cut, _following.match(data, cut).end())]
        at = cut
    if at < n:
        yield n - at, data[at:]


class Block:
    """The words of some segments as one lower-cased buffer, a single space between words of a piece, and their n-grams."""

    def __init__(self, parts: list[tuple[int, int, bytes, int]], bits: int):
        """parts: (language, own, bytes, document); fingerprints keep so many bits."""
        data = np.frombuffer(b"\n".join([p[2] for p in parts]) + b"\n", np.uint8)
        kind = _KIND[data]
        gap = kind != 0
        before = np.concatenate(([True], gap[:-1]))
        first, stop = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        ends = np.concatenate((np.zeros(1, np.int32), np.cumsum(kind == 2, dtype=np.int32)))
        broken = ends[np.append(first[1:], len(data))[: len(stop)]] > ends[stop]
        keep = ~gap
        keep[stop] = True
        lowered = _LOWER[data]
        lowered[stop] = np.where(broken, 10, 32)
        self.bytes = lowered[keep]
        length = stop - first
        self.end = np.cumsum(length + 1) - 1
        self.start = self.end - length
        #: The number of each word's piece, its language, and whether phrases that begin with it are this block's.
        self.piece = np.concatenate(([0], np.cumsum(broken)))[: len(first)]
        begins = np.cumsum([0, *(len(p[2]) + 1 for p in parts)])[:-1]
        of = np.searchsorted(begins, first, "right") - 1
        self.lang, self.doc = np.array([p[0] for p in parts])[of], np.array([p[3] for p in parts], np.int64)[of]
        self.own = first < (begins + np.array([p[1] for p in parts]))[of]
        self.hashes = Rolling(self.bytes)
        self.mask = np.uint64((1 << bits) - 1)

    def begins(self, k: int) -> np.ndarray:
        """Whether a phrase of k words begins at each word."""
        n = len(self.piece) - k + 1
        return self.piece[:n] == self.piece[k - 1 :] if n > 0 else np.zeros(0, bool)

    def keys(self, at: np.ndarray, k: int, seeds: np.ndarray) -> np.ndarray:
        """64-bit fingerprints of the k words from `at`; languages have fingerprints of their own."""
        return mixed((self.hashes.of(self.start[at], self.end[at + k - 1]) & self.mask) ^ seeds[self.lang[at]])

    def text(self, at: int, k: int) -> bytes:
        return self.bytes[self.start[at] : self.end[at + k - 1]].tobytes()

    def alike(self, at: np.ndarray, like: np.ndarray, k: int) -> np.ndarray:
        """Whether the k words from each of `at` are, byte by byte, those from its counterpart of `like`, in one language."""
        begin, other, size = self.start[at], self.start[like], self.end[at + k - 1] - self.start[at]
        same = (size == self.end[like + k - 1] - other) & (self.lang[at] == self.lang[like])
        tried = np.flatnonzero(same & (at != like))
        lengths = size[tried]
        steps = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        differs = self.bytes[np.repeat(begin[tried], lengths) + steps] != self.bytes[np.repeat(other[tried], lengths) + steps]
        same[np.repeat(tried, lengths)[differs]] = False
        return same


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, where groups of equal keys begin in it, the group of each place in it)."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _blocks(batches: Iterator[pa.RecordBatch], bits: int, langs: dict[str, int], seeds: list[int]) -> Iterator[Block]:
    """Blocks of all texts; `langs` and `seeds` learn the languages they meet."""
    held, total = [], 0
    for batch in batches:
        for lang, text, doc in zip(batch.column("lang").to_pylist(), batch.column("text"), batch.column("doc").to_pylist()):
            if lang not in langs:
                langs[lang] = len(langs)
                seeds.append(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
            for own, part in segments(text.as_py().encode()):
                if held and total + len(part) > BLOCK_BYTES:
                    yield Block(held, bits)
                    held, total = [], 0
                held.append((langs[lang], own, part, doc))
                total += len(part)
    if held:
        yield Block(held, bits)


def _contains(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bytes_, found = words.view(np.uint8), True
    for shift in (64 - FILTER_BITS, 64 - 2 * FILTER_BITS):
        place = (keys >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
        found = found & (bytes_[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def _frequent_parts(block: Block, k: int, seeds: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether the k words from each word are, by the filter, a frequent phrase."""
    out = block.begins(k)
    at = np.flatnonzero(out)
    out[at] = _contains(known, block.keys(at, k, seeds))
    return out


class _Tally:
    """Rows (key, n, low, high, doc) of fingerprints, added up: `low` and `high` are the least and the greatest second fingerprint
    of a key's texts, as signed numbers, `doc` a document that has it."""

    def __init__(self):
        self.held, self.rows = [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.rows += len(columns[0])

    def added(self) -> tuple[np.ndarray, ...]:
        key, n, low, high, doc = (np.concatenate(x) for x in zip(*self.held))
        order, begins, _ = _groups(key)
        self.held, self.rows = [], 0
        if not len(key):
            return key, n, low, high, doc
        return key[order[begins]], np.add.reduceat(n[order], begins), np.minimum.reduceat(low[order], begins), np.maximum.reduceat(high[order], begins), doc[order[begins]]


def _total(seed: np.ndarray) -> np.ndarray:
    """The key under which a language's words are counted."""
    return mixed(~seed)


def _counting(orders: tuple[int, ...], parts: int, known: Broadcast | None, bits: int):
    """Adds up fingerprints of phrases of `orders` words, those all of whose parts of `parts` words may be frequent; single words
    with the number of all words of a language."""

    def rows(key, n, low, high, doc) -> pa.RecordBatch:
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(n), pa.array(low), pa.array(high), pa.array(doc)], ["key", "n", "low", "high", "doc"])

    def run(batches):
        langs, seeds, tally = {}, [], _Tally()
        for block in _blocks(batches, bits, langs, seeds):
            seed = np.array(seeds, np.uint64)
            good = _frequent_parts(block, parts, seed, known.value) if known else None
            if orders == (1,):
                mine = np.flatnonzero(block.own)
                some, where = np.unique(block.lang[mine], return_index=True)
                none = np.zeros(len(some), np.int64)
                tally.add(_total(seed[some]), np.bincount(block.lang[mine], minlength=len(seed))[some], none, none, block.doc[mine[where]])
            second = Rolling(block.bytes ^ np.uint8(0x5A))
            for k in orders:
                chosen = block.begins(k)
                n = len(chosen)
                chosen &= block.own[:n]
                for i in range(k - parts + 1 if known else 0):
                    chosen &= good[i : i + n]
                at = np.flatnonzero(chosen)
                if not len(at):
                    continue
                order, begins, of = _groups(keys := block.keys(at, k, seed))
                at, keys = at[order], keys[order]
                reps = at[begins]
                marks = second.of(block.start[reps], block.end[reps + k - 1]).view(np.int64)
                counts = np.diff(np.append(begins, len(at)))
                strange = np.flatnonzero(~block.alike(at, reps[of], k))
                counts -= np.bincount(of[strange], minlength=len(counts))
                tally.add(keys[begins], counts, marks, marks, block.doc[reps])
                if len(strange):
                    # Another text under the same fingerprint, or another language.
                    low, high = (np.full(len(strange), x, np.int64) for x in (-(1 << 63), (1 << 63) - 1))
                    tally.add(keys[strange], np.ones(len(strange), np.int64), low, high, block.doc[at[strange]])
            if tally.rows > HELD_KEYS:
                tally.add(*tally.added())
                if tally.rows > HELD_KEYS // 2:
                    yield rows(*tally.added())
        if tally.held:
            yield rows(*tally.added())

    return run


def _materialised(bits: int):
    """(key, lang, phrase) of the keys that point to a document: of its phrases with that fingerprint the one with the second
    fingerprint, too. Its language's words have the empty phrase."""

    def run(batches):
        for b in batches:
            out = {}
            for i in range(b.num_rows):
                one, wanted, lows = b.slice(i, 1), *(b.column(n)[i].values.to_numpy().view(np.uint64) for n in ("keys", "lows"))
                order = np.argsort(wanted)
                wanted, lows = wanted[order], lows[order]
                langs, seeds = {}, []
                for block in _blocks(iter([one]), bits, langs, seeds):
                    seed, (lang,) = np.array(seeds, np.uint64), langs
                    if (total := int(_total(seed)[0])) in wanted:
                        out[total] = (lang, "")
                    second = Rolling(block.bytes ^ np.uint8(0x5A))
                    for k in range(1, MOST_WORDS + 1):
                        at = np.flatnonzero(block.begins(k))
                        keys = block.keys(at, k, seed)
                        place = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                        hit = np.flatnonzero(wanted[place] == keys)
                        marks = second.of(block.start[at[hit]], block.end[at[hit] + k - 1])
                        right = np.flatnonzero(marks == lows[place[hit]])
                        found, first = np.unique(keys[hit[right]], return_index=True)
                        for key, j in zip(found.tolist(), right[first].tolist()):
                            out[key] = (lang, block.text(at[hit[j]], k).decode())
            signed = lambda x: np.array(x, np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(signed(list(out))), pa.array([v[0] for v in out.values()], pa.string()), pa.array([v[1] for v in out.values()], pa.string())], ["key", "lang", "phrase"])

    return run


def _by_text(known: Broadcast, bits: int):
    """(key, lang, phrase, n) of every phrase whose fingerprint the filter knows."""

    def rows(tally: dict, langs: dict) -> pa.RecordBatch:
        names, keys = list(langs), np.array([k[0] for k in tally], np.uint64).view(np.int64)
        return pa.record_batch([pa.array(keys), pa.array([names[k[1]] for k in tally], pa.string()), pa.array([k[2].decode() for k in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], ["key", "lang", "phrase", "n"])

    def run(batches):
        langs, seeds, tally = {}, [], {}
        for block in _blocks(batches, bits, langs, seeds):
            seed = np.array(seeds, np.uint64)
            for k in range(1, MOST_WORDS + 1):
                chosen = block.begins(k)
                at = np.flatnonzero(chosen & block.own[: len(chosen)])
                keys = block.keys(at, k, seed)
                hit = _contains(known.value, keys)
                for key, place in zip(keys[hit].tolist(), at[hit].tolist()):
                    phrase = (key, int(block.lang[place]), block.text(place, k))
                    tally[phrase] = tally.get(phrase, 0) + 1
            words = np.bincount(block.lang[block.own], minlength=len(seed))
            for lang in np.flatnonzero(_contains(known.value, _total(seed))).tolist():
                phrase = (int(_total(seed)[lang]), lang, b"")
                tally[phrase] = tally.get(phrase, 0) + int(words[lang])
            if len(tally) > HELD_TEXTS:
                yield rows(tally, langs)
                tally = {}
        if tally:
            yield rows(tally, langs)

    return run


def _filter(keys: DataFrame) -> Broadcast:
    """A Bloom filter of `key`: 8 MB at most come to the driver and go to the tasks, however many keys there are."""
    places = F.array(*(F.shiftrightunsigned("key", s).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) for s in (64 - FILTER_BITS, 64 - 2 * FILTER_BITS)))
    bits = keys.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    got = bits.toArrow()
    words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(words)


def phrase_counts(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(lang, phrase, n): every phrase of 1 to MOST_WORDS words with `least` occurrences in a language or more, and the empty
    phrase with the number of all its words. Exact: `bits`, the length of the fingerprints, changes no result."""
    c = F.col
    rows = docs.select(F.coalesce(c(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), c(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("doc")).where("text is not null")

    def frequent(orders: tuple[int, ...], parts: int, known: DataFrame | None) -> DataFrame:
        run = _counting(orders, parts, None if known is None else _filter(known), bits)
        found = rows.mapInArrow(lean(run), "key bigint, n bigint, low bigint, high bigint, doc bigint").groupBy("key")
        # A language's words count however few they are: their key has no second fingerprint.
        return written(found.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("doc").alias("doc")).where((c("n") >= least) | ((c("low") == 0) & (c("high") == 0))))

    one = frequent((1,), 1, None)
    two = frequent((2,), 1, one)
    three = one.union(two).union(frequent(tuple(range(3, MOST_WORDS + 1)), 2, two))
    every = three.groupBy("key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("doc").alias("doc"))
    clear, mixed_up = every.where("low = high"), every.where("low <> high").select("key")
    named = clear.groupBy("doc").agg(F.collect_list(F.struct("key", "low")).alias("k")).select("doc", c("k.key").alias("keys"), c("k.low").alias("lows"))
    texts = rows.join(named, "doc").mapInArrow(lean(_materialised(bits)), "key bigint, lang string, phrase string")
    counts = clear.join(texts, "key").select("lang", "phrase", "n")
    if not mixed_up.isEmpty():
        told = rows.mapInArrow(lean(_by_text(_filter(mixed_up), bits)), "key bigint, lang string, phrase string, n bigint").join(mixed_up.distinct(), "key", "left_semi")
        counts = counts.union(told.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((c("n") >= least) | (c("phrase") == "")))
    return counts


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, within: int = WITHIN, lang_col: str = "lang", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `most` phrases of each language that stick together best.

    a counts a phrase; l and r count the parts of the cut that scores lowest (of equals the first), score is
    floor(1000 a n / (l r)) in exact integers, n all words of the language. A phrase goes if a longer one with at least `within`
    hundredths of its occurrences holds it. Ranks go by score, then a, both descending, then the phrase's bytes.

    A null language is `und`; null and empty texts have no words; texts of any length, repeated rows, which count as often as
    they stand there, and other columns, whatever their names, do no harm; an empty table gives no rows."""
    c = F.col
    counts = written(phrase_counts(docs, least, lang_col, text_col, bits))
    known = counts.where("phrase <> ''")
    totals = counts.where("phrase = ''").select("lang", c("n").alias("total"))
    phrases = known.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 1).select("lang", "phrase", c("n").alias("a"), "w")
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), c("k")).alias("head"), part(c("k") + 1, F.size("w") - c("k")).alias("tail"))
    cuts = cuts.join(known.select("lang", c("phrase").alias("head"), c("n").alias("l")), ["lang", "head"]).join(known.select("lang", c("phrase").alias("tail"), c("n").alias("r")), ["lang", "tail"]).join(totals, "lang")
    score = F.expr("(1000 * cast(a as decimal(19,0)) * cast(total as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", c("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    # Every contiguous part of two words or more of a phrase, with the most occurrences of a phrase that holds it.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    holders = phrases.where(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), c("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(holders, ["lang", "phrase"], "left").where(c("longer").isNull() | (100 * c("longer") < within * c("a")))
    rows = kept.select("lang", "phrase", "a", c("m.l").alias("l"), c("m.r").alias("r"), "n", c("m.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # First the best of each share of a language, then of these: no task sees all phrases of a language.
    share = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession)))
    some = rows.withColumn("share", share).withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(c("place") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(c("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of each language in all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS a FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4), (5)) AS o(k)) AS g GROUP BY ALL HAVING count(*) >= 100),
long AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1),
cuts AS (SELECT long.lang, long.phrase, long.a, cut, l.a AS l, r.a AS r, n, (1000 * CAST(long.a AS HUGEINT) * n) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM long) AS long JOIN total USING (lang)
  JOIN grams AS l ON l.lang = long.lang AND l.phrase = array_to_string(w[1:cut], ' ')
  JOIN grams AS r ON r.lang = long.lang AND r.phrase = array_to_string(w[cut + 1:long.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM long) AS x) AS y GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000
"""
