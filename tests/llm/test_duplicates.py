"""SimHash classes, near copies and repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assize.llm import simhash, substring_dedup
from assize.llm.components import star_components


def bits_of(t, k=4):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def test_classes_match_brute_force(docs, texts):
    rows = {r.doc_id: r for r in simhash.near_duplicate_classes(docs).collect()}
    fp = [bits_of(t) for t in texts]
    assert [rows[i].fp & (1 << 64) - 1 for i in range(len(texts))] == fp
    links = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4]
    assert [rows[i].component_id for i in range(len(fp))] == components(len(fp), links)


@pytest.mark.parametrize("radius", [0, 1, 4, 10])
@pytest.mark.parametrize("bucket_rows", [8192, 16])
def test_no_link_is_lost(spark, radius, bucket_rows):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 6))) for c in centres for _ in range(25)} | {rng.getrandbits(64) & 0xFF for _ in range(40)})
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint").repartition(4)
    links = simhash.hamming_links(rows, radius, bucket_rows).collect()
    where = {f: i for i, f in enumerate(fps)}
    got = [tuple(where[x & (1 << 64) - 1] for x in r) for r in links]
    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    assert components(len(fps), got) == components(len(fps), want) and len(got) == len(set(got))


def test_thresholds_keep_the_pigeonhole():
    rng = np.random.default_rng(1)
    for n in (0, 1, 10, 10**4, 10**7, 10**10):
        laws = rng.dirichlet(np.ones(9), 8)
        for radius in (0, 1, 4, 10):
            parts = simhash.allocate(n, laws, radius)
            # Parts that are left out count -1 each: the kept thresholds plus one each sum to radius + 1 at least.
            assert sum(t + 1 for _, _, t in parts) >= radius + 1


def test_values_within_a_threshold_meet_halfway():
    for t in range(5):
        r, values = simhash.reach(t), np.arange(256)
        near = [{v for v in range(256) if (v ^ x).bit_count() <= r} for x in range(256)]
        assert len(near[7]) == simhash.ball(8, r)
        for x, y in [(5, int(v) ^ 5) for v in values]:
            d = (x ^ y).bit_count()
            assert len(near[x] & near[y]) == simhash.meetings(8, r, d) and (d > t or near[x] & near[y])


@pytest.mark.parametrize("n", [200_000, 2_200_000, 11_000_000])
def test_probes_stay_few_as_the_table_grows(n):
    # Before, 2.2 million fingerprints (documents of 6 GB) had 428 probes each within a radius of 10.
    law = np.array([[0.005, 0.034, 0.114, 0.221, 0.272, 0.214, 0.106, 0.03, 0.004]] * 8)
    parts = simhash.allocate(n, law, 10)
    assert sum(simhash.ball(size * simhash.WIDTH, simhash.reach(t)) for _, size, t in parts) <= 100


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    rows = spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")
    root = components(500, links)
    got = {r.node: r.root for r in star_components(rows).collect()}
    assert got == {i: root[i] for a, b in links if a != b for i in (a, b)}
    assert star_components(rows.limit(0)).count() == 0


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicate_classes(odd_docs).collect()
    assert len(rows) == 8
    assert {r.component_id for r in rows if r.fp == 0} == {8}
    assert simhash.near_duplicate_classes(no_docs).count() == 0


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def stays(spark, rows, **limits):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)], "doc_id bigint, text string, class string").repartition(3)
    return {r.doc_id for r in simhash.staying(docs, **limits).collect()}


def check_stays(rows, kept, close=True):
    """Every other row is like one that stays; with `close`, no two that stay are alike."""
    sets = [shingles(t) for t in rows]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(any(like(g, k) >= 0.8 for k in kept) for g in set(range(len(rows))) - kept)
    assert not close or all(like(a, b) < 0.8 for a in kept for b in kept if a < b)


def invented(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def test_near_copies_are_dropped_and_others_stay(spark):
    rng = random.Random(9)
    base = [" ".join(invented(rng, 150)) for _ in range(30)]
    rows = list(base)
    for i in range(0, 30, 3):
        for _ in range(rng.randint(1, 4)):
            w = base[i].split()
            w[rng.randrange(len(w))] = "edit"
            rows.append(" ".join(w))
    rows += [base[1], base[1], base[2] + " one more sentence that differs a lot from what was said " + base[4], "", " ", "Two Words", "two words"]
    kept = stays(spark, rows)
    check_stays(rows, kept)
    assert stays(spark, []) == set()
    # Small groups go through rounds of leaders, with the same guarantee.
    check_stays(rows, stays(spark, rows, group_rows=2, group_bytes=2500))


@pytest.mark.parametrize("group_rows", [2048, 10])
def test_only_a_kept_text_drops_others(spark, group_rows):
    rng = random.Random(10)
    rows = []
    for _ in range(3):
        # A chain: neighbours are alike, those two steps apart are not.
        w = invented(rng, 150)
        for step in range(24):
            rows.append(" ".join(w))
            for j in range(3):
                w[10 + 18 * step % 130 + 6 * j] = f"e{step}{j}"
    rng.shuffle(rows)
    kept = stays(spark, rows, group_rows=group_rows)
    check_stays(rows, kept)
    assert len(kept) < len(rows)


def test_a_large_group_of_near_copies(spark):
    """5,000 near copies of one text, and templated texts that share half their words but are not alike."""
    rng = random.Random(11)
    base = invented(rng, 120)
    rows = [" ".join(base)]
    for _ in range(5000):
        w = list(base)
        w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    half = invented(rng, 60)
    rows += [" ".join(half + invented(rng, 60)) for _ in range(300)]
    kept = stays(spark, rows, group_rows=512)
    check_stays(rows, kept, close=False)
    assert sum(k <= 5000 for k in kept) <= 3 and all(k in kept for k in range(5001, len(rows)))


def edits(rng, words, kind):
    n = len(words)
    if kind == "scattered":
        out = list(words)
        for at in rng.sample(range(n), max(1, n // 55)):
            out[at] = f"e{rng.randrange(10**6)}"
        return out
    size = n * {"appended": 24, "replaced": 8}[kind] // 100
    if kind == "appended":
        return words + invented(rng, size)
    at = rng.randrange(n - size)
    return words[:at] + invented(rng, size) + words[at + size :]


@pytest.mark.parametrize("kind", ["scattered", "appended", "replaced"])
def test_recall_at_the_edge_of_likeness(spark, kind):
    """Pairs of likeness 0.8 or little more, by edits near and far: at least 0.9 of them are found."""
    rng = random.Random(kind)
    rows, pairs = [], []
    for _ in range(250):
        w = invented(rng, rng.randint(100, 300), 3000)
        rows += [" ".join(w), " ".join(edits(rng, w, kind))]
        a, b = shingles(rows[-2]), shingles(rows[-1])
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((len(rows) - 2, len(rows) - 1))
    kept = stays(spark, rows)
    caught = sum(not (a in kept and b in kept) for a, b in pairs)
    assert len(pairs) > 60 and caught >= 0.9 * len(pairs), (caught, len(pairs))


# ---------------------------------------------------------------- repeated strings


def brute(rows, length):
    """rows: (id, bytes) in order; what is left of each, with the number of removed runs."""
    seen, out = set(), []
    for _, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((bytes(c for c, g in zip(b, gone) if not g), sum(gone), runs))
    return out


def test_repeats_match_brute_force(docs, texts):
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in substring_dedup.remove_repeats(docs).collect()}
    want = brute([(i, (t or "").encode()) for i, t in enumerate(texts)], 100)
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize(("length", "gram"), [(8, 3), (13, 5), (30, 30)])
def test_short_lengths(spark, length, gram):
    rng = random.Random(length)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for _ in range(40)] + ["a" * 90, "ab" * 50, "\0" * 40, "é世" * 20]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in substring_dedup.remove_repeats(rows, length, gram).collect()}
    assert [got[i] for i in range(len(texts))] == brute([(i, t.encode()) for i, t in enumerate(texts)], length)


def test_shards_merge_to_the_order_of_all_rotations():
    rng = np.random.default_rng(2)
    shards = [np.append(rng.integers(1, 4, n).astype(np.uint16), np.uint16(0)) for n in (1, 50, 200)]
    transforms = [substring_dedup.transform_of(s) for s in shards]
    backs = [substring_dedup.steps_back(t) for t in transforms]
    starts = [substring_dedup.starts_of(t, b) for t, b in zip(transforms, backs)]
    for s, at in zip(shards, starts):
        assert at.tolist() == substring_dedup.rotations(s).tolist()
    for length in (4, 7, 10):
        place, block = substring_dedup.merged([substring_dedup.before(t, b, substring_dedup.STRIDE) for t, b in zip(transforms, backs)], length)
        owner = np.repeat(np.arange(3), [len(s) for s in shards])
        prefix = [tuple(np.roll(shards[k], -int(i))[np.arange(length) % len(shards[k])].tolist()) for k in range(3) for i in starts[k]]
        ordered = [prefix[p] for p in place]
        assert ordered == sorted(prefix) and sorted(place.tolist()) == list(range(len(owner)))
        assert all((ordered[i] == ordered[i - 1]) == (block[i] == block[i - 1]) for i in range(1, len(block)))


def test_repeats_of_odd_rows(spark, no_docs):
    long = "x".join(str(i) for i in range(60))
    rows = spark.createDataFrame([(None, long), (3, long), (3, long), (3, "other " + long), (4, None), (4, "")], "doc_id bigint, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed, r.text is None) for r in substring_dedup.remove_repeats(rows).collect())
    n = len(long)
    assert got == [(-1, 0, False), (3, n, False), (3, n, False), (3, n, False), (4, 0, False), (4, 0, True)]
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    text = substring_dedup.remove_repeats(rows, as_text=True)
    assert dict(text.dtypes)["kept"] == "string" and hashlib.sha256(b"").hexdigest() in {r.h for r in text.select(F.sha2("kept", 256).alias("h")).collect()}


def test_repeated_rows_count_once(spark):
    rng = random.Random(14)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(90))
    tail = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    twice, other = tail(200) + shared + tail(200), tail(150) + shared + tail(300)
    rows = [(3, twice), (3, twice), (9, other), (None, other[:80]), (9, tail(300))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    # 90 bytes in common are too few: nothing goes, of either row.
    assert len(got) == 5 and all(r.n_removed == 0 for r in got)


@pytest.mark.parametrize("sampled", [1, 64])
def test_one_anchor_in_very_many_surroundings(spark, monkeypatch, sampled):
    """A phrase of 40 bytes in 3,000 texts, with and without its strings being dealt one by one."""
    monkeypatch.setattr(substring_dedup, "SAMPLED", sampled)
    monkeypatch.setattr(substring_dedup, "HOT_BYTES", 50_000)
    rng = random.Random(15)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    phrase, sides = "This phrase stands in nearly every text.", [some(90) for _ in range(40)]
    texts = [(rng.choice(sides) if i % 3 else some(90)) + phrase + (rng.choice(sides) if i % 2 else some(90)) for i in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    laid = rows.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("sub"), F.col("text").cast("binary").alias("text"))
    assert sampled > 1 or len(substring_dedup.hot_anchors(laid, 100, 32)) > 0
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in substring_dedup.remove_repeats(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute([(i, t.encode()) for i, t in enumerate(texts)], 100)


def test_one_text_that_repeats_a_phrase(spark, monkeypatch):
    """What no sample foretells is counted: the phrase's strings are dealt one by one all the same."""
    monkeypatch.setattr(substring_dedup, "SAMPLED", 1 << 40)
    monkeypatch.setattr(substring_dedup, "HOT_BYTES", 20_000)
    hot, made = [], substring_dedup.segments
    monkeypatch.setattr(substring_dedup, "segments", lambda *a: (hot.append(len(a[3])), made(*a))[1])
    rng = random.Random(16)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    phrase, sides = "This phrase of eighty bytes or more stands in one text very often, between others.", [some(90) for _ in range(12)]
    texts = ["".join((rng.choice(sides) if rng.random() < 0.3 else some(90)) + phrase for _ in range(900)), some(500) + phrase + sides[0]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in substring_dedup.remove_repeats(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute([(i, t.encode()) for i, t in enumerate(texts)], 100)
    # The sample's pass, one without and one with what was counted.
    assert hot[:2] == [0, 0] and len(hot) >= 3 and hot[-1] > 0


def test_anchors_are_the_leftmost_least():
    h = substring_dedup.np.array([5, 3, 3, 9, 1, 1, 7, 2, 2, 2, 8, 0, 4, 6, 3, 3], "uint64")
    for span in range(1, len(h) + 1):
        want = [i + int(h[i : i + span].argmin()) for i in range(len(h) - span + 1)]
        assert substring_dedup._anchors(h, span).tolist() == want
