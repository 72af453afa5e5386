"""The model against a plain Kneser-Ney model, and the classifier on held-out documents."""

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from assize.llm import perplexity


def plain_model(texts):
    """log p(word | two words before) of an interpolated modified Kneser-Ney model of trigrams."""
    three, two = Counter(), Counter()
    for t in texts:
        w = ["<s>", *t.split(), "</s>"]
        three.update(zip(w, w[1:], w[2:]))
        two[w[0], w[1]] += 1
    two.update((b, c) for _, b, c in three)
    one = Counter(c for _, c in two)
    d3, d2, d1 = (perplexity.discounts(Counter(x.values())) for x in (three, two, one))
    disc = lambda d, n: d[min(n, 3) - 1]

    def contexts(counts, d):
        total, freed = defaultdict(int), defaultdict(float)
        for gram, n in counts.items():
            total[gram[:-1]] += n
            freed[gram[:-1]] += disc(d, n)
        return total, freed

    (total3, freed3), (total2, freed2) = contexts(three, d3), contexts(two, d2)
    all_types, share = sum(one.values()), sum(disc(d1, n) for n in one.values())
    share = share / all_types / (len(one) + 1)

    def level(counts, d, total, freed, gram, lower):
        if gram[:-1] not in total:
            return lower
        n = counts.get(gram, 0)
        return ((n - disc(d, n) if n else 0) + freed[gram[:-1]] * lower) / total[gram[:-1]]

    def log_p(before, context, word):
        p = share if word not in one else (one[word] - disc(d1, one[word])) / all_types + share
        p = level(two, d2, total2, freed2, (context, word), p)
        return math.log(p if before is None else level(three, d3, total3, freed3, (before, context, word), p))

    return log_p


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice("the of and sat ran cat dog bird tree house near under over".split()) for _ in range(rng.randint(5, 60)))
    junk = lambda: " ".join("".join(rng.choice("qzxjkw#!") for _ in range(6)) for _ in range(rng.randint(20, 60)))
    return [(i, junk() if i % 7 == 0 else good(), ["en", "de"][i % 2]) for i in range(900)]


def test_scores_are_the_plain_model_s(spark, corpus):
    train = [(t, "en") for i, t, _ in corpus if i % 7 and i < 300]
    values, unknown = perplexity.kneser_ney(perplexity.ngram_counts(spark.createDataFrame(train, "text string, lang string").repartition(3)))
    rest = [(i, t, "en") for i, t, _ in corpus if i >= 300] + [(2000, "", "en"), (2001, None, "en"), (2002, "the cat", "xx"), (2003, "the cat", None)]
    docs = spark.createDataFrame(rest, "doc_id bigint, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in perplexity.scored(docs, values, unknown).collect()}
    log_p = plain_model([t for t, _ in train])
    for i, t, lang in rest:
        w = ["<s>", *(t or "").split(), "</s>"]
        assert got[i].n_tokens == len(w) - 1
        if lang == "en":
            assert got[i].log_p == pytest.approx(sum(log_p(*x) for x in zip([None, *w], w, w[1:])), rel=1e-6)
        else:
            assert got[i].log_p is None


def test_probabilities_sum_to_one():
    log_p = plain_model(["a b c a b", "b c a", "a a"])
    words = ["a", "b", "c", "</s>"]
    for before in (None, "<s>", "a", "b", "c", "never"):
        for context in ("<s>", "a", "b", "c"):
            assert sum(math.exp(log_p(before, context, w)) for w in [*words, "unknown"]) == pytest.approx(1, abs=1e-9)


def test_junk_is_rejected_and_clean_text_kept(spark, corpus, monkeypatch):
    docs = spark.createDataFrame([(i, t, lang, "clash") for i, t, lang in corpus], "doc_id bigint, text string, lang string, threshold string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 7 != 0), 0) for i, _, _ in corpus if i % 3 < 2], "doc_id bigint, quality int, toxic int")
    rows = {r.doc_id: r for r in perplexity.classify(docs, labels).collect()}
    held_out = [i for i, _, _ in corpus if i % 3 == 2]
    assert all(not rows[i].kept for i in held_out if i % 7 == 0)
    clean = [rows[i].kept for i in held_out if i % 7]
    assert sum(clean) >= 0.97 * len(clean)
    monkeypatch.setattr(perplexity, "BLOCK_PARTITIONS", 1)
    blocks = {r.doc_id: r for r in perplexity.classify(docs, labels).collect()}
    assert all(blocks[i].kept == rows[i].kept and blocks[i].score == pytest.approx(rows[i].score) for i in rows)
    # A model of few texts still tells the two kinds apart.
    small = {r.doc_id: r.kept for r in perplexity.classify(docs, labels, train_docs=40).collect()}
    assert len(small) == len(corpus) and sum(small[i] for i in held_out if i % 7) >= 0.9 * len(clean) and not any(small[i] for i in held_out if i % 7 == 0)


def test_all_other_trusted_ids_calibrate(spark):
    rows = [(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(300)] + [(None, 1, 0), (301, 1, None), (302, None, 1)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").repartition(3)
    train, others, toxic = ([r[0] for r in x.collect()] for x in perplexity.drawn(labels, train_docs=20))
    assert len(train) == 20 and sorted(train + others) == [i for i, q, t in rows if i is not None and q == 1 and not t]
    assert 0 < len(toxic) <= 20 and set(toxic) <= {i for i, _, t in rows if t}


def test_all_of_the_training_half_trains(spark):
    # Before, 8,000 ids of a kind trained at most, and 3,000 of them fitted the trigrams.
    labels = spark.range(40_000).selectExpr("id AS doc_id", "1 AS quality", "cast(id % 2 AS int) AS toxic")
    train, others, toxic = (x.count() for x in perplexity.drawn(labels))
    assert train + others == 20_000 and min(train, toxic) > 9_500


def test_all_toxic_ids_train(spark):
    # Before, half of them trained, and the other half was used for nothing.
    labels = spark.range(4_000).selectExpr("id AS doc_id", "1 AS quality", "cast(id % 2 AS int) AS toxic")
    _, _, toxic = perplexity.drawn(labels)
    assert toxic.count() == 2_000


def test_words_beyond_the_table_have_their_contrast(spark, monkeypatch):
    rng = random.Random(15)
    good, bad = "the of and sat ran cat dog bird tree house near".split(), "idiot scum moron fool rat pig".split()
    text = lambda i: " ".join([rng.choice(good) for _ in range(30)] + [rng.choice(bad) for _ in range(i % 4 == 0)])
    docs = spark.createDataFrame([(i, text(i), "en") for i in range(400)], "doc_id bigint, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int")
    want = {r.doc_id: (r.worst, r.kept) for r in perplexity.classify(docs, labels).collect()}
    monkeypatch.setattr(perplexity, "CONTRAST_WORDS", 2)
    got = {r.doc_id: (r.worst, r.kept) for r in perplexity.classify(docs, labels).collect()}
    assert got == want and len({w for w, _ in want.values()}) > 3


def test_toxic_prose_is_rejected(spark):
    rng = random.Random(14)
    insults = "idiot scum moron".split()

    def text(i):
        w = [rng.choice("the of and sat ran cat dog bird tree house near under over".split()) + rng.choice(["", "s", "ing", "ed"]) for _ in range(rng.randint(60, 200))]
        for _ in range(2 * (i % 5 == 0)):
            w[rng.randrange(len(w))] = rng.choice(insults)
        return " ".join(w)

    docs = spark.createDataFrame([(i, text(i), ["en", "de"][i % 2]) for i in range(1200)], "doc_id bigint, text string, lang string").repartition(4)
    # Held out are all ids that no label names.
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(1200) if i % 3], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in perplexity.classify(docs, labels).collect()}
    toxic, clean = ([kept[i] for i in range(0, 1200, 3) if (i % 5 == 0) == bad] for bad in (True, False))
    assert sum(toxic) <= 0.05 * len(toxic) and sum(clean) >= 0.97 * len(clean)


def test_without_labels_or_documents_everything_is_kept(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(None, 1, None), (7, None, 0), (8, 0, 1)], "doc_id bigint, quality int, toxic int")
    rows = perplexity.classify(odd_docs.withColumn("lang", F.lit("en")), labels)
    assert [r.kept for r in rows.collect()] == [True] * 8
    assert perplexity.classify(no_docs.withColumn("lang", F.lit("en")), labels).count() == 0
    trusted = spark.createDataFrame([(7, 1, 0), (8, 1, None)], "doc_id bigint, quality int, toxic int")
    assert perplexity.classify(odd_docs.withColumn("lang", F.lit(None).cast("string")), trusted).count() == 8


def test_the_model_takes_few_bytes_an_n_gram(spark):
    # Before, an n-gram was a row of five hashes while it was counted; each count and each join moved all of them.
    rng = random.Random(21)
    texts = [" ".join(str(rng.randrange(3000)) for _ in range(400)) for _ in range(200)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(4)
    grams = len({g for t in texts for w in [["<s>", *t.split(), "</s>"]] for k in (1, 2, 3) for g in zip(*(w[i:] for i in range(k)))})
    size = lambda t: sum(f.stat().st_size for f in Path(t.path.removeprefix("file:")).glob("*.parquet"))
    counted = perplexity.tidied(perplexity.ngram_counts(docs))
    model, _ = perplexity.kneser_ney(perplexity.ngram_counts(docs))
    rows = model.read().collect()
    assert sum(len(perplexity.unpacked(r["value"], "float32")) for r in rows) == grams
    assert size(counted) < 8 * grams and sum(len(r["keys"]) + len(r["value"]) for r in rows) < 12 * grams
    model.drop()
    assert not Path(model.path.removeprefix("file:")).exists()


def test_slices_and_their_number_change_no_score(spark, corpus, monkeypatch):
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang in corpus], "doc_id bigint, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(i, int(i % 7 != 0), int(i % 35 == 0)) for i, _, _ in corpus if i % 3 < 2], "doc_id bigint, quality int, toxic int")
    results = []
    for slices, scored in ((4, 6), (1, 1), (3, 2)):
        monkeypatch.setattr(perplexity, "SLICES", slices)
        monkeypatch.setattr(perplexity, "SCORED_SLICES", scored)
        results.append({r.doc_id: (r.n_tokens, round(r.perplexity, 6), round(r.worst, 6), r.kept) for r in perplexity.classify(docs, labels).collect()})
    assert len(results[0]) == len(corpus) and results[0] == results[1] == results[2]


@pytest.mark.parametrize("words", [50, 1 << 20])
def test_ngrams_are_ordered_by_pair_and_word_before(words):
    rng = np.random.default_rng(5)
    pair, a = rng.integers(0, 50 * 50, 5000), rng.integers(0, 51, 5000)
    order, want = perplexity._ordered(pair, a, words), np.lexsort((a, pair))
    assert (pair[order] == pair[want]).all() and (a[order] == a[want]).all()


def test_words_are_hashed_in_small_blocks(monkeypatch):
    """Prefix sums take many times their bytes; before, they were made of a whole chunk of 3 MB at once."""
    sizes, rolling = [], perplexity.Rolling

    def seen(data):
        sizes.append(len(data))
        return rolling(data)

    monkeypatch.setattr(perplexity, "Rolling", seen)
    texts = [b"one two  three\n" * 60_000, b"x" * 300_000 + b" y", b"", b" a b "]
    doc, got = perplexity.word_hashes(texts)
    assert max(sizes) <= 300_000 and len(sizes) > 3
    words = [[rolling(np.frombuffer(w, np.uint8)).of(np.array([0]), np.array([len(w)]))[0] for w in t.split()] for t in (texts[0][:15], *texts[1:])]
    assert got[doc == 0][1:-1].tolist() == words[0] * 60_000
    assert [got[doc == i][1:-1].tolist() for i in (1, 2, 3)] == words[1:]


def test_groups_give_their_memory_back(monkeypatch):
    from inspect import signature

    from assize.llm import common

    released = []
    monkeypatch.setattr(common, "release", lambda circles=True: released.append(circles))

    def one(key, rows):
        return rows

    assert common.lean_group(one)(1, 2) == 2 and released == [False]
    assert list(signature(common.lean_group(one)).parameters) == ["key", "rows"]
