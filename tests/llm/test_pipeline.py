"""The pipeline's stages on a small corpus, each against brute force on its own input."""

import random

import pytest

import corpus_pipeline
from assize.llm import perplexity
from tests.llm.test_duplicates import brute, shingles
from tests.llm.test_simple_operators import measures
from tests.llm.test_tokens import check_bins

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in "ba ce di fo gu ha".split() for b in "l m n r st nd".split()]
    good = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [good(rng.randint(12, 90)) for _ in range(260)]
    passage = good(70)
    texts += [texts[3], texts[4], texts[5] + " extra", texts[6] + "\n" + passage, passage + " " + good(40)]
    texts += ["qzx##! " * 30, "WJK!! " * 40, "few words", "", None]
    rows = [(i if i != 100 else None, t, ["en", "de"][i % 2], "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10]]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{at}/documents.parquet")
    labels = [(i, int(i < 260), 0) for i in range(0, 270, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    return f"file://{at}"


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    """Rows before the first stage and after each."""
    at, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{corpus}/documents.parquet")
    out = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus).write.parquet(f"file://{at}/{i}")
        docs = spark.read.parquet(f"file://{at}/{i}")
        out.append(docs.collect())
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    return out


def test_rules(stages):
    def passes(r):
        m = measures(r.text)
        base = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
        more = 2 * m["n_symbols"] > m["n_words"] or not 2 * m["n_words"] <= m["word_chars"] <= 20 * m["n_words"] or (m["n_lines"] >= 4 and 2 * m["n_dup_lines"] > m["n_lines"]) or 2 * m["n_capitals"] > m["word_chars"]
        return not (base or more)

    assert sorted(map(repr, stages[1])) == sorted(repr(r) for r in stages[0] if passes(r))


def test_classifier_keeps_nearly_all_of_one_kind(stages):
    assert set(map(repr, stages[2])) <= set(map(repr, stages[1])) and len(stages[2]) >= 0.95 * len(stages[1])


def test_one_of_each_group_stays(stages):
    kept = [(r, shingles(r.text)) for r in stages[3]]
    like = lambda a, b: len(a & b) / len(a | b)
    assert all(like(a, b) < 0.8 for i, (_, a) in enumerate(kept) for _, b in kept[:i])
    assert all(any(like(shingles(r.text), k) >= 0.8 for _, k in kept) for r in stages[2])
    assert sum(r.doc_id == 10 for r in stages[3]) <= 1


def test_repeated_passages_go(stages):
    rows = sorted(stages[3], key=lambda r: -1 if r.doc_id is None else r.doc_id)
    want = {r.doc_id: left.decode(errors="ignore") for r, (left, _, _) in zip(rows, brute([(r.doc_id, r.text.encode()) for r in rows], 100))}
    assert {r.doc_id: r.text for r in stages[4]} == want and all(r.n_chars == len(r.text) for r in stages[4])


def test_packing_holds_all(stages):
    assert {r.doc_id for r in stages[5]} == {r.doc_id for r in stages[4]}
    check_bins(stages[5], 4096)


def test_run(spark, corpus, stages):
    rows = corpus_pipeline.run(spark, corpus).collect()
    assert sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in rows) == sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in stages[5])


def test_rows_that_share_an_id_are_told_apart(spark, tmp_path):
    rng = random.Random(13)
    good = lambda: " ".join(rng.choice("the of and sat ran cat dog bird tree house near under over".split()) for _ in range(40))
    rows = [(i, good(), "en", "s", 1) for i in range(400)]
    junk, other = " ".join("qzx##!%d" % i for i in range(60)), good()
    rows += [(7, junk, "en", "s", 1), (8, other, "en", "s", 1), (8, other, "en", "s", 1), (8, other, None, "s", 1), (None, good(), "en", "s", 1), (None, good(), "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spark.createDataFrame([(i, 1, 0) for i in range(0, 400) if i != 7], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    kept = [tuple(r) for r in corpus_pipeline.quality_classifier(spark, docs, f"file://{tmp_path}").collect()]
    assert rows[400] not in kept and rows[7] in kept
    # Copies of one text under an id leave one row; another text under the same id stays.
    left = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, f"file://{tmp_path}").collect()]
    assert {r[1] for r in left} == {r[1] for r in rows} and len(left) == len({r[1] for r in rows})


def test_classifier_trains_on_all_of_the_half(spark, tmp_path, monkeypatch):
    # Before, 8,000 ids trained at most.
    drawn, seen = perplexity.drawn, []
    monkeypatch.setattr(perplexity, "drawn", lambda *a: seen.append(drawn(*a)) or seen[0])
    spark.range(20_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, f"the cat sat on mat {i % 3}", "en", "s", 1) for i in range(40)], SCHEMA).repartition(2)
    assert corpus_pipeline.quality_classifier(spark, docs, f"file://{tmp_path}").count() > 0
    train, others, _ = (x.count() for x in seen[0])
    assert train + others == 20_000 and train > 9_500


def test_empty_corpus(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
