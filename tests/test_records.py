"""Books and transcripts in files, and citations that meet their source at once."""

import random

import pytest
from pyspark.sql import functions as F

from assize.operators import catalog, citations
from assize.sources import files


@pytest.mark.parametrize("one_by_one", [0, 1000])
@pytest.mark.parametrize("block", [80, 1 << 20])
def test_citations_at_once(spark, block, one_by_one, monkeypatch):
    """As one by one, with repeated rows, unknown sources, nulls, blanks and snippets inside each other."""
    monkeypatch.setattr(citations, "ONE_BY_ONE", one_by_one)
    rng = random.Random(3)
    texts = [(case, source, "".join(rng.choice("ab é\n") for _ in range(300))) for case in (1, 2) for source in "xy"] + [(3, "x", None)]
    refs = [(rng.choice([1, 1, 1, 2, 3, 4, None]), rng.choice(["x", "x", "y", "z", None]), rng.choice(["", " ", None, *(["".join(rng.choice("ab é\n") for _ in range(rng.randint(1, 7)))] * 5)]), i % 7) for i in range(400)]
    refs += [(1, "x", "ab", 0)] * 50
    df, sources = spark.createDataFrame(refs, "case_id int, source string, snippet string, content int"), spark.createDataFrame(texts, "case_id int, source string, content string")
    known = {(case, source): text for case, source, text in texts}
    want = [(*r, bool(known.get(r[:2])) and bool((r[2] or "").strip()) and r[2].strip() in known[r[:2]]) for r in refs]
    assert sorted(map(repr, (tuple(r) for r in citations.verify_at_once(df, sources, block=block).collect()))) == sorted(map(repr, want))


def test_a_source_with_many_citations_is_read_once(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(2000))
    refs = spark.range(3000).select(F.lit(1).alias("case_id"), F.lit("s").alias("source"), F.format_string("w%d", "id").alias("snippet"), "id")
    got = citations.verify_at_once(refs, spark.createDataFrame([(1, "s", text)], "case_id int, source string, content string"))
    assert got.where("verified").count() == 2000 and got.count() == 3000


def test_no_citations_and_no_sources(spark):
    refs, sources = spark.createDataFrame([(1, "s", "x")], "case_id int, source string, snippet string"), spark.createDataFrame([(1, "s", "x")], "case_id int, source string, content string")
    assert citations.verify_at_once(refs.limit(0), sources).count() == 0
    assert [r.verified for r in citations.verify_at_once(refs, sources.limit(0)).collect()] == [False]


def test_books_through_files(spark, tmp_path):
    at = (tmp_path / "books").as_uri()
    laws = spark.createDataFrame([(0, '{"name": "a"}', 1), (1, '{"name": "b", "description": "first"}', 1), (2, '{"name": "b", "description": "last"}', 1), (0, '{"name": "a", "blocking": false}', 2)], "ord int, json string, shelf int")
    book = catalog.statutes_from_json(laws.where("shelf = 1")).withColumn("shelf", F.lit(1)).unionByName(catalog.statutes_from_json(laws.where("shelf = 2")).withColumn("shelf", F.lit(2)))
    files.write_books(book, at, "shelf")
    # A file that people write: over several lines.
    (tmp_path / "books" / "own.json").write_text('{\n  "statutes": [\n    {"name": "c"}\n  ]\n}\n')
    (tmp_path / "books" / "empty.json").write_text("{}")
    got = {(r.file.split("books/")[1].split("/")[0], r.ord, r.name, r.description, r.blocking) for r in files.read_books(spark, at).collect()}
    assert got == {("shelf=1", 0, "a", "", True), ("shelf=1", 1, "b", "last", True), ("shelf=2", 0, "a", "", False), ("own.json", 0, "c", "", True)}


def test_malformed_lines_are_set_apart(spark, tmp_path):
    lines = ['{"case_id": 1, "call_idx": 0, "raw": "Refuted"}', '{"case_id": 1, "call_idx": 1', '{"case_id": "x", "call_idx": 2, "raw": "y"}', '{"case_id": 2, "call_idx": 0}', "", "  ", "prose", '{"case_id": 2, "call_idx": 1, "raw": "a\\nb", "more": 1}']
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.jsonl").write_text("\n".join(lines))
    rows = files.read_transcript(spark, (tmp_path / "t").as_uri())
    assert sorted((r.case_id, r.call_idx, r.raw) for r in rows.where("malformed is null").collect()) == [(1, 0, "Refuted"), (2, 1, "a\nb")]
    assert sorted(r.malformed for r in rows.where("malformed is not null").collect()) == sorted([lines[1], lines[2], lines[3], lines[6]])
