import json
import sys
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assize.functions.text import json_body, lines, strip, terminal_token, truncated
from assize.functions.verdicts import blocking_kind, confidence, decisive, fingerprint, parse_verdict, prepare, route, terminal_disposition, verdict_json
from tests import model

RAWS = [
    '{"refuted": false}', '{}', '```json\n{"finding": "x", "refuted": true, "confidence": " HIGH "}\n```', "```\n{\"refuted\": false}\n```", "Refuted", "Refuted.", "Not Refuted!", "```\nRefuted\n```", "`Refuted`", "`Refuted`.",
    "refuted", "some prose", "", "   ", '{"a": 1} x {"b": 2}', '{"a": 1} x {"b": 2}\nNot Refuted', "{'a': 1}\nRefuted", '{"a": 1,}\nRefuted', '{"a": NaN}\nNot Refuted', '{"a": 01}', '{"refuted": "false"}', '{"refuted": null}', '{"refuted": 0}',
    '{"refuted": ""}', '{"findings": null}\nNot Refuted', '{"evidence_refs": null}', '{"findings": [1]}\nRefuted', '{"evidence_refs": ["x"]}', '{"findings": [{"kind": 3}]}', '{"confidence": 3}\nNot Refuted', '{"confidence": "certain"}', '{"confidence": "LOW"}',
    '{"blocking": "contradiction"}', '{"blocking": "unverifiable"}', '{"blocking": "future"}', '{"blocking": true}', '{"blocking_kind": "contradiction"}', '{"refuted": true, "refuted": false}', 'Notes {"refuted": false} end.\nRefuted',
    '```json\n{"bad": }\n``` then {"refuted": false}', '{"findings": [{"kind": "a", "location": "b", "detail": "c"}, {"kind": "", "location": " ", "detail": ""}]}', '{"findings": [{"kind": "é", "detail": "世界 😀"}]}', 'Refuted or not?\nNot Refuted\nRefuted',
    '{"a": "x\ty"}', '{"n": 123456789012345678901234567890, "refuted": false}', " Refuted Not Refuted", "a\x1cRefuted\x1c", '{"evidence_refs": {"a": 1}}', '{"findings": [{"kind": null}]}',
]


def parsed(spark, raws):
    prepare(spark)
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").withColumn("v", parse_verdict(F.col("raw")))
    return [r.asDict() for r in rows.select("i", "v.tier", "v.refuted", "v.blocking", "v.confidence", fingerprint(F.col("v.findings")).alias("fp")).orderBy("i").collect()]


def test_tiers_match_the_model(spark):
    got = parsed(spark, RAWS)
    wrong = [(raw, g, model.parse(raw)) for raw, g in zip(RAWS, got) if {k: v for k, v in g.items() if k != "i"} != model.parse(raw)]
    # A raw control character inside a string is accepted by neither; everything must agree.
    assert not wrong


def test_null_text_is_rejected(spark):
    assert parsed(spark, [None])[0] | {"i": 0} == {"i": 0, "tier": 3, "refuted": True, "blocking": True, "confidence": "unknown", "fp": ""}


texts = st.one_of(
    st.sampled_from(RAWS),
    st.text(alphabet=st.sampled_from(list('{}[]":,`.! \n\trefutdRN \x1c')), max_size=40),
    st.dictionaries(st.sampled_from(["finding", "refuted", "confidence", "blocking", "findings", "reasoning"]), st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.sampled_from(["high", "none", "contradiction", ""]), st.lists(st.dictionaries(st.sampled_from(["kind", "location", "detail"]), st.text(alphabet="ab :|", max_size=3)), max_size=3))).map(json.dumps),
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(texts, min_size=40, max_size=80))
def test_any_text_parses_as_the_model(spark, raws):
    got = parsed(spark, raws)
    for raw, g in zip(raws, got):
        assert {k: v for k, v in g.items() if k != "i"} == model.parse(raw), raw


def test_every_white_space_and_line_end(spark):
    chars = [chr(i) for i in range(0x3100) if not unicodedata.category(chr(i)) == "Cs"]
    rows = spark.createDataFrame([(c,) for c in chars], "ch string").select("ch", strip(F.concat(F.col("ch"), F.lit("a b"), F.col("ch"))).alias("s"), F.size(lines(F.concat(F.lit("a"), F.col("ch"), F.lit("b")))).alias("n"))
    for r in rows.collect():
        assert r.s == (r.ch + "a b" + r.ch).strip(), hex(ord(r.ch))
        assert r.n == len(("a" + r.ch + "b").splitlines()), hex(ord(r.ch))
    assert sys.maxunicode > 0x3100


@pytest.mark.parametrize(("said", "want"), [("high", "high"), (" Medium\n", "medium"), ("LOW", "low"), ("certain", "unknown"), ("", "unknown"), (None, "unknown")])
def test_confidence(spark, said, want):
    assert spark.createDataFrame([(said,)], "x string").select(confidence(F.col("x")).alias("c")).first().c == want


@pytest.mark.parametrize(("said", "want"), [("none", "none"), ("contradiction", "contradiction"), ("unverifiable", "unverifiable"), ("other", "none"), (None, "none")])
def test_blocking_kind(spark, said, want):
    assert spark.createDataFrame([(said,)], "x string").select(blocking_kind(F.col("x")).alias("c")).first().c == want


def test_fingerprint_is_order_free_and_skips_blanks(spark):
    a, b, blank = ("k", "l", "d"), ("k2", "l2", "é"), ("", " ", " ")
    rows = spark.createDataFrame([([a, b],), ([b, blank, a],), ([a],), ([blank],), ([],), ([a, a],), (None,)], "f array<struct<kind:string,location:string,detail:string>>")
    fps = [r.fp for r in rows.select(fingerprint(F.col("f")).alias("fp")).collect()]
    named = [dict(zip(("kind", "location", "detail"), x)) for x in (a, b)]
    assert fps[0] == fps[1] == model.fingerprint(named)
    assert fps[2] == model.fingerprint(named[:1]) != fps[0]
    assert fps[3] == fps[4] == fps[6] == ""
    assert fps[5] == model.fingerprint(named[:1] * 2) != fps[2]


def test_routes_and_dispositions(spark):
    prepare(spark)
    raws = ['{"refuted": false}', '{"refuted": true, "confidence": "high"}', '{"refuted": true, "blocking": "contradiction"}', '{"refuted": false, "blocking": "contradiction"}']
    v = spark.createDataFrame([(r,) for r in raws], "raw string").select(parse_verdict(F.col("raw")).alias("v"))
    got = [tuple(r) for r in v.select(route(F.col("v")), terminal_disposition(F.col("v")), decisive(F.col("v"))).collect()]
    assert got == [("not_refuted", "approved", False), ("refuted", "rejected", True), ("blocked", "blocked", False), ("blocked", "approved", False)]
    assert set(json.loads(v.select(verdict_json(F.col("v")).alias("j")).first().j)) == {"finding", "refuted", "confidence", "blocking", "blocking_kind", "evidence_refs", "findings", "reasoning"}


def test_body_token_and_truncation(spark):
    rows = spark.createDataFrame([("x {\"a\": 1} y", "a" * 2001), ("none", "a" * 2000)], "raw string, t string")
    got = rows.select(json_body(F.col("raw")).alias("b"), terminal_token(F.col("raw")).alias("k"), truncated(F.col("t")).alias("t")).collect()
    assert (got[0].b, got[0].k, got[0].t) == ('{"a": 1}', None, "a" * 2000 + "\n... (truncated)")
    assert (got[1].b, got[1].t) == (None, "a" * 2000)
