import json

import pytest
from pyspark.sql import functions as F

from assize.functions.evidence import citation_failure, evidence_reason, packet_section
from assize.operators import catalog, citations, extensions, procedure, stalls
from assize.operators.procedure import CODE, JUDGMENT, Procedure, Step

REFS = "array<struct<source:string,location:string,snippet:string,kind:string>>"


@pytest.mark.parametrize(
    ("refs", "required", "least", "want"),
    [
        ([], [], 1, "no evidence refs provided"),
        ([], [], 0, ""),
        ([], ["a"], 0, "required source 'a' not cited"),
        ([("a", "", "x", "text")], ["a"], 1, ""),
        ([("a", "", "x", "text")], ["b", "c"], 1, "required source 'b' not cited"),
        ([("a", "", "x", "text")], [], 2, "only 1 citations, need at least 2"),
        ([("a", "", "x", "text"), ("b", "", "  ", "text"), ("c", "", "", "text")], ["a"], 1, "evidence from 'b' has empty snippet"),
        ([("a", "", " ", "text")], ["b"], 1, "required source 'b' not cited"),
        ([("a", "", None, "text")], [], 1, "evidence from 'a' has empty snippet"),
        ([("a", "", "x", "text")], None, 1, ""),
    ],
)
def test_evidence_rule(spark, refs, required, least, want):
    rows = spark.createDataFrame([(refs, required)], f"refs {REFS}, required array<string>")
    assert rows.select(evidence_reason(F.col("refs"), F.col("required"), least).alias("r")).first().r == want


def test_blank_snippets_pass_if_they_need_not_be_verifiable(spark):
    rows = spark.createDataFrame([([("a", "", "", "text")],)], f"refs {REFS}")
    assert rows.select(evidence_reason(F.col("refs"), F.array().cast("array<string>"), 1, verifiable=False).alias("r")).first().r == ""


def test_citations_hold_in_their_own_case_only(spark):
    sources = spark.createDataFrame([(1, "doc", "The quick brown fox"), (2, "doc", "another text")], "case_id int, source string, content string")
    refs = [(1, 0, "doc", "quick"), (1, 1, "doc", "  brown fox "), (1, 2, "doc", "Quick"), (1, 3, "other", "quick"), (1, 4, "doc", " "), (2, 0, "doc", "quick"), (2, 1, "doc", None), (3, 0, "doc", "x")]
    got = citations.verify(spark.createDataFrame(refs, "case_id int, pos int, source string, snippet string"), sources)
    assert {(r.case_id, r.pos): r.verified for r in got.collect()} == {(1, 0): True, (1, 1): True, (1, 2): False, (1, 3): False, (1, 4): False, (2, 0): False, (2, 1): False, (3, 0): False}
    told = {r.case_id: r for r in citations.failures(got.where("snippet is not null")).collect()}
    assert not told[1].all_verified and told[1].messages[0] == "Unverifiable: 'Quick...' not found in 'doc'" and len(told[1].messages) == 3


def test_failure_message_is_cut(spark):
    row = spark.createDataFrame([("x" * 70, "s")], "a string, b string")
    assert row.select(citation_failure(F.col("a"), F.col("b")).alias("m")).first().m == "Unverifiable: '" + "x" * 60 + "...' not found in 's'"


def test_latest_source_wins(spark):
    rows = spark.createDataFrame([(1, "a", "old", 0), (1, "a", "new", 1), (1, "b", "x", 0)], "case_id int, source string, content string, ord int")
    assert {(r.source, r.content) for r in citations.latest_sources(rows).collect()} == {("a", "new"), ("b", "x")}


def test_containment_finds_what_brute_force_finds(spark):
    texts = ["one two three four five six seven eight", "zone two three four five six seven eightfold", "short", "", None, "a  b\nc d e f g", "x one two three four five six seven eight y"]
    snippets = ["one two three four five six seven eight", "two three", "short", "", "a  b\nc d e f g", "a b c d e f g", None, "e", "two three four five six seven"]
    t = spark.createDataFrame(list(enumerate(texts)), "t int, text string")
    s = spark.createDataFrame(list(enumerate(snippets)), "s int, snippet string")
    got = {tuple(r) for r in citations.contained(t, s, "t", "text", "s", "snippet").collect()}
    assert got == {(i, j) for i, x in enumerate(texts) for j, y in enumerate(snippets) if x is not None and y and y in x}


def test_packet(spark):
    rows = spark.createDataFrame([("do it", [("a", "1"), ("b", "2")], ["g"]), ("do it", [], [])], "o string, a array<struct<name:string,content:string>>, g array<string>")
    got = [r.s for r in rows.select(packet_section(F.col("o"), F.col("a"), F.col("g")).alias("s")).collect()]
    assert got == ["## OBJECTIVE\ndo it\n\n## EVIDENCE\n\n### a\n1\n\n### b\n2\n\n## PRIOR GAPS (from previous rounds)\n- g", "## OBJECTIVE\ndo it\n\n## EVIDENCE"]


# ---------------------------------------------------------------- catalog

FULL = {
    "name": "full", "description": "d", "threshold": {"confidence_min": "high"}, "required_evidence": ["a", "b"], "violations": [{"name": "v", "severity": "high", "description": "x"}],
    "escalation": {"max_violations": 2, "action": "flag", "escalate_to": "boss"}, "default_to_reject": False, "blocking": False,
}


def book(spark, *laws):
    return catalog.statutes_from_json(spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(laws)], "ord int, json string"))


def test_statute_defaults_and_round_trip(spark):
    rows = book(spark, FULL, {"name": "minimal"}, {"description": "nameless"}, {"name": "bad", "violations": [{"name": "v"}]})
    again = [json.loads(r.j) for r in rows.orderBy("ord").select(catalog.statute_json().alias("j")).collect()]
    assert again[0] == FULL and len(again) == 2
    assert again[1] == {"name": "minimal", "description": "", "threshold": {}, "required_evidence": [], "violations": [], "escalation": {"max_violations": 3, "action": "block", "escalate_to": None}, "default_to_reject": True, "blocking": True}


def test_upsert_keeps_the_first_place_and_the_last_value(spark):
    rows = catalog.upserted(book(spark, {"name": "a", "description": "old"}, {"name": "b"}, {"name": "a", "description": "new"}))
    assert [(r.ord, r.name, r.description) for r in rows.orderBy("ord").collect()] == [(0, "a", "new"), (1, "b", "")]


def test_lookup_drops_unknown_names_and_keeps_repeats(spark):
    rows = spark.createDataFrame([(1, ["b", "zzz", "a", "b"]), (2, [])], "k int, names array<string>")
    got = catalog.get_all(rows, "names", book(spark, {"name": "a"}, {"name": "b"})).orderBy("k", "pos").collect()
    assert [(r.k, r.pos, r.statute.name) for r in got] == [(1, 0, "b"), (1, 2, "a"), (1, 3, "b")]


def test_book_json_round_trip(spark):
    rows = book(spark, FULL, {"name": "b"})
    text = catalog.book_json(rows).first().json
    assert [s["name"] for s in json.loads(text)["statutes"]] == ["full", "b"]
    assert [r.name for r in catalog.book_from_json(spark.createDataFrame([(text,)], "json string")).orderBy("ord").collect()] == ["full", "b"]
    assert catalog.book_from_json(spark.createDataFrame([("{}",)], "json string")).count() == 0
    assert json.loads(catalog.book_json(rows.limit(0)).first().json) == {"statutes": []}


def test_get_and_size(spark):
    book = catalog.statutes_from_json(spark.createDataFrame([(0, '{"name": "a", "description": "x"}'), (1, '{"name": "b"}')], "ord int, json string"))
    rows = spark.createDataFrame([(1, "a", "old"), (2, "zzz", "old"), (3, None, "old")], "id int, name string, statute string")
    got = {r.id: (r.known, r.statute and r.statute.description) for r in catalog.get(rows, "name", book).collect()}
    assert got == {1: (True, "x"), 2: (False, None), 3: (False, None)}
    assert catalog.size(book).first().n == 2 and catalog.size(book.limit(0)).first().n == 0


# ---------------------------------------------------------------- procedures

P = Procedure("p", (Step("a", JUDGMENT, ("law",), {"refuted": "b", "not_refuted": "c"}), Step("b", CODE, (), {"done": "a", "other": "c"}), Step("c", CODE)))


@pytest.mark.parametrize("make", [lambda: Procedure("p", ()), lambda: Procedure("p", (Step("a", CODE),), "zzz"), lambda: Procedure("p", (Step("a", CODE, (), {"done": "zzz"}),))])
def test_procedures_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_stored_procedures(spark):
    rows = procedure.stored(P.limits_frame(spark), P.steps_frame(spark), P.transitions_frame(spark))
    text = rows.first().json
    assert json.loads(text) == {
        "name": "p", "initial_step": "a", "max_rounds": 10, "stall_threshold": 2,
        "steps": [
            {"name": "a", "kind": "JUDGMENT", "statutes": ["law"], "transitions": {"refuted": "b", "not_refuted": "c"}},
            {"name": "b", "kind": "CODE", "statutes": [], "transitions": {"done": "a", "other": "c"}}, {"name": "c", "kind": "CODE", "statutes": [], "transitions": {}},
        ],
    }
    again = procedure.unstored(rows)
    assert procedure.loaded("p", *again) == P
    with pytest.raises(KeyError):
        procedure.loaded("zzz", *again)
    odd = spark.createDataFrame([("no json",), (None,), ("{}",), ('{"name": "q"}',), ('{"name": "r", "steps": [{"name": "x", "kind": "CODE"}]}',)], "json string")
    limits, steps, edges = procedure.unstored(odd)
    assert sorted(tuple(r) for r in limits.collect()) == [("q", None, 10, 2), ("r", "x", 10, 2)] and steps.count() == 1 and edges.count() == 0
    empty = procedure.stored(limits.where("procedure = 'q'"), steps, edges).first().json
    assert json.loads(empty)["steps"] == []


def test_procedure_columns_and_frames(spark):
    rows = spark.createDataFrame([("a", "refuted"), ("a", "blocked"), ("c", "done"), ("zzz", "done")], "step string, outcome string")
    got = [tuple(r) for r in rows.select(P.kind_of(F.col("step")), P.next_of(F.col("step"), F.col("outcome"))).collect()]
    assert got == [(JUDGMENT, "b"), (JUDGMENT, None), (CODE, None), (None, None)]
    steps, edges = P.steps_frame(spark), P.transitions_frame(spark)
    assert [r.step for r in procedure.terminal_steps(steps, edges).collect()] == ["c"]
    followed = {(r.step, r.outcome): (r.nxt, r.stays_or_next) for r in procedure.follow(rows, edges, "step", "outcome").collect()}
    assert followed[("a", "refuted")] == ("b", "b") and followed[("a", "blocked")] == (None, "a")
    laws = spark.createDataFrame([("other",)], "name string")
    bad = edges.union(spark.createDataFrame([("p", "a", "x", "lost")], edges.schema))
    assert {(r.problem, r.name) for r in procedure.lint(steps.union(steps.where("step = 'c'")), bad, laws).collect()} == {("unknown target", "lost"), ("unknown statute", "law"), ("repeated step", "c")}


# ---------------------------------------------------------------- stalls


@pytest.mark.parametrize(("fps", "threshold"), [("aabb", 2), ("abab", 2), ("a..a", 2), ("aaa", 3), ("", 2), ("...", 2), ("aab.bba", 2), ("a", 1)])
def test_stalls_by_window_and_fold(spark, fps, threshold):
    marks = ["" if x == "." else x for x in fps]
    last, run, want = None, 0, []
    for i, m in enumerate(marks):
        if m:
            run = run + 1 if m == last else 1
            last = m
            if run >= threshold:
                want.append((i, run))
    rows = spark.createDataFrame([("k", i, m) for i, m in enumerate(marks)], "key string, i int, fp string")
    got = stalls.stall_runs(rows, "key", ["i"], "fp", threshold).where("stalled").orderBy("i").collect()
    assert [(r.i, r.run) for r in got] == want
    folded = spark.createDataFrame([(marks,)], "fps array<string>").select(stalls.stall_counts(F.col("fps"), threshold).alias("n")).first().n
    assert folded == len(want)
    first = stalls.first_stalls(rows, "key", ["i"], "fp", threshold).collect()
    assert [(r.i, r.run) for r in first] == want[:1]


# ---------------------------------------------------------------- extensions


def test_extensions(spark):
    law = spark.createDataFrame([("s", (1, "block", "boss"))], "name string, escalation struct<max_violations:int,action:string,escalate_to:string>")
    seen = spark.createDataFrame([(1, "s"), (1, "s"), (2, "s")], "case_id int, statute string")
    assert [tuple(r) for r in extensions.escalations(seen, law).collect()] == [(1, "s", 2, "block", "boss")]
    verdict = "struct<refuted:boolean,confidence:string,blocking:boolean,evidence_refs:array<string>,findings:array<string>>"
    rows = spark.createDataFrame([(1, (True, "high", False, [], ["f"])), (1, (False, "low", False, ["r"], ["f"])), (1, (False, "low", True, [], [])), (2, (False, "medium", False, [], [])), (2, (True, "low", False, [], []))], f"case_id int, verdict {verdict}")
    assert {r.case_id: (r.refuted, r.settled) for r in extensions.panel(rows).collect()} == {1: (True, True), 2: (True, False)}
    v = F.col("verdict")
    got = [tuple(r) for r in rows.select(extensions.confident(v, F.lit("medium")), extensions.confident(v, F.lit(None).cast("string")), extensions.uncited_claims(v), extensions.blocks(v, F.lit(False))).collect()]
    assert got[0] == (True, True, True, False) and got[1] == (False, True, False, False) and got[3] == (True, True, False, False)
