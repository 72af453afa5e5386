"""Hearings over stored procedures, ledgers, data of any type and scans in blocks, against plain Python and the fold."""

import random

import pytest
from pyspark.sql import functions as F

from assize.functions.casedata import case_data, same_as, set_text, shown, texts
from assize.jobs import hearings as jobs
from assize.jobs.queries import DESK, DESK_RULES
from assize.operators import catalog, citations, hearings, scans, stalls
from assize.operators.adjudicate import adjudicate
from assize.operators.hearings import Options, docket, hear, with_step
from assize.operators.ledger import Judge, Ledger
from assize.operators.procedure import CODE, JUDGMENT

LAWS = [{"name": "sourced", "description": "d", "required_evidence": ["content"]}, {"name": "measured", "required_evidence": ["content"]}]


@pytest.fixture(scope="module")
def desk(spark):
    return docket(DESK.limits_frame(spark), DESK.steps_frame(spark), DESK.transitions_frame(spark), jobs._statutes(spark, *LAWS)).cache()


def cases(spark, rows):
    return spark.createDataFrame(rows, "case_id bigint, procedure string, j string").select("case_id", "procedure", F.parse_json("j").alias("data"))


def brief(rows):
    return sorted((r.case_id, r.final_disposition, r.reason, r.round_count, r.n_verdicts, tuple(r.step_history)) for r in rows.collect())


def test_equals_the_fold(spark, desk):
    """One stored procedure gives what the compiled one gives, on every kind of answer."""
    rng = random.Random(2)
    ref = '"evidence_refs": [{"source": "content", "snippet": "%s"}]'
    said = [
        "Refuted", "Not Refuted", "prose", '{"refuted": false, %s}' % (ref % "some"), '{"refuted": false, %s}' % (ref % "lie"), '{"refuted": true, "findings": [{"kind": "a"}], %s}' % (ref % "some"),
        '{"refuted": true, "findings": [{"kind": "b"}], %s}' % (ref % "text"), '{"refuted": true, "blocking": "contradiction", "reasoning": "x", %s}' % (ref % "some"),
    ]
    answers = [(i, k, rng.choice(said)) for i in range(120) for k in range(rng.randint(0, 5))]
    responses = spark.createDataFrame(answers, "case_id bigint, call_idx int, raw string")
    plain = spark.createDataFrame([(i, {"content": "some text"}) for i in range(120)], "case_id bigint, data map<string,string>")
    want = brief(adjudicate(plain, responses, DESK_RULES))
    got = hear(cases(spark, [(i, "desk", '{"content": "some text"}') for i in range(120)]), desk, responses=responses)
    assert brief(got) == want


def counted(spark):
    """A judge that counts its prompts in an accumulator."""
    asked = spark.sparkContext.accumulator(0)

    def ask(prompts):
        asked.add(len(prompts))
        return ['{"refuted": true, "findings": [{"kind": "k%d"}], "evidence_refs": [{"source": "content", "snippet": "t"}]}' % p.count("- [k") for p in prompts]

    return Judge("counted", ask), asked


def test_ledger_asks_once_and_goes_on(spark, desk, tmp_path):
    """Three texts in sixty cases; a hearing that dies after its second round asks the rest only when it runs again."""
    rows = cases(spark, [(i, "desk", '{"content": "t%d"}' % (i % 3)) for i in range(60)])
    judge, asked = counted(spark)
    ledger = Ledger(spark, (tmp_path / "answers").as_uri())

    class Died(Exception):
        pass

    def dies(number):
        if number == 2:
            raise Died

    with pytest.raises(Died):
        hear(rows, desk, [judge], ledger=ledger, after_round=dies)
    assert asked.value == 6 and ledger.size() == 6
    first = brief(hear(rows, desk, [judge], ledger=ledger))
    assert asked.value == 15 and {r[3] for r in first} == {5}
    assert brief(hear(rows, desk, [judge], ledger=ledger)) == first and asked.value == 15
    other, more = counted(spark)
    hear(rows, desk, [Judge("another name", other.ask)], ledger=ledger)
    assert more.value == 15 and ledger.size() == 30


def test_equal_cases_are_heard_as_one(spark, desk, tmp_path, monkeypatch):
    """Rounds see each data once, and every case gets its results: as from a hearing that takes each case by itself."""
    texts_of = [None, '{"content": "t1"}', '{"content": "t2", "n": 1}', '{"content": "t2", "n": "1"}', '{"content": 3, "l": [1, "x"]}']
    rows = cases(spark, [(i, "desk" if i % 7 else None, texts_of[i % 5]) for i in range(70)])
    judge, asked = counted(spark)
    want = brief(hear(rows, desk, [judge]))
    alone, rounds = asked.value, []

    class Seen(hearings.Kept):
        def __init__(self, df):
            super().__init__(df)
            if {"round", "disposition"} <= {*df.columns}:
                rounds.append(self.read().count())

    monkeypatch.setattr(hearings, "Kept", Seen)
    got = brief(hear(rows, desk, [judge], ledger=Ledger(spark, (tmp_path / "answers").as_uri())))
    assert got == want and len(got) == 70
    # Four data, and the 12 cases with a mixed list, which are equal to none.
    assert max(rounds) == 16 and asked.value - alone < alone


def test_equal_data(spark):
    """Equal are data of equal names, types and values; what can't be told for certain is equal to nothing."""
    made = ['{"a": 1}', '{"a": "1"}', '{"a": 1.0}', '{"a": null}', '{"a": "null"}', "{}", '{"a": true}', '{"a": "true"}', '{"a": "1", "b": "2"}', '{"a": "1\\", \\"b\\": \\"2"}', '{"a": [1, 2]}', '{"a": "[1,2]"}', '{"a": {"b": 1}}']
    mixed = ['{"a": [1, "x"]}', '{"a": [1, 1.5]}', '{"a": {"b": [true, {}]}}']
    rows = spark.createDataFrame([(i, j) for i, j in enumerate((made + mixed) * 2)], "i int, j string")
    key = lambda p: same_as(case_data(F.parse_json("j")), F.lit(p), F.col("i"))
    got = [r.k for r in rows.select("i", key("p").alias("k")).orderBy("i").collect()]
    n = len(made)
    assert got[:n] == got[n + 3 : 2 * n + 3] and len({*got}) == n + 6
    assert not {*got} & {r.k for r in rows.select(key("q").alias("k")).collect()}
    days = spark.sql("select 1 i, map('a', cast(date'2020-01-01' as variant)) d union all select 1, map('a', cast('2020-01-01' as variant)) union all select 1, map('a', cast(null as variant)) union all select 1, map('a', parse_json('null'))")
    assert len({r.k for r in days.select(same_as(F.col("d"), F.lit("p"), F.col("i")).alias("k")).collect()}) == 4


def test_ledger_keeps_finished_tasks(spark, tmp_path):
    """Answers of tasks that finished stay when the job fails."""
    ledger = Ledger(spark, (tmp_path / "answers").as_uri())
    prompts = spark.createDataFrame([(f"p{i}",) for i in range(40)] + [("bad",)], "prompt string")

    def ask(said):
        if "bad" in said:
            import time

            time.sleep(3)
            raise ValueError("no answer")
        return ["Refuted"] * len(said)

    with pytest.raises(Exception, match="no answer"):
        ledger.ask(prompts, Judge("j", ask))
    kept = ledger.size()
    assert 0 < kept < 41
    ledger.ask(prompts.where("prompt <> 'bad'"), Judge("j", ask))
    assert ledger.size() == 40


def test_many_procedures(spark):
    """Each case runs under its own; of steps with one name the last counts, unknown statutes are dropped."""
    limits = spark.createDataFrame([("a", "s", 3, 2), ("b", "s", 2, 2), ("z", "s", 0, 2)], "procedure string, initial_step string, max_rounds int, stall_threshold int")
    steps = spark.createDataFrame(
        [("a", "s", 0, JUDGMENT, ["no such law"]), ("a", "t", 1, JUDGMENT, []), ("a", "t", 2, CODE, []), ("b", "s", 0, CODE, []), ("b", "u", 1, CODE, []), ("z", "s", 0, CODE, [])], "procedure string, step string, ord int, kind string, statutes array<string>"
    )
    edges = spark.createDataFrame([("a", "s", "refuted", "t"), ("b", "s", "done", "s")], "procedure string, cur string, outcome string, nxt string")
    law = docket(limits, steps, edges, jobs._statutes(spark))
    responses = spark.createDataFrame([(1, 0, "Refuted"), (2, 0, "Refuted"), (4, 0, "Not Refuted")], "case_id bigint, call_idx int, raw string")
    got = brief(hear(cases(spark, [(1, "a", None), (2, "b", "{}"), (3, None, "[1]"), (4, "a", "{}"), (5, "z", "{}")]), law, responses=responses))
    assert got == [
        (1, "t", "Procedure ended at terminal step 't'", 2, 1, ("s", "t")), (2, "max_rounds", "Procedure did not converge within 2 rounds", 2, 0, ("s", "s")),
        (3, "rejected", "No procedure defined", 0, 0, ()), (4, "approved", "", 1, 1, ("s",)), (5, "max_rounds", "Procedure did not converge within 0 rounds", 0, 0, ()),
    ]
    with pytest.raises(Exception, match="no procedure 'c'"):
        hear(cases(spark, [(1, "c", None)]), law, responses=responses).collect()
    with pytest.raises(Exception, match="no step 'x' in procedure 'a'"):
        with_step(spark.createDataFrame([("a", "x")], "procedure string, step string"), law).collect()
    lost = docket(limits, steps, edges.union(spark.createDataFrame([("a", "s", "not_refuted", "gone")], edges.schema)), jobs._statutes(spark))
    with pytest.raises(Exception, match="no step 'gone'"):
        hear(cases(spark, [(4, "a", None)]), lost, responses=responses).collect()
    assert hear(cases(spark, []), law, responses=responses).count() == 0


def test_without_a_judge(spark, desk):
    assert brief(hear(cases(spark, [(1, "desk", None)]), desk)) == [(1, "withheld", "Procedure ended at terminal step 'withheld'", 2, 1, ("facts", "withheld"))]


def test_panel_stops_at_a_decisive_verdict(spark, desk):
    asked = {name: spark.sparkContext.accumulator(0) for name in "xyz"}

    def judge(name, answer):
        def ask(prompts):
            asked[name].add(len(prompts))
            return [answer(p) for p in prompts]

        return Judge(name, ask)

    sure = '{"refuted": true, "confidence": "high", "findings": [{"kind": "k"}], "evidence_refs": [{"source": "content", "snippet": "t"}]}'
    clear = '{"refuted": false, "evidence_refs": [{"source": "content", "snippet": "t"}]}'
    panel = [judge("x", lambda p: sure if "t1" in p else clear), judge("y", lambda p: "Refuted"), judge("z", lambda p: clear)]
    got = hear(cases(spark, [(1, "desk", '{"content": "t1"}'), (2, "desk", '{"content": "t2"}')]), desk, panel).collect()
    by = {r.case_id: r for r in got}
    # The sure judge refutes twice alone and stalls; the others pass two to one, twice.
    assert (by[1].final_disposition, by[1].n_calls) == ("stalled", 2) and (by[2].final_disposition, by[2].n_calls) == ("published", 6)
    assert {k: v.value for k, v in asked.items()} == {"x": 4, "y": 2, "z": 2}


@pytest.mark.parametrize("options, want", [(Options(), "published"), (Options(confidence=True), "stalled"), (Options(uncited=0), "published"), (Options(statute_blocking=True), "published"), (Options(packet=True), "published")])
def test_declared_rules(spark, options, want):
    laws = jobs._statutes(spark, *[law | {"threshold": {"confidence_min": "high"}, "blocking": False} for law in LAWS])
    table = docket(DESK.limits_frame(spark), DESK.steps_frame(spark), DESK.transitions_frame(spark), laws)
    seen = spark.sparkContext.accumulator(0)

    def ask(prompts):
        seen.add(sum("## EVIDENCE\n\n### content\nt" in p for p in prompts))
        return ['{"refuted": false, "confidence": "low", "findings": [{"kind": "k"}], "evidence_refs": [{"source": "content", "snippet": "t"}]}' if "facts" not in p else p for p in prompts]

    (row,) = hear(cases(spark, [(1, "desk", '{"content": "t"}')]), table, [Judge("j", ask)], options=options).collect()
    # The same finding twice is a stall whatever the route: with two passes the second one ends the case.
    assert row.final_disposition == ("stalled" if want == "published" else want)
    assert [v.refuted for v in row.verdicts] == [options.confidence] * 2
    assert (seen.value > 0) == options.packet


def test_updates_and_arrivals(spark):
    limits = spark.createDataFrame([("p", "look", 6, 9)], "procedure string, initial_step string, max_rounds int, stall_threshold int")
    steps = spark.createDataFrame([("p", "look", 0, JUDGMENT, ["law"]), ("p", "fix", 1, CODE, [])], "procedure string, step string, ord int, kind string, statutes array<string>")
    edges = spark.createDataFrame([("p", "look", "refuted", "fix"), ("p", "look", "blocked", "fix"), ("p", "fix", "done", "look")], "procedure string, cur string, outcome string, nxt string")
    law = docket(limits, steps, edges, jobs._statutes(spark, {"name": "law", "required_evidence": ["a"]}))
    cite = lambda s: '{"refuted": false, "evidence_refs": [{"source": "a", "snippet": "%s"}]}' % s
    responses = spark.createDataFrame([(1, 0, cite("old")), (1, 1, cite("mended")), (2, 0, cite("old")), (2, 1, cite("mended")), (2, 2, cite("came"))], "case_id bigint, call_idx int, raw string")
    rows = cases(spark, [(1, "p", '{"a": "new", "n": 3}'), (2, "p", '{"a": "new", "b": [1]}')])
    arrivals = spark.createDataFrame([(2, 3, "a", "it came")], "case_id bigint, round int, source string, content string")
    got = {r.case_id: r for r in hear(rows, law, responses=responses, updates={"fix": set_text("a", "mended")}, arrivals=arrivals).collect()}
    assert (got[1].final_disposition, got[1].round_count) == ("approved", 3)
    # What arrives in round 3 replaces the mended text, which the update restores before round 5.
    assert (got[2].round_count, [v.refuted for v in got[2].verdicts]) == (6, [True, True, True])


def test_shown_data(spark):
    made = '{"b": "text", "a": 1, "t": true, "f": false, "n": null, "l": [1, "x", null, true, {"k": 1.5}], "d": 2.50, "e": 1e3, "o": {"q": "it\'s"}}'
    (row,) = spark.createDataFrame([(made,)], "j string").select(shown(case_data(F.parse_json("j")), ("o", "missing")).alias("s"), texts(case_data(F.parse_json("j"))).alias("t")).collect()
    assert row.t == {"b": "text"}
    assert [(f.name, f.value) for f in row.s] == [
        ("o", "{'q': \"it's\"}"), ("a", "1"), ("b", "text"), ("d", "2.5"), ("e", "1000.0"), ("f", "False"), ("l", "[1, 'x', None, True, {'k': 1.5}]"), ("n", "None"), ("t", "True"),
    ]
    assert spark.createDataFrame([("[1]",), (None,), ("3",)], "j string").select(F.size(case_data(F.parse_json("j"))).alias("n")).collect() == [(0,)] * 3


@pytest.mark.parametrize("block", [1, 4, 37, 10_000])
@pytest.mark.parametrize("one_key", [False, True])
def test_stall_scan(spark, block, one_key):
    """Runs that go over many blocks; a key with all rows is spread over them."""
    rng = random.Random(block)
    rows, at = [], 0
    for _ in range(12):
        fp = rng.choice(["a", "b", "", None, "c"])
        for _ in range(rng.choice([1, 2, 20])):
            at += 1
            rows.append((0 if one_key or rng.random() < 0.6 else rng.choice([1, None]), at, rng.choice([fp, fp, fp, ""])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, at int, fp string").repartition(3)
    got = sorted((r.at, r.run, r.stalled) for r in scans.stall_scan(df, "k", ["at"], "fp", 3, block).collect())
    assert got == sorted((r.at, r.run, r.stalled) for r in stalls.stall_runs(df, "k", ["at"], "fp", 3).collect())
    whole = sorted((r.at, r.run) for r in scans.stall_scan(df, None, ["at"], "fp", 3, block).collect())
    assert whole == sorted((r.at, r.run) for r in stalls.stall_runs(df.withColumn("g", F.lit(1)), "g", ["at"], "fp", 3).collect())


def test_blocks_spread_one_key(spark):
    df = spark.range(10_000).select(F.lit(1).alias("k"), F.col("id").alias("at"), F.lit("x").alias("fp"))
    sizes = [r["count"] for r in scans.in_blocks(df, ["k"], ["at"], 500).groupBy("_block").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 1500


@pytest.mark.parametrize("block", [3, 100_000])
def test_as_of(spark, block, monkeypatch):
    monkeypatch.setattr(scans.carried, "__defaults__", (block,))
    rng = random.Random(7)
    versions = [(rng.choice([1, 1, 1, 2, None]), rng.randint(0, 30), rng.choice("ab"), rng.choice(["xx", "yy", "xy", None])) for _ in range(60)]
    refs = [(rng.choice([1, 1, 2, 3, None]), rng.randint(0, 31), rng.choice("abc"), rng.choice(["x", " y ", "", "xy", None]), i) for i in range(80)]
    got = citations.verify_as_of(spark.createDataFrame(refs, "case_id int, round int, source string, snippet string, n int"), spark.createDataFrame(versions, "case_id int, round int, source string, content string"))
    want = []
    for case, at, source, snippet, n in refs:
        known = [(r, content) for c, r, s, content in versions if case is not None and c == case and s == source and r <= at and content is not None]
        content = max(known)[1] if known else None
        want.append((n, content is not None and bool((snippet or "").strip()) and snippet.strip() in content))
    assert sorted((r.n, r.verified) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("in_plan", [0, 10_000])
def test_contained_whatever_the_number_of_keys(spark, in_plan, monkeypatch):
    monkeypatch.setattr(citations, "KEYS_IN_PLAN", in_plan)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdef") * rng.randint(1, 2) for _ in range(60)) for _ in range(40)]
    snippets = [t[a : a + n] for t in texts[:15] for a, n in [(rng.randint(0, 60), rng.randint(1, 40))]] + ["f e d c b a f e d c b a f"]
    got = citations.contained(spark.createDataFrame(list(enumerate(texts)), "t int, text string"), spark.createDataFrame(list(enumerate(snippets)), "i int, s string"), "t", "text", "i", "s")
    assert sorted(map(tuple, got.collect())) == sorted((t, i) for t, text in enumerate(texts) for i, s in enumerate(snippets) if s in text)


@pytest.mark.parametrize("block", [2, 1000])
def test_contained_without_whole_words(spark, block, monkeypatch):
    """Parts of words and runs of white space, in several blocks, beside snippets with whole words; repeated and empty ones too."""
    monkeypatch.setattr(citations, "KEYLESS", block)
    texts = ["alpha beta  gamma", "betamax alphabet", "", None, "x y z one two three four five six", "gamma\tdelta"]
    snippets = ["a", "a b", "ta  ga", "  ", "\t", "beta", "beta", "max alpha", "", None, "y z one two three four five s", "zzz", "mma"]
    got = citations.contained(spark.createDataFrame(list(enumerate(texts)), "t int, text string"), spark.createDataFrame(list(enumerate(snippets)), "i int, s string"), "t", "text", "i", "s")
    assert sorted(map(tuple, got.collect())) == sorted((t, i) for t, text in enumerate(texts) for i, s in enumerate(snippets) if s and text and s in text)


@pytest.mark.parametrize("block", [3, 1000])
def test_places_without_gaps(spark, block):
    rows = spark.createDataFrame([(i * 7 % 50, str(i)) for i in range(50)], "at int, x string").repartition(4)
    got = {r.x: r.n for r in scans.numbered_in_order(rows, ["at", "x"], "n", block).collect()}
    assert got == {str(i): i * 7 % 50 for i in range(50)}


def test_book_in_parts(spark):
    """Repeated names meet across the parts of a book, and not across books."""
    laws = jobs._statutes(spark, *[{"name": f"n{i % 7}", "description": f"d{i}"} for i in range(20)])
    parts = catalog.book_parts(laws, 6)
    assert parts.count() == 4
    got = [(r.name, r.description) for r in catalog.book_from_json(parts).orderBy("ord").collect()]
    assert got == [(f"n{k}", f"d{max(i for i in range(20) if i % 7 == k)}") for k in range(7)]
    two = catalog.book_json(laws.withColumn("book", F.col("ord") % 2), ("book",))
    names = {(r.book, r.name) for r in catalog.book_from_json(two, by=("book",)).collect()}
    assert names == {(i % 2, f"n{i % 7}") for i in range(20)}


def test_catalog_from_deliveries(spark):
    """Late edits change no newer entry."""
    from assize.streaming.upserts import upserted_in_batches

    rows = lambda *x: spark.createDataFrame(x, "name string, ord bigint, v string")
    parts = [rows(("a", 5, "a5"), ("b", 6, "b6")), rows(("a", 1, "a1"), ("c", 7, "c7")), rows(("b", 9, "b9")), rows(("c", 8, None))]
    got = sorted(map(tuple, upserted_in_batches(parts).collect()), key=str)
    assert got == [("a", 1, "a5"), ("b", 6, "b9"), ("c", 7, None)]
