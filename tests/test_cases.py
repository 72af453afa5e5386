import json

import pytest
from pyspark.sql import functions as F

from assize.operators.adjudicate import Rules, Statute, adjudicate, adjudicate_live, opened, prompt_of, with_case_ids
from assize.operators.procedure import CODE, JUDGMENT, Procedure, Step, set_key
from assize.sources.judges import process_judge, scripted_judge

#: Whatever the first look says goes on to the weighing, which files or sends back; a block at the first look starts it anew, at the
#: weighing it has no edge.
WATCH = Procedure(
    "watch",
    (
        Step("sight", JUDGMENT, ("level",), {"not_refuted": "weigh", "refuted": "weigh", "blocked": "sight"}),
        Step("weigh", JUDGMENT, ("level",), {"not_refuted": "filed", "refuted": "sight"}),
        Step("filed", CODE),
    ),
    max_rounds=5,
)
LEVEL = Statute("level", "no heat", ("content",))
RULES = Rules(WATCH, (LEVEL,))


def said(refuted, source="content", snippet="hello", detail=None, blocking="none", reasoning="why"):
    return json.dumps({"refuted": refuted, "blocking": blocking, "evidence_refs": [{"source": source, "snippet": snippet}] if source else [], "findings": [{"kind": "k", "location": "l", "detail": detail}] if detail else [], "reasoning": reasoning})


def hear(spark, rules, scripts, data=None):
    cases = spark.createDataFrame([(k, data or {"content": "hello world"}) for k in scripts], "case_id string, data map<string,string>")
    lines = [(k, i, r) for k, rs in scripts.items() for i, r in enumerate(rs)]
    rows = adjudicate(cases, spark.createDataFrame(lines, "case_id string, call_idx int, raw string"), rules)
    return {r.case_id: r for r in rows.collect()}


def test_kinds_of_answers(spark):
    got = hear(spark, RULES, {
        "clean": [said(False)] * 2, "sent back": [said(True, detail="a"), said(True, detail="b"), said(False), said(False)], "mild": [said(True, detail="a"), said(False)], "stalled": [said(True, detail="a")] * 2,
        "default": [], "uncited": [said(False, None)], "wrong source": [said(False, "other")], "untrue": [said(False, snippet="never said"), said(False)], "blocked": [said(True), said(True, blocking="contradiction")],
        "prose": ["prose"], "token": ["Not Refuted"],
    })
    assert {k: (r.final_disposition, r.round_count, r.n_verdicts) for k, r in got.items()} == {
        "clean": ("filed", 3, 2), "sent back": ("filed", 5, 4), "mild": ("filed", 3, 2), "stalled": ("stalled", 2, 2), "untrue": ("filed", 3, 2), "blocked": ("blocked", 2, 2),
        **{k: ("max_rounds", 5, 5) for k in ("default", "uncited", "wrong source", "prose", "token")},
    }
    assert got["stalled"].reason == "Same gap fingerprint appeared 2 consecutive times"
    assert got["clean"].reason == "Procedure ended at terminal step 'filed'" and got["clean"].step_history == ["sight", "weigh", "filed"]
    assert got["uncited"].verdicts[0].fallback_note == "Evidence insufficient: no evidence refs provided" and got["uncited"].verdicts[0].blocking
    assert got["untrue"].verdicts[0].refuted and not got["untrue"].verdicts[0].blocking
    assert [len(r.verdicts) for r in got.values()] == [r.n_verdicts for r in got.values()]


def test_handlers_change_data_and_sources(spark):
    loom = Procedure(
        "loom",
        (
            Step("card", JUDGMENT, ("c",), {"not_refuted": "weave", "refuted": "oil"}),
            Step("oil", CODE, (), {"done": "weave"}, set_key("wool", "oiled wool")),
            Step("weave", JUDGMENT, ("w",), {"not_refuted": "sold", "refuted": "card"}),
            Step("sold", CODE),
            Step("sold", CODE),
        ),
    )
    rules = Rules(loom, (Statute("c", "", ("wool",)), Statute("w", "", ("wool",))))
    script = [said(True, "wool", "raw", "x"), said(False, "wool", "raw"), said(False, "wool", "oiled"), said(False, "wool", "oiled wool")]
    got = hear(spark, rules, {"cloth": script, "early": [said(False, "wool", "oiled")]}, {"wool": "raw"})
    assert (got["cloth"].final_disposition, got["cloth"].round_count, got["cloth"].n_verdicts) == ("sold", 6, 4)
    # Once the wool is oiled, nothing raw can be cited, and before that nothing oiled.
    assert [v.refuted for v in got["cloth"].verdicts] == [True, True, False, False] and got["early"].verdicts[0].refuted


def test_stall_goes_on_behind_clean_rounds_and_cases_are_apart(spark):
    loop = Rules(Procedure("l", (Step("j", JUDGMENT, (), {"not_refuted": "j", "refuted": "j"}),), max_rounds=6))
    a, clean = said(True, None, detail="a"), said(False, None)
    got = hear(spark, loop, {"x": [a, clean, a], "y": [a, said(True, None, detail="b"), a, clean, clean, clean], "passing": [said(False, None, detail="a")] * 2})
    assert (got["x"].final_disposition, got["x"].round_count) == ("stalled", 3)
    assert (got["y"].final_disposition, got["y"].round_count) == ("max_rounds", 6)
    assert (got["passing"].final_disposition, got["passing"].round_count) == ("stalled", 2)
    assert got["y"].reason == "Procedure did not converge within 6 rounds"


def test_final_verdicts_without_edges(spark):
    end = Rules(Procedure("e", (Step("j", JUDGMENT),)))
    got = hear(spark, end, {"ok": [said(False, None)], "no": [said(True, None)], "block": [said(True, None, blocking="unverifiable")], "odd": [said(False, None, blocking="contradiction")]})
    assert {k: r.final_disposition for k, r in got.items()} == {"ok": "approved", "no": "rejected", "block": "blocked", "odd": "approved"}
    assert got["odd"].blocking_approved and not got["ok"].blocking_approved and got["ok"].reason == "why"


@pytest.mark.parametrize(("rounds", "want"), [(0, ("max_rounds", 0)), (1, ("max_rounds", 1)), (2, ("max_rounds", 2)), (3, ("filed", 3)), (None, ("filed", 3))])
def test_round_cap(spark, rounds, want):
    got = hear(spark, Rules(WATCH, (LEVEL,), max_rounds=rounds), {"c": [said(False)] * 2})["c"]
    assert (got.final_disposition, got.round_count) == want


def test_default_to_reject_off_and_unknown_statutes(spark):
    lax = Rules(WATCH, (Statute("level", "", ("content",), default_to_reject=False),))
    assert hear(spark, lax, {"c": [said(False, snippet="never said")] * 2})["c"].step_history == ["sight", "weigh", "filed"]
    assert hear(spark, Rules(WATCH), {"c": [said(False, "other", "never said")] * 2})["c"].final_disposition == "filed"


def test_code_step_ends_without_a_done_edge(spark):
    odd = Rules(Procedure("o", (Step("c", CODE, (), {"other": "c"}),)))
    got = hear(spark, odd, {"x": []})["x"]
    assert (got.final_disposition, got.round_count, got.n_verdicts) == ("c", 1, 0)


def test_live_judge_agrees_with_the_script_and_none_blocks(spark):
    cases = spark.createDataFrame([("good", {"content": "hello world"}), ("bad", {"content": "hello EVIL"})], "case_id string, data map<string,string>")

    def judge(prompts):
        return ['{"refuted": %s, "evidence_refs": [{"source": "content", "snippet": "hello"}]}' % ("true" if "EVIL" in p else "false") for p in prompts]

    got = {r.case_id: (r.final_disposition, r.round_count, r.n_verdicts) for r in adjudicate_live(cases, RULES, judge).collect()}
    assert got == {"good": ("filed", 3, 2), "bad": ("max_rounds", 5, 5)}
    none = adjudicate_live(cases, RULES, None).collect()
    assert {(r.final_disposition, r.verdicts[0].finding) for r in none} == {("max_rounds", "no_llm")}


def test_prompt(spark):
    rows = spark.createDataFrame([({"objective": "do it", "content": "x" * 3000},), ({"content": "c"},)], "data map<string,string>")
    rules = Rules(WATCH, (Statute("level", "no heat", ("content",), True, (("taunt", "grave", "taunts"),)),))
    long, short = (r.p for r in rows.select(prompt_of(rules, opened(rules, F.col("data")), ("objective",)).alias("p")).collect())
    assert "## OBJECTIVE\ndo it\n\n## CASE DATA\n### objective\ndo it\n\n### content\n" + "x" * 2000 + "\n... (truncated)\n" in long
    assert "## OBJECTIVE\n(no objective specified)" in short and "PRIOR GAPS" not in short
    assert "### level: no heat\nRequired evidence: content\nViolations to check:\n  - taunt (grave): taunts\nDefault to reject: True\n\n## RULES" in short
    assert short.endswith("Refuted\nNot Refuted")


def test_no_procedure_and_no_ids(spark):
    cases = with_case_ids(spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},), ({},)], "data map<string,string>"))
    rows = adjudicate(cases, None, None).collect()
    assert {(r.final_disposition, r.reason, r.round_count) for r in rows} == {("rejected", "No procedure defined", 0)}
    ids = [r.case_id for r in rows]
    assert ids[0] == ids[1] != ids[2] and all(len(i) == 12 for i in ids)


def test_judges():
    assert process_judge(["cat"])([" Refuted\n", "x"]) == ["Refuted", "x"]
    assert scripted_judge({"a": "Refuted"}, "Not Refuted")(["a", "b"]) == ["Refuted", "Not Refuted"]


def test_chat_judge(monkeypatch):
    """A service on this machine: what is sent, what comes back, a missing answer, a refusal."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from assize.sources.judges import chat_judge

    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = body["messages"][0]["content"]
            seen.append((self.headers.get("Authorization"), body["model"], body["temperature"], prompt))
            self.send_response(500 if prompt == "fail" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": None if prompt == "nothing" else prompt.upper()}}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("SOME_KEY", "k")
    ask = chat_judge(f"http://127.0.0.1:{server.server_port}", "m", "SOME_KEY")
    assert ask(["a", "nothing", "é"]) == ["A", "", "É"] and ask([]) == []
    assert sorted(seen) == [("Bearer k", "m", 0.1, p) for p in ("a", "nothing", "é")]
    with pytest.raises(Exception, match="500"):
        ask(["fail"])
    server.shutdown()
