"""Registered queries over stored procedures, ledgers, variant data, sources that change, and panels, with their SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assize.functions.casedata import case_data, set_text, shown, texts
from assize.operators import catalog, citations
from assize.operators.hearings import Options, docket, hear
from assize.operators.ledger import Judge, Ledger
from assize.operators.procedure import CODE, JUDGMENT, LIMITS, STEP, TRANSITION
from assize.sources.shared import shared_folder
from assize.sources.tables import table

c = F.col


def _result(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("case_id", "final_disposition", "reason", c("round_count").cast("long").alias("round_count"), c("n_verdicts").cast("long").alias("n_verdicts"), F.array_join("step_history", ">").alias("steps"), *more)


def _statutes(spark: SparkSession, *laws: dict) -> DataFrame:
    rows = spark.createDataFrame([(i, json.dumps(law)) for i, law in enumerate(laws)], "ord int, json string")
    return catalog.statutes_from_json(rows)


def _frames(spark: SparkSession, name: str, steps: list[tuple[str, str, list[str], dict[str, str]]], rounds: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    limits = spark.createDataFrame([(name, steps[0][0], rounds, threshold)], LIMITS)
    listed = spark.createDataFrame([(name, s, i, kind, laws) for i, (s, kind, laws, _) in enumerate(steps)], STEP)
    return limits, listed, spark.createDataFrame([(name, s, o, n) for s, _, _, edges in steps for o, n in edges.items()], TRANSITION)


def _text_map(**fields) -> F.Column:
    return F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v.cast("variant"))))


def _answer(refuted: bool, source: str, snippet: str, detail: str | None, sure: str = "medium", blocking: str = "none") -> str:
    found = [] if detail is None else [{"kind": "gap", "location": "t", "detail": detail}]
    return json.dumps({"refuted": refuted, "confidence": sure, "blocking": blocking, "evidence_refs": [{"source": source, "snippet": snippet}], "findings": found, "reasoning": "read"})


# ---------------------------------------------------------------- a ledger of answers

_INTAKE = [
    ("terms", JUDGMENT, ["terms_law"], {"not_refuted": "standing", "refuted": "amend", "blocked": "refused"}),
    ("amend", CODE, [], {"done": "terms"}),
    ("standing", JUDGMENT, ["standing_law"], {"not_refuted": "accepted", "refuted": "terms", "blocked": "refused"}),
    ("accepted", CODE, [], {}),
    ("refused", CODE, [], {}),
]


def _clerk(prompts: list[str]) -> list[str]:
    """Priority, status and the gaps told so far decide."""
    out = []
    for p in prompts:
        priority, status = re.search("### priority\n(.*)", p)[1], re.search("### status\n(.*)", p)[1]
        n, gaps = int(priority[0]), len(re.findall(r"^- \[gap\]", p, re.M))
        if "### terms_law:" in p:
            refuted = (n + gaps) % 2 == 1
            out.append(_answer(refuted, "priority", priority, ("p5" if n == 5 else f"g{gaps}") if refuted else None))
        else:
            clash = status == "O" and n == 2
            refuted = clash or status == "P" and gaps < 2
            out.append(_answer(refuted, "status", "zzz" if n == 4 else status, f"s{gaps}" if refuted else None, blocking="contradiction" if clash else "none"))
    return out


def q_adjudicate_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases: they differ in few texts, so few prompts are asked. The orders are heard twice with one ledger: the second
    hearing, whose results these are, asks nothing; `n_asked` is what the ledger holds."""
    limits, steps, edges = _frames(spark, "intake", _INTAKE, 6, 2)
    laws = _statutes(spark, {"name": "terms_law", "description": "Terms are named.", "required_evidence": ["priority"]}, {"name": "standing_law", "description": "The status is told.", "required_evidence": ["status"]})
    cases = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("case_id"), F.lit("intake").alias("procedure"), _text_map(status=c("o_orderstatus"), priority=c("o_orderpriority")).alias("data"))
    ledger, judge = Ledger(spark, shared_folder(spark)), Judge("clerk", _clerk)
    heard = lambda: hear(cases, docket(limits, steps, edges, laws), [judge], ledger=ledger, updates={"amend": set_text("note", "amended")})
    heard()
    asked = ledger.size()
    rows = heard()
    return _result(rows, F.lit(asked + 1_000_000 * (ledger.size() - asked)).cast("long").alias("n_asked"))


_LEDGER_SQL = """
WITH RECURSIVE edges(cur, outcome, nxt) AS (VALUES ('terms', 'not_refuted', 'standing'), ('terms', 'refuted', 'amend'), ('terms', 'blocked', 'refused'), ('amend', 'done', 'terms'), ('standing', 'not_refuted', 'accepted'), ('standing', 'refuted', 'terms'), ('standing', 'blocked', 'refused')),
kinds AS (SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS priority, CAST(o_orderpriority[1:1] AS BIGINT) AS p FROM orders),
state AS (
  SELECT s, priority, p, 'terms' AS step, 0 AS round, 0 AS k, 0 AS gaps, '' AS said, 'none' AS note, '' AS last, 0 AS run, CAST(NULL AS VARCHAR) AS disposition, '' AS reason, '' AS steps FROM kinds
  UNION ALL
  SELECT s, priority, p, coalesce(nxt, step), round + 1, CASE WHEN is_code THEN k ELSE k + 1 END, gaps + CAST(detail <> '' AS INTEGER), said || CASE WHEN detail <> '' THEN ',' || detail ELSE '' END,
    CASE WHEN step = 'amend' THEN 'amended' ELSE note END, CASE WHEN detail <> '' THEN detail ELSE last END, now_run,
    CASE WHEN detail <> '' AND now_run >= 2 THEN 'stalled' WHEN is_code AND nxt IS NULL THEN step END,
    CASE WHEN detail <> '' AND now_run >= 2 THEN 'Same gap fingerprint appeared ' || CAST(now_run AS VARCHAR) || ' consecutive times' WHEN is_code AND nxt IS NULL THEN 'Procedure ended at terminal step ''' || step || '''' ELSE '' END,
    steps || CASE WHEN steps = '' THEN '' ELSE '>' END || step
  FROM (SELECT b.*, e.nxt FROM (SELECT a.*, CASE WHEN detail = '' THEN run WHEN detail = last THEN run + 1 ELSE 1 END AS now_run FROM
      (SELECT t.*, CASE WHEN NOT told THEN '' WHEN step = 'standing' THEN 's' || CAST(gaps AS VARCHAR) WHEN p = 5 THEN 'p5' ELSE 'g' || CAST(gaps AS VARCHAR) END AS detail FROM
        (SELECT *, step IN ('amend', 'accepted', 'refused') AS is_code, step = 'standing' AND s = 'O' AND p = 2 AS clash,
          CASE step WHEN 'terms' THEN (p + gaps) % 2 = 1 WHEN 'standing' THEN (s = 'O' AND p = 2) OR (s = 'P' AND gaps < 2) ELSE false END AS told FROM state WHERE disposition IS NULL AND round < 6) t) a) b
    LEFT JOIN edges e ON e.cur = b.step AND e.outcome = CASE WHEN is_code THEN 'done' WHEN clash THEN 'blocked' WHEN told OR (step = 'standing' AND p = 4) THEN 'refuted' ELSE 'not_refuted' END)),
result AS (SELECT s, priority, coalesce(disposition, 'max_rounds') AS final_disposition, CASE WHEN disposition IS NULL THEN 'Procedure did not converge within 6 rounds' ELSE reason END AS reason, CAST(round AS BIGINT) AS round_count, CAST(k AS BIGINT) AS n_verdicts, steps
  FROM state WHERE disposition IS NOT NULL OR round = 6),
asked AS (SELECT count(*) AS n FROM (SELECT DISTINCT s, priority, step, said, note FROM state WHERE disposition IS NULL AND round < 6 AND step IN ('terms', 'standing')) AS d)
SELECT o_orderkey AS case_id, final_disposition, reason, round_count, n_verdicts, steps, n AS n_asked FROM orders JOIN result ON o_orderstatus = s AND o_orderpriority = priority CROSS JOIN asked
"""

# ---------------------------------------------------------------- many stored procedures

#: Shapes of a scripted answer, by (user + day * call) mod 5.
_SHAPES = 5


def _user_procedures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A procedure for each user: event types are steps (view and click are CODE), and what follows an event is an edge whose
    outcome goes by the event's id. Events of a high value leave no edge."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("nxt"))
    rows = rows.withColumn("procedure", c("user_id").cast("string")).withColumn("code", c("event_type").isin("view", "click"))
    limits = rows.groupBy("procedure").agg(F.min("event_type").alias("initial_step"), (4 + F.min("user_id") % 3).cast("int").alias("max_rounds")).withColumn("stall_threshold", F.lit(2))
    steps = rows.groupBy("procedure", c("event_type").alias("step")).agg(F.lit(0).alias("ord"), F.when(F.first("code"), CODE).otherwise(JUDGMENT).alias("kind"))
    steps = steps.withColumn("statutes", F.array(F.concat(F.lit("law of "), c("step"))))
    outcome = F.when(c("code"), "done").when(c("event_id") % 3 == 0, "not_refuted").when(c("event_id") % 3 == 1, "refuted").otherwise("blocked")
    edges = rows.where("value < 30 and nxt is not null").groupBy("procedure", c("event_type").alias("cur"), outcome.alias("outcome")).agg(F.max("nxt").alias("nxt"))
    return limits, steps, edges


def q_hear_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's days as cases under the user's own procedure."""
    laws = _statutes(spark, {"name": "law of error", "description": "Errors are noted.", "required_evidence": ["note"]})
    days = table(spark, sf_dir, "events").select("user_id", F.dayofyear("ts").alias("day")).groupBy("user_id", "day").agg(F.count("*").alias("n"))
    note = F.concat(F.lit("day "), c("day").cast("string"), F.lit(" of "), c("user_id").cast("string"))
    cases = days.select((c("user_id") * 1000 + c("day")).alias("case_id"), c("user_id").cast("string").alias("procedure"), _text_map(note=note, events=c("n")).alias("data"))
    calls = days.select("user_id", "day", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("call_idx")).withColumn("shape", (c("user_id") + c("day") * c("call_idx")) % _SHAPES)
    told = lambda d: F.concat(F.lit('{"refuted": true, "evidence_refs": [{"source": "note", "snippet": "day"}], "findings": [{"kind": "gap", "location": "t", "detail": "d'), d.cast("string"), F.lit('"}], "reasoning": "gap"}'))
    raw = F.when(c("shape") == 0, told(F.lit(0))).when(c("shape") == 1, told(c("call_idx") % 2)).when(c("shape") == 2, _answer(False, "note", "day", None)).when(c("shape") == 3, "Refuted").otherwise("prose")
    responses = calls.select((c("user_id") * 1000 + c("day")).alias("case_id"), "call_idx", raw.alias("raw"))
    return _result(hear(cases, docket(*_user_procedures(spark, sf_dir), laws), responses=responses))


_STORED_SQL = """
WITH RECURSIVE r AS (SELECT user_id, event_id, event_type, value, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, event_type IN ('view', 'click') AS code FROM events),
limits AS (SELECT user_id, min(event_type) AS first, 4 + user_id % 3 AS most FROM r GROUP BY user_id),
edges AS (SELECT user_id, event_type AS cur, CASE WHEN code THEN 'done' WHEN event_id % 3 = 0 THEN 'not_refuted' WHEN event_id % 3 = 1 THEN 'refuted' ELSE 'blocked' END AS outcome, max(nxt) AS nxt FROM r WHERE value < 30 AND nxt IS NOT NULL GROUP BY ALL),
state AS (
  SELECT user_id, day, first AS step, most, 0 AS round, 0 AS k, '' AS last, 0 AS run, CAST(NULL AS VARCHAR) AS disposition, '' AS reason, '' AS steps FROM (SELECT DISTINCT user_id, dayofyear(ts) AS day FROM events) AS d JOIN limits USING (user_id)
  UNION ALL
  SELECT user_id, day, coalesce(nxt, step), most, round + 1, CASE WHEN code THEN k ELSE k + 1 END, CASE WHEN detail <> '' THEN detail ELSE last END, now_run,
    CASE WHEN detail <> '' AND now_run >= 2 THEN 'stalled' WHEN nxt IS NOT NULL THEN NULL WHEN code THEN step WHEN NOT refuted THEN 'approved' WHEN blocking THEN 'blocked' ELSE 'rejected' END,
    CASE WHEN detail <> '' AND now_run >= 2 THEN 'Same gap fingerprint appeared ' || CAST(now_run AS VARCHAR) || ' consecutive times' WHEN nxt IS NOT NULL THEN '' WHEN code THEN 'Procedure ended at terminal step ''' || step || '''' WHEN shape <= 1 THEN 'gap' WHEN shape = 2 THEN 'read' ELSE '' END,
    steps || CASE WHEN steps = '' THEN '' ELSE '>' END || step
  FROM (SELECT b.*, e.nxt FROM (SELECT a.*, CASE WHEN detail = '' THEN run WHEN detail = last THEN run + 1 ELSE 1 END AS now_run, shape = 4 OR (shape = 3 AND step = 'error') AS blocking, shape <> 2 AS refuted FROM
      (SELECT t.*, CASE WHEN code OR shape > 1 THEN '' WHEN shape = 0 THEN 'd0' ELSE 'd' || CAST(k % 2 AS VARCHAR) END AS detail FROM
        (SELECT *, step IN ('view', 'click') AS code, (user_id + day * k) % 5 AS shape FROM state WHERE disposition IS NULL AND round < most) t) a) b
    LEFT JOIN edges e ON e.user_id = b.user_id AND e.cur = b.step AND e.outcome = CASE WHEN code THEN 'done' WHEN blocking THEN 'blocked' WHEN refuted THEN 'refuted' ELSE 'not_refuted' END))
SELECT user_id * 1000 + day AS case_id, coalesce(disposition, 'max_rounds') AS final_disposition, CASE WHEN disposition IS NULL THEN 'Procedure did not converge within ' || CAST(most AS VARCHAR) || ' rounds' ELSE reason END AS reason,
  CAST(round AS BIGINT) AS round_count, CAST(k AS BIGINT) AS n_verdicts, steps FROM state WHERE disposition IS NOT NULL OR round = most
"""

# ---------------------------------------------------------------- data of any type, sources that change


def q_variant_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as case data: texts are sources, everything else is only shown."""
    field = F.struct(c("event_type").alias("type"), F.parse_json("props").alias("props"), "value", (c("value") > 50).alias("large"), F.when(c("event_id") % 2 == 0, c("event_id")).alias("even"))
    rows = table(spark, sf_dir, "events").select("event_id", case_data(F.to_variant_object(field)).alias("data"))
    lines = F.transform(shown(c("data"), ("type",)), lambda f: F.concat(f["name"], F.lit("="), f["value"]))
    return rows.select("event_id", F.to_json(texts(c("data"))).alias("sources"), F.array_join(lines, "\n").alias("fields"))


def q_sources_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases are users, their sources event types; an event replaces its type's content, and every third one cites the props of a
    type: what its content was by then decides."""
    rows = table(spark, sf_dir, "events").select(c("user_id").alias("case_id"), "event_id", "event_type", "props")
    sources = rows.select("case_id", c("event_id").alias("round"), c("event_type").alias("source"), c("props").alias("content"))
    refs = rows.where("event_id % 3 = 0").select("case_id", c("event_id").alias("round"), F.when(c("event_id") % 2 == 0, "view").otherwise("error").alias("source"), F.substring("props", 1, 7).alias("snippet"))
    return citations.verify_as_of(refs, sources).select("case_id", "round", "source", "snippet", "verified")


def q_hear_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns arrive one a round as its `content`; each answer cites the first word of the turn that came, the answers
    of odd conversations that of the first turn."""
    limits, steps, edges = _frames(spark, "watch", [("read", JUDGMENT, ["cites"], {"not_refuted": "read", "refuted": "mend"}), ("mend", JUDGMENT, ["cites"], {"not_refuted": "read"})], 4, 99)
    laws = _statutes(spark, {"name": "cites", "description": "Cites the newest content.", "required_evidence": ["content"]})
    turns = table(spark, sf_dir, "conversations").select(c("conv_id").alias("case_id"), "turn", "text", F.regexp_extract("text", "[A-Za-z]+", 0).alias("word"))
    first = turns.where("turn = 0").select("case_id", c("word").alias("first_word"))
    cases = first.select("case_id", F.lit("watch").alias("procedure"), F.create_map().cast("map<string,variant>").alias("data"))
    word = F.when(c("case_id") % 2 == 1, c("first_word")).otherwise(c("word"))
    raw = F.concat(F.lit('{"refuted": false, "evidence_refs": [{"source": "content", "snippet": "'), word, F.lit('"}], "reasoning": "seen"}'))
    responses = turns.join(first, "case_id").select("case_id", c("turn").cast("int").alias("call_idx"), raw.alias("raw"))
    arrivals = turns.select("case_id", (c("turn") + 1).alias("round"), F.lit("content").alias("source"), c("text").alias("content"))
    return _result(hear(cases, docket(limits, steps, edges, laws), responses=responses, arrivals=arrivals))


_ARRIVALS_SQL = """
WITH RECURSIVE t AS (SELECT conv_id AS case_id, turn, text, regexp_extract(text, '[A-Za-z]+', 0) AS word FROM conversations),
calls AS (SELECT f.case_id, i, n.text IS NULL AS past, (SELECT arg_max(x.text, x.turn) FROM t x WHERE x.case_id = f.case_id AND x.turn <= i) AS content, CASE WHEN f.case_id % 2 = 1 THEN f.word ELSE n.word END AS word
  FROM t f CROSS JOIN range(0, 4) r(i) LEFT JOIN t n ON n.case_id = f.case_id AND n.turn = i WHERE f.turn = 0),
v AS (SELECT case_id, i, past, past OR word = '' AS blocking, past OR word = '' OR NOT contains(content, word) AS refuted FROM calls),
state AS (SELECT case_id, 'read' AS step, 0 AS k, CAST(NULL AS VARCHAR) AS disposition, '' AS reason, '' AS steps FROM t WHERE turn = 0
  UNION ALL
  SELECT s.case_id, CASE WHEN blocking THEN step WHEN refuted AND step = 'read' THEN 'mend' WHEN NOT refuted THEN 'read' ELSE step END, k + 1,
    CASE WHEN blocking THEN 'blocked' WHEN refuted AND step = 'mend' THEN 'rejected' END, CASE WHEN blocking OR (refuted AND step = 'mend') THEN CASE WHEN past THEN 'Mock default — all checks passed.' ELSE 'seen' END ELSE '' END,
    steps || CASE WHEN steps = '' THEN '' ELSE '>' END || step
  FROM state s JOIN v ON v.case_id = s.case_id AND v.i = s.k WHERE disposition IS NULL AND k < 4)
SELECT case_id, coalesce(disposition, 'max_rounds') AS final_disposition, CASE WHEN disposition IS NULL THEN 'Procedure did not converge within 4 rounds' ELSE reason END AS reason, CAST(k AS BIGINT) AS round_count, CAST(k AS BIGINT) AS n_verdicts, steps
FROM state WHERE disposition IS NOT NULL OR k = 4
"""

# ---------------------------------------------------------------- panels and declared rules


def _member(number: int):
    """Three judges: the first may be sure, the second is never, the third may block."""

    def ask(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            word = re.search("[A-Za-z]*", re.search("### content\n[^A-Za-z]*(.*)", p, re.S)[1])[0]
            n, gaps = len(word), len(re.findall(r"^- \[gap\]", p, re.M))
            refuted, sure = ((n % 4 == 0, "high" if n % 4 == 0 else "medium"), ((n + gaps) % 2 == 1, "low"), (n % 3 == 0, "medium"))[number]
            out.append(_answer(refuted, "content", word, f"{number}:{gaps}" if refuted else None, sure, "contradiction" if number == 2 and n % 9 == 0 else "none"))
        return out

    return Judge(f"member {number}", ask)


def q_hear_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three judges a round, until one is decisive; the law asks for some confidence, and may not block."""
    limits, steps, edges = _frames(spark, "bench", [("sit", JUDGMENT, ["weighty"], {"not_refuted": "granted", "refuted": "sit", "blocked": "barred"}), ("granted", CODE, [], {}), ("barred", CODE, [], {})], 3, 99)
    laws = _statutes(spark, {"name": "weighty", "description": "Weighs.", "threshold": {"confidence_min": "medium"}, "blocking": False})
    cases = table(spark, sf_dir, "conversations").where("turn = 0").select(c("conv_id").alias("case_id"), F.lit("bench").alias("procedure"), _text_map(content=c("text")).alias("data"))
    rows = hear(cases, docket(limits, steps, edges, laws), [_member(i) for i in range(3)], options=Options(confidence=True, statute_blocking=True, uncited=0, packet=True))
    return _result(rows, c("n_calls").cast("long").alias("n_calls"))


_PANEL_SQL = """
WITH RECURSIVE word AS (SELECT conv_id AS case_id, length(regexp_extract(text, '[A-Za-z]+', 0)) AS n FROM conversations WHERE turn = 0),
state AS (SELECT case_id, n, 0 AS round, 0 AS calls, 0 AS verdicts, 0 AS gaps, 'sit' AS step, '' AS steps, CAST(NULL AS VARCHAR) AS disposition FROM word
  UNION ALL
  SELECT case_id, n, round + 1, calls + CASE WHEN step <> 'sit' THEN 0 WHEN sure THEN 1 ELSE 3 END, verdicts + CAST(step = 'sit' AS INTEGER), gaps + CASE WHEN step = 'sit' AND told THEN 1 ELSE 0 END,
    CASE WHEN step = 'sit' AND NOT refuted THEN 'granted' ELSE step END, steps || CASE WHEN steps = '' THEN '' ELSE '>' END || step, CASE WHEN step <> 'sit' THEN step END
  FROM (SELECT *, told OR low OR n = 0 AS refuted FROM (SELECT *, CASE WHEN sure THEN true ELSE CAST(b AS INTEGER) + CAST(d AS INTEGER) >= 2 END AS told,
      NOT sure AND b AND d AS low FROM (SELECT *, n % 4 = 0 AS sure, (n + gaps) % 2 = 1 AS b, n % 3 = 0 AS d FROM state WHERE disposition IS NULL AND round < 3) x) y) z)
SELECT case_id, coalesce(disposition, 'max_rounds') AS final_disposition, CASE WHEN disposition IS NULL THEN 'Procedure did not converge within 3 rounds' ELSE 'Procedure ended at terminal step ''' || step || '''' END AS reason,
  CAST(round AS BIGINT) AS round_count, CAST(verdicts AS BIGINT) AS n_verdicts, steps, CAST(calls AS BIGINT) AS n_calls FROM state WHERE disposition IS NOT NULL OR round = 3
"""

QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}
ORACLE_SQL = {
    "q_adjudicate_ledger": _LEDGER_SQL,
    "q_hear_stored": _STORED_SQL,
    "q_hear_arrivals": _ARRIVALS_SQL,
    "q_hear_panel": _PANEL_SQL,
    "q_variant_data": """SELECT event_id, '{"type":"' || event_type || '"}' AS sources, 'type=' || event_type || CASE WHEN event_id % 2 = 0 THEN chr(10) || 'even=' || CAST(event_id AS VARCHAR) ELSE chr(10) || 'even=None' END || chr(10) || 'large=' || CASE WHEN value > 50 THEN 'True' ELSE 'False' END
      || chr(10) || 'props=' || replace(props, '"', '''') || chr(10) || 'value=' || CAST(value AS VARCHAR) AS fields FROM events""",
    "q_sources_as_of": """SELECT r.user_id AS case_id, r.event_id AS round, r.source, r.snippet, coalesce(contains(s.props, r.snippet), false) AS verified
      FROM (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'view' ELSE 'error' END AS source, substr(props, 1, 7) AS snippet FROM events WHERE event_id % 3 = 0) AS r
      ASOF LEFT JOIN events AS s ON r.user_id = s.user_id AND r.source = s.event_type AND r.event_id >= s.event_id""",
}
