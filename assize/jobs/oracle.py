"""The queries' SQL, for an independent engine over the same tables."""

from __future__ import annotations

from assize.functions.evidence import PROMPT_HEAD, PROMPT_RULES
from assize.functions.verdicts import REJECT_NOTE, TOKEN_NOTE
from assize.operators.adjudicate import DEFAULT_RESPONSE
from assize.sources.tables import raw_sql


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: raw texts (doc_id, toxic, quality, text, raw), their bodies, tokens and verdict fields.
_V = f"""
WITH raw AS ({raw_sql()}),
b AS (SELECT *, coalesce(nullif(regexp_extract(raw, '(?s)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1), ''), nullif(regexp_extract(raw, '(?s)\\{{.*\\}}', 0), '')) AS body FROM raw),
j AS (SELECT *, CASE WHEN body IS NOT NULL AND json_valid(body) THEN CAST(body AS JSON) END AS j,
  list_filter(list_transform(list_filter(list_transform(string_split(raw, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '```')),
    lambda x: trim(rtrim(trim(x, '`'), '.!'))), lambda x: x IN ('Refuted', 'Not Refuted'))[1] AS tok FROM b),
v AS (SELECT doc_id, toxic, quality, text, raw, body, tok, j,
  CASE WHEN j IS NOT NULL THEN 1 WHEN tok IS NOT NULL THEN 2 ELSE 3 END AS tier,
  CASE WHEN j IS NOT NULL THEN coalesce(j->>'$.finding', '') WHEN tok = 'Refuted' THEN 'unknown' WHEN tok IS NOT NULL THEN 'none' ELSE 'parse_failure' END AS finding,
  CASE WHEN j IS NOT NULL THEN NOT (json_type(j, '$.refuted') = 'BOOLEAN' AND (j->>'$.refuted') = 'false') WHEN tok IS NOT NULL THEN tok = 'Refuted' ELSE true END AS refuted,
  CASE WHEN j IS NULL THEN 'unknown' WHEN lower(trim(j->>'$.confidence')) IN ('high', 'medium', 'low') THEN lower(trim(j->>'$.confidence')) ELSE 'unknown' END AS confidence,
  CASE WHEN j IS NOT NULL AND (j->>'$.blocking') IN ('contradiction', 'unverifiable') THEN (j->>'$.blocking') ELSE 'none' END AS blocking_kind,
  CASE WHEN j IS NOT NULL THEN coalesce(j->>'$.reasoning', '') ELSE '' END AS reasoning,
  CASE WHEN j IS NOT NULL THEN NULL WHEN tok IS NOT NULL THEN {_q(TOKEN_NOTE)} ELSE {_q(REJECT_NOTE)} END AS note,
  CASE WHEN j IS NOT NULL THEN json_array_length(j, '$.evidence_refs') ELSE 0 END AS n_refs,
  j->>'$.evidence_refs[0].source' AS source, j->>'$.evidence_refs[0].snippet' AS snippet,
  CASE WHEN j IS NOT NULL AND trim(j->>'$.findings[0].kind') || trim(j->>'$.findings[0].location') || trim(j->>'$.findings[0].detail') <> '' THEN
    (j->>'$.findings[0].kind') || ':' || (j->>'$.findings[0].location') || ':' || (j->>'$.findings[0].detail') END AS fkey FROM j),
w AS (SELECT *, blocking_kind <> 'none' OR tier = 3 AS blocking,
  CASE WHEN n_refs = 0 THEN 'no evidence refs provided' WHEN source <> 'text' THEN 'required source ''text'' not cited' WHEN trim(snippet) = '' THEN 'evidence from ''' || source || ''' has empty snippet' ELSE '' END AS why,
  n_refs > 0 AND NOT (source = 'text' AND trim(snippet) <> '' AND contains(text, trim(snippet))) AS untrue FROM v)
"""

_FINDINGS = """
WITH f AS (SELECT l_orderkey, l_returnflag = 'N' AND l_linestatus = 'O' AS blank, l_returnflag || ':line:' || CAST(l_linenumber AS VARCHAR) || ':' || l_linestatus AS tok FROM lineitem),
p AS (SELECT l_orderkey, coalesce(substr(sha256(string_agg(tok, '|' ORDER BY tok) FILTER (WHERE NOT blank)), 1, 16), '') AS fp FROM f GROUP BY l_orderkey)
"""

_REFS = """
WITH r AS (SELECT l_orderkey AS o_orderkey, CASE l_returnflag WHEN 'A' THEN 'invoice' WHEN 'R' THEN 'receipt' ELSE 'manifest' END AS source, l_linenumber = 7 AS blank,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos FROM lineitem),
a AS (SELECT o_orderkey, count(*) AS n, bool_or(source = 'invoice') AS i, bool_or(source = 'receipt') AS c, bool_or(source = 'manifest') AS m, arg_min(source, pos) FILTER (WHERE blank) AS first_blank FROM r GROUP BY o_orderkey),
o AS (SELECT orders.o_orderkey, o_orderstatus AS s, orders.o_orderkey % 3 AS least, coalesce(n, 0) AS n, coalesce(i, false) AS i, coalesce(c, false) AS c, coalesce(m, false) AS m, first_blank FROM orders LEFT JOIN a ON orders.o_orderkey = a.o_orderkey)
"""


def _stall(fp: str, threshold: int) -> str:
    return f"""
WITH e AS (SELECT user_id, event_id, ts, {fp} AS fp FROM events),
f AS (SELECT * FROM e WHERE fp <> ''),
g AS (SELECT *, CASE WHEN lag(fp) OVER w IS NOT DISTINCT FROM fp THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g),
k AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM h),
hits AS (SELECT user_id, event_id, ts, CAST(run AS BIGINT) AS run FROM k WHERE run >= {threshold})
"""


_BLANKED = "CASE WHEN event_type = 'view' THEN '' ELSE event_type END"

_BOOK = """
WITH book AS (SELECT n_nationkey AS ord, n_name AS name, CASE WHEN n_regionkey = 0 THEN '' ELSE 'rule of ' || r_name END AS description, CASE WHEN n_regionkey = 0 THEN '' ELSE r_name END AS required_evidence,
  n_regionkey = 0 OR n_nationkey % 2 = 0 AS default_to_reject FROM nation JOIN region ON n_regionkey = r_regionkey)
"""

_GRAPH = """
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS procedure, event_type, value, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
steps AS (SELECT DISTINCT procedure, event_type AS step FROM r WHERE value < 60),
edges AS (SELECT DISTINCT procedure, event_type AS cur, nxt AS outcome, nxt FROM r WHERE value < 5 AND nxt IS NOT NULL)
"""

_SAID = f"""
first AS (SELECT conv_id, text AS content, regexp_extract(text, '[A-Za-z]+', 0) AS word FROM conversations WHERE turn = 0),
said AS (SELECT c.conv_id AS case_id, CAST(turn AS BIGINT) AS call_idx, (c.conv_id * 3 + turn * turn) % 5 AS shape, word, content,
  CASE (c.conv_id * 3 + turn * turn) % 5 WHEN 0 THEN 'd' || CAST(c.conv_id % 2 AS VARCHAR) WHEN 1 THEN 'd' || CAST(turn % 2 AS VARCHAR) END AS detail FROM conversations c JOIN first ON c.conv_id = first.conv_id),
raws AS (SELECT *, '"evidence_refs": [{{"source": "content", "location": "t0", "snippet": "' || word || '", "kind": "text"}}]' AS ref FROM said),
texts AS (SELECT *, CASE WHEN shape IN (0, 1) THEN '{{"finding": "gap", "refuted": true, ' || ref || ', "findings": [{{"kind": "gap", "location": "t0", "detail": "' || detail || '"}}], "reasoning": "gap"}}'
  WHEN shape = 2 THEN '{{"finding": "none", "refuted": false, ' || ref || ', "reasoning": "clean"}}' WHEN shape = 3 THEN 'Refuted' ELSE 'prose' END AS raw FROM raws),
default_ AS (SELECT {_q(DEFAULT_RESPONSE)} AS raw)
"""


def _hearing(edges: str, start: str, rounds: int, threshold: int, required: bool) -> str:
    """Cases through a procedure by recursion; edges: VALUES of (cur, outcome, nxt). JUDGMENT steps have edges."""
    short = "shape >= 3 OR word = ''" if required else "false"
    return f"""
WITH RECURSIVE edges(cur, outcome, nxt) AS (VALUES {edges}), {_SAID},
calls AS (SELECT f.conv_id AS case_id, i AS call_idx, shape, detail, coalesce(f.word, '') AS word FROM first f CROSS JOIN range(0, {rounds}) t(i) LEFT JOIN said s ON f.conv_id = s.case_id AND i = s.call_idx),
v AS (SELECT case_id, call_idx,
  CASE WHEN shape IS NULL THEN {str(required).lower()} WHEN shape = 2 THEN {short} ELSE true END AS refuted,
  CASE WHEN shape IS NULL THEN {str(required).lower()} WHEN shape = 4 THEN true ELSE {short} END AS blocking,
  CASE WHEN shape IN (0, 1) THEN substr(sha256('gap:t0:' || detail), 1, 16) ELSE '' END AS fp,
  CASE WHEN shape IS NULL THEN 'Mock default — all checks passed.' WHEN shape IN (0, 1) THEN 'gap' WHEN shape = 2 THEN 'clean' ELSE '' END AS reasoning FROM calls),
state AS (
  SELECT conv_id AS case_id, '{start}' AS step, 0 AS round, 0 AS k, '' AS last, 0 AS run, CAST(NULL AS VARCHAR) AS disposition, '' AS reason, '' AS steps FROM first
  UNION ALL
  SELECT case_id, CASE WHEN is_code THEN step ELSE coalesce(nxt, step) END, round + 1, CASE WHEN is_code THEN k ELSE k + 1 END,
    CASE WHEN is_code OR fp = '' THEN last ELSE fp END, now_run,
    CASE WHEN is_code THEN step WHEN fp <> '' AND now_run >= {threshold} THEN 'stalled' WHEN nxt IS NULL THEN CASE WHEN NOT refuted THEN 'approved' WHEN blocking THEN 'blocked' ELSE 'rejected' END END,
    CASE WHEN is_code THEN 'Procedure ended at terminal step ''' || step || '''' WHEN fp <> '' AND now_run >= {threshold} THEN 'Same gap fingerprint appeared ' || CAST(now_run AS VARCHAR) || ' consecutive times' WHEN nxt IS NULL THEN reasoning ELSE '' END,
    steps || CASE WHEN steps = '' THEN '' ELSE '>' END || step
  FROM (SELECT s.*, v.refuted, v.blocking, v.fp, v.reasoning, e.nxt, s.step NOT IN (SELECT cur FROM edges) AS is_code,
      CASE WHEN s.step NOT IN (SELECT cur FROM edges) OR v.fp = '' THEN s.run WHEN v.fp = s.last THEN s.run + 1 ELSE 1 END AS now_run
    FROM state s JOIN v ON s.case_id = v.case_id AND v.call_idx = least(s.k, {rounds - 1})
    LEFT JOIN edges e ON e.cur = s.step AND e.outcome = CASE WHEN v.blocking THEN 'blocked' WHEN v.refuted THEN 'refuted' ELSE 'not_refuted' END
    WHERE s.disposition IS NULL AND s.round < {rounds})),
result AS (SELECT case_id, coalesce(disposition, 'max_rounds') AS final_disposition, CASE WHEN disposition IS NULL THEN 'Procedure did not converge within {rounds} rounds' ELSE reason END AS reason,
  CAST(round AS BIGINT) AS round_count, CAST(k AS BIGINT) AS n_verdicts, steps FROM state WHERE disposition IS NOT NULL OR round = {rounds})
"""


_DESK = "('facts','not_refuted','tone'),('facts','refuted','facts'),('facts','blocked','withheld'),('tone','not_refuted','published'),('tone','refuted','facts'),('tone','blocked','withheld')"
_RETRY = "('review','not_refuted','review'),('review','refuted','review'),('review','blocked','review')"
_LAW = ["## APPLICABLE STATUTES", "### sourced: Every claim can be found in the text.", "Required evidence: content", "Violations to check:", "  - bare_claim (major): A claim that nothing supports", "Default to reject: True", ""]

#: The live hearing by recursion: what the judge says goes by the first word's length, the step and the gaps so far.
_LIVE = f"""
WITH RECURSIVE edges(cur, outcome, nxt) AS (VALUES {_DESK}),
word AS (SELECT conv_id AS case_id, length(regexp_extract(text, '[A-Za-z]+', 0)) AS n FROM conversations WHERE turn = 0),
state AS (
  SELECT case_id, n, 'facts' AS step, 0 AS round, 0 AS k, 0 AS gaps, '' AS last, 0 AS run, CAST(NULL AS VARCHAR) AS disposition, '' AS reason, '' AS steps FROM word
  UNION ALL
  SELECT case_id, n, coalesce(nxt, step), round + 1, CASE WHEN is_code THEN k ELSE k + 1 END, CASE WHEN fp <> '' THEN gaps + 1 ELSE gaps END, CASE WHEN fp <> '' THEN fp ELSE last END, now_run,
    CASE WHEN is_code THEN step WHEN fp <> '' AND now_run >= 2 THEN 'stalled' END,
    CASE WHEN is_code THEN 'Procedure ended at terminal step ''' || step || '''' WHEN fp <> '' AND now_run >= 2 THEN 'Same gap fingerprint appeared ' || CAST(now_run AS VARCHAR) || ' consecutive times' ELSE '' END,
    steps || CASE WHEN steps = '' THEN '' ELSE '>' END || step
  FROM (SELECT b.*, e.nxt FROM (SELECT a.*, CASE WHEN fp = '' THEN run WHEN fp = last THEN run + 1 ELSE 1 END AS now_run FROM
      (SELECT s.*, CASE WHEN NOT refuted THEN '' WHEN n % 5 = 0 THEN 'd0' ELSE 'd' || CAST(gaps % 2 AS VARCHAR) END AS fp FROM
        (SELECT *, step IN ('published', 'withheld') AS is_code, CASE step WHEN 'facts' THEN (n + gaps) % 2 = 1 WHEN 'tone' THEN n % 3 = 0 AND gaps < 2 ELSE false END AS refuted FROM state WHERE disposition IS NULL AND round < 5) s) a) b
    LEFT JOIN edges e ON e.cur = b.step AND e.outcome = CASE WHEN b.n = 0 THEN 'blocked' WHEN b.refuted THEN 'refuted' ELSE 'not_refuted' END)),
result AS (SELECT case_id, coalesce(disposition, 'max_rounds') AS final_disposition, CASE WHEN disposition IS NULL THEN 'Procedure did not converge within 5 rounds' ELSE reason END AS reason,
  CAST(round AS BIGINT) AS round_count, CAST(k AS BIGINT) AS n_verdicts, steps FROM state WHERE disposition IS NOT NULL OR round = 5)
"""

#: The settlement by recursion: the ledger is the one text that changes.
_AUDIT = """
WITH RECURSIVE edges(cur, outcome, nxt) AS (VALUES ('sums','not_refuted','delivery'),('sums','refuted','restate'),('sums','blocked','dispute'),('restate','done','delivery'),('delivery','not_refuted','settled'),('delivery','refuted','sums'),('delivery','blocked','dispute')),
x AS (SELECT o_orderkey AS id, o_orderstatus AS s, coalesce(r, false) AS r FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
state AS (
  SELECT id, s, r, 'sums' AS step, 0 AS round, 0 AS k, 'status ' || s AS ledger, '' AS last, 0 AS run, CAST(NULL AS VARCHAR) AS disposition, '' AS reason, '' AS steps FROM x
  UNION ALL
  SELECT id, s, r, coalesce(nxt, step), round + 1, CASE WHEN is_code THEN k ELSE k + 1 END, CASE WHEN step = 'restate' THEN 'as restated by the clerk' ELSE ledger END, CASE WHEN fp <> '' THEN fp ELSE last END, now_run,
    CASE WHEN fp <> '' AND now_run >= 2 THEN 'stalled' WHEN is_code AND nxt IS NULL THEN step END,
    CASE WHEN fp <> '' AND now_run >= 2 THEN 'Same gap fingerprint appeared ' || CAST(now_run AS VARCHAR) || ' consecutive times' WHEN is_code AND nxt IS NULL THEN 'Procedure ended at terminal step ''' || step || '''' ELSE '' END,
    steps || CASE WHEN steps = '' THEN '' ELSE '>' END || step
  FROM (SELECT a.*, e.nxt, CASE WHEN fp = '' THEN run WHEN fp = last THEN run + 1 ELSE 1 END AS now_run FROM
      (SELECT t.*, CASE WHEN told THEN CAST(k % 2 AS VARCHAR) ELSE '' END AS fp,
          told OR NOT contains(ledger, CASE WHEN r AND k > 0 THEN 'restated' ELSE s END) OR (id % 5 = 0 AND k = 1) AS refuted FROM
        (SELECT *, step IN ('restate', 'settled', 'dispute') AS is_code, step IN ('sums', 'delivery') AND ((k = 0 AND r) OR (k = 1 AND id % 4 = 0)) AS told FROM state WHERE disposition IS NULL AND round < 7) t) a
    LEFT JOIN edges e ON e.cur = a.step AND e.outcome = CASE WHEN is_code THEN 'done' WHEN k > 3 THEN 'blocked' WHEN refuted THEN 'refuted' ELSE 'not_refuted' END))
SELECT id AS case_id, coalesce(disposition, 'max_rounds') AS final_disposition, CASE WHEN disposition IS NULL THEN 'Procedure did not converge within 7 rounds' ELSE reason END AS reason,
  CAST(round AS BIGINT) AS round_count, CAST(k AS BIGINT) AS n_verdicts, steps FROM state WHERE disposition IS NOT NULL OR round = 7
"""

_PARTS = """
WITH book AS (SELECT p_partkey AS ord, 'part ' || CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_size = 1 THEN '' ELSE 'rule of ' || p_type END AS description, CASE WHEN p_size = 1 THEN '' ELSE p_brand END AS required_evidence,
  p_size = 1 OR p_size % 2 = 0 AS default_to_reject FROM part)
"""


def _line(text: str) -> str:
    return _q(text).replace("\n", "' || chr(10) || '")


_WINDOWS = "SELECT CAST({start} AS TIMESTAMP) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM {rows} GROUP BY ALL"

ORACLE_SQL = {
    "q_parse_tiers": _V + "SELECT doc_id % 8 AS shape, CAST(tier AS INTEGER) AS tier, count(*) AS n FROM w GROUP BY ALL",
    "q_extract_json": _V + "SELECT doc_id, body FROM w",
    "q_terminal_token": _V + "SELECT doc_id, tok = 'Refuted' AS refuted FROM w",
    "q_confidence_parse": _V + "SELECT doc_id, CASE WHEN lower(trim(s)) IN ('high', 'medium', 'low') THEN lower(trim(s)) ELSE 'unknown' END AS confidence FROM (SELECT doc_id, regexp_extract(raw, '\"confidence\": \"([^\"]*)\"', 1) AS s FROM w)",
    "q_blocking_normalise": _V + "SELECT doc_id, CASE WHEN s IN ('contradiction', 'unverifiable') THEN s ELSE 'none' END AS said_kind, blocking_kind, blocking FROM (SELECT *, regexp_extract(raw, '\"blocking\": \"([^\"]*)\"', 1) AS s FROM w)",
    "q_verdict_fields": _V + "SELECT doc_id, finding, refuted, confidence, blocking, reasoning, '' AS details_md, note AS fallback_note, CAST(n_refs AS BIGINT) AS n_refs, CAST(fkey IS NOT NULL AS BIGINT) AS n_findings, coalesce(substr(sha256(fkey), 1, 16), '') AS fp FROM w",
    "q_verdict_json": _V + """SELECT doc_id, CAST(json_object('finding', finding, 'refuted', refuted, 'confidence', confidence, 'blocking', blocking, 'blocking_kind', blocking_kind,
      'evidence_refs', CASE WHEN n_refs > 0 THEN json_array(json_object('source', source, 'location', 'w:1', 'snippet', snippet, 'kind', 'text')) ELSE json_array() END,
      'findings', CASE WHEN fkey IS NOT NULL THEN json_array(json_object('kind', j->>'$.findings[0].kind', 'location', j->>'$.findings[0].location', 'detail', j->>'$.findings[0].detail')) ELSE json_array() END,
      'reasoning', reasoning) AS VARCHAR) AS json FROM w""",
    "q_is_decisive": _V + "SELECT doc_id, refuted AND confidence = 'high' AND NOT blocking AS decisive FROM w",
    "q_route": _V + "SELECT doc_id, CASE WHEN blocking THEN 'blocked' WHEN refuted THEN 'refuted' ELSE 'not_refuted' END AS route FROM w",
    "q_terminal_disposition": _V + "SELECT doc_id, CASE WHEN NOT (refuted OR why <> '' OR untrue) THEN 'approved' WHEN blocking OR why <> '' THEN 'blocked' ELSE 'rejected' END AS disposition FROM w",
    "q_findings_nonblank": _FINDINGS + "SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE NOT blank) AS n_kept FROM f GROUP BY l_orderkey",
    "q_fingerprint": _FINDINGS + "SELECT l_orderkey, fp FROM p",
    "q_fingerprint_groups": _FINDINGS + "SELECT fp, count(*) AS n FROM p WHERE fp <> '' GROUP BY fp HAVING count(*) > 1",
    "q_evidence_rule": _REFS + """SELECT o_orderkey, CASE WHEN n = 0 AND least > 0 THEN 'no evidence refs provided' WHEN s = 'F' AND NOT i THEN 'required source ''invoice'' not cited' WHEN s = 'F' AND NOT c THEN 'required source ''receipt'' not cited'
      WHEN s = 'O' AND NOT m THEN 'required source ''manifest'' not cited' WHEN n < least THEN 'only ' || CAST(n AS VARCHAR) || ' citations, need at least ' || CAST(least AS VARCHAR)
      WHEN first_blank IS NOT NULL THEN 'evidence from ''' || first_blank || ''' has empty snippet' ELSE '' END AS reason FROM o""",
    "q_required_sources_missing": _REFS + "SELECT o_orderkey, 'invoice' AS source FROM o WHERE s = 'F' AND NOT i UNION ALL SELECT o_orderkey, 'receipt' FROM o WHERE s = 'F' AND NOT c UNION ALL SELECT o_orderkey, 'manifest' FROM o WHERE s = 'O' AND NOT m",
    "q_citation_verify": _V + "SELECT doc_id, CAST(0 AS BIGINT) AS pos, source, snippet, NOT untrue AS verified FROM w WHERE n_refs > 0",
    "q_citation_failures": _V + "SELECT doc_id, NOT untrue AS all_verified, CASE WHEN untrue THEN 'Unverifiable: ''' || substr(snippet, 1, 60) || '...'' not found in ''' || source || '''' ELSE '' END AS messages FROM w WHERE n_refs > 0",
    "q_benchmark_contained": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''",
    "q_evidence_override": _V + "SELECT doc_id, blocking OR why <> '' AS blocking, CASE WHEN why <> '' THEN 'Evidence insufficient: ' || why ELSE note END AS note FROM w",
    "q_citation_override": _V + "SELECT doc_id, untrue, refuted AS before, refuted OR why <> '' OR untrue AS after FROM w",
    "q_latest_sources": "SELECT user_id AS case_id, event_type AS source, arg_max(props, (ts, event_id)) AS content FROM events GROUP BY ALL",
    "q_confidence_gate": _V + """SELECT doc_id, doc_id % 3 = 2 OR list_position(['unknown', 'low', 'medium', 'high'], confidence) >= CASE doc_id % 3 WHEN 0 THEN 4 ELSE 3 END AS confident FROM w""",
    "q_statute_blocking": _V + "SELECT doc_id, blocking AND quality = 1 AS blocks FROM w",
    "q_uncited": _FINDINGS + "SELECT l_orderkey, count(*) FILTER (WHERE tok LIKE 'A:%') = 0 AND count(*) FILTER (WHERE NOT blank) > 1 AS uncited FROM f WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey",
    "q_panel": _V + "SELECT doc_id // 5 AS case_id, count(*) AS n, bool_or(refuted AND confidence = 'high' AND NOT blocking) OR 2 * count(*) FILTER (WHERE refuted) >= count(*) AS refuted, bool_or(refuted AND confidence = 'high' AND NOT blocking) AS settled FROM w GROUP BY ALL",
    "q_catalog_get": _BOOK + "SELECT s_suppkey, s_suppkey % 3 <> 0 AS known, CASE WHEN s_suppkey % 3 <> 0 THEN description END AS description FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN book ON n_name = name",
    "q_catalog_size": "SELECT count(*) AS n FROM part",
    "q_statute_upsert": "SELECT p_brand AS name, min(p_partkey) AS ord, arg_max(p_type, p_partkey) AS p_type, arg_max(p_size, p_partkey) AS p_size FROM part GROUP BY p_brand",
    "q_statute_lookup": _BOOK + ", s AS (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT s_suppkey, CAST(pos AS BIGINT) AS pos, name, default_to_reject FROM s CROSS JOIN (VALUES (0), (2)) p(pos) JOIN book ON n_name = name",
    "q_statute_roundtrip": _PARTS + "SELECT CAST(ord AS INTEGER) AS ord, name, description, required_evidence, CAST(3 AS BIGINT) AS max_violations, 'block' AS action, default_to_reject, true AS blocking FROM book",
    "q_statute_names": _PARTS + """, b AS (SELECT ord // 100 AS book, row_number() OVER (PARTITION BY ord // 100 ORDER BY ord) - 1 AS pos, p_brand AS brand, description, default_to_reject FROM book JOIN part ON ord = p_partkey)
      SELECT book, CAST(min(pos) AS INTEGER) AS ord, brand AS name, arg_max(description, pos) AS description, arg_max(default_to_reject, pos) AS default_to_reject FROM b GROUP BY book, brand""",
    "q_statute_parts": _PARTS + "SELECT CAST((n // 64) * 1048576 + n % 64 AS INTEGER) AS ord, name, description FROM (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS n FROM book) AS x",
    "s_catalog": "SELECT p_brand AS name, min(p_partkey) AS ord, arg_max(p_type, p_partkey) AS p_type, arg_max(p_size, p_partkey) AS p_size FROM part GROUP BY p_brand",
    "q_transitions": _GRAPH + """, e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS own, event_type, CASE WHEN event_id % 2 = 0 THEN 'view' ELSE 'click' END AS outcome FROM events)
      SELECT event_id, nxt, coalesce(nxt, event_type) AS stays_or_next FROM e LEFT JOIN edges ON e.own = edges.procedure AND e.event_type = edges.cur AND e.outcome = edges.outcome""",
    "q_procedure_json": _GRAPH + """, t AS (SELECT procedure, cur, string_agg('"' || outcome || '":"' || nxt || '"', ',' ORDER BY outcome) AS j FROM edges GROUP BY ALL),
      p AS (SELECT s.procedure, min(step) AS first, string_agg('{"name":"' || step || '","kind":"JUDGMENT","statutes":["law of ' || step || '"],"transitions":{' || coalesce(j, '') || '}}', ',' ORDER BY step) AS l FROM steps s LEFT JOIN t ON s.procedure = t.procedure AND s.step = t.cur GROUP BY s.procedure)
      SELECT procedure, '{"name":"' || procedure || '","initial_step":"' || first || '","max_rounds":10,"stall_threshold":2,"steps":[' || l || ']}' AS json FROM p""",
    "q_procedure_load": _GRAPH + "SELECT s.procedure, s.step, 'JUDGMENT' AS kind, 'law of ' || s.step AS statutes, outcome, nxt FROM steps s LEFT JOIN edges e ON s.procedure = e.procedure AND s.step = e.cur",
    "q_terminal_steps": _GRAPH + "SELECT procedure, step FROM steps s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.procedure = s.procedure AND e.cur = s.step)",
    "q_procedure_lint": _GRAPH + """SELECT procedure, cur AS step, 'unknown target' AS problem, nxt AS name FROM edges e WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.procedure = e.procedure AND s.step = e.nxt)
      UNION ALL SELECT procedure, step, 'unknown statute', 'law of ' || step FROM steps WHERE step = 'error'""",
    "q_stall_events": _stall("event_type", 2) + "SELECT user_id, event_id, run FROM hits",
    "q_stall_court": """WITH g AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (ORDER BY ts, event_id)),
      h AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
      SELECT user_id, event_id, run FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY island ORDER BY ts, event_id) AS run FROM h) AS x WHERE run >= 3""",
    "q_stall_skip_blank": _stall(_BLANKED, 2) + "SELECT user_id, event_id, run FROM hits",
    "q_stall_first": _stall(_BLANKED, 3) + "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(run, (ts, event_id)) AS run FROM hits GROUP BY user_id",
    "q_stall_fold": _stall(_BLANKED, 2) + "SELECT u.user_id, count(hits.event_id) AS hits FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN hits ON u.user_id = hits.user_id GROUP BY u.user_id",
    "q_prior_gaps": """WITH g AS (SELECT conv_id, turn, list('- [' || role || '] ' || CAST(turn AS VARCHAR) || ': ' || substr(text, 1, 20)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM conversations)
      SELECT conv_id, turn, CAST(coalesce(len(l), 0) AS BIGINT) AS n_gaps, sha256(coalesce(array_to_string(l, chr(10)), '')) AS gaps_sha256 FROM g""",
    "q_prompt": f"""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role, text FROM conversations),
      p AS (SELECT conv_id, {_line(PROMPT_HEAD + chr(10) * 2 + '## OBJECTIVE' + chr(10))} || min(text) FILTER (WHERE i = 1) || {_line(chr(10) * 2 + '## CASE DATA' + chr(10))}
        || string_agg('### ' || CASE WHEN i = 1 THEN 'objective' ELSE role || CAST(turn AS VARCHAR) END || chr(10) || CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || '... (truncated)' ELSE text END || chr(10), chr(10) ORDER BY turn)
        || {_line(chr(10) + chr(10).join(_LAW) + chr(10) + '## PRIOR GAPS (from previous rounds)' + chr(10))} || string_agg('- [' || role || '] ' || CAST(turn AS VARCHAR) || ': ' || substr(text, 1, 20), chr(10) ORDER BY turn)
        || {_line(chr(10) * 2 + PROMPT_RULES)} AS x FROM t GROUP BY conv_id)
      SELECT conv_id, CAST(length(x) AS BIGINT) AS n_chars, sha256(x) AS prompt_sha256 FROM p""",
    "q_packet": """WITH p AS (SELECT conv_id, '## OBJECTIVE' || chr(10) || arg_min(text, turn) || chr(10) || chr(10) || '## EVIDENCE' || chr(10) || string_agg(chr(10) || '### ' || role || CAST(turn AS VARCHAR) || chr(10) || text, chr(10) ORDER BY turn)
        || coalesce(chr(10) || chr(10) || '## PRIOR GAPS (from previous rounds)' || chr(10) || string_agg('- ' || substr(text, 1, 20), chr(10) ORDER BY turn) FILTER (WHERE role = 'user'), '') AS x FROM conversations GROUP BY conv_id)
      SELECT conv_id, sha256(x) AS packet_sha256 FROM p""",
    "q_truncate": "WITH t AS (SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || '... (truncated)' ELSE text END AS x FROM documents) SELECT doc_id, CAST(length(x) AS BIGINT) AS n_chars, sha256(x) AS cut_sha256 FROM t",
    "q_mock_responses": f"WITH {_SAID} SELECT f.conv_id AS case_id, CAST(i AS BIGINT) AS call_idx, t.raw IS NULL AS used_up, sha256(coalesce(t.raw, d.raw)) AS raw_sha256 FROM first f CROSS JOIN range(0, 10) r(i) CROSS JOIN default_ d LEFT JOIN texts t ON f.conv_id = t.case_id AND i = t.call_idx",
    "q_adjudicate_moderation": _hearing(_DESK, "facts", 5, 2, True) + "SELECT case_id, final_disposition, reason, round_count, n_verdicts, steps FROM result",
    "q_max_rounds": _hearing(_RETRY, "review", 3, 99, False) + "SELECT case_id, final_disposition, reason, round_count, n_verdicts, steps FROM result",
    "q_own_limits": _hearing(_DESK, "facts", 3, 1, True) + "SELECT case_id, final_disposition, reason, round_count, n_verdicts, steps FROM result",
    "q_case_ids": """SELECT o_orderkey, substr(sha256('[{"key":"priority","value":"' || o_orderpriority || '"},{"key":"status","value":"' || o_orderstatus || '"}]'), 1, 12) AS case_id FROM orders""",
    "q_disposition_summary": _hearing(_DESK, "facts", 5, 2, True) + "SELECT final_disposition, count(*) AS n, CAST(sum(round_count) AS BIGINT) AS rounds, CAST(sum(n_verdicts) AS BIGINT) AS calls FROM result GROUP BY final_disposition",
    "q_adjudicate_audit": _AUDIT,
    "q_adjudicate_live": _LIVE + "SELECT case_id, final_disposition, reason, round_count, n_verdicts, steps FROM result",
    "q_no_backend": "SELECT conv_id AS case_id, 'withheld' AS final_disposition, 'Procedure ended at terminal step ''withheld''' AS reason, CAST(2 AS BIGINT) AS round_count, CAST(1 AS BIGINT) AS n_verdicts, 'facts>withheld' AS steps FROM conversations WHERE turn = 0",
    "q_no_procedure": "SELECT conv_id AS case_id, 'rejected' AS final_disposition, 'No procedure defined' AS reason, CAST(0 AS BIGINT) AS round_count, CAST(0 AS BIGINT) AS n_verdicts, '' AS steps FROM conversations WHERE turn = 0",
    "q_escalations": "SELECT l_orderkey AS case_id, l_returnflag AS statute, count(*) AS n, CASE WHEN l_returnflag = 'R' THEN 'block' ELSE 'flag' END AS action FROM lineitem GROUP BY l_orderkey, l_returnflag HAVING count(*) > CASE WHEN l_returnflag = 'N' THEN 4 ELSE 2 END",
    "u_judge_udf": "SELECT conv_id, turn, length(text) < 60 AS refuted FROM conversations",
    "s_tumbling": _WINDOWS.format(start="date_trunc('day', ts)", rows="events"),
    "s_sliding": _WINDOWS.format(start="w", rows="(SELECT *, unnest([time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2000-01-01') - INTERVAL '12 hours']) AS w FROM events)"),
    "s_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM h GROUP BY user_id, s""",
    "s_dedup": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "s_late": """WITH m AS (SELECT max(ts) FILTER (WHERE event_id % 10 <> 0) - INTERVAL '1 hour' AS first_mark, max(ts) - INTERVAL '1 hour' AS last_mark FROM events),
      e AS (SELECT *, date_trunc('day', ts) + INTERVAL '1 day' AS closes FROM events, m)
      SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM e
      WHERE closes <= last_mark AND (event_id % 10 <> 0 OR closes > first_mark) GROUP BY ALL""",
    "s_stall_batches": _stall("event_type", 2) + "SELECT user_id, event_id, run FROM hits",
    "s_stall_ordered": _stall("event_type", 2) + "SELECT user_id, event_id, run FROM hits",
    "s_stall": _stall("event_type", 2) + "SELECT user_id, event_id, run FROM hits",
}
