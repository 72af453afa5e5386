"""The registered queries over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assize.functions.evidence import all_cited, evidence_reason, judgment_prompt, packet_section
from assize.functions.text import json_body, terminal_token, truncated
from assize.functions.verdicts import blocking_kind, confidence, decisive, fingerprint, is_blank_finding, parse_verdict, prepare, route, terminal_disposition, verdict_json
from assize.operators import catalog, citations, extensions, procedure, scans, stalls
from assize.operators.adjudicate import DEFAULT_RESPONSE, Rules, Statute, adjudicate, adjudicate_live, judge_with, overridden, with_case_ids
from assize.operators.procedure import CODE, JUDGMENT, Procedure, Step, set_key
from assize.sources.tables import conversation_cases, conversation_responses, judge_texts, order_citations, order_findings, table
from assize.streaming import events as streams
from assize.streaming import upserts

c = F.col

# ---------------------------------------------------------------- rules used by the queries

#: Facts first, then tone; a gap found in either sends the text back to the facts.
DESK = Procedure(
    "desk",
    (
        Step("facts", JUDGMENT, ("sourced",), {"not_refuted": "tone", "refuted": "facts", "blocked": "withheld"}),
        Step("tone", JUDGMENT, ("measured",), {"not_refuted": "published", "refuted": "facts", "blocked": "withheld"}),
        Step("published", CODE),
        Step("withheld", CODE),
    ),
    max_rounds=5,
)
SOURCED = Statute("sourced", "Every claim can be found in the text.", ("content",), True, (("bare_claim", "major", "A claim that nothing supports"),))
DESK_RULES = Rules(DESK, (SOURCED, Statute("measured", "The text keeps a level tone.", ("content",))))
LOOP_RULES = Rules(Procedure("retry", (Step("review", JUDGMENT, (), {"not_refuted": "review", "refuted": "review", "blocked": "review"}),), max_rounds=3, stall_threshold=99))
#: Sums, then delivery. What is restated goes on to the delivery; a refuted delivery sends the order back to its sums.
SETTLEMENT = Procedure(
    "settlement",
    (
        Step("sums", JUDGMENT, ("sums_law",), {"not_refuted": "delivery", "refuted": "restate", "blocked": "dispute"}),
        Step("restate", CODE, (), {"done": "delivery"}, set_key("ledger", "as restated by the clerk")),
        Step("delivery", JUDGMENT, ("slip_law", "sums_law"), {"not_refuted": "settled", "refuted": "sums", "blocked": "dispute"}),
        Step("settled", CODE),
        Step("dispute", CODE),
    ),
    max_rounds=7,
)
SETTLEMENT_RULES = Rules(SETTLEMENT, (Statute("sums_law", "Sums are in the ledger.", ("ledger",)), Statute("slip_law", "The slip is named.", ("slip",))))
#: One procedure of the text verdicts: the route of each case ends it.
TEXT_RULES = Rules(Procedure("text", (Step("judge", JUDGMENT, ("text_law",), {}),)), (Statute("text_law", "Cites the text.", ("text",)),))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return judge_texts(spark, sf_dir).withColumn("v", parse_verdict(c("raw")))


def _overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = F.create_map(F.lit("text"), c("text"))
    return _parsed(spark, sf_dir).withColumn("o", overridden(TEXT_RULES, F.lit("judge"), c("v"), sources))


# ---------------------------------------------------------------- verdict texts


def q_parse_tiers(spark, sf_dir):
    return _parsed(spark, sf_dir).groupBy((c("doc_id") % 8).alias("shape"), c("v.tier").alias("tier")).agg(F.count("*").alias("n"))


def q_extract_json(spark, sf_dir):
    return judge_texts(spark, sf_dir).select("doc_id", json_body(c("raw")).alias("body"))


def q_terminal_token(spark, sf_dir):
    return judge_texts(spark, sf_dir).select("doc_id", terminal_token(c("raw")).alias("refuted"))


def q_confidence_parse(spark, sf_dir):
    said = F.regexp_extract("raw", '"confidence": "([^"]*)"', 1)
    return judge_texts(spark, sf_dir).select("doc_id", confidence(said).alias("confidence"))


def q_blocking_normalise(spark, sf_dir):
    said = F.regexp_extract("raw", '"blocking": "([^"]*)"', 1)
    return _parsed(spark, sf_dir).select("doc_id", blocking_kind(said).alias("said_kind"), c("v.blocking_kind").alias("blocking_kind"), c("v.blocking").alias("blocking"))


def q_verdict_fields(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "doc_id", *(c(f"v.{n}").alias(n) for n in ("finding", "refuted", "confidence", "blocking", "reasoning", "details_md", "fallback_note")),
        F.size("v.evidence_refs").cast("long").alias("n_refs"), F.size("v.findings").cast("long").alias("n_findings"), fingerprint(c("v.findings")).alias("fp"),
    )


def q_verdict_json(spark, sf_dir):
    return _parsed(spark, sf_dir).select("doc_id", verdict_json(c("v")).alias("json"))


def q_is_decisive(spark, sf_dir):
    return _parsed(spark, sf_dir).select("doc_id", decisive(c("v")).alias("decisive"))


def q_route(spark, sf_dir):
    return _parsed(spark, sf_dir).select("doc_id", route(c("v")).alias("route"))


def q_terminal_disposition(spark, sf_dir):
    return _overridden(spark, sf_dir).select("doc_id", terminal_disposition(c("o")).alias("disposition"))


# ---------------------------------------------------------------- findings


def q_findings_nonblank(spark, sf_dir):
    kept = F.filter("findings", lambda f: ~is_blank_finding(f))
    return order_findings(spark, sf_dir).select("l_orderkey", F.size("findings").cast("long").alias("n"), F.size(kept).cast("long").alias("n_kept"))


def q_fingerprint(spark, sf_dir):
    return order_findings(spark, sf_dir).select("l_orderkey", fingerprint(c("findings")).alias("fp"))


def q_fingerprint_groups(spark, sf_dir):
    return q_fingerprint(spark, sf_dir).where("fp <> ''").groupBy("fp").agg(F.count("*").alias("n")).where("n > 1")


# ---------------------------------------------------------------- evidence


def q_evidence_rule(spark, sf_dir):
    return order_citations(spark, sf_dir).select("o_orderkey", evidence_reason(c("refs"), c("required"), c("least")).alias("reason"))


def q_required_sources_missing(spark, sf_dir):
    rows = order_citations(spark, sf_dir)
    wanted = rows.select("o_orderkey", F.explode("required").alias("source"))
    found = rows.select("o_orderkey", F.explode(F.array_distinct(F.transform("refs", lambda r: r["source"]))).alias("source"))
    return wanted.join(found, ["o_orderkey", "source"], "left_anti")


def _citations(spark, sf_dir):
    """(doc_id, pos, source, location, snippet, kind, verified)"""
    rows = _parsed(spark, sf_dir)
    refs = rows.select("doc_id", F.posexplode("v.evidence_refs").alias("pos", "ref")).select("doc_id", "pos", "ref.*")
    sources = rows.select("doc_id", F.lit("text").alias("source"), c("text").alias("content"))
    return citations.verify(refs, sources, "doc_id")


def q_citation_verify(spark, sf_dir):
    return _citations(spark, sf_dir).select("doc_id", c("pos").cast("long").alias("pos"), "source", "snippet", "verified")


def q_citation_failures(spark, sf_dir):
    return citations.failures(_citations(spark, sf_dir), "doc_id").select("doc_id", "all_verified", F.array_join("messages", "\n").alias("messages"))


def q_benchmark_contained(spark, sf_dir):
    return citations.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item"), "doc_id", "text", "item_id", "item")


def q_evidence_override(spark, sf_dir):
    return _overridden(spark, sf_dir).select("doc_id", c("o.blocking").alias("blocking"), c("o.fallback_note").alias("note"))


def q_citation_override(spark, sf_dir):
    true = all_cited(c("v.evidence_refs"), F.create_map(F.lit("text"), c("text")))
    return _overridden(spark, sf_dir).select("doc_id", (~true).alias("untrue"), c("v.refuted").alias("before"), c("o.refuted").alias("after"))


def q_latest_sources(spark, sf_dir):
    """Cases are users, sources their event types: of each, the content that came last."""
    rows = table(spark, sf_dir, "events").select(c("user_id").alias("case_id"), c("event_type").alias("source"), c("props").alias("content"), F.struct("ts", "event_id").alias("ord"))
    return citations.latest_sources(rows).select("case_id", "source", "content")


# ---------------------------------------------------------------- declared rules beyond the rounds


def q_confidence_gate(spark, sf_dir):
    least = F.when(c("doc_id") % 3 == 0, "high").when(c("doc_id") % 3 == 1, "medium")
    return _parsed(spark, sf_dir).select("doc_id", extensions.confident(c("v"), least).alias("confident"))


def q_statute_blocking(spark, sf_dir):
    return _parsed(spark, sf_dir).select("doc_id", extensions.blocks(c("v"), c("quality") == 1).alias("blocks"))


def q_uncited(spark, sf_dir):
    """An order cites its invoice lines and claims its lines: more than one claim without a citation."""
    cited = order_citations(spark, sf_dir).select(c("o_orderkey").alias("l_orderkey"), F.filter("refs", lambda r: r["source"] == "invoice").alias("evidence_refs"))
    claims = order_findings(spark, sf_dir).select("l_orderkey", F.filter("findings", lambda f: ~is_blank_finding(f)).alias("findings"))
    return claims.join(cited, "l_orderkey").select("l_orderkey", extensions.uncited_claims(F.struct("evidence_refs", "findings"), 1).alias("uncited"))


def q_panel(spark, sf_dir):
    """Five texts that follow one another make a panel."""
    rows = _parsed(spark, sf_dir).select(F.floor(c("doc_id") / 5).cast("long").alias("case_id"), c("v").alias("verdict"))
    return extensions.panel(rows).select("case_id", "n", "refuted", "settled")


# ---------------------------------------------------------------- catalog


def q_statute_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(c("p_brand").alias("name"), c("p_partkey").alias("ord"), "p_type", "p_size")
    return catalog.upserted(rows).select("name", "ord", "p_type", "p_size")


def _json_of(key, name, description, region, strict, short):
    full = F.to_json(F.struct(name.alias("name"), description.alias("description"), F.array(region).alias("required_evidence"), strict.alias("default_to_reject")))
    return c(key).alias("ord"), F.when(short, F.to_json(F.struct(name.alias("name")))).otherwise(full).alias("json")


def _nation_book(spark, sf_dir):
    """A statute for each nation, as JSON: it requires its region's name; nations of region 0 leave most fields out."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey"))
    return rows.select(*_json_of("n_nationkey", c("n_name"), F.concat(F.lit("rule of "), c("r_name")), c("r_name"), c("n_nationkey") % 2 == 0, c("n_regionkey") == 0))


def _part_book(spark, sf_dir):
    """A statute for each part, as JSON: it requires its brand; parts of size 1 leave most fields out."""
    return table(spark, sf_dir, "part").select(*_json_of("p_partkey", F.concat(F.lit("part "), c("p_partkey").cast("string")), F.concat(F.lit("rule of "), c("p_type")), c("p_brand"), c("p_size") % 2 == 0, c("p_size") == 1))


def q_statute_lookup(spark, sf_dir):
    book = catalog.statutes_from_json(_nation_book(spark, sf_dir))
    own = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), c("s_nationkey") == c("n_nationkey"))
    rows = own.select("s_suppkey", F.array(c("n_name"), F.lit("no such law"), c("n_name")).alias("names"))
    return catalog.get_all(rows, "names", book).select("s_suppkey", c("pos").cast("long").alias("pos"), c("statute.name").alias("name"), c("statute.default_to_reject").alias("default_to_reject"))


def q_catalog_get(spark, sf_dir):
    """Each supplier asks for its nation's statute; every third one for a law that nobody made."""
    book = catalog.statutes_from_json(_nation_book(spark, sf_dir))
    own = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), c("s_nationkey") == c("n_nationkey"))
    rows = own.select("s_suppkey", F.when(c("s_suppkey") % 3 == 0, "no such law").otherwise(c("n_name")).alias("asked"))
    return catalog.get(rows, "asked", book).select("s_suppkey", "known", c("statute.description").alias("description"))


def q_catalog_size(spark, sf_dir):
    return catalog.size(catalog.upserted(catalog.statutes_from_json(_part_book(spark, sf_dir)))).select("n")


def q_statute_roundtrip(spark, sf_dir):
    book = catalog.statutes_from_json(_part_book(spark, sf_dir))
    again = catalog.statutes_from_json(book.select("ord", catalog.statute_json().alias("json")))
    return again.select(
        "ord", "name", "description", F.array_join("required_evidence", "|").alias("required_evidence"), c("escalation.max_violations").cast("long").alias("max_violations"),
        c("escalation.action").alias("action"), "default_to_reject", "blocking",
    )


def _brand_laws(spark, sf_dir):
    """A statute for each part, under its brand's name: of the parts of a book with one brand, the last one's law holds."""
    rows = _part_book(spark, sf_dir).select("ord", F.from_json("json", catalog.FIELDS).alias("s")).select("ord", "s.*")
    brands = table(spark, sf_dir, "part").select(c("p_partkey").alias("ord"), "p_brand")
    return catalog.with_defaults(rows.join(brands, "ord").withColumn("name", c("p_brand")).drop("p_brand"))


def q_statute_names(spark, sf_dir):
    """Every hundred parts are a book: to JSON and back, its names in order, later laws at the earlier ones' places."""
    books = catalog.book_json(_brand_laws(spark, sf_dir).withColumn("book", F.expr("ord div 100")), ("book",))
    return catalog.book_from_json(books, by=("book",)).select("book", "ord", "name", "description", "default_to_reject")


def q_statute_parts(spark, sf_dir):
    """All parts' laws as one book, which is written in parts of 64 and read as one again."""
    book = catalog.statutes_from_json(_part_book(spark, sf_dir))
    again = catalog.book_from_json(catalog.book_parts(book, 64))
    return again.select("ord", "name", "description")


# ---------------------------------------------------------------- procedures


def _event_graphs(spark, sf_dir):
    """A procedure for each user: event types are steps, what follows them are edges by the type of the next event."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("nxt"))
    rows = rows.withColumn("procedure", c("user_id").cast("string"))
    steps = rows.where("value < 60").groupBy("procedure", c("event_type").alias("step")).agg(F.count("*").alias("uses"))
    steps = steps.select("procedure", "step", F.array(F.concat(F.lit("law of "), c("step"))).alias("statutes"))
    edges = rows.where("value < 5 and nxt is not null").select("procedure", c("event_type").alias("cur"), c("nxt").alias("outcome"), "nxt").distinct()
    return steps, edges


def q_transitions(spark, sf_dir):
    """Every event goes on along its own user's edges."""
    _, edges = _event_graphs(spark, sf_dir)
    rows = table(spark, sf_dir, "events").select("event_id", c("user_id").cast("string").alias("own"), "event_type", F.when(c("event_id") % 2 == 0, "view").otherwise("click").alias("outcome"))
    return procedure.follow(rows, edges, "event_type", "outcome", "own").select("event_id", "nxt", "stays_or_next")


def _stored(spark, sf_dir):
    steps, edges = _event_graphs(spark, sf_dir)
    limits = steps.groupBy("procedure").agg(F.min("step").alias("initial_step")).withColumns({"max_rounds": F.lit(10), "stall_threshold": F.lit(2)})
    return procedure.stored(limits, steps.withColumns({"ord": F.lit(0), "kind": F.lit(JUDGMENT)}), edges)


def q_procedure_json(spark, sf_dir):
    return _stored(spark, sf_dir)


def q_procedure_load(spark, sf_dir):
    _, steps, edges = procedure.unstored(_stored(spark, sf_dir))
    return steps.join(edges.withColumnRenamed("cur", "step"), ["procedure", "step"], "left").select("procedure", "step", "kind", F.array_join("statutes", "|").alias("statutes"), "outcome", "nxt")


def q_terminal_steps(spark, sf_dir):
    steps, edges = _event_graphs(spark, sf_dir)
    return procedure.terminal_steps(steps, edges).select("procedure", "step")


def q_procedure_lint(spark, sf_dir):
    steps, edges = _event_graphs(spark, sf_dir)
    laws = table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.concat(F.lit("law of "), c("event_type")).alias("name")).distinct()
    return procedure.lint(steps, edges, laws)


# ---------------------------------------------------------------- stalls


def q_stall_events(spark, sf_dir):
    rows = stalls.stall_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return rows.where("stalled").select("user_id", "event_id", c("run").cast("long").alias("run"))


def _blanked(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("fp", F.when(c("event_type") == "view", "").otherwise(c("event_type")))


def q_stall_court(spark, sf_dir):
    """One count over all users, as of a court that hears them all: a single key, in blocks."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return scans.stall_scan(rows, None, ["ts", "event_id"], "event_type", 3, 5_000).where("stalled").select("user_id", "event_id", "run")


def q_stall_skip_blank(spark, sf_dir):
    rows = stalls.stall_runs(_blanked(spark, sf_dir), "user_id", ["ts", "event_id"], "fp")
    return rows.where("stalled").select("user_id", "event_id", c("run").cast("long").alias("run"))


def q_stall_first(spark, sf_dir):
    rows = stalls.first_stalls(_blanked(spark, sf_dir), "user_id", ["ts", "event_id"], "fp", 3)
    return rows.select("user_id", "event_id", c("run").cast("long").alias("run"))


def q_stall_fold(spark, sf_dir):
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "fp"))), lambda x: x["fp"])
    return _blanked(spark, sf_dir).groupBy("user_id").agg(ordered.alias("fps")).select("user_id", stalls.stall_counts(c("fps")).cast("long").alias("hits"))


# ---------------------------------------------------------------- prompts


def _gap(kind="role", location="turn"):
    return F.struct(c(kind).alias("kind"), c(location).cast("string").alias("location"), F.substring("text", 1, 20).alias("detail"))


def q_prior_gaps(spark, sf_dir):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.collect_list(_gap()).over(before).alias("gaps"))
    shown = F.array_join(F.transform("gaps", lambda g: F.concat(F.lit("- ["), g["kind"], F.lit("] "), g["location"], F.lit(": "), g["detail"])), "\n")
    return rows.select("conv_id", "turn", F.size("gaps").cast("long").alias("n_gaps"), F.sha2(shown, 256).alias("gaps_sha256"))


def _per_conversation(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def q_prompt(spark, sf_dir):
    rows = _per_conversation(spark, sf_dir)
    fields = F.transform("turns", lambda t, i: F.struct(F.when(i == 0, F.lit("objective")).otherwise(F.concat(t["role"], t["turn"].cast("string"))).alias("name"), t["text"].alias("value")))
    gaps = F.transform("turns", lambda t: F.struct(t["role"].alias("kind"), t["turn"].cast("string").alias("location"), F.substring(t["text"], 1, 20).alias("detail")))
    s = DESK_RULES.statutes[0]
    law = F.array(F.struct(
        F.lit(s.name).alias("name"), F.lit(s.description).alias("description"), F.array(*map(F.lit, s.required_evidence)).alias("required_evidence"), F.lit(s.default_to_reject).alias("default_to_reject"),
        F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("severity"), F.lit(d).alias("description")) for n, v, d in s.violations)).alias("violations"),
    ))
    text = judgment_prompt(fields, law, gaps)
    return rows.select("conv_id", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("prompt_sha256"))


def q_packet(spark, sf_dir):
    rows = _per_conversation(spark, sf_dir)
    artifacts = F.transform("turns", lambda t: F.struct(F.concat(t["role"], t["turn"].cast("string")).alias("name"), t["text"].alias("content")))
    gaps = F.transform(F.filter("turns", lambda t: t["role"] == "user"), lambda t: F.substring(t["text"], 1, 20))
    text = packet_section(F.get("turns", 0)["text"], artifacts, gaps)
    return rows.select("conv_id", F.sha2(text, 256).alias("packet_sha256"))


def q_truncate(spark, sf_dir):
    cut = truncated(c("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cut).cast("long").alias("n_chars"), F.sha2(cut, 256).alias("cut_sha256"))


# ---------------------------------------------------------------- cases


def q_mock_responses(spark, sf_dir):
    calls = conversation_cases(spark, sf_dir).select("case_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("call_idx"))
    rows = calls.join(conversation_responses(spark, sf_dir), ["case_id", "call_idx"], "left")
    return rows.select("case_id", c("call_idx").cast("long").alias("call_idx"), c("raw").isNull().alias("used_up"), F.sha2(F.coalesce("raw", F.lit(DEFAULT_RESPONSE)), 256).alias("raw_sha256"))


def _moderated(spark, sf_dir, rules):
    return adjudicate(conversation_cases(spark, sf_dir), conversation_responses(spark, sf_dir), rules)


def _result(rows):
    return rows.select("case_id", "final_disposition", "reason", c("round_count").cast("long").alias("round_count"), c("n_verdicts").cast("long").alias("n_verdicts"), F.array_join("step_history", ">").alias("steps"))


def q_adjudicate_moderation(spark, sf_dir):
    return _result(_moderated(spark, sf_dir, DESK_RULES))


def q_max_rounds(spark, sf_dir):
    return _result(_moderated(spark, sf_dir, LOOP_RULES))


def q_own_limits(spark, sf_dir):
    """A court's own limits come before the procedure's."""
    return _result(_moderated(spark, sf_dir, Rules(DESK, DESK_RULES.statutes, max_rounds=3, stall_threshold=1)))


def q_case_ids(spark, sf_dir):
    """Orders without a key of their own: equal data, equal ids."""
    data = F.create_map(F.lit("status"), c("o_orderstatus"), F.lit("priority"), c("o_orderpriority"))
    return with_case_ids(table(spark, sf_dir, "orders").select("o_orderkey", data.alias("data"))).select("o_orderkey", "case_id")


def q_disposition_summary(spark, sf_dir):
    return _moderated(spark, sf_dir, DESK_RULES).groupBy("final_disposition").agg(F.count("*").alias("n"), F.sum("round_count").alias("rounds"), F.sum("n_verdicts").alias("calls"))


def q_adjudicate_audit(spark, sf_dir):
    """Orders as cases, four answers each: every answer cites the ledger and the slip. A returned line refutes the first, an order
    number divisible by four the second; one divisible by five cites in its second answer what the slip never said."""
    orders = table(spark, sf_dir, "orders")
    cases = orders.select(c("o_orderkey").alias("case_id"), F.create_map(F.lit("ledger"), F.concat(F.lit("status "), c("o_orderstatus")), F.lit("slip"), c("o_orderpriority")).alias("data"))
    returned = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.bool_or(c("l_returnflag") == "R").alias("returned"))
    rows = orders.join(returned, "o_orderkey", "left").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.coalesce("returned", F.lit(False)).alias("returned"))

    def answer(k: int):
        refuted = (c("returned") if k == 0 else c("o_orderkey") % 4 == 0 if k == 1 else F.lit(False)).cast("string")
        ledger = F.when(c("returned") & F.lit(k > 0), "restated").otherwise(c("o_orderstatus"))
        slip = F.when((c("o_orderkey") % 5 == 0) & F.lit(k == 1), "never said").otherwise(c("o_orderpriority"))
        found = F.when(refuted == "true", f'[{{"kind": "gap", "location": "", "detail": "{k % 2}"}}]').otherwise("[]")
        raw = F.concat(F.lit('{"refuted": '), refuted, F.lit(', "evidence_refs": [{"source": "ledger", "snippet": "'), ledger, F.lit('"}, {"source": "slip", "snippet": "'), slip, F.lit('"}], "findings": '), found, F.lit(', "reasoning": "seen"}'))
        return F.struct(F.lit(k).alias("call_idx"), raw.alias("raw"))

    responses = rows.select(c("o_orderkey").alias("case_id"), F.explode(F.array(*map(answer, range(4)))).alias("r")).select("case_id", "r.*")
    return _result(adjudicate(cases, responses, SETTLEMENT_RULES))


def _reviewer(prompts: list[str]) -> list[str]:
    """A judge by rule: the length of the content's first word and the gaps told so far decide what it says."""
    out = []
    for p in prompts:
        word = re.search("[A-Za-z]*", re.search("### content\n[^A-Za-z]*(.*)", p, re.S)[1])[0]
        gaps = len(re.findall(r"^- \[gap\]", p, re.M))
        refuted = (len(word) + gaps) % 2 == 1 if "### sourced:" in p else len(word) % 3 == 0 and gaps < 2
        detail = "d0" if len(word) % 5 == 0 else f"d{gaps % 2}"
        found = f'[{{"kind": "gap", "location": "t0", "detail": "{detail}"}}]' if refuted else "[]"
        out.append(f'{{"refuted": {str(refuted).lower()}, "evidence_refs": [{{"source": "content", "snippet": "{word}"}}], "findings": {found}, "reasoning": "read"}}')
    return out


def q_adjudicate_live(spark, sf_dir):
    """A judge that is asked round by round, and hears of the gaps it has found."""
    return _result(adjudicate_live(conversation_cases(spark, sf_dir), DESK_RULES, _reviewer))


def q_no_backend(spark, sf_dir):
    return _result(adjudicate_live(conversation_cases(spark, sf_dir), DESK_RULES, None))


def q_no_procedure(spark, sf_dir):
    return _result(adjudicate(conversation_cases(spark, sf_dir), conversation_responses(spark, sf_dir), None))


def u_judge_udf(spark, sf_dir):
    """A deterministic judge in Python batches: refutes what is too short to be judged."""

    def judge(prompts: list[str]) -> list[str]:
        return ["Refuted" if len(p) < 60 else "Not Refuted" for p in prompts]

    prepare(spark)
    rows = judge_with(table(spark, sf_dir, "conversations").select("conv_id", "turn", c("text").alias("prompt")), judge)
    return rows.select("conv_id", "turn", parse_verdict(c("raw"))["refuted"].alias("refuted"))


def q_escalations(spark, sf_dir):
    """Statutes are return flags, each with a limit from the catalog; an order's lines are its violations."""
    lines = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("case_id"), c("l_returnflag").alias("statute"))
    rule = F.struct(F.when(c("statute") == "N", 4).otherwise(2).alias("max_violations"), F.when(c("statute") == "R", "block").otherwise("flag").alias("action"), F.lit(None).cast("string").alias("escalate_to"))
    statutes = lines.select("statute").distinct().select(c("statute").alias("name"), rule.alias("escalation"))
    return extensions.escalations(lines, statutes).select("case_id", "statute", "n", "action")


# ---------------------------------------------------------------- streams


def _closed(spark, sf_dir, job):
    """What a windowed job has appended once the watermark has closed all windows of the events."""
    return streams.delivered([table(spark, sf_dir, "events"), streams.end_mark(spark)], job)


def s_tumbling(spark, sf_dir):
    return _closed(spark, sf_dir, streams.tumbling_counts)


def s_sliding(spark, sf_dir):
    return _closed(spark, sf_dir, streams.sliding_counts)


def s_session(spark, sf_dir):
    return _closed(spark, sf_dir, streams.sessions)


def s_dedup(spark, sf_dir):
    return streams.drained(streams.distinct_events(streams.event_stream(spark, sf_dir)).select("event_id", "user_id", "event_type"), "append")


def s_stall(spark, sf_dir):
    return streams.drained(streams.stalled_events(streams.event_stream(spark, sf_dir)), "append").select("user_id", "event_id", c("run").cast("long").alias("run"))


def s_late(spark, sf_dir):
    """Every tenth event is delivered after all others: those whose day the watermark has closed come too late."""
    rows = table(spark, sf_dir, "events")
    return streams.delivered([rows.where("event_id % 10 <> 0"), rows.where("event_id % 10 = 0")], streams.tumbling_counts)


def s_stall_batches(spark, sf_dir):
    """The first half of the time, then the second: a user's run goes on from one delivery to the next."""
    rows = table(spark, sf_dir, "events")
    half = F.expr("timestamp_ntz '2024-01-15 00:00:00'")
    return streams.delivered([rows.where(c("ts") < half), rows.where(c("ts") >= half)], streams.stalled_events).select("user_id", "event_id", c("run").cast("long").alias("run"))


def s_catalog(spark, sf_dir):
    """Edits of a catalog (each part sets its brand's entry) in two deliveries, the later half first."""
    rows = table(spark, sf_dir, "part").select(c("p_brand").alias("name"), c("p_partkey").alias("ord"), "p_type", "p_size")
    half = rows.agg(F.max("ord")).first()[0] // 2
    return upserts.upserted_in_batches([rows.where(c("ord") > half), rows.where(c("ord") <= half)]).select("name", "ord", "p_type", "p_size")


def s_stall_ordered(spark, sf_dir):
    """Events come up to twelve hours late, in four deliveries that overlap in time: state puts them in order."""
    rows = table(spark, sf_dir, "events")
    comes = c("ts") + F.make_dt_interval(secs=(c("event_id") * 7919 % 43200).cast("decimal(18,6)"))
    days = [F.expr(f"timestamp_ntz '2024-01-{d} 00:00:00'") for d in ("08", "15", "22")]
    parts = [rows.where(comes < days[0]), *(rows.where((comes >= a) & (comes < b)) for a, b in zip(days, days[1:])), rows.where(comes >= days[-1]), streams.end_mark(spark)]
    return streams.delivered(parts, streams.ordered_stalls, streams.STATE_STORE).select("user_id", "event_id", c("run").cast("long").alias("run"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:2] in ("q_", "s_", "u_")}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge texts of labelled documents to dispositions, by language."""
    rows = _overridden(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang", terminal_disposition(c("o")).alias("disposition")).agg(F.count("*").alias("n"))
