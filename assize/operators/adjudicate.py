"""Cases through a procedure to a disposition.

`advance` is one round for one case, as an expression over the case's state: CODE steps update its data, JUDGMENT steps take
a verdict, check its evidence against the case's own texts, watch for stalls and follow the edge of its route. With scripted
responses a case is one fold of `advance` over its verdicts, without a shuffle after they have met; with a live judge each
round is a pass over the open cases, written once, so that nothing that follows asks again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assize.functions.evidence import all_cited, evidence_reason, judgment_prompt
from assize.functions.text import let
from assize.functions.verdicts import FINDING, VERDICT, fingerprint, is_blank_finding, parse_verdict, plain_verdict, prepare, route, terminal_disposition
from assize.operators.procedure import CODE, JUDGMENT, Procedure
from assize.operators.stalls import run_step
from assize.sources.shared import kept

#: What a scripted judge says once its responses are used up (a fixed text of the format).
DEFAULT_RESPONSE = (
    '{"finding": "none", "refuted": false, "blocking": "none", "confidence": "high", '
    '"evidence_refs": [{"source": "mock", "location": "N/A", "snippet": "mock"}], "reasoning": "Mock default — all checks passed."}'
)
STATE = (
    "struct<step:string,round:int,calls:int,last:string,run:int,data:map<string,string>,sources:map<string,string>,"
    f"disposition:string,reason:string,history:array<string>,verdicts:array<{VERDICT}>,blocking_approved:boolean>"
)


@dataclass(frozen=True)
class Statute:
    """What adjudication reads of a statute."""

    name: str
    description: str = ""
    required_evidence: tuple[str, ...] = ()
    default_to_reject: bool = True
    violations: tuple[tuple[str, str, str], ...] = ()


@dataclass(frozen=True)
class Rules:
    """A procedure with its catalog; None takes the procedure's own limits."""

    procedure: Procedure
    statutes: tuple[Statute, ...] = ()
    max_rounds: int | None = None
    stall_threshold: int | None = None
    by_name: dict[str, Statute] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "by_name", {s.name: s for s in self.statutes})

    @property
    def rounds(self) -> int:
        return self._limit(self.max_rounds, self.procedure.max_rounds)

    @property
    def threshold(self) -> int:
        return self._limit(self.stall_threshold, self.procedure.stall_threshold)

    @staticmethod
    def _limit(own: int | None, procedure: int) -> int:
        return procedure if own is None else own

    def of_step(self, name: str) -> list[Statute]:
        """A step's statutes in its order; unknown names are dropped, repeated ones kept."""
        return [self.by_name[n] for n in self.procedure.by_name[name].statutes if n in self.by_name]

    def judgment_steps(self) -> list[str]:
        return [s.name for s in self.procedure.by_name.values() if s.kind == JUDGMENT]


def with_override(verdict: Column, facts: Column) -> Column:
    """The verdict under struct<why,untrue>: blocked where `why` says what evidence is missing, refuted where a citation is
    untrue."""
    short = facts["why"] != ""
    new = {
        "refuted": verdict["refuted"] | short | facts["untrue"], "blocking": verdict["blocking"] | short,
        "fallback_note": F.when(short, F.concat(F.lit("Evidence insufficient: "), facts["why"])).otherwise(verdict["fallback_note"]),
    }
    names = ("finding", "refuted", "confidence", "blocking", "blocking_kind", "evidence_refs", "findings", "reasoning", "details_md", "fallback_note", "tier", "refuted_coerced")
    return F.struct(*((new.get(n, verdict[n])).alias(n) for n in names))


def overridden(rules: Rules, step: Column, verdict: Column, sources: Column) -> Column:
    """The verdict after both evidence checks: the first statute whose required evidence isn't cited makes it blocking, and
    a citation that doesn't hold refutes it if any of the step's statutes rejects by default."""
    reason, strict = F.lit(""), F.lit(False)
    for name in rules.judgment_steps():
        laws = rules.of_step(name)
        checks = [evidence_reason(verdict["evidence_refs"], F.array(*map(F.lit, s.required_evidence)), 1) for s in laws if s.required_evidence]
        failed = F.coalesce(*(F.nullif(c, F.lit("")) for c in checks), F.lit("")) if checks else F.lit("")
        reason = F.when(step == name, failed).otherwise(reason)
        strict = F.when(step == name, F.lit(any(s.default_to_reject for s in laws))).otherwise(strict)
    facts = F.struct(reason.alias("why"), (strict & ~all_cited(verdict["evidence_refs"], sources)).alias("untrue"))

    return let(facts, lambda f: with_override(verdict, f))


def opened(rules: Rules, data: Column) -> Column:
    """The state of a case before its first round; its texts are its first sources."""
    data = F.coalesce(data, F.create_map().cast("map<string,string>"))
    known = F.map_filter(data, lambda k, v: v.isNotNull())
    values = {
        "step": F.lit(rules.procedure.initial_step), "round": F.lit(0), "calls": F.lit(0), "last": F.lit(None).cast("string"), "run": F.lit(0), "data": data, "sources": known,
        "disposition": F.lit(None).cast("string"), "reason": F.lit(None).cast("string"), "history": F.array().cast("array<string>"), "verdicts": F.array().cast(f"array<{VERDICT}>"), "blocking_approved": F.lit(False),
    }
    return F.struct(*(v.alias(k) for k, v in values.items())).cast(STATE)


def _with(state: Column, **new: Column) -> Column:
    names = ("step", "round", "calls", "last", "run", "data", "sources", "disposition", "reason", "history", "verdicts", "blocking_approved")
    # Without a cast: it would copy all verdicts so far in every round.
    return F.struct(*(new.get(n, state[n]).alias(n) for n in names))


def advance(rules: Rules, state: Column, verdict: Column) -> Column:
    """One round. `verdict` is the parsed answer to this case's next call; it is used only at JUDGMENT steps."""
    p = rules.procedure
    begun = {"round": state["round"] + 1, "history": F.concat(state["history"], F.array(state["step"]))}

    def code(_: Column) -> Column:
        data = p.updated(state["step"], state["data"])
        nxt = p.next_of(state["step"], F.lit("done"))
        fresh = F.map_filter(data, lambda k, v: v.isNotNull())
        kept = F.map_filter(state["sources"], lambda k, v: ~F.map_contains_key(fresh, k))
        ended = nxt.isNull()
        return _with(
            state, **begun, data=data, sources=F.map_concat(kept, fresh), step=F.coalesce(nxt, state["step"]), disposition=F.when(ended, state["step"]),
            reason=F.when(ended, F.concat(F.lit("Procedure ended at terminal step '"), state["step"], F.lit("'"))),
        )

    def judged(v: Column) -> Column:
        def routed(x: Column) -> Column:
            fp, way = x["fp"], x["way"]
            seen = run_step(F.struct(state["last"].alias("last"), state["run"].alias("run")), fp)
            nxt = p.next_of(state["step"], way)

            def end(s: Column) -> Column:
                stalled = (fp != "") & (s["run"] >= rules.threshold)
                final = nxt.isNull()
                return _with(
                    state, **begun, calls=state["calls"] + 1, last=s["last"], run=s["run"], verdicts=F.concat(state["verdicts"], F.array(v)), step=F.coalesce(nxt, state["step"]),
                    disposition=F.when(stalled, F.lit("stalled")).when(final, terminal_disposition(v)),
                    reason=F.when(stalled, F.concat(F.lit("Same gap fingerprint appeared "), s["run"].cast("string"), F.lit(" consecutive times"))).when(final, v["reasoning"]),
                    blocking_approved=state["blocking_approved"] | (~stalled & final & v["blocking"] & ~v["refuted"]),
                )

            return let(seen, end)

        return let(F.struct(fingerprint(v["findings"]).alias("fp"), route(v).alias("way")), routed)

    nothing = F.lit(0)
    is_code = p.kind_of(state["step"]) == CODE
    moved = F.when(is_code, code(nothing)).otherwise(let(overridden(rules, state["step"], verdict, state["sources"]), judged))
    return F.when(state["disposition"].isNotNull(), state).otherwise(moved)


def closed(rules: Rules, rows: DataFrame, case: str) -> DataFrame:
    """Results of cases whose `state` has gone through all rounds."""
    s = F.col("state")
    late = s["disposition"].isNull()
    return rows.select(
        case, F.coalesce(s["disposition"], F.lit("max_rounds")).alias("final_disposition"),
        F.when(late, F.lit(f"Procedure did not converge within {rules.rounds} rounds")).otherwise(s["reason"]).alias("reason"),
        s["round"].alias("round_count"), F.size(s["verdicts"]).alias("n_verdicts"), s["history"].alias("step_history"), s["verdicts"].alias("verdicts"), s["blocking_approved"].alias("blocking_approved"),
    )


def with_case_ids(cases: DataFrame, data: str = "data", case: str = "case_id") -> DataFrame:
    """`cases` with an id of 12 hexadecimal digits from their data, for cases without a key of their own. Unlike a random
    id it is the same whenever a task runs again; equal data have equal ids."""
    entries = F.sort_array(F.map_entries(F.col(data)))
    return cases.withColumn(case, F.substring(F.sha2(F.coalesce(F.to_json(entries), F.lit("")), 256), 1, 12))


def unheard(cases: DataFrame, case: str = "case_id") -> DataFrame:
    """The results of cases for which no procedure is defined: rejected, before any round."""
    none = F.array().cast(f"array<{VERDICT}>")
    return cases.select(
        case, F.lit("rejected").alias("final_disposition"), F.lit("No procedure defined").alias("reason"), F.lit(0).alias("round_count"), F.lit(0).alias("n_verdicts"),
        F.array().cast("array<string>").alias("step_history"), none.alias("verdicts"), F.lit(False).alias("blocking_approved"),
    )


def adjudicate(cases: DataFrame, responses: DataFrame, rules: Rules | None, case: str = "case_id") -> DataFrame:
    """Results of `cases` (case, data map<string,string>) under scripted `responses` (case, call_idx, raw): the k-th call of
    a case gets its k-th response in the order of call_idx, then the default response.

    Texts are parsed where they lie; then a case's verdicts meet once, and the rest is a fold in the row."""
    if rules is None:
        return unheard(cases, case)
    prepare(cases.sparkSession)
    spoken = responses.select(case, "call_idx", parse_verdict(F.col("raw")).alias("v"))
    heard = spoken.groupBy(case).agg(F.transform(F.sort_array(F.collect_list(F.struct("call_idx", "v"))), lambda x: x["v"]).alias("_said"))
    rows = cases.select(case, "data").join(heard, case, "left")
    none = F.array().cast(f"array<{VERDICT}>")
    rows = rows.withColumn("_said", F.coalesce("_said", none)).withColumn("_default", parse_verdict(F.lit(DEFAULT_RESPONSE)))
    # What a round reads of an answer is worked out once for each answer, not in each round.
    rows = rows.withColumn("_facts", F.transform("_said", lambda v: facts_of(rules, v))).withColumn("_default_facts", facts_of(rules, F.col("_default")))

    def round_(state: Column, _: Column) -> Column:
        moved = let(F.coalesce(F.get(F.col("_facts"), state["calls"]), F.col("_default_facts")), lambda f: _step(rules, state, f))
        return F.when(state["disposition"].isNotNull(), state).otherwise(moved)

    turns = F.sequence(F.lit(1), F.lit(rules.rounds)) if rules.rounds > 0 else F.array().cast("array<int>")
    done = rows.withColumn("_end", F.aggregate(turns, _begun(rules, F.col("data")), round_))
    # The k-th verdict is the k-th answer under what its round found.
    verdicts = F.transform(F.col("_end.held"), lambda h, i: with_override(F.coalesce(F.get(F.col("_said"), i), F.col("_default")), h))
    fields = {n: F.col(f"_end.{n}") for n in ("disposition", "reason", "round", "history", "blocking_approved")} | {"verdicts": verdicts}
    return closed(rules, done.withColumn("state", F.struct(*(v.alias(k) for k, v in fields.items()))), case)


# ---------------------------------------------------------------- the fold


def facts_of(rules: Rules, v: Column) -> Column:
    """What rounds read of a verdict: its fingerprint, flags, reasoning and citations, and for each JUDGMENT step what evidence is
    missing under its statutes."""
    whys = {}
    for name in rules.judgment_steps():
        checks = [evidence_reason(v["evidence_refs"], F.array(*map(F.lit, s.required_evidence)), 1) for s in rules.of_step(name) if s.required_evidence]
        if checks:
            whys[name] = F.coalesce(*(F.nullif(c, F.lit("")) for c in checks), F.lit(""))
    why = F.create_map(*(x for k, c in whys.items() for x in (F.lit(k), c))) if whys else F.create_map().cast("map<string,string>")
    return F.struct(fingerprint(v["findings"]).alias("fp"), v["refuted"].alias("refuted"), v["blocking"].alias("blocking"), v["reasoning"].alias("reasoning"), v["evidence_refs"].alias("refs"), why.alias("whys"))


_SLIM = (
    "struct<step:string,round:int,calls:int,last:string,run:int,data:map<string,string>,sources:map<string,string>,disposition:string,reason:string,history:array<string>,"
    "held:array<struct<why:string,untrue:boolean>>,blocking_approved:boolean>"
)
_SLIM_FIELDS = ("step", "round", "calls", "last", "run", "data", "sources", "disposition", "reason", "history", "held", "blocking_approved")


def _begun(rules: Rules, data: Column) -> Column:
    data = F.coalesce(data, F.create_map().cast("map<string,string>"))
    null, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    held = F.array().cast("array<struct<why:string,untrue:boolean>>")
    values = (F.lit(rules.procedure.initial_step), F.lit(0), F.lit(0), null, F.lit(0), data, F.map_filter(data, lambda k, v: v.isNotNull()), null, null, none, held, F.lit(False))
    return F.struct(*(v.alias(k) for k, v in zip(_SLIM_FIELDS, values))).cast(_SLIM)


def _step(rules: Rules, state: Column, f: Column) -> Column:
    """One round of the fold, as `advance`; `f` are the facts of the case's next answer."""
    p = rules.procedure
    begun = {"round": state["round"] + 1, "history": F.concat(state["history"], F.array(state["step"]))}
    made = lambda **new: F.struct(*((begun | new).get(n, state[n]).alias(n) for n in _SLIM_FIELDS))

    def code() -> Column:
        data, nxt = p.updated(state["step"], state["data"]), p.next_of(state["step"], F.lit("done"))
        fresh = F.map_filter(data, lambda k, v: v.isNotNull())
        sources = F.map_concat(F.map_filter(state["sources"], lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
        ended = nxt.isNull()
        return made(
            data=data, sources=sources, step=F.coalesce(nxt, state["step"]), disposition=F.when(ended, state["step"]),
            reason=F.when(ended, F.concat(F.lit("Procedure ended at terminal step '"), state["step"], F.lit("'"))),
        )

    strict = [name for name in rules.judgment_steps() if any(s.default_to_reject for s in rules.of_step(name))]
    why = F.coalesce(F.try_element_at(f["whys"], state["step"]), F.lit(""))
    untrue = F.when(state["step"].isin(*strict), ~all_cited(f["refs"], state["sources"])).otherwise(F.lit(False)) if strict else F.lit(False)

    def judged(h: Column) -> Column:
        refuted, blocking = f["refuted"] | (h["why"] != "") | h["untrue"], f["blocking"] | (h["why"] != "")
        flags = {"refuted": refuted, "blocking": blocking}
        seen = run_step(F.struct(state["last"].alias("last"), state["run"].alias("run")), f["fp"])
        nxt = p.next_of(state["step"], route(flags))

        def end(x: Column) -> Column:
            s, n = x["seen"], x["nxt"]
            stalled, final = (f["fp"] != "") & (s["run"] >= rules.threshold), n.isNull()
            return made(
                calls=state["calls"] + 1, last=s["last"], run=s["run"], held=F.concat(state["held"], F.array(h)), step=F.coalesce(n, state["step"]),
                disposition=F.when(stalled, F.lit("stalled")).when(final, terminal_disposition(flags)),
                reason=F.when(stalled, F.concat(F.lit("Same gap fingerprint appeared "), s["run"].cast("string"), F.lit(" consecutive times"))).when(final, f["reasoning"]),
                blocking_approved=state["blocking_approved"] | (~stalled & final & blocking & ~refuted),
            )

        return let(F.struct(seen.alias("seen"), nxt.alias("nxt")), end)

    return F.when(p.kind_of(state["step"]) == CODE, code()).otherwise(let(F.struct(why.alias("why"), untrue.alias("untrue")), judged))


# ---------------------------------------------------------------- live judges


def judge_with(rows: DataFrame, judge: Callable[[list[str]], list[str]], prompt: str = "prompt", out: str = "raw") -> DataFrame:
    """`rows` with the judge's answers, asked in batches inside each partition; None answers become ''.

    Asking is a side effect: write the result before using it twice."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != out) + f", `{out}` string"
    rows = rows.drop(out)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: [x or "" for x in judge(b[prompt].tolist())]})

    return rows.mapInPandas(ask, schema)


def prompt_of(rules: Rules, state: Column, order: tuple[str, ...] = ()) -> Column:
    """The prompt at a JUDGMENT step. Data fields come in `order`, the others after them by name."""
    data = state["data"]
    keys = F.concat(F.filter(F.array(*map(F.lit, order)) if order else F.array().cast("array<string>"), lambda k: F.map_contains_key(data, k)), F.filter(F.sort_array(F.map_keys(data)), lambda k: ~k.isin(*order) if order else F.lit(True)))
    fields = F.transform(keys, lambda k: F.struct(k.alias("name"), F.coalesce(F.try_element_at(data, k), F.lit("None")).alias("value")))
    law = "array<struct<name:string,description:string,required_evidence:array<string>,default_to_reject:boolean,violations:array<struct<name:string,severity:string,description:string>>>>"
    laws = F.array().cast(law)
    for name in rules.judgment_steps():
        found = [
            F.struct(F.lit(s.name).alias("name"), F.lit(s.description).alias("description"), F.array(*map(F.lit, s.required_evidence)).cast("array<string>").alias("required_evidence"), F.lit(s.default_to_reject).alias("default_to_reject"),
                     F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("name", "severity", "description"), v))) for v in s.violations)).cast("array<struct<name:string,severity:string,description:string>>").alias("violations"))
            for s in rules.of_step(name)
        ]
        laws = F.when(state["step"] == name, F.array(*found).cast(law)).otherwise(laws)
    gaps = F.filter(F.flatten(F.transform(state["verdicts"], lambda v: v["findings"])), lambda f: ~is_blank_finding(f)).cast(f"array<{FINDING}>")
    return judgment_prompt(fields, laws, gaps)


def adjudicate_live(cases: DataFrame, rules: Rules, judge: Callable[[list[str]], list[str]] | None, case: str = "case_id", order: tuple[str, ...] = (), keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Results of `cases` under a live judge, round by round; None judges nothing and blocks (finding no_llm).

    `keep` makes a round durable, its answers with it (by default a table in the shared folder): cases that are decided leave the
    loop, which ends once none is open, and no later round asks again. `hearings.hear` does so for many procedures, and with a
    ledger that outlives a hearing."""
    prepare(cases.sparkSession)
    keep = keep or kept
    s = F.col("state")
    rows = cases.select(case, opened(rules, F.col("data")).alias("state"))
    done = None
    for _ in range(rules.rounds):
        asks = rules.procedure.kind_of(s["step"]) == JUDGMENT
        if judge is None:
            rows = rows.withColumn("raw", F.lit(None).cast("string"))
            verdict = plain_verdict("no_llm", True, True, None, 0, "No LLM backend configured", "medium")
        else:
            silent = rows.where(~asks).withColumn("raw", F.lit(None).cast("string"))
            spoken = judge_with(rows.where(asks).withColumn("prompt", prompt_of(rules, s, order)), judge).drop("prompt")
            rows = silent.unionByName(spoken)
            verdict = parse_verdict(F.col("raw"))
        # Written once a round: that asks, and an unrolled plan would grow with the number of rounds.
        # The verdict is a column of its own: as an expression it would stand in the plan wherever a round reads of it.
        rows = keep(rows.withColumn("_verdict", verdict).select(case, advance(rules, s, F.col("_verdict")).alias("state")))
        decided = rows.where(s["disposition"].isNotNull())
        done = decided if done is None else done.unionByName(decided)
        rows = rows.where(s["disposition"].isNull())
        if rows.isEmpty():
            break
    return closed(rules, rows if done is None else done.unionByName(rows), case)
