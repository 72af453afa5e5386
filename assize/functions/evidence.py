"""Checks of citations inside a row, and the prompt texts built from evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let, strip, truncated

PASSED = ""


def evidence_reason(refs: Column, required: Column, least: Column | int = 1, verifiable: bool = True) -> Column:
    """'' if the citations satisfy a rule, else its first failure: none at all, a required source that isn't cited (in the
    rule's order), too few, or a blank snippet (in the citations' order)."""
    least = F.lit(least) if isinstance(least, int) else least
    required = F.coalesce(required, F.array().cast("array<string>"))

    def checked(r: Column) -> Column:
        cited = F.transform(r, lambda x: x["source"])
        missing = F.filter(required, lambda s: ~F.coalesce(F.array_contains(cited, s), F.lit(False)))
        empty = F.filter(r, lambda x: F.coalesce(blank(x["snippet"]), F.lit(True)))
        out = (
            F.when((F.size(r) == 0) & (least > 0), F.lit("no evidence refs provided"))
            .when(F.size(missing) > 0, F.concat(F.lit("required source '"), F.get(missing, 0), F.lit("' not cited")))
            .when(F.size(r) < least, F.concat(F.lit("only "), F.size(r).cast("string"), F.lit(" citations, need at least "), least.cast("string")))
        )
        if verifiable:
            out = out.when(F.size(empty) > 0, F.concat(F.lit("evidence from '"), F.coalesce(F.get(empty, 0)["source"], F.lit("")), F.lit("' has empty snippet")))
        return out.otherwise(F.lit(PASSED))

    return let(refs, checked)


def cited(snippet: Column, content: Column) -> Column:
    """True if the stripped snippet is not blank and occurs in the source's content; false for an unknown source."""
    return F.coalesce(~blank(snippet) & F.contains(content, strip(snippet)), F.lit(False))


def all_cited(refs: Column, sources: Column) -> Column:
    """True if every citation holds against a map of sources; true for none."""
    return F.forall(refs, lambda r: cited(r["snippet"], F.try_element_at(sources, r["source"])))


def citation_failure(snippet: Column, source: Column) -> Column:
    return F.concat(F.lit("Unverifiable: '"), F.substring(snippet, 1, 60), F.lit("...' not found in '"), source, F.lit("'"))


def packet_section(objective: Column, artifacts: Column, gaps: Column) -> Column:
    """A packet as prompt text; artifacts: array<struct<name,content>> in order, gaps: array<string>."""
    shown = F.flatten(F.transform(artifacts, lambda a: F.array(F.concat(F.lit("\n### "), a["name"]), a["content"])))
    tail = F.when(F.size(gaps) > 0, F.concat(F.array(F.lit("\n## PRIOR GAPS (from previous rounds)")), F.transform(gaps, lambda g: F.concat(F.lit("- "), g)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.lit("## OBJECTIVE"), objective, F.lit(""), F.lit("## EVIDENCE")), shown, tail), "\n")


#: Fixed texts of the prompt format.
PROMPT_HEAD = "You are an adversarial judge applying hard constraints to agent output."
NO_OBJECTIVE = "(no objective specified)"
PROMPT_RULES = """## RULES
- Default to reject if uncertain.
- Every finding MUST cite specific evidence (source + location + snippet).
- Claims without verifiable evidence MUST be rejected.
- Do NOT re-litigate issues already resolved in prior rounds (anti-ratchet).
- Do NOT author new evidence — only audit what is provided.

## OUTPUT CONTRACT
You MUST output a JSON verdict object:
{
  "finding": "<violation type name or 'none'>",
  "refuted": true|false,
  "confidence": "high"|"medium"|"low",
  "blocking": "none"|"contradiction"|"unverifiable",
  "evidence_refs": [{"source": "...", "location": "...", "snippet": "...", "kind": "text"}],
  "reasoning": "<explanation>",
  "findings": [{"kind": "bug|gap|todo", "location": "path:line", "detail": "..."}]
}

Your terminal response must be EXACTLY one of:
Refuted
Not Refuted"""


def judgment_prompt(fields: Column, statutes: Column, gaps: Column) -> Column:
    """The judge's prompt: fields array<struct<name,value>> in order, statutes array<struct> of the catalog's columns, and
    gaps array<struct<kind,location,detail>> of earlier rounds (blank ones are left out by the caller)."""
    none = F.array().cast("array<string>")
    objective = F.coalesce(F.get(F.filter(fields, lambda f: f["name"] == "objective"), 0)["value"], F.lit(NO_OBJECTIVE))
    data = F.flatten(F.transform(fields, lambda f: F.array(F.concat(F.lit("### "), f["name"]), truncated(f["value"]), F.lit(""))))

    def law(s: Column) -> Column:
        checks = F.transform(s["violations"], lambda v: F.concat(F.lit("  - "), v["name"], F.lit(" ("), v["severity"], F.lit("): "), v["description"]))
        return F.concat(
            F.array(F.concat(F.lit("### "), s["name"], F.lit(": "), s["description"]), F.concat(F.lit("Required evidence: "), F.array_join(s["required_evidence"], ", "))),
            F.when(F.size(checks) > 0, F.concat(F.array(F.lit("Violations to check:")), checks)).otherwise(none),
            F.array(F.concat(F.lit("Default to reject: "), F.initcap(s["default_to_reject"].cast("string"))), F.lit("")),
        )

    laws = F.when(F.size(statutes) > 0, F.concat(F.array(F.lit("## APPLICABLE STATUTES")), F.flatten(F.transform(statutes, law)))).otherwise(none)
    told = F.transform(gaps, lambda g: F.concat(F.lit("- ["), g["kind"], F.lit("] "), g["location"], F.lit(": "), g["detail"]))
    prior = F.when(F.size(gaps) > 0, F.concat(F.array(F.lit("## PRIOR GAPS (from previous rounds)")), told, F.array(F.lit("")))).otherwise(none)
    head = F.array(F.lit(PROMPT_HEAD), F.lit(""), F.lit("## OBJECTIVE"), objective, F.lit(""), F.lit("## CASE DATA"))
    return F.array_join(F.concat(head, data, laws, prior, F.array(F.lit(PROMPT_RULES))), "\n")
