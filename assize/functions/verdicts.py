"""Judge texts to typed verdicts, in three tiers that end in a rejection, and order-free fingerprints of findings."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import json_body, let, strip, terminal_token

REF = "struct<source:string,location:string,snippet:string,kind:string>"
FINDING = "struct<kind:string,location:string,detail:string>"
VERDICT = (
    f"struct<finding:string,refuted:boolean,confidence:string,blocking:boolean,blocking_kind:string,evidence_refs:array<{REF}>,"
    f"findings:array<{FINDING}>,reasoning:string,details_md:string,fallback_note:string,tier:int,refuted_coerced:boolean>"
)
#: Fixed values of the verdict format.
CONFIDENCE = ("high", "medium", "low")
UNKNOWN = "unknown"
BLOCKING_KINDS = ("none", "contradiction", "unverifiable")
TOKEN_NOTE = "verdict JSON missing/malformed; used terminal token"
REJECT_NOTE = "verdict JSON missing AND terminal token unrecognised"


def prepare(spark: SparkSession) -> None:
    """Parsing keeps the last of repeated JSON keys, which Spark's Variant refuses unless told so."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def confidence(x: Column) -> Column:
    """high, medium or low whatever the case and the white space around; anything else, null too, is unknown."""
    return let(F.lower(strip(x)), lambda c: F.when(c.isin(*CONFIDENCE), c).otherwise(F.lit(UNKNOWN)))


def blocking_kind(x: Column) -> Column:
    """A known blocking kind, else none."""
    return F.when(x.isin(*BLOCKING_KINDS), x).otherwise(F.lit("none"))


def strict_object(body: Column) -> Column:
    """The variant of a text that is one JSON object and nothing else; null otherwise.

    The parser alone would accept text behind the first value; inside brackets, only a single value makes one element."""
    boxed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    return let(boxed.try_cast("array<variant>"), lambda a: F.when(F.size(a) == 1, F.get(a, 0)))


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _string(v: Column, default: str) -> Column:
    """A string field; absent gives the default, any other type a blank."""
    return F.when(v.isNull(), F.lit(default)).when(_kind(v) == "STRING", v.try_cast("string")).otherwise(F.lit(""))


def _items(v: Column) -> Column:
    """Elements of a list field: none if absent, null if it is no list of objects."""
    cast = v.try_cast("array<variant>")
    objects = F.forall(cast, lambda x: F.coalesce(_kind(x) == "OBJECT", F.lit(False)))
    return F.when(v.isNull(), F.array().cast("array<variant>")).when((_kind(v) == "ARRAY") & objects, cast)


def is_blank_finding(f: Column) -> Column:
    return (strip(f["kind"]) == "") & (strip(f["location"]) == "") & (strip(f["detail"]) == "")


def _from_object(v: Column) -> Column:
    """The verdict of an object, or null if a field has a shape that no verdict has."""

    def built(p: Column) -> Column:
        refs = F.transform(p["refs"], lambda r: F.struct(*(_string(_field(r, n), d).alias(n) for n, d in (("source", ""), ("location", ""), ("snippet", ""), ("kind", "text")))))
        texts = F.forall(p["found"], lambda f: F.forall(F.array(*(F.coalesce(_kind(_field(f, n)), F.lit("STRING")) for n in ("kind", "location", "detail"))), lambda k: k == "STRING"))
        found = F.filter(F.transform(p["found"], lambda f: F.struct(*(_string(_field(f, n), "").alias(n) for n in ("kind", "location", "detail")))), lambda f: ~is_blank_finding(f))
        refuted, sure, kind = _field(v, "refuted"), _field(v, "confidence"), _string(_field(v, "blocking"), "none")
        is_false = F.coalesce((_kind(refuted) == "BOOLEAN") & ~refuted.try_cast("boolean"), F.lit(False))
        fits = p["refs"].isNotNull() & p["found"].isNotNull() & texts & (sure.isNull() | (_kind(sure) == "STRING"))
        made = F.struct(
            _string(_field(v, "finding"), "").alias("finding"), (~is_false).alias("refuted"), confidence(_string(sure, "medium")).alias("confidence"),
            (blocking_kind(kind) != "none").alias("blocking"), blocking_kind(kind).alias("blocking_kind"), refs.alias("evidence_refs"), found.alias("findings"),
            _string(_field(v, "reasoning"), "").alias("reasoning"), _string(_field(v, "details_md"), "").alias("details_md"), F.lit(None).cast("string").alias("fallback_note"),
            F.lit(1).alias("tier"), (refuted.isNotNull() & (_kind(refuted) != "BOOLEAN")).alias("refuted_coerced"),
        )
        return F.when(fits, made.cast(VERDICT))

    return F.when(v.isNotNull(), let(F.struct(_items(_field(v, "evidence_refs")).alias("refs"), _items(_field(v, "findings")).alias("found")), built))


def plain_verdict(finding: str, refuted: bool, blocking: bool, note: str | None, tier: int, reasoning: str = "", sure: str = UNKNOWN) -> Column:
    """A verdict without citations or findings."""
    return F.struct(
        F.lit(finding).alias("finding"), F.lit(refuted).alias("refuted"), F.lit(sure).alias("confidence"), F.lit(blocking).alias("blocking"), F.lit("none").alias("blocking_kind"),
        F.array().cast(f"array<{REF}>").alias("evidence_refs"), F.array().cast(f"array<{FINDING}>").alias("findings"), F.lit(reasoning).alias("reasoning"), F.lit("").alias("details_md"),
        F.lit(note).cast("string").alias("fallback_note"), F.lit(tier).alias("tier"), F.lit(False).alias("refuted_coerced"),
    ).cast(VERDICT)


def parse_verdict(raw: Column) -> Column:
    """A verdict struct for any text: from its JSON object, else from its terminal token, else a blocking rejection.

    Only the JSON value false passes; a missing or any other value of `refuted` refutes, and refuted_coerced says so. Null
    texts are rejected. A NaN in the JSON makes it malformed."""
    return F.coalesce(
        let(strict_object(json_body(raw)), _from_object),
        let(terminal_token(raw), lambda t: F.when(t, plain_verdict("unknown", True, False, TOKEN_NOTE, 2)).when(~t, plain_verdict("none", False, False, TOKEN_NOTE, 2))),
        plain_verdict("parse_failure", True, True, REJECT_NOTE, 3),
    )


def fingerprint(findings: Column) -> Column:
    """16 hexadecimal digits that don't depend on the findings' order; '' if all are blank. Repeats count."""
    tokens = F.transform(F.filter(findings, lambda f: ~is_blank_finding(f)), lambda f: F.concat(f["kind"], F.lit(":"), f["location"], F.lit(":"), f["detail"]))
    return F.when(F.coalesce(F.size(tokens), F.lit(0)) <= 0, F.lit("")).otherwise(F.substring(F.sha2(F.array_join(F.sort_array(tokens), "|"), 256), 1, 16))


def decisive(v: Column) -> Column:
    """Refuted with high confidence, and not blocking."""
    return v["refuted"] & (v["confidence"] == "high") & ~v["blocking"]


def verdict_json(v: Column) -> Column:
    """The eight public fields."""
    names = ("finding", "refuted", "confidence", "blocking", "blocking_kind", "evidence_refs", "findings", "reasoning")
    return F.to_json(F.struct(*(v[n].alias(n) for n in names)), {"ignoreNullFields": "false"})


def route(v: Column) -> Column:
    return F.when(v["blocking"], F.lit("blocked")).when(v["refuted"], F.lit("refuted")).otherwise(F.lit("not_refuted"))


def terminal_disposition(v: Column) -> Column:
    return F.when(~v["refuted"], F.lit("approved")).when(v["blocking"], F.lit("blocked")).otherwise(F.lit("rejected"))
