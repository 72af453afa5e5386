"""Text functions with the white space, line and substring rules that verdict texts need. All are Columns in, Column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All 29 white-space characters of Unicode, as a class of Java's regular expressions.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Every line end: CR LF, and the single ones, separators \x1c to \x1e and U+2028, U+2029 included.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for a row, lambdas included."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(x: Column) -> Column:
    """x without white space at its ends (trim() knows only the space)."""
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def blank(x: Column) -> Column:
    return strip(x) == ""


def lines(x: Column) -> Column:
    return F.split(x, LINE_END)


def truncated(x: Column, limit: int = 2000, marker: str = "\n... (truncated)") -> Column:
    """At most `limit` code points, with a marker if anything was cut."""
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit(marker))).otherwise(x)


def json_body(raw: Column) -> Column:
    """The text's JSON object: that of the first code fence that holds one, else from the first { to the last }. Null if
    there is none. A fence wins even if what it holds turns out to be malformed."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?" + SPACE + r"*(\{.*?\})" + SPACE + r"*```", 1)
    bare = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(bare, F.lit("")))


REFUTED, NOT_REFUTED = "Refuted", "Not Refuted"


def terminal_token(raw: Column) -> Column:
    """True for the first line that says Refuted, false for Not Refuted, null if no line does; case counts. Back quotes
    around a line and . or ! behind it don't; lines that open or close a fence are passed over."""
    bare = lambda x: strip(F.regexp_replace(F.regexp_replace(x, "^`+|`+$", ""), "[.!]+$", ""))
    kept = F.filter(F.transform(lines(raw), strip), lambda x: (x != "") & ~F.startswith(x, F.lit("```")))
    said = F.filter(F.transform(kept, bare), lambda x: x.isin(REFUTED, NOT_REFUTED))
    return F.get(said, 0) == REFUTED
