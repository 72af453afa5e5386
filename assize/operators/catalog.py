"""The rule catalog: statutes as a DataFrame, in and out of JSON, with upserts and ordered lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assize.operators.scans import numbered_in_order

VIOLATION = "struct<name:string,severity:string,description:string>"
ESCALATION = "struct<max_violations:int,action:string,escalate_to:string>"
FIELDS = f"name string, description string, threshold map<string,string>, required_evidence array<string>, violations array<{VIOLATION}>, escalation {ESCALATION}, default_to_reject boolean, blocking boolean"
#: Columns of a catalog; ord is the insertion order.
STATUTE = f"ord int, {FIELDS}"
_NAMES = ["name", "description", "threshold", "required_evidence", "violations", "escalation", "default_to_reject", "blocking"]


def with_defaults(rows: DataFrame) -> DataFrame:
    """Absent fields get their defaults; a row without a name, or with a violation without name or severity, is dropped."""
    c = F.col
    none = F.array().cast(f"array<{VIOLATION}>")
    checks = F.transform(F.coalesce("violations", none), lambda v: F.struct(v["name"].alias("name"), v["severity"].alias("severity"), F.coalesce(v["description"], F.lit("")).alias("description")))
    return rows.where(c("name").isNotNull()).where(F.forall(F.coalesce("violations", none), lambda v: v["name"].isNotNull() & v["severity"].isNotNull())).withColumns({
        "description": F.coalesce("description", F.lit("")), "threshold": F.coalesce("threshold", F.create_map().cast("map<string,string>")),
        "required_evidence": F.coalesce("required_evidence", F.array().cast("array<string>")), "violations": checks,
        "escalation": F.struct(F.coalesce("escalation.max_violations", F.lit(3)).alias("max_violations"), F.coalesce("escalation.action", F.lit("block")).alias("action"), c("escalation.escalate_to").alias("escalate_to")),
        "default_to_reject": F.coalesce("default_to_reject", F.lit(True)), "blocking": F.coalesce("blocking", F.lit(True)),
    })


def statutes_from_json(rows: DataFrame, column: str = "json", order: str = "ord") -> DataFrame:
    """One statute a row, from its JSON text."""
    return with_defaults(rows.select(F.col(order).cast("int").alias("ord"), F.from_json(column, FIELDS).alias("s")).select("ord", "s.*"))


def statute_json(prefix: str = "") -> Column:
    """All eight fields of a catalog row as JSON."""
    return F.to_json(F.struct(*(F.col(prefix + n).alias(n) for n in _NAMES)), {"ignoreNullFields": "false"})


def book_from_json(rows: DataFrame, column: str = "json", by: tuple[str, ...] = (), last: bool = True) -> DataFrame:
    """The statutes of {"statutes": [...]} texts, in order; a missing list is an empty book, later names win. Rows with other
    values of the columns `by` are books of their own; the parts of one book, if it is in several, follow each other by `part`.
    Without `last` all entries of a name stay, at their own places."""
    part = F.col("part") if "part" in rows.columns else F.lit(0)
    parsed = rows.select(*by, part.cast("int").alias("_part"), F.from_json(column, f"struct<statutes:array<struct<{', '.join(_colons())}>>>").alias("b"))
    # A place of a part: parts have fewer than 2^20 statutes.
    each = parsed.select(*by, "_part", F.posexplode("b.statutes").alias("pos", "s")).select(*by, (F.shiftleft(F.col("_part"), 20) + F.col("pos")).cast("int").alias("ord"), "s.*")
    entries = with_defaults(each)
    return upserted(entries, [*by, "name"]) if last else entries


def _colons() -> list[str]:
    types = ["string", "string", "map<string,string>", "array<string>", f"array<{VIOLATION}>", ESCALATION, "boolean", "boolean"]
    return [f"{n}:{t}" for n, t in zip(_NAMES, types)]


def book_json(statutes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The whole catalog as {"statutes": [...]}, a row for each value of the columns `by` (one row without any). A book that
    people write fits in a row; `book_parts` writes larger ones."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col("ord"), statute_json().alias("j")))), lambda x: x["j"])
    return statutes.groupBy(*by).agg(F.concat(F.lit('{"statutes": ['), F.array_join(ordered, ", "), F.lit("]}")).alias("json"))


def book_parts(statutes: DataFrame, rows: int = 1000) -> DataFrame:
    """(part, json): the catalog as books of at most `rows` statutes each, in order: what `book_from_json` reads as one. Places
    are given without a gap first, by blocks, so no task sees the whole catalog."""
    numbered = numbered_in_order(statutes, ["ord", "name"], "_n")
    return book_json(numbered.withColumn("part", F.expr(f"_n div {rows}").cast("int")).drop("_n"), ("part",))


def upserted(rows: DataFrame, key: str | list[str] = "name", order: str = "ord") -> DataFrame:
    """The last row of each key, at the place where the key first stood (map-side combined; columns pass through)."""
    keys = [key] if isinstance(key, str) else key
    others = [x for x in rows.columns if x not in (*keys, order)]
    last = F.max_by(F.struct(*others), order) if others else F.lit(1)
    out = rows.groupBy(*keys).agg(F.min(order).alias(order), last.alias("_v"))
    return out.select(*keys[:-1], order, keys[-1], *(F.col(f"_v.{x}").alias(x) for x in others))


def get_all(rows: DataFrame, names: str, statutes: DataFrame) -> DataFrame:
    """For each row and each known name of its array: the row, `pos` and the statute's columns as `statute`. Unknown names
    are dropped, repeated ones kept; order by pos."""
    wanted = rows.select("*", F.posexplode(names).alias("pos", "_name"))
    law = statutes.select(F.col("name").alias("_law"), F.struct(*_NAMES).alias("statute"))
    return wanted.join(law, F.col("_name") == F.col("_law")).drop("_name", "_law")


def get(rows: DataFrame, name: str, statutes: DataFrame) -> DataFrame:
    """`rows` with `known`, whether the catalog has the statute that the column `name` names, and its columns as `statute`
    (null if it doesn't). Null names are unknown."""
    law = statutes.select(F.col("name").alias("_law"), F.struct(*_NAMES).alias("statute"))
    return rows.drop("statute", "known").join(law, F.col(name) == F.col("_law"), "left").withColumn("known", F.col("_law").isNotNull()).drop("_law")


def size(statutes: DataFrame) -> DataFrame:
    """One row: how many statutes the catalog has; 0 for an empty one."""
    return statutes.agg(F.count("*").alias("n"))
