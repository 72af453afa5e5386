"""Quality rules as a bitmask ledger (DataFrame operations only).

Every rule is evaluated once for a document: the ledger holds the measurements and one bit for each rule that fails.
Policies are versioned masks over those bits; applying one, or asking what a rule alone removes, reads only the ledger.
Everything is computed inside the row, so no shuffle is needed before the ablation's sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, rolled, table, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"


@dataclass(frozen=True)
class Rule:
    """A named bit; `fails` is a condition over the measurements."""

    name: str
    bit: int
    fails: Callable[[], Column]

    @property
    def mask(self) -> int:
        return 1 << self.bit


@dataclass(frozen=True)
class Policy:
    """Rejects a document at `least` or more failures among its rules, or at any failure among `always`."""

    version: str
    rules: tuple[str, ...]
    always: tuple[str, ...] = ()
    least: int = 1


c = F.col
#: Bits are never reused: ledgers of earlier runs stay readable.
RULES = (
    Rule("few_words", 0, lambda: c("n_words") < 10),
    Rule("repeated_windows", 1, lambda: 100 * c("n_repeat_words") > 20 * c("n_words")),
    Rule("symbols", 2, lambda: 2 * c("n_symbols") > c("n_words")),
    Rule("short_words", 3, lambda: c("word_chars") < 2 * c("n_words")),
    Rule("long_words", 4, lambda: c("word_chars") > 20 * c("n_words")),
    Rule("repeated_lines", 5, lambda: (c("n_lines") >= 4) & (2 * c("n_dup_lines") > c("n_lines"))),
    Rule("capitals", 6, lambda: 2 * c("n_capitals") > c("word_chars")),
)
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "1": Policy("1", BASE, BASE),
    "2": Policy("2", tuple(r.name for r in RULES), BASE),
}
CURRENT = "2"


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    by_name = {r.name: r.mask for r in rules}
    return sum(by_name[n] for n in names)


def _repeated(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more."""

    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, i: F.when(i + 1 < F.size(places), F.least(F.lit(WINDOW), F.get(places, i + 1) - p)).otherwise(F.lit(WINDOW)))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def among(pairs: Column) -> Column:
        twins = F.filter(pairs, lambda x, i: F.coalesce(F.get(pairs, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(twins, lambda x: x["i"])), covered)

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, among))

    hashes = F.when(F.size(words) >= WINDOW, rolled(F.transform(words, lambda w: F.xxhash64(w)), WINDOW)).otherwise(F.array().cast("array<bigint>"))
    return let(hashes, count)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the measurements of `text`, all long. Null and empty texts measure 0 everywhere."""
    t = F.coalesce(c(text).cast("string"), F.lit(""))
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    facts = let(words_of(t), lambda w: F.struct(F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_facts = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    new = {
        "n_words": c("_f.n_words"), "word_chars": F.length(F.translate(t, ASCII_SPACE, "")), "n_symbols": without(SYMBOLS), "n_dup_lines": c("_l.n_dup_lines"),
        "n_repeat_words": c("_f.n_repeat_words"), "n_lines": c("_l.n_lines"), "n_capitals": without(UPPER),
    }
    return docs.drop(*new).withColumns({"_f": facts, "_l": line_facts}).withColumns({k: v.cast("long") for k, v in new.items()}).drop("_f", "_l")


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with the measurements and `fail_bits` (long). Columns of these names are replaced; others pass through."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.fails(), F.lit(r.mask)).otherwise(F.lit(0)).cast("long"))
    return measured(docs.drop("fail_bits"), text).withColumn("fail_bits", bits)


def verdict(policy: Policy, bits: Column | None = None) -> Column:
    """True if the policy keeps a document of these failure bits."""
    bits = c("fail_bits") if bits is None else bits
    counted = F.bit_count(bits.bitwiseAND(F.lit(mask_of(policy.rules)).cast("long")))
    return (counted < policy.least) & (bits.bitwiseAND(F.lit(mask_of(policy.always)).cast("long")) == 0)


def ablations(ledgers: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, and documents that are kept once it is left out.

    Rows are first summed by their bits (at most 2 to the number of rules), then read per rule."""
    by_bits = ledgers.groupBy("fail_bits").agg(F.count("*").alias("n"))
    used = [r for r in rules if r.name in policy.rules]
    each = by_bits.select(
        "n", "fail_bits",
        F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.mask).cast("long").alias("mask")) for r in used))).alias("r"),
    )
    left = c("fail_bits").bitwiseAND(F.bitwise_not(c("r.mask")))
    return each.groupBy(c("r.rule").alias("rule")).agg(
        F.sum(F.when(c("fail_bits").bitwiseAND(c("r.mask")) != 0, c("n")).otherwise(F.lit(0))).alias("fails"),
        F.sum(F.when(~verdict(policy) & verdict(policy, left), c("n")).otherwise(F.lit(0))).alias("kept_without"),
    )


def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the current policy's verdict for every document."""
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = c("fail_bits").bitwiseAND(F.lit(mask_of(BASE)).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), verdict(POLICIES[CURRENT]).alias("kept"), "fail_bits")


#: For every engine that knows ANSI SQL, lists and RE2.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
key AS (SELECT doc_id, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS k FROM win),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM key) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_capitals
  FROM w JOIN ln ON w.doc_id = ln.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END) + (CASE WHEN 2 * n_capitals > word_chars THEN 64 ELSE 0 END) AS f
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f & 3 <> 0 AS base_failed, f = 0 AS kept, CAST(f AS BIGINT) AS fail_bits FROM b
"""
