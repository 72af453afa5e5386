"""Preference formatting (DataFrame operations only).

A pair of conversations shares its longest common prefix of turns: that is rendered once, as the prompt, and what follows
on either side becomes a completion with the spans that a loss may count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

TRAINED_ROLE = "assistant"
TURN = "struct<role:string,text:string>"


def rendered(turn: Column) -> Column:
    """One turn as text; a null role or text renders as empty."""
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>\n"))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix; nulls in a turn equal nulls."""
    shorter = F.least(F.size(a), F.size(b))
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(differs, True).cast("int")
    return F.when(first == 0, shorter).otherwise(F.least(shorter, first - 1))


def spans(turns: Column, role: str) -> Column:
    """array<struct<start bigint, length bigint>>: in code points of the rendered turns, the text and end mark of each turn
    of `role`."""
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def step(state: Column, turn: Column) -> Column:
        size = F.length(rendered(turn)).cast("long")
        body = (F.length(F.coalesce(turn["text"], F.lit(""))) + F.lit(len("<|end|>\n"))).cast("long")
        span = F.struct((state["at"] + size - body).alias("start"), body.alias("length"))
        return F.struct((state["at"] + size).alias("at"), F.when(turn["role"] == role, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    return F.aggregate(turns, F.struct(F.lit(0).cast("long").alias("at"), none.alias("found")), step, lambda s: s["found"])


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", role: str = TRAINED_ROLE) -> DataFrame:
    """`pairs` (chosen, rejected: array<struct<role,text>>) with prompt, chosen_completion, rejected_completion (text),
    chosen_mask, rejected_mask (spans), n_prompt_turns and differs.

    A null side counts as a conversation without turns; equal sides give two empty completions and differs = false.
    Columns of the new names are replaced, all others pass through. Work stays inside the row: nothing is shuffled."""
    new = ["prompt", "chosen_completion", "rejected_completion", "chosen_mask", "rejected_mask", "n_prompt_turns", "differs"]
    side = lambda name: F.coalesce(F.col(name).cast(f"array<{TURN}>"), F.array().cast(f"array<{TURN}>"))
    text = lambda turns: F.array_join(F.transform(turns, rendered), "")

    def built(s: Column) -> Column:
        a, b, n = s["a"], s["b"], common_turns(s["a"], s["b"])

        def cut(k: Column) -> Column:
            after_a, after_b = F.slice(a, k + 1, F.size(a)), F.slice(b, k + 1, F.size(b))
            return F.struct(
                text(F.slice(a, F.lit(1), k)).alias("prompt"), text(after_a).alias("chosen_completion"), text(after_b).alias("rejected_completion"),
                spans(after_a, role).alias("chosen_mask"), spans(after_b, role).alias("rejected_mask"), k.alias("n_prompt_turns"), ((F.size(a) > k) | (F.size(b) > k)).alias("differs"),
            )

        return let(n, cut)

    done = pairs.withColumn("_made", let(F.struct(side(chosen).alias("a"), side(rejected).alias("b")), built))
    return done.drop(*new).select(*(c for c in pairs.columns if c not in new), *(F.col(f"_made.{c}").alias(c) for c in new))


def pairs_of(conversations: DataFrame) -> DataFrame:
    """(pair_id, kind, chosen, rejected) from (conv_id, turn, role, text), all turns of all conversations. Conversations 2i and
    2i + 1 make pair i, with three rows:

    `whole`: the first against the second, as they stand. `first`: the first against itself up to a turn, from where it goes
    on as the second does; the turn is the remainder of the pair's number by the number of turns. `second`: the same with the
    two exchanged. A conversation that is missing has no turns; equal turn numbers are ordered by role and text, nulls first.
    Rows without a conv_id belong to no conversation.

    A pair's turns meet in one row, as its texts do in the result."""
    c = F.col
    plain = lambda turns: F.transform(F.sort_array(turns), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    first = F.pmod("conv_id", F.lit(2)) == 0
    turns = conversations.where("conv_id is not null").select(F.shiftright("conv_id", 1).cast("long").alias("pair_id"), first.alias("first"), F.struct("turn", "role", "text").alias("t"))
    sides = turns.groupBy("pair_id").agg(plain(F.collect_list(F.when(c("first"), c("t")))).alias("a"), plain(F.collect_list(F.when(~c("first"), c("t")))).alias("b"))

    def going_on(mine: Column, other: Column) -> Column:
        at = F.pmod(c("pair_id"), F.greatest(F.size(mine), F.lit(1))).cast("int")
        return F.concat(F.slice(mine, F.lit(1), at), F.slice(other, at + 1, F.size(other)))

    row = lambda kind, chosen, rejected: F.struct(F.lit(kind).alias("kind"), chosen.alias("chosen"), rejected.alias("rejected"))
    a, b = c("a"), c("b")
    rows = F.array(row("whole", a, b), row("first", a, going_on(a, b)), row("second", b, going_on(b, a)))
    return sides.select("pair_id", F.explode(rows).alias("r")).select("pair_id", "r.*")


def mask_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), ",")


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of every pair of conversations, and of where either goes on as the other."""
    rows = format_preferences(pairs_of(table(spark, sf_dir, "conversations")))
    return rows.select(
        "pair_id", "kind", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), "prompt", "chosen_completion", "rejected_completion",
        mask_text(F.col("chosen_mask")).alias("chosen_mask"), mask_text(F.col("rejected_mask")).alias("rejected_mask"), "differs",
    )


#: Turn by turn: both sides of a row are joined on the place of the turn, and sums over places give texts and masks.
OP5_SQL = r"""
WITH t AS (SELECT conv_id >> 1 AS pair_id, conv_id % 2 AS side, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT pair_id, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1 FROM t GROUP BY pair_id),
g AS (SELECT pair_id, kind, side, pair_id % greatest(CASE WHEN side = 0 THEN n0 ELSE n1 END, 1) AS at FROM n, (VALUES ('whole', 0), ('first', 0), ('second', 1)) AS k(kind, side)),
c AS (SELECT g.pair_id, kind, pos, role, text FROM g JOIN t USING (pair_id, side)),
r AS (SELECT g.pair_id, kind, pos, role, text FROM g JOIN t ON t.pair_id = g.pair_id AND CASE WHEN kind = 'whole' THEN t.side = 1 ELSE (t.side = g.side) = (pos <= g.at) END),
d AS (SELECT pair_id, kind, pos, c.role AS cr, c.text AS ct, r.role AS rr, r.text AS rt, c.pos AS cp, r.pos AS rp FROM c FULL JOIN r USING (pair_id, kind, pos)),
f AS (SELECT pair_id, kind, min(pos) FILTER (WHERE cp IS NULL OR rp IS NULL OR cr IS DISTINCT FROM rr OR ct IS DISTINCT FROM rt) - 1 AS cut, max(pos) AS most FROM d GROUP BY pair_id, kind),
e AS (SELECT g.pair_id, g.kind, coalesce(cut, most, 0) AS k, cut IS NOT NULL AS differs FROM g LEFT JOIN f USING (pair_id, kind)),
s AS (SELECT pair_id, kind, pos, 'c' AS of, role, text FROM c UNION ALL SELECT pair_id, kind, pos, 'r', role, text FROM r),
x AS (SELECT e.*, s.of, s.pos, s.role, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS shown, length(coalesce(text, '')) + 8 AS body FROM e LEFT JOIN s USING (pair_id, kind)),
y AS (SELECT *, sum(CASE WHEN pos > k THEN length(shown) ELSE 0 END) OVER (PARTITION BY pair_id, kind, of ORDER BY pos) - body AS start FROM x)
SELECT pair_id, kind, CAST(k AS BIGINT) AS n_prompt_turns, differs,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE of = 'c' AND pos <= k), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE of = 'c' AND pos > k), '') AS chosen_completion,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE of = 'r' AND pos > k), '') AS rejected_completion,
  coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '+' || CAST(body AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE of = 'c' AND pos > k AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '+' || CAST(body AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE of = 'r' AND pos > k AND role = 'assistant'), '') AS rejected_mask
FROM y GROUP BY pair_id, kind, k, differs
"""
