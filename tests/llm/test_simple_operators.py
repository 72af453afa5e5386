"""Sharding, rules, winnowing and preferences against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from assize.llm import common, preference, quality_rules, sharding, winnowing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


# ---------------------------------------------------------------- sharding


def check_shards(rows, n_shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(0 <= k < n_shards for k in by)
    return {k: len(v) for k, v in by.items()}


@pytest.mark.parametrize(("n", "shards", "slack"), [(0, 3, 0.0), (1, 3, 0.0), (2, 5, 0.0), (1000, 7, 0.0), (1000, 7, 0.25), (999, 24, 0.0)])
def test_bounded_loads(spark, n, shards, slack):
    rows = sharding.bounded_load_shards(spark.range(n).withColumn("slot", F.lit("old")), ["id"], shards, vnodes=8, slack=slack).collect()
    sizes = check_shards(rows, shards)
    assert len(rows) == n == len({r.id for r in rows})
    if slack == 0 and n:
        assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(shards)) <= 1
    assert not sizes or max(sizes.values()) <= max(sharding.capacity(n, shards, slack), -(-n // shards))


def walked(pieces, keys, n_shards, slack):
    """The shard of each key (id, hash), by a plain walk: units in ring order, whose keys stay while their shard has room; the others
    queue up and go clockwise, first come, first served, to the places that lie at the units of shards with room to spare."""
    units = {}
    for i, h in sorted(keys, key=lambda k: (k[1], k[0])):
        units.setdefault(next(p for p, lo, hi, _ in pieces if lo <= h <= hi), []).append(i)
    home = {p: shard for p, _, _, shard in pieces}
    n, order = len(keys), sorted(units)
    ring = [(home[p], units[p]) for p in order] + [(s, []) for s in range(n_shards) if s not in {home[p] for p in order}]
    cap = {s: n // n_shards + (s < n % n_shards) if slack == 0 else sharding.capacity(n, n_shards, slack) for s in range(n_shards)}
    demand = {s: sum(len(k) for h, k in ring if h == s) for s in cap}
    out, over, spare, seen, full = {}, [], [], {s: 0 for s in cap}, {s: 0 for s in cap}
    for s, held in ring:
        stay = held[: max(0, cap[s] - full[s])]
        full[s] += len(stay)
        out |= {i: s for i in stay}
        over.append(held[len(stay) :])
        room, places = max(0, cap[s] - demand[s]), sum(h == s for h, _ in ring)
        spare.append((seen[s] + 1) * room // places - seen[s] * room // places)
        seen[s] += 1
    for start in range(len(ring)):
        queue, moved = [], {}
        for j in [*range(start, len(ring)), *range(start)]:
            queue += over[j]
            moved |= {i: ring[j][0] for i in queue[: spare[j]]}
            queue = queue[spare[j] :]
        if not queue:  # nobody walks past this start
            return out | moved


@pytest.mark.parametrize(("n", "shards", "slack"), [(1, 3, 0.0), (40, 5, 0.0), (500, 7, 0.0), (500, 7, 0.1), (300, 24, 0.5), (10, 24, 0.0)])
def test_ring_walk(spark, n, shards, slack):
    rows = spark.range(n)
    pieces = [(r.piece, r.lo, r.hi, r["shard"]) for r in sharding.ring(spark, shards, 8).collect()]
    keys = [(r.id, r.h) for r in rows.withColumn("h", F.xxhash64(F.lit(7), "id")).collect()]
    got = {r.id: r["shard"] for r in sharding.bounded_load_shards(rows, ["id"], shards, vnodes=8, slack=slack).collect()}
    assert got == walked(pieces, keys, shards, slack)


def test_slack_limits_movement(spark):
    at = [{r.id: r.shard for r in sharding.bounded_load_shards(spark.range(2000), ["id"], k, vnodes=32, slack=0.5).collect()} for k in (10, 11)]
    assert sum(at[0][i] != at[1][i] for i in at[0]) < 0.35 * len(at[0])


def test_shards_of_odd_rows(spark, odd_docs, no_docs, docs):
    rows = sharding.bounded_load_shards(odd_docs, ["doc_id"], 3, salt=F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(sharding.SALTS)))
    assert sorted(check_shards(rows.collect(), 3).values()) == [2, 3, 3]
    assert sharding.bounded_load_shards(no_docs, ["doc_id"], 3).count() == 0
    kept = sharding.bounded_load_shards(docs, ["doc_id"], 4)
    assert kept.count() == docs.count() and set(kept.columns) == set(docs.columns)


# ---------------------------------------------------------------- quality rules


def measures(t):
    t = t or ""
    w = words(t)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {p for places in seen.values() if len(places) > 1 for i in places for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_capitals": sum(c in quality_rules.UPPER for c in t)}


def test_ledger_matches_brute_force(docs, texts):
    rows = {r.doc_id: r for r in quality_rules.ledger(docs).collect()}
    for i, t in enumerate(texts):
        m = measures(t)
        assert {k: rows[i][k] for k in m} == m, repr(t)[:60]
        base = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
        assert (rows[i].fail_bits & 3 != 0) == base
    assert rows[0].kept == "k"  # a clashing column passes through


def test_policies_and_ablations(docs):
    ledger = quality_rules.ledger(docs)
    policy = quality_rules.POLICIES["2"]
    bits = [r.fail_bits for r in ledger.collect()]
    mask = quality_rules.mask_of(policy.rules)
    got = {r.rule: (r.fails, r.kept_without) for r in quality_rules.ablations(ledger, policy).collect()}
    for rule in quality_rules.RULES:
        alone = sum(b & mask == rule.mask for b in bits)
        assert got[rule.name] == (sum(b & rule.mask != 0 for b in bits), alone)
    lax = quality_rules.Policy("t", policy.rules, (), least=2)
    assert ledger.where(quality_rules.verdict(lax)).count() == sum((b & mask).bit_count() < 2 for b in bits)
    assert ledger.where(quality_rules.verdict(quality_rules.POLICIES["1"])).count() == sum(b & 3 == 0 for b in bits)


def test_ledger_of_odd_rows(odd_docs, no_docs):
    assert quality_rules.ledger(odd_docs).count() == 8 and quality_rules.ledger(no_docs).count() == 0


# ---------------------------------------------------------------- winnowing


def test_winnowing_keeps_the_rightmost_least_hash(spark, docs, texts):
    k, w = 3, 4
    rows = docs.select("doc_id", winnowing.winnowed(F.col("text"), k, w).alias("m"), F.transform(F.expr(f"filter(split(coalesce(text, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')"), lambda x: x).alias("w"))
    hashes = rows.withColumn("h", F.when(F.size("w") >= k, winnowing.rolled(F.transform("w", lambda x: F.xxhash64(x)), k)).otherwise(F.array().cast("array<bigint>"))).collect()
    for r in hashes:
        assert r.w == words(texts[r.doc_id])
        h = list(r.h)
        if not r.w:
            assert not r.m
        elif not h:
            assert len(r.m) == 1 and r.m[0].pos == 0
        else:
            key = lambda i: (h[i] >> 28, -i)
            spans = [range(len(h))] if len(h) <= w else [range(i, i + w) for i in range(len(h) - w + 1)]
            want = sorted({min(s, key=key) for s in spans})
            assert [(m.pos, m.hash) for m in r.m] == [(p, h[p]) for p in want]


def test_shared_passages_leave_common_hashes(spark):
    rng = __import__("random").Random(1)
    passage = " ".join(f"p{rng.random()}" for _ in range(winnowing.WINDOW + winnowing.K - 1))
    rows = spark.createDataFrame([(i, " ".join(f"w{rng.random()}" for _ in range(50)) + " " + passage + " " + " ".join(f"w{rng.random()}" for _ in range(30))) for i in range(2)], "i int, text string")
    a, b = ({m.hash for m in r.m} for r in rows.select(winnowing.winnowed(F.col("text")).alias("m")).collect())
    assert a & b


def test_rolled_hashes_tell_windows_apart(spark):
    rng = __import__("random").Random(2)
    values = [rng.randrange(3) for _ in range(300)]
    rows = spark.createDataFrame([(values,)], "v array<bigint>")
    for k in (1, 2, 3, 5, 8, 11):
        h = rows.select(winnowing.rolled(F.col("v"), k).alias("h")).first().h
        spans = [tuple(values[i : i + k]) for i in range(len(values) - k + 1)]
        assert len(h) == len(spans) and len(set(zip(h, spans))) == len(set(h)) == len(set(spans))
    for w in (1, 2, 3, 7, 16, 21):
        got = rows.select(winnowing.least_of_windows(F.col("v"), w).alias("m")).first().m
        assert got == [min(values[i : i + w]) for i in range(len(values) - w + 1)]


SPARSE = [__import__("random").Random(3).randrange(1 << 62) for _ in range(1500)]


@pytest.mark.parametrize("ids", [[], [5], [5, 9], list(range(0, 9_000_000, 1_100_003)), [3, 3, None, 2000, 5000], list(range(1500)), SPARSE, [None] * 700 + [7] * 700 + [-4, 9]])
@pytest.mark.parametrize("cell_rows", [4096, 50])
def test_next_rows(spark, ids, cell_rows):
    rows = spark.createDataFrame([(i, f"t{n}" if n % 97 else None, n, "k") for n, i in enumerate(ids)], "id bigint, text string, n int, cell string").repartition(3)
    ranked = sorted(((-(1 << 63) if r.id is None else r.id, r.h, r.text or ""), r.text, r.n) for r in rows.withColumn("h", F.xxhash64("text")).collect())[::-1]
    out = winnowing.with_next(rows, "id", "text", cell_rows)
    assert out.columns == ["id", "text", "n", "cell", "next_text"]
    got = {r.n: r.next_text for r in out.collect()}
    assert len(got) == len(ids)
    # Rows of one rank are texts that are null: any order of them is right.
    assert all(got[n] == ranked[(j + 1) % len(ranked)][1] for j, (_, t, n) in enumerate(ranked) if t is not None)


@pytest.mark.parametrize("text", ["CAST(NULL AS STRING)", "'one text'", "CAST(id AS STRING)", "CAST(id % 7 AS STRING)"])
def test_cells_are_small_whatever_repeats(spark, text):
    """Null texts, one text under 20,000 ids, distinct and repeated texts."""
    import bisect
    from collections import Counter

    rows = spark.range(20_000).selectExpr("id AS k", f"xxhash64({text}) AS h")
    cells, bounds = winnowing.cell_bounds(rows, 256)
    sizes = Counter(bisect.bisect_right(bounds, (r.k, r.h)) for r in rows.collect())
    assert cells == 79 and len(sizes) > 70 and max(sizes.values()) < 700


def test_next_of_null_texts(spark):
    rows = spark.range(3000).selectExpr("id", "CAST(NULL AS STRING) AS text")
    assert winnowing.with_next(rows, "id", "text", 50).where("next_text IS NULL").count() == 3000


def test_likeness(spark):
    rows = spark.createDataFrame([([1, 2, 2], [2, 3]), ([], []), ([1], [])], "a array<bigint>, b array<bigint>")
    assert [r.x for r in rows.select(winnowing.likeness(F.col("a"), F.col("b")).alias("x")).collect()] == [1 / 3, 1.0, 0.0]


# ---------------------------------------------------------------- preferences


def turn(role, text):
    return (role, text)


@pytest.mark.parametrize(
    ("a", "b", "n"),
    [
        ([("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b")], 1),
        ([("user", "q")], [("user", "q")], 1),
        ([("user", "q"), ("assistant", "a")], [("user", "q")], 1),
        ([("user", "q")], [("system", "q")], 0),
        ([], [("user", "q")], 0),
        (None, [("user", "q")], 0),
        ([("user", None), (None, "x")], [("user", None), (None, "y")], 1),
        ([("user", "é世"), ("assistant", "a"), ("user", "r"), ("assistant", "c")], [("user", "é世"), ("assistant", "b"), ("assistant", "dd")], 1),
    ],
)
def test_preferences(spark, a, b, n):
    t = "array<struct<role:string,text:string>>"
    rows = preference.format_preferences(spark.createDataFrame([(1, a, b, "old")], f"id int, chosen {t}, rejected {t}, prompt string"))
    r = rows.first()
    show = lambda ts: "".join(f"<|{x or ''}|>\n{y or ''}<|end|>\n" for x, y in ts)
    a, b = a or [], b or []
    assert (r.n_prompt_turns, r.prompt, r.chosen_completion, r.rejected_completion, r.differs) == (n, show(a[:n]), show(a[n:]), show(b[n:]), a != b)
    for side, mask, text in ((a, r.chosen_mask, r.chosen_completion), (b, r.rejected_mask, r.rejected_completion)):
        assert [text[m.start : m.start + m.length] for m in mask] == [(y or "") + "<|end|>\n" for x, y in side[n:] if x == "assistant"]


CONVERSATION = "conv_id bigint, turn bigint, role string, text string, kind string"


def test_pairs_of_conversations(spark):
    rows = [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "more"), (3, 0, "user", "q"), (3, 1, "assistant", "b"), (4, 0, "user", "lonely"), (7, 0, "assistant", "x"), (None, 0, "user", "no"), (9, 5, None, None), (9, 5, "user", "same turn")]
    got = {(r.pair_id, r.kind): ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in preference.pairs_of(spark.createDataFrame([(*r, "clash") for r in rows], CONVERSATION)).collect()}
    a, b = [("user", "q"), ("assistant", "a"), ("user", "more")], [("user", "q"), ("assistant", "b")]
    assert got[1, "whole"] == (a, b) and got[1, "first"] == (a, [a[0], b[1]]) and got[1, "second"] == (b, [b[0], *a[1:]])
    assert got[2, "whole"] == ([("user", "lonely")], []) and got[3, "whole"] == ([], [("assistant", "x")])
    assert got[4, "whole"] == ([], [(None, None), ("user", "same turn")]) and len(got) == 12
    assert preference.pairs_of(spark.createDataFrame([], CONVERSATION)).count() == 0


def test_long_turns_are_kept_whole(spark):
    long = "word " * 40_000
    made = preference.format_preferences(preference.pairs_of(spark.createDataFrame([(0, 0, "user", long, ""), (0, 1, "assistant", long, ""), (1, 0, "user", long, "")], CONVERSATION)))
    whole = made.where("kind = 'whole'").first()
    assert whole.n_prompt_turns == 1 and whole.prompt == f"<|user|>\n{long}<|end|>\n" and whole.chosen_completion == f"<|assistant|>\n{long}<|end|>\n" and whole.rejected_completion == ""


def test_batches_are_bounded_by_bytes(spark):
    before = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    common.small_batches(spark)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], ["n"])

    try:
        rows = spark.range(0, 12, 1, 1).select(F.expr("cast(repeat('x', 4000000) as binary)").alias("blob"))
        assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) <= 16 << 20
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.execution.arrow.{k}", v)
