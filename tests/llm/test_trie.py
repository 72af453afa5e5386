"""The prefix trie against plain Python, over many blocks and levels."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from assize.llm.conversation_trie import prefix_trie, rebuilt, turns_of

EXTRA = "path string, sizes string, kind string, block string"


def brute(convs):
    """convs: {conv_id: [(role, text), ...]}; rows in the order of the operator's columns."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[q] for q in children[p])
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(c for c in members[p] if len(convs[c]) == len(p))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


def result(rows):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows.collect())


def frame(spark, convs):
    rows = [(c, i, role, text, "p", "s", "k", "b") for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, text string, {EXTRA}")


def grown(seed, n):
    rng = random.Random(seed)
    turn = lambda: (rng.choice("ua"), rng.choice(["x", "yé", "", "zzz"]))
    out = []
    for _ in range(n):
        base = rng.choice(out) if out and rng.random() < 0.8 else []
        out.append(base[: rng.randint(0, len(base))] + [turn() for _ in range(rng.choice([0, 1, 1, 2, 4]))])
    return {rng.randint(-50, 10**6) * 2 + i % 2: t for i, t in enumerate(out) if t}


@pytest.mark.parametrize("seed, n, block, fan", [(1, 120, 20_000, 256), (2, 120, 3, 2), (3, 90, 5, 3), (4, 60, 1, 2), (5, 40, 2, 256)])
def test_against_brute_force(spark, seed, n, block, fan):
    convs = grown(seed, n)
    assert result(prefix_trie(turns_of(frame(spark, convs)), block, fan)) == brute(convs)


def test_copies_over_many_blocks(spark):
    """A third are equal, a third begin alike, and one is very long."""
    convs = {i: [("u", "hello"), ("a", "hi")] if i % 3 == 0 else [("u", "hello"), ("a", f"t{i}")] if i % 3 == 1 else [("u", f"x{i}")] for i in range(90)}
    convs[1000] = [("u", "hello")] + [("a", str(i)) for i in range(3000)]
    convs[1001] = convs[1000][:2000]
    assert result(prefix_trie(turns_of(frame(spark, convs)), 8, 2)) == brute(convs)


def test_rebuilt(spark):
    """Bases that are missing or short, conversations that lose all turns, nulls and equal turn numbers."""
    rng = random.Random(9)
    convs = {c: [(rng.choice("ua"), f"{c % 7}-{i}") for i in range(rng.randint(1, 9))] for c in range(60) if c % 5 or c % 3}
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    rows += [(70, None, None, None), (70, 1, "u", "b"), (None, 1, "u", "lost"), (71, 0, "u", "own")]
    convs |= {70: [("", ""), ("u", "b")], 71: [("u", "own")]}
    want = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        want[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    assert any(not t for t in want.values())
    assert result(prefix_trie(rebuilt(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")), 7, 2)) == brute(want)


def test_ties_and_repeated_rows(spark):
    """Turns of one number go by their hash, whatever the order of the rows."""
    rows = [(1, 0, "u", "a"), (1, 0, "u", "b"), (1, 0, "u", "b"), (2, 0, "u", "b"), (2, 0, "u", "a"), (2, 0, "u", "b")]
    got = result(prefix_trie(turns_of(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))))
    assert [(r[1], r[3]) for r in got] == [(0, 2), (1, 2), (2, 2), (3, 2)]


def test_no_conversations(spark):
    assert prefix_trie(rebuilt(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0
