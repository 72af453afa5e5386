"""The prefix trie of conversations, by union-find over the common prefixes of sorted neighbours.

A conversation is a path of turn hashes. In sorted order neighbours share the longest prefixes: each pair of neighbours is an
edge as deep as their common prefix, and taking edges in descending depth, every union of two components makes the branching
node of that depth. A task does so for a block of the order and emits the nodes that lie inside. What touches the block's ends
may go on in the next block: it is contracted to the two paths at its ends, with sums of all that hangs below them, and
contracted blocks are united in the same way, so many at a time, until one is left.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, table, written

#: Conversations of a block, contracted blocks that a task unites, and bytes of a turn's hash.
BLOCK, FAN, MARK = 20_000, 256, 16
_ROW = (
    "kind string, block bigint, k bigint, conv_id bigint, depth bigint, parent bigint, open bigint, n bigint, kids bigint, leaves bigint, saved bigint, ends string, "
    "digest binary, above binary, left binary, right binary, left_bytes binary, right_bytes binary, items string"
)
_SCHEMA = pa.schema([(x.split()[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in _ROW.split(", ")])
NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- conversations as paths


def paths_of(turns: Column) -> list[Column]:
    """`path` (binary, MARK bytes a turn) and `sizes` (array<bigint>, bytes of the turns' texts) of array<struct<mark,size>>."""
    return [F.unhex(F.array_join(F.transform(turns, lambda t: t["mark"]), "")).alias("path"), F.transform(turns, lambda t: t["size"]).alias("sizes")]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<mark string,size bigint>>): conversations ordered by turn, nulls first; turns of one number
    by their hash. Null roles and texts are empty. Rows without a conv_id belong to no conversation. Only hashes and sizes of
    turns are collected."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    mark = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * MARK)
    turn = F.struct("turn", mark.alias("mark"), F.octet_length(text).cast("long").alias("size"))
    ordered = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["mark"].alias("mark"), t["size"].alias("size")))
    return conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(ordered.alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): conversation c begins as the first h turns of conversation c - c % 5, if there is one, and goes on with
    its own turns after its first h; h is the CRC-32 of c in decimal, modulo 9."""
    own = turns_of(conversations)
    base = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 8).alias("_begins"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    rows = own.withColumn("_h", h).join(base, F.col("conv_id") - F.col("conv_id") % 5 == F.col("_base"), "left")
    head = F.coalesce(F.slice("_begins", F.lit(1), F.col("_h")), F.array().cast("array<struct<mark:string,size:bigint>>"))
    return rows.select("conv_id", F.concat(head, F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


# ---------------------------------------------------------------- union-find in a task


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths share, by bisection."""
    low, high = 0, min(len(a), len(b)) // MARK
    while low < high:
        mid = (low + high + 1) // 2
        if a[MARK * low : MARK * mid] == b[MARK * low : MARK * mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Forest:
    """Nodes with what is known below them; the first ones are items, the others branchings made by `unite`."""

    def __init__(self, depth: list[int], n: list[int], least: list[int], kids: list[int], leaves: list[int], saved: list[int]):
        self.depth, self.n, self.least, self.kids, self.leaves, self.saved = depth, n, least, kids, leaves, saved
        self.items = len(depth)
        self.up = [-1] * self.items
        self.same = list(range(self.items))  # nodes of one place are one
        self.like = list(range(self.items))  # an item below, whose path and sizes the node shares

    def node(self, x: int) -> int:
        while self.same[x] != x:
            self.same[x] = x = self.same[self.same[x]]
        return x

    def unite(self, edges: list[tuple[int, int, int]]) -> None:
        """edges: (item, item, depth of their common prefix)."""
        root, size, top = list(range(self.items)), [1] * self.items, list(range(self.items))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, b, d in sorted(edges, key=lambda e: -e[2]):
            a, b = find(a), find(b)
            if a == b:
                continue
            x, y = top[a], top[b]
            if self.depth[x] != d:
                x, y = y, x
            if self.depth[x] != d:  # neither stands here: a branching
                new = len(self.depth)
                for values, v in ((self.depth, d), (self.n, 0), (self.least, None), (self.kids, 0), (self.leaves, 0), (self.saved, 0), (self.up, -1), (self.same, new), (self.like, self.like[x])):
                    values.append(v)
                self.up[x] = self.up[y] = new
                x = new
            elif self.depth[y] == d:  # both do: one place
                self.same[y] = x
                for values in (self.n, self.kids, self.leaves, self.saved):
                    values[x] += values[y]
                self.least[x] = min((v for v in (self.least[x], self.least[y]) if v is not None), default=None)
            else:
                self.up[y] = x
            if size[a] < size[b]:
                a, b = b, a
            root[b], top[a] = a, x
            size[a] += size[b]

    def parent(self, x: int) -> int:
        return -1 if self.up[x] < 0 else self.node(self.up[x])

    def spine(self, item: int) -> list[int]:
        """The nodes from an item's to its root."""
        x, out = self.node(item), []
        while x >= 0:
            out.append(x)
            x = self.parent(x)
        return out

    def settle(self, opened: set[int], size_of, keep: bool) -> list[tuple[int, int, list[int]]]:
        """Sums up, deepest nodes first; (node, parent, saved) of each node that is not open, where `saved` has the node's own
        value and those of the places above it down to its parent's, deepest first. What is open gets the sums of what isn't.
        With `keep` roots reach up to the textless one."""
        out = []
        nodes = sorted((x for x in range(len(self.depth)) if self.same[x] == x), key=lambda x: -self.depth[x])
        for x in nodes:
            if x in opened:
                continue
            p = self.parent(x)
            leaf = self.kids[x] == 0
            self.leaves[x] += leaf
            above = self.depth[p] if p >= 0 else -1 if keep else self.depth[x] - 1
            saved, totals = self.saved[x], []
            for d in range(self.depth[x], above, -1):
                saved += (self.n[x] - 1) * size_of(x, d)
                totals.append(saved)
            self.saved[x] = saved
            out.append((x, p, totals))
            if p >= 0:
                self.n[p] += self.n[x]
                self.kids[p] += 1
                self.leaves[p] += self.leaves[x]
                self.saved[p] += saved
                self.least[p] = self.least[x] if self.least[p] is None else min(self.least[p], self.least[x])
        return out


def _rows(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], schema=_SCHEMA)


def _digest(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(path[: MARK * depth]).digest()[:16]


def _emitted(f: Forest, settled: list, ends: dict[int, str], pending: dict[int, int] | None, path_of, block: int) -> Iterator[dict]:
    """A row for each place of the settled nodes. A parent's conv_id is known if the parent is settled; else the row names the
    open node, by its number in this block or, without `pending`, by its digest."""
    done = {x for x, _, _ in settled}
    for x, p, totals in settled:
        depth, leaf = f.depth[x], f.kids[x] == 0
        base = {"kind": "node", "block": block, "conv_id": f.least[x], "n": f.n[x], "leaves": f.leaves[x]}
        for i, saved in enumerate(totals):
            d, last = depth - i, i == len(totals) - 1
            row = base | {"depth": d, "kids": f.kids[x] if i == 0 else 1, "saved": saved, "ends": (ends.get(x, NO_ENDS) if pending is not None else None) if i == 0 else NO_ENDS}
            if pending is None and i == 0:
                row["digest"] = _digest(path_of(x), depth)
            if not last:
                row["parent"] = f.least[x]
            elif p in done:
                row["parent"] = f.least[p]
            elif p >= 0 and pending is not None:
                row["open"] = pending[p]
            elif p >= 0:
                row["above"] = _digest(path_of(p), f.depth[p])
            yield row


def _contracted(f: Forest, block: int, spines: list[int], sides: list[int], left: bytes, right: bytes, left_bytes: bytes, right_bytes: bytes) -> dict:
    """A block's open nodes, from the left end's and the right end's path, shallow ones first."""
    values = {"depth": [f.depth[x] for x in spines], "side": sides, **{k: [getattr(f, k)[x] for x in spines] for k in ("n", "least", "kids", "leaves", "saved")}}
    return {"kind": "block", "block": block, "left": left, "right": right, "left_bytes": left_bytes, "right_bytes": right_bytes, "items": json.dumps(values)}


def _spines(f: Forest, first: int, last: int) -> tuple[list[int], list[int]]:
    left = f.spine(first)[::-1]
    right = [x for x in f.spine(last)[::-1] if x not in set(left)]
    return left + right, [0] * len(left) + [1] * len(right)


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block: conversations in order of (path, conv_id)."""
    paths, ids, sizes, block = [], [], [], None
    for b in batches:
        for path, conv, size, block in zip(b.column("path"), b.column("conv_id").to_pylist(), b.column("sizes"), b.column("block").to_pylist()):
            path = path.as_py()
            if not paths or paths[-1] != path:
                paths.append(path)
                ids.append([])
                sizes.append(size.values.to_numpy(zero_copy_only=False).astype(np.int64))
            ids[-1].append(conv)
    if not paths:
        return
    m = len(paths)
    f = Forest([len(p) // MARK for p in paths], [len(x) for x in ids], [x[0] for x in ids], [0] * m, [0] * m, [0] * m)
    f.unite([(i, i + 1, common(paths[i], paths[i + 1])) for i in range(m - 1)])
    spines, sides = _spines(f, 0, m - 1)
    opened = {x: k for k, x in enumerate(spines)}
    settled = f.settle(set(opened), lambda x, d: int(sizes[f.like[x]][d - 1]) if d else 0, keep=False)
    told = lambda i: ",".join(map(str, ids[i]))
    ends = {i: hashlib.sha256(told(i).encode()).hexdigest() for i in range(m) if i not in opened}
    rows = list(_emitted(f, settled, ends, opened, None, block))
    for x, k in opened.items():
        path = paths[f.like[x]]
        rows.append({"kind": "open", "block": block, "k": k, "digest": _digest(path, f.depth[x])})
        if x < m:
            rows.append({"kind": "ends", "block": block, "digest": _digest(path, f.depth[x]), "ends": told(x)})
    rows.append(_contracted(f, block, spines, sides, paths[0], paths[-1], sizes[0].tobytes(), sizes[-1].tobytes()))
    yield from _rows(rows)


def _united(final: bool, fan: int):
    def run(group: pa.Table) -> pa.Table:
        """Neighbouring contracted blocks as one; with `final` nothing stays open."""
        held = sorted(group.to_pylist(), key=lambda b: b["block"])
        f = Forest([], [], [], [], [], [])
        owner, side, edges, leaf_ends, before = [], [], [], [], None
        for i, b in enumerate(held):
            v = json.loads(b["items"])
            at, n = len(owner), len(v["depth"])
            for name in ("depth", "n", "least", "kids", "leaves", "saved"):
                getattr(f, name).extend(v[name])
            owner += [i] * n
            side += v["side"]
            lefts = v["side"].count(0)
            first, last = at + lefts - 1, at + n - 1
            edges += [(x, x + 1, f.depth[x]) for x in range(at, at + n - 1) if x != first]
            if lefts < n:
                edges.append((first, first + 1, common(b["left"], b["right"])))
            if before is not None:
                edges.append((before, first, common(held[i - 1]["right"], b["left"])))
            leaf_ends += [first, last]
            before = last
        f = Forest(f.depth, f.n, f.least, f.kids, f.leaves, f.saved)
        f.unite(edges)
        path_of = lambda x: held[owner[f.like[x]]]["right" if side[f.like[x]] else "left"]
        lengths = [(np.frombuffer(b["left_bytes"], np.int64), np.frombuffer(b["right_bytes"], np.int64)) for b in held]
        spines, sides = ([], []) if final else _spines(f, leaf_ends[0], leaf_ends[-1])
        settled = f.settle(set(spines), lambda x, d: int(lengths[owner[f.like[x]]][side[f.like[x]]][d - 1]) if d else 0, keep=final)
        block = held[0]["block"] // fan
        rows = list(_emitted(f, settled, {}, None, path_of, block))
        if spines:
            rows.append(_contracted(f, block, spines, sides, held[0]["left"], held[-1]["right"], held[0]["left_bytes"], held[-1]["right_bytes"]))
        return pa.Table.from_pylist(rows, schema=_SCHEMA)

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, ends) of texts that come in order of (digest, block): a hash goes on from one text to the next."""
    digest, state, out = None, None, []
    for b in batches:
        for d, text in zip(b.column("digest").to_pylist(), b.column("ends")):
            if d == digest:
                state.update(b",")
            else:
                if state is not None:
                    out.append((digest, state.hexdigest()))
                digest, state = d, hashlib.sha256()
            state.update(text.as_py().encode())
        yield pa.record_batch([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], ["digest", "ends"])
        out = []
    if state is not None:
        yield pa.record_batch([pa.array([digest], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["digest", "ends"])


# ---------------------------------------------------------------- the trie


def prefix_trie(conversations: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each distinct prefix
    of (conv_id, turns array<struct<mark string,size bigint>>), the empty one included.

    conv_id is a prefix's least conversation, parent_conv_id that of the prefix one turn shorter (null for the root). saved_tokens
    adds up, over all prefixes that begin with this one, the bytes of the last text times the conversations beyond the first.
    ends_sha256 hashes the decimal ids of the conversations that end here, ascending, with commas; such a list is hashed in
    order, so a very large one passes through one task, as texts of a block's ids each, in bounded memory.

    conv_ids are distinct and not null. Turns are told apart by 128 bits of SHA-256. Conversations without turns are the root's;
    a conversation's hashes stand in one row, 16 bytes a turn. An empty table gives no rows."""
    c = F.col
    rows = Table(conversations.select(c("conv_id").cast("long").alias("conv_id"), *paths_of(c("turns"))))
    n = rows.read().count()
    blocks = max(1, -(-n // block))
    dealt = rows.read().repartitionByRange(blocks, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    first = written(dealt.withColumn("block", F.spark_partition_id().cast("long")).mapInArrow(_block, _ROW))
    rows.drop()
    last = first.where("kind = 'block'").agg(F.max("block")).first()[0]
    parts, now, spread = [], first.where("kind = 'block'"), 1 if last is None else last + 1
    while True:
        spread = -(-spread // fan)
        now = written(now.groupBy(F.expr(f"block div {fan}").alias("group")).applyInArrow(_united(spread == 1, fan), _ROW))
        parts.append(now.where("kind = 'node'"))
        now = now.where("kind = 'block'")
        if spread == 1:
            break
    high = parts[0]
    for p in parts[1:]:
        high = high.unionByName(p)
    # Nodes that were open somewhere: a few for each block.
    told = first.where("kind = 'ends'").select("digest", "block", "ends").repartition("digest").sortWithinPartitions("digest", "block").mapInArrow(_ends, "digest binary, ends string")
    finals = high.where("digest is not null").select("digest", c("conv_id").alias("known"))
    ended = told.select(c("digest").alias("_ended"), c("ends").alias("_ends"))
    upper = high.join(ended, c("digest") == c("_ended"), "left").join(finals.select(c("digest").alias("_above"), "known"), c("above") == c("_above"), "left")
    upper = upper.withColumn("ends", F.coalesce("ends", "_ends", F.lit(NO_ENDS))).withColumn("parent", F.coalesce("parent", "known"))
    # A block's own open nodes, so that no open node's children meet in one task.
    opened = first.where("kind = 'open'").select("digest", c("block").alias("_block"), c("k").alias("_k")).join(finals, "digest").drop("digest")
    lower = first.where("kind = 'node'").join(opened, (c("block") == c("_block")) & (c("open") == c("_k")), "left").withColumn("parent", F.coalesce("parent", "known"))
    names = {"conv_id": "conv_id", "depth": "depth", "parent": "parent_conv_id", "n": "n_convs", "kids": "n_children", "leaves": "n_leaves", "saved": "saved_tokens", "ends": "ends_sha256"}
    return lower.select(*(c(a).alias(b) for a, b in names.items())).union(upper.select(*(c(a).alias(b) for a, b in names.items())))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that they share beginnings."""
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


#: CRC-32 bit by bit; prefixes are the joined hashes of their turns.
OP12_SQL = r"""
WITH t AS (SELECT conv_id, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS mark, strlen(coalesce(text, '')) AS size, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, mark, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS pos FROM t),
h AS (SELECT conv_id, xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t) AS d),
r AS (SELECT h.conv_id, 0 AS own, o.pos, mark, size FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5 WHERE o.pos <= h.h
  UNION ALL SELECT h.conv_id, 1, o.pos, mark, size FROM h JOIN o ON o.conv_id = h.conv_id WHERE o.pos > h.h),
s AS (SELECT h.conv_id, coalesce(string_agg(mark, '' ORDER BY own, pos), '') AS path, list(size ORDER BY own, pos) FILTER (WHERE mark IS NOT NULL) AS sizes, count(mark) AS len FROM h LEFT JOIN r USING (conv_id) GROUP BY h.conv_id),
p AS (SELECT conv_id, len, sizes, path, unnest(range(0, CAST(len AS BIGINT) + 1)) AS depth FROM s),
n AS (SELECT path[1:32 * depth] AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(CASE WHEN depth = 0 THEN 0 ELSE sizes[depth] END) AS bytes,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256 FROM p GROUP BY ALL),
k AS (SELECT n.*, q.conv_id AS parent_conv_id, (SELECT count(*) FROM n AS x WHERE x.depth = n.depth + 1 AND x.key[1:32 * n.depth] = n.key) AS n_children FROM n LEFT JOIN n AS q ON q.depth = n.depth - 1 AND q.key = n.key[1:32 * q.depth]),
u AS (SELECT key[1:32 * d] AS key, d AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM k) AS x GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM k JOIN u USING (key, depth)
"""
