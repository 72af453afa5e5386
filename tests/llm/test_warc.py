"""Archives there and back, the tree of losers, and the index against plain Python."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest

from assize.llm import warc

SCHEMA = "id bigint, url string, at timestamp, payload string, digest string, first string, place string, run string"


def captures(rows):
    """Rows (id, url, seconds, payload), with columns whose names the operator uses itself."""
    from datetime import datetime, timezone

    return [(i, u, None if s is None else datetime.fromtimestamp(s, timezone.utc).replace(tzinfo=None), p, "d", "f", "p", "r") for i, u, s, p in rows]


def frame(spark, rows, parts=3):
    made = spark.createDataFrame(captures(rows), SCHEMA.replace("timestamp", "timestamp_ntz"))
    return made.withColumn("at", made["at"].cast("timestamp")).coalesce(parts)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    cut = "\r\n\r\nWARC/1.1\r\n"
    payloads = ["", None, "a", "ä é 世界   x", cut, "x" + cut + "Content-Length: 5\r\n\r\nhello", "\r\n", "\r\n\r\n\r\n" * 30, "y" * 300_000 + cut * 3, "\x00\x01", "same", "same", "same", None, ""]
    rows = [(i, f"http://www.Site{i % 3}.example.org/p/{rng.randint(0, 4)}?q#frag", 1000 + rng.randint(0, 5), p) for i, p in enumerate(payloads)]
    rows += [(None, None, None, "same"), (3, "u\r\nInjected: x", 5, "same"), (3, "u\r\nInjected: x", 5, "same"), (200, "HTTP://A.B", 7, "with\r\nlines"), (None, "", 1, None), (None, "", 1, None)]
    return rows


def test_pieces_of_any_size():
    records = [b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s" % (len(b), b) for b in (b"", b"abc", b"\r\n\r\nWARC/1.1\r\n", b"\r\n\r\n")]
    data = b"\r\n\r\n".join(records) + b"\r\n\r\n"
    for size in (1, 2, 3, 7, 50, 10_000):
        got = list(warc.parsed(data[i : i + size] for i in range(0, len(data), size)))
        assert [r.block for r in got] == [b"", b"abc", b"\r\n\r\nWARC/1.1\r\n", b"\r\n\r\n"]
        assert all(data[r.start :].startswith(b"WARC/1.1") for r in got)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parsed([data[:-9]]))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parsed([b"<html>\r\n\r\n"]))
    assert list(warc.parsed([])) == []


def test_losers():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randint(0, 9) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.merged(runs, lambda x: (x,))) == sorted(x for r in runs for x in r)


def test_round_trip(spark, odd, tmp_path):
    at = (tmp_path / "archives").as_uri()
    warc.write_archives(frame(spark, odd), at, records=4)
    files = sorted(Path(tmp_path, "archives").glob("*.gz"))
    assert len(files) > 3
    blocks = [(r.headers, r.block) for f in files for r in warc.parsed([gzip.decompress(f.read_bytes())])]
    assert any(h["warc-type"] == "warcinfo" for h, _ in blocks) and not any("injected" in h for h, _ in blocks)
    rows = [r.asDict() for r in warc.read_runs(spark, at, 3).collect()]
    assert len(rows) == len(odd)
    payloads = {}
    for h, b in blocks:
        if h["warc-type"] == "response":
            payload = b.partition(b"\r\n\r\n")[2]
            assert payload not in payloads
            payloads[payload] = h["warc-record-id"]
    assert set(payloads) == {(p or "").encode() for *_, p in odd}
    for r in rows:
        assert r["intact"] is (True if r["record_type"] == "response" else None)
    sizes = sorted(((p or "").encode() for *_, p in odd), key=lambda p: (len(p), p))
    assert sorted(r["payload_bytes"] for r in rows) == [len(p) for p in sizes]
    digest = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    assert sorted(r["payload_digest"] for r in rows) == sorted(map(digest, sizes))
    same = [r for r in rows if r["payload_digest"] == digest(b"same")]
    # Of the repeated row with id 3 one is the response.
    assert [(r["id"], r["record_type"]) for r in same if r["record_type"] == "response"] == [(3, "response")]
    assert sorted((r["id"] is None, r["id"], r["refers_to"]) for r in same if r["record_type"] == "revisit") == [(False, 3, 3), (False, 10, 3), (False, 11, 3), (False, 12, 3), (True, None, 3)]


def test_small_payloads_are_no_revisits(spark, tmp_path):
    at = (tmp_path / "small").as_uri()
    warc.write_archives(frame(spark, [(i, "u", i, "abc" if i % 2 else "abcdef") for i in range(8)]), at, least_bytes=5)
    rows = warc.read_runs(spark, at).collect()
    assert sorted((r.id, r.record_type) for r in rows) == [(i, "response" if i % 2 or i == 0 else "revisit") for i in range(8)]


def test_common_payloads(spark):
    """More than one in COMMON captures share a payload, others are shared by few."""
    rows = [(i, "u", i, "hot" if i % 3 == 0 else f"p{i // 2}") for i in range(3000)]
    got = {r.id: r["first"].id if r["first"] else None for r in warc.with_revisits(frame(spark, rows)).collect()}
    least = {}
    for i, _, _, p in rows:
        least.setdefault(p, i)
    assert got == {i: None if least[p] == i else least[p] for i, _, _, p in rows}


@pytest.mark.parametrize("lines, fan", [(4, 2), (10, 3), (1000, 512)])
def test_index(spark, odd, tmp_path, lines, fan):
    rng = random.Random(8)
    rows = odd + [(1000 + i, "http://hot.example/", rng.randint(0, 9), str(i)) for i in range(60)]
    at = (tmp_path / f"i{lines}").as_uri()
    warc.write_archives(frame(spark, rows), at, records=7)
    runs = warc.read_runs(spark, at, 5).cache()
    got = sorted(warc.capture_index(runs, lines, fan).collect(), key=lambda r: r.position)
    want = sorted((tuple(r) for r in runs.collect()), key=warc._order)
    assert [r.position for r in got] == list(range(len(rows)))
    assert [tuple(r)[:12] for r in got] == [w[:12] for w in want]
    seen = {}
    for r in got:
        seen[r.url_key] = seen.get(r.url_key, 0) + 1
        assert r.capture == seen[r.url_key]
    assert seen["example,hot)/"] == 60


def test_no_captures(spark, tmp_path):
    at = (tmp_path / "none").as_uri()
    warc.write_archives(frame(spark, []), at)
    runs = warc.read_runs(spark, at)
    assert runs.count() == 0 and warc.capture_index(runs).count() == 0


@pytest.mark.parametrize("url, key", [("http://www.Example.ORG/A?b#c", "org,example)/A?b"), ("https://m.a.b", "b,a,m)/"), ("a.b?x", "b,a)?x"), ("", ")/"), (None, None)])
def test_url_key(url, key):
    assert warc.url_key(url) == key
