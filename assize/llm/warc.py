"""WARC archives and their index.

Captures are written by Spark's text sink, a record a row, as gzip files of any store that Spark writes. They are read by its text
source, cut where a record seems to begin and put together again by the records' own lengths, so a task holds one record of an
archive however long that is. Each archive gives locally sorted runs of index lines; the shuffle cuts all runs at common bounds,
and each range is a k-way merge of its runs by a loser tree on (URL key, time): one after the other, the ranges are the index in
order, from which places and capture histories follow by sums over ranges.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Table, lean, shared_folder, table, written

#: Fixed texts of the format.
VERSION, NEWLINE = b"WARC/1.1", b"\r\n"
BETWEEN = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of an archive, index lines of a sorted run and of a range, and runs that one tree merges.
ARCHIVE_RECORDS, RUN_LINES, RANGE_LINES, FAN_IN = 50_000, 20_000, 50_000, 512
#: Payloads that more than one in so many captures have are broadcast; there are no more than so many.
COMMON = 1000
_CUT = BETWEEN + VERSION.decode() + "\r\n"
_INDEX = [
    ("archive", "string"), ("start", "bigint"), ("url_key", "string"), ("at", "string"), ("url", "string"), ("id", "bigint"), ("record_id", "string"), ("record_type", "string"),
    ("payload_bytes", "bigint"), ("payload_digest", "string"), ("refers_to", "bigint"), ("intact", "boolean"), ("run", "string"), ("line", "bigint"),
]
_NAMES = [n for n, _ in _INDEX]
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
_own = re.compile(r"<urn:x-capture:(-?\d+)\.")


# ---------------------------------------------------------------- writing


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base 32 of the SHA-1 of a text's bytes: five hexadecimal digits are four of base 32."""
    part = lambda i: F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.upper(F.concat(*map(part, range(8)))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(captures: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Captures (id, url, at timestamp, payload) with `digest`, `size`, their `place` in the table and `first`: the capture with
    the least id among those with the same payload (null ids last, equal ids in the table's order), null for that one itself,
    for payloads that only one capture has, and for payloads of fewer than `least_bytes` bytes.

    Payloads are equal if SHA-1, length and a 64-bit hash are. Those that more than one in COMMON captures have, 1,000 at most,
    are broadcast; the others meet their captures in a join. The table must give its rows in the same order twice."""
    c = F.col
    rows = captures.select(
        c("id").cast("long").alias("id"), c("url").cast("string").alias("url"), c("at").cast("timestamp").alias("at"), F.coalesce(c("payload").cast("string"), F.lit("")).alias("payload"), F.monotonically_increasing_id().alias("place")
    ).withColumns({"digest": base32_sha1(c("payload")), "size": F.octet_length("payload").cast("long"), "check": F.xxhash64("payload")})
    key = ["digest", "size", "check"]
    capture = F.struct(c("id").isNull().alias("none"), "id", "place", "url", "at")
    again = written(rows.where(c("size") >= least_bytes).groupBy(*key).agg(F.min(capture).alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = captures.count()
    hot = again.where(c("n") > total // COMMON).select(*key, c("first").alias("_hot"))
    cold = again.where(c("n") <= total // COMMON).select(c("digest").alias("_digest"), c("size").alias("_size"), c("check").alias("_check"), c("first").alias("_cold"))
    # What has met its first already looks for a key that nothing has, and that spreads.
    sought = F.when(c("_hot").isNull(), c("digest")).otherwise(F.concat(F.lit("!"), c("place").cast("string")))
    met = rows.join(F.broadcast(hot), key, "left").withColumn("_sought", sought).join(cold, (c("_sought") == c("_digest")) & (c("size") == c("_size")) & (c("check") == c("_check")), "left")
    first = F.coalesce("_hot", "_cold")
    return met.select("id", "url", "at", "payload", "place", "digest", "size", F.when(first["place"] != c("place"), first).alias("first"))


def _name(id_: Column, place: Column) -> Column:
    return F.concat(F.lit("<urn:x-capture:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit("."), place.cast("string"), F.lit(">"))


def _date(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _header(name: str, value: Column) -> Column:
    """A header line; none for null. Line ends in the value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def record(rows: DataFrame) -> Column:
    """A capture of `with_revisits` as a record, without the line ends behind it: a response with its payload, or a revisit that
    keeps the HTTP headers alone and names the response."""
    c = F.col
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), c("size").cast("string"), F.lit("\r\n\r\n"))
    first = c("first")
    revisit = first.isNotNull()
    head = [
        F.lit(VERSION.decode() + "\r\n"), _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), _header("WARC-Record-ID", _name(c("id"), c("place"))), _header("WARC-Date", _date(c("at"))),
        _header("WARC-Target-URI", c("url")), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("digest"))), _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(revisit, _name(first["id"], first["place"]))), _header("WARC-Refers-To-Target-URI", first["url"]), _header("WARC-Refers-To-Date", _date(first["at"])),
        _header("Content-Type", F.lit("application/http;msgtype=response")),
        _header("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(c("size"))).cast("string")), F.lit("\r\n"),
    ]
    return F.concat(*head, http, F.when(revisit, F.lit("")).otherwise(c("payload")))


def _about() -> str:
    body = "software: assize\r\nformat: WARC File Format 1.1\r\n"
    return f"{VERSION.decode()}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, body)}>\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n{body}"


def write_archives(captures: DataFrame, path: str, least_bytes: int = 0, records: int = ARCHIVE_RECORDS) -> None:
    """Writes captures (id, url, at timestamp, payload) below `path`, as gzip archives of at most `records` records.

    Of captures with equal payloads of `least_bytes` bytes or more the one with the least id is the response and the others
    revisit it. Null payloads are empty, null URLs and times leave their headers out, null ids are written as none. Repeated
    rows are captures of their own. The first archive of a task begins with a warcinfo record. An empty table leaves no record."""
    rows = with_revisits(captures, least_bytes)
    begins = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    text = F.concat(F.when(begins, F.lit(_about() + BETWEEN)).otherwise(F.lit("")), record(rows))
    rows.select(text.alias("value")).write.option("lineSep", BETWEEN).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


# ---------------------------------------------------------------- reading


class Record(NamedTuple):
    start: int
    headers: dict[str, str]
    block: bytes


def parsed(pieces: Iterable[bytes]) -> Iterator[Record]:
    """The records of one archive, from its bytes in pieces of any size; raises ValueError where they are none."""
    held, start = bytearray(), 0
    for piece in pieces:
        held += piece
        while True:
            skipped = len(held) - len(held.lstrip(b"\r\n"))
            del held[:skipped]
            start += skipped
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            first, *lines = held[:end].split(NEWLINE)
            if not first.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {start}")
            headers = {}
            for line in lines:
                name, _, value = line.partition(b":")
                headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").removeprefix(" ")
            size = end + 4 + int(headers["content-length"])
            if len(held) < size:
                break
            yield Record(start, headers, bytes(held[end + 4 : size]))
            del held[:size]
            start += size
    if held.strip(b"\r\n"):
        raise ValueError(f"the record at byte {start} is cut off")


def url_key(url: str | None) -> str | None:
    """Sorts a site's pages together: the host's labels reversed, without scheme, www., fragment and upper case in the host."""
    if url is None:
        return None
    rest = re.sub(r"(?s)#.*\Z", "", re.sub(r"\A[a-zA-Z][a-zA-Z0-9+.-]*://", "", url))
    at = re.search("[/?]", rest)
    host, tail = (rest, "") if at is None else (rest[: at.start()], rest[at.start() :])
    host = re.sub("\\Awww[.]", "", host.translate(_LOWER))
    return ",".join(reversed(host.split("."))) + ")" + (tail or "/")


_LOWER = {x: x + 32 for x in range(65, 91)}


def _line(archive: str, r: Record) -> tuple:
    """An index line of a response, revisit or resource; `intact` says that payload and digest agree."""
    h = r.headers
    kind, digest = h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    head, _, payload = r.block.partition(b"\r\n\r\n") if h.get("content-type", "").startswith("application/http") else (b"", b"", r.block)
    size, intact = len(payload), None
    if kind == "revisit":
        told = re.search(rb"(?im)^content-length: *(\d+)", head)
        size = int(told[1]) if told else None
    elif digest is not None:
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        digest, intact = found, found == digest
    own, first = _own.match(h.get("warc-record-id", "")), _own.match(h.get("warc-refers-to", ""))
    url = h.get("warc-target-uri")
    return (archive, r.start, url_key(url), h.get("warc-date"), url, int(own[1]) if own else None, h.get("warc-record-id"), kind, size, digest, int(first[1]) if first else None, intact)


def _order(line: tuple) -> tuple:
    """By URL key, time, id and place; nulls first."""
    key, at, id_ = line[2], line[3], line[5]
    return key is not None, key or "", at is not None, at or "", id_ is not None, id_ or 0, line[0], line[1]


def _batch(lines: list[tuple], names: list[tuple[str, str]]) -> pa.RecordBatch:
    columns = list(zip(*lines)) if lines else [()] * len(names)
    return pa.record_batch([pa.array(x, _TYPES[t]) for x, (_, t) in zip(columns, names)], [n for n, _ in names])


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(archive, its pieces) one after the other; each archive's pieces must be used up."""
    rows = ((path.as_py(), value.as_py()) for b in batches for path, value in zip(b.column("archive"), b.column("value")))
    cut, waiting = _CUT.encode(), next(rows, None)

    def pieces(path: str) -> Iterator[bytes]:
        nonlocal waiting
        yield waiting[1]
        for waiting in rows:
            if waiting[0] != path:
                return
            yield cut + waiting[1]
        waiting = None

    while waiting is not None:
        yield waiting[0], pieces(waiting[0])


def _runs(lines_of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archive, pieces in _files(batches):
            held, done = [], 0

            def sorted_run() -> pa.RecordBatch:
                held.sort(key=_order)
                return _batch([(*x, f"{archive}:{done}", i) for i, x in enumerate(held)], _INDEX)

            for r in parsed(pieces):
                if r.headers.get("warc-type") in ("response", "revisit", "resource"):
                    held.append(_line(archive, r))
                if len(held) == lines_of:
                    yield sorted_run()
                    held, done = [], done + 1
            if held:
                yield sorted_run()

    return run


def read_runs(spark: SparkSession, path: str, run_lines: int = RUN_LINES) -> DataFrame:
    """Index lines of all archives below `path` (gzip files, whose name ends in .gz), in sorted runs of at most `run_lines`:
    column `run` names a line's run, `line` its place there. Lines name the archive and where the record starts in it, once it
    is uncompressed. Records of other types than response, revisit and resource have no line. A file that is no archive, or
    ends within a record, raises."""
    rows = spark.read.option("lineSep", _CUT).text(path).select(F.col("_metadata.file_path").alias("archive"), F.col("value").cast("binary").alias("value"))
    return rows.mapInArrow(lean(_runs(run_lines)), ", ".join(f"{n} {t}" for n, t in _INDEX))


# ---------------------------------------------------------------- merging


def merged(runs: list[list], key) -> Iterator:
    """All elements of sorted runs in order, by a tree of losers: an inner node holds the run that lost there, so each element
    taken is replaced by one comparison a level."""
    k = len(runs)
    feeds = [iter(r) for r in runs]
    end = (1,)

    def drawn(i: int) -> None:
        x = next(feeds[i], feeds)
        heads[i], values[i] = (end, None) if x is feeds else ((0, *key(x)), x)

    heads, values = [end] * k, [None] * k
    for i in range(k):
        drawn(i)
    losers = [-1] * k  # losers[0] is the winner

    def play(i: int) -> None:
        at = (i + k) // 2
        while at > 0:
            if losers[at] < 0:
                losers[at] = i
                return
            if heads[losers[at]] < heads[i]:
                losers[at], i = i, losers[at]
            at //= 2
        losers[0] = i

    for i in range(k):
        play(i)
    while k and heads[losers[0]] is not end:
        i = losers[0]
        yield values[i]
        drawn(i)
        at = (i + k) // 2
        while at > 0:
            if heads[losers[at]] < heads[i]:
                losers[at], i = i, losers[at]
            at //= 2
        losers[0] = i


_MERGED = [x for x in _INDEX if x[0] not in ("run", "line")] + [("range", "bigint"), ("nth", "bigint"), ("capture", "bigint")]


def _range(fan_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One range of the index: its runs, each in order, merged; `nth` is a line's place in the range, `capture` its place
        among the range's lines of its URL key."""
        runs, number = {}, 0
        for b in batches:
            for *line, range_ in zip(*(b.column(n).to_pylist() for n in (*_NAMES, "range"))):
                runs.setdefault(line[-2], []).append(line)
                number = range_
        held = list(runs.values())
        for r in held:
            r.sort(key=lambda x: x[-1])
        while len(held) > fan_in:
            held = [list(merged(held[i : i + fan_in], _order)) for i in range(0, len(held), fan_in)]
        out, before, capture = [], None, 0
        for nth, line in enumerate(merged(held, _order)):
            capture = capture + 1 if nth and line[2] == before else 1
            before = line[2]
            out.append((*line[:-2], number, nth, capture))
            if len(out) == 10_000:
                yield _batch(out, _MERGED)
                out = []
        if out:
            yield _batch(out, _MERGED)

    return run


def capture_index(runs: DataFrame, range_lines: int = RANGE_LINES, fan_in: int = FAN_IN) -> DataFrame:
    """The index in order of (URL key, time, id, archive, start), nulls first: the lines of `read_runs` with `position` (place in
    the whole index, from 0) and `capture` (place in the history of its URL key, from 1), in about one partition for each
    `range_lines` lines. A key with very many captures goes on from one range to the next."""
    c = F.col
    n = runs.count()
    order = ["url_key", "at", "id", "archive", "start"]
    dealt = runs.repartitionByRange(max(1, -(-n // range_lines)), *order).withColumn("range", F.spark_partition_id().cast("long"))
    lines = written(dealt.mapInArrow(lean(_range(fan_in)), ", ".join(f"{n} {t}" for n, t in _MERGED)))
    place = F.struct("nth", "url_key", "capture")
    ends = lines.groupBy("range").agg(F.count("*").alias("n"), F.min(place)["url_key"].alias("first"), F.max(place).alias("last"))
    # A row for each range.
    up_to = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("range", "first", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("lines"), c("last.url_key").alias("key"), c("last.capture").alias("tail"))
    # What earlier ranges end with of the key that a range begins with.
    asked = before.select("range", c("first").alias("key"), F.lit(0).alias("ends"), F.lit(0).cast("long").alias("tail")).union(before.select("range", "key", F.lit(1), "tail"))
    of_key = Window.partitionBy("key").orderBy("range", "ends").rowsBetween(Window.unboundedPreceding, 0)
    carried = asked.withColumn("carried", F.sum("tail").over(of_key)).where("ends = 0").select("range", "carried")
    known = before.select("range", "first", "lines").join(carried, "range")
    known = known.select(c("range").alias("_range"), c("first").alias("_first"), "lines", "carried")
    rows = lines.join(known, c("range") == c("_range"))
    capture = c("capture") + F.when(c("url_key").eqNullSafe(c("_first")), c("carried")).otherwise(F.lit(0))
    return rows.select(*(n for n, _ in _MERGED if n not in ("range", "nth", "capture")), (c("lines") + c("nth")).alias("position"), capture.alias("capture"))


def op11_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives and back, in the order of the merged index. The table has no times: a page's is as many seconds
    after the start of 2024 as its id says. The archives are dropped once they are read."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod("page_id", F.lit(10**11)))
    captures = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", at.alias("at"), F.col("html").alias("payload"))
    archives = Table.place(spark)
    write_archives(captures, archives.path)
    runs = written(read_runs(spark, archives.path))
    archives.drop()
    rows = capture_index(runs)
    return rows.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture", "position")


#: Base 32 from five hexadecimal digits at a time. Revisits of one page's repeated rows name that page.
OP11_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, url, regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://', ''), '(?s)#.*$', '') AS rest FROM pages),
k AS (SELECT *, regexp_extract(rest, '^[^/?]*') AS host FROM p),
u AS (SELECT *, array_to_string(list_reverse(string_split(regexp_replace(translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www[.]', ''), '.')), ',') || ')' || coalesce(nullif(substr(rest, length(host) + 1), ''), '/') AS url_key, sha1(html) AS hex FROM k),
d AS (SELECT *, list_transform(range(8), lambda i: list_reduce(list_transform(string_split(substr(hex, CAST(5 * i + 1 AS BIGINT), 5), ''), lambda x: CAST(instr('0123456789abcdef', x) - 1 AS BIGINT)), lambda a, b: 16 * a + b)) AS n FROM u),
b AS (SELECT *, array_to_string(flatten(list_transform(n, lambda x: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> s) & 31) + 1 AS BIGINT), 1)))), '') AS payload_digest,
  row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS nth, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS least FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN least END AS refers_to, url_key,
  row_number() OVER (PARTITION BY url_key ORDER BY page_id NULLS FIRST) AS capture, row_number() OVER (ORDER BY encode(url_key) NULLS FIRST, page_id NULLS FIRST) - 1 AS position
FROM b
"""
