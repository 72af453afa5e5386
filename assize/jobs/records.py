"""Queries over rule books and transcripts that lie in files, and over sources with very many citations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.functions.verdicts import parse_verdict, prepare
from assize.jobs.oracle import _PARTS, _SAID
from assize.jobs.queries import _brand_laws
from assize.operators import citations
from assize.sources import files
from assize.sources.shared import shared_folder
from assize.sources.tables import conversation_responses, table
from assize.streaming import upserts
from assize.streaming.events import drained

c = F.col


def _shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' laws by brand, in files of some hundred parts."""
    return _brand_laws(spark, sf_dir).withColumn("shelf", F.expr("ord div 100"))


def q_book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundred parts' laws are a file; all files are read back, later laws of a name at the earlier ones' places."""
    at = shared_folder(spark)
    files.write_books(_shelves(spark, sf_dir), at, "shelf")
    rows = files.read_books(spark, at).withColumn("book", F.regexp_extract("file", "shelf=([0-9]+)", 1).cast("int"))
    return rows.select("book", "ord", "name", "description", "default_to_reject")


def s_book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream in two deliveries, the later shelves first: a catalog that keeps each brand's newest law."""
    at, out = shared_folder(spark), shared_folder(spark)
    rows = _shelves(spark, sf_dir)
    half = rows.agg(F.max("shelf")).first()[0] // 2
    for part in (rows.where(c("shelf") > half), rows.where(c("shelf") <= half)):
        files.write_books(part, at, "shelf")
        edits = files.read_books(spark, at, stream=True).withColumn("shelf", F.regexp_extract("file", "shelf=([0-9]+)", 1).cast("int"))
        placed = edits.select("name", (c("shelf").cast("long") * 1000 + c("ord")).alias("ord"), "description", "default_to_reject")
        upserts.keep_catalog(placed, out).start().awaitTermination()
    return upserts.newest_catalog(spark, out).select("name", "description", "default_to_reject")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripted answers; of the calls whose sum with the case ends in 9 the answer is missing, so their lines are malformed."""
    rows = conversation_responses(spark, sf_dir)
    return rows.withColumn("raw", F.when((c("case_id") + c("call_idx")) % 10 != 9, c("raw")))


def _told(rows: DataFrame) -> DataFrame:
    said = rows.where("malformed is null").withColumn("v", parse_verdict(c("raw")))
    return said.select("case_id", c("call_idx").cast("long").alias("call_idx"), c("v.tier").alias("tier"), c("v.refuted").alias("refuted"))


def q_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers through a transcript's files and the parser; malformed lines are left out."""
    prepare(spark)
    at = shared_folder(spark)
    files.write_transcript(_lines(spark, sf_dir), at)
    return _told(files.read_transcript(spark, at))


def s_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, in two deliveries: the second one goes on from the first one's offsets."""
    prepare(spark)
    at, out, rows = shared_folder(spark), shared_folder(spark), None
    lines = _lines(spark, sf_dir)
    for part in (lines.where("call_idx % 2 = 0"), lines.where("call_idx % 2 = 1")):
        files.write_transcript(part, at)
        rows = drained(_told(files.read_transcript(spark, at, stream=True)), "append", out)
    return rows


def q_citation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence of a document is cited from it, every second one in lower case: how many citations hold."""
    docs = table(spark, sf_dir, "documents")
    said = docs.select(c("doc_id").alias("case_id"), F.lit("text").alias("source"), F.posexplode(F.split("text", r"\. ")).alias("i", "snippet"))
    refs = said.withColumn("snippet", F.when(c("i") % 2 == 1, F.lower("snippet")).otherwise(c("snippet")))
    sources = docs.select(c("doc_id").alias("case_id"), F.lit("text").alias("source"), c("text").alias("content"))
    return citations.verify_at_once(refs, sources).groupBy(c("case_id").alias("doc_id")).agg(F.count("*").alias("n"), F.count_if("verified").alias("n_verified"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith(("q_", "s_"))}

_TOLD_SQL = f"""WITH {_SAID}, t AS (SELECT conv_id AS case_id, CAST(turn AS BIGINT) AS call_idx, (conv_id * 3 + turn * turn) % 5 AS shape FROM conversations)
SELECT case_id, call_idx, CAST(CASE shape WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 1 END AS INTEGER) AS tier, shape <> 2 AS refuted FROM t WHERE (case_id + call_idx) % 10 <> 9"""
ORACLE_SQL = {
    "q_book_files": _PARTS + """, b AS (SELECT ord // 100 AS book, row_number() OVER (PARTITION BY ord // 100 ORDER BY ord) - 1 AS pos, p_brand AS brand, description, default_to_reject FROM book JOIN part ON ord = p_partkey)
      SELECT CAST(book AS INTEGER) AS book, CAST(min(pos) AS INTEGER) AS ord, brand AS name, arg_max(description, pos) AS description, arg_max(default_to_reject, pos) AS default_to_reject FROM b GROUP BY book, brand""",
    "s_book_files": _PARTS + "SELECT p_brand AS name, arg_max(description, ord) AS description, arg_max(default_to_reject, ord) AS default_to_reject FROM book JOIN part ON ord = p_partkey GROUP BY p_brand",
    "q_transcripts": _TOLD_SQL,
    "s_transcripts": _TOLD_SQL,
    "q_citation_scan": """WITH l AS (SELECT doc_id, text, string_split(text, '. ') AS p FROM documents WHERE text IS NOT NULL),
      s AS (SELECT doc_id, text, unnest(range(len(p))) AS i, p FROM l),
      r AS (SELECT doc_id, text, trim(CASE WHEN i % 2 = 1 THEN lower(p[i + 1]) ELSE p[i + 1] END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) AS x FROM s)
      SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE x <> '' AND contains(text, x)) AS n_verified FROM r GROUP BY doc_id""",
}
