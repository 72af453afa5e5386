"""The corpus pipeline: five stages over `documents`, each written as Parquet and reread as the next one's input.

Rows keep the columns of documents (doc_id, text, lang, source, n_chars) up to the last stage. Rows are told apart by
doc_id and a hash of all columns: different rows may share an id, and only rows repeated in full are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.llm.common import Table, small_batches
from assize.llm.packing import packed_documents
from assize.llm.perplexity import classify
from assize.llm.quality_rules import CURRENT, POLICIES, ledger, verdict
from assize.llm.simhash import staying
from assize.llm.substring_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _key() -> Column:
    """The id, and 64 bits of the whole row; a null id, which labels never name, comes before all others."""
    whole = F.xxhash64(*(x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())))
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), whole.alias("row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps."""
    return ledger(docs.select(*COLUMNS)).where(verdict(POLICIES[CURRENT])).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within their language's threshold."""
    small_batches(spark)
    keyed = docs.select(*COLUMNS).withColumn("key", _key())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected = classify(keyed, labels, id_col="key", labelled="key.id", label_col="doc_id").where("not kept").select("key").distinct()
    return keyed.join(rejected, "key", "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. Rows repeated in full, in all columns, are one row."""
    small_batches(spark)
    keyed = docs.select(*COLUMNS).withColumn("key", _key())
    repeated = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    if not repeated.isEmpty():
        twice = keyed.join(repeated, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*", "key")
        keyed = keyed.join(repeated, "key", "left_anti").unionByName(twice)
    return keyed.join(staying(keyed, id_col="key"), "key", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that an earlier place has; a text may end up empty."""
    small_batches(spark)
    rows = remove_repeats(docs.select(*COLUMNS), as_text=True)
    return rows.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 tokens."""
    small_batches(spark)
    import public_tokenizers

    packed = packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), lasting=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, through Parquet in the shared folder. A stage's table is dropped once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        made = Table(stage(spark, docs, sf_dir))
        docs = made.read()
        if before is not None:
            before.drop()
        before = made
    return docs


#: Perplexity, SimHash and the tokenizer have no SQL form.
ORACLE_SQL = None
