"""Inputs derived from the given tables: judge texts, findings, citations and scripted conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One judge text for each labelled document; the shape goes by doc_id mod 8. Runs on Spark and on the oracle alike.
RAW_SQL = """
select d.doc_id, l.toxic, l.quality, d.text, concat(
  case cast(d.doc_id % 8 as int) when 1 then concat('```json',chr(10)) when 2 then 'Review notes: '
       when 4 then concat('```',chr(10)) else '' end,
  case when d.doc_id % 8 in (0,1,2,7) then concat(
         '{"finding": "', case when l.toxic=1 then 'toxic' else 'none' end,
         '", "refuted": ', case when l.toxic=1 then 'true' else 'false' end,
         ', "confidence": "', case cast(d.doc_id % 4 as int) when 0 then 'HIGH' when 1 then ' medium '
                                   when 2 then 'low' else 'certain' end,
         '", "blocking": ', case when d.doc_id % 8 = 7
                                 then case when l.quality=0 then '"contradiction"' else '"future"' end
                                 else '"none"' end,
         ', "evidence_refs": [{"source": "', case when d.doc_id % 7 = 0 then 'other' else 'text' end,
         '", "location": "w:1", "snippet": "', case when d.doc_id % 5 = 0 then 'zzz-not-present'
                                                    else regexp_extract(d.text, '[A-Za-z]+', 0) end,
         '", "kind": "text"}]',
         ', "findings": [', case when l.toxic=1
              then concat('{"kind": "gap", "location": "doc:', cast(d.doc_id % 3 as string), '", "detail": "toxic"}')
              else '{"kind": "", "location": " ", "detail": ""}' end,
         '], "reasoning": "r', cast(d.doc_id as string), '"}')
       when d.doc_id % 8 in (3,4) then case when l.toxic=1 then 'Refuted.' else 'Not Refuted' end
       when d.doc_id % 8 = 5 then 'some prose without a decision'
       else concat('{"finding": bad}', chr(10), case when l.toxic=1 then 'Refuted' else 'Not Refuted!' end) end,
  case cast(d.doc_id % 8 as int) when 1 then concat(chr(10),'```') when 2 then ' End.'
       when 4 then concat(chr(10),'```') else '' end) as raw
from {documents} d join {labels} l on d.doc_id = l.doc_id
"""


def judge_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, toxic, quality, text, raw)."""
    # Braces of the JSON inside are literal, so only the two tables are filled in: as files, which leaves no view behind.
    named = lambda name: f"parquet.`{sf_dir}/{name}.parquet`"
    return spark.sql(RAW_SQL.replace("{documents}", named("documents")).replace("{labels}", named("labels")))


def raw_sql() -> str:
    return RAW_SQL.replace("{documents}", "documents").replace("{labels}", "labels")


_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, findings): a finding for each line; open returns of flag N are blank."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_linestatus")
    open_ = (c("l_returnflag") == "N") & (c("l_linestatus") == "O")
    part = lambda x: F.when(open_, F.lit("")).otherwise(x)
    finding = F.struct(part(c("l_returnflag")).alias("kind"), part(F.concat(F.lit("line:"), c("l_linenumber").cast("string"))).alias("location"), part(c("l_linestatus")).alias("detail"))
    return rows.groupBy("l_orderkey").agg(F.collect_list(finding).alias("findings"))


def order_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, refs, required, least): citations of an order from its lines, and the rule for it."""
    c = F.col
    source = F.when(c("l_returnflag") == "A", "invoice").when(c("l_returnflag") == "R", "receipt").otherwise("manifest")
    snippet = F.when(c("l_linenumber") == 7, " ").otherwise(c("l_linestatus"))
    lines = table(spark, sf_dir, "lineitem")
    ref = F.struct(source.alias("source"), F.lit("").alias("location"), snippet.alias("snippet"), F.lit("text").alias("kind"))
    refs = lines.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*_LINE_ORDER, ref.alias("ref")))), lambda x: x["ref"]).alias("refs"))
    names = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    required = F.when(c("o_orderstatus") == "F", names("invoice", "receipt")).when(c("o_orderstatus") == "O", names("manifest")).otherwise(names())
    orders = table(spark, sf_dir, "orders").select("o_orderkey", required.alias("required"), (c("o_orderkey") % 3).cast("int").alias("least"))
    empty = F.array().cast("array<struct<source:string,location:string,snippet:string,kind:string>>")
    return orders.join(refs, "o_orderkey", "left").withColumn("refs", F.coalesce("refs", empty))


def conversation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, data): the text of turn 0 as `content`."""
    first = table(spark, sf_dir, "conversations").where("turn = 0")
    return first.select(F.col("conv_id").alias("case_id"), F.create_map(F.lit("content"), F.col("text")).alias("data"))


def conversation_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, call_idx, raw): a scripted answer for each turn, by (3 conv_id + turn^2) mod 5."""
    c = F.col
    rows = table(spark, sf_dir, "conversations")
    word = rows.where("turn = 0").select("conv_id", F.regexp_extract("text", "[A-Za-z]+", 0).alias("word"))
    rows = rows.select("conv_id", "turn").join(word, "conv_id")
    shape = (c("conv_id") * 3 + c("turn") * c("turn")) % 5
    ref = F.concat(F.lit('"evidence_refs": [{"source": "content", "location": "t0", "snippet": "'), c("word"), F.lit('", "kind": "text"}]'))
    refuted = lambda d: F.concat(F.lit('{"finding": "gap", "refuted": true, '), ref, F.lit(', "findings": [{"kind": "gap", "location": "t0", "detail": "d'), d.cast("string"), F.lit('"}], "reasoning": "gap"}'))
    raw = (
        F.when(shape == 0, refuted(c("conv_id") % 2)).when(shape == 1, refuted(c("turn") % 2))
        .when(shape == 2, F.concat(F.lit('{"finding": "none", "refuted": false, '), ref, F.lit(', "reasoning": "clean"}')))
        .when(shape == 3, F.lit("Refuted")).otherwise(F.lit("prose"))
    )
    return rows.select(c("conv_id").alias("case_id"), c("turn").cast("int").alias("call_idx"), raw.alias("raw"))
