"""Citations against the case's own sources, over long tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from assize.functions.evidence import citation_failure, cited
from assize.functions.text import blank, strip
from assize.operators.scans import carried
from assize.sources.shared import kept


def sources_of(cases: DataFrame, case: str = "case_id", data: str = "data") -> DataFrame:
    """(case, source, content) from a map of texts."""
    return cases.select(case, F.explode(data).alias("source", "content")).where("content is not null")


def latest_sources(sources: DataFrame, case: str = "case_id", order: str = "ord") -> DataFrame:
    """The last content of each source of a case."""
    return sources.groupBy(case, "source").agg(F.max_by("content", order).alias("content"))


def verify(refs: DataFrame, sources: DataFrame, case: str = "case_id") -> DataFrame:
    """`refs` (case, source, snippet, ...) with `verified`: the stripped snippet occurs in the content of its source in the
    same case. Unknown sources and blank snippets are unverified.

    An equi-join on (case, source) comes first, so that the substring test runs once for each citation."""
    known = sources.select(F.col(case).alias("_case"), F.col("source").alias("_source"), "content")
    joined = refs.join(known, (F.col(case) == F.col("_case")) & (F.col("source") == F.col("_source")), "left")
    return joined.withColumn("verified", cited(F.col("snippet"), F.col("content"))).drop("_case", "_source", "content")


def failures(verified: DataFrame, case: str = "case_id", order: str = "pos") -> DataFrame:
    """(case, all_verified, messages): a message for each citation that fails, in their order."""
    message = F.when(~F.col("verified"), F.struct(F.col(order).alias("o"), citation_failure(F.col("snippet"), F.col("source")).alias("m")))
    return verified.groupBy(case).agg(F.bool_and("verified").alias("all_verified"), F.transform(F.sort_array(F.collect_list(message)), lambda x: x["m"]).alias("messages"))


#: Citations of a source are dealt to blocks of about so many characters.
SNIPPET_BLOCK = 1 << 20
#: Up to so many citations of a block are looked for one by one; more of them in one pass over the content.
ONE_BY_ONE = 32


@F.pandas_udf(ArrayType(BooleanType()))
def _found(content: pd.Series, snippets: pd.Series) -> pd.Series:
    """For each content, which of its snippets occur in it, by one automaton of them all and one pass."""
    import ahocorasick

    out = []
    for text, wanted in zip(content, snippets):
        if text is None:
            out.append(None)
            continue
        automaton = ahocorasick.Automaton()
        for snippet in wanted:
            automaton.add_word(snippet, snippet)
        automaton.make_automaton()
        missing = set(wanted)
        for _, snippet in automaton.iter(text):
            missing.discard(snippet)
            if not missing:
                break
        out.append([snippet not in missing for snippet in wanted])
    return pd.Series(out, dtype=object)


def verify_at_once(refs: DataFrame, sources: DataFrame, case: str = "case_id", block: int = SNIPPET_BLOCK) -> DataFrame:
    """What `verify` gives, for sources with very many citations: a content is read once for each block of them, not once each.

    Citations meet by (case, source, block), as an array a row. Only sources with more than `block` characters of snippets have
    several blocks; their content goes to each. Equal rows of such a source are counted first, so that a citation under a third
    of all rows is one entry. Citations without a case, source or snippet are false without a look. (case, source) of `sources`
    is unique; no column of `refs` may be a map."""
    c = F.col
    own = refs.columns
    asked = c(case).isNotNull() & c("source").isNotNull() & ~F.coalesce(blank(c("snippet")), F.lit(True))
    rows = refs.where(asked).select(c(case).alias("_case"), c("source").alias("_source"), F.struct(*own).alias("_ref"))
    size = F.sum(F.length(c("snippet")) + 64)
    # Written first: Spark sees its size, and sends it to the citations' tasks only where it is small.
    large = kept(refs.where(asked).groupBy(c(case).alias("_case"), c("source").alias("_source")).agg(F.ceil(size / block).cast("int").alias("_n")).where("_n > 1"))
    few = rows.join(large, ["_case", "_source"], "left_anti").withColumns({"_block": F.lit(0), "_copies": F.lit(1).cast("long")})
    many = rows.join(large, ["_case", "_source"]).withColumn("_block", F.pmod(F.xxhash64("_ref"), c("_n")).cast("int"))
    many = many.groupBy("_case", "_source", "_block", "_ref").agg(F.count("*").alias("_copies"))
    # One column names the block: of several, Spark drops those that turn out constant, and then deals all citations once more.
    at = F.struct("_case", "_source", "_block").alias("_at")
    together = few.unionByName(many).select(at, "_ref", "_copies").groupBy("_at").agg(F.collect_list(F.struct("_ref", "_copies")).alias("_refs"))
    texts = sources.where("content is not null").select(c(case).alias("_case"), c("source").alias("_source"), "content").join(large, ["_case", "_source"], "left")
    texts = texts.select("_case", "_source", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)).alias("_block"), "content").select(at, "content")
    met = together.join(texts, "_at", "left").withColumn("_snippets", F.transform("_refs", lambda r: strip(r["_ref"]["snippet"])))
    one_pass = (F.size("_snippets") > ONE_BY_ONE) & c("content").isNotNull()
    singly = F.transform("_snippets", lambda s: F.coalesce(F.contains(c("content"), s), F.lit(False)))
    met = met.withColumn("_hits", F.coalesce(_found(F.when(one_pass, c("content")), F.when(one_pass, c("_snippets"))), singly))
    each = met.select(F.explode(F.arrays_zip("_refs", "_hits")).alias("x")).select("x._refs.*", c("x._hits").alias("verified"))
    told = each.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), c("_copies")))).select("_ref.*", "verified")
    return told.unionByName(refs.where(~asked).withColumn("verified", F.lit(False)))


#: Snippets without a whole word inside have no key: so many of them at a time are broadcast and compared with every text.
KEYLESS = 1000
#: So many snippets' keys at most stand in the plan as a set of numbers.
KEYS_IN_PLAN = 10_000


def contained(texts: DataFrame, snippets: DataFrame, text_id: str, text: str, snippet_id: str, snippet: str, words: int = 5) -> DataFrame:
    """(text_id, snippet_id) for every snippet that occurs in a text, whatever their keys.

    Instead of comparing every text with every snippet, both meet on runs of words: a snippet is looked up by one run of
    `words` whole words inside it that no text boundary can cut, or by its longest whole word if it has fewer. Only hashes
    and ids meet there; the texts join the candidates afterwards, and each candidate is verified on the whole snippet.
    Snippets without a whole word inside are compared with every text, in blocks of about KEYLESS: each block is a pass over the
    texts."""
    c = F.col
    space = r"[\s\x1c-\x1f\x85\p{Z}]+"
    inner = lambda x: F.filter(F.split(x, space), lambda w: w != "")
    # Words at a snippet's ends may be parts of longer words in a text.
    whole = F.slice(inner(c(snippet)), F.lit(2), F.greatest(F.size(inner(c(snippet))) - 2, F.lit(0)))
    some = snippets.where(c(snippet) != "").select(c(snippet_id).alias("sid"), c(snippet).alias("s"), whole.alias("w"))
    counts = some.agg(F.count_if((F.size("w") > 0) & (F.size("w") < words)).alias("short"), F.count_if(F.size("w") == 0).alias("keyless")).first()
    held = texts.select(c(text_id).alias("tid"), c(text).alias("t"))

    def candidates(of_texts, of_snippets: DataFrame) -> DataFrame:
        keys = of_texts(inner(c("t")))
        # Few keys stand in the plan, so that a text's other runs never become rows; more of them only meet in the join.
        few = [r.k for r in of_snippets.select("k").distinct().limit(KEYS_IN_PLAN + 1).collect()]
        if len(few) <= KEYS_IN_PLAN:
            keys = F.filter(keys, lambda k: k.isin(few))
        keyed = held.select("tid", F.explode(F.array_distinct(keys)).alias("k"))
        return keyed.join(of_snippets, "k").select("tid", "sid")

    def runs(w):
        each = F.when(F.size(w) >= words, F.sequence(F.lit(0), F.size(w) - words)).otherwise(F.array().cast("array<int>"))
        # A word is hashed once, a run by the hashes of its words.
        return F.element_at(F.transform(F.array(F.transform(w, lambda x: F.xxhash64(x))), lambda h: F.transform(each, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))))), 1)

    met = candidates(runs, some.where(F.size("w") >= words).select("sid", F.array_min(runs(c("w"))).alias("k")))
    if counts["short"]:
        longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
        met = met.union(candidates(lambda w: F.transform(w, lambda x: F.xxhash64(x)), some.where((F.size("w") > 0) & (F.size("w") < words)).select("sid", F.xxhash64(longest).alias("k"))))
    met = met.distinct().select(c("tid").alias("_tid"), c("sid").alias("_sid"))
    known = some.select("sid", "s")
    found = held.join(met, c("tid").eqNullSafe(c("_tid"))).join(known, c("sid").eqNullSafe(c("_sid"))).where(F.contains("t", c("s"))).select("tid", "sid")
    blocks = -(-counts["keyless"] // KEYLESS)
    for block in range(blocks):
        queries = some.where((F.size("w") == 0) & (F.pmod(F.xxhash64("s"), F.lit(blocks)) == block)).select("s").distinct()
        hits = held.join(F.broadcast(queries), F.contains(c("t"), c("s"))).select("tid", c("s").alias("_s"))
        found = found.union(hits.join(known, c("_s") == c("s")).select("tid", "sid"))
    return found.distinct().select(c("tid").alias(text_id), c("sid").alias(snippet_id))


def verify_as_of(refs: DataFrame, sources: DataFrame, case: str = "case_id", order: str = "round") -> DataFrame:
    """`refs` (case, round, source, snippet, ...) with `verified`, against the newest content up to and including the citation's
    round: sources (case, round, source, content) may stand in many versions, of one round the last by content counts.

    The as-of join is over numbers: versions and citations of a source in order, each with the last version's round carried on
    (in blocks, so that no source's rows meet in one task). Texts meet afterwards, in an equi-join on (case, source, version)."""
    c = F.col
    # The ids must hold while both joins run.
    own = kept(refs.withColumn("_id", F.monotonically_increasing_id()))
    of = lambda k, x: x.select(c(case).alias("_case"), c("source").alias("_source"), c(order).alias("_round"), F.lit(k).alias("_kind"), *(["_id"] if k else [F.lit(-1).cast("long").alias("_id")]))
    versions = sources.where("content is not null").groupBy(case, "source", order).agg(F.max("content").alias("content"))
    marks = of(0, versions).withColumn("_version", c("_round")).unionByName(of(1, own).withColumn("_version", F.lit(None).cast(versions.schema[order].dataType)))
    known = carried(marks, ["_case", "_source"], ["_round", "_kind", "_id"], "_version").where("_kind = 1").select(c("_id").alias("_of"), "_version")
    texts = versions.select(c(case).alias("_case"), c("source").alias("_source"), c(order).alias("_at"), "content")
    same = (c(case) == c("_case")) & (c("source") == c("_source")) & (c("_version") == c("_at"))
    met = own.join(known, c("_id") == c("_of")).join(texts, same, "left")
    return met.withColumn("verified", cited(c("snippet"), c("content"))).select(*refs.columns, "verified")
