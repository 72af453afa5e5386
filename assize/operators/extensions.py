"""What statutes declare beyond the rounds: escalation, confidence thresholds and panels. All are off unless called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence from low to high.
RANKS = {"unknown": 0, "low": 1, "medium": 2, "high": 3}


def escalations(violations: DataFrame, statutes: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, statute, n, action, escalate_to) where a case has more violations of a statute than it allows."""
    counted = violations.groupBy(case, "statute").agg(F.count("*").alias("n"))
    law = statutes.select(F.col("name").alias("statute"), "escalation")
    return counted.join(law, "statute").where(F.col("n") > F.col("escalation.max_violations")).select(case, "statute", "n", F.col("escalation.action").alias("action"), F.col("escalation.escalate_to").alias("escalate_to"))


def confident(verdict: Column, least: Column) -> Column:
    """True if the verdict's confidence reaches a threshold's confidence_min; null thresholds ask nothing."""
    rank = lambda x: F.coalesce(F.try_element_at(F.create_map(*(F.lit(y) for p in RANKS.items() for y in p)), x), F.lit(0))
    return least.isNull() | (rank(verdict["confidence"]) >= rank(least))


def blocks(verdict: Column, statute_blocking: Column) -> Column:
    """A verdict blocks only where its statute may."""
    return verdict["blocking"] & statute_blocking


def uncited_claims(verdict: Column, most: int = 0) -> Column:
    """True if more findings than `most` come without any citation."""
    return F.when(F.size(verdict["evidence_refs"]) > 0, F.lit(False)).otherwise(F.size(verdict["findings"]) > most)


def panel(verdicts: DataFrame, case: str = "case_id", verdict: str = "verdict") -> DataFrame:
    """(case, n, refuted, settled): a panel's majority; one decisive member (refuted, high confidence, not blocking) settles."""
    v = F.col(verdict)
    sure = v["refuted"] & (v["confidence"] == "high") & ~v["blocking"]
    return verdicts.groupBy(case).agg(F.count("*").alias("n"), F.bool_or(sure).alias("settled"), F.sum(v["refuted"].cast("int")).alias("against")).select(
        case, "n", (F.col("settled") | (2 * F.col("against") >= F.col("n"))).alias("refuted"), "settled"
    )
