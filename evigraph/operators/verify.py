"""The promotion gate as Column expressions over (pattern_type, evidence, counter_evidence, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SCORE, UNRESOLVED_BELOW, LEAST_EVIDENCE, LEAST_TIERS, LEAST_URLS = 0.4, 0.6, 3, 2, 3


def _urls(items: Column, blanks: bool = False) -> Column:
    urls = F.transform(items, lambda e: F.coalesce(e["source_url"], F.lit("")))
    return F.array_distinct(urls if blanks else F.filter(urls, lambda u: F.trim(u) != ""))


def _tiers(items: Column) -> Column:
    return F.array_distinct(F.transform(items, lambda e: e["source_tier"]))


def sufficiency_failure(kind: Column, evidence: Column, counter: Column) -> Column:
    """The first failing rule, or null."""
    sources = F.array_distinct(F.filter(F.transform(evidence, lambda e: F.coalesce(e["source_document_id"], F.lit(""))), lambda s: F.trim(s) != ""))
    n = F.size(evidence)
    same = F.sort_array(_urls(evidence)) == F.sort_array(_urls(counter))
    contradiction = (
        F.when((n == 0) | (F.size(counter) == 0), "one side has no evidence")
        .when((F.size(_urls(evidence)) == 0) | (F.size(_urls(counter)) == 0), "one side has no source url")
        .when(same, "both sides have the same sources")
    )
    drift = F.when(n < 2, "fewer than 2 evidence items")
    gap = F.when(n < 2, "fewer than 2 evidence items").when(F.size(sources) < 2, "fewer than 2 source documents")
    bridge = F.when(n < LEAST_EVIDENCE, "fewer than 3 evidence items")
    return F.when(kind == "contradiction", contradiction).when(kind == "drift", drift).when(kind == "gap", gap).otherwise(bridge)


def is_diverse(kind: Column, evidence: Column, counter: Column) -> Column:
    pooled = F.when(kind == "contradiction", F.concat(evidence, counter)).otherwise(evidence)
    urls = F.when(kind == "bridge", LEAST_URLS).otherwise(2)
    return (F.size(_tiers(pooled)) >= LEAST_TIERS) | (F.size(_urls(pooled)) >= urls)


def confidence_level(kind: Column, evidence: Column, counter: Column, score: Column) -> Column:
    """Of a contradiction's urls, blank ones count on the evidence side only."""
    tiers = F.array_union(_tiers(evidence), _tiers(counter))
    urls = F.array_union(_urls(evidence, blanks=True), _urls(counter))
    pooled = F.size(evidence) + F.size(counter)
    two = (pooled >= 2) & (F.size(urls) >= 2)
    contradiction = F.when(two & (F.size(tiers) >= 2), F.when(F.array_contains(tiers, 1), "high").otherwise("medium")).when(two, "medium").otherwise("low")
    own, n, countered = _tiers(evidence), F.size(evidence), F.size(counter) > 0
    other = (
        F.when(countered & (score < UNRESOLVED_BELOW), "unresolved")
        .when((n >= 5) & (F.size(own) >= LEAST_TIERS) & F.array_contains(own, 1) & ~countered, "high")
        .when((n >= LEAST_EVIDENCE) & ((F.size(own) >= LEAST_TIERS) | (F.size(_urls(evidence, blanks=True)) >= LEAST_URLS)), "medium")
        .otherwise("low")
    )
    return F.when(kind == "contradiction", contradiction).otherwise(other)


def verify(candidates: DataFrame, interpret=None) -> DataFrame:
    """``candidates`` with status, withheld_reason, promotion_reason, confidence_level and, if given, ``interpret``'s column.
    Patterns without blind spots get a note of that."""
    kind, score = F.col("pattern_type"), F.col("confidence")
    evidence, counter = F.col("evidence"), F.col("counter_evidence")
    reasons = F.array_compact(
        F.array(
            sufficiency_failure(kind, evidence, counter),
            F.when(~is_diverse(kind, evidence, counter), "too few kinds of sources"),
            F.when(score < LEAST_SCORE, "score below 0.4"),
        )
    )
    judged = candidates.withColumn("__reasons", reasons)
    withheld = F.size("__reasons") > 0
    columns = {
        "status": F.when(withheld, "exploratory").otherwise("promoted"),
        "withheld_reason": F.when(withheld, F.array_join("__reasons", "; ")),
        "promotion_reason": F.when(withheld, "").otherwise("Passed all promotion checks"),
        "confidence_level": F.when(withheld, "low").otherwise(confidence_level(kind, evidence, counter, score)),
    }
    if "blind_spots" in candidates.columns:
        default = F.array(F.struct(F.lit("No blind spots identified; default note added."), F.lit("minor"), F.lit(None).cast("string"))).cast(candidates.schema["blind_spots"].dataType)
        columns["blind_spots"] = F.when(F.size(F.coalesce("blind_spots", F.array().cast(candidates.schema["blind_spots"].dataType))) > 0, F.col("blind_spots")).otherwise(default)
    out = judged.withColumns(columns).drop("__reasons")
    return out if interpret is None else out.withColumn("interpretation", interpret)


def split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Promoted and exploratory patterns."""
    return judged.where("status = 'promoted'"), judged.where("status = 'exploratory'")
