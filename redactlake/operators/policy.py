"""Decisions: consensus of votes, age intervals, selection of persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Evidence codes.
ADULT, CHILD = ("mature_face", "adult_body_proportions"), ("childlike_face", "childlike_body_proportions")
HARD, SOFT = ("conflicting_evidence", "insufficient_detail"), ("small_face", "motion_blur", "profile_view", "occlusion")


def _any(codes: Column, of: tuple[str, ...]) -> Column:
    return F.arrays_overlap(codes, F.array(*map(F.lit, of)))


def vote(classification: Column, codes: Column) -> Column:
    """child, adult or uncertain: a class counts only with evidence for it, none against, and with body evidence where the view is poor."""

    def supports(name: str, own: tuple[str, ...], other: tuple[str, ...]) -> Column:
        seen = F.when(_any(codes, SOFT), F.array_contains(codes, own[1])).otherwise(_any(codes, own))
        return (classification == name) & ~_any(codes, other) & ~_any(codes, HARD) & seen

    return F.when(supports("child", CHILD, ADULT), "child").when(supports("adult", ADULT, CHILD), "adult").otherwise("uncertain")


def latest_of_each_index(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of assessments with one index the most sure, then the first."""
    w = Window.partitionBy(*keys, "index").orderBy(F.desc("confidence"), "ord")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def consensus(assessments: DataFrame, least: int = 3, sure: float = 0.70, blur_uncertain: bool = False) -> DataFrame:
    """One decision a track from its assessments (track_id, classification, quality, confidence, reason_codes)."""
    least = max(1, least)
    reliable = (F.col("quality") == "good") & (F.col("confidence") >= sure)
    rows = assessments.withColumn("_vote", F.when(reliable, vote(F.col("classification"), F.col("reason_codes"))))
    count = lambda v: F.count_if(F.col("_vote") == v)
    mean = lambda v: F.avg(F.when(F.col("_vote") == v, F.col("confidence")))
    sums = rows.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("sample_count"), F.count("_vote").alias("usable"), count("child").alias("child_votes"), count("adult").alias("adult_votes"), count("uncertain").alias("uncertain_votes"),
        mean("child").alias("_child"), mean("adult").alias("_adult"), F.avg(F.when(F.col("_vote").isNotNull(), F.col("confidence"))).alias("_all"), F.array_distinct(F.flatten(F.collect_list("reason_codes"))).alias("_codes"),
    )
    few = F.col("usable") < least
    minor, adult = ~few & (F.col("child_votes") >= least) & (F.col("adult_votes") == 0), ~few & (F.col("adult_votes") >= least) & (F.col("child_votes") == 0)
    category = F.when(minor, "likely_minor").when(adult, "likely_adult").otherwise("uncertain")
    reason = F.when(few, "insufficient_usable_timestamps").when(minor, "multi_timestamp_child_consensus").when(adult, "multi_timestamp_adult_consensus").when((F.col("child_votes") > 0) & (F.col("adult_votes") > 0), "conflicting_child_adult_votes").otherwise("insufficient_consensus")
    quality = F.when(few, F.when(F.col("usable") == 0, "poor").otherwise("limited")).when(minor | adult, "good").otherwise("limited")
    confidence = F.when(few, F.coalesce("_all", F.lit(0.0))).when(minor, F.col("_child")).when(adult, F.col("_adult")).otherwise(F.col("_all"))
    codes = F.array_sort(F.array_distinct(F.when(category == "uncertain", F.array_append("_codes", reason)).otherwise(F.col("_codes"))))
    return sums.select(
        "track_id", "sample_count", "usable", "child_votes", "adult_votes", "uncertain_votes", category.alias("category"), reason.alias("reason"), quality.alias("quality"), F.round(confidence, 6).alias("confidence"),
        ((category == "likely_minor") | ((category == "uncertain") & F.lit(blur_uncertain))).alias("blur"), F.concat_ws(",", codes).alias("reason_codes"),
    )


def metrics(decisions: DataFrame) -> DataFrame:
    """One row for all decisions: how many of each category, to blur, and with how many assessments, usable ones among them."""
    of = lambda c: F.count_if(F.col("category") == c)
    return decisions.agg(
        F.count(F.lit(1)).alias("tracks"), of("likely_minor").alias("likely_minor"), of("likely_adult").alias("likely_adult"), of("uncertain").alias("uncertain"), F.count_if("blur").alias("blurred"),
        F.coalesce(F.sum("sample_count"), F.lit(0)).alias("samples"), F.coalesce(F.sum("usable"), F.lit(0)).alias("usable"),
    )


def age_interval(low: Column, high: Column, confidence: Column, quality: Column, boundary: int = 18, adult: int = 22, sure: float = 0.65) -> tuple[Column, Column]:
    """Category and reason by an interval of ages."""
    a, b = F.greatest(F.lit(0), F.least(low, high)), F.least(F.lit(100), F.greatest(low, high))
    weak = (quality == "poor") | (confidence < sure)
    none = low.isNull() | high.isNull()
    category = F.when(none | weak, "uncertain").when(b < boundary, "likely_minor").when(a >= adult, "likely_adult").otherwise("uncertain")
    reason = F.when(none, "missing_age_interval").when(weak, "low_quality_or_confidence").when(b < boundary, "estimated_interval_below_minor_boundary").when(a >= adult, "high_confidence_interval_above_adult_safety_margin").otherwise("interval_overlaps_minor_or_safety_margin")
    return category, reason


def blur_set(persons: DataFrame, selected: DataFrame, matches: DataFrame, action: str = "blur_selected", photo_action: str = "blur") -> DataFrame:
    """The person_ids to blur, from all persons (person_id), selected ones, and those matched by photos."""
    if action not in ("blur_selected", "keep_selected_visible") or photo_action not in ("blur", "keep_visible"):
        raise ValueError(f"unknown action {action!r} or {photo_action!r}")
    ids = lambda df: df.select("person_id").distinct()
    chosen = ids(persons).join(ids(selected), "person_id", "left_semi" if action == "blur_selected" else "left_anti")
    return chosen.unionByName(ids(matches)).distinct() if photo_action == "blur" else chosen.join(ids(matches), "person_id", "left_anti")
