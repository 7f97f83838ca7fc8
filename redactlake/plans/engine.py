"""The three ways in: sensitive content, persons, and faces by policy, each as joins over tables, for many recordings at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.config import Config
from redactlake.functions.jsonx import parse_findings
from redactlake.operators import clustering, policy, scenes, tracking
from redactlake.operators.intervals import action, merge_findings

_COLUMNS = ["video_id", "ord", "type", "value", "modality", "start_ms", "end_ms", "confidence", "reason", "source"]


def globalize(found: DataFrame, chunk_seconds: float) -> DataFrame:
    """Findings of chunks (with chunk_index) on the recording's clock: shifted, in whole ms, wider where there is sound."""
    ms = lambda c: (F.greatest(F.lit(0.0), F.col(c) + F.col("chunk_index") * F.lit(chunk_seconds)) * 1000).cast("bigint")
    sound = F.col("modality").isin("audio", "both")
    start = F.when(sound, F.greatest(F.lit(0).cast("bigint"), ms("start_seconds") - 200)).otherwise(ms("start_seconds"))
    end = F.greatest(start, F.when(sound, ms("end_seconds") + 250).otherwise(ms("end_seconds")))
    return found.withColumn("start_ms", start).withColumn("end_ms", end).withColumn("source", F.lit("model")).withColumn("action", action(F.col("modality")))


def widen(findings: DataFrame, observations: DataFrame, duration: str = "duration_ms") -> tuple[DataFrame, DataFrame]:
    """Visual findings reach 250 ms before their first box and 500 ms beyond their last; second: visual findings without a box."""
    ends = observations.groupBy("id").agg(F.min("time_ms").alias("_first"), F.max("time_ms").alias("_last"))
    rows = findings.join(ends, "id", "left")
    start = F.greatest(F.lit(0), F.least("start_ms", F.col("_first") - 250))
    end = F.least(duration, F.greatest("end_ms", F.col("_last") + 500))
    seen = F.col("modality").isin("visual", "both")
    wide = rows.withColumns({"start_ms": F.when(seen & F.col("_first").isNotNull(), start).otherwise(F.col("start_ms")), "end_ms": F.when(seen & F.col("_first").isNotNull(), end).otherwise(F.col("end_ms"))})
    return wide.drop("_first", "_last"), rows.where(seen & F.col("_first").isNull()).drop("_first", "_last")


@dataclass
class Gallery:
    """Tracks with their persons, and the persons."""

    members: DataFrame
    persons: DataFrame


class Engine:
    def __init__(self, config: Config | None = None):
        self.config = config or Config()

    def analyze(self, responses: DataFrame, text_findings: DataFrame | None = None, detections: DataFrame | None = None) -> DataFrame:
        """Merged findings from model answers (video_id, chunk_index, clip_duration_seconds, raw_text), findings of other scans, and, if faces are wanted, tracks."""
        found = globalize(parse_findings(responses), self.config.chunk_seconds).withColumn("ord", F.col("chunk_index") * 1000 + F.col("n")).select(*_COLUMNS)
        if text_findings is not None:
            found = found.unionByName(text_findings.select(*_COLUMNS))
        if detections is not None and self.config.face_mode != "off":
            found = found.unionByName(self.faces(detections).select(*_COLUMNS))
        return merge_findings(found, self.config.merge_gap_ms)

    def faces(self, detections: DataFrame, match: str | None = None) -> DataFrame:
        """A finding a track; in reference mode only detections whose similarity (column `match`) is high enough are tracked."""
        prefix = "face"
        if self.config.face_mode == "reference" and match:
            detections, prefix = detections.where(F.col(match) >= self.config.reference_similarity), "reference_face"
        tracks = tracking.track(detections, self.config.max_gap_ms)
        kept = tracking.only_accepted(tracks, self.config.min_observations, self.config.keep_single_confidence)
        out = tracking.track_findings(kept, self.config.face_interval_ms, prefix)
        return out.withColumns({"ord": F.col("track_number").cast("bigint"), "type": F.lit("face"), "modality": F.lit("visual"), "reason": F.lit("tracked face"), "source": F.lit("face_detector")})

    def gallery(self, profiles: DataFrame) -> Gallery:
        numbers = scenes.cut_lineage(clustering.cluster(profiles, self.config.identity_threshold))  # members and persons both read it: clustered once
        members = profiles.join(numbers, ["video_id", "track_id"]).withColumn("person_id", F.format_string("person_%02d", "cluster"))
        persons = clustering.relabel(clustering.profiles_of(members, "person_id"), "person_id", "first_seen_ms")
        return Gallery(members, persons)

    def apply_selection(self, findings: DataFrame, gallery: Gallery, blur: DataFrame) -> DataFrame:
        """findings (as before merging) and the tracks of the persons to blur (video_id, person_id), merged."""
        chosen = gallery.members.join(blur, ["video_id", "person_id"], "left_semi")
        faces = chosen.select("video_id", F.col("track_id").cast("bigint").alias("ord"), F.lit("user_selected_face").alias("type"), F.col("person_id").alias("value"), F.lit("visual").alias("modality"), "start_ms", "end_ms", F.col("quality_score").alias("confidence"), F.lit("selected").alias("reason"), F.lit("user_selection").alias("source"))
        return merge_findings(findings.select(*_COLUMNS).unionByName(faces.select(*_COLUMNS)), self.config.merge_gap_ms)

    def protect_minors(self, findings: DataFrame, tracks: DataFrame, assessments: DataFrame) -> DataFrame:
        """findings and the tracks (video_id, track_id, start_ms, end_ms) that the votes of their assessments say to blur, merged."""
        c = self.config
        decided = policy.consensus(policy.latest_of_each_index(assessments, ["track_id"]), c.usable_timestamps, c.child_confidence, c.blur_uncertain).where("blur")
        faces = tracks.join(decided.select("track_id", "category", F.col("confidence").alias("sure")), "track_id").select(
            "video_id", F.col("track_id").cast("bigint").alias("ord"), F.when(F.col("category") == "likely_minor", "visually_apparent_child_face").otherwise("child_classification_uncertain_face").alias("type"),
            F.format_string("track_%d", "track_id").alias("value"), F.lit("visual").alias("modality"), "start_ms", "end_ms", F.col("sure").alias("confidence"), F.col("category").alias("reason"), F.lit("child_policy").alias("source"),
        )
        return merge_findings(findings.select(*_COLUMNS).unionByName(faces.select(*_COLUMNS)), c.merge_gap_ms)
