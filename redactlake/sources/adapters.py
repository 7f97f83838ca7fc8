"""The tables of a test directory as the engine's domain tables; integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("ts").alias("_first"))
    return events.crossJoin(F.broadcast(first)).withColumn("time_ms", F.expr("timestampdiff(MINUTE, _first, ts)"))  # one row


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e, t = F.col("user_id"), F.col("event_id"), F.col("time_ms")
    return _timed_events(spark, sf_dir).select(
        u.alias("video_id"), "time_ms", e.alias("det_ord"), ((u * 97) % 600 + F.floor(t / 50) % 400).cast("int").alias("x"), ((u * 53) % 400 + e % 40).cast("int").alias("y"),
        (e % 60 + 40).cast("int").alias("width"), (e % 70 + 50).cast("int").alias("height"), (F.lit(0.6) + (e % 40) / 100.0).alias("confidence"),
    )


def findings_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e, t = F.col("user_id"), F.col("event_id"), F.col("time_ms")
    return _timed_events(spark, sf_dir).select(
        u.alias("video_id"), e.alias("ord"), F.col("event_type").alias("type"), F.concat(F.lit("v"), (u % 20).cast("string")).alias("value"),
        F.when(e % 3 == 0, "visual").when(e % 3 == 1, "audio").otherwise("both").alias("modality"), t.alias("start_ms"), (t + (e * 7) % 3000).alias("end_ms"),
        (F.lit(0.5) + (e % 50) / 100.0).alias("confidence"), F.concat(F.lit("reason "), (e % 5).cast("string")).alias("reason"), F.when(e % 2 == 0, "model").otherwise("text_pattern").alias("source"),
    )


def frames(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    """A row a recording is little, its frames are much: a fixed number of parts, as Spark would put the recordings together in one task before they grow."""
    last = _timed_events(spark, sf_dir).groupBy(F.col("user_id").alias("video_id")).agg(F.max("time_ms").alias("last"))
    last = last.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "video_id", "last")
    return last.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"), F.lit(step).cast("bigint"))).alias("time_ms"))


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    codes = F.when(e % 7 == 0, F.array(F.lit("mature_face"))).when(e % 7 == 1, F.array(F.lit("small_face"), F.lit("childlike_body_proportions"))).when(e % 7 == 2, F.array(F.lit("insufficient_detail"))).when(e % 7 == 3, F.array(F.lit("childlike_face"))).when(e % 7 == 4, F.array(F.lit("adult_body_proportions"))).when(e % 7 == 5, F.array(F.lit("childlike_face"), F.lit("motion_blur"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") * 100 + e % 20).alias("track_id"), e.alias("ord"), (e % 6 + 1).cast("int").alias("index"), F.when((F.col("user_id") + e % 2) % 3 == 0, "child").when((F.col("user_id") + e % 2) % 3 == 1, "adult").otherwise("uncertain").alias("classification"),
        F.when(e % 4 < 3, "good").otherwise("limited").alias("quality"), ((e % 50 + 50) / 100.0).alias("confidence"), codes.alias("reason_codes"),
    )


def track_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), v.alias("track_id"), (v * 1000).alias("start_ms"), (v * 1000 + 1500).alias("end_ms"), ((v % 97) / 97.0).alias("quality_score"), F.col("embedding"))


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers: clean, fenced, with prose around them, wrapped, or cut off."""
    e = F.col("event_id")
    one = F.to_json(F.struct(F.col("event_type").alias("type"), F.concat(F.lit("value "), e.cast("string")).alias("value"), F.lit("visual").alias("modality"), (e % 4).cast("double").alias("start_seconds"), (e % 7).cast("double").alias("end_seconds"), ((e % 10) / 10.0).alias("confidence"), F.lit("seen").alias("reason")))
    kind = e % 5
    raw = F.when(kind == 0, F.concat(F.lit("["), one, F.lit("]"))).when(kind == 1, F.concat(F.lit("```json\n["), one, F.lit("]\n```"))).when(kind == 2, F.concat(F.lit("Here it is: ["), one, F.lit("] and that is all."))).when(kind == 3, F.concat(F.lit('{"findings":['), one, F.lit("]}"))).otherwise(F.concat(F.lit('{"findings":['), one, F.lit(',{"type":"cut')))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), e.alias("chunk_index"), F.lit(5.0).alias("clip_duration_seconds"), raw.alias("raw_text"))


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of conversations as tokens of one line."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("time_ms"), F.split("text", " ").alias("tokens"), "text")
