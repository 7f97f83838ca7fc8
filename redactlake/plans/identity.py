"""Queries over vectors and persons: matching, clustering, profiles, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.functions import vectors as V
from redactlake.operators import clustering, policy
from redactlake.plans.common import PROF, query
from redactlake.sources import adapters as A


@query(f"""WITH {PROF}, pairs AS (SELECT p.video_id, p.track_id AS photo_id, q.track_id, round(list_cosine_similarity(p.embedding, q.embedding), 6) AS similarity FROM prof p JOIN prof q ON q.video_id = p.video_id AND p.track_id % 100 = 0 AND q.track_id % 100 <> 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY similarity DESC, track_id) AS r FROM pairs) WHERE r = 1)
SELECT p.video_id, p.track_id AS photo_id, b.track_id, b.similarity, coalesce(b.similarity >= 0.2, false) AS accepted, CASE WHEN b.similarity >= 0.2 THEN 'matched' ELSE 'below_similarity_threshold' END AS reason FROM prof p LEFT JOIN best b ON b.photo_id = p.track_id WHERE p.track_id % 100 = 0""")
def cosine_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.track_profiles(spark, sf_dir)
    photos = rows.where("track_id % 100 = 0").withColumnRenamed("track_id", "photo_id")
    return clustering.match_photos(photos, rows.where("track_id % 100 <> 0"), 0.2)


@query(f"WITH {PROF}, e AS (SELECT video_id, greatest(0.05::DOUBLE, quality_score) AS w, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM prof) SELECT video_id, pos::INTEGER AS pos, round(sum(w * v) / sum(w), 6) AS value FROM e GROUP BY video_id, pos")
def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.centroid(A.track_profiles(spark, sf_dir), ["video_id"], "embedding", F.greatest(F.lit(0.05), F.col("quality_score")))
    return out.withColumn("value", F.round("value", 6))


@query()
def cluster_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(A.track_profiles(spark, sf_dir), 0.20)


@query(f"""WITH {PROF} SELECT video_id, track_id % 7 AS cluster, arg_max(track_id, (quality_score, -track_id)) AS best_track, min(start_ms) AS first_seen_ms, max(end_ms) AS last_seen_ms, count(*) AS n_tracks, round(avg(quality_score), 9) AS mean_quality,
  string_agg(printf('%06d', track_id), ',' ORDER BY track_id) AS track_ids FROM prof GROUP BY video_id, track_id % 7""")
def profile_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.track_profiles(spark, sf_dir).withColumn("cluster", F.col("track_id") % 7)
    return clustering.profiles_of(rows, "cluster").withColumn("mean_quality", F.round("mean_quality", 9))


@query(f"""WITH {PROF}, p AS (SELECT video_id, 'person_' || (track_id % 30) AS person_id, min(start_ms) AS first_seen_ms FROM prof GROUP BY ALL)
SELECT video_id, person_id, first_seen_ms, row_number() OVER w ::INTEGER AS number, printf('Person %02d', row_number() OVER w) AS label FROM p WINDOW w AS (PARTITION BY video_id ORDER BY first_seen_ms, person_id)""")
def chrono_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    person = F.concat(F.lit("person_"), (F.col("track_id") % 30).cast("string"))
    rows = A.track_profiles(spark, sf_dir).groupBy("video_id", person.alias("person_id")).agg(F.min("start_ms").alias("first_seen_ms"))
    return clustering.relabel(rows, "person_id", "first_seen_ms")


@query("SELECT DISTINCT vec_id AS person_id FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 5 = 0")
def selection_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("person_id"))
    return policy.blur_set(persons, persons.where("person_id % 3 = 0"), persons.where("person_id % 5 = 0"), "keep_selected_visible", "blur")
