"""Queries over time: grids, merging, sessions, range and as-of joins, tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.functions import geometry as G
from redactlake.operators import intervals as I
from redactlake.operators import sampling, scenes, tracking
from redactlake.plans.common import DET, EV, FND, ISL, query
from redactlake.sources import adapters as A


@query(f"WITH {EV}, v AS (SELECT user_id AS video_id, max(t)::DOUBLE AS total FROM ev GROUP BY user_id) SELECT video_id, i::INTEGER AS chunk_index, i * 600.0::DOUBLE AS start_seconds, least(600.0::DOUBLE, total - i * 600.0::DOUBLE) AS duration_seconds FROM (SELECT *, unnest(range(0, ceil(total / 600)::BIGINT)) AS i FROM v WHERE total > 0)")
def tumbling_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = A.detections(spark, sf_dir).groupBy("video_id").agg(F.max("time_ms").cast("double").alias("total"))
    return I.chunks(videos, "total", 600.0).drop("total")


@query(f"WITH {DET} SELECT video_id, det_ord, least(40000, round_even(det_ord / 24.0::DOUBLE * 1000, 0))::BIGINT AS frame_ms FROM det WHERE det_ord % 5 = 0")
def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = max(1, round(24 * 200 / 1000))
    rows = A.detections(spark, sf_dir).where(F.col("det_ord") % step == 0)
    return rows.select("video_id", "det_ord", F.least(F.lit(40_000).cast("bigint"), F.bround(F.col("det_ord") / 24.0 * 1000).cast("bigint")).alias("frame_ms"))


@query(f"WITH {FND} SELECT video_id, ord, unnest(range(greatest(0, start_ms - 700), least(43000, greatest(greatest(0, start_ms - 700), end_ms + 700)) + 1, 350)) AS time_ms FROM fnd")
def frame_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.findings_in(spark, sf_dir)
    return I.grid(rows, F.col("start_ms") - 700, F.col("end_ms") + 700, 350, F.lit(43_000).cast("bigint")).select("video_id", "ord", "time_ms")


@query(f"""WITH {FND}, {ISL} SELECT video_id, arg_min(type, (start_ms, end_ms, ord)) AS type, arg_min(value, (start_ms, end_ms, ord)) AS value, CASE WHEN min(modality) = max(modality) THEN min(modality) ELSE 'both' END AS modality,
  min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(confidence) AS confidence, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(*) AS n,
  CASE WHEN min(modality) <> max(modality) OR min(modality) = 'both' THEN 'blur_and_mute' WHEN min(modality) = 'audio' THEN 'mute' ELSE 'blur' END AS action FROM isl GROUP BY video_id, type, value, island""")
def merge_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = I.merge_findings(A.findings_in(spark, sf_dir))
    return merged.withColumn("sources", F.concat_ws(",", "sources")).drop("reason", "id")


@query(f"""WITH {FND} SELECT video_id, type, CASE WHEN count(DISTINCT modality) = 1 THEN min(modality) ELSE 'both' END AS modality FROM fnd GROUP BY video_id, type""")
def modality_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.findings_in(spark, sf_dir).groupBy("video_id", "type").agg(I.fold_modality().alias("modality"))


@query(f"WITH {DET} SELECT video_id, time_ms, x, 0 AS y, width // 10 AS width, 10 AS height, max(confidence) AS confidence FROM det GROUP BY ALL")
def observation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.detections(spark, sf_dir).withColumns({"y": F.lit(0), "width": F.floor(F.col("width") / 10).cast("int"), "height": F.lit(10)})
    return I.dedup_observations(rows, ["video_id"]).select("video_id", "time_ms", "x", "y", "width", "height", "confidence")


@query(f"""WITH {FND}, {ISL}, g AS (SELECT video_id, type, value, min(start_ms) AS start_ms, list(reason ORDER BY start_ms, end_ms, ord) AS reasons FROM isl GROUP BY video_id, type, value, island)
SELECT video_id, 'finding_' || left(sha256(concat_ws('|', video_id, type, value, start_ms)), 8) AS id, type, value, start_ms, list_reduce(reasons, lambda a, r: CASE WHEN r = '' OR instr(a, r) > 0 THEN a WHEN a = '' THEN r ELSE a || '; ' || r END) AS reason FROM g""")
def reason_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_findings(A.findings_in(spark, sf_dir)).select("video_id", "id", "type", "value", "start_ms", "reason")


@query(f"""WITH {FND}, hit AS (SELECT video_id, type, value, start_ms AS time_ms, max(confidence) AS confidence FROM fnd GROUP BY ALL),
n AS (SELECT *, CASE WHEN time_ms - lag(time_ms) OVER w <= 1350 THEN 0 ELSE 1 END AS new FROM hit WINDOW w AS (PARTITION BY video_id, type, value ORDER BY time_ms)),
g AS (SELECT *, sum(new) OVER (PARTITION BY video_id, type, value ORDER BY time_ms) AS island FROM n)
SELECT video_id, type, value, greatest(0, min(time_ms) - 300) AS start_ms, max(time_ms) + 300 AS end_ms, count(*) AS n_hits, max(confidence) AS confidence FROM g GROUP BY video_id, type, value, island""")
def sessionize_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = A.findings_in(spark, sf_dir).groupBy("video_id", "type", "value", F.col("start_ms").alias("time_ms")).agg(F.max("confidence").alias("confidence"))
    return I.sessions(hits)


@query(f"""WITH {FND}, last AS (SELECT user_id AS video_id, max(t) AS m FROM ev GROUP BY user_id), frm AS (SELECT video_id, unnest(range(0, m + 1, 250)) AS time_ms FROM last)
SELECT f.video_id, f.time_ms, count(*) AS n_findings, max(g.confidence) AS confidence FROM frm f JOIN fnd g ON g.video_id = f.video_id AND f.time_ms BETWEEN g.start_ms AND g.end_ms AND g.modality <> 'audio' GROUP BY f.video_id, f.time_ms""")
def interval_join_redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = A.findings_in(spark, sf_dir).where("modality in ('visual', 'both')")
    pairs = I.interval_join(A.frames(spark, sf_dir, 250), seen, "video_id", "time_ms", "start_ms", "end_ms", 1_000)
    return pairs.groupBy("video_id", "time_ms").agg(F.count(F.lit(1)).alias("n_findings"), F.max("confidence").alias("confidence"))


@query(f"""WITH {FND}, a AS (SELECT video_id, ord, greatest(0, start_ms - 250) AS s, greatest(greatest(0, start_ms - 250), end_ms + 250) AS e FROM fnd WHERE modality IN ('audio', 'both')),
n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY video_id ORDER BY s, e, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM a),
g AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY s, e, ord ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT video_id, min(s) / 1000.0::DOUBLE AS start_seconds, max(e) / 1000.0::DOUBLE AS end_seconds FROM g GROUP BY video_id, island""")
def audio_mute_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = I.audio_padding(F.col("start_ms"), F.col("end_ms"))
    rows = A.findings_in(spark, sf_dir).where("modality in ('audio', 'both')").select("video_id", "ord", start.alias("s"), end.alias("e"))
    merged = I.islands(rows, ["video_id"], "s", "e", 0, ["ord"]).groupBy("video_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.select("video_id", (F.col("s") / 1000.0).alias("start_seconds"), (F.col("e") / 1000.0).alias("end_seconds"))


_OBS = f"WITH {DET}, obs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, time_ms ORDER BY det_ord) AS r FROM det) WHERE r = 1), last AS (SELECT video_id, max(time_ms) AS m FROM det GROUP BY video_id), grd AS (SELECT video_id, unnest(range(0, m + 1, 400)) AS time_ms FROM last)"
_AROUND = "par AS (SELECT g.video_id, g.time_ms, p.time_ms AS pt, p.x AS px, p.y AS py, p.width AS pw, p.height AS ph, p.confidence AS pc FROM grd g ASOF LEFT JOIN obs p ON p.video_id = g.video_id AND p.time_ms < g.time_ms), arn AS (SELECT par.*, n.time_ms AS nt, n.x AS nx, n.y AS ny, n.width AS nw, n.height AS nh, n.confidence AS nc FROM par ASOF LEFT JOIN obs n ON n.video_id = par.video_id AND n.time_ms >= par.time_ms)"


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.top(A.detections(spark, sf_dir), ["video_id", "time_ms"], [F.col("det_ord")], 1).drop("rank")


def _mid(c: str, least: str = "") -> str:
    v = f"round_even(p{c} + (n{c} - p{c}) * r, 0)::INTEGER"
    return f"CASE WHEN pt IS NULL THEN n{c} WHEN nt IS NULL THEN p{c} ELSE {f'greatest({least}, {v})' if least else v} END"


@query(f"{_OBS}, {_AROUND}, k AS (SELECT *, (time_ms - pt)::DOUBLE / greatest(1, nt - pt) AS r FROM arn) SELECT video_id, time_ms, {_mid('x')} AS x, {_mid('y')} AS y, {_mid('w', '1')} AS width, {_mid('h', '1')} AS height, CASE WHEN pt IS NULL THEN nc WHEN nt IS NULL THEN pc ELSE pc + (nc - pc) * r END AS confidence FROM k")
def interpolate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.interpolate(A.frames(spark, sf_dir, 400), _observed(spark, sf_dir))


@query(f"{_OBS}, {_AROUND} SELECT video_id, time_ms, CASE WHEN nt IS NULL OR time_ms - pt <= nt - time_ms THEN pt ELSE nt END AS nearest_ms, CASE WHEN nt IS NULL OR time_ms - pt <= nt - time_ms THEN px ELSE nx END AS x FROM arn")
def nearest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.nearest(A.frames(spark, sf_dir, 400), _observed(spark, sf_dir), "video_id", ["x"])
    return rows.select("video_id", "time_ms", F.col("nearest.time_ms").alias("nearest_ms"), F.col("nearest.x").alias("x"))


@query(f"{_OBS}, {_AROUND} SELECT video_id, time_ms, nx AS frame, nt AS frame_ms FROM arn WHERE nt IS NOT NULL")
def asof_frame_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.next_frame(A.frames(spark, sf_dir, 400), _observed(spark, sf_dir).select("video_id", "time_ms", F.col("x").alias("frame")), "video_id", "frame")


_PAIRS = f"WITH {DET}, two AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lag(width) OVER w AS w0, lag(height) OVER w AS h0 FROM det WINDOW w AS (PARTITION BY video_id ORDER BY time_ms, det_ord))"


def _consecutive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict, dict]:
    from pyspark.sql import Window

    w = Window.partitionBy("video_id").orderBy("time_ms", "det_ord")
    box = ("x", "y", "width", "height")
    rows = A.detections(spark, sf_dir).withColumns({f"{c}0": F.lag(c).over(w) for c in box}).where("x0 is not null")
    return rows, {c: F.col(c) for c in box}, {c: F.col(f"{c}0") for c in box}


@query(f"{_PAIRS}, k AS (SELECT *, greatest(0, least(x + width, x0 + w0) - greatest(x, x0)) * greatest(0, least(y + height, y0 + h0) - greatest(y, y0)) AS common FROM two WHERE x0 IS NOT NULL) SELECT video_id, det_ord, round(common::DOUBLE / (width * height + w0 * h0 - common), 9) AS iou FROM k")
def consecutive_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, a, b = _consecutive(spark, sf_dir)
    return rows.select("video_id", "det_ord", F.round(G.iou(a, b), 9).alias("iou"))


@query(f"{_PAIRS} SELECT video_id, det_ord, round(sqrt(power(x + width / 2 - x0 - w0 / 2, 2) + power(y + height / 2 - y0 - h0 / 2, 2)) / sqrt(1280.0::DOUBLE * 1280 + 720 * 720), 9) AS distance, round(greatest(width * height, w0 * h0)::DOUBLE / least(width * height, w0 * h0), 9) AS ratio FROM two WHERE x0 IS NOT NULL")
def center_distance_size_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, a, b = _consecutive(spark, sf_dir)
    return rows.select("video_id", "det_ord", F.round(G.centre_distance(a, b, F.lit(1280), F.lit(720)), 9).alias("distance"), F.round(G.size_ratio(a, b), 9).alias("ratio"))


def _simple_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.detections(spark, sf_dir).withColumn("track_number", (F.floor(F.col("time_ms") / 900) + 1).cast("int"))


_TRK = f"WITH {DET}, trk AS (SELECT *, (time_ms // 900 + 1)::INTEGER AS track_number FROM det)"


@query(f"{_TRK} SELECT video_id, track_number, count(*) AS n, max(confidence) AS peak FROM trk GROUP BY ALL HAVING count(*) >= 2 OR max(confidence) >= 0.93::DOUBLE")
def track_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.accepted(_simple_tracks(spark, sf_dir))


@query(f"{_TRK} SELECT video_id, track_number, printf('face_%03d', track_number) AS value, greatest(0, min(time_ms) - 200) AS start_ms, max(time_ms) + 200 AS end_ms, round(avg(confidence), 9) AS confidence, count(*) AS n_observations FROM trk GROUP BY video_id, track_number")
def track_to_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.track_findings(_simple_tracks(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9))


@query()
def face_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.track(A.detections(spark, sf_dir))


@query(f"""WITH {DET} SELECT det_ord, round(0.40::DOUBLE * least(1.0::DOUBLE, least(width, height) / 96.0::DOUBLE) + 0.38::DOUBLE * least(1.0::DOUBLE, (det_ord % 200) / 150.0::DOUBLE) + 0.22::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence)), 9) AS portrait,
  round(0.48::DOUBLE * least(1.0::DOUBLE, least(width, height) / 112.0::DOUBLE) + 0.24::DOUBLE * least(1.0::DOUBLE, (det_ord % 200) / 100.0::DOUBLE) + 0.28::DOUBLE * confidence, 9) AS evidence,
  CASE WHEN least(width, height) >= 96 AND det_ord % 200 >= 60 AND confidence >= 0.8::DOUBLE THEN 'good' WHEN least(width, height) >= 40 AND det_ord % 200 >= 20 AND confidence >= 0.7::DOUBLE THEN 'limited' ELSE 'poor' END AS hint FROM det""")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, sharp, sure = F.col("width"), F.col("height"), (F.col("det_ord") % 200).cast("double"), F.col("confidence")
    score, hint = G.evidence_quality(w, h, sharp, sure)
    return A.detections(spark, sf_dir).select("det_ord", F.round(G.portrait_quality(w, h, sharp, sure), 9).alias("portrait"), F.round(score, 9).alias("evidence"), hint.alias("hint"))


@query(f"""WITH {DET}, c AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, row_number() OVER (PARTITION BY video_id ORDER BY time_ms, det_ord) - 1 AS k FROM det),
b AS (SELECT *, CASE WHEN n <= 8 THEN k ELSE len(list_filter(list_transform(range(1, 9), lambda i: round_even(i * (n / 8.0::DOUBLE), 0)), lambda e: e <= k)) END AS bucket FROM c)
SELECT video_id, det_ord, time_ms FROM (SELECT *, row_number() OVER (PARTITION BY video_id, bucket ORDER BY width * height DESC, confidence DESC, time_ms, det_ord) AS r FROM b) WHERE r = 1""")
def bucketed_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bucketed_best(A.detections(spark, sf_dir), ["video_id"], 8).select("video_id", "det_ord", "time_ms")


@query(f"""WITH RECURSIVE {DET}, ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY sqrt(greatest(1, width * height)::DOUBLE) * greatest(0.01::DOUBLE, confidence) DESC, time_ms, det_ord) AS r FROM det),
walk AS (SELECT video_id, r, [time_ms] AS times, 1 AS k FROM ranked WHERE r = 1
  UNION ALL SELECT video_id, r, times, k FROM (SELECT w.video_id, c.r, list_append(w.times, c.time_ms) AS times, w.k + 1 AS k, row_number() OVER (PARTITION BY w.video_id ORDER BY c.r) AS nth
    FROM walk w JOIN ranked c ON c.video_id = w.video_id AND c.r > w.r WHERE w.k < 8 AND len(list_filter(w.times, lambda t: abs(t - c.time_ms) < 350)) = 0) WHERE nth = 1)
SELECT video_id, time_ms, det_ord, x, y, width, height, confidence FROM ranked JOIN walk USING (video_id, r)""")
def spacing_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.spaced_top(A.detections(spark, sf_dir), ["video_id"])


@query()
def best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.detections(spark, sf_dir).withColumn("quality_score", (F.col("det_ord") % 101) / 101.0)
    return sampling.best_evidence(rows, ["video_id"])


@query(f"WITH {DET} SELECT video_id, det_ord, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, det_ord)::INTEGER AS r FROM det) WHERE r <= 3")
def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.top(A.detections(spark, sf_dir), ["video_id"], [F.desc("confidence"), F.col("det_ord")], 3).select("video_id", "det_ord", "rank")


@query(f"WITH {FND} SELECT type, source, count(*) AS n FROM fnd GROUP BY type, source")
def finding_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.findings_in(spark, sf_dir).groupBy("type", "source").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FND} SELECT video_id, count(*) AS findings, count(*) FILTER (modality IN ('visual', 'both')) AS visual, count(*) FILTER (modality IN ('audio', 'both')) AS audio, count(DISTINCT type) AS types, max(end_ms) AS last_ms,
  round(sum(end_ms - start_ms)::DOUBLE / greatest(1, max(end_ms)), 9) AS coverage FROM fnd GROUP BY video_id""")
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.findings_in(spark, sf_dir).groupBy("video_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("modality").isin("visual", "both")).alias("visual"), F.count_if(F.col("modality").isin("audio", "both")).alias("audio"), F.countDistinct("type").alias("types"), F.max("end_ms").alias("last_ms"),
        F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / F.greatest(F.lit(1), F.max("end_ms")), 9).alias("coverage"),
    )


@query("""WITH RECURSIVE ev AS (SELECT user_id % 40 AS video_id, date_sub('minute', (SELECT min(ts) FROM events), ts) AS time_ms, event_id FROM events),
cand AS MATERIALIZED (SELECT DISTINCT video_id, time_ms FROM ev WHERE event_id * 37 % 100 >= 38),
cut AS (SELECT video_id, min(time_ms) AS time_ms FROM cand GROUP BY video_id
  UNION ALL SELECT k.video_id, min(k.time_ms) FROM cut c JOIN cand k ON k.video_id = c.video_id AND k.time_ms >= c.time_ms + 800 GROUP BY k.video_id)
SELECT video_id, time_ms FROM cut""")
def scene_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of recordings in which an event is a sampled frame and its number gives the change."""
    rows = A.detections(spark, sf_dir).select((F.col("video_id") % 40).alias("video_id"), "time_ms", (F.col("det_ord") * 37 % 100).cast("double").alias("change"))
    return scenes.scene_cuts(rows)
