"""Registration of queries, and the domain tables as SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name; `sql` is the same query for another engine."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


EV = "ev AS (SELECT *, date_sub('minute', (SELECT min(ts) FROM events), ts) AS t FROM events)"
DET = f"""{EV}, det AS (SELECT user_id AS video_id, t AS time_ms, event_id AS det_ord, ((user_id * 97) % 600 + (t // 50) % 400)::INTEGER AS x, ((user_id * 53) % 400 + event_id % 40)::INTEGER AS y,
  (event_id % 60 + 40)::INTEGER AS width, (event_id % 70 + 50)::INTEGER AS height, 0.6::DOUBLE + (event_id % 40)::DOUBLE / 100.0::DOUBLE AS confidence FROM ev)"""
FND = f"""{EV}, fnd AS (SELECT user_id AS video_id, event_id AS ord, event_type AS type, 'v' || (user_id % 20) AS value, CASE event_id % 3 WHEN 0 THEN 'visual' WHEN 1 THEN 'audio' ELSE 'both' END AS modality,
  t AS start_ms, t + (event_id * 7) % 3000 AS end_ms, 0.5::DOUBLE + (event_id % 50)::DOUBLE / 100.0::DOUBLE AS confidence, 'reason ' || (event_id % 5) AS reason, CASE event_id % 2 WHEN 0 THEN 'model' ELSE 'text_pattern' END AS source FROM ev)"""
ISL = """isl AS (SELECT *, sum(new) OVER (PARTITION BY video_id, type, value ORDER BY start_ms, end_ms, ord ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY video_id, type, value ORDER BY start_ms, end_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1200 THEN 0 ELSE 1 END AS new FROM fnd))"""
PROF = "prof AS (SELECT label AS video_id, vec_id AS track_id, vec_id * 1000 AS start_ms, vec_id * 1000 + 1500 AS end_ms, (vec_id % 97)::DOUBLE / 97.0::DOUBLE AS quality_score, embedding::DOUBLE[] AS embedding FROM embeddings)"
ASM = """asm AS (SELECT user_id * 100 + event_id % 20 AS track_id, event_id AS ord, (event_id % 6 + 1)::INTEGER AS index, CASE (user_id + event_id % 2) % 3 WHEN 0 THEN 'child' WHEN 1 THEN 'adult' ELSE 'uncertain' END AS classification,
  CASE WHEN event_id % 4 < 3 THEN 'good' ELSE 'limited' END AS quality, (event_id % 50 + 50)::DOUBLE / 100.0::DOUBLE AS confidence,
  CASE event_id % 7 WHEN 0 THEN ['mature_face'] WHEN 1 THEN ['small_face', 'childlike_body_proportions'] WHEN 2 THEN ['insufficient_detail'] WHEN 3 THEN ['childlike_face'] WHEN 4 THEN ['adult_body_proportions'] WHEN 5 THEN ['childlike_face', 'motion_blur'] ELSE []::VARCHAR[] END AS codes FROM events)"""
