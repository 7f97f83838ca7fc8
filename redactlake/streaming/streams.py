"""The session and track operators over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from redactlake.operators.tracking import Tracker


def sessions(hits: DataFrame, gap: str = "1350 milliseconds", late: str = "10 seconds") -> DataFrame:
    """hits: ts (timestamp), video_id, type, value, confidence. A finding a session, once the watermark has passed its end; works on batches too."""
    rows = hits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "video_id", "type", "value").agg(F.count(F.lit(1)).alias("n_hits"), F.max("confidence").alias("confidence"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.drop("w")


_STATE = "payload string"


def tracks(detections: DataFrame, max_gap: int = 900) -> DataFrame:
    """video_id, time_ms, det_ord, box -> track numbers, with the tracker's state kept for each recording between micro-batches. Detections of a recording must arrive in order of time across micro-batches."""
    import json

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = Tracker(max_gap=max_gap)
        if state.exists:
            held = json.loads(state.get[0])
            tracker.tracks, tracker.count, tracker.scene = [[n, t, tuple(b)] for n, t, b in held["tracks"]], held["count"], held["scene"]
        pdf = pd.concat(list(batches)).sort_values(["time_ms", "det_ord"], kind="stable")
        numbers: list[int] = []
        for t, rows in pdf.groupby("time_ms", sort=True):
            numbers += tracker.update(int(t), list(zip(rows["x"].tolist(), rows["y"].tolist(), rows["width"].tolist(), rows["height"].tolist(), strict=True)))
        state.update((json.dumps({"tracks": tracker.tracks, "count": tracker.count, "scene": tracker.scene}),))
        yield pdf.assign(track_number=numbers)[["video_id", "time_ms", "det_ord", "track_number"]]

    columns = detections.select("video_id", "time_ms", "det_ord", "x", "y", "width", "height")
    return columns.groupBy("video_id").applyInPandasWithState(run, "video_id bigint, time_ms bigint, det_ord bigint, track_number int", _STATE, "append", GroupStateTimeout.NoTimeout)
