"""Tracks of moving boxes: greedy assignment frame by frame, acceptance, and findings from tracks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_GAP, LEAST_IOU, MOST_DISTANCE, MOST_RATIO = 900, 0.08, 0.07, 3.0


class Tracker:
    """State of one recording: for each track its number, last box and last time."""

    def __init__(self, frame: tuple[int, int] = (1280, 720), max_gap: int = MAX_GAP):
        self.diagonal, self.max_gap = max(1.0, math.hypot(*frame)), max_gap
        self.tracks: list[list] = []  # number, time, (x, y, w, h)
        self.scene, self.count = 0, 0

    def new_scene(self, time: int) -> None:
        self.scene = max(self.scene, time)

    def _score(self, a: tuple, b: tuple) -> float | None:
        areas = [max(1, c[2] * c[3]) for c in (a, b)]
        if max(areas) / min(areas) > MOST_RATIO:
            return None
        wide, high = (max(0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
        union = a[2] * a[3] + b[2] * b[3] - wide * high
        share = wide * high / union if union > 0 else 0.0
        apart = math.hypot(a[0] + a[2] / 2 - b[0] - b[2] / 2, a[1] + a[3] / 2 - b[1] - b[3] / 2) / self.diagonal
        if share < LEAST_IOU and apart > MOST_DISTANCE:
            return None
        return 0.75 * share + 0.25 * max(0.0, 1 - apart / MOST_DISTANCE)

    def update(self, time: int, boxes: list[tuple]) -> list[int]:
        """The track number of each box of a frame."""
        live = [t for t in self.tracks if time - t[1] <= self.max_gap and t[1] >= self.scene]
        pairs = [(s, i, j) for i, t in enumerate(live) for j, b in enumerate(boxes) if (s := self._score(t[2], b)) is not None]
        numbers: list[int | None] = [None] * len(boxes)
        taken: set[int] = set()
        for _, i, j in sorted(pairs, reverse=True):
            if i not in taken and numbers[j] is None:
                taken.add(i)
                numbers[j] = live[i][0]
                live[i][1:] = [time, boxes[j]]
        for j, b in enumerate(boxes):
            if numbers[j] is None:
                self.count += 1
                numbers[j] = self.count
                self.tracks.append([self.count, time, b])
        self.tracks = [t for t in self.tracks if time - t[1] <= self.max_gap]  # others can't come back
        return numbers


def track(detections: DataFrame, max_gap: int = MAX_GAP, frame: tuple[int, int] = (1280, 720), cuts: str | None = None, part_rows: int = 20_000) -> DataFrame:
    """video_id, time_ms, det_ord, box, confidence -> the same with track_number. `cuts`: a boolean column, true where a frame begins a new scene.

    No track goes over a gap of more than `max_gap`, so a recording is cut at such gaps into parts of about `part_rows` rows
    (more only where there is no gap), each a task's; numbers go on from those that the parts before have given.
    """
    columns = ["video_id", "time_ms", "det_ord", "x", "y", "width", "height", "confidence"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["time_ms", "det_ord"], kind="stable")
        state, numbers = Tracker(frame, max_gap), []
        times = pdf["time_ms"].to_numpy()
        boxes = list(zip(*(pdf[c].tolist() for c in ("x", "y", "width", "height")), strict=True))
        scene = pdf[cuts].to_numpy(dtype=bool) if cuts else np.zeros(len(pdf), bool)
        edges = [0, *(np.flatnonzero(np.diff(times)) + 1).tolist(), len(times)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if scene[a:b].any():
                state.new_scene(int(times[a]))
            numbers += state.update(int(times[a]), boxes[a:b])
        numbers = np.array(numbers)
        return pdf[[*columns, "part"]].assign(track_number=numbers, fresh=np.diff(np.maximum.accumulate(np.concatenate([[0], numbers]))))

    w = Window.partitionBy("video_id").orderBy("time_ms", "det_ord")
    before = F.lag("time_ms").over(w)
    wanted = detections.select(*columns, *([F.coalesce(cuts, F.lit(False)).alias(cuts)] if cuts else []))
    wanted = wanted.withColumn("_from", F.when(before.isNull() | (F.col("time_ms") - before > max_gap), F.row_number().over(w)))
    wanted = wanted.withColumn("part", F.floor(F.max("_from").over(w.rowsBetween(Window.unboundedPreceding, 0)) / part_rows)).drop("_from")
    kinds = "video_id bigint, time_ms bigint, det_ord bigint, x int, y int, width int, height int, confidence double, part bigint, track_number bigint, fresh bigint"
    found = wanted.groupBy("video_id", "part").applyInPandas(run, kinds)
    earlier = F.coalesce(F.sum("fresh").over(Window.partitionBy("video_id").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("track_number", (F.col("track_number") + earlier).cast("int")).select(*columns, "track_number")


def accepted(tracks: DataFrame, least: int = 2, sure: float = 0.93) -> DataFrame:
    """video_id, track_number, n, peak of the tracks with enough observations or one that is sure."""
    return tracks.groupBy("video_id", "track_number").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("peak")).where((F.col("n") >= least) | (F.col("peak") >= sure))


def only_accepted(tracks: DataFrame, least: int = 2, sure: float = 0.93) -> DataFrame:
    """The rows of the tracks that `accepted` keeps, by a window: the tracks are made once."""
    w = Window.partitionBy("video_id", "track_number")
    rows = tracks.withColumns({"_n": F.count(F.lit(1)).over(w), "_peak": F.max("confidence").over(w)})
    return rows.where((F.col("_n") >= least) | (F.col("_peak") >= sure)).drop("_n", "_peak")


def match_counts(detections: DataFrame, match: str, similarity: float) -> DataFrame:
    """candidates, matches and rejections of each recording: detections by whether their similarity is high enough."""
    hit = F.coalesce(F.col(match) >= similarity, F.lit(False))
    return detections.groupBy("video_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(hit).alias("matches"), F.count_if(~hit).alias("rejections"))


def track_findings(tracks: DataFrame, interval: int = 200, prefix: str = "face") -> DataFrame:
    """One finding a track, wider by the sampling interval on both sides (not before 0)."""
    return tracks.groupBy("video_id", "track_number").agg(
        F.format_string(f"{prefix}_%03d", F.col("track_number").cast("int")).alias("value"), F.greatest(F.lit(0), F.min("time_ms") - interval).alias("start_ms"), (F.max("time_ms") + interval).alias("end_ms"),
        F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_observations"),
    )
