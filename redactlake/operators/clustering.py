"""Identities: constrained clustering of tracks, profiles, matching of photos."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactlake.functions.vectors import cosine


_CELLS = 4_000_000  # similarities that a task holds at once


def _directions(s: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(s, axis=-1, keepdims=True)
    return np.divide(s, size, out=np.zeros_like(s), where=size > 1e-8)


def _first_best(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first greatest column of each row, and its value."""
    at = rows.argmax(axis=1)
    return at, rows[np.arange(len(rows)), at]


class _Clusters:
    """Clusters of one recording, by the place of their first track, with the best later partner of each.

    Nothing here is as large as the pairs: similarities are made a row (first: a block of rows) at a time. `best[i]` is the
    greatest similarity of i to a later cluster and `with_[i]` the first that has it; of a `stale` one `best` is only a bound from above,
    and its row is made again once it is the greatest of all. Similarities are rounded, so that equal ones are equal.
    """

    def __init__(self, start: np.ndarray, end: np.ndarray, sums: np.ndarray, overlap: int):
        n = len(sums)
        self.sums, unit, has = sums, _directions(sums), np.linalg.norm(sums, axis=1) > 1e-8
        self.alive, self.nowhere, self.member = has.copy(), ~has, np.arange(n)  # nowhere: merged away, or without a direction
        # Two tracks are apart if both are longer than `overlap` and their times, each shortened by it at its end, meet.
        self.long = end - start > overlap
        self.start, self.end = start, end - overlap
        self.times = {k: np.array([k]) for k in np.flatnonzero(self.long)}  # a cluster's long tracks by start; they don't meet
        by = np.flatnonzero(self.long)
        self.by_start = by[np.argsort(start[by], kind="stable")]
        self.starts, self.longest = start[self.by_start], (self.end - start)[by].max(initial=0)
        self.best, self.with_, self.stale = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
        step = max(1, _CELLS // max(1, n))
        for a in range(0, n, step):
            b = min(n, a + step)
            near = np.round(unit[a:b] @ unit[a:].T, 12)
            meet = (self.start[a:b, None] < self.end[None, a:]) & (self.start[None, a:] < self.end[a:b, None])
            near[(meet & self.long[a:b, None] & self.long[None, a:]) | ~has[None, a:] | ~has[a:b, None]] = -np.inf
            near[np.tri(b - a, n - a, dtype=bool)] = -np.inf
            at, self.best[a:b] = _first_best(near)
            self.with_[a:b] = at + a
        self._compact(np.arange(n), unit)

    def _compact(self, ids: np.ndarray, unit: np.ndarray) -> None:
        """`unit` is held for the clusters that are left (`ids`; `place` is a cluster's row there)."""
        left = self.alive[ids]
        self.ids, self.unit, self.place = ids[left], unit[left], np.full(len(self.alive), -1)
        self.place[self.ids], self.left = np.arange(len(self.ids)), len(self.ids)

    def apart(self, i: int) -> np.ndarray:
        """The tracks that are seen at the same time as one of cluster i, as clusters."""
        own = self.times.get(i)
        if own is None:
            return np.zeros(0, np.int64)
        a = np.searchsorted(self.starts, self.start[own] - self.longest, "left")
        size = np.searchsorted(self.starts, self.end[own], "left") - a
        if size.sum() <= len(self.member):  # few tracks start near those of i
            of = np.repeat(np.arange(len(own)), size)
            near = self.by_start[np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + a[of]]
            return self.member[near[self.end[near] > self.start[own][of]]]
        last = np.searchsorted(self.start[own], self.end, "left") - 1  # of the tracks of i that start early enough the last ends last
        return self.member[(last >= 0) & self.long & (self.end[own][last] > self.start)]

    def row(self, i: int) -> np.ndarray:
        out, own = np.full(len(self.alive), -np.inf), self.unit[self.place[i]]
        if own.any():
            out[self.ids] = np.round(self.unit @ own, 12)
            out[self.nowhere] = -np.inf
            out[self.apart(i)] = -np.inf
        return out

    def take(self, i: int, row: np.ndarray) -> None:
        later = row[i + 1 :]
        at = int(later.argmax()) if len(later) else 0
        self.best[i], self.with_[i], self.stale[i] = (later[at], i + 1 + at, False) if len(later) else (-np.inf, i, False)

    def merge(self, i: int, j: int) -> None:
        self.member[self.member == j] = i
        self.sums[i] += self.sums[j]
        self.unit[self.place[i]], self.unit[self.place[j]] = _directions(self.sums[i]), 0
        self.alive[j], self.best[j], self.stale[j] = False, -np.inf, False
        self.nowhere[i], self.nowhere[j] = not self.unit[self.place[i]].any(), True
        both = [self.times.pop(k) for k in (i, j) if k in self.times]
        if both:
            tracks = np.concatenate(both)
            self.times[i] = tracks[np.argsort(self.start[tracks], kind="stable")]
        self.left -= 1
        if self.left < 0.8 * len(self.ids):
            self._compact(self.ids, self.unit)
        row = self.row(i)
        self.take(i, row)
        self.stale[:j] |= (self.with_[:j] == j) & self.alive[:j] & (np.arange(j) != i)
        old, new = slice(0, i), row[:i]
        self.stale[old] |= (self.with_[old] == i) & (new < self.best[old])
        wins = (new > self.best[old]) | ((new == self.best[old]) & ~self.stale[old] & (i < self.with_[old]))
        wins &= new > -np.inf
        self.best[old][wins], self.with_[old][wins], self.stale[old][wins] = new[wins], i, False

    def run(self, threshold: float) -> np.ndarray:
        while len(self.best):
            i = int(self.best.argmax())  # the first of the best
            if not self.best[i] > threshold:
                break
            if self.stale[i]:
                self.take(i, self.row(i))
            else:
                self.merge(i, int(self.with_[i]))
        return self.member


def cluster(profiles: DataFrame, threshold: float = 0.40, overlap: int = 350) -> DataFrame:
    """video_id, track_id, cluster (from 1, in the order of their best quality): agglomerative by cosine of the mean directions.

    The best pair above the threshold is merged again and again; tracks that are seen at the same time for over `overlap` ms
    never share a cluster; a track without a vector stays alone. A recording is one task's, whose memory follows its tracks, not
    their pairs; its work follows the pairs.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["quality_score", "track_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        dim = next((len(v) for v in pdf["embedding"] if v is not None), 1)
        sums = np.zeros((len(pdf), dim))
        for k, v in enumerate(pdf["embedding"]):
            if v is not None:
                v = np.asarray(v, dtype=np.float64)
                size = np.linalg.norm(v)
                sums[k] = v / size if size > 1e-8 else 0
        member = _Clusters(pdf["start_ms"].to_numpy(), pdf["end_ms"].to_numpy(), sums, overlap).run(threshold)
        number = {c: k for k, c in enumerate(sorted(set(member.tolist())), 1)}
        return pd.DataFrame({"video_id": pdf["video_id"], "track_id": pdf["track_id"], "cluster": [number[c] for c in member.tolist()]})

    kinds = dict(profiles.dtypes)
    return profiles.select("video_id", "track_id", "start_ms", "end_ms", "quality_score", "embedding").groupBy("video_id").applyInPandas(run, f"video_id {kinds['video_id']}, track_id {kinds['track_id']}, cluster int")


def profiles_of(rows: DataFrame, cluster_col: str) -> DataFrame:
    """One row a cluster: its best track, its time, its tracks."""
    return rows.groupBy("video_id", cluster_col).agg(
        F.max_by("track_id", F.struct("quality_score", -F.col("track_id"))).alias("best_track"), F.min("start_ms").alias("first_seen_ms"), F.max("end_ms").alias("last_seen_ms"),
        F.count(F.lit(1)).alias("n_tracks"), F.avg("quality_score").alias("mean_quality"), F.concat_ws(",", F.array_sort(F.collect_list(F.format_string("%06d", "track_id")))).alias("track_ids"),
    )


def relabel(rows: DataFrame, person: str, first_seen: str) -> DataFrame:
    """Labels by time of first sight, then by name, within a recording."""
    w = Window.partitionBy("video_id").orderBy(first_seen, F.col(person).cast("string"))
    return rows.withColumn("number", F.row_number().over(w)).withColumn("label", F.format_string("Person %02d", "number"))


def match_photos(photos: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """Each photo (photo_id, video_id, embedding) with the profile of its recording that is nearest; accepted from the threshold on; photos without a vector or a profile stay, unmatched."""
    pairs = photos.select("video_id", "photo_id", F.col("embedding").alias("_photo")).join(profiles.select("video_id", "track_id", "embedding"), "video_id").where("_photo is not null and embedding is not null")
    pairs = pairs.withColumn("similarity", F.round(cosine(F.col("_photo"), F.col("embedding")), 6))
    best = pairs.groupBy("video_id", "photo_id").agg(F.max_by("track_id", F.struct("similarity", -F.col("track_id"))).alias("track_id"), F.max("similarity").alias("similarity"))
    out = photos.select("video_id", "photo_id", F.col("embedding").isNull().alias("_none")).join(best, ["video_id", "photo_id"], "left")
    reason = F.when(F.col("_none"), "face_embedding_failed").when(F.col("similarity") >= threshold, "matched").otherwise("below_similarity_threshold")
    return out.select("video_id", "photo_id", "track_id", "similarity", (reason == "matched").alias("accepted"), reason.alias("reason"))


def gallery_metrics(members: DataFrame, person: str = "person_id") -> DataFrame:
    """Of each recording: tracks, persons, and tracks that were merged into a person that had one already."""
    tracks, persons = F.count(F.lit(1)), F.count_distinct(person)
    return members.groupBy("video_id").agg(tracks.alias("tracks"), persons.alias("persons"), (tracks - persons).alias("merged_duplicates"))
