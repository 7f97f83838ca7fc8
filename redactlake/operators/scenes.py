"""Scene cuts: changes between sampled frames that are large enough and not too close to the cut before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut_lineage(rows: DataFrame) -> DataFrame:
    """The same rows with no lineage, in the folder of spark.checkpoint.dir."""
    _checkpoints(rows.sparkSession)
    return rows.checkpoint()


def _checkpoints(spark: SparkSession) -> None:
    """A local session, as in tests, may leave spark.checkpoint.dir unset; on a cluster the executors must share it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        context.setCheckpointDir(found)


def scene_cuts(frames: DataFrame, least: float = 38.0, refractory: int = 800) -> DataFrame:
    """video_id, time_ms of each cut, from frames (video_id, time_ms, change: how much a frame differs from the one before).

    A frame whose change is at least `least` is a cut, unless less than `refractory` ms have gone by since the last cut. That last
    cut depends on all before it, so each candidate points to the first one that is far enough from it, and the chain from
    the first candidate is followed by doubling: a round joins every pointer with its target's, and n cuts in a row take log2(n)
    rounds. A candidate that is `refractory` ms after the one before is a cut whatever came earlier and starts a chain of its own, so
    rounds follow the longest stretch without such a pause, not the recording. Frames with a null change, as a recording's first
    one has, or a null time are none; repeated times count once; null video_ids are one recording; an empty table has no cuts.
    """
    every = Window.partitionBy("video_id").orderBy("time_ms")
    found = frames.where((F.col("change") >= least) & F.col("time_ms").isNotNull()).select("video_id", F.col("time_ms").cast("long").alias("time_ms")).distinct()
    before = F.lag("time_ms").over(every)
    # Where no pause follows, the next one lies less than twice `refractory` away; what is farther starts a chain itself.
    after = F.min("time_ms").over(every.rangeBetween(refractory, 2 * refractory - 1))
    rows = cut_lineage(found.select("video_id", "time_ms", (before.isNull() | (F.col("time_ms") - before >= refractory)).alias("is_cut"), after.alias("jump")))
    known = -1
    while known != (now := rows.where("is_cut").count()):
        known = now
        on = lambda a, b, t: a["video_id"].eqNullSafe(b["v"]) & (a[t] == b["t"])
        reached = rows.where("is_cut and jump is not null").select(F.col("video_id").alias("v"), F.col("jump").alias("t")).distinct().withColumn("hit", F.lit(True))
        further = rows.where("jump is not null").select(F.col("video_id").alias("v"), F.col("time_ms").alias("t"), F.col("jump").alias("far"))
        one = rows.join(reached, on(rows, reached, "time_ms"), "left").select("video_id", "time_ms", (F.col("is_cut") | F.col("hit").isNotNull()).alias("is_cut"), "jump")
        rows = cut_lineage(one.join(further, on(one, further, "jump"), "left").select("video_id", "time_ms", "is_cut", F.col("far").alias("jump")))
    return rows.where("is_cut").select("video_id", "time_ms")


def with_cuts(detections: DataFrame, cuts: DataFrame, name: str = "is_cut") -> DataFrame:
    """Detections with a boolean column, true on the frames of cuts, for track(cuts=). A cut on a frame without detections goes to the next frame of its recording that has one."""
    marks = cuts.select("video_id", "time_ms", F.lit(True).alias("_mark"))
    events = detections.select("video_id", "time_ms").distinct().withColumn("_mark", F.lit(False)).unionByName(marks)
    per = events.groupBy("video_id", "time_ms").agg(F.max("_mark").alias("_mark"), F.min("_mark").alias("_only"))
    # A frame is cut if a cut came since the frame before that has detections.
    w = Window.partitionBy("video_id").orderBy("time_ms")
    last_cut = F.last(F.when(F.col("_mark"), F.col("time_ms")), ignorenulls=True).over(w)
    seen = F.last(F.when(~F.col("_only"), F.col("time_ms")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = per.select("video_id", "time_ms", "_only", (last_cut.isNotNull() & (seen.isNull() | (last_cut > seen))).alias(name)).where(~F.col("_only")).drop("_only")
    return detections.join(flagged, ["video_id", "time_ms"])
