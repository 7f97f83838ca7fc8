"""Time: grids, chunks, interval merging, sessions, range joins and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactlake.functions.geometry import padding
from redactlake.functions.text import normalize


def probe(videos: DataFrame) -> DataFrame:
    """Recordings (fps, frame_count, width, height) with duration_ms, in whole ms; those without a positive rate or size, or with a null there, go."""
    duration = F.floor(F.col("frame_count").cast("double") / F.col("fps").cast("double") * 1000).cast("bigint")
    return videos.where("fps > 0 and width > 0 and height > 0").withColumn("duration_ms", duration)


def grid(rows: DataFrame, start: Column, end: Column, step: int, duration: Column) -> DataFrame:
    """time_ms: from start (not below 0) to end (not beyond the duration), both ends included, every `step` ms."""
    first = F.greatest(F.lit(0).cast("bigint"), start)
    last = F.least(duration, F.greatest(first, end))
    return rows.withColumn("time_ms", F.explode(F.when(last >= first, F.sequence(first, last, F.lit(max(1, step)).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))))


def chunks(videos: DataFrame, total: str, size: float) -> DataFrame:
    """chunk_index, start_seconds, duration_seconds: one after the other, the last as short as it must be."""
    n = F.ceil(F.col(total) / size).cast("int")
    each = videos.where(F.col(total) > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), n - 1)))
    return each.withColumn("start_seconds", F.col("chunk_index") * F.lit(size)).withColumn("duration_seconds", F.least(F.lit(size), F.col(total) - F.col("start_seconds")))


def islands(rows: DataFrame, keys: list[str], start: str, end: str, gap: int, order: list[str]) -> DataFrame:
    """island: rows of a key belong together if one starts no later than `gap` after the latest end before it."""
    w = Window.partitionBy(*keys).orderBy(start, end, *order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def fold_modality(modality: str = "modality") -> Column:
    return F.when(F.min(modality) == F.max(modality), F.min(modality)).otherwise("both")


def action(modality: Column) -> Column:
    return F.when(modality == "both", "blur_and_mute").when(modality == "audio", "mute").otherwise("blur")


def fold_reasons(ordered: Column) -> Column:
    """Texts in order, each added unless what is there has it within."""
    step = lambda acc, r: F.when((r == "") | (F.instr(acc, r) > 0), acc).when(acc == "", r).otherwise(F.concat(acc, F.lit("; "), r))
    return F.aggregate(ordered, F.lit(""), step)


def merge_findings(findings: DataFrame, gap: int = 1_200) -> DataFrame:
    """Findings of one recording, type and normalised value, merged where their intervals touch within `gap`.

    One shuffle by the key; the first row of an island (by start, end, ord) gives type, value and order. Null modality or
    reason counts as empty.
    """
    keyed = findings.withColumn("_type", F.lower("type")).withColumn("_value", normalize(F.col("value"))).withColumn("modality", F.coalesce("modality", F.lit("")))
    keys = ["video_id", "_type", "_value"]
    first = F.struct("start_ms", "end_ms", "ord")
    rows = islands(keyed, keys, "start_ms", "end_ms", gap, ["ord"])
    reasons = F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "ord", F.coalesce("reason", F.lit("")).alias("reason")))), lambda r: r["reason"])
    out = rows.groupBy(*keys, "island").agg(
        F.min_by("type", first).alias("type"), F.min_by("value", first).alias("value"), fold_modality().alias("modality"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.max("confidence").alias("confidence"), fold_reasons(reasons).alias("reason"), F.array_sort(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("n"),
    )
    name = F.concat(F.lit("finding_"), F.substring(F.sha2(F.concat_ws("|", "video_id", "type", "value", "start_ms"), 256), 1, 8))
    return out.withColumn("action", action(F.col("modality"))).withColumn("id", name).drop("_type", "_value", "island")


def merged_ids(findings: DataFrame, gap: int = 1_200) -> DataFrame:
    """video_id, ord, id: the finding of merge_findings that each row has become part of."""
    keyed = findings.withColumn("_type", F.lower("type")).withColumn("_value", normalize(F.col("value")))
    keys = ["video_id", "_type", "_value"]
    rows = islands(keyed, keys, "start_ms", "end_ms", gap, ["ord"])
    first = F.first(F.struct("type", "value", "start_ms")).over(Window.partitionBy(*keys, "island").orderBy("start_ms", "end_ms", "ord"))
    name = F.concat(F.lit("finding_"), F.substring(F.sha2(F.concat_ws("|", "video_id", "_f.type", "_f.value", "_f.start_ms"), 256), 1, 8))
    return rows.withColumn("_f", first).select("video_id", "ord", name.alias("id"))


def merge_observations(findings: DataFrame, observations: DataFrame, gap: int = 1_200) -> DataFrame:
    """Boxes of rows before merging (video_id, ord, time_ms, x, y, width, height, confidence) as boxes of merged findings (video_id, id): each time and box once, with its highest confidence."""
    return dedup_observations(observations.join(merged_ids(findings, gap), ["video_id", "ord"]), ["video_id", "id"])


def redaction_plan(frames: DataFrame, merged: DataFrame, boxes: DataFrame, width: int, height: int, bucket: int = 1_000) -> DataFrame:
    """What is to be covered on which frame: video_id, time_ms, id, type, x1, y1, x2, y2.

    frames: video_id, time_ms; merged: findings with id; boxes: of merged findings, the surest (then first) of a time counts.
    Each finding that is seen has a box on every frame of its interval: that of its observations there, or between two of them
    linearly, padded by its kind and cut at the border. Findings without boxes cover nothing.
    """
    seen = merged.where(F.col("modality").isin("visual", "both")).select("video_id", "id", "type", "start_ms", "end_ms")
    points = interval_join(frames, seen, "video_id", "time_ms", "start_ms", "end_ms", bucket)
    one = F.max_by(F.struct("x", "y", "width", "height", "confidence"), F.struct("confidence", -F.col("x"), -F.col("y"), -F.col("width"), -F.col("height")))
    each = boxes.withColumn("_key", F.concat_ws("|", "video_id", "id")).groupBy("_key", "time_ms").agg(one.alias("b")).select("_key", "time_ms", "b.*")
    placed = interpolate(points.select(F.concat_ws("|", "video_id", "id").alias("_key"), "time_ms"), each, "_key")
    pad = padding(F.col("type"), F.col("width"), F.col("height"))
    rows = points.withColumn("_key", F.concat_ws("|", "video_id", "id")).join(placed, ["_key", "time_ms"]).withColumn("_pad", pad)
    return rows.select(
        "video_id", "time_ms", "id", "type", F.greatest(F.lit(0), F.col("x") - F.col("_pad")).alias("x1"), F.greatest(F.lit(0), F.col("y") - F.col("_pad")).alias("y1"),
        F.least(F.lit(width), F.col("x") + F.col("width") + F.col("_pad")).alias("x2"), F.least(F.lit(height), F.col("y") + F.col("height") + F.col("_pad")).alias("y2"),
    )


def dedup_observations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each time and box, with the highest confidence."""
    return rows.groupBy(*keys, "time_ms", "x", "y", "width", "height").agg(F.max("confidence").alias("confidence"))


def sessions(hits: DataFrame, interval: int = 350) -> DataFrame:
    """video_id, type, value: hits of a value (one a frame) as findings; a gap of up to three intervals after the widened end goes on."""
    window = max(300, interval // 2 + 100)
    rows = islands(hits.withColumn("_end", F.col("time_ms")), ["video_id", "type", "value"], "time_ms", "_end", 3 * interval + window, [])
    return rows.groupBy("video_id", "type", "value", "island").agg(F.greatest(F.lit(0), F.min("time_ms") - window).alias("start_ms"), (F.max("time_ms") + window).alias("end_ms"), F.count(F.lit(1)).alias("n_hits"), F.max("confidence").alias("confidence")).drop("island")


def interval_join(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, bucket: int) -> DataFrame:
    """Pairs with start <= time <= end, as an equi-join on key and time bucket: an interval is repeated for each bucket that it touches, a point lies in one, so no pair comes twice. Both sides are sorted: Spark takes what an explode makes, an interval's buckets or a recording's frames, for as many rows as before it, and would broadcast them."""
    into = lambda c: F.floor(F.col(c) / bucket)
    spread = intervals.where(F.col(end) >= F.col(start)).withColumn("_bucket", F.explode(F.sequence(into(start), into(end))))
    return points.withColumn("_bucket", into(time)).join(spread.hint("merge"), [key, "_bucket"]).where(F.col(time).between(F.col(start), F.col(end))).drop("_bucket")


def audio_padding(start: Column, end: Column, pad: int = 250) -> tuple[Column, Column]:
    first = F.greatest(F.lit(0).cast("bigint"), start - pad)
    return first, F.greatest(first, end + pad)


def _around(points: DataFrame, observations: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Each distinct point (key, time_ms) with prev (last observation before) and next (first at or after). Repeated points stand side by side in the window's order, so no table of all points is needed to find them."""
    box = F.struct("time_ms", *payload)
    both = points.select(key, "time_ms", F.lit(0).alias("_obs"), F.lit(None).cast(observations.select(box.alias("b")).schema["b"].dataType).alias("_box")).unionByName(observations.select(key, "time_ms", F.lit(1).alias("_obs"), box.alias("_box")))
    both = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)  # such rows take far less room in a shuffle than in a sort: Spark would put too many in a task
    w = Window.partitionBy(key).orderBy("time_ms", "_obs")
    prev = F.last("_box", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(key).orderBy(F.desc("time_ms"), F.desc("_obs"))  # a running frame, as one up to the end would be summed anew for each row
    nxt = F.last("_box", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    again = (F.lag("_obs").over(w) == 0) & F.lag("time_ms").over(w).eqNullSafe(F.col("time_ms"))  # points come before observations of their time
    rows = both.withColumn("prev", prev).withColumn("_again", F.coalesce(again, F.lit(False))).withColumn("next", nxt)
    return rows.where("_obs = 0 and not _again").drop("_obs", "_box", "_again")


def interpolate(points: DataFrame, observations: DataFrame, key: str = "video_id") -> DataFrame:
    """The box at each point of time: the first or last observation outside their range, else linear between the two around it. One observation a time is expected."""
    rows = _around(points, observations, key, ["x", "y", "width", "height", "confidence"])
    p, n = F.col("prev"), F.col("next")
    ratio = (F.col("time_ms") - p["time_ms"]) / F.greatest(F.lit(1), n["time_ms"] - p["time_ms"])
    mid = lambda c: p[c] + (n[c] - p[c]) * ratio
    pick = lambda c, v: F.when(p.isNull(), n[c]).when(n.isNull(), p[c]).otherwise(v)
    whole = lambda c, least: pick(c, F.greatest(F.lit(least), F.bround(mid(c)).cast("int")) if least is not None else F.bround(mid(c)).cast("int"))
    return rows.where(p.isNotNull() | n.isNotNull()).select(key, "time_ms", whole("x", None).alias("x"), whole("y", None).alias("y"), whole("width", 1).alias("width"), whole("height", 1).alias("height"), pick("confidence", mid("confidence")).alias("confidence"))


def nearest(points: DataFrame, observations: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """The observation nearest in time; of two as near, the earlier."""
    rows = _around(points, observations, key, payload)
    p, n, t = F.col("prev"), F.col("next"), F.col("time_ms")
    box = F.when(n.isNull() | (p.isNotNull() & (t - p["time_ms"] <= n["time_ms"] - t)), p).otherwise(n)
    return rows.withColumn("nearest", box).drop("prev", "next")


def next_frame(targets: DataFrame, frames: DataFrame, key: str, frame: str) -> DataFrame:
    """Each distinct target time with the first frame at or after it; targets beyond the last frame are left out."""
    rows = _around(targets, frames, key, [frame])
    return rows.where(F.col("next").isNotNull()).select(key, "time_ms", F.col("next")[frame].alias(frame), F.col("next")["time_ms"].alias("frame_ms"))
