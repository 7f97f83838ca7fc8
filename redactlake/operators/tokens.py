"""Tokens that a text recogniser has read from frames: lines, and where findings stand on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactlake.functions import spans as X
from redactlake.functions import text as T
from redactlake.operators.intervals import grid


def _read(text: Column, conf: Column, least: float) -> Column:
    return (F.trim(text) != "") & (conf >= least)


def _with_text(rows: DataFrame) -> DataFrame:
    joined = T.tokens_text(F.transform("tokens", lambda t: t["text"]), " ")
    return rows.withColumn("_t", joined).select("video_id", "time_ms", "block", "par", "line", "tokens", F.col("_t.text").alias("text"), F.col("_t.spans").alias("spans"))


def lines(tokens: DataFrame, least: float = 20.0) -> DataFrame:
    """tokens: video_id, time_ms, block, par, line, ord, x, y, width, height, conf, text. A row for each line with a readable
    token (of some text, `conf` at least `least`): its tokens from left to right, their text, and each one's span in it."""
    read = tokens.where(_read(F.col("text"), F.col("conf"), least))
    one = F.struct("x", "ord", "y", "width", "height", "conf", F.trim("text").alias("text"))
    return _with_text(read.groupBy("video_id", "time_ms", "block", "par", "line").agg(F.sort_array(F.collect_list(one)).alias("tokens")))


def lines_together(rows: DataFrame, least: float = 20.0) -> DataFrame:
    """The rows of `lines` where a row holds all tokens of a line: video_id, time_ms, block, par, line, tokens (array of ord, x, y,
    width, height, conf, text). Each row is read by itself, without a shuffle; one without a readable token gives none."""
    read = F.filter("tokens", lambda t: _read(t["text"], t["conf"], least))
    one = lambda t: F.struct(*(t[c].alias(c) for c in ("x", "ord", "y", "width", "height", "conf")), F.trim(t["text"]).alias("text"))
    return _with_text(rows.withColumn("tokens", F.sort_array(F.transform(read, one))).where(F.size("tokens") > 0))


def pattern_hits(read: DataFrame) -> DataFrame:
    """read: the rows of `lines`. video_id, time_ms, ord, type, value, key (the normalised value), x, y, width, height (on the
    unscaled frame), confidence (of the pattern), seen (of the recogniser): personal data and secrets with the box of the tokens they overlap.

    Each line is searched twice, its tokens joined by a blank and by nothing, as a recogniser may tear a value apart. Of matches of
    a frame with the same type, key and box the first stays: by line, blank first, then as `spans` orders them; `ord` counts in
    that order from 1. Only lines that may have a match go to Python. A match over no token has no box and is left out. Null texts and empty tables give no rows; other columns are not read.
    """
    place = ["block", "par", "line"]
    texts = F.transform("tokens", lambda t: t["text"])
    joined = F.array(F.struct("text", "spans"), T.tokens_text(texts, ""))
    some = F.exists(F.array("text", F.array_join(texts, "")), X.may_match)  # bound as values, so that each text is made once
    each = read.where(some).select("video_id", "time_ms", *place, "tokens", F.posexplode(joined).alias("sep", "j"))
    each = each.select("video_id", "time_ms", *place, "tokens", "sep", F.col("j.spans").alias("spans"), F.posexplode(X.spans(F.col("j.text"))).alias("nth", "m"))
    boxed = each.withColumn("box", X.boxes_of(F.col("spans"), F.col("m"), F.col("tokens"))).where(F.col("box").isNotNull())
    flat = boxed.select("video_id", "time_ms", *place, "sep", "nth", "m.type", "m.value", T.normalize(F.col("m.value")).alias("key"), "box.x", "box.y", "box.width", "box.height", "m.confidence", F.col("box.confidence").alias("seen"))
    order = F.struct(*place, "sep", "nth", "value", "seen")  # the last two for lines of the same place
    same = ["video_id", "time_ms", "type", "key", "x", "y", "width", "height"]
    first = flat.groupBy(*same).agg(F.min_by(F.struct("value", "confidence", "seen"), order).alias("f"), F.min(order).alias("o"))
    nth = F.row_number().over(Window.partitionBy("video_id", "time_ms").orderBy("o", *same[2:]))
    return first.select("video_id", "time_ms", nth.alias("ord"), "type", "f.value", "key", "x", "y", "width", "height", "f.confidence", "f.seen")


def localize(findings: DataFrame, frames: DataFrame, step: int = 350, around: int = 700) -> DataFrame:
    """Where findings (video_id, id, value, start_ms, end_ms, duration_ms) stand on frames (video_id, time_ms, tokens: an array
    of strings): id, time_ms, places (of the tokens that hold the value), for each frame of the grid around a finding's interval that has it."""
    times = grid(findings, F.col("start_ms") - around, F.col("end_ms") + around, step, F.col("duration_ms"))
    found = times.select("video_id", "id", "value", "time_ms").join(frames.select("video_id", "time_ms", "tokens"), ["video_id", "time_ms"])
    found = found.where(F.instr(T.normalize(F.array_join("tokens", "")), T.normalize(F.col("value"))) > 0)  # cheap, and few go on
    return found.withColumn("places", T.locate_tokens(F.col("tokens"), F.col("value"))).where(F.size("places") > 0).select("video_id", "id", "time_ms", "places")
