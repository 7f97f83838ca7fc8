"""Sharding by sampled splitters, with DataFrame functions alone.

Size-weighted samples of a sort key give quantile boundaries; rows are dealt to the ranges between them, ranges that turn
out overfull are divided again, and running sums inside each range plus the ranges' offsets give every row its exact place
in the order of the whole table. A shard is an equal share of all bytes in that order, so its size differs from the mean by
no more than one record. Equal texts have neighbouring keys: a group of copies stays together unless it crosses a shard's
border, and one that holds a third of all rows is divided like any other stretch of keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactlake.llm.common import saved, table, text_or_empty

_SUB_BITS = 31
_LONG_MAX = (1 << 63) - 1


def _range_of(key: Column, splitters: list[int]) -> Column:
    """The number of splitters that are not above the key, by binary search in a literal array."""
    if not splitters:
        return F.lit(0)
    bits = len(splitters).bit_length()
    padded = F.array(*(F.lit(s).cast("long") for s in splitters + [_LONG_MAX] * ((1 << bits) - len(splitters))))
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(bits))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(key >= F.element_at(padded, at + step), at + step).otherwise(at))


def _drawn(rows: DataFrame, samples: int, total: int, seed: int) -> list[tuple[int, float]]:
    """(key, weight) of about `samples` rows, drawn in proportion to size. A row's hash decides, so a repeated task draws the same rows."""
    share = total / samples
    u = F.pmod(F.xxhash64(F.col("key"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    picked = rows.where(u * share < F.col("size")).select("key", F.greatest(F.col("size").cast("double"), F.lit(share)).alias("weight"))
    return sorted((r["key"], r["weight"]) for r in picked.collect())


def _quantiles(sample: list[tuple[int, float]], parts: int) -> list[int]:
    total, run, found = sum(w for _, w in sample), 0.0, []
    for key, weight in sample:
        run += weight
        if run * parts >= total * (len(found) + 1) and len(found) < parts - 1:
            while run * parts >= total * (len(found) + 1) and len(found) < parts - 1:
                found.append(key)
    return sorted(set(found))


def shard(
    docs: DataFrame, shards: int = 40, samples: int = 16_384, range_bytes: int = 64 << 20, least_ranges: int = 256, most_ranges: int = 4_096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row of `docs` with its shard and its slot in it.

    Returns doc_id, size (UTF-8 bytes of the text plus 16; null text: 16), text_crc32, shard, slot. Law: `bytes`.
    `samples` bounds what the driver sees of the keys (a Poisson draw of that mean), `most_ranges` the ranges; both are
    the only data that leave the executors. Null doc_ids and repeated rows are rows like any other; ties in the key are
    ordered by doc_id (nulls first), so only rows that are equal in every returned value may swap places. An empty table
    gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("key", F.shiftleft(F.col("text_crc32"), _SUB_BITS).bitwiseOR(F.xxhash64("doc_id", "text_crc32").bitwiseAND((1 << _SUB_BITS) - 1)))
    rows = saved(rows, "shard-keys")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    wanted = min(most_ranges // 2, max(least_ranges, math.ceil(total / range_bytes)))
    target = total / wanted
    splitters = _quantiles(_drawn(rows, samples, total, 1), wanted) if total else []
    sums: list = []
    for seed in (2, 3, 4):
        ranged = rows.withColumn("range", _range_of(F.col("key"), splitters))
        sums = sorted(ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect())
        overfull = [r["range"] for r in sums if r["bytes"] > 2 * target and r["n"] > 1]
        if not overfull or len(splitters) >= most_ranges:
            break
        inside = ranged.where(F.col("range").isin(overfull))
        held = sum(r["bytes"] for r in sums if r["range"] in set(overfull))
        more = _quantiles(_drawn(inside, samples, held, seed), min(most_ranges - len(splitters), math.ceil(held / target)))
        if not set(more) - set(splitters):
            break
        splitters = sorted(set(splitters) | set(more))
    n, size, before = 0, 0, []
    for r in sums:
        before.append((r["range"], n, size))
        n, size = n + r["n"], size + r["bytes"]
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    offsets = spark.createDataFrame(before, "range int, rows_before long, bytes_before long")  # a row for each range: at most most_ranges + 1
    order = Window.partitionBy("range").orderBy("key", F.asc_nulls_first("doc_id"), "size")
    placed = (
        rows.withColumn("range", _range_of(F.col("key"), splitters))
        .withColumn("nth", F.row_number().over(order))
        .withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(offsets), "range")
        .withColumn("at", F.col("rows_before") + F.col("nth") - 1)
        .withColumn("middle", F.col("bytes_before") + F.col("upto") - F.col("size") / 2)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / total)).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "at")
    )
    placed = saved(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
