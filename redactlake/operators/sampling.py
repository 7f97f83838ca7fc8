"""Choosing observations: buckets, spaced top k, evenly spaced indices."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_best(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Up to `most` rows of a key: all, or from each of `most` windows of like length in time order the one of largest area, then confidence."""
    w = Window.partitionBy(*keys)
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_k", F.row_number().over(w.orderBy("time_ms", "det_ord")) - 1)
    edges = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.bround(i * (F.col("_n") / most)).cast("int"))
    bucketed = counted.withColumn("_b", F.when(F.col("_n") <= most, F.col("_k")).otherwise(F.size(F.filter(edges, lambda e: e <= F.col("_k")))))
    best = Window.partitionBy(*keys, "_b").orderBy(F.desc(F.col("width") * F.col("height")), F.desc("confidence"), "time_ms", "det_ord")
    return bucketed.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_n", "_k", "_b", "_r")


def _spaced(pdf: pd.DataFrame, priority: str, most: int, spacing: int, fill: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["time_ms", "det_ord"], kind="stable")
    if fill and len(pdf) <= most:
        return pdf
    ranked = pdf.sort_values(priority, ascending=False, kind="stable")
    times, chosen = ranked["time_ms"].tolist(), []
    for k, t in enumerate(times):
        if all(abs(t - times[c]) >= spacing for c in chosen):
            chosen.append(k)
            if len(chosen) == most:
                break
    if fill:
        chosen += [k for k in range(len(times)) if k not in set(chosen)][: most - len(chosen)]
    return ranked.iloc[sorted(chosen, key=lambda k: (times[k], k))]


def spaced_top(rows: DataFrame, keys: list[str], most: int = 8, spacing: int = 350) -> DataFrame:
    """Greedy by root of area times confidence, no two within `spacing` ms. A key is one track: its rows are one task's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_p=(pdf["width"] * pdf["height"]).clip(lower=1) ** 0.5 * pdf["confidence"].clip(lower=0.01))
        return _spaced(pdf, "_p", most, spacing, False).drop(columns="_p")

    return rows.groupBy(*keys).applyInPandas(run, rows.schema)


def best_evidence(rows: DataFrame, keys: list[str], most: int = 5, quality: str = "quality_score") -> DataFrame:
    """Greedy by quality with a spacing that follows the track's length; filled up regardless of spacing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        span = int(pdf["time_ms"].max() - pdf["time_ms"].min())
        return _spaced(pdf, quality, most, max(300, int(span / max(2, most * 2))), True)

    return rows.groupBy(*keys).applyInPandas(run, rows.schema)


def top(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def even_indices(n: Column, fps: Column) -> Column:
    """Two a second, between 2 and 16, evenly over n frames."""
    wanted = F.greatest(F.lit(2), F.least(F.lit(16), F.bround(n / fps * 2).cast("int")))
    return F.transform(F.sequence(F.lit(0), wanted - 1), lambda i: F.least(n - 1, F.bround(i * (n - 1) / F.greatest(F.lit(1), wanted - 1)).cast("int")))
