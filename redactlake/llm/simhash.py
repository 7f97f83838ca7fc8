"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into SEGMENTS segments on a ring. If two fingerprints differ in at most `most` bits, then from some
segment on, every chain of l consecutive segments differs in at most l * most / SEGMENTS bits in all: that segment is
equal, it and the next differ in one bit, and so on. Candidates come from an equi-join on two segments (one of them with
each of its bits flipped in turn on one side), longer chains prune them, and the full Hamming distance decides.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm.common import forget, in_batches, row_keys, saved, sized, sorted_join, table, text_or_empty
from redactlake.llm.graph import components

SEGMENTS = 5
_STARTS = [round(64 * k / SEGMENTS) for k in range(SEGMENTS + 1)]


def fingerprint(text: str, words: int = 4) -> int:
    """64 bits: bit k is 1 if it is set in over half the XXH64 values (seed 42) of the text's shingles; without words, 0."""
    import xxhash

    split = text.encode().lower().split()
    if not split:
        return 0
    joined, sizes = b" ".join(split), np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(split) - words + 1)
    begins, stops = (ends - sizes)[:n].tolist(), ends[min(words, len(split)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(begins[at : at + 65_536], stops[at : at + 65_536], strict=True)), np.uint64, len(begins[at : at + 65_536]))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `ids` and fp (the 64 bits as a signed long) of every row; a null text counts as empty."""

    work = lambda b: {"fp": np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], dtype=np.int64)}
    return in_batches(docs.select(*ids, text_or_empty("text").alias("text")), lambda: work, ids, "fp long")


def _segment(fp: Column, k: int | Column) -> Column:
    if not isinstance(k, int):
        return F.coalesce(*(F.when(k == s, _segment(fp, s)) for s in range(SEGMENTS)))
    a, b = _STARTS[k % SEGMENTS], _STARTS[k % SEGMENTS + 1]
    return F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1)


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _chains_hold(most: int) -> Column:
    """True if the chains from segment `start` on keep to their budgets, whatever their length."""

    def from_start(s: int) -> Column:
        held, total = F.lit(True), F.lit(0)
        for n in range(SEGMENTS):
            total = total + _apart(_segment(F.col("x"), s + n), _segment(F.col("y"), s + n))
            held = held & (total <= (n + 1) * most // SEGMENTS)
        return held

    return F.coalesce(*(F.when(F.col("start") == s, from_start(s)) for s in range(SEGMENTS)))


def _masks(width: int, bits: int) -> Column:
    """All values of `width` bits with at most `bits` ones."""
    return F.array(*(F.lit(sum(1 << b for b in on)).cast("long") for n in range(bits + 1) for on in combinations(range(width), n)))


def _third(rows: DataFrame, fp: str, key: str, bits: Column | None, most: int) -> DataFrame:
    """rows with `key`, one or more: of the segment after the two of the old key too. `bits`: how many of the second one were flipped."""
    start = F.col("key").bitwiseAND(7)
    third = _segment(F.col(fp), F.pmod(start + 2, F.lit(SEGMENTS)))
    if bits is None:
        return rows.withColumn("start", start).select("start", F.col(fp), F.xxhash64("key", third).alias(key))
    width = lambda s: _STARTS[(s + 2) % SEGMENTS + 1] - _STARTS[(s + 2) % SEGMENTS]
    flips = F.coalesce(*(F.when((start == s) & (bits == used), _masks(width(s), max(0, 3 * most // SEGMENTS - used))) for s in range(SEGMENTS) for used in (0, 1)))
    return rows.withColumn("start", start).select("start", F.col(fp), F.explode(F.transform(flips, lambda m: F.xxhash64("key", third.bitwiseXOR(m)))).alias(key))


def links(fps: DataFrame, most: int = 4, hot: int = 2_000) -> DataFrame:
    """a, b: pairs of different fingerprints (column fp, distinct) that connect the same fingerprints as all pairs of at most `most` (4) differing bits.

    A key that over `hot` fingerprints share isn't joined, as its pairs would grow with their square. It becomes longer
    first, by the third segment of the chain, of which up to two bits may differ. The fingerprints of such a key that still
    has as many are linked through all values that differ from them in at most two bits: two fingerprints share such a value
    if and only if they differ in at most four, and each is linked to the smallest that shares one, so those links grow in
    proportion. None is lost.
    """
    if not 0 <= most < SEGMENTS:
        raise ValueError("the join key holds for up to 4 differing bits")
    key = lambda s, first, second: F.shiftleft(F.shiftleft(_segment(first, s), 16).bitwiseOR(second), 3).bitwiseOR(F.lit(s))
    fp = F.col("fp")
    own = F.array(*(F.struct(key(s, fp, _segment(fp, s + 1)).alias("key")) for s in range(SEGMENTS)))
    width = lambda s: _STARTS[(s + 1) % SEGMENTS + 1] - _STARTS[(s + 1) % SEGMENTS]

    def flipped(s: int) -> Column:
        flips = F.array(*(F.lit(v).cast("long") for v in [0, *(1 << b for b in range(width(s)))]))
        return F.transform(flips, lambda flip: F.struct(F.lit(s).alias("start"), F.when(flip == 0, 0).otherwise(1).alias("bits"), key(s, fp, _segment(fp, s + 1).bitwiseXOR(flip)).alias("key")))

    near = F.flatten(F.array(*map(flipped, range(SEGMENTS))))
    index = fps.select(F.col("fp").alias("y"), F.inline(own)).select("y", "key")
    crowded = saved(index.groupBy("key").count().where(F.col("count") > hot).select("key"), "crowded-keys")
    probe = fps.select(F.col("fp").alias("x"), F.inline(near))
    x, y = F.col("x"), F.col("y")
    kept = lambda pairs: pairs.where((x < y) & _chains_hold(most)).where(_apart(x, y) <= most).select(x.alias("a"), y.alias("b"))
    if crowded.isEmpty():
        return kept(sorted_join(probe).join(index, "key")).distinct()
    pairs = kept(sorted_join(probe).join(index.join(crowded, "key", "left_anti"), "key"))
    longer = saved(_third(index.join(crowded, "key"), "y", "longer", None, most), "longer-keys")
    probe = sorted_join(_third(probe.join(crowded, "key"), "x", "longer", F.col("bits"), most))
    packed = saved(longer.groupBy("longer").count().where(F.col("count") > hot).select("longer"), "packed-keys")
    if packed.isEmpty():
        return pairs.unionAll(kept(probe.join(longer.drop("start"), "longer"))).distinct()
    if most in (1, 3):  # odd: one step more on one side would be needed
        raise ValueError("packed keys are handled for 0, 2 and 4 differing bits")
    pairs = pairs.unionAll(kept(probe.join(longer.drop("start").join(packed, "longer", "left_anti"), "longer")))
    inside = probe.join(packed, "longer", "left_semi").select("x").unionAll(longer.join(packed, "longer", "left_semi").select(y.alias("x"))).distinct()
    ones = [0, *(1 << b for b in range(64))]
    masks = {0: {0}, 2: set(ones), 4: {a | b for a in ones for b in ones}}[most]
    around = inside.select("x", F.explode(F.array(*(F.lit(m - (1 << 64) * (m >> 63)).cast("long") for m in sorted(masks)))).alias("mask")).select("x", x.bitwiseXOR(F.col("mask")).alias("middle"))
    around = saved(around, "middles")
    least = around.groupBy("middle").agg(F.min("x").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("middle", "a")
    stars = sorted_join(around).join(least, "middle").where("a <> x").select("a", x.alias("b"))
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4, hot: int = 2_000) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id that links lead to, its own included) of every row.

    Documents without words share fingerprint zero and link like others. Copies share a fingerprint and are compared once.
    Repeated doc_ids stay rows of their own. Rows with a null doc_id take part in links but are never the smallest of a
    component unless all of it is null. An empty table gives an empty result. Other columns are not read.
    """
    fps = sized(saved(fingerprints(docs, words), "fingerprints"))
    distinct = sized(saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints"))
    roots = components(links(distinct.select("fp"), most, hot))
    linked = roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("root_least"))
    by_fp = distinct.join(linked.join(smallest, "root").select("fp", "root_least"), "fp", "left").select("fp", F.least("root_least", "least").alias("component_id"))
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return near_duplicates(table(spark, sf_dir, "documents"))


_KEY = ("__k1", "__k2")  # columns that a table of documents won't have


def one_of_each(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """The rows, with all their columns, that come first in their component: the smallest doc_id, null ids last, then the least hash of id and text. Of rows alike in id and text one stays."""
    keyed = docs.withColumns(dict(zip(_KEY, row_keys("doc_id", "text"), strict=True)))
    fps = saved(fingerprints(keyed, words, ("doc_id", *_KEY)), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *_KEY)
    distinct = sized(saved(fps.groupBy("fp").agg(F.min(first).alias("first")), "distinct-fingerprints"))
    roots = components(links(distinct.select("fp"), most))
    of_each = distinct.join(roots, distinct["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first"))
    of_each = sized(saved(of_each.select(*(f"first.{k}" for k in _KEY)), "first-of-each"))
    kept = keyed.join(of_each, list(_KEY), "left_semi")
    if not fps.join(of_each, list(_KEY), "left_semi").groupBy(*_KEY).count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(list(_KEY))
    forget(fps, distinct, roots)
    return kept.select(*docs.columns)
