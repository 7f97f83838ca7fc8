"""Removal of repeated byte strings, by threshold-bounded interval expansion on Burrows-Wheeler transforms.

Every window of `length` bytes that occurs twice is to go. Windows are dealt to anchors first: a window's anchor is the
sub-string of K bytes in it with the least hash, so that equal windows have equal anchors. The windows of one anchor lie in a
row; the bytes that they cover are the anchor's context. An anchor's contexts that are equal settle each other's windows; one
that stands alone beside others of the same anchor must be compared with them. Those contexts are brought together in blocks
of bounded size. A block's suffixes are sorted, and starting from the empty string the intervals of its transform are
extended backwards by one byte, level by level; a border between suffixes that is first met at level l is where their
common prefix has l bytes. After `length` levels the borders never met are those of common prefixes of at least `length`.

An anchor with so many different contexts that they would fill a block of their own is settled by counting the hashes of
its windows, with partial sums: no task ever holds such a group.

Only anchors that occur twice are looked at further. Texts are joined twice in all: to cut the contexts that must be
compared, and to cut out what was found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm.common import forget, in_batches, row_keys, saved, sized, table, text_or_empty

K = 64  # bytes of an anchor
_LISTS = 25_000  # rows with lists that may be broadcast: half a KB each, as seen
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 2 * len(_POWERS[0]))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def window_hashes(raw: bytes, size: int) -> np.ndarray:
    """A 64-bit hash of every sub-string of `size` bytes."""
    a, n = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1), len(raw)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(a * up[:n], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    for _ in range(2):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places of a text's anchors, and the first and last window start of each. Ties in the upper half of the hash go to the first place, which depends on the window's bytes alone."""
    h = window_hashes(raw, K)
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, span = length - K + 1, 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if width > span:
        v = np.minimum(v[: len(v) - (width - span)], v[width - span :])
    at = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return h[at[first]].view(np.int64), at[first], first, np.concatenate([first[1:] - 1, [len(at) - 1]])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling, from ranks of eight bytes on. The last byte must be the only least one."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    order, h = np.argsort(key, kind="stable"), 8
    new = np.concatenate([[0], (key[order][1:] != key[order][:-1]).astype(np.int64)])
    while True:
        rank = np.empty(n, np.int64)
        group = np.cumsum(new)
        rank[order] = group
        if group[-1] == n - 1:
            return order
        nxt = np.zeros(n, np.int64)
        nxt[: n - h] = rank[h:] + 1 if h < n else 0
        tied = np.flatnonzero(np.concatenate([new[1:] == 0, [False]]) | (new == 0))  # the others are in place
        part = order[tied]
        both = rank[part] * (n + 1) + nxt[part]
        again = np.argsort(both, kind="stable")
        order[tied] = part[again]
        both = both[again]
        new[tied] = np.concatenate([[1], (both[1:] != both[:-1]).astype(np.int64)]) if len(tied) else new[tied]
        new[0] = 0
        h *= 2


def shared_suffixes(text: np.ndarray, length: int) -> np.ndarray:
    """Mask of the places whose suffix has a common prefix of at least `length` with another one. The last byte must be the only least one."""
    n = len(text)
    order = suffix_array(text)
    bwt = text[order - 1]
    starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=256))[:-1]])
    by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by] = np.arange(n)  # equal bytes keep their order: starts[c] + rank of c
    run = np.cumsum(np.concatenate([[0], (bwt[1:] != bwt[:-1]).astype(np.int64)]))  # the intervals are extended by runs of the transform
    begin = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
    end, byte = np.concatenate([begin[1:], [n]]), bwt[begin].astype(np.int64)
    unmet = np.ones(n + 1, bool)
    unmet[[0, n]] = False
    lows, highs = np.array([0]), np.array([n])
    del starts, by
    for _ in range(length):
        if not len(lows):
            break
        one, last = run[lows], run[highs - 1]
        pieces = last - one + 1
        which = np.repeat(np.arange(len(lows)), pieces)
        r = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + one[which]
        a, b = np.maximum(begin[r], lows[which]), np.minimum(end[r], highs[which])
        a, b = lf[begin[r]] + (a - begin[r]), lf[begin[r]] + (b - begin[r])
        key = which * 256 + byte[r]
        o = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], key[o][1:] != key[o][:-1]]))
        low, high = np.minimum.reduceat(a[o], head), np.maximum.reduceat(b[o], head)
        fresh = unmet[high]
        lows, highs = low[fresh], high[fresh]
        unmet[highs] = False
    same = unmet[:n]
    mask = np.zeros(n, bool)
    mask[order[same]] = True
    mask[order[np.flatnonzero(same) - 1]] = True
    return mask


_PLACE = ("k1", "k2", "lo", "hi")


def _occurrences(rows: DataFrame, length: int) -> DataFrame:
    """Every anchor of every row: k1, k2, anchor, c1 and c2 (128 bits of its context and of where it stands there), lo, hi."""
    import xxhash

    names, digest = ["k1", "k2", "anchor", "c1", "c2", "lo", "hi"], xxhash.xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []

        def held() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=names)
            parts.clear()
            return made

        n = 0
        for b in batches:
            for k1, k2, raw in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                hashes, at, lo, hi = anchors(raw, length)
                context = np.frombuffer(b"".join([digest(raw[x : y + length], p - x) for p, x, y in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)]), "<i8").reshape(-1, 2)
                parts.append([np.full(len(at), k1), np.full(len(at), k2), hashes, context[:, 0], context[:, 1], lo.astype(np.int32), hi.astype(np.int32)])
                n += len(at)
                if n > 50_000:
                    yield held()
                    n = 0
        if parts:
            yield held()

    return rows.mapInArrow(run, "k1 long, k2 long, anchor long, c1 long, c2 long, lo int, hi int")


def repeated_windows(rows: DataFrame, length: int = 400, block_bytes: int = 1_000_000, crowded_bytes: int = 600_000) -> DataFrame:
    """rows: k1, k2 (128 bits that are the same for rows with the same bytes only), bytes. Returns k1, k2, spans (an array of
    lo, hi: runs of window starts whose windows occur elsewhere too), a saved table with the rows that have any."""
    rows = rows.where(F.length("bytes") >= length).select("k1", "k2", "bytes")
    every = saved(_occurrences(rows, length), "anchors")
    twice = saved(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors-seen-twice")  # saved, so that Spark can split the join where an anchor is hot
    occurrences = saved(every.join(sized(twice), "anchor"), "repeated-anchors")
    forget(every, twice)
    context = ["anchor", "c1", "c2"]
    contexts = saved(occurrences.groupBy(*context).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_PLACE)).alias("at")), "contexts")
    groups = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants"), F.min("n").alias("least"), F.sum(F.col("at.hi") - F.col("at.lo") + length).alias("bytes")).where("variants > 1 and least = 1")
    open_ = contexts.join(groups.select("anchor", (F.col("bytes") > crowded_bytes).alias("crowded")), "anchor").select("anchor", "crowded", (F.col("n") == 1).alias("alone"), "at.*")
    lists = saved(open_.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "crowded", "alone", "lo", "hi")).alias("wanted")), "open-contexts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k1, k2, raw, wanted in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "bytes", "wanted")), strict=True):
                out += [(k1, k2, w["anchor"], w["crowded"], w["alone"], w["lo"], raw[w["lo"] : w["hi"] + length]) for w in wanted]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["k1", "k2", "anchor", "crowded", "alone", "lo", "bytes"])

    pieces = rows.join(sized(lists, _LISTS), ["k1", "k2"]).mapInArrow(cut, "k1 long, k2 long, anchor long, crowded boolean, alone boolean, lo int, bytes binary")
    pieces = saved(pieces, "context-bytes")
    forget(lists)
    blocks = max(1, -(-pieces.where("not crowded").agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0] // block_bytes))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["k1", "k2", "lo"])  # repeated rows of the table
        raw = [np.frombuffer(b, np.uint8) for b in pdf["bytes"]]
        sizes = np.array([len(r) + 1 for r in raw])
        bytes_ = np.concatenate([x for r in raw for x in (r, np.array([255], np.uint8))])
        values, text = np.unique(np.concatenate([bytes_, [np.uint8(255)]]), return_inverse=True)  # no byte of UTF-8 is 255: it ends a context
        text = (text + 1).astype(np.uint8)
        text[-1] = 0
        mask = shared_suffixes(text, length)[:-1]
        base = np.cumsum(sizes) - sizes
        inside = np.zeros(len(mask) + 1, np.int8)  # window starts of contexts that stand alone
        alone = pdf["alone"].to_numpy(dtype=bool)
        np.add.at(inside, base[alone], 1)
        np.add.at(inside, (base + sizes - length)[alone], -1)
        mask &= np.cumsum(inside[:-1]) > 0
        edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        owner = np.searchsorted(base, first, side="right") - 1
        lo = pdf["lo"].to_numpy()[owner]
        return pd.DataFrame({"k1": pdf["k1"].to_numpy()[owner], "k2": pdf["k2"].to_numpy()[owner], "lo": (lo + first - base[owner]).astype(np.int32), "hi": (lo + last - base[owner]).astype(np.int32)})

    found = pieces.where("not crowded").withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks))).groupBy("block").applyInPandas(settle, "k1 long, k2 long, lo int, hi int")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            for k1, k2, alone, lo, raw in zip(pdf["k1"], pdf["k2"], pdf["alone"], pdf["lo"], pdf["bytes"], strict=True):
                n = len(raw) - length + 1
                yield pd.DataFrame({"k1": k1, "k2": k2, "alone": alone, "at": np.arange(lo, lo + n, dtype=np.int32), "window": [xxhash.xxh3_128_digest(raw[p : p + length]) for p in range(n)]})

    crowd = pieces.where("crowded")
    if not crowd.isEmpty():
        each = saved(crowd.dropDuplicates(["k1", "k2", "lo"]).mapInPandas(windows, "k1 long, k2 long, alone boolean, at int, window binary"), "windows")
        again = each.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
        found = found.unionAll(each.where("alone").join(again, "window").select("k1", "k2", F.col("at").alias("lo"), F.col("at").alias("hi")))
    settled = occurrences.join(contexts.where("n > 1").select(*context), context).select(*_PLACE)
    # Repeated rows share a key and have the same spans: a set holds each once, from the map side on.
    spans = saved(settled.unionAll(found).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "repeats")
    forget(occurrences, contexts, pieces)
    return spans


_OWN = ("__k1", "__k2", "__spans", "__passages")  # columns that a table of documents won't have
_SPANS = "array<struct<lo:int,hi:int>>"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with 128 bits of id and text: the same for repeated rows, which have the same windows removed."""
    return docs.withColumns(dict(zip(_OWN, row_keys("doc_id", "text"), strict=False)))


def _bytes_of(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col(_OWN[0]).alias("k1"), F.col(_OWN[1]).alias("k2"), text_or_empty("text").cast("binary").alias("bytes"))


def _with(keyed: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    return keyed.join(sized(spans, _LISTS).select(F.col("k1").alias(_OWN[0]), F.col("k2").alias(_OWN[1]), F.col("spans").alias(name)), list(_OWN[:2]), "left")


def runs_of(spans, length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    runs: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"] + length) for s in spans or ()):
        if runs and lo <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(hi, runs[-1][1]))
        else:
            runs.append((lo, hi))
    return runs


def _without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _inside(rows: DataFrame, spans: DataFrame, length: int, least: int) -> DataFrame:
    """Windows of `length` bytes that occur twice, looked for only where strings of `least` bytes do: all others can't. Like repeated_windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k1, k2, lo, raw[lo:hi]) for k1, k2, raw, own in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "bytes", "spans")), strict=True) for lo, hi in runs_of(own, least) if hi - lo >= length]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["d1", "d2", "base", "bytes"])

    cuts = rows.join(spans, ["k1", "k2"]).mapInArrow(cut, "d1 long, d2 long, base int, bytes binary")
    cuts = saved(cuts.withColumns(dict(zip(("k1", "k2"), row_keys("d1", "d2", "base"), strict=True))), "stretches")
    found = repeated_windows(cuts, length)
    back = found.join(cuts.select("k1", "k2", "d1", "d2", "base").distinct(), ["k1", "k2"]).select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), F.transform("spans", lambda s: F.struct((s["lo"] + F.col("base")).alias("lo"), (s["hi"] + F.col("base")).alias("hi"))).alias("spans"))
    back = saved(back.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans")), "repeats")
    forget(cuts, found)
    return back


def digests(docs: DataFrame, length: int = 400, passage: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, for strings of `length` bytes; and n_shared and n_passages:
    bytes and runs that strings of `passage` bytes (no more than `length`) cover which start elsewhere too.

    Null and empty texts have no bytes; repeated rows are occurrences of each other; texts shorter than `length` stay whole;
    ties don't arise; other columns are not read. Ids stay as they are, null ones too.
    """
    if passage > length:
        raise ValueError("passages can't be longer than what is removed")
    keyed = _keyed(docs.select("doc_id", "text"))
    shared = repeated_windows(_bytes_of(keyed), passage)
    removed = _inside(_bytes_of(keyed), shared, length, passage)

    def start():
        def work(b: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "n_passages")}
            for text, spans, passages in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "passages")), strict=True):
                raw, gone, common = text.encode(), runs_of(spans, length), runs_of(passages, passage)
                found = (len(raw), sum(y - x for x, y in gone), len(gone), hashlib.sha256(_without(raw, gone)).hexdigest(), sum(y - x for x, y in common), len(common))
                for k, v in zip(out, found, strict=True):
                    out[k].append(v)
            return out

        return work

    both = removed.select("k1", "k2", "spans").join(shared.select("k1", "k2", F.col("spans").alias("passages")), ["k1", "k2"], "right")
    both = both.select(F.col("k1").alias(_OWN[0]), F.col("k2").alias(_OWN[1]), "spans", "passages")
    rows = keyed.join(both, list(_OWN[:2]), "left").select("doc_id", text_or_empty("text").alias("text"), "spans", "passages")
    return in_batches(rows, start, ("doc_id",), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, n_passages long")


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """The rows with the repeated bytes cut out of their texts; bytes of a character that was cut in two go with it. All columns stay, ids as they are; a null text stays null."""
    text, own = docs.columns.index("text"), _OWN[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [t if t is None or s is None else _without(t.encode(), runs_of(s, length)).decode("utf-8", "ignore") for t, s in zip(b.column(text).to_pylist(), b.column(own).to_pylist(), strict=True)]
            yield b.set_column(text, "text", pa.array(cut, b.schema.field(text).type)).drop_columns([own])

    keyed = _keyed(docs)
    return _with(keyed, repeated_windows(_bytes_of(keyed), length), own).select(*docs.columns, own).mapInArrow(run, docs.schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes, as the contract has it, and in further columns passages of 200, about 35 words. Nulls and the like: as in `digests`."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return digests(table(spark, sf_dir, "documents"))
