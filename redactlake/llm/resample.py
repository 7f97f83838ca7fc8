"""Importance resampling towards a target corpus: documents are drawn by the likelihood ratio of hashed n-grams, with Gumbel noise.

Inside a task the words of a slice of documents become ids, and a suffix array over the ids brings equal n-grams together: runs
of the longest-common-prefix array are the distinct n-grams, each hashed once, and its bucket is scattered to all its places.
Spark sums the buckets' counts, deals the documents into ranges of scores, and ranks inside the ranges.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactlake.llm.common import forget, saved, table

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def suffix_array(words: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """The places of all words, ordered by the `depth` words that start there; a text's end comes before any word. Doubling: ranks of w words give those of 2 w."""
    rank, width = words.astype(np.int64) + 1, 1
    stop = np.repeat(ends[1:], np.diff(ends))
    order = np.argsort(rank, kind="stable")
    while width < depth and len(words):
        after = np.arange(len(words)) + width
        second = np.where(after < stop, rank[np.minimum(after, len(words) - 1)], 0)
        order = np.lexsort((second, rank))
        new = np.ones(len(words), np.int64)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new)
        width *= 2
    return order


def repeated(words: np.ndarray, ends: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n from 1 to `longest`: n, the places of all n-grams inside texts, in the order of the suffix array, and where in it a run of equal ones starts. `ends`: 0 and each text's end."""
    order = suffix_array(words, ends, longest)
    left = (np.repeat(ends[1:], np.diff(ends)) - np.arange(len(words)))[order]
    lcp = np.zeros(len(words), np.int64)  # with the suffix before, up to `longest`
    alike = np.ones(max(len(words) - 1, 0), bool)
    for n in range(1, longest + 1):
        a, b = order[1:], order[:-1]
        last = len(words) - 1
        alike = alike & (left[1:] >= n) & (left[:-1] >= n) & (words[np.minimum(a + n - 1, last)] == words[np.minimum(b + n - 1, last)])
        lcp[1:] += alike
    for n in range(1, longest + 1):
        whole = left >= n
        # Suffixes too short for an n-gram stand before all that share their words, so leaving them out cuts no run.
        yield n, order[whole], np.flatnonzero((lcp < n)[whole])


def _buckets(texts: list[str | None], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word counts, and for each feature its text and bucket."""
    known: dict[bytes, int] = {}
    ids, ends = [], [0]
    for t in texts:
        ids.extend([known.setdefault(w, len(known)) for w in _WORD.findall((t or "").encode().translate(_LOWER))])
        ends.append(len(ids))
    words, ends, names = np.array(ids, np.int64), np.array(ends), list(known)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    owners, found = [], []
    for n, places, starts in repeated(words, ends, longest):
        hashed = np.array([zlib.crc32(b" ".join([names[w] for w in words[p : p + n]])) % buckets for p in places[starts].tolist()], np.int64)
        owners.append(owner[places])
        found.append(np.repeat(hashed, np.diff(np.append(starts, len(places)))))
    return np.diff(ends), np.concatenate(owners), np.concatenate(found)


def _slices(b: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of about `size` bytes of text; a longer text goes alone."""
    at, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()):
        if held and held + n > size:
            yield b.slice(at, i - at)
            at, held = i, 0
        held += n + 1
    if b.num_rows > at:
        yield b.slice(at)


def bucket_counts(rows: DataFrame, buckets: int, longest: int, size: int = 8 << 20) -> np.ndarray:
    """How many features of all texts fall into each bucket: `buckets` sums, whatever the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in _slices(b, size):
                total += np.bincount(_buckets(part.column("text").to_pylist(), buckets, longest)[2], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _noise(doc_id: int | None, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, least: int = 20, percent: int = 10, seed: str = "2024", range_rows: int = 500_000) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of `docs` (doc_id, text); `target` needs a text.

    Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII; features are the runs of 1 to `longest` of them. A row's
    weight is the sum of its features' log ratios; score adds Gumbel noise from the seed and doc_id. Of the rows with at least `least`
    words the best floor(percent / 100) get ranks, ties to smaller doc_id, a null one first (its noise is that of an empty id); rows
    equal in all may swap ranks. Null or empty texts have no features and weight 0; an empty target counts nothing; an empty table
    gives no rows; other columns are not read. The driver sees `buckets` counts twice and one count for each range of about `range_rows` rows.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, 8 << 20):
                n_words, owner, found = _buckets(part.column("text").to_pylist(), buckets, longest)
                weight = np.zeros(len(n_words), np.int64)
                np.add.at(weight, owner, gain[found])
                noise = np.array([_noise(i, seed) for i in part.column("doc_id").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (np.bincount(owner, minlength=len(n_words)), weight, weight + noise, n_words))], names=["doc_id", "n_features", "weight", "score", "words"])

    scored = saved(docs.select("doc_id", "text").mapInArrow(score, "doc_id long, n_features long, weight long, score long, words long"), "resample-scores")
    able = scored.where(F.col("words") >= least)
    n = able.count()
    ranges = 1 + n // range_rows
    by = [F.desc("score"), F.asc_nulls_first("doc_id")]
    dealt = saved(able.repartitionByRange(ranges, *by).withColumn("range", F.spark_partition_id()), "resample-ranges")
    before, offsets = 0, {}
    for r in sorted(dealt.groupBy("range").count().collect()):
        offsets[r["range"]] = before
        before += r["count"]
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)), F.col("range")) if offsets else F.lit(0)
    place = F.row_number().over(Window.partitionBy("range").orderBy(*by)) + offset
    ranked = dealt.withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= n * percent // 100, F.col("rank")))
    kept = ["doc_id", "n_features", "weight", "score"]
    out = saved(ranked.select(*kept, "rank").unionByName(scored.where(F.col("words") < least).select(*kept, F.lit(None).cast("long").alias("rank"))), "resample")
    forget(scored, dealt)
    return out


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` drawn towards all `benchmark` texts: see resample()."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
# CRC-32 by its definition: a table of 256 remainders of the polynomial 0xEDB88320, one step a byte.
OP13_SQL = f"""WITH RECURSIVE r AS (SELECT i::BIGINT AS byte, i::BIGINT AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM r WHERE k < 8),
tab AS (SELECT list(v ORDER BY byte) AS l FROM r WHERE k = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_WORDS_SQL} AS w FROM documents),
f AS MATERIALIZED (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(w) AS word FROM d) GROUP BY ALL),
g AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS_SQL}) AS word FROM benchmark) GROUP BY ALL),
b AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, l[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM f UNION SELECT word FROM g), tab),
s AS (SELECT bucket, sum(n)::BIGINT AS n FROM f JOIN b USING (word) GROUP BY bucket), t AS (SELECT bucket, sum(n)::BIGINT AS n FROM g JOIN b USING (word) GROUP BY bucket),
gain AS MATERIALIZED (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s)::BIGINT + 10000) / ((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t)::BIGINT + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT row, sum(n * gain)::BIGINT AS weight FROM f JOIN b USING (word) JOIN gain USING (bucket) GROUP BY row),
o AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (row)),
x AS MATERIALIZED (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM o),
k AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM x WHERE n_features >= 20) // 100 THEN place END AS rank FROM k"""
