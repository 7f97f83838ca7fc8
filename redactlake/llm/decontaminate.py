"""Benchmark decontamination by spaced seeds, with DataFrame functions alone.

Texts are lower-cased words. A seed is a fixed mask over a window of words: the words under its ones are hashed, those under
its zeros are ignored, so a window still meets its original with words changed there. Hashes of the benchmark's windows are
joined with those of the documents; each hit lays a benchmark item along the document at one offset, and the overlap is then
compared word by word.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm.common import forget, row_keys, saved, table, text_or_empty

#: Offsets of the words that count; every mask has six.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 6, 7), (0, 1, 2, 5, 8, 9))
_LEAST = 3  # words of an item that is looked for inside longer texts
_DOC, _ITEM = ("__d1", "__d2"), ("__i1", "__i2")  # keys of rows; columns that a table of documents won't have
_NONWORD = r"[^\p{L}\p{N}]+"


def _named(cols: list[Column], names: tuple[str, ...]) -> list[Column]:
    return [c.alias(n) for c, n in zip(cols, names, strict=True)]


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words in turn."""
    words = F.filter(F.split(F.lower(text), _NONWORD), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def own_masks(n: int, share: float) -> list[tuple[int, tuple[int, ...], int]]:
    """(tag, offsets, span) of masks over all `n` words of an item, one of which holds whichever words are changed within `share`: of two blocks more than words may change, those that stay."""
    changed = n - math.ceil(n * share)
    blocks = min(n, changed + 2) if changed else 1
    cut = [n * k // blocks for k in range(blocks + 1)]
    stay = combinations(range(blocks), blocks - changed)
    return [(1_000 * n + k, tuple(o for x in xs for o in range(cut[x], cut[x + 1])), n) for k, xs in enumerate(stay)]


def _hash_at(h: Column, i: Column, tag: int, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(tag), *(F.get(h, i + o) for o in mask))


def _seeds_of(h: Column, tag: int, mask: tuple[int, ...], span: int) -> Column:
    """The seed hashes of every start."""
    starts = F.sequence(F.lit(0), F.size(h) - span)
    return F.when(F.size(h) >= span, F.transform(starts, lambda i: _hash_at(h, i, tag, mask))).otherwise(F.array().cast("array<bigint>"))


def _windows(rows: DataFrame, keep: list[str], h: str, masks: list[tuple[int, tuple[int, ...], int]], first: int, at: str) -> DataFrame:
    """keep, at, seed, before: for every mask (tag, offsets, span) the seed of every start in the words `h`, beside the seed one word earlier (`first` at the first). One mask of a row is worked on at a time."""
    made = rows.select(*keep, h, F.explode(F.array(*(F.lit(k) for k in range(len(masks) + 1)))).alias("__m"))
    hashes = F.when(F.col("__m") == len(masks), F.when(F.size(h) < _LEAST, F.array(_short_window(F.col(h)))))
    for k, (tag, mask, span) in enumerate(masks):
        hashes = hashes.when(F.col("__m") == k, _seeds_of(F.col(h), tag, mask, span))
    made = made.select(*keep, hashes.alias("__s"))
    made = made.select(*keep, F.posexplode(F.arrays_zip(F.col("__s").alias("seed"), F.concat(F.array(F.lit(first).cast("long")), F.col("__s")).alias("before"))).alias(at, "__w"))
    return made.select(*keep, at, "__w.seed", "__w.before").where(F.col("seed").isNotNull())


def _short_window(h: Column) -> Column:
    """The hash of all words, for texts of fewer than _LEAST words."""
    return F.xxhash64(F.lit(-1), h)


def _broadcast_up_to(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df


def _places(docs: DataFrame, items: DataFrame, window: int, share: float, most_broadcast: int) -> DataFrame:
    """_DOC, _ITEM, n_item, doc_start: where a seed lays an item along a document, each place once.

    A hit whose seeds one word earlier agree too lies on the same place as that one, so only the first hit of such a run is
    made: a phrase repeated m times in a text and n times in an item gives m + n rows, not m * n. Rows have a fixed width, no words.
    """
    lengths = [r["n_item"] for r in items.select("n_item").where(F.col("n_item").between(_LEAST, window)).distinct().collect()]  # at most `window` values
    general = [(m, mask, 1 + max(mask)) for m, mask in enumerate(MASKS)]
    own = {n: own_masks(n, share) for n in lengths}
    item = [*_ITEM, "n_item"]
    seeds = _windows(items, item, "ih", general, 0, "item_at")
    for n, masks in own.items():
        whole = F.array(*(_hash_at(F.col("ih"), F.lit(0), tag, mask) for tag, mask, _ in masks))
        seeds = seeds.unionByName(items.where(F.col("n_item") == n).select(*item, F.lit(0).alias("item_at"), F.explode(whole).alias("seed"), F.lit(0).cast("long").alias("before")))
    seeds = saved(seeds, "decontaminate-seeds", by_size=True)
    fits = seeds.count() <= most_broadcast
    words = docs.select(*_named(row_keys("doc_id", "text"), _DOC), word_hashes(text_or_empty("text")).alias("h")).where(F.size("h") > 0)
    windows = _windows(words, list(_DOC), "h", general + [m for masks in own.values() for m in masks], 1, "doc_at")
    heads = seeds.select("seed", F.col("before").alias("item_before")).distinct()
    met = windows.join(_broadcast_up_to(heads, fits), "seed").where(F.col("before") != F.col("item_before"))
    laid = met.join(_broadcast_up_to(seeds.withColumnRenamed("before", "item_before"), fits), ["seed", "item_before"])
    found = saved(laid.select(*_DOC, *item, (F.col("doc_at") - F.col("item_at")).alias("doc_start")).distinct(), "decontaminate-places", by_size=True)
    forget(seeds)
    return found


def _hits(docs: DataFrame, benchmark: DataFrame, window: int = 12, share: float = 0.8, most_broadcast: int = 1_000_000, most_bytes: int = 64 << 20) -> DataFrame:
    """The rows of `matches`, with the keys of their document (_DOC) and of their item (_ITEM): ids may be null or repeated."""
    items = benchmark.select(F.col("item_id"), *_named(row_keys("item_id", "text"), _ITEM), word_hashes(text_or_empty("text")).alias("ih")).where(F.size("ih") > 0).dropDuplicates(list(_ITEM)).withColumn("n_item", F.size("ih"))
    places = _places(docs, items, window, share, most_broadcast)
    # The words come back for the documents with a place only, each once.
    met = places.select(*_DOC).distinct()
    met = _broadcast_up_to(met, met.limit(most_broadcast + 1).count() <= most_broadcast)
    texts = docs.select("doc_id", "text", *_named(row_keys("doc_id", "text"), _DOC)).join(met, list(_DOC), "left_semi").dropDuplicates(list(_DOC))
    words = texts.select("doc_id", *_DOC, word_hashes(text_or_empty("text")).alias("h"))
    first = F.greatest(F.lit(0), -F.col("doc_start"))  # of the item's words, the first that lies in the text
    length = F.least(F.col("n_item"), F.size("h") - F.col("doc_start")) - first
    parts = places.join(words, list(_DOC)).select("doc_id", *_DOC, *_ITEM, "doc_start", first.alias("first"), F.slice("h", F.col("doc_start") + first + 1, length).alias("part"))
    held = items.agg(F.sum(64 + 8 * F.col("n_item").cast("long"))).first()[0] or 0
    laid = parts.join(_broadcast_up_to(items.select("item_id", *_ITEM, "ih"), held <= most_bytes), list(_ITEM))
    place = ["doc_id", *_DOC, "item_id", *_ITEM, "doc_start"]
    differ = F.filter(F.sequence(F.lit(0), F.size("part") - 1), lambda i: F.get("ih", F.col("first") + i) != F.get("part", i))
    laid = laid.select(*place, F.size("part").alias("n_overlap"), differ.alias("differ"))
    # `width` words with at most `most` changes are there if, and only if, some `most` + 1 changes in a row leave them between the two beside.
    width = F.least(F.lit(window), F.col("n_overlap"))
    most = width - F.ceil(width * share).cast("int")
    ends = F.concat(F.array(F.lit(-1)), F.col("differ"), F.array(F.col("n_overlap")))
    laid = laid.select(*place, "n_overlap", (F.col("n_overlap") - F.size("differ")).alias("n_equal"), width.alias("width"), most.alias("most"), ends.alias("ends"))
    gap = F.exists(F.sequence(F.lit(0), F.size("ends") - F.col("most") - 2), lambda j: F.get("ends", j + F.col("most") + 1) - F.get("ends", j) > F.col("width"))
    return laid.where(F.when(F.col("n_overlap") - F.col("n_equal") <= F.col("most"), True).otherwise(gap)).select(*place, "n_overlap", "n_equal")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 12, share: float = 0.8, most_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, doc_start (word at which the item's first word would stand; negative if that is before the text), n_overlap, n_equal.

    A row is a benchmark item laid along a document where some `window` consecutive words (all words of a shorter item or
    overlap of at least six) have at least `share` equal ones. Items of 3 to `window` words are found wherever they stand
    whole in a text, whichever words are changed within `share`; longer ones are found where the words agree under one of
    MASKS somewhere (every exact part of seven words or more, and of the 66 ways to change two of 12 words all but one).
    Items of one or two words are found where a document is just them. Null ids stay as they are; null and empty texts
    match nothing; documents and items with a repeated or null id but another text are rows of their own (the same row
    twice if the input has it twice is returned once). A phrase that a text and an item repeat gives a row for each place
    where it fits. Seeds (rows of fixed width) are broadcast only if there are `most_broadcast` at most, else both sides are
    shuffled by the seed hash; the items' words only if they have 64 MB at most. Other columns are not read.
    """
    return _hits(docs, benchmark, window, share, most_broadcast).select("doc_id", "item_id", "doc_start", "n_overlap", "n_equal")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 12, share: float = 0.8) -> DataFrame:
    """A row for each document and item that it holds some of: the place with the most equal words (ties: the first)."""
    found = _hits(docs, benchmark, window, share)
    best = found.groupBy("doc_id", *_DOC, "item_id", *_ITEM).agg(F.max_by(F.struct("doc_start", "n_overlap", "n_equal"), F.struct("n_equal", -F.col("doc_start"))).alias("m"))
    return best.select("doc_id", "item_id", "m.doc_start", "m.n_overlap", "m.n_equal")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, that hold no item; each is judged by its own text, whatever its id."""
    gone = saved(_hits(docs, benchmark).select(*_DOC).distinct(), "contaminated")
    return docs.withColumns(dict(zip(_DOC, row_keys("doc_id", "text"), strict=True))).join(gone, list(_DOC), "left_anti").select(*docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, doc_start, n_overlap, n_equal: every item of `benchmark` that a row of `documents` holds some of, at its best place. Null and empty texts hold none; equal rows count once; empty tables give no rows."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
