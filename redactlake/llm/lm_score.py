"""LM scoring with a hashed maximum-entropy model: n-gram and skip features, class-factored softmax.

A text is its lower-cased words and one end. The model knows `head` words; each belongs to a class, and all other words,
unknown ones too, make up one more class, the tail. A token's probability is that of its class, given hashed features of the
two words before it (the word before, the word before that as a skip feature, and both together), times its probability
within the class: a softmax over the class's words with the group of the word before as feature, or, in the tail, the
counts themselves. All of it sums to one over the words of the training texts and one outcome for unknown words.

Counts of the whole training part are gathered by Spark jobs with partial sums; the class weights are trained by full
gradient updates, each a Spark job over the table of contexts; each class's word weights are trained in a task of their own.
Texts are scored in numpy batches, in which just two table look-ups are made for a token. Words beyond the `known` most
frequent are looked up by a join, so that no vocabulary is ever held whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm.common import saved, table, text_or_empty

END = b""
_UNKNOWN, _START = -1, -2


@dataclass
class Shape:
    """Bounds of the model, whatever the input's size."""

    known: int = 200_000  # words whose counts go to every worker
    head: int = 32_768  # of these, words that the model has weights for
    own: int = 192  # most frequent words with a context bucket of their own
    buckets: int = 256  # context buckets of words; one more is the start of a text
    pairs: int = 8_192  # rows for hashed pairs of buckets
    groups: int = 16  # of words that follow like words
    parts: int = 4  # classes of a group, of like mass
    after: int = 32  # words whose successors tell the groups
    steps: int = 16  # gradient updates

    @property
    def classes(self) -> int:
        return self.groups * self.parts + 1  # the last is the tail


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return _UNKNOWN


@dataclass
class Words:
    """Word ids by falling count; counts; and, once known, group and class of each id (with two more places, for _START and _UNKNOWN, at the end)."""

    ids: Ids
    counts: np.ndarray
    shape: Shape
    group: np.ndarray = field(default=None)
    cls: np.ndarray = field(default=None)

    def __post_init__(self):
        rank = np.arange(len(self.counts) + 2)
        s = self.shape
        hashed = s.own + (rank * 2_654_435_761 >> 7) % (s.buckets - 1 - s.own)
        self.bucket = np.where(rank < s.own, rank, hashed)
        self.bucket[_UNKNOWN], self.bucket[_START] = s.buckets - 1, s.buckets


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(True))


def _batches(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        upto, held = at, 0
        while upto < len(texts) and (upto == at or held + len(texts[upto]) < most):
            held += len(texts[upto])
            upto += 1
        yield at, upto
        at = upto


def _tokens(words: Words, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Ids of all tokens, ids of the words one and two before them, where each text ends, and its words."""
    split = [t.encode().lower().split() for t in texts]
    sizes = np.array([len(s) + 1 for s in split])
    ends = np.cumsum(sizes)
    ids = np.empty(int(ends[-1]), np.int32)
    look, end = words.ids.__getitem__, words.ids[END]
    for s, b in zip(split, ends.tolist(), strict=True):
        ids[b - 1 - len(s) : b - 1] = np.fromiter(map(look, s), np.int32, len(s))
        ids[b - 1] = end
    begins = ends - sizes
    one = np.concatenate([[_START], ids[:-1]])
    one[begins] = _START
    two = np.concatenate([[_START], one[:-1]])
    two[begins] = _START
    return ids, one, two, ends, split


def word_counts(train: DataFrame, flush: int = 200_000) -> DataFrame:
    """word (string, empty for the end), n: over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        out = lambda: pd.DataFrame({"word": [w.decode() for w in held], "n": list(held.values())})
        for pdf in batches:
            for t in pdf["text"]:
                held.update(t.encode().lower().split())
                held[END] += 1
                if len(held) > flush:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return train.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pair_counts(train: DataFrame, words, make) -> DataFrame:
    """kind, key, n: sums over the corpus of what `make` says of a batch: for each kind, an array of keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = words.value
        for pdf in batches:
            texts = list(pdf["text"])
            for a, b in _batches(texts):
                for kind, keys in enumerate(make(own, *_tokens(own, texts[a:b])[:3])):
                    key, n = np.unique(keys, return_counts=True)
                    yield pd.DataFrame({"kind": kind, "key": key.astype(np.int64), "n": n})

    return train.select("text").mapInPandas(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def grouped(follows: np.ndarray, counts: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Group and class of each head word. Groups: k-means of the directions of what they follow; classes: a group's words by falling count, cut where a like share of its mass is reached."""
    x = np.sqrt(follows)
    x /= np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-9)
    rng, first = np.random.default_rng(3), []
    weight = np.sqrt(counts[:4096]) * (x[:4096].sum(axis=1) > 0)
    for _ in range(shape.groups):  # starts: frequent words that are unlike those before
        far = np.maximum(0, 1 - (x[:4096] @ x[first].T).max(axis=1)) if first else np.ones(len(weight))
        odds = weight * far**2
        first.append(int(rng.choice(len(odds), p=odds / odds.sum())) if odds.sum() > 0 else 0)
    centre = x[first]
    for _ in range(12):
        group = (x @ centre.T).argmax(axis=1)
        centre = np.stack([(x[group == g] * np.sqrt(counts[group == g])[:, None]).sum(axis=0) if (group == g).any() else centre[g] for g in range(shape.groups)])
        centre /= np.maximum(np.sqrt((centre**2).sum(axis=1, keepdims=True)), 1e-9)
    group, cls = (x @ centre.T).argmax(axis=1), np.zeros(len(x), np.int64)
    for g in range(shape.groups):
        own = np.flatnonzero(group == g)
        mass = np.cumsum(counts[own])
        if len(own):
            cls[own] = g * shape.parts + np.minimum(shape.parts - 1, (mass - counts[own]) * shape.parts // mass[-1])
    return group, cls


@dataclass
class ClassWeights:
    bias: np.ndarray
    one: np.ndarray
    two: np.ndarray
    pair: np.ndarray

    def table(self, ctx: np.ndarray, shape: Shape) -> np.ndarray:
        """Log probabilities (natural) of the classes in each context."""
        r = shape.buckets + 1
        y = self.bias + self.one[ctx // r] + self.two[ctx % r] + self.pair[pair_row(ctx, shape)]
        y = y - y.max(axis=1, keepdims=True)
        return y - np.log(np.exp(y).sum(axis=1, keepdims=True))


def pair_row(ctx: np.ndarray, shape: Shape) -> np.ndarray:
    return (ctx.astype(np.uint64) * np.uint64(11_400_714_819_323_198_485) >> np.uint64(40)).astype(np.int64) % shape.pairs


def train_classes(contexts: DataFrame, shape: Shape, prior: float = 2.0) -> ClassWeights:
    """contexts: ctx, counts (of each class). Every update goes over all contexts; a task sends the sums of its gradients and of their scales, by row of weights."""
    r, c = shape.buckets + 1, shape.classes
    w = ClassWeights(np.zeros(c), np.zeros((r, c)), np.zeros((r, c)), np.zeros((shape.pairs, c)))
    sizes = {"one": r, "two": r, "pair": shape.pairs, "bias": 1}

    def gradient(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, dict[int, np.ndarray]] = {k: {} for k in sizes}
        for pdf in batches:
            if not len(pdf):
                continue
            ctx, n = pdf["ctx"].to_numpy(), np.stack(pdf["counts"].to_numpy()).astype(np.float64)
            expected = np.exp(shared.value.table(ctx, shape)) * n.sum(axis=1, keepdims=True)
            both = np.stack([n - expected, expected], axis=1)
            for kind, row in (("one", ctx // r), ("two", ctx % r), ("pair", pair_row(ctx, shape)), ("bias", np.zeros(len(ctx), np.int64))):
                rows, at = np.unique(row, return_inverse=True)
                total = np.zeros((len(rows), 2, c))
                np.add.at(total, at, both)
                for k, v in zip(rows.tolist(), total, strict=True):
                    sums[kind][k] = sums[kind].get(k, 0) + v
        for kind, rows in sums.items():
            if rows:
                yield pd.DataFrame({"kind": kind, "row": list(rows), "sums": [v.astype(np.float32).tobytes() for v in rows.values()]})

    sc = contexts.sparkSession.sparkContext
    for _ in range(shape.steps):
        shared = sc.broadcast(w)  # of a size that the shape gives
        totals = {k: np.zeros((n, 2, c)) for k, n in sizes.items()}
        for batch in contexts.mapInPandas(gradient, "kind string, row int, sums binary").toArrow().to_batches():
            for kind, row, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                totals[kind][row] += np.frombuffer(raw, np.float32).reshape(2, c)
        shared.unpersist()
        for kind, total in totals.items():
            old = getattr(w, kind)
            seen = total[:, 0] + total[:, 1]  # every token moves four weights: no step may be so long that they overshoot together
            step = (total[:, 0] - prior * old) / (np.maximum(seen, total[:, 1]) + prior)
            setattr(w, kind, old + 0.35 * step.reshape(old.shape))
    return w


def _within(counts: np.ndarray, steps: int = 25, prior: float = 1.0) -> np.ndarray:
    """Log probabilities [contexts, words] of a class's words from their counts: bias and context weights by gradient updates."""
    total = counts.sum(axis=1, keepdims=True)
    bias, own = np.log(counts.sum(axis=0) + 0.1), np.zeros(counts.shape)
    for _ in range(steps):
        y = bias + own
        y = y - y.max(axis=1, keepdims=True)
        p = np.exp(y)
        p /= p.sum(axis=1, keepdims=True)
        own = own + 0.8 * (counts - total * p - prior * own) / (np.maximum(counts, total * p) + prior)
    y = bias + own
    y = y - y.max(axis=1, keepdims=True)
    return y - np.log(np.exp(y).sum(axis=1, keepdims=True))


def train_words(pairs: DataFrame, words: Words) -> np.ndarray:
    """pairs: key (group before * head + word), n. Log probability of each head word within its class after each group."""
    shape, head, contexts = words.shape, min(words.shape.head, len(words.counts)), words.shape.groups + 2
    cls = words.cls[:head]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(pdf["word"].to_numpy(), return_inverse=True)
        counts = np.zeros((contexts, len(ids)))
        counts[pdf["before"].to_numpy(), at] = pdf["n"].to_numpy()
        return pd.DataFrame({"word": ids, "logp": list(_within(counts).T.astype(np.float32))})

    classes = pairs.sparkSession.createDataFrame(pd.DataFrame({"word": np.arange(head), "cls": cls}), "word long, cls int")
    rows = pairs.select((F.col("key") % shape.head).alias("word"), F.floor(F.col("key") / shape.head).cast("int").alias("before"), "n")
    got = rows.join(F.broadcast(classes), "word").groupBy("cls").applyInPandas(fit, "word long, logp array<float>").toArrow()  # head words by contexts
    out = np.zeros((contexts, head), np.float32)
    out[:, got.column("word").to_numpy()] = np.array(got.column("logp").combine_chunks().flatten().to_numpy()).reshape(-1, contexts).T if got.num_rows else 0
    return out


@dataclass
class Model:
    words: Words
    n: int
    v: int
    tail: float  # sum of the tail's counts, each plus 0.1, and 0.1 for unknown words
    classes: np.ndarray  # log10, contexts by classes
    within: np.ndarray  # log10, groups before by head words


def _frequent(counts: DataFrame, known: int) -> DataFrame:
    """The rows of counts that can be among the `known` most frequent words: those below aren't sorted or sent anywhere."""
    bin_ = F.floor(F.log2("n") * 64)
    held = 0
    for r in sorted(counts.groupBy(bin_.alias("bin")).count().collect(), key=lambda r: -r["bin"]):  # at most 64 bins for each power of two
        held += r["count"]
        if held >= known:
            return counts.where(bin_ >= r["bin"])
    return counts


def fit(docs: DataFrame, shape: Shape | None = None) -> tuple[Model, DataFrame]:
    """The model, and the table of all counts (word, n), from the rows that are not held out."""
    shape, spark = shape or Shape(), docs.sparkSession
    sc = spark.sparkContext
    train = docs.where(~_held_out()).select(text_or_empty("text").alias("text"))
    counts = saved(word_counts(train), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = _frequent(counts, shape.known).orderBy(F.desc("n"), "word").limit(shape.known).toArrow()  # at most `known` words
    words = Words(Ids({w.encode(): k for k, w in enumerate(top.column("word").to_pylist())}), top.column("n").to_numpy().astype(np.int64), shape)
    head = min(shape.head, len(words.counts))
    follows = np.zeros((head, shape.after))
    if head:
        near = lambda own, ids, one, two: [(ids[(ids >= 0) & (ids < head) & (one >= 0) & (one < shape.after)].astype(np.int64) * shape.after + one[(ids >= 0) & (ids < head) & (one >= 0) & (one < shape.after)])]
        got = _pair_counts(train, sc.broadcast(words), near).toArrow()  # at most head * after sums
        follows[got.column("key").to_numpy() // shape.after, got.column("key").to_numpy() % shape.after] = got.column("n").to_numpy()
    tail_class = shape.classes - 1
    words.group = np.full(len(words.counts) + 2, shape.groups)
    words.cls = np.full(len(words.counts) + 2, tail_class)
    if head:
        words.group[:head], words.cls[:head] = grouped(follows, words.counts[:head], shape)
    words.group[_START] = shape.groups + 1
    r, c = shape.buckets + 1, shape.classes

    def contexts_and_words(own: Words, ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
        in_head = (ids >= 0) & (ids < head)
        return [(own.bucket[one] * r + own.bucket[two]) * c + own.cls[ids], own.group[one[in_head]].astype(np.int64) * shape.head + ids[in_head]]

    if head:
        pairs = saved(_pair_counts(train, sc.broadcast(words), contexts_and_words), "model-counts")
        by_ctx = pairs.where("kind = 0").select(F.floor(F.col("key") / c).alias("ctx"), (F.col("key") % c).alias("y"), "n").groupBy("ctx").agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("m"))
        contexts = saved(by_ctx.select("ctx", F.transform(F.sequence(F.lit(0), F.lit(c - 1)), lambda y: F.coalesce(F.get(F.map_values(F.map_filter("m", lambda k, _: k == y)), 0), F.lit(0))).alias("counts")), "contexts")
        weights, within = train_classes(contexts, shape), train_words(pairs.where("kind = 1").select("key", "n"), words) / np.log(10)
    else:
        weights, within = ClassWeights(np.where(np.arange(c) == tail_class, 0.0, -1e9), np.zeros((r, c)), np.zeros((r, c)), np.zeros((shape.pairs, c))), np.zeros((shape.groups + 2, 0), np.float32)
    if v <= head:  # no word is in the tail but unknown ones
        tail = 0.1
    else:
        tail = float(n - words.counts[:head].sum()) + 0.1 * (v - head) + 0.1
    classes = weights.table(np.arange(r * r), shape) / np.log(10)
    return Model(words, n, v, tail, classes.astype(np.float64), within), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null text counts as empty: its only token is the end. Rows with a null doc_id are held out. Repeated rows are scored
    each. Without training texts every token is unknown, and both scores are 0.
    """
    spark, shape = docs.sparkSession, model.words.shape
    shared = spark.sparkContext.broadcast(model)  # of a size that the shape gives
    head = min(shape.head, len(model.words.counts))
    below = float(np.log10(model.n + 0.1 * (model.v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = shared.value, TaskContext.get().partitionId() << 33
        words, r = m.words, shape.buckets + 1
        known = np.log10(words.counts + 0.1)
        tail = np.log10(m.tail)
        for whole in batches:
            texts = whole.column("text").to_pylist()
            for a, b in _batches(texts):
                ids, one, two, ends, split = _tokens(words, texts[a:b])
                begins = np.concatenate([[0], ends[:-1]])
                inside = ids >= 0
                base = np.where(inside, known[np.maximum(ids, 0)] if len(known) else 0.0, 0.0)
                in_head = inside & (ids < head)
                found = m.classes[words.bucket[one] * r + words.bucket[two], words.cls[ids]]
                found[in_head] += m.within[words.group[one[in_head]], ids[in_head]]
                found[~in_head] += base[~in_head] - tail  # the counts of words that aren't here are added after the join
                rare = [Counter([w for w, i in zip(s, ids[x : y - 1].tolist(), strict=True) if i < 0]) if (ids[x:y] < 0).any() else {} for s, x, y in zip(split, begins.tolist(), ends.tolist(), strict=True)]
                if m.words.ids[END] < 0:
                    for x in rare:
                        x[END] = x.get(END, 0) + 1
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(n)), whole.column("doc_id").slice(a, n), whole.column("held_out").slice(a, n), pa.array(ends - begins), pa.array(np.add.reduceat(inside, begins, dtype=np.int64)),
                        pa.array(np.add.reduceat(base, begins) - below * (ends - begins)), pa.array(np.add.reduceat(found, begins)), pa.array([[w.decode() for w in x] for x in rare], pa.list_(pa.string())), pa.array([list(x.values()) for x in rare], pa.list_(pa.int32())),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"],
                )
                row += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", _held_out().alias("held_out"), text_or_empty("text").alias("text"))
    rows = saved(rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, words array<string>, times array<int>"), "scores")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", "x.words", "x.times").withColumnRenamed("words", "word")
    less = counts.where(F.col("n") <= (int(model.words.counts[-1]) if len(model.words.counts) else 0))  # words here have no higher count
    rare = rare.join(less, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    return rows.drop("words", "times").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score")
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs))
