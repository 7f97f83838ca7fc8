"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

A sequence is a word's lower-cased bytes between two spaces (longer words: runs of MAX_BYTES bytes), so the network's
labels for a word are the same wherever it stands, and a worker runs it once for each distinct word it meets. Every byte
position gets a distribution over the languages; a document's distribution is the mean over all its positions, each
occurrence of a word counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactlake.llm.common import SPACES, ascii_lower, in_batches, saved, table, text_or_empty

MAX_BYTES = 24


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGru:
    """Parameters: byte vectors E; for each direction W [e, 3h], U [h, 3h] and b [3h] (update, reset, candidate); output V [2h, k] and c [k]."""

    def __init__(self, labels: int, embed: int = 12, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        put = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.h, self.seen = hidden, np.zeros(1 << 24, bool)  # seen: trigrams of the words it learned from
        self.p = {"E": put(256, embed) * 8, "V": put(2 * hidden, labels), "c": np.zeros(labels, np.float32)}
        for d in "fb":
            self.p |= {"W" + d: put(embed, 3 * hidden), "U" + d: put(hidden, 3 * hidden), "b" + d: np.zeros(3 * hidden, np.float32)}

    def _scan(self, x: np.ndarray, live: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: [T, B, e]; live: [T, B, 1], 1 where there is a byte. Beyond a sequence the state stays."""
        h, n, out = np.zeros((x.shape[1], self.h), np.float32), self.h, np.empty((x.shape[0], x.shape[1], self.h), np.float32)
        U, pre = self.p["U" + d], x @ self.p["W" + d] + self.p["b" + d]
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            zr = _sigmoid(pre[t, :, : 2 * n] + h @ U[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            g = np.tanh(pre[t, :, 2 * n :] + (r * h) @ U[:, 2 * n :])
            new = h + live[t] * z * (g - h)
            if keep is not None:
                keep.append((t, h, z, r, g))
            out[t] = h = new
        return out

    def forward(self, seq: np.ndarray, live: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log probabilities [T, B, labels]; seq: bytes [T, B]."""
        x, tapes = self.p["E"][seq], {"f": [], "b": []}
        hs = np.concatenate([self._scan(x, live, d, None if keep is None else tapes[d]) for d in "fb"], axis=2)
        y = hs @ self.p["V"] + self.p["c"]
        y -= y.max(axis=2, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=2, keepdims=True))
        if keep is not None:
            keep |= {"x": x, "hs": hs, "tapes": tapes}
        return y

    def gradients(self, seq: np.ndarray, live: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Back-propagation through time of the mean cross entropy of all positions. target: [B, labels], weight: [B]."""
        keep: dict = {}
        y = self.forward(seq, live, keep)
        w = live * (weight[None, :, None] / (live * weight[None, :, None]).sum())
        loss, dy = -float((w * target[None] * y).sum()), (np.exp(y) - target[None]) * w
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["V"], g["c"] = np.einsum("tbh,tbk->hk", keep["hs"], dy), dy.sum(axis=(0, 1))
        dhs, n, dx = dy @ self.p["V"].T, self.h, np.zeros_like(keep["x"])
        for d, part in (("f", dhs[:, :, : self.h]), ("b", dhs[:, :, self.h :])):
            U, W, dh = self.p["U" + d], self.p["W" + d], np.zeros(part.shape[1:], np.float32)
            for t, h, z, r, c in reversed(keep["tapes"][d]):
                dh = dh + part[t]
                dn = dh * live[t]
                dz, dc = dn * (c - h) * z * (1 - z), dn * z * (1 - c * c)
                drh = dc @ U[:, 2 * n :].T
                dr = drh * h * r * (1 - r)
                da = np.concatenate([dz, dr, dc], axis=1)
                g["U" + d][:, : 2 * n] += h.T @ da[:, : 2 * n]
                g["U" + d][:, 2 * n :] += (r * h).T @ dc
                g["W" + d] += keep["x"][t].T @ da
                g["b" + d] += da.sum(axis=0)
                dx[t] += da @ W.T
                dh = dh - dn * z + da[:, : 2 * n] @ U[:, : 2 * n].T + drh * r
        np.add.at(g["E"], seq.ravel(), dx.reshape(-1, dx.shape[2]))
        return loss, g


def padded(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes [T, B] and which are there [T, B, 1]."""
    longest = max(map(len, pieces))
    seq = np.frombuffer(b"".join(p.ljust(longest, b"\0") for p in pieces), np.uint8).reshape(len(pieces), longest).T
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return seq, (np.arange(longest)[:, None] < sizes).astype(np.float32)[:, :, None]


def pieces_of(word: bytes) -> list[bytes]:
    word = b" " + word + b" "
    return [word[a : a + MAX_BYTES] for a in range(0, len(word), MAX_BYTES)]


def train(words: list[tuple[bytes, np.ndarray]], labels: int, steps: int = 300, batch: int = 384, rate: float = 0.02, seed: int = 6) -> BiGru:
    """Adam over batches of words of like length; a word's target is the distribution of its languages, its weight grows as the root of its count."""
    net, rng = BiGru(labels), np.random.default_rng(seed)
    data = sorted(((p, c) for w, c in words for p in pieces_of(w)), key=lambda x: (len(x[0]), x[0]))
    counts = np.array([c for _, c in data], dtype=np.float64)
    shares = counts / np.maximum(counts.sum(axis=0), 1)  # languages weigh the same however many documents each has
    target = (shares / shares.sum(axis=1, keepdims=True)).astype(np.float32)
    weight = np.sqrt(counts.sum(axis=1)).astype(np.float32)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in "mv")
    for step in range(1, steps + 1):
        at = int(rng.integers(0, max(1, len(data) - batch + 1)))
        near = np.unique(np.clip(at + rng.integers(0, batch * 4, batch), 0, len(data) - 1))
        seq, live = padded([data[i][0] for i in near])
        _, g = net.gradients(seq, live, target[near], weight[near])
        size = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in net.p:
            x = g[k] * min(1.0, 1 / (size + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            net.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def trigrams(seq: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three bytes in a row as a number [T - 2, B], and where there are three with a letter (or a byte of one) in the middle."""
    x = seq.astype(np.int32)
    middle = x[1:-1]
    letter = (middle >= 128) | ((middle | 32) >= 97) & ((middle | 32) <= 122)
    return x[:-2] << 16 | middle << 8 | x[2:], letter & (live[2:, :, 0] > 0)


_WORKER: dict[str, tuple] = {}
LOW = 0.6  # room below the scores of held-out texts


class Labeller:
    """The sums of a word's position distributions, each distinct word computed once; emptied at `most` words."""

    def __init__(self, net: BiGru, labels: int, most: int = 200_000, seen: np.ndarray | None = None):
        self.net, self.labels, self.most, self.seen = net, labels, most, seen
        self.known: dict[bytes, int] = {}
        self.width = labels + 1 + 2 * (seen is not None)
        self.sums = np.zeros((1024, self.width), np.float32)

    def learn(self, words: list[bytes]) -> None:
        if len(self.known) > self.most:
            self.known.clear()
        first = len(self.known)
        if first + len(words) > len(self.sums):
            self.sums = np.concatenate([self.sums[:first], np.zeros((max(first, len(words)) + len(words), self.width), np.float32)])
        self.sums[first : first + len(words)] = 0
        pieces = sorted(((p, first + k) for k, w in enumerate(words) for p in pieces_of(w)), key=lambda x: len(x[0]))
        for at in range(0, len(pieces), 2048):
            part = pieces[at : at + 2048]
            seq, live = padded([p for p, _ in part])
            each = np.concatenate([np.exp(self.net.forward(seq, live)) * live, live], axis=2).sum(axis=0)
            if self.seen is not None:
                grams, there = trigrams(seq, live)
                each = np.concatenate([each, (self.seen[grams] & there).sum(axis=0)[:, None], there.sum(axis=0)[:, None]], axis=1)
            np.add.at(self.sums, np.array([k for _, k in part]), each)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def documents(self, texts: list[str]) -> np.ndarray:
        """Mean distribution of each text; rows of a text without words are zero. With `seen`: times the share of its trigrams (of letters) that the network has learned from."""
        out, at = np.zeros((len(texts), self.labels)), 0
        while at < len(texts):
            upto, held = at, 0
            while upto < len(texts) and (upto == at or held + len(texts[upto]) < 4_000_000):
                held += len(texts[upto])
                upto += 1
            split = [t.encode().lower().split() for t in texts[at:upto]]
            seen: set[bytes] = set()
            for s in split:
                seen.update(s)
            if new := seen.difference(self.known):
                if len(self.known) > self.most:
                    self.known.clear()
                    new = seen
                self.learn(list(new))
            for k, s in enumerate(split, at):
                if s:
                    total = self.sums[np.fromiter(map(self.known.__getitem__, s), np.int64, len(s))].sum(axis=0, dtype=np.float64)
                    out[k] = total[: self.labels] / total[self.labels]
                    if self.seen is not None:
                        out[k] *= total[-2] / total[-1] if total[-1] else 1
            at = upto
        return out


def _quota(sizes: list[int], most: int) -> int:
    """The largest q with sum(min(q, size)) of at most `most`: what a language may have so that small ones keep all of theirs."""
    left = sorted(sizes)
    for k, x in enumerate(left):
        if x * (len(left) - k) > most:
            return most // (len(left) - k)
        most -= x
    return max(left, default=0)


def fit(docs: DataFrame, sample_docs: int = 2_500, most_words: int = 30_000) -> tuple[BiGru, list[str]]:
    """Learns from a bounded sample of the rows with a language and a remainder other than 1: `sample_docs` documents (mean of a
    draw by a hash of the id) of whole texts, and of their distinct words `most_words`, the most frequent of each language.
    Languages have like shares of both, and those with less than their share have all of it, so that rare ones are learned too."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    quota = _quota(list(sizes.values()), sample_docs)
    upto = F.coalesce(*(F.when(F.col("lang") == x, F.lit(int(min(1.0, max(1, quota) / n) * (1 << 30)))) for x, n in sorted(sizes.items())), F.lit(0))
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < upto)
    words = saved(drawn.select("lang", F.explode(F.split(ascii_lower(F.col("text")), SPACES)).alias("word")).where(F.col("word") != "").groupBy("word", "lang").count(), "sample-words")
    most = max(1, _quota([r["count"] for r in words.groupBy("lang").count().collect()], most_words))
    first = words.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).where(F.col("place") <= most).select("word").distinct()
    by_word = words.join(first, "word", "left_semi").groupBy("word").agg(F.sum("count").alias("n"), F.collect_list(F.struct("lang", "count")).alias("langs"))
    rows = by_word.orderBy(F.desc("n"), "word").collect()  # at most `most_words`
    labels = sorted({x["lang"] for r in rows for x in r["langs"]})
    place = {x: k for k, x in enumerate(labels)}
    data = []
    for r in rows:
        counts = np.zeros(len(labels))
        for x in r["langs"]:
            counts[place[x["lang"]]] = x["count"]
        data.append((r["word"].encode(), counts))
    net = train(data, len(labels)) if data else BiGru(1)
    for a in range(0, len(data), 2048):
        at, there = trigrams(*padded([p for w, _ in data[a : a + 2048] for p in pieces_of(w)]))
        net.seen[at[there]] = True
    return net, labels


def predict(docs: DataFrame, net: BiGru, labels: list[str]) -> DataFrame:
    """doc_id, lang_pred and score of every row. `und` with score 0: a null text, one without a letter, or no labels at all. Ties go to the label that sorts first."""
    model, key = {k: v.copy() for k, v in net.p.items()}, str(hash(tuple(x.tobytes() for x in net.p.values())))

    def start():
        if key not in _WORKER:
            _WORKER.clear()
            own = BiGru(len(labels))
            own.p = model
            _WORKER[key] = (Labeller(own, len(labels)),)

        def work(b: pa.RecordBatch) -> dict:
            found, letters = _WORKER[key][0].documents(b.column("text").to_pylist()), b.column("letters").to_pylist()
            return {"lang_pred": [labels[x] if ok else "und" for x, ok in zip(found.argmax(axis=1), letters, strict=True)], "score": np.where(letters, np.clip(found.max(axis=1), 0, 1), 0.0)}

        return work

    rows = docs.select("doc_id", text_or_empty("text").alias("text")).withColumn("letters", F.col("text").rlike(r"\p{L}"))
    if not labels:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return in_batches(rows, start, ("doc_id",), "lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, *fit(docs))
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def _sureness(net: BiGru, labels: list[str]):
    """A function of texts: how sure the network is of each, as a worker can hold it."""
    model, seen = {k: v.copy() for k, v in net.p.items()}, np.packbits(net.seen)

    def of() -> Callable[[list[str]], np.ndarray]:
        own = BiGru(len(labels))
        own.p = model
        labeller = Labeller(own, len(labels), seen=np.unpackbits(seen).astype(bool))
        return lambda texts: labeller.documents(texts).max(axis=1, initial=0)

    return of


_FINE = 10_000  # scores are counted in steps of one in so many


def _quantile(counts: list[tuple[int, int]], share: float) -> float:
    """The quantile of values that occur so often, linear between two of them."""
    counts = sorted(counts)
    values, upto = np.array([v for v, _ in counts], dtype=np.float64), np.cumsum([n for _, n in counts])
    at = share * (upto[-1] - 1)
    low, high = (values[np.searchsorted(upto, k, "right")] for k in (np.floor(at), np.ceil(at)))
    return float(low + (high - low) * (at - np.floor(at)))


def least_sure(docs: DataFrame, net: BiGru, labels: list[str]) -> float:
    """The score below which a text is in no learned language: set from all labelled rows that the network hasn't learned from, at LOW of that below which one in a hundred is, of the language with the lowest. Spark counts their scores in steps of 1 / _FINE."""
    held = docs.where(F.col("lang").isin(labels) & F.col("text").rlike(r"\p{L}") & (F.crc32(F.col("doc_id").cast("string")) % 3 == 1))
    of = _sureness(net, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sure = of()
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf["lang"], "step": np.floor(sure(list(pdf["text"])) * _FINE).astype(np.int32)})

    by: dict[str, list[tuple[int, int]]] = {}
    for r in held.select("lang", "text").mapInPandas(run, "lang string, step int").groupBy("lang", "step").count().collect():  # at most _FINE + 1 rows a language
        by.setdefault(r["lang"], []).append((r["step"], r["count"]))
    return LOW * min(_quantile(c, 0.01) for c in by.values()) / _FINE if by else min(0.5, 1.5 / len(labels))


def keep_languages(docs: DataFrame, net: BiGru, labels: list[str], least: float | None = None) -> DataFrame:
    """The rows, with all their columns, of whose language the network is at least so sure (without `least`: as least_sure says). `und` never is."""
    if not labels:
        return docs.limit(0)
    least = least_sure(docs, net, labels) if least is None else least
    of = _sureness(net, labels)

    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure = of()
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(sure(b.column(text).to_pylist()) >= least))

    return docs.where(F.col("text").rlike(r"\p{L}")).mapInArrow(run, docs.schema)
