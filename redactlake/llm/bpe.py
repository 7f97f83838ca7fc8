"""Byte-level BPE by recursive DuckDB queries inside Spark's partitions.

A worker keeps one DuckDB connection with the merge table: a row (l, r, id, safe) for every way in which a token is two
tokens. Words are rows of (word, position, token); the recursive query joins neighbours with the merge table, contracts
each word's leftmost pair of least rank, and goes on until no word has a pair left. Ordered aggregation then gives the ids
of a word, and the bytes of a run of ids. A worker encodes a distinct word, and decodes a distinct run of ids, once; texts
are put together from those.

A long word is cut first wherever no token of the vocabulary that occurs in it stands on both sides: every contraction makes
such a token, so none ever goes across, and the parts have the same ids on their own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from redactlake.llm.common import in_batches, table, text_or_empty

#: Words, and parts of longer words, of up to so many bytes go through SHORT, which contracts one pair of a word in a step.
SHORT_BYTES = 64

#: nid is the token that follows in the word, or null.
SHORT = """
WITH RECURSIVE t(w, step, pos, id, nid) AS (
  SELECT w, 0, pos, id, nid FROM base
  UNION ALL
  (WITH b AS (SELECT w, min(g.id::BIGINT * 1048576 + pos) AS best FROM t JOIN merges g ON g.l = t.id AND g.r = t.nid GROUP BY w),
    h AS (SELECT b.w, best % 1048576 AS spot, (best // 1048576)::INTEGER AS mid, nid AS after FROM b JOIN t ON t.w = b.w AND t.pos = best % 1048576 + 1)
  SELECT t.w, step + 1, (CASE WHEN pos > spot THEN pos - 1 ELSE pos END)::INTEGER, CASE WHEN pos = spot THEN mid ELSE id END, CASE WHEN pos = spot THEN after WHEN pos = spot - 1 THEN mid ELSE nid END
  FROM t JOIN h ON t.w = h.w WHERE pos <> spot + 1)
)
SELECT w, list(id ORDER BY pos) AS ids FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) GROUP BY w ORDER BY w
"""

#: For long parts, such as runs of one letter: where no pair with the new token can have a lower rank (safe), all pairs of the least rank that don't
#: overlap are contracted at once, from the left; the result is the same, in as many steps as the word has different ranks.
#: A query takes some steps, so that few of them are held at a time, and is asked again with what it has left.
LONG = """
WITH RECURSIVE t(w, step, pos, id) AS (
  SELECT w, 0, pos, id FROM base
  UNION ALL
  SELECT w, step + 1, pos, CASE WHEN take THEN mid ELSE id END FROM (
    SELECT *, lag(take, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone FROM (
      SELECT *, mid IS NOT DISTINCT FROM least AND (CASE WHEN safe THEN (k - coalesce(brk, 0)) % 2 = 1 ELSE k = first END) AS take FROM (
        SELECT *, max(CASE WHEN mid IS DISTINCT FROM least THEN k END) OVER (PARTITION BY w ORDER BY pos) AS brk, min(CASE WHEN mid = least THEN k END) OVER (PARTITION BY w) AS first FROM (
          SELECT p.*, g.id AS mid, g.safe AS safe, min(g.id) OVER (PARTITION BY w) AS least FROM (
            SELECT w, step, pos, id, lead(id) OVER (PARTITION BY w ORDER BY pos) AS nid, row_number() OVER (PARTITION BY w ORDER BY pos) AS k FROM t
          ) p LEFT JOIN merges g ON g.l = p.id AND g.r = p.nid
        ) WHERE least IS NOT NULL AND step < 12
      )
    )
  ) WHERE NOT gone
)
SELECT w, list(id ORDER BY pos) AS ids FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) GROUP BY w ORDER BY w
"""

DECODE = "SELECT w, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM run JOIN vocab USING (id) GROUP BY w ORDER BY w"


class Bpe:
    """The tokenizer of one worker."""

    def __init__(self, ranks_path: str, pattern: str, most: int = 400_000, batch_bytes: int = 256_000):
        import duckdb
        import regex

        self.pattern, self.inner_space = regex.compile(pattern), regex.compile(r"(?<=\S) (?=\S)")
        self.near_spaces = regex.compile(r"\s\s|\A\s|\s\Z")
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        found = [(a, b, i) for token, i in self.ranks.items() for k in range(1, len(token)) if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None]
        left, right, ids = (np.array(x, dtype=np.int32) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32),) * 3
        unsafe = np.union1d(left[ids < left], right[ids < right])
        merges = pa.table({"l": left, "r": right, "id": ids, "safe": ~np.isin(ids, unsafe)})  # noqa: F841
        vocab = pa.table({"id": np.array(list(self.ranks.values()), dtype=np.int32), "hex": [t.hex() for t in self.ranks]})  # noqa: F841
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "preserve_insertion_order": False, "temp_directory": ""})  # a word that needs more fails, and doesn't fill the machine's disk
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab")
        self.most, self.batch_bytes = most, batch_bytes
        self.words: dict[bytes, bytes] = {}  # a match of the pattern -> its ids
        self.starts: dict[str, tuple[bytes, bytes]] = {}  # what stands before the first inner space of a text -> its ids and their bytes
        self.inner: dict[str, tuple[bytes, bytes]] = {}  # what follows an inner space, up to the next one

    def _rows(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Table:
        ends = np.cumsum(sizes)
        nid, none = np.r_[ids[1:], np.int32(0)], np.zeros(len(ids), bool)
        none[ends - 1] = True
        return pa.table({"w": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), "pos": (np.arange(len(ids)) - np.repeat(ends - sizes, sizes)).astype(np.int32), "id": ids, "nid": pa.array(nid.astype(np.int32), mask=none)})

    def _contract(self, query: str, words: list[bytes]) -> Iterator[bytes]:
        """The ids of each word, by the query, until nothing changes."""
        ids, sizes = self.byte_id[np.frombuffer(b"".join(words), np.uint8)], np.array([len(w) for w in words])
        if query is LONG:
            self.db.execute(f"SET memory_limit = '{200 + len(ids) // 2_000}MB'")
        while True:
            self.db.register("base", self._rows(ids, sizes))
            found = self.db.sql(query).to_arrow_table().column("ids").combine_chunks()
            before, ids, sizes = len(ids), found.values.to_numpy().astype(np.int32), np.diff(found.offsets.to_numpy())
            if query is SHORT or len(ids) == before:
                break
        flat, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes) * 4
        return (flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))

    def _parts(self, words: list[bytes]) -> Iterator[list[bytes]]:
        """Parts of about batch_bytes; a longer word is a part of its own."""
        bins = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // self.batch_bytes
        cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), len(words)]
        return (words[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)

    @cached_property
    def _tokens(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for token in self.ranks:
            if len(token) > 1:
                found.add_word(token.decode("latin-1"), len(token))
        found.make_automaton()
        return found

    def parts_of(self, word: bytes) -> list[bytes]:
        """The word, cut between all bytes that no token in it holds both of."""
        first = np.arange(len(word))  # of the longest token that ends at a byte
        for end, size in self._tokens.iter(word.decode("latin-1")):
            if end - size + 1 < first[end]:
                first[end] = end - size + 1
        over = np.zeros(len(word) + 1, np.int64)  # over[k]: tokens that hold both byte k - 1 and byte k
        np.add.at(over, first + 1, 1)
        np.add.at(over, np.arange(len(word)) + 1, -1)
        cuts = np.flatnonzero(np.cumsum(over)[1 : len(word)] == 0) + 1
        return [word[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(word)], strict=True)]

    def encode_words(self, words: Iterable[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of each word. A word that is a token is that token; no other words are looked at here."""
        words, out = list(words), {}
        cut = {w: self.parts_of(w) for w in set(words) if len(w) > SHORT_BYTES and w not in self.ranks}
        left = [w for w in {w for w in words if w not in cut}.union(*cut.values()) if w not in self.ranks]
        for query, chosen in ((SHORT, [w for w in left if len(w) <= SHORT_BYTES]), (LONG, [w for w in left if len(w) > SHORT_BYTES])):
            for part in self._parts(chosen):
                out.update(zip(part, self._contract(query, part), strict=True))
        of = lambda w: out[w] if w in out else self.ranks[w].to_bytes(4, "little") if w else b""
        return [b"".join(map(of, cut[w])) if w in cut else of(w) for w in words]

    def decode(self, runs: list[bytes]) -> list[bytes]:
        """The bytes of each run of ids (little-endian 32-bit)."""
        out = [b""] * len(runs)
        full = [k for k, r in enumerate(runs) if r]
        done = 0
        for part in self._parts([runs[k] for k in full]):
            ids = np.frombuffer(b"".join(part), "<u4").astype(np.int32)
            sizes = np.fromiter(map(len, part), np.int64, len(part)) // 4
            self.db.register("run", pa.table({"w": np.repeat(np.arange(len(part), dtype=np.int32), sizes), "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
            for k, found in zip(full[done : done + len(part)], self.db.sql(DECODE).to_arrow_table().column("bytes").to_pylist(), strict=True):
                out[k] = found
            done += len(part)
        return out

    def _learn(self, known: dict[str, tuple[bytes, bytes]], chunks: Iterable[str], before: str) -> None:
        new = list(chunks)
        matches = [[m.encode() for m in self.pattern.findall(before + c)] for c in new]
        if missing := list({m for ms in matches for m in ms}.difference(self.words)):
            if len(self.words) > self.most:
                self.words.clear()
                missing = list({m for ms in matches for m in ms})
            self.words.update(zip(missing, self.encode_words(missing), strict=True))
        ids = [b"".join(map(self.words.__getitem__, ms)) for ms in matches]
        known.update(zip(new, zip(ids, self.decode(ids), strict=True), strict=True))

    def split(self, text: str) -> list[str]:
        """Cut at spaces between two characters that are no white space: no match of the pattern goes across such a cut, and the next one begins with the space."""
        return self.inner_space.split(text) if self.near_spaces.search(text) else text.split(" ")

    def encode_texts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of each text and the bytes that these decode to."""
        out, at = [], 0
        while at < len(texts):  # as many texts at a time as have some MB
            upto, held = at, 0
            while upto < len(texts) and (upto == at or held + len(texts[upto]) < 2_000_000):
                held += len(texts[upto])
                upto += 1
            split = [self.split(t) for t in texts[at:upto]]
            for known in (self.starts, self.inner):
                if len(known) > self.most:
                    known.clear()
            self._learn(self.starts, {s[0] for s in split}.difference(self.starts), "")
            seen: set[str] = set()
            for s in split:
                seen.update(s[1:])
            self._learn(self.inner, seen.difference(self.inner), " ")
            for s in split:
                pairs = [self.starts[s[0]], *map(self.inner.__getitem__, s[1:])]
                out.append((b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])))
            at = upto
        return out


_WORKER: dict[tuple[str, str], Bpe] = {}


def worker_bpe(ranks_path: str, pattern: str) -> Bpe:
    if (ranks_path, pattern) not in _WORKER:
        _WORKER[ranks_path, pattern] = Bpe(ranks_path, pattern)
    return _WORKER[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) of every row: a null or empty text has no ids. Repeated rows stay rows; other columns are not read."""

    def start():
        bpe = worker_bpe(ranks_path, pattern)

        def work(b: pa.RecordBatch) -> dict:
            found = bpe.encode_texts(b.column(text_col).to_pylist())
            return {"ids": [np.frombuffer(a, "<u4").astype(np.int32) for a, _ in found], "decoded": [d for _, d in found]}

        return work

    return in_batches(docs.select(id_col, text_or_empty(text_col).alias(text_col)), start, (id_col,), "ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; the digests are taken where the ids are made, so that ids don't cross to the JVM. Null and empty texts have no ids, null doc_ids stay null, repeated rows stay rows, other columns are not read."""

    def start():
        bpe = worker_bpe(ranks_path, pattern)

        def work(b: pa.RecordBatch) -> dict:
            found = bpe.encode_texts(b.column("text").to_pylist())
            return {"n_tokens": [len(a) // 4 for a, _ in found], "ids_sha256": [hashlib.sha256(a).hexdigest() for a, _ in found], "decoded_sha256": [hashlib.sha256(d).hexdigest() for _, d in found]}

        return work

    return in_batches(docs.select("doc_id", text_or_empty("text").alias("text")), start, ("doc_id",), "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty; the rest as in `digests`."""
    import public_tokenizers

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
