"""Token ids as directly addressable codes: chunk levels, continuation bitmaps and rank directories.

An id is cut into chunks of `bits` bits, lowest first. Level 0 holds the first chunk of every id; a bitmap says which ids go
on, and level 1 holds the next chunk of just those, and so on. The rank directory counts the ones before every block of 512
bits, so the place of any id in the next level follows from a popcount of at most eight words: any token is read without
decoding a block.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactlake.llm.common import saved, table, text_or_empty

MAGIC = b"DAC1"
_BLOCK = 512  # bits between two entries of a rank directory


def dac_pack(ids: np.ndarray, bits: int = 8) -> bytes:
    """The file format: magic, chunk bits, number of levels, number of ids; then for each level its length, its chunks (one byte each), its bitmap (64-bit words) and its rank directory (32-bit). All little-endian."""
    assert 1 <= bits <= 8
    left, levels = np.ascontiguousarray(ids, dtype=np.uint64), []
    while True:
        more = left >> np.uint64(bits) > 0
        words = np.zeros(-(-len(left) // _BLOCK) * (_BLOCK // 64), dtype="<u8")
        packed = np.packbits(more, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(words).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        levels.append((np.bitwise_and(left, np.uint64((1 << bits) - 1)).astype(np.uint8), words, ranks))
        if not more.any():
            break
        left = left[more] >> np.uint64(bits)
    out = [MAGIC, struct.pack("<BBQ", bits, len(levels), len(ids))]
    for chunks, words, ranks in levels:
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), words.tobytes(), ranks.tobytes()]
    return b"".join(out)


class DacReader:
    """Random access to a packed segment; arrays are views of the bytes."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.bits, levels, self.n = struct.unpack_from("<BBQ", raw, 4)
        at, self.levels = 4 + struct.calcsize("<BBQ"), []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            blocks = -(-n // _BLOCK)
            chunks = np.frombuffer(raw, np.uint8, n, at + 8)
            words = np.frombuffer(raw, "<u8", blocks * (_BLOCK // 64), at + 8 + n)
            ranks = np.frombuffer(raw, "<u4", blocks, at + 8 + n + blocks * (_BLOCK // 8))
            self.levels.append((chunks, words, ranks))
            at += 8 + n + blocks * (_BLOCK // 8 + 4)

    def get(self, index: np.ndarray) -> np.ndarray:
        """The ids at any places, in any order."""
        at = np.asarray(index, dtype=np.int64)
        out, where = np.zeros(len(at), dtype=np.uint64), np.arange(len(at))
        for level, (chunks, words, ranks) in enumerate(self.levels):
            out[where] |= chunks[at].astype(np.uint64) << np.uint64(self.bits * level)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            on = (words[word] >> bit) & np.uint64(1) > 0
            if not on.any():
                break
            at, where, word, bit = at[on], where[on], word[on], bit[on]
            rank = ranks[at // _BLOCK].astype(np.int64) + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            for back in range(1, _BLOCK // 64):  # the words of the block before the id's own
                before = (word & 7) >= back
                rank[before] += np.bitwise_count(words[word[before] - back])
            at = rank
        return out.astype(np.uint32)

    def run(self, start: int, n: int) -> np.ndarray:
        """n ids from `start` on: where a run's continuing ids lie in the next level is one rank, the rest follow it."""
        out, at, count, where = np.zeros(n, dtype=np.uint64), int(start), int(n), np.arange(n)
        for level, (chunks, words, ranks) in enumerate(self.levels):
            if not count:
                break
            out[where] |= chunks[at : at + count].astype(np.uint64) << np.uint64(self.bits * level)
            first = at >> 6
            on = np.unpackbits(words[first : ((at + count - 1) >> 6) + 1].view(np.uint8), bitorder="little")[at & 63 :][:count].astype(bool)
            block = at // _BLOCK
            rank = int(ranks[block]) + int(np.bitwise_count(words[block * 8 : first]).sum()) + int(np.bitwise_count(words[first] & np.uint64((1 << (at & 63)) - 1)))
            where, at, count = where[on], rank, int(on.sum())
        return out.astype(np.uint32)


class WordIds:
    """The tokenizer of one worker, with the ids (little-endian 32-bit) of the words it has met; emptied at `most` words.

    The tokenizer drops white space and merges only inside words, so the ids of a text are those of its words in turn. New
    words are encoded in texts of `together` words with a mark between them, a character that is one token and in no text
    as a rule. As the tokenizer lower-cases, A-Z are
    lower-cased beforehand, but not where that could make up the name of a special token.
    """

    def __init__(self, vocab: str, most: int = 800_000, together: int = 200):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work; a task keeps to its core
        from tokenizers import Tokenizer

        self.tok, self.known, self.most, self.together = Tokenizer.from_file(vocab), {}, most, together
        sole = [c for c in "\x01\x02\x03\x04" if len(self.tok.encode(c, add_special_tokens=False).ids) == 1]
        self.between = f" {sole[0]} " if sole else " "
        self.mark = self.tok.encode(sole[0], add_special_tokens=False).ids[0] if sole else -1

    def learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), self.together):
            part = words[at : at + self.together]
            texts = [w.decode() for w in part]
            ids = np.array(self.tok.encode(self.between.join(texts), add_special_tokens=False).ids, dtype="<u4")
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(part) - 1:  # a word holds the mark itself
                self.known.update((w, np.array(self.tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()) for w, t in zip(part, texts, strict=True))
                continue
            raw, begins, ends = ids.tobytes(), [0, *((marks + 1) * 4).tolist()], [*(marks * 4).tolist(), len(ids) * 4]
            self.known.update((w, raw[a:b]) for w, a, b in zip(part, begins, ends, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            upto, held = at, 0
            while upto < len(texts) and (upto == at or held + len(texts[upto]) < 2_000_000):
                held += len(texts[upto])
                upto += 1
            raws = [t.encode() for t in texts[at:upto]]
            split = [(r if b"<|" in r else r.lower()).split() for r in raws]
            if len(self.known) > self.most:
                self.known.clear()
            seen: set[bytes] = set()
            for s in split:
                seen.update(s)
            self.learn(list(seen.difference(self.known)))
            out += [b"".join(map(self.known.__getitem__, s)) for s in split]
            at = upto
        return out


_WORKER: dict[str, WordIds] = {}


def encode_texts(vocab: str, texts: list[str]) -> list[bytes]:
    if vocab not in _WORKER:
        _WORKER[vocab] = WordIds(vocab)
    return _WORKER[vocab].encode(texts)


def write_segments(docs: DataFrame, vocab: str, end_id: int = 2, segment_ids: int = 1 << 19, bits: int = 8, files: int | None = None) -> DataFrame:
    """Writes the ids of all documents, in ascending order of doc_id (nulls first; ties by text), as a table of packed segments in the shared folder, and returns that table as read back.

    A row is a segment: part (its file's place in the order), seg, the doc_ids and counts of its documents, and the packed
    ids. A segment holds whole documents up to about `segment_ids` ids; a longer document has one of its own.
    """
    ordered = docs.select(F.col("doc_id"), text_or_empty("text").alias("text"))
    files = files or max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = ordered.repartitionByRange(files, F.asc_nulls_first("doc_id"), F.asc(F.xxhash64("text"))).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc(F.xxhash64("text")))
    tail = np.array([end_id], dtype="<u4").tobytes()

    names = ("part", "seg", "doc_ids", "counts", "packed")
    kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, held, ids, counts, docs_in = TaskContext.get().partitionId(), 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            row = (part, seg, docs_in, counts, dac_pack(np.frombuffer(b"".join(ids), "<u4"), bits))
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=names)

        for b in batches:
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), encode_texts(vocab, b.column("text").to_pylist()), strict=True):
                raw += tail
                if held and held + len(raw) // 4 > segment_ids:
                    yield flush()
                    seg, held, ids, counts, docs_in = seg + 1, 0, [], [], []
                ids.append(raw)
                counts.append(len(raw) // 4)
                docs_in.append(doc_id)
                held += len(raw) // 4
        if docs_in:
            yield flush()

    return saved(ordered.mapInArrow(pack, "part int, seg int, doc_ids array<long>, counts array<long>, packed binary"), "token-ids")


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the packed segments."""
    sizes = segments.select("part", "seg", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("in_part"))  # a row for each file
    before = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before_part"))
    inside = Window.partitionBy("part").orderBy("seg")
    starts = sizes.withColumn("before_seg", F.sum("n").over(inside) - F.col("n")).join(before, "part").select("part", "seg", (F.col("before_part") + F.col("before_seg")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_ids, counts, packed, start in zip(*(b.column(c).to_pylist() for c in ("doc_ids", "counts", "packed", "start")), strict=True):
                reader, ends = DacReader(packed), np.cumsum(counts)
                begins = ends - np.asarray(counts)
                sums = [zlib.crc32(reader.run(int(x), int(n)).astype("<u4").tobytes()) for x, n in zip(begins, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + begins), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.join(starts, ["part", "seg"]).select("doc_ids", "counts", "packed", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text: no ids but the end id. An empty table gives no rows. Other columns are not read."""
    import public_tokenizers

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return read_documents(write_segments(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
