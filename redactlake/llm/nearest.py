"""Nearest neighbours by largest inner product, from randomly rotated one-bit codes.

Rows are dealt to cells around centres fitted on a bounded sample. What is left of a vector beside its centre is turned by one
fixed random rotation; the signs of its coordinates are its packed code, and two scalars correct the estimate: its norm, and
the cosine of the turned direction with its code. For a turned query q' and a code x of +-1/sqrt(D), <centre, q> +
<x, q'> * norm / cosine estimates the inner product, off by no more than
eps * |q| * norm * sqrt((1 - cosine^2) / cosine^2 / (D - 1)) but for a small chance.

A query first visits the cells with the nearest centres; its k-th best inner product there is its line. It then visits every
other cell whose bound reaches the line, and in any cell only vectors whose upper bound reaches the line are measured exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactlake.llm.common import in_batches, saved, table

_OUT = "query_id long, vec_id long, score double"


def rotation(dim: int, seed: int = 20) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, norms and cosines with the codes. A zero vector has norm 0 and cosine 1."""
    norms = np.sqrt((vectors**2).sum(axis=1))
    turned = (vectors / np.where(norms > 0, norms, 1)[:, None]) @ turn
    return np.packbits(turned > 0, axis=1), norms, np.where(norms > 0, np.abs(turned).sum(axis=1) / math.sqrt(vectors.shape[1]), 1.0)


def centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 21) -> np.ndarray:
    """k-means; a centre that nothing is nearest to stays where it is."""
    found = sample[np.random.default_rng(seed).permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        own = nearest_centre(sample, found)
        n = np.bincount(own, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        found[n > 0] = sums[n > 0] / n[n > 0, None]
    return found


def nearest_centre(vectors: np.ndarray, found: np.ndarray) -> np.ndarray:
    half = (found**2).sum(axis=1) / 2
    return np.concatenate([(vectors[a : a + 4096] @ found.T - half).argmax(axis=1) for a in range(0, len(vectors), 4096)]) if len(vectors) else np.zeros(0, np.int64)


def _inner(rows: np.ndarray, queries: np.ndarray, row: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of pairs in double precision, added up in the order of the components. rows, queries: [dim, n]."""
    out = np.zeros(len(row))
    for x, q in zip(rows, queries, strict=True):
        out += x[row] * q[query]
    return out


def search_cell(query_ids: np.ndarray, queries: np.ndarray, lines: np.ndarray, ids: np.ndarray, vectors: np.ndarray, code: np.ndarray, norm: np.ndarray, cosine: np.ndarray, centre: np.ndarray, k: int, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k best rows of one cell that reach its line (-inf: none yet): query_id, vec_id, score."""
    dim, n = vectors.shape[1], len(ids)
    signs = (np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1).T * (norm / cosine / math.sqrt(dim)).astype(np.float32)
    slack = (eps * norm * np.sqrt(np.maximum(0, 1 - cosine**2)) / cosine / math.sqrt(max(1, dim - 1))).astype(np.float32)
    turned, columns, found = (queries @ rotation(dim)).astype(np.float32), np.ascontiguousarray(vectors.T), []
    length, at_centre = np.sqrt((queries**2).sum(axis=1)).astype(np.float32), (queries @ centre).astype(np.float32)
    some = min(n, 2 * k + 1)  # measured first where there is no line
    for a in range(0, len(queries), 512):
        part = slice(a, a + 512)
        guess = turned[part] @ signs + at_centre[part, None]
        line, own, asked = lines[part].copy(), ids[None] == query_ids[part, None], np.ascontiguousarray(queries[part].T)
        guess[own] = -np.inf
        if (new := np.flatnonzero(np.isneginf(line))).size and n > some:
            first = np.argpartition(guess[new], n - some, axis=1)[:, n - some :]
            score = _inner(columns, asked, first.ravel(), np.repeat(new, some)).reshape(-1, some)
            score[np.take_along_axis(own[new], first, axis=1)] = -np.inf
            line[new] = np.sort(score, axis=1)[:, -k] if some >= k else -np.inf
        guess += slack[None] * length[part, None]
        query, row = np.nonzero((guess >= line[:, None].astype(np.float32) - np.float32(1e-6)) & ~own)
        score = _inner(columns, asked, row, query)
        good = score >= line[query]
        query, row, score = query[good], row[good], score[good]
        order = np.lexsort((ids[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < k
        found.append((query_ids[part][query[best]], ids[row[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search(vectors: DataFrame, k: int = 20, query_every: int = 20, eps: float = 2.5, cell_eps: float = 3.5, first_cells: int = 3, cell_rows: int = 2_048, most_cells: int = 1_024, sample_rows: int = 16_384, block_rows: int = 8_192, block_queries: int = 65_536) -> DataFrame:
    """The k nearest rows of every row whose vec_id is divisible by `query_every`: query_id, rank, vec_id, score.

    `eps` and `cell_eps` are the standard errors within which vectors and cells are looked at. Centres, at most `most_cells`
    for one in `cell_rows` rows, are fitted on a draw of `sample_rows` rows; every row is in the index. A cell of more than
    `block_rows` rows is several blocks, and more than `block_queries` queries are several groups; a task holds one of each.
    Queries travel to the cells, the index is written once. Null ids or vectors, null or non-finite components, zero vectors
    and vectors of another length than most take no part. A repeated vec_id is one more candidate for others, never for its
    own queries; a repeated query gives its rows once. An empty table gives an empty result. Other columns are not read.
    """
    spark, vector = vectors.sparkSession, F.col("embedding")
    good = F.col("vec_id").isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]
    rows = rows.where(F.size("embedding") == dim)
    drawn = rows.sample(False, min(1.0, sample_rows / n), 22).select("embedding").toArrow()  # about `sample_rows`
    sample = _matrix(drawn.column("embedding").combine_chunks(), dim) if drawn.num_rows else np.zeros((1, dim))
    middle = centres(sample, max(1, min(most_cells, round(n / cell_rows), len(sample))))

    def start():
        turn, salt = rotation(dim), np.random.default_rng(TaskContext.get().partitionId())

        def work(b: pa.RecordBatch) -> dict:
            x = _matrix(b.column("embedding"), dim)
            cell = nearest_centre(x, middle)
            code, norm, cosine = encode(x - middle[cell], turn)
            return {"cell": cell.astype(np.int32), "code": [c.tobytes() for c in code], "norm": norm, "cosine": cosine, "deal": salt.integers(0, 1 << 30, len(x), dtype=np.int32)}

        return work

    index = saved(in_batches(rows, start, ("vec_id", "embedding"), "cell int, code binary, norm double, cosine double, deal int"), "one-bit-index")
    count, reach = np.zeros(len(middle), np.int64), np.zeros(len(middle))
    for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("reach")).collect():  # at most `most_cells`
        count[r["cell"]], reach[r["cell"]] = r["n"], r["reach"]
    blocks = np.maximum(1, -(-count // block_rows))
    groups = max(1, math.ceil(n / query_every / block_queries))
    index = index.withColumn("block", F.pmod(F.col("deal"), F.get(F.array(*map(F.lit, blocks.tolist())), F.col("cell"))).cast("int"))
    if groups > 1:
        index = index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    else:
        index = index.withColumn("qb", F.lit(0))
    asked = rows.where(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), "embedding")
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    near = min(first_cells, int((count > 0).sum()))

    def visits(queries: DataFrame) -> DataFrame:
        """A row for each query and block to visit: with a column `line` the cells beyond the first that reach it."""
        later = "line" in queries.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1_000):
                    b = whole.slice(at, 1_000)
                    q = _matrix(b.column("embedding"), dim)
                    at_centre = np.where(count > 0, q @ middle.T, -np.inf)
                    first = np.zeros(at_centre.shape, bool)
                    np.put_along_axis(first, np.argsort(-at_centre, axis=1, kind="stable")[:, :near], True, axis=1)
                    if later:
                        line = np.array([-np.inf if x is None else x for x in b.column("line").to_pylist()])
                        bound = at_centre + min(1.0, cell_eps / math.sqrt(dim)) * np.sqrt((q**2).sum(axis=1))[:, None] * reach
                        go = (bound >= line[:, None]) & ~first & (count > 0)
                    else:
                        line, go = np.full(len(q), -np.inf), first
                    query, cell = np.nonzero(go)
                    query, cell = np.repeat(query, blocks[cell]), np.repeat(cell, blocks[cell])
                    block = np.arange(len(query)) - np.searchsorted(query * len(middle) + cell, query * len(middle) + cell)
                    for y in range(0, len(query), 10_000):
                        z = slice(y, y + 10_000)
                        yield pa.RecordBatch.from_arrays(
                            [b.column("query_id").take(pa.array(query[z])), b.column("embedding").take(pa.array(query[z])), b.column("qb").take(pa.array(query[z])), pa.array(line[query[z]]), pa.array(cell[z].astype(np.int32)), pa.array(block[z].astype(np.int32))],
                            names=["query_id", "embedding", "qb", "line", "cell", "block"],
                        )

        kind = rows.schema["embedding"].dataType.simpleString()
        return queries.mapInArrow(run, f"query_id long, embedding {kind}, qb int, line double, cell int, block int")

    def meet(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, c = queries.combine_chunks(), candidates.combine_chunks()
        of = lambda t, name: t.column(name).to_numpy()
        code = np.frombuffer(b"".join(c.column("code").to_pylist()), np.uint8).reshape(c.num_rows, -1)
        found = search_cell(of(q, "query_id"), _matrix(q.column("embedding").combine_chunks(), dim), of(q, "line"), of(c, "vec_id"), _matrix(c.column("embedding").combine_chunks(), dim), code, of(c, "norm"), of(c, "cosine"), middle[c.column("cell")[0].as_py()], k, eps)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    key, order = ("cell", "block", "qb"), Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    visit = lambda queries: visits(queries).groupBy(*key).cogroup(index.groupBy(*key)).applyInArrow(meet, _OUT)
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = saved(best(visit(asked)), "first-cells")
    lines = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("line"))
    rest = visit(asked.join(lines, "query_id", "left"))
    return best(first.drop("rank").unionAll(rest)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS rank
  FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 20 = 0
) WHERE rank <= 20
"""
