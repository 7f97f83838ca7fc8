"""How far sources of one language diverge: smoothed term shares compared by an exact integer chi-square-like distance.

Counting runs as vectorized SQL (DuckDB) inside tasks, over shards that Spark deals by the hash of language and term; Spark
merges the sums and the rankings. Only cells that occur are ever stored: what two sources add by terms that one or both
lack follows from how many of their terms have which count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactlake.llm.common import forget, saved, table, text_or_empty

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHARE = "(1 + 1000000000::HUGEINT * ({0} + 2) // ({1} + 2 * {2}))::BIGINT"
_FAR = "(({0} - {1}) * ({0} - {1}) // ({0} + {1}))"

_PARTS = f"""SELECT lang, source, term, count(*) AS c, count(DISTINCT row) AS d FROM (
  SELECT lang, source, row, unnest(regexp_extract_all({_LOWER.format("text")}, '{TERM}')) AS term FROM (SELECT *, row_number() OVER () AS row FROM docs)) GROUP BY ALL"""

_KEPT = "SELECT lang, source, term, c FROM shard QUALIFY sum(d) OVER (PARTITION BY lang, term) >= {least}"

_PAIRS = f"""WITH cell AS (SELECT *, {_SHARE.format("c", "n", "v")} AS p, {_SHARE.format("0", "n", "v")} AS z, {_SHARE.format("sum(c) OVER (PARTITION BY lang, term)", "lang_n", "v")} AS q FROM shard),
term AS (SELECT lang, source, term, {_FAR.format("p", "q")} AS f, row_number() OVER (PARTITION BY lang, source ORDER BY {_FAR.format("p", "q")} DESC, term) AS r FROM cell WHERE p > q)
SELECT 'pair' AS part, a.lang, a.source, b.source AS item, 0::BIGINT AS c, sum({_FAR.format("a.p", "b.p")} - {_FAR.format("a.p", "b.z")} - {_FAR.format("a.z", "b.p")} + {_FAR.format("a.z", "b.z")})::BIGINT AS value
  FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
UNION ALL SELECT 'counts', lang, source, '', c::BIGINT, count(*)::BIGINT FROM cell GROUP BY lang, source, c
UNION ALL SELECT 'term', lang, source, term, 0::BIGINT, f::BIGINT FROM term WHERE r <= {{top}}"""


def _connect():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
    con.execute("SET temp_directory = ''")
    return con


def _asked(con, name: str, rows: pa.Table, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    con.register(name, rows)
    found = con.sql(sql).to_arrow_table().cast(schema)
    con.unregister(name)
    yield from found.to_batches(max_chunksize=50_000)


def _by_slices(sql: str, name: str, schema: pa.Schema, text: str, size: int):
    """A query over as many rows at a time as have about `size` bytes in the column `text`; a longer row goes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        con = _connect()
        for b in batches:
            at, run_ = 0, 0
            for i, n in enumerate(pc.binary_length(b.column(text)).to_pylist()):
                if run_ and run_ + n > size:
                    yield from _asked(con, name, pa.Table.from_batches([b.slice(at, i - at)]), sql, schema)
                    at, run_ = i, 0
                run_ += n + 1
            if b.num_rows > at:
                yield from _asked(con, name, pa.Table.from_batches([b.slice(at)]), sql, schema)

    return run


def _by_shard(sql: str, schema: pa.Schema):
    """A query over one shard, which is one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            yield from _asked(_connect(), "shard", pa.Table.from_batches(held), sql, schema)

    return run


def _text(*names: str) -> list[pa.Field]:
    return [pa.field(n, pa.string()) for n in names]


def divergence(docs: DataFrame, least: int = 10, top: int = 10, shard_rows: int = 500_000, slice_bytes: int = 16 << 20) -> DataFrame:
    """lang, source, part, item, value, rank for the text, lang and source of every row of `docs`.

    Nulls count as ''. Terms are runs of A-Z (lower-cased), a-z and characters beyond ASCII; a language keeps those that stand in
    at least `least` of its rows (repeated rows count each). A group's share of a term is p = 1 + floor(10^9 (count + 2) / (N + 2 V)),
    the distance of two shares floor((p - q)^2 / (p + q)). Part `pair`: the sum of distances over all kept terms to each other source
    of the language, 0 if none is kept; part `term`: the `top` terms of a source that are over-represented against its language.
    Ties go by the item's bytes. An empty table gives no rows; other columns are not read. A shard has about `shard_rows` cells,
    their number follows the data; all sources of a (language, term) meet in one shard, so a shard's memory also grows with the
    number of sources, as the result does with its square.
    """
    read = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), text_or_empty("text").alias("text"))
    number = [pa.field("c", pa.int64()), pa.field("d", pa.int64())]
    parts = read.mapInArrow(_by_slices(_PARTS, "docs", pa.schema(_text("lang", "source", "term") + number), "text", slice_bytes), "lang string, source string, term string, c long, d long")
    cells = saved(parts.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d")), "divergence-cells", by_size=True)
    groups = saved(read.select("lang", "source").distinct(), "divergence-groups", by_size=True)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(1 + cells.count() // shard_rows, "lang", "term")

    kept = saved(dealt(cells).mapInArrow(_by_shard(_KEPT.format(least=least), pa.schema(_text("lang", "source", "term") + number[:1])), "lang string, source string, term string, c long"), "divergence-kept")
    langs = kept.groupBy("lang", "term").agg(F.sum("c").alias("c")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    totals = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    totals = saved(totals, "divergence-totals", by_size=True)
    schema = pa.schema(_text("part", "lang", "source", "item") + [pa.field("c", pa.int64()), pa.field("value", pa.int64())])
    found = saved(dealt(kept.join(totals, ["lang", "source"])).mapInArrow(_by_shard(_PAIRS.format(top=top), schema), "part string, lang string, source string, item string, c long, value long"), "divergence-found")
    out = saved(_merged(totals, found, top), "divergence", by_size=True)
    forget(cells, groups, kept, totals, found)
    return out


def _far(p: str, q: str) -> Column:
    """Of two columns, by name; never a division by zero, as shares are positive wherever a term is kept."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _merged(totals: DataFrame, found: DataFrame, top: int) -> DataFrame:
    """Sums over the shards. A pair's whole is: what terms of both give beyond the rest, what each side's own terms give against the other's share of an absent term, and that of two absent terms for all."""
    share = lambda c: F.expr(f"if(v = 0, 0L, 1L + ((cast(1000000000 as decimal(38, 0)) * ({c} + 2)) div (n + 2 * v)))")
    zero = totals.select("lang", "source", "v", "n", share("0").alias("z"))
    counts = found.where("part = 'counts'").groupBy("lang", "source", "c").agg(F.sum("value").alias("terms"))
    counts = counts.join(zero, ["lang", "source"]).withColumn("p", share("c")).select("lang", "source", "z", "p", "terms")
    other = zero.select("lang", F.col("source").alias("item"), F.col("z").alias("oz"))
    own = counts.join(other, "lang").where("source != item").select("lang", "source", "item", (F.col("terms") * (_far("p", "oz") - _far("z", "oz"))).alias("value"))
    both = found.where("part = 'pair'").select("lang", "source", "item", "value")
    base = zero.join(other, "lang").where("source != item").select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * _far("z", "oz")).otherwise(0).alias("value"))
    turned = lambda d: d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = base.unionAll(both).unionAll(turned(both)).unionAll(own).unionAll(turned(own)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = found.where("part = 'term'").select("lang", "source", "item", "value").withColumn("rank", rank).where(F.col("rank") <= top)
    made = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return made.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence audit of all `documents`: see divergence()."""
    return divergence(table(spark, sf_dir, "documents"))


# Dense: every group has a cell for every kept term.
OP11_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS MATERIALIZED (SELECT row, lang, source, unnest(regexp_extract_all({_LOWER.format("text")}, '{TERM}')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS lc FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 10),
lv AS (SELECT lang, count(*) AS v, sum(lc) AS ln FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
cell AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {_SHARE.format("coalesce(c.c, 0)", "g.n", "lv.v")} AS p, {_SHARE.format("k.lc", "lv.ln", "lv.v")} AS q
  FROM gn g JOIN k ON g.lang = k.lang JOIN lv ON g.lang = lv.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum({_FAR.format("a.p", "b.p")}) AS value FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, {_FAR.format("p", "q")}::BIGINT FROM cell WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o QUALIFY part = 'pair' OR rank <= 10"""
