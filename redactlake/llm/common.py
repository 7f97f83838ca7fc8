"""What the operators of this subpackage share: reading tables, saved intermediate tables, text defaults."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SPREAD = "spark.sql.adaptive.coalescePartitions.parallelismFirst"

#: ASCII white space, as bytes.split() has it.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session, as in tests, may leave it unset: it gets a new local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str, by_size: bool = False) -> DataFrame:
    """The same rows from a table in the shared folder: lineage ends there, and lost executors lose nothing. The shuffle files of the write go with its end, as nothing reads them again. `by_size`: small shuffle partitions are put together up to Spark's advisory size, so that a small table isn't many tiny files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    wanted = {_CLEANUP: "true"} | ({_SPREAD: "false"} if by_size else {})
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    found = spark.read.schema(df.schema).parquet(path)
    found.saved_at = path
    return found


def sorted_join(df: DataFrame) -> DataFrame:
    """The same rows; a join with them shuffles and sorts both sides. For what an explode makes: Spark takes its rows for as many as before it, and would broadcast them."""
    return df.hint("merge")


def sized(table: DataFrame, most: int = 250_000) -> DataFrame:
    """A saved table, whose join may be a broadcast if it was counted to have `most` rows at most: the files, by which Spark goes, can be many times smaller than the rows in memory."""
    if table.count() <= most:
        return table
    found = sorted_join(table)
    found.saved_at = table.saved_at
    return found


def forget(*tables: DataFrame) -> None:
    """Deletes saved tables, once all that is made of them is saved itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_batches(rows: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], dict]], keep: tuple[str, ...], added: str) -> DataFrame:
    """The columns `keep` of every row, untouched (ids never become floating-point numbers), beside the columns `added` (as in a
    DDL string) that a function of a batch returns; `start` makes that function, once for each task."""
    fields = to_arrow_schema(StructType.fromDDL(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for b in batches:
            if b.num_rows:
                out = work(b)
                yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(out[f.name], f.type) for f in fields], names=[*keep, *fields.names])

    return rows.mapInArrow(run, StructType([rows.schema[c] for c in keep] + StructType.fromDDL(added).fields))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def row_keys(*cols: str) -> list[Column]:
    """128 bits that tell rows with different values in `cols` apart, null ids too."""
    return [F.xxhash64(F.lit(n), *cols) for n in (1, 2)]


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(col, UPPER, LOWER)
