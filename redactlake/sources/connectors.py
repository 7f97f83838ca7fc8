"""What reads and writes: annotations, manifests, logs, media files by suffix, data URIs; and hooks for models that make tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake import schemas

MEDIA = {"video": ("mp4", "mov", "m4v"), "image": ("jpg", "jpeg", "png", "webp")}
_MIME = {"mp4": "video/mp4", "mov": "video/quicktime", "m4v": "video/mp4", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "wav": "audio/wav"}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=schemas.MANIFEST, header=True)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row a face: filename, frame, subject, x, y, width, height."""
    rows = spark.read.schema(schemas.ANNOTATIONS).json(path, multiLine=True)
    faces = rows.select("filename", F.explode("frames").alias("f")).select("filename", F.col("f.frame").alias("frame"), F.explode("f.faces").alias("a"))
    return faces.select("filename", "frame", "a.subject", *(F.col("a.box")[k].alias(c) for k, c in enumerate(("x", "y", "width", "height"))))


def events(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    return spark.read.schema(schemas.EVENT).json(path).where(F.col("event").startswith(prefix))


def media(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Files with a suffix of the kind, in any case."""
    suffix = F.lower(F.substring_index("path", ".", -1))
    return spark.read.format("binaryFile").load(path).where(suffix.isin(*MEDIA[kind]))


def to_data_uri(content: Column, suffix: Column) -> Column:
    mime = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in _MIME.items() for x in kv)), F.lower(suffix)), F.lit("application/octet-stream"))
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def from_data_uri(uri: Column, most: int = 200 << 20) -> Column:
    """The bytes; null if it is no base64 data URI or larger than `most`."""
    body = F.substring_index(uri, ",", -1)
    return F.when(uri.rlike("^data:[^,]*;base64,") & (F.length(body) / 4 * 3 <= most), F.unbase64(body))


_HOOKS: dict[tuple[str, str], Callable[..., DataFrame]] = {}


def register(kind: str, name: str, make: Callable[..., DataFrame]) -> None:
    """kind: detector, matcher, age_estimator or clip_analyzer. `make` gets a session and options, and returns the table of that kind."""
    if kind not in {"detector", "matcher", "age_estimator", "clip_analyzer"}:
        raise ValueError(f"unknown kind {kind!r}")
    _HOOKS[kind, name] = make


def connect(spark: SparkSession, kind: str, name: str, **options) -> DataFrame:
    if (kind, name) not in _HOOKS:
        raise ValueError(f"no {kind} named {name!r}")
    return _HOOKS[kind, name](spark, **options)


def mock_answers(spark: SparkSession, videos: DataFrame, chunks: int = 4) -> DataFrame:
    """Fixed answers for the first three chunks of each recording, none after them."""
    texts = {0: '[{"type":"api_key","value":"sk-demo-0001-0002","modality":"visual","start_seconds":0,"end_seconds":5,"confidence":0.9,"reason":"shown"}]', 1: '[{"type":"email","value":"alice@example.com","modality":"both","start_seconds":0,"end_seconds":5,"confidence":0.9,"reason":"shown and spoken"}]', 2: '[{"type":"account_id","value":"CUST-493821","modality":"both","start_seconds":0,"end_seconds":4.8,"confidence":0.9,"reason":"shown and spoken"}]'}
    answers = spark.createDataFrame([(k, 5.0, texts.get(k, "[]")) for k in range(chunks)], "chunk_index bigint, clip_duration_seconds double, raw_text string")
    return videos.select("video_id").crossJoin(F.broadcast(answers))  # a few fixed rows


register("clip_analyzer", "mock", lambda spark, videos, chunks=4: mock_answers(spark, videos, chunks))
