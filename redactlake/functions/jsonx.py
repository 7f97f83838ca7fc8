"""Findings and assessments from what a model has answered: JSON with fences, prose and cuts around it."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake.functions.text import classification, quality, reason_codes
from redactlake.schemas import MODEL_FINDING

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.IGNORECASE | re.DOTALL)
_ECHOES = {"exact sensitive value", "exact sensitive value or concise description"}
_ITEM = "array<struct<type:string,value:string,modality:string,start_seconds:double,end_seconds:double,confidence:double,reason:string,visual_location:string>>"


def first_json(text: str | None):
    """The first object or array that can be decoded whole, whatever stands around it; None if there is none."""
    body = (text or "").strip()
    if fenced := _FENCE.search(body):
        body = fenced.group(1).strip()
    decoder = json.JSONDecoder()
    for at in (m.start() for m in re.finditer(r"[\[{]", body)):
        try:
            return decoder.raw_decode(body, at)[0]
        except ValueError:
            continue
    return None


def _items(payload) -> list[dict]:
    if isinstance(payload, dict):
        inner = payload.get("findings")
        payload = inner if isinstance(inner, list) else [payload] if {"type", "value"} <= payload.keys() else []
    return [x for x in payload or [] if isinstance(x, dict)]


def _float(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def _time(x) -> float | None:
    """A number; what is none counts as 0."""
    v = _float(x)
    return 0.0 if v is not None and math.isnan(v) else v


def _raw(item: dict) -> dict:
    text = lambda k, other: str(item.get(k, other)).strip()
    place = item.get("visual_location")
    return {"type": text("type", "other").lower(), "value": text("value", ""), "modality": text("modality", "visual").lower(), "start_seconds": _time(item.get("start_seconds")), "end_seconds": _time(item.get("end_seconds")), "confidence": _time(item.get("confidence")), "reason": text("reason", ""), "visual_location": None if place is None else str(place).strip()}



def raw_findings(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [_raw(x) for x in _items(first_json(t))])


def times(start: Column, end: Column, duration: Column) -> tuple[Column, Column]:
    """Within [0, duration]; the whole of it if nothing is left between the two."""
    whole = F.greatest(F.lit(0.0), duration)
    clean = lambda c, other: F.when(c.isNull(), other).when(F.isnan(c), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(c, whole)))
    s, e = clean(start, F.lit(0.0)), clean(end, whole)
    return F.when(e <= s, F.lit(0.0)).otherwise(s), F.when(e <= s, whole).otherwise(e)


def parse_findings(responses: DataFrame) -> DataFrame:
    """responses: keys, clip_duration_seconds, raw_text. One row a finding, with its place `n` in the answer; answers without JSON give none."""
    # Nondeterministic, or the filter that Spark derives of the explode would parse all answers once more.
    rows = responses.withColumn("_found", F.pandas_udf(raw_findings, _ITEM).asNondeterministic()("raw_text")).select("*", F.posexplode("_found").alias("n", "_f")).drop("_found", "raw_text")
    f = F.col("_f")
    rows = rows.where((f["value"] != "") & ~f["type"].contains("|") & ~F.lower(f["value"]).isin(*_ECHOES))
    start, end = times(f["start_seconds"], f["end_seconds"], F.col("clip_duration_seconds"))
    sure = F.when(f["confidence"].isNull(), 0.5).when(F.isnan(f["confidence"]), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), f["confidence"])))
    fields = {"type": F.when(f["type"] == "", "other").otherwise(f["type"]), "value": f["value"], "modality": F.when(f["modality"].isin("visual", "audio", "both"), f["modality"]).otherwise("visual"), "start_seconds": start, "end_seconds": end, "confidence": sure, "reason": f["reason"], "visual_location": f["visual_location"]}
    assert list(fields) == [p.split()[0] for p in MODEL_FINDING.split(", ")]
    return rows.select(*(c for c in rows.columns if c not in ("_f", "clip_duration_seconds")), *(v.alias(k) for k, v in fields.items()))


_ASSESSED = "struct<items:array<struct<index:int,classification:string,confidence:double,quality:string,reason_codes:array<string>>>,codes:array<string>>"


def _object(text: str | None) -> dict:
    """The whole text, or what lies between its first and last brace, as an object."""
    body = (text or "").strip()
    if fenced := _FENCE.search(body):
        body = fenced.group(1).strip()
    for part in (body, body[body.find("{") : body.rfind("}") + 1]):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return {}


def _assessment(item: dict, n: int, most: int) -> dict | None:
    index, sure = _float(item.get("index", n)), _float(item.get("confidence", 0.0))
    if index is None or sure is None or not math.isfinite(index) or not math.isfinite(sure):
        return None
    codes = item.get("reason_codes", [])
    return {"index": max(1, min(max(1, most), round(index))), "classification": str(item.get("classification") or "uncertain"), "confidence": min(1.0, max(0.0, sure)), "quality": str(item.get("quality") or "poor"), "reason_codes": [str(c) for c in codes] if isinstance(codes, list) else []}



def raw_assessments(texts: pd.Series, most: pd.Series) -> pd.DataFrame:
    out = []
    for t, m in zip(texts, most, strict=True):
        payload = _object(t)
        listed = payload.get("timestamps", payload.get("per_timestamp", []))
        items = [a for n, x in enumerate(listed if isinstance(listed, list) else [], 1) if isinstance(x, dict) and (a := _assessment(x, n, m))]
        if not items and "classification" in payload and (a := _assessment({**payload, "index": 1}, 1, 1)):
            items = [a]
        codes = payload.get("overall_reason_codes", [])
        out.append({"items": items, "codes": [str(c) for c in codes] if isinstance(codes, list) else []})
    return pd.DataFrame(out, columns=["items", "codes"])


def parse_assessments(rows: DataFrame, text: str, count: str) -> DataFrame:
    """One row an assessment: index, classification, confidence, quality, reason_codes, with `ord` its place in the answer."""
    found = rows.withColumn("_a", F.pandas_udf(raw_assessments, _ASSESSED)(F.col(text), F.col(count)))
    each = found.select(*(c for c in rows.columns if c not in (text, count)), F.posexplode("_a.items").alias("ord", "_i"))
    i = F.col("_i")
    return each.select(*(c for c in each.columns if c != "_i"), i["index"].alias("index"), classification(i["classification"]).alias("classification"), i["confidence"].alias("confidence"), quality(i["quality"]).alias("quality"), reason_codes(i["reason_codes"]).alias("reason_codes"))


def message_text(content: Column) -> Column:
    """A message's text: itself, or the text parts of a JSON list, one a line; null if the list has none."""
    parts = F.filter(F.from_json(content, "array<struct<type:string,text:string>>"), lambda p: p["text"].isNotNull())
    return F.when(F.ltrim(content).startswith("["), F.when(F.size(parts) > 0, F.concat_ws("\n", F.transform(parts, lambda p: p["text"])))).otherwise(content)
