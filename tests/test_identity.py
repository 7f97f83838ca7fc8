import json

import pytest
from pyspark.sql import functions as F

from redactlake import config
from redactlake.operators import clustering, policy, report
from redactlake.plans.engine import Engine
from redactlake.sources import connectors

_P = "video_id int, track_id bigint, start_ms bigint, end_ms bigint, quality_score double, embedding array<float>"


def clusters(spark, rows, threshold=0.8):
    return {r["track_id"]: r["cluster"] for r in clustering.cluster(spark.createDataFrame(rows, _P), threshold).collect()}


def test_clusters(spark):
    assert clusters(spark, [(1, 1, 0, 1000, 0.9, [1.0, 0.0]), (1, 2, 1200, 2200, 0.8, [0.99, 0.05]), (1, 3, 200, 1800, 0.7, [0.0, 1.0])]) == {1: 1, 2: 1, 3: 2}
    assert len(set(clusters(spark, [(1, 1, 0, 2000, 0.9, [1.0, 0.0]), (1, 2, 200, 1800, 0.8, [0.99, 0.05])]).values())) == 2
    assert len(set(clusters(spark, [(1, 1, 0, 1000, 0.9, [1.0, 0.0]), (1, 2, 650, 1800, 0.8, [0.99, 0.05])]).values())) == 1  # 350 ms together are allowed
    assert len(set(clusters(spark, [(1, 1, 0, 10, 0.9, None), (1, 2, 20, 30, 0.8, None)]).values())) == 2


@pytest.mark.parametrize(("action", "chosen", "photo", "matched", "blurred"), [("blur_selected", [1, 3], "blur", [], {1, 3}), ("keep_selected_visible", [2], "blur", [], {1, 3}), ("blur_selected", [1], "blur", [2], {1, 2}), ("blur_selected", [1, 2], "keep_visible", [2], {1})])
def test_selection(spark, action, chosen, photo, matched, blurred):
    of = lambda xs: spark.createDataFrame([(x,) for x in xs], "person_id int")
    assert {r[0] for r in policy.blur_set(of([1, 2, 3]), of(chosen), of(matched), action, photo).collect()} == blurred


def decided(spark, votes, **more):
    rows = spark.createDataFrame([(1, c, q, s, r) for c, q, s, r in votes], "track_id int, classification string, quality string, confidence double, reason_codes array<string>")
    r = policy.consensus(rows, **more).first()
    return r["category"], r["reason"], r["blur"]


def test_consensus(spark):
    child, adult = ("child", "good", 0.9, ["childlike_face"]), ("adult", "good", 0.9, ["mature_face"])
    assert decided(spark, [child] * 3 + [("uncertain", "good", 0.9, [])]) == ("likely_minor", "multi_timestamp_child_consensus", True)
    assert decided(spark, [adult] * 3) == ("likely_adult", "multi_timestamp_adult_consensus", False)
    assert decided(spark, [child, child, adult]) == ("uncertain", "conflicting_child_adult_votes", False)
    assert decided(spark, [("child", "good", 0.9, [])] * 3) == ("uncertain", "insufficient_consensus", False)
    assert decided(spark, [("child", "limited", 0.9, ["childlike_face"])] * 3, blur_uncertain=True) == ("uncertain", "insufficient_usable_timestamps", True)
    assert decided(spark, [("child", "good", 0.9, ["small_face", "childlike_face"])] * 3)[0] == "uncertain"
    assert decided(spark, [("child", "good", 0.9, ["small_face", "childlike_body_proportions"])] * 3)[0] == "likely_minor"


def test_modes_and_settings():
    assert [config.face_mode(x) for x in ("off", "blur-all", "children", "Reference")] == ["off", "all", "likely_minors", "reference"]
    with pytest.raises(ValueError):
        config.face_mode("some")
    assert config.overlay(config.Config(), {"max_gap_ms": "700", "unknown": 1}).max_gap_ms == 700
    with pytest.raises(ValueError):
        config.overlay(config.Config(), [1])


def test_no_value_leaks(spark, tmp_path):
    secret = "sk-planted-secret-1234567890"
    rec = report.Recorder("run")
    with rec.stage("scan"):
        rec.emit("found", value=secret, nested={"value": secret, "raw_text": secret}, path=tmp_path, long="x" * 600)
    rec.write(spark, str(tmp_path / "log"))
    logged = "".join(p.read_text() for p in (tmp_path / "log").glob("*.json"))
    assert secret not in logged and connectors.events(spark, str(tmp_path / "log"), "scan").count() == 2
    answers = spark.createDataFrame([(1, 0, 5.0, json.dumps([{"type": "api_key", "value": secret}]))], "video_id bigint, chunk_index bigint, clip_duration_seconds double, raw_text string")
    found = Engine().analyze(answers)
    assert found.first()["value"] == secret
    assert secret not in report.reports(found, rec.key).first()["report"]
    assert secret not in str(report.findings_table(found).collect())


def test_connectors(spark, tmp_path):
    (tmp_path / "a.MP4").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    assert connectors.media(spark, str(tmp_path), "video").count() == 1
    uri = spark.createDataFrame([(bytearray(b"\x00\xff"),)], "b binary").select(connectors.to_data_uri(F.col("b"), F.lit("png")).alias("u"))
    assert bytes(uri.select(connectors.from_data_uri(F.col("u"))).first()[0]) == b"\x00\xff"
    videos = spark.createDataFrame([(1,), (2,)], "video_id bigint")
    assert Engine().analyze(connectors.connect(spark, "clip_analyzer", "mock", videos=videos)).count() == 6
    with pytest.raises(ValueError):
        connectors.connect(spark, "detector", "none")


def test_no_key_leaks(spark):
    hidden = "hunter2-planted"
    rec = report.Recorder("run")
    for key in sorted(report.SENSITIVE):
        for k in (key, key.upper()):
            rec.emit("e", **{k: hidden, "nested": {k: [hidden], "deep": [{k: hidden}]}, "more": {k: {"a": hidden}}})
    rec.emit("e", Value=hidden, error=ValueError("x" * 600), password=hidden.encode())
    assert {"audio_url", "messages", "password", "payload", "raw_response", "secret", "token", "video_url", "api_key", "authorization", "prompt", "raw_text"} <= report.SENSITIVE
    logged = str(rec.frame(spark).collect())
    assert hidden not in logged
    last = json.loads(rec.events[-1]["fields"]["error"])
    assert last["type"] == "ValueError" and len(last["message"]) < 540 and json.loads(rec.events[-1]["fields"]["password"]) == {"redacted": True, "bytes": len(hidden)}


def test_switches():
    given = config.overlay(config.Config(), {"include_values": "false", "blur_uncertain": " Yes", "merge_gap_ms": 5, "identity_threshold": "0.5", "face_mode": "Blur-All"})
    assert (given.include_values, given.blur_uncertain, given.merge_gap_ms, given.identity_threshold, given.face_mode) == (False, True, 5, 0.5, "all")
    for bad in ({"include_values": "maybe"}, {"include_values": 1}, {"merge_gap_ms": True}, {"merge_gap_ms": None}, {"face_mode": 3}, {"face_mode": "some"}):
        with pytest.raises(ValueError):
            config.overlay(config.Config(), bad)
