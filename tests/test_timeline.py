import random

from pyspark.sql import functions as F

from redactlake.operators import intervals as I
from redactlake.operators import sampling, scenes, tracking
from redactlake.streaming import streams

_F = "video_id bigint, ord bigint, type string, value string, modality string, start_ms bigint, end_ms bigint, confidence double, reason string, source string"


def merged(rows, gap=1200):
    out = []
    for r in sorted(rows, key=lambda r: (r[5], r[6], r[1])):
        near = [c for c in out if c["key"] == (r[0], r[2].lower(), r[3]) and r[5] <= c["end"] + gap]
        if near:
            c = near[-1]
            c.update(end=max(c["end"], r[6]), n=c["n"] + 1, modality=c["modality"] if c["modality"] == r[4] else "both", sources=c["sources"] | {r[9]})
            if r[8] and r[8] not in c["reason"]:
                c["reason"] = f"{c['reason']}; {r[8]}" if c["reason"] else r[8]
        else:
            out.append({"key": (r[0], r[2].lower(), r[3]), "start": r[5], "end": r[6], "n": 1, "modality": r[4], "sources": {r[9]}, "reason": r[8]})
    return sorted((*c["key"], c["start"], c["end"], c["n"], c["modality"], ",".join(sorted(c["sources"])), c["reason"]) for c in out)


def test_merge_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 3), k, rng.choice(["a", "A", "b"]), rng.choice(["x", "y"]), rng.choice(["visual", "audio"]), s := rng.randint(0, 20_000), s + rng.randint(0, 1500), 0.5, rng.choice(["", "r1", "r12"]), rng.choice("pq")) for k in range(300)]
    rows += [(9, 1000, "a", "x", "visual", 0, 100, 0.5, "", "p"), (9, 1001, "a", "x", "visual", 1300, 1400, 0.5, "", "p"), (9, 1002, "a", "x", "visual", 2601, 2700, 0.5, "", "p")]
    got = I.merge_findings(spark.createDataFrame(rows, _F)).collect()
    assert sorted((r["video_id"], r["type"].lower(), r["value"], r["start_ms"], r["end_ms"], r["n"], r["modality"], ",".join(r["sources"]), r["reason"]) for r in got) == merged(rows)


def test_both_kinds_merge(spark):
    rows = [(1, 1, "email", "a@b", "both", 5000, 10000, 0.9, "m", "model"), (1, 2, "email", "A@b", "visual", 5100, 9900, 0.99, "t", "text_pattern")]
    r = I.merge_findings(spark.createDataFrame(rows, _F)).collect()
    assert [(x["modality"], x["action"], x["sources"], x["confidence"], x["reason"]) for x in r] == [("both", "blur_and_mute", ["model", "text_pattern"], 0.99, "m; t")]
    assert I.merge_findings(spark.createDataFrame([], _F)).count() == 0


def test_interpolation(spark):
    obs = spark.createDataFrame([(1, 0, 100, 50, 80, 100, 0.9), (1, 1000, 200, 100, 100, 120, 1.0)], "video_id bigint, time_ms bigint, x int, y int, width int, height int, confidence double")
    at = spark.createDataFrame([(1, t) for t in (-5, 0, 500, 1000, 2000)] + [(2, 5)], "video_id bigint, time_ms bigint")
    got = {r["time_ms"]: (r["x"], r["y"], r["width"], r["height"]) for r in I.interpolate(at, obs).collect()}
    assert got == {-5: (100, 50, 80, 100), 0: (100, 50, 80, 100), 500: (150, 75, 90, 110), 1000: (200, 100, 100, 120), 2000: (200, 100, 100, 120)}


def test_range_join_against_pairs(spark):
    rng = random.Random(5)
    points = [(rng.randint(1, 2), rng.randint(0, 5000)) for _ in range(200)]
    spans = [(rng.randint(1, 2), s := rng.randint(0, 5000), s + rng.randint(-50, 900), k) for k in range(80)]
    got = I.interval_join(spark.createDataFrame(points, "v int, t bigint"), spark.createDataFrame(spans, "v int, s bigint, e bigint, k int"), "v", "t", "s", "e", 250)
    assert sorted((r["v"], r["t"], r["k"]) for r in got.collect()) == sorted((v, t, k) for v, t in points for w, s, e, k in spans if v == w and s <= t <= e)


def boxes(*frames):
    t = tracking.Tracker()
    return [t.update(time, list(b)) for time, b in frames]


def test_tracker():
    assert boxes((0, [(100, 100, 80, 80)]), (200, [(110, 100, 80, 80)]), (400, [(120, 100, 80, 80)])) == [[1], [1], [1]]
    assert boxes((0, [(100, 100, 80, 80), (600, 300, 80, 80)]), (200, [(605, 300, 80, 80), (105, 100, 80, 80)])) == [[1, 2], [2, 1]]
    assert boxes((0, [(641, 100, 80, 80)]), (200, [(537, 100, 80, 80)])) == [[1], [2]]
    assert boxes((0, [(0, 0, 50, 50)]), (900, [(0, 0, 50, 50)]), (1801, [(0, 0, 50, 50)])) == [[1], [1], [2]]
    t = tracking.Tracker()
    assert (t.update(0, [(0, 0, 50, 50)]), t.update(200, [(0, 0, 50, 50)]), t.new_scene(400), t.update(400, [(0, 0, 50, 50)])) == ([1], [1], None, [2])


def test_tracks_and_acceptance(spark):
    rows = [(1, t, t, 100 + t // 10, 100, 80, 80, 0.8) for t in range(0, 1000, 200)] + [(1, 5000, 5000, 0, 0, 40, 40, 0.7), (1, 9000, 9000, 0, 0, 40, 40, 0.95)]
    tracks = tracking.track(spark.createDataFrame(rows, "video_id bigint, time_ms bigint, det_ord bigint, x int, y int, width int, height int, confidence double"))
    assert sorted((r["track_number"], r["n"]) for r in tracking.accepted(tracks).collect()) == [(1, 5), (3, 1)]


def test_spacing(spark):
    rows = [(1, t, k, 10, 10, c) for k, (t, c) in enumerate([(0, 0.9), (349, 0.99), (350, 0.8), (699, 0.5), (1050, 0.1)])]
    df = spark.createDataFrame(rows, "video_id bigint, time_ms bigint, det_ord bigint, width int, height int, confidence double")
    assert [r["time_ms"] for r in sampling.spaced_top(df, ["video_id"]).orderBy("time_ms").collect()] == [349, 699, 1050]


def test_streams(spark, tmp_path):
    rows = [(1, t, t, 100, 100, 80, 80) for t in range(0, 1000, 200)]
    df = spark.createDataFrame(rows, "video_id bigint, time_ms bigint, det_ord bigint, x int, y int, width int, height int")
    for k in range(2):
        df.where(F.floor(F.col("time_ms") / 500) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.tracks(stream).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["time_ms"], r["track_number"]) for r in spark.table("tracked").orderBy("time_ms").collect()] == [(t, 1) for t in range(0, 1000, 200)]


def test_sessions_of_codes(spark):
    from redactlake.operators.codes import general_sessions

    hit = lambda t, o, value, x: (1, "qr_code", value, value.lower().replace(" ", ""), t, o, x, 0, 10, 10, 0.98)
    rows = [hit(0, 0, "QR code", 0), hit(0, 1, "QR code", 100), hit(350, 2, "QR code", 2), hit(350, 3, "abc", 300), hit(350, 4, "abc", 500), hit(1700, 5, "abc", 700), hit(3052, 6, "abc", 700)]
    df = spark.createDataFrame(rows, "video_id bigint, type string, value string, key string, time_ms bigint, ord bigint, x int, y int, width int, height int, confidence double")
    got = sorted((r["value"], r["start_ms"], r["end_ms"], r["n_hits"]) for r in general_sessions(df).collect())
    assert got == [("QR code 1", 0, 650, 2), ("QR code 2", 0, 300, 1), ("abc", 50, 650, 1), ("abc", 50, 2000, 2), ("abc", 2752, 3352, 1)]


def test_message_texts(spark):
    from redactlake.functions.jsonx import message_text

    rows = spark.createDataFrame([("plain",), ('[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]',), ("[]",), (None,)], "c string")
    assert [r[0] for r in rows.select(message_text(F.col("c"))).collect()] == ["plain", "a\nb", None, None]


def test_tracks_do_not_depend_on_the_parts(spark):
    rng = random.Random(8)
    rows, t = [], 0
    for k in range(400):
        t += rng.choice([100, 200, 400, 901, 2000])
        rows += [(k % 2, t, 2 * k + j, rng.randint(0, 60), rng.randint(0, 60), 40, 40 + rng.randint(0, 9), 0.5 + rng.random() / 2) for j in range(2)]
    df = spark.createDataFrame(rows, "video_id bigint, time_ms bigint, det_ord bigint, x int, y int, width int, height int, confidence double")
    want, number = {}, {}
    for v in (0, 1):  # one pass over a recording, frame by frame
        state, own = tracking.Tracker(), sorted((r for r in rows if r[0] == v), key=lambda r: (r[1], r[2]))
        for time in sorted({r[1] for r in own}):
            frame = [r for r in own if r[1] == time]
            want.update(((v, r[2]), n) for r, n in zip(frame, state.update(time, [r[3:7] for r in frame]), strict=True))
    for part in (20_000, 7, 1):
        got = tracking.track(df, part_rows=part)
        assert {(r["video_id"], r["det_ord"]): r["track_number"] for r in got.collect()} == want
    for (v, _), n in want.items():
        number.setdefault((v, n), []).append(1)
    kept = tracking.only_accepted(got).select("video_id", "track_number").distinct()
    assert {tuple(r) for r in kept.collect()} == {(r["video_id"], r["track_number"]) for r in tracking.accepted(got).collect()}
    assert tracking.track(df.limit(0)).count() == 0


def test_probe_and_lines(spark):
    from redactlake.operators import tokens

    videos = spark.createDataFrame([(1, 24.0, 100, 640, 480), (2, 0.0, 100, 640, 480), (3, 24.0, 100, 0, 480), (4, None, 100, 640, 480), (5, 29.97, 300, 640, -1)], "id int, fps double, frame_count bigint, width int, height int")
    assert [(r["id"], r["duration_ms"]) for r in I.probe(videos).collect()] == [(1, 4166)]
    read = [(1, 0, 1, 1, 1, 0, 50, 0, 9, 9, 90.0, "world"), (1, 0, 1, 1, 1, 1, 10, 0, 9, 9, 20.0, " hello "), (1, 0, 1, 1, 1, 2, 5, 0, 9, 9, 19.9, "dim"), (1, 0, 1, 1, 2, 3, 5, 0, 9, 9, 95.0, "  "), (1, 0, 1, 1, 3, 4, 5, 0, 9, 9, None, "unsure")]
    df = spark.createDataFrame(read, "video_id int, time_ms int, block int, par int, line int, ord int, x int, y int, width int, height int, conf double, text string")
    got = tokens.lines(df).collect()
    assert [(r["line"], r["text"], [tuple(s) for s in r["spans"]]) for r in got] == [(1, "hello world", [(0, 5), (6, 11)])]
    frames = spark.createDataFrame([(1, 350 * k, ["a", "jane", "doe"] if k in (0, 3, 4) else ["other"]) for k in range(8)], "video_id int, time_ms bigint, tokens array<string>")
    found = spark.createDataFrame([(1, 7, "Jane Doe", 700, 700, 5000), (1, 8, "no", 700, 700, 5000)], "video_id int, id int, value string, start_ms bigint, end_ms bigint, duration_ms bigint")
    assert sorted((r["id"], r["time_ms"], r["places"]) for r in tokens.localize(found, frames).collect()) == [(7, 0, [1, 2]), (7, 1050, [1, 2]), (7, 1400, [1, 2])]


def test_redaction_plan(spark):
    rows = [(1, 1, "face", "p", "visual", 0, 1000, 0.9, "", "m"), (1, 2, "face", "P", "audio", 1500, 2000, 0.9, "", "m"), (1, 3, "email", "a@b", "visual", 0, 500, 0.9, "", "m")]
    found = spark.createDataFrame(rows, _F)
    boxes = spark.createDataFrame([(1, 1, 0, 100, 50, 80, 100, 0.9), (1, 1, 0, 100, 50, 80, 100, 0.95), (1, 2, 1000, 200, 100, 100, 120, 1.0)], "video_id bigint, ord bigint, time_ms bigint, x int, y int, width int, height int, confidence double")
    merged_boxes = I.merge_observations(found, boxes)
    assert merged_boxes.count() == 2 and merged_boxes.select("id").distinct().count() == 1
    frames = spark.createDataFrame([(1, t) for t in (0, 500, 2000, 2500)], "video_id bigint, time_ms bigint")
    got = sorted(tuple(r)[1:2] + tuple(r)[3:] for r in I.redaction_plan(frames, I.merge_findings(found), merged_boxes, 250, 230).collect())
    assert got == [(0, "face", 82, 32, 198, 168), (500, "face", 131, 56, 250, 204), (2000, "face", 179, 79, 250, 230)]


def cuts_plainly(rows):
    out, last = [], {}
    for video, time, change in sorted(set(r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (str(r[0]), r[1])):
        if change >= 38 and (video not in last or time - last[video] >= 800):
            out.append((video, time))
            last[video] = time
    return sorted(out, key=str)


def test_scene_cuts(spark):
    rng = random.Random(4)
    rows = [(v, rng.randrange(60_000) // 50 * 50, rng.choice([10.0, 37.99, 38.0, 90.0, None])) for v in (1, 2, None) for _ in range(400)] + [(3, t, 50.0) for t in range(0, 100_000, 200)] + [(4, 0, 99.0), (4, 799, 99.0), (4, 800, 99.0), (4, None, 99.0), (5, 7, 1.0)]
    df = spark.createDataFrame(rows + rows[:9], "video_id long, time_ms long, change double").withColumn("jump", F.lit(1))
    assert sorted(((r["video_id"], r["time_ms"]) for r in scenes.scene_cuts(df).collect()), key=str) == cuts_plainly(rows)
    assert scenes.scene_cuts(df.limit(0)).count() == 0


def test_tracks_end_at_scene_cuts(spark):
    still = [(1, t, n, 10, 10, 50, 50, 0.9) for n, t in enumerate(range(0, 4000, 200))]
    boxes = spark.createDataFrame(still, "video_id long, time_ms long, det_ord long, x int, y int, width int, height int, confidence double")
    assert {r["track_number"] for r in tracking.track(boxes).collect()} == {1}
    cuts = scenes.scene_cuts(spark.createDataFrame([(1, 900, 60.0), (1, 1500, 60.0), (1, 2400, 40.0)], "video_id long, time_ms long, change double"))
    found = tracking.track(scenes.with_cuts(boxes, cuts), cuts="is_cut").collect()
    assert {r["time_ms"]: r["track_number"] for r in found} == {t: 1 + (t >= 900) + (t >= 2400) for t in range(0, 4000, 200)}


def test_merge_of_unknown_modalities(spark):
    rows = [(1, k, "email", "a", None, k * 10, k * 10 + 5, 0.5, None, "s") for k in range(2)]
    found = I.merge_findings(spark.createDataFrame(rows, "video_id long, ord long, type string, value string, modality string, start_ms long, end_ms long, confidence double, reason string, source string")).collect()
    assert [(r["modality"], r["action"], r["n"]) for r in found] == [("", "blur", 2)]
