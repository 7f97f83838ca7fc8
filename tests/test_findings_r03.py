"""Cases of the findings of round 3."""

import tracemalloc

import numpy as np

from redactlake.operators import clustering


def by_pairs(start, end, sums, overlap, threshold):
    """The definition, with all pairs looked at before each merge."""
    groups = {k: [k] for k in range(len(sums))}
    direction = lambda g: (lambda s: s / np.linalg.norm(s) if np.linalg.norm(s) > 1e-8 else None)(sums[g].sum(axis=0))
    while True:
        best, of = {k: direction(g) for k, g in groups.items()}, []
        for i in groups:
            for j in groups:
                free = all(min(end[a], end[b]) - max(start[a], start[b]) <= overlap for a in groups[i] for b in groups[j])
                if i < j and free and best[i] is not None and best[j] is not None:
                    of.append((-round(float(best[i] @ best[j]), 12), i, j))
        if not of or -min(of)[0] <= threshold:
            return [next(k for k, g in groups.items() if t in g) for t in range(len(sums))]
        _, i, j = min(of)
        groups[i] += groups.pop(j)


def test_clusters_equal_the_definition():
    rng = np.random.default_rng(3)
    for trial in range(12):
        n = int(rng.integers(2, 16))
        v = rng.normal(size=(n, 3))
        v[rng.integers(0, n)] = 0
        v = v[rng.integers(0, n, n)] if trial % 2 else v
        size = np.linalg.norm(v, axis=1, keepdims=True)
        sums = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
        start = rng.integers(0, 3000, n)
        end = start + rng.integers(0, 1500, n)
        for threshold in (-0.5, 0.2, 0.8):
            assert clustering._Clusters(start, end, sums.copy(), 350).run(threshold).tolist() == by_pairs(start, end, sums, 350, threshold)


def test_clusters_of_a_long_recording_hold_no_pairs(monkeypatch):
    monkeypatch.setattr(clustering, "_CELLS", 10_000)
    n = 1200
    v = np.random.default_rng(4).normal(size=(n, 8))
    start = np.arange(n) * 1000
    tracemalloc.start()
    member = clustering._Clusters(start, start + 1500, v / np.linalg.norm(v, axis=1, keepdims=True), 350).run(0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * n and 1 < len(set(member.tolist())) < n  # all pairs took 9 bytes each


def test_points_of_time_are_found_once_without_a_table_of_them(spark):
    from redactlake.operators import intervals

    points = spark.createDataFrame([(1, 0), (1, 0), (1, 400), (1, 400), (1, None), (1, None), (None, 400), (None, 400)], "video_id int, time_ms bigint")
    seen = spark.createDataFrame([(1, 400, 7), (1, 300, 5), (1, 900, 9)], "video_id int, time_ms bigint, x int")
    rows = intervals.nearest(points, seen, "video_id", ["x"])
    assert sorted(((r["video_id"], r["time_ms"], r["nearest"] and r["nearest"]["x"]) for r in rows.collect()), key=str) == sorted([(1, 0, 5), (1, 400, 7), (1, None, 5), (None, 400, None)], key=str)
    assert "HashAggregate" not in rows._jdf.queryExecution().executedPlan().toString()


def test_frames_are_made_in_many_parts(spark, tmp_path):
    from redactlake.sources import adapters

    spark.sql("select id as event_id, id % 40 as user_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as ts from range(4000)").write.parquet(f"{tmp_path}/events.parquet")
    frames = adapters.frames(spark, str(tmp_path), 4)
    assert frames.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert frames.count() == frames.distinct().count()


def test_personal_data_queries_equal_their_sql(spark, tmp_path):
    from collections import Counter

    import duckdb

    from redactlake.plans import registry

    texts = [
        "a 4387393285946913 +1 (438) 555-5817 b", "16.56.229.89 +1 (569) 555-5108", "a@b.com c@d.org e@f.net", "1.2.3.4 5.6.7.8, 9.9.9.9", "1.2.3.4.5.6.7.8", "٣1.2.3.4 ٣٣٣٣٣٣٣٣٣", "²+1 234 567 890", "+1 234\v567 890 12",
        "1.2.3\n.4 ", "12345678\n", "x@y.com\n", "sk-abcdefgh12 CUST-1234 http://10.0.0.1/x 12345678", "é12345678", "", None, "a@b.com\nc@d.org", "999.1.1.1 10.0.0.1", "..@..com",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("pii_email_scan", "pii_ipv4_scan", "pii_phone_scan", "pii_type_counts", "pii_masked_preview"):
        got = Counter(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == Counter(db.execute(registry.ORACLE_SQL[name]).fetchall()), name


def test_the_least_sureness_comes_from_all_held_out_rows(spark):
    import zlib

    from redactlake.llm import language

    held = [k for k in range(40_000) if zlib.crc32(str(k).encode()) % 3 == 1][:6000]
    doubt = set(held[-90:])  # 1.5 % of all are unsure
    docs = spark.createDataFrame([(k, "en", "b" if k in doubt else "a") for k in held], "doc_id bigint, lang string, text string")
    seen = spark.sparkContext.accumulator(0)

    def sureness(net, labels):
        def of():
            def score(texts):
                seen.add(len(texts))
                return np.array([0.25 if t == "b" else 0.75 for t in texts])

            return score

        return of

    before, language._sureness = language._sureness, sureness
    try:
        assert language.least_sure(docs, None, ["en"]) == language.LOW * 0.25 and seen.value == len(held)
    finally:
        language._sureness = before
    assert language._quantile([(1, 1), (3, 1)], 0.5) == 2 and language._quantile([(5, 1)], 0.01) == 5


def test_answers_are_parsed_once(spark):
    from redactlake.functions import jsonx

    rows = spark.createDataFrame([(1, 5.0, '[{"type":"x","value":"v"}]')], "id int, clip_duration_seconds double, raw_text string")
    found = jsonx.parse_findings(rows)
    assert found.count() == 1 and found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
