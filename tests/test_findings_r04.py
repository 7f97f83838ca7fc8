"""Cases of the findings of round 4: what an explode makes isn't broadcast, however few rows Spark takes it for."""

import re
from collections import Counter

import pytest

EVENTS = "/root/testdata/sf0.001"


def joins(rows):
    """(join, first keys) of the plan that ran."""
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"(\w+Join)(?:\(\w+=\w+\))? \[([^\]]*)\]", plan)


def on(found, key):
    return {kind for kind, keys in found if key in keys}


@pytest.mark.parametrize("name", ["active_tracks", "interval_join_redactions", "redaction_plan"])
def test_intervals_and_frames_are_not_broadcast(spark, name):
    import duckdb

    from redactlake.plans import registry

    rows = registry.QUERIES[name](spark, EVENTS)
    assert on(joins(rows), "_bucket") == {"SortMergeJoin"}
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{EVENTS}/events.parquet')")
    whole = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert Counter(map(whole, rows.collect())) == Counter(map(whole, db.execute(registry.ORACLE_SQL[name]).fetchall()))


def _near(n):
    """Fingerprints in groups of ten that differ in one bit from the first."""
    return [(g * 0x9E3779B97F4A7C15 % (1 << 63)) ^ (1 << b if b else 0) for g in range(1, n + 1) for b in range(10)]


def test_segment_keys_are_not_broadcast(spark):
    from redactlake.llm import simhash

    fps = _near(30)
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = simhash.links(table)
    assert on(joins(found), "key") == {"SortMergeJoin"}
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}
    assert {tuple(r) for r in found.collect()} == want
    packed = joins(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), hot=3))
    assert "SortMergeJoin" in on(packed, "longer") and on(packed, "middle") == {"SortMergeJoin"}


def test_saved_tables_are_broadcast_only_if_few_rows_were_counted(spark, monkeypatch):
    from redactlake.llm import common, graph, simhash, suffix_dedup

    table = common.saved(spark.range(10), "few")
    for most, kind in ((10, "BroadcastHashJoin"), (9, "SortMergeJoin")):
        sized = common.sized(table, most)
        assert sized.saved_at == table.saved_at and on(joins(spark.range(100).join(sized, "id")), "id") == {kind}
    # With every table too large, groups and texts are the same, and no table in a round, a stage or a result is broadcast.
    rows = [(k, f"word{k // 3} " + " ".join(f"w{k // 3}x{j}" for j in range(60)) + (" end" if k % 3 else "")) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = lambda: (sorted(map(tuple, simhash.near_duplicates(docs).collect())), sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()), sorted(map(tuple, suffix_dedup.remove_repeats(docs, 200).collect())))
    before = of()
    for m in (graph, simhash, suffix_dedup):
        monkeypatch.setattr(m, "sized", lambda t, most=0: common.sized(t, -1))
    assert of() == before
    for made in (simhash.one_of_each(docs), suffix_dedup.remove_repeats(docs, 200)):
        assert {kind for kind, _ in joins(made)} == {"SortMergeJoin"}
