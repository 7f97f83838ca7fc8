"""The pattern scan of read tokens, and sessions of its hits, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from redactlake.functions import spans as X
from redactlake.operators import codes, tokens

RNG = random.Random(4)
WORDS = ["mail", "alice@example.com", "bob", "@", "example.org", "192.168.1.24", "CUST-", "493821", "CUST-493821", "http://db.internal/x", "+91", "98765-43210", "é", "🎉", " ", ""]
READ = "video_id long, time_ms long, block int, par int, line int, ord int, x int, y int, width int, height int, conf int, text string"


def some_tokens():
    out = []
    for video, frame, line in [(v, t, n) for v in (1, 2, None) for t in (0, 350, 700) for n in range(4)]:
        at = 0
        for k in range(RNG.randint(0, 9)):
            out.append((video, frame, 1, 1, line, k, at, 20 * line, wide := RNG.randint(5, 60), 12, RNG.choice([10, 50, 90]), RNG.choice(WORDS)))
            at += wide
    return out + out[:5] + [(1, 0, 1, 1, 9, 0, 0, 0, 5, 5, 90, None)]


def hits_plainly(read):
    lines, out = {}, {}
    for v, t, b, p, n, k, x, y, w, h, conf, text in read:
        if text and text.strip() and conf >= 20:
            lines.setdefault((v is not None, v or 0, t, b, p, n), []).append((x, k, y, w, h, conf, text.strip()))
    for (_, v, t, *_place), found in sorted(lines.items()):
        found.sort()
        for sep in (" ", ""):
            at, ends = 0, []
            for f in found:
                ends.append((at, at + len(f[6])))
                at = ends[-1][1] + len(sep)
            for m in X._find(__import__("pandas").Series([sep.join(f[6] for f in found)]))[0]:
                hit = [f for f, (a, z) in zip(found, ends, strict=True) if z > m["start"] and a < m["end"]]
                x1, y1, x2, y2 = min(f[0] for f in hit), min(f[2] for f in hit), max(f[0] + f[3] for f in hit), max(f[2] + f[4] for f in hit)
                box = (int(x1 / 1.5), int(y1 / 1.5), max(1, int((x2 - x1) / 1.5)), max(1, int((y2 - y1) / 1.5)))
                frame = out.setdefault((v if _ else None, t), {})
                frame.setdefault((m["type"], re.sub("[^a-z0-9]", "", m["value"].lower()), box), (m["value"], len(frame) + 1))
    return {(v, t, n, kind, value, key, *box) for (v, t), frame in out.items() for (kind, key, box), (value, n) in frame.items()}


def test_pattern_hits(spark):
    read = some_tokens()
    df = spark.createDataFrame(read, READ).withColumns({c: F.lit(1) for c in ("sep", "m", "box", "o", "key")})
    got = tokens.pattern_hits(tokens.lines(df))
    found = [tuple(r)[:10] for r in got.select("video_id", "time_ms", "ord", "type", "value", "key", "x", "y", "width", "height").collect()]
    assert len(found) == len(set(found)) > 20 and set(found) == hits_plainly(read)
    assert {"email", "ip_address", "account_id", "private_url", "phone"} <= {r[3] for r in found}
    assert tokens.pattern_hits(tokens.lines(df.limit(0))).count() == 0


def test_a_torn_value_is_found(spark):
    read = [(1, 0, 1, 1, 1, k, 30 * k, 0, 30, 15, 90, t) for k, t in enumerate(["to", "alice", "@example.com"])]
    got = tokens.pattern_hits(tokens.lines(spark.createDataFrame(read, READ))).select("value", "x", "width").collect()
    assert [tuple(r) for r in got] == [("toalice@example.com", 0, 60)]


def sessions_plainly(hits, interval=350):
    found, window = {}, max(300, interval // 2 + 100)
    for video, kind, value, key, t, _, x, y, w, h, conf in sorted(hits, key=lambda r: (r[4], r[5])):
        mine = found.setdefault((video, kind), [])
        for f in reversed(mine):
            if t - f["end"] <= 3 * interval and f["last"] != t and (f["key"] == key or (kind == "qr_code" and codes._overlap(f["box"], (x, y, w, h)) >= 0.15)):
                f.update(end=max(f["end"], t + window), conf=max(f["conf"], conf), n=f["n"] + 1, last=t, box=(x, y, w, h))
                break
        else:
            unread = kind == "qr_code" and value == "QR code"
            mine.append({"value": f"{value} {len(mine) + 1}" if unread else value, "key": None if unread else key, "start": max(0, t - window), "end": t + window, "conf": conf, "n": 1, "last": t, "box": (x, y, w, h)})
    return sorted((v, k, f["value"], f["start"], f["end"], f["conf"], f["n"]) for (v, k), fs in found.items() for f in fs)


@pytest.mark.parametrize("step", [350, 1000, 2000])
def test_sessions_by_parts(spark, step):
    rng = random.Random(step)
    hits = []
    for v in (1, 2):
        t = 0
        for n in range(150):
            t += rng.choice([0, 1, 2, 3]) * step // 2
            kind = rng.choice(["email", "qr_code"])
            value = rng.choice(["QR code", "http://a"] if kind == "qr_code" else ["a@b.cc", "A@b.cc", "x@y.zz"])
            hits.append((v, kind, value, re.sub("[^a-z0-9]", "", value.lower()), t, n, rng.choice([0, 10, 200]), 0, 40, 40, rng.random()))
    df = spark.createDataFrame(hits, "video_id long, type string, value string, key string, time_ms long, ord long, x int, y int, width int, height int, confidence double").withColumn("part", F.lit(1))
    assert sorted(tuple(r) for r in codes.general_sessions(df).collect()) == sessions_plainly(hits)
    assert codes.general_sessions(df.limit(0)).count() == 0


def test_findings_out_of_reach_are_not_held(spark):
    hits = [(v, "email", f"a{n}@b.cc", f"a{n}bcc", 350 * n, n, 0, 0, 40, 40, 0.5) for v in (1, 2) for n in range(3000)]  # no gap is long
    odd = [(3, "qr_code", "QR code", "qrcode", None, 1, None, None, None, None, None), (3, "qr_code", "QR code", "qrcode", 0, 1, None, 0, 40, 40, None), (3, "qr_code", "QR code", "qrcode", 350, 2, 0, 0, 40, 40, 0.5)]
    df = spark.createDataFrame(hits + odd, "video_id long, type string, value string, key string, time_ms long, ord long, x int, y int, width int, height int, confidence double")
    got = codes.general_sessions(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # a group a part, all parts in one task before
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert [r for r in rows if r[0] != 3] == sorted(((v, k, value, max(0, t - 300), t + 300, c, 1) for v, k, value, _, t, _, _, _, _, _, c in hits), key=str)
    assert [r[2:] for r in rows if r[0] == 3] == [("QR code 1", 0, None, None, 1), ("QR code 2", 0, 300, None, 1), ("QR code 3", 50, 650, 0.5, 1)]


def test_only_lines_that_may_match_go_to_python(spark, monkeypatch):
    seen, find = spark.sparkContext.accumulator(0), X._find

    def counted(texts):
        seen.add(len(texts))
        return find(texts)

    read = [(1, n, 1, 1, 1, k, 30 * k, 0, 30, 15, 90, t) for n in range(50) for k, t in enumerate(["plain", "words", "alone" if n else "a@b.cc"])]
    monkeypatch.setattr(X, "_find", counted)
    got = tokens.pattern_hits(tokens.lines(spark.createDataFrame(read, READ)))
    assert {r["value"] for r in got.collect()} == {"a@b.cc", "plainwordsa@b.cc"} and seen.value == 2  # 100 before


def test_no_match_is_ruled_out(spark):
    rng = random.Random(9)
    whole = ["a@b.cc", "1.2.3.4", "sk-abcdefgh", "AKIA" + "A1" * 8, "ghp_" + "a1" * 10, "xoxb-abcdefghij", "CUST-1234", "cu\u017ft-a\u0131\u212a\u0130", "TIC\u212aET-12a4", "http\u017f://db.lan", "HTTP://10.0.0.1/", "+49 (30) 1234.567", "1\x1c2\x853\xa04\u20285\u30006\t7\x0b8", "\u0661\u0662" * 5, "\U0001e950" * 9, "plain", "9", "\u00e9", "-", "K"]
    texts = whole + ["".join(rng.choices(["1", "\u0661", ".", "-", " ", "\x1f", "@", "a", "K", "\u212a", "CUST-", "://", "A", "I", "AKIA", "_", "gh", "localhost", "http"], k=rng.randint(1, 30))) for _ in range(3000)]
    torn = [rng.sample(list(t), len(t)) for t in texts]
    rows = spark.createDataFrame([(n, t, p) for n, (t, p) in enumerate(zip(texts, torn, strict=True))], "n int, t string, p array<string>").select("n", X.may_match(F.col("t")).alias("may"), X.may_match_torn(F.col("p")).alias("torn")).collect()
    found = X._find(__import__("pandas").Series(texts))
    assert sum(map(bool, found)) > 200 and all(map(bool, found[:15]))
    assert [texts[r["n"]] for r in rows if found[r["n"]] and not (r["may"] and r["torn"])] == []
    assert {texts[r["n"]] for r in rows if not r["may"]} >= {"plain", "9", "\u00e9", "-", "K"} and {texts[r["n"]] for r in rows if not r["torn"]} >= {"plain", "\u00e9", "K"}


def test_lines_that_stand_together(spark):
    read = some_tokens()
    df = spark.createDataFrame(read, READ).where("video_id is not null")
    place = ["video_id", "time_ms", "block", "par", "line"]
    one = F.struct("ord", "x", "y", "width", "height", "conf", "text")
    together = df.groupBy(*place).agg(F.collect_list(one).alias("tokens"))
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(tokens.lines_together(together)) == rows(tokens.lines(df)) != []


def test_ocr_findings_equal_the_token_table(spark, tmp_path):
    """The query against the same operators over a row a token."""
    from redactlake.plans import registry, runs

    rng = random.Random(5)
    docs = [(n, None if n == 7 else "" if n == 8 else " ".join(rng.choices([*WORDS, "AKIA" + "B2" * 8, "\u0661" * 9], k=rng.choice([1, 11, 12, 13, 200])))) for n in range(150)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frames = spark.read.parquet(f"{tmp_path}/documents.parquet").select(F.floor(F.col("doc_id") / 100).alias("video_id"), (F.col("doc_id") % 100 * 350).alias("time_ms"), F.split("text", r"\s+").alias("tokens"))
    rows = lambda d: sorted(map(str, d.collect()))
    got = registry.QUERIES["ocr_findings"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == rows(codes.general_sessions(tokens.pattern_hits(tokens.lines(runs._read(frames))))) != []
    assert plan.count("ObjectHashAggregate") == 0  # tokens were shuffled to be lines before


def test_lines_of_the_same_place_keep_one_order(spark):
    lines = [(None, None, 1, 1, 1, [(0, 0, 5, 30, 12, 90, t)]) for t in ("B@c.dd", "b@C.dd", "b@c.dd", "a@c.dd", "1.2.3.4", "9.8.7.6")]
    for some in (lines, lines[::-1]):
        df = spark.createDataFrame(some, "video_id long, time_ms long, block int, par int, line int, tokens array<struct<ord:int,x:int,y:int,width:int,height:int,conf:int,text:string>>").repartition(3)
        got = [(r["ord"], r["value"]) for r in tokens.pattern_hits(tokens.lines_together(df)).orderBy("ord").collect()]
        assert got == [(1, "1.2.3.4"), (2, "9.8.7.6"), (3, "B@c.dd"), (4, "a@c.dd")]
