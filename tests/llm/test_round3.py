"""The divergence audit, HTML extraction and importance resampling against plain versions on small tables with nulls, ties, repeated rows and clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from redactlake.llm import decontaminate, divergence, html_tree, resample, suffix_dedup

RNG = random.Random(5)
WORDS = ["the", "of", "Alpha", "BETA", "gamma", "é", "naïve", "x1y", "42", "İ", "日本"]
TEXTS = [None, "", " 12 !", "one", "a-b_c", "x" * 300_000, "The the THE  the"] + [" ".join(RNG.choice(WORDS) for _ in range(RNG.randint(1, 60))) for _ in range(60)] + ["of alpha"] * 40
ROWS = [(k, t, RNG.choice(["en", "de", None, ""]), RNG.choice(["a", "b", "é", None, ""])) for k, t in enumerate(TEXTS)] + [(None, "the of", "en", "a"), (3, "one", "en", "b"), (3, "one", "en", "b"), (900, "7 7", "xx", "only"), (901, None, "xx", "more")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("row", "term", "c", "d", "n", "v", "p", "rank", "score", "part", "item", "word", "weight")})


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def divergence_plainly(least, top):
    counts, df, lang_counts, groups = {}, Counter(), Counter(), set()
    for _, text, lang, source in ROWS:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        counts.setdefault((lang, source), Counter()).update(found)
        df.update((lang, t) for t in set(found))
        lang_counts.update((lang, t) for t in found)
    out = Counter()
    far = lambda p, q: (p - q) ** 2 // (p + q)
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    for lang, source in groups:
        kept = [t for (g, t), n in df.items() if g == lang and n >= least]
        v, total = len(kept), sum(lang_counts[lang, t] for t in kept)
        p = {s: {t: share(counts[lang, s][t], sum(counts[lang, s][k] for k in kept), v) for t in kept} for g, s in groups if g == lang}
        pairs = [(s, sum(far(p[source][t], p[s][t]) for t in kept)) for s in p if s != source]
        terms = [(t, far(p[source][t], q)) for t in kept for q in [share(lang_counts[lang, t], total, v)] if counts[lang, source][t] and p[source][t] > q]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out[lang, source, part, item, value, rank] += 1
    return out


@pytest.mark.parametrize("least,top,shard_rows,slice_bytes", [(10, 10, 500_000, 1 << 20), (2, 3, 5, 40)])
def test_divergence(docs, least, top, shard_rows, slice_bytes):
    assert rows(divergence.divergence(docs, least, top, shard_rows, slice_bytes)) == divergence_plainly(least, top)


def test_divergence_of_nothing(docs):
    assert divergence.divergence(docs.limit(0)).count() == 0


def resample_plainly(rows_, target, buckets, longest, least, percent):
    def features(text):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER).encode())
        return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    made = [(i, *features(t)) for i, t in rows_]
    s, t = Counter(b for *_, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[0] >= least), key=lambda r: (-r[4], r[1] is not None, r[1] or 0))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = rank
    return Counter(tuple(r[1:]) for r in out)


@pytest.mark.parametrize("longest,least,percent,parts", [(1, 20, 10, 16), (3, 2, 55, 3), (2, 1, 100, 1)])
def test_resample(spark, docs, longest, least, percent, parts):
    target = ["the of naïve", None, "gamma  42 gamma 42", "the of naïve"]
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, score int")
    got = rows(resample.resample(docs, bench, 500, longest, least, percent, range_rows=len(ROWS) // parts + 1))
    assert got == resample_plainly([r[:2] for r in ROWS], target, 500, longest, least, percent)


def test_resample_of_nothing(spark, docs):
    bench = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert resample.resample(docs.limit(0), bench).count() == 0
    assert resample.resample(docs, bench.limit(0)).count() == len(ROWS)


def test_suffix_array_runs():
    words = [RNG.randrange(6) for _ in range(300)]
    ends = [0, 0, 100, 101, 250, 300]
    for longest in (1, 2, 5):
        got = Counter()
        for n, places, starts in resample.repeated(resample.np.array(words), resample.np.array(ends), longest):
            for a, b in zip(starts, [*starts[1:], len(places)], strict=True):
                grams = {tuple(words[p : p + n]) for p in places[a:b]}
                assert len(grams) == 1
                got[grams.pop()] += b - a
        assert got == Counter(tuple(words[i : i + n]) for a, b in zip(ends, ends[1:], strict=False) for n in range(1, longest + 1) for i in range(a, b - n + 1))


def plain_marginals(page, model):
    """By all labellings of a small tree."""
    n = len(page.parent)
    total, content = 0.0, [0.0] * n
    for ls in itertools.product((0, 1), repeat=n):
        score = 0.0
        for i, (p, tag) in enumerate(zip(page.parent, page.tag, strict=True)):
            score += ls[i] * sum(model.weights[model.features[f]] for f in html_tree.evidence(page, i) if f in model.features)
            score += model.edges[model.kinds.get(tag, 0), ls[p], ls[i]] if p >= 0 else 0.0
        weight = math.exp(score)
        total += weight
        content = [c + weight * v for c, v in zip(content, ls, strict=True)]
    return [c / total for c in content]


def test_tree_marginals_and_gradient():
    pages = [html_tree.parse(h, "y") for h in ("<nav><ul><li><a href=x>one</a><li>two</ul></nav><article y=1><p>Some. Text.<p y=0 class=ad>buy</article>", "<main y=1>text<form y=0>x<p>y</form></main><footer>c")]
    labels = [html_tree.labels_of(p) for p in pages]
    model = html_tree.train(pages, labels, steps=5)
    rng = html_tree.np.random.default_rng(3)
    model.weights, model.edges = rng.normal(size=model.weights.shape), rng.normal(size=model.edges.shape)
    for page, found in zip(pages, model.marginals(pages), strict=True):
        assert found == pytest.approx(plain_marginals(page, model))
    trees, y = html_tree.forest(pages, model.features, model.kinds), html_tree.np.array(sum(labels, []))
    _, d_weights, d_edges = html_tree.gradient(trees, y, model.weights, model.edges)
    for held, d in ((model.weights, d_weights), (model.edges, d_edges)):
        for at in itertools.islice(html_tree.np.ndindex(held.shape), 25):
            was, logs = held[at], []
            for step in (1e-5, -1e-5):
                held[at] = was + step
                logs.append(html_tree.gradient(trees, y, model.weights, model.edges)[0])
            held[at] = was
            assert (logs[0] - logs[1]) / 2e-5 == pytest.approx(d[at], abs=1e-5)


@pytest.mark.parametrize("html,blocks", [
    ("<p>a<b>b\n\tc</p>d&amp;&eacute;&#8364;<br>e", ["ab c", "d&é€ e"]), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a b", "c"]),
    ("<head><title>t</title><script>var a='<p>';</script><style>x</style><body>a<!-- <p>no --><noscript>n</noscript><select><option>o</select>b", ["ab"]), ("x</p></div></a>y<p", ["x", "y"]), ("", []), (None, []), ("&am", ["&am"]),
    ("<p>a<div>b</p>c</div>", ["a", "b", "c"]), ("<div>" * 3000 + "deep", ["deep"]),
])
def test_blocks(html, blocks):
    assert [t for t in html_tree.parse(html).text if t is not None] == blocks


def test_html(spark):
    words = " ".join(WORDS * 8)
    body = lambda k: f"<h1>Title {k}</h1><p>First &amp; <i>best</i> {words}.</p><p>Second  one,\n{words}.</p>"
    noise = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class=ad>Buy now.</div>"
    made = [(k, f"u{k}", f"<html><head><title>t</title></head><body>{noise}<article>{body(k)}</article><footer>&copy; us</footer>") for k in range(40)]
    other = f"<body><div id=header><ul class=menu><li><a href=/>x</a></li></ul></div><div class='cookie-notice'><p>We use cookies. {words}.</p></div><div class=entry-content>{body(77)}<div class=newsletter><form><p>Sign up.</p></form></div></div><div id=comments><div class=comment><p>Nice. {words}.</p></div></div><div class=sidebar><h3>More</h3><ul><li><a href=/>y</a></li></ul></div><div class=footer>legal</div>"
    rest = [(None, None, None), (100, "e", ""), (100, "e", ""), (101, "o", other), (102, "s", "<script>x"), (103, "long", f"<article><p>{words * 3000}</p></article>")]
    df = spark.createDataFrame(made + rest, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "_h")})
    clean = " ".join(words.split())
    text = lambda k: f"Title {k}\nFirst & best {clean}.\nSecond one, {clean}."
    want = [(k, f"u{k}", text(k)) for k in range(40)] + [(None, None, ""), (100, "e", ""), (100, "e", ""), (101, "o", text(77)), (102, "s", ""), (103, "long", " ".join((words * 3000).split()))]
    got = html_tree.extract(df, html_tree.fit(df, dressed=300), slice_bytes=3000)
    assert rows(got) == Counter((*w, len(w[2])) for w in want)
    assert html_tree.extract(df.limit(0), html_tree.fit(df.limit(0), dressed=20)).count() == 0


def test_html_on_layouts_never_seen():
    texts = ["some words about this and that", "of the other kind of text that pages have, with marks"]
    made = [html_tree._Dresser(texts, 1), html_tree._Dresser(texts, 2)]
    pages = [[html_tree.parse(d.page(), html_tree._LABEL) for _ in range(n)] for d, n in zip(made, (300, 100), strict=True)]
    model = html_tree.train(pages[0], [html_tree.labels_of(p) for p in pages[0]])
    right = [(m >= 0.5) == bool(y) for p, ms in zip(pages[1], model.marginals(pages[1]), strict=True) for t, m, y in zip(p.text, ms, html_tree.labels_of(p), strict=True) if t is not None]
    assert sum(right) / len(right) >= 0.98


def test_suffix_dedup_of_a_hot_row(spark):
    """Thousands of equal rows: spans of their common key are held once, not once for each row."""
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(163))[:1140]
    df = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionAll(spark.createDataFrame([(8, text[:300] + "x" * 150), (9, "alone")], "doc_id long, text string"))
    got = rows(suffix_dedup.digests(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "n_shared", "n_passages"))
    assert got[7, 1140, 1140, 1, 1140, 1] == 3000 and got[9, 5, 0, 0, 0, 0] == 1
    assert sum(n for r, n in got.items() if r[0] == 8) == 1 and all(r[2] == 0 and r[4] == 300 for r in got if r[0] == 8)


def matches_plainly(docs, bench, window=12, share=0.8):
    """By laying every item along every document at each offset and looking at all masks there."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for (i, text), (j, item) in itertools.product(set(docs), set(bench)):
        d, b = cut(text), cut(item)
        for start in range(-len(b) + 1, len(d)):
            same = [d[start + k] == w if 0 <= start + k < len(d) else None for k, w in enumerate(b)]
            seeds = [(k, m) for m in decontaminate.MASKS for k in range(len(b) - max(m)) if 0 <= start + k and start + k + max(m) < len(d)]
            hit = any(all(same[k + o] for o in m) for k, m in seeds)
            if 3 <= len(b) <= window:
                hit = hit or (None not in same and sum(same) >= math.ceil(share * len(b)))
            hit = hit or (len(b) < 3 and d == b and start == 0)
            laid = [x for x in same if x is not None]
            width = min(window, len(laid))
            if hit and max(sum(laid[k : k + width]) for k in range(len(laid) - width + 1)) >= math.ceil(share * width):
                out.add((i, j, start, len(laid), sum(laid)))
    return out


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_decontamination_against_all_places(spark, most):
    rng = random.Random(12)
    some = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    few, many = ["a", "b"], [f"w{k}" for k in range(40)]
    items = [some(n, many) for n in (1, 2, 3, 5, 9, 12, 13, 20, 40)] + ["a " * 30, "a b c " * 10, some(25, few), None, ""]
    near = lambda t: " ".join("zz" if rng.random() < 0.1 else w for w in t.split())
    docs = [f"{some(rng.randint(0, 20), many)} {near(t or '')} {some(rng.randint(0, 20), many)}" for t in items] + [near(t or "") for t in items] + [t or "" for t in items] + ["a " * 90, "b a c " * 30, "c " + "a b c " * 20, some(80, few), None, "a " * 11 + "x " + "a " * 14]
    held = list(enumerate(docs)) + [(0, docs[0]), (None, docs[1])]
    df, bench = spark.createDataFrame(held, "doc_id long, text string").withColumn("seed", F.lit(1)), spark.createDataFrame(list(enumerate(items)) + [(0, items[0])], "item_id long, text string").withColumn("before", F.lit(1))
    got = rows(decontaminate._hits(df, bench, most_broadcast=most, most_bytes=most).select("doc_id", "item_id", "doc_start", "n_overlap", "n_equal"))
    assert got == Counter(matches_plainly(held, list(enumerate(items))))


def test_decontamination_of_a_repeated_phrase(spark):
    """40,000 words of a phrase, or of one word, against 400 of it: as many hits as places."""
    docs = spark.createDataFrame([(1, "all work and no play " * 8000), (2, "work " * 40_000), (3, "no work")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "all work and no play " * 80), (2, "work " * 400)], "item_id long, text string")
    got = rows(decontaminate.contaminated(docs, bench))
    assert got == Counter({(1, 1, 0, 400, 400): 1, (2, 2, 0, 400, 400): 1})
    assert decontaminate.without_contaminated(docs, bench).select("doc_id").collect() == [(3,)]
