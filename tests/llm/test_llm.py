"""The operators of redactlake.llm against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import itertools
import math
import random
import textwrap
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from redactlake.llm import binary_output, bpe, decontaminate, graph, language, licences, lm_score, nearest, sharding, simhash, suffix_dedup

RNG = random.Random(7)
WORDS = ["the", "of", "alpha", "Beta", "gamma,", "delta.", "é", "naïve", "x1", "42"]
LONG = " ".join(RNG.choice(WORDS) for _ in range(4000))
TEXTS = [None, "", " ", "one", "two words", LONG, LONG, LONG + " end", "The  spaced\n\ttext ", "日本語 テスト", "!!! 123", "a" * 1200, "a" * 1200] + [" ".join(RNG.choice(WORDS) for _ in range(RNG.randint(1, 60))) for _ in range(30)]
ROWS = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (3, "one"), (3, "one")]
#: Columns whose names the operators use inside.
EXTRA = ("key", "k1", "fp", "root", "node", "word", "n", "row", "size", "spans", "range", "shard", "h", "seed")


def extra():
    return {c: F.lit(1) for c in EXTRA}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns(extra())


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_sharding(docs, none):
    got = sharding.shard(docs, 5, samples=50, least_ranges=8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values()) and set(by) <= set(range(5))
    most = max(r["size"] for r in got)
    assert max(sum(r["size"] for r in by.get(s, [])) for s in range(5)) <= sum(r["size"] for r in got) / 5 + most
    assert sharding.shard(none).count() == 0


def test_sharding_divides_a_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy " * 40).otherwise(F.concat(F.lit("t " * 100), F.col("id").cast("string"))).alias("text"))
    sizes = [r["b"] for r in sharding.shard(df, 10, samples=300, least_ranges=32).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 2 * 240


def test_codes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = (2 ** rng.uniform(0, 31.9, n)).astype("u4")
        for bits in (3, 8):
            reader = binary_output.DacReader(binary_output.dac_pack(ids, bits))
            at = rng.permutation(n)
            assert (reader.get(at) == ids[at]).all()
            for _ in range(10 if n else 0):
                a = int(rng.integers(n))
                b = int(rng.integers(a, n)) + 1
                assert (reader.run(a, b - a) == ids[a:b]).all()
    with pytest.raises(ValueError):
        binary_output.DacReader(b"none")


def test_binary_output(docs, none):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    vocab = P.path("word_bpe_49k.json")
    tok, at, want = Tokenizer.from_file(vocab), 0, []
    texts = [(i, t) for i, t in ROWS if i != 3] + [(3, "one")] * 3
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert rows(binary_output.read_documents(binary_output.write_segments(docs, vocab, segment_ids=500))) == Counter(want)
    assert binary_output.read_documents(binary_output.write_segments(none, vocab)).count() == 0


def test_bpe(docs, none):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    own = bpe.Bpe(path, P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    assert own.parts_of(b"a" * 100) == [b"a" * 100] and all(b"".join(own.parts_of(w)) == w for w in (b"qxjqzvk" * 40, "日本".encode() * 50))
    runs = ["".join(RNG.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "a" * 1_000_000, "ab" * 50_000, "".join(RNG.choices(["the", "ing", "er"], k=700))]
    for t, (ids, back) in zip(runs, own.encode_texts(runs), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(t) and back == t.encode()
    hard = [" a  b\n c \n\n d\t", "it's  we'll 've \r\n x", "\x1c a\x1d b\x85c\xa0d", "a" * 3000, "ab" * 900, "".join(RNG.choices("ab'sé \n\t 9!.　ßтест", k=400)), "<|endoftext|>"]
    for t, (ids, back) in zip(hard, own.encode_texts(hard), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(t) and back == t.encode()
    ids = {t: np.array(ref.encode_ordinary(t or ""), "<u4") for _, t in ROWS}
    assert rows(bpe.digests(docs, path, P.PATTERN)) == Counter((i, len(ids[t]), hashlib.sha256(ids[t].tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    full = bpe.encode(docs, path, P.PATTERN).where("doc_id = 5").first()
    assert full["ids"] == ids[LONG].tolist() and bytes(full["decoded"]).decode() == LONG
    assert bpe.digests(none, path, P.PATTERN).count() == 0


def brute_groups(items, linked):
    top = list(range(len(items)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_components(spark):
    edges = [(RNG.randint(-30, 30), RNG.randint(-30, 30)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(40)]
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    pairs = {frozenset(e) for e in edges}
    want = {n: nodes[g] for n, g in zip(nodes, brute_groups(nodes, lambda a, b: frozenset((a, b)) in pairs), strict=True)}
    assert {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    import xxhash

    w = text.encode().lower().split()
    shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    fps = [plain_fingerprint(t or "") for _, t in ROWS]
    groups = brute_groups(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), g in zip(ROWS, groups, strict=True):
        least[g] = min((x for x in (i, least.get(g)) if x is not None), default=None)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((i, f"{f:016x}", least[g]) for (i, _), f, g in zip(ROWS, fps, groups, strict=True))
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (5, 6)").count() == 1


def test_components_of_long_paths_stars_and_forests(spark):
    path = [(k, k + 1) for k in range(5_000)]
    star = [(1_000_000, 10_000 + k) for k in range(100_000)]
    forest = [(200_000 + k, 200_000 + RNG.randrange(max(1, k - 30), k + 1)) for k in range(1, 3_000) if k % 100]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    edges = path + star + [e for e in forest if e[0] != e[1]]
    RNG.shuffle(edges)
    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in top}


@pytest.mark.parametrize("hot", [2000, 40, 5])
def test_simhash_links_lose_none(spark, hot):
    fps = [RNG.getrandbits(64) for _ in range(3)]
    for _ in range(200):
        x = RNG.choice(fps)
        for b in RNG.sample(range(64), RNG.randint(1, 5)):
            x ^= 1 << b
        fps.append(x)
    signed = sorted({f - (1 << 64) * (f >> 63) for f in fps})
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    near = lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 4
    want = dict(zip(signed, (signed[g] for g in brute_groups(signed, near)), strict=True))
    found = {r["node"]: r["root"] for r in graph.components(simhash.links(df, 4, hot)).collect()}
    assert {x: found.get(x, x) for x in signed} == want


def repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    for r in raws:
        mask = np.zeros(len(r), bool)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                mask[p : p + length] = True
        edges = np.diff(np.concatenate([[0], mask.astype(int), [0]]))
        yield len(r), int(mask.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(r, np.uint8)[~mask].tobytes()).hexdigest()


def test_suffix_dedup(docs, none):
    texts = [t for _, t in ROWS]
    want = Counter((i, *x, *y[1:3]) for (i, _), x, y in zip(ROWS, repeats(texts, 400), repeats(texts, 200), strict=True))
    assert rows(suffix_dedup.digests(docs)) == want
    assert suffix_dedup.digests(none).count() == 0
    cut = suffix_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.where("doc_id = 5").first()["text"] == "" and cut.where("doc_id = 0").first()["text"] is None


@pytest.mark.parametrize("crowded", [600_000, 3_000])
def test_suffix_dedup_in_blocks_and_crowds(spark, crowded):
    base = "".join(RNG.choices("abcdefgh ", k=700))
    texts = ["".join(RNG.choices("abcd ", k=RNG.randint(0, 200))) + base[RNG.randint(0, 250) : RNG.randint(400, 700)] + "".join(RNG.choices("xyzé ", k=RNG.randint(0, 200))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = df.select("doc_id", F.col("doc_id").alias("k1"), F.lit(0).cast("long").alias("k2"), F.col("text").cast("binary").alias("bytes"))
    first = suffix_dedup.repeated_windows(keyed, 150, 20_000, crowded)
    spans = {r["k1"]: r["spans"] for r in first.collect()}
    inner = {r["k1"]: r["spans"] for r in suffix_dedup._inside(keyed.select("k1", "k2", "bytes"), first, 220, 150).collect()}
    for length, own in ((150, spans), (220, inner)):
        for (_, removed, runs, sha), (i, t) in zip(repeats(texts, length), enumerate(texts), strict=True):
            gone = suffix_dedup.runs_of(own.get(i), length)
            assert (sum(b - a for a, b in gone), len(gone), hashlib.sha256(suffix_dedup._without(t.encode(), gone)).hexdigest()) == (removed, runs, sha)


def test_shared_suffixes():
    raw = b"mississippi" * 12 + b"missouri" * 5
    text = np.frombuffer(raw + b"\0", np.uint8)
    for length in (1, 2, 7, 30):
        seen = Counter(raw[p : p + length] for p in range(len(raw) - length + 1))
        assert suffix_dedup.shared_suffixes(text, length)[:-1].tolist() == [p + length <= len(raw) and seen[raw[p : p + length]] > 1 for p in range(len(raw))]


def test_decontamination(spark):
    item = " ".join(f"w{k}" for k in range(30))
    changed = " ".join("zz" if k % 7 == 3 else f"W{k}" for k in range(30))
    part = " ".join(f"w{k}" for k in range(10, 24))
    far = " ".join("zz" if k % 2 else f"w{k}" for k in range(30))
    docs = [(1, f"aa bb {item} cc"), (2, f"x {changed}!"), (3, f"q q {part} q q q"), (4, far), (5, None), (6, ""), (7, "short item"), (1, f"aa bb {item} cc"), (None, item), (8, "one short item more words here and so on until it is long")]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short item"), (4, ""), (1, item)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns(extra())
    for most in (1_000_000, 1):
        found = decontaminate.matches(df, bench, most_broadcast=most)
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (7, 3), (None, 1)}
    one = decontaminate.contaminated(df, bench).where("doc_id = 1").collect()
    assert [(r["doc_start"], r["n_overlap"], r["n_equal"]) for r in one] == [(2, 30, 30)]
    assert decontaminate.matches(df.limit(0), bench).count() == 0 and decontaminate.matches(df, bench.limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in rng.normal(size=24)] for _ in range(400)]
    for k in range(100, 140):
        vectors[k] = vectors[100]  # ties
    data = list(enumerate(vectors)) + [(1000, None), (1020, [0.0] * 24), (1040, [1.0] * 5), (1060, [math.nan] * 24), (1080, [math.inf] * 24), (None, vectors[0]), (1100, [None] * 24)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns(extra())
    for more in ({}, {"block_rows": 30, "block_queries": 7, "cell_rows": 40, "first_cells": 2}):
        got = {}
        for r in nearest.search(df, 20, **more).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        assert set(got) == set(range(0, 400, 20))
        hits = 0
        for q, found in got.items():
            score = np.array(vectors) @ np.array(vectors[q])
            want = sorted((k for k in range(400) if k != q), key=lambda k: (-round(score[k], 9), k))[:20]
            assert len(found) == 20 and all(abs(score[v] - s) < 1e-9 for v, s in found.values())
            hits += len(set(want) & {v for v, _ in found.values()})
        assert hits >= 0.98 * 20 * len(got)
    assert nearest.search(df.limit(0)).count() == 0
    few = nearest.search(df.where("vec_id in (0, 1, 2)"))
    assert few.count() == 2


@pytest.mark.parametrize("kind", ["gaussian", "clustered", "lengths"])
def test_nearest_on_larger_tables(spark, kind):
    rng, n = np.random.default_rng(3), 50_000
    x = rng.normal(size=(n, 32))
    if kind == "clustered":
        x = rng.normal(size=(150, 32))[rng.integers(0, 150, n)] * 2 + x * 0.5
    if kind == "lengths":
        x *= rng.lognormal(0, 0.5, n)[:, None]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.astype(np.float32).tolist()}), "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.search(df, 20, query_every=500).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    score = x[::500] @ x.T
    score[np.arange(len(score)), np.arange(0, n, 500)] = -np.inf
    want = np.argsort(-score, axis=1)[:, :20]
    assert all(len(got[q]) == 20 for q in range(0, n, 500))
    assert np.mean([len(got[q] & set(w.tolist())) / 20 for q, w in zip(range(0, n, 500), want, strict=True)]) >= 0.95


BIG = [(2**53 + 1, "the thing with the thing"), (None, "no id of its own"), (2**60 + 7, LONG), (2**60 + 7, LONG), (-(2**62) - 3, None), (None, None)]


def test_large_ids_beside_null_ones_stay(spark):
    import public_tokenizers as P

    df = spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in BIG], "doc_id long, text string, lang string, n_chars long").coalesce(1)
    ids = Counter(i for i, _ in BIG)
    net, labels = language.BiGru(2), ["de", "en"]
    results = [
        bpe.digests(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), binary_output.read_documents(binary_output.write_segments(df, P.path("word_bpe_49k.json"))),
        simhash.near_duplicates(df), suffix_dedup.digests(df), suffix_dedup.remove_repeats(df), language.predict(df, net, labels), sharding.shard(df),
        lm_score.score(df, *lm_score.fit(df, lm_score.Shape(known=6))),
    ]
    for got in results:
        assert Counter(r["doc_id"] for r in got.collect()) == ids
    assert Counter(r["doc_id"] for r in language.keep_languages(df, net, labels, 0.0).collect()) == Counter(i for i, t in BIG if t)
    assert Counter(r["doc_id"] for r in simhash.one_of_each(df).collect()) == Counter([2**53 + 1, None, 2**60 + 7, -(2**62) - 3])
    item = spark.createDataFrame([(2**53 + 1, LONG)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, item).collect()} == {(2**60 + 7, 2**53 + 1)}


def test_language(spark):
    parts = {"en": ["thing", "the", "shall", "with", "when"], "de": ["schön", "und", "nicht", "zwischen", "der"], "fr": ["être", "avec", "mais", "leçon", "où"]}
    data = [(k, " ".join(RNG.choices(parts[x], k=RNG.randint(5, 60))), x) for k, x in enumerate(RNG.choices(list(parts), k=300))] + [(1000, None, "en"), (1001, "", "en"), (1002, "12 !!", None), (None, "the thing", "en"), (1003, "x" * 5000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumns(extra())
    net, labels = language.fit(df)
    assert labels == ["de", "en", "fr"]
    found = {r["doc_id"]: r for r in language.predict(df, net, labels).collect()}
    held = [(k, x) for k, t, x in data[:300] if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(found[k]["lang_pred"] == x for k, x in held) >= 0.95 * len(held) > 0
    assert all(found[k]["lang_pred"] == "und" and found[k]["score"] == 0 for k in (1000, 1001, 1002)) and 0 <= found[1003]["score"] <= 1
    kept = language.keep_languages(df, net, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} >= set(range(300)) and kept.where("doc_id in (1000, 1001, 1002)").count() == 0
    empty = df.limit(0)
    assert language.predict(empty, *language.fit(empty)).count() == 0 and language.keep_languages(empty, *language.fit(empty)).count() == 0


def test_gradients():
    net, rng = language.BiGru(3, embed=4, hidden=5), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    seq, live = language.padded([b" ab ", b" xyz q"])
    target, weight = rng.dirichlet([1] * 3, 2), np.array([1.0, 2.0])
    _, g = net.gradients(seq, live, target, weight)
    for name in net.p:
        at = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
        old, loss = net.p[name][at], []
        for d in (1e-3, -1e-3):
            net.p[name][at] = old + d
            loss.append(net.gradients(seq, live, target, weight)[0])
        net.p[name][at] = old
        assert abs((loss[0] - loss[1]) / 2e-3 - g[name][at]) < 0.02 * abs(g[name][at]) + 1e-3, name


def test_licences(spark):
    mit = "MIT License\n\n" + licences.SENTENCES["mit-permission"].capitalize() + ":\n\n" + licences.SENTENCES["mit-notice"].capitalize() + ". The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."
    data = [(1, mit), (2, "Hello. Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. Bye."), (3, "Licensed under the Apache License, Version 2.0. a. b. c. You may not use this file except in compliance with the License."), (4, None), (5, ""), (6, "no licence here"), (2, "Released under the MIT License. Released under the MIT License.")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns(extra())
    got = sorted((r["doc_id"], r["start"], r["n_sentences"], r["rule_id"]) for r in licences.licences(df).collect())
    assert got == [(1, 0, 4, "mit-text"), (2, 0, 1, "mit-name"), (2, 1, 1, "mit-name"), (2, 1, 2, "apache-2.0-short"), (3, 0, 1, "apache-2.0-name")]
    assert licences.licences(df.limit(0)).count() == 0


WRAPPED = {
    "bsd-3-clause-text": """Copyright (c) 2020, Someone. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "mit-name": "This project is released under the MIT License and nothing else",
}


def test_wrapped_licences(spark):
    import re

    data, want = [], []
    for k, (rule, text) in enumerate(WRAPPED.items()):
        for width, mark, end in ((72, "", "\n"), (80, " * ", "\n"), (76, "# ", "\r\n")):
            paragraphs = ([mark + x for x in textwrap.wrap(p, width)] for p in text.split("\n\n"))
            data.append((len(data), "intro line" + end + end + (end + mark.rstrip() + end).join(end.join(p) for p in paragraphs)))
            want.append((data[-1][0], rule))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns(extra())
    assert sorted((r["doc_id"], r["rule_id"]) for r in licences.licences(df).collect()) == want
    assert all(re.search(licences._HINT, s) for s in licences.SENTENCES.values())
    assert {i for _, _, ids in licences.RULES for i in ids} == set(licences.SENTENCES)


def test_licences_equal_sql(spark):
    import duckdb

    data = [(k, t) for k, t in enumerate([*WRAPPED.values(), None, "", "MIT License. mit license", "Released under the MIT License! Licensed under CC BY-SA 4.0\nor CC BY 4.0. Licensed under the Apache License, Version 2.0 (the license)", " ".join(WRAPPED.values()), "\n".join(licences.SENTENCES.values()), "\n\n".join(licences.SENTENCES.values())])]
    got = rows(licences.licences(spark.createDataFrame(data, "doc_id long, text string")))
    db = duckdb.connect()
    documents = pd.DataFrame(data, columns=["doc_id", "text"])  # noqa: F841
    want = Counter(db.sql(licences.OP9_SQL).fetchall())
    assert got == want and len(got) > 20


def test_lm_score(docs, none):
    shape = lm_score.Shape(known=6, head=4, own=3, buckets=8, pairs=16, groups=2, parts=2, after=3, steps=4)
    model, counts = lm_score.fit(docs, shape)
    got = lm_score.score(docs, model, counts).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(w for i, t in ROWS if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(tokens(t)), sum(w in c for w in tokens(t)), n, round(sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t in ROWS)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    mass = np.zeros((shape.groups + 2, shape.classes))  # in every context the model is a distribution
    for word in range(min(shape.head, v)):
        mass[:, model.words.cls[word]] += 10 ** model.within[:, word]
    mass[:, -1] = (sum(x + 0.1 for w, x in c.items() if model.words.ids[w] < 0 or model.words.ids[w] >= shape.head) + 0.1) / model.tail
    assert np.allclose((10**model.classes).sum(axis=1), 1)
    assert all(abs(m - 1) < 1e-4 for m in mass[:, [k for k in range(shape.classes) if (model.words.cls[: shape.head] == k).any() or k == shape.classes - 1]].ravel())
    empty_model, empty_counts = lm_score.fit(none, shape)
    assert lm_score.score(none, empty_model, empty_counts).count() == 0
    assert {(r["base_score"], r["score"]) for r in lm_score.score(docs, empty_model, empty_counts).collect()} == {(0.0, 0.0)}


def test_decontamination_tells_rows_apart(spark):
    item = " ".join(f"w{k}" for k in range(30))
    false = " ".join(f"w{k}" if k < 7 else f"y{k}" for k in range(30))  # a seed, but no match
    for order in (1, -1):
        docs = [(1, item), (1, false), (1, "clean words"), (None, item), (None, false), (2, false)][::order]
        bench = spark.createDataFrame([(1, item), (None, "something else altogether"), (None, item)][::order], "item_id long, text string")
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumns(extra())
        for most in (1_000_000, 1):
            found = decontaminate.matches(df, bench, most_broadcast=most)
            assert Counter((r["doc_id"], r["item_id"]) for r in found.collect()) == Counter([(1, 1), (None, 1), (1, None), (None, None)])
        left = decontaminate.without_contaminated(df, bench)
        assert left.columns == df.columns
        assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(1, false), (1, "clean words"), (None, false), (2, false)])


def test_one_of_each_tells_rows_apart(spark):
    a, b, c = (" ".join(RNG.choice("bcdfg") + str(RNG.random()) for _ in range(40)) for _ in range(3))
    data = [(1, a), (2, a), (2, b), (None, a), (None, b), (None, c), (None, c), (3, None), (None, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns(extra())
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, a), (2, b), (None, c), (3, None)])


def test_decontamination_of_short_items(spark):
    around = lambda ws: " ".join(["before", "it", *ws, "and", "after", "it", "more", "words", "stand", "here"])
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(3, 13)}
    docs, want = [], set()
    for n, ws in items.items():
        may = n - math.ceil(n * 0.8)
        for changed in itertools.combinations(range(n), may):
            want.add((len(docs), n))
            docs.append((len(docs), around("zz" if k in changed else w for k, w in enumerate(ws))))
        docs.append((len(docs), around("zz" if k <= may else w for k, w in enumerate(ws))))  # one more than may
    bench = spark.createDataFrame([(n, " ".join(ws)) for n, ws in items.items()], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns(extra())
    for most in (1_000_000, 1):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, bench, most_broadcast=most).collect()} == want


def test_languages_that_are_not_known_go(spark):
    own = random.Random(3)
    parts = {"en": ["thing", "the", "shall", "with", "when", "other", "while", "those"], "de": ["schön", "und", "nicht", "zwischen", "der", "über", "durch", "auch"], "fr": ["être", "avec", "mais", "leçon", "où", "depuis"], "es": ["años", "con", "pero", "según", "donde", "hasta"]}
    clean = [(k, " ".join(own.choices(parts[x], k=own.randint(8, 60))), x) for k, x in enumerate(own.choices(list(parts), k=300))]
    foreign = ["kaupunki perustettiin keskiajalla ja siellä on edelleen paljon vanhoja taloja", "город был основан в средние века и сохранил множество старинных домов", "şehir orta çağda kuruldu ve bugün hala birçok eski eve sahiptir", "这座城市建于中世纪 至今仍保留着许多古老的房屋"]
    random_letters = [" ".join("".join(own.choices("abcdefghijklmnopqrstuvwxyz", k=own.randint(2, 9))) for _ in range(60)) for _ in range(6)]
    data = clean + [(1000 + k, t, None) for k, t in enumerate(foreign + random_letters)] + [(2000, None, "en"), (2001, "12 !!", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumns(extra())
    kept = language.keep_languages(df, *language.fit(df))
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, *_ in clean}


def test_a_rare_language_is_learned(spark):
    own = random.Random(4)
    parts = {"en": [f"thing{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(8)], "fi": ["kaupunki", "siellä", "edelleen", "paljon", "vanhoja"]}
    data = [(k, " ".join(own.choices(parts["fi" if k % 100 == 0 else "en"], k=30)), "fi" if k % 100 == 0 else "en") for k in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumns(extra())
    net, labels = language.fit(df, sample_docs=40, most_words=60)
    assert labels == ["en", "fi"]
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(df, net, labels).collect()}
    assert all(found[k] == x for k, _, x in data if x == "fi") and sum(found[k] == x for k, _, x in data) >= 0.98 * len(data)
    assert language._quota([1, 5, 100], 30) == 24 and language._quota([10, 10], 7) == 3 and language._quota([2, 3], 30) == 3 and language._quota([], 5) == 0
