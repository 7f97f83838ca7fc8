"""The pipeline over a small table against the same steps by brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_llm import brute_groups, plain_fingerprint

RNG = random.Random(11)
EN, DE = ["thing", "the", "shall", "with", "when", "other", "while", "those"], ["schön", "und", "nicht", "zwischen", "der", "über", "durch", "auch"]


def made(words, n):
    return " ".join(RNG.choice(words) + RNG.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    item = " ".join(f"probe{k}" for k in range(25))
    shared = made(EN, 60)
    data = [[k, made(EN if k % 2 else DE, RNG.randint(20, 60)), "en" if k % 2 else "de"] for k in range(60)]
    data[7][1] = data[3][1]  # a copy
    data[9][1] = f"{data[9][1]} {shared} {made(EN, 10)}"
    data[11][1] = f"{data[11][1]} {shared} {made(EN, 10)}"
    data[13][1] = f"{data[13][1]} {item} {made(EN, 10)}"
    data += [[100, None, "en"], [101, "", "en"], [102, "123 !!", None]]
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, x, "src", len(t or "")) for i, t, x in data]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def test_pipeline(spark, tables):
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline
    from redactlake.llm.bpe import Bpe

    path, rows, item = tables
    left = [(i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "")]
    groups = brute_groups([plain_fingerprint(t) for _, t in left], lambda a, b: (a ^ b).bit_count() <= 4)
    left = [left[g] for g in sorted(set(groups))]
    raws = [t.encode() for _, t in left]
    seen = Counter(r[p : p + 200] for r in raws for p in range(len(r) - 199))
    cut = []
    for (i, _), r in zip(left, raws, strict=True):
        mask = np.ones(len(r), bool)
        for p in range(len(r) - 199):
            if seen[r[p : p + 200]] > 1:
                mask[p : p + 200] = False
        cut.append((i, np.frombuffer(r, np.uint8)[mask].tobytes().decode("utf-8", "ignore")))
    assert sum(len(t) for _, t in cut) < sum(len(t) for _, t in left)  # the shared passage is gone
    left = [(i, t) for i, t in cut if t and item not in t]
    ranks = Bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: np.array(ref.encode_ordinary(t), "<u4") for i, t in left}
    want = {(i, len(ids[i]), hashlib.sha256(ids[i].tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in left}
    assert {tuple(r) for r in corpus_pipeline.run(spark, path).collect()} == want
    assert len(corpus_pipeline.STAGES) == 5 and {7, 13, 100, 101, 102}.isdisjoint({i for i, _ in left})


def test_stages_of_an_empty_table(spark, tables):
    import corpus_pipeline

    path, _, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0
