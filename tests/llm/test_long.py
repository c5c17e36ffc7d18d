"""Texts of more than a megabyte, one of them a single word, in every operator on texts."""

import random

import pytest
from corpus import rows_of, table
from test_duplicates import jaccard_brute, substring_brute

from tessella.llm import bpe, bpe_codec, jaccard, line_dedup, lm, packing, substring_dedup, token_counts, toxicity


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    lines = [" ".join(words[k : k + 10]) for k in range(0, len(words), 10)]
    texts = ["\n".join(lines), "a short text of its own with a few more words than a window has in it", "\n".join([*lines[:9000], "another line in the middle of it all", *lines[9000:]]), "x" * 1_200_000, "the same word " * 60_000]
    return [(i, t, *[None] * 7) for i, t in enumerate(texts)]


def test_tokens(spark, rows):
    df = table(spark, rows)
    n = {i: len(bpe.library(bpe.WORD_BPE).encode(t, add_special_tokens=False).ids) for i, t, *_ in rows}
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df).collect()}
    assert got == n
    packed = packing.pack(df).collect()
    assert {i: sum(r.length for r in packed if r.doc_id == i) for i in n} == {i: k + 1 for i, k in n.items()}
    assert bpe_codec.digests(df.where("doc_id in (1, 2, 3)")).where("n_tokens > 1").count() == 3


def test_duplicates(spark, rows):
    df = table(spark, rows)
    assert sorted(map(str, rows_of(substring_dedup.digests(df)))) == substring_brute(rows)
    assert sorted(map(str, rows_of(jaccard.near_duplicates(df, n=3, percent=90)))) == jaccard_brute(rows, 3, 90)
    assert {r.doc_id: r.n_removed for r in line_dedup.digests(df).collect()} == {0: 0, 1: 0, 2: 15_000, 3: 0, 4: 0}


def test_models(spark, rows):
    df = table(spark, rows)
    got = {r.doc_id: (r.n_tokens, r.score) for r in lm.scores(df).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: len(t.split()) + 1 for i, t, *_ in rows} and all(s < 0 for _, s in got.values())
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(df, labels).count() == len(rows)
