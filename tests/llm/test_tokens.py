"""Counts, codec and packing against the public library."""

import functools
import hashlib
import time
import zlib
from collections import defaultdict

import numpy as np
from corpus import odd_rows, rows_of, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import bpe, bpe_codec, packing, token_counts

made = functools.cache(lambda make, path: make(path))
LATIN = st.text(st.characters(min_codepoint=0, max_codepoint=255), max_size=60)


def ids(path, text):
    return bpe.library(path).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(LATIN, st.text(max_size=30)))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert made(token_counts.PrefixCounter, bpe.WORD_BPE).count(text) == len(ids(bpe.WORD_BPE, text))
    got, out = made(bpe_codec.Automaton, bpe.BYTE_BPE).encode(text)
    want = ids(bpe.BYTE_BPE, text)
    assert got == ",".join(map(str, want)) and out.decode("utf-8", "replace") == bpe.library(bpe.BYTE_BPE).decode(want, skip_special_tokens=False)
    assert next(made(packing.Ids, bpe.WORD_BPE).of([text])) == np.array(ids(bpe.WORD_BPE, text), "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abz'sllL1 .<|>éÉ\u0301\u0327日本Σςﬁİǆᄀ가ᅡ\u11a8\u0345ß"), max_size=14))
def test_any_prefix(text):
    text = "".join(text.split())
    assert made(token_counts.PrefixCounter, bpe.WORD_BPE).prefixes(text) == [len(ids(bpe.WORD_BPE, text[:k])) for k in range(1, len(text) + 1)]


def test_prefixes_with_special_strings_and_long_runs():
    c = made(token_counts.PrefixCounter, bpe.WORD_BPE)
    for text in ("ab<|endoftext|>cd<|startoftext|><|endoftext|>", "日本<|endoftext|>語e\u0301'll", "<|endoftext|"):
        assert c.prefixes(text) == [len(ids(bpe.WORD_BPE, text[:k])) for k in range(1, len(text) + 1)]
    long = "日本語" * 20_000
    found = c.prefixes(long)
    assert len(found) == 60_000 and found[299] == len(ids(bpe.WORD_BPE, long[:300])) and found[-1] == c.count(long) == len(ids(bpe.WORD_BPE, long))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abz'sllL1 .<|>éÉ\u0301\u0327日本Σςﬁİǆᄀ가ᅡ\u11a8\u0345ß"), max_size=30), st.integers(0, 12))
def test_any_fit(text, limit):
    """The longest prefix within the limit, of those that end where a cluster does."""
    c, count = made(token_counts.PrefixCounter, bpe.WORD_BPE), lambda k: len(ids(bpe.WORD_BPE, text[:k]))
    if not bpe.BEYOND.search(text):
        places = range(1, len(text) + 1)
    else:
        places = sorted({m.start() + j for m in token_counts.CHUNK.finditer(text) for j in c.cluster_ends(m[0])[0]} | {k for k in range(1, len(text) + 1) if text[k - 1].isspace()})
        normal = bpe.library(bpe.WORD_BPE).normalizer.normalize_str
        assert all(normal(text[:k]) + normal(text[k:]) == normal(text) for k in places if not text[k - 1].isspace() and not text[k:][:1].isspace())
    if "<|" not in text:
        assert c.fit(text, limit) == (len(text) if count(len(text)) <= limit else max([k for k in places if count(k) <= limit], default=0))


def test_fits_of_long_odd_runs():
    c = made(token_counts.PrefixCounter, bpe.WORD_BPE)
    for text in ("'" * 100_000, "e" + "\u0301" * 100_000, "e\u0301" * 50_000, "\u0301" * 100_000, "'s" * 50_000, "a'" * 50_000 + "日"):
        began = time.process_time()
        k = c.fit(text, 2048)
        assert time.process_time() - began < 20, text[:4]
        assert len(ids(bpe.WORD_BPE, text[:k])) <= 2048 and (k == len(text) or k > 1000 or text[1] == text[2])


def test_counts(spark):
    got = sorted(rows_of(token_counts.token_counts(table(spark), limit=40)), key=str)
    want = []
    for i, text, *_ in odd_rows():
        n, fit = len(ids(bpe.WORD_BPE, text)), len(text or "")
        if n > 40:
            fit = max(k for k in range(min(len(text), 600)) if len(ids(bpe.WORD_BPE, text[:k])) <= 40)
        want.append((i, len((text or "").encode()), n, n > 40, fit))
    assert got == sorted(want, key=str)


def test_prefix_table(spark):
    rows = [r for r in odd_rows() if r[0] is not None and len(r[1] or "") < 200]
    found = token_counts.prefix_counts(table(spark, rows)).select("doc_id", "prefix_tokens", token_counts.count_at(F.lit(5)).alias("at5"), token_counts.longest_within(F.lit(3)).alias("in3")).collect()
    texts = {r[0]: r[1] or "" for r in rows if r[0] != 10}
    for r in found:
        if r.doc_id in texts:
            counts = [len(ids(bpe.WORD_BPE, texts[r.doc_id][:k])) for k in range(1, len(texts[r.doc_id]) + 1)]
            assert r.prefix_tokens == counts
            assert r.at5 == (counts[min(5, len(counts)) - 1] if counts else 0)
            assert r.in3 == max([k for k, c in enumerate(counts, 1) if c <= 3], default=0)


def test_codec(spark):
    want = []
    for i, text, *_ in odd_rows():
        x = ids(bpe.BYTE_BPE, text)
        back = bpe.library(bpe.BYTE_BPE).decode(x, skip_special_tokens=False)
        want.append((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(rows_of(bpe_codec.digests(table(spark))), key=str) == sorted(want, key=str)
    back = bpe_codec.decode(bpe_codec.encode(table(spark)))
    assert sorted(map(str, rows_of(back))) == sorted(str((i, t or "")) for i, t, *_ in odd_rows())


def test_automaton_has_just_the_encodings():
    a = made(bpe_codec.Automaton, bpe.BYTE_BPE)
    for word in (b"tokenization", b"aaaaaaa", "ñandú".encode(), b"\xff\xfe"):
        assert b"".join(a.label[k] for k in a.encode_word(word)) == word


def test_packing(spark):
    capacity = 64
    got = packing.pack(table(spark), capacity=capacity).collect()
    full = defaultdict(list)
    for i, text, *_ in odd_rows():
        full[i].append(np.array([*ids(bpe.WORD_BPE, text), 0], "<u4"))
    assert sum(r.length for r in got) == sum(len(x) for xs in full.values() for x in xs)
    bins = defaultdict(list)
    for r in got:
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.length == len(x[r.start : r.start + capacity]) for x in full[r.doc_id]) and r.start == r.piece * capacity
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-sum(r.length for r in got) // capacity) * 1.05 + 1


def test_packing_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 40)
    got = packing.pack(table(spark), capacity=64).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n <= 64 for r in got) and len(got) <= 1.1 * sum(r.n for r in got) / 64 + 2


def test_packing_of_pieces_that_fill_no_bin(spark, monkeypatch):
    rounds, pack_shards = [], packing.pack_shards

    def counted(*args):
        rounds.append(args)
        assert len(rounds) < 9, "packing does not end"
        return pack_shards(*args)

    monkeypatch.setattr(packing, "SHARD", 16)
    monkeypatch.setattr(packing, "pack_shards", counted)
    long, short = "a " * 34, "a " * 28  # 35 and 29 tokens with the end: two long ones don't fit into 64, one of each fills it
    for texts, most in ([long] * 50, 50), ([long] * 60 + [short] * 20, 65):
        rounds.clear()
        got = packing.pack(table(spark, [(i, t, *[None] * 7) for i, t in enumerate(texts)]), capacity=64).collect()
        assert sorted(r.doc_id for r in got) == list(range(len(texts))) and {r.length for r in got} <= {35, 29}
        bins = defaultdict(int)
        for r in got:
            bins[r.sequence_id] += r.length
        assert max(bins.values()) <= 64 and len(bins) <= most


def test_empty(spark):
    none = table(spark, [])
    for f in (token_counts.token_counts, token_counts.prefix_counts, bpe_codec.digests, bpe_codec.encode, packing.pack):
        assert f(none).count() == 0


def test_packing_while_the_number_of_cores_changes(spark, monkeypatch, tmp_path):
    """Splits of files follow the cores that are there when a job starts."""
    name, turns = "spark.sql.leafNodeDefaultParallelism", []
    table(spark, [(i, "word " * (i % 50), *[None] * 7) for i in range(400)]).repartition(8).write.parquet(str(tmp_path / "docs"))
    pack_shards = packing.pack_shards

    def changed(*args):
        turns.append(2 + len(turns))
        spark.conf.set(name, turns[-1])
        return pack_shards(*args)

    monkeypatch.setattr(packing, "pack_shards", changed)
    monkeypatch.setattr(packing, "SHARD", 64)
    try:
        spark.conf.set(name, 16)
        packed = packing.pack(spark.read.parquet(str(tmp_path / "docs")), capacity=64)
        spark.conf.set(name, 16)
        got = packed.collect()
    finally:
        spark.conf.unset(name)
    assert sorted(r.doc_id for r in got) == list(range(400))
    bins = defaultdict(int)
    for r in got:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 64
