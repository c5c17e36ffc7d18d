"""Language model, toxicity, search, and the pipeline."""

import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from corpus import SCHEMA, odd_rows, rows_of, table
from pyspark.sql import functions as F

from tessella.llm import lm, queries, top_k, toxicity
from tessella.llm.common import read

DATA = "/root/testdata/sf0.001"


def test_lm_against_exact_counts(spark):
    rows = odd_rows()
    got = lm.scores(table(spark, rows)).collect()
    tokens = [[*(text or "").encode().lower().split(), None] for _, text, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows]
    c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for r, h, ws in zip(rows, held, tokens, strict=True))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and lm.scores(table(spark, [])).count() == 0


def test_lm_beats_its_base_on_held_out_texts(spark):
    got = lm.scores(read(spark, "/root/testdata/sf0.01", "documents")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def lm_brute(rows, held):
    """log10 P of each text by the formula, from exact counts on the levels' scale; and a function for P(v | u)."""
    tokens = [["<s>", *(text or "").encode().lower().split(), "</s>"] for _, text, *_ in rows]
    train = [ws for ws, h in zip(tokens, held, strict=True) if not h]
    words = Counter(w for ws in train for w in ws[1:])
    pairs = Counter(p for ws in train for p in zip(ws, ws[1:], strict=False))
    pairs = {p: n for p, n in pairs.items() if n >= lm.LEAST_PAIR}
    kept = Counter()
    for (u, _), n in pairs.items():
        kept[u] += n
    n, v = sum(words.values()), len(words)
    down = lambda c: int(lm.lower(lm.level(np.array([c])))[0])
    up = lambda c: int(lm.upper(lm.level(np.array([c])))[0])

    def p(b, a):
        total = up(len(train) if a == "<s>" else words[a])
        return (down(pairs.get((a, b), 0)) + (lm.K + total - up(kept[a])) * (down(words[b]) + 0.5) / (n + 0.5 * (v + 1))) / (total + lm.K)

    return [sum(math.log10(p(b, a)) for a, b in zip(ws, ws[1:], strict=False)) for ws in tokens], p, words


def lm_rows():
    """Contexts that kept bigrams follow, contexts that unique words follow, and odd texts."""
    rng = random.Random(12)
    rows = [(i, f"a{i % 10} b{i % 10} c{i % 10} u{i}", *[None] * 7) for i in range(120)]
    rows += [(200 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))), *[None] * 7) for i in range(60)]
    return rows + [(1000 + (r[0] or 0), *r[1:]) for r in odd_rows()]


@pytest.mark.parametrize("most_bits", [1 << 29, 1 << 14])
def test_lm_against_its_formula(spark, monkeypatch, most_bits):
    """In one reading, and in one for each of many groups of segments."""
    monkeypatch.setattr(lm, "ENTRY_BITS", 64)  # no false positives
    rows = lm_rows()
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows]
    got = lm.score(table(spark, rows), lm.is_train("doc_id", 1), most_bits=most_bits).collect()
    want, p, words = lm_brute(rows, held)
    assert sorted((r.doc_id, round(r.score, 6)) for r in got) == sorted((i, round(x, 6)) for (i, *_), x in zip(rows, want, strict=True))
    for u in ["<s>", "a0", "c3", *"abcd", "</s>"]:
        assert sum(p(v, u) for v in [*words, "never seen"]) <= 1 + 1e-9


def test_filter_levels():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    q = rng.integers(1, 12, 3000)
    bits = 3000 * 8 * 12 // 64 * 64
    on = np.zeros(bits, np.uint8)
    for at in range(1, 12):
        x, step = lm.Filter.spread(h[q >= at], np.full((q >= at).sum(), at))
        for probe in range(lm.PROBES):
            on[lm.Filter.places(x, step, probe, bits).astype(int)] = 1
    f = lm.Filter(1, bits, 1, np.packbits(on, bitorder="little"))
    h, by = np.unique(h, return_index=True)
    got, q = f.levels(h), q[by]
    assert (got == f.levels(h)).all() and (got == f.probed(h)).all()
    assert (got >= q).all() and (got > q).mean() < 0.05
    assert (lm.lower(lm.level(np.array([0, 1, 7, 10**6]))) <= [0, 1, 7, 10**6]).all() and (lm.upper(lm.level(np.array([1, 7, 10**6]))) >= [1, 7, 10**6]).all()


def test_trie_equals_edit_distance():
    rng = random.Random(8)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 12))) for _ in range(25)})
    trie = toxicity.Trie(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(600):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 13)))
        near = [(d, t) for t in terms if (d := distance(word, t)) <= toxicity.edits(t)]
        assert trie.nearest(word) == ((min(near)[1], min(near)[0]) if near else None)


def planted(n=400):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    bad = ["grumbalo", "fexotrin", "plidwack"]
    rows, labels = [], []
    for i in range(n):
        ws = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            w = rng.choice(bad)
            ws.insert(rng.randrange(len(ws)), w if rng.random() < 0.8 else w[:3] + "z" + w[4:])
        rows.append((i, " ".join(ws), *[None] * 7))
        labels.append((i, None, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = planted()
    given = spark.createDataFrame(labels + [(5000, None, 1), (None, None, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table(spark, rows + odd_rows()[:8]), given).collect()
    assert len(got) == len(rows) + 8 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    seen = {r.doc_id: r.predicted for r in got if r.doc_id >= 8}
    assert np.mean([seen[i] == y for i, _, y in labels if i in seen]) > 0.98
    docs = table(spark, rows[8:])
    kept = toxicity.drop_toxic(docs, given)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, p in seen.items() if not p}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in toxicity.toxicity(table(spark), none).collect())
    assert toxicity.toxicity(table(spark, []), none).count() == 0


@pytest.mark.parametrize("spread,block", [(1.0, 4096), (1.0, 16), (0.1, 16)])
def test_top_k(spark, monkeypatch, spread, block):
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "QUERIES", 7)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(6, 10))
    rows = [(i, (base[i % 6] * rng.choice([0.2, 1, 3]) + spread * rng.normal(size=10)).tolist(), 0) for i in range(150)]
    rows += [(300, None, 1), (301, [None] * 10, 1), (302, [float("inf")] * 10, 1), (303, [], 1), (304, [0.0] * 10, 1), (None, rows[0][1], 1), (305, rows[0][1], 1), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(rows_of(top_k.top_k(df, F.col("vec_id") % 4 == 0, k=5)))
    good = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v, _ in rows if i is not None and v and all(e is not None and np.isfinite(e) for e in v)]
    want = []
    for i, q in {i: q for i, q in good if i % 4 == 0}.items():
        best = sorted((-int(q @ c), j) for j, c in good if j != i)[:5]
        want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)
    assert top_k.top_k(df.limit(0), F.lit(True)).count() == 0


def test_registered():
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(f"op{i}" for i in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "substring_dedup", "best_fit_packing"]


def test_pipeline(spark, tmp_path):
    rows, labels = planted(60)
    docs = table(spark, rows + [(i + 1000, *r[1:]) for i, r in enumerate(odd_rows()[:-2])]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "best_fit_packing":
            assert out.schema == docs.schema and 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() and corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


@pytest.mark.parametrize("name", ["op1_token_counts", "op3_line_dedup", "op8_substring_dedup", "op10_toxicity"])
def test_queries_run(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    assert got.count() == read(spark, DATA, "documents").count() and "doc_id" in got.columns


def test_schema_has_clashing_columns():
    assert {"id", "t", "k", "label"} <= {f.split()[0] for f in SCHEMA.split(", ")}
