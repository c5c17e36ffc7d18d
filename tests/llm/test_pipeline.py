"""The pipeline against a plain version, and its stages on odd tables."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from corpus import SCHEMA, odd_rows, table
from test_duplicates import jaccard_brute, lines_left, words_left
from test_models import planted

from tessella.llm import bpe, common, jaccard, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Planted toxic documents, repeated lines, near-copies, shared passages and odd texts."""
    rng = random.Random(21)
    rows, labels = planted(120)
    texts = [r[1] for r in rows]
    line = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(9))
    footer, passage = line(), " ".join(f"p{k}" for k in range(60))
    for k in range(40):
        body = [line() for _ in range(5)]
        texts += ["\n".join([*body, footer]), "\n".join([line(), *body[:2], line()]) if k % 3 else "\n".join(body[:4] + [line()])]
        if k % 4 == 0:
            texts += [f"{line()} {passage} {line()}", " ".join(body).replace("w1 ", "w2 ", 1), " ".join(body)]
    texts += [t for _, t, *_ in odd_rows()[:14]]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], labels


def ids_of(text):
    return np.array([*bpe.library(bpe.WORD_BPE).encode(text, add_special_tokens=False).ids, 0], "<u4")


def test_pipeline_against_a_plain_version(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marked.write.parquet(f"{tmp_path}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.toxicity(docs, marked).where("predicted = 1").collect()}
    left = [(i, t) for i, t, *_ in rows if i not in rejected]
    kept = lines_left(left)
    left = [(i, kept[i] if t else t) for i, t in left if kept[i].split() or not (t or "").split()]
    group = {i: c for i, _, c in jaccard_brute(left, 5, 80, as_text=False)}
    left = [(i, t) for i, t in left if group[i] == i]
    kept = words_left(left)
    left = [(i, " ".join(kept[i])) for i, t in left if kept[i] or not (t or "").split()]
    assert rejected and len(left) < len(rows) - len(rejected)
    want = []
    for i, t in left:
        own = ids_of(t)
        want += [(i, k, at, len(own[at : at + 2048]), zlib.crc32(own[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(own), 2048))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, tmp_path, name, stage):
    """Null ids and texts, tied ids, repeated rows, columns that clash, no rows and null labels."""
    labels = [(i, None, None if i % 4 == 0 else int(i % 9 == 7)) for i in range(60)] + [(None, 1, 1), (3, None, 0), (3, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = [f.split()[0] for f in SCHEMA.split(", ")] + ["__id", "__t", "gone", "kept", "found", "row", "spans", "h"]
    docs = table(spark).selectExpr("*", "1 as __id", "2 as __t", "3 as gone", "'x' as kept", "4 as found", "5 as row", "6 as spans", "7 as h")
    out = stage(spark, docs, str(tmp_path))
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.count() == 0
    if name == "best_fit_packing":
        assert out.where("doc_id is null").count() == 1
    else:
        assert out.columns == extra and empty.columns == extra
        texts = [r.text for r in out.collect()]
        assert None in texts and "" in texts and (name != "toxicity" or len(texts) <= len(odd_rows()))


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    near = text.replace("w3 ", "x3 ")
    rows = [(5, text), (5, text), (2, near), (2, "a text of id two that is another one by all its words"), (None, text), (9, None), (9, None), (7, "")]
    got = jaccard.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, got.collect())) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [(2, near), rows[3], (9, None), (9, None), (7, "")])
    only = jaccard.without_near_duplicates(spark.createDataFrame([(None, text), (None, text), (5, text), (5, text)], "doc_id long, text string"))
    assert [tuple(r) for r in only.collect()] == [(5, text)]


def test_tables_on_the_way_are_deleted(spark, tmp_path):
    import os

    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with common.temporary_tables(spark):
        common.cut(spark.range(3))
        kept = common.cut(spark.range(4), outlives=True)
    assert len(set(os.listdir(folder)) - before) == 1 and kept.count() == 4
