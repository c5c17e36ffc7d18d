"""Duplicate operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus import SCHEMA, odd_rows, rows_of, table

from tessella.llm import embedding_dedup, jaccard, line_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def least(nodes, links):
    """The least node reachable from each."""
    out = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(out[a], out[b])
            if out[a] != m or out[b] != m:
                out[a] = out[b] = m
                changed = True
    return out


def near_texts(seed, n=60):
    """Texts of few words with many edits, so that similarities lie around the threshold."""
    rng = random.Random(seed)
    base = [[str(rng.randrange(400)) for _ in range(rng.randrange(3, 90))] for _ in range(8)]
    out = []
    for i in range(n):
        ws = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(ws))
            ws[k : k + rng.randrange(2)] = [str(rng.randrange(400))] * rng.randrange(2)
        out.append((i, " ".join(ws), *[None] * 7))
    return out


def jaccard_brute(rows, n, percent, as_text=True):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, text, *_ in rows:
        ws = WORD.findall((text or "").translate(lower))
        sets.append((i, {tuple(ws)} if 0 < len(ws) < n else {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a][1] and 100 * len(sets[a][1] & sets[b][1]) >= percent * len(sets[a][1] | sets[b][1]) and sets[b][1]]
    group = least(range(len(sets)), links)
    ids = {g: min((sets[x][0] for x in group if group[x] == g and sets[x][0] is not None), default=None) for g in set(group.values())}
    out = [(i, len(s), ids[group[k]] if ids[group[k]] is not None else i) for k, (i, s) in enumerate(sets)]
    return sorted(map(str, out)) if as_text else out


@pytest.mark.parametrize("n,percent,block", [(3, 90, 1024), (5, 80, 1024), (3, 80, 4)])
def test_jaccard(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SUMMARIES", 2 * block)
    rows = near_texts(percent + n)
    assert sorted(map(str, rows_of(jaccard.near_duplicates(table(spark, rows), n=n, percent=percent)))) == jaccard_brute(rows, n, percent)


def test_jaccard_odd_rows(spark):
    rows = odd_rows()  # with two texts under one id
    assert sorted(map(str, rows_of(jaccard.near_duplicates(table(spark, rows), n=3, percent=90)))) == jaccard_brute(rows, 3, 90)
    assert jaccard.near_duplicates(table(spark, [])).count() == 0


def words_gone(rows):
    """(id, words, places that go) of each row."""
    docs = [(i, WORD.findall(text or "")) for i, text, *_ in rows]
    first = {}
    for i, ws in docs:
        if i is not None:
            for k in range(len(ws) - 12):
                w = tuple(ws[k : k + 13])
                first[w] = min(i, first.get(w, i))
    for i, ws in docs:
        gone = set()
        for k in range(len(ws) - 12):
            if i is not None and first[tuple(ws[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        yield i, ws, gone


def words_left(rows):
    return {i: [w for k, w in enumerate(ws) if k not in gone] for i, ws, gone in words_gone(rows)}


def substring_brute(rows):
    out = []
    for i, ws, gone in words_gone(rows):
        kept = [w for k, w in enumerate(ws) if k not in gone]
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(map(str, out))


def repeated_passages(seed):
    rng = random.Random(seed)
    words = [str(x) for x in range(300)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(12, 40))] for _ in range(6)]
    rows = []
    for i in range(50):
        ws = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(max(1, len(p) - 13))
            ws += rng.choice([p, p[a:], p[: len(p) - a], [rng.choice(words) for _ in range(20)], ["x"] * rng.randrange(30)])
        rows.append((i, rng.choice([" ", "\n", "  "]).join(ws), *[None] * 7))
    return rows + [rows[3], rows[3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, monkeypatch, seed):
    monkeypatch.setattr(substring_dedup, "SHARD", 50)
    rows = repeated_passages(seed)
    assert sorted(map(str, rows_of(substring_dedup.digests(table(spark, rows))))) == substring_brute(rows)


def test_substrings_of_a_frequent_mark(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD", 8)
    sizes, parted = [], substring_dedup.parted

    def seen(texts):
        few, many = parted(texts)
        sizes.append((max(r["count"] for r in few.groupBy("f").count().collect()), many.count()))
        return few, many

    monkeypatch.setattr(substring_dedup, "parted", seen)
    rng = random.Random(3)
    own = lambda n: [str(rng.random()) for _ in range(n)]
    passage = own(30)
    rows = [(i, " ".join([*own(9), *passage, *own(9)]), *[None] * 7) for i in range(40)] + [(40 + r[0], *r[1:]) for r in repeated_passages(3)]
    assert sorted(map(str, rows_of(substring_dedup.digests(table(spark, rows))))) == substring_brute(rows)
    assert sizes[0][0] <= 8 < sizes[0][1]


def test_substrings_odd_rows(spark):
    assert sorted(map(str, rows_of(substring_dedup.digests(table(spark))))) == substring_brute(odd_rows())
    assert substring_dedup.digests(table(spark, [])).count() == 0
    kept = substring_dedup.without_repeats(table(spark))
    assert kept.columns == [f.split()[0] for f in SCHEMA.split(", ")] and kept.count() == len(odd_rows())
    shas = Counter(hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() for r in kept.collect())
    assert shas == Counter(r.kept_sha256 for r in substring_dedup.digests(table(spark)).collect())


def longest_run(pairs):
    """The length of the longest increasing run, by trying all predecessors."""
    best = []
    for k, (_, j) in enumerate(pairs):
        best.append(1 + max((best[m] for m in range(k) if pairs[m][1] < j), default=0))
    return max(best, default=0)


def test_patience():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(14))] for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert got == sorted(got) and [j for _, j in got] == sorted({j for _, j in got})  # order is kept and no line is matched twice
        once = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
        run = line_dedup.increasing(once)
        assert len(run) == longest_run(once) and run == sorted(run) and [j for _, j in run] == sorted(j for _, j in run)
    assert line_dedup.patience([1, 2, 3, 9, 4, 5], [1, 2, 7, 3, 8, 4, 5]) == [(0, 0), (1, 1), (2, 3), (4, 5), (5, 6)]
    assert line_dedup.patience([8, 1, 8, 2, 8], [7, 1, 8, 2, 7]) == [(1, 1), (2, 2), (3, 3)]


def longest_common(a, b):
    """The length of a longest common subsequence, by the whole table."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_patience_of_lines_that_repeat():
    rng = random.Random(11)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(20))] for _ in range(2))
        got = line_dedup.common(a, b)
        assert all(a[i] == b[j] for i, j in got) and got == sorted(got) and [j for _, j in got] == sorted({j for _, j in got})
        assert len(got) == longest_common(a, b)
        a, b = [-1, *a, *a, -2], [-3, *b, *b, -4]  # no line occurs once in both, and no ends are common
        assert len(line_dedup.patience(a, b)) == longest_common(a, b)
    assert line_dedup.doomed([1, 9, 2, 9, 3], [4, 9, 5], [3, 8, 3]) == [1]
    assert line_dedup.doomed([1, 7, 8, 2], [3, 7, 8, 4, 7, 8, 5], [3] * 7) in ([1, 2], [4, 5])
    long = line_dedup.common(list(range(2000)) * 2, list(range(2000)) * 3)
    assert len(long) == 4000


def test_lines_against_shared_runs(spark):
    """Documents whose shared lines come in one order have one alignment: what goes is each run that an earlier document has, found by comparing places."""
    rng = random.Random(4)
    common = [" ".join(str(rng.randrange(50)) for _ in range(rng.randrange(1, 6))) + f" c{k}" for k in range(25)]
    docs = []
    for i in range(50):
        own = [f"own {i} {k} of many words" for k in range(rng.randrange(3))]
        lines = sorted(rng.sample(range(25), rng.randrange(12)))
        docs.append([*own, *(common[k] for k in lines)] if i % 3 else [common[k] for k in lines] + own)
    docs += docs[:3]
    want = []
    for i, d in enumerate(docs):
        gone = set()
        for earlier in docs[:i]:
            at = {x: k for k, x in enumerate(earlier)}
            run = []
            for k in range(len(d) + 1):
                if k < len(d) and d[k] in at and (not run or at[d[k]] == at[d[run[-1]]] + 1):
                    run.append(k)
                    continue
                if sum(len(d[j].split()) for j in run) >= 5:
                    gone |= set(run)
                run = [k] if k < len(d) and d[k] in at else []
        want.append((i, len(d) if d else 0, len(gone), hashlib.sha256("\n".join(x for k, x in enumerate(d) if k not in gone).encode()).hexdigest()))
    rows = [(i, rng.choice(["", "\t", "  "]).join(["", "\n".join(d)]) if i % 2 else "\n".join(d), *[None] * 7) for i, d in enumerate(docs)]
    got = sorted(rows_of(line_dedup.digests(table(spark, rows))))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got if r[0] % 2 == 0] == [r[3] for r in want if r[0] % 2 == 0] and any(r[2] for r in got)


def lines_gone(rows):
    """(id, lines, places that go): each document is aligned with every one of a smaller id."""
    docs = [(i, text.split("\n") if text else []) for i, text, *_ in rows]
    keys = [[x.strip(" \t\r\x0b\x0c") for x in d] for _, d in docs]
    for n, (i, d) in enumerate(docs):
        yield i, d, {k for m in range(len(docs)) if docs[m][0] < i for k in line_dedup.doomed(keys[m], keys[n], [len(x.encode().split()) for x in d])}


def lines_left(rows):
    return {i: "\n".join(x for k, x in enumerate(d) if k not in gone) for i, d, gone in lines_gone(rows)}


def lines_all_pairs(rows):
    return sorted((i, len(d), len(gone), hashlib.sha256("\n".join(x for k, x in enumerate(d) if k not in gone).encode()).hexdigest()) for i, d, gone in lines_gone(rows))


def test_lines_that_many_documents_share(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PARTNERS", 1)
    monkeypatch.setattr(line_dedup, "GROWTH", 2)
    own = lambda i: f"what only document {i} says here"
    line, a, b = "a line that many documents share", "first block of some words here", "second block of some words here"
    twice = [[line, own(0), line, own(1)], *([own(i), line, own(-i)] for i in range(2, 8))]
    turned = [[own(10), a, own(11), b, own(12)], *([own(i), b, own(-i), a, own(100 + i)] for i in range(13, 22))]
    short = [["p q r", *x, "s t u", own(60 + k)] for k, x in enumerate([["x"], [], [], ["x"], [], ["y"], []])]
    rng = random.Random(7)
    lines = ["", "one two", "three four", *(f"frequent line of some words {k}" for k in range(5))]
    mixed = [[rng.choice(lines) if rng.random() < 0.8 else f"own {rng.random()} of some many words" for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    rows = [(i, "\n".join(x), *[None] * 7) for i, x in enumerate([*twice, *turned, *short, *mixed, *mixed[:5], *mixed[:2]])]
    got = sorted(rows_of(line_dedup.digests(table(spark, rows))))
    assert got == lines_all_pairs(rows)
    assert all(r[2] == 1 for r in got[1:7]) and all(r[2] == 2 for r in got[9:17])


def test_lines_odd_rows(spark):
    got = rows_of(line_dedup.digests(table(spark)))
    assert len(got) == len(odd_rows()) and line_dedup.digests(table(spark, [])).count() == 0
    by_id = {r[0]: r for r in got}
    assert by_id[None][2] == 0 and by_id[0][1:3] == (0, 0)
    texts = [r.text for r in line_dedup.without_repeats(table(spark)).where("doc_id is not null").collect()]
    assert all(x is None or x.strip() or x in ("", "   \n\t ") for x in texts)


@pytest.mark.parametrize("block", [2048, 7])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "PER_PIVOT", 12)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(15, 8))
    rows = [(i, (base[i % 15] + rng.normal(size=8) * rng.choice([0, 0.05, 0.1, 0.2])).tolist(), i % 3) for i in range(120)]
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [1.0, None] + [0.0] * 6, 1), (203, [float("nan")] * 8, 1), (204, rows[0][1], None), (205, [1.0, 2.0], 0), (206, [2.0, 4.0], 0), (207, [], 0), rows[5], (None, rows[0][1], 0)]
    got = {}
    for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    good = [k for k, (_, v, y) in enumerate(rows) if y is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    links = [(a, b) for a in good for b in good if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and cos(rows[a][1], rows[b][1]) >= 0.98]
    group = least(range(len(rows)), links)
    for k, (i, _, _) in enumerate(rows):
        top = min((rows[x][0] for x in group if group[x] == group[k] and rows[x][0] is not None), default=None)
        assert (sum(a == k for a, _ in links), top, i is not None and i == top) in got[i]
    assert sum(map(len, got.values())) == len(rows)
