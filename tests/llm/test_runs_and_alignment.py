"""Periodic runs by brute force, token alignment and byte-level encoding against the libraries on whole texts."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import SCHEMA, odd_rows, rows_of, table

from tessella.llm import byte_codec, periodic_runs, token_alignment
from tessella.llm.bpe import BYTE_BPE


def sha(data):
    return hashlib.sha256(data).hexdigest()


def runs_brute(ws, least, exponent):
    out = []
    for q in range(1, len(ws) // exponent + 1):
        k = 0
        while k < len(ws) - q:
            if ws[k] == ws[k + q]:
                start = k
                while k < len(ws) - q and ws[k] == ws[k + q]:
                    k += 1
                x = ws[start : k + q]
                if len(x) >= max(least, exponent * q) and not any(x[r:] == x[: len(x) - r] for r in range(1, q)):
                    out.append((start, len(x), q))
            k += 1
    return sorted(out)


def repeating(rng):
    ws = []
    for _ in range(rng.randrange(8)):
        ws += [rng.choice("abcd") for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 7)
        if rng.random() < 0.3:
            ws += ws[-rng.randrange(1, 40) :]
    return [x.encode() for x in ws]


def test_runs():
    rng = random.Random(1)
    for _ in range(400):
        ws = repeating(rng)
        for least, exponent in ((24, 3), (8, 2), (6, 3), (24, 2)):
            assert periodic_runs.runs_of(ws, least, exponent) == runs_brute(ws, least, exponent)
    assert periodic_runs.strongest([(9, 24, 8), (0, 30, 10), (0, 27, 9)]) == (0, 27, 9)
    assert periodic_runs.strongest([]) is None


def runs_row(i, text):
    ws = (text or "").encode().split()
    h = zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and ws:
        g, n = h // 10, len(ws)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[k] if k < a else ws[a + (k - a) % p] for k in range(n)]
    runs = runs_brute(ws, 24, 3)
    keep = set(range(len(ws))) - {k for s, n, p in runs for k in range(s + p, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    return (i, len(runs), *best, runs and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2]))).encode()), sha(b" ".join(w for k, w in enumerate(ws) if k in keep)))


def test_run_digests(spark):
    rng = random.Random(2)
    rows = odd_rows()
    rows += [(100 + k, " ".join(map(bytes.decode, repeating(rng))), *[None] * 7) for k in range(60)]
    got = rows_of(periodic_runs.digests(table(spark, rows)))
    assert sorted(map(str, got)) == sorted(str(runs_row(i, t)) for i, t, *_ in rows)
    assert sum(r[1] > 0 for r in got) > 20 and any(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in got)
    assert periodic_runs.digests(table(spark, [])).count() == 0


def test_runs_and_collapsed_texts(spark):
    text = "head " + "one two three " * 9 + "tail"
    df = table(spark, [(1, text, *[None] * 7), (None, None, *[None] * 7)])
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(df).collect()}
    assert got == {1: [(1, 27, 3)], None: []}
    assert {r.doc_id: r.text for r in periodic_runs.collapse(df).collect()} == {1: "head one two three tail", None: ""}


PARTS = ["a", "B", "é", "日本", "1", "²", "'", "s", "'re", " ", "  ", "\n", "\t", "\xa0", chr(0x3000), "\x1c", "\x85", "!", "<|endoftext|>", "<s>", "<0x0A>", "😀", "\r\n", "\r", ";", " " * 5, "\n" * 3, "\0", "the", "ing", "tion", "▁", "\x0b", "e" + chr(0x301)]
COMMON = [p for p in PARTS if p not in ("▁", "\xa0", "\x85", "\x1c", chr(0x3000))]


def mixed_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS if rng.random() < 0.2 else COMMON) for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def aligner():
    return token_alignment.Aligner(BYTE_BPE, token_alignment.PIECES)


def align_brute(c, text):
    """Ids of A and B, the places that end together, and the groups, from whole texts."""
    data = (" " + text).encode()
    a, b = c.a.encode(" " + text, add_special_tokens=False).ids, c.b.encode(text)
    if not text or b"".join(c.a_bytes[k] for k in a) != data or b"".join(c.b_bytes[k] for k in b) != data:
        return [], [], [], ""
    at = {e: k for k, e in enumerate(np.cumsum([len(c.a_bytes[k]) for k in a]).tolist())}
    links = [(at[e], k) for k, e in enumerate(np.cumsum([len(c.b_bytes[k]) for k in b]).tolist()) if e in at]
    groups, x, y = [], 0, 0
    for i, j in links:
        groups.append(",".join(map(str, a[x : i + 1])) + "|" + ",".join(map(str, b[y : j + 1])))
        x, y = i + 1, j + 1
    return a, b, links, ";".join(groups)


def test_merge_path():
    rng = np.random.default_rng(4)
    for work in (1, 2, 3, 7, 50):
        for _ in range(60):
            a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 30))) for _ in range(2))
            i, j = token_alignment.merged(a, b, work)
            assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
            x, y = token_alignment.crossings(a, b, work)
            assert (x[-1], y[-1]) == (len(a), len(b)) and set(np.diff(x + y)[:-1].tolist()) <= {work}
            merged = sorted([(v, 0) for v in a.tolist()] + [(v, 1) for v in b.tolist()])
            assert all(sum(s == 0 for _, s in merged[: p + q]) == p for p, q in zip(x.tolist(), y.tolist(), strict=True))


@pytest.mark.parametrize("work", [1, 3, 1 << 14])
def test_aligned_texts(aligner, work):
    for seed in range(6):
        texts = mixed_texts(seed, 60)
        x = aligner.align([t.encode() for t in texts], work)
        written, at = aligner.written_groups(x), x.link_at
        for k, t in enumerate(texts):
            a, b, links, groups = align_brute(aligner, t)
            assert (x.a[x.a_at[k] : x.a_at[k + 1]].tolist(), x.b[x.b_at[k] : x.b_at[k + 1]].tolist()) == (a, b), t
            assert [(i - x.a_at[k], j - x.b_at[k]) for i, j in zip(x.i[at[k] : at[k + 1]].tolist(), x.j[at[k] : at[k + 1]].tolist(), strict=True)] == links
            assert written[k].decode() == groups


@pytest.mark.parametrize("head", [1 << 18, 20, 0])
def test_alignment_digests(spark, aligner, head):
    rows = odd_rows() + [(100 + k, t, *[None] * 7) for k, t in enumerate(mixed_texts(9, 60))]
    found = [(i, align_brute(aligner, t or "")) for i, t, *_ in rows]
    pairs = Counter((a[x], b[y]) for _, (a, b, links, _) in found for x, y in links)
    most = {}
    for (_, b), n in pairs.items():
        most[b] = max(n, most.get(b, 0))
    want = []
    for i, (a, b, links, groups) in found:
        held = [(a[x], b[y]) for x, y in links]
        want.append((i, len(a), len(b), len(links), len(links), sum(pairs[p] == most[p[1]] for p in held), sum(pairs[p] for p in held), sha(groups.encode()) if groups else ""))
    got = rows_of(token_alignment.digests(table(spark, rows), head=head))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert token_alignment.digests(table(spark, []), head=head).count() == 0


def test_links_of_tokens(spark, aligner):
    for r in token_alignment.links(table(spark)).where("doc_id between 0 and 9").collect():
        text = {i: t for i, t, *_ in odd_rows()}[r.doc_id] if r.doc_id != 9 else None
        if text is not None:
            a, b, links, _ = align_brute(aligner, text)
            assert (r.a_ids, r.b_ids, [tuple(x) for x in r.links]) == (a, b, links)


def test_byte_codec_in_parts():
    c, small = byte_codec.Codec(byte_codec.RANKS), byte_codec.Codec(byte_codec.RANKS, part=20)
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice([*PARTS, "x" * 9, " " * 12, "\n" * 11, chr(0x2028) * 11]) for _ in range(rng.randrange(40)))
        ids = small.encode(text)
        assert ids == c.library.encode_ordinary(text) and small.decode(ids) == text.encode()
    for text in ("\n" * 1_200_000 + "x", " " * 1_200_000, "x" * 1_200_000, "a b'" * 300_000):
        assert c.decode(c.encode(text)) == text.encode()


def test_byte_codec_digests(spark):
    c = byte_codec.Codec(byte_codec.RANKS)
    want = []
    for i, t, *_ in odd_rows():
        ids = c.library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(str, rows_of(byte_codec.digests(table(spark))))) == sorted(map(str, want))
    assert byte_codec.digests(table(spark, [])).count() == 0
    back = byte_codec.decode(byte_codec.encode(table(spark)))
    assert Counter((r.doc_id, bytes(r.data)) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t, *_ in odd_rows())
    assert SCHEMA and byte_codec.decode(spark.createDataFrame([(1, None), (2, [0xFF, 0x5A])], "doc_id long, ids array<int>")).count() == 2
