"""Substring dedup by repeated-phrase automata.

A word goes if a window of WINDOW words that covers it also starts in a document with a smaller id; windows are judged on the input.

1. Find. Every window is marked by the least hash of its GRAM-word grams, so equal windows have equal marks, and a document has about a
   quarter as many marks as words. Marks that different texts share are found by one grouping; a Bloom filter of them (fixed size; a
   false positive costs work only) is broadcast.
2. Confirm. All documents are read again; around each shared mark the stretch of words that its windows cover is a segment. Segments are
   dealt by mark into shards of bounded size. In a shard, a text that occurs in two documents is a confirmed phrase; where a mark has
   several texts, so are the windows that two of them share. A phrase's owner is the least document that has it.
   A mark with more than SHARD texts isn't dealt: each window of its texts is confirmed and located by grouping on the window's words.
3. Locate. The shard's phrases are compiled into an Aho-Corasick automaton over words, and its segments are streamed through it, each
   distinct text once. Hits return to all occurrences of the segment, and those whose owner comes before the document cover its words.

Exact copies share all marks and yet none with another text, so a group of copies makes no segments: all but its least lose all words.

Rows: null and empty texts have no words; fewer words than a window are never covered; a row with a null id is kept whole and owns
nothing; rows of equal id and text are judged alike, and rows of equal id never cover each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bloom
from tessella.llm.common import TO_SPACES, U64, Words, binary_text, cut, mapped, ngram_hashes, slices, word_table

WINDOW, GRAM = 13, 7
SHARD = 10_000  # segments
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def spaced(text: bytes | None) -> bytes:
    """The text's words, joined by one space."""
    s = (text or b"").translate(TO_SPACES)
    return b" ".join(s.split()) if b"  " in s or s[:1] == b" " or s[-1:] == b" " else s


def marks(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The marks of the texts in order, and the first and last window of each, as places among all words."""
    n = len(w.hashes) - WINDOW + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    least, size = ngram_hashes(w.hashes, GRAM), 1
    while size < WINDOW - GRAM + 1:  # of all grams of a window
        step = min(size, WINDOW - GRAM + 1 - size)
        least, size = np.minimum(least[:-step], least[step:]), size + step
    at = np.flatnonzero(w.owner[:n] == w.owner[WINDOW - 1 :])
    least, owner = least[at], w.owner[at]
    first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]) if len(at) else at
    return least[first].view(np.int64), at[first], at[np.r_[first[1:], len(at)] - 1] if len(at) else at


class Letters(dict):
    """A letter for each word, so that a passage is a string of the automaton's alphabet."""

    def __missing__(self, word: bytes) -> str:
        self[word] = out = chr(len(self) + 1)
        return out


def confirmed(coded: list[str], texts: list[tuple[int, bytes, int, int]]) -> dict[str, int]:
    """The shard's phrases and the least document that has each: texts of two documents, and windows that two texts of a mark share."""
    owner = {c: least for c, (_, _, least, most) in zip(coded, texts, strict=True) if least != most}
    times = Counter(mark for mark, *_ in texts)
    seen: dict[str, int] = {}
    for c, (mark, _, least, _) in zip(coded, texts, strict=True):
        if times[mark] > 1:
            for k in range(len(c) - WINDOW + 1):
                w = c[k : k + WINDOW]
                first = seen.get(w)
                if first is None:
                    seen[w] = least
                else:
                    owner[w] = seen[w] = min(first, least)
    return owner


def hits(texts: list[tuple[int, bytes, int, int]]) -> list[tuple[int, int, int, int]]:
    """(segment, first word, end, owner) of the phrases in a shard's segments, joined where they overlap. texts: (mark, text, least id, greatest id), each text once."""
    letters = Letters()
    coded = ["".join(map(letters.__getitem__, text.split())) for _, text, _, _ in texts]
    owner = confirmed(coded, texts)
    if not owner:
        return []
    automaton = ahocorasick.Automaton()
    for phrase, doc in owner.items():
        automaton.add_word(phrase, (len(phrase), doc))
    automaton.make_automaton()
    out = []
    for i, (c, (_, _, _, most)) in enumerate(zip(coded, texts, strict=True)):
        spans: dict[int, tuple[int, int]] = {}
        for end, (n, doc) in automaton.iter(c):
            if doc < most:
                first = end + 1 - n
                if doc in spans:
                    a, b = spans[doc]
                    if first <= b:
                        first = min(a, first)
                    else:
                        out.append((i, a, b, doc))
                spans[doc] = first, end + 1
        out += [(i, a, b, doc) for doc, (a, b) in spans.items()]
    return out


def parted(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of marks with at most SHARD rows, which may share a task, and those of the others."""
    many = cut(texts.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).select("f"))
    return texts.join(many, "f", "left_anti"), texts.join(many, "f", "left_semi")


def located_by_window(texts: DataFrame) -> DataFrame:
    """(q, first, end, owner) of every window of the texts that has an owner before the text's greatest id; no group is held in memory."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, at, out = [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                ws = text.split()
                for i in range(len(ws) - WINDOW + 1):
                    of.append(k)
                    at.append(i)
                    out.append(b" ".join(ws[i : i + WINDOW]))
            own = [b.column(c).take(pa.array(of, pa.int64())) for c in ("q", "least", "most")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(at, pa.int32()), pa.array(out, pa.binary())], names=["q", "least", "most", "first", "w"])

    each = texts.groupBy("q", "text").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    each = cut(mapped(each.select("q", "text", "least", "most"), windows, "q long, least long, most long, first int, w binary"))
    owners = cut(each.groupBy("w").agg(F.min("least").alias("owner"), F.max("most").alias("last")).where("owner < last").select("w", "owner"))  # written, so that the join of a frequent window can be split
    return each.join(owners, "w").where("owner < most").select("q", "first", (F.col("first") + WINDOW).cast("int").alias("end"), "owner")


def covered(docs: DataFrame) -> DataFrame:
    """(id, t, spans): the covered places [first, end) of each document that has any. docs: (id, text binary, t), t the text's hash."""
    docs = docs.where("id is not null").select("id", "text", "t")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each mark of a part of a batch, with the least and the greatest of the texts that have it."""
        for b in slices(batches):
            w = word_table(b.column(1).to_pylist())
            f, first, _ = marks(w)
            t = b.column(2).to_numpy()[w.owner[first]]
            by = np.lexsort((t, f))
            f, t = f[by], t[by]
            start = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else by
            yield pa.RecordBatch.from_arrays([pa.array(f[start]), pa.array(t[start]), pa.array(t[np.r_[start[1:], len(f)] - 1] if len(f) else t)], names=["f", "a", "b"])

    shared = mapped(docs, mark, "f long, a long, b long").groupBy("f").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("f")
    filled = docs.sparkSession.sparkContext.broadcast(bloom.build(cut(shared), "f"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An occurrence a row (q, id, t, start), and for each distinct text of a part of the batch a row (q, f, text, least, most)."""
        names = ["q", "id", "t", "start", "f", "text", "least", "most"]
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            w = word_table(texts)
            f, first, last = marks(w)
            at = np.flatnonzero(bloom.contains(filled.value, f))
            f, first, last = f[at], first[at], last[at]
            of = w.owner[first]
            found = [spaced(texts[k][i:j]) for k, i, j in zip(of.tolist(), w.begin[first].tolist(), w.end[last + WINDOW - 1].tolist(), strict=True)]
            q = np.fromiter(map(xxhash.xxh3_64_intdigest, found), U64, len(found)).view(np.int64)
            doc, n = b.column(0).to_numpy()[of], len(q)
            start = (first - (np.cumsum(w.sizes) - w.sizes)[of]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(doc), pa.array(b.column(2).to_numpy()[of]), pa.array(start), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
            by = np.lexsort((doc, q))
            start = np.flatnonzero(np.r_[True, q[by][1:] != q[by][:-1]]) if n else by
            one, end = by[start], by[np.r_[start[1:], n] - 1] if n else by
            n = len(one)
            yield pa.RecordBatch.from_arrays([pa.array(q[one]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(f[one]), pa.array([found[k] for k in one.tolist()], pa.binary()), pa.array(doc[one]), pa.array(doc[end])], names=names)

    found = cut(mapped(docs, segments, "q long, id long, t long, start int, f long, text binary, least long, most long"))
    texts = found.where("text is not null").select("q", "f", "text", "least", "most")
    n_shards = 1 + texts.count() // SHARD

    def locate(rows: pd.DataFrame) -> pd.DataFrame:
        by_q = rows.groupby("q", sort=True).agg({"f": "first", "text": "first", "least": "min", "most": "max"})
        out = hits(list(zip(by_q["f"].tolist(), by_q["text"], by_q["least"].tolist(), by_q["most"].tolist(), strict=True)))
        q = by_q.index.to_numpy()
        return pd.DataFrame({"q": q[[x[0] for x in out]] if out else [], "first": [x[1] for x in out], "end": [x[2] for x in out], "owner": [x[3] for x in out]})

    few, many = parted(texts)
    located = few.withColumn("shard", F.pmod(F.xxhash64("f"), F.lit(n_shards))).groupBy("shard").applyInPandas(locate, "q long, first int, end int, owner long")
    located = located.unionByName(located_by_window(many))
    places = found.where("text is null").select("q", "id", "t", "start").join(located, "q").where("owner < id")
    spans = places.select("id", "t", F.struct(F.col("start") + F.col("first"), F.col("start") + F.col("end")).alias("span"))
    return spans.groupBy("id", "t").agg(F.collect_set("span").alias("spans"))


def verdicts(docs: DataFrame) -> DataFrame:
    """(id, t, spans, copy) of each document that loses words; copy: an earlier document has the same text."""
    least = cut(docs.where("id is not null").groupBy("t", F.length("text").alias("size")).agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most"))
    copies = docs.where("id is not null").select("id", "t", F.length("text").alias("size")).join(least, ["t", "size"]).where("id > least").select("id", "t").distinct().withColumn("copy", F.lit(True))
    spans = covered(docs)
    return cut(spans.join(copies, ["id", "t"], "full").select("id", "t", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"), F.coalesce("copy", F.lit(False)).alias("copy")))


def gone(n: int, spans: list[dict], copy: bool) -> np.ndarray:
    """Which of n words are covered."""
    out = np.full(n, copy and n >= WINDOW)
    if not copy:
        for s in spans or []:
            a, b = s.values()
            out[a:b] = True
    return out


def kept_text(text: bytes, spans: list[dict], copy: bool) -> bytes:
    """The text without its covered words and the white space after them; the rest stands as it was."""
    found = list(WORD.finditer(text))
    out = gone(len(found), spans, copy)
    parts, at = [], 0
    for k in np.flatnonzero(out).tolist():
        parts.append(text[at : found[k].start()])
        at = found[k + 1].start() if k + 1 < len(found) else len(text)
    return b"".join([*parts, text[at:]])


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), binary_text(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("t"))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row. Only texts that may lose words travel to their verdicts."""
    docs = keyed(df, id_col, text_col)
    found = verdicts(docs)
    key = F.xxhash64("id", "t")
    filled = df.sparkSession.sparkContext.broadcast(bloom.build(found.select(key.alias("key")), "key"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            maybe = bloom.contains(filled.value, b.column(3).to_numpy(zero_copy_only=False)).tolist()
            texts = b.column(1).to_pylist()
            done = [None if m else spaced(t) for t, m in zip(texts, maybe, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([t if m else None for t, m in zip(texts, maybe, strict=True)], pa.binary()), pa.array([s if s is None else s.count(b" ") + bool(s) for s in done], pa.int64()), pa.array([s if s is None else hashlib.sha256(s).hexdigest() for s in done], pa.string())], names=["id", "t", "text", "n_words", "kept_sha256"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, removed, shas = b.column(2).to_pylist(), [], b.column(3).to_pylist()
            for k, (text, spans, copy) in enumerate(zip(b.column(1).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                if n[k] is None:
                    ws = (text or b"").split()
                    out = gone(len(ws), spans, bool(copy))
                    n[k], shas[k] = len(ws), hashlib.sha256(b" ".join([w for w, x in zip(ws, out.tolist(), strict=True) if not x])).hexdigest()
                    removed.append(int(out.sum()))
                else:
                    removed.append(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])

    ready = mapped(docs.select("id", "text", "t", key.alias("key")), first, "id long, t long, text binary, n_words long, kept_sha256 string")
    out = ready.join(found, ["id", "t"], "left").select("id", "text", "n_words", "kept_sha256", "spans", "copy")
    return mapped(out, last, "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """df with the covered words taken out of its texts; all rows and columns stay, but with drop_emptied a row that loses its last word goes."""
    found = verdicts(keyed(df, id_col, text_col)).select("id", "t", F.struct("spans", "copy").alias("found"))
    given = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"))
    joined = given.join(found, ["id", "t"], "left").select(binary_text(f"row.`{text_col}`").alias("text"), "found", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            given, verdict = b.column(0).to_pylist(), b.column(1).to_pylist()
            texts = [t if t is None or s is None else kept_text(t, s["spans"], s["copy"]) for t, s in zip(given, verdict, strict=True)]
            row = b.column(2)
            columns = {f.name: x for f, x in zip(row.type, row.flatten(), strict=True)} | {text_col: pa.array(texts, pa.binary()).cast(pa.string())}
            out = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            emptied = [s is not None and bool(t and t.split()) and not x.split() for t, x, s in zip(given, texts, verdict, strict=True)]
            yield out.filter(pa.array([not e for e in emptied])) if drop_emptied else out

    return mapped(joined, run, df.schema)
