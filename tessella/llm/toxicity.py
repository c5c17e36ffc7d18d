"""Toxicity from a learned lexicon, its misspellings, and the words around them.

Learning. From a bounded sample of labelled rows (SAMPLE of either label, the first by a hash of the id; held-out rows never), terms are
counted by label in Spark. Terms that the label favours are candidates; a greedy cover keeps those that explain toxic documents that no
kept term explains, so that chance words of copied documents stay out. The lexicon's trie is intersected with the Levenshtein automaton
of the word at hand: one edit for terms of five letters or more, two for ten or more. The intersection is made deterministic as words
ask for it, so most words are refused after a few letters. Words near a term that clean documents use are remembered as no misspelling.
Every hit is scored by the window of words around it: whether it stands inside quotation marks, and the learned weights of its
neighbours, which tell quotation from abuse. A logistic regression joins these into a score.

Scoring is one pass over all documents without a shuffle; labels, lang, source and ids are no inputs of it.

Rows: null and empty texts have no hits and get the score of such a text; null labels teach nothing, and of several labels for an id the
largest counts; repeated rows and null ids are scored a row each; other columns are ignored. Without any toxic label every score is low.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Recent, binary_text, cut, forget, is_train, mapped, slices, words

SAMPLE = 10_000  # labelled rows of either label that a model is fitted on, at most
LEAST_DOCS, LEAST_LIFT, LEAST_GAIN = 3, 8.0, 3
WINDOW, NEIGHBOURS, NEIGHBOUR_SEEN = 5, 200, 20
EDGES = ".,;:!?()[]{}<>*_-~#/\\|"
QUOTES = "\"'`«»„“”‚‘’‹›"


def edits(term: str) -> int:
    return 2 if len(term) >= 10 else 1 if len(term) >= 5 else 0


class Trie:
    """A lexicon's trie, and its product with Levenshtein automata, made deterministic on demand.

    A state is a set of (trie node, edits so far); a letter leads on by itself, by replacing a letter, or as one too many; a letter too
    few is followed at once.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.allowed = [0]  # the most edits of any term below
        for t in terms:
            node = 0
            self.allowed[0] = max(self.allowed[0], edits(t))
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], edits(t))
            self.term[node] = t
        self._clear()

    def _clear(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: dict[tuple[int, str], int] = {}
        self.dead, self.start = self._state({}), self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The state's number, after letters too few are allowed for."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            e = reached[node] + 1
            for child in self.children[node].values():
                if e <= self.allowed[child] and e < reached.get(child, 9):
                    reached[child] = e
                    todo.append(child)
        key = frozenset(reached.items())
        at = self.states.setdefault(key, len(self.sets))
        if at == len(self.sets):
            self.sets.append(key)
        return at

    def _next(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.allowed[node] and e < reached.get(node, 9):
                reached[node] = e

        for node, e in self.sets[state]:
            reach(node, e + 1)
            for c, child in self.children[node].items():
                reach(child, e + (c != letter))
        return self._state(reached)

    def nearest(self, word: str) -> tuple[str, int] | None:
        """The term nearest to word and its distance, if it is near enough; of several the first by spelling."""
        if len(self.sets) > 100_000:
            self._clear()
        state, dead = self.start, self.dead
        for letter in word:
            at = self.step.get((state, letter))
            if at is None:
                at = self.step[state, letter] = self._next(state, letter)
            if at == dead:
                return None
            state = at
        found = [(e, t) for node, e in self.sets[state] if (t := self.term[node]) is not None and e <= edits(t)]
        return (min(found)[1], min(found)[0]) if found else None


@dataclass
class Model:
    """What scoring needs; bounded by the sample."""

    lexicon: list[str] = field(default_factory=list)
    not_misspelt: frozenset[str] = frozenset()
    neighbours: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = 0.0


FEATURES = 6


def term_of(word: bytes) -> str:
    return word.decode().lower().strip(EDGES + QUOTES)


class Scorer:
    """Features of a text under a model; words are looked up once and remembered."""

    def __init__(self, model: Model):
        self.model, self.trie = model, Trie(model.lexicon)
        self.kinds = Recent(self._kind)

    def _kind(self, word: bytes) -> int:
        """0: no term, 1: a term, 2: a misspelt one."""
        term = term_of(word)
        found = self.trie.nearest(term) if term else None
        if found is None or (found[1] and term in self.model.not_misspelt):
            return 0
        return 2 if found[1] else 1

    def hits(self, ws: list[bytes]) -> list[tuple[int, int]]:
        """(place, kind)."""
        kinds = list(map(self.kinds.__getitem__, ws))
        return [(i, k) for i, k in enumerate(kinds) if k] if any(kinds) else []

    def quoted(self, ws: list[bytes], i: int) -> bool:
        """Whether a quotation mark opens up to a window before the hit and one closes up to a window after it."""
        before = [w.decode() for w in ws[max(0, i - WINDOW) : i + 1]]
        after = [w.decode() for w in ws[i : i + WINDOW + 1]]
        return any(w[0] in QUOTES for w in before) and any(w.rstrip(EDGES)[-1:] in QUOTES for w in after if w.rstrip(EDGES))

    def features(self, text: bytes | None) -> list[float]:
        ws = words(text)
        found = self.hits(ws)
        direct, near, quoted, around = 0, 0, 0, 0.0
        for i, kind in found:
            around += sum(self.model.neighbours.get(term_of(w), 0.0) for w in ws[max(0, i - WINDOW) : i + WINDOW + 1]) if self.model.neighbours else 0.0
            if self.quoted(ws, i):
                quoted += 1
            elif kind == 1:
                direct += 1
            else:
                near += 1
        return [float(direct > 0), np.log1p(direct), np.log1p(near), np.log1p(quoted), around / max(1, len(found)), 100 * direct / (len(ws) + 100)]


    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        m = self.model
        x = np.array([self.features(t) for t in texts]).reshape(-1, FEATURES)
        return np.clip((x - m.mean) / m.scale @ m.weights + m.bias, -30, 30)


def cover(docs: list[tuple[int, list[str]]], clean: Counter) -> list[str]:
    """Terms chosen one by one: each by the toxic documents that it alone adds, less those clean documents that have it."""
    where = defaultdict(set)
    for k, (toxic, terms) in enumerate(docs):
        if toxic:
            for t in terms:
                where[t].add(k)
    chosen, price = [], {t: 3 * clean[t] for t in where}
    waiting = sorted(((price[t] - len(ks), t) for t, ks in where.items()))
    covered: set[int] = set()
    heapq.heapify(waiting)
    while waiting:
        _, t = heapq.heappop(waiting)
        gain = len(where[t] - covered) - price[t]
        if waiting and -gain > waiting[0][0]:
            if gain >= LEAST_GAIN:
                heapq.heappush(waiting, (-gain, t))
            continue
        if gain < LEAST_GAIN:
            break
        chosen.append(t)
        covered |= where[t]
    return sorted(chosen)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method with a ridge on the weights."""
    x = np.c_[x, np.ones(len(x))]
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, held: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the training rows of labels: those whose crc32(id as text) mod 5 is not `held`."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(is_train("doc_id", held) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = F.broadcast(first(0).unionByName(first(1)))  # at most 2 * SAMPLE rows
    texts = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), binary_text(text_col).alias("text")).join(sample, "doc_id").select("text", "toxic"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in slices(batches, 0):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([sorted({term_of(w) for w in words(t)} - {""}) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], names=["toxic", "terms"])

    by_doc = cut(mapped(texts, terms, "toxic int, terms array<string>"))
    total = {r["toxic"]: r["count"] for r in by_doc.groupBy("toxic").count().collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    model = Model(bias=float(np.log((n1 + 0.5) / (n0 + n1 + 1) / (1 - (n1 + 0.5) / (n0 + n1 + 1)))))
    if not n0 or not n1:
        model.bias = min(model.bias, -1.0) if not n1 else model.bias
        return model
    counted = cut(by_doc.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
    likely = counted.where((F.col("t") >= LEAST_DOCS) & ((F.col("t") + 0.5) / (n1 + 1) >= LEAST_LIFT * (F.col("c") + 0.5) / (n0 + 1)))
    candidates = {r["term"]: r["c"] for r in likely.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(terms=[[t for t in ts if t in shared.value] for ts in b["terms"]])
            yield b[(b["toxic"] == 1) & (b["terms"].map(len) > 0)]

    model.lexicon = cover([(r["toxic"], r["terms"]) for r in by_doc.mapInPandas(only, by_doc.schema).collect()], Counter(candidates))
    lexicon = model.lexicon

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(lexicon)
        for b in batches:
            yield b[[(f := trie.nearest(t)) is not None and f[1] > 0 for t in b["term"]]]

    used = counted.where("c > 0").mapInPandas(near, counted.schema).where((F.col("t") + 0.5) / (n1 + 1) < LEAST_LIFT * (F.col("c") + 0.5) / (n0 + 1))
    model.not_misspelt = frozenset(r["term"] for r in used.select("term").collect())

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in slices(batches, 0):
            out = []
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(text)
                near_by = {j for i, _ in scorer.hits(ws) for j in range(max(0, i - WINDOW), min(len(ws), i + WINDOW + 1)) if not scorer.kinds[ws[j]]}
                out += [(toxic, t) for t in {term_of(ws[j]) for j in near_by} if t]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([t for _, t in out], pa.string())], names=["toxic", "term"])

    beside = mapped(texts, windows, "toxic int, term string").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    odds = F.log((F.col("t") + 5) / (n1 + 10)) - F.log((F.col("c") + 5) / (n0 + 10))
    beside = beside.where((F.col("t") + F.col("c") >= NEIGHBOUR_SEEN) & (F.col("c") > 0)).select("term", odds.alias("w")).orderBy(F.desc(F.abs("w")), "term").limit(NEIGHBOURS)
    model.neighbours = {r["term"]: r["w"] for r in beside.collect()}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in slices(batches, 0):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([list(map(float, scorer.features(t))) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = mapped(texts, measured, "toxic int, x array<double>").toPandas()  # at most 2 * SAMPLE rows of FEATURES numbers
    x, y = np.stack(rows["x"]), rows["toxic"].to_numpy(float)
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    model.weights, model.bias = logistic((x - model.mean) / model.scale, y)
    return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.withColumn(text_col, binary_text(text_col)).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-scorer.logits(b.column(1).to_pylist()))))], names=["id", "score"])

    return mapped(given, run, "id long, score double").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted)."""
    out = scores(docs, fit(docs, labels, held, id_col, text_col), id_col, text_col)
    return out.select(id_col, (~is_train(id_col, held)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, held: int = 0, text_col: str = "text") -> DataFrame:
    """docs without the rows whose texts score 0.5 or more."""
    model = fit(docs, labels, held, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scorer = Scorer(shared.value)
        for b in slices(batches, 0):
            row = b.column(1).filter(pa.array(scorer.logits(b.column(0).to_pylist()) < 0))
            yield pa.RecordBatch.from_arrays(row.flatten(), names=[f.name for f in row.type])

    given = docs.select(binary_text(f"`{text_col}`"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return mapped(given, keep, docs.schema)
