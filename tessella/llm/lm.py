"""Language-model scores from log-frequency Bloom filters.

Counting. Tokens and bigrams of the training texts are counted over the whole corpus; n-grams travel as packed hashes, one row for each
task and range of the hash space, and each range is counted on its own. Bigrams are kept from LEAST_PAIR occurrences on.

Filters. A count is kept as its level on a scale that is exact for small counts and grows by STEP above. An n-gram of level q is put in
the filter q times, once with each level from 1; a lookup probes level after level until one is missing, so an error can only raise a
count, and rarely by more than one level. A filter lies in segments, one for each range of hashes, each built by one task, with
ENTRY_BITS for each entry. Segments are broadcast in groups of at most `most_bits`, which bounds what a worker holds; where a filter has
more than one group, the texts are read once for each. Nothing is left out for lack of room: a larger corpus has more segments.

Scores. P(v | u) = (c(uv) + (K + c(u) - k(u)) P(v)) / (c(u) + K), where k(u) is the number of tokens after u whose bigram is kept, counted
over all training texts with the bigrams' own filter. c(u) and k(u) are upper ends of their levels and c(uv) the lower one, so the
probabilities of a context sum to at most one but by false positives.

The base score needs exact counts: words more frequent than a bound that leaves at most HEAD of them are broadcast, the other words of
each text are joined with their counts.

Rows: null and empty texts are the end token alone; repeated rows and null ids (training data) are rows of their own; other columns are
ignored; an empty table gives no rows; without training texts every token has the probability of an unseen one. A text of any length is
scored whole; what a worker holds is a multiple of 4 MB of text or of the longest text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import U64, binary_text, bucket_of, cut, is_train, mapped, mix, shuffle_parts, slices, word_table

STEP = 1.15
ENTRY_BITS, PROBES, MOST_BITS = 12, 6, 1 << 29
RANGE = 4_000_000  # n-grams of one range
LEAST_PAIR = 2  # occurrences
HEAD = 1 << 18
K = 4.0
MEMO = 300_000  # n-grams
START, END = U64(0x5354415254), U64(0x454E44)  # no word hashes by construction of the tokens: they stand for the borders


def scale() -> np.ndarray:
    """The least count of each level from 1."""
    out = [1]
    while out[-1] < 1 << 62:
        out.append(max(out[-1] + 1, int(out[-1] * STEP)))
    return np.array(out, np.int64)


LEVELS = scale()


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, "right")


def lower(levels: np.ndarray) -> np.ndarray:
    return np.where(levels > 0, LEVELS[np.maximum(levels - 1, 0)], 0)


def upper(levels: np.ndarray) -> np.ndarray:
    return np.where(levels > 0, LEVELS[levels] - 1, 0)


def contexts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each token; starts marks each text's first token."""
    return np.where(starts, START, np.roll(h, 1))


def pair_hashes(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bigram that ends at each token."""
    return mix(contexts(h, starts) * U64(0x9E3779B97F4A7C15) + h)


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all texts, each with its end, the text each is of, and whether it is that text's first."""
    w = word_table([t.lower() if t else None for t in texts])
    n = len(texts)
    h = np.full(len(w.hashes) + n, END)
    h[np.arange(len(w.hashes)) + w.owner] = w.hashes
    sizes = w.sizes + 1
    starts = np.zeros(len(h), bool)
    starts[np.cumsum(sizes) - sizes] = True
    return h, np.repeat(np.arange(n), sizes), starts


@dataclass
class Filter:
    """The segments `at` to `at + held` of a log-frequency Bloom filter of `segments`; first: the level from which its n-grams are kept."""

    segments: int
    segment_bits: int
    first: int
    bits: np.ndarray
    at: int = 0
    held: int = 1 << 31

    @staticmethod
    def spread(h: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each entry, from which its probes are made."""
        x = mix(h + levels.astype(U64) * U64(0xD6E8FEB86659FD93))
        return x, x << U64(32) | U64(1 << 31)

    @staticmethod
    def places(x: np.ndarray, step: np.ndarray, probe: int, segment_bits: int) -> np.ndarray:
        """The bit of each entry within its segment."""
        return ((x + step * U64(probe) >> U64(32)) * U64(segment_bits)) >> U64(32)

    def has(self, h: np.ndarray, base: np.ndarray, at_level: int) -> np.ndarray:
        """Which n-grams have the level."""
        alive = np.arange(len(h))
        x, step = self.spread(h, np.full(len(h), at_level))
        for probe in range(PROBES):
            at = base + self.places(x, step, probe, self.segment_bits)
            yes = (self.bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool)
            alive, x, step, base = alive[yes], x[yes], step[yes], base[yes]
        return alive

    def covers(self, h: np.ndarray) -> np.ndarray:
        """Whether the n-gram's segment is held."""
        segment = bucket_of(h, max(1, self.segments)).astype(np.int64) - self.at
        return (segment >= 0) & (segment < self.held)

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Which n-grams are there at all."""
        out = np.zeros(len(h), bool)
        if self.segments:
            at = np.flatnonzero(self.covers(h))
            base = (bucket_of(h[at], self.segments) - U64(self.at)) * U64(self.segment_bits)
            out[at[self.has(h[at], base, self.first)]] = True
        return out

    def probed(self, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram by probing one level after another; 0: not there."""
        out = np.zeros(len(h), np.int64)
        if not self.segments:
            return out
        segment = bucket_of(h, self.segments).astype(np.int64) - self.at
        alive, q = np.flatnonzero((segment >= 0) & (segment < self.held)), self.first
        base = np.maximum(segment, 0).astype(U64) * U64(self.segment_bits)
        while len(alive) and q < len(LEVELS):
            alive = alive[self.has(h[alive], base[alive], q)]
            out[alive] = q
            q += 1
        return out

    def levels(self, h: np.ndarray) -> np.ndarray:
        """As probed(), for sorted distinct n-grams; frequent ones, which take many probes and come again, are remembered by the worker."""
        known, known_q = self.__dict__.setdefault("memo", (np.zeros(0, U64), np.zeros(0, np.int64)))
        out = np.zeros(len(h), np.int64)
        at = np.searchsorted(known, h)
        seen = known[np.minimum(at, len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
        out[seen] = known_q[at[seen]]
        new = h[~seen]
        out[~seen] = q = self.probed(new)
        often = q > self.first + 1
        if often.any():
            if len(known) > MEMO:
                known, known_q = known[:0], known_q[:0]
            both, both_q = np.concatenate([known, new[often]]), np.concatenate([known_q, q[often]])
            by = np.argsort(both, kind="stable")
            self.memo = both[by], both_q[by]
        return out


def packed(h: np.ndarray, counts: np.ndarray, n: int) -> pd.DataFrame:
    """Sorted distinct hashes and their counts as a row for each range that has any; counts of one are left out."""
    out = []
    cuts = np.searchsorted(bucket_of(h, n), np.arange(n + 1))
    for i in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        x, c = h[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]]
        many = c > 1
        out.append((i, x[~many].tobytes(), x[many].tobytes(), c[many].astype(np.int64).tobytes()))
    return pd.DataFrame(out, columns=["range", "ones", "more", "counts"])


PACKED = "range int, ones binary, more binary, counts binary"


def summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, sorted, and the sums of their counts."""
    by = np.argsort(h)
    h, c = h[by], c[by]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of a range and their counts over all rows."""
    ones, more = (np.frombuffer(b"".join(rows[c]), U64) for c in ("ones", "more"))
    h = np.concatenate([ones, more])
    c = np.concatenate([np.ones(len(ones), np.int64), np.frombuffer(b"".join(rows["counts"]), np.int64)])
    return summed(h, c)


@dataclass
class Segments:
    """A filter as a table (range, bits), of which groups of at most most_bits are loaded at a time."""

    table: DataFrame | None
    n: int
    segment_bits: int
    first: int

    def n_groups(self, most_bits: int) -> int:
        return max(1, -(-self.n // max(1, most_bits // self.segment_bits)))

    def groups(self, most_bits: int) -> Iterator[Filter]:
        if self.table is None:
            yield Filter(0, 8, self.first, np.zeros(0, np.uint8))
            return
        each, size = max(1, most_bits // self.segment_bits), self.segment_bits // 8
        for at in range(0, self.n, each):
            held = min(each, self.n - at)
            bits = np.zeros(held * size, np.uint8)
            for r in self.table.where(F.col("range").between(at, at + held - 1)).toLocalIterator():  # at most most_bits
                bits[(r["range"] - at) * size : (r["range"] - at + 1) * size] = np.frombuffer(r["bits"], np.uint8)
            yield Filter(self.n, self.segment_bits, self.first, bits, at, held)


def build_filter(counted: DataFrame, n_ranges: int, sizes: list, first: int) -> Segments:
    """counted: PACKED rows, one for each range; kept are levels from `first`. sizes: (level, n-grams) of all of them."""
    entries = sum(n * (q - first + 1) for q, n in sizes if q >= first)
    if not entries:
        return Segments(None, 0, 8, first)
    segment_bits = -(-entries * ENTRY_BITS // n_ranges // 64 + 1) * 64

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, row in b.iterrows():
                h, c = unpacked(row.to_frame().T)
                q = level(c)
                on = np.zeros(segment_bits, np.uint8)
                for at_level in range(first, int(q.max(initial=0)) + 1):
                    x = h[q >= at_level]
                    x, step = Filter.spread(x, np.full(len(x), at_level))
                    for probe in range(PROBES):
                        on[Filter.places(x, step, probe, segment_bits).astype(np.int64)] = 1
                yield pd.DataFrame({"range": [row["range"]], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    return Segments(cut(counted.mapInPandas(fill, "range int, bits binary")), n_ranges, segment_bits, first)


def counted_ngrams(docs: DataFrame, keys: list, n_ranges: int, least: int = 1) -> tuple[DataFrame, list]:
    """PACKED rows, one a range, of the n-grams that occur `least` times, and (level, n-grams, tokens) over all of them.

    docs: (text). keys: functions of tokens and text starts to n-grams, each counted in a reading of docs of its own.
    """

    def emitter(of):
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("range", pa.int32()), ("ones", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])
            send = lambda h, c: pa.RecordBatch.from_pandas(packed(h, c, n_ranges), schema=schema)
            h, c = np.zeros(0, U64), np.zeros(0, np.int64)
            for b in slices(batches, 0):
                tokens, _, starts = joined(b.column(0).to_pylist())
                new, times = np.unique(of(tokens, starts), return_counts=True)
                if len(new) > 0.5 * len(tokens):  # next to none comes again
                    yield send(new, times)
                    continue
                h, c = summed(np.concatenate([h, new]), np.concatenate([c, times]))
                if len(h) > RANGE // 8:
                    yield send(h, c)
                    h, c = h[:0], c[:0]
            if len(h):
                yield send(h, c)

        return emit

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        h, c = unpacked(rows)
        levels, of = np.unique(level(c), return_inverse=True)
        keep = c >= least
        out = packed(h[keep], c[keep], 1)
        if not len(out):
            out = pd.DataFrame({"range": [0], "ones": [b""], "more": [b""], "counts": [b""]})
        return out.assign(range=rows["range"].iloc[0], levels=[levels.tolist()], ngrams=[np.bincount(of, minlength=len(levels)).tolist()], tokens=[np.bincount(of, c, minlength=len(levels)).astype(np.int64).tolist()])

    sent = functools.reduce(DataFrame.unionByName, [mapped(docs, emitter(of), PACKED) for of in keys])
    counted = cut(sent.groupBy("range").applyInPandas(add, PACKED + ", levels array<long>, ngrams array<long>, tokens array<long>"))
    sums = counted.select(F.explode(F.arrays_zip("levels", "ngrams", "tokens")).alias("x")).groupBy("x.levels").agg(F.sum("x.ngrams").alias("n"), F.sum("x.tokens").alias("t")).collect()
    return counted.select("range", "ones", "more", "counts"), [(r["levels"], r["n"], r["t"]) for r in sums]


@dataclass
class Model:
    tokens: int  # of training
    distinct: int
    texts: int
    words: Segments
    kept: Segments  # by context: the tokens after it whose bigram is in pairs
    pairs: Segments


class Scale(NamedTuple):
    """Probabilities from levels."""

    tokens: int
    distinct: int

    def log10(self, own: np.ndarray, before: np.ndarray, kept: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 P of tokens from the levels of the token, its context, the context's kept bigrams and the bigram."""
        p = (lower(own) + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))
        total = upper(before).astype(float)
        return np.log10((lower(pair) + (K + total - upper(np.minimum(kept, before))) * p) / (total + K))


def kept_contexts(shared):
    """The contexts of the tokens whose bigram is in the segments that `shared` broadcasts."""

    def keys(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        unique, back = np.unique(pair_hashes(h, starts), return_inverse=True)
        return contexts(h, starts)[shared.value.holds(unique)[back]]

    return keys


def fit(docs: DataFrame, most_bits: int = MOST_BITS, least_pair: int = LEAST_PAIR) -> tuple[Model, DataFrame]:
    """The model of docs (text), and the PACKED token counts."""
    spark = docs.sparkSession
    size = docs.agg(F.count("*").alias("texts"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_ranges = max(shuffle_parts(spark), -(-(size["bytes"] or 0) // (16 * RANGE)))
    counted, sizes = counted_ngrams(docs, [lambda h, starts: h], n_ranges)
    n, v = sum(t for *_, t in sizes), sum(m for _, m, _ in sizes)
    words = build_filter(counted, n_ranges, [(q, m) for q, m, _ in sizes], 1)
    n_ranges = max(shuffle_parts(spark), -(-n // RANGE))
    first = int(level(np.array([least_pair]))[0])
    found, sizes = counted_ngrams(docs, [pair_hashes], n_ranges, least_pair)
    pairs = build_filter(found, n_ranges, [(q, m) for q, m, _ in sizes], first)
    n_ranges = max(shuffle_parts(spark), -(-v // RANGE))
    found, sizes = counted_ngrams(docs, [kept_contexts(spark.sparkContext.broadcast(g)) for g in pairs.groups(most_bits)], n_ranges)
    return Model(n, v, size["texts"], words, build_filter(found, n_ranges, [(q, m) for q, m, _ in sizes], 1), pairs), counted


def looked_up(f: Filter, h: np.ndarray) -> np.ndarray:
    """The level of each token in the filter's segments."""
    unique, back = np.unique(h, return_inverse=True)
    return f.levels(unique)[back]


def with_levels(texts: DataFrame, column: str, shared) -> DataFrame:
    """texts with the levels, a byte for each token (`own`) or its context (`kept`), that one group of segments has, added to the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TEXTS.index(column)
        for b in slices(batches, TEXTS.index("text")):
            h, owner, starts = joined(b.column(TEXTS.index("text")).to_pylist())
            found = looked_up(shared.value, h if column == "own" else contexts(h, starts)).astype(np.uint8)
            known = b"".join(x or b"" for x in b.column(at).to_pylist())
            found = np.maximum(found, np.frombuffer(known, np.uint8)) if known else found
            ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=b.num_rows))].tolist()
            columns = b.columns
            columns[at] = pa.array([found[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=TEXTS)

    return cut(mapped(texts, run, texts.schema))


TEXTS = ["row", "id", "held_out", "text", "own", "kept"]


def score(df: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS, least_pair: int = LEAST_PAIR) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; train: a Column, true for training rows."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), (~train).alias("held_out"), binary_text(text_col).alias("text"))
    model, counted = fit(docs.where("not held_out").select("text"), most_bits, least_pair)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, row in b.iterrows():
                h, c = unpacked(row.to_frame().T)
                yield pd.DataFrame({"h": h.view(np.int64), "c": c})

    counts = cut(counted.mapInPandas(listed, "h long, c long"))
    by_size = sorted(((r["q"], r["n"]) for r in counts.groupBy(F.floor(F.log2("c") * 4).alias("q")).agg(F.count("*").alias("n")).collect()), reverse=True)
    bound, room = None, HEAD
    for q, n in by_size:
        if n > room:
            break
        bound, room = q, room - n
    head = counts.where(F.floor(F.log2("c") * 4) >= F.lit(bound if bound is not None else 1 << 20)).toPandas().sort_values("h")  # at most HEAD rows
    head_h, head_c = head["h"].to_numpy(np.int64), head["c"].to_numpy(np.int64)
    spark = df.sparkSession
    whole = model.tokens + 0.5 * (model.distinct + 1)

    def reading(shared, with_base: bool):
        """A row for each text with the log10 P of its tokens whose bigrams are in the group; in the first reading also a row for each of its distinct words that are no head words."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_words, kept_words, pairs, head_h, head_c = shared.value
            names = ["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "h", "m"]
            for b in slices(batches, TEXTS.index("text")):
                h, owner, starts = joined(b.column(TEXTS.index("text")).to_pylist())
                levels = lambda c, b=b: np.frombuffer(b"".join(b.column(TEXTS.index(c)).to_pylist()), np.uint8).astype(np.int64)
                unique, back = np.unique(h, return_inverse=True)
                own = own_words.levels(unique)[back] if own_words else levels("own")
                before = np.where(starts, model_start, np.roll(own, 1))
                if kept_words:
                    kept = np.where(starts, kept_words.levels(np.array([START]))[0], np.roll(kept_words.levels(unique)[back], 1))
                else:
                    kept = levels("kept")
                g = pair_hashes(h, starts)
                found = numbers.log10(own, before, kept, looked_up(pairs, g))
                n = b.num_rows
                total = lambda w, n=n, owner=owner: np.bincount(owner, w, minlength=n)
                scored = pa.array(total(np.where(pairs.covers(g), found, 0.0)))
                if not with_base:
                    yield pa.RecordBatch.from_arrays([b.column(0), *(pa.nulls(n, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())), scored, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
                    continue
                signed = h.view(np.int64)
                at = np.minimum(np.searchsorted(head_h, signed), max(0, len(head_h) - 1))
                known = head_h[at] == signed if len(head_h) else np.zeros(len(h), bool)
                base = np.zeros(len(h))
                base[known] = np.log10((head_c[at[known]] + 0.5) / whole)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.bincount(owner, minlength=n)), pa.array(total(known).astype(np.int64)), pa.array(total(base)), scored, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
                rest_owner, rest = owner[~known], signed[~known]
                by = np.lexsort((rest, rest_owner))
                rest_owner, rest = rest_owner[by], rest[by]
                first = np.flatnonzero(np.r_[True, (rest[1:] != rest[:-1]) | (rest_owner[1:] != rest_owner[:-1])]) if len(rest) else np.empty(0, np.int64)
                times = np.diff(np.r_[first, len(rest)])
                n, rows = len(first), b.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(rows[rest_owner[first]]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array(rest[first]), pa.array(times.astype(np.int64))], names=names)

        return run

    numbers, model_start = Scale(model.tokens, model.distinct), int(level(np.array([model.texts]))[0])
    none = F.lit(None).cast("binary")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text", none.alias("own"), none.alias("kept"))
    if any(x.n_groups(bits) > 1 for x, bits in ((model.words, most_bits // 2), (model.kept, most_bits // 2), (model.pairs, most_bits))):
        texts = cut(texts)  # so that a row has its number in every reading
    loaded = []
    for column, x in (("own", model.words), ("kept", model.kept)):
        groups = x.groups(most_bits // 2)
        if x.n_groups(most_bits // 2) == 1:
            loaded.append(next(groups))
            continue
        for g in groups:
            texts = with_levels(texts, column, spark.sparkContext.broadcast(g))
        loaded.append(None)
    readings = []
    for k, g in enumerate(model.pairs.groups(most_bits)):
        shared = spark.sparkContext.broadcast((*loaded, g, *((None, None) if k else (head_h, head_c))))
        readings.append(mapped(texts, reading(shared, k == 0), "row long, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, h long, m long"))
    scored = cut(functools.reduce(DataFrame.unionByName, readings))
    tail = scored.where("h is not null").select("row", "h", "m").join(counts, "h", "left")
    c = F.coalesce("c", F.lit(0))
    tail = tail.groupBy("row").agg(F.sum(F.col("m") * F.log10((c + 0.5) / F.lit(whole))).alias("tail"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("tail_known"))
    out = scored.where("n_tokens is not null").drop("h", "m")
    if len(readings) > 1:
        out = out.drop("score").join(scored.where("h is null").groupBy("row").agg(F.sum("score").alias("score")), "row")
    out = out.join(tail, "row", "left")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("tail", F.lit(0.0))).alias("base_score"), "score")


def scores(df: DataFrame, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores with the training rows of the crc32 rule."""
    return score(df, is_train(id_col, held), id_col, text_col)
