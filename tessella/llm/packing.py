"""Packing documents into sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most one sequence. Whole-sequence pieces are done; the others are dealt by hash into shards of a bounded
number of pieces, and each shard is packed by several islands, each a Spark task with its own population. An individual is an
assignment of pieces to bins. Crossover injects the other parent's best-filled bins whole, drops the bins that they overlap, and
best-fits the displaced pieces, long ones first; mutation empties the worst bins. Between epochs each island's elite moves on to the
next island of its shard. The best individual wins; the pieces of its poorly filled bins go to another round over all shards, until
they fit into one shard or a round fills too few bins for another to be of use: then all bins of that round stay as they are. A larger
input has more shards and no larger task, and nothing passes through the driver but counts.

Rows: null and empty texts are one piece (the end id alone); repeated rows and null ids are packed a row each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.bpe import WORD_BPE, library, merges, plain_pieces
from tessella.llm.common import Recent, binary_text, cut, kept, mapped, slices

END_ID = 0
REMEMBERED = 400_000  # words that a worker keeps the ids of, twice at most
SHARD = 16_384  # pieces
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 2, 5, 10
FULL = 0.98  # a bin filled below this share is packed again, with those of other shards
PROGRESS = 0.25  # the share of its pieces that a round must place in full bins for another to follow

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "shard long, island int, origin int, item long, length int, bin int, n_bins int, fitness double"


class Ids:
    """Texts to ids, as little-endian 32-bit numbers. The vocabulary never joins across pre-split words, so each is encoded by the library once and remembered."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.path, self.library = path, library(path)
        self.known = Recent(lambda piece: np.array(self.library.encode(piece, add_special_tokens=False).ids, "<u4").tobytes(), remembered)
        m = merges(path)
        self.ends = np.zeros(max(m.ids) + max(m.added.values(), default=0) + 1, bool)  # by id: whether it ends a word
        self.ends[[m.ids[k] for k in m.final.values()]] = True

    def learn(self, pieces: list[str]) -> None:
        """New words are encoded together, joined by spaces; the ids that end a word part them again."""
        for k in range(0, len(pieces), 2000):
            part = pieces[k : k + 2000]
            got = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) == len(part):  # else each is encoded alone when it is asked for
                for piece, a, b in zip(part, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                    self.known.put(piece, got[a:b].tobytes())

    def of(self, texts: list[str]) -> Iterator[bytes]:
        found = [plain_pieces(self.path, t) for t in texts]
        known, old = self.known, self.known.old
        if self.ends.any():
            self.learn([p for p in set().union(*(f for f in found if f)) if p not in known and p not in old])
        for text, f in zip(texts, found, strict=True):
            yield known.make(text) if f is None else b"".join(map(known.__getitem__, f))


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str = WORD_BPE, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and end id, cut at the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = kept(Ids, path, remembered), np.array([END_ID], "<u4").tobytes()
        for b in slices(batches):
            out = []
            texts = [(t or b"").decode() for t in b.column(1).to_pylist()]
            coded = chain.from_iterable(encoder.of(texts[k : k + 200]) for k in range(0, len(texts), 200))
            for doc, own in zip(b.column(0).to_pylist(), coded, strict=True):
                own += end
                for k, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(df.select(F.col(id_col).cast("long"), binary_text(text_col)), run, PIECES, remembers=True)


class Bins:
    """Open bins by room left; a bit mask of the rooms in use finds the tightest fit."""

    def __init__(self, capacity: int, rooms: np.ndarray):
        self.capacity, self.by_room, self.mask, self.n = capacity, [[] for _ in range(capacity + 1)], 0, len(rooms)
        for k, room in enumerate(rooms.tolist()):
            self.by_room[room].append(k)
        for room, bins in enumerate(self.by_room):
            if bins:
                self.mask |= 1 << room

    def put(self, length: int) -> int:
        fits = self.mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            at = self.by_room[room].pop()
            if not self.by_room[room]:
                self.mask ^= 1 << room
        else:
            room, at = self.capacity, self.n
            self.n += 1
        self.by_room[room - length].append(at)
        self.mask |= 1 << (room - length)
        return at


def best_fit(assign: np.ndarray, fill: np.ndarray, loose: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """assign with the loose items put into the tightest bins, in the given order."""
    bins = Bins(capacity, capacity - fill)
    assign[loose] = [bins.put(n) for n in lengths[loose].tolist()]
    return assign


def fills(assign: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(assign, lengths).astype(np.int64)


def compact(assign: np.ndarray) -> np.ndarray:
    return np.unique(assign, return_inverse=True)[1]


def score(assign: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones: the mean squared fill."""
    f = fills(assign, lengths) / capacity
    return -len(f), float((f * f).mean())


def inject(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Crossover: a share of b's best bins goes whole into a."""
    fill = fills(b, lengths)
    best = np.argsort(-(fill + rng.random(len(fill))))[: max(1, int(len(fill) * rng.uniform(0.05, 0.3)))]
    chosen = np.zeros(len(fill), bool)
    chosen[best] = True
    given = chosen[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[given]] = True
    loose = np.flatnonzero(hit[a] & ~given)
    child = a.copy()
    child[given] = a.max() + 1 + b[given]
    kept = np.ones(len(a), bool)
    kept[loose] = False
    child[kept] = compact(child[kept])
    loose = loose[np.argsort(-lengths[loose], kind="stable")]
    return best_fit(child, fills(child[kept], lengths[kept]), loose, lengths, capacity)


def shake(a: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Mutation: some of the worst bins and a few others are emptied and their items put back."""
    fill = fills(a, lengths)
    bad = np.argsort(fill - rng.random(len(fill)) * capacity * 0.1)[: max(1, len(fill) // 20)]
    out = np.zeros(len(fill), bool)
    out[bad] = True
    out[rng.integers(0, len(fill), max(1, len(fill) // 50))] = True
    loose = np.flatnonzero(out[a])
    child, kept = a.copy(), ~out[a]
    child[kept] = compact(child[kept])
    loose = loose[np.argsort(-lengths[loose] * rng.uniform(0.9, 1, len(loose)))]
    return best_fit(child, fills(child[kept], lengths[kept]), loose, lengths, capacity)


def evolve(seeds: list[np.ndarray], lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The best individual after some generations from the seeds and random best fits."""
    none, least = np.zeros(0, np.int64), -(-int(lengths.sum()) // capacity)
    people = [s.copy() for s in seeds]
    while len(people) < POPULATION:
        order = np.argsort(-lengths * (rng.uniform(0.8, 1, len(lengths)) if people else 1), kind="stable")
        people.append(best_fit(np.zeros(len(lengths), np.int64), none, order, lengths, capacity))
    people = [(score(a, lengths, capacity), a) for a in people]
    for _ in range(GENERATIONS):
        people.sort(key=lambda x: x[0], reverse=True)
        if -people[0][0][0] <= least:
            break
        young = []
        for _ in range(POPULATION // 2):
            i, j = sorted(rng.choice(len(people), 2, replace=False))
            child = inject(people[i][1], people[j][1], lengths, capacity, rng)
            if rng.random() < 0.5:
                child = shake(child, lengths, capacity, rng)
            young.append((score(child, lengths, capacity), child))
        people = sorted(people + young, key=lambda x: x[0], reverse=True)[:POPULATION]
    return max(people, key=lambda x: x[0])[1]


def pack_shards(items: DataFrame, n_shards: int, capacity: int, level: int) -> DataFrame:
    """(shard, item, length, bin): the best packing of each shard. items: (item, length)."""

    def epoch(number: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            shard, island = int(key[0]), int(key[1])
            seeds, own = [], None
            for _, x in rows.groupby("origin"):
                x = x.sort_values("item")
                own = x
                if number:
                    seeds.append(compact(x["bin"].to_numpy()))
            lengths = own["length"].to_numpy().astype(np.int64)
            best = evolve(seeds, lengths, capacity, np.random.default_rng([level, shard, island, number]))
            n, fit = score(best, lengths, capacity)
            return pd.DataFrame({"shard": shard, "island": island, "origin": island, "item": own["item"], "length": own["length"], "bin": best, "n_bins": -n, "fitness": fit})

        return run

    shard = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(n_shards))
    people = items.select(shard.alias("shard"), F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), F.lit(0).alias("origin"), "item", F.col("length").cast("int"), F.lit(0).alias("bin"), F.lit(0).alias("n_bins"), F.lit(0.0).alias("fitness"))
    for number in range(EPOCHS):
        if number:  # the elite also goes to the next island
            people = people.withColumn("island", F.explode(F.array_distinct(F.array("island", (F.col("island") + 1) % ISLANDS))))
        people = people.groupBy("shard", "island").applyInPandas(epoch(number), BINS)
    people = cut(people)
    best = people.groupBy("shard").agg(F.min(F.struct("n_bins", -F.col("fitness"), "island"))["island"].alias("island"))
    return people.join(best, ["shard", "island"]).select("shard", "item", "length", "bin")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str = WORD_BPE, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset). remembered: words, for workers that have less memory for them; the result is the same."""
    cutup = cut(pieces(df, id_col, text_col, capacity, path, remembered).withColumn("item", F.monotonically_increasing_id()))  # written with its number, which would follow the splits of each read
    left = cutup.where(F.col("length") < capacity).select("item", "length")
    whole = cutup.where(F.col("length") == capacity).select("item", (-1 - F.col("item")).alias("sequence_id"))
    placed, level, n = whole, 0, left.count()
    while n:
        n_shards = -(-n // SHARD)
        packed = cut(pack_shards(left, n_shards, capacity, level))
        bins = packed.withColumn("fill", F.sum("length").over(Window.partitionBy("shard", "bin")))
        sequence = (F.lit(level) * F.lit(1 << 54) + F.col("shard") * F.lit(SHARD * 4) + F.col("bin")).alias("sequence_id")
        full, before = F.col("fill") >= FULL * capacity, n
        if n_shards > 1:
            left = cut(bins.where(~full).select("item", F.col("length").cast("long")))
            n = left.count()
        if n_shards == 1 or n > (1 - PROGRESS) * before:  # pieces that fill no bin in any company are placed as well as they can be
            placed = placed.unionByName(packed.select("item", sequence))
            break
        placed, level = placed.unionByName(bins.where(full).select("item", sequence)), level + 1
    w = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return cutup.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("offset"))
