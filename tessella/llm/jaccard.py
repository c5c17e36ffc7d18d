"""N-gram Jaccard join: near-duplicate texts by shared word shingles, with rare-first prefix filtering.

1. One scan hashes every text's shingle set. Texts with equal sets are one class. Word frequencies are counted over the whole corpus
   into a table of fixed size (BUCKETS). A shingle is as rare as its words make it (the sum of their log frequencies), which gives all
   sets one order, rare shingles first, that stays sharp when there are more shingles than any table could count.
2. A set of n shingles that overlaps another enough shares one of its n - ceil(t n) + 1 rarest, its prefix. Classes are joined on the
   shingles of their prefixes. Shingles that have just the same classes (as those of near-copies mostly do) would join the same pairs,
   so of these one is kept.
3. The classes of a shingle meet with a summary of a few hundred bytes: their length, the shingle's place, and the numbers of shingles in
   fixed ranges of the hash space. Lengths within t of each other, enough places left behind the shingle (positional filter), and
   differences by range that leave enough in common (suffix filter) make a candidate. Pairs that a chain of candidates already joins
   are not looked at again, so a group of copies gives a tree of candidates, not all pairs. A shingle with more than BLOCK classes is
   cut by length and into blocks that meet pair by pair.
4. Candidates that hang together meet once more with their whole sets, in the same blocks, and are verified by counting. Only a
   spanning forest of links comes out.
5. Components of the links give each document the least id that it reaches.

A link table of all pairs is never made, and no link between different texts is lost. The filter of classes with candidates that is sent
to the last scan is a Bloom filter of bounded size: when it is full, more sets travel and none is missed.

Rows: null and empty texts have no shingles and link with nothing; fewer words than a shingle are one shingle as a whole; repeated
rows are documents of their own; a null id is never the least of others; other columns are ignored; an empty table gives no rows. A text
of any length is one set; its shingles travel in one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bloom
from tessella.llm.common import U64, binary_text, cut, mapped, mix, ngram_hashes, slices, word_table
from tessella.llm.components import components

BUCKETS, SLICE = 1 << 21, 1 << 14  # of word frequencies
SUMMARIES, BLOCK = 4096, 1024  # classes of a block: summaries, and whole sets
PACK = 2000  # rows of small groups in one task's call
SMALL = 64  # classes that are compared as one matrix
RANGES = 256
HASH_BITS = U64(54)  # of a shingle; its rarity stands above them
HASH = (U64(1) << HASH_BITS) - U64(1)
CELL = ["group", "class"]
BOTH, HOME, VISITOR = 0, 1, 2


def shingles(texts: list[bytes | None], n: int, order: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct hashed shingles, A-Z in lower case, in ascending order, and its hashed words. With the words' log frequencies rare shingles come first."""
    w = word_table([t.lower() if t else None for t in texts])
    grams, ends = ngram_hashes(w.hashes, n) & HASH, np.cumsum(w.sizes)
    if order is not None:
        rarity = order[bucket(w.hashes)].astype(U64)
        if len(grams):
            grams |= sum(rarity[i : i + len(grams)] for i in range(n)) << HASH_BITS
    for i, j in zip((ends - w.sizes).tolist(), ends.tolist(), strict=True):
        h = w.hashes[i:j]
        yield np.unique(grams[i : j - n + 1]) if j - i >= n else mix(ngram_hashes(h, j - i) + U64(j - i)) & HASH if j > i else h, h


def set_key(s: np.ndarray) -> int | None:
    """A set's class, whatever its order; None: no shingles."""
    return int(mix((s & HASH) + U64(len(s))).sum().view(np.int64)) if len(s) else None


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U64(43)).astype(np.int64)


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def measure(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, t, n, k) of every row of docs (doc_id, text, t), and the log frequencies of the corpus' words by bucket, in quarters of a doubling."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "t", "n", "k", "slice", "turn", "counts"]
        total = np.zeros(BUCKETS, np.int64)
        for b in slices(batches):
            sizes, keys, words = [], [], []
            for s, h in shingles(b.column(1).to_pylist(), n):
                sizes.append(len(s))
                keys.append(set_key(s))
                words.append(h)
            total += np.bincount(bucket(np.concatenate([*words, np.empty(0, U64)])), minlength=BUCKETS)
            m = len(sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        total = total.reshape(-1, SLICE)
        parts = np.flatnonzero(total.any(1))
        m, turn = len(parts), TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([*(pa.nulls(m, pa.int64()) for _ in range(4)), pa.array(parts, pa.int32()), pa.array([turn] * m, pa.int32()), pa.array([zlib.compress(total[i].tobytes(), 1) for i in parts], pa.binary())], names=names)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(zlib.decompress(x), np.int64) for x in rows["counts"]), np.zeros(SLICE, np.int64))
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "turn": rows["turn"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    out = cut(mapped(docs, scan, "doc_id long, t long, n long, k long, slice int, turn int, counts binary"))
    counted = out.where("slice is not null").select("slice", "turn", "counts")
    for turns in (64, 1):  # the tasks' counts are added in two rounds
        counted = counted.withColumn("turn", F.col("turn") % turns).groupBy("slice", "turn").applyInPandas(add, "slice int, turn int, counts binary")
    order = np.zeros(BUCKETS, np.uint8)
    for r in counted.collect():  # BUCKETS numbers in all
        total = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
        order[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = (4 * np.log2(np.maximum(total, 1))).astype(np.uint8)
    return out.where("slice is null").select("doc_id", "t", "n", "k"), order


class Links:
    """Union-find over the places of a block pair, keeping the links that joined."""

    def __init__(self, n: int):
        self.up, self.made = np.arange(n), []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return int(x)

    def roots(self, xs: np.ndarray) -> np.ndarray:
        r = self.up[xs]
        while (r != (s := self.up[r])).any():
            r = s
        return r

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.made.append((x, y))


def index(tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token, where the rows that have it start, and the order that brings them together."""
    by = np.argsort(tokens, kind="stable")
    return np.searchsorted(tokens[by], np.arange(size + 1)), by


def gathered(starts: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in an index of all rows of the tokens, and which token each is for."""
    a, m = starts[tokens], starts[tokens + 1] - starts[tokens]
    which = np.repeat(np.arange(len(tokens)), m)
    return np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(a, m), which


def ranges_of(s: np.ndarray) -> np.ndarray:
    """How many shingles lie in each range of the hash space, 255 at most: differences can only get smaller."""
    return np.minimum(np.bincount((s & U64(RANGES - 1)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8)


def summary_links(keys: np.ndarray, sizes: np.ndarray, places: np.ndarray, ranges: np.ndarray, n_home: int, both: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Candidates between the first n_home classes of a shingle and the others, as far as they join something new.

    places: where the shingle stands in each set. Shingles before it in both sets are at most the lesser place.
    """

    def fit(x, y) -> np.ndarray:
        n, m = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
        need = -(-percent * (n + m) // (100 + percent))
        most = np.minimum(places[x], places[y]) + 1 + np.minimum(sizes[x] - places[x], sizes[y] - places[y]) - 1
        return (100 * n >= percent * m) & (most >= need), n + m - 2 * need

    def apart(x, y) -> np.ndarray:
        return np.abs(ranges[x].astype(np.int16) - ranges[y].astype(np.int16)).sum(-1)

    links, n = Links(len(keys)), len(keys)
    if n_home == 0 or n == n_home:
        return []
    if n <= 2 * SMALL:
        y, x = (k.ravel() for k in np.meshgrid(np.arange(n_home), np.arange(n_home, n)))
        keep, room = fit(x, y)
        keep &= np.where(both[x - n_home], keys[y] < keys[x], keys[y] != keys[x])
        x, y, room = x[keep], y[keep], room[keep]
        near = apart(x, y) <= room
        for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
            links.join(i, j)
        return links.made
    same = {int(k): i for i, k in enumerate(keys[:n_home])}
    for x in range(n_home, n):  # one class in both roles
        if (twin := same.get(int(keys[x]))) is not None:
            links.up[max(links.root(x), links.root(twin))] = min(links.root(x), links.root(twin))
    home = np.arange(n_home)
    for x in range(n_home, n):
        keep, room = fit(x, home)
        keep &= (links.roots(home) != links.root(x)) & ((keys[home] < keys[x]) if both[x - n_home] else True)
        y = home[keep]
        for j in y[apart(x, y) <= room[keep]].tolist():
            links.join(x, j)
    return links.made


def block_links(keys: np.ndarray, sizes: np.ndarray, prefixes: list[np.ndarray], ranges: np.ndarray, n_home: int, both: np.ndarray, percent: int, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between the first n_home sets and the others, as far as they join something new. `both` marks the others that are also homes somewhere, to be compared once. What passes the filters is counted."""
    n_prefix = np.array([len(p) for p in prefixes])
    ids, dense = np.unique(np.concatenate(prefixes), return_inverse=True)
    owner = np.repeat(np.arange(len(prefixes)), n_prefix)
    first = np.cumsum(n_prefix) - n_prefix
    place = np.arange(len(owner)) - np.repeat(first, n_prefix)
    home = owner < n_home
    p_start, p_by = index(dense[home], len(ids))
    p_owner, p_place = owner[home][p_by], place[home][p_by]
    all_ids, all_dense = np.unique(np.concatenate(sets), return_inverse=True)
    all_owner = np.repeat(np.arange(len(sets)), sizes)
    a_start, a_by = index(all_dense[all_owner < n_home], len(all_ids))
    a_owner = all_owner[all_owner < n_home][a_by]
    a_first = np.cumsum(sizes) - sizes
    links = Links(len(keys))
    same = {int(k): i for i, k in enumerate(keys[:n_home])}
    for x in range(n_home, len(keys)):
        if (twin := same.get(int(keys[x]))) is not None:
            links.up[max(links.root(x), links.root(twin))] = min(links.root(x), links.root(twin))
    for x in range(n_home, len(keys)):
        nx = sizes[x]
        at, i = gathered(p_start, dense[first[x] : first[x] + n_prefix[x]])
        if not len(at):
            continue
        h, where = np.unique(p_owner[at], return_index=True)
        i, j, nh = i[where], p_place[at][where], sizes[h]
        need = -(-percent * (nx + nh) // (100 + percent))
        keep = (100 * np.minimum(nx, nh) >= percent * np.maximum(nx, nh)) & (1 + np.minimum(nx - i - 1, nh - j - 1) >= need)
        if both[x - n_home]:
            keep &= keys[h] < keys[x]
        h, need = h[keep], need[keep]
        new = links.roots(h) != links.root(x)
        h, need = h[new], need[new]
        apart = np.abs(ranges[h].astype(np.int16) - ranges[x].astype(np.int16)).sum(1)
        fit = apart <= nx + sizes[h] - 2 * need
        h, need = h[fit], need[fit]
        if not len(h):
            continue
        at, _ = gathered(a_start, all_dense[a_first[x] : a_first[x] + nx])
        h = h[np.bincount(a_owner[at], minlength=n_home)[h] >= need]
        for y in h.tolist():
            links.join(x, y)
    return links.made


def destinations(members: DataFrame, percent: int, block: int) -> DataFrame:
    """members (group, m, k, n, ...) with pack, class, i, j, role, own: the block pairs (i, j) of cells to which each class goes. m: the group's classes.

    A group of at most `block` classes is one cell, and many of them are one call ("pack"). A larger one is cut by length: a length class
    holds lengths within the threshold of each other, so links reach at most the next class. There a set is a home in the cell of its
    length, a visitor there too (own), and a visitor in the cell below; blocks of homes meet blocks of all.
    """
    own = F.lit(True).alias("own")
    n_packs = 1 + members.count() // PACK
    pack = F.pmod(F.xxhash64("group"), F.lit(n_packs))
    small = members.where(F.col("m") <= block).select("*", pack.alias("pack"), F.lit(0).alias("class"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(BOTH).alias("role"), own)
    step = float(np.log(100 / percent))
    large = members.where(F.col("m") > block).withColumn("class", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    count = cut(large.groupBy(*CELL).agg(F.count("*").alias("homes")))
    above = count.select("group", (F.col("class") - 1).alias("class"), F.col("homes").alias("visits"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    cells = count.join(above, CELL, "left").select(*CELL, blocks(F.col("homes")).alias("n_home"), blocks(F.col("homes") + F.coalesce("visits", F.lit(0))).alias("n_all"), (-1 - F.abs(F.xxhash64(*CELL) % (1 << 62))).alias("pack"))
    visits = large.withColumn("own", F.lit(True)).unionByName(large.withColumn("class", F.col("class") - 1).withColumn("own", F.lit(False))).join(cells, CELL)
    deal = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*members.columns, "pack", "class"]
    homes = visits.where("own").select(*columns, deal("n_home").alias("i"), every("n_all").alias("j"), F.lit(HOME).alias("role"), "own")
    others = visits.select(*columns, every("n_home").alias("i"), deal("n_all").alias("j"), F.lit(VISITOR).alias("role"), "own")
    return small.unionByName(homes).unionByName(others)


def per_cell(rows: pd.DataFrame, links) -> pd.DataFrame:
    """(a, b) of the links in each cell of a block pair. links: a function of a cell's rows in the order homes, others, of the homes' number and of which others are homes too."""
    made = []
    rows = rows.sort_values([*CELL, "k"])
    for at in rows.groupby(CELL, sort=False).indices.values():
        part = rows.iloc[at]
        role = part["role"].to_numpy()
        home, other = np.flatnonzero(role != VISITOR), np.flatnonzero(role != HOME)
        if len(home) and len(other) and len(part) > 1:
            part = part.iloc[np.r_[home, other]]
            keys = part["k"].to_numpy()
            made += [(keys[x], keys[y]) for x, y in links(part, keys, len(home), part["own"].to_numpy()[len(home) :])]
    return pd.DataFrame(made, columns=["a", "b"])


def near_sets(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, n, k) of every row, and (k, component_key) of the classes that are linked to others."""
    measured, order = measure(docs, n)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(order)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each class of a part of the batch its prefix and its numbers by range."""
        for b in slices(batches):
            out = {}
            for s, _ in shingles(b.column(1).to_pylist(), n, shared.value):
                if len(s) and (k := set_key(s)) not in out:
                    out[k] = len(s), s[: prefix_size(len(s), percent)], ranges_of(s).tobytes()
            values = list(out.values())
            ends = np.cumsum([0, *(len(p) for _, p, _ in values)])
            flat = np.concatenate([*(p for _, p, _ in values), np.zeros(0, U64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([m for m, _, _ in values], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array([r for _, _, r in values], pa.binary())], names=["k", "n", "prefix", "ranges"])

    summary = cut(mapped(docs, summaries, "k long, n long, prefix array<long>, ranges binary").dropDuplicates(["k"]))
    rows = summary.select(F.posexplode("prefix").alias("place", "group"), "k")
    same = [F.bit_xor(F.xxhash64("k", F.lit(salt))).alias(f"all_{salt}") for salt in (0, 1)]
    groups = rows.groupBy("group").agg(F.count("*").alias("m"), *same).where("m > 1")
    groups = cut(groups.groupBy("m", "all_0", "all_1").agg(F.min("group").alias("group")).select("group", "m"))
    members = cut(rows.join(groups, "group")).join(summary.select("k", "n", "ranges"), "k")

    def candidates(rows: pd.DataFrame) -> pd.DataFrame:
        counts = lambda part: np.frombuffer(b"".join(part["ranges"]), np.uint8).reshape(-1, RANGES)
        return per_cell(rows, lambda part, keys, n_home, both: summary_links(keys, part["n"].to_numpy(), part["place"].to_numpy().astype(np.int64), counts(part), n_home, both, percent))

    def verified(rows: pd.DataFrame) -> pd.DataFrame:
        def links(part, keys, n_home, both):
            sets = [np.frombuffer(x, U64) for x in part["tokens"]]
            return block_links(keys, np.array([len(x) for x in sets]), [x[: prefix_size(len(x), percent)] for x in sets], np.stack([ranges_of(x) for x in sets]), n_home, both, percent, sets)

        return per_cell(rows, links)

    def joined(members: DataFrame, block: int, join) -> DataFrame:
        return destinations(members, percent, block).groupBy("pack", "i", "j").applyInPandas(join, "a long, b long")

    likely = cut(components(joined(members, SUMMARIES, candidates)))
    filled = spark.sparkContext.broadcast(bloom.build(likely, "node"))

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [(set_key(s), s) for s, _ in shingles(b.column(1).to_pylist(), n, shared.value) if len(s)]
            near = bloom.contains(filled.value, np.array([k for k, _ in found], np.int64))
            out = {k: s.tobytes() for (k, s), yes in zip(found, near, strict=True) if yes}
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([len(x) // 8 for x in out.values()], pa.int64()), pa.array(list(out.values()), pa.binary())], names=["k", "n", "tokens"])

    sets = mapped(docs, whole_sets, "k long, n long, tokens binary").dropDuplicates(["k"])
    sizes = likely.groupBy("component").agg(F.count("*").alias("m"))
    clusters = cut(likely.join(sizes, "component").select(F.col("node").alias("k"), F.col("component").alias("group"), "m"))
    # what is dealt is small; the whole sets join it last
    numbers = summary.select("k", "n").join(clusters, "k")
    dealt = destinations(numbers, percent, BLOCK).drop("n").join(sets, "k")
    links = dealt.groupBy("pack", "i", "j").applyInPandas(verified, "a long, b long")
    return measured, components(links).select(F.col("node").alias("k"), F.col("component").alias("component_key"))


def grouped(df: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(doc_id, t, n, component_key) of every row; t is the text's hash. Rows of one key are a group, those without a key have no shingles."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), binary_text(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    measured, groups = near_sets(docs, n, percent)
    return measured.join(cut(groups), "k", "left").select("doc_id", "t", "n", F.coalesce("component_key", "k").alias("component_key"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) of every row; the defaults are five words and a similarity of 0.8."""
    rows = cut(grouped(df, id_col, text_col, n, percent))
    least = cut(rows.where("component_key is not null").groupBy("component_key").agg(F.min("doc_id").alias("component_id")))
    out = rows.join(least, "component_key", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """df with one row of each group: that of the least id and, among texts of one id, of the least hash. Null ids come last; of rows of one id and text one stays.

    Rows without shingles (null and empty texts) are no group and stay.
    """
    rows = cut(grouped(df, id_col, text_col, n, percent).where("component_key is not null"))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")
    stays = cut(rows.groupBy("component_key").agg(F.min(first).alias("stays")))
    goes = rows.join(stays, "component_key").where(first != F.col("stays")).select("doc_id", "t").distinct()
    again = rows.groupBy("doc_id", "t").agg(F.count("*").alias("times")).where("times > 1").select("doc_id", "t")
    goes, again = (cut(x).select(F.col("doc_id").alias("its_id"), F.col("t").alias("its_t")) for x in (goes, again))
    given = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"))
    same = F.col("id").eqNullSafe(F.col("its_id")) & F.col("t").eqNullSafe(F.col("its_t"))
    left = given.join(goes, same, "left_anti")
    once = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["id", "t"]))
    return once.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns))
