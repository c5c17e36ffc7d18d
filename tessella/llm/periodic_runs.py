"""Periodic runs of words by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), as long as it can be, of at least
`exponent` periods and `least` words.

Access. The suffix links of the automaton of a text make a tree, in which every prefix has a node and a node stands for the suffixes on
its path to the root. Each node has the colour of the last prefix that was seen below it: the end of its last occurrence. Appending a
word accesses the new prefix's node: the whole path to the root takes the new colour. The path falls into segments of one old colour,
and what is left of a segment is always its lower part, so a segment is kept as its colour (the prefix at its foot), the length above
which it still stands and the node that it hangs from. A segment whose last end is d words back and whose suffixes reach length L
tells that the last L + d words have period d. If L >= d that is a square, d is its smallest period, and no word before it continues
it; the last end that tells the same start and period is the run's end. A path has a logarithm of segments on average. The colour of a node is
read from the last access that is known to have passed it, or else from a tree of maxima over the prefixes below it.

Where the automaton runs. The first L - q words of a run recur q words later, so the run is covered by windows of least * (exponent -
1) / exponent words that recur in the text. Stretches covered by recurring windows are found with hashes of all windows, and each
stretch has an automaton of its own, over the words themselves. Nothing else can hold a run.

Rows: null and empty texts have no words and no runs; repeated rows and null ids give a row each (a null id is never rewritten); other
columns are ignored. A text is handled whole at any length: some 100 bytes a word, and 150 more for each word of its longest stretch.
One stage, no shuffle, so a lost executor costs its own tasks.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import U64, binary_text, mapped, mix, ngram_hashes, slices, words

LEAST, EXPONENT = 24, 3

Run = tuple[int, int, int]  # start, length, period, in words


class Automaton:
    """The suffix automaton of a sequence of small numbers. State 0 is the empty suffix; `prefix[i]` is the state of the first i + 1 words."""

    def __init__(self, word: list[int]):
        most = 2 * len(word) + 1
        self.length, self.link = array("q", bytes(8 * most)), array("q", bytes(8 * most))
        self.prefix = array("q", bytes(8 * len(word)))
        # A state's first arc stands in two arrays, since most have one; others are in `more`.
        label, to, more = array("q", [-1]) * most, array("q", bytes(8 * most)), {}
        length, link, prefix = self.length, self.link, self.prefix
        link[0] = -1
        size, last = 1, 0
        for i, c in enumerate(word):
            prefix[i] = new = size
            size += 1
            length[new] = i + 1
            p, q = last, -1
            while p >= 0:
                if label[p] == c:
                    q = to[p]
                    break
                if label[p] < 0:
                    label[p], to[p] = c, new
                else:
                    arcs = more.get(p)
                    if arcs is None:
                        more[p] = {c: new}
                    elif c in arcs:
                        q = arcs[c]
                        break
                    else:
                        arcs[c] = new
                p = link[p]
            last = new
            if p < 0:
                link[new] = 0
            elif length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy, size = size, size + 1
                length[copy], link[copy] = length[p] + 1, link[q]
                label[copy], to[copy] = label[q], to[q]
                if q in more:
                    more[copy] = dict(more[q])
                link[q] = link[new] = copy
                while p >= 0:
                    if label[p] == c:
                        if to[p] != q:
                            break
                        to[p] = copy
                    elif more[p][c] == q:
                        more[p][c] = copy
                    else:
                        break
                    p = link[p]
        self.size = size

    def below(self) -> tuple[list[int], list[int], list[int]]:
        """Of each state the range of places, begin and end, of the prefixes in its subtree; and of each prefix its place."""
        n = self.size
        link, many = self.link, [0] * n
        for v in self.prefix:
            many[v] = 1
        order = np.argsort(np.frombuffer(self.length, np.int64)[:n], kind="stable").tolist()  # parents first
        for v in reversed(order[1:]):
            many[link[v]] += many[v]
        begin, free = [0] * n, [0] * n
        own = bytearray(n)
        for v in self.prefix:
            own[v] = 1
        free[0] = own[0]
        for v in order[1:]:
            up = link[v]
            begin[v] = at = free[up]
            free[up] = at + many[v]
            free[v] = at + own[v]
        return begin, [b + m for b, m in zip(begin, many, strict=True)], [begin[v] for v in self.prefix]


def repetitions(word: list[int], least: int, exponent: int) -> dict[tuple[int, int], int]:
    """(start, period) -> end of all runs of the word, by accessing the automaton's tree prefix by prefix."""
    tree, n = Automaton(word), len(word)
    link, length, prefix = tree.link, tree.length, tree.prefix
    begin, end, place = tree.below()
    base = 1 << max(1, n - 1).bit_length()
    latest = array("q", bytes(16 * base))  # maxima: of a place at base + place, of two nodes at half their number
    known = array("q", bytes(8 * tree.size))  # an access that passed the state; 0: none
    above, hangs = array("q", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1)))  # of each colour: the length above which its segment stands, and the state it hangs from
    found: dict[tuple[int, int], int] = {}
    for i in range(1, n + 1):
        v = prefix[i - 1]
        known[v] = i
        u = link[v]
        while u:
            size, colour = length[u], known[u]
            if not colour or above[colour] >= size:
                x, y, colour = begin[u] + base, end[u] + base, 0
                while x < y:
                    if x & 1:
                        if latest[x] > colour:
                            colour = latest[x]
                        x += 1
                    if y & 1:
                        y -= 1
                        if latest[y] > colour:
                            colour = latest[y]
                    x >>= 1
                    y >>= 1
            known[u] = i
            if not colour:  # the first access of this state
                u = link[u]
                continue
            d = i - colour
            if size >= (exponent - 1) * d and size + d >= least:
                found[i - d - size, d] = i
            above[colour], hangs[colour], u = size, u, hangs[colour]
        x = place[i - 1] + base
        while x:
            latest[x] = i
            x >>= 1
    return found


def stretches(ids: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the stretches of words that are covered by windows which recur."""
    h = ngram_hashes(mix(ids.astype(U64) + U64(1)), window)
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice):
        at = np.flatnonzero(np.isin(h, twice))
        gap = np.flatnonzero(np.diff(at) > window)
        yield from zip(at[np.r_[0, gap + 1]].tolist(), (at[np.r_[gap, len(at) - 1]] + window).tolist(), strict=True)


def runs_of(ws: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """(start, length, period) of a text's runs, by start, then period. exponent: 2 or more."""
    window = max(1, -(-least * (exponent - 1) // exponent))
    number = defaultdict(count().__next__)
    ids = list(map(number.__getitem__, ws))
    if len(ids) < least or len(ids) - len(number) < window:  # a run repeats that many words
        return []
    out = []
    for a, b in stretches(np.array(ids), window):
        if b - a >= least:
            out += [(a + s, e - s, d) for (s, d), e in repetitions(ids[a:b], least, exponent).items()]
    return sorted((r[0], r[1], r[2]) for r in out)


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest exact length / period; of ties that of the smallest start, then period."""
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(ws: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words left when each run keeps its first period only."""
    if not runs:
        return ws
    keep = np.ones(len(ws), bool)
    for start, size, period in runs:
        keep[start + period : start + size] = False
    return [ws[k] for k in np.flatnonzero(keep).tolist()]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The numbers of the words that a document of n words is rewritten to: a tenth of the ids get a periodic tail. None: as it is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return np.r_[np.arange(a), a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))]


def _mapped(df: DataFrame, id_col: str, text_col: str, least: int, exponent: int, rewrite: Callable | None, row: Callable, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """A row of the given columns for each document, from its words and runs."""
    names = [c.strip().split(" ")[0] for c in ["id", *schema.split("; ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(text)
                if rewrite and (places := rewrite(i, len(ws))) is not None:
                    ws = [ws[k] for k in places.tolist()]
                out.append(row(ws, runs_of(ws, least, exponent)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=names)

    return mapped(df.select(F.col(id_col).cast("long").alias("id"), binary_text(text_col)), run, "id long, " + schema.replace(";", ",")).withColumnRenamed("id", id_col)


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(id, runs): an array of (start, length, period) in words, by start, then period."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    row = lambda ws, runs: ([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs],)
    return _mapped(df, id_col, text_col, least, exponent, None, row, "runs array<struct<start:long,length:long,period:long>>", [kind])


def collapse(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(id, text): the words joined by one space, each run cut to its first period."""
    return _mapped(df, id_col, text_col, least, exponent, None, lambda ws, runs: (b" ".join(collapsed(ws, runs)).decode(),), "text string", [pa.string()])


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT, rewrite: Callable[[int | None, int], np.ndarray | None] | None = planted) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256); four nulls where there is no run. rewrite: which words a document is made of first."""

    def row(ws: list[bytes], runs: list[Run]) -> tuple:
        start, size, period = strongest(runs) or (None, None, None)
        text = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
        return len(runs), start, size, period, None if size is None else 1000 * size // period, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(ws, runs))).hexdigest()

    schema = "n_runs long; start long; length long; period long; exponent_milli long; runs_sha256 string; collapsed_sha256 string"
    return _mapped(df, id_col, text_col, least, exponent, rewrite, row, schema, [pa.int64()] * 5 + [pa.string()] * 2)
