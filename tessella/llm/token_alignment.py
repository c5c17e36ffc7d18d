"""Alignment of two tokenizers' tokens by merge-path partitioning.

A is byte-level BPE, B is BPE over pieces with byte fallback. The ends of both tokenizations, as byte offsets, are two rising sequences
that are merged: where both end is the border of a group, and the tokens that end there are linked.

Tokens. Both tokenizers are asked for units: a run of white space and what follows it up to the next white space. No token of either goes across
the end of a unit, and A's pattern sees the same on both sides of it; where B's vocabulary has a token with some kind of white space after
another character (a carriage return, here), units don't end before that kind. So each worker remembers the ids of the units that it has
met, and the libraries only see new ones. A text with white space beyond ASCII's (which A's pattern
treats in other ways) is one unit. The ids' byte lengths, added up, are the ends.

Merging. The documents of a batch are merged at once: their ends, each document's after those of the one before, are A's and B's
sequences, and a diagonal of the grid of both is the set of places after so many ends in all. On every WORK-th diagonal a binary search finds
the one place that the merged order goes through (all diagonals search at once); so the merging falls into pieces of equal work, however long
a document or a group is, and each piece emits the ends that overlap in it alone. Of equal ends A's comes first, so an end of A that closes a
piece may meet the first of B in the next one; these pairs are stitched in between, and groups that began in one piece are closed by the next end that is
common, in whichever piece it is.

Counts. The links of a document are written once, an id pair a row with its number; pairs are counted over the corpus after sums in
each task. To give each document its sums, the most frequent pairs (a power of two as the least count, found from a table of at most 64 counts, such that
at most HEAD pairs are sent) are broadcast, and the links of all other pairs are joined with the rest of the counts by a shuffle; a pair of those is
no hot key. The best of a B id is found in groups of at most as many rows as A has ids.

Rows: null and empty texts, and texts whose tokens' bytes are not the text's (U+2581 becomes a space in B), have no tokens and count nothing; special
strings inside texts are plain text; repeated rows and null ids give a row each and count each time; other columns are ignored; an
empty table gives an empty table. Texts of any length are handled whole, in some 60 bytes a token for a batch of about 4 MB or one longer text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.bpe import BYTE_BPE, unspelled
from tessella.llm.byte_codec import WHITE_BEYOND
from tessella.llm.common import Recent, binary_text, cut, kept, mapped, slices

PIECES = public_tokenizers.path("piece_bpe_32k.model")

WORK = 1 << 14  # ends a piece
HEAD = 1 << 18  # pairs that may be broadcast, of 20 bytes each
BLANK = "\t-\r "
#: White space and separators beyond ASCII's: a text that has one is one unit.
OTHER_WHITE = re.compile(f"[\x1c-\x1f{WHITE_BEYOND}]")
ACROSS = re.compile(f"(?<=[^{BLANK}])[{BLANK}]")


def crossings(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merged order of two rising sequences, a's first of equals, crosses every work-th diagonal: how many of a and of b come before."""
    at = np.r_[np.arange(0, len(a) + len(b), work), len(a) + len(b)]
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        k, mid = np.flatnonzero(open_), (low + high)[open_] // 2
        first = a[mid] <= b[at[k] - mid - 1]
        low[k[first]] = mid[first] + 1
        high[k[~first]] = mid[~first]
    return low, at - low


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the ends that two rising pieces share."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(b, a)
    i = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a)
    return i, at[i]


def merged(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """The places in a and in b of all common ends, piece by piece."""
    i, j = crossings(a, b, work)
    out = []
    for x, y, u, v in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True):
        p, q = overlaps(a[x:y], b[u:v])
        out.append((p + x, q + u))
        if y and v < len(b) and a[y - 1] == b[v]:  # the two lie on either side of the border
            out.append((np.array([y - 1]), np.array([v])))
    return (np.concatenate([p for p, _ in out]), np.concatenate([q for _, q in out])) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


@dataclass
class Aligned:
    """The tokens of some texts in a row. a_at and b_at: where each text's begin, with one entry more; i and j: the tokens of A and B that end together."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    i: np.ndarray
    j: np.ndarray

    @property
    def link_at(self) -> np.ndarray:
        return np.searchsorted(self.i, self.a_at)


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in vocab.items():
            self.a_bytes[k] = unspelled(token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes)))
        self.space = self.b.piece_to_id("▁")
        glue = {x for k, p in enumerate(pieces) if not self.b.is_byte(k) for x in ACROSS.findall(p.replace("▁", " "))}
        more = f"(?:[{re.escape(''.join(sorted(glue)))}][{BLANK}]*[^{BLANK}]*)*" if glue else ""
        self.unit = re.compile(f"[{BLANK}]+[^{BLANK}]*{more}")
        self.units = Recent(None, 200_000)
        n, m = len(self.a_bytes), len(pieces)
        # Of each id and what follows it: A's before another and before B's, B's before another and before a group.
        self.written = [*(b"%d," % k for k in range(n)), *(b"%d|" % k for k in range(n)), *(b"%d," % k for k in range(m)), *(b"%d;" % k for k in range(m))]

    def _split(self, text: str) -> list[str]:
        """The units of a text that begins with a space."""
        return self.unit.findall(text) if not OTHER_WHITE.search(text) else [text]

    def _b_ids(self, units: list[str]) -> list[list[int]]:
        """B puts a space before what it is given. Where a unit begins with another character, that space is a token of its own."""
        got = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for k, u in enumerate(units):
            if u == " ":  # B puts no space before nothing
                got[k] = [self.space]
            elif u[0] != " ":
                if got[k][0] != self.space:
                    raise ValueError(f"the space before {u[:20]!r} is part of a token")
                got[k] = got[k][1:]
        return got

    def _a_ids(self, units: list[str]) -> list[np.ndarray]:
        """A's ids of the units, encoded together: every unit's end is the end of a token, but for units of white space alone, which come last in their texts."""
        out, ends = [], np.cumsum([len(u.encode()) for u in units])
        got = np.array(self.a.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, np.int64)
        at = np.searchsorted(np.cumsum(self.a_size[got]), ends, "right").tolist()
        for x, y in zip([0, *at], at, strict=False):
            out.append(got[x:y])
        return out

    def _known(self, split: list[list[str]]) -> dict[str, tuple[bytes, bytes, bool]]:
        """Of all units of a batch: A's and B's ids, four bytes each, and whether their bytes are the unit's."""
        memo, found, new = self.units, {}, []
        for u in set(chain.from_iterable(split)):
            known = memo.get(u)
            if known is None:
                known = memo.old.get(u)
                if known is None:
                    new.append(u)
                    continue
                memo.put(u, known)
            found[u] = known
        alone = [u for u in new if u[-1].isspace() or len(u) > 1000]
        together = [u for u in new if not (u[-1].isspace() or len(u) > 1000)]
        for part in ([u] for u in alone), (together[k : k + 100] for k in range(0, len(together), 100)):
            for units in part:
                for u, x, y in zip(units, self._a_ids(units), self._b_ids(units), strict=True):
                    data = u.encode()
                    same = b"".join([self.a_bytes[t] for t in x.tolist()]) == data and b"".join([self.b_bytes[t] for t in y]) == data
                    found[u] = known = (x.astype("<i4").tobytes(), np.array(y, "<i4").tobytes(), same)
                    memo.put(u, known)
        return found

    def align(self, texts: list[bytes | None], work: int = WORK) -> Aligned:
        split = [self._split(" " + t.decode()) if t else [] for t in texts]
        known = self._known(split)
        ids: tuple[list[bytes], list[bytes]] = ([], [])
        for units in split:
            got = list(map(known.__getitem__, units))
            if not all([same for _, _, same in got]):
                got = []
            ids[0].append(b"".join([x for x, _, _ in got]))
            ids[1].append(b"".join([y for _, y, _ in got]))
        a, b = (np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in ids)
        a_at, b_at = (np.r_[0, np.cumsum([len(t) // 4 for t in x], dtype=np.int64)] for x in ids)
        # Documents have the same bytes in A and B, so the sums go on from one to the next.
        i, j = merged(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), work)
        return Aligned(a, b, a_at, b_at, i, j)

    def written_groups(self, x: Aligned) -> list[bytes]:
        """Of each text its groups: `a1,a2|b1;a3|b2,b3`."""
        n, m = len(self.a_bytes), len(self.b_bytes)
        a_many, b_many = np.diff(x.i, prepend=-1), np.diff(x.j, prepend=-1)
        a_code, b_code = x.a.copy(), x.b + 2 * n
        a_code[x.i] += n
        b_code[x.j] += m
        out = np.empty(len(x.a) + len(x.b), np.int64)
        out[np.arange(len(x.a)) + np.repeat(x.j + 1 - b_many, a_many)] = a_code
        out[np.arange(len(x.b)) + np.repeat(x.i + 1, b_many)] = b_code
        at = (x.a_at + x.b_at).tolist()
        return [b"".join(map(self.written.__getitem__, out[s:e].tolist()))[:-1] for s, e in zip(at[:-1], at[1:], strict=True)]


def links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_BPE, b_path: str = PIECES) -> DataFrame:
    """(id, a_ids, b_ids, links): the tokens of both, and the places of those that end together, as (a, b) from 0; a group ends with each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = kept(Aligner, a_path, b_path)
        for part in slices(batches, most=500_000):
            x = c.align(part.column(1).to_pylist())
            at = x.link_at
            pairs = pa.StructArray.from_arrays([pa.array(x.i - np.repeat(x.a_at[:-1], np.diff(at))), pa.array(x.j - np.repeat(x.b_at[:-1], np.diff(at)))], ["a", "b"])
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), v) for o, v in ((x.a_at, pa.array(x.a, pa.int32())), (x.b_at, pa.array(x.b, pa.int32())), (at, pairs))]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["id", "a_ids", "b_ids", "links"])

    return mapped(df.select(F.col(id_col).cast("long").alias("id"), binary_text(text_col)), run, "id long, a_ids array<int>, b_ids array<int>, links array<struct<a:long,b:long>>", remembers=True).withColumnRenamed("id", id_col)


def summaries(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_BPE, b_path: str = PIECES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs): pairs are the document's linked ids (a, b) and how many links hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = kept(Aligner, a_path, b_path)
        for part in slices(batches):
            x = c.align(part.column(1).to_pylist())
            at = x.link_at
            n = np.diff(at)
            owner = np.repeat(np.arange(len(n)), n)
            key = np.sort((owner * len(c.a_bytes) + x.a[x.i]) * len(c.b_bytes) + x.b[x.j])
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            many, key = np.diff(np.r_[first, len(key)]), key[first]
            rest, b_id = np.divmod(key, len(c.b_bytes))
            owner, a_id = np.divmod(rest, len(c.a_bytes))
            pairs = pa.StructArray.from_arrays([pa.array(a_id, pa.int32()), pa.array(b_id, pa.int32()), pa.array(many, pa.int32())], ["a", "b", "n"])
            pairs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(n) + 1)), pa.int32()), pairs)
            shas = [hashlib.sha256(g).hexdigest() if k else "" for g, k in zip(c.written_groups(x), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(x.a_at)), pa.array(np.diff(x.b_at)), pa.array(n), pa.array(n), pa.array(shas, pa.string()), pairs], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return mapped(df.select(F.col(id_col).cast("long").alias("id"), binary_text(text_col)), run, "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,n:int>>", remembers=True).withColumnRenamed("id", id_col)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links of all rows of summaries() hold each id pair, and whether that is the most of its b."""
    counts = linked.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def least_of_head(counts: DataFrame, head: int) -> int:
    """The smallest power of two that at most `head` counts reach."""
    found = counts.groupBy((F.length(F.bin("count")) - 1).alias("log")).count().collect()  # 64 rows at most
    least, many = 1 << 62, 0
    for log, n in sorted(((r["log"], r["count"]) for r in found), reverse=True):
        many += n
        if many > head:
            break
        least = 1 << log
    return least


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_BPE, b_path: str = PIECES, head: int = HEAD) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    linked = cut(summaries(df, id_col, text_col, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    counts = cut(pair_counts(linked))
    least = least_of_head(counts, head)
    each = linked.select("row", F.inline("pairs"))
    frequent, rare = F.broadcast(counts.where(F.col("count") >= least)), counts.where(F.col("count") < least)
    sums = (F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    known = each.join(frequent, ["a", "b"]).groupBy("row").agg(*sums)
    if least > 1:
        others = each.join(frequent, ["a", "b"], "left_anti").join(rare, ["a", "b"]).groupBy("row").agg(*sums)
        known = known.unionByName(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    filled = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum"))
    return linked.drop("pairs").join(known, "row", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", *filled, "groups_sha256")
