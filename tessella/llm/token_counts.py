"""Token counts by prefix dynamic programming.

For every prefix of a word the table keeps the last token of the prefix's encoding and the number of tokens. The encoding of a
prefix is that of a shorter prefix and one more token, and it is the one whose last two tokens may stand side by side: no merge
across their border comes before the merges that build them. So a word is counted in one pass, and the same table answers how many
tokens any cut of the text would have, without encoding again. Words repeat, so each Python worker remembers their tables.

Texts with characters beyond U+00FF are normalised and cut into words by the public library's own normaliser and splitter; their tokens come
from the same table.

Rows: null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids give a row each; other columns are ignored. A text
of any length is counted whole. Spark reads and writes rows in one stage without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.bpe import BEYOND, WORD_BPE, WORD_SPLIT, Endings, added_split, library, merges, plain_pieces, unspelled
from tessella.llm.common import Recent, binary_text, kept, mapped, slices

NEVER = 1 << 60
CHUNK, RUN = re.compile(r"[^ \t-\r]+"), re.compile(r"([ \t-\r]*)([^ \t-\r]*)")
chunks = CHUNK.findall


class PrefixCounter:
    """Counts for a vocabulary with word ends, whose splitter drops white space and lower-cases."""

    def __init__(self, path: str):
        self.path, self.m = path, merges(path)
        self.spans = Recent(self._spans)  # (left, right) token -> whether they may be neighbours
        self.pieces = Recent(self._piece)  # pre-split word -> tokens
        self.spelled = Recent(self._spelled)  # the same, by byte characters
        self.chunks = Recent(self._chunk, 50_000)  # chunk between white space -> tokens, for texts that the library must see
        self.inside, self.ending = (Endings({s: k for s, k in tokens.items() if self._sound(k)}) for tokens in (self.m.inner, self.m.final))
        self._clear()

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at a border while token is built, each with the merge that ends it."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if self.m.parts[token] is None:
                return out
            until, token = self.m.rank[token], self.m.parts[token][side]

    def _crossed(self, left: int, right: int, before: int) -> bool:
        """Whether a merge earlier than `before` joins the two across their border."""
        rights = self._edge(right, 0)
        for x, x_until in self._edge(left, 1):
            for y, y_until in rights:
                w = self.m.joined.get((x, y))
                if w is not None and self.m.rank[w] < x_until and self.m.rank[w] <= y_until and self.m.rank[w] < before:
                    return True
        return False

    def _sound(self, token: int) -> bool:
        """Whether the token's own spelling encodes to it."""
        parts = self.m.parts[token]
        return parts is None or not self._crossed(*parts, self.m.rank[token])

    def _spans(self, pair: tuple[int, int]) -> bool:
        return not self._crossed(*pair, NEVER)

    def _extend(self, endings: Endings, word: bytes, i: int, nodes: list[int]) -> tuple[int, int]:
        """The last token and the number of tokens of word[:i], from those of its shorter prefixes."""
        for j, t in reversed(endings.at(word, i)):
            if j == 0 or self.spans[self.last[nodes[j]], t]:
                return t, self.size[nodes[j]] + 1
        raise ValueError(f"no token ends at {i} of {word!r}")

    def _clear(self) -> None:
        self.next: dict[int, int] = {}  # (prefix, byte) -> prefix
        self.last, self.size = [-1], [0]  # of each prefix: its last token and number of tokens, as if the word went on

    def table(self, word: bytes) -> list[int]:
        """The entries of the prefixes word[:0], word[:1], ... word[:-1]."""
        if len(self.last) > 400_000:
            self._clear()
        nodes, node = [0], 0
        for i in range(1, len(word)):
            at = self.next.get(node << 8 | word[i - 1])
            if at is None:
                t, n = self._extend(self.inside, word, i, nodes)
                at = self.next[node << 8 | word[i - 1]] = len(self.last)
                self.last.append(t)
                self.size.append(n)
            nodes.append(node := at)
        return nodes

    def _count(self, word: bytes) -> int:
        return self._extend(self.ending, word, len(word), self.table(word))[1]

    def _piece(self, piece: str) -> int:
        return self._count(piece.encode())

    def _spelled(self, piece: str) -> int:
        return self._count(unspelled(piece))

    def _split(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        """The pre-split words of a text, spelled in byte characters, and their places; the library only normalises and splits."""
        return library(self.path).pre_tokenizer.pre_tokenize_str(text)

    def _plain(self, text: str) -> int:
        """The tokens of a text without special strings."""
        return sum([self.spelled[p] for p, _ in self._split(library(self.path).normalizer.normalize_str(text))])

    def _chunk(self, chunk: str) -> int:
        pieces = plain_pieces(self.path, chunk)
        if pieces is not None:
            return sum([self.pieces[p] for p in pieces])
        parts = added_split(self.path).split(chunk)
        return sum(map(self._plain, parts[::2])) + len(parts) // 2

    def count(self, text: str) -> int:
        pieces = plain_pieces(self.path, text)
        return sum(map(self.pieces.__getitem__, pieces)) if pieces is not None else sum(map(self.chunks.__getitem__, chunks(text)))

    def prefixes(self, chunk: str) -> list[int]:
        """The number of tokens of each prefix of a chunk, by characters from 1. A special string counts once it is whole."""
        out, done = [], 0
        parts = added_split(self.path).split(chunk)
        for k in range(0, len(parts), 2):
            special = parts[k + 1] if k + 1 < len(parts) else ""
            text = parts[k] + special
            found = self._ends(text, range(1, len(text) + 1)) if not BEYOND.search(text) else self._composed(text)
            if special:
                found[-1] = self._plain(parts[k]) + 1
            out += [done + n for n in found]
            done = out[-1] if out else 0
        return out

    def _ends(self, low: str, ends: Iterable[int]) -> list[int]:
        """The tokens of low[:end] for ascending ends, all from one table for each pre-split word."""
        low = low.lower()
        words = [(m[0], m[0].encode(), m.start(), m.end()) for m in WORD_SPLIT.finditer(low)] if not BEYOND.search(low) else [(low[i:j], unspelled(p), i, j) for p, (i, j) in self._split(low)]
        out, done, k = [], 0, 0
        nodes = None
        for end in ends:
            while k < len(words) and words[k][3] <= end:
                done, k, nodes = done + self._count(words[k][1]), k + 1, None
            more = 0
            if k < len(words) and words[k][2] < end:
                piece, word, start, _ = words[k]
                head = piece[: end - start]
                if piece[0] == "'" and len(piece) > 1 and piece[1] in "stmdrvl":  # a contraction, of three characters at most: its prefixes split otherwise
                    more = sum(self._count(unspelled(p)) for p, _ in self._split(head))
                else:
                    if nodes is None:
                        nodes, at, chars = self.table(word), 0, 0
                    at, chars = at + len(head[chars:].encode()), len(head)
                    more = self._extend(self.ending, word, at, nodes)[1]
            out.append(done + more)
        return out

    def _clusters(self, text: str) -> list[str]:
        """The text in parts that are normalised on their own: characters with those that are joined to them."""
        normal, starts = library(self.path).normalizer.normalize_str, []
        for k, c in enumerate(text):
            if not k or not unicodedata.combining(c) and unicodedata.is_normalized("NFC", text[k - 1 : k + 1]):
                starts.append(k)
        out, whole = [text[i:j] for i, j in zip(starts, [*starts[1:], len(text)], strict=True)], normal(text)
        while "".join(map(normal, out)) != whole:  # some still act on each other
            joined = out[:1]
            for c in out[1:]:
                if normal(joined[-1][-8:] + c[:8]) != normal(joined[-1][-8:]) + normal(c[:8]):
                    joined[-1] += c
                else:
                    joined.append(c)
            out = joined if len(joined) < len(out) else [text]
        return out

    def cluster_ends(self, text: str) -> tuple[list[int], list[int]]:
        """The places where clusters of a text without special strings end, and the number of tokens of the prefix up to each."""
        if not BEYOND.search(text):
            return list(range(1, len(text) + 1)), self._ends(text, range(1, len(text) + 1))
        normal, clusters = library(self.path).normalizer.normalize_str, self._clusters(text)
        whole = [normal(c) for c in clusters]
        return list(accumulate(map(len, clusters))), self._ends("".join(whole), accumulate(map(len, whole)))

    def _composed(self, text: str) -> list[int]:
        """As _ends for every character, where normalisation may join a character to those before it.

        Prefixes that end with a cluster are prefixes of the normalised text; one that ends within a cluster is counted from the last word's start.
        """
        normal = library(self.path).normalizer.normalize_str
        clusters = self._clusters(text)
        whole = [normal(c) for c in clusters]
        low, ends = "".join(whole), list(accumulate(map(len, whole)))
        at_end, starts = self._ends(low, ends), [i for _, (i, _) in self._split(low)]
        out = []
        for k, c in enumerate(clusters):
            first = ends[k] - len(whole[k])
            begin = max([i for i in starts if i < first], default=0) if len(c) > 1 else 0
            before = self._ends(low[:begin], [begin])[0] if begin else 0
            out += [before + sum(self._count(unspelled(p)) for p, _ in self._split(low[begin:first] + normal(c[:j]))) for j in range(1, len(c))]
            out.append(at_end[k])
        return out

    def fit(self, text: str, limit: int) -> int:
        """Characters in the longest prefix of at most limit tokens that parts no character from those joined to it, and no special string."""
        before = 0
        for m in CHUNK.finditer(text):
            n = self.chunks[m[0]]
            if before + n > limit:
                best, start = 0, 0
                for k, part in enumerate(added_split(self.path).split(m[0])):
                    places, counts = ([len(part)], [1]) if k % 2 else self.cluster_ends(part)
                    best = max([best, *(start + j for j, c in zip(places, counts, strict=True) if before + c <= limit)])
                    before, start = before + (counts[-1] if counts else 0), start + len(part)
                return m.start() + best
            before += n
        return len(text)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, path: str = WORD_BPE) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fit_chars): fit_chars is the length of the longest prefix within the limit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = kept(PrefixCounter, path)
        for b in slices(batches):
            rows = []
            for data in b.column(1).to_pylist():
                text = (data or b"").decode()
                n = c.count(text)
                rows.append((len(data or b""), n, n > limit, c.fit(text, limit) if n > limit else len(text)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.int64())))], names=["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    out = mapped(df.select(F.col(id_col).cast("long").alias("id"), binary_text(text_col)), count, "id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long", remembers=True)
    return out.withColumnRenamed("id", id_col)


def prefix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = WORD_BPE) -> DataFrame:
    """(id, prefix_tokens): the number of tokens of every prefix of the text, by characters from 1. Four bytes a character before compression."""

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = kept(PrefixCounter, path)
        for b in slices(batches, most=500_000):
            out = []
            for text in b.column(1).to_pylist():
                done, counts, rest = 0, [], (text or b"").decode()
                for space, chunk in RUN.findall(rest):
                    counts += [done] * len(space)
                    inside = c.prefixes(chunk) if chunk else []
                    counts += [done + n for n in inside]
                    done += inside[-1] if inside else 0
                out.append(counts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=["id", "prefix_tokens"])

    return mapped(df.select(F.col(id_col).cast("long").alias("id"), binary_text(text_col)), table, "id long, prefix_tokens array<int>", remembers=True).withColumnRenamed("id", id_col)


def count_at(n_chars: Column, table: str = "prefix_tokens") -> Column:
    """The tokens of the first n_chars characters; beyond the end, those of the whole text."""
    n = F.least(n_chars, F.size(table))
    return F.when(n < 1, 0).otherwise(F.try_element_at(F.col(table), n.cast("int")))


def longest_within(budget: Column, table: str = "prefix_tokens") -> Column:
    """The characters of the longest prefix of at most `budget` tokens."""
    places = F.transform(F.col(table), lambda c, i: F.when(c <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(places), F.lit(0))
