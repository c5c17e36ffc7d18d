"""Byte-pair encoding and decoding by a tokenization automaton.

Construction. The automaton starts with one state and an arc to itself for every byte, so that it takes any text in bytes. Merges are
then built in, in their order, each by one gadget: for the merge of u and v, the state that u leads to is replaced, for u, by a copy
without its arc v, and every state with an arc u gets an arc uv to where v leads. What is left accepts just the encodings. A copy is
kept as the arc that it lacks and the merge from which it lacks it; every other arc is that of the state it was copied from. An arc is
looked up through these differences once and then stands in a table.

Encoding runs the automaton against the bytes of a pre-split word. The pair is deterministic: each prefix of a word has one accepted
path. Its nodes and transitions are made when first needed and kept in a bounded table. Decoding emits the labels of the arcs.

Rows: null and empty texts have no tokens; repeated rows and null ids give a row each; other columns are ignored. One stage, no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.bpe import BEYOND, BYTE_BPE, BYTE_SPLIT, Endings, added_split, library, merges
from tessella.llm.common import Recent, binary_text, kept, mapped, slices

ALWAYS = 1 << 60


class Automaton:
    """States are named by the label that leads to them; `lacks[u]` holds the arcs that gadgets took from u's state, with the merge that did."""

    def __init__(self, path: str):
        m = merges(path)
        self.path = path
        spelling = {k: s for s, k in m.inner.items()}
        self.ids, self.parts, self.born = m.ids, m.parts, m.rank
        self.label = [spelling[k] for k in range(len(m.ids))]  # arc labels
        self.lacks: list[dict[int, int]] = [{} for _ in m.ids]
        self.built = [p is None for p in m.parts]
        for when, ((u, v), w) in enumerate(m.joined.items()):
            if self.built[u] and self.built[v] and self.at(u, v, when):
                self.lacks[u][v] = when
                self.built[w] = True
        self.endings = Endings({self.label[k]: k for k in range(len(m.ids)) if self.built[k]})
        self.arcs = Recent(lambda uv: self.at(*uv, ALWAYS))
        self.by_id = {i: self.label[k] for k, i in enumerate(m.ids)} | {i: s.encode() for s, i in m.added.items()}
        self.words = Recent(self._word)
        self._clear()

    def at(self, state: int, token: int, when: int) -> bool:
        """Whether the state that `state` leads to has the arc `token`, once the merges before `when` are built in.

        An arc uv comes from the arc u of the same state, so it is missing if u was when uv was made. A state is a copy of the one
        that its label's right half led to when the label was made.
        """
        until = when
        while True:
            lacks = self.lacks[state]
            if lacks:
                arc, made = token, ALWAYS
                while True:
                    gone = lacks.get(arc)
                    if gone is not None and gone < until and gone <= made:
                        return False
                    if self.parts[arc] is None:
                        break
                    made, arc = self.born[arc], self.parts[arc][0]
            if self.parts[state] is None:
                return True
            until, state = min(until, self.born[state]), self.parts[state][1]

    def _clear(self) -> None:
        self.step: dict[int, int] = {}  # (node, byte) -> node
        self.last, self.before = [-1], [-1]  # of each node: its last label, and the node before that label

    def _word(self, word: str) -> tuple[str, bytes]:
        """A pre-split word's ids, joined by commas, and the labels on its path."""
        path = self.encode_word(word.encode())
        return ",".join([str(self.ids[k]) for k in path]), b"".join([self.label[k] for k in path])

    def encode_word(self, word: bytes) -> list[int]:
        """The labels on the word's path."""
        if len(self.last) > 400_000:
            self._clear()
        step, nodes, node = self.step, [0], 0
        for i, byte in enumerate(word, 1):
            at = step.get(node << 8 | byte)
            if at is None:
                at = step[node << 8 | byte] = self._node(word, i, nodes)
            nodes.append(node := at)
        out = []
        while node:
            out.append(self.last[node])
            node = self.before[node]
        return out[::-1]

    def _node(self, word: bytes, i: int, nodes: list[int]) -> int:
        for j, token in reversed(self.endings.at(word, i)):
            if j == 0 or self.arcs[self.last[nodes[j]], token]:
                self.last.append(token)
                self.before.append(nodes[j])
                return len(self.last) - 1
        raise ValueError(f"no arc ends at {i} of {word!r}")

    def split(self, text: str) -> list[str]:
        """The text before merges; it is cut at white space and letters as the library cuts it."""
        if not BEYOND.search(text):
            return BYTE_SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in library(self.path).pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> tuple[str, bytes]:
        """The ids, joined by commas, and what their arcs emit."""
        special = added_split(self.path)
        known, ids, out = self.words, [], []
        for k, part in enumerate(special.split(text) if special.search(text) else [text]):
            if k % 2:
                i = merges(self.path).added[part]
                ids.append(str(i))
                out.append(self.by_id[i])
            elif part:
                got = list(map(known.__getitem__, self.split(part)))
                ids.append(",".join([x for x, _ in got]))
                out.append(b"".join([x for _, x in got]))
        return ",".join(ids), b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The emitted bytes as text; broken UTF-8 becomes U+FFFD."""
        return b"".join([self.by_id[i] for i in ids]).decode("utf-8", "replace")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = kept(Automaton, path)
        for b in slices(batches):
            ids = [[int(i) for i in s.split(",")] if (s := a.encode((t or b"").decode())[0]) else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return mapped(df.select(F.col(id_col).cast("long").alias("id"), binary_text(text_col)), run, "id long, ids array<int>", remembers=True).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = BYTE_BPE) -> DataFrame:
    """(id, text); null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = kept(Automaton, path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return mapped(df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col)), run, "id long, text string", remembers=True).withColumnRenamed("id", id_col)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), encoded and decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = kept(Automaton, path)
        for b in slices(batches):
            n, x, y = [], [], []
            for text in b.column(1).to_pylist():
                ids, out = a.encode((text or b"").decode())
                n.append(ids.count(",") + 1 if ids else 0)
                x.append(hashlib.sha256(ids.encode()).hexdigest())
                y.append(hashlib.sha256(out.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x), pa.array(y)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(df.select(F.col(id_col).cast("long").alias("id"), binary_text(text_col)), run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", remembers=True).withColumnRenamed("id", id_col)
