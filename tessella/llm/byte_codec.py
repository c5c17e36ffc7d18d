"""Byte-level BPE encoding and decoding by the tiktoken library, with ranks from a local file.

The library cuts a text by its pattern and merges the bytes of each match. Long texts are handed to it in parts, cut only where no match
can go across: after a letter or digit of ASCII before another kind of ASCII character, or after any character that is not white space
before white space of ASCII. The pattern never looks back, and looks ahead only within white space, which such a cut leaves
whole; so the parts' ids in a row are the text's ids. Long runs of white space, in which the library's pattern matcher gives up, are one match but
for a last character that something follows; they are merged as the one piece that they are. A part without a safe place is longer than others and
encoded whole. Decoding joins the ids' raw bytes, which may be no valid UTF-8 when ids were cut; nothing is replaced.

Rows: null and empty texts have no ids; null ids decode to no bytes; special strings inside texts are plain text; repeated rows and
null document ids give a row each; other columns are ignored. Texts of any length are encoded whole, within memory for the text and its ids. One
stage, no shuffle, so a lost executor costs its own tasks.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import binary_text, kept, mapped, slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

PART = 1 << 16  # characters of a text's parts, about
#: White space beyond ASCII, and with it all that the pattern's \s has.
WHITE_BEYOND = "\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WHITE = "\t-\r " + WHITE_BEYOND
SAFE = re.compile("(?<=[A-Za-z])(?=[\x00-@\\[-`{-\x7f])|(?<=[0-9])(?=[\x00-/:-\x7f])" + r"|(?<=\S)(?=[\t-\r ])")


class Codec:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, part: int = PART):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.library = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.part = part
        self.long_white = re.compile(f"[{WHITE}]{{{part // 2},}}")
        self.written = [str(i) for i in range(self.library.n_vocab)]

    def parts(self, text: str) -> Iterator[str]:
        """The text, cut at safe places."""
        start = 0
        while len(text) - start > self.part and (cut := SAFE.search(text, start + self.part)):
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.part:
            return self.library.encode_ordinary(text)
        ids, start = [], 0
        for run in self.long_white.finditer(text):
            for part in self.parts(text[start : run.start()]):
                ids += self.library.encode_ordinary(part)
            start = run.end() - (run.end() < len(text))  # the last one may belong to what follows
            ids += self.library._encode_single_piece(text[run.start() : start])
        for part in self.parts(text[start:]):
            ids += self.library.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """(id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = kept(Codec, path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode((t or b"").decode()) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["id", "ids"])

    return mapped(df.select(F.col(id_col).cast("long").alias("id"), binary_text(text_col)), run, "id long, ids array<int>", remembers=True).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = RANKS) -> DataFrame:
    """(id, data binary): the raw bytes. An id that the file doesn't have is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = kept(Codec, path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], names=["id", "data"])

    return mapped(df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col)), run, "id long, data binary", remembers=True).withColumnRenamed("id", id_col)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), encoded and decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = kept(Codec, path)
        for b in slices(batches):
            n, x, y = [], [], []
            for text in b.column(1).to_pylist():
                ids = c.encode((text or b"").decode())
                n.append(len(ids))
                x.append(hashlib.sha256(" ".join(map(c.written.__getitem__, ids)).encode()).hexdigest())
                y.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(df.select(F.col(id_col).cast("long").alias("id"), binary_text(text_col)), run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", remembers=True).withColumnRenamed("id", id_col)
