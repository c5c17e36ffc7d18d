"""Merge tables of byte-pair vocabularies, and the splits that come before the merges."""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass, field

import public_tokenizers

from tessella.llm.common import _with_kept

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

#: Up to U+00FF the classes are spelled out (they are the same in every version of Unicode); texts beyond go to the library's own splitter.
LETTER, NUMBER, SPACE = "a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
CONTRACTION = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_SPLIT = re.compile(f"{CONTRACTION}|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
BYTE_SPLIT = re.compile(f"{CONTRACTION}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BEYOND = re.compile("[^\x00-\xff]")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


BYTE_CHARS = byte_chars()


CHAR_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}


def unspelled(token: str) -> bytes:
    return bytes(map(CHAR_BYTES.__getitem__, token))


class Endings:
    """A trie of reversed tokens: which of them end at a place of a word."""

    def __init__(self, tokens: dict[bytes, int]):
        self.next, self.token = {}, [-1]
        for spelling, k in tokens.items():
            node = 0
            for byte in reversed(spelling):
                at = self.next.setdefault(node << 8 | byte, len(self.token))
                if at == len(self.token):
                    self.token.append(-1)
                node = at
            self.token[node] = k

    def at(self, word: bytes, i: int) -> list[tuple[int, int]]:
        """(start, token) of the tokens that end at i, short ones first."""
        out, node, step, token = [], 0, self.next, self.token
        for j in range(i - 1, -1, -1):
            node = step.get(node << 8 | word[j])
            if node is None:
                break
            if token[node] >= 0:
                out.append((j, token[node]))
        return out


@dataclass
class Merges:
    """Tokens numbered in the order in which they come to be: symbols first, then one a merge.

    inner and final map a token's bytes to its number; final holds those that end a word (all, where the vocabulary has no word ends).
    """

    path: str
    suffix: str = ""
    ids: list[int] = field(default_factory=list)  # the vocabulary's id of each number
    rank: list[int] = field(default_factory=list)  # the merge that makes it; -1: a symbol
    parts: list[tuple[int, int] | None] = field(default_factory=list)
    joined: dict[tuple[int, int], int] = field(default_factory=dict)
    inner: dict[bytes, int] = field(default_factory=dict)
    final: dict[bytes, int] = field(default_factory=dict)
    added: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = {a + b for a, b in pairs}
        number: dict[str, int] = {}
        for token in sorted(vocab.keys() - made - self.added.keys(), key=vocab.get):
            number[token] = self._new(vocab[token], None)
        for a, b in pairs:
            if a + b not in number:
                number[a + b] = self._new(vocab[a + b], (number[a], number[b]))
            self.joined[number[a], number[b]] = number[a + b]
        for token, k in number.items():
            if self.suffix and token.endswith(self.suffix):
                self.final[unspelled(token[: -len(self.suffix)])] = k
            else:
                self.inner[unspelled(token)] = k
        if not self.suffix:
            self.final = self.inner

    def _new(self, vocab_id: int, parts: tuple[int, int] | None) -> int:
        self.ids.append(vocab_id)
        self.parts.append(parts)
        self.rank.append(-1 if parts is None else len(self.joined))
        return len(self.ids) - 1


@functools.cache
def merges(path: str) -> Merges:
    return Merges(path)


@functools.cache
def library(path: str):
    """The public library's tokenizer, without truncation or padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


_with_kept += [merges.cache_clear, library.cache_clear]


@functools.cache
def added_split(path: str) -> re.Pattern | None:
    """Splits a text at the added special strings, longest first; they are kept at the odd places."""
    added = sorted(merges(path).added, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None


def plain_pieces(path: str, text: str) -> list[str] | None:
    """A text's pre-split words in lower case; None where the text has characters or special strings that the library must see."""
    if BEYOND.search(text) or ("<" in text and added_split(path).search(text)):
        return None
    return WORD_SPLIT.findall(text.lower())
