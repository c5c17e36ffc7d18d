"""Where the pixels of a TIFF or .npy file are, from its head alone, and its blocks as arrays.

TIFF: the first image of a classic or a big file, in strips or tiles, of whole or floating numbers, samples interleaved, uncompressed or
deflated with or without the horizontal predictor. Other compressions need a decoder. An .npy file of two or three dimensions is blocks of lines.
"""

from __future__ import annotations

import ast
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Fixed values of the file format: tags, and the bytes and codes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_LINES, STRIP_BYTES, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_BYTES, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
TYPES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 16: (8, "Q")}
PLAIN, DEFLATED = 1, (8, 32946)
KINDS = {1: "u", 2: "i", 3: "f"}

Decoder = Callable[[bytes, "Index", "Block"], np.ndarray]


@dataclass(frozen=True)
class Block:
    """A rectangle of the image and where its bytes are."""

    y0: int
    x0: int
    height: int  # as stored, which may go over the image's edge
    width: int
    start: int
    size: int


@dataclass(frozen=True)
class Index:
    height: int
    width: int
    samples: int
    dtype: str
    compression: int
    predictor: int
    blocks: tuple[Block, ...]

    def array(self, block: Block, data: bytes, decode: Decoder | None = None) -> np.ndarray:
        """The block's pixels (lines, columns, samples) within the image."""
        if self.compression == PLAIN or self.compression in DEFLATED:
            raw = data if self.compression == PLAIN else zlib.decompress(data)
            a = np.frombuffer(raw, self.dtype, block.height * block.width * self.samples).reshape(block.height, block.width, self.samples)
            if self.predictor == 2:
                a = np.cumsum(a, axis=1, dtype=a.dtype)
        elif decode:
            a = np.asarray(decode(data, self, block)).reshape(block.height, block.width, self.samples)
        else:
            raise ValueError(f"compression {self.compression} needs a decoder")
        return a[: self.height - block.y0, : self.width - block.x0]


def tiff_index(read: Callable[[int, int], bytes]) -> Index:
    """read(start, size) gives bytes of the file."""
    try:
        return _tiff_index(read)
    except struct.error as e:
        raise ValueError("the TIFF file is cut off") from e


def _tiff_index(read: Callable[[int, int], bytes]) -> Index:
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    big = version == 43
    at = struct.unpack(f"{order}{'Q' if big else 'I'}", head[8:16] if big else head[4:8])[0]
    n = struct.unpack(f"{order}{'Q' if big else 'H'}", read(at, 8 if big else 2))[0]
    entry, room = (20, 8) if big else (12, 4)
    table = read(at + (8 if big else 2), n * entry)
    found: dict[int, tuple] = {}
    for k in range(n):
        e = table[k * entry : (k + 1) * entry]
        tag, kind = struct.unpack(f"{order}HH", e[:4])
        many = struct.unpack(f"{order}{'Q' if big else 'I'}", e[4 : entry - room])[0]
        if kind in TYPES:
            size, code = TYPES[kind]
            data = e[entry - room :] if size * many <= room else read(struct.unpack(f"{order}{'Q' if big else 'I'}", e[entry - room :])[0], size * many)
            found[tag] = struct.unpack(f"{order}{many}{code}", data[: size * many])
    one = lambda tag, default=None: found.get(tag, (default,))[0]
    height, width, samples = one(HEIGHT), one(WIDTH), one(SAMPLES, 1)
    bits = set(found.get(BITS, (1,)))
    if len(bits) > 1 or next(iter(bits)) % 8 or one(PLANAR, 1) != 1 and samples > 1:
        raise ValueError("samples must be interleaved, of whole bytes and of one size")
    kind = KINDS.get(one(FORMAT, 1))
    if not kind or not height or not width:
        raise ValueError("the image has no size or an unknown kind of numbers")
    if TILE_AT in found:
        h, w, starts, sizes = one(TILE_H), one(TILE_W), found[TILE_AT], found[TILE_BYTES]
    else:
        h, w, starts, sizes = min(one(STRIP_LINES, height), height), width, found[STRIP_AT], found[STRIP_BYTES]
    across = -(-width // w)
    blocks = []
    for k, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        y0 = k // across * h
        blocks.append(Block(y0, k % across * w, h if TILE_AT in found else min(h, height - y0), w, start, size))  # the last strip is cut, a tile is not
    return Index(height, width, samples, f"{order}{kind}{next(iter(bits)) // 8}", one(COMPRESSION, 1), one(PREDICTOR, 1), tuple(blocks))


def npy_index(read: Callable[[int, int], bytes], most: int = 4 << 20) -> Index:
    """Blocks are whole lines of about `most` bytes."""
    head = read(0, 12)
    if head[:6] != b"\x93NUMPY":
        raise ValueError("no .npy file")
    start, size = (10, struct.unpack("<H", head[8:10])[0]) if head[6] == 1 else (12, struct.unpack("<I", head[8:12])[0])
    spec = ast.literal_eval(read(start, size).decode("latin1"))
    shape, kind = spec["shape"], np.dtype(spec["descr"])
    if spec["fortran_order"] or len(shape) not in (2, 3) or kind.hasobject:
        raise ValueError("an .npy image has two or three dimensions, lines first")
    line = kind.itemsize * int(np.prod(shape[1:]))
    step = max(1, most // max(1, line))
    blocks = tuple(Block(y, 0, min(step, shape[0] - y), shape[1], start + size + y * line, min(step, shape[0] - y) * line) for y in range(0, shape[0], step))
    return Index(shape[0], shape[1], shape[2] if len(shape) == 3 else 1, kind.str, PLAIN, 1, blocks)


def index(name: str, read_at: Callable[[int, int], bytes]) -> Index:
    return npy_index(read_at) if name.lower().endswith(".npy") else tiff_index(read_at)


def read(data: bytes, decode: Decoder | None = None) -> np.ndarray:
    """The whole image of a TIFF file: two dimensions, or three if it has several samples."""
    at = tiff_index(lambda start, size: data[start : start + size])
    out = np.zeros((at.height, at.width, at.samples), at.dtype)
    for b in at.blocks:
        a = at.array(b, data[b.start : b.start + b.size], decode)
        out[b.y0 : b.y0 + a.shape[0], b.x0 : b.x0 + a.shape[1]] = a
    return out[:, :, 0] if at.samples == 1 else out


def encode(a: np.ndarray, lines: int = 64, deflate: bool = True) -> bytes:
    """A classic little-endian TIFF file of an array (lines, columns) or (lines, columns, samples), in strips."""
    a = np.ascontiguousarray(a, a.dtype.newbyteorder("<"))
    samples = a.shape[2] if a.ndim == 3 else 1
    strips = [a[y : y + lines].tobytes() for y in range(0, a.shape[0], lines)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    kind = {"u": 1, "b": 1, "i": 2, "f": 3}[a.dtype.kind]
    sizes = list(map(len, strips))
    starts = np.cumsum([8, *sizes])[:-1].tolist()
    fields = {WIDTH: [a.shape[1]], HEIGHT: [a.shape[0]], BITS: [8 * a.dtype.itemsize] * samples, COMPRESSION: [8 if deflate else 1], 262: [2 if samples == 3 else 1], STRIP_AT: starts, SAMPLES: [samples], STRIP_LINES: [lines], STRIP_BYTES: sizes, PLANAR: [1], FORMAT: [kind] * samples}
    at = 8 + sum(sizes)
    at += at % 2
    beyond, entries = b"", b""
    after = at + 2 + 12 * len(fields) + 4
    for tag, values in sorted(fields.items()):
        data = struct.pack(f"<{len(values)}I", *values)
        if len(data) > 4:
            entries += struct.pack("<HHII", tag, 4, len(values), after + len(beyond))
            beyond += data
        else:
            entries += struct.pack("<HHI", tag, 4, len(values)) + data
    body = b"".join(strips)
    return b"II*\x00" + struct.pack("<I", at) + body + b"\x00" * (at - 8 - len(body)) + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + beyond
