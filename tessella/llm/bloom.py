"""A Bloom filter of a column of longs: its bits grow with the keys to a fixed bound, so that it may be broadcast at any size of the table.

It is only used where a false positive costs work and changes no result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import U64, mix

PARTS, PROBES = 64, 3
KEY_BITS, LEAST_BITS, MOST_BITS = 12, 1 << 20, 1 << 29


def places(k: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key; bits is a power of two."""
    h = mix(k.view(U64))
    return np.stack([mix(h + U64(j)) & U64(bits - 1) for j in range(PROBES)])


def contains(bloom: np.ndarray, k: np.ndarray) -> np.ndarray:
    at = places(k, len(bloom) * 8)
    return (bloom[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool).all(0)


def bits_for(n: int) -> int:
    """A power of two of at least KEY_BITS for each key, and at most MOST_BITS: beyond, false positives get more."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * n - 1).bit_length() if n else 0))


def build(keys: DataFrame, column: str) -> np.ndarray:
    """Each task sets its keys' bits; the tasks' bits are joined in two rounds, and the driver gets at most MOST_BITS / 8 bytes. keys are read twice."""
    bits = bits_for(keys.count())
    part = bits // PARTS

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for at in places(b[column].to_numpy().astype(np.int64), bits):
                np.bitwise_or.at(on, (at >> U64(3)).astype(np.int64), U64(1).astype(np.uint8) << (at & U64(7)).astype(np.uint8))
        each = on.reshape(PARTS, -1)
        some = np.flatnonzero(each.any(1))
        yield pd.DataFrame({"part": some.astype(np.int32), "turn": np.int32(TaskContext.get().partitionId()), "bits": [zlib.compress(each[i].tobytes(), 1) for i in some]})

    def either(rows: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(part // 8, np.uint8)
        for x in rows["bits"]:
            on |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "turn": rows["turn"].iloc[:1], "bits": [zlib.compress(on.tobytes(), 1)]})

    schema = "part int, turn int, bits binary"
    found = keys.select(column).mapInPandas(spread, schema)
    for turns in (64, 1):
        found = found.withColumn("turn", F.col("turn") % turns).groupBy("part", "turn").applyInPandas(either, schema)
    out = np.zeros(bits // 8, np.uint8)
    for r in found.collect():
        out[r["part"] * (part // 8) : (r["part"] + 1) * (part // 8)] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out
