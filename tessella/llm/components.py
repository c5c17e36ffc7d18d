"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut


def local_stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch's links replaced by a star for each of its components: never more rows than nodes."""
    for b in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent=parent) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for x, y in zip(b["a"].tolist(), b["b"].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        nodes = np.array(list(parent), np.int64)
        roots = np.array([root(x) for x in nodes.tolist()], np.int64)
        keep = nodes != roots
        yield pd.DataFrame({"a": nodes[keep], "b": roots[keep]})


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): component is the least node reachable.

    Each round hangs every neighbour on the least one (large star), then every smaller neighbour (small star); both keep components
    and shorten paths, and the rounds grow with the logarithm of the longest path. A round's result is written to the shared folder.
    """
    edges = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))  # so that no task holds two Python workers
    edges = cut(edges.mapInPandas(local_stars, "a long, b long").distinct())
    seen = None
    while True:
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sign == seen:
            break
        seen = sign
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))  # written, so that Spark can split the joins of a node with many links
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.col("b"), F.col("a"))).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = cut(small)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
