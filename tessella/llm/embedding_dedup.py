"""Near-duplicate vectors by an exact metric range join.

Cosine >= c on unit vectors is a distance of at most r = sqrt(2 - 2c). Equal vectors of a label are one class, compared once. Pivots (a
bounded random sample) split the space into cells by the nearest pivot. If x and y are within r and lie in different cells, the
triangle inequality puts both within r of the plane between the two pivots; so a vector is also sent to the cells of earlier pivots
whose plane is that near, and to no others. Cells join on their own. A cell is cut into blocks of bounded size that meet pair by pair,
so a hot label makes more tasks, not longer ones. A block pair returns numbers of links and a spanning forest of them, never all pairs.

Rows: a vector that is null, zero, or holds null, NaN or infinite components, and one with a null label, links with nothing; vectors of
different lengths don't link; repeated rows are vectors of their own; a null id is never the least of a component that has others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, mapped
from tessella.llm.components import components

BLOCK, MOST_PIVOTS, PER_PIVOT = 2048, 128, 4096
SLACK = 1e-9  # of distances


def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the vector by its unit vector's bytes, null where it takes no part."""
    for b in batches:
        out = []
        for v in b.column(2).to_pylist():
            x = np.array([np.nan if e is None else e for e in v or []], float)
            size = float(np.linalg.norm(x / (top := np.abs(x).max() or 1.0)) * top) if len(x) and np.isfinite(x).all() else 0.0
            out.append((x / size).tobytes() if 0 < size < np.inf else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["id", "label", "vec"])


def stacked(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), float).reshape(len(blobs), -1)


def forest(near: np.ndarray, home: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the matrix of pairs joins, one less than the nodes of each component."""
    out, rows, cols = [], near.any(1), near.any(0)
    while rows.any():
        at = int(np.argmax(rows))
        top, rows[at] = home[at], False
        row = np.array([at])
        while len(row):
            col = np.flatnonzero(near[row].any(0) & cols)
            cols[col] = False
            out += [(top, k) for k in other[col].tolist() if k != top]
            row = np.flatnonzero(near[:, col].any(1) & rows) if len(col) else col
            rows[row] = False
            out += [(top, k) for k in home[row].tolist() if k != top]
    return out


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each vector."""
    r = float(np.sqrt(max(0.0, 2 - 2 * least)))
    given = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    vectors = cut(mapped(given, unit, "id long, label string, vec binary").withColumn("k", F.when(F.col("label").isNotNull(), F.xxhash64("label", "vec", F.length("vec")))))
    taking = vectors.where("vec is not null and label is not null")
    classes = cut(taking.groupBy("k", "label", "vec").agg(F.count("*").alias("n"), F.min("id").alias("least_id")))

    n_classes = classes.count()
    pivots = [bytes(x.vec) for x in classes.orderBy(F.xxhash64("k"), "k").limit(min(MOST_PIVOTS, 1 + n_classes // PER_PIVOT)).select("vec").collect()]
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_size = {}
        for p in shared.value:
            by_size.setdefault(len(p), []).append(p)
        for b in batches:
            for size, rows in b.groupby(b["vec"].map(len)):
                x = stacked(rows["vec"])
                p = stacked(pd.Series(by_size[size])) if size in by_size else np.zeros((1, x.shape[1]))
                d2 = np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1))
                home = d2.argmin(1)
                between = np.sqrt(np.maximum(0, ((p[:, None] - p) ** 2).sum(2)))
                plane = (d2 - d2[np.arange(len(x)), home][:, None]) / np.maximum(2 * between[home], 1e-300)
                sent = (plane <= r + SLACK) & (np.arange(len(p)) < home[:, None])
                sent[np.arange(len(x)), home] = True
                row, cell = np.nonzero(sent)
                out = rows.iloc[row].reset_index(drop=True)
                yield out[["k", "label", "n", "vec"]].assign(size=size, cell=cell, home=cell == home[row])

    sent = cut(classes.select("k", "label", "n", "vec").mapInPandas(assign, "k long, label string, n long, vec binary, size int, cell int, home boolean"))
    cell = ["label", "size", "cell"]
    sizes = sent.groupBy(*cell).agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("n_home"), F.ceil(F.count("*") / BLOCK).cast("int").alias("n_all")).where("n_home > 0")
    sent = sent.join(sizes, cell)
    any_block = F.pmod(F.xxhash64("k"), F.col("n_all")).cast("int")
    home_block = F.pmod(F.xxhash64("k"), F.col("n_home")).cast("int")
    homes = sent.where("home").select(*cell, "k", "n", "vec", "home", F.lit(True).alias("inner"), home_block.alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"))
    others = sent.select(*cell, "k", "n", "vec", "home", F.lit(False).alias("inner"), F.explode(F.sequence(F.lit(0), F.col("n_home") - 1)).alias("i"), any_block.alias("j"))

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        h, o = rows[rows["inner"]], rows[~rows["inner"]]
        if h.empty or o.empty:
            return pd.DataFrame({"k": [], "links": [], "other": []})
        hk, ok = h["k"].to_numpy(), o["k"].to_numpy()
        near = (stacked(h["vec"]) @ stacked(o["vec"]).T >= least) & ~(o["home"].to_numpy() & (ok <= hk[:, None]))
        by_home, by_other = near @ o["n"].to_numpy(), near.T @ h["n"].to_numpy()
        at, to = np.flatnonzero(by_home), np.flatnonzero(by_other)
        tree = forest(near, hk, ok)
        return pd.DataFrame({"k": [*hk[at], *ok[to], *(a for a, _ in tree)], "links": [*by_home[at], *by_other[to], *[0] * len(tree)], "other": pd.array([*[None] * (len(at) + len(to)), *(b for _, b in tree)], "Int64")})

    found = cut(homes.unionByName(others).groupBy(*cell, "i", "j").applyInPandas(verify, "k long, links long, other long"))
    near = found.where("other is null").groupBy("k").agg(F.sum("links").alias("links"))
    group = components(found.where("other is not null").select(F.col("k").alias("a"), F.col("other").alias("b")))
    least_id = group.join(classes.select(F.col("k").alias("node"), "least_id"), "node").groupBy("component").agg(F.min("least_id").alias("component_id"))
    grouped = group.join(least_id, "component").select(F.col("node").alias("k"), "component_id")
    known = classes.select("k", "n", "least_id").join(near, "k", "left").join(grouped, "k", "left")
    known = cut(known.select("k", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id")))  # written, so that Spark can split the join of a class with many vectors
    out = vectors.select("id", F.when(F.col("vec").isNotNull(), F.col("k")).alias("k")).join(known, "k", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
