"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped into buckets by length, and buckets into blocks of bounded size; queries come in blocks too. One block of the
longest candidates gives each query a first k-th best score, a lower bound. For every other block the bound becomes a local cosine
threshold: bound / (query's length * block's longest). Above 1 the block is skipped. Where the threshold is high, few vectors can point
near enough: bounds on the query's largest coordinates pick them (coordinate pruning). Where it is low, only those long enough are kept
(length pruning). Products of what is left are computed in full, and each block pair keeps its k best for the query's final ranking.

Rows: a vector that is null or holds null, NaN or infinite components takes no part, as one with a null id; vectors of another length
than the query's aren't its candidates; repeated rows are candidates of their own, but never for a query of their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut

BLOCK, QUERIES, BUCKETS = 4096, 1024, 64
FOCUS, STEEP = 4, 0.6  # coordinates looked at; from this local threshold, coordinates prune better than lengths
EXACT = 2.0**53
NO_BOUND = -(1 << 62)
FOUND = "query_id long, vec_id long, score long"


def whole(scale: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in b["v"]:
                x = None if v is None else np.asarray(v, float)
                out.append(None if x is None or not np.isfinite(x).all() else np.floor(scale * x).astype(np.int64))
            yield pd.DataFrame({"vec_id": b["vec_id"], "vec": [None if x is None else x.tobytes() for x in out], "size": [0 if x is None else len(x) for x in out], "norm": [0.0 if x is None else float(np.sqrt((x.astype(float) ** 2).sum())) for x in out]})

    return run


def ints(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int64).reshape(len(blobs), -1)


def best(q_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, floor: np.ndarray, k: int) -> list[pd.DataFrame]:
    """Each query's k best of at least its bound; ties go to the smaller id. ids ascend."""
    out = []
    for q, row, bound in zip(q_ids.tolist(), scores, floor.tolist(), strict=True):
        at = np.flatnonzero((row >= bound) & (ids != q))
        if len(at) > k:
            cut_off = np.partition(row[at], len(at) - k)[len(at) - k]
            at = at[row[at] >= cut_off]
            at = at[np.lexsort((ids[at], -row[at]))[:k]]
        out.append(pd.DataFrame({"query_id": q, "vec_id": ids[at], "score": row[at]}))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point where every partial sum is a whole number that it can hold."""
    if a.shape[1] and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < EXACT:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def search(k: int):
    """One block of candidates against one block of queries, both of one length."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q, c = rows[rows["is_query"]], rows[~rows["is_query"]].sort_values("vec_id")
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if q.empty or c.empty:
            return none
        qv, cv, ids, norm = ints(q["vec"]), ints(c["vec"]), c["vec_id"].to_numpy(), c["norm"].to_numpy()
        q_ids, q_norm, bound = q["vec_id"].to_numpy(), q["norm"].to_numpy(), q["bound"].to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            need = bound / q_norm  # the length below which no candidate reaches the bound
            local = np.where(bound > 0, need / max(norm.max(), 1e-300), 0.0)
        local[(q_norm == 0) & (bound > 0)] = 2.0
        steep = (local >= STEEP) & (local <= 1 + 1e-12)
        plain = local < STEEP
        out = []
        if plain.any():
            long = norm >= np.min(np.where(bound[plain] > 0, need[plain], 0.0), initial=np.inf) * (1 - 1e-12)
            out += best(q_ids[plain], ids[long], products(qv[plain], cv[long]), bound[plain], k)
        unit = cv / np.maximum(norm, 1e-300)[:, None]
        for i in np.flatnonzero(steep):
            t, x = min(1.0, local[i]) - 1e-9, qv[i] / q_norm[i]
            keep = norm >= need[i] * (1 - 1e-12)
            for f in np.argsort(-np.abs(x))[:FOCUS]:
                spread = np.sqrt((1 - t * t) * max(0.0, 1 - x[f] ** 2)) + 1e-9
                low = -1.0 if x[f] < 0 and -x[f] >= t else x[f] * t - spread
                high = 1.0 if x[f] > 0 and x[f] >= t else x[f] * t + spread
                keep &= (unit[:, f] >= low) & (unit[:, f] <= high)
            out += best(q_ids[i : i + 1], ids[keep], products(qv[i : i + 1], cv[keep]), bound[i : i + 1], k)
        return pd.concat(out) if out else none

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def meet(candidates: DataFrame, queries: DataFrame, blocks: DataFrame, n_queries: int, k: int) -> DataFrame:
    """Blocks of candidates with the blocks of queries of the same length that they may serve. blocks: (size, bucket, block, longest), one row each.

    A query goes to the blocks whose longest vector can reach its bound; a block of candidates goes where any query does.
    """
    n = max(1, -(-n_queries // QUERIES))
    reach = F.col("bound") <= F.greatest(F.col("norm") * F.col("longest") * (1 + 1e-9), F.lit(0.0))
    q = queries.join(blocks, "size").where(reach).withColumn("q_block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    pairs = q.select("size", "bucket", "block", "q_block").distinct()
    columns = ["size", "bucket", "block", "q_block", "vec_id", "vec", "norm"]
    c = candidates.join(pairs, ["size", "bucket", "block"]).select(*columns, F.lit(False).alias("is_query"), F.lit(0).cast("long").alias("bound"))
    return c.unionByName(q.select(*columns, F.lit(True).alias("is_query"), "bound")).groupBy("size", "bucket", "block", "q_block").applyInPandas(search(k), FOUND)


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest integer products of floor(scale * x)."""
    given = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null")
    rows = cut(given.mapInPandas(whole(scale), "vec_id long, vec binary, size int, norm double").where("size > 0"))
    n = rows.count()
    wanted = rows.withColumnRenamed("vec_id", id_col).where(is_query).withColumnRenamed(id_col, "vec_id")
    wanted = wanted.groupBy("vec_id").agg(F.min(F.struct("vec", "size", "norm")).alias("q")).select("vec_id", "q.*")
    n_queries = wanted.count()
    n_buckets = max(1, min(BUCKETS, n // BLOCK))
    edges = sorted(set(rows.select(F.percentile_approx("norm", [i / n_buckets for i in range(1, n_buckets)] or [0.5])).first()[0] or []))
    bucket = sum((F.when(F.col("norm") >= x, 1).otherwise(0) for x in edges), F.lit(0))
    sizes = rows.withColumn("bucket", bucket).groupBy("size", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    dealt = cut(rows.withColumn("bucket", bucket).join(sizes, ["size", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.col("n_blocks")).cast("int")))
    blocks = cut(dealt.groupBy("size", "bucket", "block").agg(F.max("norm").alias("longest")))

    longest = blocks.groupBy("size").agg(F.max(F.struct("bucket", "block", "longest")).alias("b")).select("size", "b.*")
    first = meet(dealt.join(longest.drop("longest"), ["size", "bucket", "block"], "left_semi"), wanted.withColumn("bound", F.lit(NO_BOUND)), longest, n_queries, k)
    bounds = ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = cut(wanted.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(NO_BOUND))))
    found = ranked(meet(dealt, bounded, blocks, n_queries, k), k)
    return found.select("query_id", F.col("rank").cast("int"), F.col("vec_id").alias(id_col), "score")
