"""Resolving objects that neighbouring tiles both saw.

A merge never edits part of an object, it only drops whole ones. So pixels are read once, into a few flags for each object, and the
merge runs on that summary; pixels come back only for the assembly.

For a pair of overlapping tiles the one with more live objects (the first on a tie) has priority. It loses the objects in its border
strip, the outer two lines that face the other tile. The other keeps the objects that touch the overlap's inner line and loses those
that lie beyond it. Pairs without any live object in the overlap are left alone. Rows of tiles are chains from left to right, then
columns from top to bottom; chains don't depend on each other and run as groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.model import TileSpec

SIDES = ("right", "left", "down", "up")


def bands(side: str, n: Column, at: Column, overlap: int) -> tuple[Column, Column, Column]:
    """Whether a line of a tile n lines long is in the border strip, on the overlap's inner line (one line either way), or beyond it."""
    far = side in ("right", "down")
    strip = at >= F.greatest(F.lit(0), n - 2) if far else at < F.least(n, F.lit(2))
    if overlap == 0:
        return strip, strip, F.lit(False)
    line = n - overlap if far else F.lit(overlap)
    valid = (line >= 0) & (line < n)
    touching = valid & (at >= F.greatest(F.lit(0), line - 1)) & (at < F.least(n, line + 2))
    beyond = valid & ((at >= line + 2) if far else (at < line - 2))
    return strip, touching, beyond


def object_flags(tile_labels: DataFrame, tiles: DataFrame, spec: TileSpec) -> DataFrame:
    """(img, row, col, label) and for each side b_ (in the border strip), d_ (beyond the inner line and not touching it), s_ (in the overlap of full tiles)."""
    sized = tile_labels.join(tiles.select("img", "row", "col", (F.col("y1") - F.col("y0")).alias("h"), (F.col("x1") - F.col("x0")).alias("w")), ["img", "row", "col"])
    found = []
    for side in SIDES:
        across = side in ("right", "left")
        at, n, stride = (F.col("x"), F.col("w"), spec.stride_x) if across else (F.col("y"), F.col("h"), spec.stride_y)
        strip, touching, beyond = bands(side, n, at, spec.overlap)
        shared = at >= stride if side in ("right", "down") else at < spec.overlap
        found += [F.bool_or(strip).alias(f"b_{side}"), (F.bool_or(beyond) & ~F.bool_or(touching)).alias(f"d_{side}"), F.bool_or(shared).alias(f"s_{side}")]
    return sized.groupBy("img", "row", "col", "label").agg(*found)


def reassign_ids(objects: DataFrame, tiles: DataFrame) -> DataFrame:
    """objects with `id`, unique in the image: tile by tile in row-major order, by label within the tile. Tiles are numbered by a running sum over the grid, so no window spans all objects."""
    per_tile = objects.groupBy("img", "row", "col").agg(F.count("*").alias("n"))
    before = Window.partitionBy("img").orderBy("row", "col").rowsBetween(Window.unboundedPreceding, -1)
    start = tiles.select("img", "row", "col").join(per_tile, ["img", "row", "col"], "left").select("img", "row", "col", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("img", "row", "col").orderBy("label"))
    return objects.withColumn("own", own).join(start, ["img", "row", "col"]).withColumn("id", (F.col("before") + F.col("own")).cast("long")).drop("own", "before")


def relabel_offsets(objects: DataFrame, tiles: DataFrame) -> DataFrame:
    """(img, row, col, offset): the running sum of the largest label of the tiles before, in row-major order."""
    largest = objects.groupBy("img", "row", "col").agg(F.max("label").alias("most"))
    before = Window.partitionBy("img").orderBy("row", "col").rowsBetween(Window.unboundedPreceding, -1)
    return tiles.select("img", "row", "col").join(largest, ["img", "row", "col"], "left").select("img", "row", "col", F.coalesce(F.sum(F.coalesce("most", F.lit(0))).over(before), F.lit(0)).cast("long").alias("offset"))


def merge_pairs(flags: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every pair on its own, from the tiles as segmented: (img, axis, r1, c1, r2, c2, n1, n2, priority, lost1, lost2)."""
    out = None
    for axis, (a, b) in {"right": ("right", "left"), "down": ("down", "up")}.items():
        count = lambda tile, side: flags.groupBy("img", F.col("row").alias(f"r{tile}"), F.col("col").alias(f"c{tile}")).agg(F.count("*").alias(f"n{tile}"), *(F.count_if(f"{k}_{side}").alias(f"{k}{tile}") for k in "bds"))
        both = pairs.where(F.col("axis") == axis).join(count(1, a), ["img", "r1", "c1"], "left").join(count(2, b), ["img", "r2", "c2"], "left").na.fill(0)
        met, first = (F.col("s1") + F.col("s2")) > 0, F.col("n1") >= F.col("n2")
        both = both.select("img", "axis", "r1", "c1", "r2", "c2", "n1", "n2", F.when(~met, 0).when(first, 1).otherwise(2).alias("priority"), F.when(~met, 0).when(first, F.col("b1")).otherwise(F.col("d1")).cast("long").alias("lost1"), F.when(~met, 0).when(first, F.col("d2")).otherwise(F.col("b2")).cast("long").alias("lost2"))
        out = both if out is None else out.unionByName(both)
    return out


def fold(chain: pd.DataFrame, near: str, far: str, order: str) -> pd.DataFrame:
    """One chain of tiles, in the order given: each tile meets the next, with what is left of it. Tiles without objects have a row with a null label."""
    chain = chain.sort_values([order, "label"]).reset_index(drop=True)
    real = chain["label"].notna().to_numpy()
    live = real.copy()
    flag = {(k, s): chain[f"{k}_{s}"].astype("boolean").fillna(False).to_numpy(bool) for k in "bds" for s in (near, far)}
    tiles = [np.asarray(at) for _, at in sorted(chain.groupby(order).indices.items())]
    for a, b in zip(tiles, tiles[1:], strict=False):
        if not (live[a] & flag["s", near][a]).any() and not (live[b] & flag["s", far][b]).any():
            continue
        first = live[a].sum() >= live[b].sum()
        live[a] &= ~flag["b" if first else "d", near][a]
        live[b] &= ~flag["d" if first else "b", far][b]
    return chain[live]


def chain_step(near: str, far: str, order: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return fold(rows.drop(columns="part"), near, far, order)

    return run


def chained(flags: DataFrame, tiles: DataFrame, across: str, order: str, near: str, far: str) -> DataFrame:
    """flags, and a row for each tile without objects, with `part`: each line of tiles is cut before every tile that can't meet the one before it.

    Objects only go, so a pair without any object in its overlap at the start is left alone whatever comes before it. One shuffle, by line, serves the cuts and the merge.
    """
    line = Window.partitionBy("img", across).orderBy(order)
    rows = tiles.select("img", "row", "col").join(flags, ["img", "row", "col"], "left").select(*flags.columns)
    before, here = (F.bool_or(f"s_{side}").over(line.rangeBetween(at, at)) for side, at in ((near, -1), (far, 0)))
    rows = rows.withColumn("part", F.when(F.coalesce(before, F.lit(False)) | F.coalesce(here, F.lit(False)), None).otherwise(F.col(order)))
    return rows.withColumn("part", F.coalesce(F.max("part").over(line.rangeBetween(Window.unboundedPreceding, 0)), F.lit(-1)))


def phase(flags: DataFrame, tiles: DataFrame, across: str, order: str, near: str, far: str) -> DataFrame:
    """The flags of the objects that survive the pairs along one axis. A chain ends where tiles can't meet, so Python gets a line of tiles as many groups."""
    return chained(flags, tiles, across, order, near, far).groupBy("img", across, "part").applyInPandas(chain_step(near, far, order), flags.schema)


def merge_two_phase(flags: DataFrame, tiles: DataFrame) -> DataFrame:
    """The flags of the objects that survive all pairs: chains along rows, then along columns."""
    return phase(phase(flags, tiles, "row", "col", "right", "left"), tiles, "col", "row", "down", "up")


def assemble(tile_labels: DataFrame, survivors: DataFrame, spec: TileSpec) -> DataFrame:
    """label_px of the survivors: where tiles overlap, the first in row-major order that has an object there gives it. survivors: (img, row, col, label, id)."""
    kept = tile_labels.join(survivors.select("img", "row", "col", "label", "id"), ["img", "row", "col", "label"])
    at = kept.select("img", (F.col("y") + F.col("row") * spec.stride_y).alias("y"), (F.col("x") + F.col("col") * spec.stride_x).alias("x"), "row", "col", "id")
    return at.groupBy("img", "y", "x").agg(F.min_by("id", F.struct("row", "col", "id")).alias("label"))


def combine_raw(tile_labels: DataFrame, spec: TileSpec) -> DataFrame:
    """Unmerged labels: where tiles overlap, the last in row-major order that has an object there gives it."""
    at = tile_labels.select("img", (F.col("y") + F.col("row") * spec.stride_y).alias("y"), (F.col("x") + F.col("col") * spec.stride_x).alias("x"), "row", "col", "label")
    return at.groupBy("img", "y", "x").agg(F.max_by("label", F.struct("row", "col", "label")).alias("label"))


def combine_raw_windows(tile_labels: DataFrame, tiles: DataFrame, spec: TileSpec) -> DataFrame:
    """Unmerged labels where each tile with any object also clears its window: only labels of the last such tile over a pixel stay."""
    own = tile_labels.select("img", "row", "col").distinct()
    raw = combine_raw_candidates(tile_labels, spec)
    # the last non-empty tile over a pixel: among the at most four tiles that cover it
    over = raw.select("img", "y", "x").distinct()
    from tessella.operators.tiling import assign

    last = assign(over, spec).join(own, ["img", "row", "col"]).groupBy("img", "y", "x").agg(F.max(F.struct("row", "col")).alias("last"))
    return raw.join(last, ["img", "y", "x"]).where((F.col("row") == F.col("last.row")) & (F.col("col") == F.col("last.col"))).select("img", "y", "x", "label")


def combine_raw_candidates(tile_labels: DataFrame, spec: TileSpec) -> DataFrame:
    return tile_labels.select("img", (F.col("y") + F.col("row") * spec.stride_y).alias("y"), (F.col("x") + F.col("col") * spec.stride_x).alias("x"), "row", "col", "label")
