"""Measures of labelled objects."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.post import line_runs
from tessella.operators.tiling import by_image

#: The codes of a border pixel's neighbourhood (1 for itself, 2 a side, 10 a corner) by the length that they stand for.
STRAIGHT, DIAGONAL, MIXED = (5, 7, 15, 17, 25, 27), (21, 33), (13, 23)
KEY = ["img", "label"]


def area_bbox(label_px: DataFrame) -> DataFrame:
    """(img, label, area, bbox_0..3): pixels, and the half-open box as least y, least x, end y, end x."""
    return label_px.groupBy(*KEY).agg(F.count("*").alias("area"), F.min("y").alias("bbox_0"), F.min("x").alias("bbox_1"), (F.max("y") + 1).alias("bbox_2"), (F.max("x") + 1).alias("bbox_3"))


def moments(label_px: DataFrame) -> DataFrame:
    """(img, label, major_axis_length, minor_axis_length, eccentricity) of the ellipse with the object's second moments, from exact integer sums."""
    y, x = F.col("y").cast("long"), F.col("x").cast("long")
    s = label_px.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(x).alias("sx"), F.sum(y * y).alias("syy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    nn = (F.col("n") * F.col("n")).cast("double")
    s = s.select(*KEY, ((F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")) / nn).alias("vy"), ((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) / nn).alias("vx"), ((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / nn).alias("c"))
    root = F.sqrt((F.col("vy") - F.col("vx")) * (F.col("vy") - F.col("vx")) / 4 + F.col("c") * F.col("c"))
    s = s.withColumn("l1", (F.col("vy") + F.col("vx")) / 2 + root).withColumn("l2", F.greatest((F.col("vy") + F.col("vx")) / 2 - root, F.lit(0.0)))
    ecc = F.when(F.col("l1") > 0, F.sqrt(F.greatest(1 - F.col("l2") / F.nullif("l1", F.lit(0.0)), F.lit(0.0)))).otherwise(0.0)
    return s.select(*KEY, (4 * F.sqrt("l1")).alias("major_axis_length"), (4 * F.sqrt("l2")).alias("minor_axis_length"), ecc.alias("eccentricity"))


def spread(df: DataFrame, weights: dict[tuple[int, int], int]) -> DataFrame:
    """(img, label, y, x, code): each pixel adds a weight to cells around it; one shuffle, in place of a join for each neighbour."""
    cells = F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.lit(w).alias("w")) for (dy, dx), w in weights.items()))
    return df.select(*KEY, F.explode(cells).alias("c")).groupBy(*KEY, "c.y", "c.x").agg(F.sum("c.w").alias("code"))


def perimeter(label_px: DataFrame) -> DataFrame:
    """(img, label, perimeter): border pixels (a side neighbour is not of the object), weighted by how their border neighbours lie."""
    sides = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    counted = spread(label_px, {(0, 0): 100, **dict.fromkeys(sides, 1)})
    border = counted.where((F.col("code") >= 100) & (F.col("code") < 104)).select(*KEY, "y", "x")
    coded = spread(border, {(0, 0): 1, **dict.fromkeys(sides, 2), **{(dy, dx): 10 for dy in (-1, 1) for dx in (-1, 1)}})
    length = F.when(F.col("code").isin(*STRAIGHT), 1.0).when(F.col("code").isin(*DIAGONAL), math.sqrt(2)).when(F.col("code").isin(*MIXED), (1 + math.sqrt(2)) / 2).otherwise(0.0)
    return coded.groupBy(*KEY).agg(F.sum(length).alias("perimeter"))


def mean_intensity(label_px: DataFrame, pixels: DataFrame) -> DataFrame:
    return label_px.join(pixels.select("img", "y", "x", "v"), ["img", "y", "x"]).groupBy(*KEY).agg(F.avg("v").alias("mean_intensity"))


def chain(at: list[int], value: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The corners of the greatest convex function below the points (at ascending, value)."""
    ys: list[int] = []
    xs: list[int] = []
    for y, x in zip(at, value, strict=True):
        while len(ys) > 1 and (xs[-1] - xs[-2]) * (y - ys[-2]) >= (x - xs[-2]) * (ys[-1] - ys[-2]):
            ys.pop()
            xs.pop()
        ys.append(y)
        xs.append(x)
    return np.array(ys, np.int64), np.array(xs, np.int64)


def hull_area(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> int:
    """Lattice points in the convex hull of the pixels' side midpoints, from the least and the greatest x of each line (y ascending), counted line by line.

    Twice the coordinates are whole numbers, and so are all bounds but the hull's sides, which are cut down exactly.
    """

    def bound(x: np.ndarray) -> np.ndarray:
        """The least whole x on each line from the first to the last, within the hull's left side. x: the least of the lines there are."""
        at = np.r_[2 * y - 1, 2 * y, 2 * y + 1]
        value = np.r_[2 * x, 2 * x - 1, 2 * x]
        order = np.lexsort((value, at))
        at, value = at[order], value[order]
        first = np.r_[True, at[1:] != at[:-1]]
        cy, cx = chain(at[first].tolist(), value[first].tolist())
        lines = 2 * np.arange(y[0], y[-1] + 1)
        k = np.searchsorted(cy, lines, "right") - 1
        rise, run = cx[k + 1] - cx[k], cy[k + 1] - cy[k]  # the last corner lies below the last line
        return -((-(cx[k] * run + rise * (lines - cy[k]))) // (2 * run))

    return int((-bound(-b) - bound(a) + 1).sum())


def hole_pixels(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> int:
    """Pixels of an object's holes, from its runs (sorted by y, then a): gaps between the runs of a line are joined with those that they touch on the lines beside it, until outside is met."""
    same = y[1:] == y[:-1]
    gy, ga, gb = y[1:][same], b[:-1][same] + 1, a[1:][same] - 1
    if not len(gy):
        return 0
    lines, first = np.unique(y, return_index=True)
    left, right = a[first], b[np.r_[first[1:], len(y)] - 1]
    open_ = np.zeros(len(gy), bool)
    for step in (-1, 1):
        at = np.minimum(np.searchsorted(lines, gy + step), len(lines) - 1)
        open_ |= (lines[at] != gy + step) | (ga < left[at]) | (gb > right[at])
    wide = int(b.max()) + 2
    starts, ends = gy * wide + ga, gy * wide + gb
    low, high = np.searchsorted(ends, (gy + 1) * wide + ga), np.searchsorted(starts, (gy + 1) * wide + gb, "right")
    many = np.maximum(high - low, 0)
    upper = np.repeat(np.arange(len(gy)), many).tolist()
    under = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)).tolist()
    root = list(range(len(gy)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for p, q in zip(upper, under, strict=True):
        root[find(p)] = find(q)
    names = np.array([find(k) for k in range(len(gy))])
    reached = np.zeros(len(gy), bool)
    reached[names[open_]] = True
    return int((gb - ga + 1)[~reached[names]].sum())


def shape(label_px: DataFrame) -> DataFrame:
    """(img, label, convex_area, filled_area). Spark makes runs of the pixels, line by line; an object comes to Python as its runs, many objects a batch, and nothing has the size of its box."""

    def measured(held: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
        """The figures of the objects in the batches but for the last one, whose runs may go on, and its runs."""
        t = pa.Table.from_batches(held).combine_chunks()
        img, label, y, a, b = (t[c] for c in ("img", "label", "y", "a", "b"))
        codes, names = img.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False), label.to_numpy()
        edges = np.flatnonzero((codes[1:] != codes[:-1]) | (names[1:] != names[:-1])) + 1
        starts = np.r_[0, edges, len(names)].tolist()
        if not last:
            starts = starts[:-1]
        y, a, b = (v.to_numpy().astype(np.int64) for v in (y, a, b))
        convex, filled = [], []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            ys, first = np.unique(y[s:e], return_index=True)
            convex.append(hull_area(ys, a[s:e][first], b[s:e][np.r_[first[1:], e - s] - 1]))
            filled.append(int((b[s:e] - a[s:e] + 1).sum()) + hole_pixels(y[s:e], a[s:e], b[s:e]))
        at = pa.array(starts[:-1], pa.int64())
        out = pa.RecordBatch.from_arrays([img.combine_chunks().take(at), label.combine_chunks().take(at), pa.array(convex, pa.int64()), pa.array(filled, pa.int64())], names=[*KEY, "convex_area", "filled_area"])
        return out, [] if last else t.slice(starts[-1]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                out, held = measured([*held, batch], False)
                yield out
        if held:
            yield measured(held, True)[0]

    rows = line_runs(label_px).repartition(*KEY).sortWithinPartitions(*KEY, "y", "a")
    return rows.select(*KEY, "y", "a", "b").mapInArrow(run, "img string, label long, convex_area long, filled_area long")


def border_touch(boxes: DataFrame, extent: DataFrame) -> DataFrame:
    """boxes with border_touch: a side of the box lies on the image's edge."""
    touch = (F.col("bbox_0") == 0) | (F.col("bbox_1") == 0) | (F.col("bbox_2") == F.col("h")) | (F.col("bbox_3") == F.col("w"))
    return by_image(boxes, extent).withColumn("border_touch", touch).drop("h", "w")


def circularity(area: str = "area", around: str = "perimeter"):
    """4 pi area / perimeter^2 within [0, 1]; null without a perimeter."""
    return F.when(F.col(around) > 0, F.least(F.greatest(4 * math.pi * F.col(area) / F.nullif(F.col(around) * F.col(around), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def measure(label_px: DataFrame, extent: DataFrame, pixels: DataFrame | None = None, geometry: bool = True) -> DataFrame:
    """All metrics; without geometry, solidity and hole_fraction (which need Python) are left out."""
    out = border_touch(area_bbox(label_px), extent).join(moments(label_px), KEY).join(perimeter(label_px), KEY)
    out = out.withColumn("aspect_ratio", F.col("major_axis_length") / F.nullif("minor_axis_length", F.lit(0.0))).withColumn("circularity", circularity())
    if geometry:
        out = out.join(shape(label_px), KEY).withColumn("solidity", F.col("area") / F.nullif("convex_area", F.lit(0))).withColumn("hole_fraction", (F.col("filled_area") - F.col("area")) / F.nullif("area", F.lit(0))).drop("convex_area")
    if pixels is not None:
        out = out.join(mean_intensity(label_px, pixels), KEY, "left")
    return out
