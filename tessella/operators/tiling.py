"""Cutting images into overlapping tiles: grids, the tiles of a pixel, neighbours."""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.model import TileSpec
from tessella.operators.post import written

IMAGES, SALT = 100_000, 64  # images whose figures are broadcast, a few numbers each; parts of an image's rows where there are more

_once: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_tables: weakref.WeakSet = weakref.WeakSet()


def once(df: DataFrame) -> DataFrame:
    """A small table, written when it is first asked for, so that it isn't worked out again in each place that needs it."""
    if df in _tables:
        return df
    if df not in _once:
        _once[df] = written(df)
        _tables.add(_once[df])
    return _once[df]


_extents: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def extents(pixels: DataFrame) -> DataFrame:
    """(img, h, w), from one reading of the pixels."""
    if pixels not in _extents:
        _extents[pixels] = once(pixels.groupBy("img").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")))
    return _extents[pixels]


def by_image(rows: DataFrame, figures: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with a row for each image, without a shuffle of rows by image, which would make one image one task.

    Up to IMAGES figures are counted and broadcast. More are joined by a shuffle on the image and one of SALT parts of its rows.
    """
    figures = once(figures)
    if figures.count() <= IMAGES:
        return rows.join(F.broadcast(figures), "img", how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "img"]), F.lit(SALT)))
    parts = figures.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return salted.join(parts, ["img", "salt"], how).drop("salt")


def grid(extent: DataFrame, spec: TileSpec) -> DataFrame:
    """The tiles of each image: origins at every stride up to its edge, clipped there."""
    rows = extent.select("*", F.posexplode(F.sequence(F.lit(0), F.col("h") - 1, F.lit(spec.stride_y))).alias("row", "y0"))
    cells = rows.select("*", F.posexplode(F.sequence(F.lit(0), F.col("w") - 1, F.lit(spec.stride_x))).alias("col", "x0"))
    return cells.select("img", "row", "col", "y0", F.least(F.col("y0") + spec.height, "h").alias("y1"), "x0", F.least(F.col("x0") + spec.width, "w").alias("x1"))


def covering(at: Column, size: int, stride: int) -> Column:
    """The indexes of the tiles along one axis that hold a place."""
    return F.sequence(F.greatest(F.lit(0), F.floor((at - size) / stride).cast("int") + 1), F.floor(at / stride).cast("int"))


def assign(pixels: DataFrame, spec: TileSpec) -> DataFrame:
    """A row for each tile that a pixel is in: row, col, and the place ty, tx within it. No join and no shuffle."""
    rows = pixels.withColumn("row", F.explode(covering(F.col("y"), spec.height, spec.stride_y)))
    cells = rows.withColumn("col", F.explode(covering(F.col("x"), spec.width, spec.stride_x)))
    return cells.withColumn("ty", F.col("y") - F.col("row") * spec.stride_y).withColumn("tx", F.col("x") - F.col("col") * spec.stride_x)


def windows(pixels: DataFrame, size: int, overlap: int) -> DataFrame:
    """A row for each window that a pixel is in, as row and col: one window where the whole image fits, else windows at every size - overlap. Made for steps with an overlap of their own, whatever the tiles'."""
    spec = TileSpec(size, size, overlap)
    sized = by_image(pixels, extents(pixels))
    fits = (F.col("h") <= size) & (F.col("w") <= size)
    over = lambda at: F.when(fits, F.array(F.lit(0))).otherwise(covering(F.col(at), size, spec.stride_y))
    return sized.withColumn("row", F.explode(over("y"))).withColumn("col", F.explode(over("x"))).drop("h", "w")


def edges(tiles: DataFrame, tile_labels: DataFrame, width: int = 3) -> DataFrame:
    """(img, row, col, y, x), within the tile: the outer `width` lines of each tile that is more than twice that wide, where it has no object."""
    sized = tiles.select("img", "row", "col", (F.col("y1") - F.col("y0")).alias("h"), (F.col("x1") - F.col("x0")).alias("w")).where((F.col("h") > 2 * width) & (F.col("w") > 2 * width))
    lines = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    ends = F.concat(F.sequence(F.lit(0), F.lit(width - 1)), F.sequence(F.col("w") - width, F.col("w") - 1))
    whole = (F.col("y") < width) | (F.col("y") >= F.col("h") - width)
    cells = lines.select("img", "row", "col", "y", F.explode(F.when(whole, F.sequence(F.lit(0), F.col("w") - 1)).otherwise(ends)).alias("x"))
    return cells.join(tile_labels.select("img", "row", "col", "y", "x"), ["img", "row", "col", "y", "x"], "left_anti")


def neighbour_pairs(tiles: DataFrame, spec: TileSpec) -> DataFrame:
    """(img, axis, r1, c1, r2, c2): each tile with its right and its lower neighbour, where tiles overlap."""
    if not spec.overlap:
        tiles = tiles.limit(0)
    a = tiles.select("img", F.col("row").alias("r1"), F.col("col").alias("c1"))
    b = tiles.select("img", F.col("row").alias("r2"), F.col("col").alias("c2"))
    right = a.join(b, (a.img == b.img) & (F.col("r1") == F.col("r2")) & (F.col("c1") + 1 == F.col("c2")))
    down = a.join(b, (a.img == b.img) & (F.col("r1") + 1 == F.col("r2")) & (F.col("c1") == F.col("c2")))
    pick = lambda df, axis: df.select(a.img, F.lit(axis).alias("axis"), "r1", "c1", "r2", "c2")
    return pick(right, "right").unionByName(pick(down, "down"))


def batches(tiles: DataFrame, size: int) -> DataFrame:
    """Consecutive tiles, in row-major order, in batches of at most size."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("img").orderBy("row", "col")) - 1
    return tiles.withColumn("batch", F.floor(at / size).cast("int"))


def crop(pixels: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The pixels in (x0, x1, y0, y1), moved to the origin. All four in [0, 1]: shares of the image; else pixels, clamped. A box that holds nothing of an image is an error."""
    x0, x1, y0, y1 = box
    if all(0 <= b <= 1 for b in box):
        if x0 >= x1 or y0 >= y1:
            raise ValueError("the box is empty")
        sized = by_image(pixels, extents(pixels))
        bounds = [F.floor(F.col(side) * F.lit(float(b))).cast("int") for b, side in ((x0, "w"), (x1, "w"), (y0, "h"), (y1, "h"))]
    else:
        if max(0, x0) >= x1 or max(0, y0) >= y1:
            raise ValueError("the box is empty")
        beyond = extents(pixels).where((F.col("w") <= int(x0)) | (F.col("h") <= int(y0))).head()
        if beyond:
            raise ValueError(f"the box is beyond image {beyond['img']} of {beyond['h']} x {beyond['w']}")
        sized, bounds = pixels, [F.lit(max(0, int(b))) for b in box]
    a, b, c, d = bounds
    inside = sized.where((F.col("x") >= a) & (F.col("x") < b) & (F.col("y") >= c) & (F.col("y") < d))
    return inside.select("img", (F.col("y") - c).alias("y"), (F.col("x") - a).alias("x"), "v")


def feather(h: int, w: int, overlap: int) -> Column:
    """The weight of the pixel ty, tx of an h x w tile: 1 within; over the overlap, half a side at most, it rises from 0 and falls from 1 by equal steps."""

    def ramp(at: Column, n: int) -> Column:
        edge = min(overlap, n // 2)
        if edge <= 0:
            return F.lit(1.0)
        return F.when(at < edge, at / edge).when(at >= n - edge, (n - at) / edge).otherwise(1.0)

    return ramp(F.col("ty"), h) * ramp(F.col("tx"), w)


def region(assigned: DataFrame, y0: int, y1: int, x0: int, x1: int, value: str = "label") -> DataFrame:
    """A region read across tiles: of the tiles that cover a pixel the last in row-major order gives its value."""
    inside = assigned.where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1))
    return inside.groupBy("img", "y", "x").agg(F.max_by(value, F.struct("row", "col")).alias(value))


def within(label_px: DataFrame, extent: DataFrame) -> DataFrame:
    """label_px; a pixel outside its image, or of an image that isn't there, fails the job instead of being dropped by a join."""
    sized = by_image(label_px, extent.select("img", "h", "w"), "left")
    inside = F.coalesce((F.col("y") >= 0) & (F.col("y") < F.col("h")) & (F.col("x") >= 0) & (F.col("x") < F.col("w")), F.lit(False))
    fail = F.raise_error(F.format_string("labels don't fit their image: %s, %s, %s", F.col("img").cast("string"), F.col("y"), F.col("x"))).cast("int")
    return sized.withColumn("y", F.when(inside, F.col("y")).otherwise(fail)).drop("h", "w")


def needs_tiles(extent: DataFrame, tile: int, allowed: bool = True) -> DataFrame:
    """(img, tiled): whether an image is cut at all: where it is allowed and a side is longer than a tile."""
    return extent.select("img", (F.lit(allowed) & ((F.col("h") > tile) | (F.col("w") > tile))).alias("tiled"))


def meeting(a: DataFrame, b: DataFrame, cell: int) -> DataFrame:
    """Pairs of rectangles (img, y0, y1, x0, x1; half-open) of two tables that overlap, with all their other columns and the rectangle that they share. Empty ones meet nothing.

    Both go to the cells of a grid that they touch, and a pair is made only in the cell where its common corner lies; so no pair comes twice and nothing is
    compared across cells. cell: about the size of the larger rectangles; a smaller one sends them to more cells, a larger one compares more pairs.
    """
    sides = ("y0", "y1", "x0", "x1")

    def dealt(df: DataFrame, tag: str) -> DataFrame:
        cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell)))
        named = df.where("y0 < y1 and x0 < x1").select("*", cells("y0", "y1").alias("cy")).select("*", cells("x0", "x1").alias("cx"))
        return named.withColumnsRenamed({s: f"{s}{tag}" for s in sides})

    shared = (F.greatest("y0a", "y0b"), F.least("y1a", "y1b"), F.greatest("x0a", "x0b"), F.least("x1a", "x1b"))
    both = dealt(a, "a").join(dealt(b, "b"), ["img", "cy", "cx"]).where((F.col("y0a") < F.col("y1b")) & (F.col("y0b") < F.col("y1a")) & (F.col("x0a") < F.col("x1b")) & (F.col("x0b") < F.col("x1a")))
    own = both.where((F.floor(shared[0] / cell) == F.col("cy")) & (F.floor(shared[2] / cell) == F.col("cx")))
    return own.select("*", *(c.alias(s) for c, s in zip(shared, sides, strict=True))).drop("cy", "cx", *(f"{s}{t}" for s in sides for t in "ab"))
