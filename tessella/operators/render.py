"""Colours: label tables, overlays, crops."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.tiling import by_image

#: The palette of tiles; how colours follow from a tile's place, and how far they vary.
PALETTE = [
    (255, 100, 100),
    (100, 255, 100),
    (100, 100, 255),
    (255, 255, 100),
    (255, 100, 255),
    (100, 255, 255),
    (255, 150, 100),
    (150, 100, 255),
    (255, 100, 150),
    (150, 255, 100),
]
BY_ROW, BY_COL, VARY, LEAST = 7, 11, 30, 100


def hash_byte(text: Column, k: int) -> Column:
    """Byte k of a text's SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 2 * k + 1, 2), 16, 10).cast("int")


def label_colours(labels: DataFrame) -> DataFrame:
    """(img, label, r, g, b): a stable colour for each label."""
    text = F.col("label").cast("string")
    return labels.select("img", "label").distinct().select("img", "label", *(hash_byte(text, k).alias(c) for k, c in enumerate("rgb")))


def tile_colours(tiles: DataFrame, by_place: bool = False) -> DataFrame:
    """(img, row, col, r, g, b): a palette colour, varied by -30 to 29 within 100 to 255, by a hash of the tile's place.

    The palette's colour follows from the hash too, or from the place itself (by_place), which parts neighbours for certain.
    """
    text = F.concat_ws("_", "row", "col")
    pick, first = (F.pmod(F.col("row") * BY_ROW + F.col("col") * BY_COL, F.lit(len(PALETTE))), 0) if by_place else (hash_byte(text, 0) % 10, 1)
    base = F.element_at(F.array(*(F.array(*map(F.lit, p)) for p in PALETTE)), (pick + 1).cast("int"))
    vary = lambda k: F.least(F.greatest(F.element_at(base, k + 1) + hash_byte(text, first + k) % (2 * VARY) - VARY, F.lit(LEAST)), F.lit(255))
    return tiles.select("img", "row", "col", *(vary(k).alias(c) for k, c in enumerate("rgb")))


def object_colours(labels: DataFrame) -> DataFrame:
    """(img, label, r, g, b): bright colours, of any hue, a saturation of 0.7 to 1 and a value of 0.8 to 1, by a hash of the label (a rule of our own)."""
    part = lambda k: hash_byte(F.concat_ws("/", F.lit("object"), F.col("label")), k) / 256
    s, v = 0.7 + 0.3 * part(1), 0.8 + 0.2 * part(2)

    def channel(n: int) -> Column:
        k = (n + 6 * part(0)) % 6
        return F.floor((v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))) * 255).cast("int")

    return labels.select("img", "label").distinct().select("img", "label", *(channel(n).alias(c) for c, n in zip("rgb", (5, 3, 1), strict=True)))


def object_overlay(pixels: DataFrame, label_px: DataFrame, alpha: float = 0.6) -> DataFrame:
    """rgb of 8-bit pixels with each object in its colour; background stays."""
    over = label_px.join(object_colours(label_px), ["img", "label"])
    both = pixels.join(over, ["img", "y", "x"], "left")
    return both.select("img", "y", "x", *(F.when(F.col("label").isNull(), F.col("v")).otherwise(mix(F.col("v"), F.col(c), alpha)).cast("int").alias(c) for c in "rgb"))


def mix(under: Column, over: Column, alpha: float) -> Column:
    return F.floor(F.least(F.greatest(under * (1 - alpha) + over * alpha, F.lit(0.0)), F.lit(255.0))).cast("int")


def blend(pixels: DataFrame, label_px: DataFrame, alpha: float = 0.5, tile: int = 1024) -> DataFrame:
    """rgb of 8-bit pixels under their labels' colours. Background counts as black; tiles without any label stay as they are."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    both = pixels.join(label_px, ["img", "y", "x"], "left").withColumn("tr", F.floor(F.col("y") / tile)).withColumn("tc", F.floor(F.col("x") / tile))
    both = both.withColumn("any", F.max(F.coalesce("label", F.lit(0))).over(Window.partitionBy("img", "tr", "tc")) > 0)
    coloured = both.join(label_colours(label_px), ["img", "label"], "left")
    return coloured.select("img", "y", "x", *(F.when(F.col("any"), mix(F.col("v"), F.coalesce(c, F.lit(0)), alpha)).otherwise(F.col("v")).cast("int").alias(c) for c in "rgb"))


def verdict_overlay(pixels: DataFrame, label_px: DataFrame, flagged: DataFrame, alpha: float = 0.35) -> DataFrame:
    """rgb with objects that passed in green and others in red; background stays."""
    both = pixels.join(label_px.join(flagged.select("img", "label", "passed"), ["img", "label"]), ["img", "y", "x"], "left")
    over = {"r": F.when(F.col("passed"), 0).otherwise(255), "g": F.when(F.col("passed"), 255).otherwise(0), "b": F.lit(0)}
    return both.select("img", "y", "x", *(F.when(F.col("passed").isNull(), F.col("v")).otherwise(mix(F.col("v"), over[c], alpha)).cast("int").alias(c) for c in "rgb"))


def tile_overlay(pixels: DataFrame, label_px: DataFrame, tiles: DataFrame, alpha: float = 0.6) -> DataFrame:
    """rgb of unmerged labels in their tile's colour; where tiles overlap they are laid on in row-major order. label_px: (img, row, col, y, x, label) in image places."""
    laid = label_px.join(tile_colours(tiles), ["img", "row", "col"]).groupBy("img", "y", "x").agg(F.sort_array(F.collect_list(F.struct("row", "col", "r", "g", "b"))).alias("over"))  # at most the tiles over a pixel
    both = pixels.join(laid, ["img", "y", "x"], "left")
    layer = lambda c: F.aggregate(F.coalesce("over", F.array().cast(laid.schema["over"].dataType)), F.col("v").cast("int"), lambda acc, o: mix(acc, o[c], alpha))
    return both.select("img", "y", "x", *(layer(c).alias(c) for c in "rgb"))


def edge_overlay(pixels: DataFrame, edges: DataFrame, tiles: DataFrame, alpha: float = 0.15) -> DataFrame:
    """Tile edges (see tiling.edges) laid thinly over the pixels in their tiles' colours."""
    placed = edges.join(tiles.select("img", "row", "col", "y0", "x0"), ["img", "row", "col"]).select("img", (F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"), "row", "col")
    return tile_overlay(pixels, placed, tiles, alpha)


def binary(pixels: DataFrame, label_px: DataFrame) -> DataFrame:
    """255 where there is an object, else 0."""
    return pixels.join(label_px, ["img", "y", "x"], "left").select("img", "y", "x", F.when(F.col("label").isNotNull(), 255).otherwise(0).alias("v"))


def centre_crop(extent: DataFrame, size: int) -> DataFrame:
    """(img, y0, y1, x0, x1): the middle of each image, half of size either way; the whole image where both sides fit."""
    fits = (F.col("h") <= size) & (F.col("w") <= size)
    middle = lambda side: F.floor(F.col(side) / 2).cast("int")
    low = lambda side: F.when(fits, 0).otherwise(F.greatest(F.lit(0), middle(side) - size // 2))
    high = lambda side: F.when(fits, F.col(side)).otherwise(F.least(F.col(side), middle(side) + size // 2))
    return extent.select("img", low("h").alias("y0"), high("h").alias("y1"), low("w").alias("x0"), high("w").alias("x1"))


#: The centres of candidate crops, as shares of the height and the width, in the order in which they are tried.
CROP_CENTRES = [(0.5, 0.66), (0.5, 0.5), (0.25, 0.25), (0.25, 0.75), (0.75, 0.25), (0.75, 0.75), (0.5, 0.25), (0.5, 0.75), (0.25, 0.5), (0.75, 0.5)]


def best_crop(pixels: DataFrame, extent: DataFrame, size: int) -> DataFrame:
    """(img, y0, y1, x0, x1, mean): of the candidates the window with the largest mean, the first on a tie; the whole image where both sides fit.

    A window begins half of size before its centre, at the image's edge at the earliest, and ends at the other edge at the latest.
    """
    fits = (F.col("h") <= size) & (F.col("w") <= size)
    low = lambda side, share: F.when(fits, 0).otherwise(F.greatest(F.lit(0), F.floor(F.col(side) * share).cast("int") - size // 2))
    windows = F.array(*(F.struct(F.lit(k).alias("k"), low("h", a).alias("y0"), low("w", b).alias("x0")) for k, (a, b) in enumerate(CROP_CENTRES)))
    spots = extent.select("img", "h", "w", F.explode(windows).alias("c")).select("img", "c.*", F.least("h", F.col("c.y0") + size).alias("y1"), F.least("w", F.col("c.x0") + size).alias("x1"))
    inside = by_image(pixels, spots).where((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    means = inside.groupBy("img", "k", "y0", "y1", "x0", "x1").agg(F.avg("v").alias("mean"))
    return means.withColumn("best", F.row_number().over(Window.partitionBy("img").orderBy(F.desc("mean"), "k"))).where("best = 1").select("img", "y0", "y1", "x0", "x1", "mean")


def cut_out(pixels: DataFrame, crops: DataFrame) -> DataFrame:
    """The pixels within each image's crop (img, y0, y1, x0, x1), moved to its origin."""
    inside = by_image(pixels, crops.select("img", "y0", "y1", "x0", "x1")).where((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    return inside.withColumn("y", F.col("y") - F.col("y0")).withColumn("x", F.col("x") - F.col("x0")).drop("y0", "y1", "x0", "x1")


def background(sources: list[DataFrame], extent: DataFrame) -> DataFrame:
    """Pixels of each image from the first source that has it; an image that none has is black."""
    named = [s.select("img").distinct().withColumn("source", F.lit(k)) for k, s in enumerate(sources)]
    first = functools.reduce(DataFrame.unionByName, named).groupBy("img").agg(F.min("source").alias("source"))
    found = functools.reduce(DataFrame.unionByName, [by_image(s, first.where(F.col("source") == k), "left_semi") for k, s in enumerate(sources)])
    rows = extent.join(first, "img", "left_anti").select("img", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    return found.unionByName(rows.select("img", "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"), F.lit(0).alias("v")))
