"""Contrast: percentiles, 8-bit stretch, gamma, local equalisation, resizing, tile statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.tiling import by_image, extents

SAMPLE = 1_000_000  # pixels that percentiles are taken from, about, by a fixed stride
BLOCK = 64  # squares of four pixels on a side of what one task resizes at once


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luminance (ITU-R BT.709 weights)."""
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def percentiles(pixels: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """(img, lo, hi): exact percentiles of every k-th pixel in row-major order."""
    sized = by_image(pixels, extents(pixels))
    k = F.greatest(F.lit(1), F.floor(F.col("h") * F.col("w") / SAMPLE)).cast("long")
    sampled = sized.where((F.col("y") * F.col("w") + F.col("x")) % k == 0)
    return sampled.groupBy("img").agg(F.percentile("v", low).alias("lo"), F.percentile("v", high).alias("hi"))


def stretch(v: Column, lo: Column, hi: Column) -> Column:
    """0 to 255, truncated; 0 where the range is empty."""
    share = F.least(F.greatest((v - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(hi > lo, F.floor(share * 255).cast("int")).otherwise(0)


def to_8bit(pixels: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Pixels stretched between their image's percentiles, or between its extremes where those are equal."""
    ends = pixels.groupBy("img").agg(F.min("v").alias("least"), F.max("v").alias("most"))
    bounds = percentiles(pixels, low, high).join(ends, "img")
    flat = F.col("hi") <= F.col("lo")
    bounds = bounds.select("img", F.when(flat, F.col("least")).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("most")).otherwise(F.col("hi")).alias("hi"))
    return by_image(pixels, bounds).select("img", "y", "x", stretch(F.col("v"), F.col("lo"), F.col("hi")).alias("v"))


def gammas(tiled: DataFrame, least: float = 1.9, most: float = 2.2) -> DataFrame:
    """(img, row, col, gamma) of 8-bit tiles: the brighter the median, the smaller."""
    brightness = F.percentile("v", 0.5) / 255
    gamma = F.least(F.greatest(F.lit(most) - F.lit(most - least) * brightness, F.lit(least)), F.lit(most))
    return tiled.groupBy("img", "row", "col").agg(gamma.alias("gamma"))


def gamma_correct(tiled: DataFrame, least: float = 1.9, most: float = 2.2) -> DataFrame:
    """8-bit tiles raised to 1 / gamma of their tile."""
    out = tiled.join(gammas(tiled, least, most), ["img", "row", "col"])
    return out.withColumn("v", F.floor(F.pow(F.col("v") / 255, 1 / F.col("gamma")) * 255).cast("int")).drop("gamma")


def merge_tiles_last(tiled: DataFrame) -> DataFrame:
    """Pixels of processed tiles; where tiles overlap the last in row-major order holds."""
    return tiled.groupBy("img", "y", "x").agg(F.max_by("v", F.struct("row", "col")).alias("v"))


def tile_stats(tiled: DataFrame) -> DataFrame:
    """(img, row, col, n, mean, std, least, most)."""
    return tiled.groupBy("img", "row", "col").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))


def low_contrast(stats: DataFrame, std: float = 1.0, span: int = 5) -> DataFrame:
    """Tiles with next to no contrast."""
    return stats.where((F.col("std") < std) | (F.col("most") - F.col("least") < span))


def equalise(pixels: DataFrame, clip: float = 2.0, cells: int = 8) -> DataFrame:
    """Contrast-limited local equalisation of 8-bit pixels: each cell's clipped histogram gives a table, and a pixel blends those of the four nearest cell centres.

    The four tables are put side by side for each value, so that a pixel meets one row of four numbers and is never copied. Values beyond 8 bits count as 0 or 255.
    """
    sized = by_image(pixels, extents(pixels)).withColumn("v", F.least(F.greatest("v", F.lit(0)), F.lit(255)).cast("int"))
    n_y, n_x = (F.greatest(F.lit(1), F.least(F.lit(cells), F.floor(F.col(s) / 32).cast("int"))) for s in ("h", "w"))
    sized = sized.withColumn("ny", n_y).withColumn("nx", n_x).withColumn("fy", (F.col("y") + 0.5) * F.col("ny") / F.col("h")).withColumn("fx", (F.col("x") + 0.5) * F.col("nx") / F.col("w"))
    counts = sized.groupBy("img", F.floor("fy").cast("int").alias("cy"), F.floor("fx").cast("int").alias("cx"), "v").agg(F.count("*").alias("n"), F.first("ny").alias("ny"), F.first("nx").alias("nx"))
    per_cell = Window.partitionBy("img", "cy", "cx")
    total = F.sum("n").over(per_cell)
    counts = counts.withColumn("total", total).withColumn("limit", F.greatest(F.lit(1.0), F.lit(clip) * F.col("total") / 256))
    # what is cut off goes to all 256 values alike; the running sum of a value is that of the values up to it
    extra = F.sum(F.greatest(F.col("n") - F.col("limit"), F.lit(0.0))).over(per_cell) / 256
    counts = counts.withColumn("extra", extra).withColumn("kept", F.least(F.col("n").cast("double"), "limit"))
    in_order = per_cell.orderBy("v")
    upto = F.sum("kept").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    # a sum holds until the next value that occurs; before the first it is 0
    held = F.sequence(F.when(F.row_number().over(in_order) == 1, 0).otherwise(F.col("v")), F.lead("v", 1, 256).over(in_order) - 1)
    table = counts.select("img", "cy", "cx", "ny", "nx", "total", "extra", upto.alias("upto"), F.col("v").alias("from"), held.alias("held")).select("*", F.explode("held").alias("v"))
    mapped = (F.when(F.col("v") >= F.col("from"), F.col("upto")).otherwise(0.0) + F.col("extra") * (F.col("v") + 1)) * 255 / F.col("total")
    table = table.select("img", "cy", "cx", "ny", "nx", "v", mapped.alias("mapped"))

    beside = lambda at: F.explode(F.array(F.col(at) - 1, F.col(at)))
    corner = lambda i, j: (F.col("cy") == F.least(F.greatest(F.col("qy") + i, F.lit(0)), F.col("ny") - 1)) & (F.col("cx") == F.least(F.greatest(F.col("qx") + j, F.lit(0)), F.col("nx") - 1))
    corners = [(i, j) for i in (0, 1) for j in (0, 1)]
    squares = table.select("*", beside("cy").alias("qy")).select("*", beside("cx").alias("qx")).groupBy("img", "qy", "qx", "v").agg(*(F.max(F.when(corner(i, j), F.col("mapped"))).alias(f"t{i}{j}") for i, j in corners))
    gy, gx = F.col("fy") - 0.5, F.col("fx") - 0.5
    near = sized.select("img", "y", "x", "v", F.floor(gy).cast("int").alias("qy"), F.floor(gx).cast("int").alias("qx"), (gy - F.floor(gy)).alias("ay"), (gx - F.floor(gx)).alias("ax"))
    ay, ax = F.col("ay"), F.col("ax")
    a, b, c, d = (F.coalesce(((ay if i else 1 - ay) * (ax if j else 1 - ax)) * F.col(f"t{i}{j}"), F.lit(0.0)) for i, j in corners)
    blended = near.join(squares, ["img", "qy", "qx", "v"]).select("img", "y", "x", (a + b + c + d).alias("v"))
    return blended.select("img", "y", "x", F.least(F.greatest(F.round(F.round("v", 6)), F.lit(0.0)), F.lit(255.0)).cast("int").alias("v"))


def upscale(pixels: DataFrame, factor: float) -> DataFrame:
    """Bilinear resize by factor, with pixel centres at half places and edges repeated. Sums are rounded twice, so that their order doesn't matter.

    A square of four neighbouring pixels gives all places between them. Pixels go to blocks of BLOCK x BLOCK squares in one shuffle, and squares are put together
    and resized where they are then, so the work is dealt like the pixels and nothing is joined.
    """
    sized = by_image(pixels, extents(pixels)).select("img", "y", "x", "v", "h", "w")
    over = lambda at: F.explode(F.sequence(F.floor((F.col(at) - 1) / BLOCK), F.floor(F.col(at) / BLOCK)))
    dealt = sized.select("*", over("y").alias("by")).select("*", over("x").alias("bx")).repartition("img", "by", "bx")
    square = lambda at: F.explode(F.array(F.col(at) - 1, F.col(at)))
    parts = dealt.select("*", square("y").alias("qy")).where(F.floor(F.col("qy") / BLOCK) == F.col("by")).select("*", square("x").alias("qx")).where(F.floor(F.col("qx") / BLOCK) == F.col("bx"))
    corner = lambda i, j: F.sum(F.when((F.col("y") == F.col("qy") + i) & (F.col("x") == F.col("qx") + j), F.col("v")))
    squares = parts.groupBy("img", "by", "bx", "qy", "qx").agg(F.first("h").alias("h"), F.first("w").alias("w"), *(corner(i, j).alias(f"v{i}{j}") for i in (0, 1) for j in (0, 1)))

    squares = squares.withColumns({t: F.round(F.col(n) * factor).cast("int") for t, n in (("th", "h"), ("tw", "w"))})
    for q, t, at, n, m, share in (("qy", "ty", "sy", "h", "th", "ay"), ("qx", "tx", "sx", "w", "tw", "ax")):
        first, last = (F.col(q) + 0.5) * F.col(m) / F.col(n) - 0.5, (F.col(q) + 1.5) * F.col(m) / F.col(n) - 0.5
        near = F.sequence(F.greatest(F.floor(first).cast("int"), F.lit(0)), F.least(F.ceil(last).cast("int"), F.col(m) - 1))
        squares = squares.withColumn(t, F.explode(near)).withColumn(at, (F.col(t) + 0.5) * F.col(n) / F.col(m) - 0.5).where(F.floor(at) == F.col(q)).withColumn(share, F.col(at) - F.floor(at))
    over_y = lambda i, j: F.when(F.col("qy") < 0, F.col(f"v1{j}")).when(F.col("qy") == F.col("h") - 1, F.col(f"v0{j}")).otherwise(F.col(f"v{i}{j}"))
    at_edge = lambda i, j: F.when(F.col("qx") < 0, over_y(i, 1)).when(F.col("qx") == F.col("w") - 1, over_y(i, 0)).otherwise(over_y(i, j))
    ay, ax = F.col("ay"), F.col("ax")
    a, b, c, d = (F.coalesce(((ay if i else 1 - ay) * (ax if j else 1 - ax)) * at_edge(i, j), F.lit(0.0)) for i in (0, 1) for j in (0, 1))
    known = F.coalesce(*(at_edge(i, j) for i in (0, 1) for j in (0, 1))).isNotNull()
    return squares.select("img", F.col("ty").alias("y"), F.col("tx").alias("x"), F.when(known, F.round(F.round(a + b + c + d, 6))).cast("int").alias("v"))


def coverage(pixels: DataFrame, foreground: Column) -> DataFrame:
    """(img, percent) of pixels in the foreground."""
    return pixels.groupBy("img").agg((F.avg(F.when(foreground, 1.0).otherwise(0.0)) * 100).alias("percent"))


def scan_stats(pixels: DataFrame, label_px: DataFrame) -> DataFrame:
    """(img, n, least, most, mean, objects) of the images and their labels, as read."""
    seen = pixels.groupBy("img").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"))
    return seen.join(label_px.groupBy("img").agg(F.count_distinct("label").alias("objects")), "img", "left").na.fill(0, ["objects"])
