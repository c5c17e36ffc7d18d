"""After segmentation: parting objects at edges, and splitting large ones at their waists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.post import line_runs, numbered, pixel_components, written


def beside(name: str, step: int, other: Column, window) -> Column:
    """The value of a column one place on along a window; `other` beyond the edge."""
    return F.coalesce(F.lead(name).over(window) if step > 0 else F.lag(name).over(window), other)


def gradients(pixels: DataFrame) -> DataFrame:
    """(img, y, x, gx, gy, size, thin): 3 x 3 derivatives with edges repeated, |gx| + |gy|, and whether that is a ridge along the gradient.

    Both derivatives are products of a difference and a smoothing along one axis each, so rows and then columns are windows.
    """
    across, down = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    v, lo, hi = F.col("v"), beside("v", -1, F.col("v"), across), beside("v", 1, F.col("v"), across)
    out = pixels.select("img", "y", "x", (hi - lo).alias("d"), (lo + 2 * v + hi).alias("s"))
    gx = beside("d", -1, F.col("d"), down) + 2 * F.col("d") + beside("d", 1, F.col("d"), down)
    gy = beside("s", 1, F.col("s"), down) - beside("s", -1, F.col("s"), down)
    out = out.select("img", "y", "x", gx.alias("gx"), gy.alias("gy")).withColumn("size", F.abs("gx") + F.abs("gy"))
    none = F.lit(0)
    out = out.withColumn("left", beside("size", -1, none, across)).withColumn("right", beside("size", 1, none, across))
    near = {(dy, name): beside(name, dy, none, down) for dy in (-1, 1) for name in ("left", "size", "right")}
    flat = F.abs("gy") < F.abs("gx") * F.lit(math.tan(math.pi / 8))
    steep = F.abs("gy") > F.abs("gx") * F.lit(math.tan(3 * math.pi / 8))
    falling = F.col("gx") * F.col("gy") >= 0
    a = F.when(flat, F.col("left")).when(steep, near[-1, "size"]).when(falling, near[-1, "left"]).otherwise(near[-1, "right"])
    b = F.when(flat, F.col("right")).when(steep, near[1, "size"]).when(falling, near[1, "right"]).otherwise(near[1, "left"])
    thin = (F.col("size") > a) & F.when(flat | steep, F.col("size") >= b).otherwise(F.col("size") > b)
    return out.select("img", "y", "x", "gx", "gy", "size", thin.alias("thin"))


def edges(pixels: DataFrame, width: int, low: int = 50, high: int = 150) -> DataFrame:
    """(img, y, x) of edge pixels: ridges above `low` that are joined to one above `high`. width: of the widest image."""
    ridge = written(gradients(pixels).where(F.col("thin") & (F.col("size") > low)).select("img", "y", "x", "size"))
    parts = pixel_components(ridge.select("img", "y", "x"), width).join(ridge, ["img", "y", "x"])
    strong = parts.where(F.col("size") > high).select("img", "component").distinct()
    return parts.join(strong, ["img", "component"], "left_semi").select("img", "y", "x")


def parted_at_edges(pixels: DataFrame, label_px: DataFrame, width: int, low: int = 50, high: int = 150) -> DataFrame:
    """label_px anew: what the edges, a pixel wider on every side, leave of the foreground, a label for each piece that hangs together."""
    around = F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    wide = edges(pixels, width, low, high).select("img", F.explode(around).alias("p")).select("img", "p.y", "p.x").distinct()
    left = pixel_components(label_px.select("img", "y", "x").join(wide, ["img", "y", "x"], "left_anti"), width)
    names = numbered(left.select("img", "component").distinct(), "label", "component")
    return left.join(names, ["img", "component"]).select("img", "y", "x", "label")


def envelope(f: list[int]) -> list[int]:
    """min over k of f[k] + (i - k)^2 for each i: the lower envelope of the parabolas, each added once and dropped once."""
    at: list[int] = []  # the parabolas of the envelope, and the first place where each is the least
    low: list[int] = []
    for k in range(len(f)):
        first = 0
        while at:
            first = (f[k] + k * k - f[at[-1]] - at[-1] ** 2) // (2 * (k - at[-1])) + 1
            if first > low[-1]:
                break
            at.pop()
            low.pop()
        if not at or first < len(f):
            at.append(k)
            low.append(first if low else 0)
    out, j = [], 0
    for i in range(len(f)):
        while j + 1 < len(at) and low[j + 1] <= i:
            j += 1
        out.append(f[at[j]] + (i - at[j]) ** 2)
    return out


def depths(label_px: DataFrame) -> DataFrame:
    """(img, label, y, x, depth): the squared distance of each pixel to the nearest one that is not of its object; beyond the frame all is outside.

    Columns first: the distance to the end of the pixel's run. Then lines: nothing beyond the ends of a run is nearer than its ends are, so each run is an
    envelope of its own. A line is the most that a task holds at once.
    """
    upright = line_runs(label_px, "y", "x").select("img", "label", "x", "a", "b", F.explode(F.sequence("a", "b")).alias("y"))
    tall = upright.select("img", "label", "y", "x", F.least(F.col("y") - F.col("a") + 1, F.col("b") - F.col("y") + 1).cast("long").alias("d"))
    line = Window.partitionBy("img", "label", "y").orderBy("x")
    flat = tall.withColumn("island", F.col("x") - F.row_number().over(line)).groupBy("img", "label", "y", "island").agg(F.array_sort(F.collect_list(F.struct("x", "d"))).alias("run"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [envelope([0, *(d * d for d in row), 0])[1:-1] for row in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, pa.list_(pa.int64()))], names=["img", "label", "y", "x", "depth"])

    lines = flat.select("img", "label", "y", F.col("run")[0]["x"].alias("x"), F.col("run")["d"].alias("d"))
    every = lines.mapInArrow(run, "img string, label long, y int, x int, depth array<long>").select("img", "label", "y", "x", F.posexplode("depth").alias("k", "depth"))
    return every.select("img", "label", "y", (F.col("x") + F.col("k")).alias("x"), "depth")


def climbed(deep: DataFrame, reach: int) -> DataFrame:
    """(img, label, y, x, top): where each pixel comes to when it goes to the deepest place up to `reach` lines and columns away, of equal ones the first by y, x, and on from there until it stays.

    The steps of all pixels are doubled in each round, so rounds grow with the logarithm of the longest way.
    """
    own = F.struct("depth", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))
    wide = deep.select("img", "label", "y", own.alias("best"), F.explode(F.sequence(F.col("x") - reach, F.col("x") + reach)).alias("x"))
    wide = wide.groupBy("img", "label", "y", "x").agg(F.max("best").alias("best"))
    near = F.max("best").over(Window.partitionBy("img", "label", "x").orderBy("y").rangeBetween(-reach, reach))
    aim = wide.select("img", "label", "y", "x", near.alias("best"))
    place = lambda y, x: F.shiftleft(y.cast("long"), 32) + x
    ways = written(aim.join(deep.select("img", "label", "y", "x"), ["img", "label", "y", "x"]).select("img", "label", place(F.col("y"), F.col("x")).alias("at"), place(-F.col("best.y"), -F.col("best.x")).alias("top")))
    while True:
        on = ways.select("img", "label", F.col("at").alias("top"), F.col("top").alias("next"))
        ways = written(ways.join(on, ["img", "label", "top"]).select("img", "label", "at", F.col("next").alias("top"), (F.col("next") != F.col("top")).alias("moved")))
        if not ways.where("moved").head(1):
            return ways.select("img", "label", F.shiftright("at", 32).cast("int").alias("y"), F.col("at").bitwiseAND((1 << 32) - 1).cast("int").alias("x"), "top")
        ways = ways.drop("moved")


def split_at_waists(label_px: DataFrame, min_area: int = 1000, footprint: int = 3) -> DataFrame:
    """label_px with objects of more than min_area pixels split: pixels that climb to the same deepest place are one part. Labels are new, from 1, in the order of the old ones and then of those places.

    Depths are exact, places are compared as (depth, first by y, x), and no step depends on another's turn, so an object is split in as many tasks as its lines ask for.
    """
    label_px = written(label_px.select("img", "y", "x", "label"))
    large = label_px.groupBy("img", "label").agg(F.count("*").alias("area")).where(F.col("area") > min_area).select("img", "label")
    parts = climbed(depths(label_px.join(large, ["img", "label"], "left_semi")), footprint // 2).select("img", "label", "y", "x", F.col("top").alias("part"))
    every = label_px.join(large, ["img", "label"], "left_anti").select("img", "label", "y", "x", F.lit(0).cast("long").alias("part")).unionByName(parts)
    names = numbered(every.select("img", "label", "part").distinct(), "new", "label", "part")
    return every.join(names, ["img", "label", "part"]).select("img", "y", "x", F.col("new").alias("label"))
