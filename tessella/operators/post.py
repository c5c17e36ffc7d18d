"""Connected components of pixels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK, SQUARE = 256, 16  # pixels on a side of a block that is joined at once; blocks on a side of a square of them


def scratch(spark: SparkSession) -> str:
    """A new place in the folder that spark.checkpoint.dir names. Only where everything is one process may none be set, as in tests."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to a scratch place and read again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def line_runs(px: DataFrame, along: str = "x", across: str = "y") -> DataFrame:
    """(img, label, across, a, b): the unbroken runs of an object's pixels along one axis, from a to b. One shuffle, by line, so a large object is many tasks."""
    line = Window.partitionBy("img", "label", across).orderBy(along)
    island = px.select("img", "label", across, F.col(along).alias("at"), (F.col(along) - F.row_number().over(line)).alias("island"))
    return island.groupBy("img", "label", across, "island").agg(F.min("at").alias("a"), F.max("at").alias("b")).drop("island")


def numbered(names: DataFrame, name: str, by: str, *then: str) -> DataFrame:
    """names (img, by, ...) with a number from 1 for each row of an image, in the order of a whole number `by` and then of other columns.

    Rows are numbered in ranges of `by` and the ranges' sizes are added up, so that an image with many rows makes many tasks.
    """
    ranged = names.withColumn("range", F.shiftright(F.col(by).cast("long"), 16))
    sizes = ranged.groupBy("img", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("img").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("img", "range", F.coalesce(before, F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("img", "range").orderBy(by, *then))
    return ranged.withColumn("place", place).join(offsets, ["img", "range"]).withColumn(name, (F.col("place") + F.col("offset")).cast("long")).drop("range", "place", "offset")


def joined(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """The least name that each name of the pairs is joined to."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def block_pixels(y: np.ndarray, x: np.ndarray, width: int) -> np.ndarray:
    """The least y * width + x that each pixel of one block, in order of y, x, is joined to within the block."""
    place = y.astype(np.int64) * width + x
    new = np.ones(len(y), bool)
    new[1:] = (y[1:] != y[:-1]) | (x[1:] - x[:-1] > 1)
    at, line = place[new], y[new].astype(np.int64)
    a, b = x[new].astype(np.int64), x[np.append(np.flatnonzero(new)[1:], len(x)) - 1].astype(np.int64)
    # the runs of the line above that touch a run are those from the first that ends, to the last that begins, near enough
    reach = 2 * width + 4
    first = np.searchsorted(line * reach + b + 1, (line - 1) * reach + a, "left")
    last = np.searchsorted(line * reach + a, (line - 1) * reach + b + 1, "right")
    n = np.maximum(last - first, 0)
    own = np.repeat(np.arange(len(at)), n)
    above = np.repeat(first, n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    found = joined(zip(at[own].tolist(), at[above].tolist(), strict=True))
    return np.array([found.get(p, p) for p in at.tolist()], np.int64)[np.cumsum(new) - 1]


def starred(links: DataFrame) -> DataFrame:
    """(img, a, b) of links (img, a, b): each name that is not the least of those it is joined to, with that one.

    Each round hangs every neighbour on the least one (large star), then every smaller neighbour (small star), so that rounds grow with the logarithm of the longest path.
    """
    edges, seen = written(links.select("img", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()), None
    while True:
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("img", "a", "b").cast("decimal(38,0)"))).first()
        if sign == seen or not sign[0]:
            return edges
        seen = sign
        both = edges.unionByName(edges.select("img", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("img", "a").agg(F.min("b").alias("m")).select("img", "a", F.least("a", "m").alias("m"))
        large = written(both.where("b > a").join(least, ["img", "a"]).select("img", F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("img", "a").agg(F.min("b").alias("m"))
        edges = written(large.join(least, ["img", "a"]).select("img", F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def pixel_components(foreground: DataFrame, width: int) -> DataFrame:
    """(img, y, x, component) of foreground pixels (img, y, x) joined at sides or corners; component is the least y * width + x. width: of the widest image, or more.

    Pixels are joined within blocks of BLOCK x BLOCK, blocks where they touch within squares of blocks, and what crosses those by stars; so rounds
    don't grow with the length of a component, and only pixels at the sides of blocks are joined as a table.
    """
    from tessella.sources.store import runs

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (img, _, _), t in runs(batches, ("img", "by", "bx")):
            y, x = t["y"].to_numpy(), t["x"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([img] * len(y), pa.string()), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(block_pixels(y, x, width))], names=["img", "y", "x", "root"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (img, _, _), t in runs(batches, ("img", "by", "bx")):
            found = joined(zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([img] * len(found), pa.string()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["img", "a", "b"])

    def dealt(df: DataFrame, size: int, *then: str) -> DataFrame:
        keyed = df.withColumn("by", F.floor(F.col("y") / size).cast("int")).withColumn("bx", F.floor(F.col("x") / size).cast("int"))
        return keyed.repartition("img", "by", "bx").sortWithinPartitions("img", "by", "bx", *then)

    px = foreground.select("img", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    local = written(dealt(px, BLOCK, "y", "x").mapInArrow(within, "img string, y int, x int, root long"))
    after, before = (F.pmod(F.col("y"), F.lit(BLOCK)), F.pmod(F.col("x"), F.lit(BLOCK))), F.lit(BLOCK - 1)
    near = lambda *places: F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in places))
    none = F.filter(near((0, 0)), lambda p: F.lit(False))
    beyond = F.concat(F.when(after[0] == 0, near((-1, -1), (-1, 0), (-1, 1))).otherwise(none), F.when(after[1] == 0, near((-1, -1), (0, -1), (1, -1))).otherwise(none))
    asked = local.where((after[0] == 0) | (after[1] == 0)).select("img", F.col("root").alias("a"), F.explode(beyond).alias("p")).select("img", "a", "p.y", "p.x")
    sides = local.where((after[0] == before) | (after[1] == before) | (after[0] == 0) | (after[1] == 0)).select("img", "y", "x", F.col("root").alias("b"))
    links = asked.join(sides, ["img", "y", "x"]).where("a <> b").groupBy("img", "a", "b").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    stars = starred(dealt(links, BLOCK * SQUARE).select("img", "by", "bx", "a", "b").mapInArrow(between, "img string, a long, b long")).select("img", F.col("a").alias("root"), F.col("b").alias("least"))
    return local.join(stars, ["img", "root"], "left").select("img", "y", "x", F.coalesce("least", "root").alias("component"))
