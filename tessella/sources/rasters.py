"""Rasters from tables, files and stacks, and their sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PIXEL = "img string, y int, x int, v int"


def raster_from_events(events: DataFrame) -> DataFrame:
    """Pixels of images of 1000 x 100, one value of an event each, in hundredths."""
    return events.where("value is not null and event_id is not null").selectExpr("concat('e', event_id div 100000) as img", "cast(event_id % 100000 div 100 as int) as y", "cast(event_id % 100 as int) as x", "cast(floor(value * 100) as int) as v")


def raster_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """Pixels of an image with a row for each vector and a column for each dimension."""
    cells = embeddings.select(F.lit("v").alias("img"), F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return cells.select("img", "y", "x", F.floor((F.col("e").cast("double") + 0.6) * 50000).cast("int").alias("v"))


def read_images(spark: SparkSession, path: str, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """Pixels of the image files under path; decode turns a file's bytes into a 2-D array and runs in the tasks that read them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                a = decode(data)
                y, x = np.indices(a.shape, np.int32)
                yield pd.DataFrame({"img": name, "y": y.ravel(), "x": x.ravel(), "v": a.ravel().astype(np.int32)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PIXEL)


def pack_stack(stack: DataFrame) -> DataFrame:
    """label_px of a boolean stack (img, slice, y, x, on): slice k is label k + 1, and a later slice covers an earlier one."""
    return stack.where("on").groupBy("img", "y", "x").agg((F.max("slice") + 1).cast("bigint").alias("label"))


def unpack_stack(label_px: DataFrame, passed: DataFrame) -> DataFrame:
    """The true cells (img, slice, y, x) of a stack with one slice for each passed label (img, old, new)."""
    return label_px.join(passed.withColumnRenamed("old", "label"), ["img", "label"]).select("img", (F.col("new") - 1).alias("slice"), "y", "x")


#: Names of tile files: two numbers joined by "_" or a space, or rowR_colC.
TILE_NAME = r"(?:^|/)(?:row)?(\d+)[_ ](?:col)?(\d+)\.(?:npz|tiff?|parquet)$"


def tile_of_name(path: Column) -> Column:
    """The two numbers of a tile file's name as a struct (a, b); null where it isn't one."""
    a, b = (F.regexp_extract(path, TILE_NAME, k) for k in (1, 2))
    return F.when(a != "", F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes a stage's table and reads it back, so that later stages start from files."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_observed(df: DataFrame, path: str, **figures: Column) -> tuple[DataFrame, dict]:
    """write_table, and figures of what was written (its rows, and named aggregates), observed on the way: the table is not read for them."""
    seen = Observation()
    out = write_table(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in figures.items())), path)
    return out, seen.get


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("header", True).csv(path)
