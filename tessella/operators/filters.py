"""Keeping objects by their metrics, renumbering them, and the figures about it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.model import Thresholds
from tessella.operators.post import numbered


def flagged(metrics: DataFrame, thresholds: Thresholds) -> DataFrame:
    """metrics with `passed`."""
    thresholds.validate()
    return metrics.withColumn("passed", thresholds.predicate(metrics.columns))


def renumbered(flagged: DataFrame) -> DataFrame:
    """(img, old, new): the survivors' labels and new ones from 1, in their order."""
    return numbered(flagged.where("passed").select("img", F.col("label").alias("old")), "new", "old")


def relabelled(label_px: DataFrame, renumbered: DataFrame) -> DataFrame:
    """label_px of the survivors, under their new labels."""
    return label_px.join(renumbered.withColumnRenamed("old", "label"), ["img", "label"]).select("img", "y", "x", F.col("new").alias("label"))


def retention(flagged: DataFrame, extent: DataFrame | None = None) -> DataFrame:
    """(img, original, passed, failed, retention); with the images' extents, images without objects have a row of zeros."""
    out = flagged.groupBy("img").agg(F.count("*").alias("original"), F.count_if("passed").alias("passed"))
    if extent is not None:
        out = extent.select("img").join(out, "img", "left").na.fill(0)
    return out.select("img", "original", "passed", (F.col("original") - F.col("passed")).alias("failed"), F.coalesce(F.col("passed") / F.nullif("original", F.lit(0)), F.lit(0.0)).alias("retention"))


def outside(metrics: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(img, metric, excluded): how many objects are outside each metric's bounds, for plots."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.when(F.col(m).between(lo, hi), 0).otherwise(1).alias("out")) for m, (lo, hi) in bounds.items()))
    return metrics.select("img", F.explode(pairs).alias("p")).groupBy("img", "p.metric").agg(F.sum("p.out").alias("excluded"))


def merge_statistics(label_px: DataFrame, extent: DataFrame, tiles: DataFrame) -> DataFrame:
    """(img, objects, object_pixels, coverage, per_mm2, mean_size, per_tile): one pixel is a micrometre; null where there is nothing to divide by."""
    sizes = label_px.groupBy("img").agg(F.count_distinct("label").alias("objects"), F.count("*").alias("object_pixels"))
    n_tiles = tiles.groupBy("img").agg(F.count("*").alias("tiles"))
    out = extent.join(sizes, "img", "left").join(n_tiles, "img", "left").na.fill(0, ["objects", "object_pixels"])
    whole = F.nullif(F.col("h").cast("long") * F.col("w"), F.lit(0))
    return out.select("img", "objects", "object_pixels", (100 * F.col("object_pixels") / whole).alias("coverage"), (F.col("objects") * 1e6 / whole).alias("per_mm2"), (F.col("object_pixels") / F.nullif("objects", F.lit(0))).alias("mean_size"), (F.col("objects") / F.nullif("tiles", F.lit(0))).alias("per_tile"))


def segmentation_summary(tile_labels: DataFrame, tiles: DataFrame, extent: DataFrame) -> DataFrame:
    """(img, tiles, objects, per_tile, per_mm2): what the segmentation found before any merge; one pixel is a micrometre. Objects are counted tile by tile, so no image is one task."""
    each = tile_labels.groupBy("img", "row", "col").agg(F.count_distinct("label").alias("n"))
    found = tiles.select("img", "row", "col").join(each, ["img", "row", "col"], "left").groupBy("img").agg(F.count("*").alias("tiles"), F.coalesce(F.sum("n"), F.lit(0)).alias("objects"))
    out = extent.join(found, "img", "left").na.fill(0, ["tiles", "objects"])
    return out.select("img", "tiles", "objects", (F.col("objects") / F.nullif("tiles", F.lit(0))).alias("per_tile"), (F.col("objects") * 1e6 / F.nullif(F.col("h").cast("long") * F.col("w"), F.lit(0))).alias("per_mm2"))


def label_counts_match(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tiles (img, row, col, n_before, n_after) whose number of labels differs between two tables of tile labels; none is right."""
    count = lambda df, name: df.groupBy("img", "row", "col").agg(F.count_distinct("label").alias(name))
    both = count(before, "n_before").join(count(after, "n_after"), ["img", "row", "col"], "full").na.fill(0)
    return both.where("n_before <> n_after")


def merge_efficiency(before: DataFrame, after: DataFrame, extent: DataFrame | None = None) -> DataFrame:
    """(img, objects_in, objects_out, percent): what the merge left of the tiles' objects; 0 where there were none. before: tile_label, after: label_px. With the images' extents, each has a row."""
    given = before.groupBy("img").agg(F.count_distinct("row", "col", "label").alias("objects_in"))
    left = after.groupBy("img").agg(F.count_distinct("label").alias("objects_out"))
    both = given.join(left, "img", "full")
    if extent is not None:
        both = extent.select("img").join(both, "img", "left")
    both = both.na.fill(0)
    return both.select("*", F.when(F.col("objects_in") > 0, 100 * F.col("objects_out") / F.col("objects_in")).otherwise(0.0).alias("percent"))


def diameter_summary(sizes: DataFrame) -> DataFrame:
    """(img, mean, least, most, cv): the diameters of circles of the objects' areas; cv in percent. sizes: (img, label, area)."""
    across = sizes.select("img", (2 * F.sqrt(F.col("area") / F.lit(math.pi))).alias("d"))
    return across.groupBy("img").agg(F.avg("d").alias("mean"), F.min("d").alias("least"), F.max("d").alias("most"), (100 * F.stddev_pop("d") / F.avg("d")).alias("cv"))
