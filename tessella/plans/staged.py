"""The whole run as stages, each a Parquet table under one folder; a stage whose table is there is taken up again when asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.model import TileSpec
from tessella.operators import filters, merge, metrics, preprocess, refine, render, segment, tiling
from tessella.plans.settings import Settings
from tessella.sources import slides
from tessella.sources.rasters import write_observed, write_table
from tessella.sources.store import CURRENT, Store


def present(spark: SparkSession, path: str) -> bool:
    """Whether a stage's table was finished, in whatever store the folder is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def prepare(pixels: DataFrame, settings: Settings) -> DataFrame:
    """Crop, 8-bit stretch, then gamma (in windows with an overlap of their own), local equalisation and resizing where they are on."""
    out = tiling.crop(pixels, settings.crop) if settings.crop else pixels
    out = preprocess.to_8bit(out, settings.low_percentile, settings.high_percentile)
    if settings.gamma:
        out = preprocess.merge_tiles_last(preprocess.gamma_correct(tiling.windows(out, settings.window, int(settings.window * settings.window_overlap))))
    if settings.equalise:
        out = preprocess.equalise(out, settings.clip)
    return preprocess.upscale(out, settings.upscale) if settings.upscale > 1 else out


#: Aggregates that are observed while a stage is written, beside its rows.
OBSERVED = {
    "prepared": {"least": "min(v)", "most": "max(v)", "mean": "avg(v)"},
    "metrics": {"pixels": "sum(area)", "kept_pixels": "sum(if(passed, area, 0))", "passed": "count_if(passed)"},
}


def checked(seen: dict[str, dict]) -> None:
    """Raises RuntimeError where the figures of the stages don't fit together, as when a stage was written from other tables than those there now. Stages without figures are taken as they are."""
    rows = lambda name: seen.get(name, {}).get("rows")
    of = lambda name, figure: seen.get(name, {}).get(figure)
    pairs = {
        "measured objects have the labels' pixels": (rows("refined") if "refined" in seen else rows("merged"), of("metrics", "pixels") or (0 if rows("metrics") == 0 else None)),
        "the filtered map has the pixels of the objects that passed": (rows("filtered"), of("metrics", "kept_pixels") or (0 if rows("metrics") == 0 else None)),
        "the overlay has the image's pixels": (rows("overlay"), rows("prepared")),
        "the overlay before the merge has the image's pixels": (rows("before"), rows("prepared")),
    }
    if wrong := {what: both for what, both in pairs.items() if None not in both and both[0] != both[1]}:
        raise RuntimeError(f"stages don't fit together: {wrong}")


def refined(prepared: DataFrame, label_px: DataFrame, settings: Settings) -> DataFrame:
    """Labels parted at edges and split at waists, where these are on."""
    if settings.edges:
        width = tiling.extents(prepared).agg({"w": "max"}).first()[0] or 1
        label_px = refine.parted_at_edges(prepared, label_px, width, settings.edge_low, settings.edge_high)
    return refine.split_at_waists(label_px, settings.split_area, settings.footprint) if settings.split else label_px


def run(pixels: DataFrame, settings: Settings, folder: str, model: segment.Segmenter | None = None, resume: bool = False, load: Callable[[], segment.Segmenter] | None = None) -> dict[str, DataFrame]:
    """The stages' tables: prepared, tile_labels, raw, merged, refined, metrics, filtered, stats, summary, before, overlay, crop_preview; the binary mask, as TIFF bands; and figures observed while they were written, which must fit together. Without a model, blocks are labelled.

    load: a function that loads a model, which then gets tiles in batches, once a Python worker; tiles that fail are in the table `failed`, if the settings let the run go on.

    An image that fits into one tile is one tile; with tiling off every image is.
    """
    spark, spec, done, seen = pixels.sparkSession, settings.spec(), {}, {}
    folder = folder.rstrip("/")

    def stage(name: str, make) -> DataFrame:
        path = f"{folder}/{name}"
        if resume and present(spark, path):
            done[name] = spark.read.parquet(path)
        else:
            done[name], seen[name] = write_observed(make(), path, **{k: F.expr(e) for k, e in OBSERVED.get(name, {}).items()})
        return done[name]

    prepared = stage("prepared", lambda: prepare(pixels, settings))
    extent = tiling.extents(prepared)
    if not settings.tiling:
        side = extent.selectExpr("max(greatest(h, w))").first()[0] or 1
        spec = TileSpec(side, side)
    tiles = tiling.grid(extent, spec)

    def label() -> DataFrame:
        tiled = tiling.assign(prepared, spec)
        if load:
            labels, failed = segment.segment_batches(tiled, load, settings.batch, settings.seconds or None, settings.keep_going)
            stage("failed", lambda: failed)
            return labels
        return segment.segment(tiled, model) if model else segment.block_labels(tiled, settings.block, settings.bright)

    tile_labels = stage("tile_labels", label)

    def merged() -> DataFrame:
        flags = merge.object_flags(tile_labels, tiles, spec)
        ids = merge.reassign_ids(flags.select("img", "row", "col", "label"), tiles)
        if settings.debug:  # what the merge decides on
            flags = stage("debug_flags", lambda: merge.object_flags(tile_labels, tiles, spec))
        left = merge.merge_two_phase(flags, tiles).select("img", "row", "col", "label")
        return merge.assemble(tile_labels, left.join(ids, ["img", "row", "col", "label"]), spec)

    stage("raw", lambda: merge.combine_raw(tile_labels, spec))
    whole = stage("merged", merged)
    label_px = tiling.within(stage("refined", lambda: refined(prepared, whole, settings)), extent) if settings.edges or settings.split else tiling.within(whole, extent)
    flagged = stage("metrics", lambda: filters.flagged(metrics.measure(label_px, extent, prepared, settings.geometry), settings.thresholds))
    kept = stage("filtered", lambda: filters.relabelled(label_px, filters.renumbered(flagged)))
    stage("stats", lambda: filters.retention(flagged, extent).join(filters.merge_statistics(kept, extent, tiles).withColumnRenamed("objects", "left"), "img").join(filters.merge_efficiency(tile_labels, whole, extent).select("img", F.col("percent").alias("merge_efficiency")), "img"))
    stage("summary", lambda: filters.segmentation_summary(tile_labels, tiles, extent))
    stage("before", lambda: render.tile_overlay(prepared, merge.combine_raw_candidates(tile_labels, spec), tiles))
    overlay = stage("overlay", lambda: render.blend(prepared, kept, settings.alpha))
    crop = render.best_crop(prepared, extent, settings.crop_size)
    stage("crop_preview", lambda: render.cut_out(overlay, crop))
    if not (resume and Store(f"{folder}/binary_mask").exists(CURRENT)):
        slides.write(render.binary(prepared, kept), extent, f"{folder}/binary_mask", dtype="uint8")
    done["binary_mask"] = slides.read(spark, f"{folder}/binary_mask")
    checked(seen)
    if seen:
        figures = [(name, k, float(v)) for name, found in seen.items() for k, v in found.items() if v is not None]
        done["figures"] = write_table(spark.createDataFrame(figures, "stage string, figure string, value double").coalesce(1), f"{folder}/figures")
    return done
