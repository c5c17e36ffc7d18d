"""Command line: run all stages, filter a finished label map again, or draw overlays. Inputs and results are Parquet tables.

    python -m tessella.cli run PIXELS FOLDER [--settings FILE] [--resume]
    python -m tessella.cli filter LABELS PIXELS FOLDER [--min-pixels 20 ... one option for each threshold] [--intensity PIXELS] [--region X0,X1,Y0,Y1] [--overlay] [--summary]
    python -m tessella.cli overlay PIXELS LABELS OUT [--alpha 0.5] [--tile 1024]
    python -m tessella.cli qc PIXELS TILE_LABELS LABELS FOLDER [--settings FILE] [--alpha 0.6]
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.model import Thresholds
from tessella.operators import filters, merge, preprocess, render, tiling
from tessella.plans import filtering, settings, staged
from tessella.sources.rasters import write_metrics, write_table


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessella")
    commands = out.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("pixels")
    run.add_argument("folder")
    run.add_argument("--settings")
    run.add_argument("--resume", action="store_true")
    again = commands.add_parser("filter")
    again.add_argument("labels")
    again.add_argument("pixels")
    again.add_argument("folder")
    for f in fields(Thresholds):
        name = "--" + f.name.replace("_", "-")
        if f.name == "exclude_border":
            again.add_argument(name, action="store_true")
        else:
            again.add_argument(name, type=float, default=f.default)
    again.add_argument("--intensity")
    again.add_argument("--region", type=settings.numbers)
    again.add_argument("--overlay", action="store_true")
    again.add_argument("--summary", action="store_true")
    overlay = commands.add_parser("overlay")
    for name in ("pixels", "labels", "out"):
        overlay.add_argument(name)
    overlay.add_argument("--alpha", type=float, default=0.5)
    overlay.add_argument("--tile", type=int, default=1024)
    qc = commands.add_parser("qc")
    for name in ("pixels", "tile_labels", "labels", "folder"):
        qc.add_argument(name)
    qc.add_argument("--settings")
    qc.add_argument("--alpha", type=float, default=0.6)
    return out


def filter_again(spark: SparkSession, given: argparse.Namespace) -> None:
    """Metrics, flags and the filtered map; on request the verdict overlay and a summary of what each bound excludes."""
    pixels, label_px = spark.read.parquet(given.pixels), spark.read.parquet(given.labels)
    if given.region:
        x0, x1, y0, y1 = given.region
        inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
        label_px = label_px.where(inside)
    limits = Thresholds(**{f.name: getattr(given, f.name) for f in fields(Thresholds)})
    bright = spark.read.parquet(given.intensity) if given.intensity else pixels
    done = filtering.filter_masks(label_px, tiling.extents(pixels), limits, given.folder, bright, debug=True)
    flagged = done.metrics
    if given.overlay:
        write_table(render.verdict_overlay(preprocess.to_8bit(pixels), label_px, flagged), f"{given.folder}/overlay")
    if given.summary:
        bounds = {("area" if n == "pixels" else n): (getattr(limits, f"min_{n}"), getattr(limits, f"max_{n}")) for n in ("pixels", "circularity", "solidity", "eccentricity", "aspect_ratio", "hole_fraction")}
        write_metrics(filters.outside(flagged, bounds), f"{given.folder}/summary_csv")
    done.stats.show(truncate=False)


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    if given.command == "filter":
        filter_again(spark, given)
        return
    pixels = spark.read.parquet(given.pixels)
    chosen = settings.load(given.settings) if getattr(given, "settings", None) else settings.Settings()
    if given.command == "run":
        staged.run(pixels, chosen, given.folder, resume=given.resume)
        return
    label_px, eight = tiling.within(spark.read.parquet(given.labels), tiling.extents(pixels)), preprocess.to_8bit(pixels)
    if given.command == "overlay":
        write_table(render.blend(eight, label_px, given.alpha, given.tile), given.out)
        return
    spec = chosen.spec()
    before = merge.combine_raw_candidates(spark.read.parquet(given.tile_labels), spec)
    write_table(render.tile_overlay(eight, before, tiling.grid(tiling.extents(pixels), spec), given.alpha), f"{given.folder}/before")
    write_table(render.object_overlay(eight, label_px, given.alpha), f"{given.folder}/after")


if __name__ == "__main__":
    main()
