"""Filtering a label map by settings, as one call."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

from tessella.model import Thresholds
from tessella.operators import filters, metrics, tiling
from tessella.sources.rasters import write_metrics, write_table

#: The bounds of a run whose settings name none.
USUAL = {
    "min_pixels": 20,
    "max_pixels": 3000,
    "min_circularity": 0.4,
    "max_circularity": 1.0,
    "min_solidity": 0.6,
    "max_solidity": 1.0,
    "min_eccentricity": 0.0,
    "max_eccentricity": 0.99,
    "min_aspect_ratio": 0.5,
    "max_aspect_ratio": 4.0,
    "min_hole_fraction": 0.0,
    "max_hole_fraction": 0.05,
    "exclude_border": False,
}


@dataclass(frozen=True)
class Filtered:
    """label_px under new labels, the metrics of all objects with `passed`, and a row of figures for each image."""

    labels: DataFrame
    metrics: DataFrame
    stats: DataFrame


def limits_of(settings: Mapping) -> Thresholds:
    """Bounds from settings; names that are no bounds are left to others."""
    names = {f.name for f in fields(Thresholds)}
    return Thresholds(**USUAL | {k: v for k, v in settings.items() if k in names})


def filter_masks(label_px: DataFrame, extent: DataFrame, settings: Mapping | Thresholds, folder: str | None = None, intensity: DataFrame | None = None, debug: bool = False) -> Filtered:
    """Objects within the bounds, renumbered from 1. With a folder the tables are written there and read back, the metrics as CSV too if debug is on.

    An image without objects has a row of zeros; labels outside their image, and bounds that don't ascend, are errors.
    """
    limits = settings if isinstance(settings, Thresholds) else limits_of(settings)
    limits.validate()

    def kept(df: DataFrame, name: str) -> DataFrame:
        return write_table(df, f"{folder.rstrip('/')}/{name}") if folder else df

    flagged = kept(filters.flagged(metrics.measure(tiling.within(label_px, extent), extent, intensity), limits), "metrics")
    labels = kept(filters.relabelled(label_px, filters.renumbered(flagged)), "filtered")
    stats = kept(filters.retention(flagged, extent), "filter_stats")
    if folder and debug:
        write_metrics(flagged, f"{folder.rstrip('/')}/metrics_csv")
    return Filtered(labels, flagged, stats)
