"""Schemas and the small parameter records of the raster operators.

Relations: pixel (img, y, x, v), grid (img, row, col, y0, y1, x0, x1; half-open), tile_label (img, row, col, y, x, label; y and x within
the tile, no background), label_px (img, y, x, label; no background) and metrics (img, label, ...). `img` names the image everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from math import inf

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TileSpec:
    """Tiles of height x width pixels that overlap their neighbours."""

    height: int
    width: int
    overlap: int = 0

    def __post_init__(self):
        if self.overlap < 0 or self.overlap >= min(self.height, self.width):
            raise ValueError("the overlap must be at least 0 and smaller than the tile")

    @property
    def stride_y(self) -> int:
        return self.height - self.overlap

    @property
    def stride_x(self) -> int:
        return self.width - self.overlap


def resolve_overlap(tile: int, value: float) -> int:
    """An overlap in pixels: values in [0, 1] are a share of the tile; at most half a tile."""
    return min(int(tile * value) if 0 <= value <= 1 else int(value), tile // 2)


@dataclass(frozen=True)
class Thresholds:
    """Inclusive bounds of object metrics; an object without a value for a bounded metric is dropped."""

    min_pixels: float = 0
    max_pixels: float = 1e9
    min_circularity: float = 0.0
    max_circularity: float = 1.0
    min_solidity: float = 0.0
    max_solidity: float = 1.0
    min_eccentricity: float = 0.0
    max_eccentricity: float = 1.0
    min_aspect_ratio: float = 0.0
    max_aspect_ratio: float = inf
    min_hole_fraction: float = 0.0
    max_hole_fraction: float = 1.0
    min_mean_intensity: float | None = None
    max_mean_intensity: float | None = None
    exclude_border: bool = False

    def validate(self) -> None:
        """Raises ValueError unless 0 <= lower bound <= upper bound, and shares are at most 1."""
        for name, top in (("pixels", inf), ("circularity", 1), ("solidity", 1), ("eccentricity", 1), ("hole_fraction", 1)):
            if not 0 <= getattr(self, f"min_{name}") <= getattr(self, f"max_{name}") <= top:
                raise ValueError(f"the bounds of {name} must ascend within 0 and {top}")

    def predicate(self, columns: list[str]) -> Column:
        """One predicate for all bounds; a metric that the table doesn't have may only have its default bounds."""
        keep = F.lit(True)
        names = {f.name[4:] for f in fields(self) if f.name.startswith("min_")}
        for name in sorted(names):
            low, high = getattr(self, f"min_{name}"), getattr(self, f"max_{name}")
            column = "area" if name == "pixels" else name
            if column not in columns and (low, high) != (DEFAULTS[f"min_{name}"], DEFAULTS[f"max_{name}"]):
                raise ValueError(f"the table has no {column} to be bounded")
            if column in columns and not (low is None and high is None):
                keep = keep & F.col(column).between(-inf if low is None else low, inf if high is None else high)
        if self.exclude_border:
            keep = keep & ~F.col("border_touch")
        return F.coalesce(keep, F.lit(False))


DEFAULTS = {f.name: f.default for f in fields(Thresholds)}
