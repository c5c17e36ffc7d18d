"""Settings of a run: an INI file read into typed values, with defaults, and the same as JSON beside the results."""

from __future__ import annotations

import configparser
import json
import os
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from tessella.model import Thresholds, TileSpec, resolve_overlap


@dataclass(frozen=True)
class Settings:
    tile: int = 400
    overlap: float = 0.2
    low_percentile: float = 0.005
    high_percentile: float = 0.995
    gamma: bool = False
    equalise: bool = False
    clip: float = 2.0
    upscale: float = 1.0
    crop: tuple[float, float, float, float] | None = None
    block: int = 5
    bright: int = 128
    tiling: bool = True
    edges: bool = False
    edge_low: int = 50
    edge_high: int = 150
    split: bool = False
    split_area: int = 1000
    footprint: int = 3
    geometry: bool = True
    batch: int = 8
    seconds: float = 0.0
    keep_going: bool = False
    window: int = 8192
    window_overlap: float = 0.05
    crop_size: int = 1024
    debug: bool = False
    alpha: float = 0.5
    thresholds: Thresholds = field(default_factory=Thresholds)

    def spec(self) -> TileSpec:
        return TileSpec(self.tile, self.tile, resolve_overlap(self.tile, self.overlap))


def resolve(path: str, data_folder: str = ".") -> str:
    """A local path as settings may give it: a drive letter (C: to F:) means /mnt/<letter> here; a relative path is taken from the data folder if it is there. Addresses of other stores stay as they are."""
    path = path.strip()
    if "://" in path:
        return path
    if os.name == "posix" and path[:3] in ("C:/", "D:/", "E:/", "F:/"):
        path = f"/mnt/{path[0].lower()}{path[2:]}".replace("\\", "/")
    at = Path(path)
    if not at.is_absolute() and (Path(data_folder) / at).exists():
        return str(Path(data_folder) / at)
    return str(at if at.is_absolute() and at.exists() else at.resolve())


def numbers(text: str, default: tuple | None = None) -> tuple | None:
    """Numbers separated by commas; the default where there are none."""
    try:
        return tuple(float(x) for x in text.split(","))
    except ValueError:
        return default


def typed(section: configparser.SectionProxy, record: type) -> dict:
    """The section's values for the record's fields, by the type of each default; unknown names are an error."""
    known = {f.name: f for f in fields(record)}
    if unknown := set(section) - set(known) - {"thresholds"}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    out = {}
    for name in section:
        default = known[name].default
        if isinstance(default, bool):
            out[name] = section.getboolean(name)
        elif isinstance(default, int):
            out[name] = section.getint(name) if section[name].lstrip("-").isdigit() else section.getfloat(name)
        elif name == "crop":
            out[name] = numbers(section[name])
        else:
            out[name] = section.getfloat(name)
    return out


def load(path: str) -> Settings:
    """Sections [run] and [thresholds] of an INI file; what is missing keeps its default."""
    parser = configparser.ConfigParser(inline_comment_prefixes=("#", ";"))
    if not parser.read(path, encoding="utf-8"):
        raise FileNotFoundError(path)
    run = typed(parser["run"], Settings) if parser.has_section("run") else {}
    limits = Thresholds(**typed(parser["thresholds"], Thresholds)) if parser.has_section("thresholds") else Thresholds()
    limits.validate()
    return Settings(**run, thresholds=limits)


def snapshot(settings: Settings, path: str) -> None:
    Path(path).write_text(json.dumps(asdict(settings), indent=2, default=str), encoding="utf-8")
