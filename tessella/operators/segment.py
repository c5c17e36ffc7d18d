"""Segmentation of tiles: a protocol for models, tiles in batches, and segmenters that need no model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.post import written
from tessella.sources.store import runs


class Segmenter(Protocol):
    """A model that labels the objects of one tile."""

    def segment(self, tile: np.ndarray) -> np.ndarray:
        """Labels of a 2-D tile, 0 for background."""


def segment(tiled: DataFrame, model: Segmenter) -> DataFrame:
    """tile_label by a model, a tile a group. An error of the model fails the task. tiled: pixels with row, col, ty, tx."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tile = np.zeros((rows["ty"].max() + 1, rows["tx"].max() + 1), rows["v"].dtype)
        tile[rows["ty"], rows["tx"]] = rows["v"]
        labels = np.asarray(model.segment(tile), np.int64)
        y, x = np.nonzero(labels)
        return pd.DataFrame({"img": rows["img"].iloc[0], "row": rows["row"].iloc[0], "col": rows["col"].iloc[0], "y": y.astype(np.int32), "x": x.astype(np.int32), "label": labels[y, x]})

    return tiled.groupBy("img", "row", "col").applyInPandas(run, "img string, row int, col int, y int, x int, label long")


def model_arguments(settings: dict, resample_is_default: bool = True) -> dict:
    """What a run's settings give a model of the usual kind as keywords: sizes and thresholds as they are set, one plane at a time, without test-time copies.

    resample_is_default: for models whose `resample` is on unless told otherwise, it is named only when it is on.
    """
    out = {name: settings[name] for name in ("diameter", "flow_threshold", "cellprob_threshold", "batch_size")}
    resample = bool(settings.get("resample", True))
    return out | {"augment": False, "do_3D": False} | ({"resample": resample} if resample or not resample_is_default else {})


_model: dict = {}


def loaded(load: Callable[[], Segmenter]) -> Segmenter:
    """load(), once a Python worker, as long as it is the same function (or an equal record)."""
    if load not in _model:
        _model.clear()
        _model[load] = load()
    return _model[load]


def answers(model: Segmenter, tiles: list[np.ndarray], seconds: float | None) -> Iterator[np.ndarray | Exception]:
    """The labels of each tile of a batch, or what went wrong. The whole batch at once, where the model can; tile by tile, where it can't or where that failed.

    seconds: no tile is begun later than that after the batch.
    """
    end = time.monotonic() + seconds if seconds is not None else float("inf")
    if hasattr(model, "segment_batch"):
        try:
            found = list(model.segment_batch(tiles))
            if len(found) == len(tiles):
                yield from found
                return
        except Exception:  # one of them may be the reason: each is asked for on its own
            pass
    for tile in tiles:
        try:
            if time.monotonic() >= end:
                raise TimeoutError(f"its batch took more than {seconds} seconds")
            yield model.segment(tile)
        except Exception as e:
            yield e


def segment_batches(tiled: DataFrame, load: Callable[[], Segmenter], size: int = 8, seconds: float | None = None, keep_going: bool = False, profile: ResourceProfile | None = None) -> tuple[DataFrame, DataFrame]:
    """tile_label, and the tiles that failed (img, row, col, error), by a model that every Python worker loads once and that gets `size` tiles at a time.

    load: a function of a module, or a record with values and a call, so that a worker knows it again. A tile that fails fails the job, or with keep_going is a
    row of the second table and has no labels. profile: what executors of this stage need, such as a GPU. A task holds one batch of tiles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, every = loaded(load), runs(batches, ("img", "row", "col"))
        while group := list(islice(every, size)):
            tiles = []
            for _, t in group:
                y, x, v = (t[c].to_numpy() for c in ("ty", "tx", "v"))
                tile = np.zeros((y.max() + 1, x.max() + 1), v.dtype)
                tile[y, x] = v
                tiles.append(tile)
            for (key, _), tile, found in zip(group, tiles, answers(model, tiles, seconds), strict=True):
                if not isinstance(found, Exception) and np.shape(found) != tile.shape:
                    found = ValueError(f"labels of shape {np.shape(found)} for a tile of {tile.shape}")
                if isinstance(found, Exception):
                    if not keep_going:
                        raise RuntimeError(f"tile {key} failed") from found
                    yield out(key, [None], [None], [None], f"{type(found).__name__}: {found}")
                    continue
                labels = np.asarray(found, np.int64)
                y, x = np.nonzero(labels)
                yield out(key, y, x, labels[y, x], None)

    def out(key: tuple, y, x, label, error: str | None) -> pa.RecordBatch:
        n = len(y)
        return pa.RecordBatch.from_arrays([pa.array([k] * n, t) for k, t in zip(key, (pa.string(), pa.int32(), pa.int32()), strict=True)] + [pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(label, pa.int64()), pa.array([error] * n, pa.string())], names=["img", "row", "col", "y", "x", "label", "error"])

    rows = tiled.select("img", "row", "col", "ty", "tx", "v").repartition("img", "row", "col").sortWithinPartitions("img", "row", "col")
    both = written(rows.mapInArrow(run, "img string, row int, col int, y int, x int, label long, error string", profile=profile))
    return both.where("error is null").drop("error"), both.where("error is not null").select("img", "row", "col", "error")


def block_labels(tiled: DataFrame, block: int, threshold: int, columns: int = 1000) -> DataFrame:
    """tile_label without a model: the bright pixels of each block x block square of a tile are one object. Neighbouring tiles cut squares differently, as a model would."""
    label = F.floor(F.col("ty") / block) * columns + F.floor(F.col("tx") / block) + 1
    return tiled.where(F.col("v") > threshold).select("img", "row", "col", F.col("ty").alias("y"), F.col("tx").alias("x"), label.cast("long").alias("label"))
