"""Folders of tile masks as a data source: a table of labels to read and to write.

Reading. A folder has a file for each tile, or a folder `img=<name>` for each image. Of the places where tiles may be (the folder itself, `tile_masks`
and `tile_masks_npz` in it, then its sibling with or without `_npz`, with `_tif`, `_masks`, `_segmentation`) the first that has any is read.
A name is two numbers joined by "_" or a space, or rowR_colC. Numbers with a space are pixel origins; rowR_colC are indexes; numbers with "_"
are what `origins` says: "pixels", "index", or "auto": pixels if one is more than twice the number of tiles that the image has along its side
(where the image's size isn't given: pixels, as this sink names them). Of two files of one tile the later kind counts: .npz, then .npy and
TIFF, with "_" before a space. A file of another kind is ignored; a folder without tiles is an error.

Filters on img, row and col leave out whole files before any is opened. Files are dealt to partitions of about `partition_bytes`.

Writing. `write` lays out the grid's tiles, empty ones too, one file each, and the sink keeps a manifest of them (see store.py) with the number
of objects in each; a folder with a manifest is read by it.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from tessella.model import TileSpec
from tessella.sources import tiff
from tessella.sources.store import Store, VersionedWriter, manifest, runs

NAME = re.compile(r"(?:(\d+)([_ ])(\d+)|row(\d+)_col(\d+))\.(npz|npy|tiff?)", re.IGNORECASE)
SCHEMA = "img string, row int, col int, y int, x int, label long"
WRITTEN = "img string, row int, col int, h int, w int, y int, x int, label long"
PARTITION = 16 << 20

TESTS = {
    EqualTo: lambda v, x: v == x,
    EqualNullSafe: lambda v, x: v == x,
    In: lambda v, x: v in x,
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
    IsNotNull: lambda v, x: True,
}


def test_of(f: Filter):
    """(column, whether a value passes) of a filter on one column that compares it with a constant; None for others."""
    if type(f) not in TESTS or len(f.attribute) != 1:
        return None
    value = getattr(f, "value", None)
    return None if value is None and not isinstance(f, IsNotNull) else (f.attribute[0], lambda v, test=TESTS[type(f)], x=value: test(v, x))


def places(path: str) -> list[str]:
    """Where a folder's tiles may be, relative to the folder, in the order of trying."""
    base = posixpath.basename(path.rstrip("/"))
    out = ["", "tile_masks", "tile_masks_npz"]
    if base:
        plain = base.replace("_npz", "").replace("_tif", "")
        out += [f"../{base.removesuffix('_npz') if base.endswith('_npz') else base + '_npz'}", *(f"../{plain}{end}" for end in ("_tif", "_masks", "_segmentation"))]
    return out


def tiles_in(files: Iterable[fs.FileInfo], spec: TileSpec, size: tuple[int, int] | None, origins: str) -> dict[tuple[int, int], fs.FileInfo]:
    """(row, col) -> file of the tiles among some files."""
    found = [(m, f) for f in files if f.type == fs.FileType.File and (m := NAME.fullmatch(f.base_name))]
    kind = lambda m: (m[2] == " ", m[6].lower() != "npz")
    joined = [(int(m[1]), int(m[3])) for m, _ in found if m[2] == "_"]
    if origins == "auto":
        many = [-(-n // stride) for n, stride in zip(size, (spec.stride_y, spec.stride_x), strict=True)] if size else None
        origins = "pixels" if not many or any(a > 2 * many[0] or b > 2 * many[1] for a, b in joined) else "index"
    out = {}
    for m, f in sorted(found, key=lambda x: (kind(x[0]), x[1].path)):
        if m[4]:
            at = int(m[4]), int(m[5])
        else:
            a, b = int(m[1]), int(m[3])
            at = (a // spec.stride_y, b // spec.stride_x) if m[2] == " " or origins == "pixels" else (a, b)
        out[at] = f
    return out


def mask_of(name: str, data: bytes) -> np.ndarray:
    """A 2-D mask: of an .npz file the array `arr_0`, else `mask`, else the first."""
    if name.lower().endswith(".npz"):
        with np.load(io.BytesIO(data)) as z:
            return z[next((k for k in ("arr_0", "mask") if k in z.files), z.files[0])]
    return np.load(io.BytesIO(data)) if name.lower().endswith(".npy") else tiff.read(data)


class Files(InputPartition):
    """Tiles (img, row, col, file, kind) of one partition."""


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = test_of(f)
            if test and test[0] in ("img", "row", "col"):
                self.tests.append(test)
            else:
                yield f

    def passes(self, **values) -> bool:
        return all(test(values[name]) for name, test in self.tests if name in values)

    def found(self) -> Iterator[tuple[str, int, int, str, int]]:
        """(img, row, col, file, bytes) of all tiles that pass, by the manifest or else by names."""
        o, store = self.options, Store(self.options["path"])
        held = manifest(store)
        if held is not None:
            yield from ((r["img"], r["row"], r["col"], r["file"], r["bytes"]) for r in held.to_pylist())
            return
        spec = TileSpec(int(o["tile_height"]), int(o["tile_width"]), int(o.get("overlap", 0)))
        size = (int(o["height"]), int(o["width"])) if "height" in o else None
        images = [(f.base_name[4:], f.base_name) for f in store.listed() if f.type == fs.FileType.Directory and f.base_name.startswith("img=")]
        for img, folder in images or [(o.get("img", posixpath.basename(store.root)), "")]:
            if not self.passes(img=img):
                continue
            for place in places(store.at(folder)):
                at = posixpath.normpath(posixpath.join(folder, place))
                if tiles := tiles_in(store.listed("" if at == "." else at), spec, size, o.get("origins", "auto")):
                    yield from ((img, row, col, posixpath.relpath(f.path, store.root), f.size) for (row, col), f in sorted(tiles.items()))
                    break
            else:
                raise FileNotFoundError(f"no tiles in {store.at(folder)} nor in {', '.join(places(store.at(folder))[1:])}")

    def partitions(self) -> list[InputPartition]:
        most, parts, held = int(self.options.get("partition_bytes", PARTITION)), [[]], 0
        for img, row, col, file, size in self.found():
            if self.passes(img=img, row=row, col=col):
                if parts[-1] and held + size > most:
                    parts.append([])
                    held = 0
                parts[-1].append((img, row, col, file))
                held += size
        return [Files(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store = Store(self.options["path"])
        for img, row, col, file in partition.value if partition else ():  # None: nothing passed the filters
            try:
                mask = mask_of(file, store.bytes_of(file))
            except (ValueError, OSError, KeyError, IndexError, zipfile.BadZipFile) as e:
                raise ValueError(f"{file} is no mask: {e}") from e
            y, x = np.nonzero(mask)
            n = len(y)
            yield pa.RecordBatch.from_arrays([pa.array([img] * n, pa.string()), pa.array(np.full(n, row, np.int32)), pa.array(np.full(n, col, np.int32)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(mask[y, x].astype(np.int64))], names=["img", "row", "col", "y", "x", "label"])


class TileWriter(VersionedWriter):
    """Rows of a tile come together; a row with a null label stands for a tile without objects."""

    key = ("img", "row", "col")
    schema = pa.schema([("img", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("file", pa.string()), ("bytes", pa.int64()), ("objects", pa.int64())])

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.strides = tuple(int(options[f"tile_{side}"]) - int(options.get("overlap", 0)) for side in ("height", "width"))

    def files_of(self, iterator, store: Store, folder: str):
        for (img, row, col, h, w), t in runs(iterator, ("img", "row", "col", "h", "w")):
            t = t.filter(t["label"].is_valid())
            mask = np.zeros((h, w), np.uint32)
            mask[t["y"].to_numpy(), t["x"].to_numpy()] = t["label"].to_numpy()
            out = io.BytesIO()
            np.savez_compressed(out, mask=mask)
            name = f"{folder}/img={img}/{row * self.strides[0]}_{col * self.strides[1]}.npz"
            store.write(name, out.getvalue())
            yield {"img": img, "row": row, "col": col, "file": name, "bytes": out.tell(), "objects": len(np.unique(mask[mask > 0]))}


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessella_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return TileReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TileWriter:
        return TileWriter(dict(self.options), overwrite)


def _options(path: str, spec: TileSpec, **more) -> dict[str, str]:
    return {"path": path, "tile_height": str(spec.height), "tile_width": str(spec.width), "overlap": str(spec.overlap)} | {k: str(v) for k, v in more.items() if v is not None}


def read(spark: SparkSession, path: str, spec: TileSpec, size: tuple[int, int] | None = None, origins: str = "auto", img: str | None = None, partition_bytes: int = PARTITION) -> DataFrame:
    """tile_label (img, row, col, y, x, label) of a folder. size: height and width of its images; img: the name of the only one."""
    spark.dataSource.register(TileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    sized = dict(zip(("height", "width"), size, strict=True)) if size else {}
    return spark.read.format("tessella_tiles").options(**_options(path, spec, origins=origins, img=img, partition_bytes=partition_bytes, **sized)).load()


def write(tile_labels: DataFrame, tiles: DataFrame, path: str, spec: TileSpec, mode: str = "overwrite") -> None:
    """Every tile of the grid as a file; with mode "append" tiles are added to those there, or take their place. A task has whole tiles."""
    spark = tile_labels.sparkSession
    spark.dataSource.register(TileSource)
    sized = tiles.select("img", "row", "col", (F.col("y1") - F.col("y0")).alias("h"), (F.col("x1") - F.col("x0")).alias("w"))
    rows = sized.join(tile_labels.select("img", "row", "col", "y", "x", "label"), ["img", "row", "col"], "left")
    rows = rows.repartition("img", "row", "col").sortWithinPartitions("img", "row", "col").selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in WRITTEN.split(", ")))
    rows.write.format("tessella_tiles").options(**_options(path, spec)).mode(mode).save()


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The manifest in force of a written folder: (img, row, col, file, bytes, objects)."""
    store = Store(path)
    if not store.exists("_current"):
        raise FileNotFoundError(f"{path} was not written by a sink of this library")
    return spark.read.parquet(f"{path.rstrip('/')}/{store.bytes_of('_current').decode()}")
