"""Large images as a data source: a file's head says where its blocks are, and partitions are ranges of blocks, so one slide is many tasks.

Reading. Files are .tif, .tiff and .npy (see tiff.py); .npz masks, which can't be cut, are one block each. The path is a file, or a folder of images; a
folder `img=<name>` is one image in bands, files whose names are two numbers joined by "_", the place of their first pixel. An image of one sample
has the columns img, y, x, v (whole numbers; floating ones are cut to them), and with `rgb` any image has img, y, x, r, g, b, one sample standing for all
three. Filters on img leave out files; those on y and x leave out blocks before their bytes are read. A block is emitted in parts of at most a million pixels.
Compressions that tiff.py doesn't know are decoded by the function that `decoder` names as "module:function"; it gets one block at a time.

Writing. `write` gives bands of some lines, a TIFF file each, to the sink (see store.py), so a large image is written by many tasks.
"""

from __future__ import annotations

import importlib
import posixpath
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tessella.sources import tiff
from tessella.sources.store import Store, VersionedWriter, manifest, runs
from tessella.sources.tiles import mask_of, test_of

KINDS = re.compile(r"\.(tiff?|npy|npz)$", re.IGNORECASE)
BAND = re.compile(r"(\d+)_(\d+)\.", re.IGNORECASE)
GRAY, RGB = "img string, y int, x int, v int", "img string, y int, x int, r int, g int, b int"
WRITTEN = "img string, band int, y0 int, h int, w int, y int, x int, v int"
PARTITION, ROWS = 32 << 20, 1 << 20


class Blocks(InputPartition):
    """(img, file, y, x of its first pixel, index, blocks) of one partition; index None: a file of one block."""


class SlideReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.tests: list[tuple] = []
        self.low, self.high = {"y": 0, "x": 0}, {"y": 1 << 31, "x": 1 << 31}  # places that pass; high is the first beyond

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = test_of(f)
            if test and test[0] == "img":
                self.tests.append(test)
                continue
            if test and test[0] in ("y", "x") and hasattr(f, "value"):
                values = f.value if isinstance(f, In) else [f.value]
                if isinstance(f, EqualTo | EqualNullSafe | In | GreaterThan | GreaterThanOrEqual):
                    self.low[test[0]] = max(self.low[test[0]], min(values, default=0) + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | EqualNullSafe | In | LessThan | LessThanOrEqual):
                    self.high[test[0]] = min(self.high[test[0]], max(values, default=-1) + (not isinstance(f, LessThan)))
            yield f  # blocks hold other pixels as well

    def files(self, store: Store) -> Iterator[tuple[str, str, int, int]]:
        """(img, file, y, x)."""
        held = manifest(store)
        if held is not None:
            yield from ((r["img"], r["file"], r["y0"], 0) for r in held.to_pylist())
            return
        if store.files.get_file_info(store.root).type == fs.FileType.File:
            yield self.options.get("img", posixpath.splitext(posixpath.basename(store.root))[0]), "", 0, 0
            return
        for f in store.listed():
            if f.type == fs.FileType.File and KINDS.search(f.base_name):
                yield posixpath.splitext(f.base_name)[0], f.base_name, 0, 0
            elif f.type == fs.FileType.Directory and f.base_name.startswith("img="):
                for b in store.listed(f.base_name):
                    if KINDS.search(b.base_name) and (m := BAND.match(b.base_name)):
                        yield f.base_name[4:], f"{f.base_name}/{b.base_name}", int(m[1]), int(m[2])

    def meets(self, y: int, x: int, h: int, w: int) -> bool:
        return y < self.high["y"] and y + h > self.low["y"] and x < self.high["x"] and x + w > self.low["x"]

    def partitions(self) -> list[InputPartition]:
        store, most = Store(self.options["path"]), int(self.options.get("partition_bytes", PARTITION))
        parts: list[list] = [[]]
        held = 0
        for img, file, y, x in self.files(store):
            if not all(test(img) for _, test in self.tests) or y >= self.high["y"] or x >= self.high["x"]:
                continue
            name = file or store.root
            if name.lower().endswith(".npz"):
                parts.append([(img, file, y, x, None, ())])
                continue
            at = tiff.index(name, lambda start, size, file=file: store.bytes_of(file, start, size))
            head = tiff.Index(at.height, at.width, at.samples, at.dtype, at.compression, at.predictor, ())
            run: list = []
            for b in at.blocks:
                if not self.meets(y + b.y0, x + b.x0, b.height, b.width):
                    continue
                if run and held + b.size > most:
                    parts[-1].append((img, file, y, x, head, tuple(run)))
                    parts.append([])
                    run, held = [], 0
                run.append(b)
                held += b.size
            if run:
                parts[-1].append((img, file, y, x, head, tuple(run)))
                if held >= most:
                    parts.append([])
                    held = 0
        return [Blocks(p) for p in parts if p]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, rgb = Store(self.options["path"]), self.options.get("rgb") == "true"
        decode = None
        if name := self.options.get("decoder"):
            module, _, function = name.partition(":")
            decode = getattr(importlib.import_module(module), function)
        for img, file, y, x, head, blocks in partition.value if partition else ():  # None: nothing passed the filters
            if head is None:
                a = mask_of(file or store.root, store.bytes_of(file))
                yield from rows_of(img, y, x, a if a.ndim == 3 else a[:, :, None], rgb)
            for b in blocks:
                yield from rows_of(img, y + b.y0, x + b.x0, head.array(b, store.bytes_of(file, b.start, b.size), decode), rgb)


def rows_of(img: str, y0: int, x0: int, a: np.ndarray, rgb: bool) -> Iterator[pa.RecordBatch]:
    """A row for each pixel of (lines, columns, samples)."""
    samples = a.shape[2]
    if not rgb and samples > 1 or rgb and samples not in (1, 3, 4):
        raise ValueError(f"{img} has {samples} samples a pixel; " + ("ask for rgb" if samples > 1 and not rgb else "one or three are needed"))
    step = max(1, ROWS // max(1, a.shape[1]))
    for k in range(0, a.shape[0], step):
        part = a[k : k + step]
        h, w = part.shape[:2]
        place = [pa.array([img] * (h * w), pa.string()), pa.array(np.repeat(np.arange(y0 + k, y0 + k + h, dtype=np.int32), w)), pa.array(np.tile(np.arange(x0, x0 + w, dtype=np.int32), h))]
        values = [pa.array(part[:, :, min(s, samples - 1)].astype(np.int32).ravel()) for s in (range(3) if rgb else (0,))]
        yield pa.RecordBatch.from_arrays([*place, *values], names=["img", "y", "x", *("rgb" if rgb else "v")])


class SlideWriter(VersionedWriter):
    key = ("img", "y0")
    schema = pa.schema([("img", pa.string()), ("y0", pa.int32()), ("file", pa.string()), ("bytes", pa.int64()), ("h", pa.int32()), ("w", pa.int32())])

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.kind, self.lines = np.dtype(options.get("dtype", "uint16")), int(options.get("lines", 64))

    def files_of(self, iterator, store: Store, folder: str):
        for (img, _, y0, h, w), t in runs(iterator, ("img", "band", "y0", "h", "w")):
            a, v = np.zeros((h, w), self.kind), t["v"].to_numpy()
            if len(v) and (v.min() < np.iinfo(self.kind).min or v.max() > np.iinfo(self.kind).max):
                raise ValueError(f"values of {img} from {v.min()} to {v.max()} don't fit {self.kind}")
            a[t["y"].to_numpy() - y0, t["x"].to_numpy()] = v
            data, name = tiff.encode(a, self.lines), f"{folder}/img={img}/{y0}_0.tif"
            store.write(name, data)
            yield {"img": img, "y0": y0, "file": name, "bytes": len(data), "h": h, "w": w}


class SlideSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessella_slides"

    def schema(self) -> str:
        return RGB if self.options.get("rgb") == "true" else GRAY

    def reader(self, schema) -> SlideReader:
        return SlideReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> SlideWriter:
        return SlideWriter(dict(self.options), overwrite)


def read(spark: SparkSession, path: str, rgb: bool = False, img: str | None = None, decoder: str | None = None, partition_bytes: int = PARTITION) -> DataFrame:
    """Pixels (img, y, x, v), or (img, y, x, r, g, b), of the images at a path."""
    spark.dataSource.register(SlideSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"path": path, "rgb": str(rgb).lower(), "img": img, "decoder": decoder, "partition_bytes": str(partition_bytes)}
    return spark.read.format("tessella_slides").options(**{k: v for k, v in options.items() if v is not None}).load()


def write(pixels: DataFrame, extent: DataFrame, path: str, band: int = 1024, lines: int = 64, dtype: str = "uint16", mode: str = "overwrite") -> None:
    """Images as bands of `band` lines, in strips of `lines`; pixels that the table doesn't have are 0. A value that dtype can't hold fails the write, which leaves the old images."""
    spark = pixels.sparkSession
    spark.dataSource.register(SlideSource)
    bands = extent.select("img", "h", "w", F.explode(F.sequence(F.lit(0), F.floor((F.col("h") - 1) / band).cast("int"))).alias("band"))
    bands = bands.select("img", "band", (F.col("band") * band).alias("y0"), F.least(F.lit(band), F.col("h") - F.col("band") * band).alias("h"), "w")
    rows = bands.join(pixels.select("img", F.floor(F.col("y") / band).cast("int").alias("band"), "y", "x", "v"), ["img", "band"])
    rows = rows.repartition("img", "band").sortWithinPartitions("img", "band").selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in WRITTEN.split(", ")))
    rows.write.format("tessella_slides").options(path=path, dtype=dtype, lines=str(lines)).mode(mode).save()
