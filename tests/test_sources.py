"""Folders of tile masks and large images as data sources, and versioned sinks."""

import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.model import TileSpec
from tessella.operators import tiling
from tessella.sources import slides, tiff, tiles
from tessella.sources.store import Store, vacuum

SPEC = TileSpec(10, 12, 2)


def masks(seed=1):
    """(row, col) -> mask of an image of 30 x 35."""
    rng = np.random.default_rng(seed)
    out = {}
    for r, y in enumerate(range(0, 30, 8)):
        for c, x in enumerate(range(0, 35, 10)):
            out[r, c] = (rng.integers(0, 6, (min(10, 30 - y), min(12, 35 - x))) * (rng.random() < 0.8)).astype(np.uint32)
    return out


def cells(found, img="i"):
    return {(img, r, c, int(y), int(x), int(m[y, x])) for (r, c), m in found.items() for y, x in zip(*np.nonzero(m), strict=True)}


def put(folder, name, mask):
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / name, "wb") as f:
        if name.endswith(".npz"):
            np.savez_compressed(f, mask=mask)
        else:
            f.write(tiff.encode(mask, 3))


def got(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("name", ["{y}_{x}.npz", "{y} {x}.tif", "{r}_{c}.npz", "row{r}_col{c}.tif"])
@pytest.mark.parametrize("place", ["", "tile_masks", "tile_masks_npz", "../i_npz", "../i_masks"])
def test_names_and_places(tmp_path, name, place):
    """The files that the reader finds, on the driver alone."""
    found = masks()
    (tmp_path / "i").mkdir()
    for (r, c), m in found.items():
        put(tmp_path / "i" / place, name.format(r=r, c=c, y=8 * r, x=10 * c), m)
    put(tmp_path / "i", "notes 3.npz", np.ones((2, 2)))
    reader = tiles.TileReader({"path": str(tmp_path / "i"), "tile_height": "10", "tile_width": "12", "overlap": "2", "height": "30", "width": "35", "img": "i"})
    assert [x[:3] for x in reader.found()] == [("i", r, c) for r, c in sorted(found)]
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert {tuple(r.values()) for b in rows for r in b.to_pylist()} == cells(found)


def test_tile_rules(tmp_path):
    spec, one = TileSpec(10, 12, 2), np.ones((2, 2))
    for name in ("0_0.npz", "8_0.npz", "8_0.tif", "8 0.npz", "readme.txt"):
        put(tmp_path, name, one) if name[-3:] != "txt" else (tmp_path / name).write_text("x")
    listed = Store(str(tmp_path)).listed()
    at = {k: os.path.basename(f.path) for k, f in tiles.tiles_in(listed, spec, (30, 35), "auto").items()}
    assert at == {(0, 0): "0_0.npz", (8, 0): "8_0.tif", (1, 0): "8 0.npz"}  # 8 is no more than twice 4 tiles
    at = {k: os.path.basename(f.path) for k, f in tiles.tiles_in(listed, spec, (20, 20), "pixels").items()}
    assert at == {(0, 0): "0_0.npz", (1, 0): "8 0.npz"}
    assert set(tiles.tiles_in(listed, spec, None, "auto")) == {(0, 0), (1, 0)}
    with pytest.raises(FileNotFoundError):
        list(tiles.TileReader({"path": str(tmp_path / "none"), "tile_height": "10", "tile_width": "12"}).found())
    for key in ("arr_0", "mask", "other"):
        out = io.BytesIO()
        np.savez(out, **({"z": np.zeros((2, 2))} if key != "other" else {}), **{key: one * 7})
        assert tiles.mask_of("1_1.npz", out.getvalue()).max() == 7


def test_filters_open_only_the_files_they_need(spark, tmp_path):
    found = masks()
    for (r, c), m in found.items():
        put(tmp_path / "img=i", f"{8 * r}_{10 * c}.npz", m)
    df = tiles.read(spark, str(tmp_path), SPEC, partition_bytes=1)
    assert df.rdd.getNumPartitions() == len(found)
    assert got(df) == cells(found)
    for r, c in found:
        if (r, c) != (2, 1):
            (tmp_path / "img=i" / f"{8 * r}_{10 * c}.npz").write_bytes(b"not a mask")
    want = {x for x in cells(found) if x[1:3] == (2, 1)}
    for where in ("row = 2 and col = 1", "row in (2, 9) and col > 0 and col < 2", "img = 'i' and row >= 2 and row <= 2 and col = 1 and label > 0"):
        part = df.where(where)
        assert part.rdd.getNumPartitions() == 1 and got(part) == want
    assert df.where("img = 'j'").count() == 0
    with pytest.raises(Exception, match="is no mask"):
        df.where("row = 2").count()


def grid(spark):
    return tiling.grid(spark.createDataFrame([("i", 30, 35)], "img string, h int, w int"), SPEC)


def table(spark, found):
    return spark.createDataFrame(sorted(cells(found)), tiles.SCHEMA)


def test_tile_sink(spark, tmp_path):
    path, first = f"file://{tmp_path}/out", masks(1)
    tiles.write(table(spark, first), grid(spark), path, SPEC)
    assert got(tiles.read(spark, path, SPEC)) == cells(first)
    listed = {(r.row, r.col): r for r in tiles.listed(spark, path).collect()}
    assert {k: r.objects for k, r in listed.items()} == {k: len(np.unique(m[m > 0])) for k, m in first.items()}  # empty tiles too
    assert all(os.path.basename(r.file) == f"{8 * r.row}_{10 * r.col}.npz" for r in listed.values())

    # a write that fails in the middle leaves the table as it was, and nothing of it is read
    broken = table(spark, masks(2)).withColumn("label", F.when((F.col("row") == 3) & (F.col("col") == 3), F.raise_error("lost").cast("long")).otherwise(F.col("label")))
    with pytest.raises(Exception, match="lost"):
        tiles.write(broken.repartition(4), grid(spark), path, SPEC)
    assert got(tiles.read(spark, path, SPEC)) == cells(first)

    # some tiles anew: the others stay
    second = {k: m for k, m in masks(3).items() if k[0] == 1}
    tiles.write(table(spark, second), grid(spark).where("row = 1"), path, SPEC, mode="append")
    assert got(tiles.read(spark, path, SPEC)) == cells(first | second)
    assert vacuum(path) > 0 and vacuum(path) == 0
    assert got(tiles.read(spark, path, SPEC)) == cells(first | second)
    tiles.write(table(spark, second), grid(spark).where("row = 1"), path, SPEC)
    assert got(tiles.read(spark, path, SPEC)) == cells(second)


def picture(shape, dtype):
    return np.random.default_rng(5).integers(0, 250, shape).astype(dtype)


def test_tiff_files():
    for shape in ((1, 1), (37, 23), (64, 5), (7, 9, 3)):
        for dtype in ("uint8", "uint16", "int32", "float32"):
            for deflate in (True, False):
                a = picture(shape, dtype)
                data = tiff.encode(a, 8, deflate)
                assert (tiff.read(data) == a).all()
                assert len(tiff.tiff_index(lambda s, n, d=data: d[s : s + n]).blocks) == -(-shape[0] // 8)
    with pytest.raises(ValueError):
        tiff.read(b"II*\x00")
    with pytest.raises(ValueError):
        tiff.read(b"GIF89a")


def tiled_tiff(a, side, big):
    """A big-endian TIFF in tiles, with the horizontal predictor."""
    import struct
    import zlib

    h, w = a.shape
    blocks = []
    for y in range(0, h, side):
        for x in range(0, w, side):
            t = np.zeros((side, side), ">u2")
            part = a[y : y + side, x : x + side]
            t[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(np.diff(t, axis=1, prepend=np.zeros((side, 1), ">u2")).astype(">u2").tobytes()))
    word, head = ("Q", 16) if big else ("I", 8)
    starts = np.cumsum([head, *map(len, blocks)])[:-1].tolist()
    at = head + sum(map(len, blocks))
    room = struct.calcsize(word)
    fields = [(256, [w]), (257, [h]), (258, [16]), (259, [8]), (277, [1]), (317, [2]), (322, [side]), (323, [side]), (324, starts), (325, list(map(len, blocks)))]
    after = at + (8 if big else 2) + (4 + 2 * room) * len(fields) + room
    out, beyond = struct.pack(">Q" if big else ">H", len(fields)), b""
    for tag, values in fields:
        data = struct.pack(f">{len(values)}I", *values)
        out += struct.pack(f">HH{word}", tag, 4, len(values))
        if len(data) > room:
            out += struct.pack(f">{word}", after + len(beyond))
            beyond += data
        else:
            out += data.ljust(room, b"\0")
    out += struct.pack(f">{word}", 0)
    start = struct.pack(">2sHHHQ", b"MM", 43, 8, 0, at) if big else struct.pack(">2sHI", b"MM", 42, at)
    return start + b"".join(blocks) + out + beyond


@pytest.mark.parametrize("big", [False, True])
def test_tiled_files(big):
    a = picture((37, 50), "uint16")
    data = tiled_tiff(a, 16, big)
    assert (tiff.read(data) == a).all() and len(tiff.tiff_index(lambda s, n: data[s : s + n]).blocks) == 12


def as_array(df, shape):
    out = np.full(shape, -1)
    for r in df.collect():
        assert out[r.y, r.x] == -1
        out[r.y, r.x] = r.v
    return out


def test_one_slide_is_many_partitions(spark, tmp_path):
    a = picture((640, 30), "uint16")
    (tmp_path / "s.tif").write_bytes(tiff.encode(a, 10, deflate=False))
    np.save(tmp_path / "t.npy", a)
    df = slides.read(spark, str(tmp_path / "s.tif"), partition_bytes=1)
    assert df.rdd.getNumPartitions() == 64
    assert (as_array(df, a.shape) == a).all()
    assert df.where("y >= 95 and y < 110").rdd.getNumPartitions() == 2 and df.where("y >= 95 and y < 110").count() == 15 * 30
    assert df.where("y = 639 and x = 3").collect()[0].v == a[639, 3] and df.where("y > 700").count() == 0
    every = slides.read(spark, str(tmp_path))
    assert every.groupBy("img").count().collect() and every.where("img = 't'").agg(F.sum("v")).first()[0] == a.sum()
    assert (as_array(slides.read(spark, str(tmp_path / "t.npy"), img="u").where("img = 'u'"), a.shape) == a).all()


def inverted(data, index, block):
    return 255 - np.frombuffer(data, np.uint8)


def test_rgb_and_decoders(spark, tmp_path):
    a = picture((12, 8, 3), "uint8")
    (tmp_path / "c.tif").write_bytes(tiff.encode(a, 5))
    rows = slides.read(spark, str(tmp_path / "c.tif"), rgb=True).collect()
    assert {(r.y, r.x): (r.r, r.g, r.b) for r in rows} == {(y, x): tuple(map(int, a[y, x])) for y in range(12) for x in range(8)}
    with pytest.raises(Exception, match="ask for rgb"):
        slides.read(spark, str(tmp_path / "c.tif")).count()
    b = picture((9, 4), "uint8")
    data = tiff.encode(b, 4, deflate=False).replace(b"\x03\x01\x04\x00\x01\x00\x00\x00\x01", b"\x03\x01\x04\x00\x01\x00\x00\x00\x07")  # a compression that is not known
    with pytest.raises(ValueError, match="needs a decoder"):
        tiff.read(data)
    (tmp_path / "d.tif").write_bytes(data)
    assert (tiff.read(data, inverted) == 255 - b).all()
    got = slides.SlideReader({"path": str(tmp_path / "d.tif"), "decoder": f"{__name__}:inverted"})
    assert sum(batch.num_rows for p in got.partitions() for batch in got.read(p)) == 36


def test_slide_sink(spark, tmp_path):
    a = picture((50, 20), "uint16")
    y, x = np.indices(a.shape)
    px = spark.createDataFrame([("i", int(p), int(q), int(v)) for p, q, v in zip(y.ravel(), x.ravel(), a.ravel(), strict=True)], "img string, y int, x int, v int")
    path = f"file://{tmp_path}/out"
    slides.write(px, tiling.extents(px), path, band=16, lines=4)
    back = slides.read(spark, path, partition_bytes=1)
    assert (as_array(back, a.shape) == a).all() and back.where("y between 17 and 18").rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="don't fit"):
        slides.write(px.withColumn("v", F.col("v") + 70000), tiling.extents(px), path)
    assert (as_array(slides.read(spark, path), a.shape) == a).all()
