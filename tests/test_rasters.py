"""Grids, thresholds, merges and measures on small images."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.model import Thresholds, TileSpec, resolve_overlap
from tessella.operators import filters, merge, metrics, post, preprocess, refine, render, segment, tiling
from tessella.sources import rasters

DEFAULT = dict(circularity=0.9, solidity=0.9, eccentricity=0.3, aspect_ratio=1.0, hole_fraction=0.0)


def image(spark, array, img="i"):
    y, x = np.indices(array.shape)
    return spark.createDataFrame(pd.DataFrame({"img": img, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "v": array.ravel().astype("int32")}))


def labels(spark, array, img="i"):
    y, x = np.nonzero(array)
    return spark.createDataFrame(pd.DataFrame({"img": img, "y": y.astype("int32"), "x": x.astype("int32"), "label": array[y, x].astype("int64")}), "img string, y int, x int, label long")


def extent(spark, h, w):
    return spark.createDataFrame([("i", h, w)], "img string, h int, w int")


@pytest.mark.parametrize("h,w,size,overlap", [(50, 50, 100, 10), (200, 200, 100, 0), (500, 400, 128, 20), (110, 110, 64, 0), (150, 200, 64, 10)])
def test_grid(spark, h, w, size, overlap):
    rows = tiling.grid(extent(spark, h, w), TileSpec(size, size, overlap)).collect()
    stride = size - overlap
    assert len(rows) == math.ceil(h / stride) * math.ceil(w / stride)
    seen = np.zeros((h, w), bool)
    for r in rows:
        assert r.y1 <= h and r.x1 <= w and r.y1 - r.y0 <= size
        seen[r.y0 : r.y1, r.x0 : r.x1] = True
    assert seen.all()


@pytest.mark.parametrize("width,sizes", [(400, [400, 80]), (700, [400, 380, 60]), (720, [400, 400, 80]), (1040, [400, 400, 400, 80])])
def test_sliver_tiles(spark, width, sizes):
    rows = tiling.grid(extent(spark, 10, width), TileSpec(400, 400, 80)).where("row = 0").orderBy("col").collect()
    assert [r.x1 - r.x0 for r in rows] == sizes


def test_overlap_rules():
    with pytest.raises(ValueError):
        TileSpec(64, 64, 64)
    assert (resolve_overlap(400, 0.2), resolve_overlap(400, 1), resolve_overlap(400, 30)) == (80, 200, 30)


def test_assign_equals_brute_force(spark):
    spec = TileSpec(7, 9, 3)
    got = tiling.assign(image(spark, np.zeros((20, 23))), spec).groupBy("row", "col").count().toPandas().set_index(["row", "col"])["count"].to_dict()
    for (r, c), n in got.items():
        assert n == (min(20, r * 4 + 7) - r * 4) * (min(23, c * 6 + 9) - c * 6)
    assert len(got) == 5 * 4


def test_feather(spark):
    px = image(spark, np.zeros((12, 13))).withColumnsRenamed({"y": "ty", "x": "tx"})
    w = px.select("ty", "tx", tiling.feather(12, 13, 4).alias("w")).toPandas().set_index(["ty", "tx"])["w"]
    up = [0, 0.25, 0.5, 0.75]
    down, across = np.array([*up, 1, 1, 1, 1, 1, 0.75, 0.5, 0.25]), np.array([*up, 1, 1, 1, 1, 1, 1, 0.75, 0.5, 0.25])
    assert np.allclose(w.to_numpy().reshape(12, 13), np.outer(down, across)[: 12, : 13])
    for overlap in (0, -5):
        assert px.select(tiling.feather(12, 12, overlap).alias("w")).distinct().collect()[0].w == 1
    narrow = px.select("ty", "tx", tiling.feather(12, 13, 40).alias("w")).toPandas()["w"]  # half a side at most
    assert narrow.between(0, 1).all() and narrow.max() == 1


def test_thresholds(spark):
    rows = [(1, 50, 0.9, 0.95, 0.3, 1.1, 0.01), (2, 10, 0.2, 0.5, 0.95, 6.0, 0.0), (3, 200, 0.7, 0.85, 0.5, 1.5, 0.03), (4, 5000, 0.5, 0.7, 0.1, 1.2, 0.2)]
    df = spark.createDataFrame(rows, "label long, area long, circularity double, solidity double, eccentricity double, aspect_ratio double, hole_fraction double")
    passed = lambda **k: {r.label for r in filters.flagged(df, Thresholds(**k)).where("passed").collect()}
    assert passed() == {1, 2, 3, 4}
    assert passed(min_pixels=20) == {1, 3, 4} and passed(max_pixels=3000) == {1, 2, 3}
    assert passed(min_circularity=0.4) == {1, 3, 4} and passed(max_aspect_ratio=4) == {1, 3, 4}
    assert passed(max_hole_fraction=0.05) == {1, 2, 3}
    for name in ("pixels", "circularity", "solidity", "eccentricity", "hole_fraction"):
        with pytest.raises(ValueError):
            Thresholds(**{f"min_{name}": 0.9, f"max_{name}": 0.1}).validate()
    for bad in (dict(min_pixels=500, max_pixels=100), dict(min_pixels=-1), dict(min_circularity=0.8, max_circularity=0.3), dict(min_solidity=1.1), dict(min_eccentricity=-0.1), dict(max_hole_fraction=1.5), dict(max_solidity=2)):
        with pytest.raises(ValueError):
            Thresholds(**bad).validate()
    with pytest.raises(ValueError):  # a bound for a metric that isn't there
        filters.flagged(df, Thresholds(min_mean_intensity=3))


def test_border_and_missing_values(spark):
    df = spark.createDataFrame([(1, 100, False, None), (2, 100, True, 1.0), (3, 100, False, 2.0)], "label long, area long, border_touch boolean, aspect_ratio double")
    assert {r.label for r in filters.flagged(df, Thresholds(exclude_border=True)).where("passed").collect()} == {3}


def test_square(spark):
    a = np.zeros((30, 30), int)
    a[5:15, 8:18] = 1
    r = metrics.measure(labels(spark, a), extent(spark, 30, 30), image(spark, a * 7)).first()
    assert (r.area, r.filled_area, r.solidity, r.hole_fraction, r.mean_intensity) == (100, 100, 1.0, 0.0, 7.0)
    assert abs(r.perimeter - 36) < 1e-9 and abs(r.circularity - 4 * math.pi * 100 / 36**2) < 1e-9
    assert (r.bbox_0, r.bbox_1, r.bbox_2, r.bbox_3, r.border_touch) == (5, 8, 15, 18, False)
    assert abs(r.major_axis_length - 4 * math.sqrt(99 / 12)) < 1e-9 and r.eccentricity == 0


def test_no_objects(spark):
    none = labels(spark, np.zeros((20, 20), int))
    assert metrics.measure(none, extent(spark, 20, 20)).count() == 0


def simulate(tiles, spec):
    """The merge over arrays of pixels, one tile after another."""
    strip = {"right": lambda a: a[:, max(0, a.shape[1] - 2) :], "left": lambda a: a[:, :2], "down": lambda a: a[max(0, a.shape[0] - 2) :], "up": lambda a: a[:2]}

    def cut(a, side, what):
        n, o = a.shape[1 if side in ("right", "left") else 0], spec.overlap
        line = n - o if side in ("right", "down") else o
        if not 0 <= line < n:
            lo = hi = 0
        elif what == "touch":
            lo, hi = max(0, line - 1), min(n, line + 2)
        elif side in ("right", "down"):
            lo, hi = line + 2, n
        else:
            lo, hi = 0, max(0, line - 2)
        return a[:, lo:hi] if side in ("right", "left") else a[lo:hi]

    ids = lambda a: set(np.unique(a)) - {0}

    def pair(a, b, near, far):
        across = near == "right"
        s = spec.stride_x if across else spec.stride_y
        if not ids(a[:, s:] if across else a[s:]) and not ids(b[:, : spec.overlap] if across else b[: spec.overlap]):
            return
        first = len(ids(a)) >= len(ids(b))
        top, side, low, other = (a, near, b, far) if first else (b, far, a, near)
        top[np.isin(top, list(ids(strip[side](top))))] = 0
        low[np.isin(low, list(ids(cut(low, other, "beyond")) - ids(cut(low, other, "touch"))))] = 0

    for step, near, far in (((0, 1), "right", "left"), ((1, 0), "down", "up")):
        for r, c in sorted(tiles):
            if (r + step[0], c + step[1]) in tiles:
                pair(tiles[r, c], tiles[r + step[0], c + step[1]], near, far)
    return {(r, c, int(k)) for (r, c), a in tiles.items() for k in np.unique(a) if k}


def test_merge_equals_pixel_simulation(spark):
    rng = random.Random(7)
    parts, want = [], set()
    for k in range(12):
        spec, h, w = TileSpec(8, 8, 3), rng.randrange(5, 22), rng.randrange(5, 22)
        tiles = {}
        for r, y0 in enumerate(range(0, h, 5)):
            for c, x0 in enumerate(range(0, w, 5)):
                a = np.zeros((min(8, h - y0), min(8, w - x0)), int)
                for label in range(1, rng.choice([1, 3, 7])):
                    y, x = rng.randrange(a.shape[0]), rng.randrange(a.shape[1])
                    part = a[y : y + rng.randrange(1, 4), x : x + rng.randrange(1, 4)]
                    part[part == 0] = label
                for y, x in zip(*np.nonzero(a), strict=True):
                    parts.append((f"i{k}", r, c, int(y), int(x), int(a[y, x])))
                tiles[r, c] = a
        parts.append((f"i{k}", -1, -1, h, w, 0))
        want |= {(f"i{k}", *t) for t in simulate(tiles, spec)}
    df = spark.createDataFrame(parts, "img string, row int, col int, y int, x int, label long")
    grid = tiling.grid(df.where("row = -1").selectExpr("img", "y as h", "x as w"), spec)
    flags = merge.object_flags(df.where("row >= 0"), grid, spec)
    assert {tuple(r) for r in merge.merge_two_phase(flags, grid).select("img", "row", "col", "label").collect()} == want


def test_two_tile_merge(spark):
    spans = {(0, 1): (1, 3, 0), (0, 2): (6, 7, 1), (0, 3): (8, 9, 2), (1, 4): (0, 1, 3), (1, 5): (3, 5, 4), (1, 6): (2, 2, 5)}
    rows = [("i", 0, c, y, x, k) for (c, k), (a, b, y) in spans.items() for x in range(a, b + 1)]
    spec = TileSpec(10, 10, 4)
    grid = spark.createDataFrame([("i", 0, 0, 0, 6, 0, 10), ("i", 0, 1, 0, 6, 6, 16)], "img string, row int, col int, y0 int, y1 int, x0 int, x1 int")
    flags = merge.object_flags(spark.createDataFrame(rows, "img string, row int, col int, y int, x int, label long"), grid, spec)
    assert {(r.col, r.label) for r in merge.merge_two_phase(flags, grid).collect()} == {(0, 1), (0, 2), (1, 5), (1, 6)}


def test_components(spark):
    rng = np.random.default_rng(3)
    a = rng.random((15, 17)) < 0.35
    y, x = np.nonzero(a)
    df = spark.createDataFrame(pd.DataFrame({"img": "i", "y": y.astype("int32"), "x": x.astype("int32")}))
    got = {(r.y, r.x): r.component for r in post.pixel_components(df, 17).collect()}
    want = {p: p[0] * 17 + p[1] for p in zip(y.tolist(), x.tolist(), strict=True)}
    for _ in range(300):
        for p in want:
            want[p] = min(want[q] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (q := (p[0] + dy, p[1] + dx)) in want)
    assert got == want


def test_model_segmenter_and_stack(spark):
    class Bright:
        def segment(self, tile):
            return (tile > 5).astype(int)

    a = np.zeros((6, 6), int)
    a[1:3, 4:6] = 9
    out = segment.segment(tiling.assign(image(spark, a), TileSpec(4, 4)), Bright()).collect()
    assert {(r.row, r.col, r.y, r.x) for r in out} == {(0, 1, y, x) for y in (1, 2) for x in (0, 1)}
    stack = spark.createDataFrame([("i", 0, 0, 0, True), ("i", 1, 0, 0, True), ("i", 2, 0, 1, False), ("i", 0, 1, 1, True)], "img string, slice int, y int, x int, on boolean")
    assert {(r.y, r.x): r.label for r in rasters.pack_stack(stack).collect()} == {(0, 0): 2, (1, 1): 1}


def test_names_and_read(spark, tmp_path):
    df = spark.createDataFrame([("a/0_320.npz",), ("b/12 7.tif",), ("row3_col4.npz",), ("notes.txt",)], "p string")
    assert [r.t and tuple(r.t) for r in df.select(rasters.tile_of_name(F.col("p")).alias("t")).collect()] == [(0, 320), (12, 7), (3, 4), None]
    np.array([[1, 2], [3, 4]], "uint8").tofile(tmp_path / "x.raw")
    px = rasters.read_images(spark, str(tmp_path), lambda data: np.frombuffer(data, "uint8").reshape(2, 2))
    assert {(r.y, r.x): r.v for r in px.collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}


def test_contrast(spark):
    flat = preprocess.to_8bit(image(spark, np.full((4, 4), 9)))
    assert {r.v for r in flat.collect()} == {0}
    a = np.arange(64 * 64).reshape(64, 64) % 256
    out = preprocess.equalise(image(spark, a))
    assert out.count() == 64 * 64 and out.where("v < 0 or v > 255").count() == 0
    up = preprocess.upscale(image(spark, np.array([[0, 100], [0, 100]])), 2).where("y = 0").orderBy("x").collect()
    assert [r.v for r in up] == [0, 25, 75, 100]
    with pytest.raises(ValueError):
        tiling.crop(image(spark, a), (5, 5, 0, 3))


def test_overlays(spark):
    px = image(spark, np.full((2, 4), 100))
    lab = labels(spark, np.array([[0, 1, 0, 0], [0, 2, 0, 0]]))
    flagged = spark.createDataFrame([("i", 1, True), ("i", 2, False)], "img string, label long, passed boolean")
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in render.verdict_overlay(px, lab, flagged, 0.5).collect()}
    assert got[0, 1] == (50, 177, 50) and got[1, 1] == (177, 50, 50) and got[0, 0] == (100, 100, 100)
    out = {(r.y, r.x): r for r in render.blend(px, lab, 0.5, 2).collect()}
    assert out[0, 0].r == 50 and out[0, 3].r == 100  # a tile with labels darkens its background, one without stays
    with pytest.raises(ValueError):
        render.blend(px, lab, 2)


def test_colours(spark):
    tiles = spark.createDataFrame([("i", r, c) for r in range(4) for c in range(5)], "img string, row int, col int")
    for by_place in (False, True):
        for r in render.tile_colours(tiles, by_place).collect():
            h = hashlib.sha256(f"{r.row}_{r.col}".encode()).digest()
            base = render.PALETTE[(7 * r.row + 11 * r.col) % 10 if by_place else h[0] % 10]
            k = 0 if by_place else 1
            assert (r.r, r.g, r.b) == tuple(min(255, max(100, v + h[k + i] % 60 - 30)) for i, v in enumerate(base))
    bright = render.object_colours(labels(spark, np.arange(1, 50).reshape(7, 7))).collect()
    assert len({(r.r, r.g, r.b) for r in bright}) > 40 and all(204 <= max(r.r, r.g, r.b) <= 255 for r in bright)


def test_overlay_of_tiles(spark):
    px, tiles = image(spark, np.full((2, 3), 100)), spark.createDataFrame([("i", 0, 0), ("i", 0, 1)], "img string, row int, col int")
    lab = spark.createDataFrame([("i", 0, 0, 0, 1, 5), ("i", 0, 1, 0, 1, 7), ("i", 0, 1, 1, 2, 7)], "img string, row int, col int, y int, x int, label long")
    colour = {r.col: (r.r, r.g, r.b) for r in render.tile_colours(tiles).collect()}
    lay = lambda v, o: int(v * 0.4 + o * 0.6)
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in render.tile_overlay(px, lab, tiles).collect()}
    assert got[0, 1] == tuple(lay(lay(100, a), b) for a, b in zip(colour[0], colour[1], strict=True))
    assert got[1, 2] == tuple(lay(100, b) for b in colour[1]) and got[0, 0] == (100, 100, 100)


def test_crops_and_backgrounds(spark):
    a = np.zeros((40, 60), int)
    a[20:26, 38:44] = 200
    r = render.best_crop(image(spark, a), extent(spark, 40, 60), 10).first()
    assert (r.y0, r.y1, r.x0, r.x1) == (15, 25, 34, 44)  # around (0.5, 0.66)
    small = render.best_crop(image(spark, a), extent(spark, 40, 60), 60).first()
    assert (small.y0, small.y1, small.x0, small.x1) == (0, 40, 0, 60)
    assert tuple(render.centre_crop(extent(spark, 40, 61), 11).first()) == ("i", 15, 25, 25, 35)
    both = spark.createDataFrame([("i", 2, 2), ("j", 1, 2), ("k", 1, 1)], "img string, h int, w int")
    got = render.background([image(spark, a[:2, :2], "j"), image(spark, a[:2, :2] + 3, "i"), image(spark, a[:2, :2], "i")], both).groupBy("img").agg(F.sum("v").alias("s"), F.count("*").alias("n")).collect()
    assert {r.img: (r.s, r.n) for r in got} == {"i": (12, 4), "j": (0, 4), "k": (0, 1)}


def test_labels_must_fit(spark):
    lab = labels(spark, np.ones((3, 3), int))
    assert tiling.within(lab, extent(spark, 3, 3)).count() == 9
    with pytest.raises(Exception, match="don't fit"):
        tiling.within(lab, extent(spark, 3, 2)).collect()


def test_figures(spark):
    before = spark.createDataFrame([("i", 0, 0, 1), ("i", 0, 1, 1), ("i", 0, 1, 2), ("j", 0, 0, 1)], "img string, row int, col int, label long")
    after = spark.createDataFrame([("i", 1), ("i", 1), ("k", 2)], "img string, label long")
    assert {r.img: (r.objects_in, r.objects_out, round(r.percent, 3)) for r in filters.merge_efficiency(before, after).collect()} == {"i": (3, 1, 33.333), "j": (1, 0, 0.0), "k": (0, 1, 0.0)}
    metrics_of = spark.createDataFrame([("i", 1, 5.0), ("i", 2, 50.0)], "img string, label long, area double")
    assert {r.metric: r.excluded for r in filters.outside(metrics_of, {"area": (0, 10)}).collect()} == {"area": 1}
    assert filters.label_counts_match(before, before.limit(3)).count() == 1
    d = filters.diameter_summary(metrics_of).first()
    assert abs(d.least - 2 * math.sqrt(5 / math.pi)) < 1e-9 and d.cv > 0
    tiles = spark.createDataFrame([("i", 0, c) for c in range(5)], "img string, row int, col int")
    assert sorted(r.batch for r in tiling.batches(tiles, 2).collect()) == [0, 0, 1, 1, 2]
    grey = spark.createDataFrame([(100.0, 50.0, 10.0)], "r double, g double, b double")
    assert abs(grey.select(preprocess.gray(F.col("r"), F.col("g"), F.col("b")).alias("v")).first().v - 57.742) < 1e-9
    lab = labels(spark, np.array([[0, 2], [3, 0]]))
    assert {(r.y, r.x): r.v for r in render.binary(image(spark, np.zeros((2, 2))), lab).collect()} == {(0, 0): 0, (0, 1): 255, (1, 0): 255, (1, 1): 0}
    passed = spark.createDataFrame([("i", 3, 1)], "img string, old long, new long")
    assert [tuple(r) for r in rasters.unpack_stack(lab, passed).collect()] == [("i", 0, 1, 0)]


def test_split_at_waists(spark):
    yy, xx = np.indices((30, 50))
    a = ((yy - 14) ** 2 + (xx - 14) ** 2 <= 100) | ((yy - 14) ** 2 + (xx - 32) ** 2 <= 100)
    lab = np.where(a, 7, 0)
    lab[27:29, 2:6] = 3
    got = refine.split_at_waists(labels(spark, lab), 100, 9).toPandas()
    assert sorted(got.groupby("label").size()) == sorted([8, *got[got.label > 1].groupby("label").size()]) and got.label.nunique() == 3
    assert len(got) == (lab > 0).sum() and set(got[got.label == 1].y) == {27, 28}
    sides = got[got.label > 1].groupby("label").x.mean().tolist()
    assert abs(min(sides) - 14) < 2 and abs(max(sides) - 32) < 2
    same = refine.split_at_waists(labels(spark, lab), 10_000).toPandas()
    assert same.groupby("label").size().tolist() == [8, a.sum()]


def plain_edges(v, low, high):
    """The same edges pixel by pixel."""
    h, w = v.shape
    p = np.pad(v.astype(int), 1, mode="edge")
    gx, gy = np.zeros((h, w), int), np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            q = p[y : y + 3, x : x + 3]
            gx[y, x] = (q[:, 2] - q[:, 0]) @ [1, 2, 1]
            gy[y, x] = (q[2] - q[0]) @ [1, 2, 1]
    size = np.abs(gx) + np.abs(gy)
    s = np.pad(size, 1)
    ridge = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            q, ax, ay = s[y : y + 3, x : x + 3], abs(gx[y, x]), abs(gy[y, x])
            if ay < ax * math.tan(math.pi / 8):
                thin = q[1, 1] > q[1, 0] and q[1, 1] >= q[1, 2]
            elif ay > ax * math.tan(3 * math.pi / 8):
                thin = q[1, 1] > q[0, 1] and q[1, 1] >= q[2, 1]
            else:
                a, b = (q[0, 0], q[2, 2]) if gx[y, x] * gy[y, x] >= 0 else (q[0, 2], q[2, 0])
                thin = q[1, 1] > a and q[1, 1] > b
            ridge[y, x] = thin and size[y, x] > low
    on = ridge & (size > high)
    while True:
        more = ridge & np.max([np.pad(on, 1)[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], axis=0)
        if (more == on).all():
            return on
        on = more


def test_edges(spark):
    rng = np.random.default_rng(4)
    v = np.where(np.add.outer(np.arange(14), np.arange(16)) < 15, 40, 160) + rng.integers(0, 30, (14, 16))
    want = plain_edges(v, 60, 200)
    got = np.zeros_like(want)
    for r in refine.edges(image(spark, v), 16, 60, 200).collect():
        got[r.y, r.x] = True
    assert (got == want).all() and want.any()
    wide = np.max([np.pad(want, 1)[dy : dy + 14, dx : dx + 16] for dy in range(3) for dx in range(3)], axis=0)
    lab = refine.parted_at_edges(image(spark, v), labels(spark, np.ones((14, 16), int)), 16, 60, 200).toPandas()
    assert {(y, x) for y, x in zip(lab.y, lab.x, strict=True)} == set(zip(*(k.tolist() for k in np.nonzero(~wide)), strict=True)) and lab.label.nunique() >= 2


def test_numbers_across_ranges(spark):
    rng = random.Random(2)
    names = [("i", k) for k in rng.sample(range(1 << 20), 300)] + [("j", k) for k in (5, 70_000, 1)]
    got = {(r.img, r.k): r.n for r in post.numbered(spark.createDataFrame(names, "img string, k long"), "n", "k").collect()}
    assert got == {(i, k): 1 + sum(a == i and b < k for a, b in names) for i, k in names}
