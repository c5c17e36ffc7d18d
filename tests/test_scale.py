"""How the work is dealt: joins by image, chains of tiles, batches of tiles, rectangles."""

import importlib
import random
import re
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.model import Thresholds, TileSpec
from tessella.operators import filters, merge, metrics, plots, post, preprocess, refine, render, segment, tiling

PX = "img string, y int, x int, v int"


def image(spark, array, img="i"):
    y, x = np.indices(array.shape)
    return spark.createDataFrame(pd.DataFrame({"img": img, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "v": array.ravel().astype("int32")}), PX)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_not_dealt_by_image(spark):
    """Not even where Spark would broadcast nothing by itself: then one image would be one task."""
    px = image(spark, np.arange(40 * 50).reshape(40, 50))
    lab = px.where("v % 3 = 0").select("img", "y", "x", F.col("v").cast("long").alias("label"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (preprocess.to_8bit(px), tiling.crop(px, (0.1, 0.9, 0.2, 0.8)), tiling.within(lab, tiling.extents(px)), metrics.border_touch(metrics.area_bbox(lab), tiling.extents(px))):
            assert not re.search(r"hashpartitioning\(img#\d+, \d+\)", plan(df)) and df.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_more_images_than_are_broadcast(spark, monkeypatch):
    px = image(spark, np.arange(12).reshape(3, 4), "a").union(image(spark, np.arange(20).reshape(4, 5), "b"))
    want = {tuple(r) for r in preprocess.to_8bit(px).collect()}
    monkeypatch.setattr(tiling, "IMAGES", 1)
    df = preprocess.to_8bit(px)
    assert {tuple(r) for r in df.collect()} == want and "salt" in plan(df)
    sized = tiling.by_image(px.where("img = 'a' or v > 100"), tiling.extents(px), "left")
    assert sized.count() == 12 and {r.h for r in sized.collect()} == {3}


def test_extents_are_read_once(spark):
    px = image(spark, np.zeros((3, 4)))
    assert tiling.extents(px) is tiling.extents(px) and tiling.once(tiling.extents(px)) is tiling.extents(px)


@pytest.mark.parametrize("factor", [1.5, 2.37])
def test_resizing_is_dealt_like_the_pixels(spark, factor):
    """Places are made where the pixels are, not in the one task that has the images' sizes; and each is the mean of the pixels around it that are there, in blocks of any size."""
    rng = np.random.default_rng(8)
    h, w = 70, 132
    a = rng.integers(0, 1000, (h, w))
    gone = rng.random((h, w)) < 0.2
    df = preprocess.upscale(image(spark, np.where(gone, -1, a)).where("v >= 0"), factor)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(df.select("*"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    th, tw, want = round(h * factor), round(w * factor), {}
    for ty in range(th):
        for tx in range(tw):
            sy, sx = (ty + 0.5) * h / th - 0.5, (tx + 0.5) * w / tw - 0.5
            y, x, known, v = int(np.floor(sy)), int(np.floor(sx)), False, 0.0
            for i in (0, 1):
                for j in (0, 1):
                    at = min(max(y + i, 0), h - 1), min(max(x + j, 0), w - 1)
                    if not gone[at]:
                        known, v = True, v + (sy - y if i else 1 - sy + y) * (sx - x if j else 1 - sx + x) * a[at]
            if known:
                want[ty, tx] = int(np.floor(round(v, 6) + 0.5))
    assert {(r.y, r.x): r.v for r in df.collect()} == want


def plain_equalised(a, clip=2.0, cells=8):
    """The same, pixel by pixel; a pixel below 0 is not there."""
    h, w = a.shape
    ny, nx = (max(1, min(cells, n // 32)) for n in (h, w))
    fy, fx = (np.arange(h) + 0.5) * ny / h, (np.arange(w) + 0.5) * nx / w
    table = {}
    for cy in range(ny):
        for cx in range(nx):
            part = a[np.floor(fy) == cy][:, np.floor(fx) == cx]
            n = np.bincount(part[part >= 0], minlength=256)
            if total := n.sum():
                limit = max(1.0, clip * total / 256)
                table[cy, cx] = (np.cumsum(np.minimum(n, limit)) + np.maximum(n - limit, 0).sum() / 256 * np.arange(1, 257)) * 255 / total
    out = {}
    for y, x in np.argwhere(a >= 0).tolist():
        qy, qx, v = int(np.floor(fy[y] - 0.5)), int(np.floor(fx[x] - 0.5)), 0.0
        ay, ax = fy[y] - 0.5 - qy, fx[x] - 0.5 - qx
        for i in (0, 1):
            for j in (0, 1):
                at = min(max(qy + i, 0), ny - 1), min(max(qx + j, 0), nx - 1)
                if at in table:
                    v += (ay if i else 1 - ay) * (ax if j else 1 - ax) * table[at][a[y, x]]
        out[y, x] = min(255, int(np.floor(round(v, 6) + 0.5)))
    return out


def test_equalised_pixels_are_not_copied(spark):
    """Each pixel meets one row of four numbers; it is not copied for four tables that are searched value by value. Cells without pixels count nothing."""
    rng = np.random.default_rng(5)
    a = np.clip(rng.normal(90, 40, (70, 100)), 0, 255).astype(int)
    a[rng.random(a.shape) < 0.1] = -1
    a[:40, :40] = -1
    df = preprocess.equalise(image(spark, a).where("v >= 0"))
    shown = plan(df.select("*"))
    assert "lambdafunction" not in shown and not re.search(r"keys=\[img#\d+, y#\d+, x#\d+\]", shown)
    assert {(r.y, r.x): r.v for r in df.collect()} == plain_equalised(a)


def flooded(a):
    """The first place, line by line, that each place of a mask is joined to."""
    found = {}
    for start in map(tuple, np.argwhere(a).tolist()):
        todo = [] if start in found else [start]
        while todo:
            y, x = todo.pop()
            if 0 <= y < a.shape[0] and 0 <= x < a.shape[1] and a[y, x] and (y, x) not in found:
                found[y, x] = start[0] * a.shape[1] + start[1]
                todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return found


def winding(n):
    """One path that goes to and fro over every other line, joined at the ends by turns."""
    a = np.zeros((n, n), bool)
    a[::2] = True
    a[1::4, -1] = a[3::4, 0] = True
    return a


def test_rounds_of_components(spark, monkeypatch):
    """Rounds don't grow with the length of a component, whether it stays in a block, in a square of blocks or in neither."""
    rng = np.random.default_rng(6)
    masks = {"path": winding(61), "dots": rng.random((50, 61)) < 0.4, "diagonals": np.add.outer(np.arange(40), np.arange(40)) % 4 == 0, "one": np.ones((1, 1), bool), "column": np.ones((60, 1), bool)}
    px = None
    for name, a in masks.items():
        part = image(spark, a.astype(int), name).where("v = 1").select("img", "y", "x")
        px = part if px is None else px.union(part)
    plain = post.written
    want = {(name, *p): (c // a.shape[1]) * 61 + c % a.shape[1] for name, a in masks.items() for p, c in flooded(a).items()}
    for block, square, most in ((256, 16, 2), (8, 16, 4), (4, 2, 24)):
        count = []
        monkeypatch.setattr(post, "BLOCK", block, raising=False)
        monkeypatch.setattr(post, "SQUARE", square, raising=False)
        monkeypatch.setattr(post, "written", lambda df, count=count: count.append(1) or plain(df))
        got = {(r.img, r.y, r.x): r.component for r in post.pixel_components(px, 61).collect()}
        assert got == want and len(count) <= most
    assert post.pixel_components(px.where("y < 0"), 61).count() == 0


def test_labels_to_split_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    a = np.zeros((12, 40), int)
    a[1:9, 2:20], a[4, 20:38], a[10, 1] = 4, 4, 2
    lab = image(spark, a).where("v > 0").select("img", "y", "x", F.col("v").cast("long").alias("label"))
    got = refine.split_at_waists(lab.mapInArrow(passed, "img string, y int, x int, label long"), 12)
    assert got.count() == (a > 0).sum() and seen.value == (a > 0).sum()


def test_empty_boxes(spark):
    px = image(spark, np.arange(12).reshape(3, 4))
    for box in ((0.5, 0.5, 0, 1), (0, 1, 0.7, 0.2), (4, 9, 0, 3), (0, 2, 3, 9), (2, 2, 0, 3)):
        with pytest.raises(ValueError):
            tiling.crop(px, box)
    assert tiling.crop(px, (3, 9, 2, 9)).collect()[0].v == 11


def test_images_without_objects(spark):
    extent = spark.createDataFrame([("i", 5, 5), ("j", 5, 5)], "img string, h int, w int")
    flagged = spark.createDataFrame([("i", 1, True), ("i", 2, False)], "img string, label long, passed boolean")
    assert {tuple(r) for r in filters.retention(flagged, extent).collect()} == {("i", 2, 1, 1, 0.5), ("j", 0, 0, 0, 0.0)}
    before = spark.createDataFrame([("i", 0, 0, 1)], "img string, row int, col int, label long")
    after = spark.createDataFrame([("i", 1)], "img string, label long")
    assert {tuple(r) for r in filters.merge_efficiency(before, after, extent).collect()} == {("i", 1, 1, 100.0), ("j", 0, 0, 0.0)}
    assert Thresholds().max_pixels == 1e9


def chain(rng, n):
    """Objects of a row of tiles, few of them in an overlap."""
    rows = []
    for col in range(n):
        many = rng.choice([0, 1, 2, 4])
        for label in range(1, many + 1):
            rows.append({"img": "i", "row": 0, "col": col, "label": label} | {f"{k}_{s}": rng.random() < 0.3 for k in "bds" for s in merge.SIDES})
        if not many:
            rows.append({"img": "i", "row": 0, "col": col, "label": None} | {f"{k}_{s}": None for k in "bds" for s in merge.SIDES})
    return pd.DataFrame(rows)


def test_chains_fall_into_parts(spark):
    rng = random.Random(3)
    lines = [chain(rng, rng.randrange(1, 9)).assign(row=k) for k in range(400)]
    want = {(k, int(c), int(label)) for k, line in enumerate(lines) for c, label in merge.fold(line, "right", "left", "col")[["col", "label"]].itertuples(index=False)}
    records = [r for line in lines for r in line.to_dict("records")]
    names = [f"{k}_{s}" for k in "bds" for s in merge.SIDES]
    whole = [("i", int(r["row"]), int(r["col"]), int(r["label"]), *(bool(r[n]) for n in names)) for r in records if r["label"] == r["label"] and r["label"] is not None]
    flags = spark.createDataFrame(whole, "img string, row int, col int, label long, " + ", ".join(f"{n} boolean" for n in names))
    tiles = spark.createDataFrame(sorted({("i", int(r["row"]), int(r["col"])) for r in records}), "img string, row int, col int")
    parts = merge.chained(flags, tiles, "row", "col", "right", "left")
    assert parts.select("row", "part").distinct().count() > 2 * len(lines)
    got = merge.phase(flags, tiles, "row", "col", "right", "left")
    assert {(r.row, r.col, r.label) for r in got.collect()} == want


MODEL = """
import os, pathlib, uuid
class Counted:
    def __init__(self, batches):
        self.batches = batches
        pathlib.Path(os.environ["COUNTED"] if "COUNTED" in os.environ else FOLDER, f"load-{os.getpid()}-{uuid.uuid4().hex}").touch()
    def segment(self, tile):
        pathlib.Path(FOLDER, f"tile-{os.getpid()}-{uuid.uuid4().hex}").touch()
        if tile.max() == 99:
            raise ValueError("too bright")
        return (tile > 5).astype(int)
class Batched(Counted):
    def segment_batch(self, tiles):
        pathlib.Path(FOLDER, f"batch-{len(tiles)}-{uuid.uuid4().hex}").touch()
        if any(t.max() == 99 for t in tiles):
            raise ValueError("one of them is too bright")
        return [(t > 5).astype(int) for t in tiles]
def load():
    return Counted(False)
def load_batched():
    return Batched(True)
"""


@pytest.fixture
def counted(spark, tmp_path):
    name = f"counted_model_{abs(hash(str(tmp_path)))}"
    path = tmp_path / f"{name}.py"
    path.write_text(f"FOLDER = {str(tmp_path)!r}\n{MODEL}")
    spark.sparkContext.addPyFile(str(path))
    sys.path.insert(0, str(tmp_path))
    yield importlib.import_module(name), lambda kind: [p.name.split("-") for p in tmp_path.glob(f"{kind}-*")]
    sys.path.remove(str(tmp_path))


def test_a_model_is_loaded_once_a_worker(spark, counted):
    model, seen = counted
    a = np.zeros((40, 40), int)
    a[::7, ::7] = 9
    tiled = tiling.assign(image(spark, a), TileSpec(4, 4))
    labels, failed = segment.segment_batches(tiled, model.load, size=3)
    assert labels.count() == (a > 5).sum() and failed.count() == 0
    assert {tuple(r) for r in labels.select("row", "col", "y", "x").collect()} == {(y // 4, x // 4, y % 4, x % 4) for y, x in np.argwhere(a > 5).tolist()}
    workers = [pid for _, pid, _ in seen("load")]
    assert len(seen("tile")) == 100 and len(set(workers)) == len(workers) <= 8


def test_failed_tiles(spark, counted):
    model, seen = counted
    a = np.zeros((16, 16), int)
    a[5, 6], a[1, 1], a[14, 14] = 99, 9, 9
    tiled = tiling.assign(image(spark, a), TileSpec(4, 4))
    for load in (model.load, model.load_batched):
        labels, failed = segment.segment_batches(tiled, load, size=4, keep_going=True)
        assert {(r.row, r.col) for r in labels.collect()} == {(0, 0), (3, 3)}
        assert [tuple(r) for r in failed.collect()] == [("i", 1, 1, "ValueError: too bright")]
        with pytest.raises(Exception, match="failed"):
            segment.segment_batches(tiled, load)
    assert seen("batch") and max(int(n) for _, n, _ in seen("batch")) <= 8
    late = segment.segment_batches(tiled, model.load, seconds=0, keep_going=True)[1]
    assert late.count() == 16 and late.where("error like 'TimeoutError%'").count() == 16


def test_model_arguments():
    given = {"diameter": 0, "flow_threshold": 0.4, "cellprob_threshold": 0.1, "batch_size": 4, "channels": [0, 0]}
    want = {"diameter": 0, "flow_threshold": 0.4, "cellprob_threshold": 0.1, "batch_size": 4, "augment": False, "do_3D": False}
    assert segment.model_arguments(given) == want | {"resample": True}
    assert segment.model_arguments(given | {"resample": False}) == want
    assert segment.model_arguments(given | {"resample": False}, resample_is_default=False) == want | {"resample": False}


@pytest.mark.parametrize("cell", [1, 4, 50])
def test_rectangles_that_meet(spark, cell):
    rng = random.Random(cell)
    box = lambda k: ("ij"[rng.randrange(2)], k, *(v for _ in "yx" for v in sorted((rng.randrange(-9, 30), rng.randrange(-9, 30)))))
    a, b = ([box(k) for k in range(60)] for _ in range(2))
    schema = "img string, {} int, y0 int, y1 int, x0 int, x1 int"
    got = tiling.meeting(spark.createDataFrame(a, schema.format("p")), spark.createDataFrame(b, schema.format("q")), cell).select("img", "p", "q", "y0", "y1", "x0", "x1").collect()
    want = [(p[0], p[1], q[1], max(p[2], q[2]), min(p[3], q[3]), max(p[4], q[4]), min(p[5], q[5])) for p in a for q in b if p[0] == q[0]]
    assert sorted(map(tuple, got)) == sorted(w for w in want if w[3] < w[4] and w[5] < w[6])


def test_histograms_and_densities(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(5, 2, 300).round(3).tolist()
    rows = [("i", k, x) for k, x in enumerate(v)] + [("i", 900, None), ("i", 901, float("nan")), ("i", 902, -7.0), ("i", 903, 99.0), ("j", 1, 10.0), ("j", 2, 10.0)]
    df = spark.createDataFrame(rows, "img string, label long, m double")
    hist = plots.histograms(df, {"m": (0, 10)}, {"m": (3, 6)}, 16).toPandas().set_index(["img", "bin"])
    inside = [x for x in v if 0 <= x <= 10]
    want, _ = np.histogram(inside, 16, (0, 10))
    assert [int(hist["n"].get(("i", k), 0)) for k in range(16)] == want.tolist()
    assert hist.loc[("i", -1), "n"] == sum(x < 0 for x in v) + 1 and hist.loc[("i", 16), "n"] == sum(x > 10 for x in v) + 1 and hist.loc[("j", 15), "n"] == 2
    assert hist.excluded.sum() == sum(not 3 <= x <= 6 for x in v) + 4
    a, b = df.where("label % 2 = 0"), df.where("label % 2 = 1")
    parts = plots.added(*(plots.histograms(x, {"m": (0, 10)}, {"m": (3, 6)}, 16) for x in (a, b)))
    assert {tuple(r) for r in parts.collect()} == {tuple(r) for r in plots.histograms(df, {"m": (0, 10)}, {"m": (3, 6)}, 16).collect()}
    got = plots.densities(parts, {"m": (0, 10)}, 16).where("img = 'i'").orderBy("value").toPandas()
    centres = np.repeat((np.arange(16) + 0.5) * 10 / 16, want)
    width = centres.std(ddof=1) * len(centres) ** -0.2
    plain = [np.exp(-0.5 * ((x - centres) / width) ** 2).sum() / (len(centres) * width * np.sqrt(2 * np.pi)) for x in got.value]
    assert np.allclose(got.density, plain) and (got.kept <= got.density + 1e-12).all() and len(got) == 16


def test_edges_of_tiles(spark):
    tiles = spark.createDataFrame([("i", 0, 0, 0, 9, 0, 8), ("i", 0, 1, 0, 9, 7, 13)], "img string, row int, col int, y0 int, y1 int, x0 int, x1 int")
    lab = spark.createDataFrame([("i", 0, 0, 0, 0, 1), ("i", 0, 0, 4, 4, 1)], "img string, row int, col int, y int, x int, label long")
    got = {(r.col, r.y, r.x) for r in tiling.edges(tiles, lab).collect()}
    assert got == {(0, y, x) for y in range(9) for x in range(8) if y < 3 or y >= 6 or x < 3 or x >= 5} - {(0, 0, 0)}
    px = image(spark, np.full((9, 13), 100))
    drawn = {(r.y, r.x): (r.r, r.g, r.b) for r in render.edge_overlay(px, tiling.edges(tiles, lab), tiles).collect()}
    assert drawn[0, 0] == drawn[4, 4] == (100, 100, 100) != drawn[0, 1]


def test_windows(spark):
    px = image(spark, np.zeros((30, 30)), "a").union(image(spark, np.zeros((50, 20)), "b"))
    got = {(r.img, r.row, r.col): r["count"] for r in tiling.windows(px, 40, 4).groupBy("img", "row", "col").count().collect()}
    assert got == {("a", 0, 0): 900, ("b", 0, 0): 800, ("b", 1, 0): 280}
