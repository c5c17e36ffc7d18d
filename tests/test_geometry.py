"""Hulls, holes, depths and waists against plain versions on random figures, and on figures with large boxes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import metrics, refine


def figures(seed, n=40):
    """Random sets of pixels, some of them in pieces and with holes in holes."""
    rng = np.random.default_rng(seed)
    for _ in range(n):
        h, w = rng.integers(1, 12, 2)
        a = rng.random((h, w)) < rng.choice([0.3, 0.6, 0.85, 0.95])
        if a.any():
            yield a


def labels(spark, shapes):
    parts = []
    for k, a in enumerate(shapes, 1):
        y, x = np.nonzero(a)
        parts.append(pd.DataFrame({"img": "i", "y": (y + 40 * k).astype("int32"), "x": x.astype("int32"), "label": k}))
    return spark.createDataFrame(pd.concat(parts), "img string, y int, x int, label long")


def plain_hull(a):
    """Points that no line through two midpoints leaves on its outer side."""
    y, x = np.nonzero(a)
    p = np.unique(np.concatenate([np.c_[2 * y + dy, 2 * x + dx] for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1))]), axis=0)
    gy, gx = np.mgrid[2 * y.min() : 2 * y.max() + 1 : 2, 2 * x.min() : 2 * x.max() + 1 : 2]
    inside = np.ones(gy.shape, bool)
    for u in p:
        for v in p:
            if (u != v).any() and (((v - u)[0] * (p - u)[:, 1] - (v - u)[1] * (p - u)[:, 0]) >= 0).all():
                inside &= (v - u)[0] * (gx - u[1]) - (v - u)[1] * (gy - u[0]) >= 0
    return int(inside.sum())


def plain_fill(a):
    """What side steps from a corner outside don't reach."""
    free = np.pad(~a, 1, constant_values=True)
    todo, out = [(0, 0)], {(0, 0)}
    while todo:
        y, x = todo.pop()
        for at in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= at[0] < free.shape[0] and 0 <= at[1] < free.shape[1] and free[at] and at not in out:
                out.add(at)
                todo.append(at)
    return free.size - len(out)


def plain_depth(a):
    out = np.argwhere(~np.pad(a, 1))
    return {(y, x): int(((out - (y + 1, x + 1)) ** 2).sum(1).min()) for y, x in np.argwhere(a).tolist()}


def test_hulls_and_fills(spark):
    shapes = [a for seed in range(6) for a in figures(seed)]
    ring = np.ones((7, 7), bool)
    ring[2:5, 2:5] = False
    shapes += [ring, np.tri(6, dtype=bool), np.ones((1, 1), bool)]
    got = metrics.shape(labels(spark, shapes)).toPandas().set_index("label")
    assert got.convex_area.sort_index().tolist() == [plain_hull(a) for a in shapes]
    assert got.filled_area.sort_index().tolist() == [plain_fill(a) for a in shapes]
    assert got.loc[len(shapes) - 2].tolist()[1:] == [49, 49] and got.loc[len(shapes) - 1, "convex_area"] == 21 and got.loc[len(shapes), "convex_area"] == 1


def test_an_object_with_a_huge_box(spark):
    """A frame of 20,000 x 20,000 pixels: its hull and its hole are 4 * 10^8 pixels, and nothing holds them."""
    n = 20_000
    side = spark.range(n).select(F.lit("i").alias("img"), F.col("id").cast("int").alias("a"), F.lit(1).cast("long").alias("label"))
    edge = lambda y, x: side.select("img", y.cast("int").alias("y"), x.cast("int").alias("x"), "label")
    a, first, last = F.col("a"), F.lit(0), F.lit(n - 1)
    frame = edge(first, a).union(edge(last, a)).union(edge(a, first)).union(edge(a, last)).distinct()
    r = metrics.shape(frame).first()
    assert (r.convex_area, r.filled_area) == (n * n, n * n)


def test_envelopes():
    rng = np.random.default_rng(2)
    for _ in range(500):
        f = (rng.integers(0, 9, rng.integers(1, 12)) ** 2).tolist()
        assert refine.envelope(f) == [min(v + (i - k) ** 2 for k, v in enumerate(f)) for i in range(len(f))]


def test_depths(spark):
    shapes = list(figures(3)) + list(figures(4))
    got = {}
    for r in refine.depths(labels(spark, shapes)).collect():
        got.setdefault(r.label, {})[r.y - 40 * r.label, r.x] = r.depth
    assert got == {k: plain_depth(a) for k, a in enumerate(shapes, 1)}


def plain_tops(a, reach):
    """Where each pixel climbs to, step by step."""
    deep = plain_depth(a)
    best = {p: max((q for q in deep if abs(q[0] - p[0]) <= reach and abs(q[1] - p[1]) <= reach), key=lambda q: (deep[q], -q[0], -q[1])) for p in deep}
    out = {}
    for p in deep:
        q = p
        while best[q] != q:
            q = best[q]
        out[p] = q
    return out


@pytest.mark.parametrize("reach", [1, 2])
def test_parts(spark, reach):
    shapes = list(figures(5, 30))
    got = {}
    for r in refine.climbed(refine.depths(labels(spark, shapes)), reach).collect():
        got.setdefault(r.label, {})[r.y - 40 * r.label, r.x] = (r.top >> 32) - 40 * r.label, r.top & (1 << 32) - 1
    assert got == {k: plain_tops(a, reach) for k, a in enumerate(shapes, 1)}


def test_split_labels(spark):
    """Large objects get a label for each part, in the order of the old labels and of the parts' deepest places."""
    shapes = [a for a in figures(6, 60) if a.sum() > 3]
    got = {(r.y, r.x): r.label for r in refine.split_at_waists(labels(spark, shapes), 12).collect()}
    want, n = {}, 0
    for k, a in enumerate(shapes, 1):
        tops = plain_tops(a, 1) if a.sum() > 12 else dict.fromkeys(map(tuple, np.argwhere(a).tolist()), (0, 0))
        names = {t: n + i for i, t in enumerate(sorted(set(tops.values())), 1)}
        n += len(names)
        want |= {(y + 40 * k, x): names[t] for (y, x), t in tops.items()}
    assert got == want
