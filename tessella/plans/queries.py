"""Registered queries over rasters derived from the given tables, and the same in SQL.

Most use images of event values; tiles of 20 x 20 that overlap by 6 are segmented into blocks, which neighbouring tiles cut differently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.model import Thresholds, TileSpec
from tessella.operators import filters, merge, metrics, plots, post, preprocess, refine, render, segment, tiling
from tessella.sources import rasters, slides, tiles

SPEC = TileSpec(20, 20, 6)
BLOCK, BRIGHT, SPARSE = 5, 3000, 12000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PX = """px AS MATERIALIZED (
  SELECT concat('e', event_id // 100000) AS img, CAST(event_id % 100000 // 100 AS INTEGER) AS y, CAST(event_id % 100 AS INTEGER) AS x,
    CAST(floor(value * 100) AS INTEGER) AS v FROM events WHERE value IS NOT NULL AND event_id IS NOT NULL
), ext AS MATERIALIZED (SELECT img, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY img),
tiles AS MATERIALIZED (
  SELECT img, CAST(y0 // 14 AS INTEGER) AS "row", CAST(x0 // 14 AS INTEGER) AS col, CAST(y0 AS INTEGER) AS y0, CAST(least(y0 + 20, h) AS INTEGER) AS y1,
    CAST(x0 AS INTEGER) AS x0, CAST(least(x0 + 20, w) AS INTEGER) AS x1
  FROM (SELECT img, h, w, y0, unnest(range(0, w, 14)) AS x0 FROM (SELECT *, unnest(range(0, h, 14)) AS y0 FROM ext))
), tpx AS MATERIALIZED (
  SELECT p.img, "row", col, p.y, p.x, p.y - y0 AS ty, p.x - x0 AS tx, y1 - y0 AS h, x1 - x0 AS w, v
  FROM px p JOIN tiles t ON p.img = t.img AND p.y >= y0 AND p.y < y1 AND p.x >= x0 AND p.x < x1
)"""
TL = f"""tl AS MATERIALIZED (
  SELECT *, CAST(ty // {BLOCK} * 1000 + tx // {BLOCK} + 1 AS BIGINT) AS label FROM tpx WHERE v > {BRIGHT}
)"""
FLAGS = """fl AS MATERIALIZED (
  SELECT img, "row", col, label,
    bool_or(tx >= greatest(0, w - 2)) AS b_right,
    bool_or(w - 6 >= 0 AND tx >= w - 4) AND NOT bool_or(w - 6 >= 0 AND tx >= greatest(0, w - 7) AND tx < least(w, w - 4)) AS d_right,
    bool_or(tx >= 14) AS s_right,
    bool_or(tx < least(w, 2)) AS b_left, bool_or(6 < w AND tx < 4) AND NOT bool_or(6 < w AND tx >= 5 AND tx < least(w, 8)) AS d_left,
    bool_or(tx < 6) AS s_left,
    bool_or(ty >= greatest(0, h - 2)) AS b_down,
    bool_or(h - 6 >= 0 AND ty >= h - 4) AND NOT bool_or(h - 6 >= 0 AND ty >= greatest(0, h - 7) AND ty < least(h, h - 4)) AS d_down,
    bool_or(ty >= 14) AS s_down,
    bool_or(ty < least(h, 2)) AS b_up, bool_or(6 < h AND ty < 4) AND NOT bool_or(6 < h AND ty >= 5 AND ty < least(h, 8)) AS d_up,
    bool_or(ty < 6) AS s_up
  FROM tl GROUP BY ALL
)"""


def chain_sql(name: str, across: str, along: str, near: str, far: str, live: str) -> str:
    """SQL of one phase: what is left of every tile, as a recursion along the chains over lists of live labels."""
    lists = ", ".join(f"coalesce(list(label) FILTER ({k}_{s}), []) AS {k}_{s}" for k in "bds" for s in (near, far))
    return f"""t_{name} AS MATERIALIZED (
  SELECT t.img, t."row", t.col, coalesce(list(f.label) FILTER (f.label IS NOT NULL), []) AS live, {lists}
  FROM tiles t LEFT JOIN {live} f USING (img, "row", col) GROUP BY ALL
), r_{name} AS (
  SELECT img, {across}, {along}, live, CAST([] AS BIGINT[]) AS done FROM t_{name} WHERE {along} = 0
  UNION ALL
  SELECT img, {across}, {along} + 1,
    CASE WHEN NOT met THEN live2 WHEN len(live1) >= len(live2) THEN list_filter(live2, lambda e: NOT list_contains(d_{far}, e)) ELSE list_filter(live2, lambda e: NOT list_contains(b_{far}, e)) END,
    CASE WHEN NOT met THEN live1 WHEN len(live1) >= len(live2) THEN list_filter(live1, lambda e: NOT list_contains(b_{near}, e)) ELSE list_filter(live1, lambda e: NOT list_contains(d_{near}, e)) END
  FROM (
    SELECT r.img, r.{across}, r.{along}, r.live AS live1, n.live AS live2, a.b_{near}, a.d_{near}, n.b_{far}, n.d_{far},
      len(list_intersect(r.live, a.s_{near})) > 0 OR len(list_intersect(n.live, n.s_{far})) > 0 AS met
    FROM r_{name} r JOIN t_{name} a ON a.img = r.img AND a.{across} = r.{across} AND a.{along} = r.{along}
    JOIN t_{name} n ON n.img = r.img AND n.{across} = r.{across} AND n.{along} = r.{along} + 1
  )
), o_{name} AS MATERIALIZED (
  SELECT img, {across}, {along} - 1 AS {along}, unnest(done) AS label FROM r_{name} WHERE {along} > 0
  UNION ALL
  SELECT img, {across}, {along}, unnest(live) AS label FROM r_{name} r WHERE {along} = (SELECT max({along}) FROM t_{name} t WHERE t.img = r.img)
), f_{name} AS MATERIALIZED (SELECT f.* FROM {live} f JOIN o_{name} USING (img, "row", col, label))"""


IDS = """ids AS MATERIALIZED (
  SELECT img, "row", col, label, row_number() OVER (PARTITION BY img ORDER BY "row", col, label) AS id FROM fl
)"""
MERGED = ", ".join([chain_sql("p1", '"row"', "col", "right", "left", "fl"), chain_sql("p2", "col", '"row"', "down", "up", "f_p1")])
ASSEMBLED = """lp AS MATERIALIZED (
  SELECT img, y, x, arg_min(id, ("row", col, id)) AS label FROM tl JOIN f_p2 USING (img, "row", col, label) JOIN ids USING (img, "row", col, label)
  GROUP BY img, y, x
)"""
MEASURED = """box AS MATERIALIZED (
  SELECT img, label, count(*) AS area, min(y) AS bbox_0, min(x) AS bbox_1, max(y) + 1 AS bbox_2, max(x) + 1 AS bbox_3 FROM lp GROUP BY img, label
), mom AS MATERIALIZED (
  SELECT img, label, 4 * sqrt(l1) AS major_axis_length, 4 * sqrt(l2) AS minor_axis_length, CASE WHEN l1 > 0 THEN sqrt(greatest(1 - l2 / l1, 0)) ELSE 0 END AS eccentricity
  FROM (SELECT img, label, (vy + vx) / 2 + root AS l1, greatest((vy + vx) / 2 - root, 0) AS l2 FROM (SELECT *, sqrt((vy - vx) * (vy - vx) / 4 + c * c) AS root FROM (
    SELECT img, label, (n * syy - sy * sy) / (n * n) AS vy, (n * sxx - sx * sx) / (n * n) AS vx, (n * sxy - sx * sy) / (n * n) AS c FROM (
      SELECT img, label, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(x) AS DOUBLE) AS sx,
        CAST(sum(y * y) AS DOUBLE) AS syy, CAST(sum(x * x) AS DOUBLE) AS sxx, CAST(sum(x * y) AS DOUBLE) AS sxy FROM lp GROUP BY img, label))))
), edge AS MATERIALIZED (
  SELECT p.img, p.label, p.y, p.x FROM lp p LEFT JOIN lp q ON q.img = p.img AND q.label = p.label AND abs(q.y - p.y) + abs(q.x - p.x) = 1
  GROUP BY ALL HAVING count(q.y) < 4
), per AS MATERIALIZED (
  SELECT img, label, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1.0::DOUBLE WHEN code IN (21, 33) THEN sqrt(2.0) WHEN code IN (13, 23) THEN (1 + sqrt(2.0)) / 2 ELSE 0 END) AS perimeter
  FROM (
    SELECT p.img, p.label, p.y, p.x, 1 + coalesce(sum(CASE abs(q.y - p.y) + abs(q.x - p.x) WHEN 1 THEN 2 WHEN 2 THEN 10 END), 0) AS code
    FROM edge p LEFT JOIN edge q ON q.img = p.img AND q.label = p.label AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 AND (q.y <> p.y OR q.x <> p.x)
    GROUP BY ALL
  ) GROUP BY img, label
), met AS MATERIALIZED (
  SELECT *, bbox_0 = 0 OR bbox_1 = 0 OR bbox_2 = h OR bbox_3 = w AS border_touch, major_axis_length / nullif(minor_axis_length, 0) AS aspect_ratio,
    CASE WHEN perimeter > 0 THEN least(greatest(4 * pi() * area / (perimeter * perimeter), 0), 1) END AS circularity
  FROM box JOIN mom USING (img, label) JOIN per USING (img, label) JOIN ext USING (img)
), pass AS MATERIALIZED (
  SELECT *, coalesce(area BETWEEN 4 AND 60 AND circularity >= 0.3 AND eccentricity BETWEEN 0 AND 1 AND aspect_ratio BETWEEN 0 AND 4 AND NOT border_touch, false) AS passed FROM met
)"""
LIMITS = Thresholds(min_pixels=4, max_pixels=60, min_circularity=0.3, max_aspect_ratio=4, exclude_border=True)


def register(sql: str | None = None, *ctes: str):
    """Registers a query under its name, with its SQL after the named parts."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.raster_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def tiles_of(px: DataFrame) -> DataFrame:
    return tiling.grid(tiling.extents(px), SPEC)


def labelled(px: DataFrame) -> DataFrame:
    return segment.block_labels(tiling.assign(px, SPEC), BLOCK, BRIGHT)


def flags_of(px: DataFrame) -> DataFrame:
    return merge.object_flags(labelled(px), tiles_of(px), SPEC)


def merged(px: DataFrame) -> DataFrame:
    return merge.merge_two_phase(flags_of(px), tiles_of(px))


def assembled(px: DataFrame) -> DataFrame:
    flags, tiles = flags_of(px), tiles_of(px)
    ids = merge.reassign_ids(flags.select("img", "row", "col", "label"), tiles)
    return merge.assemble(labelled(px), merge.merge_two_phase(flags, tiles).select("img", "row", "col", "label").join(ids, ["img", "row", "col", "label"]), SPEC)


def measured(px: DataFrame) -> DataFrame:
    return metrics.measure(assembled(px), tiling.extents(px), geometry=False)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register('SELECT * FROM tiles', PX)
def tile_grid(spark, sf_dir):
    return tiles_of(events(spark, sf_dir))


@register('SELECT img, "row", col, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM tpx GROUP BY ALL', PX)
def tile_assign(spark, sf_dir):
    return tiling.assign(events(spark, sf_dir), SPEC).groupBy("img", "row", "col").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


STATS = 'SELECT img, "row", col, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS least, max(v) AS most FROM {} GROUP BY img, "row", col'


@register(STATS.format("tpx"), PX)
def tile_stats(spark, sf_dir):
    return rounded(preprocess.tile_stats(tiling.assign(events(spark, sf_dir), SPEC)), "mean", "std")


@register(f"SELECT * FROM ({STATS.format('(SELECT * REPLACE (v // 12000 AS v) FROM tpx)')}) WHERE std < 1 OR most - least < 5", PX)
def low_contrast_tiles(spark, sf_dir):
    dim = tiling.assign(events(spark, sf_dir), SPEC).withColumn("v", F.expr("cast(v div 12000 as int)"))
    return rounded(preprocess.low_contrast(preprocess.tile_stats(dim)), "mean", "std")


@register("""SELECT px.img, CAST(y - floor(h * 0.25::DOUBLE) AS INTEGER) AS y, CAST(x - floor(w * 0.1::DOUBLE) AS INTEGER) AS x, v FROM px JOIN ext USING (img)
WHERE x >= floor(w * 0.1::DOUBLE) AND x < floor(w * 0.6::DOUBLE) AND y >= floor(h * 0.25::DOUBLE) AND y < floor(h * 0.75::DOUBLE)""", PX)
def crop_relative(spark, sf_dir):
    return tiling.crop(events(spark, sf_dir), (0.1, 0.6, 0.25, 0.75))


PCT = "pct AS (SELECT img, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM px JOIN ext USING (img) WHERE (y * w + x) % greatest(1, h * w // 1000000) = 0 GROUP BY img)"
EIGHT = f"{PCT}, v8 AS MATERIALIZED (SELECT img, y, x, CAST(floor(least(greatest((v - lo) / (hi - lo), 0), 1) * 255) AS INTEGER) AS v FROM px JOIN pct USING (img))"


@register("SELECT img, round(lo, 6) AS lo, round(hi, 6) AS hi FROM pct", PX, PCT)
def intensity_percentiles(spark, sf_dir):
    return rounded(preprocess.percentiles(events(spark, sf_dir)), "lo", "hi")


@register("SELECT * FROM v8", PX, EIGHT)
def stretch_8bit(spark, sf_dir):
    return preprocess.to_8bit(events(spark, sf_dir))


GAMMA = "least(greatest(2.2::DOUBLE - (2.2::DOUBLE - 1.9::DOUBLE) * (quantile_cont(g.v, 0.5) / 255), 1.9::DOUBLE), 2.2::DOUBLE)"


@register(f'SELECT img, "row", col, round({GAMMA}, 6) AS gamma FROM tpx JOIN v8 g USING (img, y, x) GROUP BY img, "row", col', PX, EIGHT)
def gamma_lut(spark, sf_dir):
    return rounded(preprocess.gammas(tiling.assign(preprocess.to_8bit(events(spark, sf_dir)), SPEC)), "gamma")


@register(f"""SELECT t.img, t."row", t.col, ty, tx, CAST(floor(pow(v8.v / 255, 1 / gamma) * 255) AS INTEGER) AS v FROM tpx t JOIN v8 USING (img, y, x)
JOIN (SELECT img, "row", col, {GAMMA} AS gamma FROM tpx JOIN v8 g USING (img, y, x) GROUP BY img, "row", col) c USING (img, "row", col)""", PX, EIGHT)
def gamma_corrected(spark, sf_dir):
    return preprocess.gamma_correct(tiling.assign(preprocess.to_8bit(events(spark, sf_dir)), SPEC)).select("img", "row", "col", "ty", "tx", "v")


@register(f"SELECT img, round(avg(CASE WHEN v > {BRIGHT} THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS percent FROM px GROUP BY img", PX)
def binary_mask_coverage(spark, sf_dir):
    return rounded(preprocess.coverage(events(spark, sf_dir), F.col("v") > BRIGHT), "percent")


@register("""SELECT t.img, t."row", t.col, CAST(coalesce(sum(coalesce(m, 0)) OVER (PARTITION BY t.img ORDER BY t."row", t.col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM tiles t LEFT JOIN (SELECT img, "row", col, max(label) AS m FROM tl GROUP BY ALL) USING (img, "row", col)""", PX, TL)
def relabel_offsets(spark, sf_dir):
    px = events(spark, sf_dir)
    return merge.relabel_offsets(labelled(px), tiles_of(px))


@register("SELECT * FROM ids", PX, TL, FLAGS, IDS)
def reassign_ids(spark, sf_dir):
    px = events(spark, sf_dir)
    return merge.reassign_ids(labelled(px).select("img", "row", "col", "label").distinct(), tiles_of(px))


PAIRS = """SELECT a.img, 'right' AS axis, a."row" AS r1, a.col AS c1, b."row" AS r2, b.col AS c2 FROM tiles a JOIN tiles b ON a.img = b.img AND a."row" = b."row" AND a.col + 1 = b.col
UNION ALL SELECT a.img, 'down', a."row", a.col, b."row", b.col FROM tiles a JOIN tiles b ON a.img = b.img AND a."row" + 1 = b."row" AND a.col = b.col"""


@register(PAIRS, PX)
def neighbour_pairs(spark, sf_dir):
    return tiling.neighbour_pairs(tiles_of(events(spark, sf_dir)), SPEC)


@register("SELECT * FROM fl", PX, TL, FLAGS)
def object_band_flags(spark, sf_dir):
    return flags_of(events(spark, sf_dir))


def pair_sql(axis: str, near: str, far: str) -> str:
    return f"""SELECT p.*, coalesce(a.n, 0) AS n1, coalesce(b.n, 0) AS n2, coalesce(a.b, 0) AS b1, coalesce(a.d, 0) AS d1, coalesce(b.b, 0) AS b2, coalesce(b.d, 0) AS d2, coalesce(a.s, 0) + coalesce(b.s, 0) > 0 AS met
    FROM pairs p LEFT JOIN (SELECT img, "row", col, count(*) AS n, count(*) FILTER (b_{near}) AS b, count(*) FILTER (d_{near}) AS d, count(*) FILTER (s_{near}) AS s FROM fl GROUP BY ALL) a ON a.img = p.img AND a."row" = r1 AND a.col = c1
    LEFT JOIN (SELECT img, "row", col, count(*) AS n, count(*) FILTER (b_{far}) AS b, count(*) FILTER (d_{far}) AS d, count(*) FILTER (s_{far}) AS s FROM fl GROUP BY ALL) b ON b.img = p.img AND b."row" = r2 AND b.col = c2 WHERE axis = '{axis}'"""


MET = f"pairs AS ({PAIRS}), pm AS ({pair_sql('right', 'right', 'left')} UNION ALL {pair_sql('down', 'down', 'up')})"
PRIORITY = "CASE WHEN NOT met THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS priority"


@register(f"SELECT img, axis, r1, c1, r2, c2, n1, n2, {PRIORITY} FROM pm", PX, TL, FLAGS, MET)
def tile_priority(spark, sf_dir):
    px = events(spark, sf_dir)
    return merge.merge_pairs(flags_of(px), tiling.neighbour_pairs(tiles_of(px), SPEC)).drop("lost1", "lost2")


@register(f"""SELECT img, axis, r1, c1, r2, c2, n1, n2, {PRIORITY}, CAST(CASE WHEN NOT met THEN 0 WHEN n1 >= n2 THEN b1 ELSE d1 END AS BIGINT) AS lost1,
CAST(CASE WHEN NOT met THEN 0 WHEN n1 >= n2 THEN d2 ELSE b2 END AS BIGINT) AS lost2 FROM pm""", PX, TL, FLAGS, MET)
def merge_pair_4step(spark, sf_dir):
    px = events(spark, sf_dir)
    return merge.merge_pairs(flags_of(px), tiling.neighbour_pairs(tiles_of(px), SPEC))


@register('SELECT img, "row", col, label FROM f_p2', PX, TL, FLAGS, MERGED)
def merge_two_phase(spark, sf_dir):
    return merged(events(spark, sf_dir)).select("img", "row", "col", "label")


@register("SELECT * FROM lp", PX, TL, FLAGS, IDS, MERGED, ASSEMBLED)
def assemble_first_wins(spark, sf_dir):
    return assembled(events(spark, sf_dir))


@register('SELECT img, y, x, arg_max(label, ("row", col, label)) AS label FROM tl GROUP BY img, y, x', PX, TL)
def raw_combine_last_wins(spark, sf_dir):
    return merge.combine_raw(labelled(events(spark, sf_dir)), SPEC)


@register("""SELECT img, y, x, label FROM tl JOIN (
  SELECT img, y, x, max(("row", col)) AS last FROM tpx JOIN (SELECT DISTINCT img, "row", col FROM tl) USING (img, "row", col) GROUP BY img, y, x
) USING (img, y, x) WHERE ("row", col) = last""", PX, TL)
def raw_combine_windows(spark, sf_dir):
    px = events(spark, sf_dir)
    return merge.combine_raw_windows(labelled(px), tiles_of(px), SPEC)


ALL = (PX, TL, FLAGS, IDS, MERGED, ASSEMBLED, MEASURED)


@register("SELECT * FROM box", *ALL)
def object_area_bbox(spark, sf_dir):
    return metrics.area_bbox(assembled(events(spark, sf_dir)))


@register("SELECT img, label, round(major_axis_length, 6) AS major_axis_length, round(minor_axis_length, 6) AS minor_axis_length, round(eccentricity, 6) AS eccentricity FROM mom", *ALL)
def object_moments(spark, sf_dir):
    return rounded(metrics.moments(assembled(events(spark, sf_dir))), "major_axis_length", "minor_axis_length", "eccentricity")


@register("SELECT img, label, round(perimeter, 6) AS perimeter FROM per", *ALL)
def object_perimeter(spark, sf_dir):
    return rounded(metrics.perimeter(assembled(events(spark, sf_dir))), "perimeter")


@register("SELECT img, label, area, round(circularity, 6) AS circularity FROM met", *ALL)
def object_circularity(spark, sf_dir):
    return rounded(measured(events(spark, sf_dir)).select("img", "label", "area", "circularity"), "circularity")


@register("SELECT img, label, border_touch FROM met", *ALL)
def border_touch(spark, sf_dir):
    px = events(spark, sf_dir)
    return metrics.border_touch(metrics.area_bbox(assembled(px)), tiling.extents(px)).select("img", "label", "border_touch")


@register("SELECT img, label, round(avg(v), 6) AS mean_intensity FROM lp JOIN px USING (img, y, x) GROUP BY img, label", *ALL)
def mean_intensity(spark, sf_dir):
    px = events(spark, sf_dir)
    return rounded(metrics.mean_intensity(assembled(px), px), "mean_intensity")


@register("SELECT img, label, passed FROM pass", *ALL)
def apply_thresholds(spark, sf_dir):
    return filters.flagged(measured(events(spark, sf_dir)), LIMITS).select("img", "label", "passed")


@register('SELECT img, label AS old, row_number() OVER (PARTITION BY img ORDER BY label) AS "new" FROM pass WHERE passed', *ALL)
def renumber_survivors(spark, sf_dir):
    return filters.renumbered(filters.flagged(measured(events(spark, sf_dir)), LIMITS))


@register("SELECT img, count(*) AS original, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(count(*) FILTER (passed) / count(*), 6) AS retention FROM pass GROUP BY img", *ALL)
def retention_stats(spark, sf_dir):
    return rounded(filters.retention(filters.flagged(measured(events(spark, sf_dir)), LIMITS)), "retention")


@register("""SELECT img, count(DISTINCT label) AS objects, count(*) AS object_pixels, round(100 * count(*) / any_value(h * w), 6) AS coverage, round(count(DISTINCT label) * 1000000 / any_value(h * w), 6) AS per_mm2,
round(count(*) / count(DISTINCT label), 6) AS mean_size, round(count(DISTINCT label) / any_value(n), 6) AS per_tile FROM lp JOIN ext USING (img) JOIN (SELECT img, count(*) AS n FROM tiles GROUP BY img) USING (img) GROUP BY img""", *ALL)
def merge_statistics(spark, sf_dir):
    px = events(spark, sf_dir)
    return rounded(filters.merge_statistics(assembled(px), tiling.extents(px), tiles_of(px)), "coverage", "per_mm2", "mean_size", "per_tile")


LUT = ", ".join(f"CAST(concat('0x', substr(sha256(CAST(label AS VARCHAR)), {2 * k + 1}, 2)) AS INTEGER) AS {c}" for k, c in enumerate("rgb"))


@register(f"""SELECT img, y, x, {", ".join(f"CAST(CASE WHEN lit THEN floor(least(greatest(v * 0.5::DOUBLE + coalesce({c}, 0) * 0.5::DOUBLE, 0), 255)) ELSE v END AS INTEGER) AS {c}" for c in "rgb")} FROM (
  SELECT v8.*, l.*  EXCLUDE (img, y, x), max(coalesce(label, 0)) OVER (PARTITION BY v8.img, v8.y // 32, v8.x // 32) > 0 AS lit
  FROM v8 LEFT JOIN (SELECT *, {LUT} FROM lp) l ON l.img = v8.img AND l.y = v8.y AND l.x = v8.x)""", *ALL[:-1], EIGHT)
def label_lut_blend(spark, sf_dir):
    px = events(spark, sf_dir)
    return render.blend(preprocess.to_8bit(px), assembled(px), 0.5, 32)


@register("""SELECT img, y0, y1, x0, x1, round(mean, 6) AS mean FROM (
  SELECT *, row_number() OVER (PARTITION BY img ORDER BY mean DESC, k) AS best FROM (
    SELECT px.img, k, y0, y1, x0, x1, avg(v) AS mean FROM px JOIN (
      SELECT img, k, y0, CAST(least(h, y0 + 32) AS INTEGER) AS y1, x0, CAST(least(w, x0 + 32) AS INTEGER) AS x1 FROM (
        SELECT img, h, w, k, CAST(CASE WHEN h <= 32 AND w <= 32 THEN 0 ELSE greatest(0, cy - 16) END AS INTEGER) AS y0, CAST(CASE WHEN h <= 32 AND w <= 32 THEN 0 ELSE greatest(0, cx - 16) END AS INTEGER) AS x0
        FROM (SELECT *, unnest([(0, floor(h * 0.5::DOUBLE), floor(w * 0.66::DOUBLE)), (1, h // 2, w // 2), (2, h // 4, w // 4), (3, h // 4, 3 * w // 4), (4, 3 * h // 4, w // 4),
          (5, 3 * h // 4, 3 * w // 4), (6, h // 2, w // 4), (7, h // 2, 3 * w // 4), (8, h // 4, w // 2), (9, 3 * h // 4, w // 2)]) AS c FROM ext), LATERAL (SELECT c[1] AS k, c[2] AS cy, c[3] AS cx))
    ) c ON c.img = px.img AND y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY ALL)) WHERE best = 1""", PX)
def crop_choice_top1(spark, sf_dir):
    px = events(spark, sf_dir)
    return rounded(render.best_crop(px, tiling.extents(px), 32), "mean")


@register("""SELECT img, CAST(CASE WHEN fits THEN 0 ELSE greatest(0, h // 2 - 40) END AS INTEGER) AS y0, CAST(CASE WHEN fits THEN h ELSE least(h, h // 2 + 40) END AS INTEGER) AS y1,
CAST(CASE WHEN fits THEN 0 ELSE greatest(0, w // 2 - 40) END AS INTEGER) AS x0, CAST(CASE WHEN fits THEN w ELSE least(w, w // 2 + 40) END AS INTEGER) AS x1 FROM (SELECT *, h <= 80 AND w <= 80 AS fits FROM ext)""", PX)
def centre_crop(spark, sf_dir):
    return render.centre_crop(tiling.extents(events(spark, sf_dir)), 80)


def sha_byte(text: str, k: int) -> str:
    return f"CAST(concat('0x', substr(sha256({text}), {2 * k + 1}, 2)) AS INTEGER)"


def tile_colour_sql(pick: str, first: int) -> str:
    place = "concat_ws('_', \"row\", col)"
    palette = "[[255, 100, 100], [100, 255, 100], [100, 100, 255], [255, 255, 100], [255, 100, 255], [100, 255, 255], [255, 150, 100], [150, 100, 255], [255, 100, 150], [150, 255, 100]]"
    return f'SELECT img, "row", col, ' + ", ".join(f"CAST(least(greatest({palette}[{pick} + 1][{k + 1}] + {sha_byte(place, first + k)} % 60 - 30, 100), 255) AS INTEGER) AS {c}" for k, c in enumerate("rgb")) + " FROM tiles"


PLACED = sha_byte("concat_ws('_', \"row\", col)", 0)


@register(tile_colour_sql(f"{PLACED} % 10", 1), PX)
def tile_colours(spark, sf_dir):
    return render.tile_colours(tiles_of(events(spark, sf_dir)))


@register(tile_colour_sql('(7 * "row" + 11 * col) % 10', 0), PX)
def tile_colours_by_place(spark, sf_dir):
    return render.tile_colours(tiles_of(events(spark, sf_dir)), by_place=True)


LAID = "floor(least(greatest(a * (1 - 0.6::DOUBLE) + o * 0.6::DOUBLE, 0), 255))"


@register(f"""SELECT img, y, x, {", ".join(f"CAST(list_reduce({c}, lambda a, o: {LAID}, CAST(v AS DOUBLE)) AS INTEGER) AS {c}" for c in "rgb")} FROM (
  SELECT v8.img, v8.y, v8.x, any_value(v8.v) AS v, {", ".join(f'coalesce(list(CAST({c} AS DOUBLE) ORDER BY "row", col) FILTER ({c} IS NOT NULL), []) AS {c}' for c in "rgb")}
  FROM v8 LEFT JOIN (SELECT * FROM tl JOIN colours USING (img, "row", col)) t ON t.img = v8.img AND t.y = v8.y AND t.x = v8.x GROUP BY ALL)""", PX, TL, EIGHT, f'colours AS ({tile_colour_sql(f"{PLACED} % 10", 1)})')
def overlay_before_merge(spark, sf_dir):
    px = events(spark, sf_dir)
    placed = merge.combine_raw_candidates(labelled(px), SPEC)
    return render.tile_overlay(preprocess.to_8bit(px), placed, tiles_of(px))


BRIGHTS = ", ".join(f"CAST(floor((v - v * s * greatest(0, least(({n} + 6 * hue) % 6, 4 - ({n} + 6 * hue) % 6, 1))) * 255) AS INTEGER) AS {c}" for c, n in zip("rgb", (5, 3, 1), strict=True))
OBJECTS = "oc AS MATERIALIZED (SELECT img, label, " + BRIGHTS + " FROM (SELECT DISTINCT img, label, {} / 256 AS hue, 0.7::DOUBLE + 0.3::DOUBLE * ({} / 256) AS s, 0.8::DOUBLE + 0.2::DOUBLE * ({} / 256) AS v FROM lp))".format(*(sha_byte("concat('object/', label)", k) for k in range(3)))


@register(f"""SELECT v8.img, v8.y, v8.x, {", ".join(f"CAST(CASE WHEN label IS NULL THEN v ELSE floor(least(greatest(v * (1 - 0.6::DOUBLE) + {c} * 0.6::DOUBLE, 0), 255)) END AS INTEGER) AS {c}" for c in "rgb")}
FROM v8 LEFT JOIN (SELECT * FROM lp JOIN oc USING (img, label)) o ON o.img = v8.img AND o.y = v8.y AND o.x = v8.x""", *ALL[:-1], EIGHT, OBJECTS)
def overlay_after_merge(spark, sf_dir):
    px = events(spark, sf_dir)
    return render.object_overlay(preprocess.to_8bit(px), assembled(px))


@register("""SELECT img, objects_in, objects_out, round(100 * objects_out / objects_in, 6) AS percent FROM (SELECT img, count(DISTINCT ("row", col, label)) AS objects_in FROM tl GROUP BY img)
JOIN (SELECT img, count(DISTINCT label) AS objects_out FROM lp GROUP BY img) USING (img)""", *ALL[:-1])
def merge_efficiency(spark, sf_dir):
    px = events(spark, sf_dir)
    return rounded(filters.merge_efficiency(labelled(px), assembled(px)), "percent")


@register("""SELECT img, round(avg(d), 6) AS mean, round(min(d), 6) AS least, round(max(d), 6) AS most, round(100 * stddev_pop(d) / avg(d), 6) AS cv
FROM (SELECT img, 2 * sqrt(area / pi()) AS d FROM box) GROUP BY img""", *ALL)
def diameter_summary(spark, sf_dir):
    return rounded(filters.diameter_summary(metrics.area_bbox(assembled(events(spark, sf_dir)))), "mean", "least", "most", "cv")


@register("""SELECT img, n, least, most, round(mean, 6) AS mean, coalesce(objects, 0) AS objects FROM (SELECT img, count(*) AS n, min(v) AS least, max(v) AS most, avg(v) AS mean FROM px GROUP BY img)
LEFT JOIN (SELECT img, count(DISTINCT label) AS objects FROM lp GROUP BY img) USING (img)""", *ALL[:-1])
def scan_stats(spark, sf_dir):
    px = events(spark, sf_dir)
    return rounded(preprocess.scan_stats(px, tiling.within(assembled(px), tiling.extents(px))), "mean")


@register("""SELECT img, y, x, v FROM px WHERE img IN (SELECT img FROM px WHERE v > 50000) UNION ALL SELECT img, y, x, v FROM v8 WHERE img NOT IN (SELECT img FROM px WHERE v > 50000)""", PX, EIGHT)
def background_fallback(spark, sf_dir):
    px = events(spark, sf_dir)
    bright = px.join(px.where("v > 50000").select("img").distinct(), "img", "left_semi")
    return render.background([bright, preprocess.to_8bit(px)], tiling.extents(px))


RAMP = "CASE WHEN {0} < 6 THEN {0} / 6 WHEN {0} >= 14 THEN (20 - {0}) / 6 ELSE 1 END"


@register(f'SELECT img, "row", col, round(sum(({RAMP.format("ty")}) * ({RAMP.format("tx")}) * v), 3) AS weighted FROM tpx WHERE h = 20 AND w = 20 GROUP BY img, "row", col', PX)
def feather_weights(spark, sf_dir):
    px = events(spark, sf_dir)
    whole = tiles_of(px).where("y1 - y0 = 20 and x1 - x0 = 20").select("img", "row", "col")
    weight = tiling.feather(20, 20, 6)
    return tiling.assign(px, SPEC).join(whole, ["img", "row", "col"]).groupBy("img", "row", "col").agg(F.round(F.sum(weight * F.col("v")), 3).alias("weighted"))


@register("SELECT img, h > 400 OR w > 400 AS tiled FROM ext", PX)
def auto_tiling(spark, sf_dir):
    return tiling.needs_tiles(tiling.extents(events(spark, sf_dir)), 400)


def around(name: str, axis: str, step: str, other: str) -> str:
    along = "img, y ORDER BY x" if axis == "x" else "img, x ORDER BY y"
    return f"coalesce({step}({name}) OVER (PARTITION BY {along}), {other})"


GRADIENTS = f"""g1 AS (SELECT img, y, x, {around("v", "x", "lead", "v")} - {around("v", "x", "lag", "v")} AS d, {around("v", "x", "lag", "v")} + 2 * v + {around("v", "x", "lead", "v")} AS s FROM v8
), g2 AS (SELECT img, y, x, {around("d", "y", "lag", "d")} + 2 * d + {around("d", "y", "lead", "d")} AS gx, {around("s", "y", "lead", "s")} - {around("s", "y", "lag", "s")} AS gy FROM g1
), g3 AS (SELECT *, abs(gx) + abs(gy) AS size FROM g2), g4 AS (SELECT *, {around("size", "x", "lag", "0")} AS l, {around("size", "x", "lead", "0")} AS r FROM g3
), g5 AS (SELECT *, {", ".join(f'{around(n, "y", step, "0")} AS {short}_{n}' for n in ("l", "size", "r") for step, short in (("lag", "up"), ("lead", "dn")))} FROM g4
), ridge AS MATERIALIZED (SELECT img, y, x, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, CAST(size AS INTEGER) AS size, CASE WHEN abs(gy) < abs(gx) * tan(pi() / 8) THEN size > l AND size >= r
  WHEN abs(gy) > abs(gx) * tan(3 * pi() / 8) THEN size > up_size AND size >= dn_size WHEN gx * gy >= 0 THEN size > up_l AND size > dn_r ELSE size > up_r AND size > dn_l END AS thin FROM g5)"""


@register("SELECT * FROM ridge", PX, EIGHT, GRADIENTS)
def edge_gradients(spark, sf_dir):
    return refine.gradients(preprocess.to_8bit(events(spark, sf_dir)))


@register('SELECT img, y, x, arg_max(label, ("row", col)) AS label FROM tl WHERE y BETWEEN 5 AND 44 AND x BETWEEN 10 AND 69 GROUP BY img, y, x', PX, TL)
def region_read(spark, sf_dir):
    px = events(spark, sf_dir)
    at = merge.combine_raw_candidates(labelled(px), SPEC)
    return tiling.region(at, 5, 45, 10, 70)


@register("SELECT img, max(label) AS most FROM tl GROUP BY img", PX, TL)
def max_label(spark, sf_dir):
    return labelled(events(spark, sf_dir)).groupBy("img").agg(F.max("label").alias("most"))


@register(f"""SELECT img, y, x, (SELECT min(b) FROM reach r WHERE r.img = p.img AND r.a = p.y * 100 + p.x) AS component FROM fg p""", PX,
    f"fg AS MATERIALIZED (SELECT img, y, x FROM px WHERE v > {SPARSE})",
    """reach AS (SELECT img, CAST(y * 100 + x AS BIGINT) AS a, CAST(y * 100 + x AS BIGINT) AS b FROM fg
    UNION SELECT r.img, r.a, CAST(q.y * 100 + q.x AS BIGINT) FROM reach r JOIN fg q ON q.img = r.img AND abs(q.y - r.b // 100) <= 1 AND abs(q.x - r.b % 100) <= 1)""")
def connected_components(spark, sf_dir):
    return post.pixel_components(events(spark, sf_dir).where(F.col("v") > SPARSE).select("img", "y", "x"), 100)


@register("SELECT 'v' AS img, CAST(vec_id // 16 AS INTEGER) AS \"row\", CAST(i // 16 AS INTEGER) AS col, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS least, max(v) AS most FROM (SELECT vec_id, i - 1 AS i, CAST(floor((CAST(embedding[i] AS DOUBLE) + 0.6) * 50000) AS INTEGER) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)) GROUP BY ALL")
def embedding_tile_stats(spark, sf_dir):
    px = rasters.raster_from_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rounded(preprocess.tile_stats(tiling.assign(px, TileSpec(16, 16))), "mean", "std")


SHAPES = """ends AS MATERIALIZED (
  SELECT DISTINCT img, label, py, unnest([min(px), max(px)]) AS px FROM (
    SELECT img, label, 2 * y + dy AS py, 2 * x + dx AS px FROM lp, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dy, dx)) GROUP BY img, label, py
), sides AS MATERIALIZED (
  SELECT a.img, a.label, a.py AS ay, a.px AS ax, b.py AS ey, b.px AS ex FROM ends a JOIN ends b ON a.img = b.img AND a.label = b.label AND (a.py <> b.py OR a.px <> b.px)
  JOIN ends c ON c.img = a.img AND c.label = a.label GROUP BY ALL HAVING min((b.py - a.py) * (c.px - a.px) - (b.px - a.px) * (c.py - a.py)) >= 0
), frame AS MATERIALIZED (
  SELECT f.*, p.y IS NOT NULL AS own FROM (SELECT *, unnest(range(bbox_1 - 1, bbox_3 + 1)) AS x FROM (SELECT *, unnest(range(bbox_0 - 1, bbox_2 + 1)) AS y FROM box)) f
  LEFT JOIN lp p ON p.img = f.img AND p.label = f.label AND p.y = f.y AND p.x = f.x
), convex AS (
  SELECT img, label, count(*) AS convex_area FROM (
    SELECT f.img, f.label, y, x FROM frame f JOIN sides s ON s.img = f.img AND s.label = f.label
    WHERE y >= bbox_0 AND y < bbox_2 AND x >= bbox_1 AND x < bbox_3 GROUP BY ALL HAVING min((ey - ay) * (2 * x - ax) - (ex - ax) * (2 * y - ay)) >= 0) GROUP BY ALL
), air AS (
  SELECT img, label, bbox_0 - 1 AS y, bbox_1 - 1 AS x FROM box
  UNION SELECT f.img, f.label, f.y, f.x FROM air r JOIN frame f ON f.img = r.img AND f.label = r.label AND NOT f.own AND abs(f.y - r.y) + abs(f.x - r.x) = 1
), filled AS (SELECT img, label, (bbox_2 - bbox_0 + 2) * (bbox_3 - bbox_1 + 2) - count(*) AS filled_area FROM air JOIN box USING (img, label) GROUP BY img, label, bbox_0, bbox_1, bbox_2, bbox_3
), shaped AS MATERIALIZED (
  SELECT img, label, CAST(filled_area AS BIGINT) AS filled_area, area / convex_area AS solidity, (filled_area - area) / area AS hole_fraction FROM box JOIN convex USING (img, label) JOIN filled USING (img, label)
)"""
SHAPE_LIMITS = Thresholds(min_solidity=0.8, max_hole_fraction=0.1, min_mean_intensity=4000, max_eccentricity=0.95)


def shaped(px: DataFrame) -> DataFrame:
    return metrics.measure(assembled(px), tiling.extents(px), px)


@register("SELECT img, label, filled_area, round(solidity, 6) AS solidity, round(hole_fraction, 6) AS hole_fraction FROM shaped", *ALL, SHAPES)
def object_shape(spark, sf_dir):
    return rounded(shaped(events(spark, sf_dir)).select("img", "label", "filled_area", "solidity", "hole_fraction"), "solidity", "hole_fraction")


@register("""SELECT img, label, coalesce(solidity >= 0.8 AND hole_fraction <= 0.1 AND mean >= 4000 AND eccentricity <= 0.95 AND aspect_ratio >= 0 AND circularity >= 0, false) AS passed
FROM shaped JOIN met USING (img, label) JOIN (SELECT img, label, avg(v) AS mean FROM lp JOIN px USING (img, y, x) GROUP BY img, label) USING (img, label)""", *ALL, SHAPES)
def apply_shape_thresholds(spark, sf_dir):
    return filters.flagged(shaped(events(spark, sf_dir)), SHAPE_LIMITS).select("img", "label", "passed")


@register("""SELECT img, y, x, CAST(least(greatest(round(round(sum(weight * (upto + extra * (v + 1)) * 255 / total), 6)), 0), 255) AS INTEGER) AS v FROM (
  SELECT s.img, s.y, s.x, s.v, CAST(least(greatest(floor(fy - 0.5::DOUBLE) + i, 0), ny - 1) AS INTEGER) AS cy, CAST(least(greatest(floor(fx - 0.5::DOUBLE) + j, 0), nx - 1) AS INTEGER) AS cx,
    (CASE i WHEN 1 THEN fy - 0.5::DOUBLE - floor(fy - 0.5::DOUBLE) ELSE 1 - (fy - 0.5::DOUBLE - floor(fy - 0.5::DOUBLE)) END)
      * (CASE j WHEN 1 THEN fx - 0.5::DOUBLE - floor(fx - 0.5::DOUBLE) ELSE 1 - (fx - 0.5::DOUBLE - floor(fx - 0.5::DOUBLE)) END) AS weight
  FROM placed s, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) n JOIN lut USING (img, cy, cx, v) GROUP BY img, y, x""", PX, EIGHT, """placed AS MATERIALIZED (
  SELECT *, (y + 0.5::DOUBLE) * ny / h AS fy, (x + 0.5::DOUBLE) * nx / w AS fx FROM (SELECT v8.*, h, w, greatest(1, least(8, h // 32)) AS ny, greatest(1, least(8, w // 32)) AS nx FROM v8 JOIN ext USING (img))
), hist AS (SELECT img, CAST(floor(fy) AS INTEGER) AS cy, CAST(floor(fx) AS INTEGER) AS cx, v, count(*) AS n FROM placed GROUP BY ALL
), cell AS (SELECT img, cy, cx, sum(n) AS total, greatest(1.0::DOUBLE, 2.0::DOUBLE * sum(n) / 256) AS most FROM hist GROUP BY ALL
), spare AS (SELECT img, cy, cx, total, most, sum(greatest(n - most, 0)) / 256 AS extra FROM hist JOIN cell USING (img, cy, cx) GROUP BY ALL
), lut AS MATERIALIZED (
  SELECT img, cy, cx, e.v, total, extra, sum(CASE WHEN n IS NULL THEN 0 ELSE least(CAST(n AS DOUBLE), most) END) OVER (PARTITION BY img, cy, cx ORDER BY e.v) AS upto
  FROM (SELECT *, unnest(range(256)) AS v FROM spare) e LEFT JOIN hist USING (img, cy, cx, v)
)""")
def local_equalisation(spark, sf_dir):
    return preprocess.equalise(preprocess.to_8bit(events(spark, sf_dir)))


@register("""SELECT img, CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, CAST(round(round(sum(weight * v), 6)) AS INTEGER) AS v FROM (
  SELECT t.img, ty, tx, CAST(least(greatest(floor(sy) + i, 0), h - 1) AS INTEGER) AS y, CAST(least(greatest(floor(sx) + j, 0), w - 1) AS INTEGER) AS x,
    (CASE i WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE j WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS weight
  FROM (SELECT img, h, w, ty, tx, (ty + 0.5::DOUBLE) * h / th - 0.5::DOUBLE AS sy, (tx + 0.5::DOUBLE) * w / tw - 0.5::DOUBLE AS sx FROM (
    SELECT *, unnest(range(0, tw)) AS tx FROM (SELECT *, unnest(range(0, th)) AS ty FROM (SELECT img, h, w, CAST(round(h * 1.5::DOUBLE) AS INTEGER) AS th, CAST(round(w * 1.5::DOUBLE) AS INTEGER) AS tw FROM ext)))) t,
  (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) c JOIN px USING (img, y, x) GROUP BY img, ty, tx""", PX)
def upscale(spark, sf_dir):
    return preprocess.upscale(events(spark, sf_dir), 1.5)


@register(f"""SELECT v8.img, v8.y, v8.x, {", ".join(f"CAST(CASE WHEN passed IS NULL THEN v ELSE floor(least(greatest(v * (1 - 0.35::DOUBLE) + {over} * 0.35::DOUBLE, 0), 255)) END AS INTEGER) AS {c}" for c, over in (("r", "(CASE WHEN passed THEN 0 ELSE 255 END)"), ("g", "(CASE WHEN passed THEN 255 ELSE 0 END)"), ("b", "0")))}
FROM v8 LEFT JOIN (SELECT lp.img, lp.y, lp.x, passed FROM lp JOIN pass USING (img, label)) o ON o.img = v8.img AND o.y = v8.y AND o.x = v8.x""", *ALL, EIGHT)
def verdict_overlay(spark, sf_dir):
    px = events(spark, sf_dir)
    return render.verdict_overlay(preprocess.to_8bit(px), assembled(px), filters.flagged(measured(px), LIMITS))


WAISTS = """large AS MATERIALIZED (SELECT lp.* FROM lp SEMI JOIN (SELECT img, label FROM lp GROUP BY ALL HAVING count(*) > 12) USING (img, label)
), deep AS MATERIALIZED (
  SELECT p.img, p.label, p.y, p.x, min((p.y - f.y) * (p.y - f.y) + (p.x - f.x) * (p.x - f.x)) AS d FROM large p JOIN frame f ON f.img = p.img AND f.label = p.label AND NOT f.own GROUP BY ALL
), best AS MATERIALIZED (
  SELECT p.img, p.label, p.y, p.x, arg_max({'y': q.y, 'x': q.x}, (q.d, -q.y, -q.x)) AS b FROM deep p JOIN deep q ON q.img = p.img AND q.label = p.label AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL
), climb AS (
  SELECT img, label, y, x, y AS ty, x AS tx FROM deep
  UNION SELECT c.img, c.label, c.y, c.x, b.y, b.x FROM climb c JOIN best e ON e.img = c.img AND e.label = c.label AND e.y = c.ty AND e.x = c.tx
), parts AS (
  SELECT c.img, c.label, c.y, c.x, ty, tx FROM climb c JOIN best e ON e.img = c.img AND e.label = c.label AND e.y = ty AND e.x = tx WHERE e.b.y = ty AND e.b.x = tx
  UNION ALL SELECT img, label, y, x, 0, 0 FROM lp ANTI JOIN large USING (img, label)
)"""


@register("SELECT img, y, x, dense_rank() OVER (PARTITION BY img ORDER BY label, ty, tx) AS label FROM parts", *ALL, SHAPES, WAISTS)
def split_at_waists(spark, sf_dir):
    """Objects of more than 12 pixels split where they are narrow."""
    return refine.split_at_waists(assembled(events(spark, sf_dir)), 12)


def tile_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of tile masks, written from the labelled tiles."""
    px, path = events(spark, sf_dir), post.scratch(spark)
    tiles.write(labelled(px), tiles_of(px), path, SPEC)
    return path


@register('SELECT img, "row", col, CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, label FROM tl WHERE col = 2 AND "row" BETWEEN 1 AND 4', PX, TL)
def tile_folder_read(spark, sf_dir):
    """Tiles read back from their files; only the files of these rows and of this column are opened."""
    return tiles.read(spark, tile_folder(spark, sf_dir), SPEC).where("col = 2 and row between 1 and 4")


@register('SELECT img, "row", col, count(DISTINCT label) AS objects FROM tiles LEFT JOIN tl USING (img, "row", col) GROUP BY ALL', PX, TL)
def tile_folder_objects(spark, sf_dir):
    """The number of objects in each tile's file, as the sink counted them."""
    return tiles.listed(spark, tile_folder(spark, sf_dir)).select("img", "row", "col", "objects")


@register("SELECT img, y, x, v FROM px WHERE y BETWEEN 13 AND 57 AND x >= 20", PX)
def slide_bands_read(spark, sf_dir):
    """Images written in bands of 16 lines and read back; strips of other lines are not read."""
    px, path = events(spark, sf_dir), post.scratch(spark)
    slides.write(px, tiling.extents(px), path, band=16, lines=4, dtype="int32")
    return slides.read(spark, path).where("y between 13 and 57 and x >= 20")


@register("""SELECT b.img, label, "row", col, CAST(greatest(bbox_0, y0) AS INTEGER) AS y0, CAST(least(bbox_2, y1) AS INTEGER) AS y1, CAST(greatest(bbox_1, x0) AS INTEGER) AS x0, CAST(least(bbox_3, x1) AS INTEGER) AS x1
FROM box b JOIN tiles t ON t.img = b.img AND y0 < bbox_2 AND y1 > bbox_0 AND x0 < bbox_3 AND x1 > bbox_1""", *ALL)
def boxes_on_tiles(spark, sf_dir):
    """The tiles that each object's box meets, and what they share."""
    px = events(spark, sf_dir)
    boxes = metrics.area_bbox(assembled(px)).selectExpr("img", "label", "bbox_0 as y0", "bbox_2 as y1", "bbox_1 as x0", "bbox_3 as x1")
    return tiling.meeting(boxes, tiles_of(px), 16)


@register("""SELECT img, any_value(n) AS tiles, count(DISTINCT ("row", col, label)) AS objects, round(count(DISTINCT ("row", col, label)) / any_value(n), 6) AS per_tile, round(count(DISTINCT ("row", col, label)) * 1000000 / any_value(h * w), 6) AS per_mm2
FROM ext JOIN (SELECT img, count(*) AS n FROM tiles GROUP BY img) USING (img) JOIN (SELECT img, "row", col, label FROM tl) USING (img) GROUP BY img""", PX, TL)
def segmentation_summary(spark, sf_dir):
    px = events(spark, sf_dir)
    return rounded(filters.segmentation_summary(labelled(px), tiles_of(px), tiling.extents(px)), "per_tile", "per_mm2")


@register("""SELECT img, original, passed, original - passed AS failed, round(coalesce(passed / nullif(original, 0), 0), 6) AS retention FROM (
  SELECT img, count(label) AS original, count(label) FILTER (passed) AS passed FROM ext LEFT JOIN (SELECT * FROM pass WHERE img NOT IN (SELECT min(img) FROM ext)) p USING (img) GROUP BY img)""", *ALL)
def retention_with_an_empty_image(spark, sf_dir):
    """As retention_stats, with the objects of the first image gone: its row is all zeros."""
    px = events(spark, sf_dir)
    extent = tiling.extents(px)
    first = extent.agg(F.min("img").alias("img"))
    flagged = filters.flagged(measured(px), LIMITS).join(F.broadcast(first), "img", "left_anti")
    return rounded(filters.retention(flagged, extent), "retention")


@register("""SELECT t.img, "row", col, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM (
  SELECT *, unnest(range(w)) AS x FROM (SELECT *, unnest(range(h)) AS y FROM (SELECT img, "row", col, y1 - y0 AS h, x1 - x0 AS w FROM tiles) WHERE h > 6 AND w > 6)) t
WHERE (y < 3 OR y >= h - 3 OR x < 3 OR x >= w - 3) AND NOT EXISTS (SELECT 1 FROM tl WHERE tl.img = t.img AND tl."row" = t."row" AND tl.col = t.col AND tl.ty = t.y AND tl.tx = t.x)""", PX, TL)
def tile_edges(spark, sf_dir):
    px = events(spark, sf_dir)
    return tiling.edges(tiles_of(px), labelled(px))


WINDOWS = """win AS MATERIALIZED (
  SELECT img, y, x, v, "row", unnest(CASE WHEN fits THEN [0] ELSE range(greatest(0, CAST(floor((x - 40) / 38::DOUBLE) AS INTEGER) + 1), x // 38 + 1) END) AS col FROM (
    SELECT v8.*, h <= 40 AND w <= 40 AS fits, unnest(CASE WHEN h <= 40 AND w <= 40 THEN [0] ELSE range(greatest(0, CAST(floor((y - 40) / 38::DOUBLE) AS INTEGER) + 1), y // 38 + 1) END) AS "row" FROM v8 JOIN ext USING (img))
)"""


@register(f"""SELECT img, y, x, arg_max(CAST(floor(pow(v / 255, 1 / gamma) * 255) AS INTEGER), ("row", col)) AS v FROM win JOIN (SELECT img, "row", col, {GAMMA} AS gamma FROM win g GROUP BY img, "row", col) USING (img, "row", col) GROUP BY img, y, x""", PX, EIGHT, WINDOWS)
def gamma_in_windows(spark, sf_dir):
    """Gamma by windows of 40 pixels that overlap by 2, as preprocessing has them; the later window holds."""
    return preprocess.merge_tiles_last(preprocess.gamma_correct(tiling.windows(preprocess.to_8bit(events(spark, sf_dir)), 40, 2)))


RANGES = {"area": (0, 50), "circularity": (0, 1), "eccentricity": (0, 1), "aspect_ratio": (1, 5)}
PLOTTED = {"area": (4, 60), "circularity": (0.3, 1), "aspect_ratio": (0, 4)}
HIST = """hist AS MATERIALIZED (
  SELECT img, metric, CASE WHEN v < lo THEN -1 WHEN v > hi THEN 32 ELSE least(31, floor((v - lo) / (hi - lo) * 32)) END AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n, count(*) FILTER (NOT inside) AS excluded FROM (
    SELECT img, 'area' AS metric, CAST(area AS DOUBLE) AS v, 0::DOUBLE AS lo, 50::DOUBLE AS hi, area BETWEEN 4 AND 60 AS inside FROM met
    UNION ALL SELECT img, 'circularity', circularity, 0, 1, circularity BETWEEN 0.3::DOUBLE AND 1 FROM met
    UNION ALL SELECT img, 'eccentricity', eccentricity, 0, 1, true FROM met
    UNION ALL SELECT img, 'aspect_ratio', aspect_ratio, 1, 5, aspect_ratio BETWEEN 0 AND 4 FROM met
  ) WHERE v IS NOT NULL GROUP BY ALL
)"""


@register("SELECT img, metric, CAST(bin AS INTEGER) AS bin, n, excluded FROM hist", *ALL, HIST)
def metric_histograms(spark, sf_dir):
    return plots.histograms(measured(events(spark, sf_dir)), RANGES, PLOTTED, 32)


@register("""SELECT img, metric, round(value, 6) AS value, round(sum(n * k) / any_value(total * width * sqrt(2 * pi())), 6) AS density, round(sum((n - excluded) * k) / any_value(total * width * sqrt(2 * pi())), 6) AS kept FROM (
  SELECT c.*, value, n, excluded, exp(-0.5::DOUBLE * pow((value - x) / width, 2)) AS k FROM (
    SELECT img, metric, total, step, lo, CASE WHEN dev > step * 1e-6::DOUBLE THEN dev * pow(total, -0.2::DOUBLE) ELSE step END AS width FROM (
      SELECT img, metric, sum(n) AS total, any_value(step) AS step, any_value(lo) AS lo, coalesce(sqrt(greatest((sum(n * x * x) - sum(n * x) * sum(n * x) / sum(n)) / nullif(sum(n) - 1, 0), 0)), 0) AS dev FROM cells GROUP BY ALL)
  ) c JOIN cells USING (img, metric), LATERAL (SELECT c.lo + (unnest(range(32)) + 0.5::DOUBLE) * c.step AS value)
) GROUP BY img, metric, value""", *ALL, HIST, "cells AS MATERIALIZED (SELECT *, (hi - lo) / 32 AS step, lo + (bin + 0.5::DOUBLE) * (hi - lo) / 32 AS x FROM hist WHERE bin BETWEEN 0 AND 31)")
def metric_densities(spark, sf_dir):
    hist = plots.histograms(measured(events(spark, sf_dir)), RANGES, PLOTTED, 32)
    return rounded(plots.densities(hist, RANGES, 32), "value", "density", "kept")


def components_sql(name: str, pixels: str) -> str:
    """The least place of the pixels that each pixel is joined to, at sides or corners; a place's name only falls, and only places beside one that fell are looked at again."""
    return f"""n_{name} AS MATERIALIZED (
  SELECT p.img, p.y, p.x, q.y AS ny, q.x AS nx FROM {pixels} p JOIN {pixels} q ON q.img = p.img AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 AND (q.y <> p.y OR q.x <> p.x)
), c_{name}(img, y, x, m) USING KEY (img, y, x) AS (
  SELECT img, y, x, y * 100 + x FROM {pixels}
  UNION SELECT n.img, n.y, n.x, min(c.m) FROM c_{name} c JOIN n_{name} n ON n.img = c.img AND n.ny = c.y AND n.nx = c.x
  JOIN recurring.c_{name} own ON own.img = n.img AND own.y = n.y AND own.x = n.x WHERE c.m < own.m GROUP BY ALL
)"""


EDGES = f"""rg AS MATERIALIZED (SELECT img, y, x, size FROM ridge WHERE thin AND size > 200), {components_sql("rg", "rg")}, edge_px AS MATERIALIZED (
  SELECT img, y, x FROM c_rg SEMI JOIN (SELECT DISTINCT img, m FROM c_rg JOIN rg USING (img, y, x) WHERE size > 600) USING (img, m)
), wide AS MATERIALIZED (SELECT DISTINCT img, y + dy AS y, x + dx AS x FROM edge_px, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)
), rest AS MATERIALIZED (SELECT img, y, x FROM lp ANTI JOIN wide USING (img, y, x)), {components_sql("rest", "rest")}"""


@register("SELECT img, y, x, dense_rank() OVER (PARTITION BY img ORDER BY m) AS label FROM c_rest", *ALL[:-1], EIGHT, GRADIENTS, EDGES)
def parted_at_edges(spark, sf_dir):
    """Objects anew between edges."""
    px = events(spark, sf_dir)
    return refine.parted_at_edges(preprocess.to_8bit(px), assembled(px), 100, 200, 600)
