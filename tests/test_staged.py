"""Settings, the staged run and the command line."""

import pytest

from tessella import cli
from tessella.model import Thresholds, TileSpec
from tessella.operators import tiling
from tessella.plans import filtering, settings, staged
from tessella.sources import rasters

DATA = "/root/testdata/sf0.001"


def test_settings(tmp_path):
    (tmp_path / "a.ini").write_text("[run]\ntile = 20\noverlap = 0.3  # share\ngamma = yes\ncrop = 0,1,0,0.5\n[thresholds]\nmin_pixels = 4\nexclude_border = true\n")
    s = settings.load(str(tmp_path / "a.ini"))
    assert (s.tile, s.spec().overlap, s.gamma, s.crop, s.bright) == (20, 6, True, (0, 1, 0, 0.5), 128)
    assert s.thresholds == Thresholds(min_pixels=4, exclude_border=True)
    settings.snapshot(s, str(tmp_path / "a.json"))
    (tmp_path / "b.ini").write_text("[run]\ntiel = 20\n")
    with pytest.raises(ValueError):
        settings.load(str(tmp_path / "b.ini"))
    with pytest.raises(FileNotFoundError):
        settings.load(str(tmp_path / "c.ini"))
    assert settings.numbers("1, x", (0,)) == (0,)


def test_run_and_resume(spark, tmp_path):
    px = rasters.raster_from_events(spark.read.parquet(f"{DATA}/events.parquet"))
    s = settings.Settings(tile=20, overlap=0.3, bright=60, gamma=True, thresholds=Thresholds(min_pixels=15))
    done = staged.run(px, s, str(tmp_path / "out"))
    assert set(done) == {"prepared", "tile_labels", "raw", "merged", "metrics", "filtered", "stats", "summary", "before", "overlay", "crop_preview", "binary_mask", "figures"}
    seen = {(r.stage, r.figure): r.value for r in done["figures"].collect()}
    assert seen["prepared", "rows"] == px.count() and seen["metrics", "pixels"] == done["merged"].count() and seen["metrics", "kept_pixels"] == done["filtered"].count()
    assert {r.v: r["count"] for r in done["binary_mask"].groupBy("v").count().collect()} == {0: px.count() - done["filtered"].count(), 255: done["filtered"].count()}
    assert done["crop_preview"].count() == px.count() and done["summary"].first().objects == done["tile_labels"].select("row", "col", "label").distinct().count()
    stats = done["stats"].first()
    assert stats.passed == done["filtered"].select("label").distinct().count() == stats.left and stats.failed > 0
    assert done["overlay"].count() == px.count()
    again = staged.run(px.limit(0), s, str(tmp_path / "out"), resume=True)
    assert again["filtered"].count() == done["filtered"].count()

    px.write.parquet(str(tmp_path / "px"))
    cli.main(["filter", str(tmp_path / "out/merged"), str(tmp_path / "px"), str(tmp_path / "f"), "--min-pixels", "15"])
    assert spark.read.parquet(str(tmp_path / "f/filtered")).count() == done["filtered"].count()
    region = ["--region", "10,70,5,60", "--overlay", "--summary", "--intensity", str(tmp_path / "px")]
    cli.main(["filter", str(tmp_path / "out/merged"), str(tmp_path / "px"), str(tmp_path / "g"), "--min-pixels", "15", *region])
    assert 0 < spark.read.parquet(str(tmp_path / "g/filtered")).where("x >= 10 and x < 70 and y >= 5 and y < 60").count() < done["filtered"].count()
    assert spark.read.parquet(str(tmp_path / "g/overlay")).count() == px.count()
    (tmp_path / "s.ini").write_text("[run]\ntile = 20\noverlap = 0.3\n")
    cli.main(["overlay", str(tmp_path / "px"), str(tmp_path / "out/merged"), str(tmp_path / "o")])
    cli.main(["qc", str(tmp_path / "px"), str(tmp_path / "out/tile_labels"), str(tmp_path / "out/merged"), str(tmp_path / "q"), "--settings", str(tmp_path / "s.ini")])
    assert all(spark.read.parquet(str(tmp_path / p)).count() == px.count() for p in ("o", "q/before", "q/after"))


def test_stages_that_do_not_fit():
    whole = {"prepared": {"rows": 9}, "merged": {"rows": 5}, "metrics": {"rows": 2, "pixels": 5, "kept_pixels": 3}, "filtered": {"rows": 3}, "overlay": {"rows": 9}, "before": {"rows": 9}}
    staged.checked(whole)
    staged.checked({"overlay": {"rows": 9}})  # the others were taken up again
    staged.checked(whole | {"merged": {"rows": 0}, "filtered": {"rows": 0}, "metrics": {"rows": 0, "pixels": None, "kept_pixels": None}})
    for name, figures in (("filtered", {"rows": 4}), ("overlay", {"rows": 8}), ("merged", {"rows": 6})):
        with pytest.raises(RuntimeError, match="don't fit"):
            staged.checked(whole | {name: figures})


def test_filter_as_a_call(spark, tmp_path):
    px = rasters.raster_from_events(spark.read.parquet(f"{DATA}/events.parquet"))
    lab = px.where("v > 12000").selectExpr("img", "y", "x", "cast(y div 6 * 100 + x div 6 + 1 as long) as label")
    extent = tiling.extents(px).unionByName(spark.createDataFrame([("none", 4, 4)], "img string, h int, w int"))
    done = filtering.filter_masks(lab, extent, {"min_pixels": 4, "max_pixels": 30, "min_circularity": 0.1, "min_solidity": 0.1, "max_hole_fraction": 1, "tile": 7}, str(tmp_path / "f"), debug=True)
    stats = {r.img: r for r in done.stats.collect()}
    assert (stats["none"].original, stats["none"].retention) == (0, 0.0) and 0 < stats["e0"].passed < stats["e0"].original
    assert done.labels.agg({"label": "max"}).first()[0] == stats["e0"].passed and spark.read.csv(str(tmp_path / "f/metrics_csv"), header=True).count() == stats["e0"].original
    assert filtering.limits_of({}).max_pixels == 3000 and filtering.limits_of({"min_pixels": 3}).min_pixels == 3
    with pytest.raises(ValueError):
        filtering.filter_masks(lab, extent, {"min_pixels": 9, "max_pixels": 3})


def test_run_with_a_loaded_model(spark, tmp_path):
    class Bright:
        def segment(self, tile):
            return (tile > 60).astype(int)

    px = rasters.raster_from_events(spark.read.parquet(f"{DATA}/events.parquet")).where("y < 10")
    done = staged.run(px, settings.Settings(tile=20, overlap=0.3, debug=True, keep_going=True), str(tmp_path / "out"), load=Bright)
    assert done["failed"].count() == 0 and done["tile_labels"].count() == tiling.assign(done["prepared"], TileSpec(20, 20, 6)).where("v > 60").count()
    assert done["debug_flags"].count() == done["tile_labels"].select("row", "col", "label").distinct().count()


def test_paths(tmp_path):
    (tmp_path / "a.tif").touch()
    assert settings.resolve("a.tif", str(tmp_path)) == str(tmp_path / "a.tif") == settings.resolve(str(tmp_path / "a.tif"))
    assert settings.resolve("D:/x/b.tif") == "/mnt/d/x/b.tif" and settings.resolve("hdfs://n/p") == "hdfs://n/p"


def test_one_tile_and_refinement(spark, tmp_path):
    px = rasters.raster_from_events(spark.read.parquet(f"{DATA}/events.parquet")).where("y < 40")
    s = settings.Settings(tiling=False, block=20, bright=60, edges=True, edge_low=300, edge_high=700, split=True, split_area=60, footprint=9)
    done = staged.run(px, s, str(tmp_path / "out"))
    assert done["tile_labels"].select("row", "col").distinct().count() == 1
    assert done["refined"].select("label").distinct().count() > done["merged"].select("label").distinct().count()
    assert done["refined"].join(done["merged"].drop("label"), ["img", "y", "x"], "left_anti").count() == 0


def test_exports():
    import tessella

    assert {name: getattr(tessella, name).__name__ for name in tessella.__all__} == {name: name for name in tessella.__all__}
    with pytest.raises(AttributeError):
        tessella.nothing  # noqa: B018
