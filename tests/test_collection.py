"""Columns of recipes: one plan over many files, against single rasters."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera import api
from tessera.functions import kernels
from tessera.model import Band, Descriptor, Grid
from tessera.operators import collection, reproject
from tessera.raster import Raster
from tessera.sources import ranges
from tessera.sources.raster_files import read_raster, write_raster

COUNTS = ("count", "mean", "min", "max", "sum", "stddev", "status")


def dem(spark, k, width=90, height=70):
    cells = spark.range(width * height).selectExpr(f"cast(id % {width} as int) x", f"cast(id div {width} as int) y")
    value = F.when((F.col("x") + F.col("y")) % 13 == k, -9999.0).otherwise(F.col("x") * 0.5 + F.col("y") * 3 + F.col("band") * 1000 + k)
    rows = cells.withColumn("band", F.explode(F.array(F.lit(0), F.lit(1)))).select("band", "x", "y", value.alias("raw"))
    return Raster(rows, Descriptor(Grid.north_up(width, height, 0.5, 100 * k, 50), (Band("Band 1", 4, -9999.0, 0.5, 10.0), Band("Band 2", 4, -9999.0)), "EPSG:2056"))


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("many")
    out = []
    for k in range(3):
        out.append(str(folder / f"{k}.tif"))
        write_raster(dem(spark, k), out[-1], str(folder), block=16 << k, compression=("None", "Deflate", "LZW")[k])
    return out


def plane(pixels, grid, band):
    out = np.full((grid.height, grid.width), np.nan)
    for p in pixels.where(F.col("band") == band).collect():
        out[p.y, p.x] = p.raw
    return out


def assembled(tiles, key, grid, band):
    out = np.full((grid.height, grid.width), np.nan)
    for t in tiles:
        if (bytes(t.key), t.band) == (key, band):
            out[t.y : t.y + t.height, t.x : t.x + t.width] = np.array(t.samples).reshape(t.height, t.width)
    return out


def test_results_equal_those_of_single_rasters(spark, files):
    rows = api.described(spark, files).withColumn("k", F.regexp_extract("location", r"(\d)\.tif", 1).cast("int"))
    shape = F.udf(lambda k: f"POLYGON (({3 + 100 * k} 53, {40 + 100 * k} 54, {20 + 100 * k} 83, {3 + 100 * k} 53))")
    rows = api.clip_rows(rows.withColumn("wkt", shape("k")), "wkt", to="cut", mask=True)
    rows = api.reproject_rows(rows, 0.4, raster="cut", to="warped", interpolation="BILINEAR", output_no_data=-5.0)
    for column in ("raster", "cut", "warped"):
        found = api.open_tiles(rows, column).collect()
        for r in collection.keyed(rows, column).collect():
            lazy = api.open_raster(spark, r[column].asDict(recursive=True))
            for band in (0, 1):
                assert np.array_equal(assembled(found, bytes(r.key), lazy.grid, band), plane(lazy.pixels, lazy.grid, band), equal_nan=True)


def test_statistics_of_rows(spark, files):
    rows = api.described(spark, files)
    k = F.regexp_extract("location", r"(\d)\.tif", 1).cast("int")
    zone = F.udf(lambda k, x0, y0, x1, y1: "POLYGON (({0} {1}, {2} {1}, {2} {3}, {0} {3}, {0} {1}))".format(x0 + 100 * k, y0, x1 + 100 * k, y1))
    rows = rows.withColumn("k", k).crossJoin(spark.range(4).withColumnRenamed("id", "z"))
    wkt = F.when(F.col("z") < 2, zone("k", F.col("z") * 5 + 1.25, F.lit(52.0), F.col("z") * 9 + 20.0, F.lit(80.25))).when(F.col("z") == 2, zone("k", F.lit(900), F.lit(0), F.lit(901), F.lit(1)))
    rows = rows.withColumn("wkt", wkt).withColumn("raster", F.when((F.col("k") == 2) & (F.col("z") == 1), F.lit(None)).otherwise(F.col("raster"))).withColumn("n", F.lit("kept"))
    rows = rows.unionByName(rows.where("z = 0 AND k = 1"))
    io = Observation("io")
    got = api.zonal_rows(rows, band=1, no_data=None, io=io).collect()
    assert len(got) == 13 and {r.n for r in got} == {"kept"}
    for r in got:
        if r.raster is None:
            want = (0, None, None, None, None, None, "NO_RASTER")
        else:
            one = spark.createDataFrame([(0, r.wkt)], "zone_id int, wkt string")
            want = tuple(dem(spark, r.k).zonal(one, band=1).first())[1:]
        assert tuple(r[c] for c in COUNTS) == want
    sizes = sum(os.path.getsize(f) for f in files)
    assert 0 < io.get["bytes"] < sizes and 0 < io.get["requests"] < 20
    with pytest.raises(ValueError, match="exist already"):
        api.zonal_rows(rows.withColumn("COUNT", F.lit(1)))
    assert "s_count" in api.zonal_rows(rows.withColumn("count", F.lit(1)), prefix="s_").columns
    assert api.zonal_rows(rows.where("false")).count() == 0


def test_errors_name_source_and_operation(spark, files):
    rows = api.described(spark, files[:1])
    bad = api.reproject_rows(rows, 1.0, origin="to metres", interpolation="BILINEAR", output_no_data=-5.0, output_type="SOURCE")
    broken = bad.withColumn("raster", F.col("raster").withField("source.identity", F.lit("1:2:3")))
    with pytest.raises(Exception, match=r"Raster operation 'read' on '.*0\.tif' failed: The source changed"):
        api.open_tiles(broken).collect()
    collides = api.reproject_rows(api.described(spark, files[:1]), 0.5, origin="my warp", output_no_data=3.0)
    with pytest.raises(Exception, match=r"Raster operation 'my warp' on '.*0\.tif' failed: A resampled value collides"):
        api.open_tiles(collides).collect()
    flawed = api.described(spark, files[:1]).withColumn("wkt", F.lit("POLYGON ((0 0, 9 9, 9 0, 0 9, 0 0))"))
    with pytest.raises(Exception, match=r"Raster operation 'statistics' on '.*0\.tif' failed: Edges"):
        api.zonal_rows(flawed).collect()
    rows = spark.range(4).selectExpr("cast(id as int) band", "0 x", "0 y", "300D raw")
    colours = Raster(rows, Descriptor(Grid.north_up(1, 1), tuple(Band(f"Band {i + 1}", 0) for i in range(4)), "EPSG:2056", color="RGB", alpha_band=3))
    with pytest.raises(Exception, match="Raster operation 'my clip' failed: An alpha value"):
        colours.clip("POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", origin="my clip").pixels.collect()
    one = dem(spark, 0)
    with pytest.raises(Exception, match="Raster operation 'my reduction' failed: A resampled value collides"):
        one.reproject(5.0, output_no_data=17.5, origin="my reduction").pixels.collect()
    with pytest.raises(Exception, match="Raster operation 'my warp' failed: A resampled value collides"):
        one.reproject(0.4, output_no_data=3.0, origin="my warp").pixels.collect()


def test_near_ranges_come_by_one_request(tmp_path, monkeypatch):
    path = tmp_path / "x"
    path.write_bytes(bytes(range(256)) * 4096)
    s = ranges.Source(str(path))
    asked = [(None, None), (10, 5), (10, 5), (15, 5), (40, 0), (100, 10), (600_000, 3), (600_002, 7), (None, None)]
    got = [x for part in ranges.merged_reads(s, asked) for x in part]
    data = path.read_bytes()
    assert got == [None if a is None or not n else data[a : a + n] for a, n in asked]
    assert s.requests == 2 and s.bytes_read == 100 + 9
    monkeypatch.setattr(ranges, "MAX_MERGED", 50)
    assert [len(p) for p in ranges.merged_reads(ranges.Source(str(path)), asked[1:6])] == [4, 1]


def test_a_huge_reduction_stays_within_64_windows():
    """100 000 squared pixels to 4 x 4: every window has 262 144 pixels at most."""
    source, target = Grid(100_000, 100_000, 1.0, 0.0, 0.0, -1.0, 0.5, 99_999.5), Grid(4, 4, 25_000.0, 0.0, 0.0, -25_000.0, 12_500.0, 87_500.0)
    parts = list(reproject.dependencies(source, target, (0, 0, 4, 4), None))
    assert len(parts) <= 64 and sum(w * h for _, _, w, h, _ in parts) == 16
    assert max((b[2] - b[0]) * (b[3] - b[1]) for *_, b in parts) <= 262_144
    band = Band("Band 1", 5, -1.0)
    a, b = Descriptor(source, (band,), "EPSG:2056"), Descriptor(target, (band,), "EPSG:2056")
    for x, y, w, h, (x0, y0, x1, y1) in parts:
        samples = kernels.Window(x0, y0, np.full((1, y1 - y0, x1 - x0), 42.0))
        assert (kernels.warp(a, b, samples, x, y, w, h, "BILINEAR") == 42).all()


@pytest.mark.parametrize("turn", [False, True])
def test_rectangles_get_each_pixel_they_need_once(spark, turn):
    """An enlargement deals little more than the raster itself; a turned grid goes by the join."""
    source = Grid(400, 300, 0.0, 1.0, 1.0, 0.0, 0.5, 0.5) if turn else Grid.north_up(400, 300)
    target = Grid.north_up(600 if turn else 800, 800 if turn else 600, 0.5)
    rows = spark.range(400 * 300).selectExpr("0 band", "cast(id % 400 as int) x", "cast(id div 400 as int) y", "1D raw")
    got = reproject.dealt(rows, source, target, None).where("x IS NOT NULL")
    assert got.count() == got.distinct().count() <= 1.3 * 400 * 300


def test_margins_follow_the_bend():
    """Between systems the box of what is needed holds every place, and little more."""
    from tessera.functions.crs import transform

    source = Grid(4000, 3000, 100.0, 0.0, 0.0, -100.0, 2_480_000.0, 1_300_000.0)
    target = Grid(500, 400, 0.008, 0.0, 0.0, -0.006, 5.9, 47.9)
    x0, y0, x1, y1 = reproject.needed(source, target, ("EPSG:4326", "EPSG:2056"))
    sx, sy = kernels.places(source, target, 0, 0, 500, 400, transform("EPSG:4326", "EPSG:2056"))
    assert x0 <= sx.min() and y0 <= sy.min() and x1 >= sx.max() + 1 and y1 >= sy.max() + 1
    assert (x1 - x0) - (sx.max() - sx.min()) < 20 and math.isfinite(x1)


def test_read_raster_still_agrees(spark, files):
    assert read_raster(spark, files[0]).pixels.count() == 2 * 90 * 70
