"""Hand-computed vectors for the pixel operators, and recipes."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import recipe
from tessera.functions.geometry import covers, edges, pixel_window
from tessera.functions.pixel import convert, representable
from tessera.model import Band, Descriptor, Grid
from tessera.operators.overview import halve, plan_levels
from tessera.raster import Raster

NAN = math.nan


def raster(spark, planes, kind=5, no_data=None, grid=None, **more):
    """From nested lists [band][y][x]."""
    h, w = len(planes[0]), len(planes[0][0])
    rows = [(b, x, y, float(v)) for b, plane in enumerate(planes) for y, line in enumerate(plane) for x, v in enumerate(line)]
    bands = tuple(Band(f"Band {i + 1}", kind, no_data) for i in range(len(planes)))
    return Raster(spark.createDataFrame(rows, "band int, x int, y int, raw double"), Descriptor(grid or Grid.north_up(w, h), bands, "EPSG:3857", **more))


def values(r, band=0):
    got = {(p.y, p.x): p.raw for p in r.pixels.where(F.col("band") == band).collect()}
    return [got[y, x] for y in range(r.grid.height) for x in range(r.grid.width)]


def same(a, b):
    return len(a) == len(b) and all(x == y or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def square(spark):
    return raster(spark, [[[0, 10], [20, 30]]])


def test_nearest(square):
    assert values(square.reproject(1)) == [0, 10, 20, 30] and square.reproject(1).grid == square.grid
    assert values(square.reproject(0.5)) == [0, 0, 10, 10, 0, 0, 10, 10, 20, 20, 30, 30, 20, 20, 30, 30]


def test_bilinear(spark, square):
    assert values(square.reproject(2, interpolation="BILINEAR")) == [15]
    assert values(square.reproject(0.5, interpolation="BILINEAR")) == [0, 2.5, 7.5, 10, 5, 7.5, 12.5, 15, 15, 17.5, 22.5, 25, 20, 22.5, 27.5, 30]
    assert values(raster(spark, [[[0, NAN], [20, 30]]]).reproject(2, interpolation="BILINEAR")) == [50 / 3]
    low = raster(spark, [[[-100.25, 0], [10.5, 22.25]]], kind=4)
    assert values(low.reproject(2, interpolation="BILINEAR", output_type="FLOAT32")) == [-16.875]


def test_override_and_missing(spark):
    r = raster(spark, [[[0, 10], [20, 30]]], no_data=10.0)
    assert values(r.reproject(2, interpolation="BILINEAR", source_no_data=20.0)) == [40 / 3]
    gone = raster(spark, [[[NAN, NAN], [NAN, NAN]]], no_data=10.0)
    assert values(gone.reproject(1)) == [10] * 4


def test_extent(square):
    got = square.reproject(1, extent=[-0.2, 0, 1.7, 2])
    assert (got.grid.width, got.grid.height) == (3, 2) and same(values(got), [NAN, 0, 10, NAN, 20, 30])
    with pytest.raises(ValueError, match="overlap"):
        square.reproject(1, extent=[5, 5, 6, 6])


def test_rotated(spark):
    r = raster(spark, [[[0, 10], [20, 30]]], grid=Grid(2, 2, 0, 1, 2, 0, 1, 0.5))
    assert values(r.reproject(2, 1)) == [10, 30, 0, 20]


def test_integers_and_collision(spark):
    r = raster(spark, [[[0, 1], [1, 1]]], kind=0, no_data=255.0)
    assert values(r.reproject(2, interpolation="BILINEAR", output_type="SOURCE")) == [1]
    with pytest.raises(Exception, match="collides"):
        values(r.reproject(2, interpolation="BILINEAR", output_type="SOURCE", output_no_data=1.0))


def test_seams(spark):
    r = raster(spark, [[[x + 10 * y for x in range(70)] for y in range(4)]])
    got = np.array(values(r.reproject(0.5, interpolation="BILINEAR"))).reshape(8, 140)
    sx, sy = np.clip((np.arange(140) + 0.5) / 2 - 0.5, 0, 69), np.clip((np.arange(8) + 0.5) / 2 - 0.5, 0, 3)
    assert np.abs(got - (sx[None] + 10 * sy[:, None])).max() < 1e-8


def test_colours(spark):
    p = raster(spark, [[[0, 1], [0, 1]]], kind=0, color="PALETTE", palette=(65535, 0, 0, 12345, 0, 65535))
    got = p.reproject(2, interpolation="BILINEAR")
    assert [values(got, b)[0] for b in range(4)] == [32768, 6172, 32768, 65535] and got.descriptor.data_type == 1
    planes = [[[255, 0], [255, 0]], [[0, 255], [0, 0]], [[0, 0], [0, 255]], [[255, 0], [255, 0]]]
    got = raster(spark, planes, kind=0, color="RGB", alpha_band=3).reproject(2, interpolation="BILINEAR", output_type="SOURCE")
    assert [values(got, b)[0] for b in range(4)] == [255, 0, 0, 128]
    got = raster(spark, [[[64]], [[128]]], kind=0, color="GRAY_ALPHA", alpha_band=1, associated_alpha=True).reproject(1)
    assert [values(got, b)[0] for b in range(2)] == [128, 128] and not got.descriptor.associated_alpha
    got = raster(spark, [[[1, 2]], [[3, 4]], [[5, 6]]], kind=0, color="RGB").reproject(1)
    assert [values(got, b) for b in range(4)] == [[1, 2], [3, 4], [5, 6], [255, 255]]


def test_clip_colours(spark):
    strip = raster(spark, [[[10, 20, 30]], [[40, 50, 60]], [[70, 80, 90]], [[0, 128, 64]]], kind=0, no_data=200.0, color="RGB", alpha_band=3)
    got = strip.clip("POLYGON ((0 0, 3 0, 3 1, 0 1, 0 0))", bands=[2, 0])
    assert got.descriptor.color == "NUMERIC" and values(got)[0] == 70 and values(got, 1)[2] == 30
    rgb = raster(spark, [[[0, 9]], [[0, 9]], [[0, 9]]], kind=0, no_data=0.0, color="RGB")
    got = rgb.clip("POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))", mask=True)
    assert values(got, 3) == [0, 255] and got.descriptor.bands[0].no_data is None
    with pytest.raises(ValueError, match="NoData"):
        raster(spark, [[[1]]], kind=0).clip("POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))")
    with pytest.raises(ValueError, match="'box' failed: .* overlap"):
        strip.clip("POLYGON ((9 9, 10 9, 10 10, 9 9))", origin="box")


def test_zonal_scaled(spark):
    grid = Grid(4, 3, 1, 0, 0, -1, 2600000.5, 1200002.5)
    r = raster(spark, [[[4 * y + x if x + y else 65535 for x in range(4)] for y in range(3)], [[10] * 4] * 3], grid=grid)
    r = Raster(r.pixels, Descriptor(grid, (Band("a", 1, 65535.0, 0.5, 100.0), Band("b", 1, 65535.0, 0.5, 100.0)), "EPSG:2056"))
    full = "POLYGON ((2600000 1200000, 2600004 1200000, 2600004 1200003, 2600000 1200003, 2600000 1200000))"
    donut = "POLYGON ((2600000 1200000, 2600004 1200000, 2600004 1200003, 2600000 1200003, 2600000 1200000), (2600000.9 1200000.9, 2600003.1 1200000.9, 2600003.1 1200002.1, 2600000.9 1200002.1, 2600000.9 1200000.9))"
    parts = "MULTIPOLYGON (((2600000 1200000, 2600001 1200000, 2600001 1200001, 2600000 1200001, 2600000 1200000)), ((2600003 1200002, 2600004 1200002, 2600004 1200003, 2600003 1200003, 2600003 1200002)))"
    corner = "POLYGON ((2600000.5 1200000.5, 2600000.6 1200000.5, 2600000.6 1200000.6, 2600000.5 1200000.5))"
    zones = spark.createDataFrame([(0, full), (1, donut), (2, parts), (3, corner), (4, None), (5, "POLYGON ((0 0, 1 0, 1 1, 0 0))")], "zone_id int, wkt string")
    got = {z.zone_id: z for z in r.zonal(zones).collect()}
    assert (got[0]["count"], got[0]["mean"], got[0].status) == (11, 103.0, "OK")
    assert got[4].status == "EMPTY_GEOMETRY" and got[5].status == "NO_VALID_PIXELS" and got[5]["mean"] is None
    other = {z.zone_id: z for z in r.zonal(zones, band=1).collect()}
    assert [other[i]["count"] for i in range(4)] == [12, 10, 2, 1] and other[0]["mean"] == 105
    assert {z.zone_id: z["count"] for z in r.zonal(zones, band=1, no_data=10.0).collect()}[0] == 0
    with pytest.raises(Exception, match="Polygon"):
        r.zonal(spark.createDataFrame([(1, "POINT (1 1)")], "zone_id int, wkt string")).collect()


def test_covers_agrees_with_jts(spark):
    jts = spark.sparkContext._jvm.org.locationtech.jts.io.WKTReader()
    rng = np.random.default_rng(5)
    for wkt in ["POLYGON ((0 0, 6 1, 5 5, 2 7, 0 0), (2 2, 3 2, 3 3.5, 2 2))", "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((3 3, 6 3, 4.5 6, 3 3)))"]:
        points = [(i, float(a) / 2, float(b) / 2) for i, (a, b) in enumerate(rng.integers(-2, 16, (200, 2)))]
        df = spark.createDataFrame(points, "i int, x double, y double").withColumn("e", edges(F.lit(wkt)))
        got = {r.i: r.c for r in df.select("i", covers(F.col("e"), F.col("x"), F.col("y")).alias("c")).collect()}
        shape = jts.read(wkt)
        assert got == {i: shape.covers(jts.read(f"POINT ({x} {y})")) for i, x, y in points}


def test_overviews(spark):
    r = raster(spark, [[[1, 2, 5], [3, -9, 5], [7, 7, 4]]], no_data=-9.0)
    assert values(halve(r)) == [2, 5, 7, 4] and values(halve(r, "NEAREST")) == [1, 5, 7, 4]
    ints = raster(spark, [[[1, 2], [1, 2]]], kind=0, no_data=0.0)
    assert values(halve(ints)) == [2]
    assert plan_levels(777, 665, 512) == [(389, 333)] and len(plan_levels(100_000, 10, 512)) == 8
    assert same(values(halve(raster(spark, [[[NAN]]]))), [NAN])


def test_window_rule():
    grid = Grid.north_up(10, 10)
    ring = lambda a, b: [[(a, a), (b, a), (b, b), (a, b), (a, a)]]
    assert pixel_window(ring(1.0, 3.0), grid) == (1, 7, 3, 9)  # an edge adds no pixel
    assert pixel_window(ring(1.5, 3.5), grid) == (1, 6, 4, 9)  # a centre does
    assert pixel_window(ring(20, 21), grid) is None


def test_no_data_rules(spark):
    assert representable(NAN, 4) and not representable(NAN, 1) and not representable(0.5, 0) and representable(-9999.0, 4)
    assert not representable(math.inf, 5) and representable(math.inf, 5, lenient=True) and not representable(0.1, 4)
    df = spark.createDataFrame([(2.5,), (0.5,)], "v double")
    assert [r.c for r in df.select(convert(F.col("v"), 0).alias("c")).collect()] == [2, 0]
    with pytest.raises(Exception, match="overflow"):
        df.select(convert(F.col("v") * 1000, 0)).collect()


def sample(steps=2, location="/tmp/fixture.tif"):
    d = {"grid": dict(width=10, height=10, m00=1.0, m10=0.0, m01=0.0, m11=-1.0, m02=0.5, m12=9.5), "crs_wkt": None, "authority": None, "bands": [dict(name="elevation", data_type=4, no_data=-9999.0, scale=1.0, offset=0.0)], "color": "NUMERIC", "alpha_band": -1, "associated_alpha": False, "palette": []}
    clip = {"kind": "clip", "origin": "Clip é", "clip": dict(polygon_wkt="POLYGON ((0 0, 5 0, 5 5, 0 0))", polygon_mask=True, bands=[0], no_data=None), "reproject": None, "output": d}
    warp = {"kind": "reproject", "origin": "Warp", "clip": None, "reproject": dict(target_crs="EPSG:2056", resolution_x=2.0, resolution_y=2.0, extent=[], interpolation="NEAREST", output_type="AUTO", source_no_data=None, output_no_data=-1.0), "output": d}
    return {"source": {"location": location, "identity": None}, "descriptor": d, "steps": [clip, warp][:steps]}


def test_recipe_codec():
    data = recipe.encode(sample())
    assert recipe.decode(data) == sample() and recipe.decode(recipe.encode(None)) is None
    for n in range(len(data)):
        with pytest.raises(ValueError):
            recipe.decode(data[:n])
    with pytest.raises(ValueError, match="Trailing"):
        recipe.decode(data + b"\0")
    with pytest.raises(ValueError, match="version"):
        recipe.decode(b"\0" + data[1:])


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 400), st.integers(0, 255))
def test_recipe_damage_never_crashes(at, byte):
    data = bytearray(recipe.encode(sample()))
    data[at % len(data)] = byte
    try:
        recipe.decode(bytes(data))
    except ValueError:
        pass


def test_recipe_columns(spark):
    rows = [(1, sample()), (2, sample(1, "/tmp/other.tif")), (3, None), (4, sample(0, "/tmp/input.tif"))]
    df = spark.createDataFrame(rows, f"id int, raster {recipe.RASTER_TYPE}")
    coded = recipe.with_encoded(df)
    back = recipe.with_decoded(coded.drop("raster")).collect()
    assert {r.id: r.raster.asDict(True) if r.raster else None for r in back} == dict(rows)
    assert [r.id for r in coded.orderBy("encoded").collect()] == [3, 4, 2, 1]
    assert {r.t for r in df.select(recipe.text_of(F.col("raster")).alias("t")).collect() if r.t} == {f"Raster[10x10, 1 bands, {k} operations]" for k in (0, 1, 2)}


def test_locations():
    assert recipe.reference(" /a/../b.tif ") == "/b.tif" and recipe.reference("https://h/x.tif") == "https://h/x.tif"
    for bad in ("", "ftp://h/x", "http://u:p@h/x", "s3://b/x"):
        with pytest.raises(ValueError):
            recipe.reference(bad)


def test_crs_round_trips():
    from tessera.functions.crs import system, transform

    lon, lat = transform("2056", "EPSG:4326")(np.array([2600000.0, 2600000.0]), np.array([1200002.0, 1200000.0]))
    assert abs(lon[0] - 7.438632) < 1e-6 and abs(lat[0] - 46.951101) < 1e-6
    x, y = np.meshgrid(np.linspace(6, 10.4, 7), np.linspace(45.9, 47.7, 7))
    for code in ("2056", "3857", "32632", "32732", "4326"):
        s = system(code)
        a, b = s.to_degrees(*s.from_degrees(x, y))
        assert np.abs(a - x).max() < 2e-8 and np.abs(b - y).max() < 2e-8
    e, n = system("EPSG:32632").from_degrees(np.array([9.0]), np.array([0.0]))
    assert abs(e[0] - 500000) < 1e-6 and abs(n[0]) < 1e-6
    for bad in ("", "EPSG:1", "32661"):
        with pytest.raises(ValueError):
            system(bad)


def test_warp_between_systems(spark):
    grid = Grid(2, 2, 1, 0, 0, -1, 2600000.5, 1200001.5)
    r = raster(spark, [[[0, 10], [20, 30]]], grid=grid)
    r = Raster(r.pixels, Descriptor(grid, r.descriptor.bands, "EPSG:2056"))
    got = r.reproject(1e-5, target_crs="EPSG:4326")
    assert got.descriptor.crs == "EPSG:4326" and abs(got.grid.m02 - 7.43863) < 1e-4 and abs(got.grid.m12 - 46.95108) < 1e-4
    assert {0.0, 10.0, 20.0, 30.0} & {v for v in values(got) if not math.isnan(v)}
    wide = Raster(r.pixels, Descriptor(Grid(2, 2, 2, 0, 0, -1, 179, 1.5), r.descriptor.bands, "EPSG:3857"))
    wide = Raster(r.pixels, Descriptor(Grid(2, 2, 2e7, 0, 0, -1, 1e7, 1.5), wide.descriptor.bands, "EPSG:3857"))
    with pytest.raises(ValueError, match="longitude"):
        wide.reproject(1, target_crs="4326")


@pytest.mark.parametrize(
    "wkt",
    ["POLYGON ((0 0, 4 0, 4 4))", "POLYGON ((0 0, 4 4, 4 0, 0 4, 0 0))", "POLYGON ((0 0, 4 0, 0 0, 0 4, 0 0))", "POLYGON ((0 0, 1 1, 0 0))", "SRID=99999;POLYGON ((0 0, 4 0, 4 4, 0 0))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (2 2, 9 2, 9 3, 2 3, 2 2))", "POINT (1 1)"],
)
def test_invalid_polygons_are_errors(spark, wkt):
    from tessera.functions.geometry import aligned

    with pytest.raises(ValueError):
        aligned(wkt, "EPSG:3857")


def test_systems_of_polygons():
    from tessera.functions.geometry import aligned

    box = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
    assert aligned("SRID=3857;" + box, "EPSG:3857") == box and aligned(box, "EPSG:3857", "3857") == box and aligned(box, None) == box
    moved = aligned("SRID=4326;" + box, "EPSG:3857")
    assert moved.startswith("POLYGON ((0.0 ") and "445277.9" in moved
    assert aligned(None, "EPSG:3857") is None and aligned("POLYGON EMPTY", "EPSG:3857") == "POLYGON EMPTY"
    with pytest.raises(ValueError):
        aligned("SRID=4326;" + box, None)


def test_palettes_for_displays():
    from tessera.functions.pixel import eight_bits

    assert eight_bits((0, 256, 257, 32896, 65534, 65535)) == (0, 0, 1, 128, 254, 255) and eight_bits(()) == ()
