"""Coordinate systems as texts: read, compared without names, used."""

from dataclasses import replace

import numpy as np
import pytest

from tessera import api
from tessera.functions.crs import code_of, definition, equivalent, system, transform
from tessera.model import Band, Descriptor, Grid, to_struct

WGS = 'GEOGCS["WGS 84", DATUM["World Geodetic System 1984", SPHEROID["WGS 84", 6378137.0, 298.257223563, AUTHORITY["EPSG","7030"]]], PRIMEM["Greenwich", 0.0], UNIT["degree", 0.017453292519943295], AXIS["Geodetic longitude", EAST], AXIS["Geodetic latitude", NORTH], AUTHORITY["EPSG","4326"]]'
BESSEL = 'GEOGCS["CH1903+", DATUM["CH1903+", SPHEROID["Bessel 1841", 6377397.155, 299.1528128], TOWGS84[674.374, 15.056, 405.346, 0.0, 0.0, 0.0, 0.0]], PRIMEM["Greenwich", 0.0], UNIT["degree", 0.017453292519943295]]'
LV95 = f'PROJCS["CH1903+ / LV95", {BESSEL}, PROJECTION["Oblique_Mercator"], PARAMETER["longitude_of_center", 7.439583333333333], PARAMETER["latitude_of_center", 46.952405555555565], PARAMETER["azimuth", 90.0], PARAMETER["scale_factor", 1.0], PARAMETER["false_easting", 2600000.0], PARAMETER["false_northing", 1200000.0], PARAMETER["rectified_grid_angle", 90.0], UNIT["m", 1.0], AXIS["Easting", EAST], AXIS["Northing", NORTH]]'
UTM = f'PROJCS["WGS 84 / UTM zone 32N", {WGS}, PROJECTION["Transverse_Mercator"], PARAMETER["central_meridian", 9.0], PARAMETER["latitude_of_origin", 0.0], PARAMETER["scale_factor", 0.9996], PARAMETER["false_easting", 500000.0], PARAMETER["false_northing", 0.0], UNIT["m", 1.0]]'
WEB = f'PROJCS["WGS 84 / Pseudo-Mercator", {WGS}, PROJECTION["Popular Visualisation Pseudo Mercator"], PARAMETER["semi_minor", 6378137.0], PARAMETER["latitude_of_origin", 0.0], PARAMETER["central_meridian", 0.0], PARAMETER["scale_factor", 1.0], PARAMETER["false_easting", 0.0], PARAMETER["false_northing", 0.0], UNIT["m", 1.0]]'


@pytest.mark.parametrize(("text", "code"), [(WGS, "EPSG:4326"), (LV95, "EPSG:2056"), (UTM, "EPSG:32632"), (WEB, "EPSG:3857")])
def test_texts_are_their_codes(text, code):
    assert code_of(text) == code and equivalent(text, code) and system(text).code == code
    assert transform(text, code) is None
    assert equivalent(text, text.replace("WGS 84", 'A "" B').replace("CH1903+", "x").replace(', AUTHORITY["EPSG","7030"]', "")) and not equivalent(text, None)
    place = {"EPSG:4326": (7.5, 47.0), "EPSG:3857": (8e5, 6e6), "EPSG:2056": (2.65e6, 1.22e6), "EPSG:32632": (4e5, 5.2e6)}[code]
    x, y = system(text).from_degrees(*system(code).to_degrees(*(np.array([v]) for v in place)))
    assert np.allclose([x[0], y[0]], place, rtol=0, atol=5e-3)  # heights are left out, both ways


def test_other_parameters_are_other_systems():
    moved, scaled = UTM.replace("500000.0", "500001.0"), UTM.replace("0.9996", "0.99961")
    assert not equivalent(UTM, moved) and not equivalent(UTM, scaled) and code_of(moved) is None
    assert not equivalent(LV95, LV95.replace("674.374", "674.4")) and not equivalent(WGS, BESSEL) and equivalent(None, None)
    x, y = transform(UTM, moved)(np.array([400000.0]), np.array([5200000.0]))
    assert np.allclose([x, y], [[400001.0], [5200000.0]], atol=1e-6)
    north = UTM.replace('"latitude_of_origin", 0.0', '"latitude_of_origin", 40.0')
    lon, lat = transform(north, WGS)(np.array([500000.0]), np.array([0.0]))
    assert np.allclose([lon, lat], [[9.0], [40.0]])


@pytest.mark.parametrize(
    "text",
    [
        "", "EPSG:1", "GEOGCS[", f"{WGS}]", 'LOCAL_CS["x"]', 'GEOGCS["x"]', WGS.replace("EAST", "WEST"), WGS.replace('"Greenwich", 0.0', '"Paris", 2.33'), WGS.replace("0.017453292519943295", "0.015707963267948967"),
        UTM.replace('UNIT["m", 1.0]', 'UNIT["foot", 0.3048]'), UTM.replace("Transverse_Mercator", "Lambert_Conformal_Conic_2SP"), UTM.replace("scale_factor", "standard_parallel_1"), UTM.replace('"scale_factor", 0.9996', '"azimuth", 90.0'),
        LV95.replace('"azimuth", 90.0', '"azimuth", 89.0'), LV95.replace("0.0, 0.0, 0.0, 0.0]", "1.0, 0.0, 0.0, 0.0]"), WEB.replace("6378137.0, 298", "6378136.0, 298"),
    ],
)
def test_what_is_unknown_is_an_error(text):
    with pytest.raises(ValueError):
        definition(text)


def test_descriptors_that_differ_in_names_only(spark, tmp_path):
    a = Descriptor(Grid.north_up(4, 3), (Band("Band 1", 5, float("nan")),), "EPSG:2056")
    assert api.same(to_struct(a), to_struct(replace(a, crs=LV95)))
    assert not api.same(to_struct(a), to_struct(replace(a, crs=LV95.replace("1200000.0", "0.0"))))
    assert not api.same(to_struct(a), to_struct(replace(a, grid=Grid.north_up(4, 2)))) and not api.same(to_struct(a), to_struct(replace(a, crs=None)))
    from tessera.raster import Raster
    from tessera.sources.raster_files import describe, write_raster

    rows = spark.range(12).selectExpr("0 band", "cast(id % 4 as int) x", "cast(id div 4 as int) y", "cast(id as double) raw")
    path = str(tmp_path / "a.tif")
    write_raster(Raster(rows, replace(a, crs=LV95)), path, str(tmp_path), block=16)
    assert describe(path)[0].crs == "EPSG:2056"
    with pytest.raises(ValueError, match="code"):
        write_raster(Raster(rows, replace(a, crs=UTM.replace("500000.0", "500001.0"))), path, str(tmp_path), block=16, overwrite=True)
    same = Raster(rows, replace(a, crs=LV95)).reproject(0.5, target_crs="2056")
    assert same.pixels.count() == 48 and same.descriptor.crs == "2056"
