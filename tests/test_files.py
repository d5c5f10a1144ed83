"""Files: codecs, round trips, structure, ranges over HTTP."""

import math
import struct
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.model import Band, Descriptor, Grid
from tessera.operators.overview import halve
from tessera.operators.tiles import read_window, to_pixels, to_tiles
from tessera.raster import Raster
from tessera.sources import tiff
from tessera.sources.ranges import Source
from tessera.sources.raster_files import describe, read_raster, scan_tiles, write_raster


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000) | st.integers(0, 5000).map(lambda n: bytes((i * i // 7) % 5 for i in range(n))))
def test_codecs(data):
    for name, code in tiff.COMPRESSIONS.items():
        assert tiff.decompress(code, tiff.compress(name, data), len(data)) == data


def test_lzw_long():
    data = np.random.default_rng(0).integers(0, 256, 60_000).astype("u1").tobytes()
    assert tiff.unlzw(tiff.lzw(data)) == data


@pytest.fixture(scope="module")
def dem(spark):
    """100 x 70, two bands, NoData on a diagonal."""
    cells = spark.range(7000).selectExpr("cast(id % 100 as int) x", "cast(id div 100 as int) y")
    value = F.when((F.col("x") + F.col("y")) % 13 == 0, -9999.0).otherwise(F.col("x") * 0.5 + F.col("y") * 3 + F.col("band") * 1000)
    rows = cells.withColumn("band", F.explode(F.array(F.lit(0), F.lit(1)))).select("band", "x", "y", value.alias("raw"))
    bands = (Band("Band 1", 4, -9999.0, 0.5, 10.0), Band("Band 2", 4, -9999.0))
    return Raster(rows, Descriptor(Grid(100, 70, 0.25, 0.0, 0.0, -0.25, 2600000.125, 1200017.375), bands, "EPSG:2056"))


def plane(r, band=0):
    out = np.full((r.grid.height, r.grid.width), np.nan)
    for p in r.pixels.where(F.col("band") == band).collect():
        out[p.y, p.x] = p.raw
    return out


def test_tiles(dem):
    tiles = to_tiles(dem, 32)
    assert {(t.tile_x, t.tile_y): (t.width, t.height, len(t.samples)) for t in tiles.where("band = 0").collect()}[3, 2] == (4, 6, 24)
    assert (plane(to_pixels(tiles, dem.descriptor), 1) == plane(dem, 1)).all()
    got = {(p.x, p.y): p.raw for p in read_window(tiles, 30, 30, 5, 4, 1, 32).collect()}
    assert len(got) == 20 and got[34, 33] == plane(dem, 1)[33, 34]


@pytest.mark.parametrize("groups", [3, 1024])
def test_running_total(spark, monkeypatch, groups):
    """Sums of sums: by two numbers, the second with gaps, a few groups at a time."""
    from tessera.operators import tiles

    monkeypatch.setattr(tiles, "GROUPS", groups)
    rows = [(a, b * b % 23, k, (a * 7 + b * 3 + k) % 11) for a in range(2) for b in range(12) for k in range(3)]
    rows = sorted({r[:3]: r for r in rows}.values())
    got = tiles.running_total(spark.createDataFrame(rows, "a int, b int, k int, v int").repartition(5), F.col("v"), [F.col("a"), F.col("b")], [F.col("k")], "place").collect()
    want, total = [], 0
    for r in rows:
        want.append((*r, total))
        total += r[3]
    assert sorted(tuple(r) for r in got) == want


@pytest.mark.parametrize("compression", list(tiff.COMPRESSIONS))
def test_geotiff_round_trip(dem, spark, tmp_path, compression):
    path = str(tmp_path / "a.tif")
    write_raster(dem, path, str(tmp_path), block=32, compression=compression)
    d, _ = describe(path)
    assert d == dem.descriptor and tiff.directories(Source(path))[0].compression == tiff.COMPRESSIONS[compression]
    back = read_raster(spark, path)
    assert all((plane(back, b) == plane(dem, b)).all() for b in (0, 1))
    part = read_raster(spark, path, bands=[1], window=(33, 5, 60, 20))
    assert (plane(part, 1) == plane(dem, 1)[5:20, 33:60]).all() and part.grid.m02 == dem.grid.m02 + 33 * 0.25
    with pytest.raises(FileExistsError):
        write_raster(dem, path, str(tmp_path), block=32)
    with pytest.raises(ValueError, match="differ"):
        write_raster(dem, path, str(tmp_path), block=32, overwrite=True, source=path)
    assert not list(tmp_path.glob("*.tmp"))


def test_cog(dem, spark, tmp_path):
    path = str(tmp_path / "a.tif")
    write_raster(dem, path, str(tmp_path), format="COG", overview="AUTO", block=32, compression="ZLib")
    data = open(path, "rb").read()
    levels = tiff.directories(Source(path))
    assert [(d.descriptor.grid.width, d.descriptor.grid.height) for d in levels] == [(100, 70), (50, 35), (25, 18)]
    assert b"LAYOUT=IFDS_BEFORE_DATA" in data[:192] and struct.unpack("<I", data[4:8])[0] == 192
    last = 0
    for d in reversed(levels):  # overviews first, each block between its size and its last bytes
        for at, n in zip(d.offsets.tolist(), d.counts.tolist(), strict=True):
            assert at > last and struct.unpack("<I", data[at - 4 : at])[0] == n and data[at + n : at + n + 4] == data[at + n - 4 : at + n]
            last = at
    want, first = plane(halve(dem)), levels[1]
    got = np.zeros((64, 64))
    for i, (at, n) in enumerate(zip(first.offsets.tolist(), first.counts.tolist(), strict=True)):
        got[i // 2 * 32 :, i % 2 * 32 :][:32, :32] = first.decode(data[at : at + n], 32)[:, :, 0]
    assert np.allclose(got[:35, :50], want.astype("f4"))


def strip_file(path, order, photometric=2, extra=(2,), no_data=b"7\0"):
    """3 x 2, four UInt8 samples, one row a strip."""
    pixels = bytes(range(24))
    fields = [(256, 3, [3]), (257, 3, [2]), (258, 3, [8] * 4), (259, 3, [1]), (262, 3, [photometric]), (273, 4, [1000, 1012]), (277, 3, [4]), (278, 3, [1]), (279, 4, [12, 12]), (338, 3, list(extra)), (33550, 12, [1.0, 1.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 5.0, 9.0, 0.0]), (42113, 2, no_data)]
    body, tail, at = b"", b"", 8 + 2 + 12 * len(fields) + 4
    for tag, kind, values in fields:
        raw = values if isinstance(values, bytes) else struct.pack(f"{order}{len(values)}{tiff.FIELD_TYPES[kind][1]}", *values)
        body += struct.pack(order + "HHI", tag, kind, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(tail)))
        tail += raw if len(raw) > 4 else b""
    data = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HIH", 42, 8, len(fields)) + body + b"\0" * 4 + tail
    open(path, "wb").write(data.ljust(1000, b"\0") + pixels)


@pytest.mark.parametrize("order", ["<", ">"])
def test_strips_and_colours(spark, tmp_path, order):
    path = str(tmp_path / "s.tif")
    strip_file(path, order)
    d, identity = describe(path)
    assert (d.color, d.alpha_band, d.bands[0].no_data, d.grid.m02, d.grid.m12) == ("RGB", 3, 7.0, 5.5, 8.5)
    assert plane(read_raster(spark, path), 2).tolist() == [[2, 6, 10], [14, 18, 22]]
    strip_file(path, order, extra=(1, 2))
    with pytest.raises(OSError, match="changed"):
        Source(path, identity + "x").read(0, 4)
    strip_file(path, order, photometric=5)
    assert describe(path)[0].color == "UNSUPPORTED"


class Ranges(BaseHTTPRequestHandler):
    data, tag, honest, sent = b"", '"1"', True, 0

    def do_GET(self):
        a, b = map(int, self.headers["Range"][6:].split("-"))
        part = self.data[a : b + 1]
        type(self).sent += len(part)
        self.send_response(206 if self.honest else 200)
        self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(self.data)}")
        self.send_header("ETag", self.tag)
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *args):
        pass


def test_http(dem, spark, tmp_path):
    path = str(tmp_path / "a.tif")
    write_raster(dem, path, str(tmp_path), block=16, compression="None", format="COG")
    Ranges.data = open(path, "rb").read() + b"\0" * 400_000
    server = ThreadingHTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/a.tif"
        d, identity = describe(url)
        assert d == dem.descriptor and identity.endswith(':"1"')
        got = read_raster(spark, url, window=(0, 0, 16, 16), identity=identity)
        assert (plane(got) == plane(dem)[:16, :16]).all() and Ranges.sent < len(Ranges.data) / 2
        Ranges.tag = '"2"'
        with pytest.raises(OSError, match="changed"):
            Source(url, identity).read(0, 10)
        Ranges.honest = False
        with pytest.raises(OSError, match="not answered with a range"):
            Source(url).read(0, 10)
    finally:
        server.shutdown()


def test_scan_reads_only_the_window(dem, spark, tmp_path):
    path = str(tmp_path / "a.tif")
    write_raster(dem, path, str(tmp_path), block=16)
    tiles, _ = scan_tiles(spark, path, bands=[0], window=(40, 20, 50, 30))
    assert {(t.tile_x, t.tile_y) for t in tiles.collect()} == {(2, 1), (3, 1)}
    with pytest.raises(ValueError, match="outside"):
        scan_tiles(spark, path, window=(0, 0, 101, 1))
    assert math.isclose(plane(read_raster(spark, path)).max(), plane(dem).max())


def test_recipes_open_what_they_plan(dem, spark, tmp_path):
    from tessera import api, recipe

    path = str(tmp_path / "a.tif")
    write_raster(dem, path, str(tmp_path), block=32)
    first = api.describe(path)
    box = "POLYGON ((2600002 1200002, 2600020 1200002, 2600020 1200015, 2600002 1200015, 2600002 1200002))"
    clipped = api.derive_clip(first, box, mask=True, bands=[1])
    warped = api.derive_reproject(clipped, 0.5, interpolation="BILINEAR")
    assert first["steps"] == [] and len(clipped["steps"]) == 1  # branches are independent
    back = recipe.decode(recipe.encode(warped))
    lazy = api.open_raster(spark, back)
    staged = str(tmp_path / "b.tif")
    write_raster(dem.clip(box, mask=True, bands=[1]), staged, str(tmp_path), block=32)
    want = plane(read_raster(spark, staged).reproject(0.5, interpolation="BILINEAR"))
    assert np.array_equal(plane(lazy), want, equal_nan=True)
    assert [r.location for r in api.described(spark, [path]).collect()] == [path]
    damaged = back | {"descriptor": back["descriptor"] | {"color": "RGB"}}
    with pytest.raises(ValueError, match="metadata changed"):
        api.open_raster(spark, damaged)
    write_raster(dem, path, str(tmp_path), block=16, overwrite=True)
    with pytest.raises(OSError, match="changed"):
        api.open_raster(spark, back)


def test_direct_files_and_zone_systems(dem, spark, tmp_path):
    from tessera import api

    a, b, c = (str(tmp_path / n) for n in ("a.tif", "b.tif", "c.tif"))
    write_raster(dem, a, str(tmp_path), block=32)
    box = "POLYGON ((2600002 1200002, 2600020 1200002, 2600020 1200015, 2600002 1200015, 2600002 1200002))"
    api.clip_file(spark, a, box, b, str(tmp_path), band=1)
    assert (plane(read_raster(spark, b)) == plane(dem.clip(box, bands=[1]))).all()
    api.reproject_file(spark, a, c, str(tmp_path), 0.5)
    assert (plane(read_raster(spark, c)) == plane(dem.reproject(0.5))).all()
    zones = spark.createDataFrame([(1, box)], "zone_id int, wkt string")
    there = api.zones_in(api.zones_in(zones, "2056", "4326"), "4326", "2056")
    assert there.first().wkt != box
    assert dem.zonal(there).first()["count"] == dem.zonal(zones).first()["count"]
