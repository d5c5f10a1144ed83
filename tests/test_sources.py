"""The data source: pushed filters, commits, stored arrays, accounting, connections."""

import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.model import Band, Descriptor, Grid
from tessera.raster import Raster
from tessera.sources import data_source, ranges, tiff
from tessera.sources.raster_files import read_raster, scan_tiles, write_raster


@pytest.fixture(scope="module")
def dem(spark):
    rows = spark.range(200 * 150 * 2).selectExpr("cast(id % 2 as int) band", "cast(id div 2 % 200 as int) x", "cast(id div 400 as int) y", "id * 1.5D raw")
    return Raster(rows, Descriptor(Grid.north_up(200, 150), (Band("Band 1", 5, -1.0), Band("Band 2", 5, -1.0)), "EPSG:2056"))


@pytest.fixture(scope="module")
def server(spark, dem, tmp_path_factory):
    """A file behind a server that counts what it sends, and the connections it was asked over."""
    folder = tmp_path_factory.mktemp("served")
    path = str(folder / "a.tif")
    write_raster(dem, path, str(folder), block=16, compression="None")
    data = open(path, "rb").read()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"
        sent, asked, clients = [0], [0], set()

        def do_GET(self):
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/a.tif")
                self.send_header("Content-Length", "0")
                self.end_headers()
                return
            first, last = (int(v) for v in self.headers["Range"].removeprefix("bytes=").split("-"))
            part = data[first : last + 1]
            self.sent[0], self.asked[0] = self.sent[0] + len(part), self.asked[0] + 1
            self.clients.add(self.client_address)
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {first}-{first + len(part) - 1}/{len(data)}")
            self.send_header("Content-Length", str(len(part)))
            self.send_header("ETag", '"1"')
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *args):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    made.daemon_threads = True
    threading.Thread(target=made.serve_forever, daemon=True).start()
    made.url, made.size, made.counts, made.path = f"http://127.0.0.1:{made.server_port}", len(data), Handler, path
    yield made
    made.shutdown()


def sent(server, run):
    before = server.counts.sent[0], server.counts.asked[0]
    out = run()
    return out, server.counts.sent[0] - before[0], server.counts.asked[0] - before[1]


def test_filters_reach_the_blocks(spark, server):
    pixels = data_source.load(spark, f"{server.url}/a.tif", unit="pixel")
    everything, all_bytes, _ = sent(server, lambda: pixels.count())
    assert everything == 200 * 150 * 2 and all_bytes >= server.size - 2000
    few = pixels.where("band = 1 AND x >= 20 AND x < 60 AND y BETWEEN 33 AND 40")
    got, bytes_read, _ = sent(server, lambda: sorted((r.x, r.y, r.raw) for r in few.collect()))
    assert got == sorted((x, y, (y * 400 + x * 2 + 1) * 1.5) for x in range(20, 60) for y in range(33, 41))
    assert bytes_read < server.size / 3
    tiles = data_source.load(spark, server.path)
    assert {(t.tile_x, t.tile_y, t.band) for t in tiles.where("tile_x IN (2, 3) AND y > 31 AND y <= 64 AND band = 0").collect()} == {(x, y, 0) for x in (2, 3) for y in (2, 3, 4)}
    assert tiles.where("band = 7").count() == 0 and tiles.where("x = 5").count() == 0
    assert pixels.count() == everything  # the filters of another query don't stay
    plain = spark.read.format("tessera_raster").load(server.path)
    assert (plain.where("tile_x = 1").count(), plain.count()) == (2 * 10, 2 * 130)
    assert few.join(pixels, ["x", "y", "band"]).count() == 40 * 8
    assert pixels.where("x > 150 OR y < 3").count() == 2 * (49 * 150 + 151 * 3)


def test_windows_are_accounted_and_merged(spark, server):
    io = Observation("io")
    tiles, _ = scan_tiles(spark, f"{server.url}/a.tif", window=(0, 0, 200, 16), identity=None, io=io)
    (count, bytes_read, requests) = sent(server, lambda: tiles.count())
    assert count == 2 * 13 and io.get["requests"] == 1 and io.get["bytes"] == 13 * 16 * 16 * 16 < server.size / 2
    assert bytes_read >= io.get["bytes"]
    io = Observation("raster")
    assert read_raster(spark, server.path, bands=[0], window=(50, 50, 60, 60), io=io).pixels.count() == 100
    assert io.get["bytes"] < server.size / 2


def test_one_connection_and_redirects(server):
    server.counts.clients.clear()
    s = ranges.Source(f"{server.url}/moved")
    assert s.read(0, 2) == b"II" and s.read(100, 7) and s.read(5000, 9)
    assert len(server.counts.clients) == 1 and s.requests == 3
    s.connection.kept.sock.shutdown(2)  # the host has closed it meanwhile
    assert len(s.read(7, 4)) == 4
    assert ranges.CONNECT_SECONDS < ranges.REQUEST_SECONDS


def test_a_failed_write_leaves_the_old_file(spark, dem, tmp_path):
    path = str(tmp_path / "a.tif")
    write_raster(dem, path, str(tmp_path), block=32)
    before = open(path, "rb").read()
    holes = Raster(dem.pixels.where("x < 32 OR y < 32"), dem.descriptor)
    with pytest.raises(OSError, match="Not every block"):
        write_raster(holes, path, str(tmp_path), block=32, overwrite=True)
    broken = Raster(dem.pixels.withColumn("raw", F.when(F.col("x") == 77, F.raise_error(F.lit("no such sample")).cast("double")).otherwise(F.col("raw"))), dem.descriptor)
    with pytest.raises(Exception, match="no such sample"):
        write_raster(broken, path, str(tmp_path), block=32, overwrite=True)
    assert open(path, "rb").read() == before and os.listdir(tmp_path) == ["a.tif"]


def test_writer_commits_all_or_nothing(tmp_path):
    import json

    import pyarrow as pa

    temporary, target = tmp_path / "t", tmp_path / "a"
    temporary.write_bytes(bytes(64))
    plan = {"around": 0, "across": [2], "arrays": [(0, 8, 4)], "count": 2}
    w = data_source.BlockWriter({"temporary": str(temporary), "target": str(target), "plan": json.dumps(plan)})
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=list("lsbyxd"))
    rows = [(0, 0, 20, 0, 0, b"abc"), (0, 0, 20, 0, 1, b"de")]
    half = w.write(iter([batch(rows[:1])]))
    with pytest.raises(OSError, match="Not every block"):
        w.commit([half])
    with pytest.raises(OSError, match="missing or comes twice"):
        w.write(iter([batch([rows[0], rows[0]])]))
    w.commit([w.write(iter([batch(rows)])), None])
    assert target.read_bytes()[20:25] == b"abcde" and np.frombuffer(target.read_bytes()[:16], "<u4").tolist() == [20, 23, 3, 2]
    temporary.write_bytes(b"")
    w.abort([None])
    assert not temporary.exists()


def test_long_arrays_stay_in_the_file(spark, dem, tmp_path, monkeypatch):
    path = str(tmp_path / "a.tif")
    write_raster(dem, path, str(tmp_path), block=16, format="COG", overview="AUTO")
    want = [(d.offsets.tolist(), d.counts.tolist()) for d in tiff.directories(ranges.Source(path))]
    monkeypatch.setattr(tiff, "STORED_PART", 10)
    monkeypatch.setattr(tiff, "STORED_PARTS", 2)
    found = tiff.directories(ranges.Source(path))
    assert isinstance(found[0].offsets, tiff.Stored) and not isinstance(found[-1].offsets, tiff.Stored)
    assert [(d.offsets.tolist(), d.counts.tolist()) for d in found] == want
    assert len(found[0].offsets.parts) <= 2
    with pytest.raises(IndexError):
        found[0].offsets[len(found[0].offsets)]


def test_stripes_make_the_same_file(spark, dem, tmp_path, monkeypatch):
    from tessera.sources import raster_files

    for n, name in ((65_536, "a"), (1, "b")):
        monkeypatch.setattr(raster_files, "STRIPE_BLOCKS", n)
        write_raster(dem.reproject(0.9, output_no_data=-1.0), str(tmp_path / name), str(tmp_path), block=16, overview="AUTO")
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()
