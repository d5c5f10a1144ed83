"""Scans of GeoTIFF files as tiles, and sinks that write GeoTIFF and COG.

A scan reads the directory on the driver, but not the places of blocks, which
tasks read for their own blocks; neighbouring blocks come by one request.
Filters on tiles become the list of blocks, so what is not needed is not read.
A sink encodes blocks in tasks and sums their lengths by stripes of tiles;
within a stripe a writer's task puts one block after the other, and their
places where the directory has them. The file must be on a file system that
driver and executors share; it appears under its name only when it is complete.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.failures import failing
from tessera.model import Descriptor
from tessera.operators.overview import overviews
from tessera.operators.tiles import TILE, check_size, encode_blocks, to_pixels, to_tiles
from tessera.raster import Raster
from tessera.shared import remove
from tessera.sources.data_source import RASTER, directory, register, tiles_of
from tessera.sources.ranges import Source, is_http
from tessera.sources.tiff import COMPRESSIONS, Directory, directories, layout

BIG_BYTES = 2 * 1024**3
FORMATS, OVERVIEWS = ("GEOTIFF", "COG"), ("NONE", "AUTO")
#: Blocks of a stripe of tiles, of which the driver knows one sum: about so many.
STRIPE_BLOCKS = 65_536


def describe(location: str) -> tuple[Descriptor, str]:
    """A file's descriptor and identity; no pixels are read."""
    source = Source(location)
    first = directories(source)[0]
    return first.descriptor, source.identity


def scan_tiles(spark: SparkSession, location: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None, identity: str | None = None, blocks_per_task: int = 16, io: Observation | None = None) -> tuple[DataFrame, Directory]:
    """Tiles of the first image, at full resolution; overviews are not used.

    ``window`` (x0, y0, x1, y1, half open) keeps the blocks that it touches.
    ``io`` observes the bytes and requests of the tasks that succeed, with the
    directories that they read anew.
    """
    source = Source(location, identity)
    d = directories(source)[0]
    grid, n = d.descriptor.grid, len(d.descriptor.bands)
    x0, y0, x1, y1 = window or (0, 0, grid.width, grid.height)
    if not (0 <= x0 < x1 <= grid.width and 0 <= y0 < y1 <= grid.height):
        raise ValueError("Window outside raster")
    chosen = list(range(n)) if bands is None else bands
    if any(not 0 <= b < n for b in chosen):
        raise ValueError("The file has no such band")
    tx0, tx1 = x0 // d.block_width, (x1 - 1) // d.block_width + 1
    ty0, ty1 = y0 // d.block_height, (y1 - 1) // d.block_height + 1
    wide = tx1 - tx0
    count = wide * (ty1 - ty0)
    where, version = source.location, source.identity

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with failing("read", where):
            d, reader = directory(where, version), Source(where, version)
            first = [reader.bytes_read, reader.requests]
            for batch in batches:
                asked = [(tx0 + i % wide, ty0 + i // wide) for i in batch.column(0).to_pylist()]
                for made in tiles_of(d, reader, asked, chosen):
                    now = [reader.bytes_read, reader.requests]
                    more = [pa.array([b - a, *[0] * (made.num_rows - 1)], pa.int64()) for a, b in zip(first, now, strict=True)]
                    first = now
                    yield pa.RecordBatch.from_arrays([*made.columns, *more], names=[*made.schema.names, "bytes", "requests"])

    tasks = max(1, -(-count // blocks_per_task))
    found = spark.range(0, count, 1, tasks).mapInArrow(run, f"{TILE}, bytes long, requests long")
    if io is not None:
        found = found.observe(io, F.sum("bytes").alias("bytes"), F.sum("requests").alias("requests"))
    return found.drop("bytes", "requests"), d


def read_raster(spark: SparkSession, location: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None, identity: str | None = None, io: Observation | None = None) -> Raster:
    """The pixels of a file, or of a window of it (in the window's own grid)."""
    tiles, d = scan_tiles(spark, location, bands, window, identity, io=io)
    r = to_pixels(tiles, d.descriptor)
    if window is None:
        return r
    from dataclasses import replace

    x0, y0, x1, y1 = window
    inside = r.pixels.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1))
    return Raster(inside.select("band", (F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"), "raw"), replace(d.descriptor, grid=d.descriptor.grid.moved(x0, y0, x1 - x0, y1 - y0)))


def write_raster(
    raster: Raster,
    path: str,
    work_dir: str,
    format: str = "GEOTIFF",
    overview: str = "NONE",
    resampling: str = "AVERAGE",
    block: int = 512,
    compression: str = "Deflate",
    overwrite: bool = False,
    source: str | None = None,
) -> int:
    """Write one file and return its size.

    Blocks are encoded into a table in ``work_dir`` (shared by driver and
    executors), which goes in the end. The driver learns the sums of stripes
    only; the data source's writer puts the blocks and their places, and its
    commit gives the file its name. A task that fails leaves the old file.
    """
    if format not in FORMATS or overview not in OVERVIEWS:
        raise ValueError("Unknown format or overview mode")
    if compression not in COMPRESSIONS:
        raise ValueError(f"Compression must be one of {', '.join(COMPRESSIONS)}")
    check_size(block)
    if is_http(path):
        raise ValueError("Rasters are written to files")
    if source and not is_http(source) and (os.path.abspath(source) == os.path.abspath(path) or (os.path.exists(path) and os.path.exists(source) and os.path.samefile(source, path))):
        raise ValueError("Output must differ from the source")
    if not os.path.isdir(os.path.dirname(os.path.abspath(path))):
        raise FileNotFoundError("Output folder does not exist")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError("Output exists")
    if len({str(b.no_data) for b in raster.descriptor.bands}) > 1:
        raise ValueError("A file needs one NoData value for all bands")
    spark, cog = raster.spark, format == "COG"
    levels = [raster] + (overviews(raster, block, resampling) if overview == "AUTO" else [])
    shapes = [r.descriptor for r in levels]
    across, down = ([-(-size // block) for size in sizes] for sizes in zip(*((d.grid.width, d.grid.height) for d in shapes), strict=True))
    encoded = None
    for k, r in enumerate(levels):
        own = encode_blocks(to_tiles(r, block), r.descriptor, block, compression).withColumn("level", F.lit(k))
        encoded = own if encoded is None else encoded.unionByName(own)
    stripe = F.floor(F.col("tile_y") / max(1, STRIPE_BLOCKS // across[0]))
    table, temporary = f"{work_dir.rstrip('/')}/blocks-{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        encoded.withColumn("stripe", stripe).write.parquet(table)
        blocks = spark.read.parquet(table)
        # A COG's block has its size before it and its last four bytes again after it.
        around = 8 if cog else 0
        sums = blocks.groupBy("level", "stripe").agg(F.sum(F.length("data") + around).cast("long").alias("size"), F.count(F.lit(1)).alias("n"))
        sums = sorted(sums.collect(), key=lambda r: (-r["level"], r["stripe"]))  # a row for some STRIPE_BLOCKS blocks
        count, size = sum(r["n"] for r in sums), sum(r["size"] for r in sums)
        if count != sum(a * b for a, b in zip(across, down, strict=True)):
            raise OSError("Not every block of the raster has pixels")
        big = size + 32 * count + 65536 >= BIG_BYTES
        pieces, start, arrays = layout(shapes, compression, block, big, cog)
        bases, at = [], start
        for r in sums:
            bases.append((r["level"], r["stripe"], at))
            at += r["size"]
        with open(temporary, "wb") as f:
            for place, data in pieces:
                f.seek(place)
                f.write(data)
            f.truncate(at)
        placed = blocks.join(F.broadcast(spark.createDataFrame(bases, "level int, stripe long, base long")), ["level", "stripe"])
        rows = placed.select("level", "stripe", "base", "tile_y", "tile_x", "data").repartition("level", "stripe").sortWithinPartitions("level", "stripe", "tile_y", "tile_x")
        register(spark)
        plan = json.dumps({"around": around, "across": across, "arrays": arrays, "count": count})
        rows.write.format(RASTER).option("temporary", temporary).option("target", path).option("plan", plan).mode("append").save()
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)
        remove(spark, table)
    return at
