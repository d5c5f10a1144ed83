"""Tiles: pixels gathered in square blocks, and the blocks of files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import Descriptor
from tessera.raster import Raster

MAX_PIXELS = 262_144
TILE = "band int, tile_x int, tile_y int, x int, y int, width int, height int, samples array<double>"


def check_size(size: int) -> int:
    if not 16 <= size <= 4096 or size & (size - 1):
        raise ValueError("A block's side is a power of two from 16 to 4096")
    return size


def to_tiles(raster: Raster, size: int = 512) -> DataFrame:
    """One row for each band and tile, samples row by row; tiles at the edges are smaller."""
    check_size(size)
    grid = raster.grid
    x, y = F.col("x"), F.col("y")
    rows = raster.pixels.select("band", F.floor(x / size).cast("int").alias("tile_x"), F.floor(y / size).cast("int").alias("tile_y"), F.struct(y, x, "raw").alias("p"))
    tiles = rows.groupBy("band", "tile_x", "tile_y").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # size * size pixels at most
    left, top = F.col("tile_x") * size, F.col("tile_y") * size
    return tiles.select("band", "tile_x", "tile_y", left.alias("x"), top.alias("y"), F.least(F.lit(size), grid.width - left).alias("width"), F.least(F.lit(size), grid.height - top).alias("height"), F.transform("ps", lambda p: p["raw"]).alias("samples"))


def to_pixels(tiles: DataFrame, descriptor: Descriptor) -> Raster:
    """The raster of tiles."""
    each = tiles.select("band", "x", "y", "width", F.posexplode("samples").alias("at", "raw"))
    return Raster(each.select("band", (F.col("x") + F.col("at") % F.col("width")).alias("x"), (F.col("y") + F.floor(F.col("at") / F.col("width")).cast("int")).alias("y"), "raw"), descriptor)


def read_window(tiles: DataFrame, x: int, y: int, width: int, height: int, band: int, size: int) -> DataFrame:
    """(x, y, raw) of a window, from the tiles that it touches."""
    if width * height > MAX_PIXELS:
        raise ValueError(f"Read at most {MAX_PIXELS} pixels per window")
    touched = tiles.where((F.col("band") == band) & F.col("tile_x").between(x // size, (x + width - 1) // size) & F.col("tile_y").between(y // size, (y + height - 1) // size))
    each = touched.select("x", "y", "width", F.posexplode("samples").alias("at", "raw"))
    px, py = F.col("x") + F.col("at") % F.col("width"), F.col("y") + F.floor(F.col("at") / F.col("width")).cast("int")
    each = each.select(px.alias("x"), py.alias("y"), "raw")
    return each.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))


#: Groups whose sums are added up by one task, of those that follow each other.
GROUPS = 1024


def running_total(df: DataFrame, value: Column, groups: list[Column], order: list[Column], to: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before, by group and then order.

    Groups are numbers, from 0. Their sums are added up by GROUPS of the last
    number at a time, and then those sums, so that no task sees more than one
    group's rows, GROUPS sums, or the sums of so many.
    """
    names = [f"_g{i}" for i in range(len(groups))]
    rows = df.withColumns({**dict(zip(names, groups, strict=True)), "_v": value})
    before, none = Window.rowsBetween(Window.unboundedPreceding, -1), F.lit(0)
    wide = [*names[:-1], "_w"]
    sums = rows.groupBy(*names).agg(F.sum("_v").alias("_s")).withColumn("_w", F.floor(F.col(names[-1]) / GROUPS))
    tops = sums.groupBy(*wide).agg(F.sum("_s").alias("_t")).withColumn("_base", F.coalesce(F.sum("_t").over(before.orderBy(*wide)), none)).drop("_t")
    sums = sums.withColumn("_in", F.coalesce(F.sum("_s").over(before.partitionBy(*wide).orderBy(names[-1])), none)).join(tops, wide)
    own = F.coalesce(F.sum("_v").over(before.partitionBy(*names).orderBy(*order)), none)
    return rows.join(sums.select(*names, (F.col("_base") + F.col("_in")).alias("_before")), names).withColumn(to, F.col("_before") + own).drop(*names, "_v", "_before")


def encode_blocks(tiles: DataFrame, descriptor: Descriptor, size: int, compression: str) -> DataFrame:
    """(tile_x, tile_y, data): all bands of a tile as one compressed block, padded at the edges."""
    from tessera.sources.tiff import COMPRESSIONS, DTYPES, compress

    if compression not in COMPRESSIONS:
        raise ValueError(f"Compression must be one of {', '.join(COMPRESSIONS)}")
    whole = tiles.groupBy("tile_x", "tile_y").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "width", "height", "samples"))), lambda s: s).alias("bands"))
    dtype, n = "<" + DTYPES[descriptor.data_type], len(descriptor.bands)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            data = []
            for bands in batch.column(2).to_pylist():
                block = np.zeros((size, size, n), dtype)
                for b in bands:
                    block[: b["height"], : b["width"], b["band"]] = np.array(b["samples"], dtype=np.float64).reshape(b["height"], b["width"])
                data.append(compress(compression, block.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["tile_x", "tile_y", "data"])

    return whole.select("tile_x", "tile_y", "bands").mapInArrow(run, "tile_x int, tile_y int, data binary")


def decode_blocks(blocks: DataFrame, descriptor: Descriptor, size: int, compression: str) -> DataFrame:
    """The tiles of blocks."""
    from tessera.sources.tiff import COMPRESSIONS, DTYPES, decompress

    dtype, n, grid = "<" + DTYPES[descriptor.data_type], len(descriptor.bands), descriptor.grid

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for tx, ty, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = decompress(COMPRESSIONS[compression], data, size * size * n * np.dtype(dtype).itemsize)
                block = np.frombuffer(raw, dtype).reshape(size, size, n)
                w, h = min(size, grid.width - tx * size), min(size, grid.height - ty * size)
                rows += [(b, tx, ty, tx * size, ty * size, w, h, block[:h, :w, b].astype(np.float64).ravel()) for b in range(n)]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:7]), pa.array(cols[7], pa.list_(pa.float64()))], names=["band", "tile_x", "tile_y", "x", "y", "width", "height", "samples"])

    return blocks.select("tile_x", "tile_y", "data").mapInArrow(run, TILE)
