"""GeoTIFF files as a Spark data source: ``spark.read.format("tessera_raster")``.

Reading: with the option ``unit`` a row is a ``tile`` (the default) or a
``pixel``. Of what :func:`load` returns, filters on band, tile and pixel are
pushed down to the blocks that a partition reads; Spark checks them again.
Spark 4.1 keeps a reader with the filters of the query before for a query that
has none; so only :func:`load` asks for the pushing (option ``pushed``), and
puts a filter that always holds on what it returns, so that every query brings
its own. Writing takes encoded blocks in order
and is what :func:`tessera.sources.raster_files.write_raster` ends with.
"""

from __future__ import annotations

import json
import math
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tessera.failures import failing
from tessera.model import PIXEL_SCHEMA
from tessera.operators.tiles import TILE
from tessera.sources.ranges import Source, merged_reads
from tessera.sources.tiff import Directory, directories

RASTER = "tessera_raster"
UNITS = {"tile": TILE, "pixel": PIXEL_SCHEMA}


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters pushed down."""
    spark.dataSource.register(RasterDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def load(spark: SparkSession, path: str, unit: str = "tile", identity: str | None = None, blocks: int = 16) -> DataFrame:
    """A file's tiles or pixels; filters on x, y, band, tile_x and tile_y decide which blocks are read."""
    register(spark)
    reader = spark.read.format(RASTER).option("unit", unit).option("blocks", blocks).option("pushed", "true")
    return (reader.option("identity", identity) if identity else reader).load(path).where("band >= 0")


@lru_cache(maxsize=64)
def directory(location: str, identity: str | None) -> Directory:
    """A file's first image; a worker reads it once."""
    return directories(Source(location, identity))[0]


def tiles_of(d: Directory, source: Source, asked: list[tuple[int, int]], bands: list[int]) -> Iterator:
    """Batches of tiles (as in TILE) for blocks (tile_x, tile_y), one for each request; bands of a tile follow each other."""
    import numpy as np
    import pyarrow as pa

    grid, n, apart = d.descriptor.grid, len(d.descriptor.bands), d.planar == 2
    wanted = [(int(d.offsets[k]), int(d.counts[k]), tx, ty, b) for tx, ty in asked for b in (sorted(set(bands)) if apart else [0]) for k in [ty * d.across + tx + b * d.across * d.down]]
    wanted.sort()
    at = 0
    for found in merged_reads(source, [w[:2] for w in wanted]):
        rows = []
        for (_, _, tx, ty, plane), data in zip(wanted[at : at + len(found)], found, strict=True):
            w, h, size = min(d.block_width, grid.width - tx * d.block_width), min(d.block_height, grid.height - ty * d.block_height), d.rows_of(ty)
            block = d.decode(data, size) if data else np.zeros((size, d.block_width, 1 if apart else n))
            rows += [(b, tx, ty, tx * d.block_width, ty * d.block_height, w, h, block[:h, :w, 0 if apart else b].astype(np.float64).ravel()) for b in bands if not apart or b == plane]
        at += len(found)
        cols = list(zip(*rows, strict=True))
        if cols:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:7]), pa.array(cols[7], pa.list_(pa.float64()))], names=["band", "tile_x", "tile_y", "x", "y", "width", "height", "samples"])


def pixels_of(tiles) -> Iterator:
    """Batches of pixels of a batch of tiles, a tile each."""
    import numpy as np
    import pyarrow as pa

    for i in range(tiles.num_rows):
        band, _, _, x, y, w, h = (tiles.column(k)[i].as_py() for k in range(7))
        xs, ys = np.tile(np.arange(x, x + w, dtype=np.int32), h), np.repeat(np.arange(y, y + h, dtype=np.int32), w)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(w * h, band, np.int32)), pa.array(xs), pa.array(ys), tiles.column(7)[i].values], names=["band", "x", "y", "raw"])


@dataclass
class Blocks(InputPartition):
    first: int
    last: int


class RasterDataSource(DataSource):
    """Options: path, unit (tile or pixel), identity, blocks (of one partition), pushed (see :func:`load`)."""

    @classmethod
    def name(cls) -> str:
        return RASTER

    def schema(self) -> str:
        return UNITS[self.options.get("unit", "tile")]

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BlockWriter(self.options)


class RasterReader(DataSourceReader):
    def __init__(self, options):
        self.unit, self.blocks, self.pushed = options.get("unit", "tile"), int(options.get("blocks", 16)), options.get("pushed") == "true"
        source = Source(options["path"], options.get("identity"))
        d = directories(source)[0]
        self.location, self.identity = source.location, source.identity
        self.block, self.size = (d.block_width, d.block_height), (d.across, d.down)
        # What may still be asked for, first and last: blocks along x and y, and bands.
        self.ranges = {"tile_x": [0, d.across - 1], "tile_y": [0, d.down - 1], "band": [0, len(d.descriptor.bands) - 1]}

    def narrow(self, name: str, low: float, high: float) -> None:
        if name in ("x", "y"):
            side = self.block["xy".index(name)]
            # A pixel lies in its block; a tile's x and y are those of its first pixel.
            low, high, name = math.floor(low / side) if self.unit == "pixel" else math.ceil(low / side), math.floor(high / side), f"tile_{name}"
        own = self.ranges[name]
        own[0], own[1] = max(own[0], math.ceil(low)), min(own[1], math.floor(high))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name, ends = getattr(f, "attribute", ())[-1:], None
            known = self.pushed and name and len(f.attribute) == 1 and name[0] in ("band", "tile_x", "tile_y", "x", "y")
            if known and isinstance(f, EqualTo):
                ends = (f.value, f.value)
            elif known and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                ends = (f.value + isinstance(f, GreaterThan), 2**31)
            elif known and isinstance(f, (LessThan, LessThanOrEqual)):
                ends = (0, f.value - isinstance(f, LessThan))
            elif known and isinstance(f, In) and f.value:
                ends = (min(f.value), max(f.value))
            if ends and all(isinstance(v, int) for v in ends):
                self.narrow(name[0], *ends)
            yield f

    def partitions(self) -> list[Blocks]:
        n = self._wide() * max(0, self.ranges["tile_y"][1] - self.ranges["tile_y"][0] + 1) if self.ranges["band"][0] <= self.ranges["band"][1] else 0
        return [Blocks(at, min(at + self.blocks, n)) for at in range(0, n, self.blocks)] or [Blocks(0, 0)]

    def _wide(self) -> int:
        return max(0, self.ranges["tile_x"][1] - self.ranges["tile_x"][0] + 1)

    def read(self, partition: Blocks) -> Iterator:
        if partition.first == partition.last:
            return
        with failing("read", self.location):
            d, source, wide = directory(self.location, self.identity), Source(self.location, self.identity), self._wide()
            asked = [(self.ranges["tile_x"][0] + i % wide, self.ranges["tile_y"][0] + i // wide) for i in range(partition.first, partition.last)]
            for tiles in tiles_of(d, source, asked, list(range(self.ranges["band"][0], self.ranges["band"][1] + 1))):
                yield from [tiles] if self.unit == "tile" else pixels_of(tiles)


@dataclass
class Written(WriterCommitMessage):
    blocks: int


class BlockWriter(DataSourceArrowWriter):
    """Puts rows (level, stripe, base, tile_y, tile_x, data), in order within a stripe, into a file.

    A task that runs again puts the same bytes at the same places. The commit
    counts the blocks and gives the file its name; an abort removes it.
    """

    def __init__(self, options):
        self.temporary, self.target, self.plan = options["temporary"], options["target"], json.loads(options["plan"])

    def write(self, batches: Iterator) -> Written:
        around, written, last, place, index = self.plan["around"], 0, None, 0, 0
        with open(self.temporary, "r+b") as f:
            for batch in batches:
                lists = [batch.column(k).to_pylist() for k in range(5)]
                runs: list[tuple[int, int, list[int], list[int]]] = []  # level, first block, offsets, lengths
                for level, stripe, base, tile_y, tile_x, data in zip(*lists, batch.column(5), strict=True):
                    own, raw = tile_y * self.plan["across"][level] + tile_x, data.as_py()
                    if last != (level, stripe):
                        last, place, index = (level, stripe), base, own
                    if own != index:
                        raise OSError("A block of the raster is missing or comes twice")
                    if not runs or runs[-1][0] != level or runs[-1][1] + len(runs[-1][2]) != own:
                        runs.append((level, own, [], []))
                    runs[-1][2].append(place + around // 2)
                    runs[-1][3].append(len(raw))
                    f.seek(place)
                    f.write(len(raw).to_bytes(4, "little") + raw + raw[-4:] if around else raw)
                    place, index, written = place + len(raw) + around, index + 1, written + 1
                for level, first, offsets, lengths in runs:
                    at, sizes_at, width = self.plan["arrays"][level]
                    for where, values in ((at, offsets), (sizes_at, lengths)):
                        f.seek(where + first * width)
                        f.write(struct.pack(f"<{len(values)}{'Q' if width == 8 else 'I'}", *values))
        return Written(written)

    def commit(self, messages: list[Written | None]) -> None:
        if sum(m.blocks for m in messages if m) != self.plan["count"]:
            raise OSError("Not every block was written")
        os.replace(self.temporary, self.target)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.temporary):
            os.unlink(self.temporary)
