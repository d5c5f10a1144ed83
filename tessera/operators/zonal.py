"""Zonal statistics: zones and pixels meet by tile, whole tiles where they can, and sums are exact.

A zone is cut into the tiles of its window. Tiles that lie inside it count as
a whole; tiles on its boundary keep the edges near them and test their pixels;
others are left out. Pixels are gathered in the same tiles, once, and meet the
zones' pieces by an equi-join. What comes of a piece is a count, the extremes
and limbs of the sums (:mod:`tessera.functions.exact`), which add up in any
order to the same last digit.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tessera.functions import coverage, exact
from tessera.functions.geometry import aligned, parse_polygon, rings_in_pixels
from tessera.functions.pixel import finite, physical, stored_no_data, valid
from tessera.raster import Raster

#: Pixels of a join tile's side: a zone meets the pixels of the tiles that its window touches.
JOIN_TILE = 64
STATISTICS = ("count", "mean", "min", "max", "sum", "stddev")
#: Places that rows about zones themselves are dealt to, by tiles that no raster has.
SPREAD = 1024
PIECE = "tile_x int, tile_y int, near array<double>, parity binary"
PARTIAL = "place int, limb long, square long, count long, min double, max double"


def statistic(name: str):
    """A statistic's column by name."""
    if name not in STATISTICS:
        raise ValueError(f"Unknown statistic {name}")
    return F.col(name)


def pieces_of(wkt: str | None, grid, crs: str | None, given: str | None, tile: int) -> list[tuple] | None:
    """(tile_x, tile_y, near edges, parity) of a zone over a grid, None for an empty zone; an invalid one is an error."""
    text = aligned(wkt, crs, given)
    edges = rings_in_pixels(parse_polygon(text), grid) if text else []
    if not len(edges):
        return None
    box = coverage.box_of(edges, grid.width, grid.height)
    if box is None:
        return []
    return [(x, y, None if near is None else near.ravel(), None if parity is None else parity.tobytes()) for x, y, near, parity in coverage.zone_tiles(edges, box, tile)]


def zone_pieces(zones: DataFrame, grid, crs: str | None, zone_crs: str | None, tile: int) -> DataFrame:
    """Pieces of zones (zone_id, wkt, n), and one row for each zone itself on a tile outside the raster.

    Zones have their content's digest as key, so it doesn't matter how often,
    where or in which order they are read.
    """
    kind = dict(zones.dtypes)["zone_id"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.binary(), None, pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.binary()]
        names = ["key", "zone_id", "n", "empty", "tile_x", "tile_y", "near", "parity"]
        for batch in batches:
            kinds[1], out, held = batch.schema.field(1).type, [], 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)  # noqa: B023

            for key, zone, n, wkt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = pieces_of(wkt, grid, crs, zone_crs, tile)
                out.append((key, zone, n, found is None, -1 - key[0] * 4 % SPREAD, -1, None, None))
                for piece in found or []:
                    out.append((key, None, None, None, *piece))
                    held += 0 if piece[2] is None else len(piece[2])
                    if held > 1_000_000 or len(out) > 100_000:
                        yield made()
                        out, held = [], 0
            if out:
                yield made()

    keyed = zones.select(F.unhex(F.sha2(F.to_json(F.struct("zone_id", "wkt")), 256)).alias("key"), "zone_id", "n", "wkt")
    return keyed.mapInArrow(run, f"key binary, zone_id {kind}, n long, empty boolean, {PIECE}")


def pixel_tiles(pixels: DataFrame, tile: int) -> DataFrame:
    """(tile_x, tile_y, ps) from pixels (x, y, v): places in the tile and values, tile * tile at most."""
    x, y = F.col("x"), F.col("y")
    placed = pixels.select(F.floor(x / tile).cast("int").alias("tile_x"), F.floor(y / tile).cast("int").alias("tile_y"), F.struct(((y % tile) * tile + x % tile).cast("int").alias("at"), "v").alias("p"))
    return placed.groupBy("tile_x", "tile_y").agg(F.collect_list("p").alias("ps")).select("tile_x", "tile_y", F.col("ps.at").alias("at"), F.col("ps.v").alias("v"))


def partial(values) -> list[tuple]:
    """Rows (place, limb, square, count, min, max) of values: one for each place of limbs, the first with count and extremes."""
    if not len(values):
        return []
    sums, squares = exact.parts_of(values)
    places = sorted({*sums, *squares}) or [0]
    low, high = float(values.min()), float(values.max())
    return [(k, sums.get(k, 0), squares.get(k, 0), *((len(values), low, high) if k == places[0] else (0, None, None))) for k in places]


def piece_statistics(met: DataFrame, tile: int) -> DataFrame:
    """Partial statistics of pieces that met their tile's pixels; rows about zones pass through."""
    fields = {f.name: f for f in met.schema.fields}
    names = ["key", "zone_id", "n", "empty"]
    schema = StructType([*(fields[c] for c in names), *(StructField(c, k) for c, k in (("place", IntegerType()), ("limb", LongType()), ("square", LongType()), ("count", LongType()), ("min", DoubleType()), ("max", DoubleType())))])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        last, whole = None, []
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            of = lambda c, i: col[c][i].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
            out, origin = [], []
            for i, (tx, ty) in enumerate(zip(col["tile_x"].to_pylist(), col["tile_y"].to_pylist(), strict=True)):
                if ty < 0:
                    rows = [(None,) * 6]
                elif not col["v"][i].is_valid:
                    rows = []
                elif not col["near"][i].is_valid:
                    if last != (tx, ty):  # zones that hold a tile share its sums
                        last, whole = (tx, ty), partial(of("v", i))
                    rows = whole
                else:
                    covered = coverage.mask(of("near", i).reshape(-1, 4), np.frombuffer(col["parity"][i].as_py(), dtype=bool), tx, ty, tile).ravel()
                    rows = partial(of("v", i)[covered[of("at", i)]])
                out += rows
                origin += [i] * len(rows)
            if out:
                places = pa.array(origin, pa.int64())
                yield pa.RecordBatch.from_arrays([*(col[c].take(places) for c in names), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=schema.names)

    return met.select(*names, "tile_x", "tile_y", "near", "parity", "at", "v").mapInArrow(run, schema)


def merged(parts: DataFrame) -> DataFrame:
    """One row for each key with its limbs gathered: some 140 at most."""
    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    by_place = parts.groupBy("key", "place").agg(whole("limb"), whole("square"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), F.first("zone_id", ignorenulls=True).alias("zone_id"), F.max("n").alias("n"), F.max("empty").alias("empty"))
    limbs = F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", F.col("limb").cast("string").alias("limb"), F.col("square").cast("string").alias("square"))))
    return by_place.groupBy("key").agg(limbs.alias("limbs"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), F.first("zone_id", ignorenulls=True).alias("zone_id"), F.max("n").alias("n"), F.max("empty").alias("empty"))


def finished(found: DataFrame) -> DataFrame:
    """Statistics of merged rows, each rounded once."""
    zone = found.schema["zone_id"]
    kinds = (("count", LongType()), ("mean", DoubleType()), ("min", DoubleType()), ("max", DoubleType()), ("sum", DoubleType()), ("stddev", DoubleType()), ("status", StringType()))
    schema = StructType([StructField("zone_id", zone.dataType), StructField("n", LongType()), *(StructField(c, k) for c, k in kinds)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for limbs, count, low, high, empty in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5, 6)), strict=True):
                if not count:
                    out.append((0, None, None, None, None, None, "EMPTY_GEOMETRY" if empty else "NO_VALID_PIXELS"))
                    continue
                mean, total, deviation = exact.statistics(count, *({x["place"]: int(x[c]) for x in limbs} for c in ("limb", "square")))
                out.append((count, mean, low, high, total, deviation, "OK"))
            arrow = [pa.int64(), *[pa.float64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in out], arrow[k]) for k in range(7))], names=schema.names)

    return found.select("zone_id", "n", "limbs", "count", "min", "max", "empty").mapInArrow(run, schema)


def zonal_statistics(raster: Raster, zones: DataFrame, band: int = 0, no_data: float | None = None, zone_id: str = "zone_id", wkt: str = "wkt", tile: int = JOIN_TILE, zone_crs: str | None = None) -> DataFrame:
    """count, mean, min, max, sum, stddev (population) and status for each zone.

    A pixel counts if its centre lies in the zone or on its boundary, its raw
    value is valid (``no_data`` replaces the band's own) and its physical value
    finite. A null or empty zone is EMPTY_GEOMETRY, one without such pixels
    NO_VALID_PIXELS. Zones that repeat an id are one row each. A zone's system
    is its ``SRID=n;``, else ``zone_crs``, else the raster's; where it differs
    from the raster's its coordinates are transformed. An unknown system or an
    invalid polygon is an error. Sums are exact until they are rounded, so
    results don't depend on the partitioning.
    """
    if not 0 <= band < len(raster.descriptor.bands):
        raise ValueError("The raster has no such band")
    own, grid = raster.descriptor.bands[band], raster.grid
    shapes = zones.select(zones[zone_id].alias("zone_id"), zones[wkt].alias("wkt")).groupBy("zone_id", "wkt").agg(F.count(F.lit(1)).alias("n"))
    pieces = zone_pieces(shapes, grid, raster.descriptor.crs, zone_crs, tile)
    raw = F.col("raw")
    value = physical(raw, own.scale, own.offset)
    fine = valid(raw, stored_no_data(own.no_data, own.data_type), no_data) & finite(value)
    tiles = pixel_tiles(raster.pixels.where((F.col("band") == band) & fine).select("x", "y", value.alias("v")), tile)
    found = finished(merged(piece_statistics(pieces.join(tiles, ["tile_x", "tile_y"], "left"), tile)))
    each = found.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select("zone_id", *STATISTICS, "status")
