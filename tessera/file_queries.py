"""Queries over recipes, tiles and files that are made from the given tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import recipe
from tessera.api import clip_rows, described_rows, open_tiles, reproject_rows, zonal_rows
from tessera.operators.collection import keyed as with_keys
from tessera.operators.tiles import decode_blocks, encode_blocks, read_window, running_total, to_pixels, to_tiles
from tessera.queries import ORACLE_SQL, QUERIES, P, O, keyed, order_prices, parts, plain, query, read, sizes
from tessera.model import Band
from tessera.shared import kept, scratch_folder, work_dir
from tessera.sources.raster_files import read_raster, write_raster
from tessera.sources.tiff import COMPRESSIONS

ORDERS = f"WITH {O} SELECT band::BIGINT AS band, x, y, raw FROM o"
BLOCK = 32


def recipes(spark, sf_dir: str) -> DataFrame:
    """A recipe without steps for each part; null for every 50th."""
    k = F.col("p_partkey")
    grid = F.struct(F.lit(20).alias("width"), F.lit(10).alias("height"), *(F.lit(v).alias(n) for n, v in (("m00", 1.0), ("m10", 0.0), ("m01", 0.0), ("m11", -1.0), ("m02", 0.5), ("m12", 9.5))))
    band = F.struct(F.lit("Band 1").alias("name"), F.lit(4).alias("data_type"), F.col("p_retailprice").alias("no_data"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"))
    none = F.lit(None).cast("string")
    descriptor = F.struct(grid.alias("grid"), none.alias("crs_wkt"), none.alias("authority"), F.array(band).alias("bands"), F.lit("NUMERIC").alias("color"), F.lit(-1).alias("alpha_band"), F.lit(False).alias("associated_alpha"), F.array().cast("array<int>").alias("palette"))
    source = F.struct(F.concat(F.lit("/data/part-"), k.cast("string"), F.lit(".tif")).alias("location"), none.alias("identity"))
    value = F.struct(source.alias("source"), descriptor.alias("descriptor"), F.array().cast(f"array<{recipe.STEP_TYPE}>").alias("steps")).cast(recipe.RASTER_TYPE)
    return read(spark, sf_dir, "part").select(k.alias("key"), F.col("p_size").cast("long").alias("size"), F.when(k % 50 != 0, value).alias("raster"))


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 50 <> 0 THEN 144 + length('/data/part-' || p_partkey || '.tif') END AS n_bytes, CASE WHEN p_partkey % 50 <> 0 THEN 'Raster[20x10, 1 bands, 0 operations]' END AS text, true AS same FROM part")
def recipe_codec_roundtrip(spark, sf_dir):
    coded = recipe.with_decoded(recipe.with_encoded(recipes(spark, sf_dir)), to="back")
    return coded.select("key", F.length("encoded").cast("long").alias("n_bytes"), recipe.text_of(F.col("back")).alias("text"), F.col("raster").eqNullSafe(F.col("back")).alias("same"))


@query("SELECT p_partkey AS key, row_number() OVER (PARTITION BY p_size ORDER BY (p_partkey % 50 = 0) DESC, length(p_partkey::VARCHAR), p_partkey::VARCHAR) AS place FROM part WHERE p_partkey % 50 <> 0")
def recipe_order(spark, sf_dir):
    """Recipes in the order of their binary form, among parts of a size."""
    coded = recipe.with_encoded(recipes(spark, sf_dir).where("raster IS NOT NULL"))
    return coded.select("key", F.row_number().over(Window.partitionBy("size").orderBy("encoded")).cast("long").alias("place"))


@query(ORDERS)
def tile_roundtrip(spark, sf_dir):
    r = order_prices(spark, sf_dir)
    return plain(to_pixels(to_tiles(r, BLOCK), r.descriptor).pixels)


@query(f"WITH {O} SELECT x, y, raw FROM o WHERE x BETWEEN 10 AND 40 AND y BETWEEN 5 AND 24")
def tile_window(spark, sf_dir):
    got = read_window(to_tiles(order_prices(spark, sf_dir), 16), 10, 5, 31, 20, 0, 16)
    return got.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "raw")


@query(
    f"WITH {O}, t AS (SELECT x // 16 AS tile_x, y // 16 AS tile_y, count(*) * 8 AS n FROM o GROUP BY ALL) SELECT tile_x, tile_y, n, (coalesce(sum(n + 8) OVER (ORDER BY tile_y, tile_x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 4)::BIGINT AS place FROM t"
)
def cog_block_order(spark, sf_dir):
    """Where each block of a COG starts: its size before it, its last bytes again after it."""
    tiles = to_tiles(order_prices(spark, sf_dir), 16).select(F.col("tile_x").cast("long").alias("tile_x"), F.col("tile_y").cast("long").alias("tile_y"), (F.size("samples") * 8).cast("long").alias("n"))
    return running_total(tiles, F.col("n") + 8, [F.col("tile_y")], [F.col("tile_x")], "place").withColumn("place", (F.col("place") + 4).cast("long"))


def codec_query(name: str):
    def run(spark, sf_dir):
        r = order_prices(spark, sf_dir)
        blocks = encode_blocks(to_tiles(r, BLOCK), r.descriptor, BLOCK, name)
        return plain(to_pixels(decode_blocks(blocks, r.descriptor, BLOCK, name), r.descriptor).pixels)

    run.__name__ = f"codec_roundtrip_{name.lower()}"
    return query(ORDERS)(run)


for codec in COMPRESSIONS:
    codec_query(codec)


def written(spark, raster, name: str, **options) -> str:
    path = f"{scratch_folder(spark, 'rasters')}/{name}"
    write_raster(raster, path, work_dir(spark), block=BLOCK, **options)
    return path


@query(ORDERS)
def geotiff_roundtrip(spark, sf_dir):
    return plain(read_raster(spark, written(spark, order_prices(spark, sf_dir), "orders.tif", compression="ZSTD")).pixels)


@query(f"WITH {P} SELECT band::BIGINT AS band, x - 3 AS x, y - 2 AS y, raw FROM p WHERE band = 1 AND x BETWEEN 3 AND 16 AND y BETWEEN 2 AND 7")
def geotiff_scan(spark, sf_dir):
    """One band of a window of a file with two bands."""
    r = keyed(spark, sf_dir, "part", "p_partkey", 20, [F.col("p_size"), F.rint(F.col("p_retailprice") * 100)], [Band("Band 1", 3, -1.0, 0.5, 100.0), Band("Band 2", 3, -1.0)])
    return plain(read_raster(spark, written(spark, r, "parts.tif"), bands=[1], window=(3, 2, 17, 8)).pixels)


@query(ORDERS)
def cog_roundtrip(spark, sf_dir):
    path = written(spark, order_prices(spark, sf_dir), "orders-cog.tif", format="COG", overview="AUTO", compression="Deflate")
    return plain(read_raster(spark, path).pixels)


#: Rows of the orders raster that make one file of many.
STRIP = 6


def strips(spark, sf_dir: str) -> DataFrame:
    """(strip, raster): the orders raster as files of STRIP rows, written by tasks, with their recipes."""
    folder = scratch_folder(spark, "strips")
    key = F.col("o_orderkey")
    cells = read(spark, sf_dir, "orders").select(F.floor(key / (50 * STRIP)).alias("strip"), (key % 50).cast("int").alias("x"), F.floor(key % (50 * STRIP) / 50).cast("int").alias("y"), F.rint(F.col("o_totalprice") * 100).alias("raw"))

    def write(table):
        import numpy as np
        import pyarrow as pa

        from tessera.model import Descriptor, Grid
        from tessera.sources.tiff import compress, head

        strip = table.column("strip")[0].as_py()
        block = np.zeros((64, 64), "<f8")
        block[table.column("y").to_numpy(), table.column("x").to_numpy()] = table.column("raw").to_numpy()
        d, data = Descriptor(Grid.north_up(50, STRIP, 1.0, 0.0, 10.0 * strip), (Band("Band 1", 5, -1.0),), "EPSG:2056"), compress("Deflate", block.tobytes())
        start = len(head([(d, [0], [0])], "Deflate", 64, False, False))
        path = f"{folder}/{strip}.tif"
        with open(f"{path}.tmp", "wb") as f:
            f.write(head([(d, [start], [len(data)])], "Deflate", 64, False, False) + data)
        os.replace(f"{path}.tmp", path)
        return pa.table({"strip": [strip], "location": [path]})

    files = kept(cells.groupBy("strip").applyInArrow(write, "strip long, location string"), "strips")
    return described_rows(files).join(files, "location").select("strip", "raster")


def strip_box(x0: float, x1: float) -> Column:
    """A box over a part of each strip."""
    low, high = (F.col("strip") * 10 + F.lit(v) for v in (1.25, 4.75))
    corner = lambda x, y: F.concat_ws(" ", F.lit(str(x)), y.cast("string"))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(x0, low), corner(x1, low), corner(x1, high), corner(x0, high), corner(x0, low)), F.lit("))"))


@query(
    f"""WITH {O}, t AS (SELECT y // {STRIP} AS strip, (2 * x + u + 0.5) / 2 AS wx, y // {STRIP} * 10 + {STRIP} - (2 * (y % {STRIP}) + v + 0.5) / 2 AS wy, raw FROM o, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(u, v))
SELECT strip, count(*) AS count, round(avg(raw), 6) AS mean, min(raw) AS min, max(raw) AS max, sum(raw) AS sum, round(stddev_pop(raw), 6) AS stddev, 'OK' AS status FROM t
WHERE wx BETWEEN 10.25 AND 30.75 AND wy - strip * 10 BETWEEN 1.25 AND 4.75 GROUP BY strip"""
)
def zonal_many_files(spark, sf_dir):
    """A file and a zone for each strip: reprojected and summed up in one plan."""
    rows = kept(reproject_rows(strips(spark, sf_dir), 0.5).withColumn("wkt", strip_box(10.25, 30.75)), "warped")
    return zonal_rows(rows).drop("raster", "wkt").withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query(f"WITH {O} SELECT y // {STRIP} AS strip, x - 7 AS x, y % {STRIP} - 1 AS y, CASE WHEN x + 0.5 BETWEEN 7.75 AND 40.25 THEN raw ELSE -1 END AS raw FROM o WHERE x BETWEEN 7 AND 40 AND y % {STRIP} BETWEEN 1 AND 4")
def clip_many_files(spark, sf_dir):
    """Every strip's file clipped and masked by its own polygon, in one plan."""
    rows = kept(clip_rows(strips(spark, sf_dir).withColumn("wkt", strip_box(7.75, 40.25)), "wkt", mask=True), "clipped")
    tiles = open_tiles(rows).join(with_keys(rows).select("key", "strip"), "key").select("strip", "x", "y", "width", F.posexplode("samples").alias("at", "raw"))
    return tiles.select("strip", (F.col("x") + F.col("at") % F.col("width")).cast("long").alias("x"), (F.col("y") + F.floor(F.col("at") / F.col("width"))).cast("long").alias("y"), "raw")


@query(None)
def warp_lv95_to_wgs84(spark, sf_dir):
    """Swiss coordinates to longitude and latitude; tested against round trips and known points."""
    r = sizes(spark, sf_dir)
    from dataclasses import replace

    from tessera.raster import Raster

    moved = replace(r.grid, m02=r.grid.m02 + 2_600_000, m12=r.grid.m12 + 1_200_000)
    return plain(Raster(r.pixels, replace(r.descriptor, grid=moved)).reproject(1e-5, output_no_data=-9999.0, target_crs="EPSG:4326").pixels)


__all__ = ["ORACLE_SQL", "QUERIES", "parts"]
