"""Raster queries over rasters that the given tables hold, with their oracle SQL.

Tables with contiguous keys are read as rasters: ``part`` is 20 wide (bands
size and price), ``orders`` 50 wide (price), ``embeddings`` has a row for each
vector, ``events`` is 25 wide. World coordinates have the lower left corner at
(0, 0) and pixels of side 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.pixel import convert, finite, physical, pixel, stored_no_data, valid, world
from tessera.model import Band, Descriptor, Grid
from tessera.operators.overview import halve
from tessera.operators.zonal import zonal_statistics
from tessera.raster import Raster, from_table

SENTINEL = 7.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def height(df: DataFrame, key: str, width: int) -> int:
    """Rows of pixels; from the key's statistics."""
    return (df.agg(F.max(key)).first()[0] or 0) // width + 1


def keyed(spark: SparkSession, sf_dir: str, name: str, key: str, width: int, values: list[Column], bands: list[Band], **more) -> Raster:
    df = read(spark, sf_dir, name)
    grid = Grid.north_up(width, height(df, key, width))
    return from_table(df, F.col(key) % width, F.floor(F.col(key) / width), values, Descriptor(grid, tuple(bands), "EPSG:2056", **more))


def parts(spark: SparkSession, sf_dir: str, no_data: float | None = SENTINEL, kind: int = 1) -> Raster:
    """Bands 0: size, with a sentinel; 1: price in cents, scaled."""
    bands = [Band("Band 1", kind, no_data, 0.5, 100.0), Band("Band 2", 3, no_data, 0.25, 0.0)]
    return keyed(spark, sf_dir, "part", "p_partkey", 20, [F.col("p_size"), F.rint(F.col("p_retailprice") * 100)], bands)


def sizes(spark: SparkSession, sf_dir: str, no_data: float | None = SENTINEL, kind: int = 5) -> Raster:
    return keyed(spark, sf_dir, "part", "p_partkey", 20, [F.col("p_size")], [Band("Band 1", kind, no_data)])


def order_prices(spark: SparkSession, sf_dir: str) -> Raster:
    return keyed(spark, sf_dir, "orders", "o_orderkey", 50, [F.rint(F.col("o_totalprice") * 100)], [Band("Band 1", 5, -1.0)])


def colours(spark: SparkSession, sf_dir: str, alpha: bool = False) -> Raster:
    """A UInt8 RGB raster from orders; with alpha from the order's key."""
    key = F.col("o_orderkey")
    values = [(F.rint(F.col("o_totalprice") * 100) + 71 * b) % 256 for b in range(3)] + ([key * 37 % 256] if alpha else [])
    return keyed(spark, sf_dir, "orders", "o_orderkey", 50, values, [Band(f"Band {i + 1}", 0) for i in range(len(values))], color="RGB", alpha_band=3 if alpha else -1)


#: The same rasters in SQL.
P = """p AS (SELECT band, x, y, raw FROM (
  SELECT 0 AS band, p_partkey % 20 AS x, p_partkey // 20 AS y, p_size::DOUBLE AS raw FROM part
  UNION ALL SELECT 1, p_partkey % 20, p_partkey // 20, round_even(p_retailprice * 100, 0) FROM part)),
ph AS (SELECT max(p_partkey) // 20 + 1 AS h FROM part)"""
O = """o AS (SELECT 0 AS band, o_orderkey % 50 AS x, o_orderkey // 50 AS y, round_even(o_totalprice * 100, 0) AS raw FROM orders),
oh AS (SELECT max(o_orderkey) // 50 + 1 AS h FROM orders)"""
RGB = """c AS (SELECT o_orderkey % 50 AS x, o_orderkey // 50 AS y, round_even(o_totalprice * 100, 0) % 256 AS r, (round_even(o_totalprice * 100, 0) + 71) % 256 AS g,
  (round_even(o_totalprice * 100, 0) + 142) % 256 AS b, (o_orderkey * 37 % 256)::DOUBLE AS a FROM orders),
oh AS (SELECT max(o_orderkey) // 50 + 1 AS h FROM orders)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """Pixels as every query returns them."""
    return df.select(F.col("band").cast("long").alias("band"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "raw")


# --- Scalar functions -------------------------------------------------------


@query(f"WITH {P} SELECT band::BIGINT AS band, x, y, raw <> 7 AS valid, raw <> 20 AS valid_override FROM p")
def px_valid(spark, sf_dir):
    r = parts(spark, sf_dir)
    return r.pixels.select(F.col("band").cast("long").alias("band"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), valid(F.col("raw"), SENTINEL).alias("valid"), valid(F.col("raw"), SENTINEL, 20.0).alias("valid_override"))


@query(f"WITH {P} SELECT band::BIGINT AS band, x, y, CASE band WHEN 0 THEN raw * 0.5 + 100.0 ELSE raw * 0.25 END AS raw FROM p")
def px_physical(spark, sf_dir):
    r = parts(spark, sf_dir)
    value = F.lit(None).cast("double")
    for i, b in enumerate(r.descriptor.bands):
        value = F.when(F.col("band") == i, physical(F.col("raw"), b.scale, b.offset)).otherwise(value)
    return plain(r.pixels.withColumn("raw", value))


@query(f"WITH {P} SELECT band::BIGINT AS band, x, y, round_even(raw * 5.1, 0) AS raw FROM p WHERE band = 0")
def px_convert_uint8(spark, sf_dir):
    return plain(sizes(spark, sf_dir).pixels.withColumn("raw", convert(F.col("raw") * 5.1, 0)))


@query(f"WITH {P} SELECT band::BIGINT AS band, x, y, round_even(raw / 4, 0) AS raw FROM p WHERE band = 0")
def px_rint_half_even(spark, sf_dir):
    return plain(sizes(spark, sf_dir).pixels.withColumn("raw", convert(F.col("raw") / 4, 2)))


@query("SELECT event_id % 25 AS x, event_id // 25 AS y, (value / 3)::FLOAT::DOUBLE AS raw FROM events")
def px_convert_float32(spark, sf_dir):
    r = keyed(spark, sf_dir, "events", "event_id", 25, [F.col("value")], [Band("Band 1", 5, -1.0)])
    return plain(r.pixels.withColumn("raw", convert(F.col("raw") / 3, 4))).drop("band")


@query(f"WITH {P} SELECT x, y, x + 0.5 AS wx, h - 0.5 - y AS wy FROM p, ph WHERE band = 0")
def px_world_coords(spark, sf_dir):
    r = sizes(spark, sf_dir)
    wx, wy = world(r.grid, F.col("x").cast("double"), F.col("y").cast("double"))
    return r.pixels.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), wx.alias("wx"), wy.alias("wy"))


@query("SELECT event_id, value - 0.5 AS px, (SELECT max(p_partkey) // 20 + 1 FROM part) - 0.5 - event_id % 97 * 0.25 AS py FROM events")
def px_world_inverse(spark, sf_dir):
    r = sizes(spark, sf_dir)
    px, py = pixel(r.grid, F.col("value"), F.col("event_id") % 97 * 0.25)
    return read(spark, sf_dir, "events").select("event_id", px.alias("px"), py.alias("py"))


@query(f"WITH {P} SELECT band::BIGINT AS band, count(*) FILTER (raw <> 7) AS own, count(*) FILTER (raw <> 20) AS override, sum(raw) FILTER (raw <> 20) AS sum_override FROM p GROUP BY band")
def nodata_override(spark, sf_dir):
    raw = F.col("raw")
    ok, other = valid(raw, SENTINEL), valid(raw, SENTINEL, 20.0)
    return parts(spark, sf_dir).pixels.groupBy(F.col("band").cast("long").alias("band")).agg(F.count(F.when(ok, 1)).alias("own"), F.count(F.when(other, 1)).alias("override"), F.sum(F.when(other, raw)).alias("sum_override"))


# --- Zonal statistics -------------------------------------------------------


def zones(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A zone for each nation: coordinates that binary fractions hold exactly."""
    k = F.col("n_nationkey")
    x0, y0 = (k % 8 * 2).cast("double"), (k % 5).cast("double")
    x1, y1 = x0 + 4.5, y0 + 3.5 + k % 3
    ring = lambda *ps: F.concat(F.lit("("), F.concat_ws(", ", *(F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in (*ps, ps[0]))), F.lit(")"))
    box = lambda a, b, c, d: ring((a, b), (c, b), (c, d), (a, d))
    poly = lambda *rings: F.concat(F.lit("POLYGON ("), F.concat_ws(", ", *rings), F.lit(")"))
    if kind == "rect":
        wkt = poly(box(x0, y0, x1, y1))
    elif kind == "triangle":
        wkt = poly(ring((x0, y0), (x1, y0), (x0, y1)))
    elif kind == "donut":
        wkt = poly(box(x0, y0, x1, y1), box(x0 + 1.5, y0 + 1.5, x0 + 3.0, y0 + 2.5))
    elif kind == "multipart":
        wkt = F.concat(F.lit("MULTIPOLYGON (("), box(x0, y0, x0 + 1.5, y1), F.lit("), ("), box(x0 + 3.0, y0, x1, y1), F.lit("))"))
    else:
        outside = poly(box(F.lit(1000.0), y0, F.lit(1001.0), y1))
        wkt = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, F.lit("POLYGON EMPTY")).when(k % 5 == 2, outside).otherwise(poly(box(x0, y0, x1, y1)))
    return read(spark, sf_dir, "nation").select(k.cast("long").alias("zone_id"), wkt.alias("wkt"))


Z = """z AS (SELECT n_nationkey::BIGINT AS zone_id, n_nationkey % 8 * 2.0::DOUBLE AS x0, (n_nationkey % 5)::DOUBLE AS y0,
  n_nationkey % 8 * 2 + 4.5::DOUBLE AS x1, n_nationkey % 5 + 3.5::DOUBLE + n_nationkey % 3 AS y1 FROM nation)"""
STATS = """count(v) AS count, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, sum(v) AS sum, round(stddev_pop(v), 6) AS stddev,
  CASE WHEN count(v) > 0 THEN 'OK' ELSE 'NO_VALID_PIXELS' END AS status"""
BOX = "wx BETWEEN x0 AND x1 AND wy BETWEEN y0 AND y1"


def zonal_sql(inside: str, value: str = "raw", where: str = "band = 0 AND raw <> 7") -> str:
    return f"WITH {P}, {Z}, w AS (SELECT x + 0.5 AS wx, h - 0.5 - y AS wy, {value} AS v FROM p, ph WHERE {where}) SELECT zone_id, {STATS} FROM z LEFT JOIN w ON {inside} GROUP BY zone_id"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query(zonal_sql(BOX))
def zonal_rect(spark, sf_dir):
    return rounded(sizes(spark, sf_dir).zonal(zones(spark, sf_dir, "rect")))


@query(zonal_sql("wx BETWEEN x0 + 0.25 AND x1 + 0.25 AND wy BETWEEN y0 + 0.25 AND y1 + 0.25"))
def zonal_srid(spark, sf_dir):
    """Zones in longitude and latitude (SRID 4326) over a raster in Mercator metres; the SQL takes the metres."""
    r = sizes(spark, sf_dir)
    metres = Raster(r.pixels, replace(r.descriptor, crs="EPSG:3857"))
    radius, point = 6378137.0, r"(-?[0-9.]+) (-?[0-9.]+)"
    # A quarter of a pixel off, so that no pixel centre lies on an edge.
    lon = lambda x: F.degrees((x.cast("double") + 0.25) / radius)
    lat = lambda y: F.degrees(2 * F.atan(F.exp((y.cast("double") + 0.25) / radius)) - F.lit(math.pi) / 2)
    pairs = F.transform(F.regexp_extract_all("wkt", F.lit(point), F.lit(0)), lambda p: F.concat_ws(" ", lon(F.split(p, " ")[0]).cast("string"), lat(F.split(p, " ")[1]).cast("string")))
    wkt = F.concat(F.lit("SRID=4326;POLYGON (("), F.array_join(pairs, ", "), F.lit("))"))
    return rounded(metres.zonal(zones(spark, sf_dir, "rect").withColumn("wkt", wkt)))


@query(f"WITH {P}, d AS (SELECT x, y, raw FROM p WHERE band = 0 AND raw <> 7) SELECT (x // 5)::BIGINT AS x, (y // 5)::BIGINT AS y, count(*) AS n FROM d WHERE x % 5 = 2 AND y % 5 = 2 GROUP BY ALL")
def warp_bilinear_down(spark, sf_dir):
    """A fifth of the resolution: each target's centre is a source pixel's, whose weight is 1."""
    out = sizes(spark, sf_dir).reproject(5.0, interpolation="BILINEAR", output_no_data=-9999.0).pixels
    return out.where("raw <> -9999.0").groupBy(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query(zonal_sql("wx >= x0 AND wy >= y0 AND (wx - x0) * (y1 - y0) + (wy - y0) * (x1 - x0) <= (x1 - x0) * (y1 - y0)"))
def zonal_triangle(spark, sf_dir):
    return rounded(sizes(spark, sf_dir).zonal(zones(spark, sf_dir, "triangle")))


@query(zonal_sql(f"{BOX} AND NOT (wx > x0 + 1.5 AND wx < x0 + 3 AND wy > y0 + 1.5 AND wy < y0 + 2.5)"))
def zonal_donut(spark, sf_dir):
    return rounded(sizes(spark, sf_dir).zonal(zones(spark, sf_dir, "donut")))


@query(zonal_sql(f"{BOX} AND (wx <= x0 + 1.5 OR wx >= x0 + 3)"))
def zonal_multipart(spark, sf_dir):
    return rounded(sizes(spark, sf_dir).zonal(zones(spark, sf_dir, "multipart")))


@query(zonal_sql(BOX, where="band = 0 AND raw <> 20"))
def zonal_override(spark, sf_dir):
    return rounded(sizes(spark, sf_dir).zonal(zones(spark, sf_dir, "rect"), no_data=20.0))


@query(zonal_sql(BOX, value="raw * 0.25", where="band = 1 AND raw <> 7"))
def zonal_scaled_band(spark, sf_dir):
    return rounded(parts(spark, sf_dir).zonal(zones(spark, sf_dir, "rect"), band=1))


@query(
    zonal_sql(f"zone_id % 5 > 2 AND {BOX}").replace(
        "CASE WHEN count(v) > 0 THEN 'OK' ELSE", "CASE WHEN zone_id % 5 < 2 THEN 'EMPTY_GEOMETRY' WHEN count(v) > 0 THEN 'OK' ELSE"
    )
)
def zonal_status(spark, sf_dir):
    return rounded(sizes(spark, sf_dir).zonal(zones(spark, sf_dir, "status")))


@query(
    f"""WITH {O}, z AS (SELECT n_nationkey::BIGINT AS zone_id, n_nationkey % 5 * 10.0 AS x0, n_nationkey % 5 * 10 + 17.5 AS x1,
  h * n_nationkey // 25 AS y0, h * (n_nationkey + 4) // 25 + 0.5 AS y1 FROM nation, oh),
w AS (SELECT x + 0.5 AS wx, h - 0.5 - y AS wy, raw AS v FROM o, oh) SELECT zone_id, {STATS} FROM z LEFT JOIN w ON {BOX} GROUP BY zone_id"""
)
def zonal_orders(spark, sf_dir):
    """Zones that grow with the raster."""
    r = order_prices(spark, sf_dir)
    return rounded(r.zonal(growing_zones(spark, sf_dir, r)))


def growing_zones(spark: SparkSession, sf_dir: str, r: Raster) -> DataFrame:
    k = F.col("n_nationkey")
    x0, y0 = k % 5 * 10.0, F.floor(k * r.grid.height / 25).cast("double")
    x1, y1 = x0 + 17.5, F.floor((k + 4) * r.grid.height / 25) + 0.5
    corner = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(",", corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0)), F.lit("))"))
    return read(spark, sf_dir, "nation").select(k.cast("long").alias("zone_id"), wkt.alias("wkt"))


@query(
    f"""WITH {O}, z AS (SELECT n_nationkey::BIGINT AS zone_id, n_nationkey % 5 * 10.0 AS x0, n_nationkey % 5 * 10 + 17.5 AS x1,
  h * n_nationkey // 25 AS y0, h * (n_nationkey + 4) // 25 + 0.5 AS y1 FROM nation, oh),
w AS (SELECT x + 0.5 AS wx, h - 0.5 - y AS wy, raw::HUGEINT + CASE WHEN (x + y) % 2 = 0 THEN 4503599627370496 ELSE -4503599627370496 END AS v FROM o, oh)
SELECT zone_id, count(v) AS count, sum(v)::DOUBLE AS sum FROM z LEFT JOIN w ON {BOX} GROUP BY zone_id"""
)
def zonal_cancelling(spark, sf_dir):
    """Prices beside 2^52 of either sign: plain sums of doubles lose their last digits."""
    r = order_prices(spark, sf_dir)
    huge = F.when((F.col("x") + F.col("y")) % 2 == 0, 2.0**52).otherwise(-(2.0**52))
    r = Raster(r.pixels.withColumn("raw", F.col("raw") + huge), r.descriptor)
    return r.zonal(growing_zones(spark, sf_dir, r), no_data=float("nan")).select("zone_id", "count", "sum")


# --- Clip -------------------------------------------------------------------


def box_wkt(x0: float, y0: float, x1: float, y1: float) -> str:
    return f"POLYGON (({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"


def tall(r: Raster, x0: float, x1: float) -> str:
    """A box over most of the height."""
    return box_wkt(x0, 1.25, x1, r.grid.height - 1.25)


def triangle(r: Raster, width: int) -> str:
    return f"POLYGON ((0 0, {width} 0, 0 {r.grid.height}, 0 0))"


@query(f"WITH {P} SELECT band::BIGINT AS band, x - 2 AS x, y - 1 AS y, CASE WHEN raw = 7 THEN 7.0 ELSE raw END AS raw FROM p, ph WHERE x BETWEEN 2 AND 9 AND y BETWEEN 1 AND h - 2")
def clip_crop(spark, sf_dir):
    r = parts(spark, sf_dir)
    return plain(r.clip(tall(r, 2.25, 9.75)).pixels)


@query(f"WITH {P} SELECT band::BIGINT AS band, x - 2 AS x, y - 1 AS y, CASE WHEN x + 0.5 BETWEEN 2.75 AND 9.25 AND h - 0.5 - y BETWEEN 1.25 AND h - 1.25 AND raw <> 7 THEN raw ELSE 7 END AS raw FROM p, ph WHERE x BETWEEN 2 AND 9 AND y BETWEEN 1 AND h - 2")
def clip_mask_rect(spark, sf_dir):
    r = parts(spark, sf_dir)
    return plain(r.clip(tall(r, 2.75, 9.25), mask=True).pixels)


@query(f"WITH {P} SELECT band::BIGINT AS band, x, y, CASE WHEN (x + 0.5) * h + (h - 0.5 - y) * 16 <= 16 * h AND raw <> 7 THEN raw ELSE 7 END AS raw FROM p, ph WHERE x < 16")
def clip_mask_triangle(spark, sf_dir):
    r = parts(spark, sf_dir)
    return plain(r.clip(triangle(r, 16), mask=True).pixels)


@query(f"WITH {P} SELECT (1 - band)::BIGINT AS band, x - 2 AS x, y - 1 AS y, raw FROM p, ph WHERE x BETWEEN 2 AND 9 AND y BETWEEN 1 AND h - 2")
def clip_band_reorder(spark, sf_dir):
    r = parts(spark, sf_dir)
    return plain(r.clip(tall(r, 2.25, 9.75), bands=[1, 0]).pixels)


@query(f"WITH {P} SELECT band::BIGINT AS band, x - 2 AS x, y - 1 AS y, CASE WHEN raw = 20 THEN 20 ELSE raw END AS raw FROM p, ph WHERE band = 0 AND x BETWEEN 2 AND 9 AND y BETWEEN 1 AND h - 2")
def clip_nodata_override(spark, sf_dir):
    r = sizes(spark, sf_dir)
    return plain(r.clip(tall(r, 2.25, 9.75), no_data=20.0).pixels)


@query("SELECT 0::BIGINT AS band, event_id % 25 AS x, event_id // 25 AS y, CASE WHEN event_id % 11 = 0 OR value > 400 THEN -1 ELSE value END AS raw FROM events WHERE event_id % 25 < 20")
def clip_nodata_normalise(spark, sf_dir):
    """NaN and infinite samples become NoData, masked or not."""
    value = F.when(F.col("event_id") % 11 == 0, float("nan")).when(F.col("value") > 400, float("inf")).otherwise(F.col("value"))
    r = keyed(spark, sf_dir, "events", "event_id", 25, [value], [Band("Band 1", 5, -1.0)])
    return plain(r.clip(box_wkt(0, 0, 20, r.grid.height)).pixels)


RGB_LONG = "SELECT band::BIGINT AS band, x, y, raw FROM m, LATERAL (VALUES (0, r), (1, g), (2, b), (3, a)) AS v(band, raw)"


@query(f"WITH {RGB}, i AS (SELECT *, (x + 0.5) * h + (h - 0.5 - y) * 40 <= 40 * h AS s FROM c, oh WHERE x < 40), m AS (SELECT x, y, CASE WHEN s THEN r ELSE 0 END AS r, CASE WHEN s THEN g ELSE 0 END AS g, CASE WHEN s THEN b ELSE 0 END AS b, CASE WHEN s THEN 255.0::DOUBLE ELSE 0 END AS a FROM i) {RGB_LONG}")
def clip_rgb_add_alpha(spark, sf_dir):
    r = colours(spark, sf_dir)
    return plain(r.clip(triangle(r, 40), mask=True).pixels)


@query(f"WITH {RGB}, m AS (SELECT x - 5 AS x, y, r, g, b, CASE WHEN r = 10 AND g = 10 AND b = 10 THEN 0 ELSE a END AS a FROM c WHERE x BETWEEN 5 AND 44) {RGB_LONG}")
def clip_alpha_invalid_channels(spark, sf_dir):
    r = colours(spark, sf_dir, alpha=True)
    return plain(r.clip(box_wkt(5, 0, 45, r.grid.height), no_data=10.0).pixels)


@query(f"WITH {RGB}, m AS (SELECT x, y, b AS r, r AS g, NULL AS b, NULL AS a FROM c WHERE x < 40) {RGB_LONG} WHERE band < 2")
def clip_rgb_subset(spark, sf_dir):
    """Bands out of order are numeric."""
    r = colours(spark, sf_dir)
    return plain(r.clip(box_wkt(0, 0, 40, r.grid.height), bands=[2, 0], no_data=255.0).pixels)


# --- Reprojection -----------------------------------------------------------


def warp_sql(cells: str, nearest: bool, source: str = "band = 0 AND raw <> 7", missing: float = -9999.0, finish: str = "s / w", width: int = 20) -> str:
    """``cells`` selects (x, y, sx, sy) for each target pixel."""
    if nearest:
        met = "SELECT t.x, t.y, t.sx, t.sy, a.raw AS s, CASE WHEN a.raw IS NULL THEN 0 ELSE 1 END AS w FROM t LEFT JOIN q a ON a.x = floor(t.sx + 0.5) AND a.y = floor(t.sy + 0.5)"
    else:
        part = lambda k, dx, dy: f"LEFT JOIN q a{k} ON a{k}.x = floor(t.sx) + {dx} AND a{k}.y = floor(t.sy) + {dy}"
        fx, fy = "(t.sx - floor(t.sx))", "(t.sy - floor(t.sy))"
        ws = [f"(1 - {fx}) * (1 - {fy})", f"{fx} * (1 - {fy})", f"(1 - {fx}) * {fy}", f"{fx} * {fy}"]
        s = " + ".join(f"{w} * coalesce(a{k}.raw, 0)" for k, w in enumerate(ws))
        w = " + ".join(f"{w} * CASE WHEN a{k}.raw IS NULL THEN 0 ELSE 1 END" for k, w in enumerate(ws))
        met = f"SELECT t.x, t.y, t.sx, t.sy, {s} AS s, {w} AS w FROM t {part(0, 0, 0)} {part(1, 1, 0)} {part(2, 0, 1)} {part(3, 1, 1)}"
    return f"""WITH {P}, q AS (SELECT x, y, raw FROM p WHERE {source}), t AS ({cells}), m AS ({met})
SELECT 0::BIGINT AS band, m.x::BIGINT AS x, m.y::BIGINT AS y, CASE WHEN w > 0 AND sx >= -0.5 AND sx < {width} - 0.5 AND sy >= -0.5 AND sy < h - 0.5 THEN {finish} ELSE {missing} END AS raw FROM m, ph"""


def grid_sql(width: str, rows: str, sx: str, sy: str) -> str:
    return f"SELECT x, y, {sx} AS sx, {sy} AS sy FROM ph, LATERAL (SELECT unnest(range({rows})) AS y) AS b, LATERAL (SELECT unnest(range({width})) AS x) AS a"


SAME = grid_sql("20", "h", "x::DOUBLE", "y::DOUBLE")
UP = grid_sql("40", "2 * h", "(x + 0.5) * 0.5 - 0.5", "(y + 0.5) * 0.5 - 0.5")
DOWN = grid_sql("10", "h // 2", "(x + 0.5) * 2 - 0.5", "(y + 0.5) * 2 - 0.5")
TIE = grid_sql("20", "h", "x + 0.5::DOUBLE", "y + 0.5::DOUBLE")


@query(warp_sql(SAME, True))
def warp_identity(spark, sf_dir):
    return plain(sizes(spark, sf_dir).reproject(1, output_no_data=-9999.0).pixels)


@query(warp_sql(UP, True))
def warp_nearest_up(spark, sf_dir):
    return plain(sizes(spark, sf_dir).reproject(0.5, output_no_data=-9999.0).pixels)


@query(warp_sql(DOWN, True))
def warp_nearest_down(spark, sf_dir):
    """Each target centre lies on a corner of four pixels: the tie goes up."""
    return plain(sizes(spark, sf_dir).reproject(2, output_no_data=-9999.0).pixels)


@query(warp_sql(UP, False))
def warp_bilinear_up(spark, sf_dir):
    return plain(sizes(spark, sf_dir).reproject(0.5, interpolation="BILINEAR", output_no_data=-9999.0).pixels)


@query(warp_sql(DOWN, False, source="band = 0"))
def warp_bilinear_down(spark, sf_dir):
    return plain(sizes(spark, sf_dir, no_data=None).reproject(2, interpolation="BILINEAR", output_no_data=-9999.0).pixels)


@query(warp_sql(DOWN, False, source="band = 0 AND raw > 25", finish="(s / w)::FLOAT::DOUBLE"))
def warp_bilinear_nodata(spark, sf_dir):
    """Only the valid neighbours weigh; Float32 results."""
    r = sizes(spark, sf_dir)
    few = Raster(r.pixels.withColumn("raw", F.when(F.col("raw") > 25, F.col("raw")).otherwise(float("nan"))), r.descriptor)
    return plain(few.reproject(2, interpolation="BILINEAR", output_type="FLOAT32", source_no_data=-5.0, output_no_data=-9999.0).pixels)


@query(warp_sql(grid_sql("12", "h", "x - 2.0::DOUBLE", "y::DOUBLE"), True))
def warp_extent(spark, sf_dir):
    """An extent beyond the raster's left edge."""
    r = sizes(spark, sf_dir)
    return plain(r.reproject(1, extent=[-1.75, 0, 9.5, r.grid.height], output_no_data=-9999.0).pixels)


@query(warp_sql(DOWN, False, finish="round_even(s / w, 0)", missing=0.0))
def warp_source_int(spark, sf_dir):
    return plain(sizes(spark, sf_dir, kind=0).reproject(2, interpolation="BILINEAR", output_type="SOURCE", output_no_data=0.0).pixels)


@query(warp_sql(SAME, True, source="band = 0 AND raw <> 20"))
def warp_override(spark, sf_dir):
    """A source NoData replaces the band's: the old sentinel is data."""
    return plain(sizes(spark, sf_dir).reproject(1, source_no_data=20.0, output_no_data=-9999.0).pixels)


@query(
    f"""WITH {P}, q AS (SELECT x, y, raw FROM p WHERE band = 0 AND raw <> 7), t AS ({grid_sql("h", "20", "19 - y::DOUBLE", "x::DOUBLE")})
SELECT 0::BIGINT AS band, t.x::BIGINT AS x, t.y::BIGINT AS y, coalesce(q.raw, -9999) AS raw FROM t LEFT JOIN q ON q.x = t.sx AND q.y = t.sy"""
)
def warp_rotated(spark, sf_dir):
    """A raster whose columns run north and rows east."""
    r = sizes(spark, sf_dir)
    turned = Raster(r.pixels, Descriptor(Grid(20, r.grid.height, 0.0, 1.0, 1.0, 0.0, 0.5, 0.5), r.descriptor.bands, "EPSG:2056"))
    return plain(turned.reproject(1, output_no_data=-9999.0).pixels)


#: Mercator metres and degrees: the earth's radius, the raster's corner, degrees of a target pixel and its least column and row.
RADIUS, EAST, NORTH, DEGREES, COLUMN, ROW = 6378137.0, 800_000.0, 6_000_000.0, 0.005, 1438, 9472
TOP = f"(floor(degrees(2 * atan(exp(({NORTH} + h * 1000 - 5000) / {RADIUS})) - pi() / 2) * 100) / 100 / {DEGREES})"


@query(
    f"""WITH {P}, q AS (SELECT x, y, raw FROM p WHERE band = 0 AND raw <> 7), g AS (SELECT h, round({TOP})::BIGINT AS top FROM ph),
t AS (SELECT x, y, ({RADIUS}::DOUBLE * radians(({COLUMN} + x + 0.5) * {DEGREES}::DOUBLE) - {EAST + 500}) / 1000 AS sx,
  ({NORTH - 500} + h * 1000 - {RADIUS}::DOUBLE * ln(tan(pi() / 4 + radians((top - y - 0.5) * {DEGREES}::DOUBLE) / 2))) / 1000 AS sy
  FROM g, LATERAL (SELECT unnest(range(top - {ROW})) AS y) AS b, LATERAL (SELECT unnest(range(34)) AS x) AS a)
SELECT 0::BIGINT AS band, t.x::BIGINT AS x, t.y::BIGINT AS y, coalesce(q.raw, -9999) AS raw FROM t LEFT JOIN q ON q.x = floor(sx + 0.5) AND q.y = floor(sy + 0.5)"""
)
def warp_mercator_to_degrees(spark, sf_dir):
    """Between systems, in closed form: a raster in Mercator metres on a grid of degrees that grows with it."""
    r = sizes(spark, sf_dir)
    metres = Raster(r.pixels, replace(r.descriptor, grid=Grid.north_up(20, r.grid.height, 1000.0, EAST, NORTH), crs="EPSG:3857"))
    top = math.floor(math.degrees(2 * math.atan(math.exp((NORTH + r.grid.height * 1000 - 5000) / RADIUS)) - math.pi / 2) * 100) / 100
    extent = [COLUMN * DEGREES, ROW * DEGREES, (COLUMN + 34) * DEGREES, top]
    return plain(metres.reproject(DEGREES, extent=extent, output_no_data=-9999.0, target_crs="EPSG:4326").pixels)


WARP_RGB = f"""WITH {RGB}, q AS (SELECT x, y, a / 255 AS a, r * (a / 255) AS r, g * (a / 255) AS g, b * (a / 255) AS b FROM c WHERE a > 0),
t AS (SELECT u AS x, v AS y, u * 2 AS sx, v * 2 AS sy FROM oh, LATERAL (SELECT unnest(range(h // 2)) AS v) AS j, LATERAL (SELECT unnest(range(25)) AS u) AS i),
s AS (SELECT t.x, t.y, {", ".join(f"0.25 * coalesce(q0.{n}, 0) + 0.25 * coalesce(q1.{n}, 0) + 0.25 * coalesce(q2.{n}, 0) + 0.25 * coalesce(q3.{n}, 0) AS {n}" for n in "rgba")} FROM t
  LEFT JOIN q q0 ON q0.x = sx AND q0.y = sy LEFT JOIN q q1 ON q1.x = sx + 1 AND q1.y = sy LEFT JOIN q q2 ON q2.x = sx AND q2.y = sy + 1 LEFT JOIN q q3 ON q3.x = sx + 1 AND q3.y = sy + 1),
m AS (SELECT x::BIGINT AS x, y::BIGINT AS y, {", ".join(f"CASE WHEN a > 0 THEN round_even({n} / a, 0) ELSE 0 END AS {n}" for n in "rgb")}, round_even(least(1, greatest(0, a)) * 255, 0) AS a FROM s) {RGB_LONG}"""


@query(WARP_RGB)
def warp_rgba_premultiplied(spark, sf_dir):
    return plain(colours(spark, sf_dir, alpha=True).reproject(2, interpolation="BILINEAR", output_type="SOURCE").pixels)


PALETTE = tuple((i * 257 if c == 0 else 65535 - i * 257 if c == 1 else i * 1000 % 65536) for c in range(3) for i in range(51))


@query(
    f"""WITH {P}, q AS (SELECT x, y, raw * 257 AS r, 65535 - raw * 257 AS g, raw * 1000 % 65536 AS b FROM p WHERE band = 0),
t AS (SELECT u AS x, v AS y, u * 2 AS sx, v * 2 AS sy FROM ph, LATERAL (SELECT unnest(range(h // 2)) AS v) AS j, LATERAL (SELECT unnest(range(10)) AS u) AS i),
m AS (SELECT t.x::BIGINT AS x, t.y::BIGINT AS y, {", ".join(f"round_even(0.25::DOUBLE * q0.{n} + 0.25::DOUBLE * q1.{n} + 0.25::DOUBLE * q2.{n} + 0.25::DOUBLE * q3.{n}, 0) AS {n}" for n in "rgb")}, 65535.0::DOUBLE AS a FROM t
  JOIN q q0 ON q0.x = sx AND q0.y = sy JOIN q q1 ON q1.x = sx + 1 AND q1.y = sy JOIN q q2 ON q2.x = sx AND q2.y = sy + 1 JOIN q q3 ON q3.x = sx + 1 AND q3.y = sy + 1) {RGB_LONG}"""
)
def warp_palette_expand(spark, sf_dir):
    r = sizes(spark, sf_dir, no_data=None, kind=0)
    coloured = Raster(r.pixels, Descriptor(r.grid, r.descriptor.bands, "EPSG:2056", color="PALETTE", palette=PALETTE))
    return plain(coloured.reproject(2, interpolation="BILINEAR").pixels)


# --- Overviews --------------------------------------------------------------


def half_sql(source: str, mean: str, missing: float) -> str:
    return f"SELECT band, x // 2 AS x, y // 2 AS y, coalesce({mean}, {missing}) AS raw FROM {source} GROUP BY band, x // 2, y // 2"


MEAN = "round_even(avg(raw) FILTER (raw <> 7), 0)"
OUT = "SELECT band::BIGINT AS band, x::BIGINT AS x, y::BIGINT AS y, raw FROM"


@query(f"WITH {P}, a AS ({half_sql('p', MEAN, 7.0)}) {OUT} a WHERE band = 0")
def overview_average_int(spark, sf_dir):
    return plain(halve(sizes(spark, sf_dir, kind=0)).pixels)


@query(f"WITH {O}, a AS ({half_sql('o', 'avg(raw) FILTER (raw <> -1)', -1.0)}) {OUT} a")
def overview_average_float(spark, sf_dir):
    return plain(halve(order_prices(spark, sf_dir)).pixels)


@query(f"WITH {P} SELECT band::BIGINT AS band, x // 2 AS x, y // 2 AS y, raw FROM p WHERE x % 2 = 0 AND y % 2 = 0")
def overview_nearest(spark, sf_dir):
    return plain(halve(parts(spark, sf_dir), "NEAREST").pixels)


@query(f"WITH {P}, p0 AS (SELECT * FROM p WHERE band = 0), a AS ({half_sql('p0', MEAN, 7.0)}), b AS ({half_sql('a', MEAN, 7.0)}) {OUT} b")
def overview_cascade_l2(spark, sf_dir):
    """Level 2 averages the rounded averages of level 1."""
    return plain(sizes(spark, sf_dir, kind=0).overviews(block=5)[1].pixels)


@query(f"WITH {P}, p0 AS (SELECT band, x - 2 AS x, y - 1 AS y, raw FROM p, ph WHERE band = 0 AND x BETWEEN 2 AND 8 AND y BETWEEN 1 AND h - 2), a AS ({half_sql('p0', MEAN, 7.0)}) {OUT} a")
def overview_ragged(spark, sf_dir):
    r = sizes(spark, sf_dir, kind=0)
    return plain(halve(r.clip(tall(r, 2.25, 8.75))).pixels)


@query(f"WITH {O}, " + ", ".join(f"l{k} AS ({half_sql('o' if k == 1 else f'l{k - 1}', 'avg(raw)', -1.0)})" for k in (1, 2, 3)) + " SELECT 1::BIGINT AS level, count(*) AS n, min(raw) AS low, max(raw) AS high FROM l1 UNION ALL SELECT 2, count(*), min(raw), max(raw) FROM l2 UNION ALL SELECT 3, count(*), min(raw), max(raw) FROM l3")
def overview_pyramid(spark, sf_dir):
    """Three levels of the orders raster, each from the one before."""
    out, r = None, order_prices(spark, sf_dir)
    for level in (1, 2, 3):
        r = halve(r)
        row = r.pixels.agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high")).select(F.lit(level).cast("long").alias("level"), "n", "low", "high")
        out = row if out is None else out.unionByName(row)
    return out


# --- Chains and tiles -------------------------------------------------------


CHAIN = f"""WITH {P}, k AS (SELECT x - 2 AS x, y - 1 AS y, raw FROM p, ph WHERE band = 0 AND raw <> 7 AND x BETWEEN 2 AND 9 AND y BETWEEN 1 AND h - 2),
t AS (SELECT u AS x, v AS y, (u + 0.5) * 0.5 - 0.5 AS sx, (v + 0.5) * 0.5 - 0.5 AS sy FROM ph, LATERAL (SELECT unnest(range(2 * h - 4)) AS v) AS j, LATERAL (SELECT unnest(range(16)) AS u) AS i),
m AS (SELECT t.x, t.y, coalesce(k.raw, 7) AS raw FROM t LEFT JOIN k ON k.x = floor(t.sx + 0.5) AND k.y = floor(t.sy + 0.5))"""


def chain(spark: SparkSession, sf_dir: str) -> Raster:
    r = sizes(spark, sf_dir)
    return r.clip(tall(r, 2.25, 9.75)).reproject(0.5)


@query(f"{CHAIN} SELECT 0::BIGINT AS band, x::BIGINT AS x, y::BIGINT AS y, raw FROM m")
def chain_clip_warp(spark, sf_dir):
    return plain(chain(spark, sf_dir).pixels)


@query(f"{CHAIN}, {Z}, w AS (SELECT 2 + (x + 0.5) * 0.5 AS wx, h - 1 - (y + 0.5) * 0.5 AS wy, raw AS v FROM m, ph WHERE raw <> 7) SELECT zone_id, {STATS} FROM z LEFT JOIN w ON {BOX} GROUP BY zone_id")
def chain_clip_warp_zonal(spark, sf_dir):
    return rounded(chain(spark, sf_dir).zonal(zones(spark, sf_dir, "rect")))


@query(f"WITH {O} SELECT (x // 16)::BIGINT AS tile_x, (y // 16)::BIGINT AS tile_y, count(*) AS n, sum(raw) AS total FROM o GROUP BY ALL")
def tile_grid(spark, sf_dir):
    r = order_prices(spark, sf_dir)
    return r.pixels.groupBy(F.floor(F.col("x") / 16).alias("tile_x"), F.floor(F.col("y") / 16).alias("tile_y")).agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("total"))
