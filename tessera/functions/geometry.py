"""Polygons as columns: WKT to edges, pixel windows, coverage.

A polygon is an array of edges (x1, y1, x2, y2). Coverage is even-odd with the
boundary included, which for valid polygons and multipolygons respects holes
and parts. All of it is built-in functions, so it stays in the JVM.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.coverage import edges_of
from tessera.functions.pixel import number, pixel
from tessera.functions.validity import check_polygons
from tessera.model import Grid

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
EDGE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
POLYGON = r"(?i)^\s*(?:SRID=\d+;)?\s*(MULTI)?POLYGON\s*(?:EMPTY|\(.*\))\s*$"


def edges(wkt: Column) -> Column:
    """Edges of a polygon's or multipolygon's rings; none for a null or empty one, an error for other types."""
    points = F.regexp_replace(wkt, rf"({NUMBER})\s+({NUMBER})(?:\s+{NUMBER})*", r"[$1,$2]")
    rings = F.regexp_extract_all(points, F.lit(r"\(\s*(\[[^()]*\])\s*\)"), F.lit(1))
    lines = F.transform(rings, lambda r: F.from_json(F.concat(F.lit("["), r, F.lit("]")), "array<array<double>>"))

    def sides(ring: Column) -> Column:
        following = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
        pairs = F.arrays_zip(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))).alias("p"), following.alias("q"))
        return F.transform(pairs, lambda s: F.struct(s["p"][0].alias("x1"), s["p"][1].alias("y1"), s["q"][0].alias("x2"), s["q"][1].alias("y2")))

    empty = F.array().cast(EDGE)
    found = F.flatten(F.transform(lines, sides))
    checked = F.when(wkt.rlike("(?s)" + POLYGON), found).otherwise(F.raise_error(F.lit("The geometry must be a Polygon or MultiPolygon")))
    return F.when(wkt.isNull(), empty).otherwise(checked)


def in_pixels(sides: Column, grid: Grid) -> Column:
    """Edges in the pixel space of a grid."""

    def one(e: Column) -> Column:
        x1, y1 = pixel(grid, e["x1"], e["y1"])
        x2, y2 = pixel(grid, e["x2"], e["y2"])
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    return F.transform(sides, one)


def window(sides: Column, width: int, height: int) -> Column:
    """Struct (x0, y0, x1, y1): the pixels, half open, whose centres a polygon's box may hold."""

    def bound(first: str, second: str, low: bool, size: int) -> Column:
        values = F.transform(sides, lambda e: F.least(e[first], e[second]) if low else F.greatest(e[first], e[second]))
        edge = F.floor(F.array_min(values) + 0.5) if low else F.ceil(F.array_max(values) + 0.5)
        return F.least(F.greatest(edge.cast("double"), number(0)), number(size)).cast("int")

    return F.struct(bound("x1", "x2", True, width).alias("x0"), bound("y1", "y2", True, height).alias("y0"), bound("x1", "x2", False, width).alias("x1"), bound("y1", "y2", False, height).alias("y1"))


def covers(sides: Column, x: Column, y: Column, more: Column | int = 0) -> Column:
    """Whether the point lies in the polygon or on its boundary; ``more`` edges to its right aren't among ``sides``."""

    def cross(e: Column) -> Column:
        return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])

    def on(e: Column) -> Column:
        return (cross(e) == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    def crossed(e: Column) -> Column:
        up, down = (e["y1"] <= y) & (e["y2"] > y), (e["y1"] > y) & (e["y2"] <= y)
        return (up & (cross(e) > 0)) | (down & (cross(e) < 0))

    return F.exists(sides, on) | ((F.size(F.filter(sides, crossed)) + more) % 2 == 1)


PART = re.compile(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)")
RING = re.compile(r"\(([^()]*)\)")


def parse_polygons(wkt: str) -> list[list[list[tuple[float, float]]]]:
    """The polygons of a valid polygon or multipolygon, each its shell and then its holes."""
    if not re.match(POLYGON, wkt or "", re.S):
        raise ValueError("The geometry must be a Polygon or MultiPolygon")
    parts = [[[tuple(map(float, p.split()[:2])) for p in ring.split(",")] for ring in RING.findall(part)] for part in PART.findall(wkt)]
    if not parts and not wkt.rstrip().upper().endswith("EMPTY"):
        raise ValueError("The geometry's rings cannot be read")
    if any(len(p) != 2 for part in parts for ring in part for p in ring):
        raise ValueError("A point needs two coordinates")
    check_polygons(parts)
    return parts


def parse_polygon(wkt: str) -> list[list[tuple[float, float]]]:
    """Rings of one valid polygon or multipolygon."""
    return [ring for part in parse_polygons(wkt) for ring in part]


def aligned(wkt: str | None, crs: str | None, given: str | None = None) -> str | None:
    """A valid polygon's text in system ``crs``, without an SRID.

    Its own system is its SRID, else ``given``, else ``crs``. A null or empty
    polygon stays as it is; an unknown system is an error.
    """
    if wkt is None or not wkt.strip():
        return None
    srid = re.match(r"(?i)\s*SRID=(\d+);", wkt)
    text, own = (wkt[srid.end() :], srid[1]) if srid else (wkt, given)
    parse_polygon(text)
    if own in (None, "0", crs) or crs is None and not srid:
        return text
    if crs is None:
        raise ValueError("A zone has a system but the raster has none")
    from tessera.functions.crs import transform

    if (change := transform(own, crs)) is None:
        return text
    import numpy as np

    pair = re.compile(rf"({NUMBER})\s+({NUMBER})(?:\s+{NUMBER})*")
    points = [m.groups() for m in pair.finditer(text)]
    if not points:
        return text
    x, y = change(*np.array(points, dtype=np.float64).T)
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise ValueError("A zone has no place in the raster's system")
    new = iter(zip(x.tolist(), y.tolist(), strict=True))
    return pair.sub(lambda _: "{!r} {!r}".format(*next(new)), text)


def rings_in_pixels(rings: list[list[tuple[float, float]]], grid: Grid):
    """(n, 4) edges of rings in the pixel space of a grid."""
    edges = edges_of(rings)
    d, dx, dy = grid.determinant, edges[:, 0::2] - grid.m02, edges[:, 1::2] - grid.m12
    out = edges.copy()
    out[:, 0::2], out[:, 1::2] = (grid.m11 * dx - grid.m01 * dy) / d, (grid.m00 * dy - grid.m10 * dx) / d
    return out


def pixel_window(rings: list[list[tuple[float, float]]], grid: Grid) -> tuple[int, int, int, int] | None:
    """(x0, y0, x1, y1), half open, or None if it holds no pixel."""
    d = grid.determinant
    points = [((grid.m11 * (x - grid.m02) - grid.m01 * (y - grid.m12)) / d, (grid.m00 * (y - grid.m12) - grid.m10 * (x - grid.m02)) / d) for r in rings for x, y in r]
    if not points:
        return None
    clamp = lambda v, size: int(min(max(v, 0), size))
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    box = (clamp(math.floor(min(xs) + 0.5), grid.width), clamp(math.floor(min(ys) + 0.5), grid.height), clamp(math.ceil(max(xs) + 0.5), grid.width), clamp(math.ceil(max(ys) + 0.5), grid.height))
    return box if box[0] < box[2] and box[1] < box[3] else None
