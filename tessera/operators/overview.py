"""Overview pyramids: each level halves the one before, after its conversion."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from tessera.functions.pixel import convert, number, stored_no_data, valid
from tessera.operators.clip import by_number
from tessera.raster import Raster


def plan_levels(width: int, height: int, block: int) -> list[tuple[int, int]]:
    """Sizes of the levels below the first, until both fit a block."""
    out = []
    while width > block or height > block:
        width, height = (width + 1) // 2, (height + 1) // 2
        out.append((width, height))
    return out


def halve(raster: Raster, resampling: str = "AVERAGE") -> Raster:
    """One level: NEAREST takes every second pixel; AVERAGE the mean of the valid ones of four.

    Palettes are always NEAREST. The four children are added in a fixed order,
    so the result doesn't depend on how rows were dealt.
    """
    source, grid = raster.descriptor, raster.grid
    target = replace(source, grid=replace(grid, width=(grid.width + 1) // 2, height=(grid.height + 1) // 2, m00=grid.m00 * 2, m10=grid.m10 * 2, m01=grid.m01 * 2, m11=grid.m11 * 2, m02=grid.m02 + (grid.m00 + grid.m01) / 2, m12=grid.m12 + (grid.m10 + grid.m11) / 2))
    x, y, raw = F.col("x"), F.col("y"), F.col("raw")
    half = [F.floor(x / 2).cast("int").alias("x"), F.floor(y / 2).cast("int").alias("y")]
    if resampling.upper() == "NEAREST" or source.color == "PALETTE":
        return Raster(raster.pixels.where((x % 2 == 0) & (y % 2 == 0)).select("band", *half, "raw"), target)
    sentinel = [stored_no_data(b.no_data, b.data_type) for b in source.bands]
    fine = by_number(F.col("band"), [valid(raw, s) for s in sentinel], F.lit(False))
    child = (y % 2) * 2 + x % 2
    rows = raster.pixels.select("band", *half, child.alias("child"), F.when(fine, raw).alias("v"))
    got = rows.groupBy("band", "x", "y").agg(*(F.max(F.when(F.col("child") == k, F.col("v"))).alias(f"v{k}") for k in range(4)))
    total, n = number(0), F.lit(0)
    for k in range(4):
        total, n = total + F.coalesce(F.col(f"v{k}"), number(0)), n + F.col(f"v{k}").isNotNull().cast("int")
    empty = by_number(F.col("band"), [number((math.nan if b.data_type >= 4 else 0) if b.no_data is None else b.no_data) for b in source.bands], number(0))
    mean = convert(total / n, source.data_type)
    return Raster(got.select("band", "x", "y", F.when(n > 0, mean).otherwise(empty).alias("raw")), target)


def overviews(raster: Raster, block: int = 512, resampling: str = "AVERAGE") -> list[Raster]:
    """All levels below the first; each is planned on the one before."""
    out = []
    for _ in plan_levels(raster.grid.width, raster.grid.height, block):
        raster = halve(raster, resampling)
        out.append(raster)
    return out
