"""Rasters as lazy relations of pixels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import Band, Descriptor, Grid


@dataclass(frozen=True)
class Raster:
    """A descriptor and a DataFrame (band, x, y, raw) that nothing has computed yet.

    Operations return new rasters and only plan: what they do is in the
    DataFrame's plan, so filters and columns reach the source's scan.
    """

    pixels: DataFrame
    descriptor: Descriptor

    @property
    def grid(self) -> Grid:
        return self.descriptor.grid

    @property
    def spark(self):
        return self.pixels.sparkSession

    def clip(self, wkt: str, mask: bool = False, bands: Sequence[int] | None = None, no_data: float | None = None, origin: str = "clip") -> "Raster":
        from tessera.operators.clip import clip

        return clip(self, wkt, mask, bands, no_data, origin)

    def reproject(self, resolution_x: float, resolution_y: float | None = None, extent: Sequence[float] | None = None, interpolation: str = "NEAREST", output_type: str = "AUTO", source_no_data: float | None = None, output_no_data: float | None = None, target_crs: str | None = None, origin: str = "reproject") -> "Raster":
        from tessera.operators.reproject import reproject

        return reproject(self, resolution_x, resolution_y if resolution_y is not None else resolution_x, extent, interpolation, output_type, source_no_data, output_no_data, target_crs, origin)

    def overviews(self, block: int = 512, resampling: str = "AVERAGE") -> "list[Raster]":
        from tessera.operators.overview import overviews

        return overviews(self, block, resampling)

    def zonal(self, zones: DataFrame, band: int = 0, no_data: float | None = None, zone_id: str = "zone_id", wkt: str = "wkt", zone_crs: str | None = None) -> DataFrame:
        from tessera.operators.zonal import zonal_statistics

        return zonal_statistics(self, zones, band, no_data, zone_id, wkt, zone_crs=zone_crs)


def from_table(df: DataFrame, x: Column, y: Column, bands: Sequence[Column], descriptor: Descriptor) -> Raster:
    """A raster from any table that has one row for each pixel."""
    if len(bands) != len(descriptor.bands):
        raise ValueError("One column for each band")
    values = F.array(*(F.struct(F.lit(i).alias("band"), b.cast("double").alias("raw")) for i, b in enumerate(bands)))
    rows = df.select(x.cast("int").alias("x"), y.cast("int").alias("y"), F.explode(values).alias("v"))
    return Raster(rows.select("v.band", "x", "y", "v.raw"), descriptor)


def numbered(names_types: Sequence[tuple[int, float | None]] | Sequence[Band]) -> tuple[Band, ...]:
    """Bands called ``Band 1`` and so on from (sample type, NoData)."""
    return tuple(b if isinstance(b, Band) else Band(f"Band {i + 1}", b[0], b[1]) for i, b in enumerate(names_types))
