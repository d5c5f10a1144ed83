"""Descriptors of rasters and their invariants, with the matching Spark schemas."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, replace

#: Sample types: code, name, least and largest value (None: no range), as stored by Spark.
SAMPLE_TYPES = {
    0: ("UInt8", 0, 255, "short"),
    1: ("UInt16", 0, 65535, "int"),
    2: ("Int16", -32768, 32767, "short"),
    3: ("Int32", -(2**31), 2**31 - 1, "int"),
    4: ("Float32", None, None, "float"),
    5: ("Float64", None, None, "double"),
}
COLORS = ("NUMERIC", "RGB", "GRAY_ALPHA", "PALETTE", "UNSUPPORTED")
MAX_STEPS = 128


@dataclass(frozen=True)
class Grid:
    """Width, height and the affine map from pixel centres to world coordinates."""

    width: int
    height: int
    m00: float = 1.0
    m10: float = 0.0
    m01: float = 0.0
    m11: float = -1.0
    m02: float = 0.5
    m12: float = 0.5

    def __post_init__(self):
        if self.width <= 0 or self.height <= 0:
            raise ValueError("Raster dimensions must be positive")
        if not all(math.isfinite(v) for v in self.affine) or self.determinant == 0:
            raise ValueError("Raster transform must be finite and invertible")

    @property
    def affine(self) -> tuple[float, ...]:
        return (self.m00, self.m10, self.m01, self.m11, self.m02, self.m12)

    @property
    def determinant(self) -> float:
        return self.m00 * self.m11 - self.m01 * self.m10

    @classmethod
    def north_up(cls, width: int, height: int, resolution: float = 1.0, left: float = 0.0, bottom: float = 0.0) -> "Grid":
        return cls(width, height, resolution, 0.0, 0.0, -resolution, left + resolution / 2, bottom + resolution * (height - 0.5))

    def moved(self, x: int, y: int, width: int, height: int) -> "Grid":
        """The grid of a window, with its own origin."""
        return replace(self, width=width, height=height, m02=self.m00 * x + self.m01 * y + self.m02, m12=self.m10 * x + self.m11 * y + self.m12)


@dataclass(frozen=True)
class Band:
    name: str = "Band 1"
    data_type: int = 5
    no_data: float | None = None
    scale: float = 1.0
    offset: float = 0.0

    def __post_init__(self):
        if self.data_type not in SAMPLE_TYPES:
            raise ValueError("Unknown sample type")
        if not (math.isfinite(self.scale) and math.isfinite(self.offset)):
            raise ValueError("Scale and offset must be finite")


@dataclass(frozen=True)
class Descriptor:
    grid: Grid
    bands: tuple[Band, ...]
    crs: str | None = None
    authority: str | None = None
    color: str = "NUMERIC"
    alpha_band: int = -1
    associated_alpha: bool = False
    palette: tuple[int, ...] = field(default=())

    def __post_init__(self):
        if not self.bands:
            raise ValueError("A raster needs a band")
        if self.color not in COLORS:
            raise ValueError("Unknown colour kind")
        if not -1 <= self.alpha_band < len(self.bands):
            raise ValueError("Alpha band outside the raster")

    @property
    def data_type(self) -> int:
        return self.bands[0].data_type

    @property
    def is_float(self) -> bool:
        return self.data_type >= 4

    @property
    def palette_size(self) -> int:
        return len(self.palette) // 3


PIXEL_SCHEMA = "band int, x int, y int, raw double"
TILE_SCHEMA = "raster_id string, level int, tile_x int, tile_y int, x int, y int, width int, height int, band int, samples array<double>"
DESCRIPTOR_TYPE = (
    "struct<grid:struct<width:int,height:int,m00:double,m10:double,m01:double,m11:double,m02:double,m12:double>,crs_wkt:string,authority:string,"
    "bands:array<struct<name:string,data_type:int,no_data:double,scale:double,offset:double>>,color:string,alpha_band:int,associated_alpha:boolean,palette:array<int>>"
)


def to_struct(d: Descriptor) -> dict:
    """A descriptor in the shape of its struct."""
    out = asdict(d)
    out["crs_wkt"] = out.pop("crs")
    return out | {"bands": [dict(b) for b in out["bands"]], "palette": list(out["palette"])}


def from_struct(s: dict) -> Descriptor:
    return Descriptor(Grid(**s["grid"]), tuple(Band(**b) for b in s["bands"]), s["crs_wkt"], s["authority"], s["color"], s["alpha_band"], s["associated_alpha"], tuple(s["palette"]))
