"""Clip and reprojection of one window of samples, as array kernels.

A window is an array (bands, rows, columns) of raw samples with its left upper
pixel; NaN stands for pixels that aren't there. Kernels need the descriptors
of what goes in and comes out, never the rest of the raster, so a task runs
them on one tile at a time. Their arithmetic is that of the column expressions
in :mod:`tessera.functions.pixel`, term by term.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tessera.functions.pixel import channel_maximum, stored_no_data
from tessera.model import SAMPLE_TYPES, Descriptor, Grid


@dataclass
class Window:
    """Samples (bands, rows, columns) from pixel (x, y) on."""

    x: int
    y: int
    raw: np.ndarray

    @property
    def width(self) -> int:
        return self.raw.shape[2]

    @property
    def height(self) -> int:
        return self.raw.shape[1]

    @classmethod
    def empty(cls, x: int, y: int, width: int, height: int, bands: int) -> Window:
        return cls(x, y, np.full((bands, height, width), np.nan))

    def put(self, band, x, y, raw) -> None:
        """Samples of single pixels; those outside the window are left out."""
        x, y = np.asarray(x) - self.x, np.asarray(y) - self.y
        own = (x >= 0) & (x < self.width) & (y >= 0) & (y < self.height)
        self.raw[np.asarray(band)[own], y[own], x[own]] = np.asarray(raw)[own]

    def put_block(self, band: int, x: int, y: int, block: np.ndarray) -> None:
        """Samples of a block whose left upper pixel is (x, y)."""
        x0, y0 = max(x, self.x), max(y, self.y)
        x1, y1 = min(x + block.shape[1], self.x + self.width), min(y + block.shape[0], self.y + self.height)
        if x0 < x1 and y0 < y1:
            self.raw[band, y0 - self.y : y1 - self.y, x0 - self.x : x1 - self.x] = block[y0 - y : y1 - y, x0 - x : x1 - x]


def fine(raw: np.ndarray, no_data: float | None, data_type: int, override: float | None = None) -> np.ndarray:
    """Finite and not NoData; an override replaces the band's own."""
    missing = stored_no_data(no_data, data_type) if override is None else override
    out = np.isfinite(raw)
    return out if missing is None or math.isnan(missing) else out & (raw != missing)


def converted(value: np.ndarray, data_type: int) -> np.ndarray:
    """Finite values in the range and precision of a sample type; others raise."""
    name, low, high, _ = SAMPLE_TYPES[data_type]
    if data_type == 5:
        out, fits = value, np.isfinite(value)
    elif data_type == 4:
        with np.errstate(over="ignore"):
            out = value.astype(np.float32).astype(np.float64)
        fits = np.isfinite(value) & np.isfinite(out)
    else:
        out = np.rint(value)
        fits = np.isfinite(value) & (out >= low) & (out <= high)
    if not fits.all():
        raise ValueError(f"{name} output overflow: {value[~fits][0]}")
    return out


def places(source: Grid, target: Grid, x: int, y: int, width: int, height: int, change: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Source coordinates (rows, columns) of a rectangle of target pixels; ``change`` brings target to source systems."""
    px, py = np.arange(x, x + width, dtype=np.float64)[None, :], np.arange(y, y + height, dtype=np.float64)[:, None]
    wx = np.broadcast_to(target.m00 * px + target.m01 * py + target.m02, (height, width))
    wy = np.broadcast_to(target.m10 * px + target.m11 * py + target.m12, (height, width))
    if change:
        wx, wy = (v.reshape(height, width) for v in change(wx.ravel(), wy.ravel()))
        if not (np.isfinite(wx).all() and np.isfinite(wy).all()):
            raise ValueError("A target pixel has no place in the source's system")
    d, dx, dy = source.determinant, wx - source.m02, wy - source.m12
    return (source.m11 * dx - source.m01 * dy) / d, (source.m00 * dy - source.m10 * dx) / d


def within(sx: np.ndarray, sy: np.ndarray, grid: Grid) -> np.ndarray:
    return (sx >= -0.5) & (sx < grid.width - 0.5) & (sy >= -0.5) & (sy < grid.height - 0.5)


def needed_box(sx: np.ndarray, sy: np.ndarray, grid: Grid) -> tuple[int, int, int, int] | None:
    """(x0, y0, x1, y1), half open: the source pixels that four-corner sums at these places read; None if no place is in the grid."""
    own = within(sx, sy, grid)
    if not own.any():
        return None
    x, y = sx[own], sy[own]
    box = (math.floor(x.min()), math.floor(y.min()), math.floor(x.max()) + 2, math.floor(y.max()) + 2)
    return max(box[0], 0), max(box[1], 0), min(box[2], grid.width), min(box[3], grid.height)


def sampled(planes: list[np.ndarray], x: int, y: int, sx: np.ndarray, sy: np.ndarray, nearest: bool) -> list[np.ndarray]:
    """Each plane at (sx, sy): its nearest sample, or four weighted ones in a fixed order; 0 beyond the plane."""
    padded = [np.pad(p, 1) for p in planes]
    height, width = padded[0].shape

    def at(plane: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
        return plane[np.clip(qy - y + 1, 0, height - 1), np.clip(qx - x + 1, 0, width - 1)]

    if nearest:
        qx, qy = np.floor(sx + 0.5).astype(np.int64), np.floor(sy + 0.5).astype(np.int64)
        return [at(p, qx, qy) for p in padded]
    qx, qy = np.floor(sx), np.floor(sy)
    fx, fy = sx - qx, sy - qy
    qx, qy = qx.astype(np.int64), qy.astype(np.int64)
    corners = (((1 - fx) * (1 - fy), 0, 0), (fx * (1 - fy), 1, 0), ((1 - fx) * fy, 0, 1), (fx * fy, 1, 1))
    out = []
    for p in padded:
        total = None
        for weight, dx, dy in corners:
            term = weight * at(p, qx + dx, qy + dy)
            total = term if total is None else total + term
        out.append(total)
    return out


def warp(source: Descriptor, target: Descriptor, samples: Window, x: int, y: int, width: int, height: int, interpolation: str, source_no_data: float | None = None, change: Callable | None = None) -> np.ndarray:
    """(bands, height, width) of a reprojection's pixels from (x, y) on; ``samples`` holds what they need of the source."""
    sx, sy = places(source.grid, target.grid, x, y, width, height, change)
    own, nearest, kind = within(sx, sy, source.grid), interpolation == "NEAREST", target.data_type
    if target.color in ("NUMERIC", "PALETTE"):
        missing, out = target.bands[0].no_data, np.empty((len(target.bands), height, width))
        for b, band in enumerate(source.bands):
            good = fine(samples.raw[b], band.no_data, band.data_type, source_no_data)
            v, w = sampled([np.where(good, samples.raw[b], 0.0), good.astype(np.float64)], samples.x, samples.y, sx, sy, nearest)
            there = (w > 0) & own
            if missing is None and not there.all():
                raise ValueError("A palette without a free NoData index cannot show transparent pixels")
            value = converted(v[there] / w[there], kind)
            if missing is not None and not math.isnan(missing) and (value == missing).any():
                raise ValueError("A resampled value collides with the NoData value of the result")
            out[b] = math.nan if missing is None else missing
            out[b][there] = value
        return out

    channels, palette = len(target.bands) - 1, source.color == "PALETTE"
    colours, top = samples.raw[: 1 if palette else channels], channel_maximum(source.data_type)
    any_fine = np.zeros(colours.shape[1:], bool)
    for c, band in zip(colours, source.bands, strict=False):
        any_fine |= fine(c, band.no_data, band.data_type, source_no_data)
    alpha = opacity(samples.raw[source.alpha_band] / top if source.alpha_band >= 0 else np.ones(any_fine.shape), any_fine & np.isfinite(colours).all(0), 1.0)
    shown = alpha > 0
    planes = []
    for b in range(channels):
        if palette:
            n, index = source.palette_size, np.trunc(colours[0][shown])
            if ((index < 0) | (index >= n)).any():
                raise ValueError("A sample is no index of the palette")
            value = np.array(source.palette[b * n : (b + 1) * n], dtype=np.float64)[index.astype(np.int64)]
        else:
            value = colours[b][shown]
            if ((value < 0) | (value > top)).any():
                raise ValueError("A colour value is more than its type can hold")
        plane = np.zeros(alpha.shape)
        plane[shown] = value if source.associated_alpha else value * alpha[shown]
        planes.append(plane)
    *planes, alpha = sampled([*planes, alpha], samples.x, samples.y, sx, sy, nearest)
    alpha = np.where(own, alpha, 0.0)
    shown, out = alpha > 0, np.zeros((len(target.bands), height, width))
    for b, plane in enumerate(planes):
        out[b][shown] = converted(plane[shown] / alpha[shown], kind)
    out[channels] = converted(np.maximum(0.0, np.minimum(1.0, alpha)) * channel_maximum(kind), kind)
    return out


def opacity(alpha: np.ndarray, shown: np.ndarray, top: float) -> np.ndarray:
    """Alpha values where colours are shown and alpha is finite, else 0; more than ``top`` is an error."""
    out = np.where(np.isfinite(alpha), alpha, 0.0)
    if ((out < 0) | (out > top)).any():
        raise ValueError("An alpha value is more than its type can hold")
    return np.where(shown, out, 0.0)


def cut(source: Descriptor, target: Descriptor, samples: Window, chosen: list[int], added: bool, no_data: float | None, covered: np.ndarray | None) -> np.ndarray:
    """(bands, rows, columns) of a clip's pixels; ``samples`` holds just those of the source, ``covered`` (rows, columns) a mask."""
    rest = np.ones(samples.raw.shape[1:], bool) if covered is None else covered
    raws = [samples.raw[b] for b in chosen]
    good = [fine(r, source.bands[b].no_data, source.data_type, no_data) for r, b in zip(raws, chosen, strict=True)]
    if target.color in ("NUMERIC", "PALETTE"):
        gone = [r if t.no_data is None else np.full(r.shape, float(t.no_data)) for r, t in zip(raws, target.bands, strict=False)]
        return np.stack([np.where(rest & g, r, m) for r, g, m in zip(raws, good, gone, strict=True)])
    out = [np.where(rest, r, 0.0) for r in raws]
    if target.alpha_band >= 0:
        channels, top = 3 if target.color == "RGB" else 1, channel_maximum(source.data_type)
        shown = np.any(good[:channels], axis=0) & np.isfinite(np.stack(raws[:channels])).all(0)
        alpha = opacity(np.where(rest, np.full(rest.shape, top) if added else raws[target.alpha_band], 0.0), shown, top)
        if added:
            out.append(alpha)
        else:
            out[target.alpha_band] = alpha
    return np.stack(out)
