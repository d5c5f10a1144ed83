"""Which pixels of a tile a polygon covers, from what of its edges is near.

A zone meets the tiles of its window in three ways: tiles that no edge comes
near are inside or outside as a whole, and only tiles on the boundary need a
test for each pixel. Such a tile keeps the edges near it, and for each of its
rows the parity of the edges further right, so its work doesn't grow with the
polygon. Coverage is even-odd with the boundary included, as in
:func:`tessera.functions.geometry.covers`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pixels from an edge within which a tile counts as on the boundary.
NEAR = 0.5


def edges_of(rings) -> np.ndarray:
    """(n, 4) edges x1, y1, x2, y2 of rings."""
    parts = [np.concatenate([np.asarray(r[:-1], dtype=np.float64), np.asarray(r[1:], dtype=np.float64)], axis=1) for r in rings if len(r) > 1]
    return np.concatenate(parts) if parts else np.zeros((0, 4))


def box_of(edges: np.ndarray, width: int, height: int) -> tuple[int, int, int, int] | None:
    """(x0, y0, x1, y1), half open: the pixels whose centres a polygon's box may hold; None if there are none."""
    if not len(edges):
        return None
    xs, ys = edges[:, 0::2], edges[:, 1::2]
    clamp = lambda v, size: int(min(max(v, 0), size))
    box = (clamp(np.floor(xs.min() + 0.5), width), clamp(np.floor(ys.min() + 0.5), height), clamp(np.ceil(xs.max() + 0.5), width), clamp(np.ceil(ys.max() + 0.5), height))
    return box if box[0] < box[2] and box[1] < box[3] else None


def zone_tiles(edges: np.ndarray, box: tuple[int, int, int, int], tile: int) -> Iterator[tuple[int, int, np.ndarray | None, np.ndarray | None]]:
    """(tile_x, tile_y, edges near it, parity of each row) of the tiles that a polygon meets; None twice for one inside."""
    x0, y0, x1, y1 = box
    c_first, c_last = x0 // tile, (x1 - 1) // tile
    low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    r_first, r_last = y0 // tile, (y1 - 1) // tile
    first = np.clip(np.floor((low - NEAR) / tile), r_first, r_last + 1).astype(np.int64)
    last = np.clip(np.floor((high + NEAR) / tile), r_first - 1, r_last).astype(np.int64)
    n = np.maximum(last - first + 1, 0)
    which = np.repeat(np.arange(len(edges)), n)
    rows = np.repeat(first, n) + (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))
    order = np.argsort(rows, kind="stable")
    which, rows = which[order], rows[order]
    starts = np.searchsorted(rows, np.arange(r_first, r_last + 2))
    for r in range(r_first, r_last + 1):
        own = edges[which[starts[r - r_first] : starts[r - r_first + 1]]]
        yield from _row_tiles(own, r, c_first, c_last, tile)


def _row_tiles(edges: np.ndarray, r: int, c_first: int, c_last: int, tile: int) -> Iterator:
    """The tiles of one row of tiles, from the right."""
    top, bottom = r * tile - NEAR, (r + 1) * tile - 1 + NEAR
    ax, ay, bx, by = edges.T
    flat = ay == by
    with np.errstate(all="ignore"):
        slope = np.where(flat, 0.0, (bx - ax) / np.where(flat, 1.0, by - ay))
        at = lambda y: np.clip(ax + slope * (np.clip(y, np.minimum(ay, by), np.maximum(ay, by)) - ay), np.minimum(ax, bx), np.maximum(ax, bx))
        one, two = np.where(flat, ax, at(top)), np.where(flat, bx, at(bottom))
    left, right = np.floor((np.minimum(one, two) - NEAR) / tile), np.floor((np.maximum(one, two) + NEAR) / tile)
    left, right = np.clip(left, c_first - 1, c_last + 1).astype(np.int64), np.clip(right, c_first - 1, c_last + 1).astype(np.int64)
    # The rows that an edge crosses: from its lower end, without its upper.
    y_from = np.clip(np.ceil(np.minimum(ay, by)) - r * tile, 0, tile).astype(np.int64)
    y_to = np.clip(np.ceil(np.maximum(ay, by)) - r * tile, 0, tile).astype(np.int64)
    flips = np.zeros((len(edges), 2), np.int64)
    flips[:, 0], flips[:, 1] = y_from, y_to
    near = np.zeros(c_last - c_first + 2, np.int64)
    inside = (left <= c_last) & (right >= c_first)
    np.add.at(near, np.maximum(left[inside], c_first) - c_first, 1)
    np.add.at(near, np.minimum(right[inside], c_last) + 1 - c_first, -1)
    near = np.cumsum(near)[:-1] > 0
    order = np.argsort(-left, kind="stable")  # edges join the parity when a tile lies left of them
    changes, k = np.zeros(tile + 1, np.int64), 0
    for c in range(c_last, c_first - 1, -1):
        new = k
        while k < len(order) and left[order[k]] > c:
            k += 1
        if k > new:
            np.add.at(changes, flips[order[new:k]].ravel(), 1)
        if near[c - c_first]:
            parity = (np.cumsum(changes[:tile]) & 1).astype(bool)
            yield c, r, edges[(left <= c) & (right >= c)], parity
        elif (changes[0] & 1) if tile else False:
            yield c, r, None, None


def mask(near: np.ndarray, parity: np.ndarray, tile_x: int, tile_y: int, tile: int) -> np.ndarray:
    """(tile, tile) booleans: the pixels of a boundary tile whose centres the polygon covers."""
    left, top = tile_x * tile, tile_y * tile
    flips = np.zeros((tile, tile + 1), np.int64)
    flips[:, 0] = parity
    on = np.zeros((tile, tile), bool)
    ax, ay, bx, by = near.T

    def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each edge with each of its rows, first to last, relative to the tile."""
        n = np.maximum(last - first, 0)
        e = np.repeat(np.arange(len(near)), n)
        return e, np.repeat(first, n) + (np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n))

    low, high = np.minimum(ay, by), np.maximum(ay, by)
    clip = lambda v: np.clip(v - top, 0, tile).astype(np.int64)
    e, r = spread(clip(np.ceil(low)), clip(np.ceil(high)))
    x1, y1, x2, y2, y = ax[e], ay[e], bx[e], by[e], (r + top).astype(np.float64)
    up = y2 > y1
    k = np.clip(np.ceil(x1 + (x2 - x1) * (y - y1) / (y2 - y1)) - left, 0, tile).astype(np.int64)

    def crossed(k: np.ndarray) -> np.ndarray:
        turn = (x2 - x1) * (y - y1) - (y2 - y1) * (k + left - x1)
        return np.where(up, turn > 0, turn < 0)

    for _ in range(2):  # the estimate is off by rounding at most
        k = np.where((k < tile) & crossed(k), k + 1, k)
        k = np.where((k > 0) & ~crossed(k - 1), k - 1, k)
    np.add.at(flips, (r, np.zeros_like(r)), 1)
    np.add.at(flips, (r, k), 1)

    e, r = spread(clip(np.ceil(low)), np.clip(np.floor(high) + 1 - top, 0, tile).astype(np.int64))
    x1, y1, x2, y2, y = ax[e], ay[e], bx[e], by[e], (r + top).astype(np.float64)
    flat = y1 == y2
    for i in np.flatnonzero(flat):
        a, b = np.ceil(min(x1[i], x2[i])) - left, np.floor(max(x1[i], x2[i])) - left
        on[r[i], max(0, int(max(a, 0))) : int(min(b, tile - 1)) + 1] = True
    with np.errstate(all="ignore"):
        about = np.rint(np.where(flat, x1, x1 + (x2 - x1) * (y - y1) / np.where(flat, 1, y2 - y1))) - left
    for step in (-1, 0, 1):
        c = np.clip(about + step, -1, tile)
        x = c + left
        hit = ~flat & (c >= 0) & (c < tile) & ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) == 0) & (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2))
        on[r[hit], c[hit].astype(np.int64)] = True
    return on | ((np.cumsum(flips, axis=1)[:, :tile] & 1) == 1)
