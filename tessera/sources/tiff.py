"""TIFF directories and blocks: what a scan needs to know, and what a sink writes.

Only headers pass through here on the driver; blocks are read and written by
tasks, each at its own place in the file.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np

from tessera.functions.crs import code_of
from tessera.model import Band, Descriptor, Grid
from tessera.sources.ranges import Source

# Field types (code: size, struct letter), tags, compressions.
FIELD_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, COLOR_MAP, EXTRA, FORMAT = 256, 257, 258, 259, 262, 277, 284, 320, 338, 339
STRIP_OFFSETS, ROWS_PER_STRIP, STRIP_COUNTS, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SUBFILE, PREDICTOR = 273, 278, 279, 322, 323, 324, 325, 254, 317
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, GEO_DOUBLES, GEO_TEXT, METADATA, NO_DATA = 33550, 33922, 34264, 34735, 34736, 34737, 42112, 42113
COMPRESSIONS = {"None": 1, "LZW": 5, "ZLib": 8, "Deflate": 32946, "PackBits": 32773, "ZSTD": 50000}
DTYPES = {0: "u1", 1: "u2", 2: "i2", 3: "i4", 4: "f4", 5: "f8"}
MAX_HEADER = 64 * 1024 * 1024
#: Offsets of blocks that are read at a time, and how many such parts are held; longer arrays than one part stay in the file.
STORED_PART, STORED_PARTS = 8192, 16


def pack_bits(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        end = at + 1
        while end < n and end - at < 128 and not (end + 1 < n and data[end] == data[end + 1]):
            end += 1
        out.append(end - at - 1)
        out += data[at:end]
        at = end
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; the table starts anew when full."""
    bits, length, table, width, word = 0, 0, {bytes([i]): i for i in range(256)}, 9, b""
    out = bytearray()

    def emit(code: int) -> None:
        nonlocal bits, length
        bits, length = bits << width | code, length + width
        while length >= 8:
            length -= 8
            out.append(bits >> length & 255)
        bits &= (1 << length) - 1

    emit(256)
    fresh = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        emit(table[word])
        table[longer] = fresh
        fresh += 1
        word = data[i : i + 1]
        if fresh == 4094:
            emit(256)
            table, width, fresh = {bytes([i]): i for i in range(256)}, 9, 258
        elif fresh >= 1 << width:
            width += 1
    if word:
        emit(table[word])
        fresh += 1
        if fresh >= 1 << width and width < 12:
            width += 1
    emit(257)
    if length:
        out.append(bits << (8 - length) & 255)
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    bits, length, at, width, before = 0, 0, 0, 9, b""
    table: list[bytes] = []
    out = bytearray()
    while True:
        while length < width and at < len(data):
            bits, length, at = bits << 8 | data[at], length + 8, at + 1
        if length < width:
            break
        length -= width
        code = bits >> length
        bits &= (1 << length) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif before and code == len(table):
            word = before + before[:1]
        else:
            raise ValueError("Damaged LZW data")
        out += word
        if before:
            table.append(before + word[:1])
        before = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def compress(name: str, data: bytes) -> bytes:
    if name in ("ZLib", "Deflate"):
        return zlib.compress(data, 6)
    if name == "ZSTD":
        import zstandard

        return zstandard.ZstdCompressor(level=9).compress(data)
    return {"None": bytes, "PackBits": pack_bits, "LZW": lzw}[name](data)


def decompress(code: int, data: bytes, size: int) -> bytes:
    if code in (8, 32946):
        out = zlib.decompress(data)
    elif code == 50000:
        import zstandard

        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    elif code in (1, 5, 32773):
        out = {1: bytes, 5: unlzw, 32773: unpack_bits}[code](data)
    else:
        raise ValueError(f"Unsupported TIFF compression {code}")
    if len(out) < size:
        raise ValueError("Raster block is shorter than its size")
    return out[:size]


class Stored:
    """A long array of whole numbers that stays in its file; parts of it are read when they are asked for."""

    def __init__(self, source: Source, order: str, at: int, count: int, width: int, letter: str):
        self.source, self.at, self.count, self.width = source, at, count, width
        self.dtype = np.dtype(order + {"H": "u2", "I": "u4", "Q": "u8"}[letter])
        self.parts: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.count:
            raise IndexError("A block outside the image")
        part, at = divmod(k, STORED_PART)
        if part not in self.parts:
            if len(self.parts) >= STORED_PARTS:
                self.parts.pop(next(iter(self.parts)))
            n = min(STORED_PART, self.count - part * STORED_PART)
            self.parts[part] = np.frombuffer(self.source.read(self.at + part * STORED_PART * self.width, n * self.width), self.dtype)
        return int(self.parts[part][at])

    def tolist(self) -> list[int]:
        return [self[k] for k in range(self.count)]


@dataclass(frozen=True)
class Directory:
    """One image of a file: its descriptor and its blocks."""

    descriptor: Descriptor
    order: str
    block_width: int
    block_height: int
    compression: int
    planar: int
    predictor: int
    tiled: bool
    offsets: np.ndarray | Stored
    counts: np.ndarray | Stored

    @property
    def across(self) -> int:
        return -(-self.descriptor.grid.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.descriptor.grid.height // self.block_height)

    def rows_of(self, tile_y: int) -> int:
        """Rows that a block holds: the last strip is shorter, tiles are padded."""
        return self.block_height if self.tiled else min(self.block_height, self.descriptor.grid.height - tile_y * self.block_height)

    def decode(self, data: bytes, rows: int) -> np.ndarray:
        """(rows, block width, samples) of one block."""
        dtype = np.dtype(self.order + DTYPES[self.descriptor.data_type])
        n = 1 if self.planar == 2 else len(self.descriptor.bands)
        raw = decompress(self.compression, data, rows * self.block_width * n * dtype.itemsize)
        out = np.frombuffer(raw, dtype).reshape(rows, self.block_width, n)
        if self.predictor == 2 and dtype.kind != "f":
            out = np.cumsum(out, axis=1, dtype=dtype.newbyteorder("="))
        elif self.predictor != 1:
            raise ValueError("Unsupported TIFF predictor")
        return out


class Header:
    """The bytes at a file's start, extended where a directory points beyond."""

    def __init__(self, source: Source, step: int = 64 * 1024):
        self.source, self.data, self.step = source, b"", step

    def get(self, start: int, length: int) -> bytes:
        end = start + length
        if end > len(self.data) and end <= MAX_HEADER and start <= len(self.data) + 16 * self.step:
            while len(self.data) < end:
                more = self.source.read(len(self.data), max(self.step, end - len(self.data)))
                if not more:
                    raise ValueError("TIFF ends within its directories")
                self.data += more
        if end <= len(self.data):
            return self.data[start:end]
        return self.source.read(start, length)


def fields(header: Header) -> list[tuple[str, dict[int, list | Stored]]]:
    """Byte order and fields of each directory."""
    start = header.get(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    version = struct.unpack(order + "H", start[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("Not a TIFF file")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), start[8:16] if big else start[4:8])[0]
    out: list[tuple[str, dict[int, list | Stored]]] = []
    seen = set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(order + ("Q" if big else "H"), header.get(at, 8 if big else 2))[0]
        size, inline = (20, 8) if big else (12, 4)
        body = header.get(at + (8 if big else 2), n * size + inline)
        found: dict[int, list | Stored] = {}
        for i in range(n):
            entry = body[i * size : (i + 1) * size]
            tag, kind = struct.unpack(order + "HH", entry[:4])
            if kind not in FIELD_TYPES:
                continue
            count = struct.unpack(order + ("Q" if big else "I"), entry[4 : 12 if big else 8])[0]
            width, letter = FIELD_TYPES[kind]
            value = entry[12 if big else 8 :]
            if tag in (STRIP_OFFSETS, STRIP_COUNTS, TILE_OFFSETS, TILE_COUNTS) and count > STORED_PART and letter in "HIQ":
                found[tag] = Stored(header.source, order, struct.unpack(order + ("Q" if big else "I"), value)[0], count, width, letter)
                continue
            if count * width > inline:
                value = header.get(struct.unpack(order + ("Q" if big else "I"), value)[0], count * width)
            value = value[: count * width]
            if letter == "s":
                found[tag] = [value]
            else:
                found[tag] = list(struct.unpack(f"{order}{count * len(letter)}{letter[0]}", value))
        out.append((order, found))
        at = struct.unpack(order + ("Q" if big else "I"), body[-inline:])[0]
    return out


def text(values: list | None) -> str:
    return values[0].split(b"\0")[0].decode("latin-1").strip() if values else ""


def colour(f: dict, n: int) -> tuple[str, int, bool, tuple[int, ...]]:
    """Colour kind, alpha band, associated flag and palette."""
    photometric, extra = f.get(PHOTOMETRIC, [1])[0], f.get(EXTRA, [])
    alphas = [i for i, v in enumerate(extra) if v in (1, 2)]
    base = {1: 1, 2: 3, 3: 1}.get(photometric, 0)
    if photometric == 6 and n == 3 and f.get(COMPRESSION, [1])[0] == 7:
        base = 3
    if not base or len(alphas) > 1:
        return "UNSUPPORTED", -1, False, ()
    if photometric == 3:
        return ("PALETTE", -1, False, tuple(f.get(COLOR_MAP, ()))) if n == 1 else ("UNSUPPORTED", -1, False, ())
    if not alphas:
        return ("RGB" if base == 3 else "NUMERIC", -1, False, ()) if base == 1 or n == 3 else ("UNSUPPORTED", -1, False, ())
    if n != base + 1 or len(extra) != 1:
        return "UNSUPPORTED", -1, False, ()
    return "RGB" if base == 3 else "GRAY_ALPHA", n - 1, extra[0] == 1, ()


def georeference(f: dict, width: int, height: int) -> tuple[Grid, str | None]:
    """The grid of pixel centres and the CRS's code."""
    keys = f.get(GEO_KEYS, [])
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    shift = 0.5 if found.get(1025, 1) != 2 else 0.0
    if TRANSFORM in f:
        m = f[TRANSFORM]
        a = (m[0], m[4], m[1], m[5], m[3], m[7])
    elif PIXEL_SCALE in f and TIEPOINT in f:
        s, t = f[PIXEL_SCALE], f[TIEPOINT]
        a = (s[0], 0.0, 0.0, -s[1], t[3] - t[0] * s[0], t[4] + t[1] * s[1])
    else:
        a = (1.0, 0.0, 0.0, -1.0, 0.0, float(height))
    grid = Grid(width, height, *a[:4], a[4] + shift * (a[0] + a[2]), a[5] + shift * (a[1] + a[3]))
    code = found.get(3072) or found.get(2048)
    return grid, f"EPSG:{code}" if code and code != 32767 else None


def directories(source: Source) -> list[Directory]:
    """All images of a file, the first at full resolution."""
    out = []
    for order, f in fields(Header(source)):
        width, height, n = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, [1])[0]
        bits, form = f.get(BITS, [1])[0], f.get(FORMAT, [1])[0]
        kind = {(8, 1): 0, (16, 1): 1, (16, 2): 2, (32, 2): 3, (32, 3): 4, (64, 3): 5}.get((bits, form))
        if kind is None:
            raise ValueError("Unsupported TIFF sample type")
        grid, crs = georeference(f, width, height)
        nd = text(f.get(NO_DATA))
        nd = float(nd) if nd else None
        if nd is not None and kind == 4 and math.isfinite(nd):
            nd = float(np.float32(nd))
        numbers = {(int(i), role): float(v) for v_ in [text(f.get(METADATA))] for i, role, v in re.findall(r'<Item[^>]*sample="(\d+)"[^>]*role="(scale|offset)"[^>]*>([^<]*)<', v_)}
        bands = tuple(Band(f"Band {i + 1}", kind, nd, numbers.get((i, "scale"), 1.0), numbers.get((i, "offset"), 0.0)) for i in range(n))
        color, alpha, associated, palette = colour(f, n)
        tiled = TILE_WIDTH in f
        out.append(
            Directory(
                Descriptor(grid, bands, crs, None, color, alpha, associated, palette),
                order,
                f[TILE_WIDTH][0] if tiled else width,
                f[TILE_HEIGHT][0] if tiled else min(height, f.get(ROWS_PER_STRIP, [height])[0]),
                f.get(COMPRESSION, [1])[0],
                f.get(PLANAR, [1])[0],
                f.get(PREDICTOR, [1])[0],
                tiled,
                *(v if isinstance(v, Stored) else np.array(v, dtype=np.int64) for v in (f[TILE_OFFSETS if tiled else STRIP_OFFSETS], f[TILE_COUNTS if tiled else STRIP_COUNTS])),
            )
        )
    return out


def epsg(crs: str | None) -> int | None:
    """The number that a file names a system by; a text without one can't be written."""
    if not crs:
        return None
    if (m := re.fullmatch(r"(?i)\s*(?:EPSG:)?(\d+)\s*", crs)) is None:
        m = re.fullmatch(r"EPSG:(\d+)", code_of(crs) or "")
    if m is None:
        raise ValueError("A file needs a CRS with a code")
    return int(m[1])


@dataclass(frozen=True)
class Gap:
    """The place of an array that is filled in later."""

    size: int


def entry(tag: int, kind: int, values) -> tuple[int, int, int, bytes | Gap]:
    letter = FIELD_TYPES[kind][1]
    if isinstance(values, Gap):
        return tag, kind, values.size, Gap(values.size * FIELD_TYPES[kind][0])
    data = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{letter[0]}", *values)
    return tag, kind, len(values), data


def describe_fields(d: Descriptor, compression: str, block: int, level: int, big: bool) -> list:
    """The fields of one directory, by tag; the blocks' offsets and lengths are gaps."""
    blocks = Gap(-(-d.grid.width // block) * -(-d.grid.height // block))
    n, kind, grid = len(d.bands), d.data_type, d.grid
    bits, form = {0: (8, 1), 1: (16, 1), 2: (16, 2), 3: (32, 2), 4: (32, 3), 5: (64, 3)}[kind]
    photometric = {"RGB": 2, "PALETTE": 3}.get(d.color, 1)
    extra = n - (3 if d.color == "RGB" else 1)
    out = [
        entry(SUBFILE, 4, [1 if level else 0]), entry(WIDTH, 4, [grid.width]), entry(HEIGHT, 4, [grid.height]), entry(BITS, 3, [bits] * n), entry(COMPRESSION, 3, [COMPRESSIONS[compression]]),
        entry(PHOTOMETRIC, 3, [photometric]), entry(SAMPLES, 3, [n]), entry(PLANAR, 3, [1]), entry(TILE_WIDTH, 3, [block]), entry(TILE_HEIGHT, 3, [block]),
        entry(TILE_OFFSETS, 16 if big else 4, blocks), entry(TILE_COUNTS, 16 if big else 4, blocks), entry(FORMAT, 3, [form] * n),
    ]
    if d.color == "PALETTE":
        size, n_colours = 2**bits, d.palette_size
        out.append(entry(COLOR_MAP, 3, [v for c in range(3) for v in (*d.palette[c * n_colours : (c + 1) * n_colours], *[0] * (size - n_colours))]))
    if extra > 0:
        out.append(entry(EXTRA, 3, [(1 if d.associated_alpha else 2) if d.alpha_band == n - extra + i else 0 for i in range(extra)]))
    if not level:
        x, y = grid.m02 - (grid.m00 + grid.m01) / 2, grid.m12 - (grid.m10 + grid.m11) / 2
        if grid.m01 == grid.m10 == 0 and grid.m11 < 0 < grid.m00:
            out += [entry(PIXEL_SCALE, 12, [grid.m00, -grid.m11, 0.0]), entry(TIEPOINT, 12, [0.0, 0.0, 0.0, x, y, 0.0])]
        else:
            out.append(entry(TRANSFORM, 12, [grid.m00, grid.m01, 0.0, x, grid.m10, grid.m11, 0.0, y, *[0.0] * 7, 1.0]))
        code = epsg(d.crs)
        geographic = code is not None and 4000 <= code < 5000
        keys = [(1024, 2 if geographic else 1), (1025, 1)] + ([(2048 if geographic else 3072, code)] if code else [])
        out.append(entry(GEO_KEYS, 3, [1, 1, 0, len(keys), *(v for k, c in keys for v in (k, 0, 1, c))]))
        items = [f'<Item name="{r.upper()}" sample="{i}" role="{r}">{getattr(b, r)!r}</Item>' for i, b in enumerate(d.bands) for r, plain in (("scale", 1.0), ("offset", 0.0)) if getattr(b, r) != plain]
        if items:
            out.append(entry(METADATA, 2, ("<GDALMetadata>" + "".join(items) + "</GDALMetadata>").encode() + b"\0"))
    if d.bands[0].no_data is not None:
        nd = d.bands[0].no_data
        out.append(entry(NO_DATA, 2, ("nan" if math.isnan(nd) else repr(int(nd)) if nd == int(nd) else repr(nd)).encode() + b"\0"))
    return sorted(out, key=lambda e: e[0])


GHOST = (
    "LAYOUT=IFDS_BEFORE_DATA\nBLOCK_ORDER=ROW_MAJOR\nBLOCK_LEADER=SIZE_AS_UINT4\nBLOCK_TRAILER=LAST_4_BYTES_REPEATED\nKNOWN_INCOMPATIBLE_EDITION=NO\n "
)


def layout(levels: list[Descriptor], compression: str, block: int, big: bool, cog: bool) -> tuple[list[tuple[int, bytes]], int, list[tuple[int, int, int]]]:
    """Everything before the blocks: pieces with their places, the whole length, and where each level's arrays go.

    An array's place is (offsets at, lengths at, bytes of one number). What
    isn't in a piece is zero, so nothing here grows with the number of blocks.
    """
    ghost = (f"GDAL_STRUCTURAL_METADATA_SIZE={len(GHOST):06d} bytes\n" + GHOST).encode() if cog else b""
    start = (struct.pack("<2sHHHQ" if big else "<2sHI", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0)) + ghost
    pieces, length, arrays = [(0, start)], -(-len(start) // 16) * 16, []
    link, number = 8 if big else 4, "<Q" if big else "<I"
    for level, d in enumerate(levels):
        made = describe_fields(d, compression, block, level, big)
        pieces.append((link, struct.pack(number, length)))
        size, inline = (20, 8) if big else (12, 4)
        body, tail = bytearray(struct.pack("<Q" if big else "<H", len(made))), length + (8 if big else 2) + size * len(made) + inline
        places = {}
        for tag, kind, n, data in made:
            body += struct.pack("<HHQ" if big else "<HHI", tag, kind, n)
            long = data.size if isinstance(data, Gap) else len(data)
            if long <= inline:
                places[tag] = length + len(body)
                body += b"\0" * inline if isinstance(data, Gap) else data.ljust(inline, b"\0")
                continue
            tail += tail % 2
            places[tag] = tail
            body += struct.pack(number, tail)
            if not isinstance(data, Gap):
                pieces.append((tail, data))
            tail += long
        arrays.append((places[TILE_OFFSETS], places[TILE_COUNTS], 8 if big else 4))
        pieces.append((length, bytes(body)))
        link = length + len(body)
        length = -(-tail // 16) * 16
    return pieces, length, arrays


def head(levels: list[tuple[Descriptor, list[int], list[int]]], compression: str, block: int, big: bool, cog: bool) -> bytes:
    """Everything before the blocks of a small file, with offsets and lengths at hand."""
    pieces, length, arrays = layout([d for d, _, _ in levels], compression, block, big, cog)
    out = bytearray(length)
    for (_, offsets, counts), (at, lengths, width) in zip(levels, arrays, strict=True):
        pieces += [(at, struct.pack(f"<{len(offsets)}{'Q' if width == 8 else 'I'}", *offsets)), (lengths, struct.pack(f"<{len(counts)}{'Q' if width == 8 else 'I'}", *counts))]
    for at, data in pieces:
        out[at : at + len(data)] = data
    return bytes(out)
