"""Rasters as values of rows: one plan over the files of a whole column of recipes.

A recipe becomes a *work list*. Its result is cut into rectangles; a
rectangle's window is followed back through the recipe's steps to the blocks
of its source that it needs. The work of all recipes together is grouped by
source and place, so that a block is read once, neighbouring blocks by one
request, however many rows ask for them; then it is grouped by recipe and
rectangle, and kernels run the steps on the rectangle's window. Nothing
loops over files or rows on the driver, and no raster lies in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessera import recipe
from tessera.failures import failing
from tessera.functions import coverage, kernels
from tessera.functions.crs import equivalent
from tessera.functions.geometry import aligned, parse_polygon, rings_in_pixels
from tessera.functions.pixel import stored_no_data
from tessera.model import Descriptor, from_struct
from tessera.operators import clip as clipping
from tessera.operators import reproject as warping
from tessera.operators import zonal
from tessera.sources.data_source import directory
from tessera.sources.ranges import Source, merged_reads
from tessera.sources.tiff import Directory

#: A rectangle's side, in pixels of the result.
SIDE = 256
#: Tasks of each stage for each core that Spark knows of, so that small work lists of many files are spread too.
WAVES = 3
#: Bytes of a file whose blocks one task reads.
STRETCH = 64 * 1024 * 1024
RECT = "rx int, ry int, rw int, rh int"
WORK = f"key binary, {RECT}, location string, identity string, stretch long, start long, length long, tile_x int, tile_y int, plane int, recipe binary"
BLOCK = f"key binary, {RECT}, plane int, tile_x int, tile_y int, recipe binary, data binary, bytes long, requests long"
TILE = "key binary, band int, tile_x int, tile_y int, x int, y int, width int, height int, samples array<double>"


def same(a: Descriptor, b: Descriptor) -> bool:
    """Whether descriptors have the same values (NaN is NaN) and systems that differ in names at most."""
    return repr(replace(a, crs=None)) == repr(replace(b, crs=None)) and equivalent(a.crs, b.crs)


class Chain:
    """A recipe's steps over windows: what a window needs of the source, and its samples from those."""

    def __init__(self, value: dict):
        self.location, self.identity = value["source"]["location"], value["source"]["identity"]
        self.descriptors = [from_struct(value["descriptor"])]
        self.steps = []
        for s in value["steps"]:
            d, p, origin = self.descriptors[-1], s[s["kind"]], s["origin"]
            with failing(origin, self.location):
                if s["kind"] == "clip":
                    made, window, chosen, added = clipping.plan(d, p["polygon_wkt"], p["polygon_mask"], p["bands"], p["no_data"])
                    self.steps.append(("clip", origin, window, chosen, added, p, None))
                else:
                    made = warping.plan(d, p["resolution_x"], p["resolution_y"], p["extent"] or None, p["interpolation"], p["output_type"], p["source_no_data"], p["output_no_data"], p["target_crs"])
                    change = warping.transform(made.crs, d.crs)
                    self.steps.append(("reproject", origin, None, None, None, p, change))
                if not same(made, from_struct(s["output"])):
                    raise ValueError("It has another result than planned")
            self.descriptors.append(made)
        self._masks: dict = {}

    @property
    def result(self) -> Descriptor:
        return self.descriptors[-1]

    def boxes(self, rect: tuple[int, int, int, int]) -> list[tuple[int, int, int, int] | None]:
        """The box (x0, y0, x1, y1) of each step's input that a rectangle needs, the source's first; None where it needs nothing."""
        box, out = (rect[0], rect[1], rect[0] + rect[2], rect[1] + rect[3]), []
        for k in range(len(self.steps) - 1, -1, -1):
            kind, _, window, *_, change = self.steps[k]
            if box is not None and kind == "clip":
                box = (box[0] + window[0], box[1] + window[1], box[2] + window[0], box[3] + window[1])
            elif box is not None:
                x, y, w, h = box[0], box[1], box[2] - box[0], box[3] - box[1]
                box = kernels.needed_box(*kernels.places(self.descriptors[k].grid, self.descriptors[k + 1].grid, x, y, w, h, change), self.descriptors[k].grid)
            out.append(box)
        return out[::-1]

    def parts(self, rect: tuple[int, int, int, int]) -> Iterator[tuple[tuple[int, int, int, int], tuple[int, int, int, int] | None]]:
        """(rectangle, the source's box) of a rectangle, halved until no step's box has over MAX_PIXELS."""
        boxes = self.boxes(rect)
        if all(b is None or (b[2] - b[0]) * (b[3] - b[1]) <= warping.MAX_PIXELS for b in boxes):
            yield rect, (boxes[0] if boxes else (rect[0], rect[1], rect[0] + rect[2], rect[1] + rect[3]))
            return
        x, y, w, h = rect
        if w == h == 1:
            raise ValueError("One pixel's neighbourhood is over the limit")
        for half in ((x, y, w // 2, h), (x + w // 2, y, w - w // 2, h)) if w >= h else ((x, y, w, h // 2), (x, y + h // 2, w, h - h // 2)):
            yield from self.parts(half)

    def covered(self, k: int, x: int, y: int, width: int, height: int):
        """What a clip's polygon covers of a window of its input; pieces are kept, a tile at a time."""
        import numpy as np

        if k not in self._masks:
            grid = self.descriptors[k].grid
            edges = rings_in_pixels(parse_polygon(aligned(self.steps[k][5]["polygon_wkt"], self.descriptors[k].crs)), grid)
            box = coverage.box_of(edges, grid.width, grid.height)
            self._masks[k] = {(tx, ty): (near, parity) for tx, ty, near, parity in coverage.zone_tiles(edges, box, SIDE)}
        out = np.zeros((height, width), bool)
        for tx in range(x // SIDE, (x + width - 1) // SIDE + 1):
            for ty in range(y // SIDE, (y + height - 1) // SIDE + 1):
                if (tx, ty) in self._masks[k]:
                    near, parity = self._masks[k][tx, ty]
                    m = np.ones((SIDE, SIDE), bool) if near is None else coverage.mask(near, parity, tx, ty, SIDE)
                    a, b = max(x, tx * SIDE), max(y, ty * SIDE)
                    c, d = min(x + width, (tx + 1) * SIDE), min(y + height, (ty + 1) * SIDE)
                    out[b - y : d - y, a - x : c - x] = m[b - ty * SIDE : d - ty * SIDE, a - tx * SIDE : c - tx * SIDE]
        return out

    def run(self, rect: tuple[int, int, int, int], samples: kernels.Window):
        """(bands, rows, columns) of the result's rectangle."""
        boxes = [*self.boxes(rect), (rect[0], rect[1], rect[0] + rect[2], rect[1] + rect[3])]
        for k, (kind, origin, window, chosen, added, p, change) in enumerate(self.steps):
            if boxes[k + 1] is None:  # nothing after needs anything of this step
                samples = kernels.Window.empty(0, 0, 1, 1, len(self.descriptors[k + 1].bands))
                continue
            x, y, w, h = boxes[k + 1][0], boxes[k + 1][1], boxes[k + 1][2] - boxes[k + 1][0], boxes[k + 1][3] - boxes[k + 1][1]
            with failing(origin, self.location):
                if kind == "clip":
                    inside = self.covered(k, x + window[0], y + window[1], w, h) if p["polygon_mask"] else None
                    made = kernels.cut(self.descriptors[k], self.descriptors[k + 1], samples, chosen, added, p["no_data"], inside)
                else:
                    made = kernels.warp(self.descriptors[k], self.descriptors[k + 1], samples, x, y, w, h, p["interpolation"], p["source_no_data"], change)
            samples = kernels.Window(x, y, made)
        return samples.raw


def keyed(rows: DataFrame, raster: str = "raster", to: str = "key") -> DataFrame:
    """``rows`` with their recipe's digest; equal recipes have equal keys."""
    return rows.withColumn(to, F.when(rows[raster].isNotNull(), F.unhex(F.sha2(F.to_json(rows[raster]), 256))))


def tasks_of(df: DataFrame) -> int:
    return WAVES * df.sparkSession.sparkContext.defaultParallelism


def all_tiles(recipes: DataFrame) -> DataFrame:
    """(key, raster, tile_x, tile_y): every tile of each recipe's result."""
    grid = recipe.result(F.col("raster"))["grid"]
    last = lambda size: F.floor((grid[size] - 1) / SIDE).cast("int")
    return recipes.select("key", "raster", F.explode(F.sequence(F.lit(0), last("width"))).alias("tile_x")).select("*", F.explode(F.sequence(F.lit(0), last("height"))).alias("tile_y"))


def work_list(wanted: DataFrame) -> DataFrame:
    """The blocks that tiles (key, raster, tile_x, tile_y) need, one row for each part of a tile and block.

    Reads the directories of the sources, in tasks. A part that needs no block
    has one row without a range, so that it is made all the same; the first row
    of each part carries its recipe.
    """
    names = [f.split()[0] for f in WORK.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        chains: dict[bytes, Chain] = {}
        kinds = [pa.binary(), *[pa.int32()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3, *[pa.int32()] * 3, pa.binary()]

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out: list = []
            for key, value, tx, ty in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if key not in chains:
                    chains.clear()  # rows of a recipe follow each other
                    chains[key] = Chain(value.as_py())
                    coded = recipe.encode(value.as_py())
                chain = chains[key]
                with failing("read", chain.location):
                    d = directory(chain.location, chain.identity)
                    if not same(d.descriptor, chain.descriptors[0]):
                        raise ValueError("The source's metadata changed since it was described")
                grid, left, top = chain.result.grid, tx * SIDE, ty * SIDE
                for rect, box in chain.parts((left, top, min(SIDE, grid.width - left), min(SIDE, grid.height - top))):
                    out += [(key, *rect, chain.location, chain.identity, *r, None if i else coded) for i, r in enumerate(block_ranges(d, box))]
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    near = wanted.select("key", "raster", "tile_x", "tile_y").repartition(tasks_of(wanted), "key", F.floor(F.col("tile_y") / 16)).sortWithinPartitions("key", "tile_y", "tile_x")
    return near.mapInArrow(run, WORK)


def block_ranges(d: Directory, box: tuple[int, int, int, int] | None) -> list[tuple]:
    """(stretch, start, length, tile_x, tile_y, plane) of the blocks of a box; one without a range if there are none."""
    out = []
    if box is not None:
        for ty in range(box[1] // d.block_height, (box[3] - 1) // d.block_height + 1):
            for tx in range(box[0] // d.block_width, (box[2] - 1) // d.block_width + 1):
                for plane in range(len(d.descriptor.bands) if d.planar == 2 else 1):
                    k = ty * d.across + tx + plane * d.across * d.down
                    out.append((int(d.offsets[k]) // STRETCH, int(d.offsets[k]), int(d.counts[k]), tx, ty, plane))
    return out or [(0, None, None, None, None, None)]


def blocks(work: DataFrame, io: Observation | None = None) -> DataFrame:
    """The encoded bytes of the work list's blocks; those that are near in a file come by one request.

    ``io`` observes the bytes and requests of the tasks that succeed.
    """
    names = [f.split()[0] for f in BLOCK.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        source = None
        for batch in batches:
            kept = [batch.column(i) for i in (0, 1, 2, 3, 4, 12, 10, 11, 13)]
            location, identity, start, length = (batch.column(i).to_pylist() for i in (5, 6, 8, 9))
            first = 0
            while first < batch.num_rows:
                last = first
                while last < batch.num_rows and (location[last], identity[last]) == (location[first], identity[first]):
                    last += 1
                asked = [(start[i], length[i]) for i in range(first, last)]
                if source is None or (source.location, source.asked_as) != (location[first], identity[first]):
                    source = Source(location[first], identity[first])
                    source.asked_as = identity[first]
                at, before = first, (source.bytes_read, source.requests)
                with failing("read", location[first]):
                    for data in merged_reads(source, asked):
                        n = len(data)
                        more = [pa.array([now - was, *[0] * (n - 1)], pa.int64()) for now, was in zip((source.bytes_read, source.requests), before, strict=True)]
                        yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in kept), pa.array(data, pa.binary()), *more], names=names)
                        at, before = at + n, (source.bytes_read, source.requests)
                first = last

    near = work.repartition(tasks_of(work), "location", "identity", "stretch").sortWithinPartitions("location", "identity", "start")
    found = near.mapInArrow(run, BLOCK)
    return found if io is None else found.observe(io, F.sum("bytes").alias("bytes"), F.sum("requests").alias("requests"))


def result_tiles(wanted: DataFrame, bands: list[int] | None = None, io: Observation | None = None) -> DataFrame:
    """(key, band, tile_x, tile_y, x, y, width, height, samples): the results' tiles, those of a halved tile in parts."""
    # A group is one rectangle's blocks, which hold its window of MAX_PIXELS and what they have beside it.
    found = F.collect_list(F.when(F.col("plane").isNotNull(), F.struct("plane", "tile_x", "tile_y", "data")))
    whole = blocks(work_list(wanted), io).groupBy("key", "rx", "ry", "rw", "rh").agg(F.max("recipe").alias("recipe"), found.alias("blocks"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        chains: dict[bytes, Chain] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                key, rx, ry, rw, rh = (batch.column(k)[i].as_py() for k in range(5))
                if key not in chains:
                    chains.clear()
                    chains[key] = Chain(recipe.decode(batch.column(5)[i].as_py()))
                chain, rect = chains[key], (rx, ry, rw, rh)
                out = chain.run(rect, window_of(chain, rect, batch.column(6)[i].as_py()))
                chosen = range(len(out)) if bands is None else bands
                if any(not 0 <= b < len(out) for b in chosen):
                    raise ValueError("The raster has no such band")
                own = [out[b].ravel() for b in chosen]
                samples = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * (rw * rh)), pa.array(np.concatenate(own)))
                fixed = lambda v: pa.array(np.full(len(own), v, np.int32))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(own), pa.binary()), pa.array(list(chosen), pa.int32()), *map(fixed, (rx // SIDE, ry // SIDE, rx, ry, rw, rh)), samples], names=[f.split()[0] for f in TILE.split(", ")])

    return whole.mapInArrow(run, TILE)


def window_of(chain: Chain, rect: tuple[int, int, int, int], found: list[dict]) -> kernels.Window:
    """The source's window that a rectangle needs, from its blocks."""
    import numpy as np

    boxes = chain.boxes(rect)
    box = boxes[0] if boxes else (rect[0], rect[1], rect[0] + rect[2], rect[1] + rect[3])
    n = len(chain.descriptors[0].bands)
    if box is None:
        return kernels.Window.empty(0, 0, 1, 1, n)
    samples = kernels.Window.empty(box[0], box[1], box[2] - box[0], box[3] - box[1], n)
    d = directory(chain.location, chain.identity)
    for b in found:
        rows = d.rows_of(b["tile_y"])
        block = d.decode(b["data"], rows) if b["data"] else np.zeros((rows, d.block_width, 1 if d.planar == 2 else n))
        for band in (b["plane"],) if d.planar == 2 else range(n):
            samples.put_block(band, b["tile_x"] * d.block_width, b["tile_y"] * d.block_height, block[:, :, 0 if d.planar == 2 else band].astype(np.float64))
    return samples


def open_tiles(rows: DataFrame, raster: str = "raster", bands: list[int] | None = None, io: Observation | None = None) -> DataFrame:
    """The tiles of all results of a column of recipes; rows with equal recipes share them, null ones have none."""
    recipes = keyed(rows.select(rows[raster].alias("raster"))).where("raster IS NOT NULL").groupBy("key").agg(F.first("raster").alias("raster"))
    return result_tiles(all_tiles(recipes), bands, io)


def zonal_rows(rows: DataFrame, raster: str = "raster", wkt: str = "wkt", band: int = 0, no_data: float | None = None, zone_crs: str | None = None, prefix: str = "", io: Observation | None = None) -> DataFrame:
    """``rows`` with the statistics of each row's zone over each row's raster, as columns ``prefix`` + name.

    Statuses and rules are those of :func:`tessera.operators.zonal.zonal_statistics`;
    a null recipe has the status NO_RASTER. Only blocks that a zone touches are
    read, each once for all rows that share the source. Rows keep their
    columns; a name that the statistics need is an error.
    """
    names = [*zonal.STATISTICS, "status"]
    if clash := {f"{prefix}{n}".lower() for n in names} & {c.lower() for c in rows.columns}:
        raise ValueError(f"Columns exist already: {', '.join(sorted(clash))}")
    pairs = keyed(rows.select(rows[raster].alias("raster"), rows[wkt].alias("wkt"))).where("raster IS NOT NULL")
    pair_key = lambda key, wkt: F.unhex(F.sha2(F.concat(F.hex(key), F.lit(" "), F.coalesce(wkt, F.lit("null "))), 256))
    pairs = pairs.select(pair_key(F.col("key"), F.col("wkt")).alias("pair"), "key", "raster", "wkt").groupBy("pair").agg(*(F.first(c).alias(c) for c in ("key", "raster", "wkt")))
    pieces = raster_pieces(pairs, zone_crs)
    recipes = pairs.groupBy("key").agg(F.first("raster").alias("raster"))
    wanted = pieces.where("tile_y >= 0").select("key", "tile_x", "tile_y").distinct().join(recipes, "key")
    own = recipe.result(F.col("raster"))["bands"]
    rules = recipes.select("key", F.get(own, F.lit(band)).alias("rule"))
    tiles = result_tiles(wanted, [band], io).join(rules, "key").select("key", "tile_x", "tile_y", "x", "y", "width", "samples", "rule")
    met = pieces.join(tiles, ["key", "tile_x", "tile_y"], "left")
    found = zonal.finished(zonal.merged(row_statistics(met, no_data)))
    stats = found.select(F.col("zone_id").alias("pair"), *names)
    left = keyed(rows, raster, "_raster_key").withColumn("_pair_key", pair_key(F.col("_raster_key"), rows[wkt]))
    out = left.join(stats.select(F.col("pair").alias("_pair_key"), *(F.col(n).alias(f"{prefix}{n}") for n in names)), "_pair_key", "left")
    status = F.when(F.col("_raster_key").isNull(), "NO_RASTER").otherwise(F.col(f"{prefix}status"))
    return out.select(*rows.columns, *(F.col(f"{prefix}{n}") if n not in ("status", "count") else status.alias(f"{prefix}status") if n == "status" else F.coalesce(F.col(f"{prefix}count"), F.lit(0)).alias(f"{prefix}count") for n in names))


def raster_pieces(pairs: DataFrame, zone_crs: str | None) -> DataFrame:
    """Pieces of each pair's zone over its result's grid, and one row for the pair itself."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.binary()]
        names = ["pair", "key", "n", "empty", "tile_x", "tile_y", "near", "parity"]
        for batch in batches:
            for pair, key, value, wkt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                value = value.as_py()
                d = from_struct(value["steps"][-1]["output"] if value["steps"] else value["descriptor"])
                with failing("statistics", value["source"]["location"]):
                    found = zonal.pieces_of(wkt, d.grid, d.crs, zone_crs, SIDE)
                out = [(pair, key, 1, found is None, -1, -1, None, None), *((pair, key, None, None, *p) for p in found or [])]
                for at in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 10_000], strict=True), kinds, strict=True)], names=names)

    spread = pairs.select("pair", "key", "raster", "wkt").repartition(tasks_of(pairs), "pair")
    return spread.mapInArrow(run, f"pair binary, key binary, n long, empty boolean, {zonal.PIECE}")


def row_statistics(met: DataFrame, no_data: float | None) -> DataFrame:
    """Partial statistics of pieces and the parts of the tiles that they met."""
    schema = StructType([StructField("key", BinaryType()), StructField("zone_id", BinaryType()), *StructType.fromDDL(f"n long, empty boolean, {zonal.PARTIAL}").fields])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        last, whole = None, []
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out, origin = [], []
            for i in range(batch.num_rows):
                tx, ty = col["tile_x"][i].as_py(), col["tile_y"][i].as_py()
                if ty < 0 or not col["samples"][i].is_valid:
                    rows = [(None,) * 6] if ty < 0 else []
                else:
                    x, y, width = (col[c][i].as_py() for c in ("x", "y", "width"))
                    place = (col["key"][i].as_py(), x, y)
                    inside = not col["near"][i].is_valid
                    if not inside or last != place:
                        rule = col["rule"][i].as_py()
                        raw = col["samples"][i].values.to_numpy(zero_copy_only=False).reshape(-1, width)
                        with np.errstate(over="ignore", invalid="ignore"):
                            value = raw * rule["scale"] + rule["offset"]
                        good = kernels.fine(raw, stored_no_data(rule["no_data"], rule["data_type"]), rule["data_type"], no_data) & np.isfinite(value)
                        if not inside:
                            m = coverage.mask(col["near"][i].values.to_numpy(zero_copy_only=False).reshape(-1, 4), np.frombuffer(col["parity"][i].as_py(), dtype=bool), tx, ty, SIDE)
                            rows = zonal.partial(value[good & m[y - ty * SIDE :, x - tx * SIDE :][: value.shape[0], :width]])
                        else:
                            last, whole = place, zonal.partial(value[good])
                    if inside:
                        rows = whole
                out += rows
                origin += [i] * len(rows)
            if out:
                at = pa.array(origin, pa.int64())
                own = col["pair"].take(at)
                yield pa.RecordBatch.from_arrays([own, own, col["n"].take(at), col["empty"].take(at), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=schema.names)

    return met.select("key", "pair", "n", "empty", "tile_x", "tile_y", "near", "parity", "x", "y", "width", "samples", "rule").mapInArrow(run, schema)


def derived(rows: DataFrame, change, raster: str = "raster", to: str | None = None, *more: Column) -> DataFrame:
    """``rows`` with each recipe changed by ``change(recipe, *values of more)``, in place or as column ``to``; null stays null.

    Deriving plans only, so no file is opened; a step that can't be is an error.
    """
    target = to or raster
    args = [f"_arg{i}" for i in range(len(more))]
    kept = [c for c in rows.columns if c != target]
    wide = rows.select(*rows.columns, *(m.alias(a) for m, a in zip(more, args, strict=True)))
    kind = StructType.fromDDL(f"`{target}` {recipe.RASTER_TYPE}").fields[0]
    schema = StructType([*(f for f in rows.schema.fields if f.name in kept), kind])
    names = wide.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind.dataType)
        for batch in batches:
            values = zip(batch.column(names.index(raster)).to_pylist(), *(batch.column(names.index(a)).to_pylist() for a in args), strict=True)
            made = [None if v is None else change(v, *rest) for v, *rest in values]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), pa.array(made, arrow)], names=[*kept, target])

    return wide.mapInArrow(run, schema)
