"""Recipes as values: describe a file, derive operations, open what they say.

Deriving only plans: it needs descriptors, not files. Opening checks that the
source and every step still have the descriptors that were planned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import recipe
from tessera.functions.crs import transform
from tessera.functions.geometry import NUMBER
from tessera.functions.pixel import representable
from tessera.model import MAX_STEPS, Descriptor, from_struct, to_struct
from tessera.operators import clip as clipping
from tessera.operators import collection
from tessera.operators import reproject as warping
from tessera.raster import Raster
from tessera.sources import raster_files


def describe(location: str) -> dict:
    """The recipe of a file, without steps."""
    d, identity = raster_files.describe(location)
    return {"source": {"location": recipe.reference(location), "identity": identity}, "descriptor": to_struct(d), "steps": []}


def described(spark: SparkSession, locations: Sequence[str]) -> DataFrame:
    """One row (location, raster) for each file; directories are read by tasks."""
    return described_rows(spark.createDataFrame([(x,) for x in locations], "location string"))


def described_rows(rows: DataFrame, location: str = "location") -> DataFrame:
    """(location, raster) for each row's file; directories are read by tasks."""
    schema = StructType.fromDDL(f"location string, raster {recipe.RASTER_TYPE}")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["raster"].dataType)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([describe(x) for x in batch.column(0).to_pylist()], kind)], names=["location", "raster"])

    spread = rows.select(rows[location].alias("location")).repartition(collection.tasks_of(rows), "location")
    return spread.mapInArrow(run, schema)


def same(a: dict, b: dict) -> bool:
    """Whether two descriptors have the same values (NaN equals NaN) and systems that differ in names at most."""
    return collection.same(from_struct(a), from_struct(b))


def current(value: dict) -> Descriptor:
    return from_struct(value["steps"][-1]["output"] if value["steps"] else value["descriptor"])


def extended(value: dict, kind: str, origin: str, payload: dict, output: Descriptor) -> dict:
    if len(value["steps"]) >= MAX_STEPS:
        raise ValueError("A raster has too many operations")
    step = {"kind": kind, "origin": origin, "clip": None, "reproject": None, kind: payload, "output": to_struct(output)}
    return value | {"steps": [*value["steps"], step]}


def derive_clip(value: dict, wkt: str, mask: bool = False, bands: Sequence[int] | None = None, no_data: float | None = None, origin: str = "clip") -> dict:
    """The recipe with a clip; the value given stays as it is."""
    d = current(value)
    output, _, chosen, _ = clipping.plan(d, wkt, mask, bands, no_data)
    return extended(value, "clip", origin, {"polygon_wkt": wkt, "polygon_mask": mask, "bands": chosen, "no_data": no_data}, output)


def derive_reproject(value: dict, resolution_x: float, resolution_y: float | None = None, target_crs: str | None = None, extent: Sequence[float] = (), interpolation: str = "NEAREST", output_type: str = "AUTO", source_no_data: float | None = None, output_no_data: float | None = None, origin: str = "reproject") -> dict:
    """The recipe with a reprojection; the value given stays as it is."""
    ry = resolution_x if resolution_y is None else resolution_y
    output = warping.plan(current(value), resolution_x, ry, extent or None, interpolation, output_type, source_no_data, output_no_data, target_crs)
    payload = {"target_crs": target_crs, "resolution_x": float(resolution_x), "resolution_y": float(ry), "extent": [float(v) for v in extent], "interpolation": interpolation, "output_type": output_type, "source_no_data": source_no_data, "output_no_data": output_no_data}
    return extended(value, "reproject", origin, payload, output)


def open_raster(spark: SparkSession, value: dict) -> Raster:
    """The lazy raster of a recipe; a source or step that has changed is an error."""
    source = value["source"]
    r = raster_files.read_raster(spark, source["location"], identity=source["identity"])
    if not same(to_struct(r.descriptor), value["descriptor"]):
        raise ValueError("The source's metadata changed since it was described")
    for step in value["steps"]:
        p = step[step["kind"]]
        if step["kind"] == "clip":
            r = r.clip(p["polygon_wkt"], p["polygon_mask"], p["bands"], p["no_data"], step["origin"])
        else:
            r = r.reproject(p["resolution_x"], p["resolution_y"], p["extent"] or None, p["interpolation"], p["output_type"], p["source_no_data"], p["output_no_data"], p["target_crs"], step["origin"])
        if not same(to_struct(r.descriptor), step["output"]):
            raise ValueError(f"Raster operation '{step['origin']}' has another result than planned")
    return r


def clip_file(spark: SparkSession, location: str, wkt: str, path: str, work_dir: str, mask: bool = False, band: int = 0, no_data: float | None = None, overwrite: bool = False) -> int:
    """Clip one band of a file to a new file, as numeric samples."""
    r = raster_files.read_raster(spark, location)
    d = r.descriptor
    if not 0 <= band < len(d.bands):
        raise ValueError("Band outside raster")
    if not representable(no_data, d.data_type, lenient=True):
        raise ValueError("NoData outside the sample type")
    one = Raster(r.pixels.where(F.col("band") == band).withColumn("band", F.lit(0)), Descriptor(d.grid, (d.bands[band],), d.crs))
    return raster_files.write_raster(one.clip(wkt, mask, no_data=no_data), path, work_dir, overwrite=overwrite, source=location)


def reproject_file(spark: SparkSession, location: str, path: str, work_dir: str, resolution: float, overwrite: bool = False, **options) -> int:
    """Reproject a file to a new file."""
    r = raster_files.read_raster(spark, location).reproject(resolution, **options)
    return raster_files.write_raster(r, path, work_dir, overwrite=overwrite, source=location)


def zones_in(zones: DataFrame, source_crs: str, target_crs: str, wkt: str = "wkt") -> DataFrame:
    """``zones`` with their polygons' coordinates in another system; the input stays as it is."""
    if transform(source_crs, target_crs) is None:
        return zones
    at, schema, names = zones.columns.index(wkt), zones.schema, zones.columns

    def run(batches: Iterator) -> Iterator:
        import re

        import numpy as np
        import pyarrow as pa

        change, pair = transform(source_crs, target_crs), re.compile(rf"({NUMBER})\s+({NUMBER})")

        def moved(text: str | None) -> str | None:
            points = pair.findall(text or "")
            if not points:
                return text
            x, y = change(*np.array(points, dtype=np.float64).T)
            new = iter(zip(x.tolist(), y.tolist(), strict=True))
            return pair.sub(lambda _: "{!r} {!r}".format(*next(new)), text)

        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([moved(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return zones.mapInArrow(run, schema)


def clip_rows(rows: DataFrame, wkt: str, raster: str = "raster", to: str | None = None, mask: bool = False, bands: Sequence[int] | None = None, no_data: float | None = None, origin: str = "clip") -> DataFrame:
    """``rows`` with each recipe clipped to the polygon in the row's column ``wkt``."""
    return collection.derived(rows, lambda value, text: derive_clip(value, text, mask, bands, no_data, origin), raster, to, rows[wkt])


def reproject_rows(rows: DataFrame, resolution_x: float, resolution_y: float | None = None, raster: str = "raster", to: str | None = None, **options) -> DataFrame:
    """``rows`` with each recipe reprojected; options are those of :func:`derive_reproject`."""
    return collection.derived(rows, lambda value: derive_reproject(value, resolution_x, resolution_y, **options), raster, to)


open_tiles = collection.open_tiles
zonal_rows = collection.zonal_rows
