"""GeoParquet: polygons as WKB in Parquet files with a `geo` footer and a bounding box for each row.

spark.dataSource.register(GeoParquet); df.write.format("geoparquet").mode("append").option("crs", "EPSG:4326").save(path)

The column `points` becomes `geometry` (WKB) and `bbox` (xmin, ymin, xmax, ymax); others are written as they are.  Each task
writes files of its own by Arrow, under names that readers skip until the job commits, when they are renamed; the folder
must be one that pyarrow reaches (a local or mounted folder, S3, GCS, HDFS).  Any Parquet reader reads the files; `read`
turns geometries back into points and leaves row groups and columns that aren't wanted unread.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from parcelflow.functions.geometry import POINTS
from parcelflow.sources.geopackage import parse_wkb

# WKB codes of areal geometries.
POLYGON, MULTIPOLYGON = 3, 6
BOX = ("xmin", "ymin", "xmax", "ymax")
#: Rows of a row group, which is what a filter by boxes may skip.
GROUP = 8192


def wkb(points: pa.Array) -> tuple[pa.Array, pa.Array, set[str]]:
    """WKB and bounding boxes of polygons, and the kinds among them; null and empty polygons have neither."""
    points = points.combine_chunks() if isinstance(points, pa.ChunkedArray) else points
    sizes = pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False)
    flat = points.flatten()
    part, ring, x, y = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("part", "ring", "x", "y"))
    xy = np.stack([x, y], axis=1).astype("<f8") if len(x) else np.zeros((0, 2))
    ends = np.cumsum(sizes)
    shapes, boxes, kinds = [], [], set()
    for a, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        if a == e:
            shapes.append(None)
            boxes.append(None)
            continue
        cuts = [a, *(a + 1 + np.flatnonzero((part[a + 1 : e] != part[a : e - 1]) | (ring[a + 1 : e] != ring[a : e - 1]))).tolist(), e]
        polygons: dict[int, list[bytes]] = {}
        for s, t in zip(cuts[:-1], cuts[1:], strict=True):  # rings are closed by their first point
            polygons.setdefault(int(part[s]), []).append(struct.pack("<I", t - s + 1) + xy[s:t].tobytes() + xy[s].tobytes())
        whole = [struct.pack("<BII", 1, POLYGON, len(r)) + b"".join(r) for r in polygons.values()]
        kinds.add("Polygon" if len(whole) == 1 else "MultiPolygon")
        shapes.append(whole[0] if len(whole) == 1 else struct.pack("<BII", 1, MULTIPOLYGON, len(whole)) + b"".join(whole))
        boxes.append(dict(zip(BOX, (*xy[a:e].min(0).tolist(), *xy[a:e].max(0).tolist()), strict=True)))
    return pa.array(shapes, pa.binary()), pa.array(boxes, pa.struct([(c, pa.float64()) for c in BOX])), kinds


def footer(kinds: set[str], box: list[float] | None, crs: str | None) -> str:
    """The metadata of a file; without a crs it says that none is known."""
    column = {"encoding": "WKB", "geometry_types": sorted(kinds), "crs": {"id": dict(zip(("authority", "code"), crs.split(":", 1), strict=True))} if crs else None, "covering": {"bbox": {c: ["bbox", c] for c in BOX}}}
    return json.dumps({"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column | ({"bbox": box} if box else {})}})


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class GeoParquetWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.crs, self.overwrite = options["path"], options.get("crs"), overwrite

    def folder(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = self.folder()
        fs.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.parquet"
        sink, writer, kinds, low, high = None, None, set(), [], []
        for batch in iterator:
            geometry, box, own = wkb(batch.column("points"))
            kinds |= own
            out = pa.Table.from_batches([batch]).drop_columns(["points"]).append_column("geometry", geometry).append_column("bbox", box)
            sink = sink or fs.open_output_stream(f"{folder}/_{name}")
            writer = writer or pq.ParquetWriter(sink, out.schema)
            if own:
                low.append([pc.min(box.field(c)).as_py() for c in BOX[:2]])
                high.append([pc.max(box.field(c)).as_py() for c in BOX[2:]])
            writer.write_table(out, row_group_size=GROUP)
        if writer is None or sink is None:
            return Written([])
        whole = [*np.min(low, axis=0).tolist(), *np.max(high, axis=0).tolist()] if low else None
        writer.add_key_value_metadata({"geo": footer(kinds, whole, self.crs)})
        writer.close()
        sink.close()
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = self.folder()
        fs.create_dir(folder, recursive=True)
        names = [n for m in messages if m for n in m.names]
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(folder)):
                if f.base_name.startswith("part-"):
                    fs.delete_file(f.path)
        for n in names:  # names of files, not rows
            fs.move(f"{folder}/_{n}", f"{folder}/{n}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = self.folder()
        for n in (n for m in messages if m for n in m.names):
            if fs.get_file_info(f"{folder}/_{n}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{folder}/_{n}")


class GeoParquet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geoparquet"

    def schema(self) -> str:
        raise NotImplementedError("read the files as Parquet, by geoparquet.read()")

    def writer(self, schema: StructType, overwrite: bool) -> GeoParquetWriter:
        return GeoParquetWriter(dict(self.options), overwrite)


def read(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The rows whose boxes meet a box, with the columns asked for and points; files without `bbox` are read whole."""
    df = spark.read.parquet(path)
    if box and "bbox" in df.columns:
        x0, y0, x1, y1 = map(float, box)
        df = df.filter((F.col("bbox.xmin") <= x1) & (F.col("bbox.xmax") >= x0) & (F.col("bbox.ymin") <= y1) & (F.col("bbox.ymax") >= y0))
    wanted = columns if columns is not None else [c for c in df.columns if c not in ("geometry", "bbox")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if g is None else [dict(zip(("part", "ring", "x", "y"), p, strict=True)) for p in parse_wkb(g)] for g in batch.column("geometry").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in wanted), pa.array(rows, kind)], [*wanted, "points"])

    kind = pa.list_(pa.struct([("part", pa.int32()), ("ring", pa.int32()), ("x", pa.float64()), ("y", pa.float64())]))
    schema = StructType([*(df.schema[c] for c in wanted)]).add("points", StructType.fromDDL(f"p {POINTS}")[0].dataType)
    return df.select(*wanted, "geometry").mapInArrow(decode, schema)
