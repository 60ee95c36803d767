"""GeoPackage layers as a data source: a GeoPackage is an SQLite file with geometries as WKB behind a short header.

spark.dataSource.register(GeoPackage); spark.read.format("gpkg").option("layer", name).load(path)

Rows are read in ranges of row ids, one task each; the file must be in a folder that executors see, as SQLite needs
random access.  Geometries come as points (part, ring, x, y); parts of collections that aren't areas are dropped.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

POINT = StructType([StructField("part", IntegerType()), StructField("ring", IntegerType()), StructField("x", DoubleType()), StructField("y", DoubleType())])
# Sizes of the envelope by its code, and WKB codes of areal geometries.
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
POLYGON, MULTIPOLYGON, COLLECTION = 3, 6, 7


def parse_wkb(data: bytes) -> list[tuple[int, int, float, float]]:
    """Points of the polygons in a WKB geometry, without the point that closes a ring."""
    out: list[tuple[int, int, float, float]] = []
    parts = 0

    def geometry(at: int) -> int:
        nonlocal parts
        end = "<" if data[at] == 1 else ">"
        (kind,) = struct.unpack_from(end + "I", data, at + 1)
        at += 5
        if kind & 0x20000000:  # an id of the coordinate system
            at += 4
        flat, dims = (kind & 0xFFFF) % 1000, 2 + (1 if kind & 0x80000000 or (kind & 0xFFFF) // 1000 in (1, 3) else 0) + (1 if kind & 0x40000000 or (kind & 0xFFFF) // 1000 in (2, 3) else 0)
        if flat == 1:
            return at + 8 * dims
        (n,) = struct.unpack_from(end + "I", data, at)
        at += 4
        if flat == 2:
            return at + 8 * dims * n
        if flat in (4, 5, MULTIPOLYGON, COLLECTION):
            for _ in range(n):
                at = geometry(at)
            return at
        if flat != POLYGON:
            raise ValueError(f"WKB kind {kind} is not supported")
        for ring in range(n):
            (m,) = struct.unpack_from(end + "I", data, at)
            xs = struct.unpack_from(f"{end}{m * dims}d", data, at + 4)
            at += 4 + 8 * m * dims
            points = [(xs[i], xs[i + 1]) for i in range(0, m * dims, dims)]
            if len(points) > 1 and points[0] == points[-1]:
                points.pop()
            out.extend((parts, ring, x, y) for x, y in points)
        parts += 1
        return at

    if data:
        geometry(0)
    return out


def to_wkb(points: list) -> bytes:
    """A multipolygon of points (part, ring, x, y)."""
    rings: dict[int, dict[int, list]] = {}
    for p in points:
        rings.setdefault(p[0], {}).setdefault(p[1], []).append((p[2], p[3]))
    out = struct.pack("<BII", 1, MULTIPOLYGON, len(rings))
    for part in sorted(rings):
        out += struct.pack("<BII", 1, POLYGON, len(rings[part]))
        for ring in sorted(rings[part]):
            closed = [*rings[part][ring], rings[part][ring][0]]
            out += struct.pack("<I", len(closed)) + b"".join(struct.pack("<dd", *xy) for xy in closed)
    return out


def parse_blob(blob: bytes | None) -> list[tuple[int, int, float, float]]:
    if not blob or blob[:2] != b"GP" or blob[3] & 0x10:
        return []
    return parse_wkb(bytes(blob[8 + ENVELOPES[blob[3] >> 1 & 7] :]))


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://').removeprefix('file:')}?mode=ro", uri=True)


def layers(path: str) -> list[str]:
    with _open(path) as c:
        return [r[0] for r in c.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name")]


class Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class GeoPackage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def _layer(self) -> tuple[str, str]:
        with _open(self.options["path"]) as c:
            found = dict(c.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall())
        layer = self.options.get("layer") or (next(iter(sorted(found))) if len(found) == 1 else None)
        if layer not in found:
            raise ValueError(f"choose one layer of {sorted(found)}")
        return layer, found[layer]

    def schema(self) -> StructType:
        layer, geometry = self._layer()
        with _open(self.options["path"]) as c:
            columns = c.execute(f'PRAGMA table_info("{layer}")').fetchall()
        kind = lambda t: LongType() if "INT" in t.upper() else DoubleType() if t.upper() in ("REAL", "DOUBLE", "FLOAT") else StringType()
        return StructType([StructField("ordinal", LongType()), *(StructField(r[1], kind(r[2])) for r in columns if r[1] != geometry), StructField("points", ArrayType(POINT))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return GeoPackageReader(self.options["path"], *self._layer(), schema, int(self.options.get("rows", 5000)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return GeoPackageWriter(self.options["path"], self.options.get("layer", "layer"), schema)


class GeoPackageReader(DataSourceReader):
    def __init__(self, path: str, layer: str, geometry: str, schema: StructType, rows: int) -> None:
        self.path, self.layer, self.geometry, self.rows = path, layer, geometry, rows
        self.columns = [f.name for f in schema if f.name not in ("ordinal", "points")]

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.layer}"').fetchone()
        return [Range(k, k + self.rows) for k in range(low, high + 1, self.rows)] if low is not None else [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        names = "".join(f', "{c}"' for c in self.columns)
        with _open(self.path) as c:
            for row in c.execute(f'SELECT rowid, "{self.geometry}"{names} FROM "{self.layer}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (partition.low, partition.high)):
                yield (row[0], *row[2:], parse_blob(row[1]))


class Written(WriterCommitMessage):
    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows


class GeoPackageWriter(DataSourceWriter):
    """Adds one layer to a file; for maps, whose rows fit on the driver.  Rows without points get the point (0, 0)."""

    MOST = 200_000

    def __init__(self, path: str, layer: str, schema: StructType) -> None:
        self.path, self.layer = path.removeprefix("file://"), layer
        self.names = [f.name for f in schema]
        self.kinds = ["INTEGER" if isinstance(f.dataType, (LongType, IntegerType)) else "REAL" if isinstance(f.dataType, DoubleType) else "TEXT" for f in schema]

    def write(self, iterator: Iterator) -> Written:
        rows = []
        for row in iterator:
            if len(rows) >= self.MOST:
                raise ValueError(f"more than {self.MOST} rows for one map layer; write Parquet instead")
            rows.append(tuple(row))
        return Written(rows)

    def commit(self, messages: list) -> None:
        header = b"GP\x00\x01" + struct.pack("<i", 4326)
        place = self.names.index("points") if "points" in self.names else None
        columns = [(n, k) for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if i != place]
        with sqlite3.connect(self.path) as c:
            c.execute("PRAGMA application_id = 1196444487")
            c.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER)")
            c.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
            c.execute(f'CREATE TABLE "{self.layer}" (fid INTEGER PRIMARY KEY, geom BLOB{"".join(f", \"{n}\" {k}" for n, k in columns)})')
            c.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, 4326)", (self.layer, self.layer))
            c.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', 4326, 0, 0)", (self.layer,))
            marks = ", ".join("?" * (2 + len(columns)))
            for message in messages:
                for row in message.rows:
                    points = [tuple(p) for p in row[place] or []] if place is not None else []
                    shape = to_wkb(points) if points else struct.pack("<BIdd", 1, 1, 0.0, 0.0)
                    c.execute(f'INSERT INTO "{self.layer}" VALUES ({marks})', (None, header + shape, *(v for i, v in enumerate(row) if i != place)))
