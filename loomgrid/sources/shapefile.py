"""A Spark data source for ESRI shapefiles: ``spark.read.format("shapefile").load(path)``.

Rows have the attributes of the ``.dbf`` as text and a geometry as ``kind, x, y, rings``. One file is one
partition; a folder of files is read in parallel. Paths must be readable by the executors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SHAPE = "kind string, x double, y double, rings array<array<struct<x:double,y:double>>>"
KINDS = {1: "point", 11: "point", 21: "point", 3: "line", 13: "line", 23: "line", 5: "polygon", 15: "polygon", 25: "polygon", 8: "multipoint", 18: "multipoint", 28: "multipoint"}


def dbf_fields(data: bytes) -> list[tuple[str, int]]:
    """Names and widths of a dBase table."""
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    return fields


def dbf_rows(data: bytes, encoding: str = "utf-8") -> Iterator[list[str | None]]:
    count, head, width = struct.unpack("<IHH", data[4:12])
    fields = dbf_fields(data)
    for i in range(count):
        record, at, row = data[head + i * width : head + (i + 1) * width], 1, []
        for _, size in fields:
            row.append(record[at : at + size].decode(encoding, "replace").strip() or None)
            at += size
        yield row


def shapes(data: bytes) -> Iterator[tuple]:
    """``kind, x, y, rings`` of each record; a null shape is all null."""
    at = 100
    while at + 8 <= len(data):
        size = 2 * struct.unpack(">i", data[at + 4 : at + 8])[0]
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        code = struct.unpack("<i", body[:4])[0]
        kind = KINDS.get(code)
        if kind == "point":
            x, y = struct.unpack("<2d", body[4:20])
            yield kind, x, y, None
        elif kind == "multipoint":
            n = struct.unpack("<i", body[36:40])[0]
            points = [{"x": p[0], "y": p[1]} for p in struct.iter_unpack("<2d", body[40 : 40 + 16 * n])]
            yield kind, points[0]["x"], points[0]["y"], [points]
        elif kind:
            parts, n = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), n]
            points = [{"x": p[0], "y": p[1]} for p in struct.iter_unpack("<2d", body[44 + 4 * parts : 44 + 4 * parts + 16 * n])]
            rings = [points[a:b] for a, b in zip(starts, starts[1:])]
            yield kind, sum(p["x"] for p in points) / n, sum(p["y"] for p in points) / n, rings
        else:
            yield None, None, None, None


def _files(path: str) -> list[str]:
    p = Path(path.removeprefix("file://"))
    return sorted(map(str, p.glob("**/*.shp"))) if p.is_dir() else [str(p)]


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str):
        self.files = _files(path)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        base = Path(partition.value)
        attributes = dbf_rows(base.with_suffix(".dbf").read_bytes())
        for row, shape in zip(attributes, shapes(base.read_bytes())):
            yield (*row, *(shape[:3]), None if shape[3] is None else [[(p["x"], p["y"]) for p in ring] for ring in shape[3]])


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        files = _files(self.options["path"])
        if not files or not Path(files[0]).exists():
            raise FileNotFoundError(self.options["path"])
        names = [n for n, _ in dbf_fields(Path(files[0]).with_suffix(".dbf").read_bytes())]
        return ", ".join([*[f"`{n}` string" for n in names], SHAPE])

    def reader(self, schema) -> DataSourceReader:
        return ShapefileReader(self.options["path"])


def read_shapefile(spark: SparkSession, path: str, required: bool = False) -> DataFrame | None:
    """A shapefile layer; one that is missing is None, or FileNotFoundError if it is ``required``."""
    if not _files(path) or not Path(_files(path)[0]).exists():
        if required:
            raise FileNotFoundError(path)
        return None
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("shapefile").load(path)
