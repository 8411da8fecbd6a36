"""Polygon sources: rows with parts, GeoPackage layers, boxes; and the text, JSON and table sinks."""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

RING = "array<struct<x:double,y:double>>"


def box_ring(xmin: float, ymin: float, xmax: float, ymax: float) -> list[tuple[float, float]]:
    """A closed ring of five points."""
    return [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]


def boxes(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(patch_id, quality, xmin, ymin, xmax, ymax) in memory."""
    return spark.createDataFrame(rows, "patch_id int, quality double, xmin double, ymin double, xmax double, ymax double")


def wkb_polygons(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """Polygons (rings of points) of a WKB polygon or multipolygon."""

    def read(at: int) -> tuple[list, int]:
        order = "<" if data[at] else ">"
        kind = struct.unpack_from(f"{order}I", data, at + 1)[0] % 1000
        n = struct.unpack_from(f"{order}I", data, at + 5)[0]
        at += 9
        if kind == 6:
            out = []
            for _ in range(n):
                part, at = read(at)
                out += part
            return out, at
        if kind != 3:
            raise ValueError(f"not a polygon: kind {kind}")
        rings = []
        for _ in range(n):
            m = struct.unpack_from(f"{order}I", data, at)[0]
            v = struct.unpack_from(f"{order}{2 * m}d", data, at + 4)
            rings.append(list(zip(v[::2], v[1::2], strict=True)))
            at += 4 + 16 * m
        return [rings], at

    return read(0)[0] if data else []


def to_wkb(polygons: list[list[list[tuple[float, float]]]]) -> bytes:
    """WKB of one polygon, or of a multipolygon."""
    one = lambda rings: struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)
    return one(polygons[0]) if len(polygons) == 1 else struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(one, polygons))


class GeoPackageReader(DataSourceReader):
    def __init__(self, path: str, layer: str | None) -> None:
        self.path, self.layer = path, layer

    def read(self, partition) -> Iterator[tuple]:  # noqa: ANN001, ARG002
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            layer = self.layer or db.execute("select table_name from gpkg_contents where data_type = 'features' order by 1").fetchone()[0]
            geom = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()[0]
            cur = db.execute(f'select * from "{layer}"')
            names = [d[0] for d in cur.description]
            for row in cur:
                values = dict(zip(names, row, strict=True))
                blob = values.pop(geom)
                skip = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7] if blob else 0
                yield (blob[skip:] if blob else None), {k: str(v) for k, v in values.items() if v is not None}


class GeoPackage(DataSource):
    """spark.read.format("geopackage").option("layer", ...).load(path): (geom WKB, attributes). "path|layername=x" works too."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        return "geom binary, attributes map<string,string>"

    def reader(self, schema) -> GeoPackageReader:  # noqa: ANN001, ARG002
        path, _, layer = self.options["path"].partition("|layername=")
        return GeoPackageReader(path, layer or self.options.get("layer"))


def write_geopackage(path: str, layer: str, rows: list[tuple[bytes, int]]) -> None:
    """A layer (geom, value) of a bounded number of polygons, for exchange."""
    with sqlite3.connect(path) as db:
        db.executescript(f"""create table gpkg_contents (table_name text, data_type text); create table gpkg_geometry_columns (table_name text, column_name text);
            create table "{layer}" (fid integer primary key, geom blob, value integer); insert into gpkg_contents values ('{layer}', 'features'); insert into gpkg_geometry_columns values ('{layer}', 'geom')""")
        db.executemany(f'insert into "{layer}" (geom, value) values (?, ?)', [(b"GP\x00\x01\x00\x00\x00\x00" + g, v) for g, v in rows])


def split_parts(features: DataFrame) -> DataFrame:
    """One row for each part of (.., parts); empty parts go, attributes are copied."""
    return features.withColumn("part", F.explode("parts")).where(F.size("part") > 0).drop("parts")


def multipart_summary(features: DataFrame, key: str) -> DataFrame:
    """One row: features with several parts, their parts, the most of one, and three examples."""
    many = features.where(F.size("parts") > 1)
    return many.agg(F.count(F.lit(1)).alias("features"), F.coalesce(F.sum(F.size("parts")), F.lit(0)).alias("parts"), F.coalesce(F.max(F.size("parts")), F.lit(0)).alias("most"), F.slice(F.sort_array(F.collect_set(key)), 1, 3).alias("examples"))


def ring_area(ring: str = "ring") -> Column:
    """Area of a closed ring, by the shoelace rule."""
    r = F.col(ring)
    cross = F.transform(F.slice(r, 1, F.size(r) - 1), lambda p, i: p["x"] * F.get(r, i + 1)["y"] - F.get(r, i + 1)["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def numeric_fields(df: DataFrame) -> list[str]:
    """Fields that can weigh quality."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]


def catalogue(spark: SparkSession) -> list[str]:
    """Temporary views and tables."""
    return sorted(t.name for t in spark.catalog.listTables())


def register(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def unregister(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def write_text(report: DataFrame, path: str) -> None:
    """The lines of a report (line) in the order of `n`."""
    report.orderBy("n").select("line").coalesce(1).write.mode("overwrite").text(path)


def dump_json(stats: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(stats, f, indent=2, sort_keys=True)
