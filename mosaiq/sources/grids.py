"""Grid sources: ESRI ASCII grids through a Python data source with one partition for each band of rows, and dense arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CELLS = "row int, col int, value float"


def band_rows(rows: int) -> int:
    """Rows of one band."""
    return max(1, min(1024, rows // 50 or 1))


def header(path: str) -> tuple[dict[str, float], int]:
    """Values and lines of an ASCII grid's header."""
    out: dict[str, float] = {}
    with open(path) as f:
        for n, line in enumerate(f):
            key, _, value = line.strip().partition(" ")
            if not key.isalpha() and not key.lower().startswith("nodata"):
                return out, n
            out[key.lower()] = float(value)
    return out, len(out)


class Band(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class GridReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Band]:
        rows = int(header(self.path)[0]["nrows"])
        n = band_rows(rows)
        return [Band(i, min(rows, i + n)) for i in range(0, rows, n)]

    def read(self, partition: Band) -> Iterator[tuple]:
        meta, skip = header(self.path)
        nodata = meta.get("nodata_value")
        with open(self.path) as f:
            for n, line in enumerate(f):
                if n < skip + partition.first:
                    continue
                if n >= skip + partition.last:
                    return
                for c, v in enumerate(np.array(line.split(), np.float32)):
                    if nodata is None or abs(float(v) - nodata) >= 1e-6:
                        yield n - skip, c, float(v)


class AsciiGrid(DataSource):
    """spark.read.format("ascii_grid").load(path), after spark.dataSource.register(AsciiGrid). The path must be readable on all executors."""

    @classmethod
    def name(cls) -> str:
        return "ascii_grid"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> GridReader:  # noqa: ANN001, ARG002
        return GridReader(self.options["path"])


def from_array(spark: SparkSession, values: np.ndarray, nodata: float | None = None) -> DataFrame:
    """Cells of a dense array; nodata and NaN are left out."""
    keep = ~np.isnan(values.astype(float)) & (True if nodata is None else np.abs(values - nodata) >= 1e-6)
    r, c = np.nonzero(keep)
    return spark.createDataFrame([(int(i), int(j), float(values[i, j])) for i, j in zip(r, c, strict=True)], CELLS)


def grid_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row of an ASCII grid's origin, cell size, extent and nodata."""
    m, _ = header(path)
    size = m.get("cellsize", 1.0)
    return spark.createDataFrame([(m.get("xllcorner", 0.0), size, 0.0, m.get("yllcorner", 0.0) + size * m["nrows"], 0.0, -size, m.get("nodata_value"), int(m["nrows"]), int(m["ncols"]))], "origin_x double, px_w double, rot_x double, origin_y double, rot_y double, px_h double, nodata double, rows int, cols int")


def write_cells(cells: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
