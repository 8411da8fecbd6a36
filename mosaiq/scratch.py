"""Cut points of long plans: Parquet tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset in local mode (as in tests), a folder of our own.

    On a cluster an unset folder is an error: executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = tempfile.mkdtemp(prefix="mosaiq-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop(spark: SparkSession, path: str | None) -> None:
    """Delete a cut table; None is ignored."""
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Writes frames to the shared folder and reads them again, which ends their lineage.

    A table lives until `drop` is called for its name or a new one of that name is written.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}
        self.n = 0

    def cut(self, df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
        """row_group: bytes that a writer holds, and a reader's task takes at once; Parquet's own size if None."""
        self.n += 1
        path, old = f"{self.root}/{name}-{self.n}", self.paths.get(name)
        was = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # what the write has shuffled is deleted at its end
        try:
            df.write.options(**{"parquet.block.size": row_group} if row_group else {}).parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if was is None else self.spark.conf.set(CLEANUP, was)
        self.paths[name] = path
        drop(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            drop(self.spark, self.paths.pop(name, None))
