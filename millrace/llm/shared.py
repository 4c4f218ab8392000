"""Written tables in the shared folder: how the iterative operators cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

#: Spark's own setting: shuffle files of a query are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (local tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder, and executors share none of ours")
        named = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Parquet tables of one run below the shared folder.

    ``cut(df)`` writes df and returns it read back, so that a lost executor costs a re-read and
    not the whole lineage. ``keep(...)`` removes the tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/millrace-{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.count = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        self._written(df.write.option("compression", "zstd"), path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append(path)
        return back

    def _written(self, writer: DataFrameWriter, path: str) -> None:
        """Writes; the shuffle files of the write go at its end, as nothing reads them any more."""
        before = self.spark.conf.get(CLEANUP, None)
        try:
            self.spark.conf.set(CLEANUP, "true")
            writer.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)

    def add(self, name: str, df: DataFrame) -> None:
        """Appends to the table ``name``, which ``added`` reads and ``keep`` leaves alone."""
        self._written(df.write.mode("append").option("compression", "zstd"), f"{self.base}/{name}")

    def added(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}")

    def keep(self, *tables: DataFrame) -> None:
        """Removes all tables but these: those that a result, which is still to be run, reads."""
        kept = {path for df in tables for path in df.inputFiles()[:1]}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths[:]:
            if not any(f"{path.split(':', 1)[-1].lstrip('/')}/" in k for k in kept):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
                self.paths.remove(path)
