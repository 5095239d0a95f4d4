"""Where iterative operators cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_checkpoints(spark: SparkSession) -> None:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only on a single machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from there."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """A folder of tables in the shared folder, for loops whose frames join themselves over and over.

    A checkpoint hands its plan's estimate of size on, and estimates of joins multiply; a table that was read has the size it has.
    """

    def __init__(self, spark: SparkSession):
        use_checkpoints(spark)
        self.spark, self.folder, self.n = spark, f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4()}", 0

    def keep(self, df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
        """df, written and read again; the table that it takes the place of is deleted."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        if instead_of is not None:
            self._delete(instead_of.scratch)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads again."""
        for df in frames:
            self._delete(df.scratch)

    def close(self) -> None:
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
