"""Tables that are written between the steps of an operator or between runs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one of our own only on a single machine where none is named."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="records_")
        atexit.register(shutil.rmtree, at, True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Steps:
    """Tables of one loop: put() writes and reads again, so that neither lineage nor plan grows with the rounds."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path, schema = f"{self.folder}/{self.n}", df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def end(self) -> None:
        """Removes the tables."""
        delete(self.spark, self.folder)
