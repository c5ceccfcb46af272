"""Reading tables, cutting lineage and small shared column expressions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expressions of Java and Python for what the contracts call words.
SPACES = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and runs on one machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and (own := spark.sparkContext.getCheckpointDir()):
        at = own
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="llm_shared_")
        atexit.register(shutil.rmtree, at, True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Tables written since the innermost scratch() began.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are removed at the end, but for those that are to be kept."""
    outer = _written.get()
    token = _written.set([])
    try:
        yield
    finally:
        own = _written.get() or []
        _written.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in own:
            at = jvm.org.apache.hadoop.fs.Path(path.removeprefix("keep "))
            if not path.startswith("keep "):
                at.getFileSystem(conf).delete(at, True)
            elif outer is not None:
                outer.append(path.removeprefix("keep "))


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    It cuts the lineage in storage that outlives executors, and gives the planner
    the true size, so that a later join broadcasts it only below the session's
    threshold and is dealt out evenly by adaptive execution otherwise.  Inside
    scratch() a table is removed at its end unless `keep`: what the operator returns
    may read kept tables only; those belong to the folder's owner.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if (written := _written.get()) is not None:
        written.append(f"keep {path}" if keep else path)
    return spark.read.schema(schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z in small letters, every other character as it is."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))
