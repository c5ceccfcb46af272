"""State of runs in versions: rows are written first, and one commit record publishes them.

A state is a folder.  rows/ has the rows of each publication; commits/ has one small
record of each, created once and never changed, with its version, its run, where its
rows are and which lists they are of.  Readers go by the records alone: what a broken
run has written without a record does not exist for them, and each list is read in its
newest version.  Publishing again under the same run and name changes nothing, so that a
run that is started again, or a streaming batch that is replayed, does no harm.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import delete
from ..types import join_keys
from . import state as ST


class VersionedState:
    """The rows of each list (`by`: the columns, texts or whole numbers, that name a list) as the last complete run left them."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, by: list[str]) -> None:
        self.spark, self.folder, self.schema, self.by = spark, folder.rstrip("/"), schema, by
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """The commit records, oldest version first."""
        at = self._path(f"{self.folder}/commits")
        if not self._fs.exists(at):
            return []
        found = self.spark.read.text(f"{self.folder}/commits", wholetext=True).collect() if self._fs.listStatus(at) else []  # one short record of each publication
        return sorted((json.loads(r["value"]) for r in found if r["value"]), key=lambda c: (c["version"], c["run"], c["name"]))

    def publish(self, run: str, name: str, rows: DataFrame) -> bool:
        """Writes rows and then their record; False, with nothing written, if this run has published the name before."""
        done = self.commits()
        if any(c["run"] == run and c["name"] == name for c in done):
            return False
        path = f"{self.folder}/rows/{uuid.uuid4().hex}"
        rows.select(*[f.name for f in self._empty().schema]).write.parquet(path)
        lists = [r.asDict() for r in self.spark.read.parquet(path).select(*self.by).distinct().collect()]  # names of lists
        record = {"version": 1 + max((c["version"] for c in done), default=0), "run": run, "name": name, "path": path, "lists": lists}
        at = self._path(f"{self.folder}/commits/{hashlib.sha256(f'{run}/{name}'.encode()).hexdigest()[:32]}.json")
        draft = self._path(f"{path}/_record")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(record, default=str).encode()))
        out.close()
        self._fs.mkdirs(at.getParent())
        if not self._fs.rename(draft, at):  # another writer of the same run was first
            delete(self.spark, path)
            return False
        return True

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def current(self) -> DataFrame:
        """The rows of the newest version of every list."""
        newest: dict[str, tuple[dict, dict]] = {}
        for c in self.commits():
            for one in c["lists"]:
                newest[json.dumps(one, sort_keys=True, default=str)] = (c, one)
        by_path: dict[str, list[dict]] = {}
        for c, one in newest.values():
            by_path.setdefault(c["path"], []).append(one)
        out = self._empty()
        for path, lists in sorted(by_path.items()):
            names = self.spark.createDataFrame([tuple(one[b] for b in self.by) for one in lists], StructType([out.schema[b] for b in self.by]))
            out = out.unionByName(join_keys(self.spark.read.schema(out.schema).parquet(path), names, self.by, "left_semi"))
        return out

    def batches(self, name: str = "batch", run: str = "stream") -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each batch is published once, however often it is replayed."""
        return lambda rows, number: self.publish(f"{run}-{number}", name, rows) and None


def compare_lists(state: VersionedState, current: DataFrame, item: str, rank: str, visible: int, least: int = 1) -> DataFrame:
    """Rank changes of `current` against the state; all rows of a list without a committed version are its baseline."""
    previous = state.current()
    known = previous.select(*state.by).distinct()
    changes = ST.rank_changes(join_keys(current, known, state.by, "left_semi"), join_keys(previous, current.select(*state.by).distinct(), state.by, "left_semi"), state.by, item, rank, visible, least)
    baseline = join_keys(current, known, state.by, "left_anti").where(F.col(rank) <= visible)
    return changes.unionByName(baseline.select(*state.by, item, F.col(rank).alias("now"), F.lit(None).cast(current.schema[rank].dataType).alias("then"), F.lit("baseline").alias("change")))


def track_lists(state: VersionedState, run: str, lists: list[tuple[str, DataFrame]], emit: Callable[[str, DataFrame], None]) -> None:
    """A run over named lists: each is emitted whole, then committed; where the run breaks off, the lists after it keep their old version."""
    for name, rows in lists:
        emit(name, rows)
        state.publish(run, name, rows)
