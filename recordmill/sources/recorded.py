"""Recorded pages of paged services as a Spark data source, in batch and as a stream.

A recording is a folder feed=<name>/page=<cursor>/ with one text file in it, a line of JSON:
{"rows": [...], "next": <cursor of the next page, or null>}.  Two modes:

* numbered: pages are 1, 2, 3 ... up to the first one missing; ranges of them are read by tasks of their own.
* cursor: the name of the next page is known only from the page before, so a feed is one task that follows the
  cursors until there is none, one comes again, one has no page (yet), or most_pages are read.

As a stream the offset holds, for each feed, the pages done and the next cursor; what was read before is
not read again, and a page recorded later comes with the next batch.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..storage import shared_folder

FIRST = "1"
#: Pages of a feed that cursors are followed for, unless most_pages says otherwise (a stream's offset names them all).
CURSOR_PAGES = 200
FIELDS = "feed string, page long, cursor string, row string"


class Range(InputPartition):
    """`count` pages of a feed from a cursor on, the first of them being the `number`-th."""

    def __init__(self, feed: str, cursor: str, number: int, count: int) -> None:
        super().__init__((feed, cursor, number, count))
        self.feed, self.cursor, self.number, self.count = feed, cursor, number, count


class Recording:
    """Access to the pages of a folder."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.numbered = options.get("mode", "numbered") == "numbered"
        self.first = options.get("first", FIRST)
        self.most = int(options.get("most_pages", 1 << 40 if self.numbered else CURSOR_PAGES))
        self.at_once = int(options.get("pages_per_task", 50))

    def system(self) -> tuple[fs.FileSystem, str]:
        parts = urlsplit(self.path)
        return (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(self.path)

    def names(self, kind: str, *below: str) -> list[str]:
        system, root = self.system()
        found = system.get_file_info(fs.FileSelector(posixpath.join(root, *below), allow_not_found=True))
        return sorted(x.base_name.removeprefix(f"{kind}=") for x in found if x.type == fs.FileType.Directory and x.base_name.startswith(f"{kind}="))

    def page(self, feed: str, cursor: str) -> dict | None:
        system, root = self.system()
        found = system.get_file_info(fs.FileSelector(posixpath.join(root, f"feed={feed}", f"page={cursor}"), allow_not_found=True))
        files = sorted(x.path for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")) and x.size)
        if not files:
            return None
        with system.open_input_stream(files[0]) as stream:
            return json.loads(stream.read())

    def last(self, feed: str, after: int = 0) -> int:
        """The number of the last page without a gap before it."""
        numbers = {int(x) for x in self.names("page", f"feed={feed}") if x.isdigit()}
        while after + 1 in numbers and after < self.most:
            after += 1
        return after

    def walk(self, feed: str, cursor: str | None, number: int, count: int, passed: set[str]) -> Iterator[tuple[int, str, dict]]:
        """(number, cursor, page) along the cursors; `passed` holds those that may not come again."""
        while cursor is not None and count > 0 and number <= self.most and cursor not in passed:
            page = self.page(feed, cursor)
            if page is None:
                return
            passed.add(cursor)
            yield number, cursor, page
            following = str(number + 1) if self.numbered else page.get("next")
            cursor, number, count = None if following is None else str(following), number + 1, count - 1

    def ranges(self, feed: str, done: int, last: int) -> list[Range]:
        starts = range(done + 1, last + 1, self.at_once)
        return [Range(feed, str(n), n, min(self.at_once, last + 1 - n)) for n in starts]

    def rows(self, part: Range | None) -> Iterator[tuple]:
        if part is None:  # Spark's way to ask a source without partitions
            return
        for number, cursor, page in self.walk(part.feed, part.cursor, part.number, part.count, set()):
            for row in page.get("rows") or []:
                yield part.feed, number, cursor, json.dumps(row, separators=(",", ":"), ensure_ascii=False)


class _Reader(DataSourceReader):
    def __init__(self, recording: Recording) -> None:
        self.recording = recording

    def partitions(self) -> list[Range]:
        r = self.recording
        if not r.numbered:
            return [Range(f, r.first, 1, r.most) for f in r.names("feed")]
        return [x for f in r.names("feed") for x in r.ranges(f, 0, r.last(f))]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        return self.recording.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """Offset: {feed: [pages done, next cursor, cursors done]}; the last only in cursor mode, where a repeat ends the feed."""

    def __init__(self, recording: Recording) -> None:
        self.recording = recording
        self.known: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Only the cursors of pages that came since are followed here; rows are read by the tasks."""
        r = self.recording
        for feed in r.names("feed"):
            done, cursor, passed = self.known.get(feed, [0, r.first, []])
            if r.numbered:
                self.known[feed] = [r.last(feed, done), None, []]
                continue
            seen = set(passed)
            for number, at, page in r.walk(feed, cursor, done + 1, r.most, seen):
                following = page.get("next")
                done, passed, cursor = number, [*passed, at], None if following is None else str(following)
            self.known[feed] = [done, cursor, passed]
        return {f: list(x) for f, x in self.known.items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        r, out = self.recording, []
        for feed, (last, _, passed) in end.items():
            done, cursor, _ = start.get(feed, [0, r.first, []])
            if r.numbered:
                out += r.ranges(feed, done, last)
            elif last > done:
                out += [Range(feed, passed[n], n + 1, min(r.at_once, last - n)) for n in range(done, last, r.at_once)]
        for feed, at in end.items():  # after a restart the offset of the log is where reading goes on
            if at[0] >= self.known.get(feed, [0])[0]:
                self.known[feed] = list(at)
        return out

    def read(self, partition: Range | None) -> Iterator[tuple]:
        return self.recording.rows(partition)


class RecordedPages(DataSource):
    """spark.read.format("recorded_pages").option("path", ...): feed, page (its number), cursor, row (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(Recording(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(Recording(self.options))


def record_pages(df: DataFrame, feed: str, page: str, order: list[str], path: str | None = None) -> str:
    """Writes a recording of df, one folder for each page of each feed, the rows of a page in order; gives its path.

    A page is one file, so its rows (not a feed's) are gathered.
    """
    at = path or f"{shared_folder(df.sparkSession)}/pages-{uuid.uuid4().hex}"
    rest = [c for c in df.columns if c not in (feed, page)]
    pages = df.groupBy(feed, page).agg(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("__o"), F.struct(*rest).alias("row")))).alias("__rows"))
    line = F.to_json(F.struct(F.transform("__rows", lambda r: r["row"]).alias("rows"), (F.col(page) + 1).cast("string").alias("next")))
    pages.select(F.col(feed).alias("feed"), F.col(page).alias("page"), line.alias("value")).write.partitionBy("feed", "page").text(at)
    return at


def read_pages(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    spark.dataSource.register(RecordedPages)
    return spark.read.format("recorded_pages").option("path", path).options(**{k: str(v) for k, v in options.items()}).load()


def stream_pages(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    spark.dataSource.register(RecordedPages)
    return spark.readStream.format("recorded_pages").option("path", path).options(**{k: str(v) for k, v in options.items()}).load()
