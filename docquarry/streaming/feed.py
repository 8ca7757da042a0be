"""spark.readStream.format("docquarry_feed"): committed events, by sequence number.

The offset is the last sequence number examined, so events of collections out
of scope are passed over and still advance it.  Only what a manifest names is
read.  If retention has dropped events that the stream has not seen, the query
fails; it never skips them.

Options: path (the tenant's root), collections (comma-separated; all if unset),
startingSequence (0: from the first event that is kept; default).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..sources.store import FEED

BATCH_ROWS = 4096


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
    return fs, path.rstrip("/")


def _feed(root: str) -> dict:
    """The feed part of the newest manifest."""
    fs, path = _open(root)
    names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(f"{path}/manifests"))]
    newest = max(n for n in names if n.count(".") == 1 and n.endswith(".json"))
    with fs.open_input_stream(f"{path}/manifests/{newest}") as f:
        return json.loads(f.read())["feed"]


class Part(InputPartition):
    """One file of a segment; a bulk load has as many as it had tasks."""

    def __init__(self, path: str, after: int, until: int):
        self.path, self.after, self.until = path, after, until


def _parts(root: str, feed: dict, after: int, until: int) -> list[Part]:
    if after + 1 < feed["first"] and after > 0:
        raise RuntimeError(f"RETENTION_GAP: events from {after + 1} to {feed['first'] - 1} are no longer kept")
    fs, path = _open(root)
    wanted = [s["path"] for s in feed["segments"] if s["first"] <= until and s["first"] + s["count"] - 1 > after]
    files = [f for s in wanted for f in fs.get_file_info(pafs.FileSelector(f"{path}/{s}"))]
    return [Part(f.path, after, until) for f in files if f.base_name.endswith(".parquet")]


def _rows(root: str, collections: list[str], part: Part) -> Iterator[pa.RecordBatch]:
    fs, _ = _open(root)
    with fs.open_input_file(part.path) as f:
        for batch in pq.ParquetFile(f).iter_batches(BATCH_ROWS):
            keep = pc.and_(pc.greater(batch["sequence"], part.after), pc.less_equal(batch["sequence"], part.until))
            if collections:
                keep = pc.and_(keep, pc.is_in(batch["collection"], pa.array(collections)))
            yield batch.filter(keep)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        given = {k.lower(): v for k, v in options.items()}  # names of options have no case
        self.root = given["path"]
        self.collections = [c for c in given.get("collections", "").split(",") if c]
        self.start = int(given.get("startingsequence", 0))

    def initialOffset(self) -> dict:
        return {"sequence": max(self.start, _feed(self.root)["first"] - 1) if not self.start else self.start}

    def latestOffset(self) -> dict:
        return {"sequence": _feed(self.root)["next"] - 1}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return _parts(self.root, _feed(self.root), start["sequence"], end["sequence"])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _rows(self.root, self.collections, partition)

    def commit(self, end: dict) -> None:
        pass


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.stream = _Stream(options)

    def partitions(self) -> list[Part]:
        feed = _feed(self.stream.root)
        return _parts(self.stream.root, feed, self.stream.start, feed["next"] - 1) or [Part("", 0, -1)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _rows(self.stream.root, self.stream.collections, partition) if partition.path else iter(())


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docquarry_feed"

    def schema(self) -> str:
        return FEED

    def streamReader(self, schema) -> _Stream:
        return _Stream(dict(self.options))

    def reader(self, schema) -> _Batch:
        return _Batch(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)
