"""Files that are complete, as a stream: each comes once, when it has stopped changing, within one checkpointed query."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from parley.sources.files import filesystem
from parley.sources.tables import AUDIO_SUFFIXES

#: Files in one task.
CHUNK = 1_000


class _Chunk(InputPartition):
    def __init__(self, files: list[list]):
        self.files = files


class _Reader(DataSourceStreamReader):
    """An offset is the number of a list. Lists are written before their number is handed to the query, once and for good, under the state folder: which files a
    run hands on, and which still wait (young, empty or growing). A query that restarts reads the lists of the runs that it repeats, so it gets the same files; a
    file that waited, however long, is in a later list. What was handed on is the union of the lists, so files may come with any time of change."""

    def __init__(self, options: dict):
        self.path, self.state = options["path"], options["state"].rstrip("/")
        self.stable = float(options.get("stableseconds", options.get("stableSeconds", 0)))
        self.suffixes = tuple(x.strip().lower() for x in options.get("suffixes", ",".join(AUDIO_SUFFIXES)).split(","))
        self.handed: set[str] = set()
        self.last = 0
        self.sizes: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"run": 0}

    def _list(self, run: int) -> dict:
        fs, at = filesystem(self.state)
        with fs.open_input_file(f"{at}/{run}.json") as f:
            return json.loads(f.read())

    def _catch_up(self) -> None:
        from pyarrow import fs as pafs

        fs, at = filesystem(self.state)
        while fs.get_file_info(f"{at}/{self.last + 1}.json").type == pafs.FileType.File:
            self.last += 1
            self.handed.update(x[0] for x in self._list(self.last)["files"])

    def latestOffset(self) -> dict:
        from pyarrow import fs as pafs

        self._catch_up()
        fs, at = filesystem(self.path)
        now, ripe, waiting = time.time(), [], []
        for f in fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True)):
            if not f.is_file or f.path in self.handed or not f.path.lower().endswith(tuple("." + s for s in self.suffixes)):
                continue
            grew, self.sizes[f.path] = self.sizes.get(f.path, f.size) != f.size, f.size
            done = f.size > 0 and not grew and now - f.mtime.timestamp() >= self.stable
            (ripe if done else waiting).append([f.path, f.mtime.timestamp(), f.size])
        if ripe:
            fs, at = filesystem(self.state)
            fs.create_dir(at, recursive=True)
            name = f"{at}/{self.last + 1}.json"
            young = f"{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(young) as f:
                f.write(json.dumps({"files": sorted(ripe), "waiting": sorted(waiting)}).encode())
            fs.move(young, name)  # a list comes into being whole
            self._catch_up()
        return {"run": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = [x for run in range(start["run"] + 1, end["run"] + 1) for x in self._list(run)["files"]]
        return [_Chunk(files[i : i + CHUNK]) for i in range(0, len(files), CHUNK)]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        for path, changed, size in partition.files:
            yield path, datetime.fromtimestamp(changed, timezone.utc), int(size)

    def commit(self, end: dict) -> None:
        """Nothing: what was handed on is in the lists."""


class CompleteFiles(DataSource):
    """A streaming source of complete files: path string, modificationTime timestamp, length long. Options: path, state (a shared folder), stableSeconds, suffixes."""

    @classmethod
    def name(cls) -> str:
        return "complete_files"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def complete_audio_stream(spark: SparkSession, folder: str, state: str, stable_s: float = 0) -> DataFrame:
    """A stream of a folder's audio files, each once, when it holds something and has not changed for stable_s: what is young or empty now comes in a later batch
    of the same query. The driver holds the folder's names, as for any source of files."""
    spark.dataSource.register(CompleteFiles)
    return spark.readStream.format("complete_files").option("path", folder).option("state", state).option("stableSeconds", str(stable_s)).load()
