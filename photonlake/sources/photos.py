"""Photos in a directory tree as a DataFrame: a Python data source that finds what Spark's file readers hide.

Every regular file counts, also those whose names begin with a dot or an underscore; links are not followed;
what can't be read is skipped. The driver opens a bounded number of directories; tasks walk what is below these, and
list and stat files.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import DISCOVERED
from ..settings import EXTENSIONS

#: Directories that one task lists; those that the driver looks for, and opens on the way, at most.
PER_TASK, FRONTIER, OPENED = 64, 512, 4096


class Directories(InputPartition):
    """Directories to list; ``deep``: with all that is below them."""

    def __init__(self, paths: list[str], deep: bool):
        self.paths, self.deep = paths, deep


def _below(directory: str) -> list[str]:
    try:
        return sorted(e.path for e in os.scandir(directory) if e.is_dir(follow_symlinks=False))
    except OSError:
        return []


class PhotoReader(DataSourceReader):
    def __init__(self, root: str, photos_only: bool):
        self.root, self.photos_only = root, photos_only

    def partitions(self) -> list[Directories]:
        opened, ahead = [], deque([self.root])
        while ahead and len(ahead) < FRONTIER and len(opened) < OPENED:
            opened.append(ahead.popleft())
            ahead.extend(_below(opened[-1]))
        flat = [Directories(opened[i : i + PER_TASK], False) for i in range(0, len(opened), PER_TASK)]
        return flat + [Directories([d], True) for d in ahead]

    def read(self, partition: Directories) -> Iterator[tuple]:
        paths = partition.paths if not partition.deep else (d for top in partition.paths for d, _, _ in os.walk(top, followlinks=False))
        for directory in paths:
            try:
                entries = sorted(os.scandir(directory), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                try:
                    if not e.is_file(follow_symlinks=False):
                        continue
                    if self.photos_only and os.path.splitext(e.name)[1][1:].lower() not in EXTENSIONS and e.name.rpartition(".")[2].lower() not in EXTENSIONS:
                        continue
                    stat = e.stat(follow_symlinks=False)
                except OSError:
                    continue
                yield e.path, stat.st_size, max(0, int(stat.st_mtime))


class PhotoSource(DataSource):
    """``spark.read.format("photos").load(root)``; option ``photos_only`` (default true) tests extensions in the walk."""

    @classmethod
    def name(cls) -> str:
        return "photos"

    def schema(self) -> str:
        return DISCOVERED

    def reader(self, schema) -> PhotoReader:
        return PhotoReader(self.options["path"], self.options.get("photos_only", "true").lower() == "true")


def discover(spark: SparkSession, root: str, photos_only: bool = True) -> DataFrame:
    """(path, file_size, modified_at) of the photos below a directory."""
    if not os.path.isdir(root):
        raise ValueError("Invalid directory path")
    spark.dataSource.register(PhotoSource)
    return spark.read.format("photos").option("photos_only", str(photos_only).lower()).load(root)
