"""A data source that lists a mounted tree in tasks, hidden names included."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that the driver looks into at most, to deal out what lies below them.
SPREAD = 256


@dataclass
class Folder(InputPartition):
    """A folder with all that is below it, or with its own files only."""

    path: str
    below: bool

    def __init__(self, path: str, below: bool):
        super().__init__(path)
        self.path, self.below = path, below


class TreeReader(DataSourceReader):
    def __init__(self, root: str, suffixes: tuple[str, ...], spread: int):
        self.root, self.suffixes, self.spread = root, suffixes, spread

    def partitions(self) -> list[Folder]:
        """The root is opened folder by folder, breadth first, until there are enough; each opened one keeps its own files."""
        if not os.path.isdir(self.root):
            return [Folder(self.root, False)]
        opened, open_ = [], [self.root]
        while open_ and len(opened) < self.spread and len(opened) + len(open_) < self.spread:
            folder = open_.pop(0)
            opened.append(folder)
            open_ += sorted(e.path for e in _entries(folder) if e.is_dir(follow_symlinks=False))
        return [*(Folder(f, False) for f in opened), *(Folder(f, True) for f in open_)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        if not os.path.isdir(partition.path):
            yield from _row(partition.path, self.suffixes)
            return
        pending = [partition.path]
        while pending:
            for e in _entries(pending.pop()):
                if e.is_dir(follow_symlinks=False):
                    if partition.below:
                        pending.append(e.path)
                else:
                    yield from _row(e.path, self.suffixes)


def _entries(folder: str) -> Iterator[os.DirEntry]:
    """What a folder holds, read as it is asked for; a folder that can't be opened holds nothing."""
    try:
        with os.scandir(folder) as found:
            yield from found
    except OSError:
        return


def _row(path: str, suffixes: tuple[str, ...]) -> Iterator[tuple]:
    if path.lower().endswith(suffixes) and os.path.isfile(path):
        try:
            about = os.stat(path)
        except OSError:
            return
        yield path, about.st_size, datetime.fromtimestamp(about.st_mtime, timezone.utc)


class TreeSource(DataSource):
    """(path, size, modificationTime) of the files below a folder with one of the suffixes, or of one file.

    Options: path, suffixes (separated by commas, without dots), spread. Links to folders aren't followed.
    """

    @classmethod
    def name(cls) -> str:
        return "curata_tree"

    def schema(self) -> str:
        return "path string, size bigint, modificationTime timestamp"

    def reader(self, schema) -> TreeReader:
        suffixes = tuple(f".{s.strip().lower()}" for s in self.options.get("suffixes", "png").split(","))
        return TreeReader(self.options["path"], suffixes, int(self.options.get("spread", SPREAD)))


def list_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...], spread: int = SPREAD):
    """The files of a tree on a store that the driver and all executors have mounted."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("curata_tree").option("suffixes", ",".join(suffixes)).option("spread", spread).load(root)
