"""A directory tree as a batch source: `spark.read.format("shelfmark_walk").load(path)`.

Each folder at the top is one partition, listed on an executor; links are recorded but not followed, excluded names
are pruned on the way down, folders that can't be read are flagged. The result doesn't depend on the partitioning.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.names import EPOCH_FILETIME, fold_text

SCHEMA = "path string, parent string, name string, is_dir boolean, is_link boolean, size bigint, alloc_size bigint, modified_at bigint, file_ref bigint, listed boolean"


class Folder(InputPartition):
    def __init__(self, rel: str, deep: bool):
        self.rel, self.deep = rel, deep


class Walk(DataSource):
    """Options: `exclude` (names separated by |, any case)."""

    @classmethod
    def name(cls) -> str:
        return "shelfmark_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WalkReader(self.options["path"], {fold_text(x) for x in self.options.get("exclude", "").split("|") if x})


class WalkReader(DataSourceReader):
    def __init__(self, root: str, excluded: set[str]):
        self.root, self.excluded = root, excluded

    def partitions(self) -> list[Folder]:
        subs = sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and fold_text(e.name) not in self.excluded)
        return [Folder("", False), *[Folder(s, True) for s in subs]]

    def read(self, part: Folder) -> Iterator[tuple]:
        todo = [part.rel]
        while todo:
            rel = todo.pop()
            here = os.path.join(self.root, rel)
            try:
                items = sorted(os.scandir(here), key=lambda e: e.name)
            except OSError:
                items = None
            if rel and rel == part.rel:
                yield self._row(rel, os.lstat(here), items is not None)
            for e in items or []:
                is_dir = e.is_dir(follow_symlinks=False)
                sub = os.path.join(rel, e.name)
                if is_dir:
                    if fold_text(e.name) in self.excluded:
                        continue
                    if part.deep:
                        todo.append(sub)
                        yield self._row(sub, e.stat(follow_symlinks=False), os.access(e.path, os.R_OK))
                    continue  # folders at the top have partitions of their own
                yield self._row(sub, e.stat(follow_symlinks=False), True)

    def _row(self, rel: str, s: os.stat_result, listed: bool) -> tuple:
        is_dir = stat.S_ISDIR(s.st_mode)
        path = rel.replace(os.sep, "\\").encode("utf-8", "replace").decode()
        parent, _, name = path.rpartition("\\")
        return path, parent, name, is_dir, stat.S_ISLNK(s.st_mode), 0 if is_dir else s.st_size, 0 if is_dir else s.st_blocks * 512, s.st_mtime_ns // 100 + EPOCH_FILETIME, s.st_ino, listed
