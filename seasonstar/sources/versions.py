"""Sets of Parquet tables that are replaced all or nothing.

A set is a folder. A builder writes its tables into a new version folder, which nobody reads, and
publishes the version by one small file that is named by the next number and only created if
there is none of that name. Readers take the version of the highest number. So a job that is
killed at any point leaves the tables as they were, several tables change in one step, readers
keep the files they have planned with, and of two builders that started from the same version
only the first one publishes.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLISHED = "_published"


class ConflictError(ValueError):
    """Another version was published after this one was begun."""


@dataclass(frozen=True)
class Version:
    """A version folder; ``number`` is that of its publication, or of the one it was begun after."""

    root: str
    name: str
    number: int
    made_from: dict[str, str] = field(default_factory=dict)
    #: Table → folder of a version → the partitions of that table that this version takes from there.
    parts: dict[str, dict[str, list[int]]] = field(default_factory=dict)

    def path(self, table: str) -> str:
        return os.path.join(self.root, self.name, table)


class VersionedTables:
    """The versions of one set of tables under ``root``, on storage that Spark's executors share.

    Publishing needs a file system whose rename fails if the target exists, as HDFS has it. On a
    local disk, where a rename replaces its target, what was written is read again afterwards.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root

    # --- reading ----------------------------------------------------------------

    def current(self) -> Version | None:
        """The version published last."""
        numbers = self._numbers()
        return self._published(max(numbers)) if numbers else None

    def history(self) -> list[Version]:
        """All publications that are still listed, the first one first."""
        return [self._published(number) for number in sorted(self._numbers())]

    def table(self, name: str) -> DataFrame:
        version = self.current()
        if version is None:
            raise LookupError(f"nothing has been published under {self.root}")
        return self.read(version, name)

    def read(self, version: Version, name: str) -> DataFrame:
        """A table of ``version``, with the partitions it shares with older versions."""
        parts = version.parts.get(name)
        if not parts:
            return self.spark.read.parquet(version.path(name))
        column = self.partition_column(version, name)
        taken = [
            self.spark.read.parquet(os.path.join(self.root, folder, name)).where(
                F.col(column).isin(values)
            )
            for folder, values in parts.items()
        ]
        return reduce(DataFrame.unionByName, taken)

    def holds(self, version: Version, name: str) -> bool:
        return name in version.parts or self._files().exists(self._path(version.name, name))

    def partition_column(self, version: Version, name: str) -> str:
        folder = next(iter(version.parts.get(name, {})), version.name)
        return self._partitions(os.path.join(folder, name))[0][0]

    def partitions(self, version: Version, name: str) -> dict[str, list[int]]:
        """Where the partitions of a table, numbered by one column, are: folder → values."""
        if name in version.parts:
            return version.parts[name]
        found = [int(value) for _, value in self._partitions(os.path.join(version.name, name))]
        return {version.name: sorted(found)} if found else {}

    # --- writing ----------------------------------------------------------------

    def begin(self, **made_from: str) -> Version:
        """A new version to write tables into; ``made_from`` is kept with its publication."""
        numbers = self._numbers()
        return Version(self.root, f"v-{uuid.uuid4().hex}", max(numbers, default=0), made_from)

    def publish(self, version: Version) -> Version:
        """Make ``version`` the current one, unless another was published since it was begun."""
        number = version.number + 1
        text = json.dumps(
            {"version": version.name, "made_from": version.made_from, "parts": version.parts}
        )
        target = self._file(number)
        draft = self._path(PUBLISHED, f".{version.name}")
        stream = self._files().create(draft, True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        try:
            self._rename(draft, target)
        except Py4JJavaError as error:
            self._files().delete(draft, False)
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            raise self._lost(version) from None
        done = self._published(number)
        if done.name != version.name:
            raise self._lost(version)
        return done

    def _lost(self, version: Version) -> ConflictError:
        return ConflictError(f"{self.root}: version {version.number + 1} was published by another job")

    def expire(self, keep: int = 2, unfinished_hours: float = 24.0) -> list[str]:
        """Remove all but the last ``keep`` published versions, and folders that were never published
        and have not changed for so long; the names of those removed. Running readers of a removed
        version fail, so keep as many as are built while the longest query runs. A folder that a
        kept version shares partitions with stays; once none does, it counts as never published."""
        if keep < 1:
            raise ValueError("the current version has to be kept")
        files, history = self._files(), self.history()
        kept = {version.name for version in history[-keep:]}
        for version in history[-keep:]:
            kept.update(folder for parts in version.parts.values() for folder in parts)
        published = {version.name for version in history}
        for version in history[:-keep]:
            files.delete(self._file(version.number), False)
        removed = []
        latest = (time.time() - unfinished_hours * 3600) * 1000
        for status in self._listed(""):
            name = status.getPath().getName()
            if not name.startswith("v-") or name in kept:
                continue
            if name in published or self._changed(status) <= latest:
                files.delete(status.getPath(), True)
                removed.append(name)
        return removed

    # --- files ------------------------------------------------------------------

    def _jvm(self):
        return self.spark._jvm.org.apache.hadoop.fs

    def _path(self, *parts: str):
        return self._jvm().Path(os.path.join(self.root, *parts))

    def _file(self, number: int):
        return self._path(PUBLISHED, f"{number:010d}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list:
        path = self._path(folder)
        return list(self._files().listStatus(path)) if self._files().exists(path) else []

    def _partitions(self, folder: str) -> list[list[str]]:
        names = [status.getPath().getName() for status in self._listed(folder)]
        return [name.split("=", 1) for name in names if "=" in name]

    def _numbers(self) -> list[int]:
        names = [status.getPath().getName() for status in self._listed(PUBLISHED)]
        return [int(name) for name in names if name.isdigit()]

    def _changed(self, status) -> float:
        """The last change of a version folder or of a table folder in it."""
        inside = self._files().listStatus(status.getPath())
        return max([status.getModificationTime(), *(s.getModificationTime() for s in inside)])

    def _published(self, number: int) -> Version:
        stream = self._files().open(self._file(number))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        read = json.loads(text)
        # publications of earlier releases share nothing
        return Version(self.root, read["version"], number, read["made_from"], read.get("parts", {}))

    def _rename(self, draft, target) -> None:
        """Rename, but fail if ``target`` exists."""
        kind = getattr(self._jvm(), "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(kind, 0)
        context = self._jvm().FileContext.getFileContext(
            draft.toUri() if draft.toUri().getScheme() else self._files().getUri(),
            self.spark._jsc.hadoopConfiguration(),
        )
        context.rename(draft, target, none)
