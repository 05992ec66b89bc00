"""Tables that change together, or not at all.

``publish`` writes every table of a change to a fresh folder and then one small commit
marker that names them all.  Readers follow the newest marker, so a run that stops
before its marker has changed nothing: what it wrote is an unnamed folder.  A marker
is created exclusively (its number is taken or it is not), and it carries the key of
the change, so publishing a change twice is publishing it once.

A marker is one line of JSON with paths and a few numbers; tables never pass
through the driver.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from concordia.session import drop_path


@dataclass(frozen=True)
class Commit:
    number: int
    key: str
    tables: dict[str, str]      # all tables as of this commit: name to path
    written: tuple[str, ...]    # those that it wrote itself
    meta: dict = field(default_factory=dict)


class PublishConflict(RuntimeError):
    """Another writer has published since this one last looked."""


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _fs(spark, path)
    return fs.exists(jpath)


def has_files(spark: SparkSession, path: str | None) -> bool:
    """Whether a table is there at all: an absent or empty folder is a first run."""
    if path is None:
        return False
    jpath, fs = _fs(spark, path)
    if not fs.exists(jpath):
        return False
    if not fs.getFileStatus(jpath).isDirectory():
        return True
    return any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(jpath))


def child_names(spark: SparkSession, path: str) -> list[str]:
    jpath, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath)) if fs.exists(jpath) else []


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file of a table."""
    jpath, fs = _fs(spark, path)
    return max((s.getLen() for s in fs.listStatus(jpath)), default=0)


def _read_text(spark: SparkSession, path: str) -> str:
    jpath, fs = _fs(spark, path)
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Published:
    """The published tables under one folder of shared storage."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._known: dict[int, Commit] = {}

    def _numbers(self) -> list[int]:
        names = child_names(self.spark, f"{self.base}/_commits")
        return [int(n[:10]) for n in names if re.fullmatch(r"\d{10}\.json", n)]

    def _commit(self, number: int) -> Commit | None:
        """A commit, once read kept; None if its marker is not whole."""
        if number not in self._known:
            try:
                d = json.loads(_read_text(self.spark, f"{self.base}/_commits/{number:010d}.json"))
            except ValueError:
                return None
            self._known[number] = Commit(number, d["key"], d["tables"], tuple(d["written"]), d["meta"])
        return self._known[number]

    def commits(self) -> list[Commit]:
        """All commits, oldest first."""
        return [c for c in map(self._commit, self._numbers()) if c]

    def latest(self) -> Commit | None:
        """The newest commit; older markers are not read."""
        return next((c for c in map(self._commit, reversed(self._numbers())) if c), None)

    def find(self, key: str) -> Commit | None:
        return next((c for c in self.commits() if c.key == key), None)

    def path(self, name: str) -> str | None:
        last = self.latest()
        return last.tables.get(name) if last else None

    def read(self, name: str) -> DataFrame | None:
        """The table as last published; None before its first time."""
        path = self.path(name)
        return self.spark.read.parquet(path) if path else None

    def publish(self, key: str, tables: dict[str, DataFrame | Callable[[str], None]], meta: dict | None = None) -> Commit:
        """Write ``tables`` (a DataFrame as Parquet, or a function that writes to
        the path it is given) and commit them under ``key``.  Tables that are not
        named stay as they are.  A key that is committed already is left alone."""
        commits = self.commits()
        done = next((c for c in commits if c.key == key), None)
        if done:
            return done
        folder = f"{self.base}/data/{uuid.uuid4().hex}"
        paths = {}
        for name, table in tables.items():
            paths[name] = f"{folder}/{name}"
            if callable(table):
                table(paths[name])
            else:
                table.write.mode("errorifexists").parquet(paths[name])
        before = commits[-1].tables if commits else {}
        number = self._next_number()
        if commits and self.latest().number != commits[-1].number:
            raise PublishConflict(f"{self.base}: commit {self.latest().number} came between")
        commit = Commit(number, key, {**before, **paths}, tuple(paths), meta or {})
        self._mark(commit)
        return commit

    def _next_number(self) -> int:
        return max(self._numbers(), default=-1) + 1

    def _mark(self, commit: Commit) -> None:
        jpath, fs = _fs(self.spark, f"{self.base}/_commits/{commit.number:010d}.json")
        try:
            out = fs.create(jpath, False)
        except Exception as e:
            raise PublishConflict(f"{self.base}: commit {commit.number} is taken") from e
        try:
            out.write(json.dumps({"key": commit.key, "tables": commit.tables, "written": commit.written,
                                  "meta": commit.meta}).encode())
        finally:
            out.close()

    def vacuum(self, keep: int = 2) -> None:
        """Forget all but the last ``keep`` commits, and delete the folders that none
        of these names; what is read and listed stays bounded."""
        kept = self.commits()[-keep:]
        used = {p.rsplit("/", 2)[1] for c in kept for p in c.tables.values()}
        for number in self._numbers():
            if kept and number < kept[0].number:
                drop_path(self.spark, f"{self.base}/_commits/{number:010d}.json")
        for name in child_names(self.spark, f"{self.base}/data"):
            if name not in used:
                drop_path(self.spark, f"{self.base}/data/{name}")
