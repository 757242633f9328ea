"""A log of commits over files of rows: readers see whole commits, writers add one at a time, in order.

A store is a folder with ``data`` (a folder of Parquet files for each write) and ``log`` (numbered manifests that name such folders). A write
puts its rows down first and then creates the next manifest; creation fails if another writer has that number, and the loser takes the
number after it, having looked at what came between. What no manifest names is never read: a job that dies leaves rows, but no commit.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, types as T

from ..operators.gates import GateError
from ..session import file_system

#: Digits of a manifest's name, and numbers that a writer tries before it gives up.
DIGITS, TRIES = 12, 1000


@dataclass(frozen=True)
class Commit:
    """One manifest: its number, the folder of its rows, and what the writer said about them."""

    version: int
    folder: str
    note: dict


class CommitLog:
    def __init__(self, spark: SparkSession, store: str, schema: str | T.StructType):
        self.spark, self.store, self.schema = spark, store.rstrip("/"), schema

    def _create(self, name: str, text: str) -> bool:
        """Create a file, whole, unless it is there; whether this call did."""
        path = f"{self.store}/log/{name}"
        url = urlparse(path)
        if url.scheme in ("", "file"):  # a local file system has no create that fails atomically but a link
            os.makedirs(os.path.dirname(url.path), exist_ok=True)
            part = f"{url.path}.{uuid.uuid4().hex}"
            with open(part, "x", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(part, url.path)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
        fs, p = file_system(self.spark, path)
        from py4j.protocol import Py4JJavaError

        try:
            out = fs.create(p, False)
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        out.write(bytearray(text, "utf-8"))
        out.close()
        return True

    def commits(self) -> list[Commit]:
        """All commits, in order. A gap in the numbers raises: a manifest has been lost."""
        fs, p = file_system(self.spark, f"{self.store}/log")
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith("."))
        if names != [f"{i:0{DIGITS}d}.json" for i in range(len(names))]:
            raise GateError("a commit is missing")
        if not names:
            return []
        # Manifests are small, one for each write.
        read = self.spark.sparkContext.wholeTextFiles(f"{self.store}/log/*.json").collect()
        found = {os.path.basename(path): json.loads(text) for path, text in read}
        return [Commit(i, found[n]["folder"], found[n]["note"]) for i, n in enumerate(names) if n in found]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of all commits, or of those up to a version."""
        folders = [f"{self.store}/data/{c.folder}" for c in self.commits() if version is None or c.version <= version]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, note: dict | None = None, check: Callable[[list[Commit]], None] | None = None) -> Commit:
        """Add the rows as one commit. ``check`` sees the commits that came since the rows were made, and raises where they do not agree with them."""
        seen = self.commits()
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.store}/data/{folder}")
        text = json.dumps({"folder": folder, "note": note or {}}, sort_keys=True)
        version = len(seen)
        for _ in range(TRIES):
            if self._create(f"{version:0{DIGITS}d}.json", text):
                return Commit(version, folder, note or {})
            others = self.commits()
            if check:
                check(others[len(seen) :])
            version = max(version + 1, len(others))
        raise GateError("other writers were faster every time")

    def lost(self) -> list[str]:
        """Folders of rows that no commit names: of writers that died, or are at work."""
        fs, p = file_system(self.spark, f"{self.store}/data")
        known = {c.folder for c in self.commits()}
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName() not in known) if fs.exists(p) else []

    def compact(self) -> Commit:
        """The rows of all commits in a store of their own beside this one, as its only commit; this one stays as it is."""
        return CommitLog(self.spark, f"{self.store}-{uuid.uuid4().hex[:8]}", self.schema).append(self.read(), {"of": len(self.commits())})
