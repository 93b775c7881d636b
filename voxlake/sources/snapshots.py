"""Several tables that change together: a manifest names the files of one state and is put in place last."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class State:
    """One committed state: its number, and path and schema of each table."""

    number: int
    tables: dict[str, dict[str, Any]]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        table = self.tables[name]
        return spark.read.schema(StructType.fromJson(table["schema"])).parquet(table["path"])


class Snapshots:
    """States of a group of tables under one folder of any Hadoop file system.

    Tables are written to folders of their own; then a manifest is written aside and renamed to the next number, which fails
    if another writer was first. A reader takes the last manifest and sees all tables of that state or none of them. Nothing
    is overwritten, so a reader keeps its state while others commit. A run that fails leaves folders that no manifest names.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._system = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self._fs.Path(name)

    def _list(self, folder: str) -> Iterator[Any]:
        path = self._path(f"{self.root}/{folder}")
        return iter(self._system.listStatus(path)) if self._system.exists(path) else iter(())

    def _numbers(self) -> list[int]:
        names = (s.getPath().getName() for s in self._list("manifests"))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def _load(self, number: int) -> State:
        stream = self._system.open(self._path(f"{self.root}/manifests/{number:012d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return State(number, json.loads(text))

    def current(self) -> State | None:
        """The last state that was committed."""
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else None

    def commit(self, tables: dict[str, DataFrame], base: State | None = None) -> State:
        """Write the tables as one new state; those of the state before that are not given go on as they are.

        With `base`, the commit fails if another state has come since then, as the tables were made from that one.
        """
        before = self.current()
        if base is not None and (before is None or before.number != base.number):
            raise RuntimeError(f"state {base.number} is no longer the last one under {self.root}")
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        state = dict(before.tables) if before else {}
        for name, table in tables.items():
            path = f"{folder}/{name}"
            table.write.parquet(path)
            state[name] = {"path": path, "schema": json.loads(table.schema.json())}
        number = before.number + 1 if before else 1
        aside = self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}")
        stream = self._system.create(aside)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        context = self._fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        context.rename(aside, self._path(f"{self.root}/manifests/{number:012d}.json"), plain)
        return State(number, state)

    def orphans(self) -> list[str]:
        """Folders of tables that no state names: of failed runs, of runs that go on, and of states that were dropped."""
        named = {t["path"].rsplit("/", 2)[1] for n in self._numbers() for t in self._load(n).tables.values()}
        return sorted(s.getPath().getName() for s in self._list("data") if s.getPath().getName() not in named)

    def clean(self, keep: int = 1, min_age: float = 86_400.0) -> list[str]:
        """Drop all states but the last `keep`, and what no state names and nobody has written to for `min_age` seconds."""
        for number in self._numbers()[: -max(1, keep)]:
            self._system.delete(self._path(f"{self.root}/manifests/{number:012d}.json"), False)
        ended = (time.time() - min_age) * 1000
        left = set(self.orphans())
        gone = []
        for status in list(self._list("data")) + [s for s in self._list("manifests") if s.getPath().getName().startswith("_")]:
            name = status.getPath().getName()
            if (name in left or name.startswith("_")) and self._newest(status) <= ended:
                self._system.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)

    def _newest(self, status: Any) -> int:
        if not status.isDirectory():
            return status.getModificationTime()
        inside = [s.getModificationTime() for t in self._system.listStatus(status.getPath()) if t.isDirectory() for s in self._system.listStatus(t.getPath())]
        return max([status.getModificationTime(), *inside])
