"""Score parts behind a log of commits: ever-rising part numbers, snapshots for readers, several writers at once.

A part is a folder of Parquet files. It exists for readers from the moment that its number's file appears in the log, which
happens at once or not at all: the file is written under a name of its own and then linked or renamed to the next number,
which fails if another writer has taken that. Then the writer looks at what the other one added, drops what is there
already, and tries the number after it. So nothing is lost, doubled or half seen; a writer that dies leaves a folder that no
number names, which ``vacuum`` removes. Reading at a number gives what there was then, whatever was added since.

The shared folder must be a local one or in a store whose rename refuses an existing target, as HDFS does. A missing folder
is an empty table. Columns that older parts lack are null.
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .readers import SCORES


class PartLog:
    """``folder`` as a table of ``schema`` whose rows ``key`` tells apart."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType = SCORES, key: str = "item_id") -> None:
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key

    # --- files
    def _hadoop(self, path: str):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm  # noqa: SLF001
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """Names in a folder with their times of change in milliseconds."""
        at, store = self._hadoop(f"{self.folder}/{folder}")
        return [(f.getPath().getName(), f.getModificationTime()) for f in store.listStatus(at)] if store.exists(at) else []

    def _put(self, number: int, text: str) -> bool:
        """The log's file of this number with this text, all of it at once; False if there is one."""
        own, name = f"{self.folder}/log/.{uuid.uuid4().hex}", f"{self.folder}/log/{number:020d}.json"
        at, store = self._hadoop(own)
        out = store.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()
        if store.getScheme() != "file":
            done = store.rename(at, self._hadoop(name)[0])
        else:  # a local rename would replace, a link doesn't
            local = lambda p: Path(self._hadoop(p)[0].toUri().getPath())
            try:
                os.link(local(own), local(name))
                done = True
            except FileExistsError:
                done = False
        if store.exists(at):
            store.delete(at, False)
        return done

    # --- the log
    def commits(self) -> list[tuple[int, dict]]:
        """Numbers and entries in order."""
        names = sorted(n for n, _ in self._names("log") if n.endswith(".json") and not n.startswith("."))
        if not names:
            return []
        rows = self.spark.read.text([f"{self.folder}/log/{n}" for n in names], wholetext=True).select("value", "_metadata.file_name").collect()
        return sorted((int(r["file_name"].removesuffix(".json")), json.loads(r["value"])) for r in rows)

    def version(self) -> int:
        """The last number, -1 if there is none."""
        return max((int(n.removesuffix(".json")) for n, _ in self._names("log") if n.endswith(".json") and not n.startswith(".")), default=-1)

    def _folders(self, after: int, upto: int | None) -> list[str]:
        found: list[str] = []
        for number, entry in self.commits():
            if number > after and (upto is None or number <= upto):
                found = [entry["folder"]] if entry.get("all") and after < 0 else [*found, *([] if entry.get("all") else [entry["folder"]])]
        return found

    def read(self, upto: int | None = None, after: int = -1) -> DataFrame:
        """The rows of the parts up to a number, all by default, or of those after another number."""
        folders = self._folders(after, upto)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/parts/{f}" for f in folders))

    # --- writers
    def _write(self, rows: DataFrame) -> tuple[str, DataFrame]:
        name = uuid.uuid4().hex
        rows.select(self.schema.fieldNames()).write.parquet(f"{self.folder}/parts/{name}")
        return name, self.spark.read.schema(self.schema).parquet(f"{self.folder}/parts/{name}")

    def append(self, rows: DataFrame) -> int | None:
        """Adds the rows whose key no part has; the number of the new part, None if there was nothing to add."""
        seen = self.version()
        fresh = rows.dropDuplicates([self.key]).join(self.read(seen).select(self.key), self.key, "left_anti")
        name, part = self._write(fresh)
        while n := part.count():
            if self._put(seen + 1, json.dumps({"folder": name, "rows": n})):
                return seen + 1
            last, seen = seen, self.version()
            others = self.read(seen, after=last).select(self.key)
            if not part.join(others, self.key, "left_semi").isEmpty():
                name, part = self._write(part.join(others, self.key, "left_anti"))
        return None

    def compact(self) -> int | None:
        """One part in place of all so far, so that readers open one folder; None if another writer was faster."""
        seen = self.version()
        if seen < 0:
            return None
        name, part = self._write(self.read(seen))
        return seen + 1 if self._put(seen + 1, json.dumps({"folder": name, "rows": part.count(), "all": True})) else None

    def vacuum(self, older_than_s: float = 86_400.0) -> list[str]:
        """Removes folders of writers that died: named by no entry and older than so many seconds. Parts that ``compact``
        replaced stay, for readers at older numbers."""
        named, at, now = {e["folder"] for _, e in self.commits()}, self._names("parts"), self.spark.sparkContext._jvm.System.currentTimeMillis()  # noqa: SLF001
        old = [n for n, changed in at if n not in named and now - changed > older_than_s * 1000]
        for n in old:
            path, store = self._hadoop(f"{self.folder}/parts/{n}")
            store.delete(path, True)
        return sorted(old)
