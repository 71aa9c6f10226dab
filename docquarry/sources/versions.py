"""Versions of a set of tables in one folder: what belongs together becomes visible together.

A version is a small JSON file that names the parts of every table. Parts are folders that are written once and never
changed. A new version is written beside the others and moved to its number, which fails if that is taken; so of two
writers one wins, and a writer that stops before the move leaves the old version as it was. Readers take the largest
number once and see its parts alone, whatever is written meanwhile."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has made the next version."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        place = self._path(f"{self.root}/_versions")
        if not self._fs.exists(place):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _load(self, number: int) -> dict:
        source = self._fs.open(self._path(f"{self.root}/_versions/{number:012d}.json"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def latest(self) -> tuple[int, dict]:
        """The last version's number and content; 0 and nothing where there is none."""
        numbers = self._numbers()
        return (numbers[-1], self._load(numbers[-1])) if numbers else (0, {})

    def new_part(self, name: str) -> str:
        """A folder of this store that nothing has been written to."""
        return f"{self.root}/{name}/{uuid.uuid4().hex}"

    def commit(self, after: int, content: dict) -> int:
        """Make `content` the version after number `after`. Conflict if that is there already."""
        number = after + 1
        name = f"{number:012d}.json"
        draft = self._path(f"{self.root}/_versions/.{name}.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = self.spark.sparkContext
        kind = getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename")
        target = self._path(f"{self.root}/_versions/{name}")
        try:
            # unlike a file system's own rename, this one never replaces what is there
            context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, target, context._gateway.new_array(kind, 0))
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{self.root} has a version {number} already") from e
            raise
        return number

    def collected(self, keep: int = 1) -> int:
        """Delete all versions but the last `keep`, and the parts that only those name; how many folders went.

        Parts of a commit that is under way are named by no version yet: call this when nothing is being written."""
        numbers = self._numbers()
        named: set[str] = set()

        def look(x) -> None:
            if isinstance(x, str):
                named.add(x)
            elif isinstance(x, (dict, list)):
                for y in x.values() if isinstance(x, dict) else x:
                    look(y)

        for number in numbers[-keep:]:
            look(self._load(number))
        for number in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_versions/{number:012d}.json"), False)
        gone = 0
        for table in self._fs.listStatus(self._path(self.root)) if self._fs.exists(self._path(self.root)) else []:
            if table.isDirectory() and table.getPath().getName() != "_versions":
                for part in self._fs.listStatus(table.getPath()):
                    if f"{self.root}/{table.getPath().getName()}/{part.getPath().getName()}" not in named:
                        self._fs.delete(part.getPath(), True)
                        gone += 1
        return gone
