"""Versioned manifest of a store: which runs are live, the last sequence, and the
stream batches written.

A version is one small JSON file ``manifest-NNNNNNNN.json``.  A commit writes the
next version under a name of its own and publishes it in one step, which fails if
another writer was first.  Files are reached by Spark's own file systems, so
driver and executors see the same folder.
"""

from __future__ import annotations

import base64
import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from kvlake.options import Busy, Corruption

VERSION = "manifest-{:08d}.json"


@dataclass(frozen=True)
class Run:
    """A folder of sorted rows.  Their sequences count from ``base``."""

    name: str
    level: int
    base: int
    rows: int
    min_seq: int
    max_seq: int
    smallest_key: bytes
    largest_key: bytes

    def overlaps(self, low: bytes | None, high: bytes | None) -> bool:
        """Whether the run may hold keys of [low, high]; open bounds are None."""
        return (high is None or self.smallest_key <= high) and (low is None or self.largest_key >= low)


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    last_seq: int = 0
    runs: tuple[Run, ...] = ()
    #: last batch written of each stream, by the stream's id
    batches: dict[str, int] = field(default_factory=dict)

    def adding(self, *runs: Run) -> Manifest:
        return replace(self, runs=(*self.runs, *runs), last_seq=max([self.last_seq, *(r.max_seq for r in runs)]))

    def without(self, names: set[str]) -> Manifest:
        return replace(self, runs=tuple(r for r in self.runs if r.name not in names))

    def to_json(self) -> str:
        def plain(v):
            return base64.b64encode(v).decode() if isinstance(v, bytes) else v

        d = asdict(self)
        d["runs"] = [{k: plain(v) for k, v in r.items()} for r in d["runs"]]
        return json.dumps(d)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        try:
            d = json.loads(text)
            keys = ("smallest_key", "largest_key")
            runs = tuple(Run(**{k: base64.b64decode(v) if k in keys else v for k, v in r.items()}) for r in d["runs"])
            return cls(d["version"], d["last_seq"], runs, dict(d["batches"]))
        except (ValueError, KeyError, TypeError) as e:
            raise Corruption(f"manifest can't be read: {e}") from e

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r.level, r.name, r.rows, r.smallest_key, r.largest_key) for r in self.runs]
        return spark.createDataFrame(rows, "level int, run string, n_rows long, smallest_key binary, largest_key binary")


class Folder:
    """A folder of small files, in whatever file system Spark finds its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._jvm = spark, path.rstrip("/"), spark._jvm
        self._root = self._at("")
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self) -> bool:
        return self._fs.exists(self._root)

    def make(self) -> None:
        self._fs.mkdirs(self._root)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._root)) if self.exists() else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file, whole or not at all; Busy if there is one of this name."""
        own, last = self._at(f".{name}.{uuid.uuid4().hex}"), self._at(name)
        out = self._fs.create(own)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a rename would replace what is there
                paths = [self._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (last, own)]
                self._jvm.java.nio.file.Files.createLink(*paths)
            elif not self._fs.rename(own, last):
                raise Busy(f"{name} was committed by another writer")
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise Busy(f"{name} was committed by another writer") from e
        finally:
            self._fs.delete(own, False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def versions(folder: Folder) -> list[int]:
    found = (n.removeprefix("manifest-").removesuffix(".json") for n in folder.names() if n.startswith("manifest-"))
    return [int(n) for n in found if n.isdigit()]


def load(folder: Folder, version: int | None = None) -> Manifest:
    """The given or newest version; an empty manifest if there is none."""
    if version is None:
        version = max(versions(folder), default=0)
    return Manifest.from_json(folder.read(VERSION.format(version))) if version else Manifest()


def commit(folder: Folder, manifest: Manifest) -> Manifest:
    """Make ``manifest`` the next version; Busy if it exists already."""
    new = replace(manifest, version=manifest.version + 1)
    folder.create(VERSION.format(new.version), new.to_json())
    return new
