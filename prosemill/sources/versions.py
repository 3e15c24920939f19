"""A table of immutable snapshots: a version is published by making one file, so readers see the old rows or the new ones."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from .staging import store


class Versioned:
    """``path/data/<snapshot>`` holds rows, ``path/versions/<number>.json`` says which snapshot a version is; the highest number is the current one.

    A version's file is written beside and renamed to its number, which fails if another writer was first: then the write
    is refused and its snapshot stays unseen. A crash at any step leaves the table as it was, and at most a snapshot that no version names, which expire() clears.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files, self.at = store(spark, path)

    def _names(self, folder: str) -> list[str]:
        at = self.at(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in self.files.listStatus(at)] if self.files.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit())

    def info(self, version: int | None = None) -> dict:
        """A version's entry: number, data, made (seconds since 1970). Without a number that of the current one."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise LookupError(f"{self.path} has no version {'' if version is None else version}".rstrip())
        number = known[-1] if version is None else version
        return {"number": number} | json.loads(self._read(f"versions/{number}.json"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; the frame stays with it whatever is published later, until expire() removes it."""
        return self.spark.read.parquet(self.info(version)["data"])

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """SNK7: publishes df as the next version; df may read this table. ``after`` refuses the write if another version has come since."""
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        base = self.versions()
        df.write.parquet(data)
        return self._publish(data, (base[-1] if base else 0) if after is None else after)

    def promote(self, winner: Versioned, losers: tuple[Versioned, ...] = ()) -> int:
        """SNK11: the winner's current snapshot becomes this table's next version. No row is copied: the snapshot is pinned where it lies. The losers go, but for what others have pinned."""
        data = winner.info()["data"]
        if winner.path != self.path:
            # pinned first: a crash behind this leaves a pin too many, never a snapshot too few
            owner = Versioned(self.spark, data.rsplit("/data/", 1)[0])
            owner._make(f"pins/{data.rsplit('/', 1)[1]}.{uuid.uuid4().hex}", self.path)
        known = self.versions()
        number = known[-1] if known and self.info()["data"] == data else self._publish(data, known[-1] if known else 0)
        for x in losers:
            if x.path not in (self.path, winner.path):
                x.drop()
        return number

    def expire(self, keep: int = 2, older_than: float = 0.0) -> list[str]:
        """Removes all but the last ``keep`` versions, and the snapshots that neither a version nor a pin names and that are older than ``older_than`` seconds (those of writes under way are not)."""
        if keep < 1:
            raise ValueError("the current version stays")
        gone = []
        for n in self.versions()[:-keep]:
            self.files.delete(self.at(f"{self.path}/versions/{n}.json"), False)
            gone.append(f"versions/{n}.json")
        named = {self.info(n)["data"] for n in self.versions()}
        return gone + self._clear(named, older_than)

    def drop(self) -> None:
        """All versions go, and all snapshots that no other table has pinned."""
        self.files.delete(self.at(f"{self.path}/versions"), True)
        self._clear(set(), 0.0)

    def _pinned(self) -> set[str]:
        """Snapshots that a version of the table that pinned them still names."""
        out = set()
        for name in self._names("pins"):
            other, data = Versioned(self.spark, self._read(f"pins/{name}").strip()), f"{self.path}/data/{name.split('.')[0]}"
            if data in {other.info(n)["data"] for n in other.versions()}:
                out.add(data)
        return out

    def _clear(self, named: set[str], older_than: float) -> list[str]:
        kept, gone = named | self._pinned(), []
        for name in self._names("data"):
            data = f"{self.path}/data/{name}"
            if data not in kept and time.time() - self.files.getFileStatus(self.at(data)).getModificationTime() / 1000 >= older_than:
                self.files.delete(self.at(data), True)
                gone.append(f"data/{name}")
        return gone

    def _publish(self, data: str, after: int) -> int:
        hidden = f"versions/.{uuid.uuid4().hex}"
        self._make(hidden, json.dumps({"data": data, "made": time.time()}))
        target = self.at(f"{self.path}/versions/{after + 1}.json")
        newer = [n for n in self.versions() if n > after]
        if newer or self.files.exists(target) or not self.files.rename(self.at(f"{self.path}/{hidden}"), target):
            self.files.delete(self.at(f"{self.path}/{hidden}"), False)
            raise RuntimeError(f"{self.path}: version {after + 1} is another writer's")
        return after + 1

    def _make(self, name: str, content: str) -> None:
        out = self.files.create(self.at(f"{self.path}/{name}"), False)
        out.write(bytearray(content.encode()))
        out.close()

    def _read(self, name: str) -> str:
        stream = self.files.open(self.at(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
