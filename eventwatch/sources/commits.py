"""Batch commits: a manifest per micro-batch, published by one rename.

A batch writes its files under its own number into several tables and commits them together: the
manifest says which batch was last, and which files of the rewritten tables are live. Readers take rows up
to that batch and those files only, so they never see half a batch. A batch that failed runs again with
the clock and the manifest it had the first time and replaces what it wrote.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

#: Manifests kept for readers that opened an older one.
KEPT = 5
EMPTY = {"batch": -1, "high_us": None, "ids": [], "alerts": {}, "dropped": []}


class Commits:
    """Manifests of a store below `root`, on any file system Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits/{name}".rstrip("/"))

    def _names(self) -> list[str]:
        if not self._fs.exists(self._path("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")))

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, name: str, content: dict) -> bool:
        """Write the file beside its place and rename it; False if the name is taken."""
        draft = self._path(f"_{name}-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        done = not self._fs.exists(self._path(name)) and self._fs.rename(draft, self._path(name))
        if not done:
            self._fs.delete(draft, False)
        return done

    def latest(self) -> dict:
        """The newest manifest; before the first commit, an empty one of batch -1."""
        done = [n for n in self._names() if n.endswith(".json") and not n.startswith("_")]
        return {**EMPTY, **self._load(done[-1])} if done else dict(EMPTY)

    def begin(self, batch_id: int, now_us: int | None = None) -> int:
        """The batch's clock in µs: that of its first attempt."""
        name = f"{batch_id:012d}.begun"
        if name not in self._names():
            self._publish(name, {"clock_us": int(time.time() * 1e6) if now_us is None else now_us})
        return self._load(name)["clock_us"]

    def commit(self, batch_id: int, manifest: dict) -> None:
        """Publish the batch, then forget old manifests and what the one before it stopped using."""
        before = self.latest()
        self._publish(f"{batch_id:012d}.json", {**manifest, "batch": batch_id})
        # files dropped by this batch stay for readers of the manifest before it
        for folder in before["dropped"]:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}"), True)
        names = [n for n in self._names() if not n.startswith("_")]
        for name in names:
            if int(name.split(".")[0]) <= batch_id - KEPT:
                self._fs.delete(self._path(name), False)
