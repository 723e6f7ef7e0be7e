"""Resumable scans and exports.

A job works off a table of units in chunks of a fixed order.  A chunk's rows are written to a folder of their own and
then named in the manifest, one small file a chunk, written last: what the manifest names is whole, what it does not name is
done again.  A job resumes only on the same query over the same units (`identity`), and tells its coverage at any time.
Status, manifest and rows live in the shared store, so any driver can go on after another.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("running", "complete", "incomplete", "cancelled")


class JobError(RuntimeError):
    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


class Store:
    """Small text files in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def write(self, name: str, value: dict, replace: bool = True) -> None:
        """Written aside and renamed, so a reader sees a whole file or none."""
        aside = self._path(f"{name}.part")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.close()
        target = self._path(name)
        if replace and self._fs.exists(target):
            self._fs.delete(target, False)
        if not self._fs.rename(aside, target):
            raise JobError("NOT_WRITTEN", name)

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if not s.getPath().getName().endswith(".part"))

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


@dataclass
class Status:
    state: str
    chunks: int
    done: int
    rows: int
    failed: int

    @property
    def scan_complete(self) -> bool:
        """Every unit was looked at."""
        return self.done == self.chunks

    @property
    def coverage_complete(self) -> bool:
        """Every unit was looked at, and none failed: only then does absence from the result mean anything."""
        return self.scan_complete and self.failed == 0


class Job:
    """`work(units) -> rows` over chunks of `units`; rows with a non-null `error` column count as failed units."""

    def __init__(self, spark: SparkSession, path: str, units: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], query: dict, chunks: int = 16):
        self.spark, self.units, self.key, self.work, self.chunks = spark, units, key, work, chunks
        self.store = Store(spark, path)
        self.query = query

    def identity(self) -> str:
        """The query and the units: their number and an order-free digest of their keys."""
        digest = self.units.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(self.key).cast("decimal(38,0)")).alias("h")).collect()[0]
        text = json.dumps([self.query, self.chunks, digest["n"], str(digest["h"])], sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()

    def start(self, resume: bool = False) -> None:
        """A new folder, or (resume) one that the same job left incomplete."""
        mine = self.identity()
        if self.store.exists("status.json"):
            found = self.store.read("status.json")
            if not resume:
                raise JobError("EXISTS", self.store.base)
            if found["identity"] != mine:
                raise JobError("OTHER_JOB", "the folder belongs to another query or other units")
            if found["state"] == "complete":
                raise JobError("COMPLETE", "there is nothing to resume")
        elif resume:
            raise JobError("NOTHING_TO_RESUME", self.store.base)
        self.store.write("status.json", {"identity": mine, "state": "running"})

    def _state(self, state: str) -> None:
        self.store.write("status.json", {**self.store.read("status.json"), "state": state})

    def run(self, most: int | None = None) -> Status:
        """Work off what is not committed, `most` chunks at most; stops at a chunk's end when cancelled."""
        committed = set(self.store.names("manifest"))
        left = [k for k in range(self.chunks) if f"{k:08d}.json" not in committed]
        chunk = F.pmod(F.xxhash64(self.key), F.lit(self.chunks))
        for k in left[:most]:
            if self.store.read("status.json")["state"] == "cancelled":
                return self.status()
            folder = f"rows/{k:08d}"
            self.store.remove(folder)
            self.work(self.units.where(chunk == k)).write.parquet(f"{self.store.base}/{folder}")
            rows = self.spark.read.parquet(f"{self.store.base}/{folder}")
            failed = rows.where("error is not null").count() if "error" in rows.columns else 0
            self.store.write(f"manifest/{k:08d}.json", {"chunk": k, "rows": rows.count() - failed, "failed": failed}, replace=False)
        status = self.status()
        if status.scan_complete:
            self._state("complete" if status.coverage_complete else "incomplete")
        return self.status()

    def cancel(self) -> None:
        self._state("cancelled")

    def status(self) -> Status:
        entries = [self.store.read(f"manifest/{n}") for n in self.store.names("manifest")]
        return Status(self.store.read("status.json")["state"], self.chunks, len(entries), sum(e["rows"] for e in entries), sum(e["failed"] for e in entries))

    def results(self) -> DataFrame:
        """The committed rows."""
        folders = [f"{self.store.base}/rows/{n.removesuffix('.json')}" for n in self.store.names("manifest")]
        if not folders:
            raise JobError("NO_RESULTS", "no chunk is committed")
        return self.spark.read.parquet(*folders)

    def release(self) -> None:
        self.store.remove("")


def search_job(spark: SparkSession, path: str, docs: DataFrame, key: str, text: str, query: str, **options) -> Job:
    """A source search that can be stopped, resumed and read while it runs."""
    from lodestack.operators.search import matches

    chunks = options.pop("chunks", 16)
    return Job(spark, path, docs.select(key, text), key, lambda part: matches(part, key, text, query, **options), {"search": query, **options}, chunks)


def export_job(spark: SparkSession, path: str, listings: DataFrame, key: str = "method_id", text: str = "text", chunks: int = 16) -> Job:
    """An export of sources with the SHA-256 of each, verified by `verify`."""
    work = lambda part: part.select(key, text, F.sha2(F.col(text), 256).alias("sha256"), F.when(F.col(text).isNull(), F.lit("no source")).alias("error"))
    return Job(spark, path, listings.select(key, text), key, work, {"export": key}, chunks)


def verify(job: Job, text: str = "text") -> DataFrame:
    """Exported rows whose text no longer has its hash: empty when all is as it was written."""
    return job.results().where(F.col("error").isNull() & (F.sha2(F.col(text), 256) != F.col("sha256")))


def stream_matches(spark: SparkSession, source: str, schema: str, key: str, text: str, query: str, out: str, checkpoint: str):
    """A search over files that keep arriving: each micro-batch is searched once, and committed with its checkpoint."""
    from lodestack.operators.search import matches

    stream = spark.readStream.schema(schema).parquet(source)
    return matches(stream, key, text, query).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
