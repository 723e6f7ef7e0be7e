"""Exports of sources and assets, and the command line for them."""

from __future__ import annotations

import argparse
import hashlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import scope as S
from lodestack.operators.paging import ContractError
from lodestack.project import Project
from lodestack.streaming import jobs


def export_source(project: Project, out: str, class_name: str | None = None, method_id: str | None = None) -> dict:
    """One class's or method's listing to a new folder, with its hash and what it covers."""
    if (class_name is None) == (method_id is None):
        raise ContractError("INVALID_SELECTOR", "a class or a method")
    store = jobs.Store(project.spark, out)
    if store.exists():
        raise ContractError("EXISTS", out)
    rows = (project.get_class_disassembly(class_name) if class_name else project.table("listing").where(F.col("method_id") == method_id)).select("text", "sha256").collect()
    if not rows:
        raise ContractError("NO_SOURCE", class_name or method_id)
    text = rows[0]["text"]
    missing = project.failures.where(F.col("part").startswith(f"{class_name}.") if class_name else F.col("part") == method_id).count()
    status = {"sha256": hashlib.sha256(text.encode()).hexdigest(), "characters": len(text), "failed_methods": missing, "complete": missing == 0}
    store.write("source.json", {"text": text})
    store.write("completion.json", status)
    return status


def export_asset(project: Project, files: str, path: str) -> DataFrame:
    """The bytes of a member by its path: (path, size, sha256, content), read again from the files."""
    from collections.abc import Iterator

    import pyarrow as pa

    from lodestack.sources.container import Container, ContainerError

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = [(e.path, p.read(e.member)) for e, p in Container(data.as_py(), name.rpartition("/")[2]).entries() if e.path == path]
                except ContainerError:
                    continue
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.binary())], ["path", "content"])

    raw = project.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files).select("path", "content")
    out = raw.mapInArrow(run, "path string, content binary")
    return out.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def export_package_source(project: Project, out: str, package_prefix: str | None = None, chunks: int = 16) -> jobs.Job:
    """A job over the listings in scope; see `jobs` for start, run, resume, cancel and status."""
    listings = project.table("listing").where(S.in_scope(F.col("class_id"), [package_prefix] if package_prefix else []))
    return jobs.export_job(project.spark, out, listings, chunks=chunks)


def main(arguments: list[str] | None = None) -> int:
    """export INPUT OUTPUT [--prefix P] [--resume]; 0 complete, 1 not started, 2 incomplete."""
    parser = argparse.ArgumentParser(prog="lodestack-export")
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--prefix")
    parser.add_argument("--resume", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    try:
        job = export_package_source(Project.open(spark, given.input), given.output, given.prefix)
        job.start(given.resume)
    except (ContractError, jobs.JobError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1
    status = job.run()
    print(f"{status.state}: {status.rows} sources, {status.failed} failed, {status.done} of {status.chunks} chunks")
    return 0 if status.coverage_complete else 2


if __name__ == "__main__":
    sys.exit(main())
