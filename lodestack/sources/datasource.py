"""`spark.read.format("package_facts").option("table", ...).load(path)`: a fact table of local package files.

One partition a file; filters on class_id, method_id, dex_id and path are taken over and applied before rows leave the reader.
Files must be readable by path on every worker; for remote stores use `facts.Facts`.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from .facts import SCHEMAS, package_rows

PUSHED = ("class_id", "method_id", "dex_id", "path")


class FilePart(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


class PackageReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType):
        self.path, self.table = path, table
        self.names = [f.name for f in schema.fields]
        self.equal: dict[str, object] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if isinstance(one, EqualTo) and len(one.attribute) == 1 and one.attribute[0] in PUSHED:
                self.equal[one.attribute[0]] = one.value
            else:
                yield one

    def partitions(self) -> list[FilePart]:
        files = [self.path] if os.path.isfile(self.path) else sorted(f for f in glob.glob(f"{self.path}/**", recursive=True) if os.path.isfile(f))
        return [FilePart(f) for f in files] or [FilePart("")]

    def read(self, part: FilePart) -> Iterator[tuple]:
        if not part.file:
            return
        with open(part.file, "rb") as stream:
            data = stream.read()
        for fact, row in package_rows(part.file, data):
            if fact == self.table and all(row.get(k) == v for k, v in self.equal.items()):
                yield tuple(row.get(n) for n in self.names)


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "package_facts"

    def schema(self) -> str:
        table = self.options.get("table", "dex_class")
        if table not in SCHEMAS:
            raise ValueError(f"table is one of {', '.join(SCHEMAS)}")
        return SCHEMAS[table]

    def reader(self, schema: StructType) -> PackageReader:
        return PackageReader(self.options["path"], self.options.get("table", "dex_class"), schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackageSource)
