"""Open projects of a session: open, list, inspect, forget."""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lodestack.operators.paging import ContractError
from lodestack.project import Project

#: Projects that are looked at in one step of a listing.
BATCH = 16


@dataclass
class Instance:
    id: str
    path: str
    project: Project
    opened: float = field(default_factory=time.time)

    def info(self) -> dict:
        one = self.project
        manifest = [r["name"] for r in one.get_manifest_components().limit(1).collect()]
        return {"instance_id": self.id, "path": self.path, "classes": one.get_all_classes().count(), "has_manifest": bool(manifest), "complete": one.facts.complete}


class Registry:
    """Instances by id; the id is of the path and the content's modification, so a changed file is another instance."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._open: dict[str, Instance] = {}

    def open_apk(self, path: str) -> Instance:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length").orderBy("path").collect()
        if not files:
            raise ContractError("NO_INPUT", path)
        key = hashlib.sha256(repr([tuple(f) for f in files]).encode()).hexdigest()[:16]
        if key not in self._open:
            self._open[key] = Instance(key, path, Project.open(self.spark, path))
        return self._open[key]

    def get(self, instance_id: str) -> Instance:
        if instance_id not in self._open:
            raise ContractError("UNKNOWN_INSTANCE", instance_id)
        return self._open[instance_id]

    def list_instances(self, path: str | None = None, package: str | None = None) -> DataFrame:
        rows = [(i.id, i.path, i.opened) for i in self._open.values() if (path is None or path in i.path) and (package is None or i.project.get_all_classes(package_prefix=package).limit(1).count())]
        return self.spark.createDataFrame(rows, "instance_id string, path string, opened double")

    def get_instance_info(self, instance_id: str) -> dict:
        return self.get(instance_id).info()

    def get_health(self, offset: int = 0) -> list[dict]:
        """The next BATCH instances: whether their tables can still be read, and what was not read of their files."""
        out = []
        for one in list(self._open.values())[offset : offset + BATCH]:
            try:
                out.append({"instance_id": one.id, "ready": True, "failures": one.project.failures.count()})
            except Exception as error:  # a table that is gone is an answer here
                out.append({"instance_id": one.id, "ready": False, "failures": None, "reason": type(error).__name__})
        return out

    def forget_instance(self, instance_id: str) -> None:
        self.get(instance_id)
        del self._open[instance_id]
