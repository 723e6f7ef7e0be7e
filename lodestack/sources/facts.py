"""Fact tables of packages: each file is parsed once, its rows go to one written table, in a folder and a typed struct a kind.

A read of one fact lists its own folder only, prunes the columns it does not need and pushes filters to the files.
Files are parsed where they are read, member by member; what cannot be read gives a row in `failure`, so that a result can
say what it does not cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from . import bytecode as BC
from .chunks import ChunkError, binary_xml, resource_table
from .container import Container, ContainerError, is_dex, preview
from .dex import Annotation, Class, Dex, DexError, flat_values
from .steps import cut

SCHEMAS = {
    "archive_entry": "source string, member string, path string, size long, is_package_member boolean, kind string",
    "dex_string": "dex_id string, idx long, value string",
    "dex_class": "class_id string, dex_id string, descriptor string, superclass string, interfaces array<string>, access long, is_interface boolean, is_abstract boolean, is_annotation boolean, package string, source_file string, idx long",
    "hierarchy_edge": "child string, parent string, kind string",
    "dex_field": "field_id string, class_id string, name string, type string, access long, is_static boolean, idx long",
    "dex_method": "method_id string, class_id string, name string, parameters array<string>, returns string, access long, is_static boolean, is_private boolean, is_final boolean, is_abstract boolean, is_package_private boolean, package string, signature string, has_code boolean, registers long, code_offset long, idx long",
    "dex_instruction": "method_id string, class_id string, dex_id string, pc long, opcode long, name string, registers array<long>, literal long, pool string, pool_idx long, operand string, target long, catches array<long>",
    "dex_annotation": "annotation_id string, class_id string, owner_kind string, owner string, parameter long, type string, visibility long",
    "annotation_value": "annotation_id string, class_id string, owner string, type string, path string, kind string, value string",
    "static_value": "field_id string, class_id string, path string, kind string, value string",
    "resource_variant": "id long, package string, kind string, name string, configuration string, value_kind string, data long, value string, reference long, origin string",
    "document": "path string, text string",
    "listing": "method_id string, class_id string, text string, sha256 string",
    "failure": "path string, part string, reason string",
}

#: Rows of one kind that go to the JVM together.
BATCH_ROWS = 2_000


def _annotation_id(owner: Class, one: Annotation, k: int) -> str:
    return f"{owner.id}#{k}"


def _class_rows(dex: Dex, dex_id: str, k: int, own: Class) -> Iterator[tuple[str, dict]]:
    package = own.id.rpartition(".")[0]
    access = own.access
    parent = Class(own.superclass, 0, None, [], None).id if own.superclass else None
    interfaces = [Class(i, 0, None, [], None).id for i in own.interfaces]
    yield "dex_class", dict(class_id=own.id, dex_id=dex_id, descriptor=own.descriptor, superclass=parent, interfaces=interfaces, access=access, is_interface=bool(access & 0x200), is_abstract=bool(access & 0x400), is_annotation=bool(access & 0x2000), package=package, source_file=own.source, idx=k)
    if parent:
        yield "hierarchy_edge", dict(child=own.id, parent=parent, kind="super")
    for i in interfaces:
        yield "hierarchy_edge", dict(child=own.id, parent=i, kind="interface")
    for n, f in enumerate(own.fields):
        yield "dex_field", dict(field_id=f.id, class_id=own.id, name=f.name, type=f.type, access=f.access, is_static=f.is_static, idx=n)
        for path, kind, text in flat_values(f.value) if f.value else ():
            yield "static_value", dict(field_id=f.id, class_id=own.id, path=path, kind=kind, value=text)
    for n, one in enumerate(own.annotations):
        key = _annotation_id(own, one, n)
        yield "dex_annotation", dict(annotation_id=key, class_id=own.id, owner_kind=one.owner_kind, owner=one.owner, parameter=one.parameter, type=one.type, visibility=one.visibility)
        for name, value in one.elements:
            for path, kind, text in flat_values(value, name):
                yield "annotation_value", dict(annotation_id=key, class_id=own.id, owner=one.owner, type=one.type, path=path, kind=kind, value=text)
    for n, m in enumerate(own.methods):
        a = m.access
        yield "dex_method", dict(method_id=m.id, class_id=own.id, name=m.name, parameters=m.parameters, returns=m.returns, access=a, is_static=bool(a & 8), is_private=bool(a & 2), is_final=bool(a & 16), is_abstract=bool(a & 0x400), is_package_private=not a & 7, package=package, signature=f"{m.name}({''.join(m.parameters)}){m.returns}", has_code=m.code is not None, registers=m.code and m.code.registers, code_offset=m.code and m.code.offset, idx=n)
        try:
            text = BC.listing(dex, m)
            found = [dict(method_id=m.id, class_id=own.id, dex_id=dex_id, pc=i.pc, opcode=i.opcode, name=i.name, registers=list(i.registers), literal=i.literal, pool=i.pool, pool_idx=i.index, operand=BC.operand(dex, i), target=i.target, catches=BC.catches(m.code, i.pc)) for i in BC.instructions(m.code)] if m.code else []
        except (DexError, IndexError) as error:
            yield "failure", dict(path=dex_id, part=m.id, reason=str(error))
            continue
        yield "listing", dict(method_id=m.id, class_id=own.id, text=text, sha256=hashlib.sha256(text.encode()).hexdigest())
        yield from (("dex_instruction", row) for row in found)


def dex_rows(data: bytes, dex_id: str) -> Iterator[tuple[str, dict]]:
    dex = Dex(data)
    for k, text in enumerate(dex.strings):
        yield "dex_string", dict(dex_id=dex_id, idx=k, value=text)
    for k, own in enumerate(dex.classes):
        yield from _class_rows(dex, dex_id, k, own)


def package_rows(path: str, data: bytes) -> Iterator[tuple[str, dict]]:
    """Every fact of one file; a container that is refused gives one failure and nothing else.

    A DEX is told apart by its file and its place in it, so that members of one name in two packages never meet.
    """
    name = path.rpartition("/")[2]
    try:
        if data[:4] == b"dex\n":
            yield from dex_rows(data, path)
            return
        box = Container(data, name)
        # A container is whole or refused, so its directory is walked before anything is given out.
        entries = list(box.entries())
        for one, package in entries:
            raw = package.read(one.member)
            kind = "dex" if is_dex(one.member) and one.is_package_member else "resources" if one.member == "resources.arsc" else preview(raw)[0]
            yield "archive_entry", dict(source=one.source, member=one.member, path=one.path, size=one.size, is_package_member=one.is_package_member, kind=kind)
            try:
                if kind == "dex":
                    yield from dex_rows(raw, f"{path}!{one.path}")
                elif kind == "resources":
                    origin = one.path.split("/")[1] if one.path.startswith("splits/") else "base"
                    for v in resource_table(raw):
                        yield "resource_variant", {**vars(v), "origin": origin}
                elif kind == "text":
                    yield "document", dict(path=one.path, text=binary_xml(raw) if raw[:4] == b"\x03\x00\x08\x00" else raw.decode())
            except (DexError, ChunkError) as error:
                yield "failure", dict(path=one.path, part=kind, reason=str(error))
    except (ContainerError, DexError) as error:
        yield "failure", dict(path=path, part="container", reason=str(error))


def _storable(value):
    """`value` with lone surrogates, which names in a DEX may hold and UTF-8 does not, replaced by question marks."""
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode()
    return [_storable(v) for v in value] if isinstance(value, list) else value


def fact_batch(path: str, kind: str, rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of one kind: its struct is filled, those of the other kinds are null."""
    form = schema.field(kind).type
    try:
        made = pa.array(rows, form)
    except UnicodeEncodeError:
        made = pa.array([{k: _storable(v) for k, v in row.items()} for row in rows], form)
    given = {"file": pa.array([path] * len(rows), pa.string()), "fact": pa.array([kind] * len(rows), pa.string()), kind: made}
    return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(len(rows), f.type) for f in schema], schema=schema)


class Facts:
    """The fact tables of the files under a path; `table(name)` is one of SCHEMAS."""

    def __init__(self, spark: SparkSession, path: str, partitions: int | None = None):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
        if partitions:
            files = files.repartition(partitions, "path")
        form = StructType().add("file", StringType()).add("fact", StringType())
        for name, fields in SCHEMAS.items():
            form = form.add(name, StructType.fromDDL(fields))
        schema = to_arrow_schema(form)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    held: dict[str, list[dict]] = {}
                    for kind, row in package_rows(at, data.as_py()):
                        rows = held.setdefault(kind, [])
                        rows.append(row)
                        if len(rows) >= BATCH_ROWS:
                            yield fact_batch(at, kind, held.pop(kind), schema)
                    for kind, rows in held.items():
                        yield fact_batch(at, kind, rows, schema)

        self.spark = spark
        self.rows = cut(files.mapInArrow(run, form), "facts", by="fact")
        self._check()

    def _check(self) -> None:
        """A class that two files define is an error of the whole load."""
        twice = self.table("dex_class").groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
        if twice:
            raise ContainerError("DUPLICATE_CLASS", twice[0]["class_id"])

    def table(self, name: str) -> DataFrame:
        return self.rows.where(F.col("fact") == name).select(f"{name}.*")

    @property
    def complete(self) -> bool:
        """Whether everything was read."""
        return self.table("failure").limit(1).count() == 0

    def save(self, path: str) -> None:
        """One Parquet folder a table."""
        for name in SCHEMAS:
            self.table(name).write.mode("errorifexists").parquet(f"{path}/{name}")
