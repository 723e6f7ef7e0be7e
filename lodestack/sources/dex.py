"""Compiled classes (DEX): pools, classes, members, code, annotations and values, as plain rows.

The format is the public one.  Reading is total or fails with `DexError`: no part of a file that cannot be read is
passed over.  Indices are local to a file, so every row that holds one also holds the file's id.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

NO_INDEX = 0xFFFFFFFF


class DexError(ValueError):
    """A file that is no readable DEX."""


@dataclass
class Code:
    registers: int
    ins: int
    outs: int
    offset: int
    words: tuple[int, ...]
    tries: list[tuple[int, int, list[tuple[str | None, int]]]]


@dataclass
class Method:
    index: int
    owner: str
    name: str
    parameters: list[str]
    returns: str
    access: int
    code: Code | None = None
    is_direct: bool = False

    @property
    def id(self) -> str:
        return f"{class_of(self.owner)}.{self.name}({''.join(self.parameters)}){self.returns}"


@dataclass
class Field:
    index: int
    owner: str
    name: str
    type: str
    access: int
    is_static: bool
    value: tuple | None = None

    @property
    def id(self) -> str:
        return f"{class_of(self.owner)}.{self.name}:{self.type}"


@dataclass
class Annotation:
    owner_kind: str
    owner: str
    parameter: int | None
    type: str
    visibility: int
    elements: list[tuple[str, tuple]]


@dataclass
class Class:
    descriptor: str
    access: int
    superclass: str | None
    interfaces: list[str]
    source: str | None
    fields: list[Field] = field(default_factory=list)
    methods: list[Method] = field(default_factory=list)
    annotations: list[Annotation] = field(default_factory=list)

    @property
    def id(self) -> str:
        return class_of(self.descriptor)


def class_of(descriptor: str) -> str:
    """`La/b/C;` to `a.b.C`; others as they are."""
    return descriptor[1:-1].replace("/", ".") if descriptor.startswith("L") and descriptor.endswith(";") else descriptor


def modified_utf8(data: bytes) -> str:
    """Modified UTF-8; surrogate pairs are joined, and a lone one becomes its escape, so nothing is lost."""
    text = data.replace(b"\xc0\x80", b"\x00").decode("utf-8", "surrogatepass")
    joined = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")
    return "".join(f"\\u{ord(c):04x}" if 0xD800 <= ord(c) <= 0xDFFF else c for c in joined)


class Dex:
    """A parsed file: string, type, proto, field and method pools, and classes in file order."""

    def __init__(self, data: bytes, budget: int = 512 << 20):
        if len(data) < 112 or data[:4] != b"dex\n":
            raise DexError("no DEX header")
        if len(data) > budget:
            raise DexError(f"{len(data)} bytes exceed the budget of {budget}")
        self.data = data
        try:
            self._read()
        except (IndexError, struct.error, UnicodeError, RecursionError) as error:
            raise DexError(f"truncated or damaged: {error}") from error

    # Readers.

    def u4(self, at: int) -> int:
        return struct.unpack_from("<I", self.data, at)[0]

    def u2(self, at: int) -> int:
        return struct.unpack_from("<H", self.data, at)[0]

    def uleb(self, at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            byte = self.data[at]
            at += 1
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return out, at
            shift += 7
            if shift > 28:
                raise DexError("a number has too many bytes")

    def sleb(self, at: int) -> tuple[int, int]:
        start = at
        out, at = self.uleb(at)
        bits = 7 * (at - start)
        return (out - (1 << bits) if out >> (bits - 1) & 1 else out), at

    def _table(self, header: int, width: int) -> Iterator[int]:
        size, offset = self.u4(header), self.u4(header + 4)
        if offset + size * width > len(self.data):
            raise DexError("a table lies beyond the end")
        return iter(range(offset, offset + size * width, width))

    def _string(self, at: int) -> str:
        _, at = self.uleb(self.u4(at))
        return modified_utf8(self.data[at : self.data.index(b"\0", at)])

    def _types(self, at: int) -> list[str]:
        return [self.types[self.u2(at + 4 + 2 * i)] for i in range(self.u4(at))] if at else []

    def _read(self) -> None:
        self.strings = [self._string(at) for at in self._table(56, 4)]
        self.types = [self.strings[self.u4(at)] for at in self._table(64, 4)]
        self.protos = [(self.types[self.u4(at + 4)], self._types(self.u4(at + 8))) for at in self._table(72, 12)]
        self.fields = [(self.types[self.u2(at)], self.types[self.u2(at + 2)], self.strings[self.u4(at + 4)]) for at in self._table(80, 8)]
        self.methods = [(self.types[self.u2(at)], self.u2(at + 2), self.strings[self.u4(at + 4)]) for at in self._table(88, 8)]
        self.classes = [self._class(at) for at in self._table(96, 32)]

    def method_id(self, index: int) -> str:
        owner, proto, name = self.methods[index]
        returns, parameters = self.protos[proto]
        return f"{class_of(owner)}.{name}({''.join(parameters)}){returns}"

    def field_id(self, index: int) -> str:
        owner, kind, name = self.fields[index]
        return f"{class_of(owner)}.{name}:{kind}"

    def _class(self, at: int) -> Class:
        kind, access, parent, interfaces, source, notes, body, values = struct.unpack_from("<8I", self.data, at)
        out = Class(self.types[kind], access, None if parent == NO_INDEX else self.types[parent], self._types(interfaces), None if source == NO_INDEX else self.strings[source])
        if body:
            self._members(out, body)
        if values:
            found, _ = self._array(values)
            for own, value in zip([f for f in out.fields if f.is_static], found, strict=False):
                own.value = value
        if notes:
            self._annotations(out, notes)
        return out

    def _members(self, out: Class, at: int) -> None:
        sizes = []
        for _ in range(4):
            n, at = self.uleb(at)
            sizes.append(n)
        for k, n in enumerate(sizes):
            index = 0
            for _ in range(n):
                step, at = self.uleb(at)
                access, at = self.uleb(at)
                index += step
                if k < 2:
                    _, kind, name = self.fields[index]
                    out.fields.append(Field(index, out.descriptor, name, kind, access, k == 0))
                    continue
                code, at = self.uleb(at)
                _, proto, name = self.methods[index]
                returns, parameters = self.protos[proto]
                out.methods.append(Method(index, out.descriptor, name, parameters, returns, access, self._code(code) if code else None, k == 2))

    def _code(self, at: int) -> Code:
        registers, ins, outs, n_tries, _, size = struct.unpack_from("<4H2I", self.data, at)
        words = struct.unpack_from(f"<{size}H", self.data, at + 16)
        tries = []
        if n_tries:
            first = at + 16 + 2 * (size + size % 2)
            handlers = first + 8 * n_tries
            for k in range(n_tries):
                start, count, offset = struct.unpack_from("<IHH", self.data, first + 8 * k)
                tries.append((start, start + count, self._handlers(handlers + offset)))
        return Code(registers, ins, outs, at, words, tries)

    def _handlers(self, at: int) -> list[tuple[str | None, int]]:
        n, at = self.sleb(at)
        out: list[tuple[str | None, int]] = []
        for _ in range(abs(n)):
            kind, at = self.uleb(at)
            target, at = self.uleb(at)
            out.append((self.types[kind], target))
        if n <= 0:
            target, at = self.uleb(at)
            out.append((None, target))
        return out

    # Values: (kind, payload); numbers stay bits, indices are resolved.

    def _value(self, at: int, depth: int = 0) -> tuple[tuple, int]:
        if depth > 64:
            raise DexError("values are nested too deep")
        head = self.data[at]
        kind, size, at = head & 0x1F, (head >> 5) + 1, at + 1
        if kind == 0x1C:
            found, at = self._array(at, depth + 1)
            return ("array", found), at
        if kind == 0x1D:
            found, at = self._encoded_annotation(at, depth + 1)
            return ("annotation", found), at
        if kind == 0x1E:
            return ("null", None), at
        if kind == 0x1F:
            return ("boolean", size - 1), at
        raw = self.data[at : at + size]
        number, at = int.from_bytes(raw, "little"), at + size
        signed = int.from_bytes(raw, "little", signed=True)
        # The kinds of the format, and how each payload reads.
        readers = {
            0x00: ("byte", signed), 0x02: ("short", signed), 0x03: ("char", number), 0x04: ("int", signed), 0x06: ("long", signed),
            0x10: ("float", number << 8 * (4 - size) if size <= 4 else number), 0x11: ("double", number << 8 * (8 - size)),
            0x15: ("method_type", number), 0x16: ("method_handle", number),
        }
        if kind in readers:
            return readers[kind], at
        pools = {0x17: ("string", lambda: self.strings[number]), 0x18: ("type", lambda: self.types[number]), 0x19: ("field", lambda: self.field_id(number)), 0x1A: ("method", lambda: self.method_id(number)), 0x1B: ("enum", lambda: self.field_id(number))}
        if kind not in pools:
            raise DexError(f"value kind {kind:#x}")
        name, look = pools[kind]
        return (name, look()), at

    def _array(self, at: int, depth: int = 0) -> tuple[list[tuple], int]:
        n, at = self.uleb(at)
        out = []
        for _ in range(n):
            value, at = self._value(at, depth)
            out.append(value)
        return out, at

    def _encoded_annotation(self, at: int, depth: int = 0) -> tuple[tuple[str, list[tuple[str, tuple]]], int]:
        kind, at = self.uleb(at)
        n, at = self.uleb(at)
        out = []
        for _ in range(n):
            name, at = self.uleb(at)
            value, at = self._value(at, depth)
            out.append((self.strings[name], value))
        return (self.types[kind], out), at

    def _set(self, out: Class, at: int, owner_kind: str, owner: str, parameter: int | None = None) -> None:
        for i in range(self.u4(at) if at else 0):
            item = self.u4(at + 4 + 4 * i)
            (kind, elements), _ = self._encoded_annotation(item + 1)
            out.annotations.append(Annotation(owner_kind, owner, parameter, kind, self.data[item], elements))

    def _annotations(self, out: Class, at: int) -> None:
        own, n_fields, n_methods, n_parameters = struct.unpack_from("<4I", self.data, at)
        self._set(out, own, "class", out.id)
        at += 16
        for _ in range(n_fields):
            self._set(out, self.u4(at + 4), "field", self.field_id(self.u4(at)))
            at += 8
        for _ in range(n_methods):
            self._set(out, self.u4(at + 4), "method", self.method_id(self.u4(at)))
            at += 8
        for _ in range(n_parameters):
            listed, owner = self.u4(at + 4), self.method_id(self.u4(at))
            for k in range(self.u4(listed)):
                self._set(out, self.u4(listed + 4 + 4 * k), "parameter", owner, k)
            at += 8


def flat_values(value: tuple, path: str = "") -> Iterator[tuple[str, str, str | None]]:
    """(path, kind, text) of a value and all values in it."""
    kind, payload = value
    if kind == "array":
        yield path, kind, None
        for k, inner in enumerate(payload):
            yield from flat_values(inner, f"{path}[{k}]")
    elif kind == "annotation":
        yield path, kind, payload[0]
        for name, inner in payload[1]:
            yield from flat_values(inner, f"{path}.{name}")
    elif kind == "null":
        yield path, kind, None
    elif kind == "boolean":
        yield path, kind, "true" if payload else "false"
    else:
        yield path, kind, str(payload)
