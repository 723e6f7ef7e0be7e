"""Binary XML and resource tables: the chunked format that both share."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr


class ChunkError(ValueError):
    """A file whose chunks cannot be read."""


# Chunk types.
STRING_POOL, TABLE, XML, TABLE_PACKAGE, TABLE_TYPE = 0x0001, 0x0002, 0x0003, 0x0200, 0x0201
XML_START_NAMESPACE, XML_END_NAMESPACE, XML_START, XML_END, XML_TEXT, XML_RESOURCE_MAP = 0x0100, 0x0101, 0x0102, 0x0103, 0x0104, 0x0180
NONE = 0xFFFFFFFF

# Kinds of typed values, units of dimensions and fractions.
KINDS = {0x00: "null", 0x01: "reference", 0x02: "attribute", 0x03: "string", 0x04: "float", 0x05: "dimension", 0x06: "fraction", 0x07: "reference", 0x10: "int_dec", 0x11: "int_hex", 0x12: "boolean", 0x1C: "color", 0x1D: "color", 0x1E: "color", 0x1F: "color"}
UNITS = ("px", "dip", "sp", "pt", "in", "mm")
FRACTIONS = ("%", "%p")
# Attributes of the framework that are found by their id where the name is stripped.
FRAMEWORK_ATTRIBUTES = {
    0x01010001: "label", 0x01010002: "icon", 0x01010003: "name", 0x01010006: "permission", 0x01010009: "protectionLevel", 0x0101000E: "enabled", 0x01010010: "exported", 0x01010011: "process",
    0x01010018: "authorities", 0x0101001D: "launchMode", 0x01010024: "value", 0x01010025: "resource", 0x01010026: "mimeType", 0x01010027: "scheme", 0x01010028: "host", 0x01010029: "port",
    0x0101002A: "path", 0x0101002B: "pathPrefix", 0x0101002C: "pathPattern", 0x010100D0: "id", 0x01010202: "targetActivity", 0x0101020C: "minSdkVersion", 0x01010270: "targetSdkVersion",
}
LAUNCH_MODES = ("standard", "singleTop", "singleTask", "singleInstance", "singleInstancePerTask")


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(type, start, header size, end) of the chunks in a range."""
    while at + 8 <= end:
        kind, header, size = struct.unpack_from("<HHI", data, at)
        if size < 8 or header > size or at + size > end:
            raise ChunkError(f"chunk {kind:#06x} at {at} has size {size}")
        yield kind, at, header, at + size
        at += size


def string_pool(data: bytes, at: int) -> list[str]:
    n, _, flags, first, _ = struct.unpack_from("<5I", data, at + 8)
    header = struct.unpack_from("<H", data, at + 2)[0]
    out = []
    for offset in struct.unpack_from(f"<{n}I", data, at + header):
        p = at + first + offset
        if flags & 0x100:
            for _ in range(2):
                size, p = (data[p], p + 1) if data[p] < 0x80 else ((data[p] & 0x7F) << 8 | data[p + 1], p + 2)
            out.append(data[p : p + size].decode("utf-8", "replace"))
        else:
            size, p = struct.unpack_from("<H", data, p)[0], p + 2
            if size & 0x8000:
                size, p = (size & 0x7FFF) << 16 | struct.unpack_from("<H", data, p)[0], p + 2
            out.append(data[p : p + 2 * size].decode("utf-16-le", "replace"))
    return out


def rendered(kind: int, value: int, strings: list[str]) -> str:
    """A typed value as text."""
    name = KINDS.get(kind, "unknown")
    if name == "string":
        return strings[value]
    if name == "null":
        return "@empty" if value == 1 else "@null"
    if name in ("reference", "attribute"):
        return f"{'?' if name == 'attribute' else '@'}0x{value:08x}"
    if name == "float":
        return repr(struct.unpack("<f", struct.pack("<I", value))[0])
    if name in ("dimension", "fraction"):
        shift = (0, 7, 15, 23)[value >> 4 & 3]
        mantissa = value >> 8
        number = (mantissa - (1 << 24) if mantissa >> 23 else mantissa) / (1 << shift)
        units = UNITS if name == "dimension" else FRACTIONS
        number *= 100 if name == "fraction" else 1
        return f"{number:g}{units[value & 0xF] if (value & 0xF) < len(units) else '?'}"
    if name == "int_dec":
        return str(value - (1 << 32) if value >> 31 else value)
    if name == "boolean":
        return "true" if value else "false"
    if name == "color":
        return f"#{value:08x}"
    return f"0x{value:x}"


def binary_xml(data: bytes) -> str:
    """A binary document as text; names that were stripped come from the ids of the framework's attributes."""
    try:
        return _binary_xml(data)
    except (struct.error, IndexError) as error:
        raise ChunkError(f"truncated or damaged: {error}") from error


def _binary_xml(data: bytes) -> str:
    kind, header, size = struct.unpack_from("<HHI", data, 0)
    if kind != XML:
        raise ChunkError("no binary XML")
    strings: list[str] = []
    ids: tuple[int, ...] = ()
    prefixes: list[tuple[str, str]] = []
    fresh: list[tuple[str, str]] = []
    out = ['<?xml version="1.0" encoding="utf-8"?>']
    depth, is_open = 0, False
    prefix_of = lambda uri: next((p for p, u in reversed(prefixes) if u == uri), None)

    def named(namespace: int, name: str) -> str:
        prefix = prefix_of(strings[namespace]) if namespace != NONE else None
        return f"{prefix}:{name}" if prefix else name

    for kind, at, head, _ in chunks(data, header, min(size, len(data))):
        body = at + head
        if kind == STRING_POOL:
            strings = string_pool(data, at)
        elif kind == XML_RESOURCE_MAP:
            ids = struct.unpack_from(f"<{(struct.unpack_from('<I', data, at + 4)[0] - head) // 4}I", data, body)
        elif kind in (XML_START_NAMESPACE, XML_END_NAMESPACE):
            pair = tuple(strings[i] for i in struct.unpack_from("<2I", data, body))
            if kind == XML_START_NAMESPACE:
                prefixes.append(pair)
                fresh.append(pair)
            elif pair in prefixes:
                prefixes.reverse()
                prefixes.remove(pair)
                prefixes.reverse()
        elif kind == XML_START:
            namespace, name, start, width, count = struct.unpack_from("<2I3H", data, body)
            cells = [f"xmlns:{p}={quoteattr(u)}" for p, u in fresh]
            fresh.clear()
            for k in range(count):
                space, own, raw, _, _, vtype, value = struct.unpack_from("<3IHBBI", data, body + start + k * width)
                label = strings[own] or FRAMEWORK_ATTRIBUTES.get(ids[own] if own < len(ids) else 0, f"attr_{ids[own]:08x}" if own < len(ids) else "attr")
                text = strings[raw] if raw != NONE else rendered(vtype, value, strings)
                if raw == NONE and label == "launchMode" and value < len(LAUNCH_MODES):
                    text = LAUNCH_MODES[value]
                cells.append(f"{named(space, label)}={quoteattr(text)}")
            if is_open:
                out[-1] += ">"
            out.append("  " * depth + " ".join([f"<{named(namespace, strings[name])}", *cells]))
            depth, is_open = depth + 1, True
        elif kind == XML_END:
            namespace, name = struct.unpack_from("<2I", data, body)
            depth -= 1
            if is_open:
                out[-1] += "/>"
            else:
                out.append("  " * depth + f"</{named(namespace, strings[name])}>")
            is_open = False
        elif kind == XML_TEXT:
            if is_open:
                out[-1] += ">"
                is_open = False
            out.append("  " * depth + escape(strings[struct.unpack_from("<I", data, body)[0]]))
    return "\n".join(out) + "\n"


@dataclass(frozen=True)
class Variant:
    """One value of a resource: id, package, kind, name, configuration, and the value's kind, data and text."""

    id: int
    package: str
    kind: str
    name: str
    configuration: str
    value_kind: str
    data: int
    value: str | None
    reference: int | None


def configuration(data: bytes) -> str:
    """The qualifiers of a configuration record; empty for the default one."""
    size = struct.unpack_from("<I", data, 0)[0]
    raw = data[:size].ljust(64, b"\0")
    mcc, mnc = struct.unpack_from("<2H", raw, 4)
    parts = [f"mcc{mcc}"] if mcc else []
    parts += [f"mnc{mnc}"] if mnc else []

    def code(two: bytes, base: int) -> str:
        if two[0] & 0x80:
            packed = two[0] | two[1] << 8
            return "".join(chr(base + (packed >> s & 0x1F)) for s in (0, 5, 10))
        return two.rstrip(b"\0").decode("ascii", "replace")

    language, region = code(raw[8:10], ord("a")), code(raw[10:12], ord("0"))
    if language:
        parts.append(language + (f"-r{region}" if region else ""))
    density, sdk = struct.unpack_from("<H", raw, 14)[0], struct.unpack_from("<H", raw, 24)[0]
    layout, mode = raw[28], raw[29]
    smallest, width, height = struct.unpack_from("<3H", raw, 30)
    parts += [f"ldltr"] if layout >> 6 == 1 else ["ldrtl"] if layout >> 6 == 2 else []
    parts += [f"sw{smallest}dp"] if smallest else []
    parts += [f"w{width}dp"] if width else []
    parts += [f"h{height}dp"] if height else []
    # Names of orientations, night modes and densities.
    parts += [("port", "land", "square")[raw[12] - 1]] if 1 <= raw[12] <= 3 else []
    parts += [("notnight", "night")[(mode >> 4 & 3) - 1]] if mode >> 4 & 3 in (1, 2) else []
    named = {120: "ldpi", 160: "mdpi", 213: "tvdpi", 240: "hdpi", 320: "xhdpi", 480: "xxhdpi", 640: "xxxhdpi", 0xFFFE: "anydpi", 0xFFFF: "nodpi"}
    parts += [named.get(density, f"{density}dpi")] if density else []
    parts += [f"v{sdk}"] if sdk else []
    return "-".join(parts)


def resource_table(data: bytes) -> list[Variant]:
    """Every simple value of every resource; bags give one row each, without a value."""
    try:
        return list(_resource_table(data))
    except (struct.error, IndexError) as error:
        raise ChunkError(f"truncated or damaged: {error}") from error


def _resource_table(data: bytes) -> Iterator[Variant]:
    kind, header, size = struct.unpack_from("<HHI", data, 0)
    if kind != TABLE:
        raise ChunkError("no resource table")
    strings: list[str] = []
    for kind, at, head, end in chunks(data, header, min(size, len(data))):
        if kind == STRING_POOL:
            strings = string_pool(data, at)
        elif kind == TABLE_PACKAGE:
            yield from _package(data, at, head, end, strings)


def _package(data: bytes, at: int, head: int, end: int, strings: list[str]) -> Iterator[Variant]:
    number = struct.unpack_from("<I", data, at + 8)[0]
    package = data[at + 12 : at + 268].decode("utf-16-le").split("\0")[0]
    types_at, _, keys_at = struct.unpack_from("<3I", data, at + 268)
    types, keys = string_pool(data, at + types_at), string_pool(data, at + keys_at)
    for kind, start, width, _ in chunks(data, at + head, end):
        if kind != TABLE_TYPE:
            continue
        type_id, flags, _, count, entries = struct.unpack_from("<BBHII", data, start + 8)
        config = configuration(data[start + 20 : start + width])
        index = start + width
        if flags & 1:
            places = [(e, 4 * o) for e, o in (struct.unpack_from("<HH", data, index + 4 * k) for k in range(count))]
        elif flags & 2:
            places = [(k, 4 * o) for k, o in enumerate(struct.unpack_from(f"<{count}H", data, index)) if o != 0xFFFF]
        else:
            places = [(k, o) for k, o in enumerate(struct.unpack_from(f"<{count}I", data, index)) if o != NONE]
        for entry, offset in places:
            p = start + entries + offset
            size, entry_flags, key = struct.unpack_from("<HHI", data, p)
            common = (number << 24 | type_id << 16 | entry, package, types[type_id - 1])
            if entry_flags & 8:
                # A compact entry: the key in the size field, the value's kind in the flags, the data in place of the key.
                yield _variant(common, keys[size], config, entry_flags >> 8, key, strings)
            elif entry_flags & 1:
                yield Variant(*common, keys[key], config, "bag", 0, None, None)
            else:
                _, _, vtype, value = struct.unpack_from("<HBBI", data, p + size)
                yield _variant(common, keys[key], config, vtype, value, strings)


def _variant(common: tuple, name: str, config: str, vtype: int, value: int, strings: list[str]) -> Variant:
    kind = KINDS.get(vtype, "unknown")
    return Variant(*common, name, config, kind, value, rendered(vtype, value, strings), value if kind == "reference" else None)
