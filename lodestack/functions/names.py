"""Descriptors, members and selectors of compiled classes, as column expressions and as plain functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The primitive descriptors and their type names.
PRIMITIVES = {"V": "void", "Z": "boolean", "B": "byte", "S": "short", "C": "char", "I": "int", "J": "long", "F": "float", "D": "double"}
DESCRIPTOR = r"\[*(?:L[^;]+;|[VZBSCIJFD])"


def class_name(descriptor: Column) -> Column:
    """`La/b/C;` to `a.b.C`; null for anything else."""
    inner = F.regexp_extract(descriptor, r"^L([^;]+);$", 1)
    return F.when(inner != "", F.translate(inner, "/", "."))


def type_name(descriptor: Column) -> Column:
    """A descriptor as Java writes it: `[La/B;` to `a.B[]`, `J` to `long`; others stay."""
    ranks = F.length(F.regexp_extract(descriptor, r"^(\[*)", 1))
    inner = F.regexp_replace(descriptor, r"^\[+", "")
    named = F.coalesce(class_name(inner), F.element_at(F.create_map(*[F.lit(x) for kv in PRIMITIVES.items() for x in kv]), inner), inner)
    return F.concat(named, F.repeat(F.lit("[]"), ranks))


def descriptors(joined: Column) -> Column:
    """The descriptors of a parameter list, as an array."""
    return F.regexp_extract_all(joined, F.lit(DESCRIPTOR), F.lit(0))


def simple_type(name: Column) -> Column:
    """The part after the last dot."""
    return F.substring_index(name, ".", -1)


def component_type(name: Column) -> Column:
    """`T[][]` to `T`."""
    return F.regexp_replace(name, r"(?:\[\])+$", "")


def method_id(owner: Column, name: Column, parameters: Column, returns: Column) -> Column:
    return F.concat(owner, F.lit("."), name, F.lit("("), F.array_join(parameters, ""), F.lit(")"), returns)


def field_id(owner: Column, name: Column, descriptor: Column) -> Column:
    return F.concat(owner, F.lit("."), name, F.lit(":"), descriptor)


def normal_selector(selector: str) -> str:
    """One spelling for a member: `La/B;->m(I)V`, `a/B.m(I)V`, `a.B#m(I)V` and `a.B.m:(I)V` are `a.B.m(I)V`."""
    text = selector.strip()
    if found := re.match(r"^L([^;]+);->(.+)$", text):
        owner, member = found[1].replace("/", "."), found[2]
    else:
        head, mark, tail = text.partition("(")
        head = head.replace("/", ".").replace("::", ".").replace("->", ".").replace("#", ".")
        owner, _, member = head.rpartition(".")
        member += mark + tail
    member = re.sub(r"^([^(:]+):\(", r"\1(", member)
    return f"{owner}.{member}" if owner else member


def is_complete(selector: str) -> bool:
    """Whether a selector names its parameters and return type."""
    return re.search(r"\(.*\)" + DESCRIPTOR + "$", selector) is not None


def owner_of(selector: str) -> str:
    return selector.partition("(")[0].partition(":")[0].rpartition(".")[0]


def is_identifier(text: Column) -> Column:
    return text.rlike(r"^[\p{L}_$][\p{L}\p{N}_$]*$")


def quoted(value: Column) -> Column:
    """A string column as Java source writes it; characters beyond ASCII stay, which Java allows."""
    # The short escapes, the backslash first.
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), value, F.lit('"'))


def java_literal(value: str) -> str:
    """A string as Java source writes it: ASCII, with escapes for everything else."""
    # The short escapes.
    short = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}
    units = value.encode("utf-16-be", "surrogatepass")
    out = []
    for k in range(0, len(units), 2):
        c = units[k] << 8 | units[k + 1]
        out.append(short.get(chr(c)) or (chr(c) if 0x20 <= c < 0x7F else f"\\u{c:04x}"))
    return '"' + "".join(out) + '"'


def tracing_snippet(selector: str) -> str:
    """A hook for a method, as a tracer's script: the overload is picked by its parameter types."""
    full = normal_selector(selector)
    head, _, tail = full.partition("(")
    owner, _, name = head.rpartition(".")
    kinds = re.findall(DESCRIPTOR, tail.partition(")")[0])
    spell = lambda d: PRIMITIVES.get(d) or (d.replace("/", ".") if d[0] == "[" else d[1:-1].replace("/", "."))
    names = [f"a{k}" for k in range(len(kinds))]
    member = "$init" if name == "<init>" else name
    overload = ", ".join(f'"{spell(k)}"' for k in kinds)
    values = ", ".join(names)
    return (
        "Java.perform(() => {\n"
        f'  const owner = Java.use("{owner}");\n'
        f"  owner.{member}.overload({overload}).implementation = function ({values}) {{\n"
        f'    console.log("{full}"{"".join(", " + n for n in names)});\n'
        f"    return this.{member}({values});\n"
        "  };\n"
        "});\n"
    )
