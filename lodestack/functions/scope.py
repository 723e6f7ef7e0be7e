"""Scope predicates on dotted (or otherwise separated) names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The scope that stands for names whose every segment is one to three characters.
OBFUSCATED = "obfuscated-root"


def under(name: Column, prefix: str, separator: str = ".") -> Column:
    """The name itself or anything below it at a separator: `a.B` holds `a.B.c`, not `a.B$C` or `a.Bc`."""
    return (name == prefix) | name.startswith(prefix + separator)


def obfuscated(name: Column, separator: str = ".") -> Column:
    parts = F.split(name, separator.replace(".", r"\."))
    return F.forall(parts, lambda p: F.length(p).between(1, 3))


def in_scope(name: Column, prefixes: list[str], separator: str = ".") -> Column:
    """Any of the prefixes; an empty list is no restriction."""
    tests = [obfuscated(name, separator) if p == OBFUSCATED else under(name, p, separator) for p in prefixes if p]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)


def package_of(name: Column, separator: str = ".") -> Column:
    """What stands before the last separator, empty if there is none."""
    return F.regexp_extract(name, rf"^(.*)\Q{separator}\E", 1)


def normal_exclusion(raw: str) -> str | None:
    """`pkg.*`, `pkg.` and `pkg` are the root `pkg`; blank and wild roots are none."""
    root = raw.strip().removesuffix("*").rstrip(".").strip()
    return root if root and "*" not in root else None


def excluded(name: Column, patterns: list[str], separator: str = ".") -> Column:
    """Strictly below any of the roots: the root itself stays."""
    roots = [r for r in map(normal_exclusion, patterns) if r]
    return reduce(lambda a, b: a | b, [name.startswith(r + separator) for r in roots]) if roots else F.lit(False)
