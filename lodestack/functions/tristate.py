"""Three-valued facts: true, false, and null for unresolved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(fact: Column) -> Column:
    """Aggregate OR where true outranks unresolved, and unresolved outranks false (unlike bool_or)."""
    return F.when(F.max(F.coalesce(fact, F.lit(False)).cast("int")) == 1, True).when(F.count(F.when(fact.isNull(), 1)) > 0, None).otherwise(False)


def matches(fact: Column, wanted: bool | None) -> Column:
    """Null-safe equality: None asks for the unresolved."""
    return fact.eqNullSafe(F.lit(wanted).cast("boolean"))


def verdict(proven: Column, refuted: Column) -> Column:
    """`matched`, `excluded` or `unresolved`."""
    return F.when(F.coalesce(proven, F.lit(False)), "matched").when(F.coalesce(refuted, F.lit(False)), "excluded").otherwise("unresolved")
