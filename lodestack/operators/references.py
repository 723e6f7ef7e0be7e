"""Reference lookups: who uses a string, a number, a field, a type, an annotation; identifiers and callers.

Every lookup is a projection of one shape of table, `owner, position, operand`, joined with the pool that the operand
points into; pools are per container, so the join is always on the container and the index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.names import component_type, simple_type
from lodestack.functions.numbers import hex_pattern, parse_value

#: Most values that one lookup of integers takes.
BATCH = 64

# The instruction ranges that read and write fields.
FIELD_READS, FIELD_WRITES = ((0x52, 0x58), (0x60, 0x66)), ((0x59, 0x5F), (0x67, 0x6D))


def resolve(operands: DataFrame, pool: DataFrame, keys: list[str], index: str, value: str, wanted: Column | None = None) -> DataFrame:
    """Operands with the pool value that they point to; a condition on the pool is applied before the join."""
    held = pool if wanted is None else pool.where(wanted)
    return operands.join(held.select(*keys, F.col(index), F.col(value)), [*keys, index])


def holding(operands: DataFrame, pool: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    """Operands whose pool entry meets a condition, without its columns: a semi-join."""
    return operands.join(pool.where(wanted).select(*keys), keys, "left_semi")


def identifier_matches(identifier: Column, query: str, mode: str = "contains", case_sensitive: bool = True, separator: str = ".") -> Column:
    """Exact or contained, on the whole identifier or on its simple name."""
    simple = F.substring_index(F.substring_index(identifier, "(", 1), separator, -1)
    fold = (lambda c: c) if case_sensitive else F.lower
    query = query if case_sensitive else query.lower()
    if mode == "exact":
        return (fold(identifier) == query) | (fold(simple) == query)
    if mode == "contains":
        return fold(identifier).contains(query) | fold(simple).contains(query)
    raise ValueError(f"match mode {mode}")


def projected(hits: DataFrame, projection: str, owner: str = "owner", group: str = "class_id") -> DataFrame:
    """`full`: the hits; `summary`: counts; `callers`: each owner once with its number of hits."""
    if projection == "full":
        return hits
    if projection == "summary":
        return hits.agg(F.count(F.lit(1)).alias("matches"), F.countDistinct(group).alias("unique_classes"), F.countDistinct(owner).alias("unique_methods"))
    if projection == "callers":
        return hits.groupBy(owner).agg(F.count(F.lit(1)).alias("matching_occurrences"))
    raise ValueError(f"projection {projection}")


def integer_references(loads: DataFrame, values: list[str | int], bits: int = 32, value: str = "value") -> DataFrame:
    """Loads of any of the values, by bit pattern."""
    return loads.where(F.col(value).isin(_wanted(values, bits)))


def integer_totals(loads: DataFrame, values: list[str | int], bits: int = 32, value: str = "value") -> DataFrame:
    """(value, hex, total) for each value asked for, those without a load included."""
    wanted = _wanted(values, bits)
    asked = loads.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v).cast("long") for v in wanted])).alias("value"))
    found = loads.where(F.col(value).isin(wanted)).groupBy(F.col(value).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("total"))
    return asked.join(found, "value", "left").select("value", hex_pattern(F.col("value"), bits).alias("hex"), F.coalesce("total", F.lit(0)).alias("total"))


def _wanted(values: list[str | int], bits: int) -> list[int]:
    if not 1 <= len(values) <= BATCH:
        raise ValueError(f"1 to {BATCH} values")
    return sorted({parse_value(v, bits) for v in values})


def access_kind(opcode: Column) -> Column:
    among = lambda ranges: reduce(lambda a, b: a | b, [opcode.between(lo, hi) for lo, hi in ranges])
    return F.when(among(FIELD_READS), "read").when(among(FIELD_WRITES), "write")


def field_references(accesses: DataFrame, wanted: Column, access: str = "all", kind: str = "access") -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the accesses of a kind, and reads and writes of all before that filter."""
    found = accesses.where(wanted)
    totals = found.agg(F.coalesce(F.sum((F.col(kind) == "read").cast("long")), F.lit(0)).alias("reads"), F.coalesce(F.sum((F.col(kind) == "write").cast("long")), F.lit(0)).alias("writes"))
    return (found if access == "all" else found.where(F.col(kind) == access)), totals


def instantiations(allocations: DataFrame, type_id: object = None, owner: object = None, method: object = None, columns: tuple[str, str, str] = ("type", "class_id", "method_id")) -> DataFrame:
    """Allocations by the allocated type, by who allocates, or by both; one selector at least."""
    given = [(c, v) for c, v in zip(columns, (type_id, owner, method), strict=True) if v is not None]
    if not given:
        raise ValueError("a type, a class or a method is needed")
    return allocations.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in given]))


def type_references(symbols: DataFrame, annotations: DataFrame, class_name: str, type_column: str = "type") -> DataFrame:
    """Uses of a type, or of an array of it, in code and in annotations: one sequence, code first."""
    same = component_type(F.col(type_column)) == class_name
    code = symbols.where(same).withColumn("source_rank", F.lit(0))
    return code.unionByName(annotations.where(same).withColumn("source_rank", F.lit(1)), allowMissingColumns=True)


def annotation_matches(annotation: Column, wanted: str, mode: str) -> Column:
    """By descriptor, by simple name (after the last slash, `$` kept), or by prefix (which may end in a segment)."""
    bare = F.regexp_replace(annotation, r"^L|;$", "")
    goal = wanted.removeprefix("L").removesuffix(";").replace(".", "/") if wanted.startswith("L") or "." in wanted else wanted
    if mode == "exact_descriptor":
        return bare == goal
    if mode == "simple_name":
        return F.substring_index(bare, "/", -1) == wanted
    if mode == "prefix":
        return bare.startswith(goal)
    raise ValueError(f"match mode {mode}")


def argument_partition(calls: DataFrame, value: Column, known: Column, wanted: str) -> DataFrame:
    """Call sites with `verdict`: the argument is proven to be the literal, proven not to be, or not known."""
    return calls.withColumn("verdict", F.when(~F.coalesce(known, F.lit(False)) | value.isNull(), "unresolved").when(value == wanted, "matched").otherwise("excluded"))


def unique_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Joined rows with `ambiguous` where either side has the key more than once."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("_nl"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("_nr"))
    both = a.join(b, key)
    return left.join(both, key).withColumn("ambiguous", (F.col("_nl") > 1) | (F.col("_nr") > 1)).drop("_nl", "_nr")


def by_short_name(names: DataFrame, column: str, short: str) -> DataFrame:
    """Names whose simple name is `short`; more than one is for the caller to report as ambiguous."""
    return names.where(simple_type(F.col(column)) == short)
