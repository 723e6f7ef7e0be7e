"""Record counts, coverage and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories of a histogram, and samples of each.
CATEGORIES, SAMPLES = 256, 3


def tri_counts(fact: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.sum(F.coalesce(fact, F.lit(False)).cast("long")).alias("yes"),
        F.sum(F.coalesce(~fact, F.lit(False)).cast("long")).alias("no"),
        F.sum(fact.isNull().cast("long")).alias("unresolved"),
    ]


def record_counts(records: DataFrame, kind: str, fact: Column) -> DataFrame:
    """Total, true, false and unresolved by kind, and over all kinds (kind null): one rollup, one shuffle."""
    return records.rollup(kind).agg(*tri_counts(fact))


def histogram(rows: DataFrame, reason: Column, sample: str, categories: int = CATEGORIES, samples: int = SAMPLES) -> DataFrame:
    """(reason, n, samples): the most frequent reasons, the smallest samples of each, and one row for the others.

    Samples are thinned by rank before they are collected, so a reason that most rows have gathers no list.
    """
    named = rows.select(reason.alias("reason"), F.col(sample).alias("_sample"))
    sizes = named.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    least = named.distinct().withColumn("_k", F.row_number().over(Window.partitionBy("reason").orderBy("_sample"))).where(F.col("_k") <= samples)
    lists = least.groupBy("reason").agg(F.sort_array(F.collect_list("_sample")).alias("samples"))
    top = sizes.orderBy(F.desc("n"), "reason").limit(categories)
    total = sizes.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    kept = top.agg(F.sum("n").alias("kept"), F.count(F.lit(1)).alias("shown"))
    empty = F.array().cast(lists.schema["samples"].dataType)
    rest = total.join(F.broadcast(kept)).where("kinds > shown").select(F.lit("(other)").alias("reason"), (F.col("all") - F.col("kept")).alias("n"), empty.alias("samples"))
    return top.join(lists, "reason", "left").select("reason", "n", F.coalesce("samples", empty).alias("samples")).unionByName(rest)


def normal_reason(text: Column) -> Column:
    """A failure's text without what differs from case to case: numbers, hex words and quoted names."""
    text = F.regexp_replace(text, r"0x[0-9a-fA-F]+", "0x#")
    text = F.regexp_replace(text, r"'[^']*'|\"[^\"]*\"|`[^`]*`", "'…'")
    return F.regexp_replace(text, r"\d+(?!x#)", "#")


def capped_distinct(rows: DataFrame, column: str, most: int = 200) -> DataFrame:
    """One row: the first `most` distinct values, how many there are, and whether the list is complete."""
    values = rows.select(column).where(F.col(column).isNotNull()).distinct()
    total = values.agg(F.count(F.lit(1)).alias("n_distinct"))
    first = values.orderBy(column).limit(most).agg(F.sort_array(F.collect_list(column)).alias("values"))
    return first.join(F.broadcast(total)).withColumn("complete", F.col("n_distinct") <= most)


def edge_totals(edges: DataFrame, source: str, target: str, inferred: Column) -> DataFrame:
    """One row an edge: declared and inferred call sites."""
    return edges.groupBy(source, target).agg(F.sum((~inferred).cast("long")).alias("declared"), F.sum(inferred.cast("long")).alias("inferred"))


def source_coverage(units: DataFrame, status: str) -> DataFrame:
    """Units by how they were rendered, with their share."""
    total = units.agg(F.count(F.lit(1)).alias("_all"))
    return units.groupBy(status).agg(F.count(F.lit(1)).alias("units")).join(F.broadcast(total)).select(status, "units", (F.col("units") / F.col("_all")).alias("share"))
