"""Search over documents: matches with offsets, lines and previews; comment scopes; enclosing members; trigrams."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.sources.steps import shared_folder


def matches(docs: DataFrame, key: str, text: str, query: str, use_regex: bool = False, case_sensitive: bool = True, per_document: int | None = None) -> DataFrame:
    """One row a match: key, ordinal, start, end, line, column, matched, preview (code points, lines from 1).

    Documents without a match are dropped by a JVM predicate, so only the others reach Python, in Arrow batches.
    """
    body = query if use_regex else regex.escape(query, special_only=True)
    T.pattern(query, use_regex, case_sensitive)
    find = regex.compile(body, regex.V0 if case_sensitive else regex.V0 | regex.IGNORECASE).finditer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                line, line_start, seen, ordinal = 1, 0, 0, 0
                for found in find(value):
                    start, end = found.span()
                    if start == end:
                        continue
                    breaks = value.count("\n", seen, start)
                    if breaks:
                        line, line_start = line + breaks, value.rfind("\n", seen, start) + 1
                    seen = start
                    stop = value.find("\n", start)
                    stop = len(value) if stop < 0 else stop
                    head = max(line_start, start - T.BEFORE)
                    preview = ("…" if head > line_start else "") + value[head : min(stop, start + T.AFTER)]
                    keep.append(row)
                    rows.append((ordinal, start, end, line, start - line_start + 1, found.group(), preview))
                    ordinal += 1
                    if per_document and ordinal >= per_document:
                        break
            if rows:
                columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:5]]
                texts = [pa.array(c, pa.string()) for c in list(zip(*rows, strict=True))[5:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), *columns, *texts], [key, "ordinal", "start", "end", "line", "column", "matched", "preview"])

    kind = docs.schema[key].dataType.simpleString()
    some = docs.select(key, text).where(T.contains(F.col(text), query, use_regex, case_sensitive))
    return some.mapInArrow(run, f"`{key}` {kind}, ordinal long, start long, end long, line long, column long, matched string, preview string")


def counts(docs: DataFrame, key: str, text: str, query: str, use_regex: bool = False, case_sensitive: bool = True) -> DataFrame:
    """Documents with a match and how many they have, inside the JVM."""
    some = docs.where(T.contains(F.col(text), query, use_regex, case_sensitive))
    exact = T.count_literal(F.col(text), query) if not use_regex and case_sensitive else T.count_matches(F.col(text), query, use_regex, case_sensitive)
    return some.select(key, exact.alias("n_matches")).where("n_matches > 0")


def spans(docs: DataFrame, key: str, text: str, opening: str, closing: str, kind: str) -> DataFrame:
    """(key, kind, start, end) of regions from an opening to the next closing mark, or to the end of the text."""
    find = re.compile(re.escape(opening) + ".*?(?:" + re.escape(closing) + r"|\Z)", re.S).finditer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, *m.span()) for r, value in enumerate(batch.column(1).to_pylist()) for m in find(value)]
            if rows:
                at, start, end = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([kind] * len(at)), pa.array(start, pa.int64()), pa.array(end, pa.int64())], [key, "kind", "start", "end"])

    some = docs.select(key, text).where(F.col(text).contains(opening))
    return some.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, kind string, start long, end long")


def line_offsets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, start, end) of every line, in code points, inside the JVM."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("_i", "_t"))
    size = F.length("_t").cast("long")
    run = Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(size + 1).over(run) - 1
    return lines.withColumn("end", end).select(key, (F.col("_i") + 1).cast("long").alias("line"), (F.col("end") - size).alias("start"), "end")


def scoped(hits: DataFrame, regions: DataFrame, key: str, inside: bool) -> DataFrame:
    """Hits that overlap a region, or (inside=False) none: an equi-join on the document with the interval as residual."""
    r = regions.select(F.col(key).alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    meets = (F.col(key) == F.col("_key")) & (F.col("start") < F.col("_end")) & (F.col("end") > F.col("_start"))
    return hits.join(r, meets, "left_semi" if inside else "left_anti")


def enclosing(hits: DataFrame, definitions: DataFrame, keys: list[str], at: str, start: str, carry: list[str]) -> DataFrame:
    """Each hit with the last definition that starts at or before it: an as-of join as one ordered union.

    Definitions and hits of a group are sorted together, definitions first on ties; the last carried values run
    forward.  One shuffle, no pairs.
    """
    slots = [F.col(c).alias(f"_d_{c}") for c in carry]
    left = hits.withColumns({f"_d_{c}": F.lit(None).cast(definitions.schema[c].dataType) for c in carry}).withColumns({"_at": F.col(at), "_hit": F.lit(1)})
    right = definitions.select(*keys, *slots, F.col(start).alias("_at"), F.lit(0).alias("_hit"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_at", "_hit").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({c if c not in hits.columns else f"enclosing_{c}": F.last(f"_d_{c}", ignorenulls=True).over(order) for c in carry})
    return out.where("_hit = 1").drop("_at", "_hit", *[f"_d_{c}" for c in carry])


def usages_in_order(hits: DataFrame, key: str, name: Column, wanted: str, standard: list[str]) -> DataFrame:
    """Search order: the document named exactly as the query, then those outside standard packages, then the rest."""
    known = F.lit(False)
    for prefix in standard:
        known = known | name.startswith(prefix)
    return hits.withColumn("rank", F.when(name == wanted, 0).when(~known, 1).otherwise(2)).orderBy("rank", key)


def trigram_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Postings (gram, key): the distinct runs of three code points of every document.

    `kept_index` writes it once, so that a query reads the postings of its own trigrams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [{v[i : i + 3] for i in range(len(v) - 2)} if v else set() for v in part.column(1).to_pylist()]
                row = pa.array([r for r, grams in enumerate(found) for _ in grams], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), pa.array([g for grams in found for g in grams], pa.string())], [key, "gram"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, gram string")


def kept_index(spark: SparkSession, source: str, key: str, text: str) -> DataFrame:
    """The `trigram_index` of the Parquet table at `source`, built once and read from the shared folder from then on.

    Every part of the table gives one segment, sorted by gram where it is made: nothing is shuffled, a frequent gram
    weighs on no task, and the least and greatest gram of a page let a query skip the others.  The index belongs to the paths, sizes and
    times of the table's files: once these change, it is built anew.  One that was not written to its end is not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    state = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    mark = hashlib.sha256(repr((source, key, text, *state)).encode()).hexdigest()[:32]
    base = f"{shared_folder(spark)}/trigrams-{mark}"
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{base}-*/_SUCCESS")
    done = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    docs = spark.read.parquet(source)
    if done:
        path = min(one.getPath().getParent().toString() for one in done)
    else:
        path = f"{base}-{uuid.uuid4().hex}"
        trigram_index(docs, key, text).sortWithinPartitions("gram", key).write.parquet(path)
    return spark.read.schema(f"`{key}` {docs.schema[key].dataType.simpleString()}, gram string").parquet(path)


def search_indexed(docs: DataFrame, index: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """`counts` by the index: documents that hold all trigrams of the query, then verified on their texts."""
    grams = sorted({query[i : i + 3] for i in range(len(query) - 2)})
    if not grams:
        return counts(docs, key, text, query)
    held = index.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(grams))
    return counts(docs.join(held.select(key), key, "left_semi"), key, text, query)


def near_matches(docs: DataFrame, key: str, name: Column, query: str, most: int = 20) -> DataFrame:
    """(key, relaxation): exact matches; where there are none, contained ones; where none, contained after folding case."""
    levels = F.when(name == query, 0).when(name.contains(query), 1).when(F.lower(name).contains(query.lower()), 2)
    found = docs.withColumn("_level", levels).where("_level is not null")
    best = found.agg(F.min("_level").alias("_best"))
    out = found.join(F.broadcast(best), F.col("_level") == F.col("_best"))
    named = F.element_at(F.array(F.lit("exact"), F.lit("contains"), F.lit("folded")), F.col("_level") + 1)
    return out.select(key, named.alias("relaxation")).orderBy(key).limit(most)
