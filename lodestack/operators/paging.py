"""Result contracts: total order, exact totals, pages by rows and by bytes, cursors, digests."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.sources.steps import cut

PAGE_MOST, PAGE_DEFAULT = 500, 100
#: Bounds and default of a page by bytes.
BYTES_LEAST, BYTES_MOST, BYTES_DEFAULT = 16_384, 1_048_576, 65_536


class ContractError(ValueError):
    """A request that no result can answer; `code` names the reason."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


def _bounds(offset: int, limit: int, most: int = PAGE_MOST) -> None:
    if not 1 <= limit <= most or offset < 0:
        raise ContractError("INVALID_PAGE", f"limit must be 1 to {most} and offset not negative")


def page(df: DataFrame, order: list, offset: int = 0, limit: int = PAGE_DEFAULT) -> DataFrame:
    """Rows [offset, offset + limit) of the total order with position, total and next_offset.

    The total is one partial aggregation; the page is a top-k of offset + limit rows, so nothing is
    numbered but the page itself.
    """
    _bounds(offset, limit)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).limit(offset + limit)
    numbered = rows.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long") - 1).where(F.col("position") >= offset)
    out = numbered.join(F.broadcast(total))
    after = F.lit(offset + limit).cast("long")
    return out.withColumn("next_offset", F.when(after < F.col("total"), after))


def page_by_bytes(df: DataFrame, order: list, size: Column, offset: int = 0, budget: int = BYTES_DEFAULT) -> DataFrame:
    """The longest run of rows from `offset` whose sizes fit the budget; the first row alone may not exceed it."""
    if not BYTES_LEAST <= budget <= BYTES_MOST:
        raise ContractError("INVALID_BUDGET", f"budget must be {BYTES_LEAST} to {BYTES_MOST}")
    # No row is smaller than a byte, so budget rows are enough.
    window = Window.orderBy(*order)
    rows = df.withColumn("bytes", F.greatest(size.cast("long"), F.lit(1).cast("long"))).orderBy(*order).limit(offset + budget)
    rows = rows.withColumn("position", F.row_number().over(window).cast("long") - 1).where(F.col("position") >= offset)
    running = F.sum("bytes").over(window.rowsBetween(Window.unboundedPreceding, 0))
    fits = rows.withColumn("running", running)
    too_large = (F.col("position") == offset) & (F.col("bytes") > budget)
    guarded = F.when(too_large, F.raise_error(F.lit("PAGE_TOO_SMALL: the first row exceeds the budget")).cast("boolean")).otherwise(F.col("running") <= budget)
    return fits.where(guarded)


def positions(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Every row with its place in the total order, without one task for all rows.

    Rows are dealt by range and written once, so their ranges are fixed; each range is numbered by itself and
    shifted by the sizes of the ranges before it, one row each.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "positions")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_within", within).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_range", "_within", "_before")


def ordered_digest(df: DataFrame, record: Column, order: list) -> DataFrame:
    """One row: n_records, and the SHA-256 of every record and a line feed, in order.

    Records are sorted in parallel and folded in one pass that holds one batch at a time.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, n = hashlib.sha256(), 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                state.update((value or "").encode() + b"\n")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([state.hexdigest()])], ["n_records", "sha256"])

    ordered = cut(df.select(record.alias("_record"), *[(o if isinstance(o, Column) else F.col(o)).alias(f"_o{k}") for k, o in enumerate(order)]).orderBy(*[F.col(f"_o{k}") for k in range(len(order))]), "digest")
    # The sorted table is read back by one task, file by file in name order, a batch at a time.
    folded = ordered.orderBy(*[F.col(f"_o{k}") for k in range(len(order))]).select("_record").coalesce(1).mapInArrow(fold, "n_records long, sha256 string")
    # An empty table has no task to fold in.
    empty = hashlib.sha256().hexdigest()
    return folded.agg(F.coalesce(F.max("n_records"), F.lit(0).cast("long")).alias("n_records"), F.coalesce(F.max("sha256"), F.lit(empty)).alias("sha256"))


def identity(**query) -> str:
    """What binds a cursor to its query: the hash of its canonical JSON."""
    return hashlib.sha256(json.dumps(query, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def seal(query_id: str, last: list) -> str:
    body = json.dumps([query_id, last], separators=(",", ":"))
    check = hashlib.sha256(f"cursor:{body}".encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(f"{check}{body}".encode()).decode()


def unseal(cursor: str, query_id: str) -> list:
    """The last sort key of a cursor; another query's or a changed one is an error."""
    try:
        text = base64.urlsafe_b64decode(cursor.encode()).decode()
        check, body = text[:16], text[16:]
        if hashlib.sha256(f"cursor:{body}".encode()).hexdigest()[:16] != check:
            raise ValueError
        owner, last = json.loads(body)
    except ValueError as error:
        raise ContractError("INVALID_CURSOR", "the cursor is damaged") from error
    if owner != query_id:
        raise ContractError("CURSOR_MISMATCH", "the cursor belongs to another query")
    return last


def after(df: DataFrame, order: list[str], last: list | None) -> DataFrame:
    """Rows behind a sort key in the total order of ascending columns."""
    if last is None:
        return df
    return df.where(F.struct(*order) > F.struct(*[F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order, last, strict=True)]))


def top_per_group(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows a group on each side of the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
