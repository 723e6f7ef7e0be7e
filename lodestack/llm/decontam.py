"""Benchmark decontamination by winnowing.

Words are hashed in runs of `K_GRAM`; of every `WINDOW` consecutive run hashes the smallest is a
fingerprint.  Two texts that share `K_GRAM + WINDOW - 1 = 10` consecutive words share a fingerprint
at the same place, whatever stands around it, so every shared span of ten words is found.

The fingerprints of documents are joined with those of the benchmark on their 64-bit hash.  Before the join a bitmap of
2^22 bits of the benchmark's fingerprints, of a fixed size whatever the benchmark's, thins those of the documents; where a large
benchmark fills it, more rows reach the join and the results stay the same.  What meets is extended: the texts with a
met fingerprint, once each however often they are copied, give the windows of ten words around it, and these are joined
with the benchmark's windows on their words, so that no hash decides a result.  Both joins broadcast the benchmark's side while it has
at most `BROADCAST_ROWS` rows; beyond that they shuffle, and adaptive execution splits what is skewed.

An item of fewer than ten words is one window.  For each such length that the benchmark has (nine at
most), every run of that many words is a fingerprint, since winnowing promises nothing for shorter spans.

A verdict is of a text alone, so rows meet theirs by the digest of the text, whatever their doc_id is.

Defined results: a null or empty text, and one without words, has n_words 0 and no hits; an item
without words hits nothing; null item_ids are left out; repeated items count once by item_id; each row
of `docs` gives one row, repeated or not; an empty benchmark hits nothing; only doc_id and text of
`docs`, and item_id and text of the benchmark, are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import Steps, bound_batches, sent, spare

SPAN = 10
K_GRAM = 5
WINDOW = SPAN - K_GRAM + 1
BITS = 1 << 22
BROADCAST_ROWS = 200_000


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word position, hash) of the winnowed runs of each row with at least SPAN words."""
    at, value = K.grams(hashes, first, K_GRAM)
    if not len(at):
        return at, value
    # A run's row, and where in `at` the row's runs end, bound each window to its row.
    row = np.searchsorted(first, at, side="right") - 1
    n = len(at) - WINDOW + 1
    if n <= 0:
        return at[:0], value[:0]
    views = np.lib.stride_tricks.sliding_window_view(value, WINDOW)
    best = np.arange(n) + (WINDOW - 1 - np.argmin(views[:, ::-1], axis=1))
    chosen = np.unique(best[row[:n] == row[WINDOW - 1 :]])
    return at[chosen], value[chosen]


def _bucket(value: np.ndarray) -> np.ndarray:
    return (value & K.U64(BITS - 1)).astype(np.int64)


def _signed(value: np.ndarray) -> list[int]:
    return value.view(np.int64).tolist()


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, words, prints) of every window; the prints of an item are with its first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in K.slices(batch, "text"):
                    found = K.words(part.column("text"), K.ALNUM, fold=True)
                    hashes, ids = found.hashes(), part.column("item_id").to_pylist()
                    at, value = fingerprints(hashes, found.first)
                    rows = []
                    for d, n in enumerate(found.count.tolist()):
                        a = int(found.first[d])
                        texts = [found.text(i) for i in range(a, a + n)]
                        if n >= SPAN:
                            inside = _signed(value[(at >= a) & (at < a + n)])
                            rows += [(ids[d], SPAN, " ".join(texts[i : i + SPAN]), inside if not i else []) for i in range(n - SPAN + 1)]
                        elif n:
                            _, whole = K.grams(hashes[a : a + n], np.array([0, n]), n)
                            rows.append((ids[d], n, " ".join(texts), _signed(whole)))
                    if rows:
                        item, size, text, prints = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(size, pa.int32()), pa.array(text), pa.array(prints, pa.list_(pa.int64()))], ["item_id", "size", "words", "prints"])

    source = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    return source.mapInArrow(run, "item_id long, size int, words string, prints array<long>")


def bitmaps(prints: DataFrame) -> dict[int, bytes]:
    """Per window length, a bitmap of its fingerprints (size, print): BITS bits each, gathered in pieces of 2^15."""
    place = F.col("print").bitwiseAND(F.lit(BITS - 1)) + 1
    pieces = prints.groupBy("size", F.bitmap_bucket_number(place).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out: dict[int, bytearray] = {}
    for row in pieces.collect():
        whole = out.setdefault(row["size"], bytearray(BITS // 8))
        at = (row["piece"] - 1) * (1 << 12)
        whole[at : at + len(row["bits"])] = row["bits"]
    return {size: bytes(bits) for size, bits in out.items()}


def document_prints(docs: DataFrame, maps: dict[int, bytes]) -> DataFrame:
    """(doc_id, digest, n_words, size, start, print): a bare row of each document, and its fingerprints that the bitmaps let pass."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        held = {size: np.frombuffer(bits, np.uint8) for size, bits in shared.value.items()}
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in K.slices(batch, "text"):
                    found = K.words(part.column("text"), K.ALNUM, fold=True)
                    hashes, first, row_of = found.hashes(), found.first, found.row()
                    starts, values, sizes = [np.zeros(0, np.int64)], [np.zeros(0, K.U64)], [np.zeros(0, np.int64)]
                    for size, bits in held.items():
                        at, value = fingerprints(hashes, first) if size == SPAN else K.grams(hashes, first, size)
                        bucket = _bucket(value)
                        may = (bits[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 > 0
                        starts.append(at[may])
                        values.append(value[may])
                        sizes.append(np.full(int(may.sum()), size))
                    start, none = np.concatenate(starts), [None] * part.num_rows
                    of = row_of[start]
                    row = pa.array(np.concatenate((np.arange(part.num_rows), of)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(row),
                            part.column("digest").take(row),
                            pa.array(found.count.astype(np.int64)).take(row),
                            pa.array(none + np.concatenate(sizes).tolist(), pa.int32()),
                            pa.array(none + (start - first[of]).tolist(), pa.int64()),
                            pa.array(none + _signed(np.concatenate(values)), pa.int64()),
                        ],
                        ["doc_id", "digest", "n_words", "size", "start", "print"],
                    )

    source = docs.select(F.col("doc_id").cast("long"), _digest(), "text")
    return source.mapInArrow(run, "doc_id long, digest binary, n_words long, size int, start long, print long")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def extended(texts: DataFrame) -> DataFrame:
    """(digest, size, start, words): the windows around each hit of (digest, text, hits), where hits are (size, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            for part in K.slices(batch, "text"):
                found = K.words(part.column("text"), K.ALNUM, fold=True)
                for d, hits in enumerate(part.column("hits").to_pylist()):
                    a, n = int(found.first[d]), int(found.count[d])
                    near = {(h["size"], h["start"]) for h in hits if h["size"] < SPAN}
                    for h in hits:
                        if h["size"] == SPAN:
                            near.update((SPAN, s) for s in range(max(h["start"] - WINDOW + 1, 0), min(h["start"], n - SPAN) + 1))
                    size, start = zip(*sorted(near), strict=True) if near else ((), ())
                    texts = [" ".join(found.text(i) for i in range(a + s, a + s + k)) for k, s in zip(size, start, strict=True)]
                    key = part.column("digest")[d]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(size), pa.binary()), pa.array(size, pa.int32()), pa.array(start, pa.int64()), pa.array(texts, pa.string())], ["digest", "size", "start", "words"])

    return texts.select("digest", "text", "hits").mapInArrow(run, "digest binary, size int, start long, words string")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def verdicts(docs: DataFrame, benchmark: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n_words) of each row of `docs`, and (digest, n_hit, items) of each distinct text that is hit."""
    windows = steps.write(benchmark_windows(benchmark))
    prints = windows.select("size", F.explode("prints").alias("print")).distinct()
    rows = steps.write(document_prints(docs, bitmaps(prints)))
    met = rows.where("size is not null").select("digest", "size", "start", "print").join(_small(prints), ["size", "print"], "left_semi")
    hits = steps.write(met.groupBy("digest").agg(F.collect_set(F.struct("size", "start")).alias("hits")))
    texts = docs.select(_digest(), "text").join(sent(hits.select("digest"), 500_000), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    listed = windows.groupBy("size", "words").agg(F.collect_set("item_id").alias("items"))
    found = extended(texts.join(hits, "digest")).join(_small(listed), ["size", "words"])
    found = found.groupBy("digest").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # Words under the union of the spans, which come by start.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["size"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0).cast("long"), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    hit = steps.write(found.select("digest", covered.alias("n_hit"), F.sort_array(F.transform("items", lambda x: x.cast("string"))).alias("items")))
    return rows.where("size is null").select("doc_id", "digest", "n_words"), hit


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, items (sorted item_ids as strings)."""
    rows, hit = verdicts(docs, benchmark, Steps(docs.sparkSession, "contaminated"))
    found = rows.join(sent(hit, 500_000), "digest", "left")
    return found.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that share no window with the benchmark, with all their columns."""
    _, hit = verdicts(docs, benchmark, Steps(docs.sparkSession, "contaminated"))
    own = spare(docs, "_hit")
    gone = sent(hit.select(F.col("digest").alias(own)), 500_000)
    return docs.join(gone, F.unhex(F.sha2("text", 256)) == F.col(own), "left_anti")
