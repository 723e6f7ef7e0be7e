"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (1 to 4 bytes of the lower-cased text, digits and
punctuation folded to one separator).  Embeddings and the softmax layer are trained by stochastic gradient descent in
numpy on a bounded sample of labelled documents; a part of it that training does not see sets the
temperature, and the score below which a prediction is marked rejected.

Because the layer behind the mean is linear, prediction needs one table of bucket times class: the scores of a text are
the mean of its n-grams' rows.  It reads every byte of every text.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected; ties go to the
language that sorts first; there is no limit on length; repeated rows give repeated rows; an empty table gives an empty result;
without labelled rows every text is `und`; only text (and, for training, lang) is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import bound_batches

#: Most labelled documents that are drawn for training, calibration included.
SAMPLE_ROWS = 2400
BUCKETS = 1 << 16
WIDTH = 16
ORDERS = (1, 2, 3, 4)
#: Share of the sample's texts, and of their accuracy when accepted, for calibration.
CALIBRATION = 0.2
ACCEPTED_ACCURACY = 0.99

_FOLD = K.LOWER.copy()
_FOLD[:128][~K.ALNUM[K.LOWER[:128]]] = 0x20
_FOLD[0x30:0x3A] = 0x20
_LETTER = ((np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)) | ((np.arange(256) >= 0x61) & (np.arange(256) <= 0x7A))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    floor: float


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: (bucket of each n-gram, offsets of the rows among them)."""
    folded = _FOLD[data].astype(np.uint32)
    code = np.zeros(len(data), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        shifted = folded if n == 1 else np.concatenate((np.zeros(n - 1, np.uint32), folded[: len(folded) - n + 1]))
        code = code * np.uint32(0x01000193) + shifted[: len(data)] + np.uint32(n)
        if n not in ORDERS:
            continue
        # The n-gram that ends at a byte counts from the n-th byte of its row on.
        size = np.diff(offsets)
        keep = np.maximum(size - (n - 1), 0)
        first = np.concatenate(([0], np.cumsum(keep)))
        inside = np.arange(first[-1]) - np.repeat(first[:-1], keep) + np.repeat(offsets[:-1] + (n - 1), keep)
        value = code[inside]
        value = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        yield (value >> np.uint32(16)).astype(np.int64) % BUCKETS, first


def _scores(column: pa.Array, model: Model) -> np.ndarray:
    data, offsets = K.utf8(column)
    total = np.zeros((len(column), len(model.languages)))
    count = np.zeros(len(column))
    for bucket, first in _grams(data, offsets):
        full = np.flatnonzero(np.diff(first) > 0)
        count += np.diff(first)
        if len(full):
            for k in range(len(model.languages)):
                total[full, k] += np.add.reduceat(model.table[k][bucket], first[full], dtype=np.float64)
    return total / np.maximum(count, 1)[:, None] + model.bias


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], languages: list[str], epochs: int = 6, rate: float = 4.0, seed: int = 7) -> Model:
    """Fit on (text, language) pairs; the last CALIBRATION of a shuffle calibrates."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    empty = Model(names, np.zeros((len(names), BUCKETS), np.float32), bias, 1.0, 0.0)
    if not texts:
        return empty
    order = rng.permutation(len(texts))
    held = order[len(order) - int(CALIBRATION * len(order)) :]
    fitted = order[: len(order) - len(held)]
    bags = {}
    for i in fitted.tolist():
        data, offsets = K.utf8(pa.array([texts[i]], pa.large_string()))
        found = np.concatenate([b for b, _ in _grams(data, offsets)])
        if len(found):
            bucket, n = np.unique(found, return_counts=True)
            bags[i] = bucket, (n / len(found)).astype(np.float32)
    target = {n: k for k, n in enumerate(names)}
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(np.array(list(bags), np.int64)).tolist():
            bucket, share = bags[i]
            mean = share @ embedding[bucket]
            error = _softmax((mean @ layer + bias)[None])[0]
            error[target[languages[i]]] -= 1
            back = layer @ error
            layer -= step * np.outer(mean, error)
            bias -= 0.01 * step * error
            embedding[bucket] -= step * share[:, None] * back[None]
    model = Model(names, np.ascontiguousarray((embedding @ layer).T), bias, 1.0, 0.0)
    held = [i for i in held.tolist() if texts[i]]
    if held:
        raw = _scores(pa.array([texts[i] for i in held], pa.large_string()), model)
        truth = np.array([target[languages[i]] for i in held])
        grid, rows = np.geomspace(0.05, 20, 60), np.arange(len(held))
        likely = [-np.log(np.maximum(_softmax(raw / t)[rows, truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(likely))])
        chance = _softmax(raw / model.temperature)
        score, right = chance.max(axis=1), chance.argmax(axis=1) == truth
        ranked = np.argsort(-score, kind="stable")
        good = np.flatnonzero(np.cumsum(right[ranked]) / np.arange(1, len(held) + 1) >= ACCEPTED_ACCURACY)
        model.floor = float(score[ranked[good[-1]]]) if len(good) else 1.0
    return model


def sample(docs: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """At most `rows` texts and languages, as many of each language as it has, in an order that a hash fixes."""
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    each = max(1, rows // len(counts))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    bound = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1 << 30, (each << 30) // n))]), F.col("lang"))
    drawn = labelled.where(draw < bound).select("text", "lang").limit(2 * rows).collect()
    drawn = sorted((r["text"], r["lang"]) for r in drawn)
    return [t for t, _ in drawn], [lang for _, lang in drawn]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, score and rejected."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(names)
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        model = shared.value
        for batch in batches:
            named = pa.RecordBatch.from_arrays([batch.column(place)], ["text"])
            at = 0
            for part in K.slices(named, "text"):
                text = part.column(0)
                data, offsets = K.utf8(text)
                total = np.concatenate(([0], np.cumsum(_LETTER[data], dtype=np.int64)))
                lettered = np.diff(total[offsets]) > 0
                for i in np.flatnonzero(~lettered).tolist():
                    lettered[i] = any(map(str.isalpha, text[i].as_py() or ""))
                if model.languages:
                    chance = _softmax(_scores(text, model) / model.temperature)
                    best, score = chance.argmax(axis=1), np.where(lettered, chance.max(axis=1), 0.0)
                    found = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                else:
                    score, found = np.zeros(part.num_rows), ["und"] * part.num_rows
                rest = batch.slice(at, part.num_rows)
                columns = [*rest.columns, pa.array(found), pa.array(score), pa.array((score < model.floor) | ~lettered)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score", "rejected"])
                at += part.num_rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
