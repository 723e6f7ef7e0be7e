"""Quality rules as a short-circuit cascade.

Each rule is a test on statistics of a text.  The cost of every statistic (its own seconds, without those of statistics that
it builds on) and the selectivity of every rule (share rejected) are estimated on about `SAMPLE_ROWS` rows, chosen by a
hash of their text and measured where they lie: only sums reach the driver.  The next rule is always the one with the most rejections for
the cost that it adds, since a statistic that an earlier rule computed costs nothing more.  Rejected documents are taken
out of what the next rules see as soon as they hold half of its bytes, so that all cutting anew costs as much as the first
pass at most.  The order changes the time only: a verdict is the conjunction of all rules, whatever their order.

Defined results: null and empty texts have no words and all counts 0, and fail the base rule; the
length of a text is not limited; repeated rows give repeated rows; an empty table gives an empty
result; other columns, whatever their names, are carried by `filter_documents` and not looked at.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import bound_batches

_CONTINUATION = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LINE = np.arange(256) != 0x0A
_DIGIT = (np.arange(256) >= 0x30) & (np.arange(256) <= 0x39)

#: Expected rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 2000


class Profile:
    """Statistics of a column of texts, each computed at its first use."""

    def __init__(self, column: pa.Array):
        self._column, self._kept = column, {}
        #: Own seconds of each statistic, and what the statistics inside the running one took.
        self._seconds, self._inner = {}, [0.0]

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._kept:
            self._inner.append(0.0)
            began = time.perf_counter()
            self._kept[name] = getattr(self, f"_{name}")()
            took = time.perf_counter() - began
            self._seconds[name] = took - self._inner.pop()
            self._inner[-1] += took
        return self._kept[name]

    def _words(self) -> K.Words:
        return K.words(self._column, K.SPACED, fold=False)

    def _count(self, mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return np.diff(total[self.words.offsets])

    def _n_words(self) -> np.ndarray:
        return self.words.count

    def _word_chars(self) -> np.ndarray:
        data = self.words.data
        return self._count(K.SPACED[data] & ~_CONTINUATION[data])

    def _n_chars(self) -> np.ndarray:
        return self._count(~_CONTINUATION[self.words.data])

    def _n_symbols(self) -> np.ndarray:
        return self._count(_SYMBOL[self.words.data])

    def _n_digits(self) -> np.ndarray:
        return self._count(_DIGIT[self.words.data])

    def _n_doubled(self) -> np.ndarray:
        """Words equal to the word before them."""
        value, row = self.words.hashes(), self.words.row()
        again = np.flatnonzero((value[1:] == value[:-1]) & (row[1:] == row[:-1])) + 1
        return np.bincount(row[again], minlength=len(self._column))

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every line that has a word."""
        lines = K.words(self._column, _LINE, fold=False)
        starts = self.words.start
        full = np.searchsorted(starts, lines.end) > np.searchsorted(starts, lines.start)
        return lines.row()[full], lines.hashes()[full]

    def _n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=len(self._column))

    def _n_dup_lines(self) -> np.ndarray:
        row, value = self.lines
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        again = np.flatnonzero((row[1:] == row[:-1]) & (value[1:] == value[:-1])) + 1
        return np.bincount(row[again], minlength=len(self._column))

    def _n_repeat_words(self) -> np.ndarray:
        size, first = 5, self.words.first
        at, value = K.grams(self.words.hashes(), first, size)
        row = self.words.row()[at]
        keyed = K.mix(value + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keyed)
        same = keyed[order][1:] == keyed[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(self.words.start) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + size, -1)
        covered = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:-1] > 0)))
        return np.diff(covered[first])


@dataclass(frozen=True)
class Rule:
    """A document is rejected where `rejects(profile)` is true."""

    name: str
    rejects: Callable[[Profile], np.ndarray]


#: The base rule that the query's contract fixes.
BASE = (
    Rule("too_few_words", lambda p: p.n_words < 10),
    Rule("repeated_windows", lambda p: 100 * p.n_repeat_words > 20 * p.n_words),
)
#: The method's own rules: they reject texts that no prose looks like.
VERDICT = (
    Rule("symbol_words", lambda p: 10 * p.n_symbols > 3 * p.n_words),
    Rule("word_length", lambda p: (p.word_chars < 2 * p.n_words) | (p.word_chars > 25 * p.n_words)),
    Rule("digit_share", lambda p: 10 * p.n_digits > 6 * p.word_chars),
    Rule("doubled_words", lambda p: 10 * p.n_doubled > 3 * p.n_words),
    Rule("repeated_lines", lambda p: (p.n_lines >= 4) & (10 * p.n_dup_lines > 4 * p.n_lines)),
)


@dataclass(frozen=True)
class Cost:
    """What a sample tells of a rule: rows seen and rejected, and the seconds of each statistic that it uses."""

    rows: int
    rejected: int
    seconds: dict[str, float]


def measure(column: pa.Array, rules: tuple[Rule, ...]) -> list[tuple[str, str, float, int, int]]:
    """(rule, statistic, seconds, rejected, rows) of each rule on its own and each statistic that it uses; `test` is the rule's own."""
    out = []
    for rule in rules:
        profile = Profile(column)
        began = time.perf_counter()
        rejected = int(np.count_nonzero(rule.rejects(profile)))
        spent = {**profile._seconds, "test": time.perf_counter() - began - sum(profile._seconds.values())}
        out += [(rule.name, name, seconds, rejected, len(column)) for name, seconds in spent.items()]
    return out


def plan(costs: dict[str, Cost]) -> list[str]:
    """Rule names, each time the one with the most rejections a second that it adds; ties by name."""
    left, known, order = dict(costs), set(), []
    while left:

        def gain(name: str) -> float:
            cost = left[name]
            added = sum(s for statistic, s in cost.seconds.items() if statistic == "test" or statistic not in known)
            return cost.rejected / max(cost.rows, 1) / max(added, 1e-9)

        best = min(left, key=lambda name: (-gain(name), name))
        known.update(left.pop(best).seconds)
        order.append(best)
    return order


def passes(column: pa.Array, rules: list[Rule]) -> np.ndarray:
    """Rows that no rule rejects."""
    out = np.zeros(len(column), bool)
    left, alive = np.arange(len(column)), np.ones(len(column), bool)
    profile, size = Profile(column), np.diff(K.utf8(column)[1])
    for rule in rules:
        if not alive.any():
            break
        if not alive.all() and 2 * int(size[alive].sum()) <= int(size.sum()):
            left, size, column = left[alive], size[alive], column.take(pa.array(np.flatnonzero(alive)))
            profile, alive = Profile(column), np.ones(len(left), bool)
        alive &= ~rule.rejects(profile)
    out[left[alive]] = True
    return out


def ordered(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order that the sample's estimates give."""
    bound_batches(docs.sparkSession)
    total = max(docs.count(), 1)
    parts = 1 << 20
    chosen = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(parts)) < min(parts, -(-sample_rows * parts // total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            for part in K.slices(batch, "text"):
                columns = zip(*measure(part.column("text"), rules), strict=True)
                kinds = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rule", "statistic", "seconds", "rejected", "n_rows"])

    found = chosen.mapInArrow(run, "rule string, statistic string, seconds double, rejected long, n_rows long")
    sums = found.groupBy("rule", "statistic").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"), F.sum("n_rows").alias("n_rows")).collect()
    costs = {rule.name: Cost(0, 0, {}) for rule in rules}
    for r in sums:
        costs[r["rule"]] = Cost(r["n_rows"], r["rejected"], {**costs[r["rule"]].seconds, r["statistic"]: r["seconds"]})
    place = {name: k for k, name in enumerate(plan(costs))}
    return sorted(rules, key=lambda rule: place[rule.name])


def assess(docs: DataFrame, verdict: tuple[Rule, ...] = VERDICT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of `docs`: doc_id, the base counts, base_failed and kept."""
    cascade = ordered(docs, verdict, sample_rows=sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            for part in K.slices(batch, "text"):
                text = part.column("text")
                p = Profile(text)
                failed = np.logical_or.reduce([rule.rejects(p) for rule in BASE])
                kept = np.zeros(len(text), bool)
                rest = np.flatnonzero(~failed)
                kept[rest] = passes(text.take(pa.array(rest)), cascade)
                counts = [p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words]
                columns = [part.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = BASE + VERDICT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs` that every rule keeps, with all their columns."""
    cascade = ordered(docs, rules, sample_rows=sample_rows)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            named = pa.RecordBatch.from_arrays([batch.column(place)], ["text"])
            at = 0
            for part in K.slices(named, "text"):
                keep = passes(part.column("text"), cascade)
                yield batch.slice(at, part.num_rows).filter(pa.array(keep))
                at += part.num_rows

    return docs.mapInArrow(run, docs.schema)
