"""Near-duplicate classes by a chosen-path set similarity join.

A document is the set of its 5-word shingles.  Two documents are linked when their Jaccard
similarity is at least `threshold` per cent; classes are the connected components of the links.

* Equal sets are one *class* from the start, by a digest of the whole set, so exact copies cost one
  partial aggregation and never form pairs.
* `TREES` independent trees branch the classes: a node picks one or two of `COORDINATES` minwise
  values (4/3 on average, the reciprocal of the similarity) by its own seed and sends each class to
  the child of each picked value.  A pair of similarity 0.75 shares a node of one tree with
  probability 0.81 at depth one, 0.69 at depth two and 0.53 at depth four; over 12 trees it is missed with
  probability 2e-9, 8e-7 and 1e-4.  Most nodes end at depth one.
* Nodes are dealt into blocks of about `LEAF` classes (never one task for a node), whose most similar pairs
  link a node up at linear cost.  A node whose classes beside its largest component fill at most `GRID` blocks is
  then compared exhaustively, block by block; a larger one is branched again.
* In a block, sketches of 128 values drop pairs estimated under 0.60 (four standard deviations at
  0.75), and set sizes those that no overlap could link.  A block first proposes a maximum spanning forest of the
  others, whose edges are confirmed on the full sets: one a class and block at most.  Small nodes that still have
  such a pair between two components then give those pairs where there are no more of them than classes; where there
  are more, the classes bring their full sets to the block, where every pair is counted exactly.  A pair that meets in
  several nodes of a level is looked at in the first of them only.  So a step gives at most a row for each class and
  block, a class of a node is in at most GRID blocks or one for each SIDE members, and no pair that the sketches allow goes unconfirmed.
* Blocks are bounded by the sizes of their sets as well as by their number, so that long texts do not meet in a task.
* Components are grown by distributed minimum labels with pointer jumping.

No task sees more than a block, and nothing about documents reaches the driver but row counts.

Defined results: null, empty and wordless texts have no shingles, are linked with nothing and kept;
fewer than five words are one shingle; rows that repeat a doc_id are one document that has the links
of each of its texts, and each row gets a result; ties go to the smallest doc_id; an empty table
gives an empty result; a row with a null doc_id is linked with nothing, has component null, and is kept; columns other
than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import Steps, sent, spare

SHINGLE = 5
THRESHOLD = 75
COORDINATES = 128
TREES = 12
LEAF = 256
#: Classes of one side of a block that is compared exhaustively, and shingles of them all together (8 MB of full sets).
SIDE = 1024
WEIGHT = 1 << 20
#: A node whose classes beside its largest component are dealt into at most so many groups is compared exhaustively.
GRID = 4
#: Pairs estimated below this many of 128 equal values are not confirmed.
NEAR = 77

_SEEDS = K.mix(np.arange(1, COORDINATES + 1, dtype=K.U64) * K.U64(0x9E3779B97F4A7C15)) | K.U64(1)


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    found = K.words(column, K.SPACED, fold=True)
    hashes = found.hashes()
    at, value = K.grams(hashes, found.first, size)
    cut = np.searchsorted(at, found.first)
    for d, n in enumerate(found.count.tolist()):
        if n >= size:
            yield np.unique(value[cut[d] : cut[d + 1]])
        elif n:
            whole = hashes[found.first[d] : found.first[d] + n]
            joined = K.U64(n)
            for x in whole:
                joined = joined * K._STEP + x
            yield K.mix(np.array([joined], K.U64))
        else:
            yield np.zeros(0, K.U64)


def _sketch(values: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, ~K.U64(0))
    for at in range(0, len(values), 2048):
        np.minimum(low, (_SEEDS[:, None] * values[None, at : at + 2048]).min(axis=1), out=low)
    return (low >> K.U64(32)).astype("<u4")


def profiles(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, and its minwise values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in K.slices(batch, "text"):
                    rows = []
                    for values in _sets(part.column("text"), size):
                        one, two = K.mix(values), K.mix(values ^ K.U64(0xA5A5A5A55A5A5A5A))
                        digest = np.array([one.sum(dtype=K.U64), two.sum(dtype=K.U64) + K.U64(len(values))])
                        rows.append((len(values), *digest.astype(np.int64).tolist(), _sketch(values).tobytes() if len(values) else None))
                    n, a, b, s = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.binary())],
                        ["doc_id", "n_shingles", "digest_a", "digest_b", "sketch"],
                    )

    schema = "doc_id long, n_shingles long, digest_a long, digest_b long, sketch binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _children(node: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of each pick of each row: node k of values[k]; the node alone decides the picks."""
    seed = K.mix(node)
    first = (seed >> K.U64(8)) % K.U64(COORDINATES)
    other = (first + K.U64(1) + (seed >> K.U64(24)) % K.U64(COORDINATES - 1)) % K.U64(COORDINATES)
    two = np.flatnonzero((seed >> K.U64(40)) % K.U64(3) == 0)
    row = np.concatenate((np.arange(len(node)), two))
    pick = np.concatenate((first, other[two])).astype(np.int64)
    child = K.mix(node[row] ^ K.mix((values[row, pick].astype(K.U64) << K.U64(8)) | pick.astype(K.U64)))
    return row, child


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), COORDINATES)


def _expand(members: DataFrame) -> DataFrame:
    """One level down: (id, size, nodes, sketch) to (node, id, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column("nodes")
                which = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                nodes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(K.U64)
                row, child = _children(nodes, _matrix(part.column("sketch"))[which])
                of = pa.array(which[row])
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), part.column("id").take(of), part.column("size").take(of)], ["node", "id", "size"])

    return members.select("id", "size", "nodes", "sketch").mapInArrow(run, "node long, id long, size long")


def _by_block(blocks: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """`work(table)` on the rows of each block of more than one row; blocks are small by construction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        held: pa.Table | None = None
        found: list[pa.RecordBatch] = []

        def each(table: pa.Table, edges: np.ndarray) -> None:
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a > 1 and (out := work(table.slice(a, b - a))) is not None:
                    found.append(out)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            block = table["block"].to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1))
            each(table, edges)
            held = table.slice(int(edges[-1]))
            yield from found
            found.clear()
        if held is not None:
            each(held, np.array([0, held.num_rows]))
        yield from found
        held = None
        K.release()

    together = blocks.select("block", *columns).repartition("block").sortWithinPartitions("block")
    return together.mapInArrow(run, schema)


def _forest(left: np.ndarray, right: np.ndarray, labels: np.ndarray, order: np.ndarray) -> list[int]:
    """The edges, in the given order, that connect what was not connected."""
    root = {x: x for x in labels.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    taken = []
    for e in order.tolist():
        a, b = find(int(labels[left[e]])), find(int(labels[right[e]]))
        if a != b:
            root[max(a, b)] = min(a, b)
            taken.append(e)
    return taken


def _near(table: pa.Table, threshold: int) -> tuple[np.ndarray, ...]:
    """Pairs (i, j, agreeing values) of a block that differ in label and that sketches and sizes allow.

    With columns `side` and `home`, only those of different sides, or of any in a block that is their home.
    """
    labels, sizes = table["label"].to_numpy(), table["size"].to_numpy()
    short = np.frombuffer(b"".join(table["short"].to_pylist()), np.uint8).reshape(len(labels), COORDINATES)
    side = None
    if "side" in table.column_names and not table["home"][0].as_py():
        side = table["side"].to_numpy()
    left, right, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(labels) - 1):
        apart = labels[i + 1 :] != labels[i]
        if side is not None:
            apart &= side[i + 1 :] != side[i]
        apart &= (100 * sizes[i + 1 :] >= threshold * sizes[i]) & (100 * sizes[i] >= threshold * sizes[i + 1 :])
        others = np.flatnonzero(apart) + i + 1
        if not len(others):
            continue
        agree = (short[others] == short[i]).sum(axis=1)
        keep = agree >= NEAR
        if keep.any():
            j = others[keep]
            left.append(np.full(len(j), i))
            right.append(j)
            score.append(agree[keep])
    return np.concatenate(left), np.concatenate(right), np.concatenate(score)


def _met_before(table: pa.Table, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs share a node of `nodes` that comes before the block's own."""
    node, lists = table["node"][0].as_py(), table["nodes"].combine_chunks()
    count = np.diff(lists.offsets.to_numpy())
    within = np.arange(len(count))[:, None], np.arange(max(int(count.max()), 1))[None]
    # Every list is padded by the block's own node, which comes before nothing.
    held = np.full((len(count), within[1].shape[1]), node, np.int64)
    held[within[1] < count[:, None]] = lists.flatten().to_numpy()
    out = np.zeros(len(left), bool)
    for at in range(0, len(left), 4096):
        a, b = held[left[at : at + 4096]], held[right[at : at + 4096]]
        out[at : at + 4096] = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] < node)).any(axis=(1, 2))
    return out


def _links(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch | None:
    if not len(left):
        return None
    a, b = np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _propose(blocks: DataFrame, threshold: int) -> DataFrame:
    """(a, b): a maximum spanning forest of each block's near pairs, by agreeing values."""

    def work(table: pa.Table) -> pa.RecordBatch | None:
        left, right, score = _near(table, threshold)
        taken = _forest(left, right, table["label"].to_numpy(), np.argsort(-score, kind="stable"))
        return _links(table["id"].to_numpy(), left[taken], right[taken])

    return _by_block(blocks, ["id", "label", "size", "short"], work, "a long, b long")


def _doubtful(blocks: DataFrame, threshold: int) -> DataFrame:
    """(block, id, label, other) of what is still to be compared exactly.

    A block with no more near pairs than rows in them gives the pairs (id, other); one with more gives its rows, with
    other null.
    """

    def work(table: pa.Table) -> pa.RecordBatch | None:
        left, right, _ = _near(table, threshold)
        if len(left):
            first = ~_met_before(table, left, right)
            left, right = left[first], right[first]
        rows = np.union1d(left, right)
        if not len(rows):
            return None
        ids = table["id"].to_numpy()
        if len(left) <= len(rows):
            a, b = np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])
            block, label, other = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), pa.array(b)
        else:
            a, other = ids[rows], pa.nulls(len(rows), pa.int64())
            block, label = table["block"].to_numpy()[rows], table["label"].to_numpy()[rows]
        return pa.RecordBatch.from_arrays([pa.array(block), pa.array(a), pa.array(label), other], ["block", "id", "label", "other"])

    return _by_block(blocks, ["id", "label", "size", "short", "node", "nodes", "side", "home"], work, "block long, id long, label long, other long")


def _exact(blocks: DataFrame, threshold: int) -> DataFrame:
    """(a, b): a spanning forest of each block's links, by the full sets in `items`."""

    def work(table: pa.Table) -> pa.RecordBatch | None:
        sets = [np.frombuffer(x.as_buffer(), K.U64) for x in table["items"]]
        size = np.array([len(x) for x in sets])
        _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        many = count[place] > 1
        column = np.cumsum(count > 1)[place[many]] - 1
        owner = owner[many]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = 2048
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [at, at + width])
            dense = np.zeros((len(sets), width), np.float32)
            dense[owner[a:b], column[a:b] - at] = 1
            shared += dense @ dense.T
        labels = table["label"].to_numpy()
        linked = 100 * shared >= threshold * (size[:, None] + size[None] - shared)
        left, right = np.nonzero(np.triu(linked, 1) & (labels[:, None] != labels[None]))
        taken = _forest(left, right, labels, np.arange(len(left)))
        return _links(table["id"].to_numpy(), left[taken], right[taken])

    return _by_block(blocks, ["id", "label", "items"], work, "a long, b long")


def _parts(n: str, weight: str) -> Column:
    """Into how many parts so many classes with so many shingles are dealt."""
    return F.least(F.ceil(F.greatest(F.col(n) / SIDE, F.col(weight) / WEIGHT)), F.col(n)).cast("long")


def _grid(nodes: DataFrame) -> DataFrame:
    """(block, node, id, label, side, home): blocks of about 2 * SIDE rows in which all classes of a node with different labels meet.

    The members of the largest component are dealt into slices, the others into at most GRID groups; every group
    meets every slice and every other group.  A row is copied GRID times, or once a slice and group.  Members of one group (one
    `side`) are compared in the block with the first slice only, which is their `home`.
    """
    slots, groups = F.col("slots"), F.col("groups")
    zero, deal = F.lit(0).cast("long"), F.xxhash64("id", "node")
    main = F.col("label") == F.col("main")
    slot, group = F.pmod(deal, slots), F.pmod(deal, groups)
    place = lambda x, y, kind: F.struct(x.alias("x"), y.alias("y"), F.lit(kind).alias("kind"))
    of_main = F.transform(F.sequence(zero, groups - 1), lambda g: place(slot, g, 0))
    of_slots = F.transform(F.sequence(zero, slots - 1), lambda s: place(s, group, 0))
    of_groups = F.transform(F.filter(F.sequence(zero, groups - 1), lambda g: g != group), lambda g: place(F.least(g, group), F.greatest(g, group), 1))
    places = F.when(main, of_main).otherwise(F.concat(of_slots, of_groups))
    side = F.when(main, F.lit(-1).cast("long")).otherwise(group)
    rows = nodes.select("node", "id", "label", side.alias("side"), F.explode(places).alias("p"))
    home = (F.col("p.kind") == 0) & (F.col("p.x") == 0)
    return rows.select(F.xxhash64("node", "p.x", "p.y", "p.kind").alias("block"), "node", "id", "label", "side", home.alias("home"))


def _ends(pairs: DataFrame, steps: Steps) -> DataFrame:
    """The ids in pairs (a, b), written: they are read for their number and by both sides of a join."""
    return steps.write(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())


def _items(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(id, items): the full shingle sets of the documents whose id is in `needed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in K.slices(batch, "text"):
                    found = [x.tobytes() for x in _sets(part.column("text"), size)]
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.binary())], ["id", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(sent(needed), "id", "left_semi")
    return texts.mapInArrow(run, "id long, items binary")


def _confirm(pairs: DataFrame, items: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) with 100 * |A and B| >= threshold * |A or B| on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), K.U64), np.frombuffer(y.as_buffer(), K.U64)
                shared = 0
                if min(len(one), len(two)) * 100 >= threshold * max(len(one), len(two)):
                    if len(one) > len(two):
                        one, two = two, one
                    at = np.minimum(np.searchsorted(two, one), len(two) - 1)
                    shared = int(np.count_nonzero(two[at] == one))
                keep.append(100 * shared >= threshold * (len(one) + len(two) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(items.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a")
    both = both.join(items.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b")
    return both.select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, steps: Steps) -> DataFrame:
    """(id, label) of every id in `links` (a, b): the smallest id that it reaches."""
    edges = steps.write(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    labels = steps.write(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id", "left").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        after = steps.write(lower.join(jump, "label", "left").select("id", "was", F.least("label", "far").alias("label")))
        changed = after.where("label < was").limit(1).count()
        steps.drop(labels)
        labels = after
        if not changed:
            steps.drop(edges)
            out = after.select("id", "label")
            out._written_to = after._written_to
            return out


def _merge(labels: DataFrame, links: DataFrame, steps: Steps) -> DataFrame:
    """Labels after more links; labels hold ids that have a link only."""
    if not links.limit(1).count():
        return labels
    one, two = (labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    named = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    top = components(named, steps)
    high = top.select(F.col("id").alias("label"), F.col("label").alias("up"))
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    every = labels.join(ends, "id", "full").select("id", F.coalesce("label", "id").alias("label"))
    out = steps.write(every.join(high, "label", "left").select("id", F.coalesce("up", "label").alias("label")))
    steps.drop(labels, top)
    steps.release()
    return out


def _ties(profile: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): the id of each class of a doc_id that has several sets, and the doc_id."""
    digest = F.struct("digest_a", "digest_b")
    rows = profile.where("n_shingles > 0 and doc_id is not null").select("doc_id", "digest_a", "digest_b")
    several = rows.groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).where("low <> high").select("doc_id")
    tied = rows.join(several, "doc_id", "left_semi").distinct().join(classes, ["digest_a", "digest_b"])
    return tied.select(F.col("id").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, trees: int = TREES) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    steps = Steps(spark, "neardup")
    profile = steps.write(profiles(docs, size))
    # One row a class: its smallest doc_id and that document's minwise values, which the whole class shares.
    first = profile.where("n_shingles > 0 and doc_id is not null").groupBy("digest_a", "digest_b")
    reps = steps.write(first.agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("size"), F.min("sketch").alias("sketch")))
    classes = reps.select("digest_a", "digest_b", "id")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            short = (_matrix(batch.column("sketch")) & 0xFF).astype(np.uint8) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("size"), pa.array([x.tobytes() for x in short], pa.binary())], ["id", "size", "short"])

    shorts = reps.select("id", "size", "sketch").mapInArrow(shorten, "id long, size long, short binary")
    roots = np.arange(1, trees + 1, dtype=K.U64) * K.U64(0xC2B2AE3D27D4EB4F)
    root_list = F.array(*[F.lit(int(x)) for x in K.mix(roots).view(np.int64)])
    # A doc_id with several texts ties their classes from the start, so they stay one document.
    labels = steps.write(spark.createDataFrame([], "id long, label long"))
    labels = _merge(labels, steps.write(_ties(profile, classes)), steps)
    with_label = lambda rows: rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    members = steps.write(_expand(reps.select("id", "size", root_list.alias("nodes"), "sketch")))
    # Ends: members of a node that never part agree in all minwise values, and are linked at once.
    while True:
        # Written, so that the join below has plain inputs and adaptive execution can split a large node's rows.
        counts = steps.write(members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        # Only ids that share a node go on; most nodes hold one.
        shared = steps.write(members.join(counts, "node"))
        steps.drop(members)
        deal = F.pmod(F.xxhash64("node", "id"), F.ceil(F.col("n") / LEAF))
        blocks = with_label(shared.select(F.xxhash64("node", deal).alias("block"), "id"))
        pairs = steps.write(_propose(blocks.join(shorts, "id"), threshold).distinct())
        if pairs.limit(1).count():
            ends = _ends(pairs, steps)
            links = steps.write(_confirm(pairs, _items(docs, ends, size), threshold))
            labels = _merge(labels, links, steps)
            steps.drop(links, ends)
        # Nodes that are one component need no more work.
        labelled = with_label(shared.drop("n"))
        parts = labelled.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"))
        tops = parts.groupBy("node").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max(F.struct("n", "label", "weight")).alias("top"), F.count(F.lit(1)).alias("parts"))
        tops = tops.where("parts > 1").select("node", F.col("top.label").alias("main"), F.col("top.n").alias("n"), F.col("top.weight").alias("weight"), (F.col("n") - F.col("top.n")).alias("rest"), (F.col("weight") - F.col("top.weight")).alias("rest_weight"))
        tops = steps.write(tops.select("node", "main", _parts("n", "weight").alias("slots"), _parts("rest", "rest_weight").alias("groups")))
        left = steps.write(labelled.join(tops, "node"))
        steps.drop(shared)
        small, large = left.where(F.col("groups") <= GRID), left.where(F.col("groups") > GRID)
        nodes = small.groupBy("id").agg(F.collect_list("node").alias("nodes"))
        doubtful = steps.write(_doubtful(_grid(small).join(shorts.join(nodes, "id"), "id"), threshold))
        if doubtful.limit(1).count():
            single = doubtful.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
            single = steps.write(single.join(pairs, ["a", "b"], "left_anti"))
            dense = doubtful.where("other is null").drop("other")
            ends = _ends(single, steps)
            whole = steps.write(dense.select("id").distinct())
            by_pair = _confirm(single, _items(docs, ends, size), threshold)
            by_block = _exact(dense.join(_items(docs, whole, size), "id"), threshold)
            links = steps.write(by_pair.unionByName(by_block))
            labels = _merge(labels, links, steps)
            steps.drop(links, single, ends, whole)
        steps.drop(pairs)
        deeper = large.groupBy("id").agg(F.min("size").alias("size"), F.collect_set("node").alias("nodes")).join(reps.select("id", "sketch"), "id")
        members = steps.write(_expand(deeper))
        steps.drop(left, doubtful, counts, tops)
        if not members.limit(1).count():
            break
        del counts, shared, blocks, pairs, labelled, parts, tops, left, small, large, nodes, doubtful, deeper
        steps.release()
    component = F.coalesce("label", "id")
    named = classes.join(labels, "id", "left").select("digest_a", "digest_b", component.alias("component"))
    out = profile.select("doc_id", "n_shingles", "digest_a", "digest_b").join(named, ["digest_a", "digest_b"], "left")
    identity = F.col("doc_id")
    out = out.withColumn("component_id", F.when((F.col("n_shingles") > 0) & identity.isNotNull(), F.col("component")).otherwise(identity))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(identity == F.col("component_id"), F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its class, one each, with all their columns.

    Only ids are joined with the rows: the texts are shuffled once at most, and not at all while the ids
    that go are few.  Of rows that repeat a doc_id that with the smallest text stays, then with the smallest other columns (as JSON).
    """
    found = Steps(docs.sparkSession, "kept").write(near_duplicates(docs, size, threshold)).where("doc_id is not null")
    own = spare(docs, "_id")
    ids = found.groupBy(F.col("doc_id").alias(own)).agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    identity = F.col("doc_id").cast("long") == F.col(own)
    once = docs.join(sent(ids.where("not kept or n > 1").select(own)), identity, "left_anti")
    again = docs.join(sent(ids.where("kept and n > 1").select(own)), identity, "left_semi")
    least = F.min_by(F.struct(*docs.columns), F.struct("text", F.to_json(F.struct(*docs.columns))))
    return once.unionByName(again.groupBy(F.col("doc_id").cast("long").alias(own)).agg(least.alias("row")).select("row.*"))
