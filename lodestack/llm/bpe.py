"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one last token with which the encoding of that
prefix ends.  `Vocabulary.tails` stores it per prefix: the last token of prefix i is the token t that
ends there and is *compatible* with the last token of the prefix before t, that is, merging the bytes
of both never joins across their border.  Compatibility is decided by undoing merges on either side
of the border, latest first, and is remembered per pair.

Because a prefix's entry depends on shorter prefixes only, appending bytes adds entries and changes
none, and after an edit the entries before it stay and the ones behind it are computed only until the
table agrees with the old one over the length of the longest token (`Encoded.append`, `Encoded.edit`).

Texts are cut by the tokenizer's pattern first; each match is encoded by itself.  Short matches are
remembered in a table of bounded size, since a corpus repeats them.

Defined results: a null text is empty; an empty text has no ids and decodes to no bytes; there are no
special tokens, their spellings are ordinary text; there is no limit on length; repeated rows give
repeated rows; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import bound_batches

#: Entries of each of the two generations of matches, and of the pairs, that a worker remembers unless told otherwise.
MEMORY = 300_000
#: Bytes that one lookup covers when the tokens that end at a byte are sought.
STEM = 3


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Vocabulary:
    """Ranks, the merge that made each token, and compatibility of neighbours."""

    def __init__(self, ranks: dict[bytes, int], memory: int = MEMORY):
        self.ranks, self.memory = ranks, memory
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.merge: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._trie: dict[int, dict] = {}
        self._stems: dict[bytes, tuple[list[tuple[int, int]], dict | None]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            # Encoding the token's bytes with the ranks below it leaves the two parts of its merge.
            parts = self._merge_below(token, rank)
            if len(parts) == 2:
                self.halves[rank] = (parts[0], parts[1])
                self.merge[parts[0], parts[1]] = rank
            node = self._trie
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = rank

    def _merge_below(self, token: bytes, limit: int) -> list[int]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            options = [(self.ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1)]
            rank, i = min(options)
            if rank >= limit:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _border_holds(self, left: int, right: int) -> bool:
        """Whether `left` and `right` stand side by side in the encoding of their joint bytes."""
        # Steps back in time: undo whichever of the two tokens was merged later, and ask each time
        # whether the parts now at the border would have been merged before what was undone.
        undone = 1 << 62
        while True:
            joined = self.merge.get((left, right))
            if joined is not None and joined < undone:
                return False
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                return True
            # Of equal ranks the left one was merged first, so the right one is undone first, and a
            # merge across the border of that very rank would have come before it.
            if b is None or (a is not None and left > right):
                undone, left = left, a[1]
            else:
                undone, right = right + 1, b[0]

    def _stem(self, stem: bytes) -> tuple[list[tuple[int, int]], dict | None]:
        """The tokens that end like `stem` and fit in it, the longest first, and where longer ones go on."""
        node, ends = self._trie, []
        for back, byte in enumerate(reversed(stem), 1):
            node = node.get(byte)
            if node is None:
                break
            if -1 in node:
                ends.insert(0, (back, node[-1]))
        known = self._stems[stem] = (ends, node or None)
        return known

    def tails(self, data: bytes, known: list[int] = (), to: int | None = None) -> list[int]:
        """The last token of each prefix of data; `known` are those of its first prefixes."""
        stems, fits, border = self._stems, self._fits, self._border_holds
        out = known if isinstance(known, list) else list(known)
        if len(fits) >= self.memory:
            fits.clear()
        if len(stems) >= self.memory:
            stems.clear()
        for end in range(len(out) + 1, (len(data) if to is None else to) + 1):
            at = end - STEM
            stem = data[at if at > 0 else 0 : end]
            ends, node = stems.get(stem) or self._stem(stem)
            if node is not None and at > 0:
                longer, back = [], STEM
                while at > 0:
                    at -= 1
                    back += 1
                    node = node.get(data[at])
                    if node is None:
                        break
                    if -1 in node:
                        longer.append((back, node[-1]))
                if longer:
                    longer.reverse()
                    ends = longer + ends
            # Longest first: it is the usual answer, and exactly one candidate is right.
            for back, token in ends:
                if back == end:
                    break
                pair = (out[end - back - 1], token)
                good = fits.get(pair)
                if good is None:
                    good = fits[pair] = border(*pair)
                if good:
                    break
            else:
                raise ValueError(f"no token ends at byte {end}; the ranks lack single bytes")
            out.append(token)
        return out

    def follow(self, tails: list[int]) -> list[int]:
        """The encoding that a table of tails stands for."""
        at, out = len(tails), []
        while at:
            token = tails[at - 1]
            out.append(token)
            at -= len(self.bytes_of[token])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        return self.follow(self.tails(data))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Encoded:
    """A byte string with its table of tails, for appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, data
        self.tails = vocabulary.tails(data)

    @property
    def ids(self) -> list[int]:
        return self.vocabulary.follow(self.tails)

    def append(self, more: bytes) -> None:
        self.data += more
        self.tails = self.vocabulary.tails(self.data, self.tails)

    def edit(self, start: int, end: int, put: bytes) -> int:
        """Replace bytes [start, end); returns how many entries were computed anew."""
        old, tails, reach = self.data, self.tails, self.vocabulary.longest
        self.data = old[:start] + put + old[end:]
        new = tails[:start]
        shift = len(put) - (end - start)
        agreed, behind = 0, start + len(put)
        while len(new) < len(self.data):
            new = self.vocabulary.tails(self.data, new, len(new) + 1)
            at = len(new)
            # Once as many entries in a row agree as the longest token has bytes, all later ones do.
            agreed = agreed + 1 if at > behind and new[-1] == tails[at - 1 - shift] else 0
            if agreed >= reach and at - behind >= reach:
                computed = at - start
                self.tails = new + tails[at - shift :]
                return computed
        self.tails = new
        return len(new) - start


class Tokenizer:
    """A vocabulary with the pattern that cuts texts; remembers what short matches encode to.

    Two generations of at most `memory` matches are kept: a full one becomes the old one, from which
    matches that come again move up.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = MEMORY):
        self.vocabulary = Vocabulary(ranks, memory)
        self._split = regex.compile(pattern).findall
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _pack(self, piece: str) -> bytes:
        return array("i", self.vocabulary.encode(piece.encode())).tobytes()

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        pieces = self._split(text)
        known, old = self._known, self._old
        long: dict[str, bytes] = {}
        for piece in set(pieces).difference(known):
            ids = old.get(piece) or self._pack(piece)
            if len(piece) <= 32:
                known[piece] = ids
            else:
                long[piece] = ids
        if long:
            out = b"".join([long[p] if p in long else known[p] for p in pieces])
        else:
            out = b"".join(map(known.__getitem__, pieces))
        if len(known) >= self.vocabulary.memory:
            self._known, self._old = {}, known
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()


def _name(ranks: dict[bytes, int], pattern: str) -> str:
    out = hashlib.sha256(pattern.encode())
    for token, rank in sorted(ranks.items()):
        out.update(b"%d:%d:" % (rank, len(token)) + token)
    return out.hexdigest()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", memory: int = MEMORY, decoded: bool = False) -> DataFrame:
    """`docs` with `ids`, the encoding of the text column, in place of it (and of an `ids` it had).

    With `decoded`, the bytes that the ids stand for as well: the same as `decode` of the result, in the same worker, where a
    second Python stage would need a worker of its own a task.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    others = [c for c in docs.columns if c not in (text, "ids") and not (decoded and c == "decoded")]
    name = f"{_name(ranks, pattern)}:{memory}"
    place = len(others)
    names = [*others, "ids", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = K.hold(name, lambda: Tokenizer(shared.value, pattern, memory))
        of = tokenizer.vocabulary.bytes_of.__getitem__
        for batch in batches:
            named = pa.RecordBatch.from_arrays([batch.column(place)], ["text"])
            at = 0
            for part in K.slices(named, "text"):
                coded = [tokenizer.packed(value) if value else b"" for value in part.column(0).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in coded]))).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))]
                if decoded:
                    columns.append(pa.array([b"".join(map(of, np.frombuffer(x, "<i4").tolist())) for x in coded], pa.binary()))
                rest = batch.slice(at, part.num_rows)
                yield pa.RecordBatch.from_arrays([*(rest.column(i) for i in range(place)), *columns], names)
                at += part.num_rows

    slim = docs.select(*others, text)
    fields = [f for f in slim.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "ids array<int>", *(["decoded binary"] if decoded else [])])
    return slim.mapInArrow(run, schema)


def decode(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """`docs` with `decoded`, the bytes that its ids stand for (in place of a `decoded` it had)."""
    docs = docs.drop("decoded")
    size = max(ranks.values(), default=-1) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        of = tokens.__getitem__
        length = np.array([len(t) for t in tokens] or [0], np.int64)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for row in range(0, batch.num_rows, 512):
                part = batch.slice(row, 512)
                flat = part.column(at).flatten().to_numpy(zero_copy_only=False)
                cut = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(part.column(at)), 0).to_numpy())))
                ends = np.concatenate(([0], np.cumsum(length[flat])))[cut].astype(np.int32)
                whole = b"".join(map(of, flat.tolist()))
                texts = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, decoded binary")


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
