"""Control flow of one method: blocks, edges, dominators, liveness; as rows for audit."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from .dataflow import _per_method, is_call, writes
from .dataflow import successors as normal_successors


def successors(body: list[dict]) -> list[list[int]]:
    """Normal successors, then the handlers that guard an instruction."""
    place = {one["pc"]: k for k, one in enumerate(body)}
    guarded = [[place[t] for t in one.get("catches") or () if t in place] for one in body]
    return [list(dict.fromkeys([*n, *g])) for n, g in zip(normal_successors(body), guarded, strict=True)]


def blocks(body: list[dict]) -> list[tuple[int, int]]:
    """(first, last) positions of the basic blocks, in order."""
    if not body:
        return []
    after = successors(body)
    leaders = {0}
    for k, targets in enumerate(after):
        if targets != [k + 1]:
            leaders.update(targets)
            leaders.add(k + 1)
    starts = sorted(s for s in leaders if s < len(body))
    return [(a, b - 1) for a, b in zip(starts, [*starts[1:], len(body)], strict=True)]


def block_edges(body: list[dict]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Blocks and the successors of each, as block numbers."""
    found, after = blocks(body), successors(body)
    number = {a: n for n, (a, _) in enumerate(found)}
    return found, [sorted({number[t] for t in after[last] if t in number}) for _, last in found]


def dominators(after: list[list[int]]) -> list[int | None]:
    """The immediate dominator of each block; the entry and what cannot be reached have none."""
    order, seen, stack = [], {0}, [(0, iter(after[0]))] if after else []
    while stack:
        node, rest = stack[-1]
        for n in rest:
            if n not in seen:
                seen.add(n)
                stack.append((n, iter(after[n])))
                break
        else:
            order.append(node)
            stack.pop()
    rank = {n: k for k, n in enumerate(order)}
    before: list[list[int]] = [[] for _ in after]
    for n, targets in enumerate(after):
        for t in targets:
            before[t].append(n)
    idom: list[int | None] = [None] * len(after)
    if after:
        idom[0] = 0
    changed = True
    while changed:
        changed = False
        for n in reversed(order):
            known = [p for p in before[n] if idom[p] is not None]
            if n == 0 or not known:
                continue
            new = known[0]
            for p in known[1:]:
                a, b = p, new
                while a != b:
                    while rank[a] < rank[b]:
                        a = idom[a]
                    while rank[b] < rank[a]:
                        b = idom[b]
                new = a
            if idom[n] != new:
                idom[n], changed = new, True
    return [None if n == 0 else d for n, d in enumerate(idom)]


def effects(one: dict) -> tuple[set[int], set[int]]:
    """(registers read, registers written) of an instruction."""
    op, regs = one["opcode"], list(one["registers"])
    if not regs:
        return set(), set()
    wide = "wide" in one["name"] or "long" in one["name"] or "double" in one["name"]
    pair = lambda r: {r, r + 1} if wide else {r}
    if is_call(op) or op in (0x24, 0x25):
        return set(regs), set()
    if 0x01 <= op <= 0x09:
        return pair(regs[1]), pair(regs[0])
    if 0x12 <= op <= 0x1C:
        return set(), pair(regs[0])
    if 0xB0 <= op <= 0xCF:
        return set(regs) | pair(regs[0]), pair(regs[0])
    if writes(op):
        return set(regs[1:]), pair(regs[0])
    return set(regs), set()


def live_in(body: list[dict]) -> list[set[int]]:
    """The registers that some path from an instruction reads before it writes them."""
    after, use = successors(body), [effects(o) for o in body]
    before: list[list[int]] = [[] for _ in body]
    for k, targets in enumerate(after):
        for t in targets:
            before[t].append(k)
    live = [set() for _ in body]
    waiting = deque(range(len(body) - 1, -1, -1))
    while waiting:
        k = waiting.popleft()
        out = set().union(*(live[t] for t in after[k])) if after[k] else set()
        new = use[k][0] | (out - use[k][1])
        if new != live[k]:
            live[k] = new
            waiting.extend(before[k])
    return live


def cfg_blocks(methods: DataFrame) -> DataFrame:
    """(method_id, block, first_pc, last_pc, dominator, live): one row a block."""

    def work(method: str, owner: str, body: list[dict]) -> list[tuple]:
        found, after = block_edges(body)
        idom, live = dominators(after), live_in(body)
        return [(method, n, body[a]["pc"], body[b]["pc"], idom[n], sorted(live[a])) for n, (a, b) in enumerate(found)]

    names = ["method_id", "block", "first_pc", "last_pc", "dominator", "live"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return _per_method(methods, work, "method_id string, block long, first_pc long, last_pc long, dominator long, live array<long>", names, kinds)


def cfg_edges(methods: DataFrame) -> DataFrame:
    """(method_id, source, target) of blocks."""

    def work(method: str, owner: str, body: list[dict]) -> list[tuple]:
        _, after = block_edges(body)
        return [(method, n, t) for n, targets in enumerate(after) for t in targets]

    return _per_method(methods, work, "method_id string, source long, target long", ["method_id", "source", "target"], [pa.string(), pa.int64(), pa.int64()])
