"""Per-method evidence: constant arguments, forwarders, lambda branches, flow of marked values.

Each analysis is a fixpoint over one method's instructions.  Methods are independent, so they run in Arrow batches of
whole methods (an array of instruction rows each); a method over the bounds gives `unresolved`, never nothing.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_MOST, REGISTERS_MOST, WORK_MOST = 32_768, 512, 2_000_000
#: A value that several paths disagree on, or that nothing is known of.
UNKNOWN = None

_CALL = range(0x6E, 0x73), range(0x74, 0x79)


def is_call(opcode: int) -> bool:
    return any(opcode in r for r in _CALL)


def bodies(instructions: DataFrame) -> DataFrame:
    """(method_id, class_id, body): the instructions of each method as one array, by pc; a method is bounded by its format."""
    row = F.struct("pc", "opcode", "name", "registers", "literal", "pool", "operand", "target", "catches")
    return instructions.groupBy("method_id", "class_id").agg(F.sort_array(F.collect_list(row)).alias("body"))


def successors(body: list[dict]) -> list[list[int]]:
    """Normal successors of each instruction, as positions."""
    place = {one["pc"]: k for k, one in enumerate(body)}
    out = []
    for k, one in enumerate(body):
        op, after = one["opcode"], [k + 1] if k + 1 < len(body) else []
        if op in (0x0E, 0x0F, 0x10, 0x11, 0x27):
            after = []
        elif op in (0x28, 0x29, 0x2A):
            after = [place[one["target"]]] if one["target"] in place else []
        elif 0x32 <= op <= 0x3D and one["target"] in place:
            after = [*after, place[one["target"]]]
        out.append(after)
    return out


def fixpoint(body: list[dict], entry: dict, step: Callable[[dict, dict], dict], join: Callable[[object, object], object], caught: Callable[[dict], dict] = lambda state: {}) -> list[dict] | None:
    """The state before each instruction, or None when the work is too much.  Registers that a state lacks are unknown.

    `caught` is what a handler gets of the state before an instruction that it guards; nothing is known there by default.
    """
    if len(body) > WORDS_MOST:
        return None
    after = successors(body)
    place = {one["pc"]: k for k, one in enumerate(body)}
    handlers = [[place[t] for t in one.get("catches") or () if t in place] for one in body]
    states: list[dict | None] = [None] * len(body)
    if body:
        states[0] = dict(entry)
    waiting, work = deque([0] if body else []), 0
    while waiting:
        k = waiting.popleft()
        work += 1 + len(states[k])
        if work > WORK_MOST:
            return None
        normal = step(body[k], states[k])
        guarded = caught(states[k]) if handlers[k] else None
        for n, left in [*((n, normal) for n in after[k]), *((n, guarded) for n in handlers[k])]:
            if states[n] is None:
                states[n] = dict(left)
                waiting.append(n)
                continue
            met = {r: v for r in states[n].keys() & left.keys() if (v := join(states[n][r], left[r])) is not UNKNOWN}
            if met != states[n]:
                states[n] = met
                waiting.append(n)
    return [s if s is not None else {} for s in states]


def _constant_step(one: dict, state: dict) -> dict:
    op, regs = one["opcode"], one["registers"]
    out = dict(state)
    wide = 0x16 <= op <= 0x19
    if 0x12 <= op <= 0x19:
        out[regs[0]] = ("bits", one["literal"])
        if wide:
            out.pop(regs[0] + 1, None)
    elif op in (0x1A, 0x1B):
        out[regs[0]] = ("string", one["operand"])
    elif op == 0x1C:
        out[regs[0]] = ("type", one["operand"])
    elif 0x01 <= op <= 0x09:
        if regs[1] in state:
            out[regs[0]] = state[regs[1]]
        else:
            out.pop(regs[0], None)
    elif regs and writes(op):
        out.pop(regs[0], None)
        if op in (0x0B, 0x45, 0x53, 0x61) or "long" in one["name"] or "double" in one["name"]:
            out.pop(regs[0] + 1, None)
    return out


def writes(op: int) -> bool:
    """Whether an instruction's first register is written (moves and constants have their own rules)."""
    return op in (0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x21, 0x22, 0x23) or 0x2D <= op <= 0x31 or 0x44 <= op <= 0x4A or 0x52 <= op <= 0x58 or 0x60 <= op <= 0x66 or 0x7B <= op <= 0xE2 or op in (0xFE, 0xFF)


def _same(a: object, b: object) -> object:
    return a if a == b else UNKNOWN


def parameter_slots(one: dict) -> list[tuple[int, str]]:
    """(register, descriptor) of a call's parameters without the receiver; wide ones take two registers."""
    import re

    listed = re.findall(r"\[*(?:L[^;]+;|[VZBSCIJFD])", one["operand"].partition("(")[2].partition(")")[0])
    regs = list(one["registers"])
    at = 0 if one["opcode"] in (0x71, 0x77) else 1
    out = []
    for kind in listed:
        if at >= len(regs):
            break
        out.append((regs[at], kind))
        at += 2 if kind in ("J", "D") else 1
    return out


def _per_method(methods: DataFrame, work: Callable[[str, str, list[dict]], list[tuple]], schema: str, names: list[str], kinds: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for method, owner, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows += work(method, owner, body)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return methods.select("method_id", "class_id", "body").mapInArrow(run, schema)


def constant_arguments(methods: DataFrame, callee: str | None = None) -> DataFrame:
    """(method_id, pc, callee, argument, kind, value): every argument of every call; kind `unknown` where it is not proven."""

    def work(method: str, owner: str, body: list[dict]) -> list[tuple]:
        if callee is not None and not any(is_call(o["opcode"]) and o["operand"] == callee for o in body):
            return []
        states = fixpoint(body, {}, _constant_step, _same)
        out = []
        for k, one in enumerate(body):
            if is_call(one["opcode"]) and (callee is None or one["operand"] == callee):
                for n, (reg, _) in enumerate(parameter_slots(one)):
                    kind, value = (states[k].get(reg) if states is not None else None) or ("unknown", None)
                    out.append((method, one["pc"], one["operand"], n, kind, None if value is None else str(value)))
        return out

    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return _per_method(methods, work, "method_id string, pc long, callee string, argument long, kind string, value string", ["method_id", "pc", "callee", "argument", "kind", "value"], kinds)


def forwarders(methods: DataFrame, static: DataFrame) -> DataFrame:
    """(method_id, target): static methods of at most 64 instructions that only move all they get, in its order, into one static
    call and return what it returns, moved or not; `static` has method_id, ins, returns and words of static methods without handlers."""

    def work(method: str, owner: str, body: list[dict]) -> list[tuple]:
        calls = [o for o in body if is_call(o["opcode"])]
        if len(body) > 64 or len(calls) != 1 or calls[0]["opcode"] not in (0x71, 0x77):
            return []
        if calls[0]["operand"].partition("(")[2] != method.partition("(")[2]:
            return []
        # What registers hold that hold something else than at entry.
        held: dict[int, object] = {}
        given, returned = None, False
        for one in body:
            op, regs = one["opcode"], one["registers"]
            if 0x01 <= op <= 0x09:
                wide = range(2 if 0x04 <= op <= 0x06 else 1)
                held.update({regs[0] + n: value for n, value in [(n, held.get(regs[1] + n, regs[1] + n)) for n in wide]})
            elif is_call(op):
                given = [held.get(r, r) for r in regs]
            elif op in (0x0A, 0x0B, 0x0C) and given is not None:
                held.update({regs[0]: "result", regs[0] + 1: "high"} if op == 0x0B else {regs[0]: "result"})
            elif 0x0E <= op <= 0x11:
                returned = op == 0x0E or held.get(regs[0]) == "result"
                break
            else:
                return []
        # With moves alone nothing but parameters is set before the call, so as many words in their order are all of them.
        return [(method, calls[0]["operand"])] if returned and given is not None and given == sorted(set(given)) else []

    some = methods.join(static.select("method_id"), "method_id", "left_semi")
    return _per_method(some, work, "method_id string, target string", ["method_id", "target"], [pa.string(), pa.string()])


def cross_namespace_calls(calls: DataFrame) -> DataFrame:
    """Calls from one package to another: (method_id, pc, callee)."""
    package = lambda c: F.regexp_extract(F.regexp_extract(c, r"^([^(]*)\.[^.(]+\(", 1), r"^(.*)\.", 1)
    return calls.where(package(F.col("method_id")) != package(F.col("callee")))


def switch_branch(methods: DataFrame, discriminator: str) -> DataFrame:
    """(method_id, value, pc): where a method that compares a field goes for each constant it is compared with.

    The field must be read before the test, and the other side be a proven constant; all other tests are left out.
    """

    def step(one: dict, state: dict) -> dict:
        out = _constant_step(one, state)
        if one["operand"] == discriminator and 0x52 <= one["opcode"] <= 0x58:
            out[one["registers"][0]] = ("field", discriminator)
        return out

    def work(method: str, owner: str, body: list[dict]) -> list[tuple]:
        if not any(o["operand"] == discriminator for o in body):
            return []
        states = fixpoint(body, {}, step, _same)
        after, rows = successors(body), []
        for k, one in enumerate(body if states is not None else []):
            op = one["opcode"]
            if op not in (0x32, 0x33, 0x38, 0x39) or not after[k]:
                continue
            sides = [states[k].get(r) for r in one["registers"]] + ([("bits", 0)] if op >= 0x38 else [])
            if ("field", discriminator) not in sides:
                continue
            other = next((s for s in sides if s and s[0] == "bits"), None)
            if other is None:
                continue
            equal = after[k][-1] if op in (0x32, 0x38) else after[k][0]
            rows.append((method, other[1], body[equal]["pc"]))
        return rows

    return _per_method(methods, work, "method_id string, value long, pc long", ["method_id", "value", "pc"], [pa.string(), pa.int64(), pa.int64()])


def marked_flows(methods: DataFrame, sources: dict[str, int], sinks: dict[str, int], carriers: dict[str, int] | None = None) -> DataFrame:
    """(method_id, pc, sink, mask): which marks may reach an argument of a sink.

    `sources` mark the results of calls; `carriers` pass marks of their arguments on to their result or receiver.  Masks are joined
    by OR, so this is a may-analysis; mask 0 rows are sinks that nothing marked reaches.
    """
    carriers = carriers or {}

    def step(one: dict, state: dict) -> dict:
        out = dict(state)
        op, regs = one["opcode"], one["registers"]
        if 0x01 <= op <= 0x09:
            out[regs[0]] = state.get(regs[1], 0)
        elif op in (0x0A, 0x0B, 0x0C):
            out[regs[0]] = state.get("result", 0)
        elif is_call(op):
            passed = 0
            for r in regs:
                passed |= state.get(r, 0)
            callee = one["operand"]
            out["result"] = sources.get(callee, 0) | (passed if callee in carriers else 0)
            if callee in carriers and regs and op not in (0x71, 0x77):
                out[regs[0]] = state.get(regs[0], 0) | passed | carriers[callee]
        elif regs and (writes(op) or 0x12 <= op <= 0x1C):
            out[regs[0]] = 0
        return out

    def either(a: int, b: int) -> int:
        return a | b

    def work(method: str, owner: str, body: list[dict]) -> list[tuple]:
        hits = [k for k, o in enumerate(body) if is_call(o["opcode"]) and o["operand"] in sinks]
        if not hits:
            return []
        registers = {r for o in body for r in o["registers"]} | {"result"}
        states = fixpoint(body, dict.fromkeys(registers, 0), step, either, caught=dict)
        rows = []
        for k in hits:
            mask = -1 if states is None else 0
            for r in body[k]["registers"] if states is not None else ():
                mask |= states[k].get(r, 0)
            rows.append((method, body[k]["pc"], body[k]["operand"], mask))
        return rows

    return _per_method(methods, work, "method_id string, pc long, sink string, mask long", ["method_id", "pc", "sink", "mask"], [pa.string(), pa.int64(), pa.string(), pa.int64()])
