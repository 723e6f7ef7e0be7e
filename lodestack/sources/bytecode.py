"""Instructions: widths, operands, names, and the listing of a method."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from .dex import Code, Dex, DexError, Method

_FORMATS: dict[int, str] = {}


def _span(kind: str, *ranges: tuple[int, int]) -> None:
    for lo, hi in ranges:
        for op in range(lo, hi + 1):
            _FORMATS[op] = kind


# Formats by ranges of opcodes, as the format's reference lists them.
_span("10x", (0x00, 0x00), (0x0E, 0x0E), (0x3E, 0x43), (0x73, 0x73), (0x79, 0x7A), (0xE3, 0xF9))
_span("12x", (0x01, 0x01), (0x04, 0x04), (0x07, 0x07), (0x21, 0x21), (0x7B, 0x8F), (0xB0, 0xCF))
_span("22x", (0x02, 0x02), (0x05, 0x05), (0x08, 0x08))
_span("32x", (0x03, 0x03), (0x06, 0x06), (0x09, 0x09))
_span("11x", (0x0A, 0x0D), (0x0F, 0x11), (0x1D, 0x1E), (0x27, 0x27))
_span("11n", (0x12, 0x12))
_span("21s", (0x13, 0x13), (0x16, 0x16))
_span("31i", (0x14, 0x14), (0x17, 0x17))
_span("21h", (0x15, 0x15), (0x19, 0x19))
_span("51l", (0x18, 0x18))
_span("21c", (0x1A, 0x1A), (0x1C, 0x1C), (0x1F, 0x1F), (0x22, 0x22), (0x60, 0x6D), (0xFE, 0xFF))
_span("31c", (0x1B, 0x1B))
_span("22c", (0x20, 0x20), (0x23, 0x23), (0x52, 0x5F))
_span("35c", (0x24, 0x24), (0x6E, 0x72), (0xFC, 0xFC))
_span("3rc", (0x25, 0x25), (0x74, 0x78), (0xFD, 0xFD))
_span("31t", (0x26, 0x26), (0x2B, 0x2C))
_span("10t", (0x28, 0x28))
_span("20t", (0x29, 0x29))
_span("30t", (0x2A, 0x2A))
_span("23x", (0x2D, 0x31), (0x44, 0x51), (0x90, 0xAF))
_span("22t", (0x32, 0x37))
_span("21t", (0x38, 0x3D))
_span("22s", (0xD0, 0xD7))
_span("22b", (0xD8, 0xE2))
_span("45cc", (0xFA, 0xFA))
_span("4rcc", (0xFB, 0xFB))


def _mnemonics() -> dict[int, str]:
    """Names by families: a stem with the suffixes of its types or forms."""
    out: dict[int, str] = {}

    def put(first: int, names: list[str]) -> None:
        out.update((first + k, n) for k, n in enumerate(names))

    kinds = ["", "-wide", "-object", "-boolean", "-byte", "-char", "-short"]
    put(0x00, ["nop"])
    put(0x01, [f"move{k}{s}" for k in ("", "-wide", "-object") for s in ("", "/from16", "/16")])
    put(0x0A, ["move-result", "move-result-wide", "move-result-object", "move-exception", "return-void", "return", "return-wide", "return-object"])
    put(0x12, ["const/4", "const/16", "const", "const/high16", "const-wide/16", "const-wide/32", "const-wide", "const-wide/high16", "const-string", "const-string/jumbo", "const-class", "monitor-enter", "monitor-exit"])
    put(0x1F, ["check-cast", "instance-of", "array-length", "new-instance", "new-array", "filled-new-array", "filled-new-array/range", "fill-array-data", "throw", "goto", "goto/16", "goto/32", "packed-switch", "sparse-switch"])
    put(0x2D, ["cmpl-float", "cmpg-float", "cmpl-double", "cmpg-double", "cmp-long"])
    tests = ["eq", "ne", "lt", "ge", "gt", "le"]
    put(0x32, [f"if-{t}" for t in tests] + [f"if-{t}z" for t in tests])
    for first, stems in ((0x44, ("aget", "aput")), (0x52, ("iget", "iput")), (0x60, ("sget", "sput"))):
        put(first, [s + k for s in stems for k in kinds])
    calls = ["virtual", "super", "direct", "static", "interface"]
    put(0x6E, [f"invoke-{c}" for c in calls])
    put(0x74, [f"invoke-{c}/range" for c in calls])
    put(0x7B, ["neg-int", "not-int", "neg-long", "not-long", "neg-float", "neg-double"])
    numbers = ["int", "long", "float", "double"]
    put(0x81, [f"{a}-to-{b}" for a in numbers for b in numbers if a != b] + ["int-to-byte", "int-to-char", "int-to-short"])
    whole = ["add", "sub", "mul", "div", "rem", "and", "or", "xor", "shl", "shr", "ushr"]
    binary = [f"{op}-{t}" for t in ("int", "long") for op in whole] + [f"{op}-{t}" for t in ("float", "double") for op in whole[:5]]
    put(0x90, binary)
    put(0xB0, [f"{b}/2addr" for b in binary])
    small = ["add-int", "rsub-int", "mul-int", "div-int", "rem-int", "and-int", "or-int", "xor-int"]
    put(0xD0, [f"{s}/lit16" if s != "rsub-int" else s for s in small])
    put(0xD8, [f"{s}/lit8" for s in [*small, "shl-int", "shr-int", "ushr-int"]])
    put(0xFA, ["invoke-polymorphic", "invoke-polymorphic/range", "invoke-custom", "invoke-custom/range", "const-method-handle", "const-method-type"])
    return out


MNEMONICS = _mnemonics()
CALLS = {op: MNEMONICS[op] for op in (*range(0x6E, 0x73), *range(0x74, 0x79))}


@dataclass
class Instruction:
    pc: int
    opcode: int
    words: tuple[int, ...]
    registers: tuple[int, ...] = ()
    literal: int | None = None
    pool: str | None = None
    index: int | None = None
    target: int | None = None

    @property
    def name(self) -> str:
        return MNEMONICS.get(self.opcode, f"unused-{self.opcode:02x}")


def _signed(value: int, bits: int) -> int:
    return value - (1 << bits) if value >> (bits - 1) & 1 else value


def _pool(op: int) -> str | None:
    if op in (0x1A, 0x1B):
        return "string"
    if op in (0x1C, 0x1F, 0x20, 0x22, 0x23, 0x24, 0x25):
        return "type"
    if 0x52 <= op <= 0x6D:
        return "field"
    if op in CALLS or op in (0xFA, 0xFB):
        return "method"
    return {0xFC: "call_site", 0xFD: "call_site", 0xFE: "method_handle", 0xFF: "proto"}.get(op)


def payload_width(words: tuple[int, ...], pc: int) -> int:
    """Words of the table at pc (a switch or array payload), or 0."""
    head = words[pc]
    if head == 0x0100:
        return 4 + 2 * words[pc + 1]
    if head == 0x0200:
        return 2 + 4 * words[pc + 1]
    if head == 0x0300:
        width, size = words[pc + 1], words[pc + 2] | words[pc + 3] << 16
        return 4 + (width * size + 1) // 2
    return 0


def instructions(code: Code) -> Iterator[Instruction]:
    """The instructions of a method in order; tables between them are passed over by their own size."""
    words, pc = code.words, 0
    try:
        while pc < len(words):
            if table := payload_width(words, pc) if words[pc] & 0xFF == 0 and words[pc] else 0:
                pc += table
                continue
            op = words[pc] & 0xFF
            width = int(_FORMATS[op][0])
            if pc + width > len(words):
                raise DexError(f"an instruction at {pc} is cut off")
            yield _decode(op, pc, words[pc : pc + width])
            pc += width
    except IndexError as error:
        raise DexError(f"a table at {pc} is cut off") from error


def _decode(op: int, pc: int, w: tuple[int, ...]) -> Instruction:
    kind, a, b, high = _FORMATS[op], w[0] >> 8 & 0xF, w[0] >> 12, w[0] >> 8
    one = Instruction(pc, op, w)
    if kind == "12x":
        one.registers = (a, b)
    elif kind in ("11x", "22x", "21s", "21h", "31i", "51l", "21c", "31c", "31t", "21t"):
        one.registers = (high, w[1]) if kind == "22x" else (high,)
    elif kind == "11n":
        one.registers, one.literal = (a,), _signed(b, 4)
    elif kind == "32x":
        one.registers = (w[1], w[2])
    elif kind == "23x":
        one.registers = (high, w[1] & 0xFF, w[1] >> 8)
    elif kind in ("22t", "22s", "22c"):
        one.registers = (a, b)
    elif kind == "22b":
        one.registers, one.literal = (high, w[1] & 0xFF), _signed(w[1] >> 8, 8)
    elif kind in ("35c", "45cc"):
        listed = [w[2] & 0xF, w[2] >> 4 & 0xF, w[2] >> 8 & 0xF, w[2] >> 12, a]
        one.registers = tuple(listed[:b])
    elif kind in ("3rc", "4rcc"):
        one.registers = tuple(range(w[2], w[2] + high))
    if kind in ("21s", "22s"):
        one.literal = _signed(w[1], 16)
    elif kind == "21h":
        one.literal = _signed(w[1], 16) << (16 if op == 0x15 else 48)
    elif kind == "31i":
        one.literal = _signed(w[1] | w[2] << 16, 32)
    elif kind == "51l":
        one.literal = _signed(w[1] | w[2] << 16 | w[3] << 32 | w[4] << 48, 64)
    if kind in ("10t", "20t", "30t", "21t", "22t", "31t"):
        step = {"10t": lambda: _signed(high, 8), "20t": lambda: _signed(w[1], 16), "21t": lambda: _signed(w[1], 16), "22t": lambda: _signed(w[1], 16), "30t": lambda: _signed(w[1] | w[2] << 16, 32), "31t": lambda: _signed(w[1] | w[2] << 16, 32)}[kind]()
        one.target = pc + step
    if (pool := _pool(op)) is not None:
        one.pool = pool
        one.index = w[1] | w[2] << 16 if kind == "31c" else w[1]
    return one


def catches(code: Code, pc: int) -> list[int]:
    """Where handlers begin that an instruction may go to."""
    return sorted({target for start, end, handlers in code.tries if start <= pc < end for _, target in handlers})


def operand(dex: Dex, one: Instruction) -> str | None:
    """What a pool operand stands for."""
    if one.pool == "string":
        return dex.strings[one.index]
    if one.pool == "type":
        return dex.types[one.index]
    if one.pool == "field":
        return dex.field_id(one.index)
    if one.pool == "method":
        return dex.method_id(one.index)
    return None if one.pool is None else f"{one.pool}@{one.index}"


def listing(dex: Dex, method: Method) -> str:
    """A method line by line: offset, name, registers, operand; handlers follow."""
    lines = [f".method {method.id} access={method.access:#x}"]
    if method.code is None:
        return "\n".join([*lines, "  (no code)", ".end method"])
    code = method.code
    lines.append(f"  .registers {code.registers} ins={code.ins} outs={code.outs}")
    for one in instructions(code):
        parts = [f"v{r}" for r in one.registers]
        if one.literal is not None:
            parts.append(f"#{one.literal}")
        if (text := operand(dex, one)) is not None:
            parts.append('"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' if one.pool == "string" else text)
        if one.target is not None:
            parts.append(f"-> {one.target:04x}")
        lines.append(f"{one.pc:04x}: {one.name} {', '.join(parts)}".rstrip())
    for start, end, handlers in code.tries:
        lines += [f"  .catch {kind or 'any'} {start:04x}..{end:04x} -> {target:04x}" for kind, target in handlers]
    return "\n".join([*lines, ".end method"])
