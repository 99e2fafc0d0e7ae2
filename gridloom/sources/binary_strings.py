"""Formula byte code of binary workbooks to text: a stack machine over a few dozen tokens."""

from __future__ import annotations

import struct

from gridloom.a1 import col_name

# Operators by token, functions by number (name, argument count or None for a variable one).
OPERATORS = {0x03: "+", 0x04: "-", 0x05: "*", 0x06: "/", 0x07: "^", 0x08: "&", 0x09: "<", 0x0A: "<=", 0x0B: "=", 0x0C: ">=", 0x0D: ">", 0x0E: "<>"}
FUNCTIONS = {0: "COUNT", 1: "IF", 4: "SUM", 5: "AVERAGE", 6: "MIN", 7: "MAX", 24: "ABS", 27: "ROUND", 36: "AND", 37: "OR", 38: "NOT", 169: "COUNTA", 336: "CONCATENATE"}
FIXED_ARGS = {24: 1, 27: 2, 38: 1}
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


class Unreadable(Exception):
    pass


def decode(code: bytes, wide: bool) -> str:
    """The formula's text. ``wide``: the newer binary format (32-bit rows, UTF-16 strings); else BIFF8."""
    stack: list[str] = []
    at = 0

    def reference() -> str:
        nonlocal at
        r, c = struct.unpack_from("<IH" if wide else "<HH", code, at)
        at += 6 if wide else 4
        return f"{'' if c & 0x4000 else '$'}{col_name(c & 0x3FFF if wide else c & 0xFF)}{'' if c & 0x8000 else '$'}{r + 1}"

    def area() -> str:
        nonlocal at
        if wide:
            r0, r1, c0, c1 = struct.unpack_from("<IIHH", code, at)
            at += 12
        else:
            r0, r1, c0, c1 = struct.unpack_from("<HHHH", code, at)
            at += 8
        cell = lambda r, c: f"{'' if c & 0x4000 else '$'}{col_name(c & 0x3FFF if wide else c & 0xFF)}{'' if c & 0x8000 else '$'}{r + 1}"
        return f"{cell(r0, c0)}:{cell(r1, c1)}"

    def pop(n: int) -> list[str]:
        if len(stack) < n:
            raise Unreadable("stack")
        out = stack[len(stack) - n :]
        del stack[len(stack) - n :]
        return out

    try:
        while at < len(code):
            token = code[at]
            at += 1
            base = token & 0x1F | 0x20 if token >= 0x40 else token
            if token in OPERATORS:
                a, b = pop(2)
                stack.append(f"{a}{OPERATORS[token]}{b}")
            elif token in (0x12, 0x13):
                stack.append("+-"[token - 0x12] + pop(1)[0])
            elif token == 0x14:
                stack.append(pop(1)[0] + "%")
            elif token == 0x15:
                stack.append(f"({pop(1)[0]})")
            elif token == 0x16:
                stack.append("")
            elif token == 0x17:
                if wide:
                    n = struct.unpack_from("<H", code, at)[0]
                    text = code[at + 2 : at + 2 + 2 * n].decode("utf-16-le")
                    at += 2 + 2 * n
                else:
                    n, flag = code[at], code[at + 1] & 1
                    text = code[at + 2 : at + 2 + n * (1 + flag)].decode("utf-16-le" if flag else "latin-1")
                    at += 2 + n * (1 + flag)
                stack.append('"' + text.replace('"', '""') + '"')
            elif token == 0x19:  # hints: volatile, if, choose, goto, sum, space
                kind = code[at]
                at += 3
                if kind & 0x10:
                    stack.append(f"SUM({pop(1)[0]})")
                elif kind & 0x04:
                    raise Unreadable("choose")
            elif token == 0x1C:
                stack.append(ERRORS.get(code[at], "#N/A"))
                at += 1
            elif token == 0x1D:
                stack.append("TRUE" if code[at] else "FALSE")
                at += 1
            elif token == 0x1E:
                stack.append(str(struct.unpack_from("<H", code, at)[0]))
                at += 2
            elif token == 0x1F:
                x = struct.unpack_from("<d", code, at)[0]
                stack.append(str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x))
                at += 8
            elif base == 0x24:
                stack.append(reference())
            elif base == 0x25:
                stack.append(area())
            elif base == 0x21:
                k = struct.unpack_from("<H", code, at)[0]
                at += 2
                stack.append(f"{FUNCTIONS[k]}({','.join(pop(FIXED_ARGS[k]))})")
            elif base == 0x22:
                n, k = struct.unpack_from("<BH", code, at)
                at += 3
                stack.append(f"{FUNCTIONS[k & 0x7FFF]}({','.join(pop(n & 0x7F))})")
            else:
                raise Unreadable(hex(token))
    except (struct.error, IndexError, KeyError, UnicodeDecodeError) as problem:
        raise Unreadable(str(problem)) from None
    if len(stack) != 1:
        raise Unreadable("stack")
    return stack[0]
