"""Fill-down formulas as Column expressions: one expression for all rows that hold the same formula relative to their row.

A value knows its kind as far as the formula tells it, and keeps its error apart: ``raw`` expressions hold each operand once,
so they grow with the formula, not with a power of it, and the error is looked at once, at the root. Only references
to the formula's own row are compiled; aggregates over ranges are :mod:`gridloom.operators.formulas`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import formula as X
from gridloom.sinks.csv import number_text

_NUMERIC = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


@dataclass
class Value:
    """``kind``: n, s, b, blank or any. Of a known kind the one column ``raw`` counts, null for a blank; ``any`` has its tag in
    ``t`` (null for a blank) and a column for each kind. ``err`` is the error's text or null; None where there can be none."""

    kind: str
    raw: Column | None = None
    err: Column | None = None
    t: Column | None = None
    vn: Column | None = None
    vs: Column | None = None
    vb: Column | None = None

    def parts(self) -> tuple[Column, Column, Column, Column]:
        """(t, vn, vs, vb) whatever the kind."""
        none = {"n": "double", "s": "string", "b": "boolean"}
        if self.kind == "any":
            return self.t, self.vn, self.vs, self.vb
        tag = F.lit(None).cast("string") if self.kind == "blank" else F.when(self.raw.isNotNull(), F.lit(self.kind))
        return (tag, *[self.raw if k == self.kind else F.lit(None).cast(kind) for k, kind in none.items()])


def _first(*errors: Column | None) -> Column | None:
    there = [e for e in errors if e is not None]
    return F.coalesce(*there) if len(there) > 1 else there[0] if there else None


def number(v: Value) -> tuple[Column, Column | None]:
    """(number, error): bools count 1 and 0, blanks 0, numeric text its number."""
    zero = F.lit(0.0)
    if v.kind == "n":
        return F.coalesce(v.raw, zero), v.err
    if v.kind == "b":
        return F.coalesce(v.raw.cast("double"), zero), v.err
    if v.kind == "blank":
        return zero, v.err
    text = v.raw if v.kind == "s" else v.vs
    bad = text.isNotNull() & ~text.rlike(_NUMERIC)
    n = F.when(text.isNotNull(), F.trim(text).try_cast("double"))
    n = F.coalesce(n, zero) if v.kind == "s" else F.coalesce(v.vn, v.vb.cast("double"), n, zero)
    return n, _first(v.err, F.when(bad, F.lit("#VALUE!")))


def boolean(v: Value) -> tuple[Column, Column | None]:
    """(bool, error)."""
    no = F.lit(False)
    if v.kind == "n":
        return F.coalesce(v.raw != 0, no), v.err
    if v.kind == "b":
        return F.coalesce(v.raw, no), v.err
    if v.kind == "blank":
        return no, v.err
    word = F.upper(v.raw if v.kind == "s" else v.vs)
    bad = word.isNotNull() & ~word.isin("TRUE", "FALSE")
    b = F.coalesce(word == "TRUE", no) if v.kind == "s" else F.coalesce(v.vb, v.vn != 0, word == "TRUE", no)
    return b, _first(v.err, F.when(bad, F.lit("#VALUE!")))


def text(v: Value) -> Column:
    t = {"n": lambda: number_text(v.raw), "s": lambda: v.raw, "b": lambda: F.upper(v.raw.cast("string")), "blank": lambda: F.lit("")}
    if v.kind in t:
        return F.coalesce(t[v.kind](), F.lit(""))
    return F.coalesce(number_text(v.vn), v.vs, F.upper(v.vb.cast("string")), F.lit(""))


def _unfinite(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit("#NUM!"))


def _arithmetic(op: str, a: Value, b: Value) -> Value:
    (x, ex), (y, ey) = number(a), number(b)
    # Errors of operands first, left before right, then coercions, then the operation's own.
    before = _first(a.err, b.err, ex if ex is not a.err else None, ey if ey is not b.err else None)
    if op == "/":
        out = F.try_divide(x, y)
        own = F.coalesce(F.when(y == 0, F.lit("#DIV/0!")), _unfinite(out))
    else:
        out = x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else F.pow(x, y)
        own = _unfinite(out)
    return Value("n", out, _first(before, own))


def _compare(op: str, a: Value, b: Value) -> Value:
    way = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    zeros = {"n": F.lit(0.0), "s": F.lit(""), "b": F.lit(False)}

    def ready(v: Value, kind: str) -> Column:
        raw = zeros[kind] if v.kind == "blank" else F.coalesce(v.raw, zeros[kind])
        return F.lower(raw) if kind == "s" else raw.cast("int") if kind == "b" else raw

    kinds = {v.kind for v in (a, b)} - {"blank"}
    if len(kinds) <= 1 and "any" not in kinds:
        kind = next(iter(kinds), "n")
        order = way(ready(a, kind), ready(b, kind))
    else:
        rank = lambda t: F.when(t == "n", 0).when(t == "s", 1).when(t == "b", 2)
        (ta, *va), (tb, *vb) = a.parts(), b.parts()
        ra, rb = F.coalesce(rank(ta), rank(tb), F.lit(0)), F.coalesce(rank(tb), rank(ta), F.lit(0))
        sides = [(F.coalesce(n, F.lit(0.0)), F.lower(F.coalesce(s, F.lit(""))), F.coalesce(f, F.lit(False)).cast("int")) for n, s, f in (va, vb)]
        order = F.when(ra != rb, way(ra, rb)).when(ra == 0, way(sides[0][0], sides[1][0])).when(ra == 1, way(sides[0][1], sides[1][1])).otherwise(way(sides[0][2], sides[1][2]))
    test = {"=": order == 0, "<>": order != 0, "<": order < 0, "<=": order <= 0, ">": order > 0, ">=": order >= 0}[op]
    return Value("b", test, _first(a.err, b.err))


def _choose(test: Column, problem: Column | None, a: Value, b: Value) -> Value:
    """IF: the error of the condition, else of the branch that is taken."""
    none = F.lit(None).cast("string")
    branch = None if a.err is None and b.err is None else F.when(test, none if a.err is None else a.err).otherwise(none if b.err is None else b.err)
    err = _first(problem, branch)
    if a.kind == b.kind != "any":
        return Value(a.kind, None if a.kind == "blank" else F.when(test, a.raw).otherwise(b.raw), err)
    t, vn, vs, vb = (F.when(test, p).otherwise(q) for p, q in zip(a.parts(), b.parts()))
    return Value("any", None, err, t, vn, vs, vb)


def _logical(name: str, nodes: tuple[X.Node, ...], args: list[Value]) -> Value:
    seen, errors = [], []
    for n, v in zip(nodes, args):
        b, e = boolean(v)
        if n.op == "ref":  # text and blanks of references do not count
            t, vn, _, vb = v.parts()
            b, e = F.when(t == "b", vb).when(t == "n", vn != 0), v.err
        elif v.kind == "blank":
            e = F.lit("#VALUE!")
        seen.append(b)
        errors.append(e)
    counted = F.filter(F.array(*seen), lambda x: x.isNotNull()) if seen else F.array().cast("array<boolean>")
    test = F.forall(counted, lambda x: x) if name == "AND" else F.exists(counted, lambda x: x)
    return Value("b", test, _first(*errors, F.when(F.size(counted) == 0, F.lit("#VALUE!"))))


def compile_tree(tree: X.Node, row: dict[int, Value]) -> Value:
    """``row``: the values of the formula's own row by column number."""
    if tree.op == "lit":
        v = tree.value
        if isinstance(v, X.Error):
            return Value("blank", None, F.lit(str(v)))
        if v is None:
            return Value("blank")
        return Value("b" if isinstance(v, bool) else "n" if isinstance(v, float) else "s", F.lit(v))
    if tree.op == "ref":
        if not tree.value.lone or tree.value.r0 != 0 or tree.value.c0 not in row:
            raise X.FormulaError("unsupported")
        return row[tree.value.c0]
    args = [compile_tree(a, row) for a in tree.args]
    if tree.op == "u+":
        return args[0]
    if tree.op in ("u-", "%"):
        x, e = number(args[0])
        return Value("n", -x if tree.op == "u-" else x / 100, e)
    if tree.op == "&":
        return Value("s", F.concat(text(args[0]), text(args[1])), _first(args[0].err, args[1].err))
    if tree.op != "call":
        return _arithmetic(tree.op, *args) if tree.op in "+-*/^" else _compare(tree.op, *args)
    name = tree.value
    if name in X.ARITY and not X.ARITY[name][0] <= len(args) <= X.ARITY[name][1]:
        return Value("blank", None, F.lit("#VALUE!"))
    if name == "IF":
        b, e = boolean(args[0])
        return _choose(b, e, args[1], args[2] if len(args) == 3 else Value("b", F.lit(False)))
    if name == "NOT":
        b, e = boolean(args[0])
        return Value("b", ~b, e)
    if name == "ABS":
        x, e = number(args[0])
        return Value("n", F.abs(x), e)
    if name == "ROUND" and tree.args[1].op == "lit" and isinstance(tree.args[1].value, float) and abs(tree.args[1].value) <= 308:
        from gridloom.operators.formulas import excel_round

        x, e = number(args[0])
        out = excel_round(x, int(tree.args[1].value))
        return Value("n", out, _first(e, _unfinite(out)))
    if name == "CONCAT":
        return Value("s", F.concat(F.lit(""), *[text(a) for a in args]), _first(*[a.err for a in args]))
    if name in ("AND", "OR"):
        return _logical(name, tree.args, args)
    raise X.FormulaError("unsupported")


def compile_row(formula: str, columns: dict[int, tuple[Column | str, Column]]) -> dict[str, Column]:
    """A formula over row 1 (A1, B1, ...) as Columns t, vn, vs, vb; an error has t e and its text in vs. ``columns``: (kind, value)
    of each column number; a kind that is the same for all rows is a string: n, s or b."""
    row = {}
    for c, (t, v) in columns.items():
        if isinstance(t, str):
            row[c] = Value(t, v.cast({"n": "double", "s": "string", "b": "boolean"}[t]))
        else:
            tag = F.when(v.isNotNull() & (t != "e"), t)
            row[c] = Value("any", None, F.when(t == "e", v.cast("string")), tag, F.when(t == "n", v.try_cast("double")), F.when(t == "s", v.cast("string")), F.when(t == "b", v.try_cast("boolean")))
    out = compile_tree(X.parse(formula), row)
    t, vn, vs, vb = out.parts()
    if out.err is None:
        return {"t": t, "vn": vn, "vs": vs, "vb": vb}
    fine = out.err.isNull()
    return {"t": F.when(fine, t).otherwise(F.lit("e")), "vn": F.when(fine, vn), "vs": F.coalesce(out.err, vs), "vb": F.when(fine, vb)}
