"""Queries of the formula language, its evaluation and the number formats over small fixed inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.functions import display, numfmt
from gridloom.functions import formula as X
from gridloom.operators import formulas
from gridloom.plans import samples
from gridloom.plans.twins import expects
from gridloom.plans.workbook_queries import tables
from gridloom.session import ready

RESULT = "formula string, t string, vn double, vs string, vb boolean"
_CELLS = "workbook string, sheet int, r int, c int, t string, vn double, vs string, vb boolean, f string, fmt string"


def n(f: str, v: float) -> tuple:
    return (f, "n", float(v), None, None)


def s(f: str, v: str) -> tuple:
    return (f, "s", None, v, None)


def b(f: str, v: bool) -> tuple:
    return (f, "b", None, None, v)


def e(f: str, v: str) -> tuple:
    return (f, "e", None, v, None)


def evaluates(name: str, *rows: tuple):
    """Register the evaluation of formulas on a sheet with A1 = 2, A2 = "3", A3 = TRUE, A4 blank, A5 = "x"."""

    def run(spark) -> DataFrame:
        ready(spark)
        cells = [("w", 0, 0, 0, "n", 2.0, None, None, None, None), ("w", 0, 1, 0, "s", None, "3", None, None, None), ("w", 0, 2, 0, "b", None, None, True, None, None), ("w", 0, 4, 0, "s", None, "x", None, None, None)]
        cells += [("w", 0, k, 9, "n", None, None, None, r[0], None) for k, r in enumerate(rows)]
        held = spark.createDataFrame(cells, _CELLS)
        sheets = spark.createDataFrame([("w", 0, "Sheet1")], "workbook string, sheet int, name string")
        done = formulas.evaluate_books(held, sheets).drop("workbook", "sheet", "d", "e")
        return held.filter("c = 9").select("r", F.col("f").alias("formula")).join(done.filter("c = 9").drop("c"), "r")

    expects(name, RESULT, list(rows))(run)


evaluates("formula_numbers", n("A1+1", 3), n("A2+1", 4), n("A3+1", 2), n("A4+1", 1), e("A5+1", "#VALUE!"), n('"2.5"+1', 3.5), e('"1,5"+1', "#VALUE!"))
evaluates("formula_booleans", b("AND(A3)", True), b("AND(2)", True), b("AND(0)", False), b('OR("true",FALSE)', True), e('OR("x")', "#VALUE!"))
evaluates("formula_texts", s('""&A1', "2"), s('""&A3', "TRUE"), s('""&A4', ""), s('""&0.1', "0.1"), s('10^20&""', "100000000000000000000"), e('""&1/0', "#DIV/0!"))
evaluates("formula_unary", n("-A1", -2), n("-A2", -3), n("-2^2", 4), n("50%", 0.5), n("A1%%", 0.0002), e("-A5", "#VALUE!"), s('+"a"', "a"))
evaluates("formula_binary", n("1+2*3^2-4/2", 17), n("2^3^2", 512), n("A1-A2", -1), e("A1/A4", "#DIV/0!"), e("9^999", "#NUM!"), n("(1+2)*3", 9))
evaluates("formula_concat_op", s('"a"&1&TRUE', "a1TRUE"), s('A4&"x"', "x"), s("A1&A2", "23"), e('"a"&1/0', "#DIV/0!"))
evaluates("formula_compare", b('1<"a"', True), b('"B"="b"', True), b("TRUE>9", True), b("A4=0", True), b('A4=""', True), b("A1<>2", False), b("A1>=2", True), b('"a"<"b"', True), e("1/0=1", "#DIV/0!"))
evaluates("formula_sum", n('SUM(A1:A5,TRUE,"4")', 7), n("SUM(A1:A5)", 2), n("SUM()", 0), e("SUM(1/0,1)", "#DIV/0!"), n('SUM("x")', 0))
evaluates("formula_average_of", n("AVERAGE(A1:A5,4)", 3), e("AVERAGE(A4:A5)", "#DIV/0!"), n("AVERAGE(1,2)", 1.5))
evaluates("formula_counts", n('COUNT(A1:A5,TRUE,"4")', 3), n("COUNTA(A1:A5)", 4), n("COUNT(A5)", 0), n("COUNTA(1/0)", 1))
evaluates("formula_extremes", n("MIN(A1:A5,4)", 2), n("MAX(A1:A5,4)", 4), n("MIN(A4:A5)", 0), n("MAX(-1,-2)", -1))
evaluates("formula_if", n("IF(1,2)", 2), b("IF(0,2)", False), n("IF(1,2,1/0)", 2), s('IF(A1>3,1,"no")', "no"), e("IF(A5,1)", "#VALUE!"), n('IF("TRUE",1)', 1))
evaluates("formula_logic", b("AND(TRUE,1,A1)", True), b("OR(FALSE,0,A3)", True), b("AND(A1:A3,FALSE)", False), e("AND(A5)", "#VALUE!"), e("OR(A4)", "#VALUE!"))
evaluates("formula_not", b("NOT(0)", True), b("NOT(A3)", False), e("NOT(A5)", "#VALUE!"), e("NOT()", "#VALUE!"))
evaluates("formula_round", n("ROUND(2.675,2)", 2.68), n("ROUND(-2.5,0)", -3), n("ROUND(1234.5,-2)", 1200), n("ROUND(0.049999999999999975,1)", 0.1), n("ROUND(A1/3,2)", 0.67))
evaluates("formula_abs", n("ABS(-3)", 3), n("ABS(A2)", 3), e("ABS(A5)", "#VALUE!"), n("ABS(A4)", 0))
evaluates("formula_concat", s('CONCAT(A1:A3,"!")', "23TRUE!"), s("_xlfn.CONCAT(1,2)", "12"), s("CONCAT(A4)", ""), e('CONCAT("a",1/0)', "#DIV/0!"))
evaluates("formula_result_types", n("A1", 2), s("A2", "3"), b("A3", True), n("A4", 0), s("A5", "x"), e("1/0", "#DIV/0!"))
evaluates("formula_errors", e("1/0", "#DIV/0!"), e("A5*1", "#VALUE!"), e("9^999", "#NUM!"), e("(1/0)+A5", "#DIV/0!"), b("IF(FALSE,1/0)", False))
evaluates("formula_references", n("$A$1*Sheet1!A1", 4), n("sheet1!$A1+A$1", 4), n("SUM(A2:A1)", 2), n("SUM(Sheet1!A1:A1)", 2))


@expects(
    "formula_supported", "formula string, supported boolean",
    [
        ("SUM(A1:B2)", True), ("VLOOKUP(1,A1:B2,1)", False), ("A1:B2", False), ("ABS(A1:A2)", False), ("1+", False), ("{1}", False), ("Nope!A1", False), ("(" * 300 + "1" + ")" * 300, False), ("SUM(1,)", False),
        ('IF(A1>1,"a","b")', True), ("XFE1", False), ("A1048577", False), ("1" + "+1" * 5000, False), ("a b", False), ("'my sheet'!A1", True),
    ],
)
def formula_supported(spark):
    """Which formulas are evaluated: known functions, ranges only inside aggregates, within the limits of length and depth."""
    texts = ["SUM(A1:B2)", "VLOOKUP(1,A1:B2,1)", "A1:B2", "ABS(A1:A2)", "1+", "{1}", "Nope!A1", "(" * 300 + "1" + ")" * 300, "SUM(1,)", 'IF(A1>1,"a","b")', "XFE1", "A1048577", "1" + "+1" * 5000, "a b", "'my sheet'!A1"]
    return [(t, X.is_supported(t, {"sheet1": 0, "my sheet": 1})) for t in texts]


@expects("formula_junk", "refused long, raised long", [(400, 0)])
def formula_junk(spark):
    """Random text is refused or evaluated, never a crash."""
    import random

    rng, seen, raised = random.Random(1), 0, 0
    for _ in range(400):
        text = "".join(rng.choice("A1B2$:!,()+-*/^&=<>%\" 'SUMIF.0eT{;") for _ in range(rng.randint(0, 24)))
        try:
            X.evaluate(X.parse(text), lambda at: 2.0)
            seen += 1
        except X.FormulaError:
            seen += 1
        except Exception:  # what the query counts
            raised += 1
    return [(seen, raised)]


@expects("formula_dependencies", "formula string, sheet int, r0 int, c0 int, r1 int, c1 int", [("A1+$B$2", 0, 0, 0, 0, 0), ("A1+$B$2", 0, 1, 1, 1, 1), ("SUM(C3:A1,Other!D4)", 0, 0, 0, 2, 2), ("SUM(C3:A1,Other!D4)", 1, 3, 3, 3, 3)])
def formula_dependencies(spark):
    """What a formula reads; ranges with their corners in order."""
    return [(t, x.sheet, x.r0, x.c0, x.r1, x.c1) for t in ("A1+$B$2", "SUM(C3:A1,Other!D4)") for x in X.references(X.parse(t, 0, {"other": 1}))]


@expects("formula_translate", "formula string, dr int, dc int, moved string", [("A1+$A1+A$1+$A$1", 2, 1, "B3+$A3+B$1+$A$1"), ('"A1"&A1', 1, 0, '"A1"&A2'), ("SUM(B2:C3)", 1, 1, "SUM(C3:D4)"), ("A1", -1, 0, "#REF!"), ("LOG10(A1)", 1, 0, "LOG10(A2)")])
def formula_translate(spark):
    return [(t, dr, dc, X.translate(t, dr, dc)) for t, dr, dc in (("A1+$A1+A$1+$A$1", 2, 1), ('"A1"&A1', 1, 0), ("SUM(B2:C3)", 1, 1), ("A1", -1, 0), ("LOG10(A1)", 1, 0))]


@expects("formula_text_normal", "text string, normal string", [("=A1", "A1"), ("of:=[.A1]", "[.A1]"), ("_xlfn.CONCAT(1)", "_xlfn.CONCAT(1)"), ("", None), (None, None)])
def formula_text_normal(spark):
    return [(t, X.normalize_text(t)) for t in ("=A1", "of:=[.A1]", "_xlfn.CONCAT(1)", "", None)]


def _evaluated(spark, contents, **options) -> DataFrame:
    got = tables(spark, contents)
    return formulas.evaluate_books(got.cells, got.sheets, got.workbooks, **options)


@expects("evaluate_at_open", "workbook string, sheet int, r int, c int, t string, vn double, vs string, vb boolean, d string", [("f.xlsx", 0, 0, 1, "n", 4.0, None, None, "4.00"), ("f.xlsx", 0, 0, 2, "n", 5.0, None, None, None), ("s.xlsx", 0, 0, 2, "n", 11.0, None, None, None), ("s.xlsx", 0, 1, 2, "n", 13.0, None, None, None), ("s.xlsx", 0, 2, 2, "n", 15.0, None, None, None), ("s.xlsx", 1, 0, 0, "n", 16.0, None, None, None), ("s.xlsx", 1, 0, 1, "b", None, None, True, None)])
def evaluate_at_open(spark):
    """Two workbooks, each by its own sheet names: supported formulas have results, the others none."""
    return _evaluated(spark, {"f.xlsx": samples.formula_book(), "s.xlsx": samples.shared_formula_book()})


@expects("unevaluated_counts", "workbook string, sheet int, n long", [("f.xlsx", 0, 1), ("r.xlsx", 0, 1)])
def unevaluated_counts(spark):
    got = tables(spark, {"f.xlsx": samples.formula_book(), "r.xlsx": samples.reader_book(), "s.xlsx": samples.shared_formula_book()})
    return formulas.unevaluated(got.cells, formulas.evaluate_books(got.cells, got.sheets, got.workbooks))


@expects("evaluation_budget", "budget_ms double, evaluated long, skipped long, warned boolean", [(0.0, 0, 200, True), (60000.0, 200, 0, False)])
def evaluation_budget(spark):
    """A budget of nothing leaves all results as they were; a large one leaves none out."""
    cells = [(0, 0, 0, "n", 1.0, None, None), *((0, r, 0, "n", 1.0, f"A{r}+1", None) for r in range(1, 201))]
    book = formulas.Book(cells, ["S"], budget_ms=60_000)
    out = []
    for ms in (0.0, 60_000.0):
        got = book.recalc([(0, 0, 0, 5.0, None)], budget_ms=ms)
        out.append((ms, got.evaluated, got.skipped, bool(got.warnings)))
    return out


def _book() -> formulas.Book:
    return formulas.Book([(0, 0, 0, "n", 2.0, None, "0.0"), (0, 0, 1, "n", 4.0, "A1*2", "0.00"), (0, 0, 2, "n", 5.0, "B1+1", None), (0, 1, 0, "n", 1.0, "A3", None), (0, 2, 0, "n", 1.0, "A2", None), (0, 3, 0, "n", 1.0, "A2+1", None), (0, 9, 9, "d", "2024-02-29", None, "yyyy")], ["Sheet1"])


CHANGED = "sheet int, r int, c int, t string, vn double, vs string, vb boolean, d string, e boolean"


def _changed(edits) -> list[tuple]:
    got = _book().recalc(edits)
    return [formulas._row(None, at, x)[1:] for at, x in got.changed]


@expects("recalc_changed", CHANGED, [(0, 0, 0, "n", 4.0, None, None, "4.0", False), (0, 0, 1, "n", 8.0, None, None, "8.00", True), (0, 0, 2, "n", 9.0, None, None, None, True)])
def recalc_changed(spark):
    """The last edit of a cell counts; what reads it, and what reads that, is in the set with the literal."""
    return _changed([(0, 0, 0, 3, None), (0, 0, 0, 4, None)])


@expects("recalc_cycles", "place string, before string, after double", [("A2", "#CYCLE!", 7.0), ("A3", "#CYCLE!", 7.0), ("A4", "#CYCLE!", 8.0)])
def recalc_cycles(spark):
    """A literal in a cycle breaks it."""
    before = _book().base
    after = dict(_book().recalc([(0, 2, 0, 7, None)]).changed)
    return [(f"A{r + 1}", before[0, r, 0].v, after[0, r, 0].v) for r in (1, 2, 3)]


@expects("recalc_authored", CHANGED, [(0, 5, 5, "e", None, "#NAME?", None, "#NAME?", True), (0, 5, 6, "e", None, "#VALUE!", None, "#VALUE!", True), (0, 5, 7, "n", 6.0, None, None, "6", True), (0, 6, 0, "e", None, "#CYCLE!", None, "#CYCLE!", True), (0, 7, 0, "e", None, "#CYCLE!", None, "#CYCLE!", True)])
def recalc_authored(spark):
    """Authored formulas: an unknown function, one that cannot be read, a sound one, and two that read each other."""
    return _changed([(0, 5, 5, None, "=NOPE(A1)"), (0, 5, 6, None, "=1+"), (0, 5, 7, None, "=A1*3"), (0, 6, 0, None, "A8"), (0, 7, 0, None, "A7")])


@expects("recalc_priority", "source string, value double", [("edit", 11.0), ("result", 9.0), ("stored", 3.0), ("blank", 1.0)])
def recalc_priority(spark):
    """What a reference reads: an edit before a result before the file's value before nothing."""
    edits = [(0, 20, 0, 10.0, None), (0, 21, 0, None, "=A21+1"), (0, 0, 0, 4.0, None), (0, 22, 0, None, "=B1+1"), (0, 23, 0, None, "=J10*0+3"), (0, 24, 0, None, "=Z99+1")]
    got = dict(_book().recalc(edits).changed)
    return [(k, got[0, r, 0].v) for k, r in (("edit", 21), ("result", 22), ("stored", 23), ("blank", 24))]


@expects("recalc_changed_cap", "listed long, evaluated long, truncated boolean, warned boolean", [(50_000, 50_009, True, True)])
def recalc_changed_cap(spark):
    """A recalculation lists 50,000 changes at most and says how many more there are."""
    cells = [(0, 0, 0, "n", 1.0, None, None), *((0, r, 1, "n", 2.0, "A1+1", None) for r in range(50_009))]
    got = formulas.Book(cells, ["S"], budget_ms=600_000).recalc([(0, 0, 0, 5.0, None)])
    return [(len(got.changed), got.evaluated, got.truncated, any(str(50_010 - schema.MAX_CHANGED) in w for w in got.warnings))]


@expects("touched_cells", "r0 int, c0 int, r1 int, c1 int, touched boolean", [(0, 0, 0, 0, False), (1, 1, 3, 3, True), (5, 0, 9, 9, True), (6, 0, 9, 9, False), (0, 3, 9, 3, True), (0, 4, 9, 9, False)])
def touched_cells(spark):
    """Which ranges hold an edited cell, by rows and columns in order."""
    places = formulas.Places([(0, 2, 2), (0, 5, 3), (1, 0, 0)])
    return [(*box, places.touched(X.references(X.parse(f"SUM({_name(*box)})"))[0])) for box in ((0, 0, 0, 0), (1, 1, 3, 3), (5, 0, 9, 9), (6, 0, 9, 9), (0, 3, 9, 3), (0, 4, 9, 9))]


def _name(r0, c0, r1, c1) -> str:
    from gridloom.a1 import cell_name

    return f"{cell_name(r0, c0)}:{cell_name(r1, c1)}"


# Formats.


def displays(name: str, *rows: tuple[str, float, str | None]):
    """Register the displays of numbers under codes, by the column functions."""

    def run(spark) -> DataFrame:
        ready(spark)
        out = None
        for code in dict.fromkeys(r[0] for r in rows):
            held = spark.createDataFrame([(code, float(v)) for c, v, _ in rows if c == code], "code string, v double")
            shown = held.select("code", "v", display.format_column(code, F.col("v")).alias("d"))
            out = shown if out is None else out.unionByName(shown)
        return out

    expects(name, "code string, v double, d string", [(c, float(v), d) for c, v, d in rows])(run)


displays("fmt_decimals", ("#,##0.00", 12410.5, "12,410.50"), ("0.0%", 0.125, "12.5%"), ("#.##", 0.25, ".25"), ('#,##0,,"M"', 123456789.0, "123M"), ("0", 2.5, "3"), ("000", 7.0, "007"), ("0.00", -1.005, "-1.01" if round(1.005, 2) > 1 else "-1.00"))
displays("fmt_sections", ("#,##0 ;[Red](#,##0)", -1234.5, "(1,235)"), ("#,##0 ;[Red](#,##0)", 1234.4, "1,234 "), ('0;-0;"zero"', 0.0, "zero"), ("[>100]0.0;0.00", 150.0, "150.0"), ("[>100]0.0;0.00", 50.0, "50.00"))
displays("fmt_masks", ("00000\\-0000", 1234567890.0, "123456-7890"), ("(000) 000-0000", 5551234567.0, "(555) 123-4567"))
displays("fmt_exponents", ("0.00E+00", 1234.5, "1.23E+03"), ("##0.0E+0", 12345.0, "12.3E+3"), ("0.00E+00", 0.00012, "1.20E-04"))
displays("fmt_fractions", ("# ?/?", 1234.5, "1234 1/2"), ("# ??/??", 0.25, "  1/4 "), ("# ?/8", 1.25, "1 2/8"))
displays("fmt_dates", ("yyyy-mm-dd ddd", 59.0, "1900-02-28 Tue"), ("yyyy-mm-dd ddd", 60.0, "1900-02-29 Wed"), ("yyyy-mm-dd ddd", 61.0, "1900-03-01 Thu"), ("[h]:mm:ss", 1.5, "36:00:00"), ("mmss.000", 0.5432199, "0214.199"), ("d mmmm yyyy", 45351.0, "29 February 2024"))
displays("fmt_generals", ("General", 0.1 + 0.2, "0.3"), ("General", 123456789012.0, "1.2345678901E+11"), ("General", 1e-10, "1E-10"), ("General", 100.0, "100"), ("General", -0.5, "-0.5"))


@expects("fmt_texts", "code string, value string, d string", [("@", "a", "a"), ('0;0;0;"<"@">"', "a", "<a>"), ("0.00", "a", "a"), ('General" units"', "5", "5")])
def fmt_texts(spark):
    """Text under a code: its own section, else as it is."""
    return [(c, v, numfmt.render(c, v)) for c, v in (("@", "a"), ('0;0;0;"<"@">"', "a"), ("0.00", "a"), ('General" units"', "5"))]


@expects("fmt_general_literals", "code string, v double, d string", [('General" units"', 5.0, "5 units"), ('"n="General', 2.5, "n=2.5")])
def fmt_general_literals(spark):
    return [(c, v, numfmt.render(c, v)) for c, v in (('General" units"', 5.0), ('"n="General', 2.5))]


@expects("fmt_supported", "code string, supported boolean, kind string", [("0.00", True, "other"), ("yyyy-mm-dd", True, "date"), ("[h]:mm", True, "duration"), ("0.00;0;0;@;x", False, "other"), ("# ??/??", True, "other"), ("[$-409]d", True, "date")])
def fmt_supported(spark):
    return [(c, numfmt.is_supported(c), numfmt.date_kind(c)) for c in ("0.00", "yyyy-mm-dd", "[h]:mm", "0.00;0;0;@;x", "# ??/??", "[$-409]d")]


@expects("fmt_builtin", "number int, code string", [(0, "General"), (1, "0"), (2, "0.00"), (4, "#,##0.00"), (9, "0%"), (14, "mm-dd-yy"), (49, "@")])
def fmt_builtin(spark):
    return [(k, numfmt.BUILT_IN[k]) for k in (0, 1, 2, 4, 9, 14, 49)]


@expects("fmt_epochs", "serial double, epoch_1904 boolean, d string, iso string", [(0.0, True, "1904-01-01 Friday", "1904-01-01"), (1.0, False, "1900-01-01 Sunday", "1900-01-01"), (60.0, False, "1900-02-29 Wednesday", "1900-02-29")])
def fmt_epochs(spark):
    return [(v, x, numfmt.render("yyyy-mm-dd dddd", v, x), numfmt.serial_to_iso(v, x)) for v, x in ((0.0, True), (1.0, False), (60.0, False))]


@expects("number_texts", "v double, text string", [(1.0, "1"), (0.1, "0.1"), (1e21, "1000000000000000000000"), (1e-7, "0.0000001"), (-2.5, "-2.5")])
def number_texts(spark):
    return [(v, numfmt.shortest(v)) for v in (1.0, 0.1, 1e21, 1e-7, -2.5)]
