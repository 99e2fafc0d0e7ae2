import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.functions import numfmt as N

CASES = [
    ("#,##0.00", 12410.5, "12,410.50"), ("#,##0 ;[Red](#,##0)", -1234.5, "(1,235)"), ("0.0%", 0.125, "12.5%"),
    ("0.00E+00", 1234.5, "1.23E+03"), ("##0.0E+0", 12345, "12.3E+3"), ("# ?/?", 1234.5, "1234 1/2"),
    ("# ??/??", 0.25, "  1/4 "), ("# ?/8", 1.25, "1 2/8"), ("00000\\-0000", 1234567890, "123456-7890"), ("#.##", 0.25, ".25"),
    ('#,##0,,"M"', 123456789, "123M"), ("yyyy-mm-dd ddd", 59, "1900-02-28 Tue"), ("yyyy-mm-dd ddd", 60, "1900-02-29 Wed"),
    ("yyyy-mm-dd ddd", 61, "1900-03-01 Thu"), ("[h]:mm:ss", 1.5, "36:00:00"), ("mmss.000", 0.5432199, "0214.199"),
    ("General", 0.1 + 0.2, "0.3"), ("General", 123456789012, "1.2345678901E+11"), ("General", 1e-10, "1E-10"),
    ("h:mm AM/PM", 0.75, "6:00 PM"), ("@", 5, "5"), ('0;;"zero"', 0, "zero"), ("[>100]0.0;0", 7.6, "8"),
]


@pytest.mark.parametrize("code,value,want", CASES)
def test_vectors(code, value, want):
    assert N.render(code, value) == want


def test_epoch_1904_and_kinds():
    assert N.render("yyyy-mm-dd dddd", 0, epoch_1904=True) == "1904-01-01 Friday"
    assert [N.date_kind(c) for c in ("yyyy", "[h]:mm", "0.0", '"day"0')] == ["date", "duration", "other", "other"]
    assert N.render("yyyy", -1) is None
    assert N.render("0", "text") == "text" and N.render("0;0;0;<@>", "x") == "<x>"
    assert N.render("0", True) == "TRUE" and N.render("0", "#N/A", error=True) == "#N/A"


@pytest.mark.parametrize("serial", [0.0, 1.0, 59.0, 60.0, 61.0, 44000.5, 44000.123])
def test_iso_round_trip(serial):
    assert math.isclose(N.iso_to_serial(N.serial_to_iso(serial)), serial, abs_tol=1e-8)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='0#?.,;%/E+-@[]"\\_* ymdhsAP$<>1GenralRd', max_size=14), st.floats(-1e13, 1e13))
def test_junk_codes_never_fail(code, value):
    out = N.render(code, value)
    assert out is None or isinstance(out, str)


def test_columns_agree_with_render(spark):
    from pyspark.sql import functions as F

    from gridloom.functions.display import format_column

    rng = random.Random(3)
    values = [0.0, 0.5, 1.5, 2.5, -2.5, 0.125, 1e12, -1e-4, 61.0, 45000.25] + [rng.uniform(-1e6, 1e6) for _ in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    codes = ["0", "0.00", "#,##0.0", "0.0%", "#,##0;(#,##0)", "yyyy-mm-dd", "d mmm yy", "# ?/?", "General"]
    rows = df.select("v", *[format_column(c, F.col("v")).alias(f"k{i}") for i, c in enumerate(codes)]).collect()
    for r in rows:
        for i, c in enumerate(codes):
            assert r[f"k{i}"] == N.render(c, r["v"]), (c, r["v"])
