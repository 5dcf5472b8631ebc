import random

import pytest
from pyspark.sql import functions as F

from cubeloom.errors import CubeError
from cubeloom.functions import fixed


@pytest.mark.parametrize("text,value", [("1", 10000), (" -2.5 ", -25000), (".5", 5000), ("5.", 50000), (".", 0), ("+0.0001", 1)])
def test_parse(text, value):
    assert fixed.parse(text) == value


@pytest.mark.parametrize("text", ["", " ", "1e3", "1.00001", "a", "1.2.3", "-", "9" * 30])
def test_parse_refuses(text):
    with pytest.raises(CubeError):
        fixed.parse(text)


def test_format_round_trip():
    for v in (0, 1, -1, 10000, -12500, 123456789, 2**62):
        assert fixed.parse(fixed.format(v)) == v
    assert fixed.format(-12500) == "-1.25" and fixed.format(100000) == "10"


def test_columns_match_integers(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(-10**9, 10**9), rng.choice([1, 3, 7, 20000, -40000, rng.randint(1, 10**7)])) for _ in range(300)]
    pairs += [(25000, 20000), (5, 20000), (15, 20000), (-5, 20000), (fixed.HIGHEST, 1), (fixed.HIGHEST, 20000), (7, 0)]
    rows = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", fixed.product(F.col("a"), F.col("b")).alias("p"), fixed.quotient(F.col("a"), F.col("b")).alias("q")).collect()
    for r in rows:
        p = fixed.div_half_even(r["a"] * r["b"], fixed.SCALE)
        assert r["p"] == (p if abs(p) < fixed.HIGHEST - 2 else None)
        if r["b"]:
            q = fixed.div_half_even(r["a"] * fixed.SCALE, r["b"])
            assert r["q"] == (q if abs(q) < fixed.HIGHEST - 2 else None)
        else:
            assert r["q"] is None


def test_text_columns(spark):
    texts = ["1", "-2.5", ".5", "5.", "1.00001", "x", "", "0.1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fixed.parsed(F.col("t")).alias("v")).collect()
    for r in rows:
        try:
            want = fixed.parse(r["t"])
        except CubeError:
            want = None
        assert r["v"] == want, r
    shown = spark.createDataFrame([(v,) for v in (0, 1, -12500, 100000, 123)], "v bigint").select("v", fixed.formatted(F.col("v")).alias("t")).collect()
    assert all(r["t"] == fixed.format(r["v"]) for r in shown)


def test_intermediate_sums_cannot_overflow(spark):
    rows = spark.createDataFrame([(fixed.HIGHEST,), (fixed.HIGHEST,), (-fixed.HIGHEST,)], "v bigint")
    assert rows.agg(fixed.narrowed(fixed.total(F.col("v")))).first()[0] == fixed.HIGHEST
