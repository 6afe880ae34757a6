import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from calibrix.functions.numeric import (accuracy_pct, ieee_div, inverse_predict, nan_null,
                                        round_half_even, strict_mean, with_signif)


def one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("v")).collect()]


def test_ieee_div(spark):
    got = one(spark, ieee_div("a", "b"),
              [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, None), (None, 0.0), (6.0, 3.0),
               (float("inf"), float("inf"))], "a double, b double")
    assert got[0] == math.inf and got[1] == -math.inf
    assert got[2] is None and got[3] is None and got[4] is None
    assert got[5] == 2.0 and got[6] is None


def test_nan_null(spark):
    got = one(spark, nan_null("a"), [(float("nan"),), (1.5,), (None,)], "a double")
    assert got == [None, 1.5, None]


def test_strict_mean(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 1.0), (2, None)], "g int, x double")
    got = dict(df.groupBy("g").agg(strict_mean("x").alias("m")).collect())
    assert got == {1: 2.0, 2: None}
    got = dict(df.groupBy("g").agg(strict_mean("x", F.col("x") > 10).alias("m")).collect())
    assert got == {1: None, 2: None}  # empty group -> missing


@pytest.mark.parametrize("m,t,acc", [(1.0, 1.0, 100.0), (1.2, 1.0, 80.0), (0.8, 1.0, 120.0),
                                     (2.0, 1.0, 0.0), (3.0, 1.0, 100.0)])
def test_accuracy_mirrored(spark, m, t, acc):
    got = one(spark, accuracy_pct("m", "t"), [(m, t)], "m double, t double")[0]
    assert got == pytest.approx(acc, abs=1e-9)


def test_accuracy_zero_target(spark):
    got = one(spark, accuracy_pct("m", "t"), [(1.0, 0.0), (0.0, 0.0)], "m double, t double")
    assert got == [math.inf, None]


def test_inverse_predict_keeps_negatives(spark):
    got = one(spark, inverse_predict("r", "b", "s", "c"), [(0.05, 0.1, 2.0, 5.0)],
              "r double, b double, s double, c double")[0]
    assert got == pytest.approx(-0.125)


def test_round_half_even(spark):
    got = one(spark, round_half_even("x", 0), [(2.5,), (3.5,), (-2.5,), (None,)], "x double")
    assert got == [2.0, 4.0, -2.0, None]


def exact_round(x, digits):
    """Half to even on the exact value, in rational arithmetic."""
    return float(Fraction(round(Fraction(x) * 10**digits), 10**digits))


def exact_signif(x, digits):
    k = math.floor(math.log10(abs(x))) - (digits - 1)
    scaled = Fraction(x) / Fraction(10)**k
    return float(round(scaled) * Fraction(10)**k)


def near_ties(digits, n=4000):
    """Doubles next to decimal ties: the nearest to a tie and its neighbours."""
    rng, out = random.Random(digits), []
    for _ in range(n):
        x = (2 * rng.randrange(10 ** rng.randint(1, 9)) + 1) / (2 * 10**digits) * rng.choice([1, -1])
        out += [x, math.nextafter(x, math.inf), math.nextafter(x, -math.inf), rng.uniform(-1e6, 1e6)]
    return out


@pytest.mark.parametrize("digits", range(5))
def test_round_goes_by_the_binary_value(spark, digits):
    xs = [*near_ties(digits), 0.0, 1e15 + 0.5, 2.0**53 + 2, 1e300, -1e300, 5e-324, math.inf, None,
          2.675, 0.15, 1.005, 0.285, 1.115]
    got = one(spark, round_half_even("x", digits), [(x,) for x in xs], "x double")
    for x, y in zip(xs, got, strict=True):
        assert y == (x if x is None or math.isinf(x) else exact_round(x, digits)), x


def test_known_ties(spark):
    for x, digits, y in ((2.675, 2, 2.67), (0.15, 1, 0.1), (1.005, 2, 1.0), (2.5, 0, 2.0), (0.125, 2, 0.12), (0.375, 2, 0.38)):
        assert one(spark, round_half_even("x", digits), [(x,)], "x double") == [y]


def signif(spark, xs, digits):
    df = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    return [r.y for r in with_signif(df, {"y": ("x", digits)}).select("y").collect()]


@pytest.mark.parametrize("digits", [2, 4])
def test_signif_goes_by_the_binary_value(spark, digits):
    rng = random.Random(7)
    xs = [(2 * rng.randrange(10 ** (digits - 1), 10**digits) + 1) / 2 * 10.0 ** rng.randint(-6, 9) for _ in range(4000)]
    xs += [math.nextafter(x, s * math.inf) for x in xs[:1000] for s in (1, -1)]
    got = signif(spark, xs, digits)
    for x, y in zip(xs, got, strict=True):
        assert y == pytest.approx(exact_signif(x, digits), rel=1e-14), x


def test_signif(spark):
    assert signif(spark, [66.5, 0.0, 123456.0, None, math.inf], 2) == [66.0, 0.0, 120000.0, None, math.inf]
    assert signif(spark, [0.99876543], 4) == [pytest.approx(0.9988)]
