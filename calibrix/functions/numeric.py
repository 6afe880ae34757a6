"""Column expressions with the method scripts' arithmetic.

The scripts compute in IEEE doubles: x/0 is +-Inf, 0/0 is NaN, and NaN then
behaves as "missing" everywhere (dropped by predicates, sorted last, poisoning
means). Spark in ANSI mode raises on x/0 and treats NaN as a value that is
greater than everything, so the engine creates infinities explicitly and turns
every NaN into NULL where it is created. After that all logic is NULL logic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _pos_inf() -> Column:
    return F.lit(float("inf"))


def _neg_inf() -> Column:
    return F.lit(float("-inf"))


def _null_d() -> Column:
    return F.lit(None).cast("double")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_null(x) -> Column:
    """NaN -> NULL (NULL and finite/infinite values pass through)."""
    return F.nanvl(_c(x), _null_d())


def ieee_div(a, b) -> Column:
    """a / b with IEEE results for a zero divisor: +-Inf, and 0/0 -> NULL.

    The divisor is tested explicitly so that a NULL divisor gives NULL, never
    Inf; Inf/Inf (NaN) becomes NULL too.
    """
    a, b = _c(a), _c(b)
    return nan_null(
        F.when(b != 0, a / b)
        .when((b == 0) & (a > 0), _pos_inf())
        .when((b == 0) & (a < 0), _neg_inf())
    )


def is_infinite(x) -> Column:
    return F.abs(_c(x)) == _pos_inf()


def strict_mean(x, where: Column | None = None) -> Column:
    """Mean that is NULL as soon as one value in the group is missing.

    ``where`` restricts the group (conditional aggregate); an empty group gives
    NULL. Partial-aggregatable: only count and avg are used.
    """
    x = _c(x)
    if where is not None:
        x = F.when(where, x)
        n_rows = F.count(F.when(where, F.lit(1)))
    else:
        n_rows = F.count(F.lit(1))
    return nan_null(F.when(F.count(x) == n_rows, F.avg(x)))


def inverse_predict(ratio, intercept, slope, intstd_conc) -> Column:
    """Back-calculated concentration ((ratio - intercept) / slope) * intstd_conc.

    The operation order is the scripts' and is kept for bit-equality.
    """
    return nan_null(ieee_div(_c(ratio) - _c(intercept), slope) * _c(intstd_conc))


def accuracy_pct(measured, target) -> Column:
    """abs((((M - T) / T) * 100) - 100), as written by the scripts.

    This is |100*M/T - 200|: M = T gives 100, M = 1.1 T gives 90, M = 2 T gives
    0 and M = 3 T gives 100 again. The mirrored scale is the scripts' and is
    reproduced, not corrected.
    """
    m, t = _c(measured), _c(target)
    return nan_null(F.abs(ieee_div(m - t, t) * 100 - 100))


# 2^27 + 1 splits a double into two halves whose products are exact.
_SPLIT = 134217729.0
# From here on every double is a whole number.
_WHOLE = float(1 << 52)


def _product_error(a: Column, b: Column, product: Column) -> Column:
    """a * b - product without a rounding error (Dekker's exact product)."""
    def halves(x):
        high = F.lit(_SPLIT) * x - (F.lit(_SPLIT) * x - x)
        return high, x - high

    ah, al = halves(a)
    bh, bl = halves(b)
    return ((ah * bh - product) + ah * bl + al * bh) + al * bl


def _nearest_whole(p: Column, error: Column) -> Column:
    """The whole number nearest to p + error, ties to even; ``error`` is what p
    lost in rounding, so it only matters where p is halfway."""
    return (F.when(F.abs(p) - F.floor(F.abs(p)) == 0.5, F.when(error > 0, F.ceil(p).cast("double"))
                   .when(error < 0, F.floor(p).cast("double")).otherwise(F.rint(p)))
            .otherwise(F.rint(p)))


def round_half_even(x, digits: int = 0) -> Column:
    """R's round(): to the nearer of the two neighbouring decimals by the exact
    (binary) value of x, ties to even. 2.675 lies below its tie and gives 2.67;
    ``bround`` goes by the shortest decimal text and gives 2.68."""
    x = _c(x)
    scale = F.lit(10.0 ** digits)
    p = x * scale
    rounded = _nearest_whole(p, _product_error(x, scale, p)) / scale
    return F.when(F.abs(p) < _WHOLE, rounded).otherwise(x)


def with_signif(df: DataFrame, values: dict[str, tuple[str, int]]) -> DataFrame:
    """``df`` with R's signif(x, digits) of columns x: name -> (x, digits). Rounds
    to so many significant digits by the exact value of x, ties to even; 0 stays
    0, NULL and infinities pass through.

    The parts are columns of their own, step by step: as one expression each
    would hold copies of all before it.
    """
    part = {n: tuple(f"_signif_{i}_{c}" for c in "kudpqb") for i, n in enumerate(values)}
    steps = [lambda x, d, k, *_: {k: F.floor(F.log10(F.abs(x))) - F.lit(d - 1)},
             lambda x, d, k, u, w, *_: {u: F.pow(F.lit(10.0), -F.col(k)), w: F.pow(F.lit(10.0), F.col(k))},
             lambda x, d, k, u, w, p, q, b: {p: F.col(x) * F.col(u), q: F.col(x) / F.col(w)},
             lambda x, d, k, u, w, p, q, b: {b: F.col(q) * F.col(w)}]
    out = df
    for step in steps:
        out = out.withColumns({c: e for n, (x, d) in values.items() for c, e in step(x, d, *part[n]).items()})
    for n, (x, _) in values.items():
        k, u, w, p, q, b = map(F.col, part[n])
        small = _nearest_whole(p, _product_error(F.col(x), u, p)) / u
        # What the quotient lost: the sign of x - q * 10^k, found exactly.
        large = _nearest_whole(q, (F.col(x) - b) - _product_error(q, w, b)) * w
        out = out.withColumn(n, F.when(F.col(x) == 0, F.lit(0.0)).when(is_infinite(x), F.col(x))
                             .when(k > 0, large).otherwise(small))
    return out.drop(*(c for cs in part.values() for c in cs))
