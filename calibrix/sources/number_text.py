"""Text of doubles as the scripts' result writer gives it.

That writer prints the shortest digits that read back as the same double, found
with 64-bit arithmetic only (Grisu3: F. Loitsch, "Printing floating-point
numbers quickly and accurately with integers", PLDI 2010). For about one double
in 200 that arithmetic cannot prove its digits shortest; the writer then prints
17 significant digits. ``proven_shortest`` says which case a double is.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import cache

_BITS = 64
# Exponents that a scaled boundary may have, and the step between
# the decimal powers that the writer keeps (from 10^-348 up).
_LOW, _HIGH, _STEP, _FIRST, _LAST = -60, -32, 8, -348, 340


@cache
def _power(k: int) -> tuple[int, int]:
    """10^k as a 64-bit significand (rounded) and a binary exponent."""
    exact = Fraction(10) ** k
    e = math.floor(math.log2(10) * k) - _BITS + 1
    while exact >= Fraction(2) ** (e + _BITS):
        e += 1
    while exact < Fraction(2) ** (e + _BITS - 1):
        e -= 1
    f = round(exact / Fraction(2) ** e)
    return (f, e) if f < 1 << _BITS else (f >> 1, e + 1)


@cache
def _scale(e: int) -> tuple[int, int]:
    """The kept power that brings exponent ``e`` into the range."""
    for k in range(_FIRST, _LAST + 1, _STEP):
        if _LOW <= _power(k)[1] + e + _BITS:
            return _power(k)
    raise OverflowError(e)


def _times(a: int, b: int) -> int:
    return (a * b + (1 << _BITS - 1)) >> _BITS


def proven_shortest(x: float) -> bool:
    """Do 64 bits suffice to prove the shortest digits of ``x`` (finite, > 0)?"""
    m, e = math.frexp(x)
    f, e = int(m * (1 << 53)), e - 53
    if e < -1074:  # subnormal
        f, e = f >> (-1074 - e), -1074
    # Halfway to the neighbours, on the exponent of the normalised upper one.
    high, low = 2 * f + 1, 2 * f - 1
    low_e = e - 1
    if f == 1 << 52 and e > -1074:
        low, low_e = 4 * f - 1, e - 2
    up = _BITS - high.bit_length()
    top = e - 1 - up
    high, low, mid = high << up, low << low_e - top, f << e - top
    c, ce = _scale(top)
    high, low, mid = _times(high, c), _times(low, c), _times(mid, c)
    shift = -(top + ce + _BITS)
    too_low, too_high, unit = low - 1, high + 1, 1
    unsafe = too_high - too_low
    whole, rest = too_high >> shift, too_high & (1 << shift) - 1
    kappa = len(str(whole)) if whole else 0
    while kappa:
        ten = 10 ** (kappa - 1)
        digit, whole = divmod(whole, ten)
        kappa -= 1
        left = (whole << shift) + rest
        if left < unsafe:
            return _settled(digit, too_high - mid, unsafe, left, ten << shift, unit)
    one = 1 << shift
    while True:
        rest, unit, unsafe = rest * 10, unit * 10, unsafe * 10
        digit, rest = rest >> shift, rest & one - 1
        if rest < unsafe:
            return _settled(digit, (too_high - mid) * unit, unsafe, rest, one, unit)


def _settled(digit: int, distance: int, unsafe: int, rest: int, ten: int, unit: int) -> bool:
    """Lower the last digit towards the double; is the result certain?"""
    near, far = distance - unit, distance + unit
    while rest < near and unsafe - rest >= ten and (rest + ten < near or near - rest >= rest + ten - near):
        rest += ten
    if rest < far and unsafe - rest >= ten and (rest + ten < far or far - rest > rest + ten - far):
        return False
    return 2 * unit <= rest <= unsafe - 4 * unit


def number_text(x: float | None) -> str:
    """A result file's text of ``x``: NA, Inf, whole numbers without a point,
    else the shortest digits, or 17 where they are not proven shortest."""
    if x is None or math.isnan(x):
        return "NA"
    if math.isinf(x):
        return "Inf" if x > 0 else "-Inf"
    if x == math.floor(x) and abs(x) < 1e15:
        return str(int(x))
    return repr(x) if proven_shortest(abs(x)) else f"{x:.17g}"
