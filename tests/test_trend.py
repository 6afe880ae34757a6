"""The smoother against a direct numpy evaluation of the same definition."""

import math
import random

import numpy as np
import pytest

from calibrix.operators.trend import MARGIN, recovery_curve, recovery_trend


def brute(xs, ys, span=0.75, n=80):
    xs, ys = np.asarray(xs, float), np.asarray(ys, float)
    m = len(xs)
    q = int(math.floor(m * span))
    lo, hi = xs.min(), xs.max()
    step = (hi - lo) / (n - 1)
    out = []
    for j in range(n):
        v = lo if j == 0 else hi if j == n - 1 else lo + j * step
        d = np.abs(xs - v)
        h = np.sort(d)[q - 1]
        if h <= 0:
            out.append((v, None))
            continue
        u = (xs - v) / h
        w = np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0.0)
        X = np.vstack([np.ones(m), u, u * u]).T
        A = X.T @ (w[:, None] * X)
        b = X.T @ (w * ys)
        if abs(np.linalg.det(A)) <= 1e-10 * A[0, 0] ** 3:
            out.append((v, None))
        else:
            out.append((v, float(np.linalg.solve(A, b)[0])))
    return out


def test_trend_matches_brute_force(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for bid, n in [(1, 12), (2, 40), (3, 97)]:
        ys = []
        for pos in range(1, n + 1):
            y = 100 + 10 * math.sin(pos / 7) + rng.uniform(-5, 5)
            if pos % 11 == 5:
                y = None  # missing recovery keeps its position out of the fit
            rows.append((bid, pos + 3, y))
            ys.append(y)
        pts = [(i + 1, y) for i, y in enumerate(ys) if y is not None]
        expected[bid] = brute([p for p, _ in pts], [y for _, y in pts])
    df = spark.createDataFrame(rows, "BatchID long, RowIndex long, IS_Recovery double")
    got = {(r.BatchID, r.grid_index): (r.Order, r.IS_Recovery_Trend)
           for r in recovery_trend(df).collect()}
    assert len(got) == 240
    for bid, exp in expected.items():
        for j, (v, f) in enumerate(exp):
            gv, gf = got[(bid, j + 1)]
            assert gv == pytest.approx(v)
            if f is None:
                assert gf is None
            else:
                assert gf == pytest.approx(f, rel=1e-7, abs=1e-7)


def local_fit(xs, ys, v, q):
    """(fit, slope) at v, or None."""
    h = np.sort(np.abs(xs - v))[q - 1]
    if h <= 0:
        return None
    u = (xs - v) / h
    w = np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0.0)
    A = np.vstack([np.ones(len(xs)), u, u * u]).T
    N = A.T @ (w[:, None] * A)
    if np.linalg.det(N) <= 1e-10 * N[0, 0] ** 3:
        return None
    b = np.linalg.solve(N, A.T @ (w * ys))
    return b[0], b[1] / h


def brute_curve(xs, ys, span=0.75, n=80, cell=0.2):
    """Cells cut one by one, fits at their ends, Hermite cubics between."""
    xs, ys = np.asarray(xs, float), np.asarray(ys, float)
    m = len(xs)
    q, most = int(m * span), max(1, int(math.floor(m * span * cell)))
    cuts, todo = [], [(0, m - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo + 1 > most:
            mid = (lo + 1 + hi + 1) // 2 - 1
            cuts.append((xs[mid] + xs[mid + 1]) / 2)
            todo += [(lo, mid), (mid + 1, hi)]
    mu = MARGIN * max(xs[-1] - xs[0], max(abs(xs[0]), abs(xs[-1])) * 1e-3 + 1e-30)
    vertices = [xs[0] - mu, *sorted(cuts), xs[-1] + mu]
    fits = [local_fit(xs, ys, v, q) for v in vertices]
    out = []
    for j in range(n):
        z = xs[0] if j == 0 else xs[-1] if j == n - 1 else xs[0] + j * ((xs[-1] - xs[0]) / (n - 1))
        i = next(i for i in range(len(vertices) - 1) if vertices[i] < z <= vertices[i + 1])
        if fits[i] is None or fits[i + 1] is None:
            out.append((z, None))
            continue
        h = vertices[i + 1] - vertices[i]
        # The cubic through values and slopes, as a polynomial in t.
        c = np.linalg.solve([[1, 0, 0, 0], [0, 1, 0, 0], [1, 1, 1, 1], [0, 1, 2, 3]],
                            [fits[i][0], fits[i][1] * h, fits[i + 1][0], fits[i + 1][1] * h])
        t = (z - vertices[i]) / h
        out.append((z, float(c @ [1, t, t * t, t**3])))
    return out


def wavy(sizes, seed=5):
    rng = random.Random(seed)
    rows, points = [], {}
    for bid, n in sizes:
        ys = [None if pos % 11 == 5 else 100 + 10 * math.sin(pos / 7) + rng.uniform(-5, 5) for pos in range(1, n + 1)]
        rows += [(bid, pos + 3, y) for pos, y in enumerate(ys, start=1)]
        points[bid] = [(i + 1, y) for i, y in enumerate(ys) if y is not None]
    return rows, points


def test_curve_matches_brute_force(spark):
    rows, points = wavy([(1, 2), (2, 5), (3, 13), (4, 14), (5, 40), (6, 97), (7, 333), (8, 1)])
    df = spark.createDataFrame(rows, "BatchID long, RowIndex long, IS_Recovery double").repartition(5)
    got = {(r.BatchID, r.grid_index): (r.Order, r.IS_Recovery_Curve) for r in recovery_curve(df).collect()}
    expected = {(b, j + 1): x for b, p in points.items() if len(p) >= 2
                for j, x in enumerate(brute_curve(*zip(*p, strict=True)))}
    assert got.keys() == expected.keys()
    for k, (v, f) in expected.items():
        assert got[k][0] == pytest.approx(v)
        assert got[k][1] is None if f is None else got[k][1] == pytest.approx(f, rel=1e-6, abs=1e-6), k
    assert any(f is not None for (b, _), (_, f) in expected.items() if b == 7)


def test_curve_follows_the_direct_fit(spark):
    """Between vertices the curve stays near the local fit, and a parabola,
    which every local fit reproduces, is drawn exactly."""
    rows, _ = wavy([(1, 300)])
    rows += [(2, i, 0.01 * i * i - i + 3) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "BatchID long, RowIndex long, IS_Recovery double")
    direct = {(r.BatchID, r.grid_index): r for r in recovery_trend(df).collect()}
    far = {1: 0.0, 2: 0.0}
    for r in recovery_curve(df).collect():
        d = direct[r.BatchID, r.grid_index]
        assert d.Order == r.Order
        far[r.BatchID] = max(far[r.BatchID], abs(d.IS_Recovery_Trend - r.IS_Recovery_Curve))
    assert far[2] < 1e-8 < far[1] < 0.5
