"""Result, comparison, report and status tables against the plain-Python model
of the method scripts, on random batches of every method."""

import math
import random
from collections import Counter
from decimal import ROUND_HALF_EVEN, Decimal

import pytest

from calibrix.operators import gates, report, results
from calibrix.operators.calibration import score_by_set
from calibrix.plans.pipeline import BatchPipeline
from calibrix.sources.methods import METHODS
from tests.fixtures import batches_df, runs_df
from tests.test_quantify_model import close, div, fit, model, mul, random_batch, sub

BY_ID = {m[0]: m for m in METHODS}


def rounded(x, digits):
    if x is None or math.isinf(x):
        return x
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_EVEN))


def calibration(rows, c):
    """(ratios, concentration ratios, accuracies, sets) of the calibrators, and the line."""
    cal = [r for r in rows if r[3] == "Cal"]
    cr, cx = [div(r[5], r[6]) for r in cal], [div(r[4], c) for r in cal]
    slope, icpt = fit(cx, cr)
    acc = []
    for r, ratio in zip(cal, cr):
        a = div(sub(mul(div(sub(ratio, icpt), slope), c), r[4]), r[4])
        acc.append(None if a is None else abs(a * 100 - 100))
    sets = [None if a is None else 1 if a >= 110 or a <= 90 else 2 for a in acc]
    return cal, cr, cx, sets, slope


def status(rows, method):
    cal, cr, cx, sets, slope = calibration(rows, method[3])
    usable = [(x, y) for x, y in zip(cx, cr) if x is not None and y is not None]
    ids = Counter(r[2] for r in rows if r[3] == "Sample")
    if not cal:
        return "no_calibrators"
    if any(math.isinf(x) or math.isinf(y) for x, y in usable):
        return "non_finite_calibrator"
    if not usable:
        return "no_usable_calibrator"
    if slope is None:
        return "degenerate_fit"
    if not ids:
        return "no_samples"
    if max(ids.values()) > 1:
        return "duplicate_sample_ids"
    if method[7]:
        for s in (1, 2):
            if s not in sets:
                return f"empty_set{s}"
        for s in (1, 2):
            at = [i for i, v in enumerate(sets) if v == s]
            if fit([cx[i] for i in at], [cr[i] for i in at])[0] is None:
                return f"degenerate_set{s}"
    return "ok"


def odd_batch(rng, bid):
    """A random batch, often with one thing wrong."""
    rows = random_batch(rng, bid)
    kind = rng.randrange(10)
    cals = [i for i, r in enumerate(rows) if r[3] == "Cal"]
    if kind == 0:
        rows = [r for r in rows if r[3] != "Cal"]
    elif kind == 1:
        i = rng.choice(cals)
        rows[i] = (*rows[i][:6], 0.0, None)
    elif kind == 2:
        rows = [(*r[:4], None, *r[5:]) if r[3] == "Cal" else r for r in rows]
    elif kind == 3:
        rows = [r for i, r in enumerate(rows) if r[3] != "Cal" or i == cals[0]]
    elif kind == 4:
        rows = [r for r in rows if r[3] != "Sample"]
    elif kind == 5:
        rows += [(*r[:1], len(rows) + 1, *r[2:]) for r in rows if r[3] == "Sample"][:1]
    elif kind == 6:  # scattered calibrators
        rows = [(*r[:5], r[5] * rng.uniform(0.5, 1.6), *r[6:]) if r[3] == "Cal" else r for r in rows]
    elif kind == 8:  # three calibrators far from any line
        rows = [(*r[:5], r[5] * rng.uniform(0.1, 4.0), *r[6:]) if r[3] == "Cal" else r
                for i, r in enumerate(rows) if r[3] != "Cal" or i in cals[:3]]
    elif kind == 7:  # an exact line: nothing outside the window
        rows = [(*r[:5], (0.1 + 2 * r[4] / 5) * r[6], *r[6:]) if r[3] == "Cal" else r for r in rows]
    return rows


def table(rng, n):
    rows, methods = [], {}
    for bid in range(1, n + 1):
        methods[bid] = rng.randrange(5)
        rows += odd_batch(rng, bid)
    return rows, methods


@pytest.fixture(scope="module")
def data(spark):
    rows, methods = table(random.Random(23), 150)
    p = BatchPipeline(runs_df(spark, rows).repartition(4), batches_df(spark, methods))
    return rows, methods, p


def test_every_status(spark, data):
    rows, methods, p = data
    got = {r.BatchID: r for r in gates.batch_status(p.summary, gates.sample_counts(p.runs)).collect()}
    want = {b: status([r for r in rows if r[0] == b], BY_ID[m]) for b, m in methods.items()}
    assert {b: r.status for b, r in got.items()} == want
    assert set(want.values()) == {
        "ok", "no_calibrators", "non_finite_calibrator", "no_usable_calibrator", "degenerate_fit", "no_samples",
        "duplicate_sample_ids", "empty_set1", "empty_set2", "degenerate_set1", "degenerate_set2"}


def unique_samples(rows):
    ids = Counter((r[0], r[2]) for r in rows if r[3] == "Sample")
    return {k for k, n in ids.items() if n == 1}


def test_finalize_and_result_report(spark, data):
    rows, methods, p = data
    fin = results.finalize(p.samples)
    got = {(r.BatchID, r.SampleID): r for r in fin.collect()}
    printed = {(r.BatchID, r.SampleID): r for r in report.result_report(fin).collect()}
    neither = 0
    for bid, mid in methods.items():
        m = BY_ID[mid]
        for sid, (unc, rec, st, cor, crec) in model([r for r in rows if r[0] == bid], m[3]).items():
            if (bid, sid) not in unique_samples(rows):
                continue
            g, q = got[(bid, sid)], printed[(bid, sid)]
            conc, recovery = (cor, crec) if m[7] else (unc, rec)
            blank = m[7] and st is None
            neither += blank
            factor = None if blank else {"mass": m[4], "dilution": m[5], "plain": None}[m[6]]
            assert g.Batch == (None if blank else f"{m[1]}_{bid}")
            assert close(g.Concentration, conc) and g.Factor == factor
            assert close(g.IS_Recovery, rounded(recovery, 0)) or abs(recovery % 1 - 0.5) < 1e-6
            assert close(g.Reported, mul(conc, factor))
            assert q.RowIndex == g.RowIndex
            for a, b, digits in ((q.Concentration, g.Concentration, 2), (q.Reported, g.Reported, 2)):
                assert close(a, rounded(b, digits))
    assert neither > 3  # samples in neither set are covered


def test_comparison_and_report(spark, data):
    rows, methods, p = data
    out = p.comparison().collect()
    printed = {(r.BatchID, r.RowIndex): r for r in report.comparison_report(p.comparison(sort=False)).collect()}
    key = lambda r: (r.BatchID, r.Difference_Pct is None, -(r.Difference_Pct or 0.0), r.RowIndex)
    assert [key(r) for r in out] == sorted(key(r) for r in out)
    assert {r.BatchID for r in out} <= {b for b, m in methods.items() if BY_ID[m][7]}
    seen = 0
    for bid, mid in methods.items():
        want = model([r for r in rows if r[0] == bid], BY_ID[mid][3])
        for r in (x for x in out if x.BatchID == bid and (bid, x.SampleID) in unique_samples(rows)):
            unc, _, _, cor, crec = want[r.SampleID]
            diff = div(sub(cor, unc), unc)
            assert close(r.Difference_Pct, None if diff is None else mul(abs(diff), 100))
            assert close(r.IS_Recovery, crec) and close(r.TC_Conc_Uncorrected, unc)
            q = printed[(bid, r.RowIndex)]
            assert close(q.TC_Conc_Corrected, rounded(r.TC_Conc_Corrected, 4))
            assert close(q.Difference_Pct, rounded(r.Difference_Pct, 0))
            seen += 1
    assert seen > 50


def test_split_by_concentration(spark, data):
    rows, methods, _ = data
    p = BatchPipeline(runs_df(spark, rows), batches_df(spark, methods), split="concentration", threshold=2.0)
    got = {r.BatchID: r for r in p.summary.collect()}
    routed = {(r.BatchID, r.SampleID): r for r in p.samples.collect()}
    for bid, mid in methods.items():
        cal, cr, cx, _, _ = calibration([r for r in rows if r[0] == bid], BY_ID[mid][3])
        for s in (1, 2):
            at = [i for i, r in enumerate(cal) if r[4] is not None and (r[4] <= 2.0) == (s == 1)]
            slope, icpt = fit([cx[i] for i in at], [cr[i] for i in at])
            assert close(got[bid][f"slope_{s}"], slope) and close(got[bid][f"intercept_{s}"], icpt)
            if s == 1 and at:
                assert close(got[bid].selection_value, cr[at[-1]])
                for r in rows:
                    if r[0] == bid and r[3] == "Sample" and cr[at[-1]] is not None and div(r[5], r[6]) is not None:
                        assert routed[(bid, r[2])].cal_set == (1 if div(r[5], r[6]) <= cr[at[-1]] else 2)
    with pytest.raises(ValueError):
        BatchPipeline(p.runs, p.batches, split="other")


def test_accuracy_report_by_set(spark, data):
    _, _, p = data
    scored = {(r.BatchID, r.RowIndex): r for r in score_by_set(p.scored_calibrators, p.summary).collect()}
    out = report.cal_accuracy_report(score_by_set(p.scored_calibrators, p.summary), by_set=True).collect()
    assert len(out) == len(scored) > 50
    for r in out:
        s = scored[(r.BatchID, r.RowIndex)]
        assert r.cal_set == s.cal_set
        assert close(r.Accuracy_Pct, rounded(s.Accuracy_Pct, 0))
        assert close(r.Measured_TC_Conc, rounded(s.Measured_TC_Conc, s.conc_digits))
