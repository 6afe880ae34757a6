import math

import pytest

from calibrix.operators import calibration as C
from calibrix.operators import gates
from calibrix.plans.pipeline import BatchPipeline
from tests.fixtures import batches_df, line_batch, runs_df


def test_exact_line(spark):
    runs = runs_df(spark, line_batch())
    p = BatchPipeline(runs, batches_df(spark, {1: 0}))
    s = p.summary.collect()[0]
    assert s.slope == pytest.approx(2.0) and s.intercept == pytest.approx(0.1)
    assert s.r_squared == pytest.approx(1.0)
    accs = [r.Accuracy_Pct for r in p.scored_calibrators.collect()]
    assert all(a == pytest.approx(100.0) for a in accs)
    assert s.n_set1 == 0 and s.n_set2 == 5
    # all calibrators inside the window: no correction needed, Set 1 empty
    assert gates.correction_required(p.summary).collect()[0].correction_required is False
    st = gates.batch_status(p.summary, gates.sample_counts(runs)).collect()[0]
    assert st.status == "no_samples"


def test_cal_set_boundaries(spark):
    df = spark.createDataFrame([(a,) for a in [120.0, 80.0, 100.0, None, 110.0, 90.0,
                                               math.inf, 109.9, 90.1]], "Accuracy_Pct double")
    got = [r.cal_set for r in C.assign_cal_set(df).collect()]
    assert got == [1, 1, 2, None, 1, 1, 1, 2, 2]


def _scored(spark, rows):
    return spark.createDataFrame(
        rows, "BatchID long, RowIndex long, cal_set int, Response_Ratio double, "
              "Conc_Ratio double, IS_Response double, Accuracy_Pct double")


def test_selection_value_is_positional_last(spark):
    sc = _scored(spark, [(1, 1, 1, 0.5, 0.2, 1000.0, 80.0), (1, 2, 2, 0.9, 0.4, 1000.0, 100.0),
                         (1, 3, 1, 0.2, 0.6, 1000.0, 120.0)])
    row = C.fit_sets(sc).collect()[0]
    assert row.selection_value == 0.2  # last in acquisition order, not the max


def test_selection_value_missing_last(spark):
    sc = _scored(spark, [(1, 1, 1, 0.5, 0.2, 1000.0, 80.0), (1, 3, 1, None, 0.6, 1000.0, 120.0)])
    assert C.fit_sets(sc).collect()[0].selection_value is None


def test_one_point_set(spark):
    sc = _scored(spark, [(1, 1, 1, 0.5, 0.2, 1000.0, 80.0), (1, 2, 2, 0.9, 0.4, 1000.0, 100.0),
                         (1, 3, 2, 1.7, 0.8, 1000.0, 100.0)])
    row = C.fit_sets(sc).collect()[0]
    assert row.slope_1 is None and row.intercept_1 == 0.5 and row.n_set1 == 1
    assert row.slope_2 == pytest.approx(2.0)


def test_missing_is_poisons_mean(spark):
    rows = line_batch()
    rows[2] = rows[2][:6] + (None,) + rows[2][7:]
    p = BatchPipeline(runs_df(spark, rows), batches_df(spark, {1: 1}))
    assert p.summary.collect()[0].mean_is_response is None


def test_non_finite_calibrator_refuses_fit(spark):
    rows = line_batch()
    rows[1] = rows[1][:6] + (0.0,) + rows[1][7:]  # IS = 0 -> ratio +Inf
    runs = runs_df(spark, rows + [(1, 9, "S1", "Sample", None, 500.0, 1000.0, 1.0)])
    p = BatchPipeline(runs, batches_df(spark, {1: 1}))
    s = p.summary.collect()[0]
    assert s.slope is None and s.intercept is None and s.n_nonfinite == 1
    st = gates.batch_status(p.summary, gates.sample_counts(runs)).collect()[0]
    assert st.status == "non_finite_calibrator"


def test_duplicates(spark):
    runs = runs_df(spark, line_batch() + [(1, 8, "S1", "Sample", None, 1.0, 1.0, None),
                                          (1, 9, "S1", "Sample", None, 1.0, 1.0, None),
                                          (1, 10, None, "Sample", None, 1.0, 1.0, None),
                                          (1, 11, None, "Sample", None, 1.0, 1.0, None)])
    got = {(r.SampleID, r.n) for r in gates.duplicate_samples(runs).collect()}
    assert got == {("S1", 2), (None, 2)}


@pytest.mark.parametrize("spread, fits", [(1e-9, False), (0.9e-7, False), (3e-7, True), (1e-3, True), (0.0, False)])
def test_nearly_constant_concentrations_refuse_the_slope(spark, spread, fits):
    """The linear model leaves x out below a relative spread of 1e-7 (norm of
    x about its mean against its norm)."""
    rows = [(1, i + 1, f"C{i}", "Cal", 50.0 * (1 + spread * z), 1000.0 * (2 + i), 1000.0, None)
            for i, z in enumerate([-1.0, 1.0, -1.0, 1.0])]
    runs = runs_df(spark, rows + [(1, 9, "S1", "Sample", None, 500.0, 1000.0, 1.0)])
    p = BatchPipeline(runs, batches_df(spark, {1: 1}))
    s = p.summary.collect()[0]
    st = gates.batch_status(p.summary, gates.sample_counts(runs)).collect()[0]
    assert (s.slope is not None) == fits
    if fits:
        assert st.status == "ok" and s.r_squared > 0
    else:
        assert st.status == "degenerate_fit" and s.intercept == pytest.approx(3.5) and s.r_squared == 0.0
        assert p.samples.collect()[0].TC_Conc_Uncorrected is None
