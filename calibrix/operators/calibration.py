"""Calibration: response ratios, straight-line fits, accuracy, calibration sets.

Every fit is a grouped aggregate over (BatchID[, set]) built from partial-
aggregatable moments (count, mean, population (co)variance), so a batch of any
size is reduced map-side before one small shuffle. The per-batch results are
one row per batch and are joined back to rows; AQE broadcasts them when their
measured size is small and otherwise splits a skewed batch in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrix.functions.numeric import (accuracy_pct, ieee_div, inverse_predict, is_infinite,
                                        nan_null, strict_mean)
from calibrix.session import split_hot_batches

CAL, SAMPLE = "Cal", "Sample"
SET1, SET2 = 1, 2
# The accuracy window (percent) that separates the two sets.
ACC_HIGH, ACC_LOW = 110.0, 90.0
# Fixed value: the linear model's tolerance for a collinear column.
RANK_TOL = 1e-7


def calibrators(runs: DataFrame, batches: DataFrame) -> DataFrame:
    """Cal rows with Response_Ratio and Conc_Ratio (TC_Conc / intstd_conc)."""
    params = batches.select("BatchID", "intstd_conc", "conc_digits")
    cal = runs.filter(F.col("Type") == CAL).join(params, "BatchID", "left")
    return (cal.withColumn("Response_Ratio", ieee_div("TC_Response", "IS_Response"))
            .withColumn("Conc_Ratio", ieee_div("TC_Conc", "intstd_conc")))


def samples(runs: DataFrame) -> DataFrame:
    """Sample rows with Response_Ratio. Types other than Cal/Sample are ignored."""
    return (runs.filter(F.col("Type") == SAMPLE)
            .withColumn("Response_Ratio", ieee_div("TC_Response", "IS_Response")))


def line_fit_aggs(x: str, y: str, prefix: str, where: Column | None = None) -> list[Column]:
    """Partial-aggregatable moments of an unweighted fit of y on x.

    Pairs with a missing x or y are left out (as a linear model drops them);
    an infinite x or y is counted so the fit can be refused.
    """
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    if where is not None:
        ok = ok & where
    xm, ym = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    bad = F.when(ok & (is_infinite(x) | is_infinite(y)), F.lit(1))
    return [
        F.count(xm).alias(f"{prefix}n"),
        F.count(bad).alias(f"{prefix}nonfinite"),
        F.avg(xm).alias(f"{prefix}mx"),
        F.avg(ym).alias(f"{prefix}my"),
        F.var_pop(xm).alias(f"{prefix}vx"),
        F.var_pop(ym).alias(f"{prefix}vy"),
        F.covar_pop(ym, xm).alias(f"{prefix}cxy"),
    ]


def line_fit_result(prefix: str, out: str) -> list[Column]:
    """slope, intercept, r_squared from the moments of ``line_fit_aggs``.

    * no usable pair or a non-finite one: everything NULL (the model fails);
    * one point, or constant or nearly constant x: slope NULL, intercept =
      mean(y), r^2 0 (NULL when y is constant too) -- the coefficient is not
      estimable. The model's pivoted QR leaves x out where its norm, swept of the
      mean, is below ``RANK_TOL`` of its norm; with n points these are
      sqrt(n vx) and sqrt(n (vx + mx^2));
    * constant y with varying x: slope 0, r^2 NULL (0/0).
    """
    n, bad = F.col(f"{prefix}n"), F.col(f"{prefix}nonfinite")
    vx, vy, cxy = F.col(f"{prefix}vx"), F.col(f"{prefix}vy"), F.col(f"{prefix}cxy")
    usable = (n > 0) & (bad == 0)
    mx = F.col(f"{prefix}mx")
    varies = (vx > 0) & (vx >= RANK_TOL**2 * (vx + mx * mx))
    slope = F.when(usable & varies, cxy / vx)
    intercept = F.when(usable, F.col(f"{prefix}my") - F.coalesce(slope, F.lit(0.0)) * mx)
    r2 = F.when(usable & (vy > 0),
                F.when(varies, cxy * cxy / (vx * vy)).otherwise(F.lit(0.0)))
    return [nan_null(slope).alias(f"slope{out}"), nan_null(intercept).alias(f"intercept{out}"),
            nan_null(r2).alias(f"r_squared{out}"), n.alias(f"n_fit{out}")]


def fit_calibration(cal: DataFrame) -> DataFrame:
    """One row per batch: the fit over all calibrators and their mean IS response."""
    agg = cal.groupBy("BatchID").agg(
        *line_fit_aggs("Conc_Ratio", "Response_Ratio", "_f0_"),
        strict_mean("IS_Response").alias("mean_is_response"),
        F.count(F.lit(1)).alias("n_calibrators"),
    )
    return agg.select("BatchID", *line_fit_result("_f0_", ""),
                      F.col("_f0_nonfinite").alias("n_nonfinite"), "mean_is_response",
                      "n_calibrators")


def batch_lines(runs: DataFrame, batches: DataFrame) -> DataFrame:
    """One row per batch: its parameters and the fit over all its calibrators."""
    split_hot_batches(runs.sparkSession)
    return batches.select("BatchID", "intstd_conc", "conc_digits").join(
        fit_calibration(calibrators(runs, batches)), "BatchID", "left")


FIT0_COLUMNS = ("slope", "intercept", "r_squared", "n_fit", "n_nonfinite", "mean_is_response",
                "n_calibrators")


def score_calibrators(cal: DataFrame, fit: DataFrame) -> DataFrame:
    """Back-calculated calibrator concentration and its accuracy under ``fit``.

    All of the fit's columns come along, so later per-batch aggregates can
    carry them instead of joining the fit table a second time.
    """
    scored = cal.join(fit.select("BatchID", *FIT0_COLUMNS), "BatchID", "left")
    measured = inverse_predict("Response_Ratio", "intercept", "slope", "intstd_conc")
    return (scored.withColumn("Measured_TC_Conc", measured)
            .withColumn("Accuracy_Pct", accuracy_pct("Measured_TC_Conc", "TC_Conc")))


def assign_cal_set(scored: DataFrame, acc: str = "Accuracy_Pct") -> DataFrame:
    """cal_set 1 = outside the window (>= 110 or <= 90), 2 = strictly inside.

    A missing accuracy joins neither set.
    """
    a = F.col(acc)
    return scored.withColumn(
        "cal_set",
        F.when((a >= ACC_HIGH) | (a <= ACC_LOW), F.lit(SET1))
        .when((a < ACC_HIGH) & (a > ACC_LOW), F.lit(SET2)))


def assign_cal_set_by_conc(cal: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Alternative split on the known concentration: Set 1 = TC_Conc <= threshold."""
    c = F.col("TC_Conc")
    return cal.withColumn("cal_set", F.when(c <= threshold, F.lit(SET1))
                          .when(c > threshold, F.lit(SET2)))


def fit_sets(scored: DataFrame) -> DataFrame:
    """One row per batch: fits, mean IS response and size of each calibration set,
    plus the routing threshold (Response_Ratio of the last Set 1 calibrator in
    acquisition order). All in one aggregate pass over the scored calibrators.
    """
    aggs = []
    for s in (SET1, SET2):
        in_set = F.col("cal_set") == s
        aggs += line_fit_aggs("Conc_Ratio", "Response_Ratio", f"_f{s}_", in_set)
        aggs.append(strict_mean("IS_Response", in_set).alias(f"mean_is_response_{s}"))
        aggs.append(F.count(F.when(in_set, F.lit(1))).alias(f"n_set{s}"))
    # max_by keeps a missing value of the last row (it does not skip NULLs).
    aggs.append(F.max_by(F.col("Response_Ratio"),
                         F.when(F.col("cal_set") == SET1, F.col("RowIndex"))).alias("selection_value"))
    aggs.append(F.count(F.col("Accuracy_Pct")).alias("n_scored"))
    carried = [c for c in FIT0_COLUMNS if c in scored.columns]
    aggs += [F.any_value(c).alias(c) for c in carried]  # constant per batch
    agg = scored.groupBy("BatchID").agg(*aggs)
    cols = ["BatchID", *carried]
    for s in (SET1, SET2):
        cols += line_fit_result(f"_f{s}_", f"_{s}")
        cols += [f"mean_is_response_{s}", f"n_set{s}"]
    return agg.select(*cols, "selection_value", "n_scored")


def batch_fits(runs: DataFrame, batches: DataFrame,
               split_at: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored calibrators, one row per batch with every coefficient). Sets are
    by accuracy, or by known concentration up to ``split_at`` if given.

    The per-batch table starts from ``batches`` so a batch without calibrators
    keeps a row (with NULL fits) and its samples keep their label.
    """
    cal = calibrators(runs, batches)
    fit0 = fit_calibration(cal)
    scored = score_calibrators(cal, fit0)
    scored = assign_cal_set(scored) if split_at is None else assign_cal_set_by_conc(scored, split_at)
    summary = batches.join(fit_sets(scored), "BatchID", "left")
    return scored, summary


def score_by_set(scored: DataFrame, summary: DataFrame) -> DataFrame:
    """Calibrators of each set back-calculated through their own set's line.

    Output: the calibrator columns, cal_set, and Measured_TC_Conc / Accuracy_Pct
    under the set's fit (a calibrator in neither set is left out).
    """
    coef = summary.select("BatchID", "intercept_1", "slope_1", "intercept_2", "slope_2")
    s = F.col("cal_set")

    def pick(name):
        return F.when(s == SET1, F.col(f"{name}_1")).when(s == SET2, F.col(f"{name}_2"))

    base = scored.filter(s.isNotNull()).drop("Measured_TC_Conc", "Accuracy_Pct",
                                             "slope", "intercept")
    out = base.join(coef, "BatchID", "left")
    out = out.withColumn("Measured_TC_Conc",
                         inverse_predict("Response_Ratio", pick("intercept"), pick("slope"),
                                         "intstd_conc"))
    return (out.withColumn("Accuracy_Pct", accuracy_pct("Measured_TC_Conc", "TC_Conc"))
            .drop("intercept_1", "slope_1", "intercept_2", "slope_2"))
