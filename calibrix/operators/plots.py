"""Data behind the QC plots (the drawing itself is left to the report tool).

Calibration scatter with its line, the low end of the calibration, recovery
and concentration by acquisition order with the batch mean, and the two
calibration sets. Positions come from ``rank_positions`` (bounded tasks). What has one row a
batch is written before the rows join it: only a join that reads both sides from
an exchange is split where one batch is hot. The order plots' rows are written as
Parquet before and after they are numbered, so one exchange of them stands at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibrix.functions.numeric import accuracy_pct, ieee_div, inverse_predict
from calibrix.functions.sequence import rank_positions
from calibrix.operators.calibration import (CAL, SAMPLE, SET1, SET2, assign_cal_set, assign_cal_set_by_conc,
                                            samples)
from calibrix.operators.quantify import SET_LABEL, batch_means, route_samples, uncorrected
from calibrix.session import discard, materialize, store

LOW_END_POINTS = 4  # fixed value: calibrators shown in the low-end plot


def calibration_points(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """Samples (at their back-calculated ratio) and calibrators, with the line.
    ``lines``: ``calibration.batch_lines``, which both types meet in one join."""
    kind = F.when(F.col("Type") == SAMPLE, "Sample").when(F.col("Type") == CAL, "Calibration")
    rows = runs.filter(F.col("Type").isin(SAMPLE, CAL)).withColumn(
        "Response_Ratio", ieee_div("TC_Response", "IS_Response")).join(materialize(lines), "BatchID", "left")
    ratio = F.when(F.col("Type") == SAMPLE, F.col("Conc_Ratio_Uncorrected")).otherwise(ieee_div("TC_Conc", "intstd_conc"))
    return uncorrected(rows).select("BatchID", "RowIndex", kind.alias("Category"), ratio.alias("Conc_Ratio"),
                                    "Response_Ratio", "intercept", "slope")


def calibration_points_by_set(runs: DataFrame, summary: DataFrame, split_at: float | None = None) -> DataFrame:
    """Per set: its samples (back-calculated before the zero rule), its
    calibrators, and the set's line. Both types meet the summary in one join;
    a calibrator's set follows from its batch's fit, as in ``batch_fits``."""
    own = summary.select("BatchID", "intstd_conc", "intercept", "slope", "selection_value",
                         "intercept_1", "slope_1", "intercept_2", "slope_2")
    rows = runs.filter(F.col("Type").isin(SAMPLE, CAL)).withColumn(
        "Response_Ratio", ieee_div("TC_Response", "IS_Response")).join(materialize(own), "BatchID", "left")
    if split_at is None:
        measured = inverse_predict("Response_Ratio", "intercept", "slope", "intstd_conc")
        rows = assign_cal_set(rows.withColumn("_acc", accuracy_pct(measured, "TC_Conc")), "_acc")
    else:
        rows = assign_cal_set_by_conc(rows, split_at)
    is_sample, s = F.col("Type") == SAMPLE, F.col("cal_set")
    routed = route_samples(rows.withColumnRenamed("cal_set", "_own_set")).withColumn(
        "cal_set", F.when(is_sample, s).otherwise(F.col("_own_set"))).filter(s.isNotNull())

    def pick(name):
        return F.when(s == SET1, F.col(f"{name}_1")).when(s == SET2, F.col(f"{name}_2"))

    back = ieee_div(inverse_predict("Response_Ratio", pick("intercept"), pick("slope"), "intstd_conc"), "intstd_conc")
    return routed.select(
        "BatchID", "RowIndex", F.when(s == SET1, F.lit(SET_LABEL[SET1])).otherwise(F.lit(SET_LABEL[SET2])).alias("Set"),
        F.when(is_sample, "Sample").otherwise("Calibration").alias("Category"),
        F.when(is_sample, back).otherwise(ieee_div("TC_Conc", "intstd_conc")).alias("Conc_Ratio"), "Response_Ratio",
        pick("intercept").alias("intercept"), pick("slope").alias("slope"))


def low_end(cal: DataFrame, fit: DataFrame, n: int = LOW_END_POINTS) -> DataFrame:
    """The first ``n`` calibrators of each batch in acquisition order, with the line.

    The rank is limited on the calibrators, before the fit joins: each task
    sends at most ``n`` rows of a batch (a group limit below the exchange).
    """
    position = F.row_number().over(Window.partitionBy("BatchID").orderBy("RowIndex"))
    ranked = (cal.select("BatchID", "RowIndex", "Conc_Ratio", "Response_Ratio")
              .withColumn("CalPosition", position).filter(F.col("CalPosition") <= n)
              .withColumn("CalPosition", F.col("CalPosition").cast("long")))
    return ranked.join(fit.select("BatchID", "intercept", "slope"), "BatchID", "left").select(
        "BatchID", "CalPosition", "Conc_Ratio", "Response_Ratio", "intercept", "slope")


def with_sample_order(q: DataFrame, by_batch: DataFrame | None = None) -> DataFrame:
    """Order = 1..n over the samples of a batch in acquisition order, and the
    columns of ``by_batch``."""
    return rank_positions(q, ["BatchID"], "RowIndex", "Order", by_group=by_batch)


def ordered_samples(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """Samples with their position and uncorrected results, written once: the
    rows of the order plots and their batch means read it. The export's sample
    rows are written first, as two branches number them; the lines come with
    the positions' offsets, so the rows are not exchanged by batch for them."""
    rows = store(samples(runs).select("BatchID", "RowIndex", "SampleID", "TC_Response", "IS_Response"))
    lines = store(lines)
    numbered = with_sample_order(rows, lines).withColumn("Response_Ratio", ieee_div("TC_Response", "IS_Response"))
    out = store(uncorrected(numbered).select(
        "BatchID", "SampleID", "Order", "IS_Recovery", "Measured_TC_Conc", "TC_Conc_Uncorrected"))
    discard(rows, lines)
    return out


def recovery_by_order(ordered: DataFrame) -> DataFrame:
    """``ordered``: ``ordered_samples``."""
    means = store(batch_means(ordered).select("BatchID", "mean_is_recovery"))
    return ordered.join(means, "BatchID", "left").select(
        "BatchID", "SampleID", "Order", "IS_Recovery", "mean_is_recovery")


def conc_by_order(ordered: DataFrame) -> DataFrame:
    means = store(batch_means(ordered).select("BatchID", "mean_tc_conc"))
    return ordered.join(means, "BatchID", "left").select(
        "BatchID", "SampleID", "Order",
        F.col("TC_Conc_Uncorrected").alias("Measured_TC_Conc"), "mean_tc_conc")
