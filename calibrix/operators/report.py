"""Report tables: the rounding the QC report prints, and the fit summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.functions.numeric import round_half_even, strict_mean, with_signif
from calibrix.operators.quantify import recovery
from calibrix.session import materialize

# Significant digits printed for r^2 and for the mean recovery.
R2_DIGITS, RECOVERY_DIGITS = 4, 2


def _conc_round(col: str):
    """Concentration columns: 1 decimal, or 3 for methods that ask for it."""
    return (F.when(F.col("conc_digits") == 3, round_half_even(col, 3))
            .otherwise(round_half_even(col, 1)))


def cal_accuracy_report(scored: DataFrame, by_set: bool = False) -> DataFrame:
    """Calibration accuracy table as printed: digits (c, 0, 0, 2, 2, c, 0);
    ``by_set`` for the two sets' tables (``calibration.score_by_set``)."""
    sets = ["cal_set"] if by_set else []
    return scored.select(
        "BatchID", *sets, "RowIndex",
        _conc_round("TC_Conc").alias("TC_Conc"),
        round_half_even("TC_Response", 0).alias("TC_Response"),
        round_half_even("IS_Response", 0).alias("IS_Response"),
        round_half_even("Response_Ratio", 2).alias("Response_Ratio"),
        round_half_even("Conc_Ratio", 2).alias("Conc_Ratio"),
        _conc_round("Measured_TC_Conc").alias("Measured_TC_Conc"),
        round_half_even("Accuracy_Pct", 0).alias("Accuracy_Pct"))


def comparison_report(comparison: DataFrame) -> DataFrame:
    """Comparison table as printed. The report's digit list has one entry fewer
    than the table has columns and is recycled, so Difference_Pct gets 0 digits."""
    return comparison.select(
        "BatchID", "RowIndex", "SampleID",
        round_half_even("IS_Recovery", 0).alias("IS_Recovery"),
        round_half_even("TC_Conc_Uncorrected", 4).alias("TC_Conc_Uncorrected"),
        round_half_even("TC_Conc_MassHunter", 4).alias("TC_Conc_MassHunter"),
        round_half_even("TC_Conc_Corrected", 4).alias("TC_Conc_Corrected"),
        "Set",
        round_half_even("Difference_Pct", 0).alias("Difference_Pct"))


def comparison_nocorr_report(comparison: DataFrame) -> DataFrame:
    return comparison.select(
        "BatchID", "SampleID",
        round_half_even("IS_Recovery", 0).alias("IS_Recovery"),
        round_half_even("TC_Conc_Uncorrected", 4).alias("TC_Conc_Uncorrected"),
        round_half_even("TC_Conc_MassHunter", 4).alias("TC_Conc_MassHunter"))


def result_report(finalized: DataFrame) -> DataFrame:
    """Result table as printed: digits (0, 0, 0, 2, 1, 2)."""
    return finalized.select(
        "BatchID", "RowIndex", "Batch", "SampleID", "IS_Recovery",
        round_half_even("Concentration", 2).alias("Concentration"),
        round_half_even("Factor", 1).alias("Factor"),
        round_half_even("Reported", 2).alias("Reported"))


def fit_report(summary: DataFrame, smp: DataFrame) -> DataFrame:
    """Per batch: r^2 of each line to 4 significant digits, mean recovery to 2.

    The summary is written first, so that the join of the samples splits a hot
    batch (an inner one: only its outer side could be split otherwise); a batch
    without samples keeps its row."""
    lines = materialize(summary.select("BatchID", "mean_is_response", *(
        F.col(c).alias(f"_{c}") for c in ("r_squared", "r_squared_1", "r_squared_2"))))
    rows = smp.select("BatchID", "IS_Response").join(lines.select("BatchID", "mean_is_response"), "BatchID")
    means = rows.withColumn("IS_Recovery", recovery("IS_Response", "mean_is_response")).groupBy("BatchID").agg(
        strict_mean("IS_Recovery").alias("_mean"))
    s = lines.drop("mean_is_response").join(means, "BatchID", "left")
    return with_signif(s, {
        "r_squared": ("_r_squared", R2_DIGITS), "r_squared_set1": ("_r_squared_1", R2_DIGITS),
        "r_squared_set2": ("_r_squared_2", R2_DIGITS), "mean_is_recovery": ("_mean", RECOVERY_DIGITS)}).drop(
        "_r_squared", "_r_squared_1", "_r_squared_2", "_mean")
