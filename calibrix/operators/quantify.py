"""Sample concentrations: uncorrected (one line) and corrected (two sets).

Both results are columns of one frame, one row per injection, so the
comparison and the result table need no self-joins: the per-batch coefficient
table is joined once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.functions.numeric import ieee_div, inverse_predict, nan_null, strict_mean
from calibrix.operators.calibration import SET1, SET2, samples

SET_LABEL = {SET1: "Set 1", SET2: "Set 2"}


def zero_rule(value, tc_response="TC_Response"):
    """A zero target response reports 0 (a missing response leaves the value)."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.col(tc_response) == 0, F.lit(0.0)).otherwise(v)


def recovery(is_response, mean_is_response):
    """IS recovery in percent of the calibrators' mean IS response."""
    return nan_null(ieee_div(is_response, mean_is_response) * 100)


def route_samples(df: DataFrame, threshold: str = "selection_value") -> DataFrame:
    """Set 1 when Response_Ratio <= threshold, Set 2 when above; else neither."""
    r, t = F.col("Response_Ratio"), F.col(threshold)
    return df.withColumn("cal_set", F.when(r <= t, F.lit(SET1)).when(r > t, F.lit(SET2)))


def uncorrected(q: DataFrame) -> DataFrame:
    """Concentration, ratio and recovery over the whole calibration of rows that
    carry their batch's fit, before (Measured_*) and after the zero rule."""
    return (q.withColumn("Measured_TC_Conc",
                         inverse_predict("Response_Ratio", "intercept", "slope", "intstd_conc"))
            .withColumn("Measured_Conc_Ratio", ieee_div("Measured_TC_Conc", "intstd_conc"))
            .withColumn("IS_Recovery", recovery("IS_Response", "mean_is_response"))
            .withColumn("TC_Conc_Uncorrected", zero_rule("Measured_TC_Conc"))
            .withColumn("Conc_Ratio_Uncorrected", zero_rule("Measured_Conc_Ratio")))


def quantify_samples(smp: DataFrame, summary: DataFrame) -> DataFrame:
    """Every sample with its uncorrected and corrected results.

    Uncorrected (whole calibration): Measured_TC_Conc, Measured_Conc_Ratio,
    IS_Recovery before the zero rule; TC_Conc_Uncorrected and
    Conc_Ratio_Uncorrected after it.
    Corrected (the sample's set): *_Corrected columns; Set is NULL for a sample
    routed to neither set, and all its corrected values are NULL.
    """
    q = uncorrected(smp.join(summary, "BatchID", "left"))
    q = route_samples(q)

    def by_set(col1: str, col2: str):
        s = F.col("cal_set")
        return F.when(s == SET1, F.col(col1)).when(s == SET2, F.col(col2))

    q = (q.withColumn("Set", F.when(F.col("cal_set") == SET1, F.lit(SET_LABEL[SET1]))
                      .when(F.col("cal_set") == SET2, F.lit(SET_LABEL[SET2])))
         .withColumn("Measured_TC_Conc_Corrected",
                     inverse_predict("Response_Ratio", by_set("intercept_1", "intercept_2"),
                                     by_set("slope_1", "slope_2"), "intstd_conc"))
         .withColumn("Measured_Conc_Ratio_Corrected",
                     ieee_div("Measured_TC_Conc_Corrected", "intstd_conc"))
         .withColumn("IS_Recovery_Corrected",
                     recovery("IS_Response", by_set("mean_is_response_1", "mean_is_response_2")))
         # The zero rule runs on the routed samples only: a sample in neither
         # set stays missing even when its target response is 0.
         .withColumn("TC_Conc_Corrected", F.when(F.col("cal_set").isNotNull(),
                                                 zero_rule("Measured_TC_Conc_Corrected")))
         .withColumn("Conc_Ratio_Corrected", F.when(F.col("cal_set").isNotNull(),
                                                    zero_rule("Measured_Conc_Ratio_Corrected"))))
    return q.withColumnRenamed("Analyte_CalcConc", "TC_Conc_MassHunter")


def batch_means(q: DataFrame) -> DataFrame:
    """Per batch: mean IS recovery and mean concentration, taken before the
    zero rule and NULL when any sample's value is missing."""
    return q.groupBy("BatchID").agg(
        strict_mean("IS_Recovery").alias("mean_is_recovery"),
        strict_mean("Measured_TC_Conc").alias("mean_tc_conc"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def uncorrected_recovery(runs: DataFrame) -> DataFrame:
    """Samples with IS_Recovery against the mean IS response of all calibrators.

    The same value as ``quantify_samples(...).IS_Recovery`` without the line
    fits: one partial aggregate over the calibrators and one join.
    """
    from calibrix.operators.calibration import CAL
    mean_is = (runs.filter(F.col("Type") == CAL).groupBy("BatchID")
               .agg(strict_mean("IS_Response").alias("mean_is_response")))
    return (samples(runs).join(mean_is, "BatchID", "left")
            .withColumn("IS_Recovery", recovery("IS_Response", "mean_is_response")))
