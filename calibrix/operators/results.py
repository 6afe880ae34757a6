"""Final result tables: reporting units, recovery rounding, acquisition order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.functions.numeric import nan_null, round_half_even

MASS, DILUTION, PLAIN = "mass", "dilution", "plain"


def finalize(q: DataFrame) -> DataFrame:
    """One result row per sample, following each batch's method.

    A correcting method reports the corrected concentration and the recovery
    against the sample's own calibration set; otherwise the uncorrected ones.
    A sample routed to neither set keeps only its SampleID (Batch, recovery,
    concentration and factor are missing), as the scripts' final join leaves it.
    Output: BatchID, RowIndex, method columns, batch_label (the batch's name,
    never blanked), Batch, SampleID, IS_Recovery (rounded half to even),
    Concentration, Factor, Reported.
    """
    corr = F.coalesce(F.col("correct"), F.lit(False))
    present = ~corr | F.col("cal_set").isNotNull()
    conc = F.when(corr, F.col("TC_Conc_Corrected")).otherwise(F.col("TC_Conc_Uncorrected"))
    rec = F.when(corr, F.col("IS_Recovery_Corrected")).otherwise(F.col("IS_Recovery"))
    out = q.select(
        "BatchID", "RowIndex", "method_id", "unit_mode", "analyte", "extract_vol",
        "dilution_fac",
        F.col("Batch").alias("batch_label"),
        F.when(present, F.col("Batch")).alias("Batch"),
        "SampleID",
        round_half_even(rec, 0).alias("IS_Recovery"),
        conc.alias("Concentration"),
        present.alias("_present"))
    return with_units(out).drop("_present", "extract_vol", "dilution_fac")


def with_units(df: DataFrame) -> DataFrame:
    """Factor (extraction volume or dilution factor, by unit_mode) and
    Reported = Concentration x Factor; a row flagged not ``_present`` gets no
    factor (the scripts add it before the join that brings such rows back)."""
    mode = F.col("unit_mode")
    factor = (F.when(mode == MASS, F.col("extract_vol"))
              .when(mode == DILUTION, F.col("dilution_fac")))
    if "_present" in df.columns:
        factor = F.when(F.col("_present"), factor)
    return (df.withColumn("Factor", factor)
            .withColumn("Reported", nan_null(F.col("Concentration") * F.col("Factor"))))


def in_acquisition_order(df: DataFrame) -> DataFrame:
    """Sort by batch and position (a distributed range sort); the position stays
    as a column, so the order survives any later exchange."""
    return df.orderBy("BatchID", "RowIndex")


def result_mass(res: DataFrame) -> DataFrame:
    """Concentration x extraction volume = mass (nicotine methods)."""
    out = res.filter(F.col("unit_mode") == MASS).select(
        "BatchID", "RowIndex", "Batch", "SampleID", "IS_Recovery",
        F.col("Concentration").alias("Nicotine_Conc_ng_per_mL"),
        F.col("Factor").alias("Sample_Vol_mL"),
        F.col("Reported").alias("Nicotine_Mass_ng"))
    return in_acquisition_order(out)


def result_dilution(res: DataFrame) -> DataFrame:
    """Vial concentration x dilution factor = concentration in the matrix."""
    out = res.filter(F.col("unit_mode") == DILUTION).select(
        "BatchID", "RowIndex", "Batch", "SampleID", "IS_Recovery",
        F.col("analyte").alias("Analyte"),
        F.col("Concentration").alias("Conc_Vial"),
        F.col("Factor").alias("Dilution_Factor"),
        F.col("Reported").alias("Conc_Urine"))
    return in_acquisition_order(out)


def result_plain(res: DataFrame) -> DataFrame:
    """Concentration reported as measured (no unit change)."""
    out = res.filter(F.col("unit_mode") == PLAIN).select(
        "BatchID", "RowIndex", "Batch", "SampleID", "IS_Recovery",
        F.col("Concentration").alias("Cotinine_Conc_ng_per_mL_Urine"))
    return in_acquisition_order(out)
