"""Quality gates. A script stops on a bad batch; a multi-batch job flags it.

All gates are grouped aggregates (partial aggregation, no per-batch task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.operators.calibration import SAMPLE


def duplicate_samples(runs: DataFrame) -> DataFrame:
    """(BatchID, SampleID, n) for sample IDs used more than once in a batch.

    Samples are matched by ID between the result tables, so an ID must be
    unique within its batch. A missing ID is a key of its own (matched null-safe).
    """
    return (runs.filter(F.col("Type") == SAMPLE)
            .groupBy("BatchID", "SampleID").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def correction_required(summary: DataFrame) -> DataFrame:
    """True when some calibrator lies outside 90-110 % accuracy (Set 1 not empty).

    Calibrators without an accuracy neither trigger nor clear it; a batch
    without calibrators gives NULL.
    """
    return summary.select("BatchID", F.when(F.col("n_calibrators") > 0, F.col("n_set1") > 0)
                          .alias("correction_required"))


def batch_status(summary: DataFrame, sample_counts: DataFrame) -> DataFrame:
    """One status per batch: the first problem that would stop the script, or 'ok'.

    ``sample_counts``: BatchID, n_samples, n_duplicate_ids.
    """
    s = summary.join(sample_counts, "BatchID", "left")
    corr = F.coalesce(F.col("correct"), F.lit(False))
    n_cal = F.coalesce(F.col("n_calibrators"), F.lit(0))
    status = (F.when(n_cal == 0, F.lit("no_calibrators"))
              .when(F.col("n_nonfinite") > 0, F.lit("non_finite_calibrator"))
              .when(F.col("n_fit") == 0, F.lit("no_usable_calibrator"))
              .when(F.col("slope").isNull(), F.lit("degenerate_fit"))
              .when(F.coalesce(F.col("n_samples"), F.lit(0)) == 0, F.lit("no_samples"))
              .when(F.col("n_duplicate_ids") > 0, F.lit("duplicate_sample_ids"))
              .when(corr & (F.col("n_set1") == 0), F.lit("empty_set1"))
              .when(corr & (F.col("n_set2") == 0), F.lit("empty_set2"))
              .when(corr & F.col("slope_1").isNull(), F.lit("degenerate_set1"))
              .when(corr & F.col("slope_2").isNull(), F.lit("degenerate_set2"))
              .otherwise(F.lit("ok")))
    return s.select("BatchID", n_cal.alias("n_calibrators"),
                    F.coalesce(F.col("n_samples"), F.lit(0)).alias("n_samples"),
                    F.coalesce(F.col("n_duplicate_ids"), F.lit(0)).alias("n_duplicate_ids"),
                    corr.alias("correct"), status.alias("status"))


def sample_counts(runs: DataFrame) -> DataFrame:
    """Per batch: number of samples and of sample IDs that occur more than once."""
    per_id = (runs.filter(F.col("Type") == SAMPLE)
              .groupBy("BatchID", "SampleID").agg(F.count(F.lit(1)).alias("n")))
    return per_id.groupBy("BatchID").agg(
        F.sum("n").alias("n_samples"),
        F.count(F.when(F.col("n") > 1, F.lit(1))).alias("n_duplicate_ids"))
