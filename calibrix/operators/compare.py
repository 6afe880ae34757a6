"""Comparison of uncorrected, corrected and vendor concentrations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.functions.numeric import ieee_div, nan_null
from calibrix.functions.sequence import sequence_within
from calibrix.session import materialize

KEYS = ("BatchID", "SampleID")


def difference_pct(corrected="TC_Conc_Corrected", uncorrected="TC_Conc_Uncorrected"):
    """abs((corrected - uncorrected) / uncorrected) * 100; 0/0 -> NULL."""
    c, u = F.col(corrected), F.col(uncorrected)
    return nan_null(F.abs(ieee_div(nan_null(c - u), u)) * 100)


def comparison(q: DataFrame, sort: bool = True) -> DataFrame:
    """Seven-column comparison per sample of the correcting methods' batches
    (plus BatchID and RowIndex), largest difference first.

    Order: by batch, Difference_Pct descending with missing values last, ties
    in acquisition order -- a distributed range sort, no per-batch window. The
    sort keys are columns, so the order survives any later exchange.
    """
    out = q.filter(F.coalesce(F.col("correct"), F.lit(False))).select(
        "BatchID", "RowIndex", "SampleID",
        F.col("IS_Recovery_Corrected").alias("IS_Recovery"),
        "TC_Conc_Uncorrected", "TC_Conc_MassHunter", "TC_Conc_Corrected", "Set",
        difference_pct().alias("Difference_Pct"),
    )
    if sort:
        out = out.orderBy("BatchID", F.col("Difference_Pct").desc_nulls_last(), "RowIndex")
    return out


def comparison_nocorr(q: DataFrame) -> DataFrame:
    """Uncorrected against vendor result (the no-correction scripts' table)."""
    return q.select("BatchID", "SampleID", "IS_Recovery", "TC_Conc_Uncorrected",
                    "TC_Conc_MassHunter")


def full_join_by_sample(left: DataFrame, right: DataFrame,
                        keys: Sequence[str] = KEYS, order: str | None = None) -> DataFrame:
    """Full outer join on (BatchID, SampleID) where a missing key matches a missing key.

    For tables supplied separately (e.g. vendor results exported on their own).
    The n-th row of a key meets the n-th row of the same key on the other side
    (in the order of ``order``, a column of both, or of the rows' values), so k
    missing or repeated IDs give k rows, never k * k. All missing IDs of a batch
    are one key: its rows are ranged by the order over many tasks, numbered
    inside each range and moved up by the ranges before (``sequence_within``),
    so no task numbers a key alone. Rows equal in every column stay together.
    """
    def numbered(df: DataFrame) -> DataFrame:
        by = [order] if order else sorted(c for c in df.columns if c not in keys) or list(keys)
        ranged = df.repartitionByRange(*keys, *by).withColumn("_range", F.spark_partition_id())
        # Written once: the ranges are then the same for all that reads them.
        return sequence_within(materialize(ranged), keys, by, "_nth", [F.col("_range")])

    l_ = numbered(left).alias("_l")
    r_ = numbered(right).alias("_r")
    cond = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
    joined = l_.join(r_, on=[*cond, F.col("_l._nth") == F.col("_r._nth")], how="full")
    others_l = [c for c in left.columns if c not in keys]
    others_r = [c for c in right.columns if c not in keys]
    return joined.select(
        *[F.coalesce(F.col(f"_l.{k}"), F.col(f"_r.{k}")).alias(k) for k in keys],
        *[F.col(f"_l.{c}") for c in others_l],
        *[F.col(f"_r.{c}") for c in others_r],
    )
