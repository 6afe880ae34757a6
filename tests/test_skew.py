"""One batch with 60 % of all rows: joins split it, results stay the same."""

import pytest
from pyspark.sql import functions as F

from calibrix.operators.trend import recovery_trend
from calibrix.plans.pipeline import BatchPipeline
from tests.fixtures import batches_df

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "12",
}
BATCHES = 40


@pytest.fixture()
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    n = 60_000
    rows = spark.range(0, n, 1, 12).select(
        F.when(F.col("id") % 10 < 6, F.lit(1)).otherwise(2 + F.expr("id div 10") % (BATCHES - 1)).cast("long").alias("BatchID"),
        (F.col("id") + 1).alias("RowIndex"), F.concat(F.lit("s"), F.col("id")).alias("SampleID"),
        F.when(F.col("id") % 3 == 0, "Cal").otherwise("Sample").alias("Type"),
        (F.col("id") % 17 + 1).cast("double").alias("TC_Conc"),
        ((F.col("id") % 17 + 1) * 100.0 + F.hash("id") % 50).alias("TC_Response"),
        (900.0 + F.col("id") % 100).alias("IS_Response"),
        (F.col("id") % 17 + 1).cast("double").alias("Analyte_CalcConc"))
    yield rows, batches_df(spark, {b: b % 5 for b in range(1, BATCHES + 1)})
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def split_joins(df):
    rows = sorted(map(tuple, df.collect()), key=repr)
    return rows, df._jdf.queryExecution().executedPlan().toString().count("skew=true")


def near(a, b):
    return len(a) == len(b) and all(
        (x == y) or (isinstance(x, float) and x == pytest.approx(y, rel=1e-9)) for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.mark.parametrize("make", ["summary", "batch_means", "samples"])
def test_hot_batch_is_split(spark, skewed, make):
    def build():
        p = BatchPipeline(*skewed)
        cols = ["BatchID", "slope", "intercept", "slope_1", "slope_2", "mean_is_response", "selection_value"]
        return {"summary": lambda: p.summary.select(*cols), "batch_means": p.batch_means,
                "samples": lambda: p.samples.select("BatchID", "RowIndex", "TC_Conc_Uncorrected", "TC_Conc_Corrected")}[make]()

    rows, split = split_joins(build())
    assert split > 0
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        plain, none = split_joins(build())
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    assert none == 0 and near(rows, plain)


def test_hot_batch_is_split_in_the_trend(spark, skewed):
    smp = skewed[0].filter("Type = 'Sample'").select(
        "BatchID", "RowIndex", (F.lit(100.0) + F.hash("RowIndex") % 7).alias("IS_Recovery"))
    rows, split = split_joins(recovery_trend(smp))
    assert split > 0 and len(rows) == BATCHES * 80


@pytest.mark.parametrize("report", ["recovery_by_order", "plot_points", "fit_report"])
def test_reports_of_a_hot_batch(spark, skewed, report):
    """The joins of the order plots and reports split it; values stay the same."""
    from calibrix.operators import calibration, plots
    from calibrix.operators.report import fit_report

    def build():
        runs, batches = skewed
        p = BatchPipeline(runs, batches)
        if report == "recovery_by_order":
            return plots.recovery_by_order(p.ordered_samples)
        if report == "plot_points":
            return plots.calibration_points(runs, calibration.batch_lines(runs, batches))
        return fit_report(p.summary, calibration.samples(runs))

    rows, split = split_joins(build())
    assert split > 0
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        plain, none = split_joins(build())
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    assert none == 0 and near(rows, plain)
