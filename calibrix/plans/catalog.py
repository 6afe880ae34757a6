"""Registered queries: name -> (DataFrame builder, oracle SQL).

Every builder takes (spark, sf_dir), reads the test tables through the
adapter and returns a lazy DataFrame over all batches. Column names match the
SQL text of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrix.functions.numeric import ieee_div
from calibrix.operators import calibration as cal_ops
from calibrix.operators import quantify, results
from calibrix.plans import sqltext as S
from calibrix.plans.pipeline import BatchPipeline
from calibrix.sources import adapter

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(runs, batches) for ``sf_dir``: the stored tables if ``adapter.ingest``
    was called for it in this session, else built from the test tables."""
    return adapter.stored(spark, sf_dir) or (adapter.runs(spark, sf_dir), adapter.batches(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> BatchPipeline:
    return BatchPipeline(*tables(spark, sf_dir))


# --- sources and parameters ------------------------------------------------

@register("runs", S.with_base("SELECT * FROM runs"))
def q_runs(spark, sf_dir):
    return adapter.runs(spark, sf_dir)


@register("method_params", S.with_base("SELECT * FROM batches"))
def q_method_params(spark, sf_dir):
    return adapter.batches(spark, sf_dir)


# --- filters and projections -----------------------------------------------

@register("calibrators", S.with_base(
    "SELECT BatchID, RowIndex, SampleID, TC_Response, IS_Response, TC_Conc "
    "FROM runs WHERE Type = 'Cal'"))
def q_calibrators(spark, sf_dir):
    r = tables(spark, sf_dir)[0]
    return r.filter(F.col("Type") == cal_ops.CAL).select(
        "BatchID", "RowIndex", "SampleID", "TC_Response", "IS_Response", "TC_Conc")


@register("samples", S.with_base(
    "SELECT BatchID, RowIndex, SampleID, TC_Response, IS_Response "
    "FROM runs WHERE Type = 'Sample'"))
def q_samples(spark, sf_dir):
    r = tables(spark, sf_dir)[0]
    return r.filter(F.col("Type") == cal_ops.SAMPLE).select(
        "BatchID", "RowIndex", "SampleID", "TC_Response", "IS_Response")


@register("vendor_conc", S.with_base(
    "SELECT BatchID, SampleID, Analyte_CalcConc AS TC_Conc_MassHunter "
    "FROM runs WHERE Type = 'Sample'"))
def q_vendor_conc(spark, sf_dir):
    r = tables(spark, sf_dir)[0]
    return (r.filter(F.col("Type") == cal_ops.SAMPLE)
            .select("BatchID", "SampleID", "Analyte_CalcConc")
            .withColumnRenamed("Analyte_CalcConc", "TC_Conc_MassHunter"))


# --- scalar expressions ----------------------------------------------------

@register("response_ratio", S.with_base(
    f"SELECT BatchID, RowIndex, Type, {S.ieee_div('TC_Response', 'IS_Response')} AS Response_Ratio "
    "FROM runs WHERE Type IN ('Cal', 'Sample')"))
def q_response_ratio(spark, sf_dir):
    r = tables(spark, sf_dir)[0]
    return (r.filter(F.col("Type").isin(cal_ops.CAL, cal_ops.SAMPLE))
            .select("BatchID", "RowIndex", "Type",
                    ieee_div("TC_Response", "IS_Response").alias("Response_Ratio")))


@register("conc_ratio", S.with_base(
    "SELECT BatchID, RowIndex, TC_Conc, intstd_conc, Conc_Ratio FROM cal"))
def q_conc_ratio(spark, sf_dir):
    c = cal_ops.calibrators(*tables(spark, sf_dir))
    return c.select("BatchID", "RowIndex", "TC_Conc", "intstd_conc", "Conc_Ratio")


# --- calibration -------------------------------------------------------------

@register("cal_fit", S.with_base("SELECT * FROM fit0"))
def q_cal_fit(spark, sf_dir):
    c = cal_ops.calibrators(*tables(spark, sf_dir))
    return cal_ops.fit_calibration(c)


@register("cal_accuracy", S.with_base(
    "SELECT BatchID, RowIndex, SampleID, Measured_TC_Conc, Accuracy_Pct FROM scored"))
def q_cal_accuracy(spark, sf_dir):
    return pipeline(spark, sf_dir).scored_calibrators.select(
        "BatchID", "RowIndex", "SampleID", "Measured_TC_Conc", "Accuracy_Pct")


@register("cal_accuracy_table", S.with_base(
    "SELECT BatchID, RowIndex, TC_Conc, TC_Response, IS_Response, Response_Ratio, Conc_Ratio, "
    "Measured_TC_Conc, Accuracy_Pct FROM scored ORDER BY BatchID, RowIndex"))
def q_cal_accuracy_table(spark, sf_dir):
    s = pipeline(spark, sf_dir).scored_calibrators
    return s.select("BatchID", "RowIndex", "TC_Conc", "TC_Response", "IS_Response",
                    "Response_Ratio", "Conc_Ratio", "Measured_TC_Conc",
                    "Accuracy_Pct").orderBy("BatchID", "RowIndex")


_CAL_SET_COLS = "BatchID, RowIndex, SampleID, TC_Response, IS_Response, TC_Conc, Response_Ratio, Conc_Ratio"


def _cal_set(spark, sf_dir, s):
    sc = pipeline(spark, sf_dir).scored_calibrators
    return sc.filter(F.col("cal_set") == s).select(*[c.strip() for c in _CAL_SET_COLS.split(",")])


@register("cal_set1", S.with_base(f"SELECT {_CAL_SET_COLS} FROM scored WHERE cal_set = 1"))
def q_cal_set1(spark, sf_dir):
    return _cal_set(spark, sf_dir, cal_ops.SET1)


@register("cal_set2", S.with_base(f"SELECT {_CAL_SET_COLS} FROM scored WHERE cal_set = 2"))
def q_cal_set2(spark, sf_dir):
    return _cal_set(spark, sf_dir, cal_ops.SET2)


@register("cal_split_by_conc", S.with_base(
    "SELECT BatchID, RowIndex, SampleID, TC_Conc, "
    "CASE WHEN TC_Conc <= 1.0 THEN 1 WHEN TC_Conc > 1.0 THEN 2 END AS cal_set FROM cal"))
def q_cal_split_by_conc(spark, sf_dir):
    c = cal_ops.calibrators(*tables(spark, sf_dir))
    return cal_ops.assign_cal_set_by_conc(c, 1.0).select(
        "BatchID", "RowIndex", "SampleID", "TC_Conc", "cal_set")


@register("selection_value", S.with_base(
    "SELECT BatchID, selection_value FROM sets"))
def q_selection_value(spark, sf_dir):
    return cal_ops.fit_sets(pipeline(spark, sf_dir).scored_calibrators).select(
        "BatchID", "selection_value")


_BY_SET_SQL = """
SELECT BatchID, 1 AS cal_set, slope_1 AS slope, intercept_1 AS intercept, r_squared_1 AS r_squared,
       n_fit_1 AS n_fit, mean_is_response_1 AS mean_is_response, n_set1 AS n_calibrators FROM sets
UNION ALL
SELECT BatchID, 2 AS cal_set, slope_2, intercept_2, r_squared_2, n_fit_2, mean_is_response_2, n_set2
FROM sets
"""


def _sets_long(sets: DataFrame) -> DataFrame:
    parts = []
    for s in (cal_ops.SET1, cal_ops.SET2):
        parts.append(sets.select(
            "BatchID", F.lit(s).alias("cal_set"), F.col(f"slope_{s}").alias("slope"),
            F.col(f"intercept_{s}").alias("intercept"), F.col(f"r_squared_{s}").alias("r_squared"),
            F.col(f"n_fit_{s}").alias("n_fit"), F.col(f"mean_is_response_{s}").alias("mean_is_response"),
            F.col(f"n_set{s}").alias("n_calibrators")))
    return parts[0].unionByName(parts[1])


@register("cal_fit_by_set", S.with_base(_BY_SET_SQL))
def q_cal_fit_by_set(spark, sf_dir):
    return _sets_long(cal_ops.fit_sets(pipeline(spark, sf_dir).scored_calibrators))


# --- sample results ------------------------------------------------------------

@register("sample_routing", S.with_base(
    'SELECT BatchID, RowIndex, SampleID, Response_Ratio, selection_value, "Set" FROM qz'))
def q_sample_routing(spark, sf_dir):
    return pipeline(spark, sf_dir).samples.select(
        "BatchID", "RowIndex", "SampleID", "Response_Ratio", "selection_value", "Set")


@register("inverse_predict", S.with_base("""
SELECT BatchID, RowIndex, 'Cal' AS Type, Measured_TC_Conc FROM scored
UNION ALL
SELECT BatchID, RowIndex, 'Sample' AS Type, Measured_TC_Conc FROM qz"""))
def q_inverse_predict(spark, sf_dir):
    p = pipeline(spark, sf_dir)
    a = p.scored_calibrators.select("BatchID", "RowIndex", F.lit("Cal").alias("Type"),
                                    "Measured_TC_Conc")
    b = p.samples.select("BatchID", "RowIndex", F.lit("Sample").alias("Type"), "Measured_TC_Conc")
    return a.unionByName(b)


@register("quantify", S.with_base(
    "SELECT BatchID, RowIndex, SampleID, TC_Response, IS_Response, Response_Ratio, "
    "TC_Conc_Uncorrected AS Measured_TC_Conc, Conc_Ratio_Uncorrected AS Measured_Conc_Ratio, "
    "IS_Recovery FROM qz"))
def q_quantify(spark, sf_dir):
    return pipeline(spark, sf_dir).samples.select(
        "BatchID", "RowIndex", "SampleID", "TC_Response", "IS_Response", "Response_Ratio",
        F.col("TC_Conc_Uncorrected").alias("Measured_TC_Conc"),
        F.col("Conc_Ratio_Uncorrected").alias("Measured_Conc_Ratio"), "IS_Recovery")


@register("is_recovery", S.with_base(
    "SELECT BatchID, RowIndex, SampleID, IS_Recovery, IS_Recovery_Corrected FROM qz"))
def q_is_recovery(spark, sf_dir):
    return pipeline(spark, sf_dir).samples.select(
        "BatchID", "RowIndex", "SampleID", "IS_Recovery", "IS_Recovery_Corrected")


@register("zero_rule", S.with_base(
    "SELECT BatchID, RowIndex, TC_Response, Measured_TC_Conc, TC_Conc_Uncorrected, "
    "Measured_TC_Conc_Corrected, TC_Conc_Corrected FROM qz"))
def q_zero_rule(spark, sf_dir):
    return pipeline(spark, sf_dir).samples.select(
        "BatchID", "RowIndex", "TC_Response", "Measured_TC_Conc", "TC_Conc_Uncorrected",
        "Measured_TC_Conc_Corrected", "TC_Conc_Corrected")


@register("batch_means", S.with_base(
    f"SELECT BatchID, {S.strict_mean('IS_Recovery')} AS mean_is_recovery, "
    f"{S.strict_mean('Measured_TC_Conc')} AS mean_tc_conc, count(*) AS n_samples "
    "FROM qz GROUP BY BatchID"))
def q_batch_means(spark, sf_dir):
    return pipeline(spark, sf_dir).batch_means()


@register("quantify_corrected", S.with_base(
    'SELECT BatchID, RowIndex, SampleID, TC_Response, IS_Response, Response_Ratio, '
    'TC_Conc_Corrected AS Measured_TC_Conc, Conc_Ratio_Corrected AS Measured_Conc_Ratio, '
    'IS_Recovery_Corrected AS IS_Recovery, "Set" FROM qz WHERE cal_set IS NOT NULL AND correct'))
def q_quantify_corrected(spark, sf_dir):
    """Routed samples of the batches whose method corrects."""
    return _corrected(pipeline(spark, sf_dir))


def _corrected(p: BatchPipeline) -> DataFrame:
    routed = F.col("cal_set").isNotNull() & F.coalesce(F.col("correct"), F.lit(False))
    return p.samples.filter(routed).select(
        "BatchID", "RowIndex", "SampleID", "TC_Response", "IS_Response", "Response_Ratio",
        F.col("TC_Conc_Corrected").alias("Measured_TC_Conc"),
        F.col("Conc_Ratio_Corrected").alias("Measured_Conc_Ratio"),
        F.col("IS_Recovery_Corrected").alias("IS_Recovery"), "Set")


# Sets by known concentration instead of accuracy (threshold 1.0).

def _by_conc(sql: str) -> str:
    return sql.replace(S.SETS_BY_ACCURACY, S.SETS_BY_CONCENTRATION)


@register("cal_fit_by_set_conc", _by_conc(S.with_base(_BY_SET_SQL)))
def q_cal_fit_by_set_conc(spark, sf_dir):
    p = BatchPipeline(*tables(spark, sf_dir), split="concentration")
    return _sets_long(cal_ops.fit_sets(p.scored_calibrators))


@register("quantify_corrected_conc", _by_conc(S.with_base(
    'SELECT BatchID, RowIndex, SampleID, TC_Response, IS_Response, Response_Ratio, '
    'TC_Conc_Corrected AS Measured_TC_Conc, Conc_Ratio_Corrected AS Measured_Conc_Ratio, '
    'IS_Recovery_Corrected AS IS_Recovery, "Set" FROM qz WHERE cal_set IS NOT NULL AND correct')))
def q_quantify_corrected_conc(spark, sf_dir):
    return _corrected(BatchPipeline(*tables(spark, sf_dir), split="concentration"))


# --- comparison and results ------------------------------------------------

_DIFF_SQL = S.nan_null(
    "abs(" + S.ieee_div(S.nan_null("TC_Conc_Corrected - TC_Conc_Uncorrected"),
                        "TC_Conc_Uncorrected") + ") * 100")


@register("comparison", S.with_base(
    'SELECT BatchID, RowIndex, SampleID, IS_Recovery_Corrected AS IS_Recovery, TC_Conc_Uncorrected, '
    f'TC_Conc_MassHunter, TC_Conc_Corrected, "Set", {_DIFF_SQL} AS Difference_Pct FROM qz WHERE correct '
    'ORDER BY BatchID, Difference_Pct DESC NULLS LAST, RowIndex'))
def q_comparison(spark, sf_dir):
    return pipeline(spark, sf_dir).comparison()


@register("comparison_nocorr", S.with_base(
    "SELECT BatchID, SampleID, IS_Recovery, TC_Conc_Uncorrected, TC_Conc_MassHunter FROM qz"))
def q_comparison_nocorr(spark, sf_dir):
    return pipeline(spark, sf_dir).comparison_nocorr()


_FINAL_CTE = f"""
fin0 AS (
  SELECT BatchID, RowIndex, method_id, unit_mode, analyte,
         CASE WHEN NOT coalesce(correct, FALSE) OR cal_set IS NOT NULL THEN Batch END AS Batch,
         SampleID,
         {S.bround('CASE WHEN coalesce(correct, FALSE) THEN IS_Recovery_Corrected ELSE IS_Recovery END', 0)} AS IS_Recovery,
         CASE WHEN coalesce(correct, FALSE) THEN TC_Conc_Corrected ELSE TC_Conc_Uncorrected END AS Concentration,
         CASE WHEN NOT coalesce(correct, FALSE) OR cal_set IS NOT NULL THEN
              (CASE WHEN unit_mode = 'mass' THEN extract_vol
                    WHEN unit_mode = 'dilution' THEN dilution_fac END) END AS Factor
  FROM qz),
fin AS (SELECT *, {S.nan_null('Concentration * Factor')} AS Reported FROM fin0)
"""


@register("result_mass", S.with_base(
    "SELECT BatchID, RowIndex, Batch, SampleID, IS_Recovery, Concentration AS Nicotine_Conc_ng_per_mL, "
    "Factor AS Sample_Vol_mL, Reported AS Nicotine_Mass_ng FROM fin WHERE unit_mode = 'mass' "
    "ORDER BY BatchID, RowIndex", _FINAL_CTE))
def q_result_mass(spark, sf_dir):
    return results.result_mass(pipeline(spark, sf_dir).finalized)


@register("result_dilution", S.with_base(
    "SELECT BatchID, RowIndex, Batch, SampleID, IS_Recovery, analyte AS Analyte, Concentration AS Conc_Vial, "
    "Factor AS Dilution_Factor, Reported AS Conc_Urine FROM fin WHERE unit_mode = 'dilution' "
    "ORDER BY BatchID, RowIndex", _FINAL_CTE))
def q_result_dilution(spark, sf_dir):
    return results.result_dilution(pipeline(spark, sf_dir).finalized)


@register("result_plain", S.with_base(
    "SELECT BatchID, RowIndex, Batch, SampleID, IS_Recovery, Concentration AS Cotinine_Conc_ng_per_mL_Urine "
    "FROM fin WHERE unit_mode = 'plain' ORDER BY BatchID, RowIndex", _FINAL_CTE))
def q_result_plain(spark, sf_dir):
    return results.result_plain(pipeline(spark, sf_dir).finalized)


# --- gates -------------------------------------------------------------------

from calibrix.operators import gates, plots, report  # noqa: E402


@register("duplicate_samples", S.with_base(
    "SELECT BatchID, SampleID, count(*) AS n FROM runs WHERE Type = 'Sample' "
    "GROUP BY BatchID, SampleID HAVING count(*) > 1"))
def q_duplicate_samples(spark, sf_dir):
    return gates.duplicate_samples(tables(spark, sf_dir)[0])


@register("correction_required", S.with_base(
    "SELECT BatchID, CASE WHEN n_calibrators > 0 THEN n_set1 > 0 END AS correction_required "
    "FROM summary"))
def q_correction_required(spark, sf_dir):
    return gates.correction_required(pipeline(spark, sf_dir).summary)


_STATUS_CTE = """
sc AS (
  SELECT BatchID, CAST(sum(n) AS BIGINT) AS n_samples,
         count(CASE WHEN n > 1 THEN 1 END) AS n_duplicate_ids
  FROM (SELECT BatchID, SampleID, count(*) AS n FROM runs WHERE Type = 'Sample'
        GROUP BY BatchID, SampleID) AS per_id
  GROUP BY BatchID)
"""

_STATUS_SQL = """
SELECT s.BatchID, coalesce(s.n_calibrators, 0) AS n_calibrators,
       coalesce(c.n_samples, 0) AS n_samples, coalesce(c.n_duplicate_ids, 0) AS n_duplicate_ids,
       coalesce(s.correct, FALSE) AS correct,
       CASE WHEN coalesce(s.n_calibrators, 0) = 0 THEN 'no_calibrators'
            WHEN s.n_nonfinite > 0 THEN 'non_finite_calibrator'
            WHEN s.n_fit = 0 THEN 'no_usable_calibrator'
            WHEN s.slope IS NULL THEN 'degenerate_fit'
            WHEN coalesce(c.n_samples, 0) = 0 THEN 'no_samples'
            WHEN c.n_duplicate_ids > 0 THEN 'duplicate_sample_ids'
            WHEN coalesce(s.correct, FALSE) AND s.n_set1 = 0 THEN 'empty_set1'
            WHEN coalesce(s.correct, FALSE) AND s.n_set2 = 0 THEN 'empty_set2'
            WHEN coalesce(s.correct, FALSE) AND s.slope_1 IS NULL THEN 'degenerate_set1'
            WHEN coalesce(s.correct, FALSE) AND s.slope_2 IS NULL THEN 'degenerate_set2'
            ELSE 'ok' END AS status
FROM summary s LEFT JOIN sc c ON s.BatchID = c.BatchID
"""


@register("batch_status", S.with_base(_STATUS_SQL, _STATUS_CTE))
def q_batch_status(spark, sf_dir):
    r, b = tables(spark, sf_dir)
    p = BatchPipeline(r, b)
    return gates.batch_status(p.summary, gates.sample_counts(r))


# --- per-set calibration tables ----------------------------------------------

_BY_SET_CTE = f"""
bys0 AS (
  SELECT c.BatchID, c.cal_set, c.RowIndex, c.TC_Conc, c.TC_Response, c.IS_Response,
         c.Response_Ratio, c.Conc_Ratio,
         {S.inverse_predict('c.Response_Ratio',
                            'CASE WHEN c.cal_set = 1 THEN s.intercept_1 WHEN c.cal_set = 2 THEN s.intercept_2 END',
                            'CASE WHEN c.cal_set = 1 THEN s.slope_1 WHEN c.cal_set = 2 THEN s.slope_2 END',
                            'c.intstd_conc')} AS Measured_TC_Conc
  FROM scored c LEFT JOIN sets s ON c.BatchID = s.BatchID
  WHERE c.cal_set IS NOT NULL),
bys AS (SELECT *, {S.accuracy('Measured_TC_Conc', 'TC_Conc')} AS Accuracy_Pct FROM bys0)
"""


@register("cal_accuracy_by_set", S.with_base("SELECT * FROM bys", _BY_SET_CTE))
def q_cal_accuracy_by_set(spark, sf_dir):
    p = pipeline(spark, sf_dir)
    return cal_ops.score_by_set(p.scored_calibrators, p.summary).select(
        "BatchID", "cal_set", "RowIndex", "TC_Conc", "TC_Response", "IS_Response",
        "Response_Ratio", "Conc_Ratio", "Measured_TC_Conc", "Accuracy_Pct")


# --- acquisition order and plot data ----------------------------------------

_ORDER_CTE = f"""
ord AS (SELECT *, CAST(row_number() OVER (PARTITION BY BatchID ORDER BY RowIndex) AS BIGINT)
               AS "Order" FROM qz),
bm AS (SELECT BatchID, {S.strict_mean('IS_Recovery')} AS mean_is_recovery,
              {S.strict_mean('Measured_TC_Conc')} AS mean_tc_conc FROM qz GROUP BY BatchID)
"""


@register("sample_order", S.with_base(
    'SELECT BatchID, SampleID, RowIndex, "Order" FROM ord', _ORDER_CTE))
def q_sample_order(spark, sf_dir):
    smp = cal_ops.samples(tables(spark, sf_dir)[0]).select("BatchID", "SampleID", "RowIndex")
    return plots.with_sample_order(smp)


@register("recovery_by_order", S.with_base(
    'SELECT o.BatchID, o.SampleID, o."Order", o.IS_Recovery, b.mean_is_recovery '
    'FROM ord o LEFT JOIN bm b ON o.BatchID = b.BatchID', _ORDER_CTE))
def q_recovery_by_order(spark, sf_dir):
    return plots.recovery_by_order(pipeline(spark, sf_dir).ordered_samples)


@register("conc_by_order", S.with_base(
    'SELECT o.BatchID, o.SampleID, o."Order", o.TC_Conc_Uncorrected AS Measured_TC_Conc, '
    'b.mean_tc_conc FROM ord o LEFT JOIN bm b ON o.BatchID = b.BatchID', _ORDER_CTE))
def q_conc_by_order(spark, sf_dir):
    return plots.conc_by_order(pipeline(spark, sf_dir).ordered_samples)


@register("cal_low_end", S.with_base("""
SELECT BatchID, CalPosition, Conc_Ratio, Response_Ratio, intercept, slope
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY BatchID ORDER BY RowIndex) AS BIGINT)
             AS CalPosition FROM scored) AS ranked
WHERE CalPosition <= 4"""))
def q_cal_low_end(spark, sf_dir):
    c = cal_ops.calibrators(*tables(spark, sf_dir))
    return plots.low_end(c, cal_ops.fit_calibration(c))


@register("plot_points", S.with_base("""
SELECT BatchID, RowIndex, 'Sample' AS Category, Conc_Ratio_Uncorrected AS Conc_Ratio,
       Response_Ratio, intercept, slope FROM qz
UNION ALL
SELECT BatchID, RowIndex, 'Calibration' AS Category, Conc_Ratio, Response_Ratio, intercept, slope
FROM scored"""))
def q_plot_points(spark, sf_dir):
    r, b = tables(spark, sf_dir)
    return plots.calibration_points(r, cal_ops.batch_lines(r, b))


@register("plot_points_by_set", S.with_base("""
SELECT BatchID, RowIndex, "Set", 'Sample' AS Category, Measured_Conc_Ratio_Corrected AS Conc_Ratio,
       Response_Ratio,
       CASE WHEN cal_set = 1 THEN intercept_1 WHEN cal_set = 2 THEN intercept_2 END AS intercept,
       CASE WHEN cal_set = 1 THEN slope_1 WHEN cal_set = 2 THEN slope_2 END AS slope
FROM qz WHERE cal_set IS NOT NULL
UNION ALL
SELECT c.BatchID, c.RowIndex, CASE WHEN c.cal_set = 1 THEN 'Set 1' ELSE 'Set 2' END AS "Set",
       'Calibration' AS Category, c.Conc_Ratio, c.Response_Ratio,
       CASE WHEN c.cal_set = 1 THEN s.intercept_1 WHEN c.cal_set = 2 THEN s.intercept_2 END,
       CASE WHEN c.cal_set = 1 THEN s.slope_1 WHEN c.cal_set = 2 THEN s.slope_2 END
FROM scored c LEFT JOIN sets s ON c.BatchID = s.BatchID WHERE c.cal_set IS NOT NULL"""))
def q_plot_points_by_set(spark, sf_dir):
    p = pipeline(spark, sf_dir)
    return plots.calibration_points_by_set(p.runs, p.summary, p.split_at)


# --- report tables -------------------------------------------------------------

def _sql_signif(x: str, d: int) -> str:
    k = f"(floor(log10(abs({x}))) - {d - 1})"
    scale = f"pow(10.0, -{k})"
    return (f"(CASE WHEN {x} = 0 THEN 0.0 WHEN isinf({x}) THEN {x} "
            f"ELSE round_even({x} * {scale}, 0) / {scale} END)")


@register("fit_report", S.with_base(f"""
SELECT s.BatchID, {_sql_signif('s.r_squared', 4)} AS r_squared,
       {_sql_signif('s.r_squared_1', 4)} AS r_squared_set1,
       {_sql_signif('s.r_squared_2', 4)} AS r_squared_set2,
       {_sql_signif('b.mean_is_recovery', 2)} AS mean_is_recovery
FROM summary s LEFT JOIN bm b ON s.BatchID = b.BatchID""", _ORDER_CTE))
def q_fit_report(spark, sf_dir):
    p = pipeline(spark, sf_dir)
    return report.fit_report(p.summary, cal_ops.samples(p.runs))


def _sql_conc_round(x: str) -> str:
    return f"CASE WHEN conc_digits = 3 THEN {S.bround(x, 3)} ELSE {S.bround(x, 1)} END"


@register("cal_accuracy_report", S.with_base(f"""
SELECT BatchID, RowIndex, {_sql_conc_round('TC_Conc')} AS TC_Conc,
       {S.bround('TC_Response', 0)} AS TC_Response, {S.bround('IS_Response', 0)} AS IS_Response,
       {S.bround('Response_Ratio', 2)} AS Response_Ratio, {S.bround('Conc_Ratio', 2)} AS Conc_Ratio,
       {_sql_conc_round('Measured_TC_Conc')} AS Measured_TC_Conc,
       {S.bround('Accuracy_Pct', 0)} AS Accuracy_Pct
FROM scored"""))
def q_cal_accuracy_report(spark, sf_dir):
    return report.cal_accuracy_report(pipeline(spark, sf_dir).scored_calibrators)


@register("cal_accuracy_by_set_report", S.with_base(f"""
SELECT BatchID, cal_set, RowIndex, {_sql_conc_round('TC_Conc')} AS TC_Conc,
       {S.bround('TC_Response', 0)} AS TC_Response, {S.bround('IS_Response', 0)} AS IS_Response,
       {S.bround('Response_Ratio', 2)} AS Response_Ratio, {S.bround('Conc_Ratio', 2)} AS Conc_Ratio,
       {_sql_conc_round('Measured_TC_Conc')} AS Measured_TC_Conc,
       {S.bround('Accuracy_Pct', 0)} AS Accuracy_Pct
FROM bys JOIN (SELECT BatchID AS b, conc_digits FROM batches) AS m ON m.b = bys.BatchID""", _BY_SET_CTE))
def q_cal_accuracy_by_set_report(spark, sf_dir):
    p = pipeline(spark, sf_dir)
    return report.cal_accuracy_report(cal_ops.score_by_set(p.scored_calibrators, p.summary), by_set=True)


@register("comparison_report", S.with_base(f"""
SELECT BatchID, RowIndex, SampleID, {S.bround('IS_Recovery_Corrected', 0)} AS IS_Recovery,
       {S.bround('TC_Conc_Uncorrected', 4)} AS TC_Conc_Uncorrected,
       {S.bround('TC_Conc_MassHunter', 4)} AS TC_Conc_MassHunter,
       {S.bround('TC_Conc_Corrected', 4)} AS TC_Conc_Corrected, "Set",
       {S.bround(_DIFF_SQL, 0)} AS Difference_Pct
FROM qz WHERE correct"""))
def q_comparison_report(spark, sf_dir):
    return report.comparison_report(pipeline(spark, sf_dir).comparison(sort=False))


@register("comparison_nocorr_report", S.with_base(f"""
SELECT BatchID, SampleID, {S.bround('IS_Recovery', 0)} AS IS_Recovery,
       {S.bround('TC_Conc_Uncorrected', 4)} AS TC_Conc_Uncorrected,
       {S.bround('TC_Conc_MassHunter', 4)} AS TC_Conc_MassHunter
FROM qz"""))
def q_comparison_nocorr_report(spark, sf_dir):
    return report.comparison_nocorr_report(pipeline(spark, sf_dir).comparison_nocorr())


@register("result_report", S.with_base(f"""
SELECT BatchID, RowIndex, Batch, SampleID, IS_Recovery, {S.bround('Concentration', 2)} AS Concentration,
       {S.bround('Factor', 1)} AS Factor, {S.bround('Reported', 2)} AS Reported
FROM fin""", _FINAL_CTE))
def q_result_report(spark, sf_dir):
    return report.result_report(pipeline(spark, sf_dir).finalized)


# --- recovery trend ----------------------------------------------------------

from calibrix.operators import trend  # noqa: E402

_TREND_CTE = f"""
pts AS (SELECT BatchID, CAST("Order" AS DOUBLE) AS x, IS_Recovery AS y FROM ord
        WHERE IS_Recovery IS NOT NULL AND NOT isinf(IS_Recovery)),
st AS (SELECT BatchID, count(*) AS m, min(x) AS xmin, max(x) AS xmax,
              CAST(floor(count(*) * 0.75) AS BIGINT) AS q
       FROM pts GROUP BY BatchID HAVING count(*) >= 2),
grid AS (SELECT st.*, CAST(t.j AS INTEGER) AS j,
                CASE WHEN t.j = 0 THEN xmin WHEN t.j = 79 THEN xmax
                     ELSE xmin + CAST(t.j AS INTEGER) * ((xmax - xmin) / 79.0) END AS v
         FROM st CROSS JOIN range(80) AS t(j)),
dist AS (SELECT g.BatchID, g.j, g.v, g.q, p.x, p.y, abs(p.x - g.v) AS d,
                row_number() OVER (PARTITION BY g.BatchID, g.j ORDER BY abs(p.x - g.v), p.x) AS rk
         FROM grid g JOIN pts p ON g.BatchID = p.BatchID),
hh AS (SELECT BatchID, j, max(d) AS h FROM dist WHERE rk <= q GROUP BY BatchID, j),
wu0 AS (SELECT t.BatchID, t.j, t.y, (t.x - t.v) / h.h AS u
        FROM dist t JOIN hh h ON t.BatchID = h.BatchID AND t.j = h.j
        WHERE h.h > 0 AND t.rk <= t.q),
wu1 AS (SELECT *, CASE WHEN abs(u) < 1.0 THEN (1.0 - abs(u) * abs(u) * abs(u))
                                           * (1.0 - abs(u) * abs(u) * abs(u))
                                           * (1.0 - abs(u) * abs(u) * abs(u)) ELSE 0.0 END AS w
        FROM wu0),
mom AS (SELECT BatchID, j, sum(w) AS S0, sum(w * u) AS S1, sum(w * u * u) AS S2,
               sum(w * u * u * u) AS S3, sum(w * u * u * u * u) AS S4,
               sum(w * y) AS T0, sum(w * u * y) AS T1, sum(w * u * u * y) AS T2
        FROM wu1 GROUP BY BatchID, j),
sol AS (SELECT BatchID, j,
               S0 * (S2 * S4 - S3 * S3) - S1 * (S1 * S4 - S3 * S2) + S2 * (S1 * S3 - S2 * S2) AS det,
               T0 * (S2 * S4 - S3 * S3) - S1 * (T1 * S4 - S3 * T2) + S2 * (T1 * S3 - S2 * T2) AS det_a,
               S0 FROM mom)
"""


@register("recovery_trend", S.with_base("""
SELECT g.BatchID, CAST(g.j + 1 AS BIGINT) AS grid_index, g.v AS "Order",
       CASE WHEN s.S0 > 0 AND s.det > 1e-10 * s.S0 * s.S0 * s.S0 THEN s.det_a / s.det END
           AS IS_Recovery_Trend
FROM grid g LEFT JOIN sol s ON g.BatchID = s.BatchID AND g.j = s.j""",
    _ORDER_CTE + "," + _TREND_CTE))
def q_recovery_trend(spark, sf_dir):
    return trend.recovery_trend(quantify.uncorrected_recovery(tables(spark, sf_dir)[0]))


_CURVE_CTE = """
cells AS (
  SELECT BatchID, CAST(1 AS BIGINT) AS lo, m AS hi,
         greatest(1, CAST(floor(m * (0.75e0 * 0.2e0)) AS BIGINT)) AS most FROM st
  UNION ALL
  SELECT BatchID, CASE WHEN h.k = 0 THEN lo ELSE (lo + hi) // 2 + 1 END AS lo,
         CASE WHEN h.k = 0 THEN (lo + hi) // 2 ELSE hi END AS hi, most
  FROM cells, (VALUES (0), (1)) AS h(k) WHERE hi - lo >= most),
cuts AS (SELECT c.BatchID, (p.x + n.x) / 2 AS v
         FROM cells c JOIN ranked p ON p.BatchID = c.BatchID AND p.r = c.hi
                      JOIN ranked n ON n.BatchID = c.BatchID AND n.r = c.hi + 1
         WHERE hi - lo < most),
mu AS (SELECT BatchID, xmin, xmax,
              0.005e0 * greatest(xmax - xmin, greatest(abs(xmin), abs(xmax)) * 1e-3 + 1e-30) AS mu FROM st),
vert AS (SELECT BatchID, v, CAST(row_number() OVER (PARTITION BY BatchID ORDER BY v) AS INTEGER) AS j
         FROM (SELECT BatchID, v FROM cuts UNION ALL SELECT BatchID, xmin - mu FROM mu
               UNION ALL SELECT BatchID, xmax + mu FROM mu) AS u),
vdist AS (SELECT t.BatchID, t.j, t.v, st.q, p.x, p.y, abs(p.x - t.v) AS d,
                 row_number() OVER (PARTITION BY t.BatchID, t.j ORDER BY abs(p.x - t.v), p.x) AS rk
          FROM vert t JOIN st ON t.BatchID = st.BatchID JOIN pts p ON t.BatchID = p.BatchID),
vh AS (SELECT BatchID, j, max(d) AS h FROM vdist WHERE rk <= q GROUP BY BatchID, j),
vu AS (SELECT t.BatchID, t.j, t.y, h.h, (t.x - t.v) / h.h AS u
       FROM vdist t JOIN vh h ON t.BatchID = h.BatchID AND t.j = h.j WHERE h.h > 0 AND t.rk <= t.q),
vw AS (SELECT *, CASE WHEN abs(u) < 1.0 THEN pow(1.0 - abs(u) * abs(u) * abs(u), 3) ELSE 0.0 END AS w FROM vu),
vmom AS (SELECT BatchID, j, max(h) AS h, sum(w) AS S0, sum(w * u) AS S1, sum(w * u * u) AS S2,
                sum(w * u * u * u) AS S3, sum(w * u * u * u * u) AS S4,
                sum(w * y) AS T0, sum(w * u * y) AS T1, sum(w * u * u * y) AS T2 FROM vw GROUP BY BatchID, j),
vdet AS (SELECT *, S0 * (S2 * S4 - S3 * S3) - S1 * (S1 * S4 - S3 * S2) + S2 * (S1 * S3 - S2 * S2) AS det FROM vmom),
vfit AS (SELECT t.BatchID, t.j, t.v,
                (T0 * (S2 * S4 - S3 * S3) - S1 * (T1 * S4 - S3 * T2) + S2 * (T1 * S3 - S2 * T2)) / det AS g,
                (S0 * (T1 * S4 - S3 * T2) - T0 * (S1 * S4 - S3 * S2) + S2 * (S1 * T2 - T1 * S2)) / det / h AS d
         FROM vert t LEFT JOIN (SELECT * FROM vdet WHERE S0 > 0 AND det > 1e-10 * S0 * S0 * S0) f
              ON t.BatchID = f.BatchID AND t.j = f.j),
iv AS (SELECT BatchID, v AS v0, g AS g0, d AS d0, lead(v) OVER w AS v1, lead(g) OVER w AS g1, lead(d) OVER w AS d1
       FROM vfit WINDOW w AS (PARTITION BY BatchID ORDER BY j)),
cz AS (SELECT g.BatchID, g.j, g.v, iv.*  EXCLUDE (BatchID), (g.v - v0) / (v1 - v0) AS t
       FROM grid g JOIN iv ON g.BatchID = iv.BatchID AND g.v > v0 AND g.v <= v1)
"""


@register("recovery_curve", S.with_base("""
SELECT BatchID, CAST(j + 1 AS BIGINT) AS grid_index, v AS "Order",
       (1 - t) * (1 - t) * (1 + 2 * t) * g0 + t * t * (3 - 2 * t) * g1
       + (t * (1 - t) * (1 - t) * d0 - t * t * (1 - t) * d1) * (v1 - v0) AS IS_Recovery_Curve
FROM cz""", _ORDER_CTE + "," + _TREND_CTE + ",ranked AS (SELECT BatchID, x, "
    "row_number() OVER (PARTITION BY BatchID ORDER BY x) AS r FROM pts)," + _CURVE_CTE)
    .replace("WITH ", "WITH RECURSIVE ", 1))
def q_recovery_curve(spark, sf_dir):
    return trend.recovery_curve(quantify.uncorrected_recovery(tables(spark, sf_dir)[0]))
