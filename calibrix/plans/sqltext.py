"""SQL text for the oracle side of the correctness check (DuckDB dialect).

The same definitions as the DataFrame operators, written independently as
plain SQL over the driver's views. Small helpers generate the repeated
expression shapes (IEEE division, strict means, fit moments).
"""

from __future__ import annotations

from calibrix.sources.adapter import RUNS_SQL, batches_sql

INF = "CAST('inf' AS DOUBLE)"


def nan_null(x: str) -> str:
    return f"nullif({x}, CAST('nan' AS DOUBLE))"


def ieee_div(a: str, b: str) -> str:
    """a / b; x/0 is +-Inf by the sign of x, 0/0 and every NaN are NULL."""
    return nan_null(f"coalesce(({a}) / nullif({b}, 0), CASE WHEN ({b}) = 0 THEN sign({a}) * {INF} END)")


def is_inf(x: str) -> str:
    return f"(abs({x}) = {INF})"


def strict_mean(x: str, where: str | None = None) -> str:
    if where is None:
        return nan_null(f"(CASE WHEN count({x}) = count(*) THEN avg({x}) END)")
    xv = f"(CASE WHEN {where} THEN {x} END)"
    return nan_null(f"(CASE WHEN count({xv}) = count(CASE WHEN {where} THEN 1 END) "
                    f"THEN avg({xv}) END)")


def fit_moments(x: str, y: str, p: str, where: str | None = None) -> str:
    ok = f"({x} IS NOT NULL AND {y} IS NOT NULL" + (f" AND {where})" if where else ")")
    xm, ym = f"(CASE WHEN {ok} THEN {x} END)", f"(CASE WHEN {ok} THEN {y} END)"
    return ",\n  ".join([
        f"count({xm}) AS {p}n",
        f"count(CASE WHEN {ok} AND ({is_inf(x)} OR {is_inf(y)}) THEN 1 END) AS {p}nonfinite",
        f"avg({xm}) AS {p}mx", f"avg({ym}) AS {p}my",
        f"var_pop({xm}) AS {p}vx", f"var_pop({ym}) AS {p}vy",
        f"covar_pop({ym}, {xm}) AS {p}cxy",
    ])


def fit_result(p: str, out: str) -> str:
    usable = f"({p}n > 0 AND {p}nonfinite = 0)"
    varies = f"({p}vx > 0 AND {p}vx >= 1e-14 * ({p}vx + {p}mx * {p}mx))"
    slope = f"(CASE WHEN {usable} AND {varies} THEN {p}cxy / {p}vx END)"
    intercept = f"(CASE WHEN {usable} THEN {p}my - coalesce({slope}, 0.0) * {p}mx END)"
    r2 = (f"(CASE WHEN {usable} AND {p}vy > 0 THEN "
          f"(CASE WHEN {varies} THEN {p}cxy * {p}cxy / ({p}vx * {p}vy) ELSE 0.0 END) END)")
    return ",\n  ".join([f"{nan_null(slope)} AS slope{out}",
                         f"{nan_null(intercept)} AS intercept{out}",
                         f"{nan_null(r2)} AS r_squared{out}",
                         f"{p}n AS n_fit{out}"])


def inverse_predict(ratio: str, intercept: str, slope: str, c: str) -> str:
    return nan_null(f"({ieee_div(f'({ratio}) - ({intercept})', slope)} * ({c}))")


def accuracy(m: str, t: str) -> str:
    return nan_null(f"abs({ieee_div(f'({m}) - ({t})', t)} * 100 - 100)")


def zero_rule(v: str) -> str:
    return f"(CASE WHEN TC_Response = 0 THEN 0.0 ELSE {v} END)"


def bround(x: str, d: int) -> str:
    """Nearest decimal by the exact value of the double, ties to even. A tie of
    the scaled value p is decided by what p lost: v * 10^d - p, from v in two
    halves whose products are exact."""
    s = f"1e{d}"
    high = "(134217729e0 * v - (134217729e0 * v - v))"
    lost = f"(({high} * {s} - v * {s}) + (v - {high}) * {s})"
    p = f"(v * {s})"
    return (f"list_transform([CAST({x} AS DOUBLE)], lambda v: CASE WHEN abs({p}) >= 4503599627370496e0 THEN v "
            f"WHEN abs({p} - trunc({p})) = 0.5e0 THEN (CASE WHEN {lost} > 0 THEN ceil({p}) "
            f"WHEN {lost} < 0 THEN floor({p}) ELSE round_even({p}, 0) END) / {s} "
            f"ELSE round({p}) / {s} END)[1]")


SETS_BY_ACCURACY = """CASE WHEN Accuracy_Pct >= 110.0 OR Accuracy_Pct <= 90.0 THEN 1
                 WHEN Accuracy_Pct < 110.0 AND Accuracy_Pct > 90.0 THEN 2 END"""
SETS_BY_CONCENTRATION = "CASE WHEN TC_Conc <= 1.0 THEN 1 WHEN TC_Conc > 1.0 THEN 2 END"

# --- the shared CTE chain -------------------------------------------------
# Steps are materialised: a value that later expressions repeat is a column by
# then, never a nested copy of its expression.

BASE_CTES = f"""
runs AS MATERIALIZED ({RUNS_SQL}),
batches AS MATERIALIZED ({batches_sql()}),
cal AS MATERIALIZED (
  SELECT r.*, b.intstd_conc, b.conc_digits,
         {ieee_div('r.TC_Response', 'r.IS_Response')} AS Response_Ratio,
         {ieee_div('r.TC_Conc', 'b.intstd_conc')} AS Conc_Ratio
  FROM runs r LEFT JOIN batches b ON r.BatchID = b.BatchID
  WHERE r.Type = 'Cal'),
fit0_m AS (
  SELECT BatchID,
  {fit_moments('Conc_Ratio', 'Response_Ratio', '_f0_')},
  {strict_mean('IS_Response')} AS mean_is_response,
  count(*) AS n_calibrators
  FROM cal GROUP BY BatchID),
fit0 AS MATERIALIZED (
  SELECT BatchID,
  {fit_result('_f0_', '')},
  _f0_nonfinite AS n_nonfinite, mean_is_response, n_calibrators
  FROM fit0_m),
scored0 AS MATERIALIZED (
  SELECT c.*, f.slope, f.intercept,
         {inverse_predict('c.Response_Ratio', 'f.intercept', 'f.slope', 'c.intstd_conc')} AS Measured_TC_Conc
  FROM cal c LEFT JOIN fit0 f ON c.BatchID = f.BatchID),
scored1 AS (
  SELECT *, {accuracy('Measured_TC_Conc', 'TC_Conc')} AS Accuracy_Pct FROM scored0),
scored AS MATERIALIZED (
  SELECT *, {SETS_BY_ACCURACY} AS cal_set
  FROM scored1),
sets_m AS (
  SELECT BatchID,
  {fit_moments('Conc_Ratio', 'Response_Ratio', '_f1_', 'cal_set = 1')},
  {strict_mean('IS_Response', 'cal_set = 1')} AS mean_is_response_1,
  count(CASE WHEN cal_set = 1 THEN 1 END) AS n_set1,
  {fit_moments('Conc_Ratio', 'Response_Ratio', '_f2_', 'cal_set = 2')},
  {strict_mean('IS_Response', 'cal_set = 2')} AS mean_is_response_2,
  count(CASE WHEN cal_set = 2 THEN 1 END) AS n_set2,
  arg_max_null(Response_Ratio, CASE WHEN cal_set = 1 THEN RowIndex END) AS selection_value,
  count(Accuracy_Pct) AS n_scored
  FROM scored GROUP BY BatchID),
sets AS MATERIALIZED (
  SELECT BatchID,
  {fit_result('_f1_', '_1')}, mean_is_response_1, n_set1,
  {fit_result('_f2_', '_2')}, mean_is_response_2, n_set2,
  selection_value, n_scored
  FROM sets_m),
summary AS MATERIALIZED (
  SELECT b.*, f.slope, f.intercept, f.r_squared, f.n_fit, f.n_nonfinite, f.mean_is_response,
         f.n_calibrators,
         s.slope_1, s.intercept_1, s.r_squared_1, s.n_fit_1, s.mean_is_response_1, s.n_set1,
         s.slope_2, s.intercept_2, s.r_squared_2, s.n_fit_2, s.mean_is_response_2, s.n_set2,
         s.selection_value, s.n_scored
  FROM batches b LEFT JOIN fit0 f ON b.BatchID = f.BatchID
                 LEFT JOIN sets s ON b.BatchID = s.BatchID),
smp AS MATERIALIZED (
  SELECT r.*, {ieee_div('r.TC_Response', 'r.IS_Response')} AS Response_Ratio
  FROM runs r WHERE r.Type = 'Sample'),
q0 AS MATERIALIZED (
  SELECT p.BatchID, p.RowIndex, p.SampleID, p.TC_Response, p.IS_Response, p.Response_Ratio,
         p.Analyte_CalcConc AS TC_Conc_MassHunter,
         s.* EXCLUDE (BatchID),
         {inverse_predict('p.Response_Ratio', 's.intercept', 's.slope', 's.intstd_conc')} AS Measured_TC_Conc,
         CASE WHEN p.Response_Ratio <= s.selection_value THEN 1
              WHEN p.Response_Ratio > s.selection_value THEN 2 END AS cal_set
  FROM smp p LEFT JOIN summary s ON p.BatchID = s.BatchID),
q1 AS MATERIALIZED (
  SELECT *,
         {ieee_div('Measured_TC_Conc', 'intstd_conc')} AS Measured_Conc_Ratio,
         {nan_null(ieee_div('IS_Response', 'mean_is_response') + ' * 100')} AS IS_Recovery,
         CASE WHEN cal_set = 1 THEN 'Set 1' WHEN cal_set = 2 THEN 'Set 2' END AS "Set",
         {inverse_predict('Response_Ratio',
                          'CASE WHEN cal_set = 1 THEN intercept_1 WHEN cal_set = 2 THEN intercept_2 END',
                          'CASE WHEN cal_set = 1 THEN slope_1 WHEN cal_set = 2 THEN slope_2 END',
                          'intstd_conc')} AS Measured_TC_Conc_Corrected,
         {nan_null(ieee_div('IS_Response', 'CASE WHEN cal_set = 1 THEN mean_is_response_1 WHEN cal_set = 2 THEN mean_is_response_2 END') + ' * 100')} AS IS_Recovery_Corrected
  FROM q0),
q AS (
  SELECT *,
         {zero_rule('Measured_TC_Conc')} AS TC_Conc_Uncorrected,
         {zero_rule('Measured_Conc_Ratio')} AS Conc_Ratio_Uncorrected,
         {ieee_div('Measured_TC_Conc_Corrected', 'intstd_conc')} AS Measured_Conc_Ratio_Corrected,
         CASE WHEN cal_set IS NOT NULL THEN {zero_rule('Measured_TC_Conc_Corrected')} END
             AS TC_Conc_Corrected
  FROM q1),
qz AS MATERIALIZED (
  SELECT *, CASE WHEN cal_set IS NOT NULL THEN {zero_rule('Measured_Conc_Ratio_Corrected')} END
             AS Conc_Ratio_Corrected FROM q)
"""


def with_base(select: str, extra_ctes: str = "") -> str:
    ctes = BASE_CTES.rstrip()
    if extra_ctes:
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {ctes.strip()}\n{select.strip()}\n"
