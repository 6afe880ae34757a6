"""Method parameters (one row per analytical method) and the batch dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The five method scripts, in their order.
# (method_id, file_name, analyte, intstd_conc, extract_vol, dilution_fac,
#  unit_mode, correct, conc_digits)
# unit_mode: 'mass' = conc x extract_vol, 'dilution' = conc x dilution_fac,
# 'plain' = concentration only. conc_digits = decimals of the report's
# concentration columns (1, creatinine 3). extract_vol never enters the
# arithmetic for the dilution and plain methods.
METHODS = [
    (0, "Nicotine_Correction_Input", "Nicotine", 5.0, 3.0, None, "mass", True, 1),
    (1, "Nicotine_No_Correction_Input", "Nicotine", 5.0, 3.0, None, "mass", False, 1),
    (2, "Cotinine_100uL_Correction_Input", "Cotinine", 5.0, 0.1, 20.0, "dilution", True, 1),
    (3, "Cotinine_2mL_Correction_Input", "Cotinine", 5.0, 2.0, None, "plain", True, 1),
    (4, "Creatinine_No_Correction_Input", "Creatinine", 0.1, 50.0, 10000.0, "dilution", False, 3),
]

# Result column names written by each method's export.
# (method_id, concentration column, factor column, reported column)
RESULT_COLUMNS = {
    0: ("Nicotine_Conc_ng_per_mL", "Sample_Vol_mL", "Nicotine_Mass_ng"),
    1: ("Nicotine_Conc_ng_per_mL", "Sample_Vol_mL", "Nicotine_Mass_ng"),
    2: ("Cotinine_Conc_ng_per_mL_Vial", "Dilution_Factor", "Cotinine_Conc_ng_per_mL_Urine"),
    3: ("Cotinine_Conc_ng_per_mL_Urine", None, None),
    4: ("Creatinine_Conc_ug_per_mL_Vial", "Dilution_Factor", "Creatinine_Conc_ug_per_mL_Urine"),
}

METHOD_SCHEMA = T.StructType([
    T.StructField("method_id", T.IntegerType(), False),
    T.StructField("file_name", T.StringType(), False),
    T.StructField("analyte", T.StringType(), False),
    T.StructField("intstd_conc", T.DoubleType(), True),
    T.StructField("extract_vol", T.DoubleType(), True),
    T.StructField("dilution_fac", T.DoubleType(), True),
    T.StructField("unit_mode", T.StringType(), False),
    T.StructField("correct", T.BooleanType(), False),
    T.StructField("conc_digits", T.IntegerType(), False),
])


def methods(spark: SparkSession) -> DataFrame:
    """The method dimension: 5 rows, a fixed size, safe to broadcast."""
    return spark.createDataFrame(METHODS, METHOD_SCHEMA)


def methods_sql() -> str:
    """The same table as a SQL VALUES list (for the SQL oracle)."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, str):
            return "'" + v + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)
    rows = ",\n    ".join("(" + ", ".join(lit(v) for v in m) + ")" for m in METHODS)
    cols = ", ".join(f.name for f in METHOD_SCHEMA.fields)
    return f"(VALUES\n    {rows}) AS m({cols})"
