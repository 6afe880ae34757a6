"""Declared schemas: instrument export layouts, the engine's run table, methods."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, TS = T.StringType(), T.DoubleType(), T.TimestampType()

# Column names of the instrument export, by position, as the
# vendor software writes them (the misspelt IS_ReponseRatio is the export's).
LAYOUT_A_COLUMNS = [
    ("SampleID", S), ("DataFile", S), ("Type", S), ("Level", S), ("DateTime", TS),
    ("AcqMethodFile", S), ("DataAnalysisMethodFile", S), ("Comment", S),
    ("TC_Conc", D), ("Analyte_RT", D), ("TC_Response", D), ("Analyte_ManualIntegration", S),
    ("Analyte_CalcConc", D), ("Analyte_FinalConc", D), ("Analyte_Accuracy", D),
    ("IS_ReponseRatio", D), ("Analyte_Transition1_Ratio", D),
    ("Analyte_Transition1_ManualIntegration", S), ("Analyte_Transition2_Ratio", D),
    ("Analyte_Transition2_ManualIntegration", S), ("IS_RT", D), ("IS_Response", D),
    ("IS_Transition1_Ratio", D), ("IS_Transition1_ManualIntegration", S),
    ("IS_Transition2_Ratio", D), ("IS_Transition2_ManualIntegration", S),
]
# Layout B is layout A without the two Transition2 column pairs.
_B_DROPPED = {"Analyte_Transition2_Ratio", "Analyte_Transition2_ManualIntegration",
              "IS_Transition2_Ratio", "IS_Transition2_ManualIntegration"}
LAYOUT_B_COLUMNS = [c for c in LAYOUT_A_COLUMNS if c[0] not in _B_DROPPED]

LAYOUTS = {"A": LAYOUT_A_COLUMNS, "B": LAYOUT_B_COLUMNS}

# Header rows above the data in every export sheet.
HEADER_ROWS = 2


def layout_schema(layout: str) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in LAYOUTS[layout]])


# The engine's run table: the six columns the computation reads, plus the batch
# key and the row's position in its export (acquisition order is data).
RUNS_SCHEMA = T.StructType([
    T.StructField("BatchID", T.LongType(), False),
    T.StructField("RowIndex", T.LongType(), False),
    T.StructField("SampleID", S, True),
    T.StructField("Type", S, True),
    T.StructField("TC_Conc", D, True),
    T.StructField("TC_Response", D, True),
    T.StructField("IS_Response", D, True),
    T.StructField("Analyte_CalcConc", D, True),
])
RUN_COLUMNS = [f.name for f in RUNS_SCHEMA.fields]

# One row per batch: its label (the export's file name) and method parameters.
BATCHES_SCHEMA = T.StructType([
    T.StructField("BatchID", T.LongType(), False),
    T.StructField("Batch", S, True),
    T.StructField("method_id", T.IntegerType(), True),
    T.StructField("file_name", S, True),
    T.StructField("analyte", S, True),
    T.StructField("intstd_conc", D, True),
    T.StructField("extract_vol", D, True),
    T.StructField("dilution_fac", D, True),
    T.StructField("unit_mode", S, True),
    T.StructField("correct", T.BooleanType(), True),
    T.StructField("conc_digits", T.IntegerType(), True),
])
