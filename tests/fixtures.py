"""Hand-made run tables for edge cases (expected values worked out by hand)."""

from __future__ import annotations

from calibrix.schema import BATCHES_SCHEMA, RUNS_SCHEMA
from calibrix.sources.methods import METHODS


def runs_df(spark, rows):
    """rows: (BatchID, RowIndex, SampleID, Type, TC_Conc, TC_Response, IS_Response, vendor)."""
    return spark.createDataFrame(rows, RUNS_SCHEMA)


def batches_df(spark, batch_methods: dict[int, int]):
    by_id = {m[0]: m for m in METHODS}
    rows = []
    for bid, mid in batch_methods.items():
        m = by_id[mid]
        rows.append((bid, f"{m[1]}_{bid}", mid, *m[1:]))
    return spark.createDataFrame(rows, BATCHES_SCHEMA)


def line_batch(bid=1, intercept=0.1, slope=2.0, concs=(1.0, 2.0, 5.0, 10.0, 20.0),
               start=1, is_resp=1000.0, intstd=5.0):
    """Calibrators exactly on ratio = intercept + slope * (conc / intstd)."""
    rows = []
    for i, c in enumerate(concs):
        ratio = intercept + slope * (c / intstd)
        rows.append((bid, start + i, f"C{i + 1}", "Cal", c, ratio * is_resp, is_resp, None))
    return rows
