"""Result files: one CSV per batch, as the method scripts export them.

Format of the scripts' export: UTF-8 with a byte-order mark, comma separated,
header row, missing values as ``NA``, numbers in their shortest round-trip
form with whole numbers written without a decimal point, rows in acquisition
order, file name ``<batch> Result.csv``.

Spark writes a folder per batch (``batch=<batch> Result/BatchID=<id>``) holding
the part files in acquisition order; a batch larger than one task spans several
part files, the first of which starts with the header line. For one file per
batch see ``result_files``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrix.sources.methods import RESULT_COLUMNS
from calibrix.sources.result_files import BOM, NA, result_schema, typed_batches


def format_number(x) -> Column:
    """Shortest round-trip decimal text; whole numbers without '.0'; Inf as Inf."""
    x = F.col(x) if isinstance(x, str) else x
    text = x.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(text, r"E(-?)([0-9]+)$", 2)
    sign = F.when(F.regexp_extract(text, r"E(-?)", 1) == "-", F.lit("-")).otherwise(F.lit("+"))
    scientific = F.concat(mantissa, F.lit("e"), sign, F.lpad(exponent, 2, "0"))
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(x == float("inf"), F.lit("Inf"))
            .when(x == float("-inf"), F.lit("-Inf"))
            .when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string"))
            .when(text.contains("E"), scientific)
            .otherwise(text))


def format_text(x) -> Column:
    """A CSV field: missing is NA; quoted (quotes doubled) where it holds a
    delimiter, a quote, a line break or outer blanks, or reads like missing."""
    x = F.col(x) if isinstance(x, str) else x
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return (F.when(x.isNull(), F.lit(NA))
            .when(x.rlike('[",\\r\\n]|^\\s|\\s$') | (x == NA) | (x == ""), quoted)
            .otherwise(x))


def result_names(method_id: int) -> list[str]:
    """The header of one method's result file."""
    conc, factor, reported = RESULT_COLUMNS[method_id]
    return ["Batch", "SampleID", "IS_Recovery", conc, *([factor, reported] if factor is not None else [])]


def result_lines(finalized: DataFrame, method_id: int) -> DataFrame:
    """(batch, BatchID, RowIndex, value): the file's lines of one method, the
    header as row 0 of each batch."""
    rows = finalized.filter(F.col("method_id") == method_id)
    label = F.concat(F.coalesce("batch_label", F.lit(NA)), F.lit(" Result")).alias("batch")
    numbers = ["IS_Recovery", "Concentration"]
    if RESULT_COLUMNS[method_id][1] is not None:
        numbers += ["Factor", "Reported"]
    line = F.concat_ws(",", format_text("Batch"), format_text("SampleID"),
                       *(F.coalesce(format_number(c), F.lit(NA)) for c in numbers))
    body = rows.select(label, "BatchID", "RowIndex", line.alias("value"))
    head = rows.select(label, "BatchID").distinct().select(
        "batch", "BatchID", F.lit(0).cast("long").alias("RowIndex"),
        F.lit(BOM + ",".join(result_names(method_id))).alias("value"))
    return head.unionByName(body)


def write_results(finalized: DataFrame, out_dir: str) -> None:
    """Write result files under ``out_dir/method=<id>/batch=<name> Result/BatchID=<id>``.

    Only the batches in ``finalized`` are (re)written; every other result in
    ``out_dir`` stays, so a repeated write of the same rows changes nothing.
    Range partitioning on (batch, position) keeps each task's rows contiguous
    in acquisition order without putting a large batch into one task; part
    files in name order are the file. The final rows are checkpointed first, so
    each method's write reads them instead of recomputing the pipeline.
    """
    from calibrix.session import materialize
    finalized = materialize(finalized)
    present = {r[0] for r in finalized.select("method_id").distinct().collect()}  # of five
    for method_id in sorted(present & set(RESULT_COLUMNS)):
        (result_lines(finalized, method_id)
         .repartitionByRange("batch", "BatchID", "RowIndex")
         .sortWithinPartitions("batch", "BatchID", "RowIndex").drop("RowIndex")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch", "BatchID").text(f"{out_dir.rstrip('/')}/method={method_id}"))


def read_results(spark: SparkSession, path: str, method_id: int) -> DataFrame:
    """Read result files back under the declared schema, record by record: a
    quoted field may hold line breaks. Header lines are skipped; an unquoted
    ``NA`` is missing, a quoted one is text. A task holds one part file."""
    schema = result_schema(method_id)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    yield from typed_batches(pa.BufferReader(content.as_buffer()), schema)
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from e

    return files.select("path", "content").mapInArrow(parse, schema)
