"""Quantify instrument exports as they arrive in a folder.

Structured Streaming watches the folder (``binaryFile`` source); every
micro-batch holds whole workbooks, i.e. whole batches, and batches are
independent, so the micro-batch runs the same batch pipeline and appends its
result files. The stream's checkpoint records which files were processed. A
micro-batch that fails halfway is run again on restart; it then rewrites the
same batches' files and no others, so results are neither lost nor repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from calibrix.operators import results
from calibrix.plans.pipeline import BatchPipeline
from calibrix.session import materialize
from calibrix.sources import methods as method_table
from calibrix.sources import results_csv, workbook


# The binaryFile source's fixed schema (a streaming source needs it declared).
BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])


def process_exports(rows: DataFrame, method_id: int) -> DataFrame:
    """Typed export rows of complete batches -> final result rows."""
    spark = rows.sparkSession
    runs = workbook.to_runs(rows)
    batches = workbook.to_batches(rows, method_table.methods(spark), method_id)
    return results.finalize(BatchPipeline(runs, batches).samples)


def start(spark: SparkSession, in_dir: str, out_dir: str, method_id: int, checkpoint: str,
          layout: str = "A", available_now: bool = False,
          max_files_per_trigger: int = 64) -> StreamingQuery:
    """Start the stream: new ``*.xlsx`` in ``in_dir`` -> result CSVs in ``out_dir``.
    ``checkpoint`` is this stream's own folder in shared storage."""
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
             .option("pathGlobFilter", "*.xlsx")
             .option("maxFilesPerTrigger", max_files_per_trigger).load(in_dir))
    rows = workbook.parse_files(files, layout)

    def each(batch_rows: DataFrame, epoch_id: int) -> None:
        # Each workbook is parsed once, whatever reads its rows afterwards.
        results_csv.write_results(process_exports(materialize(batch_rows), method_id), out_dir)

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
