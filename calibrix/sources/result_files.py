"""One committed result file for each batch: ``<batch> Result.csv``.

``write_batch_files`` writes through a data source with a commit step. Every
task streams its batches' lines into a folder of its own below the target's
staging folder; when all tasks have ended, the files are moved to their final
names, so a failed job leaves nothing and a repeated one replaces its files. A
batch's rows go to one task, sorted, as one file is written by one writer: the
sort spills, and the writer holds one Arrow batch.

Bytes are those of the scripts' own files: byte-order mark, header, missing
values as NA, numbers as ``number_text``. Two batches of one name fail the job,
as their files would be one; so does a name that is no file name.

``read_batch_files`` reads such files as a data source: whole records (a quoted
field may hold line breaks), packed by size, streamed. ``results_csv`` uses the
same records for its part files.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)
from pyspark.sql.pandas.types import to_arrow_schema

from calibrix.sources.methods import RESULT_COLUMNS
from calibrix.sources.number_text import number_text
from calibrix.sources.stores import Store, packed

NAME = "batch_result"
BOM, NA = "﻿", "NA"
_CHUNK = 10_000
_QUOTED = re.compile(r'[",\r\n]|^\s|\s$')
_FIELD = re.compile(r'("(?:[^"]|"")*"|[^,]*)(?:,|$)', re.DOTALL)
# What the writer is given, sorted by the first three.
INPUT = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("BatchID", T.LongType()), T.StructField("RowIndex", T.LongType()),
    T.StructField("method_id", T.IntegerType()), T.StructField("Batch", T.StringType()),
    T.StructField("SampleID", T.StringType()),
    *(T.StructField(c, T.DoubleType()) for c in ("IS_Recovery", "Concentration", "Factor", "Reported"))])


def result_schema(method_id: int) -> T.StructType:
    """Declared schema of one method's result file (numbers as doubles)."""
    conc, factor, reported = RESULT_COLUMNS[method_id]
    fields = [T.StructField("Batch", T.StringType()), T.StructField("SampleID", T.StringType()),
              T.StructField("IS_Recovery", T.DoubleType()), T.StructField(conc, T.DoubleType())]
    if factor is not None:
        fields += [T.StructField(factor, T.DoubleType()), T.StructField(reported, T.DoubleType())]
    return T.StructType(fields)


def text_field(x: str | None) -> str:
    """Missing is NA; quoted (quotes doubled) where it holds a delimiter, a
    quote, a line break or outer blanks, is empty or reads like missing."""
    if x is None:
        return NA
    return '"' + x.replace('"', '""') + '"' if x in (NA, "") or _QUOTED.search(x) else x


def records(lines: Iterable[str]) -> Iterator[str]:
    """Lines (with their ends) as whole records: a line break inside quotes
    belongs to its field."""
    held: list[str] = []
    quotes = 0
    for line in lines:
        held.append(line)
        quotes += line.count('"')
        if quotes % 2 == 0:
            yield "".join(held).removesuffix("\n").removesuffix("\r")
            held, quotes = [], 0
    if held:
        raise ValueError("a quoted field does not end")


def values(record: str, schema: T.StructType) -> list:
    """A record's typed values; a quoted NA is text, an unquoted one is missing."""
    out, at = [], 0
    for field in schema:
        found = _FIELD.match(record, at)
        raw, at = found.group(1), found.end()
        if raw.startswith('"'):
            raw = raw[1:-1].replace('""', '"')
        elif raw == NA:
            out.append(None)
            continue
        out.append(float(raw) if isinstance(field.dataType, T.DoubleType) else raw)
    if at < len(record):
        raise ValueError(f"more than {len(schema)} fields: {record[:80]}")
    return out


def typed_batches(stream, schema: T.StructType, size: int = _CHUNK) -> Iterator[pa.RecordBatch]:
    """A file's records as record batches; header lines are left out."""
    header, arrow = ",".join(schema.names), to_arrow_schema(schema)
    lines = io.TextIOWrapper(stream, encoding="utf-8", newline="\n")
    rows = (values(r, schema) for r in records(lines) if r.removeprefix(BOM) != header)
    while chunk := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk, strict=True), arrow, strict=True)],
                                         schema=arrow)


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class BatchFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _staging(self, store: Store) -> str:
        return f"{store.base.rstrip('/')}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store = Store(self.path)
        folder = f"{self._staging(store)}/{uuid.uuid4().hex}"  # of this attempt alone
        store.fs.create_dir(folder, recursive=True)
        name, owner, out, numbers = None, None, None, 0
        try:
            for batch in iterator:
                lines: list[str] = []
                for file, bid, _, method, label, sample, *nums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if file != name:
                        if out is not None:
                            out.write("".join(lines).encode())
                            out.close()
                            lines = []
                        if not file or "/" in file or "\\" in file or file.startswith((".", "_")) or "\0" in file:
                            raise ValueError(f"{file!r} is no file name")
                        name, owner, schema = file, bid, result_schema(method)
                        out, numbers = store.fs.open_output_stream(f"{folder}/{file}"), len(schema) - 2
                        lines.append(BOM + ",".join(schema.names) + "\n")
                    elif bid != owner:
                        raise ValueError(f"batches {owner} and {bid} have one file name, {file!r}")
                    lines.append(",".join([text_field(label), text_field(sample), *map(number_text, nums[:numbers])]) + "\n")
                if lines:
                    out.write("".join(lines).encode())
        finally:
            if out is not None:
                out.close()
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        store = Store(self.path)
        for message in messages:
            if message is not None:
                for info in store.fs.get_file_info(fs.FileSelector(message.folder)):
                    store.fs.move(info.path, f"{store.base.rstrip('/')}/{info.base_name}")
        self._clear(store)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(Store(self.path))

    def _clear(self, store: Store) -> None:
        folder = self._staging(store)
        if store.fs.get_file_info(folder).type == fs.FileType.Directory:
            store.fs.delete_dir(folder)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class BatchFilesReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, limit: int, open_cost: int):
        self.path, self.out, self.limit, self.open_cost = path, schema, limit, open_cost

    def partitions(self) -> list[Files]:
        files = Store(self.path).files((".csv",))
        return [Files(tuple(g)) for g in packed(files, self.limit, self.open_cost)] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = Store(self.path)
        for path in partition.paths:
            try:
                with store.fs.open_input_stream(path) as stream:
                    yield from typed_batches(stream, self.out)
            except ValueError as e:
                raise ValueError(f"{store.prefix}{path}: {e}") from e


class BatchFilesSource(DataSource):
    """Options: ``method`` (its result columns), ``maxPartitionBytes``, ``openCostInBytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return result_schema(int(self.options["method"]))

    def reader(self, schema: T.StructType) -> BatchFilesReader:
        return BatchFilesReader(self.options["path"], schema, int(self.options.get("maxPartitionBytes", 128 << 20)),
                                int(self.options.get("openCostInBytes", 4 << 20)))

    def writer(self, schema: T.StructType, overwrite: bool) -> BatchFilesWriter:
        if schema.names != INPUT.names:
            raise ValueError(f"the writer takes {', '.join(INPUT.names)}")
        return BatchFilesWriter(self.options["path"])


def batch_rows(finalized: DataFrame) -> DataFrame:
    """The writer's rows: a batch in one partition, in acquisition order."""
    file = F.concat(F.coalesce("batch_label", F.lit(NA)), F.lit(" Result.csv"))
    rows = finalized.select(file.alias("file"), *(F.col(f.name).cast(f.dataType) for f in INPUT.fields[1:]))
    return rows.repartition("file").sortWithinPartitions("file", "BatchID", "RowIndex")


def write_batch_files(finalized: DataFrame, out_dir: str) -> None:
    """One file for each batch of ``finalized`` in ``out_dir``; files of other
    batches stay."""
    finalized.sparkSession.dataSource.register(BatchFilesSource)
    batch_rows(finalized).write.format(NAME).mode("append").option("path", out_dir).save()


def read_batch_files(spark: SparkSession, path: str, method_id: int, **options) -> DataFrame:
    """A result file, or all in a folder, under its method's columns."""
    spark.dataSource.register(BatchFilesSource)
    return spark.read.format(NAME).options(method=method_id, **options).load(path)
