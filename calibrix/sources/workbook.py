"""Instrument exports (.xlsx workbooks) into the run table.

Each export is one batch: sheet ``Sheet1``, two header rows, then one row per
injection with a fixed column layout (``calibrix.schema.LAYOUTS``). Files are
read with ``binaryFile`` (Spark spreads them over tasks) or by the data source
of ``workbook_source``. A task pulls the sheet part through an event parser and
passes its rows on in chunks of ``CHUNK_ROWS``, so its memory is the compressed
file, the shared strings (one buffer with offsets) and a chunk, whatever the
sheet's length. The row's position in the sheet becomes ``RowIndex``
(acquisition order is data). The batch key is a 64-bit hash of the file's path.
``write_runs`` parses each file once into a stored run table. Workers need this
package (installed or shipped with the job), as the parser runs in their Python.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from array import array
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from itertools import islice
from xml.etree import ElementTree as ET
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.schema import HEADER_ROWS, LAYOUTS, RUN_COLUMNS, RUNS_SCHEMA, layout_schema

SHEET = "Sheet1"  # fixed value: the sheet the exports use
CHUNK_ROWS = 10_000
_READ = 1 << 18  # bytes of a part that the parser is fed at once
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_NS = {"m": _MAIN,
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
_CELL = re.compile(r"([A-Z]+)(\d+)")
_EPOCH = datetime(1899, 12, 30)  # spreadsheet serial day 0 (1900 date system)


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _sheet_path(z: zipfile.ZipFile, sheet: str) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rid = None
    for s in wb.iterfind("m:sheets/m:sheet", _NS):
        if s.get("name") == sheet:
            rid = s.get(f"{{{_NS['r']}}}id")
    if rid is None:
        raise ValueError(f"sheet {sheet!r} not found")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for rel in rels.iterfind("pr:Relationship", _NS):
        if rel.get("Id") == rid:
            target = rel.get("Target")
            return target.lstrip("/") if target.startswith("/") else \
                posixpath.normpath(posixpath.join("xl", target))
    raise ValueError(f"no part for sheet {sheet!r}")


class SharedStrings:
    """The workbook's string table: one buffer and the strings' ends."""

    def __init__(self):
        self.data, self.ends = bytearray(), array("Q")

    def append(self, text: str) -> None:
        self.data += text.encode("utf-8", "surrogatepass")
        self.ends.append(len(self.data))

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < len(self.ends):
            raise IndexError(f"no shared string {i}")
        return self.data[self.ends[i - 1] if i else 0:self.ends[i]].decode("utf-8", "surrogatepass")


def _fed(z: zipfile.ZipFile, part: str, start: Callable, end: Callable, text: Callable) -> Iterator[None]:
    """Feed a part to the handlers, stopping after each piece of it."""
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    with z.open(part) as stream:
        while piece := stream.read(_READ):
            parser.Parse(piece, False)
            yield
    parser.Parse(b"", True)
    yield


def _shared_strings(z: zipfile.ZipFile) -> SharedStrings:
    out, now, inside = SharedStrings(), [], False
    if "xl/sharedStrings.xml" not in z.namelist():
        return out

    def start(name, _):
        nonlocal inside
        inside = name == f"{_MAIN} t"

    def end(name):
        nonlocal inside
        inside = False
        if name == f"{_MAIN} si":
            out.append("".join(now))
            now.clear()

    def text(data):
        if inside:
            now.append(data)

    for _ in _fed(z, "xl/sharedStrings.xml", start, end, text):
        pass
    return out


class _SheetEvents:
    """Handlers that turn a sheet part's events into (row number, width, raw
    cells); finished rows wait in ``rows``."""

    ROW, CELL, VALUE, TEXT = (f"{_MAIN} {t}" for t in ("row", "c", "v", "t"))

    def __init__(self, n_cols: int, strings: SharedStrings):
        self.n_cols, self.strings, self.rows = n_cols, strings, []
        self.number, self.pos, self.wide, self.values = 0, -1, 0, []
        self.kind, self.col, self.buf, self.reading, self.valued, self.columns = "n", 0, [], False, False, {}

    def start(self, name, attrs):
        if name == self.CELL:
            self.pos += 1
            ref = attrs.get("r")
            self.col = self._column(ref) if ref else self.pos
            self.kind, self.valued = attrs.get("t", "n"), False
            self.buf.clear()
        elif name == self.VALUE:
            self.valued = True
            self.reading = self.kind != "inlineStr"
        elif name == self.TEXT:
            self.reading = self.kind == "inlineStr"
        elif name == self.ROW:
            self.number = int(attrs["r"]) if "r" in attrs else self.number + 1
            self.pos, self.wide, self.values = -1, 0, [None] * self.n_cols

    def _column(self, ref: str) -> int:
        letters = ref.rstrip("0123456789")
        if letters not in self.columns:
            self.columns[letters] = _col_index(_CELL.match(ref).group(1))
        return self.columns[letters]

    def text(self, data):
        if self.reading:
            self.buf.append(data)

    def end(self, name):
        if name in (self.VALUE, self.TEXT):
            self.reading = False
        elif name == self.CELL:
            if self.kind == "inlineStr" or self.valued:
                self.wide = max(self.wide, self.col + 1)
                if self.col < self.n_cols:
                    self.values[self.col] = self._value("".join(self.buf))
        elif name == self.ROW:
            self.rows.append((self.number, self.wide, self.values))

    def _value(self, raw: str):
        if self.kind == "inlineStr":
            return raw
        if raw == "":
            return None
        if self.kind == "s":
            return self.strings[int(raw)]
        if self.kind in ("str", "e"):
            return raw
        return raw == "1" if self.kind == "b" else float(raw)


def iter_rows(source: bytes | io.IOBase, n_cols: int, sheet: str = SHEET) -> Iterator[list]:
    """Rows of raw cell values (str / float / bool / None) after the header
    rows, as they are parsed; ``source`` is a workbook's content or a seekable
    file.

    The column names (the last header row) must be exactly ``n_cols`` wide and
    no value may stand beyond them; another width is another layout, whose
    columns would be read under wrong names, so it raises ``ValueError``. Rows
    must come in the order of their numbers, as the format has them.
    """
    with zipfile.ZipFile(io.BytesIO(source) if isinstance(source, bytes) else source) as z:
        events = _SheetEvents(n_cols, _shared_strings(z))
        last, named = 0, False
        for _ in _fed(z, _sheet_path(z, sheet), events.start, events.end, events.text):
            for number, wide, values in events.rows:
                if number <= last:
                    raise ValueError(f"row {number} comes after row {last}")
                last = number
                if wide > n_cols or number == HEADER_ROWS and wide != n_cols:
                    raise ValueError(f"row {number} has {wide} columns, the layout has {n_cols}")
                if number == HEADER_ROWS:
                    named = True
                elif number > HEADER_ROWS:
                    if not named:
                        raise ValueError(f"no column names in row {HEADER_ROWS}")
                    if any(v is not None for v in values):
                        yield values
            events.rows.clear()
        if not named:
            raise ValueError(f"no column names in row {HEADER_ROWS}")


def parse_workbook(content: bytes, n_cols: int, sheet: str = SHEET) -> list[list]:
    """All rows of ``iter_rows``."""
    return list(iter_rows(content, n_cols, sheet))


def _convert(value, dtype: T.DataType):
    if value is None:
        return None
    if isinstance(dtype, T.StringType):
        if isinstance(value, float) and value.is_integer():
            return str(int(value))
        return str(value)
    if isinstance(dtype, T.DoubleType):
        if isinstance(value, str):
            try:
                return float(value)
            except ValueError:
                return None
        return float(value)
    if isinstance(dtype, T.TimestampType):
        if isinstance(value, float):
            return _EPOCH + timedelta(days=value)
        try:
            return pd.Timestamp(value).to_pydatetime()
        except (ValueError, TypeError):
            return None
    return value


def read_workbooks(spark: SparkSession, path: str, layout: str = "A") -> DataFrame:
    """All workbooks under ``path`` (a file, folder or glob) as typed rows:
    the layout's columns plus Path, Batch (file name without extension) and
    RowIndex. A file of another layout fails the job by name."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx")
             .option("recursiveFileLookup", True).load(path))
    return parse_files(files, layout)


def parse_files(files: DataFrame, layout: str = "A") -> DataFrame:
    """A ``binaryFile`` frame (batch or streaming) -> typed export rows."""
    schema = layout_schema(layout)
    names = [f.name for f in schema.fields]
    out_schema = T.StructType(list(schema.fields) + [
        T.StructField("Path", T.StringType(), False),
        T.StructField("Batch", T.StringType(), False),
        T.StructField("RowIndex", T.LongType(), False)])

    def parse(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                stem = posixpath.splitext(posixpath.basename(p))[0]
                try:
                    rows = enumerate(iter_rows(bytes(content), len(names)), start=1)
                    # One chunk of a workbook at a time leaves the task.
                    while chunk := list(islice(rows, CHUNK_ROWS)):
                        yield pd.DataFrame.from_records(
                            [[*(_convert(v, f.dataType) for v, f in zip(vals, schema.fields)), p, stem, i]
                             for i, vals in chunk],
                            columns=[*names, "Path", "Batch", "RowIndex"])
                except Exception as e:
                    raise ValueError(f"{p}: {e}") from e

    return files.select("path", "content").mapInPandas(parse, out_schema)


def to_runs(rows: DataFrame) -> DataFrame:
    """Typed export rows -> the engine's run table (BatchID from the file's path,
    so equal names in two folders stay two batches)."""
    return rows.withColumn("BatchID", F.xxhash64("Path")).select(*RUN_COLUMNS)


def to_batches(rows: DataFrame, methods: DataFrame, method_id: int) -> DataFrame:
    """One batch row per workbook, all under one method (the folder's method)."""
    labels = (rows.select(F.xxhash64("Path").alias("BatchID"), "Batch").distinct()
              .withColumn("method_id", F.lit(method_id)))
    return labels.join(F.broadcast(methods), "method_id").select(
        "BatchID", "Batch", "method_id", "file_name", "analyte", "intstd_conc", "extract_vol",
        "dilution_fac", "unit_mode", "correct", "conc_digits")


def write_runs(rows: DataFrame, methods: DataFrame, method_id: int, path: str,
               mode: str = "errorifexists") -> None:
    """Store the run table (``path``/runs, parquet by Type) and its batches
    (``path``/batches). Each workbook is parsed once; what reads the stored
    tables scans only the types and columns it uses."""
    keyed = rows.withColumn("BatchID", F.xxhash64("Path"))
    (keyed.select(*RUN_COLUMNS, "Path", "Batch").sortWithinPartitions("Type", "BatchID", "RowIndex")
     .write.mode(mode).partitionBy("Type").parquet(f"{path.rstrip('/')}/runs"))
    stored = rows.sparkSession.read.parquet(f"{path.rstrip('/')}/runs")
    to_batches(stored, methods, method_id).write.mode(mode).parquet(f"{path.rstrip('/')}/batches")


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, batches) that ``write_runs`` stored."""
    runs = spark.read.schema(RUNS_SCHEMA).parquet(f"{path.rstrip('/')}/runs").select(*RUN_COLUMNS)
    return runs, spark.read.parquet(f"{path.rstrip('/')}/batches")


__all__ = ["read_workbooks", "parse_files", "to_runs", "to_batches", "write_runs", "read_runs",
           "iter_rows", "parse_workbook", "LAYOUTS"]
