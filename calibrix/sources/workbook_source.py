"""Instrument exports as a Spark data source.

``spark.read.format("instrument_export").option("layout", "A").load(folder)``
reads the workbooks of a folder as typed rows (the layout's columns plus Path,
Batch and RowIndex), like ``workbook.read_workbooks``. Partitions are planned
by file size, so many small exports share a task and none is read twice. Files
are opened in place (only the parts read are loaded).

The rows of some types alone can be read: the cells of other rows are not
converted and do not leave the parser, while ``RowIndex`` still counts them.

* option ``types`` names them ("Cal,Sample"): a frame of its own for each use;
* option ``pushFilters`` lets Spark push a filter on ``Type`` (equal, in, not
  null) into the reader. This Spark version keeps what was pushed with the
  loaded frame and hands it to every other scan of the same frame, in the same
  plan or later ones; so it is off by default, and is for a frame that one plan
  reads once, straight under its filter (a test states this).

Options: ``layout`` (A or B), ``types``, ``pushFilters``, ``maxPartitionBytes``,
``openCostInBytes``, ``timeZone`` (of the sheet's dates; ``read_exports`` gives
the session's).
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.pandas.types import to_arrow_schema

from calibrix.schema import LAYOUTS, layout_schema
from calibrix.sources.stores import Store, packed
from calibrix.sources.workbook import CHUNK_ROWS, _convert, iter_rows

NAME = "instrument_export"
MAX_PARTITION_BYTES, OPEN_COST = 128 << 20, 4 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def export_schema(layout: str) -> T.StructType:
    if layout not in LAYOUTS:
        raise ValueError(f"layout {layout!r}: one of {', '.join(LAYOUTS)}")
    return T.StructType([*layout_schema(layout).fields, T.StructField("Path", T.StringType(), False),
                         T.StructField("Batch", T.StringType(), False), T.StructField("RowIndex", T.LongType(), False)])


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class ExportReader(DataSourceReader):
    def __init__(self, path: str, layout: str, limit: int = MAX_PARTITION_BYTES, open_cost: int = OPEN_COST,
                 zone: str = "UTC", types: Iterable[str] | None = None):
        self.path, self.layout, self.limit, self.open_cost = path, layout, limit, open_cost
        self.zone = ZoneInfo(zone)
        self.types = None if types is None else frozenset(types)  # all, without a limit
        self.not_null = False

    def partitions(self) -> list[Files]:
        files = Store(self.path).files((".xlsx",))
        return [Files(tuple(g)) for g in packed(files, self.limit, self.open_cost)] or [Files(())]

    def wanted(self, kind) -> bool:
        return not (self.not_null and kind is None) and (self.types is None or kind in self.types)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, fields = Store(self.path), layout_schema(self.layout).fields
        schema = to_arrow_schema(export_schema(self.layout))
        at = [f.name for f in fields].index("Type")
        times = [k for k, f in enumerate(fields) if isinstance(f.dataType, T.TimestampType)]
        for path in partition.paths:
            full, stem = store.prefix + path, posixpath.splitext(posixpath.basename(path))[0]
            try:
                with store.fs.open_input_file(path) as file:
                    rows = ((i, r) for i, r in enumerate(iter_rows(file, len(fields)), start=1)
                            if self.wanted(_convert(r[at], T.StringType())))
                    while chunk := list(islice(rows, CHUNK_ROWS)):
                        cols = [[_convert(r[k], f.dataType) for _, r in chunk] for k, f in enumerate(fields)]
                        for k in times:
                            cols[k] = [t and t.replace(tzinfo=self.zone) for t in cols[k]]
                        cols += [[full] * len(chunk), [stem] * len(chunk), [i for i, _ in chunk]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)],
                                                         schema=schema)
            except Exception as e:
                raise ValueError(f"{full}: {e}") from e


class PushedReader(ExportReader):
    """Takes filters on Type from the plan."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            wanted = None
            if getattr(f, "attribute", None) == ("Type",):
                if isinstance(f, EqualTo):
                    wanted = {f.value}
                elif isinstance(f, In):
                    wanted = set(f.value)
                elif isinstance(f, IsNotNull):
                    self.not_null = True
                    continue
            if wanted is None:
                yield f
            else:
                self.types = frozenset(wanted if self.types is None else self.types & wanted)


class ExportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return export_schema(self.options.get("layout", "A"))

    def reader(self, schema: T.StructType) -> ExportReader:
        get = self.options.get
        if not get("path"):
            raise ValueError("give load() a path")
        kind = PushedReader if get("pushFilters", "false").lower() == "true" else ExportReader
        return kind(get("path"), get("layout", "A"), int(get("maxPartitionBytes", MAX_PARTITION_BYTES)),
                    int(get("openCostInBytes", OPEN_COST)), get("timeZone", "UTC"),
                    get("types").split(",") if get("types") else None)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(ExportSource)


def read_exports(spark: SparkSession, path: str, layout: str = "A", types: Iterable[str] | None = None,
                 push_filters: bool = False, **options) -> DataFrame:
    """The workbooks below ``path`` as typed rows, of some ``types`` or all."""
    register(spark)
    options = {"timeZone": spark.conf.get("spark.sql.session.timeZone"), "layout": layout, **options}
    if types is not None:
        options["types"] = ",".join(types)
    if push_filters:  # Spark refuses a reader that takes filters while this is off
        spark.conf.set(PUSHDOWN, "true")
        options["pushFilters"] = "true"
    return spark.read.format(NAME).options(**options).load(path)
