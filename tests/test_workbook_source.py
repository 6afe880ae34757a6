"""Instrument exports through the data source: the same rows as the binaryFile
reader, partitions by size, the Type filter inside the reader."""

import os

import pytest
from pyspark.sql import functions as F

from calibrix.schema import LAYOUTS
from calibrix.sources import workbook, workbook_source
from calibrix.sources.stores import packed
from tests.test_workbook import export_rows, write_xlsx

KINDS = [("C1", "Cal", 1.0, 500.0, 1000.0, None), ("S1", "Sample", None, 2100.0, 1000.0, 5.0),
         ("Q1", "QC", None, 900.0, 1000.0, 2.0), ("X", None, None, 1.0, 1.0, None), ("S2", "Sample", None, 7.0, 1000.0, 0.5)]


def as_layout_b(rows):
    names = [n for n, _ in LAYOUTS["A"]]
    keep = [names.index(n) for n, _ in LAYOUTS["B"]]
    return [[r[i] if i < len(r) else None for i in keep] for r in rows]


@pytest.fixture()
def folder(tmp_path):
    for i in range(4):
        (tmp_path / f"site{i % 2}").mkdir(exist_ok=True)
        write_xlsx(tmp_path / f"site{i % 2}" / f"Run_{i}.xlsx", export_rows(KINDS * (i + 1)))
    (tmp_path / "_old").mkdir()
    write_xlsx(tmp_path / "_old" / "Hidden.xlsx", export_rows(KINDS))
    (tmp_path / "notes.txt").write_text("not a workbook")
    return tmp_path


def test_same_rows_as_the_file_reader(spark, folder):
    got = workbook_source.read_exports(spark, str(folder))
    expected = workbook.read_workbooks(spark, f"{folder}/site*", "A")
    assert got.schema == expected.schema and got.count() == 50
    assert got.exceptAll(expected).count() == expected.exceptAll(got).count() == 0
    ids = lambda df: {r.BatchID for r in workbook.to_runs(df).select("BatchID").distinct().collect()}
    assert ids(got) == ids(expected) and len(ids(got)) == 4


def test_layout_b_and_wrong_layout(spark, tmp_path):
    write_xlsx(tmp_path / "B.xlsx", as_layout_b(export_rows(KINDS)))
    rows = spark.read.format(workbook_source.NAME).option("layout", "B").load(str(tmp_path / "B.xlsx"))
    assert len(rows.columns) == 22 + 3
    got = {r.SampleID: r for r in rows.collect()}
    assert got["S1"].TC_Response == 2100.0 and got["S1"].IS_Response == 1000.0 and got["S1"].RowIndex == 2
    with pytest.raises(Exception, match="B.xlsx: row 2 has 22 columns, the layout has 26"):
        workbook_source.read_exports(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="layout 'C'"):
        workbook_source.read_exports(spark, str(tmp_path), "C").collect()


def keys(df):
    return {(r.Path, r.RowIndex, r.SampleID, r.Type) for r in df.collect()}


def test_types_are_read_alone(spark, folder):
    every = keys(workbook_source.read_exports(spark, str(folder)))
    for kinds in (["Sample"], ["Cal", "QC"], ["none"]):
        got = workbook_source.read_exports(spark, str(folder), types=kinds)
        assert keys(got) == {k for k in every if k[3] in kinds}
    reader = workbook_source.ExportReader(str(folder), "A", types=["Cal"])
    part, = reader.partitions()
    assert sum(b.num_rows for b in reader.read(part)) == 10  # of 50


def test_type_filter_is_pushed(spark, folder, capsys):
    every = keys(workbook_source.read_exports(spark, str(folder)))
    load = lambda: workbook_source.read_exports(spark, str(folder), push_filters=True)
    for cond, kinds in ((F.col("Type") == "Sample", {"Sample"}), (F.col("Type").isin("Cal", "QC"), {"Cal", "QC"}),
                        ((F.col("Type") == "Cal") & F.col("Type").isin("QC", "Sample"), set()),
                        (F.col("Type").isNotNull(), {"Cal", "Sample", "QC"}), (F.col("Type") != "Cal", {"Sample", "QC"})):
        assert keys(load().filter(cond)) == {k for k in every if k[3] in kinds}
    load().filter((F.col("Type") == "Sample") & (F.col("TC_Response") > 10)).explain("formatted")
    plan = capsys.readouterr().out
    # The pushed filter leaves the plan's Filter node; the other one stays.
    condition = [line for line in plan.splitlines() if line.strip().startswith("Condition")]
    assert condition and all("TC_Response" in c and "Type" not in c for c in condition), plan


def test_frames_without_pushing_are_read_many_times(spark, folder):
    """Two filters on one frame, in one plan and after each other; with pushed
    filters this Spark version would give the rows of one of them to both."""
    rows = workbook_source.read_exports(spark, str(folder))
    cal, smp = rows.filter("Type = 'Cal'"), rows.filter("Type = 'Sample'")
    assert cal.union(smp).count() == 30 and cal.count() == 10 and smp.count() == 20 and rows.count() == 50


def test_partitions_by_size(spark, folder):
    sizes = {p: os.path.getsize(p) for p in map(str, folder.glob("site*/*.xlsx"))}
    limit = max(sizes.values()) + 1
    rows = workbook_source.read_exports(spark, str(folder), maxPartitionBytes=limit, openCostInBytes=0)
    assert 1 < rows.rdd.getNumPartitions() <= 4
    assert workbook_source.read_exports(spark, str(folder)).rdd.getNumPartitions() == 1
    files = [("a", 5), ("b", 90), ("c", 5), ("d", 40)]
    assert packed(files, 50, 0) == [["b"], ["d", "a", "c"]]
    assert packed(files, 50, 10) == [["b"], ["d"], ["a", "c"]]
    assert packed([], 50, 1) == []


def test_empty_and_missing_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert workbook_source.read_exports(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="absent"):
        workbook_source.read_exports(spark, str(tmp_path / "absent")).collect()
    with pytest.raises(Exception, match="absolute"):
        workbook_source.read_exports(spark, "relative/folder").collect()
