"""Workbook ingest on hand-built .xlsx files (shared strings, inline strings,
numbers, empty cells, a date serial), then the full pipeline on top."""

import zipfile

import pytest
from pyspark.sql import functions as F

from calibrix.plans.pipeline import BatchPipeline
from calibrix.schema import LAYOUTS
from calibrix.sources import workbook
from calibrix.sources.methods import methods


def col_letter(i):
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def write_xlsx(path, rows, sheet="Sheet1"):
    strings = []

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, str):
            if v.startswith("inline:"):
                return f'<c r="{ref}" t="inlineStr"><is><t>{v[7:]}</t></is></c>'
            strings.append(v)
            return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
        return f'<c r="{ref}"><v>{v!r}</v></c>'

    body = "".join(
        f'<row r="{r + 1}">' + "".join(cell(f"{col_letter(c)}{r + 1}", v)
                                       for c, v in enumerate(row)) + "</row>"
        for r, row in enumerate(rows))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml",
                   f'<workbook {ns} {rns}><sheets><sheet name="{sheet}" sheetId="1" '
                   f'r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/'
                   'relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
                   '</Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml",
                   f'<sst {ns}>' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")


def export_rows(samples):
    names = [n for n, _ in LAYOUTS["A"]]
    header = [["Batch export"] + [None] * (len(names) - 1), names]
    rows = []
    for sid, typ, conc, tc, isr, vendor in samples:
        r = [None] * len(names)
        r[names.index("SampleID")] = sid
        r[names.index("Type")] = typ
        r[names.index("DateTime")] = 45000.5
        r[names.index("TC_Conc")] = conc
        r[names.index("TC_Response")] = tc
        r[names.index("IS_Response")] = isr
        r[names.index("Analyte_CalcConc")] = vendor
        rows.append(r)
    return header + rows


def test_read_workbooks_and_quantify(spark, tmp_path):
    cal = [(f"Cal{i}", "Cal", c, (0.1 + 2 * c / 5) * 1000, 1000.0, None)
           for i, c in enumerate([1.0, 2.0, 5.0, 10.0], start=1)]
    spl = [("S1", "Sample", None, 2100.0, 1000.0, 5.0), ("inline:S2", "Sample", None, 0.0, 500.0, 0.0),
           ("QC1", "QC", None, 900.0, 1000.0, 2.0)]
    write_xlsx(tmp_path / "Batch_A.xlsx", export_rows(cal + spl))
    write_xlsx(tmp_path / "Batch_B.xlsx", export_rows(cal[:2] + spl[:1]))
    rows = workbook.read_workbooks(spark, str(tmp_path), "A")
    got = rows.filter(F.col("Batch") == "Batch_A").orderBy("RowIndex").collect()
    assert [r.SampleID for r in got] == ["Cal1", "Cal2", "Cal3", "Cal4", "S1", "S2", "QC1"]
    assert [r.RowIndex for r in got] == list(range(1, 8))
    assert got[0].TC_Conc == 1.0 and got[4].Analyte_CalcConc == 5.0
    assert got[0].DateTime.year == 2023
    runs = workbook.to_runs(rows)
    batches = workbook.to_batches(rows, methods(spark), 1)
    q = BatchPipeline(runs, batches).samples
    res = {(r.SampleID): r for r in q.filter(F.col("SampleID").startswith("S")).collect()}
    assert res["S1"].TC_Conc_Uncorrected == pytest.approx(5.0)  # (2.1 - 0.1) / 2 * 5
    assert res["S2"].TC_Conc_Uncorrected == 0.0 and res["S2"].IS_Recovery == pytest.approx(50.0)


def small_batch(slope=2.0, sample=2100.0):
    cal = [(f"Cal{i}", "Cal", c, (0.1 + slope * c / 5) * 1000, 1000.0, None)
           for i, c in enumerate([1.0, 2.0, 5.0, 10.0], start=1)]
    return export_rows([*cal, ("S1", "Sample", None, sample, 1000.0, 5.0)])


def test_wrong_layout_fails_by_name(spark, tmp_path):
    write_xlsx(tmp_path / "Wide.xlsx", small_batch())
    with pytest.raises(Exception, match="Wide.xlsx.*26 columns, the layout has 22"):
        workbook.read_workbooks(spark, str(tmp_path), "B").collect()
    rows = small_batch()
    rows[3] = rows[3] + [7.0]
    write_xlsx(tmp_path / "Wide.xlsx", rows)
    with pytest.raises(Exception, match="27 columns"):
        workbook.read_workbooks(spark, str(tmp_path), "A").collect()


def test_equal_names_in_two_folders_stay_two_batches(spark, tmp_path):
    for folder, slope in (("siteA", 2.0), ("siteB", 4.0)):
        (tmp_path / folder).mkdir()
        write_xlsx(tmp_path / folder / "Run_1.xlsx", small_batch(slope))
    rows = workbook.read_workbooks(spark, str(tmp_path), "A")
    p = BatchPipeline(workbook.to_runs(rows), workbook.to_batches(rows, methods(spark), 1))
    got = p.summary.collect()
    assert sorted(round(r.slope, 9) for r in got) == [2.0, 4.0] and {r.Batch for r in got} == {"Run_1"}


def test_stored_runs_parse_each_file_once(spark, tmp_path, monkeypatch):
    write_xlsx(tmp_path / "Run_1.xlsx", small_batch())
    rows = workbook.read_workbooks(spark, str(tmp_path), "A")
    parsed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            parsed.add(pdf["Path"].nunique())
            yield pdf

    workbook.write_runs(rows.mapInPandas(counted, rows.schema), methods(spark), 1, str(tmp_path / "out"))
    runs, batches = workbook.read_runs(spark, str(tmp_path / "out"))
    got = BatchPipeline(runs, batches).samples.collect()
    assert parsed.value == 1 and [round(r.TC_Conc_Uncorrected, 9) for r in got] == [5.0]


def test_long_sheet_in_bounded_memory(tmp_path):
    """A sheet of many rows is parsed as a stream: what is held at once is far
    below its size, and the rows are those of the whole."""
    import tracemalloc

    names = [n for n, _ in LAYOUTS["A"]]
    rows = [["Batch export"], names] + [[f"S{i}", "Sample", *([float(i)] * 24)] for i in range(20_000)]
    write_xlsx(tmp_path / "Long.xlsx", rows)
    content = (tmp_path / "Long.xlsx").read_bytes()
    tracemalloc.start()
    n = 0
    for n, row in enumerate(workbook.iter_rows(content, 26), start=1):
        assert row[0] == f"S{n - 1}" and row[25] == n - 1
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and held < 12 << 20 < len(content)


def test_stream_reports_bad_sheets(tmp_path):
    names = [n for n, _ in LAYOUTS["A"]]
    for sheet, rows, message in (("Sheet1", [["x"]], "no column names"), ("Other", [["x"], names], "not found")):
        write_xlsx(tmp_path / "Bad.xlsx", rows, sheet)
        with pytest.raises(ValueError, match=message):
            workbook.parse_workbook((tmp_path / "Bad.xlsx").read_bytes(), 26)

