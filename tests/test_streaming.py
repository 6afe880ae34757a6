import glob

from calibrix.sources import results_csv
from calibrix.streaming import exports
from tests.test_workbook import export_rows, write_xlsx


def test_stream_processes_new_exports(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    cal = [(f"Cal{i}", "Cal", c, (0.1 + 2 * c / 5) * 1000, 1000.0, None)
           for i, c in enumerate([1.0, 2.0, 5.0, 10.0], start=1)]
    write_xlsx(src / "Run_1.xlsx", export_rows(cal + [("S1", "Sample", None, 2100.0, 1000.0, 5.0)]))
    q = exports.start(spark, str(src), str(out), method_id=1, available_now=True,
                      checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    write_xlsx(src / "Run_2.xlsx", export_rows(cal + [("S9", "Sample", None, 4100.0, 1000.0, 9.0)]))
    q = exports.start(spark, str(src), str(out), method_id=1, available_now=True,
                      checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    df = results_csv.read_results(spark, str(out / "method=1"), 1)
    got = {r.SampleID: r for r in df.collect()}
    assert set(got) == {"S1", "S9"}  # each export processed exactly once
    assert abs(got["S1"].Nicotine_Conc_ng_per_mL - 5.0) < 1e-9
    assert got["S1"].Nicotine_Mass_ng == got["S1"].Nicotine_Conc_ng_per_mL * 3
    assert len(glob.glob(str(out / "method=1" / "batch=Run_1 Result" / "*" / "*.txt"))) >= 1
