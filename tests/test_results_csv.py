"""Result files as part files of a folder per batch (byte equality with the
scripts' own files: ``test_result_files``)."""

import glob
import os

import pytest

from calibrix.operators.results import with_units
from calibrix.sources import results_csv
from calibrix.sources.methods import METHODS


def final_rows(spark, method_id, bid, label, ids, conc=1.5):
    m = [x for x in METHODS if x[0] == method_id][0]
    rows = [(bid, i, method_id, m[6], m[4], m[5], label, label, s, 100.0, conc) for i, s in enumerate(ids, start=1)]
    return with_units(spark.createDataFrame(
        rows, "BatchID long, RowIndex long, method_id int, unit_mode string, extract_vol double, dilution_fac double, "
              "batch_label string, Batch string, SampleID string, IS_Recovery double, Concentration double"))


def read_back(spark, out, method_id):
    path = os.path.join(out, f"method={method_id}")
    return sorted(map(tuple, results_csv.read_results(spark, path, method_id).collect()), key=repr)


def test_writes_leave_other_results_alone(spark, tmp_path):
    out = str(tmp_path / "out")
    results_csv.write_results(final_rows(spark, 0, 1, "A", ["a1", "a2"]), out)
    results_csv.write_results(final_rows(spark, 1, 2, "B", ["b1"]), out)
    results_csv.write_results(final_rows(spark, 0, 3, "C", ["c1"]), out)
    results_csv.write_results(final_rows(spark, 0, 4, "A", ["other folder"]), out)
    assert [r[1] for r in read_back(spark, out, 0)] == ["a1", "a2", "other folder", "c1"]
    assert [r[1] for r in read_back(spark, out, 1)] == ["b1"]
    results_csv.write_results(final_rows(spark, 0, 1, "A", ["a3"], conc=2.0), out)
    assert [(r[1], r[3]) for r in read_back(spark, out, 0)] == [("a3", 2.0), ("other folder", 1.5), ("c1", 1.5)]


@pytest.mark.parametrize("method_id", [m[0] for m in METHODS])
def test_text_comes_back_unchanged(spark, tmp_path, method_id):
    ids = [" a\"b,c ", "NA", None, "", "plain", "Ünï", '"', "a b", "tab\t"]
    out = str(tmp_path / "out")
    results_csv.write_results(final_rows(spark, method_id, 1, "x, y", ids), out)
    got = read_back(spark, out, method_id)
    assert sorted((r[1] for r in got), key=repr) == sorted(ids, key=repr) and {r[0] for r in got} == {"x, y"}
    lines = open(glob.glob(f"{out}/method={method_id}/batch=*/BatchID=1/*.txt")[0], encoding="utf-8").read().split("\n")
    assert lines[0] == results_csv.BOM + ",".join(results_csv.result_names(method_id))
    assert lines[1].startswith('"x, y"," a""b,c ",100,1.5') and '"NA"' in lines[2] and ",NA,100" in lines[3]


def test_format_number(spark):
    df = spark.createDataFrame([(3.0,), (105.0,), (36.99415872286471,), (None,),
                                (float("inf"),), (1e-05,), (-2.5,)], "x double")
    got = [r[0] for r in df.select(results_csv.format_number("x")).collect()]
    assert got == ["3", "105", "36.99415872286471", None, "Inf", "1e-05", "-2.5"]
