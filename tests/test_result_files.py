"""One committed result file per batch: bytes, repeats, aborts, whole records."""

import os
import random

import pytest
from pyspark.sql import functions as F

from calibrix.operators.results import with_units
from calibrix.sources import result_files, results_csv
from calibrix.sources.methods import METHODS, RESULT_COLUMNS
from calibrix.sources.number_text import number_text, proven_shortest
from tests.test_results_csv import final_rows

# The folder of the scripts' own result files, where there is one.
GOLDEN = os.environ.get("CALIBRIX_GOLDEN_DIR", "")

# Hand-made files of the scripts' form, a body for each method.
HAND = {
    0: "Run 7,S10,98,36.99415872286471,3,110.98247616859413\nRun 7,S2,105,0.1,3,0.30000000000000004\n",
    1: "Run 7,B1,100,0,3,0\nRun 7,S1,87,228.5,3,685.5\nRun 7,S1,NA,NA,3,NA\n",
    2: "Run 7,S1,101,42.75,20,855\nRun 7,\"a, b\",99,1e-05,20,0.0002\n",
    3: "Run 7,B1,93,0\nRun 7,S1,Inf,965.5000000000001\n",
    4: "Run 7,S1,90,0.067990672727594,10000,679.90672727594006\nNA,lost,NA,NA,NA,NA\n",
}


def files_of(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names
                  if not f.endswith(".crc"))


def finals(spark, method_id, path):
    """Final rows whose unit step gives the file's last columns again."""
    m = [x for x in METHODS if x[0] == method_id][0]
    read = result_files.read_batch_files(spark, path, method_id).coalesce(1).withColumn(
        "RowIndex", F.monotonically_increasing_id())
    df = read.select(
        F.lit(1).cast("long").alias("BatchID"), "RowIndex", F.lit(method_id).alias("method_id"),
        F.lit(m[6]).alias("unit_mode"), F.lit(m[4]).alias("extract_vol"), F.lit(m[5]).cast("double").alias("dilution_fac"),
        F.lit(os.path.basename(path).removesuffix(" Result.csv")).alias("batch_label"), "Batch", "SampleID",
        "IS_Recovery", F.col(RESULT_COLUMNS[method_id][0]).alias("Concentration"), F.col("Batch").isNotNull().alias("_present"))
    return with_units(df)


@pytest.mark.parametrize("kind, method_id", [("hand", m) for m in HAND] + [("given", m) for m in HAND if GOLDEN])
def test_files_are_byte_equal(spark, tmp_path, kind, method_id):
    name = {m[0]: m[1] for m in METHODS}[method_id] + " Result.csv"
    if kind == "hand":
        path = tmp_path / name
        head = ",".join(["Batch", "SampleID", "IS_Recovery", *(c for c in RESULT_COLUMNS[method_id] if c)])
        path.write_bytes(("﻿" + head + "\n" + HAND[method_id]).encode())
    else:
        path = os.path.join(GOLDEN, name)
    out = tmp_path / "out"
    result_files.write_batch_files(finals(spark, method_id, str(path)), str(out))
    assert files_of(out) == [name]
    assert (out / name).read_bytes() == open(path, "rb").read()


def test_number_text():
    shown = {3.0: "3", -2.5: "-2.5", 1e-05: "1e-05", 0.1: "0.1", 0.0: "0", 2 / 3: "0.6666666666666666",
             float("inf"): "Inf", float("-inf"): "-Inf", float("nan"): "NA", None: "NA", 1e14: "100000000000000"}
    assert {x: number_text(x) for x in shown} == shown
    # Doubles as the scripts print them: 64 bits do not prove 16 digits shortest.
    for text in ("679.90672727594006", "320.82803434348523"):
        assert number_text(float(text)) == text and repr(float(text)) != text
    rng = random.Random(2)
    every = [rng.uniform(0, 1000) for _ in range(5000)]
    fallen = [x for x in every if not proven_shortest(x)]
    assert 0 < len(fallen) < 0.02 * len(every)
    for x in [*every, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 2.0**60, 2.0**-60]:
        assert float(number_text(x)) == x


def test_a_repeat_replaces_its_files_and_no_others(spark, tmp_path):
    out = str(tmp_path / "out")
    both = final_rows(spark, 0, 1, "A", ["a1", "a2"]).unionByName(final_rows(spark, 3, 2, "B", ["b1"]))
    result_files.write_batch_files(both, out)
    assert files_of(out) == ["A Result.csv", "B Result.csv"]
    result_files.write_batch_files(final_rows(spark, 0, 1, "A", ["a3"], conc=2.0), out)
    assert files_of(out) == ["A Result.csv", "B Result.csv"]
    got = result_files.read_batch_files(spark, f"{out}/A Result.csv", 0).collect()
    assert [(r.SampleID, r[3], r[5]) for r in got] == [("a3", 2.0, 6.0)]
    before = (tmp_path / "out" / "B Result.csv").read_bytes()
    result_files.write_batch_files(both, out)
    result_files.write_batch_files(both, out)
    assert (tmp_path / "out" / "B Result.csv").read_bytes() == before


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    result_files.write_batch_files(final_rows(spark, 0, 9, "kept", ["k"]), str(out))
    clash = final_rows(spark, 0, 1, "A", ["a1"]).unionByName(final_rows(spark, 0, 2, "A", ["other batch"])).unionByName(
        final_rows(spark, 0, 3, "C", ["c1"]))
    with pytest.raises(Exception, match="batches 1 and 2 have one file name, 'A Result.csv'"):
        result_files.write_batch_files(clash, str(out))
    for name in ("a/b", "../up", ".hidden"):
        with pytest.raises(Exception, match="is no file name"):
            result_files.write_batch_files(final_rows(spark, 0, 1, name, ["a1"]), str(out))
    broken = final_rows(spark, 0, 1, "D", ["d1", "d2"]).withColumn(
        "IS_Recovery", F.when(F.col("SampleID") == "d2", F.raise_error(F.lit("lost"))).otherwise(F.col("IS_Recovery")))
    with pytest.raises(Exception, match="lost"):
        result_files.write_batch_files(broken, str(out))
    assert files_of(out) == ["kept Result.csv"] and os.listdir(out) == ["kept Result.csv"]


def test_commit_takes_one_attempt_of_a_task(tmp_path):
    """What a lost attempt wrote stays out; staging goes with the commit."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(result_files.INPUT)
    writer = result_files.BatchFilesWriter(str(tmp_path))

    def attempt(rows):
        cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
        return writer.write(iter([pa.RecordBatch.from_arrays(cols, schema=schema)]))

    row = ("A Result.csv", 1, 1, 3, "A", "s", 1.0, 2.0, None, None)
    attempt([row, (*row[:5], "half", *row[6:])])  # its message never arrives
    writer.commit([attempt([row]), None])
    assert os.listdir(tmp_path) == ["A Result.csv"] and "half" not in (tmp_path / "A Result.csv").read_text()


def test_acquisition_order_of_a_large_batch(spark, tmp_path):
    ids = [f"s{i}" for i in range(3000)]
    rows = final_rows(spark, 3, 1, "L", ids).repartition(7, "SampleID")
    result_files.write_batch_files(rows, str(tmp_path / "out"))
    lines = (tmp_path / "out" / "L Result.csv").read_text(encoding="utf-8").splitlines()
    assert [line.split(",")[1] for line in lines[1:]] == ids


NASTY_IDS = [" a\"b,c ", "NA", None, "", "two\nlines", "\r\nouter\n", 'quote"\n"s', "Ünï", "tab\t", '"', "\n"]


@pytest.mark.parametrize("method_id", sorted(RESULT_COLUMNS))
def test_records_with_line_breaks_come_back_whole(spark, tmp_path, method_id):
    rows = final_rows(spark, method_id, 1, "x, y", NASTY_IDS)
    result_files.write_batch_files(rows, str(tmp_path / "files"))
    results_csv.write_results(rows, str(tmp_path / "parts"))
    one = result_files.read_batch_files(spark, str(tmp_path / "files"), method_id).collect()
    assert [r.SampleID for r in one] == NASTY_IDS and {r.Batch for r in one} == {"x, y"}
    parts = results_csv.read_results(spark, str(tmp_path / "parts" / f"method={method_id}"), method_id).collect()
    assert sorted(parts, key=repr) == sorted(one, key=repr)


def test_broken_records_fail_by_name(spark, tmp_path):
    (tmp_path / "Bad Result.csv").write_text('A,"open,1,2\n')
    with pytest.raises(Exception, match="Bad Result.csv: a quoted field does not end"):
        result_files.read_batch_files(spark, str(tmp_path), 3).collect()
