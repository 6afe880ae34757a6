import os
import random
import re
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from calibrix.functions.sequence import rank_positions, sequence_within
from calibrix.session import discard, store
from calibrix.sources import adapter


def test_sequence_matches_row_number_with_tiny_chunks(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 4), rng.randint(0, 50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, a int, b int").repartition(7)
    got = sequence_within(df, ["g"], ["a", "b"], "pos", [F.floor(F.col("a") / 5)])
    exp = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("a", "b"))
                        .cast("long"))
    assert got.select("g", "a", "b", "pos").exceptAll(exp.select("g", "a", "b", "pos")).count() == 0
    assert got.count() == 400


def test_rank_positions_with_flag(spark):
    rows = [(1, p, float(p) if p % 3 else None) for p in range(1, 30)] + [(2, 1, 1.0)]
    df = spark.createDataFrame(rows, "g long, p long, y double").repartition(5)
    out = rank_positions(df.filter(F.col("p") != 4), ["g"], "p", "order", width=4,
                         flag=F.col("y").isNotNull(), flag_name="r")
    got = {(r.g, r.p): (r.order, r.r) for r in out.collect()}
    order = r = 0
    for p in range(1, 30):
        if p == 4:
            continue
        order += 1
        if p % 3:
            r += 1
            assert got[(1, p)] == (order, r)
        else:
            assert got[(1, p)] == (order, None)
    assert got[(2, 1)] == (1, 1)


def test_columns_of_the_group_come_with_the_positions(spark):
    """As a left join would bring them: missing groups meet none, repeated ones multiply."""
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, None]), i, f"s{i}") for i in range(1, 200)]
    df = spark.createDataFrame(rows, "g int, p long, s string").repartition(5)
    by = spark.createDataFrame([(1, 1.5), (3, 3.5), (3, 3.25), (None, 9.0), (4, 4.5)], "g int, x double")
    plain = rank_positions(df, ["g"], "p", "order", width=16)
    got = rank_positions(df, ["g"], "p", "order", width=16, by_group=by)
    want = plain.join(by, "g", "left").select(got.columns)
    assert got.columns == ["g", "p", "s", "order", "x"] and got.schema["g"].dataType == df.schema["g"].dataType
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_unread_positions_exchange_nothing(spark, tmp_path):
    spark.range(200).selectExpr("id % 3 as g", "id as p", "cast(id as string) as s").write.parquet(f"{tmp_path}/rows")
    out = rank_positions(spark.read.parquet(f"{tmp_path}/rows"), ["g"], "p", "order", width=16)
    assert exchanges(out) > 0 and exchanges(out.select("g", "s")) == 0


def test_run_table_without_positions_exchanges_nothing(spark, tmp_path):
    rows = [(i // 7, i % 20, i % 3, i % 7 + 1, float(i % 50), i % 11 / 100, i % 9 / 100) for i in range(300)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    runs = adapter.runs(spark, str(tmp_path))
    assert exchanges(runs.filter("Type = 'Cal'").select("BatchID", "TC_Conc", "TC_Response")) == 0
    # What follows from the columns is not exchanged with them.
    wide = [x for x in runs._jdf.queryExecution().executedPlan().toString().splitlines() if "concat_ws" in x]
    assert wide and all("SampleID" in x and "_seq_local" in x for x in wide)
    assert runs.count() == 300


def files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString()


def test_stored_table_leaves_no_exchange(spark):
    before = set(re.findall(r"shuffle_\d+", files(spark)))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    out = store(spark.range(1000).groupBy((F.col("id") % 7).alias("g")).agg(F.count("*").alias("n")))
    until = time.time() + 20
    while set(re.findall(r"shuffle_\d+", files(spark))) - before and time.time() < until:
        time.sleep(0.2)  # they are removed behind the job
    assert not set(re.findall(r"shuffle_\d+", files(spark))) - before
    assert spark.conf.get(key) == was and sum(r["n"] for r in out.collect()) == 1000
    discard(out)
    assert not os.path.exists(out._stored.removeprefix("file:"))
