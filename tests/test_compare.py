from calibrix.operators.compare import comparison, full_join_by_sample


def test_comparison_sort_missing_last(spark):
    # differences 5, NULL, 12, 12 -> 12, 12 (acquisition order), 5, NULL
    rows = [(1, 1, "a", 100.0, 105.0), (1, 2, "b", 0.0, 0.0), (1, 3, "c", 100.0, 112.0),
            (1, 4, "d", 100.0, 88.0)]
    q = spark.createDataFrame(rows, "BatchID long, RowIndex long, SampleID string, "
                                    "TC_Conc_Uncorrected double, TC_Conc_Corrected double")
    q = q.selectExpr("*", "true AS correct")
    for c, t in [("IS_Recovery_Corrected", "double"), ("TC_Conc_MassHunter", "double"),
                 ("Set", "string")]:
        q = q.selectExpr("*", f"CAST(NULL AS {t}) AS {c}")
    got = [(r.SampleID, r.Difference_Pct) for r in comparison(q).collect()]
    assert [g[0] for g in got] == ["c", "d", "a", "b"]
    assert got[3][1] is None and round(got[0][1], 9) == 12.0


def test_full_join_matches_missing_keys(spark):
    a = spark.createDataFrame([(1, None, 1.0), (1, "x", 2.0)], "BatchID long, SampleID string, u double")
    b = spark.createDataFrame([(1, None, 9.0), (1, "y", 8.0)], "BatchID long, SampleID string, v double")
    got = {(r.SampleID, r.u, r.v) for r in full_join_by_sample(a, b).collect()}
    assert got == {(None, 1.0, 9.0), ("x", 2.0, None), ("y", None, 8.0)}


def test_full_join_pairs_repeated_keys_one_to_one(spark):
    a = spark.createDataFrame([(1, None, float(i)) for i in range(30)], "BatchID long, SampleID string, u double")
    b = spark.createDataFrame([(1, None, float(i)) for i in range(20)], "BatchID long, SampleID string, v double")
    got = [(r.u, r.v) for r in full_join_by_sample(a, b).collect()]
    assert sorted(got) == [(float(i), float(i) if i < 20 else None) for i in range(30)]


def test_comparison_lists_correcting_methods_only(spark):
    q = spark.createDataFrame([(1, 1, "a", True), (2, 1, "b", False), (3, 1, "c", None)],
                              "BatchID long, RowIndex long, SampleID string, correct boolean")
    for c, t in [("IS_Recovery_Corrected", "double"), ("TC_Conc_MassHunter", "double"), ("Set", "string"),
                 ("TC_Conc_Uncorrected", "double"), ("TC_Conc_Corrected", "double")]:
        q = q.selectExpr("*", f"CAST(NULL AS {t}) AS {c}")
    assert [r.SampleID for r in comparison(q).collect()] == ["a"]


def test_a_hot_key_is_numbered_in_many_tasks(spark):
    """Missing IDs with most of the rows: paired one to one in order, and no
    task's window holds the key."""
    from pyspark.sql import functions as F

    rows = [(1, None, float(i)) for i in range(3000)] + [(1, f"s{i}", -1.0) for i in range(300)]
    a = spark.createDataFrame(rows, "BatchID long, SampleID string, u double").repartition(6)
    b = spark.createDataFrame([(x, y, z + 0.5) for x, y, z in rows[100:]], "BatchID long, SampleID string, v double")
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # few rows would be one range
    spark.conf.set(key, "false")
    try:
        got = full_join_by_sample(a, b).collect()
        pairs = sorted((r.u, r.v) for r in got if r.SampleID is None)
        assert pairs == [(float(i), 100.5 + i if i < 2900 else None) for i in range(3000)]
        assert sum(r.u == -1.0 and r.v == -0.5 for r in got if r.SampleID) == 300
        ranged = a.repartitionByRange("BatchID", "SampleID", "u").withColumn("_range", F.spark_partition_id())
        sizes = [r["count"] for r in ranged.filter("SampleID IS NULL").groupBy("_range").count().collect()]
        assert len(sizes) >= 3 and max(sizes) < 1500
    finally:
        spark.conf.set(key, "true")


def test_full_join_of_empty_sides(spark):
    a = spark.createDataFrame([(1, None, 1.0), (None, "x", 2.0)], "BatchID long, SampleID string, u double")
    none = spark.createDataFrame([], "BatchID long, SampleID string, v double")
    assert {(r.BatchID, r.SampleID, r.u, r.v) for r in full_join_by_sample(a, none).collect()} == {
        (1, None, 1.0, None), (None, "x", 2.0, None)}
    assert full_join_by_sample(none, none.withColumnRenamed("v", "w")).collect() == []
