from pyspark.sql import functions as F
from seriespan.llm import common
from seriespan.operators import lookup


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 200), (300, 300), (None, 4)]
    got = {r[0]: r[1] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_attach_with_hot_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_ROWS", 50)
    rows = spark.range(500).selectExpr("id", "CASE WHEN id < 300 THEN 'hot' WHEN id < 320 THEN NULL ELSE cast(id % 40 AS string) END AS k")
    groups = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = lookup.attach(rows, groups, "k", count="n", total=500, spread=F.col("id")).collect()
    want = {}
    for r in rows.collect():
        want.setdefault(r["k"], r["id"])
    assert len(got) == 500
    assert all(r["least"] == (None if r["k"] is None else want[r["k"]]) for r in got)


def test_attach_apart_shuffles_no_served_row(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_ROWS", 50)
    rows = spark.range(500).selectExpr("id", "CASE WHEN id < 300 THEN 'hot' WHEN id < 320 THEN NULL ELSE cast(id % 40 AS string) END AS k")
    groups = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    whole = lookup.attach(rows, groups, "k", count="n", total=500, spread=F.col("id")).collect()
    got = lookup.attach_apart(rows, groups, "k", count="n", total=500).collect()
    assert sorted(got, key=lambda r: r["id"]) == sorted(whole, key=lambda r: r["id"]) and len(got) == 500
