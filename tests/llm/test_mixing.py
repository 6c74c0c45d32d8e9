import math
import random
import re
from collections import defaultdict

import pytest
from frames import documents, empty, words
from seriespan.llm import mixing


def water(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] >= most * sizes[s]}
        if not over:
            return target
        capped |= over


def corpus(spark, n=400):
    r, rows = random.Random(3), []
    for i in range(n):
        source = r.choice(["a", "a", "a", "a", "B", "c", "tiny" if i % 50 == 0 else "d", None])
        rows.append((i, words(r.choice([1, 5, 20, 20, 20, 80, 300]), i), source))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_caps_and_reruns(spark):
    df = corpus(spark)
    got = mixing.mix(df).collect()
    sizes, taken, target, longest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) and 0 <= r["copies"] <= 3
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(r["source_size"] == sizes[r["source"]] for r in got)
    want = water(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 20)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_rates_solve_the_dual(spark):
    df = corpus(spark)
    cells = df.selectExpr("coalesce(concat('0', source), '1') AS _s", "cast(size(split(text, ' ')) AS long) AS _size", "1L AS _n")
    cells = cells.groupBy("_s", "_size").agg({"_n": "sum"}).withColumnRenamed("sum(_n)", "_n")
    targets = mixing.source_targets(cells)
    dual = {r["_s"]: r for r in mixing.balance(cells, targets).collect()}
    want = {r["_s"]: r for r in targets.collect()}
    for s, r in dual.items():
        words_ = sum(c["_n"] * c["_size"] * min(3, math.exp(min(r["lambda"] * c["_size"] / r["mean"], 9))) for c in cells.where(f"_s = '{s}'").collect())
        assert words_ == pytest.approx(want[s]["target"], rel=1e-5)


def test_awkward_rows(spark):
    df = documents(spark)
    got = mixing.mix(df)
    assert got.count() == df.count() and mixing.mix(empty(spark)).count() == 0
    assert set(df.columns) <= set(got.columns)
    assert all(r["taken"] == 0 for r in got.where("size = 0").collect())
    again = mixing.repeated(df)
    assert again.columns == df.columns and again.count() == sum(r["copies"] for r in got.where("size > 0").collect())


def test_the_mix_keeps_input_columns(spark):
    rows = [(i, words(5 + i, i), "ab"[i % 2], 77, 88, "t", -1, -2) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, source_size long, target string, copies int, taken long")
    mixed = mixing.repeated(df)
    assert mixed.columns == df.columns
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in df.collect()} and mixed.count() > 0
    assert all(r["size"] not in (77,) and r["target"] != "t" for r in mixing.mix(df).collect())


def test_reruns_agree_on_rows_that_share_an_id(spark):
    rows = [(i % 3 if i % 4 else None, words(6, i), "a" if i % 2 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted(map(repr, mixing.repeated(df.repartition(3)).collect()))
    assert one == sorted(map(repr, mixing.repeated(df.repartition(7)).collect()))


def test_only_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.mix(df).collect()] == [(0, 0), (0, 0)]


def test_one_large_group_of_copies(spark):
    rows = [(i, "same words here", "a") for i in range(500)] + [(500 + i, words(10, i), "b") for i in range(60)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source", "target").agg({"taken": "sum"}).collect()
    for _, target, taken in got:
        assert abs(taken - target) <= 3


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(corpus(spark, 50))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
