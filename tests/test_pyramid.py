"""Pyramids grown in appends against pyramids of all rows at once."""

from __future__ import annotations

import random

import pytest

from seriespan.operators import rollup as ru
from seriespan.operators.ordered import LOG_TIME
from seriespan.sources.pyramid import Pyramid

SCHEMA = "log_id string, t_ms long, seq long, v long"
WHOLE = {"continuous": ru.continuous, "counter": ru.counter, "bitmask": ru.bitmask, "enum": ru.enum}


def rows(seed, logs=("a", "b", "c"), n=150):
    r = random.Random(seed)
    out = []
    for x in logs:
        t = 0
        for i in range(r.randint(1, n)):
            t += r.choice([0, 1, 7])
            out.append((x, t, i, r.randint(0, 4)))
    return out


def flat(df):
    return sorted(map(repr, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("kind", WHOLE)
def test_appends_equal_one_go(spark, tmp_path, kind):
    all_rows = rows(1) + [("late", 5, 0, 1), ("late", 5, 1, 1)] + [("exact", i, i, i % 3) for i in range(64)]
    r = random.Random(2)
    cut = {}
    for x in {row[0] for row in all_rows}:
        n = sum(row[0] == x for row in all_rows)
        cut[x] = sorted(r.randint(0, n) for _ in range(3))
    cut["exact"] = [16, 16, 64]
    seen, parts = {}, [[], [], [], []]
    for row in all_rows:
        i = seen.get(row[0], 0)
        seen[row[0]] = i + 1
        parts[sum(i >= c for c in cut[row[0]])].append(row)
    grown = Pyramid(spark, str(tmp_path / kind), kind, 3, LOG_TIME)
    for k, part in enumerate([*parts, []]):
        assert grown.append(spark.createDataFrame(part, SCHEMA)) == k + 1
    want = WHOLE[kind](spark.createDataFrame(all_rows, SCHEMA), 3, LOG_TIME)
    assert flat(grown.read()) == flat(want.select(*grown.read().columns)) and want.count() > 60
    assert grown.read([2]).count() == want.where("level = 2").count()
    if kind != "enum":
        assert grown.tail().groupBy("log_id", "level").count().where("count > 1").isEmpty()
    else:
        assert grown.tail().groupBy("log_id", "level").count().where("count > 3").isEmpty()


def test_rows_out_of_order_are_refused(spark, tmp_path):
    grown = Pyramid(spark, str(tmp_path / "p"), "continuous", 2, LOG_TIME)
    grown.append(spark.createDataFrame([("a", i, i, i) for i in range(9)], SCHEMA))
    with pytest.raises(ValueError, match="behind"):
        grown.append(spark.createDataFrame([("a", 3, 3, 3), ("b", 0, 0, 0)], SCHEMA))
    assert grown.version() == 1 and grown.read().count() == 2
    grown.append(spark.createDataFrame([("a", 9, 9, 9), ("b", 0, 0, 0)], SCHEMA))
    assert grown.read().count() == 2 and grown.tail().where("log_id = 'b'").count() == 2


def test_a_broken_append_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    from seriespan.sources import pyramid

    grown = Pyramid(spark, str(tmp_path / "p"), "continuous", 2, LOG_TIME)
    first = spark.createDataFrame([("a", i, i, i) for i in range(9)], SCHEMA)
    grown.append(first)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(pyramid, "publish", killed)
    with pytest.raises(KeyboardInterrupt):
        grown.append(spark.createDataFrame([("a", 10 + i, 10 + i, i) for i in range(9)], SCHEMA))
    monkeypatch.undo()
    assert grown.version() == 1 and grown.read().count() == 2
    grown.append(spark.createDataFrame([("a", 10 + i, 10 + i, i) for i in range(7)], SCHEMA))
    assert flat(grown.read().where("level = 2")) and grown.read().where("level = 1").count() == 4


def test_empty(spark, tmp_path):
    grown = Pyramid(spark, str(tmp_path / "p"), "bitmask", 2, LOG_TIME)
    with pytest.raises(ValueError, match="nothing"):
        grown.read()
    grown.append(spark.createDataFrame([], SCHEMA))
    assert grown.read().count() == 0 and "bits" in grown.read().columns
    with pytest.raises(ValueError, match="kind"):
        Pyramid(spark, "x", "other", 1)
