"""The store: logs replaced one by one, writers that die, and the folder it follows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from seriespan.sources.manifest import Conflict, Store

SCHEMA = "log_id string, channel_id string, seq long, t_ms long, v double"
MARKS = "log_id string, size long, mtime long, parser_version string, format_version string"


def samples(spark, logs, v=0.0, n=5):
    return spark.createDataFrame([(x, c, i, i * 10, v) for x in logs for c in "ab" for i in range(n)], SCHEMA)


def marks(spark, logs, mtime=1):
    return spark.createDataFrame([(x, 5, mtime, "1", "1") for x in logs], MARKS)


def state(store, **more):
    return {(r.log_id, r.v, r.n) for r in store.read(**more).groupBy("log_id", "v").agg(F.count("*").alias("n")).collect()}


def files(path):
    return {os.path.join(r, f): os.stat(os.path.join(r, f)).st_mtime_ns for r, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_replace_add_remove(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    assert store.version() == 0 and store.manifest().count() == 0
    logs = [f"l{i}" for i in range(20)]
    assert store.refresh(samples(spark, logs), marks(spark, logs)) == 1
    assert state(store) == {(x, 0.0, 10) for x in logs}
    before = files(tmp_path / "s")
    new = spark.createDataFrame([("l1",), ("l19",)], "log_id string")
    assert store.refresh(samples(spark, ["l3", "new"], 1.0), marks(spark, ["l3", "new"], 2), new) == 2
    want = {(x, 0.0, 10) for x in logs if x not in ("l1", "l3", "l19")} | {("l3", 1.0, 10), ("new", 1.0, 10)}
    assert state(store) == want
    after = files(tmp_path / "s")
    assert all(after[f] == t for f, t in before.items()) and len(after) > len(before)  # nothing was rewritten
    assert state(store, logs=["l3", "l4", "nowhere"]) == {("l3", 1.0, 10), ("l4", 0.0, 10)}
    assert state(store, version=1) == {(x, 0.0, 10) for x in logs}
    assert {r.mtime for r in store.manifest().where("log_id IN ('l3', 'new')").collect()} == {2}
    store.compact()
    assert state(store) == want and store.manifest().select("commit").distinct().count() == 1
    gone = store.vacuum()
    assert len([g for g in gone if g.startswith("data/")]) == 2 and state(store) == want


def test_logs_and_stores_without_samples(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.refresh(samples(spark, []), marks(spark, ["a"]))
    assert store.read().count() == 0 and store.read().columns == SCHEMA.replace(" string", "").replace(" long", "").replace(" double", "").split(", ")
    assert [(r.log_id, r.samples) for r in store.manifest().collect()] == [("a", 0)]
    store.refresh(samples(spark, ["a", "foreign"]), marks(spark, ["a", "a"]))  # samples of logs not named are not stored
    assert state(store) == {("a", 0.0, 10)}
    store.refresh(samples(spark, []), marks(spark, []), spark.createDataFrame([("a",)], "log_id string"))
    assert store.read().count() == 0 and store.manifest().count() == 0
    store.compact()
    assert store.read().count() == 0


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.refresh(samples(spark, ["a", "b"]), marks(spark, ["a", "b"]))

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(Store, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        store.refresh(samples(spark, ["a"], 9.0), marks(spark, ["a"], 9))
    monkeypatch.undo()
    assert state(store) == {("a", 0.0, 10), ("b", 0.0, 10)} and store.version() == 1
    assert len(store.vacuum()) == 1 and state(store) == {("a", 0.0, 10), ("b", 0.0, 10)}


def test_two_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.refresh(samples(spark, ["a"]), marks(spark, ["a"]))
    mine = store.manifest(1)
    store.refresh(samples(spark, ["b"]), marks(spark, ["b"]))
    with pytest.raises(Conflict):
        store._publish(mine, 1)
    assert state(store) == {("a", 0.0, 10), ("b", 0.0, 10)}


def test_store_follows_a_folder(spark, tmp_path):
    from test_sources import BODY, HEAD

    from seriespan.plans.ingest import refresh_store

    d, store = tmp_path / "logs", Store(spark, str(tmp_path / "s"))
    d.mkdir()
    text = HEAD.format(version="1.1", stamp="11:59:58") + BODY
    for name in "abc":
        (d / f"{name}.csv").write_text(text)
    (d / "bad.csv").write_text("no log")
    (d / "empty.csv").write_text("")

    def run():
        got = refresh_store(spark, str(d), store, parser_version="1", format_version="1")
        return {r.path.rsplit("/", 1)[1]: (r.action, r.status) for r in got.collect()}

    assert run() == {**{f"{n}.csv": ("compute", "ok") for n in "abc"}, "bad.csv": ("compute", "not_native"), "empty.csv": ("compute", "empty")}
    first = {r.log_id.rsplit("/", 1)[1]: r.commit for r in store.manifest().collect()}
    assert set(first) == {"a.csv", "b.csv", "c.csv"}
    (d / "b.csv").write_text(text.replace("1100", "1111", 1) + "00:00:01.000,1,2,3\n")
    (d / "c.csv").unlink()
    (d / "bad.csv").write_text(text)
    got = run()
    assert got == {"a.csv": ("reuse", None), "b.csv": ("compute", "ok"), "c.csv": ("discard", None), "bad.csv": ("compute", "ok"), "empty.csv": ("compute", "empty")}
    second = {r.log_id.rsplit("/", 1)[1]: r.commit for r in store.manifest().collect()}
    assert set(second) == {"a.csv", "b.csv", "bad.csv"} and second["a.csv"] == first["a.csv"] and second["b.csv"] != first["b.csv"]
    values = {(r.log_id.rsplit("/", 1)[1], r.v) for r in store.read().where("channel_id = '384'").collect()}
    assert ("b.csv", 1111.0) in values and ("b.csv", 1100.0) not in values and ("a.csv", 1100.0) in values
