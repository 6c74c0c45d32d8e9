"""Every registered query of the operators, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import oracle
import test_decontamination
import test_minhash
from seriespan import registry
from seriespan.llm import queries  # noqa: F401

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(n for n in registry.QUERIES if n.startswith("op"))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    if name in registry.ORACLES:
        problems, rows, _ = oracle.compare(spark, oracle.connect(FOLDER), name, registry.QUERIES[name], registry.ORACLES[name], FOLDER)
        assert not problems and rows
        return
    got = registry.QUERIES[name](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    if name == "op9_simhash_leaks":
        bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
        rows = docs.collect()
        exact = {(d["doc_id"], b["item_id"]) for d in rows for b in bench if b["text"] in d["text"]}
        assert exact <= {(r["doc_id"], r["item_id"]) for r in got.collect()}
        return
    if name == "op13_whitening":
        vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
        assert got.groupBy("vec_id").count().where("count <> 4").isEmpty() and got.count() == 4 * vectors.count()
        assert got.agg(F.max("identity_error")).first()[0] < 1e-9
        return
    ids = got.select("doc_id")
    assert ids.exceptAll(docs.select("doc_id")).count() == 0 and docs.select("doc_id").exceptAll(ids).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in P.STAGES][1] == "MinHash near-dedup" and len(P.STAGES) == 5
    before = docs
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    for i, (_, stage) in enumerate(P.STAGES):
        after = P.settle(stage(spark, before, FOLDER))
        rows = [tuple(r) for r in before.select("doc_id", "text").collect()] if i in (1, 2) else []
        if i == 1:
            assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in test_minhash.brute(rows) if r[3]}
        if i == 2:
            known = {s for _, t in items for s in test_decontamination.shingles(t.lower().split())}
            near = [r for r in rows if known & set(test_decontamination.shingles(r[1].lower().split()))]
            leaked = {key for key, _ in test_decontamination.brute(near, items)}
            assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in rows} - leaked
        if i == 3:
            copies = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
            mixed = {r["doc_id"]: r["copies"] for r in P.mixing.mix(before).where("copies > 0").select("doc_id", "copies").collect()}
            assert copies == mixed and max(copies.values()) <= 3
        if i < 4:
            assert after.columns == docs.columns
            assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    assert before.columns == [*docs.columns, "shard", "slot"]
    counts = [r[0] for r in before.groupBy("shard").agg(F.count("*")).select("count(1)").collect()]
    assert max(counts) - min(counts) <= 1
    leaked = {r[0] for r in P.decontamination.leaks(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).select("doc_id").collect()}
    assert not leaked
    assert P.minhash.near_duplicates(before.dropDuplicates(["doc_id"]).select("doc_id", "text")).where("NOT kept").count() == 0


def test_pipeline_near_duplicates_by_row(spark):
    """One row of each class stays, whatever doc_id says: equal rows, shared and missing ids."""
    import corpus_pipeline as P
    from frames import words

    base = words(60, 1)
    near = base.replace(base.split()[30], "changed", 1)
    other, third = words(60, 2), words(60, 3)
    rows = [(5, base), (5, base), (5, base), (None, base), (2, near), (7, other), (7, third), (8, other), (None, third), (None, None), (9, "")]
    docs = spark.createDataFrame([(k, t, "en", "x", 1) for k, t in rows], "doc_id long, text string, lang string, source string, _row long").repartition(4)
    got = P.one_of_each(spark, docs, FOLDER)
    assert got.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, [(2, near), (7, other), (7, third), (None, None), (9, "")]))
    plain = docs.where("doc_id IN (2, 8, 9)")
    assert P.one_of_each(spark, plain, FOLDER).count() == 3


def test_pipeline_stages_on_empty_tables(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    assert P.one_of_each(spark, docs, FOLDER).count() == 0 and P.mixed(spark, docs, FOLDER).count() == 0
