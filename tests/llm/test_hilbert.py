import zlib

import numpy as np
import pytest
from frames import documents, empty
from seriespan.llm import hilbert as H


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = H.hilbert_index(grid, bits)
    assert sorted(index.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


DIMENSIONS = [H.Category("source"), H.Category("lang"), H.Numeric("n_chars")]


def check(df, shards=16):
    got = H.hilbert_shards(df, DIMENSIONS, shards=shards).collect()
    assert len(got) == df.count()
    by = {s: [] for s in range(shards)}
    for r in got:
        by[r["shard"]].append(r["slot"])
    counts = [len(x) for x in by.values()]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    keys = [(r["curve"], r["text_crc32"], -1 if r["doc_id"] is None else r["doc_id"]) for r in order]
    assert keys == sorted(keys)
    return got


def test_awkward_rows(spark):
    got = check(documents(spark))
    want = sorted((len((r[0] or "").encode()) + 1, zlib.crc32((r[0] or "").encode())) for r in documents(spark).select("text").collect())
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    assert H.hilbert_shards(empty(spark), DIMENSIONS).count() == 0
    check(documents(spark).unionByName(documents(spark)), shards=5)


def test_one_cell_with_most_rows_is_spread(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "IF(id < 2800, 'hot', cast(id AS string)) AS source", "10L AS n_chars")
    check(df.repartition(8))


def test_rows_are_carried_whole(spark):
    df = documents(spark)
    got = H.sharded_rows(df, DIMENSIONS)
    assert got.columns == [c for c in df.columns if c != "shard"] + ["shard", "slot"]
    assert sorted(map(repr, got.drop("shard", "slot").collect())) == sorted(map(repr, df.drop("shard").collect()))


def test_shards_are_pruned(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text", "concat('l', id % 5) AS lang", "concat('s', id % 40) AS source", "(id * 7919) % 1000 AS n_chars")
    rows = H.hilbert_shards(df, DIMENSIONS)
    boxes = H.manifest(rows)
    code = df.where("source = 's3'").select(H.category_code(df["source"])).first()[0]
    wanted = {r[0] for r in H.prune(boxes, {0: code}).collect()}
    holding = {r[0] for r in rows.join(df.where("source = 's3'"), "doc_id").select("shard").distinct().collect()}
    assert holding <= wanted and len(wanted) <= 10
