"""Binned statistics over lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mesh as m
from ..plans.views import table
from . import query

QTY = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]
DISC = [0.0, 0.02, 0.04, 0.06, 0.08, 0.10]


def _bin(col: str, edges: list[float]) -> str:
    inner = " + ".join(f"({col} >= CAST({e!r} AS DOUBLE))::INT" for e in edges[1:-1])
    return f"CASE WHEN {col} >= CAST({edges[0]!r} AS DOUBLE) AND {col} <= CAST({edges[-1]!r} AS DOUBLE) THEN {inner} END"


CELLS = f"""WITH b AS (SELECT l_returnflag AS flag, {_bin('l_quantity', QTY)} AS i, {_bin('l_discount', DISC)} AS j,
    l_extendedprice AS v FROM lineitem),
  c AS (SELECT flag, i, j, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi
    FROM b WHERE i IS NOT NULL AND j IS NOT NULL AND v IS NOT NULL GROUP BY flag, i, j)
"""
R = "round(mean, 4) AS mean, round(sd, 4) AS sd, lo, hi"


def _cells(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return m.mesh(li, ["flag"], F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice"), QTY, DISC)


def _rounded(df, places=4):
    return df.withColumns({c: F.round(c, places) for c in ("mean", "sd")})


@query("mesh_2d", CELLS + f"SELECT flag, i, j, n, {R} FROM c")
def mesh_2d(spark, d):
    return _rounded(_cells(spark, d))


@query(
    "mesh_dense",
    CELLS + f""", f AS (SELECT DISTINCT flag FROM c), g AS (SELECT flag, a.i::INT AS i, b.j::INT AS j
    FROM f, range(0, 5) a(i), range(0, 5) b(j))
  SELECT g.flag, g.i, g.j, coalesce(n, 0) AS n, {R} FROM g LEFT JOIN c USING (flag, i, j)""",
)
def mesh_dense(spark, d):
    return _rounded(m.dense(_cells(spark, d), ["flag"], 5, 5))


@query(
    "mesh_compare",
    CELLS + """SELECT a.i, a.j, least(a.n, b.n) AS n, round(a.mean - b.mean, 4) AS mean, round(a.sd - b.sd, 4) AS sd,
    round(a.lo - b.lo, 4) AS lo, round(a.hi - b.hi, 4) AS hi FROM c a JOIN c b ON a.i = b.i AND a.j = b.j
    WHERE a.flag = 'A' AND b.flag = 'R'""",
)
def mesh_compare(spark, d):
    cells = _cells(spark, d)
    before = cells.filter("flag = 'A'").drop("flag")
    after = cells.filter("flag = 'R'").drop("flag")
    out = m.compare(before, after, [])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "sd", "lo", "hi")})


@query(
    "mesh_comparable",
    """WITH e AS (SELECT l_returnflag AS flag, l_linenumber % 2 AS side, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1, 2)
  SELECT a.flag, a.flag = 'A' OR (a.lo = b.lo AND a.hi = b.hi) AS comparable, CASE WHEN NOT (a.flag = 'A' OR (a.lo = b.lo AND a.hi = b.hi)) THEN 'different_edges' END AS reason
  FROM e a JOIN e b ON a.flag = b.flag AND a.side = 1 AND b.side = 0 WHERE a.flag <> 'R'
  UNION ALL SELECT flag, FALSE, 'missing' FROM e WHERE flag = 'R' AND side = 1""",
)
def mesh_comparable(spark, d):
    """Flag A is held against its own edges, R has no counterpart."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag")
    odd = m.edge_table(li.filter("l_linenumber % 2 = 1"), ["flag"], F.col("l_extendedprice"), 8)
    even = m.edge_table(li.filter("l_linenumber % 2 = 0"), ["flag"], F.col("l_extendedprice"), 8)
    after = even.filter("flag NOT IN ('A', 'R')").unionByName(odd.filter("flag = 'A'"))
    return m.comparable_edges(odd, after, ["flag"])


@query(
    "mesh_default_edges",
    """WITH e AS (SELECT l_returnflag AS flag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1)
  SELECT flag, k::INT AS k, round(CASE WHEN k = 8 THEN hi ELSE lo + (hi - lo) / 8.0 * k END, 6) AS edge FROM e, range(0, 9) r(k)""",
)
def mesh_default_edges(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return m.edge_table(li, ["flag"], F.col("l_extendedprice"), 8).select(
        "flag", F.posexplode("edges").alias("k", "edge")
    ).withColumn("edge", F.round("edge", 6))


@query(
    "correction_table",
    f"""WITH b AS (SELECT {_bin('l_quantity', QTY)} AS i, {_bin('l_discount', DISC)} AS j,
    l_extendedprice / (l_quantity * 1000) - 1 AS v FROM lineitem WHERE NOT (l_tax > 0.06)),
  c AS (SELECT i, j, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS sd FROM b
    WHERE i IS NOT NULL AND j IS NOT NULL AND v IS NOT NULL GROUP BY i, j)
  SELECT i, j, n, round(CASE WHEN n >= 20 THEN mean * 100 END, 4) AS correction_pct, coalesce(sd > 0.3, FALSE) AS unreliable FROM c""",
)
def correction_table(spark, d):
    li = table(spark, d, "lineitem").filter(~(F.col("l_tax") > 0.06))
    error = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity") * 1000) - 1
    cells = m.mesh(li, [], F.col("l_quantity"), F.col("l_discount"), error, QTY, DISC)
    out = m.correction_table(cells, 20, 0.3)
    return out.select("i", "j", "n", F.round("correction_pct", 4).alias("correction_pct"), "unreliable")
