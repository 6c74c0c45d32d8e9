"""Multi-resolution roll-ups over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollup as ru
from ..operators.ordered import LOG_TIME, attach_splits
from ..plans.views import counters
from ..sources.pyramid import Pyramid
from . import ORACLES, query
from .conditions import by_log
from .files import fresh

RANKED = """{S}, r AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY t_ms, seq) - 1 AS rn FROM s),
  lv AS (SELECT k AS level, CAST(pow(4, k) AS BIGINT) AS size FROM range(1, 4) t(k)),
  a AS (SELECT log_id, level::INT AS level, rn // size AS bucket, any_value(size) AS size, count(*) AS c,
      min(t_ms) AS t_start, max(t_ms) AS t_end, min(v) AS v_min, max(v) AS v_max,
      arg_min(v, rn) AS v_first, arg_max(v, rn) AS v_last FROM r, lv GROUP BY log_id, level, rn // size),
  b AS (SELECT * FROM a WHERE c = size)
"""
COLS = "log_id, level, bucket, t_start, t_end, v_min, v_max, v_first, v_last"


@query("rollup_continuous", RANKED + f"SELECT {COLS} FROM b")
def rollup_continuous(spark, d):
    return ru.continuous(by_log(spark, d), 3, LOG_TIME).select(*COLS.split(", "))


@query(
    "rollup_level_choice",
    RANKED + """, n AS (SELECT log_id, level, count(*) AS buckets FROM b GROUP BY log_id, level),
  p AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY abs(buckets - 6), level) AS k FROM n)
  SELECT log_id, level, buckets FROM p WHERE k = 1""",
)
def rollup_level_choice(spark, d):
    return ru.choose_level(ru.continuous(by_log(spark, d), 3, LOG_TIME), ["log_id"], 6)


T0, T1 = 1_704_844_800_000, 1_705_708_800_000


@query(
    "rollup_slice",
    RANKED + f""", l AS (SELECT *, c = size AS complete FROM a WHERE level = 1),
  o AS (SELECT log_id, max(bucket) AS last_b, max(bucket) FILTER (t_start <= {T0}) AS open_b FROM l GROUP BY log_id),
  x AS (SELECT o.*, l.complete, l.t_end FROM o LEFT JOIN l ON l.log_id = o.log_id AND l.bucket = o.open_b),
  k AS (SELECT log_id, coalesce(open_b, 0) AS from_b FROM x
    WHERE open_b IS NULL OR (complete AND NOT (open_b = last_b AND t_end < {T0}))),
  z AS (SELECT l.* FROM l JOIN k ON l.log_id = k.log_id AND l.bucket >= k.from_b WHERE l.complete AND l.t_start <= {T1})
  SELECT {COLS}, t_start - min(t_start) OVER (PARTITION BY log_id) AS t_rel FROM z""",
)
def rollup_slice(spark, d):
    r = ru.continuous(by_log(spark, d), 1, LOG_TIME, tail=True)
    return ru.slice_level(r, ["log_id"], 1, T0, T1).select(*COLS.split(", "), "t_rel")


KRANK = """WITH k AS (SELECT user_id AS log_id, event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    event_type AS state, row_number() OVER w - 1 AS rn,
    CAST(json_extract_string(props, '$.k') AS BIGINT) - lag(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER w AS step
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY floor(epoch_us(ts) / 1000), event_id)),
  lv AS (SELECT l AS level, CAST(pow(4, l) AS BIGINT) AS size FROM range(1, 4) t(l))
"""


@query(
    "rollup_counter",
    KRANK + """SELECT log_id, level::INT AS level, rn // size AS bucket, CAST(sum(coalesce(step, 0)) AS BIGINT) AS increase,
    arg_min(k, rn) AS v_first, arg_max(k, rn) AS v_last FROM k, lv GROUP BY log_id, level, size, rn // size HAVING count(*) = size""",
)
def rollup_counter(spark, d):
    k = attach_splits(counters(spark, d), LOG_TIME)
    return ru.counter(k, 3, LOG_TIME, "k").select("log_id", "level", "bucket", "increase", "v_first", "v_last")


@query(
    "rollup_bits",
    KRANK + """SELECT log_id, level::INT AS level, rn // size AS bucket, bit_or(k) AS bits
    FROM k, lv GROUP BY log_id, level, size, rn // size HAVING count(*) = size""",
)
def rollup_bits(spark, d):
    k = attach_splits(counters(spark, d), LOG_TIME)
    return ru.bitmask(k, 3, LOG_TIME, "k").select("log_id", "level", "bucket", "bits")


def _enum_level(src: str, dst: str) -> str:
    return f"""{dst} AS (SELECT log_id, bucket, mode, changed FROM (
    SELECT log_id, b AS bucket, mode, row_number() OVER (PARTITION BY log_id, b ORDER BY votes DESC, first_b) AS pick,
      sum(votes) OVER (PARTITION BY log_id, b) AS kids,
      (count(*) OVER (PARTITION BY log_id, b) > 1) OR bool_or(any_c) OVER (PARTITION BY log_id, b) AS changed
    FROM (SELECT log_id, bucket // 4 AS b, mode, count(*) AS votes, min(bucket) AS first_b, bool_or(changed) AS any_c
      FROM {src} GROUP BY log_id, bucket // 4, mode)) WHERE pick = 1 AND kids = 4)"""


@query(
    "rollup_enum",
    KRANK + ", e0 AS (SELECT log_id, rn AS bucket, state AS mode, FALSE AS changed FROM k), "
    + ", ".join(_enum_level(f"e{i}", f"e{i + 1}") for i in range(3))
    + " " + " UNION ALL ".join(f"SELECT log_id, {i}::INT AS level, bucket, mode, changed FROM e{i}" for i in (1, 2, 3)),
)
def rollup_enum(spark, d):
    return ru.enum(by_log(spark, d), 3, LOG_TIME, "channel_id")


def _grown(spark, rows, kind, value):
    """A pyramid of the rows in three appends, cut in time; some series begin in a later one."""
    grown = Pyramid(spark, fresh(spark, "pyramids"), kind, 3, LOG_TIME, value)
    early, late = F.col("t_ms") < T0, F.col("t_ms") >= T1
    for part in (rows.where(early), rows.where(~early & ~late), rows.where(late)):
        grown.append(part)
    return grown.read()


@query("rollup_append", RANKED + f"SELECT {COLS} FROM b")
def rollup_append(spark, d):
    return _grown(spark, by_log(spark, d), "continuous", "v").select(*COLS.split(", "))


@query("rollup_append_counter", ORACLES["rollup_counter"])
def rollup_append_counter(spark, d):
    return _grown(spark, counters(spark, d), "counter", "k").select("log_id", "level", "bucket", "increase", "v_first", "v_last")


@query("rollup_append_bits", ORACLES["rollup_bits"])
def rollup_append_bits(spark, d):
    return _grown(spark, counters(spark, d), "bitmask", "k").select("log_id", "level", "bucket", "bits")


@query("rollup_append_enum", ORACLES["rollup_enum"])
def rollup_append_enum(spark, d):
    return _grown(spark, by_log(spark, d), "enum", "channel_id").select("log_id", "level", "bucket", "mode", "changed")
