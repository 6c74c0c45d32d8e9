"""Virtual axes over several logs, the folder index, incidents and gating."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import axes, folder_index as fi, incidents as inc
from ..operators.ordered import LOG_FILE, LOG_TIME, attach_splits
from ..operators import quality
from ..plans.views import samples, table
from . import query
from .phases import DAY, cold_events
from .quality import GAPS, SHUFFLED
from .sql import limit, runs

SPANS = """{S}, lg AS (SELECT log_id, log_id % 10 AS session, log_id * 7 % 150 AS ord, min(t_ms) AS t_start, max(t_ms) AS t_end FROM s GROUP BY log_id)
"""


def _logs(spark, d):
    return axes.log_spans(samples(spark, d)).select(
        "log_id", F.pmod("log_id", F.lit(10)).alias("session"), F.pmod(F.col("log_id") * 7, F.lit(150)).alias("ord"),
        "t_start", "t_end",
    )


CONCAT = SPANS + """, cc AS (SELECT *, coalesce(sum(t_end - t_start + 1000) OVER (PARTITION BY session ORDER BY ord, log_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_x, lag(log_id) OVER (PARTITION BY session ORDER BY ord, log_id) AS previous_log FROM lg),
  co AS (SELECT log_id, session, begin_x - t_start AS "offset", begin_x AS x_start, begin_x + t_end - t_start AS x_end, previous_log,
    CASE WHEN previous_log IS NOT NULL THEN begin_x - 1000 END AS previous_x_end FROM cc)
"""


@query("concatenated_timeline", CONCAT + "SELECT * FROM co")
def concatenated_timeline(spark, d):
    return axes.concatenated(_logs(spark, d), ["session"]).select(
        "log_id", "session", "offset", "x_start", "x_end", "previous_log", "previous_x_end"
    )


@query("concatenated_samples", CONCAT + 'SELECT session, log_id, channel_id, seq, t_ms + "offset" AS x, v FROM s JOIN co USING (log_id)')
def concatenated_samples(spark, d):
    o = axes.concatenated(_logs(spark, d), ["session"])
    return axes.place(samples(spark, d), o, ["session"]).select("session", "log_id", "channel_id", "seq", "x", "v")


@query(
    "parallel_timeline",
    SPANS + """, o AS (SELECT *, (log_id % 3) * 1000 AS raw FROM lg)
  SELECT log_id, session, raw - min(raw + t_start) OVER (PARTITION BY session) AS "offset" FROM o""",
)
def parallel_timeline(spark, d):
    out = axes.parallel(_logs(spark, d), ["session"], F.pmod("log_id", F.lit(3)) * 1000)
    return out.select("log_id", "session", "offset")


@query(
    "virtual_range",
    SPANS + """, o AS (SELECT *, -min(t_start) OVER (PARTITION BY session) AS off FROM lg)
  SELECT session, min(t_start + off) AS x_min, max(t_end + off) AS x_max FROM o GROUP BY session""",
)
def virtual_range(spark, d):
    return axes.virtual_range(axes.parallel(_logs(spark, d), ["session"]), ["session"])


@query(
    "clock_offsets",
    SPANS + """, c AS (SELECT *, CASE WHEN log_id % 50 = 9 THEN 'unknown' ELSE 'reliable' END AS reliability FROM lg),
  b AS (SELECT session, min(t_start) AS t0, bool_or(reliability <> 'reliable') AS bad FROM c GROUP BY session)
  SELECT log_id, session, CASE WHEN NOT bad THEN t_start - t0 END AS raw_offset, CASE WHEN bad THEN 'unreliable_clock' ELSE 'ok' END AS clock_status FROM c JOIN b USING (session)""",
)
def clock_offsets(spark, d):
    logs = _logs(spark, d).withColumns(
        {
            "t0": F.timestamp_millis("t_start"),
            "reliability": F.when(F.col("log_id") % 50 == 9, "unknown").otherwise("reliable"),
        }
    )
    return axes.clock_offsets(logs, ["session"]).select("log_id", "session", "raw_offset", "clock_status")


COLD = "{S}, c AS (SELECT *, " + limit("v", "60.0::DOUBLE", True, 0.1) + " AS hot FROM s), " + runs("c", "coalesce(hot, FALSE)", "r") + """,
  e AS (SELECT log_id, run, min(t_ms) AS t_start, max(t_ms) AS t_end, count(*) AS n, max(v) AS peak FROM r WHERE st GROUP BY log_id, run)
"""


@query(
    "event_anchor",
    COLD + """, f AS (SELECT log_id, min(t_start) AS a FROM e GROUP BY log_id),
  z AS (SELECT lg.log_id, a, CASE WHEN NOT bool_or_present THEN 'role_missing' WHEN pending THEN 'role_unconfirmed' WHEN a IS NULL THEN 'event_absent' END AS reason
    FROM (SELECT log_id, bool_or(channel_id = 'signup' AND v > 80) AS bool_or_present, bool_or(channel_id = 'error' AND v > 200) AS pending FROM s GROUP BY log_id) lg LEFT JOIN f USING (log_id))
  SELECT log_id, CASE WHEN reason IS NULL THEN a END AS anchor_ms, CASE WHEN reason IS NULL THEN -a END AS "offset", reason FROM z""",
)
def event_anchor(spark, d):
    s = samples(spark, d)
    logs = s.select("log_id").distinct()
    present = s.filter("channel_id = 'signup' AND v > 80").select("log_id")
    pending = s.filter("channel_id = 'error' AND v > 200").select("log_id")
    return axes.anchors(logs, cold_events(spark, d), present, pending)


PAIRS = """{S}, st AS (SELECT log_id, min(t_ms) AS t0 FROM s GROUP BY log_id),
  pr AS (SELECT a.log_id AS pair_id, a.log_id AS log_a, -a.t0 AS oa, b.log_id AS log_b, -b.t0 AS ob FROM st a JOIN st b ON b.log_id = a.log_id + 1)
"""


def _pairs(spark, d):
    st = axes.log_spans(samples(spark, d)).select("log_id", (-F.col("t_start")).alias("o"))
    a = st.select(F.col("log_id").alias("log_a"), F.col("o").alias("offset_a"), (F.col("log_id") + 1).alias("log_b"))
    b = st.select(F.col("log_id").alias("log_b"), F.col("o").alias("offset_b"))
    return a.join(b, "log_b").withColumn("pair_id", F.col("log_a"))


@query(
    "log_delta",
    PAIRS + """, a AS (SELECT pair_id, seq, t_ms + oa AS x, v FROM pr JOIN s ON s.log_id = log_a WHERE channel_id = 'click'),
  b AS (SELECT pair_id, t_ms + ob AS x, v FROM pr JOIN s ON s.log_id = log_b WHERE channel_id = 'click'),
  j AS (SELECT a.pair_id, a.seq, a.x, a.v AS here, CASE WHEN a.x - b.x <= 259200000 THEN b.v END AS there FROM a ASOF LEFT JOIN b ON a.pair_id = b.pair_id AND a.x >= b.x)
  SELECT pair_id, seq, x, here, there, round(here - there, 6) AS delta FROM j""",
)
def log_delta(spark, d):
    out = axes.log_delta(samples(spark, d), _pairs(spark, d), "click", 3 * DAY)
    return out.withColumn("delta", F.round("delta", 6))


@query(
    "best_lag",
    PAIRS + """, g AS (SELECT log_id, (t_ms - t0) // 86400000 AS b, avg(v) AS v FROM s JOIN st USING (log_id) WHERE channel_id = 'click' GROUP BY 1, 2),
  g0 AS (SELECT s.log_id, min(t_ms) AS c0 FROM s WHERE channel_id = 'click' GROUP BY 1),
  h AS (SELECT s.log_id, (t_ms - c0) // 86400000 AS b, avg(v) AS v FROM s JOIN g0 USING (log_id) WHERE channel_id = 'click' GROUP BY 1, 2),
  l AS (SELECT pair_id, lag, corr(a.v, b.v) AS r, count(*) AS overlap FROM pr JOIN h a ON a.log_id = log_a, range(-5, 6) q(lag), h b
    WHERE b.log_id = log_b AND b.b + lag = a.b GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY round(r, 9) DESC, abs(lag), lag DESC) AS p FROM l WHERE overlap >= 4 AND r IS NOT NULL AND NOT isnan(r))
  SELECT pair_id, CAST(lag AS INT) AS lag, lag * 86400000 AS offset_ms, round(r, 6) AS r, overlap FROM k WHERE p = 1""",
)
def best_lag(spark, d):
    out = axes.best_lag(samples(spark, d), _pairs(spark, d), "click", DAY, 5, 4)
    return out.select("pair_id", "lag", F.col("offset_ms").cast("bigint").alias("offset_ms"), F.round("r", 6).alias("r"), "overlap")


def _lagged(width: int, lags: str) -> str:
    return f"""SELECT pair_id, lag, corr(a.v, b.v) AS r, count(*) AS overlap FROM pr JOIN h{width} a ON a.log_id = log_a, range({lags}) q(lag), h{width} b
    WHERE b.log_id = log_b AND b.b + lag = a.b GROUP BY 1, 2"""


def _grid(width: int) -> str:
    return f"""h{width} AS (SELECT s.log_id, (t_ms - c0) // {width} AS b, avg(v) AS v FROM s JOIN g0 USING (log_id) WHERE channel_id = 'click' GROUP BY 1, 2)"""


BEST = "row_number() OVER (PARTITION BY pair_id ORDER BY round(r, 9) DESC, abs(lag), lag DESC) AS p"


@query(
    "best_lag_refined",
    PAIRS + f""", g0 AS (SELECT s.log_id, min(t_ms) AS c0 FROM s WHERE channel_id = 'click' GROUP BY 1), {_grid(DAY)}, {_grid(DAY // 4)},
  l AS ({_lagged(DAY, "-5, 6")}), k AS (SELECT *, {BEST} FROM l WHERE overlap >= 4 AND r IS NOT NULL AND NOT isnan(r)),
  c AS (SELECT pair_id AS pc, 4 * lag AS centre FROM k WHERE p = 1),
  l2 AS (SELECT pair_id, lag, corr(a.v, b.v) AS r, count(*) AS overlap FROM pr JOIN c ON pc = pair_id JOIN h{DAY // 4} a ON a.log_id = log_a, range(-24, 25) q(lag), h{DAY // 4} b
    WHERE b.log_id = log_b AND b.b + lag = a.b AND abs(lag - centre) <= 4 GROUP BY 1, 2),
  k2 AS (SELECT *, {BEST} FROM l2 WHERE overlap >= 4 AND r IS NOT NULL AND NOT isnan(r))
  SELECT pair_id, CAST(lag AS INT) AS lag, lag * {DAY // 4} AS offset_ms, round(r, 6) AS r, overlap FROM k2 WHERE p = 1""",
)
def best_lag_refined(spark, d):
    """Lags of whole days first, then of quarter days around the best."""
    out = axes.best_lag_refined(samples(spark, d), _pairs(spark, d), "click", DAY // 4, 5, 4, 4)
    return out.select("pair_id", "lag", F.col("offset_ms").cast("bigint").alias("offset_ms"), F.round("r", 6).alias("r"), "overlap")


@query(
    "concatenated_series",
    CONCAT + """SELECT session, CASE channel_id WHEN 'click' THEN 'g1' WHEN 'view' THEN 'g2' END AS group_id, log_id, t_ms + "offset" AS x, seq, v
    FROM s JOIN co USING (log_id) WHERE channel_id IN ('click', 'view')""",
)
def concatenated_series(spark, d):
    s = samples(spark, d)
    matched = s.filter(F.col("channel_id").isin("click", "view")).select("log_id", "channel_id").distinct().withColumn(
        "group_id", F.when(F.col("channel_id") == "click", "g1").otherwise("g2")
    )
    o = axes.concatenated(_logs(spark, d), ["session"])
    return axes.concatenate_series(s, matched, o, ["session"])


INDEX = """WITH li AS (SELECT '/logs/' || o_orderkey || '.csv' AS path, o_custkey AS size, epoch_ms(o_orderdate) AS mtime FROM orders WHERE o_orderpriority <> '5-LOW'),
  ix AS (SELECT '/logs/' || o_orderkey || '.csv' AS path, o_custkey + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS size, epoch_ms(o_orderdate) AS mtime,
    CASE WHEN o_orderpriority = '1-URGENT' THEN '1' ELSE '2' END AS parser_version, 'f1' AS format_version, 'ok' AS status, o_totalprice AS metric FROM orders WHERE o_totalprice < 300000),
  pn AS (SELECT path, CASE WHEN li.path IS NULL THEN 'discard' WHEN ix.path IS NOT NULL AND li.size = ix.size AND li.mtime = ix.mtime AND parser_version = '2' THEN 'reuse' ELSE 'compute' END AS action,
    li.size AS size, li.mtime AS mtime FROM li FULL JOIN ix USING (path))
"""


def _index(spark, d):
    o = table(spark, d, "orders")
    path = F.concat(F.lit("/logs/"), "o_orderkey", F.lit(".csv"))
    micros = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)")
    listing = o.filter(F.col("o_orderpriority") != "5-LOW").select(path.alias("path"), F.col("o_custkey").alias("size"), micros.alias("mtime"))
    index = o.filter(F.col("o_totalprice") < 300000).select(
        path.alias("path"), (F.col("o_custkey") + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("size"), micros.alias("mtime"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "1").otherwise("2").alias("parser_version"), F.lit("f1").alias("format_version"),
        F.lit("ok").alias("status"), F.col("o_totalprice").alias("metric"),
    )
    return listing, index


@query("index_plan", INDEX + "SELECT path, action, size, mtime FROM pn")
def index_plan(spark, d):
    return fi.plan(*_index(spark, d), "2", "f1")


@query(
    "index_merge",
    INDEX + """SELECT path, size, mtime, parser_version, format_version, status, metric FROM ix SEMI JOIN (SELECT path FROM pn WHERE action = 'reuse') USING (path)
  UNION ALL SELECT pn.path, pn.size, pn.mtime, '2', 'f1', CASE WHEN pn.size % 9 = 0 THEN 'error' ELSE 'ok' END, CASE WHEN pn.size % 9 <> 0 THEN pn.size * 2.0::DOUBLE END FROM pn WHERE action = 'compute'""",
)
def index_merge(spark, d):
    listing, index = _index(spark, d)
    planned = fi.plan(listing, index, "2", "f1")
    bad = F.col("size") % 9 == 0
    computed = listing.select(
        "path", F.when(bad, "error").otherwise("ok").alias("status"), F.when(~bad, F.col("size") * 2.0).alias("metric")
    )
    return fi.merge(planned, index, computed, "2", "f1")


@query(
    "fingerprint_equality",
    INDEX + """, nw AS (SELECT *, CASE WHEN size % 3 = 0 THEN '2' ELSE '1' END AS pv, CASE WHEN size % 5 <> 0 THEN 'f1' END AS fv FROM li)
  SELECT path, nw.size IS NOT DISTINCT FROM ix.size AND nw.mtime IS NOT DISTINCT FROM ix.mtime AND nw.pv IS NOT DISTINCT FROM ix.parser_version AND nw.fv IS NOT DISTINCT FROM ix.format_version AS same FROM nw JOIN ix USING (path)""",
)
def fingerprint_equality(spark, d):
    listing, index = _index(spark, d)
    now = listing.withColumns({
        "parser_version": F.when(F.col("size") % 3 == 0, "2").otherwise("1"),
        "format_version": F.when(F.col("size") % 5 != 0, "f1"),
    })
    a = now.select("path", F.struct(*[F.col(c).alias(c) for c in fi.FINGERPRINT]).alias("a"))
    b = index.select("path", F.struct(*[F.col(c).alias(c) for c in fi.FINGERPRINT]).alias("b"))
    return a.join(b, "path").select("path", fi.same_fingerprint(F.col("a"), F.col("b")).alias("same"))


@query(
    "candidate_files",
    """SELECT url AS path, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS extension, CASE WHEN lower(regexp_extract(url, '(\\.[^./]+)$', 1)) IN ('.csv', '.txt', '.log') THEN NULL
    WHEN regexp_extract(url, '(\\.[^./]+)$', 1) = '' THEN 'no_extension' ELSE 'unsupported_extension' END AS discard_reason FROM (
    SELECT url || CASE page_id % 4 WHEN 0 THEN '.CSV' WHEN 1 THEN '.log' WHEN 2 THEN '.xlsx' ELSE '/raw' END AS url FROM pages)""",
)
def candidate_files(spark, d):
    k = F.col("page_id") % 4
    tail = F.when(k == 0, ".CSV").when(k == 1, ".log").when(k == 2, ".xlsx").otherwise("/raw")
    listing = table(spark, d, "pages").select(F.concat("url", tail).alias("path"))
    return fi.candidates(listing)


INC = COLD + """, i AS (SELECT log_id, 'D' || (1 + log_id % 3) AS detector, t_start, CASE WHEN n % 5 = 0 THEN NULL ELSE t_end END AS t_end,
    CASE WHEN peak > 150 THEN 'critica' WHEN peak > 100 THEN 'alta' ELSE 'media' END AS severity, peak FROM e)
"""


def _incidents(spark, d):
    from ..operators.conditions import judge, limit as alert
    from ..operators.events import events

    s = judge(attach_splits(samples(spark, d), LOG_TIME), LOG_TIME, {"c": alert(F.col("v"), 60.0, above=True, margin=0.1)})
    found = events(s, LOG_TIME, F.col("c"), aggregates={"peak": ("max", F.col("v"))}).withColumn(
        "t_end", F.when(F.col("n") % 5 != 0, F.col("t_end"))
    )
    sev = F.when(F.col("peak") > 150, "critica").when(F.col("peak") > 100, "alta").otherwise("media")
    out = inc.as_incidents(found, "D", sev, {"peak": F.col("peak")})
    return out.withColumn("detector", F.concat(F.lit("D"), F.pmod("log_id", F.lit(3)) + 1))


@query(
    "incidents_ordered",
    INC + """SELECT CAST(CASE severity WHEN 'critica' THEN 0 WHEN 'alta' THEN 1 ELSE 2 END AS INT) AS rank, log_id, detector, t_start, t_end, severity, peak FROM i""",
)
def incidents_ordered(spark, d):
    out = inc.ordered(_incidents(spark, d))
    return out.select("rank", "log_id", "detector", "t_start", "t_end", "severity", F.col("detail")["peak"].alias("peak"))


@query(
    "incidents_by_detector",
    INC + """, dt(detector) AS (VALUES ('D1'), ('D2'), ('D3'), ('D4'))
  SELECT dt.detector, count(i.log_id) AS incidents, round(coalesce(sum(t_end - t_start), 0) / 1000.0, 3) AS seconds, coalesce(bool_or(i.log_id IS NOT NULL AND t_end IS NULL), FALSE) AS has_open
  FROM dt LEFT JOIN i USING (detector) GROUP BY dt.detector""",
)
def incidents_by_detector(spark, d):
    names = spark.createDataFrame([("D1",), ("D2",), ("D3",), ("D4",)], "detector string")
    return inc.by_detector(_incidents(spark, d), names).withColumn("seconds", F.round("seconds", 3))


@query(
    "incidents_by_severity",
    INC + """, sv(rank, severity) AS (VALUES (0, 'critica'), (1, 'alta'), (2, 'media'), (3, 'baja'), (4, 'informativa'))
  SELECT rank, severity, count(i.log_id) AS incidents FROM sv LEFT JOIN i USING (severity) GROUP BY 1, 2""",
)
def incidents_by_severity(spark, d):
    return inc.by_severity(_incidents(spark, d))


@query("gap_incidents", "WITH g AS (" + GAPS.replace("{S}", "{S}") + """) SELECT log_id, 'D18' AS detector, t_start, t_end, 'informativa' AS severity, duration_ms::DOUBLE AS duration_ms FROM g""")
def gap_incidents(spark, d):
    s = attach_splits(samples(spark, d), LOG_FILE)
    out = inc.gap_incidents(quality.gaps(s, 3.0, LOG_FILE))
    return out.select("log_id", "detector", "t_start", "t_end", "severity", F.col("detail")["duration_ms"].alias("duration_ms"))


@query(
    "jump_incidents",
    SHUFFLED + """SELECT log_id, 'clock' AS detector, t_prev AS t_start, t AS t_end, 'media' AS severity, (t_prev - t)::DOUBLE AS back_ms FROM d WHERE t < t_prev""",
)
def jump_incidents(spark, d):
    s = attach_splits(samples(spark, d), LOG_FILE).withColumn("t", F.col("t_ms") - (F.col("seq") % 7) * 3_600_000)
    out = inc.jump_incidents(quality.clock_jumps(s, LOG_FILE, "t"), "clock", "media")
    return out.select("log_id", "detector", "t_start", "t_end", "severity", F.col("detail")["back_ms"].alias("back_ms"))


@query(
    "notice_groups",
    """WITH n AS (SELECT l_suppkey % 20 AS log_id, list_extract(['clock_without_metadata', 'clock_metadata_unreadable', 'factory_epoch', 'clock_without_first_row', 'header_before_midnight', 'download_before_log',
    'duplicate_name', 'invalid_display_range', 'duplicate_id', 'unknown_type', 'unconfirmed_scale', 'row_malformed', 'clock_not_reliable', 'column_empty'], CAST(1 + l_partkey % 14 AS INT)) AS code FROM lineitem)
  SELECT log_id, code, count(*) AS notices, CASE code WHEN 'duplicate_id' THEN 'warning' WHEN 'unknown_type' THEN 'warning' WHEN 'unconfirmed_scale' THEN 'warning' WHEN 'row_malformed' THEN 'warning'
    WHEN 'clock_not_reliable' THEN 'warning' WHEN 'column_empty' THEN 'warning' ELSE 'informational' END AS severity FROM n GROUP BY 1, 2""",
)
def notice_groups(spark, d):
    codes = [
        "clock_without_metadata", "clock_metadata_unreadable", "factory_epoch", "clock_without_first_row", "header_before_midnight",
        "download_before_log", "duplicate_name", "invalid_display_range", "duplicate_id", "unknown_type", "unconfirmed_scale",
        "row_malformed", "clock_not_reliable", "column_empty",
    ]
    code = F.get(F.array(*[F.lit(c) for c in codes]), (F.col("l_partkey") % 14).cast("int"))
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("log_id"), code.alias("code"))
    return inc.notice_groups(rows, ["log_id"])


@query(
    "detector_states",
    """{S}, r AS (SELECT log_id, channel_id AS role, min(v) < 2 AS confirmed FROM s GROUP BY 1, 2 HAVING max(v) > 100),
  dt(detector, sens) AS (VALUES ('D1', TRUE), ('D2', FALSE), ('D3', TRUE)), nd(detector, role) AS (VALUES ('D1', 'click'), ('D1', 'view'), ('D2', 'error'), ('D2', 'click')),
  m AS (SELECT l.log_id, dt.detector, any_value(sens) AS sens, count(*) FILTER (nd.role IS NOT NULL AND r.role IS NULL) AS missing, count(*) FILTER (NOT r.confirmed) AS pending
    FROM (SELECT DISTINCT log_id FROM r) l CROSS JOIN dt LEFT JOIN nd USING (detector) LEFT JOIN r ON r.log_id = l.log_id AND r.role = nd.role GROUP BY 1, 2)
  SELECT log_id, detector, NOT (missing > 0 OR (sens AND pending > 0)) AS active, CASE WHEN missing > 0 THEN 'role_missing' WHEN sens AND pending > 0 THEN 'role_unconfirmed' END AS reason FROM m""",
)
def detector_states(spark, d):
    s = samples(spark, d).groupBy("log_id", F.col("channel_id").alias("role")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    roles = s.filter("hi > 100").select("log_id", "role", (F.col("lo") < 2).alias("confirmed"))
    detectors = spark.createDataFrame(
        [("D1", ["click", "view"], ["alta", "critica"]), ("D2", ["error", "click"], ["media"]), ("D3", [], ["critica"])],
        "detector string, roles array<string>, severities array<string>",
    )
    return inc.detector_states(detectors, roles).select("log_id", "detector", "active", "reason")
