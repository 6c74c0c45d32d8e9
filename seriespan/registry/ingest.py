"""Scans and probes over log text that Spark derives from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..operators.ordered import LOG_TIME, Axis, attach_splits, scan
from ..plans.views import samples, table
from ..sources import csv_probe as cp, csv_read as cr, declared_units as du, native as nat
from . import query

CHANNELS = ["click", "error", "purchase", "signup", "view"]
TYPE_OF = {"click": "EngineSpeed", "error": "Pressure", "purchase": "Percentage", "signup": "Odd", "view": "Temperature"}
HEAD = ["%DataLog%", "DataLogVersion : 1.1", "Software : Sim"] + [
    line
    for i, c in enumerate(CHANNELS)
    for line in (f"Channel : {c}", f"ID : {100 + i}", f"Type : {TYPE_OF[c]}", f"DisplayMaxMin : {1000 * (i + 1)},{-i}")
]


def native_lines(spark, d) -> DataFrame:
    """One native log per user: a header, then a row per event in file order.

    Some users get a wrong version, and every 50th row has too many fields.
    """
    s = scan(attach_splits(samples(spark, d), LOG_TIME), LOG_TIME, total={"n": F.lit(1).cast("bigint")})
    file = F.concat(F.lit("/logs/"), "log_id", F.lit(".csv"))
    stamp = F.date_format(F.timestamp_millis("t_ms"), "HH:mm:ss.SSS")
    raw = F.when(F.col("v") > 200, F.lit(2147483647)).otherwise(F.floor(F.col("v") * 100)).cast("string")
    cells = F.concat_ws(",", *[F.when(F.col("channel_id") == c, raw).otherwise("") for c in CHANNELS])
    extra = F.when(F.col("seq") % 50 == 0, ",9").otherwise("")
    rows = s.select(
        file.alias("file"), F.lit(0).cast("bigint").alias("bytes"), (F.col("n") + len(HEAD) + 1).alias("line"),
        F.concat(stamp, F.lit(","), cells, extra).alias("text"),
    )
    users = samples(spark, d).groupBy("log_id").agg(F.min("t_ms").alias("t0"))
    start = F.concat(F.lit("Log : "), F.date_format(F.timestamp_millis("t0"), "yyyyMMdd HH:mm:ss"))
    version = F.when(F.col("log_id") % 10 == 7, "DataLogVersion : 2.0").otherwise(HEAD[1])
    texts = [F.lit(HEAD[0]), version, *[F.lit(x) for x in HEAD[2:]], start, F.concat(F.lit("Log Number : "), "log_id")]
    head = users.select(file.alias("file"), F.posexplode(F.array(*texts)).alias("line", "text")).select(
        "file", F.lit(0).cast("bigint").alias("bytes"), F.col("line").cast("bigint").alias("line"), "text"
    )
    return head.unionByName(rows)


def _header(spark, d):
    lines = native_lines(spark, d)
    marks = nat.scan_marks(lines)
    return (lines, *nat.read_header(lines, marks=marks), marks)


@query(
    "native_files",
    """SELECT '/logs/' || user_id || '.csv' AS file, CASE WHEN user_id % 10 = 7 THEN 'unsupported_version' ELSE 'ok' END AS status,
    25::BIGINT AS first_row, CASE WHEN user_id % 10 = 7 THEN '2.0' ELSE '1.1' END AS version, 5::BIGINT AS channels FROM (SELECT DISTINCT user_id FROM events)""",
)
def native_files(spark, d):
    return _header(spark, d)[1]


CH_ROWS = ", ".join(
    f"({i}, '{c}', {100 + i}, '{TYPE_OF[c]}', {-i}, {1000 * (i + 1)}, '{dim}', {f!r}::DOUBLE, '{conf}')"
    for i, (c, (dim, f, conf)) in enumerate(
        zip(CHANNELS, [("angular_speed", 1.0, "confirmed"), ("pressure", 0.1, "confirmed"), ("ratio", 0.001, "confirmed"), ("unknown", 1.0, "unknown"), ("temperature", 0.1, "confirmed")])
    )
)


@query(
    "native_channels",
    f"""WITH c(pos, name, native_id, type, disp_min, disp_max, dim, factor, confidence) AS (VALUES {CH_ROWS})
  SELECT '/logs/' || user_id || '.csv' AS file, c.* FROM (SELECT DISTINCT user_id FROM events), c""",
)
def native_channels(spark, d):
    return _header(spark, d)[2].select(
        "file", "pos", "name", "native_id", "type", "disp_min", "disp_max", "dim", "factor", "confidence"
    )


@query("native_notices", "SELECT '/logs/' || user_id || '.csv' AS file, 18::BIGINT - 3 AS line, 'unknown_type' AS code FROM (SELECT DISTINCT user_id FROM events)")
def native_notices(spark, d):
    return nat.header_notices(_header(spark, d)[2])


ROWS = """{S}, o AS (SELECT *, (t_ms % 86400000) AS sod, row_number() OVER w - 1 AS rn FROM s WHERE log_id % 10 <> 7 WINDOW w AS (PARTITION BY log_id ORDER BY t_ms, seq)),
  w AS (SELECT *, sod - lag(sod) OVER (PARTITION BY log_id ORDER BY rn) AS step FROM o),
  u AS (SELECT *, sod + 86400000 * sum(CASE WHEN step < -43200000 THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM w),
  z AS (SELECT *, CAST(t - first_value(t) OVER (PARTITION BY log_id ORDER BY rn) AS BIGINT) AS t_rel FROM u)
"""


@query(
    "native_samples",
    ROWS + """SELECT '/logs/' || log_id || '.csv' AS log_id, CASE channel_id WHEN 'click' THEN '100' WHEN 'error' THEN '101' WHEN 'purchase' THEN '102' WHEN 'signup' THEN '103' ELSE '104' END AS channel_id,
    rn AS seq, t_rel AS t_ms, CASE WHEN v <= 200 THEN CAST(floor(v * 100) AS INT) END AS raw,
    round(CASE WHEN v <= 200 THEN floor(v * 100) * CASE channel_id WHEN 'error' THEN 0.1 WHEN 'view' THEN 0.1 WHEN 'purchase' THEN 0.001 ELSE 1 END END, 6) AS v FROM z""",
)
def native_samples(spark, d):
    lines, files, channels, _, marks = _header(spark, d)
    out = nat.read_samples(nat.read_rows(lines, files), channels, clocks=nat.clocks_of(marks, files))
    return out.select("log_id", "channel_id", "seq", "t_ms", "raw", F.round("v", 6).alias("v"))


@query(
    "native_malformed_rows",
    ROWS + """, b AS (SELECT log_id, rn, row_number() OVER (PARTITION BY log_id ORDER BY rn) AS k FROM z WHERE seq % 50 = 0)
  SELECT '/logs/' || log_id || '.csv' AS file, rn AS row, 7 AS fields, 6::BIGINT AS expected, 1::BIGINT AS rows FROM b WHERE k <= 2
  UNION ALL SELECT '/logs/' || log_id || '.csv', NULL, NULL, 6, count(*) - 2 FROM b GROUP BY log_id HAVING count(*) > 2""",
)
def native_malformed_rows(spark, d):
    lines, files, _, _, _ = _header(spark, d)
    return nat.malformed_rows(nat.read_rows(lines, files), 2)


@query(
    "native_clocks",
    ROWS + """, f AS (SELECT log_id, min(t_ms) AS t0 FROM z GROUP BY log_id)
  SELECT '/logs/' || log_id || '.csv' AS file, 'reliable' AS reliability, t0 AS t0_ms FROM f""",
)
def native_clocks(spark, d):
    _, files, _, metadata, marks = _header(spark, d)
    out = clock.reconcile(nat.log_clocks(metadata, nat.clocks_of(marks, files)))
    return out.select("file", "reliability", F.unix_millis("t0").alias("t0_ms"))


@query(
    "path_notices",
    """WITH q AS (SELECT o_orderkey AS k, '/logs/' || o_orderkey AS path FROM orders)
  SELECT path, CASE WHEN k % 7 = 1 THEN 'missing' WHEN k % 7 = 2 THEN 'empty' ELSE 'unreadable' END AS notice
  FROM q WHERE k NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <> 1) AND k % 7 <> 0
    OR k % 7 IN (1, 2)""",
)
def path_notices(spark, d):
    """Some requested paths are not listed, some are empty, some give no line."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("/logs/"), "o_orderkey").alias("path"))
    k = F.col("o_orderkey") % 7
    listing = o.filter(k != 1).select("path", F.when(k == 2, 0).otherwise(F.lit(10)).alias("size"))
    li = table(spark, d, "lineitem")
    some = li.filter((F.col("l_linenumber") != 1) & ~(F.col("l_orderkey") % 7).isin(1, 2)).select("l_orderkey")
    whole = o.filter(k == 0).select(F.col("o_orderkey").alias("l_orderkey"))
    lines = some.unionByName(whole).select(F.concat(F.lit("/logs/"), "l_orderkey").alias("file"))
    return nat.path_notices(o, listing, lines)


@query("format_detection", "SELECT '/logs/' || user_id || '.csv' AS file, 'nsp' AS format FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT '/doc/' || doc_id, 'generic' FROM documents")
def format_detection(spark, d):
    docs = table(spark, d, "documents").select(
        F.concat(F.lit("/doc/"), "doc_id").alias("file"), F.lit(0).cast("bigint").alias("line"), "text"
    )
    lines = native_lines(spark, d).select("file", "line", "text").unionByName(docs)
    return nat.detect_format(lines, [nat.NativeFormat()])


def csv_lines(spark, d) -> DataFrame:
    """One CSV per supplier in five dialects, numbered by order key and line."""
    axis = Axis(("l_suppkey",), "l_orderkey", ("l_linenumber", "l_partkey", "l_extendedprice"))
    li = scan(attach_splits(table(spark, d, "lineitem"), axis), axis, total={"n": F.lit(1).cast("bigint")})
    k = F.col("l_suppkey") % 5
    sep = F.when(k == 0, ",").when(k == 1, ";").when(k == 2, "\t").when(k == 3, "|").otherwise(";")
    mark = lambda x: F.when(k == 1, F.replace(x, F.lit("."), F.lit(","))).otherwise(x)
    cells = [
        mark(F.format_string("%.2f", (F.col("n") - 1) * 0.05)), F.format_string("%.0f", "l_quantity"),
        mark(F.format_string("%.2f", "l_extendedprice")), mark(F.format_string("%.2f", "l_discount")),
    ]
    body = li.select(
        "l_suppkey", (F.col("n") + 3).alias("line"), F.replace(F.concat_ws("~", *cells), F.lit("~"), sep).alias("text")
    )
    names, units = "Time [s]~RPM~MAP_kPa~Duty", "s~rpm~~%"
    heads = [
        F.when(k == 3, F.lit("vehicle: car")),
        F.replace(F.lit(names), F.lit("~"), sep),
        F.when(k == 4, F.replace(F.lit(units), F.lit("~"), sep)),
    ]
    head = li.select("l_suppkey").distinct().select(
        "l_suppkey", F.posexplode(F.array_compact(F.array(*heads))).alias("line", "text")
    )
    both = head.withColumn("line", F.col("line").cast("bigint")).unionByName(body)
    return both.select(F.concat(F.lit("/csv/"), "l_suppkey").alias("file"), "line", "text")


def _probe(spark, d) -> cp.Probe:
    """The probe of ``csv_lines``; a file has a supplier's items and up to two lines before them."""
    items = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.count(F.lit(1)) + 2).alias("lines"))
    return cp.Probe(csv_lines(spark, d), counted=items.select(F.concat(F.lit("/csv/"), "l_suppkey").alias("file"), "lines"))


SUP = """WITH f AS (SELECT l_suppkey AS k, '/csv/' || l_suppkey AS file, l_suppkey % 5 AS m, count(*) AS n FROM lineitem GROUP BY l_suppkey)
"""


@query(
    "csv_dialect",
    SUP + """SELECT file, n + CASE WHEN m >= 3 THEN 2 ELSE 1 END AS lines, list_extract([',', ';', chr(9), '|', ';'], m + 1) AS delimiter, CAST(NULL AS VARCHAR) AS quote,
    4 AS fields, CASE WHEN m = 3 THEN 1 ELSE 0 END::BIGINT AS start, n + CASE WHEN m = 4 THEN 2 ELSE 1 END AS run, CASE WHEN m = 3 THEN 'inconsistent_fields' END AS notice FROM f""",
)
def csv_dialect(spark, d):
    return cp.dialects(cp.sample_lines(csv_lines(spark, d)))


@query(
    "csv_delimiter_score",
    SUP + """, t(d, delimiter) AS (VALUES (0, ','), (1, ';'), (2, chr(9)), (3, '|'), (4, ' ')),
  x AS (SELECT file, m, n, t.*, list_extract([',', ';', chr(9), '|', ';'], m + 1) AS own FROM f, t)
  SELECT file, delimiter, CASE WHEN delimiter = own THEN n + CASE WHEN m = 4 THEN 2 ELSE 1 END
      WHEN delimiter = ',' AND m = 1 THEN n WHEN delimiter = ' ' AND m = 4 THEN n + 1 WHEN delimiter = ' ' THEN n
      ELSE n + CASE WHEN m >= 3 THEN 2 ELSE 1 END END AS run,
    CASE WHEN delimiter = own THEN 4 WHEN delimiter = ',' AND m = 1 THEN 4 ELSE 1 END AS fields FROM x""",
)
def csv_delimiter_score(spark, d):
    scores = cp.delimiter_scores(cp.sample_lines(csv_lines(spark, d)))
    return scores.select("file", "delimiter", "run", "fields")


@query(
    "csv_structure",
    SUP + """SELECT file, CASE WHEN m >= 3 THEN 2 ELSE 1 END::BIGINT AS data_start, 4 AS columns, CASE WHEN m = 4 THEN 1 END::BIGINT AS units_line,
    CASE WHEN m = 3 THEN 1 ELSE 0 END::BIGINT AS names_line, CASE WHEN m = 3 THEN 1 ELSE 0 END::BIGINT AS preamble_end FROM f""",
)
def csv_structure(spark, d):
    return _probe(spark, d).structure


@query("csv_preamble", SUP + "SELECT file, 'vehicle' AS key, 'car' AS value, FALSE AS repeated FROM f WHERE m = 3")
def csv_preamble(spark, d):
    return _probe(spark, d).metadata


@query(
    "csv_declared_units",
    SUP + """, c(pos, clean_name, dim, unit_id) AS (VALUES (0, 'Time', 'time', 's'), (1, 'RPM', NULL, NULL), (2, 'MAP', 'pressure', 'kPa'), (3, 'Duty', NULL, NULL))
  SELECT file, pos, clean_name, CASE WHEN m = 4 AND pos = 1 THEN 'angular_speed' WHEN m = 4 AND pos = 3 THEN 'ratio' ELSE dim END AS dim,
    CASE WHEN m = 4 AND pos = 1 THEN 'rpm' WHEN m = 4 AND pos = 3 THEN 'pct' ELSE unit_id END AS unit_id FROM f, c""",
)
def csv_declared_units(spark, d):
    return du.resolve(_probe(spark, d).headers).select("file", "pos", "clean_name", "dim", "unit_id")


@query(
    "csv_time_axis",
    SUP + """SELECT file, 'relative' AS class, 0 AS col, 1.0::DOUBLE AS factor, CASE WHEN n > 1 THEN 20.0 END::DOUBLE AS hz, 'unknown' AS reliability FROM f""",
)
def csv_time_axis(spark, d):
    out = _probe(spark, d).time
    return out.select("file", "class", "col", "factor", F.round("hz", 3).alias("hz"), "reliability")


TIMES = """WITH r AS (SELECT l_suppkey % 7 AS m, '/times/' || l_suppkey AS file, count(*) AS n FROM lineitem GROUP BY l_suppkey)
"""


@query(
    "csv_time_classes",
    TIMES + """SELECT file, CASE WHEN m = 5 AND n < 3 THEN 'relative' ELSE list_extract(['iso8601', 'clock', 'date_and_clock', 'epoch_s', 'epoch_ms', 'counter', 'absent'], CAST(m + 1 AS INT)) END AS class,
    CASE WHEN m = 4 THEN 0.001 ELSE 1.0 END::DOUBLE AS factor,
    CASE m WHEN 0 THEN 1700000001 WHEN 2 THEN 1785283201 WHEN 3 THEN 1700000001 WHEN 4 THEN 1700000000.05 END::DOUBLE AS t0_s,
    CASE WHEN m IN (0, 2, 3, 4) THEN 'reliable' ELSE 'unknown' END AS reliability,
    CASE WHEN n > 1 AND m < 5 THEN CASE WHEN m = 4 THEN 20 ELSE 1 END END::DOUBLE AS hz,
    CASE m WHEN 1 THEN 'clock_without_date' WHEN 5 THEN 'counter_without_frequency' WHEN 6 THEN 'no_time_column' END AS notice FROM r""",
)
def csv_time_classes(spark, d):
    """One kind of time column per file: instants, clocks with and without a date, epochs, a counter, none."""
    axis = Axis(("l_suppkey",), "l_orderkey", ("l_linenumber", "l_partkey", "l_extendedprice"))
    li = scan(attach_splits(table(spark, d, "lineitem"), axis), axis, total={"n": F.lit(1).cast("bigint")})
    k, n = F.col("l_suppkey") % 7, F.col("n")
    clock = F.date_format(F.timestamp_seconds(n), "HH:mm:ss")
    odd = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("."), (n * 37 % 10).cast("string"))
    time = (
        F.when(k == 0, F.date_format(F.timestamp_seconds(n + 1700000000), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 1, clock).when(k == 2, F.concat(F.lit("2026-07-29;"), clock)).when(k == 3, (n + 1700000000).cast("string"))
        .when(k == 4, (n * 50 + 1700000000000).cast("string")).when(k == 5, n.cast("string"))
        .otherwise(F.concat(((n * 7919) % 1000).cast("string"), F.lit(".5")))
    )
    body = li.select("l_suppkey", n.alias("line"), F.concat_ws(";", time, odd, odd).alias("text"))
    head = li.select("l_suppkey").distinct().select(
        "l_suppkey", F.lit(0).cast("bigint").alias("line"), F.when(k == 2, "D;T;A;B").otherwise("T;A;B").alias("text")
    )
    found = cp.Probe(head.unionByName(body).select(F.concat(F.lit("/times/"), "l_suppkey").alias("file"), "line", "text"))
    return found.time.select("file", "class", "factor", F.round("t0_s", 3).alias("t0_s"), "reliability", F.round("hz", 3).alias("hz"), "notice")


@query(
    "csv_column_types",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem),
  c AS (SELECT '/csv/' || l_suppkey AS file, u.col, u.cell FROM n, LATERAL (VALUES (0, printf('%.2f', (rn - 1) * 0.05::DOUBLE)), (1, printf('%.0f', l_quantity)), (2, printf('%.2f', l_extendedprice)), (3, printf('%.2f', l_discount))) u(col, cell))
  SELECT file, col, count(*) AS cells, count(DISTINCT cell) AS "distinct", CASE WHEN count(DISTINCT cell) = 1 THEN 'constant' WHEN col = 1 THEN 'integer' ELSE 'decimal' END AS type FROM c GROUP BY 1, 2""",
)
def csv_column_types(spark, d):
    return _probe(spark, d).types.select("file", "col", "cells", "distinct", "type")


@query(
    "csv_series",
    """WITH r AS (SELECT l_suppkey, l_quantity, l_extendedprice, l_discount, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS seq FROM lineitem)
  SELECT '/csv/' || l_suppkey AS log_id, u.channel_id, seq, seq * 50 AS t_ms, round(u.v, 2) AS v FROM r, LATERAL (VALUES ('1', l_quantity), ('2', l_extendedprice), ('3', l_discount)) u(channel_id, v)""",
)
def csv_series(spark, d):
    found = _probe(spark, d)
    block = cr.read_block(cr.data_lines(found.rows, found.sample, found.structure), found.dialects)
    out = cr.read_series(block, found.time, found.decimals)
    return out.select("log_id", "channel_id", "seq", "t_ms", F.round("v", 2).alias("v"))


LATE = """WITH f AS (SELECT l_suppkey AS k, '/late/' || l_suppkey AS file, count(*) AS n FROM lineitem GROUP BY l_suppkey)
"""


def _late_lines(spark, d) -> DataFrame:
    """Files whose first 300 rows look like whole numbers on a counter; later rows tell otherwise."""
    axis = Axis(("l_suppkey",), "l_orderkey", ("l_linenumber", "l_partkey", "l_extendedprice"))
    li = scan(attach_splits(table(spark, d, "lineitem"), axis), axis, total={"n": F.lit(1).cast("bigint")})
    late = F.col("n") > 300
    whole = F.col("l_quantity").cast("int").cast("string")
    text = F.concat(
        F.col("n").cast("string"), F.when(late, ",5").otherwise(""), F.lit(";"), whole, F.when(late, ",5").otherwise(""), F.lit(";7;"), whole, F.lit(";"),
        F.when(late & (F.col("n") % 2 == 0), "on").when(late, "off").otherwise("on"),
    )
    body = li.select("l_suppkey", F.col("n").alias("line"), text.alias("text"))
    head = li.select("l_suppkey").distinct().select("l_suppkey", F.lit(0).cast("bigint").alias("line"), F.lit("T;A;B;C;State").alias("text"))
    return head.unionByName(body).select(F.concat(F.lit("/late/"), "l_suppkey").alias("file"), "line", "text")


@query(
    "csv_late_evidence",
    LATE + """SELECT file, CASE WHEN n > 300 THEN ',' ELSE '.' END AS decimal, CASE WHEN n > 300 THEN 'relative' ELSE 'counter' END AS class,
    CASE WHEN n > 300 THEN 'decimal' ELSE 'integer' END AS type_a, CASE WHEN n > 301 THEN 'boolean' ELSE 'constant' END AS type_state FROM f""",
)
def csv_late_evidence(spark, d):
    found = cp.Probe(_late_lines(spark, d))
    kind = lambda col: F.max(F.when(F.col("col") == col, F.col("type")))
    types = found.types.groupBy("file").agg(kind(1).alias("type_a"), kind(4).alias("type_state"))
    out = found.decimals.select("file", "decimal").join(found.time.select("file", "class"), "file")
    return out.join(types, "file").select("file", "decimal", "class", "type_a", "type_state")


@query(
    "csv_enum_series",
    """WITH r AS (SELECT l_suppkey, l_quantity, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS seq FROM lineitem),
  l AS (SELECT l_suppkey, l_returnflag, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag) - 1 AS code FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem))
  SELECT '/enum/' || l_suppkey AS log_id, u.channel_id, seq, seq * 500 AS t_ms, u.v::DOUBLE AS v FROM r JOIN l USING (l_suppkey, l_returnflag),
    LATERAL (VALUES ('1', l_quantity), ('2', l_quantity), ('3', l_quantity), ('4', l_quantity), ('5', l.code), ('6', CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)) u(channel_id, v)""",
)
def csv_enum_series(spark, d):
    axis = Axis(("l_suppkey",), "l_orderkey", ("l_linenumber", "l_partkey", "l_extendedprice"))
    li = scan(attach_splits(table(spark, d, "lineitem"), axis), axis, total={"n": F.lit(1).cast("bigint")})
    cells = [
        F.format_string("%.1f", (F.col("n") - 1) * 0.5), *[F.format_string("%.0f", "l_quantity")] * 4, F.concat(F.lit("flag "), "l_returnflag"),
        F.when(F.col("l_linestatus") == "F", "on").otherwise("off"),
    ]
    body = li.select("l_suppkey", F.col("n").alias("line"), F.concat_ws(";", *cells).alias("text"))
    head = li.select("l_suppkey").distinct().select("l_suppkey", F.lit(0).cast("bigint").alias("line"), F.lit("T;A;B;C;D;Flag;On").alias("text"))
    found = cp.Probe(head.unionByName(body).select(F.concat(F.lit("/enum/"), "l_suppkey").alias("file"), "line", "text"))
    block = cr.read_block(cr.data_lines(found.rows, found.sample, found.structure), found.dialects)
    return cr.read_channels(block, found.time, found.decimals, found.types)[0]


@query(
    "csv_file_status",
    """SELECT '/status/' || l_suppkey AS file, CASE WHEN l_suppkey % 5 = 0 THEN 'ok' ELSE 'error' END AS status,
    list_extract([NULL, 'delimiter_undetermined', 'no_data_row', 'no_time_column', 'counter_without_frequency'], CAST(1 + l_suppkey % 5 AS INT)) AS reason,
    CASE WHEN l_suppkey % 5 = 0 THEN count(*) FILTER (n % 100 = 0) ELSE 0 END AS unreadable_cells
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem) GROUP BY l_suppkey""",
)
def csv_file_status(spark, d):
    axis = Axis(("l_suppkey",), "l_orderkey", ("l_linenumber", "l_partkey", "l_extendedprice"))
    li = scan(attach_splits(table(spark, d, "lineitem"), axis), axis, total={"n": F.lit(1).cast("bigint")})
    n, k, q = F.col("n"), F.col("l_suppkey") % 5, F.format_string("%.0f", "l_quantity")
    text = (
        F.when(k == 0, F.concat_ws(";", F.format_string("%.1f", n * 0.5), F.when(n % 100 == 0, "odd cell").otherwise(q)))
        .when(k == 1, F.concat(F.lit("word"), n.cast("string")))
        .when(k == 2, F.concat_ws(";", F.lit("a"), "l_returnflag", "l_linestatus"))
        .when(k == 3, F.concat_ws(";", q, F.format_string("%.2f", F.col("l_extendedprice") - n * (n % 2 * 2 - 1))))
        .otherwise(F.concat_ws(";", n.cast("string"), q))
    )
    lines = li.select(F.concat(F.lit("/status/"), "l_suppkey").alias("file"), (n - 1).alias("line"), text.alias("text"))
    return cp.Probe(lines).status


@query(
    "csv_ragged_rows",
    """SELECT o_custkey % 50 AS file, count(*) AS rows, count(*) FILTER (o_orderkey % 3 = 0) AS short, count(*) FILTER (o_orderkey % 3 = 1) AS long FROM orders GROUP BY 1""",
)
def csv_ragged_rows(spark, d):
    k = F.col("o_orderkey") % 3
    cells = [F.col("o_orderstatus"), F.lit('"a,b"'), F.col("o_totalprice").cast("string")]
    text = F.when(k == 0, F.concat_ws(",", *cells[:2])).when(k == 1, F.concat_ws(",", *cells, F.lit("x"))).otherwise(F.concat_ws(",", *cells))
    rows = table(spark, d, "orders").select(
        (F.col("o_custkey") % 50).alias("file"), F.col("o_orderkey").alias("seq"), F.lit(3).alias("columns"), text.alias("text")
    )
    dialect = rows.select("file").distinct().select("file", F.lit(",").alias("delimiter"), F.lit('"').alias("quote"))
    return cr.ragged_rows(cr.read_block(rows, dialect))


@query(
    "synthetic_axis",
    "SELECT event_id, CASE WHEN event_type <> 'view' THEN round(event_id / CASE event_type WHEN 'click' THEN 20.0 ELSE 50.0 END, 6) END AS t_s FROM events",
)
def synthetic_axis(spark, d):
    hz = F.when(F.col("event_type") == "click", 20.0).when(F.col("event_type") != "view", 50.0)
    e = table(spark, d, "events")
    return e.select("event_id", F.round(cp.synthetic_axis(F.col("event_id").cast("double"), hz), 6).alias("t_s"))


@query(
    "export_wide",
    """SELECT user_id AS log_id, event_id AS seq, round(CASE WHEN event_type = 'click' THEN value * 1.8 - 459.67 END, 6) AS clt, round(CASE WHEN event_type = 'view' THEN (value - 101.325) * 0.01 END, 6) AS boost,
    CASE WHEN event_type = 'error' THEN value END AS odd FROM events""",
)
def export_wide(spark, d):
    from ..sources.store import wide

    out = wide(
        samples(spark, d),
        {
            "click": {"name": "clt", "dimension": "temperature", "unit": "degF"},
            "view": {"name": "boost", "dimension": "pressure", "unit": "bar", "reference_kpa": 101.325},
            "error": {"name": "odd", "dimension": "unknown", "unit": "raw", "reason": "unknown_dimension"},
        },
        ("log_id", "seq"),
    )
    return out.withColumns({c: F.round(c, 6) for c in ("clt", "boost")})


@query("store_round_trip", "{S} SELECT log_id, channel_id, seq, t_ms, v FROM s")
def store_round_trip(spark, d):
    from ..session import shared_folder
    from ..sources import store

    path = f"{shared_folder(spark)}/store/{uuid.uuid4().hex}"
    store.write_samples(samples(spark, d), path)
    return store.read_samples(spark, path).select("log_id", "channel_id", "seq", "t_ms", "v")
