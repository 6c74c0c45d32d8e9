"""Cell parsing, type inference and clock queries on text derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells, clock, names
from ..plans.views import table
from . import query

# One text cell per lineitem row and column, in the shapes log exports use, each with the name of its shape.
CELLS = """WITH base AS (SELECT l_suppkey % 13 AS file, row_number() OVER () AS rid, l_quantity, l_extendedprice, l_discount, l_linenumber, l_orderkey, l_partkey FROM lineitem),
  c0 AS (SELECT file, 'price' AS col, CASE l_linenumber WHEN 1 THEN replace(printf('%.2f', l_extendedprice), '.', ',') || ' bar'
        WHEN 2 THEN ' ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) WHEN 3 THEN '#N/A' WHEN 4 THEN '' WHEN 5 THEN '2147483647' WHEN 6 THEN 'x' || l_partkey
        ELSE '1.' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || ',5' END AS cell,
        ['with_unit', 'whole', 'dash', 'blank', 'overflow', 'word', 'mixed'][CAST(least(l_linenumber, 7) AS INT)] AS form,
        CASE l_linenumber WHEN 1 THEN round(l_extendedprice, 2) WHEN 2 THEN CAST(l_quantity AS INT) ELSE 1000.5 + l_partkey % 1000 END::DOUBLE AS amount FROM base
    UNION ALL SELECT file, 'qty', CASE WHEN file % 2 = 0 THEN replace(printf('%.1f', l_quantity), '.', ',') ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END,
        CASE WHEN file % 2 = 0 THEN 'comma' ELSE 'whole' END, l_quantity::DOUBLE FROM base
    UNION ALL SELECT file, 'disc', '0,0' || CAST(h AS VARCHAR), 'comma', CASE WHEN h < 10 THEN h / 100.0 ELSE h / 1000.0 END::DOUBLE
        FROM (SELECT file, CAST(floor(l_discount * 100 + 0.5) AS INT) AS h FROM base)
    UNION ALL SELECT file, 'flag', CASE WHEN l_linenumber > 5 THEN 'ON' WHEN l_linenumber > 3 THEN 'On' ELSE 'off' END, 'word', 0 FROM base
    UNION ALL SELECT file, 'same', 'k', 'word', 0 FROM base
    UNION ALL SELECT file, 'none', CASE WHEN l_linenumber > 2 THEN '' ELSE '---' END, CASE WHEN l_linenumber > 2 THEN 'blank' ELSE 'dash' END, 0 FROM base
    UNION ALL SELECT file, 'text', 't' || CAST(l_partkey % 70 AS VARCHAR), 'word', 0 FROM base),
  forms(form, kind, as_comma, as_dot, shape, has_number, grouped, fraction) AS (VALUES
    ('with_unit', 'data', FALSE, FALSE, 'text', TRUE, FALSE, FALSE), ('whole', 'data', TRUE, TRUE, 'integer', TRUE, FALSE, FALSE),
    ('comma', 'data', TRUE, FALSE, 'decimal', TRUE, FALSE, TRUE), ('mixed', 'data', TRUE, FALSE, 'both', TRUE, TRUE, TRUE),
    ('word', 'data', FALSE, FALSE, 'text', FALSE, FALSE, FALSE), ('dash', 'sentinel', FALSE, FALSE, 'text', FALSE, FALSE, FALSE),
    ('blank', 'empty', TRUE, TRUE, 'empty', FALSE, FALSE, FALSE), ('overflow', 'overflow', TRUE, TRUE, 'integer', TRUE, FALSE, FALSE)),
  c AS (SELECT file, col, cell, forms.*, CASE WHEN has_number THEN replace(trim(cell), ' bar', '') END AS number, CASE WHEN form = 'with_unit' THEN 'bar' END AS unit,
    CASE WHEN has_number AND kind = 'data' THEN amount END AS value FROM c0 JOIN forms USING (form))
"""


def _cells(spark, d):
    li = table(spark, d, "lineitem")
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    whole = F.col("l_quantity").cast("int").cast("string")
    price = (
        F.when(n == 1, F.concat(F.replace(F.format_string("%.2f", "l_extendedprice"), F.lit("."), F.lit(",")), F.lit(" bar")))
        .when(n == 2, F.concat(F.lit(" "), whole))
        .when(n == 3, "#N/A").when(n == 4, "").when(n == 5, "2147483647")
        .when(n == 6, F.concat(F.lit("x"), part))
        .otherwise(F.concat(F.lit("1."), F.lpad((part % 1000).cast("string"), 3, "0"), F.lit(",5")))
    )
    file = (F.col("l_suppkey") % 13).alias("file")
    qty = F.when(F.col("l_suppkey") % 13 % 2 == 0, F.replace(F.format_string("%.1f", "l_quantity"), F.lit("."), F.lit(","))).otherwise(whole)
    disc = F.concat(F.lit("0,0"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int"))
    pairs = {
        "price": price, "qty": qty, "disc": disc, "flag": F.when(n > 5, "ON").when(n > 3, "On").otherwise("off"), "same": F.lit("k"),
        "none": F.when(n > 2, "").otherwise("---"), "text": F.concat(F.lit("t"), part % 70),
    }
    structs = F.array(*[F.struct(F.lit(k).alias("col"), v.alias("cell")) for k, v in pairs.items()])
    return li.select(file, F.explode(structs).alias("_c")).select("file", "_c.col", "_c.cell")


@query("cell_parse", CELLS + "SELECT col, cell, kind, number, unit, value FROM c")
def cell_parse(spark, d):
    c = F.col("cell")
    return _cells(spark, d).select(
        "col", "cell", cells.cell_kind(c).alias("kind"), cells.number_text(c, ",").alias("number"),
        cells.unit_text(c, ",").alias("unit"), cells.cell_value(c, ",").alias("value"),
    )


@query("number_shape", CELLS + "SELECT col, cell, as_comma AS numeric_comma, as_dot AS numeric_dot, shape FROM c")
def number_shape(spark, d):
    c = F.col("cell")
    return _cells(spark, d).select(
        "col", "cell", cells.is_numeric(c, ",").alias("numeric_comma"), cells.is_numeric(c, ".").alias("numeric_dot"),
        cells.number_shape(c).alias("shape"),
    )


@query(
    "cell_conversion_report",
    CELLS + """, g AS (SELECT file, col, count(*) AS cells, count(*) FILTER (kind = 'empty') AS empty, count(*) FILTER (kind = 'sentinel') AS sentinels, count(*) FILTER (kind = 'overflow') AS overflows,
    count(*) FILTER (kind = 'data' AND has_number) AS numeric, count(*) FILTER (kind = 'data' AND NOT has_number) AS non_numeric,
    count(*) FILTER (kind = 'data' AND grouped) AS grouped, count(*) FILTER (kind = 'data' AND unit IS NOT NULL) AS with_unit,
    count(DISTINCT unit) FILTER (kind = 'data') AS units, min(unit) FILTER (kind = 'data') AS u0 FROM c GROUP BY 1, 2)
  SELECT file, col, cells, empty, sentinels, overflows, numeric, non_numeric, grouped, with_unit, CASE WHEN units = 0 THEN 'none' WHEN units = 1 THEN 'consistent' ELSE 'mixed' END AS unit_status,
    CASE WHEN units = 1 THEN u0 END AS unit FROM g""",
)
def cell_conversion_report(spark, d):
    return cells.convert_columns(_cells(spark, d), ["file", "col"], ",")


@query(
    "decimal_vote",
    CELLS + """, g AS (SELECT file, count(*) AS cells, count(*) FILTER (as_dot AND NOT as_comma) AS only_dot, count(*) FILTER (as_comma AND NOT as_dot) AS only_comma,
    count(*) FILTER (shape = 'three_digits') AS three_digits FROM c GROUP BY file)
  SELECT file, cells, only_dot, only_comma, three_digits, CASE WHEN only_comma > only_dot THEN ',' ELSE '.' END AS "decimal",
    CASE WHEN only_dot > 0 OR only_comma > 0 THEN 'cross_check' ELSE 'no_evidence' END AS reason, only_dot > 0 AND only_comma > 0 AS ambiguous FROM g""",
)
def decimal_vote(spark, d):
    return cells.vote_decimal(_cells(spark, d), ["file"])


TYPES = CELLS + """, p AS (SELECT *, trim(cell) AS t FROM c),
  g AS (SELECT file, col, count(*) AS cells, count(*) FILTER (kind = 'empty') AS empty, count(*) FILTER (kind = 'sentinel') AS sentinels, count(*) FILTER (kind = 'overflow') AS overflows,
    count(*) FILTER (kind = 'data' AND as_comma) AS numeric, count(*) FILTER (kind = 'data' AND NOT as_comma) AS non_numeric,
    count(DISTINCT t) FILTER (kind = 'data') AS "distinct", count(DISTINCT lower(t)) FILTER (kind = 'data') AS words, coalesce(bool_or(kind = 'data' AND as_comma AND fraction), FALSE) AS frac,
    min(lower(t)) FILTER (kind = 'data') AS a, max(lower(t)) FILTER (kind = 'data') AS b, min(t) FILTER (kind = 'data') AS o FROM p GROUP BY 1, 2),
  y AS (SELECT *, CASE WHEN numeric + non_numeric = 0 THEN 'empty' WHEN "distinct" = 1 THEN 'constant'
    WHEN words = 2 AND (a, b) IN (('false', 'true'), ('off', 'on'), ('no', 'sí'), ('no', 'si'), ('falso', 'verdadero'), ('no', 'yes')) THEN 'boolean'
    WHEN numeric::DOUBLE / (numeric + non_numeric) >= 0.95 THEN CASE WHEN frac THEN 'decimal' ELSE 'integer' END ELSE 'text_enum' END AS type FROM g)
"""


@query(
    "type_inference",
    TYPES + """SELECT file, col, cells, empty, sentinels, overflows, numeric, non_numeric, "distinct", type,
    CASE WHEN "distinct" = 1 THEN o END AS constant_value, "distinct" > 64 AS free_text FROM y""",
)
def type_inference(spark, d):
    return cells.infer_types(_cells(spark, d), ["file", "col"], ",", free_text_over=64)


@query(
    "type_notices",
    TYPES + """SELECT file, col, code FROM (SELECT file, col, unnest([CASE WHEN type = 'empty' THEN 'column_empty' END, CASE WHEN type = 'constant' THEN 'column_constant' END,
    CASE WHEN type IN ('integer', 'decimal') AND non_numeric > 0 THEN 'column_mixed' END, CASE WHEN type = 'text_enum' AND "distinct" > 64 THEN 'column_free_text' END]) AS code FROM y) WHERE code IS NOT NULL""",
)
def type_notices(spark, d):
    return cells.type_notices(cells.infer_types(_cells(spark, d), ["file", "col"], ",", free_text_over=64), ["file", "col"])


ENUM = CELLS + """, lb AS (SELECT DISTINCT file, col, trim(cell) AS label FROM c WHERE kind NOT IN ('empty', 'sentinel')),
  sz AS (SELECT file, col, count(*) AS n, min(lower(label)) AS a, max(lower(label)) AS b FROM lb GROUP BY 1, 2),
  en AS (SELECT file, col, label, CAST(CASE WHEN n = 2 AND (a, b) IN (('false', 'true'), ('off', 'on'), ('no', 'sí'), ('no', 'si'), ('falso', 'verdadero'), ('no', 'yes'))
     THEN CASE WHEN lower(label) IN ('true', 'on', 'sí', 'si', 'verdadero', 'yes') THEN 1 ELSE 0 END ELSE dense_rank() OVER (PARTITION BY file, col ORDER BY label) - 1 END AS INT) AS code FROM lb JOIN sz USING (file, col))
"""


@query("enum_codes", ENUM + "SELECT file, col, label, code FROM en")
def enum_codes(spark, d):
    return cells.enum_dictionary(_cells(spark, d), ["file", "col"])


@query(
    "enum_encode_decode",
    ENUM + "SELECT c.file, c.col, en.code, coalesce(en.label, CAST(en.code AS VARCHAR)) AS state, count(*) AS n FROM c LEFT JOIN en ON en.file = c.file AND en.col = c.col AND en.label = trim(cell) GROUP BY 1, 2, 3, 4",
)
def enum_encode_decode(spark, d):
    rows = _cells(spark, d)
    dictionary = cells.enum_dictionary(rows, ["file", "col"])
    coded = cells.to_codes(rows, dictionary, ["file", "col"]).drop("cell")
    decoded = cells.decode(coded, dictionary, ["file", "col"])
    return decoded.groupBy("file", "col", "code", "state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "unit_in_name",
    r"""WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' [rpm]' WHEN 1 THEN p_name || ' (' || p_type || ')' WHEN 2 THEN p_name || ' [ ]' ELSE p_name END AS name FROM part)
  SELECT p_partkey, CASE WHEN regexp_matches(name, '\[rpm\]$') OR regexp_matches(name, '\)$') THEN regexp_extract(name, '^(.*\S)\s*[\[(]', 1) ELSE name END AS plain,
    CASE WHEN p_partkey % 4 = 0 THEN 'rpm' WHEN p_partkey % 4 = 1 THEN regexp_extract(name, '\(([^()]*)\)$', 1) END AS unit,
    CASE WHEN p_partkey % 4 = 0 THEN 'bracket' WHEN p_partkey % 4 = 1 THEN 'parenthesis' ELSE 'none' END AS origin FROM n""",
)
def unit_in_name(spark, d):
    k = F.col("p_partkey") % 4
    name = (
        F.when(k == 0, F.concat("p_name", F.lit(" [rpm]")))
        .when(k == 1, F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")))
        .when(k == 2, F.concat("p_name", F.lit(" [ ]")))
        .otherwise(F.col("p_name"))
    )
    plain, unit, origin = cells.name_and_unit(F.col("name"))
    return table(spark, d, "part").select("p_partkey", name.alias("name")).select(
        "p_partkey", plain.alias("plain"), unit.alias("unit"), origin.alias("origin")
    )


@query(
    "name_normalise",
    r"""SELECT p_partkey, strip_accents(lower(regexp_replace(translate(p_name, 'eoi', CASE WHEN p_partkey % 2 = 0 THEN 'éÖî' ELSE 'eoi' END) || ' - ' || p_brand || '_' || p_type, '[\s_\-./()\[\]{}:,;+]+', '', 'g'))) AS key FROM part""",
)
def name_normalise(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.translate("p_name", "eoi", "éÖî")).otherwise(F.col("p_name"))
    full = F.concat(name, F.lit(" - "), "p_brand", F.lit("_"), "p_type")
    rows = table(spark, d, "part").select("p_partkey", full.alias("full"))
    return names.with_normalised(rows, "full", "key").select("p_partkey", "key")


HEADS = """WITH h AS (SELECT p_partkey // 20 AS file, CAST(p_partkey % 20 AS INT) AS pos, CASE WHEN p_partkey % 7 = 3 THEN ' ' ELSE split_part(p_name, ' ', 2) END AS name FROM part),
  b AS (SELECT *, CASE WHEN trim(name) = '' THEN 'col_' || (pos + 1) ELSE name END AS base FROM h)
"""


def _heads(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 7 == 3, " ").otherwise(F.split_part("p_name", F.lit(" "), F.lit(2)))
    return table(spark, d, "part").select(F.floor(k / 20).alias("file"), (k % 20).cast("int").alias("pos"), name.alias("name"))


@query(
    "presentation_names",
    HEADS + """SELECT file, pos, base, base || CASE WHEN rn > 1 THEN '_' || rn ELSE '' END AS display FROM (SELECT *, row_number() OVER (PARTITION BY file, base ORDER BY pos) AS rn FROM b)""",
)
def presentation_names(spark, d):
    return cells.presentation_names(_heads(spark, d), ["file"])


@query(
    "header_fingerprint",
    HEADS + """SELECT file, sha256(string_agg(lower(replace(name, ' ', '')), chr(31) ORDER BY pos) || chr(31) || ',' || chr(31) || 'utf-8') AS fingerprint FROM h GROUP BY file""",
)
def header_fingerprint(spark, d):
    return cells.header_fingerprint(_heads(spark, d), ["file"], F.lit(","), F.lit("utf-8"))


@query(
    "row_clock",
    r"""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 4 THEN strftime(ts, '%H:%M:61.5') WHEN 3 THEN strftime(ts, '%H:%M:%S') ELSE strftime(ts, '%H:%M:%S.%g') END AS mark FROM events)
  SELECT event_id, mark, CASE WHEN event_id % 5 <> 4 THEN round(split_part(mark, ':', 1)::DOUBLE * 3600 + split_part(mark, ':', 2)::DOUBLE * 60 + split_part(mark, ':', 3)::DOUBLE, 3) END AS seconds FROM t""",
)
def row_clock(spark, d):
    k = F.col("event_id") % 5
    mark = (
        F.when(k == 4, F.concat(F.date_format("ts", "HH:mm"), F.lit(":61.5")))
        .when(k == 3, F.date_format("ts", "HH:mm:ss"))
        .otherwise(F.date_format("ts", "HH:mm:ss.SSS"))
    )
    rows = table(spark, d, "events").select("event_id", mark.alias("mark"))
    return rows.withColumn("seconds", F.round(clock.row_clock_seconds(F.col("mark")), 3))


@query(
    "header_stamp",
    r"""WITH t AS (SELECT event_id, CASE WHEN event_id % 6 = 5 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y%m%d %H:%M:%S') END AS stamp FROM events)
  SELECT event_id, CASE WHEN event_id % 6 <> 5 THEN epoch(strptime(stamp, '%Y%m%d %H:%M:%S'))::BIGINT END AS epoch_s FROM t""",
)
def header_stamp(spark, d):
    stamp = F.when(F.col("event_id") % 6 == 5, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyyMMdd HH:mm:ss"))
    rows = table(spark, d, "events").select("event_id", stamp.alias("stamp"))
    return rows.select("event_id", F.unix_seconds(clock.header_stamp(F.col("stamp"))).alias("epoch_s"))


@query(
    "instant_parse",
    r"""SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN epoch_us(ts) / 1e6 WHEN 1 THEN floor(epoch_us(ts) / 1000) / 1000.0 - 7200 WHEN 2 THEN floor(epoch_us(ts) / 1000) / 1000.0 ELSE (event_id * 0.5)::DOUBLE END, 3) AS seconds FROM events""",
)
def instant_parse(spark, d):
    k = F.col("event_id") % 4
    text = (
        F.when(k == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
        .when(k == 1, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("+02:00")))
        .when(k == 2, F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1000).cast("string"))
        .otherwise(F.replace((F.col("event_id") * 0.5).cast("decimal(20,1)").cast("string"), F.lit("."), F.lit(",")))
    )
    rows = table(spark, d, "events").select("event_id", text.alias("text"))
    cls = F.when(F.col("event_id") % 4 < 2, "iso8601").otherwise("number")
    factor = F.when(F.col("event_id") % 4 == 2, 0.001).otherwise(1.0)
    return rows.select("event_id", F.round(clock.instant_seconds(F.col("text"), cls, factor, ","), 3).alias("seconds"))


@query(
    "clock_reconcile",
    r"""WITH l AS (SELECT o_orderkey AS log_id, o_orderdate + INTERVAL 3287 DAY AS day0, (o_orderkey * 37) % 86400 AS sod, o_orderkey % 9 AS k FROM orders),
  m AS (SELECT log_id, k, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'garbage' WHEN k = 2 THEN '19800101 01:01:01' ELSE strftime(day0 + to_seconds(sod), '%Y%m%d %H:%M:%S') END AS started,
     CASE WHEN k = 3 THEN NULL WHEN k = 4 THEN ((sod + 43200) % 86400)::DOUBLE WHEN k = 5 THEN ((sod + 20) % 86400)::DOUBLE WHEN k = 6 THEN ((sod + 5000) % 86400)::DOUBLE ELSE sod::DOUBLE END AS first_row_s, day0, sod FROM l),
  q AS (SELECT *, CASE WHEN k > 3 THEN [abs(sod - first_row_s), abs(sod - first_row_s - 86400), abs((sod + 43200) % 86400 - first_row_s), abs((sod + 43200) % 86400 - first_row_s - 86400)] END AS res FROM m),
  z AS (SELECT *, list_min(res) AS best, list_position(res, list_min(res)) AS pos FROM q)
  SELECT log_id, CASE WHEN k <= 3 OR day0 < TIMESTAMP '2005-01-01' THEN 'unknown' WHEN best <= 60 THEN 'reliable' ELSE 'unreliable' END AS reliability,
    CASE WHEN k > 3 AND day0 >= TIMESTAMP '2005-01-01' AND best <= 60 THEN epoch_ms(day0) + (CASE WHEN pos IN (2, 4) THEN 86400 ELSE 0 END + first_row_s)::BIGINT * 1000 END AS t0_ms FROM z""",
)
def clock_reconcile(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("log_id"), F.expr("o_orderdate + interval 3287 days").alias("day0"),
        ((F.col("o_orderkey") * 37) % 86400).alias("sod"), (F.col("o_orderkey") % 9).alias("k"),
    )
    k, sod = F.col("k"), F.col("sod")
    stamp = F.date_format(F.col("day0").cast("timestamp") + F.make_dt_interval(secs=sod), "yyyyMMdd HH:mm:ss")
    first = (
        F.when(k == 4, (sod + 43200) % 86400).when(k == 5, (sod + 20) % 86400).when(k == 6, (sod + 5000) % 86400).when(k != 3, sod)
    ).cast("double")
    logs = o.select(
        "log_id", F.when(k == 1, "garbage").when(k == 2, "19800101 01:01:01").when(k > 2, stamp).alias("started"),
        first.alias("first_row_s"), F.lit(None).cast("string").alias("downloaded"), F.col("log_id").cast("string").alias("log_number"),
    )
    out = clock.reconcile(logs)
    return out.select("log_id", "reliability", F.unix_millis("t0").alias("t0_ms"))
