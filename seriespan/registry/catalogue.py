"""Plausibility, identity, comparability and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..functions.units import unit_frame
from ..operators import conflicts, identity, plausibility as pl, profiles
from ..plans.views import samples, table
from . import query
from .units import CATALOGUE

ROLES = [
    ("click", "pressure", 0.0, 600.0, True),
    ("view", "temperature", 233.15, 423.15, False),
    ("error", "ratio", 0.0, 1.0, True),
    ("signup", "mixture_ratio", 0.4, 1.6, False),
    ("purchase", "speed", 0.0, 150.0, True),
]
LIM = pl.PlausibilityLimits(min_samples=5)


def _findings(spark, d):
    s = samples(spark, d).withColumn(
        "v",
        F.when(F.col("channel_id") == "view", F.pmod(F.col("seq"), F.lit(80)) + 10.0)
        .when(F.col("channel_id") == "error", F.pmod(F.col("seq"), F.lit(100)).cast("double"))
        .when(F.col("channel_id") == "signup", 11.0 + F.pmod(F.col("seq"), F.lit(5)) + F.pmod(F.col("log_id"), F.lit(2)) * 100)
        .when((F.col("channel_id") == "click") & (F.col("v") > 200), -F.col("v"))
        .otherwise(F.col("v")),
    )
    channels = s.select("log_id", "channel_id").distinct().select(
        "log_id", "channel_id",
        F.when(F.pmod("log_id", F.lit(11)) != 0, F.col("channel_id")).alias("role"),
        F.when(F.col("channel_id") == "click", "fuzzy").otherwise("exact").alias("confidence"),
        F.when((F.col("channel_id") == "purchase") & (F.pmod("log_id", F.lit(4)) == 0), "torque").alias("dim"),
    )
    roles = spark.createDataFrame(ROLES, "role string, role_dim string, lo double, hi double, critical boolean")
    return pl.evaluate(s, channels, roles, LIM, sentinels=[7.0])


def _tries_sql() -> str:
    """The corrections of the dimensions in play, as VALUES in the order they are tried."""
    import math

    from ..catalog.units import DEFAULT_REFERENCE_KPA, units_of

    rows = []
    for dim in dict.fromkeys(r[1] for r in ROLES):
        tries = []
        for c in sorted(units_of(dim)[1:], key=lambda c: c.parameter_role != "stoichiometry"):
            diag = "afr_for_lambda" if c.parameter_role else "wrong_unit"
            tries.append((diag, f"'{c.unit}'", c.kind, c.a, c.b, 0.0))
        if dim == "pressure":
            tries.append(("gauge_without_reference", "NULL", "affine", 1.0, 0.0, DEFAULT_REFERENCE_KPA))
        for f in sorted(LIM.factors, key=lambda x: abs(math.log(abs(x)))):
            tries.append(("inverted_sign" if abs(f) == 1 else "wrong_scale", "NULL", "affine", 1 / f, 0.0, 0.0))
        for i, (diag, unit, kind, a, b, shift) in enumerate(tries):
            rows.append(f"('{dim}', {i}, '{diag}', {unit}, '{kind}', {a!r}::DOUBLE, {b!r}::DOUBLE, {shift!r}::DOUBLE)")
    return ", ".join(rows)


ROLE_ROWS = ", ".join(f"('{r}', '{d}', {lo!r}::DOUBLE, {hi!r}::DOUBLE, {str(c).upper()})" for r, d, lo, hi, c in ROLES)
PLAUSIBLE = f"""{{S}}, x AS (SELECT log_id, channel_id, seq, CASE channel_id WHEN 'view' THEN seq % 80 + 10.0 WHEN 'error' THEN seq % 100
     WHEN 'signup' THEN 11.0 + seq % 5 + (log_id % 2) * 100 WHEN 'click' THEN CASE WHEN v > 200 THEN -v ELSE v END ELSE v END::DOUBLE AS v FROM s),
  ro(role, role_dim, lo, hi, critical) AS (VALUES {ROLE_ROWS}),
  tr(hdim, ord, diagnosis, unit, kind, a, b, shift) AS (VALUES {_tries_sql()}),
  c AS (SELECT DISTINCT log_id, channel_id, CASE WHEN log_id % 11 <> 0 THEN channel_id END AS role,
     CASE WHEN channel_id = 'purchase' AND log_id % 4 = 0 THEN 'torque' END AS dim FROM x),
  i AS (SELECT c.*, role_dim, lo, hi, critical FROM c LEFT JOIN ro USING (role)),
  g AS (SELECT i.log_id, i.channel_id, any_value(i.role) AS role, any_value(i.dim) AS dim, any_value(role_dim) AS role_dim,
     any_value(lo) AS lo, any_value(hi) AS hi, any_value(critical) AS critical, count(*) AS n, count(*) FILTER (v = 7.0) AS sentinels,
     count(*) FILTER (v <> 7.0) AS valid, count(*) FILTER (v <> 7.0 AND (v < lo OR v > hi)) AS outside FROM i JOIN x USING (log_id, channel_id) GROUP BY 1, 2),
  w AS (SELECT *, coalesce(outside::DOUBLE / nullif(valid, 0), 0) AS share, CASE WHEN valid = 0 THEN 'no_data' WHEN role IS NULL THEN 'no_role'
     WHEN dim <> role_dim THEN 'dimension_mismatch' WHEN valid < 5 THEN 'few_samples' WHEN outside = 0 THEN 'plausible'
     WHEN coalesce(outside::DOUBLE / nullif(valid, 0), 0) <= 0.02 THEN 'excursion' END AS verdict FROM g),
  f AS (SELECT w.log_id, w.channel_id, tr.ord, tr.diagnosis, tr.unit, avg(CASE WHEN kind = 'reciprocal' THEN
       coalesce(NOT (a / nullif(v, 0) BETWEEN lo AND hi), TRUE)::INT ELSE (NOT ((v - b) / a + shift BETWEEN lo AND hi))::INT END) AS fs
     FROM w JOIN x USING (log_id, channel_id) JOIN tr ON tr.hdim = w.role_dim WHERE verdict IS NULL AND v <> 7.0 GROUP BY 1, 2, 3, 4, 5),
  b AS (SELECT log_id, channel_id, arg_min(diagnosis, ord) AS diagnosis, arg_min(coalesce(unit, ''), ord) AS unit FROM f WHERE fs <= 0.02 GROUP BY 1, 2),
  z AS (SELECT w.log_id, w.channel_id, coalesce(verdict, b.diagnosis, 'unexplained') AS diagnosis, w.n, w.valid, w.sentinels, w.outside,
     round(share, 6) AS outside_share, CASE WHEN verdict IS NULL THEN nullif(b.unit, '') END AS likely_unit, coalesce(critical, FALSE) AS critical
     FROM w LEFT JOIN b USING (log_id, channel_id)),
  y AS (SELECT *, CASE WHEN diagnosis IN ('dimension_mismatch', 'wrong_unit', 'afr_for_lambda', 'gauge_without_reference', 'inverted_sign', 'wrong_scale', 'unexplained')
     THEN CASE WHEN critical THEN 'critica' ELSE 'alta' END WHEN diagnosis = 'excursion' THEN CASE WHEN critical THEN 'media' ELSE 'baja' END
     WHEN diagnosis = 'no_data' THEN CASE WHEN critical THEN 'media' ELSE 'informativa' END ELSE 'informativa' END AS severity FROM z)
"""


@query(
    "plausibility",
    PLAUSIBLE + "SELECT log_id, channel_id, diagnosis, severity, n, valid, sentinels, outside, outside_share, likely_unit FROM y",
)
def plausibility(spark, d):
    return _findings(spark, d).select(
        "log_id", "channel_id", "diagnosis", "severity", "n", "valid", "sentinels", "outside",
        F.round("outside_share", 6).alias("outside_share"), "likely_unit",
    )


@query("plausibility_counts", PLAUSIBLE + "SELECT diagnosis, count(*) AS channels FROM y GROUP BY diagnosis")
def plausibility_counts(spark, d):
    return pl.diagnosis_counts(_findings(spark, d))


@query(
    "plausibility_report",
    PLAUSIBLE + """SELECT CAST(CASE severity WHEN 'critica' THEN 0 WHEN 'alta' THEN 1 WHEN 'media' THEN 2 WHEN 'baja' THEN 3 ELSE 4 END AS INT) AS rank,
    log_id, channel_id, diagnosis FROM y""",
)
def plausibility_report(spark, d):
    return pl.report(_findings(spark, d)).select("rank", "log_id", "channel_id", "diagnosis")


# Channels stand-in: parts as channels, the supplier-like bucket p_partkey % 97 as the log.
CH = """WITH ch AS (SELECT p_partkey % 97 AS log_id, printf('c%06d', p_partkey) AS channel_id,
    CASE WHEN p_size % 4 = 0 THEN lower(p_type) END AS role, CASE WHEN p_size % 8 = 0 THEN CAST(p_size // 8 AS INT) END AS role_index,
    CASE WHEN p_size % 3 = 0 THEN 'fmt' END AS format, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) END AS native_id,
    CASE WHEN p_size % 7 <> 0 THEN regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') END AS name_key FROM part),
  man(ord, pair, log_id, channel_id) AS (SELECT CAST(p_partkey // 10 AS INT), 'm' || (p_partkey // 10), p_partkey % 97, printf('c%06d', p_partkey)
    FROM part WHERE p_size < 9),
"""


def _channels(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size")
    ch = p.select(
        (F.col("p_partkey") % 97).alias("log_id"),
        F.format_string("c%06d", "p_partkey").alias("channel_id"),
        F.when(size % 4 == 0, F.lower("p_type")).alias("role"),
        F.when(size % 8 == 0, F.floor(size / 8).cast("int")).alias("role_index"),
        F.when(size % 3 == 0, "fmt").alias("format"),
        F.when(size % 3 == 0, size.cast("string")).alias("native_id"),
        F.when(size % 7 != 0, names.normalise(F.col("p_name"))).alias("name_key"),
    )
    ten = F.floor(F.col("p_partkey") / 10)
    manual = p.filter(size < 9).select(
        ten.cast("int").alias("ord"), F.concat(F.lit("m"), ten).alias("pair"),
        (F.col("p_partkey") % 97).alias("log_id"), F.format_string("c%06d", "p_partkey").alias("channel_id"),
    )
    return ch, manual


def _layer(n: int, src: str, key: str, layer: str) -> str:
    return f"""k{n} AS (SELECT *, {key} AS gid FROM {src}),
  m{n} AS (SELECT '{layer}' AS layer, gid AS group_id, log_id, channel_id FROM (SELECT *, row_number() OVER (PARTITION BY gid, log_id ORDER BY channel_id) AS rn
    FROM k{n} WHERE gid IS NOT NULL) WHERE rn = 1),
  p{n} AS (SELECT * FROM {src} ANTI JOIN m{n} USING (log_id, channel_id))"""


IDENTITY = CH + """mv AS (SELECT * FROM man JOIN ch USING (log_id, channel_id)),
  mg AS (SELECT pair FROM mv GROUP BY pair HAVING count(DISTINCT log_id) >= 2),
  m0 AS (SELECT 'manual' AS layer, 'manual:' || pair AS group_id, log_id, channel_id FROM mv SEMI JOIN mg USING (pair)),
  p0 AS (SELECT * FROM ch ANTI JOIN m0 USING (log_id, channel_id)),
  """ + ",\n  ".join(
    [
        _layer(1, "p0", "CASE WHEN role IS NOT NULL THEN 'role:' || role || CASE WHEN role_index IS NOT NULL THEN '#' || role_index ELSE '' END END", "role"),
        _layer(2, "p1", "CASE WHEN format IS NOT NULL AND native_id IS NOT NULL THEN 'native:' || format || ':' || native_id END", "native"),
        _layer(3, "p2", "CASE WHEN name_key <> '' THEN 'name:' || name_key END", "name"),
    ]
) + ", mm AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)\n"


@query("identity_layers", IDENTITY + "SELECT layer, group_id, log_id, channel_id FROM mm")
def identity_layers(spark, d):
    return identity.match_channels(*_channels(spark, d))


PAIRS = CH + """xs AS (SELECT ord, pair, min(channel_id) AS channel_id, min(log_id) FILTER (channel_id = c0) AS log_id FROM
    (SELECT *, min(channel_id) OVER (PARTITION BY pair) AS c0 FROM man) GROUP BY ord, pair),
  mv AS (SELECT * FROM man JOIN ch USING (log_id, channel_id)),
  mg AS (SELECT pair FROM mv GROUP BY pair HAVING count(DISTINCT log_id) >= 2),
  lost AS (SELECT 'manual_not_applicable' AS code, pair, -1 AS log_id, 'gone' AS channel_id FROM man WHERE ord % 3 = 0 GROUP BY pair
    UNION ALL SELECT 'manual_not_applicable', 'x' || pair, log_id, channel_id FROM xs SEMI JOIN mg USING (pair)
    UNION ALL SELECT 'manual_not_applicable', 'x' || pair, -1, 'gone' FROM xs)
"""


@query(
    "identity_pair_notices",
    PAIRS + """SELECT * FROM lost UNION ALL SELECT 'manual_dropped', pair, NULL, NULL FROM (SELECT DISTINCT pair FROM man) ANTI JOIN mg USING (pair)
  UNION ALL SELECT 'manual_dropped', 'x' || pair, NULL, NULL FROM xs
  UNION ALL SELECT 'manual_contradicts_role', pair, NULL, NULL FROM mv SEMI JOIN mg USING (pair) GROUP BY pair HAVING count(DISTINCT role) > 1""",
)
def identity_pair_notices(spark, d):
    """Pairs that cite channels that do not exist, and later pairs that cite what an earlier one holds."""
    ch, manual = _channels(spark, d)
    gone = manual.where("ord % 3 = 0").select("ord", "pair").distinct()
    nowhere = [F.lit(-1).cast("bigint").alias("log_id"), F.lit("gone").alias("channel_id")]
    first = manual.groupBy("ord", "pair").agg(F.min(F.struct("channel_id", "log_id")).alias("_f"))
    later = [(F.col("ord") + 1_000_000).alias("ord"), F.concat(F.lit("x"), "pair").alias("pair")]
    more = (
        gone.select("ord", "pair", *nowhere).unionByName(first.select(*later, "_f.log_id", "_f.channel_id")).unionByName(first.select(*later, *nowhere))
    )
    return identity.manual_notices(ch, manual.unionByName(more))


@query(
    "identity_groups",
    IDENTITY + "SELECT layer, group_id, count(DISTINCT log_id) AS logs, arg_min(channel_id, (log_id, channel_id)) AS label FROM mm GROUP BY 1, 2",
)
def identity_groups(spark, d):
    return identity.group_summary(identity.match_channels(*_channels(spark, d)))


@query(
    "identity_notices",
    IDENTITY + """SELECT log_id, channel_id, CASE WHEN role IS NOT NULL OR (format IS NOT NULL AND native_id IS NOT NULL) OR name_key <> ''
    THEN 'same_log_same_group' ELSE 'no_identity' END AS code FROM ch ANTI JOIN mm USING (log_id, channel_id)""",
)
def identity_notices(spark, d):
    return identity.identity_notices(*_channels(spark, d))


ROLE_SYNONYMS = [
    (0, "colour_ring", ["red ring", "blue ring", "Green_Ring"]),
    (1, "widget", ["small widget", "large widget", "widget {n}"]),
    (2, "bolt", ["red bolt", "bolt {n} size"]),
    (3, "gearish", ["steel gear", "gear #{n}"]),
    (4, "bolt_b", ["red bolt", "blue bolt"]),
]


def _named(spark, d):
    """Part names, every third one with an index the patterns know."""
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        "p_partkey",
        F.when(key % 9 == 0, F.concat(F.lit("Widget_"), F.col("p_size")))
        .when(key % 9 == 1, F.concat(F.lit("BOLT "), F.col("p_size"), F.lit(" size")))
        .otherwise(F.col("p_name"))
        .alias("name"),
    )


@query(
    "role_exact_indexed",
    """WITH n AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'Widget_' || p_size WHEN 1 THEN 'BOLT ' || p_size || ' size' ELSE p_name END AS name FROM part),
  k AS (SELECT *, lower(regexp_replace(name, '[\\s_\\-./\\\\()\\[\\]{}:,;+]+', '', 'g')) AS key FROM n),
  e(key, role) AS (VALUES ('redring', 'colour_ring'), ('bluering', 'colour_ring'), ('greenring', 'colour_ring'), ('smallwidget', 'widget'),
    ('largewidget', 'widget'), ('redbolt', 'bolt'), ('steelgear', 'gearish'), ('bluebolt', 'bolt_b'))
  SELECT p_partkey, name, coalesce(e.role, CASE WHEN regexp_matches(key, '^widget\\d+$') THEN 'widget' WHEN regexp_matches(key, '^bolt\\d+size$') THEN 'bolt' END) AS role,
    CASE WHEN e.role IS NOT NULL THEN 'exact' WHEN regexp_matches(key, '^(widget|bolt)\\d+') THEN 'indexed' END AS confidence,
    CASE WHEN e.role IS NULL THEN TRY_CAST(regexp_extract(key, '(\\d+)', 1) AS INT) END AS idx
  FROM k LEFT JOIN e USING (key)""",
)
def role_exact_indexed(spark, d):
    named = _named(spark, d)
    roles = spark.createDataFrame(ROLE_SYNONYMS, "ord int, role string, synonyms array<string>")
    found = names.assign_roles(named, roles, cutoff=1.0)  # nothing short of equal
    return named.join(found, "name", "left").select("p_partkey", "name", "role", "confidence", F.col("index").alias("idx"))


# Closeness of the names that no synonym or pattern has: matched characters of both lengths, found by hand.
CLOSE = """('redwidget', 'widget', 8, 20)"""


@query(
    "role_assignment",
    f"""WITH n AS (SELECT p_partkey, p_size, CASE p_partkey % 9 WHEN 0 THEN 'Widget_' || p_size WHEN 1 THEN 'BOLT ' || p_size || ' size' ELSE p_name END AS name FROM part),
  k AS (SELECT *, replace(replace(lower(name), ' ', ''), '_', '') AS key FROM n),
  e(key, role) AS (VALUES ('redring', 'colour_ring'), ('bluering', 'colour_ring'), ('greenring', 'colour_ring'), ('smallwidget', 'widget'),
    ('largewidget', 'widget'), ('redbolt', 'bolt'), ('steelgear', 'gearish'), ('bluebolt', 'bolt_b')),
  c(key, role, m, t) AS (VALUES {CLOSE})
  SELECT p_partkey, name, CASE p_partkey % 9 WHEN 0 THEN 'widget' WHEN 1 THEN 'bolt' ELSE coalesce(e.role, c.role) END AS role,
    CASE WHEN p_partkey % 9 < 2 THEN 'indexed' WHEN e.role IS NOT NULL THEN 'exact' WHEN c.role IS NOT NULL THEN 'fuzzy' END AS confidence,
    CASE WHEN p_partkey % 9 < 2 THEN p_size END AS idx,
    CASE WHEN p_partkey % 9 < 2 OR e.role IS NOT NULL THEN 1.0 ELSE round(2.0 * c.m / c.t, 9) END::DOUBLE AS ratio
  FROM k LEFT JOIN e USING (key) LEFT JOIN c USING (key)""",
)
def role_assignment(spark, d):
    named = _named(spark, d)
    roles = spark.createDataFrame(ROLE_SYNONYMS, "ord int, role string, synonyms array<string>")
    found = names.assign_roles(named, roles, cutoff=0.8)
    return named.join(found, "name", "left").select(
        "p_partkey", "name", "role", "confidence", F.col("index").alias("idx"), F.round("ratio", 9).alias("ratio")
    )


DECL = """, de AS (SELECT lower(p_name) AS role, p_partkey AS log_id, CASE p_size % 17 WHEN 0 THEN NULL WHEN 1 THEN 'nonsense' ELSE
     CASE WHEN p_name LIKE 'red%' THEN 'pressure' ELSE 'temperature' END END AS dim,
    CASE WHEN p_size % 19 = 0 THEN 'unknown' ELSE 'confirmed' END AS confidence, CASE WHEN p_size % 23 = 0 THEN 'rpm' END AS source_unit,
    CASE WHEN p_size % 5 = 0 THEN 'gauge' WHEN p_size % 5 < 4 THEN 'absolute' END AS pressure, CASE WHEN p_size % 10 = 0 THEN 101.0 END AS reference_kpa,
    CASE WHEN p_name LIKE '%bolt' AND p_size = 30 THEN 5.0 ELSE 0.1 END AS factor, CASE WHEN p_name LIKE '%ring' AND p_size = 9 THEN 5000.0 ELSE 0.0 END AS off,
    CASE WHEN p_size % 3 > 0 THEN 0.0 END AS lo, CASE WHEN p_size % 3 > 0 THEN 1000.0 + p_size END AS hi FROM part),
  rs AS (SELECT de.*, CASE WHEN dim IS NULL THEN 'no_dimension' WHEN dim NOT IN (SELECT dim FROM un) THEN 'unknown_dimension' WHEN confidence = 'unknown' THEN 'unconfirmed_scale'
     WHEN source_unit IS NOT NULL THEN 'foreign_unit' WHEN dim = 'pressure' AND pressure = 'gauge' AND reference_kpa IS NULL THEN 'gauge_without_reference' END AS reason FROM de),
  cn AS (SELECT *, reason IS NULL AS live, reason IS NULL OR reason = 'gauge_without_reference' AS early,
     CASE WHEN reason IS NULL AND lo IS NOT NULL THEN lo * factor + off + CASE WHEN dim = 'pressure' AND pressure = 'gauge' THEN reference_kpa ELSE 0 END END::DOUBLE AS clo,
     CASE WHEN reason IS NULL AND lo IS NOT NULL THEN hi * factor + off + CASE WHEN dim = 'pressure' AND pressure = 'gauge' THEN reference_kpa ELSE 0 END END::DOUBLE AS chi FROM rs),
  ag AS (SELECT role, count(*) AS declared, count(*) FILTER (live) AS comparable_logs, count(*) FILTER (reason IS NOT NULL) AS excluded,
     count(DISTINCT dim) FILTER (early) AS dims, min(dim) FILTER (early) AS dim0, count(clo) AS ranges, max(chi - clo) / min(chi - clo) AS ratio,
     max(clo) > min(chi) AS disjoint, count(*) FILTER (live AND dim = 'pressure' AND (pressure = 'gauge' OR pressure IS NULL)) AS noted FROM cn GROUP BY role),
  vd AS (SELECT *, CASE WHEN declared < 2 THEN 'single' WHEN dims > 1 THEN 'different_dimensions' WHEN comparable_logs < 2 THEN 'too_few_left'
     WHEN ranges >= 2 AND ratio >= 10 THEN 'incoherent_span' WHEN ranges >= 2 AND disjoint THEN 'disjoint_ranges' END AS reason FROM ag)
"""


def _declared(spark, d):
    n, s = F.col("p_name"), F.col("p_size")
    return table(spark, d, "part").select(
        F.lower(n).alias("role"), F.col("p_partkey").alias("log_id"), F.col("p_partkey").cast("string").alias("channel_id"),
        F.when(s % 17 == 1, "nonsense").when(s % 17 > 1, F.when(n.like("red%"), "pressure").otherwise("temperature")).alias("dim"),
        F.when(s % 19 == 0, "unknown").otherwise("confirmed").alias("confidence"),
        F.when(s % 23 == 0, "rpm").alias("source_unit"),
        F.when(s % 5 == 0, "gauge").when(s % 5 < 4, "absolute").alias("pressure"),
        F.when(s % 10 == 0, 101.0).alias("reference_kpa"),
        F.when(n.like("%bolt") & (s == 30), 5.0).otherwise(0.1).alias("factor"),
        F.when(n.like("%ring") & (s == 9), 5000.0).otherwise(0.0).alias("offset"),
        F.when(s % 3 > 0, 0.0).alias("lo"), F.when(s % 3 > 0, 1000.0 + s).alias("hi"),
    )


@query(
    "role_comparability",
    CATALOGUE + DECL + """SELECT role, CASE WHEN reason = 'single' THEN 'nothing_to_compare' WHEN reason IS NOT NULL THEN 'not_comparable'
    WHEN excluded > 0 OR noted > 0 THEN 'with_reservation' ELSE 'comparable' END AS verdict, reason, declared, comparable_logs, excluded FROM vd""",
)
def role_comparability(spark, d):
    return conflicts.comparability(_declared(spark, d), unit_frame(spark)).select(
        "role", "verdict", "reason", "declared", "comparable_logs", "excluded"
    )


@query("comparability_exclusions", CATALOGUE + DECL + "SELECT role, log_id, reason FROM rs WHERE reason IS NOT NULL")
def comparability_exclusions(spark, d):
    out = conflicts.exclusion_reasons(_declared(spark, d), unit_frame(spark))
    return out.filter("reason IS NOT NULL").select("role", "log_id", "reason")


ELEMENTS = [
    ("P1", "mixture", 0, "economy", None, None, True),
    ("P1", "mixture", 1, "small", None, None, False),
    ("P1", "knock", 0, "large", 2, None, True),
    ("P1", "knock", 1, None, None, "9", False),
    ("P2", "boost", 0, "medium", None, None, True),
    ("P2", "boost", 1, "promo", None, None, False),
    ("P3", "all", 0, "economy", None, None, False),
    ("P3", "all", 1, "standard", 3, None, False),
]
ELEMENT_SCHEMA = "profile string, panel string, pos int, role string, role_index int, native_id string, required boolean"


def _sqlv(x):
    return "NULL" if x is None else (str(x).upper() if isinstance(x, bool) else repr(x))


ELEMENT_ROWS = ", ".join("(" + ", ".join(_sqlv(v) for v in e) + ")" for e in ELEMENTS)
PROFILE = CH.rstrip().rstrip(",") + f""", cf AS (SELECT *, CASE channel_id[-1] WHEN '0' THEN 'fuzzy' WHEN '1' THEN 'indexed' ELSE 'exact' END AS confidence,
    channel_id[-1] = '5' AS is_empty FROM ch), us AS (SELECT * FROM cf WHERE NOT is_empty AND confidence <> 'fuzzy'),
  el(profile, panel, pos, role, role_index, native_id, required) AS (VALUES {ELEMENT_ROWS}),
"""


def _applied_sql(src: str, out: str) -> str:
    return f"""{out}_b AS (SELECT log_id, role AS r, role_index AS i, channel_id AS by_role FROM (SELECT *, row_number() OVER (PARTITION BY log_id, role, role_index
      ORDER BY CASE confidence WHEN 'exact' THEN 0 WHEN 'indexed' THEN 1 ELSE 2 END, channel_id) AS k FROM {src} WHERE role IS NOT NULL) WHERE k = 1),
  {out}_n AS (SELECT log_id, native_id AS nid, min(channel_id) AS by_id FROM {src} WHERE native_id IS NOT NULL GROUP BY 1, 2),
  {out} AS (SELECT l.log_id, el.*, coalesce(b.by_role, n.by_id) AS served_by FROM (SELECT DISTINCT log_id FROM {src}) l CROSS JOIN el
    LEFT JOIN {out}_b b ON b.log_id = l.log_id AND b.r = el.role AND b.i IS NOT DISTINCT FROM el.role_index
    LEFT JOIN {out}_n n ON n.log_id = l.log_id AND n.nid = el.native_id AND el.role IS NULL)"""


def _profiled(spark, d):
    ch, _ = _channels(spark, d)
    last = F.substring("channel_id", -1, 1)
    ch = ch.withColumns(
        {
            "confidence": F.when(last == "0", "fuzzy").when(last == "1", "indexed").otherwise("exact"),
            "is_empty": last == "5",
        }
    )
    return spark.createDataFrame(ELEMENTS, ELEMENT_SCHEMA), ch


@query("profile_elements", PROFILE + _applied_sql("cf", "ap") + " SELECT log_id, profile, panel, pos, served_by FROM ap")
def profile_elements(spark, d):
    elements, ch = _profiled(spark, d)
    return profiles.apply_profiles(elements, ch).select("log_id", "profile", "panel", "pos", "served_by")


PANELS = """SELECT log_id, profile, panel, NOT coalesce(bool_or(required AND role IS NOT NULL AND served_by IS NULL), FALSE) AS visible,
    count(DISTINCT role) FILTER (served_by IS NOT NULL) AS available, count(DISTINCT role) AS roles FROM ap GROUP BY 1, 2, 3"""


@query("profile_panels", PROFILE + _applied_sql("cf", "ap") + " " + PANELS)
def profile_panels(spark, d):
    return profiles.panel_states(profiles.apply_profiles(*_profiled(spark, d)))


SUGGEST = PROFILE + _applied_sql("us", "ap") + f""", pn AS ({PANELS}),
  hv AS (SELECT ap.log_id, ap.profile, count(DISTINCT ap.role) AS available FROM ap JOIN pn USING (log_id, profile, panel)
    WHERE visible AND served_by IS NOT NULL AND ap.role IS NOT NULL GROUP BY 1, 2),
  tt AS (SELECT profile, count(DISTINCT role) AS roles FROM el WHERE role IS NOT NULL GROUP BY 1),
  sg AS (SELECT l.log_id, tt.profile, coalesce(available, 0) AS available, roles, coalesce(available, 0)::DOUBLE / roles AS share
    FROM (SELECT DISTINCT log_id FROM cf) l CROSS JOIN tt LEFT JOIN hv ON hv.log_id = l.log_id AND hv.profile = tt.profile),
  pl AS (SELECT *, CAST(row_number() OVER (PARTITION BY log_id ORDER BY share DESC, available DESC, profile) AS INT) AS place FROM sg)
  SELECT log_id, profile, available, roles, round(share, 6) AS share, place FROM pl"""


@query("profile_suggestions", SUGGEST)
def profile_suggestions(spark, d):
    out = profiles.suggest(*_profiled(spark, d))
    return out.select("log_id", "profile", "available", "roles", F.round("share", 6).alias("share"), "place")


@query("profile_best", SUGGEST + " WHERE place = 1 AND share >= 0.5")
def profile_best(spark, d):
    out = profiles.best_suggestion(profiles.suggest(*_profiled(spark, d)))
    return out.select("log_id", "profile", "available", "roles", F.round("share", 6).alias("share"), "place")


IMPORT = """WITH cur AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS file, lower(regexp_replace(o_orderpriority, '[- ]', '', 'g')) AS key, o_orderpriority AS name,
    min(o_orderstatus) AS decision FROM orders GROUP BY 1, 2, 3),
  fi AS (SELECT DISTINCT file, CASE WHEN file::INT % 5 = 0 THEN ';' ELSE ',' END AS delimiter, 'utf-8' AS encoding, CASE WHEN file::INT % 3 = 0 THEN 'fp1' ELSE 'x' END AS fingerprint FROM cur),
  pr(profile, d, e, f) AS (VALUES ('A', ',', 'utf-8', 'fp1'), ('B', ';', 'utf-8', 'fp2')),
  sv(profile, key, name, decision, origin) AS (VALUES ('A', '1urgent', '1-URGENT', 'keep', 'confirmed'), ('A', '2high', '2-HIGH', 'drop', 'guessed'),
    ('A', '9gone', '9-GONE', 'keep', 'confirmed'), ('B', '5low', '5-LOW', 'drop', 'confirmed')),
  pa AS (SELECT * FROM fi CROSS JOIN pr),
  fu AS (SELECT coalesce(c.file, o.file) AS file, coalesce(c.profile, o.profile) AS profile, coalesce(c.key, o.key) AS key, c.name AS cn, c.decision AS cd, o.name AS sn, o.decision AS sd, o.origin
    FROM (SELECT pa.file, pa.profile, cur.key, cur.name, cur.decision FROM pa JOIN cur USING (file)) c
    FULL JOIN (SELECT pa.file, sv.* FROM pa JOIN sv USING (profile)) o ON c.file = o.file AND c.profile = o.profile AND c.key = o.key),
  ct AS (SELECT file, profile, count(*) FILTER (cn IS NOT NULL AND sn IS NOT NULL) AS matched, count(*) FILTER (sn IS NULL) AS new_c, count(*) FILTER (cn IS NULL) AS lost FROM fu GROUP BY 1, 2),
  oc AS (SELECT pa.file, pa.profile, matched, new_c, lost, CASE WHEN NOT (delimiter = d AND encoding = e AND matched > 0) THEN 'none'
    WHEN fingerprint = f AND new_c = 0 AND lost = 0 THEN 'total' ELSE 'partial' END AS outcome FROM pa LEFT JOIN ct USING (file, profile))
"""


def _imports(spark, d, apply=profiles.reapply_import):
    o = table(spark, d, "orders")
    cur = o.groupBy(
        (F.col("o_custkey") % 40).cast("string").alias("file"),
        names.normalise(F.col("o_orderpriority")).alias("key"), F.col("o_orderpriority").alias("name"),
    ).agg(F.min("o_orderstatus").alias("decision"))
    f = F.col("file").cast("int")
    files = cur.select("file").distinct().select(
        "file", F.when(f % 5 == 0, ";").otherwise(",").alias("delimiter"), F.lit("utf-8").alias("encoding"),
        F.when(f % 3 == 0, "fp1").otherwise("x").alias("fingerprint"),
    )
    profile = spark.createDataFrame(
        [("A", ",", "utf-8", "fp1"), ("B", ";", "utf-8", "fp2")], "profile string, delimiter string, encoding string, fingerprint string"
    )
    saved = spark.createDataFrame(
        [("A", "1urgent", "1-URGENT", "keep", "confirmed"), ("A", "2high", "2-HIGH", "drop", "guessed"),
         ("A", "9gone", "9-GONE", "keep", "confirmed"), ("B", "5low", "5-LOW", "drop", "confirmed")],
        "profile string, key string, name string, decision string, origin string",
    )
    return apply(saved, cur, files, profile)


@query("import_reapply_outcome", IMPORT + "SELECT file, profile, outcome, matched, new_c, lost FROM oc")
def import_reapply_outcome(spark, d):
    return _imports(spark, d)[1].withColumnRenamed("new", "new_c")


IMPORT_COLUMNS = IMPORT + """SELECT fu.file, fu.profile, fu.key, cn AS name, CASE WHEN sn IS NULL THEN 'new' ELSE 'matched' END AS state,
    CASE WHEN outcome <> 'none' AND origin = 'confirmed' THEN sd ELSE cd END AS decision FROM fu JOIN oc USING (file, profile) WHERE cn IS NOT NULL"""


@query("import_reapply_columns", IMPORT_COLUMNS)
def import_reapply_columns(spark, d):
    return _imports(spark, d)[0]


@query("import_found_outcome", IMPORT + "SELECT file, profile, outcome, matched, new_c, lost FROM oc WHERE outcome <> 'none'")
def import_found_outcome(spark, d):
    return _imports(spark, d, profiles.find_imports)[1].withColumnRenamed("new", "new_c")


@query("import_found_columns", IMPORT_COLUMNS + " AND outcome <> 'none'")
def import_found_columns(spark, d):
    return _imports(spark, d, profiles.find_imports)[0]
