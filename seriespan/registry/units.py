"""Unit queries over the balance, price and payload columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog.units import COMPOUNDS, PRESETS, UNITS
from ..functions import bits, units as u
from ..plans.views import counters, samples, table
from . import query

VALUES = ", ".join(f"('{d}', '{n}', '{k}', CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for d, n, k, a, b in UNITS)
CATALOGUE = f"WITH un(dim, unit, kind, a, b) AS (VALUES {VALUES})"


@query(
    "unit_convert",
    CATALOGUE + """, c(cls) AS (VALUES ('point'), ('interval'), ('rate'), ('variance')),
  x AS (SELECT c_custkey, c_acctbal / 10 + 300 AS v FROM customer)
  SELECT c_custkey, dim, unit, cls, round(CASE WHEN kind = 'reciprocal' THEN CASE WHEN cls = 'point' THEN a / v END
    WHEN cls = 'point' THEN v * a + b WHEN cls = 'variance' THEN v * a * a ELSE v * a END, 5) AS shown
  FROM x, un, c WHERE dim IN ('temperature', 'mixture_ratio', 'fuel_economy')""",
)
def unit_convert(spark, d):
    units = u.unit_frame(spark)
    wanted = units.filter(F.col("dim").isin("temperature", "mixture_ratio", "fuel_economy"))
    targets = wanted.select(F.collect_list(F.struct("dim", "unit")).alias("t"))
    plan = [(r.dim, r.unit) for r in targets.first().t]
    combos = F.explode(
        F.array(*[F.struct(F.lit(a).alias("dim"), F.lit(b).alias("unit"), F.lit(c).alias("cls")) for a, b in plan for c in u.CLASSES])
    )
    rows = table(spark, d, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 10 + 300).alias("v"), combos.alias("x")
    ).select("c_custkey", "v", "x.*")
    out = u.convert_by_catalogue(rows, units, "v", "dim", "unit", "cls", "shown")
    return out.select("c_custkey", "dim", "unit", "cls", F.round("shown", 5).alias("shown"))


@query(
    "unit_round_trip",
    """SELECT s_suppkey, round(s_acctbal * 1.8 + (-459.67), 5) AS fahrenheit, round(s_acctbal * 1.8, 5) AS delta_f,
    round(s_acctbal * 1.8 * 1.8, 4) AS var_f, round(s_acctbal, 6) AS back,
    round((s_acctbal - 101.325) * 0.01, 6) AS gauge_bar, round(s_acctbal * 0.01, 6) AS delta_bar,
    round(s_acctbal, 6) AS absolute FROM supplier""",
)
def unit_round_trip(spark, d):
    x = F.col("s_acctbal")
    f = u.from_canonical(x, "temperature", "degF")
    g = u.from_canonical(x, "pressure", "bar", reference=101.325)
    return table(spark, d, "supplier").select(
        "s_suppkey",
        F.round(f, 5).alias("fahrenheit"),
        F.round(u.from_canonical(x, "temperature", "degF", "interval"), 5).alias("delta_f"),
        F.round(u.from_canonical(x, "temperature", "degF", "variance"), 4).alias("var_f"),
        F.round(u.to_canonical(f, "temperature", "degF"), 6).alias("back"),
        F.round(g, 6).alias("gauge_bar"),
        F.round(u.from_canonical(x, "pressure", "bar", "interval", reference=101.325), 6).alias("delta_bar"),
        F.round(u.to_canonical(g, "pressure", "bar", reference=101.325), 6).alias("absolute"),
    )


@query(
    "unit_reciprocal_param",
    """SELECT p_partkey, round(100.0 / p_retailprice, 8) AS km_per_l, round(p_retailprice * coalesce(nullif(p_size, 7), 14.7), 5) AS afr,
    round(p_retailprice, 6) AS back FROM part""",
)
def unit_reciprocal_param(spark, d):
    x = F.col("p_retailprice")
    param = F.when(F.col("p_size") != 7, F.col("p_size").cast("double"))
    k = u.from_canonical(x, "fuel_economy", "km/L")
    return table(spark, d, "part").select(
        "p_partkey",
        F.round(k, 8).alias("km_per_l"),
        F.round(u.from_canonical(x, "mixture_ratio", "afr", param=param), 5).alias("afr"),
        F.round(u.to_canonical(k, "fuel_economy", "km/L"), 6).alias("back"),
    )


PAIRS = ", ".join(f"('{c}', '{n}', '{m}')" for c, (n, m) in COMPOUNDS.items())


@query(
    "compound_units",
    CATALOGUE + f""", cp(compound, nd, dd) AS (VALUES {PAIRS}),
  x AS (SELECT p_partkey, p_retailprice AS v, list_extract(['pct_per_kPa', 'pct_per_lambda', 'pct_per_rpm'], 1 + p_size % 3) AS compound FROM part)
  SELECT p_partkey, n.unit || '/' || m.unit AS label, round(v * (n.a / m.a) / 1000, 3) AS shown
  FROM x JOIN cp USING (compound) JOIN un n ON n.dim = nd AND n.kind = 'affine' JOIN un m ON m.dim = dd AND m.kind = 'affine'""",
)
def compound_units(spark, d):
    compounds = spark.createDataFrame(
        [(c, n, m) for c, (n, m) in COMPOUNDS.items()], "compound string, num_dim string, den_dim string"
    )
    factors = u.compound_frame(u.unit_frame(spark), compounds)
    names = F.array(F.lit("pct_per_kPa"), F.lit("pct_per_lambda"), F.lit("pct_per_rpm"))
    part = table(spark, d, "part").select(
        "p_partkey", F.col("p_retailprice").alias("v"), names[F.col("p_size") % 3].alias("compound")
    )
    return part.join(F.broadcast(factors), "compound").select(
        "p_partkey", "label", F.round(F.col("v") * F.col("factor") / 1000, 3).alias("shown")
    )


@query(
    "unit_precedence",
    """WITH ch AS (SELECT p_partkey AS channel_id, list_extract(['temperature', 'pressure', 'speed', 'torque'], 1 + p_size % 4) AS dim,
      p_size, p_type FROM part),
  f AS (SELECT *, CASE WHEN p_type = 'ECONOMY' THEN CASE WHEN dim = 'temperature' THEN 'degR' ELSE 'psi' END END AS o,
      CASE WHEN dim = 'speed' THEN 'mph' END AS p,
      CASE dim WHEN 'temperature' THEN 'degC' WHEN 'pressure' THEN 'bar' WHEN 'speed' THEN 'km/h' END AS s,
      CASE dim WHEN 'temperature' THEN 'K' WHEN 'pressure' THEN 'kPa' WHEN 'speed' THEN 'km/h' ELSE 'Nm' END AS c FROM ch),
  g AS (SELECT *, CASE WHEN o = 'degR' OR (o = 'psi' AND dim = 'pressure') THEN o END AS ok FROM f)
  SELECT channel_id, dim, coalesce(ok, p, s, c) AS unit, CASE WHEN ok IS NOT NULL THEN 'override' WHEN p IS NOT NULL THEN 'profile'
    WHEN s IS NOT NULL THEN 'preset' ELSE 'canonical' END AS layer FROM g""",
)
def unit_precedence(spark, d):
    dims = F.array(*[F.lit(x) for x in ("temperature", "pressure", "speed", "torque")])
    part = table(spark, d, "part")
    channels = part.select(F.col("p_partkey").alias("channel_id"), dims[F.col("p_size") % 4].alias("dim"), "p_type")
    overrides = channels.filter("p_type = 'ECONOMY'").select(
        "channel_id", F.when(F.col("dim") == "temperature", "degR").otherwise("psi").alias("unit")
    )
    profile = spark.createDataFrame([("speed", "mph")], "dim string, unit string")
    preset = spark.createDataFrame(list(PRESETS["metrico"].items()), "dim string, unit string")
    return u.effective_unit(channels.drop("p_type"), overrides, profile, preset, u.unit_frame(spark))


@query(
    "conversion_parameter",
    """SELECT user_id AS log_id, round(quantile_cont(value, 0.5), 6) AS param,
    (max(value) - min(value)) / abs(quantile_cont(value, 0.5)) > 0.01 AS varies FROM events WHERE event_type = 'signup' GROUP BY 1""",
)
def conversion_parameter(spark, d):
    return u.conversion_parameter(samples(spark, d), "signup").withColumn("param", F.round("param", 6))


@query(
    "pressure_reference",
    """{S}, x AS (SELECT b.log_id, b.v AS pressure, CASE WHEN b.t_ms - w.t_ms <= 172800000 THEN w.v END AS speed
    FROM (SELECT * FROM s WHERE channel_id = 'view') b ASOF LEFT JOIN (SELECT log_id, t_ms, CASE WHEN v < 20 THEN 0.0 ELSE v END AS v
      FROM s WHERE channel_id = 'click') w ON b.log_id = w.log_id AND b.t_ms >= w.t_ms),
  m AS (SELECT log_id, quantile_cont(pressure, 0.5) AS measured FROM x WHERE speed = 0 GROUP BY log_id)
  SELECT log_id, round(coalesce(CASE WHEN log_id % 7 = 0 THEN 99.0 END, measured, 101.325), 6) AS reference_kpa,
    (log_id % 7 <> 0 AND measured IS NULL) AS estimated FROM (SELECT DISTINCT log_id FROM s) LEFT JOIN m USING (log_id)""",
)
def pressure_reference(spark, d):
    s = samples(spark, d).withColumn(
        "v", F.when((F.col("channel_id") == "click") & (F.col("v") < 20), 0.0).otherwise(F.col("v"))
    )
    logs = s.select("log_id").distinct()
    declared = F.when(F.col("log_id") % 7 == 0, 99.0)
    out = u.pressure_reference(logs, s, pressure="view", speed="click", window_ms=172_800_000, declared=declared)
    return out.withColumn("reference_kpa", F.round("reference_kpa", 6))


@query(
    "raw_scale",
    """WITH ch AS (SELECT p_partkey AS channel_id, p_type AS type, p_size AS raw FROM part)
  SELECT channel_id, CASE type WHEN 'ECONOMY' THEN 'pressure' WHEN 'SMALL' THEN 'temperature' ELSE 'unknown' END AS dim,
    CASE type WHEN 'ECONOMY' THEN 'confirmed' WHEN 'SMALL' THEN 'confirmed' WHEN 'LARGE' THEN 'unknown' ELSE 'unknown' END AS confidence,
    round(CASE type WHEN 'ECONOMY' THEN raw * 0.1::DOUBLE WHEN 'SMALL' THEN raw * 0.01::DOUBLE ELSE raw::DOUBLE END, 6) AS value,
    CASE WHEN type NOT IN ('ECONOMY', 'SMALL') THEN 'unknown_dimension' END AS reason FROM ch""",
)
def raw_scale(spark, d):
    types = spark.createDataFrame(
        [("ECONOMY", "pressure", 0.1, "confirmed"), ("SMALL", "temperature", 0.01, "confirmed"), ("LARGE", "unknown", 1.0, "unknown")],
        "type string, dim string, factor double, confidence string",
    )
    ch = table(spark, d, "part").select(
        F.col("p_partkey").alias("channel_id"), F.col("p_type").alias("type"), F.col("p_size").cast("double").alias("raw")
    )
    out = u.export_policy(u.scale_raw(ch, types))
    return out.select("channel_id", "dim", "confidence", F.round("value", 6).alias("value"), "reason")


KV = "(SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@query("bit_decode", f"SELECT event_id AS seq, b::INT AS bit, CAST((k >> b) & 1 AS INT) AS on_ FROM {KV}, range(0, 7) r(b)")
def bit_decode(spark, d):
    return bits.decode_bits(counters(spark, d), "k", 7).select("seq", "bit", F.col("on").alias("on_"))


@query(
    "bit_activity",
    f"SELECT user_id AS log_id, event_type AS channel_id, b::INT AS bit, max((k >> b) & 1) = 1 AS active FROM {KV}, range(0, 7) r(b) GROUP BY 1, 2, 3",
)
def bit_activity(spark, d):
    return bits.active_bits(counters(spark, d), ["log_id", "channel_id"], "k", 7)


@query(
    "bit_width",
    """SELECT p_partkey, CASE p_size WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 7 THEN 3 WHEN 15 THEN 4 WHEN 31 THEN 5 END AS bits FROM part""",
)
def bit_width(spark, d):
    return table(spark, d, "part").select("p_partkey", bits.bit_width(F.col("p_size")).alias("bits"))
