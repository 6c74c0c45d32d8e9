"""Units, cells, clocks, roll-ups, meshes and analyses on small frames."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from seriespan.catalog.units import UNITS, canonical_unit
from seriespan.functions import cells, clock, curves, formulas, names, units
from seriespan.operators import boost, gears, identity, mesh, phases, plausibility, quality, rollup
from seriespan.operators.ordered import LOG_TIME, attach_splits


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "x,dim,unit,cls,want",
    [
        (373.15, "temperature", "degC", "point", 100.0),
        (10.0, "temperature", "degC", "interval", 10.0),
        (10.0, "temperature", "degF", "interval", 18.0),
        (4.0, "temperature", "degF", "variance", 12.96),
        (250.0, "pressure", "bar", "point", 2.5),
        (10.0, "fuel_economy", "km/L", "point", 10.0),
        (5.0, "fuel_economy", "mpg_us", "point", 47.04291666),
        (1.0, "mixture_ratio", "afr", "point", 14.7),
    ],
)
def test_known_conversions(spark, x, dim, unit, cls, want):
    assert math.isclose(value(spark, units.from_canonical(F.lit(x), dim, unit, cls)), want, rel_tol=1e-9)


def test_every_unit_round_trips(spark):
    columns = []
    for dim, unit, *_ in UNITS:
        there = units.from_canonical(F.lit(3.7), dim, unit)
        columns.append(units.to_canonical(there, dim, unit).alias(f"{dim}|{unit}"))
    row = spark.range(1).select(*columns).first().asDict()
    assert all(math.isclose(v, 3.7, rel_tol=1e-9) for v in row.values())
    assert canonical_unit("pressure") == "kPa"


def test_conversion_rejects(spark):
    with pytest.raises(ValueError):
        units.from_canonical(F.lit(1.0), "fuel_economy", "km/L", "interval")
    with pytest.raises(ValueError):
        units.from_canonical(F.lit(1.0), "temperature", "degC", reference=101.0)
    with pytest.raises(KeyError):
        units.from_canonical(F.lit(1.0), "speed", "K")
    gauge = units.from_canonical(F.lit(201.325), "pressure", "bar", reference=101.325)
    assert math.isclose(value(spark, gauge), 1.0)
    assert value(spark, units.from_canonical(F.lit(0.0), "fuel_economy", "km/L")) is None
    factor, label = units.compound_factor(("ratio", "pct"), ("pressure", "bar"))
    assert factor == 100.0 / 0.01 and label == "pct/bar"


def test_min_max_propagate_null(spark):
    assert value(spark, formulas.smallest(F.lit(1.0), F.lit(None).cast("double"))) is None
    assert value(spark, formulas.largest(F.lit(1.0), F.lit(2.0))) == 2.0
    assert value(spark, formulas.lambda_error(F.lit(1.0), F.lit(0.0))) is None


def test_curve_is_clamped(spark):
    c = lambda x: value(spark, curves.interpolated(F.lit(x), [(0, 0), (10, 100), (20, 0)]))
    assert [c(-5.0), c(5.0), c(15.0), c(50.0)] == [0.0, 50.0, 50.0, 0.0]
    assert value(spark, curves.linear_limit(F.lit(2000.0), 201.3, 100.0, 1000.0)) == 401.3


def test_cells(spark):
    rows = [("3,2 bar",), ("1.234,5",), (" 850 ",), ("#N/A",), ("",), ("8388607",), ("x1",), ("1 234,5",), ("0.050",), (None,)]
    df = spark.createDataFrame(rows, "c string")
    c = F.col("c")
    got = df.select(cells.cell_value(c, ",").alias("v"), cells.unit_text(c, ",").alias("u"), cells.cell_kind(c).alias("k")).collect()
    assert [r.v for r in got] == [3.2, 1234.5, 850.0, None, None, None, None, 1234.5, None, None]
    assert got[0].u == "bar" and [r.k for r in got[3:6]] == ["sentinel", "empty", "overflow"]
    shapes = ["12", "1.234.567", "1.234,56", "217,300", "0,050", "1234,567", "abc", ""]
    s = spark.createDataFrame([(x,) for x in shapes], "c string").select(cells.number_shape(c).alias("s"))
    assert [r.s for r in s.collect()] == ["integer", "grouped", "both", "three_digits", "decimal", "decimal", "text", "empty"]


NUMBER_CELLS = [
    # cell, number under ',', under '.', number part and unit under ','
    ("12", True, True, "12", None), ("-0,5", True, False, "-0,5", None), ("+3.25", False, True, None, None), ("", True, True, None, None),
    ("1.234", True, True, "1.234", None), ("0.234", False, True, None, None), ("1234.567", False, True, None, None),
    ("1.234.567,8", True, False, "1.234.567,8", None), ("1.23.567", False, False, None, None), ("1,2,3", False, False, None, None),
    ("6e3", True, True, "6e3", None), ("6,5E-3", True, False, "6,5E-3", None), ("6e", False, False, "6", "e"), ("e6", False, False, None, None),
    ("6e3,2", False, False, None, None), ("6e3 m", False, False, "6e3", "m"), ("6 e3", False, False, "6", "e3"), ("6e3e3", False, False, "6e3", "e3"),
    ("1 234,5 bar", False, False, "1 234,5", "bar"), ("1 23 bar", False, False, None, None), ("850rpm", False, False, "850", "rpm"),
    ("12 %", False, False, "12", "%"), ("3\tkm/h", False, False, "3", "km/h"), ("7 m2", False, False, "7", "m2"), ("7 2m", False, False, None, None),
    ("7 m!", False, False, None, None), ("5.", False, False, None, None), (",5", False, False, None, None), ("-", False, False, None, None),
    ("+", False, False, None, None), ("--5", False, False, None, None), ("5-", False, False, None, None), ("5 -", False, False, None, None),
    ("012", True, True, "012", None), ("bar", False, False, None, None), ("é", False, False, None, None), ("9" * 5000, True, True, "9" * 5000, None),
    (None, None, None, None, None),
]


def test_numbers_piece_by_piece(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(NUMBER_CELLS)], "i int, c string")
    c = F.col("c")
    got = df.select("i", "c", cells.is_numeric(c, ","), cells.is_numeric(c, "."), cells.number_text(c, ","), cells.unit_text(c, ","))
    assert [tuple(r)[1:] for r in got.orderBy("i").collect()] == NUMBER_CELLS


def test_presentation_names(spark):
    heads = ["RPM", "RPM", "", "RPM_2", "RPM"]
    df = spark.createDataFrame([("f", i, n) for i, n in enumerate(heads)], "file string, pos int, name string")
    got = [r.display for r in cells.presentation_names(df, ["file"]).orderBy("pos").collect()]
    assert got == ["RPM", "RPM_2", "col_3", "RPM_2_2", "RPM_3"]


def test_enum_codes_and_limits(spark):
    rows = [("a", x) for x in ("Idle", "Run", "idle", "#N/A", "Run")] + [("b", x) for x in ("Off", "ON")] + [("c", f"v{i}") for i in range(600)]
    frame = spark.createDataFrame(rows, "col string, cell string")
    assert cells.enum_dictionary(frame, ["col"]).filter("col = 'c'").count() == 600
    d = cells.enum_dictionary(frame, ["col"], limit=512)
    got = {(r.col, r.label): r.code for r in d.collect()}
    assert got == {("a", "Idle"): 0, ("a", "Run"): 1, ("a", "idle"): 2, ("b", "Off"): 0, ("b", "ON"): 1}


def test_accents_and_fuzzy_roles(spark):
    rows = spark.createDataFrame([("Régimen",), ("Engine Sped",), ("EGT 3",), ("zzz",)], "name string")
    roles = spark.createDataFrame(
        [(0, "engine_speed", ["RPM", "Regimen", "Engine Speed"]), (1, "exhaust_temp", ["EGT {n}"])],
        "ord int, role string, synonyms array<string>",
    )
    got = {r.name: (r.role, r.confidence, r["index"]) for r in names.assign_roles(rows, roles).collect()}
    assert got == {
        "Régimen": ("engine_speed", "exact", None),
        "Engine Sped": ("engine_speed", "fuzzy", None),
        "EGT 3": ("exhaust_temp", "indexed", 3),
    }


def test_clock_reconciliation(spark):
    rows = [
        ("a", "20260729 06:59:00", 68340.0),  # the header clock runs on 12 hours
        ("b", "20260729 23:59:50", 5.0),  # first row after midnight
        ("c", "19800101 01:01:01", 3661.0),
        ("d", "20260729 10:00:00", 40000.0),
        ("e", "bad", 1.0),
        ("f", None, 1.0),
    ]
    df = spark.createDataFrame(rows, "id string, started string, first_row_s double").withColumns(
        {"downloaded": F.lit(None).cast("string"), "log_number": F.lit("5")}
    )
    got = {r.id: r for r in clock.reconcile(df).collect()}
    assert [got[k].reliability for k in "abcdef"] == ["reliable", "reliable", "unknown", "unreliable", "unknown", "unknown"]
    assert got["a"].t0.isoformat() == "2026-07-29T18:59:00" and got["b"].t0.isoformat() == "2026-07-30T00:00:05"
    assert got["b"].notices == ["header_before_midnight"] and got["c"].notices == ["factory_epoch"]
    assert got["e"].notices == ["clock_metadata_unreadable"] and got["f"].notices == ["clock_without_metadata"]


def test_rollup_extremes_equal_raw(spark):
    rows = [(1, "a", i, i * 10, float((i * 37) % 101)) for i in range(70)]
    df = spark.createDataFrame(rows, "log_id int, channel_id string, seq bigint, t_ms bigint, v double")
    for frame in (df, attach_splits(df, LOG_TIME, target_rows=9)):
        got = {(r.level, r.bucket): r for r in rollup.continuous(frame, 3, LOG_TIME).collect()}
        assert {lvl: sum(1 for k in got if k[0] == lvl) for lvl in (1, 2, 3)} == {1: 17, 2: 4, 3: 1}
        vs = [r[4] for r in rows]
        top = got[(3, 0)]
        assert (top.v_min, top.v_max, top.v_first, top.v_last) == (min(vs[:64]), max(vs[:64]), vs[0], vs[63])


def test_enum_rollup_is_hierarchical(spark):
    # the block modes are a, b, b, b although a is the most frequent value overall
    states = "aaaa" + "abba" + "bbaa" + "bbab"
    modes = ["a", "a", "b", "b"]
    rows = [(1, i, i, s) for i, s in enumerate(states)]
    df = spark.createDataFrame(rows, "log_id int, seq bigint, t_ms bigint, s string")
    got = rollup.enum(df, 2, LOG_TIME, "s").orderBy("level", "bucket").collect()
    assert [r["mode"] for r in got] == [*modes, "a"]
    assert [r.changed for r in got] == [False, True, True, True, True]


def test_mesh_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (1.999,), (-0.1,), (2.1,), (None,)], "x double")
    got = [r.i for r in df.select(mesh.bin_index(F.col("x"), [0, 1, 2]).alias("i")).collect()]
    assert got == [0, 1, 1, 1, None, None, None]
    assert mesh.default_edges(df, F.col("x"), 2)[-1] == 2.1
    with pytest.raises(ValueError):
        mesh.check_edges([1, 1])


def test_coverage_counts_every_sample(spark):
    import random

    rnd = random.Random(5)
    rows = [(1, i, i * 50, rnd.choice([None, 0.0, 300.0, 900.0, 2500.0]), rnd.choice([None, 0.0, 0.3, 0.9])) for i in range(300)]
    df = spark.createDataFrame(rows, "log_id int, seq bigint, t_ms bigint, rpm double, tps double")
    lim = phases.PhaseLimits(min_s={p: 0.1 for p in phases.PHASES}, min_samples=1)
    judged = phases.phase_conditions(df, "rpm", "tps", lim)
    c = phases.coverage(judged, "rpm", lim).first().asDict()
    n = c.pop("n")
    c.pop("log_id")
    assert n == 300 == sum(c.values())


def test_phases_without_throttle(spark):
    rows = [(1, i, i * 100, 200.0, None) for i in range(10)]
    df = spark.createDataFrame(rows, "log_id int, seq bigint, t_ms bigint, rpm double, tps double")
    lim = phases.PhaseLimits()
    judged = phases.phase_conditions(df, "rpm", "tps", lim, F.lit(False))
    assert [(r.phase, r.n) for r in phases.phases(judged, "rpm", lim).collect()] == [("start", 10)]


def test_gears_merge_close_peaks(spark):
    ratios = [5.0] * 40 + [5.3] * 40 + [9.0] * 60 + [20.0] * 5
    rows = [(1, i, 2000.0, r * 2.0) for i, r in enumerate(ratios)] + [(1, 900, 500.0, 5.0), (1, 901, None, 5.0)]
    df = spark.createDataFrame(rows, "log_id int, seq bigint, rpm double, speed double")
    found, summary, samples = gears.detect_gears(df, "rpm", "speed", gears.GearLimits())
    got = found.orderBy("gear").collect()
    assert [(r.gear, round(r.ratio, 2), r.n) for r in got] == [(1, 5.1, 80), (2, 8.9, 60)]
    s = summary.first()
    assert (s.n, s.no_data, s.useful, s.stopped, s.between) == (147, 1, 145, 1, 5)
    assert samples.groupBy("gear").count().filter("gear = 0").first()["count"] == 7


def test_step_response(spark):
    target = [100.0] * 5 + [150.0] * 40 + [120.0] * 10
    actual = [100.0] * 5 + [100.0, 120.0, 160.0, 152.0] + [150.0] * 36 + [140.0] * 10
    rows = [(1, i, i * 100, a, t) for i, (a, t) in enumerate(zip(actual, target))]
    df = spark.createDataFrame(rows, "log_id int, seq bigint, t_ms bigint, act double, tgt double")
    lim = boost.StepLimits()
    for frame in (df, attach_splits(df, LOG_TIME, target_rows=6)):
        got = boost.step_responses(frame, "act", "tgt", lim).orderBy("step").collect()
        assert [r.verdict for r in got] == ["measured", "fall"]
        r = got[0]
        assert (r.t_start, r.t_end, r.target_before, r.target_new, r.peak, r.overshoot) == (500, 4400, 100.0, 150.0, 160.0, 10.0)
        assert r.settling_s == 0.3 and round(r.steady_error, 6) == round(2 / 37, 6) and r.steady_samples == 37


def test_plausibility_ladder(spark):
    lim = plausibility.PlausibilityLimits(min_samples=3)
    data = {
        "celsius": [90.0, 80.0, 85.0, 95.0], "afr": [14.7, 13.2, 12.5, 15.0], "flipped": [-0.5, -0.2, -0.9, -0.1],
        "fine": [0.1, 0.2, 0.3, 0.4], "few": [0.1], "odd": [1e9, -1e9, 5e8, 1.0], "none": [None, None], "loose": [1.0, 2.0, 3.0],
        "gauge": [-30.0, 120.0, -60.0, -20.0],
    }
    rows = [(1, c, v) for c, vs in data.items() for v in vs]
    s = spark.createDataFrame(rows, "log_id int, channel_id string, v double")
    ch = spark.createDataFrame([(1, c, None if c == "loose" else c, "exact", None) for c in data], "log_id int, channel_id string, role string, confidence string, dim string")
    roles = spark.createDataFrame(
        [("celsius", "temperature", 300.0, 423.15, True), ("afr", "mixture_ratio", 0.4, 1.6, True), ("flipped", "ratio", 0.0, 1.0, False),
         ("fine", "ratio", 0.0, 1.0, False), ("few", "ratio", 0.0, 1.0, False), ("odd", "ratio", 0.0, 1.0, False), ("none", "ratio", 0.0, 1.0, True),
         ("gauge", "pressure", 0.0, 600.0, False)],
        "role string, role_dim string, lo double, hi double, critical boolean",
    )
    got = {r.channel_id: (r.diagnosis, r.severity, r.likely_unit) for r in plausibility.evaluate(s, ch, roles, lim).collect()}
    assert got["celsius"] == ("wrong_unit", "critica", "degC")
    assert got["afr"] == ("afr_for_lambda", "critica", "afr")
    assert got["flipped"][0] == "inverted_sign" and got["fine"][0] == "plausible" and got["few"][0] == "few_samples"
    assert got["odd"][0] == "unexplained" and got["none"][:2] == ("no_data", "media") and got["loose"][0] == "no_role"
    assert got["gauge"][0] == "gauge_without_reference"


def test_identity_consumes_layers(spark):
    ch = spark.createDataFrame(
        [(1, "a", "rpm", None, None, None, "x"), (2, "b", "rpm", None, "f", "9", "x"), (2, "c", "rpm", None, "f", "9", "y"),
         (3, "d", None, None, "f", "9", "y"), (4, "e", None, None, None, None, "y"), (5, "z", None, None, None, None, "")],
        "log_id int, channel_id string, role string, role_index int, format string, native_id string, name_key string",
    )
    got = {(r.log_id, r.channel_id): r.group_id for r in identity.match_channels(ch).collect()}
    assert got == {(1, "a"): "role:rpm", (2, "b"): "role:rpm", (2, "c"): "native:f:9", (3, "d"): "native:f:9", (4, "e"): "name:y"}


def test_sampling_groups(spark):
    rows = [(1, c, s) for c, seqs in {"a": [0, 2, 4], "b": [0, 2, 4], "c": [0, 1, 5]}.items() for s in seqs]
    got = quality.sampling_groups(spark.createDataFrame(rows, "log_id int, channel_id string, seq bigint")).collect()
    assert sorted(tuple(r.channels) for r in got) == [("a", "b"), ("c",)]


def test_gaps_and_jumps(spark):
    t = [0, 50, 100, 400, 450, 440, 490]
    rows = [(1, "a", i, x, 1.0) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "log_id int, channel_id string, seq bigint, t_ms bigint, v double")
    g = quality.gaps(df).collect()
    assert [(r.t_start, r.t_end, r.duration_ms, r.factor) for r in g] == [(100, 400, 300, 6.0)]
    j = quality.clock_jumps(df).collect()
    assert [(r.t_start, r.t_end, r.dt) for r in j] == [(450, 440, -10)]


def test_store_round_trip(spark, tmp_path):
    from seriespan.sources import store

    rows = [(i % 3, f"c{i % 2}", i, i * 10, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "log_id bigint, channel_id string, seq bigint, t_ms bigint, v double")
    store.write_samples(df, str(tmp_path / "s"))
    back = store.read_samples(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(rows)
    assert store.read_samples(spark, str(tmp_path / "s"), logs=[1]).count() == 20
    plan = store.read_samples(spark, str(tmp_path / "s"), logs=[1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "log_bucket" in plan
    store.write_rollup(rollup.continuous(df, 2), str(tmp_path / "r"), "continuous")
    assert store.read_rollup(spark, str(tmp_path / "r"), "continuous", 1).count() == 12
    wide = store.wide(df, {"c0": {"name": "CLT", "dimension": "temperature", "unit": "degC"}}, ("log_id", "seq"))
    store.export_parquet(wide, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).schema["CLT"].metadata["unit"] == "degC"
    store.export_csv(wide, str(tmp_path / "csv"))
    assert "CLT [degC]" in spark.read.option("header", True).csv(str(tmp_path / "csv")).columns


def test_dictionaries_of_any_size_give_the_same_codes(spark, monkeypatch):
    from seriespan.functions import cells

    rows = [(f"f{i % 2}", i % 3, None if i % 17 == 0 else f" label {i * 7919 % 300} " if i % 3 else ["on", "off"][i % 2]) for i in range(2000)]
    df = spark.createDataFrame(rows, "file string, col int, cell string")
    got = []
    for ranked, broadcast in ((1 << 20, 1 << 20), (5, 1 << 20), (5, 0), (1 << 20, 0)):
        monkeypatch.setattr(cells, "RANKED_ROWS", ranked)
        monkeypatch.setattr(cells.ranked, "__defaults__", (ranked,))
        monkeypatch.setattr(cells, "BROADCAST_ROWS", broadcast)
        dictionary = cells.enum_dictionary(df, ["file", "col"])
        coded = cells.to_codes(df, dictionary, ["file", "col"])
        back = cells.decode(coded, dictionary, ["file", "col"])
        assert coded.columns == [*df.columns, "code"]
        got.append((sorted(dictionary.collect()), sorted(map(repr, back.collect()))))
    assert all(g == got[0] for g in got) and len(got[0][1]) == 2000
    by_column = {}
    for r in got[0][0]:
        by_column.setdefault((r.file, r.col), []).append((r.label, r.code))
    for (_, c), pairs in by_column.items():
        if c:
            assert [n for _, n in sorted(pairs)] == list(range(len(pairs)))


def test_configurations_of_any_size(spark):
    from seriespan.operators.config import with_each

    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    config = spark.createDataFrame([(i, f"c{i}") for i in range(95)], "k int, c string").repartition(3)
    whole = sorted(with_each(df, config).collect())
    assert whole == sorted((x, y, i, f"c{i}") for x, y in ((1, "a"), (2, "b")) for i in range(95))
    assert sorted(with_each(df, config, 10).collect()) == whole and with_each(df, config.limit(0), 10).count() == 0


def test_manual_pairs_one_after_the_other(spark):
    """Against the pairs taken in order, each with the channels that kept pairs before it left."""
    import random

    from seriespan.operators import identity

    for seed in range(4):
        r = random.Random(seed)
        channels = [(log, f"c{c}", r.choice([None, "rpm", "map"])) for log in "abcd" for c in range(4)]
        manual = [(o, f"p{o}", r.choice("abcd"), f"c{r.randint(0, 5)}") for o in range(14) for _ in range(r.randint(1, 4))]
        free, members, notices = {(x, c): y for x, c, y in channels}, {}, set()
        for o in range(14):
            got = set()
            for _, p, log, c in sorted(set(m for m in manual if m[0] == o)):
                if (log, c) in free:
                    got.add((log, c))
                else:
                    notices.add(("manual_not_applicable", p, log, c))
            if len({log for log, _ in got}) < 2:
                if any(m[0] == o for m in manual):
                    notices.add(("manual_dropped", f"p{o}", None, None))
                continue
            members[f"p{o}"] = got
            if len({free[g] for g in got} - {None}) > 1:
                notices.add(("manual_contradicts_role", f"p{o}", None, None))
            for g in got:
                del free[g]
        ch = spark.createDataFrame(channels, "log_id string, channel_id string, role string")
        man = spark.createDataFrame(manual, "ord int, pair string, log_id string, channel_id string")
        layer = {(x.group_id.removeprefix("manual:"), x.log_id, x.channel_id) for x in identity.manual_layer(ch, man).collect()}
        assert layer == {(p, *g) for p, gs in members.items() for g in gs}
        assert {tuple(x) for x in identity.manual_notices(ch, man).collect()} == notices
    assert identity.manual_notices(ch, man.limit(0)).count() == 0


def test_imports_meet_only_where_a_column_is_shared(spark):
    from seriespan.operators import profiles

    files = [("f1", ",", "u", "p"), ("f2", ",", "u", "x"), ("f3", ";", "u", "p"), ("f4", ",", "u", "p"), ("f5", None, "u", "p")]
    current = [
        ("f1", "a", "A", "c1"), ("f1", "b", "B", "c2"), ("f2", "a", "A", "c3"), ("f2", "a", "A2", "c4"), ("f2", "z", "Z", "c5"),
        ("f2", None, "?", "c6"), ("f3", "a", "A", "c7"), ("f5", "a", "A", "c8"),
    ]
    profile = [("P", ",", "u", "p"), ("Q", ",", "u", "q"), ("R", ",", "u", "p")]
    saved = [
        ("P", "a", "A", "s1", "confirmed"), ("P", "b", "B", "s2", "guessed"), ("Q", "a", "A", "s3", "confirmed"),
        ("Q", "a", "A", "s4", "guessed"), ("Q", None, "?", "s5", "confirmed"),
    ]
    frames = (
        spark.createDataFrame(saved, "profile string, key string, name string, decision string, origin string"),
        spark.createDataFrame(current, "file string, key string, name string, decision string"),
        spark.createDataFrame(files, "file string, delimiter string, encoding string, fingerprint string"),
        spark.createDataFrame(profile, "profile string, delimiter string, encoding string, fingerprint string"),
    )
    columns, outcome = (x.collect() for x in profiles.reapply_import(*frames))
    assert len(outcome) == len(files) * len(profile)
    by_pair = {(r.file, r.profile): tuple(r)[2:] for r in outcome}
    assert by_pair["f1", "P"] == ("total", 2, 0, 0) and by_pair["f2", "P"] == ("partial", 2, 2, 1)
    assert by_pair["f2", "Q"] == ("partial", 4, 2, 1) and by_pair["f3", "P"] == ("none", 1, 0, 1)
    assert by_pair["f4", "P"] == ("none", 0, 0, 2) and by_pair["f4", "R"] == ("none", None, None, None)
    assert by_pair["f5", "P"][0] == "none"
    decided = {(r.file, r.profile, r.key, r.name): (r.state, r.decision) for r in columns if r.profile == "P"}
    assert decided["f1", "P", "a", "A"] == ("matched", "s1") and decided["f1", "P", "b", "B"] == ("matched", "c2")
    assert decided["f2", "P", None, "?"] == ("new", "c6") and decided["f3", "P", "a", "A"] == ("matched", "c7")
    some_columns, some = (x.collect() for x in profiles.find_imports(*frames))
    wanted = {(r.file, r.profile) for r in outcome if r.outcome != "none"}
    assert wanted == {("f1", "P"), ("f1", "Q"), ("f2", "P"), ("f2", "Q")}
    order = lambda rows: sorted(map(repr, rows))
    assert order(some) == order(r for r in outcome if r.outcome != "none")
    assert order(some_columns) == order(r for r in columns if (r.file, r.profile) in wanted)
    nothing = [f.limit(0) for f in frames]
    assert all(x.isEmpty() for x in (*profiles.reapply_import(*nothing), *profiles.find_imports(*nothing)))


def test_a_row_s_own_decimal_sign_is_read_by_one_expression(spark):
    df = spark.createDataFrame([(t, d) for t in [r[0] for r in NUMBER_CELLS] for d in (".", ",")], "c string, d string")
    c, d = F.col("c"), F.col("d")
    own = F.when(d == ",", cells.cell_value(c, ",")).otherwise(cells.cell_value(c, "."))
    got = df.select(own.alias("own"), cells.value_under(c, d).alias("v"), cells.is_numeric(cells.pointed(c, d), ".").alias("n"),
                    F.when(d == ",", cells.is_numeric(c, ",")).otherwise(cells.is_numeric(c, ".")).alias("m")).collect()
    assert all((r.own, r.m) == (r.v, r.n) for r in got)


def test_votes_and_types_sort_only_what_they_must(spark):
    """Aggregates of texts have all rows sorted; a vote keeps numbers and types are told in one pass for both signs."""
    df = spark.createDataFrame([("a", 0, "1,5", ","), ("a", 0, "2,5", ","), ("b", 0, "1.5", "."), ("b", 0, "1.5", ".")], "file string, col int, cell string, d string")
    vote = cells.vote_decimal(df, ["file"], delimiter=F.lit(";"))
    assert "SortAggregate" not in vote._jdf.queryExecution().executedPlan().toString()
    assert {(r.file, r.decimal) for r in vote.collect()} == {("a", ","), ("b", ".")}
    types = cells.infer_types(df, ["file", "col"], F.col("d"))
    assert {(r.file, r.type, r.constant_value) for r in types.collect()} == {("a", "decimal", None), ("b", "constant", "1.5")}
