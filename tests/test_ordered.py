"""Ordered operators: chunked plans equal plain ones, both equal simple loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from seriespan.operators import events as ev, windows as win
from seriespan.operators.align import hold_onto
from seriespan.operators.conditions import Band, Threshold, first_true, judge
from seriespan.operators.ordered import LOG_TIME, SPLIT, Axis, attach_splits, runs, scan
from seriespan.operators.quantiles import quantiles

SCHEMA = "log_id bigint, channel_id string, seq bigint, t_ms bigint, v double"


def make_series(seed: int, logs: dict[int, int], gap_share: float = 0.15, step: int = 20) -> list[tuple]:
    rnd = random.Random(seed)
    rows = []
    for log, n in logs.items():
        t = rnd.randrange(1000)
        for i in range(n):
            t += rnd.choice([0, 1, 1, 2, 5]) * step
            v = None if rnd.random() < gap_share else round(rnd.random() * 100, 2)
            rows.append((log, rnd.choice("ab"), i, t, v))
    return rows


LOGS = {1: 400, 2: 3, 3: 60, 4: 1}  # one log holds most rows


@pytest.fixture(scope="module")
def data(spark):
    rows = make_series(7, LOGS)
    return rows, spark.createDataFrame(rows, SCHEMA).cache()


def both(df, axis=LOG_TIME):
    plain = attach_splits(df, axis)
    assert SPLIT not in plain.columns
    split = attach_splits(df, axis, target_rows=25)
    assert SPLIT in split.columns
    return plain, split


def rows_of(df, drop=(SPLIT,)):
    return sorted((tuple(r) for r in df.drop(*drop).collect()), key=repr)


def per_log(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_only_oversized_keys_are_split(data):
    _, df = data
    split = attach_splits(df, LOG_TIME, target_rows=100)
    got = {r.log_id for r in split.filter(F.col(SPLIT).isNotNull()).select("log_id").distinct().collect()}
    assert got == {1}


def test_scan_matches_loop(data):
    rows, df = data
    want = []
    for log, series in per_log(rows).items():
        held, total, prev = None, 0, None
        for i, r in enumerate(series):
            held = r[4] if r[4] is not None else held
            total += 1
            want.append((log, r[2], held, None if i == 0 else prev, total))
            prev = r[4]
    for frame in both(df):
        got = scan(
            frame, LOG_TIME, hold={"h": F.col("v")}, prev={"p": F.col("v")}, total={"n": F.lit(1).cast("bigint")}
        ).select("log_id", "seq", "h", "p", "n")
        assert rows_of(got) == sorted(want, key=repr)


def hysteresis_loop(series, enter, leave):
    state, out = False, []
    for r in series:
        if r[4] is None:
            out.append(None)
            continue
        if r[4] >= enter:
            state = True
        elif r[4] <= leave:
            state = False
        out.append(state)
    return out


def runs_loop(series, cond):
    out, i = [], 0
    while i < len(series):
        if cond[i] is True:
            j = i
            while j + 1 < len(series) and cond[j + 1] is True:
                j += 1
            vs = [series[k][4] for k in range(i, j + 1) if series[k][4] is not None]
            out.append((series[i][3], series[j][3], j - i + 1, max(vs) if vs else None, series[i][4], series[j][4]))
            i = j + 1
        else:
            i += 1
    return out


def test_hysteresis_and_events_match_loop(data):
    rows, df = data
    want_c, want_e = [], []
    for log, series in per_log(rows).items():
        cond = hysteresis_loop(series, 60, 30)
        want_c += [(log, r[2], c) for r, c in zip(series, cond)]
        want_e += [(log, *e) for e in runs_loop(series, cond)]
    for frame in both(df):
        j = judge(frame, LOG_TIME, {"c": Threshold(F.col("v"), 60.0, 30.0)})
        assert rows_of(j.select("log_id", "seq", "c")) == sorted(want_c, key=repr)
        e = ev.events(
            j, LOG_TIME, F.col("c"),
            aggregates={"peak": ("max", F.col("v")), "a": ("first", F.col("v")), "b": ("last", F.col("v"))},
        ).select("log_id", "t_start", "t_end", "n", "peak", "a", "b")
        assert rows_of(e) == sorted(want_e, key=repr)


def test_one_run_over_many_slices(spark):
    rows = [(1, "a", i, i * 10, 90.0) for i in range(500)]
    df = attach_splits(spark.createDataFrame(rows, SCHEMA), LOG_TIME, target_rows=20)
    got = ev.events(df, LOG_TIME, F.col("v") > 50).collect()
    assert [(r.t_start, r.t_end, r.n) for r in got] == [(0, 4990, 500)]


def test_runs_break_at_empty_slices(spark):
    times = [0, 10, 20, 5000, 5010, 9000]
    rows = [(1, "a", i, t, 1.0 if t != 5010 else 0.0) for i, t in enumerate(times)]
    df = attach_splits(spark.createDataFrame(rows, SCHEMA), LOG_TIME, target_rows=1)
    got = sorted((r.t_start, r.t_end, r.n) for r in ev.events(df, LOG_TIME, F.col("v") > 0.5).collect())
    assert got == [(0, 5000, 4), (9000, 9000, 1)]


def test_band_equals_two_thresholds(data):
    _, df = data
    for frame in both(df):
        j = judge(
            frame, LOG_TIME,
            {
                "band": Band(F.col("v"), 20.0, 60.0, 0.1),
                "low": Threshold(F.col("v"), 20.0, 16.0),
                "high": Threshold(F.col("v"), 60.0, 64.0, rising=False),
            },
        )
        assert j.filter(~F.col("band").eqNullSafe(F.col("low") & F.col("high"))).count() == 0


def window_loop(series, lo, hi, fn):
    t0, t1 = series[0][3], series[-1][3]
    out = []
    for r in series:
        vs = [s[4] for s in series if r[3] + lo <= s[3] <= r[3] + hi and s[4] is not None]
        ok = r[4] is not None and r[3] + lo >= t0 and r[3] + hi <= t1 and vs
        out.append(fn(vs) if ok else None)
    return out


@pytest.mark.parametrize("lo,hi", [(-200, 200), (-500, 0), (0, 300), (100, 400), (-3000, 3000)])
def test_window_extreme_matches_loop(data, lo, hi):
    rows, df = data
    want = [(log, r[2], x) for log, s in per_log(rows).items() for r, x in zip(s, window_loop(s, lo, hi, max))]
    for frame in both(df):
        got = win.window_extreme(frame, LOG_TIME, F.col("v"), lo, hi, "max", "x").select("log_id", "seq", "x")
        assert rows_of(got) == sorted(want, key=repr)


def test_derivative_matches_loop(data):
    rows, df = data
    want = []
    for log, s in per_log(rows).items():
        for r in s:
            first = next(x for x in s if x[3] >= r[3] - 300)
            dt = (r[3] - first[3]) / 1000
            ok = dt > 0 and r[4] is not None and first[4] is not None
            want.append((log, r[2], round((r[4] - first[4]) / dt, 6) if ok else None))
    for frame in both(df):
        got = win.derivative(frame, LOG_TIME, F.col("v"), 300, "d").select("log_id", "seq", F.round("d", 6).alias("d"))
        assert rows_of(got) == sorted(want, key=repr)


def test_hold_asof_matches_loop(data):
    rows, df = data
    want = []
    for log, s in per_log(rows).items():
        for r in s:
            if r[1] != "a":
                continue
            src = [x for x in s if x[1] == "b" and x[3] <= r[3]]
            last = max(src, key=lambda x: (x[3], x[2])) if src else None
            want.append((log, r[2], last[4] if last and r[3] - last[3] <= 100 else None))
    for frame in both(df):
        got = hold_onto(frame, F.col("channel_id") == "a", {"b": F.col("channel_id") == "b"}, 100)
        assert rows_of(got.select("log_id", "seq", "b")) == sorted(want, key=repr)


def test_plateau_peaks(spark):
    vs = [0, 0, 5, 5, 0, 0, 3, 0, 0, 0]
    rows = [(1, "a", i, i * 100, float(v)) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, SCHEMA)
    for frame in (df, attach_splits(df, LOG_TIME, target_rows=2)):
        got = win.local_peak(frame, LOG_TIME, F.col("v"), 2.0, 400, "p").orderBy("seq").collect()
        assert [r.p for r in got] == [None, None, True, True, False, False, True, False, None, None]


def test_crossings_ignore_unknown(spark):
    states = [True, None, False, True, True, False]
    rows = [(1, i, i * 10, s) for i, s in enumerate(states)]
    df = spark.createDataFrame(rows, "log_id bigint, seq bigint, t_ms bigint, c boolean")
    assert ev.crossings(df, LOG_TIME, F.col("c")).first().crossings == 2


def test_precedence_keeps_unknown(spark):
    df = spark.createDataFrame([(True, True), (None, True), (False, True), (False, None)], "a boolean, b boolean")
    ex = first_true({"a": F.col("a"), "b": F.col("b")})
    got = [(r.x, r.y) for r in df.select(ex["a"].alias("x"), ex["b"].alias("y")).collect()]
    assert got == [(True, False), (None, None), (False, True), (False, None)]


def test_event_cap_is_reported(spark):
    rows = [(1, "a", i, i * 10, float(i % 2)) for i in range(10)]
    found = ev.events(spark.createDataFrame(rows, SCHEMA), LOG_TIME, F.col("v") > 0.5)
    assert ev.over_event_cap(found, ["log_id"], 5).count() == 0
    assert [(r.log_id, r.events) for r in ev.over_event_cap(found, ["log_id"], 4).collect()] == [(1, 5)]


def test_state_lanes(data):
    rows, df = data
    want = []
    for log, s in per_log(rows).items():
        i = 0
        while i < len(s):
            j = i
            while j + 1 < len(s) and s[j + 1][1] == s[i][1]:
                j += 1
            want.append((log, s[i][1], s[i][3], s[j][3], j - i + 1))
            i = j + 1
    for frame in both(df):
        got = ev.state_lanes(frame, LOG_TIME, F.col("channel_id")).select("log_id", "state", "t_start", "t_end", "n")
        assert rows_of(got) == sorted(want, key=repr)


def test_runs_sum_and_extremes_merge(data):
    _, df = data
    plain, split = both(df)
    aggs = {"s": ("sum", F.lit(1)), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
    cond = F.coalesce(F.col("v") > 20, F.lit(False))
    assert rows_of(runs(plain, LOG_TIME, cond, aggs)) == rows_of(runs(split, LOG_TIME, cond, aggs))


def test_quantiles_exact_for_oversized_keys(spark):
    rnd = random.Random(3)
    rows = [(1, float(rnd.randrange(50)) + rnd.choice([0, 0.5])) for _ in range(997)] + [(2, 5.0), (2, 9.0), (3, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    probs = {"a": 0.01, "b": 0.37, "c": 0.5, "d": 0.99}
    plain = rows_of(quantiles(df, ["k"], "v", probs))
    split = rows_of(quantiles(df, ["k"], "v", probs, target_rows=40))
    assert [tuple(round(x, 9) for x in r) for r in plain] == [tuple(round(x, 9) for x in r) for r in split]
    assert [r[0] for r in plain] == [1, 2]


def test_axis_position_order():
    assert len(Axis(("k",), "t", ("a", "b")).position) == 3


@pytest.mark.parametrize("lo,hi", [(-50, 0), (-30, 30), (0, 40), (10, 25), (-40, -20), (0, 0)])
def test_plain_frames_and_running_halves_agree(spark, monkeypatch, lo, hi):
    import random

    from seriespan.operators import windows
    from seriespan.operators.ordered import LOG_TIME

    r = random.Random(lo * 100 + hi)
    rows = [(k, r.randint(0, 400), i, None if r.random() < 0.2 else float(r.randint(0, 9))) for k in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "log_id int, t_ms long, seq int, v double")
    wanted = {"a": ("min", F.col("v")), "b": ("max", F.col("v")), "c": ("sum", F.col("v")), "d": ("count", F.col("v"))}
    got = []
    for narrow in (10_000, -1):
        monkeypatch.setattr(windows, "NARROW", narrow)
        got.append(sorted(map(repr, windows.sliding(df, LOG_TIME, lo, hi, wanted).select("log_id", "t_ms", "seq", "v", "a", "b", "c", "d").collect())))
    assert got[0] == got[1] and len(got[0]) == 360
    assert windows.most_in_a_block(df.limit(0), LOG_TIME, 10) == 0


def test_selected_quantiles(spark, monkeypatch):
    import numpy as np

    from seriespan.operators import quantiles as q

    r = np.random.default_rng(4)
    columns = {
        "same": np.full(300, 3.5), "two": np.where(np.arange(301) % 2, -1.0, 1e-300), "wide": r.standard_normal(500) * 10.0 ** r.integers(-300, 300, 500),
        "close": 1e9 + r.standard_normal(700) * 1e-6, "whole": r.integers(-5, 6, 900).astype(float), "zeros": np.array([0.0, -0.0, 5e-324, -5e-324] * 60),
        "ends": np.array([np.inf, -np.inf, 0.0, 1.0] * 50), "skew": r.exponential(1, 2000) ** 9,
    }
    rows = [(k, float(v)) for k, vs in columns.items() for v in vs] + [(None, float(v)) for v in range(400)] + [("small", 1.0), ("small", 2.0), ("small", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    plain = {x.k: x for x in q.quantiles(df, ["k"], "v", probs).collect()}
    for exact in (1 << 20, 40, 1):
        monkeypatch.setattr(q.selected, "__defaults__", (exact,))
        got = {x.k: x for x in q.quantiles(df, ["k"], "v", probs, 10).collect()}
        assert set(got) == set(plain)
        for k in plain:
            for name in probs:
                x, y = got[k][name], plain[k][name]
                assert x == y or (np.isnan(x) and np.isnan(y)) or abs(x - y) <= 1e-12 * abs(y), (exact, k, name, x, y)
    assert q.quantiles(df.limit(0), ["k"], "v", probs, 10).count() == 0


@pytest.mark.parametrize("block,direct", [(4, 1 << 30), (16, 1 << 30), (4096, 0), (7, 0)])
def test_lags_by_blocks(spark, monkeypatch, block, direct):
    import numpy as np

    from seriespan.operators import axes

    monkeypatch.setattr(axes, "DIRECT", direct)
    r = random.Random(9)
    logs = {k: {i: r.random() + (i % 7) for i in range(80) if r.random() < 0.8} for k in range(3)}
    logs[3] = {i: 2.5 for i in range(40)}  # no variance: no correlation
    rows = [(k, "a", i, i * 10 + r.randint(0, 9), v) for k, vs in logs.items() for i, v in vs.items()] + [(0, "b", 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "log_id int, channel_id string, seq long, t_ms long, v double")
    pairs = spark.createDataFrame([("x", 0, 1), ("y", 2, 1), ("z", 0, 3), ("n", 0, 99)], "pair_id string, log_a int, log_b int")
    grids = {}
    for k in logs:
        own = [(t, v) for x, c, _, t, v in rows if x == k and c == "a"]
        t0, cells = min(t for t, _ in own), {}
        for t, v in own:
            cells.setdefault((t - t0) // 10, []).append(v)
        grids[k] = {b: float(np.mean(v)) for b, v in cells.items()}

    def brute(lags, a, b):
        out = {}
        for lag in lags:
            both = [(v, grids[b][i - lag]) for i, v in grids[a].items() if i - lag in grids[b]]
            if len(both) >= 5 and np.std([x for x, _ in both]) > 0 and np.std([y for _, y in both]) > 0:
                out[lag] = (float(np.corrcoef(np.array(both).T)[0, 1]), len(both))
        return out

    def same(scored, lags):
        got = {}
        for x in scored.collect():
            got.setdefault(x.pair_id, {})[x.lag] = (x.r, x.overlap)
        for pair, (a, b) in {"x": (0, 1), "y": (2, 1)}.items():
            want = brute(lags[pair], a, b)
            assert set(got[pair]) == set(want)
            assert all(abs(got[pair][k][0] - want[k][0]) < 1e-9 and got[pair][k][1] == want[k][1] for k in want)
        assert set(got) == {"x", "y"}

    every = range(-6, 7)
    same(axes.lag_scores(df, pairs, "a", 10, 6, 5, block=block), {"x": every, "y": every})
    centres = spark.createDataFrame([("x", 20), ("y", -11), ("z", 0)], "pair_id string, centre long")
    same(axes.lag_scores(df, pairs, "a", 10, 3, 5, centres, block), {"x": range(17, 24), "y": range(-14, -7)})
    assert axes.lag_scores(df.limit(0), pairs, "a", 10, 6).count() == 0
