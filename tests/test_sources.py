"""File sources on small files written by the tests."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seriespan.sources import csv_probe as cp, csv_read as cr, declared_units as du, native as nat
from seriespan.sources import ranges
from seriespan.sources.lines import listing, read_lines
from seriespan.sources.listing import files_of, tree

HEAD = """%DataLog%
DataLogVersion : {version}
Software : Sim
DownloadDateTime : 20260729 06:59:00
Channel : RPM
ID : 384
Type : EngineSpeed
DisplayMaxMin : 20000,0
Channel : Coolant Temperature
ID : 229
Type : Temperature
Channel : Mystery
ID : 7
Type : Odd
DisplayMaxMin : x
Log Source : 2
Log Number : 2768
Log : 20260729 {stamp}
"""
BODY = """23:59:59.900,1000,3600,
23:59:59.950,1100,,5
00:00:00.000,2147483647,3610,6
00:00:00.050,1300
00:00:00.100,1400,3620,7,8,9
00:00:00.090,1500,,
"""


@pytest.fixture(scope="module")
def native_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("native")
    head = HEAD.format(version="1.1", stamp="11:59:58")
    (d / "good.csv").write_bytes((head + BODY).replace("\n", "\r\n").encode())
    (d / "bom.csv").write_bytes(b"\xef\xbb\xbf" + (head + BODY).rstrip("\n").encode())
    (d / "version.csv").write_text(HEAD.format(version="2.0", stamp="01:01:01") + BODY)
    (d / "cut.csv").write_text("\n".join(head.splitlines()[:-5]) + "\nChannel : Last\nID : 1\n")
    (d / "norows.csv").write_text(head)
    (d / "plain.csv").write_text("Time,RPM\n0.0,1\n0.1,2\n")
    (d / "empty.csv").write_text("")
    (d / "notes.xyz").write_text("hello")
    return str(d)


def by_name(rows):
    return {r["file"].rsplit("/", 1)[1]: r for r in rows}


def test_native_header(spark, native_dir):
    lines = read_lines(spark, native_dir)
    files, channels, metadata = nat.read_header(lines)
    status = {k: r.status for k, r in by_name(files.collect()).items()}
    assert status["good.csv"] == status["bom.csv"] == "ok"
    assert status["version.csv"] == "unsupported_version"
    assert status["cut.csv"] == "incomplete_channel"
    assert status["norows.csv"] == "no_rows"
    assert status["plain.csv"] == "not_native"
    good = channels.filter(F.col("file").endswith("/good.csv")).orderBy("pos").collect()
    assert [(c.name, c.native_id, c.dim, c.factor) for c in good] == [
        ("RPM", 384, "angular_speed", 1.0),
        ("Coolant Temperature", 229, "temperature", 0.1),
        ("Mystery", 7, "unknown", 1.0),
    ]
    assert (good[0].disp_min, good[0].disp_max) == (0, 20000)
    notices = nat.header_notices(channels).filter(F.col("file").endswith("/good.csv")).collect()
    assert sorted(n.code for n in notices) == ["invalid_display_range", "unknown_type"]
    meta = {r.key: r.value for r in metadata.filter(F.col("file").endswith("/good.csv")).collect()}
    assert meta["Log Number"] == "2768" and meta["Log"] == "20260729 11:59:58"


def test_native_rows_and_samples(spark, native_dir):
    lines = read_lines(spark, native_dir)
    files, channels, metadata = nat.read_header(lines.cache())
    rows = nat.read_rows(lines, files.cache())
    bad = nat.malformed_rows(rows).filter(F.col("file").endswith("/good.csv")).orderBy("row").collect()
    assert [(r.row, r.fields, r.expected) for r in bad] == [(3, 2, 4), (4, 6, 4)]
    rows, channels = rows.cache(), channels.cache()
    for size in (8192, 2, 1):
        s = nat.read_samples(rows, channels, rows_per_slice=size).filter(F.col("log_id").endswith("/good.csv"))
        rpm = s.filter("channel_id = '384'").orderBy("seq").collect()
        assert [(r.t_ms, r.raw) for r in rpm] == [(0, 1000), (50, 1100), (100, None), (150, 1300), (200, 1400), (190, 1500)]
        clt = s.filter("channel_id = '229'").orderBy("seq").collect()
        assert [(r.seq, round(r.v, 3)) for r in clt] == [(0, 360.0), (2, 361.0), (4, 362.0)]
    from seriespan.functions.clock import reconcile

    clocks = reconcile(nat.log_clocks(metadata, rows)).collect()
    row = by_name(clocks)["good.csv"]
    assert row.reliability == "reliable" and row.t0.isoformat() == "2026-07-29T23:59:59.900000"


def test_split_files_number_lines(spark, tmp_path):
    text = "\n".join(f"row {i}" for i in range(5000))
    (tmp_path / "big.csv").write_text(text)
    files = files_of(tree(spark, str(tmp_path)))
    scanned = ranges.scan(files, 4096)
    assert scanned.count() > 10
    rows = ranges.lines(files, scanned, 4096).collect()
    assert sorted((r.line, r.text) for r in rows) == [(i, f"row {i}") for i in range(5000)]


def test_format_triage(spark, native_dir):
    lines = read_lines(spark, native_dir)
    formats = nat.detect_format(lines, [nat.NativeFormat()])
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in nat.triage_paths(listing(spark, native_dir), formats).collect()}
    assert kinds["good.csv"] == kinds["bom.csv"] == "native"
    assert kinds["plain.csv"] == "generic" and kinds["empty.csv"] == "empty" and kinds["notes.xyz"] == "unrecognised"


@pytest.fixture(scope="module")
def csv_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("csv")

    def rows(fmt, n=30):
        return "\n".join(fmt(i) for i in range(n)) + "\n"

    (d / "plain.csv").write_text("Time,RPM,TPS\n" + rows(lambda i: f"{i * 0.05:.3f},{1000 + i},{i / 3:.2f}"))
    (d / "comma.csv").write_text("Time;RPM;TPS\n" + rows(lambda i: f"{i * 0.05:.3f};{1000 + i};{i / 3:.2f}".replace(".", ",")))
    (d / "tab.csv").write_text("Time\tRPM\n" + rows(lambda i: f"{i * 50 + 3.5}\t{1000 + i}"))
    (d / "units.csv").write_text("Time,RPM,MAP\ns,rpm,kPa\n" + rows(lambda i: f"{i * 0.05:.3f},{1000 + i},{i + 0.5}"))
    (d / "iso.csv").write_text("When,RPM\n" + rows(lambda i: f"2026-07-29T18:30:{i:02d}Z,{i}"))
    (d / "epoch.csv").write_text("T,RPM\n" + rows(lambda i: f"{1785000000000 + i * 50},{i % 7}"))
    (d / "clock.csv").write_text("Date,Clock,RPM\n" + rows(lambda i: f"2026-07-29,18:30:{i:02d}.500,{i % 7}"))
    (d / "preamble.csv").write_text(
        "vehicle: GT\nengine = 2000cc\nvehicle: GT2\n" + "Time,RPM,TPS\n" + rows(lambda i: f"{i * 0.05:.3f},{1000 + i},{i / 3:.2f}")
    )
    (d / "nohead.csv").write_text(rows(lambda i: f"{i * 0.05:.3f},{1000 + i},{i / 3:.2f}"))
    (d / "counter.csv").write_text("N,RPM\n" + rows(lambda i: f"{i},{(i * 7) % 11}"))
    (d / "notime.csv").write_text("RPM,MAP\n" + rows(lambda i: f"{(i * 7) % 11},{(i * 5) % 13}.5"))
    (d / "quoted.csv").write_text('Time,"Name, long",X,Y\n' + rows(lambda i: f'{i * 0.1:.1f},"a{", " * (i % 3)}b",{i},{i + 1}'))
    (d / "ragged.csv").write_text("Time,A,B\n" + rows(lambda i: f"{i * 0.1:.1f},1" if i == 5 else f"{i * 0.1:.1f},1,2,3" if i == 7 else f"{i * 0.1:.1f},1,2"))
    (d / "latin.csv").write_bytes(("Tiempo;Régimen\n" + rows(lambda i: f"{i}.5;{i}")).encode("latin-1"))
    return str(d)


@pytest.fixture(scope="module")
def probed(spark, csv_dir):
    lines = read_lines(spark, csv_dir)
    return lines, cp.Probe(lines.cache(), declared_hz=20.0)


def test_dialects(probed):
    _, p = probed
    got = {k: (r.delimiter, r.quote, r.fields) for k, r in by_name(p.dialects.collect()).items()}
    assert got["plain.csv"] == (",", None, 3)
    assert got["comma.csv"] == (";", None, 3)
    assert got["tab.csv"] == ("\t", None, 2)
    assert got["quoted.csv"] == (",", '"', 4)
    enc = {k: r.encoding for k, r in by_name(p.encodings.collect()).items()}
    assert enc["latin.csv"] == "latin-1" and enc["plain.csv"] == "utf-8"
    dec = {k: r.decimal for k, r in by_name(p.decimals.collect()).items()}
    assert dec["comma.csv"] == "," and dec["plain.csv"] == "."


def test_structure(probed):
    _, p = probed
    got = {k: (r.data_start, r.names_line, r.units_line) for k, r in by_name(p.structure.collect()).items()}
    assert got["plain.csv"] == (1, 0, None)
    assert got["units.csv"] == (2, 0, 1)
    assert got["preamble.csv"] == (4, 3, None)
    assert got["nohead.csv"] == (0, None, None)
    meta = {r.key: r.value for r in p.metadata.collect() if r.file.endswith("preamble.csv")}
    assert meta == {"vehicle": "GT2", "engine": "2000cc"}
    heads = {(r.file.rsplit("/", 1)[1], r.pos): (r.name, r.unit) for r in p.headers.collect()}
    assert heads[("units.csv", 2)] == ("MAP", "kPa") and heads[("latin.csv", 1)] == ("Régimen", None)
    assert heads[("quoted.csv", 1)] == ("Name, long", None)


def test_time_axis(probed):
    _, p = probed
    got = by_name(p.time.collect())
    assert got["plain.csv"]["class"] == "relative" and got["plain.csv"].factor == 1.0
    assert abs(got["plain.csv"].hz - 20.0) < 1e-6
    assert got["tab.csv"]["class"] == "relative" and got["tab.csv"].factor == 0.001
    assert got["iso.csv"]["class"] == "iso8601" and got["iso.csv"].t0_s == 1785349800.0
    assert got["epoch.csv"]["class"] == "epoch_ms" and got["epoch.csv"].t0_s == 1785000000.0
    assert got["clock.csv"]["class"] == "date_and_clock" and got["clock.csv"].t0_s == 1785349800.5
    assert got["counter.csv"]["class"] == "counter" and got["counter.csv"].step_s == 0.05
    assert got["notime.csv"]["class"] == "absent" and got["notime.csv"].notice == "synthetic_axis"


def test_read_block_and_series(spark, probed):
    lines, p = probed
    block = cr.read_block(cr.data_lines(lines, p.sample, p.structure), p.dialects, p.encodings)
    ragged = by_name(cr.ragged_rows(block).collect())
    assert (ragged["ragged.csv"].rows, ragged["ragged.csv"].short, ragged["ragged.csv"].long) == (30, 1, 1)
    series = cr.read_series(block, p.time, p.decimals)
    s = {(r.log_id.rsplit("/", 1)[1], r.channel_id, r.seq): (r.t_ms, r.v) for r in series.collect()}
    assert s[("comma.csv", "2", 3)] == (150, 1.0)
    assert s[("epoch.csv", "1", 10)] == (500, 3.0)
    assert s[("clock.csv", "2", 8)] == (8000, 1.0)
    assert s[("notime.csv", "1", 2)] == (100, 10.5)
    assert ("quoted.csv", "1", 0) not in s and s[("quoted.csv", "2", 4)] == (400, 4.0)


def test_declared_units(spark):
    heads = spark.createDataFrame(
        [("f", 0, "MAP [kPa]", None), ("f", 1, "CLT (°C)", "K"), ("f", 2, "Speed_kmh", None), ("f", 3, "X", "g"),
         ("f", 4, "Y (left)", "rpm"), ("f", 5, "Sensor_1", None), ("f", 6, "Z", "blah"), ("f", 7, "H", "Hz")],
        "file string, pos int, name string, unit string",
    )
    got = {r.pos: (r.clean_name, r.origin, r.dim, r.unit_id, r.notice) for r in du.resolve(heads).collect()}
    assert got[0] == ("MAP", "bracket", "pressure", "kPa", None)
    assert got[1] == ("CLT", "parenthesis", "temperature", "degC", "unit_declared_twice")
    assert got[2] == ("Speed", "suffix", "speed", "km/h", None)
    assert got[3][2:] == (None, None, "unit_ambiguous")
    assert got[4] == ("Y (left)", "unit_row", "angular_speed", "rpm", "name_unit_unresolved")
    assert got[5][1:] == ("none", None, None, None)
    assert got[6][4] == "unit_unresolved"
    assert got[7][2:4] == ("frequency", "Hz")


def test_ingest_native_end_to_end(spark, native_dir, tmp_path):
    from seriespan.plans.ingest import ingest_native

    tables = ingest_native(spark, native_dir, str(tmp_path / "out"))
    assert {r.status for r in tables["files"].collect()} >= {"ok", "no_rows", "not_native"}
    logs = [r.file for r in tables["files"].filter("status = 'ok'").collect()]
    one = [x for x in logs if x.endswith("/good.csv")]
    from seriespan.sources.store import read_samples

    picked = read_samples(spark, str(tmp_path / "out/samples"), logs=one)
    assert picked.select("log_id").distinct().count() == 1
    assert picked.count() == tables["samples"].filter(F.col("log_id").isin(one)).count() == 12
    codes = {(r.file.rsplit("/", 1)[1], r.code, r.notices) for r in tables["notices"].collect()}
    assert ("good.csv", "row_malformed", 2) in codes


def test_import_csv_end_to_end(spark, csv_dir, tmp_path):
    from seriespan.plans.ingest import import_csv

    t = import_csv(spark, csv_dir + "/units.csv", str(tmp_path / "out"))
    assert t["samples"].count() == 60
    assert {(r.pos, r.dim) for r in t["columns"].collect()} == {(0, "time"), (1, "angular_speed"), (2, "pressure")}


def test_rescan_reuses_and_recomputes(spark, native_dir):
    from seriespan.plans.ingest import scan_folder

    def summary(samples, files):
        return samples.groupBy(F.col("log_id").alias("path")).agg(F.max("v").alias("v_max"))

    schema = "path string, size bigint, mtime bigint, parser_version string, format_version string, status string, v_max double"
    first = scan_folder(spark, native_dir, spark.createDataFrame([], schema), summary, parser_version="1", format_version="1")
    rows = {r.path.rsplit("/", 1)[1]: r for r in first.collect()}
    assert rows["good.csv"].status == "ok" and rows["good.csv"].v_max == 1500.0
    assert rows["version.csv"].status == "unsupported_version" and rows["version.csv"].v_max is None
    stored = spark.createDataFrame([r for k, r in rows.items() if k != "bom.csv"], first.schema).withColumn(
        "v_max", F.when(F.col("status") == "ok", -1.0)
    )
    again = {r.path.rsplit("/", 1)[1]: r for r in scan_folder(spark, native_dir, stored, summary, parser_version="1", format_version="1").collect()}
    assert again["good.csv"].v_max == -1.0 and again["bom.csv"].v_max == 1500.0


@pytest.fixture(scope="module")
def broken_dir(tmp_path_factory):
    import gzip
    import random

    d = tmp_path_factory.mktemp("broken")
    r = random.Random(1)
    rows = "Time,RPM\n" + "".join(f"{i * 0.05:.2f},{r.randint(0, 9999)}\n" for i in range(4_000))
    head = HEAD.format(version="1.1", stamp="11:59:58")
    native = head + "".join(f"{i // 3600 % 24:02d}:{i // 60 % 60:02d}:{i % 60:02d}.000,{r.randint(0, 9999)},3600,1\n" for i in range(4_000))
    for name, text in (("rows", rows), ("native", native)):
        packed = gzip.compress(text.encode())
        (d / name).mkdir()
        (d / name / "whole [1].csv.gz").write_bytes(packed)
        (d / name / "cut{2}.csv.gz").write_bytes(packed[: len(packed) // 2])
        (d / name / "none.csv.gz").write_bytes(b"no archive")
    return str(d)


def test_lines_are_never_left_out_silently(spark, broken_dir):
    with pytest.raises(ValueError, match="2 files cannot be read to their end"):
        read_lines(spark, broken_dir + "/rows")
    assert read_lines(spark, broken_dir + "/rows/whole*").count() == 4_001


def test_broken_files_have_a_status_in_every_plan(spark, broken_dir, tmp_path):
    from seriespan.plans.ingest import import_csv, ingest_native, scan_folder

    expected = {"whole%20%5B1%5D.csv.gz": "ok", "cut%7B2%7D.csv.gz": "unreadable", "none.csv.gz": "unreadable"}
    t = ingest_native(spark, broken_dir + "/native", str(tmp_path / "native"))
    assert {k: r.status for k, r in by_name(t["files"].collect()).items()} == expected
    assert t["samples"].select("log_id").distinct().count() == 1
    t = import_csv(spark, broken_dir + "/rows", str(tmp_path / "rows"))
    assert {k: r.reason or r.status for k, r in by_name(t["files"].collect()).items()} == expected
    assert t["samples"].count() == 4_000

    def summary(samples, files):
        return samples.groupBy(F.col("log_id").alias("path")).agg(F.count("v").alias("n"))

    schema = "path string, size bigint, mtime bigint, parser_version string, format_version string, status string, n bigint"
    rows = scan_folder(spark, broken_dir + "/native", spark.createDataFrame([], schema), summary, parser_version="1", format_version="1").collect()
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.n is not None) for r in rows}
    assert got == {"whole [1].csv.gz": ("ok", True), "cut{2}.csv.gz": ("unreadable", False), "none.csv.gz": ("unreadable", False)}


def _probe_of(spark, texts):
    rows = [(name, i, t) for name, lines in texts.items() for i, t in enumerate(lines)]
    return cp.Probe(spark.createDataFrame(rows, "file string, line bigint, text string"))


def test_data_that_begins_late_is_found(spark):
    """The first lines are looked at first; files without data there are searched to their end."""
    n = cp.HEAD_LINES + 30
    rows = [f"{i};{i * 2}" for i in range(5)]
    p = _probe_of(spark, {"late": ["word;text"] * n + rows, "early": ["a;b", *rows], "never": ["word;text"] * n})
    got = {r.file: (r.data_start, r.columns) for r in p.structure.collect()}
    assert got == {"late": (n, 2), "early": (1, 2)}


def test_only_columns_that_can_be_an_axis_are_scanned_in_order(spark):
    n = 40
    texts = ["T;Up;Same;Noise;Day"] + [f"{(i * 7) % 11}.5;{i // 2};7;{(i * 5) % 13};2026-07-29" for i in range(n)]
    p = _probe_of(spark, {"f": texts, "flat": ["A;B"] + ["7;8"] * 5, "one": ["A;B", "1;2"]})
    rows = cp.data_rows(p.cells, p.structure).join(p.decimals.select("file", "decimal"), "file")
    got = {(r.file, r.col): (r["class"], r.step_s, r.first_text) for r in cp.time_classes(rows, ["file", "col"], F.col("decimal")).collect()}
    assert got[("f", 0)][0] is None and got[("f", 3)][0] is None
    assert got[("f", 1)][:2] == ("relative", 1.0) and got[("f", 2)][:2] == ("relative", None)
    assert got[("f", 4)] == (None, None, "2026-07-29")
    assert got[("flat", 0)][:2] == ("relative", None) and got[("one", 1)][:2] == ("relative", None)


def test_runs_of_equal_counts_are_joined_over_lines_left_out(spark):
    """Only lines that count otherwise than the line before are kept; runs of each try are as over all lines."""
    texts = ["a,b;c", "1,2;3", "1,2;3", '"1,5";2', "3;4", "1,2;3", "1,2;3", "1,2;3"]
    p = _probe_of(spark, {"f": texts})
    got = {(r.delimiter, r.quote): (r.run, r.start, r.fields) for r in cp.delimiter_scores(p.sample).collect()}
    assert got[(";", None)] == (8, 0, 2) and got[(";", '"')] == (8, 0, 2)
    assert got[(",", None)] == (4, 0, 2) and got[(",", '"')] == (3, 0, 2)
    assert got[("\t", None)] == (8, 0, 1) and ("|", "'") not in got


def test_series_of_a_file_whose_first_rows_have_no_instant(spark):
    n = cp.HEAD_LINES + 10
    block = spark.createDataFrame(
        [("late", i, 2, 2, ["x" if i < n else str(i), "5"]) for i in range(n + 3)] + [("plain", i, 2, 2, [str(i), "5"]) for i in range(3)],
        "file string, seq bigint, fields int, columns int, cells array<string>",
    )
    time = spark.createDataFrame([(f, "relative", 0, None, 1.0, None) for f in ("late", "plain")], "file string, class string, col int, date_col int, factor double, hz double")
    decimal = spark.createDataFrame([("late", "."), ("plain", ".")], "file string, decimal string")
    got = {(r.log_id, r.seq): (r.t_ms, r.v) for r in cr.read_series(block, time, decimal).collect()}
    assert got == {("late", n): (0, 5.0), ("late", n + 1): (1000, 5.0), ("late", n + 2): (2000, 5.0), ("plain", 0): (0, 5.0), ("plain", 1): (1000, 5.0), ("plain", 2): (2000, 5.0)}
