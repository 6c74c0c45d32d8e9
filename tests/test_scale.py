"""Steps that must not grow faster than their input: passes, tasks, broadcasts, entries of the disk."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from seriespan.functions import cells as c
from seriespan.operators import ordered
from seriespan.sources import csv_probe as cp, csv_read as cr, listing, ranges, stores
from seriespan.sources.lines import split_fields


def _files(spark, n: int, rows: int):
    body = spark.range(n * rows).select(
        F.concat(F.lit("/f/"), F.col("id") % n).alias("file"), (F.floor(F.col("id") / n) + 1).alias("line"),
        F.concat_ws(";", (F.floor(F.col("id") / n) * 0.5).cast("string"), F.lit("1.5"), (F.col("id") % 7).cast("string")).alias("text"),
    )
    head = spark.range(n).select(F.concat(F.lit("/f/"), "id").alias("file"), F.lit(0).cast("bigint").alias("line"), F.lit("T;A;B").alias("text"))
    return head.unionByName(body)


def _spy(monkeypatch, module) -> list:
    """What a module settles, in order."""
    seen, settle = [], module.settle
    monkeypatch.setattr(module, "settle", lambda df: seen.append(df) or settle(df))
    return seen


def test_large_frames_are_dealt_to_more_tasks(spark, monkeypatch):
    rows = spark.range(100).select((F.col("id") % 20).alias("log_id"), F.col("id").alias("t_ms"), F.col("id").alias("seq"))
    monkeypatch.setattr(ordered, "ROWS_A_TASK", 10)
    got = ordered.scan(ordered.attach_splits(rows, ordered.LOG_TIME), ordered.LOG_TIME, total={"n": F.lit(1)})
    assert got.rdd.getNumPartitions() == 10
    assert got.groupBy("log_id").agg(F.max("n").alias("n")).where("n <> 5").isEmpty()


def test_lines_known_are_not_counted_again(spark, tmp_path):
    """Reading the lines is counted by a file per task that runs."""

    def seen(batches):
        for b in batches:
            (tmp_path / os.urandom(8).hex()).write_bytes(b"")
            yield b

    lines = _files(spark, 2, 5).coalesce(1).mapInArrow(seen, "file string, line bigint, text string")
    counted = spark.createDataFrame([("/f/0", 6), ("/f/1", 6)], "file string, lines bigint")
    got = cp.sample_lines(lines, counted=counted).orderBy("file", "line").collect()
    assert len(list(tmp_path.iterdir())) == 1
    assert [(r.k, r._new) for r in got] == [(0, True), (1, False), (2, False), (3, False), (4, False), (5, False)] * 2


def test_no_join_of_the_structure_sends_the_whole_sample(spark, monkeypatch):
    seen = _spy(monkeypatch, cp)
    p = cp.Probe(_files(spark, 3, 200))
    assert {(r.data_start, r.columns, r.names_line) for r in p.structure.collect()} == {(1, 3, 0)}
    near = [df for df in seen if "is_meta" in df.columns and "k" in df.columns]
    assert [df.count() for df in near] == [3]


def test_where_data_begins_is_settled(spark, monkeypatch):
    p = cp.Probe(_files(spark, 3, 200))
    p.structure
    seen = _spy(monkeypatch, cr)
    rows = cr.data_lines(p.rows, p.sample, p.structure)
    assert rows.count() == 600
    assert [df.columns for df in seen] == [["file", "_from", "columns"]]


def test_ranges_are_not_joined_with_ranges(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a.csv")
    stores.write_file(path, [b'"a\nb";1\n' * 500, b"c;2\n" * 500])
    files = spark.createDataFrame([(path, path, os.path.getsize(path))], "path string, file string, size bigint")
    scanned = ranges.scan(files, 64)
    seen = _spy(monkeypatch, ranges)
    got = ranges.lines(files, scanned, 64)
    assert [r.line for r in got.orderBy("line").collect()] == list(range(1000))
    plan = seen[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


def test_files_of_one_size_share_an_entry_of_the_disk(tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST_LINKS", 4)
    holes = stores.Holes()
    paths = [tmp_path / f"{i % 3}" / f"{i}" for i in range(20)]
    for again in range(2):
        for i, p in enumerate(paths):
            holes.write(f"file:{p}", i % 2 + 5 * again)
    assert [p.stat().st_size for p in paths] == [i % 2 + 5 for i in range(20)]
    assert len({p.stat().st_ino for p in paths}) <= 6
    for name, size in (("a", 7), ("a", 3), ("b", 7), ("c", 3)):  # a name written twice
        holes.write(f"file:{tmp_path}/{name}", size)
    assert [(tmp_path / n).stat().st_size for n in "abc"] == [3, 7, 3]


def test_values_and_votes_of_usual_and_odd_cells(spark):
    odd = ["1", "+1.5", "-2,5", "1.234", "0.234", "1,234.5", "1.234.567", "1e3", "1,5e3", "3 bar", "", " 7 ", "x", "12:30", "1\n", "2147483647", "1.", ".5", None]
    cells = spark.createDataFrame([(s, x) for s in (".", ",") for x in odd], "decimal string, cell string")
    got = cells.select("decimal", "cell", c.value_under(F.col("cell"), F.col("decimal")).alias("v"))
    want = cells.select("decimal", "cell", F.when(F.col("decimal") == ",", c.cell_value(F.col("cell"), ",")).otherwise(c.cell_value(F.col("cell"), ".")).alias("v"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    x = F.col("cell")
    shape, dot, comma = c.number_shape(x), c.is_numeric(x, "."), c.is_numeric(x, ",")
    want = cells.where("decimal = '.'").groupBy("cell").agg(
        F.count_if(dot & ~comma).alias("only_dot"), F.count_if(comma & ~dot).alias("only_comma"), F.count_if(shape == "three_digits").alias("three_digits")
    )
    got = c.vote_decimal(cells.where("decimal = '.'"), ["cell"]).select("cell", "only_dot", "only_comma", "three_digits")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_texts_are_written_by_stretches(spark, tmp_path):
    """Files in several encodings, with one kind of line end or two, plain and packed."""
    import gzip

    from seriespan.registry import files

    kinds = [("a", "utf-16-le", "\n", None), ("b", "utf-8-sig", "\r", "gzip"), ("c", "utf-32-be", "\r\n", None), ("d", "utf-8", None, None)]
    rows = [(n, i, f"é{i};1", codec, end or "\n\r"[i % 2], how) for n, codec, end, how in kinds for i in range(50)]
    texts = spark.createDataFrame(rows, "name string, line long, text string, codec string, end string, damage string")
    batch = texts.where("name <> 'd'").coalesce(1).toArrow().combine_chunks().to_batches()[0]
    assert [(name, codec, damage) for name, codec, damage, _ in files._pieces(batch)] == [(n, codec, how) for n, codec, _, how in kinds[:3]]
    files.write_texts(texts, f"file:{tmp_path}")
    for n, codec, _, how in kinds:
        got = (tmp_path / n).read_bytes()
        want = files.MARKS.get(codec, b"") + "".join(f"{r[2]}{r[4]}" for r in rows if r[0] == n).encode(codec.removesuffix("-sig"))
        assert (gzip.decompress(got) if how else got) == want


def test_types_are_told_without_sorting_values(spark, monkeypatch):
    rows = [("f", 0, x) for x in ("Yes", "no", "", "YES")] + [("f", 1, x) for x in ("yes", "no", "maybe")] + [("f", 2, x) for x in ("7", " 7", "")]
    rows += [("f", 3, x) for x in ("SÍ", "no")] + [("f", 4, x) for x in ("1", "2.5")] + [(None, 5, "k"), (None, 5, "k"), ("f", 6, ""), ("f", 7, "no"), ("f", 7, "1")]
    df = spark.createDataFrame(rows, "file string, col int, cell string")
    seen = _spy(monkeypatch, c)
    got = {r.col: (r.file, r.type, r.constant_value, r.distinct) for r in c.infer_types(df, ["file", "col"], ".").collect()}
    assert got == {
        0: ("f", "boolean", None, 3), 1: ("f", "text_enum", None, 3), 2: ("f", "constant", "7", 1), 3: ("f", "boolean", None, 2),
        4: ("f", "decimal", None, 2), 5: (None, "constant", "k", 1), 6: ("f", "empty", None, 0), 7: ("f", "text_enum", None, 2),
    }
    assert "SortAggregate" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_what_is_known_of_a_file_meets_its_lines(spark):
    """The data block's cells as before, with no join above the split of the lines."""
    p = cp.Probe(_files(spark, 3, 20).unionByName(spark.createDataFrame([("/f/0", 30, "9,5;2,5"), ("/f/1", 31, "10;1;2;3;4")], "file string, line bigint, text string")))
    old = cp.data_rows(p.cells, p.structure).join(p.decimals.select("file", "decimal"), "file")
    names = ["file", "k", "col", "cell", "delimiter", "fields", "data_start", "columns", "decimal"]
    rows = lambda df: sorted(map(repr, df.select(*names).collect()))
    assert rows(p.data) == rows(old) and len(rows(p.data)) == 3 * 60 + 2 + 3
    plan = p.data._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Generate") < plan.index("Join")
    assert p.decoding is None


def test_lines_behind_all_starts_are_left_before_any_join(spark):
    lines = spark.range(10).select(F.lit("f").alias("file"), F.col("id").alias("k"))
    found = spark.createDataFrame([("f", 2), ("g", 4)], "file string, data_start long")
    assert cp.lines_until(lines, found).count() == 5
    assert cp.lines_until(lines, found.limit(0)).count() == 0


def test_status_reads_no_line_of_files_that_are_counted(spark, tmp_path):
    def seen(batches):
        for b in batches:
            (tmp_path / os.urandom(8).hex()).write_bytes(b"")
            yield b

    lines = _files(spark, 2, 5).coalesce(1).mapInArrow(seen, "file string, line bigint, text string")
    p = cp.Probe(lines, counted=spark.createDataFrame([("/f/0", 6), ("/f/1", 6)], "file string, lines bigint"))
    assert sorted((r.file, r.status) for r in p.status.collect()) == [("/f/0", "ok"), ("/f/1", "ok")]
    assert len(list(tmp_path.iterdir())) == 1


def test_lines_are_cut_once(spark):
    lines = spark.createDataFrame([("/f/a", 0, "T;Note;A;B")] + [("/f/a", i, f'{i}.5;"x;{i % 2}";{i};7') for i in range(1, 30)], "file string, line bigint, text string")
    p = cp.Probe(lines)
    block = cr.read_block(cr.data_lines(p.rows, p.sample, p.structure), p.dialects, p.encodings)
    for df in (p.cells, p.data):
        assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert block.where("seq = 1").first().cells == ["2.5", "x;0", "2", "7"]
    other = p.dialects.withColumn("delimiter", F.lit(","))  # by other signs they are cut anew
    assert cr.read_block(cr.data_lines(p.rows, p.sample, p.structure), other).where("seq = 1").first().cells == ['2.5;"x;0";2;7', None, None, None]


def test_quoted_fields(spark):
    cases = [
        ('a;"b;c";d', '"', ["a", "b;c", "d"]), ('"a""b";"";c', '"', ['a"b', "", "c"]), ('"a\\";b";c', '"', ['a\\";b'.replace("\\", ""), "c"]),
        ('a;"b;c', '"', ["a", '"b', "c"]), ('x"y;z"w;q', '"', ['x"y;z"w', "q"]), (' "a;b" ;c', '"', ["a;b", "c"]), ("'a\n;b';'", "'", ["a\n;b", "'"]),
        ('a;";";b', '"', ["a", ";", "b"]), ("a;b", '"', ["a", "b"]), ('"";";"', '"', ["", ";"]), ("", '"', [""]),
    ]
    rows = spark.createDataFrame([(i, text, quote) for i, (text, quote, _) in enumerate(cases)], "i int, text string, quote string")
    got = {r.i: r.f for r in rows.select("i", split_fields(F.col("text"), F.lit(";"), F.col("quote")).alias("f")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_labels_of_a_file_meet_its_lines(spark, monkeypatch):
    rows = [(f, 0, "T;A;B;C;D;L;M") for f in ("/f/a", "/f/b")]
    rows += [("/f/a", i, f"{i}.5;1;2;3;4;{'xyz'[i % 3]};{'on' if i % 2 else 'off'}") for i in range(1, 20)]
    rows += [("/f/b", i, f"{i}.5;1;2;3;4;w{i};{'uv'[i % 2]}") for i in range(1, 20)]
    lines = spark.createDataFrame(rows, "file string, line bigint, text string")

    def read():
        p = cp.Probe(lines)
        block = cr.read_block(cr.data_lines(p.rows, p.sample, p.structure), p.dialects)
        return sorted(map(tuple, cr.read_channels(block, p.time, p.decimals, p.types)[0].collect()))

    looked_up = []
    real = cr.to_codes
    monkeypatch.setattr(cr, "to_codes", lambda cells, *more: looked_up.append({r.file for r in cells.select("file").distinct().collect()}) or real(cells, *more))
    packed = read()
    assert not looked_up and len(packed) == 228
    monkeypatch.setattr(cr, "PACKED_LABELS", 10)
    assert read() == packed and looked_up == [{"/f/b"}]


def test_keys_are_counted_without_their_order(spark):
    dear = spark.range(10).select((F.col("id") % 2).alias("log_id"), F.raise_error(F.lit("computed")).cast("bigint").alias("t_ms"), F.col("id").alias("seq"))
    assert ordered.attach_splits(dear, ordered.LOG_TIME).columns == ["log_id", "t_ms", "seq"]


def test_small_ranges_share_a_batch(tmp_path):
    path = str(tmp_path / "a.csv")
    stores.write_file(path, [b"".join(b"%d\n" % (i % 10) for i in range(100))])
    blank = {"path": path, "file": "f", "plain": False, "bytes": 200, "quoting": None, "entry": 0}
    parts = [{**blank, "start": 20 * i, "stop": 20 * i + 20 if i < 9 else None, "shift": 10 * i} for i in range(10)]
    got = list(ranges._read(iter([pa.RecordBatch.from_pylist(parts)])))
    assert len(got) == 1
    assert got[0].to_pylist() == [{"file": "f", "bytes": 200, "line": i, "text": b"%d" % (i % 10)} for i in range(100)]


def test_a_few_folders_are_listed_by_several_tasks(spark, tmp_path, monkeypatch):
    for i in range(16):
        stores.write_file(f"{tmp_path}/{i}/a.csv", [b"1\n"])
    seen = _spy(monkeypatch, listing)
    found = listing.tree(spark, str(tmp_path))
    assert found.where("kind = 'file'").count() == 16
    dealt = [df.rdd.getNumPartitions() for df in seen if {"root", "kind"} <= set(df.columns)]
    assert max(dealt) == min(16, spark.sparkContext.defaultParallelism) > 1


def test_only_links_are_resolved_and_a_folder_comes_in_pieces(tmp_path, monkeypatch):
    for i in range(10):
        stores.write_file(f"{tmp_path}/a/{i}", [b"x" * i])
    (tmp_path / "a" / "link").symlink_to(tmp_path / "a" / "3")
    (tmp_path / "a" / "broken").symlink_to(tmp_path / "nowhere")
    (tmp_path / "a" / "below").mkdir()
    os.mkfifo(tmp_path / "a" / "pipe")
    (tmp_path / "a" / ".hidden").write_text("")
    folder = f"file:{os.path.realpath(tmp_path)}/a"
    store, name = stores.locate(folder)
    want = sorted((i.base_name, *stores._shown(i)) for i in store.get_file_info(pafs.FileSelector(name)) if not i.base_name.startswith("."))
    assert sorted(stores.children(folder)) == want
    asked, real = [], stores.resolved
    monkeypatch.setattr(stores, "resolved", lambda path: asked.append(path) or real(path))
    monkeypatch.setattr(listing, "PIECE", 4)
    got = list(listing._expand(iter([pa.RecordBatch.from_pylist([{"root": "r", "path": folder}, {"root": "r", "path": f"{folder}/none"}])])))
    assert [b.num_rows for b in got] == [4, 4, 4, 1, 1]
    rows = {(r["path"].rsplit("/", 1)[1], r["kind"], r["size"]) for b in got for r in b.to_pylist()}
    assert {(f"{i}", "file", i) for i in range(10)} | {("3", "file", 3), ("below", "folder", 0), ("pipe", "other", 0), ("none", "unreadable_folder", 0)} == rows
    assert len(asked) == 3  # two folders and a link


def test_columns_that_are_no_axis_are_not_read_to_their_end(spark, monkeypatch):
    """Two axes that later lines rule out, a date behind text, and a file without any axis."""
    monkeypatch.setattr(cp, "HEAD_LINES", 4)
    row = {
        "a": lambda i: f"{i if i < 30 else 0};{i}.5;{i % 3};1", "b": lambda i: f"{i % 2};x;2026-01-0{1 + i % 9};0{i % 10}:00:0{i % 10}",
        "c": lambda i: f"{i % 3};{-i}.5;{i % 2};{7 - i}",
    }
    lines = spark.createDataFrame([(f, 0, "A;B;C;D") for f in row] + [(f, i, row[f](i)) for f in row for i in range(1, 40)], "file string, line bigint, text string")
    read, real = [], cp.time_column
    monkeypatch.setattr(cp, "time_column", lambda data, *more, **named: read.append(data) or real(data, *more, **named))
    p = cp.Probe(lines)
    got = sorted(map(repr, p.time.collect()))
    assert got == sorted(map(repr, real(p.data, p.decimals, p.headers).collect()))
    assert {(r.file, r["class"], r.col, r.date_col) for r in p.time.collect()} == {("a", "relative", 1, None), ("b", "date_and_clock", 3, 2), ("c", "absent", None, None)}
    assert {(r.file, r.col) for r in read[0].select("file", "col").distinct().collect()} == {("a", 0), ("a", 1), ("a", 3), ("b", 2), ("b", 3)}


def test_lines_are_counted_without_their_text(spark):
    dear = spark.range(20).select(F.concat(F.lit("f"), F.col("id") % 2).alias("file"), F.col("id").alias("line"), F.raise_error(F.lit("computed")).alias("text"))
    assert cp.sample_lines(dear).columns == ["file", "line", "text", "k", "_new"]
