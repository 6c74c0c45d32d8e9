"""Real files: texts and folders that Spark writes from the tables and reads back."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import Axis, attach_splits, scan
from ..plans.ingest import counted_lines, import_csv, read_folder, scan_status
from ..plans.views import samples, table
from ..session import settle, shared_folder
from ..sources import csv_probe as cp, csv_read as cr, export, listing, native as nat, ranges, stores
from ..sources.lines import read_lines, split_fields
from ..sources.manifest import Store
from . import query
from .ingest import ROWS, csv_lines, native_lines

# Byte-order marks that a writer puts first.
CODECS = ["utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"]
MARKS = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff", "utf-32-le": b"\xff\xfe\x00\x00", "utf-32-be": b"\x00\x00\xfe\xff", "utf-8-sig": b"\xef\xbb\xbf"}
ENDS = ["\n", "\r\n", "\r"]
#: Ranges far smaller than in production, so that files of the test tables have many.
SMALL_RANGE = 1 << 16


def fresh(spark: SparkSession, name: str) -> str:
    return stores.qualified(spark, f"{shared_folder(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}")


def one_of(values: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), number.cast("int"))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[str, str, str, bytes]]:
    """``name, codec, damage`` of each stretch of a file's lines that share them and their line end, and its bytes.

    Lines are joined and encoded by stretches; a file with ends of several kinds has stretches of a line.
    """
    keys = [batch.column(c) for c in ("name", "codec", "end", "damage")]
    n = batch.num_rows
    new = np.zeros(n, bool)
    for key in keys:
        code = pc.fill_null(key.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    new[:1] = True
    at = np.flatnonzero(new)
    texts = [str(t) for t in batch.column("text").to_pylist()] if batch.column("text").null_count else batch.column("text").to_pylist()
    for first, stop, name, codec, end, damage in zip(at, [*at[1:], n], *[k.take(pa.array(at)).to_pylist() for k in keys]):
        yield name, codec, damage, f"{end}".join([*texts[first:stop], ""]).encode(codec.removesuffix("-sig"))


def write_texts(texts: DataFrame, folder: str) -> None:
    """Write ``texts(name, line, text, codec, end, damage)`` as files, a task streaming one file after the other.

    ``damage`` is null, gzip (packed), cut (packed and cut in half), none (empty) or noise (no archive
    under an archive's name).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, packer, how = None, [], None, None

        def close() -> None:
            if name is None:
                return
            data = parts + ([packer.flush()] if packer else [])
            if how == "cut":
                whole = b"".join(data)
                data = [whole[: len(whole) // 2]]
            stores.write_file(f"{folder}/{name}", {"none": [], "noise": [b"no archive"]}.get(how, data))

        files = 0
        for batch in batches:
            for piece_name, codec, damage, piece in _pieces(batch):
                if piece_name != name:
                    close()
                    name, parts, how, files = piece_name, [], damage, files + 1
                    packer = zlib.compressobj(wbits=31) if how in ("gzip", "cut") else None
                    piece = MARKS.get(codec, b"") + piece
                parts.append(packer.compress(piece) if packer else piece)
        close()
        yield pa.RecordBatch.from_pydict({"files": [files]})

    texts.repartition("name").sortWithinPartitions("name", "line").mapInArrow(run, "files long").agg(F.sum("files")).collect()


def name_of(file: Column) -> Column:
    return F.substring_index(file, "/", -1)


def _native_files(spark: SparkSession, d: str) -> str:
    """One native log per user, in six encodings and four kinds of line ends."""
    folder = fresh(spark, "texts")
    lines = native_lines(spark, d)
    user = F.regexp_extract("file", r"(\d+)\.csv$", 1).cast("bigint")
    kind = user.cast("bigint") % 4
    end = F.when(kind == 3, F.when(F.col("line") % 2 == 0, "\n").otherwise("\r\n")).otherwise(one_of(ENDS, kind))
    texts = lines.select(
        name_of(F.col("file")).alias("name"), "line", "text", one_of(CODECS, user % 6).alias("codec"), end.alias("end"), F.lit(None).cast("string").alias("damage")
    )
    write_texts(texts, folder)
    return folder


USERS = "WITH u AS (SELECT user_id, count(*) + 25 AS n FROM events GROUP BY user_id)\n"


@query(
    "text_encodings",
    USERS + """SELECT user_id || '.csv' AS name, list_extract(['utf-8', 'utf-8-sig', 'utf-16', 'utf-16', 'utf-32', 'utf-32'], CAST(1 + user_id % 6 AS INT)) AS encoding,
    CASE user_id % 4 WHEN 1 THEN 'CRLF' WHEN 2 THEN 'CR' ELSE 'LF' END AS line_end, user_id % 4 = 3 AS mixed_ends, CAST(n AS BIGINT) AS lines FROM u""",
)
def text_encodings(spark, d):
    files = settle(listing.files_of(listing.tree(spark, _native_files(spark, d))))
    out = ranges.states(files, ranges.scan(files, SMALL_RANGE))
    return out.where("status = 'ok'").select(name_of(F.col("path")).alias("name"), "encoding", "line_end", "mixed_ends", "lines")


@query(
    "text_samples",
    ROWS + """SELECT log_id || '.csv' AS log_id, CASE channel_id WHEN 'click' THEN '100' WHEN 'error' THEN '101' WHEN 'purchase' THEN '102' WHEN 'signup' THEN '103' ELSE '104' END AS channel_id,
    rn AS seq, t_rel AS t_ms, CASE WHEN v <= 200 THEN CAST(floor(v * 100) AS INT) END AS raw FROM z""",
)
def text_samples(spark, d):
    """The samples of ``native_samples``, read from files in six encodings."""
    _, _, lines = read_folder(spark, _native_files(spark, d), SMALL_RANGE)
    marks = nat.scan_marks(lines)
    files, channels, _ = nat.read_header(lines, marks=marks)
    out = nat.read_samples(nat.read_rows(lines, files), channels, clocks=nat.clocks_of(marks, files))
    return out.select(name_of(F.col("log_id")).alias("log_id"), "channel_id", "seq", "t_ms", "raw")


DAMAGE = [None, "gzip", "cut", "none", "noise"]


@query(
    "scan_status",
    """WITH u AS (SELECT l_suppkey AS k, count(*) + CASE WHEN l_suppkey % 5 >= 3 THEN 2 ELSE 1 END AS n FROM lineitem GROUP BY l_suppkey)
  SELECT list_extract(['sound/', 'packed/', 'cut/', 'empty/', 'noise/'], CAST(1 + k // 5 % 5 AS INT)) || k || '.csv' || list_extract(['', '.gz', '.gz', '', '.gz'], CAST(1 + k // 5 % 5 AS INT)) AS name,
    list_extract(['ok', 'ok', 'unreadable', 'empty', 'unreadable'], CAST(1 + k // 5 % 5 AS INT)) AS status,
    CASE WHEN k // 5 % 5 = 3 THEN 'empty' END AS notice, CASE WHEN k // 5 % 5 < 2 THEN 'utf-8' END AS encoding, CASE WHEN k // 5 % 5 < 2 THEN CAST(n AS BIGINT) END AS lines FROM u
  UNION ALL SELECT 'nowhere', 'left_out', 'missing', NULL, NULL""",
)
def scan_status_(spark, d):
    """A folder with sound, packed, cut, empty and foreign files in one pass, and a path that is not there."""
    folder = fresh(spark, "states")
    key = F.regexp_extract("file", r"(\d+)$", 1).cast("bigint")
    kind = F.floor(key / 5) % 5
    name = F.concat(
        one_of(["sound/", "packed/", "cut/", "empty/", "noise/"], kind), key.cast("string"), F.lit(".csv"), one_of(["", ".gz", ".gz", "", ".gz"], kind)
    )
    damage = F.get(F.array(*[F.lit(x) for x in DAMAGE]), kind.cast("int"))
    write_texts(csv_lines(spark, d).select(name.alias("name"), "line", "text", F.lit("utf-8").alias("codec"), F.lit("\n").alias("end"), damage.alias("damage")), folder)
    found, states, _ = read_folder(spark, [folder, f"{folder}/nowhere"], SMALL_RANGE)
    out = scan_status(found, states, formats=states.select("file", F.lit("csv").alias("format")))
    return out.select(F.substring("path", len(folder) + 2, 1 << 20).alias("name"), "status", "notice", "encoding", "lines")


def _paths() -> Column:
    key, hidden = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 10 == 3, ".old/").otherwise("")
    end = F.when(key % 11 == 0, ".png").otherwise(".csv")
    return F.concat((F.col("o_custkey") % 5).cast("string"), F.lit("/"), (F.col("o_custkey") % 50).cast("string"), F.lit("/"), hidden, key.cast("string"), end)


@query(
    "folder_listing",
    """WITH f AS (SELECT o_orderkey % 7 AS size, o_orderkey AS k,
    (o_custkey % 5) || '/' || (o_custkey % 50) || '/' || o_orderkey || CASE WHEN o_orderkey % 11 = 0 THEN '.png' ELSE '.csv' END AS path FROM orders WHERE o_orderkey % 10 <> 3)
  SELECT path, size, CASE WHEN size = 0 THEN 'empty' WHEN k % 11 = 0 THEN 'unrecognised' END AS notice FROM f""",
)
def folder_listing(spark, d):
    """A tree of a file per order, some hidden, some empty; the folder and a part of it are asked for."""
    folder = fresh(spark, "tree")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holes = stores.Holes()
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                holes.write(f"{folder}/{path}", size)
            yield pa.RecordBatch.from_pydict({"files": [batch.num_rows]})

    orders = table(spark, d, "orders").select(_paths().alias("path"), (F.col("o_orderkey") % 7).alias("size"))
    orders.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(write, "files long").agg(F.sum("files")).collect()
    found = listing.tree(spark, [folder, f"{folder}/1"])  # its levels are settled
    files = listing.files_of(found).join(listing.notices(found), "path", "left")
    return files.select(F.substring("path", len(folder) + 2, 1 << 20).alias("path"), "size", "notice")


@query(
    "import_samples",
    """WITH r AS (SELECT l_suppkey, l_quantity, l_extendedprice, l_discount, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS seq FROM lineitem)
  SELECT l_suppkey || '.csv' AS log_id, u.channel_id, seq, seq * 50 AS t_ms, round(u.v, 2) AS v FROM r, LATERAL (VALUES ('1', l_quantity), ('2', l_extendedprice), ('3', l_discount)) u(channel_id, v)""",
)
def import_samples(spark, d):
    """CSV files in five dialects and six encodings, imported from their folder."""
    folder = fresh(spark, "csv")
    key = F.regexp_extract("file", r"(\d+)$", 1)
    number = key.cast("bigint")
    write_texts(
        csv_lines(spark, d).select(
            F.concat(key, F.lit(".csv")).alias("name"), "line", "text", one_of(CODECS, number % 6).alias("codec"), one_of(ENDS, number % 3).alias("end"),
            F.lit(None).cast("string").alias("damage"),
        ),
        folder,
    )
    out = import_csv(spark, folder, f"{fresh(spark, 'imported')}")["samples"]
    return out.select(name_of(F.col("log_id")).alias("log_id"), "channel_id", "seq", "t_ms", F.round("v", 2).alias("v"))


def _quoted_files(spark: SparkSession, d: str) -> str:
    """A CSV per supplier whose notes hold delimiters, quotes and line breaks; escapes and signs differ."""
    folder = fresh(spark, "quoted")
    axis = Axis(("l_suppkey",), "l_orderkey", ("l_linenumber", "l_partkey", "l_extendedprice"))
    li = scan(attach_splits(table(spark, d, "lineitem"), axis), axis, total={"n": F.lit(1).cast("bigint")})
    k = F.col("l_suppkey") % 3
    sign, inner = F.when(k == 2, "'").otherwise('"'), F.when(k == 0, '""').when(k == 1, '\\"').otherwise("''")
    note = F.concat(sign, F.lit("flag "), "l_returnflag", F.lit(";\n "), inner, "l_linestatus", inner, F.lit("\r\n"), sign)
    cells = [F.format_string("%.1f", (F.col("n") - 1) * 0.5), note, *[F.format_string("%.0f", "l_quantity")] * 3]
    body = li.select("l_suppkey", F.col("n").alias("line"), F.concat_ws(";", *cells).alias("text"))
    head = li.select("l_suppkey").distinct().select("l_suppkey", F.lit(0).cast("bigint").alias("line"), F.lit("T;Note;A;B;C").alias("text"))
    texts = head.unionByName(body).select(
        F.concat("l_suppkey", F.lit(".csv")).alias("name"), "line", "text", one_of(CODECS, F.col("l_suppkey") % 6).alias("codec"), F.lit("\r\n").alias("end"),
        F.lit(None).cast("string").alias("damage"),
    )
    write_texts(texts, folder)
    return folder


@query(
    "csv_quoted_breaks",
    """WITH r AS (SELECT l_suppkey, l_quantity, l_returnflag || l_linestatus AS label, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS seq FROM lineitem),
  c AS (SELECT l_suppkey, label, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY label) - 1 AS code FROM (SELECT DISTINCT l_suppkey, label FROM r))
  SELECT l_suppkey || '.csv' AS log_id, u.channel_id, seq, seq * 500 AS t_ms, u.v::DOUBLE AS v FROM r JOIN c USING (l_suppkey, label),
    LATERAL (VALUES ('1', code), ('2', l_quantity), ('3', l_quantity), ('4', l_quantity)) u(channel_id, v)""",
)
def csv_quoted_breaks(spark, d):
    """Records with line breaks inside quotes, in files of many ranges."""
    _, states, lines = read_folder(spark, _quoted_files(spark, d), SMALL_RANGE // 16)
    found = cp.Probe(lines, counted=counted_lines(states))
    block = cr.read_block(cr.data_lines(found.rows, found.sample, found.structure), found.dialects, found.encodings)
    out = cr.read_channels(block, found.time, found.decimals, found.types)[0]
    return out.select(name_of(F.col("log_id")).alias("log_id"), "channel_id", "seq", "t_ms", "v")


@query(
    "csv_escapes",
    "SELECT l_suppkey || '.csv' AS name, CASE WHEN l_suppkey % 3 = 1 THEN 'backslash' ELSE 'doubled' END AS escape FROM lineitem GROUP BY l_suppkey",
)
def csv_escapes(spark, d):
    _, states, lines = read_folder(spark, _quoted_files(spark, d), SMALL_RANGE)
    found = cp.Probe(lines, counted=counted_lines(states))
    return cp.escapes(found.sample, found.dialects).select(name_of(F.col("file")).alias("name"), "escape")


@query(
    "store_refresh",
    """{S} SELECT log_id, channel_id, seq, t_ms, CASE WHEN log_id % 50 = 7 THEN 2 * v ELSE v END AS v, CASE WHEN log_id % 50 = 7 THEN 2 ELSE 1 END AS version
  FROM s WHERE log_id % 50 <> 9 AND NOT (log_id % 50 = 7 AND seq % 3 = 0)""",
)
def store_refresh(spark, d):
    """A store of all logs, of which some are replaced and some removed; a writer that dies changes nothing."""
    stored = Store(spark, fresh(spark, "stores"))
    s = samples(spark, d)
    marks = s.groupBy("log_id").agg(F.count(F.lit(1)).alias("size"), F.max("t_ms").alias("mtime"))
    marks = marks.withColumns({"parser_version": F.lit("1"), "format_version": F.lit("1")})
    first = stored.refresh(s, marks)
    before = stored.manifest(first)
    changed = marks.where("log_id % 50 = 7").withColumn("mtime", F.col("mtime") + 1)
    stored.refresh(
        s.where("log_id % 50 = 7 AND seq % 3 <> 0").withColumn("v", 2 * F.col("v")), changed, marks.where("log_id % 50 = 9").select("log_id")
    )
    stored._write_aside(s.withColumn("v", F.lit(-1.0)))  # a writer that is killed before it publishes
    kept = stored.manifest().join(before.select("log_id", "commit"), ["log_id", "commit"], "left_semi").select("log_id", F.lit(1).alias("version"))
    out = stored.read().join(kept, "log_id", "left")
    return out.select("log_id", "channel_id", "seq", "t_ms", "v", F.coalesce("version", F.lit(2)).alias("version"))


def export_channels(spark: SparkSession, d: str) -> DataFrame:
    """Three layouts: logs differ in the channels they have and in the units asked for."""
    logs = samples(spark, d).select("log_id").distinct()
    text = lambda x: F.lit(x).cast("string")
    spec = lambda c, name, dim, unit, ref=None, why=None: F.struct(
        F.lit(c).alias("channel_id"), F.lit(name).alias("name"), text(dim).alias("dimension"), text(unit).alias("unit"), F.lit("point").alias("cls"),
        F.lit(ref).cast("double").alias("reference_kpa"), text(why).alias("reason"),
    )
    kinds = [
        [spec("click", "CLT", "temperature", "degF"), spec("view", "Boost", "pressure", "bar", 101.325)],
        [spec("click", "CLT", "temperature", "degC"), spec("error", "Odd", None, None, why="unknown_dimension")],
        [spec("view", "MAP", "pressure", "kPa"), spec("purchase", "Speed", "angular_speed", "rpm"), spec("signup", "Speed", "angular_speed", "rpm")],
    ]
    k = F.col("log_id") % 3
    found = F.when(k == 0, F.array(*kinds[0])).when(k == 1, F.array(*kinds[1])).otherwise(F.array(*kinds[2]))
    return logs.select("log_id", F.explode(found).alias("c")).select("log_id", "c.*")


@query(
    "export_by_layout",
    """{S}, c(m, channel_id, label, a, b) AS (VALUES (0, 'click', 'CLT [degF]', 1.8, -459.67), (0, 'view', 'Boost [bar (rel)]', 0.01, -1.01325),
    (1, 'click', 'CLT [degC]', 1.0, -273.15), (1, 'error', 'Odd [raw]', 1.0, 0.0),
    (2, 'view', 'MAP [kPa (abs)]', 1.0, 0.0), (2, 'purchase', 'Speed [rpm]', 1.0, 0.0), (2, 'signup', 'Speed [rpm]_2', 1.0, 0.0))
  SELECT CAST(log_id AS VARCHAR) AS log_id, seq, t_ms, label, round(v * a + b, 6) AS v FROM s JOIN c ON c.m = s.log_id % 3 AND c.channel_id = s.channel_id""",
)
def export_by_layout(spark, d):
    """All logs exported as CSV in one job; files and headers read back as text."""
    files = export.export_layouts(samples(spark, d), export_channels(spark, d), fresh(spark, "exports"), "csv", 100)
    lines = read_lines(spark, files.select(F.col("file").alias("path")))
    comma, quote = F.lit(","), F.lit('"')
    heads = lines.where("line = 0").select("file", split_fields(F.col("text"), comma, quote).alias("h"))
    cells = lines.where("line > 0").join(heads, "file").select("h", split_fields(F.col("text"), comma, quote).alias("c"))
    each = cells.select(F.get("c", F.lit(0)).alias("log_id"), F.get("c", F.lit(1)).cast("bigint").alias("seq"), F.get("c", F.lit(2)).cast("bigint").alias("t_ms"), "h", F.posexplode("c").alias("i", "x"))
    kept = each.where("i > 2 AND x <> ''")
    return kept.select("log_id", "seq", "t_ms", F.get("h", F.col("i")).alias("label"), F.round(F.col("x").cast("double"), 6).alias("v"))
