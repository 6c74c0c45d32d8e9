"""What arbitrary CSV files look like: dialect, structure, time axis, types.

Everything runs as grouped aggregates over the lines of many files at once, and every
line counts: what is judged is what is read. A caller who only wants a preview may give
``max_bytes`` for a file's first bytes.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as c
from ..functions.clock import iso_instant, row_clock_seconds, to_number
from ..operators.ordered import SPLIT, Axis, attach_splits, dealt, has_splits, scan
from ..operators.quantiles import quantiles
from ..session import settle
from .lines import field_count, split_fields, unquoted

# Fixed values.
DELIMITERS = [",", ";", "\t", "|", " "]
QUOTES = [None, '"', "'"]
MIN_CONSISTENCY = 0.6
MIN_RUN = 3
MIN_NUMERIC = 0.7
MAX_UNIT_LENGTH = 12
#: Lines of a file in which its data is looked for first.
HEAD_LINES = 64
METADATA = r"^\s*([^:=]{1,60}?)\s*[:=]\s*(.*?)\s*$"


FILE_LINES = Axis(("file",), "line")


def _counts() -> Column:
    """Fields of a line under every try, by quotes, then delimiters; a line without quotes counts alike under all of them and has one set."""
    count = lambda bare: [field_count(bare, F.lit(d)) for d in DELIMITERS]
    text = F.col("text")
    # a line without its quoted stretches is made once for all delimiters
    bares = F.array(*[text if q is None else unquoted(text, F.lit(q)) for q in QUOTES])
    every = c.bound(bares, lambda b: F.array(*[n for i in range(len(QUOTES)) for n in count(F.get(b, F.lit(i)))]))
    return F.when(text.contains('"') | text.contains("'"), every).otherwise(F.array(*count(text)))


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines numbered in ``k``; ``_new`` where a line counts unlike the one before. One ordered scan tells both."""
    out = scan(lines.withColumn("_c", _counts()), FILE_LINES, total={"_n": F.lit(1).cast("bigint")}, prev={"_p": F.col("_c")})
    return out.withColumns({"k": F.col("_n") - 1, "_new": ~F.col("_c").eqNullSafe(F.col("_p"))}).drop("_n", "_c", "_p")


def sample_lines(lines: DataFrame, max_bytes: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Non-blank lines of each file (of its first ``max_bytes``), renumbered in ``k`` from 0.

    ``counted(file, lines)`` spares counting them where files are known to have at most so many.
    """
    lines = lines.select("file", "line", "text")
    if max_bytes is None:
        zero, most = F.lit(0.0), F.col("lines").cast("double")
        known = None if counted is None else counted.select("file", F.col("lines").alias("_n"), zero.alias("_lo"), most.alias("_hi"))
        lines = attach_splits(lines, FILE_LINES, counted=known)
    # as rows of an array: a filter on the text itself would compute it a second time
    lines = lines.select(*[x for x in lines.columns if x != "text"], F.explode(F.array("text")).alias("text"))
    if max_bytes is not None:
        w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
        lines = (
            lines.filter(F.col("line") < max_bytes)
            .withColumn("_end", F.sum(F.octet_length("text") + 1).over(w))
            .filter(F.col("_end") <= max_bytes)
            .drop("_end")
        )
    return _numbered(lines.filter(F.trim("text") != ""))


def encodings(lines: DataFrame) -> DataFrame:
    """UTF-8 where every line's bytes are valid, else latin-1."""
    return lines.groupBy("file").agg(
        F.when(F.min(F.is_valid_utf8("text")), "utf-8").otherwise("latin-1").alias("encoding")
    )


def decode_text(lines: DataFrame, encoding: DataFrame) -> DataFrame:
    """Decode the raw bytes of files that are not UTF-8."""
    raw = F.col("text").cast("binary")
    text = F.when(F.col("encoding") == "latin-1", F.decode(raw, "ISO-8859-1")).otherwise(F.col("text"))
    return lines.join(encoding, "file").withColumn("text", text).drop("encoding")


def lines_until(lines: DataFrame, found: DataFrame, at: str = "data_start") -> DataFrame:
    """Lines whose ``k`` is no larger than any file's ``at``: told by one number before a line is joined or split."""
    most = found.agg(F.max(at)).first()[0]
    return lines.filter(F.col("k") <= F.lit(-1 if most is None else most))


def delimiter_scores(sample: DataFrame) -> DataFrame:
    """Longest run of equal field counts for every delimiter and quote per file.

    Lines that count as the line before under all tries, as the ordered scan that numbers
    them tells, are left out: what stays are the first lines of stretches, and only those
    are spread over the tries and joined to each try's runs.
    """
    tries = [(i, j) for i in range(len(DELIMITERS)) for j in range(len(QUOTES))]
    present = sample.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.max(F.col("text").contains('"')).alias("_q1"),
        F.max(F.col("text").contains("'")).alias("_q2"),
    )
    present = settle(present.withColumn("_file_lines", F.col("lines")).drop("lines"))
    if "_new" not in sample.columns:
        sample = _numbered(sample.drop("k"))
    starts = settle(sample.filter("_new").select("file", "line", "k", _counts().alias("_c")))
    back = Axis(("file",), "_back")
    following = scan(attach_splits(starts.withColumn("_back", -F.col("line")), back), back, prev={"_next": F.col("k")})
    following = following.select("file", "line", "k", "_c", "_next").join(present.select("file", "_file_lines"), "file")
    all_counts = F.when(F.size("_c") == len(DELIMITERS), F.concat(*["_c"] * len(QUOTES))).otherwise(F.col("_c"))
    stretches = following.select("file", "line", "k", (F.coalesce("_next", "_file_lines") - F.col("k")).alias("_long"), all_counts.alias("_c"))
    rows = scan(attach_splits(settle(stretches), FILE_LINES), FILE_LINES, prev={"_p": F.col("_c")})
    at = lambda i, j: j * len(DELIMITERS) + i
    changed = {f"_r{n}": (~F.get("_c", F.lit(at(i, j))).eqNullSafe(F.get("_p", F.lit(at(i, j))))).cast("bigint") for n, (i, j) in enumerate(tries)}
    rows = scan(rows, FILE_LINES, total=changed)
    each = F.explode(
        F.array(*[F.struct(F.lit(i).alias("d"), F.lit(j).alias("q"), F.col(f"_r{n}").alias("r"), F.get("_c", F.lit(at(i, j))).alias("fields")) for n, (i, j) in enumerate(tries)])
    )
    islands = (
        rows.select("file", "k", "_long", each.alias("_t")).select("file", "k", "_long", "_t.*").groupBy("file", "d", "q", "r", "fields")
        .agg(F.sum("_long").alias("run"), F.min("k").alias("start"))
        .join(present, "file").withColumnRenamed("_file_lines", "lines")
    )
    islands = islands.filter((F.col("q") == 0) | ((F.col("q") == 1) & F.col("_q1")) | ((F.col("q") == 2) & F.col("_q2")))
    best = F.max(F.struct(F.col("run"), (-F.col("start")).alias("early"), F.col("fields"))).alias("_b")
    marks = F.array(*[F.lit(d) for d in DELIMITERS]), F.array(*[F.lit(q).cast("string") for q in QUOTES])
    return islands.groupBy("file", "lines", "d", "q").agg(best).select(
        "file", "lines", "d", "q", F.get(marks[0], F.col("d")).alias("delimiter"), F.get(marks[1], F.col("q")).alias("quote"), F.col("_b.run").alias("run"), (-F.col("_b.early")).alias("start"),
        F.col("_b.fields").alias("fields"),
    ).withColumn("consistency", F.try_divide(F.col("run").cast("double"), F.col("lines") - F.col("start")))


def dialects(sample: DataFrame) -> DataFrame:
    """Best delimiter and quote per file; NULL delimiter where none is convincing."""
    scores = delimiter_scores(sample)
    useful = (F.col("fields") > 1) & (F.col("run") >= F.least(F.lit(MIN_RUN), F.col("lines")))
    rank = F.struct(
        "consistency", "run", "fields", (-F.col("d")).alias("d"), (-F.col("q")).alias("q"), "delimiter", "quote", "start"
    )
    best = scores.groupBy("file", "lines").agg(F.max(F.when(useful, rank)).alias("b"))
    sure = F.coalesce(F.col("b.consistency") >= MIN_CONSISTENCY, F.lit(False))
    loose = sure & (F.col("b.run") < F.col("lines"))
    return best.select(
        "file", "lines",
        F.when(sure, F.col("b.delimiter")).alias("delimiter"),
        F.when(sure, F.col("b.quote")).alias("quote"),
        F.when(sure, F.col("b.fields")).otherwise(1).alias("fields"),
        F.when(sure, F.col("b.start")).alias("start"),
        F.when(sure, F.col("b.run")).alias("run"),
        F.when(~sure, "delimiter_undetermined").when(loose, "inconsistent_fields").alias("notice"),
    )


def escapes(sample: DataFrame, dialect: DataFrame) -> DataFrame:
    """``(file, escape)``: how quotes inside quotes are written, as the first line that has some tells.

    backslash, doubled, or none where no quote is used or none is escaped.
    """
    known = dialect.select("file", F.col("quote").alias("_q"))
    kind = F.when(F.col("text").contains(F.concat(F.lit("\\"), "_q")), 0).when(F.col("text").contains(F.concat("_q", "_q")), 1)
    told = sample.join(known.where("_q IS NOT NULL"), "file").withColumn("_e", kind).where("_e IS NOT NULL")
    first = told.groupBy("file").agg(F.min_by("_e", "k").alias("_e")).select("file", F.when(F.col("_e") == 0, "backslash").otherwise("doubled").alias("_e"))
    return known.join(first, "file", "left").select("file", F.coalesce("_e", F.lit("none")).alias("escape"))


def cut_lines(sample: DataFrame, dialect: DataFrame) -> DataFrame:
    """The sample's lines with ``delimiter, quote, start`` of their file and their fields ``_f``; NULL where the file has no dialect.

    To be settled where several steps need the fields: the planner would cut a line anew, even twice, in each of them.
    """
    known = dialect.filter("delimiter IS NOT NULL").select("file", "delimiter", "quote", "start")
    rows = sample.drop("_new").join(known, "file", "left")
    return rows.withColumn("_f", split_fields(F.col("text"), F.col("delimiter"), F.col("quote")))


def cells_of(cut: DataFrame) -> DataFrame:
    """``(file, k, start, delimiter, fields, col, cell)`` of lines cut by ``cut_lines``."""
    split = [SPLIT] if has_splits(cut) else []
    return cut.filter("delimiter IS NOT NULL").select("file", "k", *split, "start", "delimiter", F.size("_f").alias("fields"), F.posexplode("_f").alias("col", "cell"))


def sample_cells(sample: DataFrame, dialect: DataFrame) -> DataFrame:
    """``(file, k, fields, col, cell)`` of the sample under each file's dialect."""
    return cells_of(cut_lines(sample, dialect))


def decimals(cells: DataFrame, dialect: DataFrame, rows: int | None = None) -> DataFrame:
    """Decimal sign per file from its data rows (the first ``rows``); the delimiter cannot be it."""
    data = cells.filter(F.col("k") >= F.col("start"))
    if rows is not None:
        data = data.filter(F.col("k") < F.col("start") + rows)
    if "delimiter" not in data.columns:
        data = data.join(dialect.select("file", "delimiter"), "file")
    return c.vote_decimal(data, ["file"], delimiter=F.col("delimiter"))


def _line_shares(cells: DataFrame, decimal: DataFrame) -> DataFrame:
    """Per line its fields, the share of filled cells that are numbers or times, and the longest cell."""
    tested = cells.join(decimal.select("file", "decimal"), "file")
    counts = c.is_numeric(c.pointed(F.col("cell"), F.col("decimal")), ".") | c.looks_like_time(F.col("cell"))
    filled = F.trim("cell") != ""
    return tested.groupBy("file", "k").agg(
        F.max("fields").alias("fields"),
        F.avg(F.when(filled, counts.cast("int"))).alias("_share"),
        F.count_if(filled).alias("_filled"),
        F.max(F.when(filled, F.length(F.trim("cell")))).alias("_longest"),
    )


def _begins(per_line: DataFrame) -> DataFrame:
    """The first line of each file that looks like data."""
    return per_line.filter(F.col("_share") >= MIN_NUMERIC).groupBy("file").agg(
        F.min("k").alias("data_start"), F.min_by("fields", "k").alias("columns")
    )


def structure(sample: DataFrame, cells: DataFrame, decimal: DataFrame) -> DataFrame:
    """Where data starts and which lines carry names and units, per file.

    Data starts at the first line whose filled cells are at least 70 % numbers or
    times; the line before holds units when it is short text of the same width with
    a line of the same width before it, which then holds the names. Later lines cannot
    change the first, so the first ``HEAD_LINES`` of every file are looked at before the
    others, and those only in files without data so far.
    """
    found = settle(_begins(_line_shares(cells.filter(F.col("k") < HEAD_LINES), decimal)))
    late = settle(decimal.select("file").join(found, "file", "left_anti"))
    if not late.isEmpty():
        rest = cells.filter(F.col("k") >= HEAD_LINES).join(late, "file", "left_semi")
        found = found.unionByName(_begins(_line_shares(rest, decimal)))
    begins = settle(found)
    before = begins.select("file", F.col("data_start").alias("_at"))
    near = lines_until(cells, begins).join(before, "file").filter((F.col("k") < F.col("_at")) & (F.col("k") >= F.col("_at") - 2)).drop("_at")
    per_line = _line_shares(near, decimal)
    # only the lines before the data: a join with the whole sample might send it to every task, for it is small on disk
    above = lines_until(sample, begins).join(before, "file").filter((F.col("k") < F.col("_at")) & (F.col("k") >= F.col("_at") - 2))
    meta = settle(above.select("file", "k", F.col("text").rlike(METADATA).alias("is_meta")))
    around = per_line.join(begins, "file").join(meta, ["file", "k"])
    one = F.col("k") == F.col("data_start") - 1
    pick = lambda cond, x: F.max(F.when(cond, x))
    near = around.groupBy("file").agg(
        pick(one, F.col("fields")).alias("_f1"), pick(~one, F.col("fields")).alias("_f2"),
        pick(one, F.col("is_meta")).alias("_m1"), pick(~one, F.col("is_meta")).alias("_m2"),
        pick(one, F.col("_share")).alias("_s1"), pick(one, F.col("_longest")).alias("_l1"),
        pick(one, F.col("_filled")).alias("_c1"),
    )
    out = begins.join(near, "file", "left")
    units_like = (F.col("_c1") > 0) & (F.col("_s1") == 0) & (F.col("_l1") <= MAX_UNIT_LENGTH)
    has_units = F.coalesce(
        (F.col("data_start") >= 2) & (F.col("_f1") == F.col("columns")) & (F.col("_f2") == F.col("columns"))
        & units_like & ~F.col("_m1") & ~F.col("_m2"),
        F.lit(False),
    )
    before = F.when(has_units, F.col("data_start") - 2).otherwise(F.col("data_start") - 1)
    not_names = (before < 0) | (~has_units & F.coalesce(F.col("_m1") & (F.col("_f1") != F.col("columns")), F.lit(False)))
    out = out.select(
        "file", "data_start", "columns",
        F.when(has_units, F.col("data_start") - 1).alias("units_line"),
        F.when(~not_names, before).alias("names_line"),
    )
    return out.withColumn(
        "preamble_end", F.coalesce("names_line", "units_line", "data_start")
    )


def preamble_metadata(sample: DataFrame, found: DataFrame) -> DataFrame:
    """``(file, key, value)`` of the preamble, the last value of a key winning."""
    rows = sample.join(found.select("file", "preamble_end"), "file").filter(F.col("k") < F.col("preamble_end"))
    rows = rows.filter(F.col("text").rlike(METADATA)).select(
        "file", "k", F.trim(F.regexp_extract("text", METADATA, 1)).alias("key"), F.trim(F.regexp_extract("text", METADATA, 2)).alias("value")
    )
    return rows.groupBy("file", "key").agg(F.max_by("value", "k").alias("value"), (F.count(F.lit(1)) > 1).alias("repeated"))


def preamble_map(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))


def headers(cells: DataFrame, found: DataFrame) -> DataFrame:
    """``(file, pos, name, unit)`` of every data column, NULL where not declared."""
    slots = found.select(
        "file", "names_line", "units_line", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("pos")
    )
    at = cells.select("file", "k", F.col("col").alias("pos"), F.trim("cell").alias("_x"))
    names = at.join(found.select("file", F.col("names_line").alias("k")), ["file", "k"]).select("file", "pos", F.col("_x").alias("name"))
    units = at.join(found.select("file", F.col("units_line").alias("k")), ["file", "k"]).select("file", "pos", F.col("_x").alias("unit"))
    return slots.join(names, ["file", "pos"], "left").join(units, ["file", "pos"], "left").select("file", "pos", "name", "unit")


def _instants(cells: DataFrame, decimal: Column) -> DataFrame:
    """Filled cells with ``_iso, _clock, _n``, what they are to a time axis, and ``_raw``, their instant or number."""
    t = F.trim("cell")
    rows = cells.filter(t != "").withColumns({"_t": t, "_dec": decimal})
    number = to_number(F.when(F.col("_dec") == ",", F.replace("_t", F.lit(","), F.lit("."))).otherwise(F.col("_t")))
    iso = (F.length("_t") >= 19) & F.col("_t").rlike(c.ISO_TIME)
    rows = rows.withColumns({"_iso": iso, "_clock": F.contains("_t", F.lit(":")) & F.col("_t").rlike(c.CLOCK_TIME), "_n": number})
    raw = F.when(F.col("_iso"), iso_instant(F.col("_t"))).when(F.col("_clock"), row_clock_seconds(F.col("_t"))).otherwise(F.col("_n"))
    return rows.withColumn("_raw", raw)


def _is_date() -> Column:
    return (F.length("_t") >= 8) & F.col("_t").rlike(c.DATE_ONLY)


def _is_epoch(scale: int) -> Column:
    return F.coalesce(F.col("_n").between(c.EPOCH_MIN_S * scale, c.EPOCH_MAX_S * scale), F.lit(False))


def no_axes(data: DataFrame) -> DataFrame:
    """``(file, _no_axis)`` of every file of ``data_cells``: columns that its first ``HEAD_LINES`` data lines show to be no axis and no dates.

    Such a column has a cell that is no time, no date and no number, or numbers that fall and are no epoch. Later lines
    cannot mend that, so only the other columns need be read to their end.
    """
    near = _instants(data.drop(SPLIT).filter(F.col("k") < F.col("data_start") + HEAD_LINES), F.col("decimal"))
    seen = near.groupBy("file", "col").agg(
        F.min("_iso").alias("_iso"), F.min("_clock").alias("_clock"), F.min(_is_date()).alias("_date"), F.min(F.col("_n").isNotNull()).alias("_num"),
        F.min(_is_epoch(1)).alias("_es"), F.min(_is_epoch(1000)).alias("_ems"),
        # as in time_classes: no order is needed to see that most columns of numbers fall
        ((F.min_by("_raw", "k") > F.min("_raw")) | (F.max_by("_raw", "k") < F.max("_raw"))).alias("_falls"),
    )
    axis = F.col("_iso") | F.col("_clock") | F.col("_date") | (F.col("_num") & (F.col("_es") | F.col("_ems") | ~F.col("_falls")))
    return seen.groupBy("file").agg(F.collect_list(F.when(~axis, F.col("col"))).alias("_no_axis"))


def time_classes(cells: DataFrame, keys: list[str], decimal: Column, order: str = "k") -> DataFrame:
    """Time class of each column, its factor to seconds, first instant and median step.

    Rule order: ISO text, clock text, epoch seconds, epoch ms, then non-decreasing
    numbers, which are a counter when they step by one and a relative axis otherwise
    (seconds up to a median step of two). Monotony and steps need the row order: one ordered
    scan over the rows of each column that can be an axis, in slices where a file is large.
    ``step_s`` is null for other columns that are no axis, ``first_text`` for those that hold no dates.
    """
    keys = list(keys)
    told = lambda cells: _instants(cells, decimal)
    rows = told(cells)
    n = F.col("_n")
    g = settle(rows.groupBy(*keys).agg(
        F.min("_iso").alias("_iso"),
        F.min("_clock").alias("_clock"),
        F.min(_is_date()).alias("is_date"),
        F.min(n.isNotNull()).alias("_num"),
        F.min(_is_epoch(1)).alias("_es"),
        F.min(_is_epoch(1000)).alias("_ems"),
        F.min(F.coalesce(n == F.floor(n), F.lit(False))).alias("_whole"),
        F.count(F.lit(1)).alias("_rows"),
        F.min(order).alias("_k0"),
        F.min_by("_raw", order).alias("_first"), F.max_by("_raw", order).alias("_last"),
        F.min("_raw").alias("_low"), F.max("_raw").alias("_high"),
    ))
    # What never falls begins with its least and ends with its largest value; other columns of numbers need no scan.
    may_rise = (F.col("_first") == F.col("_low")) & (F.col("_last") == F.col("_high"))
    steps_count = F.col("_iso") | F.col("_clock") | (F.col("_num") & (F.col("_es") | F.col("_ems") | may_rise))
    moving = steps_count & ~F.col("_low").eqNullSafe(F.col("_high"))
    wanted = settle(g.filter(moving).select(*keys, "_rows"))
    # joined before a cell is read: most columns are not wanted
    rows_in_order = told(cells.join(wanted, keys, "left_semi")).select(*keys, order, "_raw", *([SPLIT] if has_splits(cells) else []))
    if not has_splits(cells):
        rows_in_order = dealt(rows_in_order, keys, wanted.agg(F.sum("_rows")).first()[0] or 0)
    moves = scan(rows_in_order, Axis(tuple(keys), order), prev={"_before": F.col("_raw")}).withColumn("_d", F.col("_raw") - F.col("_before"))
    rising = [F.coalesce(F.min(F.col("_d") >= 0), F.lit(True)).alias("_up"), F.coalesce(F.min(F.col("_d") == 1.0), F.lit(False)).alias("_ones")]
    if has_splits(cells):
        steps = quantiles(moves.filter(F.col("_d") > 0).select(*keys, "_d"), keys, "_d", {"_step": 0.5})
        moved = moves.groupBy(*keys).agg(*rising).join(steps, keys, "left")
    else:
        moved = moves.groupBy(*keys).agg(*rising, F.percentile(F.when(F.col("_d") > 0, F.col("_d")), 0.5).alias("_step"))
    dates = g.filter("is_date").select(*keys, F.col("_k0").alias(order))
    texts = rows.select(*keys, order, "_t").join(dates, [*keys, order], "left_semi").groupBy(*keys).agg(F.min("_t").alias("first_text"))
    g = g.join(moved, keys, "left").join(texts, keys, "left")
    # a column that never moves never falls, and has no steps
    g = g.withColumns({"_up": F.coalesce("_up", steps_count, F.lit(False)), "_ones": F.coalesce("_ones", F.lit(False))})
    counter = (F.col("_rows") >= 3) & F.col("_whole") & F.col("_ones")
    cls = (
        F.when(F.col("_iso"), "iso8601")
        .when(F.col("_clock"), "clock")
        .when(~F.col("_num"), None)
        .when(F.col("_es"), "epoch_s")
        .when(F.col("_ems"), "epoch_ms")
        .when(~F.col("_up"), None)
        .when(counter, "counter")
        .otherwise("relative")
    )
    factor = F.when(F.col("class") == "epoch_ms", 0.001).when(
        (F.col("class") == "relative") & (F.col("_step") > c.LONGEST_SECOND_STEP), 0.001
    ).otherwise(1.0)
    return g.withColumn("class", cls).withColumn("factor", factor).select(
        *keys, "class", "factor", "is_date", "first_text",
        (F.col("_first") * F.col("factor")).alias("first_s"), (F.col("_step") * F.col("factor")).alias("step_s"),
    )


def data_rows(cells: DataFrame, found: DataFrame, rows: int | None = None) -> DataFrame:
    """Cells of the data block (of its first ``rows``), padded columns dropped."""
    data = cells.drop("start").join(found.select("file", "data_start", "columns"), "file").filter(
        (F.col("k") >= F.col("data_start")) & (F.col("col") < F.col("columns"))
    )
    return data if rows is None else data.filter(F.col("k") < F.col("data_start") + rows)


def data_cells(cut: DataFrame, found: DataFrame, decimal: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """Cells of the data block, with the decimal sign of their file; none of the columns that ``without(file, columns)`` names.

    As ``data_rows`` of ``cells_of``, but what is known of a file meets its lines and not every cell of them.
    """
    known = found.select("file", "data_start", "columns").join(decimal.select("file", "decimal"), "file")
    if without is not None:
        known = known.join(without.toDF("file", "_without"), "file", "left")
    known = settle(known)
    rows = cut.filter("delimiter IS NOT NULL").join(known, "file").filter(F.col("k") >= F.col("data_start"))
    split = [SPLIT] if has_splits(cut) else []
    cells = rows.select("file", "k", *split, "delimiter", F.size("_f").alias("fields"), "data_start", "columns", "decimal", *([] if without is None else ["_without"]), F.posexplode("_f").alias("col", "cell"))
    cells = cells.filter(F.col("col") < F.col("columns"))
    return cells if without is None else cells.filter(~F.coalesce(F.array_contains("_without", F.col("col")), F.lit(False))).drop("_without")


def _signed(data: DataFrame, decimal: DataFrame) -> DataFrame:
    return data if "decimal" in data.columns else data.join(decimal.select("file", "decimal"), "file")


def time_column(
    data: DataFrame,
    decimal: DataFrame,
    head: DataFrame,
    *,
    declared_hz: float | None = None,
    metadata_date: DataFrame | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """The time axis of each file: first column that is one, resolved to seconds.

    A clock joins a date column; a counter or a missing column needs the declared
    frequency. ``metadata_date(file, date)`` dates a lone clock. ``files`` names the files where
    ``data`` may lack columns that are no axis, and so whole files.
    """
    rows = _signed(data, decimal)
    classes = time_classes(rows, ["file", "col"], F.col("decimal"))
    axis = F.struct("col", "class", "factor", "first_s", "step_s")
    out = classes.groupBy("file").agg(
        F.min_by(axis, F.when(F.col("class").isNotNull(), F.col("col"))).alias("_t"),
        F.min_by(F.struct("col", "first_text"), F.when(F.col("is_date"), F.col("col"))).alias("_d"),
    )
    out = out.select("file", "_t.*", F.col("_d.col").alias("date_col"), F.col("_d.first_text").alias("date_text"))
    if files is not None:
        out = files.select("file").join(out, "file", "left")
    joined = (F.col("class") == "clock") & F.col("date_col").isNotNull()
    out = out.withColumn("class", F.when(joined, "date_and_clock").otherwise(F.coalesce("class", F.lit("absent"))))
    if metadata_date is None:
        out = out.withColumn("_date", F.lit(None).cast("date"))
    else:
        out = out.join(metadata_date.select("file", F.col("date").alias("_date")), "file", "left")
    out = out.join(head.select("file", F.col("pos").alias("col"), "name"), ["file", "col"], "left")
    hz = F.lit(None).cast("double") if declared_hz is None else F.lit(float(declared_hz))
    synthetic = F.col("class").isin("counter", "absent")
    day = F.coalesce(
        F.try_to_date("date_text", "yyyy-MM-dd"), F.try_to_date("date_text", "yyyyMMdd"), F.try_to_date("date_text", "d/M/yyyy")
    )
    day = F.when(F.col("class") == "date_and_clock", day).when(F.col("class") == "clock", F.col("_date"))
    t0 = F.when(F.col("class").isin("iso8601", "epoch_s", "epoch_ms"), F.col("first_s")).otherwise(
        F.unix_seconds(day.cast("timestamp")) + F.col("first_s")
    )
    t0 = F.when(~synthetic & (F.col("class") != "relative"), t0)
    notice = (
        F.when((F.col("class") == "counter") & hz.isNull(), "counter_without_frequency")
        .when(F.col("class") == "counter", "synthetic_axis_from_counter")
        .when((F.col("class") == "absent") & hz.isNull(), "no_time_column")
        .when(F.col("class") == "absent", "synthetic_axis")
        .when(F.col("class") == "relative", "relative_unit_from_step")
        .when((F.col("class") == "clock") & day.isNull(), "clock_without_date")
    )
    return out.select(
        "file", "class", F.when(F.col("class") != "absent", F.col("col")).alias("col"), "name",
        F.when(F.col("class") == "date_and_clock", F.col("date_col")).alias("date_col"),
        F.when(synthetic, F.coalesce(F.try_divide(F.lit(1.0), hz), F.lit(1.0))).otherwise(F.col("factor")).alias("factor"),
        F.when(synthetic, F.try_divide(F.lit(1.0), hz)).otherwise(F.col("step_s")).alias("step_s"),
        F.when(synthetic, hz).otherwise(F.try_divide(F.lit(1.0), F.col("step_s"))).alias("hz"),
        t0.alias("t0_s"),
        F.when(t0.isNotNull(), "reliable").otherwise("unknown").alias("reliability"),
        notice.alias("notice"),
    )


def synthetic_axis(seq: Column, hz: Column) -> Column:
    """Seconds of row ``seq`` at a declared frequency; NULL without one."""
    return F.try_divide(seq, hz)


def column_types(data: DataFrame, decimal: DataFrame) -> DataFrame:
    """Type profile of every data column under its file's decimal sign."""
    rows = _signed(data, decimal)
    return c.infer_types(rows, ["file", "col"], F.col("decimal"))


#: Columns of cut lines, and their names where they travel with lines that ``read_block`` cuts.
CUT = {"delimiter": "_cut_by", "quote": "_cut_quote", "_f": "_cut"}


class Probe:
    """Probe tables of a set of files, each computed when first asked for.

    Every step feeds several later ones, so the steps are settled. The numbered lines
    and their fields are the largest: they are written once, and every later step and the reading of the
    data block start from them instead of numbering and cutting the text again.
    """

    def __init__(
        self, lines: DataFrame, *, declared_hz: float | None = None, max_bytes: int | None = None, counted: DataFrame | None = None
    ):
        self.lines, self.declared_hz, self.max_bytes, self.counted = lines, declared_hz, max_bytes, counted

    @cached_property
    def _raw_sample(self) -> DataFrame:
        return settle(sample_lines(self.lines, self.max_bytes, self.counted))

    @cached_property
    def encodings(self) -> DataFrame:
        return settle(encodings(self._raw_sample))

    @cached_property
    def decoding(self) -> DataFrame | None:
        """The encodings to decode by; None where every file is UTF-8, so that no line has to meet its file's."""
        return None if self.encodings.filter("encoding <> 'utf-8'").isEmpty() else self.encodings

    @cached_property
    def sample(self) -> DataFrame:
        if self.decoding is None:
            return self._raw_sample.filter("file IS NOT NULL")
        return decode_text(self._raw_sample, self.decoding)

    @property
    def rows(self) -> DataFrame:
        """``(file, line, text)`` as given, of every line that is not blank, from the settled sample where it is whole.

        Where no line was decoded they carry their fields and what these were cut by, so that ``read_block`` need not cut them again.
        """
        if self.max_bytes is not None:
            return self.lines
        if self.decoding is not None:
            return self._raw_sample.select("file", "line", "text")
        return self._cut.select("file", "line", "text", *CUT.values())

    @cached_property
    def dialects(self) -> DataFrame:
        return settle(dialects(self.sample))

    @cached_property
    def _cut(self) -> DataFrame:
        by = [F.col(old).alias(new) for old, new in CUT.items()]
        cut = cut_lines(self.sample, self.dialects)
        return settle(cut.select(*[x for x in cut.columns if x not in CUT], *by))

    @cached_property
    def cut(self) -> DataFrame:
        """The sample's lines, cut once for all steps; see ``cut_lines``."""
        return self._cut.withColumnsRenamed({new: old for old, new in CUT.items()})

    @cached_property
    def cells(self) -> DataFrame:
        return cells_of(self.cut)

    @cached_property
    def decimals(self) -> DataFrame:
        return settle(decimals(self.cells, self.dialects))

    @cached_property
    def structure(self) -> DataFrame:
        return settle(structure(self.sample, self.cells, self.decimals))

    @cached_property
    def headers(self) -> DataFrame:
        named = self.structure.select("file", F.explode(F.array("names_line", "units_line")).alias("k")).where("k IS NOT NULL")
        heads = sample_cells(lines_until(self.sample, self.structure).join(named, ["file", "k"], "left_semi"), self.dialects)
        return settle(headers(heads, self.structure))

    @property
    def metadata(self) -> DataFrame:
        return preamble_metadata(self.sample, self.structure)

    @cached_property
    def data(self) -> DataFrame:
        return data_cells(self.cut, self.structure, self.decimals)

    @cached_property
    def time(self) -> DataFrame:
        out = settle(no_axes(self.data))
        rows = data_cells(self.cut, self.structure, self.decimals, without=out)
        return settle(time_column(rows, self.decimals, self.headers, declared_hz=self.declared_hz, files=out))

    @cached_property
    def types(self) -> DataFrame:
        return settle(column_types(self.data, self.decimals))

    @property
    def status(self) -> DataFrame:
        """``(file, status, reason)`` of every file: what stands in the way of its samples."""
        files = (self.lines if self.counted is None else self.counted).select("file").distinct()  # lines counted need not be read for it
        out = files.join(self.dialects.select("file", F.col("notice").alias("_dn"), "delimiter"), "file", "left")
        out = out.join(self.structure.select("file", "data_start"), "file", "left")
        out = out.join(self.time.select("file", "class", "hz"), "file", "left")
        reason = (
            F.when(F.col("delimiter").isNull(), F.coalesce("_dn", F.lit("no_lines")))
            .when(F.col("data_start").isNull(), "no_data_row")
            .when((F.col("class") == "absent") & F.col("hz").isNull(), "no_time_column")
            .when((F.col("class") == "counter") & F.col("hz").isNull(), "counter_without_frequency")
        )
        numeric = F.col("type").isin("integer", "decimal")
        unread = self.types.groupBy("file").agg(F.sum(F.when(numeric, F.col("non_numeric")).otherwise(0)).alias("unreadable_cells"))
        out = out.join(unread, "file", "left")
        return out.select(
            "file", F.when(reason.isNull(), "ok").otherwise("error").alias("status"), reason.alias("reason"),
            F.coalesce("unreadable_cells", F.lit(0)).alias("unreadable_cells"),
        )
