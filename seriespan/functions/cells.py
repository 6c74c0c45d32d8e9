"""Text cells to typed values, as column expressions and grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog.units import INT32_SENTINELS, TEXT_SENTINELS
from ..operators.lookup import attach_apart
from ..session import settle

# Cell shapes and boolean pairs.
INTEGER = r"^[+-]?\d+$"
THREE_DIGITS = r"^[+-]?[1-9]\d{0,2}([.,])(\d{3})$"
CLEAR_DECIMAL = r"^[+-]?\d+([.,])\d+$"
REPEATED_GROUPS = r"^[+-]?[1-9]\d{0,2}([.,]\d{3}){2,}+$"
BOTH_SEPARATORS = r"^[+-]?[1-9]\d{0,2}(([.,])\d{3})+([.,])(\d+)$"
ISO_TIME = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})([.,]\d+)?(Z|[+-]\d{2}:?\d{2})?$"
CLOCK_TIME = r"^\d{1,2}:\d{2}:\d{2}([.,]\d+)?$"
TIME_MARK = (
    r"^(\d{1,2}:\d{1,2}(:\d{1,2}([.,]\d+)?)?"
    r"|\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}(:\d{1,2}([.,]\d+)?)?)?[A-Z+\-:0-9]*"
    r"|\d{8}"
    r"|\d{1,2}/\d{1,2}/\d{2,4})$"
)
DATE_ONLY = r"^(\d{4}-\d{2}-\d{2}|\d{8}|\d{1,2}/\d{1,2}/\d{4})$"
UNIT_CHARS = "A-Za-zµΩλφ°%/"
BRACKET_UNIT = r"^(.*\S)\s*\[([^\[\]]{1,24})\]\s*$"
PAREN_UNIT = r"^(.*\S)\s*\(([^()]{1,24})\)\s*$"
SUFFIX_UNIT = r"^[A-Za-zµΩλφ°%./0-9]{1,8}$"
BOOLEAN_PAIRS = [
    ("true", "false"),
    ("on", "off"),
    ("sí", "no"),
    ("si", "no"),
    ("verdadero", "falso"),
    ("yes", "no"),
]
EPOCH_MIN_S = 946684800.0
EPOCH_MAX_S = 4102444800.0
LONGEST_SECOND_STEP = 2.0
MIN_NUMERIC_SHARE = 0.95


def _other(decimal: str) -> str:
    if decimal not in (".", ","):
        raise ValueError("the decimal sign is '.' or ','")
    return "," if decimal == "." else "."


def _digits(text: Column) -> Column:
    """One digit or more and nothing else."""
    return text.rlike(r"^[0-9]+\z")


def _signed_digits(text: Column) -> Column:
    return text.rlike(r"^[+-]?[0-9]+\z")


def _behind(text: Column, head: Column, skip: int) -> Column:
    """What follows ``head`` and ``skip`` characters less one; empty where there is none."""
    return F.substring(text, F.length(head) + skip, F.lit(2**31 - 1))


def _well_formed(number: Column, decimal: str, spaced: bool = False) -> Column:
    """Whether a text is a number, piece by piece.

    The text is cut at the exponent sign, its head at the decimal sign and the whole part at the first grouping
    sign (``spaced``: or a blank). Every piece has digits only; of several groups the first has one to three
    and no leading zero, the others have three. Whole numbers and such with a fraction, the usual ones, are not
    cut, and neither are texts that begin with a letter.
    """
    usual = number.rlike(rf"^[+-]?[0-9]+([{decimal}][0-9]+)?\z")
    scaled = F.substring_index(F.replace(number, F.lit("E"), F.lit("e")), "e", 1)
    whole = F.substring_index(scaled, decimal, 1)
    grouping = _other(decimal)
    parted = F.replace(whole, F.lit(" "), F.lit(grouping)) if spaced else whole
    first = F.substring_index(parted, grouping, 1)
    grouped = first.rlike(r"^[+-]?[1-9][0-9]{0,2}\z") & _behind(parted, first, 1).rlike(rf"^([{grouping}][0-9]{{3}})++\z")
    fraction = (F.length(whole) == F.length(scaled)) | _digits(_behind(scaled, whole, 2))
    one_cut = (F.length(scaled) == F.length(number)) | _signed_digits(_behind(number, scaled, 2))
    return (number < ":") & (usual | ((_signed_digits(whole) | grouped) & fraction & one_cut))


def is_numeric(cell: Column, decimal: str) -> Column:
    """Number under this decimal sign: plain, grouped or scientific; empty counts."""
    t = F.trim(cell)
    return (t == "") | _well_formed(t, decimal)


def looks_like_time(cell: Column) -> Column:
    return F.trim(cell).rlike(TIME_MARK)


def number_shape(cell: Column) -> Column:
    """How a cell is written; the first matching shape wins."""
    t = F.trim(cell)
    mixed = t.rlike(BOTH_SEPARATORS) & (
        F.regexp_extract(t, BOTH_SEPARATORS, 2) != F.regexp_extract(t, BOTH_SEPARATORS, 3)
    )
    # No shape but text begins with a letter; one with a single separator has no groups.
    return (
        F.when(t == "", "empty")
        .when(t >= ":", "text")
        .when(t.rlike(INTEGER), "integer")
        .when(t.rlike(CLEAR_DECIMAL), F.when(t.rlike(THREE_DIGITS), "three_digits").otherwise("decimal"))
        .when(t.rlike(REPEATED_GROUPS), "grouped")
        .when(mixed, "both")
        .otherwise("text")
    )


def _unblanked(text: Column) -> Column:
    """Without blanks, tabs and line breaks at its ends."""
    t = F.trim(text)
    return F.when(((t != "") & (t < " ")) | F.right(t, F.lit(1)).between("\t", "\r"), F.regexp_replace(t, r"^\s+|\s+$", "")).otherwise(t)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once however often it is used.

    It is not compiled: long expressions for rare values, which would keep their whole stage from being compiled, go here.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _number_and_unit(cell: Column, decimal: str) -> Column:
    """What a cell begins with as a number, and the word behind it, as (number, unit); NULL in any other shape.

    A cell that is a number is not cut. Elsewhere the number goes as far as digits, signs and blanks do, and
    on over an exponent that has digits.
    """
    t = F.trim(cell)

    def cut(head: Column) -> Column:
        rest = F.substring(t, F.length(head) + 1, F.lit(2**31 - 1))
        power = F.when(
            F.left(rest, F.lit(1)).isin("e", "E") & ~F.endswith(head, F.lit(" ")),
            F.regexp_extract(rest, "^.[+-]?[0-9]+", 0),
        ).otherwise("")
        unit = F.substring(rest, F.length(power) + 1, F.lit(2**31 - 1))
        return F.struct(F.concat(_unblanked(head), power).alias("number"), _unblanked(unit).alias("unit"))

    def checked(parts: Column) -> Column:
        number, unit = parts["number"], parts["unit"]
        word = unit.rlike(rf"^[0-9{UNIT_CHARS}]+\z") & ~unit.rlike("^[0-9]")
        shape = ((unit == "") | word) & _well_formed(number, decimal, spaced=True)
        return F.when(shape, F.struct(number.alias("number"), F.nullif(unit, F.lit("")).alias("unit")))

    plain = F.struct(t.alias("number"), F.lit(None).cast("string").alias("unit"))
    return F.when((t != "") & _well_formed(t, decimal), plain).when(
        t.rlike(r"^\s*[+-]?[0-9]"), bound(bound(F.regexp_extract(t, r"^\s*[0-9+., -]*", 0), cut), checked)
    )


def number_text(cell: Column, decimal: str) -> Column:
    """The number part of ``3,2 bar``; NULL where the cell has another shape."""
    return _number_and_unit(cell, decimal)["number"]


def unit_text(cell: Column, decimal: str) -> Column:
    return _number_and_unit(cell, decimal)["unit"]


def normalise_thousands(number: Column, decimal: str) -> Column:
    """Drop the grouping sign and blanks and write the decimal sign as a point."""
    out = F.translate(number, f"{_other(decimal)} \t\n\x0b\f\r", "")
    return out if decimal == "." else F.replace(out, F.lit(","), F.lit("."))


def cell_kind(cell: Column) -> Column:
    """empty / overflow / sentinel / data."""
    t = F.trim(F.coalesce(cell, F.lit("")))
    return (
        F.when(t == "", "empty")
        .when(t.isin([str(s) for s in INT32_SENTINELS]), "overflow")
        .when(t.isin(TEXT_SENTINELS), "sentinel")
        .otherwise("data")
    )


def cell_value(cell: Column, decimal: str) -> Column:
    """Number of a cell; missing and non-numeric cells are NULL, never 0."""
    number = normalise_thousands(number_text(cell, decimal), decimal).try_cast("double")
    return F.when(cell_kind(cell) == "data", number)


def pointed(cell: Column, decimal: Column) -> Column:
    """A cell with both signs exchanged where the decimal sign is a comma, so that one reading serves all files."""
    return F.when(decimal == ",", F.translate(cell, ".,", ",.")).otherwise(cell)


def value_under(cell: Column, decimal: Column) -> Column:
    """``cell_value`` under the decimal sign of the row."""
    t = F.trim(pointed(cell, decimal))
    number = F.when(t.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?\z"), t.try_cast("double")).otherwise(
        bound(t, lambda x: normalise_thousands(number_text(x, "."), ".").try_cast("double"))
    )
    return F.when(cell_kind(cell) == "data", number)


def convert_columns(cells: DataFrame, keys: Sequence[str], decimal: str, cell: str = "cell") -> DataFrame:
    """Conversion report per column: counts and the embedded unit's status."""
    c = F.col(cell)
    kind, number, unit = cell_kind(c), number_text(c, decimal), unit_text(c, decimal)
    work = cells.select(
        *keys, kind.alias("_k"), cell_value(c, decimal).alias("_v"),
        F.when(kind == "data", unit).alias("_u"),
        ((kind == "data") & F.coalesce(number.rlike(rf"[{_other(decimal)}\s]"), F.lit(False))).alias("_g"),
    )
    data = F.col("_k") == "data"
    per_unit = work.groupBy(*keys, "_u").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("_k") == "empty").alias("empty"),
        F.count_if(F.col("_k") == "sentinel").alias("sentinels"),
        F.count_if(F.col("_k") == "overflow").alias("overflows"),
        F.count_if(data & F.col("_v").isNotNull()).alias("numeric"),
        F.count_if(data & F.col("_v").isNull()).alias("non_numeric"),
        F.count_if("_g").alias("grouped"),
    )
    counts = ["cells", "empty", "sentinels", "overflows", "numeric", "non_numeric", "grouped"]
    out = per_unit.groupBy(*keys).agg(
        *[F.sum(n).alias(n) for n in counts],
        F.sum(F.when(F.col("_u").isNotNull(), F.col("cells")).otherwise(0)).alias("with_unit"),
        F.count("_u").alias("units"),
        F.min("_u").alias("_first"),
    )
    return out.select(
        *keys, *counts, "with_unit",
        F.when(F.col("units") == 0, "none").when(F.col("units") == 1, "consistent").otherwise("mixed").alias("unit_status"),
        F.when(F.col("units") == 1, F.col("_first")).alias("unit"),
    )


#: What a cell says about the decimal sign: number under a point, under a comma, and its shape.
DOT, COMMA, THREE, CLEAR, GROUPED = 1, 2, 4, 8, 16


def vote_decimal(cells: DataFrame, keys: Sequence[str], cell: str = "cell", delimiter: Column | None = None) -> DataFrame:
    """Decimal sign per file from the cells only one reading explains."""
    c = F.col(cell)
    t = F.trim(c)
    # Usual numbers are told by one pattern: under the other sign they are a number only where three digits follow.
    three = F.substring(t, -4, 1).isin(".", ",") & t.rlike(THREE_DIGITS)
    pointed_one, comma_one = F.contains(t, F.lit(".")), F.contains(t, F.lit(","))
    usual = F.when(three, DOT + COMMA + THREE).when(pointed_one, DOT + CLEAR).otherwise(COMMA + CLEAR)

    def other(x: Column) -> Column:
        shape = number_shape(x)
        return (
            F.when(is_numeric(x, "."), DOT).otherwise(0) + F.when(is_numeric(x, ","), COMMA).otherwise(0)
            + F.when(shape == "three_digits", THREE).when(shape == "decimal", CLEAR).when(shape.isin("both", "grouped"), GROUPED).otherwise(0)
        )

    # a cell without either sign reads alike under both and tells nothing, so it is not looked at
    kind = F.when(~pointed_one & ~comma_one, 0).when(t.rlike(r"^[+-]?[0-9]+[.,][0-9]+\z"), usual).when(t.isNotNull(), bound(t, other))
    sep = F.when(delimiter.isNotNull(), delimiter).otherwise(F.lit("")) if delimiter is not None else F.lit("")
    # Numbers in place of texts: an aggregate of texts would have every cell sorted.
    code = F.when(sep.isin(",", "."), F.ascii(sep)).when(sep > ".", 127).when(sep > ",", 45).otherwise(0)
    work = cells.select(*keys, kind.alias("_s"), code.alias("_sep"))
    has = lambda bit: F.col("_s").bitwiseAND(bit) != 0
    out = work.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(has(DOT) & ~has(COMMA)).alias("only_dot"),
        F.count_if(has(COMMA) & ~has(DOT)).alias("only_comma"),
        F.count_if(has(THREE)).alias("three_digits"),
        F.count_if(has(CLEAR)).alias("clear"),
        F.count_if(has(GROUPED)).alias("grouped"),
        F.max("_sep").alias("_sep"),
    )
    forced = F.when(F.col("_sep") == ord(","), ".").when(F.col("_sep") == ord("."), ",")
    both = (F.col("only_dot") > 0) & (F.col("only_comma") > 0) & forced.isNull()
    unclear = (F.col("three_digits") > 0) & (F.col("grouped") == 0) & (F.col("clear") == 0)
    evidence = (F.col("only_dot") > 0) | (F.col("only_comma") > 0)
    return out.select(
        *keys, "cells", "only_dot", "only_comma", "three_digits",
        F.coalesce(
            forced,
            F.when(F.col("only_comma") > F.col("only_dot"), ",").otherwise("."),
        ).alias("decimal"),
        F.when(forced.isNotNull(), "delimiter").when(evidence, "cross_check").otherwise("no_evidence").alias("reason"),
        (both | unclear).alias("ambiguous"),
    )


def _pair_bits(data: Column) -> Column:
    """What a value is to each boolean pair, as three bits a pair: its first word, its second, anything else."""
    bits = lambda word: sum((1 if word == yes else 2 if word == no else 4) << 3 * i for i, (yes, no) in enumerate(BOOLEAN_PAIRS))
    words = F.lower("_t")
    told = F.lit(0)
    for word in dict.fromkeys(w for both in BOOLEAN_PAIRS for w in both):
        told = F.when(words == word, bits(word)) if word == BOOLEAN_PAIRS[0][0] else told.when(words == word, bits(word))
    # what begins with a digit or a sign is no word, and is not put in lower case
    return F.when(~data, 0).when(F.col("_t") < ":", bits(None)).otherwise(told.otherwise(bits(None)))


def infer_types(
    cells: DataFrame,
    keys: Sequence[str],
    decimal: str | Column,
    cell: str = "cell",
    min_numeric_share: float = MIN_NUMERIC_SHARE,
    free_text_over: int | None = None,
) -> DataFrame:
    """Type of each column from all of its cells.

    Cells collapse to distinct values first, so the per-column step sees each value
    once and keeps counts and flags only; the distinct count is exact. ``free_text``
    marks columns of more than ``free_text_over`` different values. ``decimal`` may be a column that is
    one value in each of ``keys``.
    """
    c = F.trim(F.coalesce(F.col(cell), F.lit("")))
    sign = F.lit(_other(_other(decimal))) if isinstance(decimal, str) else decimal
    fraction = F.contains("_t", F.col("_dec")) | F.contains(F.lower("_t"), F.lit("e"))
    values = (
        cells.select(*keys, sign.alias("_dec"), c.alias("_t"))
        .groupBy(*keys, "_dec", "_t")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_k", cell_kind(F.col("_t")))
    )
    well = is_numeric(F.col("_t"), decimal) if isinstance(decimal, str) else is_numeric(pointed(F.col("_t"), F.col("_dec")), ".")
    numeric = (F.col("_k") == "data") & well
    data = F.col("_k") == "data"
    n = F.col("_n")

    def tally(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(0))

    # numbers and flags only: with a text among the aggregates every value would be sorted
    out = values.groupBy(*keys).agg(
        F.sum(n).alias("cells"),
        tally(F.col("_k") == "empty").alias("empty"),
        tally(F.col("_k") == "sentinel").alias("sentinels"),
        tally(F.col("_k") == "overflow").alias("overflows"),
        tally(numeric).alias("numeric"),
        tally(data & ~numeric).alias("non_numeric"),
        F.count_if(data).alias("distinct"),
        F.coalesce(F.max(numeric & fraction), F.lit(False)).alias("_fraction"),
        F.bit_or(_pair_bits(data)).alias("_pairs"),
    )
    out = settle(out)
    one = out.filter("distinct = 1").select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(keys)]
    texts = cells.select(*keys, c.alias("_t")).join(one, same, "left_semi").filter(cell_kind(F.col("_t")) == "data")
    only = texts.groupBy(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)]).agg(F.min("_t").alias("_only"))
    out = out.join(only, same, "left")
    pair = F.lit(False)
    for i in range(len(BOOLEAN_PAIRS)):
        pair = pair | (F.col("_pairs").bitwiseAND(7 << 3 * i) == 3 << 3 * i)  # both words and nothing else
    with_data = F.col("numeric") + F.col("non_numeric")
    share = F.try_divide(F.col("numeric"), with_data)
    kind_of = (
        F.when(with_data == 0, "empty")
        .when(F.col("distinct") == 1, "constant")
        .when(pair, "boolean")
        .when((share >= min_numeric_share) & F.col("_fraction"), "decimal")
        .when(share >= min_numeric_share, "integer")
        .otherwise("text_enum")
    )
    return out.select(
        *keys, "cells", "empty", "sentinels", "overflows", "numeric", "non_numeric", "distinct",
        kind_of.alias("type"),
        F.col("_only").alias("constant_value"),
        (F.lit(False) if free_text_over is None else F.col("distinct") > free_text_over).alias("free_text"),
    )


def type_notices(types: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per notice a column's type inference raises."""
    mixed = F.col("type").isin("integer", "decimal") & (F.col("non_numeric") > 0)
    notices = F.array_compact(
        F.array(
            F.when(F.col("type") == "empty", "column_empty"),
            F.when(F.col("type") == "constant", "column_constant"),
            F.when(mixed, "column_mixed"),
            F.when((F.col("type") == "text_enum") & F.col("free_text"), "column_free_text"),
        )
    )
    return types.select(*keys, F.explode(notices).alias("code"))


#: A dictionary up to this size is looked up by broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: Labels of one column up to which one task may rank them.
RANKED_ROWS = 1_000_000


def ranked(labels: DataFrame, keys: Sequence[str], size: DataFrame, most: int = RANKED_ROWS) -> DataFrame:
    """``labels`` with ``_rank``, the place of each distinct label in its column from 0.

    Where a column has more than ``most`` labels (``size`` counts them), labels are sorted by ranges and
    ranked inside each range, behind the counts of the ranges before: no column passes one task.
    """
    if (size.agg(F.max("_n")).first()[0] or 0) <= most:
        return labels.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("label")) - 1)
    placed = settle(labels.repartitionByRange(*keys, "label").withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("label")) - 1
    return placed.withColumn("_in", inside).join(shifts, [*keys, "_part"]).withColumn("_rank", (F.col("_in") + F.col("_shift")).cast("int")).drop("_in", "_part", "_shift")


def enum_dictionary(
    cells: DataFrame, keys: Sequence[str], cell: str = "cell", limit: int | None = None, booleans: bool = True
) -> DataFrame:
    """Labels and codes per column; with a ``limit``, columns with more labels have no dictionary.

    Codes are the rank of the label in binary order, or 1 / 0 for one positive and one
    negative boolean word. The ranking sees each label of a column once.
    """
    t = F.trim(F.col(cell))
    labels = settle(cells.filter(t.isNotNull() & ~t.isin(TEXT_SENTINELS)).select(*keys, t.alias("label")).distinct())
    positive = F.lower("label").isin([yes for yes, _ in BOOLEAN_PAIRS])
    negative = F.lower("label").isin([no for _, no in BOOLEAN_PAIRS])
    size = labels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(positive).alias("_yes"), F.count_if(negative).alias("_no")
    )
    if limit is not None:
        size = size.filter(F.col("_n") <= limit)
    kept = ranked(labels, keys, size).join(size, list(keys))
    is_pair = (F.col("_n") == 2) & (F.col("_yes") == 1) & (F.col("_no") == 1) & F.lit(booleans)
    return kept.select(
        *keys, "label", F.when(is_pair, positive.cast("int")).otherwise(F.col("_rank")).alias("code")
    )


def to_codes(cells: DataFrame, dictionary: DataFrame, keys: Sequence[str], cell: str = "cell") -> DataFrame:
    """Append the code of each cell; cells without one are NULL. One label may fill a column."""
    return _look_up(cells, dictionary.select(*keys, "label", "code"), [*keys, "label"], [*map(F.col, keys), F.trim(F.col(cell))])


def _look_up(rows: DataFrame, values: DataFrame, keys: list[str], match: list[Column]) -> DataFrame:
    """Attach the other columns of ``values`` where all ``keys`` equal ``match``.

    Values are settled and measured: up to ``BROADCAST_ROWS`` and ``BROADCAST_BYTES`` of them go to every
    task and no row moves. More meet the rows in a shuffle, in which hot keys are served by broadcast.
    """
    rest = [c for c in values.columns if c not in keys]
    values = settle(values)
    size = values.agg(F.count(F.lit(1)).alias("n"), F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in values.columns), F.lit(0))).alias("b")).first()
    if size["n"] <= BROADCAST_ROWS and (size["b"] or 0) <= BROADCAST_BYTES:
        named = values.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *rest)
        same = F.lit(True)
        for i, m in enumerate(match):
            same = same & (m == F.col(f"_k{i}"))
        return rows.join(F.broadcast(named), same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    known = F.lit(True)
    for m in match:
        known = known & m.isNotNull()
    as_text = lambda cols: F.to_json(F.array(*[c.cast("string") for c in cols]))
    keyed = rows.withColumn("_key", F.when(known, as_text(match)))
    counted = keyed.filter("_key IS NOT NULL").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    counted = settle(counted)
    groups = settle(values.select(as_text([F.col(k) for k in keys]).alias("_key"), *rest).join(counted, "_key"))
    total = counted.agg(F.sum("_n")).first()[0] or 0
    return attach_apart(keyed, groups, "_key", count="_n", total=total).drop("_key")


def decode(samples: DataFrame, dictionary: DataFrame, keys: Sequence[str], code: str = "code") -> DataFrame:
    """Code to label; an unknown code stays as its text."""
    d = dictionary.select(*keys, F.col("code").alias("_code"), F.col("label").alias("_label"))
    found = _look_up(samples, d, [*keys, "_code"], [*map(F.col, keys), F.col(code)])
    return found.select(*samples.columns, F.coalesce("_label", F.col(code).cast("string")).alias("state"))


def name_and_unit(name: Column) -> tuple[Column, Column, Column]:
    """``name [unit]`` or ``name (unit)`` to (name, unit, origin)."""
    bracket, paren = name.rlike(BRACKET_UNIT), name.rlike(PAREN_UNIT)
    unit = F.when(bracket, F.trim(F.regexp_extract(name, BRACKET_UNIT, 2))).when(
        paren, F.trim(F.regexp_extract(name, PAREN_UNIT, 2))
    )
    found = F.coalesce(unit != "", F.lit(False))
    plain = F.when(found & bracket, F.regexp_extract(name, BRACKET_UNIT, 1)).when(
        found & paren, F.regexp_extract(name, PAREN_UNIT, 1)
    ).otherwise(name)
    origin = F.when(found & bracket, "bracket").when(found & paren, "parenthesis").otherwise("none")
    return plain, F.when(found, unit), origin


def presentation_names(headers: DataFrame, keys: Sequence[str], position: str = "pos", name: str = "name") -> DataFrame:
    """Unique display names: blanks become ``col_N``, repeats get ``_2``, ``_3``...

    A repeat's number is its place among equal names. Only in files where a suffixed name
    is also another column's are the names placed one after the other, each at the next
    free suffix.
    """
    base = F.when(F.trim(F.coalesce(F.col(name), F.lit(""))) == "", F.concat(F.lit("col_"), F.col(position) + 1)).otherwise(F.col(name))
    number = F.row_number().over(Window.partitionBy(*keys, "base").orderBy(position))
    shown = F.when(number > 1, F.concat("base", F.lit("_"), number)).otherwise(F.col("base"))
    named = headers.select(*keys, F.col(position), base.alias("base")).withColumn("display", shown)
    clash = named.groupBy(*keys).agg((F.count(F.lit(1)) > F.count_distinct("display")).alias("_clash"))
    plain = named.join(clash.filter("NOT _clash"), list(keys)).select(*keys, position, "base", "display")
    packed = named.join(clash.filter("_clash"), list(keys)).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col("base").alias("n")))).alias("h")
    )

    def place(used: Column, item: Column) -> Column:
        tries = F.sequence(F.lit(1), F.size(used) + 1)
        candidate = F.transform(
            tries, lambda k: F.when(k == 1, item["n"]).otherwise(F.concat(item["n"], F.lit("_"), k.cast("string")))
        )
        free = F.filter(candidate, lambda c: ~F.exists(used, lambda u: u == c))
        return F.concat(used, F.array(free[0]))

    names = F.aggregate("h", F.array().cast("array<string>"), place)
    placed = packed.select(*keys, F.posexplode(names).alias("_i", "display"), F.col("h").alias("_h")).select(
        *keys, F.col("_h")[F.col("_i")]["p"].alias(position), F.col("_h")[F.col("_i")]["n"].alias("base"), "display"
    )
    return plain.unionByName(placed)


def header_fingerprint(headers: DataFrame, keys: Sequence[str], delimiter: Column, encoding: Column) -> DataFrame:
    """sha256 over the normalised names in order, the delimiter and the encoding."""
    from .names import normalise

    packed = headers.withColumns({"_d": delimiter, "_e": encoding}).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("pos", normalise(F.col("name")).alias("n")))).alias("h"),
        F.max("_d").alias("_d"), F.max("_e").alias("_e"),
    )
    text = F.array_join(
        F.concat(F.transform("h", lambda x: x["n"]), F.array("_d", "_e")), chr(31)
    )
    return packed.select(*keys, F.sha2(text, 256).alias("fingerprint"))
