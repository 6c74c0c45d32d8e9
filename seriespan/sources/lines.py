"""Text files as numbered lines, and the fields of a line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from . import ranges
from .listing import files_of, tree


def read_lines(spark: SparkSession, path: str | Sequence[str] | DataFrame) -> DataFrame:
    """``lines(file, bytes, line, text)`` of every file below ``path``, ``line`` from 0.

    See ``ranges``: any encoding with a byte-order mark, any line end, files cut into ranges. Where
    single files may be broken, ``ranges.scan`` gives them a status instead; here one that cannot be
    read to its end is an error, so lines are never left out silently.
    """
    files = settle(files_of(tree(spark, path)))
    scanned = ranges.scan(files)
    broken = scanned.where("error IS NOT NULL").select("path", "error")
    some = broken.limit(3).collect()
    if some:
        raise ValueError(f"{broken.select('path').distinct().count()} files cannot be read to their end: {[tuple(r) for r in some]}")
    return ranges.lines(files, scanned)


def listing(spark: SparkSession, path: str | Sequence[str] | DataFrame) -> DataFrame:
    """``listing(path, size, mtime)`` without reading any content; empty files have size 0."""
    return files_of(tree(spark, path)).select("path", "size", "mtime")


#: Stands for a quote behind a backslash while a line is cut; a private code point that texts do not use.
ESCAPED = "\uf8f1"


def _shield(text: Column, quote: Column) -> Column:
    """Quotes behind a backslash neither open nor close a field."""
    return F.replace(text, F.concat(F.lit("\\"), quote), F.lit(ESCAPED))


def unquoted(text: Column, quote: Column) -> Column:
    """A line without its quoted stretches."""
    inside = F.concat(quote, F.lit("[^"), quote, F.lit("]*"), quote)
    return F.when(F.contains(text, quote), F.regexp_replace(_shield(text, quote), inside, F.lit(""))).otherwise(text)


def field_count(text: Column, delimiter: Column, quote: Column | None = None) -> Column:
    """Fields of a line; delimiters inside quotes do not count."""
    bare = text if quote is None else unquoted(text, quote)
    # by octets: no text has to be decoded to be counted
    removed = F.octet_length(bare) - F.octet_length(F.replace(bare, delimiter, F.lit("")))
    return (removed / F.octet_length(delimiter)).cast("int") + 1


#: Stands for a delimiter between quotes while a line is cut; lines that hold it are cut by a pattern instead.
MASKED = "\uf8f2"


def split_fields(text: Column, delimiter: Column, quote: Column | None = None) -> Column:
    """Fields of a line as an array, quotes removed and doubled quotes undone."""
    # One-character patterns split without the regex engine; only the bar needs quoting.
    literal = F.when(delimiter == "|", F.lit("\\|")).otherwise(delimiter)
    plain = F.split(text, literal, -1)
    if quote is None:
        return plain
    # A field is what lies between delimiters: runs without either sign, quoted stretches, lone quotes.
    # Possessive steps never look back, so the time is linear in the line.
    inside = F.concat(F.lit("(?:[^"), quote, delimiter, F.lit("]++|"), quote, F.lit("[^"), quote, F.lit("]*+"), quote, F.lit("|"), quote, F.lit(")*+"))
    field = F.concat(F.lit("["), delimiter, F.lit("]("), inside, F.lit(")"))
    wrapped = F.concat(F.lit("(?s)^\\s*"), quote, F.lit("(.*)"), quote, F.lit("\\s*$"))
    undo = lambda x: F.replace(F.replace(x, F.concat(quote, quote), quote), F.lit(ESCAPED), quote)
    shielded = _shield(text, quote)
    cut = F.transform(
        F.regexp_extract_all(F.concat(delimiter, shielded), field, F.lit(1)),
        lambda x: undo(F.regexp_replace(x, wrapped, F.lit("$1"))),
    )
    # Where all quotes are paired no pattern is needed: every second part between quotes is quoted, and its delimiters are masked.
    masked = F.transform(F.split(shielded, quote, -1), lambda x, i: F.when(i % 2 == 1, F.replace(x, delimiter, F.lit(MASKED))).otherwise(x))

    def bare(x: Column) -> Column:
        whole = F.replace(x, F.lit(MASKED), delimiter)
        ends = F.startswith(x, quote) & F.endswith(x, quote) & (F.octet_length(x) > 1)
        inner = F.when(ends, F.substring(whole, F.lit(2), F.length(whole) - 2)).otherwise(F.regexp_replace(whole, wrapped, F.lit("$1")))
        return F.when(F.contains(x, quote), undo(inner)).otherwise(F.replace(x, F.lit(ESCAPED), quote))

    paired = F.transform(F.split(F.call_function("array_join", masked, quote), literal, -1), bare)
    even = (F.octet_length(shielded) - F.octet_length(F.replace(shielded, quote, F.lit("")))) % 2 == 0
    return F.when(~F.contains(text, quote), plain).when(even & ~F.contains(text, F.lit(MASKED)), paired).when(F.contains(text, quote), cut).otherwise(plain)
