"""Channel names: normalisation and role assignment."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

# Fixed value: what separates words inside a channel name.
SEPARATORS = r"[\s_\-./\\()\[\]{}:,;+]+"
_ASCII = "^[\\x00-\\x7F]*$"


@functools.cache
def _plain_letters() -> list[tuple[str, str]]:
    """Every character that compatibility decomposition changes, with what is left without marks."""
    rows = []
    for code in range(0x80, 0x110000):
        if not 0xD800 <= code < 0xE000:
            c = chr(code)
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if plain != c:
                rows.append((c, plain))
    return rows


def _without_marks(names: DataFrame) -> DataFrame:
    """``(_name, _plain)`` of distinct names, letter by letter through the table of plain letters.

    Decomposition works on each character by itself and the marks it reorders are dropped, so
    the letters' results in their order are the name's.
    """
    letters = names.select("_name", F.posexplode(F.regexp_extract_all("_name", F.lit("(?s)(.)"), F.lit(1))).alias("_at", "_c"))
    table = names.sparkSession.createDataFrame(_plain_letters(), "_c string, _p string")
    plain = letters.join(table, "_c", "left").select("_name", "_at", F.coalesce("_p", "_c").alias("_p"))
    spelled = F.sort_array(F.collect_list(F.struct("_at", "_p")))
    return plain.groupBy("_name").agg(F.array_join(F.transform(spelled, lambda x: x["_p"]), "").alias("_plain"))


def normalise(name: Column) -> Column:
    """Lower case without separators; exact for ASCII names, all inside the JVM."""
    return F.lower(F.regexp_replace(name, SEPARATORS, ""))


def with_normalised(df: DataFrame, name: str, out: str) -> DataFrame:
    """Append the fully normalised name, resolving accents on the distinct names."""
    odd = _without_marks(df.select(F.col(name).alias("_name")).filter(~F.col("_name").rlike(_ASCII)).distinct())
    return (
        df.join(odd, df[name] == odd["_name"], "left")
        .withColumn(out, normalise(F.coalesce("_plain", F.col(name))))
        .drop("_name", "_plain")
    )


def role_table(roles: DataFrame) -> DataFrame:
    """Synonyms exploded in catalogue order with their kind and match key.

    ``roles(ord, role, synonyms)``; a synonym with ``{n}`` matches an index.
    """
    flat = roles.select("ord", "role", F.posexplode("synonyms").alias("pos", "synonym"))
    indexed = F.col("synonym").contains("{n}")
    flat = flat.withColumn("_text", F.replace("synonym", F.lit("{n}"), F.lit("")))
    flat = with_normalised(flat.withColumn("indexed", indexed), "_text", "_key")
    head = F.substring_index("synonym", "{n}", 1)
    tail = F.substring_index("synonym", "{n}", -1)
    flat = with_normalised(flat.withColumns({"_head": head, "_tail": tail}), "_head", "_h")
    flat = with_normalised(flat, "_tail", "_t")
    return flat.select(
        "ord", "pos", "role", "synonym", "indexed",
        F.col("_key").alias("key"),
        F.when(F.col("indexed"), F.concat(F.lit("^\\Q"), "_h", F.lit("\\E(\\d+)\\Q"), "_t", F.lit("\\E$"))).alias("pattern"),
        F.when(F.col("indexed"), F.col("_h")).alias("head"),
    )


def assign_roles(channels: DataFrame, roles: DataFrame, cutoff: float = 0.85, name: str = "name") -> DataFrame:
    """Role of each channel name: exact synonym, indexed pattern, closest name.

    Works on the distinct names: an equi-join, then a pattern join keyed on the
    name with its digits removed, then closeness for what is left.
    """
    table = role_table(roles)
    names = with_normalised(channels.select(F.col(name).alias("name")).distinct(), "name", "key").filter(
        F.col("key") != ""
    )
    order = F.struct("ord", "pos")
    plain = table.filter(~F.col("indexed"))
    exact_keys = plain.groupBy("key").agg(F.min_by(F.struct("role", "synonym"), order).alias("_r"))
    exact = names.join(exact_keys, "key").select(
        "name", "key", "_r.role", "_r.synonym",
        F.lit("exact").alias("confidence"), F.lit(None).cast("int").alias("index"), F.lit(1.0).alias("ratio"),
    )
    rest = names.join(exact.select("key"), "key", "left_anti")
    stem = F.regexp_replace("key", r"\d+", "")
    patterns = table.filter("indexed").select(
        "ord", "pos", "role", "synonym", "pattern", F.regexp_replace("key", r"\d+", "").alias("_stem")
    )
    hits = (
        rest.withColumn("_stem", stem)
        .join(patterns, "_stem")
        .filter(F.rlike("key", F.col("pattern")))
    )
    indexed = hits.groupBy("name", "key").agg(F.min_by(F.struct("role", "synonym", "pattern"), order).alias("_r")).select(
        "name", "key", "_r.role", "_r.synonym",
        F.lit("indexed").alias("confidence"),
        F.expr("regexp_extract(key, _r.pattern, 1)").try_cast("int").alias("index"),
        F.lit(1.0).alias("ratio"),
    )
    rest = rest.join(indexed.select("key"), "key", "left_anti")
    fuzzy = _closest(rest, exact_keys, cutoff)
    return exact.unionByName(indexed).unionByName(fuzzy)


def _closest(names: DataFrame, exact_keys: DataFrame, cutoff: float) -> DataFrame:
    """Best synonym per remaining key by the share of matching blocks, if it reaches the cutoff.

    The share is twice the matched characters over both lengths, where matching takes the
    longest common block (the first in the synonym, then in the key) and goes on left and
    right of it; equal shares go to the greatest synonym.

    A share of ``cutoff`` leaves so few characters unmatched that of the key, cut into one
    piece more, at least one piece is whole inside the synonym: candidates are an equi-join of
    pieces with substrings, and only they are compared.
    """
    if not 2 / 3 < cutoff <= 1:
        raise ValueError("the cutoff must lie between 2/3 and 1")
    keys = names.select(F.col("key").alias("w")).distinct()
    loose = 2 * (1 - cutoff) / cutoff
    n = F.least(F.floor(F.length("w") * loose + 1e-9) + 1, F.length("w")).cast("int")
    cut = lambda i: F.floor(i * F.length("w") / n).cast("int")
    pieces = keys.select(
        "w", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("w"), cut(i) + 1, cut(i + 1) - cut(i)))).alias("piece")
    )
    pool = exact_keys.select(F.col("key").alias("x")).filter("x <> ''")
    at = F.sequence(F.lit(1), F.length("x"))
    substrings = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.length("x") - i + 1), lambda k: F.substring(F.col("x"), i, k))))
    parts = pool.select("x", F.explode(F.array_distinct(substrings)).alias("piece"))
    total = F.length("w") + F.length("x")
    pairs = pieces.join(parts, "piece").select("w", "x").distinct()
    pairs = settle(pairs.filter(2 * F.least(F.length("w"), F.length("x")) >= cutoff * total - 1e-9))
    scored = pairs.join(_matched(pairs), ["w", "x"], "left").select("w", "x", (2 * F.coalesce("m", F.lit(0)) / total).alias("ratio"))
    best = scored.filter(F.col("ratio") >= cutoff).groupBy("w").agg(F.max(F.struct("ratio", "x")).alias("_b"))
    found = best.select(F.col("w").alias("key"), F.col("_b.x").alias("_k"), F.col("_b.ratio").alias("ratio"))
    keyed = exact_keys.select(F.col("key").alias("_k"), "_r")
    return names.join(found, "key").join(keyed, "_k").select(
        "name", "key", "_r.role", "_r.synonym",
        F.lit("fuzzy").alias("confidence"), F.lit(None).cast("int").alias("index"), "ratio",
    )


def _matched(pairs: DataFrame) -> DataFrame:
    """``(w, x, m)``: characters of the pairs in matching blocks. Each round splits every open stretch."""
    a, b = F.col("a"), F.col("b")
    blocks = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length(a)),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.length(a) - i + 1),
                lambda k: F.struct(k.alias("k"), (-i).alias("early"), F.substring(a, i, k).alias("s")),
            ),
        )
    )
    longest = F.array_max(F.filter(blocks, lambda t: F.contains(b, t["s"])))
    open_ = pairs.select("w", "x", F.col("x").alias("a"), F.col("w").alias("b"))
    found = []
    while True:
        hit = settle(open_.withColumn("_l", longest).filter("_l IS NOT NULL"))
        if hit.isEmpty():
            break
        found.append(hit.select("w", "x", F.col("_l.k").alias("k")))
        i, j, k = -F.col("_l.early"), F.instr(b, F.col("_l.s")), F.col("_l.k")
        left = F.struct(F.substring(a, F.lit(1), i - 1).alias("a"), F.substring(b, F.lit(1), j - 1).alias("b"))
        right = F.struct(F.substring(a, i + k, F.length(a)).alias("a"), F.substring(b, j + k, F.length(b)).alias("b"))
        open_ = hit.select("w", "x", F.explode(F.array(left, right)).alias("_s")).select("w", "x", "_s.*").filter("a <> '' AND b <> ''")
    if not found:
        return pairs.select("w", "x", F.lit(0).alias("m")).limit(0)
    return functools.reduce(DataFrame.unionByName, found).groupBy("w", "x").agg(F.sum("k").alias("m"))
