"""Which channels of different logs are the same channel.

Channels are consumed layer by layer: manual pairs, role and index, format and
native id, normalised name. Every step groups by (key, log); no step gathers all
logs of a key, so a role present in every log stays spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

KEYS = ["log_id", "channel_id"]


def _decided(cited: DataFrame) -> DataFrame:
    """``pair, ord, kept``: which user pairs keep at least two channels, taken in ``ord``.

    A pair gets the channels that no earlier kept pair cites, so pairs depend on earlier ones. A round
    decides every pair that has two logs left whatever undecided earlier pairs do, or has not even if
    they all go; the first undecided one is always among them. Without a channel cited twice there is
    nothing to wait for.
    """
    pairs = cited.groupBy("pair").agg(F.min("ord").alias("ord"))
    logs = cited.groupBy("pair").agg((F.count_distinct("log_id") >= 2).alias("kept"))
    if cited.groupBy(*KEYS).agg(F.count_distinct("pair").alias("_n")).where("_n > 1").isEmpty():
        return pairs.join(logs, "pair")
    known = settle(pairs.withColumn("kept", F.lit(None).cast("boolean")))
    rows = settle(cited.select("pair", *KEYS).distinct())
    while not known.where("kept IS NULL").isEmpty():
        mine = rows.join(known, "pair")
        earlier = Window.partitionBy(*KEYS).orderBy("ord", "pair").rowsBetween(Window.unboundedPreceding, -1)
        taken = F.coalesce(F.max(F.coalesce("kept", F.lit(False))).over(earlier), F.lit(False))
        maybe = F.coalesce(F.max(F.coalesce("kept", F.lit(True))).over(earlier), F.lit(False))
        count = lambda c: F.count_distinct(F.when(~F.col(c), F.col("log_id")))
        sums = mine.withColumns({"_t": taken, "_m": maybe}).groupBy("pair").agg(count("_m").alias("_least"), count("_t").alias("_most"))
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("_least") >= 2, True).when(F.col("_most") < 2, False)
        known = settle(known.join(sums, "pair").select("pair", "ord", now.alias("kept")))
    return known


def _cited(channels: DataFrame, manual: DataFrame) -> DataFrame:
    return channels.join(manual.select("ord", "pair", *KEYS).distinct(), KEYS)


def manual_layer(channels: DataFrame, manual: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """Members of user pairs with at least two existing channels.

    ``manual(ord, pair, log_id, channel_id)``; a channel cited twice belongs to the
    first pair in ``ord`` that is kept.
    """
    cited = _cited(channels, manual)
    kept = (_decided(cited) if decided is None else decided).where("kept").select("pair")
    first = F.row_number().over(Window.partitionBy(*KEYS).orderBy("ord", "pair"))
    return cited.join(kept, "pair", "left_semi").withColumn("_k", first).filter("_k = 1").select(
        F.lit("manual").alias("layer"), F.concat(F.lit("manual:"), "pair").alias("group_id"), *KEYS
    )


def manual_notices(channels: DataFrame, manual: DataFrame) -> DataFrame:
    """``code, pair, log_id, channel_id``: what of the user's pairs could not be applied, or looks odd.

    ``manual_not_applicable`` names a cited channel that does not exist or that an earlier kept pair
    cites; ``manual_dropped`` a pair left with fewer than two logs, whose channels go on to the other
    layers; ``manual_contradicts_role`` a kept pair of channels with different roles.
    """
    cited = _cited(channels, manual)
    known = _decided(cited)
    asked = manual.select("ord", "pair", *KEYS).distinct()
    pairs = asked.groupBy("pair").agg(F.min("ord").alias("ord")).join(known.select("pair", "kept"), "pair", "left")
    pairs = settle(pairs.withColumn("kept", F.coalesce("kept", F.lit(False))))
    there = channels.select(*KEYS, F.lit(True).alias("_there")).distinct()
    earlier = Window.partitionBy(*KEYS).orderBy("ord", "pair").rowsBetween(Window.unboundedPreceding, -1)
    rows = asked.drop("ord").join(pairs, "pair").join(there, KEYS, "left")
    rows = rows.withColumn("_taken", F.coalesce(F.max("kept").over(earlier), F.lit(False)))
    lost = rows.where(F.col("_there").isNull() | F.col("_taken")).select(F.lit("manual_not_applicable").alias("code"), "pair", *KEYS)
    blank = [F.lit(None).cast(channels.schema[k].dataType).alias(k) for k in KEYS]
    dropped = pairs.where("NOT kept").select(F.lit("manual_dropped").alias("code"), "pair", *blank)
    members = manual_layer(channels, manual, known).select(F.expr("substring(group_id, 8)").alias("pair"), *KEYS).join(channels, KEYS)
    odd = members.groupBy("pair").agg(F.count_distinct("role").alias("_roles")).where("_roles > 1")
    return lost.unionByName(dropped).unionByName(odd.select(F.lit("manual_contradicts_role").alias("code"), "pair", *blank))


def one_layer(channels: DataFrame, layer: str, key: Column) -> DataFrame:
    """Fill ``layer`` and ``group_id`` of unclaimed channels that own their key.

    The first channel by id per (key, log) wins. Claimed and keyless rows get a key
    of their own, so no window partition is larger than one key of one log.
    """
    free = F.col("group_id").isNull()
    work = channels.withColumn("_key", F.when(free, key))
    own = F.coalesce("_key", F.concat(F.lit("-"), "channel_id"))
    w = Window.partitionBy("log_id", own).orderBy("channel_id")
    wins = F.col("_key").isNotNull() & (F.row_number().over(w) == 1)
    return (
        work.withColumn("_wins", wins)
        .withColumns(
            {
                "layer": F.when(F.col("_wins"), layer).otherwise(F.col("layer")),
                "group_id": F.when(F.col("_wins"), F.col("_key")).otherwise(F.col("group_id")),
            }
        )
        .drop("_key", "_wins")
    )


def role_key() -> Column:
    index = F.when(F.col("role_index").isNotNull(), F.concat(F.lit("#"), F.col("role_index"))).otherwise("")
    return F.when(F.col("role").isNotNull(), F.concat(F.lit("role:"), "role", index))


def native_key() -> Column:
    return F.when(
        F.col("format").isNotNull() & F.col("native_id").isNotNull(),
        F.concat(F.lit("native:"), "format", F.lit(":"), "native_id"),
    )


def name_key() -> Column:
    return F.when(F.col("name_key") != "", F.concat(F.lit("name:"), "name_key"))


def assign_groups(channels: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """All channels with their ``layer`` and ``group_id``, NULL where none claims them.

    ``channels(log_id, channel_id, role, role_index, format, native_id, name_key)``.
    One window per layer over (log, key); nothing is joined back.
    """
    if manual is None:
        work = channels.withColumns({"layer": F.lit(None).cast("string"), "group_id": F.lit(None).cast("string")})
    else:
        work = channels.join(manual_layer(channels, manual), KEYS, "left")
    for layer, key in (("role", role_key()), ("native", native_key()), ("name", name_key())):
        work = one_layer(work, layer, key)
    return work


def match_channels(channels: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """``(layer, group_id, log_id, channel_id)`` of every channel some layer claims."""
    out = assign_groups(channels, manual).filter(F.col("group_id").isNotNull())
    return out.select("layer", "group_id", *KEYS)


def identity_notices(channels: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Channels no layer could claim, with the reason."""
    loose = assign_groups(channels, manual).filter(F.col("group_id").isNull())
    has_key = role_key().isNotNull() | native_key().isNotNull() | F.coalesce(name_key().isNotNull(), F.lit(False))
    return loose.select(
        *KEYS,
        F.when(has_key, "same_log_same_group").otherwise("no_identity").alias("code"),
    )


def group_summary(matched: DataFrame) -> DataFrame:
    return matched.groupBy("layer", "group_id").agg(
        F.count_distinct("log_id").alias("logs"),
        F.min(F.struct("log_id", "channel_id")).alias("_f"),
    ).select("layer", "group_id", "logs", F.col("_f.channel_id").alias("label"))
