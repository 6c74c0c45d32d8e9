"""Analysis profiles applied to the channels of each log, and import profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .config import with_each
from .lookup import measured

# Fixed value: confidence levels, best first.
CONFIDENCE = ["exact", "indexed", "fuzzy", "manual"]


def _rank():
    rank = F.lit(len(CONFIDENCE))
    for i, c in reversed(list(enumerate(CONFIDENCE))):
        rank = F.when(F.col("confidence") == c, i).otherwise(rank)
    return rank


def apply_profiles(elements: DataFrame, channels: DataFrame) -> DataFrame:
    """Each panel element per log with the channel that serves it.

    ``elements(profile, panel, pos, role, role_index, native_id, required)`` is
    configuration and is broadcast; ``channels(log_id, channel_id, role, role_index,
    native_id, confidence)``. By role and index the best confidence wins, then the
    first channel id; elements without a role go by native id.
    """
    best = Window.partitionBy("log_id", "role", "role_index").orderBy(_rank(), "channel_id")
    by_role = (
        channels.filter(F.col("role").isNotNull())
        .withColumn("_k", F.row_number().over(best))
        .filter("_k = 1")
        .select(F.col("log_id").alias("_l"), F.col("role").alias("_r"), F.col("role_index").alias("_i"), F.col("channel_id").alias("_by_role"))
    )
    by_id = (
        channels.filter(F.col("native_id").isNotNull())
        .groupBy(F.col("log_id").alias("_m"), F.col("native_id").alias("_n"))
        .agg(F.min("channel_id").alias("_by_id"))
    )
    per_log = with_each(channels.select("log_id").distinct(), elements)
    role, index = F.col("role"), F.col("role_index")
    out = per_log.join(
        by_role, (F.col("log_id") == F.col("_l")) & (role == F.col("_r")) & index.eqNullSafe(F.col("_i")), "left"
    )
    out = out.join(
        by_id, (F.col("log_id") == F.col("_m")) & (F.col("native_id") == F.col("_n")) & role.isNull(), "left"
    )
    return out.withColumn("served_by", F.coalesce("_by_role", "_by_id")).drop("_l", "_r", "_i", "_by_role", "_m", "_n", "_by_id")


def panel_states(applied: DataFrame) -> DataFrame:
    """Visibility and role coverage of each panel per log."""
    served = F.col("served_by").isNotNull()
    return applied.groupBy("log_id", "profile", "panel").agg(
        (~F.coalesce(F.max(F.col("required") & F.col("role").isNotNull() & ~served), F.lit(False))).alias("visible"),
        F.count_distinct(F.when(served, F.col("role"))).alias("available"),
        F.count_distinct("role").alias("roles"),
    )


def suggest(
    elements: DataFrame, channels: DataFrame, limit_roles: DataFrame | None = None
) -> DataFrame:
    """Profiles per log by the share of their roles that is available.

    Empty and fuzzily assigned channels do not count, nor do roles that only appear
    in hidden panels. ``limit_roles(profile, role)`` adds roles outside any panel.
    """
    useful = channels.filter(~F.coalesce("is_empty", F.lit(False)) & (F.coalesce("confidence", F.lit("exact")) != "fuzzy"))
    logs = channels.select("log_id").distinct()
    applied = apply_profiles(elements, useful)
    shown = panel_states(applied).filter("visible").select("log_id", "profile", "panel")
    from_panels = (
        applied.filter(F.col("served_by").isNotNull() & F.col("role").isNotNull())
        .join(shown, ["log_id", "profile", "panel"], "left_semi")
        .select("log_id", "profile", "role")
    )
    referenced = elements.filter(F.col("role").isNotNull()).select("profile", "role").distinct()
    all_roles = referenced
    if limit_roles is not None:
        only_limits = limit_roles.select("profile", "role").distinct().join(referenced, ["profile", "role"], "left_anti")
        here = useful.filter(F.col("role").isNotNull()).select("log_id", "role").distinct()
        from_panels = from_panels.unionByName(here.join(only_limits, "role").select("log_id", "profile", "role"))
        all_roles = referenced.unionByName(only_limits)
    have = from_panels.distinct().groupBy("log_id", "profile").agg(F.count(F.lit(1)).alias("available"))
    totals = all_roles.groupBy("profile").agg(F.count(F.lit(1)).alias("roles"))
    grid = with_each(logs, totals)
    out = grid.join(have, ["log_id", "profile"], "left").withColumn("available", F.coalesce("available", F.lit(0)))
    out = out.withColumn("share", F.coalesce(F.try_divide(F.col("available").cast("double"), F.col("roles")), F.lit(0.0)))
    w = Window.partitionBy("log_id").orderBy(F.col("share").desc(), F.col("available").desc(), "profile")
    return out.withColumn("place", F.row_number().over(w))


def best_suggestion(suggestions: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Top suggestion per log where it covers enough."""
    return suggestions.filter((F.col("place") == 1) & (F.col("share") >= minimum))


def _meetings(current: DataFrame, saved: DataFrame, by: list[str]) -> DataFrame:
    """Per file and profile that share a column key: rows that match, and the rows of either side among them.

    An index from key to profiles meets the files' keys (``by``: the key and whatever must be equal too), so
    work and output follow the hits; keys are counted first, so repeated columns do not multiply. The index
    goes to every task where it is measured to be small.
    """
    here = current.groupBy("file", *by).agg(F.count(F.lit(1)).alias("_here"))
    index = measured(saved.groupBy("profile", *by).agg(F.count(F.lit(1)).alias("_there")))
    return here.join(index, by).groupBy("file", "profile").agg(
        F.sum(F.col("_here") * F.col("_there")).alias("matched"), F.sum("_here").alias("_met"), F.sum("_there").alias("_used")
    )


def _counted(pairs: DataFrame, met: DataFrame, current: DataFrame, saved: DataFrame, how: str) -> DataFrame:
    """Pairs with their matched, new and lost columns; all three NULL where neither side has a column."""
    wide = current.groupBy("file").agg(F.count(F.lit(1)).alias("_wide"))
    kept = saved.groupBy("profile").agg(F.count(F.lit(1)).alias("_kept"))
    out = pairs.join(met, ["file", "profile"], how).join(wide, "file", "left").join(kept, "profile", "left")
    none = F.col("_wide").isNull() & F.col("_kept").isNull()

    def left_over(of: str, used: str) -> Column:
        return F.when(~none, F.coalesce(of, F.lit(0)) - F.coalesce(used, F.lit(0)))

    out = out.withColumns({"new": left_over("_wide", "_met"), "lost": left_over("_kept", "_used")})
    return out.withColumn("matched", F.when(~none, F.coalesce("matched", F.lit(0)))).drop("_wide", "_kept", "_met", "_used")


def _columns(outcome: DataFrame, current: DataFrame, saved: DataFrame) -> DataFrame:
    """The current columns of each pair with the decision that holds for them."""
    old = measured(
        saved.select(F.col("profile").alias("_p"), F.col("key").alias("_k"), F.col("decision").alias("_saved"), "origin")
    )
    cur = current.select("file", "key", "name", "decision").join(outcome.select("file", "profile", "outcome"), "file")
    met = cur.join(old, (F.col("profile") == F.col("_p")) & (F.col("key") == F.col("_k")), "left")
    return met.select(
        "file", "profile", "key", "name", F.when(F.col("_p").isNull(), "new").otherwise("matched").alias("state"),
        F.when((F.col("outcome") != "none") & (F.col("origin") == "confirmed"), F.col("_saved"))
        .otherwise(F.col("decision")).alias("decision"),
    )


def _same_layout() -> Column:
    return (F.col("fingerprint") == F.col("_f")) & (F.col("new") == 0) & (F.col("lost") == 0)


OUTCOME = ["file", "profile", "outcome", "matched", "new", "lost"]


def reapply_import(saved: DataFrame, current: DataFrame, files: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Re-apply saved import decisions to new files: ``(columns, outcome)`` of every file with every profile.

    ``saved(profile, key, name, decision, origin)``, ``current(file, key, name,
    decision)``, ``files(file, delimiter, encoding, fingerprint)``, ``profile(profile,
    delimiter, encoding, fingerprint)``. Per current column a confirmed saved decision
    wins, a guessed one is refreshed; columns are matched on the normalised name, and a
    column without a key matches none.
    """
    p = profile.select(
        "profile", F.col("delimiter").alias("_d"), F.col("encoding").alias("_e"), F.col("fingerprint").alias("_f")
    )
    counted = _counted(with_each(files, p), _meetings(current, saved, ["key"]), current, saved, "left")
    usable = (
        (F.col("delimiter") == F.col("_d")) & (F.col("encoding") == F.col("_e")) & (F.coalesce("matched", F.lit(0)) > 0)
    )
    outcome = counted.withColumn(
        "outcome", F.when(~F.coalesce(usable, F.lit(False)), "none").when(_same_layout(), "total").otherwise("partial")
    ).select(*OUTCOME)
    return _columns(outcome, current, saved), outcome


def find_imports(saved: DataFrame, current: DataFrame, files: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``reapply_import`` whose outcome is not ``none``, for any number of files and profiles.

    Files meet only profiles of the same delimiter and encoding that share a column key with them, so no
    pair without a hit is ever made.
    """
    by = ["key", "delimiter", "encoding"]
    here = current.join(files.select("file", "delimiter", "encoding"), "file")
    there = saved.join(profile.select("profile", "delimiter", "encoding"), "profile")
    met = _meetings(here, there, by)
    pairs = met.select("file", "profile").join(files.select("file", "fingerprint"), "file")
    pairs = pairs.join(profile.select("profile", F.col("fingerprint").alias("_f")), "profile")
    counted = _counted(pairs, met, current, saved, "inner")
    outcome = counted.withColumn("outcome", F.when(_same_layout(), "total").otherwise("partial")).select(*OUTCOME)
    return _columns(outcome, current, saved), outcome
