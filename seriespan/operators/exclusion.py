"""Samples to leave out of maps: transients, cuts, protection, transport delay."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import LOG_TIME, any_of_key
from .windows import derivative, window_extremes

REASONS = ["transient", "cut", "protection", "transport_delay"]


@dataclass(frozen=True)
class ExclusionLimits:
    """Every limit is explicit; only the transport delay has a fixed default."""

    throttle_rate_per_s: float
    transient_ms: int
    rate_window_ms: int
    cut_min: float
    protection_min: float
    transport_ms: int = 150


def _columns(throttle: str | None, cut: str | None, protection: str | None) -> dict[str, str | None]:
    return {"transient": throttle, "cut": cut, "protection": protection, "transport_delay": throttle}


def exclusion(
    grid: DataFrame,
    lim: ExclusionLimits,
    *,
    throttle: str | None = None,
    cut: str | None = None,
    protection: str | None = None,
    unconfirmed: Collection[str] = (),
) -> DataFrame:
    """Append ``ex_<reason>`` for every reason that applies to some log, and ``exclude``.

    A reason applies to a log that has its role and has it confirmed: ``unconfirmed`` are
    roles that no log has confirmed, and a column ``confirmed_<role column>`` on the grid
    says it log by log. In a log it does not apply to, ``ex_<reason>`` is NULL and the
    others decide (see ``reasons``): ``exclude`` is the Kleene OR of those that apply, or
    FALSE when none does.
    """
    roles = _columns(throttle, cut, protection)
    applied = {r: c for r, c in roles.items() if c is not None and c not in set(unconfirmed)}
    has = {f"_has_{c}": _usable(grid, c) for c in dict.fromkeys(applied.values())}
    out = any_of_key(grid, LOG_TIME, has) if has else grid
    flags: dict[str, Column] = {}
    if "transient" in applied:
        out = derivative(out, LOG_TIME, F.col(throttle), lim.rate_window_ms, "_rate")
        out = out.withColumn("_hit", (F.abs("_rate") > lim.throttle_rate_per_s).cast("int"))
        out = window_extremes(out, LOG_TIME, -lim.transient_ms, 0, {"_tr": ("max", F.col("_hit"))})
        out = window_extremes(out, LOG_TIME, -lim.transport_ms, 0, {"_td": ("max", F.col("_hit"))})
        flags["transient"], flags["transport_delay"] = F.col("_tr") > 0, F.col("_td") > 0
    if "cut" in applied:
        flags["cut"] = F.col(cut) >= lim.cut_min
    if "protection" in applied:
        flags["protection"] = F.col(protection) >= lim.protection_min
    exclude = F.lit(False)
    for reason, flag in flags.items():
        exclude = exclude | F.when(F.col(f"_has_{applied[reason]}"), flag).otherwise(False)
    flags = {r: F.when(F.col(f"_has_{applied[r]}"), flags[r]) for r in REASONS if r in flags}
    out = out.withColumns({**{f"ex_{r}": c for r, c in flags.items()}, "exclude": exclude})
    return out.drop("_rate", "_hit", "_tr", "_td", *has)


def _usable(grid: DataFrame, column: str) -> Column:
    there = F.col(column).isNotNull()
    return there & F.col(f"confirmed_{column}") if f"confirmed_{column}" in grid.columns else there


def reasons(
    grid: DataFrame,
    *,
    throttle: str | None = None,
    cut: str | None = None,
    protection: str | None = None,
    unconfirmed: Collection[str] = (),
) -> DataFrame:
    """``(log_id, reason, applied, cause)``: for every log, which reasons apply and why others do not.

    ``cause`` is ``missing`` where the log has no value of the role, else ``unconfirmed``.
    """
    roles = _columns(throttle, cut, protection)
    used = [c for c in dict.fromkeys(roles.values()) if c is not None]
    per_log = grid.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.max(F.col(c).isNotNull()).alias(f"_in_{c}") for c in used],
        *[F.coalesce(F.max(_usable(grid, c)), F.lit(False)).alias(f"_ok_{c}") for c in used],
    )
    rows = []
    for reason in REASONS:
        c = roles[reason]
        there = F.lit(False) if c is None else F.col(f"_in_{c}")
        sure = F.lit(False) if c is None or c in set(unconfirmed) else F.col(f"_ok_{c}")
        rows.append(F.struct(F.lit(reason).alias("reason"), (there & sure).alias("applied"), F.when(~there, "missing").when(~sure, "unconfirmed").alias("cause")))
    return per_log.select("log_id", F.explode(F.array(*rows)).alias("_r")).select("log_id", "_r.*")


def kept(excluded: DataFrame) -> DataFrame:
    """Rows that survive: not excluded, an unknown verdict included."""
    return excluded.filter(~F.coalesce("exclude", F.lit(False)))


def excluded_share(excluded: DataFrame) -> DataFrame:
    return excluded.groupBy("log_id").agg(
        F.avg(F.coalesce("exclude", F.lit(False)).cast("int")).alias("excluded_share")
    )
