"""Virtual time axes over several logs. Times in ms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .align import hold_onto
from .lookup import measured
from .ordered import SPLIT, Axis, attach_splits, scan

GAP_MS = 1000


def log_spans(samples: DataFrame) -> DataFrame:
    """First and last instant of each log."""
    return samples.groupBy("log_id").agg(F.min("t_ms").alias("t_start"), F.max("t_ms").alias("t_end"))


def concatenated(logs: DataFrame, session: Sequence[str], gap_ms: int = GAP_MS) -> DataFrame:
    """Offsets that lay the logs of a session end to end, with a gap between.

    ``logs(<session>, log_id, ord, t_start, t_end)``. Also gives the frontier that
    opens each log: where the previous one ended, NULL for the first.
    """
    if gap_ms <= 0:
        raise ValueError("the gap between logs must be positive")
    axis = Axis(tuple(session), "ord", ("log_id",))
    length = F.col("t_end") - F.col("t_start") + F.lit(gap_ms)
    work = scan(attach_splits(logs, axis), axis, total={"_upto": length}, prev={"previous_log": F.col("log_id")})
    begin = F.col("_upto") - length
    return work.withColumns(
        {
            "offset": begin - F.col("t_start"),
            "x_start": begin,
            "x_end": F.col("_upto") - F.lit(gap_ms),
            "previous_x_end": F.when(F.col("previous_log").isNotNull(), begin - F.lit(gap_ms)),
        }
    ).drop("_upto", SPLIT)


def parallel(logs: DataFrame, session: Sequence[str], raw_offset: Column | None = None) -> DataFrame:
    """Offsets per log, shifted so the earliest instant of the session is 0.

    No ``raw_offset`` is the relative mode; a user column is the manual mode; the
    absolute-clock mode passes ``clock_offsets``' column.
    """
    raw = F.lit(0) if raw_offset is None else raw_offset
    work = logs.withColumn("_raw", raw)
    base = work.groupBy(*session).agg(F.min(F.col("_raw") + F.col("t_start")).alias("_base"))
    return work.join(base, list(session)).withColumn("offset", F.col("_raw") - F.col("_base")).drop("_raw", "_base")


def clock_offsets(logs: DataFrame, session: Sequence[str]) -> DataFrame:
    """``t0 - min(t0)`` in ms; a session with any unreliable clock gets no offsets."""
    micros = F.unix_micros("t0")
    base = logs.groupBy(*session).agg(
        F.min(micros).alias("_min"),
        F.count_if(F.coalesce(F.col("reliability") != "reliable", F.lit(True))).alias("_bad"),
    )
    fine = F.col("_bad") == 0
    return logs.join(base, list(session)).withColumns(
        {
            "raw_offset": F.when(fine, F.floor((micros - F.col("_min")) / 1000)),
            "clock_status": F.when(fine, "ok").otherwise("unreliable_clock"),
        }
    ).drop("_min", "_bad")


def place(samples: DataFrame, offsets: DataFrame, session: Sequence[str]) -> DataFrame:
    """Samples on the virtual axis: ``x = t_ms + offset``."""
    o = offsets.select(*session, "log_id", "offset")
    return samples.join(measured(o), "log_id").withColumn("x", F.col("t_ms") + F.col("offset")).drop("offset")


def virtual_range(offsets: DataFrame, session: Sequence[str]) -> DataFrame:
    """Union of the logs' ranges on the virtual axis."""
    return offsets.groupBy(*session).agg(
        F.min(F.col("t_start") + F.col("offset")).alias("x_min"),
        F.max(F.col("t_end") + F.col("offset")).alias("x_max"),
    )


def anchors(logs: DataFrame, found: DataFrame, present: DataFrame, unconfirmed: DataFrame | None = None) -> DataFrame:
    """First event of each log as its anchor, or the reason there is none.

    ``present(log_id)`` lists the logs that have the needed roles,
    ``unconfirmed(log_id)`` those where one of them is unconfirmed.
    """
    first = found.groupBy("log_id").agg(F.min("t_start").alias("anchor_ms"))
    out = logs.join(first, "log_id", "left").join(present.select("log_id").distinct().withColumn("_p", F.lit(True)), "log_id", "left")
    if unconfirmed is None:
        out = out.withColumn("_u", F.lit(None).cast("boolean"))
    else:
        out = out.join(unconfirmed.select("log_id").distinct().withColumn("_u", F.lit(True)), "log_id", "left")
    reason = (
        F.when(F.col("_p").isNull(), "role_missing")
        .when(F.col("_u"), "role_unconfirmed")
        .when(F.col("anchor_ms").isNull(), "event_absent")
    )
    return out.withColumn("reason", reason).select(
        *logs.columns,
        F.when(F.col("reason").isNull(), F.col("anchor_ms")).alias("anchor_ms"),
        F.when(F.col("reason").isNull(), -F.col("anchor_ms")).alias("offset"),
        "reason",
    )


def log_delta(
    samples: DataFrame, pairs: DataFrame, channel: str, window_ms: int, target_rows: int | None = None
) -> DataFrame:
    """Difference of one channel between the two logs of each pair.

    ``pairs(pair_id, log_a, offset_a, log_b, offset_b)``; log b is held onto the
    instants of log a on the shared axis.
    """
    one = samples.filter(F.col("channel_id") == channel).select("log_id", "seq", "t_ms", "v")
    a = pairs.select("pair_id", F.col("log_a").alias("log_id"), F.col("offset_a").alias("_o"), F.lit(True).alias("is_a"))
    b = pairs.select("pair_id", F.col("log_b").alias("log_id"), F.col("offset_b").alias("_o"), F.lit(False).alias("is_a"))
    both = one.join(measured(a.unionByName(b)), "log_id").withColumn("x", F.col("t_ms") + F.col("_o")).drop("_o")
    axis = Axis(("pair_id",), "x", ("seq",))
    both = attach_splits(both, axis, **({"target_rows": target_rows} if target_rows else {}))
    out = hold_onto(both, F.col("is_a"), {"there": ~F.col("is_a")}, window_ms, axis=axis)
    return out.select("pair_id", "seq", "x", F.col("v").alias("here"), "there", (F.col("v") - F.col("there")).alias("delta"))


#: Buckets of a block of the grid; a block is at least twice as long as the longest lag.
BLOCK = 4096
#: Up to so many products a block is correlated term by term, which rounds less than a transform.
DIRECT = 20_000_000


def _lag_sums(block: int, reach: int):
    """Partial sums of every lag for one block of one pair; see ``lag_scores``."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        pair, k = key[0].as_py(), key[1].as_py()
        first, i, v = (part.column(c).to_numpy() for c in ("is_a", "i", "v"))
        centre = part.column("centre")[0].as_py()
        y, x = np.zeros((2, block)), np.zeros((2, block + 2 * reach))  # mask and value of a, then of b around it
        at = i[first] - k * block
        y[0, at], y[1, at] = 1, v[first]
        at = i[~first] - (k * block - centre - reach)
        x[0, at], x[1, at] = 1, v[~first]
        rows = {}
        for name, p, q in (("n", x[0], y[0]), ("a", x[0], y[1]), ("b", x[1], y[0]), ("aa", x[0], y[1] ** 2), ("bb", x[1] ** 2, y[0]), ("ab", x[1], y[1])):
            if block * (2 * reach + 1) <= DIRECT:
                rows[name] = np.correlate(p, q, "valid")
            else:
                size = 1 << (len(p) + block - 1).bit_length()
                rows[name] = np.fft.irfft(np.fft.rfft(p, size) * np.conj(np.fft.rfft(q, size)), size)[: 2 * reach + 1]
        lags = centre + reach - np.arange(2 * reach + 1)
        n = np.rint(rows["n"]).astype(np.int64)
        some = n > 0
        out = {"pair_id": pa.array([pair] * int(some.sum()), part.schema.field("pair_id").type), "lag": lags[some].astype(np.int32), "n": n[some]}
        return pa.table({**out, **{c: rows[c][some] for c in ("a", "b", "aa", "bb", "ab")}})

    return run


def lag_scores(
    samples: DataFrame, pairs: DataFrame, channel: str, step_ms: int, max_lag: int, min_overlap: int = 3, centres: DataFrame | None = None,
    block: int | None = None,
) -> DataFrame:
    """``pair_id, lag, r, overlap`` of all lags within ``max_lag`` of 0, or of a pair's ``centres(pair_id, centre)``.

    Both logs are averaged onto a grid of ``step_ms`` from their own start. The grid is cut into blocks; a
    bucket of log b goes to the one or two blocks of log a that some lag brings it to, whatever
    ``max_lag`` is. A block gives its part of the sums behind the correlation for all lags at once, as
    products of masked arrays, and Spark adds the parts up. Values count from their log's mean.
    """
    block = max(block or BLOCK, 2 * max_lag + 1)
    one = samples.filter(F.col("channel_id") == channel)
    start = measured(one.groupBy("log_id").agg(F.min("t_ms").alias("_t0")))
    grid = (
        one.join(start, "log_id")
        .groupBy("log_id", F.floor((F.col("t_ms") - F.col("_t0")) / step_ms).alias("i"))
        .agg(F.avg("v").alias("v"))
        .filter("v IS NOT NULL")
    )
    grid = settle(grid)
    means = measured(grid.groupBy("log_id").agg(F.avg("v").alias("_mean")))
    grid = grid.join(means, "log_id").select("log_id", "i", (F.col("v") - F.col("_mean")).alias("v"))
    chosen = pairs.select("pair_id", "log_a", "log_b")
    chosen = chosen.withColumn("centre", F.lit(0).cast("bigint")) if centres is None else chosen.join(centres.select("pair_id", F.col("centre").cast("bigint")), "pair_id")
    side = lambda log, is_a: chosen.select("pair_id", F.col(log).alias("log_id"), "centre", F.lit(is_a).alias("is_a"))
    rows = grid.join(measured(side("log_a", True).unionByName(side("log_b", False))), "log_id")
    low = F.when(F.col("is_a"), F.col("i")).otherwise(F.col("i") + F.col("centre") - max_lag)
    high = F.when(F.col("is_a"), F.col("i")).otherwise(F.col("i") + F.col("centre") + max_lag)
    blocks = F.sequence(F.floor(low / block), F.floor(high / block))
    dealt = rows.select("pair_id", "centre", "is_a", "i", "v", F.explode(blocks).alias("k"))
    kind = pairs.schema["pair_id"].dataType.simpleString()
    parts = dealt.groupBy("pair_id", "k").applyInArrow(
        _lag_sums(block, max_lag), f"pair_id {kind}, lag int, n long, a double, b double, aa double, bb double, ab double"
    )
    sums = parts.groupBy("pair_id", "lag").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")])
    n = F.col("n")
    spread = lambda c: F.col(c + c) - F.col(c) * F.col(c) / n
    flat = (spread("a") <= 1e-12 * F.col("aa")) | (spread("b") <= 1e-12 * F.col("bb"))
    r = F.when(~flat, (F.col("ab") - F.col("a") * F.col("b") / n) / F.sqrt(spread("a") * spread("b")))
    scored = sums.select("pair_id", "lag", r.alias("r"), n.alias("overlap"))
    return scored.filter((F.col("overlap") >= min_overlap) & F.col("r").isNotNull() & ~F.isnan("r"))


def _best(scored: DataFrame, step_ms: int) -> DataFrame:
    best = F.struct(F.round("r", 9).alias("r"), (-F.abs("lag")).alias("near"), F.col("lag"), F.col("overlap"))
    return scored.groupBy("pair_id").agg(F.max(best).alias("_b")).select(
        "pair_id", "_b.lag", (F.col("_b.lag") * step_ms).alias("offset_ms"), F.col("_b.r").alias("r"), "_b.overlap"
    )


def best_lag(
    samples: DataFrame, pairs: DataFrame, channel: str, step_ms: int, max_lag: int, min_overlap: int = 3
) -> DataFrame:
    """Offset between two logs with the highest correlation of a channel; see ``lag_scores``."""
    return _best(lag_scores(samples, pairs, channel, step_ms, max_lag, min_overlap), step_ms)


def best_lag_refined(
    samples: DataFrame, pairs: DataFrame, channel: str, step_ms: int, max_lag: int, coarse: int = 16, min_overlap: int = 3
) -> DataFrame:
    """The same in two rounds: lags on a grid ``coarse`` times as wide, then single steps around the best.

    ``max_lag`` counts coarse steps. The second round looks one coarse step to either side.
    """
    wide = settle(best_lag(samples, pairs, channel, step_ms * coarse, max_lag, min_overlap))
    centres = wide.select("pair_id", (F.col("lag") * coarse).alias("centre"))
    return _best(lag_scores(samples, pairs, channel, step_ms, coarse, min_overlap, centres), step_ms)


def concatenate_series(samples: DataFrame, matched: DataFrame, offsets: DataFrame, session: Sequence[str]) -> DataFrame:
    """Samples of matched channels as one series per group on the concatenated axis."""
    placed = place(samples, offsets, session)
    return placed.join(measured(matched.select("group_id", "log_id", "channel_id")), ["log_id", "channel_id"]).select(
        *session, "group_id", "log_id", "x", "seq", "v"
    )
