"""Step response of a controlled pressure to rises of its target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .conditions import Band, judge
from .ordered import LOG_TIME, SPLIT, Axis, has_splits, runs, scan


@dataclass(frozen=True)
class StepLimits:
    """Fixed default values (kPa, fractions, seconds)."""

    min_step: float = 5.0
    band: float = 0.03
    margin: float = 0.25
    settled_s: float = 1.0
    settled_samples: int = 10


STEP = Axis(("log_id", "step"), "t_ms", ("seq",))


def _steps(grid: DataFrame, target: str, lim: StepLimits) -> DataFrame:
    """Append step kind, step number and the target before the step.

    A step is a run of rises (or falls) of at least ``min_step``; its window lasts
    until the next step, so ``step`` counts the steps begun so far.
    """
    t = F.col(target)
    work = scan(grid, LOG_TIME, prev={"_before": t})
    rise = t - F.col("_before")
    kind = F.when(rise >= lim.min_step, "rise").when(rise <= -lim.min_step, "fall")
    work = work.withColumn("_kind", kind)
    work = scan(work, LOG_TIME, prev={"_pk": F.col("_kind")})
    begins = F.col("_kind").isNotNull() & ~F.col("_kind").eqNullSafe(F.col("_pk"))
    work = work.withColumn("_begin", begins.cast("bigint"))
    return scan(work, LOG_TIME, total={"step": F.col("_begin")}).drop("_pk", "_begin")


def step_responses(grid: DataFrame, actual: str, target: str, lim: StepLimits) -> DataFrame:
    """One row per step with its verdict and, when settled, the response metrics."""
    a, t = F.col(actual), F.col(target)
    inside_window = _steps(grid, target, lim).filter(F.col("step") >= 1)
    pos = F.struct("t_ms", "seq")
    first = F.when(F.col("_kind").isNotNull(), pos)
    windows = inside_window.groupBy("log_id", "step").agg(
        F.min("t_ms").alias("t_start"),
        F.max(pos).alias("_end"),
        F.count(F.lit(1)).alias("n"),
        F.max(a).alias("peak"),
        F.min_by("_kind", pos).alias("kind"),
        F.min_by("_before", pos).alias("target_before"),
        F.max_by(t, first).alias("target_new"),
    )
    last = windows.groupBy("log_id").agg(F.max("step").alias("_last"))
    known = a.isNotNull() & t.isNotNull()
    banded = judge(
        inside_window,
        STEP,
        {
            "_in": Band(
                F.when(known, a),
                F.when(known, t * (1.0 - lim.band)),
                F.when(known, t * (1.0 + lim.band)),
                lim.margin,
            )
        },
    )
    keep = ["log_id", "step", "t_ms", "seq", "_in", actual, target, *([SPLIT] if has_splits(banded) else [])]
    settled = runs(
        banded.select(*keep), STEP, F.col("_in"), {"_error": ("sum", a - t)}
    ).filter(
        (F.col("t_end") - F.col("t_start") >= lim.settled_s * 1000) & (F.col("n") >= lim.settled_samples)
    )
    settled = settled.select(
        F.col("log_id").alias("_l"), F.col("step").alias("_s"), F.col("t_start").alias("_t_in"), F.col("i_end").alias("_i_end"),
        F.col("n").alias("steady_samples"), F.col("_error"),
    )
    w = windows.join(last, "log_id")
    out = w.join(
        settled,
        (F.col("log_id") == F.col("_l")) & (F.col("step") == F.col("_s")) & (F.col("_end.seq") == F.col("_i_end")),
        "left",
    )
    done = F.col("_t_in").isNotNull()
    verdict = (
        F.when(F.col("kind") == "fall", "fall")
        .when(done, "measured")
        .when(F.col("step") < F.col("_last"), "interrupted")
        .otherwise("unsettled")
    )
    good = F.col("verdict") == "measured"
    over = F.col("peak") - F.col("target_new")
    steady = F.col("_error") / F.col("steady_samples")
    return out.withColumn("verdict", verdict).select(
        "log_id", "step", "verdict", "t_start", F.col("_end.t_ms").alias("t_end"), "n",
        "target_before", "target_new",
        (F.col("target_new") - F.col("target_before")).alias("step_size"),
        F.when(good, F.col("peak")).alias("peak"),
        F.when(good, over).alias("overshoot"),
        F.when(good, F.try_divide(over, F.col("target_new"))).alias("overshoot_rel"),
        F.when(good, (F.col("_t_in") - F.col("t_start")) / 1000.0).alias("settling_s"),
        F.when(good, steady).alias("steady_error"),
        F.when(good, F.try_divide(steady, F.col("target_new"))).alias("steady_error_rel"),
        F.when(good, F.col("steady_samples")).alias("steady_samples"),
    )


def response_summary(responses: DataFrame) -> DataFrame:
    """Measured and discarded steps per log."""
    kinds = ["measured", "fall", "interrupted", "unsettled"]
    return responses.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("steps"), *[F.count_if(F.col("verdict") == k).alias(k) for k in kinds]
    )
