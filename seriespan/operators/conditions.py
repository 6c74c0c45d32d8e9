"""Three-valued conditions over ordered samples.

A condition is a nullable BOOLEAN column: NULL where it cannot be judged. Spark's
AND / OR / NOT are already the Kleene tables the analysis needs, so composing
conditions is plain column algebra and only the stateful ones live here.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Axis, scan


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class Threshold:
    """Enter beyond ``enter``, leave beyond ``leave``; limits may be columns.

    Equal limits: entering wins. Invalid samples judge to NULL and keep the state.
    """

    value: Column
    enter: Column | float
    leave: Column | float
    rising: bool = True

    def __post_init__(self) -> None:
        if isinstance(self.enter, Column) or isinstance(self.leave, Column):
            return
        wrong = self.leave > self.enter if self.rising else self.leave < self.enter
        if wrong:
            raise ValueError("the leave limit lies beyond the enter limit")

    def valid(self) -> Column:
        return self.value.isNotNull() & _col(self.enter).isNotNull() & _col(self.leave).isNotNull()

    def decision(self) -> Column:
        v, enter, leave = self.value, _col(self.enter), _col(self.leave)
        if self.rising:
            return F.when(self.valid() & (v >= enter), True).when(self.valid() & (v <= leave), False)
        return F.when(self.valid() & (v <= enter), True).when(self.valid() & (v >= leave), False)


@dataclass(frozen=True)
class Band:
    """``lo <= v <= hi`` with a margin of ``margin`` band widths outside each edge."""

    value: Column
    lo: Column | float
    hi: Column | float
    margin: float = 0.0

    def __post_init__(self) -> None:
        if not 0.0 <= self.margin < 1.0:
            raise ValueError("the margin is a fraction of the band width in [0, 1)")

    def sides(self) -> tuple[Threshold, Threshold]:
        lo, hi = _col(self.lo), _col(self.hi)
        slack = (hi - lo) * F.lit(float(self.margin))
        return (
            Threshold(self.value, lo, lo - slack, rising=True),
            Threshold(self.value, hi, hi + slack, rising=False),
        )


def limit(value: Column, at: Column | float, *, above: bool, margin: float) -> Threshold:
    """Alert limit whose leave edge is ``margin`` of the limit's size inside it."""
    edge = _col(at)
    slack = F.abs(edge) * F.lit(float(margin))
    return Threshold(value, edge, edge - slack if above else edge + slack, rising=above)


def judge(df: DataFrame, axis: Axis, specs: Mapping[str, Threshold | Band]) -> DataFrame:
    """Append one nullable BOOLEAN per spec, all from a single ordered scan."""
    sides: dict[str, list[Threshold]] = {
        name: list(spec.sides()) if isinstance(spec, Band) else [spec] for name, spec in specs.items()
    }
    held = {
        f"_held_{name}_{i}": side.decision()
        for name, parts in sides.items()
        for i, side in enumerate(parts)
    }
    out = scan(df, axis, hold=held)
    judged = {}
    for name, parts in sides.items():
        column = None
        for i, side in enumerate(parts):
            one = F.when(side.valid(), F.coalesce(F.col(f"_held_{name}_{i}"), F.lit(False)))
            column = one if column is None else column & one
        judged[name] = column
    return out.withColumns(judged).drop(*held)


def any_bit(bits: Column, mask: int | None = None) -> Column:
    """TRUE where any bit (of ``mask``) is set."""
    return (bits if mask is None else bits.bitwiseAND(F.lit(mask))) != 0


def outside(value: Column, lo: float | Column | None, hi: float | Column | None) -> Column:
    """TRUE where the value leaves [lo, hi]; a missing bound never fails."""
    low = F.lit(False) if lo is None else F.coalesce(value < _col(lo), F.lit(False))
    high = F.lit(False) if hi is None else F.coalesce(value > _col(hi), F.lit(False))
    return low | high


def first_true(conditions: Mapping[str, Column]) -> dict[str, Column]:
    """Make conditions exclusive in mapping order, keeping Kleene logic.

    Each becomes ``c AND NOT (any earlier)``: an unknown earlier condition leaves
    the later ones unknown, which a plain CASE would not.
    """
    exclusive: dict[str, Column] = {}
    earlier: Column | None = None
    for name, cond in conditions.items():
        exclusive[name] = cond if earlier is None else cond & ~earlier
        earlier = cond if earlier is None else earlier | cond
    return exclusive
