"""Building blocks of the oracle SQL."""

from __future__ import annotations

W = "(PARTITION BY log_id ORDER BY t_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
L = "(PARTITION BY log_id ORDER BY t_ms, seq)"


def num(x: float) -> str:
    return f"({float(x)!r}::DOUBLE)"


def hyst(value: str, enter: str, leave: str, rising: bool = True, over: str = W) -> str:
    """Threshold with hysteresis, NULL where it cannot be judged."""
    valid = f"(({value}) IS NOT NULL AND ({enter}) IS NOT NULL AND ({leave}) IS NOT NULL)"
    a, b = (">=", "<=") if rising else ("<=", ">=")
    dec = f"CASE WHEN {valid} AND ({value}) {a} ({enter}) THEN TRUE WHEN {valid} AND ({value}) {b} ({leave}) THEN FALSE END"
    return f"CASE WHEN {valid} THEN coalesce(last_value({dec} IGNORE NULLS) OVER {over}, FALSE) END"


def limit(value: str, at: str, above: bool, margin: float) -> str:
    sign = "-" if above else "+"
    return hyst(value, at, f"({at}) {sign} abs({at}) * {num(margin)}", above)


def band(value: str, lo: str, hi: str, margin: float, over: str = W) -> str:
    slack = f"(({hi}) - ({lo})) * {num(margin)}"
    return f"(({hyst(value, lo, f'({lo}) - {slack}', True, over)}) AND ({hyst(value, hi, f'({hi}) + {slack}', False, over)}))"


def runs(src: str, state: str, out: str, key: str = "log_id") -> str:
    """CTEs numbering the runs of ``state`` as ``<out>(..., st, run)``."""
    part = f"(PARTITION BY {key} ORDER BY t_ms, seq)"
    upto = f"(PARTITION BY {key} ORDER BY t_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{out}_0 AS (SELECT *, {state} AS st FROM {src}),
  {out}_1 AS (SELECT *, lag(st) OVER {part} AS st_prev, row_number() OVER {part} AS st_rn FROM {out}_0),
  {out} AS (SELECT *, sum(CASE WHEN st_rn = 1 OR st IS DISTINCT FROM st_prev THEN 1 ELSE 0 END) OVER {upto} AS run FROM {out}_1)"""


def held(base: str, out: str, label: str, column: str, window_ms: int, source: str = "s", value: str = "v") -> str:
    """CTE adding ``column``: the held value of another channel."""
    return f"""{out} AS (SELECT b.*, CASE WHEN b.t_ms - w.t_ms <= {window_ms} THEN w.{value} END AS {column}
    FROM {base} b ASOF LEFT JOIN (SELECT * FROM {source} WHERE channel_id = '{label}') w
    ON b.log_id = w.log_id AND b.t_ms >= w.t_ms)"""
