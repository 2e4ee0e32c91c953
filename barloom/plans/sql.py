"""SQL building blocks of the oracles: bars, rolling windows with full counts, tied ranks."""

from __future__ import annotations

BARS = """bars as (select {key} as ticker, cast(l_shipdate as date) as date,
  cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double) as close,
  max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low, cast(sum(cast(l_quantity as decimal(18,2))) as double) as volume
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""

NAME = "partition by ticker order by date"


def over(n: int, by: str = NAME) -> str:
    return f"over ({by} rows between {n - 1} preceding and current row)"


def roll(function: str, x: str, n: int, by: str = NAME) -> str:
    return f"(case when count({x}) {over(n, by)} = {n} then {function}({x}) {over(n, by)} end)"


def lag(x: str, n: int = 1) -> str:
    return f"(lag({x}, {n}) over ({NAME}))"


def rank(x: str, by: str) -> str:
    part = f"partition by {by}" if by else ""
    return f"(case when {x} is not null then (rank() over ({part} order by {x} asc nulls last) + (count({x}) over (partition by {by + ', ' if by else ''}{x}) - 1) / 2.0) / cast(count({x}) over ({part}) as double) end)"


def r6(x: str, name: str = "", digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 as {name or x}"


def base(key: str = "p_brand") -> str:
    """with-list of bars and b (log close, ret1, true range, ...)."""
    return (
        BARS.format(key=key)
        + f""", b0 as (select *, ln(close) as lc, ln(1 + volume) as lv, close * volume as dv, power(ln(high / low), 2) as hl2 from bars),
  b1 as (select *, lc - {lag('lc')} as r, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) as tr from b0),
  b as (select *, {roll('stddev_samp', 'r', 20)} as vol20, {roll('stddev_samp', 'r', 63)} as vol63, case when r is not null then least(r, 0) end as dn, row_number() over ({NAME}) as i from b1)"""
    )
