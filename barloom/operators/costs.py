"""Trading costs per unit of capital."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spread_cost(turnover: Column, half_spread_bps: float = 5.0) -> Column:
    return F.abs(turnover) * half_spread_bps / 1e4


def impact_cost(turnover: Column, impact_bps: float = 8.0, power: float = 0.5) -> Column:
    return F.pow(F.abs(turnover), F.lit(power)) * impact_bps / 1e4


def borrow_cost(short: Column, annual_bps: float = 50.0) -> Column:
    return F.abs(short) * annual_bps / 1e4 / 252


def total_cost(turnover: Column, short: Column, half_spread_bps: float = 5.0, impact_bps: float = 8.0, borrow_bps: float = 50.0) -> Column:
    return spread_cost(turnover, half_spread_bps) + impact_cost(turnover, impact_bps) + borrow_cost(short, borrow_bps)


def break_even_ic(turnover: float, cost_bps: float, vol: float) -> float:
    return turnover * cost_bps / 1e4 / max(vol, 1e-9)
