"""From scores to a cost-aware book, and from a book to a scorecard."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.python import by_group
from barloom.functions.windows import all_dates, by_date, by_name, cumulative, forward_fill, no_nan, pct_rank
from barloom.operators.costs import total_cost
from barloom.operators.portfolio import dense, long_short_weights, vol_target_leverage


def rank_ic(frame: DataFrame, pred: str = "pred", target: str = "target", least: int = 5) -> DataFrame:
    """(date, ic): rank correlation of both columns over each date's rows, where there are enough."""
    kept = frame.filter(F.col(pred).isNotNull() & F.col(target).isNotNull())
    enough = kept.withColumn("_n", F.count("*").over(by_date())).filter(F.col("_n") >= least)
    ranked = enough.select("date", pct_rank(F.col(pred), None, "date").alias("a"), pct_rank(F.col(target), None, "date").alias("b"))
    sums = ranked.groupBy("date").agg(F.covar_samp("a", "b").alias("c"), F.stddev_samp("a").alias("sa"), F.stddev_samp("b").alias("sb"))
    return sums.select("date", F.try_divide(F.col("c"), F.col("sa") * F.col("sb")).alias("ic")).na.drop()


def smoothed(scores: DataFrame, score: str = "pred", span: int = 3) -> DataFrame:
    """(date, ticker, smooth) on the dense grid: exponential means whose weights decay over missing dates too.

    Scores of one date and ticker count as their mean.
    """
    scores = scores.groupBy("date", "ticker").agg(F.avg(score).alias(score))
    grid = dense(scores).join(scores, ["date", "ticker"], "left")
    keep = 1 - 2 / (span + 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        up = down = 0.0
        out = np.full(len(pdf), np.nan)
        for i, v in enumerate(pdf[score].astype(float).tolist()):
            up, down = up * keep, down * keep
            if v == v:
                up, down = up + v, down + 1
            if down:
                out[i] = up / down
        return pd.DataFrame({"date": pdf["date"], "ticker": pdf["ticker"], "smooth": out})

    made = by_group(grid, "ticker", run, "date date, ticker string, smooth double")
    return made.withColumn("smooth", F.round(no_nan(F.col("smooth")), 12))


def backtest(scores: DataFrame, panel: DataFrame, score: str = "pred", quantile: float = 0.2, smooth: int = 3, rebalance: int = 5, target: float = 0.10, half_spread_bps: float = 5.0, impact_bps: float = 8.0, borrow_bps: float = 50.0) -> DataFrame:
    """The book by date: gross, cost, turnover, leverage, gross_exposure, net_exposure and net.

    Weights of every rebalance-th date are held; yesterday's weights earn today's ret1. Entering the first book is free.
    """
    held = positions(scores, score, quantile, smooth, rebalance)
    moved = held.join(panel.select("date", "ticker", "ret1"), ["date", "ticker"], "left").withColumn("_before", F.lag("weight").over(by_name()))
    daily = moved.groupBy("date").agg(
        F.coalesce(F.sum(F.col("_before") * F.col("ret1")), F.lit(0.0)).alias("raw"),
        F.coalesce(F.sum(F.abs(F.col("weight") - F.col("_before"))), F.lit(0.0)).alias("traded"),
        F.sum(F.abs(F.least("weight", F.lit(0.0)))).alias("short"),
        F.sum(F.abs("weight")).alias("gross_exposure"),
        F.sum("weight").alias("net_exposure"),
    )
    # One row for each date from here on.
    sized = daily.withColumn("leverage", vol_target_leverage(F.col("raw"), all_dates(), target))
    turned = sized.withColumns({"turnover": F.col("traded") * F.col("leverage"), "gross": F.col("raw") * F.col("leverage")})
    paid = turned.withColumn("cost", total_cost(F.col("turnover"), F.col("short") * F.col("leverage"), half_spread_bps, impact_bps, borrow_bps))
    exposed = paid.withColumns({"gross_exposure": F.col("gross_exposure") * F.col("leverage"), "net_exposure": F.col("net_exposure") * F.col("leverage"), "net": F.col("gross") - F.col("cost")})
    return exposed.select("date", "gross", "cost", "turnover", "leverage", "gross_exposure", "net_exposure", "net")


def positions(scores: DataFrame, score: str = "pred", quantile: float = 0.2, smooth: int = 3, rebalance: int = 5) -> DataFrame:
    """(date, ticker, weight): weights of every rebalance-th date, held until the next."""
    weighted = long_short_weights(smoothed(scores, score, smooth), "smooth", quantile)
    kept = F.when((F.row_number().over(by_name()) - 1) % rebalance == 0, F.col("weight"))
    return weighted.withColumn("_kept", kept).select("date", "ticker", F.coalesce(forward_fill(F.col("_kept")), F.lit(0.0)).alias("weight"))


def with_curve(book: DataFrame, column: str = "net") -> DataFrame:
    """book with equity and drawdown of compounded returns, null where the return is."""
    growth, order = F.lit(1.0) + F.col(column), all_dates()
    # A running product by logarithms, with its sign and zeros counted apart: a loss can exceed the capital.
    size = F.exp(cumulative(F.sum, F.ln(F.abs(F.nullif(growth, F.lit(0.0)))), order))
    sign = 1 - 2 * (cumulative(F.sum, (growth < 0).cast("int"), order) % 2)
    product = F.when(cumulative(F.sum, (growth == 0).cast("int"), order) > 0, 0.0).otherwise(sign * F.coalesce(size, F.lit(1.0)))
    grown = book.withColumn("equity", F.when(F.col(column).isNotNull(), product))
    return grown.withColumn("drawdown", F.col("equity") / cumulative(F.max, F.col("equity"), order) - 1)


def equity(book: DataFrame, column: str = "net") -> DataFrame:
    """(date, equity, drawdown) of compounded returns."""
    return with_curve(book, column).na.drop(subset=[column]).select("date", "equity", "drawdown")


def drawdown_spells(curve: DataFrame) -> DataFrame:
    """(spell, days) below the peak, for each run of dates between peaks."""
    island = cumulative(F.sum, (F.col("drawdown") >= 0).cast("int"), all_dates())
    return curve.withColumn("spell", island).groupBy("spell").agg(F.sum((F.col("drawdown") < 0).cast("long")).alias("days"))


def deflated_sharpe(sharpe: float, n: int, trials: int, variance: float, skew: float, kurtosis: float) -> float:
    """Chance that a Sharpe ratio is above what the best of so many trials would show without skill; kurtosis is raw."""
    normal, t, gamma = NormalDist(), max(trials, 2), 0.5772156649015329
    bar = math.sqrt(max(variance, 1e-12)) * ((1 - gamma) * normal.inv_cdf(1 - 1 / t) + gamma * normal.inv_cdf(1 - 1 / (t * math.e)))
    return normal.cdf((sharpe - bar) * math.sqrt(n - 1) / math.sqrt(max(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe, 1e-9)))


def _shape(x: str) -> tuple[Column, Column]:
    """Bias-corrected skewness and excess kurtosis as aggregates."""
    n = F.count(x).cast("double")
    g1 = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return g1, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)


def performance_frame(book: DataFrame) -> DataFrame:
    """One row of the scorecard's figures that need no trial count, in one pass over the book."""
    year, tiny = math.sqrt(252), 1e-12
    seen = cumulative(F.count, F.col("drawdown"), all_dates())
    peak = forward_fill(F.when(F.col("drawdown") >= 0, F.col("_seen")), all_dates())
    curve = with_curve(book).withColumn("_seen", seen).withColumn("_below", F.when(F.col("drawdown").isNotNull(), F.col("_seen") - F.coalesce(peak, F.lit(0))))
    g1, g2 = _shape("net")
    sums = curve.agg(
        F.min("drawdown").alias("max_drawdown"), F.coalesce(F.max("_below"), F.lit(0)).alias("drawdown_days"),
        F.avg("net").alias("m"), F.stddev_samp("net").alias("s"), F.avg("gross").alias("gm"), F.stddev_samp("gross").alias("gs"),
        F.stddev_samp(F.when(F.col("net") < 0, F.col("net"))).alias("ds"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"),
        F.percentile("net", 0.95).alias("hi"), F.percentile("net", 0.05).alias("lo"), g1.alias("skew"), g2.alias("excess_kurtosis"), F.count("net").alias("n"),
        F.avg("turnover").alias("t"), F.avg("cost").alias("c"), F.avg("leverage").alias("avg_leverage"),
    )
    m, s = F.col("m") * 252, F.col("s") * year
    return sums.select(
        m.alias("ann_return"), s.alias("ann_vol"), (m / (s + tiny)).alias("sharpe_net"), (F.col("gm") * 252 / (F.col("gs") * year + tiny)).alias("sharpe_gross"),
        (m / (F.col("ds") * year + tiny)).alias("sortino"), "max_drawdown", "drawdown_days", (m / (F.abs("max_drawdown") + tiny)).alias("calmar"), "hit_rate",
        F.abs(F.col("hi") / (F.col("lo") + tiny)).alias("tail_ratio"), "skew", "excess_kurtosis", (F.col("m") / (F.col("s") / F.sqrt("n") + tiny)).alias("t_stat"),
        (F.col("t") * 252).alias("ann_turnover"), (F.col("c") * 252).alias("ann_cost_drag"), "avg_leverage", "n", F.col("m").alias("_m"), F.col("s").alias("_s"),
    )


def performance(book: DataFrame, ic: DataFrame | None = None, trials: int = 1) -> dict[str, float]:
    """The scorecard, with the deflated Sharpe probability and, given ics, their figures."""
    got = performance_frame(book).first().asDict()
    n, m, s = got.pop("n"), got.pop("_m"), got.pop("_s")
    block = max(n // 5, 1)
    parts = book.na.drop(subset=["net"]).withColumn("_b", F.floor((F.row_number().over(all_dates()) - 1) / block)).groupBy("_b").agg(F.avg("net").alias("m"), F.stddev_samp("net").alias("s"))
    ratios = [r["m"] / ((r["s"] or 0.0) + 1e-12) for r in parts.collect()]  # five or six rows
    spread = float(np.var(ratios, ddof=1)) if len(ratios) > 2 else 1e-4
    got["deflated_sharpe_prob"] = deflated_sharpe(m / (s + 1e-12), n, trials, spread, got["skew"], got["excess_kurtosis"] + 3)
    if ic is not None:
        r = ic.agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"), F.count("ic").alias("n"), F.avg((F.col("ic") > 0).cast("double")).alias("h")).first()
        if r["n"]:
            got |= {"mean_ic": r["m"], "ic_ir": r["m"] / ((r["s"] or 0.0) + 1e-12), "ic_t_stat": r["m"] / ((r["s"] or 0.0) / math.sqrt(r["n"]) + 1e-12), "ic_hit_rate": r["h"]}
    return got


def compare_models(oof: DataFrame, panel: DataFrame, models: list[str], trials: int = 1, **book: float) -> list[dict]:
    """Scorecards of several prediction columns, best net Sharpe first."""
    keys = ("mean_ic", "ic_ir", "ic_t_stat", "sharpe_net", "max_drawdown", "ann_turnover", "deflated_sharpe_prob")
    out = []
    for m in models:
        card = performance(backtest(oof, panel, m, **book).cache(), rank_ic(oof, m), trials)
        out.append({"model": m, **{k: card[k] for k in keys if k in card}})
    return sorted(out, key=lambda r: -r["sharpe_net"])


def cost_sensitivity(book: DataFrame, multiples: tuple[int, ...] = (1, 2, 3, 5), half_spread_bps: float = 5.0, impact_bps: float = 8.0) -> DataFrame:
    """Net Sharpe, return and cost drag with spread and impact multiplied; borrowing is not.

    What a book trades does not depend on its costs, so its gross, turnover and borrowing are used again.
    """
    spark = book.sparkSession
    own = F.abs("turnover") * half_spread_bps / 1e4 + F.sqrt(F.abs("turnover")) * impact_bps / 1e4
    priced = book.select("gross", own.alias("own"), (F.col("cost") - own).alias("borrow")).crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in multiples], "multiple int")))
    each = priced.withColumn("cost", F.col("own") * F.col("multiple") + F.col("borrow")).withColumn("net", F.col("gross") - F.col("cost"))
    sums = each.groupBy("multiple").agg(F.avg("net").alias("m"), F.stddev_samp("net").alias("s"), F.avg("cost").alias("c"))
    return sums.select(F.format_string("%dx", "multiple").alias("cost_multiple"), (F.col("m") * 252 / (F.col("s") * math.sqrt(252) + 1e-12)).alias("sharpe_net"), (F.col("m") * 252).alias("ann_return"), (F.col("c") * 252).alias("ann_cost_drag"))


def regime_breakdown(book: DataFrame, panel: DataFrame) -> DataFrame:
    """Mean, deviation, count and Sharpe of net returns by the date's regime, the last known one."""
    state = panel.groupBy("date").agg(F.bround(F.avg("regime")).alias("state"))
    joined = book.select("date", "net").join(state, "date", "left").withColumn("state", forward_fill(F.col("state"), all_dates())).na.drop(subset=["state"])
    sums = joined.groupBy("state").agg(F.avg("net").alias("mean"), F.stddev_samp("net").alias("std"), F.count("net").alias("count"))
    name = F.when(F.col("state") == 0, "calm").when(F.col("state") == 1, "normal").otherwise("stressed")
    return sums.select(name.alias("regime"), "mean", "std", "count", (F.col("mean") / (F.col("std") + 1e-12) * math.sqrt(252)).alias("sharpe"))


def monthly_returns(book: DataFrame, column: str = "net") -> DataFrame:
    """year by month 1 to 12 of summed returns."""
    return book.groupBy(F.year("date").alias("year")).pivot("month", list(range(1, 13))).agg(F.sum(column)) if "month" in book.columns else monthly_returns(book.withColumn("month", F.month("date")), column)


def benchmark(panel: DataFrame) -> DataFrame:
    """(date, market): the equal-weight mean of ret1."""
    return panel.groupBy("date").agg(F.avg("ret1").alias("market"))


def momentum_factor(panel: DataFrame, column: str = "mom21") -> DataFrame:
    """(date, momentum): ret1 weighted by the distance of each name's rank from the middle, unsigned."""
    ranked = panel.withColumn("_r", pct_rank(F.col(column), None, "date")).withColumn("_w", F.abs(F.col("_r") - F.avg("_r").over(by_date())))
    return ranked.groupBy("date").agg(F.try_divide(F.sum(F.col("_w") * F.col("ret1")), F.sum("_w")).alias("momentum"))


def rolling_ic(ic: DataFrame, n: int = 63) -> DataFrame:
    from barloom.functions.windows import mean

    return ic.select("date", "ic", mean(F.col("ic"), n, all_dates()).alias("mean_ic"))


def snapshot(panel: DataFrame, columns: list[str]) -> DataFrame:
    """The last date's rows."""
    last = panel.agg(F.max("date").alias("date"))
    return panel.join(F.broadcast(last), "date").select("date", "ticker", *columns)


def label_distribution(frame: DataFrame, label: str = "label") -> DataFrame:
    counted = frame.groupBy(label).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
