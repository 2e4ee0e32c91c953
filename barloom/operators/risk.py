"""Value at risk and its tests, for many series at once: frames (series, date, r)."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.python import by_group
from barloom.functions.windows import by_series
from barloom.operators.features import exponential_std

#: The level of a chi-squared test with one degree of freedom at 5 %.
CRITICAL = 3.84


def historical_var(r: str, level: float) -> Column:
    return -F.percentile(r, 1 - level)


def gaussian_var(r: str, level: float) -> Column:
    return _gaussian(r, F.lit(NormalDist().inv_cdf(1 - level)))


def _gaussian(r: str, z: Column) -> Column:
    return -(F.avg(r) + z * F.stddev_samp(r))


def cornish_fisher_var(r: str, level: float) -> Column:
    """Gaussian with the quantile corrected for skewness and kurtosis, both bias-corrected."""
    return _cornish_fisher(r, F.lit(NormalDist().inv_cdf(1 - level)))


def _cornish_fisher(r: str, z: Column) -> Column:
    n = F.count(r).cast("double")
    s = F.skewness(r) * F.sqrt(n * (n - 1)) / (n - 2)
    k = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(r) + 6)
    return -(F.avg(r) + (z + (z * z - 1) * s / 6 + (z * z * z - 3 * z) * k / 24) * F.stddev_samp(r))


def expected_shortfall(frame: DataFrame, level: float = 0.95) -> DataFrame:
    """(series, es): minus the mean of returns at or below the quantile."""
    cut = frame.groupBy("series").agg(F.percentile("r", 1 - level).alias("q"))  # one row for each series
    return frame.join(cut, "series").filter("r <= q").groupBy("series").agg((-F.avg("r")).alias("es"))


def filtered_historical_var(frame: DataFrame, *levels: float, halflife: float = 20) -> DataFrame:
    """(series, level, var): the quantiles of returns scaled by their running deviation, times the last one."""
    wanted = levels or (0.95,)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        vol = pd.Series(exponential_std(pdf["r"].to_numpy(float), halflife))
        z = (pdf["r"].reset_index(drop=True) / (vol + 1e-12)).dropna()
        return pd.DataFrame({"series": pdf["series"].iloc[0], "level": wanted, "var": [-z.quantile(1 - v) * vol.iloc[-1] for v in wanted]})

    return by_group(frame.select("series", "date", "r"), "series", run, "series string, level double, var double")


def p_value(lr: float) -> float:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    return math.erfc(math.sqrt(max(lr, 0.0) / 2))


def kupiec(breaches: int, n: int, level: float) -> dict:
    """Likelihood ratio of the share of breaches against the nominal one."""
    if breaches in (0, n):
        return {"lr": 0.0, "p_value": 1.0, "reject": False}
    p, x = 1 - level, breaches / n
    log = lambda q: (n - breaches) * math.log(1 - q) + breaches * math.log(q)
    lr = -2 * (log(p) - log(x))
    return {"lr": lr, "p_value": p_value(lr), "reject": lr > CRITICAL}


def kupiec_column(breaches: Column, n: Column, level: float | Column) -> Column:
    x = breaches / n
    log = lambda q: (n - breaches) * F.ln(1 - q) + breaches * F.ln(q)
    return F.when((breaches == 0) | (breaches == n), 0.0).otherwise(-2 * (log(F.lit(1 - level)) - log(x)))


def transitions(frame: DataFrame) -> DataFrame:
    """(series, n00, n01, n10, n11) of consecutive flags, from frame (series, date, flag 0/1)."""
    pair = frame.withColumn("before", F.lag("flag").over(by_series())).na.drop(subset=["before"])
    return pair.groupBy("series").agg(*_moves())


def _moves() -> list[Column]:
    return [F.count_if((F.col("before") == a) & (F.col("flag") == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)]


def christoffersen_column() -> Column:
    """Likelihood ratio of independent breaches, from the columns of transitions(); 0 where a share is 0 or 1."""
    n00, n01, n10, n11 = (F.col(c).cast("double") for c in ("n00", "n01", "n10", "n11"))
    p01, p11 = n01 / F.greatest(n00 + n01, F.lit(1.0)), n11 / F.greatest(n10 + n11, F.lit(1.0))
    p = (n01 + n11) / F.greatest(n00 + n01 + n10 + n11, F.lit(1.0))
    null = (n00 + n10) * F.ln(1 - p) + (n01 + n11) * F.ln(p)
    own = n00 * F.ln(1 - p01) + n01 * F.ln(p01) + n10 * F.ln(1 - p11) + n11 * F.ln(p11)
    return F.when((F.least(p01, p11, p) <= 0) | (F.greatest(p01, p11, p) >= 1), 0.0).otherwise(-2 * (null - own))


def var_table(frame: DataFrame, levels: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """One row for each series and level with every estimate, breaches and both tests.

    Returns are sent once by series: quantiles of all levels are a window over the series, and what follows keeps that
    partitioning. The filtered estimate, which runs through a series in order, takes one more pass for all levels.
    """
    marks = F.percentile("r", F.array(*(F.lit(1 - v) for v in levels))).over(Window.partitionBy("series"))
    each = F.array(*(F.struct(F.lit(v).alias("level"), F.lit(f"{v:.0%}").alias("confidence"), F.lit(NormalDist().inv_cdf(1 - v)).alias("z"), F.get("_q", F.lit(k)).alias("q")) for k, v in enumerate(levels)))
    rows = frame.select("series", "date", "r", marks.alias("_q")).select("series", "date", "r", F.explode(each).alias("x")).select("series", "date", "r", "x.*")
    flagged = rows.withColumn("flag", (F.col("r") < F.col("q")).cast("int"))
    paired = flagged.withColumn("before", F.lag("flag").over(Window.partitionBy("series", "level").orderBy("date")))
    sums = paired.groupBy("series", "level", "confidence", "z", "q").agg(
        F.count("r").alias("n"), _gaussian("r", F.col("z")).alias("gaussian_var"), _cornish_fisher("r", F.col("z")).alias("cornish_fisher_var"),
        (-F.avg(F.when(F.col("r") <= F.col("q"), F.col("r")))).alias("expected_shortfall"), F.sum("flag").cast("long").alias("breaches"), *_moves(),
    )
    rows = sums.join(filtered_historical_var(frame, *levels).withColumnRenamed("var", "filtered_hist_var"), ["series", "level"])
    lr, independent = kupiec_column(F.col("breaches"), F.col("n"), F.col("level")), christoffersen_column()
    return rows.select(
        "series", "confidence", (-F.col("q")).alias("historical_var"), "gaussian_var", "cornish_fisher_var", "filtered_hist_var", "expected_shortfall", "breaches",
        F.round((1 - F.col("level")) * F.col("n"), 1).alias("expected_breaches"), F.round(lr, 2).alias("kupiec_lr"), (lr > CRITICAL).alias("kupiec_reject"),
        F.round(independent, 2).alias("christoffersen_lr"), (independent > CRITICAL).alias("christoffersen_reject"),
    )


def stress_scenarios(frame: DataFrame) -> DataFrame:
    """(series, scenario, ann_vol, var_95, es_95) of the returns as they are, doubled, with the worst five again, with a shock.

    Returns are sent once, by series; each row gives its value in every scenario there.
    """
    own = Window.partitionBy("series")
    placed = frame.select("series", "r").na.drop().withColumns({"_k": F.row_number().over(own.orderBy("r")), "_s": F.stddev_samp("r").over(own)})
    value = lambda name, x: F.struct(F.lit(name).alias("scenario"), x.alias("v"))
    worst, shock = "worst 5 days repeated", "fat left tail (-3 sigma shock)"
    always = F.array(value("base", F.col("r")), value("vol x2", F.col("r") * 2), value(worst, F.col("r")), value(shock, F.col("r")))
    again = F.when(F.col("_k") <= 5, F.array(value(worst, F.col("r"))))
    once = F.when(F.col("_k") == 1, F.array(value(shock, -3 * F.col("_s"))))
    rows = placed.select("series", F.explode(F.flatten(F.array_compact(F.array(always, again, once)))).alias("x")).select("series", "x.*")
    cut = rows.withColumn("_q", F.percentile("v", 0.05).over(Window.partitionBy("series", "scenario")))
    return cut.groupBy("series", "scenario").agg((F.stddev_samp("v") * math.sqrt(252)).alias("ann_vol"), (-F.max("_q")).alias("var_95"), (-F.avg(F.when(F.col("v") <= F.col("_q"), F.col("v")))).alias("es_95"))
