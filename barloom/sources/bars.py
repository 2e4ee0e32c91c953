"""Daily bars: from the driver tables, from files, simulated, and their audit."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barloom.functions.windows import by_name

PANEL = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("close", "high", "low", "volume")), T.StructField("sector", T.StringType())]
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, key: str = "p_brand") -> DataFrame:
    """(ticker, date, close, high, low, volume) from line items: a part attribute is the name, unit prices are the bars.

    Sums are taken in decimal, so that they don't depend on the order of rows.
    """
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", F.to_date("l_shipdate").alias("date"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(key).alias("ticker"))
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    grouped = joined.groupBy("ticker", "date").agg(money("l_extendedprice").alias("paid"), money("l_quantity").alias("volume"), F.max(unit).alias("high"), F.min(unit).alias("low"))
    return grouped.select("ticker", "date", (F.col("paid") / F.col("volume")).alias("close"), "high", "low", "volume")


def with_sector(panel: DataFrame, sectors: DataFrame, default: str = "Other") -> DataFrame:
    """panel with the sector of each ticker from a dimension table (ticker, sector); unknown ones get the default."""
    return panel.join(sectors.dropDuplicates(["ticker"]), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit(default)))


def long_enough(panel: DataFrame, least: int = 400) -> DataFrame:
    """Rows of names with at least so many complete bars."""
    complete = panel.na.drop(subset=["close", "high", "low", "volume"])
    keep = complete.groupBy("ticker").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("ticker")
    return complete.join(keep, "ticker", "left_semi")


def load_prices(spark: SparkSession, path: str, sectors: DataFrame | None = None, fallback: DataFrame | None = None, form: str = "parquet") -> DataFrame:
    """A panel from files, or the fallback where the files can't be read."""
    try:
        panel = spark.read.format(form).options(header="true", inferSchema="true").load(path)
        panel.schema  # noqa: B018
    except Exception:
        if fallback is None:
            raise
        panel = fallback
    panel = require_columns(panel, "date", "ticker", "close", "high", "low", "volume")
    panel = panel if sectors is None else with_sector(panel.drop("sector"), sectors)
    return panel.select(*(c for c in PANEL.names if c in panel.columns))


def save_prices(panel: DataFrame, path: str, form: str = "parquet") -> None:
    panel.write.mode("overwrite").format(form).option("header", "true").save(path)


def save_report(frame: DataFrame, path: str) -> None:
    """A small report as one CSV part with a header."""
    frame.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date"))
    return days.filter(F.weekday("date") < 5)


def simulate_panel(spark: SparkSession, tickers: list[str], start: str = "2010-01-01", end: str = "2024-12-31", seed: int = 7) -> DataFrame:
    """Bars of a two-state market: calm days turn stressed with chance 0.015 and stressed ones calm with chance 0.06.

    The state of a day depends on the day before, so the calendar's states are drawn on the driver, one value for each
    business day; all that is by name is drawn where its rows are.
    """
    import random

    rng, state, states = random.Random(seed), 0, []
    days = [r["date"] for r in business_days(spark, start, end).orderBy("date").collect()]
    for day in days:
        state = 1 - state if rng.random() < (0.06 if state else 0.015) else state
        states.append((day, rng.gauss(0.0003, 1.0) * (0.026 if state else 0.010)))
    market = spark.createDataFrame(states, T.StructType([T.StructField("date", T.DateType()), T.StructField("market", T.DoubleType())]))
    names = [(t, k, 0.5 + 1.2 * rng.random(), 0.011 + 0.006 * rng.random()) for k, t in enumerate(tickers)]
    named = spark.createDataFrame(names, "ticker string, k int, beta double, idio double")
    rows = named.crossJoin(F.broadcast(market)).repartition("ticker").sortWithinPartitions("ticker", "date")  # every name has every day, by definition
    walk = F.sum(F.col("beta") * F.col("market") + F.col("idio") * F.randn(seed)).over(by_name().rowsBetween(Window.unboundedPreceding, 0))
    close = rows.withColumn("close", 40.0 * (1 + F.col("k") % 7) * F.exp(walk))
    wick = lambda s: F.abs(F.randn(seed + s)) * 0.008
    return close.select("date", "ticker", "close", (F.col("close") * (1 + wick(1))).alias("high"), (F.col("close") * (1 - wick(2))).alias("low"), F.exp(15.5 + 0.45 * F.randn(seed + 3)).alias("volume"))


def monte_carlo_paths(spark: SparkSession, s0: float, mu: float, sigma: float, days: int = 252, paths: int = 2000, seed: int = 7) -> DataFrame:
    """(path, day, price) of geometric Brownian motions."""
    dt = 1 / 252
    steps = spark.range(paths).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"))
    shocked = steps.withColumn("shock", F.lit((mu - 0.5 * sigma**2) * dt) + F.lit(sigma * math.sqrt(dt)) * F.randn(seed))
    total = F.sum("shock").over(Window.partitionBy("path").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return shocked.select("path", "day", (s0 * F.exp(total)).alias("price"))


def audit(panel: DataFrame) -> DataFrame:
    """Per name: rows, first and last date, null closes, widest gap in days, unchanged closes, rows without volume."""
    seen = panel.select(
        "ticker", "date", "close", "volume",
        F.coalesce(F.datediff("date", F.lag("date").over(by_name())), F.lit(1)).alias("gap"),
        (F.col("close") - F.lag("close").over(by_name())).alias("change"),
    )
    return seen.groupBy("ticker").agg(
        F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if(F.col("close").isNull()).alias("null_close"),
        F.max("gap").cast("long").alias("max_gap_days"), F.count_if(F.col("change") == 0).alias("zero_returns"), F.count_if(F.col("volume") <= 0).alias("no_volume"),
    )


def dates_between(start: date, end: date) -> int:
    return (end - start).days
