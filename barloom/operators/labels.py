"""Triple-barrier labels, label end times, and sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.windows import by_name, forward_fill


def triple_barrier(frame: DataFrame, vol: str = "vol20", profit: float = 2.0, stop: float = 1.0, hold: int = 10) -> DataFrame:
    """ticker, date, label, bars_held and realised: which of two vol-scaled barriers the next bars cross first.

    Rows without a positive vol, and each name's last row, have label 0 and nothing else.
    """
    ahead = frame.withColumn("_p", F.collect_list(F.ln("close")).over(by_name().rowsBetween(1, hold))).withColumn("_path", F.transform("_p", lambda p: p - F.ln("close")))
    sigma = F.col(vol)
    first = lambda hit: F.array_position(F.transform("_path", hit), True)
    at = ahead.withColumns({"_up": F.nullif(first(lambda p: p > profit * sigma), F.lit(0)), "_down": F.nullif(first(lambda p: p < -stop * sigma), F.lit(0)), "_ok": (sigma > 0) & (F.size("_path") > 0)})
    crossed = F.least("_up", "_down")
    label = F.when(F.col("_ok") & crossed.isNotNull(), F.when(F.col("_down").isNull() | (F.col("_up") < F.col("_down")), 1.0).otherwise(-1.0)).otherwise(0.0)
    held = F.when(F.col("_ok"), F.coalesce(crossed.cast("int"), F.size("_path")))
    return at.select("ticker", "date", label.alias("label"), held.alias("bars_held"), F.when(F.col("_ok"), F.get("_path", held - 1)).alias("realised"))


def label_end_times(frame: DataFrame, horizon: int = 5) -> DataFrame:
    """ticker, date and t1: the date on which a label is known; the last rows share the last known one."""
    return frame.select("ticker", "date", F.lead("date", horizon).over(by_name()).alias("t1")).withColumn("t1", forward_fill(F.col("t1")))


def average_uniqueness(ends: DataFrame) -> DataFrame:
    """ticker, date, uniqueness: mean over a label's bars of 1 / labels that cover the bar.

    Coverage is a running sum of starts and ends, and the mean a difference of prefix sums: no join by range.
    """
    spans = ends.na.drop(subset=["t1"])
    grid = spans.select("ticker", "date").union(spans.select("ticker", F.col("t1").alias("date"))).distinct()
    starts = spans.groupBy("ticker", "date").agg(F.count("*").alias("starts"))
    stops = spans.groupBy("ticker", F.col("t1").alias("date")).agg(F.count("*").alias("stops"))
    upto = by_name().rowsBetween(Window.unboundedPreceding, 0)
    before = by_name().rowsBetween(Window.unboundedPreceding, -1)
    bar = grid.join(starts, ["ticker", "date"], "left").join(stops, ["ticker", "date"], "left").na.fill(0)
    covered = bar.withColumn("cover", F.sum("starts").over(upto) - F.coalesce(F.sum("stops").over(before), F.lit(0)))
    summed = covered.withColumns({"i": F.row_number().over(by_name()), "total": F.sum(F.try_divide(F.lit(1.0), F.col("cover"))).over(upto)})
    summed = summed.withColumn("own", F.try_divide(F.lit(1.0), F.col("cover"))).select("ticker", "date", "i", "total", "own")
    begin = spans.join(summed, ["ticker", "date"]).withColumnsRenamed({"i": "i0", "total": "total0", "own": "own0"})
    finish = summed.select("ticker", F.col("date").alias("t1"), "i", "total")
    return begin.join(finish, ["ticker", "t1"]).select("ticker", "date", ((F.col("total") - F.col("total0") + F.col("own0")) / (F.col("i") - F.col("i0") + 1)).alias("uniqueness"))


def time_decay(order: Column, count: Column, last: float = 1.0, first: float = 0.35) -> Column:
    """Weight from first to last along rows numbered 1 to count."""
    return F.when(count > 1, F.lit(first) + (last - first) * (order - 1) / (count - 1)).otherwise(F.lit(first))


def sample_weights(frame: DataFrame, uniqueness: str | None = None, decay: bool = True, key: tuple[str, ...] = ()) -> DataFrame:
    """frame (date, ticker, ...) with `weight`, of mean 1 over the rows of each key, in the order of date and ticker.

    A row's place is the count of rows on earlier dates, of which there is one row for each date, and its place within its
    date (by uniqueness where tickers repeat): rows are never brought together by key.
    """
    whole, day = [F.col(k) for k in key] or [F.lit(1)], [*key, "date"]
    counted = frame.groupBy(*day).agg(F.count("*").alias("_n"), *([F.sum(uniqueness).alias("_su"), F.count(uniqueness).alias("_nu")] if uniqueness else []))
    part = Window.partitionBy(*whole)
    before = F.coalesce(F.sum("_n").over(part.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mean = F.sum("_su").over(part) / F.sum("_nu").over(part) if uniqueness else F.lit(1.0)
    days = counted.select(*day, before.alias("_before"), F.sum("_n").over(part).alias("_all"), mean.alias("_mean"))
    weight = F.lit(1.0) if uniqueness is None else F.col(uniqueness) / F.col("_mean")
    if decay:
        weight = weight * time_decay(F.col("_before") + F.row_number().over(Window.partitionBy(*day).orderBy("ticker", *([uniqueness] if uniqueness else []))), F.col("_all"))
    weighed = frame.join(days, day).withColumn("_w", weight)
    level = weighed.groupBy(*key).agg(F.avg("_w").alias("_level"))
    scaled = weighed.join(level, list(key)) if key else weighed.crossJoin(F.broadcast(level))  # one row without a key
    return scaled.select(*(c for c in frame.columns if c != "weight"), (F.col("_w") / F.col("_level")).alias("weight"))


def meta_label(side: Column, realised: Column) -> Column:
    """1 if the signs of both agree and are not zero, else 0."""
    return F.when((F.signum(side) == F.signum(realised)) & (F.signum(side) != 0), 1).otherwise(0)
