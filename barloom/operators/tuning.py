"""Search over booster settings, and statistics of overfitting."""

from __future__ import annotations

import math
import random
from itertools import combinations, islice

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.windows import all_dates, pct_rank
from barloom.operators.backtest import rank_ic
from barloom.operators.models import DEFAULTS, checkpoint_folder, gbt
from barloom.operators.splits import prepare_fold, unique_dates


def suggest(rng: random.Random) -> dict:
    """One draw of booster settings, rates on a logarithmic scale."""
    log = lambda a, b: math.exp(rng.uniform(math.log(a), math.log(b)))
    return {"maxIter": rng.randrange(200, 901, 50), "maxDepth": rng.randint(2, 7), "stepSize": log(0.005, 0.15), "subsamplingRate": rng.uniform(0.5, 1.0), "minInstancesPerNode": round(log(1, 60))}


def tune(panel: DataFrame, features: list[str], trials: int = 25, horizon: int = 5, embargo: int = 5, seed: int = 7, inner: float = 0.7, turnover_penalty: float = 0.0) -> tuple[dict, list[dict]]:
    """The best settings by mean over deviation of daily rank ICs on later dates, and all trials.

    With a penalty, that many times the mean daily move of the mean prediction is taken off.
    """
    dates = unique_dates(panel)
    cut = int(len(dates) * inner)
    role = F.when(F.col("date") <= F.lit(dates[max(cut - horizon - embargo, 1) - 1]), "train").when(F.col("date") >= F.lit(dates[min(cut, len(dates) - 1)]), "test")
    rows = panel.withColumn("role", role).filter("role is not null")
    count = {r["role"]: r["n"] for r in rows.groupBy("role").agg(F.count("*").alias("n")).collect()}
    if not trials or count.get("train", 0) < 500 or count.get("test", 0) < 200:
        return dict(DEFAULTS), []
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(prepare_fold(rows, features)).withColumn("weight", F.lit(1.0)).cache()
    checkpoint_folder(panel.sparkSession)
    rng, done = random.Random(seed), []
    for _ in range(trials):
        settings = suggest(rng)
        scored = gbt(seed, **settings).setPredictionCol("pred").fit(ready.filter("role = 'train'")).transform(ready.filter("role = 'test'"))
        r = rank_ic(scored).agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"), F.count("*").alias("n")).first()
        value = r["m"] / ((r["s"] or 0.0) + 1e-6) if r["n"] >= 20 else -1.0
        if turnover_penalty and r["n"] >= 20:
            level = scored.groupBy("date").agg(F.avg("pred").alias("p"))  # one row for each date
            value -= turnover_penalty * (level.select(F.abs(F.col("p") - F.lag("p").over(all_dates())).alias("d")).agg(F.avg("d").alias("d")).first()["d"] or 0.0)
        done.append({"settings": settings, "value": value})
    ready.unpersist()
    return max(done, key=lambda t: t["value"])["settings"], done


def overfit_probability(performance: DataFrame, most: int = 200) -> DataFrame:
    """(combo, best, oos_rank, loss) for performance (block, model, value): of each half of the blocks, in lexicographic
    order and `most` at most, the best model inside it and its rank outside. The mean of loss is the probability.

    Models that lack a value are left out; there have to be two models and four blocks.
    """
    spark = performance.sparkSession
    blocks = [r["block"] for r in performance.select("block").distinct().orderBy("block").collect()]
    full = performance.groupBy("model").agg(F.count("value").alias("n")).filter(F.col("n") == len(blocks)).select("model")
    half = [(k, b, b in chosen) for k, chosen in enumerate(islice(combinations(blocks, len(blocks) // 2), most)) for b in blocks] if len(blocks) >= 4 else []
    combos = spark.createDataFrame(half, "combo int, block int, inside boolean")
    joined = performance.join(full, "model", "left_semi").join(F.broadcast(combos), "block")  # at most `most` halves of the blocks
    means = joined.groupBy("combo", "model").agg(F.avg(F.when(F.col("inside"), F.col("value"))).alias("i"), F.avg(F.when(~F.col("inside"), F.col("value"))).alias("o"))
    by = Window.partitionBy("combo")
    ranked = means.withColumns({"rank": pct_rank(F.col("o"), None, "combo"), "models": F.count("*").over(by)}).filter("models >= 2")
    ordered = ranked.withColumn("k", F.row_number().over(by.orderBy(F.desc("i"), "model"))).filter("k = 1")
    return ordered.select("combo", F.col("model").alias("best"), F.col("rank").alias("oos_rank"), (F.col("rank") < 0.5).cast("int").alias("loss"))


def reality_check(returns: DataFrame, strategy: str, benchmarks: list[str], boots: int = 500, seed: int = 7) -> float:
    """Share of bootstrap draws whose largest centred mean excess over the benchmarks reaches the observed one.

    Draws resample dates with Poisson counts, so each is one aggregation and all are made in one job. The counts come from
    hashes of the row and the draw, whatever the partitions.
    """
    gaps = [f"x{k}" for k in range(len(benchmarks))]
    excess = returns.select(F.xxhash64(*returns.columns).alias("_row"), *((F.col(strategy) - F.col(b)).alias(x) for x, b in zip(gaps, benchmarks))).na.drop()
    means = excess.agg(*(F.avg(c).alias(c) for c in gaps)).first()
    observed = max(means)
    poisson, term, total = F.lit(0), math.exp(-1), math.exp(-1)
    for k in range(1, 12):
        poisson = poisson + (F.col("_u") > total).cast("int")
        term /= k
        total += term
    drawn = excess.withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(boots)))).withColumn("_u", F.pmod(F.xxhash64("_row", "boot", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)).withColumn("_n", poisson)
    sums = drawn.groupBy("boot").agg(*((F.sum((F.col(c) - F.lit(means[c])) * F.col("_n")) / F.sum("_n")).alias(c) for c in gaps))
    top = F.greatest(*gaps) if len(benchmarks) > 1 else F.col("x0")
    return sums.agg(F.avg((top >= observed).cast("double")).alias("p")).first()["p"]


def sharpe_blocks(book: DataFrame, blocks: int = 8) -> DataFrame:
    """(block, model, value): Sharpe ratios of contiguous blocks of dates, from book (model, date, net)."""
    by = Window.partitionBy("model")
    placed = book.withColumns({"k": F.row_number().over(by.orderBy("date")) - 1, "n": F.count("*").over(by)}).withColumn("block", F.least(F.floor(F.col("k") * blocks / F.col("n")), F.lit(blocks - 1)).cast("int"))
    return placed.groupBy("block", "model").agg((F.avg("net") / (F.stddev_samp("net") + 1e-12)).alias("value"))

