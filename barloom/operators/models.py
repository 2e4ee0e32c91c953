"""Boosters from MLlib, fitted per walk-forward fold, and ensembles of their predictions."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.windows import pct_rank
from barloom.operators import boosting
from barloom.operators.labels import sample_weights
from barloom.operators.splits import prepare_fold, walk_forward

#: Settings that a tuner may change.
DEFAULTS = {"maxIter": 450, "maxDepth": 4, "stepSize": 0.035, "subsamplingRate": 0.8, "minInstancesPerNode": 20}


#: Trees after which AdaBoost's lineage is cut.
CUT = 10
#: Training rows times features that one task may hold (some 25 bytes each); MLlib fits larger folds over all executors.
CELLS = 1 << 24
#: Depth of trees up to which one task fits them: there they are laid out whole.
DEPTH = 10


def checkpoint_folder(spark: SparkSession) -> None:
    """Long boosting cuts its lineage there, which would otherwise grow with every round."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or "/tmp/checkpoints/barloom")  # one machine, as in tests


class AdaBoostR2:
    """Boosted regression trees: rows with larger errors weigh more in the next tree; predictions are weighted medians."""

    def __init__(self, estimators: int = 250, depth: int = 3, seed: int = 7, rate: float = 0.05):
        self.estimators, self.depth, self.seed, self.rate, self.trees, self.votes = estimators, depth, seed, rate, [], []

    def fit(self, df: DataFrame) -> AdaBoostR2:
        checkpoint_folder(df.sparkSession)
        current = df.select("features", "target", F.col("weight").alias("_w"))
        for k in range(self.estimators):
            tree = DecisionTreeRegressor(maxDepth=self.depth, featuresCol="features", labelCol="target", weightCol="_w", predictionCol="_p", seed=self.seed + k).fit(current)
            scored = tree.transform(current).withColumn("_e", F.abs(F.col("_p") - F.col("target")))
            r = scored.agg(F.max("_e").alias("m"), (F.sum(F.col("_w") * F.col("_e")) / F.sum("_w")).alias("l")).first()
            worst = r["m"] or 0.0
            if worst == 0:
                self.trees, self.votes = [*self.trees, tree], [*self.votes, 1.0]
                break
            loss = r["l"] / worst
            if loss >= 0.5:
                if not self.trees:
                    self.trees, self.votes = [tree], [1.0]
                break
            beta = loss / (1 - loss)
            self.trees, self.votes = [*self.trees, tree], [*self.votes, self.rate * math.log(1 / beta)]
            current = scored.withColumn("_w", F.col("_w") * F.pow(F.lit(beta), self.rate * (1 - F.col("_e") / worst))).drop("_p", "_e")
            if k % CUT == CUT - 1:
                current = current.checkpoint()
        return self

    def transform(self, df: DataFrame, column: str) -> DataFrame:
        checkpoint_folder(df.sparkSession)
        df = df.withColumn("_votes", F.array().cast("array<struct<p:double,v:double>>"))
        for low in range(0, len(self.trees), CUT):
            some = range(low, min(low + CUT, len(self.trees)))
            for k in some:
                df = self.trees[k].copy().setPredictionCol(f"_t{k}").transform(df)
            made = F.array(*(F.struct(F.col(f"_t{k}").alias("p"), F.lit(self.votes[k]).alias("v")) for k in some))
            df = df.withColumn("_votes", F.concat("_votes", made)).drop(*(f"_t{k}" for k in some))
            df = df.checkpoint() if len(self.trees) > CUT else df
        half = sum(self.votes) / 2
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("p"))
        step = lambda a, x: F.struct((a["sum"] + x["v"]).alias("sum"), F.coalesce(a["p"], F.when(a["sum"] + x["v"] >= half, x["p"])).alias("p"))
        return df.withColumn(column, F.aggregate(F.array_sort("_votes"), start, step, lambda a: a["p"])).drop("_votes")


def gbt(seed: int = 7, **settings: float) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol="target", weightCol="weight", seed=seed, **(DEFAULTS | settings))


def ridge(alpha: float, n: int, deviation: float) -> LinearRegression:
    """Closed-form ridge: Spark scales the label by its deviation, so that the penalty is scaled alike."""
    return LinearRegression(featuresCol="features", labelCol="target", elasticNetParam=0.0, solver="normal", standardization=False, regParam=alpha / max(n, 1) * max(deviation, 1e-12))


def regressors(settings: dict | None = None, seed: int = 7) -> dict:
    return {"Boost": gbt(seed, **(settings or {})), "DeepBoost": gbt(seed + 1, maxIter=500, maxDepth=5, stepSize=0.04, subsamplingRate=0.6), "AdaBoost": AdaBoostR2(seed=seed)}


def classifiers(seed: int = 7) -> dict:
    return {"Boost": GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=400, maxDepth=4, stepSize=0.04, subsamplingRate=0.8, minInstancesPerNode=10, seed=seed), "Logistic": LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight")}


def plan_of(model: object) -> boosting.Plan | None:
    """What one task would do for a booster; none for other models, or if a setting is used that only MLlib has."""
    if isinstance(model, AdaBoostR2):
        plan = boosting.Plan("adaboost", model.estimators, model.depth, model.rate, seed=model.seed)
    elif isinstance(model, GBTRegressor):
        ours = {"maxIter", "maxDepth", "stepSize", "subsamplingRate", "minInstancesPerNode", "maxBins", "seed", "featuresCol", "labelCol", "weightCol", "predictionCol", "cacheNodeIds", "checkpointInterval", "maxMemoryInMB"}
        if any(p.name not in ours and model.hasDefault(p) and model.getOrDefault(p) != model._defaultParamMap[p] for p in model.params) or model.isSet("validationIndicatorCol"):
            return None
        plan = boosting.Plan("gradient", model.getMaxIter(), model.getMaxDepth(), model.getStepSize(), model.getSubsamplingRate(), model.getMinInstancesPerNode(), model.getMaxBins(), model.getSeed())
    else:
        return None
    return plan if plan.depth <= DEPTH and plan.bins <= 256 else None


def fitted(model: object, train: DataFrame, cells: int) -> object:
    """The model fitted to train (features, target, weight, date, ticker): by one task if it can hold so many cells."""
    plan = plan_of(model)
    return model.fit(train) if plan is None or not 0 < cells <= CELLS else boosting.fit_in_task(plan, train)


def rank_average(columns: list[str], *keys: str) -> Column:
    """Mean of the columns' ranks over all rows of each key, less a half."""
    return sum((pct_rank(F.col(c), None if keys else Window.partitionBy(F.lit(1)), *keys) for c in columns), F.lit(0.0)) / len(columns) - 0.5


def stack(oof: DataFrame, columns: list[str], target: str = "target", alpha: float = 1.0) -> tuple[DataFrame, list[float]]:
    """oof with `stacked`: a ridge over the models' predictions, missing ones as 0; and its coefficients."""
    filled = oof.na.fill(0.0, subset=columns).na.drop(subset=[target])
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(filled.withColumn("target", F.col(target)))
    stats = rows.agg(F.count("*").alias("n"), F.stddev_pop("target").alias("s")).first()
    model = ridge(alpha, stats["n"], stats["s"]).fit(rows)
    return model.setPredictionCol("stacked").transform(rows).drop("features"), model.coefficients.tolist()


def fit_fold(rows: DataFrame, features: list[str], settings: dict | None = None, seed: int = 7, weighted: bool = True, models: Callable = regressors) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """Test rows of one fold (role, ...) with each model's predictions, and feature importances.

    The models are fitted at the same time, each by a task; those too large for one by MLlib, whose rounds of boosting are
    a few short jobs, which leave most of a cluster idle.
    """
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(prepare_fold(rows.cache(), features)).cache()
    train = ready.filter("role = 'train'").na.drop(subset=["target"])
    train = (sample_weights(train) if weighted else train.withColumn("weight", F.lit(1.0))).cache()
    test, gain, given = ready.filter("role = 'test'"), {}, models(settings, seed)
    cells = train.count() * len(features)
    with ThreadPoolExecutor(len(given)) as pool:
        done = list(pool.map(lambda model: fitted(model, train, cells), given.values()))
    for name, model in zip(given, done):
        test = model.transform(test, name) if isinstance(model, (AdaBoostR2, boosting.Trees)) else model.setPredictionCol(name).transform(test)
        if isinstance(given[name], GBTRegressor) and isinstance(model, boosting.Trees):
            gain[name] = dict(zip(features, model.importances().tolist()))
        elif hasattr(model, "featureImportances"):
            gain[name] = dict(zip(features, model.featureImportances.toArray().tolist()))
    return test.drop("features"), gain


def run_walk_forward(panel: DataFrame, features: list[str], settings: dict | None = None, folds: int = 5, horizon: int = 5, embargo: int = 5, seed: int = 7, weighted: bool = True, models: Callable = regressors) -> tuple[DataFrame, dict[str, float], list[dict]]:
    """Out-of-fold predictions (date, ticker, target, fwd_ret, fold, models, Ensemble), mean importances, fold summary."""
    spark = panel.sparkSession
    checkpoint_folder(spark)
    table = walk_forward(panel, folds, horizon, embargo).cache()
    rows = panel.join(table, "date")
    names = list(models(settings, seed))
    ends = [f(F.when(F.col("role") == role, F.col("date"))).alias(f"{role}_{name}") for role in ("train", "test") for name, f in (("start", F.min), ("end", F.max), ("days", F.count))]
    summary = [r.asDict() for r in table.groupBy("fold").agg(*ends).orderBy("fold").collect()]  # one row for each fold
    with ThreadPoolExecutor(max(len(summary), 1)) as pool:
        fitted = list(pool.map(lambda one: fit_fold(rows.filter(F.col("fold") == one["fold"]), features, settings, seed, weighted, models), summary))
    pooled, totals = None, {}
    for one, (scored, gain) in zip(summary, fitted):
        block = scored.select("date", "ticker", "target", "fwd_ret", F.lit(one["fold"]).alias("fold"), *names)
        pooled = block if pooled is None else pooled.unionByName(block)
        for gains in gain.values():
            for f, g in gains.items():
                totals[f] = totals.get(f, 0.0) + g / len(summary) / len(gain)
    return pooled.withColumn("Ensemble", rank_average(names, "fold")), dict(sorted(totals.items(), key=lambda r: -r[1])), summary
