from __future__ import annotations

from barloom.operators.models import AdaBoostR2, gbt, rank_average, run_walk_forward
from barloom.sources.bars import load_prices, save_prices
from barloom.streaming.event_bars import event_bars
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F


def test_stream_gives_the_closed_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = event_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("made").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    made, whole = spark.table("made"), event_bars(events)
    assert made.count() > 0 and made.exceptAll(whole).isEmpty()


def test_files_round_trip(spark, prices, tmp_path):
    save_prices(prices, str(tmp_path / "p"))
    assert load_prices(spark, str(tmp_path / "p")).count() == prices.count()
    assert load_prices(spark, str(tmp_path / "none"), fallback=prices).count() == prices.count()


def test_models(spark):
    rows = spark.range(300).select((F.col("id") % 10).cast("double").alias("x"), F.lit(1.0).alias("weight")).withColumn("target", F.col("x") * 2 + F.rand(1))
    ready = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    scored = AdaBoostR2(3).fit(ready).transform(ready, "p")
    assert scored.stat.corr("p", "target") > 0.9
    ranks = scored.select(rank_average(["p", "target"]).alias("r")).agg(F.avg("r")).first()[0]
    assert abs(ranks) < 0.05


def test_walk_forward_pools_every_fold(spark):
    days = F.explode(F.sequence(F.to_date(F.lit("2018-01-01")), F.to_date(F.lit("2019-06-30"))))
    panel = spark.range(4).select(F.format_string("n%d", "id").alias("ticker"), days.alias("date")).withColumns({"a": F.randn(1), "target": F.randn(2), "fwd_ret": F.randn(3)}).cache()
    # The defaults' 1,200 trees a fold take many minutes here; their numbers are tested below.
    few = lambda settings, seed: {"Boost": gbt(seed, **settings), "DeepBoost": gbt(seed + 1, maxIter=3, maxDepth=3), "AdaBoost": AdaBoostR2(3)}
    oof, gain, folds = run_walk_forward(panel, ["a"], {"maxIter": 2, "maxDepth": 2}, folds=2, models=few)
    assert {"Boost", "DeepBoost", "AdaBoost", "Ensemble"} <= set(oof.columns) and len(folds) == 2 and "a" in gain
    assert oof.select("fold").distinct().count() == 2
    assert all(f["train_end"] < f["test_start"] and f["test_days"] >= 20 and f["train_days"] > 200 for f in folds)


def test_default_rounds_and_search_ranges():
    import random

    from barloom.operators.models import regressors
    from barloom.operators.tuning import suggest

    models = regressors()
    assert [(models[m].getMaxIter(), models[m].getStepSize()) for m in ("Boost", "DeepBoost")] == [(450, 0.035), (500, 0.04)]
    assert (models["AdaBoost"].estimators, models["AdaBoost"].rate) == (250, 0.05)
    rounds = {suggest(random.Random(k))["maxIter"] for k in range(300)}
    assert rounds == set(range(200, 901, 50))


def test_boosted_query_is_the_whole_walk(spark, sf, monkeypatch):
    from barloom.operators import models
    from barloom.plans.queries import boosted_walk_forward

    seen = {}
    monkeypatch.setattr(models, "run_walk_forward", lambda panel, features, *a, **k: seen.update(features=features, a=a, k=k) or [panel])
    boosted_walk_forward(spark, sf)
    assert len(seen["features"]) == 37 and not seen["a"] and not seen["k"]


def test_many_trees_of_adaboost_keep_their_lineage_short(spark):
    rows = spark.range(200).select((F.col("id") % 10).cast("double").alias("x"), F.lit(1.0).alias("weight")).withColumn("target", F.col("x") * 2 + F.rand(1))
    ready = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    model = AdaBoostR2(25).fit(ready)
    scored = model.transform(ready, "p")
    assert len(model.trees) == 25 and scored.stat.corr("p", "target") > 0.9
    assert scored._jdf.queryExecution().logical().toString().count("UDF") < 11


def test_boosters_of_one_task_equal_mllib(spark):
    from barloom.operators import models

    days = F.expr("date_add(date'2020-01-01', cast(id as int))")
    columns = {f"x{k}": (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(9 + k))).cast("double") for k in range(4)}
    rows = spark.range(600).withColumns({"date": days, "ticker": F.lit("a"), **columns})
    rows = rows.withColumns({"target": F.col("x0") * F.col("x1") - F.col("x2") + F.randn(3), "weight": 0.5 + F.rand(4)})
    ready = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows).cache()
    model = gbt(3, maxIter=12, maxDepth=3, subsamplingRate=1.0)
    one, all_over = models.fitted(model, ready, 2400), models.fitted(model, ready, models.CELLS + 1)
    both = all_over.setPredictionCol("q").transform(one.transform(ready, "p"))
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9
    assert max(abs(a - b) for a, b in zip(one.importances(), all_over.featureImportances.toArray())) < 1e-9
    ada = AdaBoostR2(12)
    both = ada.fit(ready).transform(models.fitted(ada, ready, 2400).transform(ready, "p"), "q")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9


def test_a_tree_of_the_walk_takes_no_jobs(spark, prices):
    """All 1,200 default trees of a fold; with MLlib's jobs for each this took many minutes."""
    import time

    from barloom.operators.models import fit_fold

    days = F.explode(F.sequence(F.to_date(F.lit("2018-01-01")), F.to_date(F.lit("2019-06-30"))))
    role = F.when(F.col("date") < "2019-01-01", "train").otherwise("test")
    panel = spark.range(4).select(F.format_string("n%d", "id").alias("ticker"), days.alias("date")).withColumns({"a": F.randn(1), "target": F.randn(2), "role": role}).cache()
    began = time.time()
    first, again = (fit_fold(panel, ["a"])[0].select("ticker", "date", "Boost", "DeepBoost", "AdaBoost").collect() for _ in range(2))
    assert time.time() - began < 120 and len(first) == 4 * 181 and sorted(first) == sorted(again)


def test_cut_points_part_weights_evenly():
    import numpy as np
    from barloom.operators.boosting import cut_points

    x = np.random.default_rng(1).normal(size=10_000)
    counts = np.bincount(np.searchsorted(cut_points(x, np.ones(len(x)), 31), x), minlength=32)
    assert len(counts) == 32 and abs(counts - 312.5).max() < 2
    assert cut_points(np.array([1.0, 2.0, 2.0, 4.0]), np.ones(4), 31).tolist() == [1.5, 3.0]
    assert not len(cut_points(np.ones(5), np.ones(5), 31))
