from __future__ import annotations

import math

import numpy as np
import pandas as pd
from barloom.operators import features as f
from pyspark.sql import functions as F


def test_truncation_leaves_the_past_as_it_was(spark, prices):
    """No feature of a row may depend on later rows."""
    one = prices.filter("ticker = 'AAA'")
    cut = [r["date"] for r in one.select("date").orderBy(F.desc("date")).limit(60).collect()][-1]
    whole = f.per_name_features(one).filter(F.col("date") < cut).select("date", *f.RAW, "regime").toPandas().sort_values("date")
    part = f.per_name_features(one.filter(F.col("date") < cut)).select("date", *f.RAW, "regime").toPandas().sort_values("date")
    for c in [*f.RAW, "regime"]:
        np.testing.assert_allclose(whole[c].to_numpy(float), part[c].to_numpy(float), rtol=1e-6, atol=1e-8, err_msg=c)


def test_target_is_the_scaled_forward_return(prices):
    b = f.window_features(prices).withColumns(f.label_columns(5)).filter("ticker = 'BBB'").toPandas().sort_values("date")
    want = np.log(b["close"]).shift(-5) - np.log(b["close"])
    np.testing.assert_allclose(b["fwd_ret"].to_numpy(float), want.to_numpy(float), atol=1e-12)
    np.testing.assert_allclose(b["target"].to_numpy(float), (want / (b["vol20"] * math.sqrt(5) + 1e-9)).to_numpy(float), atol=1e-9)


def test_z_scores_are_per_date_and_clipped(spark):
    rows = spark.createDataFrame([("2020-01-01", t, v) for t, v in zip("abcd", (1.0, 2.0, 3.0, None))] + [("2020-01-02", "a", 1.0)], "date string, ticker string, x double")
    got = {(r["date"], r["ticker"]): r["z"] for r in rows.withColumn("z", f.per_date_z("x")).collect()}
    assert abs(got["2020-01-01", "a"] + 1) < 1e-6 and got["2020-01-01", "d"] is None and got["2020-01-02", "a"] is None


def test_exponential_std_equals_pandas():
    x = np.array([np.nan, 0.1, -0.2, np.nan, 0.3, 0.05, -0.1])
    np.testing.assert_allclose(f.exponential_std(x, 3), pd.Series(x).ewm(halflife=3).std().to_numpy(), atol=1e-12)


def test_expanding_rank_equals_definition():
    x = np.random.default_rng(1).integers(0, 9, 40).astype(float)
    want = [pd.Series(x[: i + 1]).rank(pct=True).iloc[-1] if i >= 9 else np.nan for i in range(40)]
    np.testing.assert_allclose(f.expanding_rank(x, 10), want)


def test_hurst_of_noise_is_near_a_half():
    x = np.random.default_rng(2).normal(size=(200, 126))
    assert 0.4 < np.mean([f.rescaled_range(r) for r in x]) < 0.75
    assert math.isnan(f.rescaled_range(np.zeros(126)))


def test_panel_has_all_feature_columns(prices):
    panel = f.build_panel(prices)
    assert len(f.feature_columns(panel)) == 37
    assert panel.filter("target is null or vol20 is null or abs(target) > 6").isEmpty()
