from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
from barloom.operators import backtest as bt
from barloom.operators import portfolio, risk, toolkit, tsa, tuning
from barloom.operators.costs import break_even_ic, impact_cost, total_cost
from pyspark.sql import functions as F

RNG = np.random.default_rng(3)
DAYS = [date(2018, 1, 1) + timedelta(days=i) for i in range(160)]


def panel(spark, names=8):
    rows = [(d, f"n{k}", float(RNG.normal()), float(RNG.normal(0, 0.01)), float(RNG.normal())) for d in DAYS for k in range(names)]
    return spark.createDataFrame(rows, "date date, ticker string, pred double, ret1 double, target double").cache()


def test_weights_and_book(spark):
    scores = panel(spark)
    sums = portfolio.long_short_weights(scores).groupBy("date").agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross")).collect()
    assert all(abs(r["net"]) < 1e-9 and abs(r["gross"] - 1) < 1e-9 for r in sums)
    book = bt.backtest(scores, scores).cache()
    assert book.filter("net > gross + 1e-12 or leverage > 3 or cost < 0").isEmpty() and book.count() == len(DAYS)
    card = bt.performance(book, bt.rank_ic(scores), 5)
    assert len(card) == 21 and all(v == v for v in card.values()) and abs(card["ic_t_stat"]) < 4
    assert bt.cost_sensitivity(book).count() == 4


def test_drawdowns_follow_their_definition(spark):
    nets = [0.1, -0.2, -0.1, 0.5, -1.5, 0.2]
    book = spark.createDataFrame(list(zip(DAYS, nets)), "date date, net double")
    got = bt.equity(book).orderBy("date").toPandas()
    want = np.cumprod(1 + np.array(nets))
    np.testing.assert_allclose(got["equity"], want)
    np.testing.assert_allclose(got["drawdown"], want / np.maximum.accumulate(want) - 1)


def test_costs(spark):
    got = spark.createDataFrame([(0.0,), (0.5,), (2.0,)], "t double").select(total_cost(F.col("t"), F.lit(0.0)).alias("c"), impact_cost(F.col("t")).alias("i")).collect()
    assert all(r["c"] >= 0 for r in got) and got[2]["i"] < 4 * got[1]["i"]
    assert break_even_ic(1.0, 10, 0.01) > 0


def test_deflated_sharpe_falls_with_trials():
    assert bt.deflated_sharpe(0.08, 1000, 2, 0.0009, -0.3, 5) > bt.deflated_sharpe(0.08, 1000, 500, 0.0009, -0.3, 5)


def test_shrunk_covariance_and_allocations(spark):
    rows = panel(spark)
    names, cov, shrink = portfolio.ledoit_wolf(rows.select("date", "ticker", "ret1"))
    assert np.linalg.eigvalsh(cov).min() > -1e-10 and 0 <= shrink <= 1
    wide = rows.groupBy("date").pivot("ticker").agg(F.first("ret1")).toPandas()[names].to_numpy()
    x = wide - wide.mean(0)
    s = x.T @ x / (len(x) - 1)
    target = np.eye(len(names)) * np.trace(s) / len(names)
    beta = sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / len(x) ** 2
    assert abs(shrink - np.clip(beta / (((s - target) ** 2).sum() + 1e-12), 0, 1)) < 1e-6
    w = portfolio.risk_parity(names, cov)
    assert abs(sum(w.values()) - 1) < 1e-9 and min(w.values()) > 0
    assert abs(np.abs(portfolio.mean_variance_weights(np.arange(8) / 100, cov)).sum() - 1) < 1e-9
    assert len(portfolio.efficient_frontier(np.arange(8) / 100, cov)) == 25


def test_var_and_coverage(spark):
    r = RNG.standard_t(5, 3000) * 0.01
    frame = spark.createDataFrame([("s", date(2000, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(r)], "series string, date date, r double")
    table = {x["confidence"]: x for x in risk.var_table(frame).collect()}
    assert table["99%"]["historical_var"] > table["95%"]["historical_var"] and not table["95%"]["kupiec_reject"]
    assert abs(table["95%"]["historical_var"] + np.quantile(r, 0.05)) < 1e-12
    assert not risk.kupiec(150, 3000, 0.95)["reject"] and abs(risk.p_value(3.841459) - 0.05) < 1e-5
    assert risk.stress_scenarios(frame).count() == 4


def test_time_series(spark):
    y = np.cumsum(RNG.normal(size=400))
    frame = spark.createDataFrame([("s", date(2000, 1, 1) + timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(zip(np.diff(y), y))], "series string, date date, r double, y double")
    verdict = tsa.stationarity(frame).first()
    assert verdict["verdict"] == "stationary"
    acf = [r["acf"] for r in tsa.autocorrelations(frame).orderBy("lag").collect()]
    assert abs(tsa.partial_autocorrelations(acf)[0] - acf[0]) < 1e-12
    assert abs(tsa.chi2_tail(3.841459, 1) - 0.05) < 1e-5 and abs(tsa.chi2_tail(5.991465, 2) - 0.05) < 1e-5 and abs(tsa.chi2_tail(7.814728, 3) - 0.05) < 1e-5
    assert tsa.baseline_forecasts(frame).count() == 3 and tsa.least_difference_order(frame).count() == 7


def test_unit_roots_and_their_p_values(spark):
    # Published critical values of both tests.
    assert all(abs(tsa.dickey_fuller_p(t) - p) < 0.002 for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)))
    assert tsa.dickey_fuller_p(-30) == 0 and tsa.dickey_fuller_p(5) == 1 and math.isnan(tsa.dickey_fuller_p(math.nan))
    assert abs(tsa.dickey_fuller_p(tsa.ADF_MIDDLE) - tsa.dickey_fuller_p(tsa.ADF_MIDDLE + 1e-9)) < 0.001
    noise, walk = RNG.normal(size=500), np.cumsum(RNG.normal(size=500))
    assert tsa.kpss_statistic(noise)[1] > tsa.kpss_statistic(walk)[1]
    days = [date(2000, 1, 1) + timedelta(days=i) for i in range(500)]
    pairs = {"tied": 2 * walk + noise, "apart": np.cumsum(RNG.normal(size=500))}
    frame = spark.createDataFrame([(s, d, float(a), float(b)) for s, y in pairs.items() for d, a, b in zip(days, y, walk)], "series string, date date, y double, x double")
    got = {r["series"]: r for r in tsa.engle_granger(frame).collect()}
    assert got["tied"]["cointegrated"] and abs(got["tied"]["hedge_ratio"] - 2) < 0.1 and got["apart"]["adf_p"] > got["tied"]["adf_p"]
    short = spark.createDataFrame([("s", d, 1.0) for d in days[:20]] + [("flat", d, 1.0) for d in days[:200]], "series string, date date, r double")
    assert {r["series"]: (r["n"], r["adf_p"], r["verdict"]) for r in tsa.stationarity(short).collect()} == {"s": (20, None, "unit root"), "flat": (200, None, "unit root")}


def test_toolkit(spark):
    rows = spark.createDataFrame([(float(i), float(i % 7), "ab"[i % 2], float(i)) for i in range(100)], "x double, z double, c string, target double")
    w = toolkit.Winsorizer(["x"], 0.1, 0.9).fit(rows).transform(rows).agg(F.min("x"), F.max("x")).first()
    assert abs(w[0] - 9.9) < 1e-9 and abs(w[1] - 89.1) < 1e-9
    new = spark.createDataFrame([("a",), ("new",)], "c string")
    te = {r["c"]: r["c_te"] for r in toolkit.TargetEncoder(["c"]).fit(rows).transform(new).collect()}
    assert abs(te["new"] - 49.5) < 1e-9 and abs(te["a"] - (0.5 * 49 + 0.5 * 49.5)) < 1e-9
    assert {r["c"]: r["c_freq"] for r in toolkit.FrequencyEncoder(["c"]).fit(rows).transform(new).collect()} == {"a": 0.5, "new": 0.0}
    assert toolkit.correlation_prune(rows, ["x", "z", "target"]) == ["target"]
    gauss = toolkit.RankGauss(["x"]).fit(rows).transform(rows).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(gauss[0]) < 1e-6 and gauss[1] > 0.8
    assert {r["cluster"] for r in toolkit.clustered_importance(rows, {"x": 1.0, "z": 0.5, "target": 0.2}, 2)} == {1, 2}
    _, pipe = toolkit.numeric_pipeline(["x", "z"])
    assert pipe.fit(rows).transform(rows).count() == 100 and toolkit.one_hot(["c"]).fit(rows).transform(rows).count() == 100


def test_reality_check_of_noise(spark):
    rows = spark.createDataFrame([tuple(map(float, r)) for r in RNG.normal(size=(200, 3))], "s double, a double, b double")
    assert 0 <= tuning.reality_check(rows, "s", ["a", "b"], 100) <= 1


def test_factor_attribution(spark):
    x = RNG.normal(size=300)
    rows = spark.createDataFrame([(float(a), float(0.5 + 2 * a)) for a in x], "f double, y double")
    got = {r["factor"]: r for r in portfolio.factor_attribution(rows, "y", ["f"])}
    assert abs(got["f"]["beta"] - 2) < 1e-9 and abs(got["alpha"]["beta"] - 0.5 * 252) < 1e-6
    assert math.isfinite(got["f"]["t_stat"])


def test_scores_that_repeat_count_as_their_mean(spark):
    from datetime import date, timedelta

    from barloom.operators import backtest

    rows = [(date(2020, 1, 1) + timedelta(days=d), t, float(d * k)) for d in range(6) for k, t in enumerate("abc")]
    plain = spark.createDataFrame(rows, "date date, ticker string, pred double")
    twice = plain.withColumn("pred", plain["pred"] - 1).union(plain.withColumn("pred", plain["pred"] + 1))
    key = lambda f: sorted((r["date"], r["ticker"], round(r["smooth"], 9)) for r in backtest.smoothed(f).collect())
    assert key(twice) == key(plain)


def test_correlations_equal_pandas(spark):
    x = pd.DataFrame(RNG.normal(size=(300, 3)) + 1e4, columns=list("abc")).assign(d=2.0)
    x.loc[::7, "a"] = np.nan
    x.loc[::5, "c"] = np.nan
    frame = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x.to_numpy()], "a double, b double, c double, d double").repartition(5)
    got = {(r["i"], r["j"]): r["corr"] for r in toolkit.column_correlations(frame, list("abcd")).collect()}
    want = x.corr()
    assert set(got) == {(a, b) for k, a in enumerate("abcd") for b in "abcd"[k + 1 :]} and got["b", "d"] is None
    assert all(abs(got[a, b] - want.loc[a, b]) < 1e-9 for a, b in ("ab", "ac", "bc"))
    assert toolkit.column_correlations(frame.filter("a > 1e9"), ["a", "b"]).first()["corr"] is None


def test_shuffled_column_and_mutual_information(spark):
    rows = spark.createDataFrame([(i, float(i % 50) if i % 9 else None, float(i % 50), float(RNG.normal())) for i in range(3000)], "k int, x double, target double, z double").repartition(4)
    for bucket in (50_000, 400):
        mixed = toolkit.shuffled(rows, "x", 3, bucket).toPandas().sort_values("k")
        plain = rows.toPandas().sort_values("k")
        assert sorted(mixed["x"].fillna(-1)) == sorted(plain["x"].fillna(-1)) and (mixed["z"].to_numpy() == plain["z"].to_numpy()).all()
        assert abs(np.corrcoef(mixed["x"].fillna(25), plain["target"])[0, 1]) < 0.1
    assert toolkit.shuffled(rows.limit(0), "x", 3).count() == 0
    known = dict(toolkit.mutual_information(rows, ["x", "z"], "target"))
    assert known["x"] > 2 and 0 <= known["z"] < 0.1
    assert toolkit.mutual_information(rows.limit(0), ["x"], "target") == [("x", 0.0)]


def test_risk_tables_equal_numpy(spark):
    made = {s: RNG.standard_t(4, 700) * 0.01 for s in "ab"}
    frame = spark.createDataFrame([(s, date(2000, 1, 1) + timedelta(days=i), float(v)) for s, r in made.items() for i, v in enumerate(r)], "series string, date date, r double").repartition(3)
    table = {(x["series"], x["confidence"]): x for x in risk.var_table(frame, (0.9, 0.95, 0.99)).collect()}
    assert len(table) == 6
    for (s, label), row in table.items():
        r, level = made[s], float(label[:-1]) / 100
        q = np.quantile(r, 1 - level)
        flags = r < q
        assert abs(row["historical_var"] + q) < 1e-12 and row["breaches"] == flags.sum() and abs(row["expected_shortfall"] + r[r <= q].mean()) < 1e-12
        assert abs(row["kupiec_lr"] - round(risk.kupiec(int(flags.sum()), 700, level)["lr"], 2)) < 0.011
    stress = {(x["series"], x["scenario"]): x for x in risk.stress_scenarios(frame).collect()}
    worst = np.concatenate([made["a"], np.sort(made["a"])[:5]])
    assert abs(stress["a", "worst 5 days repeated"]["ann_vol"] - worst.std(ddof=1) * math.sqrt(252)) < 1e-9
    shocked = np.append(made["b"], -3 * made["b"].std(ddof=1))
    assert abs(stress["b", "fat left tail (-3 sigma shock)"]["var_95"] + np.quantile(shocked, 0.05)) < 1e-12


def test_weights_by_key_and_uniqueness(spark):
    from barloom.operators import labels

    x = pd.DataFrame([(f, date(2020, 1, 1) + timedelta(days=d), t, float(RNG.uniform(0.1, 1))) for f in (1, 2) for d in range(20) for t in "abc"[: 1 + d % 3]], columns=["fold", "date", "ticker", "u"])
    frame = spark.createDataFrame(x.values.tolist(), "fold int, date date, ticker string, u double").repartition(4)
    for key in ((), ("fold",)):
        want = []
        for _, part in x.groupby(list(key)) if key else [(0, x)]:
            part = part.sort_values(["date", "ticker", "u"])
            w = part["u"] / part["u"].mean() * np.linspace(0.35, 1, len(part))
            want += list(zip(part["fold"], part["date"], part["ticker"], (w / w.mean()).round(9)))
        got = labels.sample_weights(frame, "u", key=key).collect()
        assert len(got) == len(x) and abs(sum(r["weight"] for r in got) / len(x) - 1) < 1e-9
        near = zip(sorted((r["fold"], r["date"], r["ticker"], r["weight"]) for r in got), sorted(want))
        assert all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-8 for a, b in near)


def test_neutral_and_gross_limits():
    mu, cov = np.arange(6) / 100, np.eye(6) * 0.04
    free = portfolio.mean_variance_weights(mu, cov, gross_limit=2.0, market_neutral=False)
    neutral = portfolio.mean_variance_weights(mu, cov, gross_limit=0.5)
    assert abs(np.abs(free).sum() - 2) < 1e-9 and free.min() >= 0
    assert abs(np.abs(neutral).sum() - 0.5) < 1e-9 and abs(neutral.sum()) < 1e-9
    assert not portfolio.mean_variance_weights(mu * 0, cov).any()
