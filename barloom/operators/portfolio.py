"""Weights from scores, and from small covariance matrices that Spark aggregates and the driver solves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from barloom.functions.windows import by_date, clip, pct_rank, rolling


def long_short_weights(scores: DataFrame, score: str = "pred", quantile: float = 0.2, cap: float = 0.15) -> DataFrame:
    """scores (date, ticker, score) with `weight`: the ranks' tails, held to cap, summing to 0, absolutes to 1, per date."""
    ranked = scores.withColumn("_r", pct_rank(F.col(score), None, "date"))
    picked = F.col("_r").isNotNull() & ((F.col("_r") <= quantile) | (F.col("_r") >= 1 - quantile))
    raw = ranked.withColumn("_picked", picked).withColumn("_w", F.when(F.col("_picked"), clip(F.col("_r") - F.avg("_r").over(by_date()), -cap, cap)).otherwise(0.0))
    chosen = F.sum(F.col("_picked").cast("int")).over(by_date())
    level = raw.withColumn("_w", F.when(F.col("_picked"), F.col("_w") - F.try_divide(F.sum("_w").over(by_date()), chosen)).otherwise(0.0))
    gross = F.sum(F.abs("_w")).over(by_date())
    return level.withColumn("weight", F.coalesce(F.try_divide(F.col("_w"), gross), F.lit(0.0))).drop("_r", "_picked", "_w")


def kelly_fraction(mean: Column, variance: Column, fraction: float = 0.5, most: float = 3.0) -> Column:
    return F.when(variance > 0, clip(fraction * mean / variance, 0, most)).otherwise(0.0)


def vol_target_leverage(returns: Column, order: WindowSpec, target: float = 0.10, n: int = 63, most: float = 3.0) -> Column:
    """Leverage from the vol of the n rows before; 1 until there are so many."""
    vol = rolling(F.stddev_samp, returns, n, order) * 252**0.5
    return F.coalesce(clip(F.lag(target / (vol + 1e-9)).over(order), 0, most), F.lit(1.0))


def covariance_pairs(returns: DataFrame) -> DataFrame:
    """(i, j, cov, corr, n) for i <= j over dates that both names have, from returns (date, ticker, ret1).

    A date's names are brought together once; its products are summed where they are made, so that what is sent after that
    is one row for each pair of names and task, however many dates there are.
    """
    name = F.struct(F.col("ticker").alias("t"), F.col("ret1").alias("r"))
    days = returns.filter("ret1 is not null and ticker is not null").groupBy("date").agg(F.collect_list(name).alias("_all"))  # a date's names
    left = days.select("_all", F.explode("_all").alias("a"))
    both = left.select("a", F.explode(F.filter("_all", lambda b: b["t"] >= F.col("a.t"))).alias("b")).select(F.col("a.t").alias("i"), F.col("b.t").alias("j"), F.col("a.r").alias("x"), F.col("b.r").alias("y"))
    sums = both.groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"), F.count("*").alias("n"))
    return sums.select("i", "j", "cov", F.try_divide(F.col("cov"), F.col("sx") * F.col("sy")).alias("corr"), "n")


def matrix(pairs: DataFrame, value: str = "cov") -> tuple[list[str], np.ndarray]:
    """Names and the symmetric matrix of (i, j, value) rows; of p names the driver gets p (p + 1) / 2 rows."""
    rows = pairs.select("i", "j", value).collect()
    names = sorted({r["i"] for r in rows} | {r["j"] for r in rows})
    at, out = {n: k for k, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in rows:
        out[at[r["i"]], at[r["j"]]] = out[at[r["j"]], at[r["i"]]] = r[value]
    return names, out


def ledoit_wolf(returns: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """Names, covariance shrunk to a scaled identity, and the shrinkage, over dates that every name has.

    Only sums over dates leave the executors: the Gram matrix, the means, and the sum of fourth powers of the rows' norms.
    """
    kept = returns.na.drop(subset=["ret1"])
    names = [r["ticker"] for r in kept.select("ticker").distinct().orderBy("ticker").collect()]
    full = kept.groupBy("date").agg(F.count("*").alias("n")).filter(F.col("n") == len(names)).select("date")
    rows = kept.join(full, "date", "left_semi").cache()
    centred = rows.join(F.broadcast(rows.groupBy("ticker").agg(F.avg("ret1").alias("m"))), "ticker").select("date", "ticker", (F.col("ret1") - F.col("m")).alias("ret1"))
    _, cov = matrix(covariance_pairs(centred))
    norms = centred.groupBy("date").agg(F.sum(F.pow("ret1", F.lit(2))).alias("s")).agg(F.sum(F.pow("s", F.lit(2))).alias("q"), F.count("*").alias("n")).first()
    rows.unpersist()
    n, p = norms["n"], len(names)
    target = np.eye(p) * np.trace(cov) / p
    gram = cov * (n - 1)
    beta = (norms["q"] - 2 * float((gram * cov).sum()) + n * float((cov**2).sum())) / n**2
    shrink = float(np.clip(beta / (((cov - target) ** 2).sum() + 1e-12), 0, 1))
    return names, shrink * target + (1 - shrink) * cov, shrink


def mean_variance_weights(mu: np.ndarray, cov: np.ndarray, aversion: float = 5.0, cap: float = 0.10, gross_limit: float = 1.0, market_neutral: bool = True) -> np.ndarray:
    """Optimal weights without constraints, then centred if neutral, capped by name and scaled to the gross limit."""
    best = np.linalg.pinv(cov + 1e-8 * np.eye(len(mu))) @ mu / aversion
    held = np.clip(best - market_neutral * best.mean(), -cap, cap)
    return held * gross_limit / (np.abs(held).sum() or gross_limit)


def efficient_frontier(mu: np.ndarray, cov: np.ndarray, points: int = 25) -> list[tuple[float, float]]:
    """(return, vol) along the unconstrained frontier, from its closed form."""
    inverse, one = np.linalg.pinv(cov), np.ones(len(mu))
    a, b, c = one @ inverse @ one, one @ inverse @ mu, mu @ inverse @ mu
    d = a * c - b * b
    return [(float(m), float(np.sqrt(max((a * m * m - 2 * b * m + c) / (d + 1e-18), 0)))) for m in np.linspace(mu.min(), mu.max(), points)]


def merge_tree(distance: np.ndarray, linkage: str = "single") -> list[list[int]]:
    """Leaf lists in the order of agglomerative merges, the last being all leaves in dendrogram order."""
    clusters = {i: [i] for i in range(len(distance))}
    born = {i: i for i in clusters}
    merges, d, nxt = [], distance.astype(float).copy(), len(distance)
    np.fill_diagonal(d, np.inf)
    size = {i: 1 for i in clusters}
    while len(clusters) > 1:
        keys = sorted(clusters)
        sub = d[np.ix_(keys, keys)]
        i, j = divmod(int(sub.argmin()), len(keys))
        a, b = keys[i], keys[j]
        left, right = sorted((a, b), key=lambda k: born[k])
        joined = clusters[left] + clusters[right]
        for k in keys:
            if k not in (a, b):
                d[a, k] = d[k, a] = min(d[a, k], d[b, k]) if linkage == "single" else (size[a] * d[a, k] + size[b] * d[b, k]) / (size[a] + size[b])
        size[a] += size.pop(b)
        d[b], d[:, b] = np.inf, np.inf
        del clusters[b]
        clusters[a], born[a] = joined, nxt
        nxt += 1
        merges.append(joined)
    return merges


def risk_parity(names: list[str], cov: np.ndarray) -> dict[str, float]:
    """Allocation by recursive bisection along the single-linkage order of correlation distances."""
    vol = np.sqrt(np.diag(cov))
    corr = cov / (np.outer(vol, vol) + 1e-12)
    order = merge_tree(np.sqrt(np.clip((1 - corr) / 2, 0, 1)))[-1] if len(names) > 1 else [0]
    weight = np.ones(len(names))

    def variance(items: list[int]) -> float:
        part = cov[np.ix_(items, items)]
        w = 1 / np.diag(part)
        w /= w.sum()
        return float(w @ part @ w)

    def bisect(items: list[int]) -> None:
        if len(items) < 2:
            return
        a, b = items[: len(items) // 2], items[len(items) // 2 :]
        va, vb = variance(a), variance(b)
        share = 1 - va / (va + vb + 1e-12)
        weight[a] *= share
        weight[b] *= 1 - share
        bisect(a)
        bisect(b)

    bisect(order)
    return dict(zip(names, (weight / weight.sum()).tolist()))


def factor_attribution(frame: DataFrame, y: str, factors: list[str]) -> list[dict]:
    """Coefficient, standard error and t of an intercept and each factor: one aggregation of products, solved here."""
    columns = ["_one", *factors]
    rows = frame.na.drop(subset=[y, *factors]).withColumn("_one", F.lit(1.0))
    products = {f"{a}|{b}": F.sum(F.col(a) * F.col(b)) for a in [*columns, y] for b in [*columns, y]}
    got = rows.agg(F.count("*").alias("n"), *(v.alias(k) for k, v in products.items())).first()
    xx = np.array([[got[f"{a}|{b}"] for b in columns] for a in columns])
    xy = np.array([got[f"{a}|{y}"] for a in columns])
    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    rss = max(got[f"{y}|{y}"] - 2 * beta @ xy + beta @ xx @ beta, 0.0)
    error = np.sqrt(np.diag(np.linalg.pinv(xx)) * rss / max(got["n"] - len(columns), 1))
    return [{"factor": "alpha" if c == "_one" else c, "beta": float(b * (252 if c == "_one" else 1)), "std_error": float(e), "t_stat": float(b / (e + 1e-18))} for c, b, e in zip(columns, beta, error)]


def dense(scores: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """(date, ticker) of every date with every name, for each key: a panel's grid, by definition."""
    dates, names = scores.select(*key, "date").distinct(), scores.select(*key, "ticker").distinct()
    return dates.join(names, list(key)) if key else dates.crossJoin(names)


