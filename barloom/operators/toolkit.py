"""Fit on training rows, transform any rows: feature transformers and importance measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, RobustScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.python import ship
from barloom.functions.windows import clip
from barloom.operators.portfolio import merge_tree


class Winsorizer:
    """Hold columns to their training quantiles."""

    def __init__(self, columns: list[str], low: float = 0.01, high: float = 0.99):
        self.columns, self.low, self.high, self.bounds = columns, low, high, {}

    def fit(self, df: DataFrame) -> Winsorizer:
        got = df.agg(*(F.percentile(c, F.array(F.lit(self.low), F.lit(self.high))).alias(c) for c in self.columns)).first()
        self.bounds = {c: tuple(got[c]) for c in self.columns if got[c] is not None}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: clip(F.col(c), *b) for c, b in self.bounds.items()})


class RankGauss:
    """Map columns to a normal distribution through training quantiles."""

    def __init__(self, columns: list[str], quantiles: int = 1000):
        self.columns, self.quantiles, self.marks = columns, quantiles, {}

    def fit(self, df: DataFrame) -> RankGauss:
        n = min(self.quantiles, max(df.count() // 2, 10))
        at = [i / (n - 1) for i in range(n)]
        got = df.agg(*(F.percentile(c, F.array(*map(F.lit, at))).alias(c) for c in self.columns)).first()
        self.marks = {c: np.array(got[c]) for c in self.columns if got[c] is not None}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        normal = NormalDist()

        def mapped(marks: np.ndarray):
            grid = np.linspace(0, 1, len(marks))

            @F.pandas_udf("double")
            def run(x: pd.Series) -> pd.Series:
                v = x.to_numpy(float)
                # A value among equal marks gets their middle rank.
                q = (np.interp(v, marks, grid) + 1 - np.interp(-v, -marks[::-1], grid)) / 2
                z = np.array([normal.inv_cdf(min(max(p, 1e-7), 1 - 1e-7)) if p == p else np.nan for p in q])
                return pd.Series(z).where(~np.isnan(v))

            return run

        return df.withColumns({c: mapped(m)(F.col(c)) for c, m in self.marks.items()})


class TargetEncoder:
    """column_te: the category's training mean drawn towards the overall one; unknown categories get that."""

    def __init__(self, columns: list[str], target: str = "target", smoothing: float = 50.0):
        self.columns, self.target, self.smoothing, self.tables, self.prior = columns, target, smoothing, {}, 0.0

    def fit(self, df: DataFrame) -> TargetEncoder:
        self.prior = df.agg(F.avg(self.target).alias("m")).first()["m"]
        for c in self.columns:
            sums = df.groupBy(c).agg(F.count(self.target).alias("n"), F.avg(self.target).alias("m"))
            w = F.col("n") / (F.col("n") + self.smoothing)
            self.tables[c] = sums.select(F.col(c).alias("_k"), (w * F.coalesce("m", F.lit(0.0)) + (1 - w) * self.prior).alias(f"{c}_te"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for c, table in self.tables.items():
            df = df.join(table, df[c] == F.col("_k"), "left").drop("_k").withColumn(f"{c}_te", F.coalesce(f"{c}_te", F.lit(self.prior)))
        return df


class FrequencyEncoder:
    """column_freq: the category's share of the training rows; unknown categories get 0."""

    def __init__(self, columns: list[str]):
        self.columns, self.tables = columns, {}

    def fit(self, df: DataFrame) -> FrequencyEncoder:
        n = df.count()
        self.tables = {c: df.groupBy(c).agg((F.count("*") / F.lit(float(max(n, 1)))).alias(f"{c}_freq")).withColumnRenamed(c, "_k") for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for c, table in self.tables.items():
            df = df.join(table, df[c] == F.col("_k"), "left").drop("_k").withColumn(f"{c}_freq", F.coalesce(f"{c}_freq", F.lit(0.0)))
        return df


def numeric_pipeline(columns: list[str], kind: str = "robust", winsorize: bool = True) -> tuple[Winsorizer | None, Pipeline]:
    """A winsorizer to fit first, if wanted, and a pipeline of median imputation and scaling into `scaled`.

    The median is a row within 1 / 10,000 of the middle one, from a summary that does not grow with the rows.
    """
    if kind not in ("robust", "standard"):
        raise ValueError("kind is robust or standard; RankGauss stands alone")
    scaler = RobustScaler(inputCol="assembled", outputCol="scaled", withCentering=True) if kind == "robust" else StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True)
    stages = [Imputer(strategy="median", relativeError=1e-4, inputCols=columns, outputCols=columns), VectorAssembler(inputCols=columns, outputCol="assembled"), scaler]
    return (Winsorizer(columns) if winsorize else None), Pipeline(stages=stages)


def one_hot(columns: list[str]) -> Pipeline:
    indexed = [f"{c}_index" for c in columns]
    return Pipeline(stages=[StringIndexer(inputCols=columns, outputCols=indexed, handleInvalid="keep"), OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_hot" for c in columns], handleInvalid="keep")])


def column_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, corr) for i before j, each over rows where both are known; null where one does not vary.

    Each task sums the products of its rows, centred by the columns' means, as matrices, and sends one row for each pair:
    what is sent grows with the pairs and the tasks, not with the rows.
    """
    ship(df.sparkSession)
    middle = df.agg(*(F.avg(c).alias(f"m{k}") for k, c in enumerate(columns))).first()
    means = np.array([0.0 if m is None else m for m in middle], float)
    i, j = np.triu_indices(len(columns), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(columns), len(columns)))
        for batch in batches:
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns]) - means
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype(float)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(t[i, j]) for t in total)], ["i", "j", *"nabcde"])

    parts = df.select(*columns).mapInArrow(run, "i int, j int, n double, a double, b double, c double, d double, e double")
    s = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in "nabcde"))
    x, y = F.col("c") - F.try_divide(F.col("a") * F.col("a"), F.col("n")), F.col("d") - F.try_divide(F.col("b") * F.col("b"), F.col("n"))
    corr = F.when((x > 0) & (y > 0), F.try_divide(F.col("e") - F.try_divide(F.col("a") * F.col("b"), F.col("n")), F.sqrt(x) * F.sqrt(y)))
    names = F.array(*map(F.lit, columns))
    return s.select(F.get(names, F.col("i")).alias("i"), F.get(names, F.col("j")).alias("j"), corr.alias("corr"))


def correlation_prune(df: DataFrame, columns: list[str], threshold: float = 0.95) -> list[str]:
    """The later column of each pair above the threshold."""
    high = {r["j"] for r in column_correlations(df, columns).filter(F.abs("corr") > threshold).collect()}
    return [c for c in columns if c in high]


def _correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    at, out = {c: k for k, c in enumerate(columns)}, np.eye(len(columns))
    for r in column_correlations(df, columns).collect():
        out[at[r["i"]], at[r["j"]]] = out[at[r["j"]], at[r["i"]]] = r["corr"] or 0.0
    return out


def vif_scores(df: DataFrame, columns: list[str]) -> list[tuple[str, float]]:
    """Variance inflation of each column after median imputation, highest first."""
    middle = df.agg(*(F.median(c).alias(c) for c in columns)).first()
    filled = df.select(*(F.coalesce(F.col(c), F.lit(middle[c])).alias(c) for c in columns))
    return sorted(zip(columns, np.diag(np.linalg.pinv(_correlation_matrix(filled, columns))).tolist()), key=lambda r: -r[1])


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 16) -> list[tuple[str, float]]:
    """Mutual information of each column with the target over a grid of quantiles, highest first.

    Two aggregations for all columns: mergeable quantile summaries (places within 1 / 10,000 of the rows), then counts of
    cells, of which the driver gets bins * bins for each column.
    """
    names, at = [*columns, target], F.array(*(F.lit(k / bins) for k in range(1, bins)))
    known = df.filter(F.col(target).isNotNull())
    marks = known.agg(*(F.percentile_approx(c, at, 10_000).alias(f"q{k}") for k, c in enumerate(names))).first()
    place = {c: sum(((F.col(c) > q).cast("int") for q in marks[f"q{k}"] or []), F.lit(0)) for k, c in enumerate(names)}
    each = F.array(*(F.struct(F.lit(c).alias("c"), F.when(F.col(c).isNotNull(), place[c]).alias("a")) for c in columns))
    counts = known.select(place[target].alias("b"), F.explode(each).alias("x")).filter("x.a is not null").groupBy("x.c", "x.a", "b").agg(F.count("*").alias("n")).collect()
    out = []
    for c in columns:
        grid = np.zeros((bins, bins))
        for r in counts:
            if r["c"] == c:
                grid[r["a"], r["b"]] = r["n"]
        share = grid / max(grid.sum(), 1)
        apart = share.sum(1, keepdims=True) * share.sum(0, keepdims=True)
        out.append((c, float((share[share > 0] * np.log(share[share > 0] / apart[share > 0])).sum())))
    return sorted(out, key=lambda r: -r[1])


def shuffled(df: DataFrame, column: str, seed: int, bucket: int = 50_000) -> DataFrame:
    """df with the column's values dealt to other rows: a random cycle within random buckets of about so many rows.

    Order and buckets are hashes of the whole row, so a lost task makes the same rows again.
    """
    n = max(1, -(-df.count() // bucket))
    drawn = F.xxhash64(*df.columns, F.lit(seed))
    cycle = Window.partitionBy(F.pmod(F.xxhash64(drawn, F.lit(1)), F.lit(n))).orderBy(drawn)
    held = F.struct(F.col(column).alias("v"))
    ahead = F.coalesce(F.lead(held).over(cycle), F.first(held).over(cycle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return df.withColumn(column, ahead["v"])


def mean_decrease(df: DataFrame, columns: list[str], predict: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], float], repeats: int = 3, seed: int = 7) -> list[dict]:
    """Fall of the score when one column is shuffled: mean and deviation over repeats, largest first."""
    whole, out = score(predict(df)), []
    for c in columns:
        falls = [whole - score(predict(shuffled(df, c, seed + k))) for k in range(repeats)]
        out.append({"feature": c, "mean": float(np.mean(falls)), "std": float(np.std(falls))})
    return sorted(out, key=lambda r: -r["mean"])


def clustered_importance(df: DataFrame, importance: dict[str, float], clusters: int = 8) -> list[dict]:
    """(cluster, feature, importance): average-linkage clusters of 1 - |corr|, by cluster and falling importance."""
    columns = list(importance)
    merges = merge_tree(1 - np.abs(_correlation_matrix(df, columns)), "average")
    groups = [[i] for i in range(len(columns))]
    for joined in merges[: max(0, len(columns) - clusters)]:
        groups = [g for g in groups if not set(g) <= set(joined)] + [joined]
    return [{"cluster": k, "feature": columns[i], "importance": importance[columns[i]]} for k, g in enumerate(sorted(groups, key=min), 1) for i in sorted(g, key=lambda i: -importance[columns[i]])]
