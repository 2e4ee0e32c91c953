"""python -m barloom.cli: one research run, its reports written below a folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from barloom.plans.research import REPORTS, Config, Run
from barloom.sources.bars import load_prices, save_report


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--start", default="2010-01-01")
    p.add_argument("--end", default="2024-12-31")
    p.add_argument("--horizon", type=int, choices=(1, 5, 21), default=5)
    for name, kind, value in (("folds", int, 5), ("embargo", int, 5), ("n-trials", int, 25), ("quantile", float, 0.2), ("vol-target", float, 0.10)):
        p.add_argument(f"--{name}", type=kind, default=value)
    p.add_argument("--prices", help="bars as Parquet; simulated if left out")
    p.add_argument("--tickers", nargs="*")
    p.add_argument("--out", default="reports")
    o = p.parse_args(args)
    spark = SparkSession.builder.appName("barloom").getOrCreate()
    config = Config(start=o.start, end=o.end, horizon=o.horizon, folds=o.folds, embargo=o.embargo, trials=o.n_trials, quantile=o.quantile, vol_target=o.vol_target, **({"tickers": o.tickers} if o.tickers else {}))
    result = Run(spark, config, load_prices(spark, o.prices) if o.prices else None)
    for row in result.report("scorecard").collect():
        print(f"{row['metric']:>22} {row['value']:.4f}")
    for name in REPORTS:
        save_report(result.report(name), f"{o.out}/{name}")
    result.oof.write.mode("overwrite").parquet(f"{o.out}/oof")


if __name__ == "__main__":
    main()
