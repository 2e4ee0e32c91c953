"""Backward-looking features of each name, and their standardisation per date."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.python import by_group
from barloom.functions.windows import by_date, by_name, clip, kurt, mean, no_nan, rolling, skew, std

EPS = 1e-9


def _inputs() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("close", "high", "low", "volume", "ret1", "_lc"))


#: Feature names in their order; fixed values.
RAW = [
    "mom5", "mom21", "mom63", "mom252", "ma_ratio", "dist_52w_high", "rev1", "rev5", "bb_z", "rsi14", "macd_h", "stoch_k", "vol20", "vol63", "vol_ratio", "ewma_vol",
    "vov", "dn_vol", "atr_pct", "parkinson", "skew60", "kurt60", "vol_z", "amihud", "dollar_vol", "roll_spread", "hl_range", "fdiff", "entropy60", "hurst126", "gap_z",
]
CALENDAR = ["month_end", "quarter_end", "month_sin", "month_cos", "regime", "dow"]


def base(bars: DataFrame) -> DataFrame:
    """bars with ret1, the log close and other shared inputs."""
    C, H, L, V, _, LC = _inputs()
    logged = bars.withColumn("_lc", F.ln("close"))
    return logged.withColumns(
        {
            "ret1": LC - F.lag("_lc").over(by_name()),
            "_lv": F.log1p("volume"),
            "_tr": F.greatest(H - L, F.abs(H - F.lag("close").over(by_name())), F.abs(L - F.lag("close").over(by_name()))),
            "_hl2": F.pow(F.ln(H / L), 2),
            "_dv": C * V,
        }
    )


def log_return(n: int, skip: int = 0) -> Column:
    LC = F.col("_lc")
    last = LC if not skip else F.lag("_lc", skip).over(by_name())
    return last - F.lag("_lc", n).over(by_name())


def fractional_weights(d: float, width: int) -> list[float]:
    """Binomial weights of fractional differencing: each follows from the one before."""
    out = [1.0]
    while len(out) < width:
        k = len(out)
        out.append(-out[-1] * (d - k + 1) / k)
    return out


def fractional_difference(x: str, d: float = 0.4, width: int = 24) -> Column:
    """Weighted sum of the bars before the current one, which is left out."""
    total = F.lit(0.0)
    for j, w in enumerate(fractional_weights(d, width)):
        total = total + F.lit(w) * F.lag(x, j + 1).over(by_name())
    return total


def first_level() -> dict[str, Column]:
    """Features that need base() only."""
    C, H, L, V, R, _ = _inputs()
    down = F.when(R.isNotNull(), F.least(R, F.lit(0.0)))
    mean20, std20 = mean(C, 20), std(C, 20)
    low14, high14 = rolling(F.min, L, 14), rolling(F.max, H, 14)
    lagged = F.lag("ret1").over(by_name())
    pair = F.when(R.isNotNull() & lagged.isNotNull(), R)
    return {
        "mom5": log_return(5), "mom21": log_return(21), "mom63": log_return(63), "mom252": log_return(252, 21),
        "ma_ratio": C / mean(C, 50) - 1, "dist_52w_high": C / rolling(F.max, C, 252) - 1,
        "rev1": -R, "rev5": -log_return(5), "bb_z": (C - mean20) / (std20 + EPS), "stoch_k": (C - low14) / (high14 - low14 + EPS) - 0.5,
        "vol20": std(R, 20), "vol63": std(R, 63), "dn_vol": std(down, 60), "atr_pct": mean(F.col("_tr"), 14) / C,
        "parkinson": F.sqrt(mean(F.col("_hl2"), 20) / (4 * math.log(2))), "skew60": skew(R, 60), "kurt60": kurt(R, 60),
        "vol_z": (F.col("_lv") - mean(F.col("_lv"), 20)) / (std(F.col("_lv"), 20) + EPS), "amihud": mean(F.abs(R) / (F.col("_dv") + EPS), 20) * 1e9,
        "dollar_vol": F.log1p(mean(F.col("_dv"), 20)), "hl_range": (H - L) / C, "fdiff": fractional_difference("_lc"), "_mean20": mean(R, 20),
        "_lagged": lagged, "_pair": pair,
    }


def second_level() -> dict[str, Column]:
    """Features that need first_level()."""
    R = F.col("ret1")
    w = by_name().rowsBetween(-19, 0)
    cov = F.when(F.count("_pair").over(w) == 20, F.covar_samp("ret1", "_lagged").over(w))
    return {
        "vol_ratio": F.col("vol20") / (F.col("vol63") + EPS) - 1,
        "vov": std(F.col("vol20"), 60),
        "roll_spread": F.when(cov.isNotNull(), 2 * F.sqrt(F.greatest(-cov, F.lit(0.0)))),
        "gap_z": (R - F.col("_mean20")) / (F.col("vol20") + EPS),
    }


def exponential_mean(x: np.ndarray, alpha: float) -> np.ndarray:
    """Recursive mean that starts at the first value; a missing value leaves it as it was."""
    out, state = np.full(len(x), np.nan), np.nan
    for i, v in enumerate(x.tolist()):
        if v == v:
            state = v if state != state else (1 - alpha) * state + alpha * v
        out[i] = state
    return out


def exponential_std(x: np.ndarray, halflife: float) -> np.ndarray:
    """Bias-corrected deviation under weights that halve every so many rows, missing ones included."""
    keep, out = 0.5 ** (1 / halflife), np.full(len(x), np.nan)
    w = w2 = wx = wxx = 0.0
    for i, v in enumerate(x.tolist()):
        w, w2, wx, wxx = w * keep, w2 * keep * keep, wx * keep, wxx * keep
        if v == v:
            w, w2, wx, wxx = w + 1, w2 + 1, wx + v, wxx + v * v
        if w * w > w2 * (1 + 1e-12):
            m = wx / w
            out[i] = math.sqrt(max(wxx / w - m * m, 0.0) * w * w / (w * w - w2))
    return out


def expanding_rank(x: np.ndarray, least: int = 252) -> np.ndarray:
    """Share of past and present values that are not above the present one, ties averaged, from `least` values on."""
    seen, out = [], np.full(len(x), np.nan)
    for i, v in enumerate(x.tolist()):
        if v == v:
            bisect.insort(seen, v)
            if len(seen) >= least:
                a, b = bisect.bisect_left(seen, v), bisect.bisect_right(seen, v)
                out[i] = (a + 1 + b) / 2 / len(seen)
    return out


def window_entropy(x: np.ndarray, n: int = 60, bins: int = 8) -> np.ndarray:
    """Shannon entropy of the histogram of each window over its own range."""
    out = np.full(len(x), np.nan)
    for i in range(n - 1, len(x)):
        share = np.histogram(x[i - n + 1 : i + 1], bins)[0] / n
        share = share[share > 0]
        out[i] = -(share * np.log(share)).sum()
    return out


def rescaled_range(x: np.ndarray) -> float:
    """Hurst exponent from mean rescaled ranges of chunks of 8, 16, ... rows up to half the window."""
    n = len(x)
    if n < 32 or x.std() <= 1e-8:
        return math.nan
    points = []
    size = 8
    while size <= min(256, n // 2):
        chunks = x[: n // size * size].reshape(-1, size)
        spread = chunks.std(1, ddof=1)
        run = np.cumsum(chunks - chunks.mean(1, keepdims=True), 1)
        ok = spread > 0
        if ok.any():
            points.append((math.log(size), math.log((np.ptp(run[ok], axis=1) / spread[ok]).mean())))
        size *= 2
    if len(points) < 3:
        return math.nan
    a, b = np.array(points).T
    return float(((a - a.mean()) * (b - b.mean())).sum() / ((a - a.mean()) ** 2).sum())


def decimated_hurst(x: np.ndarray, n: int = 126, every: int = 5) -> np.ndarray:
    """The exponent of the n rows before every fifth row, carried forward."""
    out = np.full(len(x), np.nan)
    for i in range(n, len(x), every):
        out[i] = rescaled_range(x[i - n : i])
    return pd.Series(out).ffill().to_numpy()


SEQUENTIAL = ("rsi14", "macd_h", "ewma_vol", "entropy60", "hurst126", "_vol_rank")


def sequential(frame: DataFrame, wanted: tuple[str, ...] = SEQUENTIAL) -> DataFrame:
    """frame (ticker, date, close, ret1, vol20, ...) with features that depend on all rows before.

    One name's bars are one group; its size is bounded by the calendar, not by the number of names.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        c, r = pdf["close"].to_numpy(float), pdf["ret1"].to_numpy(float)
        r0 = np.nan_to_num(r)
        out = pdf[["ticker", "date"]].copy()
        if "rsi14" in wanted:
            step = np.diff(c, prepend=np.nan)
            up, down = (exponential_mean(np.where(np.isnan(step), np.nan, np.maximum(s * step, 0)), 1 / 14) for s in (1, -1))
            out["rsi14"] = (100 - 100 / (1 + up / (down + 1e-12))) / 100 - 0.5
        if "macd_h" in wanted:
            macd = exponential_mean(c, 2 / 13) - exponential_mean(c, 2 / 27)
            out["macd_h"] = (macd - exponential_mean(macd, 0.2)) / (pd.Series(c).rolling(63).std().to_numpy() + EPS)
        if "ewma_vol" in wanted:
            out["ewma_vol"] = exponential_std(r, 20)
        if "entropy60" in wanted:
            out["entropy60"] = window_entropy(r0)
        if "hurst126" in wanted:
            out["hurst126"] = decimated_hurst(r0)
        if "_vol_rank" in wanted:
            out["_vol_rank"] = expanding_rank(pdf["vol20"].to_numpy(float))
        return out

    needed = frame.select("ticker", "date", "close", "ret1", *(["vol20"] if "_vol_rank" in wanted else []))
    made = by_group(needed, "ticker", run, "ticker string, date date, " + ", ".join(f"{c} double" for c in wanted))
    return frame.join(made.select("ticker", "date", *(no_nan(F.col(c)).alias(c) for c in wanted)), ["ticker", "date"])


def regime(rank: Column) -> Column:
    """0, 1, 2 for the lower 40 %, the next 35 % and the rest."""
    return F.when(rank <= 0.4, 0.0).when(rank <= 0.75, 1.0).when(rank <= 1.01, 2.0)


def label_columns(horizon: int) -> dict[str, Column]:
    """fwd_ret, target, target_bin and t1; target is not yet clipped."""
    LC = F.col("_lc")
    ahead = F.lead("_lc", horizon).over(by_name()) - LC
    return {"fwd_ret": ahead, "target": ahead / (F.col("vol20") * math.sqrt(horizon) + EPS), "target_bin": F.signum(ahead), "t1": F.lead("date", horizon).over(by_name())}


def calendar_columns() -> dict[str, Column]:
    end = F.col("date") == F.last_day("date")
    turn = 2 * math.pi * F.month("date") / 12
    return {"dow": F.weekday("date"), "month": F.month("date"), "month_end": end.cast("int"), "quarter_end": (end & (F.month("date") % 3 == 0)).cast("int"), "month_sin": F.sin(turn), "month_cos": F.cos(turn)}


def per_date_z(x: str) -> Column:
    """x against its mean and deviation over the date's names, held to five deviations."""
    return clip((F.col(x) - F.avg(x).over(by_date())) / (F.stddev_samp(x).over(by_date()) + EPS), -5, 5)


def window_features(bars: DataFrame) -> DataFrame:
    return base(bars).withColumns(first_level()).withColumns(second_level())


def per_name_features(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """bars with all raw features, regime and labels."""
    full = sequential(window_features(bars)).withColumn("regime", regime(F.col("_vol_rank")))
    labelled = full.withColumns(label_columns(horizon))
    return labelled.drop(*(c for c in labelled.columns if c.startswith("_")))


def build_panel(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """The feature panel: raw and standardised features, calendar, labels; rows without target or vol20 go last of all."""
    full = per_name_features(bars, horizon).withColumns(calendar_columns())
    scored = full.withColumns({f"{c}_cs": per_date_z(c) for c in RAW})
    return scored.withColumn("target", clip(F.col("target"), -6, 6)).na.drop(subset=["target", "vol20"])


def feature_columns(panel: DataFrame, standardised: bool = True) -> list[str]:
    names = [f"{c}_cs" if standardised else c for c in RAW] + CALENDAR
    return [c for c in names if c in panel.columns]
