"""One query for each operator over the driver tables, with the SQL that must give the same rows."""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from barloom.functions.windows import by_name, clip, rounded
from barloom.operators import backtest as bt
from barloom.operators import costs, features, labels, portfolio, risk, splits, toolkit, tsa, tuning
from barloom.plans.registry import ORACLES, QUERIES
from barloom.plans.sql import NAME, base, lag, r6, rank, roll
from barloom.sources import bars as src

C = F.col


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def _round(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    return df.select(*keys, *(rounded(C(c), digits).alias(c) for c in df.columns if c not in keys))


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    return src.bars(spark, sf)


def _features(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    return _round(features.window_features(_bars(spark, sf)).select("ticker", "date", *names), "ticker", "date")


def _feature_sql(**columns: str) -> str:
    return f"with {base()} select ticker, date, " + ", ".join(r6(x, n) for n, x in columns.items()) + " from b"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with vol20, ret1, a stand-in for a model's score, and the label."""
    b = features.window_features(_bars(spark, sf)).withColumns(features.label_columns(5))
    return b.select("ticker", "date", "close", "ret1", "vol20", "mom21", F.round("mom21", 9).alias("pred"), clip(C("target"), -6, 6).alias("target"))


SCORED = base() + f", scored as (select ticker, date, close, r, vol20, lc - {lag('lc', 21)} as mom21, round(lc - {lag('lc', 21)}, 9) as pred, least(greatest((lead(lc, 5) over ({NAME}) - lc) / (vol20 * sqrt(5.0) + 1e-9), -6), 6) as target_ from b), sc as (select *, case when (lead(1, 5) over ({NAME})) is not null and vol20 is not null then target_ end as target from scored)"


def _book(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf)
    return bt.backtest(scored, scored, "pred")


def _weights_sql(score: str, source: str) -> str:
    """with-list from source (ticker, date, score) to wt (ticker, date, weight)."""
    return f"""w1 as (select ticker, date, {rank(score, 'date')} as rk from {source}),
  w2 as (select *, rk is not null and (rk <= 0.2::double or rk >= 0.8::double) as picked, avg(rk) over (partition by date) as mr from w1),
  w3 as (select *, case when picked then least(greatest(rk - mr, -0.15::double), 0.15::double) else 0 end as w from w2),
  w4 as (select *, case when picked then w - sum(w) over (partition by date) / nullif(sum(picked::int) over (partition by date), 0) else 0 end as w_ from w3),
  wt as (select ticker, date, coalesce(w_ / nullif(sum(abs(w_)) over (partition by date), 0), 0) as weight from w4)"""


#: with recursive-list to book.
BOOK = f"""{SCORED},
  grid as (select d.date, t.ticker, row_number() over (partition by t.ticker order by d.date) as k from (select distinct date from sc) d, (select distinct ticker from sc) t),
  g as (select grid.*, sc.pred, sc.r from grid left join sc using (date, ticker)),
  e as (select ticker, k, date, coalesce(pred, 0)::double as up, (case when pred is null then 0 else 1 end)::double as down from g where k = 1
    union all select g.ticker, g.k, g.date, e.up * 0.5::double + coalesce(g.pred, 0), e.down * 0.5::double + case when g.pred is null then 0 else 1 end from e join g on g.ticker = e.ticker and g.k = e.k + 1),
  sm as (select ticker, date, round(up / nullif(down, 0), 12) as smooth from e),
  {_weights_sql('smooth', 'sm')},
  h0 as (select ticker, date, case when (row_number() over ({NAME}) - 1) % 5 = 0 then weight end as kept from wt),
  h1 as (select ticker, date, coalesce(last_value(kept ignore nulls) over ({NAME} rows between unbounded preceding and current row), 0) as weight from h0),
  h as (select h1.*, lag(weight) over ({NAME}) as before, g.r from h1 join g using (ticker, date)),
  day as (select date, coalesce(sum(before * r), 0) as raw, coalesce(sum(abs(weight - before)), 0) as traded, sum(abs(least(weight, 0))) as short, sum(abs(weight)) as ge, sum(weight) as ne from h group by date),
  lv as (select *, {roll('stddev_samp', 'raw', 63, 'order by date')} * sqrt(252.0) as vol from day),
  le as (select *, case when lag(vol) over (order by date) is null then 1 else least(greatest(lag(0.10::double / (vol + 1e-9)) over (order by date), 0), 3) end::double as leverage from lv),
  bk as (select date, raw * leverage as gross, traded * leverage as turnover, leverage, ge * leverage as gross_exposure, ne * leverage as net_exposure,
    traded * leverage * 5.0 / 1e4 + sqrt(traded * leverage) * 8.0 / 1e4 + short * leverage * 50.0 / 1e4 / 252 as cost, short * leverage * 50.0 / 1e4 / 252 as borrow from le),
  book as (select *, gross - cost as net from bk)"""


# ---------------------------------------------------------------------------------------------------------- sources


@query(f"with {base()} select ticker, date, {r6('close', digits=9)}, {r6('high', digits=9)}, {r6('low', digits=9)}, volume from bars")
def bars(spark, sf):
    return _round(_bars(spark, sf), "ticker", "date", "volume", digits=9)


@query(
    f"""with {base()}, x as (select *, coalesce(date_diff('day', {lag('date')}, date), 1) as gap, close - {lag('close')} as change from bars)
  select ticker, count(*) as rows, min(date) as first_date, max(date) as last_date, count_if(close is null)::bigint as null_close, max(gap) as max_gap_days, count_if(change = 0)::bigint as zero_returns, count_if(volume <= 0)::bigint as no_volume from x group by ticker"""
)
def audit(spark, sf):
    return src.audit(_bars(spark, sf))


@query(f"with {base()} select ticker, count(*) as rows from bars where ticker in (select ticker from bars group by ticker having count(*) >= 1500) group by ticker")
def long_names(spark, sf):
    return src.long_enough(_bars(spark, sf), 1500).groupBy("ticker").agg(F.count("*").alias("rows"))


@query(f"with {base()} select ticker, coalesce(s.p, 'Other') as sector, count(*) as rows from bars left join (select 'Brand#' || x as t, 'even' as p from (values ('12'), ('22'), ('32')) v(x)) s on t = ticker group by 1, 2")
def sectors(spark, sf):
    known = spark.createDataFrame([(f"Brand#{k}", "even") for k in ("12", "22", "32")], "ticker string, sector string")
    return src.with_sector(_bars(spark, sf), known).groupBy("ticker", "sector").agg(F.count("*").alias("rows"))


@query()
def simulated_panel(spark, sf):
    return src.simulate_panel(spark, ["AAA", "BBB", "CCC"], "2018-01-01", "2019-12-31")


@query()
def monte_carlo(spark, sf):
    return src.monte_carlo_paths(spark, 100.0, 0.05, 0.2, 60, 50)


@query("select event_type, date_trunc('day', ts) as start, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*) as n from events group by 1, 2")
def event_bars(spark, sf):
    from barloom.streaming.event_bars import event_bars as make

    return make(src.table(spark, sf, "events")).withColumn("start", C("start").cast("timestamp_ntz"))


# --------------------------------------------------------------------------------------------------------- features


@query(_feature_sql(ret1="r", mom5=f"lc - {lag('lc', 5)}", mom21=f"lc - {lag('lc', 21)}", mom63=f"lc - {lag('lc', 63)}", mom252=f"{lag('lc', 21)} - {lag('lc', 252)}", ma_ratio=f"close / {roll('avg', 'close', 50)} - 1", dist_52w_high=f"close / {roll('max', 'close', 252)} - 1"))
def ret_mom(spark, sf):
    return _features(spark, sf, "ret1", "mom5", "mom21", "mom63", "mom252", "ma_ratio", "dist_52w_high")


@query(_feature_sql(rev1="-r", rev5=f"-(lc - {lag('lc', 5)})", bb_z=f"(close - {roll('avg', 'close', 20)}) / ({roll('stddev_samp', 'close', 20)} + 1e-9)"))
def reversal_bb(spark, sf):
    return _features(spark, sf, "rev1", "rev5", "bb_z")


@query(_feature_sql(stoch_k=f"(close - {roll('min', 'low', 14)}) / ({roll('max', 'high', 14)} - {roll('min', 'low', 14)} + 1e-9) - 0.5"))
def stoch(spark, sf):
    return _features(spark, sf, "stoch_k")


@query(_feature_sql(vol20="vol20", vol63="vol63", vol_ratio="vol20 / (vol63 + 1e-9) - 1"))
def rolling_vol(spark, sf):
    return _features(spark, sf, "vol20", "vol63", "vol_ratio")


@query(_feature_sql(vov=roll("stddev_samp", "vol20", 60), dn_vol=roll("stddev_samp", "dn", 60)))
def vov_dnvol(spark, sf):
    return _features(spark, sf, "vov", "dn_vol")


@query(_feature_sql(atr_pct=f"{roll('avg', 'tr', 14)} / close", parkinson=f"sqrt({roll('avg', 'hl2', 20)} / (4 * ln(2.0)))", hl_range="(high - low) / close"))
def atr_parkinson(spark, sf):
    return _features(spark, sf, "atr_pct", "parkinson", "hl_range")


@query(_feature_sql(skew60=roll("skewness", "r", 60), kurt60=roll("kurtosis", "r", 60)))
def rolling_skew_kurt(spark, sf):
    return _features(spark, sf, "skew60", "kurt60")


@query(_feature_sql(vol_z=f"(lv - {roll('avg', 'lv', 20)}) / ({roll('stddev_samp', 'lv', 20)} + 1e-9)", dollar_vol=f"ln(1 + {roll('avg', 'dv', 20)})", amihud=f"{roll('avg', 'abs(r) / (dv + 1e-9)', 20)} * 1e9"))
def volume_liquidity(spark, sf):
    return _features(spark, sf, "vol_z", "dollar_vol", "amihud")


@query(
    f"""with {base()}, c as (select *, {lag('r')} as r1 from b), v as (select *, case when count(r + r1) over ({NAME} rows between 19 preceding and current row) = 20 then covar_samp(r, r1) over ({NAME} rows between 19 preceding and current row) end as cv from c)
  select ticker, date, round(case when cv is not null then 2 * sqrt(greatest(-cv, 0)) end, 6) + 0.0 as roll_spread from v"""
)
def roll_spread(spark, sf):
    return _features(spark, sf, "roll_spread")


@query(_feature_sql(fdiff=" + ".join(f"({w!r}::double) * {lag('lc', j + 1)}" for j, w in enumerate(features.fractional_weights(0.4, 24)))))
def fracdiff(spark, sf):
    return _features(spark, sf, "fdiff")


@query(_feature_sql(gap_z=f"(r - {roll('avg', 'r', 20)}) / (vol20 + 1e-9)"))
def gap_z(spark, sf):
    return _features(spark, sf, "gap_z")


def _sequential(spark, sf, *names):
    full = features.sequential(features.window_features(_bars(spark, sf)).select("ticker", "date", "close", "ret1", "vol20"), names)
    return _round(full.select("ticker", "date", *names), "ticker", "date")


@query(
    f"""with recursive {base()}, s as (select ticker, i, date, greatest(close - {lag('close')}, 0) as u, greatest({lag('close')} - close, 0) as d from b),
  e as (select ticker, i, date, u, d from s where i = 2 union all select s.ticker, s.i, s.date, e.u * 13 / 14.0 + s.u / 14.0, e.d * 13 / 14.0 + s.d / 14.0 from e join s on s.ticker = e.ticker and s.i = e.i + 1)
  select b.ticker, b.date, round((100 - 100 / (1 + e.u / (e.d + 1e-12))) / 100 - 0.5, 6) + 0.0 as rsi14 from b left join e using (ticker, date)"""
)
def rsi(spark, sf):
    return _sequential(spark, sf, "rsi14")


@query(
    f"""with recursive {base()}, s as (select ticker, i, date, close, {roll('stddev_samp', 'close', 63)} as sd from b),
  e as (select ticker, i, date, close as a, close as c, 0::double as g from s where i = 1
    union all select s.ticker, s.i, s.date, e.a * 11 / 13.0 + s.close * 2 / 13.0, e.c * 25 / 27.0 + s.close * 2 / 27.0, e.g * 0.8::double + 0.2::double * ((e.a * 11 / 13.0 + s.close * 2 / 13.0) - (e.c * 25 / 27.0 + s.close * 2 / 27.0)) from e join s on s.ticker = e.ticker and s.i = e.i + 1)
  select s.ticker, s.date, round((a - c - g) / (sd + 1e-9), 6) + 0.0 as macd_h from s join e using (ticker, date)"""
)
def macd(spark, sf):
    return _sequential(spark, sf, "macd_h")


@query(
    f"""with recursive {base()}, s as (select ticker, i, date, r from b), k as (select pow(0.5, 1 / 20.0) as k),
  e as (select ticker, i, date, 1::double as w, 1::double as w2, r as x, r * r as xx from s where i = 2
    union all select s.ticker, s.i, s.date, e.w * k + 1, e.w2 * k * k + 1, e.x * k + s.r, e.xx * k + s.r * s.r from e join s on s.ticker = e.ticker and s.i = e.i + 1, k)
  select s.ticker, s.date, round(case when w * w > w2 * (1 + 1e-12) then sqrt(greatest(xx / w - (x / w) * (x / w), 0) * w * w / (w * w - w2)) end, 6) + 0.0 as ewma_vol from s left join e using (ticker, date)"""
)
def ewma_vol(spark, sf):
    return _sequential(spark, sf, "ewma_vol")


@query(
    f"""with {base()}, v as (select ticker, date, i, vol20 from b where vol20 is not null),
  n as (select a.ticker, a.date, count(*) as n, (count_if(c.vol20 < a.vol20) + (count_if(c.vol20 = a.vol20) + 1) / 2.0) / count(*)::double as q from v a join v c on c.ticker = a.ticker and c.i <= a.i group by 1, 2)
  select b.ticker, b.date, case when n >= 252 then case when q <= 0.4::double then 0.0 when q <= 0.75::double then 1.0 else 2.0 end end as regime from b left join n using (ticker, date)"""
)
def regime(spark, sf):
    full = features.sequential(features.window_features(_bars(spark, sf)).select("ticker", "date", "close", "ret1", "vol20"), ("_vol_rank",))
    return full.select("ticker", "date", features.regime(C("_vol_rank")).alias("regime"))


@query(
    f"""with {base()}, w as (select ticker, date, i, list(coalesce(r, 0)) over ({NAME} rows between 59 preceding and current row) as l from b),
  x as (select ticker, date, i, l, list_min(l) as lo, list_max(l) as hi from w where i >= 60),
  u as (select ticker, date, lo, hi, unnest(l) as v from x),
  c as (select ticker, date, case when hi = lo then 4 else least(floor((v - lo) / (hi - lo) * 8), 7) end as bin, count(*) / 60.0::double as p from u group by all)
  select b.ticker, b.date, round(s.entropy60, 6) + 0.0 as entropy60 from b left join (select ticker, date, -sum(p * ln(p)) as entropy60 from c group by 1, 2) s using (ticker, date)"""
)
def entropy60(spark, sf):
    return _sequential(spark, sf, "entropy60")


@query(
    f"""with {base()}, a as (select ticker, date, i from b where i > 126 and (i - 127) % 5 = 0), w as (select a.ticker, a.i, c.i - a.i + 126 as pos, coalesce(c.r, 0) as x from a join b c on c.ticker = a.ticker and c.i between a.i - 126 and a.i - 1),
  ok as (select ticker, i from w group by 1, 2 having stddev_pop(x) > 1e-8), z as (select w.*, size, pos // size as chunk from w join ok using (ticker, i), (values (8), (16), (32)) v(size) where pos // size < 126 // size),
  m as (select *, x - avg(x) over (partition by ticker, i, size, chunk) as dx from z), u as (select *, sum(dx) over (partition by ticker, i, size, chunk order by pos) as run from m),
  rs as (select ticker, i, size, chunk, (max(run) - min(run)) / stddev_samp(x) as rs from u group by all having stddev_samp(x) > 0), g as (select ticker, i, size, ln(avg(rs)) as y, ln(size) as s from rs group by all),
  h as (select ticker, i, regr_slope(y, s) as h from g group by 1, 2 having count(*) >= 3)
  select b.ticker, b.date, round(last_value(h ignore nulls) over (partition by b.ticker order by b.date rows between unbounded preceding and current row), 6) + 0.0 as hurst126 from b left join h using (ticker, i)"""
)
def hurst126(spark, sf):
    return _sequential(spark, sf, "hurst126")


@query(
    f"with {base()} select ticker, date, (isodow(date) - 1)::int as dow, month(date)::int as month, (date = last_day(date))::int as month_end, (date = last_day(date) and month(date) % 3 = 0)::int as quarter_end, {r6('sin(2 * pi() * month(date) / 12)', 'month_sin')}, {r6('cos(2 * pi() * month(date) / 12)', 'month_cos')} from bars"
)
def calendar(spark, sf):
    made = _bars(spark, sf).select("ticker", "date").withColumns(features.calendar_columns())
    return _round(made, "ticker", "date", "dow", "month", "month_end", "quarter_end")


def _z_sql(x: str) -> str:
    return f"least(greatest(({x} - avg({x}) over (partition by date)) / (stddev_samp({x}) over (partition by date) + 1e-9), -5), 5)"


@query(f"with {SCORED} select ticker, date, " + ", ".join(f"round(case when {x} is not null and stddev_samp({x}) over (partition by date) is not null then {_z_sql(x)} end, 6) + 0.0 as {x}_cs" for x in ("mom21", "vol20")) + " from sc")
def cs_zscore(spark, sf):
    scored = _scored(spark, sf).withColumns({f"{c}_cs": features.per_date_z(c) for c in ("mom21", "vol20")})
    return _round(scored.select("ticker", "date", "mom21_cs", "vol20_cs"), "ticker", "date")


@query()
def feature_panel(spark, sf):
    panel = features.build_panel(_bars(spark, sf))
    return panel.select("ticker", "date", "target", *features.feature_columns(panel))


# ----------------------------------------------------------------------------------------------------------- labels


@query(
    f"with {base()} select ticker, date, round(lead(lc, 5) over ({NAME}) - lc, 6) + 0.0 as fwd_ret, round((lead(lc, 5) over ({NAME}) - lc) / (vol20 * sqrt(5.0) + 1e-9), 6) + 0.0 as target, sign(lead(lc, 5) over ({NAME}) - lc)::double + 0.0 as target_bin, lead(date, 5) over ({NAME}) as t1 from b"
)
def target(spark, sf):
    b = features.window_features(_bars(spark, sf)).withColumns(features.label_columns(5))
    return _round(b.select("ticker", "date", "fwd_ret", "target", "target_bin", "t1"), "ticker", "date", "t1")


@query(
    f"""with {base()}, p as (select ticker, date, i, lc, vol20, list(lc) over ({NAME} rows between 1 following and 10 following) as f from b),
  q as (select *, coalesce(len(f), 0) as n, list_position(list_transform(f, lambda x: x - lc > 2 * vol20), true) as up, list_position(list_transform(f, lambda x: x - lc < -vol20), true) as dn from p),
  o as (select *, coalesce(vol20 > 0 and n > 0, false) as ok, case when coalesce(up, 0) = 0 then null else up end as u, case when coalesce(dn, 0) = 0 then null else dn end as d from q)
  select ticker, date, case when ok and (u is not null or d is not null) then case when d is null or u < d then 1.0 else -1.0 end else 0.0 end as label, case when ok then coalesce(least(u, d), n) end::double as bars_held,
    round(case when ok then f[coalesce(least(u, d), n)] - lc end, 6) + 0.0 as realised from o"""
)
def triple_barrier(spark, sf):
    made = labels.triple_barrier(features.window_features(_bars(spark, sf)).select("ticker", "date", "close", "vol20"))
    return made.withColumns({"bars_held": C("bars_held").cast("double"), "realised": rounded(C("realised"))})


_ENDS = f"ends as (select ticker, date, last_value(lead5 ignore nulls) over ({NAME} rows between unbounded preceding and current row) as t1 from (select ticker, date, lead(date, 5) over ({NAME}) as lead5 from bars))"


@query(f"with {base()}, {_ENDS} select ticker, date, t1 from ends")
def label_end(spark, sf):
    return labels.label_end_times(_bars(spark, sf))


@query(
    f"""with {base()}, {_ENDS}, g as (select distinct ticker, date from (select ticker, date from ends where t1 is not null union all select ticker, t1 from ends where t1 is not null)),
  cov as (select g.ticker, g.date, count(*) as c from g join ends e on e.ticker = g.ticker and g.date between e.date and e.t1 group by 1, 2)
  select e.ticker, e.date, round(avg(1.0::double / c), 6) + 0.0 as uniqueness from ends e join cov on cov.ticker = e.ticker and cov.date between e.date and e.t1 group by 1, 2"""
)
def uniqueness(spark, sf):
    return _round(labels.average_uniqueness(labels.label_end_times(_bars(spark, sf))), "ticker", "date")


@query(
    f"with {base()}, d as (select ticker, date, 0.35::double + 0.65::double * (row_number() over (order by date, ticker) - 1) / (count(*) over () - 1) as w from bars) select ticker, date, round(w / avg(w) over (), 6) + 0.0 as weight from d"
)
def decay_weights(spark, sf):
    return _round(labels.sample_weights(_bars(spark, sf)).select("ticker", "date", "weight"), "ticker", "date")


@query(f"with {SCORED} select ticker, date, case when sign(pred) = sign(target) and sign(pred) <> 0 then 1 else 0 end as meta from sc where pred is not null and target is not null")
def meta_label(spark, sf):
    return _scored(spark, sf).na.drop(subset=["pred", "target"]).select("ticker", "date", labels.meta_label(C("pred"), C("target")).alias("meta"))


@query(f"with {SCORED} select case when target > 0 then 1 when target < 0 then -1 else 0 end as label, count(*) as n, round(count(*) / sum(count(*)) over ()::double, 12) as share from sc where target is not null group by 1")
def label_distribution(spark, sf):
    made = bt.label_distribution(_scored(spark, sf).na.drop(subset=["target"]).select(F.signum("target").cast("int").alias("label")))
    return made.withColumn("share", F.round("share", 12))


# ----------------------------------------------------------------------------------------------------------- splits

_DATES = "dd as (select date, row_number() over (order by date) - 1 as row, count(*) over () as n from (select distinct cast(l_shipdate as date) as date from lineitem))"


def _dates(spark, sf):
    return src.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()


@query(
    f"""with {_DATES}, f as (select unnest(range(5)) as fold), bb as (select fold, fold * (n // 5) + least(fold, n % 5) as a, (fold + 1) * (n // 5) + least(fold + 1, n % 5) as b, (n * 0.01::double)::int as skip, n from f, (select max(n) as n from dd)),
  t as (select row, row + 5 as t1 from dd)
  select fold, t.row, case when t.row >= a and t.row < b then 'test' else 'train' end as role from t, bb where (t.row >= a and t.row < b) or (t.row < a and t1 < a + 5) or t.row >= b + floor(n * 0.01::double)"""
)
def purged_kfold(spark, sf):
    rows = splits.numbered(_dates(spark, sf), "date").select("row", (C("row") + 5).alias("t1"))
    return splits.purged_k_fold(rows)


@query(
    f"""with {_DATES}, c as (select max(n) as n, case when max(n) < 700 then greatest(250, (0.4::double * max(n))::int) else 500 end as m from dd), s as (select n, m, greatest((n - m) // 5, 1) as span from c), f as (select unnest(range(5)) as fold),
  w as (select fold, m + fold * span as t0, case when fold < 4 then m + (fold + 1) * span else n end as t1 from f, s)
  select fold::int as fold, date, case when row >= t0 then 'test' else 'train' end as role from dd, w where t1 - t0 >= 20 and ((row >= t0 and row < t1) or row < greatest(t0 - 10, 10))"""
)
def walk_forward(spark, sf):
    return splits.walk_forward(_dates(spark, sf))


@query(
    f"""with {_DATES}, g as (select date, row, (select max(k) from range(6) r(k) where k * (n // 6) + least(k, n % 6) <= row) as grp from dd),
  cc as (select row_number() over (order by a, b) - 1 as fold, a, b from (select a.k as a, b.k as b from range(6) a(k), range(6) b(k) where a.k < b.k)),
  lim as (select fold, a, b, min(date) - 15 as lo, max(date) + 15 as hi from cc join g on grp in (a, b) group by all),
  al as (select fold, date, case when grp in (a, b) then 'test' else 'train' end as role from g, lim where grp in (a, b) or date < lo or date > hi),
  ok as (select fold, row_number() over (order by fold) - 1 as k from al group by fold having count(*) filter (role = 'train') > 250 and count(*) filter (role = 'test') > 40)
  select k::int as fold, date, role from al join ok using (fold)"""
)
def cpcv(spark, sf):
    return splits.combinatorial(_dates(spark, sf))


@query(
    f"""with {_DATES}, c as (select max(n) as n, case when max(n) < 700 then greatest(250, (0.4::double * max(n))::int) else 500 end as m from dd), s as (select n, m, greatest((n - m) // 5, 1) as span from c), f as (select unnest(range(5)) as fold),
  w as (select fold, m + fold * span as t0, case when fold < 4 then m + (fold + 1) * span else n end as t1 from f, s),
  r as (select fold::int as fold, date, case when row >= t0 then 'test' else 'train' end as role from dd, w where t1 - t0 >= 20 and ((row >= t0 and row < t1) or row < greatest(t0 - 10, 10))),
  e as (select fold, min(date) filter (role = 'test') as low, max(date) filter (role = 'test') as high from r group by fold), g as (select unnest(range(1, 13)) as embargo)
  select embargo::int as embargo, fold, count(*) filter (role = 'train' and date between low - ((5 + embargo) * 3 // 2)::int and high + ((5 + embargo) * 3 // 2)::int) as inside from r join e using (fold), g group by all"""
)
def fold_overlaps(spark, sf):
    folds = splits.walk_forward(_dates(spark, sf)).cache()
    found = [splits.overlaps(folds, 5, e).withColumn("embargo", F.lit(e)) for e in range(1, 13)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_SPLIT = "case when date < date '2000-01-01' then 'train' else 'test' end"


@query(
    f"""with {SCORED}, x as (select ticker, date, mom21, vol20, {_SPLIT} as role from sc), m as (select median(mom21) as a, median(vol20) as b from x where role = 'train'),
  y as (select ticker, date, role, coalesce(mom21, a) as mom21, coalesce(vol20, b) as vol20 from x, m), s as (select avg(mom21) as ma, stddev_samp(mom21) as sa, avg(vol20) as mb, stddev_samp(vol20) as sb from y where role = 'train')
  select ticker, date, role, round((mom21 - ma) / sa, 6) + 0.0 as mom21, round((vol20 - mb) / sb, 6) + 0.0 as vol20 from y, s"""
)
def fold_prep(spark, sf):
    rows = _scored(spark, sf).select("ticker", "date", "mom21", "vol20").withColumn("role", F.when(C("date") < F.lit("2000-01-01").cast("date"), "train").otherwise("test"))
    return _round(splits.prepare_fold(rows, ["mom21", "vol20"]), "ticker", "date", "role")


# ------------------------------------------------------------------------------------------------ scores and the book


_IC = f"""ic0 as (select date, pred, target, count(*) over (partition by date) as n from sc where pred is not null and target is not null),
  ic1 as (select date, {rank('pred', 'date')} as a, {rank('target', 'date')} as b from ic0 where n >= 5), ic as (select date, corr(a, b) as ic from ic1 group by date)"""


@query(f"with {SCORED}, {_IC} select date, round(ic, 6) + 0.0 as ic from ic where ic is not null and not isnan(ic)")
def rank_ic(spark, sf):
    return _round(bt.rank_ic(_scored(spark, sf)), "date")


@query(f"with {SCORED}, {_IC}, k as (select date, ic from ic where ic is not null and not isnan(ic)) select date, round({roll('avg', 'ic', 63, 'order by date')}, 6) + 0.0 as mean_ic from k")
def rolling_ic(spark, sf):
    return _round(bt.rolling_ic(bt.rank_ic(_scored(spark, sf))).select("date", "mean_ic"), "date")


@query(f"with {SCORED} select ticker, date, round(({rank('pred', 'year(date)')} + {rank('vol20', 'year(date)')}) / 2 - 0.5, 9) + 0.0 as ensemble from sc where pred is not null and vol20 is not null")
def rank_average(spark, sf):
    from barloom.operators.models import rank_average as average

    kept = _scored(spark, sf).na.drop(subset=["pred", "vol20"]).withColumn("fold", F.year("date"))
    return _round(kept.select("ticker", "date", average(["pred", "vol20"], "fold").alias("ensemble")), "ticker", "date", digits=9)


@query(f"with {SCORED}, {_weights_sql('pred', 'sc')} select ticker, date, round(weight, 6) + 0.0 as weight from wt")
def ls_weights(spark, sf):
    return _round(portfolio.long_short_weights(_scored(spark, sf)).select("ticker", "date", "weight"), "ticker", "date")


@query(
    f"""with {SCORED}, {_weights_sql('pred', 'sc')}, l as (select wt.ticker, wt.date, weight, lag(weight) over (partition by wt.ticker order by wt.date) as before, sc.r from wt join sc on sc.ticker = wt.ticker and sc.date = wt.date)
  select date, round(coalesce(sum(before * r), 0), 6) + 0.0 as pnl, round(sum(weight), 6) + 0.0 as net_exposure, round(sum(abs(weight)), 6) + 0.0 as gross_exposure from l group by date"""
)
def long_short(spark, sf):
    """Flagship: yesterday's ranked long-short weights earn today's returns."""
    held = portfolio.long_short_weights(_scored(spark, sf)).withColumn("before", F.lag("weight").over(by_name()))
    daily = held.groupBy("date").agg(F.coalesce(F.sum(C("before") * C("ret1")), F.lit(0.0)).alias("pnl"), F.sum("weight").alias("net_exposure"), F.sum(F.abs("weight")).alias("gross_exposure"))
    return _round(daily, "date")


@query(f"with recursive {BOOK} select ticker, date, round(smooth, 6) + 0.0 as smooth from sm")
def ewma_scores(spark, sf):
    return _round(bt.smoothed(_scored(spark, sf)), "ticker", "date")


@query(f"with recursive {BOOK} select date, " + ", ".join(r6(c) for c in ("gross", "cost", "turnover", "leverage", "gross_exposure", "net_exposure", "net")) + " from book")
def book(spark, sf):
    return _round(_book(spark, sf), "date")


@query(f"with recursive {BOOK} select date, round(leverage, 6) + 0.0 as leverage from book")
def vol_target(spark, sf):
    return _round(_book(spark, sf).select("date", "leverage"), "date")


@query(f"with recursive {BOOK} select date, round(turnover * 5.0 / 1e4, 9) + 0.0 as spread, round(sqrt(turnover) * 8.0 / 1e4, 9) + 0.0 as impact, round(0.4::double * 50.0 / 1e4 / 252, 9) + 0.0 as borrow from book")
def cost_parts(spark, sf):
    made = _book(spark, sf).select("date", costs.spread_cost(C("turnover")).alias("spread"), costs.impact_cost(C("turnover")).alias("impact"), costs.borrow_cost(F.lit(-0.4)).alias("borrow"))
    return _round(made, "date", digits=9)


@query(
    f"""with recursive {BOOK}, m as (select multiple, gross - ((cost - borrow) * multiple + borrow) as net, (cost - borrow) * multiple + borrow as cost from book, (values (1), (2), (3), (5)) v(multiple))
  select multiple || 'x' as cost_multiple, round(avg(net) * 252 / (stddev_samp(net) * sqrt(252.0) + 1e-12), 6) + 0.0 as sharpe_net, round(avg(net) * 252, 6) + 0.0 as ann_return, round(avg(cost) * 252, 6) + 0.0 as ann_cost_drag from m group by multiple"""
)
def cost_sensitivity(spark, sf):
    return _round(bt.cost_sensitivity(_book(spark, sf)), "cost_multiple")


_CURVE = "cv0 as (select date, product(1 + net) over (order by date) as equity from book), cv as (select date, equity, equity / max(equity) over (order by date) - 1 as drawdown from cv0)"


@query(f"with recursive {BOOK}, {_CURVE} select date, round(equity, 6) + 0.0 as equity, round(drawdown, 6) + 0.0 as drawdown from cv")
def equity_drawdown(spark, sf):
    return _round(bt.equity(_book(spark, sf)), "date")


@query(f"with recursive {BOOK}, {_CURVE}, s as (select drawdown, sum((drawdown >= 0)::int) over (order by date) as spell from cv) select spell::bigint as spell, sum((drawdown < 0)::int)::bigint as days from s group by 1")
def dd_duration(spark, sf):
    return bt.drawdown_spells(bt.equity(_book(spark, sf)))


@query(
    f"""with recursive {BOOK}, {_CURVE}, s as (select drawdown, sum((drawdown >= 0)::int) over (order by date) as spell from cv),
  a as (select avg(net) * 252 as m, stddev_samp(net) * sqrt(252.0) as s, avg(gross) * 252 as gm, stddev_samp(gross) * sqrt(252.0) as gs, stddev_samp(net) filter (net < 0) * sqrt(252.0) as ds, avg((net > 0)::int) as hit, quantile_cont(net, 0.95) as hi, quantile_cont(net, 0.05) as lo,
    skewness(net) as g1, kurtosis(net) as g2, count(net) as n, avg(turnover) * 252 as t, avg(cost) * 252 as c, avg(leverage) as l from book),
  d as (select min(drawdown) as dd from cv), x as (select max(n) as days from (select sum((drawdown < 0)::int) as n from s group by spell))
  select {r6('m', 'ann_return')}, {r6('s', 'ann_vol')}, {r6('m / (s + 1e-12)', 'sharpe_net')}, {r6('gm / (gs + 1e-12)', 'sharpe_gross')}, {r6('m / (ds + 1e-12)', 'sortino')}, {r6('dd', 'max_drawdown')}, days::bigint as drawdown_days, {r6('m / (abs(dd) + 1e-12)', 'calmar')}, {r6('hit', 'hit_rate', 12)},
    {r6('abs(hi / (lo + 1e-12))', 'tail_ratio')}, {r6('g1', 'skew')}, {r6('g2', 'excess_kurtosis')}, {r6('m / 252 / (s / sqrt(252.0) / sqrt(n) + 1e-12)', 't_stat')}, {r6('t', 'ann_turnover')}, {r6('c', 'ann_cost_drag')}, {r6('l', 'avg_leverage')} from a, d, x"""
)
def performance(spark, sf):
    made = bt.performance_frame(_book(spark, sf)).drop("n", "_m", "_s")
    return _round(made, "drawdown_days", "hit_rate").withColumn("hit_rate", rounded(C("hit_rate"), 12))


@query()
def scorecard(spark, sf):
    card = bt.performance(_book(spark, sf).cache(), bt.rank_ic(_scored(spark, sf)), 25)
    return spark.createDataFrame([(k, float(v)) for k, v in card.items()], "metric string, value double")


@query(
    f"""with recursive {BOOK}, rg as (select date, case when count(vol20) = 0 then null else round_even(avg(case when vol20 < 0.2 then 0 when vol20 < 0.3 then 1 else 2 end::double), 0) end as state from b group by date),
  j as (select book.date, net, last_value(state ignore nulls) over (order by book.date rows between unbounded preceding and current row) as state from book left join rg using (date))
  select case state when 0 then 'calm' when 1 then 'normal' else 'stressed' end as regime, round(avg(net), 9) + 0.0 as mean, round(stddev_samp(net), 9) + 0.0 as std, count(net) as count, round(avg(net) / (stddev_samp(net) + 1e-12) * sqrt(252.0), 6) + 0.0 as sharpe from j where state is not null group by state"""
)
def regime_breakdown(spark, sf):
    state = _scored(spark, sf).select("date", F.when(C("vol20") < 0.2, 0.0).when(C("vol20") < 0.3, 1.0).when(C("vol20").isNotNull(), 2.0).alias("regime"))
    made = bt.regime_breakdown(_book(spark, sf), state)
    return made.select("regime", rounded(C("mean"), 9).alias("mean"), rounded(C("std"), 9).alias("std"), "count", rounded(C("sharpe")).alias("sharpe"))


@query(f"with recursive {BOOK} select year(date) as year, " + ", ".join(f'round(sum(net) filter (month(date) = {m}), 6) + 0.0 as "{m}"' for m in range(1, 13)) + " from book group by 1")
def monthly_pivot(spark, sf):
    return _round(bt.monthly_returns(_book(spark, sf)), "year")


@query(f"with {SCORED}, k as (select date, r, abs(rk - avg(rk) over (partition by date)) as w from (select date, r, {rank('mom21', 'date')} as rk from sc)) select date, round(avg(r), 6) + 0.0 as market, round(sum(w * r) / nullif(sum(w), 0), 6) + 0.0 as momentum from k group by date")
def factors(spark, sf):
    scored = _scored(spark, sf)
    return _round(bt.benchmark(scored).join(bt.momentum_factor(scored), "date"), "date")


@query(f"with recursive {BOOK}, mk as (select date, avg(r) as market from sc group by date) select round(regr_slope(net, market), 6) + 0.0 as beta, round(regr_intercept(net, market) * 252, 6) + 0.0 as alpha from book join mk using (date) where market is not null")
def factor_beta(spark, sf):
    scored = _scored(spark, sf)
    joined = bt.backtest(scored, scored, "pred").join(bt.benchmark(scored), "date")
    got = {r["factor"]: r["beta"] for r in portfolio.factor_attribution(joined, "net", ["market"])}
    return spark.createDataFrame([(round(got["market"], 6) + 0.0, round(got["alpha"], 6) + 0.0)], "beta double, alpha double")


@query(f"with {SCORED} select ticker, date, round(pred, 6) + 0.0 as pred, round(vol20, 6) + 0.0 as vol20 from sc where date = (select max(date) from sc)")
def snapshot(spark, sf):
    return _round(bt.snapshot(_scored(spark, sf), ["pred", "vol20"]), "ticker", "date")


@query(f"with {SCORED}, s as (select ticker, avg(r) as m, var_samp(r) as v from sc group by ticker) select ticker, round(case when v > 0 then least(greatest(0.5 * m / v, 0), 3) else 0 end, 6) + 0.0 as kelly from s")
def kelly(spark, sf):
    sums = _scored(spark, sf).groupBy("ticker").agg(F.avg("ret1").alias("m"), F.var_samp("ret1").alias("v"))
    return _round(sums.select("ticker", portfolio.kelly_fraction(C("m"), C("v")).alias("kelly")), "ticker")


@query(f"with {base('p_type')} select a.ticker as i, c.ticker as j, round(covar_samp(a.r, c.r), 6) + 0.0 as cov, round(corr(a.r, c.r), 6) + 0.0 as corr, count(*) as n from b a join b c on a.date = c.date and a.ticker <= c.ticker where a.r is not null and c.r is not null group by 1, 2")
def covariance_pairs(spark, sf):
    return _round(portfolio.covariance_pairs(_returns(spark, sf)), "i", "j", "n")


def _returns(spark, sf, key="p_type"):
    return features.base(src.bars(spark, sf, key)).select("date", "ticker", "ret1")


@query()
def ledoit_wolf(spark, sf):
    names, cov, shrink = portfolio.ledoit_wolf(_returns(spark, sf))
    rows = [(a, b, float(cov[i, j]), shrink) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return spark.createDataFrame(rows, "i string, j string, cov double, shrinkage double")


@query()
def risk_parity(spark, sf):
    names, cov, _ = portfolio.ledoit_wolf(_returns(spark, sf))
    return spark.createDataFrame(sorted(portfolio.risk_parity(names, cov).items()), "ticker string, weight double")


@query()
def mean_variance(spark, sf):
    names, cov, _ = portfolio.ledoit_wolf(_returns(spark, sf))
    mu = {r["ticker"]: r["m"] for r in _returns(spark, sf).groupBy("ticker").agg(F.avg("ret1").alias("m")).collect()}
    import numpy as np

    w = portfolio.mean_variance_weights(np.array([mu[n] for n in names]), cov)
    return spark.createDataFrame([(n, float(x)) for n, x in zip(names, w)], "ticker string, weight double")


@query()
def efficient_frontier(spark, sf):
    import numpy as np

    names, cov, _ = portfolio.ledoit_wolf(_returns(spark, sf))
    mu = {r["ticker"]: r["m"] for r in _returns(spark, sf).groupBy("ticker").agg(F.avg("ret1").alias("m")).collect()}
    return spark.createDataFrame(portfolio.efficient_frontier(np.array([mu[n] for n in names]), cov), "ret double, vol double")


# ------------------------------------------------------------------------------------------------------------- risk


def _series(spark, sf):
    return features.base(src.bars(spark, sf, "p_type")).select(C("ticker").alias("series"), "date", C("ret1").alias("r")).na.drop()


_S = f"{base('p_type')}, s as (select ticker as series, date, r from b where r is not null)"
_Z95 = "(-1.6448536269514715::double)"


@query(
    f"""with {_S} select series, round(-quantile_cont(r, 0.05), 6) + 0.0 as historical, round(-(avg(r) + {_Z95} * stddev_samp(r)), 6) + 0.0 as gaussian,
  round(-(avg(r) + ({_Z95} + ({_Z95} * {_Z95} - 1) * skewness(r) / 6 + (pow({_Z95}, 3) - 3 * {_Z95}) * kurtosis(r) / 24) * stddev_samp(r)), 6) + 0.0 as cornish_fisher from s group by series"""
)
def var_levels(spark, sf):
    made = _series(spark, sf).groupBy("series").agg(risk.historical_var("r", 0.95).alias("historical"), risk.gaussian_var("r", 0.95).alias("gaussian"), risk.cornish_fisher_var("r", 0.95).alias("cornish_fisher"))
    return _round(made, "series")


@query(f"with {_S}, q as (select series, quantile_cont(r, 0.05) as q from s group by series) select series, round(-avg(r), 6) + 0.0 as es from s join q using (series) where r <= q group by series")
def expected_shortfall(spark, sf):
    return _round(risk.expected_shortfall(_series(spark, sf)), "series")


_FLAG = f"{_S}, q as (select series, quantile_cont(r, 0.05) as q from s group by series), fl as (select series, date, (r < q)::int as flag from s join q using (series))"


@query(
    f"""with {_FLAG}, k as (select series, sum(flag)::double as x, count(*)::double as n from fl group by series)
  select series, x::bigint as breaches, round(case when x = 0 or x = n then 0 else -2 * (((n - x) * ln(0.95::double) + x * ln(0.05::double)) - ((n - x) * ln(1 - x / n) + x * ln(x / n))) end, 6) + 0.0 as lr from k"""
)
def kupiec(spark, sf):
    cut = _series(spark, sf).groupBy("series").agg(F.percentile("r", 0.05).alias("q"))
    sums = _series(spark, sf).join(cut, "series").groupBy("series").agg(F.count_if(C("r") < C("q")).alias("breaches"), F.count("*").alias("n"))
    return sums.select("series", "breaches", rounded(risk.kupiec_column(C("breaches"), C("n"), 0.95)).alias("lr"))


@query(
    f"""with {_FLAG}, p as (select series, flag, lag(flag) over (partition by series order by date) as before from fl),
  t as (select series, count_if(before = 0 and flag = 0)::double as a, count_if(before = 0 and flag = 1)::double as b, count_if(before = 1 and flag = 0)::double as c, count_if(before = 1 and flag = 1)::double as d from p where before is not null group by series),
  u as (select *, b / greatest(a + b, 1) as p01, d / greatest(c + d, 1) as p11, (b + d) / greatest(a + b + c + d, 1) as p from t)
  select series, round(case when least(p01, p11, p) <= 0 or greatest(p01, p11, p) >= 1 then 0 else -2 * (((a + c) * ln(1 - p) + (b + d) * ln(p)) - (a * ln(1 - p01) + b * ln(p01) + c * ln(1 - p11) + d * ln(p11))) end, 6) + 0.0 as lr from u"""
)
def christoffersen(spark, sf):
    cut = _series(spark, sf).groupBy("series").agg(F.percentile("r", 0.05).alias("q"))
    flagged = _series(spark, sf).join(cut, "series").withColumn("flag", (C("r") < C("q")).cast("int"))
    return risk.transitions(flagged).select("series", rounded(risk.christoffersen_column()).alias("lr"))


#: with recursive-list to vl: each series' running deviation of half-life 20.
_EW = f"""{_S}, n as (select series, date, r, row_number() over (partition by series order by date) as i from s), k as (select pow(0.5, 1 / 20.0) as k),
  e as (select series, date, i, r, 1::double as w, 1::double as w2, r as x, r * r as xx from n where i = 1 union all select n.series, n.date, n.i, n.r, e.w * k + 1, e.w2 * k * k + 1, e.x * k + n.r, e.xx * k + n.r * n.r from e join n on n.series = e.series and n.i = e.i + 1, k),
  vl as (select series, date, r, case when w * w > w2 * (1 + 1e-12) then sqrt(greatest(xx / w - (x / w) * (x / w), 0) * w * w / (w * w - w2)) end as vol from e)"""


def _var_sql(label: str, level: float, z: float) -> str:
    p = f"({1 - level!r}::double)"
    return f"""select * from (with q as (select series, quantile_cont(r, {p}) as q, count(*)::double as n, -(avg(r) + ({z!r}::double) * stddev_samp(r)) as g,
      -(avg(r) + (({z!r}::double) + (pow({z!r}::double, 2) - 1) * skewness(r) / 6 + (pow({z!r}::double, 3) - 3 * ({z!r}::double)) * kurtosis(r) / 24) * stddev_samp(r)) as cf from s group by series),
    f as (select series, date, r, q, (r < q)::int as flag from s join q using (series)), ll as (select *, lag(flag) over (partition by series order by date) as before from f),
    t as (select series, sum(flag)::double as x, -avg(r) filter (r <= q) as es, count_if(before = 0 and flag = 0)::double as a, count_if(before = 0 and flag = 1)::double as b, count_if(before = 1 and flag = 0)::double as c, count_if(before = 1 and flag = 1)::double as d from ll group by series),
    y as (select *, b / greatest(a + b, 1) as p01, d / greatest(c + d, 1) as p11, (b + d) / greatest(a + b + c + d, 1) as pp from t),
    h as (select series, -quantile_cont(r / (vol + 1e-12), {p}) * arg_max(vol, date) as fh from vl group by series),
    l as (select *, case when x = 0 or x = n then 0 else -2 * (((n - x) * ln({level!r}::double) + x * ln({p})) - ((n - x) * ln(1 - x / n) + x * ln(x / n))) end as kl,
      case when least(p01, p11, pp) <= 0 or greatest(p01, p11, pp) >= 1 then 0 else -2 * (((a + c) * ln(1 - pp) + (b + d) * ln(pp)) - (a * ln(1 - p01) + b * ln(p01) + c * ln(1 - p11) + d * ln(p11))) end as cl from q join y using (series) join h using (series))
    select series, '{label}' as confidence, round(-q, 6) + 0.0 as historical_var, round(g, 6) + 0.0 as gaussian_var, round(cf, 6) + 0.0 as cornish_fisher_var, round(fh, 6) + 0.0 as filtered_hist_var, round(es, 6) + 0.0 as expected_shortfall, x::bigint as breaches,
      round({p} * n, 1) as expected_breaches, round(kl, 2) + 0.0 as kupiec_lr, kl > 3.84 as kupiec_reject, round(cl, 2) + 0.0 as christoffersen_lr, cl > 3.84 as christoffersen_reject from l)"""


@query(f"with recursive {_EW} {_var_sql('95%', 0.95, -1.6448536269514715)} union all {_var_sql('99%', 0.99, -2.3263478740408408)}")
def var_table(spark, sf):
    return _round(risk.var_table(_series(spark, sf)), "series", "confidence", "breaches", "expected_breaches", "kupiec_reject", "christoffersen_reject")


@query(
    f"""with {_S}, w as (select series, r, row_number() over (partition by series order by r) as k from s), a as (select series, 'base' as scenario, r from s union all select series, 'vol x2', 2 * r from s union all select series, 'worst 5 days repeated', r from s
    union all select series, 'worst 5 days repeated', r from w where k <= 5 union all select series, 'fat left tail (-3 sigma shock)', r from s union all select series, 'fat left tail (-3 sigma shock)', -3 * stddev_samp(r) from s group by series),
  v as (select series, scenario, stddev_samp(r) * sqrt(252.0) as av, -quantile_cont(r, 0.05) as q from a group by 1, 2)
  select series, scenario, round(any_value(av), 6) + 0.0 as ann_vol, round(any_value(q), 6) + 0.0 as var_95, round(-avg(r), 6) + 0.0 as es_95 from a join v using (series, scenario) where r <= -q group by 1, 2"""
)
def stress(spark, sf):
    return _round(risk.stress_scenarios(_series(spark, sf)), "series", "scenario")


# ------------------------------------------------------------------------------------------------------ time series


_BS = "partition by series order by date"


@query(f"with {_S} select series, date, round(abs(r), 6) + 0.0 as rv_d, round(sqrt({roll('avg', 'r * r', 5, _BS)}), 6) + 0.0 as rv_w, round(sqrt({roll('avg', 'r * r', 22, _BS)}), 6) + 0.0 as rv_m from s")
def har_rv(spark, sf):
    return _round(tsa.har_rv(_series(spark, sf)), "series", "date")


@query(
    f"""with {_S}, c as (select series, date, r - avg(r) over (partition by series) as a, r * r - avg(r * r) over (partition by series) as b, row_number() over ({_BS}) as i, count(*) over (partition by series) as n from s), v as (select series, sum(a * a) as va, sum(b * b) as vb from c group by series)
  select x.series, x.n, (y.i - x.i)::int as lag, round(sum(x.a * y.a) / any_value(va), 6) + 0.0 as acf, round(sum(x.b * y.b) / any_value(vb), 6) + 0.0 as acf_sq from c x join c y on x.series = y.series and y.i - x.i between 1 and 15 join v on v.series = x.series group by 1, 2, 3"""
)
def acf(spark, sf):
    return _round(tsa.autocorrelations(_series(spark, sf)), "series", "n", "lag")


@query(
    f"""with recursive {_S}, z as (select series, date, (r - avg(r) over (partition by series)) / (stddev_samp(r) over (partition by series) + 1e-12) as z, row_number() over ({_BS}) as i from s),
  e as (select series, date, i, case when z > 5 then 0 else greatest(z, 0) end as u, case when z < -5 then 0 else least(z, 0) end as d, abs(z) > 5 as hit from z where i = 1
    union all select n.series, n.date, n.i, case when greatest(e.u + n.z, 0) > 5 then 0 else greatest(e.u + n.z, 0) end, case when greatest(e.u + n.z, 0) <= 5 and least(e.d + n.z, 0) < -5 then 0 else least(e.d + n.z, 0) end, greatest(e.u + n.z, 0) > 5 or least(e.d + n.z, 0) < -5 from e join z n on n.series = e.series and n.i = e.i + 1)
  select series, date from e where hit"""
)
def cusum(spark, sf):
    return tsa.cusum_breaks(_series(spark, sf))


def _pair(spark, sf):
    b = src.bars(spark, sf, "p_type").select("date", "ticker", F.ln("close").alias("l"))
    names = b.agg(F.array_sort(F.collect_set("ticker")).alias("t"))  # six types
    two = b.crossJoin(F.broadcast(names)).filter(C("ticker").isin("x") | (C("ticker") == F.get("t", F.lit(0))) | (C("ticker") == F.get("t", F.lit(1))))
    return two.groupBy("date").agg(F.max(F.when(C("ticker") == F.get("t", F.lit(0)), C("l"))).alias("y"), F.max(F.when(C("ticker") == F.get("t", F.lit(1)), C("l"))).alias("x")).withColumn("series", F.lit("pair")).na.drop()


_P = f"{base('p_type')}, nm as (select ticker, row_number() over (order by ticker) as k from (select distinct ticker from bars)), pr as (select date, max(lc) filter (k = 1) as y, max(lc) filter (k = 2) as x from b join nm using (ticker) group by date having max(lc) filter (k = 1) is not null and max(lc) filter (k = 2) is not null), pz as (select *, row_number() over (order by date) as i from pr)"


@query(
    f"""with recursive {_P}, e as (select i, date, y, x, (1 + 1e-5::double) * x / (x * x * (1 + 1e-5::double) + 1e-3::double) * y as beta, (1 + 1e-5::double) * (1 - (1 + 1e-5::double) * x / (x * x * (1 + 1e-5::double) + 1e-3::double) * x) as p from pz where i = 1
    union all select n.i, n.date, n.y, n.x, e.beta + (e.p + 1e-5::double) * n.x / (n.x * n.x * (e.p + 1e-5::double) + 1e-3::double) * (n.y - n.x * e.beta), (e.p + 1e-5::double) * (1 - (e.p + 1e-5::double) * n.x / (n.x * n.x * (e.p + 1e-5::double) + 1e-3::double) * n.x) from e join pz n on n.i = e.i + 1)
  select 'pair' as series, date, round(beta, 6) + 0.0 as beta from e"""
)
def kalman(spark, sf):
    return _round(tsa.kalman_hedge_ratio(_pair(spark, sf)), "series", "date")


@query(
    f"""with {_P}, h as (select regr_slope(y, x) as k from pr), s as (select date, y - k * x as s from pr, h), m as (select s, lag(s) over (order by date) as before from s), q as (select regr_slope(s - before, before) as k, count(before) as n from m where before is not null)
  select 'pair' as series, round(h.k, 6) + 0.0 as hedge_ratio, round(case when n > 30 and q.k < 0 then -ln(2.0) / q.k end, 6) + 0.0 as half_life from h, q"""
)
def engle_granger(spark, sf):
    return _round(tsa.engle_granger(_pair(spark, sf)).drop("adf_p", "cointegrated"), "series")


@query()
def cointegration(spark, sf):
    return tsa.engle_granger(_pair(spark, sf)).select("series", "adf_p", "cointegrated")


@query(
    f"""with {_S}, f as (select series, date, sum(r) over ({_BS} rows between 1 following and 5 following) as y, lead(r, 5) over ({_BS}) as later from s),
  k as (select series, y, row_number() over ({_BS}) as k, count(*) over (partition by series) as n, lag(y) over ({_BS}) as before from f where later is not null),
  c as (select *, floor(n * (1 - 0.3::double)) as cut from k), t as (select series, avg(y) as m, regr_slope(y, before) as phi, arg_max(y, k) as last from c where k <= cut group by series),
  h as (select c.series, y, 0.0::double as p0, m as p1, m + pow(phi, k - cut) * (last - m) as p2 from c join t using (series) where k > cut),
  x as (select series, y, 'random_walk' as model, p0 as p from h union all select series, y, 'historical_mean', p1 from h union all select series, y, 'ar1', p2 from h)
  select series, model, round(sqrt(avg(pow(y - p, 2))), 6) + 0.0 as rmse, round(avg(abs(y - p)), 6) + 0.0 as mae, round(avg((sign(p) = sign(y))::int::double), 6) + 0.0 as directional_acc from x group by 1, 2"""
)
def baseline_forecasts(spark, sf):
    return _round(tsa.baseline_forecasts(_series(spark, sf)), "series", "model")


@query()
def serial_dependence(spark, sf):
    return tsa.serial_dependence(_series(spark, sf))


@query()
def stationarity(spark, sf):
    return tsa.stationarity(_series(spark, sf))


@query()
def difference_order(spark, sf):
    return tsa.least_difference_order(src.bars(spark, sf, "p_type").select(C("ticker").alias("series"), "date", F.ln("close").alias("y")))


@query(f"with recursive {_EW} select series, date, round(vol * sqrt(252.0), 6) + 0.0 as vol from vl")
def garch_vol(spark, sf):
    return _round(tsa.garch_vol(_series(spark, sf)), "series", "date")


@query(
    f"""with {_S}, w as (select series, date, row_number() over ({_BS}) as i, {roll('stddev_samp', 'r', 20, _BS)} as v from s), k as (select * from w where v is not null),
  n as (select a.series, a.date, count(*) as n, (count_if(c.v < a.v) + (count_if(c.v = a.v) + 1) / 2.0) / count(*)::double as q from k a join k c on c.series = a.series and c.i <= a.i group by 1, 2)
  select w.series, w.date, case when n >= 252 then case when q <= 0.4::double then 0.0 when q <= 0.75::double then 1.0 else 2.0 end end::double as state from w left join n using (series, date)"""
)
def vol_regimes(spark, sf):
    return tsa.vol_regimes(_series(spark, sf))


@query()
def curve_components(spark, sf):
    wide = src.bars(spark, sf, "p_type").groupBy("date").pivot("ticker").agg(F.first("close"))
    names = [c for c in wide.columns if c != "date"]
    renamed = wide.toDF("date", *(f"c{k}" for k in range(len(names))))
    return tsa.yield_curve_pcs(renamed, renamed.columns[1:]).select("date", "level", "slope", "curvature")


# ---------------------------------------------------------------------------------------------------------- toolkit


@query(f"with {SCORED}, q as (select quantile_cont(mom21, 0.01) as lo, quantile_cont(mom21, 0.99) as hi from sc where date < date '2000-01-01') select ticker, date, round(case when mom21 is not null then least(greatest(mom21, lo), hi) end, 6) + 0.0 as mom21 from sc, q")
def winsorize(spark, sf):
    rows = _scored(spark, sf).select("ticker", "date", "mom21")
    fitted = toolkit.Winsorizer(["mom21"]).fit(rows.filter(C("date") < F.lit("2000-01-01").cast("date")))
    return _round(fitted.transform(rows), "ticker", "date")


@query(
    f"""with {SCORED}, tr as (select * from sc where date < date '2000-01-01'), p as (select avg(target) as prior from tr), k as (select ticker, count(target) as n, avg(target) as m from tr group by ticker)
  select sc.ticker, date, round(coalesce(n / (n + 50.0::double) * coalesce(m, 0) + (1 - n / (n + 50.0::double)) * prior, prior), 6) + 0.0 as ticker_te from sc left join k using (ticker), p"""
)
def target_encode(spark, sf):
    rows = _scored(spark, sf).select("ticker", "date", "target")
    fitted = toolkit.TargetEncoder(["ticker"]).fit(rows.filter(C("date") < F.lit("2000-01-01").cast("date")))
    return _round(fitted.transform(rows).select("ticker", "date", "ticker_te"), "ticker", "date")


@query(f"with {SCORED}, tr as (select * from sc where date < date '2000-01-01'), k as (select ticker, count(*) / (select count(*) from tr)::double as f from tr group by ticker) select sc.ticker, date, round(coalesce(f, 0), 12) as ticker_freq from sc left join k using (ticker)")
def freq_encode(spark, sf):
    rows = _scored(spark, sf).select("ticker", "date")
    fitted = toolkit.FrequencyEncoder(["ticker"]).fit(rows.filter(C("date") < F.lit("2000-01-01").cast("date")))
    return fitted.transform(rows).select("ticker", "date", F.round("ticker_freq", 12).alias("ticker_freq"))


@query(f"with {SCORED} " + " union all ".join(f"select '{a}' as i, '{c}' as j, round(corr({a}, {c}), 6) + 0.0 as corr from sc" for a, c in (("mom21", "vol20"), ("mom21", "target"), ("vol20", "target"))))
def corr_pairs(spark, sf):
    return _round(toolkit.column_correlations(_scored(spark, sf), ["mom21", "vol20", "target"]), "i", "j")


@query()
def rank_gauss(spark, sf):
    rows = _scored(spark, sf).select("ticker", "date", "mom21")
    return toolkit.RankGauss(["mom21"]).fit(rows).transform(rows)


@query()
def vif(spark, sf):
    panel = features.build_panel(_bars(spark, sf)).cache()
    return spark.createDataFrame(toolkit.vif_scores(panel, features.feature_columns(panel)), "feature string, vif double")


@query()
def mutual_information(spark, sf):
    panel = features.build_panel(_bars(spark, sf)).cache()
    return spark.createDataFrame(toolkit.mutual_information(panel, features.feature_columns(panel), "target"), "feature string, mi double")


_PRUNED = ("mom21", "vol20", "ret1", "pred")


@query(
    f"with {SCORED}, z as (select mom21, vol20, r as ret1, pred from sc), p as ("
    + " union all ".join(f"select '{b}' as feature, corr({a}, {b}) as c from z" for k, a in enumerate(_PRUNED) for b in _PRUNED[k + 1 :])
    + ") select distinct feature from p where abs(c) > 0.95"
)
def correlation_prune(spark, sf):
    return spark.createDataFrame([(c,) for c in toolkit.correlation_prune(_scored(spark, sf), list(_PRUNED))], "feature string")


@query()
def clustered_importance(spark, sf):
    panel = features.build_panel(_bars(spark, sf)).cache()
    weight = dict(toolkit.mutual_information(panel, features.feature_columns(panel), "target"))
    rows = [(r["cluster"], r["feature"], float(r["importance"])) for r in toolkit.clustered_importance(panel, weight)]
    return spark.createDataFrame(rows, "cluster int, feature string, importance double")


@query()
def mean_decrease(spark, sf):
    from pyspark.ml.feature import VectorAssembler

    from barloom.operators.models import ridge

    columns = ["mom21", "vol20", "ret1"]
    rows = _scored(spark, sf).na.drop().select("ticker", "date", "target", *columns).cache()
    ready = VectorAssembler(inputCols=columns, outputCol="features")
    model = ridge(1.0, rows.count(), 1.0).fit(ready.transform(rows).withColumn("weight", F.lit(1.0))).setPredictionCol("pred")
    score = lambda d: d.agg(F.corr("pred", "target").alias("c")).first()["c"] or 0.0
    got = toolkit.mean_decrease(rows, columns, lambda d: model.transform(ready.transform(d)).drop("features"), score)
    return spark.createDataFrame([(r["feature"], r["mean"], r["std"]) for r in got], "feature string, mean double, std double")


@query()
def numeric_pipeline(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows = _scored(spark, sf).select("ticker", "date", "mom21", "vol20")
    _, pipe = toolkit.numeric_pipeline(["mom21", "vol20"], "standard", winsorize=False)
    made = pipe.fit(rows).transform(rows).withColumn("_s", vector_to_array("scaled"))
    return _round(made.select("ticker", "date", F.get("_s", F.lit(0)).alias("mom21"), F.get("_s", F.lit(1)).alias("vol20")), "ticker", "date")


@query(f"with {base()} select ticker, date, 1::bigint as hot from bars")
def one_hot(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows = _scored(spark, sf).select("ticker", "date")
    made = toolkit.one_hot(["ticker"]).fit(rows).transform(rows)
    ones = F.size(F.filter(vector_to_array("ticker_hot"), lambda x: x == 1)).cast("long")
    return made.select("ticker", "date", ones.alias("hot"))


# ----------------------------------------------------------------------------------------------- models and overfitting


def _model_books(spark, sf):
    """Daily means of three signals' signed returns, as stand-ins for models' books."""
    scored = _scored(spark, sf).filter("target is not null")
    signals = {"mom": C("mom21"), "rev": -C("ret1"), "vol": -C("vol20")}
    each = F.array(*(F.struct(F.lit(k).alias("model"), v.alias("s")) for k, v in signals.items()))
    rows = scored.withColumn("x", F.explode(each)).select("date", "x.model", "x.s", "target").na.drop()
    return rows.groupBy("model", "date").agg(F.avg(F.signum("s") * C("target")).alias("net"))


_MODELS = """mb as (select model, date, avg(sign(s) * target) as net from (select 'mom' as model, date, mom21 as s, target from sc union all select 'rev', date, -r, target from sc union all select 'vol', date, -vol20, target from sc) where s is not null and target is not null group by 1, 2),
  bl as (select least((row_number() over (partition by model order by date) - 1) * 6 // count(*) over (partition by model), 5)::int as block, model, net from mb), sb as (select block, model, avg(net) / (stddev_samp(net) + 1e-12) as value from bl group by 1, 2)"""


@query(
    f"""with {SCORED}, {_MODELS}, cm as (select row_number() over (order by a, b, c) - 1 as combo, a, b, c from (select x.k as a, y.k as b, z.k as c from range(6) x(k), range(6) y(k), range(6) z(k) where x.k < y.k and y.k < z.k)),
  m as (select combo, model, avg(value) filter (block in (a, b, c)) as i, avg(value) filter (block not in (a, b, c)) as o from sb, cm group by 1, 2), k as (select combo, model, {rank('o', 'combo')} as rk, row_number() over (partition by combo order by i desc, model) as n from m)
  select combo::int as combo, model as best, round(rk, 9) as oos_rank, (rk < 0.5)::int as loss from k where n = 1"""
)
def pbo(spark, sf):
    made = tuning.overfit_probability(tuning.sharpe_blocks(_model_books(spark, sf), 6))
    return made.withColumn("oos_rank", F.round("oos_rank", 9))


@query()
def reality_check(spark, sf):
    wide = _model_books(spark, sf).groupBy("date").pivot("model", ["mom", "rev", "vol"]).agg(F.first("net"))
    return spark.createDataFrame([(float(tuning.reality_check(wide, "mom", ["rev", "vol"])),)], "p_value double")


@query()
def deflated_sharpe(spark, sf):
    rows = [(t, bt.deflated_sharpe(0.08, 1000, t, 0.0009, -0.3, 5.0)) for t in (2, 10, 100, 500)]
    return spark.createDataFrame(rows, "trials int, probability double")


@query()
def stacked(spark, sf):
    from barloom.operators.models import stack

    oof = _scored(spark, sf).filter("target is not null").select("ticker", "date", "target", "mom21", "vol20", (-C("ret1")).alias("rev1"))
    return stack(oof, ["mom21", "vol20", "rev1"])[0].select("ticker", "date", "stacked")


@query()
def compare_models(spark, sf):
    scored = _scored(spark, sf).withColumn("rev1", -C("ret1")).cache()
    cards = bt.compare_models(scored, scored, ["mom21", "rev1"])
    return spark.createDataFrame([(c["model"], k, float(v)) for c in cards for k, v in c.items() if k != "model"], "model string, metric string, value double")


@query()
def boosted_walk_forward(spark, sf):
    from barloom.operators.models import run_walk_forward

    panel = features.build_panel(_bars(spark, sf)).cache()
    return run_walk_forward(panel, features.feature_columns(panel))[0]



