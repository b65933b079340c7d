"""Bars to adjusted prices, returns, price statistics and volatility. Long form, one row per (code, day)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import cols as C

RELIST_GAP_DAYS = 60
DECAY = 60.0  # natural logarithm of the fading within a block of the exponential scan


def dedupe_last(df: DataFrame, keys, seq: str) -> DataFrame:
    """Newest row per key. max_by on the whole row combines on the map side, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(seq).isNotNull(), F.col(seq))).alias("_r")  # a row without seq is the oldest
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def base_price_factor(bars: DataFrame) -> DataFrame:
    """Adds prev close and the day's adjustment factor f = (close - chg) / prev close (1 on gaps > 60 days or bad inputs)."""
    w = Window.partitionBy("code").orderBy(F.col("date").desc())
    base = F.col("close") - F.col("chg")
    raw = F.when((F.col("prev_close") > 0) & (base > 0), C.div(base, "prev_close")).otherwise(1.0)
    gap = F.datediff("date", F.col("prev_date")) > RELIST_GAP_DAYS
    return (bars.withColumn("prev_close", F.lead("close").over(w)).withColumn("prev_date", F.lead("date").over(w))
            .withColumn("factor", F.when(gap | (F.abs(raw - 1) <= 1e-9), 1.0).otherwise(raw)))


def adjust_prices(bars: DataFrame, halt_on_volume: bool = False) -> DataFrame:
    """Split-adjusted OHLCV: raw x product of all later factors; volume divided, rounded half-even.

    The running product walks backwards in time, so it is linear and shares one sort with the previous-close lookup.
    """
    w = Window.partitionBy("code").orderBy(F.col("date").desc())
    b = base_price_factor(bars.where("close > 0"))
    later = F.product("factor").over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("mult", F.coalesce(later, F.lit(1.0)))
    halted = F.coalesce(F.col("open"), F.lit(0.0)) <= 0
    if halt_on_volume:
        halted = halted | (F.coalesce(F.col("volume"), F.lit(0.0)) <= 0)
    keep = [c for c in bars.columns if c not in ("open", "high", "low", "close", "volume", "chg")]
    px = [F.when(~halted, F.col(c) * F.col("mult")).alias(c) for c in ("open", "high", "low")]
    return b.select(*keep, *px, (F.col("close") * F.col("mult")).alias("close"),
                    F.bround(F.col("volume") / F.col("mult"), 0).alias("volume"), "factor")


def base_price_returns(bars: DataFrame) -> DataFrame:
    """ret against the base price, raw factor and a first-day flag, per code's own rows."""
    w = Window.partitionBy("code").orderBy("date")
    prev = F.lag("close").over(w)
    base = F.col("close") - F.col("chg")
    return (bars.withColumn("ret", C.change("close", base))
            .withColumn("factor", F.when(prev > 0, base / prev)).withColumn("first_day", prev.isNull()))


def returns(grid: DataFrame, h: int = 1, price: str = "close", out: str = "ret", keys=("code",)) -> DataFrame:
    """price_t / price_{t-h} - 1 on the market grid; no fill across a missing day."""
    return grid.withColumn(out, C.change(price, C.at(price, -h, C.by_code(*keys))))


def forward_returns(grid: DataFrame, h: int = 1, price: str = "close", out: str = "fwd", keys=("code",)) -> DataFrame:
    return grid.withColumn(out, C.change(C.at(price, h, C.by_code(*keys)), price))


def price_features(grid: DataFrame, month: int = 21, year: int = 252, rel: int = 60, trend: int = 120, vol: int = 60) -> DataFrame:
    """mom_12_1, rev_1m, rel_60, trend_120, low_vol, tail: one window per code over a grid with `ret`."""
    w = C.by_code()
    c = F.col("close")
    return (grid
            .withColumn("mom_12_1", C.change(C.at("close", -month, w), C.at("close", -year, w)))
            .withColumn("rev_1m", C.change(c, C.at("close", -month, w)))
            .withColumn("rel_60", C.change(c, C.at("close", -rel, w)))
            .withColumn("trend_120", C.change(c, C.rolled(F.avg, "close", trend, w, min_obs=trend * 5 // 6)))
            .withColumn("low_vol", -C.rolled(C.std, "ret", vol, w, min_obs=vol * 5 // 6))
            .withColumn("tail", C.rolled(F.min, "ret", vol, w, min_obs=vol * 5 // 6)))


def size(df: DataFrame, cap: str = "cap", out: str = "size") -> DataFrame:
    return df.withColumn(out, F.ln(C.positive(cap)))


def winsorize_expanding(df: DataFrame, value: str, n_sigma: float = 3.0, min_obs: int = 20, out: str = "wins") -> DataFrame:
    """Clip to mean +- n_sigma std of the rows strictly before; untouched while fewer than min_obs values came before."""
    before = C.by_code().rowsBetween(Window.unboundedPreceding, -1)
    v = F.col(value)
    ok = F.count(v).over(before) >= min_obs
    mu, sd = F.avg(v).over(before), F.stddev_samp(v).over(before)
    return df.withColumn(out, F.when(ok & v.isNotNull(), F.least(F.greatest(v, mu - n_sigma * sd), mu + n_sigma * sd)).otherwise(v))


def high_low_flags(grid: DataFrame, lookback: int = 250, min_obs: int = 240) -> DataFrame:
    """new_high / new_low against the extremes of the previous `lookback` market days."""
    w = C.by_code()
    g = grid.withColumn("prior_max", C.rolled(F.max, "high", lookback, w, min_obs, shift=1)).withColumn(
        "prior_min", C.rolled(F.min, "low", lookback, w, min_obs, shift=1))
    return g.withColumn("new_high", F.coalesce(F.col("high") >= F.col("prior_max"), F.lit(False))).withColumn(
        "new_low", F.coalesce(F.col("low") <= F.col("prior_min"), F.lit(False)))


def total_return_close(prices: DataFrame, yields: DataFrame) -> DataFrame:
    """Total-return price: close x running product of (1 + r + y) / (1 + r) over the code's own closes."""
    w = Window.partitionBy("code").orderBy("date")
    d = prices.where("close is not null").join(yields.select("code", F.col("ex_date").alias("date"), F.col("yield").alias("_y")), ["code", "date"], "left")
    d = d.withColumn("_r", F.coalesce(C.change(F.col("close"), F.lag("close").over(w)), F.lit(0.0)))
    step = F.coalesce(C.div(1 + F.col("_r") + F.coalesce("_y", F.lit(0.0)), 1 + F.col("_r")), F.lit(1.0))
    d = d.withColumn("_step", step)
    run = F.product("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("tr_close", F.col("close") * run).drop("_r", "_y", "_step")


# ---- series statistics (monitoring): window None = expanding; `ramp` drops the first rows ----

def _frame(w, n):
    return w.rowsBetween(Window.unboundedPreceding if n is None else -(n - 1), 0)


def _ramped(value, w, ramp):
    return F.when(F.row_number().over(w) > ramp, value) if ramp else value


def series_stats(df: DataFrame, window: int | None = None, ramp: int = 0, price: str = "close", annual: int = C.TRADING_DAYS) -> DataFrame:
    """ret, rolling std of price, volatility %, max drawdown and z-score of price for each series (keys: code, order: pos)."""
    w = C.by_code()
    fr = _frame(w, window)
    x = F.col(price)
    d = df.withColumn("ret", C.change(x, F.lag(x).over(w)))
    d = d.withColumn("_dd", C.change(x, F.max(x).over(fr)))
    d = d.withColumn("std", _ramped(F.stddev_samp(x).over(fr), w, ramp))
    d = d.withColumn("volatility", _ramped(F.stddev_samp("ret").over(fr) * (annual ** 0.5) * 100, w, ramp))
    d = d.withColumn("max_drawdown", _ramped(F.min("_dd").over(fr), w, ramp))
    if window is None:
        whole = Window.partitionBy("code")
        z = C.div(x - F.avg(x).over(whole), F.stddev_samp(x).over(whole))
    else:
        z = C.div(x - F.avg(x).over(fr), F.stddev_samp(x).over(fr))
        z = _ramped(z, w, ramp)
    return d.withColumn("zscore", z).drop("_dd")


def beta(df: DataFrame, bench: DataFrame, window: int | None = None, ramp: int = 0) -> DataFrame:
    """cov(rx, rb) / var(rb) over rows where both returns exist. df: (code, pos, close), bench: (pos, bench_close)."""
    w = C.by_code()
    d = df.join(bench, "pos", "left")
    d = d.withColumn("rx", C.change(F.col("close"), F.lag("close").over(w))).withColumn("rb", C.change(F.col("bench_close"), F.lag("bench_close").over(w)))
    d = d.where("rx is not null and rb is not null")
    fr = _frame(w, window)
    b = F.covar_samp("rx", "rb").over(fr) / F.when(F.var_samp("rb").over(fr) != 0, F.var_samp("rb").over(fr))
    return d.withColumn("beta", _ramped(b, w, ramp))


def ewm_std(df: DataFrame, value: str, beta: float, out: str = "ewm", keys=("code",), order: str = "pos") -> DataFrame:
    """Exponentially weighted standard deviation (weights (1-b)b^i, bias-corrected), NULLs carry the last value.

    Every observation is an affine step m -> r m + (1 - r) x, with r from the number of rows since the last one (a missing
    observation still ages the old weights). The steps are scanned in blocks: -ln r is summed up, and a block holds the rows
    within DECAY of that sum, so weights relative to the block's start neither overflow nor vanish. A block's running sums and
    the whole sums of the block before it give the mean; what lies further back weighs less than e^-DECAY.
    """
    x, has = F.col(value), F.col(value).isNotNull()
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_i", F.row_number().over(w))
    seen = F.last(F.when(has, F.col("_i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_age", F.when(has, F.col("_i") - seen)).withColumn("_old", F.pow(F.lit(beta), F.col("_age")))
    fresh = F.lit(1.0 - beta)
    fade = F.coalesce(F.log(F.col("_old") + fresh) - F.col("_age") * math.log(beta), F.lit(0.0))
    d = d.withColumn("_f", F.sum(fade).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_block", F.floor(F.col("_f") / DECAY))
    d = d.withColumn("_e", F.exp(F.col("_block") * DECAY - F.col("_f"))).withColumn("_w", F.when(has, F.coalesce(fresh / (F.col("_old") + fresh), F.lit(1.0)) / F.col("_e")))
    block = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rangeBetween(-1, -1)

    def total(term, power):
        past = F.coalesce(F.sum(term).over(before), F.lit(0.0)) * math.exp(-DECAY * power)
        return F.pow("_e", F.lit(float(power))) * (F.coalesce(F.sum(term).over(block), F.lit(0.0)) + past)

    d = d.withColumns({"_m": total(F.col("_w") * x, 1), "_q": total(F.col("_w") * x * x, 1), "_s2": total(F.col("_w") * F.col("_w"), 2)})
    # one observation, or one after a gap that leaves nothing of those before it, has no deviation
    v = F.when(F.col("_s2").between(1e-300, 1 - 1e-14), F.sqrt(F.greatest((F.col("_q") - F.col("_m") * F.col("_m")) / (1 - F.col("_s2")), F.lit(0.0))))
    return d.withColumn(out, v).select(*df.columns, out)


def move_threshold(df: DataFrame, k: float = 2.0, floor: float = 0.025, cap: float = 0.15, min_obs: int = 60, beta: float = 0.94) -> DataFrame:
    """ret, threshold from yesterday's EWMA sigma, surge / plunge flags."""
    w = C.by_code()
    d = df.withColumn("ret", C.change(F.col("close"), F.lag("close").over(w)))
    d = ewm_std(d, "ret", beta, "_sig")
    seen = F.count("ret").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("threshold", F.when(seen >= min_obs, C.clip(k * F.lag("_sig").over(w), floor, cap)))
    return d.withColumn("surge", F.coalesce(F.col("ret") > F.col("threshold"), F.lit(False))).withColumn(
        "plunge", F.coalesce(F.col("ret") < -F.col("threshold"), F.lit(False))).drop("_sig")


def realized_vol(series: DataFrame, window: int = 20) -> DataFrame:
    w = C.by_code()
    d = series.withColumn("ret", C.change(F.col("close"), F.lag("close").over(w)))
    return d.withColumn("vol", C.rolled(C.std, "ret", window, w) * (C.TRADING_DAYS ** 0.5))


def equity_and_drawdown(rets: DataFrame, keys=("series",), order: str = "date", ret: str = "ret") -> DataFrame:
    """Running product of 1 + ret and its distance from the running peak (peak starts with the first value)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = rets.where(F.col(ret).isNotNull()).withColumn("_g", 1 + F.col(ret)).withColumn("equity", F.product("_g").over(w)).drop("_g")
    return d.withColumn("drawdown", C.change(F.col("equity"), F.max("equity").over(w)))
