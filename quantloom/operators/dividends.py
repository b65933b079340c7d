"""Dividend yields at the ex-date, known-time TTM dividends and growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import cols as C
from quantloom.operators import calendar as K

KNOWN_LAG_DAYS = 120
YEAR_DAYS = 365


def dated_dividends(divs: DataFrame, raw: DataFrame, cal: DataFrame) -> DataFrame:
    """Dividends with cum/ex dates and the raw close on the cum date. raw: (code, date, raw_close)."""
    d = K.ex_dates(divs, cal).where("ex_date is not null")
    return d.join(raw.select("code", F.col("date").alias("cum_date"), "raw_close"), ["code", "cum_date"], "left")


def dividend_yields(divs: DataFrame, raw: DataFrame, cal: DataFrame) -> DataFrame:
    """(code, ex_date, cum_date, dps, raw_close, yield, missing): same ex-date summed; rows without a raw close only counted."""
    d = dated_dividends(divs, raw, cal)
    ok = F.coalesce(F.col("raw_close") > 0, F.lit(False))
    g = d.groupBy("code", "ex_date").agg(
        F.min(F.when(ok, F.col("cum_date"))).alias("cum_date"), F.sum(F.when(ok, F.col("dps"))).alias("dps"), F.max(F.when(ok, F.col("raw_close"))).alias("raw_close"),
        F.sum(F.when(ok, F.col("dps") / F.col("raw_close"))).alias("yield"), F.sum((~ok).cast("long")).alias("missing"))
    return g


def known_dividends(divs: DataFrame, prices: DataFrame, cal: DataFrame) -> DataFrame:
    """(code, pos, dps_adj): split-adjusted dividends on the first trading day they are known. prices: (code, date, close, raw_close)."""
    d = dated_dividends(divs, prices, cal).where("raw_close > 0")
    adj = prices.select("code", F.col("date").alias("cum_date"), F.col("close").alias("_adj"))
    d = d.join(adj, ["code", "cum_date"]).where("_adj is not null")
    known = F.coalesce(F.col("pay_date").try_cast("date"), F.date_add("record_date", KNOWN_LAG_DAYS))
    d = d.withColumn("_known", known).withColumn("dps_adj", F.col("dps") * F.col("_adj") / F.col("raw_close"))
    d = K.next_trading_day(d, "_known", cal, strict=False, out="date").where("date is not null")
    return d.join(cal, "date").groupBy("code", "pos").agg(F.sum("dps_adj").alias("dps_adj"))


def dividend_features(prices: DataFrame, divs: DataFrame, cal: DataFrame) -> DataFrame:
    """Grid (code, pos, date, close, ttm, dy_ttm, div_growth). TTM covers (t - 365 days, t]; no dividend is 0, not NULL."""
    g = K.with_date(K.grid(prices, cal, ["close"]), cal)
    k = known_dividends(divs, prices, cal)
    # a dividend known before the first price enters through its own row, which is dropped after the sum
    rows = g.select("code", "pos", "date", "close", F.lit(None).cast("double").alias("dps_adj"), F.lit(True).alias("_grid")).unionByName(
        k.join(cal, "pos").select("code", "pos", "date", F.lit(None).cast("double").alias("close"), "dps_adj", F.lit(False).alias("_grid")))
    w = Window.partitionBy("code").orderBy(F.unix_date("date")).rangeBetween(-(YEAR_DAYS - 1), 0)
    t = rows.withColumn("ttm", F.coalesce(F.sum("dps_adj").over(w), F.lit(0.0))).where("_grid").select("code", "pos", "date", "close", "ttm")
    m = K.day_map(cal).select(F.date_add("day", YEAR_DAYS).alias("date"), F.col("last_pos").alias("_ppos"))
    prior = t.select("code", F.col("pos").alias("_ppos"), F.col("ttm").alias("_prior"))
    t = t.join(m, "date", "left").join(prior, ["code", "_ppos"], "left")
    growth = F.when((F.col("ttm") > 0) & (F.col("_prior") > 0), C.change(F.col("ttm"), F.col("_prior")))
    return t.select("code", "pos", "date", "close", "ttm", C.div("ttm", "close").alias("dy_ttm"), growth.alias("div_growth"))


def upcoming_dividends(divs: DataFrame, today, back: int = 30, ahead: int = 120, n: int = 10) -> DataFrame:
    t = F.lit(today).cast("date")
    d = divs.where(F.col("record_date").between(F.date_sub(t, back), F.date_add(t, ahead)))
    return d.orderBy(F.col("record_date").desc(), F.col("code"), F.col("dps")).limit(n)
