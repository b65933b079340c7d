"""Report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import cols as C
from quantloom.operators import ranks
from quantloom.operators import universe as U


def share_above_ma(grid: DataFrame, membership: DataFrame, window: int = 200, min_names: int = 30) -> DataFrame:
    """Share of members with close above their moving average (90 % of the window observed), NULL on thin days."""
    g = grid.withColumn("_ma", C.rolled(F.avg, "close", window, C.by_code(), window * 9 // 10)).where("_ma is not null")
    g = U.only_members(g, membership)
    up = F.coalesce(F.col("close") > F.col("_ma"), F.lit(False)).cast("double")
    return g.groupBy("date").agg(F.count("*").alias("n"), F.avg(up).alias("_s")).select("date", "n", F.when(F.col("n") >= min_names, F.col("_s")).alias("above"))


def rankings(last: DataFrame, top: int = 30) -> DataFrame:
    """Top codes of the last day by value, volume, up, down, cap and investor net, per market and for all markets together."""
    chg = C.div("close", F.col("close") - F.col("chg")) - 1
    x = last.where("volume > 0").withColumn("up", chg).withColumn("down", -chg)
    x = x.select("code", F.explode(F.array("market", F.lit("ALL"))).alias("market"), "value", "volume", "up", "down", "cap", "frgn", "inst")
    x = x.unpivot(["code", "market"], ["value", "volume", "up", "down", "cap", "frgn", "inst"], "metric", "score").where("score is not null")
    return ranks.top_k(x, ["market", "metric"], [F.col("score").desc(), F.col("code")], top, "rk")


def study_ledger(tests: DataFrame, t_in: float) -> DataFrame:
    """One row per study: best in-sample test as text, pass/fail, whether the hold-out was used."""
    ins = F.col("phase") == "insample"
    size = F.when(ins, F.struct(F.abs(F.coalesce("nw_t", F.lit(0.0))), F.col("feature"), F.col("h")))
    g = tests.groupBy("study").agg(F.max_by(F.struct("feature", "h", "nw_t"), size).alias("_b"), F.bool_or(F.col("phase") == "holdout").alias("holdout_used"),
                                   F.coalesce(F.bool_or(ins & (F.abs("nw_t") >= t_in)), F.lit(False)).alias("_hit"))
    text = F.format_string("best %s h%d t %.2f", F.col("_b.feature"), F.col("_b.h"), F.col("_b.nw_t"))
    return g.select("study", text.alias("metric"), F.when(F.col("_hit"), "pass").otherwise("fail").alias("status"), "holdout_used")


def from_end(df: DataFrame, keys=("code",), order: str = "date", out: str = "back") -> DataFrame:
    """Adds 0, 1, 2 … counted back from each key's last row; later conditional sums on it need no further shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn(out, F.row_number().over(w) - 1)


def nth(value, n: int, back: str = "back"):
    """Value n rows before the last, inside an aggregate over `from_end` rows."""
    return F.max(F.when(F.col(back) == n, C.col(value)))


def mean_last(value, n: int, back: str = "back"):
    return F.avg(F.when(F.col(back) < n, C.col(value)))


def sum_last(value, n: int, back: str = "back"):
    return F.sum(F.when(F.col(back) < n, C.col(value)))


def breadth(bars: DataFrame) -> DataFrame:
    """Per (date): rising and falling names among those traded, rising share."""
    g = bars.where("volume > 0").groupBy("date").agg(F.sum((F.col("chg") > 0).cast("long")).alias("up"), F.sum((F.col("chg") < 0).cast("long")).alias("down"))
    return g.withColumn("ratio", C.div("up", F.col("up") + F.col("down")))


def high_low_counts(flags: DataFrame, cal: DataFrame, days: int = 250) -> DataFrame:
    last = cal.agg(F.max("pos")).scalar()
    return flags.where(F.col("pos") > last - days).groupBy("pos", "market").agg(F.sum(F.col("new_high").cast("long")).alias("hi"), F.sum(F.col("new_low").cast("long")).alias("lo"))


def new_high_low_list(flags: DataFrame, own: DataFrame, cal: DataFrame, year_rows: int = 250) -> DataFrame:
    """Codes at a new high or low on the last day: day change, distance beyond the prior extreme, one-year return, cap.

    flags: high_low_flags on the grid; own: the code's own rows (code, date, close, cap).
    """
    last = cal.agg(F.max("pos")).scalar()
    f = flags.where((F.col("pos") == last) & (F.col("new_high") | F.col("new_low")))
    o = from_end(own.where("close is not null")).groupBy("code").agg(nth("close", 0).alias("close"), nth("close", 1).alias("_p"), nth("close", year_rows).alias("_y"), nth("cap", 0).alias("cap"))
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("new_high"), "hi"), F.when(F.col("new_low"), "lo")))).alias("kind")
    f = f.select("code", kinds, "high", "low", "prior_max", "prior_min").join(o, "code")
    beyond = F.when(F.col("kind") == "hi", C.change(F.col("high"), F.col("prior_max"))).otherwise(C.change(F.col("low"), F.col("prior_min")))
    return f.select("kind", "code", "close", (C.change(F.col("close"), F.col("_p"))).alias("pct"), beyond.alias("beyond"), (C.change(F.col("close"), F.col("_y"))).alias("r1y"), "cap")


# Report windows in trading days.
FUND_WINDOWS = {"1w": 5, "1m": 21, "3m": 63, "1y": 252}


def fund_panels(funds: DataFrame) -> DataFrame:
    """ret against the base price and creation flow per (code, pos); an unusable share ratio gives flow 0."""
    w = Window.partitionBy("code").orderBy("pos")
    prev = F.when(F.lag("pos").over(w) == F.col("pos") - 1, F.lag("fund_shares").over(w))
    base = F.col("close") - F.col("chg")
    d = funds.withColumn("_ps", prev).withColumn("ret", F.col("close") / F.when(base > 0, base) - 1)
    q = C.div("fund_shares", "_ps")
    flow = F.when((q > 0.5) & (q < 2.0), (F.col("fund_shares") - F.col("_ps")) * F.col("nav"))
    return d.withColumn("flow", F.coalesce(flow, F.lit(0.0))).drop("_ps")


def fund_summary(funds: DataFrame, cal: DataFrame) -> DataFrame:
    """Latest row per fund: compounded returns and flows over the windows and year to date, only if listed before the window."""
    from quantloom.functions import rules as R

    last = cal.agg(F.max("pos")).scalar()
    year0 = cal.where(F.year("date") == F.year(cal.agg(F.max("date")).scalar())).agg(F.min("pos")).scalar()
    d = fund_panels(funds)
    gross = 1 + F.coalesce("ret", F.lit(0.0))
    aggs = [F.min(F.when(F.col("ret").isNotNull(), F.col("pos"))).alias("_first"), F.max("pos").alias("_lastpos"), F.avg(F.when(F.col("pos") > last - 20, F.col("value"))).alias("value_20d")]
    aggs += [F.max(F.when(F.col("pos") == last, F.col(c))).alias(c) for c in ("fund_name", "market", "aum")]
    for k, n in FUND_WINDOWS.items():
        inside = F.col("pos") > last - n
        aggs += [F.product(F.when(inside, gross).otherwise(1.0)).alias(f"_g{k}"), F.sum(F.when(inside, F.col("flow")).otherwise(0.0)).alias(f"_f{k}")]
    aggs.append(F.product(F.when(F.col("pos") >= year0, gross).otherwise(1.0)).alias("_gy"))
    g = d.groupBy("code").agg(*aggs).where(F.col("_lastpos") == last)
    cols = []
    for k, n in FUND_WINDOWS.items():
        ok = (F.col("_first") <= last - n) & (last > n)
        cols += [F.when(ok, F.col(f"_g{k}") - 1).alias(f"ret_{k}"), F.when(ok, F.col(f"_f{k}")).alias(f"flow_{k}")]
    listed = F.col("_first") <= F.greatest(year0 - 1, F.lit(1))
    g = g.select("code", F.col("fund_name").alias("name"), R.fund_category("fund_name", "market").alias("category"), "aum", "value_20d", *cols,
                 F.when(listed, F.col("_gy") - 1).alias("ret_ytd"))
    return g.withColumn("flow_1m_pct", F.col("flow_1m") / C.positive(F.col("aum") - F.col("flow_1m")))


def fund_detail(funds: DataFrame, short: int = 63, year: int = 250) -> DataFrame:
    """Per fund on its own rows: premium now, mean absolute premium over 20 rows, tracking difference over two windows
    (not for leveraged funds; at least 3 rows needed)."""
    from quantloom.functions import rules as R

    base = F.col("close") - F.col("chg")
    d = from_end(funds.withColumn("ret", F.col("close") / F.when(base > 0, base) - 1).withColumn("prem", F.when(F.col("nav") > 0, C.change(F.col("close"), F.col("nav")))))
    aggs = [F.count("*").alias("n"), nth("prem", 0).alias("prem_now"), mean_last(F.abs("prem"), 20).alias("prem_20d_abs"), F.max(F.when(F.col("back") == 0, R.fund_category("fund_name", "market"))).alias("category")]
    for k, n in (("3m", short), ("1y", year)):
        aggs += [F.product(F.when(F.col("back") < n, 1 + F.coalesce("ret", F.lit(0.0))).otherwise(1.0)).alias(f"_e{k}"), C.change(nth("idx", 0), nth("idx", n)).alias(f"_i{k}")]
    g = d.groupBy("code").agg(*aggs).where("n >= 3")
    plain = F.col("category") != R.LEVERAGED
    return g.select("code", "n", "category", "prem_now", "prem_20d_abs", *[F.when(plain, F.col(f"_e{k}") - 1 - F.col(f"_i{k}")).alias(f"track_{k}") for k in ("3m", "1y")])


def sector_rotation(prices: DataFrame, cal: DataFrame, weeks: int = 12, step: int = 5, recent: int = 4, min_weight: float = 0.005, other: str = "기타") -> DataFrame:
    """Cap-weighted sector return per period (weights at the period start), sectors under min_weight at the last start dropped.

    prices: (code, market, sector, pos, close, cap).
    """
    last = cal.agg(F.max("pos")).scalar()
    w = Window.partitionBy("code").orderBy("pos")
    d = prices.where(((last - F.col("pos")) % step == 0) & (F.col("pos") >= last - step * weeks))
    d = d.withColumn("_n", F.when(F.lead("pos").over(w) == F.col("pos") + step, F.lead("close").over(w)))
    d = d.where(F.col("pos") < last).withColumn("_r", C.change(F.col("_n"), F.col("close")))
    usable = F.col("_r").isNotNull() & (F.col("cap") > 0)
    g = d.groupBy("market", "sector", "pos").agg((F.sum(F.when(usable, F.col("_r") * F.col("cap"))) / F.sum(F.when(usable, F.col("cap")))).alias("ret"), F.sum("cap").alias("_cap"))
    per = Window.partitionBy("market", "pos")
    g = g.withColumn("_w", C.div("_cap", F.sum("_cap").over(per)))
    sec = Window.partitionBy("market", "sector")
    g = g.withColumn("weight", F.max(F.when(F.col("pos") == last - step, F.col("_w"))).over(sec))
    g = g.withColumn("recent", F.product(F.when(F.col("pos") >= last - step * recent, 1 + F.coalesce("ret", F.lit(0.0))).otherwise(1.0)).over(sec) - 1)
    return g.where((F.col("sector") != other) & (F.col("weight") >= min_weight)).select("market", "sector", (F.col("pos") + step).alias("pos"), "ret", "weight", "recent")


def cap_rank_change(caps: DataFrame, cal: DataFrame, top: int = 50, week: int = 5, month: int = 21) -> DataFrame:
    """Top codes per market with their cap rank now, a week and a month ago. caps: (market, code, pos, cap)."""
    last = cal.agg(F.max("pos")).scalar()
    d = caps.where((F.col("pos") == last) | (F.col("pos") == last - week) | (F.col("pos") == last - month))
    d = ranks.ordinal(d.where("cap is not null").select("market", "code", "pos", "cap"), ["market", "pos"], "cap", "code", "rank")
    pick = lambda n, c: F.max(F.when(F.col("pos") == last - n, F.col(c)))
    g = d.groupBy("market", "code").agg(pick(0, "rank").alias("rank"), pick(week, "rank").alias("rank_w1"), pick(month, "rank").alias("rank_m1"),
                                        pick(0, "cap").alias("cap"), pick(month, "cap").alias("_c"))
    return g.where(F.col("rank") <= top).select("market", "code", "rank", "rank_w1", "rank_m1", "cap", (F.col("cap") / C.positive("_c") - 1).alias("chg_m1"))


def market_map(bars: DataFrame, cal: DataFrame, top: int = 300) -> DataFrame:
    """Largest codes per market on the last day with 1-day, 1-week, 1-month and year-to-date returns and the coverage of the top."""
    day = cal.agg(F.max("date")).scalar()
    snap = bars.where((F.col("date") == day) & (F.col("close") > 0))
    tot = snap.groupBy("market").agg(F.sum("cap").alias("_tot"))
    pick = ranks.top_k(snap, ["market"], [F.col("cap").desc(), F.col("code")], top)
    cover = pick.groupBy("market").agg(F.sum("cap").alias("_top")).join(tot, "market").select("market", C.div("_top", "_tot").alias("coverage"))
    hist = from_end(bars.where("adj_close is not null")).groupBy("code").agg(
        nth("adj_close", 0).alias("_0"), nth("adj_close", 5).alias("_5"), nth("adj_close", 21).alias("_21"),
        F.max_by("adj_close", F.when(F.year("date") < F.year(day), F.col("date"))).alias("_y"), F.min(F.year("date")).alias("_y0"))
    base = F.col("close") - F.col("chg")
    d = pick.join(hist, "code", "left").join(cover, "market")
    prior = F.when(F.col("_y0") < F.year(day), F.col("_y"))
    return d.select("market", "code", "sector", "cap", (F.col("close") / C.positive(base) - 1).alias("r1d"), (C.change(F.col("_0"), F.col("_5"))).alias("r1w"), (C.change(F.col("_0"), F.col("_21"))).alias("r1m"),
                    C.change("_0", prior).alias("rytd"), "coverage")


def change_since(df: DataFrame, days, value: str = "ratio") -> DataFrame:
    """(code, last, chg_<n>): last value minus the last value at or before (last date - n days)."""
    d = df.where(F.col(value).isNotNull()).withColumn("_l", F.max("date").over(Window.partitionBy("code")))
    past = [F.max_by(value, F.when(F.col("date") <= F.date_sub("_l", n), F.col("date"))).alias(f"_p{n}") for n in days]
    has = [F.max(F.when(F.col("date") <= F.date_sub("_l", n), 1)).alias(f"_h{n}") for n in days]
    g = d.groupBy("code").agg(F.max_by(value, "date").alias("last"), *past, *has)
    return g.select("code", "last", *[F.when(F.col(f"_h{n}") == 1, F.round(F.col("last") - F.col(f"_p{n}"), 3)).alias(f"chg_{n}") for n in days])


def short_credit_board(x: DataFrame) -> DataFrame:
    """Per code: short share means, loan level and 20-row change, lending share of listed shares, foreign ratio and changes, 20-row return."""
    d = from_end(x)
    step = lambda c: nth(c, 0) / F.when(nth(c, 20) > 0, nth(c, 20)) - 1
    g = d.groupBy("code").agg(
        mean_last("short_pct", 5).alias("s5"), mean_last("short_pct", 20).alias("s20"), mean_last("short_pct", 60).alias("s60"),
        nth("loan_rate", 0).alias("loan_rate"), nth("loan_amt", 0).alias("loan_amt"), step("loan_amt").alias("loan_chg20"),
        (C.div(nth("lend_qty", 0), C.div(nth("cap", 0), nth("close", 0))) * 100).alias("lend_pct"), step("lend_qty").alias("lend_chg20"), step("close").alias("r20"))
    return g.join(change_since(x, (28, 91, 365)).withColumnRenamed("last", "foreign_ratio"), "code")


def short_share_total(x: DataFrame) -> DataFrame:
    """Per day: short value over traded value, the latter inferred from amount and percent."""
    v = F.when(F.col("short_pct") > 0, F.col("short_amt") * 100 / F.col("short_pct"))
    return x.groupBy("date").agg((F.sum("short_amt") / F.when(F.sum(v) > 0, F.sum(v)) * 100).alias("short_share"))


def loan_total(grid: DataFrame) -> DataFrame:
    """Per position: sum of loans, each code carried forward over missing days."""
    run = C.by_code().rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn("_l", F.last("loan_amt", ignorenulls=True).over(run)).groupBy("pos").agg(F.sum("_l").alias("loans"))


def program_market(x: DataFrame, cal: DataFrame, year: int = 250) -> DataFrame:
    """Per market and day of the last year: net and its running sum; window sums of the last 1/5/20/60 days on every row."""
    last = cal.agg(F.max("pos")).scalar()
    d = x.groupBy("market", "date", "pos").agg(F.sum("prog_net").alias("net"))
    d = d.withColumn("back", last - F.col("pos"))
    whole = Window.partitionBy("market")
    for n in (1, 5, 20, 60):
        d = d.withColumn(f"net_{n}", F.sum(F.when(F.col("back") < n, F.col("net")).otherwise(0.0)).over(whole))
    run = Window.partitionBy("market").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return d.where(F.col("back") < year).withColumn("cum", F.sum("net").over(run)).drop("back")


def program_board(x: DataFrame) -> DataFrame:
    """Per code: net sums, share of the 5-row value, share of cap; codes with fewer than 5 rows drop out."""
    g = from_end(x).groupBy("code").agg(F.count("*").alias("_n"), nth("prog_net", 0).alias("n1"), sum_last("prog_net", 5).alias("n5"), sum_last("prog_net", 20).alias("n20"),
                                        sum_last("value", 5).alias("_v5"), nth("cap", 0).alias("_cap"))
    return g.where("_n >= 5").select("code", "n1", "n5", "n20", (F.col("n5") / C.positive("_v5")).alias("v5"), (F.col("n20") / C.positive("_cap")).alias("c20"))


def price_stats(own: DataFrame) -> DataFrame:
    """Per code on its own rows: returns over 1/21/63/250 rows, 52-week range and position, 60-row volatility (40+ returns)."""
    w = Window.partitionBy("code").orderBy("date")
    d = from_end(own.where("close is not null").withColumn("_r", C.change(F.col("close"), F.lag("close").over(w))))
    hi, lo = F.max(F.when(F.col("back") < 250, F.col("close"))), F.min(F.when(F.col("back") < 250, F.col("close")))
    vol = F.when(F.count(F.when(F.col("back") < 60, F.col("_r"))) >= 40, F.stddev_samp(F.when(F.col("back") < 60, F.col("_r"))) * C.TRADING_DAYS ** 0.5)
    g = d.groupBy("code").agg(F.count("*").alias("_n"), nth("close", 0).alias("close"), *[C.change(nth("close", 0), nth("close", n)).alias(a) for n, a in ((1, "ret_1d"), (21, "ret_1m"), (63, "ret_3m"), (250, "ret_1y"))],
                              hi.alias("hi_52w"), lo.alias("lo_52w"), vol.alias("vol_60")).where("_n >= 2")
    return g.withColumn("pos_52w", F.when(F.col("hi_52w") > F.col("lo_52w"), (F.col("close") - F.col("lo_52w")) / (F.col("hi_52w") - F.col("lo_52w")))).drop("_n")


def screener_price_stats(grid: DataFrame, cal: DataFrame, year: int = 250, min_obs: int = 240) -> DataFrame:
    """Grid version for the whole market: forward-filled prices; one-year figures need min_obs closes in the year. grid: high, low, close."""
    last = cal.agg(F.max("pos")).scalar()
    w = C.by_code()
    g = grid.withColumn("_c", F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", C.change(F.col("close"), F.lag("close").over(w)))
    g = g.withColumn("back", last - F.col("pos"))
    yr = F.col("back") < year
    a = g.groupBy("code").agg(nth("_c", 0).alias("_l"), *[C.change(nth("_c", 0), nth("_c", n)).alias(k) for n, k in ((21, "r1m"), (63, "r3m"), (year, "_r1y"))],
                              F.max(F.when(yr, F.col("high"))).alias("_hi"), F.min(F.when(yr, F.col("low"))).alias("_lo"), F.count(F.when(yr, F.col("close"))).alias("_n"),
                              (F.stddev_samp(F.when(F.col("back") < 60, F.col("_r"))) * C.TRADING_DAYS ** 0.5).alias("vol60"))
    full = F.col("_n") >= min_obs
    return a.select("code", "r1m", "r3m", F.when(full, F.col("_r1y")).alias("r1y"), F.when(full & (F.col("_hi") > F.col("_lo")), (F.col("_l") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).alias("pos52"), "vol60")


def screener(valuation: DataFrame, listing: DataFrame, prices: DataFrame, flow: DataFrame, dividend: DataFrame) -> DataFrame:
    """One row per valued code: valuation, price, flow and dividend columns, all keyed by code."""
    d = valuation.join(listing.select("code", "name", "market", "sector"), "code").join(prices, "code", "left").join(flow, "code", "left").join(dividend, "code", "left")
    return d


def monitor(feats: DataFrame, cal: DataFrame, drop: float = 0.2) -> DataFrame:
    """Members on the last day: one-day return, cap, annualised volatility, high-volatility flag, relative strength, flows."""
    last = cal.agg(F.max("pos")).scalar()
    d = ranks.average_rank(feats.where(F.col("pos") == last), ["pos"], "low_vol", "_pct", pct=True)
    return d.select("code", "close", F.col("ret").alias("ret_1d"), (F.coalesce("cap", F.lit(0.0)) / 1e12).alias("cap_trn"), (-F.col("low_vol") * C.TRADING_DAYS ** 0.5).alias("vol_60"),
                    F.coalesce(F.col("_pct") <= drop, F.lit(False)).alias("high_vol"), "rel_60", "flow_frgn", "flow_inst")


def latest_n(df: DataFrame, keys, order, n: int, fields, out: str = "rows") -> DataFrame:
    """Newest n rows per key as one array, newest first. Only n rows per key and task reach the shuffle."""
    d = ranks.top_k(df, list(keys), list(order), n, "_rn")
    return d.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", F.struct(*fields).alias("r")))), lambda s: s["r"]).alias(out))


def headline_rows(articles: DataFrame, titles: DataFrame | None = None, keys=()) -> DataFrame:
    """Adds the auto flag and tone (-1, 0, 1; 0 for automatic headlines). Articles hold their title, or the `keys` of a row of `titles`, which is judged once."""
    from quantloom.functions import rules as R
    from quantloom.operators import news as N

    if titles is None:
        d = articles.withColumn("auto", R.is_market_auto("title")).withColumn("s", R.lexicon_score("title"))
    else:
        d = articles.join(N.judged_titles(titles, keys).drop("t"), list(keys))
    tone = F.when(F.col("auto"), 0).otherwise(F.signum(F.col("s.pos") - F.col("s.neg"))).cast("int")
    return d.withColumn("tone", tone).drop("s")


def filing_board(filings: DataFrame, n: int = 15) -> DataFrame:
    """(code, insider, rows): newest filings per code; insider ownership reports are only counted."""
    from quantloom.functions import rules as R

    ins = F.col("title").contains(R.INSIDER_TITLE)
    count = filings.groupBy("code").agg(F.sum(ins.cast("long")).alias("insider"))
    rest = filings.where(~ins).withColumn("cat", R.classify_filing("title"))
    return count.join(latest_n(rest, ["code"], [F.col("rcept_dt").desc(), F.col("rcept_no").desc()], n, ["rcept_dt", "title", "cat", "rcept_no"]), "code", "left")


def ohlcv_rows(bars: DataFrame) -> DataFrame:
    """Halted days (open missing or 0) show the close as open, high and low."""
    ok = F.coalesce(F.col("open") > 0, F.lit(False))
    return bars.where("close > 0").select("code", "date", *[F.when(ok, F.col(c)).otherwise(F.col("close")).alias(c) for c in ("open", "high", "low")], "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def index_cards(series: DataFrame, n: int = 120) -> DataFrame:
    """Per series: last, change, percent change, the last n points oldest first; series with one value drop out."""
    d = from_end(series.where("close is not null"), ("name",)).where(F.col("back") < n)
    g = d.groupBy("name").agg(F.max("date").alias("asof"), nth("close", 0).alias("last"), nth("close", 1).alias("_p"),
                              F.transform(F.sort_array(F.collect_list(F.struct("date", F.round("close", 4).alias("v")))), lambda s: s["v"]).alias("spark"))
    return g.where("_p is not null").select("name", "asof", "last", (F.col("last") - F.col("_p")).alias("chg"), (C.change(F.col("last"), F.col("_p"))).alias("pct"), "spark")


def stock_series(x: DataFrame, n: int = 250) -> DataFrame:
    """Per code: last n rows of short %, loan rate, lending % of shares and foreign ratio, with 28/91/365-day ratio changes."""
    sh = F.col("cap") / C.positive("close")
    d = x.withColumn("lend_pct", F.round(C.div("lend_qty", sh) * 100, 3))
    rows = latest_n(d, ["code"], [F.col("date").desc()], n, ["date", "short_pct", "loan_rate", "lend_pct", "ratio"])
    return rows.join(change_since(x, (28, 91, 365)), "code")


def market_events(today, days: int, open_days: DataFrame, divs: DataFrame) -> DataFrame:
    """(date, kind, title, code): closures, expiries, index changes, report deadlines and dividend record dates of the next days."""
    from quantloom.operators import calendar as K

    t = F.lit(today).cast("date")
    end = F.date_add(t, days)
    one = open_days.sparkSession.range(1)
    closed = open_days.where(~F.col("is_open") & (F.weekday("date") < 5)).select("date", F.lit("휴장").alias("kind"), F.lit("증시 휴장").alias("title"), F.lit(None).cast("string").alias("code"))
    months = one.select(F.explode(F.sequence(F.trunc(t, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))).alias("month"))
    ex = K.option_expiry(months, open_days)
    exp = ex.select(F.col("expiry").alias("date"), F.lit("만기").alias("kind"), F.when(F.col("quarterly"), "선물·옵션 동시 만기").otherwise("옵션 만기").alias("title"), F.lit(None).cast("string").alias("code"))
    chg = K.roll_to_open(ex.where(F.month("month").isin(6, 12)).select(F.date_add("expiry", 1).alias("_n")), "_n", open_days, forward=True, out="date")
    chg = chg.select("date", F.lit("지수").alias("kind"), F.lit("코스피200 정기변경 반영").alias("title"), F.lit(None).cast("string").alias("code"))
    marks = [(3, 31, "사업보고서 제출 마감 (12월 결산)"), (5, 15, "1분기 보고서 제출 마감"), (8, 14, "반기 보고서 제출 마감"), (11, 14, "3분기 보고서 제출 마감")]
    years = one.select(F.explode(F.sequence(F.year(t), F.year(end))).alias("y"))
    due = years.select(F.explode(F.array(*[F.struct(F.make_date(F.col("y"), F.lit(m), F.lit(d)).alias("_d"), F.lit(s).alias("title")) for m, d, s in marks])).alias("_m")).select("_m.*")
    due = K.roll_to_open(due, "_d", open_days, forward=True, out="date").select("date", F.lit("공시").alias("kind"), "title", F.lit(None).cast("string").alias("code"))
    rec = divs.select(F.col("record_date").alias("date"), F.lit("배당").alias("kind"), F.concat("code", F.lit(" "), "kind", F.lit(" 배당 기준일")).alias("title"), "code")
    every = closed.unionByName(exp).unionByName(chg).unionByName(due).unionByName(rec)
    return every.where(F.col("date").between(t, end)).orderBy("date", "kind", "title")


def member_corps(members: DataFrame, master: DataFrame, filings: DataFrame) -> DataFrame:
    """(code, corp_code) from the master list, else from filings."""
    m = master.select("code", F.col("corp_code").alias("_m")).dropDuplicates(["code"])
    f = filings.groupBy("code").agg(F.max("corp_code").alias("_f"))
    return members.select("code").distinct().join(m, "code", "left").join(f, "code", "left").select("code", F.coalesce("_m", "_f").alias("corp_code")).where("corp_code is not null")


def missing_companies(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return wanted.select("corp_code").distinct().join(stored.select("corp_code"), "corp_code", "left_anti")


def collection_targets(snapshot: DataFrame, corps: DataFrame) -> DataFrame:
    """Latest common shares of all markets that have a corporation id."""
    return snapshot.where(U.is_common_stock("code", "name")).join(corps.select("code", "corp_code"), "code").select("corp_code", "code").distinct()


def studies_ledger(studies: DataFrame, measures: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per registered study, also of those without results: hypothesis, best item by its main metric, pass when any item passed, hold-out used.

    studies: (study, hypothesis, main, holdout), the last two naming metrics of `measures`; the hold-out counts as used once its metric has a value.
    """
    d = measures.join(studies, "study")
    main = F.when((F.col("metric") == F.col("main")) & F.col("value").isNotNull(), F.struct("value", "item"))
    g = d.groupBy("study").agg(F.max(main).alias("_b"), F.bool_or((F.col("metric") == F.col("holdout")) & F.col("value").isNotNull()).alias("_h"))
    p = verdicts.groupBy("study").agg(F.bool_or("passed").alias("_p"))
    text = F.when(F.col("_b").isNull(), "no result").otherwise(F.format_string("best %s %s %.2f", F.col("_b.item"), F.col("main"), F.col("_b.value")))
    return (studies.join(g, "study", "left").join(p, "study", "left")
            .select("study", "hypothesis", text.alias("metric"), F.when(F.coalesce("_p", F.lit(False)), "pass").otherwise("fail").alias("status"), F.coalesce("_h", F.lit(False)).alias("holdout_used")))


PROGRAM_WINDOWS = (1, 5, 20, 60)


def _program_days(x: DataFrame, parts) -> DataFrame:
    return from_end(x.groupBy("market", "date").agg(*[F.sum(c).alias(c) for c in parts]), ("market",))


def program_sums(x: DataFrame, parts=("arb_net", "nonarb_net", "net")) -> DataFrame:
    """Per market: newest day and the sums of each part over its last 1, 5, 20 and 60 days with rows."""
    return _program_days(x, parts).groupBy("market").agg(F.max("date").alias("date"), *[sum_last(c, n).alias(f"{c}_{n}") for c in parts for n in PROGRAM_WINDOWS])


def program_cumulative(x: DataFrame, parts=("arb_net", "nonarb_net"), days: int = 250) -> DataFrame:
    """Per market and day of its last `days` days: running sum of each part since the first of them."""
    run = Window.partitionBy("market").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return _program_days(x, parts).where(F.col("back") < days).select("market", "date", *[F.sum(c).over(run).alias(f"cum_{c}") for c in parts])


def program_members(x: DataFrame, closes: DataFrame, members: DataFrame, listing: DataFrame) -> DataFrame:
    """`program_board` of current members with name, sector and the return over 20 closes (more than 21 closes needed)."""
    c = from_end(closes.where("close is not null")).groupBy("code").agg(F.count("*").alias("_m"), nth("close", 0).alias("_c0"), nth("close", 20).alias("_c20"))
    r = c.where("_m > 21").select("code", C.change(F.col("_c0"), F.col("_c20")).alias("r20"))
    b = program_board(x).join(members.select("code").distinct(), "code", "left_semi")
    return b.join(listing.select("code", "name", "sector"), "code", "left").join(r, "code", "left")
