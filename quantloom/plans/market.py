"""Queries: calendar, prices, universe, windows over bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import cols as C
from quantloom.operators import calendar as K
from quantloom.operators import prices as P
from quantloom.operators import ranks
from quantloom.operators import universe as U
from quantloom.plans.registry import query
from quantloom.plans.views import r6


def out(df, *keys, **rounded):
    """keys unchanged, keyword columns rounded to the given digits."""
    return df.select(*keys, *[r6(c, d).alias(c) for c, d in rounded.items()])


@query("s03_trading_calendar", """SELECT date, coalesce(bool_or(close <> 0), false) AS is_open
FROM (SELECT CAST(ts AS DATE) AS date, CASE WHEN isodow(ts) > 5 THEN NULL WHEN isodow(ts) = 3 THEN 0 ELSE value END AS close FROM events) GROUP BY date""")
def _(v):
    wd = F.weekday("ts")
    snap = v.table("events").select(F.col("ts").cast("date").alias("date"), F.when(wd > 4, F.lit(None)).when(wd == 2, 0.0).otherwise(F.col("value")).alias("close"))
    return K.trading_calendar(snap)


@query("s04_candidate_days", """SELECT CAST(d AS DATE) AS date FROM (SELECT min(o_orderdate)::DATE a, max(o_orderdate)::DATE b FROM orders) t, generate_series(t.a, t.b, interval 1 day) s(d)
WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT DISTINCT o_orderdate::DATE FROM orders WHERE day(o_orderdate) = 1)""")
def _(v):
    o = v.table("orders").select(F.col("o_orderdate").cast("date").alias("date"))
    bounds = o.agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return K.candidate_days(bounds, o.where(F.dayofmonth("date") == 1).distinct())


@query("p10_drop_holiday_rows", "SELECT date, pos FROM cal")
def _(v):
    return K.calendar_of(v.bars)


@query("p12_every_kth_keep_last", "SELECT date, pos FROM cal WHERE ((SELECT max(pos) FROM cal) - pos) % 5 = 0")
def _(v):
    return K.every_kth_keep_last(v.cal, 5)


@query("p13_quarter_labels", """SELECT stock_code, year*4+q AS period, last_day(make_date(year,q*3,1))::DATE AS qend, (year%100)::VARCHAR || '.' || q || 'Q' AS label
FROM (SELECT DISTINCT stock_code, year, q FROM fin)""")
def _(v):
    d = v.fin.select("stock_code", C.period("year", "q").alias("period")).distinct()
    return d.select("stock_code", "period", C.quarter_end("period").alias("qend"),
                    F.regexp_replace(C.quarter_label("period"), "^0", "").alias("label"))


@query("p14_month_starts", "SELECT DISTINCT CAST(date_trunc('month', d) AS DATE) AS date FROM (SELECT min(date) a, max(date) b FROM cal) t, generate_series(t.a, t.b, interval 1 day) s(d) WHERE day(d)=1")
def _(v):
    return K.month_starts(v.cal.agg(F.min("date").alias("start"), F.max("date").alias("end")))


@query("j03_next_trading_day", """, d AS (SELECT rcept_no, rcept_dt FROM filings)
SELECT rcept_no, rcept_dt, (SELECT min(date) FROM cal WHERE date >= rcept_dt) AS on_or_after, (SELECT min(date) FROM cal WHERE date > rcept_dt) AS after FROM d""")
def _(v):
    f = v.filings.select("rcept_no", "rcept_dt")
    f = K.next_trading_day(f, "rcept_dt", v.cal, strict=False, out="on_or_after")
    return K.next_trading_day(f, "rcept_dt", v.cal, strict=True, out="after")


EX_SQL = """, ex AS (SELECT d.*, c1.date AS cum_date, c2.date AS ex_date FROM (SELECT *, (SELECT max(pos) FROM cal WHERE date <= record_date) - 2 AS k FROM divs) d
  LEFT JOIN cal c1 ON c1.pos = k AND k+1 <= (SELECT max(pos) FROM cal) LEFT JOIN cal c2 ON c2.pos = k+1 AND k >= 1)"""


@query("j04_ex_date", EX_SQL + "SELECT code, record_date, cum_date, ex_date FROM ex")
def _(v):
    return K.ex_dates(v.divs, v.cal).select("code", "record_date", "cum_date", "ex_date")


ADJ_SQL = """, f0 AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) AS pc, lag(date) OVER (PARTITION BY code ORDER BY date) AS pd FROM bars WHERE close > 0),
f1 AS (SELECT *, CASE WHEN pc > 0 AND close-chg > 0 THEN (close-chg)/pc ELSE 1.0 END AS raw FROM f0),
f2 AS (SELECT *, CASE WHEN abs(raw-1) <= 1e-9 OR date-pd > 60 THEN 1.0 ELSE raw END AS factor FROM f1),
f3 AS (SELECT *, coalesce(product(factor) OVER (PARTITION BY code ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS mult FROM f2),
adj AS MATERIALIZED (SELECT date, code, market, sector, name, CASE WHEN open > 0 THEN open*mult END AS open, CASE WHEN open > 0 THEN high*mult END AS high,
  CASE WHEN open > 0 THEN low*mult END AS low, close*mult AS close, round_even(volume/mult, 0) AS volume, factor, close AS raw_close, value, cap, shares FROM f3),
adjgrid AS MATERIALIZED (SELECT g.date, g.pos, g.code, a.open, a.high, a.low, a.close, a.volume, a.factor, a.cap, a.value FROM grid g LEFT JOIN adj a ON a.code=g.code AND a.date=g.date)
"""


@query("w01_adjust_prices", ADJ_SQL + "SELECT date, code, round(open,8) AS open, round(high,8) AS high, round(low,8) AS low, round(close,8) AS close, volume, round(factor,6) AS factor FROM adj")
def _(v):
    return out(P.adjust_prices(v.bars), "date", "code", "volume", open=8, high=8, low=8, close=8, factor=6)


@query("w02_daily_forward_returns", """SELECT date, code, round(close/lag(close) OVER w - 1, 6)+0.0 AS ret, round(lead(close,5) OVER w / close - 1, 6)+0.0 AS fwd FROM grid WINDOW w AS (PARTITION BY code ORDER BY pos)""")
def _(v):
    g = K.grid(v.bars, v.cal, ["close"])
    g = P.forward_returns(P.returns(g), 5)
    return out(K.with_date(g, v.cal), "date", "code", ret=6, fwd=6)


PF_SQL = """, pr AS (SELECT *, close/lag(close) OVER (PARTITION BY code ORDER BY pos) - 1 AS ret FROM grid),
pf AS MATERIALIZED (SELECT date, pos, code, close, ret,
  lag(close,21) OVER w / lag(close,252) OVER w - 1 AS mom_12_1, close/lag(close,21) OVER w - 1 AS rev_1m, close/lag(close,60) OVER w - 1 AS rel_60,
  close/CASE WHEN count(close) OVER w120 >= 100 THEN avg(close) OVER w120 END - 1 AS trend_120,
  -CASE WHEN count(ret) OVER w60 >= 50 THEN stddev_samp(ret) OVER w60 END AS low_vol, CASE WHEN count(ret) OVER w60 >= 50 THEN min(ret) OVER w60 END AS tail
  FROM pr WINDOW w AS (PARTITION BY code ORDER BY pos), w120 AS (PARTITION BY code ORDER BY pos ROWS 119 PRECEDING), w60 AS (PARTITION BY code ORDER BY pos ROWS 59 PRECEDING))
"""
FEATS = ["mom_12_1", "rev_1m", "rel_60", "trend_120", "low_vol", "tail"]


def feature_grid(v, values=("close",)):
    return P.price_features(P.returns(K.grid(v.bars, v.cal, list(values))))


@query("w03_price_features", PF_SQL + "SELECT date, code, " + ", ".join(f"round({f},6)+0.0 AS {f}" for f in FEATS) + " FROM pf")
def _(v):
    return out(K.with_date(feature_grid(v), v.cal), "date", "code", **{f: 6 for f in FEATS})


@query("w04_size", "SELECT date, code, round(ln(CASE WHEN cap>0 THEN cap END),6) AS size FROM bars")
def _(v):
    return out(P.size(v.bars), "date", "code", size=6)


FLOWN_SQL = """, fg2 AS (SELECT g.date, g.pos, g.code, g.who0 AS who, g.value, f.net FROM (SELECT date,pos,code,value, unnest(['frgn','inst']) AS who0 FROM grid) g LEFT JOIN flows f ON f.code=g.code AND f.date=g.date AND f.who=g.who0),
fn AS (SELECT *, lag(net) OVER w / CASE WHEN count(value) OVER m >= 10 THEN CASE WHEN quantile_cont(value,0.5) OVER m > 0 THEN quantile_cont(value,0.5) OVER m END END AS norm
  FROM fg2 WINDOW w AS (PARTITION BY code, who ORDER BY pos), m AS (PARTITION BY code, who ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
fs AS (SELECT date, pos, code, who, norm, CASE WHEN count(norm) OVER w >= 10 THEN sum(norm) OVER w END AS flow_20 FROM fn WINDOW w AS (PARTITION BY code, who ORDER BY pos ROWS 19 PRECEDING))
"""


@query("w05_normalized_flow", FLOWN_SQL + "SELECT date, code, who, round(norm,6)+0.0 AS norm, round(flow_20,6)+0.0 AS flow_20 FROM fs")
def _(v):
    from quantloom.operators import flows as FL

    f = FL.flow_features(FL.flow_grid(v.bars, v.flows, v.cal))
    f = FL.long_flows(f)
    return out(K.with_date(f, v.cal), "date", "code", "who", norm=6, flow_20=6)


DV_SQL = """, dvp AS (SELECT date, pos, code, close, CASE WHEN count(tv) OVER w >= 10 THEN quantile_cont(tv, 0.5) OVER w END AS dv FROM (SELECT *, close*volume AS tv FROM grid)
  WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
dvr AS (SELECT *, rank() OVER (PARTITION BY pos ORDER BY dv) + (count(*) OVER (PARTITION BY pos, dv) - 1)/2.0 AS rk, count(*) OVER (PARTITION BY pos) AS nn FROM dvp WHERE dv IS NOT NULL),
dvk AS (SELECT *, rk/nn > 0.2::DOUBLE AS keep FROM dvr),
uni AS MATERIALIZED (SELECT g.date, g.pos, g.code, g.close, g.dv, coalesce(CASE WHEN k.nk < 30 THEN true ELSE k.keep END, false) AS in_universe
  FROM dvp g LEFT JOIN (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY pos) AS nk FROM dvk) k USING (pos, code))
"""


@query("w06_dollar_volume", DV_SQL + "SELECT date, code, round(dv,6) AS dv FROM dvp")
def _(v):
    return out(K.with_date(U.dollar_volume(K.grid(v.bars, v.cal, ["close", "volume"])), v.cal), "date", "code", dv=6)


def universe_grid(v, values=("close", "volume")):
    g = U.dollar_volume(K.grid(v.bars, v.cal, list(values)))
    return U.restrict_universe(g)


@query("w07_restrict_universe", DV_SQL + "SELECT date, code, in_universe FROM uni")
def _(v):
    return K.with_date(universe_grid(v), v.cal).select("date", "code", "in_universe")


@query("w08_attach_labels", DV_SQL + """, lb AS (SELECT date, pos, code, CASE WHEN in_universe THEN lead(close,5) OVER w/close-1 END AS fwd FROM uni WINDOW w AS (PARTITION BY code ORDER BY pos))
SELECT date, code, round(CASE WHEN fwd IS NOT NULL THEN (rank() OVER (PARTITION BY pos, fwd IS NULL ORDER BY fwd) + (count(*) OVER (PARTITION BY pos, fwd) - 1)/2.0)/count(fwd) OVER (PARTITION BY pos) END, 6) AS label FROM lb""")
def _(v):
    return out(K.with_date(U.attach_labels(universe_grid(v), 5), v.cal), "date", "code", label=6)


@query("p11_eligible", DV_SQL + """SELECT date, code, in_universe AND count(close) OVER (PARTITION BY code ORDER BY pos ROWS UNBOUNDED PRECEDING) >= 100 AS ok FROM uni""")
def _(v):
    return K.with_date(U.eligible(universe_grid(v), min_days=100), v.cal).select("date", "code", "ok")


@query("p01_is_common_stock", "SELECT code, name, right(code,1)='0' AND length(code)=6 AS common FROM listing")
def _(v):
    return v.listing.select("code", "name", U.is_common_stock("code", "name").alias("common"))


def universe_sql(top: str, buffer: str, shares: str = "true") -> str:
    return f""", ms AS (SELECT snap_date, (SELECT max(date) FROM cal WHERE date < snap_date) AS date FROM
  (SELECT DISTINCT CAST(date_trunc('month', d) AS DATE) AS snap_date FROM (SELECT min(date) a, max(date) b FROM cal) t, generate_series(t.a, t.b, interval 1 day) s(d) WHERE day(d)=1)),
mr AS (SELECT ms.snap_date, b.code, row_number() OVER (PARTITION BY ms.snap_date ORDER BY b.cap DESC, b.code) AS rk FROM bars b JOIN ms USING (date) WHERE b.cap > 0 AND {shares}),
ml AS MATERIALIZED (SELECT snap_date, list(code ORDER BY rk) AS codes, row_number() OVER (ORDER BY snap_date) AS i FROM mr WHERE rk <= {buffer} GROUP BY snap_date),
fold(i, chosen) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL
  SELECT ml.i, list_slice(list_concat(list_filter(codes, lambda c: list_contains(chosen, c))[1:{top}], list_filter(codes, lambda c: NOT list_contains(chosen, c))), 1, {top})
  FROM fold JOIN ml ON ml.i = fold.i + 1),
members AS MATERIALIZED (SELECT ml.snap_date, unnest(chosen) AS code FROM fold JOIN ml USING (i)),
dsnap AS (SELECT date, (SELECT max(snap_date) FROM ml WHERE snap_date <= date) AS snap_date FROM cal)
"""


UNI_SQL = universe_sql("40", "50")


def membership(v, top=40, buffer=50):
    snaps = K.month_starts(v.cal.agg(F.min("date").alias("start"), F.max("date").alias("end"))).withColumnRenamed("date", "snap_date")
    return U.buffered_universe(U.caps_before(v.bars.select("date", "code", "cap"), snaps, v.cal), top, buffer)


@query("q01_common_universe", universe_sql("4", "5", "right(b.code,1)='0' AND length(b.code)=6") + "SELECT snap_date, code FROM members")
def _(v):
    snaps = K.month_starts(v.cal.agg(F.min("date").alias("start"), F.max("date").alias("end"))).withColumnRenamed("date", "snap_date")
    return U.common_universe(U.caps_before(v.bars.select("date", "code", "name", "cap"), snaps, v.cal), 4, 5)


@query("q01_buffered_universe", UNI_SQL + "SELECT snap_date, code FROM members")
def _(v):
    return membership(v)


@query("j01_members_asof", UNI_SQL + "SELECT d.date, m.code FROM dsnap d JOIN members m USING (snap_date)")
def _(v):
    return U.members_asof(v.cal, membership(v))


@query("j01_membership_mask", UNI_SQL + "SELECT b.date, b.code, m.code IS NOT NULL AS member FROM bars b LEFT JOIN dsnap d USING (date) LEFT JOIN members m ON m.snap_date=d.snap_date AND m.code=b.code")
def _(v):
    return U.flag_members(v.bars.select("date", "code"), membership(v))


@query("j02_cap_asof", "SELECT code, round(cap,0) AS cap FROM bars WHERE date = (SELECT max(date) FROM bars WHERE date <= DATE '1999-06-30')")
def _(v):
    b = v.bars.where(F.col("date") <= F.lit("1999-06-30").cast("date"))
    return out(b.where(F.col("date") == v.cal.where(F.col("date") <= F.lit("1999-06-30").cast("date")).agg(F.max("date")).scalar()), "code", cap=0)


@query("j06_panel_align", """SELECT g.date, g.code, round(g.close,4) AS close, g.volume, round(g.cap,0) AS cap, f.net FROM grid g LEFT JOIN (SELECT date, code, round(sum(net),2) AS net FROM flows GROUP BY ALL) f ON f.date=g.date AND f.code=g.code""")
def _(v):
    f = v.flows.groupBy("date", "code").agg(F.round(F.sum("net"), 2).alias("net"))
    b = v.bars.select("date", "code", "close", "volume", "cap").join(f, ["date", "code"], "left")
    return out(K.with_date(K.grid(b, v.cal, ["close", "volume", "cap", "net"]), v.cal), "date", "code", "volume", "net", close=4, cap=0)


@query("j17_backfill_codes", UNI_SQL + "SELECT DISTINCT code FROM members WHERE snap_date >= DATE '1999-01-15' - INTERVAL 1 MONTH")
def _(v):
    return membership(v).where(F.col("snap_date") >= F.add_months(F.lit("1999-01-15").cast("date"), -1)).select("code").distinct()


@query("u01_union_markets", "SELECT date, code, market, round(close,4) AS close FROM bars WHERE market IN ('ASIA','EUROPE')")
def _(v):
    a, b = v.bars.where("market = 'ASIA'"), v.bars.where("market = 'EUROPE'")
    return out(a.unionByName(b, allowMissingColumns=True), "date", "code", "market", close=4)


@query("u02_transferred_codes", "SELECT lpad(CAST(l_suppkey AS VARCHAR),6,'0') AS code, count(DISTINCT l_linestatus) AS markets FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_linestatus) > 1")
def _(v):
    t = v.table("lineitem").select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("code"), F.col("l_linestatus").alias("market"))
    return t.groupBy("code").agg(F.countDistinct("market").alias("markets")).where("markets > 1")


@query("u03_all_current_members", UNI_SQL + "SELECT code, max(snap_date) = (SELECT max(snap_date) FROM members) AS is_current FROM members GROUP BY code")
def _(v):
    m = membership(v)
    return m.groupBy("code").agg(F.max("snap_date").alias("last")).select("code", (F.col("last") == m.agg(F.max("snap_date")).scalar()).alias("is_current"))


@query("w15_high_low_flags", """, hl AS (SELECT date, pos, code, high, low, CASE WHEN count(high) OVER w >= 40 THEN max(high) OVER w END AS prior_max, CASE WHEN count(low) OVER w >= 40 THEN min(low) OVER w END AS prior_min
 FROM grid WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING))
SELECT date, code, round(prior_max,4) AS prior_max, round(prior_min,4) AS prior_min, coalesce(high >= prior_max,false) AS new_high, coalesce(low <= prior_min,false) AS new_low FROM hl""")
def _(v):
    g = P.high_low_flags(K.grid(v.bars, v.cal, ["high", "low"]), 52, 40)
    return out(K.with_date(g, v.cal), "date", "code", "new_high", "new_low", prior_max=4, prior_min=4)


@query("w17_realized_vol", """, r AS (SELECT code, pos, close/lag(close) OVER (PARTITION BY code ORDER BY pos)-1 AS ret FROM grid)
SELECT code, pos, round(CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END*sqrt(252),6) AS vol FROM r WINDOW w AS (PARTITION BY code ORDER BY pos ROWS 19 PRECEDING)""")
def _(v):
    return out(P.realized_vol(K.grid(v.bars, v.cal, ["close"])), "code", "pos", vol=6)


def _series_sql(frame):
    z = ("(close-avg(close) OVER (PARTITION BY code))/stddev_samp(close) OVER (PARTITION BY code)" if frame == "UNBOUNDED PRECEDING"
         else "(close-avg(close) OVER w)/stddev_samp(close) OVER w")
    return f""", b1 AS (SELECT code, date, close, close/lag(close) OVER (PARTITION BY code ORDER BY date)-1 AS ret, row_number() OVER (PARTITION BY code ORDER BY date) AS pos FROM bars),
b2 AS (SELECT *, close/max(close) OVER w - 1 AS dd FROM b1 WINDOW w AS (PARTITION BY code ORDER BY pos ROWS {frame}))
SELECT code, date, round(stddev_samp(close) OVER w,4) AS std, round(stddev_samp(ret) OVER w*sqrt(252)*100,4) AS volatility, round(min(dd) OVER w,6)+0.0 AS max_drawdown,
 round({z},6)+0.0 AS zscore FROM b2 WINDOW w AS (PARTITION BY code ORDER BY pos ROWS {frame})"""


def _series(v, window):
    from pyspark.sql import Window

    b = v.bars.select("code", "date", "close").withColumn("pos", F.row_number().over(Window.partitionBy("code").orderBy("date")))
    return out(P.series_stats(b, window), "code", "date", std=4, volatility=4, max_drawdown=6, zscore=6)


@query("w18_series_stats_rolling", _series_sql("25 PRECEDING"))
def _(v):
    return _series(v, 26)


@query("w18_series_stats_expanding", _series_sql("UNBOUNDED PRECEDING"))
def _(v):
    return _series(v, None)


@query("w18_beta", """, mk AS (SELECT pos, sum(close*volume)/sum(volume) AS bench FROM grid WHERE volume>0 GROUP BY pos),
rb AS (SELECT code, pos, close/lag(close) OVER w - 1 AS rx, bench/lag(bench) OVER w - 1 AS rb FROM grid LEFT JOIN mk USING (pos) WINDOW w AS (PARTITION BY code ORDER BY pos))
SELECT code, pos, round(covar_samp(rx,rb) OVER w/CASE WHEN var_samp(rb) OVER w<>0 THEN var_samp(rb) OVER w END,5)+0.0 AS beta FROM rb WHERE rx IS NOT NULL AND rb IS NOT NULL WINDOW w AS (PARTITION BY code ORDER BY pos ROWS 51 PRECEDING)""")
def _(v):
    g = K.grid(v.bars, v.cal, ["close", "volume"])
    bench = g.where("volume > 0").groupBy("pos").agg((F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("bench_close"))
    return out(P.beta(g, bench, 52), "code", "pos", beta=5)


EWM_SQL = """, e0 AS (SELECT code, pos, close/lag(close) OVER (PARTITION BY code ORDER BY pos)-1 AS ret FROM grid),
el AS (SELECT code, list(ret ORDER BY pos) AS xs, min(pos) AS p0 FROM e0 GROUP BY code),
ef(code, p0, i, xs, m, q, s2, gap) AS (SELECT code, p0, 0, xs, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 0 FROM el UNION ALL
 SELECT code, p0, i+1, xs, CASE WHEN x IS NULL THEN m WHEN m IS NULL THEN x ELSE (o*m+a*x)/(o+a) END, CASE WHEN x IS NULL THEN q WHEN m IS NULL THEN x*x ELSE (o*q+a*x*x)/(o+a) END,
  CASE WHEN x IS NULL THEN s2 WHEN m IS NULL THEN 1.0 ELSE (o*o*s2+a*a)/((o+a)*(o+a)) END, CASE WHEN x IS NULL AND m IS NOT NULL THEN gap+1 ELSE 0 END
 FROM (SELECT *, xs[i+1] AS x, pow(0.94::DOUBLE, gap+1) AS o, 0.06::DOUBLE AS a FROM ef WHERE i < len(xs))),
ew AS (SELECT code, p0+i-1 AS pos, CASE WHEN s2 < 1 THEN sqrt(greatest((q-m*m)/(1-s2),0)) END AS ewm FROM ef WHERE i > 0)
"""


@query("w19_ewm_std", EWM_SQL + "SELECT code, pos, round(ewm,6) AS ewm, round(ewm*sqrt(252)*100,4) AS ewm_vol FROM ew")
def _(v):
    g = P.returns(K.grid(v.bars, v.cal, ["close"]))
    e = P.ewm_std(g, "ret", 0.94).withColumn("ewm_vol", F.col("ewm") * (252 ** 0.5) * 100)
    return out(e, "code", "pos", ewm=6, ewm_vol=4)


@query("w20_move_threshold", EWM_SQL + """, mt AS (SELECT code, pos, ret, lag(ewm) OVER w AS sg, count(ret) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e0 JOIN ew USING (code,pos) WINDOW w AS (PARTITION BY code ORDER BY pos)),
mt2 AS (SELECT *, CASE WHEN seen >= 60 AND sg IS NOT NULL THEN least(greatest(2*sg, 0.025::DOUBLE), 0.15::DOUBLE) END AS thr FROM mt)
SELECT code, pos, round(thr,6) AS threshold, coalesce(ret > thr,false) AS surge, coalesce(ret < -thr,false) AS plunge FROM mt2""")
def _(v):
    return out(P.move_threshold(K.grid(v.bars, v.cal, ["close"])), "code", "pos", "surge", "plunge", threshold=6)


@query("w22_base_price_returns", """SELECT date, code, round(close/CASE WHEN close-chg<>0 THEN close-chg END-1,6)+0.0 AS ret, round(CASE WHEN lag(close) OVER w > 0 THEN (close-chg)/lag(close) OVER w END,6) AS factor, lag(close) OVER w IS NULL AS first_day
FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)""")
def _(v):
    return out(P.base_price_returns(v.bars), "date", "code", "first_day", ret=6, factor=6)


@query("w23_winsorize_expanding", """, r AS (SELECT code, pos, close/lag(close) OVER (PARTITION BY code ORDER BY pos)-1 AS ret FROM grid),
s AS (SELECT *, count(ret) OVER w AS n, avg(ret) OVER w AS mu, stddev_samp(ret) OVER w AS sd FROM r WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT code, pos, round(CASE WHEN n >= 20 AND ret IS NOT NULL THEN least(greatest(ret, mu-1.5::DOUBLE*sd), mu+1.5::DOUBLE*sd) ELSE ret END,6)+0.0 AS wins FROM s""")
def _(v):
    g = P.returns(K.grid(v.bars, v.cal, ["close"]))
    return out(P.winsorize_expanding(g, "ret", n_sigma=1.5), "code", "pos", wins=6)


@query("w28_vol_exposure", """, r AS (SELECT code, pos, close/lag(close) OVER (PARTITION BY code ORDER BY pos)-1 AS ret FROM grid)
SELECT code, pos, round(CASE WHEN count(ret) OVER w >= 20 THEN CASE WHEN stddev_samp(ret) OVER w > 0 THEN least(1.0, 0.15::DOUBLE/(stddev_samp(ret) OVER w*sqrt(252))) ELSE 1.0 END END,6) AS exposure FROM r WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def _(v):
    from quantloom.operators import backtest as B

    g = P.returns(K.grid(v.bars, v.cal, ["close"]))
    return out(B.vol_exposure(g), "code", "pos", exposure=6)


@query("w29_drawdown_curve", """, b1 AS (SELECT code, date, close/lag(close) OVER (PARTITION BY code ORDER BY date)-1 AS ret FROM bars),
b2 AS (SELECT code, date, product(1+ret) OVER (PARTITION BY code ORDER BY date) AS equity FROM b1 WHERE ret IS NOT NULL)
SELECT code, date, round(equity,6) AS equity, round(equity/max(equity) OVER (PARTITION BY code ORDER BY date)-1,6)+0.0 AS drawdown FROM b2""")
def _(v):
    from pyspark.sql import Window

    b = v.bars.withColumn("ret", C.change(F.col("close"), F.lag("close").over(Window.partitionBy("code").orderBy("date"))))
    return out(P.equity_and_drawdown(b, ("code",)), "code", "date", equity=6, drawdown=6)


@query("a18_share_above_ma", UNI_SQL + """, ma AS (SELECT g.date, g.code, close, CASE WHEN count(close) OVER w >= 18 THEN avg(close) OVER w END AS ma FROM grid g WINDOW w AS (PARTITION BY code ORDER BY pos ROWS 19 PRECEDING))
SELECT date, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN avg(CASE WHEN close > ma THEN 1.0 ELSE 0.0 END) END,6)+0.0 AS above FROM ma JOIN dsnap USING (date) JOIN members USING (snap_date, code) WHERE ma IS NOT NULL GROUP BY date""")
def _(v):
    from quantloom.operators import boards as BD

    g = K.with_date(K.grid(v.bars, v.cal, ["close"]), v.cal)
    return out(BD.share_above_ma(g, membership(v), 20, 10), "date", "n", above=6)


@query("a20_percentile_of_last", """, l AS (SELECT code, max_by(close, date) AS last FROM bars GROUP BY code)
SELECT code, round(last,4) AS last, round(avg(CASE WHEN close <= last THEN 1.0 ELSE 0.0 END),6) AS pct FROM bars JOIN l USING (code) GROUP BY ALL""")
def _(v):
    from quantloom.operators import stats as S

    return out(S.percentile_of_last(v.bars, ("code",), "date", "close"), "code", last=4, pct=6)


@query("k01_rankings", """, last AS (SELECT * FROM bars WHERE date=(SELECT max(date) FROM bars) AND volume > 0), net AS (SELECT date, code, sum(CASE WHEN who='frgn' THEN net END) AS frgn, sum(CASE WHEN who='inst' THEN net END) AS inst FROM flows GROUP BY ALL),
x AS (SELECT l.code, m AS market, unnest(['value','volume','up','down','cap','frgn','inst']) AS metric, unnest([value, volume, close/(close-chg)-1, -(close/(close-chg)-1), cap, frgn, inst]) AS score
 FROM last l LEFT JOIN net USING (date, code), unnest([l.market,'ALL']) t(m)),
y AS (SELECT *, row_number() OVER (PARTITION BY market, metric ORDER BY score DESC, code) AS rk FROM x WHERE score IS NOT NULL)
SELECT market, metric, rk, code FROM y WHERE rk <= 30""")
def _(v):
    from quantloom.operators import boards as BD

    net = v.flows.groupBy("date", "code").pivot("who", ["frgn", "inst"]).agg(F.sum("net"))
    last = v.bars.where(F.col("date") == v.cal.agg(F.max("date")).scalar()).join(net, ["date", "code"], "left")
    return BD.rankings(last, 30).select("market", "metric", F.col("rk").cast("long").alias("rk"), "code")
