"""Queries: features, information coefficients, backtests, dividends, fundamentals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import cols as C
from quantloom.operators import backtest as B
from quantloom.operators import calendar as K
from quantloom.operators import dividends as D
from quantloom.operators import fundamentals as FU
from quantloom.operators import prices as P
from quantloom.operators import ranks
from quantloom.operators import stats as S
from quantloom.operators import universe as U
from quantloom.plans.market import ADJ_SQL, DV_SQL, EX_SQL, FEATS, PF_SQL, UNI_SQL, feature_grid, membership, out
from quantloom.plans.registry import query
from quantloom.plans.views import r6


def nw_sql(src: str, keys: str, lags: str, out: str = "nw") -> str:
    """Textbook Newey-West over CTE src(keys, o, x): autocovariances by self join."""
    on = " AND ".join(f"a.{k.strip()}=b.{k.strip()}" for k in keys.split(","))
    return f""", {out}0 AS (SELECT {keys}, x, row_number() OVER (PARTITION BY {keys} ORDER BY o) AS i, count(*) OVER (PARTITION BY {keys}) AS n,
  avg(x) OVER (PARTITION BY {keys}) AS mu, least({lags}, count(*) OVER (PARTITION BY {keys}) - 1) AS lg FROM {src} WHERE x IS NOT NULL),
{out}1 AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, any_value(a.n) AS n, any_value(a.mu) AS mean,
  sum(CASE WHEN a.i=b.i THEN 1.0::DOUBLE ELSE 2.0::DOUBLE*(1-(a.i-b.i)::DOUBLE/(a.lg+1)) END*(a.x-a.mu)*(b.x-b.mu))/any_value(a.n) AS var
  FROM {out}0 a JOIN {out}0 b ON {on} AND b.i BETWEEN a.i-a.lg AND a.i GROUP BY ALL),
{out} AS (SELECT {keys}, n, mean, CASE WHEN n >= 3 AND var > 1e-300 THEN mean/sqrt(var/n) END AS nw_t FROM {out}1)"""


def avg_rank_sql(expr: str, part: str) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {expr}) + (count(*) OVER (PARTITION BY {part}, {expr}) - 1)/2.0::DOUBLE)"


IC_SQL = DV_SQL + PF_SQL + """, lf AS (SELECT u.pos, u.code, h, fwd, unnest(['mom_12_1','rev_1m','low_vol','tail']) AS feature, unnest([mom_12_1,rev_1m,low_vol,tail]) AS v
  FROM (SELECT pos, code, in_universe, unnest([5,20]) AS h, unnest([lead(close,5) OVER w/close-1, lead(close,20) OVER w/close-1]) AS fwd FROM uni WINDOW w AS (PARTITION BY code ORDER BY pos)) u
  JOIN pf USING (pos, code) WHERE in_universe AND fwd IS NOT NULL),
lr AS (SELECT feature, h, pos, """ + avg_rank_sql("v", "feature, h, pos") + " AS rf, " + avg_rank_sql("fwd", "feature, h, pos") + """ AS rt FROM lf WHERE v IS NOT NULL),
ics AS MATERIALIZED (SELECT feature, h, pos, count(*) AS n, round(corr(rf, rt), 10)+0.0 AS ic FROM lr GROUP BY ALL HAVING count(*) >= 5 AND var_pop(rf) > 0 AND var_pop(rt) > 0)
"""
IC_FEATS = ["mom_12_1", "rev_1m", "low_vol", "tail"]


def research_grid(v):
    """One grid with features, universe and forward returns: everything keyed by code runs before anything keyed by day."""
    g = U.dollar_volume(P.price_features(P.returns(K.grid(v.bars, v.cal, ["close", "volume"]))))
    g = P.forward_returns(P.forward_returns(g, 5, out="fwd_5"), 20, out="fwd_20")
    return U.restrict_universe(g)


def all_ics(v):
    """Every feature and horizon as rows of one job."""
    g = research_grid(v).where("in_universe")
    horizons = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"fwd_{h}").alias("fwd")) for h in (5, 20)])
    g = g.select("pos", "code", *IC_FEATS, F.explode(horizons).alias("_h")).select("pos", "code", *IC_FEATS, "_h.h", "_h.fwd").where("fwd is not null")
    long = g.unpivot(["pos", "code", "h", "fwd"], IC_FEATS, "feature", "v")
    ic = S.cross_sectional_ic(long, "v", "fwd", 5, ("feature", "h", "pos"))
    return ic.withColumn("ic", r6("ic", 10))  # an exact zero stays zero in both engines


@query("a01_cross_sectional_ic", IC_SQL + "SELECT feature, h, pos, n, round(ic,6)+0.0 AS ic FROM ics")
def _(v):
    return out(all_ics(v), "feature", "h", "pos", "n", ic=6)


@query("a02_ic_summary", IC_SQL + ", ser AS (SELECT feature, h, pos AS o, ic AS x FROM ics)" + nw_sql("ser", "feature, h", "2*h") + """
SELECT feature, h, nw.n, round(mean,6)+0.0 AS mean, round(nw_t,6)+0.0 AS nw_t, round(hit,6) AS hit, round(mean/sd*sqrt(252.0/h),6)+0.0 AS icir FROM nw
JOIN (SELECT feature, h, avg(CASE WHEN ic>0 THEN 1.0 ELSE 0.0 END) AS hit, CASE WHEN stddev_samp(ic)>0 THEN stddev_samp(ic) END AS sd FROM ics GROUP BY ALL) USING (feature, h)""")
def _(v):
    return out(S.ic_summary(all_ics(v)), "feature", "h", "n", mean=6, nw_t=6, hit=6, icir=6)


@query("a02_ic_by_year", IC_SQL + "SELECT feature, h, CAST(year(date) AS INT) AS year, round(avg(ic),6)+0.0 AS ic, count(*) AS n FROM ics JOIN cal USING (pos) GROUP BY ALL")
def _(v):
    d = K.with_date(all_ics(v), v.cal).groupBy("feature", "h", F.year("date").alias("year")).agg(F.avg("ic").alias("ic"), F.count("*").alias("n"))
    return out(d, "feature", "h", "year", "n", ic=6)


@query("a43_ic_by_year_unpivot", IC_SQL + "SELECT feature, h, CAST(year(date) AS VARCHAR) AS year, round(avg(ic),6)+0.0 AS ic FROM ics JOIN cal USING (pos) GROUP BY ALL")
def _(v):
    ic = K.with_date(all_ics(v), v.cal).withColumn("y", F.year("date"))
    wide = ic.groupBy("feature", "h").pivot("y").agg(F.avg("ic"))
    return out(wide.unpivot(["feature", "h"], wide.columns[2:], "year", "ic").where("ic is not null"), "feature", "h", "year", ic=6)


@query("a03_label_cutoff", "SELECT code, pos FROM grid WHERE pos <= (SELECT max(pos) FROM cal) - 20 AND close IS NOT NULL")
def _(v):
    g = v.bars.join(v.cal, "date").select("code", "pos")
    return S.label_cutoff(g, 20, last=v.cal.agg(F.max("pos")).scalar())


@query("a04_nw_tstat", ", ser AS (SELECT code, date AS o, close/lag(close) OVER (PARTITION BY code ORDER BY date)-1 AS x FROM bars)" + nw_sql("ser", "code", "10") +
       "SELECT code, n, round(mean,6)+0.0 AS mean, round(nw_t,6)+0.0 AS nw_t FROM nw")
def _(v):
    b = v.bars.withColumn("ret", C.change(F.col("close"), F.lag("close").over(Window.partitionBy("code").orderBy("date"))))
    return out(S.nw_tstat(b, ["code"], "date", "ret", 10), "code", "n", mean=6, nw_t=6)


@query("a05_annualize_overlapping", """SELECT code, round(avg(fwd)*252/20,6)+0.0 AS ann FROM (SELECT code, lead(close,20) OVER (PARTITION BY code ORDER BY pos)/close-1 AS fwd FROM grid) GROUP BY code""")
def _(v):
    g = P.forward_returns(K.grid(v.bars, v.cal, ["close"]), 20)
    return out(g.groupBy("code").agg(F.avg("fwd").alias("m")).withColumn("ann", S.annualize_overlapping("m", 20)), "code", ann=6)


BOOT_SQL = """, b0 AS (SELECT code, date, close/lag(close) OVER (PARTITION BY code ORDER BY date)-1 AS x FROM bars),
b1 AS (SELECT code, row_number() OVER (PARTITION BY code ORDER BY date) AS i, sum(x) OVER (PARTITION BY code ORDER BY date) AS p FROM b0 WHERE x IS NOT NULL),
b2 AS (SELECT code, i, p FROM b1 UNION ALL SELECT DISTINCT code, 0, 0.0 FROM b1), b3 AS (SELECT code, max(i) AS n, arg_max(p, i) AS total FROM b1 GROUP BY code),
b4 AS (SELECT code, n, total, boot, unnest(range((n+19)//20)) AS b FROM b3, range(100) AS t(boot)),
b5 AS (SELECT *, ((12345 + boot*7919 + b*104729) % 2147483647) * 48271 % 2147483647 AS z FROM b4),
b6 AS (SELECT *, ((z*z % 2147483647) * 69621 + boot) % 2147483647 % n AS s, least(20, n - b*20) AS len FROM b5),
b7 AS (SELECT b6.code, boot, sum(CASE WHEN s+len <= n THEN e.p - a.p ELSE total - a.p + e.p END) / any_value(n) AS mean FROM b6
  JOIN b2 a ON a.code=b6.code AND a.i=s JOIN b2 e ON e.code=b6.code AND e.i = CASE WHEN s+len <= n THEN s+len ELSE s+len-n END GROUP BY ALL)
"""


@query("a06_block_bootstrap", BOOT_SQL + "SELECT code, round(avg(mean),6)+0.0 AS mean, round(stddev_samp(mean),6)+0.0 AS se FROM b7 GROUP BY code")
def _(v):
    b = v.bars.withColumn("ret", C.change(F.col("close"), F.lag("close").over(Window.partitionBy("code").orderBy("date"))))
    m = S.block_bootstrap_means(b, ["code"], "date", "ret", 20, n_boot=100)
    return out(m.groupBy("code").agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("se")), "code", mean=6, se=6)


RES_SQL = PF_SQL + ", fwd5 AS (SELECT pos, code, rev_1m, low_vol, tail FROM pf)"


def _res_sql(ctrls):
    conds = " AND ".join(f"{c} IS NOT NULL" for c in ["rev_1m", *ctrls])
    rk = ", ".join(f"{avg_rank_sql(c, 'pos')} AS r{i}" for i, c in enumerate(["rev_1m", *ctrls]))
    if len(ctrls) == 1:
        fit = "regr_intercept(r0,r1) OVER p + regr_slope(r0,r1) OVER p * r1"
    else:
        det = "(var_pop(r1) OVER p*var_pop(r2) OVER p - pow(covar_pop(r1,r2) OVER p,2))"
        b1 = f"(covar_pop(r0,r1) OVER p*var_pop(r2) OVER p - covar_pop(r0,r2) OVER p*covar_pop(r1,r2) OVER p)/{det}"
        b2 = f"(covar_pop(r0,r2) OVER p*var_pop(r1) OVER p - covar_pop(r0,r1) OVER p*covar_pop(r1,r2) OVER p)/{det}"
        fit = f"avg(r0) OVER p + {b1}*(r1-avg(r1) OVER p) + {b2}*(r2-avg(r2) OVER p)"
    return RES_SQL + f""", rr AS (SELECT pos, code, {rk}, count(*) OVER (PARTITION BY pos) AS n FROM fwd5 WHERE {conds})
SELECT pos, code, round(r0 - ({fit}),5)+0.0 AS resid FROM rr WHERE n >= 5 WINDOW p AS (PARTITION BY pos)"""


@query("a07_residual_rank_1", _res_sql(["low_vol"]))
def _(v):
    return out(S.residual_rank(feature_grid(v), "rev_1m", ["low_vol"], 5), "pos", "code", resid=5)


@query("a08_residual_rank_2", _res_sql(["low_vol", "tail"]))
def _(v):
    return out(S.residual_rank(feature_grid(v), "rev_1m", ["low_vol", "tail"], 5), "pos", "code", resid=5)


@query("a08_residual_rank_k")
def _(v):
    return out(S.residual_rank(feature_grid(v), "rev_1m", ["low_vol", "tail", "trend_120"], 5), "pos", "code", resid=5)


RET_SQL = ", rets AS (SELECT code, date, close/lag(close) OVER (PARTITION BY code ORDER BY date)-1 AS ret FROM bars)"


def own_returns(v, *extra):
    w = Window.partitionBy("code").orderBy("date")
    return v.bars.select("code", "date", *extra, (C.change(F.col("close"), F.lag("close").over(w))).alias("ret"))


@query("a09_perf_stats", RET_SQL + """, e AS (SELECT code, date, ret, product(1+ret/200) OVER (PARTITION BY code ORDER BY date) AS eq FROM rets WHERE ret IS NOT NULL),
e2 AS (SELECT *, eq/max(eq) OVER (PARTITION BY code ORDER BY date)-1 AS dd FROM e),
s AS (SELECT code, count(*) AS n, max_by(eq,date) AS e1, stddev_samp(ret/200)*sqrt(252) AS vol, min(dd) AS mdd FROM e2 GROUP BY code)
SELECT code, n, round(pow(e1,252.0/n)-1,6)+0.0 AS cagr, round(vol,6) AS vol, round((pow(e1,252.0/n)-1)/vol,6)+0.0 AS sharpe, round(mdd,6)+0.0 AS mdd, round(e1-1,6)+0.0 AS total FROM s""")
def _(v):
    r = own_returns(v).withColumn("ret", F.col("ret") / 200)
    return out(S.perf_stats(r, ("code",)), "code", "n", cagr=6, vol=6, sharpe=6, mdd=6, total=6)


@query("a10_excess_test", RET_SQL + """, mk AS (SELECT date, avg(ret) AS base FROM rets GROUP BY date),
b AS (SELECT code, (row_number() OVER (PARTITION BY code ORDER BY date)-1)//21 AS o, ret-base AS ex FROM rets JOIN mk USING (date) WHERE ret IS NOT NULL),
ser AS (SELECT code, o, sum(ex) AS x FROM b GROUP BY ALL)""" + nw_sql("ser", "code", "2") +
       "SELECT code, round(mean*252/21,6)+0.0 AS excess_ann, round(nw_t,6)+0.0 AS excess_t, n AS months FROM nw")
def _(v):
    r = own_returns(v)
    base = r.groupBy("date").agg(F.avg("ret").alias("base"))
    return out(S.excess_test(r.join(base, "date"), ("code",)), "code", "months", excess_ann=6, excess_t=6)


PHI_SQL = "(0.5 + exp(-{z}*{z}/2)/sqrt(2*pi())*list_sum(list_transform(range(0,80), lambda i: CASE WHEN {z}=0 THEN 0 ELSE sign({z})*exp((2*i+1)*ln(abs({z})) + i*ln(2.0::DOUBLE) + lgamma(i+1.0) - lgamma(2*i+2.0)) END)))"
MOM_SQL = RET_SQL + """, mo AS (SELECT code, count(ret) AS n, avg(ret)/stddev_samp(ret) AS sr, skewness(ret) AS sk, kurtosis(ret)+3 AS ku FROM rets WHERE ret IS NOT NULL GROUP BY code)"""


@query("a12_psr", MOM_SQL + ", z AS (SELECT *, (sr-0.3::DOUBLE)*sqrt(n-1)/sqrt(1-sk*sr+(ku-1)/4*sr*sr) AS z FROM mo)" +
       f"SELECT code, n, round(sr,6) AS sr, round(sk,5)+0.0 AS skew, round(ku,4) AS kurt, round({PHI_SQL.format(z='z')},6)+0.0 AS psr FROM z WHERE abs(z) < 6")
def _(v):
    m = S.psr(own_returns(v), 0.3, ("code",))
    z = (F.col("sr") - 0.3) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr"))
    return out(m.where(F.abs(z) < 6), "code", "n", sr=6, skew=5, kurt=4, psr=6)


def ppf_sql(src: str, out: str) -> str:
    """CTE out(p, z): normal quantile by bisection on the series for the distribution function."""
    phi = PHI_SQL.format(z="mid")
    return f""", {out}b(p, lo, hi, k) AS (SELECT p, -7.0::DOUBLE, 7.0::DOUBLE, 0 FROM {src} UNION ALL
 SELECT p, CASE WHEN f < p THEN mid ELSE lo END, CASE WHEN f < p THEN hi ELSE mid END, k+1 FROM (SELECT *, {phi} AS f FROM (SELECT *, (lo+hi)/2 AS mid FROM {out}b WHERE k < 45))),
{out} AS (SELECT p, (lo+hi)/2 AS z FROM {out}b WHERE k = 45)"""


@query("a13_expected_max_sharpe", MOM_SQL + """, tr AS (SELECT s.market, count(*) AS n, var_samp(sr) AS v FROM mo JOIN listing s USING (code) GROUP BY s.market),
ps AS (SELECT DISTINCT unnest([1-1.0::DOUBLE/n, 1-1.0::DOUBLE/(n*exp(1))]) AS p FROM tr)""" + ppf_sql("ps", "q") + """
SELECT market, n, round(sqrt(v)*((1-0.5772156649015329::DOUBLE)*a.z+0.5772156649015329::DOUBLE*b.z),6) AS bar FROM tr JOIN q a ON a.p=1-1.0::DOUBLE/n JOIN q b ON b.p=1-1.0::DOUBLE/(n*exp(1))""")
def _(v):
    m = S.moments(own_returns(v), ("code",)).join(v.listing, "code")
    g = m.groupBy("market").agg(F.count("*").alias("n"), F.var_samp("sr").alias("v"))
    return out(g.withColumn("bar", S.expected_max_sharpe("n", "v")), "market", "n", bar=6)


@query("a13_dsr", MOM_SQL + """, tr AS (SELECT count(*) AS n, var_samp(sr) AS v FROM mo), ps AS (SELECT DISTINCT unnest([1-1.0::DOUBLE/n, 1-1.0::DOUBLE/(n*exp(1))]) AS p FROM tr)""" + ppf_sql("ps", "q") + """
, br AS (SELECT sqrt(v)*((1-0.5772156649015329::DOUBLE)*(SELECT z FROM q WHERE p=1-1.0::DOUBLE/n)+0.5772156649015329::DOUBLE*(SELECT z FROM q WHERE p=1-1.0::DOUBLE/(n*exp(1)))) AS bar FROM tr),
zz AS (SELECT code, n, bar, (sr-bar)*sqrt(n-1)/sqrt(1-sk*sr+(ku-1)/4*sr*sr) AS z FROM mo, br)""" +
       f"SELECT code, n, round(bar,6) AS sr_star, round({PHI_SQL.format(z='z')},6)+0.0 AS dsr FROM zz WHERE abs(z) < 6")
def _(v):
    r = own_returns(v)
    d = S.dsr(r, S.moments(r, ("code",)), ("code",))
    z = (F.col("sr") - F.col("sr_star")) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr"))
    return out(d.where(F.abs(z) < 6), "code", "n", sr_star=6, dsr=6)


@query("a14_bonferroni_t", ", nt AS (SELECT market, count(*) AS n FROM listing GROUP BY market), ps AS (SELECT DISTINCT 1-0.05::DOUBLE/(2*n) AS p FROM nt)" + ppf_sql("ps", "q") +
       "SELECT market, n, round(z,6) AS t FROM nt JOIN q ON q.p=1-0.05::DOUBLE/(2*n)")
def _(v):
    g = v.listing.groupBy("market").agg(F.count("*").alias("n"))
    return out(g.withColumn("t", S.bonferroni_t("n")), "market", "n", t=6)


VERDICT_SQL = IC_SQL + """, ser AS (SELECT feature, h, CASE WHEN date < DATE '2000-01-01' THEN 'insample' ELSE 'holdout' END AS phase, pos AS o, ic AS x FROM ics JOIN cal USING (pos))""" + \
    nw_sql("ser", "feature, h, phase", "2*h")


def phase_tests(v):
    ic = K.with_date(all_ics(v), v.cal).withColumn("phase", F.when(F.col("date") < F.lit("2000-01-01").cast("date"), "insample").otherwise("holdout"))
    return S.nw_tstat(ic, ["feature", "h", "phase"], "pos", "ic", F.col("h") * 2).withColumn("study", F.lit("price_features"))


@query("a16_study_verdict", VERDICT_SQL + """, i AS (SELECT * FROM nw WHERE phase='insample'), o AS (SELECT * FROM nw WHERE phase='holdout')
SELECT feature, h, round(i.nw_t,6)+0.0 AS t_in, round(o.nw_t,6)+0.0 AS t_out, coalesce(abs(i.nw_t) >= 0.5,false) AS candidate,
 coalesce(abs(i.nw_t) >= 0.5,false) AND coalesce(sign(i.nw_t)=sign(o.nw_t) AND o.nw_t*sign(i.nw_t) >= 0.3,false) AS confirmed FROM i LEFT JOIN o USING (feature, h)""")
def _(v):
    return out(S.study_verdict(phase_tests(v), 0.5, 0.3), "feature", "h", "candidate", "confirmed", t_in=6, t_out=6)


@query("k06_best_test", VERDICT_SQL + """SELECT phase, max_by(feature, (abs(coalesce(nw_t,0)), feature, h)) AS feature, max_by(h, (abs(coalesce(nw_t,0)), feature, h)) AS h,
 round(max_by(nw_t, (abs(coalesce(nw_t,0)), feature, h)),6)+0.0 AS nw_t FROM nw GROUP BY phase""")
def _(v):
    return out(S.best_test(phase_tests(v), ("phase",)), "phase", "feature", "h", nw_t=6)


@query("a42_study_ledger", VERDICT_SQL + """, b AS (SELECT max_by(feature, (abs(coalesce(nw_t,0)), feature, h)) AS f, max_by(h, (abs(coalesce(nw_t,0)), feature, h)) AS h, max_by(nw_t, (abs(coalesce(nw_t,0)), feature, h)) AS t,
 count(*) FILTER (abs(nw_t) >= 0.5) AS hits FROM nw WHERE phase='insample')
SELECT 'price_features' AS study, 'best ' || f || ' h' || h || ' t ' || printf('%.2f', t) AS metric, CASE WHEN hits > 0 THEN 'pass' ELSE 'fail' END AS status, EXISTS (SELECT 1 FROM nw WHERE phase='holdout') AS holdout_used FROM b""")
def _(v):
    from quantloom.operators import boards as BD

    return BD.study_ledger(phase_tests(v), 0.5)


BT = dict(start="1998-01-05", end="2001-06-25", every=10, top_frac=0.2, delay=1)


def bt_sql(size: bool, top: float, name: str = "run") -> str:
    w0 = ("CASE WHEN tot > 0 THEN s/tot ELSE 1.0::DOUBLE/k END" if size else "1.0::DOUBLE/k")
    return f""", pp AS (SELECT min(pos) AS a, max(pos) AS b FROM cal WHERE date BETWEEN DATE '1998-01-05' AND DATE '2001-06-25'),
sc AS (SELECT u.pos, u.code, u.in_universe AND count(u.close) OVER (PARTITION BY u.code ORDER BY u.pos) >= 52 AS ok, pf.low_vol AS score, g.cap AS size FROM uni u JOIN pf USING (pos, code) JOIN grid g USING (pos, code)),
sg AS (SELECT sc.*, row_number() OVER (PARTITION BY pos ORDER BY score DESC, code) AS rk, count(*) OVER (PARTITION BY pos) AS n FROM sc, pp WHERE ok AND score IS NOT NULL AND pos BETWEEN a AND b AND (pos-a)%10=0 AND pos+1<=b),
tg AS MATERIALIZED (SELECT seg, code, {w0} AS w0 FROM (SELECT pos+1 AS seg, code, CASE WHEN size>0 THEN size END AS s, count(*) OVER (PARTITION BY pos) AS k, sum(CASE WHEN size>0 THEN size END) OVER (PARTITION BY pos) AS tot
  FROM sg WHERE rk <= greatest(1, ceil(n*{top}::DOUBLE)))),
rr AS (SELECT code, pos, coalesce(close/lag(close) OVER (PARTITION BY code ORDER BY pos)-1,0) AS r FROM grid),
hd AS MATERIALIZED (SELECT t.seg, g.pos, g.code, t.w0, t.w0*product(1+r) OVER (PARTITION BY t.seg, t.code ORDER BY g.pos) AS wg FROM rr g JOIN tg t ON g.code=t.code, pp WHERE g.pos > t.seg AND g.pos <= least(t.seg+10, pp.b)),
vv AS (SELECT pos, seg, sum(wg)+1-sum(w0) AS v, count(*) FILTER (wg>0) AS nd FROM hd GROUP BY ALL),
pre AS (SELECT hd.pos AS seg, code, wg/v AS w FROM hd JOIN vv USING (pos), pp WHERE (hd.pos-(a+1))%10=0),
tr AS (SELECT seg, sum(greatest(coalesce(tg.w0,0)-coalesce(pre.w,0),0)) AS buys, sum(greatest(coalesce(pre.w,0)-coalesce(tg.w0,0),0)) AS sells, count(*) FILTER (tg.w0>0) AS nn FROM tg FULL OUTER JOIN pre USING (seg, code) GROUP BY seg),
{name} AS MATERIALIZED (SELECT date, coalesce(v/CASE WHEN pos-1=vv.seg THEN 1 ELSE lag(v) OVER (ORDER BY pos) END-1,0) AS gross, coalesce(buys*0.00065::DOUBLE+sells*0.00265::DOUBLE,0) AS cost,
 coalesce((buys+sells)/2,0) AS turnover, coalesce(CASE WHEN pos>=a+1 AND (pos-a-1)%10=0 THEN coalesce(nn,0) ELSE nd END,0) AS n_hold FROM cal LEFT JOIN vv USING (pos) LEFT JOIN (SELECT seg AS pos, * EXCLUDE seg FROM tr) USING (pos), pp WHERE pos BETWEEN a AND b)"""


def bt_grid(v):
    g = U.dollar_volume(P.price_features(P.returns(K.grid(v.bars, v.cal, ["close", "volume", "cap"]))))
    seen = F.count("close").over(C.by_code().rowsBetween(Window.unboundedPreceding, 0))
    g = U.restrict_universe(g.withColumn("_seen", seen))
    return g.select("pos", "code", "close", F.col("low_vol").alias("score"), F.col("cap").alias("size"), "cap", (F.col("in_universe") & (F.col("_seen") >= 52)).alias("ok"))


BT_OUT = "SELECT date, round(gross,6)+0.0 AS gross, round(cost,6)+0.0 AS cost, round(gross-cost,6)+0.0 AS ret, round(turnover,6)+0.0 AS turnover, n_hold FROM run"


@query("q02_backtest_equal", DV_SQL + PF_SQL + bt_sql(False, 0.2) + BT_OUT)
def _(v):
    return out(B.backtest(bt_grid(v), v.cal, **BT), "date", "n_hold", gross=6, cost=6, ret=6, turnover=6)


@query("q02_backtest_cap_weighted", DV_SQL + PF_SQL + bt_sql(True, 0.8) + BT_OUT)
def _(v):
    return out(B.backtest(bt_grid(v), v.cal, **{**BT, "top_frac": 0.8, "by_size": True}), "date", "n_hold", gross=6, cost=6, ret=6, turnover=6)


@query("q02_target_weights", DV_SQL + PF_SQL + bt_sql(True, 0.2) + "SELECT seg, code, round(w0,6) AS w FROM tg")
def _(v):
    g = bt_grid(v)
    a = v.cal.where(F.col("date").between(F.lit(BT["start"]).cast("date"), F.lit(BT["end"]).cast("date"))).agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    s, e = a.select("a").scalar(), a.select("b").scalar()
    sig = g.where(F.col("pos").between(s, e) & ((F.col("pos") - s) % 10 == 0) & (F.col("pos") + 1 <= e))
    return out(B.target_weights(sig, 0.2, True).withColumn("seg", F.col("pos") + 1), "seg", "code", w=6)


BENCH_SQL = ", mkr AS (SELECT date, sum(r*cap)/sum(cap) AS bench_ret FROM (SELECT date, close/lag(close) OVER (PARTITION BY code ORDER BY pos)-1 AS r, lag(cap) OVER (PARTITION BY code ORDER BY pos) AS cap FROM grid) WHERE r IS NOT NULL GROUP BY date)"


def bench_returns(v):
    w = C.by_code()
    g = K.grid(v.bars, v.cal, ["close", "cap"]).withColumn("r", C.change(F.col("close"), C.at("close", -1, w))).withColumn("_c", C.at("cap", -1, w)).where("r is not null")
    return K.with_date(g, v.cal).groupBy("date").agg((F.sum(F.col("r") * F.col("_c")) / F.sum("_c")).alias("bench_ret"))


@query("a46_evaluation_window", DV_SQL + PF_SQL + bt_sql(False, 0.2) + BENCH_SQL + """SELECT run.date, round(gross-cost,6)+0.0 AS ret, round(coalesce(bench_ret,0),6)+0.0 AS bench_ret FROM run LEFT JOIN mkr USING (date)
WHERE run.date > (SELECT min(date) FROM run WHERE n_hold > 0)""")
def _(v):
    return out(B.evaluation_window(B.backtest(bt_grid(v), v.cal, **BT), bench_returns(v)), "date", ret=6, bench_ret=6)


@query("a47_turnover_cost_summary", DV_SQL + PF_SQL + bt_sql(False, 0.2) + "SELECT 'low_vol' AS series, round(sum(turnover)/(count(*)/252.0),6) AS turnover_ann, round(sum(cost)/(count(*)/252.0),6) AS cost_ann, median(n_hold)::DOUBLE AS n_hold FROM run")
def _(v):
    r = B.backtest(bt_grid(v), v.cal, **BT).withColumn("series", F.lit("low_vol"))
    return out(B.turnover_cost_summary(r), "series", turnover_ann=6, cost_ann=6, n_hold=6)


@query("a34_yearly_returns", DV_SQL + PF_SQL + bt_sql(False, 0.2) + "SELECT 'low_vol' AS series, CAST(year(date) AS INT) AS year, round(product(1+gross-cost)-1,6)+0.0 AS ret FROM run GROUP BY ALL")
def _(v):
    r = B.backtest(bt_grid(v), v.cal, **BT).withColumn("series", F.lit("low_vol"))
    return out(S.yearly_returns(r), "series", "year", ret=6)


@query("a33_holding_sector_share", DV_SQL + PF_SQL + bt_sql(False, 0.2) + """, sh0 AS (SELECT seg, sector, count(*)::DOUBLE AS c FROM tg JOIN listing USING (code) GROUP BY seg, sector), sh AS (SELECT *, c/sum(c) OVER (PARTITION BY seg) AS s FROM sh0)
SELECT sector, round(sum(s)/(SELECT count(DISTINCT seg) FROM tg),6) AS share FROM sh GROUP BY sector""")
def _(v):
    return out(_diagnostics(v)[0], "sector", share=6)


@query("a33_holding_cap_rank", DV_SQL + PF_SQL + bt_sql(False, 0.2) + ", cr AS (SELECT pos, code, " + avg_rank_sql("-size", "pos") +
       "/count(*) OVER (PARTITION BY pos) AS pct FROM sc WHERE ok AND size IS NOT NULL) SELECT pos, round(median(pct),6) AS cap_rank_pct FROM cr JOIN tg ON tg.code=cr.code AND tg.seg=cr.pos+1 GROUP BY pos")
def _(v):
    return out(_diagnostics(v)[1], "pos", cap_rank_pct=6)


def _diagnostics(v):
    g = bt_grid(v)
    p = v.cal.where(F.col("date").between(F.lit(BT["start"]).cast("date"), F.lit(BT["end"]).cast("date"))).agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    a, b = p.select("a").scalar(), p.select("b").scalar()
    sig = g.where(F.col("pos").between(a, b) & ((F.col("pos") - a) % 10 == 0) & (F.col("pos") + 1 <= b))
    picks = B.target_weights(sig, 0.2).join(v.listing.select("code", "sector"), "code")
    return B.holding_diagnostics(picks, sig)


@query("q03_vol_target", RET_SQL + """, x AS (SELECT code, date, ret, CASE WHEN count(ret) OVER w >= 20 THEN least(1.0, 0.15::DOUBLE/(stddev_samp(ret) OVER w*sqrt(252))) END AS e FROM rets WHERE ret IS NOT NULL
  WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY code ORDER BY date),0) AS w0 FROM x WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'),
z AS (SELECT *, w0*ret AS pr, CASE WHEN 1+w0*ret>0 THEN w0*(1+ret)/(1+w0*ret) ELSE w0 END AS wd FROM y),
q AS (SELECT *, coalesce(e,wd) AS tgt, abs(coalesce(e,wd)-wd)*0.0005::DOUBLE AS c FROM z)
SELECT code, date, round((1+pr)*(1-c)-1,6)+0.0 AS ret, round(tgt,6)+0.0 AS exposure, round(c,8)+0.0 AS cost FROM q""")
def _(v):
    return out(B.vol_target(own_returns(v), "1996-01-01", "2000-12-31"), "code", "date", ret=6, exposure=6, cost=8)


PAPER_SQL = """, pd AS (SELECT market AS name, code, (1+CAST(code AS INT)%3)::DOUBLE AS weight, DATE '1996-01-15' AS start, 0.0005::DOUBLE AS buy, 0.001::DOUBLE AS sell FROM listing QUALIFY row_number() OVER (PARTITION BY market ORDER BY code) <= 3),
pw AS (SELECT *, weight/sum(weight) OVER (PARTITION BY name) AS w FROM pd),
px0 AS (SELECT p.*, d.date FROM pw p JOIN (SELECT DISTINCT p.name, b.date FROM pw p JOIN bars b USING (code) WHERE b.date > p.start) d USING (name)),
px1 AS (SELECT x.*, last_value(b.close/1000+100 IGNORE NULLS) OVER (PARTITION BY x.name, x.code ORDER BY x.date) AS close FROM px0 x LEFT JOIN bars b ON b.code=x.code AND b.date=x.date),
px2 AS (SELECT *, coalesce(close/lag(close) OVER k-1,0) AS r, coalesce(date_trunc('month',date) <> date_trunc('month', lag(date) OVER k), true) AS isnew FROM px1 WINDOW k AS (PARTITION BY name, code ORDER BY date)),
pl AS (SELECT name, list(DISTINCT date ORDER BY date) AS ds FROM px2 GROUP BY name),
pa AS MATERIALIZED (SELECT name, date, bool_or(isnew) AS isnew, list({'w': w, 'r': r, 'b': buy, 's': sell} ORDER BY code) AS a, row_number() OVER (PARTITION BY name ORDER BY date) AS i FROM px2 GROUP BY name, date),
sim(name, i, date, wt, nav, prev, cost) AS (SELECT name, 0::BIGINT, NULL::DATE, list_transform(a, lambda e: 0.0::DOUBLE), 1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM pa WHERE i=1
 UNION ALL SELECT name, i, date, CASE WHEN isnew THEN list_transform(a, lambda e: e.w) ELSE wd END, nv*(1-c), nav, c FROM (
  SELECT *, CASE WHEN isnew THEN list_sum(list_transform(range(1, len(a)+1), lambda j: CASE WHEN a[j].w > wd[j] THEN (a[j].w-wd[j])*a[j].b ELSE (wd[j]-a[j].w)*a[j].s END)) ELSE 0.0 END AS c FROM (
   SELECT *, nav*(1+pr) AS nv, list_transform(range(1, len(a)+1), lambda j: wt[j]*(1+a[j].r)/(1+pr)) AS wd FROM (
    SELECT sim.name, pa.i, pa.date, sim.wt, sim.nav, pa.a, pa.isnew, list_sum(list_transform(range(1, len(pa.a)+1), lambda j: sim.wt[j]*pa.a[j].r)) AS pr FROM sim JOIN pa ON pa.name=sim.name AND pa.i=sim.i+1)))),
pnav AS MATERIALIZED (SELECT name, date, nav, nav/prev-1 AS ret, cost FROM sim WHERE i > 0)
"""


def paper_closes(v):
    """Closes pulled towards a level, so that compounding over the years stays in a comparable range."""
    return v.bars.select("code", "date", (F.col("close") / 1000 + 100).alias("close"))


def paper_defs(v):
    d = ranks.top_k(v.listing, ["market"], [F.col("code")], 3)
    return d.select(F.col("market").alias("name"), "code", (F.col("code").cast("int") % 3 + 1).cast("double").alias("weight"), F.lit("1996-01-15").cast("date").alias("start"),
                    F.lit(0.0005).alias("buy"), F.lit(0.001).alias("sell"))


@query("q04_paper_nav", PAPER_SQL + "SELECT name, date, round(nav,6) AS nav, round(ret,6)+0.0 AS ret, round(cost,8)+0.0 AS cost FROM pnav")
def _(v):
    return out(B.paper_nav(paper_defs(v), paper_closes(v)), "name", "date", nav=6, ret=6, cost=8)


BA_SQL = ", ba AS (SELECT name, p.date, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY p.date)=1 THEN 0 ELSE coalesce(bench_ret,0) END AS bench_ret FROM pnav p LEFT JOIN mkr USING (date))"


@query("a48_benchmark_returns_aligned", PAPER_SQL + BENCH_SQL + BA_SQL + "SELECT name, date, round(bench_ret,6)+0.0 AS bench_ret FROM ba")
def _(v):
    nav = B.paper_nav(paper_defs(v), paper_closes(v))
    return out(B.benchmark_returns_aligned(nav.select("name", "date"), bench_returns(v)), "name", "date", bench_ret=6)


@query("a15_promotion_gate", PAPER_SQL + BENCH_SQL + BA_SQL + """, ml2 AS (SELECT name, date_trunc('month', max(date)) AS lm FROM pnav GROUP BY name),
ser AS (SELECT name, date_trunc('month', date) AS o, product(1+ret)-product(1+bench_ret) AS x FROM pnav JOIN ba USING (name, date) JOIN ml2 USING (name) WHERE date < lm GROUP BY ALL)""" + nw_sql("ser", "name", "2") + """
SELECT name, nw.n AS months_complete, round(c,6)+0.0 AS cum_return, round(b,6)+0.0 AS bench_cum_return, round(nw_t,6)+0.0 AS monthly_excess_t, nw.n >= 6 AND c > b AND coalesce(nw_t >= 1.96,false) AS passed
FROM (SELECT name, product(1+ret)-1 AS c, product(1+bench_ret)-1 AS b FROM pnav JOIN ba USING (name, date) GROUP BY name) JOIN nw USING (name)""")
def _(v):
    nav = B.paper_nav(paper_defs(v), paper_closes(v))
    g = B.promotion_gate(nav, B.benchmark_returns_aligned(nav.select("name", "date"), bench_returns(v)))
    return out(g, "name", "months_complete", "passed", cum_return=6, bench_cum_return=6, monthly_excess_t=6)


# ---- dividends ----
YLD_SQL = ADJ_SQL + EX_SQL + """, ylds AS MATERIALIZED (SELECT ex.code, ex_date, min(CASE WHEN a.raw_close>0 THEN cum_date END) AS cum_date, sum(CASE WHEN a.raw_close>0 THEN dps END) AS dps, max(CASE WHEN a.raw_close>0 THEN a.raw_close END) AS raw_close,
  sum(CASE WHEN a.raw_close>0 THEN dps/a.raw_close END) AS yield, count(*) FILTER (a.raw_close IS NULL) AS missing FROM ex LEFT JOIN adj a ON a.code=ex.code AND a.date=ex.cum_date WHERE ex_date IS NOT NULL GROUP BY ALL)
"""


def adjusted(v):
    return P.adjust_prices(v.bars.withColumn("raw_close", F.col("close")))


@query("j05_dividend_yields", YLD_SQL + "SELECT code, ex_date, cum_date, round(dps,6) AS dps, round(raw_close,6) AS raw_close, round(yield,6) AS yield, missing FROM ylds")
def _(v):
    raw = v.bars.select("code", "date", F.col("close").alias("raw_close"))
    return out(D.dividend_yields(v.divs, raw, v.cal), "code", "ex_date", "cum_date", "missing", dps=6, raw_close=6, **{"yield": 6})


@query("w09_total_return_close", YLD_SQL + """, t AS (SELECT a.code, a.date, a.close, coalesce(a.close/lag(a.close) OVER (PARTITION BY a.code ORDER BY a.date)-1,0) AS r, coalesce(y.yield,0) AS y FROM adj a LEFT JOIN ylds y ON y.code=a.code AND y.ex_date=a.date)
SELECT code, date, round(close*product((1+r+y)/(1+r)) OVER (PARTITION BY code ORDER BY date),7) AS tr_close FROM t""")
def _(v):
    a = adjusted(v)
    y = D.dividend_yields(v.divs, a, v.cal)
    return out(P.total_return_close(a, y), "code", "date", tr_close=7)


DIVF_SQL = YLD_SQL + """, kd AS (SELECT ex.code, (SELECT min(pos) FROM cal WHERE date >= coalesce(CAST(pay_date AS DATE), record_date+120)) AS pos, dps*a.close/a.raw_close AS dps_adj FROM ex JOIN adj a ON a.code=ex.code AND a.date=ex.cum_date),
kd2 AS (SELECT k.code, c.date, sum(dps_adj) AS dps_adj FROM kd k JOIN cal c USING (pos) GROUP BY ALL),
tt AS MATERIALIZED (SELECT g.code, g.pos, g.date, g.close, coalesce((SELECT sum(dps_adj) FROM kd2 k WHERE k.code=g.code AND k.date > g.date-365 AND k.date <= g.date),0) AS ttm FROM adjgrid g),
dvf AS (SELECT t.code, t.pos, t.date, t.close, t.ttm, t.ttm/t.close AS dy_ttm, CASE WHEN t.ttm > 0 AND p.ttm > 0 THEN t.ttm/p.ttm-1 END AS div_growth
  FROM (SELECT *, (SELECT max(pos) FROM cal WHERE cal.date <= tt.date-365) AS pp FROM tt) t LEFT JOIN tt p ON p.code=t.code AND p.pos=t.pp)
"""


@query("w10_dividend_features", DIVF_SQL + "SELECT code, date, round(ttm,6)+0.0 AS ttm, round(dy_ttm,6)+0.0 AS dy_ttm, round(div_growth,6)+0.0 AS div_growth FROM dvf")
def _(v):
    return out(D.dividend_features(adjusted(v), v.divs, v.cal), "code", "date", ttm=6, dy_ttm=6, div_growth=6)


@query("k04_upcoming_dividends", "SELECT code, record_date, round(dps,2) AS dps, kind FROM divs WHERE record_date BETWEEN DATE '1998-11-15'-30 AND DATE '1998-11-15'+120 ORDER BY record_date DESC, code, dps LIMIT 10")
def _(v):
    return out(D.upcoming_dividends(v.divs, "1998-11-15"), "code", "record_date", "kind", dps=2)


# ---- fundamentals ----
FIN_SQL = """, fw0 AS (SELECT stock_code, year*4+q AS period, max(fs) FILTER (fs='CFS') AS has, """ + ", ".join(
    f"max(value) FILTER (item='{i}' AND fs='{f}') AS {i}_{f}" for i in ("revenue", "op", "ni", "assets", "liab", "equity") for f in ("CFS", "OFS")) + """,
  max(rcept_dt) FILTER (fs='CFS') AS r_CFS, max(rcept_dt) FILTER (fs='OFS') AS r_OFS FROM fin GROUP BY ALL),
wide AS MATERIALIZED (SELECT stock_code, period, """ + ", ".join(f"CASE WHEN has IS NOT NULL THEN {i}_CFS ELSE {i}_OFS END AS {i}" for i in ("revenue", "op", "ni", "assets", "liab", "equity")) + """,
  CASE WHEN has IS NOT NULL THEN r_CFS ELSE r_OFS END AS rcept_dt FROM fw0),
qd AS MATERIALIZED (SELECT stock_code, period, """ + ", ".join(
    f"CASE WHEN (period-1)%4=0 THEN {i} WHEN lag(period) OVER w=period-1 THEN {i}-lag({i}) OVER w END AS {i}" for i in ("revenue", "op", "ni")) + """,
  assets, liab, equity, rcept_dt FROM wide WINDOW w AS (PARTITION BY stock_code ORDER BY period)),
kf AS MATERIALIZED (SELECT a.stock_code, a.period, a.rcept_dt, a.equity, CASE WHEN count(n.ni)=4 THEN sum(n.ni) END AS ni_ttm,
  CASE WHEN a.equity>0 AND any_value(e.equity)>0 THEN (a.equity+any_value(e.equity))/2 END AS avg_eq
  FROM qd a LEFT JOIN qd n ON n.stock_code=a.stock_code AND n.period BETWEEN a.period-3 AND a.period LEFT JOIN qd e ON e.stock_code=a.stock_code AND e.period=a.period-4 GROUP BY a.stock_code, a.period, a.rcept_dt, a.equity)
"""


@query("j08_consolidated_first", FIN_SQL + "SELECT stock_code, period, round(revenue,4) AS revenue, round(ni,4)+0.0 AS ni, round(equity,4) AS equity, rcept_dt FROM wide")
def _(v):
    return out(FU.consolidated_first(v.fin), "stock_code", "period", "rcept_dt", revenue=4, ni=4, equity=4)


@query("w11_cumulative_to_quarterly", FIN_SQL + "SELECT stock_code, period, round(revenue,4)+0.0 AS revenue, round(op,4)+0.0 AS op, round(ni,4)+0.0 AS ni FROM qd")
def _(v):
    return out(FU.quarterly(FU.consolidated_first(v.fin)), "stock_code", "period", revenue=4, op=4, ni=4)


def quarters(v):
    return FU.quarterly(FU.consolidated_first(v.fin))


@query("w12_known_fundamentals", FIN_SQL + "SELECT stock_code, period, rcept_dt, round(ni_ttm,4)+0.0 AS ni_ttm, round(equity,4) AS equity, round(avg_eq,5) AS avg_eq FROM kf")
def _(v):
    return out(FU.known_fundamentals(quarters(v)), "stock_code", "period", "rcept_dt", ni_ttm=4, equity=4, avg_eq=5)


STEP_SQL = FIN_SQL + """, kp0 AS (SELECT stock_code AS code, period, ni_ttm, equity, avg_eq, (SELECT min(pos) FROM cal WHERE date > rcept_dt) AS kpos FROM kf),
kp1 AS (SELECT * FROM kp0 WHERE kpos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code, kpos ORDER BY period DESC)=1),
kp AS (SELECT * FROM (SELECT *, max(period) OVER (PARTITION BY code ORDER BY kpos) AS top FROM kp1) WHERE period=top),
sp0 AS (SELECT g.date, g.pos, g.code, any_value(g.market) AS market, any_value(g.close) AS close, any_value(g.cap) AS cap, """ + ", ".join(
    f"max_by(kp.{c}, kpos) FILTER (kp.{c} IS NOT NULL) AS {c}" for c in ("ni_ttm", "equity", "avg_eq", "period")) + """ FROM grid g LEFT JOIN kp ON kp.code=g.code AND kp.kpos<=g.pos GROUP BY g.date, g.pos, g.code),
sp AS MATERIALIZED (SELECT date, pos, code, market, close, cap, CASE WHEN fresh THEN ni_ttm END AS ni_ttm, CASE WHEN fresh THEN equity END AS equity, CASE WHEN fresh THEN avg_eq END AS avg_eq
  FROM (SELECT *, date - last_day(make_date((period-1)//4, ((period-1)%4+1)*3, 1)) <= 455 AS fresh FROM sp0))
"""


def stepped(v, values=("close", "cap")):
    g = K.grid(v.bars, v.cal, list(values)).drop("traded")
    return FU.step_panels(g, FU.known_fundamentals(quarters(v)), v.cal)


@query("j07_step_panels", STEP_SQL + "SELECT date, code, round(ni_ttm,4)+0.0 AS ni_ttm, round(equity,4) AS equity, round(avg_eq,5) AS avg_eq FROM sp")
def _(v):
    return out(K.with_date(stepped(v), v.cal), "date", "code", ni_ttm=4, equity=4, avg_eq=5)


QV_SQL = STEP_SQL + """, ff AS (SELECT date, pos, code, CASE WHEN equity>0 THEN equity END/CASE WHEN cap>0 THEN cap END AS bp, ni_ttm/CASE WHEN cap>0 THEN cap END AS ep, ni_ttm/CASE WHEN avg_eq>0 THEN avg_eq END AS roe FROM sp),
qv AS (SELECT pos, code, (""" + avg_rank_sql("bp", "pos") + "+" + avg_rank_sql("roe", "pos") + """)/2/count(*) OVER (PARTITION BY pos) AS qv FROM ff WHERE bp IS NOT NULL AND roe IS NOT NULL)
"""


@query("w13_fundamental_features", QV_SQL + "SELECT date, ff.code, round(bp,8) AS bp, round(ep,8)+0.0 AS ep, round(roe,6)+0.0 AS roe, round(qv,6) AS qv FROM ff LEFT JOIN qv USING (pos, code)")
def _(v):
    f = FU.rank_average(FU.fundamental_features(stepped(v)), ["bp", "roe"], out="qv", jointly=True)
    return out(K.with_date(f, v.cal), "date", "code", bp=8, ep=8, roe=6, qv=6)


@query("w13_rank_avg", PF_SQL + ", ra AS (SELECT pos, code, low_vol, tail, CASE WHEN low_vol IS NOT NULL THEN (rank() OVER (PARTITION BY pos, low_vol IS NULL ORDER BY low_vol)+(count(*) OVER (PARTITION BY pos, low_vol)-1)/2.0)/count(low_vol) OVER (PARTITION BY pos) END AS a,"
       " CASE WHEN rev_1m IS NOT NULL THEN (rank() OVER (PARTITION BY pos, rev_1m IS NULL ORDER BY rev_1m)+(count(*) OVER (PARTITION BY pos, rev_1m)-1)/2.0)/count(rev_1m) OVER (PARTITION BY pos) END AS b FROM pf) SELECT pos, code, round((a+b)/2,6) AS score FROM ra")
def _(v):
    return out(FU.rank_average(feature_grid(v), ["low_vol", "rev_1m"]), "pos", "code", score=6)


@query("w27_per_share_bands", STEP_SQL + "SELECT code, date, round(close,4) AS close, round(ni_ttm/(CASE WHEN cap>0 THEN cap END/close),9)+0.0 AS eps, round(CASE WHEN equity>0 THEN equity END/(CASE WHEN cap>0 THEN cap END/close),9) AS bps FROM sp WHERE ((SELECT max(pos) FROM cal)-pos)%5=0")
def _(v):
    return out(FU.per_share_bands(stepped(v), v.cal), "code", "date", close=4, eps=9, bps=9)


@query("a32_coverage_stats", STEP_SQL + UNI_SQL + ", md AS (SELECT sp.code, ni_ttm FROM sp JOIN dsnap USING (date) JOIN members m ON m.snap_date=dsnap.snap_date AND m.code=sp.code), pm AS (SELECT code, count(*) AS d, count(ni_ttm) AS h FROM md GROUP BY code) SELECT round(sum(h)/sum(d),6) AS coverage, count(*) FILTER (h=0) AS members_without FROM pm")
def _(v):
    d = U.only_members(K.with_date(stepped(v), v.cal), membership(v))
    return out(FU.coverage_stats(d), "members_without", coverage=6)


CAPS_SQL = ", lc AS (SELECT code, market, sector, name, CASE WHEN CAST(code AS INT)%10=3 THEN cap/10000000 ELSE cap/1000 END AS mcap FROM bars WHERE date=(SELECT max(date) FROM cal)) "


def last_caps(v):
    """Caps of the last day in the unit of the facts; every tenth code gets a wrong unit so that the suspect rule bites."""
    scale = F.when(F.col("code").cast("int") % 10 == 3, 10000000.0).otherwise(1000.0)
    return v.bars.where(F.col("date") == v.cal.agg(F.max("date")).scalar()).select("code", "market", "sector", "name", (F.col("cap") / scale).alias("mcap"))


VM_SQL = FIN_SQL + CAPS_SQL + """, tq AS (SELECT a.stock_code, a.period, count(n.ni) FILTER (n.period>a.period-4) AS c1, """ + ", ".join(
    f"CASE WHEN count(n.{i}) FILTER (n.period>a.period-4)=4 THEN sum(n.{i}) FILTER (n.period>a.period-4) END AS {i}_t, CASE WHEN count(n.{i}) FILTER (n.period<=a.period-4)=4 THEN sum(n.{i}) FILTER (n.period<=a.period-4) END AS {i}_p" for i in ("revenue", "op", "ni")) + """
  FROM qd a JOIN qd n ON n.stock_code=a.stock_code AND n.period BETWEEN a.period-7 AND a.period GROUP BY ALL),
vm0 AS (SELECT q.stock_code AS code, q.period, q.rcept_dt, q.liab, q.equity, q.revenue, q.op, e.equity AS eq0, e.revenue AS rev0, e.op AS op0, t.revenue_t, t.op_t, t.ni_t, t.ni_p, t.op_p, lc.mcap
  FROM qd q JOIN tq t USING (stock_code, period) LEFT JOIN qd e ON e.stock_code=q.stock_code AND e.period=q.period-4 LEFT JOIN lc ON lc.code=q.stock_code
  WHERE q.period=(SELECT max(period) FROM qd x WHERE x.stock_code=q.stock_code)),
vm1 AS (SELECT *, coalesce(mcap<>0,false) AND (coalesce(abs(ni_t)>5*mcap,false) OR coalesce(equity>50*mcap,false)) AS suspect FROM vm0),
vm2 AS (SELECT * REPLACE (CASE WHEN NOT suspect THEN revenue_t END AS revenue_t, CASE WHEN NOT suspect THEN op_t END AS op_t, CASE WHEN NOT suspect THEN ni_t END AS ni_t, CASE WHEN NOT suspect THEN equity END AS equity, CASE WHEN NOT suspect THEN eq0 END AS eq0) FROM vm1),
vm AS MATERIALIZED (SELECT code, period, right(((period-1)//4)::VARCHAR,2) || '.' || ((period-1)%4+1) || 'Q' AS label, mcap, ni_t AS ni_ttm, CASE WHEN ni_t>0 THEN mcap/ni_t END AS per, CASE WHEN equity>0 THEN mcap/equity END AS pbr,
  CASE WHEN (equity+coalesce(eq0,equity))/2>0 THEN ni_t/((equity+coalesce(eq0,equity))/2) END AS roe, CASE WHEN revenue_t>0 THEN op_t/revenue_t END AS opm, CASE WHEN equity>0 THEN liab/equity END AS debt,
  CASE WHEN rev0>0 THEN revenue/rev0-1 END AS rev_yoy, CASE WHEN op0>0 THEN op/op0-1 END AS op_yoy, CASE WHEN ni_p>0 THEN ni_t/ni_p-1 END AS ni_ttm_chg, CASE WHEN op_p>0 THEN op_t/op_p-1 END AS op_ttm_chg, coalesce(ni_t<=0,false) AS loss, suspect FROM vm2)
"""
VM_COLS = ["per", "pbr", "roe", "opm", "debt", "rev_yoy", "op_yoy", "ni_ttm_chg", "op_ttm_chg"]


@query("a22_valuation_metrics", VM_SQL + "SELECT code, period, label, loss, suspect, " + ", ".join(f"round({c},5)+0.0 AS {c}" for c in VM_COLS) + " FROM vm")
def _(v):
    return out(FU.valuation_metrics(quarters(v), last_caps(v)), "code", "period", "label", "loss", "suspect", **{c: 5 for c in VM_COLS})


@query("p09_suspect", VM_SQL + "SELECT code, suspect FROM vm")
def _(v):
    return FU.valuation_metrics(quarters(v), last_caps(v)).select("code", "suspect")


MV_SQL = STEP_SQL + """, cf AS (SELECT date, code, market, cap/1000 AS cap, CASE WHEN NOT bad THEN ni_ttm END AS ni, CASE WHEN NOT bad THEN equity END AS eq FROM (SELECT *, coalesce(abs(ni_ttm)>5*cap/1000,false) OR coalesce(equity>50*cap/1000,false) AS bad FROM sp) WHERE cap>0)
"""


def cap_facts(v):
    facts = K.with_date(stepped(v), v.cal).select("date", "code", F.col("ni_ttm").alias("ni"), F.col("equity").alias("eq"))
    return FU.caps_with_fundamentals(v.bars.select("date", "code", "market", (F.col("cap") / 1000).alias("cap")), facts)


@query("j10_caps_with_fundamentals", MV_SQL + "SELECT date, code, market, round(cap,4) AS cap, round(ni,4)+0.0 AS ni, round(eq,4) AS eq FROM cf")
def _(v):
    return out(cap_facts(v), "date", "code", "market", cap=4, ni=4, eq=4)


@query("a21_market_valuation", MV_SQL + """, b AS (SELECT date, market, coalesce(sum(ni) FILTER (ni IS NOT NULL AND eq IS NOT NULL),0) AS e, coalesce(sum(eq) FILTER (ni IS NOT NULL AND eq IS NOT NULL),0) AS b, coalesce(sum(cap) FILTER (ni IS NOT NULL AND eq IS NOT NULL),0) AS m, sum(cap) AS al,
 count(*) FILTER (ni IS NOT NULL AND eq IS NOT NULL) AS n FROM cf GROUP BY ALL)
SELECT date, market, n, round(CASE WHEN e>0 THEN m/e END,4) AS per, round(CASE WHEN b>0 THEN m/b END,5) AS pbr, round(CASE WHEN b>0 THEN e/b END,6)+0.0 AS roe, round(m/al,6)+0.0 AS cover FROM b""")
def _(v):
    return out(FU.market_valuation(cap_facts(v)), "date", "market", "n", per=4, pbr=5, roe=6, cover=6)


@query("a23_season_period", FIN_SQL + "SELECT max(period) AS period FROM (SELECT period FROM qd GROUP BY period HAVING count(DISTINCT stock_code) >= 5)")
def _(v):
    return FU.season_period(quarters(v), 5)


YOY_SQL = FIN_SQL + CAPS_SQL + """, yy AS (SELECT c.stock_code AS code, lc.market, lc.sector, c.revenue, c.op, c.ni, p.revenue AS revenue_p, p.op AS op_p, p.ni AS ni_p FROM qd c LEFT JOIN qd p ON p.stock_code=c.stock_code AND p.period=c.period-4 LEFT JOIN lc ON lc.code=c.stock_code
 WHERE c.period=(SELECT max(period) FROM (SELECT period FROM qd GROUP BY period HAVING count(DISTINCT stock_code) >= 5)) AND NOT (coalesce(abs(c.ni)>5*lc.mcap,false) OR coalesce(abs(p.ni)>5*lc.mcap,false)))
"""


def season_pairs(v):
    q = quarters(v)
    return FU.yoy_pairs(q, last_caps(v), FU.season_period(q, 5).scalar())


@query("j09_yoy_pairs", YOY_SQL + """SELECT code, round(revenue,4)+0.0 AS revenue, round(op,4)+0.0 AS op, round(CASE WHEN revenue_p>0 THEN revenue/revenue_p-1 END,6)+0.0 AS rev_yoy, round(CASE WHEN op_p>0 THEN op/op_p-1 END,6)+0.0 AS op_yoy,
 CASE WHEN op_p<=0 AND op>0 THEN '흑자전환' WHEN op_p>0 AND op<=0 THEN '적자전환' WHEN op_p<=0 AND op<=0 THEN '적자지속' ELSE '' END AS turn FROM yy""")
def _(v):
    return out(season_pairs(v), "code", "turn", revenue=4, op=4, rev_yoy=6, op_yoy=6)


@query("a23_season_summary", YOY_SQL.replace("LEFT JOIN lc ON", "JOIN lc ON") + """SELECT market, count(*) AS n, round(avg(CASE WHEN op>op_p THEN 1.0 ELSE 0.0 END),6)+0.0 AS up, round(sum(op),3)+0.0 AS op, round(sum(op_p),3)+0.0 AS op_p, round(CASE WHEN sum(op_p)>0 THEN sum(op)/sum(op_p)-1 END,6)+0.0 AS op_sum_yoy
 FROM yy WHERE op IS NOT NULL AND op_p IS NOT NULL GROUP BY ROLLUP (market)""")
def _(v):
    d = season_pairs(v).join(v.bars.where(F.col("date") == v.cal.agg(F.max("date")).scalar()).select("code", "market"), "code")
    return out(FU.season_summary(d, "market"), "market", "n", up=6, op=3, op_p=3, op_sum_yoy=6)


def feature_registry():
    """name -> fn(views) -> (pos, code, value): the extension point for user features."""
    return {f: (lambda v, f=f: feature_grid(v).select("pos", "code", F.col(f).alias("value"))) for f in FEATS}
