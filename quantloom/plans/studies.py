"""Queries: study criteria and ledger, program boards with members, channel selection, all quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import rules as R
from quantloom.operators import backtest as B
from quantloom.operators import boards as BD
from quantloom.operators import events as EV
from quantloom.operators import quality as Q
from quantloom.operators import stats as S
from quantloom.operators import textops as TX
from quantloom.plans.events import DOM_RE, FOR_RE, cars
from quantloom.plans.boards import tail_sql
from quantloom.plans.market import UNI_SQL, membership, out
from quantloom.plans.registry import BODIES, nested, query
from quantloom.plans.research import nw_sql, own_returns, phase_tests
from quantloom.session import stored

# ---- study criteria ----
CRITERIA = [
    ("price_features", "t_in", "ge", 0.0, 0.5), ("price_features", "t_out", "ge", 0.0, 0.3),
    ("events", "nw_t", "ge", 0.0, 0.5), ("events", "mean_car", "ge", 0.0, 0.0005),
    ("vol_target", "mdd", "ge", 0.75, 0.0), ("vol_target", "cagr", "ge", 1.0, -0.02),
    ("vol_target_total", "total", "ge", 1.0, 0.0), ("vol_target_total", "excess_t", "ge", 0.0, 0.25),
]
STUDIES = [
    ("price_features", "price features order the returns of the next days", "t_in", "t_out"),
    ("events", "filings move prices after the entry day", "nw_t", "pre_car"),
    ("vol_target", "scaling by volatility cuts drawdowns at a small cost", "mdd", "none"),
    ("vol_target_total", "scaling by volatility earns more", "excess_t", "none"),
    ("paper", "a study without results yet", "cagr", "none"),
]


def measures(v):
    ic = S.study_verdict(phase_tests(v), 0.5, 0.3)
    ic = S.long_measures(ic, "price_features", F.concat_ws(" h", "feature", F.col("h").cast("string")), t_in=F.abs("t_in"), t_out=F.col("t_out") * F.signum("t_in"))
    ev = S.long_measures(EV.calendar_time_t(cars(v)), "events", "event", nw_t=F.abs("nw_t"), mean_car=F.abs("mean_car"), pre_car="pre_car_mean")
    own = own_returns(v).withColumn("ret", F.col("ret") / 200)
    scaled = B.vol_target(own, "1996-01-01", "2000-12-31").select("code", "date", "ret")
    vt = S.portfolio_measures(scaled.join(own.select("code", "date", F.col("ret").alias("base")), ["code", "date"]), "vol_target", "code")
    both = vt.withColumn("study", F.explode(F.array(F.lit("vol_target"), F.lit("vol_target_total"))))
    return stored(ic.unionByName(ev).unionByName(both), "measures")


MEASURES_SQL = nested("a16_study_verdict", "icv") + nested("a11_calendar_time_t", "evv") + """,
vr AS (SELECT code, date, (close/lag(close) OVER (PARTITION BY code ORDER BY date)-1)/200 AS ret FROM bars),
vx AS (SELECT code, date, ret, CASE WHEN count(ret) OVER w >= 20 THEN least(1.0, 0.15::DOUBLE/(stddev_samp(ret) OVER w*sqrt(252))) END AS e FROM vr WHERE ret IS NOT NULL
  WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
vy AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY code ORDER BY date),0) AS w0 FROM vx WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'),
vz AS (SELECT *, w0*ret AS pr, CASE WHEN 1+w0*ret>0 THEN w0*(1+ret)/(1+w0*ret) ELSE w0 END AS wd FROM vy),
vt AS MATERIALIZED (SELECT code, date, ret AS base, (1+pr)*(1-abs(coalesce(e,wd)-wd)*0.0005::DOUBLE)-1 AS ret FROM vz),
v2 AS (SELECT code, date, 'own' AS k, ret AS r FROM vt UNION ALL SELECT code, date, 'base', base FROM vt),
ve AS (SELECT *, product(1+r) OVER (PARTITION BY code, k ORDER BY date) AS eq FROM v2),
vd AS (SELECT *, eq/max(eq) OVER (PARTITION BY code, k ORDER BY date)-1 AS dd FROM ve),
vs AS (SELECT code, k, pow(max_by(eq,date),252.0/count(*))-1 AS cagr, min(dd) AS mdd, max_by(eq,date)-1 AS total FROM vd GROUP BY ALL),
vb AS (SELECT code, o, sum(ex) AS x FROM (SELECT code, (row_number() OVER (PARTITION BY code ORDER BY date)-1)//21 AS o, ret-base AS ex FROM vt) GROUP BY ALL)
"""


MEASURES_SQL += nw_sql("vb", "code", "2", "vn") + """, me AS MATERIALIZED (
SELECT 'price_features' AS study, feature || ' h' || h AS item, unnest(['t_in','t_out']) AS metric, unnest([abs(t_in), t_out*sign(t_in)]) AS value, NULL::DOUBLE AS base FROM icv
UNION ALL SELECT 'events', event, unnest(['nw_t','mean_car','pre_car']), unnest([abs(nw_t), abs(mean_car), pre_car_mean]), NULL FROM evv
UNION ALL SELECT study, a.code, unnest(['cagr','mdd','total']), unnest([a.cagr,a.mdd,a.total]), unnest([b.cagr,b.mdd,b.total]) FROM vs a JOIN vs b USING (code), (VALUES ('vol_target'),('vol_target_total')) t(study) WHERE a.k='own' AND b.k='base'
UNION ALL SELECT study, code, 'excess_t', vn.nw_t, NULL FROM (SELECT DISTINCT code FROM vb) LEFT JOIN vn USING (code), (VALUES ('vol_target'),('vol_target_total')) t(study)),
cr(study, metric, test, share, bar0) AS (VALUES """ + ", ".join(f"('{s}','{m}','{t}',{a}::DOUBLE,{b}::DOUBLE)" for s, m, t, a, b in CRITERIA) + """),
jd AS (SELECT me.study, item, metric, coalesce(value >= CASE WHEN share=0 THEN bar0 ELSE share*base+bar0 END, false) AS met FROM me JOIN cr USING (study, metric)),
cv AS MATERIALIZED (SELECT study, item, count(*) FILTER (met) AS n_met, count(*) FILTER (met)=any_value(need) AS passed FROM jd JOIN (SELECT study, count(*) AS need FROM cr GROUP BY study) USING (study) GROUP BY study, item)
"""


@query("a16_criteria_verdict", MEASURES_SQL + "SELECT study, item, n_met, passed FROM cv")
def _(v):
    return S.criteria_verdict(measures(v), S.criteria_table(v.spark, CRITERIA)).select("study", "item", "n_met", "passed")


@query("a42_studies_ledger", MEASURES_SQL + ", st(study, hypothesis, main, holdout) AS (VALUES " + ", ".join(str(s) for s in STUDIES) + """),
bt AS (SELECT study, arg_max(item, (value, item)) AS item, max(value) AS value FROM me JOIN st USING (study) WHERE metric=main AND value IS NOT NULL GROUP BY study)
SELECT st.study, hypothesis, CASE WHEN bt.item IS NULL THEN 'no result' ELSE 'best ' || bt.item || ' ' || main || ' ' || printf('%.2f', bt.value) END AS metric,
 CASE WHEN EXISTS (SELECT 1 FROM cv WHERE cv.study=st.study AND passed) THEN 'pass' ELSE 'fail' END AS status,
 EXISTS (SELECT 1 FROM me WHERE me.study=st.study AND me.metric=st.holdout AND value IS NOT NULL) AS holdout_used FROM st LEFT JOIN bt USING (study)""")
def _(v):
    m = measures(v)
    studies = v.spark.createDataFrame(STUDIES, "study string, hypothesis string, main string, holdout string")
    return BD.studies_ledger(studies, m, S.criteria_verdict(m, S.criteria_table(v.spark, CRITERIA)))


# ---- program boards ----
PARTS = {"arb_net": "prog_net * (pos % 3 - 1)", "nonarb_net": "prog_net * (2 - pos % 3)", "net": "prog_net"}
PG_SQL = ", pg AS (SELECT market, date, " + ", ".join(f"sum({e}) AS {c}" for c, e in PARTS.items()) + ", row_number() OVER (PARTITION BY market ORDER BY date DESC)-1 AS back FROM extra GROUP BY market, date)"


def program(v):
    return v.extra.select("market", "date", *[F.expr(e).alias(c) for c, e in PARTS.items()])


@query("a30_program_sums", PG_SQL + "SELECT market, max(date) AS date, " + ", ".join(f"round(sum({c}) FILTER (back<{n}),2)+0.0 AS {c}_{n}" for c in PARTS for n in BD.PROGRAM_WINDOWS) + " FROM pg GROUP BY market")
def _(v):
    return out(BD.program_sums(program(v), tuple(PARTS)), "market", "date", **{f"{c}_{n}": 2 for c in PARTS for n in BD.PROGRAM_WINDOWS})


@query("a30_program_cumulative", PG_SQL + "SELECT market, date, round(sum(arb_net) OVER w,2)+0.0 AS cum_arb_net, round(sum(nonarb_net) OVER w,2)+0.0 AS cum_nonarb_net FROM pg WHERE back<250 WINDOW w AS (PARTITION BY market ORDER BY date)")
def _(v):
    return out(BD.program_cumulative(program(v)), "market", "date", cum_arb_net=2, cum_nonarb_net=2)


@query("a30_program_members", nested("a30_program_board", "pb") + UNI_SQL + tail_sql() + """, rr AS (SELECT code, CASE WHEN count(*)>21 THEN max(close) FILTER (back=0)/max(close) FILTER (back=20)-1 END AS r20 FROM tl GROUP BY code)
SELECT code, name, sector, n1, n5, n20, v5, c20, round(r20,6)+0.0 AS r20 FROM pb JOIN listing USING (code) JOIN rr USING (code) WHERE code IN (SELECT code FROM members WHERE snap_date=(SELECT max(snap_date) FROM members))""")
def _(v):
    m = membership(v)
    now = m.where(F.col("snap_date") == m.agg(F.max("snap_date")).scalar())
    return out(BD.program_members(v.extra, v.bars, now, v.listing), "code", "name", "sector", n1=2, n5=2, n20=2, v5=6, c20=8, r20=6)


# ---- channels ----
VIDEO = "CASE event_id % 7 WHEN 0 THEN '미국 주식 이야기' WHEN 1 THEN '코스닥 급등주' WHEN 2 THEN '일상 브이로그' ELSE '코스피 삼성전자 전망' END"
OWNER = "CASE user_id % 11 WHEN 0 THEN '{word} 채널' ELSE '채널' END".format(word=R.EXCLUDE_WORDS[0])
SEL_SQL = f""", vi AS (SELECT user_id AS channel, {VIDEO} AS title, CASE WHEN event_id % 13 <> 0 THEN event_id*37 % 900 END AS seconds FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-28'),
ca AS (SELECT user_id AS channel, count(*) AS subscribers FROM events WHERE user_id % 11 <> 0 AND user_id % 7 <> 0 GROUP BY user_id),
lg AS (SELECT channel, count(*) AS n, avg(CASE WHEN regexp_matches(title,'{DOM_RE}') AND NOT regexp_matches(lower(title),'{FOR_RE}') THEN 1.0 ELSE 0.0 END) AS kr, avg(CASE WHEN regexp_matches(lower(title),'{FOR_RE}') THEN 1.0 ELSE 0.0 END) AS fo FROM vi WHERE seconds > 180 GROUP BY channel),
s0 AS (SELECT ca.channel, subscribers, coalesce(l.listed,0) AS listed, coalesce(lg.n,0) AS n, coalesce(kr,0) AS kr, coalesce(fo,0) AS fo FROM ca LEFT JOIN (SELECT channel, count(*) AS listed FROM vi GROUP BY channel) l USING (channel) LEFT JOIN lg USING (channel)),
s1 AS (SELECT *, CASE WHEN channel % 17 = 3 THEN 'manual_exclude' WHEN listed > 70 THEN 'too_many' WHEN n < 30 THEN 'too_few' WHEN NOT (kr >= 0.5 AND fo < kr) THEN 'off_topic' ELSE 'picked' END AS status FROM s0),
s2 AS (SELECT *, coalesce(count(*) FILTER (status='picked') OVER (ORDER BY subscribers DESC, channel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM s1)
"""


@query("p08_select_channels", SEL_SQL + "SELECT channel, subscribers, listed, n, round(kr,6)+0.0 AS kr, round(fo,6)+0.0 AS fo, CASE WHEN before >= 10 THEN 'not_checked' ELSE status END AS status, CASE WHEN channel % 17 = 3 THEN 'by hand' END AS reason FROM s2")
def _(v):
    e = v.table("events")
    cands = e.groupBy(F.col("user_id").alias("channel")).agg(F.count("*").alias("_n"), F.max(F.expr(OWNER)).alias("name"))
    cands = cands.withColumn("subscribers", F.when(F.col("channel") % 7 != 0, F.col("_n")))
    videos = e.select(F.col("user_id").alias("channel"), F.expr(VIDEO).alias("title"), F.col("ts").alias("published"), F.when(F.col("event_id") % 13 != 0, F.col("event_id") * 37 % 900).alias("seconds"))
    manual = cands.where("channel % 17 = 3").select("channel", F.lit("by hand").alias("reason"))
    span = [F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05", "2024-01-28")]
    d = TX.select_channels(cands, videos, *span, manual, n=10, min_videos=30, max_videos=70, min_share=0.5)
    return out(d, "channel", "subscribers", "listed", "n", "status", "reason", kr=6, fo=6)


# ---- all checks ----
CHECKS = [  # (name, query of the offending rows, severity; None: serious if a row is inside the universe, else warning)
    ("holiday_conflicts", "d04_holiday_conflicts", "critical"), ("price_jumps", "d01_price_jumps", None), ("flow_exceeds_value", "d03_flow_exceeds_value", "serious"),
    ("invalid_cap_days", "d07_invalid_cap_days", "serious"), ("missing_days", "d05_missing_days", "serious"), ("stale_prices", "d06_stale_keys", "warning"),
    ("adjustments", "d02_adjustments", "info"), ("suspect_financials", "d08_suspect_financials", "info"), ("series_gap", "d09_series_gap", "warning"),
    ("high_loan_rate", "d08_high_loan_rate", "warning"), ("delisted", "a36_delisted_guess", "info"),
]
ALL_SQL = "".join(nested(q, f"ck{i}") for i, (_, q, _s) in enumerate(CHECKS)) + ", ck AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS \"check\", CASE WHEN count(*)=0 THEN 'ok' ELSE " + (f"'{s}'" if s else "CASE WHEN bool_or(inside) THEN 'serious' ELSE 'warning' END") + f" END AS severity, count(*) AS n FROM ck{i}"
    for i, (n, _, s) in enumerate(CHECKS)) + ")"


def all_checks(v):
    inside = F.when(F.coalesce(F.bool_or("inside"), F.lit(False)), "serious").otherwise("warning")
    return Q.all_checks((n, BODIES[q](v), s or inside) for n, q, s in CHECKS)


@query("a39_all_checks", ALL_SQL + 'SELECT "check", severity, n FROM ck')
def _(v):
    return all_checks(v)


@query("a39_severity_table", ALL_SQL + "SELECT " + ", ".join(f"count(*) FILTER (severity='{s}') AS {s}" for s in Q.SEVERITIES) + " FROM ck")
def _(v):
    return Q.severity_table(all_checks(v))
