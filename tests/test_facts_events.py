import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from quantloom.functions import rules as R
from quantloom.operators import boards as BD
from quantloom.operators import calendar as K
from quantloom.operators import dividends as DV
from quantloom.operators import events as EV
from quantloom.operators import fundamentals as FU
from quantloom.operators import news as N
from quantloom.operators import quality as Q
from tests.conftest import D, business_days, calendar, near, rows

FIN = "stock_code string, year int, q int, fs string, item string, value double, rcept_dt date"


def ytd(code, year, values, item, fs="CFS", rcept=None):
    return [(code, year + (i // 4), i % 4 + 1, fs, item, float(v), rcept[i] if rcept else D("2026-05-15")) for i, v in enumerate(values)]


def test_valuation_golden_row(spark):
    data = ytd("A", 2025, [10, 25, 45, 70, 12], "revenue") + ytd("A", 2025, [1, 3, 6, 10, 2], "ni") + ytd("A", 2025, [100] * 5, "equity")
    q = FU.quarterly(FU.consolidated_first(spark.createDataFrame(data, FIN)))
    assert [r["revenue"] for r in rows(q, "period")] == [10, 15, 20, 25, 12]
    caps = spark.createDataFrame([("A", 200.0)], "code string, mcap double")
    m = rows(FU.valuation_metrics(q, caps), "code")[0]
    assert m["label"] == "26.1Q" and m["rev_ttm"] == 72 and m["ni_ttm"] == 11
    assert near(m["per"], 200 / 11) and near(m["pbr"], 2) and near(m["rev_yoy"], 0.2)
    bad = rows(FU.valuation_metrics(q, caps.withColumn("mcap", F.lit(1.0))), "code")[0]
    assert bad["suspect"] and bad["per"] is None


def test_consolidated_wins_and_asof_hides_later_reports(spark):
    data = [("A", 2025, 1, "CFS", "ni", 5.0, D("2025-05-15")), ("A", 2025, 1, "OFS", "ni", 3.0, D("2025-05-15")), ("B", 2025, 1, "OFS", "ni", 7.0, D("2025-06-01"))]
    df = spark.createDataFrame(data, FIN)
    assert [r["ni"] for r in rows(FU.consolidated_first(df), "stock_code")] == [5.0, 7.0]
    assert [r["stock_code"] for r in rows(FU.consolidated_first(df, "2025-05-20"), "stock_code")] == ["A"]


def test_reports_count_from_the_day_after_receipt_and_go_stale(spark):
    days = business_days("2025-03-10", 400)
    cal = calendar(spark, days)
    rc = [D("2024-05-14"), D("2024-08-14"), D("2024-11-14"), D("2025-03-14")]
    data = ytd("A", 2024, [10, 20, 30, 40], "ni", rcept=rc) + ytd("A", 2024, [-5] * 4, "equity", rcept=rc)
    known = FU.known_fundamentals(FU.quarterly(FU.consolidated_first(spark.createDataFrame(data, FIN))))
    g = spark.createDataFrame([("A", i + 1, 1000.0) for i in range(400)], "code string, pos int, cap double")
    f = {str(r["date"]): r for r in K.with_date(FU.fundamental_features(FU.step_panels(g, known, cal)), cal).collect()}
    assert f["2025-03-14"]["ep"] is None and near(f["2025-03-17"]["ep"], 0.04) and f["2025-03-17"]["bp"] is None
    last = D("2024-12-31") + dt.timedelta(days=455)
    after = next(d for d in days if d > last)
    assert f[str(after)]["ep"] is None and f[str(max(d for d in days if d <= last))]["ep"] is not None


def test_newer_report_without_ttm_keeps_the_older_value(spark):
    days = business_days("2025-01-01", 30)
    cal = calendar(spark, days)
    known = spark.createDataFrame([("A", 8098, D("2025-01-03"), 40.0, 10.0, 9.0), ("A", 8099, D("2025-01-10"), None, 12.0, None), ("A", 8097, D("2025-01-15"), 99.0, 99.0, 99.0)],
                                  "stock_code string, period int, rcept_dt date, ni_ttm double, equity double, avg_eq double")
    g = spark.createDataFrame([("A", i + 1) for i in range(30)], "code string, pos int")
    r = rows(FU.step_panels(g, known, cal), "pos")[-1]
    assert (r["ni_ttm"], r["equity"], r["avg_eq"]) == (40.0, 12.0, 9.0)


def test_quality_value_rank(spark):
    d = spark.createDataFrame([(1, "a", 0.1, 0.3), (1, "b", 0.5, 0.1), (1, "c", None, 0.2)], "pos int, code string, bp double, roe double")
    assert [r["qv"] for r in rows(FU.rank_average(d, ["bp", "roe"], out="qv", jointly=True), "code")] == [0.75, 0.75, None]


def test_season_pairs_and_market_valuation(spark):
    q = [("A", 8102, 4.0, -1.0, 1.0), ("A", 8106, 8.0, 2.0, 1.0), ("B", 8102, 4.0, 6.0, 1.0), ("B", 8106, 4.0, 3.0, 1.0), ("C", 8106, 1.0, 1.0, 5001.0)]
    df = spark.createDataFrame(q, "stock_code string, period int, revenue double, op double, ni double").withColumn("rcept_dt", F.lit(D("2026-08-14")))
    caps = spark.createDataFrame([("A", 1000.0), ("B", 1000.0), ("C", 1000.0)], "code string, mcap double")
    p = FU.season_period(df, 3).scalar()
    pairs = FU.yoy_pairs(df, caps, p)
    assert [(r["code"], r["rev_yoy"], r["turn"]) for r in rows(pairs, "code")] == [("A", 1.0, "흑자전환"), ("B", 0.0, "")]
    s = rows(FU.season_summary(pairs), "n")[0]
    assert s["n"] == 2 and near(s["up"], 0.5) and near(s["op_sum_yoy"], 0.0)
    facts = spark.createDataFrame([(D("2026-01-02"), "a", "K", 100.0, 10.0, 100.0), (D("2026-01-02"), "b", "K", 100.0, -2.0, 50.0), (D("2026-01-02"), "c", "K", 1.0, 5000.0, 1.0)],
                                  "date date, code string, market string, cap double, ni double, eq double")
    m = rows(FU.market_valuation(FU.caps_with_fundamentals(facts.select("date", "code", "market", "cap"), facts.select("date", "code", "ni", "eq"))), "market")[0]
    assert m["n"] == 2 and near(m["per"], 25) and near(m["pbr"], 200 / 150) and near(m["cover"], 200 / 201)


def test_dividend_known_on_pay_day_and_split_adjusted(spark):
    days = business_days("2024-12-02", 300)
    cal = calendar(spark, days)
    divs = spark.createDataFrame([("A", D("2024-12-31"), 5.0, "x", "2025-04-18"), ("B", D("2024-12-31"), 5000.0, "x", None)], "code string, record_date date, dps double, kind string, pay_date string")
    px = spark.createDataFrame([("A", d, 100.0, 100.0) for d in days] + [("B", d, 2000.0, 100000.0) for d in days], "code string, date date, close double, raw_close double")
    f = {(r["code"], str(r["date"])): r["dy_ttm"] for r in DV.dividend_features(px, divs, cal).collect()}
    assert f["A", "2025-04-17"] == 0 and near(f["A", "2025-04-18"], 0.05)
    assert f["B", "2025-04-29"] == 0 and near(f["B", "2025-04-30"], 0.05)


def test_event_rules(spark):
    cases = {"주요사항보고서(자기주식취득결정)": ("주요사항", "E1_자사주취득"), "[기재정정]주요사항보고서(유상증자결정)": ("정정공시", None), "주요사항보고서 (유상증자결정)": ("주요사항", "E2_유상증자"),
             "단일판매ㆍ공급계약체결(자율공시)": ("수주", "E3_공급계약"), "단일판매ㆍ공급계약해지": ("수주", None), "단일판매ㆍ공급계약체결(자회사의 주요경영사항)": ("수주", None),
             "자기주식처분결정": ("자사주", None), "유상증자결정": ("자금조달", None), "증권발행실적보고서(사채)": ("기타", None), "감사보고서제출": ("감사", None), "사업보고서 (2025.12)": ("정기보고", None), "회사분할결정": ("M&A", None)}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", R.classify_filing("t").alias("c"), R.event_type("t").alias("e"))
    assert {r["t"]: (r["c"], r["e"]) for r in df.collect()} == cases


def test_fund_categories(spark):
    cases = {"KODEX 코스닥150레버리지": "레버리지·인버스", "TIGER 국고채3년": "채권·금리", "KODEX 골드선물(H)": "원자재", "ACE 미국S&P500": "해외 주식", "KODEX 200": "국내 주식"}
    df = spark.createDataFrame([(k, None) for k in cases], "n string, i string").select("n", R.fund_category("n", "i").alias("c"))
    assert {r["n"]: r["c"] for r in df.collect()} == cases


def test_dedupe_matches_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    days = business_days("2024-01-01", 200)
    cal = calendar(spark, days)
    data = [("E", f"{int(rng.integers(0, 4)):06d}", days[int(i)] + dt.timedelta(days=int(rng.integers(0, 2))), f"{n:05d}") for n, i in enumerate(rng.integers(0, 199, 150))]
    pos = lambda d: sum(x < d for x in days)
    want, last = set(), {}
    for e, c, d, no in sorted(data, key=lambda r: (r[2], r[3])):
        if c not in last or pos(d) - last[c] >= 20:
            last[c] = pos(d)
            want.add(no)
    df = spark.createDataFrame(data, "event string, code string, rcept_dt date, rcept_no string")
    assert {r["rcept_no"] for r in EV.dedupe_events(df, cal).collect()} == want


def test_event_window(spark):
    days = business_days("2024-01-01", 30)
    cal = calendar(spark, days)
    fri = next(d for d in days[8:] if d.weekday() == 4)
    i = days.index(fri) + 2
    ret = spark.createDataFrame([("A", p + 1, None if p == 0 else (0.1 if p == i or p == i - 2 else 0.0)) for p in range(30)], "code string, pos int, ret double")
    bench = spark.createDataFrame([(p + 1, 0.0) for p in range(30)], "pos int, bench_ret double")
    ev = spark.createDataFrame([("E", "A", fri, "1"), ("E", "A", days[27], "2"), ("E", "A", days[1], "3")], "event string, code string, rcept_dt date, rcept_no string")
    r = rows(EV.event_window(ev, ret, bench, cal, 3), "rcept_no")
    assert len(r) == 1 and r[0]["entry"] == days[i - 1] and near(r[0]["car"], 0.1) and near(r[0]["pre_car"], 0.1)
    late = EV.event_window(ev, ret.withColumn("ret", F.when(F.col("pos") != i + 2, F.col("ret"))), bench, cal, 3)
    assert late.count() == 0


def test_lexicon_and_cutoff(spark):
    cases = {"목표가 상향": (1, 0), "최대주주 변경": (0, 0), "적자전환 우려": (0, 2), "어닝 쇼크 뒤  반등": (1, 1), "기대 이하": (0, 1), "상승 상승": (2, 0), "상승 출발": (0, 0)}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", R.lexicon_score("t").alias("s")).select("t", "s.*")
    assert {r["t"]: (r["pos"], r["neg"]) for r in df.collect()} == cases
    cal = calendar(spark, [D("2024-01-05"), D("2024-01-08")])
    a = spark.createDataFrame([(t,) for t in ("2024-01-05 15:29:59", "2024-01-05 15:30:00", "2024-01-06 09:00:00", "2024-01-08 16:00:00")], "x string").withColumn("dt", F.col("x").cast("timestamp_ntz"))
    assert [str(r["tday"]) for r in rows(N.assign_trade_date(a, cal), "x")] == ["2024-01-05", "2024-01-08", "2024-01-08", "None"]


def test_news_repeats_count_once_and_the_future_is_out(spark):
    days = business_days("2024-01-01", 12)
    cal = calendar(spark, days)
    mk = lambda extra: spark.createDataFrame([("A", dt.datetime.combine(d, dt.time(9)), t) for d, t in [(days[3], "실적  호조"), (days[3], "실적 호조"), (days[3], "급등 +3.2%"), (days[5], "적자")] + extra], "code string, dt timestamp_ntz, title string")
    t = N.daily_news_table(mk([]), cal)
    assert [(str(r["tday"]), r["n"], r["score_sum"]) for r in rows(t, "tday")] == [(str(days[3]), 1, 1.0), (str(days[5]), 1, -1.0)]
    codes = spark.createDataFrame([("A",), ("B",)], "code string")
    f = lambda a: N.news_features(codes, N.daily_news_table(a, cal), cal, 2, 4).where("pos <= 7")
    assert f(mk([])).exceptAll(f(mk([(days[8], "급락"), (days[9], "상승")]))).count() == 0


def test_titles_are_judged_once_whatever_the_number_of_articles(spark):
    day = business_days("2024-01-01", 3)
    texts = ["실적  호조", "실적 호조", "급등 +3.2%", "적자", None]
    titles = spark.createDataFrame(list(enumerate(texts)), "k long, title string")
    arts = spark.createDataFrame([(i, "AB"[i % 2], dt.datetime.combine(day[i % 3], dt.time(9 + i % 8)), i % 6) for i in range(120)], "id long, code string, dt timestamp_ntz, k long")
    full, cal = arts.join(titles, "k").drop("k"), calendar(spark, day)
    judged = N.judged_titles(titles, ["k"])
    assert judged.count() == 4 and judged.select("t").distinct().count() == 3
    assert rows(N.daily_news_table(arts, cal, titles=titles, keys=["k"]), "code", "tday") == rows(N.daily_news_table(full, cal), "code", "tday")
    tones = lambda d: rows(d.where("k < 4").select("id", "auto", "tone"), "id")
    assert tones(BD.headline_rows(arts, titles, ["k"])) == tones(BD.headline_rows(arts.join(titles, "k")))


def test_quality_checks(spark):
    days = business_days("2024-01-01", 6)
    cal = calendar(spark, days)
    bars = spark.createDataFrame([("A", d, "n", 129.0 if i == 1 else 100.0, 29.0 if i == 1 else 0.0, 1.0) for i, d in enumerate(days[:3])] + [("B", days[0], "n", 300.0, 200.0, 1.0), ("B", days[1], "n", 150.0, 50.0, 1.0)],
                                 "code string, date date, name string, close double, chg double, volume double")
    from quantloom.operators import prices as P

    r = P.base_price_returns(bars)
    uni = spark.createDataFrame([("B",)], "code string")
    i = rows(Q.price_jump_issue(Q.price_jumps(r, uni)), "check")[0]
    assert i["severity"] == "serious" and len(i["items"]) == 1 and "[유니버스]" in i["items"][0]
    assert rows(Q.price_jump_issue(Q.price_jumps(r, uni, 9.0)), "check")[0]["severity"] == "ok"
    s = {x["code"]: (x["last"], x["lag"]) for x in Q.stale_keys(spark.createDataFrame([("A",), ("B",), ("C",)], "code string"), bars, cal, F.lit(days[5]), 3).collect()}
    assert s == {"B": (days[1], 4), "C": (None, None)}
    m = rows(Q.missing_days(cal, spark.createDataFrame([("x", d) for d in days[:4]] + [("y", d) for d in days], "dataset string, date date")), "dataset")
    assert [(x["dataset"], x["n_missing"]) for x in m] == [("x", 2)]


def test_trading_lag_and_states(spark):
    none = spark.createDataFrame([], "date date, is_open boolean")
    closed = spark.createDataFrame([(D("2024-01-02"), False)], "date date, is_open boolean")
    d = spark.createDataFrame([(D("2023-12-29"), D("2024-01-04")), (D("2024-01-03"), D("2024-01-04")), (None, D("2024-01-04"))], "last date, today date")
    assert sorted(str(r["lag"]) for r in K.trading_lag(d, "last", "today", none).collect()) == ["0", "3", "None"]
    assert sorted(str(r["lag"]) for r in K.trading_lag(d, "last", "today", closed).collect()) == ["0", "2", "None"]
    st = [r["s"] for r in spark.createDataFrame([(None,), (1,), (3,), (4,)], "l int").select(Q.lag_state("l", 1, 3).alias("s")).collect()]
    assert st == ["critical", "good", "warning", "serious"]


def test_fund_flow_and_board_rows(spark):
    x = [("A", 1, 100.0, 0.0, 99.5, 1e6), ("A", 2, 98.0, 0.0, 97.5, 1.1e6), ("A", 3, 99.0, 1.0, 98.5, 2.5e6)]
    p = rows(BD.fund_panels(spark.createDataFrame(x, "code string, pos int, close double, chg double, nav double, fund_shares double")), "pos")
    assert p[1]["ret"] == 0 and near(p[1]["flow"], 1e5 * 97.5) and p[0]["flow"] == 0 and p[2]["flow"] == 0 and near(p[2]["ret"], 99 / 98 - 1)
    b = spark.createDataFrame([("A", D("2024-01-02"), 0.0, 9.0, 9.0, 10.0, None)], "code string, date date, open double, high double, low double, close double, volume double")
    r = rows(BD.ohlcv_rows(b), "date")[0]
    assert (r["open"], r["high"], r["low"], r["volume"]) == (10.0, 10.0, 10.0, 0.0)


def test_rule_tables_take_rules_of_the_user(spark):
    titles = ["[기재정정]주요사항보고서", "감자결정", "감사보고서제출", "유상증자 증권발행실적보고서", "유상증자결정", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    got = lambda rules: [r["c"] for r in df.select("i", R.classify_filing("t", rules).alias("c")).orderBy("i").collect()]
    assert got(R.FILING_RULES) == ["정정공시", "기타", "감사", "기타", "자금조달", "기타"]
    assert got((*R.FILING_RULES, (0.5, "contains", ("감자",), ("철회",), "감자"))) == ["정정공시", "감자", "감사", "기타", "자금조달", "기타"]
    assert got(((2, "matches", ("^감.+결정$",), (), "b"), (1, "equals", ("감자결정",), (), "a"))) == ["기타", "a", "기타", "기타", "기타", "기타"]
    import duckdb

    sql = R.rules_sql("t", R.FILING_RULES, "기타")
    for t in titles[:-1]:
        assert duckdb.execute(f"SELECT {sql} FROM (SELECT ? AS t)", [t]).fetchone()[0] == got(R.FILING_RULES)[titles.index(t)]
