import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quantloom.operators import backtest as B
from quantloom.operators import calendar as K
from quantloom.operators import universe as U
from tests.conftest import D, business_days, calendar, near, rows


def test_members_asof(spark):
    m = spark.createDataFrame([(D("2024-01-01"), "A"), (D("2024-02-01"), "A"), (D("2024-02-01"), "B")], "snap_date date, code string")
    days = spark.createDataFrame([(D(x),) for x in ("2023-12-31", "2024-01-31", "2024-02-01")], "date date")
    got = {(str(r["date"]), r["code"]) for r in U.members_asof(days, m).collect()}
    assert got == {("2024-01-31", "A"), ("2024-02-01", "A"), ("2024-02-01", "B")}


def test_buffer_matches_month_by_month_selection(spark):
    rng = np.random.default_rng(5)
    top, buffer, months = 6, 9, [D(f"2020-{m:02d}-01") for m in range(1, 13)]
    caps = {m: {f"{i:05d}0": float(v) for i, v in enumerate(rng.random(20) + np.arange(20) / 15)} for m in months}
    prev, want = set(), set()
    for m in months:
        order = sorted(caps[m], key=lambda c: (-caps[m][c], c))
        stay = [c for c in order[:buffer] if c in prev][:top]
        prev = set(stay + [c for c in order if c not in stay][: top - len(stay)])
        want |= {(m, c) for c in prev}
    df = spark.createDataFrame([(m, c, v) for m, s in caps.items() for c, v in s.items()], "snap_date date, code string, cap double")
    assert {(r["snap_date"], r["code"]) for r in U.buffered_universe(df, top, buffer).collect()} == want


def test_caps_strictly_before_the_month(spark):
    days = [D("2024-01-30"), D("2024-01-31"), D("2024-02-01")]
    caps = spark.createDataFrame([(d, "A", float(i)) for i, d in enumerate(days)], "date date, code string, cap double")
    snaps = spark.createDataFrame([(D("2024-02-01"),)], "snap_date date")
    assert rows(U.caps_before(caps, snaps, calendar(spark, days)), "code")[0]["cap"] == 1.0


def test_common_stock_by_code_and_every_name_pattern(spark):
    bad_names = [f"가나 {part} 1호" for part in ("리츠", "REIT", "인프라", "스팩", "기업인수목적", "투자회사", "선박투자", "유전")]
    rows_ = [(f"{i:05d}0", name) for i, name in enumerate(bad_names)] + [("123450", "가나다산업"), ("123455", "가나다산업우"), ("12345", "짧음"), ("1234560", "긺"), ("222220", None), (None, "x")]
    df = spark.createDataFrame(rows_, "code string, name string")
    assert sorted(r["code"] for r in df.where(U.is_common_stock("code", "name")).collect()) == ["123450", "222220"]


def test_only_common_shares_are_ranked(spark):
    caps = spark.createDataFrame([(D("2024-01-01"), c, n, v) for c, n, v in (("000015", "우선", 9.0), ("000020", "스팩 2호", 8.0), ("000030", "가", 7.0), ("000040", "나", 6.0), ("000050", "다", 5.0))],
                                 "snap_date date, code string, name string, cap double")
    assert sorted(r["code"] for r in U.common_universe(caps, 2, 2).collect()) == ["000030", "000040"]
    assert sorted(r["code"] for r in U.buffered_universe(caps, 2, 2).collect()) == ["000015", "000020"]


def test_labels_ignore_non_members(spark):
    days = business_days("2024-01-01", 2)
    data = [(c, p + 1, v[p], c != "C") for c, v in {"A": (100.0, 110.0), "B": (100.0, 105.0), "C": (100.0, 1000.0)}.items() for p in range(2)]
    g = spark.createDataFrame(data, "code string, pos int, close double, in_universe boolean")
    r = {x["code"]: x["label"] for x in U.attach_labels(g, 1).where("pos = 1").collect()}
    assert r == {"A": 1.0, "B": 0.5, "C": None} and len(days) == 2


# ---- backtest: closed form against a day-by-day restatement ----

def simulate(px, score, ok, size, a, b, every, frac, delay, cost, by_size):
    n, k = px.shape
    weights, out = {}, []
    targets = {}
    for i in range(a, b + 1, every):
        j = i + delay
        if j <= b:
            cand = sorted([c for c in range(k) if ok[i, c] and not np.isnan(score[i, c])], key=lambda c: (-score[i, c], c))
            pick = cand[: max(1, math.ceil(len(cand) * frac))] if cand else []
            w = {c: 1 / len(pick) for c in pick}
            if by_size and pick:
                s = {c: size[i, c] for c in pick if size[i, c] > 0}
                if s:
                    w = {c: v / sum(s.values()) for c, v in s.items()}
            targets[j] = w
    for i in range(a, b + 1):
        r = {c: (px[i, c] / px[i - 1, c] - 1) if i and not np.isnan(px[i, c]) and not np.isnan(px[i - 1, c]) else 0.0 for c in weights}
        gross = sum(w * r[c] for c, w in weights.items())
        weights = {c: w * (1 + r[c]) / (1 + gross) for c, w in weights.items()}
        c_, turn = 0.0, 0.0
        if i in targets:
            keys = set(weights) | set(targets[i])
            d = [targets[i].get(c, 0) - weights.get(c, 0) for c in keys]
            buys, sells = sum(x for x in d if x > 0), -sum(x for x in d if x < 0)
            c_, turn = buys * cost[0] + sells * cost[1], (buys + sells) / 2
            weights = dict(targets[i])
        out.append((gross, c_, turn, sum(w > 0 for w in weights.values())))
    return out


def _case(spark, seed, by_size, frac):
    rng = np.random.default_rng(seed)
    n, k = 70, 8
    days = business_days("2022-01-03", n)
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, (n, k)), axis=0))
    px[45:, 2] = np.nan
    px[20:23, 3] = np.nan
    score = np.round(rng.normal(size=(n, k)), 1)
    score[rng.random((n, k)) < 0.1] = np.nan
    ok = rng.random((n, k)) < 0.8
    size = rng.random((n, k)) * 10
    f = lambda x: None if np.isnan(x) else float(x)
    data = [(i + 1, f"{c:06d}", f(px[i, c]), f(score[i, c]), bool(ok[i, c]), float(size[i, c])) for i in range(n) for c in range(k)]
    grid = spark.createDataFrame(data, "pos int, code string, close double, score double, ok boolean, size double")
    got = rows(B.backtest(grid, calendar(spark, days), days[5], days[64], every=7, top_frac=frac, delay=1, by_size=by_size), "pos")
    want = simulate(px, score, ok, size, 5, 64, 7, frac, 1, B.STOCK_COST, by_size)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert near(g["gross"], w[0], 1e-10) and near(g["cost"], w[1], 1e-10) and near(g["turnover"], w[2], 1e-10) and g["n_hold"] == w[3]


def test_backtest_equal_weights(spark):
    _case(spark, 1, False, 0.3)


def test_backtest_size_weights(spark):
    _case(spark, 2, True, 0.5)


def test_backtest_all_names(spark):
    _case(spark, 3, False, 1.0)


def test_pick_without_a_size_stays_with_an_open_weight(spark):
    c = spark.createDataFrame([(1, "A", 3.0, True, 6.0), (1, "B", 2.0, True, None), (1, "C", 1.0, True, 2.0), (2, "A", 1.0, True, None)],
                              "pos int, code string, score double, ok boolean, size double")
    got = [tuple(r) for r in B.target_weights(c, 1.0, True).orderBy("pos", "code").collect()]
    assert got == [(1, "A", 0.75), (1, "B", None), (1, "C", 0.25), (2, "A", 1.0)]


def test_eligible_needs_history(spark):
    g = spark.createDataFrame([("A", i + 1, 100.0 if i >= 200 else None, True) for i in range(300)], "code string, pos int, close double, in_universe boolean")
    assert U.eligible(g, min_days=252).where("ok").count() == 0
    assert U.eligible(g, min_days=100).where("ok").count() == 1


def test_vol_target_matches_loop(spark):
    rng = np.random.default_rng(4)
    days = business_days("2022-01-03", 60)
    r = rng.normal(0, 0.02, 60)
    df = spark.createDataFrame([("A", d, float(x)) for d, x in zip(days, r)], "code string, date date, ret double")
    got = rows(B.vol_target(df, days[10], days[-1], window=20), "date")
    sd = pd.Series(r).rolling(20).std() * math.sqrt(252)
    e = (0.15 / sd).clip(upper=1).shift(1)
    w = 0.0
    for i, g in zip(range(10, 60), got):
        pr = w * r[i]
        drift = w * (1 + r[i]) / (1 + pr)
        tgt = drift if np.isnan(e[i]) else e[i]
        c = abs(tgt - drift) * 0.0005
        assert near(g["ret"], (1 + pr) * (1 - c) - 1, 1e-12) and near(g["exposure"], tgt, 1e-12)
        w = tgt


def test_paper_nav_months(spark):
    days = [D("2024-01-10"), D("2024-01-31"), D("2024-02-01"), D("2024-02-29")]
    px = {"A": (100.0, 200.0, 200.0, 400.0), "B": (100.0, 100.0, 100.0, 100.0)}
    closes = spark.createDataFrame([(c, d, v) for c, s in px.items() for d, v in zip(days, s)], "code string, date date, close double")
    defs = spark.createDataFrame([("p", c, 1.0, D("2024-01-01"), 0.0, 0.0) for c in px], "name string, code string, weight double, start date, buy double, sell double")
    r = rows(B.paper_nav(defs, closes), "date")
    assert [round(x["nav"], 9) for x in r] == [1.0, 1.5, 1.5, 2.25]
    cost = rows(B.paper_nav(defs.withColumn("buy", F.lit(0.001)), closes), "date")
    assert near(cost[0]["nav"], 0.999) and near(cost[0]["cost"], 0.001)


def test_gate_counts_complete_months(spark):
    days = [d for d in business_days("2024-01-01", 165)]
    nav = spark.createDataFrame([("p", d, 0.01 if i % 5 else -0.005) for i, d in enumerate(days)], "name string, date date, ret double")
    bench = spark.createDataFrame([("p", d, 0.0) for d in days], "name string, date date, bench_ret double")
    g = rows(B.promotion_gate(nav, bench), "name")[0]
    assert g["months_complete"] == len({(d.year, d.month) for d in days}) - 1 and g["passed"]


def test_next_trading_day_and_ex_dates(spark):
    days = [D(x) for x in ("2024-12-24", "2024-12-26", "2024-12-27", "2024-12-30", "2025-01-02")]
    cal = calendar(spark, days)
    f = spark.createDataFrame([(D("2024-12-25"),), (D("2024-12-27"),), (D("2025-01-02"),), (D("2020-01-01"),)], "d date")
    r = rows(K.next_trading_day(K.next_trading_day(f, "d", cal, False, "ge"), "d", cal, True, "gt"), "d")
    assert [(str(x["ge"]), str(x["gt"])) for x in r] == [("2024-12-24", "2024-12-24"), ("2024-12-26", "2024-12-26"), ("2024-12-27", "2024-12-30"), ("2025-01-02", "None")]
    e = rows(K.ex_dates(spark.createDataFrame([("A", D("2024-12-31")), ("A", D("2024-12-24"))], "code string, record_date date"), cal), "record_date")
    assert e[0]["ex_date"] is None and str(e[1]["cum_date"]) == "2024-12-26" and str(e[1]["ex_date"]) == "2024-12-27"


def test_option_expiry(spark):
    months = spark.createDataFrame([(D("2026-10-01"),), (D("2026-12-01"),)], "month date")
    none = spark.createDataFrame([], "date date, is_open boolean")
    closed = spark.createDataFrame([(D("2026-12-10"), False)], "date date, is_open boolean")
    assert [str(r["expiry"]) for r in rows(K.option_expiry(months, none), "month")] == ["2026-10-08", "2026-12-10"]
    assert str(rows(K.option_expiry(months, closed), "month")[1]["expiry"]) == "2026-12-09"
    n = rows(K.next_expiries(spark.createDataFrame([(D("2026-10-09"),)], "today date"), none), "today")[0]
    assert str(n["monthly"]) == "2026-11-12" and str(n["quarterly"]) == "2026-12-10"
