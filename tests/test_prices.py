import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quantloom.operators import calendar as K
from quantloom.operators import flows as FL
from quantloom.operators import prices as P
from quantloom.operators import universe as U
from tests.conftest import D, business_days, calendar, near, rows

BAR = "code string, date date, open double, high double, low double, close double, chg double, volume double"


def test_split_with_halt(spark):
    b = spark.createDataFrame([("A", D("2018-05-02"), 2.6e6, 2.7e6, 2.6e6, 2.65e6, 0.0, 10.0), ("A", D("2018-05-03"), 0.0, 0.0, 0.0, 2.65e6, 0.0, 0.0),
                               ("A", D("2018-05-04"), 53000.0, 53900.0, 51800.0, 51900.0, -1100.0, 100.0)], BAR)
    r = rows(P.adjust_prices(b), "date")
    assert near(r[0]["close"], 53000) and r[0]["volume"] == 500 and r[1]["open"] is None
    assert near(r[2]["close"] / r[1]["close"] - 1, 51900 / 53000 - 1)


def test_no_split_and_relisted_code(spark):
    b = spark.createDataFrame([("A", D("2020-01-01"), 1.0, 1.0, 1.0, 1000.0, 0.0, 1.0), ("A", D("2020-01-02"), 1.0, 1.0, 1.0, 1100.0, 100.0, 1.0), ("A", D("2020-01-03"), 1.0, 1.0, 1.0, 990.0, -110.0, 1.0),
                               ("B", D("2015-01-02"), 1.0, 1.0, 1.0, 1000.0, 0.0, 1.0), ("B", D("2020-01-02"), 1.0, 1.0, 1.0, 50.0, 10.0, 1.0)], BAR)
    r = rows(P.adjust_prices(b), "code", "date")
    assert all(x["factor"] == 1.0 for x in r) and r[3]["close"] == 1000


def test_return_does_not_bridge_a_gap(spark):
    days = business_days("2024-01-01", 4)
    cal = calendar(spark, days)
    p = spark.createDataFrame([("A", days[0], 100.0), ("A", days[2], 110.0), ("A", days[3], 121.0)], "code string, date date, close double")
    r = rows(P.returns(K.grid(p, cal, ["close"])), "pos")
    assert [x["ret"] for x in r[:3]] == [None, None, None] and near(r[3]["ret"], 0.1)
    assert [x["traded"] for x in r] == [True, False, True, True]


def _panel(spark, n=120, codes=6, seed=3):
    rng = np.random.default_rng(seed)
    days = business_days("2023-01-02", n)
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, (n, codes)), axis=0))
    vol = rng.integers(100, 1000, (n, codes)).astype(float)
    data = [(f"{j:06d}", d, float(px[i, j]), float(vol[i, j])) for i, d in enumerate(days) for j in range(codes)]
    return days, pd.DataFrame(data, columns=["code", "date", "close", "volume"])


def _features(spark, days, pdf):
    cal = calendar(spark, days)
    g = K.grid(spark.createDataFrame(pdf, "code string, date date, close double, volume double"), cal, ["close", "volume"])
    g = U.dollar_volume(P.price_features(P.returns(g), month=5, year=40, rel=10, trend=12, vol=20))
    g = P.winsorize_expanding(g, "ret")
    g = U.restrict_universe(g, min_names=3)
    return g


def test_future_values_do_not_move_the_past(spark):
    days, pdf = _panel(spark)
    cut = days[80]
    changed = pdf.copy()
    later = changed["date"] > cut
    changed.loc[later, "close"] *= 3
    changed.loc[later, "volume"] *= 50
    cols = ["code", "pos", "mom_12_1", "rev_1m", "trend_120", "low_vol", "tail", "dv", "wins", "in_universe"]
    a = _features(spark, days, pdf).where("pos <= 81").select(*cols)
    b = _features(spark, days, changed).where("pos <= 81").select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_same_day_volume_does_not_enter_liquidity(spark):
    days, pdf = _panel(spark)
    spiked = pdf.copy()
    spiked.loc[spiked["date"] == days[60], "volume"] *= 1000
    a, b = (_features(spark, days, x).where("pos = 61").select("code", "dv", "in_universe") for x in (pdf, spiked))
    assert a.exceptAll(b).count() == 0


def test_features_match_pandas(spark):
    days, pdf = _panel(spark)
    wide = pdf.pivot(index="date", columns="code", values="close")
    ret = wide.pct_change(fill_method=None)
    low = -ret.rolling(20, min_periods=16).std()
    got = _features(spark, days, pdf).where("pos = 100").select("code", "low_vol").collect()
    for r in got:
        assert near(r["low_vol"], low.loc[days[99], r["code"]], 1e-12)


def test_ewm_matches_pandas_with_gaps(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.02, 90)
    x[[0, 10, 11, 40]] = np.nan
    want = pd.Series(x).ewm(alpha=0.06, adjust=False).std(bias=False)
    df = spark.createDataFrame([("A", i + 1, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "code string, pos int, ret double")
    got = rows(P.ewm_std(df, "ret", 0.94), "pos")
    for g, w in zip(got, want):
        assert near(g["ewm"], None if np.isnan(w) else float(w), 1e-10)


def test_threshold_uses_yesterday_only(spark):
    rng = np.random.default_rng(1)
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 100)))
    mk = lambda p: spark.createDataFrame([("A", i + 1, float(v)) for i, v in enumerate(p)], "code string, pos int, close double")
    a = rows(P.move_threshold(mk(px)), "pos")
    px2 = px.copy()
    px2[80:] *= 1.5
    b = rows(P.move_threshold(mk(px2)), "pos")
    assert a[80]["threshold"] == b[80]["threshold"] and b[80]["surge"] and not a[80]["surge"]
    assert all(x["threshold"] is None for x in a[:61]) and a[70]["threshold"] >= 0.025


def test_total_return_is_flat_when_the_drop_equals_the_yield(spark):
    p = spark.createDataFrame([("A", D("2024-12-26"), 100.0), ("A", D("2024-12-27"), 98.0)], "code string, date date, close double")
    y = spark.createDataFrame([("A", D("2024-12-27"), 0.02)], "code string, ex_date date, yield double")
    r = rows(P.total_return_close(p, y), "date")
    assert near(r[1]["tr_close"], 100.0)


def test_streaks_and_sums(spark):
    days = business_days("2024-01-01", 5)
    cal = calendar(spark, days)
    series = {"a": [1, -1, 2, 3, 4], "b": [None, None, 5, -1, -2], "c": [None, None, 1, 2, 0], "d": [None, 1, None, 2, 3]}
    data = [(k, "f", days[i], float(v)) for k, s in series.items() for i, v in enumerate(s) if v is not None]
    f = spark.createDataFrame(data, "code string, who string, date date, net double")
    assert {r["code"]: r["streak"] for r in FL.streaks(f, cal).collect()} == {"a": 3, "b": -2, "c": 0, "d": 2}
    s = {r["code"]: r["sum_1"] for r in FL.window_sums(f, cal, (1, 2)).collect()}
    assert s == {"a": 4.0, "b": -2.0, "c": 0.0, "d": 3.0}


def test_flow_uses_lagged_publication(spark):
    days, pdf = _panel(spark, n=40, codes=2)
    cal = calendar(spark, days)
    bars = spark.createDataFrame(pdf, "code string, date date, close double, volume double").withColumn("value", F.col("close") * F.col("volume"))
    mk = lambda k: spark.createDataFrame([(d, "000000", "frgn", 10.0 if i != 30 else k) for i, d in enumerate(days)], "date date, code string, who string, net double")
    f = lambda k: {r["pos"]: r["norm_frgn"] for r in FL.flow_features(FL.flow_grid(bars, mk(k), cal)).where("code = '000000'").collect()}
    a, b = f(10.0), f(999.0)
    assert a[31] == b[31] and a[32] != b[32]


def test_null_day_has_no_trading_day_and_double_rows_make_no_days(spark):
    days = business_days("2020-01-06", 6)
    cal = calendar(spark, days)
    got = K.next_trading_day(spark.createDataFrame([(None,), (days[2],)], "d date"), "d", cal, strict=False)
    assert {(r["d"], r["trade_date"]) for r in got.collect()} == {(None, None), (days[2], days[2])}
    panel = spark.createDataFrame([("a", days[1], 1.0), ("a", days[1], 2.0), ("a", days[3], 3.0)], "code string, date date, close double")
    assert [r["pos"] for r in rows(K.grid(panel, cal, ["close"]), "pos")] == [2, 3, 4, 5, 6]
    one = spark.createDataFrame([("a", None, 1.0)], "code string, seq int, v double")
    assert [r["v"] for r in P.dedupe_last(one, ["code"], "seq").collect()] == [1.0]


def test_ewm_scan_over_many_blocks_and_long_gaps(spark):
    rng = np.random.default_rng(8)
    for beta in (0.94, 0.5, 0.05):
        x = rng.normal(size=1500) * np.where(np.arange(1500) < 700, 1.0, 1e-4)
        x[rng.random(1500) < 0.1] = np.nan
        x[:5], x[400:900] = np.nan, np.nan
        m = q = s2 = None
        gap, want = 0, []
        for v in x:  # the recursion; pandas itself underflows on the longest gap
            if np.isnan(v):
                gap += 1
            elif m is None:
                m, q, s2, gap = v, v * v, 1.0, 0
            else:
                old = beta ** (gap + 1)
                r, gap = old / (old + 1 - beta), 0
                m, q, s2 = r * m + (1 - r) * v, r * q + (1 - r) * v * v, r * r * s2 + (1 - r) ** 2
            want.append(np.sqrt(max((q - m * m) / (1 - s2), 0.0)) if m is not None and s2 < 1 else np.nan)
        df = spark.createDataFrame([("A", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)] + [("B", 0, 1.0), ("B", 1, None)], "code string, pos int, ret double")
        got = {(r["code"], r["pos"]): r["ewm"] for r in P.ewm_std(df, "ret", beta).collect()}
        assert len(got) == 1502 and got["B", 0] is None and got["B", 1] is None
        assert all(near(got["A", i], None if np.isnan(v) else float(v), 1e-9) for i, v in enumerate(want)), beta
