import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quantloom.functions import cols as C
from quantloom.operators import ranks
from quantloom.operators import stats as S
from tests.conftest import near, rows


def test_normal_functions(spark):
    zs = [-8.0, -4.5, -2.0, -0.66, -0.3, 0.0, 0.1, 0.5, 1.0, 2.5, 5.0, 6.5]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", C.norm_cdf("z").alias("p")).collect()
    for r in got:
        assert near(r["p"], NormalDist().cdf(r["z"]), 1e-13)
    ps = [1e-12, 1e-5, 0.02, 0.2, 0.5, 0.8, 0.975, 0.9999]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", C.norm_ppf("p").alias("z")).collect():
        assert near(r["z"], NormalDist().inv_cdf(r["p"]), 1e-12)


def nw(x, lags):
    x = np.asarray(x)
    n = len(x)
    if n < 3:
        return None
    e = x - x.mean()
    L = min(lags, n - 1)
    var = sum((1 if k == 0 else 2 * (1 - k / (L + 1))) * float(e[k:] @ e[: n - k]) for k in range(L + 1)) / n
    return None if var <= 0 else x.mean() / math.sqrt(var / n)


def test_newey_west(spark):
    rng = np.random.default_rng(0)
    series = {"a": (rng.normal(0.1, 1, 200), 10), "b": (np.convolve(rng.normal(size=90), np.ones(5), "valid"), 40), "c": (rng.normal(size=4), 9), "d": (np.array([1.0, 2.0]), 2)}
    data = [(k, i, float(v), lag) for k, (xs, lag) in series.items() for i, v in enumerate(xs)]
    df = spark.createDataFrame(data + [("a", 500, None, 10)], "k string, i int, x double, lag int")
    got = {r["k"]: r for r in S.nw_tstat(df, ["k", "lag"], "i", "x", F.col("lag")).collect()}
    for k, (xs, lag) in series.items():
        w = nw(xs, lag)
        assert got[k]["n"] == len(xs) and near(got[k]["nw_t"], None if w is None else float(w), 1e-9)


def test_rank_equals_pandas_with_a_value_that_a_third_shares(spark):
    rng = np.random.default_rng(2)
    vals = np.concatenate([np.zeros(150), [-0.0] * 5, rng.normal(size=200), rng.normal(size=100) * 1e6, [1e-300, -1e-300, 1000.0, 999.9999]])
    other = np.where(rng.random(len(vals)) < 0.2, np.nan, rng.integers(0, 9, len(vals)))
    data = [(int(i % 3), f"{i:06d}", float(v), None if np.isnan(o) else float(o)) for i, (v, o) in enumerate(zip(vals, other))] + [(0, "nul", None, 1.0)]
    df = spark.createDataFrame(data, "g int, code string, v double, o double").repartition(5)
    pdf = pd.DataFrame(data, columns=["g", "code", "v", "o"])
    for pct in (False, True):
        for desc in (False, True):
            got = {r["code"]: (r["rv"], r["ro"]) for r in ranks.average_ranks(df, ["g"], {"v": "rv", "o": "ro"}, pct, desc).collect()}
            want = pdf.groupby("g")[["v", "o"]].rank(pct=pct, ascending=not desc)
            assert len(got) == len(data)
            for code, v, o in zip(pdf["code"], want["v"], want["o"]):
                assert near(got[code][0], None if np.isnan(v) else float(v)) and near(got[code][1], None if np.isnan(o) else float(o))


def test_rank_buckets_stay_small(spark):
    df = spark.range(20000).selectExpr("1 as g", "case when id % 3 = 0 then 7.0D else 1 + id * 1e-9D end as v")
    table = ranks.rank_table(df, ["g"], ["v"])
    assert table.count() == 13334 and table.agg(F.sum("_cnt")).first()[0] == 20000
    got = table.orderBy("_v").select("_above").collect()
    assert [r[0] for r in got] == list(range(13333)) + [13333]


def test_rank_histogram_is_made_once(spark):
    df = spark.range(500).selectExpr("id % 3 as g", "cast(id % 40 as double) as v")
    plan = ranks.rank_table(df, ["g"], ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "Relation" in plan  # both branches read the stored counts


def test_short_median_equals_the_percentile(spark):
    rng = np.random.default_rng(5)
    data = [("AB"[i % 2], i, None if rng.random() < 0.3 else float(x)) for i, x in enumerate(np.round(rng.normal(size=200), 1))]
    w = C.by_code()
    d = C.rolled_median(spark.createDataFrame(data, "code string, pos int, v double"), "v", 6, w, "m", 3, shift=1)
    got = d.withColumn("p", C.rolled(C.median, "v", 6, w, 3, shift=1)).collect()
    assert len(got) == 200 and all(r["m"] == r["p"] for r in got) and sum(r["m"] is None for r in got) > 2


def test_ordinal_breaks_ties_by_the_whole_string(spark):
    rng = np.random.default_rng(7)
    data = [(int(i % 2), f"{'same-start-' if i % 5 else 'é'}{i * 37 % 1000:06d}", float(v)) for i, v in enumerate(np.round(rng.normal(size=300), 1))]
    data += [(0, f"x{i:07d}", 0.5) for i in range(150)]
    got = {r["code"]: r["r"] for r in ranks.ordinal(spark.createDataFrame(data, "g int, code string, v double").repartition(4), ["g"], "v", "code", "r").collect()}
    for g in (0, 1):
        order = sorted((r for r in data if r[0] == g), key=lambda r: (-r[2], r[1].encode()))
        assert [got[c] for _, c, _ in order] == list(range(1, len(order) + 1))


def test_group_total_keeps_all_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, 3.0), (None, 4.0)], "g int, x double")
    got = sorted((r["g"] or 0, r["x"] or 0.0, r["t"]) for r in ranks.group_total(df, ["g"], F.col("x"), "t").collect())
    assert got == [(0, 4.0, None), (1, 0.0, 2.0), (1, 2.0, 2.0), (2, 3.0, 3.0)]


def test_ic_matches_spearman(spark):
    rng = np.random.default_rng(3)
    f, t = rng.normal(size=(4, 30)), rng.normal(size=(4, 30))
    f[0, :27] = np.nan
    f[1, :] = 1.0
    data = [(p, None if np.isnan(f[p, c]) else float(f[p, c]), float(t[p, c])) for p in range(4) for c in range(30)]
    got = {r["pos"]: r["ic"] for r in S.cross_sectional_ic(spark.createDataFrame(data, "pos int, f double, t double"), "f", "t", 5).collect()}
    assert set(got) == {2, 3}
    for p in (2, 3):
        assert near(got[p], float(pd.Series(f[p]).rank().corr(pd.Series(t[p]).rank())), 1e-12)


def test_residuals_match_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(x)], "pos int, i int, y double, a double, b double, c double")
    rk = pd.DataFrame(x).rank().to_numpy()
    for ctrls in (["a"], ["a", "b"], ["a", "b", "c"]):
        X = np.column_stack([np.ones(60), rk[:, 1:1 + len(ctrls)]])
        want = rk[:, 0] - X @ np.linalg.lstsq(X, rk[:, 0], rcond=None)[0]
        got = {r["i"]: r["resid"] for r in S.residual_rank(df, "y", ctrls, 30).collect()}
        assert all(near(got[i], float(w), 1e-8) for i, w in enumerate(want))


def test_bootstrap_block_of_full_length_is_the_mean(spark):
    xs = np.random.default_rng(5).normal(size=40)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(xs)], "k string, i int, x double")
    full = S.block_bootstrap_means(df, ["k"], "i", "x", 40, n_boot=20).collect()
    assert len(full) == 20 and all(near(r["mean"], float(xs.mean()), 1e-9) for r in full)
    some = [r["mean"] for r in S.block_bootstrap_means(df, ["k"], "i", "x", 5, n_boot=400).collect()]
    assert abs(np.mean(some) - xs.mean()) < 0.05 and 0.3 < np.std(some) / (xs.std() / math.sqrt(40)) < 2


def test_bootstrap_look_ups_stay_with_their_series(spark):
    df = spark.range(40).selectExpr("id % 4 as k", "cast(id as int) as i", "cast(id as double) as x")
    plan = S.block_bootstrap_means(df, ["k"], "i", "x", 5, n_boot=6)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_bootstrap_equals_resampled_series(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=37), "b": rng.normal(size=3), "c": np.array([2.0])}
    rows_ = [(k, i, float(v)) for k, xs in data.items() for i, v in enumerate(xs)] + [("a", 99, None), ("d", 0, None)]
    got = {(r["k"], r["boot"]): r["mean"] for r in S.block_bootstrap_means(spark.createDataFrame(rows_, "k string, i int, x double"), ["k"], "i", "x", 5, n_boot=30, seed=4).collect()}
    assert len(got) == 90
    for (k, boot), mean in got.items():
        xs, sample = data[k], []
        for b in range(-(-len(xs) // 5)):
            x = (4 * 1000003 + 12345 + boot * 7919 + b * 104729) % S.PRIME * 48271 % S.PRIME
            s = (x * x % S.PRIME * 69621 + boot) % S.PRIME % len(xs)
            sample += [xs[(s + j) % len(xs)] for j in range(5)]
        assert near(mean, float(np.mean(sample[: len(xs)])), 1e-9)


def test_overfitting_statistics(spark):
    xs = np.random.default_rng(6).normal(0.05, 1, 500)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(xs)], "series string, i int, ret double")
    m = S.moments(df).collect()[0]
    assert near(S.psr(df, m["sr"]).collect()[0]["psr"], 0.5, 1e-9)
    assert near(m["skew"], float(pd.Series(xs).skew()), 1e-9) and near(m["kurt"], float(pd.Series(xs).kurt()) + 3, 1e-9)
    bar = spark.range(1).select(S.expected_max_sharpe(F.lit(1000), F.lit(1.0)).alias("b"), S.bonferroni_t(F.lit(22)).alias("t")).collect()[0]
    assert abs(bar["b"] - 3.25) < 0.03 and abs(bar["t"] - 3.06) < 0.01
    few = spark.createDataFrame([(0.01 * i,) for i in range(5)], "sr double")
    many = spark.createDataFrame([(0.01 * (i % 5),) for i in range(200)], "sr double")
    a, b = (S.dsr(df, t).collect()[0]["dsr"] for t in (few, many))
    assert a > b and near(S.dsr(df, few.limit(1)).collect()[0]["dsr"], S.psr(df).collect()[0]["psr"])


def test_perf_stats(spark):
    r = [0.1, -0.2, 0.05]
    g = S.perf_stats(spark.createDataFrame([("a", i, v) for i, v in enumerate(r)], "series string, date int, ret double")).collect()[0]
    assert near(g["total"], 1.1 * 0.8 * 1.05 - 1) and near(g["mdd"], -0.2) and g["n"] == 3


def test_excess_test_keeps_the_partial_block(spark):
    df = spark.createDataFrame([("a", i, 0.01, 0.0) for i in range(50)], "series string, date int, ret double, base double")
    g = S.excess_test(df).collect()[0]
    assert g["months"] == 3 and near(g["excess_ann"], (0.21 + 0.21 + 0.08) / 3 * 12)


def test_iso_duration_and_labels(spark):
    df = spark.createDataFrame([("PT1H2M3S",), ("PT45S",), ("P1DT1S",), ("x",), (None,)], "d string")
    assert [r["s"] for r in df.select(C.iso_seconds("d").alias("s")).collect()] == [3723, 45, 86401, None, None]
    assert rows(spark.createDataFrame([(8105,)], "p int").select(C.quarter_label("p").alias("l"), C.quarter_end("p").cast("string").alias("e")), "l") == [{"l": "26.1Q", "e": "2026-03-31"}]
