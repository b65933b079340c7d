import random

from pyspark.sql import functions as F

from quantloom.functions import rules as R
from quantloom.operators import boards as BD
from quantloom.operators import quality as Q
from quantloom.operators import stats as S
from quantloom.operators import textops as TX
from tests.conftest import near

MEASURES = "study string, item string, metric string, value double, base double"


def test_criteria_verdict(spark):
    rules = S.criteria_table(spark, [("s", "mdd", "ge", 0.75, 0.0), ("s", "cagr", "ge", 1.0, -0.02), ("c", "cost", "le", 0.0, 0.001), ("none", "cagr", "ge", 0.0, 0.0)])
    data = [("s", "good", "mdd", -0.2, -0.3), ("s", "good", "cagr", 0.05, 0.06), ("s", "deep", "mdd", -0.25, -0.3), ("s", "deep", "cagr", 0.05, 0.06),
            ("s", "half", "mdd", -0.1, -0.3), ("s", "blank", "mdd", -0.1, None), ("s", "blank", "cagr", None, 0.1), ("c", "x", "cost", 0.001, None), ("free", "x", "cost", 9.0, None),
            ("s", "twice", "mdd", -0.2, -0.3), ("s", "twice", "mdd", -0.29, -0.3), ("s", "twice", "cagr", 1.0, 0.0)]
    m = spark.createDataFrame(data, MEASURES)
    got = {(r["study"], r["item"]): (r["n_met"], r["n_criteria"], r["passed"]) for r in S.criteria_verdict(m, rules).collect()}
    assert got == {("s", "good"): (2, 2, True), ("s", "deep"): (1, 2, False), ("s", "half"): (1, 2, False), ("s", "blank"): (0, 2, False), ("c", "x"): (1, 1, True), ("s", "twice"): (1, 2, False)}
    assert S.criteria_verdict(m.limit(0), rules).count() == 0


def test_studies_ledger(spark):
    studies = spark.createDataFrame([("s", "idea", "t", "late"), ("u", "unused", "t", "late")], "study string, hypothesis string, main string, holdout string")
    m = spark.createDataFrame([("s", "a", "t", 1.5, None), ("s", "b", "t", 2.25, None), ("s", "c", "t", None, None), ("s", "a", "late", None, None)], MEASURES)
    v = S.criteria_verdict(m, S.criteria_table(spark, [("s", "t", "ge", 0.0, 2.0)]))
    got = {r["study"]: (r["metric"], r["status"], r["holdout_used"]) for r in BD.studies_ledger(studies, m, v).collect()}
    assert got == {"s": ("best b t 2.25", "pass", False), "u": ("no result", "fail", False)}


def test_portfolio_measures(spark):
    own, base = [0.1, -0.2, 0.05, None, 0.3], [0.0, -0.1, None, 0.2, 0.1]
    df = spark.createDataFrame([("p", i, a, b) for i, (a, b) in enumerate(zip(own, base))], "series string, date int, ret double, base double")
    got = {r["metric"]: (r["value"], r["base"]) for r in S.portfolio_measures(df, "x").collect()}
    assert near(got["total"][0], 1.1 * 0.8 * 1.3 - 1) and near(got["total"][1], 0.9 * 1.1 - 1)
    assert near(got["mdd"][0], -0.2) and near(got["mdd"][1], -0.1) and near(got["cagr"][0], (1.1 * 0.8 * 1.3) ** (252 / 3) - 1)
    assert set(got) == {"cagr", "mdd", "total", "excess_t"} and got["excess_t"][1] is None


def test_program_boards(spark):
    r = random.Random(3)
    data = [(m, c, d, float(r.randint(-9, 9)), float(r.randint(-9, 9))) for m, c in (("K", "a"), ("K", "b"), ("Q", "c")) for d in range(70 if m == "K" else 3)]
    x = spark.createDataFrame(data, "market string, code string, date int, arb_net double, nonarb_net double").withColumn("net", F.col("arb_net") + F.col("nonarb_net"))
    got = {s["market"]: s for s in BD.program_sums(x).collect()}
    for m, end in (("K", 70), ("Q", 3)):
        for n in (1, 5, 20, 60):
            assert got[m][f"net_{n}"] == sum(a + b for k, _, d, a, b in data if k == m and d >= end - n)
    cum = {s["date"]: s["cum_arb_net"] for s in BD.program_cumulative(x, days=10).where("market = 'K'").collect()}
    assert cum == {d: sum(a for k, _, e, a, _ in data if k == "K" and 60 <= e <= d) for d in range(60, 70)}


def test_program_members(spark):
    x = spark.createDataFrame([(c, i, float(i), 10.0, 100.0) for c in ("a", "b", "c") for i in range(30)], "code string, date int, prog_net double, value double, cap double")
    closes = spark.createDataFrame([("a", i, None if i == 29 else 100.0 + i) for i in range(30)] + [("b", i, 50.0) for i in range(21)], "code string, date int, close double")
    listing = spark.createDataFrame([(c, c.upper(), "s") for c in "abc"], "code string, name string, sector string")
    members = spark.createDataFrame([("a",), ("b",), ("b",)], "code string")
    got = {s["code"]: s for s in BD.program_members(x, closes, members, listing).collect()}
    assert set(got) == {"a", "b"} and near(got["a"]["r20"], 128 / 108 - 1) and got["b"]["r20"] is None and got["b"]["n5"] == 27 * 5


def test_select_channels(spark):
    good, bad = "코스피 전망", "일상"
    cands = [(1, "x", 90), (1, "x", 80), (2, R.EXCLUDE_WORDS[0], 85), (3, "x", None), (4, "x", 70), (5, "x", 60), (6, "x", 50), (7, "x", 40), (8, "x", 30), (9, None, 20)]
    videos = [(c, good, 5, 200) for c in (1, 4, 6, 9) for _ in range(3)] + [(5, bad, 5, 200)] * 3 + [(7, good, 5, 180)] * 3 + [(7, good, 50, 999)] * 5 + [(8, good, 5, 200)] * 7 + [(4, good, 5, None)]
    got = TX.select_channels(spark.createDataFrame(cands, "channel int, name string, subscribers int"), spark.createDataFrame(videos, "channel int, title string, published int, seconds int"),
                             F.lit(0), F.lit(10), spark.createDataFrame([(6, "by hand")], "channel int, reason string"), n=3, min_videos=3, max_videos=6)
    status = {r["channel"]: (r["listed"], r["n"], r["status"]) for r in got.collect()}
    assert status == {1: (3, 3, "picked"), 4: (4, 3, "picked"), 5: (3, 3, "off_topic"), 6: (3, 3, "manual_exclude"), 7: (3, 0, "too_few"), 8: (7, 7, "too_many"), 9: (3, 3, "picked")}
    two = TX.select_channels(spark.createDataFrame(cands, "channel int, name string, subscribers int"), spark.createDataFrame(videos, "channel int, title string, published int, seconds int"), F.lit(0), F.lit(10), n=2, min_videos=3, max_videos=6)
    assert {r["channel"]: r["status"] for r in two.collect()} == {1: "picked", 4: "picked", 5: "not_checked", 6: "not_checked", 7: "not_checked", 8: "not_checked", 9: "not_checked"}


def test_all_checks(spark):
    bad = spark.createDataFrame([(1, True), (2, False)], "id int, inside boolean")
    sev = F.when(F.bool_or("inside"), "serious").otherwise("warning")
    found = Q.all_checks([("a", bad, sev), ("b", bad.where("id = 2"), sev), ("c", bad.limit(0), sev), ("d", bad, "info")])
    assert {r["check"]: (r["severity"], r["n"]) for r in found.collect()} == {"a": ("serious", 2), "b": ("warning", 1), "c": ("ok", 0), "d": ("info", 2)}
    assert tuple(Q.severity_table(found).first()) == (0, 1, 1, 1, 1)
