import glob
import itertools
import json
import re
import tempfile
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import text as T
from quantloom.operators import prices as P
from quantloom.operators import textops as TX
from quantloom.sources import landing as L
from quantloom.sources import sinks
from quantloom.streaming import jobs as J
from quantloom.streaming import store as ST
from tests.conftest import SF, D, business_days, calendar, near, rows


def work():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_snapshot_csv_to_bars_with_pruning(spark):
    path = work()
    head = ",".join(L.SNAPSHOT_SCHEMA.names)
    for day, px in (("20240102", '"1,234"'), ("20240103", "-")):
        with open(f"{path}/{day}.csv", "w", encoding="utf-8") as f:
            f.write(f"{head}\n{day},5930,전자,KOSPI,0,1,1,{px},10,,5,\"2,000\",100\n")
    t = rows(L.tidy_bars(L.scan_snapshots(spark, path, "20240101", "20240131")), "date")
    assert t[0]["close"] == 1234.0 and t[0]["code"] == "005930" and t[0]["cap"] == 2000.0 and t[0]["chg"] is None and t[1]["close"] is None
    out = work() + "/t"
    L.land_snapshots(L.scan_snapshots(spark, path), out)
    df = L.scan_snapshots(spark, out, "20240103", None, L.PARTITIONED_SCHEMA, "parquet")
    assert df.count() == 1 and "PartitionFilters: [isnotnull(ds_day" in df._jdf.queryExecution().toString()


def test_flow_padding_and_units(spark):
    r = [("A", "20240102", "100", "1,000", "2", "-3", "4", 1), ("A", "20240102", "100", "9", "9", "9", "9", 2), ("A", "20240103", "", "0", "0", "0", "0", 1)]
    df = spark.createDataFrame(r, "code string, stck_bsop_date string, stck_clpr string, orgn_ntby_tr_pbmn string, etc_corp_ntby_tr_pbmn string, prsn_ntby_tr_pbmn string, frgn_ntby_tr_pbmn string, seq int")
    got = rows(L.ingest_flows(df), "date")
    assert len(got) == 1 and got[0]["inst"] == 1e9 and got[0]["indiv"] == -3e6


def test_upsert_restart_and_reload(spark):
    old = spark.createDataFrame([("A", D("2024-01-02"), 1.0, 1), ("A", D("2024-01-03"), 2.0, 1)], "code string, date date, close double, ingest_seq int")
    new = spark.createDataFrame([("A", D("2024-01-03"), 2.5, 2), ("A", D("2024-01-04"), 3.0, 2)], "code string, date date, close double, ingest_seq int")
    assert [r["close"] for r in rows(L.upsert_latest(old, new, ["code", "date"]), "date")] == [1.0, 2.5, 3.0]
    assert L.adjustment_changed(old, new).collect()[0]["changed"]
    keys = spark.createDataFrame([("A",), ("B",)], "code string")
    assert [str(r["start"]) for r in rows(L.incremental_start(keys, old, "2015-01-01"), "code")] == ["2023-12-29", "2015-01-01"]
    news = spark.createDataFrame([("A", "2026-09-01 14:15:00")], "code string, x string").withColumn("dt", F.col("x").cast("timestamp_ntz"))
    assert str(rows(L.incremental_start(keys, news, "2025-10-01", "6 hours", date="dt"), "code")[0]["start"]) == "2026-09-01 08:15:00"


def test_foreign_priority_and_limits(spark):
    df = spark.createDataFrame([("A", D("2024-01-31"), 50.0, "M", 2), ("A", D("2024-01-31"), 53.27, "D", 1), ("A", D("2024-02-29"), 40.0, "M", 1), ("A", D("2024-02-29"), 41.0, "M", 2)], "code string, date date, ehrt double, freq string, seq int")
    m = L.merge_by_priority(df)
    assert [r["ehrt"] for r in rows(m, "date")] == [53.27, 41.0]
    lim = spark.createDataFrame([("A", 50.0)], "code string, limit double")
    assert rows(L.exhaustion_to_ownership(m, lim), "date")[0]["ratio"] == 26.635
    v = spark.createDataFrame([(20.0, 100.0, 40.0), (99.9, 100.0, 100.0), (1.0, 0.0, 5.0), (1.0, 10.0, 0.0)], "h double, l double, e double").select(L.foreign_limit("h", "l", "e").alias("x"))
    assert [r["x"] for r in v.collect()] == [50.0, 100.0, None, None]


def test_priority_takes_any_frequency_without_sorting_the_rows(spark):
    day = [D(f"2024-01-0{i}") for i in range(1, 5)]
    data = [("A", day[0], 1.0, "X", 9), ("A", day[0], 2.0, "W", 1), ("A", day[1], 3.0, "X", 1), ("A", day[1], 4.0, "Y", 2), ("A", day[2], None, "D", 2), ("A", day[2], 5.0, "D", 1), ("A", day[2], 6.0, "M", 7)]
    df = spark.createDataFrame(data, "code string, date date, ehrt double, freq string, seq int")
    assert [(r["ehrt"], r["freq"]) for r in rows(L.merge_by_priority(df), "date")] == [(2.0, "W"), (4.0, "Y"), (None, "D")]
    listed = L.merge_by_priority(df.withColumn("freq", F.lit("W")))
    assert "SortAggregate" not in listed._jdf.queryExecution().executedPlan().toString()


def test_vendor_rows_are_landed_once(spark):
    import __spark_entry__ as E

    plan = E.queries()["s09_ingest_flows"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "l_suppkey" not in plan  # both branches read stored rows


def test_first_flow_row_of_a_day_stays_whole_and_is_found_by_hash(spark):
    cols = "code string, stck_bsop_date string, orgn_ntby_tr_pbmn string, etc_corp_ntby_tr_pbmn string, prsn_ntby_tr_pbmn string, frgn_ntby_tr_pbmn string, seq int"
    data = [("A", "20240102", "1", "2", "-", "4", 2), ("A", "20240102", "9", "9", "9", "9", 3), ("A", "20240102", "8", "8", "8", "8", None), ("B", "20240102", "5", "-", "5", "5", None)]
    got = L.ingest_flows(spark.createDataFrame(data, cols))
    assert [(r["code"], r["inst"], r["corp"], r["indiv"], r["frgn"]) for r in rows(got, "code")] == [("A", 1e6, 2e6, None, 4e6), ("B", 5e6, None, 5e6, 5e6)]
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_financial_items(spark):
    cols = "bsns_year string, reprt_code string, corp_code string, stock_code string, rcept_no string, fs_div string, sj_div string, account_nm string, thstrm_amount string, thstrm_add_amount string, seq int"
    base = ("2025", "11012", "C", "5930", "20250814000001", "CFS")
    r = [(*base, "IS", "매출액", "171", "305", 1), (*base, "IS", "당기순이익(손실)", "4", "9", 2), (*base, "IS", "당기순이익", "1", "2", 3), (*base, "BS", "자본총계", "1,000", "", 4), (*base, "IS", "기타", "1", "1", 5)]
    got = {x["item"]: x for x in rows(L.ingest_financials(spark.createDataFrame(r, cols)), "item")}
    assert {k: v["value"] for k, v in got.items()} == {"revenue": 305.0, "ni": 9.0, "equity": 1000.0}
    assert got["ni"]["stock_code"] == "005930" and got["ni"]["rcept_dt"] == D("2025-08-14") and got["ni"]["q"] == 2


def test_corp_code_xml_file(spark):
    path = work() + "/c.xml"
    with open(path, "w", encoding="utf-8") as f:
        f.write("<result>" + "".join(f"<list><corp_code>{c}</corp_code><corp_name>{n}</corp_name><stock_code>{s}</stock_code></list>" for c, n, s in (("1", "a", "0041L0"), ("2", "b", " "), ("3", "c", "005930"))) + "</result>")
    assert [(r["corp_name"], r["stock_code"]) for r in rows(L.read_corp_codes(spark, path), "stock_code")] == [("a", "0041L0"), ("c", "005930")]


def test_dividend_and_names(spark):
    d = spark.createDataFrame([("A", "20241231", "1,000", "결산", "2025/04/18", "보통"), ("A", "20241231", "1,000", "결산", "2025/04/18", "보통"), ("A", "20241231", "50", "결산", "", "우선"), ("A", "20240630", "0", "x", "", "보통")],
                              "sht_cd string, record_date string, per_sto_divi_amt string, divi_kind string, divi_pay_dt string, stk_kind string")
    got = rows(L.ingest_dividends(d), "record_date")
    assert len(got) == 1 and got[0]["dps"] == 1000.0 and got[0]["pay_date"] == "2025-04-18"
    old = spark.createDataFrame([("005930", "전자")], "code string, name string")
    new = spark.createDataFrame([("005930", "005930"), ("000660", None), ("000020", "제약")], "code string, name string")
    assert {r["code"]: r["name"] for r in L.merge_names(old, new).collect()} == {"005930": "전자", "000660": "000660", "000020": "제약"}


def test_portfolio_file_and_board_sink(spark):
    path = work()
    with open(f"{path}/p.json", "w", encoding="utf-8") as f:
        json.dump({"a": {"weights": {"069500": 3, "114260": 1}, "benchmark": "KOSPI200", "start": "2026-09-28"}}, f)
    p = rows(L.load_portfolios(spark.read.text(path, wholetext=True)), "code")
    assert [(r["code"], r["weight"], str(r["start"])) for r in p] == [("069500", 0.75, "2026-09-28"), ("114260", 0.25, "2026-09-28")]
    out = work() + "/b"
    df = spark.createDataFrame([("A", float("nan")), ("B", 1.0)], "code string, v double")
    sinks.write_board(df, out, "code")
    sinks.write_board(df.where("code = 'A'"), out, "code")
    got = spark.read.json(out)
    assert got.count() == 1 and json.loads(got.toJSON().first()).get("v") is None


def test_text_columns(spark):
    t = "1 2 3 4\n반도체 업황이 좋다\n반도체 업황이 좋다\nok"
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(T.summarize("t").alias("s")).first()["s"] == "반도체 업황이 좋다"
    assert df.select(T.summarize("t", 5).alias("s")).first()["s"] == "반도체 업…"
    names = spark.createDataFrame([("000660", "하이닉스"), ("005930", "삼성전자"), ("003550", "LG")], "code string, name string")
    docs = spark.createDataFrame([(1, "SK하이닉스와 삼성전자는 삼성전자 005930 LG"), (2, "하이닉스가 1005930 올랐다")], "doc_id int, text string")
    assert {(r["doc_id"], r["code"]): r["n"] for r in TX.mention_counts(docs, names).collect()} == {(1, "005930"): 3, (2, "000660"): 1}
    shares = spark.createDataFrame([("c", x) for x in ("코스피 전망", "미국 주식", "삼성전자 실적", "요리", None)], "channel string, title string")
    s = TX.topic_shares(shares).first()
    assert (s["n"], s["kr"], s["fo"]) == (4, 0.5, 0.25)


def test_mentions_in_a_long_text_by_parts_of_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr(TX, "NAMES_AT_ONCE", 2)
    words = ["한빛전자", "한빛", "ABC", "ABC Motor", "xABC", "noise", "000777", "é한빛전자"]
    rng = np.random.default_rng(9)
    text = " ".join(words[i] for i in rng.integers(0, len(words), 20_000))
    names = [("000001", "한빛전자"), ("000002", "ABC"), ("000003", "ABC Motor"), ("000004", "한빛"), ("000005", "ABC"), ("000777", "noise"), ("000008", None)]
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    want = Counter()
    for code, name in names:
        if name and len(name) >= 3:
            want[code] += sum(1 for m in re.finditer(f"(?<![가-힣A-Za-z0-9]){name}", text))
        want[code] += len(re.findall(rf"(?<!\d){code}(?!\d)", text))
    got = {r["code"]: r["n"] for r in TX.mention_counts(docs, spark.createDataFrame(names, "code string, name string"), 9).collect()}
    assert got == {c: n for c, n in want.items() if n} and len(got) == 5
    assert TX.mention_counts(docs, spark.createDataFrame([], "code string, name string")).count() == 0


def test_labels_go_past_z(spark):
    got = [r["label"] for r in TX.anonymous_labels(spark.range(710).select(F.col("id").cast("string").alias("c")), "c").collect()]
    assert len(set(got)) == 710 and sorted(got, key=lambda x: (len(x), x))[24:28] == ["Y", "Z", "AA", "AB"] and {"ZZ", "AAA", "AAH"} <= set(got) and "AAI" not in got


def news_file(path, name, items):
    with open(f"{path}/{name}.json", "w", encoding="utf-8") as f:
        for i, ts, title in items:
            f.write(json.dumps({"id": i, "dt": ts, "code": "A", "title": title}) + "\n")


def test_news_stream_three_batches_with_a_late_row(spark):
    src, out = work(), work() + "/news"
    days = [D(f"2024-01-{d:02d}") for d in (5, 8, 9, 10, 11, 12, 15, 16, 17, 18, 19, 22)]
    cal = spark.createDataFrame([(d, i + 1) for i, d in enumerate(days)], "date date, pos int")

    def batch(name, items):
        news_file(src, name, items)
        J.run_available(J.news_stream(spark.readStream.schema("id string, dt timestamp, code string, title string").json(src), cal), out)
        return {(str(r["tday"]), r["n"]) for r in J.read_news_counts(spark, out).collect()} if glob.glob(f"{out}/batch=*/*.parquet") else set()

    first = batch("a", [("1", "2024-01-05T09:00:00Z", "호조"), ("2", "2024-01-05T15:30:00Z", "호조"), ("3", "2024-01-05T09:01:00Z", "특징주"), ("4", "2024-01-05T10:00:00Z", " 호조 ")])
    assert first == set()  # no window is closed yet
    # id 1 comes again; title 호조 is new for the next trading day only; 5 is another title of the first day
    second = batch("b", [("1", "2024-01-05T09:00:00Z", "호조"), ("5", "2024-01-05T11:00:00Z", "전망"), ("6", "2024-01-08T09:00:00Z", "호조"), ("7", "2024-01-12T09:00:00Z", "실적")])
    assert second == {("2024-01-05", 2), ("2024-01-08", 1)}
    # 8 lies behind the watermark of the second batch: dropped, the closed day stays as it was
    third = batch("c", [("8", "2024-01-05T12:00:00Z", "늦음"), ("9", "2024-01-22T09:00:00Z", "끝")])
    assert third == {("2024-01-05", 2), ("2024-01-08", 1), ("2024-01-12", 1)}


def test_event_dedupe_three_batches_late_row_and_expiry(spark):
    src, out = work(), work() + "/ev"
    schema = "event string, code string, tpos int, rcept_dt date, rcept_no string"
    days = business_days("2024-01-02", 120)
    cal = calendar(spark, days)

    def batch(name, items):
        with open(f"{src}/{name}.json", "w") as f:
            for code, tpos, no in items:
                f.write(json.dumps({"event": "E", "code": code, "tpos": tpos, "rcept_dt": str(days[tpos - 1]), "rcept_no": no}) + "\n")
        J.run_available(J.dedupe_event_stream(spark.readStream.schema(schema).json(src), cal, delay="30 days"), out, J.event_writer(out))

    batch("a", [("A", 1, "a"), ("A", 7, "b"), ("A", 1, "c"), ("B", 5, "x")])
    batch("b", [("A", 20, "d"), ("A", 21, "e"), ("B", 12, "y"), ("A", 45, "f")])
    batch("c", [("A", 30, "late"), ("A", 64, "g"), ("A", 65, "h"), ("B", 100, "z")])
    assert {r["rcept_no"] for r in J.read_batches(spark, out).collect()} == {"a", "e", "f", "h", "x", "z"}
    assert {r["rcept_no"] for r in J.read_batches(spark, out + "-late").collect()} == {"late"}
    batch("d", [("C", 119, "w")])
    state = spark.read.format("statestore").option("stateVarName", "last").load(out + "-checkpoint")
    held = {r["key"]["code"]: r["value"]["last"] for r in state.collect()}
    assert held == {"B": 100, "C": 119}  # A's quiet period lies behind the watermark


def test_event_dedupe_in_buckets_judges_as_one_key_at_a_time(spark):
    schema = "event string, code string, tpos int, rcept_dt date, rcept_no string"
    days = business_days("2024-01-02", 200)
    cal, rng, got = calendar(spark, days), np.random.default_rng(3), []
    batches = [[(f"E{rng.integers(2)}", f"c{rng.integers(9)}", int(rng.integers(lo, lo + 55)), f"{b}-{i}") for i in range(120)] for b, lo in enumerate((1, 50, 110))]
    for buckets in (None, 2):
        src, out = work(), work() + "/ev"
        for b, items in enumerate(batches):
            with open(f"{src}/{b}.json", "w") as f:
                for event, code, tpos, no in items:
                    f.write(json.dumps({"event": event, "code": code, "tpos": tpos, "rcept_dt": str(days[tpos - 1]), "rcept_no": no}) + "\n")
            J.run_available(J.dedupe_event_stream(spark.readStream.schema(schema).json(src), cal, delay="30 days", buckets=buckets), out, J.event_writer(out))
        got.append([sorted(tuple(r) for r in J.read_batches(spark, p).select("event", "code", "tpos", "rcept_no").collect()) for p in (out, out + "-late")])
        if buckets:  # a state for each bucket
            state = spark.read.format("statestore").option("stateVarName", "held").load(out + "-checkpoint").collect()
            assert len(state) <= 2 and 0 < sum(len(r["value"]["code"]) for r in state) <= 18
    assert got[0] == got[1] and len(got[0][0]) > 50 and len(got[0][1]) > 0


def test_upsert_table_three_batches_crash_and_restart(spark, monkeypatch):
    src, out = work(), work() + "/up"
    schema, keys, part = "code string, date date, value double, seq int", ["code", "date"], F.date_format("date", "yyyy-MM")

    def put(name, items):
        with open(f"{src}/{name}.json", "w") as f:
            for d, v, s in items:
                f.write(json.dumps({"code": "A", "date": d, "value": v, "seq": s}) + "\n")

    run = lambda: J.upsert_stream(spark.readStream.schema(schema).json(src), out, keys, "seq", part, every=2)
    table = lambda: {str(r["date"]): r["value"] for r in ST.read(spark, out, keys, "seq").collect()}
    put("a", [("2024-01-02", 1.0, 1), ("2024-01-03", 2.0, 1), ("2024-01-03", 2.2, 2), ("2024-02-01", 5.0, 1)])
    run()
    assert ST.manifest(spark, out)["number"] == 0 and table() == {"2024-01-02": 1.0, "2024-01-03": 2.2, "2024-02-01": 5.0}

    def crash(*a):
        raise RuntimeError("lost before the manifest")

    put("b", [("2024-01-02", 9.0, 3)])
    with monkeypatch.context() as m:
        m.setattr(ST, "_publish", crash)
        with pytest.raises(Exception, match="lost before"):
            run()
    # the parts are written, the manifest is not: readers see version 0 and both batches
    want = {"2024-01-02": 9.0, "2024-01-03": 2.2, "2024-02-01": 5.0}
    assert ST.manifest(spark, out)["number"] == 0 and table() == want
    run()  # the restart replays the batch
    now = ST.manifest(spark, out)
    assert now["number"] == 1 and now["through"] == 1 and set(now["parts"]) == {"2024-01", "2024-02"} and table() == want
    assert ST.open_batches(spark, out, now["through"]) == []
    put("c", [("2024-02-01", 4.0, 0), ("2024-02-02", 7.0, 1)])  # an older restatement loses
    run()
    want["2024-02-02"] = 7.0
    assert table() == want
    assert ST.compact(spark, out, keys, "seq", part) == 2
    later = ST.manifest(spark, out)
    assert later["parts"]["2024-01"] == now["parts"]["2024-01"] and later["parts"]["2024-02"] != now["parts"]["2024-02"] and table() == want
    ST.vacuum(spark, out)
    assert table() == want
    with pytest.raises(RuntimeError):  # another writer took the number
        ST._publish(spark, out, 2, {})


def test_move_alerts_use_yesterdays_threshold(spark):
    rng = np.random.default_rng(3)
    days = business_days("2024-01-02", 40)
    ticks = [(i * 10 + j, "A", d, float(p)) for i, d in enumerate(days) for j, p in enumerate(100 * np.exp(rng.normal(0, 0.03, 3)))]
    ticks += [(9000 + i, "B", d, 50.0) for i, d in enumerate(days[:4])]

    def run(cuts, data):
        src, out = work(), work() + "/al"
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            with open(f"{src}/{n}.json", "w") as f:
                for i, c, d, p in data:
                    if a <= days.index(d) < b:
                        f.write(json.dumps({"event_id": i, "code": c, "date": str(d), "price": p}) + "\n")
            J.run_available(J.move_alerts(spark.readStream.schema("event_id long, code string, date date, price double").json(src), min_obs=5), out)
        return {r["event_id"]: (r["side"], r["threshold"]) for r in J.read_batches(spark, out).collect()}

    # the batch operator on the days' mean prices
    close = pd.Series({d: np.mean([p for _, c, x, p in ticks if c == "A" and x == d]) for d in days})
    bars = spark.createDataFrame([("A", i + 1, float(c)) for i, c in enumerate(close)], "code string, pos int, close double")
    limit = {r["pos"]: r["threshold"] for r in P.move_threshold(bars, min_obs=5).collect()}
    want = {}
    for i, c, d, p in ticks:
        at = days.index(d)
        if c == "A" and at and limit[at + 1] is not None and abs(p / close.iloc[at - 1] - 1) > limit[at + 1]:
            want[i] = ("surge" if p > close.iloc[at - 1] else "plunge", limit[at + 1])
    got = run([0, 13, 27, 40], ticks)
    assert got.keys() == want.keys() and len(want) > 5
    assert all(got[i][0] == want[i][0] and near(got[i][1], want[i][1]) for i in want)
    # another future changes nothing of the past
    other = [(i, c, d, p * (3 if days.index(d) >= 30 else 1)) for i, c, d, p in ticks]
    again = run([0, 13, 27, 40], other)
    past = lambda x: {i: v for i, v in x.items() if i < 300}
    assert past(again) == past(got) and again != got


def test_move_alerts_after_a_close_of_zero(spark):
    days = business_days("2024-01-02", 9)
    price = [10.0, 10.1, 10.0, 10.1, 0.0, 5.0, 5.1, 5.0, 9.0]
    ticks = [(i, "A", d, p) for i, (d, p) in enumerate(zip(days, price))] + [(90, "A", days[5], 0.0), (91, "A", days[6], None)]
    src, out = work(), work() + "/al"
    with open(f"{src}/0.json", "w") as f:
        f.writelines(json.dumps({"event_id": i, "code": c, "date": str(d), "price": p}) + "\n" for i, c, d, p in ticks)
    J.run_available(J.move_alerts(spark.readStream.schema("event_id long, code string, date date, price double").json(src), min_obs=2), out)
    got = {r["event_id"]: (r["side"], r["threshold"]) for r in J.read_batches(spark, out).collect()}
    assert {4, 5, 6, 8, 90} == got.keys()  # the mean of day 5 is 2.5, so 5.1 is a surge
    assert [got[i][0] for i in (4, 5, 6, 8, 90)] == ["plunge", "surge", "surge", "surge", "surge"] and got[6][1] == got[8][1] == 0.15


def test_move_alerts_add_prices_in_the_order_of_ids(spark):
    days, prices = business_days("2024-01-02", 6), (17.68, 31.34, 66.18)
    src, out = work(), work() + "/al"
    with open(f"{src}/0.json", "w") as f:
        for n, order in enumerate(itertools.permutations(range(3))):
            ticks = [(d, p) for d, p in zip(days, (10.0, 20.0, 10.0, 20.0))] + [(days[4], prices[k]) for k in order] + [(days[5], 32.64)]
            ids = [0, 1, 2, 3, *[4 + k for k in order], 9]
            f.writelines(json.dumps({"event_id": 10 * n + i, "code": f"C{n}", "date": str(d), "price": p}) + "\n" for i, (d, p) in zip(ids, ticks))
    J.run_available(J.move_alerts(spark.readStream.schema("event_id long, code string, date date, price double").json(src), min_obs=2), out)
    got = {r["event_id"] for r in J.read_batches(spark, out).collect()}
    total = 0.0
    for p in prices:
        total += p
    assert {10 * n + 9 in got for n in range(6)} == {32.64 / (total / 3) - 1 < -0.15}  # the same for all orders of the rows
    assert len({32.64 / (((prices[a] + prices[b]) + prices[c]) / 3) - 1 < -0.15 for a, b, c in itertools.permutations(range(3))}) == 2
