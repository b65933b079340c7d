"""Landing-zone files and raw records -> typed tables. Every parser takes a DataFrame of strings, so batch and stream share it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions import cols as C
from quantloom.functions import rules as R
from quantloom.operators.prices import adjust_prices, dedupe_last

# Field names of the daily snapshots and the unit factors of each feed.
SNAPSHOT_FIELDS = {"TDD_OPNPRC": "open", "TDD_HGPRC": "high", "TDD_LWPRC": "low", "TDD_CLSPRC": "close", "ACC_TRDVOL": "volume", "CMPPREVDD_PRC": "chg",
                   "ACC_TRDVAL": "value", "MKTCAP": "cap", "LIST_SHRS": "shares"}
INDEX_FIELDS = {"OPNPRC_IDX": "open", "HGPRC_IDX": "high", "LWPRC_IDX": "low", "CLSPRC_IDX": "close", "ACC_TRDVOL": "volume"}
FUND_FIELDS = {"TDD_CLSPRC": "close", "CMPPREVDD_PRC": "chg", "NAV": "nav", "MKTCAP": "aum", "LIST_SHRS": "shares", "ACC_TRDVAL": "value", "OBJ_STKPRC_IDX": "idx"}
SNAPSHOT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("BAS_DD", "ISU_CD", "ISU_NM", "MKT_NM", *SNAPSHOT_FIELDS)])
PARTITIONED_SCHEMA = T.StructType([*SNAPSHOT_SCHEMA.fields, T.StructField("ds_day", T.StringType())])
INDEX_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("BAS_DD", "IDX_NM", *INDEX_FIELDS)])
MILLION, TEN_THOUSAND = 1_000_000, 10_000
FREQ_ORDER = {"D": 0, "W": 1, "M": 2}
MASTER_TAIL = {"kospi": 227, "kosdaq": 221}
NO_LIMIT_ABOVE = 99.5


def scan_snapshots(spark: SparkSession, path: str, start=None, end=None, schema: T.StructType = SNAPSHOT_SCHEMA, fmt: str = "csv") -> DataFrame:
    """All-string snapshots partitioned by day (ds_day=YYYYMMDD); the date range prunes partitions before any file is opened."""
    df = spark.read.format(fmt).schema(schema).option("header", "true").option("mode", "PERMISSIVE").load(path)
    day = "ds_day" if "ds_day" in df.columns else "BAS_DD"
    if start is not None:
        df = df.where(F.col(day) >= start)
    return df if end is None else df.where(F.col(day) <= end)


def land_snapshots(raw: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Stores raw strings partitioned by day (ds_day), replacing only the days present in `raw`."""
    days = raw.withColumn("ds_day", F.col("BAS_DD")).repartition("ds_day")
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", "true").partitionBy("ds_day").format(fmt).save(path)


def _typed(raw: DataFrame, fields: dict[str, str]) -> list[Column]:
    return [(C.num(s) if s in raw.columns else F.lit(None).cast("double")).alias(d) for s, d in fields.items()]


def tidy_bars(raw: DataFrame) -> DataFrame:
    opt = lambda c: (F.col(c) if c in raw.columns else F.lit(None).cast("string"))
    return raw.select(C.ymd("BAS_DD").alias("date"), C.code6("ISU_CD").alias("code"), opt("ISU_NM").alias("name"), opt("MKT_NM").alias("market"), *_typed(raw, SNAPSHOT_FIELDS))


def tidy_funds(raw: DataFrame) -> DataFrame:
    opt = lambda c: (F.col(c) if c in raw.columns else F.lit(None).cast("string"))
    d = raw.select(C.ymd("BAS_DD").alias("date"), F.col("ISU_CD").alias("code"), opt("ISU_NM").alias("name"), opt("IDX_IND_NM").alias("index_name"), *_typed(raw, FUND_FIELDS))
    return d.where("close > 0")


def clean_bars(df: DataFrame, seq: str) -> DataFrame:
    """OHLCV only, date normalised, close > 0, the last row of each (code, date) in `seq` order."""
    d = df.select("code", F.col("date").cast("date").alias("date"), *[F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")], seq)
    return dedupe_last(d.where("close > 0"), ["code", "date"], seq).drop(seq)


def upsert_latest(old: DataFrame, new: DataFrame, keys, seq: str = "ingest_seq") -> DataFrame:
    """Appends and keeps the newest row per key (map-side combined, so a hot key is one row per task)."""
    return dedupe_last(old.unionByName(new, allowMissingColumns=True), list(keys), seq)


def incremental_start(keys: DataFrame, table: DataFrame, default, overlap: str = "5 days", key: str = "code", date: str = "date") -> DataFrame:
    """(key, start): last date minus the overlap, the default where nothing is stored."""
    last = table.groupBy(key).agg(F.max(date).alias("_last"))
    kind = dict(table.dtypes)[date]
    start = (F.col("_last") - F.expr(f"interval {overlap}")).cast(kind)
    return keys.select(key).distinct().join(last, key, "left").select(key, F.coalesce(start, F.lit(default).cast(kind)).alias("start"))


def adjustment_changed(old: DataFrame, new: DataFrame, tol: float = 0.005) -> DataFrame:
    """(code, changed): the largest relative close gap on overlapping days exceeds tol -> the code needs a full reload."""
    j = new.select("code", "date", F.col("close").alias("_n")).join(old.select("code", "date", "close"), ["code", "date"])
    return j.groupBy("code").agg((F.max(F.abs(C.change("_n", "close"))) > tol).alias("changed"))


def ingest_flows(raw: DataFrame) -> DataFrame:
    """Investor net buying, million -> units; padding rows (blank or zero close) out; the first row of a day stays."""
    names = {"orgn_ntby_tr_pbmn": "inst", "etc_corp_ntby_tr_pbmn": "corp", "prsn_ntby_tr_pbmn": "indiv", "frgn_ntby_tr_pbmn": "frgn"}
    d = raw.where(F.length("stck_bsop_date") > 0)
    if "stck_clpr" in raw.columns:
        d = d.where(C.num("stck_clpr") > 0)
    d = d.select("code", C.ymd("stck_bsop_date").alias("date"), *[(C.num(s) * MILLION).alias(t) for s, t in names.items()], *(["seq"] if "seq" in raw.columns else []))
    if "seq" in raw.columns:
        # numbers only: a max_by a column is a hash aggregate, one of whole rows sorts them twice; all columns come from the same row
        early = F.coalesce(-F.col("seq").cast("long"), F.lit(-(1 << 63)))  # a row without seq is the last
        return d.groupBy("code", "date").agg(*[F.max_by(c, early).alias(c) for c in names.values()])
    return d.dropDuplicates(["code", "date"])


def _dated(raw: DataFrame, date: str, price: str | None) -> DataFrame:
    d = raw.where(F.length(F.col(date)) == 8)
    return d.where(C.num(price) > 0) if price else d


def ingest_short(raw: DataFrame) -> DataFrame:
    d = _dated(raw, "stck_bsop_date", "stck_clpr")
    return d.select("code", C.ymd("stck_bsop_date").alias("date"), C.num("ssts_cntg_qty").alias("short_qty"), C.num("ssts_vol_rlim").alias("short_vol_pct"),
                    C.num("ssts_tr_pbmn").alias("short_amt"), C.num("ssts_tr_pbmn_rlim").alias("short_amt_pct"))


def ingest_credit(raw: DataFrame) -> DataFrame:
    d = _dated(raw, "deal_date", "stck_prpr")
    return d.select("code", C.ymd("deal_date").alias("date"), C.num("whol_loan_rmnd_stcn").alias("loan_qty"), (C.num("whol_loan_rmnd_amt") * TEN_THOUSAND).alias("loan_amt"),
                    C.num("whol_loan_rmnd_rate").alias("loan_rate"), C.num("whol_loan_gvrt").alias("loan_gvrt"))


def ingest_lending(raw: DataFrame) -> DataFrame:
    d = _dated(raw, "bsop_date", "stck_prpr")
    return d.select("code", C.ymd("bsop_date").alias("date"), C.num("new_stcn").alias("lend_new"), C.num("rdmp_stcn").alias("lend_rdmp"), C.num("rmnd_stcn").alias("lend_qty"),
                    (C.num("rmnd_amt") * MILLION).alias("lend_amt"))


def ingest_program(raw: DataFrame, kind: str) -> DataFrame:
    if kind == "market":
        d = _dated(raw, "stck_bsop_date", None)
        m = {"arbt_smtn_ntby_tr_pbmn": "arb_net", "nabt_smtn_ntby_tr_pbmn": "nonarb_net", "whol_smtn_ntby_tr_pbmn": "net", "whol_smtn_shnu_tr_pbmn": "buy", "whol_smtn_seln_tr_pbmn": "sell"}
        return d.select("code", C.ymd("stck_bsop_date").alias("date"), *[(C.num(s) * MILLION).alias(t) for s, t in m.items()], C.num("whol_ntby_tr_pbmn_rate").alias("net_rate"))
    d = _dated(raw, "stck_bsop_date", "stck_clpr")
    m = {"whol_smtn_ntby_tr_pbmn": "net", "whol_smtn_shnu_tr_pbmn": "buy", "whol_smtn_seln_tr_pbmn": "sell", "acml_tr_pbmn": "value"}
    return d.select("code", C.ymd("stck_bsop_date").alias("date"), *[C.num(s).alias(t) for s, t in m.items()])


def ingest_foreign(raw: DataFrame, freq: str) -> DataFrame:
    d = _dated(raw, "stck_bsop_date", "stck_clpr").where(C.num("hts_frgn_ehrt").isNotNull())
    return d.select("code", C.ymd("stck_bsop_date").alias("date"), C.num("hts_frgn_ehrt").alias("ehrt"), F.lit(freq).alias("freq"))


def merge_by_priority(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per (code, date): daily over weekly over monthly over any other, then the newer input.

    The listed frequencies are gathered as numbers, by hash; a struct as the best of a group would have all rows sorted first.
    """
    order = sorted(FREQ_ORDER, key=FREQ_ORDER.get)
    listed = F.coalesce(F.col("freq").isin(order), F.lit(False))
    is_ = {k: F.col("freq") == k for k in order}
    found = df.where(listed).groupBy("code", "date").agg(*[F.max(is_[k]).alias(f"_h{k}") for k in order],
                                                         *[F.max_by("ehrt", F.when(is_[k], F.coalesce(F.col(seq).cast("long"), F.lit(-2 ** 63)))).alias(f"_e{k}") for k in order])
    found = found.select("code", "date", C.first_match([(k, F.col(f"_h{k}")) for k in order]).alias("freq"), *[f"_e{k}" for k in order])
    ehrt = reduce(lambda c, k: c.when(F.col("freq") == k, F.col(f"_e{k}")), order[1:], F.when(F.col("freq") == order[0], F.col(f"_e{order[0]}")))
    found = found.select("code", "date", ehrt.alias("ehrt"), "freq")
    rest = df.where(~listed).groupBy("code", "date").agg(F.min_by(F.struct("ehrt", "freq"), -F.col(seq)).alias("_b")).select("code", "date", "_b.*")
    return found.unionByName(rest.join(found.select("code", "date"), ["code", "date"], "left_anti"))


def foreign_limit(held, listed, ehrt) -> Column:
    """Foreign ownership limit in percent of listed shares; NULL on unusable input, 100 when there is no limit."""
    lim = C.col(held) / C.positive(listed) * 100 / C.positive(ehrt) * 100
    return F.when(lim > NO_LIMIT_ABOVE, 100.0).otherwise(F.round(lim, 2))


def exhaustion_to_ownership(df: DataFrame, limits: DataFrame) -> DataFrame:
    d = df.join(limits.select("code", "limit"), "code", "left").withColumn("limit", F.coalesce("limit", F.lit(100.0)))
    return d.withColumn("ratio", F.round(F.col("ehrt") * F.col("limit") / 100, 3))


def ingest_news(raw: DataFrame) -> DataFrame:
    """(id, dt, source, provider, category, title, codes array): composed timestamp, up to ten codes, blank ids out."""
    stamp = F.concat(F.col("data_dt"), F.lpad("data_tm", 6, "0"))
    codes = F.filter(F.array(*[F.trim(F.coalesce(F.col(f"iscd{i}"), F.lit(""))) for i in range(1, 11)]), lambda c: c != "")
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    d = raw.where(F.length("data_dt") == 8).select(
        t("cntt_usiq_srno").alias("id"), F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz").alias("dt"), t("dorg").alias("source"),
        t("news_ofer_entp_code").alias("provider"), t("news_lrdv_code").alias("category"), t("hts_pbnt_titl_cntt").alias("title"), codes.alias("codes"))
    return d.where("id <> ''")


def news_by_code(news: DataFrame) -> DataFrame:
    return news.select("*", F.explode("codes").alias("code")).drop("codes")


def ingest_dividends(raw: DataFrame) -> DataFrame:
    """Common shares with dps > 0, one row per (code, record date, dps)."""
    kind = F.trim(F.coalesce("stk_kind", F.lit("보통")))
    d = raw.where(kind.isin("보통", "")).select(
        F.trim("sht_cd").alias("code"), C.ymd("record_date").alias("record_date"), C.num("per_sto_divi_amt").alias("dps"), F.trim("divi_kind").alias("kind"),
        F.trim(F.replace("divi_pay_dt", F.lit("/"), F.lit("-"))).alias("pay_date"))
    return d.where("dps > 0").dropDuplicates(["code", "record_date", "dps"])


def ingest_global(raw: DataFrame) -> DataFrame:
    d = _dated(raw, "stck_bsop_date", "ovrs_nmix_prpr")
    return d.select("name", C.ymd("stck_bsop_date").alias("date"), C.num("ovrs_nmix_oprc").alias("open"), C.num("ovrs_nmix_hgpr").alias("high"), C.num("ovrs_nmix_lwpr").alias("low"),
                    C.num("ovrs_nmix_prpr").alias("close"))


def ingest_market_investor(raw: DataFrame) -> DataFrame:
    d = _dated(raw, "stck_bsop_date", None)
    return d.select("market", C.ymd("stck_bsop_date").alias("date"), C.num("bstp_nmix_prpr").alias("index"), (C.num("prsn_ntby_tr_pbmn") * MILLION).alias("indiv"),
                    (C.num("frgn_ntby_tr_pbmn") * MILLION).alias("frgn"), (C.num("orgn_ntby_tr_pbmn") * MILLION).alias("inst"))


def ingest_calendar(raw: DataFrame) -> DataFrame:
    return raw.where(F.length("bass_dt") == 8).select(C.ymd("bass_dt").alias("date"), (F.upper(F.coalesce("opnd_yn", F.lit(""))) == "Y").alias("is_open"))


def scan_filings(raw: DataFrame, start=None, end=None) -> DataFrame:
    d = raw.withColumn("rcept_dt", C.ymd("rcept_dt"))
    if start is not None:
        d = d.where(F.col("rcept_dt") >= F.lit(start).cast("date"))
    if end is not None:
        d = d.where(F.col("rcept_dt") <= F.lit(end).cast("date"))
    return d.dropDuplicates(["rcept_no"])


def ingest_financials(raw: DataFrame, seq: str = "seq") -> DataFrame:
    """Long facts: mapped accounts only, P&L of half-year and Q3 reports from the cumulative column (period column when blank),
    the first row per (company, statement, item), receipt date from the receipt number."""
    item = C.first_match([(v, F.trim("account_nm") == k) for k, v in R.ACCOUNT_ITEMS.items()])
    q = C.first_match([(str(v), F.col("reprt_code") == k) for k, v in R.REPORT_QUARTER.items()]).cast("int")
    amount = C.num("thstrm_amount")
    ytd = (F.col("sj_div") == "IS") & F.col("reprt_code").isin("11012", "11014")
    d = raw.withColumn("item", item).where("item is not null").withColumn("value", F.when(ytd, F.coalesce(C.num("thstrm_add_amount"), amount)).otherwise(amount))
    d = d.select(F.col("bsns_year").cast("int").alias("year"), q.alias("q"), "corp_code", C.code6(F.trim("stock_code")).alias("stock_code"), F.col("fs_div").alias("fs"), "item", "value",
                 "rcept_no", C.ymd(F.substring("rcept_no", 1, 8)).alias("rcept_dt"), (-F.col(seq)).alias(seq))
    return dedupe_last(d, ["year", "q", "corp_code", "fs", "item"], seq).drop(seq)


def shrink_guard(old: DataFrame, new: DataFrame, share: float = 0.8, key: str = "corp_code") -> DataFrame:
    """One row (n_old, n_new, ok): a reload must cover at least `share` of the companies seen before."""
    a, b = old.agg(F.countDistinct(key).alias("n")), new.agg(F.countDistinct(key).alias("n"))
    one = old.sparkSession.range(1)
    return one.select(a.scalar().alias("n_old"), b.scalar().alias("n_new")).withColumn("ok", F.col("n_new") >= F.col("n_old") * share)


def read_corp_codes(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("corp_code", "corp_name", "stock_code")])
    return ingest_corp_codes(spark.read.format("xml").schema(schema).option("rowTag", "list").load(path))


def ingest_corp_codes(items: DataFrame) -> DataFrame:
    d = items.select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("corp_code", "corp_name", "stock_code")])
    return d.where(F.col("stock_code").rlike("^[0-9A-Z]{6}$")).dropDuplicates(["stock_code"])


def ingest_master(lines: DataFrame, market: str) -> DataFrame:
    """Fixed-width master lines (`value`): free-length head, tail of known width."""
    tail = MASTER_TAIL[market]
    d = lines.where((F.trim("value") != "") & (F.length("value") > tail + 21))
    d = d.withColumn("_h", F.expr(f"substring(value, 1, length(value) - {tail})")).withColumn("_t", F.substring("value", -tail, tail))
    flag = lambda i: F.substring("_t", i + 1, 1)
    cols = [F.trim(F.substring("_h", 1, 9)).alias("code"), F.trim(F.substring("_h", 10, 12)).alias("std_code"), F.trim(F.expr("substring(_h, 22)")).alias("name"),
            F.substring("_t", 1, 2).alias("group"), F.substring("_t", 4, 4).alias("sector_l"), F.substring("_t", 8, 4).alias("sector_m"), F.substring("_t", 12, 4).alias("sector_s")]
    if market == "kospi":
        cols += [flag(18).alias("kospi200_sector"), (~flag(18).isin(" ", "0")).alias("kospi200"),
                 (flag(19) == "Y").alias("kospi100"), (flag(20) == "Y").alias("kospi50")]
    else:
        cols += [(flag(35) == "Y").alias("kosdaq150")]
    return d.select(*cols, F.lit(market.upper()).alias("market"))


def sector_map(master: DataFrame, index_names: DataFrame) -> DataFrame:
    """(code, sector): medium sector when set and named, else large, else 기타; KOSPI wins when a code is in both markets."""
    prefix = F.when(F.col("market") == "KOSPI", "0").otherwise("1")
    named = lambda c: index_names.select(F.col("key").alias(f"_k{c}"), F.col("label").alias(f"_n{c}"))
    usable = lambda c: F.when(F.regexp_replace(c, "[0 ]", "") != "", F.concat(prefix, F.col(c)))
    d = master.withColumn("_km", usable("sector_m")).withColumn("_kl", usable("sector_l"))
    d = d.join(named("m"), "_km", "left").join(named("l"), "_kl", "left").withColumn("sector", F.coalesce("_nm", "_nl", F.lit("기타")))
    return d.groupBy("code").agg(F.min_by("sector", F.when(F.col("market") == "KOSPI", 0).otherwise(1)).alias("sector"))


def index_names(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value").rlike("^[0-9]{5}.")).select(F.substring("value", 1, 5).alias("key"), F.trim(F.expr("substring(value, 6)")).alias("label"))


def index_bench(raw: DataFrame, name: str) -> DataFrame:
    """Price index rows whose name matches without blanks."""
    d = raw.where(F.replace("IDX_NM", F.lit(" "), F.lit("")) == name.replace(" ", ""))
    return d.select(C.ymd("BAS_DD").alias("date"), *_typed(raw, INDEX_FIELDS)).where("close > 0").dropDuplicates(["date"])


def fund_bench(raw: DataFrame, code: str) -> DataFrame:
    return adjust_prices(tidy_bars(raw.where(F.col("ISU_CD") == code))).select("date", "open", "high", "low", "close", "volume")


def names_latest(tidy: DataFrame) -> DataFrame:
    ok = F.col("name").isNotNull() & (F.trim("name") != "")
    return tidy.where(ok).groupBy("code").agg(F.max_by("name", "date").alias("name"))


def merge_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """A valid new name wins; an invalid one (blank, nan, equal to the code) never overwrites; unknown codes name themselves."""
    bad = F.col("_n").isNull() | (F.trim("_n") == "") | (F.col("_n") == F.col("code")) | F.lower("_n").isin("nan", "none")
    j = old.select("code", F.col("name").alias("_o")).join(new.select("code", F.col("name").alias("_n")), "code", "full")
    return j.select("code", F.coalesce(F.when(~bad, F.col("_n")), "_o", "code").alias("name"))


def market_caps(tidy: DataFrame) -> DataFrame:
    """Rows of days that have at least one positive cap."""
    good = tidy.groupBy("date").agg(F.bool_or(F.col("cap") > 0).alias("_ok")).where("_ok")
    return tidy.select("date", "code", "close", "cap", "volume", "value", "shares").join(good.select("date"), "date", "left_semi")


def load_portfolios(docs: DataFrame) -> DataFrame:
    """JSON documents {name: {weights: {...}, benchmark, start}} in column `value` -> (name, code, weight, benchmark, start), weights normalised."""
    spec = "map<string, struct<weights: map<string, double>, benchmark: string, start: string>>"
    d = docs.select(F.explode(F.from_json("value", spec)).alias("name", "_s"))
    d = d.select("name", F.explode("_s.weights").alias("code", "weight"), F.col("_s.benchmark").alias("benchmark"), F.col("_s.start").try_cast("date").alias("start"))
    return d.withColumn("weight", C.div("weight", F.sum("weight").over(Window.partitionBy("name"))))
