"""Queries: ingestion of raw string records (derived from the bars) and streaming jobs over the table files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import rules as R
from quantloom.operators import calendar as K
from quantloom.operators import events as EV
from quantloom.plans.events import DEDUP_SQL, NEWS_SQL
from quantloom.plans.market import out
from quantloom.plans.registry import query
from quantloom.session import kept
from quantloom.sources import landing as L
from quantloom.streaming import jobs as J
from quantloom.streaming import store as ST


def text(c, d: int = 4):
    return F.format_number(F.col(c) if isinstance(c, str) else c, d)


def whole(c):
    return F.format_number(c, 0)


def raw_bars(v):
    """The bars as a vendor would send them: padded dates, thousands separators, '-' for nothing, codes without leading zeros."""
    return v.bars.select(F.date_format("date", "yyyyMMdd").alias("BAS_DD"), F.col("code").cast("int").cast("string").alias("ISU_CD"), F.col("name").alias("ISU_NM"), F.col("market").alias("MKT_NM"),
                         text("open").alias("TDD_OPNPRC"), text("high").alias("TDD_HGPRC"), text("low").alias("TDD_LWPRC"), text("close").alias("TDD_CLSPRC"), F.when(F.col("volume") == 0, "-").otherwise(text("volume", 0)).alias("ACC_TRDVOL"),
                         text("chg", 8).alias("CMPPREVDD_PRC"), text("value", 2).alias("ACC_TRDVAL"), text("cap", 0).alias("MKTCAP"), F.when(F.col("volume") == 0, "").otherwise(text("shares", 0)).alias("LIST_SHRS"))


@query("s01_scan_snapshots", "SELECT strftime(date,'%Y%m%d') AS day, count(*) AS n FROM bars GROUP BY date")
def _(v):
    path = J.work_path(v.spark, "snapshots")
    L.land_snapshots(raw_bars(v), path, "csv")
    s = L.scan_snapshots(v.spark, path, schema=L.PARTITIONED_SCHEMA)
    return s.groupBy(F.col("BAS_DD").alias("day")).agg(F.count("*").alias("n"))


@query("s02_tidy_bars", "SELECT date, code, name, market, open, close, round(chg,6)+0.0 AS chg, CASE WHEN volume<>0 THEN volume END AS volume, CASE WHEN volume<>0 THEN shares END AS shares FROM bars")
def _(v):
    t = L.tidy_bars(raw_bars(v))
    return out(t, "date", "code", "name", "market", "open", "close", "volume", "shares", chg=6)


@query("s05_clean_bars", "SELECT code, date, close, volume FROM bars WHERE close > 500")
def _(v):
    a = v.bars.withColumn("seq", F.lit(2)).withColumn("close", F.when(F.col("close") > 500, F.col("close")).otherwise(0.0))
    b = v.bars.withColumn("seq", F.lit(1)).withColumn("close", F.col("close") + 1).where("close > 501")
    return L.clean_bars(a.unionByName(b), "seq").select("code", "date", "close", "volume")


UPS_SQL = ", od AS (SELECT code, date, net AS net, 1 AS seq FROM flows WHERE who='frgn'), nw AS (SELECT code, date, net*2 AS net, 2 AS seq FROM flows WHERE who='frgn' AND date >= DATE '1999-01-01')"


@query("s06_upsert_latest", UPS_SQL + "SELECT code, date, round(CASE WHEN date >= DATE '1999-01-01' THEN net*2 ELSE net END,2)+0.0 AS net FROM od")
def _(v):
    f = v.flows.where("who = 'frgn'").select("code", "date", "net")
    old = f.withColumn("ingest_seq", F.lit(1))
    new = f.where(F.col("date") >= F.lit("1999-01-01").cast("date")).select("code", "date", (F.col("net") * 2).alias("net"), F.lit(2).alias("ingest_seq"))
    return out(L.upsert_latest(old, new, ["code", "date"]), "code", "date", net=2)


@query("s07_incremental_start", "SELECT l.code, coalesce(max(b.date)-5, DATE '1995-01-01') AS start FROM listing l LEFT JOIN bars b ON b.code=l.code AND CAST(b.code AS INT)%4<>0 GROUP BY l.code")
def _(v):
    return L.incremental_start(v.listing, v.bars.where("cast(code as int) % 4 <> 0"), "1995-01-01")


@query("s08_adjustment_changed", "SELECT code, CAST(code AS INT)%3=0 AS changed FROM bars GROUP BY code")
def _(v):
    return L.adjustment_changed(v.bars, v.bars.withColumn("close", F.col("close") * F.when(F.col("code").cast("int") % 3 == 0, 1.01).otherwise(1.001)))


def vendor(v, **cols):
    """One raw record per bar with string fields."""
    x = v.extra
    return x.select("code", F.date_format("date", "yyyyMMdd").alias("day"), F.when(F.col("volume") > 0, text("close")).otherwise("").alias("px"), *[e.alias(k) for k, e in cols.items()])


@query("s09_ingest_flows", "SELECT code, date, (pos-100)*1000000.0::DOUBLE AS inst, (pos%7)*1000000.0::DOUBLE AS corp, CASE WHEN pos%5<>0 THEN pos*1000000.0::DOUBLE END AS indiv, -pos*100000*1000000.0::DOUBLE AS frgn FROM extra WHERE volume>0")
def _(v):
    p = F.col("pos")
    r = vendor(v, orgn_ntby_tr_pbmn=(p - 100).cast("string"), etc_corp_ntby_tr_pbmn=(p % 7).cast("string"), prsn_ntby_tr_pbmn=F.when(p % 5 == 0, "-").otherwise(p.cast("string")), frgn_ntby_tr_pbmn=whole(-p * 100000))
    r = kept(r.withColumnRenamed("day", "stck_bsop_date").withColumnRenamed("px", "stck_clpr"), "vendor")
    dup = r.withColumn("orgn_ntby_tr_pbmn", F.lit("7")).withColumn("seq", F.lit(2))
    return L.ingest_flows(r.withColumn("seq", F.lit(1)).unionByName(dup))


@query("s10_ingest_short", "SELECT code, date, pos*3.0::DOUBLE AS short_qty, short_pct AS short_vol_pct, round(short_amt,4) AS short_amt, short_pct AS short_amt_pct FROM extra WHERE volume>0")
def _(v):
    r = vendor(v, ssts_cntg_qty=whole(F.col("pos") * 3), ssts_vol_rlim=F.col("short_pct").cast("string"), ssts_tr_pbmn=text("short_amt", 6), ssts_tr_pbmn_rlim=F.col("short_pct").cast("string"))
    s = L.ingest_short(r.withColumnRenamed("day", "stck_bsop_date").withColumnRenamed("px", "stck_clpr"))
    return out(s, "code", "date", "short_qty", "short_vol_pct", "short_amt_pct", short_amt=4)


@query("s10_ingest_credit", "SELECT code, date, pos*2.0::DOUBLE AS loan_qty, loan_amt*10000 AS loan_amt, loan_rate, 1.5::DOUBLE AS loan_gvrt FROM extra WHERE volume>0")
def _(v):
    r = vendor(v, whol_loan_rmnd_stcn=whole(F.col("pos") * 2), whol_loan_rmnd_amt=text("loan_amt", 0), whol_loan_rmnd_rate=F.col("loan_rate").cast("string"), whol_loan_gvrt=F.lit("1.5"))
    return L.ingest_credit(r.withColumnRenamed("day", "deal_date").withColumnRenamed("px", "stck_prpr"))


@query("s11_ingest_lending", "SELECT code, date, pos::DOUBLE AS lend_new, (pos+1)::DOUBLE AS lend_rdmp, lend_qty, pos*1000000.0::DOUBLE AS lend_amt FROM extra WHERE volume>0")
def _(v):
    r = vendor(v, new_stcn=F.col("pos").cast("string"), rdmp_stcn=(F.col("pos") + 1).cast("string"), rmnd_stcn=text("lend_qty", 0), rmnd_amt=whole("pos"))
    return L.ingest_lending(r.withColumnRenamed("day", "bsop_date").withColumnRenamed("px", "stck_prpr"))


@query("s12_ingest_program", "SELECT code, date, round(prog_net,2)+0.0 AS net, round(value,2) AS value FROM extra WHERE volume>0")
def _(v):
    r = vendor(v, whol_smtn_ntby_tr_pbmn=text("prog_net", 6), whol_smtn_shnu_tr_pbmn=F.lit("1"), whol_smtn_seln_tr_pbmn=F.lit("2"), acml_tr_pbmn=text("value", 6))
    return out(L.ingest_program(r.withColumnRenamed("day", "stck_bsop_date").withColumnRenamed("px", "stck_clpr"), "stock"), "code", "date", net=2, value=2)


@query("s12_ingest_program_market", "SELECT code, date, pos*1000000.0::DOUBLE AS arb_net, -pos*1000000.0::DOUBLE AS nonarb_net, short_pct AS net_rate FROM extra")
def _(v):
    r = vendor(v, arbt_smtn_ntby_tr_pbmn=whole("pos"), nabt_smtn_ntby_tr_pbmn=whole(-F.col("pos")), whol_smtn_ntby_tr_pbmn=F.lit("0"), whol_smtn_shnu_tr_pbmn=F.lit("1"), whol_smtn_seln_tr_pbmn=F.lit("1"), whol_ntby_tr_pbmn_rate=F.col("short_pct").cast("string"))
    return L.ingest_program(r.withColumnRenamed("day", "stck_bsop_date"), "market").select("code", "date", "arb_net", "nonarb_net", "net_rate")


def foreign_rows(v):
    p = F.col("pos")
    r = vendor(v, D=F.when(p % 2 == 0, F.col("ratio").cast("string")).otherwise(""), W=(F.col("ratio") + 1).cast("string"), M=(F.col("ratio") + 2).cast("string"))
    r = kept(r.withColumnRenamed("day", "stck_bsop_date").withColumnRenamed("px", "stck_clpr"), "vendor")  # the bars are made once, not in each of three branches
    mk = lambda f, seq: L.ingest_foreign(r.withColumnRenamed(f, "hts_frgn_ehrt"), f).withColumn("seq", F.lit(seq))
    d, w, m = mk("D", 1), mk("W", 1), mk("M", 2)
    return L.merge_by_priority(d.unionByName(w).unionByName(m))


@query("s13_merge_by_priority", "SELECT code, date, round(CASE WHEN pos%2=0 THEN ratio ELSE ratio+1 END,4) AS ehrt, CASE WHEN pos%2=0 THEN 'D' ELSE 'W' END AS freq FROM extra WHERE volume>0")
def _(v):
    return out(foreign_rows(v), "code", "date", "freq", ehrt=4)


@query("s14_exhaustion_to_ownership", """, lm AS (SELECT code, CASE WHEN l > 99.5 THEN 100.0 ELSE round(l+1e-9,2) END AS "limit" FROM (SELECT code, CASE WHEN CAST(code AS INT)%3<>0 THEN (CAST(code AS INT)*7%100)::DOUBLE/100*100/40*100 END AS l FROM listing) WHERE l > 0)
SELECT e.code, e.date, round(coalesce("limit",100),2) AS "limit", round((CASE WHEN pos%2=0 THEN ratio ELSE ratio+1 END)*coalesce("limit",100)/100+1e-9,3) AS ratio FROM extra e LEFT JOIN lm USING (code) WHERE volume>0""")
def _(v):
    k = F.col("code").cast("int")
    lim = v.listing.select("code", L.foreign_limit((k * 7 % 100).cast("double") + 1e-11, F.lit(100.0), F.when(k % 3 != 0, 40.0)).alias("limit")).where("limit > 0")
    r = foreign_rows(v).withColumn("ehrt", F.col("ehrt") + 1e-11)
    return out(L.exhaustion_to_ownership(r, lim), "code", "date", limit=2, ratio=3)


@query("s15_ingest_news", "SELECT CAST(id AS VARCHAR) AS id, date_trunc('second', dt) AS dt, title, code FROM (SELECT id, dt, trim(title) AS title, unnest([code, 'X' || code]) AS code FROM articles) WHERE id % 50 <> 0")
def _(v):
    blank = {f"iscd{i}": F.lit("") for i in range(3, 11)}
    raw = v.articles.select(F.when(F.col("id") % 50 == 0, "").otherwise(F.col("id").cast("string")).alias("cntt_usiq_srno"), F.date_format("dt", "yyyyMMdd").alias("data_dt"),
                            F.regexp_replace(F.date_format("dt", "HHmmss"), "^0+(?=.)", "").alias("data_tm"), F.lit("src").alias("dorg"), F.lit("1").alias("news_ofer_entp_code"), F.lit("A").alias("news_lrdv_code"),
                            F.col("title").alias("hts_pbnt_titl_cntt"), F.col("code").alias("iscd1"), F.concat(F.lit(" X"), "code").alias("iscd2"), *[e.alias(k) for k, e in blank.items()])
    return L.news_by_code(L.ingest_news(raw)).select("id", "dt", "title", "code")


@query("s16_ingest_dividends", "SELECT code, record_date, dps, kind, pay_date FROM divs WHERE CAST(code AS INT)%7<>0 AND dps>0")
def _(v):
    d = v.divs.select(F.col("code").alias("sht_cd"), F.date_format("record_date", "yyyyMMdd").alias("record_date"), F.format_number("dps", 2).alias("per_sto_divi_amt"), F.col("kind").alias("divi_kind"),
                      F.replace("pay_date", F.lit("-"), F.lit("/")).alias("divi_pay_dt"), F.when(F.col("code").cast("int") % 7 == 0, "우선").otherwise("보통").alias("stk_kind"))
    return L.ingest_dividends(d.unionByName(d))


@query("s17_ingest_global", "SELECT market AS name, date, round(max(close),4) AS close FROM bars GROUP BY ALL")
def _(v):
    g = v.bars.groupBy("market", "date").agg(F.max("close").alias("c"))
    r = g.select(F.col("market").alias("name"), F.date_format("date", "yyyyMMdd").alias("stck_bsop_date"), text("c").alias("ovrs_nmix_prpr"), text("c").alias("ovrs_nmix_oprc"), text("c").alias("ovrs_nmix_hgpr"), text("c").alias("ovrs_nmix_lwpr"))
    return out(L.ingest_global(r), "name", "date", close=4)


@query("s17_ingest_market_investor", "SELECT market, date, count(*)::DOUBLE AS index, count(*)*1000000.0::DOUBLE AS indiv FROM bars GROUP BY ALL")
def _(v):
    g = v.bars.groupBy("market", "date").agg(F.count("*").alias("c"))
    r = g.select("market", F.date_format("date", "yyyyMMdd").alias("stck_bsop_date"), whole("c").alias("bstp_nmix_prpr"), whole("c").alias("prsn_ntby_tr_pbmn"), whole("c").alias("frgn_ntby_tr_pbmn"), whole("c").alias("orgn_ntby_tr_pbmn"))
    return L.ingest_market_investor(r).select("market", "date", "index", "indiv")


@query("s17_ingest_calendar", "SELECT date, pos%9<>0 AS is_open FROM cal")
def _(v):
    return L.ingest_calendar(v.cal.select(F.date_format("date", "yyyyMMdd").alias("bass_dt"), F.when(F.col("pos") % 9 != 0, "y").otherwise("N").alias("opnd_yn")))


FIN_RAW = {"revenue": "매출액", "op": "영업이익", "ni": "당기순이익(손실)", "assets": "자산총계", "liab": "부채총계", "equity": "자본총계"}


@query("s19_ingest_financials", "SELECT stock_code, year, q, fs, item, round(value,3)+0.0 AS value, rcept_dt FROM fin")
def _(v):
    name = F.element_at(F.create_map(*[x for k, n in FIN_RAW.items() for x in (F.lit(k), F.lit(n))]), F.col("item"))
    report = F.element_at(F.create_map(*[x for k, n in R.REPORT_QUARTER.items() for x in (F.lit(n), F.lit(k))]), F.col("q"))
    amount = F.format_number(F.col("value"), 6)
    ytd = F.col("item").isin("revenue", "op", "ni") & F.col("q").isin(2, 3)
    r = v.fin.select(F.col("year").cast("string").alias("bsns_year"), report.alias("reprt_code"), F.concat(F.lit("C"), "stock_code").alias("corp_code"), F.col("stock_code"), F.col("fs").alias("fs_div"), name.alias("account_nm"),
                     F.when(F.col("item").isin("revenue", "op", "ni"), "IS").otherwise("BS").alias("sj_div"), F.when(ytd, "1").otherwise(amount).alias("thstrm_amount"), F.when(ytd, amount).otherwise("").alias("thstrm_add_amount"),
                     F.concat(F.date_format("rcept_dt", "yyyyMMdd"), F.lit("000001")).alias("rcept_no"), F.lit(1).alias("seq"))
    dup = r.where("account_nm = '당기순이익(손실)'").withColumn("account_nm", F.lit("당기순이익")).withColumn("thstrm_amount", F.lit("9")).withColumn("thstrm_add_amount", F.lit("9")).withColumn("seq", F.lit(2))
    junk = r.where("account_nm = '매출액'").withColumn("account_nm", F.lit("기타수익"))
    d = L.ingest_financials(r.unionByName(dup).unionByName(junk))
    return out(d, "stock_code", "year", "q", "fs", "item", "rcept_dt", value=3)


@query("s20_shrink_guard", "SELECT count(DISTINCT stock_code) AS n_old, count(DISTINCT stock_code) FILTER (CAST(stock_code AS INT)%3<>0) AS n_new, count(DISTINCT stock_code) FILTER (CAST(stock_code AS INT)%3<>0) >= 0.8::DOUBLE*count(DISTINCT stock_code) AS ok FROM fin")
def _(v):
    return L.shrink_guard(v.fin, v.fin.where("cast(stock_code as int) % 3 <> 0"), key="stock_code")


@query("s21_ingest_corp_codes", "SELECT 'C' || code AS corp_code, name AS corp_name, CASE WHEN CAST(code AS INT)%10=1 THEN '0041L' || right(code,1) ELSE code END AS stock_code FROM listing WHERE CAST(code AS INT)%10 NOT IN (1,4) UNION ALL (SELECT 'C' || code, name, '0041L1' FROM listing WHERE CAST(code AS INT)=1)")
def _(v):
    k = F.col("code").cast("int")
    xml = v.listing.where((k % 10 != 1) | (k == 1)).select(F.concat(F.lit("<list><corp_code>C"), "code", F.lit("</corp_code><corp_name>"), "name", F.lit("</corp_name><stock_code> "),
                                    F.when(k % 10 == 4, " ").when(k == 1, "0041L1").otherwise(F.col("code")), F.lit(" </stock_code></list>")).alias("x"))
    items = xml.select(F.from_xml("x", "corp_code string, corp_name string, stock_code string").alias("i")).select("i.*")
    return L.ingest_corp_codes(items)


def master_lines(v, market):
    """Fixed-width lines: code 9, standard code 12, name, then a tail of the market's width."""
    k = F.col("code").cast("int")
    tail = F.rpad(F.concat(F.lit("ST"), F.lit(" "), F.lpad((k % 5).cast("string"), 4, "0"), F.lpad((k % 4 * 3).cast("string"), 4, "0"), F.lit("0000"), F.lit("   "), (k % 3).cast("string"), F.lit("Y"), F.lit("N")), L.MASTER_TAIL[market], " ")
    return v.listing.select(F.concat(F.rpad("code", 9, " "), F.rpad(F.concat(F.lit("KR"), "code"), 12, " "), "name", tail).alias("value"))


@query("s22_ingest_master", "SELECT code, 'KR' || code AS std_code, name, lpad((CAST(code AS INT)%5)::VARCHAR,4,'0') AS sector_l, lpad((CAST(code AS INT)%4*3)::VARCHAR,4,'0') AS sector_m, CAST(code AS INT)%3<>0 AS kospi200, true AS kospi100, false AS kospi50 FROM listing")
def _(v):
    return L.ingest_master(master_lines(v, "kospi"), "kospi").select("code", "std_code", "name", "sector_l", "sector_m", "kospi200", "kospi100", "kospi50")


@query("s23_sector_map", "SELECT code, CASE WHEN CAST(code AS INT)%4<>0 AND CAST(code AS INT)%4*3<>9 THEN 'M' || (CAST(code AS INT)%4*3) WHEN CAST(code AS INT)%5 IN (1,2) THEN 'L' || (CAST(code AS INT)%5) WHEN CAST(code AS INT)%5=3 THEN 'M3' ELSE '기타' END AS sector FROM listing")
def _(v):
    kospi = L.ingest_master(master_lines(v, "kospi"), "kospi").select("code", "sector_l", "sector_m", "market")
    kosdaq = L.ingest_master(master_lines(v, "kosdaq").where("value like '%7 %'"), "kosdaq").select("code", "sector_l", "sector_m", "market")
    lines = v.listing.select((F.col("code").cast("int") % 10).alias("k")).distinct().select(F.explode(F.array_compact(F.array(
        F.when(F.col("k").isin(3, 6), F.concat(F.lit("000"), F.lpad(F.col("k").cast("string"), 2, "0"), F.lit("M"), F.col("k").cast("string"))),
        F.when(F.col("k").isin(1, 2), F.concat(F.lit("000"), F.lpad(F.col("k").cast("string"), 2, "0"), F.lit("L"), F.col("k").cast("string"), F.lit("  ")))))).alias("value"))
    return L.sector_map(kospi.unionByName(kosdaq), L.index_names(lines))


@query("s24_benchmarks", "SELECT date, round(max(close),4) AS close FROM bars WHERE market='EUROPE' GROUP BY date")
def _(v):
    g = v.bars.groupBy("market", "date").agg(F.max("close").alias("c"))
    raw = g.select(F.date_format("date", "yyyyMMdd").alias("BAS_DD"), F.concat_ws(" ", F.substring("market", 1, 2), F.expr("substring(market, 3)")).alias("IDX_NM"), text("c").alias("OPNPRC_IDX"), text("c").alias("HGPRC_IDX"), text("c").alias("LWPRC_IDX"),
                   text("c").alias("CLSPRC_IDX"), F.lit("1").alias("ACC_TRDVOL"))
    return out(L.index_bench(raw, "EUROPE"), "date", close=4)


@query("s24_fund_bench", """, fb AS (SELECT date, close, chg FROM bars WHERE code='000007'), f1 AS (SELECT *, lag(close) OVER (ORDER BY date) AS pc, lag(date) OVER (ORDER BY date) AS pd FROM fb),
f2 AS (SELECT *, CASE WHEN pc>0 AND close-chg>0 AND abs((close-chg)/pc-1)>1e-9 AND date-pd<=60 THEN (close-chg)/pc ELSE 1.0 END AS f FROM f1)
SELECT date, round(close*coalesce(product(f) OVER (ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),1.0),6) AS close FROM f2""")
def _(v):
    return out(L.fund_bench(raw_bars(v), "7"), "date", close=6)


@query("s25_names_latest", "SELECT code, max_by(name || '@' || year(date), date) FILTER (CAST(code AS INT)%2=0 OR year(date)<2000) AS name FROM bars GROUP BY code")
def _(v):
    n = F.concat("name", F.lit("@"), F.year("date").cast("string"))
    return L.names_latest(v.bars.select("code", "date", F.when((F.col("code").cast("int") % 2 == 0) | (F.year("date") < 2000), n).otherwise(" ").alias("name")))


@query("s25_merge_names", "SELECT code, CASE WHEN CAST(code AS INT)%4=0 THEN 'new ' || code WHEN CAST(code AS INT)%3=0 THEN code ELSE name END AS name FROM listing")
def _(v):
    k = F.col("code").cast("int")
    old = v.listing.where(k % 3 != 0).select("code", "name")
    new = v.listing.select("code", F.when(k % 4 == 0, F.concat(F.lit("new "), "code")).when(k % 4 == 1, F.col("code")).when(k % 4 == 2, "nan").alias("name"))
    return L.merge_names(old, new)


@query("s26_market_caps", "SELECT date, code, round(CASE WHEN month(date)<>2 THEN cap END,0) AS cap FROM bars WHERE month(date)<>2")
def _(v):
    b = v.bars.withColumn("cap", F.when(F.month("date") != 2, F.col("cap")))
    return out(L.market_caps(b), "date", "code", cap=0)


@query("s28_load_portfolios", "SELECT market AS name, code, round((1+CAST(code AS INT)%3)/sum(1+CAST(code AS INT)%3) OVER (PARTITION BY market)::DOUBLE,6) AS weight, 'IDX' AS benchmark, DATE '2026-09-28' AS start FROM listing")
def _(v):
    w = F.map_from_entries(F.collect_list(F.struct("code", (F.col("code").cast("int") % 3 + 1).cast("double"))))
    docs = v.listing.groupBy("market").agg(w.alias("weights")).select(F.to_json(F.map_from_arrays(F.array("market"), F.array(F.struct("weights", F.lit("IDX").alias("benchmark"), F.lit("2026-09-28").alias("start"))))).alias("value"))
    return out(L.load_portfolios(docs), "name", "code", "benchmark", "start", weight=6)


# ---- streaming ----

def thirds(v, df, order, run):
    """Lands a table in three parts by `order` (a date), and runs the stream over what is there after each: three batches, two restarts."""
    src = J.work_path(v.spark, "landing")
    cut = df.select(F.percentile_approx(F.unix_seconds(F.col(order).cast("timestamp")), [1 / 3, 2 / 3])).first()[0]
    at = F.unix_seconds(F.col(order).cast("timestamp"))
    for i in range(3):
        part = df.where((at > cut[i - 1] if i else F.lit(True)) & (at <= cut[i] if i < 2 else F.lit(True)))
        part.write.parquet(f"{src}/part={i}")
        run(v.spark.readStream.schema(df.schema).option("basePath", src).parquet(f"{src}/part=*").drop("part"))


@query("r01_news_stream", NEWS_SQL + """, ea AS (SELECT event_id AS id, ts AS dt, user_id, CASE WHEN event_type='purchase' THEN '특징주 급등' ELSE event_type || ' ' || event_id % 7 END AS title FROM events),
eb AS (SELECT *, (SELECT min(date) FROM dcal WHERE date >= CAST(dt AS DATE) + CASE WHEN hour(dt)*60+minute(dt) >= 930 THEN 1 ELSE 0 END) AS tday FROM ea WHERE title<>'특징주 급등'),
ec AS (SELECT user_id, tday, title, min(dt) AS dt FROM eb WHERE tday IS NOT NULL GROUP BY ALL)
SELECT lpad(CAST(user_id AS VARCHAR),6,'0') AS code, tday, count(*) AS n FROM ec
WHERE CAST(CAST(dt AS DATE) AS TIMESTAMP) + INTERVAL 930 MINUTE + CASE WHEN hour(dt)*60+minute(dt) >= 930 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END <= (SELECT max(ts) FROM events) - INTERVAL 4 DAY GROUP BY ALL""")
def _(v):
    title = F.when(F.col("event_type") == "purchase", "특징주 급등").otherwise(F.concat_ws(" ", "event_type", F.col("event_id") % 7))
    raw = v.table("events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("dt"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("code"), title.alias("title"))
    path = J.work_path(v.spark, "news")
    thirds(v, raw, "dt", lambda s: J.run_available(J.news_stream(s, v.daily_cal), path))
    return J.read_news_counts(v.spark, path)


@query("r02_event_dedupe_stream", DEDUP_SQL + "SELECT event, code, rcept_no, rcept_dt FROM evk")
def _(v):
    e = kept(EV.extract_events(v.filings, None).select("event", "code", "rcept_dt", "rcept_no"), "extracted")  # titles are classed once, not for the cuts and each third
    m = K.day_map(v.cal, pad_before=30, pad_after=30).select(F.col("day").alias("rcept_dt"), F.coalesce("next_pos", v.cal.agg(F.max("pos")).scalar() + 1).alias("tpos"))
    path = J.work_path(v.spark, "events")
    thirds(v, e, "rcept_dt", lambda s: J.run_available(J.dedupe_event_stream(s.join(m, "rcept_dt"), v.cal, buckets=1024), path, J.event_writer(path)))
    return J.read_batches(v.spark, path).select("event", "code", "rcept_no", "rcept_dt")


@query("r03_snapshot_upsert_stream", "SELECT lpad(CAST(l_suppkey AS VARCHAR),6,'0') AS code, CAST(l_shipdate AS DATE) AS date, max(l_orderkey) AS seq, round(max_by(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)),2) AS value FROM lineitem GROUP BY ALL")
def _(v):
    rows = v.table("lineitem").select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("code"), F.col("l_shipdate").cast("date").alias("date"),
                                      F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("seq"), F.col("l_extendedprice").alias("value"), F.timestamp_seconds("l_orderkey").alias("arrived"))
    path, keys = J.work_path(v.spark, "upsert"), ["code", "date"]
    thirds(v, rows, "arrived", lambda s: J.upsert_stream(s.drop("arrived"), path, keys, "seq", F.year("date"), every=2))
    return out(ST.read(v.spark, path, keys, "seq").withColumn("seq", F.col("seq.l_orderkey")), "code", "date", "seq", value=2)


@query("r04_move_alerts", """, tk AS (SELECT event_id, lpad(CAST(user_id AS VARCHAR),6,'0') AS code, CAST(ts AS DATE) AS date, value FROM events),
cl AS (SELECT code, date, avg(value) AS close FROM tk GROUP BY ALL),
cr AS (SELECT code, date, lag(close) OVER w AS prev, close/lag(close) OVER w - 1 AS ret, row_number() OVER w AS i FROM cl WINDOW w AS (PARTITION BY code ORDER BY date)),
st(code, i, m, q, s2) AS (SELECT code, 2, ret, ret*ret, 1.0::DOUBLE FROM cr WHERE i=2 UNION ALL
 SELECT s.code, s.i+1, 0.94::DOUBLE*m+0.06::DOUBLE*ret, 0.94::DOUBLE*q+0.06::DOUBLE*ret*ret, 0.94::DOUBLE*0.94::DOUBLE*s2+0.06::DOUBLE*0.06::DOUBLE FROM st s JOIN cr ON cr.code=s.code AND cr.i=s.i+1),
lim AS (SELECT cr.code, cr.date, cr.prev, least(greatest(2*sqrt(greatest((q-m*m)/(1-s2),0)),0.025::DOUBLE),0.15::DOUBLE) AS threshold FROM cr JOIN st ON st.code=cr.code AND st.i=cr.i-1 WHERE st.i-1 >= 5 AND s2 < 1)
SELECT event_id, CASE WHEN value/prev-1 > threshold THEN 'surge' ELSE 'plunge' END AS side, round(threshold,6) AS threshold FROM tk JOIN lim USING (code, date) WHERE abs(value/prev-1) > threshold""")
def _(v):
    ticks = v.table("events").select("event_id", F.lpad(F.col("user_id").cast("string"), 6, "0").alias("code"), F.col("ts").cast("date").alias("date"), F.col("value").cast("double").alias("price"))
    path = J.work_path(v.spark, "alerts")
    thirds(v, ticks, "date", lambda s: J.run_available(J.move_alerts(s, min_obs=5), path))
    return out(J.read_batches(v.spark, path).where("side <> 'late'"), "event_id", "side", threshold=6)
