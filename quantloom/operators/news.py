"""Headlines: trading-day assignment, daily counts and tone, attention features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import cols as C
from quantloom.functions import rules as R
from quantloom.operators import calendar as K
from quantloom.operators import ranks

CUTOFF_MINUTES = 15 * 60 + 30


def assign_trade_date(articles: DataFrame, cal: DataFrame, dt: str = "dt", out: str = "tday") -> DataFrame:
    """Before 15:30 on a trading day: that day; otherwise the next trading day; NULL past the calendar."""
    late = (F.hour(dt) * 60 + F.minute(dt) >= CUTOFF_MINUTES).cast("int")
    d = articles.withColumn("_d", F.date_add(F.col(dt).cast("date"), late))
    return K.next_trading_day(d, "_d", cal, strict=False, out=out).drop("_d")


def judged_titles(titles: DataFrame, keys) -> DataFrame:
    """(…keys, t, auto, s): each title judged once, for articles that carry only its keys. titles: (…keys, title), unique by keys.

    `t` is the SHA-256 of the normalised title and stands for it when repeats are counted, so no text travels with the articles.
    """
    d = titles.where("title is not null").withColumn("_t", C.squeeze("title"))
    return d.select(*keys, F.sha2("_t", 256).alias("t"), R.is_market_auto("title").alias("auto"), R.lexicon_score("_t").alias("s"))


def daily_news_table(articles: DataFrame, cal: DataFrame, exclude_auto: bool = True, titles: DataFrame | None = None, keys=()) -> DataFrame:
    """(code, tday, n, n_sent, score_sum): repeats of a normalised title per code and day count once.

    Articles hold their title, or the `keys` of a row of `titles`: (…keys, title). The score depends on the normalised title only, so it is computed
    once per row of `titles`, or else after the dedupe.
    """
    if titles is None:
        a = articles if not exclude_auto else articles.where(~R.is_market_auto("title"))
        a = assign_trade_date(a, cal).where("tday is not null")
        a = a.select("code", "tday", C.squeeze("title").alias("t")).distinct()
        a = a.withColumn("s", R.lexicon_score("t"))
    else:
        judged = judged_titles(titles, keys)
        a = articles.join(judged if not exclude_auto else judged.where("not auto"), list(keys))
        a = assign_trade_date(a, cal).where("tday is not null").dropDuplicates(["code", "tday", "t"])  # the score is the title's: any of the repeats will do
    has = (F.col("s.pos") + F.col("s.neg") > 0).cast("long")
    return a.groupBy("code", "tday").agg(F.count("*").alias("n"), F.sum(has).alias("n_sent"), F.sum("s.score").alias("score_sum"))


def news_features(codes: DataFrame, table: DataFrame, cal: DataFrame, window: int = 5, base: int = 60) -> DataFrame:
    """sent, attn, sent_attn, news_n on every (code, trading day); days without articles count 0. codes: (code)."""
    end = cal.agg(F.max("pos")).scalar()
    g = codes.select("code", F.explode(F.sequence(F.lit(1), end)).alias("pos"))
    t = table.join(cal.withColumnRenamed("date", "tday"), "tday").select("code", "pos", "n", "n_sent", "score_sum")
    g = g.join(t, ["code", "pos"], "left").na.fill(0, ["n", "n_sent", "score_sum"])
    w = C.by_code()
    near = w.rowsBetween(-(window - 1), 0)
    past = w.rowsBetween(-(window + base - 1), -window)
    ns = F.sum("n_sent").over(near)
    usual = F.when(F.count("n").over(past) >= base // 2, F.avg("n").over(past) * window)
    g = g.withColumn("news_n", F.sum("n").over(near)).withColumn("sent", F.sum("score_sum").over(near) / F.when(ns > 0, ns))
    g = g.withColumn("attn", F.log1p(F.col("news_n")) - F.log1p(usual))
    g = ranks.average_rank(g, ["pos"], "attn", "_pct", pct=True)
    return g.select("code", "pos", "news_n", "sent", "attn", (F.col("sent") * F.col("_pct")).alias("sent_attn"))


def news_density(articles: DataFrame, days: int) -> DataFrame:
    """One row: codes, median and 90th percentile of articles per code and day."""
    per = articles.groupBy("code").agg((F.count("*") / days).alias("d"))
    return per.agg(F.count("*").alias("codes"), F.percentile("d", F.array(F.lit(0.5), F.lit(0.9))).alias("_p")).select(
        "codes", F.col("_p")[0].alias("median"), F.col("_p")[1].alias("p90"))
