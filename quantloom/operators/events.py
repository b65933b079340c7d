"""Filing events: point-in-time filter, quiet-period dedupe, event windows, calendar-time t."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import cols as C
from quantloom.functions import rules as R
from quantloom.operators import calendar as K
from quantloom.operators import universe as U

QUIET_DAYS = 20


def extract_events(filings: DataFrame, membership: DataFrame | None) -> DataFrame:
    """Filings of a study event type whose code was a member on the receipt date. filings: (rcept_no, rcept_dt, code, title)."""
    e = filings.withColumn("event", R.event_type("title")).where("event is not null and length(code) = 6")
    return e if membership is None else U.only_members(e, membership, "rcept_dt")


def dedupe_events(events: DataFrame, cal: DataFrame, quiet: int = QUIET_DAYS) -> DataFrame:
    """Per (event, code): drops events closer than `quiet` trading days to the last kept one.

    Events of one key on one trading position collapse first (only the earliest can be kept), with a map-side combine,
    so the fold sees at most one element per trading day however hot the key is.
    """
    d = K.next_trading_day(events, "rcept_dt", cal, strict=False, out="_td").join(cal.withColumnRenamed("date", "_td"), "_td", "left")
    end = cal.agg(F.max("pos")).scalar()
    d = d.withColumn("tpos", F.coalesce("pos", end + 1))
    rest = [c for c in events.columns if c not in ("event", "code", "rcept_dt", "rcept_no")]
    first = F.min(F.struct("rcept_dt", "rcept_no", *rest)).alias("_e")
    one = d.groupBy("event", "code", "tpos").agg(first)
    seq = one.groupBy("event", "code").agg(F.sort_array(F.collect_list(F.struct("tpos", "_e"))).alias("_s"))
    # the position of the last kept event is carried next to the kept positions
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(acc, x):
        take = acc["last"].isNull() | (x["tpos"] - acc["last"] >= quiet)
        return F.struct(F.when(take, x["tpos"]).otherwise(acc["last"]).alias("last"),
                        F.when(take, F.concat(acc["kept"], F.array(x["tpos"]))).otherwise(acc["kept"]).alias("kept"))

    k = seq.withColumn("_k", F.aggregate("_s", start, step)["kept"])
    k = k.select("event", "code", F.explode("_s").alias("_x"), "_k").where(F.array_contains("_k", F.col("_x.tpos")))
    return k.select("event", "code", "_x._e.*")


def event_window(events: DataFrame, returns: DataFrame, bench: DataFrame, cal: DataFrame, h: int, pre: int = 5) -> DataFrame:
    """(…event columns, entry, car, pre_car): CAR from the day after entry, pre-CAR over the `pre` days up to entry.

    returns: dense grid (code, pos, ret); bench: (pos, bench_ret). Window sums are rolled once per code, then looked up at the
    entry position, so the range join is an equi-join.
    """
    w = C.by_code()
    ar = returns.join(bench, "pos", "left").withColumn("ar", F.col("ret") - F.col("bench_ret"))
    fwd, back = w.rowsBetween(1, h), w.rowsBetween(-(pre - 1), 0)
    ar = ar.select("code", "pos", F.when(F.count("ar").over(fwd) == h, F.sum("ar").over(fwd)).alias("car"),
                   F.when(F.count("ar").over(back) == pre, F.sum("ar").over(back)).alias("pre_car"))
    e = K.next_trading_day(events, "rcept_dt", cal, strict=True, out="entry").where("entry is not null")
    e = e.join(cal.withColumnRenamed("date", "entry"), "entry")
    end = cal.agg(F.max("pos")).scalar()
    e = e.where((F.col("pos") + h <= end) & (F.col("pos") > pre))
    return e.join(ar, ["code", "pos"]).where("car is not null").drop("pos")


def calendar_time_t(cars: DataFrame) -> DataFrame:
    """Per event: mean of monthly mean CARs with Newey-West t (lag 2), event-level mean, median, pre-CAR mean."""
    from quantloom.operators import stats as S

    m = cars.groupBy("event", F.trunc("entry", "MM").alias("month")).agg(F.avg("car").alias("m"))
    t = S.nw_tstat(m, ["event"], "month", "m", 2).select("event", F.col("n").alias("n_months"), F.col("mean").alias("mean_car"), "nw_t")
    g = cars.groupBy("event").agg(F.count("*").alias("n_events"), F.avg("car").alias("event_mean"), C.median("car").alias("event_median"), F.avg("pre_car").alias("pre_car_mean"))
    return g.join(t, "event")


def filing_reaction(filings: DataFrame, moves: DataFrame, cal: DataFrame) -> DataFrame:
    """Adds r0 (move on the filing day) and r1 (first trading day after). moves: (code, date, r), halted rows already out."""
    m = moves.select("code", F.col("date").alias("rcept_dt"), F.col("r").alias("r0"))
    n = moves.select("code", F.col("date").alias("_next"), F.col("r").alias("r1"))
    f = K.next_trading_day(filings, "rcept_dt", cal, strict=True, out="_next")
    return f.join(m, ["code", "rcept_dt"], "left").join(n, ["code", "_next"], "left").drop("_next")


def price_reaction_map(raw: DataFrame) -> DataFrame:
    """(code, date, r): percent change / 100 on days with volume. raw: (code, date, pct, volume)."""
    return raw.where("volume > 0 and pct is not null").select("code", "date", (F.col("pct") / 100).alias("r"))


def key_filings(filings: DataFrame, members: DataFrame, since, n: int = 10) -> DataFrame:
    """Newest n filings of members in the key classes, routine ones out, repeats of a title per code and day out."""
    f = filings.where(F.col("rcept_dt") >= since).join(members.select("code"), "code", "left_semi")
    f = f.withColumn("cat", R.classify_filing("title")).where(F.col("cat").isin(*R.KEY_CLASSES) & ~R.is_routine("title"))
    newest = F.max_by(F.struct("rcept_no", "corp_name", "cat"), F.col("rcept_no")).alias("_f")
    f = f.groupBy("rcept_dt", "code", "title").agg(newest).select("rcept_dt", "code", "title", "_f.*")
    return f.orderBy(F.col("rcept_dt").desc(), F.col("rcept_no").desc()).limit(n)


def matured_events(events: DataFrame, at, cal: DataFrame, horizon: int = 20) -> DataFrame:
    """Events on trading days whose outcome `horizon` days later is known at date `at`. events: (…, date)."""
    last = cal.where(F.col("date") <= F.lit(at).cast("date")).agg(F.max("pos")).scalar()
    return events.join(cal, "date").where(F.col("pos") + horizon <= last).drop("pos")
