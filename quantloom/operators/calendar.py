"""Trading calendar: `calendar(date, pos)`. All "next / k-th trading day" logic becomes an equi-join on pos or date.

A calendar holds one row per market day (about 250 a year), so numbering it in one task is bounded by time,
not by the amount of market data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import cols as C


def calendar_of(days: DataFrame, date: str = "date") -> DataFrame:
    """Distinct days numbered 1..n."""
    d = days.select(F.col(date).alias("date")).where("date is not null").distinct()
    return d.select("date", F.row_number().over(Window.orderBy("date")).cast("int").alias("pos"))


def trading_calendar(snapshots: DataFrame, date: str = "date", close: str = "close") -> DataFrame:
    """(date, is_open): a day is a trading day when some close is present and non-zero; otherwise a holiday."""
    return snapshots.groupBy(F.col(date).alias("date")).agg(
        F.coalesce(F.bool_or(F.col(close) != 0), F.lit(False)).alias("is_open"))


def candidate_days(bounds: DataFrame, holidays: DataFrame) -> DataFrame:
    """Weekdays in one row of (start, end) that are not known holidays."""
    days = bounds.select(F.explode(F.sequence("start", "end")).alias("date"))
    return days.where(F.weekday("date") < 5).join(holidays.select("date"), "date", "left_anti")


def month_starts(bounds: DataFrame) -> DataFrame:
    first = F.when(F.trunc("start", "MM") == F.col("start"), F.col("start")).otherwise(F.add_months(F.trunc("start", "MM"), 1))
    return (bounds.where(first <= F.col("end"))
            .select(F.explode(F.sequence(first, F.col("end"), F.expr("interval 1 month"))).alias("date")))


def day_map(cal: DataFrame, pad_before: int = 0, pad_after: int = 0) -> DataFrame:
    """Every calendar day (also closed ones) -> last_pos (last trading day <= day), next_pos (first >= day), after_pos (first > day)."""
    span = cal.agg(F.date_sub(F.min("date"), pad_before).alias("a"), F.date_add(F.max("date"), pad_after).alias("b"))
    every = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    w = Window.orderBy("day")
    last = F.last("pos", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first("pos", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    after = F.first("pos", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return every.join(cal, every.day == cal.date, "left").select(
        "day", last.alias("last_pos"), nxt.alias("next_pos"), after.alias("after_pos"))


def next_trading_day(df: DataFrame, day: str, cal: DataFrame, strict: bool, out: str = "trade_date") -> DataFrame:
    """Adds the first trading day >= day (strict: > day), NULL past the end of the calendar.

    The interval [previous trading day, this trading day) of each calendar row is expanded to its days,
    so the as-of match is an equi-join; a day before the calendar starts maps to its first day. A NULL day has no trading day.
    """
    w = Window.orderBy("pos")
    prev = F.lag("date").over(w)
    shift = 0 if strict else 1
    first = cal.agg(F.min("date").alias("_first"))
    spans = cal.select(F.col("date").alias(out), F.date_add(F.coalesce(prev, F.date_sub("date", 1)), shift).alias("_from"))
    spans = spans.select(out, F.explode(F.sequence("_from", F.date_sub(out, 1 - shift))).alias("_day"))
    early = F.date_sub(first.scalar(), 0 if not strict else 1)
    return (df.withColumn("_day", F.when(F.col(day).isNotNull(), F.greatest(F.col(day), early)))
            .join(spans, "_day", "left").drop("_day"))


def ex_dates(divs: DataFrame, cal: DataFrame, record: str = "record_date", settle: int = 2) -> DataFrame:
    """cum_date = `settle` trading days before the last trading day <= record; ex_date = the day after cum. NULL out of range."""
    m = day_map(cal, pad_after=400).select(F.col("day").alias(record), "last_pos")
    cum = cal.select(F.col("pos").alias("_cum"), F.col("date").alias("cum_date"))
    ex = cal.select(F.col("pos").alias("_ex"), F.col("date").alias("ex_date"))
    d = divs.join(m, record, "left").withColumn("_cum", F.col("last_pos") - settle).withColumn("_ex", F.col("last_pos") - settle + 1)
    d = d.join(cum, "_cum", "left").join(ex, "_ex", "left").drop("_cum", "_ex", "last_pos")
    return d.withColumn("cum_date", F.when(F.col("ex_date").isNotNull(), F.col("cum_date"))).withColumn(
        "ex_date", F.when(F.col("cum_date").isNotNull(), F.col("ex_date")))


def every_kth_keep_last(cal: DataFrame, k: int) -> DataFrame:
    """Every k-th day counted from the end, so the last day is always in."""
    last = cal.agg(F.max("pos")).scalar()
    return cal.where((last - F.col("pos")) % k == 0)


def grid(panel: DataFrame, cal: DataFrame, values, keys=("code",)) -> DataFrame:
    """Dense market grid: one row per key and calendar position from the key's first row to the calendar's end.

    Gaps are produced by exploding [pos, next pos) of each existing row, so there is no cross join and the
    partitioning by key is kept for the windows that follow.
    """
    end = cal.agg(F.max("pos")).scalar()
    w = C.by_code(*keys)
    p = panel.join(cal, "date").select(*keys, "pos", *values)
    p = p.withColumn("_upto", F.coalesce(F.lead("pos").over(w) - 1, end))
    p = p.where(F.col("_upto") >= F.col("pos"))  # of rows that share key and day, the last of the window stays
    p = p.withColumn("_p", F.explode(F.sequence(F.col("pos"), F.col("_upto"))))
    here = F.col("_p") == F.col("pos")
    return p.select(*keys, F.col("_p").alias("pos"), *[F.when(here, F.col(v)).alias(v) for v in values], here.alias("traded"))


def with_date(df: DataFrame, cal: DataFrame) -> DataFrame:
    return df.join(cal, "pos")


def second_thursday(first_of_month) -> "F.Column":
    f = C.col(first_of_month)
    return F.date_add(F.next_day(F.date_sub(f, 1), "Thu"), 7)


def roll_to_open(days: DataFrame, day: str, open_days: DataFrame, forward: bool, out: str) -> DataFrame:
    """Moves each day to the nearest open weekday (forward or backward). `open_days`(date, is_open) overrides weekends."""
    step = 14
    cand = days.select("*", F.explode(F.sequence(F.lit(0), F.lit(step))).alias("_step"))
    cand = cand.withColumn("_cand", F.date_add(day, F.col("_step")) if forward else F.date_sub(day, F.col("_step")))
    cand = cand.join(open_days.select(F.col("date").alias("_cand"), "is_open"), "_cand", "left")
    ok = F.coalesce(F.col("is_open"), F.weekday("_cand") < 5)
    best = F.min_by(F.when(ok, F.col("_cand")), F.when(ok, F.col("_step"))).alias(out)
    return cand.groupBy(*days.columns).agg(best)


def option_expiry(months: DataFrame, open_days: DataFrame) -> DataFrame:
    """(month) -> expiry: second Thursday, moved back while the calendar says closed."""
    m = months.withColumn("_thu", second_thursday("month"))
    m = roll_to_open(m, "_thu", open_days, forward=False, out="expiry").drop("_thu")
    return m.withColumn("quarterly", F.month("month") % 3 == 0)


def next_expiries(days: DataFrame, open_days: DataFrame) -> DataFrame:
    """For each `today`: next monthly and next quarterly expiry (today counts)."""
    months = days.select("today", F.explode(F.sequence(F.trunc("today", "MM"), F.add_months(F.trunc("today", "MM"), 13),
                                                       F.expr("interval 1 month"))).alias("month"))
    e = option_expiry(months.select("month").distinct(), open_days)
    x = months.join(e, "month").where("expiry >= today")
    return x.groupBy("today").agg(F.min("expiry").alias("monthly"), F.min(F.when(F.col("quarterly"), F.col("expiry"))).alias("quarterly"))


def trading_lag(df: DataFrame, last: str, today: str, open_days: DataFrame, out: str = "lag") -> DataFrame:
    """Open days strictly between `last` and `today`; unknown days count when they are weekdays. NULL stays NULL."""
    keys = df.columns
    has = F.date_add(F.col(last), 1) <= F.date_sub(F.col(today), 1)
    days = df.select("*", F.explode_outer(F.when(has, F.sequence(F.date_add(F.col(last), 1), F.date_sub(F.col(today), 1)))).alias("_d"))
    days = days.join(open_days.select(F.col("date").alias("_d"), "is_open"), "_d", "left")
    n = F.sum(F.when(F.col("_d").isNotNull(), F.coalesce(F.col("is_open"), F.weekday("_d") < 5).cast("int")).otherwise(0))
    return days.groupBy(*keys).agg(n.cast("long").alias("_n")).select(
        *keys, F.when(F.col(last).isNotNull(), F.col("_n")).alias(out))
