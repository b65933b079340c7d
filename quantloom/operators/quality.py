"""Data-quality checks. Each returns Issue rows (check, severity, summary, items) or the offending rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ITEMS = 30


def lag_state(lag, ok: int, warn: int) -> Column:
    x = F.col(lag) if isinstance(lag, str) else lag
    return F.when(x.isNull(), "critical").when(x <= ok, "good").when(x <= warn, "warning").otherwise("serious")


def issue(rows: DataFrame, check: str, severity: Column | str, text: Column, order) -> DataFrame:
    """One Issue row: total count over all rows, the first items in `order`. Only the short item list is gathered."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    total = rows.agg(F.count("*").alias("n"), F.max(sev).alias("_sev")) if isinstance(severity, str) else rows.agg(F.count("*").alias("n"), sev.alias("_sev"))
    first = rows.select(F.struct(*order).alias("_o"), text.alias("_t")).orderBy("_o").limit(MAX_ITEMS)
    items = first.agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_t"))), lambda s: s["_t"]).alias("items"))
    return total.select(F.lit(check).alias("check"), F.when(F.col("n") > 0, F.col("_sev")).otherwise("ok").alias("severity"),
                        F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit("건"))).otherwise("없음").alias("summary"), items.scalar().alias("items"))


def price_jumps(rets: DataFrame, universe: DataFrame, limit: float = 0.305) -> DataFrame:
    """Rows beyond the daily price limit (not the first day, with volume), `inside` = in the universe. rets: base_price_returns."""
    bad = rets.where((F.abs("ret") > limit) & ~F.col("first_day") & (F.col("volume") > 0))
    return bad.join(universe.select("code", F.lit(True).alias("inside")), "code", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def price_jump_issue(bad: DataFrame) -> DataFrame:
    text = F.concat(F.date_format("date", "MM-dd"), F.lit(" "), F.col("name"), F.lit("("), F.col("code"), F.lit(") "), F.format_string("%+.1f%%", F.col("ret") * 100),
                    F.when(F.col("inside"), " [유니버스]").otherwise(""))
    sev = F.when(F.coalesce(F.bool_or("inside"), F.lit(False)), "serious").otherwise("warning")
    return issue(bad, "price_jumps", sev, text, ["date", "code"])


def adjustments(rets: DataFrame, tol: float = 1e-6) -> DataFrame:
    return rets.where(F.abs(F.col("factor") - 1) > tol)


def adjustment_issue(adj: DataFrame) -> DataFrame:
    text = F.concat(F.date_format("date", "MM-dd"), F.lit(" "), F.col("name"), F.lit("("), F.col("code"), F.lit(") "), F.format_string("%.4f", "factor"))
    return issue(adj, "adjustments", "info", text, ["date", "code"])


def flow_exceeds_value(flows: DataFrame, values: DataFrame) -> DataFrame:
    """Net flows larger than the day's traded value. flows: (date, code, who, net), values: (date, code, value)."""
    return flows.join(values.where("value > 0").select("date", "code", "value"), ["date", "code"]).where(F.abs("net") > F.col("value") * 1.001)


def holiday_conflicts(holidays: DataFrame, days: DataFrame) -> DataFrame:
    return holidays.select("date").intersect(days.select("date"))


def missing_days(cal: DataFrame, saved: DataFrame, last: int = 10) -> DataFrame:
    """(dataset, n_missing, last_missing): calendar days each dataset lacks. saved: (dataset, date)."""
    have = saved.select("dataset", "date").distinct()
    per = have.join(cal.select("date"), "date").groupBy("dataset").agg(F.collect_set("date").alias("_have"))
    every = cal.agg(F.sort_array(F.collect_list("date"))).scalar()
    # both arrays are bounded by the calendar
    gap = F.array_except(every, "_have")
    return per.where(F.size(gap) > 0).select("dataset", F.size(gap).cast("long").alias("n_missing"), F.slice(F.sort_array(gap), -F.least(F.lit(last), F.size(gap)), last).alias("last_missing"))


def stale_keys(keys: DataFrame, table: DataFrame, cal: DataFrame, asof, max_lag: int) -> DataFrame:
    """Keys whose last record lags `asof` by more than max_lag trading days, or that have none. (code, last, lag)."""
    last = table.groupBy("code").agg(F.max("date").alias("last"))
    d = keys.select("code").distinct().join(last, "code", "left")
    end = cal.where(F.col("date") <= asof).agg(F.max("pos")).scalar()
    from quantloom.operators.calendar import day_map

    m = day_map(cal).select(F.col("day").alias("last"), "last_pos")
    d = d.join(m, "last", "left").withColumn("lag", F.greatest(end - F.col("last_pos"), F.lit(0)).cast("long"))
    return d.where(F.col("last").isNull() | (F.col("lag") > max_lag)).select("code", "last", F.when(F.col("last").isNotNull(), F.col("lag")).alias("lag"))


def invalid_cap_days(caps: DataFrame) -> DataFrame:
    g = caps.groupBy("date").agg(F.coalesce(F.bool_or(F.col("cap") > 0), F.lit(False)).alias("_ok"))
    return g.where(~F.col("_ok")).select("date")


def high_loan_rate(credit: DataFrame, limit: float = 20.0) -> DataFrame:
    last = credit.groupBy("code").agg(F.max_by("loan_rate", "date").alias("loan_rate"))
    return last.where(F.col("loan_rate") > limit)


SEVERITIES = ("critical", "serious", "warning", "info", "ok")


def all_checks(checks) -> DataFrame:
    """(check, severity, n) of (name, offending rows, severity) triples: severity is a word, or an aggregate over the rows; without rows it is ok."""
    found = None
    for name, rows, severity in checks:
        sev = F.lit(severity) if isinstance(severity, str) else severity
        one = rows.agg(F.count(F.lit(1)).alias("n"), (F.max(sev) if isinstance(severity, str) else sev).alias("_s"))
        one = one.select(F.lit(name).alias("check"), F.when(F.col("n") > 0, F.col("_s")).otherwise("ok").alias("severity"), "n")
        found = one if found is None else found.unionAll(one)
    return found


def severity_table(issues: DataFrame) -> DataFrame:
    """One row with the number of checks of each severity, zero included."""
    return issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


def delisted_guess(bars: DataFrame, today, gap: int = 20) -> DataFrame:
    g = bars.groupBy("code").agg(F.max("date").alias("last"))
    return g.where(F.datediff(today, F.col("last")) > gap)


def survivorship_audit(members: DataFrame, bars: DataFrame, today, gap: int = 20) -> DataFrame:
    """One row: members ever, how many lack bars, how many look delisted, and whether the universe is survivorship-safe."""
    ever = members.select("code").distinct()
    last = bars.groupBy("code").agg(F.max("date").alias("last"))
    j = ever.join(last, "code", "left")
    return j.agg(F.count("*").alias("members_ever"), F.sum(F.col("last").isNull().cast("long")).alias("without_bars"),
                 F.sum(F.coalesce((F.datediff(today, F.col("last")) > gap).cast("long"), F.lit(0))).alias("delisted")).withColumn("safe", (F.col("members_ever") > 0) & (F.col("without_bars") == 0))


def dataset_status(saved: DataFrame, today, open_days: DataFrame, ok: int = 1, warn: int = 3) -> DataFrame:
    """Per dataset: first and last date, day count, open-day lag to today and its state. saved: (dataset, date)."""
    from quantloom.operators.calendar import trading_lag

    g = saved.groupBy("dataset").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.countDistinct("date").alias("days"))
    g = trading_lag(g.withColumn("today", today), "last", "today", open_days).drop("today")
    return g.withColumn("state", lag_state("lag", ok, warn))


def expected_quarter(days: DataFrame) -> DataFrame:
    """For each `today`: newest period that should be filed (quarter end + 46 days, + 90 for the fourth)."""
    from quantloom.functions import cols as C

    cand = days.select("today", F.explode(F.sequence(F.year("today") * 4 - 3, F.year("today") * 4 + 4)).alias("period"))
    due = F.date_add(C.quarter_end("period"), F.when(C.period_quarter("period") == 4, 90).otherwise(46))
    return cand.where(due <= F.col("today")).groupBy("today").agg(F.max("period").alias("period"))


def full_coverage_from(tidy: DataFrame, more_than: int = 100) -> DataFrame:
    g = tidy.groupBy("date").agg(F.countDistinct("code").alias("n"))
    return g.where(F.col("n") > more_than).agg(F.min("date").alias("full_from"))
