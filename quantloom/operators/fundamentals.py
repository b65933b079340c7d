"""Financial facts: consolidated-first pivot, quarterly values, known-time steps, factors, valuation and earnings tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import cols as C
from quantloom.operators import calendar as K

FLOW_ITEMS = ("revenue", "op", "ni")
STOCK_ITEMS = ("assets", "liab", "equity")
STALE_DAYS = 455


def consolidated_first(fin: DataFrame, asof=None) -> DataFrame:
    """(stock_code, period, items…, rcept_dt): consolidated rows, separate ones only where no consolidated row exists.

    One map-side combined aggregate holds both statements side by side; no pivot job and no window.
    """
    d = fin if asof is None else fin.where(F.col("rcept_dt") <= F.lit(asof).cast("date"))
    cfs = F.col("fs") == "CFS"
    aggs = [F.bool_or(cfs).alias("_has")]
    for item in (*FLOW_ITEMS, *STOCK_ITEMS):
        for tag, cond in (("c", cfs), ("o", ~cfs)):
            aggs.append(F.max(F.when(cond & (F.col("item") == item), F.col("value"))).alias(f"{item}_{tag}"))
    aggs += [F.max(F.when(cfs, F.col("rcept_dt"))).alias("r_c"), F.max(F.when(~cfs, F.col("rcept_dt"))).alias("r_o")]
    g = d.groupBy("stock_code", C.period("year", "q").alias("period")).agg(*aggs)
    pick = lambda x: F.when(F.col("_has"), F.col(f"{x}_c")).otherwise(F.col(f"{x}_o"))
    return g.select("stock_code", "period", *[pick(i).alias(i) for i in (*FLOW_ITEMS, *STOCK_ITEMS)], pick("r").alias("rcept_dt"))


def quarterly(wide: DataFrame) -> DataFrame:
    """Year-to-date P&L -> quarter values: Q1 as is, else minus the previous row when that is the previous quarter."""
    w = Window.partitionBy("stock_code").orderBy("period")
    q1 = (F.col("period") - 1) % 4 == 0
    near = F.lag("period").over(w) == F.col("period") - 1
    return wide.select("stock_code", "period", *[F.when(q1, F.col(i)).when(near, F.col(i) - F.lag(i).over(w)).alias(i) for i in FLOW_ITEMS], *STOCK_ITEMS, "rcept_dt")


def _span(a: int, b: int):
    return Window.partitionBy("stock_code").orderBy("period").rangeBetween(a, b)


def ttm(item: str, back: int = 0) -> Column:
    """Sum of four consecutive quarters ending `back` quarters ago; all four must exist."""
    w = _span(-3 - back, -back)
    return F.when(F.count(item).over(w) == 4, F.sum(item).over(w))


def ago(item: str, n: int = 4) -> Column:
    return F.max(item).over(_span(-n, -n))


def known_fundamentals(q: DataFrame) -> DataFrame:
    """(stock_code, period, rcept_dt, ni_ttm, equity, avg_eq): average equity needs both this and last year's to be positive."""
    eq0 = ago("equity")
    return q.select("stock_code", "period", "rcept_dt", ttm("ni").alias("ni_ttm"), "equity",
                    F.when((F.col("equity") > 0) & (eq0 > 0), (F.col("equity") + eq0) / 2).alias("avg_eq"))


def step_panels(grid: DataFrame, known: DataFrame, cal: DataFrame, values=("ni_ttm", "equity", "avg_eq")) -> DataFrame:
    """Adds the known-time values to a (code, pos, …) grid.

    Facts count from the trading day after receipt; the newest period wins within a day, late restatements of older periods
    drop out, every column carries its own last non-null value, and all are NULL once the quarter end is too old.
    Facts and grid rows meet in a union ordered by code and position, so the as-of join is one window.
    """
    k = K.next_trading_day(known.where("rcept_dt is not null"), "rcept_dt", cal, strict=True, out="date").where("date is not null").join(cal, "date")
    k = k.groupBy(F.col("stock_code").alias("code"), "pos").agg(F.max_by(F.struct("period", *values), "period").alias("_k")).select("code", "pos", "_k.*")
    w = C.by_code()
    k = k.withColumn("_top", F.max("period").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("period = _top").drop("_top")
    k = k.withColumn("qend", C.quarter_end("period")).drop("period")
    cols = [*values, "qend"]
    rest = [c for c in grid.columns if c not in ("code", "pos")]
    both = grid.withColumn("_grid", F.lit(1)).unionByName(k.withColumn("_grid", F.lit(0)), allowMissingColumns=True)
    run = Window.partitionBy("code").orderBy("pos", "_grid").rowsBetween(Window.unboundedPreceding, 0)
    for c in cols:
        both = both.withColumn(c, F.last(c, ignorenulls=True).over(run))
    both = both.where("_grid = 1").join(cal.withColumnRenamed("date", "_day"), "pos")
    fresh = F.datediff("_day", "qend") <= STALE_DAYS
    return both.select("code", "pos", *rest, *[F.when(fresh, F.col(c)).alias(c) for c in values])


def fundamental_features(stepped: DataFrame) -> DataFrame:
    cap, eq = C.positive("cap"), C.positive("equity")
    return (stepped.withColumn("bp", eq / cap).withColumn("ep", F.col("ni_ttm") / cap).withColumn("roe", F.col("ni_ttm") / C.positive("avg_eq")))


def rank_average(df: DataFrame, features, group=("pos",), out: str = "score", ok: str | None = None, jointly: bool = False) -> DataFrame:
    """Mean of percent ranks, NULL when any is NULL. jointly: rank only rows where all features exist."""
    from functools import reduce

    from quantloom.operators import ranks

    cond = F.col(ok) if ok else F.lit(True)
    if jointly:
        cond = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features], cond)
    d = df.withColumns({f"_x{i}": F.when(cond, F.col(f)) for i, f in enumerate(features)})
    d = ranks.average_ranks(d, group, {f"_x{i}": f"_p{i}" for i in range(len(features))}, pct=True)
    total = reduce(lambda a, b: a + b, [F.col(f"_p{i}") for i in range(len(features))])
    return d.withColumn(out, total / len(features)).select(*df.columns, out)


def suspect(ni, eq, cap) -> Column:
    """Figures that look like unit errors."""
    return F.coalesce(F.abs(C.col(ni)) > 5 * C.col(cap), F.lit(False)) | F.coalesce(C.col(eq) > 50 * C.col(cap), F.lit(False))


def caps_with_fundamentals(caps: DataFrame, stepped: DataFrame) -> DataFrame:
    """caps (date, code, market, cap) left join (date, code, ni, eq), suspect figures masked, only positive caps."""
    d = caps.join(stepped, ["date", "code"], "left").where("cap > 0")
    bad = suspect("ni", "eq", "cap")
    return d.withColumn("_bad", bad).withColumn("ni", F.when(~F.col("_bad"), F.col("ni"))).withColumn("eq", F.when(~F.col("_bad"), F.col("eq"))).drop("_bad")


def market_valuation(facts: DataFrame) -> DataFrame:
    """Per (date, market): PER, PBR, ROE over names with both facts, coverage of the market cap."""
    both = F.col("ni").isNotNull() & F.col("eq").isNotNull()
    s = lambda c: F.coalesce(F.sum(F.when(both, F.col(c))), F.lit(0.0))
    g = facts.groupBy("date", "market").agg(s("ni").alias("earn"), s("eq").alias("_b"), s("cap").alias("mcap"), F.sum("cap").alias("_all"),
                                            F.sum(both.cast("long")).alias("n"))
    return g.select("date", "market", (F.col("mcap") / C.positive("earn")).alias("per"), (F.col("mcap") / C.positive("_b")).alias("pbr"),
                    (F.col("earn") / C.positive("_b")).alias("roe"), (F.col("mcap") / F.col("_all")).alias("cover"), "earn", "mcap", "n")


def valuation_metrics(q: DataFrame, caps: DataFrame) -> DataFrame:
    """One row per code at its latest quarter. caps: (code, mcap)."""
    eq = F.col("equity")
    last = F.max("period").over(Window.partitionBy("stock_code"))
    d = q.select("stock_code", "period", "rcept_dt", "liab", eq, ago("equity").alias("_eq0"), *[ttm(i).alias(f"{i}_ttm") for i in FLOW_ITEMS],
                 ttm("ni", 4).alias("_ni_prev"), ttm("op", 4).alias("_op_prev"),
                 C.growth("revenue", ago("revenue")).alias("rev_yoy"), C.growth("op", ago("op")).alias("op_yoy"), last.alias("_last"))
    d = d.where("period = _last").drop("_last").withColumnRenamed("stock_code", "code").join(caps.select("code", "mcap"), "code", "left")
    d = d.withColumn("suspect", F.coalesce(F.col("mcap") != 0, F.lit(False)) & suspect("ni_ttm", "equity", "mcap"))
    for c in ("ni_ttm", "op_ttm", "revenue_ttm", "equity", "_eq0"):
        d = d.withColumn(c, F.when(~F.col("suspect"), F.col(c)))
    avg_eq = F.when(eq.isNotNull(), (eq + F.coalesce("_eq0", eq)) / 2)
    return d.select(
        "code", "period", C.quarter_label("period").alias("label"), "rcept_dt", "mcap", F.col("revenue_ttm").alias("rev_ttm"), "op_ttm", "ni_ttm", "equity",
        (F.col("mcap") / C.positive("ni_ttm")).alias("per"), (F.col("mcap") / C.positive("equity")).alias("pbr"),
        (F.col("ni_ttm") / F.when(avg_eq > 0, avg_eq)).alias("roe"), (F.col("op_ttm") / C.positive("revenue_ttm")).alias("opm"),
        (F.col("liab") / C.positive("equity")).alias("debt"), "rev_yoy", "op_yoy", C.growth("ni_ttm", "_ni_prev").alias("ni_ttm_chg"),
        C.growth("op_ttm", "_op_prev").alias("op_ttm_chg"), F.coalesce(F.col("ni_ttm") <= 0, F.lit(False)).alias("loss"), "suspect")


def season_period(q: DataFrame, min_companies: int = 1000) -> DataFrame:
    """One row: the latest period reported by enough companies."""
    g = q.groupBy("period").agg(F.countDistinct("stock_code").alias("n"))
    return g.where(F.col("n") >= min_companies).agg(F.max("period").alias("period"))


def yoy_pairs(q: DataFrame, caps: DataFrame, period: Column) -> DataFrame:
    """Quarter against the same quarter last year, unit errors dropped, YoY on positive bases, turn labels."""
    prev = [ago(i).alias(f"{i}_p") for i in FLOW_ITEMS]
    d = q.select("stock_code", "period", *FLOW_ITEMS, "rcept_dt", *prev).where(F.col("period") == period)
    d = d.withColumnRenamed("stock_code", "code").join(caps.select("code", "mcap"), "code", "left")
    big = lambda c: F.coalesce(F.abs(c) > 5 * F.col("mcap"), F.lit(False))
    d = d.where(~(big(F.col("ni")) | big(F.col("ni_p"))))
    op, op_p = F.col("op"), F.col("op_p")
    turn = C.first_match([("흑자전환", (op_p <= 0) & (op > 0)), ("적자전환", (op_p > 0) & (op <= 0)), ("적자지속", (op_p <= 0) & (op <= 0))], "")
    return d.withColumn("rev_yoy", C.growth("revenue", "revenue_p")).withColumn("op_yoy", C.growth("op", "op_p")).withColumn("turn", turn)


def season_summary(pairs: DataFrame, *groups: str) -> DataFrame:
    """n, share improving, sums and YoY of sums; a rollup gives the overall row and every group in one pass."""
    b = pairs.where("op is not null and op_p is not null")
    g = (b.rollup(*groups) if groups else b.groupBy()).agg(
        F.count("*").alias("n"), F.avg((F.col("op") > F.col("op_p")).cast("double")).alias("up"), F.sum("op").alias("op"), F.sum("op_p").alias("op_p"))
    return g.withColumn("op_sum_yoy", C.growth("op", "op_p"))


def coverage_stats(member_days: DataFrame, value: str = "ni_ttm") -> DataFrame:
    """Share of member-days with a fact, and the number of members that never have one."""
    per = member_days.groupBy("code").agg(F.count("*").alias("d"), F.count(value).alias("h"))
    return per.agg((F.sum("h") / F.sum("d")).alias("coverage"), F.sum((F.col("h") == 0).cast("long")).alias("members_without"))


def per_share_bands(stepped: DataFrame, cal: DataFrame, step: int = 5) -> DataFrame:
    """(code, date, close, eps, bps) every `step`-th market day counted from the end. stepped: grid with cap, close, ni_ttm, equity."""
    days = K.every_kth_keep_last(cal, step)
    shares = C.div(C.positive("cap"), "close")
    return stepped.join(days, "pos").select("code", "date", "close", (F.col("ni_ttm") / shares).alias("eps"), (C.positive("equity") / shares).alias("bps"))
