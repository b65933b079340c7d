"""Investor flows: alignment to the market grid, normalisation by lagged liquidity, window sums, streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import cols as C
from quantloom.operators import calendar as K

INVESTORS = ("frgn", "inst")


def flow_grid(bars: DataFrame, flows: DataFrame, cal: DataFrame, investors=INVESTORS) -> DataFrame:
    """Grid with traded value and one net column per investor group."""
    net = flows.groupBy("date", "code").pivot("who", list(investors)).agg(F.sum("net"))
    b = bars.select("date", "code", "value").join(net, ["date", "code"], "left")
    return K.grid(b, cal, ["value", *investors])


def flow_features(grid: DataFrame, investors=INVESTORS, lag: int = 1, window: int = 20) -> DataFrame:
    """norm_<who> = flow_{t-lag} / median(value_{t-window..t-1}); flow_<who> = its window sum. Both use only days before t."""
    w = C.by_code()
    g = C.rolled_median(grid, "value", window, w, "_med", max(5, window // 2), shift=1)
    g = g.withColumn("_med", C.positive("_med"))
    for who in investors:
        g = g.withColumn(f"norm_{who}", C.at(who, -lag, w) / F.col("_med"))
    for who in investors:
        g = g.withColumn(f"flow_{who}", C.rolled(F.sum, f"norm_{who}", window, w, window // 2))
    return g.drop("_med")


def long_flows(g: DataFrame, investors=INVESTORS) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(w).alias("who"), F.col(f"norm_{w}").alias("norm"), F.col(f"flow_{w}").alias("flow_20")) for w in investors]))
    return g.select("code", "pos", cells.alias("_c")).select("code", "pos", "_c.who", "_c.norm", "_c.flow_20")


def aggregate_flow(flows: DataFrame, window: int = 20, min_obs: int = 15) -> DataFrame:
    """(who, date, pos, net): member flows summed per day (NULL when none) and their rolling sum."""
    d = flows.groupBy("who", "date", "pos").agg(F.sum("net").alias("net"))
    w = Window.partitionBy("who").orderBy("pos")
    return d.withColumn("net_20", C.rolled(F.sum, "net", window, w, min_obs))


def window_sums(flows: DataFrame, cal: DataFrame, windows=(1, 5, 20, 60), keys=("code", "who")) -> DataFrame:
    """Sums over the last n market days per key, NULL when no value falls in the window."""
    last = cal.agg(F.max("pos")).scalar()
    f = flows.join(cal, "date")
    return f.groupBy(*keys).agg(*[F.sum(F.when(F.col("pos") > last - n, F.col("net"))).alias(f"sum_{n}") for n in windows])


def streaks(flows: DataFrame, cal: DataFrame, lookback: int = 120, keys=("code", "who")) -> DataFrame:
    """Signed length of the run of equal signs ending on the last market day; zero or a missing day breaks the run."""
    last = cal.agg(F.max("pos")).scalar()
    f = flows.join(cal, "date").where(F.col("pos") > last - lookback)
    w = Window.partitionBy(*keys).orderBy(F.col("pos").desc())
    f = f.withColumn("_rn", F.row_number().over(w)).withColumn("_first", F.first("net").over(w))
    unbroken = (last - F.col("pos") + 1 == F.col("_rn")) & (F.signum("net") == F.signum("_first")) & (F.col("net") != 0)
    f = f.withColumn("_ok", F.min(F.coalesce(unbroken, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return f.groupBy(*keys).agg((F.sum("_ok") * F.max(F.signum("_first"))).cast("long").alias("streak"))


def window_returns(grid: DataFrame, cal: DataFrame, windows=(1, 5, 20, 60)) -> DataFrame:
    """n-day returns of the last market day, prices forward-filled."""
    last = cal.agg(F.max("pos")).scalar()
    w = C.by_code()
    g = grid.withColumn("_px", F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda n: F.max(F.when(F.col("pos") == last - n, F.col("_px")))
    return g.groupBy("code").agg(*[C.change(at(0), at(n)).alias(f"ret_{n}") for n in windows])


def market_flow_series(totals: DataFrame, n: int = 260) -> DataFrame:
    """(market, points): the last n days of each market's investor totals, oldest first. totals: (market, date, …groups)."""
    from quantloom.operators import ranks

    groups = [c for c in totals.columns if c not in ("market", "date")]
    t = ranks.top_k(totals, ["market"], [F.col("date").desc()], n)
    return t.groupBy("market").agg(F.sort_array(F.collect_list(F.struct("date", *groups))).alias("points"))
