"""Point-in-time universe: buffered monthly selection, as-of membership, liquidity filter, eligibility, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import cols as C
from quantloom.functions import rules as R
from quantloom.operators import calendar as K
from quantloom.operators import ranks
from quantloom.session import kept


def is_common_stock(code, name) -> Column:
    """Six characters ending in 0 and a name that is no trust, fund or acquisition vehicle."""
    c = C.col(code)
    return (F.length(c) == 6) & c.endswith("0") & ~F.coalesce(C.col(name).rlike(R.NOT_COMMON_NAME), F.lit(False))


def caps_before(caps: DataFrame, snaps: DataFrame, cal: DataFrame) -> DataFrame:
    """(snap_date, code, cap): market caps of the last trading day strictly before each snapshot date."""
    m = K.day_map(cal, pad_after=62).select(F.date_add("day", 1).alias("snap_date"), F.col("last_pos").alias("pos"))
    day = snaps.join(m, "snap_date").join(cal, "pos").select("snap_date", "date")
    return caps.join(day, "date").select("snap_date", *[c for c in caps.columns if c != "date"])


def buffered_universe(caps: DataFrame, top: int = 200, buffer: int = 220, keys=()) -> DataFrame:
    """(…keys, snap_date, code): previous members ranked <= buffer stay (best first, at most top), the rest is filled by rank.

    Ranking is distributed; only ranks <= buffer can ever be chosen, so the month-by-month fold sees
    buffer x months codes per market whatever the size of the market.
    """
    if buffer < top:
        raise ValueError("buffer must be at least top")
    ranked = ranks.top_k(caps.where("cap > 0"), [*keys, "snap_date"], [F.col("cap").desc(), F.col("code")], buffer, "rank")
    months = ranked.groupBy(*keys, "snap_date").agg(F.sort_array(F.collect_list(F.struct("rank", "code"))).alias("_r"))
    months = months.select(*keys, "snap_date", F.transform("_r", lambda x: x["code"]).alias("codes"))
    hist = months.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("snap_date", "codes"))).alias("_m"))
    start = F.struct(F.array().cast("array<string>").alias("prev"), F.array().cast("array<struct<snap_date:date,codes:array<string>>>").alias("out"))

    def month(acc, m):
        keep = F.slice(F.filter(m["codes"], lambda c: F.array_contains(acc["prev"], c)), 1, top)
        fill = F.filter(m["codes"], lambda c: ~F.array_contains(keep, c))
        chosen = F.slice(F.concat(keep, fill), 1, top)
        return F.struct(chosen.alias("prev"), F.concat(acc["out"], F.array(F.struct(m["snap_date"].alias("snap_date"), chosen.alias("codes")))).alias("out"))

    folded = hist.select(*keys, F.explode(F.aggregate("_m", start, month)["out"]).alias("_o"))
    return folded.select(*keys, F.col("_o.snap_date").alias("snap_date"), F.explode("_o.codes").alias("code"))


def common_universe(caps: DataFrame, top: int = 200, buffer: int = 220, keys=()) -> DataFrame:
    """`buffered_universe` of common shares only: other shares are dropped before the ranking, so they take no rank. caps: (…keys, snap_date, code, name, cap)."""
    return buffered_universe(caps.where(is_common_stock("code", "name")), top, buffer, keys)


def snapshot_of(days: DataFrame, membership: DataFrame) -> DataFrame:
    """(date, snap_date): the latest snapshot <= date for every calendar day; days before the first are dropped."""
    snaps = membership.select("snap_date").distinct()
    w = Window.orderBy("snap_date")
    spans = snaps.select("snap_date", F.lead("snap_date").over(w).alias("_to"))
    last = days.agg(F.max("date")).scalar()
    end = F.date_sub(F.coalesce("_to", F.date_add(last, 1)), 1)
    spans = spans.where(end >= F.col("snap_date")).select("snap_date", F.explode(F.sequence(F.col("snap_date"), end)).alias("date"))
    return days.select("date").join(spans, "date")


def members_asof(days: DataFrame, membership: DataFrame) -> DataFrame:
    """(date, code) for every day and every code in that day's snapshot."""
    return snapshot_of(days, membership).join(membership, "snap_date").select("date", "code")


def only_members(df: DataFrame, membership: DataFrame, date: str = "date") -> DataFrame:
    """Rows whose code is in the snapshot valid on their date (equi semi join on snapshot and code)."""
    days = df.select(F.col(date).alias("date")).distinct()
    snap = snapshot_of(days, membership).select(F.col("date").alias(date), "snap_date")
    return df.join(snap, date).join(membership.select("snap_date", "code"), ["snap_date", "code"], "left_semi").select(*df.columns)


def flag_members(df: DataFrame, membership: DataFrame, out: str = "member") -> DataFrame:
    snap = snapshot_of(df.select("date").distinct(), membership)
    m = membership.select("snap_date", "code", F.lit(True).alias(out))
    return df.join(snap, "date", "left").join(m, ["snap_date", "code"], "left").withColumn(out, F.coalesce(out, F.lit(False))).drop("snap_date")


def dollar_volume(grid: DataFrame, window: int = 20, out: str = "dv") -> DataFrame:
    """Median traded value of the `window` market days before t."""
    g = grid.withColumn("_tv", F.col("close") * F.col("volume"))
    return C.rolled_median(g, "_tv", window, C.by_code(), out, max(5, window // 2), shift=1).drop("_tv")


def restrict_universe(df: DataFrame, drop: float = 0.2, min_names: int = 30, dv: str = "dv", member: str | None = None,
                      out: str = "in_universe") -> DataFrame:
    """True where the liquidity percent rank among candidates exceeds `drop`; thin days keep all candidates."""
    base = F.col(dv).isNotNull() & (F.col(member) if member else F.lit(True))
    d = df.withColumn("_base", base).withColumn("_dvb", F.when(base, F.col(dv)))
    if drop <= 0:
        return d.withColumn(out, F.col("_base")).drop("_base", "_dvb")
    d = kept(d, "liquidity")
    table = ranks.rank_table(d, ["pos"], ["_dvb"]).withColumn("_in", ranks.average(pct=True) > drop)
    survivors = table.groupBy("pos").agg(F.sum(F.when(F.col("_in"), F.col("_cnt")).otherwise(0)).alias("_kept"))
    table = table.join(survivors, "pos").withColumn("_in", F.col("_in") | (F.col("_kept") < min_names))
    return ranks.look_up(d, table, ["pos"], "_dvb", {out: F.col("_in")}).withColumn(out, F.coalesce(out, F.lit(False))).drop("_base", "_dvb")


def eligible(grid: DataFrame, universe: str = "in_universe", min_days: int = 252, out: str = "ok") -> DataFrame:
    seen = F.count("close").over(C.by_code().rowsBetween(Window.unboundedPreceding, 0))
    return grid.withColumn(out, F.col(universe) & (seen >= min_days))


def attach_labels(grid: DataFrame, h: int = 5, kind: str = "cs_rank", universe: str = "in_universe", out: str = "label") -> DataFrame:
    """Forward return inside the universe only, raw or as the percent rank of the day."""
    fwd = C.change(C.at("close", h, C.by_code()), "close")
    g = grid.withColumn("_fwd", fwd).withColumn("_fwd", F.when(F.col(universe), F.col("_fwd")))
    if kind == "raw":
        return g.withColumnRenamed("_fwd", out)
    if kind != "cs_rank":
        raise ValueError(kind)
    return ranks.average_rank(g, ["pos"], "_fwd", out, pct=True).drop("_fwd")
