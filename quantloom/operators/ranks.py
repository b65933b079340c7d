"""Cross-sectional average ranks within a group (usually one day).

Average rank = values below + (equal values + 1) / 2; percent rank divides by the non-null count.
Neither is Spark's rank or percent_rank.

There is one path, whatever the size. Values are unpivoted to (group, column, value) and collapse in a map-side combined
histogram, so a value that a third of a day shares is one row. Quantiles of the whole column (a mergeable sketch) cut it
into BUCKETS parts of about equal numbers of rows; each (group, part) is ranked on its own, and the totals of the parts in
front are added. A task's share is thus bounded by the part, whatever the group. The rank of each distinct value is then
joined back. Several branches read the input, so it is written to the shared folder first: whatever made it runs once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.session import kept

BUCKETS = 64


def _key(value: str, descending: bool) -> Column:
    v = F.col(value).cast("double")
    return (-v if descending else v) + F.lit(0.0)  # one zero


def _bounds(df: DataFrame, keys: list[Column]) -> list[list[float]]:
    """Quantiles of each column, BUCKETS - 1 at most, without repetitions."""
    row = df.agg(*[F.array_distinct(F.percentile_approx(k, [i / BUCKETS for i in range(1, BUCKETS)], 4 * BUCKETS)).alias(f"b{i}") for i, k in enumerate(keys)]).first()
    return [list(b or []) for b in row]


def _bucket(bounds: list[float], key: Column) -> Column:
    """How many of the bounds lie below the value: a bisection as nested conditions, which compile to plain code."""

    def among(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(key > bounds[mid], among(mid + 1, b)).otherwise(among(a, mid))

    return among(0, len(bounds))


def rank_table(df: DataFrame, group, values, descending: bool = False) -> DataFrame:
    """(…group, _c, _v, _cnt, _above, _n): for each distinct value of column number _c of `values` its count, the values in front, and the group's size.

    NULL values have no row, nor have NULL groups. Values are compared as doubles. `df` is read at once, for the quantiles.
    """
    group, values = list(group), list(values)
    keys = [_key(v, descending) for v in values]
    cells = [F.when(k.isNotNull(), F.struct(F.lit(i).alias("_c"), k.alias("_v"), _bucket(b, k).alias("_p"))) for i, (k, b) in enumerate(zip(keys, _bounds(df, keys)))]
    long = df.select(*group, (F.explode(F.array_compact(F.array(*cells))) if len(cells) > 1 else cells[0]).alias("_e")).where("_e is not null")
    one = [*group, "_c"]
    hist = long.groupBy(*group, *[F.col(f"_e.{c}").alias(c) for c in ("_c", "_p", "_v")]).agg(F.count("*").alias("_cnt"))
    part = Window.partitionBy(*one, "_p")
    inside = part.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_lt", F.coalesce(F.sum("_cnt").over(inside), F.lit(0))).withColumn("_t", F.sum("_cnt").over(part))
    hist = kept(hist, "histogram")  # read twice below; as one plan the whole count was made twice
    per = Window.partitionBy(*one)
    front = per.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = hist.where("_lt = 0").select(*one, "_p", F.coalesce(F.sum("_t").over(front), F.lit(0)).alias("_off"), F.sum("_t").over(per).alias("_n"))
    return hist.join(totals, [*one, "_p"]).select(*one, "_v", "_cnt", (F.col("_off") + F.col("_lt")).alias("_above"), "_n")


def average(pct: bool = False) -> Column:
    """The average or percent rank of a row of `rank_table`."""
    r = F.col("_above") + (F.col("_cnt") + 1) / 2
    return r / F.col("_n") if pct else r


def look_up(df: DataFrame, table: DataFrame, group, value: str, fields: dict[str, Column], number: int = 0, descending: bool = False) -> DataFrame:
    """Adds `fields`, made from the row of `rank_table` for the value of column number `number`; NULL where the value is NULL.

    The number stands in the join key as an expression that Catalyst cannot fold: the table is then the same plan for every column, and computed once.
    """
    t = table.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_c").alias("_tc"), F.col("_v").alias("_tv"), *[c.alias(f"_new_{n}") for n, c in fields.items()])
    on = [F.col(g) == F.col(f"_g{i}") for i, g in enumerate(group)]
    on += [F.when(F.col(value).isNotNull(), F.lit(number)) == F.col("_tc"), _key(value, descending) == F.col("_tv")]
    kept = [c for c in df.columns if c not in fields]
    return df.join(t, on, "left").select(*[F.col(c) for c in kept], *[F.col(f"_new_{n}").alias(n) for n in fields])


def average_ranks(df: DataFrame, group, values: dict[str, str], pct: bool = False, descending: bool = False) -> DataFrame:
    """Adds the ranks of several columns (value -> name of the rank) from one table of them all."""
    df = kept(df, "ranked")
    table = rank_table(df, group, values, descending)
    for i, (value, out) in enumerate(values.items()):
        df = look_up(df, table, group, value, {out: average(pct)}, i, descending)
    return df


def average_rank(df: DataFrame, group, value: str, out: str, pct: bool = False, descending: bool = False) -> DataFrame:
    return average_ranks(df, group, {value: out}, pct, descending)


def top_k(df: DataFrame, group, order, k: int, out: str = "rn") -> DataFrame:
    """First k rows of each group. Filtering row_number lets Catalyst keep only k rows per group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def group_total(df: DataFrame, group, value, out: str) -> DataFrame:
    """Adds the sum of a column expression over the group: a map-side combined aggregate joined back."""
    group, df = list(group), kept(df, "totalled")
    return df.join(df.groupBy(*group).agg(F.sum(value).alias(out)), group, "left").select(*df.columns, out)


def _leading(text: str) -> Column:
    """The first six bytes of a string as a number of the same order (strings compare by bytes)."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def ordinal(df: DataFrame, group, value: str, tie: str, out: str) -> DataFrame:
    """1..n by value descending, then by the string column `tie`. `value` and `tie` must not be NULL.

    Rows above come from the table of values. Among equal values, those with a smaller leading part of `tie` come from a table of the leading parts,
    and rows that share even this part are numbered by the whole string; so one value shared by a whole day is spread over many tasks.
    """
    group, df = list(group), kept(df, "ordered")
    d = look_up(df, rank_table(df, group, [value], True), group, value, {"_above": F.col("_above"), "_cnt": F.col("_cnt")}, 0, True)
    d = kept(d.withColumn("_tied", F.when(F.col("_cnt") > 1, _leading(tie))), "ties")
    same = [*group, value]
    d = look_up(d, rank_table(d, same, ["_tied"]), same, "_tied", {"_before": F.col("_above")})
    inside = F.row_number().over(Window.partitionBy(*same, "_tied").orderBy(tie))
    return d.withColumn(out, (F.col("_above") + F.coalesce("_before", F.lit(0)) + inside).cast("int")).select(*df.columns, out)
