"""Column -> Column helpers. NULL is the only missing value; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c) -> Column:
    """'1,234' -> 1234.0; blank, '-' and anything unreadable -> NULL."""
    return F.replace(F.trim(col(c)), F.lit(","), F.lit("")).try_cast("double")


def ymd(c) -> Column:
    return F.try_to_timestamp(col(c), F.lit("yyyyMMdd")).cast("date")


def code6(c) -> Column:
    return F.when(F.length(col(c)) < 6, F.lpad(col(c), 6, "0")).otherwise(col(c))


def positive(c) -> Column:
    return F.when(col(c) > 0, col(c))


def div(a, b) -> Column:
    """a / b, NULL where b is 0 (ANSI sessions would raise)."""
    return F.try_divide(col(a), col(b))


def change(now, base) -> Column:
    return div(now, base) - 1


def growth(now, base) -> Column:
    """now/base - 1, only on a positive base."""
    return F.when(col(base) > 0, col(now) / col(base) - 1)


def clip(c, lo, hi) -> Column:
    x = col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def contains_any(c, words) -> Column:
    return reduce(lambda a, b: a | b, [col(c).contains(w) for w in words])


def starts_any(c, words) -> Column:
    return reduce(lambda a, b: a | b, [col(c).startswith(w) for w in words])


def first_match(rules, default=None) -> Column:
    """Ordered (label, condition) pairs as one CASE: the first true condition gives the label."""
    out = None
    for label, cond in rules:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default)) if default is not None else out


def squeeze(c) -> Column:
    """Runs of white space become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def unspace(c) -> Column:
    return F.regexp_replace(col(c), r"\s+", "")


def period(year, q) -> Column:
    return (col(year) * 4 + col(q)).cast("int")


def period_year(p) -> Column:
    return F.floor((col(p) - 1) / 4).cast("int")


def period_quarter(p) -> Column:
    return ((col(p) - 1) % 4 + 1).cast("int")


def quarter_end(p) -> Column:
    return F.last_day(F.make_date(period_year(p), (period_quarter(p) * 3).cast("int"), F.lit(1)))


def quarter_label(p) -> Column:
    """8105 -> '26.1Q'."""
    return F.concat(F.substring(period_year(p).cast("string"), 3, 2), F.lit("."),
                    period_quarter(p).cast("string"), F.lit("Q"))


def iso_seconds(c) -> Column:
    """'PT1H2M3S' -> 3723; NULL when the text is not such a duration."""
    pat = r"^P(?:(\d+)D)?T?(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    part = [F.coalesce(F.regexp_extract(col(c), pat, i).try_cast("long"), F.lit(0)) for i in range(1, 5)]
    d, h, m, s = part
    return F.when(col(c).rlike(pat), ((d * 24 + h) * 60 + m) * 60 + s)


# ---- windows over a dense market grid (one row per key and calendar position, see calendar.grid) ----

def by_code(*keys, order="pos"):
    return Window.partitionBy(*(keys or ("code",))).orderBy(order)


def at(value, offset: int, w) -> Column:
    """Value `offset` grid rows away (negative = past)."""
    return F.lag(col(value), -offset).over(w) if offset < 0 else F.lead(col(value), offset).over(w)


def rolled(fn, value, n: int, w, min_obs: int | None = None, shift: int = 0) -> Column:
    """fn over the last n grid rows ending `shift` rows ago, NULL below min_obs values."""
    frame = w.rowsBetween(-(n - 1) - shift, -shift)
    need = n if min_obs is None else min_obs
    return F.when(F.count(col(value)).over(frame) >= need, fn(col(value)).over(frame))


def median(c) -> Column:
    return F.percentile(col(c), F.lit(0.5))


def rolled_median(df: DataFrame, value: str, n: int, w, out: str, min_obs: int | None = None, shift: int = 0) -> DataFrame:
    """Adds `rolled(median, …)` for a short window: its values as a sorted array, which is far cheaper per row than a table of counts."""
    frame = w.rowsBetween(-(n - 1) - shift, -shift)
    d = df.withColumn("_xs", F.collect_list(value).over(frame)).withColumn("_xs", F.sort_array("_xs"))
    size = F.size("_xs")
    lo, hi = F.get("_xs", F.floor((size - 1) / 2).cast("int")), F.get("_xs", F.floor(size / 2).cast("int"))
    middle = F.when(lo == hi, lo).otherwise(lo * 0.5 + hi * 0.5)
    return d.withColumn(out, F.when(size >= (n if min_obs is None else min_obs), middle)).drop("_xs")


def std(c) -> Column:
    return F.stddev_samp(col(c))


# ---- normal distribution ----
# Rational approximations of erf/erfc (Cody 1969) and of the normal quantile (AS241, Wichura 1988).
ERF_NUM = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_DEN = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
ERFC_NUM = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
            8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
ERFC_DEN = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
            3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
TAIL_NUM = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
            1.60837851487422766e-2, 6.58749161529837803e-4)
TAIL_DEN = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
PPF_MID_NUM = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
               1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0)
PPF_MID_DEN = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
               5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0)
PPF_LOW_NUM = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
               3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0)
PPF_LOW_DEN = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
               6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0)
PPF_FAR_NUM = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
               2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0)
PPF_FAR_DEN = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
               1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0)


def _poly(coefs, x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefs[1:], F.lit(coefs[0]))


def norm_cdf(z) -> Column:
    z = col(z)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    sq = x * x
    inv = F.lit(1.0) / F.when(sq > 0, sq)
    erf_mid = x * _poly(ERF_NUM, sq) / _poly(ERF_DEN, sq)
    erfc_out = F.exp(-sq) * _poly(ERFC_NUM, x) / _poly(ERFC_DEN, x)
    erfc_far = F.exp(-sq) / x * (F.lit(0.5641895835477562869) - inv * _poly(TAIL_NUM, inv) / _poly(TAIL_DEN, inv))
    upper = F.when(x <= 0.46875, (F.lit(1.0) - erf_mid) / 2).when(x <= 4.0, erfc_out / 2).otherwise(erfc_far / 2)
    return F.when(z.isNotNull(), F.when(z > 0, 1.0 - upper).otherwise(upper))


def norm_ppf(p) -> Column:
    p = col(p)
    q = p - 0.5
    r0 = F.lit(0.180625) - q * q
    mid = q * _poly(PPF_MID_NUM, r0) / _poly(PPF_MID_DEN, r0)
    r = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    low = _poly(PPF_LOW_NUM, r - 1.6) / _poly(PPF_LOW_DEN, r - 1.6)
    far = _poly(PPF_FAR_NUM, r - 5.0) / _poly(PPF_FAR_DEN, r - 5.0)
    tail = F.when(r <= 5.0, low).otherwise(far)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, mid).otherwise(F.when(q < 0, -tail).otherwise(tail)))
