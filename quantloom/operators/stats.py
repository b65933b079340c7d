"""Information coefficients, Newey-West t, bootstrap, residual ranks, performance and overfitting statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import cols as C
from quantloom.operators import ranks

EULER_GAMMA = 0.5772156649015329


def cross_sectional_ic(df: DataFrame, feature: str, target: str, min_names: int = 5, group=("pos",)) -> DataFrame:
    """Per group: rank correlation over rows where both values exist; groups below min_names or without variance drop out."""
    d = df.where(F.col(feature).isNotNull() & F.col(target).isNotNull()).select(*group, F.col(feature).alias("_f"), F.col(target).alias("_t"))
    d = ranks.average_ranks(d, group, {"_f": "_rf", "_t": "_rt"})
    g = d.groupBy(*group).agg(F.count("*").alias("n"), F.covar_pop("_rf", "_rt").alias("_cov"), F.var_pop("_rf").alias("_vf"), F.var_pop("_rt").alias("_vt"))
    g = g.where((F.col("n") >= min_names) & (F.col("_vf") > 0) & (F.col("_vt") > 0))
    return g.select(*group, "n", C.div("_cov", F.sqrt(F.col("_vf") * F.col("_vt"))).alias("ic"))


def label_cutoff(df: DataFrame, h, pos: str = "pos", last: Column | None = None) -> DataFrame:
    """Drops the last h dates so that every label ends inside the period."""
    end = last if last is not None else df.agg(F.max(pos)).scalar()
    return df.where(F.col(pos) <= end - (F.lit(h) if isinstance(h, int) else h))


def series_arrays(df: DataFrame, keys, order: str, value: str, out: str = "xs") -> DataFrame:
    """One array per series in date order, NULLs dropped. A series has at most one value per calendar day."""
    item = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("x")))
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["x"]).alias(out))


def nw_tstat(df: DataFrame, keys, order: str, value: str, lags) -> DataFrame:
    """(keys, n, mean, nw_t): Newey-West t of the mean; population autocovariances, Bartlett weights, NULL below 3 values.
    `lags` is a number or a Column of the keys.

    With Bartlett weights the long-run variance is the mean square of moving sums of length L+1 (zero-padded at both
    ends), so prefix sums of the demeaned series replace one pass per lag. The prefix sums end at 0, which leaves the
    head, the differences and the tail below.
    """
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    run = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(order).alias("_o"), F.col(value).cast("double").alias("_x"))
    run = Window.partitionBy(*keys).orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_mu", F.avg("_x").over(whole)).withColumn("_c", F.sum(F.col("_x") - F.col("_mu")).over(run))
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.max("_mu").alias("mean"), F.sort_array(F.collect_list(F.struct("_o", "_c"))).alias("_s"))
    g = g.withColumn("_n", F.size("_s")).withColumn("_l", F.least(F.lit(lags) if isinstance(lags, int) else lags, F.col("_n") - 1))
    n, lag = F.col("_n"), F.col("_l")
    prefix = lambda i: F.coalesce(F.try_element_at("_s", F.when(i > 0, i))["_c"], F.lit(0.0))

    def box(acc, j):
        head = F.when(j <= n, F.try_element_at("_s", F.least(j, n))["_c"]).otherwise(0.0)
        return acc + F.pow(head - prefix(j - lag - 1), F.lit(2.0))

    total = F.aggregate(F.sequence(F.lit(1), n + lag), F.lit(0.0), box)
    g = g.withColumn("_var", F.when(n >= 3, total / (n * (lag + 1))))
    return g.select(*keys, "n", "mean", F.when(F.col("_var") > 1e-300, F.col("mean") / F.sqrt(F.col("_var") / n)).alias("nw_t"))


def annualize_overlapping(mean, h) -> Column:
    return C.col(mean) * (F.lit(float(C.TRADING_DAYS)) / h)


def ic_summary(ic: DataFrame, keys=("feature", "h"), order: str = "pos") -> DataFrame:
    """mean, Newey-West t (lag 2h), hit rate, annualised ICIR, n per (feature, h)."""
    t = nw_tstat(ic, keys, order, "ic", F.col("h") * 2)
    g = ic.groupBy(*keys).agg(F.avg((F.col("ic") > 0).cast("double")).alias("hit"), F.stddev_samp("ic").alias("_sd"))
    return t.join(g, list(keys)).withColumn("icir", F.col("mean") / F.when(F.col("_sd") > 0, F.col("_sd")) * F.sqrt(F.lit(float(C.TRADING_DAYS)) / F.col("h"))).drop("_sd")


def residual_rank(df: DataFrame, feature: str, controls, min_names: int = 30, group=("pos",), out: str = "resid") -> DataFrame:
    """Residual of rank(feature) on rank(controls) with intercept, per group, over rows where all exist.

    One or two controls solve the normal equations from per-group moments (map-side combined aggregates, so a group
    of any size is summed in parallel). Singular groups give NULL.
    """
    cols = [feature, *controls]
    d = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    names = [f"_r{i}" for i in range(len(cols))]
    d = ranks.average_ranks(d, group, dict(zip(cols, names)))
    y, xs = names[0], names[1:]
    mom = [F.count("*").alias("_n")] + [F.avg(c).alias(f"_m{c}") for c in names]
    mom += [F.covar_pop(a, b).alias(f"_c{a}{b}") for i, a in enumerate(names) for b in names[i:]]
    g = d.groupBy(*group).agg(*mom).where(F.col("_n") >= min_names)
    if len(xs) == 1:
        (x,) = xs
        g = g.withColumn("_b0", F.col(f"_c{y}{x}") / F.when(F.col(f"_c{x}{x}") > 0, F.col(f"_c{x}{x}")))
    elif len(xs) == 2:
        a, b = xs
        det = F.col(f"_c{a}{a}") * F.col(f"_c{b}{b}") - F.col(f"_c{a}{b}") * F.col(f"_c{a}{b}")
        det = F.when(F.abs(det) > 1e-9, det)
        g = g.withColumn("_b0", (F.col(f"_c{y}{a}") * F.col(f"_c{b}{b}") - F.col(f"_c{y}{b}") * F.col(f"_c{a}{b}")) / det)
        g = g.withColumn("_b1", (F.col(f"_c{y}{b}") * F.col(f"_c{a}{a}") - F.col(f"_c{y}{a}") * F.col(f"_c{a}{b}")) / det)
    else:
        return _residual_general(d, names, group, min_names, out, list(df.columns))
    d = d.join(g, list(group))
    fit = reduce(lambda s, i: s + F.col(f"_b{i}") * (F.col(xs[i]) - F.col(f"_m{xs[i]}")), range(len(xs)), F.col(f"_m{y}"))
    return d.withColumn(out, F.col(y) - fit).select(*df.columns, out)


def _residual_general(d, names, group, min_names, out, keep):
    """Three or more controls: Gram matrix per group by aggregation, solved in one small Arrow step per group row."""
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    g = d.groupBy(*group).agg(F.count("*").alias("_n"), F.array(*[F.avg(c) for c in names]).alias("_m"),
                              F.array(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).alias("_c")).where(F.col("_n") >= min_names)

    @F.pandas_udf("array<double>")
    def solve(cov: pd.Series) -> pd.Series:
        def one(c):
            m = np.zeros((k, k))
            for v, (i, j) in zip(c, pairs):
                m[i, j] = m[j, i] = v
            return np.linalg.lstsq(m[1:, 1:], m[1:, 0], rcond=None)[0].tolist()

        return cov.map(one)

    d = d.join(g.withColumn("_b", solve("_c")).drop("_c", "_n"), list(group))
    fit = reduce(lambda s, i: s + F.col("_b")[i - 1] * (F.col(names[i]) - F.col("_m")[i]), range(1, k), F.col("_m")[0])
    return d.withColumn(out, F.col(names[0]) - fit).select(*keep, out)


PRIME = 2147483647  # modulus of the integer draws; products of two numbers below it fit a long


def draw(seed: int, boot, block) -> Column:
    """A number below PRIME from (seed, boot, block), by integer arithmetic alone: two linear steps around a square, all modulo PRIME."""
    x = (F.lit(seed * 1000003 + 12345) + C.col(boot) * 7919 + C.col(block) * 104729).cast("long") % PRIME
    x = x * 48271 % PRIME
    return (x * x % PRIME * 69621 + C.col(boot)) % PRIME


def block_bootstrap_means(df: DataFrame, keys, order: str, value: str, h: int, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """(keys, boot, mean): circular block bootstrap of the mean, block = h (the last block is cut to the series' length).

    The series is read once, as prefix sums: one array per series, in date order, with at most one value per calendar day. A drawn block is the difference of
    two of them, so a resample costs two look-ups a block in the row of its series; neither the series nor the look-ups are shuffled.
    """
    keys, size = list(keys), max(1, int(h))
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.where(F.col(value).isNotNull()).select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).alias("_i"), F.sum(value).over(run).cast("double").alias("_p"))
    sums = F.transform(F.sort_array(F.collect_list(F.struct("_i", "_p"))), lambda x: x["_p"])
    d = d.groupBy(*keys).agg(F.concat(F.array(F.lit(0.0)), sums).alias("_s")).withColumn("_n", F.size("_s") - 1)
    n, upto = F.col("_n"), lambda i: F.get("_s", i.cast("int"))

    def mean(boot):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda b: F.struct((draw(seed, boot, b) % n).alias("s"), F.least(F.lit(size), n - b * size).alias("len")))

        def add(acc, x):
            end = x["s"] + x["len"]
            return acc + F.when(end > n, upto(n) + upto(end - n)).otherwise(upto(end)) - upto(x["s"])

        return F.aggregate(blocks, F.lit(0.0), add) / n

    return d.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n_boot - 1)), mean)).alias("boot", "mean"))


def perf_stats(rets: DataFrame, keys=("series",), order: str = "date", ret: str = "ret") -> DataFrame:
    """CAGR, vol, CAGR/vol, max drawdown and total return per series."""
    from quantloom.operators.prices import equity_and_drawdown

    e = equity_and_drawdown(rets, keys, order, ret)
    g = e.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("equity", order).alias("_end"), F.stddev_samp(ret).alias("_sd"),
                             F.min("drawdown").alias("mdd"))
    vol = F.col("_sd") * (C.TRADING_DAYS ** 0.5)
    cagr = F.pow(F.col("_end"), F.lit(float(C.TRADING_DAYS)) / F.col("n")) - 1
    return g.select(*keys, "n", cagr.alias("cagr"), vol.alias("vol"), (cagr / F.when(vol > 0, vol)).alias("sharpe"), "mdd", (F.col("_end") - 1).alias("total"))


def excess_test(df: DataFrame, keys=("series",), order: str = "date", ret: str = "ret", base: str = "base", block: int = 21) -> DataFrame:
    """Sums of daily excess per block of rows (the last partial block stays): annualised mean, Newey-West t (lag 2), blocks."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_ex", F.col(ret) - F.col(base)).where("_ex is not null")
    d = d.withColumn("_b", F.floor((F.row_number().over(w) - 1) / block)).groupBy(*keys, "_b").agg(F.sum("_ex").alias("_s"))
    t = nw_tstat(d, keys, "_b", "_s", 2)
    return t.select(*keys, (F.col("mean") * (C.TRADING_DAYS / block)).alias("excess_ann"), F.col("nw_t").alias("excess_t"), F.col("n").alias("months"))


def moments(rets: DataFrame, keys=("series",), ret: str = "ret") -> DataFrame:
    """n, Sharpe per period, bias-corrected skewness and (non-excess) kurtosis."""
    g = rets.where(F.col(ret).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(ret).alias("_mu"), F.stddev_samp(ret).alias("_sd"), F.skewness(ret).alias("_g1"), F.kurtosis(ret).alias("_g2"))
    n = F.col("n")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("_g1"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6) + 3)
    return g.select(*keys, "n", (F.col("_mu") / F.when(F.col("_sd") > 0, F.col("_sd"))).alias("sr"), skew.alias("skew"), kurt.alias("kurt"))


def psr_of(n, sr, skew, kurt, sr_star) -> Column:
    n, sr, skew, kurt = (C.col(x) for x in (n, sr, skew, kurt))
    denom = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    z = (sr - sr_star) * F.sqrt(n - 1) / F.sqrt(F.when(denom > 0, denom))
    return F.when(n >= 3, C.norm_cdf(z))


def psr(rets: DataFrame, sr_star: float = 0.0, keys=("series",), ret: str = "ret") -> DataFrame:
    m = moments(rets, keys, ret)
    return m.withColumn("psr", psr_of("n", "sr", "skew", "kurt", F.lit(sr_star)))


def expected_max_sharpe(n, var) -> Column:
    n, var = C.col(n), C.col(var)
    z1 = C.norm_ppf(1 - 1 / n)
    z2 = C.norm_ppf(1 - 1 / (n * F.e()))
    return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(var) * ((1 - EULER_GAMMA) * z1 + EULER_GAMMA * z2))


def dsr(rets: DataFrame, trials: DataFrame, keys=("series",), ret: str = "ret", sharpe: str = "sr") -> DataFrame:
    """PSR at the expected maximum Sharpe of all trials (0 when fewer than two)."""
    bar = trials.where(F.col(sharpe).isNotNull()).agg(expected_max_sharpe(F.count("*"), F.coalesce(F.var_samp(sharpe), F.lit(0.0))).alias("b"))
    m = moments(rets, keys, ret).withColumn("sr_star", bar.scalar())
    return m.withColumn("dsr", psr_of("n", "sr", "skew", "kurt", F.col("sr_star")))


def bonferroni_t(n_tests, alpha: float = 0.05) -> Column:
    return C.norm_ppf(F.lit(1.0) - alpha / (C.col(n_tests) * 2))


def percentile_of_last(df: DataFrame, keys=("series",), order: str = "date", value: str = "value") -> DataFrame:
    """Share of the history at or below the last value."""
    d = df.where(F.col(value).isNotNull())
    last = d.groupBy(*keys).agg(F.max_by(value, order).alias("last"))
    return d.join(last, list(keys)).groupBy(*keys, "last").agg(F.avg((F.col(value) <= F.col("last")).cast("double")).alias("pct"))


def yearly_returns(rets: DataFrame, keys=("series",), date: str = "date", ret: str = "ret") -> DataFrame:
    return rets.where(F.col(ret).isNotNull()).groupBy(*keys, F.year(date).alias("year")).agg((F.product(1 + F.col(ret)) - 1).alias("ret"))


def study_verdict(tests: DataFrame, t_in: float, t_out: float) -> DataFrame:
    """(study, feature, h, phase, mean, nw_t) -> candidate in sample, confirmed when the hold-out agrees in sign and strength."""
    ins = tests.where("phase = 'insample'").select("study", "feature", "h", F.col("nw_t").alias("t_in"))
    out = tests.where("phase = 'holdout'").select("study", "feature", "h", F.col("nw_t").alias("t_out"))
    d = ins.join(out, ["study", "feature", "h"], "left")
    cand = F.coalesce(F.abs("t_in") >= t_in, F.lit(False))
    ok = cand & F.coalesce((F.signum("t_in") == F.signum("t_out")) & (F.col("t_out") * F.signum("t_in") >= t_out), F.lit(False))
    return d.withColumn("candidate", cand).withColumn("confirmed", ok)


def best_test(tests: DataFrame, keys=("study",), t: str = "nw_t") -> DataFrame:
    """The test with the largest |t| of each study; ties by feature and horizon."""
    pick = F.max_by(F.struct("feature", "h", t), F.struct(F.abs(F.coalesce(t, F.lit(0.0))), F.col("feature"), F.col("h")))
    return tests.groupBy(*keys).agg(pick.alias("_b")).select(*keys, "_b.feature", "_b.h", f"_b.{t}")


def portfolio_measures(df: DataFrame, study: str, key: str = "series", order: str = "date", ret: str = "ret", base: str = "base") -> DataFrame:
    """(study, item, metric, value, base): CAGR, drawdown and total of a strategy beside its benchmark's, and the t of the excess. Rows without either return drop out."""
    both = df.where(F.col(ret).isNotNull() & F.col(base).isNotNull())
    two = both.select(key, order, F.inline(F.array(F.struct(F.lit(True).alias("_own"), F.col(ret).alias("_r")), F.struct(F.lit(False).alias("_own"), F.col(base).alias("_r")))))
    own = lambda c: F.max(F.when(F.col("_own"), F.col(c)))
    ref = lambda c: F.max(F.when(~F.col("_own"), F.col(c)))
    names = ("cagr", "mdd", "total")
    g = perf_stats(two, (key, "_own"), order, "_r").groupBy(key).agg(*[f(c).alias(f"{p}_{c}") for c in names for f, p in ((own, "own"), (ref, "ref"))])
    g = g.join(excess_test(both, (key,), order, ret, base).select(key, "excess_t"), key, "left")
    rows = [F.struct(F.lit(c).alias("metric"), F.col(f"own_{c}").alias("value"), F.col(f"ref_{c}").alias("base")) for c in names]
    rows.append(F.struct(F.lit("excess_t").alias("metric"), F.col("excess_t").alias("value"), F.lit(None).cast("double").alias("base")))
    return g.select(F.lit(study).alias("study"), F.col(key).alias("item"), F.inline(F.array(*rows)))


def long_measures(df: DataFrame, study: str, item, **metrics) -> DataFrame:
    """(study, item, metric, value, base) from one column per metric, without a benchmark."""
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), C.col(c).cast("double").alias("value"), F.lit(None).cast("double").alias("base")) for k, c in metrics.items()])
    return df.select(F.lit(study).alias("study"), C.col(item).alias("item"), F.inline(rows))


def criteria_table(spark, rows) -> DataFrame:
    """Criteria as rows (study, metric, test, share, offset): the value must be at least ('ge') or at most ('le') share * base + offset."""
    return spark.createDataFrame(list(rows), "study string, metric string, test string, share double, offset double")


def judged(measures: DataFrame, criteria: DataFrame) -> DataFrame:
    """Each measure beside every criterion on it. A share of 0 needs no base; a missing value or base fails."""
    d = measures.join(criteria, ["study", "metric"])
    d = d.withColumn("bar", F.when(F.col("share") == 0, F.col("offset")).otherwise(F.col("share") * F.col("base") + F.col("offset")))
    met = F.when(F.col("test") == "ge", F.col("value") >= F.col("bar")).when(F.col("test") == "le", F.col("value") <= F.col("bar"))
    return d.withColumn("met", F.coalesce(met, F.lit(False)))


def criteria_verdict(measures: DataFrame, criteria: DataFrame) -> DataFrame:
    """(study, item, n_met, n_criteria, passed): passed when each criterion of the study is met; one that the item has no measure for is not.

    Repeated measures of an item must all meet the criterion. Studies without criteria have no rows.
    """
    rule = F.struct("metric", "test", "share", "offset")
    each = judged(measures, criteria).groupBy("study", "item", rule.alias("_rule")).agg(F.bool_and("met").alias("_met"))
    met = each.groupBy("study", "item").agg(F.count_if("_met").alias("n_met"))
    need = criteria.distinct().groupBy("study").agg(F.count("*").alias("n_criteria"))
    return met.join(need, "study").withColumn("passed", F.col("n_met") == F.col("n_criteria"))
