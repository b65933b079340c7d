"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import store

SHARDS = 61


def source_targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """Targets per source: `share` of all words split by weight, none above `cap` times its source, the excess reshared by weight.

    Input: `__null` (is the source null), `__src` (source or ''), `__size`. Sources take the weights in turn by code point, null last.
    With sources ordered by cap/weight, the level of those that stay below their cap is (total - capped sources before) / (weights from here on), taken
    at the first source that this level does not fill. The table has one row per source, so its windows are small.
    """
    per = sized.groupBy("__null", "__src").agg(F.sum("__size").alias("__words"))
    turn = (F.row_number().over(Window.orderBy("__null", "__src")) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int"))
    per = per.withColumn("__weight", weight).withColumn("__cap", F.col("__words") * cap)
    order = Window.orderBy(F.col("__cap") / F.col("__weight"), "__null", "__src")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("__weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("__total", F.sum("__words").over(everything) * F.lit(float(share)))
    per = per.withColumn("__level", (F.col("__total") - before) / after)
    level = F.min(F.when(F.col("__cap") >= F.col("__level") * F.col("__weight"), F.struct(F.col("__cap") / F.col("__weight"), "__null", "__src", "__level")))
    per = per.withColumn("__at", level.over(everything)["__level"])
    target = F.least(F.col("__cap").cast("double"), F.coalesce(F.col("__at") * F.col("__weight"), F.col("__cap").cast("double")))
    return per.select("__null", "__src", "__words", target.alias("__target"))


def offset(null: Column, src: Column, seed: str) -> Column:
    """The one random offset of a source in [0, 1): 48 bits of a digest of seed and source, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(seed + "|"), null.cast("int").cast("string"), F.lit("|"), src))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def with_copies(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """Adds `__size`, `__words` (of the source), `__target` and `__copies` to every row.

    Each document of a source expects target / source size copies. The documents of a source stand in order of size, so that the copies are spread over all
    sizes and the words taken come near the target. The running sum of expected copies plus the source's offset is cut at the integers: a document gets one copy
    for each integer it passes. The running sum is expected copies times rank; the rank is put together from counts of (source, size), of (source, size, shard)
    and a row number inside a shard, so a source, or one size of it, with a third of all rows is spread over many tasks.

    Null or empty text: size 0 (copied like others, takes no words). Null source: a source of its own, last in order. Null id: first of its size.
    Repeated rows count each. An empty table gives an empty table. Extra columns pass through; names beginning with two underscores are used inside.
    """
    base = (
        docs.withColumn("__size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(store.WORD)), F.lit(0)).cast("bigint"))
        .withColumn("__null", F.col(source_col).isNull())
        .withColumn("__src", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
        .withColumn("__shard", F.coalesce(F.pmod(F.col(id_col), F.lit(SHARDS)), F.lit(-1)))
    )
    source = ["__null", "__src"]
    shards = base.groupBy(*source, "__size", "__shard").agg(F.count(F.lit(1)).alias("__n"))
    sizes = shards.groupBy(*source, "__size").agg(F.sum("__n").alias("__of_size"))
    earlier = Window.unboundedPreceding, -1
    sizes = sizes.select(*source, "__size", F.coalesce(F.sum("__of_size").over(Window.partitionBy(*source).orderBy("__size").rowsBetween(*earlier)), F.lit(0)).alias("__smaller"))
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy(*source, "__size").orderBy("__shard").rowsBetween(*earlier)), F.lit(0))
    places = shards.withColumn("__inside", inside).join(sizes, [*source, "__size"]).withColumn("__first", F.col("__smaller") + F.col("__inside"))
    targets = source_targets(sized=shards.withColumn("__size", F.col("__size") * F.col("__n")), weights=weights, share=share, cap=cap)
    places = places.join(targets, source).select(*source, "__size", "__shard", "__first", "__words", "__target")
    key = [*source, "__size", "__shard"]
    rank = F.col("__first") + F.row_number().over(Window.partitionBy(*key).orderBy(id_col))
    rate = F.when(F.col("__words") > 0, F.col("__target") / F.col("__words")).otherwise(F.lit(0.0))
    shift = offset(F.col("__null"), F.col("__src"), seed)
    crossed = F.floor(rate * F.col("__rank") + shift) - F.floor(rate * (F.col("__rank") - 1) + shift)
    return base.join(places, key).withColumn("__rank", rank).withColumn("__copies", crossed.cast("bigint"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row as often as it has copies, with the input's columns."""
    columns = docs.columns
    out = with_copies(docs, **options).filter(F.col("__copies") > 0)
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(f"`{c}`") for c in columns])


def op4_mix(spark, sf_dir: str) -> DataFrame:
    docs = store.read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return with_copies(docs).select("doc_id", F.col("__size").alias("size"), F.col("__words").alias("source_size"), F.col("__target").alias("target"),
                                    (F.col("__copies") * F.col("__size")).alias("taken"), F.col("source"), F.col("__copies").alias("copies"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, source IS NULL AS nul, coalesce(source, '') AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT nul, src, sum(size)::BIGINT AS words, [5, 2, 1][((row_number() OVER (ORDER BY nul, src) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY nul, src),
t AS (SELECT *, 2 * words AS cap, sum(words) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
              / sum(weight) OVER (ORDER BY cap / weight, nul, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM t),
g AS (SELECT arg_min(level, row(cap / weight, nul, src)) FILTER (WHERE cap >= level * weight) AS lvl FROM l),
q AS (SELECT nul, src, words, least(cap::DOUBLE, coalesce(lvl * weight, cap::DOUBLE)) AS target,
             ('0x' || substr(md5('mix|' || nul::INT::VARCHAR || '|' || src), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS shift FROM t, g),
r AS (SELECT d.*, words, target, shift, CASE WHEN words > 0 THEN target / words ELSE 0.0::DOUBLE END AS rate,
             row_number() OVER (PARTITION BY nul, src ORDER BY size, coalesce((doc_id % 61 + 61) % 61, -1), doc_id) AS rk FROM d JOIN q USING (nul, src)),
c AS (SELECT *, (floor(rate * rk + shift) - floor(rate * (rk - 1) + shift))::BIGINT AS copies FROM r)
SELECT doc_id, size, words AS source_size, target, copies * size AS taken, source, copies FROM c
"""
