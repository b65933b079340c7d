"""URL filter: listed host and path rules first, mined token rules for the rest."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import store

#: (host, path, verdict): fixed values of the task.
LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

SHAPE = "://([^/?#]*)([^?#]*)"
LABEL = "label="


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; null, or a url without '://': both empty."""
    part = lambda k: F.coalesce(F.regexp_extract(url, SHAPE, k), F.lit(""))
    return store.lower_ascii(part(1)), part(2)


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """Longest rule that fits, and its verdict; null where none fits. One expression; meant for short lists."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a url: its labels by their place from the right, path words, names of query fields. Numbers are left out."""
    labels = F.filter(F.reverse(F.split(host, r"\.")), lambda x: x != "")
    labels = F.transform(labels, lambda x, i: F.concat(F.lit("h"), F.least(i, F.lit(9)).cast("string"), F.lit(":"), x))
    words = F.regexp_extract_all(F.concat(store.lower_ascii(path), F.lit("/")), F.lit("([a-z][a-z-]*)(?=[^a-z-])"), F.lit(1))
    fields = F.regexp_extract_all(store.lower_ascii(F.coalesce(url, F.lit(""))), F.lit("[?&]([a-z_]+)="), F.lit(1))
    parts = F.concat(labels, F.transform(words, lambda x: F.concat(F.lit("p:"), x)), F.transform(fields, lambda x: F.concat(F.lit("q:"), x)))
    return F.array_sort(F.array_distinct(parts))


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """Rules (tokens, verdict, confidence, support) from rows of `tokens` and `verdict` (block or allow), by FP-growth over all labelled rows.

    A rule with a proper subset of its tokens behind the same verdict at no less confidence is dropped. The number of rules follows from the support, not
    from the number of rows. Without labelled rows there are no rules.
    """
    baskets = labelled.select(F.concat(F.col("tokens"), F.array(F.concat(F.lit(LABEL), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = (
        model.associationRules.filter(F.element_at("consequent", 1).startswith(LABEL))
        .filter(~F.exists("antecedent", lambda x: x.startswith(LABEL)))
        .select(F.array_sort("antecedent").alias("tokens"), F.expr(f"substring(element_at(consequent, 1), {len(LABEL) + 1})").alias("verdict"), "confidence", "support")
    )
    found = store.stored(found, "url-rules")
    more = found.withColumn("token", F.explode("tokens")).alias("b")
    subset = (F.size("b.tokens") < F.size("a.tokens")) & (F.col("b.confidence") >= F.col("a.confidence")) & (F.size(F.array_except("b.tokens", "a.tokens")) == 0)
    one = found.withColumn("token", F.explode("tokens")).alias("a")
    weak = one.join(more, (F.col("a.token") == F.col("b.token")) & (F.col("a.verdict") == F.col("b.verdict")) & subset, "left_semi").select("tokens", "verdict").distinct()
    return found.join(weak, ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "confidence", "support")


def judge(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdict of each row of `tokens` (distinct token sets) that some rule fits: (tokens, mined), by the most confident rule, block before allow.

    Inverted index: each rule is filed under its rarest token only; a set looks its tokens up there and keeps the rules whose other tokens it has as well.
    """
    listed = rules.withColumn("rule_id", F.xxhash64("tokens", "verdict"))
    posted = listed.select(F.explode("tokens").alias("token"), "*")
    often = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posted = posted.join(often, "token")
    index = posted.groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("tokens").alias("needs"), F.first("verdict").alias("verdict"), F.first("confidence").alias("confidence"))
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.max(F.struct("confidence", (F.col("verdict") == "block").alias("block"), "needs"))
    return hits.groupBy("tokens").agg(best.alias("best")).select("tokens", F.when(F.col("best.block"), "block").otherwise("allow").alias("mined"), F.array_join("best.needs", " ").alias("mined_rule"))


def filter_urls(pages: DataFrame, rules=LISTED, min_support: float = 0.01, min_confidence: float = 0.8, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined_rule.

    A listed rule decides where one fits. The urls it decides are the labels from which token rules are mined over all of them; those rules judge the other urls,
    and `default` holds where no rule fits. Distinct token sets are judged once, so a host with a third of the pages costs a few rows.
    Null url: host and path are empty, no listed rule, `default`. Repeated rows are judged each. Extra columns are ignored.
    """
    host, path = host_path(F.col("url"))
    seen = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    seen = seen.withColumn("rule", rule).withColumn("listed", verdict).withColumn("tokens", tokens(F.col("host"), F.col("path"), F.col("url")))
    mined = mine(seen.filter(F.col("listed").isNotNull()).select("tokens", F.col("listed").alias("verdict")), min_support, min_confidence)
    judged = judge(seen.filter(F.col("listed").isNull()).select("tokens").distinct(), mined)
    out = seen.join(judged, "tokens", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit(default)).alias("verdict"), F.when(F.col("listed").isNull(), F.col("mined_rule")).alias("mined_rule"))


def op10_url_rules(spark, sf_dir: str) -> DataFrame:
    return filter_urls(store.read(spark, sf_dir, "pages"))
