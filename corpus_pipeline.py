"""Corpus pipeline: quality rules, near duplicates, repeated passages, source mix, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import store
from quantloom.llm.jaccard import linked
from quantloom.llm.mixing import mix
from quantloom.llm.packing import pack
from quantloom.llm.quality import assess
from quantloom.llm.repeats import cut_repeats


def free(docs: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of docs is called so (Spark's names ignore case)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def named(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a 128-bit name of their text (null: that of the empty one), and that column's name."""
    name = free(docs, "text_name")
    return docs.withColumn(name, F.md5(store.text_of())), name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep. Each row is judged by its own text, whatever its id, so verdicts are looked up by the text's name and no row is stored."""
    rows, name = named(docs)
    kept = assess(rows.select("doc_id", "text", name), keep=(name,)).filter("kept").select(name).distinct()
    return rows.join(kept, name, "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, similarity 0.8): the least by (id, text), null ids last. Rows without words are in no group and stay.

    Rows are found again by id and name of the text, so they are not stored; of rows that share both, any one is taken."""
    rows, name = named(docs)
    links = linked(rows, k=5, percent=80, keep=(name,)).filter("node_group is not null")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("at")
    grouped = store.stored(links.select("node_group", F.col(name).alias("name"), at).groupBy("node_group", "name", "at").agg(F.count(F.lit(1)).alias("many")), "grouped")
    store.drop(links)
    least = store.stored(grouped.groupBy("node_group").agg(F.min("at").alias("least")), "least")
    first = store.stored(grouped.join(least, "node_group").filter(F.col("at").eqNullSafe(F.col("least"))).select("node_group", "name", "many", F.col("at.doc_id").alias("id")), "first")
    store.drop(grouped, least)
    tied = store.stored(first.groupBy("node_group").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("node_group"), "tied")
    texts = rows.select(F.col(name).alias("name"), F.col("doc_id").cast("long").alias("own"), "text")
    among = first.join(tied, "node_group").join(texts, "name").filter(F.col("id").eqNullSafe(F.col("own")))
    chosen = among.groupBy("node_group").agg(F.min(F.struct("text", "name", "id", "many")).alias("best")).select("best.name", "best.id", "best.many")
    picked = store.stored(first.join(tied, "node_group", "left_anti").select("name", "id", "many").union(chosen), "picked")
    store.drop(first, tied)
    picks = picked.toDF(*[free(docs, c) for c in ("picked_name", "picked_id", "picked_rows")])
    own_name, own_id, many = picks.columns
    same = (F.col(name) == F.col(own_name)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own_id))
    out = rows.join(picks.filter(F.col(many) == 1), same, "left_semi").select(*docs.columns)
    out = out.union(docs.filter(~store.text_of().rlike(store.WORD)))
    if picked.filter("many > 1").isEmpty():
        return out
    row = free(docs, "whole_row")
    repeated = rows.join(picks.filter(F.col(many) > 1), same).groupBy(own_name, own_id).agg(F.first(F.struct(*docs.columns)).alias(row))
    return out.union(repeated.select(f"{row}.*"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without passages of 20 words or more that stand earlier; texts that lose nothing stay as they are, texts that lose all go.

    n_chars, where the table has it, is counted again. Rows with null id come first (as -1); for rows that share an id see `cut_repeats`."""
    rest, names = free(docs, "other_columns"), [c for c in docs.columns if c.lower() != "text"]
    none = free(docs, "no_text")  # the columns travel with the text, which is stored once and joined once
    rows = docs.select("doc_id", "text", F.struct(*names, F.col("text").isNull().alias(none)).alias(rest))
    cut = cut_repeats(rows, keep=("text", rest)).filter("n_removed = 0 or kept != ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).when(~F.col(f"{rest}.{none}"), F.col("text"))
    out = cut.select(text.alias("text"), *[F.col(rest)[c].alias(c) for c in names])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mixed", mixed), ("packed", packed)]

#: Shingle links, byte-pair tokens and best fit have no SQL. Tests hold stages of their own; none holds run() as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage stored, and the table it read, go once its own output stands."""
    docs = store.read(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        with store.scope() as tables:
            out = store.stored(stage(spark, docs, sf_dir), name)
            tables.pop()
        if at:
            store.drop(docs)
        docs = out
    return docs
