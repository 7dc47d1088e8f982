"""Documents to a training mix: toxicity, near-duplicates, benchmark passages, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import decontam, mixing, sharding, simhash, toxicity
from veilspan.llm.common import drop_table, drop_tables_since, placed, tables_now, write_table

SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below the threshold, each judged by its own text.

    Null and empty texts are scored as texts without tokens; repeated rows, null ids and very long texts are scored like any other. An
    empty table gives no rows; columns pass through whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels, keep=True)
    return scored.where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by SimHash one, with the smallest doc_id (then by a hash of the row).

    Groups are of texts, so rows that share an id but are in different groups are decided on their own; rows equal in all columns are
    one group. Rows with a null doc_id make groups of their own. Null, empty and blank texts are one group (fingerprint zero). An
    empty table gives no rows; columns pass through whatever their names.
    """
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no benchmark passage.

    Null and empty texts hold none; repeated rows and null ids are judged one by one; very long texts are searched whole. An empty
    table, of documents or of passages, is passed through; so are all columns.
    """
    return decontam.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: a row for each whole copy (0 to 2), so sources come to their targets.

    A row is decided on its own, also where it equals others; neighbours in the mix's order are rounded in turn, so equal rows
    together come within one of their share. Null and empty texts have no words and aren't taken; null sources are a source. An
    empty table gives no rows; columns pass through whatever their names.
    """
    keyed, place = placed(docs)
    mixed = mixing.mix_documents(keyed, carried=place)
    copies = f"{place[0]}_copies"
    taken = mixed.select(*place, mixing.copies(F.col("size"), F.col("taken"), F.col("nth")).alias(copies)).where(F.col(copies) > 0)
    # kept rows grow with the table: a merge, which shuffles texts once
    out = keyed.join(taken.hint("merge"), list(place)).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies))
    return out.drop(copies)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their size, the shard that their id draws, and the shard with one more; a column of documents that has one of
    these names keeps its place and the added one ends in an underscore.

    Null ids are a key like any other; null texts have size 1; repeated rows go to one shard. An empty table gives no rows.
    """
    tree, key = sharding.base_tree(SHARDS), F.col("doc_id").cast("long")
    added = {"size": sharding.text_size(F.col("text")), "shard": sharding.shard_of(tree, key), "grown_shard": sharding.shard_of(sharding.grow(tree), key)}
    return docs.select("*", *[c.alias(n + "_" if n in docs.columns else n) for n, c in added.items()])


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("sharding", shard)]

#: The models, the fingerprints and the alignment can't be said in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. Each stage's rows are written; then the tables that it worked with, and the rows before, go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        mark, before = tables_now(), docs
        docs = write_table(stage(spark, before, sf_dir), name)
        drop_tables_since(mark, docs)
        drop_table(before)
    return docs
