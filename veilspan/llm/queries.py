"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embeddings, langid, lattice, mixing, quality, sharding, simhash, token_ids, toxicity

SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "item_id", "edits", "budget", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lattice.score_texts(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), SHARDS).withColumnRenamed("id", "doc_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_language(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted", F.size("spans").alias("n_spans"), spans.alias("spans"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.embedding_links(_table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_digest(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(_table(spark, sf_dir, "documents"))
    shards = [F.col("shard_taken")[k].alias(f"taken_{k}") for k in range(mixing.SHARDS)]
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", *shards)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_decontamination, op3_lm_scoring, op4_sharding, op5_language, op6_toxicity, op7_embedding_dedup,
                                   op8_quality, op9_token_ids, op10_mixing)}

#: Words of a text as SQL; doc_id orders a source's words, as the ids of documents are distinct.
OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
    ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s),
v AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS nth,
    (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT level FROM v WHERE level * weight <= cap ORDER BY nth LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM l) * weight), cap) AS target FROM v),
n AS (SELECT *, ceil(source_size / {mixing.BLOCK}.0)::BIGINT AS blocks, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM t),
x AS (SELECT *, CASE WHEN blocks > 0 THEN target / source_size * blocks ELSE 0.0 END::DOUBLE AS exact FROM n),
q AS (SELECT *, floor(sum(exact) OVER () + 0.5)::BIGINT AS seats FROM x),
k AS (SELECT source, seats, exact, unnest(range(blocks * 2)) AS k FROM q),
r AS (SELECT source, seats, row_number() OVER (ORDER BY exact / (2 * k + 1) DESC, source IS NULL, source, k) AS nth FROM k WHERE exact > 0),
u AS (SELECT source, {", ".join(f"(count(*) FILTER (WHERE nth <= seats * {j + 1} // {mixing.SHARDS}))::BIGINT AS q{j}" for j in range(mixing.SHARDS))} FROM r GROUP BY source),
p0 AS (
  SELECT q.*, {", ".join(f"coalesce(u.q{j}, 0) AS q{j}" for j in range(mixing.SHARDS))}, greatest(blocks, 1) AS n, (place * 48271 + {mixing.SEED} * 16807) % 2147483647 AS draw
  FROM q LEFT JOIN u ON q.source IS NOT DISTINCT FROM u.source),
p1 AS (SELECT *, greatest(1, floor(n * (0.3::DOUBLE + 0.4::DOUBLE * draw / 2147483647))::BIGINT) AS low, draw * 48271 % 2147483647 % n AS step FROM p0),
p AS (SELECT *, list_filter(range(low, low + 64), lambda a: gcd(a, n) = 1)[1] AS factor FROM p1),
o AS (
  SELECT d.doc_id, d.source, d.size,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
b AS (
  SELECT o.doc_id, least(o.start + o.size, (x.b + 1) * {mixing.BLOCK}) - greatest(o.start, x.b * {mixing.BLOCK}) AS words, (x.b * p.factor + p.step) % p.n + y.lap * p.n AS seat,
    {", ".join(f"q{j}" for j in range(mixing.SHARDS))}
  FROM o JOIN p ON o.source IS NOT DISTINCT FROM p.source,
    LATERAL (SELECT unnest(range(o.start // {mixing.BLOCK}, (o.start + o.size - 1) // {mixing.BLOCK} + 1)) AS b) x, (VALUES (0), (1)) y(lap)
  WHERE o.size > 0),
c AS (
  SELECT doc_id, sum(CASE WHEN seat < q{mixing.SHARDS - 1} THEN words ELSE 0 END)::BIGINT AS taken,
    {", ".join(f"sum(CASE WHEN seat < q{j}{f' AND seat >= q{j - 1}' if j else ''} THEN words ELSE 0 END)::BIGINT AS taken_{j}" for j in range(mixing.SHARDS))}
  FROM b GROUP BY doc_id)
SELECT o.doc_id, o.size, p.source_size, p.target, coalesce(c.taken, 0)::BIGINT AS taken, {", ".join(f"coalesce(c.taken_{j}, 0)::BIGINT AS taken_{j}" for j in range(mixing.SHARDS))}
FROM o JOIN p ON o.source IS NOT DISTINCT FROM p.source LEFT JOIN c ON c.doc_id = o.doc_id
"""

ORACLES = {"op10_mixing": OP10_SQL}
