"""Mixing sources to target weights by Sainte-Lague apportionment. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_sums

#: Weights that the sources get in turn, the mix's size as a share of all words, and how often a source may be used at most.
WEIGHTS, SHARE, TOP = (3, 1, 2), 1.5, 2
#: Words of a block; shards of the mix; seed of the choice of blocks.
BLOCK, SHARDS, SEED = 16, 8, 1
#: A linear congruential generator's modulus and multiplier: draws that any SQL engine can make.
_PRIME, _FACTOR = 2_147_483_647, 48_271


def words_in(text: Column) -> Column:
    """Runs of bytes other than the six ASCII spaces; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, top: float = TOP) -> DataFrame:
    """(source, source_size) -> also weight, target and place (the source's number, from 1).

    Sources in order of code points, null last, get the weights in turn. Targets share ``share`` of all words by weight; one that
    would be above ``top`` times its source's words stops there and the excess is shared again by weight until none is above. That
    is water-filling: with sources in order of ``top * size / weight`` the level is found from running sums. The table has one row
    a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("place", F.row_number().over(order)).withColumn("cap", F.col("source_size") * F.lit(float(top)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    upto, after, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    rows = (
        rows.withColumn("nth", F.row_number().over(by_level)).withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("capped", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    # the level that holds is that of the first source that stays under it
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))).over(everything)
    return rows.withColumn("target", F.coalesce(F.least(F.col("cap"), level["level"] * F.col("weight")), F.col("cap"))).select("source", "source_size", "weight", "target", "place")


def shard_quotas(targets: DataFrame, shards: int = SHARDS, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """Adds ``blocks`` (of ``block`` words that the source has) and ``upto``: for each shard, the blocks that the mix takes from the
    source for the shards up to it. Differences of neighbours are the source's integer quota in each shard.

    Sainte-Lague: the seats, all sources' targets in blocks together, go one after the other to the highest quotient target / (2 k + 1),
    k being what a source has; ties to the first source. A shard gets the next equal share of the seats in that order, so the shards up
    to any of them are an apportionment of their own. A source's seats among the first M are within 2 + x * S / (2 M) of its exact
    share x (S sources): seats below that range are certain and only those in it are ranked, so the table stays small.
    """
    everything, shard = Window.partitionBy(), Window.partitionBy("shard")
    rows = (
        targets.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)))
        .withColumn("exact", F.when(F.col("blocks") > 0, F.col("target") / F.col("source_size") * F.col("blocks")).otherwise(0.0))
        .withColumn("all_seats", F.floor(F.sum("exact").over(everything) + F.lit(0.5)).cast("long"))
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("seats", F.floor(F.col("all_seats") * F.col("shard") / F.lit(shards)))
        .withColumn("x", F.col("exact") * F.col("seats") / F.greatest("all_seats", F.lit(1)))
        .withColumn("slack", F.ceil(F.lit(2) + F.col("x") * F.count("*").over(shard) / (2.0 * F.greatest("seats", F.lit(1)))))
        .withColumn("sure", F.greatest(F.lit(0), F.floor("x") - F.col("slack")))
        .withColumn("most", F.least(F.col("blocks") * top, F.floor("x") + F.col("slack")))
        .withColumn("left", F.col("seats") - F.sum("sure").over(shard))
    )
    seats = rows.where("most > sure").select("source", "shard", "left", F.col("exact").alias("t"), F.explode(F.sequence(F.col("sure"), F.col("most") - 1)).alias("k"))
    seats = seats.withColumn("quotient", F.col("t") / (F.col("k") * 2 + 1)).where("quotient > 0")
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.col("quotient").desc(), F.col("source").isNull(), F.col("source"), F.col("k")))
    won = seats.withColumn("rank", rank).where(F.col("rank") <= F.col("left")).groupBy(F.col("source").alias("of"), F.col("shard").alias("in")).agg(F.count("*").alias("won"))
    rows = rows.join(won, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("in")), "left")
    upto = F.transform(F.sort_array(F.collect_list(F.struct("shard", (F.col("sure") + F.coalesce("won", F.lit(0))).cast("long").alias("n")))), lambda x: x["n"])
    return rows.groupBy("source", "source_size", "target", "place", F.col("blocks").cast("long").alias("blocks")).agg(upto.alias("upto"))


def _coprime(a: Column, n: Column) -> Column:
    """Whether two whole numbers have no common divisor (Euclid; 64 steps are enough below 2 ** 44)."""
    start = F.struct(a.cast("long").alias("a"), n.cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, s["b"]).otherwise(s["a"] % F.greatest(s["b"], F.lit(1))).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda s: s["a"]) == 1


def _with_permutation(quotas: DataFrame, seed: int) -> DataFrame:
    """Adds n, factor and step of a source's seeded order of its blocks: block b has number (b * factor + step) mod n.

    The factor lies between 0.3 n and 0.7 n and has no divisor in common with n, so neighbouring blocks are far apart in that order and
    no run of blocks is taken, or left, together.
    """
    draw = (F.col("place").cast("long") * _FACTOR + F.lit(seed) * 16_807) % _PRIME
    rows = quotas.withColumns({"n": F.greatest("blocks", F.lit(1)), "draw": draw})
    low = F.greatest(F.lit(1), F.floor(F.col("n") * (F.lit(0.3) + F.lit(0.4) * F.col("draw") / _PRIME)).cast("long"))
    factor = F.try_element_at(F.filter(F.sequence(F.col("low"), F.col("low") + 63), lambda a: _coprime(a, F.col("n"))), F.lit(1))
    return rows.withColumn("low", low).withColumns({"factor": F.coalesce(factor, F.lit(1)), "step": F.col("draw") * _FACTOR % _PRIME % F.col("n")}).drop("draw", "low")


def _times(a: Column, b: Column, n: Column) -> Column:
    """a * b mod n without overflow, for a and b below n below 2 ** 41."""
    half = F.lit(1 << 20)
    return (F.shiftright(a, 20) * b % n * half + a % half * b) % n


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, carried: tuple[str, ...] = (), shards: int = SHARDS,
                  seed: int = SEED) -> DataFrame:
    """(id, source, size, source_size, target, taken, shard_taken, nth) and the columns ``carried``, a row for each row of ``docs``.

    A source's words, in order of id, size and checksum, are cut into blocks of ``block`` words. :func:`shard_quotas` says how many blocks
    each shard takes of each source. A source's blocks stand in a seeded order; the shards take their quotas from it one after the
    other, and it starts again where a source is used more than once. shard_taken has the words of the document in blocks that each
    shard takes, ``taken`` is their sum; so reruns agree, no document exceeds ``TOP`` times its words, and a source's words come within
    a few blocks of its target. nth numbers a source's rows in that order.

    Running sums (:func:`running_sums`) are made in parts of equal numbers of rows, so neither a source with a third of all rows nor
    null, sparse or repeated ids end in one task. Only ids, sizes, checksums and sources are shuffled; the tables of sources have a row
    a source and shard. Null or empty texts have size and ``taken`` 0; null sources are a source, ordered last; null ids come first in
    their source; a very long text is cut into blocks like any other; repeated rows count each. An empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), words_in(text).alias("size"),
                       F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"), *carried)
    rows = running_sums(rows, "source", ["id", "size", "crc"], {"start": F.col("size")})
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = _with_permutation(shard_quotas(targets, shards, block), seed).withColumnRenamed("source", "of")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    # a row a block, so that the sums are generated code; partial sums leave one row a document to shuffle
    lo, hi = F.floor(F.col("start") / F.lit(block)), F.floor((F.col("start") + F.col("size") - 1) / F.lit(block))
    quotas = [f"_q{k}" for k in range(shards)]
    keys = ["id", "source", "size", "source_size", "target", "nth", *carried]
    parts = rows.select(*keys, "start", "n", "factor", "step", *[F.col("upto")[k].alias(q) for k, q in enumerate(quotas)],
                        F.explode_outer(F.when(F.col("size") > 0, F.sequence(lo, hi))).alias("_b"))
    b = F.col("_b")
    words = F.least(F.col("start") + F.col("size"), (b + 1) * block) - F.greatest(F.col("start"), b * block)
    first = (_times(F.col("factor"), b, F.col("n")) + F.col("step")) % F.col("n")
    parts = parts.select(*keys, *quotas, words.alias("_words"), *[(first + F.col("n") * k).alias(f"_seat{k}") for k in range(TOP)])
    own = []
    for k, q in enumerate(quotas):
        inside = [F.when((F.col(f"_seat{x}") < F.col(q)) & ((F.col(f"_seat{x}") >= F.col(quotas[k - 1])) if k else F.lit(True)), F.col("_words")).otherwise(0) for x in range(TOP)]
        own.append(F.coalesce(F.sum(sum(inside[1:], inside[0])), F.lit(0)).cast("long").alias(f"_t{k}"))
    sums = parts.groupBy(*keys).agg(*own)
    each = [F.col(f"_t{k}") for k in range(shards)]
    return sums.select("id", "source", "size", "source_size", "target", sum(each[1:], each[0]).alias("taken"), F.array(*each).alias("shard_taken"), "nth", *carried)


def copies(size: Column, taken: Column, nth: Column) -> Column:
    """Whole copies of a document that stand for ``taken`` of its words: the exact share, rounded so that neighbours in the mix's order
    are rounded up in turn (multiples of the golden section)."""
    share = taken / F.greatest(size, F.lit(1))
    unit = nth * F.lit(0.6180339887498949) - F.floor(nth * F.lit(0.6180339887498949))
    return (F.floor(share) + F.when(unit < share - F.floor(share), 1).otherwise(0)).cast("int")
