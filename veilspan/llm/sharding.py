"""Sharding by a weighted hash tree of regions, racks and shards. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_sums

#: Racks of a region, shards of a rack.
RACKS, SHARDS = 2, 2

#: A tree: region -> rack -> {shard: weight}.
Tree = dict[int, dict[int, dict[int, float]]]


def base_tree(shards: int) -> Tree:
    """Shards 0 to ``shards`` - 1 of weight 1, SHARDS to a rack and RACKS racks to a region; the last ones may be smaller."""
    tree: Tree = {}
    for s in range(shards):
        region, rack = s // (SHARDS * RACKS), s // SHARDS % RACKS
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """``tree`` with one more shard in a region of its own.

    The draws of the regions there stay as they are, so a row either stays where it was or moves into the new shard. (A shard
    added inside a region raises that region's weight, and rows that enter the region would reach its other shards too.)
    """
    new = 1 + max((s for racks in tree.values() for rack in racks.values() for s in rack), default=-1)
    return tree | {1 + max(tree, default=-1): {0: {new: weight}}}


def _draw(level: str, node: str, weight: float, cols: list[Column]) -> Column:
    """An exponential draw of rate ``weight``: the smallest of several falls on each in proportion to its weight."""
    h = F.xxhash64(F.lit(f"{level}/{node}"), *cols)
    unit = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(unit) / F.lit(float(weight))


def _pick(level: str, nodes: dict[str, tuple[float, int]], cols: list[Column]) -> Column:
    drawn = [F.struct(_draw(level, name, weight, cols).alias("d"), F.lit(value).alias("v")) for name, (weight, value) in sorted(nodes.items())]
    return drawn[0]["v"] if len(drawn) == 1 else F.array_min(F.array(*drawn))["v"]


def _case(choice: Column, branches: dict[int, Column]) -> Column:
    if len(branches) == 1:
        return next(iter(branches.values()))
    out = None
    for k, col in branches.items():
        out = F.when(choice == k, col) if out is None else out.when(choice == k, col)
    return out


def shard_of(tree: Tree, *cols: Column) -> Column:
    """Descends the tree: at each level the child with the smallest weighted draw for the key.

    A node's draws depend on its path and the key, and its weight is the sum of its shards'. So a change of weight moves rows only
    into or out of subtrees whose weight changed.
    """
    total = lambda racks: sum(w for rack in racks.values() for w in rack.values())
    region = _pick("region", {str(r): (total(racks), r) for r, racks in tree.items()}, list(cols))
    in_region = {}
    for r, racks in tree.items():
        rack = _pick("rack", {f"{r}/{k}": (sum(s.values()), k) for k, s in racks.items()}, list(cols))
        in_region[r] = _case(rack, {k: _pick("shard", {f"{r}/{k}/{s}": (w, s) for s, w in shards.items()}, list(cols)) for k, shards in racks.items()})
    return _case(region, in_region).cast("int")


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; null counts as empty."""
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + 1


def shard_documents(docs: DataFrame, shards: int = 8, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), a row for each row of ``docs``.

    The law is ``key``: id and tree decide the shard, and ``grown_shard`` is the shard with one more (:func:`grow`). slot numbers a
    shard's rows from 0 without gaps, in order of id (nulls first), size and checksum (:func:`running_sums`), so no task orders a
    whole shard, also where ids are sparse, null or repeated. Only ids, sizes and checksums are shuffled. Null ids are a key like any
    other; null texts have size 1 and checksum 0; very long texts are read for their size and checksum only; repeated rows get slots
    of their own. An empty table gives no rows; other columns are ignored.
    """
    tree = tree or base_tree(shards)
    text, key = F.col(text_col).cast("string"), F.col("id")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    rows = rows.withColumns({"shard": shard_of(tree, key), "grown_shard": shard_of(grow(tree), key)})
    return running_sums(rows, "shard", ["id", "size", "text_crc32"], {}).select(
        "id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("nth").alias("slot"), "grown_shard")
