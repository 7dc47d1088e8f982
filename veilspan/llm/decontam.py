"""Finds benchmark passages in documents: q-gram lemma over diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Block, blocks, drop_table, mix, small_batches, write_table

#: Length of the shared character q-grams, and the edits allowed for each character of a passage.
Q, EDIT_RATE = 12, 0.06
#: Characters of normalised benchmark text that one index, which is broadcast, may hold; more text makes more passes.
INDEX_CHARS = 4 << 20
#: Bits of the table that a document's q-grams are first looked up in.
_TABLE = 22


def _normal(data: np.ndarray, at: np.ndarray) -> tuple[Block, np.ndarray]:
    """Lower-cased bytes with each run of spaces as one; and where each byte came from."""
    block = Block(data, at)
    white = SPACE[block.data]
    keep = np.ones(len(white), bool)
    keep[1:] = ~(white[1:] & white[:-1])
    starts = block.at[(block.at < len(white))]
    keep[starts] = ~white[starts]
    new = np.where(white, np.uint8(32), block.data)[keep]
    moved = np.concatenate([[0], np.cumsum(keep)])[block.at]
    return Block(new, moved, lower=False), np.flatnonzero(keep)


def normal_text(text: str) -> bytes:
    b = text.encode()
    return _normal(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0].data.tobytes().strip()


@dataclass
class Index:
    """Passages and where each q-gram stands in them."""

    ids: list[int]
    passages: list[bytes]
    budget: np.ndarray  # edits allowed
    least: np.ndarray  # q-grams that a region within the budget shares at least
    width: np.ndarray  # diagonals of a band
    table: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    short: list[int]


def _budget(length: int, q: int, rate: float) -> int:
    """Edits allowed: ``rate`` of the length, yet few enough that the lemma asks for a shared q-gram at least."""
    return max(0, min(int(rate * length), (length - q) // q))


def _grams(block: Block, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all q-grams that lie within one document."""
    n = len(block.data) - q + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = block.prefix()
    starts = np.arange(n)
    ok = np.ones(n, bool)
    for end in block.at[1:-1]:
        ok[max(0, end - q + 1) : end] = False
    starts = starts[ok]
    return starts, block.hashes(starts, starts + q, sums)


def build_index(items: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE) -> Index:
    pairs = [(i, p) for i, t in items if (p := normal_text(t))]
    short = [k for k, (_, p) in enumerate(pairs) if len(p) < q]
    hashes, item, pos = [], [], []
    for k, (_, p) in enumerate(pairs):
        s, h = _grams(Block(np.frombuffer(p, np.uint8), np.array([0, len(p)]), lower=False), q)
        hashes.append(h), item.append(np.full(len(s), k)), pos.append(s)
    empty = np.zeros(0, np.int64)
    h, item, pos = np.concatenate([*hashes, empty.astype(np.uint64)]), np.concatenate([*item, empty]), np.concatenate([*pos, empty])
    order = np.lexsort((pos, item, h))
    h, item, pos = h[order], item[order], pos[order]
    uniq, first = np.unique(h, return_index=True)
    table = np.zeros(1 << _TABLE, bool)
    table[(uniq >> np.uint64(64 - _TABLE)).astype(np.int64)] = True
    budget = np.array([_budget(len(p), q, rate) for _, p in pairs], np.int64)
    least = np.array([max(1, len(p) - q + 1 - q * k) for (_, p), k in zip(pairs, budget)], np.int64)
    return Index([i for i, _ in pairs], [p for _, p in pairs], budget, least, 2 * (budget + 1), table, uniq, np.append(first, len(h)), item, pos, short)


def align(passage: bytes, region: bytes, lowest: int, highest: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of ``region`` nearest to ``passage``, or None if it takes more than ``budget`` edits.

    Only cells whose diagonal (region position minus passage position) is from ``lowest`` to ``highest`` are computed; the part may
    start and end anywhere. Ties go to the leftmost end.
    """
    at = region.find(passage)
    if at >= 0:
        return 0, at, at + len(passage)
    r, width, far = np.frombuffer(region, np.uint8), highest - lowest + 1, 1 << 20
    diagonals = np.arange(lowest, highest + 1)
    lanes = np.arange(width)
    # row[x]: edits of passage[:i] against a part that ends before region[i + lowest + x]; start: where that part begins
    inside = (diagonals >= 0) & (diagonals <= len(r))
    row, start = np.where(inside, 0, far), diagonals.copy()
    for i, c in enumerate(passage):
        at = i + diagonals  # region byte used on the diagonal
        ok = (at >= 0) & (at < len(r))
        same = np.zeros(width, bool)
        same[ok] = r[at[ok]] == c
        cost, begin = np.where(ok, row + ~same, far), start.copy()
        down, down_start = np.append(row[1:], far) + 1, np.append(start[1:], 0)  # passage byte without partner
        down = np.where((at + 1 >= 0) & (at + 1 <= len(r)), down, far)
        better = down < cost
        cost, begin = np.where(better, down, cost), np.where(better, down_start, begin)
        reach = np.minimum.accumulate(cost - lanes) + lanes  # region bytes without partner
        source = np.maximum.accumulate(np.where(cost == reach, lanes, 0))
        row, start = np.where((at + 1 >= 0) & (at + 1 <= len(r)), reach, far), begin[source]
    best = int(row.argmin())
    if row[best] > budget:
        return None
    return int(row[best]), int(start[best]), int(len(passage) + diagonals[best])


def _search(block: Block, index: Index, q: int):
    """(document, item, edits, start, end) in the normalised block: the best region of each passage in each document."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def put(doc: int, k: int, got: tuple[int, int, int]) -> None:
        if got < best.get((doc, k), (1 << 30, 0, 0)):
            best[doc, k] = got

    for k in index.short:
        for doc in range(block.n):
            at = block.data[block.at[doc] : block.at[doc + 1]].tobytes().find(index.passages[k])
            if at >= 0:
                put(doc, k, (0, int(block.at[doc]) + at, int(block.at[doc]) + at + len(index.passages[k])))
    starts, h = _grams(block, q)
    maybe = index.table[(h >> np.uint64(64 - _TABLE)).astype(np.int64)]
    starts, h = starts[maybe], h[maybe]
    if not len(starts) or not len(index.hashes):
        return best
    where = np.minimum(np.searchsorted(index.hashes, h), len(index.hashes) - 1)
    true = index.hashes[where] == h
    starts, where = starts[true], where[true]
    if not len(starts):
        return best
    many = index.first[where + 1] - index.first[where]
    #: positions are expanded to (position, passage) hits in runs of bounded length
    bounds = np.concatenate([[0], np.cumsum(many)])
    keys_all, counts_all = [], []
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 4_000_000, "right")) - 1)
        n = many[lo:hi]
        src = np.repeat(np.arange(lo, hi), n)
        entry = index.first[where[src]] + (np.arange(len(src)) - np.repeat(bounds[lo:hi] - bounds[lo], n))
        item, diagonal = index.item[entry], starts[src] - index.pos[entry]
        doc = block.doc_of(starts[src])
        diagonal = diagonal - block.at[doc] + len(max(index.passages, key=len))  # never negative
        w = index.width[item]
        band, rest = diagonal // w, diagonal % w
        # bands of 2w diagonals, a new one every w: each diagonal lies in two
        key = ((doc * len(index.passages) + item) << 32) | band
        key = np.concatenate([key, key[band > 0] - 1])
        k, c = np.unique(key, return_counts=True)
        keys_all.append(k), counts_all.append(c)
        del rest
        lo = hi
    key, inverse = np.unique(np.concatenate(keys_all), return_inverse=True)
    count = np.bincount(inverse, np.concatenate(counts_all)).astype(np.int64)
    pair, band = key >> 32, key & 0xFFFFFFFF
    doc, item = pair // len(index.passages), pair % len(index.passages)
    kept = np.flatnonzero(count >= index.least[item])
    pad = len(max(index.passages, key=len))
    for x in kept[np.lexsort((-count[kept], pair[kept]))].tolist():
        d, k = int(doc[x]), int(item[x])
        have = best.get((d, k))
        if have and have[0] == 0:
            continue
        passage, budget, w = index.passages[k], int(index.budget[k]), int(index.width[k])
        base, end = int(block.at[d]), int(block.at[d + 1])
        low = int(band[x]) * w - pad - budget
        high = int(band[x]) * w + 2 * w - 1 - pad + budget
        first, last = max(base, base + low), min(end, base + high + len(passage))
        if last <= first:
            continue
        got = align(passage, block.data[first:last].tobytes(), low - (first - base), high - (first - base), budget)
        if got:
            put(d, k, (got[0], first + got[1], first + got[2]))
    return best


_SCHEMA = "id long, item_id long, edits int, budget int, start long, end long"


def _indexes(spark: SparkSession, benchmark: DataFrame, q: int, rate: float) -> Iterator[tuple[Broadcast, bool]]:
    """The broadcast index of each pass, a part of the benchmark of about INDEX_CHARS, and whether it is the only one. Where there are
    several the caller writes a pass's rows before it asks for the next index, and the one before goes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("t IS NOT NULL AND length(t) > 0")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-total // INDEX_CHARS))
    for part in range(passes):
        own = sorted(items.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == part).collect(), key=lambda r: (r.i is None, r.i or 0, r.t))
        index = spark.sparkContext.broadcast(build_index([(r.i, r.t) for r in own], q, rate))
        yield index, passes == 1
        if passes > 1:
            index.destroy()


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = Q, rate: float = EDIT_RATE) -> DataFrame:
    """(id, item_id, edits, budget, start, end): the best region of every benchmark passage in every document that holds it.

    Texts are compared lower-cased (A-Z) with runs of spaces as one. A passage of m bytes is found where a region is within
    ``min(rate * m, (m - q) // q)`` edits. By the q-gram lemma such a region shares ``m - q + 1 - q * edits`` q-grams on
    diagonals that lie in one band, so no region is missed; each region that passes the count is verified by banded alignment.
    Passages shorter than q are looked for as they are. start and end are byte offsets in the text's UTF-8.

    Documents aren't shuffled. The index is broadcast: its size is bounded by INDEX_CHARS, and a larger benchmark is searched in
    several passes of that size, one after the other, so one index is held at a time. Null and empty texts and passages hold and match nothing; repeated rows are reported each;
    repeated item ids count as separate passages. Rows with a null id are reported with a null id. Empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    out = None
    for index, alone in _indexes(spark, benchmark, q, rate):

        def run(batches, index=index):
            known = index.value
            for b in batches:
                ids = b.column(0).to_pylist()
                found = []
                for lo, _, block in blocks(b.column(1)) if known.passages else ():
                    normal, came = _normal(block.raw, block.at)
                    for (d, k), (edits, s, e) in sorted(_search(normal, known, q).items()):
                        base = int(block.at[d])
                        found.append((ids[lo + d], known.ids[k], edits, int(known.budget[k]), int(came[s]) - base, int(came[e - 1]) + 1 - base))
                cols = list(zip(*found)) if found else [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["id", "item_id", "edits", "budget", "start", "end"])

        got = rows.mapInArrow(run, _SCHEMA)
        got = got if alone else write_table(got, "passages")
        out = got if out is None else out.unionByName(got)
    return out


def without_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", q: int = Q, rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs``, all columns, in which :func:`find_passages` finds nothing; each row is judged by its own text."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text_col)
    for index, alone in _indexes(spark, benchmark, q, rate):

        def run(batches, index=index):
            known = index.value
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for lo, _, block in blocks(b.column(at)) if known.passages else ():
                    normal, _ = _normal(block.raw, block.at)
                    clean[[lo + d for d, _ in _search(normal, known, q)]] = False
                yield b.filter(pa.array(clean))

        left = docs.mapInArrow(run, docs.schema)
        if not alone:
            left = write_table(left, "without-passages")
            drop_table(docs)
        docs = left
    return docs
