"""SimHash fingerprints and their near-duplicate components by bit-sliced comparison."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import placed, row_hash, small_batches, write_table
from .components import connected_components

#: Fingerprints of 64 bits are cut into this many parts; two that differ in at most RADIUS bits agree on BLOCKS - RADIUS parts.
BLOCKS, RADIUS = 5, 3
#: Fingerprints of one key that one comparison takes; larger keys are cut into slices that meet pair by pair.
SLICE = 2048
#: Small keys are compared together until they hold so many fingerprints.
BATCH = 512


# ---- fingerprints ------------------------------------------------------------------------------------------------


def _shingle_hashes(text: bytes, width: int) -> list[int]:
    words = text.lower().split()  # of bytes: folds A-Z only, cuts at the six ASCII spaces only
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(b" ".join(words), 42)]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *(ends[: len(words) - width]).tolist()]
    return [digest(line[s : e - 1], 42) for s, e in zip(starts, ends[width - 1 :].tolist())]


def fingerprints(texts: pa.Array, width: int = 3) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text: bit b is set if over half of the shingles' XXH64 have it; no words or null: 0."""
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    rows, counts = [], []

    def flush() -> None:
        if not hashes:
            return
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        total = np.add.reduceat(bits, starts, axis=0, dtype=np.uint32)
        major = total * 2 > np.array(counts, np.uint32)[:, None]
        out[rows] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
        hashes.clear(), rows.clear(), counts.clear()

    for i, t in enumerate(texts):
        got = _shingle_hashes(t.as_py().encode() if t.is_valid else b"", width)
        if got:
            hashes += got
            rows.append(i)
            counts.append(len(got))
        if len(hashes) > 100_000:
            flush()
    flush()
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, carried: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp long) and the columns ``carried``, which are longs: the fingerprint's bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1), width).view(np.int64)), *b.columns[2:]], ["id", "fp", *carried])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), *carried).mapInArrow(run, ", ".join(f"{c} long" for c in ("id", "fp", *carried)))


# ---- bit-sliced comparison ---------------------------------------------------------------------------------------


def near_pairs(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All i < j with at most ``radius`` (1 to 3) differing bits among ``fps`` (uint64).

    The fingerprints are stored as 64 vertical bit planes. For every query at once a plane is compared with the query's bit and
    the outcome enters carry-save counters (ones, twos) with a saturated plane ``over``. Cells (query, word of 64 fingerprints)
    in which all exceed the radius are abandoned.
    """
    n = len(fps)
    words = (n + 63) // 64
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((64, words * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    flip = np.where(bits.T != 0, np.uint64(2**64 - 1), np.uint64(0))  # [bit, query]
    found_i, found_j = [], []
    step = max(1, (1 << 18) // words)
    for q0 in range(0, n, step):
        q1 = min(n, q0 + step)
        q = np.arange(q0, q1)
        # only fingerprints after the query count: the rest start as exceeded
        word_of = q // 64
        cols = np.arange(words)
        over = np.where(cols[None, :] < word_of[:, None], np.uint64(2**64 - 1), np.uint64(0))
        low = np.uint64(2**64 - 1) >> (np.uint64(63) - (q % 64).astype(np.uint64))
        over[np.arange(len(q)), word_of] = low
        if n % 64:
            over[:, -1] |= ~(np.uint64(2**64 - 1) >> np.uint64(64 - n % 64))
        cell_q, cell_w = np.nonzero(~over)
        over = over[cell_q, cell_w]
        qs = cell_q + q0
        ones, twos = np.zeros_like(over), np.zeros_like(over)
        for b in range(64):
            x = planes[b, cell_w] ^ flip[b, qs]
            carry = ones & x
            ones ^= x
            over |= twos & carry  # a fourth difference
            twos ^= carry
            if radius < 3:
                over |= twos if radius == 1 else twos & ones
            if b % 4 == 3:
                live = over != np.uint64(2**64 - 1)
                if not live.all():
                    over, ones, twos, cell_w, qs = over[live], ones[live], twos[live], cell_w[live], qs[live]
                if not len(over):
                    break
        if len(over):
            hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            c, lane = np.nonzero(hit)
            found_i.append(qs[c])
            found_j.append(cell_w[c] * 64 + lane)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def _stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among ``fps`` as few edges: every fingerprint of a group of linked ones to its smallest."""
    fps = np.unique(fps)
    i, j = near_pairs(fps)
    if not len(i):
        return fps[:0], fps[:0]
    root = np.arange(len(fps))
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(fps)))
    return fps[own], fps[root[own]]


def _compare(batches):
    """Batches (key, a, b, fp) sorted by group; groups are taken whole, small ones together."""

    def edges(parts):
        a, b = _stars(np.concatenate(parts).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    done, open_, last = [], [], None
    size = 0
    for batch in batches:
        group = np.stack([batch.column(k).to_numpy() for k in range(3)])
        fp = batch.column(3).to_numpy()
        if not len(fp):
            continue
        cut = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)]):
            own = tuple(group[:, s])
            if own != last:
                done += open_
                open_, last = [], own
                if size >= BATCH:
                    yield edges(done)
                    done, size = [], 0
            open_.append(fp[s:e])
            size += e - s
    if size:
        yield edges(done + open_)


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Edges (a, b) over distinct ``fp``: their components are those of all pairs within RADIUS bits.

    Two fingerprints within RADIUS of each other agree on at least BLOCKS - RADIUS of their BLOCKS parts, so they share one of
    the C(5, 2) = 10 keys made of two parts (25 or 26 bits). Keys held by one fingerprint are of no use and go before Python.
    A key with more than SLICE fingerprints is cut into slices by a hash and each two slices meet in a group of their own; nothing
    is capped. What leaves a group is a star over each linked set, never its pairs.
    """
    cuts = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    masks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(BLOCKS)]
    keys = []
    for t, parts in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS)):
        mask = sum(masks[p] for p in parts)
        mask -= (1 << 64) * (mask >> 63)
        keys.append(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(mask))))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(counts, "key")
    slices = F.ceil(F.col("n") / F.lit(SLICE)).cast("int")
    own = F.pmod(F.xxhash64(F.lit("slice"), "fp"), slices).cast("int")
    meet = F.transform(F.sequence(F.lit(0), slices - 1), lambda o: F.struct(F.least(o, own).alias("a"), F.greatest(o, own).alias("b")))
    rows = rows.select("key", "fp", F.explode(meet).alias("m")).select("key", F.col("m.a").alias("a"), F.col("m.b").alias("b"), "fp")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b")
    return rows.mapInArrow(_compare, "a long, b long")


def _groups(fps: DataFrame) -> DataFrame:
    """``fps``, a row for each ``fp``, with ``root``, which is the same for all fingerprints that links connect."""
    roots = connected_components(link_fingerprints(fps.select("fp"))).select(F.col("node").alias("fp"), "root")
    return fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, component): one row for each row of ``docs``.

    component is the smallest id reachable over links of at most 3 differing bits, rows with equal fingerprints included. Texts
    that are null or have no word have fingerprint 0 and are linked like any other. A row whose id is null takes no part in
    linking and gets a null component. Repeated ids and repeated rows stay; empty input gives no rows; other columns are ignored.
    """
    own = write_table(with_fingerprint(docs, id_col, text_col, width), "fingerprints")
    fps = own.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("least"))
    group = _groups(fps)
    least = group.groupBy("root").agg(F.min("least").alias("component"))
    found = group.join(least, "root").select("fp", "component")
    return own.join(found, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group of linked texts (:func:`simhash_components`): those with the
    smallest id, then the smallest hash of the row; of rows equal in all columns, one.

    Rows with a null id are linked among themselves only, so they never stand for a row with an id or the other way round. Rows that
    share an id but are in different groups are decided on their own. A row is known by its place (:func:`placed`); the kept places
    grow with the table, so they are joined by a merge and texts are shuffled once, whatever the size. An empty table gives no rows.
    """
    keyed, place = placed(docs)
    keyed = keyed.withColumn(place[0] + "_row", row_hash(docs.columns))
    row = place[0] + "_row"
    own = write_table(with_fingerprint(keyed, id_col, text_col, carried=(row, *place)), "fingerprints")

    def firsts(rows: DataFrame) -> DataFrame:
        least = rows.groupBy("fp").agg(F.min(F.struct("id", row, *place)).alias("least"))
        return _groups(least).groupBy("root").agg(F.min("least").alias("least")).select(*[F.col(f"least.{c}").alias(c) for c in place])

    kept = firsts(own.where("id IS NOT NULL"))
    if not own.where("id IS NULL").isEmpty():
        kept = kept.unionByName(firsts(own.where("id IS NULL")))
    return keyed.join(kept.hint("merge"), list(place), "left_semi").select(*docs.columns)


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
