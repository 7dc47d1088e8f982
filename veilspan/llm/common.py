"""What the operators share: tables in the shared folder, folds, bounded samples, blocks of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer document makes a step of its own.
BLOCK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. Where it is unset, a session on one machine gets a folder of its
    own; on a cluster that is an error, as executors don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='veilspan-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of the tables written so far that are still there, oldest first.
_written: list[str] = []


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it back. The table goes when the application ends, if
    :func:`drop_table` or :func:`drop_tables_since` doesn't remove it before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veilspan_path = path
    _written.append(path)
    store, at = _store(spark, path)
    store.deleteOnExit(at)
    return out


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _remove(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    store.delete(at, True)
    if path in _written:
        _written.remove(path)


def drop_table(df: DataFrame) -> None:
    """Removes a table of :func:`write_table` that nothing reads any more."""
    path = getattr(df, "_veilspan_path", None)
    if path:
        _remove(df.sparkSession, path)


def tables_now() -> int:
    """A mark for :func:`drop_tables_since`."""
    return len(_written)


def drop_tables_since(mark: int, kept: DataFrame) -> None:
    """Removes the tables written since the mark, ``kept`` apart, once its rows are on disk."""
    for path in _written[mark:]:
        if path != getattr(kept, "_veilspan_path", None):
            _remove(kept.sparkSession, path)


def placed(docs: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """``docs`` with two more columns of longs, and their names: a place that no two rows share and that is the same on every read.

    It is the file and the row's number in it; a table that isn't read straight from files is written first.
    """
    names = tuple(f"{x}{'_' * k}" for x in ("_file", "_nth") for k in [next(k for k in range(99) if not {f"_file{'_' * k}", f"_nth{'_' * k}"} & set(docs.columns))])
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or "_metadata" in docs.columns:
        docs = write_table(docs, "rows")
    at = docs.metadataColumn("_metadata")
    return docs.select("*", F.xxhash64(at["file_path"]).alias(names[0]), at["row_index"].alias(names[1])), names


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as one row can hold a very long text. Arrow has no such setting for a single query; a session that
    has smaller batches keeps them."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def fold(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def row_hash(columns: list[str]) -> Column:
    """64-bit hash of a row's columns and of which of them are null."""
    return F.xxhash64(*[x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, per_class: int, budget: int, seed: str) -> list[tuple[str, int]]:
    """Labelled training texts, whole: of each class the first ``per_class`` rows by a seeded hash of id and text, until their texts hold
    half of ``budget`` bytes, and one at least.

    The bound is on rows and on their sum, so long texts are learned from as short ones are; only a text that alone is over a
    sixteenth of the budget is passed over where it doesn't fit any more, and shorter ones after it are still taken. Rows that share
    an id count the highest label; equal texts count once. The first rows by hash are found by a partial top-k of hashes and sizes,
    so only texts that are taken leave the executors, and reruns take the same ones.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", mod) != held))
        .groupBy("doc_id").agg((F.max(F.col(label).cast("int")) > 0).alias("y"))
    )
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", mod) != held))
    rows = rows.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("u"), F.octet_length("text").alias("size"))
    keys = rows.select("doc_id", "u", "size").join(known, "doc_id").select("y", "u", "size").distinct()
    taken = []
    for y in (False, True):
        own = keys.where(F.col("y") == y).orderBy("u").limit(per_class).collect()
        held_bytes = 0
        for r in own:
            if taken and taken[-1][0] == y and held_bytes + r["size"] > budget // 2:
                if r["size"] > budget // 16:
                    continue
                break
            taken.append((y, r["u"]))
            held_bytes += r["size"]
    if not taken:
        return []
    wanted = docs.sparkSession.createDataFrame(taken, "y boolean, u long")
    found = rows.join(F.broadcast(wanted), "u").select("text", "y").dropDuplicates().collect()
    return sorted({(r["text"], int(r["y"])) for r in found})


# ---- blocks of text as byte arrays -------------------------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: An odd base, so that its powers can be inverted modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: int = _BASE, name: str = "up") -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 20, 2 * len(have) if have is not None else 0)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[name] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Block:
    """Texts laid end to end: ``data`` (bytes, A-Z lower-cased), ``at`` (offsets of the documents), prefix sums for hashing."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = True):
        self.raw, self.at = data, at.astype(np.int64)
        self.data = _FOLD[data] if lower else data
        self.n = len(at) - 1

    def prefix(self) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power(n), out=sums[1:])
        return sums

    def hashes(self, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges."""
        return mix((sums[ends] - sums[starts]) * _power(len(self.data) + 1, _INVERSE, "down")[starts])

    def tokens(self, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes that aren't ``gap``, within documents."""
        off = gap[self.data]
        n = len(off)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, last = np.ones(n, bool), np.ones(n, bool)
        first[1:] = off[:-1]
        last[:-1] = off[1:]
        inner = self.at[(self.at > 0) & (self.at < n)]
        first[inner] = True
        last[inner - 1] = True
        return np.flatnonzero(first & ~off), np.flatnonzero(last & ~off) + 1

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, positions, "right") - 1


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, end row, Block) for runs of rows of about ``limit`` bytes; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, Block(data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j
