"""Token ids on disk: frequency-ranked, in byte-aligned variable length with control bytes apart."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, small_batches, write_table

#: Id that ends each document; ids of one segment of a file; distinct words that a worker remembers.
END, SEGMENT, CACHE = 2, 1 << 20, 1_000_000

# ---- the code ----------------------------------------------------------------------------------------------------
# A value takes 1 to 4 bytes, low byte first. A control byte holds the lengths (minus 1, two bits each, the first lowest) of four
# values; control bytes and data bytes are stored apart. The last control byte is filled up with lengths of 1 that have no data.


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    v = np.asarray(values, "<u4")
    size = 1 + (v >= 1 << 8).astype(np.int64) + (v >= 1 << 16) + (v >= 1 << 24)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    return (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes(), data.tobytes()


#: Of each control byte: the four lengths, and where each value starts.
_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_STARTS = np.concatenate([np.zeros((256, 1), np.int64), np.cumsum(_SIZES, axis=1)[:, :3]], axis=1)
_TOTALS = _SIZES.sum(axis=1)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values, by table lookup of the control bytes."""
    c = np.frombuffer(control, np.uint8)
    base = np.concatenate([[0], np.cumsum(_TOTALS[c])[:-1]]) if len(c) else np.zeros(0, np.int64)
    at = (base[:, None] + _STARTS[c]).ravel()[:n]
    d = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
    word = d[at] | d[at + 1] << np.uint32(8) | d[at + 2] << np.uint32(16) | d[at + 3] << np.uint32(24)
    return word & _MASKS[(_SIZES[c].ravel()[:n]) - 1]


# ---- tokenizing --------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts by the tokenizers library; words seen before are remembered.

    A text may be cut where the tokenizer's own pattern always cuts: at spaces and line feeds, which leave no id. Where that
    isn't known to hold (the file drops white space otherwise, or a piece of it can match an added token), texts go whole.
    """

    _MARKS = ".,!?;:%$&*#)]}|"

    def __init__(self, path: str, kind: str = "<u4"):
        from tokenizers import Tokenizer

        self.tok, self.kind = Tokenizer.from_file(path), kind
        self.model = self.tok.model
        self.cache: dict[str, bytes] = {}
        probe = "Ab c,d  e\n\nf.'s x\n1 2 l'l é́ ́ "
        self.cuts = self._whole([probe])[0] == b"".join(self._whole(re.split("[ \n]", probe)))
        table = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in table]
        chars = {**{b: chr(b) for b in table}, **{b: chr(256 + k) for k, b in enumerate(rest)}}
        self.visible = str.maketrans({chr(b): c for b, c in chars.items()})
        words = ["the", "zqx", "été", "straße", "niño", "хлеб"]
        self.by_word = self.cuts and all(self._word(w) == self._whole([w])[0] for w in words)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case word of letters only: the model alone decides, as the pattern keeps such a word whole."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.visible)
        return np.array([t.id for t in self.model.tokenize(word)], self.kind).tobytes()

    def _learn(self, words: set[str]) -> None:
        """A run of letters and the marks after it are separate to the pattern; only an apostrophe may bind both."""
        cache, rest = self.cache, []
        if len(cache) + len(words) > CACHE:
            cache.clear()
        normal, alone, marks = unicodedata.is_normalized, self._word, self._MARKS
        for w in words:
            if self.by_word and "Σ" not in w and "İ" not in w:
                low = w.lower()
                core = low.rstrip(marks)
                if core.isalpha() and normal("NFC", w):
                    ids = cache.get(core)
                    if ids is None:
                        ids = cache[core] = alone(core)
                    if len(core) < len(low):
                        ids = ids + self._mark(low[len(core) :])
                    cache[w] = ids
                    continue
            rest.append(w)
        for lo in range(0, len(rest), 4096):
            part = rest[lo : lo + 4096]
            cache.update(zip(part, self._whole(part)))

    def _mark(self, c: str) -> bytes:
        ids = self.cache.get(c)
        if ids is None:
            ids = self.cache[c] = self._whole([c])[0]
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as the bytes of numbers of the given kind."""
        if not self.cuts:
            return self._whole(texts)
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        out, lo = [], 0
        while lo < len(parts):
            hi, size = lo, 0
            while hi < len(parts) and (hi == lo or size < 200_000):
                size += len(parts[hi])
                hi += 1
            words = set().union(*parts[lo:hi])
            had = {w: i for w in words if (i := self.cache.get(w)) is not None}
            new = words - had.keys()
            if new:
                self._learn(new)
                cache = self.cache
                had.update((w, cache[w]) for w in new)
            get = had.__getitem__
            out += [b"".join(map(get, p)) for p in parts[lo:hi]]
            lo = hi
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One for a worker, which keeps it from task to task."""
    if (path, kind) not in _encoders:
        _encoders.clear()
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


# ---- files -------------------------------------------------------------------------------------------------------

_FILE = "part int, seq int, n_null int, doc_ids binary, lengths binary, n_ids long, control binary, data binary"


def _binary(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all rows end to end, how many each row has) of a binary column."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data.view(kind), np.diff(at) // np.dtype(kind).itemsize


def _tokens(docs: DataFrame, tokenizer_path: str, end: int, id_col: str, text_col: str) -> tuple[DataFrame, str, int]:
    """(table, kind, size): the table holds each document's ids (id, nth, ids) and a row of counts for each task (ids null).

    Ids take two bytes if the vocabulary allows. Counts are made of the ids at hand, so nothing is read again for them; they are a
    column of their own, which a scan for counts reads alone.
    """
    from tokenizers import Tokenizer

    size = max(end, Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)) + 1
    kind = "<u2" if size <= 1 << 16 else "<u4"
    last = np.array([end], kind).tobytes()
    names = ["id", "nth", "ids", "counts"]

    def tokenize(batches):
        enc, total, nth = encoder(tokenizer_path, kind), np.zeros(size, np.int64), 0
        for b in batches:
            found = [one + last for one in enc.encode(b.column(1).to_pylist())]
            total += np.bincount(np.frombuffer(b"".join(found), kind), minlength=size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(nth, nth + len(found))), pa.array(found, pa.binary()), pa.nulls(len(found), pa.binary())], names)
            nth += len(found)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()])], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return write_table(rows.mapInArrow(tokenize, "id long, nth long, ids binary, counts binary"), "ids"), kind, size


def _ranks(tokens: DataFrame, size: int) -> np.ndarray:
    """The ids that occur, most frequent first; ties by id. Sums of the tasks' counts, of which one row reaches the driver."""

    def add(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for one in b.column(0):
                total += np.frombuffer(one.as_py(), "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "c"])

    counts = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(add, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).collect()
    return np.array([r.token for r in sorted(counts, key=lambda r: (-r.c, r.token))], np.int64)


def write_ids(docs: DataFrame, tokenizer_path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """Writes all documents' ids in ascending order of id; returns the files and the ids by rank (most frequent first).

    Each row of the files is a segment: about SEGMENT ids of neighbouring documents as ranks, coded by :func:`encode_values`, with the
    documents' ids (64 bits) and lengths (32 bits) beside; the first ``n_null`` of them have no id. Segments are in order of (part,
    seq). Frequent ids take one byte. The container is Parquet in the shared folder, which executors can write on any store. Counts of
    the vocabulary (bounded) reach the driver; documents are tokenized where they are and then sorted by range, by id (null first),
    checksum of the ids and place, so that rows with the same id, or equal ones, can lie in several ranges.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokens, kind, size = _tokens(docs, tokenizer_path, end, id_col, text_col)
    by_rank = _ranks(tokens, size)
    rank = np.zeros(size, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    ranks, room = spark.sparkContext.broadcast(rank), SEGMENT

    def segments(batches):
        part, seq, known = TaskContext.get().partitionId(), 0, ranks.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        have = 0

        def segment():
            ids, null, sizes, values = (np.concatenate(c) for c in zip(*held))
            control, data = encode_values(values)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(null.sum())], pa.int32()), pa.array([ids.astype("<i8").tobytes()]),
                 pa.array([sizes.astype("<u4").tobytes()]), pa.array([len(values)], pa.int64()), pa.array([control]), pa.array([data])],
                ["part", "seq", "n_null", "doc_ids", "lengths", "n_ids", "control", "data"])

        for b in batches:
            flat, sizes = _binary(b.column(1), kind)
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            ids, values, at = b.column(0).fill_null(0).to_numpy(), known[flat], np.concatenate([[0], np.cumsum(sizes)])
            lo = 0
            while lo < len(ids):
                # documents that the segment has room for, and one at least where it is empty
                hi = int(np.searchsorted(at, at[lo] + room - have, "right")) - 1
                hi = min(len(ids), max(hi, lo if have else lo + 1))
                if hi > lo:
                    held.append((ids[lo:hi], null[lo:hi], sizes[lo:hi], values[at[lo] : at[hi]]))
                    have += int(at[hi] - at[lo])
                if hi < len(ids):
                    yield segment()
                    held, have, seq = [], 0, seq + 1
                lo = hi
        if held:
            yield segment()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = tokens.where("ids IS NOT NULL").withColumn("tie", F.crc32("ids")).repartitionByRange(n, "id", "tie", "nth").sortWithinPartitions("id", "tie", "nth")
    files = write_table(ordered.select("id", "ids").mapInArrow(segments, _FILE), "token-files")
    drop_table(tokens)
    return files, by_rank


def read_ids(files: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """(id, start, n_tokens, ids binary): the documents of the files; start counts the ids of all documents before.

    Segments are numbered by sums over parts and over the segments of a part, one row each; they are decoded where they are.
    """
    spark = files.sparkSession
    ids = spark.sparkContext.broadcast(by_rank.astype("<u4"))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    heads = files.select("part", "seq", "n_ids").withColumn("own", F.coalesce(F.sum("n_ids").over(own), F.lit(0)))
    heads = heads.join(parts, "part").select("part", "seq", (F.col("base") + F.col("own")).alias("start"))

    def decode(batches):
        known = ids.value
        for b in batches:
            for k in range(b.num_rows):
                n_null, doc_ids, lengths, n, control, data, start = (b.column(c)[k].as_py() for c in range(7))
                sizes = np.frombuffer(lengths, "<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                raw = known[decode_values(control, data, n)]
                at = np.concatenate([[0], ends]) * 4
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])
                own = pa.array(np.frombuffer(doc_ids, "<i8"), mask=np.arange(len(sizes)) < n_null)
                yield pa.RecordBatch.from_arrays([own, pa.array(start + ends - sizes), pa.array(sizes), texts.cast(pa.binary())], ["id", "start", "n_tokens", "ids"])

    return files.join(heads, ["part", "seq"]).select("n_null", "doc_ids", "lengths", "n_ids", "control", "data", "start").mapInArrow(
        decode, "id long, start long, n_tokens long, ids binary")


def token_digest(docs: DataFrame, tokenizer_path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n_tokens, ids_crc32): what the files hold of each document, read back.

    Null and empty texts have the end id alone. Rows with a null id come first. Rows with the same id stand next to each other, in
    order of their ids' checksum; repeated rows count each. A very long text is one document of a segment of its own. An empty table
    gives no rows; other columns are ignored.
    """
    files, by_rank = write_ids(docs, tokenizer_path, end, id_col, text_col)
    return read_ids(files, by_rank).select("id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

