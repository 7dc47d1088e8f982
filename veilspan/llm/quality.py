"""Document quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, blocks, fold, sample_labelled, small_batches

#: Labelled training documents of each class, and bytes of their texts together; bits of a hashed word; rank of the interactions.
SAMPLE, SAMPLE_BYTES, BITS, RANK = 2500, 16 << 20, 14, 8
EPOCHS, RATE, RIDGE = 12, 0.05, 1e-4
THRESHOLD = 0.5
STATS = ("words", "bytes", "lines", "word_length", "distinct", "repeats", "top_word", "punctuation", "digits", "capitals", "other", "long_words", "stops", "line_length")


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)  # 0: separators
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 3, 4
    for c in range(33, 127):
        if kind[c] == 0:
            kind[c] = 5
    return kind


_KIND = _kinds()


@dataclass
class Rows:
    """Sparse rows: hashed words with values, and dense statistics."""

    first: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    stats: np.ndarray


def describe(block: Block) -> Rows:
    """A document's words, hashed; a value is the word's share of the document, square-rooted. Statistics are logs and shares."""
    s, e = block.tokens()
    doc, n = block.doc_of(s), block.n
    h = block.hashes(s, e, block.prefix())
    uniq, count = np.unique((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)), return_counts=True)
    owner = (uniq >> np.uint64(40)).astype(np.int64)
    words = np.bincount(doc, minlength=n)
    safe = np.maximum(words, 1)
    feature = ((uniq >> np.uint64(40 - BITS)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    value = np.sqrt(count / safe[owner])
    size = np.diff(block.at)
    sums = np.stack([np.concatenate([[0], np.cumsum(_KIND[block.raw] == k)]) for k in range(1, 6)])
    kinds = (sums[:, block.at[1:]] - sums[:, block.at[:-1]]) / np.maximum(size, 1)
    line = np.concatenate([[0], np.cumsum(block.raw == 10)])
    lines = line[block.at[1:]] - line[block.at[:-1]] + 1
    stop = np.concatenate([[0], np.cumsum((block.raw == 46) | (block.raw == 33) | (block.raw == 63))])
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    again = np.zeros(len(s), bool)
    if len(s):
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    stats = np.stack([
        np.log1p(words), np.log1p(size), np.log1p(lines), np.bincount(doc, e - s, n) / safe, np.bincount(owner, minlength=n) / safe,
        np.bincount(doc, again, n) / safe, top / safe, kinds[4], kinds[2], kinds[1], kinds[3],
        np.bincount(doc, e - s > 20, n) / safe, (stop[block.at[1:]] - stop[block.at[:-1]]) / safe, np.log1p(words / lines),
    ], axis=1)
    return Rows(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), feature.astype(np.int32), value.astype(np.float32), stats)


@dataclass
class Machine:
    """Weights [features], factors [features, rank]; the statistics are the last features."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def join(self, r: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value) of hashed words and standardised statistics, by row."""
        n, k = r.stats.shape
        z = np.clip((r.stats - self.mean) / self.sd, -4, 4) * 0.3
        row = np.concatenate([np.repeat(np.arange(n), np.diff(r.first)), np.repeat(np.arange(n), k)])
        feature = np.concatenate([r.feature, np.tile((1 << BITS) + np.arange(k), n)])
        value = np.concatenate([r.value, z.ravel()])
        order = np.argsort(row, kind="stable")
        return row[order].astype(np.int32), feature[order].astype(np.int32), value[order].astype(np.float32)

    def logit(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """w0 + sum w x + 1/2 sum_f ((sum v x)^2 - sum (v x)^2): linear in the number of features; also sum v x [rows, rank]."""
        vx = self.v[feature] * value[:, None].astype(np.float32)
        starts = np.searchsorted(row, np.arange(n))  # every row has its statistics, so none is empty
        s = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        linear = np.bincount(row, self.w[feature] * value, n)
        return self.bias + linear + 0.5 * ((s * s).sum(axis=1) - squares), s


def fit(samples: list[tuple[str, int]], seed: int = 7) -> Machine | None:
    """Logistic loss, classes weighed alike, by Adam over seeded minibatches."""
    y = np.array([int(v > 0) for _, v in samples])
    if not len(y) or y.all() or not y.any():
        return None
    rng = np.random.default_rng(seed)
    parts = [describe(block) for _, _, block in blocks(pa.array([s for s, _ in samples], pa.large_string()), 1 << 20)]
    held = np.cumsum([0, *(len(r.feature) for r in parts)])
    rows = Rows(np.concatenate([[0], *(r.first[1:] + h for r, h in zip(parts, held))]), *(np.concatenate([getattr(r, k) for r in parts]) for k in ("feature", "value", "stats")))
    size = (1 << BITS) + len(STATS)
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)).astype(np.float32), rows.stats.mean(axis=0), rows.stats.std(axis=0) + 1e-6)
    row, feature, value = m.join(rows)
    at = np.searchsorted(row, np.arange(len(y) + 1))
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    mom = [np.zeros(size), np.zeros(size), np.zeros((size, RANK), np.float32), np.zeros((size, RANK), np.float32)]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
            take = np.concatenate([np.arange(at[i], at[i + 1]) for i in part])
            r, f, x = np.repeat(np.arange(len(part)), at[part + 1] - at[part]), feature[take], value[take]
            z, s = m.logit(r, f, x, len(part))
            g = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            m.bias -= rate * g.sum()
            used, inverse = np.unique(f, return_inverse=True)
            gw = np.bincount(inverse, g[r] * x) + RIDGE * m.w[used]
            inner = (g[r] * x)[:, None] * (s[r] - m.v[f] * x[:, None])
            gv = np.stack([np.bincount(inverse, inner[:, k]) for k in range(RANK)], axis=1) + RIDGE * m.v[used]
            step += 1
            for theta, grad, a, b in ((m.w, gw, mom[0], mom[1]), (m.v, gv, mom[2], mom[3])):
                a[used] = 0.9 * a[used] + 0.1 * grad
                b[used] = 0.99 * b[used] + 0.01 * grad * grad
                theta[used] -= rate * (a[used] / (1 - 0.9**step)) / (np.sqrt(b[used] / (1 - 0.99**step)) + 1e-6)
    return m


def score_block(machine: Machine, block: Block) -> np.ndarray:
    z, _ = machine.logit(*machine.join(describe(block)), block.n)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted), a row for each row of ``docs``.

    The machine's features are the text's hashed words and its structure and size (STATS); ids, labels, languages and sources are
    no inputs. It learns from a sample of labelled training rows, bounded by SAMPLE rows a class and SAMPLE_BYTES of text together,
    whatever a text's length, and is broadcast; whole texts are scored where they are, without a shuffle. Null and empty texts are scored as texts without words. Without labels of both
    classes every score is 0. Repeated rows and null ids are scored like any other; an empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = spark.sparkContext.broadcast(fit(sample_labelled(own, labels, "quality", mod, held, SAMPLE, SAMPLE_BYTES, "quality")))

    def run(batches):
        for b in batches:
            score = np.zeros(b.num_rows)
            for lo, hi, block in blocks(b.column(2)) if model.value else ():
                score[lo:hi] = score_block(model.value, block)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    rows = own.select(F.col("doc_id").cast("long").alias("id"), (fold("doc_id", mod) == held).alias("held_out"), "text")
    return rows.mapInArrow(run, "id long, held_out boolean, score double, predicted int")
