"""Language identification: presence kernels over byte n-grams, Nystroem landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, blocks, fold, small_batches, write_table

#: Lengths of the n-grams (in UTF-8 bytes) that the spectrum blends, and bits of their hash.
LENGTHS, BITS = (1, 2, 3, 4), 18
#: Training rows of all languages together (shared among them, at most SAMPLE and about one at least each), of at most so many bytes each; landmarks of a language; n-grams that the kernel sees; ridge.
TOTAL, SAMPLE, SAMPLE_BYTES, LANDMARKS, GRAMS, RIDGE = 1600, 400, 1 << 16, 32, 8192, 1e-2
UNKNOWN = "und"
_PRIMES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)

#: Separators are one byte to the kernel; upper-case Latin-1 letters in UTF-8 fold as A-Z do.
_GAP = np.ones(256, bool)
_GAP[97:123] = False
_GAP[128:] = False


def letters(block: Block) -> np.ndarray:
    """The block's bytes with everything but letters (a-z and bytes above 127) as spaces, upper-case Latin-1 folded."""
    d = block.data
    out = np.where(_GAP[d], np.uint8(32), d)
    if len(d) > 1:
        up = (d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] <= 0x9E) & (d[1:] != 0x97)
        out[1:][up] += 0x20
    return out


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that start at each byte, by length."""
    out, code = [], np.zeros(len(data), np.uint32)
    for k in range(max(LENGTHS)):
        code = code[: max(0, len(data) - k)] * np.uint32(257) + data[k:].astype(np.uint32) + np.uint32(1)
        if k + 1 in LENGTHS:
            out.append((code * np.uint32(_PRIMES[k % 4])) >> np.uint32(32 - BITS))
    return out


def presence(data: np.ndarray, at: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    """[documents, n-grams] 1 where the document holds the n-gram, scaled to length 1; column: of each hash, ``width`` for none."""
    out = np.zeros((len(at) - 1, width + 1), np.float32)
    for d in range(len(at) - 1):
        for g in _grams(data[at[d] : at[d + 1]]):
            out[d, column[g]] = 1
    out = out[:, :width]
    return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))


def _of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    block = Block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    return letters(block), block.at


@dataclass
class Classifier:
    langs: list[str]
    column: np.ndarray
    width: int
    landmarks: np.ndarray  # [n-grams, landmarks]
    weights: np.ndarray  # [landmarks + 1, languages]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """One regression value a language; two products of a batch."""
        return (x @ self.landmarks) @ self.weights[:-1] + self.weights[-1]


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, grams: int = GRAMS, ridge: float = RIDGE) -> Classifier | None:
    """K(x, z) is the share of n-grams present in both; landmarks are texts of each language, the first by a seeded hash; ridge regression of one
    language against the rest in the landmarks' space (K_zz to the power -1/2). n-grams: those that differ most between languages."""
    names = sorted(set(langs))
    if not names:
        return None
    data, at = _of_texts(texts)
    number = {x: k for k, x in enumerate(names)}
    y = np.array([number[x] for x in langs])
    # one language after the other, so that many take no more memory than few
    most, least = np.zeros(1 << BITS, np.float32), np.ones(1 << BITS, np.float32)
    for k in range(len(names)):
        seen, docs = np.zeros(1 << BITS, np.float32), np.flatnonzero(y == k)
        for d in docs.tolist():
            own = np.zeros(1 << BITS, bool)
            for g in _grams(data[at[d] : at[d + 1]]):
                own[g] = True
            seen += own
        share = seen / len(docs)
        most, least = np.maximum(most, share), np.minimum(least, share)
    spread = most - least if len(names) > 1 else most
    chosen = np.sort(np.argsort(-spread, kind="stable")[:grams])
    column = np.full(1 << BITS, len(chosen), np.int32)
    column[chosen] = np.arange(len(chosen))
    x = presence(data, at, column, len(chosen))
    drawn = np.argsort([xxhash.xxh64_intdigest(t.encode(), 5) for t in texts], kind="stable")
    z = np.concatenate([drawn[y[drawn] == k][:landmarks] for k in range(len(names))])
    lm = x[z].T.astype(np.float64)
    values, vectors = np.linalg.eigh(lm.T @ lm)
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.hstack([(x @ lm) @ root, np.ones((len(x), 1))])
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    # each language weighs the same
    w = (1.0 / np.bincount(y, minlength=len(names)))[y][:, None]
    penalty = ridge * np.eye(phi.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(phi.T @ (phi * w) + penalty, phi.T @ (target * w))
    weights = np.vstack([root @ solved[:-1], solved[-1:]])
    return Classifier(names, column, len(chosen), lm.astype(np.float32), weights.astype(np.float32))


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, mod: int, held: int, per_lang: int = SAMPLE) -> list[tuple[str, str]]:
    """At most about ``per_lang`` training texts of each language, chosen by a seeded hash of the id and the text, and one at least.

    Texts of at most SAMPLE_BYTES are taken, whole; of a language that has none, the first SAMPLE_BYTES // 4 characters of others.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull() & (fold("id", mod) != held))
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), "id", "t"), 11) * F.lit(2.0**-53)
    rows = rows.withColumns({"long": F.octet_length("t") > SAMPLE_BYTES, "u": drawn})
    # the least (long, u) of a language is a row that is always taken
    langs = rows.groupBy("l").agg(F.count_if(~F.col("long")).alias("short"), F.count("*").alias("n"), F.min(F.struct("long", "u")).alias("least"))
    langs = write_table(langs.select("l", F.when(F.col("short") > 0, F.col("short")).otherwise(F.col("n")).alias("n"), "least"), "languages")
    many = langs.count()
    if not many:
        return []
    per_lang = min(per_lang, max(1, TOTAL // many))
    known = langs.withColumnRenamed("l", "of")
    rows = rows.join(F.broadcast(known), F.col("l") == F.col("of")).where(F.col("long") == F.col("least.long"))
    first = F.col("u") == F.col("least.u")
    text = F.when(F.col("long"), F.substring("t", 1, SAMPLE_BYTES // 4)).otherwise(F.col("t")).alias("t")
    # equal texts count once, so that they can't fill the sample
    firsts = rows.where(first).select("l", text).dropDuplicates().collect()
    others = rows.where(~first & (F.col("u") < F.lit(per_lang) / F.col("n"))).select("l", text).dropDuplicates().limit(2 * per_lang * many).collect()
    return sorted({(r.l, r.t) for r in [*firsts, *others]})


def predict_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 5, held: int = 0) -> DataFrame:
    """(id, held_out, lang_pred, score), a row for each row of ``docs``.

    Learns every language of the training rows (:func:`training_rows`; crc32 of the id modulo ``mod`` is not ``held``) from a sample
    bounded by TOTAL, SAMPLE and SAMPLE_BYTES; predicts every whole text from its text alone. Texts that are null, or have no letter, are
    ``und`` with score 0, as are all when nothing could be learned. score is the winner's regression value brought into 0 to 1. Ties
    go to the first language by name. Repeated rows and null ids are predicted like any other; an empty table gives no rows.
    Nothing is shuffled but the counts of languages; the model, which grows with the number of languages only, is broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = training_rows(docs, id_col, text_col, lang_col, mod, held)
    model = spark.sparkContext.broadcast(fit([t for _, t in known], [x for x, _ in known]))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (fold(id_col, mod) == held).alias("held_out"), F.col(text_col).cast("string").alias("t"),
                       F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("has"))

    def run(batches):
        clf = model.value
        for b in batches:
            pred, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            has = b.column(3).to_numpy(zero_copy_only=False)
            for lo, hi, block in blocks(b.column(2), 2 << 20) if clf else ():
                data = letters(block)
                for s in range(0, hi - lo, 256):
                    e = min(s + 256, hi - lo)
                    f = clf.scores(presence(data, block.at[s : e + 1], clf.column, clf.width))
                    best = f.argmax(axis=1)
                    for i, k in enumerate(best.tolist()):
                        if has[lo + s + i]:
                            pred[lo + s + i] = clf.langs[k]
                            score[lo + s + i] = min(1.0, max(0.0, (float(f[i, k]) + 1) / 2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")
