"""Toxic spans by a linear-chain conditional random field; document scores from its marginals."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Block, blocks, fold, mix, sample_labelled, small_batches
from .langid import letters

#: Labelled training documents of each class, and bytes of their texts together.
SAMPLE, SAMPLE_BYTES = 2500, 16 << 20
#: Bytes of text whose tokens and hashes are held at once.
STEP_BYTES = 1 << 20
#: A feature counts from so many toxic training documents on (or two thirds of a hundredth of them, if more), and if its share among
#: them is so many times that among the others; the most telling FEATURES are kept.
LEAST, LIFT, FEATURES = 3, 20.0, 1024
#: Training cuts longer sentences into chains of so many tokens; scoring takes them whole.
CHAIN = 100
#: Bytes of the word starts and ends that are features besides whole words and pairs of neighbouring words.
STARTS, END = (4, 6, 8), 4
THRESHOLD = 0.7
#: A token is part of a reported span from this marginal on.
SPAN = 0.5


@dataclass
class Tokens:
    """Letter runs of a block with a document and a sentence each."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    sentence: np.ndarray  # number, ascending
    hashes: list[np.ndarray]  # of whole words, their starts, their ends and pairs with the word before; 0 for none


_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 59, 63]] = True
_WHITE = np.zeros(256, bool)
_WHITE[32] = True


def tokenize(block: Block) -> Tokens:
    """Words are runs of letters; a sentence ends at . ! ? ; or a line's end, or with the document."""
    stops = np.cumsum(_STOP[block.data])
    plain = Block(letters(block), block.at, lower=False)
    s, e = plain.tokens(_WHITE)
    sums, doc = plain.prefix(), block.doc_of(s)
    new = np.ones(len(s), bool)
    if len(s):
        new[1:] = (doc[1:] != doc[:-1]) | (stops[s[1:]] != stops[s[:-1]])
    hashes = [plain.hashes(s, e, sums)]
    for n in STARTS:
        h = np.zeros(len(s), np.uint64)
        long = np.flatnonzero(e - s >= n)
        h[long] = plain.hashes(s[long], s[long] + n, sums) ^ np.uint64(n)
        hashes.append(h)
    h = np.zeros(len(s), np.uint64)
    long = np.flatnonzero(e - s > END)
    h[long] = plain.hashes(e[long] - END, e[long], sums) ^ np.uint64(1 << 20)
    hashes.append(h)
    h = np.zeros(len(s), np.uint64)
    pair = np.flatnonzero(~new)
    h[pair] = mix(hashes[0][pair - 1] * np.uint64(0x9E3779B97F4A7C15) + hashes[0][pair])
    hashes.append(h)
    return Tokens(s, e, doc, np.cumsum(new) - 1, hashes)


@dataclass
class Crf:
    """Two labels, 0 plain and 1 toxic. Emission: bias + the token's features + those of its neighbours; transition: 2 x 2."""

    keys: np.ndarray  # hashes of the features
    own: np.ndarray  # weights of a token's own features
    side: np.ndarray  # weights of its neighbours' features
    bias: float
    step: np.ndarray  # [from, to]
    doc: np.ndarray  # weights of the document's features, then their intercept
    mean: np.ndarray
    sd: np.ndarray

    def plain(self, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sentences of tokens without a feature: the forward value of label 1 by place, its backward value by tokens that
        follow, the log partition by length. A message there depends on its place only, so all lengths share them."""
        if len(self._plain[0]) < longest:
            e, w = math.exp(self.bias), np.exp(self.step)
            size = max(256, 2 * longest)
            ahead, behind, z = np.zeros(size), np.zeros(size), np.zeros(size + 1)
            a0, a1, b0, b1, fa, fb = 1.0, e, 1.0, 1.0, 0.0, 0.0
            for k in range(size):
                ahead[k], behind[k], z[k + 1] = math.log(a1) + fa, math.log(b1) + fb, math.log(a0 + a1) + fa
                a0, a1 = a0 * w[0, 0] + a1 * w[1, 0], (a0 * w[0, 1] + a1 * w[1, 1]) * e
                b0, b1 = w[0, 0] * b0 + w[0, 1] * e * b1, w[1, 0] * b0 + w[1, 1] * e * b1
                sa, sb = a0 + a1, b0 + b1
                a0, a1, fa, b0, b1, fb = a0 / sa, a1 / sa, fa + math.log(sa), b0 / sb, b1 / sb, fb + math.log(sb)
            self._plain = ahead, behind, z
        return self._plain

    def features(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(token, number of the feature) of all features that tokens have, each once a token, by token."""
        tokens, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for h in t.hashes if len(self.keys) else ():
            some = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.sorted, h[some]), len(self.keys) - 1)
            ok = self.sorted[at] == h[some]
            tokens.append(some[ok]), found.append(self.order[at[ok]])
        both = np.unique(np.concatenate(tokens) * (len(self.keys) + 1) + np.concatenate(found))
        return both // (len(self.keys) + 1), both % (len(self.keys) + 1)

    def __post_init__(self):
        self.order = np.argsort(self.keys)
        self.sorted = self.keys[self.order]
        self._plain = (np.zeros(0),) * 3
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys >> np.uint64(48)).astype(np.int64)] = True


def _runs(sentence: np.ndarray, chosen: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Token positions [sentence, place] and lengths of the chosen sentences, those of like length together."""
    first = np.searchsorted(sentence, chosen)
    size = np.searchsorted(sentence, chosen, "right") - first
    order, out, i = np.argsort(size, kind="stable"), [], 0
    while i < len(order):
        j = i + 1
        top = max(8, int(size[order[i]] * 1.5))
        while j < len(order) and size[order[j]] <= top and (j - i) * top < 400_000:
            j += 1
        part = order[i:j]
        width = int(size[part].max())
        out.append((np.minimum(first[part][:, None] + np.arange(width), len(sentence) - 1), size[part]))
        i = j
    return out


def forward_backward(emit: np.ndarray, size: np.ndarray, step: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of label 1 [sentence, place], log partition, and expected transitions [2, 2], sentences weighed by ``weight``; emit:
    score of label 1."""
    n, width = emit.shape
    weight = np.ones(n) if weight is None else weight
    live = np.arange(width)[None, :] < size[:, None]
    a = np.zeros((width, n, 2))
    a[0, :, 1] = emit[:, 0]
    for k in range(1, width):
        new = np.logaddexp(a[k - 1, :, :1] + step[0], a[k - 1, :, 1:] + step[1])
        new[:, 1] += emit[:, k]
        a[k] = np.where(live[:, k, None], new, a[k - 1])
    z = np.logaddexp(a[-1, :, 0], a[-1, :, 1])
    b, moves = np.zeros((width, n, 2)), np.zeros((2, 2))
    for k in range(width - 2, -1, -1):
        nxt = b[k + 1].copy()
        nxt[:, 1] += emit[:, k + 1]
        both = step[None] + nxt[:, None, :]
        on = live[:, k + 1]
        b[k] = np.where(on[:, None], np.logaddexp(both[:, :, 0], both[:, :, 1]), 0.0)
        moves += (np.exp(a[k][on][:, :, None] + both[on] - z[on][:, None, None]) * weight[on][:, None, None]).sum(axis=0)
    marginal = np.exp(a[:, :, 1] + b[:, :, 1] - z).T
    return np.where(live, marginal, 0.0), z, moves


def _emissions(crf: Crf, at: np.ndarray, f: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    n = len(sentence)
    side = np.bincount(at, crf.side[f], n)
    same = sentence[1:] == sentence[:-1]
    out = crf.bias + np.bincount(at, crf.own[f], n)
    out[1:] += np.where(same, side[:-1], 0)
    out[:-1] += np.where(same, side[1:], 0)
    return out


def marginals(crf: Crf, t: Tokens) -> np.ndarray:
    """Each token's probability to be toxic. Sentences without a feature depend on their length only and are computed once."""
    at, f = crf.features(t)
    out = np.zeros(len(t.start))
    if not len(out):
        return out
    emit = _emissions(crf, at, f, t.sentence)
    telling = np.unique(t.sentence[at])
    for at, size in _runs(t.sentence, telling):
        p, _, _ = forward_backward(emit[at], size, crf.step)
        live = np.arange(at.shape[1])[None, :] < size[:, None]
        out[at[live]] = p[live]
    plain = np.ones(t.sentence[-1] + 1, bool)
    plain[telling] = False
    rest = np.flatnonzero(plain)
    if len(rest):
        sizes = np.bincount(t.sentence)[rest]
        first = np.searchsorted(t.sentence, rest)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ahead, behind, z = crf.plain(int(sizes.max()))
        n = np.repeat(sizes, sizes)
        out[np.repeat(first, sizes) + place] = np.exp(ahead[place] + behind[n - 1 - place] - z[n])
    return out


def document_features(p: np.ndarray, t: Tokens, docs: int) -> np.ndarray:
    """Of each document: expected toxic tokens (log), their share of the tokens (log), the highest and second highest marginal."""
    n = np.bincount(t.doc, minlength=docs)
    strong = np.where(p >= 0.05, p, 0.0)
    total = np.bincount(t.doc, strong, docs)
    top, second = np.zeros(docs), np.zeros(docs)
    order = np.lexsort((-p, t.doc))
    d = t.doc[order]
    if len(d):
        head = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        top[d[head]] = p[order[head]]
        nxt = head + 1
        ok = nxt < len(d)
        ok[ok] = d[nxt[ok]] == d[head[ok]]
        second[d[head[ok]]] = p[order[nxt[ok]]]
    return np.stack([np.log1p(total), np.log(total / np.maximum(n, 1) + 1e-4), top, second], axis=1)


def _holders(t: Tokens) -> list[np.ndarray]:
    """Hashes of each kind of feature, each as often as there are documents that hold it."""
    out = []
    for h in t.hashes:
        ok = h != 0
        own, doc = h[ok], t.doc[ok]
        _, once = np.unique(own * np.uint64(0x9E3779B97F4A7C15) + doc.astype(np.uint64), return_index=True)  # once a document
        out.append(own[once])
    return out


def _features(toxic: list[str], plain: list[str]) -> np.ndarray:
    """Hashes of features that toxic documents hold far more often, the most telling first. Only what enough toxic documents hold is
    looked for in the others."""
    least = max(LEAST, len(toxic) // 150)
    parts = [[np.unique(own, return_counts=True) for own in _holders(t)] for _, t in _blocks(toxic)]
    found: list[tuple[float, int]] = []
    known = []
    for kind in zip(*parts):
        h, inverse = np.unique(np.concatenate([u for u, _ in kind]), return_inverse=True)
        hot = np.bincount(inverse, np.concatenate([n for _, n in kind]), len(h))
        known.append((h[hot >= least], hot[hot >= least], np.zeros(int((hot >= least).sum()))))
    del parts
    for _, t in _blocks(plain):
        for own, (h, _, cold) in zip(_holders(t), known):
            if len(h):
                at = np.minimum(np.searchsorted(h, own), len(h) - 1)
                cold += np.bincount(at[h[at] == own], minlength=len(h))
    for h, hot, cold in known:
        lift = (hot / len(toxic)) / ((cold + 0.5) / len(plain))
        found += [(-hot[k] * np.log(lift[k]), int(h[k])) for k in np.flatnonzero(lift >= LIFT)]
    return np.array([h for _, h in sorted(found)[:FEATURES]], np.uint64)


def _blocks(texts: list[str]):
    """(first document, its tokens) by blocks of a megabyte."""
    for lo, _, block in blocks(pa.array(texts, pa.large_string()), STEP_BYTES):
        yield lo, tokenize(block)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x1, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + ridge * np.eye(len(w)) * weight.sum()
        w = w + np.linalg.solve(h, x1.T @ (weight * (y - p)) - ridge * weight.sum() * w)
    return w


@dataclass
class _Chains:
    """Training chains that have a feature: chain and document of each token, and the features tokens have; lengths of all others."""

    chain: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    f: np.ndarray
    lengths: np.ndarray
    many: np.ndarray


def _chains(crf: Crf, texts: list[str]) -> _Chains:
    """A chain is a sentence, or CHAIN tokens of a longer one. Of the words only numbers of features are kept."""
    chain, doc, at, f, rest = [], [], [], [], Counter()
    held = chains = 0
    for first, t in _blocks(texts):
        a, g = crf.features(t)
        place = np.arange(len(t.sentence)) - np.searchsorted(t.sentence, t.sentence)
        new = np.ones(len(place), bool)
        new[1:] = (t.sentence[1:] != t.sentence[:-1]) | (place[1:] % CHAIN == 0)
        number = np.cumsum(new) - 1
        telling = np.zeros(int(new.sum()), bool)
        telling[number[a]] = True
        sizes = np.bincount(number, minlength=len(telling))
        rest.update(Counter(sizes[~telling].tolist()))
        kept = telling[number]
        moved = np.cumsum(kept) - 1
        chain.append((np.cumsum(telling) - 1)[number[kept]].astype(np.int32) + np.int32(chains)), doc.append((t.doc[kept] + first).astype(np.int32))
        at.append((moved[a] + held).astype(np.int32)), f.append(g.astype(np.int16))
        held, chains = held + int(kept.sum()), chains + int(telling.sum())
    lengths = np.array(sorted(rest), np.int64)
    return _Chains(*(np.concatenate(x) for x in (chain, doc, at, f)), lengths, np.array([rest[n] for n in lengths.tolist()], np.int64))


def fit(samples: list[tuple[str, int]], rounds: int = 40) -> Crf | None:
    """Trains on labelled documents. Only documents are labelled, so tokens get labels from them: a token with a feature is
    labelled toxic in a toxic document, every other token is labelled plain. Conditional likelihood of all chains by gradient steps
    (Adam); chains without a feature are alike if they are of one length, so each length is computed once and weighed. Texts are
    tokenized in blocks, again for each of the three passes, so a block's hashes are all that is held at a time."""
    toxic, plain = [s for s, v in samples if v > 0], [s for s, v in samples if v <= 0]
    if not toxic or not plain:
        return None
    texts, y = toxic + plain, np.repeat([1, 0], [len(toxic), len(plain)])
    keys = _features(toxic, plain)
    k = len(keys)
    crf = Crf(keys, np.zeros(k), np.zeros(k), -4.0, np.zeros((2, 2)), np.zeros(5), np.zeros(4), np.ones(4))
    c = _chains(crf, texts)
    n, lengths, many = len(c.chain), c.lengths, c.many
    gold = np.zeros(n, bool)
    gold[c.at[y[c.doc[c.at]] == 1]] = True
    runs = _runs(c.chain, np.unique(c.chain))
    same = np.append(c.chain[1:] == c.chain[:-1], False)[:n]
    theta = {"own": crf.own, "side": crf.side, "bias": np.array([-4.0]), "step": crf.step}
    m, v = {x: np.zeros_like(w) for x, w in theta.items()}, {x: np.zeros_like(w) for x, w in theta.items()}
    for r in range(1, rounds + 1):
        crf.bias = float(theta["bias"][0])
        emit, g, diff = _emissions(crf, c.at, c.f, c.chain), {x: np.zeros_like(w) for x, w in theta.items()}, np.zeros(n)
        for at, size in runs:
            p, _, moves = forward_backward(emit[at], size, crf.step)
            live = np.arange(at.shape[1])[None, :] < size[:, None]
            goal = gold[at] & live
            diff[at[live]] = (goal - p)[live]
            if at.shape[1] > 1:
                pair = goal[:, :-1] * 2 + goal[:, 1:]
                g["step"] += np.bincount(pair[live[:, 1:]], minlength=4).reshape(2, 2) - moves
        before, after = np.concatenate([[0.0], np.where(same[:-1], diff[:-1], 0)]), np.append(np.where(same[:-1], diff[1:], 0), 0.0)
        g["own"] += np.bincount(c.f, diff[c.at], k)
        g["side"] += np.bincount(c.f, (before + after)[c.at], k)
        g["bias"] += diff.sum()
        if len(lengths):
            p, _, moves = forward_backward(np.full((len(lengths), int(lengths.max())), crf.bias), lengths, crf.step, many.astype(float))
            g["bias"] -= (p.sum(axis=1) * many).sum()
            g["step"] -= moves
            g["step"][0, 0] += ((lengths - 1) * many).sum()
        for x, w in theta.items():
            grad = g[x] - 0.05 * w
            m[x] = 0.9 * m[x] + 0.1 * grad
            v[x] = 0.99 * v[x] + 0.01 * grad * grad
            w += 0.3 * (m[x] / (1 - 0.9**r)) / (np.sqrt(v[x] / (1 - 0.99**r)) + 1e-8)
    crf.bias, crf._plain = float(theta["bias"][0]), (np.zeros(0),) * 3
    found = np.zeros((len(y), 4))
    for lo, hi, block in blocks(pa.array(texts, pa.large_string()), STEP_BYTES):
        t = tokenize(block)
        found[lo:hi] = document_features(marginals(crf, t), t, hi - lo)
    crf.mean, crf.sd = found.mean(axis=0), found.std(axis=0) + 1e-6
    crf.doc = _logistic((found - crf.mean) / crf.sd, y, np.ones(len(y)))
    return crf


def score_block(crf: Crf, block: Block) -> tuple[np.ndarray, Tokens, np.ndarray]:
    t = tokenize(block)
    p = marginals(crf, t)
    x = (document_features(p, t, block.n) - crf.mean) / crf.sd
    return 1 / (1 + np.exp(-np.clip(x @ crf.doc[:-1] + crf.doc[-1], -30, 30))), t, p


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1) -> Crf | None:
    return fit(sample_labelled(docs, labels, "toxic", mod, held, SAMPLE, SAMPLE_BYTES, "toxicity"))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 3, held: int = 1, threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """(id, held_out, score, predicted, spans), a row for each row of ``docs``; with ``keep`` its columns before, as struct ``row``.

    A conditional random field tags the tokens of each sentence; a logistic model turns a document's marginals (their sum, share
    and highest values) into its score. spans lists [start, end) in bytes of the text's UTF-8 and the highest marginal of runs of tokens whose
    marginal is SPAN or more. Both models learn from a sample of labelled training rows, bounded by SAMPLE rows a class and SAMPLE_BYTES of
    text together, whatever a text's length; ids, labels, languages and sources are no inputs of a score. Whole texts are scored,
    sentence by sentence, however long, without a shuffle.

    Null and empty texts are scored as documents without tokens. Without labels of both classes every score is 0. Repeated rows
    and null ids are scored like any other; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), labels, mod, held))
    text = F.col(text_col).cast("string")
    row = F.struct(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns]) if keep else F.struct(text.alias(text_col))
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), (fold(id_col, mod) == held).alias("held_out"))
    names, first = (["row"], 0) if keep else ([], 1)

    def run(batches):
        crf = model.value
        for b in batches:
            score, spans = np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]
            for lo, hi, block in blocks(b.column(0).field(text_col), STEP_BYTES) if crf else ():
                score[lo:hi], t, p = score_block(crf, block)
                hot = np.flatnonzero(p >= SPAN)
                last = -2
                for i in hot.tolist():
                    d = lo + int(t.doc[i])
                    s, e = int(t.start[i] - block.at[t.doc[i]]), int(t.end[i] - block.at[t.doc[i]])
                    if i == last + 1 and t.sentence[i] == t.sentence[last]:
                        spans[d][-1]["end"], spans[d][-1]["p"] = e, max(spans[d][-1]["p"], float(p[i]))
                    else:
                        spans[d].append({"start": s, "end": e, "p": float(p[i])})
                    last = i
            yield pa.RecordBatch.from_arrays(
                [*b.columns[first:], pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, span_type)],
                [*names, "id", "held_out", "score", "predicted", "spans"])

    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])
    found = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", T.ArrayType(span))]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[first:], *found]))
