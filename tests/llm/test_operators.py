"""Every operator against a brute-force version, on the smallest tables and on awkward rows."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspan.llm import decontam, embeddings, langid, lattice, mixing, quality, queries, sharding, simhash, token_ids, toxicity
from veilspan.llm.common import blocks
from veilspan.llm.components import connected_components

#: Nulls, empty and blank texts, a very long one, ties, repeated rows, and columns with the names that operators use.
AWKWARD = [
    (0, "The cat sat on the mat, it did.", "en", "a"), (0, "The cat sat on the mat, it did.", "en", "a"), (1, None, None, None), (2, "", "en", "b"),
    (3, " \t\n ", "fr", "b"), (None, "the cat sat on the mat, it did.", "en", "a"), (None, None, None, None), (4, "word " * 60_000, "en", "a"),
    (5, "x" * 200_000, "de", "c"), (6, "É ñ ß 漢字 \U0001f600 one two", "es", None), (7, "THE CAT sat on the mat, it did.", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, id string, fp int, score string, t string, g int, row string, component string, train string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "x", 1, "s", "t", 2, "r", "c", "z") for r in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, tiny):
    return spark.read.parquet(f"{tiny}/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


def find(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3 and rows[i][0] is not None and rows[j][0] is not None]
    root = find(len(rows), links)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, fp, least[r] if i is not None else None) for (i, _), fp, r in zip(rows, fps, root)), key=str)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 90)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(40)] + [(500, 500)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = find(600, edges)
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(spark, docs, awkward):
    for table in (docs, awkward):
        got = [(r.id, r.fp % 2**64, r.component) for r in simhash.simhash_components(table).collect()]
        assert sorted(got, key=str) == brute_components([(r.doc_id, r.text) for r in table.collect()])
    assert simhash.simhash_components(awkward.limit(0)).count() == 0
    assert simhash.hex_fingerprint is not None
    row = queries.op1_simhash(spark, "/root/testdata/sf0.001").first()
    assert len(row.fingerprint) == 16 and row.fingerprint == row.fingerprint.lower()


def test_near_pairs_are_all_found():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    near = base.copy()
    for k in range(len(near)):
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    fps = np.unique(np.concatenate([base, near]))
    i, j = simhash.near_pairs(fps)
    want = [(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= 3]
    assert sorted(zip(i.tolist(), j.tolist())) == want


def test_links_survive_slices(spark, monkeypatch):
    """One key with far more fingerprints than a slice."""
    monkeypatch.setattr(simhash, "SLICE", 16)
    rng = np.random.default_rng(6)
    fps = {0x0123456789ABCDEF}
    while len(fps) < 300:
        f = int(rng.choice(sorted(fps)))
        fps.add(f ^ (1 << int(rng.integers(0, 20))))
    rows = [(f - 2**64 if f >> 63 else f,) for f in fps]
    edges = [(r.a, r.b) for r in simhash.link_fingerprints(spark.createDataFrame(rows, "fp long")).collect()]
    order = sorted(fps)
    at = {f: k for k, f in enumerate(order)}
    want = find(len(order), [(a, b) for a in range(len(order)) for b in range(a) if (order[a] ^ order[b]).bit_count() <= 3])
    assert find(len(order), [(at[a % 2**64], at[b % 2**64]) for a, b in edges]) == want
    assert len(edges) < 20 * len(fps) * 10


def brute_edits(passage, text):
    row = [(0, 0)] * (len(text) + 1)
    for c in passage:
        new = [(row[0][0] + 1, 0)]
        for j, d in enumerate(text):
            new.append(min((row[j][0] + (c != d), 0), (row[j + 1][0] + 1, 0), (new[j][0] + 1, 0)))
        row = new
    return min(row)[0]


def test_decontamination_finds_every_region(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(400)]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate((30, 12, 4, 60, 1))] + [(9, None), (10, ""), (11, "zq")]
    texts = []
    for k in range(80):
        t = rng.choices(words, k=rng.randint(0, 60))
        if k % 2:
            p = list(rng.choice(items[:5])[1])
            for _ in range(rng.randint(0, 14)):
                x = rng.randrange(len(p))
                p[x : x + rng.randint(0, 1)] = rng.choice(["", "q", "w"])
            t.insert(rng.randint(0, len(t)), "".join(p).replace(" ", rng.choice([" ", "\n ", "  "])).title())
        texts.append((k, " ".join(t)))
    texts += [(100, None), (101, ""), (102, "zq"), (102, "zq"), (None, "a ZQ b")]
    got = decontam.find_passages(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for d, t in texts:
        for i, p in items:
            p = decontam.normal_text(p or "")
            if not p or t is None:
                continue
            k = decontam._budget(len(p), decontam.Q, decontam.EDIT_RATE) if len(p) >= decontam.Q else 0
            e = brute_edits(p, decontam.normal_text(t))
            if e <= k:
                want.append((d, i, e))
    assert sorted(((r.id, r.item_id, r.edits) for r in got), key=str) == sorted(want, key=str) and any(e for _, _, e in want)
    source = dict(texts)
    for r in got:
        if r.edits == 0:
            part = decontam.normal_text((source[r.id].encode()[r.start : r.end]).decode())
            assert part == decontam.normal_text(dict(items)[r.item_id])


def test_decontamination_in_several_passes(spark, docs, tiny, monkeypatch):
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
    one = sorted(map(tuple, decontam.find_passages(docs, bench).collect()))
    monkeypatch.setattr(decontam, "INDEX_CHARS", 2000)
    assert one and sorted(map(tuple, decontam.find_passages(docs, bench).collect())) == one
    assert decontam.find_passages(docs.limit(0), bench).count() == 0 and decontam.find_passages(docs, bench.limit(0)).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = [(b" a", 0.2), (b"a", 0.1), (b"b", 0.2), (b"ab", 0.1), (b" ", 0.2), (b" ab", 0.1), (b"ba", 0.1)]
    known = dict(pieces)
    vocab = lattice.Pieces.of([p for p, _ in pieces])
    model = lattice._model(vocab, np.array([w for _, w in pieces]))
    total = sum(known.values())

    def brute(word):
        return 1.0 if not word else sum(known[word[:n]] / total * brute(word[n:]) for n in range(1, len(word) + 1) if word[:n] in known)

    words = [b" ab", b" abab", b" ba", b" aabba", b" bbbb"]
    assert np.allclose(model.words(words), [math.log(brute(w)) for w in words])
    assert np.allclose([lattice._long_forward(w, vocab, model.logp) for w in words], model.words(words))
    counts = np.zeros(vocab.size + 1)
    lattice.WordLattice(words, vocab).expect(model.logp, np.ones(len(words)), counts)
    spent = sum(counts[k] * len(p) for k, (p, _) in enumerate(pieces))
    assert np.isclose(spent, sum(map(len, words)))  # each byte is in one piece of a segmentation


def test_long_words_are_learned_from(spark, monkeypatch):
    """Training words of 48 bytes and more count in the expectation as shorter ones do."""
    path = queries._vocabulary("piece_bpe_32k.model")
    pieces = lattice.read_pieces(path)
    vocab, prior = lattice.Pieces.of([p for p, _ in pieces]), np.array([w for _, w in pieces])
    start = lattice._model(vocab, prior)
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(["天", "地", "ab", "q"], 40))
    table = [(i, word()) for i in range(60)]
    train = [(" " + t).encode() for i, t in table if zlib.crc32(str(i).encode()) % 7 != 2]
    want, got = np.zeros(vocab.size + 1), np.zeros(vocab.size + 1)
    lattice.WordLattice(train, vocab).expect(start.logp, np.full(len(train), 3.0), want)
    monkeypatch.setattr(lattice, "LONG_STEP", 17)
    for w in train:
        lattice._long_expect(w, vocab, start.logp, 3.0, got)
    assert np.allclose(got, want) and np.isclose(sum(got[k] * len(p) for k, (p, _) in enumerate(pieces)), 3 * sum(map(len, train)))
    tokens = 2 * len(train)
    models = [start, lattice._model(vocab, lattice._with_prior(want[:-1] / 3, prior, tokens))]
    rows = lattice.score_texts(spark.createDataFrame(table, "doc_id long, text string"), path).collect()
    assert any(r.held_out for r in rows)
    for name, model in zip(("score", "fitted_score"), models):
        logs = {i: float(model.words([(" " + t).encode()])[0]) for i, t in table}
        assert all(math.isclose(r[name], (logs[r.id] + 2 * math.log(0.5)) / math.log(10), rel_tol=1e-9) for r in rows)


def brute_marginal(word, weights, total):
    """The sum over all segmentations, longest prefix first, with plain Python numbers."""
    ways = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        ways[j] = sum(ways[i] * weights.get(word[i:j], 0.0) / total for i in range(max(0, j - 40), j))
    return ways[-1]


def test_lm_score_is_the_marginal_over_all_segmentations(spark, docs):
    path = queries._vocabulary("piece_bpe_32k.model")
    weights = dict(lattice.read_pieces(path))
    total = sum(max(w, 1e-12) for w in weights.values())
    assert max(map(len, weights)) <= 40
    rows = [(r.doc_id, r.text) for r in docs.limit(40).collect()] + [(None, "Straße übt, 漢字!"), (900, None), (901, "a" * 120)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    train = [(t or "").encode().lower().split() for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    end = len(train) / sum(len(w) + 1 for w in train)
    logs = {}
    want = []
    for i, t in rows:
        words = [b" " + w for w in (t or "").encode().lower().split()]
        for w in words:
            if w not in logs:
                logs[w] = math.log10(brute_marginal(w, weights, total))
        want.append((str(i), round(sum(logs[w] + math.log10(1 - end) for w in words) + math.log10(end), 4)))
    assert sorted((str(r.id), round(r.score, 4)) for r in lattice.score_texts(table, path, group_bytes=20_000).collect()) == sorted(want)


def test_lm_counts_hold_a_step_of_text_at_a_time():
    pieces = lattice.read_pieces(queries._vocabulary("piece_bpe_32k.model"))
    model = lattice._model(lattice.Pieces.of([p for p, _ in pieces]), np.array([w for _, w in pieces]))
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(4000)] + ["Q" * 60]
    texts = [" ".join(rng.choices(words, k=1000)) for _ in range(1300)] + [""]
    train = np.arange(len(texts)) % 3 > 0
    column = pa.chunked_array([pa.array(texts[:500]), pa.array([], pa.string()), pa.array(texts[400:])[100:]])
    tracemalloc.start()
    h, c, total = lattice.count_words(column, train, model)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    want = Counter(w for t, on in zip(texts, train) if on for w in t.lower().split())
    assert sorted(c[c > 0].astype(int).tolist()) == sorted(want.values()) and (np.diff(h.astype(object)) > 0).all()
    spelled = [b" " + w.encode() for w in want]
    expect, weight = np.zeros(len(total)), np.array(list(want.values()), float)
    lattice.WordLattice(spelled, model.pieces).expect(model.logp, weight, expect)
    assert np.allclose(total, expect)
    assert sum(map(len, texts)) > 8_000_000 and peak < 130, peak


def test_lm_base_and_scores(spark, docs, awkward):
    path = queries._vocabulary("piece_bpe_32k.model")
    for table in (docs, awkward):
        rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in table.select("doc_id", "text").collect()]
        train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
        c = Counter(w for i, ws in rows if train(i) for w in [*ws, None])
        n, v = sum(c.values()), len(c)
        want = sorted((str(i), not train(i), len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, None]), 4)) for i, ws in rows)
        got = lattice.score_texts(table, path, group_bytes=50_000).collect()
        assert sorted((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(math.isfinite(x) and x < 0 for r in got for x in (r.score, r.fitted_score))
    assert lattice.score_texts(awkward.limit(0), path).count() == 0


def test_sharding(spark, docs, awkward):
    for table in (docs, awkward):
        got = sharding.shard_documents(table).collect()
        assert len(got) == table.count()
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in awkward.collect()), key=str)
    assert sorted(((r.id, r.size, r.text_crc32) for r in got), key=str) == want
    ids = spark.range(80_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    sizes = [r["count"] for r in sharding.shard_documents(ids).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.06 * min(sizes)
    assert sharding.shard_documents(awkward.limit(0)).count() == 0


def test_growth_stays_in_changed_subtrees(spark):
    before = sharding.base_tree(8)
    after = {r: {k: dict(s) for k, s in racks.items()} for r, racks in before.items()}
    after[1][0][4] = 2.0  # a heavier shard in region 1
    rows = spark.range(20_000).select(sharding.shard_of(before, F.col("id")).alias("a"), sharding.shard_of(after, F.col("id")).alias("b")).where("a <> b").collect()
    assert rows and all(r.b in (4, 5, 6, 7) for r in rows) and all(r.b in (4, 5) for r in rows if r.a in (6, 7)) and all(r.b == 4 for r in rows if r.a == 5)
    for n in (1, 3, 8, 11):
        tree = sharding.base_tree(n)
        moved = spark.range(3000).select(sharding.shard_of(tree, F.col("id")).alias("a"), sharding.shard_of(sharding.grow(tree), F.col("id")).alias("b")).where("a <> b").collect()
        assert moved and {r.b for r in moved} == {n}


def test_language(spark, awkward):
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.id: r for r in langid.predict_language(data).collect()}
    held = [(r.lang, got[r.doc_id]) for r in data.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for _, r in held) and np.mean([x == r.lang_pred for x, r in held]) > 0.95
    rows = langid.predict_language(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    by_text = {r.doc_id: r.text for r in awkward.collect()}
    assert all((r.lang_pred == "und") == (by_text[r.id] in (None, "", " \t\n ")) for r in rows if r.id is not None)
    assert langid.predict_language(awkward.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict_language(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_scores_are_those_of_dense_kernel_ridge():
    """Nystroem features and their ridge regression against the same problem solved in the span of the landmarks' kernels."""
    rng = random.Random(7)
    words = [["".join(rng.choice(a) for _ in range(5)) for _ in range(9)] for a in ("abcdefg", "efghijkl", "mnopqabc")]
    langs = [f"l{k % 3}" for k in range(36)]
    texts = [" ".join(rng.choice(words[k % 3]) for _ in range(20)) for k in range(36)]
    clf = langid.fit(texts, langs, landmarks=4, grams=300, ridge=0.05)
    data, at = langid._of_texts(texts)
    x = langid.presence(data, at, clf.column, clf.width).astype(float)
    z = clf.landmarks.astype(float).T
    assert z.shape[0] == 12 and all(any(np.allclose(row, own) for own in x) for row in z)
    kxz, kzz, y = x @ z.T, z @ z.T, np.array([[1.0 if f"l{k}" == n else -1.0 for k in range(3)] for n in langs])
    w = np.full((36, 1), 1 / 12)
    design = np.hstack([kxz, np.ones((36, 1))])
    penalty = np.zeros((13, 13))
    penalty[:12, :12] = 0.05 * kzz
    penalty[12, 12] = 1e-9
    alpha = np.linalg.lstsq(design.T @ (design * w) + penalty, design.T @ (y * w), rcond=1e-12)[0]
    assert np.allclose(clf.scores(x.astype(np.float32)), design @ alpha, atol=2e-3)


def test_toxicity_end_to_end_against_loops(spark, docs, labels):
    """Features by dictionary, forward and backward by loops over a sentence, and the document's score, with the trained weights."""
    crf = toxicity.train(docs, labels)
    assert crf is not None
    number = {int(h): k for k, h in enumerate(crf.keys)}

    def brute(text):
        _, _, block = next(blocks(pa.array([text])))
        t = toxicity.tokenize(block)
        n, p = len(t.start), []
        own = [{number[int(h[i])] for h in t.hashes if int(h[i]) in number} for i in range(n)]
        i = 0
        while i < n:
            j = i
            while j < n and t.sentence[j] == t.sentence[i]:
                j += 1
            emit = [crf.bias + sum(crf.own[k] for k in own[x]) + sum(crf.side[k] for y in (x - 1, x + 1) if i <= y < j for k in own[y]) for x in range(i, j)]
            score = lambda a, x: emit[x] if a else 0.0  # noqa: E731, B023
            ahead = [[score(a, 0) for a in (0, 1)]]
            for x in range(1, j - i):
                ahead.append([score(a, x) + np.logaddexp(ahead[-1][0] + crf.step[0, a], ahead[-1][1] + crf.step[1, a]) for a in (0, 1)])
            behind = [[0.0, 0.0]]
            for x in range(j - i - 2, -1, -1):
                behind.insert(0, [np.logaddexp(*(crf.step[a, b] + score(b, x + 1) + behind[0][b] for b in (0, 1))) for a in (0, 1)])
            z = np.logaddexp(*ahead[-1])
            p += [math.exp(ahead[x][1] + behind[x][1] - z) for x in range(j - i)]
            i = j
        top = sorted(p, reverse=True) + [0.0, 0.0]
        total = sum(x for x in p if x >= 0.05)
        f = (np.array([math.log1p(total), math.log(total / max(n, 1) + 1e-4), top[0], top[1]]) - crf.mean) / crf.sd
        return 1 / (1 + math.exp(-max(-30, min(30, float(f @ crf.doc[:-1] + crf.doc[-1]))))), p, t

    texts = {r.doc_id: r.text for r in docs.collect() if r.text and len(r.text) < 3000}
    got = {r.id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    for i in sorted(texts)[:60]:
        score, p, t = brute(texts[i])
        assert math.isclose(got[i].score, score, abs_tol=1e-6)
        assert sum(x >= 0.5 for x in p) >= len(got[i].spans) and all(any(s.start <= t.start[k] and t.end[k] <= s.end for s in got[i].spans) for k in range(len(p)) if p[k] >= 0.5)


def test_every_language_is_learned(spark):
    """More than 64 languages, one of them with long texts only, many rows and few."""
    rng = random.Random(5)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for _ in range(80)]
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    data = [(i, text(k, 30), f"l{k:02}") for i, k in enumerate(k for k in range(79) for _ in range(40 if k < 64 else 12))]
    data += [(10_000 + i, text(79, 12_000), "l79") for i in range(8)]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string")
    known = langid.training_rows(table, "doc_id", "text", "lang", 5, 0)
    assert {x for x, _ in known} == {x for _, _, x in data} and all(len(t) <= langid.SAMPLE_BYTES for _, t in known)
    # a share of less than one row for each language leaves none out
    assert {x for x, _ in langid.training_rows(table, "doc_id", "text", "lang", 5, 0, per_lang=1)} == {x for _, _, x in data}
    want = {i: x for i, _, x in data}
    held = [(r.lang_pred == want[r.id], want[r.id]) for r in langid.predict_language(table).collect() if r.held_out]
    assert sum(ok for ok, _ in held) >= 0.95 * len(held) and all(ok for ok, x in held if x == "l79") and any(x == "l79" for _, x in held)


def test_crf_forward_backward():
    rng = np.random.default_rng(2)
    emit, step = rng.normal(size=(1, 6)), rng.normal(size=(2, 2))
    p, z, moves = toxicity.forward_backward(emit, np.array([6]), step)
    paths = [[m >> k & 1 for k in range(6)] for m in range(64)]
    weight = np.array([math.exp(sum(emit[0, k] * y for k, y in enumerate(s)) + sum(step[a, b] for a, b in zip(s, s[1:]))) for s in paths])
    assert np.isclose(z[0], math.log(weight.sum()))
    assert np.allclose(p[0], weight @ np.array(paths) / weight.sum())
    want = np.zeros((2, 2))
    for w, s in zip(weight / weight.sum(), paths):
        for a, b in zip(s, s[1:]):
            want[a, b] += w
    assert np.allclose(moves, want)


def test_plain_sentences_share_messages():
    crf = toxicity.Crf(np.array([5], np.uint64), np.zeros(1), np.zeros(1), -1.5, np.array([[0.3, -0.2], [0.1, 0.7]]), np.zeros(5), np.zeros(4), np.ones(4))
    _, _, block = next(blocks(pa.array(["aa bb cc. dd ee ff gg hh. ii"])))
    got = toxicity.marginals(crf, toxicity.tokenize(block))
    want = [toxicity.forward_backward(np.full((1, n), -1.5), np.array([n]), crf.step)[0][0] for n in (3, 5, 1)]
    assert np.allclose(got, np.concatenate(want))


def test_toxicity(spark, awkward, labels):
    big, marks = "/root/testdata/sf0.1", spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    data = spark.read.parquet(f"{big}/documents.parquet").join(marks.select("doc_id", "toxic"), "doc_id")
    got = {r.id: r for r in toxicity.score_toxicity(data, marks).collect()}
    held = [(r.toxic, got[r.doc_id]) for r in data.select("doc_id", "toxic").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out and r.predicted == (r.score >= 0.7) for _, r in held)
    assert np.mean([r.predicted for y, r in held if y]) > 0.9 and np.mean([r.predicted for y, r in held if not y]) < 0.05
    assert any(r.spans for y, r in held if y)
    rows = toxicity.score_toxicity(awkward, marks).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity.score_toxicity(awkward, marks.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(awkward.limit(0), marks).count() == 0
    kept = toxicity.score_toxicity(awkward, marks, keep=True).select("row.*")
    assert kept.columns == awkward.columns and sorted(map(str, kept.collect())) == sorted(map(str, awkward.collect()))


def test_quality(spark, awkward):
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    data = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(marks.select("doc_id", F.col("quality").alias("q")), "doc_id")
    got = {r.id: r for r in quality.score_quality(data, marks).collect()}
    held = [(r.q, got[r.doc_id]) for r in data.select("doc_id", "q").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([y == r.predicted for y, r in held]) > 0.97
    rows = quality.score_quality(awkward, marks).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score_quality(awkward, marks.limit(0)).collect()} == {0.0}
    assert quality.score_quality(awkward.limit(0), marks).count() == 0


def test_machine_identity():
    """The linear-time form equals the sum over all pairs."""
    rng = np.random.default_rng(1)
    size = (1 << quality.BITS) + len(quality.STATS)
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)).astype(np.float32), np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))
    feature, value = np.array([3, 9, 77, 5]), np.array([0.5, -1.0, 2.0, 0.1])
    z, _ = m.logit(np.zeros(4, int), feature, value, 1)
    pairs = sum(float(m.v[feature[a]] @ m.v[feature[b]]) * value[a] * value[b] for a in range(4) for b in range(a))
    assert np.isclose(z[0], 0.3 + m.w[feature] @ value + pairs, atol=1e-4)


def brute_links(rows, radius=0.93):
    good = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in good}
    links = [(a, b) for a in good for b in good if b < a and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= radius]
    return links


def test_embeddings(spark, tiny, monkeypatch):
    table = spark.read.parquet(f"{tiny}/embeddings.parquet")
    rng = np.random.default_rng(4)
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in table.collect()]
    rows += [(10_000 + i, (np.array(v) + 0.25 * np.linalg.norm(v) / 8 * rng.normal(size=len(v))).tolist(), x) for i, v, x in rows[::2]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links = brute_links(rows)
    want = Counter(x for p in links for x in p)
    got = {r.id: r for r in embeddings.embedding_links(table).collect()}
    found = sum(r.n_links for r in got.values())
    assert all(got[rows[k][0]].n_links <= want[k] for k in range(len(rows))) and found >= 0.95 * 2 * len(links) > 0
    root = find(len(rows), links)
    exact = [got[i].component == rows[root[k]][0] for k, (i, _, _) in enumerate(rows)]
    assert np.mean(exact) > 0.95 and all(r.kept == (r.id == r.component) for r in got.values())
    # many copies and near copies, with slices smaller than the groups; a leaf holds them all, so nothing may be missed
    monkeypatch.setattr(embeddings, "SLICE", 8)
    base = rng.normal(size=8)
    odd = [(k, (base + (k % 40) * 0.01 * rng.normal(size=8)).tolist(), 1) for k in range(60)] + [(100 + k, base.tolist(), 1) for k in range(30)]
    odd += [(200, None, 1), (201, [], 1), (202, [0.0] * 8, 1), (203, [float("nan")] * 8, 1), (204, [None] * 8, 1), (205, base.tolist(), None), (None, base.tolist(), 1),
            (206, base.tolist(), 2), (207, [float("inf")] * 8, 1), (208, [1.0, 2.0], 1), (100, base.tolist(), 1)]
    links = brute_links(odd)
    want, root = Counter(x for p in links for x in p), find(len(odd), links)
    got = embeddings.embedding_links(spark.createDataFrame([(*r, "x", 3) for r in odd], "vec_id long, embedding array<double>, label int, rep string, n int")).collect()
    least = {}
    for k, (i, _, _) in enumerate(odd):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    expected = sorted(((i, want[k], least.get(root[k]) if i is not None else None) for k, (i, _, _) in enumerate(odd)), key=str)
    assert sorted(((r.id, r.n_links, r.component) for r in got), key=str) == expected
    assert embeddings.embedding_links(table.limit(0)).count() == 0


def test_variable_length_code():
    rng = np.random.default_rng(0)
    for v in (rng.integers(0, 2**32, 1003, dtype=np.uint64), np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]), np.zeros(0), rng.integers(0, 300, 17)):
        control, data = token_ids.encode_values(v)
        assert (token_ids.decode_values(control, data, len(v)) == v).all()
    assert token_ids.encode_values(np.array([1, 256, 70000, 2**24, 5])) == (bytes([0b11100100, 0]), bytes([1, 0, 1, 0x70, 0x11, 1, 0, 0, 0, 1, 5]))


def test_encoder_is_exact():
    from tokenizers import Tokenizer

    path = queries._vocabulary("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), token_ids.Encoder(path)
    chars = [chr(c) for c in [*range(1, 0x600), *range(0x1E00, 0x2100), *range(0x3040, 0x3100), 0x1F600]]
    texts = ["", " ", "it's we'll I'D x.. ..y a,b 12 <|endoftext|> x<|startoftext|>y", "tab\there\r\nnew\x0bx", "É́ ΑΣ. İx ẞ. áb, o'Neil's."]
    texts += [c + "." for c in chars] + ["a" + c + "," for c in chars] + [c + "b " + c for c in chars]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("segment", [token_ids.SEGMENT, 500])
def test_token_files(spark, docs, awkward, monkeypatch, segment):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_ids, "SEGMENT", segment)
    path = queries._vocabulary("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    for table in (docs, awkward):
        want = []
        for r in table.select("doc_id", "text").collect():
            ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
            want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
        got = sorted(token_ids.token_digest(table, path).collect(), key=lambda r: r.start)
        null_first = lambda i: (i is not None, i or 0)
        assert [r.id for r in got] == sorted((i for i, _, _ in want), key=null_first)
        assert sorted(((r.id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
        assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert token_ids.token_digest(awkward.limit(0), path).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, total, out = set(order), 1.5 * sum(sizes.values()), {}
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in left}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return out


def test_mixing(spark, docs, awkward):
    for table in (docs, awkward, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        got = mixing.mix_documents(table).collect()
        assert len(got) == table.count() and sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(table.repartition(3)).collect()))
        sizes, taken = Counter(), Counter()
        for r in got:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 2 * r.size
        want = brute_targets(sizes)
        assert all(r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) for r in got)
        assert all(abs(taken[s] - want[s]) <= 2.5 * mixing.BLOCK for s in sizes)
    words = sorted(((r.doc_id, len((r.text or "").encode().split())) for r in awkward.collect()), key=str)
    assert sorted(((r.id, r.size) for r in mixing.mix_documents(awkward).collect()), key=str) == words
    assert mixing.mix_documents(awkward.limit(0)).count() == 0


def test_quotas_are_those_of_highest_quotients(spark):
    rng = random.Random(8)
    for n, shards in ((1, 1), (2, 3), (7, 8), (30, 5)):
        sizes = {f"s{k:02d}": rng.choice([0, 5, 40, 900, 30_000]) for k in range(n)}
        rows = mixing.shard_quotas(mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")), shards).collect()
        blocks_of = {r.source: r.blocks for r in rows}
        target = {r.source: r.target / r.source_size * r.blocks if r.blocks else 0.0 for r in rows}
        seats, quota, upto = math.floor(sum(target.values()) + 0.5), Counter(), {s: [] for s in target}
        for j in range(shards):
            for _ in range(seats * j // shards, seats * (j + 1) // shards):
                open_ = [s for s in target if target[s] > 0 and quota[s] < 2 * blocks_of[s]]
                if open_:
                    quota[max(open_, key=lambda s: (target[s] / (2 * quota[s] + 1), [-ord(c) for c in s]))] += 1
            for s in target:
                upto[s].append(quota[s])
        assert {r.source: r.upto for r in rows} == upto


def test_shards_take_their_quotas(spark, monkeypatch):
    """Every block is chosen by the seeded order; sums by shard are the quotas; another seed chooses others."""
    rng = random.Random(4)
    data = [(rng.choice([None, 7, k, 10**15 + k]), "w " * rng.choice([0, 1, 5, 40, 400]), rng.choice("abc")) for k in range(300)] + [(None, "x " * 64, "a")] * 100
    table = spark.createDataFrame(data, "doc_id long, text string, source string")
    taken = {}
    for seed in (1, 2):
        rows = mixing.mix_documents(table, seed=seed, shards=5).collect()
        taken[seed] = sorted((str(r.id), r.source, r.size, r.taken) for r in rows)
        assert all(sum(r.shard_taken) == r.taken <= 2 * r.size for r in rows)
        size = Counter()
        for r in rows:
            size[r.source] += r.size
        plan = {r.source: r for r in mixing._with_permutation(mixing.shard_quotas(mixing.source_targets(spark.createDataFrame(list(size.items()), "source string, source_size long")), 5), seed).collect()}
        for s, p in plan.items():
            order = [(b * p.factor + p.step) % p.n for b in range(p.n)]
            assert sorted(order) == list(range(p.n))
            own = sorted((r for r in rows if r.source == s), key=lambda r: r.nth)
            assert [r.nth for r in own] == list(range(len(own))) and [r.id or -1 for r in own] == sorted(r.id or -1 for r in own)
            words = [k for k, r in enumerate(own) for _ in range(r.size)]
            want = [[0] * 5 for _ in own]
            for w, k in enumerate(words):
                for seat in (order[w // 16], order[w // 16] + p.n):
                    if seat < p.upto[-1]:
                        want[k][sum(q <= seat for q in p.upto)] += 1
            assert [r.shard_taken for r in own] == want
    assert taken[1] != taken[2]


def test_running_sums_of_awkward_ids(spark):
    """Null, repeated and sparse ids: sums as in one sorted list, whatever the parts."""
    from veilspan.llm.ordered import running_sums

    rng = random.Random(2)
    data = [(rng.choice(["a", None]), rng.choice([None, 3, rng.randrange(-(2**62), 2**62)]), rng.randrange(5)) for _ in range(400)]
    got = running_sums(spark.createDataFrame(data, "g string, i long, v long").repartition(5), "g", ["i", "v"], {"s": F.col("v")}).collect()
    assert len(got) == 400
    for g in ("a", None):
        total = 0
        own = sorted((r for r in got if r.g == g), key=lambda r: r.nth)
        assert [(r.i is not None, r.i or 0, r.v) for r in own] == sorted((i is not None, i or 0, v) for h, i, v in data if h == g)
        for k, r in enumerate(own):
            assert (r.nth, r.s) == (k, total)
            total += r.v


def test_draws_of_the_tree_are_recomputed(spark):
    """The shard is that of the least -ln(u) / weight at each level, u being from the id's XXH64."""

    def unit(name, i):
        h = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(name.encode(), 42))
        return ((h >> 11) + 0.5) * 2.0**-53

    pick = lambda level, nodes, i: min(nodes, key=lambda n: -math.log(unit(f"{level}/{n[0]}", i)) / n[1])[2]
    tree = sharding.base_tree(11)
    tree[1][0][4] = 3.0
    total = lambda racks: sum(w for rack in racks.values() for w in rack.values())
    for r in spark.range(500).select("id", sharding.shard_of(tree, F.col("id")).alias("s")).collect():
        region = pick("region", [(str(k), total(x), k) for k, x in tree.items()], r.id)
        rack = pick("rack", [(f"{region}/{k}", sum(x.values()), k) for k, x in tree[region].items()], r.id)
        assert r.s == pick("shard", [(f"{region}/{rack}/{k}", w, k) for k, w in tree[region][rack].items()], r.id)


def test_embeddings_of_several_lengths(spark):
    """Each length is compared, the less common ones too."""
    rng = np.random.default_rng(6)
    rows = []
    for n, d in ((30, 8), (12, 5), (3, 2)):
        base = rng.normal(size=d)
        rows += [(len(rows) + k, (base + 0.02 * (k % 6) * rng.normal(size=d)).tolist(), 1) for k in range(n)]
    links = brute_links(rows)
    want, root = Counter(x for p in links for x in p), find(len(rows), links)
    got = {r.id: (r.n_links, r.component) for r in embeddings.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {k: (want[k], min(i for i in range(len(rows)) if root[i] == root[k])) for k in range(len(rows))}
    assert all(any(len(rows[a][1]) == d for a, _ in links) for d in (8, 5, 2))


def test_forest_of_a_concentrated_label():
    """Links of a large label with mean cosine 0.88, found by brute force, share a leaf."""
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    axis = unit(rng.normal(size=(1, 64)))
    off = rng.normal(size=(8000, 64))
    x = math.sqrt(0.88) * axis + math.sqrt(0.12) * unit(off - off @ axis.T * axis)
    forest = embeddings.sized_forest(x[:4000], np.array(["large"] * 4000), 50_000)
    other = x[4000:]
    i, j = np.nonzero(np.triu(other @ other.T >= embeddings.RADIUS, 1))
    leaves = [set() for _ in other]
    for row, code in zip(*forest.leaves(other)):
        leaves[row].add(int(code))
    assert len(i) > 500 and np.mean([bool(leaves[a] & leaves[b]) for a, b in zip(i, j)]) >= 0.9


def test_pairs_count_in_the_first_leaf_they_share(monkeypatch):
    monkeypatch.setattr(embeddings, "LOOKUPS", 50)
    rng = np.random.default_rng(5)
    own = [sorted(rng.choice(40, rng.integers(0, 9), replace=False).tolist()) for _ in range(60)]
    order = rng.permutation(60)
    for code in (0, 1, 17, 39):
        before = [[c for c in codes if c < code] for codes in own]
        keys = embeddings._earlier_leaves(pa.table({"before": pa.array(before, pa.list_(pa.int32()))}), order, code)
        i, j = np.triu_indices(60, 1)
        got = embeddings._share_earlier(keys, i, j, code)
        assert got.tolist() == [bool(set(before[order[a]]) & set(before[order[b]])) for a, b in zip(i, j)]


def test_toxicity_holds_a_step_of_text_at_a_time():
    crf = toxicity.Crf(np.array([5], np.uint64), np.zeros(1), np.zeros(1), -1.5, np.array([[0.3, -0.2], [0.1, 0.7]]), np.zeros(5), np.zeros(4), np.ones(4))
    texts = pa.array(["plain words of a line. " * 40] * 8000)
    tracemalloc.start()
    scores = np.concatenate([toxicity.score_block(crf, block)[0] for _, _, block in blocks(texts, toxicity.STEP_BYTES)])
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(scores) == 8000 and peak < 120, peak
