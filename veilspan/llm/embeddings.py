"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, write_table
from .components import connected_components

#: Least number of trees; least share of a node's sample on either side of a split that goes both ways; rows that a leaf should hold; rows the trees are fitted on.
TREES, SPILL, LEAF, SAMPLE = 8, 0.05, 256, 8192
#: Share of measured pairs that must share a leaf; pairs from which a label (or the sample's links) is measured on its own; most pairs measured of each; wider spills that are tried.
RECALL, OWN_PAIRS, MOST_PAIRS, SPILLS = 0.95, 256, 512, (SPILL, 0.1, 0.15)
RADIUS = 0.93
#: Vectors of a leaf that one comparison takes; larger leaves are cut into slices that meet pair by pair.
SLICE = 2048
#: Leaves that one step looks up when pairs are counted in the first leaf they share.
LOOKUPS = 1 << 19


@dataclass
class Forest:
    """Split nodes by number: direction, and the two thresholds between which a vector goes both ways; children or leaf codes."""

    directions: np.ndarray  # [nodes, dimensions]
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray  # [nodes, 2]; negative: leaf -1 - code
    roots: list[int]

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf code) for all leaves that each row falls in."""
        rows = np.concatenate([np.arange(len(x))] * len(self.roots))
        node = np.repeat(np.array(self.roots, np.int64), len(x))
        out_r, out_c = [], []
        while len(rows):
            leaf = node < 0
            out_r.append(rows[leaf]), out_c.append(-1 - node[leaf])
            rows, node = rows[~leaf], node[~leaf]
            if not len(rows):
                break
            p = np.einsum("ij,ij->i", x[rows], self.directions[node])
            left, right = p <= self.high[node], p >= self.low[node]
            rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([self.child[node[left], 0], self.child[node[right], 1]])
        return np.concatenate(out_r), np.concatenate(out_c)


def fit_forest(sample: np.ndarray, rows: int, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF, seed: int = 11) -> Forest:
    """Random recursive splits near the median of a sample that stands for ``rows`` vectors, down to ``leaf`` of them or, in a
    sample, eight. Unit vectors are compared by cosine, so directions are Gaussian."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple[np.ndarray, float, float]] = []
    child: list[list[int]] = []
    leaves = 0
    scale = max(1.0, rows / max(1, len(sample)))
    roots = []

    def build(own: np.ndarray, depth: int) -> int:
        nonlocal leaves
        if len(own) * scale <= leaf or len(own) <= 8 or depth >= 40:
            leaves += 1
            return -leaves
        r = rng.normal(size=sample.shape[1])
        p = sample[own] @ r
        lo, hi = np.quantile(p, [0.5 - spill, 0.5 + spill])
        left, right = own[p <= hi], own[p >= lo]
        if len(left) == len(own) or len(right) == len(own):  # a split that parts nothing
            leaves += 1
            return -leaves
        k = len(nodes)
        nodes.append((r, lo, hi))
        child.append([0, 0])
        child[k] = [build(left, depth + 1), build(right, depth + 1)]
        return k

    for _ in range(trees):
        roots.append(build(np.arange(len(sample)), 0))
    width = sample.shape[1] if sample.ndim == 2 else 0
    return Forest(np.array([n[0] for n in nodes]).reshape(len(nodes), width), np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes]),
                  np.array(child, np.int64).reshape(len(nodes), 2), roots)


def _sharing(forest: Forest, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Number of leaves that each pair shares, and leaves of a vector."""
    many = max(1, len(forest.child) * 2 + len(forest.roots) + 1)
    (i, a), (j, b) = forest.leaves(x), forest.leaves(y)
    both = np.intersect1d(i * many + a, j * many + b)
    return np.bincount(both // many, minlength=len(x)), len(i) / max(1, len(x))


def _pairs(sample: np.ndarray, labels: np.ndarray, radius: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, group): pairs by which a forest is measured.

    A sample vector's partner moves towards another vector of its label, seen from the label's mean, until the cosine is ``radius``;
    so partners are spread as the label is and pairs of a concentrated label are as hard to keep together as its links. The group is
    the label, or one for all small labels; one more holds links found in the sample by brute force, if there are enough.
    """
    rng = np.random.default_rng(seed)
    names, of, count = np.unique(labels, return_inverse=True, return_counts=True)
    order = rng.permutation(len(sample))
    order = order[np.argsort(of[order], kind="stable")]
    first = np.concatenate([[0], np.cumsum(count)])
    other = np.empty(len(sample), np.int64)
    mean = np.empty_like(sample)
    for g in range(len(names)):
        own = order[first[g] : first[g + 1]]
        other[own], mean[own] = np.roll(own, 1), sample[own].mean(axis=0) if len(own) > 1 else 0.0
    u, v = sample - mean, sample[other] - mean
    alone = other == np.arange(len(sample))
    v[alone] = rng.normal(size=(int(alone.sum()), sample.shape[1])) / math.sqrt(sample.shape[1])
    low, high = np.zeros((len(sample), 1)), np.ones((len(sample), 1))
    for _ in range(30):
        rho = (low + high) / 2
        y = mean + rho * u + np.sqrt(1 - rho * rho) * v
        y /= np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-300)
        near = np.einsum("ij,ij->i", sample, y)[:, None] >= radius
        low, high = np.where(near, low, rho), np.where(near, rho, high)
    group = np.where(count[of] >= OWN_PAIRS, of, len(names))
    rank = np.empty(len(sample), np.int64)
    by = np.argsort(group, kind="stable")
    rank[by] = np.arange(len(by)) - np.searchsorted(group[by], group[by])
    kept = rank < MOST_PAIRS
    x, y, group = sample[kept], y[kept], group[kept]
    found = []
    for lo in range(0, len(sample), 1024):
        i, j = np.nonzero((sample[lo : lo + 1024] @ sample.T >= radius) & (of[lo : lo + 1024, None] == of))
        some = np.flatnonzero(i + lo < j)
        some = rng.choice(some, min(len(some), 4 * MOST_PAIRS), replace=False)
        found.append(np.stack([i[some] + lo, j[some]]))
    i, j = np.concatenate(found, axis=1)
    if len(i) >= OWN_PAIRS:
        some = rng.choice(len(i), min(len(i), 4 * MOST_PAIRS), replace=False)
        x, y = np.concatenate([x, sample[i[some]]]), np.concatenate([y, sample[j[some]]])
        group = np.concatenate([group, np.full(len(some), len(names) + 1)])
    return x, y, group


def sized_forest(sample: np.ndarray, labels: np.ndarray, rows: int, trees: int = TREES, radius: float = RADIUS, seed: int = 11) -> Forest:
    """A forest of at least ``trees`` trees in which RECALL of each group of :func:`_pairs` share a leaf.

    Where ``trees`` trees with the least spill don't bring enough of them together, as in labels whose vectors lie close to each
    other, the spill with the fewest leaves a vector is taken and trees are added until they do.
    """
    forest = fit_forest(sample, rows, trees, seed=seed)
    if not len(forest.child):
        return forest
    x, y, group = _pairs(sample, labels, radius, seed + 1)

    def worst(share: np.ndarray) -> float:
        return min(float(share[group == g].mean()) for g in np.unique(group))

    if worst(_sharing(forest, x, y)[0] > 0) >= RECALL:
        return forest
    best = None
    for spill in SPILLS:
        # shares of single trees say how many are needed
        alone = [_sharing(fit_forest(sample, rows, 1, spill, seed=seed + 100 + k), x, y) for k in range(4)]
        p = worst(np.mean([n > 0 for n, _ in alone], axis=0))
        if p > 0:
            need = max(trees, math.ceil(math.log(1 - RECALL) / math.log(1 - min(p, 0.999))))
            cost = need * float(np.mean([c for _, c in alone]))
            best = min(best or (cost, need, spill), (cost, need, spill))
    # where no split keeps any pair together all vectors meet in one leaf
    _, need, spill = best or (0, 1, 0.5)
    while True:
        forest = fit_forest(sample, rows, need, spill, seed=seed)
        if worst(_sharing(forest, x, y)[0] > 0) >= RECALL:
            return forest
        need += max(1, need // 4)


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each position's group."""
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _earlier_leaves(table: pa.Table, order: np.ndarray, code: int) -> np.ndarray:
    """position * code + leaf, sorted, for each leaf before ``code`` of the vectors at the positions of ``order``."""
    raw = table["before"].combine_chunks()
    at = np.asarray(raw.offsets, np.int64)
    position = np.empty(len(order), np.int64)
    position[order] = np.arange(len(order))
    return np.sort(np.repeat(position, np.diff(at)) * code + np.asarray(raw.values)[at[0] : at[-1]])


def _share_earlier(keys: np.ndarray, i: np.ndarray, j: np.ndarray, code: int) -> np.ndarray:
    """Whether the vectors at positions i and j share a leaf before ``code``: each of i's is looked up among j's."""
    out = np.zeros(len(i), bool)
    if not len(keys):
        return out
    first = np.searchsorted(keys, i * code)
    many = np.searchsorted(keys, (i + 1) * code) - first
    lo, ends = 0, np.cumsum(many)
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - many[lo] + LOOKUPS, "right")))
        n = many[lo:hi]
        pair = np.repeat(np.arange(lo, hi), n)
        own = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + first[pair]
        sought = keys[own] + (j - i)[pair] * code
        at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
        out[pair[keys[at] == sought]] = True
        lo = hi
    return out


def _leaf_links(table: pa.Table, radius: float) -> pa.Table:
    """Rows (a, b, n): links of vector a, weighed by the copies of the vectors it is linked with; b: one of its group, or null."""
    reps = table["rep"].to_numpy()
    order = np.argsort(reps, kind="stable")
    reps, many = reps[order], table["copies"].to_numpy()[order]
    own = table["own"].to_numpy()[order]
    flat = table["vec"].combine_chunks()
    x = np.asarray(flat.flatten(), np.float64).reshape(len(reps), -1)[order]
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    code, a, b = (table[c][0].as_py() for c in ("code", "a", "b"))
    earlier = _earlier_leaves(table, order, code)
    links, all_i, all_j = np.zeros(len(reps), np.int64), [], []
    for lo in range(0, len(reps), 512):
        sims = x[lo : lo + 512] @ x[lo:].T
        i, j = np.nonzero(sims >= radius - 1e-9)
        i, j = i + lo, j + lo
        ok = (i < j) & ((own[i] != own[j]) if a != b else True)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        # the bound itself is checked on plain double sums, as a matrix product may round otherwise
        near = np.abs(sims[i - lo, j - lo] - radius) < 1e-9
        if near.any():
            exact = np.array([math.fsum(x[p] * x[q]) for p, q in zip(i[near], j[near])])
            bad = np.flatnonzero(near)[exact < radius]
            i, j = np.delete(i, bad), np.delete(j, bad)
        all_i.append(i), all_j.append(j)
        first = ~_share_earlier(earlier, i, j, code)
        np.add.at(links, i[first], many[j[first]])
        np.add.at(links, j[first], many[i[first]])
    none = np.zeros(0, np.int64)
    root = _stars(len(reps), np.concatenate([*all_i, none]), np.concatenate([*all_j, none]))
    out = np.flatnonzero((links > 0) | (root != np.arange(len(reps))))
    return pa.table({"a": reps[out], "b": reps[root[out]], "n": links[out]})


def _linked_classes(rows: DataFrame, dims: int, radius: float, trees: int) -> DataFrame:
    """(of_label, of_vec, n_links, component): the classes of equal vectors of ``dims`` numbers among the good rows (id, label, vec, ok)."""
    spark = rows.sparkSession
    classes = write_table(
        rows.where(F.col("ok") & (F.size("vec") == dims)).groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")),
        "vectors",
    )
    n, per_label = classes.count(), classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    drawn = classes.where(F.pmod(F.xxhash64(F.lit("forest"), "rep"), F.lit(max(1, math.ceil(n / (SAMPLE * 3 // 4))))) == 0).limit(SAMPLE).select("vec", "rep", "label").collect()
    drawn.sort(key=lambda r: r.rep)
    sample = np.array([r.vec for r in drawn], np.float64).reshape(len(drawn), dims)
    sample /= np.maximum(np.sqrt((sample * sample).sum(axis=1, keepdims=True)), 1e-300)
    # a leaf holds LEAF of the largest label's vectors
    forest = spark.sparkContext.broadcast(sized_forest(sample, np.array([r.label for r in drawn]), per_label, trees, radius))

    def index(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, dims)
            x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            row, code = forest.value.leaves(x)
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(code.astype(np.int32)))], ["vec", "label", "rep", "copies", "leaves"])

    placed = classes.select("vec", "label", "rep", "copies").mapInArrow(index, f"vec {rows.schema['vec'].dataType.simpleString()}, label string, rep long, copies long, leaves array<int>")
    # a vector takes along the leaves before this one only: they tell whether a pair was counted already
    in_leaf = placed.select("*", F.posexplode("leaves").alias("p", "code")).withColumn("before", F.slice("leaves", F.lit(1), F.col("p")))
    counts = in_leaf.groupBy("label", "code").agg(F.count("*").alias("n")).where("n > 1")
    slices = F.ceil(F.col("n") / F.lit(SLICE)).cast("int")
    own = F.pmod(F.xxhash64(F.lit("slice"), "rep"), slices).cast("int")
    meet = F.transform(F.sequence(F.lit(0), slices - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("a"), F.greatest(o, F.col("own")).alias("b")))
    groups = in_leaf.join(counts, ["label", "code"]).withColumn("own", own).withColumn("m", F.explode(meet)).select(
        "label", "code", F.col("m.a").alias("a"), F.col("m.b").alias("b"), "own", "vec", "rep", "copies", "before")
    found = write_table(groups.groupBy("label", "code", "a", "b").applyInArrow(lambda t: _leaf_links(t, radius), "a long, b long, n long"), "links")
    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select("a", "b")).select(F.col("node").alias("a"), "root")
    return classes.join(links, classes.rep == links.a, "left").drop("a").join(roots, F.col("rep") == roots.a, "left").select(
        F.col("label").alias("of_label"), F.col("vec").alias("of_vec"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component"))


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", radius: float = RADIUS, trees: int = TREES) -> DataFrame:
    """(id, n_links, component, kept), a row for each row of ``vectors``.

    Two vectors are linked if their labels are equal and not null and their cosine, in double precision, is ``radius`` or more; only
    pairs that share a leaf of a tree are compared. Equal vectors of a label are one class with a representative and a number
    of copies, so copies are linked through it and never as pairs. n_links counts the other rows linked directly: a pair that
    shares several leaves counts in the first of them. Out of a leaf come a count and one edge for each vector, not its pairs.
    component is the smallest id reachable, the row's own included.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null label, are linked with
    nothing and are their own component. Vectors of different lengths are never linked; each length has a forest of its own. A row with
    a null id is linked with nothing and its component is null. Repeated rows count as copies. An empty table gives no rows.

    The trees are fitted on a sample of at most SAMPLE vectors, chosen by a hash; every vector is indexed. There are
    ``trees`` trees or as many more as the sample shows to be needed (:func:`sized_forest`). A leaf with more than
    SLICE vectors of a label is cut into slices that meet two by two: nothing is capped.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    # floats stay floats on their way, and become doubles where they are compared
    number = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    vec = F.transform(F.col(vec_col), lambda v: v.cast(number))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & ~bad, F.lit(False))
    # zero, or so small or large that the length has no double
    length = F.aggregate(F.when(good, F.col("vec")).otherwise(F.array().cast(f"array<{number}>")), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = rows.withColumn("ok", good & (length > 0) & (length < float("inf")))
    lengths = [r.d for r in rows.where("ok").select(F.size("vec").alias("d")).distinct().orderBy("d").collect()]
    if not lengths:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(True).alias("kept"))
    per_class = _linked_classes(rows, lengths[0], radius, trees)
    for dims in lengths[1:]:
        # each is written, so that the plan doesn't grow with the lengths
        per_class = per_class.unionByName(write_table(_linked_classes(rows, dims, radius, trees), "classes"))
    keyed = rows.withColumns({"k": F.when(F.col("ok"), F.col("label")), "v": F.when(F.col("ok"), F.col("vec"))})
    out = keyed.join(per_class, (F.col("k") == F.col("of_label")) & (F.col("v") == F.col("of_vec")), "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
