"""The pipeline's stages, each against a brute-force version on its own input."""

from collections import Counter

import corpus_pipeline as cp
from veilspan.llm import decontam, sharding, toxicity

from .test_operators import AWKWARD, SCHEMA, brute_components


def rows(df):
    return Counter(map(str, df.collect()))


def test_stages(spark, tiny):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{tiny}/documents.parquet").cache()
    clean = cp.drop_toxic(spark, docs, tiny).cache()
    good = {r.id for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{tiny}/labels.parquet")).collect() if not r.predicted}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == good
    single = cp.drop_near_duplicates(spark, clean, tiny).cache()
    want = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in clean.collect()]) if i == c}
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(want)
    free = cp.drop_benchmark(spark, single, tiny).cache()
    items = [decontam.normal_text(r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    exact = {r.doc_id for r in single.collect() if any(p in decontam.normal_text(r.text) for p in items)}
    assert free.columns == docs.columns and {r.doc_id for r in free.collect()} == {r.doc_id for r in single.collect()} - exact
    mixed = cp.mix_sources(spark, free, tiny).cache()
    assert mixed.columns == docs.columns and set(rows(mixed)) <= set(rows(free)) and max(rows(mixed).values()) <= 2
    out = cp.shard(spark, mixed, tiny)
    assert out.columns[: len(docs.columns)] == docs.columns and {r.shard for r in out.collect()} <= set(range(8))
    assert rows(cp.run(spark, tiny)) == rows(out)
    sharding.base_tree(8)


def test_awkward_rows(spark, tiny):
    docs = spark.createDataFrame([(*r, "x", 1, "s", "t", 2, "r", "c", "z") for r in AWKWARD], SCHEMA)
    for table in (docs, docs.limit(0)):
        kept = table
        for _, stage in cp.STAGES:
            kept = stage(spark, kept, tiny)
            assert kept.columns[: len(docs.columns)] == docs.columns
        assert kept.count() <= 2 * table.count()
    single = cp.drop_near_duplicates(spark, docs, tiny)
    ids = Counter(r.doc_id for r in single.collect())
    assert ids[0] == 1 and ids[7] == 0 and ids[None] == 2 and ids[1] == 1 and ids[2] == 0


def test_rows_that_share_an_id_are_decided_one_by_one(spark, tiny):
    """Null and repeated ids: each row stays or goes by its own text."""
    leak = next(r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").orderBy("item_id").collect() if len(r.text) > 60)
    a, b, c = (" ".join(f"{w}{(7 * k * k + 3 * k) % 101}" for k in range(60)) for w in ("oak", "elm", "fir"))
    table = lambda data: spark.createDataFrame([(i, t, "en", "s") for i, t in data], "doc_id long, text string, lang string, source string")
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    clean = [(None, a), (None, b), (5, c), (None, c)]
    assert left(cp.drop_benchmark(spark, table([*clean, (None, f"{a} {leak} {b}"), (5, f"{c} {leak}")]), tiny)) == sorted(clean, key=str)
    # 5 holds three unrelated texts, the first twice; 9 repeats one text of 5; nulls repeat among themselves
    data = [(5, a), (5, a), (5, b), (5, c), (9, b), (None, a), (None, a), (None, b)]
    for rows_ in (data, data[::-1]):
        assert left(cp.drop_near_duplicates(spark, table(rows_), tiny)) == sorted([(5, a), (5, b), (5, c), (None, a), (None, b)], key=str)
    # one source whose share is 1.5 of its words: with a draw for each row some rows come once and some twice
    many = table([(None, f"{a} n{k}") for k in range(40)] + [(5, f"{b} n{k}") for k in range(40)])
    mixed = Counter(left(cp.mix_sources(spark, many, tiny)))
    assert {sorted({n for (i, _), n in mixed.items() if i == x}) == [1, 2] for x in (None, 5)} == {True} and 100 <= sum(mixed.values()) <= 140
    same = Counter(left(cp.mix_sources(spark, table([(None, a)] * 10), tiny)))
    assert 14 <= same[None, a] <= 16
