"""The pipeline's near-duplicate stage against brute-force Jaccard of five-word shingles."""

from __future__ import annotations

import random
from collections import defaultdict


def grams_of(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()


def smallest_of_components(texts):
    """texts: id -> text. All pairs that share a shingle are compared."""
    sets = {i: grams_of(t) for i, t in texts.items()}
    holders, root = defaultdict(list), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def link(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    by_set = defaultdict(list)
    for i, s in sets.items():
        by_set[s].append(i)
    for own in by_set.values():
        for i in own:
            link(i, own[0])
    for s, own in by_set.items():
        for g in s:
            holders[g].append(own[0])
    shared = defaultdict(int)
    for own in holders.values():
        for k, i in enumerate(own):
            for j in own[:k]:
                shared[i, j] += 1
    for (i, j), n in shared.items():
        if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            link(i, j)
    return {i for i in sets if find(i) == i}


def mutated(rng, words, changes):
    out = list(words)
    for k in rng.sample(range(len(out)), changes):
        out[k] = f"z{rng.randrange(10**6)}"
    return " ".join(out)


def test_stage_finds_all_pairs_of_similarity_four_fifths(spark):
    import corpus_pipeline

    rng = random.Random(4)
    texts = {}
    for size in (12, 40, 100, 300):
        for _ in range(25):
            base = [f"w{rng.randrange(3000)}" for _ in range(size)]
            for changes in (0, 0, size // 60, size // 50 + 1, size // 40 + 1, size // 20):
                texts[len(texts)] = mutated(rng, base, changes)
    texts |= {len(texts) + k: t for k, t in enumerate(("", None, "a b", "A  b", "a b c"))}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == smallest_of_components(texts)


def test_stage_on_a_stored_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    expected = smallest_of_components({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    assert len(got) == len(set(got)) and set(got) == expected


def test_blocks_of_a_bucket(spark):
    from pyspark.sql import functions as F

    from auditlake.llm.jaccard import TEXT_HASH, nodes_of, similar_sets

    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(60)]
        texts += [mutated(rng, base, c) for c in (0, 1, 1, 2, 2, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.xxhash64("text").alias(TEXT_HASH), "text")
    read, _, nodes = nodes_of(docs, 5)
    whole, cut = (sorted(similar_sets(docs, read, nodes, shingle=5, threshold=0.8, limit=3, block=b, block_shingles=n).collect()) for b, n in ((2048, 1_000_000), (2, 100)))
    assert whole and whole == cut


def test_fingerprints_of_similar_sets_are_within_the_bound():
    import numpy as np

    from auditlake.llm import simhash
    from auditlake.llm.jaccard import _K, FEW, _mixed, most_bits

    rng = np.random.default_rng(3)
    worst = 0
    for n in (FEW, 80, 131, 250, 500):
        for _ in range(300):
            own = n // 9  # of each set's shingles the other lacks these: similarity 0.8
            both = rng.integers(0, 1 << 64, n + own, dtype=np.uint64)
            x, y = both[:n], both[own:]
            worst = max(worst, sum((simhash.majority(f(x)) ^ simhash.majority(f(y))).bit_count() for f in (lambda s: s, lambda s: _mixed(s + _K))))
    assert worst <= most_bits(0.8) == 40


def test_hot_groups_leave_as_forests(spark):
    """Copies of one text that are near and not near: links leave, not pairs, and every class is found."""
    from auditlake.llm.jaccard import one_of_each

    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    texts = {k: mutated(rng, base, rng.randrange(0, 20)) for k in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"] for r in one_of_each(docs).collect()}
    assert got == smallest_of_components(texts)


def test_rows_not_ids_are_told_apart(spark):
    from auditlake.llm.jaccard import one_of_each

    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text), (1, text), (1, "another text altogether"), (None, text), (2, text), (None, "only here"), (3, None), (4, ""), (5, "  ")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, sid int, a string")
    got = sorted(((r["doc_id"], r["text"]) for r in one_of_each(docs).collect()), key=repr)
    assert got == sorted([(1, text), (1, "another text altogether"), (None, "only here"), (3, None)], key=repr)
    assert one_of_each(docs.limit(0)).collect() == []
