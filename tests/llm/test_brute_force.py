"""Results of whole queries against slow and plain versions on the smallest tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.dataset as ds
import pytest
import xxhash

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] or "" for r in ds.dataset(f"{SF}/documents.parquet").to_table().to_pylist()}


def rows_of(spark, name):
    from auditlake.llm.queries import QUERIES

    return QUERIES[name](spark, SF).collect()


def test_op1(spark, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for b in ds.dataset(f"{SF}/benchmark.parquet").to_table().to_pylist():
        w = word.findall(b["text"].translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if w else []:
            windows[tuple(w[k : k + n])].add(str(b["item_id"]))
    sizes = {len(w) for w in windows}
    got = {r["doc_id"]: r for r in rows_of(spark, "op1_decontamination")}
    assert len(got) == len(texts)
    for i, t in texts.items():
        w = word.findall(t.translate(LOWER))
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])]
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) == (len(w), len(hit), len(items), bool(hit))


def test_op9(spark, texts):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    prints = {}
    for i, t in texts.items():
        w = word.findall(t.translate(LOWER))
        n = min(3, len(w))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + n]).encode(), seed=42) for k in range(len(w) - n + 1)] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r for r in rows_of(spark, "op9_simhash")}
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_simhash_links_with_unequal_thresholds(spark):
    """Random fingerprints in tight groups, found by every number of partitions and with small blocks."""
    import numpy as np

    from auditlake.llm import simhash

    rng = np.random.default_rng(5)
    values = set()
    for centre in rng.integers(0, 1 << 62, 25).tolist():
        x = centre
        for _ in range(30):
            for b in rng.integers(0, 64, int(rng.integers(1, 5))).tolist():
                x ^= 1 << b
            values.add(x & ((1 << 63) - 1))
    values = sorted(values)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, a in enumerate(values):
        for b in values[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    expected = {v: find(v) for v in values if find(v) != v}
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    n, both = simhash.bit_counts(frame)
    assert n == len(values) and both[3, 3] == sum(v >> 3 & 1 for v in values)
    for sizes in ((2,), (3,), (4,), (5,)):
        parts = simhash.plan(n, both, 3, sizes)
        assert sum(t for _, t in parts) + (len(parts) - sizes[0]) == 3 - sizes[0] + 1
        roots = simhash.components(simhash.links(frame, parts, block=16 if sizes == (4,) else 2048))
        assert {r["u"]: r["root"] for r in roots.collect()} == expected


def test_op6(spark, texts):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    tokens = {i: [*word.findall(t.translate(LOWER)), 0] for i, t in texts.items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    one = Counter(w for i in train for w in tokens[i])
    two = Counter(p for i in train for p in zip([1, *tokens[i]], tokens[i], strict=False))
    total = sum(one.values())

    def ratios(counts):
        n = Counter(counts.values())
        common, absolute, out = 6 * n[6] / n[1], n[1] / (n[1] + 2 * n[2]), {}
        for r in range(1, 6):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0
            out[r] = d if 0 < d <= 1 else 1 - absolute / r
        return out

    d1, d2 = ratios(one), ratios(two)
    lower = {w: d1.get(c, 1) * c / total for w, c in one.items()}
    unknown = 1 - sum(lower.values())
    after = defaultdict(list)
    for (a, b), c in two.items():
        after[a].append((b, c))
    weight = {}
    for a, own in after.items():
        freed = sum((1 - d2.get(c, 1)) * c for _, c in own)
        below = sum(c for _, c in own) + (freed <= 1e-9)
        weight[a] = below, (freed if freed > 1e-9 else 1) / below / (1 - sum(lower[b] for b, _ in own))

    def p(a, b):
        c = two.get((a, b), 0)
        return d2.get(c, 1) * c / weight[a][0] if c else weight.get(a, (0, 1.0))[1] * lower.get(b, unknown)

    for a in list(after)[:40]:
        assert abs(sum(p(a, w) for w in one) + p(a, None) - 1) < 1e-9
    got = {r["doc_id"]: r for r in rows_of(spark, "op6_katz")}
    for i, t in tokens.items():
        base = sum(math.log10((one.get(w, 0) + 0.1) / (total + 0.1 * (len(one) + 1))) for w in t)
        score = sum(math.log10(p(a, b)) for a, b in zip([1, *t], t, strict=False))
        r = got[i]
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score) < 1e-6
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(w in one for w in t), total, zlib.crc32(str(i).encode()) % 10 == 0)


def test_katz_model_tables(spark, texts):
    """The stored tables score the same documents alike, and hold the corpus's counts."""
    from auditlake.llm import katz
    from auditlake.llm.common import fresh_path, table

    path = fresh_path(spark, "model")
    docs = table(spark, SF, "documents")
    options = {"chunk_tokens": 3000, "bucket_tokens": 2000}
    first = {r["doc_id"]: r for r in katz.score(docs, model_path=path, **options).collect()}
    again = {r["doc_id"]: r for r in katz.score_with(docs, path, chunk_tokens=5000).collect()}
    assert first.keys() == again.keys() == texts.keys()
    for i, r in first.items():
        assert r[1:5] == again[i][1:5] and abs(r["score"] - again[i]["score"]) < 1e-9 and abs(r["base_score"] - again[i]["base_score"]) < 1e-9
    words = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)), 0])
    assert sorted(r["value"] for r in spark.read.parquet(f"{path}/order=1").collect()) == sorted(words.values())
    other = spark.createDataFrame([(1, "never seen words zzyzx"), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in katz.score_with(other, path).collect()}
    assert found[1]["n_tokens"] == 5 and found[2]["n_tokens"] == 1 and found[1]["score"] < found[2]["score"] < 0


def test_toxicity_held_out(spark):
    from auditlake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in ds.dataset(f"{sf}/labels.parquet").to_table().to_pylist()}
    rows = [r for r in QUERIES["op10_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    hits = sum(r["predicted"] and labels[r["doc_id"]] for r in rows)
    assert hits >= 0.5 * sum(labels[r["doc_id"]] for r in rows)
    assert sum(r["predicted"] for r in rows) - hits <= 0.05 * len(rows)


def test_deobfuscation(spark):
    from auditlake.llm.common import table
    from auditlake.llm.toxicity import Restorer, char_counts

    r = Restorer(char_counts(table(spark, "/root/testdata/sf0.01", "documents")))
    for word, plain in {"1d10t": "idiot", "stuuupid": "stupid", "$tup1d": "stupid", "m0r0n": "moron", "s.t.u.p.i.d": "stupid", "m-o-r-o-n": "moron"}.items():
        assert plain in r.features(word)
    assert "stupid" in r.spaced("s t u p i d")
    assert r.features("ordinary") == {"ordinary", "ordi*", "ordin*", "ordina*"}


def test_pipeline(spark, texts):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "best_fit_packing"]
    rows = corpus_pipeline.run(spark, SF).collect()
    kept = {r["doc_id"] for r in rows}
    assert kept <= set(texts) and len(kept) > 0.7 * len(set(texts.values()))
    dirty = {r["doc_id"] for r in rows_of(spark, "op1_decontamination") if r["contaminated"]}
    assert not kept & dirty


def test_op2_recall_on_the_stored_table(spark):
    import numpy as np

    from auditlake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = ds.dataset(f"{sf}/embeddings.parquet").to_table().to_pylist()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in QUERIES["op2_ann"](spark, sf).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    asked = np.flatnonzero(ids % 50 == 0)
    assert set(got) == set(ids[asked].tolist())
    hits = 0
    for q in asked:
        scores = x @ x[q]
        order = [int(ids[k]) for k in np.lexsort((ids, -scores)) if k != q][:5]
        own = sorted(got[int(ids[q])])
        assert [r for r, *_ in own] == [1, 2, 3, 4, 5] and all(abs(s - scores[np.flatnonzero(ids == v)[0]]) < 1e-9 for _, v, s in own)
        hits += len(set(order) & {v for _, v, _ in own})
    assert hits >= 0.9 * 5 * len(asked)


def test_code_sums_are_inner_products():
    import numpy as np

    from auditlake.llm.ann import byte_sums

    rng = np.random.default_rng(2)
    for d in (3, 8, 64, 70):
        turned, signs = rng.standard_normal((4, d)).astype(np.float32), rng.random((6, d)) < 0.5
        codes, sums = np.packbits(signs, axis=1), byte_sums(turned)
        got = sum(sums[:, b].take(codes[:, b], axis=1) for b in range(codes.shape[1]))
        # bits behind the last coordinate meet zeros
        assert np.allclose(got, turned @ (signs * 2.0 - 1).T, atol=1e-4)
