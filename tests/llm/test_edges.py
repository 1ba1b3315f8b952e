"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, lang string, n_words string, items string, score string, fp string, n string"
LONG = "lang palabra ñandú 12,5 " * 20_000


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "x", "y", "z", "w", "v") for i, t in zip(ids, texts, strict=True)], DOCS)


TEXTS = [None, "", " \n\t ", "one", "one", LONG, LONG, "a b c d e f g h i j k l", "A B C D E F G H I J K L", "<|endoftext|> x"]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, TEXTS, [0, 1, 2, 3, 3, 5, 6, 7, 8, None])


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def test_decontamination(spark, docs, empty):
    from auditlake.llm.decontam import decontaminate, uncontaminated

    bench = spark.createDataFrame([(10, "b c d e f g h i j k"), (2, "One!"), (2, "One!"), (None, "a"), (4, None), (5, "")], "item_id long, text string")
    rows = decontaminate(docs, bench).orderBy("doc_id", "n_words").collect()
    hit = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["items"]) for r in rows}
    assert len(rows) == len(TEXTS)
    assert hit[7, 12] == hit[8, 12] == (11, ["10"])  # the item without an id hits "a", but is not named
    assert hit[3, 1] == (1, ["2"])
    assert hit[0, 0] == hit[1, 0] == hit[2, 0] == (0, [])
    assert next(r for r in rows if r["doc_id"] == 7)["items_sha256"] == hashlib.sha256(b"10").hexdigest()
    assert not decontaminate(empty, bench).collect()
    none = decontaminate(docs, bench.limit(0)).collect()
    assert len(none) == len(TEXTS) and not any(r["contaminated"] for r in none)
    assert sorted(r["n_words"] for r in none) == sorted(r["n_words"] for r in rows)
    kept = uncontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["items"]) for r in kept.collect()) == [(i, "y") for i in (-1, 0, 1, 2, 5, 6)]


def test_decontamination_in_blocks_and_below_one(spark, docs):
    from auditlake.llm.decontam import decontaminate

    bench = spark.createDataFrame([(k, f"a b c d e f g h i j{'' if k % 2 else ' k'}") for k in range(6)], "item_id long, text string")
    whole, cut = (decontaminate(docs, bench, block_bytes=b).drop("items_sha256").orderBy("doc_id", "n_words").collect() for b in (1 << 20, 150))
    assert whole == cut
    near = spark.createDataFrame([(1, "a b c d e f X h i j")], "item_id long, text string")
    found = {r["doc_id"]: r["n_hit"] for r in decontaminate(docs, near, threshold=0.5).collect()}
    assert found[7] == 10 and not found[3]
    assert not any(r["n_hit"] for r in decontaminate(docs, near).collect())


def test_packing(docs, empty):
    from auditlake.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = pack(docs, path).collect()
    assert not pack(empty, path).collect()
    tokenizer, expected = Tokenizer.from_file(path), []
    for i, t in zip([0, 1, 2, 3, 3, 5, 6, 7, 8, None], TEXTS, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        expected += [(str(i), k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    _check_packed(rows, 2048)


def _check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_plan_is_best_fit_decreasing():
    from auditlake.llm.packing import plan_slots

    rng = np.random.default_rng(3)
    for capacity in (10, 64, 2048):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, capacity + 1, 40), rng.integers(1, 50, 40), strict=True)}
        ends: dict[int, list] = {}
        ranks: dict[int, list[int]] = {}
        for length, rank, n, first, offset in plan_slots(counts, capacity):
            ranks.setdefault(length, []).extend(range(rank, rank + n))
            for k in range(n):
                ends.setdefault(first + k, []).append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        for own in ends.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        rooms: list[int] = []
        for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
            fits = [k for k, r in enumerate(rooms) if r >= length]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= length
            else:
                rooms.append(capacity - length)
        assert len(ends) <= len(rooms)


def test_simhash(spark, docs, empty):
    from auditlake.llm.simhash import near_duplicates, survivors

    rows = near_duplicates(docs).collect()
    of = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert len(rows) == len(TEXTS)
    assert of[0] == of[1] == of[2] == 0 and of[5] == of[6] == 5 and of[7] == of[8] == 7 and of[3] == 3
    assert not near_duplicates(empty).collect()
    kept = survivors(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == [-1, 0, 3, 3, 5, 7]
    assert not survivors(empty).collect()


def test_toxicity(spark, docs, empty):
    from auditlake.llm.toxicity import accepted, fit, score

    texts = [f"these words are fine number {k} and more of them" + (" you stupid thing" if k % 4 == 0 else "") for k in range(120)]
    many = documents(spark, [*texts, "s t u p i d", "what a $tup1d idea", None, "", LONG], [*range(124), None])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)] + [(None, 1), (5, None), (3, 0), (3, 0)], "doc_id long, toxic int")
    model = fit(many, labels)
    got = {r["doc_id"]: r for r in score(many, model).collect()}
    assert len(got) == 125
    assert all(got[k]["predicted"] == (k % 4 == 0) for k in range(120))
    assert got[120]["predicted"] == got[121]["predicted"] == 1
    assert got[122]["predicted"] == got[123]["predicted"] == got[None]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = accepted(many, model)
    assert kept.columns == many.columns and kept.count() == 90 + 3
    assert not score(empty, model).collect()
    blank = fit(empty, labels.limit(0))
    assert not any(r["predicted"] for r in score(docs, blank).collect())


def test_token_shards(spark, docs, empty):
    from auditlake.llm.wavelet import round_trip

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = round_trip(docs, path, shard_tokens=50).collect()
    assert not round_trip(empty, path).collect()
    tokenizer, start = Tokenizer.from_file(path), 0
    order = sorted(zip([0, 1, 2, 3, 3, 5, 6, 7, 8, -1], TEXTS, strict=True), key=lambda x: x[0])
    got = sorted(rows, key=lambda r: r["start"])
    for (i, t), r in zip(order, got, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_wavelet_matrix():
    from auditlake.llm.wavelet import WaveletMatrix, build

    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 1), (1000, 5), (300_000, 50_257)):
        ids = rng.integers(0, top, n)
        data = build(ids.astype(np.uint32), np.array([7]), np.array([n]))
        w = WaveletMatrix(data)
        assert (w.all_ids() == ids).all()
        for i in rng.integers(0, max(n, 1), 15 if n else 0).tolist():
            t = int(ids[i])
            assert w.access(i) == t and w.rank(t, i) == (ids[:i] == t).sum() and w.count(t) == (ids == t).sum() and w.select(t, w.rank(t, i)) == i
        assert w.count(1 << 20) == 0
    with pytest.raises(ValueError, match="cut short"):
        WaveletMatrix(data[:-3])
    with pytest.raises(ValueError, match="damaged"):
        WaveletMatrix(data[:-60] + bytes(1) + data[-59:]).all_ids()


def test_pieces_match_the_library(docs, empty):
    import random

    from tokenizers import models, pre_tokenizers

    from auditlake.llm.pieces import PieceCounter, count_pieces, vocabulary

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = vocabulary(path)
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = PieceCounter(pieces)
    random.seed(2)
    texts = ["".join(random.choice("ab the  ▁ñ漢字😀\n\t.,éß\x00☃☂") for _ in range(random.randint(0, 40))) for _ in range(3000)]
    assert [counter.text(t) for t in texts] == [len(library.encode(t).ids) for t in texts]
    got = count_pieces(docs, path).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(library.encode(t or "").ids) for t in TEXTS)
    assert not count_pieces(empty, path).collect()
    # integer scores make many ties
    tied = [("<unk>", 0.0), *((p, -float(len(p) % 2 + 1)) for p in ("▁", "▁a", "a", "b", "ab", "ba", "aba", "bab", "▁ab", "abab"))]
    library = Tokenizer(models.Unigram(tied, unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = PieceCounter(tied)
    texts = ["".join(random.choice("aabbx ") for _ in range(random.randint(1, 25))) for _ in range(3000)]
    assert [counter.text(t) for t in texts] == [len(library.encode(t).ids) for t in texts]


def test_warc(spark):
    from auditlake.llm.common import fresh_path
    from auditlake.llm.warcz import read_archives, round_trip, write_archives

    same = "<p>" + "x" * 200
    rows = [(5, "http://a/1", same), (3, None, same), (9, "http://a/\n2", same), (1, "u", None), (2, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", same), (4, "u", LONG), (4, "u", LONG)]
    pages = spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id long, url string, html string, digest string, payload int")
    got = sorted(round_trip(pages).collect(), key=lambda r: (r["page_id"] or 0, r["payload_bytes"]))
    assert len(got) == len(rows)
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {
        (5, "revisit", 3), (3, "response", None), (9, "revisit", 3), (1, "response", None), (2, "response", None),
        (7, "response", None), (8, "response", None), (None, "response", None), (4, "response", None),
    }
    for r in got:
        body = next((h or "") for i, _, h in rows if i == r["page_id"]).encode()
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == hashlib.sha256(body).hexdigest()
        assert r["payload"] is None or bytes(r["payload"]) == body
    assert not round_trip(pages.limit(0)).collect()
    small = read_archives(write_archives(pages, fresh_path(spark, "small"), archive_bytes=300))
    assert small.count() == len(rows)


def test_warc_reader_checks():
    from auditlake.llm.warcz import decode_archive, encode_archive, encode_record

    digest = hashlib.sha256(b"hello").hexdigest()
    records = [encode_record(k, "u", b"hello", digest, None, "2024-01-01T00:00:00Z") for k in range(40)]
    data = encode_archive(records, [r * 30 for r in records])
    assert data[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18])
    assert [r.payload for r in decode_archive(data)] == [b"hello"] * 40
    assert len(list(decode_archive(encode_archive(records, [])))) == 40
    import zstandard

    for broken in (data[:-5], data[:60], encode_archive([records[0].replace(b"hello", b"hellO")], []), encode_archive([records[0] + b"x"], []), encode_archive([records[0].replace(b"WARC-Date", b"Other")], [])):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(decode_archive(broken))


def test_nearest(spark):
    from auditlake.llm.ann import nearest

    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 24)).round(3)
    x[60:120] = x[50]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(1000, None), (1050, [0.0] * 24), (1100, [float("nan")] * 24), (1150, [1.0, None] * 12), (1200, [float("inf")] * 24), (1250, [1.0]), (None, rows[0][1])]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = {}
    for r in nearest(frame).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(got) == set(range(0, 400, 50))
    right = 0
    for q, own in got.items():
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(400), -s.round(12)))[:5]
        assert sorted(own) == [1, 2, 3, 4, 5]
        right += len({v for v, _ in own.values()} & set(best.tolist()))
        assert all(abs(c - s[v]) < 1e-12 for v, c in own.values())
    assert right / (5 * len(got)) >= 0.9
    assert [got[100][k][0] for k in (1, 2, 3, 4, 5)] == [50, 60, 61, 62, 63]
    assert not nearest(frame.limit(0)).collect()
    few = nearest(frame.where("vec_id in (0, 7)")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 7)]
    assert sorted(nearest(frame, block_bytes=400).collect()) == sorted(nearest(frame).collect())


def test_url_rules(spark):
    from auditlake.llm.urlrules import judge

    urls = {
        1: None, 2: "", 3: "no scheme", 4: "https://A.Example.NET/en/1?x", 5: "https://net/", 6: "https://net?x=/", 7: "http://x.example.com/de/2#t", 8: "http://x.example.com/fr/2",
        9: "http://fr.org/fr/", 10: "ftp://a.org/de/", 11: "https://badnet/", 12: "x://y.net/z://w.org/", 13: "http://Ä.NET/É",
    }
    rows = list(urls.items()) + [(k, f"http://cheap-pills.example.info/en/{k}") for k in range(100, 160)] + [(k, f"http://good.example.info/en/{k}") for k in range(200, 300)]
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([(k, 1, int(k < 160)) for k in (*range(100, 140), *range(200, 300))] + [(None, 0, 1), (101, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(pages, labels).collect()}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[5] == ("net", "/", "net/", "block") and got[6] == ("net", "", None, "allow")
    assert got[7] == ("x.example.com", "/de/2", "example.com/de/", "block") and got[8][2:] == (None, "allow")
    assert got[9][2:] == ("org/fr/", "allow") and got[10][2:] == (None, "allow") and got[11][2:] == (None, "allow")
    assert got[12] == ("y.net", "/z://w.org/", "net/", "block") and got[13] == ("Ä.net", "/É", "net/", "block")
    assert all(got[k][3] == "block" for k in range(100, 160)) and all(got[k][3] == "allow" for k in range(200, 300))
    assert len(judge(pages, labels.limit(0)).collect()) == len(rows)
    assert not judge(pages.limit(0), labels).collect()


def test_katz_edges(spark, docs, empty):
    from auditlake.llm.katz import score

    rows = score(docs).collect()
    assert len(rows) == len(TEXTS) and all(np.isfinite([r["score"], r["base_score"]]).all() for r in rows)
    assert not score(empty).collect()
    held = documents(spark, ["a b", "c"], [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0][:2])
    assert all(r["score"] == 0 and r["train_tokens"] == 0 and r["held_out"] for r in score(held).collect())
