"""Mined rules against supports and confidences counted plainly."""

from __future__ import annotations

import itertools
import random

import pytest


def test_mined_rules_are_all_that_counting_gives(spark):
    from auditlake.llm.urlrules import RuleIndex, mine, tokens_of

    rng = random.Random(8)
    rows = []
    for k in range(240):
        host, word, key = rng.choice(["a.example.com", "b.example.net"]), rng.choice(["win", "news", "shop"]), rng.choice(["ref", "page", ""])
        bad = int((word == "win" and key == "ref") or rng.random() < 0.1)
        rows.append((f"https://{host}/{word}/{k}" + (f"?{key}=1" if key else ""), bad))
    frame = spark.createDataFrame(rows, "url string, bad int")
    least, confidence, most = 12, 0.4, 3
    got = {(tokens, n): c for tokens, c, n in mine(frame, least_rows=least, confidence=confidence, most_tokens=most)}
    baskets = [(tokens_of(u), b) for u, b in rows]
    every = sorted(set().union(*(t for t, _ in baskets)))
    kept = {}
    for size in range(1, most + 1):
        for combo in map(frozenset, itertools.combinations(every, size)):
            held = [b for t, b in baskets if combo <= t]
            n, c = sum(held), sum(held) / len(held) if held else 0
            if n >= least and c >= confidence and not any(t < combo and other >= c for (t, _), other in kept.items()):
                kept[combo, n] = c
    assert kept and got.keys() == kept.keys() and all(got[k] == pytest.approx(c) for k, c in kept.items())
    index = RuleIndex([(t, c, n) for (t, n), c in got.items()])
    for tokens, _ in baskets:
        assert index.confidence(tokens) == pytest.approx(max((c for (t, _), c in kept.items() if t <= tokens), default=0.0))


def test_long_and_empty_tables(spark):
    from auditlake.llm.urlrules import judge

    pages = spark.createDataFrame([(1, "https://a.example.org/fr/" + "x" * 100_000), (1, None), (None, "https://NET/"), (4, "")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r["page_id"], r["rule"], r["verdict"]) for r in judge(pages, labels).collect()}
    assert got == {(1, "org/fr/", "allow"), (1, None, "allow"), (None, "net/", "block"), (4, None, "allow")}
    assert judge(pages.limit(0), labels).collect() == []
