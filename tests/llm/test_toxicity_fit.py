"""Which training rows the toxicity fit folds, and where it looks in spaced-out words."""

from __future__ import annotations

import random


def test_only_near_copies_are_folded(spark):
    from auditlake.llm.toxicity import families

    rng = random.Random(6)
    shared = "this passage stands in every one of these texts word for word"
    texts = [f"{shared} {' '.join(f'w{rng.randrange(5000)}' for _ in range(30))}" for _ in range(40)]
    near = " ".join(f"v{k}" for k in range(200))
    copies = [near, near, f"{near} more", near.replace("v100", "other")]
    rows = spark.createDataFrame([(k, t, int(k % 2)) for k, t in enumerate(texts + copies)], "doc_id long, text string, toxic int")
    got = [(r["text"], r["toxic"]) for r in families(rows).collect()]
    assert sorted(t for t, _ in got if t.startswith("this")) == sorted(texts)
    assert sorted(x for t, x in got if not t.startswith("this")) == [0, 1]


def test_words_anywhere_in_spaced_runs(spark):
    from auditlake.llm.common import table
    from auditlake.llm.toxicity import Model, char_counts

    model = Model(char_counts(table(spark, "/root/testdata/sf0.01", "documents")), {"idiot": 0.9, "moro*": 0.8}, 0.01)
    found = {
        "y o u i d i o t": 0.9,
        "a i d i o t": 0.9,
        "y o u  i d i o t  h e r e": 0.9,
        f"{'x ' * 38}i d i o t": 0.9,
        f"{'x ' * 500}1 d 1 0 t {'x ' * 500}end": 0.9,
        "y.o.u.m.o.r.o.n.s": 0.8,
        ".".join("x" * 40 + "idiot"): 0.9,
        "x" * 40 + "-0-" + "x" * 40: 0.01,
        "y o u i d o l": 0.01,
    }
    assert dict(zip(found, model.scores(t.encode() for t in found), strict=True)) == found


def test_long_words_are_restored(spark):
    from auditlake.llm.common import table
    from auditlake.llm.toxicity import Restorer, char_counts

    restorer = Restorer(char_counts(table(spark, "/root/testdata/sf0.01", "documents")))
    assert "idiot*" not in restorer.features("1d10t") and "idio*" in restorer.features("1d10t" + "s" * 1 + "a" * 45)
    assert len(restorer.deobfuscator.decode("a b " * 5000)) >= 10_000


def test_decode_is_the_best_of_all_spellings(spark):
    """Every spelling of short words, costed one by one."""
    import itertools

    import pytest

    from auditlake.llm.common import table
    from auditlake.llm.toxicity import LEET, Deobfuscator, _code, char_counts

    d = Deobfuscator(char_counts(table(spark, "/root/testdata/sf0.01", "documents")))

    def spellings(word):
        each = []
        for k, c in enumerate(word):
            if "a" <= c <= "z":
                own = [(c, 0.0)] + ([("", d.REPEAT_COST)] if word[k - 1 : k] == c else [])
            else:
                own = [(x, d.LEET_COST) for x in LEET.get(c, "")] + ([("", d.DROP_COST)] if c in " .-_*" else [])
                own.append((c, d.KEEP_COST if c in LEET or not c.isalpha() else 0.0))
            each.append(own)
        return itertools.product(*each)

    def cost(parts):
        a = b = 0
        total = 0.0
        for x, channel in parts:
            total += channel
            if x:
                s = _code(x)
                total -= d.log[a][b][s]
                a, b = b, s
        return total - d.log[a][b][0]

    rng = random.Random(3)
    words = ["1d10t", "st|p1d", "m-o-r-o-n", "aaabbb", "1", "--", "ñ1$!", "h e l l o"] + ["".join(rng.choice("aab1|!-. zñ0") for _ in range(rng.randrange(1, 8))) for _ in range(150)]
    for word in words:
        best = min(map(cost, spellings(word)))
        got = d.decode(word)
        assert min(cost(p) for p in spellings(word) if "".join(x for x, _ in p) == got) == pytest.approx(best)
