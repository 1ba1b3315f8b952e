"""Ids of whole texts against the library's own, on texts made to break the split by words."""

from __future__ import annotations

import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

ODD = ["\t", "\r", " ", "\x1c", "\x85", "​", "<|endoftext|>", "　", "  "]
PLAIN = ["a", "The", "the", "don't", "it's", "'s", "'", "é", "é", "́", "ñ", "漢", "1", "23", "~", "|", "&&&", "##", "_", "\n", " ", " ", " "]
PLAIN += ["İ", "Σ", "ΑΣ", "Länge", "ÉTÉ", "😀", "क़", "x" * 70, ".", ",", "!?", "Word.", "(two)"]
FIXED = ["", "~", " ", "\n", None, "a\n", "\na", "a \nb", "a\n b", "a\n\n\nb", "w " * 50_000, "y" * 20_000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("most", [500_000, 40])
def test_ids_are_the_library_s(name, most):
    from auditlake.llm.tokens import WordEncoder

    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), WordEncoder(path, most)
    assert own.direct
    random.seed(9)
    texts = FIXED + ["".join(random.choice(PLAIN + ODD * (k % 3 == 0)) for _ in range(random.randint(0, 25))) for k in range(2000)]
    got = [ids for at in range(0, len(texts), 9) for ids in own.ids_of_all(texts[at : at + 9])]
    assert got == [array("I", library.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts]
