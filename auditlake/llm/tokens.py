"""Whole-text encoding with a public tokenizer, one distinct word at a time.

The tokenizers library splits a text at white space before it merges pieces,
so a text's ids are those of its words in turn. Each distinct word is encoded
once, many new words in one call with a mark between them, and its ids stay in
a dictionary of bounded size; this gives exactly the library's ids at a
fraction of its time. A byte-level vocabulary gives a blank to the word after
it and a line break an id of its own; one with word ends drops both. Texts for
which the split by words is not certain (runs of blanks, other white space,
special tokens) go to the library whole.
"""

from __future__ import annotations

import os
import re
import string
from array import array

import numpy as np

#: Characters that libraries disagree on whether they are white space.
_UNSURE = "᠎​﻿"
_ODD_CHARACTER = re.compile(rf"[^\S \n]|[{_UNSURE}]")
_ODD_BLANKS = re.compile(rf"[^\S \n]|\s\s|\A\s|\s\Z|[{_UNSURE}]")
#: Texts to encode in a call: few enough that their words stay in the processor's caches.
TEXTS = 128
#: Words that are remembered in each of two generations.
WORDS = 1_000_000
#: Longer words are not kept.
_LONG = 64
#: A line of Latin letters and the ASCII signs after them; both are pieces of their own for the vocabularies known here.
_PLAIN_WORD = re.compile(r"^([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]{1,64})([!-/:-@\[-`{-~]{0,16})$", re.M)


def _byte_letters() -> dict[int, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones as they are, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in own)}


_BYTES = _byte_letters()


class WordEncoder:
    """Encodes texts as the tokenizers library does with add_special_tokens=False."""

    def __init__(self, path: str, most: int = WORDS) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        # without character offsets, which nobody reads
        self.whole = lambda text: array("I", tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        #: A byte-level vocabulary keeps blanks; one with a normalizer and word ends drops them.
        self.keeps_blanks = tokenizer.normalizer is None
        #: Stands between the words of a call; its single id shows where each ends.
        self.mark = "\n" if self.keeps_blanks else "~"
        found = np.frombuffer(self.whole(self.mark), "<u4")
        self.mark_id = int(found[0]) if len(found) == 1 else None
        #: Words' ids as little-endian 32-bit integers, in two generations of about ``most`` each, and those of signs.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most, self.tails = most, {"": b""}
        self.pieces = tokenizer.model.tokenize
        self.before = chr(_BYTES[32]) if self.keeps_blanks else ""
        probes = ["Probe", "l\u00e4nger", "\u00d1and\u00fa"]
        #: Whether words of Latin letters, which are never split, may go straight to the vocabulary's merges.
        self.direct = all(self._letters(w if self.keeps_blanks else w.lower()) == self._alone(w) for w in probes)

    def _letters(self, word: str) -> bytes:
        """A word of Latin letters."""
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.pieces(self.before + mapped)]).tobytes()

    def _alone(self, word: str) -> bytes:
        """A word that was not learned, being long or holding the mark; of a byte-level vocabulary with the blank or break before it."""
        return self.whole(word if not self.keeps_blanks or word[0] == "\n" else " " + word)

    def _keep(self, found: dict[str, bytes]) -> None:
        if len(self.known) + len(found) > self.most:
            self.known, self.old = {}, self.known
        self.known.update(found)

    def _get(self, word: str) -> bytes:
        """A word's ids, whether or not it was kept."""
        ids = self.known.get(word)
        if ids is None:
            ids = self.old.get(word)
        return self._alone(word) if ids is None else ids

    def _tail(self, signs: str) -> bytes:
        if (ids := self.tails.get(signs)) is None:
            if len(self.tails) > 10_000:
                self.tails = {"": b""}
            ids = self.tails[signs] = self.whole(signs)
        return ids

    def _learn(self, words: list[str]) -> None:
        """Encodes new words, many in a call: those of letters and signs at their end by the merges alone, the others as texts."""
        if self.mark_id is None:
            return
        if self.direct:
            pairs = _PLAIN_WORD.findall("\n".join(words))
            if pairs:
                self._learn_plain(pairs)
            words = [w for w in words if w not in self.known] if len(pairs) < len(words) else []
        if words:
            self._learn_others(words)

    def _learn_plain(self, pairs: list[tuple[str, str]]) -> None:
        keys = [h for h, _ in pairs]
        if not self.keeps_blanks:
            keys = "\n".join(keys).lower().split("\n")
        known, old, found = self.known, self.old, {}
        for k in {k for (h, t), k in zip(pairs, keys, strict=True) if t or h != k}:  # others are new themselves
            if (ids := known.get(k) or old.get(k)) is not None:
                found[k] = ids
        new = [k for k in dict.fromkeys(keys) if k not in found]
        found.update(zip(new, map(self._letters, new), strict=True))
        found.update([(h + t, found[k] + self._tail(t)) for (h, t), k in zip(pairs, keys, strict=True) if t or h != k])
        self._keep(found)

    def _learn_others(self, words: list[str]) -> None:
        """New words, each without the signs at its end, which are pieces of their own after a letter or digit."""
        known, old, blanks, mark = self.known, self.old, self.keeps_blanks, self.mark
        again, heads, tailed = [], set(), []
        for w in words:
            if w and len(w) <= _LONG and (blanks or mark not in w):
                head = w.rstrip(string.punctuation)
                # in lower case or composed form a letter beyond these may end in a mark, which would join the signs
                if head and head[-1].isalnum() and (blanks or (head[-1] < "\u0250" and head[-1] != "\u0130")):
                    if not blanks and (head.isascii() or (max(head) < "\u0250" and "\u0130" not in head)):
                        head = head.lower()
                    if head not in known:
                        if head in old:
                            again.append(head)
                        else:
                            heads.add(head)
                    if head != w:
                        tailed.append((w, head, w[len(head) :]))
                else:
                    heads.add(w)
        found = {w: old[w] for w in again}
        todo = []
        for w in heads:
            if self.direct and w.isalpha() and (w.isascii() or max(w) < "\u0250") and (blanks or w.islower()):
                found[w] = self._letters(w)
            else:
                todo.append(w)
        for at in range(0, len(todo), 2000):
            part = todo[at : at + 2000]
            data = self.whole("".join([w if w[0] == mark else f"{mark} {w}" for w in part]) if blanks else f" {mark} ".join([*part, ""]))
            ends = np.flatnonzero(np.frombuffer(data, "<u4") == self.mark_id) * 4
            if len(ends) != len(part):
                continue  # they are encoded one by one where they are met
            cuts = [*ends.tolist(), len(data)]
            if blanks:
                found.update((w, data[a if w[0] == mark else a + 4 : b]) for w, a, b in zip(part, cuts, cuts[1:], strict=False))
            else:
                found.update((w, data[a + 4 : b]) for w, a, b in zip(part, [-4, *cuts], cuts[:-1], strict=False))
        for w, head, tail in tailed:
            if (ids := found.get(head) or known.get(head)) is not None:
                found[w] = ids + self._tail(tail)
        self._keep(found)

    def _split(self, text: str | None) -> list[str]:
        """Words between single blanks; of a byte-level vocabulary a word that starts a line has the break before it, the first one too."""
        if not text:
            return []
        if self.keeps_blanks:
            return ("\n" + text).replace("\n", " \n").split(" ")[1:]
        return text.replace("\n", " ").split(" ")

    def _odd(self, text: str) -> bool:
        return bool((_ODD_BLANKS if self.keeps_blanks else _ODD_CHARACTER).search(text)) or any(s in text for s in self.special)

    def _strange(self, words: str) -> bool:
        return bool(_ODD_CHARACTER.search(words)) or any(s in words for s in self.special)

    def ids_of_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; null is empty."""
        split = [self._split(t) for t in texts]
        words, generation = set().union(*split), self.old
        new = words.difference(self.known)
        # words that hold odd characters are never kept, so they are always new
        odd = self._strange("\n".join(new))
        careful = odd or (self.keeps_blanks and ("" in words or "\n" in words)) or any(" " in s for s in self.special)
        whole = [careful and bool(t) and self._odd(t) for t in texts]
        self._keep({w: generation[w] for w in new if w in generation} | ({} if self.keeps_blanks else {"": b""}))
        new = new.difference(self.known)
        new.discard("\n")
        self._learn([w for w in new if not self._strange(w)] if odd else list(new))
        if self.old is not generation:  # what this call needs of the words that are old now
            self.known.update([(w, self.old[w]) for w in words if w in self.old and w not in self.known])
        get, skip = self.known.__getitem__, 4 if self.keeps_blanks else 0
        out = []
        for t, s, w in zip(texts, split, whole, strict=True):
            if not t or w:
                out.append(self.whole(t) if t else b"")
                continue
            try:
                ids = b"".join(map(get, s))
            except KeyError:  # long words, and some with the mark in them
                ids = b"".join(map(self._get, s))
            out.append(ids[skip:])
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str, most: int = WORDS) -> WordEncoder:
    """The encoder of a tokenizer file, kept for the life of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path, most)
    _ENCODERS[path].most = most
    return _ENCODERS[path]
