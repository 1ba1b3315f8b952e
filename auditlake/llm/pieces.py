"""Token counts of a unigram vocabulary by a count-only Viterbi search.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at
each position of a word. Dynamic programming carries the best score of each
position and the number of pieces on the path that has it, never the path.
Ties are settled as the tokenizers library's unigram model settles them: pieces
are tried by their start, first to last, and a later one must be strictly
better; a character that no piece covers alone is an unknown piece at the
vocabulary's least score minus ten; unknown pieces in a row count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import slices

UNKNOWN_PENALTY = 10.0
#: The mark that stands for a blank.
BLANK = "▁"


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with Zipf scores by rank, the unknown piece first.

    The public file ranks its pieces without giving probabilities; control and
    byte pieces match nothing and are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kept = [k for k in range(model.get_piece_size()) if not (model.is_unknown(k) or model.is_control(k) or model.is_byte(k))]
    return [("<unk>", 0.0), *((model.id_to_piece(k), -math.log(r + 2.0)) for r, k in enumerate(kept))]


class PieceCounter:
    """Counts the pieces of words."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0, most: int = 400_000) -> None:
        self.automaton = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(pieces):
            if k != unknown and piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for k, (p, _) in enumerate(pieces) if k != unknown and len(p) == 1}
        self.unknown_score = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.most, self.known, self.old = most, {}, {}

    def _search(self, word: str) -> int:
        n = len(word)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, (length, score) in self.automaton.iter(word):
            matches[end + 1].append((length, score))
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top, at, is_unknown = None, 0, False
            for length, score in sorted(matches[end], reverse=True):
                if top is None or best[end - length] + score > top:
                    top, at = best[end - length] + score, end - length
            if word[end - 1] not in self.singles and (top is None or best[end - 1] + self.unknown_score > top):
                top, at, is_unknown = best[end - 1] + self.unknown_score, end - 1, True
            best[end], unknown[end] = top, is_unknown
            count[end] = count[at] + (not (is_unknown and unknown[at]))
        return count[n]

    def word(self, word: str) -> int:
        """Pieces of one word that starts with the blank mark."""
        n = self.known.get(word)
        if n is None:
            n = self.old.get(word)
            if n is None:
                n = self._search(word)
            if len(word) <= 64:
                if len(self.known) >= self.most:
                    self.old, self.known = self.known, {}
                self.known[word] = n
        return n

    def text(self, text: str | None) -> int:
        """Pieces of a whole text: the mark goes before it and replaces its blanks; words start at marks."""
        if not text:
            return 0
        words = text.split(" ")
        # a text that starts with a blank gets no second mark
        if not words[0]:
            words = words[1:]
        word = self.word
        return sum([word(BLANK + w) for w in words]) if BLANK not in text else sum(word(BLANK + w) for w in text.replace(" ", BLANK).removeprefix(BLANK).split(BLANK))


def count_pieces(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_chars and n_tokens of every document.

    Null and empty texts have none; very long texts and words are read whole; null
    ids come back null; repeated rows stay; an empty table gives no rows; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(model_file) or _COUNTERS.setdefault(model_file, PieceCounter(vocabulary(model_file)))
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(map(counter.text, texts), pa.int64())],
                    ["doc_id", "n_chars", "n_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_chars long, n_tokens long")


_COUNTERS: dict[str, PieceCounter] = {}
