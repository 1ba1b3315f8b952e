"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over all documents. Words that look
disguised (digits or symbols among letters, letters spaced or dotted apart,
letters repeated) become lattices of the letters that they may stand for, and
a Viterbi search picks the spelling that the character model and the channel
costs together find likeliest. Restored words are then scored: from labelled
rows each word and word beginning gets the lower confidence bound of the share
of toxic documents among those that hold it, and a text's score is the largest
bound among its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import crc_of_id, materialize, slices, texts_utf8

#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
_SPLIT = re.compile(r"[\s.,;:?\"“”«»)\]}>/\\]+")
_SPACED = re.compile(r"(?<![^\s])(?:[^\W_]|[@$!|+€£])(?:[ .\-_*]{1,2}(?:[^\W_]|[@$!|+€£])){3,}(?![^\s.,;:!?])")
_DISGUISED = re.compile(r"(?=.*[a-z])(?=.*[0-9@$!|+€£*_\-]).*[a-z@$!|+0-9].*|(?=.*([a-z])\1\1).*|(?:[0-9@$!|+]+[a-z]+)")
_WIDE = re.compile(r"[ .\-_*]{2}")
_GAPS = str.maketrans("", "", " .-_*")
_EDGES = "'`´’‘-–—_*~#&=%^<([{\""
_A, _OTHER = ord("a"), 27  # 0 is a word's edge, 1 to 26 are letters
SIGNS = 28


def _code(c: str) -> int:
    return ord(c) - _A + 1 if "a" <= c <= "z" else _OTHER


def char_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over the words of all documents: SIGNS ** 3 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIGNS**3, np.int64)
        codes = np.full(256, _OTHER, np.int64)
        codes[_A : _A + 26] = np.arange(1, 27)
        codes[32] = 0
        keep = bytes(b if b > 32 else 32 for b in range(256))
        for batch in batches:
            for part in slices(batch):
                # a character beyond ASCII is several signs of the kind "other"
                text = b" ".join(t for t in texts_utf8(part.column(0)) if t)
                x = codes[np.frombuffer(b"  " + text.lower().translate(keep) + b" ", np.uint8)]
                total += np.bincount((x[:-2] * SIGNS + x[1:-1]) * SIGNS + x[2:], minlength=SIGNS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["gram", "n"])

    out = np.zeros(SIGNS**3)
    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "gram int, n long")
    for r in counted.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most SIGNS ** 3 rows
        out[r["gram"]] = r["n"]
    return out


class Deobfuscator:
    """Viterbi decoding of disguised words under a character trigram model."""

    #: Channel costs in nats: a sign for a letter, a separator left out, a repeated letter left out, a sign kept.
    LEET_COST, DROP_COST, REPEAT_COST, KEEP_COST = 1.0, 0.7, 0.7, 4.0

    def __init__(self, counts: np.ndarray) -> None:
        c = counts.reshape(SIGNS, SIGNS, SIGNS)
        two, one = c.sum(axis=0), c.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SIGNS)
        p2 = (two + 8 * p1) / (two.sum(axis=1, keepdims=True) + 8)
        p3 = (c + 8 * p2) / (c.sum(axis=2, keepdims=True) + 8)
        self.log = np.log(p3).tolist()

    def decode(self, word: str) -> str:
        """The likeliest spelling of ``word`` (lower case, no white space but between single letters), exactly."""
        log = self.log
        # state: the last two signs; value: cost, the letters so far as (all before, last)
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for at, c in enumerate(word):
            options: list[tuple[str, float]] = []
            if "a" <= c <= "z":
                options.append((c, 0.0))
                if word[at - 1 : at] == c:
                    options.append(("", self.REPEAT_COST))
            else:
                options += [(x, self.LEET_COST) for x in LEET.get(c, "")]
                if c in " .-_*":
                    options.append(("", self.DROP_COST))
                options.append((c, self.KEEP_COST if c in LEET or not c.isalpha() else 0.0))
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, done) in states.items():
                for x, channel in options:
                    if x:
                        s = _code(x)
                        key, value = (b, s), (cost + channel - log[a][b][s], (done, x))
                    else:
                        key, value = (a, b), (cost + channel, done)
                    if key not in after or value[0] < after[key][0]:
                        after[key] = value
            states = after  # no more than SIGNS ** 2, and few: every path is kept that may be the best
        done = min(((cost - log[a][b][0], done) for (a, b), (cost, done) in states.items()), key=lambda x: x[0])[1]
        out = []
        while done:
            done, x = done
            out.append(x)
        return "".join(reversed(out))


def spaced_runs(text: str) -> list[str]:
    """Runs of four or more single letters or signs that stand apart from each other."""
    return _SPACED.findall(text)


def parts_of(token: str) -> list[str]:
    """Lower-cased words of a white-space token, without marks at their edges."""
    return [w for x in _SPLIT.split(token.lower()) if (w := x.strip(_EDGES))]


def features_of(word: str) -> set[str]:
    """The word and its beginnings, which catch inflected and compound forms."""
    word = word.rstrip("!|$+")
    return {word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)}


class Restorer:
    """Feature sets of tokens, restored where they look disguised."""

    def __init__(self, counts: np.ndarray) -> None:
        self.deobfuscator = Deobfuscator(counts)

    def features(self, token: str) -> set[str]:
        out: set[str] = set()
        for word in parts_of(token):
            out |= features_of(word)
            if _DISGUISED.fullmatch(word):
                out |= features_of(self.deobfuscator.decode(word))
        dotted = token.lower().strip(".,;:!?\"'")
        if len(dotted) >= 7 and _SPACED.fullmatch(dotted):
            out |= self.spaced(dotted)
        return out

    def spaced(self, run: str, longest: int = 32) -> set[str]:
        """Features of words anywhere in a run of single letters, which does not show where they begin.

        Words of four letters or more, up to ``longest``, and word beginnings are
        taken at every letter; shorter words only between wider gaps.
        """
        return set(self.each_spaced(run, longest))

    def each_spaced(self, run: str, longest: int) -> Iterator[str]:
        """The same one by one, with repeats."""
        run = run.lower()
        for part in {run, *_WIDE.split(run)}:
            letters = self.deobfuscator.decode(part).translate(_GAPS)
            if letters:
                yield from features_of(letters)
            if part == run:
                for k in range(len(letters) - 3):
                    yield from (letters[k : k + n] for n in range(4, min(longest, len(letters) - k) + 1))
                    yield from (letters[k : k + n] + "*" for n in (4, 5, 6) if k + n < len(letters))


def lower_bound(hits: int, n: int, z: float) -> float:
    """Wilson's lower confidence bound of a share."""
    p = hits / n
    return max(0.0, (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def log_tail(hits: int, n: int, p: float) -> float:
    """Upper bound of the log chance of ``hits`` or more among ``n`` at rate ``p`` (Chernoff)."""
    q = hits / n
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


class _Cache(dict):
    def __init__(self, make, most: int = 200_000) -> None:
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


class Model:
    """Scores texts; small enough to travel with a task: trigram counts and the kept lexicon."""

    def __init__(self, counts: np.ndarray, lexicon: dict[str, float], base: float) -> None:
        self.counts, self.lexicon, self.base = counts, lexicon, base
        self._cache = self._restorer = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": None, "_restorer": None}

    def scores(self, texts: Iterable[bytes | None]) -> list[float]:
        if self._cache is None:
            self._restorer, get, base = Restorer(self.counts), self.lexicon.get, self.base
            self._cache = _Cache(lambda token: max((get(f, base) for f in self._restorer.features(token)), default=base))
        value, out, longest = self._cache.__getitem__, [], max(map(len, self.lexicon), default=0)
        for raw in texts:
            text = raw.decode("utf-8", "replace") if raw else ""
            best = max(map(value, set(text.split())), default=self.base)
            for run in spaced_runs(text):
                best = max(best, max((self.lexicon.get(f, self.base) for f in self._restorer.each_spaced(run, longest)), default=best))
            out.append(best)
        return out


_BANDS, _BAND_HASHES = 6, 6


def _with_bands(shingle: int):
    """The rows and, of each text's word shingles, hashes of ``_BAND_HASHES`` minhashes each."""
    from auditlake.llm.jaccard import Shingler, _mixed

    turns = np.random.default_rng(11).integers(1, 1 << 63, _BANDS * _BAND_HASHES, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            for part in slices(batch):
                bands = []
                for text in texts_utf8(part.column(2)):
                    grams = shingler(text)
                    low = np.array([_mixed(grams * k).min() if len(grams) else 0 for k in turns], np.uint64).reshape(_BANDS, -1)
                    bands.append([xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in low])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bands, pa.list_(pa.int64()))], [*part.schema.names, "bands"])

    return run


def families(rows: DataFrame, *, shingle: int = 5) -> DataFrame:
    """text and toxic of one of ``rows`` (doc_id, text, toxic) for each label of each group of near copies.

    Two texts are near copies if six independent minhashes of their word shingles
    agree, in one of six such bands: nearly sure from a similarity of 0.9 on, and
    one in thousands at 0.3, so that a passage in common folds nothing. Groups pass
    their smallest member on from band to band. Repeated rows are one.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    plain = rows.select("doc_id", "toxic", "text")
    sample = plain.mapInArrow(_with_bands(shingle), f"doc_id {kind}, toxic {rows.schema['toxic'].dataType.simpleString()}, text string, bands array<long>")
    sample = materialize(sample.withColumn("row", F.monotonically_increasing_id()), "sample")
    told = F.xxhash64("doc_id", "text")
    nodes = sample.groupBy("bands").agg(F.min(told).alias("label"))
    for k in range(_BANDS):
        nodes = nodes.withColumn("label", F.min("label").over(Window.partitionBy(F.col("bands")[k])))
    first = sample.select("bands", "toxic", F.struct(told.alias("told"), "row").alias("rank")).join(nodes, "bands").groupBy("label", "toxic").agg(F.min("rank").alias("rank"))
    first = materialize(first.select(F.col("rank.row").alias("row")), "families")
    return sample.join(F.broadcast(first), "row").select("text", "toxic")  # at most a row for each of ``rows``


def fit(docs: DataFrame, labels: DataFrame, *, train_rows: int = 50_000, z: float = 1.64, held_out: tuple[int, int] = (4, 2)) -> Model:
    """The model of ``docs`` and ``labels``.

    ``labels`` has doc_id and toxic (rows with a null in either, and documents
    whose crc32(doc_id) mod held_out[0] is held_out[1], teach nothing). Character
    statistics cover all documents; the lexicon is fitted on at most
    ``train_rows`` labelled documents, those with the smallest hashes of their
    ids (more rows only where ids repeat). A feature counts once for a family of
    near copies, and is kept where toxic families hold it too often for chance,
    given how many features there are. Repeated rows of documents or labels count
    once; of an id's labels the largest holds. Null and empty texts have no
    features; very long ones are read whole. Without documents or labels the
    lexicon is empty and every score is the base. Other columns are not read.
    """
    mod, out = held_out
    counts = char_counts(docs)
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .where(F.pmod(crc_of_id("doc_id"), F.lit(mod)) != out)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = plain.join(F.broadcast(chosen), "doc_id")  # at most train_rows pairs of numbers

    texts = families(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(counts)
        cache = _Cache(restorer.features, 50_000)
        n: Counter = Counter()
        hits: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = set().union(*map(cache.__getitem__, set((text or "").split())), *map(restorer.spaced, spaced_runs(text or "")), ("",))
                    n.update(own)
                    if toxic:
                        hits.update(own)
        keys = list(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([hits[k] for k in keys], pa.int64())], ["feature", "n", "hits"]
        )

    counted = texts.mapInArrow(count, "feature string, n long, hits long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    counted = materialize(counted.where("hits >= 3 or feature = ''"), "features")
    whole = counted.where("feature = ''").first()
    rate = (whole["hits"] + 1) / (whole["n"] + 2) if whole else 0.05
    chance = math.log(0.01 / max(counted.count(), 100))
    lexicon = {}
    for r in counted.where(F.col("hits") > 2 * rate * F.col("n")).collect():  # features of toxic texts in the bounded sample
        if r["feature"] and log_tail(r["hits"], r["n"], rate) < chance:
            lexicon[r["feature"]] = lower_bound(r["hits"], r["n"], z)
    base = 0.3 * min(0.25, rate)
    return Model(counts, {f: v for f, v in lexicon.items() if v > base}, base)


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every document.

    Null and empty texts get the base score; null ids come back null; repeated rows
    are scored each; very long texts are read whole; an empty table gives no rows;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(texts_utf8(part.column(1))), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, whole, whose texts score below the threshold.

    Nulls, empty and very long texts, repeated rows and empty tables as in
    ``score``; all columns pass through, whatever their names.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                low = pa.array([s < threshold for s in model.scores(texts_utf8(part.column(at)))])
                yield part.filter(low)

    return docs.mapInArrow(run, docs.schema)
