"""URL filtering by association rules.

Labelled URLs become sets of tokens (host labels, path words, query keys); with
the token ``BAD`` added to those of rejected pages, Spark's FP-growth mines the
combinations that are frequent, and of the rules that end in ``BAD`` those
stay that are confident and not implied by a shorter rule as confident. A URL
is matched through an inverted index of the rules' rarest tokens. A list of
host and path rules comes before the mined ones: the longest that fits decides.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import materialize, slices

#: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BAD = "=bad"
_SPLIT = re.compile(r"[^a-z\-_]+")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, on, under in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(under)
        rule, verdict = F.when(fits, on + under).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens_of(url: str | None) -> set[str]:
    """Tokens of a URL: scheme, host labels and its last two together, path words, query keys, fragment. Numbers give none."""
    if not url or "://" not in url:
        return set()
    scheme, _, rest = url.lower().partition("://")
    rest, hash_, _ = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, _, path = rest.partition("/")
    labels = host.split(".")
    out = {f"scheme:{scheme}", *(f"host:{x}" for x in labels if x), "host:" + ".".join(labels[-2:])}
    out |= {f"word:{w}" for x in labels for w in x.split("-") if "-" in x and w}
    out |= {f"path:{w}" for w in _SPLIT.split(path) if w}
    out |= {f"query:{p.partition('=')[0]}" for p in query.split("&") if p}
    return out | ({"fragment"} if hash_ else set())


def _with_tokens(urls: DataFrame, others: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = pa.array([sorted(tokens_of(u)) for u in b.column(0).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([tokens, *(b.column(k + 1) for k in range(len(others)))], ["tokens", *others])

    kinds = dict(urls.dtypes)
    return urls.select("url", *others).mapInArrow(run, ", ".join(["tokens array<string>", *(f"{c} {kinds[c]}" for c in others)]))


def mine(labelled: DataFrame, *, least_rows: int = 15, confidence: float = 0.4, most_tokens: int = 4, train_rows: int = 100_000) -> list[tuple[frozenset[str], float, int]]:
    """(tokens, confidence, rows) of the rules mined from a table of url and bad (0 or 1).

    At most ``train_rows`` rows are used, those with the smallest hashes of their
    urls (their sort ends in one task of that many rows). A rule has at most
    ``most_tokens`` tokens: longer combinations are not rules here, which bounds
    what the driver collects to combinations of that many tokens that ``least_rows``
    rows hold. Of those a rule stays that no part of it implies as confidently.
    """
    chosen = labelled.where("url is not null and bad is not null").orderBy(F.xxhash64("url"), "url").limit(train_rows)
    baskets = materialize(_with_tokens(chosen, ["bad"]), "baskets")
    n = baskets.count()
    if not n or not baskets.where("bad = 1").count():
        return []
    items = F.when(F.col("bad") == 1, F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least_rows / n), minConfidence=confidence).fit(baskets.select(items.alias("items")))
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.size("antecedent") <= most_tokens))
    found = [(frozenset(r["antecedent"]), r["confidence"], round(r["support"] * n)) for r in rules.collect()]
    kept: list[tuple[frozenset[str], float, int]] = []
    for tokens, c, rows in sorted(found, key=lambda r: (len(r[0]), sorted(r[0]))):
        if not any(t < tokens and other >= c for t, other, _ in kept):
            kept.append((tokens, c, rows))
    return kept


class RuleIndex:
    """Mined rules, found by the token of each that the fewest rules have."""

    def __init__(self, rules: list[tuple[frozenset[str], float, int]]) -> None:
        often = Counter(t for tokens, *_ in rules for t in tokens)
        self.by_token: dict[str, list[tuple[frozenset[str], float]]] = defaultdict(list)
        for tokens, c, _ in rules:
            self.by_token[min(tokens, key=lambda t: (often[t], t))].append((tokens, c))
        self.by_token = dict(self.by_token)

    def confidence(self, tokens: set[str]) -> float:
        """The largest confidence of a rule all of whose tokens are there; else 0."""
        return max((c for t in tokens & self.by_token.keys() for rule, c in self.by_token[t] if rule <= tokens), default=0.0)


def judge(pages: DataFrame, labels: DataFrame, *, rules: Iterable[tuple[str, str, str]] = RULES, document: str = r"/(\d+)(?:\.html)?/?$", **options) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence of every page.

    A page's labels are those of the document whose id its path ends with
    (``document``); bad means toxic or of quality 0. Null urls and urls without
    ``://`` have empty hosts and paths, fit no rule and are allowed. Very long urls
    are read whole. Repeated rows stay; an empty table gives no rows; without labels
    nothing is mined; other columns are not read.
    """
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    path_only = own.select("url", F.regexp_extract(path_of(F.col("url")), document, 1).alias("digits"))
    ids = path_only.select("url", F.expr("try_cast(digits as bigint)").alias("doc_id")).where("doc_id is not null")
    known = labels.groupBy("doc_id").agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    index = RuleIndex(mine(ids.join(known, "doc_id").select("url", "bad"), **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 4096):
                c = pa.array([index.confidence(tokens_of(u)) for u in part.column(1).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), c], ["page_id", "url", "confidence"])

    kind = pages.schema["page_id"].dataType.simpleString()
    scored = own.mapInArrow(run, f"page_id {kind}, url string, confidence double")
    url = F.col("url")
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    mined = F.when(F.col("confidence") > 0, "block").otherwise("allow")
    out = scored.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "confidence")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence")
