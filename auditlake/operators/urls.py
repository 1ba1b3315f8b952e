"""URL cleaning, predicates and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.js import first_match, js_or, js_trim
from auditlake.operators.dedup import first_wins

# Parameter names that cleaning removes, extensions of what is no page.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid"]
#: Extensions that the inventory cleaner, the crawlers and the smart crawler leave out.
NOT_PAGES = {
    "inventory": "pdf|jpg|jpeg|png|gif|svg|docx?|xlsx?|zip|rar|mp4|webm|ico|rss|xml|json|txt",
    "crawl": "pdf|jpg|jpeg|png|gif|svg|webp|mp4|webm|avi|mov|ico|css|js|zip|rar|doc|docx|xls|xlsx|json|rss|xml|woff|woff2|ttf|eot",
    "smart": "pdf|jpg|jpeg|png|gif|svg|mp4|zip",
}
# How forms write signs of a query that addresses may write otherwise.
FORM_SIGNS = {"%20": "+", "!": "%21", "'": "%27", "(": "%28", ")": "%29", "~": "%7E"}
#: Elements that make a page interactive, as patterns of HTML source.
INTERACTIVE = ["form", "input", "button", "select", "textarea", "dialog", "video", "audio", "iframe", "details"]


def not_html(url: Column, kind: str = "inventory") -> Column:
    return url.rlike(rf"(?i)\.({NOT_PAGES[kind]})$")


def _split(url: Column) -> tuple[Column, Column, Column, Column]:
    """Scheme and host in lower case, path, query with ``?``, fragment with ``#``."""
    part = lambda k: F.regexp_extract(url, r"^(https?://[^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$", k)
    return F.lower(part(1)), part(2), part(3), part(4)


def without_dots(path: Column) -> Column:
    """A path from its root without ``.`` and ``..`` parts; a last one leaves a slash."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 20)
    empty = F.array().cast("array<string>")
    shorter = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(parts, empty, lambda acc, x: F.when(x == "..", shorter(acc)).when(x == ".", acc).otherwise(F.array_append(acc, x)))
    last = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(last, "/"))


def resolve(base: Column, href: Column) -> Column:
    """The address that a link on page ``base`` names; null if the page's is not absolute, or for schemes other than http."""
    href = js_trim(href)
    origin, path, query, _ = _split(base)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    own_path, rest = F.regexp_extract(href, "^([^?#]*)(.*)$", 1), F.regexp_extract(href, "^([^?#]*)(.*)$", 2)
    found = first_match(
        [
            (href.rlike("(?i)^https?://"), F.regexp_replace(href, "(?i)^http", "http")),
            (href.startswith("//"), F.concat(F.regexp_extract(origin, "^[a-z]+:", 0), href)),
            (href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string")),
            (own_path.startswith("/"), F.concat(origin, without_dots(own_path), rest)),
            (own_path != "", F.concat(origin, without_dots(F.concat(folder, own_path)), rest)),
            (href.startswith("?"), F.concat(origin, path, href)),
        ],
        F.concat(origin, path, query, href),
    )
    return F.when(origin != "", found)


def is_address(url: Column) -> Column:
    """The format guard of addresses: they begin with http or https."""
    return F.coalesce(url.rlike("^https?://"), F.lit(False))


def clean_url(raw: Column, site: str = "https://example.com") -> Column:
    """Absolute, dots resolved, without tracking parameters and one final slash, fragment kept; null for empty, unparsable and non-HTML ones."""
    url = resolve(F.lit(site.rstrip("/") + "/"), F.nullif(raw, F.lit("")))
    url = F.regexp_replace(url, "(?i)^http", "http")
    origin, path, query, fragment = _split(url)
    kept = F.filter(F.split(F.substring(query, 2, 1 << 20), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING))
    # the query is written anew, whether or not something was removed
    joined = F.array_join(F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))), "&")
    for sign, form in FORM_SIGNS.items():
        joined = F.replace(joined, F.lit(sign), F.lit(form))
    query = F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined))
    out = F.concat(origin, without_dots(F.when(path == "", "/").otherwise(path)), query, fragment)
    out = F.regexp_replace(out, "/$", "")
    return F.when((origin != "") & ~not_html(out), out)


def crawl_url(url: Column) -> Column:
    """For crawling: without query, fragment and one final slash; null if not absolute."""
    origin, path, _, _ = _split(url)
    return F.when(origin != "", F.regexp_replace(F.concat(origin, F.when(path == "", "/").otherwise(path)), "/$", ""))


def clean_inventory(rows: DataFrame, site: str = "https://example.com") -> DataFrame:
    """First title of each cleaned URL of (url, title, _ord)."""
    cleaned = rows.select(clean_url(F.col("url"), site).alias("url"), F.coalesce(js_trim(F.col("title")), F.lit("")).alias("title"), "_ord")
    return first_wins(cleaned.where("url is not null"), ["url"])


def read_inventory(rows: DataFrame) -> DataFrame:
    """Rows with a url, trimmed, titles defaulted."""
    return rows.where(js_or(F.col("url")).isNotNull()).select(js_trim(F.col("url")).alias("url"), js_or(js_trim(F.col("title")), "(sin título)").alias("title"))


def should_visit(url: Column, site: str) -> Column:
    """Within the site, HTML, no mail address, no fragment. Unseen pages are an anti join away."""
    return url.startswith(site) & ~not_html(url, "crawl") & ~url.contains("mailto:") & ~url.contains("#")


def in_language(url: Column, host: Column | str, lang: str) -> Column:
    """Same host, and the path is the language's, below it, or the root."""
    host = F.lit(host) if isinstance(host, str) else host
    origin, path, _, _ = _split(url)
    path = F.regexp_replace(path, "/$", "")
    own = F.regexp_extract(origin, r"://(?:[^@/]*@)?([^:/]+)", 1) == host
    return own & (F.lit(lang == "") | (path == f"/{lang}") | path.startswith(f"/{lang}/") | (path == ""))


def is_link(href: Column) -> Column:
    """No mail, telephone or script link."""
    return ~href.rlike("(?i)^(mailto|tel|javascript):")


def is_plain_link(url: Column, origin: str) -> Column:
    """Same origin, over http, without fragment, query or media file."""
    return url.startswith("http") & url.startswith(origin) & ~url.contains("#") & ~url.contains("?") & ~not_html(url, "smart")


def is_interactive(html: Column) -> Column:
    """Whether the source has an element that users act on (an approximation of selector matching)."""
    return html.rlike(r"(?i)<(" + "|".join(INTERACTIVE) + r")\b|role=[\"']?(button|dialog|tab|menu)|aria-(expanded|haspopup)=")


def matches_lists(url: Column, include: list[str], exclude: list[str]) -> Column:
    ok = url.rlike("|".join(include)) if include else F.lit(True)
    return ok & ~url.rlike("|".join(exclude)) if exclude else ok
