"""Links of stored pages, and breadth-first traversal of the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.js import js_or, js_trim
from auditlake.operators.urls import crawl_url, in_language, is_interactive, is_link, not_html, resolve
from auditlake.session import settled

#: Fixed value: the title of pages that could not be loaded.
FAILED = "(error de carga)"


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href of every anchor, in order."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('<a[^>]+href="([^"]+)"'), F.lit(1))
    return pages.select("page_id", "url", F.posexplode(found).alias("pos", "href"))


def edges(pages: DataFrame, *, follow: Column | None = None) -> DataFrame:
    """src, dst and pos of links, normalized for crawling and resolved against their own page.

    Mail, telephone and script links, and what is no page by its extension, give
    none; of equal links the first counts. ``follow`` is a further condition on
    ``src`` and ``dst``.
    """
    rows = links(pages).where(is_link(F.col("href")))
    rows = rows.select(crawl_url(F.col("url")).alias("src"), crawl_url(resolve(F.col("url"), F.col("href"))).alias("dst"), "pos")
    rows = rows.where("src is not null and dst is not null").where(~not_html(F.col("dst"), "crawl"))
    if follow is not None:
        rows = rows.where(follow)
    return rows.groupBy("src", "dst").agg(F.min("pos").alias("pos"))


def same_site() -> Column:
    """For ``edges``: links that stay on their page's host."""
    host = lambda c: F.regexp_extract(c, "^https?://([^/]+)", 1)
    return host(F.col("src")) == host(F.col("dst"))


def same_site_in(lang: str) -> Column:
    """For ``edges``: links that stay on the host and, by their path, in a language."""
    return in_language(F.col("dst"), F.regexp_extract("src", "^https?://([^/:]+)", 1), lang)


def bfs(seeds: DataFrame, edges: DataFrame, *, max_depth: int, max_nodes: int | None = None, keep: Column | None = None) -> DataFrame:
    """node and depth of all that ``seeds`` (node) reach over ``edges`` (src, dst) in at most ``max_depth`` steps.

    Level by level: the frontier joins the edges, and what was visited is taken
    out by an anti join. Each level is a table in the shared folder. ``keep`` is a
    condition on node. Under ``max_nodes`` the traversal stops with the level
    that reaches it, and keeps the first by (depth, node).
    """
    visited = frontier = settled(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    for depth in range(1, max_depth + 1):
        if max_nodes is not None and visited.count() >= max_nodes:
            break
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        if keep is not None:
            step = step.where(keep)
        frontier = settled(step.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited if max_nodes is None else visited.orderBy("depth", "node").limit(max_nodes)


def crawl(pages: DataFrame, seeds: DataFrame, *, max_depth: int = 5, max_urls: int | None = None, lang: str | None = None, failed: bool = True) -> DataFrame:
    """url, depth, title, ok and interactive of the pages that a crawl of stored pages visits.

    ``seeds`` has ``url``. Links are followed within their host and, if ``lang``
    is given, where the address contains ``/lang``; pages that are not stored
    cannot be loaded, and are rows titled ``FAILED`` or, without ``failed``, none.
    ``max_urls`` stops the traversal early (see ``bfs``).
    """
    stored = pages.withColumn("node", crawl_url(F.col("url"))).where("node is not null")
    first = stored.groupBy("node").agg(F.min("page_id").alias("page_id"))
    stored = stored.drop("node").join(first, "page_id")
    keep = None if lang is None else contains_language(F.col("node"), lang)
    start = seeds.select(crawl_url(F.col("url")).alias("node")).where("node is not null")
    seen = bfs(start, edges(pages, follow=same_site()), max_depth=max_depth, max_nodes=max_urls, keep=keep)
    title = js_trim(F.regexp_extract(F.coalesce("html", F.lit("")), "(?is)<title[^>]*>(.*?)</title>", 1))
    known = stored.select("node", js_or(title, "(sin título)").alias("title"), is_interactive(F.coalesce("html", F.lit(""))).alias("interactive"))
    rows = seen.join(known, "node", "left" if failed else "inner")
    ok = F.col("title").isNotNull()
    return rows.select(F.col("node").alias("url"), "depth", F.coalesce("title", F.lit(FAILED)).alias("title"), ok.alias("ok"), F.coalesce("interactive", F.lit(False)).alias("interactive"))


def contains_language(url: Column, lang: str) -> Column:
    """Whether the address has the language as a part of its path."""
    return url.contains(f"/{lang}/") | url.endswith(f"/{lang}")


def crawl_counters(crawled: DataFrame) -> DataFrame:
    """One row: pages visited, errors, and the sizes of both classes of loaded pages."""
    ok, interactive = F.col("ok"), F.col("interactive")
    return crawled.agg(
        F.count("*").alias("pages"), F.count_if(~ok).alias("errors"), F.count_if(ok & interactive).alias("interactive"), F.count_if(ok & ~interactive).alias("static"), F.max("depth").alias("depth")
    )


def seed_path(pages: DataFrame, langs: str = "es|en|fr|de|pt|it", default: str = "/es/") -> DataFrame:
    """The language path of the first link of each page that has one, else the default."""
    found = links(pages).withColumn("lang", F.regexp_extract("href", f"/({langs})(/|$)", 1)).where("lang != ''")
    first = found.groupBy("page_id").agg(F.concat(F.lit("/"), F.min_by("lang", "pos"), F.lit("/")).alias("path"))
    return pages.select("page_id").join(first, "page_id", "left").select("page_id", F.coalesce("path", F.lit(default)).alias("path"))


def headings(html: Column) -> Column:
    """Texts of the second-level headings, tags stripped."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h2[^>]*>(.*?)</h2>"), F.lit(1))
    return F.transform(found, lambda h: F.regexp_replace(h, "<[^>]+>", ""))
