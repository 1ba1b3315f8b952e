"""Registered queries of sources, sinks, crawls and the smaller operators, each with SQL that says the same.

Queries of sources and sinks write files to the shared folder and read them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import js
from auditlake.operators import captures, dedup, gates, linkgraph, lookup, metrics, normalize, rules, urls
from auditlake.plans.registry import _DIMS, _GROUPS, _MERGED, _NESTED, _RAW, _RESOLVE, _SEV4, _SLUG, _merged, query
from auditlake.session import scratch, settled
from auditlake.sources import arrays, bind, readers, sinks
from auditlake.sources.bind import table

_SIX = "source, id, impact, description, pageUrl, selector"

# Sources: files that the query writes


@query(f"with {_RAW} select {_SIX} from raw")
def source_findings(spark, d):
    """A folder of JSON arrays, with files that are to be passed over."""
    folder = scratch(spark, "findings")
    raw = bind.raw(spark, d)
    for source, name in (("sitemap", "a/results-sitemap"), ("interactiva", "b/Interactiva-1"), ("manual", "c/needs_review")):
        sinks.write_json_array(raw.where(F.col("source") == source).drop("source"), f"{folder}/{name}.json")
    sinks.write_json_array(raw, f"{folder}/a/sitemap-merged.json")
    sinks.write_text(spark, f"{folder}/a/sitemap-object.json", '{"id": "no array"}')
    sinks.write_text(spark, f"{folder}/a/sitemap-broken.json", '[{"id": "never closed"')
    found = readers.raw_findings(spark, folder)
    return found.select("source", "id", "impact", "description", "pageUrl", "selector")


@query("""select user_id::varchar as path, count(*) as n, sum(event_id)::bigint as ids from events group by user_id""")
def source_repair(spark, d):
    """Arrays broken in one of four ways, a file for each user."""
    e = table(spark, d, "events").select("user_id", F.to_json(F.struct("event_id")).alias("j"))
    files = e.groupBy("user_id").agg(F.sort_array(F.collect_list("j")).alias("j"))
    comma, glued = F.array_join("j", ","), F.array_join("j", "")
    k = F.col("user_id") % 4
    text = js.first_match(
        [(k == 0, F.concat(F.lit("["), comma, F.lit("]"))), (k == 1, F.concat(F.lit("["), glued, F.lit("]"))), (k == 2, F.concat(F.lit("["), comma, F.lit(",]")))], F.concat(F.lit("["), comma)
    )
    rows = readers.elements(files.select(F.col("user_id").cast("string").alias("path"), text.alias("text")), mend=True)
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.get_json_object("item", "$.event_id").cast("long")).alias("ids"))


@query("select trim(url) as url, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), '(sin título)') as title from pages where url <> ''")
def source_inventory(spark, d):
    """An inventory file."""
    path = scratch(spark, "urls") + ".json"
    sinks.write_json_array(bind.inventory(spark, d), path)
    return urls.read_inventory(readers.read_urls(spark, path))


@query("select trim(url) as url, '(sin título)' as title from pages where url <> ''")
def source_plain_inventory(spark, d):
    """An inventory file of plain addresses."""
    path = scratch(spark, "urls") + ".json"
    quoted = F.to_json(F.array("url"))
    sinks.write_values(table(spark, d, "pages").where("url is not null").orderBy("url").select(F.substr(quoted, F.lit(2), F.length(quoted) - 2).alias("value")), path)
    return urls.read_inventory(readers.read_urls(spark, path))


@query("select * from (values ('latest', 'c-2024.json'), ('first', 'b-2023.json'), ('png', '2'), ('png', '1'), ('direct', '1'), ('none', '0')) as t(what, value)")
def source_listing(spark, d):
    """Names of files, the last of them, the first that exists, counts of screenshots."""
    folder = scratch(spark, "listing")
    for name in ("a-2022.json", "b-2023.json", "c-2024.json", "shots/1.png", "shots/deep/2.png"):
        sinks.write_text(spark, f"{folder}/{name}", name)
    named = readers.listing(spark, folder, "*.json")
    base = lambda p: p.rpartition("/")[2]
    shots = readers.captures(spark, f"{folder}/shots").select(F.lit("png").alias("what"), F.regexp_extract("path", r"(\d)\.png$", 1).alias("value"))
    first = readers.first_that_exists(spark, f"{folder}/merged.json", f"{folder}/b-2023.json")
    facts = [("latest", base(readers.latest(named, "name"))), ("first", base(first)), ("direct", str(readers.count_png(spark, f"{folder}/shots"))), ("none", str(readers.count_png(spark, f"{folder}/missing")))]
    return shots.unionByName(spark.createDataFrame(facts, "what string, value string"))


@query(f"with {_MERGED} select count(*) as merged, count(distinct pageUrl) as pages from merged")
def source_object(spark, d):
    """An object that is written, read safely and taken apart; a missing and a broken file give no row."""
    path = scratch(spark, "object")
    sinks.write_object(_merged(spark, d).agg(F.count("*").alias("merged"), F.count_distinct("pageUrl").alias("pages")), path + "/a.json")
    sinks.write_text(spark, path + "/b.json", '{"merged": ')
    found = readers.read_object(spark, path + "/a.json").union(readers.read_object(spark, path + "/b.json")).union(readers.read_object(spark, path + "/c.json"))
    return found.select(F.get_json_object("text", "$.merged").cast("long").alias("merged"), F.get_json_object("text", "$.pages").cast("long").alias("pages"))


# Sinks: read back


@query(f"with {_MERGED} select id, pageUrl, source, engine, impact, selector, resultadoActual from merged")
def sink_json_array(spark, d):
    """K1: one file with one array."""
    path = scratch(spark, "merged") + ".json"
    sinks.write_json_array(_merged(spark, d), path)
    names = ["id", "pageUrl", "source", "engine", "impact", "selector", "resultadoActual"]
    found = arrays.array_elements(spark, path).select(F.from_json("item", ", ".join(f"{n} string" for n in names)).alias("r"))
    return found.select(*(f"r.{n}" for n in names))


@query(f"with {_MERGED} select engine, source, id, pageUrl, selector from merged where engine in ('axe-core', 'pa11y')")
def sink_by_engine(spark, d):
    """A folder for each engine."""
    path = scratch(spark, "engines")
    sinks.write_by_engine(_merged(spark, d).drop("_ord"), path)
    return spark.read.json(path).select("engine", "source", "id", "pageUrl", "selector")


@query(f"""with {_MERGED} select engine as "Motor", pageUrl as "Página analizada", selector as "Selector", id as "ID", impact as "Impacto / Severidad", wcag as "Criterio WCAG", context as "Contexto" from merged""")
def sink_csv(spark, d):
    """K3: quoted, separated by semicolons."""
    path = scratch(spark, "csv")
    sinks.write_csv(sinks.csv_rows(_merged(spark, d)), path)
    back = spark.read.options(**(sinks.CSV_OPTIONS | {"emptyValue": ""})).csv(path)
    return back.select("Motor", "Página analizada", "Selector", "ID", "Impacto / Severidad", "Criterio WCAG", "Contexto")


@query(f'with {_GROUPS} select id, pageUrl, engine, source, impact, wcag, selectors, instances::integer as instances from firsts')
def sink_grouped_csv(spark, d):
    """K4: grouped findings with their selectors in a column."""
    path = scratch(spark, "csv")
    used = _merged(spark, d).select("_ord", "id", "pageUrl", "engine", "source", "impact", "wcag", "selector", "context")
    sinks.write_csv(sinks.grouped_csv_rows(dedup.grouped(used)), path)
    back = spark.read.options(**(sinks.CSV_OPTIONS | {"emptyValue": ""})).csv(path)
    return back.withColumn("instances", F.col("instances").cast("int"))


@query(f"""with {_MERGED}, s as (select *, {'case ' + ' '.join(f"when severity like '%{k}%' then '{v}'" for k, v in (('crit', 'critical'), ('serious', 'serious'), ('moderate', 'moderate'), ('minor', 'minor'))) + ' else severity end'} as sev from merged)
    select 'severidad' as sheet, sev as value, count(*) as n from s group by 2 union all select 'origen', source, count(*) from s group by 2 union all select 'motor', engine, count(*) from s group by 2
    union all select 'nivel', nivel, count(*) from s group by 2 union all select 'principio', case principio when '' then 'sin_dato' else principio end, count(*) from s group by 2
    union all select 'resumen', 'hallazgos', count(*) from s union all select 'resumen', 'paginas', count(distinct pageUrl) from s""")
def sink_summary(spark, d):
    """K5 to K8: the rows of the summary sheet, which the Markdown and HTML summaries show as well."""
    return sinks.summary_rows(_merged(spark, d))


@query(f"with {_RAW} select event_id, twice from (select _ord as event_id, unnest([1, 2]) as twice from raw) as t")
def sink_append(spark, d):
    """What is there stays."""
    path = scratch(spark, "append")
    for k in (1, 2):
        sinks.append(bind.raw(spark, d).select(F.col("_ord").alias("event_id"), F.lit(k).alias("twice")), path)
    return spark.read.json(path).select("event_id", F.col("twice").cast("int").alias("twice"))


@query(f"""with {_NESTED}, g as (select count(*) as total, count(*) filter (impact = 'critical') as critical, count(*) filter (impact = 'serious') as serious from nested where source = 'sitemap'),
    t as (select '## Quality gate' || chr(10) || chr(10) || '| total | critical | serious | verdict |' || chr(10) || '|---|---|---|---|' || chr(10) || '| ' || total::varchar || ' | ' || critical::varchar || ' | ' || serious::varchar || ' | '
        || case when critical <= 0 and serious <= 5 then 'PASSED' else 'FAILED' end || ' |' as text from g)
    select '# CI' || chr(10) || text as text from t""")
def sink_ci_markdown(spark, d):
    """Text that is added to a run's summary."""
    path = scratch(spark, "summary") + ".md"
    sinks.append_text(spark, path, "# CI\n")
    sinks.append_text(spark, path, sinks.gate_markdown(gates.quality_gate(metrics.nested_counts(bind.nested_pages(spark, d)))))
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\n$", "").alias("text"))


@query(f"with {_MERGED} select impact as value, count(*) as n, true as shown from merged group by impact")
def sink_dashboard(spark, d):
    """The dashboard in its dated folder; every count stands in it."""
    folder = scratch(spark, "dashboard")
    m = settled(_merged(spark, d).select("impact", "engine"), "merged")
    sinks.write_text(spark, f"{folder}/dashboard.html", sinks.dashboard(m))
    (copy,) = sinks.dated_copy(spark, [f"{folder}/dashboard.html"], f"{folder}/public", "2024-01-31")
    page = spark.read.text(copy, wholetext=True)
    rows = metrics.histogram(m).select("value", "n")
    shown = F.col("page").contains(F.concat(F.lit("<td>"), F.col("value"), F.lit("</td><td>"), F.col("n").cast("string"), F.lit("</td>")))
    return rows.join(F.broadcast(page.select(F.col("value").alias("page")))).select("value", "n", shown.alias("shown"))  # one row


# Crawls

_SITE = """site as (select page_id, html, 'https://site.example' || coalesce(l[(page_id % greatest(len(l), 1)) + 1], '/') as url from
        (select page_id, html, regexp_extract_all(html, '<a[^>]+href="([^"]+)"', 1) as l from pages) as p),
    nodes as (select *, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') as node from site),
    stored as (select * from nodes where page_id in (select min(page_id) from nodes group by node)),
    hrefs as (select node as src, unnest(regexp_extract_all(html, '<a[^>]+href="([^"]+)"', 1)) as href from nodes),
    e as (select distinct src, regexp_replace(regexp_replace('https://site.example' || href, '[?#].*$', ''), '/$', '') as dst from hrefs where href like '/%'),
    edges as (select * from e where not regexp_matches(dst, '\\.(""" + urls.NOT_PAGES["crawl"] + """)$', 'i')),
    walk(node, depth) as (select (select node from stored order by page_id limit 1), 0
        union select edges.dst, walk.depth + 1 from walk join edges on edges.src = walk.node where walk.depth < 5{keep}),
    seen as (select node, min(depth)::integer as depth from walk group by node{limit})"""
_TITLE = "coalesce(nullif(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')), ''), '(sin título)')"
_ACTIVE = r"""regexp_matches(html, '<(form|input|button|select|textarea|dialog|video|audio|iframe|details)\b|role=["'']?(button|dialog|tab|menu)|aria-(expanded|haspopup)=', 'i')"""
_CRAWLED = f"""crawled as (select s.node as url, s.depth, case when p.node is null then '{linkgraph.FAILED}' else {_TITLE} end as title,
        p.node is not null as ok, coalesce({_ACTIVE}, false) as interactive from seen as s left join stored as p on p.node = s.node)"""


def _crawl(spark, d, **options):
    pages = bind.site(spark, d)
    return linkgraph.crawl(pages, pages.orderBy("page_id").limit(1).select("url"), **options)


@query(f"with recursive {_SITE.format(keep='', limit='')}, {_CRAWLED} select * from crawled")
def crawl_pages(spark, d):
    """Breadth first, with the pages that could not be loaded, and their classes."""
    return _crawl(spark, d)


@query(f"with recursive {_SITE.format(keep='', limit='')}, {_CRAWLED} select url, depth, title from crawled where ok")
def crawl_static(spark, d):
    """Pages that could not be loaded are left out."""
    return _crawl(spark, d, failed=False).select("url", "depth", "title")


@query(f"with recursive {_SITE.format(keep='', limit=' order by depth, node limit 80')}, {_CRAWLED} select depth, url, title, case when ok then 'OK' else 'ERROR' end as result from crawled")
def crawl_capped(spark, d):
    """The log of a crawl that stops at 80 addresses."""
    return sinks.crawl_log(_crawl(spark, d, max_urls=80))


@query(f"with recursive {_SITE.format(keep='', limit='')}, {_CRAWLED} select count(*) as pages, count(*) filter (not ok) as errors, count(*) filter (ok and interactive) as interactive, count(*) filter (ok and not interactive) as static, max(depth) as depth from crawled")
def crawl_counts(spark, d):
    """A crawl's counters."""
    return linkgraph.crawl_counters(_crawl(spark, d))


_IN_THE = " and (contains(edges.dst, '/The/') or edges.dst like '%/The')"


@query(f"with recursive {_SITE.format(keep=_IN_THE, limit='')}, {_CRAWLED} select url, depth, ok from crawled")
def crawl_language(spark, d):
    """Only addresses that contain the language's part."""
    return _crawl(spark, d, lang="The").select("url", "depth", "ok")


@query("select page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://[^/?#]+')) || regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '[?#].*$', ''), '/$', ''), '/$', '') as url from pages")
def crawl_address(spark, d):
    """Addresses as crawls compare them."""
    return table(spark, d, "pages").select("page_id", urls.crawl_url(F.col("url")).alias("url"))


_BASES = "('https://a.example/x/y/z.html?q=1#f'), ('http://B.example'), ('https://a.example/x/')"
_HREFS = "('w'), ('./w'), ('../w'), ('../../../w'), ('/r/./s/../t'), ('?p=2'), ('#g'), ('//c.example/k'), ('HTTPS://d.example/'), ('mailto:x@y.example'), ('v/..'), ('')"
_RESOLVED = [
    ["https://a.example/x/y/w", "https://a.example/x/y/w", "https://a.example/x/w", "https://a.example/w", "https://a.example/r/t", "https://a.example/x/y/z.html?p=2", "https://a.example/x/y/z.html?q=1#g", "https://c.example/k", "httpS://d.example/", None, "https://a.example/x/y/", "https://a.example/x/y/z.html?q=1"],
    ["http://b.example/w", "http://b.example/w", "http://b.example/w", "http://b.example/w", "http://b.example/r/t", "http://b.example?p=2", "http://b.example#g", "http://c.example/k", "httpS://d.example/", None, "http://b.example/", "http://b.example"],
    ["https://a.example/x/w", "https://a.example/x/w", "https://a.example/w", "https://a.example/w", "https://a.example/r/t", "https://a.example/x/?p=2", "https://a.example/x/#g", "https://c.example/k", "httpS://d.example/", None, "https://a.example/x/", "https://a.example/x/"],
]


def _tuples(text: str) -> list[str]:
    return [x.strip("('") for x in text.removesuffix("')").split("'), ")]


@query("select * from (values " + ", ".join(f"('{b}', '{h}', {'null' if r is None else repr(r)})" for b, row in zip(_tuples(_BASES), _RESOLVED, strict=True) for h, r in zip(_tuples(_HREFS), row, strict=True)) + ") as t(base, href, found)")
def link_resolution(spark, d):
    """Links of every kind against pages of every kind."""
    both = spark.createDataFrame([(b, h) for b in _tuples(_BASES) for h in _tuples(_HREFS)], "base string, href string")
    return both.withColumn("found", urls.resolve(F.col("base"), F.col("href")))


# Predicates and fields


@query("""select page_id, url like 'https://%' and not regexp_matches(url, '\\.(""" + urls.NOT_PAGES["crawl"] + """)$', 'i') and not contains(url, 'mailto:') and not contains(url, '#') as visits,
    url like 'https://%' and not contains(url, '#') and not contains(url, '?') and not regexp_matches(url, '\\.(""" + urls.NOT_PAGES["smart"] + """)$', 'i') as plain,
    regexp_matches(url, 'example\\.(net|org)|/en/') and not regexp_matches(url, 'utm_|blog') as listed, contains(url, '/en/') or url like '%/en' as english, regexp_matches(url, '^https?://') as address from pages""")
def url_predicates(spark, d):
    """F5, F7, F9, F10, F17."""
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id",
        urls.should_visit(u, "https://").alias("visits"),
        urls.is_plain_link(u, "https://").alias("plain"),
        urls.matches_lists(u, [r"example\.(net|org)", "/en/"], ["utm_", "blog"]).alias("listed"),
        linkgraph.contains_language(u, "en").alias("english"),
        urls.is_address(u).alias("address"),
    )


@query(f"""with {_NESTED}, p as (select distinct url from nested) select count(*) as pages, count(*) filter (hash_ok) as valid from (select url, cast(regexp_extract(url, 'u(\\d+)$', 1) as integer) % 3 <> 0 as hash_ok from p) as q""")
def nested_valid_pages(spark, d):
    """nested pages without a list of violations are no pages."""
    pages = bind.nested_pages(spark, d).withColumn("user", F.regexp_extract("url", r"u(\d+)$", 1).cast("int"))
    pages = pages.withColumn("violations", F.when(F.col("user") % 3 != 0, F.col("violations")))
    return pages.agg(F.count("*").alias("pages")).join(metrics.valid_pages(pages).agg(F.count("*").alias("valid")))  # one row each


@query(f"""with {_RAW} select _ord, contains(selector, '#k1') or contains(context, 'nav') as named from raw""")
def repeated_elements(spark, d):
    """elements that every page repeats, told by parts of their names."""
    r = bind.raw(spark, d)
    return r.select("_ord", (js.contains_any(F.col("selector"), ["#k1"]) | js.contains_any(F.col("context"), dedup.REPEATED)).alias("named"))


@query(f"""with {_RAW}, c as (select case when impact = 'notice' then 'sin clasificar' else impact end as value, count(*) as n from raw group by 1) select value, n, sum(n) over ()::bigint as total from c""")
def impact_histogram(spark, d):
    """Absent impacts under a label, and the total."""
    return metrics.histogram(bind.raw(spark, d).withColumn("impact", F.nullif(F.col("impact"), F.lit("notice"))))


@query(f"with {_RAW} select count(*) as total, " + ", ".join(f"count(*) filter (impact = '{s}') as {s}" for s in metrics.SEVERITIES) + " from raw")
def impact_counts(spark, d):
    """Exact matches only."""
    return metrics.exact_counts(bind.raw(spark, d))


@query(f"with {_NESTED} select count(distinct url) as pages, count(*) filter (source = 'sitemap' or (source = 'interactiva' and coalesce(engine, '') = 'pa11y')) as issues from nested")
def issues_total(spark, d):
    """Issue lists of two engines, one behind the other, and how many there are."""
    pages = bind.nested_pages(spark, d).select(F.col("url").alias("page"), "pa11y", F.col("violations").alias("axe"))
    return metrics.issues_total(normalize.multi_engine(pages))


@query(f"with {_RAW} select count(*) filter (_ord % 3 <> 0 and _ord % 7 <> 0) as captured, count(*) filter (_ord % 3 = 0) as skipped, count(*) filter (_ord % 3 <> 0 and _ord % 7 = 0) as errors from raw")
def capture_counts(spark, d):
    """Screenshots made, left out and failed."""
    k = F.col("_ord")
    return captures.capture_counters(bind.raw(spark, d).select((k % 3 != 0).alias("captured"), (k % 7 == 0).alias("error")))


@query(f"""with {_RAW} select coalesce(nullif(id, ''), 'manual-check') as id, impact, pageUrl as page, selector from raw
    where source in ('sitemap', 'interactiva') and (impact in ('needs-review', 'manual', 'incomplete') or regexp_matches(description, 'manual|revisión', 'i'))""")
def review_candidates(spark, d):
    """Candidates of both audits."""
    r = bind.raw(spark, d)
    return gates.review_candidates(r.where("source = 'sitemap'"), r.where("source = 'interactiva'")).select("id", "impact", "page", "selector")


@query(f"""with {_RAW} select distinct rule from (select id as rule from raw where _ord % 4 = 0 union all select 'r' || (_ord % 50)::varchar from raw where _ord % 4 = 1 union all
    select 'c' || (_ord % 40)::varchar from raw where _ord % 4 = 2 union all select 'v' || (_ord % 30)::varchar from raw union all select 't' || (_ord % 20)::varchar from raw) as t where rule <> ''""")
def rule_extraction(spark, d):
    """Rules wherever payloads carry them."""
    k = F.col("_ord")
    name = lambda letter, n: F.concat(F.lit(letter), (k % n).cast("string"))
    none = F.lit(None).cast("string")
    rows = bind.raw(spark, d).select(
        F.when(k % 4 == 0, F.col("id")).alias("id"),
        F.when(k % 4 == 1, name("r", 50)).alias("ruleId"),
        F.when(k % 4 == 2, name("c", 40)).alias("code"),
        F.array(F.struct(F.lit("").alias("id"), name("v", 30).alias("ruleId"))).alias("violations"),
        F.array(F.struct(none.alias("code"), name("t", 20).alias("type"))).alias("results"),
    )
    return rules.extract_rules(rows)


@query(f"""with {_RAW}, shots as (select distinct 'capturas/' || (user_id % 4)::varchar || '-' || {_SLUG} || '.png' as path from raw where user_id % 5 = 0),
    hits as (select s.slug, min(path) as path from (select distinct {_SLUG} as slug from raw) as s join shots on contains(shots.path, s.slug) group by s.slug)
    select _ord, case when _ord % 6 = 0 then 'own.png' else coalesce(h.path, '—') end as capturePath from raw left join hits as h on h.slug = {_SLUG}""")
def sheet_captures(spark, d):
    """The screenshot given, else the first that fits, else a dash."""
    r = bind.raw(spark, d)
    user = F.regexp_extract("pageUrl", "/p([0-9]+)/", 1).cast("int")
    path = F.concat(F.lit("capturas/"), (user % 4).cast("string"), F.lit("-"), js.slug_capture(F.col("pageUrl")), F.lit(".png"))
    shots = r.where(user % 5 == 0).select(path.alias("path")).distinct().withColumn("pos", F.col("path"))
    given = r.select("_ord", "pageUrl", F.when(F.col("_ord") % 6 == 0, "own.png").alias("capturePath"))
    return captures.sheet_captures(given, shots).select("_ord", "capturePath")


@query("select distinct n_name as file from nation where n_nationkey % 3 <> 0")
def missing_files(spark, d):
    """Files that are required and not there."""
    names = table(spark, d, "nation").select(F.col("n_name").alias("file"), "n_nationkey")
    return gates.missing_specs(names.select("file"), names.where("n_nationkey % 3 = 0").select("file"))


@query(f"""with {_RAW} select _ord, case when contains(f, 'interactiva') then 'interactiva' else 'sitemap' end as origen, coalesce(nullif(regexp_extract(c, 'WCAG\\d+\\.\\d+'), ''), 'N/A') as wcag,
    coalesce(nullif(regexp_extract(c, 'WCAG\\d+\\.[0-9.]+'), ''), 'N/A') as wcag_loose, regexp_replace(i, '^(.*?)n/a', '\\1moderate') as severity,
    case when engine is null then 'desconocido' else engine end as engine, case impact when 'notice' then 'sin severidad' else impact end as impact
    from (select *, case _ord % 2 when 0 then 'x-interactiva.json' else 'x.json' end as f, case _ord % 3 when 0 then 'WCAG21.1.4.3.F' when 1 then 'WCAG2AA.Principle1' end as c,
        case _ord % 4 when 0 then 'n/a' when 1 then 'xn/an/a' else 'minor' end as i from raw) as r""")
def field_rules(spark, d):
    """Fields told from names and codes, and labels of absent ones."""
    k = F.col("_ord")
    code = js.first_match([(k % 3 == 0, "WCAG21.1.4.3.F"), (k % 3 == 1, "WCAG2AA.Principle1")], F.lit(None).cast("string"))
    return bind.raw(spark, d).select(
        "_ord",
        normalize.origin_of_file(F.when(k % 2 == 0, "x-interactiva.json").otherwise("x.json")).alias("origen"),
        normalize.wcag_of_code(code).alias("wcag"),
        normalize.wcag_of_code(code, loose=True).alias("wcag_loose"),
        normalize.severity_of_impact(js.first_match([(k % 4 == 0, "n/a"), (k % 4 == 1, "xn/an/a")], F.lit("minor"))).alias("severity"),
        js.js_or(F.col("engine"), "desconocido").alias("engine"),
        js.js_or(F.nullif(F.col("impact"), F.lit("notice")), "sin severidad").alias("impact"),
    )


@query(f"""with {_RAW} select _ord, id, case impact when 'notice' then 'unknown' else impact end as impact, selector, pageUrl, 2 as nodes, case when _ord % 2 = 0 then 'wcag2a' else 'N/A' end as wcag_tag from raw""")
def axe_rows(spark, d):
    """Nested violations as rows, with what stands first in their lists."""
    r = bind.raw(spark, d)
    node = lambda c: F.struct(F.array(c).alias("target"))
    tags = F.when(F.col("_ord") % 2 == 0, F.array(F.lit("cat.color"), F.lit("wcag2a"), F.lit("wcag111"))).otherwise(F.array(F.lit("best-practice")))
    violation = F.struct(
        "id", F.nullif(F.col("impact"), F.lit("notice")).alias("impact"), "description", F.lit("").alias("helpUrl"), F.array(node(F.col("selector")), node(F.lit("body"))).alias("nodes"), tags.alias("tags")
    )
    pages = r.select("_ord", F.col("pageUrl").alias("url"), F.array(violation).alias("violations"))
    rows = normalize.flat_axe(pages.withColumn("url", F.concat(F.col("_ord").cast("string"), F.lit(" "), F.col("url"))))
    return rows.select(F.split("pageUrl", " ")[0].cast("long").alias("_ord"), "id", "impact", "selector", F.split("pageUrl", " ")[1].alias("pageUrl"), "nodes", "wcag_tag")


@query(f"with {_DIMS}, {_RAW}, asked as (select id as rule from raw), {_RESOLVE} select rule, criterio || ' (' || nivel || ')' as label from resolved")
def criterion_labels(spark, d):
    """P20."""
    found = lookup.resolve(bind.raw(spark, d), "id")
    return found.select("rule", lookup.label(F.col("criterio"), F.col("nivel")).alias("label"))


@query("select page_id, (row_number() over (partition by page_id % 7 order by page_id))::integer as index from pages")
def page_index(spark, d):
    """Running numbers."""
    return dedup.numbered(table(spark, d, "pages").withColumn("k", F.col("page_id") % 7), "page_id", ["k"]).select("page_id", "index")


@query("""select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((extract(millisecond from ts) % 1000)::varchar, 3, '0') || 'Z' as iso,
    extract(day from ts)::varchar || '/' || extract(month from ts)::varchar || '/' || extract(year from ts)::varchar || ', ' || extract(hour from ts)::varchar || strftime(ts, ':%M:%S') as local, 90.0::double as took,
    coalesce(try_cast(regexp_extract(case event_id % 3 when 0 then '12px' when 1 then 'none' else ' -7' end, '^\\s*([+-]?\\d+)', 1) as integer), 5) as number from events""")
def stamps(spark, d):
    """Dates as text, elapsed time, whole numbers with a default."""
    ts, k = F.col("ts"), F.col("event_id")
    text = js.first_match([(k % 3 == 0, "12px"), (k % 3 == 1, "none")], F.lit(" -7"))
    return table(spark, d, "events").select(
        "event_id",
        js.day_stamp(ts).alias("day"),
        js.iso_stamp(ts).alias("iso"),
        js.local_stamp(ts).alias("local"),
        js.elapsed(ts, ts + F.expr("interval 90 seconds")).alias("took"),
        js.int_or(text, 5).alias("number"),
    )


@query("""select lang, count(*) as n, lower(string_split(regexp_replace(lang || '_XX.UTF-8', '[-_.]', '_', 'g'), '_')[1]) as code from documents group by lang""")
def locale_codes(spark, d):
    """X10."""
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return rows.withColumn("code", js.language_of_locale(F.concat("lang", F.lit("_XX.UTF-8"))))


@query(f"""with {_RAW}, c as (select pageUrl, impact, count(*)::bigint as n from raw group by 1, 2), w as (select * from c union all select distinct pageUrl, 'minor', -1 from c where false)
    select pageUrl, string_agg(impact, ',' order by impact) as keys, sum(n)::bigint as total, coalesce(max(n) filter (impact = 'minor'), 0) + 1000 as minor from w group by pageUrl""")
def map_fields(spark, d):
    """Keys, values and entries of maps, and maps that take over others' entries."""
    counts = bind.raw(spark, d).groupBy("pageUrl", "impact").agg(F.count("*").alias("n"))
    m = counts.groupBy("pageUrl").agg(F.map_from_entries(F.collect_list(F.struct("impact", "n"))).alias("m"))  # as many entries as impacts
    other = F.create_map(F.lit("minor"), F.coalesce(F.col("m")["minor"], F.lit(0)).cast("long") + 1000)
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select("pageUrl", F.array_join(F.sort_array(F.map_keys("m")), ",").alias("keys"), total.alias("total"), js.with_entries(F.col("m"), other)["minor"].alias("minor"))


@query("""select page_id, array_to_string(list_transform(regexp_extract_all(html, '<h2[^>]*>(.*?)</h2>', 1, 'is'), lambda x: regexp_replace(x, '<[^>]+>', '', 'g')), '|') as headings from pages""")
def page_headings(spark, d):
    """Second-level headings, tags stripped."""
    return table(spark, d, "pages").select("page_id", F.array_join(linkgraph.headings(F.coalesce("html", F.lit(""))), "|").alias("headings"))


@query(f"""with {_NESTED}, o as (select *, case when origen = 'interactiva' then 'interactiva' else 'sitemap' end as oo from nested),
    g as (select oo as origen, count(distinct url) as urls, count(*) filter (source = 'sitemap') as total, {_SEV4} from o group by oo) select origen, total from g""")
def gate_by_origin(spark, d):
    """The gate's rows by origin alone."""
    return metrics.nested_counts(bind.nested_pages(spark, d)).where("origen != 'global'").select("origen", "total")


