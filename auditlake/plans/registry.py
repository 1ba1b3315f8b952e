"""The registered queries: every operator over the bound tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import dims
from auditlake.functions import js
from auditlake.operators import captures, dedup, gates, linkgraph, lookup, metrics, normalize, rules, urls
from auditlake.sources import bind, sinks
from auditlake.sources.bind import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else _q(v) for v in r) + ")" for r in rows)


def _nth(values: list[str], index: str) -> str:
    return f"case {index} " + " ".join(f"when {k} then {_q(v)}" for k, v in enumerate(values)) + " end"


def _translated(text: str) -> str:
    for phrase, wording in normalize.PHRASES:
        text = f"regexp_replace({text}, {_q(phrase)}, {_q(wording)}, 'gi')"
    return f"trim({text})"


def _severity(c: str) -> str:
    return (
        f"case when coalesce({c}, '') = '' then 'unclassified' when contains(lower({c}), 'crit') then 'critical' "
        f"when contains(lower({c}), 'serious') or contains(lower({c}), 'high') then 'serious' "
        f"when contains(lower({c}), 'moderate') or contains(lower({c}), 'medium') then 'moderate' "
        f"when contains(lower({c}), 'minor') or contains(lower({c}), 'low') then 'minor' else lower({c}) end"
    )


_BANDS = "case " + " ".join(f"when ix >= {low} then {_q(name)}" for low, name in dims.BANDS) + f" else {_q(dims.NO_BAND)} end"
_CRIT = f"crit(criterion, ordinal, principio, nivel, criterio, esperado, resumen, url) as (values {_values(dims.criteria_rows())})"
_EQ = f"eq(rule, criterion) as (values {_values(dims.equivalence_rows())})"
_RAW = f"""raw as (
    select event_id as _ord, {_nth(["sitemap", "interactiva", "manual"], "event_id % 3")} as source,
        case when event_id % 5 = 0 then null else {_nth(["axe-core", "pa11y"], "event_id % 2")} end as engine,
        {_nth(bind.RULES, "k % 12")} as id,
        case event_type {" ".join(f"when '{t}' then '{i}'" for t, i in bind.IMPACTS.items())} else 'notice' end as impact,
        {_nth(bind.TEXTS, "k % 5")} as description,
        'https://site' || (user_id % 7)::varchar || '.example/es/p' || user_id::varchar || '/w' || floor((day(ts) - 1) / 7)::integer::varchar as pageUrl,
        user_id, '#k' || k::varchar as selector, '<i>' || k::varchar || '</i>' as context
    from (select *, cast(json_extract_string(props, '$.k') as integer) as k from events) as e)"""
_RESOLVE = f"""ids as (select rule, trim(replace(regexp_replace(regexp_replace(lower(rule), '^wcag\\d{{2}}-|^axe-|^rule-', ''), '^best-practice-', ''), '_', '-')) as normalized
        from (select distinct rule from asked where rule <> '') as a),
    keys as (select i.rule, i.normalized, c1.criterion as k1, c2.criterion as k2,
            (select arg_min(c.criterion, c.ordinal) from crit as c where contains(i.normalized, c.criterion)) as k3,
            case {" ".join(f"when contains(i.normalized, '{w}') then '{c}'" for w, c in dims.KEYWORDS)} end as k4
        from ids as i left join eq on eq.rule = i.normalized left join crit as c1 on c1.criterion = eq.criterion left join crit as c2 on c2.criterion = i.rule),
    resolved as (select k.rule, k.normalized, case when contains(k.rule, 'wcag2') then 'pa11y' else 'axe-core' end as lookup_engine,
            case when k1 is not null then 1 when k2 is not null then 2 when k3 is not null then 3 when k4 is not null then 4 else 0 end as tier,
            coalesce(k1, k2, k3, k4) as criterion, coalesce(c.principio, {_q(dims.DEFAULT["principio"])}) as principio, coalesce(c.nivel, {_q(dims.DEFAULT["nivel"])}) as nivel,
            coalesce(c.criterio, {_q(dims.DEFAULT["criterio"])}) as criterio, coalesce(c.esperado, {_q(dims.DEFAULT["esperado"])}) as esperado,
            coalesce(c.resumen, 'Regla sin correspondencia directa (' || k.rule || ').') as resumen, coalesce(c.url, {_q(dims.DEFAULT["url"])}) as url
        from keys as k left join crit as c on c.criterion = coalesce(k1, k2, k3, k4))"""
_DIMS = f"{_CRIT}, {_EQ}"
_FINDINGS = f"""{_DIMS}, {_RAW}, asked as (select id as rule from raw), {_RESOLVE},
    texts as (select *, {_translated("description")} as said from raw),
    findings as (select t._ord,
            coalesce(nullif(t.id, ''), t.source || '-' || substr(to_base64(encode(t.pageUrl || t.selector)), 1, 10)) as id,
            t.pageUrl, '(sin título)' as pageTitle, t.source,
            coalesce(t.engine, case when t.source = 'interactiva' then 'pa11y' else 'axe-core' end) as engine,
            t.impact, t.impact as severity, coalesce(r.criterio, 'Desconocido') as wcag, coalesce(r.nivel, 'AA') as nivel, coalesce(r.principio, '') as principio,
            coalesce(r.resumen, t.said) as resumen, coalesce(nullif(t.said, ''), 'Sin descripción disponible') as resultadoActual,
            coalesce(r.resumen, {_q(dims.DEFAULT["esperado"])}) as resultadoEsperado,
            case when r.url <> '' then 'Ver recomendación W3C: ' || r.url else 'Revisión manual requerida' end as recomendacionW3C,
            t.selector, t.context, '' as helpUrl
        from texts as t left join resolved as r on r.rule = t.id)"""
_MERGED = f"""{_FINDINGS}, merged as (select * exclude (rn) from (select *, row_number() over
        (partition by pageUrl, selector, wcag, resultadoActual, source order by _ord) as rn from findings) as f where rn = 1)"""
_GROUPS = f"""{_MERGED}, groups as (select id || '::' || pageUrl as group_key, min(_ord) as _ord, count(*) as instances,
        string_agg(selector, ' | ' order by _ord, selector) as selectors from merged group by id || '::' || pageUrl),
    firsts as (select g.group_key, g.instances, g.selectors, m.* from groups as g join merged as m on m._ord = g._ord)"""
_INDEX = """select findings, pages, penalty10, ix as conformance, {bands} as level from (
        select *, cast(round(greatest(0, 100 - cast(penalty10 as decimal(18,0)) / (greatest(pages, 1) * 10)), 1) as double) as ix from ({inner}) as i) as j"""
_NESTED = f"""{_RAW}, nested as (select 'https://site.example/u' || user_id::varchar as url,
        case user_id % 3 when 0 then 'interactiva' when 1 then 'sitemap' end as origen, source, engine, nullif(impact, 'notice') as impact from raw)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return dedup.merge_dedup(bind.findings(spark, d))


def _weights(c: str, weights: dict[str, int]) -> str:
    return f"sum(case {c} " + " ".join(f"when '{k}' then {w}" for k, w in weights.items()) + f" else {dims.OTHER_WEIGHT} end)::bigint"


@query(f"with {_MERGED}, s as (select *, {_severity('severity')} as sev from merged) " + _INDEX.format(bands=_BANDS, inner=f"select count(*) as findings, count(distinct pageUrl) as pages, {_weights('sev', dims.WEIGHTS)} as penalty10 from s"))
def conformance_index(spark, d):
    return metrics.conformance_index(_merged(spark, d))


@query(f"with {_GROUPS} " + _INDEX.format(bands=_BANDS, inner=f"select count(*) as findings, count(distinct pageUrl) as pages, {_weights('impact', dims.METADATA_WEIGHTS)} as penalty10 from firsts"))
def conformance_metadata(spark, d):
    return metrics.conformance_metadata(dedup.grouped(_merged(spark, d)))


@query(f"""with {_MERGED}, s as (select {_severity('severity')} as severity, count(*) as n from merged group by 1)
    select severity, n, cast(round(n * 100.0 / sum(n) over (), 1) as decimal(20,1))::varchar || '%' as pct from s""")
def severity_share(spark, d):
    return metrics.severity_share(_merged(spark, d))


@query(f"""with {_MERGED} select source, engine, count(*) as total, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'serious') as serious,
    count(*) filter (severity = 'moderate') as moderate, count(*) filter (severity = 'minor') as minor from merged group by source, engine""")
def count_by_source_engine(spark, d):
    return metrics.count_by_source_engine(_merged(spark, d))


@query(f"""with {_MERGED} select 'engine' as field, engine as value, count(*) as n from merged group by 2
    union all select 'impact', impact, count(*) from merged group by 2 union all select 'nivel', nivel, count(*) from merged group by 2
    union all select 'principio', case principio when '' then 'sin_dato' else principio end, count(*) from merged group by 2""")
def count_by_field(spark, d):
    return metrics.count_by_fields(_merged(spark, d), ["engine", "impact", "nivel", "principio"])


@query(f"with {_RAW} select count(distinct coalesce(pageUrl, '')) as pages, count(distinct selector) as selectors from raw")
def distinct_pages(spark, d):
    return bind.raw(spark, d).agg(metrics.page_count("pageUrl").alias("pages"), metrics.page_count_raw("selector").alias("selectors"))


_TOP = "select value, n from (select {c} as value, count(*) as n, min(_ord) as f from merged group by 1 order by n desc, f limit 10) as t"


@query(f"with {_MERGED} " + _TOP.format(c="pageUrl"))
def top_pages(spark, d):
    return metrics.top(_merged(spark, d), "pageUrl")


@query(f"with {_MERGED} " + _TOP.format(c="wcag"))
def top_criteria(spark, d):
    return metrics.top(_merged(spark, d), "wcag")


@query(f"""with {_RAW} select _ord, impact, case impact when 'critical' then 0 when 'serious' then 1 when 'moderate' then 2 when 'minor' then 3 else 99 end as sev_rank from raw""")
def severity_sorted_findings(spark, d):
    r = bind.raw(spark, d).withColumn("severity", F.col("impact"))
    return metrics.by_severity(r).select("_ord", "impact", metrics.severity_rank(F.col("impact")).alias("sev_rank"))


@query(f"""with {_DIMS}, {_RAW}, asked as (select id as rule from raw union all select criterio from crit union all select rule from eq), {_RESOLVE} select * from resolved""")
def wcag_lookup(spark, d):
    asked = bind.raw(spark, d).select(F.col("id").alias("rule")).union(dims.criteria(spark).select("criterio")).union(dims.equivalences(spark).select("rule"))
    return lookup.resolve(asked)


@query(f"with {_FINDINGS} select * from findings")
def findings_canonical(spark, d):
    return bind.findings(spark, d)


@query(f"with {_MERGED} select * from merged")
def merge_dedup(spark, d):
    return _merged(spark, d)


@query(f"""with {_RAW} select _ord from (select _ord, row_number() over (partition by concat_ws('-', coalesce(engine, 'undefined'), id, pageUrl, selector) order by _ord) as rn from raw) as r where rn = 1""")
def audit_dedup(spark, d):
    return dedup.audit_dedup(bind.raw(spark, d)).select("_ord")


@query(f"with {_GROUPS} select group_key, _ord, impact, wcag, instances, selectors from firsts")
def metadata_groups(spark, d):
    g = dedup.grouped(_merged(spark, d))
    joined = F.array_join(F.transform("instances", lambda x: x["selector"]), " | ")
    return g.select("group_key", "_ord", "impact", "wcag", F.size("instances").cast("long").alias("instances"), joined.alias("selectors"))


@query(f"with {_MERGED} select id, count(*) as n from merged group by id having count(*) > 1")
def duplicate_ids(spark, d):
    return dedup.duplicate_ids(_merged(spark, d))


_EMPTY = " + ".join(f"(case when trim({c}) = '' then 1 else 0 end)" for c in ("id", "engine", "source", "pageUrl", "impact", "description"))
_MISSING = "(case when engine is null then 1 else 0 end)"
_SIX = ["id", "engine", "source", "pageUrl", "impact", "description"]


@query(f"with {_RAW} select _ord, {_MISSING} as missing, coalesce({_EMPTY.replace('trim(engine)', 'trim(coalesce(engine, ' + _q('x') + '))')}, 0) as empties from raw")
def missing_empty_fields(spark, d):
    r = gates.defects(bind.raw(spark, d), required=_SIX)
    return r.select("_ord", F.size("missing").alias("missing"), F.size("empties").alias("empties"))


@query(f"""with {_MERGED}, d as (select count(*) as duplicates from (select id from merged group by id having count(*) > 1) as x),
    m as (select 0::bigint as missing, count(*) filter (trim(principio) = '') as empty from merged)
    select missing, empty, duplicates, case when empty > 0 then 'ERROR' when duplicates > 0 then 'WARNING' else 'OK' end as status,
        case when empty > 0 then 2 when duplicates > 0 then 1 else 0 end as exit_code from m, d""")
def metadata_status(spark, d):
    return gates.metadata_verdict(gates.defects(_merged(spark, d), required=[*gates.REQUIRED, "principio"]))


_SEV4 = ", ".join(f"count(*) filter (source = 'sitemap' and impact = '{s}') as {s}" for s in metrics.SEVERITIES)


@query(f"""with {_NESTED}, o as (select *, case when origen = 'interactiva' then 'interactiva' else 'sitemap' end as oo from nested)
    select oo as origen, count(distinct url) as urls, count(*) filter (source = 'sitemap') as total, {_SEV4} from o group by oo
    union all select 'global', count(distinct url), count(*) filter (source = 'sitemap'), {_SEV4} from o""")
def nested_gate_stats(spark, d):
    return metrics.nested_counts(bind.nested_pages(spark, d))


@query(f"""with {_NESTED} select *, critical <= 0 and serious <= 5 as passed, case when critical <= 0 and serious <= 5 then 0 else 1 end as exit_code from (
    select count(*) as total, count(*) filter (impact = 'critical') as critical, count(*) filter (impact = 'serious') as serious from nested where source = 'sitemap') as g""")
def quality_gate(spark, d):
    return gates.quality_gate(metrics.nested_counts(bind.nested_pages(spark, d)))


@query(f"""with {_NESTED}, n as (select * from nested where source = 'sitemap')
    select count(*) filter (origen = 'sitemap') as sitemap, count(*) filter (origen = 'interactiva') as interactiva, count(*) filter (origen is null) as combinado,
        count(*) filter (impact = 'critical') as critical, count(*) filter (impact = 'serious') as serious, count(*) filter (impact = 'moderate') as moderate,
        count(*) filter (impact = 'minor') as minor, count(*) filter (impact is null) as unclassified,
        (select count(*) from nested where source = 'manual') as needs_review,
        (select count(*) from nested where source = 'interactiva' and engine = 'pa11y') as pa11y from n""")
def report_counters(spark, d):
    return metrics.report_counters(bind.nested_pages(spark, d))


@query(f"""with {_MERGED}, f as (select count(*) as merged, count(*) filter (source = 'sitemap') as sitemap, count(*) filter (source = 'interactiva') as interactiva,
        count(*) filter (source = 'sitemap' and engine <> 'axe-core') = 0 and count(*) filter (source = 'sitemap') > 0 as sitemap_only_axe,
        count(*) filter (source = 'interactiva' and engine = 'pa11y') > 0 as interactive_has_pa11y,
        count(*) filter (source = 'sitemap') > 0 and count(*) filter (source = 'interactiva') > 0 as both_sources,
        count(*) filter (engine = 'axe-core') > 0 and count(*) filter (engine = 'pa11y') > 0 as both_engines from merged),
    r as (select (select count(*) from pages) as urls, (select count(*) from raw where source = 'sitemap') as raw_sitemap,
        (select count(*) from raw where source = 'interactiva') as raw_interactiva, (select count(distinct pageUrl) from raw where user_id % 5 = 0) as captures),
    j as (select *, cast(round(merged * 100.0 / (raw_sitemap + raw_interactiva), 1) as double) as coverage from f, r)
    select merged, sitemap, interactiva, sitemap_only_axe, interactive_has_pa11y, both_sources, both_engines, urls, raw_sitemap, raw_interactiva, captures, coverage,
        case when not sitemap_only_axe or not both_sources or not both_engines or urls = 0 or merged = 0 or raw_sitemap + raw_interactiva = 0 then 2 when captures = 0 or coverage < 70 then 1 else 0 end as exit_code,
        case when not sitemap_only_axe or not both_sources or not both_engines or urls = 0 or merged = 0 or raw_sitemap + raw_interactiva = 0 then 'ERROR' when captures = 0 or coverage < 70 then 'WARNING' else 'OK' end as status from j""")
def coverage_verdict(spark, d):
    r = bind.raw(spark, d)
    shots = r.where(F.regexp_extract("pageUrl", "/p([0-9]+)/", 1).cast("int") % 5 == 0).select("pageUrl").distinct()
    counts = metrics.cardinalities(urls=table(spark, d, "pages"), raw_sitemap=r.where("source = 'sitemap'"), raw_interactiva=r.where("source = 'interactiva'"), captures=shots)
    facts = gates.sources_and_engines(_merged(spark, d)).join(counts)  # one row each
    return gates.pipeline_verdict(facts)


@query(f"""with {_RAW} select coalesce(nullif(id, ''), 'manual-check') as id, impact, coalesce(nullif(description, ''), 'Requiere revisión manual según WCAG 2.2.') as description,
    'https://www.w3.org/WAI/WCAG22/quickref/?showtechniques=es' as helpUrl, 'needs_review' as origen, selector, pageUrl as page, id as criterio, 'AA' as nivel
    from raw where impact in ('needs-review', 'manual', 'incomplete') or regexp_matches(description, 'manual|revisión', 'i')""")
def needs_review(spark, d):
    return gates.review_rows(gates.needs_review(bind.raw(spark, d)))


@query(f"""with {_RAW}, p as (select * from raw where engine = 'pa11y'), a as (select * from raw where engine = 'axe-core')
    select _ord, pageUrl, engine from p union all select _ord, pageUrl, engine from a where pageUrl not in (select pageUrl from p)""")
def engine_fallback(spark, d):
    r = bind.raw(spark, d).select("_ord", "pageUrl", "engine", "impact")
    out = gates.engine_fallback(r.where("engine = 'axe-core'"), r.where("engine = 'pa11y'"))
    return out.select("_ord", "pageUrl", "engine")


_SLUG = "substr(regexp_replace(pageUrl, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 60)"


@query(f"""with {_RAW}, shots as (select distinct 'capturas/' || (user_id % 4)::varchar || '-' || {_SLUG} || '.png' as path from raw where user_id % 5 = 0),
    hits as (select s.slug, min(path) as path from (select distinct {_SLUG} as slug from raw) as s join shots on contains(shots.path, s.slug) group by s.slug)
    select _ord, h.path as capturePath from raw left join hits as h on h.slug = {_SLUG}""")
def capture_link(spark, d):
    r = bind.raw(spark, d)
    user = F.regexp_extract("pageUrl", "/p([0-9]+)/", 1).cast("int")
    path = F.concat(F.lit("capturas/"), (user % 4).cast("string"), F.lit("-"), js.slug_capture(F.col("pageUrl")), F.lit(".png"))
    shots = r.where(user % 5 == 0).select(path.alias("path")).distinct().withColumn("pos", F.col("path"))
    return captures.link_captures(r.select("_ord", "pageUrl"), shots).select("_ord", "capturePath")


_SKIPPED = " or ".join(f"contains(selector, '{x}')" for x in dedup.REPEATED)


@query(f"""with recursive {_RAW}, named as (select _ord, coalesce(nullif(selector, ''), 'body') as selector from raw),
    firsts as (select selector, min(_ord) as _ord from named where not ({_SKIPPED}) group by selector), ranked as (select *, row_number() over (order by _ord) as k from firsts),
    fold(k, _ord, fresh, taken) as (select 0::bigint, -1::bigint, false, []::varchar[]
        union all select r.k, r._ord, f.ok, case when f.ok then list_append(f.taken, r.selector) else f.taken end from (
            select fold.k, fold.taken, len(list_filter(fold.taken, lambda t: contains(t, n.selector) or contains(n.selector, t))) = 0 as ok from fold join ranked as n on n.k = fold.k + 1) as f
        join ranked as r on r.k = f.k + 1)
    select n._ord, coalesce(f.fresh, false) as captured from named as n left join fold as f on f._ord = n._ord""")
def capture_skip_fold(spark, d):
    return dedup.capture_fold(bind.raw(spark, d)).select("_ord", "captured")


_AXE, _PA = "select id as rule from raw where engine = 'axe-core' and id <> ''", "select id as rule from raw where engine = 'pa11y' and id <> ''"


def _rule_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = bind.raw(spark, d)
    return tuple(rules.extract_rules(r.where(F.col("engine") == e).select("id")) for e in ("axe-core", "pa11y"))


@query(f"with {_RAW} {_AXE} union {_PA}")
def rules_union(spark, d):
    return rules.union_rules(*_rule_sets(spark, d))


@query(f"with {_RAW} {_AXE} intersect {_PA}")
def rules_both_engines(spark, d):
    return rules.both_engines(*_rule_sets(spark, d))


_ALL_RULES = f"{_DIMS}, {_RAW}, asked as ({_AXE} union {_PA}), {_RESOLVE}"


@query(f"with {_ALL_RULES} select rule from resolved where tier = 0")
def rules_unmapped(spark, d):
    return rules.unmapped(rules.union_rules(*_rule_sets(spark, d)))


@query(f"""with {_ALL_RULES} select count(*) as rules, count(*) filter (tier > 0) as mapped, count(*) filter (tier = 0) as unmapped,
    cast(round(count(*) filter (tier > 0) * 100.0 / count(*), 2) as double) as pct from resolved""")
def rule_coverage(spark, d):
    return rules.coverage_report(rules.union_rules(*_rule_sets(spark, d)))


@query(f"""with {_ALL_RULES} select rule, criterio, nivel, principio, case when length(rule) < 50 then rpad(rule, 50, ' ') else rule end || ' → '
    || case when length(criterio) < 30 then rpad(criterio, 30, ' ') else criterio end || ' Nivel: ' || nivel || '  (' || principio || ')' as line from resolved""")
def rule_details(spark, d):
    return rules.details(rules.union_rules(*_rule_sets(spark, d)))


_SPLIT_URL = r"'^(https?://[^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$'"
_NOT_HTML = urls.NOT_PAGES["inventory"]
_TRACK = ", ".join(map(_q, urls.TRACKING))
_CLEAN = f"""parts as (select page_id, lower(regexp_extract(url, {_SPLIT_URL}, 1)) as o, regexp_extract(url, {_SPLIT_URL}, 2) as p,
        regexp_extract(url, {_SPLIT_URL}, 3) as qs, regexp_extract(url, {_SPLIT_URL}, 4) as h, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages),
    kept as (select *, array_to_string(list_transform(list_filter(string_split(substr(qs, 2), '&'), lambda x: x <> '' and string_split(x, '=')[1] not in ({_TRACK})),
        lambda x: case when contains(x, '=') then x else x || '=' end), '&') as q from parts),
    cleaned as (select page_id, trim(title) as title, regexp_replace(o || case when p = '' then '/' else p end || case when q = '' then '' else '?' || q end || h, '/$', '') as url
        from kept where o <> '')"""


@query(f"""with {_CLEAN} select url, title, page_id as _ord from (select *, row_number() over (partition by url order by page_id) as rn from cleaned
    where not regexp_matches(url, '\\.({_NOT_HTML})$', 'i')) as c where rn = 1""")
def url_clean_dedup(spark, d):
    return urls.clean_inventory(bind.inventory(spark, d)).select("url", "title", "_ord")


@query(f"""select page_id, url from pages where regexp_matches(url, {_SPLIT_URL})
    and (regexp_replace(regexp_extract(url, {_SPLIT_URL}, 2), '/$', '') in ('/es', '') or regexp_extract(url, {_SPLIT_URL}, 2) like '/es/%')""")
def url_lang_filter(spark, d):
    own = F.lower(F.regexp_extract("url", "^https?://([^/?#:]+)", 1))
    return table(spark, d, "pages").where(urls.in_language(F.col("url"), own, "es")).select("page_id", "url")


@query(f"select page_id, regexp_matches(url, '\\.({_NOT_HTML})$', 'i') as not_html, not regexp_matches(url, '^(mailto|tel|javascript):', 'i') as is_link from pages")
def url_nonhtml_filter(spark, d):
    return table(spark, d, "pages").select("page_id", urls.not_html(F.col("url")).alias("not_html"), urls.is_link(F.col("url")).alias("is_link"))


@query("""select page_id, substr(regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 60) as capture,
    substr(regexp_replace(regexp_replace(url, '^https?://', ''), '[^a-zA-Z0-9]+', '_', 'g'), 1, 90) as page,
    lower(substr(regexp_replace(regexp_replace(url, 'https?://', ''), '[^a-zA-Z0-9]', '_', 'g'), 1, 80)) as low, regexp_replace(url, '[^a-zA-Z0-9_.-]', '_', 'g') as file from pages""")
def url_slug(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", js.slug_capture(u).alias("capture"), js.slug_page(u).alias("page"), js.slug_lower(u).alias("low"), js.slug_file(u).alias("file"))


_LINKS = """links as (select page_id, url, unnest(l) as href, unnest(range(0, len(l))) as pos from
    (select page_id, url, regexp_extract_all(html, '<a[^>]+href="([^"]+)"', 1) as l from pages) as p)"""


@query(f"with {_LINKS} select page_id, pos::integer as pos, href from links")
def page_links(spark, d):
    return linkgraph.links(table(spark, d, "pages")).select("page_id", "pos", "href")


@query(f"""with recursive {_LINKS}, hosts as (select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host from pages),
    e as (select distinct 'p' || l.page_id::varchar as page, 'l' || host || l.href as link from links as l join hosts as h on h.page_id = l.page_id),
    edges as (select page as src, link as dst from e union all select link, page from e),
    walk(node, depth) as (select 'p' || min(page_id)::varchar, 0 from hosts group by host
        union select edges.dst, walk.depth + 1 from walk join edges on edges.src = walk.node where walk.depth < 4)
    select node, min(depth)::integer as depth from walk group by node""")
def link_graph_bfs(spark, d):
    pages = table(spark, d, "pages").withColumn("host", F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    found = linkgraph.links(pages).withColumn("host", F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    page, link = F.concat(F.lit("p"), F.col("page_id").cast("string")), F.concat(F.lit("l"), F.col("host"), F.col("href"))
    e = found.select(page.alias("src"), link.alias("dst")).distinct()
    seeds = pages.groupBy("host").agg(F.min("page_id").alias("page_id")).select(page.alias("node"))
    return linkgraph.bfs(seeds, e.union(e.select("dst", "src")), max_depth=4)


@query(f"""with {_LINKS} select p.page_id, '/' || coalesce(s.lang, 'es') || '/' as path from pages as p left join
    (select page_id, arg_min(lang, pos) as lang from (select *, regexp_extract(href, '/(es|en|fr|de|pt|it)(/|$)', 1) as lang from links) as l where lang <> '' group by page_id) as s on s.page_id = p.page_id""")
def seed_paths(spark, d):
    return linkgraph.seed_path(table(spark, d, "pages"))


@query(f"select doc_id, sha256({_translated('text')}) as digest from documents")
def translate_phrases(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(normalize.translate(F.col("text")), 256).alias("digest"))


@query(f"with {_RAW} select _ord, source || '-' || substr(to_base64(encode(pageUrl || selector)), 1, 10) as id from raw")
def synthetic_id(spark, d):
    return bind.raw(spark, d).select("_ord", js.synthetic_id(F.col("source"), F.col("pageUrl"), F.col("selector")).alias("id"))


@query(f"""with {_RAW} select _ord, coalesce(lower(engine), case when contains(path, 'pa11y') then 'pa11y' when contains(path, 'axe') then 'axe-core'
    when source = 'interactiva' then 'pa11y' else 'axe-core' end) as engine from (select *, case _ord % 3 when 0 then 'x/pa11y.json' when 1 then 'x/axe.json' else 'x' end as path from raw) as r""")
def engine_infer(spark, d):
    path = js.first_match([(F.col("_ord") % 3 == 0, "x/pa11y.json"), (F.col("_ord") % 3 == 1, "x/axe.json")], F.lit("x"))
    return bind.raw(spark, d).select("_ord", normalize.engine_of(F.col("engine"), path, F.col("source")).alias("engine"))


@query(f"""with {_RAW} select _ord, case impact when 'critical' then 'Critical' when 'serious' then 'Serious' when 'moderate' then 'Moderate' when 'minor' then 'Minor' else 'Sin severidad' end as name,
    case impact when 'critical' then '#d60000' when 'serious' then '#ff4c00' when 'minor' then '#00aaff' else '#ffaa00' end as color from raw""")
def impact_display(spark, d):
    return bind.raw(spark, d).select("_ord", normalize.impact_name(F.col("impact")).alias("name"), normalize.impact_color(F.col("impact")).alias("color"))


@query(f"""with {_MERGED} select 'combinado' as "Origen", engine as "Motor", pageUrl as "Página analizada", selector as "Selector", id as "ID", impact as "Impacto / Severidad",
    '' as "Descripción", wcag as "Criterio WCAG", context as "Contexto", '' as "Enlace de ayuda", '—' as "Captura asociada" from merged""")
def csv_export_rows(spark, d):
    return sinks.csv_rows(_merged(spark, d))


_SHEETS = _MERGED.replace("asked as (select id as rule from raw)", "asked as (select id as rule from raw union all select criterio from crit union all select 'Desconocido' union all select " + _q(dims.DEFAULT["criterio"]) + ")")


@query(f"""with {_SHEETS} select m._ord, m.source as sheet, m.source as origen, m.engine, r.criterio, r.nivel, r.principio,
    case m.impact when 'critical' then 'Critical' when 'serious' then 'Serious' when 'moderate' then 'Moderate' when 'minor' then 'Minor' else 'Sin severidad' end as impact,
    r.resumen as descripcion, m.resultadoActual, m.resultadoEsperado, m.recomendacionW3C, m.selector, m.pageUrl as url, r.url || '?showtechniques=es' as enlace, '—' as captura
    from merged as m join resolved as r on r.rule = m.wcag""")
def sheet_rows(spark, d):
    return sinks.sheet_rows(_merged(spark, d))


@query(f"""with {_RAW} select p.url, coalesce(f.n, 0) as total, coalesce(f.engine, 'unknown') as motor from
    (select distinct pageUrl as url from raw union all select 'https://site.example/none/' || u::varchar from (select distinct user_id as u from events) as x) as p
    left join (select pageUrl, count(*) as n, arg_min(engine, _ord) as engine from (select pageUrl, _ord, coalesce(engine, 'none') as engine from raw) as c group by pageUrl) as f on f.pageUrl = p.url""")
def page_summary(spark, d):
    rows = bind.raw(spark, d).withColumn("engine", F.coalesce("engine", F.lit("none")))
    users = table(spark, d, "events").select("user_id").distinct()
    clean = users.select(F.concat(F.lit("https://site.example/none/"), F.col("user_id").cast("string")).alias("url"))
    return metrics.page_summary(rows.select(F.col("pageUrl").alias("url")).distinct().unionByName(clean), rows)


@query(f"""with {_RAW}, d as (select count(*) as duplicates from (select id from raw group by id having count(*) > 1) as x),
    m as (select count(*) filter (engine is null) as missing, count(*) filter (trim(id) = '' or trim(description) = '') as empty from raw)
    select missing, empty, duplicates, case when missing > 0 or empty > 0 then 'ERROR' when duplicates > 0 then 'WARNING' else 'OK' end as status,
        case when missing > 0 or empty > 0 then 2 when duplicates > 0 then 1 else 0 end as exit_code from m, d""")
def metadata_status_raw(spark, d):
    return gates.metadata_verdict(gates.defects(bind.raw(spark, d), required=_SIX))


@query(f"""with {_MERGED} select greatest(max(length(id)), 2) + 2 as id, greatest(max(length(pageUrl)), 7) + 2 as "pageUrl", greatest(max(length(wcag)), 4) + 2 as wcag from merged""")
def sheet_widths(spark, d):
    return metrics.widths(_merged(spark, d).select("id", "pageUrl", "wcag"))


@query("""select page_id, regexp_matches(html, '<(form|input|button|select|textarea|dialog|video|audio|iframe|details)\\b|role=["'']?(button|dialog|tab|menu)|aria-(expanded|haspopup)=', 'i') as interactive from pages""")
def interactive_pages(spark, d):
    return table(spark, d, "pages").select("page_id", urls.is_interactive(F.col("html")).alias("interactive"))
