"""Operators on hand-written rows: the quirks of lookup, order, emptiness and verdicts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from auditlake import dims
from auditlake.functions import js
from auditlake.operators import captures, dedup, gates, linkgraph, lookup, metrics, normalize, rules, urls
from auditlake.sources import readers, sinks


def apply(spark, texts, make):
    """The column that ``make`` builds, over a table of texts, in their order."""
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, v string")
    return [r["x"] for r in frame.select("k", make(F.col("v")).alias("x")).orderBy("k").collect()]


# Dimensions and lookup


def test_dimensions():
    criteria, equal = dims.criteria_rows(), dims.equivalence_rows()
    assert len(criteria) == 44 and [r[1] for r in criteria] == list(range(44))
    assert [sum(r[3] == level for r in criteria) for level in ("A", "AA", "AAA")] == [23, 18, 3]
    assert len(equal) == len({r for r, _ in equal}) == 233
    assert sum("principle" in r for r, _ in equal) == 68


@pytest.mark.parametrize(
    ("rule", "tier", "criterion"),
    [
        ("color-contrast", 1, "1.4.3"),
        ("image-alt", 1, "1.1.1"),
        ("target-size", 1, "2.5.8"),  # defined twice, the last one holds
        ("meta-refresh", 0, None),  # its criterion is not in the dimension
        ("wcag2aa.principle1.guideline1_4.1_4_3.g18,b1,b2", 0, None),  # hyphens for underscores defeat it
        ("1.4.10", 2, "1.4.10"),
        ("1.4.10 Reflujo", 3, "1.4.1"),  # the first in map order, not the longest
        ("some-error-rule", 4, "3.3.1"),
        ("AXE-color-contrast", 1, "1.4.3"),
        ("unknown-thing", 0, None),
    ],
)
def test_lookup_tiers(spark, rule, tier, criterion):
    row = lookup.resolve(spark.createDataFrame([(rule,), (rule,), ("",), (None,)], "rule string")).collect()
    assert len(row) == 1
    assert (row[0]["tier"], row[0]["criterion"]) == (tier, criterion)
    if not tier:
        assert row[0]["criterio"] == dims.DEFAULT["criterio"] and row[0]["nivel"] == "N/A"


def test_lookup_corrected(spark):
    frame = spark.createDataFrame([("wcag2aa.principle1.guideline1_4.1_4_3.g18,b1,b2",), ("1.4.10 Reflujo",)], "rule string")
    got = {r["rule"]: r["criterion"] for r in lookup.resolve(frame, strict=True).collect()}
    assert got["1.4.10 Reflujo"] == "1.4.10"
    known = dict(dims.equivalence_rows())
    own = next(r for r in known if r.startswith("wcag2aa.principle1.guideline1_4.1_4_3"))
    assert lookup.resolve(spark.createDataFrame([(own,)], "rule string"), strict=True).first()["criterion"] == known[own]


def test_no_pa11y_equivalence_matches_as_computed(spark):
    frame = dims.equivalences(spark).where("rule like '%principle%'")
    assert lookup.resolve(frame).where("tier = 1").count() == 0


def test_null_rule_is_null_not_default(spark):
    raw = spark.createDataFrame([(0, "sitemap", None, None, "p"), (1, "sitemap", "nothing-known", "", "p")], "_ord int, source string, id string, description string, pageUrl string")
    got = {r["_ord"]: r for r in normalize.canonical(raw).collect()}
    assert (got[0]["wcag"], got[0]["nivel"], got[0]["principio"]) == ("Desconocido", "AA", "")
    assert (got[1]["wcag"], got[1]["nivel"]) == (dims.DEFAULT["criterio"], "N/A")
    assert got[0]["recomendacionW3C"] == "Revisión manual requerida"


# Normalization


def test_canonical_defaults_and_order_of_fields(spark):
    kind = "_ord int, source string, id string, ruleId string, impact string, type string, engine string, message string, pageUrl string, selector string, path string"
    rows = [
        (0, "sitemap", "image-alt", "other", "N/A", None, None, "Empty heading ", "https://a/b", "#x", "x/pa11y.json"),
        (1, "interactiva", None, None, None, "error", "AXE-core", None, None, None, None),
        (2, "manual", "", "", "", "", None, "", "", "", "x"),
    ]
    got = {r["_ord"]: r for r in normalize.canonical(spark.createDataFrame(rows, kind)).collect()}
    assert (got[0]["id"], got[0]["impact"], got[0]["severity"], got[0]["engine"]) == ("other", "n/a", "moderate", "pa11y")
    assert got[0]["wcag"].startswith("1.1.1") and got[0]["resultadoActual"] == "El encabezado está vacío o sin contenido"
    assert got[0]["resultadoEsperado"] == got[0]["resumen"]  # as computed: the summary, not the expectation
    assert (got[1]["impact"], got[1]["engine"], got[1]["resultadoActual"]) == ("error", "axe-core", "Sin descripción disponible")
    assert (got[2]["impact"], got[2]["engine"], got[2]["pageTitle"]) == ("moderate", "axe-core", "(sin título)")


def test_synthetic_ids_collide(spark):
    frame = spark.createDataFrame([("https://a.es/1", "#a"), ("https://b.es/2", "#b")], "p string, s string")
    assert {r[0] for r in frame.select(js.synthetic_id(F.lit("manual"), F.col("p"), F.col("s"))).collect()} == {"manual-aHR0cHM6Ly"}


def test_severity_names(spark):
    texts = ["Critical!", "HIGH", "serious", "medium", "MODERATE", "low", "minor", "notice", "", None]
    expected = ["critical", "serious", "serious", "moderate", "moderate", "minor", "minor", "notice", "unclassified", "unclassified"]
    assert apply(spark, texts, normalize.severity) == expected
    assert apply(spark, ["critical", "Needs-Review", "x", None], normalize.impact_name) == ["Critical", "Revisión manual", "Sin severidad", "Sin severidad"]
    assert apply(spark, ["WCAG2.1x", "WCAG2AA.Principle1", None], normalize.wcag_of_code) == ["WCAG2.1", "N/A", "N/A"]


def test_translation_is_ordered_and_ignores_case(spark):
    got = apply(spark, [" EMPTY HEADING ", "Buttons must have discernible text", "plain", None], normalize.translate)
    assert got == ["El encabezado está vacío o sin contenido", "Buttons debe tener texto visible o etiqueta accesible", "plain", None]


def test_flat_axe(spark):
    kind = "url string, violations array<struct<id:string,impact:string,description:string,helpUrl:string,tags:array<string>,nodes:array<struct<target:array<string>>>>>"
    rows = [("u", [("a", None, "d", "h", ["cat", "wcag2a"], [(["#1", "#2"],), (["#3"],)]), ("b", "minor", None, None, [], [])]), ("v", None)]
    got = {r["id"]: r for r in normalize.flat_axe(spark.createDataFrame(rows, kind)).collect()}
    assert (got["a"]["impact"], got["a"]["selector"], got["a"]["nodes"], got["a"]["wcag_tag"]) == ("unknown", "#1", 2, "wcag2a")
    assert (got["b"]["selector"], got["b"]["wcag_tag"]) == ("", "N/A")


def test_multi_engine_pages(spark):
    issue = "struct<id:string,impact:string>"
    rows = [("u", [("a", "x")], [("b", "y"), ("c", None)]), ("v", None, None)]
    got = {r["page"]: r for r in normalize.multi_engine(spark.createDataFrame(rows, f"page string, pa11y array<{issue}>, axe array<{issue}>")).collect()}
    assert got["u"]["total_issues"] == 3 and [i["id"] for i in got["u"]["issues"]] == ["a", "b", "c"]
    assert got["v"]["total_issues"] == 0 and got["v"]["issues"] == []


def test_origin_from_file_name(spark):
    assert apply(spark, ["results-interactiva.json", "results-sitemap.json", "x.json"], normalize.origin_of_file) == ["interactiva", "sitemap", "sitemap"]


# Deduplication


def test_merge_dedup_ignores_id_and_engine(spark):
    kind = "_ord int, id string, engine string, pageUrl string, selector string, wcag string, resultadoActual string, source string"
    rows = [(2, "b", "pa11y", "p", "s", "w", "r", "x"), (1, "a", "axe-core", "p", "s", "w", "r", "x"), (3, "a", "axe-core", "p", "s", "w", "r", "y"), (4, "c", None, None, "s", "w", "r", "x"), (5, "d", None, None, "s", "w", "r", "x")]
    frame = spark.createDataFrame(rows, kind)
    once = dedup.merge_dedup(frame)
    assert sorted(r["_ord"] for r in once.collect()) == [1, 3, 4]
    assert sorted(map(tuple, dedup.merge_dedup(once).collect())) == sorted(map(tuple, once.collect()))


def test_audit_key_collides_on_hyphens(spark):
    frame = spark.createDataFrame([(1, "axe", "a-b", "c", "d"), (2, "axe", "a", "b-c", "d"), (3, None, "a", "b", "c")], "_ord int, engine string, id string, pageUrl string, selector string")
    assert sorted(r["_ord"] for r in dedup.audit_dedup(frame).collect()) == [1, 3]


def test_groups_keep_order(spark):
    kind = "_ord int, id string, pageUrl string, selector string, context string, engine string"
    rows = [(3, "a", "p", "s3", None, "e"), (1, "a", "p", "s1", "c", "e"), (2, "a", "q", "s2", "", "e"), (4, None, "p", "s4", "", "e")]
    frame = spark.createDataFrame(rows, kind)
    got = {r["group_key"]: r for r in dedup.grouped(frame).collect()}
    assert got["a::p"]["_ord"] == 1 and [i["selector"] for i in got["a::p"]["instances"]] == ["s1", "s3"]
    assert set(got) == {"a::p", "a::q", "sin_id::p"}
    assert [(r["id"], r["n"]) for r in dedup.duplicate_ids(frame).collect()] == [("a", 3)]


def test_capture_fold(spark):
    selectors = ["div.a", "div.a > b", "div", "p", "site-header x", "span", "p", None, "q"]
    frame = spark.createDataFrame([(k, s) for k, s in enumerate(selectors)], "_ord int, selector string")
    accepted, expected = [], []
    for s in (x or "body" for x in selectors):
        ok = not any(w in s for w in dedup.REPEATED) and not any(a in s or s in a for a in accepted)
        accepted += [s] * ok
        expected.append(ok)
    got = dedup.capture_fold(frame)
    assert [r["captured"] for r in got.orderBy("_ord").collect()] == expected
    counts = captures.capture_counters(got.withColumn("error", F.col("_ord") == 3)).first()
    assert (counts["captured"], counts["skipped"], counts["errors"]) == (sum(expected) - 1, len(expected) - sum(expected), 1)


def test_capture_links_and_empty_pages(spark):
    found = spark.createDataFrame([(1, "http://a/b"), (2, ""), (3, "http://zz"), (4, None)], "_ord int, pageUrl string")
    shots = spark.createDataFrame([("x/2-http___a_b.png", 1), ("x/1-http___a_b.png", 2)], "path string, pos int")
    got = {r["_ord"]: r["capturePath"] for r in captures.link_captures(found, shots).collect()}
    assert got == {1: "x/2-http___a_b.png", 2: "x/2-http___a_b.png", 3: None, 4: "x/2-http___a_b.png"}


def test_capture_metadata(spark):
    kind = "id string, wcag string, selector string, impact string, capturePath string, pageUrl string, source string"
    rows = [("image-alt", "1.1.1 X", "#a", "critical", "p.png", "http://a", "manual"), (None, None, "", None, None, "http://b", None), ("image-alt", None, "x", "minor", None, "", None)]
    got = {r["url"]: r for r in captures.capture_meta(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {"http://a", "http://b"}
    a, b = got["http://a"], got["http://b"]
    assert (a["criterio"], a["nivel"], a["impacto"], a["color"], a["origen"]) == ("1.1.1 X", "A", "critical", "#d60000", "manual")
    assert (b["criterio"], b["selector"], b["impacto"], b["color"], b["origen"]) == ("sin-id", "body", "serious", "#ffaa00", "sitemap")


# Metrics and gates


def test_index_bounds_and_bands(spark):
    kind = "severity string, impact string, pageUrl string"
    for rows, expected in (
        ([], (100.0, "AA (Alta)")),
        ([("critical", None, "p")] * 40, (0.0, "No conforme")),
        ([("critical", None, "p"), ("minor", None, "q"), ("odd", None, "")], (98.5, "AA (Alta)")),
        ([("serious", None, "p")] * 5, (90.0, "AA (Alta)")),
        ([("critical", None, "p")] * 3, (89.5, "AA (Media)")),
    ):
        r = metrics.conformance_index(spark.createDataFrame(rows, kind)).first()
        assert (r["conformance"], r["level"]) == expected


def test_top_breaks_ties_by_first_seen(spark):
    rows = [(k, v) for k, v in enumerate(["b", "a", None, "a", "b", "", "c"])]
    assert [tuple(r) for r in metrics.top(spark.createDataFrame(rows, "_ord int, f string"), "f", 3).collect()] == [("b", 2), ("a", 2), ("(sin dato)", 2)]


def test_nested_counts(spark):
    kind = "url string, origen string, violations array<struct<id:string,impact:string>>"
    rows = [("u", "interactiva", [("a", "critical"), ("b", "serious")]), ("v", None, [("a", "Critical")]), ("v", "x", None)]
    got = {r["origen"]: r for r in metrics.nested_counts(spark.createDataFrame(rows, kind)).collect()}
    assert (got["global"]["urls"], got["global"]["total"], got["global"]["critical"]) == (2, 3, 1)
    assert (got["sitemap"]["urls"], got["sitemap"]["total"], got["interactiva"]["serious"]) == (1, 1, 1)
    gate = gates.quality_gate(metrics.nested_counts(spark.createDataFrame(rows, kind)))
    assert (gate.first()["passed"], gate.first()["exit_code"]) == (False, 1)
    assert gates.quality_gate(metrics.nested_counts(spark.createDataFrame(rows, kind)), critical_max=1).first()["exit_code"] == 0


def test_metadata_verdicts(spark):
    good = spark.createDataFrame([tuple("x" for _ in gates.REQUIRED)], ", ".join(f"{c} string" for c in gates.REQUIRED))
    none = spark.createDataFrame([], "id string, n long")
    some = spark.createDataFrame([("x", 2)], "id string, n long")
    verdict = lambda rows, d, **o: (r := gates.metadata_status(gates.defects(rows), d, **o).first(), (r["status"], r["exit_code"]))[1]
    assert verdict(good, none) == ("OK", 0)
    assert verdict(good, some) == ("WARNING", 1)
    assert verdict(good, some, strict=True) == ("WARNING", 2)
    assert verdict(good.withColumn("wcag", F.lit(" ")), none) == ("ERROR", 2)
    assert verdict(good.withColumn("wcag", F.lit(None).cast("string")), none) == ("ERROR", 2)


def test_absent_and_blank_fields_differ(spark):
    frame = spark.createDataFrame([('{"id":"a","engine":" "}',), ("{}",), ('{"id":null,"engine":"x"}',)], "_raw string")
    got = [(sorted(r["missing"]), sorted(r["empties"])) for r in gates.defects(frame, "_raw", ["id", "engine"]).collect()]
    assert got == [([], ["engine"]), (["engine", "id"], []), ([], [])]


def test_pipeline_verdicts(spark):
    kind = "source string, engine string"
    fine = [("sitemap", "axe-core"), ("interactiva", "pa11y")]
    facts = lambda rows, **o: gates.sources_and_engines(spark.createDataFrame(rows, kind)).withColumns({k: F.lit(v) for k, v in ({"urls": 1, "captures": 1, "raw_sitemap": 1, "raw_interactiva": 1} | o).items()})
    assert gates.pipeline_verdict(facts(fine)).first()["status"] == "OK"
    assert gates.pipeline_verdict(facts(fine, captures=0)).first()["exit_code"] == 1
    assert gates.pipeline_verdict(facts(fine, raw_sitemap=9)).first()["status"] == "WARNING"
    assert gates.pipeline_verdict(facts([*fine, ("sitemap", "pa11y")])).first()["exit_code"] == 2
    assert gates.pipeline_verdict(facts(fine), missing_specs=1).first()["status"] == "ERROR"


def test_engine_fallback_and_review(spark):
    axe = spark.createDataFrame([("p", "axe-core"), ("q", "axe-core")], "pageUrl string, engine string")
    got = gates.engine_fallback(axe, spark.createDataFrame([("p", "pa11y")], "pageUrl string, engine string"))
    assert sorted((r["pageUrl"], r["engine"]) for r in got.collect()) == [("p", "pa11y"), ("q", "axe-core")]
    items = spark.createDataFrame([("a", "manual", None), ("b", "minor", "REVISIÓN necesaria"), ("c", "minor", None), ("d", None, "x")], "id string, impact string, description string")
    rows = {r["id"]: r for r in gates.review_rows(gates.needs_review(items)).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["selector"] == "(sin selector definido)" and rows["a"]["nivel"] == "AA"


# Rules


def test_stored_coverage_report(spark):
    """The two rules of the sample input: both mapped, 100.00 %."""
    both = rules.extract_rules(spark.createDataFrame([("color-contrast",), ("image-alt",), ("image-alt",), (None,)], "id string"))
    r = rules.coverage_report(both).first()
    assert (r["rules"], r["mapped"], r["unmapped"], r["pct"]) == (2, 2, 0, 100.0)
    assert {(d["rule"], d["criterio"].split()[0], d["nivel"]) for d in rules.details(both).collect()} == {("color-contrast", "1.4.3", "AA"), ("image-alt", "1.1.1", "A")}
    none = rules.coverage_report(both.limit(0)).first()
    assert (none["rules"], none["pct"]) == (0, 0.0)


def test_rule_sets(spark):
    kind = "id string, violations array<struct<id:string,ruleId:string>>, results array<struct<code:string,type:string>>"
    rows = [("a", [("b", None), (None, "c")], [("d", "e")]), (None, None, None)]
    one = rules.extract_rules(spark.createDataFrame(rows, kind))
    assert {r["rule"] for r in one.collect()} == set("abcde")
    two = spark.createDataFrame([("a",), ("image-alt",)], "rule string")
    every, shared, lost = (({r["rule"] for r in f.collect()}) for f in (rules.union_rules(one, two), rules.both_engines(one, two), rules.unmapped(rules.union_rules(one, two))))
    mapped = {r["rule"] for r in rules.mapped(rules.union_rules(one, two)).collect()}
    assert shared == {"a"} and shared <= every and lost | mapped == every and not lost & mapped


# URLs and links


def test_clean_url(spark):
    site = "https://s.es"
    pairs = {
        "https://A.es/x/?utm_source=1&b=2&gclid=3#f": "https://a.es/x/?b=2#f",
        "/rel/path/": "https://s.es/rel/path",
        "//cdn.es/x": "https://cdn.es/x",
        "x/y": "https://s.es/x/y",
        "https://a.es": "https://a.es",
        "https://a.es/doc.PDF": None,
        "mailto:a@b": None,
        " https://a.es/?x ": "https://a.es/?x=",
        "": None,
        None: None,
    }
    assert apply(spark, list(pairs), lambda c: urls.clean_url(c, site)) == list(pairs.values())


def test_url_predicates(spark):
    assert apply(spark, ["https://a.es/es", "https://a.es/es/x", "https://a.es/", "https://a.es/en", "https://b.es/es", "https://a.es/estado"], lambda c: urls.in_language(c, "a.es", "es")) == [True, True, True, False, False, False]
    assert apply(spark, ["https://a.es/x", "https://a.es/x#y", "https://a.es/x.css", "http://a.es"], lambda c: urls.should_visit(c, "https://a.es")) == [True, False, False, False]
    assert apply(spark, ["mailto:x", "TEL:1", "javascript:0", "/x"], urls.is_link) == [False, False, False, True]
    assert apply(spark, ["https://a.es/x", "https://a.es/x?y", "/x"], lambda c: urls.is_plain_link(c, "https://a.es")) == [True, False, False]
    assert apply(spark, ["<button>", "<p>", "<div role='dialog'>", "<formal>"], urls.is_interactive) == [True, False, True, False]
    assert apply(spark, ["https://a/admin", "https://a/x"], lambda c: urls.matches_lists(c, ["a/"], ["admin"])) == [False, True]


def test_inventory_keeps_the_first_title(spark):
    rows = spark.createDataFrame([("https://a.es/x?utm_term=1", " One ", 1), ("https://a.es/x", "Two", 0), ("https://a.es/x/", None, 2), ("", "n", 3)], "url string, title string, _ord int")
    assert [(r["url"], r["title"]) for r in urls.clean_inventory(rows).collect()] == [("https://a.es/x", "Two")]


def test_page_to_page_crawl(spark):
    page = lambda k, *to: (k, f"https://a.es/{k}", "".join(f'<a class="x" href="{t}">' for t in to))
    pages = spark.createDataFrame([page(1, "/2?q=1", "/3#f"), page(2, "/4/"), page(3, "/1", "mailto:x"), page(4, "/5"), page(5)], "page_id int, url string, html string")
    e = linkgraph.edges(pages)
    seeds = spark.createDataFrame([("https://a.es/1",)], "node string")
    found = {r["node"][-1]: r["depth"] for r in linkgraph.bfs(seeds, e, max_depth=2).collect()}
    assert found == {"1": 0, "2": 1, "3": 1, "4": 2}
    capped = linkgraph.bfs(seeds, e, max_depth=5, max_nodes=2)
    assert [r["node"][-1] for r in capped.orderBy("depth", "node").collect()] == ["1", "2"]
    kept = linkgraph.bfs(seeds, e, max_depth=5, keep=~F.col("node").endswith("/2"))
    assert {r["node"][-1] for r in kept.collect()} == {"1", "3"}


def test_headings(spark):
    assert apply(spark, ["<h2 class=x>One <b>two</b></h2><H2>Three</H2>", "none"], linkgraph.headings) == [["One two", "Three"], []]


# Sources and sinks


def test_json_repair(spark):
    cases = {'[{"a":1}]': 1, '{"a":1}{"a":2}': 2, '[{"a":1}][{"a":2}]': 2, '[{"a":1},]': 1, '[{"a":1}': 1, '[[{"a":1},{"a":2}]]': 2, "": 0, "nonsense": 0, '{"a":1},{"a":2}': 2, '[{"a":"}{"}]': 1}
    frame = spark.createDataFrame([(t, t) for t in cases], "path string, text string")
    got = {r["path"]: r["n"] for r in readers.elements(frame, mend=True).groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert {t: got.get(t, 0) for t in cases} == cases


def test_findings_from_a_folder(spark, tmp_path):
    def put(name, data):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(data if isinstance(data, str) else json.dumps(data))

    put("sitemap/a.json", [{"id": "image-alt", "impact": "critical", "pageUrl": "u"}, {"id": 5}, {"id": "lost"}])
    put("interactiva/sub/pa11y.json", [{"code": "x", "type": "error", "title": "t"}])
    put("interactiva/sitemap-both.json", [{"id": "b"}])
    put("sitemap/summary.json", [{"id": "no"}])
    put("sitemap/urls.json", [{"id": "no"}])
    put("sitemap/broken.json", "{")
    put("sitemap/object.json", {"id": "no"})
    rows = readers.raw_findings(spark, str(tmp_path)).orderBy("_ord").collect()
    assert [(r["source"], r["id"], r["code"]) for r in rows] == [("sitemap", "b", None), ("sitemap", "image-alt", None), ("interactiva", "b", None), ("interactiva", None, "x")]
    found = dedup.merge_dedup(normalize.canonical(readers.raw_findings(spark, str(tmp_path))))
    assert found.where("engine = 'pa11y'").count() >= 1
    assert readers.raw_findings(spark, str(tmp_path / "missing")).count() == 0
    assert readers.first_that_exists(spark, str(tmp_path / "missing"), str(tmp_path)) == str(tmp_path)


def test_inventory_reader_and_captures(spark, tmp_path):
    (tmp_path / "urls.json").write_text('[{"url":"https://a","title":"T"},"https://b",{"title":"no"}]')
    got = readers.read_urls(spark, str(tmp_path / "urls.json")).orderBy("_ord").collect()
    assert [(r["url"], r["title"]) for r in got] == [("https://a", "T"), ("https://b", None)]
    (tmp_path / "shots").mkdir()
    for name in ("b.png", "a.png", "c.txt"):
        (tmp_path / "shots" / name).write_bytes(b"x")
    assert [r["path"][-5:] for r in readers.captures(spark, str(tmp_path / "shots"), str(tmp_path / "none")).orderBy("pos").collect()] == ["a.png", "b.png"]
    assert readers.count_png(spark, str(tmp_path / "shots")) == 2 and readers.count_png(spark, str(tmp_path / "none")) == 0
    assert readers.latest(readers.listing(spark, str(tmp_path / "shots"), "*.png"), "name").endswith("b.png")


def test_sinks(spark, tmp_path):
    kind = "_ord int, id string, source string, engine string, pageUrl string, selector string, wcag string, impact string, resultadoActual string, context string, helpUrl string"
    frame = spark.createDataFrame([(2, "b", "sitemap", "pa11y", "p", 's;"', "1.1.1", "minor", "r", "", ""), (1, "a", "manual", "other", "", "", "", "", "", "", "")], kind)
    sinks.write_json(frame, str(tmp_path / "j"), single=True)
    lines = [json.loads(x) for p in sorted((tmp_path / "j").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["id"] for x in lines] == ["a", "b"]
    sinks.write_by_engine(frame, str(tmp_path / "e"))
    assert [p.name for p in (tmp_path / "e").glob("engine=*")] == ["engine=pa11y"]
    rows = sinks.csv_rows(frame)
    assert len(rows.columns) == 11 and {r["Origen"] for r in rows.collect()} == {"combinado"}
    assert {r["Origen"] for r in sinks.csv_rows(frame, strict=True).collect()} == {"sitemap", "manual"}
    sinks.write_csv(rows, str(tmp_path / "c"), single=True)
    back = spark.read.options(**sinks.CSV_OPTIONS).option("escape", "\\").csv(str(tmp_path / "c"))
    assert back.count() == 2 and back.columns == rows.columns
    sinks.append(frame, str(tmp_path / "a"))
    sinks.append(frame, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 4
    text = sinks.markdown("Resumen", {"x|y": frame.groupBy("engine").count().orderBy("engine")})
    assert "| other | 1 |" in text and text.startswith("# Resumen")
    assert "<td>pa11y</td>" in sinks.html("R", {"t": frame.select("engine")})


def test_streaming_dedup_and_merge(spark, tmp_path):
    from auditlake.streaming import findings

    source = tmp_path / "in"
    source.mkdir()
    row = {"ts": "2024-01-01T00:00:00Z", "source": "sitemap", "id": "image-alt", "impact": "minor", "pageUrl": "p", "selector": "s", "engine": "axe-core"}
    (source / "a.json").write_text(json.dumps(row) + "\n" + json.dumps(row) + "\n" + json.dumps(row | {"selector": "t"}) + "\n")
    schema = "ts timestamp, source string, id string, impact string, pageUrl string, selector string, engine string"
    rows = findings.deduplicated(findings.read_events(spark, str(source), schema))
    query = rows.writeStream.foreachBatch(findings.merge_into(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_lookup_of_known_rules(spark):
    """Criteria of rules, levels and tiers, written down here independently of the tables."""
    from auditlake.operators.lookup import resolve

    expected = {
        "color-contrast": ("1.4.3", "AA", "Perceptible", 1), "image-alt": ("1.1.1", "A", "Perceptible", 1), "target-size": ("2.5.8", "AA", "Operable", 1), "axe-link_name": ("2.4.4", "A", "Operable", 1),
        "html-has-lang": ("3.1.1", "A", "Comprensible", 1), "best-practice-region": ("1.3.1", "A", "Perceptible", 1), "label": ("3.3.2", "A", "Comprensible", 1), "aria-alert-name": ("4.1.3", "AA", "Robusto", 1),
        "focus-not-obscured": ("2.4.12", "AAA", "Operable", 1), "2.1.1": ("2.1.1", "A", "Operable", 2), "1.4.10": ("1.4.10", "AA", "Perceptible", 2), "1.4.10 Reflujo": ("1.4.1", "A", "Perceptible", 3),
        "some-error-rule": ("3.3.1", "A", "Comprensible", 4), "el foco": ("2.4.7", "AA", "Operable", 4), "meta-refresh": (None, "N/A", "Desconocido", 0), "unknown-thing": (None, "N/A", "Desconocido", 0),
    }
    rows = resolve(spark.createDataFrame([(r,) for r in [*expected, "", None]], "rule string")).collect()
    assert {r["rule"]: (r["criterion"], r["nivel"], r["principio"], r["tier"]) for r in rows} == expected


def test_links_resolve_against_their_page(spark):
    from auditlake.operators.linkgraph import crawl, crawl_counters

    pages = spark.createDataFrame(
        [
            (1, "https://a.example/x/", '<title>One</title><a href="two.html"></a><a href="../y"></a><a href="mailto:m@a.example"></a><a href="f.pdf"></a>'),
            (2, "https://a.example/x/two.html?q=1", '<title> </title><form></form><a href="https://b.example/far"></a><a href="/missing"></a>'),
            (3, "https://a.example/y", None),
            (4, "https://b.example/far", "<title>Far</title>"),
        ],
        "page_id long, url string, html string",
    )
    seeds = pages.where("page_id = 1").select("url")
    got = {(r["url"], r["depth"], r["title"], r["ok"], r["interactive"]) for r in crawl(pages, seeds).collect()}
    assert got == {
        ("https://a.example/x", 0, "One", True, False),
        ("https://a.example/x/two.html", 1, "(sin título)", True, True),
        ("https://a.example/y", 1, "(sin título)", True, False),
        ("https://a.example/missing", 2, "(error de carga)", False, False),
    }
    assert tuple(crawl_counters(crawl(pages, seeds)).first()) == (4, 1, 1, 2, 2)
    assert [r["url"] for r in crawl(pages, seeds, max_urls=2).collect()] == ["https://a.example/x", "https://a.example/x/two.html"]


def test_streams_merge_by_batch(spark, tmp_path):
    """A batch that is run again changes nothing; findings that are there already stay out."""
    import datetime

    from auditlake.streaming.findings import merge_into

    schema = "ts timestamp, source string, id string, impact string, pageUrl string, selector string, engine string"
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    row = ("sitemap", "image-alt", "minor", "p")
    one = spark.createDataFrame([(at(2), *row, "s", "second"), (at(1), *row, "s", "first"), (at(1), *row, "t", "axe-core")], schema)
    two = spark.createDataFrame([(at(0), *row, "s", "late"), (at(3), *row, "u", "axe-core")], schema)
    run, path = merge_into(str(tmp_path / "out")), str(tmp_path / "out")
    run(one, 0)
    run(two, 1)
    for batch, number in ((one, 0), (two, 1), (two, 1)):
        run(batch, number)
        assert sorted((r["selector"], r["engine"]) for r in spark.read.parquet(path).collect()) == [("s", "first"), ("t", "axe-core"), ("u", "axe-core")]


def test_falsy_values_of_json_count_as_absent(spark, tmp_path):
    from auditlake.sources import readers

    (tmp_path / "sitemap.json").write_text('[\n {"id": "x", "severity": false, "message": 0, "description": "d"},\n {"id": "y", "message": "0"}\n]\n')
    rows = readers.raw_findings(spark, str(tmp_path)).orderBy("_ord").collect()
    assert [(r["id"], r["severity"], r["message"], r["description"]) for r in rows] == [("x", None, None, "d"), ("y", None, "0", None)]


ODD_ARRAYS = [
    '[{"a":1},{"a":2}]', ' \n[ {"a" : 1} ,\n{"a":{"b":[1,2,{"c":"}]\\"{[,"}]}}, "x,y}", 5, -1.50, true, null, [1,[2,3]], {} ]\r\n', "[]", " [ ] ", "[[]]", '[""]', "[null]", '["\\\\","}",{"q":"\\\\\\""}]',
    '[{"a":"ñ€𝄞 }{ , ][ \\u00e9"}]', "[1,]", "[,1]", "[1 2]", "[1]]", "[1] 2", "[1],[2]", "[1][2,3]", '{"a":[1]}', "5", "", " ", "nonsense", "[", "]", '[{"a":1}', '[{"a":1}}', '[{"a":1]}', '[1},{"v":2]', "[1,2], 3]", '["a', '["a\\"]',
    "﻿[1]", '[{"a":1,"a":2}]', '[{"t":"' + "long, } text " * 60 + '"},{"u":"' + "{[" * 200 + '"}]', "[" + ",".join('{"k":%d,"s":"}%s"}' % (k, "\\\\" * (k % 5)) for k in range(200)) + "]", "[" + "[" * 50 + "}" * 3 + "]" * 50 + "]",
]


def test_arrays_are_read_in_parts(spark, tmp_path):
    """Files cut at every few bytes give what whole files give, broken and odd ones too."""
    from auditlake.sources.arrays import array_elements

    for k, text in enumerate(ODD_ARRAYS):
        (tmp_path / f"{k:02}.json").write_text(text)
    whole = readers.elements(readers.json_files(spark, str(tmp_path))).collect()
    want = sorted((r["path"][-7:], r["idx"], r["item"]) for r in whole)
    assert len(want) > 200
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for n in (23, 64, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
            got = array_elements(spark, str(tmp_path), recursiveFileLookup=True, pathGlobFilter="*.json").collect()
            assert sorted((r["path"][-7:], r["idx"], r["item"]) for r in got) == want, n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_arrays_beyond_a_variant_are_read(spark, tmp_path):
    """A file longer than any one JSON value that Spark holds (128 MiB) gave no rows."""
    with open(tmp_path / "sitemap.json", "w") as out:
        out.write("[")
        for k in range(140):
            out.write(("," if k else "") + json.dumps({"id": f"r{k}", "description": "d" * (1 << 20)}))
        out.write("]")
    rows = readers.raw_findings(spark, str(tmp_path))
    assert sorted(r["id"] for r in rows.select("id").collect()) == sorted(f"r{k}" for k in range(140))


def test_array_file_is_written_by_all_tasks(spark, tmp_path, monkeypatch):
    """One file of the same bytes, however many tasks and chunks write it."""
    from auditlake.sources import arrays

    monkeypatch.setattr(arrays, "CHUNK", 100)
    frame = spark.range(500).select((-F.col("id")).alias("_ord"), F.concat(F.lit('ñ"\n'), F.col("id").cast("string")).alias("id"))
    want = "[" + "\n,".join(json.dumps({"id": f'ñ"\n{k}'}, ensure_ascii=False, separators=(",", ":")) for k in reversed(range(500))) + "\n]\n"
    for path in (str(tmp_path / "a.json"), f"file://{tmp_path}/b.json"):
        sinks.write_json_array(frame.repartition(7), path)
    monkeypatch.setattr(arrays, "local_path", lambda uri: None)  # as on stores that are not mounted
    sinks.write_json_array(frame.repartition(7), str(tmp_path / "c.json"))
    assert [(tmp_path / f"{n}.json").read_text() for n in "abc"] == [want] * 3
    sinks.write_json_array(frame.where("false"), str(tmp_path / "d.json"))
    assert (tmp_path / "d.json").read_text() == "[]\n"
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.json", "b.json", "c.json", "d.json"]


def test_dashboard_computes_its_findings_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    frame = spark.createDataFrame([("minor", "pa11y"), ("minor", None), (None, "axe-core")], "impact string, engine string").mapInArrow(look, "impact string, engine string")
    page = sinks.dashboard(frame)
    assert "<td>minor</td><td>2</td>" in page and "<td>sin clasificar</td><td>1</td>" in page and "<td>desconocido</td><td>1</td>" in page
    assert seen.value == 3


def test_a_finding_is_translated_once(spark):
    """Each phrase's pattern stands once in the plan; trimming and translation give what the plain patterns give."""
    rows = spark.createDataFrame([(1, "sitemap", "image-alt", "Empty heading", "p", "s")], "_ord int, source string, id string, description string, pageUrl string, selector string")
    plan = normalize.canonical(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)Empty heading") == 1
    texts = [None, "", " ", "a", " a b\t", " x﻿", "x \u0085", "x\u0085", "\u0085 x", "x \n", "EMPTY heading decorative ", "must have discernible textmpty heading", "Kontrast Contrast Ratio"]
    plain = lambda x: F.regexp_replace(x, r"^[\s\x{FEFF}\p{Z}]+|[\s\x{FEFF}\p{Z}]+$", "")

    def long_way(x):
        for phrase, wording in normalize.PHRASES:
            x = F.regexp_replace(x, f"(?i){phrase}", wording)
        return plain(x)

    assert apply(spark, texts, js.js_trim) == apply(spark, texts, plain)
    assert apply(spark, texts, normalize.translate) == apply(spark, texts, long_way)
