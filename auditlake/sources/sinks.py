"""Writers of results: JSON, CSV, partitioned tables and small reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.js import first_match, js_or
from auditlake.operators.normalize import impact_name
from auditlake.session import settled
from auditlake.sources.arrays import join_parts

CSV_OPTIONS = {"sep": ";", "quote": '"', "header": "true", "quoteAll": "true", "encoding": "UTF-8"}


def csv_rows(findings: DataFrame, *, strict: bool = False) -> DataFrame:
    """The eleven columns of the CSV export.

    As computed, origin and description come from fields that merged findings
    do not have; ``strict=True`` takes source and resultadoActual instead.
    """
    c = {n: F.col(n) if n in findings.columns else F.lit(None).cast("string") for n in ("origen", "description", "capturePath", "url")}
    origin, text = (F.col("source"), F.col("resultadoActual")) if strict else (c["origen"], c["description"])
    return findings.select(
        js_or(origin, "combinado").alias("Origen"),
        js_or(F.col("engine"), "desconocido").alias("Motor"),
        js_or(F.col("pageUrl"), c["url"], "(sin URL)").alias("Página analizada"),
        js_or(F.col("selector"), "(sin selector)").alias("Selector"),
        js_or(F.col("id"), "(sin id)").alias("ID"),
        js_or(F.col("impact"), "sin severidad").alias("Impacto / Severidad"),
        js_or(text, "").alias("Descripción"),
        js_or(F.col("wcag"), "").alias("Criterio WCAG"),
        js_or(F.col("context"), "").alias("Contexto"),
        js_or(F.col("helpUrl"), "").alias("Enlace de ayuda"),
        js_or(c["capturePath"], "—").alias("Captura asociada"),
    )


def grouped_csv_rows(groups: DataFrame) -> DataFrame:
    """Grouped findings with their selectors in one column."""
    selectors = F.array_join(F.transform("instances", lambda x: F.coalesce(x["selector"], F.lit(""))), " | ")
    return groups.select("id", "pageUrl", "engine", "source", "impact", "wcag", selectors.alias("selectors"), F.size("instances").alias("instances"))


def sheet_of(source: Column) -> Column:
    """The sheet that a source goes to; unknown sources by substring, else the sitemap's."""
    s = js_or(source, "sitemap")
    named = [(s == n, n) for n in ("sitemap", "interactiva", "manual")]
    return first_match([*named, (s.contains("interactiva"), "interactiva"), (s.contains("manual"), "manual")], F.lit("sitemap"))


def sheet_rows(findings: DataFrame) -> DataFrame:
    """The thirteen columns of the workbook, criteria looked up again from the criterion's text, with its W3C link."""
    from auditlake.operators.lookup import enrich

    e = enrich(findings, js_or(F.col("wcag"), F.col("id")))
    link = F.when(F.col("w_url").contains("w3.org"), F.concat("w_url", F.lit("?showtechniques=es"))).otherwise(F.col("w_url"))
    link = F.coalesce(link, F.lit("https://www.w3.org/WAI/WCAG22/quickref/?showtechniques=es"))
    capture = F.col("capturePath") if "capturePath" in findings.columns else F.lit(None).cast("string")
    return e.select(
        *([F.col("_ord")] if "_ord" in findings.columns else []),
        sheet_of(F.col("source")).alias("sheet"),
        js_or(F.col("source"), "sitemap").alias("origen"),
        js_or(F.col("engine"), "WCAG").alias("engine"),
        js_or(F.col("w_criterio"), F.col("wcag"), "(sin criterio)").alias("criterio"),
        js_or(F.col("w_nivel"), "—").alias("nivel"),
        js_or(F.col("w_principio"), "").alias("principio"),
        impact_name(F.col("impact")).alias("impact"),
        js_or(F.col("w_resumen"), "Elemento con posible problema de accesibilidad.").alias("descripcion"),
        js_or(F.col("resultadoActual"), "(sin descripción)").alias("resultadoActual"),
        js_or(F.col("resultadoEsperado"), "Debe cumplir con el criterio WCAG indicado.").alias("resultadoEsperado"),
        js_or(F.col("recomendacionW3C"), F.concat(F.lit("Ver criterio en "), link), "—").alias("recomendacionW3C"),
        js_or(F.col("selector"), "(sin selector)").alias("selector"),
        js_or(F.col("pageUrl"), "(sin URL)").alias("url"),
        link.alias("enlace"),
        js_or(capture, "—").alias("captura"),
    )


def write_csv(rows: DataFrame, path: str, *, single: bool = False) -> None:
    """Semicolon-separated and quoted; ``single`` for small exports that must be one file."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_json_array(rows: DataFrame, path: str, order: str | None = "_ord") -> None:
    """One file with one JSON array, an object a line, sorted by ``order``.

    The rows are sorted and written by all tasks, whose files are then joined.
    """
    write_values((rows.orderBy(order).drop(order) if order else rows).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")), path)


def write_values(values: DataFrame, path: str) -> None:
    """One file with one JSON array of the JSON texts in ``value``, in their order."""
    spark = values.sparkSession
    aside = f"{path}.{uuid.uuid4().hex}"
    values.select(F.concat(F.lit(","), "value")).write.text(aside)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, folder, whole = hadoop.Path(path), hadoop.Path(aside), hadoop.Path(f"{aside}.whole")
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [(f.getPath().toString(), f.getLen()) for f in store.listStatus(folder) if f.getPath().getName().startswith("part-")]
    join_parts(spark, sorted(parts), store.makeQualified(whole).toString())
    store.delete(target, False)
    if not store.rename(whole, target):
        raise OSError(f"{path} could not be written")
    store.delete(folder, True)


def write_object(row: DataFrame, path: str) -> None:
    """One file with one JSON object, from a table of one row."""
    _write_file(row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).limit(1), path)


def append_text(spark: SparkSession, path: str, text: str) -> None:
    """Adds to a small text file, such as the summary of a CI run."""
    lines = spark.createDataFrame([(0, text)], "at int, value string")
    if exists(spark, path):
        before = spark.read.text(path, wholetext=True).select(F.lit(-1).alias("at"), "value")
        lines = before.union(lines)
    whole = lines.coalesce(1).sortWithinPartitions("at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "").alias("value"))
    _write_file(whole.select(F.regexp_replace("value", "\\n$", "").alias("value")), path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _write_file(lines: DataFrame, path: str) -> None:
    """The lines of a table of one partition as one file, written aside and then renamed."""
    spark = lines.sparkSession
    aside = f"{path}.{uuid.uuid4().hex}"
    lines.coalesce(1).write.text(aside)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, folder = hadoop.Path(path), hadoop.Path(aside)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-"))
    store.delete(target, False)
    if not store.rename(part, target):
        raise OSError(f"{path} could not be written")
    store.delete(folder, True)


def verification(facts: DataFrame) -> DataFrame:
    """What the verification file says: the row of ``pipeline_verdict`` under its names."""
    c = F.col
    return facts.select(
        c("status"), c("exit_code").alias("exitCode"), c("merged").alias("totalMerged"), c("urls").alias("totalUrls"), c("captures").alias("totalCaptures"), c("coverage")
    )


def gate_markdown(gate: DataFrame, title: str = "Quality gate") -> str:
    """The lines that a CI run's summary gets from the row of ``quality_gate``."""
    r = gate.first()
    verdict = "PASSED" if r["passed"] else "FAILED"
    return f"## {title}\n\n| total | critical | serious | verdict |\n|---|---|---|---|\n| {r['total']} | {r['critical']} | {r['serious']} | {verdict} |\n"


def dashboard(findings: DataFrame, title: str = "Dashboard") -> str:
    """The dashboard's page: findings by impact and by engine, absent values under their labels."""
    from auditlake.operators.metrics import count_by, histogram

    # what the findings are made of is computed once
    both = settled(findings.select("impact", "engine"), "counted")
    impacts = histogram(both).orderBy(F.desc("n"), "value")
    engines = count_by(both, "engine", "desconocido").orderBy(F.desc("n"), "value")
    return html(title, {"Impacto": impacts, "Motor": engines})


def write_text(spark: SparkSession, path: str, text: str) -> None:
    _write_file(spark.createDataFrame([(text,)], "value string"), path)


def dated_copy(spark: SparkSession, files: list[str], folder: str, day: str) -> list[str]:
    """Copies artifacts to ``folder/day`` and returns their new paths."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    out = []
    for path in files:
        source, target = hadoop.Path(path), hadoop.Path(f"{folder.rstrip('/')}/{day}/{path.rstrip('/').rpartition('/')[2]}")
        hadoop.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
        out.append(target.toString())
    return out


def summary_rows(findings: DataFrame) -> DataFrame:
    """sheet, value and n of the workbook's summary: totals, and findings by severity, source, engine, level and principle."""
    from auditlake.operators.metrics import page_count, with_severity

    f = with_severity(findings)
    named = {"severidad": "severity", "origen": "source", "motor": "engine", "nivel": "nivel", "principio": "principio"}
    pairs = F.array(*(F.struct(F.lit(k).alias("sheet"), js_or(F.col(c), "sin_dato").alias("value")) for k, c in named.items()))
    each = f.select(F.explode(pairs).alias("p")).groupBy("p.sheet", "p.value").agg(F.count("*").alias("n"))
    whole = f.agg(F.count("*").alias("hallazgos"), page_count("pageUrl").alias("paginas"))
    both = whole.select(F.explode(F.array(*(F.struct(F.lit("resumen").alias("sheet"), F.lit(k).alias("value"), F.col(k).alias("n")) for k in ("hallazgos", "paginas")))).alias("p"))
    return each.unionByName(both.select("p.*"))


def write_json(findings: DataFrame, path: str, order: str = "_ord", *, single: bool = False) -> None:
    """One object a line, sorted by ``order``; in many files, for tables that one file must not hold, unless ``single``."""
    rows = findings.orderBy(order).drop(order)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").json(path)


def write_by_engine(findings: DataFrame, path: str) -> None:
    """A folder for each of the two engines; findings of others are left out."""
    findings.where(F.col("engine").isin("axe-core", "pa11y")).write.mode("overwrite").partitionBy("engine").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Adds to what is there."""
    rows.write.mode("append").json(path)


def markdown(title: str, sections: dict[str, DataFrame]) -> str:
    """Tables of small aggregates."""
    out = [f"# {title}"]
    for name, df in sections.items():
        rows = df.collect()  # aggregates of a few rows
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows]
    return "\n".join(out) + "\n"


def html(title: str, sections: dict[str, DataFrame]) -> str:
    """The same as an HTML page."""
    from html import escape

    out = [f'<!doctype html><html lang="es"><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>']
    for name, df in sections.items():
        head = "".join(f'<th scope="col">{escape(c)}</th>' for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.collect())
        out.append(f"<h2>{escape(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
    return "".join(out) + "</body></html>"


def url_list(pages: DataFrame, most: int = 80) -> DataFrame:
    """The first ``most`` pages by depth and address."""
    return pages.orderBy("depth", "node").limit(most).select(F.col("node").alias("url"))


def crawl_log(crawled: DataFrame) -> DataFrame:
    """A crawl's log: depth, address, title and result of every page, in order."""
    result = F.when(F.col("ok"), "OK").otherwise("ERROR")
    return crawled.select("depth", "url", "title", result.alias("result")).orderBy("depth", "url")
