"""The queries of this subpackage: one thin query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import crc_of_id, table
from auditlake.llm.urlrules import RULES
from auditlake.session import ship


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditlake.llm.decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditlake.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditlake.llm.urlrules import judge

    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).drop("confidence")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditlake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op5_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditlake.llm.pieces import count_pieces

    return count_pieces(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditlake.llm.katz import score

    return score(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditlake.llm.warcz import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditlake.llm.wavelet import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditlake.llm.simhash import hex_of, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditlake.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.pmod(crc_of_id("doc_id"), F.lit(4)) == 2).alias("held_out"), "score", "predicted")


def url_rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3 that SQL can say: hosts, paths and the list's rule."""
    from auditlake.llm.urlrules import host_of, listed_rule, path_of

    parts = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.withColumn("rule", listed_rule(F.col("host"), F.col("path"))[0])


_OPERATORS = [
    op1_decontamination,
    op2_ann,
    op3_url_rules,
    op4_packing,
    op5_piece_counts,
    op6_katz,
    op7_warc,
    op8_token_shards,
    op9_simhash,
    op10_toxicity,
    url_rule_list,
]


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {q.__name__: _shipped(q) for q in _OPERATORS}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_URL_RULES = " ".join(
    f"when (host = '{on}' or host like '%.{on}') and path like '{under}%' then '{on}{under}'" for _, on, under in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
)
ORACLES: dict[str, str] = {
    "op1_decontamination": f"""
        with w as (select item_id::varchar as item_id, {_WORDS} as ws from benchmark), b as (select item_id, ws, least(10, len(ws)) as n from w where len(ws) > 0),
        windows as (select distinct item_id, n, array_to_string(ws[p : p + n - 1], ' ') as key from (select *, unnest(range(1, len(ws) - n + 2)) as p from b)),
        d as (select row_number() over () as row, doc_id, {_WORDS} as ws from documents), sizes as (select distinct n from windows),
        stretches as (select row, n, p, array_to_string(ws[p : p + n - 1], ' ') as key from (select row, ws, n, unnest(range(1, len(ws) - n + 2)) as p from d, sizes where len(ws) >= n)),
        found as (select row, s.n, p, item_id from stretches as s join windows as x on x.n = s.n and x.key = s.key),
        hits as (select row, count(distinct q) as n_hit from (select row, unnest(range(p, p + n)) as q from found) group by row),
        items as (select row, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct row, item_id from found where item_id is not null) group by row)
        select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join hits on hits.row = d.row left join items on items.row = d.row
    """,
    "url_rule_list": f"""
        select page_id, host, path, case {_URL_RULES} end as rule from (select page_id,
            translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages)
    """,
    "op7_warc": """
        select page_id, cast(strlen(body) as bigint) as payload_bytes, sha256(body) as payload_digest,
            case when strlen(body) >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
            case when strlen(body) >= 100 and page_id <> first_id then first_id end as refers_to
        from (select page_id, body, min(page_id) over (partition by body) as first_id
              from (select page_id, coalesce(html, '') as body from pages) as p) as q
    """,
}
