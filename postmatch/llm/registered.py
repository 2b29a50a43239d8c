"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from postmatch.llm import decontamination, filter_audit, jaccard, langid, licenses, near_vectors, neighbours, packing, quality, repeats, spelling, token_counts, warc
from postmatch.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Folder of public tokenizer vocabularies.
TOKENIZERS = os.environ.get("POSTMATCH_TOKENIZERS", "/opt/tokenizers")


def register(name: str, oracle: str | None = None):
    def add(query):
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return add


@register(
    "op7_warc",
    """
    with p as (
      select page_id, coalesce(html, '') as body, octet_length(encode(coalesce(html, ''))) as n,
             sha256(coalesce(html, '')) as digest
      from pages),
    o as (select digest, min(page_id) as owner from p where n >= 100 group by digest)
    select p.page_id, cast(p.n as bigint) as payload_bytes, p.digest as payload_digest,
           case when p.n >= 100 and p.page_id > o.owner then 'revisit' else 'response' end as record_type,
           case when p.n >= 100 and p.page_id > o.owner then o.owner end as refers_to, true as intact
    from p left join o on p.digest = o.digest
    """,
)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@register("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op10_langid")
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def _templates_sql() -> str:
    """The scan with all templates in the text of the query."""
    rows = ", ".join(f"('{name}', '{text.replace(chr(39), 2 * chr(39))}')" for name, text in licenses.template_rows())
    words = r"""list_filter(list_transform(string_split(lower(regexp_replace({t}, '[\x09-\x0D\x20]+', ' ', 'g')), ' '),
        lambda w: regexp_replace(regexp_replace(w, '^[\pP\pS]+', ''), '[\pP\pS]+$', '')), lambda w: w <> '')"""
    grams = """list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1),
        lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))"""
    return f"""
    with t as (select license_id, {words.format(t="txt")} as w from (values {rows}) v(license_id, txt)),
    tg as (select license_id, row_number() over () as template, {grams} as g from (select distinct license_id, w from t) where len(w) > 0),
    d as (select row_number() over () as r, doc_id, {words.format(t="text")} as w from documents),
    dg as (select r, doc_id, unnest({grams}) as g from d where len(w) > 0),
    hit as (select r, doc_id, license_id, template, size, count(*) as n from dg
            join (select license_id, template, len(g) as size, unnest(g) as g from tg) using (g) group by all)
    select doc_id, license_id, max(n / size) as containment from hit where n / size >= 0.75 group by r, doc_id, license_id
    """


@register("op3_licenses", _templates_sql())
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), licenses.license_templates(spark))
    return found.select("doc_id", "license_id", "containment")


@register("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/{token_counts.VOCABULARY}")


@register("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


@register("op1_repeats")
def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


@register("op4_jaccard")
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


@register("op6_neighbours")
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


@register("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op11_spelling", spelling.SQL)
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


@register("op12_near_vectors", near_vectors.SQL)
def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@register("op13_filter_audit", filter_audit.SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
