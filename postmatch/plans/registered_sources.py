"""Registered queries of sources, pages, text flags and the streaming ingest."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmatch.functions import text as T
from postmatch.functions.dates import local_date, publication_date
from postmatch.operators import operations as O
from postmatch.plans import bindings as B
from postmatch.plans import bindings_matching as M
from postmatch.plans import names as N
from postmatch.plans.registry import register
from postmatch.sources import json_sources as J
from postmatch.sources import pages as P
from postmatch.sources import tables
from postmatch.streaming import ingest


# JSON records ---------------------------------------------------------------------------------------
def _raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source C records made of events; some lack a field or are broken text."""
    eid = F.col("event_id")
    record = F.concat(
        F.lit('{"id": '), F.when(eid % 7 == 0, "null").otherwise((-eid).cast("string")),
        F.lit(', "title": "<b>'), F.col("event_type"), F.lit('</b> one", "company": "'), F.when(eid % 5 == 0, "").otherwise("Firm"),
        F.lit('", "location": " Rio ", "snippet": "a   b", "source": "'), F.when(eid % 3 == 0, "").otherwise(" Jobs.Example.COM "),
        F.lit('", "link": "https://x.example.com/1", "updated": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('.1234567"'),
        F.when(eid % 11 == 0, "").otherwise("}"),
    )
    return B.table(spark, sf_dir, "events").select(eid.alias("event_id"), record.alias("raw"), eid.alias("arrival"))


GOOD_SQL = "event_id % 11 <> 0 and event_id % 7 <> 0"


@register(
    "json_source_records",
    f"""select (-event_id)::varchar as external_id, event_type || ' one' as title,
  case when event_id % 5 = 0 then 'Empresa não informada' else 'Firm' end as company, 'Rio' as location, 'a b' as description,
  case when event_id % 3 <> 0 then 'jobs.example.com' end as domain, date_trunc('second', ts) + interval 123456 microsecond as published_at,
  false as description_complete from events where {GOOD_SQL}""",
)
def json_source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = J.split_malformed(J.parse_records(_raw_records(spark, sf_dir), J.SOURCE_C_RECORD), J.REQUIRED_C)
    return J.postings_from_c(good).select(
        "external_id", "title", "company", "location", "description", F.col("origin.domain").alias("domain"),
        "published_at", "description_complete",
    )


@register(
    "quarantined_records",
    f"select event_id, event_id % 11 = 0 as broken from events where not ({GOOD_SQL})",
)
def quarantined_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = J.split_malformed(J.parse_records(_raw_records(spark, sf_dir), J.SOURCE_C_RECORD), J.REQUIRED_C)
    return bad.select("event_id", F.col("record").isNull().alias("broken"))


@register(
    "recent_postings",
    """select doc_id, by_day from (select doc_id, timestamp '2024-01-01' + to_hours((doc_id % 700)::int) as moment, unnest([true, false]) as by_day from documents)
where case when by_day then moment::date >= date '2024-01-20' else moment >= timestamp '2024-01-20 15:30:00' end""",
)
def recent_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_add("HOUR", (F.col("doc_id") % 700).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    rows = B.table(spark, sf_dir, "documents").select("doc_id", at.alias("published_at"))
    parts = [J.recent(rows, "2024-01-23 15:30:00", 3, day).withColumn("by_day", F.lit(day)) for day in (True, False)]
    return parts[0].unionByName(parts[1]).select("doc_id", "by_day")


@register(
    "source_union_status",
    """select lang as source, 'ok' as state, count(*) as rows, min(doc_id) as first from documents where lang in ('en', 'fr', 'es') group by 1
union all select 'de', 'partial', count(*), min(doc_id) from documents where lang = 'de' union all select 'xx', 'failed', 0, null""",
)
def source_union_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents")
    collected = {
        lang: docs.filter(F.col("lang") == lang).select(F.lit(lang).alias("source"), F.col("doc_id").alias("seq"))
        for lang in ("en", "fr", "de", "es")
    }
    rows, status = tables.union_sources({**collected, "xx": None}, {"de": "page 3", "xx": "down"})
    counted = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.col("seq") % (1 << 40)).alias("first")
    )
    joined = status.join(counted, "source", "left")
    return joined.select("source", "state", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "first")


# pages ----------------------------------------------------------------------------------------------
#: Tags as depths: the section runs from the article's start to where its depth is back at none.
PAGE_TEXT_SQL = r"""with s as (select page_id, substr(html, greatest(strpos(html, '<article'), 1)) as h, strpos(html, '<article') > 0 as has from pages),
tokens as (select page_id, unnest(regexp_extract_all(h, '<!--(?:[^-]|-[^-])*-->|<[^>]*>|[^<]+')) as t, generate_subscripts(regexp_extract_all(h, '<!--(?:[^-]|-[^-])*-->|<[^>]*>|[^<]+'), 1) as i from s where has),
named as (select *, lower(regexp_extract(t, '^</?([a-zA-Z0-9]+)', 1)) as tag from tokens),
deep as (
  select *, sum(case when t like '<!%' or left(t, 1) <> '<' or tag in {void} then 0 when t like '</%' then -1 else 1 end) over (partition by page_id order by i) as depth from named),
ended as (select page_id, min(i) as e from deep where depth <= 0 group by 1),
kept as (select d.* from deep d left join ended using (page_id) where e is null or d.i <= e),
joined as (
  select page_id, string_agg(case when left(t, 1) <> '<' then t when t not like '</%' and t not like '<!%' and tag in {breaking} and i > 1 then ' ' else '' end, '' order by i) as x from kept group by 1)
select page_id, coalesce(trim(regexp_replace({plain}, '[\s\x{A0}]+', ' ', 'g')), '') as section_text, null::varchar as partner, null::varchar as partner_id from s left join joined using (page_id)
"""


def _page_text_sql() -> str:
    plain = "x"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        plain = f"replace({plain}, '{entity}', '{char}')"
    names = lambda tags: "(" + ", ".join(f"'{t}'" for t in sorted(tags)) + ")"
    return PAGE_TEXT_SQL.replace("{void}", names(P.VOID_TAGS)).replace("{breaking}", names(P.BREAKING_TAGS)).replace("{plain}", plain)


@register("page_text", _page_text_sql())
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_pages(B.table(spark, sf_dir, "pages"), ["page_id"], "article", None)


@register(
    "page_clean_html",
    r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) as cleaned from pages""",
)
def page_clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", T.clean_html(F.col("html")).alias("cleaned"))


HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@register("page_host", f"select page_id, regexp_replace({HOST_SQL}, '^www\\.', '') as host from pages")
def page_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", T.url_host(F.col("url"), F.lit("none")).alias("host"))


@register(
    "visit_attribution",
    f"""select page_id, left(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), 20) as pagina,
  left({HOST_SQL}, 30) as host, nullif(left(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), 20), '') as utm_source from pages""",
)
def visit_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return B.table(spark, sf_dir, "pages").select(
        "page_id",
        F.left(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit(20)).alias("pagina"),
        T.origin_label(F.try_parse_url(url, F.lit("HOST")), 30).alias("host"),
        T.origin_label(F.try_parse_url(url, F.lit("QUERY"), F.lit("utm_source")), 20).alias("utm_source"),
    )


@register(
    "origin_counts",
    """with o as (select case doc_id % 4 when 0 then 'jobs.gupy.io' when 1 then 'linkedin.com' when 2 then 'ok.example' else '' end as domain from documents)
select domain, case when domain = 'jobs.gupy.io' then 'os termos da Gupy proíbem agregar, copiar ou duplicar as vagas dela'
  when domain = 'linkedin.com' then 'o LinkedIn bloqueia coleta automatizada e está fora do escopo do projeto' end as block_reason, count(*) as total from o group by 1, 2""",
)
def origin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postmatch.operators.candidates import origin_status

    domain = B.case(F.col("doc_id") % 4, {0: "jobs.gupy.io", 1: "linkedin.com", 2: "ok.example"})
    none = F.lit(None).cast("string")
    rows = B.table(spark, sf_dir, "documents").select(
        "source", F.struct(none.alias("partner"), none.alias("partner_id"), domain.alias("domain")).alias("origin")
    )
    return O.origin_counts(origin_status(rows))


def _paged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("doc_id")
    none = F.lit(None).cast(J.NO_ORIGIN)
    postings = B.table(spark, sf_dir, "documents").select(
        F.when(key % 2 == 0, "adzuna").otherwise("gupy").alias("source"),
        key.cast("string").alias("external_id"),
        F.lit("old").alias("description"),
        F.lit(False).alias("description_complete"),
        none.alias("origin"),
    )
    pages = B.table(spark, sf_dir, "pages").select(
        F.lit("adzuna").alias("source"), (F.col("page_id") * 2).cast("string").alias("external_id"), "html"
    )
    return postings, P.parse_pages(pages, ["source", "external_id"], "article", None)


@register(
    "enrich_from_pages",
    """select case when doc_id % 2 = 0 then 'adzuna' else 'gupy' end as source, doc_id::varchar as external_id,
  coalesce(p.page_id is not null and doc_id % 2 = 0, false) as description_complete, doc_id % 2 = 0 and p.page_id is null as page_unread
from documents left join pages p on p.page_id * 2 = doc_id""",
)
def enrich_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, parsed = _paged(spark, sf_dir)
    enriched = P.enrich_from_pages(postings, parsed)
    replaced = P.replace_enriched(postings, enriched)
    unread = enriched.select("source", "external_id", "page_unread")
    return replaced.join(unread, ["source", "external_id"]).select(
        "source", "external_id", "description_complete", "page_unread"
    )


@register(
    "pages_without_origin",
    """select count(*) as pages_read, count(*) as pages_without_origin from documents d join pages p on p.page_id * 2 = d.doc_id""",
)
def pages_without_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, parsed = _paged(spark, sf_dir)
    return P.pages_without_origin(postings, P.enrich_from_pages(postings, parsed).drop("page_unread"))


@register(
    "lost_unread_page",
    """select distinct o_custkey as profile_id from orders o join documents d on d.doc_id = o.o_orderkey % (select max(doc_id) + 1 from documents)
where d.doc_id % 2 = 0 and not exists (select 1 from pages p where p.page_id * 2 = d.doc_id)""",
)
def lost_unread_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, parsed = _paged(spark, sf_dir)
    unread = P.enrich_from_pages(postings, parsed).filter("page_unread")
    pairs = B.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("profile_id"),
        (F.col("o_orderkey") % B.documents_to(B.table(spark, sf_dir, "documents"))).cast("string").alias("external_id"),
    )
    return O.lost_unread_page(pairs, unread, ["external_id"])


@register(
    "page_addresses",
    """select doc_id, case when doc_id % 3 = 0 then 'https://www.example.com/details/' || doc_id || '%20a' else 'https://www.example.com/other/x' end as address from documents""",
)
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("doc_id") % 3 == 0, "//Land//ad/9").otherwise("/other/x")
    url = F.concat(F.lit("https://www.example.com"), path)
    identifier = F.concat(F.col("doc_id").cast("string"), F.lit(" a"))
    return B.table(spark, sf_dir, "documents").select("doc_id", P.page_url(url, identifier).alias("address"))


# text flags -----------------------------------------------------------------------------------------
@register(
    "text_flags",
    f"""with d as (select doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) as spaced, replace(text, chr(10), '') as flat from documents),
e as (select *, replace(replace(replace(replace(replace(spaced, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as escaped from d)
select doc_id, length(text) >= 500 or regexp_matches(rtrim(text), '(…|\\.\\.\\.)$') as truncated,
  case when length(spaced) <= 2500 then spaced else left(spaced, 2500) || ' […]' end as summary,
  case when length(escaped) <= 80 then escaped else rtrim(regexp_replace(left(escaped, 80), '&[#a-zA-Z0-9]*$', '')) || '…' end as short,
  case when doc_id % 2 = 0 then 'remoto' end as mode from e""",
)
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    spelled = F.when(F.col("doc_id") % 2 == 0, " Remôto ").otherwise("other")
    return B.table(spark, sf_dir, "documents").select(
        "doc_id",
        T.is_truncated(text).alias("truncated"),
        T.summarize(text).alias("summary"),
        T.escape_truncate(text, 80).alias("short"),
        T.recognize_mode(spelled).alias("mode"),
    )


@register(
    "title_without_suffix",
    f"""select doc_id, {M.fold_sql("trim(regexp_replace(text, '\\s+', ' ', 'g'))")} as bare from documents""",
)
def title_without_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.trim(F.regexp_replace("text", r"\s+", " "))
    suffix = B.case(F.col("doc_id") % 3, {0: " - Vaga", 1: " – vaga aberta "}, " - Recrutamento aberto")
    docs = B.table(spark, sf_dir, "documents").withColumn("t", F.concat(title, suffix))
    return docs.select("doc_id", T.strip_aggregator_suffix(T.fold_text(F.col("t"))).alias("bare"))


@register(
    "event_days",
    f"""select event_id, ({B.local_sql('ts')})::date as local_day,
  case when date_trunc('day', m) = m then m::date else ({B.local_sql('m')})::date end as published_on
from (select *, case when event_id % 2 = 0 then date_trunc('day', ts) else ts end as m from events)""",
)
def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    moment = F.when(F.col("event_id") % 2 == 0, F.date_trunc("day", "ts")).otherwise(F.col("ts"))
    return B.table(spark, sf_dir, "events").select(
        "event_id", local_date(F.col("ts")).alias("local_day"), publication_date(moment).alias("published_on")
    )


# streaming ------------------------------------------------------------------------------------------
def ingest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the rows a site and a chat would send."""
    events = B.events(spark, sf_dir)
    owner = F.concat(F.lit("a"), F.col("profile_id").cast("string"))
    web = F.col("origin") == "web"
    return events.select(
        "id", "name", "origin",
        F.when(web, F.coalesce("session_id", F.lit("none"))).alias("session_id"),
        F.when(web, F.col("user_id")).otherwise(owner).alias("user_id"),
        "profile_id", "posting_id",
        F.when(F.col("name") == N.LANDING, '{"host": "site.example"}').otherwise("{}").alias("properties_json"),
        "occurred_at",
    )


STREAM_ORACLE = f"""with {B.PROFILES_SQL}, {B.EVENTS_SQL}, o as (
  select e.*, exists (select 1 from v_profiles p where p.profile_id = e.profile_id and p.active and p.deleted_at is null and p.chat_id is not null) as ok
  from v_events e)
select id, case when origin = 'web' then 'accepted' when not ok then 'profile_unavailable'
  when name = 'vaga_aberta' and row_number() over (partition by ok, name, profile_id, posting_id order by id) > 1 then 'repeated'
  else 'accepted' end as verdict from o"""


@register("stream_ingest", STREAM_ORACLE)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log ingested as a file stream: accepted and rejected rows per reason."""
    root = _scratch(spark)
    ingest_source(spark, sf_dir).write.parquet(f"{root}/in")
    stream = ingest.read_event_files(spark, f"{root}/in")
    query = ingest.start_ingest(stream, lambda: B.profiles(spark, sf_dir), f"{root}/out", f"{root}/state")
    query.awaitTermination()
    accepted = spark.read.parquet(f"{root}/out/accepted").select("id", F.lit("accepted").alias("verdict"))
    rejected = spark.read.parquet(f"{root}/out/rejected").select("id", F.col("reason").alias("verdict"))
    return accepted.unionByName(rejected)


def _scratch(spark: SparkSession) -> str:
    """A new folder below the session's shared checkpoint folder, or a local one in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        return tempfile.mkdtemp(prefix="postmatch-stream-")
    return os.path.join(shared, "postmatch-stream", spark.sparkContext.applicationId, uuid.uuid4().hex)
