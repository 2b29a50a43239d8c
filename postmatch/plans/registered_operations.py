"""Registered queries of deliveries, marks, sheets, account events and stored extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmatch.operators import candidates as C
from postmatch.operators import evaluation, limits, operations, quality, writes
from postmatch.plans import bindings as B
from postmatch.plans import bindings_matching as M
from postmatch.plans.registry import register

DAY = "2024-01-31"


# who may be served ----------------------------------------------------------------------------------
@register(
    "still_deliverable",
    f"""with {B.PROFILES_SQL}, o as (select o_orderkey, o_custkey as profile_id, case when o_orderkey % 5 = 0 then 'old' else 'c' end || o_custkey as chat_id from orders)
select o.o_orderkey, o.profile_id from o join v_profiles p on p.profile_id = o.profile_id and p.chat_id = o.chat_id where p.active and p.deleted_at is null""",
)
def still_deliverable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose profile is still active and on the chat that it had when they were made."""
    key = F.col("o_custkey").cast("string")
    outcomes = B.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("profile_id"), F.concat(F.when(F.col("o_orderkey") % 5 == 0, "old").otherwise("c"), key).alias("chat_id")
    )
    return operations.still_deliverable(outcomes, B.profiles(spark, sf_dir)).select("o_orderkey", "profile_id")


SERVED_SQL = f"""v_served as (
  select p.*, case when p.profile_id % 6 = 0 then date '{DAY}' when p.profile_id % 6 = 1 then date '2024-01-30' end as last_day_served,
    case when p.profile_id % 4 = 0 then timestamp '{DAY} 08:00:00' end as dispatched_at, case when p.profile_id % 10 = 0 then timestamp '{DAY} 09:00:00' end as attended_at,
    case when p.profile_id % 9 = 0 then timestamp '2024-01-02 00:00:00' end as silence_warned_at from v_profiles p)"""


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("profile_id")
    return B.profiles(spark, sf_dir).withColumns(
        {
            "last_day_served": F.when(key % 6 == 0, DAY).when(key % 6 == 1, "2024-01-30").cast("date"),
            "dispatched_at": F.when(key % 4 == 0, f"{DAY} 08:00:00").cast("timestamp"),
            "attended_at": F.when(key % 10 == 0, f"{DAY} 09:00:00").cast("timestamp"),
            "silence_warned_at": F.when(key % 9 == 0, "2024-01-02 00:00:00").cast("timestamp"),
        }
    )


@register(
    "immediate_run",
    f"""with {B.PROFILES_SQL}, {SERVED_SQL}, runs as (
  select 'dispatched' as run, * from v_served where dispatched_at is not null union all
  select 'one', * from v_served where dispatched_at is not null or profile_id = 21 union all
  select 'daily one', * from v_served where profile_id = 21)
select run, profile_id from runs where last_day_served is distinct from date '{DAY}' and (run = 'daily one' or attended_at is null)""",
)
def immediate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of an immediate run, with and without one asked for, and of a daily run for one profile."""
    rows = _served(spark, sf_dir)
    runs = (("dispatched", True, None), ("one", True, 21), ("daily one", False, 21))
    parts = [operations.profiles_to_serve(rows, DAY, now, only).select(F.lit(name).alias("run"), "profile_id") for name, now, only in runs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "allowed_interests",
    f"""with {M.CITY_SQL}, {M.PEOPLE_SQL} select profile_id, case when area = 'construcao' and interest in ('obras', 'maquinas') or area = 'casa' and interest = 'decoracao'
  then [interest] else []::varchar[] end as interest_areas from v_people""",
)
def allowed_interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = M.people_courses(spark, sf_dir).select("course", "area")
    people = M.people(spark, sf_dir).join(named, "course", "left")
    rows = [(area.name, [value for value, _ in area.subareas]) for area in M.CATALOG.areas]
    subareas = spark.createDataFrame(rows, "area string, values array<string>")
    return operations.allowed_interests(people, subareas).select("profile_id", "interest_areas")


# marks ----------------------------------------------------------------------------------------------
@register(
    "profile_marks",
    f"""with {B.PROFILES_SQL}, {SERVED_SQL}, f as (select distinct o_custkey as profile_id from orders where o_orderstatus = 'F'),
a as (select distinct o_custkey as profile_id from orders where o_orderstatus = 'P')
select p.profile_id, case when f.profile_id is not null then date '{DAY}' else last_day_served end as last_day_served,
  case when f.profile_id is not null then coalesce(attended_at, timestamp '{B.NOW}') else attended_at end as attended_at,
  case when a.profile_id is not null then timestamp '{B.NOW}' else silence_warned_at end as silence_warned_at
from v_served p left join f on f.profile_id = p.profile_id left join a on a.profile_id = p.profile_id""",
)
def profile_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles marked as served, attended once and warned of silence; the same marks again change nothing."""
    orders = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile_id"), "o_orderstatus")
    served, warned = orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'P'")
    rows = _served(spark, sf_dir)
    for _ in range(2):
        rows = writes.mark_silence_warned(writes.mark_attended(writes.mark_served(rows, served, DAY), served, B.NOW), warned, B.NOW)
    return rows.select("profile_id", "last_day_served", "attended_at", "silence_warned_at")


@register(
    "upsert_extractions",
    f"""with l as (select doc_id, max(case when quality = 1 then 'read ' || doc_id end) as extraction from labels group by 1)
select d.doc_id as posting, coalesce(l.extraction, case when d.doc_id % 3 = 0 then 'old' end) as extraction,
  case when l.extraction is not null then timestamp '{B.NOW}' when d.doc_id % 3 = 0 then timestamp '2024-01-01 00:00:00' end as extracted_at,
  case when l.extraction is not null then 'm2' when d.doc_id % 3 = 0 then 'm1' end as extraction_model
from documents d left join l on l.doc_id = d.doc_id""",
)
def upsert_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a run over stored postings; a reading that failed leaves the stored one."""
    doc = F.col("doc_id")
    old = doc % 3 == 0
    current = B.table(spark, sf_dir, "documents").select(
        doc.alias("posting"), F.lit("s").alias("source"), doc.cast("string").alias("external_id"),
        F.when(old, "old").alias("extraction"), F.when(old, "2024-01-01 00:00:00").cast("timestamp").alias("extracted_at"), F.when(old, "m1").alias("extraction_model"),
    )
    read = F.max(F.when(F.col("quality") == 1, F.concat(F.lit("read "), doc.cast("string"))))
    extracted = B.table(spark, sf_dir, "labels").groupBy("doc_id").agg(read.alias("extraction")).select(
        F.lit("s").alias("source"), doc.cast("string").alias("external_id"), "extraction"
    )
    return writes.upsert_extractions(current, extracted, "m2", B.NOW).select("posting", "extraction", "extracted_at", "extraction_model")


# accounts and profiles --------------------------------------------------------------------------------
@register(
    "account_events",
    """with v as (select 'a' || o_custkey as user_id, o_orderkey as version, timestamp '1990-01-01' as created_at, case when o_orderkey % 4 = 0 then o_orderdate::timestamp end as confirmed_at from orders),
w as (select *, row_number() over (partition by user_id order by version) = 1 as is_first, lag(confirmed_at) over (partition by user_id order by version) as before from v)
select 'conta_criada' as name, user_id, created_at as occurred_at from w where is_first
union all select 'email_confirmado', user_id, confirmed_at from w where confirmed_at is not null and (is_first or before is null)""",
)
def account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of account versions: created, and confirmed whenever a confirmation appears."""
    versions = B.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("user_id"), F.col("o_orderkey").alias("version"),
        F.lit("1990-01-01 00:00:00").cast("timestamp").alias("created_at"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate").cast("timestamp")).alias("confirmed_at"),
    )
    return limits.account_events(versions).select("name", "user_id", "occurred_at")


@register(
    "unreadable_profiles",
    """select c_custkey as profile_id, not (c_custkey % 29 = 0 or c_custkey % 31 = 0 or c_custkey % 37 = 0 or c_custkey % 41 = 0) as readable from customer""",
)
def unreadable_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored profiles that a run can read, and those that it skips."""
    key = F.col("profile_id")
    rows = M.people(spark, sf_dir).withColumns(
        {
            "course": F.when(key % 29 == 0, "  ").otherwise(F.col("course")),
            "period": F.when(key % 31 == 0, 0).otherwise(F.col("period")),
            "mode": F.when(key % 37 == 0, "anywhere").otherwise(F.col("mode")),
            "city": F.when(key % 41 == 0, "").otherwise(F.col("city")),
        }
    )
    good, bad = quality.readable_profiles(rows)
    return good.select("profile_id", F.lit(True).alias("readable")).unionByName(bad.select("profile_id", F.lit(False).alias("readable")))


@register(
    "discard_sheet",
    f"""with {M.MATCHING_SQL}, {M.PAIRS_SQL}, p_all as (select * from v_people), d_all as (
  select o.o_orderkey, p.profile_id, p.segment, p.city as p_city, p.mode as p_mode, p.is_technical, d.*, {M.REASON_SQL.replace('p.disability', 'null')} as reason
  from v_pairs o join v_posting_places d on d.seq = o.seq join p_all p on p.profile_id = o.profile_id)
select profile_id, case when is_technical then 'Técnico em ' else '' end || upper(left(segment, 1)) || lower(substr(segment, 2)) as course, p_mode as profile_mode,
  reason, source, external_id, source as company, ('https://posts.example.com/' || seq) as url, strftime(date '2024-01-01' + (seq % 30)::int, '%Y-%m-%d') as published_on,
  null::boolean as discard_correct, '' as comment from d_all where reason is not null""",
)
def discard_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discarded pairs for review, judged without the sensitive attribute."""
    keys = ["source", "external_id"]
    features, courses = M.features(spark, sf_dir), M.people_courses(spark, sf_dir)
    people = evaluation.without_sensitive(M.people_places(spark, sf_dir, courses))
    mentions = C.course_mentions(features, courses, keys).select(*keys, F.col("course").alias("p_course"), F.lit(True).alias("_mentioned"))
    joined = M.order_pairs(spark, sf_dir).join(features.drop("tails"), "seq").join(people, "p_profile_id").join(mentions, [*keys, "p_course"], "left")
    judged = joined.withColumn("reason", C.pair_reason(F.coalesce("_mentioned", F.lit(False)))).filter(F.col("reason").isNotNull())
    sheet = evaluation.discard_sheet(judged.select(
        F.col("p_profile_id").alias("profile_id"), F.col("p_course").alias("course"), F.col("p_city_name").alias("city"), "p_mode", "reason", *keys,
        "title", "company", "location", "url", "published_at",
    ))
    return sheet.drop("profile_city", "title", "location")
