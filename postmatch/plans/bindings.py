"""The logical tables expressed over the driver's star schema, in Spark and as SQL text.

Each `*_SQL` constant is a list of common table expressions that defines the same rows as the
function beside it, so that a query and its SQL twin start from one definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmatch.plans import names as N
from postmatch.session import ensure_utc

NOW = "2024-01-31 00:00:00"
DAYS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with wall-clock timestamps read as UTC instants."""
    ensure_utc(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    for column in plain:
        df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df


def documents_to(docs: DataFrame) -> int:
    """One more than the largest document id: other keys are folded onto documents by this modulus."""
    return (docs.agg(F.max("doc_id")).first()[0] or 0) + 1


def case(column: Column, values: dict, default=None) -> Column:
    out = None
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)) if out is None else out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(default))


# profiles -----------------------------------------------------------------------------------------
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    created = F.timestamp_add("DAY", (key % 25).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return table(spark, sf_dir, "customer").select(
        key.alias("profile_id"),
        F.concat(F.lit("a"), key.cast("string")).alias("user_id"),
        F.col("c_mktsegment").alias("course"),
        F.col("c_nationkey").alias("city"),
        created.alias("created_at"),
        F.when(key % 5 != 0, F.timestamp_add("DAY", (key % 9).cast("int"), created)).alias("activated_at"),
        F.when(key % 3 != 0, F.concat(F.lit("c"), key.cast("string"))).alias("chat_id"),
        (F.col("c_acctbal") >= 0).alias("active"),
        F.when(key % 41 == 0, created).alias("deleted_at"),
        case(key % 4, {1: "conseguiu_estagio", 2: "sem_vagas_uteis", 3: "outro"}).alias("pause_reason"),
    )


PROFILES_SQL = """v_profiles as (
  select c_custkey as profile_id, 'a' || c_custkey as user_id, c_mktsegment as course,
    c_nationkey as city,
    timestamp '2024-01-01' + to_days((c_custkey % 25)::int) as created_at,
    case when c_custkey % 5 <> 0 then timestamp '2024-01-01'
      + to_days((c_custkey % 25)::int) + to_days((c_custkey % 9)::int) end as activated_at,
    case when c_custkey % 3 <> 0 then 'c' || c_custkey end as chat_id,
    c_acctbal >= 0 as active,
    case when c_custkey % 41 = 0 then timestamp '2024-01-01' + to_days((c_custkey % 25)::int) end as deleted_at,
    case c_custkey % 4 when 1 then 'conseguiu_estagio' when 2 then 'sem_vagas_uteis' when 3 then 'outro' end as pause_reason
  from customer)"""


# events -------------------------------------------------------------------------------------------
NAME_OF_TYPE = {
    "view": N.OPENED,
    "click": N.USEFUL,
    "error": N.IRRELEVANT,
    "purchase": N.APPLIED,
    "signup": N.LANDING,
}
REASON_OF_VALUE = {
    0: N.REASON_AREA,
    1: N.REASON_SCORE,
    2: N.REASON_REPEATED,
    3: N.REASON_CLOSED,
    4: "motivo_outro",
}


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_events(spark, sf_dir)
    k, eid, uid = F.col("k"), F.col("event_id"), F.col("user_id").cast("string")
    day = F.date_format("ts", "yyyyMMdd")
    landing = F.col("event_type") == "signup"
    properties = {
        "host": F.when(landing, F.when(k % 23 == 0, "localhost").otherwise("site.example")),
        "pagina": F.when(landing, F.when(k % 19 == 0, "/home/x").otherwise("/")),
        "utm_source": F.when(landing & (k % 4 == 0), F.concat(F.lit("news"), (k % 3).cast("string"))),
        "referrer_dominio": F.when(
            landing & (k % 4 == 1), F.concat(F.lit("ref"), (k % 5).cast("string"), F.lit(".example"))
        ),
        N.REASON_KEY: F.when(
            F.col("event_type") == "error", case(F.floor("value").cast("int") % 6, REASON_OF_VALUE)
        ),
    }
    entries = [item for key, value in properties.items() for item in (F.lit(key), value)]
    return raw.select(
        eid.alias("id"),
        case(F.col("event_type"), NAME_OF_TYPE).alias("name"),
        F.when(landing, F.lit("web")).otherwise(F.lit("telegram")).alias("origin"),
        F.when(eid % 4 == 0, F.lit(None).cast("string"))
        .when(eid % 11 == 0, F.concat(F.lit("shared"), day))
        .otherwise(F.concat(uid, F.lit("-"), day))
        .alias("session_id"),
        F.when(eid % 7 == 0, F.concat(F.lit("a"), uid)).alias("user_id"),
        F.when(~landing, F.col("user_id")).alias("profile_id"),
        F.when(~landing, k).alias("posting_id"),
        F.create_map(*entries).alias("properties"),
        F.col("ts").alias("occurred_at"),
    )


EVENTS_SQL = """v_raw as (
  select *, json_extract_string(props, '$.k')::bigint as k, strftime(ts, '%Y%m%d') as day from events),
v_events as (
  select event_id as id,
    case event_type when 'view' then 'vaga_aberta' when 'click' then 'vaga_util'
      when 'error' then 'vaga_irrelevante' when 'purchase' then 'candidatura_iniciada'
      when 'signup' then 'landing_visualizada' end as name,
    case when event_type = 'signup' then 'web' else 'telegram' end as origin,
    case when event_id % 4 = 0 then null when event_id % 11 = 0 then 'shared' || day
      else user_id || '-' || day end as session_id,
    case when event_id % 7 = 0 then 'a' || user_id end as user_id,
    case when event_type <> 'signup' then user_id end as profile_id,
    case when event_type <> 'signup' then k end as posting_id,
    case when event_type = 'signup' then case when k % 23 = 0 then 'localhost' else 'site.example' end end as host,
    case when event_type = 'signup' then case when k % 19 = 0 then '/home/x' else '/' end end as pagina,
    case when event_type = 'signup' and k % 4 = 0 then 'news' || (k % 3) end as utm_source,
    case when event_type = 'signup' and k % 4 = 1 then 'ref' || (k % 5) || '.example' end as referrer,
    case when event_type = 'error' then case floor(value)::int % 6 when 0 then 'motivo_area'
      when 1 then 'motivo_nota' when 2 then 'motivo_repetida' when 3 then 'motivo_encerrada'
      when 4 then 'motivo_outro' end end as reason,
    ts as occurred_at
  from v_raw)"""


# deliveries ---------------------------------------------------------------------------------------
def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_events(spark, sf_dir).filter(F.col("event_id") % 3 == 0)
    return raw.groupBy(F.col("user_id").alias("profile_id"), F.col("k").alias("posting_id")).agg(
        F.min("ts").alias("sent_at"),
        F.concat(F.lit("t"), F.min("event_id").cast("string")).alias("token"),
        F.when(F.min("event_id") % 5 == 0, F.max("ts")).alias("asked_at"),
    )


DELIVERIES_SQL = """v_deliveries as (
  select user_id as profile_id, k as posting_id, min(ts) as sent_at, 't' || min(event_id) as token,
    case when min(event_id) % 5 = 0 then max(ts) end as asked_at
  from v_raw where event_id % 3 = 0 group by 1, 2)"""


# stored postings with their extraction --------------------------------------------------------------
def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, words = F.col("p_partkey"), F.split("p_name", " ")
    skills = F.when(key % 4 == 1, F.array().cast("array<string>")).when(key % 4 == 2, words)
    return table(spark, sf_dir, "part").select(
        key.alias("posting_id"),
        (key % 4 != 0).alias("extracted"),
        F.when(
            key % 4 != 0,
            F.timestamp_add("HOUR", -(key % 1500).cast("int"), F.lit(NOW).cast("timestamp")),
        ).alias("extracted_at"),
        skills.when(key % 4 == 3, F.concat(words, F.array(F.lower("p_type")))).alias("required_skills"),
        F.when(key % 4 != 0, F.array(F.lower("p_type"), F.lower("p_brand"))).alias("areas"),
    )


STORED_SQL = """v_stored as (
  select p_partkey as posting_id, p_partkey % 4 <> 0 as extracted,
    case when p_partkey % 4 <> 0 then timestamp '2024-01-31' - to_hours((p_partkey % 1500)::int) end as extracted_at,
    case p_partkey % 4 when 1 then []::varchar[] when 2 then string_split(p_name, ' ')
      when 3 then list_append(string_split(p_name, ' '), lower(p_type)) end as required_skills,
    case when p_partkey % 4 <> 0 then [lower(p_type), lower(p_brand)] end as areas
  from part)"""


LOCAL_DAY_SQL = "timezone('America/Sao_Paulo', timezone('UTC', {}))"


def local_sql(column: str) -> str:
    return LOCAL_DAY_SQL.format(column)


# the funnel's shared frames, as SQL -----------------------------------------------------------------
CLEAN_SQL = f"""{PROFILES_SQL}, {EVENTS_SQL}, {DELIVERIES_SQL}, {STORED_SQL},
v_local_sessions as (
  select distinct session_id from v_events where name = 'landing_visualizada' and session_id is not null
    and (host in ('localhost') or pagina like '/home/%')),
v_local_users as (
  select distinct e.user_id from v_events e join v_local_sessions s using (session_id) where e.user_id is not null),
v_clean as (
  select e.*, coalesce(e.user_id, p.user_id) as person_user
  from v_events e left join v_profiles p on p.profile_id = e.profile_id
  where e.occurred_at <= timestamp '{NOW}'
    and not exists (select 1 from v_local_sessions s where s.session_id = e.session_id)
    and not exists (select 1 from v_local_users u where u.user_id = coalesce(e.user_id, p.user_id))),
v_cohort as (
  select * from v_profiles where created_at between timestamp '{NOW}' - interval 30 day and timestamp '{NOW}'),
v_delivered as (
  select d.*, c.created_at from v_deliveries d join v_cohort c using (profile_id) where d.sent_at <= timestamp '{NOW}'),
v_first_deliveries as (
  select * from v_delivered where sent_at >= created_at
  qualify row_number() over (partition by profile_id order by sent_at, posting_id) = 1),
v_interactions as (
  select e.*, t.sent_at, t.created_at from v_clean e
  join v_delivered t on t.profile_id = e.profile_id and t.posting_id = e.posting_id
  where e.occurred_at >= t.sent_at),
v_first_opens as (
  select profile_id, occurred_at, created_at from v_interactions
  where name = 'vaga_aberta' and sent_at >= created_at
  qualify row_number() over (partition by profile_id order by occurred_at, id) = 1),
v_answers as (
  select profile_id, posting_id, name, reason, occurred_at, id from v_interactions
  where name in ('vaga_util', 'vaga_irrelevante')
  qualify row_number() over (partition by profile_id, posting_id order by occurred_at desc, id desc) = 1),
v_useful as (
  select profile_id, posting_id from v_answers where name = 'vaga_util'
  union select profile_id, posting_id from v_interactions where name = 'candidatura_iniciada'),
v_sessions as (
  select session_id, min(user_id) as owner from v_clean
  where session_id is not null and user_id is not null group by 1 having count(distinct user_id) = 1),
v_identified as (
  select e.*, coalesce('u:' || e.person_user, 'u:' || s.owner, 's:' || e.session_id) as person
  from v_clean e left join v_sessions s on s.session_id = e.session_id),
v_entries as (
  select person, min(occurred_at) as entered_at from v_identified where person is not null group by 1),
v_weeks as (
  select w::date as week,
    timezone('UTC', timezone('America/Sao_Paulo', w::timestamp)) as opens,
    timezone('UTC', timezone('America/Sao_Paulo', (w + interval 7 day)::timestamp)) as closes
  from generate_series(
    date_trunc('week', {local_sql(f"timestamp '{NOW}' - interval 30 day")}),
    date_trunc('week', {local_sql(f"timestamp '{NOW}'")}), interval 7 day) g(w)),
v_week_events as (
  select s.week, e.* from v_weeks s
  join v_clean e on e.occurred_at >= s.opens and e.occurred_at < s.closes
  join v_deliveries t on t.profile_id = e.profile_id and t.posting_id = e.posting_id
  where e.occurred_at >= t.sent_at),
v_week_useful as (
  select week, profile_id from (
    select week, profile_id, posting_id, name from v_week_events
    where name in ('vaga_util', 'vaga_irrelevante')
    qualify row_number() over (partition by week, profile_id, posting_id order by occurred_at desc, id desc) = 1)
  where name = 'vaga_util'
  union select week, profile_id from v_week_events where name = 'candidatura_iniciada'),
v_facts as (
  select s.week, s.closes > timestamp '{NOW}' as partial, p.profile_id, p.course,
    u.profile_id is not null as useful
  from v_weeks s join v_profiles p on p.activated_at < s.closes and p.activated_at <= timestamp '{NOW}'
  left join v_week_useful u on u.week = s.week and u.profile_id = p.profile_id),
v_grouped as (
  select e.profile_id, e.posting_id, e.sent_at,
    case when not v.extracted then 'sem_extracao' when len(v.required_skills) = 0 then 'sem_tecnologias'
      when len(v.required_skills) <= 2 then 'uma_ou_duas' else 'tres_ou_mais' end as "group"
  from v_deliveries e join v_stored v using (posting_id)
  where e.sent_at between timestamp '{NOW}' - interval 30 day and timestamp '{NOW}'
  qualify row_number() over (partition by profile_id, posting_id order by sent_at) = 1),
v_period_answers as (
  select e.* from v_clean e join v_grouped t on t.profile_id = e.profile_id and t.posting_id = e.posting_id
  where e.name in ('vaga_util', 'vaga_irrelevante') and e.occurred_at >= t.sent_at
  qualify row_number() over (partition by e.profile_id, e.posting_id order by e.occurred_at desc, e.id desc) = 1)"""


def with_clean(select: str) -> str:
    return f"with {CLEAN_SQL} {select}"


# busy sessions ------------------------------------------------------------------------------------
def busy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as web events of few sessions and accounts within little more than an hour, so that every limit refuses some."""
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    eid, uid = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        eid.alias("id"),
        F.timestamp_micros(start + F.floor((F.unix_micros("ts") - start) / F.lit(600))).alias("occurred_at"),
        F.when(eid % 4 != 0, F.concat(F.lit("s"), (uid % 25).cast("string"))).alias("session_id"),
        F.when(eid % 2 == 0, F.concat(F.lit("a"), (uid % 60).cast("string"))).alias("user_id"),
    )


BUSY_SQL = """v_busy as (
  select event_id as id, timestamp '2024-01-01' + to_microseconds((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 600) as moment,
    case when event_id % 4 <> 0 then 's' || (user_id % 25) end as s, case when event_id % 2 = 0 then 'a' || (user_id % 60) end as u from events)"""
