"""Registered queries of the funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmatch.functions.dates import micros_between
from postmatch.plans import bindings as B
from postmatch.plans import funnel
from postmatch.plans.registry import register


class Frames:
    """The funnel's base frames over one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.profiles = B.profiles(spark, sf_dir)
        self.events = B.events(spark, sf_dir)
        self.deliveries = B.deliveries(spark, sf_dir)
        self.postings = B.stored_postings(spark, sf_dir)
        self.clean = funnel.clean_events(self.events, self.profiles, B.NOW)
        self.members = funnel.cohort(self.profiles, B.NOW, B.DAYS)
        self.delivered = funnel.cohort_deliveries(self.deliveries, self.members, B.NOW)
        self.interactions = funnel.pair_events(self.clean, self.delivered)


@register("last_answer", B.with_clean("select profile_id, posting_id, name, reason, occurred_at, id from v_answers"))
def last_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.last_answers(Frames(spark, sf_dir).interactions)


@register(
    "refusals_by_reason",
    B.with_clean(
        "select coalesce(reason, 'sem_motivo') as reason, count(*) as total"
        " from v_answers where name = 'vaga_irrelevante' group by 1"
    ),
)
def refusals_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.refusals_by_reason(Frames(spark, sf_dir).interactions)


@register("traffic_filter", B.with_clean("select id, name, session_id, person_user, occurred_at from v_clean"))
def traffic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Frames(spark, sf_dir).clean.select("id", "name", "session_id", "person_user", "occurred_at")


@register(
    "cohort_counts",
    B.with_clean(
        """select count(*) as profiles_created,
  count(*) filter (where chat_id is not null or exists (select 1 from v_clean e
    where e.profile_id = c.profile_id and e.name = 'telegram_vinculado')) as profiles_linked,
  count(*) filter (where activated_at <= timestamp '2024-01-31') as profiles_activated,
  count(*) filter (where not exists (select 1 from v_first_deliveries d where d.profile_id = c.profile_id)) as profiles_without_delivery,
  count(*) filter (where not exists (select 1 from v_first_opens o where o.profile_id = c.profile_id)) as profiles_without_open
from v_cohort c"""
    ),
)
def cohort_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frames(spark, sf_dir)
    return funnel.cohort_counts(f.members, f.clean, f.delivered, f.interactions, B.NOW)


@register(
    "current_pauses",
    f"""with {B.PROFILES_SQL} select coalesce(pause_reason, 'sem_motivo') as reason, count(*) as total
from v_profiles where not active and deleted_at is null group by 1""",
)
def current_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.current_pauses(B.profiles(spark, sf_dir))


@register(
    "visits_by_origin",
    B.with_clean(
        """select coalesce(utm_source, referrer, '(direto)') as visit_origin, count(*) as visits from v_clean
where name = 'landing_visualizada' and occurred_at >= timestamp '2024-01-31' - interval 30 day group by 1"""
    ),
)
def visits_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.visits_by_origin(Frames(spark, sf_dir).clean, B.NOW, B.DAYS)


@register("session_owner", B.with_clean("select session_id, owner from v_sessions"))
def session_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.session_owner(Frames(spark, sf_dir).clean)


@register("identity_resolution", B.with_clean("select id, person from v_identified"))
def identity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.identity_resolution(Frames(spark, sf_dir).clean).select("id", "person")


@register("first_seen", B.with_clean("select person, entered_at from v_entries"))
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.first_seen(funnel.identity_resolution(Frames(spark, sf_dir).clean))


@register(
    "funnel_steps",
    B.with_clean(
        """select name as step, count(distinct e.person) as persons from v_identified e join v_entries i using (person)
where i.entered_at >= timestamp '2024-01-31' - interval 30 day group by 1"""
    ),
)
def funnel_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.funnel_steps(Frames(spark, sf_dir).clean, B.NOW, B.DAYS)


@register(
    "first_delivery",
    B.with_clean("select profile_id, posting_id, sent_at, created_at from v_first_deliveries"),
)
def first_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.first_deliveries(Frames(spark, sf_dir).delivered)


@register(
    "first_delivery_median",
    B.with_clean(
        """select round(quantile_cont(epoch_us(sent_at) - epoch_us(created_at), 0.5) / 1e6, 6)
  as median_seconds_to_delivery from v_first_deliveries"""
    ),
)
def first_delivery_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.median_delivery_seconds(Frames(spark, sf_dir).delivered)


@register(
    "first_open_median",
    B.with_clean(
        """select round(quantile_cont(epoch_us(occurred_at) - epoch_us(created_at), 0.5) / 1e6, 6)
  as median_seconds_to_open from v_first_opens"""
    ),
)
def first_open_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.median_open_seconds(Frames(spark, sf_dir).interactions)


@register(
    "open_wait_by_course",
    B.with_clean(
        """select course, quantile_cont(epoch_us(o.occurred_at) - epoch_us(o.created_at), 0.5) as median_micros
from v_first_opens o join v_profiles p using (profile_id) group by 1"""
    ),
)
def open_wait_by_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frames(spark, sf_dir)
    waits = funnel.first_opens(f.interactions).join(f.profiles.select("profile_id", "course"), "profile_id")
    waits = waits.withColumn("wait", micros_between(F.col("created_at"), F.col("occurred_at")))
    return funnel.exact_median(waits, "wait", ["course"], "median_micros")


@register("useful_pairs", B.with_clean("select profile_id, posting_id from v_useful"))
def useful_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.useful_pairs(Frames(spark, sf_dir).interactions)


@register(
    "delivery_join_events",
    B.with_clean("select id, profile_id, posting_id, name, occurred_at, sent_at from v_interactions"),
)
def delivery_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Frames(spark, sf_dir).interactions.select(
        "id", "profile_id", "posting_id", "name", "occurred_at", "sent_at"
    )


@register("weekly_fact", B.with_clean("select week, partial, profile_id, course, useful from v_facts"))
def weekly_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frames(spark, sf_dir)
    return funnel.weekly_fact(f.profiles, f.clean, f.deliveries, B.NOW, B.DAYS)


@register(
    "weekly_utility",
    B.with_clean(
        """select s.week, s.closes > timestamp '2024-01-31' as partial, count(f.profile_id) as activated,
  count(*) filter (where f.useful) as useful from v_weeks s left join v_facts f on f.week = s.week group by 1, 2"""
    ),
)
def weekly_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.weekly_rate(weekly_fact(spark, sf_dir), funnel.weeks_calendar(spark, B.NOW, B.DAYS))


@register(
    "utility_by_area",
    B.with_clean(
        """select week, partial, case when course in ('BUILDING', 'MACHINERY') then 'engenharia'
    when course = 'HOUSEHOLD' then 'casa' else 'Não classificado' end as area,
  count(*) as activated, count(*) filter (where useful) as useful from v_facts group by 1, 2, 3"""
    ),
)
def utility_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    courses = B.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("course")).distinct()
    area = F.when(F.col("course").isin("BUILDING", "MACHINERY"), "engenharia").when(
        F.col("course") == "HOUSEHOLD", "casa"
    )
    return funnel.utility_by_area(weekly_fact(spark, sf_dir), courses.withColumn("area", area))


@register("delivery_groups", B.with_clean('select profile_id, posting_id, sent_at, "group" from v_grouped'))
def delivery_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frames(spark, sf_dir)
    return funnel.delivery_groups(f.deliveries, f.postings, B.NOW, B.DAYS)


@register(
    "refusals_by_group",
    B.with_clean(
        """select t."group", count(*) as deliveries,
  count(*) filter (where r.name = 'vaga_irrelevante' and r.reason is distinct from 'motivo_encerrada') as refusals,
  count(*) filter (where r.name = 'vaga_irrelevante' and r.reason = 'motivo_nota') as score_refusals
from v_grouped t left join v_period_answers r on r.profile_id = t.profile_id and r.posting_id = t.posting_id group by 1"""
    ),
)
def refusals_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frames(spark, sf_dir)
    grouped = funnel.delivery_groups(f.deliveries, f.postings, B.NOW, B.DAYS)
    return funnel.refusals_by_group(f.clean, grouped)


FUNNEL_ROW_SQL = B.with_clean(
    """select
  (select count(*) from v_cohort) as profiles_created,
  (select count(*) from v_cohort c where chat_id is not null or exists (select 1 from v_clean e
     where e.profile_id = c.profile_id and e.name = 'telegram_vinculado')) as profiles_linked,
  (select count(*) from v_cohort where activated_at <= timestamp '2024-01-31') as profiles_activated,
  (select count(*) from v_cohort c where not exists (select 1 from v_first_deliveries d where d.profile_id = c.profile_id)) as profiles_without_delivery,
  (select count(*) from v_cohort c where not exists (select 1 from v_first_opens d where d.profile_id = c.profile_id)) as profiles_without_open,
  (select count(distinct profile_id) from v_interactions where name = 'vaga_aberta') as profiles_opened,
  (select count(distinct profile_id) from v_useful) as profiles_useful,
  (select count(distinct profile_id) from v_interactions where name = 'candidatura_iniciada') as profiles_applied,
  (select count(distinct (profile_id, posting_id)) from v_interactions where name = 'vaga_aberta') as postings_opened,
  (select count(*) from v_useful) as postings_useful,
  (select count(*) from v_answers where name = 'vaga_irrelevante') as postings_irrelevant,
  (select count(distinct (profile_id, posting_id)) from v_interactions where name = 'candidatura_iniciada') as applications,
  (select count(*) from v_delivered) as postings_sent,
  (select count(*) from v_stored where extracted_at between timestamp '2024-01-31' - interval 30 day and timestamp '2024-01-31') as postings_extracted,
  (select count(*) from v_grouped) as eligible_for_answer,
  (select count(*) from v_period_answers) as answered,
  (select round(quantile_cont(epoch_us(sent_at) - epoch_us(created_at), 0.5) / 1e6, 6) from v_first_deliveries) as median_seconds_to_delivery,
  (select round(quantile_cont(epoch_us(occurred_at) - epoch_us(created_at), 0.5) / 1e6, 6) from v_first_opens) as median_seconds_to_open"""
)


def _funnel_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Frames(spark, sf_dir)
    return funnel.funnel_row(f.profiles, f.events, f.deliveries, f.postings, B.NOW, B.DAYS, maps=False)


register("funnel_row", FUNNEL_ROW_SQL)(_funnel_row)


@register(
    "funnel_ratios",
    FUNNEL_ROW_SQL.replace("select\n  (select count(*) from v_cohort) as profiles_created", ", v_row as (select\n  (select count(*) from v_cohort) as profiles_created")
    + """) select round(profiles_linked * 100.0 / nullif(profiles_created, 0), 6)::double as linked_pct,
  round(profiles_activated * 100.0 / nullif(profiles_created, 0), 6)::double as activated_pct,
  round(postings_opened * 100.0 / nullif(postings_sent, 0), 6)::double as opened_pct,
  round(postings_useful * 100.0 / nullif(postings_sent, 0), 6)::double as useful_pct,
  round(answered * 100.0 / nullif(eligible_for_answer, 0), 6)::double as answered_pct,
  round(postings_extracted::double / nullif(profiles_activated, 0), 6)::double as extracted_per_activated from v_row""",
)
def funnel_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = funnel.funnel_ratios(_funnel_row(spark, sf_dir))
    return ratios.select(*[F.round(c, 6).cast("double").alias(c) for c in ratios.columns])
