"""Cohort funnel, utility and refusal metrics over the event log.

Every function takes DataFrames plus the run instant and returns one DataFrame. Frames are keyed by
profile, pair (profile, posting) or local week; outputs that grow with the data (weekly facts, visits
by origin) stay tables instead of being packed into one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmatch.functions.dates import instant, local_midnight, local_week, micros_between
from postmatch.operators.keyed import exact_median, first_per_key
from postmatch.plans import names as N
from postmatch.session import cut_lineage

Moment = datetime | str
PAIR = ("profile_id", "posting_id")
COHORT_DAYS = 30


def window_start(now: Moment, days: int) -> Column:
    return instant(now) - F.make_dt_interval(F.lit(days))


def cohort(profiles: DataFrame, now: Moment, days: int = COHORT_DAYS) -> DataFrame:
    return profiles.filter(F.col("created_at").between(window_start(now, days), instant(now)))


def current_pauses(profiles: DataFrame) -> DataFrame:
    paused = profiles.filter(~F.col("active") & F.col("deleted_at").isNull())
    reason = F.coalesce("pause_reason", F.lit(N.NO_REASON)).alias("reason")
    return paused.groupBy(reason).agg(F.count(F.lit(1)).alias("total"))


def local_sessions(events: DataFrame) -> DataFrame:
    """Sessions whose landing came from a development machine."""
    host, page = F.col("properties")["host"], F.col("properties")["pagina"]
    is_local = reduce(
        lambda left, right: left | right,
        [F.coalesce(page.rlike(p), F.lit(False)) for p in N.LOCAL_PAGES],
        F.coalesce(host.rlike(N.LOCAL_HOST), F.lit(False)),
    )
    landings = events.filter((F.col("name") == N.LANDING) & F.col("session_id").isNotNull())
    return landings.filter(is_local).select("session_id").distinct()


def clean_events(events: DataFrame, profiles: DataFrame, now: Moment) -> DataFrame:
    """Events up to now without local sessions nor anything of a user seen in one.

    `person_user` is the event's user or else its profile's; the identity step reads it again.
    """
    sessions = local_sessions(events)
    users = (
        events.filter(F.col("user_id").isNotNull())
        .join(sessions, "session_id", "left_semi")
        .select(F.col("user_id").alias("person_user"))
        .distinct()
    )
    owners = profiles.select("profile_id", F.col("user_id").alias("_owner"))
    past = events.filter(F.col("occurred_at") <= instant(now))
    return (
        past.join(owners, "profile_id", "left")
        .withColumn("person_user", F.coalesce("user_id", "_owner"))
        .drop("_owner")
        .join(sessions, "session_id", "left_anti")
        .join(users, "person_user", "left_anti")
    )


def visits_by_origin(clean: DataFrame, now: Moment, days: int = COHORT_DAYS) -> DataFrame:
    landings = clean.filter(
        (F.col("name") == N.LANDING) & (F.col("occurred_at") >= window_start(now, days))
    )
    props = F.col("properties")
    origin = F.coalesce(props["utm_source"], props["referrer_dominio"], F.lit(N.DIRECT))
    return landings.groupBy(origin.alias("visit_origin")).agg(F.count(F.lit(1)).alias("visits"))


def session_owner(clean: DataFrame) -> DataFrame:
    """Sessions with exactly one user: min equals max, no distinct set is kept."""
    known = clean.filter(F.col("session_id").isNotNull() & F.col("user_id").isNotNull())
    spans = known.groupBy("session_id").agg(
        F.min("user_id").alias("owner"), F.max("user_id").alias("_other")
    )
    return spans.filter(F.col("owner") == F.col("_other")).drop("_other")


def identity_resolution(clean: DataFrame) -> DataFrame:
    person = F.coalesce(
        F.concat(F.lit("u:"), F.col("person_user")),
        F.concat(F.lit("u:"), F.col("owner")),
        F.concat(F.lit("s:"), F.col("session_id")),
    )
    return clean.join(session_owner(clean), "session_id", "left").withColumn("person", person).drop("owner")


def first_seen(identified: DataFrame) -> DataFrame:
    known = identified.filter(F.col("person").isNotNull())
    return known.groupBy("person").agg(F.min("occurred_at").alias("entered_at"))


def funnel_steps(clean: DataFrame, now: Moment, days: int = COHORT_DAYS) -> DataFrame:
    """Distinct persons per event name, only persons whose first event ever is in the window.

    One pass to (person, name) keeps at most sixteen rows per person; the first appearance is the
    minimum over them, so no second read of the log is needed.
    """
    per_step = (
        identity_resolution(clean)
        .filter(F.col("person").isNotNull())
        .groupBy("person", "name")
        .agg(F.min("occurred_at").alias("_first"))
    )
    per_person = per_step.groupBy("person").agg(
        F.min("_first").alias("entered_at"), F.collect_list("name").alias("names")
    )
    entered = per_person.filter(F.col("entered_at") >= window_start(now, days))
    steps = entered.select(F.explode("names").alias("step"))
    return steps.groupBy("step").agg(F.count(F.lit(1)).alias("persons"))


def cohort_deliveries(deliveries: DataFrame, members: DataFrame, now: Moment) -> DataFrame:
    sent = deliveries.filter(F.col("sent_at") <= instant(now))
    return sent.join(members.select("profile_id", "created_at"), "profile_id")


def first_deliveries(delivered: DataFrame) -> DataFrame:
    """Earliest delivery per cohort profile not before its creation."""
    valid = delivered.filter(F.col("sent_at") >= F.col("created_at"))
    return first_per_key(
        valid.select("profile_id", "posting_id", "sent_at", "created_at"),
        ["profile_id"],
        [F.col("sent_at"), F.col("posting_id")],
    )


def pair_events(clean: DataFrame, delivered: DataFrame) -> DataFrame:
    """Events of a delivered pair not before its delivery (a pair delivered twice gives two rows)."""
    sides = delivered.select(*PAIR, "sent_at", *[c for c in ("created_at", "group") if c in delivered.columns])
    joined = clean.join(sides, list(PAIR))
    return joined.filter(F.col("occurred_at") >= F.col("sent_at"))


def first_opens(interactions: DataFrame) -> DataFrame:
    opens = interactions.filter(
        (F.col("name") == N.OPENED) & (F.col("sent_at") >= F.col("created_at"))
    )
    return first_per_key(
        opens.select("profile_id", "occurred_at", "id", "created_at"),
        ["profile_id"],
        [F.col("occurred_at"), F.col("id")],
    )


def last_answers(interactions: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Last useful/irrelevant answer per key, by (instant, id)."""
    answers = interactions.filter(F.col("name").isin(*N.ANSWERS)).withColumn(
        "reason", F.col("properties")[N.REASON_KEY]
    )
    kept = answers.select(*keys, "name", "reason", "occurred_at", "id")
    return first_per_key(kept, keys, [F.col("occurred_at").desc(), F.col("id").desc()])


def useful_pairs(interactions: DataFrame) -> DataFrame:
    """Pairs whose last answer is useful, plus pairs with an application."""
    useful = last_answers(interactions).filter(F.col("name") == N.USEFUL).select(*PAIR)
    applied = interactions.filter(F.col("name") == N.APPLIED).select(*PAIR)
    return useful.union(applied).distinct()


def refusals_by_reason(interactions: DataFrame) -> DataFrame:
    refused = last_answers(interactions).filter(F.col("name") == N.IRRELEVANT)
    reason = F.coalesce("reason", F.lit(N.NO_REASON)).alias("reason")
    return refused.groupBy(reason).agg(F.count(F.lit(1)).alias("total"))


def weeks_calendar(spark, now: Moment, days: int = COHORT_DAYS) -> DataFrame:
    """Local Monday weeks that touch the window, with UTC bounds; a few rows whatever the data."""
    span = spark.range(1).select(
        F.explode(
            F.sequence(
                local_week(window_start(now, days)), local_week(instant(now)), F.expr("interval 7 days")
            )
        ).alias("week")
    )
    until = local_midnight(F.date_add("week", 7))
    return span.select(
        F.to_date("week").alias("week"),
        local_midnight(F.col("week")).alias("opens"),
        until.alias("closes"),
        (until > instant(now)).alias("partial"),
    )


def weekly_useful(clean: DataFrame, deliveries: DataFrame, now: Moment, days: int = COHORT_DAYS) -> DataFrame:
    """(week, profile) with a useful last answer or an application inside the week.

    The week of an event is computed from its instant, so the calendar join is an equality.
    """
    first_week = local_week(window_start(now, days))
    relevant = clean.filter(F.col("name").isin(*N.ANSWERS, N.APPLIED)).withColumn(
        "week", local_week(F.col("occurred_at"))
    )
    inside = pair_events(relevant.filter(F.col("week") >= first_week), deliveries)
    answered = last_answers(inside, ["week", *PAIR]).filter(F.col("name") == N.USEFUL)
    applied = inside.filter(F.col("name") == N.APPLIED)
    keys = ["week", "profile_id"]
    return answered.select(*keys).union(applied.select(*keys)).distinct()


def weekly_fact(
    profiles: DataFrame, clean: DataFrame, deliveries: DataFrame, now: Moment, days: int = COHORT_DAYS
) -> DataFrame:
    """One row per activated profile and calendar week since its activation."""
    first_week, last_week = local_week(window_start(now, days)), local_week(instant(now))
    activated = profiles.filter(F.col("activated_at") <= instant(now)).select(
        "profile_id", "course", F.greatest(local_week(F.col("activated_at")), first_week).alias("_since")
    )
    rows = activated.select(
        F.explode(F.sequence("_since", last_week, F.expr("interval 7 days"))).alias("week"),
        "profile_id",
        "course",
    ).withColumn("week", F.to_date("week"))
    useful = weekly_useful(clean, deliveries, now, days).withColumn("useful", F.lit(True))
    return rows.join(useful, ["week", "profile_id"], "left").select(
        "week",
        (local_midnight(F.date_add("week", 7)) > instant(now)).alias("partial"),
        "profile_id",
        "course",
        F.coalesce("useful", F.lit(False)).alias("useful"),
    )


def weekly_rate(facts: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per week: activated and useful profiles; weeks without profiles keep zeros."""
    counted = facts.groupBy("week").agg(
        F.count(F.lit(1)).alias("activated"), F.count_if("useful").alias("useful")
    )
    zero = F.lit(0).cast("long")
    return calendar.join(counted, "week", "left").select(
        "week",
        "partial",
        F.coalesce("activated", zero).alias("activated"),
        F.coalesce("useful", zero).alias("useful"),
    )


UNCLASSIFIED = "Não classificado"


def utility_by_area(facts: DataFrame, course_areas: DataFrame) -> DataFrame:
    """Weekly facts by the area of the current course; `course_areas` is (course, area)."""
    labelled = facts.join(course_areas, "course", "left").withColumn(
        "area", F.coalesce("area", F.lit(UNCLASSIFIED))
    )
    return labelled.groupBy("week", "partial", "area").agg(
        F.count(F.lit(1)).alias("activated"), F.count_if("useful").alias("useful")
    )


def delivery_groups(deliveries: DataFrame, postings: DataFrame, now: Moment, days: int = COHORT_DAYS) -> DataFrame:
    """First delivery per pair in the window, labelled by how many skills the posting requires."""
    size = F.size(F.coalesce("required_skills", F.array().cast("array<string>")))
    group = (
        F.when(~F.col("extracted"), "sem_extracao")
        .when(size == 0, "sem_tecnologias")
        .when(size <= 2, "uma_ou_duas")
        .otherwise("tres_ou_mais")
    )
    recent = deliveries.filter(F.col("sent_at").between(window_start(now, days), instant(now)))
    firsts = recent.groupBy(*PAIR).agg(F.min("sent_at").alias("sent_at"))
    return firsts.join(postings.select("posting_id", group.alias("group")), "posting_id")


def answers_in_period(clean: DataFrame, grouped: DataFrame) -> DataFrame:
    return last_answers(pair_events(clean, grouped))


def refusals_by_group(clean: DataFrame, grouped: DataFrame) -> DataFrame:
    joined = grouped.join(answers_in_period(clean, grouped), list(PAIR), "left")
    refused = F.coalesce(F.col("name") == N.IRRELEVANT, F.lit(False))
    return joined.groupBy("group").agg(
        F.count(F.lit(1)).alias("deliveries"),
        F.count_if(refused & ~F.col("reason").eqNullSafe(F.lit(N.REASON_CLOSED))).alias("refusals"),
        F.count_if(refused & F.col("reason").eqNullSafe(F.lit(N.REASON_SCORE))).alias("score_refusals"),
    )


def pair_states(interactions: DataFrame) -> DataFrame:
    """One row per delivered pair: opened, applied, last answer."""
    is_answer = F.col("name").isin(*N.ANSWERS)
    order = F.when(is_answer, F.struct("occurred_at", "id"))
    return interactions.groupBy(*PAIR).agg(
        F.bool_or(F.col("name") == N.OPENED).alias("opened"),
        F.bool_or(F.col("name") == N.APPLIED).alias("applied"),
        F.max_by("name", order).alias("answer"),
    )


def interaction_counts(interactions: DataFrame) -> DataFrame:
    """Pair and profile counts in three nested aggregates, without a distinct set."""
    answer = F.coalesce("answer", F.lit(""))
    useful = F.col("applied") | (answer == N.USEFUL)
    per_profile = (
        pair_states(interactions)
        .groupBy("profile_id")
        .agg(
            F.count_if("opened").alias("opened"),
            F.count_if("applied").alias("applied"),
            F.count_if(useful).alias("useful"),
            F.count_if(answer == N.IRRELEVANT).alias("irrelevant"),
        )
    )

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("long")

    return per_profile.agg(
        F.count_if(F.col("opened") > 0).alias("profiles_opened"),
        F.count_if(F.col("useful") > 0).alias("profiles_useful"),
        F.count_if(F.col("applied") > 0).alias("profiles_applied"),
        total("opened").alias("postings_opened"),
        total("useful").alias("postings_useful"),
        total("irrelevant").alias("postings_irrelevant"),
        total("applied").alias("applications"),
    )


def seconds(micros: str) -> Column:
    return F.round(F.col(micros) / 1e6, 6)


def cohort_counts(members: DataFrame, clean: DataFrame, delivered: DataFrame, interactions: DataFrame, now: Moment) -> DataFrame:
    """Profiles created, linked, activated, without delivery and without an open."""
    linked = clean.filter(F.col("name") == N.CHAT_LINKED).select("profile_id").distinct()
    flags = (
        members.select("profile_id", "chat_id", "activated_at")
        .join(linked.withColumn("_linked", F.lit(True)), "profile_id", "left")
        .join(first_deliveries(delivered).select("profile_id", F.lit(True).alias("_sent")), "profile_id", "left")
        .join(first_opens(interactions).select("profile_id", F.lit(True).alias("_open")), "profile_id", "left")
    )
    return flags.agg(
        F.count(F.lit(1)).alias("profiles_created"),
        F.count_if(F.col("chat_id").isNotNull() | F.col("_linked").isNotNull()).alias("profiles_linked"),
        F.count_if(F.col("activated_at") <= instant(now)).alias("profiles_activated"),
        F.count_if(F.col("_sent").isNull()).alias("profiles_without_delivery"),
        F.count_if(F.col("_open").isNull()).alias("profiles_without_open"),
    )


def median_delivery_seconds(delivered: DataFrame) -> DataFrame:
    waits = first_deliveries(delivered).select(micros_between(F.col("created_at"), F.col("sent_at")).alias("_w"))
    return exact_median(waits, "_w").select(seconds("median").alias("median_seconds_to_delivery"))


def median_open_seconds(interactions: DataFrame) -> DataFrame:
    waits = first_opens(interactions).select(micros_between(F.col("created_at"), F.col("occurred_at")).alias("_w"))
    return exact_median(waits, "_w").select(seconds("median").alias("median_seconds_to_open"))


def as_map(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """A bounded dimension (event names, reasons) as one map; empty input gives an empty map."""
    entries = F.array_sort(F.collect_list(F.struct(key, value)))
    return df.agg(F.map_from_entries(entries).alias(name))


def one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Single-row frames side by side, as one aggregate over their union."""
    columns = [c for part in parts for c in part.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])


def funnel_row(
    profiles: DataFrame,
    events: DataFrame,
    deliveries: DataFrame,
    postings: DataFrame,
    now: Moment,
    days: int = COHORT_DAYS,
    maps: bool = True,
) -> DataFrame:
    """The whole funnel as one row; child tables come from the functions above."""
    members = cohort(profiles, now, days)
    clean = clean_events(events, profiles, now)
    delivered = cohort_deliveries(deliveries, members, now)
    # Read by five metrics: only events of delivered cohort pairs, a small part of the log.
    interactions = cut_lineage(pair_events(clean, delivered))
    grouped = cut_lineage(delivery_groups(deliveries, postings, now, days))
    recently_read = F.col("extracted_at").between(window_start(now, days), instant(now))
    parts = [
        cohort_counts(members, clean, delivered, interactions, now),
        interaction_counts(interactions),
        delivered.agg(F.count(F.lit(1)).alias("postings_sent")),
        postings.agg(F.count_if(recently_read).alias("postings_extracted")),
        grouped.agg(F.count(F.lit(1)).alias("eligible_for_answer")),
        answers_in_period(clean, grouped).agg(F.count(F.lit(1)).alias("answered")),
        median_delivery_seconds(delivered),
        median_open_seconds(interactions),
    ]
    if maps:
        parts += [
            as_map(funnel_steps(clean, now, days), "step", "persons", "steps"),
            as_map(refusals_by_reason(interactions), "reason", "total", "refusal_reasons"),
            as_map(current_pauses(profiles), "reason", "total", "pauses"),
        ]
    return one_row(parts)


def funnel_ratios(row: DataFrame) -> DataFrame:
    """Derived ratios; null where the denominator is zero."""

    def share(part: str, whole: str) -> Column:
        return F.try_divide(F.col(part) * 100.0, F.col(whole))

    return row.select(
        share("profiles_linked", "profiles_created").alias("linked_pct"),
        share("profiles_activated", "profiles_created").alias("activated_pct"),
        share("postings_opened", "postings_sent").alias("opened_pct"),
        share("postings_useful", "postings_sent").alias("useful_pct"),
        share("answered", "eligible_for_answer").alias("answered_pct"),
        F.try_divide(F.col("postings_extracted").cast("double"), F.col("profiles_activated")).alias("extracted_per_activated"),
    )
