"""Profiles to serve, run counters, budgets and alerts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmatch.functions.dates import instant, local_date

# Request budgets, ceilings and alert thresholds.
DAY_LIMIT, WEEK_LIMIT, MONTH_LIMIT = 250, 1000, 2500
SOURCE_C_DAY_LIMIT = 100
VISITOR_CEILING, ACCOUNT_CEILING = 2400, 900
USAGE_ALERT = 0.8
UNNAMED_PAGES_ALERT = 0.5
DAYS_UNTIL_RELEASE = 3
SILENCE_DAYS = 7


def active_profiles(profiles: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Active, undeleted, linked profiles and since when they have no recommendation."""
    live = profiles.filter(F.col("active") & F.col("deleted_at").isNull() & F.col("chat_id").isNotNull())
    last = deliveries.groupBy("profile_id").agg(F.max("sent_at").alias("_last"))
    joined = live.join(last, "profile_id", "left")
    return joined.withColumn("silent_since", F.coalesce("_last", "created_at")).drop("_last")


def unlinked_count(profiles: DataFrame) -> DataFrame:
    unlinked = F.col("active") & F.col("deleted_at").isNull() & F.col("chat_id").isNull()
    return profiles.agg(F.count_if(unlinked).alias("unlinked"))


def still_deliverable(outcomes: DataFrame, current: DataFrame) -> DataFrame:
    """Outcomes whose profile is, in the current snapshot, active, undeleted and on the same chat."""
    live = current.filter(F.col("active") & F.col("deleted_at").isNull())
    return outcomes.join(live.select("profile_id", "chat_id"), ["profile_id", "chat_id"], "left_semi")


def served_today(day: date | str) -> Column:
    return F.col("last_day_served").eqNullSafe(F.lit(str(day)).cast("date"))


def profiles_to_serve(active: DataFrame, day: date | str, immediate: bool = False, only: int | None = None) -> DataFrame:
    """Daily run: not yet served on the local day. Immediate run: the profile asked for and those
    dispatched, not yet attended."""
    if not immediate:
        chosen = active.filter(~served_today(day))
        return chosen if only is None else chosen.filter(F.col("profile_id") == only)
    asked = F.col("dispatched_at").isNotNull()
    if only is not None:
        asked = asked | (F.col("profile_id") == only)
    return active.filter(asked & F.col("attended_at").isNull() & ~served_today(day))


def prolonged_silence(active: DataFrame, now, days: int = SILENCE_DAYS) -> DataFrame:
    """Profiles silent for at least `days` and not warned within them, with the whole days."""
    limit = instant(now) - F.make_dt_interval(F.lit(days))
    silent = F.col("silent_since") <= limit
    unwarned = F.col("silence_warned_at").isNull() | (F.col("silence_warned_at") <= limit)
    gap = (F.unix_micros(instant(now)) - F.unix_micros("silent_since")) / F.lit(86_400_000_000)
    return active.filter(silent & unwarned).select("profile_id", F.floor(gap).alias("silent_days"))


def allowed_interests(profiles: DataFrame, subareas: DataFrame) -> DataFrame:
    """Interests that belong to the area of the profile's course; `subareas` is (area, values)."""
    empty = F.array().cast("array<string>")
    joined = profiles.join(subareas, "area", "left")
    own = F.array_intersect(F.coalesce("interest_areas", empty), F.coalesce("values", empty))
    return joined.withColumn("interest_areas", own).drop("values")


def last_day_served(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("profile_id").agg(F.max(local_date(F.col("sent_at"))).alias("last_day_served"))


def first_activation(deliveries: DataFrame) -> DataFrame:
    return deliveries.groupBy("profile_id").agg(F.min("sent_at").alias("activated_at"))


def already_attended(profiles: DataFrame) -> DataFrame:
    """Linked or activated profiles need no immediate delivery any more."""
    return profiles.filter(F.col("chat_id").isNotNull() | F.col("activated_at").isNotNull()).select("profile_id")


# --- hold back ------------------------------------------------------------------------------------
def hold_back(candidates: DataFrame, run_incomplete: bool, days_known: bool = True) -> DataFrame:
    """(profile_id, outcome) of profiles by what their candidates allow.

    `candidates` has profile_id, selected, extracted and days_without. Nothing selected and a
    candidate missing its extraction for fewer than three days holds the message, as does an
    incomplete run.
    """
    recent = ~F.col("extracted") & (F.coalesce("days_without", F.lit(0)) < DAYS_UNTIL_RELEASE)
    waits = F.bool_or(recent) if days_known else F.bool_or(F.lit(False))
    flags = candidates.groupBy("profile_id").agg(F.bool_or("selected").alias("_any"), waits.alias("_waits"))
    outcome = (
        F.when(F.col("_any"), "send")
        .when(F.col("_waits"), "held_for_extraction")
        .when(F.lit(run_incomplete), "held_for_incomplete_run")
        .otherwise("nothing_found")
    )
    return flags.select("profile_id", outcome.alias("outcome"))


def lost_unread_page(candidates: DataFrame, unread: DataFrame, keys=("source", "external_id")) -> DataFrame:
    """Profiles for whom a posting with an unread page would have been a candidate."""
    return candidates.join(unread.select(*keys), list(keys), "left_semi").select("profile_id").distinct()


# --- counters and alerts --------------------------------------------------------------------------
OUTCOMES = (
    "messaged", "lost", "failed_check", "unexpected_error", "held_for_extraction", "held_for_incomplete_run",
    "write_failed", "already_served", "refused_message", "paused",
)


def run_counters(outcomes: DataFrame) -> DataFrame:
    """One row of counters over (profile_id, outcomes array).

    A lost message only counts for a profile that got none; lists of profiles stay in the table.
    """

    def has(name: str) -> Column:
        return F.array_contains("outcomes", name)

    lost = (has("lost") | has("failed_check")) & ~has("messaged")
    return outcomes.agg(
        F.count(F.lit(1)).alias("profiles"),
        *[F.count_if(has(name)).alias(name) for name in OUTCOMES if name != "lost"],
        F.count_if(lost).alias("without_message"),
        F.count_if(has("failed_check") & ~has("messaged")).alias("undelivered_by_check"),
    )


def run_alerts(summary: DataFrame) -> DataFrame:
    """(alert, value) of the rules a one-row summary breaks.

    Columns a run has no value for may be absent.
    """
    zero_rules = (
        "without_message", "failed_check", "unexpected_error", "held_for_extraction", "held_for_incomplete_run",
        "write_failed", "refused_message", "paused", "postings_without_extraction", "unwritten_extractions",
        "failed_questions", "unreadable_profiles", "blocked_postings", "unidentified_postings", "pages_unread",
    )
    present = set(summary.columns)
    rules = [(name, F.col(name) > 0, F.col(name)) for name in zero_rules if name in present]
    if {"pages_read", "pages_without_origin"} <= present:
        share = F.col("pages_without_origin") > F.col("pages_read") * UNNAMED_PAGES_ALERT
        rules.append(("pages_without_origin", share, F.col("pages_without_origin")))
    for used, limit in (("used_month", MONTH_LIMIT), ("used_day_c", SOURCE_C_DAY_LIMIT)):
        if used in present:
            rules.append((used, F.col(used) >= limit * USAGE_ALERT, F.col(used)))
    if {"profiles", "messaged", "without_message"} <= present:
        nobody = (F.col("profiles") > 0) & (F.col("messaged") == 0) & (F.col("without_message") > 0)
        rules.append(("nobody_served", nobody, F.col("without_message")))
    if {"sampled", "judged"} <= present:
        rules.append(("nothing_judged", (F.col("sampled") > 0) & (F.col("judged") == 0), F.col("sampled")))
    fired = [
        F.when(rule, F.struct(F.lit(name).alias("alert"), value.cast("long").alias("value"))) for name, rule, value in rules
    ]
    return summary.select(F.explode(F.array_compact(F.array(*fired))).alias("_a")).select("_a.*")


def append_run(summary: DataFrame, path: str, run_id: str) -> None:
    """Adds the run's row; writing the same run again replaces nothing and fails."""
    summary.withColumn("run_id", F.lit(run_id)).write.mode("errorifexists").parquet(f"{path}/run_id={run_id}")


# --- budgets --------------------------------------------------------------------------------------
def usage_budget(usage: DataFrame, today: date | str, reserve: int = 0, daily_marker: str = ":diario") -> DataFrame:
    """Requests used and left per source: day, seven days and calendar month in one pass.

    The reserve counts for week and month always, for the day until the daily run left its marker.
    """
    day: Column = F.lit(str(today)).cast("date")
    marker = F.col("source").endswith(daily_marker)
    base = usage.filter((F.col("day") >= F.date_sub(day, 6)) | (F.col("day") >= F.trunc(day, "MM")))
    base = base.filter(F.col("day") <= day).withColumn(
        "_source", F.when(marker, F.regexp_replace("source", f"{daily_marker}$", "")).otherwise(F.col("source"))
    )

    def used(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when & ~marker, F.col("requests"))), F.lit(0)).cast("long")

    totals = base.groupBy(F.col("_source").alias("source")).agg(
        used(F.col("day") == day).alias("used_day"),
        used(F.col("day") >= F.date_sub(day, 6)).alias("used_week"),
        used(F.col("day") >= F.trunc(day, "MM")).alias("used_month"),
        F.coalesce(F.bool_or(marker & (F.col("day") == day)), F.lit(False)).alias("daily_ran"),
    )
    day_reserve = F.when(F.col("daily_ran"), 0).otherwise(reserve)
    left = F.least(
        DAY_LIMIT - F.col("used_day") - day_reserve,
        WEEK_LIMIT - F.col("used_week") - reserve,
        MONTH_LIMIT - F.col("used_month") - reserve,
    )
    return totals.withColumn("left", F.greatest(F.lit(0), left).cast("long"))


def source_c_budget(used_today: Column) -> Column:
    return F.greatest(F.lit(0), SOURCE_C_DAY_LIMIT - used_today)


def ceiling(anonymous: Column) -> Column:
    return F.when(anonymous, VISITOR_CEILING).otherwise(ACCOUNT_CEILING)


def site_events_24h(hours: DataFrame, now) -> DataFrame:
    """Visitor and account events of the last 24 hours and the hours that reached their ceiling."""
    since = F.date_trunc("hour", instant(now)) - F.expr("interval 24 hours")
    recent = hours.filter(F.col("hour") > since)

    def total(anonymous: bool) -> Column:
        return F.coalesce(F.sum(F.when(F.col("anonymous") == F.lit(anonymous), F.col("total"))), F.lit(0)).cast("long")

    return recent.agg(
        total(True).alias("visitors"),
        total(False).alias("accounts"),
        F.count_if(F.col("total") >= ceiling(F.col("anonymous"))).alias("hours_at_ceiling"),
    )


def origin_counts(postings: DataFrame) -> DataFrame:
    """Kept and cut postings per origin domain with the reason of the cut."""
    domain = F.coalesce("origin.domain", F.lit(""))
    return postings.groupBy(domain.alias("domain"), "block_reason").agg(F.count(F.lit(1)).alias("total"))
