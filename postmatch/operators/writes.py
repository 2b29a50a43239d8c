"""New table versions from the current version and a run's changes.

Each function returns the full next version; publishing it is one immutable write. Applying the same
change twice gives the same version (usage is additive and therefore keyed by run).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmatch.functions.dates import instant, local_date
from postmatch.operators.keyed import first_per_key
from postmatch.plans import names as N

POSTING = ("source", "external_id")
PAIR = ("profile_id", "posting_id")
PAUSE_AFTER = 3
ACCOUNT_DAYS, PENDING_DAYS, UNCONFIRMED_DAYS = 60, 2, 30


def upsert_postings(current: DataFrame, new: DataFrame) -> DataFrame:
    """Existing postings stay; a longer description and a known mode win. New keys are added.

    `new` has one row per key.
    """
    columns = current.columns
    extra = [c for c in ("description", "mode") if c in columns]
    changes = new.select(*POSTING, *[F.col(c).alias(f"_{c}") for c in extra])
    longer = F.length("_description") > F.length("description")
    updated = current.join(changes, list(POSTING), "left").withColumns(
        {
            "description": F.when(longer, F.col("_description")).otherwise(F.col("description")),
            "mode": F.coalesce("_mode", "mode"),
        }
    )
    added = new.join(current.select(*POSTING), list(POSTING), "left_anti")
    return updated.select(*columns).unionByName(added.select(*[c for c in columns if c in new.columns]), allowMissingColumns=True)


def upsert_extractions(current: DataFrame, extracted: DataFrame, model: str, now) -> DataFrame:
    """Sets extraction, reading time and model version on the postings read this run."""
    change = extracted.select(*POSTING, F.col("extraction").alias("_extraction"))
    read = F.col("_extraction").isNotNull()
    return current.join(change, list(POSTING), "left").select(
        *[c for c in current.columns if c not in ("extraction", "extracted_at", "extraction_model")],
        F.coalesce("_extraction", "extraction").alias("extraction"),
        F.when(read, instant(now)).otherwise(F.col("extracted_at")).alias("extracted_at"),
        F.when(read, F.lit(model)).otherwise(F.col("extraction_model")).alias("extraction_model"),
    )


def replace_rows(current: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `new` replace rows with the same key (scores)."""
    return current.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def insert_first_wins(current: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Adds rows whose key is unknown; among new rows of one key the first wins (deliveries)."""
    fresh = first_per_key(new, keys, order)
    return current.unionByName(fresh.join(current.select(*keys), list(keys), "left_anti").select(*current.columns))


def profile_state(profiles: DataFrame, outcomes: DataFrame, now, pause_after: int = PAUSE_AFTER) -> DataFrame:
    """Activation, failure counter and pause after a run.

    `outcomes` is (profile_id, delivered, refused): a delivery activates once and resets the counter,
    a refusal counts, and the third in a row pauses an active profile.
    """
    joined = profiles.join(outcomes.select("profile_id", "delivered", "refused"), "profile_id", "left")
    delivered, refused = F.coalesce("delivered", F.lit(False)), F.coalesce("refused", F.lit(False))
    failures = F.when(delivered, 0).when(refused, F.col("failures") + 1).otherwise(F.col("failures"))
    paused = refused & ~delivered & (F.col("failures") + 1 >= pause_after)
    return joined.withColumns(
        {
            "activated_at": F.when(delivered, F.coalesce("activated_at", instant(now))).otherwise(F.col("activated_at")),
            "failures": failures.cast("int"),
            "active": F.col("active") & ~paused,
        }
    ).select(*profiles.columns)


def days_without_extraction(postings: DataFrame, missing: DataFrame, day: date | str, keys: Sequence[str] = POSTING) -> DataFrame:
    """Counts distinct local days on which a posting missed its extraction."""
    today: Column = F.lit(str(day)).cast("date")
    missed = missing.select(*keys, F.lit(True).alias("_missed")).distinct()
    since = local_date(F.col("extracted_at")) >= F.col("last_missing_day")
    next_days = (
        F.when(F.col("last_missing_day") == today, F.col("days_without"))
        .when(since, 1)
        .otherwise(F.col("days_without") + 1)
    )
    joined = postings.join(missed, list(keys), "left")
    return joined.withColumns(
        {
            "days_without": F.when(F.col("_missed"), next_days).otherwise(F.col("days_without")).cast("int"),
            "last_missing_day": F.when(F.col("_missed"), today).otherwise(F.col("last_missing_day")),
        }
    ).select(*postings.columns)


def add_usage(current: DataFrame, used: DataFrame) -> DataFrame:
    """Requests summed per (source, day)."""
    columns = ["source", "day", "requests"]
    both = current.select(*columns).unionByName(used.select(*columns))
    return both.groupBy("source", "day").agg(F.sum("requests").alias("requests"))


def mark(rows: DataFrame, chosen: DataFrame, keys: Sequence[str], column: str, value: Column, once: bool = False) -> DataFrame:
    """Sets a date or instant on the chosen rows; with `once` only where it is still null."""
    flagged = rows.join(chosen.select(*keys, F.lit(True).alias("_chosen")).distinct(), list(keys), "left")
    change = F.coalesce("_chosen", F.lit(False))
    if once:
        change = change & F.col(column).isNull()
    return flagged.withColumn(column, F.when(change, value).otherwise(F.col(column))).select(*rows.columns)


def mark_served(profiles: DataFrame, served: DataFrame, day: date | str) -> DataFrame:
    return mark(profiles, served, ["profile_id"], "last_day_served", F.lit(str(day)).cast("date"))


def mark_attended(profiles: DataFrame, served: DataFrame, now) -> DataFrame:
    return mark(profiles, served, ["profile_id"], "attended_at", instant(now), once=True)


def mark_silence_warned(profiles: DataFrame, warned: DataFrame, now) -> DataFrame:
    return mark(profiles, warned, ["profile_id"], "silence_warned_at", instant(now))


def reserve_questions(deliveries: DataFrame, asked: DataFrame, now) -> DataFrame:
    return mark(deliveries, asked, ["profile_id", "token"], "asked_at", instant(now), once=True)


def release_questions(deliveries: DataFrame, failed: DataFrame) -> DataFrame:
    return mark(deliveries, failed, ["profile_id", "token"], "asked_at", F.lit(None).cast("timestamp"))


# --- retention --------------------------------------------------------------------------------------
def _before(now, days: int) -> Column:
    return instant(now) - F.make_dt_interval(F.lit(days))


def expired_accounts(profiles: DataFrame, now, days: int = ACCOUNT_DAYS) -> DataFrame:
    return profiles.filter(F.col("deleted_at") < _before(now, days)).select("user_id").distinct()


def unconfirmed_accounts(accounts: DataFrame, profiles: DataFrame, now, days: int = UNCONFIRMED_DAYS) -> DataFrame:
    late = F.col("confirmed_at").isNull() & (F.col("confirmation_sent_at") < _before(now, days))
    return accounts.filter(late).select("user_id").join(profiles.select("user_id"), "user_id", "left_anti")


def sessions_only_of(events: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions a database event ties to one of the users and that no other user shares."""
    named = events.filter(F.col("session_id").isNotNull() & F.col("user_id").isNotNull())
    gone = users.select("user_id", F.lit(True).alias("_gone"))
    per_session = (
        named.join(gone, "user_id", "left")
        .groupBy("session_id")
        .agg(
            F.min("user_id").alias("_low"),
            F.max("user_id").alias("_high"),
            F.bool_or(F.coalesce("_gone", F.lit(False)) & (F.col("origin") == "banco")).alias("_tied"),
        )
    )
    return per_session.filter(F.col("_tied") & (F.col("_low") == F.col("_high"))).select("session_id")


def retained_events(events: DataFrame, users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Events without those of the users, of their profiles and the anonymous ones of their own sessions."""
    anonymous = F.col("user_id").isNull()
    own = sessions_only_of(events, users).withColumn("_own", F.lit(True))
    owned = profiles.join(users, "user_id", "left_semi").select("profile_id", F.lit(True).alias("_owned"))
    gone = users.select("user_id", F.lit(True).alias("_gone"))
    marked = events.join(gone, "user_id", "left").join(owned, "profile_id", "left").join(own, "session_id", "left")
    drop = F.col("_gone").isNotNull() | F.col("_owned").isNotNull() | (anonymous & F.col("_own").isNotNull())
    return marked.filter(~drop).select(*events.columns)


def retained(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of a table without those keyed to removed accounts or profiles."""
    return rows.join(gone.select(key), key, "left_anti").select(*rows.columns)


def without_deleted_postings(events: DataFrame, postings: DataFrame) -> DataFrame:
    """A removed posting only empties the event's posting id."""
    known = postings.select("posting_id", F.lit(True).alias("_known"))
    joined = events.join(known, "posting_id", "left")
    return joined.withColumn("posting_id", F.when(F.col("_known"), F.col("posting_id"))).select(*events.columns)


def retained_signups(pending: DataFrame, now, days: int = PENDING_DAYS) -> DataFrame:
    return pending.filter(F.col("received_at") >= _before(now, days))


# --- subject data -----------------------------------------------------------------------------------
def export_subject_data(subjects: DataFrame, sections: dict[str, DataFrame], secrets: Sequence[str] = ("token", "link_token")) -> DataFrame:
    """(user_id, section, record): every row of the asked accounts as JSON, secrets removed.

    One record per row, so an account with a large share of the data is still spread; writing it
    partitioned by account gives one document folder each.
    """
    out = None
    for name, rows in sections.items():
        kept = [c for c in rows.columns if c not in (*secrets, "user_id")]
        part = rows.join(subjects.select("user_id"), "user_id", "left_semi").select(
            "user_id", F.lit(name).alias("section"), F.to_json(F.struct(*kept)).alias("record")
        )
        out = part if out is None else out.unionByName(part)
    return out


def signup_profiles(pending: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles from valid pending signups, trimmed; an account that has one keeps it.

    `pending` is (user_id, signup, received_at) with `signup` already checked by the quality rules.
    """
    from postmatch.operators.quality import SIGNUP

    doc = F.from_json("signup", SIGNUP)
    p = doc["perfil"]
    rows = pending.join(profiles.select("user_id"), "user_id", "left_anti")
    firsts = first_per_key(rows, ["user_id"], [F.col("received_at")])
    return firsts.select(
        "user_id",
        F.trim(p["curso"]).alias("course"),
        p["periodo"].cast("int").alias("period"),
        F.transform(p["habilidades"], lambda s: F.trim(s)).alias("skills"),
        F.trim(p["cidade"]).alias("city"),
        p["modalidade"].alias("mode"),
        p["areas_de_interesse"].alias("interest_areas"),
        p["pessoa_com_deficiencia"].cast("boolean").alias("disability"),
        doc["sessao_id"].alias("session_id"),
        F.col("received_at").alias("created_at"),
    )


def attribute_sessions(events: DataFrame, signups: DataFrame) -> DataFrame:
    """The signup's session goes to its account's database events that have none."""
    own = signups.select("user_id", F.col("session_id").alias("_session"))
    joined = events.join(own, "user_id", "left")
    named = (F.col("origin") == "banco") & F.col("name").isin(N.ACCOUNT_CREATED, N.EMAIL_CONFIRMED, N.PROFILE_SAVED)
    filled = F.coalesce("session_id", F.when(named, F.col("_session")))
    return joined.withColumn("session_id", filled).select(*events.columns)
