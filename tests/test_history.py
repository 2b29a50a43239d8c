import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postmatch import schemas
from postmatch.operators import evaluation, limits, operations, writes
from postmatch.plans import names as N
from postmatch.streaming import ingest

START = datetime(2026, 9, 1)
LIMIT_COLUMNS = "id long, occurred_at timestamp, session_id string, user_id string"


def sliding(rows, limit, span):
    """Accepted ids when rows are judged one by one in time order."""
    accepted = []
    for i, at, *keys in sorted(rows, key=lambda r: (r[1], r[0])):
        full = any(
            k is not None and sum(k in other[2] and other[1] > at - span for other in accepted) >= limit for k in keys
        )
        if not full:
            accepted.append((i, at, [k for k in keys if k is not None]))
    return sorted(a[0] for a in accepted)


@pytest.mark.parametrize("seed", [1, 2])
def test_sliding_limit_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = [
        (i, START + timedelta(seconds=rng.randrange(4 * 3600)), f"s{rng.choice([0, 0, 0, 1, 2, 3])}", rng.choice([None, "u0", "u1"]))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, LIMIT_COLUMNS)
    got = limits.sliding_limit(df, [F.col("session_id"), F.col("user_id")], 7, limits.HOUR, chunk=20, cells_per_span=10)
    assert sorted(r[0] for r in got.collect()) == sliding(rows, 7, timedelta(hours=1))


def test_the_61st_event_of_a_session_is_refused(spark):
    rows = [(i, START + timedelta(seconds=i), "s", None) for i in range(65)] + [(99, START + timedelta(hours=1), "s", None)]
    verdicts = {r["id"]: r["reason"] for r in limits.limit_site_events(spark.createDataFrame(rows, LIMIT_COLUMNS)).collect()}
    assert [i for i, reason in verdicts.items() if reason] and {i for i, r in verdicts.items() if r} == set(range(60, 65))


def test_visitors_and_accounts_have_their_own_ceiling(spark):
    rows = [(i, START + timedelta(seconds=i / 2), f"s{i}", None) for i in range(2405)]
    rows += [(10_000 + i, START + timedelta(seconds=i), f"t{i}", f"u{i}") for i in range(903)]
    refused = limits.limit_site_events(spark.createDataFrame(rows, LIMIT_COLUMNS)).filter("reason is not null")
    assert sorted(r["id"] for r in refused.collect()) == [2400, 2401, 2402, 2403, 2404, 10_900, 10_901, 10_902]


def events(spark, rows):
    full = [(i, n, "telegram", None, "u", p, q, {}, at) for i, (n, p, q, at) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.EVENT)


def test_repeats(spark):
    rows = [(N.OPENED, 1, 1, START), (N.OPENED, 1, 1, START + timedelta(days=9)), (N.OPENED, 1, 2, START)]
    rows += [(N.PAUSED, 1, None, START + timedelta(hours=h)) for h in (0, 5, 23, 24, 30, 49)]
    kept = limits.drop_repeats(events(spark, rows)).select("id").collect()
    assert sorted(r[0] for r in kept) == [0, 2, 3, 6, 8]
    known = events(spark, [(N.OPENED, 1, 2, START)])
    assert sorted(r[0] for r in limits.drop_repeats(events(spark, rows[:3]), known).select("id").collect()) == [0]


def test_upserts_are_idempotent(spark):
    columns = "source string, external_id string, description string, mode string"
    current = spark.createDataFrame([("a", "1", "long text", None), ("a", "2", "x", "remoto")], columns)
    new = spark.createDataFrame([("a", "1", "short", "hibrido"), ("a", "2", "longer", None), ("b", "1", "n", None)], columns)
    once = writes.upsert_postings(current, new)
    want = {("a", "1", "long text", "hibrido"), ("a", "2", "longer", "remoto"), ("b", "1", "n", None)}
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in writes.upsert_postings(once, new).collect()} == want


def test_days_without_extraction(spark):
    schema = "posting_id int, days_without int, last_missing_day date, extracted_at timestamp"
    rows = spark.createDataFrame([(1, 0, None, None)], schema)
    seen = []
    for day, read in (("2026-09-01", None), ("2026-09-01", None), ("2026-09-02", None), ("2026-09-04", datetime(2026, 9, 3, 12)), ("2026-09-05", None)):
        if read:
            rows = rows.withColumn("extracted_at", F.lit(read))
        rows = spark.createDataFrame(writes.days_without_extraction(rows, rows, day, ["posting_id"]).collect(), schema)
        seen.append(rows.first()["days_without"])
    assert seen == [1, 1, 2, 1, 2]


def test_retention_keeps_shared_sessions(spark):
    people = [(1, "gone", "c", START, None, "x", True, START - timedelta(days=90), None), (2, "kept", "c", START, None, "x", True, None, None)]
    profiles = spark.createDataFrame(people, schemas.ACCOUNT_PROFILE)
    log = [
        (1, N.ACCOUNT_CREATED, "banco", "own", "gone", None, None, {}, START), (2, N.LANDING, "web", "own", None, None, None, {}, START),
        (3, N.ACCOUNT_CREATED, "banco", "both", "gone", None, None, {}, START), (4, N.LANDING, "web", "both", None, None, None, {}, START),
        (5, N.ACCOUNT_CREATED, "banco", "both", "kept", None, None, {}, START), (6, N.OPENED, "telegram", None, None, 1, 1, {}, START),
    ]
    users = writes.expired_accounts(profiles, START)
    kept = writes.retained_events(spark.createDataFrame(log, schemas.EVENT), users, profiles)
    assert sorted(r["id"] for r in kept.collect()) == [4, 5]


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("s"))
    one = evaluation.sample_n(df.repartition(1), 20, 5, ["k"]).collect()
    assert {r["k"] for r in one} == {r["k"] for r in evaluation.sample_n(df.repartition(7), 20, 5, ["k"]).collect()}
    strata = evaluation.stratified_sample(df, 10, 5, "s", ["k"]).groupBy("s").count().collect()
    assert sorted(r["count"] for r in strata) == [3, 3, 4]


def test_three_valued_and_hold_back(spark):
    rows = [(1, False, False, 1), (2, False, False, 3), (3, True, False, 0), (4, False, True, 0)]
    df = spark.createDataFrame(rows, "profile_id int, selected boolean, extracted boolean, days_without int")
    got = {r[0]: r[1] for r in operations.hold_back(df, run_incomplete=True).collect()}
    assert got == {1: "held_for_extraction", 2: "held_for_incomplete_run", 3: "send", 4: "held_for_incomplete_run"}
    served = spark.createDataFrame([(1, date(2026, 9, 1)), (2, None)], "profile_id int, last_day_served date")
    assert [r[0] for r in operations.profiles_to_serve(served, "2026-09-01").select("profile_id").collect()] == [2]


def stream_rows():
    """Web traffic over several files with a noisy session, link clicks in a loop and an unknown profile."""
    rows = []
    for i in range(160):
        at = START + timedelta(seconds=20 * i)
        noisy = i % 4 != 0
        rows.append((i, N.LANDING, "web", "noisy" if noisy else f"s{i}", None, None, None, '{"host": "a.example"}', at))
    rows += [(1000 + i, N.OPENED, "telegram", None, "u1", 1, i % 2, "{}", START + timedelta(seconds=i)) for i in range(20)]
    rows += [(2000, N.OPENED, "telegram", None, "u9", 9, 1, "{}", START), (2001, "other", "web", "s", None, None, None, "{}", START)]
    return rows


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    rows = stream_rows()
    people = [(1, "u1", "c", START, None, "chat", True, None, None)]
    profiles = spark.createDataFrame(people, schemas.ACCOUNT_PROFILE)
    rows.sort(key=lambda r: (r[8], r[0]))
    source = spark.createDataFrame(rows, ingest.EVENT_COLUMNS)
    empty = spark.createDataFrame([], ingest.EVENT_COLUMNS + ", day date, batch long")
    accepted, rejected = ingest.ingest_batch(source, profiles, empty)
    want = {r["id"] for r in accepted.collect()}, {(r["id"], r["reason"]) for r in rejected.collect()}
    folder, root = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in (rows[:70], rows[70:120], rows[120:]):  # each part arrives later; every run resumes from the checkpoint
        spark.createDataFrame(part, ingest.EVENT_COLUMNS).coalesce(1).write.mode("append").parquet(folder)
        ingest.start_ingest(ingest.read_event_files(spark, folder, 1), lambda: profiles, root, f"{tmp_path}/state").awaitTermination()
    got = {r["id"] for r in spark.read.parquet(f"{root}/accepted").collect()}
    bad = {(r["id"], r["reason"]) for r in spark.read.parquet(f"{root}/rejected").collect()}
    assert (got, bad) == want
    reasons = {reason for _, reason in bad}
    assert reasons == {"session_or_account_limit", "repeated", "profile_unavailable", "known_name,web_name"}


def test_profile_changes_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for p in range(5):
        chat = activated = None
        for v in range(6):
            at = START + timedelta(hours=v)
            chat = chat or rng.choice([None, "c"])
            activated = activated or rng.choice([None, at])
            rows.append((p, f"u{p}", v, at, START, chat, activated, rng.random() > 0.4))
    schema = "profile_id long, user_id string, version long, changed_at timestamp, created_at timestamp, chat_id string, activated_at timestamp, active boolean"
    want = sorted(tuple(r) for r in limits.transition_events(spark.createDataFrame(rows, schema)).select("name", "profile_id", "occurred_at").collect())
    folder = f"{tmp_path}/versions"
    for low, high in ((0, 3), (3, 6)):
        part = [r for r in rows if low <= r[2] < high]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        changes = ingest.profile_changes(stream)
        changes.writeStream.format("parquet").option("path", f"{tmp_path}/changes").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["name"], r["profile_id"], r["occurred_at"]) for r in spark.read.parquet(f"{tmp_path}/changes").collect())
    assert got == want


def _web(rows):
    return [(i, s, u, at) for i, s, u, at in rows], "id long, session_id string, user_id string, occurred_at timestamp"


def test_late_events_find_their_places_taken(spark):
    hour = datetime(2026, 9, 1, 10)
    half = hour + timedelta(minutes=30)
    known = spark.createDataFrame(*_web([(i, f"k{i}", f"u{i}", half + timedelta(seconds=i)) for i in range(900)]))
    late = spark.createDataFrame(*_web([(5000, "late", "late", hour + timedelta(minutes=1)), (5001, "late", "late", hour - timedelta(minutes=5))]))
    got = {r["id"]: r["reason"] for r in limits.limit_site_events(late, known).collect()}
    assert got == {5000: "hourly_ceiling", 5001: None}
    same = spark.createDataFrame(*_web([(i, "s", None, half + timedelta(seconds=i)) for i in range(60)]))
    late = spark.createDataFrame(*_web([(5000, "s", None, hour + timedelta(minutes=1)), (5001, "s", None, half - timedelta(minutes=61))]))
    got = {r["id"]: r["reason"] for r in limits.limit_site_events(late, same).collect()}
    assert got == {5000: "session_or_account_limit", 5001: None}


def test_replay_with_other_profiles_leaves_nothing_over(spark, tmp_path):
    people = [(1, "u1", "c", START, None, "chat", True, None, None)]
    profiles = spark.createDataFrame(people, schemas.ACCOUNT_PROFILE)
    rows = [(1, N.OPENED, "telegram", None, "u1", 1, 1, "{}", START), (2, "other", "web", "s", None, None, None, "{}", START + timedelta(days=1))]
    folder, root = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame(rows, ingest.EVENT_COLUMNS).coalesce(1).write.parquet(folder)
    for number, known in enumerate((profiles, profiles.limit(0))):  # the same batch 0 again, profiles gone meanwhile
        ingest.start_ingest(ingest.read_event_files(spark, folder), lambda known=known: known, root, f"{tmp_path}/state{number}").awaitTermination()
    accepted = {r["id"] for r in spark.read.parquet(f"{root}/accepted").collect()} if any(p.suffix == ".parquet" for p in (tmp_path / "out" / "accepted").rglob("*")) else set()
    rejected = {r["id"] for r in spark.read.parquet(f"{root}/rejected").collect()}
    assert 1 not in accepted and rejected == {1, 2}
