from datetime import datetime

import pytest

from postmatch import schemas
from postmatch.plans import funnel
from postmatch.plans import names as N

NOW = "2026-09-09 12:00:00"


def at(text):
    return datetime.fromisoformat(text if len(text) > 10 else text + " 00:00:00")


def profiles(spark, changed=()):
    old = [(n, f"p{n}", "Computação", at("2020-01-01"), None, None, n == 17, at("2026-09-01") if n == 18 else None, r) for n, r in (
        (10, "conseguiu_estagio"), (11, "interrompeu_busca"), (12, "sem_vagas_uteis"), (13, "frequencia"),
        (14, "outro"), (15, None), (16, None), (17, "outro"), (18, "outro"))]
    rows = [
        (1, "dono", "Computação", at("2026-09-03"), at("2026-09-03"), "123", True, None, None),
        (2, "antigo", "Direito", at("2026-08-01"), at("2026-08-02"), None, True, None, None),
        *old,
    ]
    return spark.createDataFrame(rows, schemas.ACCOUNT_PROFILE)


def deliveries(spark, second="2026-09-08"):
    sent = [(1, 1, "2026-09-03"), (1, 1, "2026-09-03 00:00:30"), (1, 2, "2026-09-03"), (1, 3, "2026-09-04"), (2, 1, second)]
    return spark.createDataFrame([(p, q, at(t), None, None) for p, q, t in sent], schemas.DELIVERY)


def postings(spark):
    rows = [
        (1, True, at("2026-09-03"), ["Python"], None),
        (2, True, at("2026-09-03"), ["Python", "SQL", "Git"], None),
        (3, False, None, None, None),
    ]
    return spark.createDataFrame(rows, schemas.STORED_POSTING)


def events(spark, *more):
    people = [
        (N.ACCOUNT_CREATED, "antigo", None, "2026-08-01"), (N.LANDING, None, "s1", "2026-09-03"),
        (N.ACCOUNT_CREATED, "dono", "s1", "2026-09-03 01:00:00"), (N.EMAIL_CONFIRMED, "dono", "s1", "2026-09-03 02:00:00"),
        (N.LANDING, None, "abandono", "2026-09-04"), (N.ACCOUNT_CREATED, "sem-confirmacao", None, "2026-09-04"),
    ]
    score = {N.REASON_KEY: N.REASON_SCORE}
    pairs = [
        (N.OPENED, 1, 1, "2026-09-04", {}), (N.OPENED, 1, 1, "2026-09-04", {}), (N.USEFUL, 1, 1, "2026-09-04", {}),
        (N.USEFUL, 1, 1, "2026-09-04", {}), (N.APPLIED, 1, 1, "2026-09-04", {}), (N.USEFUL, 1, 2, "2026-09-05", {}),
        (N.IRRELEVANT, 1, 2, "2026-09-06", score), (N.IRRELEVANT, 1, 2, "2026-09-06", score),
        (N.USEFUL, 1, 3, "2026-09-03", {}), (N.USEFUL, 2, 1, "2026-09-08", {}), (N.USEFUL, 1, 3, "2026-09-10", {}), *more,
    ]
    rows = [(i, n, "web", s, u, None, None, {}, at(t)) for i, (n, u, s, t) in enumerate(people)]
    rows += [(100 + i, n, "telegram", None, None, p, q, d, at(t)) for i, (n, p, q, t, d) in enumerate(pairs)]
    return spark.createDataFrame(rows, schemas.EVENT)


def groups(spark, log):
    clean = funnel.clean_events(log, profiles(spark), NOW)
    grouped = funnel.delivery_groups(deliveries(spark), postings(spark), NOW, 7)
    return {r["group"]: tuple(r)[1:] for r in funnel.refusals_by_group(clean, grouped).collect()}


def weeks(spark, log, sent=None):
    clean = funnel.clean_events(log, profiles(spark), NOW)
    facts = funnel.weekly_fact(profiles(spark), clean, sent or deliveries(spark), NOW, 7)
    rate = funnel.weekly_rate(facts, funnel.weeks_calendar(spark, NOW, 7))
    return [(str(r["week"]), r["partial"], r["activated"], r["useful"]) for r in rate.orderBy("week").collect()]


def test_golden_row(spark):
    row = funnel.funnel_row(profiles(spark), events(spark), deliveries(spark), postings(spark), NOW, 7).first()
    expected = {N.LANDING: 2, N.ACCOUNT_CREATED: 2, N.EMAIL_CONFIRMED: 1}
    assert {k: row["steps"][k] for k in expected} == expected
    assert (row["postings_opened"], row["postings_useful"], row["postings_irrelevant"]) == (1, 1, 1)
    assert row["pauses"] == {
        "conseguiu_estagio": 1, "frequencia": 1, "interrompeu_busca": 1, "outro": 1, "sem_motivo": 2, "sem_vagas_uteis": 1,
    }
    assert (row["eligible_for_answer"], row["answered"]) == (4, 3)
    assert (row["profiles_created"], row["profiles_without_delivery"], row["profiles_without_open"]) == (1, 0, 0)
    assert (row["median_seconds_to_delivery"], row["median_seconds_to_open"]) == (0.0, 86400.0)
    assert row["refusal_reasons"] == {N.REASON_SCORE: 1}
    assert (row["postings_sent"], row["postings_extracted"]) == (4, 2)


def test_golden_children(spark):
    log = events(spark)
    assert weeks(spark, log) == [("2026-08-31", False, 2, 1), ("2026-09-07", True, 2, 1)]
    assert groups(spark, log) == {"sem_extracao": (1, 0, 0), "tres_ou_mais": (1, 1, 1), "uma_ou_duas": (2, 0, 0)}


def test_closed_answer_is_a_reason_but_no_refusal(spark):
    log = events(spark, (N.IRRELEVANT, 1, 1, "2026-09-07", {N.REASON_KEY: N.REASON_CLOSED}))
    assert groups(spark, log)["uma_ou_duas"] == (2, 0, 0)


def test_later_answer_and_week_boundary(spark):
    changed = events(spark, (N.IRRELEVANT, 2, 1, "2026-09-09", {}))
    assert [w[3] for w in weeks(spark, changed)] == [1, 0]
    late = events(spark, (N.IRRELEVANT, 2, 1, "2026-09-09", {}), (N.USEFUL, 2, 1, "2026-09-07 02:00:00", {}))
    assert [w[3] for w in weeks(spark, late, deliveries(spark, "2026-09-06"))] == [2, 0]


def test_empty_tables_give_zeros_and_null_medians(spark):
    empty = [spark.createDataFrame([], s) for s in (schemas.ACCOUNT_PROFILE, schemas.EVENT, schemas.DELIVERY, schemas.STORED_POSTING)]
    row = funnel.funnel_row(*empty, NOW, 7).first()
    assert row["profiles_created"] == row["postings_useful"] == row["eligible_for_answer"] == 0
    assert row["median_seconds_to_delivery"] is None and row["median_seconds_to_open"] is None
    assert row["steps"] == {} and row["pauses"] == {}


def test_shared_session_has_no_owner(spark):
    rows = [
        (1, N.LANDING, "web", "shared", None, None, None, {}, at("2026-08-01")),
        (2, N.ACCOUNT_CREATED, "web", "shared", "a", None, None, {}, at("2026-09-04")),
        (3, N.ACCOUNT_CREATED, "web", "shared", "b", None, None, {}, at("2026-09-05")),
    ]
    log = spark.createDataFrame(rows, schemas.EVENT)
    clean = funnel.clean_events(log, spark.createDataFrame([], schemas.ACCOUNT_PROFILE), NOW)
    assert {r[0]: r[1] for r in funnel.funnel_steps(clean, NOW, 7).collect()} == {N.ACCOUNT_CREATED: 2}


def test_medians_use_observed_events_only(spark):
    people = [(i, u, "c", at("2026-09-03"), None, "1", True, None, None) for i, u in ((1, "a"), (2, "b"), (3, "c"))]
    sent = [(1, 1, "00:01:00"), (1, 1, "00:02:00"), (2, 2, "00:03:00"), (2, 1, "00:04:00")]
    opens = [(1, "2026-09-03 00:00:30"), (2, "2026-09-03 00:03:30"), (2, "2026-09-03 00:05:00"), (1, "2026-09-05 00:05:00")]
    row = funnel.funnel_row(
        spark.createDataFrame(people, schemas.ACCOUNT_PROFILE),
        spark.createDataFrame([(i, N.OPENED, "t", None, None, p, 1, {}, at(t)) for i, (p, t) in enumerate(opens)], schemas.EVENT),
        spark.createDataFrame([(p, q, at("2026-09-03 " + t), None, None) for p, q, t in sent], schemas.DELIVERY),
        spark.createDataFrame([(1, True, at("2026-09-03"), [], None), (2, True, at("2026-09-03"), ["x"], None)], schemas.STORED_POSTING),
        "2026-09-04 00:00:00", 7,
    ).first()
    assert (row["profiles_created"], row["profiles_without_delivery"], row["profiles_without_open"]) == (3, 1, 2)
    assert (row["median_seconds_to_delivery"], row["median_seconds_to_open"]) == (120.0, 300.0)


@pytest.mark.parametrize("size", [1, 2, 7, 400])
def test_exact_median(spark, size):
    import random
    import statistics

    from postmatch.operators.keyed import exact_median

    values = [random.Random(size).randrange(-(10**13), 10**13) for _ in range(size)] + [5] * (size // 3)
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert exact_median(df, "v").first()[0] == statistics.median(values)
