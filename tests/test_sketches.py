"""Daily sketches against exact figures, over windows that read no events."""

import random

from pyspark.sql import functions as F

from postmatch.operators import sketches as S


def test_windows_unite_days(spark):
    rng = random.Random(1)
    rows = [(d, rng.choice("ab"), rng.randrange(20_000), rng.randrange(10**6)) for d in range(10) for _ in range(3000)] + [(3, "a", None, None)]
    df = spark.createDataFrame(rows, "d int, name string, person long, value long").withColumn("at", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    people, values = S.daily_people(df, F.col("at")).cache(), S.daily_values(df, F.col("at"), "value").cache()
    assert people.count() == 20 and values.count() == 10
    for first, last in ((0, 9), (2, 4), (7, 7)):
        days = [F.date_add(F.lit("2024-01-01").cast("date"), n) for n in (first, last)]
        got = {r["name"]: r["people"] for r in S.people_between(people, *days).collect()}
        for name in "ab":
            exact = len({p for d, n, p, _ in rows if first <= d <= last and n == name and p is not None})
            assert abs(got[name] - exact) <= 4 * S.count_error() * exact + 1
        own = sorted(v for d, _, _, v in rows if first <= d <= last and v is not None)
        found = S.quantile_between(values, *days).first()["quantile"]
        rank = sum(v <= found for v in own) / len(own)
        assert abs(rank - 0.5) <= 2 * S.rank_error() + 1 / len(own)
    empty = S.people_between(people, *[F.lit("2030-01-01").cast("date")] * 2)
    assert empty.count() == 0
