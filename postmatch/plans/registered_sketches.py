"""Sketched figures next to the exact ones: each query tells the exact figure and whether the sketch is within its error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmatch.functions.dates import local_date
from postmatch.operators import sketches as S
from postmatch.plans import bindings as B
from postmatch.plans import funnel
from postmatch.plans.registered_funnel import Frames
from postmatch.plans.registry import register
from postmatch.session import cut_lineage

WEEKS = 4


def _week(number: int):
    start = F.lit("2024-01-01").cast("date")
    return F.date_add(start, 7 * number), F.date_add(start, 7 * number + 6)


@register(
    "people_sketches",
    B.with_clean(
        """select week, name, count(distinct person) as people, true as within
from (select name, person, (occurred_at - interval 3 hour)::date as day from v_identified where person is not null), (select unnest(range(4)) as week)
where day between date '2024-01-01' + (7 * week)::int and date '2024-01-01' + (7 * week + 6)::int group by 1, 2"""
    ),
)
def people_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct people per week and event name, united from daily sketches, against the exact counts."""
    events = cut_lineage(funnel.identity_resolution(Frames(spark, sf_dir).clean).select("name", "person", "occurred_at"))
    day = local_date(F.col("occurred_at"))
    daily = cut_lineage(S.daily_people(events, day))
    weeks = []
    for number in range(WEEKS):
        first, last = _week(number)
        exact = events.filter(day.between(first, last) & F.col("person").isNotNull()).groupBy("name").agg(F.count_distinct("person").alias("exact"))
        both = S.people_between(daily, first, last).join(exact, "name", "full")
        off = F.abs(F.col("people") - F.col("exact")) <= F.ceil(F.lit(4 * S.count_error()) * F.col("exact"))
        weeks.append(both.select(F.lit(number).cast("long").alias("week"), "name", F.col("exact").alias("people"), F.coalesce(off, F.lit(False)).alias("within")))
    return reduce(DataFrame.unionByName, weeks)


@register(
    "quantile_sketches",
    f"""with {B.EVENTS_SQL}, d as (select (occurred_at - interval 3 hour)::date as day from v_events)
select week, count(*) as n, true as within from d, (select unnest(range(4)) as week)
where day between date '2024-01-01' + (7 * week)::int and date '2024-01-01' + (7 * week + 6)::int group by 1""",
)
def quantile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ninth decile of the second of the day per week, merged from daily sketches; its exact rank is within the error."""
    day = local_date(F.col("occurred_at"))
    rows = cut_lineage(B.events(spark, sf_dir).select("occurred_at", (F.unix_seconds("occurred_at") % 86400).alias("second")))
    daily = cut_lineage(S.daily_values(rows, day, "second"))
    weeks = []
    for number in range(WEEKS):
        first, last = _week(number)
        found = S.quantile_between(daily, first, last, 0.9).withColumn("week", F.lit(number).cast("long"))
        held = rows.filter(day.between(first, last)).withColumn("week", F.lit(number).cast("long"))
        ranked = held.join(F.broadcast(found), "week").groupBy("week").agg(  # one row a week
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("second") <= F.col("quantile")).alias("upto"), F.count_if(F.col("second") < F.col("quantile")).alias("below")
        )
        slack = F.ceil(F.lit(2 * S.rank_error()) * F.col("n")) + 1
        near = (F.col("upto") >= 0.9 * F.col("n") - slack) & (F.col("below") <= 0.9 * F.col("n") + slack)
        weeks.append(ranked.select("week", "n", near.alias("within")))
    return reduce(DataFrame.unionByName, weeks)
