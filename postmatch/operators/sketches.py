"""Mergeable sketches of distinct people and of durations, one row a day: an opt-in beside the exact figures.

A sketch of a day is written once and has a fixed size, whatever the day's events; any window is a union of its
days' sketches and reads no events. Distinct counts have a relative standard error of 1.04 / sqrt(2^LG); ranks of
quantiles are off by about 2.3 / K^0.9 of the values at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG = 14
K = 400


def count_error() -> float:
    return 1.04 / 2 ** (LG / 2)


def rank_error() -> float:
    return 2.3 / K**0.9


def daily_people(events: DataFrame, day: Column, person: str = "person", keys: Sequence[str] = ("name",)) -> DataFrame:
    """(day, keys, people): a sketch of the distinct people of each day; rows without a person do not count."""
    known = events.filter(F.col(person).isNotNull())
    return known.groupBy(day.alias("day"), *keys).agg(F.hll_sketch_agg(person, F.lit(LG)).alias("people"))


def people_between(sketches: DataFrame, first: Column, last: Column, keys: Sequence[str] = ("name",)) -> DataFrame:
    """(keys, people): about how many distinct people the days from first to last had."""
    window = sketches.filter(F.col("day").between(first, last))
    return window.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("people")).alias("people"))


def daily_values(rows: DataFrame, day: Column, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(day, keys, values): a sketch of the whole-number values of each day; nulls do not count."""
    known = rows.filter(F.col(value).isNotNull())
    return known.groupBy(day.alias("day"), *keys).agg(F.kll_sketch_agg_bigint(value, F.lit(K)).alias("values"))


def quantile_between(sketches: DataFrame, first: Column, last: Column, q: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, quantile) over the days from first to last."""
    window = sketches.filter(F.col("day").between(first, last))
    return window.groupBy(*keys).agg(F.kll_sketch_get_quantile_bigint(F.kll_merge_agg_bigint("values"), F.lit(q)).alias("quantile"))
