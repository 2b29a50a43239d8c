"""Samples, label sheets and agreement between judge, people and gold labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmatch.functions.dates import local_date, publication_date
from postmatch.operators.keyed import first_per_key, top_per_key
from postmatch.plans import names as N

DELIVERY = ("profile_id", "source", "external_id")
HIGH_SCORE = 70
WORST_SHOWN = 5
JUDGE_BATCH = 8
EXTRACTION_BATCH = 10


def draw(keys: Sequence[str], seed: int) -> Column:
    """A repeatable draw per row that does not depend on partitioning."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))


def sample_n(df: DataFrame, n: int, seed: int, keys: Sequence[str] = DELIVERY) -> DataFrame:
    """Simple random sample of n rows (all when fewer): the sample size is the feature's limit."""
    drawn = df.withColumn("_draw", draw(keys, seed))
    return drawn.orderBy("_draw", *keys).limit(n).drop("_draw")


def stratified_sample(df: DataFrame, n: int, seed: int, stratum: str, keys: Sequence[str]) -> DataFrame:
    """One row of each stratum in turn until n: a stratum never needs more than n rows."""
    drawn = df.withColumn("_draw", draw(keys, seed))
    turns = top_per_key(drawn, [stratum], [F.col("_draw"), *map(F.col, keys)], n)
    return turns.orderBy("_rank", stratum).limit(n).drop("_draw", "_rank")


def label_sheet(deliveries: DataFrame) -> DataFrame:
    """Flat export of deliveries with empty label fields."""
    return deliveries.select(
        "profile_id", "course", "source", "external_id", "title", "company", "location", "url",
        local_date(F.col("sent_at")).cast("string").alias("sent_on"),
        "score",
        F.lit(None).cast("boolean").alias("relevant"),
        F.lit("").alias("comment"),
    )


def discard_sheet(discards: DataFrame) -> DataFrame:
    """Flat export of discarded pairs with empty review fields; the sensitive flag is not part of it."""
    return discards.select(
        "profile_id", "course", F.col("city").alias("profile_city"), F.col("p_mode").alias("profile_mode"),
        "reason", "source", "external_id", "title", "company", "location", "url",
        publication_date(F.col("published_at")).cast("string").alias("published_on"),
        F.lit(None).cast("boolean").alias("discard_correct"),
        F.lit("").alias("comment"),
    )


def without_sensitive(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("p_disability", F.lit(None).cast("boolean"))


def judged_deliveries(sampled: DataFrame, judgements: DataFrame, order: str = "seq") -> DataFrame:
    """Sampled deliveries with the first judgement of each; unanswered ones keep nulls."""
    first = first_per_key(judgements, list(DELIVERY), [F.col(order)])
    return sampled.join(first.drop(order), list(DELIVERY), "left")


def judge_summary(judged: DataFrame) -> DataFrame:
    """Counts, relevant share and median scores over judged deliveries.

    Scores are whole numbers from 0 to 100, so the percentile keeps at most 101 counts.
    """
    answered = F.col("relevant").isNotNull()
    return judged.agg(
        F.count(F.lit(1)).alias("sampled"),
        F.count_if(answered).alias("judged"),
        F.count_if(~answered).alias("unjudged"),
        F.avg(F.col("relevant").cast("int")).alias("relevant_share"),
        F.percentile(F.when(answered, F.col("judge_score")), F.lit(0.5)).alias("median_judge"),
        F.percentile(F.when(answered, F.col("score")), F.lit(0.5)).alias("median_score"),
    )


def judge_by_profile(judged: DataFrame) -> DataFrame:
    answered = judged.filter(F.col("relevant").isNotNull())
    return answered.groupBy("course", "profile_id").agg(
        F.count(F.lit(1)).alias("judged"),
        F.count_if("relevant").alias("relevant"),
        F.percentile("judge_score", F.lit(0.5)).alias("median_judge"),
        F.percentile("score", F.lit(0.5)).alias("median_score"),
    )


def judge_problems(judged: DataFrame) -> DataFrame:
    named = judged.filter(F.col("problem").isNotNull())
    return named.groupBy("problem").agg(F.count(F.lit(1)).alias("total"))


def agreement(judged: DataFrame) -> DataFrame:
    """How often judge and feedback agree; a closed posting says nothing about relevance."""
    answered = judged.filter(
        F.col("relevant").isNotNull()
        & F.col("feedback").isNotNull()
        & ~F.col("feedback_reason").eqNullSafe(F.lit(N.REASON_CLOSED))
    )
    agrees = F.col("relevant") == (F.col("feedback") == N.USEFUL)
    return answered.agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(agrees).alias("agreed"), F.avg(agrees.cast("int")).alias("rate")
    )


def gold_agreement(judged: DataFrame, labels: DataFrame) -> DataFrame:
    gold = labels.select(*DELIVERY, F.col("relevant").alias("gold"))
    joined = judged.filter(F.col("relevant").isNotNull()).join(gold, list(DELIVERY))
    agrees = F.col("relevant") == F.col("gold")
    return joined.agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(agrees).alias("agreed"), F.avg(agrees.cast("int")).alias("rate")
    )


def disagreements(judged: DataFrame, labels: DataFrame) -> DataFrame:
    gold = labels.select(*DELIVERY, F.col("relevant").alias("gold"))
    return judged.join(gold, list(DELIVERY)).filter(F.col("relevant") != F.col("gold"))


def labels_outside(labels: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Labels whose delivery is not among the selected ones."""
    return labels.join(deliveries.select(*DELIVERY), list(DELIVERY), "left_anti")


def labelled_deliveries(deliveries: DataFrame, labels: DataFrame) -> DataFrame:
    return deliveries.join(labels.select(*DELIVERY), list(DELIVERY), "left_semi")


def worst_disagreements(judged: DataFrame, minimum: int = HIGH_SCORE, n: int = WORST_SHOWN) -> DataFrame:
    """Rejected by the judge although scored high: the five highest scores."""
    bad = judged.filter((F.col("relevant") == F.lit(False)) & (F.col("score") >= minimum))
    return bad.orderBy(F.col("score").desc(), *DELIVERY).limit(n)
