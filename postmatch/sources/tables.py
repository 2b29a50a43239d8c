"""Stored tables, unions of sources and label sheets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmatch import schemas


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table under its declared schema; nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in parallel over ranges of a numeric key."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high),
        numPartitions=str(parts), **options,
    ).load()


def read_stored_extractions(postings: DataFrame, column: str = "extraction") -> DataFrame:
    """Typed extractions from stored JSON; text that no longer fits the schema counts as missing."""
    schema = T.StructType([*schemas.EXTRACTION.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(column, schema, {"columnNameOfCorruptRecord": "_corrupt"})
    typed = postings.withColumn("_e", parsed)
    return typed.withColumn(column, F.when(F.col("_e._corrupt").isNull(), F.col("_e").dropFields("_corrupt"))).drop("_e")


class AllSourcesFailed(ValueError):
    pass


def union_sources(
    collected: Mapping[str, DataFrame | None], problems: Mapping[str, str] | None = None, gap: int = 1 << 40
) -> tuple[DataFrame, DataFrame]:
    """(postings, status): sources in the given order, each with its own range of `seq`.

    A source that is None failed; one with a problem but rows is partial. All failed is an error.
    """
    problems = dict(problems or {})
    usable = {name: df for name, df in collected.items() if df is not None}
    if not usable:
        raise AllSourcesFailed("; ".join(f"{name}: {problems.get(name, '')}" for name in collected))
    spark = next(iter(usable.values())).sparkSession
    order = {name: i for i, name in enumerate(collected)}
    parts = [df.withColumn("seq", F.col("seq") + F.lit(order[name] * gap)) for name, df in usable.items()]
    state = [
        (name, "failed" if name not in usable else "partial" if name in problems else "ok", problems.get(name))
        for name in collected
    ]
    status = spark.createDataFrame(state, "source string, state string, reason string")
    return reduce(lambda a, b: a.unionByName(b), parts), status


LABEL_KEYS = ("profile_id", "source", "external_id")


def write_label_sheet(rows: DataFrame, path: str) -> None:
    """Sampled rows as JSON lines, label fields kept although empty."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def read_label_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows of a sheet; a malformed sheet is an error."""
    schema = "profile_id string, source string, external_id string, relevant boolean"
    sheet = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    keyed = F.col("profile_id").rlike("^[0-9a-fA-F-]{36}$") & F.col("source").isNotNull() & F.col("external_id").isNotNull()
    checked = sheet.withColumn(
        "profile_id",
        F.when(keyed, F.lower("profile_id")).otherwise(F.raise_error(F.lit("label sheet row without a valid key"))),
    )
    return checked.filter(F.col("relevant").isNotNull())


def publish(df: DataFrame, root: str, version: str) -> str:
    """Write one immutable version of a table; readers name the version they use."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def keyed_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_anti")
