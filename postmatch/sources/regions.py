"""Municipalities, their immediate regions, and how near two places are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmatch.functions.text import fold_place

SAME_CITY, SAME_REGION, DISTANT = "mesma_cidade", "mesma_regiao", "distante"


def build_region_catalog(municipalities: DataFrame, population: DataFrame) -> DataFrame:
    """(municipality_id, municipality, uf, region_id) with each region ranked by population.

    The first of a region is its hub. Missing populations count as zero; ties go by folded name.
    """
    counted = municipalities.join(population, "municipality_id", "left")
    people = F.coalesce("population", F.lit(0))
    order = W.partitionBy("region_id").orderBy(people.desc(), F.lower("municipality"))
    return counted.select(
        "municipality",
        "uf",
        "region_id",
        F.row_number().over(order).alias("region_rank"),
        fold_place(F.col("municipality")).alias("name"),
    )


def region_hubs(regions: DataFrame) -> DataFrame:
    return regions.filter(F.col("region_rank") == 1).select("region_id", F.col("municipality").alias("hub"))


def region_cities(regions: DataFrame) -> DataFrame:
    """Municipalities of each region, the most populous first."""
    ordered = F.array_sort(F.collect_list(F.struct("region_rank", "municipality")))
    return regions.groupBy("region_id").agg(F.transform(ordered, lambda c: c["municipality"]).alias("cities"))


def state_codes(states: DataFrame) -> DataFrame:
    """(state, uf) from (state_name, uf): the folded name and the lower-case code both lead to it."""
    named = states.select(fold_place(F.col("state_name")).alias("state"), "uf")
    coded = states.select(F.lower("uf").alias("state"), "uf")
    return named.unionByName(coded).distinct()


def identify_municipality(
    df: DataFrame, location: str, states: DataFrame, regions: DataFrame, prefix: str = ""
) -> DataFrame:
    """Adds <prefix>city_name, <prefix>city_uf and <prefix>region_id for a "name, state" column.

    Places are few next to rows: distinct spellings are identified once and joined back; the state
    list and the catalogue are dimensions Spark broadcasts when their measured size allows.
    """
    places = df.select(F.col(location).alias("_place")).filter(F.col("_place").isNotNull()).distinct()
    comma = F.instr("_place", ",")
    name = F.when(comma > 0, F.left("_place", comma - 1)).otherwise(F.col("_place"))
    rest = F.when(comma > 0, F.substring("_place", comma + 1, F.length("_place"))).otherwise(F.lit(""))
    split = places.select(
        "_place",
        fold_place(name).alias("name"),
        F.regexp_replace(fold_place(rest), "^estado d[aeo] ", "").alias("state"),
    )
    single = (
        regions.groupBy("name")
        .agg(F.min("uf").alias("_only"), F.max("uf").alias("_other"))
        .filter(F.col("_only") == F.col("_other"))
        .drop("_other")
    )
    known = (
        split.join(states, "state", "left")
        .join(single, "name", "left")
        .select("_place", "name", F.coalesce("uf", "_only").alias("uf"))
    )
    located = known.join(regions.select("name", "uf", "region_id"), ["name", "uf"], "left").select(
        "_place",
        F.col("name").alias(f"{prefix}city_name"),
        F.col("uf").alias(f"{prefix}city_uf"),
        F.col("region_id").alias(f"{prefix}region_id"),
    )
    return df.join(located, df[location] == located["_place"], "left").drop("_place")


def same_city(name: Column, uf: Column, other_name: Column, other_uf: Column) -> Column:
    codes_agree = uf.isNull() | other_uf.isNull() | (uf == other_uf)
    return (name != "") & (name == other_name) & codes_agree


def proximity(
    name: Column, uf: Column, region: Column, other_name: Column, other_uf: Column, other_region: Column
) -> Column:
    return (
        F.when(same_city(name, uf, other_name, other_uf), SAME_CITY)
        .when(region == other_region, SAME_REGION)
        .otherwise(DISTANT)
    )
