"""Postings from the three recorded search payloads, with malformed records set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmatch import fixed_values as V
from postmatch.functions.dates import instant
from postmatch.functions.text import clean_html, is_truncated, strip_invalid
from postmatch.operators.keyed import numbered

NAMED = "struct<display_name:string,area:array<string>>"
SOURCE_A_RECORD = (
    f"id string, title string, description string, created string, redirect_url string,"
    f" company struct<display_name:string>, location {NAMED}"
)
SOURCE_B_RECORD = (
    "id string, name string, description string, careerPageName string, publishedDate string,"
    " city string, state string, jobUrl string, workplaceType string"
)
SOURCE_C_RECORD = (
    "id string, title string, snippet string, company string, location string, source string,"
    " link string, updated string"
)
NO_ORIGIN = "struct<partner:string,partner_id:string,domain:string>"


def read_records(spark: SparkSession, path: str, record: str, field: str) -> DataFrame:
    """One row per record of the payload's list: raw text, arrival order and the typed record.

    Records stay text until they are parsed one by one, so a malformed record never costs its page.
    """
    pages = spark.read.schema(f"{field} array<string>").option("multiLine", True).json(path)
    listed = pages.select(F.input_file_name().alias("_file"), F.posexplode(field).alias("at", "raw"))
    # Files arrive in name order; a page holds far fewer than a million records.
    order = F.struct("_file", "at")
    return parse_records(listed.withColumn("arrival", order), record)


def parse_records(raw: DataFrame, record: str, column: str = "raw") -> DataFrame:
    """Adds `record`; it is null when the text is not a record of this schema."""
    schema = T.StructType.fromDDL(f"{record}, _corrupt string")
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return raw.withColumn("_parsed", parsed).withColumn(
        "record", F.when(F.col("_parsed").isNotNull() & F.col("_parsed._corrupt").isNull(), F.col("_parsed"))
    ).drop("_parsed")


def split_malformed(parsed: DataFrame, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): a record needs to parse and to have its required fields."""
    complete = F.col("record").isNotNull()
    for name in required:
        complete = complete & F.col(f"record.{name}").isNotNull()
    complete = F.coalesce(complete, F.lit(False))
    return parsed.filter(complete), parsed.filter(~complete)


def timestamp_utc(text: Column) -> Column:
    """ISO instants with any number of fraction digits; without an offset they are UTC."""
    micros = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    return F.try_to_timestamp(micros)


def displayed(name: Column, default: str) -> Column:
    trimmed = F.trim(name)
    return F.when(F.length(trimmed) > 0, trimmed).otherwise(default)


def place_from_parts(*parts: Column) -> Column:
    """Non-empty parts joined by a comma, else the country."""
    named = F.concat_ws(", ", *[F.when(F.length(p) > 0, F.trim(p)) for p in parts])
    return F.when(named != "", named).otherwise(V.DEFAULT_LOCATION)


REQUIRED_A = ("id", "title", "description", "redirect_url", "created")
REQUIRED_B = ("id", "name", "description", "jobUrl", "publishedDate")
REQUIRED_C = ("id", "title", "link", "updated")


def _posting(source: str, **columns: Column) -> list[Column]:
    texts = ("external_id", "title", "company", "location", "description", "url")
    cleaned = {k: strip_invalid(c) if k in texts else c for k, c in columns.items()}
    return [F.lit(source).alias("source"), *[c.alias(k) for k, c in cleaned.items()]]


def postings_from_a(records: DataFrame) -> DataFrame:
    r = F.col("record")
    area = r["location"]["area"]
    city = F.concat_ws(", ", F.try_element_at(area, F.lit(4)), F.try_element_at(area, F.lit(3)))
    where = F.when(F.size(area) > 3, city).otherwise(displayed(r["location"]["display_name"], V.DEFAULT_LOCATION))
    return records.select(
        *_posting(
            V.SOURCE_A,
            external_id=r["id"],
            title=r["title"],
            company=displayed(r["company"]["display_name"], V.UNKNOWN_COMPANY),
            location=where,
            description=r["description"],
            url=r["redirect_url"],
            published_at=timestamp_utc(r["created"]),
            mode=F.lit(None).cast("string"),
            description_complete=~is_truncated(r["description"]),
            origin=F.lit(None).cast(NO_ORIGIN),
        ),
        "arrival",
    )


def postings_from_b(records: DataFrame) -> DataFrame:
    r = F.col("record")
    mode = F.lit(None).cast("string")
    for workplace, value in V.WORKPLACE_MODES.items():
        mode = F.when(r["workplaceType"] == workplace, value).otherwise(mode)
    return records.select(
        *_posting(
            V.SOURCE_B,
            external_id=r["id"],
            title=F.trim(r["name"]),
            company=displayed(r["careerPageName"], V.UNKNOWN_COMPANY),
            location=place_from_parts(r["city"], r["state"]),
            description=clean_html(r["description"]),
            url=r["jobUrl"],
            published_at=timestamp_utc(r["publishedDate"]),
            mode=mode,
            description_complete=F.lit(True),
            origin=F.lit(None).cast(NO_ORIGIN),
        ),
        "arrival",
    )


def postings_from_c(records: DataFrame) -> DataFrame:
    r = F.col("record")
    company = clean_html(F.coalesce(r["company"], F.lit("")))
    domain = F.lower(F.trim(r["source"]))
    origin = F.struct(
        F.lit(None).cast("string").alias("partner"), F.lit(None).cast("string").alias("partner_id"), domain.alias("domain")
    )
    return records.select(
        *_posting(
            V.SOURCE_C,
            external_id=r["id"],
            title=clean_html(r["title"]),
            company=F.when(company != "", company).otherwise(V.UNKNOWN_COMPANY),
            location=displayed(r["location"], V.DEFAULT_LOCATION),
            description=clean_html(F.coalesce(r["snippet"], F.lit(""))),
            url=r["link"],
            published_at=timestamp_utc(r["updated"]),
            mode=F.lit(None).cast("string"),
            description_complete=F.lit(False),
            origin=F.when(F.length(domain) > 0, origin),
        ),
        "arrival",
    )


def recent(postings: DataFrame, now, days: int = 3, by_day: bool = False) -> DataFrame:
    """Postings of the last days; source C compares UTC days, the others instants. Undated ones go."""
    since = instant(now) - F.make_dt_interval(F.lit(days))
    if by_day:
        return postings.filter(F.to_date("published_at") >= F.to_date(since))
    return postings.filter(F.col("published_at") >= since)


def with_seq(postings: DataFrame) -> DataFrame:
    """Arrival order as one number: files in name order, records in page order."""
    placed = numbered(postings, [], [F.col("arrival.at")], [F.col("arrival._file")], "seq")
    return placed.drop("arrival")
