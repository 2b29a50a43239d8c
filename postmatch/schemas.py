"""Declared schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B, TS, DATE = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
    T.DateType(),
)
TEXTS = T.ArrayType(S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


ORIGIN = _struct(partner=S, partner_id=S, domain=S)
POSTING = _struct(
    source=S,
    external_id=S,
    title=S,
    company=S,
    location=S,
    description=S,
    url=S,
    published_at=TS,
    mode=S,
    description_complete=B,
    origin=ORIGIN,
    seq=L,
)
EXTRACTION = _struct(
    source=S,
    external_id=S,
    model=S,
    area=S,
    areas=TEXTS,
    accepted_courses=TEXTS,
    any_course=B,
    min_period=I,
    min_years=I,
    desirable_exp=B,
    required_skills=TEXTS,
    main_skills=TEXTS,
    nice_skills=TEXTS,
    mode=S,
    catch_alert=S,
    read_complete=B,
)
PROFILE = _struct(
    profile_id=S,
    course=S,
    period=I,
    skills=TEXTS,
    city=S,
    mode=S,
    interest_areas=TEXTS,
    refused_areas=TEXTS,
    disability=B,
)
ACCOUNT_PROFILE = _struct(
    profile_id=L,
    user_id=S,
    course=S,
    created_at=TS,
    activated_at=TS,
    chat_id=S,
    active=B,
    deleted_at=TS,
    pause_reason=S,
)
DELIVERY = _struct(profile_id=L, posting_id=L, sent_at=TS, token=S, asked_at=TS)
EVENT = _struct(
    id=L,
    name=S,
    origin=S,
    session_id=S,
    user_id=S,
    profile_id=L,
    posting_id=L,
    properties=T.MapType(S, S),
    occurred_at=TS,
)
STORED_POSTING = _struct(
    posting_id=L, extracted=B, extracted_at=TS, required_skills=TEXTS, areas=TEXTS
)
USAGE = _struct(source=S, day=DATE, requests=L)
SITE_HOUR = _struct(hour=TS, anonymous=B, total=L)
JUDGEMENT = _struct(
    profile_id=S, source=S, external_id=S, relevant=B, judge_score=I, problem=S, reason=S
)
LABEL = _struct(profile_id=S, source=S, external_id=S, relevant=B)
MUNICIPALITY = _struct(municipality=S, uf=S, region_id=L, region_rank=I)
