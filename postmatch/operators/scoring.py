"""Score, objective limits and explanations of a candidate pair.

Posting, extraction and profile features are prepared once per row of their own table; a pair is then
scored with column expressions only, so scoring adds no shuffle to the candidate join.
Profile columns carry the prefix p_, extraction columns the prefix e_.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmatch import fixed_values as V
from postmatch import skill_values as S
from postmatch.functions import skills
from postmatch.functions.courses import AreaCatalog
from postmatch.functions.text import fold_text, recognize_mode
from postmatch.operators.candidates import pair_proximity
from postmatch.operators.keyed import first_per_key
from postmatch.operators.skill_sets import met_phrases
from postmatch.sources.regions import DISTANT, SAME_CITY, SAME_REGION

GOOD, PARTIAL, BAD = "compativel", "parcial", "incompativel"
LISTS = ["required_skills", "main_skills", "nice_skills"]
TEXTS = "array<string>"


def some(column: Column, kind: str = TEXTS) -> Column:
    return F.coalesce(column, F.array().cast(kind))


def _mapped(values: Column, table: dict[str, str]) -> Column:
    """Values of a small fixed table for an array of keys, nulls dropped."""
    if not table:
        return F.array().cast(TEXTS)
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_distinct(F.array_compact(F.transform(values, lambda v: F.try_element_at(pairs, v))))


# --- extraction features ----------------------------------------------------------------------------
def accepted_items(courses: Column) -> Column:
    """(formation, course) of each accepted item: items that name a technical course are split into
    their alternatives, and the course drops the level at its start."""

    def split_item(item: Column) -> Column:
        folded = fold_text(item)
        parts = F.split(folded, V.ITEM_ALTERNATIVES)
        several = folded.rlike(V.TECHNICAL_WORD) & (F.size(parts) > 1)
        return F.when(
            several,
            F.transform(
                parts,
                lambda p: F.struct(p.alias("formation"), F.regexp_replace(p, V.LEVEL_AT_START, "").alias("course")),
            ),
        ).otherwise(F.array(F.struct(item.alias("formation"), item.alias("course"))))

    return F.flatten(F.transform(courses, split_item))


def extraction_features(
    extractions: DataFrame, catalog: AreaCatalog, courses: DataFrame, dictionary: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Per extraction: parsed skills, recognised areas, accepted courses, level flags.

    `courses` is the course dictionary over `accepted_course_names`; `dictionary` the skill dictionary.
    """
    keys = list(keys)
    cleaned = clean_extractions(extractions, catalog)
    parsed = skills.with_phrases(cleaned, keys, LISTS, dictionary)
    items = cleaned.select(*keys, F.explode(accepted_items(some(F.col("accepted_courses")))).alias("_i")).select(*keys, "_i.*")
    forms = courses.select(F.col("course").alias("formation"), F.col("technical").alias("f_technical"), F.col("higher").alias("f_higher"))
    names = courses.select("course", "normalized", "area")
    per_posting = (
        items.join(forms, "formation", "left")
        .join(names, "course", "left")
        .groupBy(*keys)
        .agg(
            F.collect_set(F.when(F.col("normalized") != "", F.struct("normalized", "area"))).alias("e_accepted"),
            F.bool_or("f_technical").alias("_technical"),
            F.bool_or("f_higher").alias("_higher"),
        )
    )
    open_text = F.exists(some(F.col("accepted_courses")), lambda c: fold_text(c).isin(*V.OPEN_TO_ANY_COURSE))
    areas = F.array_distinct(F.transform(some(F.col("areas")), lambda a: F.lower(F.trim(a))))
    recognised = F.array_intersect(areas, F.array(*map(F.lit, catalog.area_of_subarea)).cast(TEXTS))
    joined = parsed.join(per_posting, keys, "left")
    any_course = F.coalesce("any_course", F.lit(False)) | open_text
    return joined.select(
        *keys,
        F.col("area").alias("e_area"),
        recognised.alias("e_areas"),
        _mapped(recognised, catalog.area_of_subarea).alias("e_fields"),
        any_course.alias("e_any_course"),
        some(F.col("e_accepted"), "array<struct<normalized:string,area:string>>").alias("e_accepted"),
        (F.size(some(F.col("accepted_courses"))) > 0).alias("e_names_courses"),
        F.coalesce("any_course", F.lit(False)).alias("e_declares_any"),
        (~any_course & F.coalesce("_technical", F.lit(False)) & ~F.coalesce("_higher", F.lit(False))).alias("e_technical_only"),
        F.col("min_period").alias("e_min_period"),
        F.col("min_years").alias("e_min_years"),
        F.coalesce("desirable_exp", F.lit(False)).alias("e_desirable"),
        F.col("mode").alias("e_mode"),
        F.col("read_complete").alias("e_read_complete"),
        F.col("catch_alert").alias("e_catch_alert"),
        *[F.col(f"{c}_phrases").alias(f"e_{c}") for c in LISTS],
    )


def accepted_course_names(extractions: DataFrame) -> DataFrame:
    """Every formation and course string the accepted items hold, for the course dictionary."""
    items = extractions.select(F.explode(accepted_items(some(F.col("accepted_courses")))).alias("_i"))
    return items.select(F.explode(F.array("_i.formation", "_i.course")).alias("course"))


def clean_extractions(extractions: DataFrame, catalog: AreaCatalog) -> DataFrame:
    """Unknown areas and implausible minimum periods become null; the mode must be a known one."""
    known = [a.name for a in catalog.areas]
    area = F.lower(F.trim("area"))
    return extractions.withColumns(
        {
            "area": F.when(area.isin(*known), area) if known else F.lit(None).cast("string"),
            "min_period": F.when(F.col("min_period").between(1, 12), F.col("min_period")),
            "mode": recognize_mode(F.col("mode")),
        }
    )


def profile_facts(profiles: DataFrame, catalog: AreaCatalog, courses: DataFrame) -> DataFrame:
    """p_ columns of a profile without its skills: all that the discard rules need, once the place columns are
    added by `identify_municipality(..., prefix="p_")`."""
    named = profiles.join(courses.drop("folded", "names", "higher"), "course", "left")
    interests = some(F.col("interest_areas"))
    return named.select(
        F.col("profile_id").alias("p_profile_id"),
        F.col("course").alias("p_course"),
        F.col("normalized").alias("p_normalized"),
        F.col("area").alias("p_area"),
        F.coalesce("technical", F.lit(False)).alias("p_technical"),
        F.col("period").alias("p_period"),
        F.col("city").alias("p_city"),
        F.col("mode").alias("p_mode"),
        F.col("disability").alias("p_disability"),
        interests.alias("p_interests"),
        _mapped(interests, catalog.area_of_subarea).alias("p_fields"),
        F.array_except(some(F.col("refused_areas")), interests).alias("p_refused"),
        F.exists(some(F.col("skills")), lambda s: F.trim(s) != "").alias("p_has_skills"),
        some(F.col("skills")).alias("p_skills"),
    )


def profile_features(
    profiles: DataFrame, catalog: AreaCatalog, courses: DataFrame, dictionary: DataFrame
) -> DataFrame:
    """The facts of a profile and the numbers of the skill phrases it meets."""
    facts = profile_facts(profiles, catalog, courses)
    met = met_phrases(facts.select(F.col("p_skills").alias("skills")), dictionary)
    return facts.join(met.withColumnRenamed("skills", "p_skills"), "p_skills").drop("p_skills")


# --- levels -----------------------------------------------------------------------------------------
def area_level() -> Column:
    unknown = F.col("e_area").isNull() | F.col("p_area").isNull()
    return F.when(unknown, PARTIAL).when(F.col("e_area") == F.col("p_area"), GOOD).otherwise(BAD)


def _same_course(accepted: Column) -> Column:
    """Equal names, or the accepted name (or its singular) as a whole word of a known course."""
    mine, theirs = F.col("p_normalized"), accepted["normalized"]
    singular = F.when(
        theirs.endswith("s") & ~theirs.contains(" "), F.left(theirs, F.length(theirs) - 1)
    ).otherwise(theirs)
    pattern = F.concat(F.lit(r"\b(?:\Q"), theirs, F.lit(r"\E|\Q"), singular, F.lit(r"\E)\b"))
    inside = F.when(mine.contains(singular) & F.col("p_area").isNotNull(), F.rlike(mine, pattern))
    return (mine != "") & ((theirs == mine) | F.coalesce(inside, F.lit(False)))


def course_level(catalog: AreaCatalog) -> Column:
    swappable = [a.name for a in catalog.areas if a.interchangeable]

    def fits(accepted: Column) -> Column:
        same_area = (accepted["area"] == F.col("p_area")) & accepted["area"].isin(*swappable) if swappable else F.lit(False)
        return F.coalesce(same_area, F.lit(False)) | F.coalesce(_same_course(accepted), F.lit(False))

    return (
        F.when(F.col("e_any_course"), GOOD)
        .when(technical_only(), BAD)
        .when(F.size("e_accepted") == 0, PARTIAL)
        .when(F.exists("e_accepted", fits), GOOD)
        .otherwise(BAD)
    )


def technical_only() -> Column:
    return F.col("e_technical_only") & ~F.col("p_technical")


def below_period() -> Column:
    return F.coalesce(F.col("p_period") < F.col("e_min_period"), F.lit(False))


def period_level(below: Column | None = None) -> Column:
    below = below_period() if below is None else below
    return (
        F.when(F.coalesce(F.col("e_min_years") > 0, F.lit(False)) | below, BAD)
        .when(F.col("e_desirable"), PARTIAL)
        .otherwise(GOOD)
    )


def logistics() -> Column:
    mode, mine = F.col("mode"), F.col("p_mode")
    remote = mode.eqNullSafe(F.lit("remoto")) | (mine == "remoto")
    near = pair_proximity()
    place = F.when(remote, 1.0).when(near == SAME_CITY, 1.0).when(near == SAME_REGION, 0.5).otherwise(0.0)
    way = (
        F.when(mode.isNull(), 0.5)
        .when((mine == "indiferente") | (mode == mine), 1.0)
        .when((mine == "presencial") & (mode == "hibrido"), 0.5)
        .otherwise(0.0)
    )
    return (place + way) / 2


def interest() -> Column:
    areas, interests = F.col("e_areas"), F.col("p_interests")
    return (
        F.when(F.arrays_overlap(areas, F.col("p_refused")), 0.0)
        .when(F.size(interests) == 0, 1.0)
        .when(F.size(areas) == 0, 0.5)
        .when(F.arrays_overlap(areas, interests), 1.0)
        .when(F.arrays_overlap("e_fields", "p_fields"), 0.5)
        .otherwise(0.0)
    )


def _coefficient(level: Column) -> Column:
    return F.when(level == GOOD, 1.0).when(level == PARTIAL, 0.5).otherwise(0.0)


# --- score ------------------------------------------------------------------------------------------
def fill_from_extraction(pairs: DataFrame) -> DataFrame:
    """The source's mode wins over the extracted one; a recorded completeness wins over today's."""
    return pairs.withColumns(
        {
            "mode": F.coalesce("mode", "e_mode"),
            "description_complete": F.coalesce("e_read_complete", "description_complete"),
        }
    )


def _computing() -> Column:
    return F.coalesce(F.col("p_area") == V.COMPUTING_AREA, F.lit(False))


def _compare_words() -> Column:
    return ~_computing() & ~F.col("e_area").eqNullSafe(F.lit(V.COMPUTING_AREA))


def score_columns(pairs: DataFrame, catalog: AreaCatalog) -> DataFrame:
    """Adds levels, the 0-100 score and the verdicts of each skill list."""
    computing = _computing()
    met = F.when(_compare_words(), F.col("p_met")).otherwise(F.col("p_named"))
    verdicts = {f"v_{c}": skills.judged(F.col(f"e_{c}"), met) for c in LISTS}
    levelled = fill_from_extraction(pairs).withColumns(
        {
            **verdicts,
            "area_level": area_level(),
            "course_level": course_level(catalog),
            "period_level": period_level(),
        }
    )
    covered = levelled.withColumns({f"c_{c}": skills.coverage(F.col(f"v_{c}"), computing) for c in LISTS})
    parts = covered.withColumns(
        {
            "skill_part": skills.skill_component(*[F.col(f"c_{c}") for c in LISTS]),
            "logistics_part": logistics(),
            "interest_part": interest(),
        }
    )
    return parts.withColumn("score", _rounded_score())


def _outside_interest() -> Column:
    return (F.col("interest_part") == 0.0) | ((F.size("p_interests") > 0) & (F.size("e_areas") == 0))


def _rounded_score(outside: Column | None = None, below: Column | None = None) -> Column:
    """The 0-100 score of levels and parts, with the caps of interest, course and period."""
    outside = _outside_interest() if outside is None else outside
    below = below_period() if below is None else below
    w = S.WEIGHTS
    total = (
        F.lit(w["skills"]) * F.col("skill_part")
        + F.lit(w["course"]) * _coefficient(F.col("course_level"))
        + F.lit(w["area"]) * _coefficient(F.col("area_level"))
        + F.lit(w["period"]) * _coefficient(F.col("period_level"))
        + F.lit(w["logistics"]) * F.col("logistics_part")
        + F.lit(w["interest"]) * F.col("interest_part")
    )
    capped = F.least(
        total,
        F.when(outside, float(S.LIMIT_OUTSIDE_INTEREST)).otherwise(100.0),
        F.when(F.col("course_level") == BAD, float(S.LIMIT_COURSE_INCOMPATIBLE))
        .when(F.col("course_level") == PARTIAL, float(S.LIMIT_COURSE_PARTIAL))
        .otherwise(100.0),
        F.when(below, float(S.LIMIT_BELOW_PERIOD)).otherwise(100.0),
    )
    return F.floor(capped + 0.5).cast("int")


# --- explanations -----------------------------------------------------------------------------------
def explain_requirements(scored: DataFrame) -> DataFrame:
    """Adds requirements_met, requirements_unmet and nice_unmet, in list order.

    A requirement is named by its first variant, or where one is not met, by the first that is not.
    """
    needed = F.concat("v_required_skills", "v_main_skills")
    nice = F.col("v_nice_skills")
    only_nice = F.array_except(skills.identities(nice), skills.identities(needed))

    def named(wanted: Column, verdicts: Column) -> Column:
        first = F.transform(wanted, lambda i: F.try_element_at(F.filter(verdicts, lambda v: v["identity"] == i), F.lit(1)))
        return F.transform(first, lambda v: v["text"])

    def met(wanted: Column, verdicts: Column) -> Column:
        return named(F.array_except(wanted, skills.unmet_identities(verdicts)), verdicts)

    def unmet(wanted: Column, verdicts: Column) -> Column:
        missing = F.filter(verdicts, lambda v: ~v["met"])
        return named(F.array_intersect(wanted, skills.identities(missing)), missing)

    return scored.withColumns(
        {
            "requirements_met": F.concat(met(skills.identities(needed), needed), met(only_nice, nice)),
            "requirements_unmet": unmet(skills.identities(needed), needed),
            "nice_unmet": unmet(only_nice, nice),
        }
    )


def notices(catalog: AreaCatalog) -> Column:
    refused = F.array_sort(F.array_intersect("e_areas", "p_refused"))
    labels = F.array_join(_mapped(refused, catalog.subarea_labels), ", ")
    outside = (F.col("interest_part") == 0.0) & (F.size("p_interests") > 0)
    asks = F.exists(F.concat("e_required_skills", "e_main_skills"), lambda p: p["text"].isNotNull())
    return F.array_compact(
        F.array(
            F.when(F.size(refused) > 0, F.concat(F.lit(S.NOTICE_REFUSED_AREA + ": "), labels)).when(
                outside, S.NOTICE_OUTSIDE_INTEREST
            ),
            F.when(technical_only(), S.NOTICE_TECHNICAL_ONLY).when(
                F.col("course_level") == BAD, S.NOTICE_OTHER_COURSE
            ),
            F.when(below_period(), F.format_string(S.NOTICE_BELOW_PERIOD, "e_min_period")),
            F.when(asks & ~F.col("p_has_skills"), S.NOTICE_NO_SKILLS),
        )
    )


def points(scored: DataFrame, catalog: AreaCatalog) -> DataFrame:
    """Adds notices, points_for and points_against before the objective rules."""
    named = F.col("e_names_courses") | F.col("e_declares_any")
    good_course = (F.col("course_level") == GOOD) & named
    return scored.withColumns(
        {
            "notices": notices(catalog),
            "points_for": F.array_compact(F.array(F.when(good_course, S.POINT_COURSE))),
            "points_against": F.array_compact(
                F.array(F.when(F.coalesce(F.col("e_min_years") > 0, F.lit(False)), S.POINT_EXPERIENCE))
            ),
        }
    )


def _presence_elsewhere() -> tuple[Column, Column]:
    """(presence for a remote profile, presence in another place)."""
    present = F.col("mode").isin("presencial", "hibrido")
    wrong_mode = present & (F.col("p_mode") == "remoto")
    return wrong_mode, present & ~F.col("p_mode").isin("remoto", "presencial") & (pair_proximity() == DISTANT)


def _mode_limit() -> Column:
    wrong_mode, elsewhere = _presence_elsewhere()
    return F.when(F.coalesce(wrong_mode | elsewhere, F.lit(False)), S.LIMIT_MODE).otherwise(100)


def _complete() -> Column:
    return F.coalesce("description_complete", F.lit(True))


def _limited(after_mode: Column, complete: Column) -> Column:
    return F.when(complete, after_mode).otherwise(F.least(after_mode, F.lit(S.LIMIT_INCOMPLETE))).cast("int")


def _audience_point() -> Column:
    audience = F.col("audience")
    return F.when(audience == V.AUDIENCE_EXCLUSIVE, S.POINT_EXCLUSIVE).when(
        audience == V.AUDIENCE_AFFIRMATIVE_DISABILITY, S.POINT_AFFIRMATIVE
    )


def _priority() -> Column:
    return F.col("p_disability").eqNullSafe(F.lit(True)) & _audience_point().isNotNull()


def objective_rules(explained: DataFrame) -> DataFrame:
    """Caps for presence elsewhere and incomplete text, audience priority and notices.

    `score_before_limits` keeps the score the caps started from.
    """
    wrong_mode, elsewhere = _presence_elsewhere()
    mode_notice = F.when(wrong_mode, S.NOTICE_MODE).when(elsewhere, S.NOTICE_OTHER_CITY)
    after_mode = F.least(F.col("score"), _mode_limit())
    complete = _complete()
    audience = F.col("audience")
    point, priority = _audience_point(), _priority()
    audience_notice = F.when(
        ~priority,
        F.when(audience == V.AUDIENCE_GENERAL, None)
        .when(audience == V.AUDIENCE_EXCLUSIVE, S.NOTICE_EXCLUSIVE)
        .when(F.col("groups").isNull(), S.NOTICE_AFFIRMATIVE)
        .otherwise(F.concat(F.lit(S.NOTICE_AFFIRMATIVE_GROUPS), F.col("groups"))),
    )
    added = F.array_compact(
        F.array(
            F.when(after_mode < F.col("score"), mode_notice),
            F.when(~complete, S.NOTICE_INCOMPLETE),
            audience_notice,
        )
    )
    return explained.withColumns(
        {
            "score_before_limits": F.col("score"),
            "score": _limited(after_mode, complete),
            "notices": F.array_union("notices", added),
            "points_for": F.when(priority, F.array_union(F.array(point), "points_for")).otherwise(F.col("points_for")),
            "priority": priority,
        }
    )


def score_pairs(pairs: DataFrame, catalog: AreaCatalog) -> DataFrame:
    """Score, explanation and objective rules over joined candidate pairs."""
    explained = points(explain_requirements(score_columns(pairs, catalog)), catalog)
    ruled = objective_rules(explained)
    helper = [c for c in ruled.columns if c.startswith(("v_", "c_"))]
    return ruled.drop(*helper)


# --- scores alone -----------------------------------------------------------------------------------
#: What levels, logistics and the objective rules see of a profile.
KIND = ("p_area", "p_normalized", "p_technical", "p_city_name", "p_city_uf", "p_region_id", "p_mode", "p_disability")
#: The rest of what a score sees of a profile.
OWN = ("p_period", "p_interests", "p_refused", "p_fields", "p_named", "p_met")


def with_needs(postings: DataFrame) -> DataFrame:
    """Adds what each skill list asks for, in computing and elsewhere (`skills.needs`)."""
    return postings.withColumns({f"{kind}_{c}": skills.needs(F.col(f"e_{c}"), F.lit(kind == "k")) for c in LISTS for kind in ("k", "o")})


def kind_levels(pairs: DataFrame, catalog: AreaCatalog) -> DataFrame:
    """What a score needs of a posting and a kind of profile (`KIND`), computed once for all profiles of the kind.

    Keeps (seq, row, class_id, kind_id, _touched, arrival) and needs the columns of posting (`with_needs`), extraction and kind.
    """
    return fill_from_extraction(pairs).select(
        "seq", "row", "class_id", "kind_id", "_touched", "arrival", "e_min_period", "e_min_years", "e_desirable", "e_areas", "e_fields",
        area_level().alias("area_level"),
        course_level(catalog).alias("course_level"),
        logistics().alias("logistics_part"),
        _compare_words().alias("compare_words"),
        _mode_limit().alias("mode_limit"),
        _complete().alias("complete"),
        _priority().alias("priority"),
        *[F.when(_computing(), F.col(f"k_{c}")).otherwise(F.col(f"o_{c}")).alias(f"n_{c}") for c in LISTS],
    )


def best_numbers(pairs: DataFrame, own: bool = False) -> DataFrame:
    """Adds score and score_before_limits that no profile of the kind can pass (pairs as of `kind_levels`).

    They are those of a profile that meets every skill, whose interests the posting fits and who is far enough in the
    course; with `own`, interests and period are the profile's. Each part of a score only grows with these, and the sums
    are the same, so rounding keeps the order.
    """
    no = None if own else F.lit(False)
    whole = {c: F.struct(F.when(F.col(f"n_{c}.n") > 0, F.lit(1.0)).alias("value"), F.col(f"n_{c}.n").alias("met")) for c in LISTS}
    parts = pairs.withColumns({f"c_{c}": done for c, done in whole.items()}).withColumns(
        {
            "skill_part": skills.skill_component(*[F.col(f"c_{c}") for c in LISTS]),
            "period_level": period_level(no),
            "interest_part": interest() if own else F.lit(1.0),
        }
    )
    scored = parts.withColumn("score_before_limits", _rounded_score(no, no))
    return scored.withColumn("score", _limited(F.least(F.col("score_before_limits"), F.col("mode_limit")), F.col("complete")))


def rank_of_pair() -> Column:
    """Larger for the better of two pairs of a profile (the order of `ranking.ranking_order`)."""
    return F.struct("priority", "score", "score_before_limits", -F.col("arrival"))


def could_pass(pairs: DataFrame, last: str) -> DataFrame:
    """Pairs that may be better than the rank in column `last`, whatever skills the profile has; all where it is null."""
    possible = best_numbers(pairs, own=True).filter(F.col(last).isNull() | (rank_of_pair() >= F.col(last)))
    return possible.select(*pairs.columns)


def score_numbers(pairs: DataFrame) -> DataFrame:
    """(profile_id, p_row, row, arrival, priority, score, score_before_limits): the numbers of `score_pairs` without explanations."""
    met = F.when(F.col("compare_words"), F.col("p_met")).otherwise(F.col("p_named"))
    covered = pairs.withColumns({f"c_{c}": skills.covered(F.col(f"n_{c}"), met) for c in LISTS})
    parts = covered.withColumns(
        {
            "skill_part": skills.skill_component(*[F.col(f"c_{c}") for c in LISTS]),
            "period_level": period_level(),
            "interest_part": interest(),
        }
    )
    scored = parts.withColumn("score_before_limits", _rounded_score())
    limited = _limited(F.least(F.col("score_before_limits"), F.col("mode_limit")), F.col("complete"))
    return scored.select("profile_id", "p_row", "row", "arrival", "priority", limited.alias("score"), "score_before_limits")


def newest_extractions(extractions: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Of several readings of a posting the newest version holds."""
    return first_per_key(extractions, list(keys), [F.col(version).desc()]).drop(version)


# --- cached extractions -----------------------------------------------------------------------------
def with_cached_extraction(postings: DataFrame, extractions: DataFrame, model: str, keys: Sequence[str]) -> DataFrame:
    """Postings with the extraction of this model version, or nulls; `pending` marks those to read.

    A cached extraction that read an incomplete text is pending again once the text is complete.
    """
    same_model = extractions.filter(F.col("model") == model).withColumn("_cached", F.lit(True))
    joined = postings.join(same_model.drop("model"), list(keys), "left")
    less = (F.col("read_complete") == F.lit(False)) & F.col("description_complete")
    pending = F.col("_cached").isNull() | F.coalesce(less, F.lit(False))
    return joined.withColumn("cached", F.col("_cached").isNotNull()).withColumn("pending", pending).drop("_cached")
