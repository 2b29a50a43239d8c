"""Discard rules and candidate pairs as equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmatch import fixed_values as V
from postmatch.functions.audience import with_audience
from postmatch.functions.context import areas_in_description, course_starts, requires_years
from postmatch.functions.courses import AreaCatalog, plain_fold
from postmatch.functions.matches import holds
from postmatch.functions.text import fold_text
from postmatch.operators.keyed import dealt_join, numbered, range_step
from postmatch.session import cut_lineage
from postmatch.sources.regions import DISTANT, SAME_CITY, proximity

ANY_AREA = "-"


# --- posting-only features --------------------------------------------------------------------------
def title_flags(folded_title: Column) -> dict[str, Column]:
    """Discard rules that need only the folded title."""
    also_higher = folded_title.rlike(V.TITLE_ALSO_HIGHER)
    return {
        "not_internship": ~folded_title.rlike(V.INTERNSHIP),
        "requires_seniority": folded_title.rlike(V.SENIORITY),
        "requires_postgrad": folded_title.rlike(V.POSTGRADUATE)
        & ~folded_title.rlike(V.UNDERGRADUATE_WITH_POSTGRADUATE),
        "requires_high_school": folded_title.rlike(V.HIGH_SCHOOL_TITLE) & ~also_higher,
        "requires_technical": folded_title.rlike(V.TECHNICAL_TITLE) & ~also_higher,
    }


def _matching_areas(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    if not patterns:
        return F.array().cast("array<string>")
    hits = F.array(*[F.when(text.rlike(pattern), F.lit(area)) for area, pattern in patterns])
    return F.array_compact(hits)


def pass_areas(catalog: AreaCatalog) -> Column:
    """Every course area (and "-" for an unknown one) a posting passes the field rule for.

    Depends on the posting alone, so the rule becomes an equi-join key.
    """
    any_course, title, excluded, described = map(
        F.col, ("any_course_text", "title_areas", "excluded_areas", "description_areas")
    )
    every = F.array(*[F.lit(a.name) for a in catalog.areas], F.lit(ANY_AREA))

    def passes(area: Column) -> Column:
        foreign = F.size(F.filter(excluded, lambda a: a != area)) > 0
        known = F.array_contains(title, area) | (~foreign & F.array_contains(described, area))
        return F.when(area == ANY_AREA, F.size(excluded) == 0).otherwise(known)

    return F.filter(every, lambda area: any_course | passes(area))


def posting_features(postings: DataFrame, catalog: AreaCatalog) -> DataFrame:
    """Everything the discard rules need from a posting, computed once per posting."""
    folded = postings.withColumns(
        {"f_title": fold_text(F.col("title")), "f_description": fold_text(F.col("description"))}
    )
    title, description = F.col("f_title"), F.col("f_description")
    both = F.concat_ws(" ", title, description)
    titles = [(a.name, catalog.title_pattern(a, plain_fold)) for a in catalog.areas]
    exclusions = [(a.name, rf"\b(?:{a.exclusion})\b") for a in catalog.areas if a.exclusion]
    flagged = with_audience(folded).withColumns(
        {
            **title_flags(title),
            "requires_years": requires_years(both),
            "any_course_text": holds(description, V.ANY_COURSE, ["qualquer", "todos os", "todas as"], ["curso", "formac", "graduac"]),
            "remote_text": holds(both, V.REMOTE_WORK, ["remot", "home", "trabalho"]),
            "on_site_text": holds(both, V.ON_SITE_WORK, ["presencial", "hibrid", "hybrid", "site"]),
            "title_areas": _matching_areas(title, titles),
            "excluded_areas": _matching_areas(title, exclusions),
            "description_areas": areas_in_description(description, catalog.description_patterns),
            "_cited": F.when(holds(description, rf"\b(?:{V.FORMATION_CONTEXT}|{V.FORMATION_LABEL})", V.FORMATION_PARTS), description),
        }
    )
    # Where a course may be named: the text once and the word starts, not one piece of text per start.
    flagged = flagged.withColumn("tails", F.struct(F.col("_cited").alias("text"), course_starts(F.col("_cited")).alias("starts")))
    flagged = flagged.drop("_cited")
    remote = F.when(F.col("mode").isNotNull(), F.col("mode") == "remoto").otherwise(F.col("remote_text"))
    return flagged.withColumns({"admits_remote": remote, "pass_areas": pass_areas(catalog)})


def course_mentions(features: DataFrame, courses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(posting keys, course) where a formation context announces one of the course's names.

    What follows a context, as far as the longest name goes, is joined to the distinct course names on
    its first word; the rest of the name is a residual prefix test, so no posting meets every course.
    """
    names = courses.select("course", F.explode("names").alias("name"))
    names = names.withColumn("_word", F.regexp_extract("name", r"^(\w+)", 1))
    longest = names.agg(F.max(F.length("name")).alias("n")).first()["n"] or 0
    pieces = F.transform("tails.starts", lambda at: F.substring(F.col("tails.text"), at + 1, F.lit(longest + 1)))
    tails = features.select(*keys, F.explode(F.array_distinct(pieces)).alias("_tail")).distinct()
    tails = tails.withColumn("_word", F.regexp_extract("_tail", r"^(\w+)", 1))
    whole = F.col("_tail").startswith(F.col("name")) & ~F.substring(
        F.col("_tail"), F.length("name") + 1, F.lit(1)
    ).rlike(r"\w")
    return tails.join(names, "_word").filter(whole).select(*keys, "course").distinct()


# --- the rules over one pair ------------------------------------------------------------------------
def pair_reason(mentioned: Column | None = None) -> Column:
    """First discard reason of a joined (posting features, profile) row, or null.

    Profile columns carry the prefix p_: p_technical, p_disability, p_area, p_mode and the place.
    """
    in_field = F.array_contains("pass_areas", F.coalesce("p_area", F.lit(ANY_AREA)))
    if mentioned is not None:
        in_field = in_field | mentioned
    distant = pair_proximity() == DISTANT
    wrong_mode = (F.col("p_mode") == "remoto") & F.when(
        F.col("mode").isNotNull(), F.col("mode") != "remoto"
    ).otherwise(F.col("on_site_text") & ~F.col("remote_text"))
    rules = (
        F.col("not_internship"),
        F.col("requires_seniority"),
        F.col("requires_postgrad"),
        F.col("requires_high_school"),
        F.col("requires_technical") & ~F.col("p_technical"),
        (F.col("audience") == V.AUDIENCE_EXCLUSIVE) & F.col("p_disability").eqNullSafe(F.lit(False)),
        ~in_field,
        F.col("requires_years"),
        distant & ((F.col("p_mode") == "presencial") | ~F.col("admits_remote")),
        wrong_mode,
    )
    return F.coalesce(*[F.when(rule, name) for rule, name in zip(rules, V.DISCARD_REASONS, strict=True)])


def pair_proximity() -> Column:
    mine = [F.col(c) for c in ("city_name", "city_uf", "region_id")]
    theirs = [F.col(c) for c in ("p_city_name", "p_city_uf", "p_region_id")]
    return proximity(*mine, *theirs)


# --- candidate pairs --------------------------------------------------------------------------------
def _keys(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def posting_place_keys() -> Column:
    """Join keys of a posting's place. A (posting, class) pair in one city shares exactly one key."""
    name, uf = F.col("city_name"), F.col("city_uf")
    named = name != ""
    return _keys(
        F.when(named & uf.isNotNull(), F.concat_ws(":", F.lit("C"), name, uf)),
        F.when(named & uf.isNull(), F.concat_ws(":", F.lit("N"), name)),
        F.when(named, F.concat_ws(":", F.lit("A"), name)),
        F.when(F.col("region_id").isNotNull(), F.concat_ws(":", F.lit("R"), F.col("region_id").cast("string"))),
        F.when(F.col("admits_remote"), F.lit("T")),
    )


def class_place_keys() -> Column:
    name, uf, region = F.col("p_city_name"), F.col("p_city_uf"), F.col("p_region_id")
    named = name != ""
    return _keys(
        F.when(named & uf.isNotNull(), F.concat_ws(":", F.lit("C"), name, uf)),
        F.when(named & uf.isNotNull(), F.concat_ws(":", F.lit("N"), name)),
        F.when(named & uf.isNull(), F.concat_ws(":", F.lit("A"), name)),
        F.when(named & uf.isNull(), F.concat_ws(":", F.lit("N"), name)),
        F.when(region.isNotNull(), F.concat_ws(":", F.lit("R"), region.cast("string"))),
        F.when(F.col("p_mode") != "presencial", F.lit("T")),
    )


#: All that the rules see of a profile.
CLASS = ("p_area", "p_course", "p_city_name", "p_city_uf", "p_region_id", "p_mode", "p_technical", "p_disability")


def profile_classes(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): profiles that no rule tells apart are one class; members are (class_id, profile_id)."""
    keyed = profiles.select("p_profile_id", F.struct(*CLASS).alias("_class"))
    classes = cut_lineage(keyed.select("_class").distinct().withColumn("class_id", F.monotonically_increasing_id()))
    members = keyed.join(classes, "_class").select("class_id", F.col("p_profile_id").alias("profile_id"))
    return classes.select("class_id", "_class.*"), members


def class_pairs(
    features: DataFrame,
    classes: DataFrame,
    mentions: DataFrame | None = None,
    posting_keys: Sequence[str] = ("source", "external_id"),
) -> DataFrame:
    """(posting keys, seq, class_id, proximity) for every posting and class of profiles that no rule discards.

    One equi-join on (area, place key). The keys of one pair are made disjoint by a residual test on
    which key joined it, so no distinct over pairs is needed:
    a city key always wins, a region key only when the city differs, the remote key only when distant;
    the mentioned-course branch only takes pairs the area branch did not. Keys that many postings and classes
    share (the remote key above all) are dealt by their measured counts.
    """
    usable = ~(
        F.col("not_internship")
        | F.col("requires_seniority")
        | F.col("requires_postgrad")
        | F.col("requires_high_school")
        | F.col("requires_years")
    )
    light = [
        *posting_keys, "seq", "mode", "audience", "requires_technical", "on_site_text", "remote_text",
        "admits_remote", "pass_areas", "city_name", "city_uf", "region_id",
    ]
    kept = features.filter(usable).select(*light)
    places = kept.withColumn("_place", F.explode(posting_place_keys()))
    people = classes.withColumn("_area", F.coalesce("p_area", F.lit(ANY_AREA))).withColumn("_place", F.explode(class_place_keys()))
    posting = F.struct(*posting_keys)
    by_area = places.withColumn("_area", F.explode("pass_areas"))
    pairs = dealt_join(by_area, people, ["_area", "_place"], posting, F.col("class_id"))
    if mentions is not None:
        named = places.join(mentions.withColumnRenamed("course", "p_course"), list(posting_keys))
        by_course = dealt_join(named, people, ["p_course", "_place"], posting, F.col("class_id"))
        pairs = pairs.unionByName(by_course.filter(~F.array_contains("pass_areas", F.col("_area"))).select(*pairs.columns))
    near = pair_proximity()
    kind = F.left("_place", F.lit(1))
    once = (
        F.when(kind == "T", near == DISTANT)
        .when(kind == "R", near != SAME_CITY)
        # Both codes null gives two shared keys (A and N): keep one.
        .when((kind == "N") & F.col("city_uf").isNull() & F.col("p_city_uf").isNull(), F.lit(False))
        .otherwise(F.lit(True))
    )
    wrong_mode = (F.col("p_mode") == "remoto") & F.when(
        F.col("mode").isNotNull(), F.col("mode") != "remoto"
    ).otherwise(F.col("on_site_text") & ~F.col("remote_text"))
    exclusive = (F.col("audience") == V.AUDIENCE_EXCLUSIVE) & F.col("p_disability").eqNullSafe(F.lit(False))
    technical = F.col("requires_technical") & ~F.col("p_technical")
    return pairs.filter(once & ~wrong_mode & ~exclusive & ~technical).select(
        *posting_keys, "seq", "class_id", near.alias("proximity")
    )


def candidate_pairs(
    features: DataFrame,
    profiles: DataFrame,
    mentions: DataFrame | None = None,
    posting_keys: Sequence[str] = ("source", "external_id"),
) -> DataFrame:
    """(posting keys, seq, profile_id, proximity) for every pair no rule discards.

    Postings meet classes of profiles; only what passes is expanded to profiles.
    """
    classes, members = profile_classes(profiles)
    pairs = class_pairs(features, classes, mentions, posting_keys)
    return expanded(pairs, cut_lineage(members)).select(*posting_keys, "seq", "profile_id", "proximity")


def expanded(pairs: DataFrame, members: DataFrame, keys: Sequence[str] = ("class_id",)) -> DataFrame:
    """Class pairs with every member of the class; tasks are as many as the members' pairs need."""
    return dealt_join(pairs, members, keys, F.col("seq"), F.col("profile_id"), spread=True)


def unsent_candidate_pairs(
    features: DataFrame,
    profiles: DataFrame,
    sent: DataFrame,
    mentions: DataFrame | None = None,
    posting_keys: Sequence[str] = ("source", "external_id"),
) -> DataFrame:
    """The pairs of `candidate_pairs` less those in `sent` (profile_id, seq).

    What was sent is looked up between postings and classes first: only pairs of a class with a member that was sent
    the posting are compared one by one, all others are expanded where they are and never shuffled.
    """
    classes, members = profile_classes(profiles)
    sent = sent.select("profile_id", "seq").distinct()
    marked = marked_class_pairs(class_pairs(features, classes, mentions, posting_keys), members, sent)
    return unsent_members(marked, cut_lineage(members), sent).select(*posting_keys, "seq", "profile_id", "proximity")


def marked_class_pairs(pairs: DataFrame, members: DataFrame, sent: DataFrame) -> DataFrame:
    """Pairs of a posting and a class; `_touched` where some member of the class was sent the posting."""
    touched = members.distinct().join(sent, "profile_id").select("class_id", "seq").distinct().withColumn("_touched", F.lit(True))
    return cut_lineage(pairs.join(touched, ["class_id", "seq"], "left"))


def unsent_members(marked: DataFrame, members: DataFrame, sent: DataFrame, keys: Sequence[str] = ("class_id",)) -> DataFrame:
    """Marked class pairs with every member that was not sent the posting; only touched ones are compared one by one."""
    some = lambda touched: expanded(marked.filter(touched).drop("_touched"), members, keys)
    compared = without_sent(some(F.col("_touched").isNotNull()), sent, ["profile_id", "seq"])
    return some(F.col("_touched").isNull()).unionByName(compared)


def unsent_counts(marked: DataFrame, members: DataFrame, sent: DataFrame) -> DataFrame:
    """(seq, candidates): how many pairs `unsent_members` gives a posting; only those of touched classes are made for it."""
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("candidates"))
    whole = marked.filter(F.col("_touched").isNull()).join(sizes, "class_id").select("seq", "candidates")
    compared = without_sent(expanded(marked.filter(F.col("_touched").isNotNull()), members), sent, ["profile_id", "seq"])
    counted = compared.groupBy("seq").agg(F.count(F.lit(1)).alias("candidates"))
    return whole.unionByName(counted).groupBy("seq").agg(F.sum("candidates").alias("candidates"))


def without_sent(candidates: DataFrame, sent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates the profile has not received."""
    return candidates.join(sent.select(*keys), list(keys), "left_anti")


def interleaved(candidates: DataFrame, posting_keys: Sequence[str], profile_order: str, seq: str = "seq") -> DataFrame:
    """Postings in round-robin order of the profiles: everyone's first, then everyone's second…

    A profile with a large share of the pairs is numbered by ranges of the arrival order, so its
    rows are never sorted in one task.
    """
    placed = numbered(candidates, [profile_order], [F.col(seq)], [range_step(F.col(seq))], "turn")
    first = placed.groupBy(*posting_keys).agg(F.min(F.struct("turn", profile_order)).alias("_first"))
    return first.select(*posting_keys, F.col("_first.turn").alias("turn"), F.col(f"_first.{profile_order}").alias(profile_order))


# --- origins ----------------------------------------------------------------------------------------
def block_reason(partner: Column, partner_id: Column, domain: Column) -> Column:
    """Why an origin is blocked: partner id or name, or a blocked domain or one of its subdomains."""
    informed = F.lower(F.trim(domain))
    by_partner = F.trim(partner_id).eqNullSafe(F.lit(V.BLOCKED_PARTNER_ID)) | F.lower(F.trim(partner)).eqNullSafe(
        F.lit(V.BLOCKED_PARTNER_NAME)
    )
    reason = F.when(by_partner, V.BLOCKED_DOMAINS[V.BLOCKED_PARTNER_DOMAIN])
    for blocked, why in V.BLOCKED_DOMAINS.items():
        reason = reason.when((informed == blocked) | informed.endswith(f".{blocked}"), why)
    return reason


def origin_status(postings: DataFrame) -> DataFrame:
    """Adds block_reason, origin_required and origin_unidentified."""
    partner, number, domain = (F.col(f"origin.{c}") for c in ("partner", "partner_id", "domain"))
    required = F.col("source").isin(*V.ORIGIN_REQUIRED_SOURCES)
    unknown = required & partner.isNull() & number.isNull() & domain.isNull()
    return postings.withColumns(
        {
            "block_reason": block_reason(partner, number, domain),
            "origin_required": required,
            "origin_unidentified": unknown,
        }
    )


def split_by_origin(postings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, blocked, unidentified)."""
    checked = origin_status(postings)
    blocked = F.col("block_reason").isNotNull()
    kept = checked.filter(~blocked & ~F.col("origin_unidentified"))
    return kept, checked.filter(blocked), checked.filter(~blocked & F.col("origin_unidentified"))


def generalized_loss(checked: DataFrame) -> DataFrame:
    """True when strictly more than half of the postings that need an origin lack one."""
    lost, required = F.count_if("origin_unidentified"), F.count_if("origin_required")
    return checked.agg(lost.alias("unidentified"), required.alias("required"), (lost > required * 0.5).alias("generalized"))


# --- discard counts -------------------------------------------------------------------------------
def discard_counts(reasons: DataFrame) -> DataFrame:
    counted = reasons.filter(F.col("reason").isNotNull()).groupBy("reason")
    return counted.agg(F.count(F.lit(1)).alias("total"))


def crawl_plan(profiles: DataFrame, hubs: DataFrame, areas: DataFrame) -> DataFrame:
    """(kind, value) of the searches a run needs.

    kind "city": profile cities and their region hubs, for profiles that depend on the city; "term":
    search terms of the known areas; "national" always; "general" when some course has no area.
    `profiles` has (mode, city, region_id, area), `hubs` (region_id, hub), `areas` (area, terms).
    """
    placed = profiles.filter(F.col("mode").isin("presencial", "hibrido", "indiferente"))
    hub_cities = placed.join(hubs, "region_id").select(F.col("hub").alias("value"))
    cities = placed.select(F.col("city").alias("value")).union(hub_cities).distinct()
    known = profiles.select("area").distinct()
    terms = known.join(areas, "area").select(F.explode("terms").alias("value")).distinct()
    unknown = known.filter(F.col("area").isNull()).select(F.lit("general").alias("kind"))
    national = profiles.sparkSession.range(1).select(F.lit("national").alias("kind"))
    nothing = F.lit(None).cast("string").alias("value")
    return (
        cities.select(F.lit("city").alias("kind"), "value")
        .unionByName(terms.select(F.lit("term").alias("kind"), "value"))
        .unionByName(national.select("kind", nothing))
        .unionByName(unknown.select("kind", nothing))
    )
