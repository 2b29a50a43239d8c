"""Registered queries of cleaning, duplicates, candidates, scoring and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmatch.functions import text as T
from postmatch.operators import candidates as C
from postmatch.operators import dedup, scoring
from postmatch.plans import bindings as B
from postmatch.plans import bindings_matching as M
from postmatch.plans.registry import register
from postmatch.sources import regions as R


@register(
    "posting_scan_clean",
    f"""select doc_id, {M.fold_sql('text')} as folded, {M.key_sql('text')} as key,
  len({M.words_sql('text')}) as opening from documents""",
)
def posting_scan_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return B.table(spark, sf_dir, "documents").select(
        "doc_id",
        T.fold_text(text).alias("folded"),
        T.clean_key(text).alias("key"),
        F.size(T.opening_words(text)).cast("long").alias("opening"),
    )


@register(
    "first_wins_source",
    """select source, external_id, seq from (select source, md5(text) as external_id, doc_id as seq from documents)
qualify row_number() over (partition by source, external_id order by seq) = 1""",
)
def first_wins_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "documents").select(
        "source", F.md5(F.col("text").cast("binary")).alias("external_id"), F.col("doc_id").alias("seq")
    )
    return dedup.first_wins(rows)


@register(
    "dedupe_exact_best",
    f"""with {M.DOCUMENTS_SQL}, ranked as (select *, case when company_key in ('', 'empresa nao informada', 'confidencial', 'empresa confidencial') then text_key end as t from v_documents)
select seq, min_seq as position, source, mode, length(description) as n from (
  select *, min(seq) over (partition by title_key, company_key, city, t) as min_seq from ranked)
qualify row_number() over (partition by title_key, company_key, city, t
  order by mode is not null desc, source <> 'jooble' desc, length(description) desc, seq) = 1""",
)
def dedupe_exact_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = dedup.dedupe_exact(M.keyed_documents(spark, sf_dir))
    return best.select("seq", "position", "source", "mode", F.length("description").cast("long").alias("n"))


SIMILAR_SQL = """len(a.words) >= 20 and len(b.words) >= 20
  and len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) >= 0.8"""


@register(
    "drop_republications",
    f"""with {M.DOCUMENTS_SQL}
select seq from v_documents a where not exists (select 1 from v_documents b
  where b.seq in (select doc_id from labels where quality = 1) and a.ad_key = b.ad_key and {SIMILAR_SQL})""",
)
def drop_republications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents similar to no document labelled good."""
    docs = M.compared_documents(spark, sf_dir)
    known = docs.join(_labelled(spark, sf_dir, "quality"), "seq", "left_semi")
    return dedup.drop_republications(docs, known, ["seq"]).select("seq")


def _labelled(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return B.table(spark, sf_dir, "labels").filter(F.col(column) == 1).select(F.col("doc_id").alias("seq"))


@register(
    "drop_closed_postings",
    f"""with {M.DOCUMENTS_SQL}, closed as (select * from v_documents where seq in (select doc_id from labels where toxic = 1))
select seq from v_documents a where a.seq not in (select seq from closed) and not exists (select 1 from closed b
  where a.ad_key = b.ad_key and {SIMILAR_SQL}
  and (a.company_key = b.company_key or a.company_key = 'confidencial' or b.company_key = 'confidencial'))""",
)
def drop_closed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = M.compared_documents(spark, sf_dir)
    closed = docs.join(_labelled(spark, sf_dir, "toxic"), "seq", "left_semi")
    return dedup.drop_closed(docs, closed, ["seq"]).select("seq")


#: One row after the other joins the first slot of its block that it is similar to, or opens one.
FOLD_STEP_SQL = """select ad_key, k, case when hit is null then list_append(slots, {'words': words, 'rank': rank, 'position': seq, 'winner': seq})
    when rank > slots[hit].rank then list_concat(list_append(slots[1:hit - 1], {'words': words, 'rank': rank, 'position': slots[hit].position, 'winner': seq}), slots[hit + 1:])
    else slots end
  from (select f.ad_key, t.k, f.slots, t.words, t.rank, t.seq,
      list_position(list_transform(f.slots, lambda s: len(s.words) >= 20 and len(t.words) >= 20
        and len(list_intersect(s.words, t.words)) / (len(s.words) + len(t.words) - len(list_intersect(s.words, t.words))) >= 0.8), true) as hit
    from fold f join t on t.ad_key = f.ad_key and t.k = f.k + 1)"""


@register(
    "dedupe_near_greedy",
    f"""with recursive {M.DOCUMENTS_SQL},
t as (select *, row_number() over (partition by ad_key order by seq) as k, (mode is not null)::int * 1000000000000 + (source <> 'jooble')::int * 100000000000 + length(description) as rank
  from v_documents),
fold as (
  select ad_key, 0::bigint as k, []::struct(words varchar[], rank bigint, position bigint, winner bigint)[] as slots from t group by ad_key
  union all
  {FOLD_STEP_SQL}),
last as (select ad_key, unnest(slots) as s from fold qualify k = max(k) over (partition by ad_key))
select s.position as position, d.source, d.external_id, replace(d.ad_key, '|City', chr(1) || 'City') as ad_key from last join v_documents d on d.seq = s.winner""",
)
def dedupe_near_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = M.keyed_documents(spark, sf_dir).withColumnRenamed("seq", "position")
    return dedup.dedupe_near(docs).select("position", "source", "external_id", "ad_key")


@register(
    "similar_descriptions",
    f"""with {M.DOCUMENTS_SQL}
select distinct a.seq from v_documents a join v_documents b on a.ad_key = b.ad_key and a.seq > b.seq where {SIMILAR_SQL}""",
)
def similar_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents similar to an earlier one of their block: the pairs are never emitted."""
    return dedup.similar_to_earlier(M.compared_documents(spark, sf_dir)).select("seq")


# places and rules -----------------------------------------------------------------------------------
@register(
    "region_hub",
    f"""with {M.CITY_SQL} select region_id, 'City ' || id as hub, count_in_region as cities from (
  select *, count(*) over (partition by region_id) as count_in_region from v_cities)
qualify row_number() over (partition by region_id order by population desc, 'city ' || id) = 1""",
)
def region_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, regions = M.places(spark, sf_dir)
    sizes = regions.groupBy("region_id").agg(F.count(F.lit(1)).alias("cities"))
    return R.region_hubs(regions).join(sizes, "region_id")


@register(
    "posting_places",
    f"""with {M.MATCHING_SQL} select seq, 'city ' || city as city_name, 'R' || (city % 5) as city_uf, region_id
from v_posting_places""",
)
def posting_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, regions = M.places(spark, sf_dir)
    located = R.identify_municipality(M.rule_postings(spark, sf_dir), "location", states, regions)
    return located.select("seq", "city_name", "city_uf", "region_id")


@register(
    "posting_rules",
    f"""with {M.MATCHING_SQL} select seq, not_internship, seniority as requires_seniority, postgrad as requires_postgrad,
  high_school as requires_high_school, technical as requires_technical, years as requires_years, any_course as any_course_text,
  case when exclusive then 'exclusivo_pcd' else 'geral' end as audience, admits_remote,
  list_sort(list_filter([case when any_course or t_casa or (not x_construcao and d_casa) then 'casa' end,
    case when any_course or t_construcao or (not x_casa and d_construcao) then 'construcao' end,
    case when any_course or not (x_casa or x_construcao) then '-' end], lambda x: x is not null)) as pass_areas
from v_rule_postings""",
)
def posting_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.features(spark, sf_dir).select(
        "seq", "not_internship", "requires_seniority", "requires_postgrad", "requires_high_school",
        "requires_technical", "requires_years", "any_course_text", "audience", "admits_remote",
        F.array_sort("pass_areas").alias("pass_areas"),
    )


@register(
    "discard_reason",
    f"""with {M.MATCHING_SQL}, {M.PAIRS_SQL} select o_orderkey, {M.REASON_SQL} as reason
from v_pairs o join v_posting_places d on d.seq = o.seq join v_people p on p.profile_id = o.profile_id""",
)
def discard_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First discard reason of the pairs the orders table names."""
    keys = ["source", "external_id"]
    features, courses = M.features(spark, sf_dir), M.people_courses(spark, sf_dir)
    people = M.people_places(spark, sf_dir, courses)
    mentions = C.course_mentions(features, courses, keys).select(
        *keys, F.col("course").alias("p_course"), F.lit(True).alias("_mentioned")
    )
    pairs = M.order_pairs(spark, sf_dir)
    joined = pairs.join(features.drop("tails"), "seq").join(people, "p_profile_id")
    named = joined.join(mentions, [*keys, "p_course"], "left")
    return named.select("o_orderkey", C.pair_reason(F.coalesce("_mentioned", F.lit(False))).alias("reason"))


@register(
    "discard_counts",
    f"""with {M.MATCHING_SQL}, {M.PAIRS_SQL} select reason, count(*) as total from (
  select {M.REASON_SQL} as reason
  from v_pairs o join v_posting_places d on d.seq = o.seq join v_people p on p.profile_id = o.profile_id)
where reason is not null group by 1""",
)
def discard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.discard_counts(discard_reason(spark, sf_dir))


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, profiles, mentions)."""
    features, courses = M.features(spark, sf_dir), M.people_courses(spark, sf_dir)
    mentions = C.course_mentions(features, courses, ["source", "external_id"])
    return features, M.people_places(spark, sf_dir, courses), mentions


CANDIDATES_SQL = f"""{M.MATCHING_SQL}, v_candidates as (
  select d.source, d.external_id, d.seq, p.profile_id, {M.NEAR_SQL} as proximity
  from v_posting_places d, v_people p where ({M.REASON_SQL}) is null)"""


@register(
    "candidate_pairs", f"with {CANDIDATES_SQL} select source, external_id, seq, profile_id, proximity from v_candidates"
)
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair no rule discards; the SQL twin checks it against the full cross join."""
    return C.candidate_pairs(*_matched(spark, sf_dir))


@register(
    "unsent_candidates",
    f"""with {CANDIDATES_SQL} select profile_id, seq from v_candidates c where not exists (
  select 1 from orders o where o.o_custkey = c.profile_id and o.o_orderkey % (select max(doc_id) + 1 from documents) = c.seq)""",
)
def unsent_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = B.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("profile_id"),
        (F.col("o_orderkey") % B.documents_to(B.table(spark, sf_dir, "documents"))).alias("seq"),
    )
    features, people, mentions = _matched(spark, sf_dir)
    return C.unsent_candidate_pairs(features, people, sent, mentions).select("profile_id", "seq")


@register(
    "interleaved_candidates",
    """with t as (select o_custkey as profile_id, o_orderkey as seq, o_orderkey % 700 as posting,
  row_number() over (partition by o_custkey order by o_orderkey) as turn from orders)
select posting, turn, profile_id from t qualify row_number() over (partition by posting order by turn, profile_id) = 1""",
)
def interleaved_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 700).alias("posting")
    )
    return C.interleaved(rows, ["posting"], "profile_id")


@register(
    "crawl_plan",
    f"""with {M.CITY_SQL}, {M.PEOPLE_SQL}, hubs as (select region_id, 'City ' || id as hub from v_cities
  qualify row_number() over (partition by region_id order by population desc, 'city ' || id) = 1)
select 'city' as kind, 'City ' || city as value from v_people where mode <> 'remoto'
union select 'city', h.hub from v_people p join hubs h on h.region_id = p.region_id where p.mode <> 'remoto'
union select 'term', unnest(case area when 'casa' then ['casa', 'moveis'] else ['obra', 'predio'] end) from v_people where area is not null
union select 'national', null union select 'general', null from v_people where area is null""",
)
def crawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, regions = M.places(spark, sf_dir)
    people = M.people_places(spark, sf_dir, M.people_courses(spark, sf_dir)).select(
        F.col("p_mode").alias("mode"), F.initcap("p_city_name").alias("city"), F.col("p_region_id").alias("region_id"),
        F.col("p_area").alias("area"),
    )
    areas = M.CATALOG.to_frame(spark).select(F.col("name").alias("area"), F.col("search_terms").alias("terms"))
    return C.crawl_plan(people, R.region_hubs(regions), areas)


@register(
    "blocked_origin_split",
    """with t as (select doc_id, case doc_id % 3 when 0 then 'adzuna' when 1 then 'gupy' else 'jooble' end as source,
  case when doc_id % 10 = 0 then '79986' when doc_id % 10 = 1 then 'x' end as partner_id,
  case when doc_id % 15 = 2 then ' Emprego ' end as partner,
  case doc_id % 8 when 0 then 'jobs.gupy.io' when 1 then 'LinkedIn.com' when 2 then 'notgupy.io' when 3 then 'a.emprego.pt' end as domain from documents),
d as (select *, lower(trim(domain)) as dom from t)
select doc_id, case when partner_id = '79986' or lower(trim(partner)) = 'emprego' then 'o emprego.pt publica como novos anúncios brasileiros já vencidos'
  when dom = 'gupy.io' or dom like '%.gupy.io' then 'os termos da Gupy proíbem agregar, copiar ou duplicar as vagas dela'
  when dom = 'linkedin.com' or dom like '%.linkedin.com' then 'o LinkedIn bloqueia coleta automatizada e está fora do escopo do projeto'
  when dom = 'emprego.pt' or dom like '%.emprego.pt' then 'o emprego.pt publica como novos anúncios brasileiros já vencidos' end as block_reason,
  source = 'adzuna' as origin_required,
  source = 'adzuna' and partner is null and partner_id is null and domain is null as origin_unidentified from d""",
)
def blocked_origin_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.origin_status(_origins(spark, sf_dir)).select(
        "doc_id", "block_reason", "origin_required", "origin_unidentified"
    )


def _origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    domain = B.case(doc % 8, {0: "jobs.gupy.io", 1: "LinkedIn.com", 2: "notgupy.io", 3: "a.emprego.pt"})
    return B.table(spark, sf_dir, "documents").select(
        "doc_id",
        B.case(doc % 3, {0: "adzuna", 1: "gupy"}, "jooble").alias("source"),
        F.struct(
            F.when(doc % 15 == 2, " Emprego ").alias("partner"),
            B.case(doc % 10, {0: "79986", 1: "x"}).alias("partner_id"),
            domain.alias("domain"),
        ).alias("origin"),
    )


@register(
    "generalized_loss",
    """select count(*) filter (where lost) as unidentified, count(*) filter (where source = 0) as required,
  count(*) filter (where lost) > count(*) filter (where source = 0) * 0.5 as generalized
from (select doc_id % 3 as source, doc_id % 3 = 0 and doc_id % 15 <> 2 and doc_id % 10 > 1 and doc_id % 8 > 3 as lost from documents)""",
)
def generalized_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.generalized_loss(C.origin_status(_origins(spark, sf_dir)))


@register(
    "course_dictionary",
    f"""with {M.CITY_SQL}, {M.PEOPLE_SQL} select distinct case when is_technical then 'Técnico em ' else '' end
  || upper(left(segment, 1)) || lower(substr(segment, 2)) as course, lower(segment) as normalized, area,
  is_technical as technical, not is_technical as higher from v_people""",
)
def course_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postmatch.functions.courses import course_dictionary as build

    built = build(M.people(spark, sf_dir), M.CATALOG)
    return built.select("course", "normalized", "area", "technical", "higher")
