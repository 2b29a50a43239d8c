"""Registered queries of scoring, ranking and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmatch.functions import skills
from postmatch.operators import dedup, ranking, scoring
from postmatch.plans import bindings as B
from postmatch.plans import bindings_matching as M
from postmatch.plans.registry import register

SCORE_STEPS_SQL = f"""v_joined as (
  select o.o_orderkey, p.profile_id, p.skills, p.meets, p.area, p.interest, p.refuses_decoracao, p.disability, p.mode as p_mode, p.period,
    p.is_technical, p.segment, d.exclusive, e.*, coalesce(d.mode, e.e_mode) as mode, {M.NEAR_SQL} as near,
    coalesce(e.read_complete, d.description_complete) as complete,
    case e.e_sub when 'decoracao' then 'casa' when 'obras' then 'construcao' when 'maquinas' then 'construcao' end as e_field,
    case p.interest when 'decoracao' then 'casa' when 'obras' then 'construcao' when 'maquinas' then 'construcao' end as p_field
  from v_pairs o join v_posting_places d on d.seq = o.seq join v_people p on p.profile_id = o.profile_id
  join v_extractions e on e.seq = o.seq),
v_covered as (
  select *,
    (1 + len(list_intersect(list_distinct(required_skills), meets))) / (1 + nullif(len(list_distinct(required_skills)), 0)) as r,
    (1 + len(list_intersect(list_distinct(main_skills), meets))) / (1 + nullif(len(list_distinct(main_skills)), 0)) as m,
    (1 + len(list_intersect(list_distinct(nice_skills), meets))) / (1 + nullif(len(list_distinct(nice_skills)), 0)) as n,
    len(list_intersect(list_concat(required_skills, main_skills, nice_skills), meets)) > 0 as some_met
  from v_joined),
v_parts as (
  select *, case when some_met then weighted else least(weighted, 0.25::double) end as skill_part,
    case when e_area is null or area is null then 'parcial' when e_area = area then 'compativel' else 'incompativel' end as area_level,
    case when any_flag then 'compativel' when c7 = 2 and not is_technical then 'incompativel'
      when c7 > 3 then 'parcial'
      when c7 in (0, 2) and coalesce(area = 'construcao', false) then 'compativel'
      when c7 = 1 and segment = 'HOUSEHOLD' then 'compativel' else 'incompativel' end as course_level,
    case when needs_years or coalesce(period < min_period, false) then 'incompativel' when desirable then 'parcial' else 'compativel' end as period_level,
    ((case when mode is not distinct from 'remoto' or p_mode = 'remoto' then 1.0::double when near = 'mesma_cidade' then 1.0::double
        when near = 'mesma_regiao' then 0.5::double else 0.0::double end)
      + (case when mode is null then 0.5::double when p_mode = 'indiferente' or mode = p_mode then 1.0::double
        when p_mode = 'presencial' and mode = 'hibrido' then 0.5::double else 0.0::double end)) / 2 as logistics_part,
    case when refuses_decoracao and e_sub is not distinct from 'decoracao' then 0.0::double when interest is null then 1.0::double when e_sub is null then 0.5::double
      when e_sub = interest then 1.0::double when e_field = p_field then 0.5::double else 0.0::double end as interest_part
  from (select *, case when r is not null and m is not null and n is not null then 0.6::double * r + 0.3::double * m + 0.1::double * n
      when r is not null and m is not null then 0.7::double * r + 0.3::double * m
      when r is not null and n is not null then 0.8::double * r + 0.2::double * n
      when m is not null and n is not null then 0.8::double * m + 0.2::double * n
      else coalesce(r, m, n, 0.25::double) end as weighted from v_covered)),
v_scored as (
  select *, floor(least(
      45 * skill_part + 10 * {{c}} + 10 * {{a}} + 15 * {{p}} + 10 * logistics_part + 10 * interest_part,
      case when interest_part = 0 or (interest is not null and e_sub is null) then 65 else 100 end,
      case course_level when 'incompativel' then 35 when 'parcial' then 75 else 100 end,
      case when coalesce(period < min_period, false) then 35 else 100 end) + 0.5)::int as base from v_parts),
v_final as (
  select *, exclusive and disability is not distinct from true as priority,
    least(least(base, case when mode in ('presencial', 'hibrido') and (p_mode = 'remoto' or (p_mode <> 'presencial' and near = 'distante')) then 30 else 100 end),
      case when complete then 100 else 60 end) as score from v_scored)"""
for slot, column in (("{c}", "course_level"), ("{a}", "area_level"), ("{p}", "period_level")):
    SCORE_STEPS_SQL = SCORE_STEPS_SQL.replace(
        slot, f"(case {column} when 'compativel' then 1.0::double when 'parcial' then 0.5::double else 0.0::double end)"
    )
SCORED_SQL = f"{M.MATCHING_SQL}, {M.PAIRS_SQL}, {M.EXTRACTIONS_SQL}, {SCORE_STEPS_SQL}"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_pairs(M.scored_pairs(spark, sf_dir), M.CATALOG)


@register(
    "skill_coverage",
    f"""with {SCORED_SQL} select o_orderkey, round(r, 9) as required, round(m, 9) as main, round(n, 9) as nice, round(skill_part, 9) as skill_part from v_parts""",
)
def skill_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = M.scored_pairs(spark, sf_dir)
    no = F.lit(False)
    verdicts = [skills.judged(F.col(f"e_{c}"), F.col("p_met")) for c in scoring.LISTS]
    judged = pairs.select("o_orderkey", *[v.alias(f"v{i}") for i, v in enumerate(verdicts)])
    covered = judged.select("o_orderkey", *[skills.coverage(F.col(f"v{i}"), no).alias(f"c{i}") for i in range(3)])
    part = skills.skill_component(F.col("c0"), F.col("c1"), F.col("c2"))
    shown = [F.round(F.col(f"c{i}.value"), 9).alias(n) for i, n in enumerate(("required", "main", "nice"))]
    return covered.select("o_orderkey", *shown, F.round(part, 9).alias("skill_part"))


@register(
    "match_score",
    f"""with {SCORED_SQL} select o_orderkey, area_level, course_level, period_level, logistics_part, interest_part,
  base as score_before_limits, score, priority from v_final""",
)
def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(
        "o_orderkey", "area_level", "course_level", "period_level", "logistics_part", "interest_part",
        "score_before_limits", "score", "priority",
    )


@register(
    "explain_requirements",
    f"""with {SCORED_SQL}, n as (select *, list_distinct(list_concat(required_skills, main_skills)) as needed from v_joined)
select o_orderkey, list_sort(list_distinct(list_concat(list_intersect(needed, meets), list_intersect(nice_skills, meets)))) as requirements_met,
  list_sort(list_filter(needed, lambda x: not list_contains(meets, x))) as requirements_unmet,
  list_sort(list_distinct(list_filter(nice_skills, lambda x: not list_contains(meets, x) and not list_contains(needed, x)))) as nice_unmet from n""",
)
def explain_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ("requirements_met", "requirements_unmet", "nice_unmet")
    return scored(spark, sf_dir).select("o_orderkey", *[F.array_sort(c).alias(c) for c in lists])


NOTICES_SQL = """select o_orderkey, list_filter([
  case when refuses_decoracao and e_sub is not distinct from 'decoracao' then 'Área que você recusou nos últimos dias: Decoração'
    when interest_part = 0 and interest is not null then 'Fora das suas áreas de interesse' end,
  case when not any_flag and c7 = 2 and not is_technical then 'Vaga para estudantes de curso técnico'
    when course_level = 'incompativel' then 'Exige formação de outra área' end,
  case when coalesce(period < min_period, false) then 'Exige a partir do ' || min_period || 'º período' end,
  case when len(skills) = 0 and len(required_skills) + len(main_skills) > 0 then 'Nota calculada sem habilidades no seu perfil' end,
  case when score_after < base then case when p_mode = 'remoto' then 'Nota limitada a 30: modalidade incompatível' else 'Nota limitada a 30: exige presença em outra cidade' end end,
  case when not complete then 'Descrição incompleta: requisitos podem estar ausentes; nota limitada a 60' end,
  case when exclusive and not priority then 'Vaga exclusiva para pessoas com deficiência (PCD)' end], lambda x: x is not null) as notices,
  list_filter([case when priority then 'Vaga exclusiva para PCD' end,
    case when course_level = 'compativel' and (c7 <= 3 or any_flag) then 'Curso compatível' end], lambda x: x is not null) as points_for,
  case when needs_years then ['Exige experiência prévia'] else []::varchar[] end as points_against
from (select *, least(base, case when mode in ('presencial', 'hibrido') and (p_mode = 'remoto' or (p_mode <> 'presencial' and near = 'distante')) then 30 else 100 end) as score_after from v_final)"""


@register("notices", f"with {SCORED_SQL} {NOTICES_SQL}")
def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("o_orderkey", "notices", "points_for", "points_against")


@register(
    "topk_per_profile",
    """with s as (select o_custkey as profile_id, o_orderkey as seq, (floor(o_totalprice)::bigint % 101)::int as score,
  (floor(o_totalprice)::bigint % 103)::int as before, o_orderpriority = '1-URGENT' as priority from orders)
select profile_id, seq, score, row_number() over (partition by profile_id order by priority desc, score desc, before desc, seq) as position
from s where score >= 40 qualify position <= 7""",
)
def topk_per_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.select_top(_order_scores(spark, sf_dir)).select(
        "profile_id", "seq", "score", F.col("position").cast("long").alias("position")
    )


def _order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor("o_totalprice")
    return B.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("profile_id"),
        F.col("o_orderkey").alias("seq"),
        (price % 101).cast("int").alias("score"),
        (price % 103).cast("int").alias("score_before_limits"),
        (F.col("o_orderpriority") == "1-URGENT").alias("priority"),
    )


@register(
    "full_ranking",
    """with s as (select o_custkey as profile_id, o_orderkey as seq, (floor(o_totalprice)::bigint % 101)::int as score,
  (floor(o_totalprice)::bigint % 103)::int as before, o_orderpriority = '1-URGENT' as priority from orders)
select profile_id, seq, row_number() over (partition by profile_id order by priority desc, score desc, before desc, seq) as position from s""",
)
def full_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(_order_scores(spark, sf_dir)).select("profile_id", "seq", "position")


BLOCKS_SQL = """v_blocks as (
  select o_custkey as profile_id, row_number() over (partition by o_custkey order by o_orderkey) as position,
    repeat(o_orderpriority || ' ', (o_orderkey % 90)::int + 1) as block from orders qualify position <= 7)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postmatch.operators.keyed import top_per_key

    top = top_per_key(B.table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")], 7)
    text = F.expr("repeat(concat(o_orderpriority, ' '), cast(o_orderkey % 90 + 1 as int))")
    return top.select(F.col("o_custkey").alias("profile_id"), F.col("_rank").alias("position"), text.alias("block"))


PACKED_SQL = f"""with recursive {BLOCKS_SQL}, v_walk as (
  select profile_id, position, 1 as part, length(block) as used from v_blocks where position = 1
  union all select b.profile_id, b.position, case when w.used + 19 + length(b.block) <= 2000 then w.part else w.part + 1 end,
    case when w.used + 19 + length(b.block) <= 2000 then w.used + 19 + length(b.block) else length(b.block) end
  from v_walk w join v_blocks b on b.profile_id = w.profile_id and b.position = w.position + 1)"""


@register(
    "pack_digest",
    f"""{PACKED_SQL} select profile_id, part, max(used) as length, list(position::int order by position) as positions from v_walk group by 1, 2""",
)
def pack_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ranking.pack_digest(_blocks(spark, sf_dir), 2000)
    return parts.select("profile_id", "part", F.length("text").alias("length"), "positions")


@register(
    "delivered_rows",
    f"""{PACKED_SQL} select profile_id, position::int as position from v_walk where part <= profile_id % 3""",
)
def delivered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ranking.pack_digest(_blocks(spark, sf_dir), 2000)
    outcomes = B.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("profile_id"), (F.col("c_custkey") % 3).alias("delivered_parts")
    )
    return ranking.delivered_rows(parts, outcomes)


@register(
    "digest_rows",
    f"""with {SCORED_SQL} select o_orderkey, score, len(string_split(r_block, chr(10))) as lines from (select o_orderkey, score,
  '<b>1. x</b>' || chr(10) || 'place' || chr(10) || 'source' || chr(10) || 'score'
  || case when len(list_intersect(list_concat(required_skills, main_skills, nice_skills), meets)) > 0 then chr(10) || 'met' else '' end
  || case when len(list_filter(list_concat(required_skills, main_skills), lambda x: not list_contains(meets, x))) > 0 then chr(10) || 'unmet' else '' end
  || case when len(list_filter(nice_skills, lambda x: not list_contains(meets, x) and not list_contains(list_concat(required_skills, main_skills), x))) > 0 then chr(10) || 'nice' else '' end
  || case when complete and len(list_intersect(list_concat(required_skills, main_skills, nice_skills), meets)) = 0 and len(required_skills) + len(main_skills) = 0 then chr(10) || 'silent' else '' end
  || case when priority or (course_level = 'compativel' and (c7 <= 3 or any_flag)) then chr(10) || 'for' else '' end
  || case when needs_years then chr(10) || 'against' else '' end
  || repeat(chr(10) || 'notice', (case when (refuses_decoracao and e_sub is not distinct from 'decoracao') or (interest_part = 0 and interest is not null) then 1 else 0 end
    + case when course_level = 'incompativel' then 1 else 0 end + case when coalesce(period < min_period, false) then 1 else 0 end
    + case when len(skills) = 0 and len(required_skills) + len(main_skills) > 0 then 1 else 0 end
    + case when base > 30 and mode in ('presencial', 'hibrido') and (p_mode = 'remoto' or (p_mode <> 'presencial' and near = 'distante')) then 1 else 0 end
    + case when not complete then 1 else 0 end + case when exclusive and not priority then 1 else 0 end)::int)
  || chr(10) || 'link' as r_block from v_final)""",
)
def digest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumns({"position": F.lit(1), "token": F.lit("t")})
    block = ranking.digest_block("https://go.example.com/")
    return rows.select("o_orderkey", "score", F.size(F.split(block, "\n")).alias("lines"))


@register(
    "batch_groups",
    """select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1) // 3 as batch from conversations""",
)
def batch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return ranking.batch_groups(rows, ["conv_id"], "turn", 3).select("conv_id", "turn", "batch")


@register(
    "batch_reconcile",
    """with asked as (select doc_id // 10 as batch, doc_id as id from documents),
answers as (select (doc_id + quality) // 10 as batch, case when toxic = 1 then doc_id - doc_id % 7 else doc_id end as id from labels),
c as (select batch, id, count(*) as n from answers group by 1, 2)
select coalesce(a.batch, c.batch) as batch, coalesce(a.id, c.id) as id, case when c.n is null then 'missing' when a.id is null then 'foreign'
  when c.n > 1 then 'repeated' else 'accepted' end as status from asked a full join c on a.batch = c.batch and a.id = c.id""",
)
def batch_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    asked = B.table(spark, sf_dir, "documents").select(F.floor(doc / 10).alias("batch"), doc.alias("id"))
    answers = B.table(spark, sf_dir, "labels").select(
        F.floor((doc + F.col("quality")) / 10).alias("batch"),
        F.when(F.col("toxic") == 1, doc - doc % 7).otherwise(doc).alias("id"),
    )
    return dedup.reconcile_batches(asked, answers)


CACHE_SQL = """v_cache as (select doc_id as id, case when quality = 1 then 'm1' else 'm2' end as model, toxic = 0 as read_complete from labels),
v_asked as (select doc_id as id, doc_id % 3 <> 0 as complete from documents)"""


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = B.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 3 != 0).alias("description_complete")
    )
    cache = B.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, "m1").otherwise("m2").alias("model"),
        (F.col("toxic") == 0).alias("read_complete"),
    )
    return scoring.with_cached_extraction(postings, cache, "m1", ["id"])


@register(
    "extraction_cache_join",
    f"""with {CACHE_SQL} select a.id, c.id is not null as cached, c.read_complete from v_asked a left join v_cache c on c.id = a.id and c.model = 'm1'""",
)
def extraction_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, sf_dir).select("id", "cached", "read_complete")


@register(
    "pending_extractions",
    f"""with {CACHE_SQL} select a.id from v_asked a left join v_cache c on c.id = a.id and c.model = 'm1'
where c.id is null or (not c.read_complete and a.complete)""",
)
def pending_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, sf_dir).filter("pending").select("id")
