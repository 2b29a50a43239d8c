"""Postings, people, extractions and places over the driver's tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmatch.functions.courses import Area, AreaCatalog, course_dictionary
from postmatch.functions.skills import skill_dictionary
from postmatch.functions.text import clean_key, opening_words
from postmatch.operators import scoring
from postmatch.operators.candidates import CLASS, posting_features
from postmatch.operators.dedup import ad_key, duplicate_key
from postmatch.plans.bindings import case, documents_to, table
from postmatch.session import cut_lineage
from postmatch.sources.regions import build_region_catalog, identify_municipality, state_codes

CATALOG = AreaCatalog(
    (
        Area(
            name="casa",
            courses=("household", "furniture"),
            title="household|furniture|moveis",
            exclusion="household|furniture",
            description="moveis|decoracao",
            search_terms=("casa", "moveis"),
            subareas=(("decoracao", "Decoração"), ("marcenaria", "Marcenaria")),
        ),
        Area(
            name="construcao",
            courses=("building", "machinery"),
            title="building|machinery|obra",
            exclusion="building|machinery",
            description="obra|concreto",
            search_terms=("obra", "predio"),
            subareas=(("obras", "Obras"), ("maquinas", "Máquinas")),
            interchangeable=True,
        ),
    )
)


def fold_sql(text: str) -> str:
    return (
        f"lower(trim(regexp_replace(regexp_replace(strip_accents(translate({text}, '‐‑–—−', '-----')),"
        " '[^\\x00-\\x7F]', '', 'g'), '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g')))"
    )


def key_sql(text: str) -> str:
    return f"array_to_string(regexp_extract_all({fold_sql(text)}, '[a-z0-9]+(?:#|\\+\\+)?'), ' ')"


def words_sql(text: str) -> str:
    return f"list_distinct(list_slice(regexp_extract_all({fold_sql(text)}, '[a-z0-9]+(?:#|\\+\\+)?'), 1, 40))"


# documents as postings ------------------------------------------------------------------------------
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    title = F.concat_ws(" ", F.slice(F.split("text", r"\s+"), 1, 3))
    city = F.concat(F.lit("City "), (F.length(title) % 25).cast("string"))
    return table(spark, sf_dir, "documents").select(
        doc.alias("seq"),
        case(doc % 4, {0: "adzuna", 1: "gupy", 2: "jooble"}, "outra").alias("source"),
        doc.cast("string").alias("external_id"),
        title.alias("title"),
        F.when(doc % 6 == 0, "Confidencial").otherwise(F.col("source")).alias("company"),
        F.when(doc % 2 == 0, F.concat(city, F.lit(", Estado de AFRICA"))).otherwise(city).alias("location"),
        F.col("text").alias("description"),
        case(doc % 7, {0: "remoto", 1: "presencial", 2: "hibrido"}).alias("mode"),
        city.alias("_city"),
        F.col("source").alias("_origin"),
    )


DOCUMENTS_SQL = f"""v_documents as (
  select *, 'City ' || (length(title) % 25) as city, {key_sql('title')} as title_key, {key_sql('company')} as company_key,
    {key_sql('description')} as text_key, {words_sql('description')} as words,
    {key_sql("regexp_replace(" + fold_sql('title') + ", '\\s*-\\s*(?:vaga(?: aberta)?|recrutamento aberto)\\s*$', '')")} || '|City ' || (length(title) % 25) as ad_key
  from (select doc_id as seq,
    case doc_id % 4 when 0 then 'adzuna' when 1 then 'gupy' when 2 then 'jooble' else 'outra' end as source,
    doc_id::varchar as external_id,
    array_to_string(list_slice(string_split_regex(text, '\\s+'), 1, 3), ' ') as title,
    case when doc_id % 6 = 0 then 'Confidencial' else source end as company, text as description,
    case doc_id % 7 when 0 then 'remoto' when 1 then 'presencial' when 2 then 'hibrido' end as mode
  from documents))"""


def compared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow columns similarity needs, computed once."""
    return cut_lineage(keyed_documents(spark, sf_dir).select("seq", "ad_key", "words", "company_key"))


def keyed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.withColumns(
        {
            "dup_key": duplicate_key(F.col("title"), F.col("company"), F.col("description"), F.col("_city")),
            "ad_key": ad_key(F.col("title"), F.col("_city")),
            "words": opening_words(F.col("description")),
            "company_key": clean_key(F.col("company")),
        }
    )


# places ---------------------------------------------------------------------------------------------
CITIES = 500
REGIONS = 125


def municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities that customers live in, with the customers as population."""
    key = (F.col("c_custkey") % CITIES).alias("municipality_id")
    counted = table(spark, sf_dir, "customer").groupBy(key).agg(F.count(F.lit(1)).alias("population"))
    number = F.col("municipality_id")
    return counted.select(
        "municipality_id",
        F.concat(F.lit("City "), number.cast("string")).alias("municipality"),
        F.concat(F.lit("R"), (number % 5).cast("string")).alias("uf"),
        (number % REGIONS).alias("region_id"),
        "population",
    )


def places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(states, regions)."""
    cities = municipalities(spark, sf_dir)
    regions = build_region_catalog(cities.drop("population"), cities.select("municipality_id", "population"))
    states = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("state_name"), F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("uf")
    )
    return state_codes(states), regions


def _location(number: Column, state: Column) -> Column:
    city = F.concat(F.lit("City "), number.cast("string"))
    return F.when(number % 3 == 0, city).otherwise(F.concat(city, F.lit(", Estado de "), state))


STATE_OF = {0: "AFRICA", 1: "AMERICA", 2: "ASIA", 3: "EUROPE", 4: "MIDDLE EAST"}
CITY_SQL = f"""v_cities as (
  select c_custkey % {CITIES} as id, 'R' || (c_custkey % {CITIES} % 5) as uf, c_custkey % {CITIES} % {REGIONS} as region_id,
    count(*) as population from customer group by 1, 2, 3)"""


# postings that exercise the rules -------------------------------------------------------------------
PREFIXES = (
    "Estágio em", "Estagiário de", "Internship", "Estágio pleno de", "Estágio para estudantes do curso técnico em",
    "Estágio de ensino médio", "Estágio mestrado", "PCD - Estágio em", "Analista de",
)
FIELDS = ("Building", "Machinery", "Household", "Furniture", "Automobile", "Geral", "Obra")
ENDINGS = (
    ". Aceitamos qualquer curso.", ". Exige 3 anos de experiência.", ". Trabalho home office.",
    ". Atividades de apoio em obra.", ". Modelo presencial.", ". Cursando automobile ou áreas afins.", ".",
    ". Rotinas de decoração.", ". Modelo presencial.", ".", ".",
)


def rule_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    city = doc % CITIES
    title = F.concat_ws(
        " ", case(doc % len(PREFIXES), dict(enumerate(PREFIXES))), case(doc % len(FIELDS), dict(enumerate(FIELDS)))
    )
    return table(spark, sf_dir, "documents").select(
        doc.alias("seq"),
        F.col("source"),
        doc.cast("string").alias("external_id"),
        title.alias("title"),
        F.col("source").alias("company"),
        _location(city, case(city % 5, STATE_OF)).alias("location"),
        F.concat("text", case(doc % len(ENDINGS), dict(enumerate(ENDINGS)))).alias("description"),
        F.concat(F.lit("https://posts.example.com/"), doc.cast("string")).alias("url"),
        case(doc % 13, {0: "remoto", 1: "presencial", 2: "hibrido"}).alias("mode"),
        (doc % 5 != 0).alias("description_complete"),
        F.timestamp_add("DAY", (doc % 30).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("published_at"),
    )


def run_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as collected postings whose title, place and rules follow from the text's first words, so that
    copies of a text are copies of a posting."""
    doc, opening = F.col("doc_id"), F.concat_ws(" ", F.slice(F.split("text", r"\s+"), 1, 3))
    size = F.length(opening)
    city = size % 25
    parts = [case(size % len(PREFIXES), dict(enumerate(PREFIXES))), case(size % len(FIELDS), dict(enumerate(FIELDS))), opening]
    return table(spark, sf_dir, "documents").select(
        doc.alias("seq"),
        RUN_SOURCE(doc).alias("source"),
        doc.cast("string").alias("external_id"),
        F.concat_ws(" ", *parts).alias("title"),
        F.when(doc % 6 == 0, "Confidencial").otherwise(F.col("source")).alias("company"),
        _location(city, case(city % 5, STATE_OF)).alias("location"),
        F.concat(F.lit("City "), city.cast("string")).alias("municipality"),
        F.concat("text", case(size % len(ENDINGS), dict(enumerate(ENDINGS)))).alias("description"),
        F.concat(F.lit("https://posts.example.com/"), doc.cast("string")).alias("url"),
        case(doc % 13, {0: "remoto", 1: "presencial", 2: "hibrido"}).alias("mode"),
        (doc % 5 != 0).alias("description_complete"),
        F.timestamp_add("DAY", (doc % 30).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("published_at"),
        F.struct(
            F.when(doc % 50 == 3, " Emprego ").alias("partner"),
            F.when(doc % 40 == 0, "79986").when(doc % 3 == 0, "x").alias("partner_id"),
            case(doc % 60, {7: "jobs.gupy.io", 8: "LinkedIn.com", 9: "notgupy.io"}).alias("domain"),
        ).alias("origin"),
    )


def RUN_SOURCE(doc: Column) -> Column:  # noqa: N802
    return case(doc % 4, {0: "adzuna", 1: "gupy", 2: "jooble"}, "outra")


RUN_SQL = f"""v_run_postings as (
  select *, {key_sql('title')} as title_key, {key_sql('company')} as company_key, {key_sql('description')} as text_key, {words_sql('description')} as words,
    {key_sql("regexp_replace(" + fold_sql('title') + ", '\\s*-\\s*(?:vaga(?: aberta)?|recrutamento aberto)\\s*$', '')")} || '|City ' || city as ad_key,
    f in ('Building', 'Machinery', 'Obra') as t_construcao, f in ('Household', 'Furniture') as t_casa,
    f in ('Building', 'Machinery') as x_construcao, f in ('Household', 'Furniture') as x_casa,
    e = 3 as d_construcao, e = 7 as d_casa, e = 0 as any_course, e = 5 as cites_automobile,
    p = 8 as not_internship, p = 3 as seniority, p = 6 as postgrad, p = 5 as high_school, p = 4 as technical,
    p = 7 as exclusive, e = 1 as years, case when mode is not null then mode = 'remoto' else e = 2 end as admits_remote
  from (select *, {list(PREFIXES)}[p + 1] || ' ' || f || ' ' || opening as title, raw || {list(ENDINGS)}[e + 1] as description
    from (select doc_id as seq, doc_id::varchar as external_id, text as raw, opening, length(opening) % 9 as p, length(opening) % 11 as e,
      {list(FIELDS)}[(length(opening) % 7) + 1] as f, length(opening) % 25 as city,
      case doc_id % 4 when 0 then 'adzuna' when 1 then 'gupy' when 2 then 'jooble' else 'outra' end as source,
      case when doc_id % 6 = 0 then 'Confidencial' else source end as company,
      case doc_id % 13 when 0 then 'remoto' when 1 then 'presencial' when 2 then 'hibrido' end as mode, doc_id % 5 <> 0 as description_complete
      from (select *, array_to_string(list_slice(string_split_regex(text, '\\s+'), 1, 3), ' ') as opening from documents)))),
v_unblocked as (select * from v_run_postings where not (seq % 40 = 0 or seq % 50 = 3 or seq % 60 in (7, 8))
  and not (seq % 4 = 0 and seq % 50 <> 3 and seq % 40 <> 0 and seq % 3 <> 0 and seq % 60 not in (7, 8, 9)))"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, regions = places(spark, sf_dir)
    located = identify_municipality(rule_postings(spark, sf_dir), "location", states, regions)
    # Features are a table of their own: read several times, computed once, without the long texts.
    return cut_lineage(posting_features(located, CATALOG).drop("description", "f_title", "f_description"))


RULES_SQL = """v_rule_postings as (
  select *,
    f in ('Building', 'Machinery', 'Obra') as t_construcao, f in ('Household', 'Furniture') as t_casa,
    f in ('Building', 'Machinery') as x_construcao, f in ('Household', 'Furniture') as x_casa,
    e = 3 as d_construcao, e = 7 as d_casa, e = 0 as any_course, e = 5 as cites_automobile,
    p = 8 as not_internship, p = 3 as seniority, p = 6 as postgrad, p = 5 as high_school, p = 4 as technical,
    p = 7 as exclusive, e = 1 as years,
    case when mode is not null then mode = 'remoto' else e = 2 end as admits_remote
  from (select doc_id as seq, source, doc_id::varchar as external_id, doc_id % 9 as p, doc_id % 11 as e,
    (['Building', 'Machinery', 'Household', 'Furniture', 'Automobile', 'Geral', 'Obra'])[(doc_id % 7) + 1] as f,
    case doc_id % 13 when 0 then 'remoto' when 1 then 'presencial' when 2 then 'hibrido' end as mode,
    doc_id % 5 <> 0 as description_complete, doc_id % 500 as city from documents)),
v_posting_places as (
  select d.*, c.region_id from v_rule_postings d left join v_cities c on c.id = d.city)"""


# people ---------------------------------------------------------------------------------------------
SKILL_WORDS = ("red", "large", "small", "plate", "rod", "ring", "blue", "bolt")
# Declared and required phrases with aliases, levels, families and alternatives beside the plain words.
SKILL_PHRASES = {0: "MySQL", 1: "SQL avançado", 2: "Python básico", 3: "Excel", 4: "JavaScript"}
REQUIRED_PHRASES = {0: "SQL avançado", 1: "Python ou red", 2: "banco de dados", 3: "Excel e plate"}
INTERESTS = {0: "obras", 1: "decoracao", 2: "maquinas"}


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    city = key % CITIES
    words = [case((key + shift) % 8, dict(enumerate(SKILL_WORDS))) for shift in (0, 3)]
    segment = F.initcap(F.lower("c_mktsegment"))
    interest = case(key % 5, INTERESTS)
    return table(spark, sf_dir, "customer").select(
        key.alias("profile_id"),
        F.when(key % 10 == 0, F.concat(F.lit("Técnico em "), segment)).otherwise(segment).alias("course"),
        (key % 8 + 1).cast("int").alias("period"),
        F.when(key % 11 == 0, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*words, case(key % 6, SKILL_PHRASES)))).alias("skills"),
        _location(city, case(city % 5, STATE_OF)).alias("city"),
        case(key % 4, {0: "remoto", 1: "presencial", 2: "hibrido", 3: "indiferente"}).alias("mode"),
        F.array_compact(F.array(interest)).alias("interest_areas"),
        F.array_compact(F.array(F.when(key % 7 == 0, "decoracao"))).alias("refused_areas"),
        case(key % 3, {1: False, 2: True}).alias("disability"),
    )


def people_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The courses of profiles alone: all that candidates need."""
    return cut_lineage(course_dictionary(people(spark, sf_dir).select("course"), CATALOG))


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = scoring.accepted_course_names(extractions(spark, sf_dir))
    return cut_lineage(course_dictionary(people(spark, sf_dir).select("course").union(accepted), CATALOG))


def all_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = people(spark, sf_dir).select(F.explode("skills").alias("skill"))
    asked = extractions(spark, sf_dir).select(
        F.explode(F.concat("required_skills", "main_skills", "nice_skills")).alias("skill")
    )
    return skill_dictionary(mine.union(asked))


def people_places(spark: SparkSession, sf_dir: str, named: DataFrame) -> DataFrame:
    """What the discard rules need of a profile; skills are not read."""
    states, regions = places(spark, sf_dir)
    facts = scoring.profile_facts(people(spark, sf_dir).withColumn("skills", F.lit(None).cast("array<string>")), CATALOG, named)
    placed = identify_municipality(facts, "p_city", states, regions, prefix="p_")
    return cut_lineage(placed.select("p_profile_id", *CLASS))


def people_features(
    spark: SparkSession, sf_dir: str, named: DataFrame | None = None, known: DataFrame | None = None
) -> DataFrame:
    states, regions = places(spark, sf_dir)
    named = courses(spark, sf_dir) if named is None else named
    known = all_skills(spark, sf_dir) if known is None else known
    ready = scoring.profile_features(people(spark, sf_dir), CATALOG, named, known)
    return cut_lineage(identify_municipality(ready, "p_city", states, regions, prefix="p_"))


PEOPLE_SQL = """v_people as (
  select *, list_concat(skills, list_filter([case when list_has_any(skills, ['MySQL', 'SQL avançado']) then 'banco de dados' end,
      case when list_has_any(skills, ['Python básico', 'red']) then 'Python ou red' end,
      case when list_has_all(skills, ['Excel', 'plate']) then 'Excel e plate' end,
      case when list_contains(skills, 'JavaScript') then 'JS' end], lambda x: x is not null)) as meets,
    case segment when 'BUILDING' then 'construcao' when 'MACHINERY' then 'construcao'
    when 'HOUSEHOLD' then 'casa' when 'FURNITURE' then 'casa' end as area, c.region_id
  from (select c_custkey as profile_id, c_mktsegment as segment, c_custkey % 10 = 0 as is_technical, c_custkey % 8 + 1 as period,
    case when c_custkey % 11 = 0 then []::varchar[] else
      [(['red','large','small','plate','rod','ring','blue','bolt'])[(c_custkey % 8) + 1],
       (['red','large','small','plate','rod','ring','blue','bolt'])[((c_custkey + 3) % 8) + 1]]
      || case when c_custkey % 6 < 5 then [(['MySQL','SQL avançado','Python básico','Excel','JavaScript'])[(c_custkey % 6) + 1]] else [] end end as skills,
    c_custkey % 500 as city, (['remoto','presencial','hibrido','indiferente'])[(c_custkey % 4) + 1] as mode,
    case c_custkey % 5 when 0 then 'obras' when 1 then 'decoracao' when 2 then 'maquinas' end as interest,
    c_custkey % 7 = 0 and c_custkey % 5 <> 1 as refuses_decoracao,
    case c_custkey % 3 when 1 then false when 2 then true end as disability from customer)
  left join v_cities c on c.id = city)"""

MATCHING_SQL = f"{CITY_SQL}, {RULES_SQL}, {PEOPLE_SQL}"
NEAR_SQL = """case when d.city = p.city then 'mesma_cidade'
  when d.region_id = p.region_id then 'mesma_regiao' else 'distante' end"""
IN_FIELD_SQL = """(d.any_course or (d.cites_automobile and p.segment = 'AUTOMOBILE') or
  case when p.area is null then not (d.x_construcao or d.x_casa)
    when p.area = 'construcao' then d.t_construcao or (not d.x_casa and d.d_construcao)
    else d.t_casa or (not d.x_construcao and d.d_casa) end)"""
REASON_SQL = f"""case when d.not_internship then 'nao_e_estagio' when d.seniority then 'exige_senioridade'
  when d.postgrad then 'exige_pos_graduacao' when d.high_school then 'exige_ensino_medio'
  when d.technical and not p.is_technical then 'exige_ensino_tecnico'
  when d.exclusive and p.disability is not distinct from false then 'exclusiva_para_pcd'
  when not {IN_FIELD_SQL} then 'fora_da_area_do_curso'
  when d.years then 'exige_anos_de_experiencia'
  when ({NEAR_SQL}) = 'distante' and (p.mode = 'presencial' or not d.admits_remote) then 'localizacao_incompativel'
  when p.mode = 'remoto' and case when d.mode is not null then d.mode <> 'remoto' else d.e in (4, 8) end then 'modalidade_incompativel' end"""


# extractions ----------------------------------------------------------------------------------------
def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is one reading of a posting: part numbers are folded onto documents, a later one is a newer version."""
    key, words = F.col("p_partkey"), F.split("p_name", " ")
    none = F.array().cast("array<string>")
    documents = table(spark, sf_dir, "documents")
    to = documents_to(documents)
    docs = documents.select(F.col("doc_id").alias("_doc"), F.col("source"))
    parts = table(spark, sf_dir, "part").join(docs, F.col("p_partkey") % to == F.col("_doc"))
    more = lambda column: F.array_compact(F.array(column))
    return parts.select(
        "source",
        F.col("_doc").cast("string").alias("external_id"),
        F.concat(F.lit("m"), F.floor(key / to).cast("string")).alias("model"),
        F.floor(key / to).alias("version"),
        case(key % 4, {0: "construcao", 1: "casa", 2: "desconhecida"}).alias("area"),
        F.array_compact(F.array(case(key % 6, {0: "Obras", 1: "decoracao ", 2: "maquinas", 3: "outra"}))).alias("areas"),
        F.array_compact(
            F.array(case(key % 7, {0: "Building", 1: "Household", 2: "Técnico em Machinery", 3: "Machinery ou Furniture"}))
        ).alias("accepted_courses"),
        (key % 9 == 0).alias("any_course"),
        case(key % 5, {0: 3, 1: 6, 2: 40}).alias("min_period"),
        case(key % 17, {0: 2}).alias("min_years"),
        (key % 3 == 0).alias("desirable_exp"),
        F.concat(F.when(key % 4 != 1, words).otherwise(none), more(case(key % 10, REQUIRED_PHRASES))).alias("required_skills"),
        F.when(key % 3 == 1, F.array(F.lower("p_type"))).otherwise(none).alias("main_skills"),
        F.concat(
            F.when(key % 5 < 2, F.array(F.element_at(words, 1), F.lit("gear"))).otherwise(none), more(F.when(key % 8 == 0, "JS"))
        ).alias("nice_skills"),
        case(key % 6, {0: "Remoto", 1: "Híbrido", 2: "presencial"}).alias("mode"),
        F.lit(None).cast("string").alias("catch_alert"),
        case(key % 8, {0: False, 1: True}).alias("read_complete"),
    )


def newest_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.newest_extractions(extractions(spark, sf_dir), ["source", "external_id"], "version")


EXTRACTIONS_SQL = """v_extractions as (
  select p_partkey % (select max(doc_id) + 1 from documents) as seq, case p_partkey % 4 when 0 then 'construcao' when 1 then 'casa' end as e_area,
    case p_partkey % 6 when 0 then 'obras' when 1 then 'decoracao' when 2 then 'maquinas' end as e_sub,
    p_partkey % 7 as c7, p_partkey % 9 = 0 as any_flag,
    case p_partkey % 5 when 0 then 3 when 1 then 6 end as min_period, p_partkey % 17 = 0 as needs_years,
    p_partkey % 3 = 0 as desirable,
    list_concat(case when p_partkey % 4 <> 1 then string_split(p_name, ' ') else []::varchar[] end,
      case when p_partkey % 10 < 4 then [(['SQL avançado', 'Python ou red', 'banco de dados', 'Excel e plate'])[(p_partkey % 10) + 1]] else []::varchar[] end) as required_skills,
    case when p_partkey % 3 = 1 then [lower(p_type)] else []::varchar[] end as main_skills,
    list_concat(case when p_partkey % 5 < 2 then [string_split(p_name, ' ')[1], 'gear'] else []::varchar[] end,
      case when p_partkey % 8 = 0 then ['JS'] else []::varchar[] end) as nice_skills,
    case p_partkey % 6 when 0 then 'remoto' when 1 then 'hibrido' when 2 then 'presencial' end as e_mode,
    case p_partkey % 8 when 0 then false when 1 then true end as read_complete
  from part qualify row_number() over (partition by p_partkey % (select max(doc_id) + 1 from documents) order by p_partkey desc) = 1)"""


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(profile, posting) pairs the orders table names."""
    to = documents_to(table(spark, sf_dir, "documents"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("p_profile_id"), (F.col("o_orderkey") % to).alias("seq"), "o_orderkey"
    )


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs named by the orders table, joined to posting, extraction and profile features."""
    pairs = order_pairs(spark, sf_dir)
    named, known = courses(spark, sf_dir), all_skills(spark, sf_dir)
    asked = cut_lineage(
        scoring.extraction_features(newest_extractions(spark, sf_dir), CATALOG, named, known, ["source", "external_id"])
    )
    posts = features(spark, sf_dir).drop("tails").join(asked, ["source", "external_id"])
    return pairs.join(posts, "seq").join(people_features(spark, sf_dir, named, known), "p_profile_id")


PAIRS_SQL = "v_pairs as (select o_custkey as profile_id, o_orderkey % (select max(doc_id) + 1 from documents) as seq, o_orderkey from orders)"
