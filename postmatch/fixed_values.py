"""Patterns, word lists and messages that results depend on.

All patterns run on folded text (ASCII, lower case, single spaces) unless noted.
The area catalogue is not here: it is an input (see `functions.courses.AreaCatalog`).
"""

# fmt: off
# --- level words ------------------------------------------------------------------------------------
HIGHER_LEVEL = (
    r"\b(?:superior|graduacao|graduand[oa]s?|bacharel(?:ado)?|licenciatura|tecnolog[oa]s?"
    r"|faculdade|universitari[oa]s?)\b"
)
HIGHER_LEVEL_OR_ACRONYM = HIGHER_LEVEL + r"|\b(?:cst|ads)\b"
TECHNICAL_COURSE = (
    r"^(?:(?:cursando|estudantes?|alun[oa]s?|curso|ensino|medio|nivel|formacao)(?: d[eoa])?\s+)*"
    r"tecnic[oa]s?\b"
)
HIGH_SCHOOL_COURSE = r"^(?:cursando\s+)?(?:ensino|nivel) medio\b"

# --- title rules ------------------------------------------------------------------------------------
INTERNSHIP = r"\bestagi|\bintern(?:ship)?s?\b"
SENIORITY = r"\b(?:pleno|senior|especialista|coordenador)\b"
HIGH_SCHOOL_TITLE = (
    r"\b(?:jovem|menor) aprendiz\b|\b(?:estudantes?|alunos?|para) (?:d[eo] )?ensino medio\b"
    r"|^\W*estagio\W+(?:de |em )?ensino medio\b|\bnivel medio\b"
)
TECHNICAL_TITLE = (
    r"\b(?:vaga|estagio|estagiari[oa]s?|oportunidade)(?: de estagio)?\s+para\s+(?:(?:os|as)\s+)?"
    r"(?:estudantes?|alun[oa]s?)\s+(?:d[eoa]s?\s+)?"
    r"(?:(?:ensino|curso|nivel)\s+tecnico|tecnicos?)\b"
    r"|^\W*estagi\w*\W+(?:(?:de|para)\s+)?(?:curso|nivel) tecnico\b"
    r"|(?:^|\s[-|:]\s*)nivel tecnico\s*(?:$|[-|:(])"
)
TITLE_ALSO_HIGHER = HIGHER_LEVEL + r"|\b(?:ou|e|em) (?:cst|ads)\b"
POSTGRADUATE = (
    r"\b(?:mestrado|doutorado|mestrand[oa]s?|doutorand[oa]s?|pos-?graduacao|pos-?graduand[oa]s?)\b"
)
UNDERGRADUATE = r"(?<!pos-)(?<!pos )\b(?:graduacao|graduand[oa]s?|universitari[oa]s?|superior)\b"
LEVEL_LINK = r"(?:\s*(?:,|/|\bou\b|\be\b)\s*)+"
UNDERGRADUATE_WITH_POSTGRADUATE = (
    UNDERGRADUATE + LEVEL_LINK + POSTGRADUATE + "|" + POSTGRADUATE + LEVEL_LINK + UNDERGRADUATE
)

# --- description rules ------------------------------------------------------------------------------
YEARS_OF_EXPERIENCE = (
    r"(\d+)\s*\+?\s*anos?\s+de\s+experiencia"
    r"|experiencia\s+(?:minima\s+)?(?:de\s+)?(\d+)\s*\+?\s*anos?"
)
EXPERIENCE_WAIVED = (
    r"\bnao\s+(?:\w+\s+){0,3}?(?:exig\w*|ped\w*|precis\w*|requer\w*|necessari\w*)"
    r"|\bsem\s+(?:a\s+)?necessidade\b|\bdispensa\w*\b"
)
CLAUSE_END = r"[.,;](?:\s|$)"
YEARS_LOW, YEARS_HIGH = 2, 9
YEARS_DIGITS = 4
WORDS_BEFORE_REQUIREMENT = 8
WORDS_AFTER_REQUIREMENT = 4
ANY_COURSE = (
    r"\b(?:qualquer|todos os|todas as)\s+(?:cursos?|formacao|formacoes|graduacao|graduacoes)"
    r"\b(?!\s+(?:de|da|do|das|dos|em|na|no)\b)"
)
REMOTE_WORK = r"\b(?:remoto|remota|remote|home[\s-]*office|tele-?trabalho)\b"
ON_SITE_WORK = r"\b(?:presencial(?:mente)?|hibrid[oa]|hybrid|on-?site)\b"

# --- words that announce a course or an activity ----------------------------------------------------
FORMATION_CONTEXT = (
    r"cursando|cursar|estudantes?|graduand[oa]s?|graduacao|formacao|formad[oa]s?|bacharelado"
    r"|bacharel|licenciatura|tecnologo|ensino superior|nivel superior|superior (?:em|de|completo)"
    r"|cursos?(?=\s*:|\s+(?:de|em|aceitos|desejados|relacionados|superior))|aceita(?:mos|m)?"
    r"|vagas? para|areas? (?:de|da|do)"
)
ACTIVITY_CONTEXT = FORMATION_CONTEXT + (
    r"|setor (?:de|da|do)|departamento (?:de|da|do)|equipe (?:de|da|do)"
    r"|time (?:de|da|do)|atuar|atuara|atuacao|atividades|responsabilidades|rotinas? (?:de|da|do)"
    r"|apoio|apoiar|auxiliar|suporte|conhecimentos? (?:em|de)|experiencia (?:em|com)|desejavel"
    r"|requisitos?|vivencia|interesse (?:em|por)|habilidades? (?:em|com)|dominio (?:de|em)"
    r"|nocoes (?:de|em)|elaborar|elaboracao"
)
FORMATION_LABEL = (
    r"(?:curso(?:s|\(s\))?|formacao|graduacao|escolaridade|cursando|(?:ensino|nivel) superior)"
    r"(?:[\s*]+(?:aceit[oa]s|academica|desejad[oa]s?|desejave(?:l|is)|necessari[oa]s?|em|de"
    r"|andamento|curso|abaixo)){0,2}"
)
# Every match of the two above holds one of these.
FORMATION_PARTS = (
    "curs", "estudante", "graduand", "graduacao", "formac", "formad", "bacharel", "licenciatura", "tecnologo",
    "superior", "escolaridade", "aceita", "vaga", "area",
)
WORDS_TO_TERM = 24
CONTEXT_WINDOW = 260

# --- course names -----------------------------------------------------------------------------------
COURSE_PREFIXES = (
    "curso superior de tecnologia", "curso superior", "ensino superior", "nivel superior",
    "bacharelado", "licenciatura", "tecnologo", "tecnologia", "tecnico", "graduacao", "graduando",
    "graduanda", "superior", "cursando", "estudante", "estudantes", "formacao", "formado", "formada",
    "bacharel", "aluno", "aluna", "alunos", "cursos", "curso",
)
COURSE_CONNECTORS = ("em", "de", "do", "da", "no", "na")
COURSE_SUFFIXES = ("em andamento", "em curso", "incompleto", "completo", "concluido", "cursando")
GENERIC_COURSES = (
    "ensino superior", "nivel superior", "curso superior", "superior", "graduacao", "qualquer curso",
    "qualquer graduacao", "qualquer formacao", "todos os cursos", "areas afins", "areas correlatas",
)
COURSE_SYNONYMS = {
    "ti": "tecnologia da informacao",
    "rh": "recursos humanos",
    "ciencias economicas": "economia",
    "ciencias juridicas": "direito",
    "ciencias juridicas e sociais": "direito",
    "ciencias contabeis": "contabilidade",
    "ciencias atuariais": "atuaria",
    "gestao de recursos humanos": "recursos humanos",
    "administracao de empresas": "administracao",
    "adm": "administracao",
    "publicidade e propaganda": "publicidade",
    "propaganda": "publicidade",
    "ciencias da computacao": "ciencia da computacao",
    "ads": "analise e desenvolvimento de sistemas",
    "comunicacao social": "comunicacao",
    "engenharia da computacao": "engenharia de computacao",
    "t.i": "tecnologia da informacao",
    "t.i.": "tecnologia da informacao",
    "processamento de dados": "tecnologia da informacao",
    "sistemas da informacao": "sistemas de informacao",
    "sistema da informacao": "sistemas de informacao",
    "sistema de informacao": "sistemas de informacao",
    "si": "sistemas de informacao",
    "redes": "redes de computadores",
    "data science": "ciencia de dados",
    "gestao da ti": "gestao da tecnologia da informacao",
    "gestao de ti": "gestao da tecnologia da informacao",
    "gestao de rh": "recursos humanos",
    "tecnologia": "tecnologia da informacao",
    "ciberseguranca": "seguranca cibernetica",
    "sistemas para a internet": "sistemas para internet",
    "desenvolvimento de software": "desenvolvimento de sistemas",
    "rede de computadores": "redes de computadores",
    "analise de sistema": "analise de sistemas",
}
COURSE_ABBREVIATIONS = {
    "eng": "engenharia", "adm": "administracao", "cienc": "ciencias", "cien": "ciencias", "c": "ciencias",
}
COURSE_LEADING_SIGNS = r"^[^a-z0-9]+"
COURSE_TRAILING_SIGNS = r"[^a-z0-9]+$"
COURSE_COMPLEMENT = r"\s*(?:\(|[-–|/,]).*$"
COURSE_CLOSING_STATE = rf"(?:\s*[-–|:]\s*|\s+)(?:{'|'.join(COURSE_SUFFIXES)})$"
COURSE_LEVEL_BEFORE = rf"^(?:{'|'.join(COURSE_PREFIXES)})(?: (?:{'|'.join(COURSE_CONNECTORS)}))?\s+"
COURSE_ABBREVIATED = r"^{}(?:\.\s*|\s+)(?=[a-z])"
COMPUTING_AREA = "computacao"
TEACHING_AREA = "educacao"
TEACHING_DEGREE = "licenciatura"

# --- accepted courses of a posting ------------------------------------------------------------------
OPEN_TO_ANY_COURSE = ("qualquer curso", "qualquer graduacao", "qualquer formacao", "todos os cursos")
TECHNICAL_WORD = r"\btecnic[oa]s?\b"
ITEM_ALTERNATIVES = r"\s+(?:e/)?ou\s+|\s*[/,]\s*"
LEVEL_AT_START = (
    r"^(?:(?:cursando|estudantes?|ensino|curso|nivel)\s+)*"
    r"(?:tecnic[oa]s?|superior|graduacao|graduand[oa]s?|bacharel(?:ado)?|licenciatura"
    r"|tecnolog[oa]s?|cst)(?:\s+(?:em|de|do|da|no|na))?(?:\s+|$)"
)

# --- audience of a posting --------------------------------------------------------------------------
DISABILITY = r"(?:pcds?|pessoas? com deficiencias?|pessoas? portadoras? de deficiencias?)"
POSTING_SUBJECT = r"(?:vaga|oportunidade|processo seletivo|selecao)"
AUDIENCE_QUALIFIER = (
    r"(?:exclusiv[ao]|exclusivamente|somente|apenas|unicamente"
    r"|destinad[ao]|voltad[ao]|direcionad[ao]|reservad[ao])"
)
ACRONYM_AFTER = r"(?:\s*\(\s*pcds?\s*\))?"
LOOSE_NO = r"nao(?=\s*(?:$|[.;,|)/]|-(?:\s|$)))"
OTHER_AUDIENCE_WORD = (
    rf"(?:tambem|ampla|preferencial\w*|n/a|nao\s+(?:se\s+aplica|informad[ao]|{DISABILITY})|{LOOSE_NO})"
)
NO_OTHER_AUDIENCE = (
    rf"(?!{ACRONYM_AFTER}\s*(?:/|,?\s*(?:e|ou)\b|[-:?,(|\s]*{OTHER_AUDIENCE_WORD}\b))"
    r"(?![^.]{0,60}\bnao\s+(?:e\s+)?exclusiv)"
)
MENTIONS_DISABILITY = rf"\b{DISABILITY}\b"
EXCLUSIVE_SENTENCE = (
    rf"\b{POSTING_SUBJECT}\s+(?:afirmativa\s+)?(?:de\s+(?:emprego|estagio)\s+)?"
    rf"(?:(?:e|sera|esta)\s+)?"
    rf"(?:para|{AUDIENCE_QUALIFIER}\s+(?:(?:para|a|as|aos)\s+)?)\s*{DISABILITY}\b{NO_OTHER_AUDIENCE}"
    rf"|\bvaga\s+{DISABILITY}\b{NO_OTHER_AUDIENCE}"
    rf"|\b(?:inscricoes|candidaturas)\s+(?:(?:sao|serao)\s+)?"
    rf"(?:exclusivas|exclusivamente|somente|apenas|unicamente)\s+(?:para|de)\s+{DISABILITY}\b"
    rf"{NO_OTHER_AUDIENCE}"
)
TITLE_PART_START = r"(?:^|\s[-|]\s*|\()\s*"
TITLE_PART_END = rf"\s*(?:$|\)|\s[-|]\s){NO_OTHER_AUDIENCE}"
EXCLUSIVE_TITLE_PART = (
    rf"{TITLE_PART_START}pcds?{TITLE_PART_END}"
    rf"|{TITLE_PART_START}(?:vaga\s+(?:exclusiv[ao]\s+(?:para\s+)?)?|exclusiv[ao]\s+(?:para\s+)?)"
    rf"{DISABILITY}{TITLE_PART_END}"
    rf"|^\W*estagi\w*\s+(?:exclusivo\s+)?para\s+{DISABILITY}\b{NO_OTHER_AUDIENCE}"
)
VETO_BEFORE = r"\b(?:nao|tambem|nossas?|outras?|confira|conheca|programas?|reservas?)\s+(?:[\w-]+\s+){0,3}$"
SENTENCE_START = r"(?:^|[.;:!?|()\[\]*\"]|(?:^|\s)-)\s*(?:(?:[ao]s?|est[ae]s?|ess[ae]s?)\s+)?$"
AFFIRMATIVE_POSTING = (
    r"\b(?:vaga|acao|processo seletivo|oportunidade|estagio|programa|selecao)"
    r"\s+(?:de\s+estagio\s+)?afirmativ[ao]\b"
)
AFFIRMATIVE_TITLE = r"\bafirmativ[ao]s?\b"
# The two group patterns run on the original text, ignoring case.
GROUPS_IN_DESCRIPTION = (
    r"(?i)\b(?:vaga|a[cç][aã]o|processo seletivo|oportunidade|est[aá]gio|programa|sele[cç][aã]o)"
    r"\s+(?:de\s+est[aá]gio\s+)?afirmativ[ao]\b[^().]{0,40}?\(([^()]{3,80})\)"
)
GROUPS_IN_TITLE = r"(?i)\bafirmativ[ao]s?\b[^().]{0,40}?\(([^()]{3,80})\)"
GROUP_NAME = (
    r"\b(?:pcds?|deficien\w*|negr[oa]s?|pret[oa]s?|pard[oa]s?|indigenas?|raca|racial|etni\w*"
    r"|mulher(?:es)?|genero|lgbt\w*|trans|\d{2}|idade|diversidade)\b"
)
CHARS_BEFORE_SUBJECT = 60
AFFIRMATIVE_EXCERPT = 160
AUDIENCE_GENERAL = "geral"
AUDIENCE_EXCLUSIVE = "exclusivo_pcd"
AUDIENCE_AFFIRMATIVE = "afirmativo"
AUDIENCE_AFFIRMATIVE_DISABILITY = "afirmativo_com_pcd"

# --- discard reasons, in order ----------------------------------------------------------------------
DISCARD_REASONS = (
    "nao_e_estagio", "exige_senioridade", "exige_pos_graduacao", "exige_ensino_medio",
    "exige_ensino_tecnico", "exclusiva_para_pcd", "fora_da_area_do_curso",
    "exige_anos_de_experiencia", "localizacao_incompativel", "modalidade_incompativel",
)

# --- sources and origins ----------------------------------------------------------------------------
DEFAULT_LOCATION = "Brasil"
UNKNOWN_COMPANY = "Empresa não informada"
UNIDENTIFIED_COMPANIES = ("", "empresa nao informada", "confidencial", "empresa confidencial")
SOURCE_A, SOURCE_B, SOURCE_C = "adzuna", "gupy", "jooble"
EXCERPT_ONLY_SOURCES = (SOURCE_C,)
ORIGIN_REQUIRED_SOURCES = (SOURCE_A,)
BLOCKED_PARTNER_ID = "79986"
BLOCKED_PARTNER_NAME = "emprego"
BLOCKED_PARTNER_DOMAIN = "emprego.pt"
BLOCKED_DOMAINS = {
    "gupy.io": "os termos da Gupy proíbem agregar, copiar ou duplicar as vagas dela",
    "linkedin.com": "o LinkedIn bloqueia coleta automatizada e está fora do escopo do projeto",
    "emprego.pt": "o emprego.pt publica como novos anúncios brasileiros já vencidos",
}
WORKPLACE_MODES = {"remote": "remoto", "hybrid": "hibrido", "on-site": "presencial"}

# --- near duplicates --------------------------------------------------------------------------------
MIN_SIMILARITY = 0.8
MIN_WORDS_TO_COMPARE = 20
# fmt: on
