"""Names of product events and answer reasons (fixed values of the event log)."""

LANDING = "landing_visualizada"
CTA_OPENED = "cta_cadastro_aberto"
PROFILE_STEP = "etapa_perfil_concluida"
SKILLS_STEP = "etapa_habilidades_concluida"
PREFERENCES_STEP = "etapa_preferencias_concluida"
ACCOUNT_CREATED = "conta_criada"
EMAIL_CONFIRMED = "email_confirmado"
PROFILE_SAVED = "perfil_salvo"
CHAT_OPENED = "telegram_aberto"
CHAT_LINKED = "telegram_vinculado"
FIRST_RECOMMENDATION = "primeira_recomendacao_enviada"
OPENED = "vaga_aberta"
USEFUL = "vaga_util"
IRRELEVANT = "vaga_irrelevante"
APPLIED = "candidatura_iniciada"
PAUSED = "entregas_pausadas"

ANSWERS = (USEFUL, IRRELEVANT)
VISITOR_EVENTS = (LANDING, CTA_OPENED, PROFILE_STEP, SKILLS_STEP, PREFERENCES_STEP)
ACCOUNT_EVENTS = (*VISITOR_EVENTS, PROFILE_SAVED, CHAT_OPENED)
ALL_EVENTS = (
    *ACCOUNT_EVENTS,
    ACCOUNT_CREATED,
    EMAIL_CONFIRMED,
    CHAT_LINKED,
    FIRST_RECOMMENDATION,
    OPENED,
    USEFUL,
    IRRELEVANT,
    APPLIED,
    PAUSED,
)

REASON_KEY = "motivo"
REASON_AREA = "motivo_area"
REASON_SCORE = "motivo_nota"
REASON_REPEATED = "motivo_repetida"
REASON_CLOSED = "motivo_encerrada"
NO_REASON = "sem_motivo"
DIRECT = "(direto)"

# Landing hosts and pages of local development.
LOCAL_HOST = (
    r"^(localhost|file|127\.[0-9.]+|0\.0\.0\.0|10\.[0-9.]+|192\.168\.[0-9.]+"
    r"|172\.(1[6-9]|2[0-9]|3[01])\.[0-9.]+|.*\.local|.*\.localhost)$"
)
LOCAL_PAGES = (
    r"(^|/)web/",
    r"^/(Users|home|private|tmp|var|mnt|Volumes|opt)/",
    r"^/[A-Za-z]:",
)
