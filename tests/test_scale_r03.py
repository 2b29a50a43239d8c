"""Steps rewritten to scale give what the plain definitions give."""

import random
import re

from pyspark.sql import functions as F

from postmatch import fixed_values as V
from postmatch.functions import context as X
from postmatch.functions import matches
from postmatch.functions import text as T
from postmatch.operators import candidates as C
from postmatch.operators import dedup, limits
from postmatch.operators import quality as Q


def test_site_limits_equal_one_event_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(limits, "ceiling", lambda anonymous: F.when(anonymous, 150).otherwise(100))
    rng = random.Random(4)
    hour = limits.HOUR
    rows = []
    for i in range(1500):
        at = rng.randrange(3 * hour)
        rows.append((i, at, rng.choice(["a", "b", None]), rng.choice(["x", "y", None, None])))
    rows += [(2000 + i, 5 * hour + i * 1000, "one", None) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, at long, session_id string, user_id string").withColumn("occurred_at", F.timestamp_micros("at"))
    got = {r["id"]: r["reason"] for r in limits.limit_site_events(df, chunk=40).collect()}
    taken, placed, want = [], {}, {}
    for i, at, s, u in sorted(rows, key=lambda r: (r[1], r[0])):
        near = [t for t in taken if t[0] > at - hour]
        full = (s is not None and sum(t[1] == s for t in near) >= 60) or (u is not None and sum(t[2] == u for t in near) >= 60)
        key = (at // hour, u is None)
        over = placed.get(key, 0) >= (150 if u is None else 100)
        want[i] = "session_or_account_limit" if full else "hourly_ceiling" if over else None
        if want[i] is None:
            taken.append((at, s, u))
            placed[key] = placed.get(key, 0) + 1
    assert got == want and len(set(want.values())) == 3


def test_signatures_lose_no_similar_pair(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(36)]
    sets = [sorted(rng.sample(base, rng.randint(20, 36))) for _ in range(120)]
    df = spark.createDataFrame([(i, "k", " ".join(s), s) for i, s in enumerate(sets)], "seq long, ad_key string, set string, words array<string>")
    marked = df.select("seq", *[c.alias(n) for n, c in dedup.signature(F.col("words")).items()])
    other = marked.select(*[F.col(c).alias(f"r{c}") for c in marked.columns])
    kept = {tuple(r) for r in marked.join(other).filter(dedup.maybe_similar("", "r", 0.8)).select("seq", "rseq").collect()}
    near = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8}
    assert near <= kept and len(kept) < len(sets) ** 2
    got = {tuple(r) for r in dedup.similar_classes(df, df).select("set", "k_set").collect()}
    assert got == {(" ".join(sets[i]), " ".join(sets[j])) for i, j in near}


def test_opening_words_need_only_the_start_of_a_text(spark):
    texts = ["Ação " * 3 + "x" * 2000 + " fim c++ c#", "–— a‑b\t ﬁm  \n z", " ".join(f"p{i}" for i in range(900)), ("c++ " * 600), None, "", "  \x1c\x1f "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    slow = F.trim(F.regexp_replace(T.ascii_fold(F.translate("t", T.DASHES, "-" * len(T.DASHES))), r"[\s\x1c-\x1f]+", " "))
    whole = F.array_distinct(F.slice(T.words_of_folded(slow), 1, T.OPENING_WORDS))
    for fast, plain in df.select(F.struct(T.fold_text(F.col("t")), T.opening_words(F.col("t"))), F.struct(slow, whole)).collect():
        assert tuple(fast) == tuple(plain)


def test_prefilters_change_no_match(spark):
    texts = ["exige 3 anos de experiencia", "experiencia minima de 2 anos", "home office", "site", "on-site", "curso de obra", "area de x", None, "ano", "pcds"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    cited = rf"\b(?:{V.FORMATION_CONTEXT}|{V.FORMATION_LABEL})"
    rules = [(V.YEARS_OF_EXPERIENCE, ["experiencia"], ["ano"]), (V.ON_SITE_WORK, ["presencial", "hibrid", "hybrid", "site"]), (cited, V.FORMATION_PARTS)]
    for pattern, *needles in rules:
        assert all(a == b for a, b in df.select(matches.holds(F.col("t"), pattern, *needles), F.col("t").rlike(pattern)).collect())


def test_word_starts_are_sought_near_contexts_only():
    def plain(text):
        contexts = [m.start() for m in X._FORMATION_WORD.finditer(text)]
        near = [m.start() for m in re.finditer(r"\b\w", text) if any(m.start() - 520 <= c < m.start() for c in contexts)]
        return [p for p in near if X._FORMATION.search(X._window(text, p)) or X._LABEL.search(X._window(text, p))]

    rng = random.Random(6)
    parts = ["cursando", "curso:", "de", "em", "obra", "superior em", "xy", ". ", "area de", "formacao"] + ["w" * n for n in (30, 200)]
    for _ in range(60):
        text = " ".join(rng.choice(parts) for _ in range(60))
        assert X.course_starts_of(text) == plain(text)


def test_unsent_pairs_are_candidates_less_sent(spark):
    members = spark.createDataFrame([(i, i % 3) for i in range(30)] + [(4, 1)], "profile_id long, class_id long")
    pairs = spark.createDataFrame([("s", str(q), q, c, "near") for q in range(10) for c in range(3) if (q + c) % 4], "source string, external_id string, seq long, class_id long, proximity string")
    sent = spark.createDataFrame([(4, 1), (4, 1), (7, 2), (8, 3), (99, 1), (None, 2)], "profile_id long, seq long")
    old = C.profile_classes, C.class_pairs
    try:
        C.profile_classes, C.class_pairs = lambda p: (None, members), lambda *a: pairs
        got = C.unsent_candidate_pairs(None, None, sent)
    finally:
        C.profile_classes, C.class_pairs = old
    want = C.without_sent(pairs.join(members, "class_id"), sent, ["profile_id", "seq"])
    rows = lambda df: sorted(tuple(r) for r in df.select("profile_id", "seq").collect())
    assert rows(got) == rows(want) and len(rows(got)) < pairs.join(members, "class_id").count()


def test_signups_read_once_break_the_same_rules(spark):
    docs = ['{"perfil": {"curso": "Letras", "periodo": 2, "habilidades": ["sql"], "areas_de_interesse": ["obras"]}, "aceitou_termos": true}', "no json", None, "{}", '{"perfil": {"curso": 3, "pessoa_com_deficiencia": "sim"}, "extra": 1}']
    df = spark.createDataFrame([(d,) for d in docs], "signup string")
    rows = lambda x: [sorted(r["violations"]) for r in x.collect()]
    plain = Q.with_violations(df, Q.signup_rules(F.col("signup"), ["obras"]))
    assert rows(Q.check_signups(df, "signup", ["obras"])) == rows(plain)
