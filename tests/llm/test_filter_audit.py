"""The filter audit against a replay of every order over the documents themselves."""

import random
import re
from itertools import permutations

from postmatch.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, text string, part string"
DOCUMENTS = "doc_id long, text string, lang string, part string, mask int, docs long, e string, total long"


def failing(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    tests = (
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)),
    )
    return {f for f, t in zip("ABCD", tests, strict=True) if t}


def replayed(rows, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    texts = [(d, t or "", p or "") for d, t, p in rows]
    fails = [failing(t) | ({"E"} if d is not None and any(e is not None and e < d and u == t for e, u, _ in texts) else set()) for d, t, _ in texts]
    out, shapley = {}, {}
    for part in {p for _, _, p in texts}:
        own = [i for i, x in enumerate(texts) if x[2] == part]
        for order in permutations("ABCDE"):
            left, gone = list(own), set()
            for step, f in enumerate(order, 1):
                here = [i for i in left if f in fails[i]]
                late = [i for i in own if f in fails[i] and i in gone]
                left = [i for i in left if f not in fails[i]]
                gone |= set(here)
                ids = [texts[i][0] for i in here]
                alone = sum(fails[i] == {f} for i in own)
                out[part, "".join(order), step] = [len(left), len(here), len(late), alone, sum(i in good for i in ids), sum(i in toxic for i in ids)]
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, p, "clash", 1, 2, "clash", 3) for d, t, p in rows], DOCUMENTS)
    marks = spark.createDataFrame([(*x, "clash", "clash") for x in labels], LABELS)
    found = filter_audit.audit(filter_audit.failures(docs, marks)).collect()
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in found}, len(found)


def test_audit_equals_replay(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ß", "no break"]
    rows = [(None, None, None), (None, "", "en"), (1, "", "en"), (2, None, "en"), (3, "", None), (3, "", None), (4, "É" * 10 + "A", "fr"), (None, None, "fr")]
    for i in range(60):
        text = " ".join(rng.choices(vocabulary[: rng.choice([20, 403])], k=rng.choice([5, 199, 200, 260])))
        text = rng.choice([str, str.upper, lambda t: t + "\t|", lambda t: "ABC " + t])(text)
        rows.append((10 + i, text, rng.choice(["en", "de", "", None])))
    rows += [(100 + i, rows[rng.randrange(8, 68)][1], rng.choice(["en", "fr"])) for i in range(20)] + [(rows[20][0], *rows[20][1:])] * 2
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, _, _ in rows] + [(12, 1, 0), (12, 0, 1), (None, 1, 1), (999, 1, 1)]
    got, n = audited(spark, rows, labels)
    want = replayed(rows, labels)
    assert n == len(got) == len(want) and got == want


def test_audit_of_hot_text_and_empty_table(spark):
    rows = [(i, "same text", "en") for i in range(3000)] + [(5000, "other", "de")]
    got, _ = audited(spark, rows, [])
    assert got["en", "EABCD", 1] == (1, 2999, 0, 0, 0, 0, 60 * 2999) and got["en", "ABCDE", 5][2] == 2999
    docs = spark.createDataFrame([], DOCUMENTS)
    assert filter_audit.audit(filter_audit.failures(docs, spark.createDataFrame([], LABELS))).count() == 0


def test_long_text_in_blocks(monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice(["one", "Two", "x" * 90, "dré"]) + rng.choice(["", "\n"]) for _ in range(3000)).encode()
    whole = filter_audit.judge(memoryview(text))
    half = filter_audit.judge(memoryview(" ".join(f"w{i}" for i in range(3000)).encode()))
    monkeypatch.setattr(filter_audit, "BLOCK", 64)
    assert filter_audit.judge(memoryview(text)) == whole and filter_audit.judge(memoryview(" ".join(f"w{i}" for i in range(3000)).encode())) == half
    assert whole[0] == 0b0010 and half[0] == 0


def test_runs_cover_every_order_once():
    for mask in range(1, 32):
        ranks = sorted(r for _, a, b in filter_audit.steps_of(mask, 5) for r in range(a, b))
        assert ranks == list(range(120))
