"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from postmatch.llm import spelling

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and is_near(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()), key=repr)


def some_words(rng, many):
    words = {}
    for _ in range(many):
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(5, 9)))
        words[w] = rng.choice([3, 3, 6, 12, 50])
    for w in list(words)[: many // 2]:
        i = rng.randrange(len(w))
        words[rng.choice([w[:i] + w[i + 1 :] + "z", w[:i] + rng.choice("abz") + w[i:], w[:i] + rng.choice("xyÿ") + w[i + 1 :], w + w[-1], w[0] + w])] = rng.choice([3, 7, 100])
    return {w: n for w, n in words.items() if len(w) >= 5}


@pytest.mark.parametrize("part_words", [100_000, 7])
def test_variants_equal_all_pairs(spark, monkeypatch, part_words):
    monkeypatch.setattr(spelling, "PART_WORDS", part_words)
    words = some_words(random.Random(part_words), 150) | {"aaaaa": 9, "aaaaaa": 20, "aaaaaaa": 41, "aaaaaaaa": 41, "ÿÿÿÿÿ": 5, "abcde": 5, "abcdef": 5}
    df = spark.createDataFrame([(w, n, "clash", 0, "clash") for w, n in words.items()], "word string, n long, rank string, form long, up string")
    assert found(df) == plain(words)


def test_words_of_texts(spark, documents, monkeypatch):
    rng = random.Random(1)
    base = ["Straße", "HOUSES", "houses", "naïveté", "ÀÉÎõü", "fünfzehn", "x÷y×zabc", "short", "čekaaaaa", "don't", "under_score", "naiveté", "housses"]
    rows = [(i, " ".join(rng.choices(base, k=40)) + rng.choice(["", "\n", "-日本語words", " é"])) for i in range(120)]
    rows += [(None, "houses " * 5), (None, None), (7, ""), rows[3], rows[3], (500, "a" * 3000 + " " + "houses," * 2000), (501, "a" * 3000), (502, "a" * 2999 + "b a" + "a" * 2999)]
    for block in (1 << 20, 50):
        monkeypatch.setattr(spelling, "BLOCK", block)
        got = {r["word"]: r["n"] for r in spelling.word_counts(documents(rows, clash=True)).collect()}
        assert got == counted(rows)
    assert spelling.variants(spelling.word_counts(documents(["x"]).limit(0))).count() == 0


def test_very_long_words(spark):
    long = "ab" * 20_000
    words = {long: 8, long[:-1]: 3, "x" + long: 20, long[:7] + "c" + long[8:]: 3}
    rows = {r[0]: r[1:] for r in found(spark.createDataFrame(list(words.items()), "word string, n long"))}
    assert rows[long][0] == "x" + long and rows[long][3] == 3 and rows[long[:-1]][0] == long and rows[long[:-1]][1] == "x" + long
