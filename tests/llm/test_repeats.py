"""Repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from postmatch.llm import repeats


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdéß ") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other, base = prose(70), prose(120), prose(200)
    texts = [prose(rng.randint(1, 150)) for _ in range(20)]
    texts += [prose(30) + passage + prose(rng.randint(0, 40)) for _ in range(12)]
    texts += [other + prose(20) + other, base, base, base[:400] + "x" + base[401:], base[3:], prose(60) + base]
    texts += ["ab" * 300, "a" * 199, "a" * 200, None, "", None, "z" * 700, "é" * 260]
    return texts


@pytest.mark.parametrize("options", [{}, {"shard_segments": 3, "shard_bytes": 4000}])
def test_report_equals_brute_force(documents, options):
    texts = corpus()
    got = repeats.repeat_report(documents(texts, clash=True), **options).collect()
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got}
    assert len(got) == len(texts)
    assert [rows[i] for i in range(len(texts))] == brute(texts)


def test_null_and_repeated_ids_and_kept_columns(documents):
    long = "the same words over and over again, " * 12
    df = documents([(None, long), (7, long), (7, "short"), (7, long + "end"), (None, None)], clash=True)
    kept = repeats.without_repeats(df)
    assert kept.columns == df.columns
    assert sorted("~" if r["text"] is None else r["text"] for r in kept.collect()) == ["", "", "end", "short", "~"]


def test_empty_table(documents, spark):
    assert repeats.repeat_report(documents(["x"]).limit(0)).count() == 0


def test_nothing_to_remove_from_nothing(documents):
    empty = documents(["x"], clash=True).limit(0)
    assert repeats.without_repeats(empty).count() == 0 and repeats.without_repeats(empty).columns == empty.columns
