"""Quality classifier and language identification: brute force, odd rows, held-out accuracy."""

import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from postmatch.llm import langid, quality

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_ranked_grams_equal_a_count():
    texts = [" Das ist, das IST es! ".lower(), "  ", " a1b  c ", " ñandú "]
    doc, gram, rank, count = langid.ranked_grams(texts)
    for i, text in enumerate(texts):
        flat = "_" + "".join(c if c.isalpha() else "_" for c in text).strip("_") + "_"
        while "__" in flat:
            flat = flat.replace("__", "_")
        grams = Counter()
        if flat != "_":
            grams.update(c for c in flat if c != "_")
            grams.update(flat[j : j + 2] for j in range(len(flat) - 1))
            grams.update(flat[j : j + 3] for j in range(len(flat) - 2) if flat[j + 1] != "_")
        own = [n for d, n in zip(doc, count, strict=True) if d == i and n > 0]
        if grams:
            assert sorted(own) == sorted(grams.values())
        assert list(rank[doc == i]) == list(range((doc == i).sum()))
        assert all(a >= b for a, b in zip(own, own[1:], strict=False))


def test_distance_equals_brute_force():
    known = {"aa": {}, "bb": {}}
    for name, text in (("aa", " abc abd abc "), ("bb", " xyz xyw xyz ")):
        _, gram, rank, _ = langid.ranked_grams([text])
        known[name] = dict(zip(gram.tolist(), rank.tolist(), strict=True))
    labels, scores = langid.nearest_language(["abd", None, "12", "xyz xyz", ""], known, top=10)
    assert labels == ["aa", "und", "und", "bb", "und"] and scores[1] == 0 and 0 < scores[0] <= 1
    _, gram, rank, _ = langid.ranked_grams([" abd "])
    away = sum(abs(known["aa"][g] - r) if g in known["aa"] else 10 for g, r in zip(gram.tolist(), rank.tolist(), strict=True) if r < 10)
    assert scores[0] == pytest.approx(1 - away / (10 * min(10, len(gram))))


def test_odd_rows(documents, spark):
    df = documents([(1, "abc abc"), (1, "abc abc"), (None, "abc"), (2, None), (3, "... 12")], clash=True)
    rows = langid.languages(df).collect()
    assert len(rows) == 5 and {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3)} == {"und"}
    assert langid.languages(df.limit(0)).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(df, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality_scores(df.limit(0), labels.limit(0)).count() == 0
    assert quality.keep_good(df, labels).columns == df.columns


@needs_tables
def test_held_out_languages(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in entry.queries()["op10_langid"](spark, SF).collect() if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in rows]) > 0.95


@needs_tables
def test_held_out_quality(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r["doc_id"]: r for r in entry.queries()["op2_quality"](spark, SF).collect()}
    pairs = [(truth[d], rows[d]["predicted"]) for d in truth if held(d)]
    assert np.mean([a == b for a, b in pairs]) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())


def test_context_vectors_equal_a_plain_sum():
    raw, offsets = np.frombuffer(b"one two!!THREE four", np.uint8), np.array([0, 9, 19])
    slots, counts = quality.token_slots(raw, offsets)
    where, sign = quality._index_vectors()
    want, at = np.zeros((quality.SLOTS, quality.WIDTH)), 0
    for n in counts:
        own = slots[at : at + n]
        at += n
        for i in range(n):
            for j in range(n):
                if 0 < abs(i - j) <= quality.REACH:
                    np.add.at(want[own[i]], where[own[j]], sign[own[j]])
    assert counts.sum() == 10 and np.allclose(want, quality.context_sums(raw, offsets))
    vectors = np.random.default_rng(0).normal(size=(quality.SLOTS, quality.WIDTH)).astype(np.float32)
    texts = ["one two", "", "THREE"]
    got = quality.pooled(*quality.utf8(pa.array(texts)), vectors)
    assert np.allclose(got[1], 0) and np.allclose(got[0], vectors[quality.token_slots(np.frombuffer(b"one two", np.uint8), np.array([0, 7]))[0]].mean(axis=0), atol=1e-5)
