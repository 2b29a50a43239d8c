"""License scans, decontamination and nearest neighbours against brute force."""

import os
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from postmatch.llm import decontamination, licenses, neighbours
from tests.compare import duck, expected, rows_of

SF = "/root/testdata/sf0.001"


def test_licenses_in_odd_texts(documents, spark):
    notices = [text for _, text in licenses.NOTICES]
    texts = [
        notices[0], "some words, " + notices[1].upper() + " more words", None, "", "released under the", " ".join(notices[3:] * 2),
        "\n".join(["filler words in here"] * 200 + notices), notices[2].replace(" ", "\n\t "), "(Licensed under CC BY-NC 4.0)", "---",
    ]
    rows = licenses.scan(documents(texts, clash=True), licenses.notice_templates(spark)).collect()
    got = {(r["doc_id"], r["license_id"]) for r in rows}
    assert got == {(0, "Apache-2.0"), (1, "CC-BY-NC-4.0"), (5, "MIT"), (7, "GPL-3.0"), (8, "CC-BY-NC-4.0")} | {(6, n) for n, _ in licenses.NOTICES}
    assert all(r["containment"] >= 0.75 for r in rows) and len(rows) == len(got)
    assert licenses.scan(documents(["x"]).limit(0), licenses.notice_templates(spark)).count() == 0


def test_license_of_many_words(documents, spark):
    rng = random.Random(1)
    template = [f"t{rng.randint(0, 500)}" for _ in range(120)]
    near, far = list(template), list(template)
    for at in range(0, 20, 10):
        near[at] = "changed"
    for at in range(0, 120, 4):
        far[at] = "changed"
    noise = " ".join(f"n{i}" for i in range(500))
    texts = [f"{noise} {' '.join(near)} {noise}", f"{noise} {' '.join(far)}", noise]
    rows = licenses.scan(documents(texts), spark.createDataFrame([("L", " ".join(template)), ("E", None), ("E", "")], "license_id string, text string")).collect()
    assert [(r["doc_id"], r["license_id"]) for r in rows] == [(0, "L")]


def counted_whole(texts, templates, least=0.75):
    """Every text against every template: the share of distinct shingles."""
    import re

    def grams(text):
        plain = re.sub(r"[\x09-\x0D\x20]+", " ", text or "").lower()
        words = [w for w in (re.sub(r"^[^\w]+|[^\w]+$", "", w) for w in plain.split(" ")) if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    held = [grams(t) for t in texts]
    wanted = [(name, grams(t)) for name, t in templates]
    return {(i, name) for i, h in enumerate(held) for name, g in wanted if g and len(h & g) >= least * len(g)}


def test_windows_retrieve_near_copies_at_the_bar(documents, spark):
    rng = random.Random(12)
    prose = lambda n: [f"p{rng.randint(0, 10**6)}" for _ in range(n)]
    templates = [(f"L{i}", " ".join(prose(rng.choice([3, 5, 9, 40, 100, 131, 140, 200, 600])))) for i in range(60)]
    texts = []
    for _, text in templates:
        for every in (15, 20, 21, 24, 40):  # at 20 about 3/4 of the shingles are left
            words, shift = text.split(), rng.randint(0, 40)
            words = [w if (i + 1) % every else "changed" for i, w in enumerate(words)]
            texts.append(" ".join(prose(shift) + words + prose(rng.randint(0, 60))))
    want = counted_whole(texts, templates)
    got = {(r["doc_id"], r["license_id"]) for r in licenses.scan(documents(texts), licenses.notice_templates(spark, templates)).collect()}
    assert got <= want and len(want) > 150 and len(got) >= 0.999 * len(want)


def changed(text, every):
    return " ".join("changed" if i % every == 0 else w for i, w in enumerate(text.split(), 1))


def test_license_texts_headers_and_near_copies(documents, spark):
    templates = licenses.license_templates(spark)
    by = {}
    for r in templates.collect():
        by.setdefault(r["license_id"], []).append(r["text"])
    own = [(n, max(by[n], key=len)) for n in ("MIT", "BSD-2-Clause", "ISC", "MPL-2.0", "CC0-1.0")]
    own += [("Apache-2.0", next(t for t in by["Apache-2.0"] if t.startswith("Licensed under the Apache License, Version 2.0 (the"))), ("CC-BY-4.0", by["CC-BY-4.0"][0])]
    texts = [f"some {text} more" for _, text in own] + [changed(text, 25) for _, text in own[:6]] + [changed(text, 4) for _, text in own[:6]]
    texts += ["we are distributed under the MIT License, as said", "released under the FOO license", dict(licenses.NOTICES)["GPL-3.0"]]
    got = {(r["doc_id"], r["license_id"]) for r in licenses.scan(documents(texts), templates).collect()}
    assert {(i, n) for i, (n, _) in enumerate(own)} | {(len(own) + i, n) for i, (n, _) in enumerate(own[:6])} <= got
    assert not [g for g in got if 13 <= g[0] < 19 or g[0] == 20] and (19, "MIT") in got
    assert {n for i, n in got if i == 21} == {"GPL-3.0"}


def test_more_than_2000_license_shingles(documents, spark):
    long = " ".join(f"t{i}" for i in range(6000))
    templates = spark.createDataFrame([("L", long)] + [(f"S{i}", " ".join(f"s{i}x{j}" for j in range(20))) for i in range(200)], "license_id string, text string")
    texts = [f"a b {changed(long, 100)} c", "x " + " ".join(f"s7x{j}" for j in range(20)), " ".join(long.split()[:4000]), None]
    for limit in (licenses.BROADCAST_BYTES, 0):
        rows = licenses.scan(documents(texts), templates, broadcast_bytes=limit).collect()
        got = {r["doc_id"]: (r["license_id"], round(r["containment"], 6), r["first_word"]) for r in rows}
        lost = {j for i in range(100, 6001, 100) for j in range(max(0, i - 5), min(5996, i))}
        assert got == {0: ("L", round(1 - len(lost) / 5996, 6), 2), 1: ("S7", 1.0, 1)} and len(rows) == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ["op3_licenses", "op7_warc"])
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    assert rows_of(df.columns, df.collect()) == expected(duck(SF), entry.oracle_sql()[name])


def edits_within(probe, text):
    """Fewest edits between the probe and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(probe):
        last, row = row, [i + 1]
        for j, c in enumerate(text):
            row.append(min(last[j] + (p != c), last[j + 1] + 1, row[j] + 1))
    return min(row)


def test_leaks_equal_full_alignment(documents, spark):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdeñ") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [prose(rng.randint(5, 60)) for _ in range(8)] + ["tiny", None, ""]
    texts = [prose(40), None, "", "short"]
    for _ in range(40):
        own = list(rng.choice(items[:8]))
        own = own[: rng.choice([60, 110, 400])]
        for _ in range(rng.choice([0, 2, 6, 12])):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[], ["z"], [own[at], "z"]])
        texts.append(prose(rng.randint(0, 20)) + " \n" + "".join(own).upper() + " " + prose(rng.randint(0, 20)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for d, text in enumerate(texts):
        flat = " ".join((text or "").lower().split()).encode()
        for i, item in enumerate(items):
            whole = " ".join((item or "").lower().split()).encode()
            if len(whole) < decontamination.Q:
                continue
            for _, probe, k in decontamination.Probes([(i, whole)]).probes[0]:
                if edits_within(probe, flat) <= k:
                    want.add((d, i))
    for block in (decontamination.BLOCK_BYTES, 300):
        df = documents(texts, clash=True)
        rows = decontamination.leaks(df, bench, block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
        kept = decontamination.without_leaks(df, bench, block)
        assert kept.columns == df.columns
        assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontamination.leaks(df, bench.limit(0)).count() == 0
    assert decontamination.leaks(df.limit(0), bench).count() == 0


def test_excerpts_at_every_offset(documents, spark):
    rng = random.Random(7)
    item = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(60))
    size = decontamination.PROBE
    texts = [f"zzz z {item[at : at + size]} zz zzz" for at in range(len(item) - size + 1)]
    found = decontamination.leaks(documents(texts), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(len(texts)))


def exact(ids, v, k):
    out = {}
    for i, q in zip(ids, v, strict=True):
        if i % 20 == 0:
            score = (v * q).sum(axis=1)
            order = sorted((-s, j) for s, j in zip(score, ids, strict=True) if j != i)[:k]
            out[i] = [j for _, j in order]
    return out


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(0)
    good = [(i, [float(x) for x in rng.normal(size=8) * rng.uniform(0.2, 3)], "c") for i in range(300)]
    good += [(i, good[0][1], "c") for i in range(300, 340)]
    odd = [(1000, None, "c"), (1020, [0.0] * 8, "c"), (1040, [1.0] * 3, "c"), (1060, [float("nan")] * 8, "c"), (1080, [None] + [1.0] * 7, "c"), (1100, [float("inf")] * 8, "c"), (None, [1.0] * 8, "c")]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>, list string")
    rows = neighbours.nearest(df, lambda i: i % 20 == 0).collect()
    ids, v = [g[0] for g in good], np.array([g[1] for g in good], np.float32).astype(float)
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = exact(ids, v, 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9
    few = neighbours.nearest(df.filter("vec_id < 5"), lambda i: i % 20 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert neighbours.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are not here")
def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    want = exact([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float32).astype(float), 20)
    found = neighbours.nearest(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), lambda i: i % 20 == 0).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.9


def test_repeated_rows_and_null_ids(documents, spark):
    notice = dict(licenses.NOTICES)["GPL-3.0"]
    rng = random.Random(3)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    rows = [(None, notice), (None, notice), (5, notice), (5, notice), (5, item), (None, item), (None, item), (6, None)]
    found = licenses.scan(documents(rows, clash=True), licenses.notice_templates(spark)).collect()
    assert sorted((r["doc_id"] or 0, r["license_id"]) for r in found) == [(0, "GPL-3.0")] * 2 + [(5, "GPL-3.0")] * 2
    bench = spark.createDataFrame([(1, item), (1, item), (2, None)], "item_id long, text string")
    leaked = decontamination.leaks(documents(rows), bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in leaked) == [(0, 1)] * 4 + [(5, 1)] * 2
    assert decontamination.without_leaks(documents(rows), bench).count() == 5


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0] if i else [2.0, 0.0]) for i in range(45)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(df, lambda i: i == 0).collect()
    assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, 21)) and {r["score"] for r in rows} == {2.0}
