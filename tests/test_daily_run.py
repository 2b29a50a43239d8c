"""The daily run: republications in each profile's own scope, and the chain's steps against SQL."""

import random

import __spark_entry__ as entry
from postmatch.operators import dedup
from tests.compare import duck, expected, rows_of

SF = "/root/testdata/sf0.001"


def similar(a, b):
    a, b = set(a), set(b)
    return min(len(a), len(b)) >= 20 and len(a & b) / len(a | b) >= 0.8


def test_republications_count_for_the_profile_that_was_sent_one(spark):
    rng = random.Random(3)
    texts = []
    for family in range(6):
        words = [f"f{family}w{i}" for i in range(rng.choice([12, 25, 40]))]
        for _ in range(8):
            texts.append((len(texts), f"block{family % 2}", [w for w in words if rng.random() > 0.05]))
    pairs = sorted({(rng.choice("abc"), rng.randrange(len(texts))) for _ in range(90)})
    sent = sorted({(rng.choice("abz"), rng.randrange(len(texts))) for _ in range(12)})
    by = {seq: (block, words) for seq, block, words in texts}
    want = [
        (p, s) for p, s in pairs
        if any(p == q and by[s][0] == by[t][0] and similar(by[s][1], by[t][1]) for q, t in sent)
    ]
    make = spark.createDataFrame
    got = dedup.republished_pairs(
        make(pairs, "profile_id string, seq long"), make(sent, "profile_id string, seq long"), make(texts, "seq long, ad_key string, words array<string>")
    )
    assert sorted(tuple(r) for r in got.collect()) == want and 0 < len(want) < len(pairs)


def test_unnamed_companies_agree_with_all(spark):
    words = [f"w{i}" for i in range(30)]
    known = [("k", words, "firm"), ("k", words[:28], "confidencial"), ("o", words, "firm")]
    rows = [(0, "k", words, "firm"), (1, "k", words, "other"), (2, "o", words, "other"), (3, "o", words, "confidencial"), (4, "o", words, "firm"), (5, "k", words[:10], "firm"), (6, "z", words, "firm")]
    df = spark.createDataFrame(rows, "seq long, ad_key string, words array<string>, company_key string")
    told = spark.createDataFrame(known, "ad_key string, words array<string>, company_key string")
    found = lambda **o: sorted(r[0] for r in dedup.known_republications(df, told, ["seq"], **o).collect())
    assert found(same_company=True) == [0, 1, 3, 4] and found() == [0, 1, 2, 3, 4]


def test_run_equals_sql(spark):
    con = duck(SF)
    for name in ("daily_run", "daily_counters"):
        df = entry.queries()[name](spark, SF)
        assert rows_of(df.columns, df.collect()) == expected(con, entry.oracle_sql()[name])
