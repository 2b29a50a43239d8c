"""Token counts and packing against plain versions."""

import os
import random

import pytest

from postmatch.llm import packing, token_counts

MODEL = f"{os.environ.get('POSTMATCH_TOKENIZERS', '/opt/tokenizers')}/{token_counts.VOCABULARY}"


def plain_count(word, scores):
    text = token_counts.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        size = len(text[end - 1].encode("utf-8", "surrogatepass"))
        options = [(best[end - 1][0] + size * token_counts.BYTE_SCORE, best[end - 1][1] - size)]
        for begin in range(end):
            if text[begin:end] in scores:
                options.append((best[begin][0] + scores[text[begin:end]], best[begin][1] - 1))
        best.append(max(options))
    return -best[-1][1]


def test_trie_equals_plain_viterbi(monkeypatch):
    rng = random.Random(1)
    scores = {"▁": -3.0, "▁a": -2.5, "ab": -2.0, "b": -3.5, "a": -3.5, "abc": -4.0, "c": -2.0, "bcab": -5.0, "▁abca": -6.0}
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    for limit in (10**6, 20):
        monkeypatch.setattr(token_counts, "MAX_KEPT", limit)
        trie = token_counts.PreTokenTrie(scores)
        for at in range(0, len(words), 50):
            part = [[w] for w in words[at : at + 50]]
            assert trie.count(part) == [plain_count(w[0], scores) for w in part]


@pytest.mark.skipif(not os.path.isfile(MODEL), reason="vocabulary is not here")
def test_counts_of_documents(documents):
    texts = ["The lazy dog", None, "", " \n ", "naïve 漢字 " * 40, "x" * 3000, "The lazy dog"]
    scores = token_counts.zipf_scores(MODEL)
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.count_tokens(documents(texts, clash=True), MODEL).collect()}
    assert got == {i: (len((t or "").split()), sum(plain_count(w, scores) for w in (t or "").split())) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(documents(["x"]).limit(0), MODEL).count() == 0


def plain_pack(lengths, sizes, cost):
    bins = []
    for i, length in enumerate(lengths):
        fitting = [b for b in bins if b["room"] >= length]
        if fitting:
            chosen = min(fitting, key=lambda b: b["room"])
        else:
            def price(c):
                rest = sum(x for x in lengths[i + 1 :] if x <= c - length)
                return cost(c) / min(c, length + rest), c
            size = min((c for c in sizes if c >= length), key=price)
            chosen = {"room": size, "used": 0}
            bins.append(chosen)
        chosen["room"] -= length
        chosen["used"] += length
    return sorted((b["used"], min(c for c in sizes if c >= b["used"])) for b in bins)


def test_pack_equals_plain_best_fit():
    rng = random.Random(2)
    for _ in range(20):
        lengths = sorted((rng.randint(1, 64) for _ in range(rng.randint(1, 60))), reverse=True)
        bins, positions, capacity = packing.pack(lengths, (16, 32, 64))
        used, end = {}, {}
        for length, b, p, c in zip(lengths, bins, positions, capacity, strict=True):
            assert p == end.get(b, 0)
            end[b] = p + length
            used[b] = (end[b], c)
        assert sorted(used.values()) == plain_pack(lengths, (16, 32, 64), packing.attention_cost)


def test_packed_documents(documents):
    rng = random.Random(3)
    texts = ["w " * rng.randint(0, 900) for _ in range(150)] + ["long " * 10_000, None, "", "  ", "one"]
    for shard in (packing.SHARD_TOKENS, 3000):
        rows = packing.best_fit(documents(texts, clash=True), shard_tokens=shard).collect()
        spans, filled = {}, {}
        for r in rows:
            spans.setdefault(r["doc_id"], []).append((r["first_token"], r["n_tokens"]))
            if r["n_tokens"]:
                filled.setdefault((r["shard"], r["bin"], r["capacity"]), []).append((r["position"], r["n_tokens"]))
            else:
                assert r["bin"] is None
        for i, text in enumerate(texts):
            own, at = sorted(spans[i]), 0
            for first, n in own:
                assert first == at
                at += n
            assert at == len((text or "").split())
        for (_, _, capacity), held in filled.items():
            at = 0
            for position, n in sorted(held):
                assert position == at
                at += n
            assert at <= capacity and not any(at <= c < capacity for c in packing.CAPACITIES)
    assert packing.best_fit(documents(["x"]).limit(0)).count() == 0


def test_rows_without_ids_are_dealt_to_many_shards(documents):
    df = documents([(None, " ".join(["w"] * 50))] * 400, clash=True)
    rows = packing.best_fit(df, shard_tokens=1000).collect()
    shards = {r["shard"] for r in rows}
    assert len(rows) == 400 and len(shards) == 20 and sum(r["n_tokens"] for r in rows) == 20_000
