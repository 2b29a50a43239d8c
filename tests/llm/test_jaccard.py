"""Components of similar documents against brute force."""

import random
import re

from postmatch.llm import jaccard


def sets_of(texts):
    upper = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(upper))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(texts):
    sets, root = sets_of(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i)) for i in range(len(sets))]


def corpus(seed=3):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randint(0, 4000)}" for _ in range(n)]
    texts = [" ".join(words(rng.randint(1, 60))) for _ in range(30)]
    for size in (12, 40, 150):  # drifting chains: neighbours link, far members do not
        chain = words(size)
        for _ in range(15):
            texts.append(" ".join(chain))
            at = rng.randrange(len(chain))
            chain = chain[:at] + words(rng.randint(1, 2)) + chain[at + 1 :]
    passage = words(60)  # a frequent passage in texts that do not link
    texts += [" ".join(words(40) + passage + words(rng.randint(10, 50))) for _ in range(25)]
    texts += [" ".join(passage + words(8)) for _ in range(25)]
    base = words(90)
    for _ in range(40):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = words(1)[0]
        texts.append(" ".join(own))
    texts += ["One two three", "one TWO three", "one two", "", None, " \t\n", "x", "x", "a b c d e", "A b c d e", "repeat " * 50, "repeat " * 60]
    rng.shuffle(texts)
    return texts


def test_components_equal_brute_force(documents):
    texts = corpus()
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(documents(texts, clash=True)).collect())
    assert got == brute(texts)


def test_small_blocks_give_the_same(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 2)
    monkeypatch.setattr(jaccard, "MAX_FREQUENT", 5)
    texts = corpus(8)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(documents(texts)).collect())
    assert got == brute(texts)


def test_one_per_component_and_odd_rows(documents):
    text = "a b c d e f g h"
    df = documents([(5, text), (None, text), (3, text), (3, text), (3, "other words here"), (None, None), (9, ""), (9, "")], clash=True)
    kept = jaccard.one_per_component(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"] or -1), r["text"] or "") for r in kept.collect()) == [(-1, ""), (3, text), (3, "other words here"), (9, ""), (9, "")]
    rows = [(r["doc_id"], r["component_id"]) for r in jaccard.similar_components(df).collect()]
    assert rows.count((None, 3)) == 1 and rows.count((None, None)) == 1 and rows.count((5, 3)) == 1


def test_empty_table(documents):
    assert jaccard.similar_components(documents(["x"]).limit(0)).count() == 0


def test_bound_and_prefix():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 200), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64)]))
        assert jaccard.least_difference(jaccard.parity_bits(a), jaccard.parity_bits(b)) <= len(np.setxor1d(a, b))
