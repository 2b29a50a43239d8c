"""Links between vectors against all pairs, on one graph and over several shards."""

import numpy as np
import pytest

from postmatch.llm import near_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, node string, root string, links string, weight string, v string, first string, size string"


def usable(v, label, vec_id):
    return v is not None and label is not None and vec_id is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def all_pairs(rows, bar):
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for i, (a, v, x) in enumerate(rows):
        for j, (b, w, y) in enumerate(rows):
            if i != j and usable(v, x, a) and usable(w, y, b) and x == y and len(v) == len(w):
                p, q = np.array(v) / max(map(abs, v)), np.array(w) / max(map(abs, w))
                linked[i, j] = p @ q / np.sqrt((p @ p) * (q @ q)) >= bar
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            fresh = set(np.flatnonzero(linked[todo].any(axis=0)).tolist()) - seen
            seen |= fresh
            todo = sorted(fresh)
        own = rows[i][0]
        component = min([rows[j][0] for j in seen if rows[j][0] is not None], default=None)
        out.append((own, int(linked[i].sum()), component, own == component))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, x, *["clash"] * 7) for i, v, x in rows], SCHEMA)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df, **options).collect()), key=repr)


def families(seed, many, size=16):
    rng = np.random.Generator(np.random.PCG64(seed))
    rows = []
    for _ in range(many):
        center = rng.normal(size=size)
        for _ in range(int(rng.integers(1, 14))):
            rows.append(center + rng.normal(size=size) * rng.choice([0.05, 0.2, 0.35]))
    order = rng.permutation(len(rows))
    return [(int(i), rows[k].tolist(), int(rng.integers(0, 2))) for i, k in enumerate(order)]


@pytest.mark.parametrize("shard_rows", [4096, 60])
def test_links_equal_all_pairs(spark, shard_rows):
    rows = families(3, 45)
    assert found(spark, rows, shard_rows=shard_rows) == all_pairs(rows, near_vectors.BAR)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.1], 0), (3, [2.0, 0.1], 0), (3, [0.0, 5.0], 0), (4, [1.0, 0.0], 1), (5, [1.0, 0.0], None), (6, None, 0),
        (7, [0.0, 0.0], 0), (8, [nan, 1.0], 0), (9, [inf, 1.0], 0), (10, [None, 1.0], 0), (11, [1.0, 0.0, 0.0], 0), (12, [], 0), (None, [1.0, 0.0], 0),
        (13, [1e300, 1e299], 0), (14, [1e-300, 0.0], 0), (15, [-1.0, 0.0], 0), (16, [0.0, 4.0], 0),
    ]
    want = [(*r[:3], r[0] == r[2]) for r in all_pairs(rows, near_vectors.BAR)]
    assert found(spark, rows) == sorted([(*r[:3], True) if r[0] is None else r for r in want], key=repr)
    assert near_vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_family_over_shards(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    center = rng.normal(size=24)
    rows = [(1000 + i, (center + rng.normal(size=24) * 0.1).tolist(), 7) for i in range(400)] + [(i, rng.normal(size=24).tolist(), 7) for i in range(200)]
    rows += [(5000 + i, rows[0][1], 7) for i in range(300)]
    assert found(spark, rows, shard_rows=100) == all_pairs(rows, near_vectors.BAR)


def test_audit_widens_to_whole_results(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(5))
    points = near_vectors.units(np.repeat(rng.normal(size=(30, 12)), 20, axis=0) + rng.normal(size=(600, 12)) * 0.1)
    graph = near_vectors.Graph(points)
    for level in graph.levels:
        level[:] = -1  # a graph that leads nowhere
    truth = points @ points.T >= 0.93
    np.fill_diagonal(truth, False)
    assert (near_vectors.linked(graph, None, 0.93) == truth).all()
