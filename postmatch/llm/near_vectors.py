"""Near duplicates among embeddings: hierarchical navigable small-world graphs per shard, every shard queried.

Equal vectors of a label are one class first, so copies never meet. The classes of a label are dealt by hash
to shards of about `SHARD_ROWS`; a task builds the graph of one shard (`Graph`), whose nodes and links are rows
of a table. For each two shards of a label, one task asks each with the vectors of the other (and a shard with
its own): a beam search from the top level down finds the nearest, and from those at or near the bar the
search floods on along links, so a family of any size is found whole. What is found is verified by cosine in
double precision.

Each task audits itself: for up to `AUDIT` vectors of either side taken evenly and as many that have links, all links are
computed; while less than `RECALL` of them are found, the beams double, the flood goes further below the bar,
and the task searches again. Beams as wide as a shard are past all use of a graph: then the task compares
directly, so results are whole in any case.

Links stay inside their task: it returns, for each class with links, their number and the class that stands
for its component there; components over all tasks are united on those rows. No rows are made per link.

Defined cases: vectors that are null, zero or hold null or non-finite components, or whose label or id is
null, link with nothing and are their own component; vectors of different length do not link; every row is a
vector, so repeated rows link with each other; an empty table gives no rows. A link is counted for both its
vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmatch.llm.common import components, stored

BAR = 0.93
SHARD_ROWS = 4096
LINKS = 12  # of a node on the upper levels, twice as many on the lowest
BUILD_BEAM = 48
BEAM = 24
SLACK = 0.02
TOGETHER = 512  # queries searched at once
AUDIT = 64
RECALL = 0.99
#: Single precision decides the way through a graph; what comes this close to the bar is verified.
ROUNDING = 1e-4
LEVELS = 6
SEED = 11


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length 1. Divided by their largest component first, so no square overflows or vanishes."""
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Graph:
    """Levels of links between the rows of one shard."""

    def __init__(self, points: np.ndarray, levels: list[np.ndarray] | None = None, top: np.ndarray | None = None):
        self.exact = points
        self.points = points.astype(np.float32)
        n = len(points)
        if levels is not None:
            self.levels, self.top = levels, top
            self.entry = int(np.argmax(top))
            return
        drawn = np.random.Generator(np.random.PCG64(SEED)).random(n)
        self.top = np.minimum(np.floor(-np.log(1 - drawn) / np.log(LINKS)), LEVELS).astype(np.int64)
        self.levels = [np.full((n, LINKS if level else 2 * LINKS), -1, np.int32) for level in range(int(self.top.max()) + 1)]
        self.entry, at = 0, 1
        while at < n:
            end = min(n, at + min(at, TOGETHER // 2))
            self._insert(np.arange(at, end))
            at = end

    def _insert(self, new: np.ndarray) -> None:
        """Links rows to the graph and to each other."""
        high, queries = int(self.top[self.entry]), self.points[new]
        here = np.full(len(new), self.entry)
        for level in range(max(high, int(self.top[new].max())), -1, -1):
            deep = self.top[new] >= level
            if level <= high and not deep.all():
                here[~deep] = self.beam(level, queries[~deep], here[~deep], 1)[0][:, 0]
            if not deep.any():
                continue
            rows, asked = new[deep], queries[deep]
            peers = asked @ asked.T
            np.fill_diagonal(peers, -np.inf)
            choice = np.argsort(-peers, axis=1, kind="stable")[:, : min(LINKS, len(rows) - 1)]
            candidates = rows[choice]
            if level <= high:
                ids = self.beam(level, asked, here[deep], BUILD_BEAM)[0]
                here[deep] = ids[:, 0]
                candidates = np.concatenate([ids, candidates], axis=1)
            if not candidates.shape[1]:
                continue
            chosen = self._choose(asked, candidates, LINKS)
            self.levels[level][rows[:, None], np.arange(chosen.shape[1])] = chosen
            to = chosen >= 0
            self._link_back(level, np.repeat(rows, to.sum(axis=1)), chosen[to])
        best = new[np.argmax(self.top[new])]
        if self.top[best] > high:
            self.entry = int(best)

    def _choose(self, queries: np.ndarray, candidates: np.ndarray, width: int) -> np.ndarray:
        """Up to `width` candidates of each query: nearest first, before others those nearer to it than to any chosen one."""
        out = []
        for a in range(0, len(queries), TOGETHER):
            q, ids = queries[a : a + TOGETHER], candidates[a : a + TOGETHER]
            near = np.where(ids >= 0, np.einsum("td,tcd->tc", q, self.points[ids]), -np.inf)
            order = np.argsort(-near, axis=1, kind="stable")
            ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
            vectors = self.points[ids]
            between = vectors @ vectors.transpose(0, 2, 1)
            chosen, covered, count = np.zeros(ids.shape, bool), np.full(ids.shape, -2, np.float32), np.zeros(len(ids), int)
            for c in range(ids.shape[1]):
                fine = (ids[:, c] >= 0) & (count < width) & (covered[:, c] < near[:, c])
                chosen[:, c] = fine
                count += fine
                covered[fine] = np.maximum(covered[fine], between[fine, c])
            first = np.argsort(~chosen, axis=1, kind="stable")[:, :width]
            out.append(np.take_along_axis(ids, first, 1))
        return np.concatenate(out)

    def _link_back(self, level: int, sources: np.ndarray, targets: np.ndarray, at_once: int = 16) -> None:
        links = self.levels[level]
        order = np.argsort(targets, kind="stable")
        sources, targets = sources[order], targets[order]
        begin = np.searchsorted(targets, targets)
        place = np.arange(len(targets)) - begin
        for low in range(0, int(place.max(initial=-1)) + 1, at_once):
            part = (place >= low) & (place < low + at_once)
            rows, number = np.unique(targets[part], return_inverse=True)
            more = np.full((len(rows), at_once), -1, np.int64)
            more[number, place[part] - low] = sources[part]
            more[(more[:, :, None] == links[rows][:, None, :]).any(axis=2)] = -1
            both = np.concatenate([links[rows], more], axis=1)
            full = (both >= 0).sum(axis=1) > links.shape[1]
            links[rows[~full]] = np.take_along_axis(both[~full], np.argsort(both[~full] < 0, axis=1, kind="stable"), 1)[:, : links.shape[1]]
            if full.any():
                links[rows[full]] = self._choose(self.points[rows[full]], both[full], links.shape[1])

    def beam(self, level: int, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest rows found for each query, best first, and their similarities; queries go step by step together."""
        n, links = len(self.points), self.levels[level]
        rows = np.arange(len(queries))
        ids, near = np.full((len(queries), width), -1, np.int64), np.full((len(queries), width), -np.inf, np.float32)
        ids[:, 0], near[:, 0] = entry, np.einsum("ij,ij->i", queries, self.points[entry])
        opened = np.zeros(ids.shape, bool)
        seen = np.zeros((len(queries), n), bool)
        seen[rows, entry] = True
        while len(rows):
            waiting = np.where(opened[rows] | (ids[rows] < 0), -np.inf, near[rows])
            best = waiting.argmax(axis=1)
            going = waiting[np.arange(len(rows)), best] > -np.inf
            rows, best = rows[going], best[going]
            if not len(rows):
                break
            opened[rows, best] = True
            step = links[ids[rows, best]]
            fresh = (step >= 0) & ~seen[rows[:, None], step]
            row, col = np.nonzero(fresh)
            seen[rows[row], step[row, col]] = True
            found = np.full(step.shape, -np.inf, np.float32)
            found[row, col] = np.einsum("ij,ij->i", queries[rows[row]], self.points[step[row, col]])
            all_near = np.concatenate([near[rows], found], axis=1)
            keep = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
            near[rows] = np.take_along_axis(all_near, keep, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(fresh, step, -1)], axis=1), keep, 1)
            opened[rows] = np.take_along_axis(np.concatenate([opened[rows], np.zeros(step.shape, bool)], axis=1), keep, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)

    def links_of(self, exact: np.ndarray, width: int, slack: float, own: bool, bar: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first query, query in the block, row) for the pairs at or above the bar; `own`: the queries are the graph's rows."""
        n = len(self.points)
        for a in range(0, len(exact), TOGETHER):
            block = exact[a : a + TOGETHER]
            queries = block.astype(np.float32)
            here = np.arange(a, a + len(block)) if own else np.full(len(block), self.entry)
            for level in range(0 if own else int(self.top[self.entry]), 0, -1):
                here = self.beam(level, queries, here, 1)[0][:, 0]
            ids, near = self.beam(0, queries, here, min(width, n))
            rows, place = np.nonzero(near >= bar - slack)
            pairs = [rows * n + ids[rows, place]]
            seen = np.zeros((len(block), n), bool)  # anew: a beam forgets rows that it has seen
            seen.reshape(-1)[pairs[0]] = True
            sure = [near[rows, place]]
            frontier = pairs[0]
            while len(frontier):  # on along the links of all that is near enough
                onward = []
                for b in range(0, len(frontier), 1 << 16):
                    query, row = np.divmod(frontier[b : b + (1 << 16)], n)
                    step = self.levels[0][row]
                    keys = (query[:, None] * n + step)[step >= 0]
                    keys = np.unique(keys[~seen.reshape(-1)[keys]])
                    seen.reshape(-1)[keys] = True
                    query, row = np.divmod(keys, n)
                    near = np.einsum("ij,ij->i", queries[query], self.points[row])
                    enough = near >= bar - slack
                    onward.append(keys[enough])
                    pairs.append(keys[enough])
                    sure.append(near[enough])
                frontier = np.concatenate(onward)
            keys = np.concatenate(pairs)[np.concatenate(sure) >= bar - ROUNDING]
            for b in range(0, max(1, len(keys)), 1 << 16):
                query, row = np.divmod(keys[b : b + (1 << 16)], n)
                fine = np.einsum("ij,ij->i", block[query], self.exact[row]) >= bar
                yield a, query[fine], row[fine]


def linked(one: Graph, two: Graph | None, bar: float, width: int = BEAM, slack: float = SLACK) -> np.ndarray:
    """Which rows of one shard link with which of another (of itself: None), widened until the audit passes."""
    other = two or one
    found = np.zeros((len(one.exact), len(other.exact)), bool)
    while True:
        for a, query, row in other.links_of(one.exact, width, slack, two is None, bar):
            found[a + query, row] = True
        if two is not None:
            for a, query, row in one.links_of(two.exact, width, slack, False, bar):
                found[row, a + query] = True
        else:
            found |= found.T
            np.fill_diagonal(found, False)
        if _audited(one.exact, other.exact, found, two is None, bar) and (two is None or _audited(two.exact, one.exact, found.T, False, bar)):
            return found
        width, slack = 2 * width, min(1.0, 2 * slack)
        if width >= max(found.shape):
            for a in range(0, len(found), TOGETHER):
                found[a : a + TOGETHER] = one.exact[a : a + TOGETHER] @ other.exact.T >= bar
            if two is None:
                np.fill_diagonal(found, False)
            return found


def _audited(queries: np.ndarray, rows: np.ndarray, found: np.ndarray, own: bool, bar: float) -> bool:
    """Whether enough of all links of sampled queries are found."""
    with_links = np.flatnonzero(found.any(axis=1))
    spread = lambda x: x[np.unique(np.linspace(0, len(x) - 1, min(len(x), AUDIT)).astype(int))]
    sample = np.union1d(spread(np.arange(len(queries))), spread(with_links) if len(with_links) else with_links)
    truth = queries[sample] @ rows.T >= bar
    if own:
        truth[np.arange(len(sample)), sample] = False
    return (truth & found[sample]).sum() >= RECALL * truth.sum()


def families(found: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of both sides, the smallest row (left ones first) that their links reach; each row and column is visited once."""
    left, right = np.full(found.shape[0], -1), np.full(found.shape[1], -1)
    for start in np.flatnonzero(found.any(axis=1)):
        if left[start] >= 0:
            continue
        todo = np.array([start])
        left[start] = start
        while len(todo):
            reached = np.flatnonzero(found[todo].any(axis=0) & (right < 0))
            right[reached] = start
            if own:
                todo = reached[left[reached] < 0]
            else:
                todo = np.flatnonzero(found[:, reached].any(axis=1) & (left < 0))
            left[todo] = start
    return left, right


def _weighed(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each row, the sum of the weights that it is linked with."""
    return np.concatenate([found[a : a + TOGETHER] @ weights for a in range(0, len(found), TOGETHER)])


NODES = "label {0}, size int, shards int, shard int, node long, weight long, v array<double>, top int, links array<int>"


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build(rows: pa.Table) -> pa.Table:
    """The rows of a shard with their links: those of the lowest level, then of each level above."""
    rows = rows.sort_by("node")
    graph = Graph(units(_vectors(rows.column("v"))))
    flat = np.concatenate(graph.levels, axis=1)
    length = 2 * LINKS + LINKS * graph.top
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    links = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[np.arange(flat.shape[1]) < length[:, None]]))
    return rows.append_column("top", pa.array(graph.top.astype(np.int32))).append_column("links", links)


def _read(rows: pa.Table) -> tuple[Graph, np.ndarray, np.ndarray]:
    rows = rows.sort_by("node")
    top = rows.column("top").to_numpy().astype(np.int64)
    flat = np.full((len(rows), 2 * LINKS + LINKS * int(top.max())), -1, np.int32)
    flat[np.arange(flat.shape[1]) < (2 * LINKS + LINKS * top)[:, None]] = rows.column("links").combine_chunks().flatten().to_numpy()
    levels = [flat[:, : 2 * LINKS], *[flat[:, LINKS * (level + 1) : LINKS * (level + 2)] for level in range(1, int(top.max()) + 1)]]
    return Graph(units(_vectors(rows.column("v"))), [np.ascontiguousarray(x) for x in levels], top), rows.column("node").to_numpy(), rows.column("weight").to_numpy()


def near_vectors(vectors: DataFrame, bar: float = BAR, key: str = "vec_id", value: str = "embedding", label: str = "label", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept)."""
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(value).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(fine)
    classes = usable.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"))
    classes = stored(classes.select("label", F.size("v").alias("size"), "v", "first", "weight", F.monotonically_increasing_id().alias("node")))
    shards = classes.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = classes.join(shards, ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))

    schema = NODES.format(classes.schema["label"].dataType.simpleString())
    names = ["label", "size", "shards", "shard", "node", "weight", "v"]
    graphs = stored(dealt.select(names).groupBy("label", "size", "shards", "shard").applyInArrow(build, schema))
    meet = lambda begin, end: F.explode(F.sequence(begin, end))
    last = F.col("shards") - 1
    left = graphs.select("label", "size", F.col("shard").alias("a"), meet(F.col("shard"), last).alias("b"), "node", "weight", "v", "top", "links")
    right = graphs.filter("shard > 0").select("label", "size", meet(F.lit(0), F.col("shard") - 1).alias("a"), F.col("shard").alias("b"), "node", "weight", "v", "top", "links")

    def searched(one: pa.Table, two: pa.Table) -> pa.Table:
        if not len(one):
            return pa.table({c: np.zeros(0, np.int64) for c in ("node", "links", "root")})
        graph, nodes, weights = _read(one)
        other, other_nodes, other_weights = _read(two) if len(two) else (None, nodes, weights)
        found = linked(graph, other, bar)
        home, other_home = families(found, other is None)
        out = [(nodes, _weighed(found, other_weights), home)]
        if other is not None:
            out.append((other_nodes, _weighed(found.T, weights), other_home))
        has = [h >= 0 for _, _, h in out]
        return pa.table({
            "node": np.concatenate([n[h] for (n, _, _), h in zip(out, has, strict=True)]),
            "links": np.concatenate([c[h] for (_, c, _), h in zip(out, has, strict=True)]),
            "root": np.concatenate([nodes[r[h]] for (_, _, r), h in zip(out, has, strict=True)]),
        })

    keys = ["label", "size", "a", "b"]
    met = stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(searched, "node long, links long, root long"))
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    homes = components(met.filter(F.col("node") != F.col("root")).select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = classes.join(counts, "node", "left").join(homes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = known.groupBy("root").agg(F.min("first").alias("component"))
    known = known.join(smallest, "root").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    whole = rows.join(known, ["label", "v"], "left")
    named = F.col("vec_id").isNotNull()
    component = F.when(named, F.coalesce("component", "vec_id"))
    return whole.select("vec_id", F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: Every pair of a label compared.
SQL = """
with recursive v as (select row_number() over () as r, vec_id, label, embedding::double[] as e from embeddings),
u as (
  select * from v where vec_id is not null and label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
  select a.r, b.r as o, b.vec_id as id from u a join u b on a.label = b.label and len(a.e) = len(b.e) and a.r <> b.r
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach as (select r, o from links union select reach.r, links.o from reach join links on reach.o = links.r),
home as (select reach.r, min(u.vec_id) as id from reach join u on u.r = reach.o group by reach.r),
counted as (select r, count(*) as n from links group by r)
select v.vec_id, coalesce(n, 0) as n_links, least(v.vec_id, home.id) as component_id, home.id is null or v.vec_id <= home.id as kept
from v left join home using (r) left join counted using (r)
"""
