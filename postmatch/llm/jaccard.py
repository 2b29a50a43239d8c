"""N-gram Jaccard join: all documents whose sets of word shingles are similar, as components.

Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set holds its distinct
five-word shingles (all its words as one, if fewer). Two sets link when their Jaccard similarity is 0.75
or more.

How it runs. Equal sets are one class. Each class enters the index lists of its prefix: the quarter of
its shingles that comes first in one global order, frequent shingles last; similar sets share one. Work
is then skipped by relations between sets:
- each list has a pivot, and every member is compared with the pivot first. Members that link to it are
  in one component, so their answers need no further pair among themselves;
- members that do not are compared with a few members of the list's largest component, in turns, and once
  one of them links, the others' answers hold for it too;
- what is left of a list is cut into blocks by position. Whole block pairs are skipped by the bounds of
  sizes and positions, and where both lie in one component;
- a pair is derived from the pivot where possible: the Jaccard distance is a metric, so two sets whose
  distances to a common pivot differ by more than 0.25 cannot link.
Pairs that remain meet a parity bit map (a lower bound of the symmetric difference) and then the exact
intersection. Every pair that could link is either verified or already joined by verified links.

Defined cases: null, empty and blank texts have no shingles, link with nothing and are components of
their own; repeated rows are equal sets; a null id is kept and named only where its component has no
other id. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmatch.llm.common import BYTE_CODES, arrow_rows, components, pieces, prefix_sums, runs_of, scramble, span_hash, stored, utf8

SHINGLE = 5
#: Links from 3/4 on: intersection >= 3/7 of the sum of sizes.
FREQUENT_PER_PIECE = 3
#: Bound of the broadcast list of frequent shingles; it only sets the order, so any list gives the same links.
MAX_FREQUENT = 500_000
BLOCK_ROWS = 64
#: Turns in which members ask others of their list's largest component, how many each, the bucket of one answer, and
#: from what size of that component on it saves work.
TURNS, PARTNERS, BUCKET_ROWS, CROWD = 3, 3, 8, 16
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FOLD = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
_MULTIPLIERS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text in text order, repeats included, and where each text's begin."""
    starts, ends = runs_of(~_SPACE[raw], offsets[1:-1])
    words = span_hash(prefix_sums(BYTE_CODES[_FOLD[raw]]), starts, ends)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    size = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first[:-1] - begin[:-1], size) + np.arange(begin[-1])
    length = np.minimum(np.repeat(count, size), SHINGLE)
    total = length.astype(np.uint64)
    for k in range(SHINGLE):
        inside = k < length
        word = words[np.minimum(at + k, max(0, len(words) - 1))] if len(words) else np.zeros(0, np.uint64)
        total = total + np.where(inside, scramble(word ^ _MULTIPLIERS[k]) * _MULTIPLIERS[k], np.uint64(0))
    return scramble(total), begin


def sets_of(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a column."""
    raw, offsets = utf8(column)
    for x, y in pieces(offsets, limit):
        hashes, begin = shingles(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
        for row in range(y - x):
            yield x + row, np.unique(hashes[begin[row] : begin[row + 1]])


def fingerprint(tokens: np.ndarray) -> int:
    """64-bit name of a set, the same in any order."""
    return int(scramble(np.array([scramble(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64))[0].view(np.int64))


def parity_bits(tokens: np.ndarray) -> bytes:
    """Bit map of odd bucket counts, at least two bits per element."""
    width = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference, from two bit maps; the wider one is folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefix_order(tokens: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The shingles that a similar set must share one of: the first quarter, frequent ones last."""
    count = len(tokens) // 4 + 1
    if len(frequent):
        near = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        hot = frequent[near] == tokens
        if hot.any():
            late = tokens[hot][np.argsort(place[near[hot]], kind="stable")]
            tokens = np.concatenate([tokens[~hot], late])
    return tokens[:count]


def _read(texts: DataFrame) -> DataFrame:
    """Both tables of the first reading in one: rows (doc_id, t, f, n, bits), where f is null without shingles and t
    a hash of the text, and (tok, c) of the shingles that recur within parts of the table, with a null t."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, n, bits, held = [], [], [], []
            seen: set[int] = set()
            for _, tokens in sets_of(batch.column("text")):
                n.append(len(tokens))
                f.append(fingerprint(tokens) if len(tokens) else None)
                bits.append(parity_bits(tokens) if len(tokens) else None)
                if len(tokens) and f[-1] not in seen:
                    seen.add(f[-1])
                    held.append(tokens)
            values, c = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            del held
            values, c = values[c >= FREQUENT_PER_PIECE].view(np.int64), c[c >= FREQUENT_PER_PIECE]
            none = [None] * len(values)
            blank = pa.nulls(len(f), pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([batch.column("doc_id"), pa.nulls(len(none), pa.int64())]), pa.concat_arrays([batch.column("t"), pa.nulls(len(none), pa.int64())]),
                pa.array(f + none, pa.int64()), pa.array(n + none, pa.int64()), pa.array(bits + none, pa.binary()),
                pa.concat_arrays([blank, pa.array(values, pa.int64())]), pa.concat_arrays([blank, pa.array(c, pa.int64())]),
            ], ["doc_id", "t", "f", "n", "bits", "tok", "c"])

    return stored(texts.mapInArrow(named, "doc_id long, t long, f long, n long, bits binary, tok long, c long"))


def _frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Recurring shingles, and their rank by frequency."""
    sums = counted.groupBy("tok").agg(F.sum("c").alias("c"))
    top = sums.orderBy(F.col("c").desc(), "tok").limit(MAX_FREQUENT).toPandas()
    tokens = top["tok"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    rank = np.arange(len(tokens), 0, -1)  # least frequent first
    return tokens[order], rank[order]


def _prefixes(texts: DataFrame, frequent: np.ndarray, place: np.ndarray, names: bool) -> DataFrame:
    """(tok, f, n, i) of all prefix shingles, or only (tok, c) counted per batch."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            tok, f, n, size = [], [], [], []
            for _, tokens in sets_of(batch.column("text")):
                if len(tokens) and (name := fingerprint(tokens)) not in seen:
                    seen.add(name)
                    tok.append(prefix_order(tokens, frequent, place))
                    f.append(name)
                    n.append(len(tokens))
                    size.append(len(tok[-1]))
            if not tok:
                continue
            every = np.concatenate(tok).view(np.int64)
            if names:
                at = np.arange(len(every)) - np.repeat(np.cumsum(size) - size, size)
                yield arrow_rows(tok=every, f=np.repeat(np.array(f, np.int64), size), n=np.repeat(np.array(n, np.int32), size), i=at.astype(np.int32))
            else:
                values, c = np.unique(every, return_counts=True)
                yield arrow_rows(tok=values, c=c)

    return texts.select("text").mapInArrow(listed, "tok long, f long, n int, i int" if names else "tok long, c long")


def _possible(nx, ix, ny, iy):
    """May sets of these sizes link whose first common shingle has these positions in their orders?

    Every linking pair passes in the list of its first common shingle, which is in both prefixes.
    """
    return (4 * F.least(nx, ny) >= 3 * F.greatest(nx, ny)) & (7 * F.least(nx - ix, ny - iy) >= 3 * (nx + ny))


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(x, y, nx, ny, least): the bit maps' lower bound of the symmetric difference of each pair."""
    bits = classes.select("f", "n", "bits")
    both = pairs.join(bits.select(F.col("f").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("bx")), "x").join(
        bits.select(F.col("f").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("by")), "y"
    )

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [least_difference(a, b) for a, b in zip(batch.column("bx").to_pylist(), batch.column("by").to_pylist(), strict=True)]
            yield arrow_rows(**{c: batch.column(c) for c in ("x", "y", "nx", "ny")}, least=np.array(least, np.int64))

    return both.select("x", "y", "nx", "ny", "bx", "by").mapInArrow(bound, "x long, y long, nx long, ny long, least long")


def _tokens(named: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(f, tokens) of the named classes."""
    owners = classes.join(named, "f", "left_semi").select("f", "_doc")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("f").to_pylist()
            rows = [(wanted[row], own.tobytes()) for row, own in sets_of(batch.column("text")) if len(own) and fingerprint(own) == wanted[row]]
            yield arrow_rows(f=pa.array([r[0] for r in rows], pa.int64()), tokens=pa.array([r[1] for r in rows], pa.binary()))

    held = texts.withColumn("_doc", F.coalesce("doc_id", F.lit(-1))).join(owners, "_doc").select("f", "text").mapInArrow(tokens, "f long, tokens binary")
    return stored(held.groupBy("f").agg(F.min("tokens").alias("tokens")))


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(x, y, common, nx, ny) of the pairs (x, y) whose exact similarity links them; `held` has their tokens."""
    both = pairs.join(held.select(F.col("f").alias("x"), F.col("tokens").alias("tx")), "x").join(
        held.select(F.col("f").alias("y"), F.col("tokens").alias("ty")), "y"
    )

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, nx, ny = [], [], []
            for a, b in zip(batch.column("tx"), batch.column("ty"), strict=True):
                p, q = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common.append(int((q[at] == p).sum()))
                nx.append(len(p))
                ny.append(len(q))
            rows = arrow_rows(x=batch.column("x"), y=batch.column("y"), common=np.array(common, np.int64), nx=np.array(nx, np.int64), ny=np.array(ny, np.int64))
            link = np.array([100 * c >= 75 * (p + q - c) for c, p, q in zip(common, nx, ny, strict=True)], bool)
            yield rows.filter(pa.array(link))

    return both.select("x", "y", "tx", "ty").mapInArrow(judged, "x long, y long, common long, nx long, ny long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("f")).union(pairs.select("y")).distinct()


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))


def _crowded_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the lists whose largest component, `home`, has `CROWD` members or more."""
    linked = lists.join(roots.withColumnRenamed("node", "f"), "f")
    sizes = linked.groupBy("tok", "root").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= CROWD)
    homes = sizes.groupBy("tok").agg(F.max(F.struct("m", "root")).alias("h")).select("tok", F.col("h.root").alias("home"))
    return stored(_rooted(lists.join(homes, "tok"), roots))


def _asked(members: DataFrame, turn: int) -> DataFrame:
    """(x, y): each member outside its list's largest component with a few members of it, others in each list and turn.

    The largest component of a list is dealt to buckets by hash; a bucket's smallest hash answers for it.
    """
    buckets, salt = F.ceil(F.col("c") / BUCKET_ROWS), F.lit(turn)
    inside = members.filter(F.col("root") == F.col("home")).withColumn("bucket", F.pmod(F.xxhash64("f", salt), buckets))
    answering = inside.groupBy("tok", "bucket").agg(F.min(F.struct(F.xxhash64("f", "tok", salt).alias("h"), "f", "n", "i")).alias("p"))
    draws = F.array(*[F.pmod(F.xxhash64("f", "tok", salt, F.lit(k)), buckets) for k in range(PARTNERS)])
    outside = members.filter(F.col("root") != F.col("home")).withColumn("bucket", F.explode(F.array_distinct(draws)))
    met = outside.join(answering, ["tok", "bucket"]).filter(_possible(F.col("n"), F.col("i"), F.col("p.n"), F.col("p.i")))
    return met.select(F.least("f", "p.f").alias("x"), F.greatest("f", "p.f").alias("y")).distinct()


def _joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links; only the components that they join are walked."""
    ends = links.select(F.col("x").alias("f")).union(links.select("y")).distinct()
    known = roots.unionByName(ends.select(F.col("f").alias("node"), F.col("f").alias("root")).join(roots, "node", "left_anti"))
    of = lambda name: known.select(F.col("node").alias(name), F.col("root").alias(f"r{name}"))
    edges = links.join(of("x"), "x").join(of("y"), "y").filter("rx <> ry").select(F.col("rx").alias("a"), F.col("ry").alias("b"))
    moved = components(edges).select(F.col("node").alias("root"), F.col("root").alias("moved"))
    return stored(known.join(moved, "root", "left").select("node", F.coalesce("moved", "root").alias("root")))


def _distance(inter, nx, ny):
    return 1 - inter / (nx + ny - inter)


def class_links(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): rows (doc_id, t, f, n); links (x, y, common, nx, ny) between classes.

    The links are all verified and connect every pair of similar classes, directly or through others.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    read = _read(texts)
    rows = read.filter("t is not null").select("doc_id", "t", "f", "n", "bits")
    classes = stored(rows.filter(F.col("f").isNotNull()).groupBy("f").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("_doc"), F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("bits").alias("bits")))
    frequent, place = _frequent(read.filter("t is null").select("tok", "c"))
    shared = _prefixes(texts, frequent, place, False).groupBy("tok").agg(F.sum("c").alias("c")).filter(F.col("c") > 1)
    shared = stored(shared.select("tok"))  # a table, so that Spark can split a hot shingle's rows in the join
    lists = stored(_prefixes(texts, frequent, place, True).join(shared, "tok", "left_semi").distinct())

    pivots = stored(lists.groupBy("tok").agg(F.min(F.struct("f", "n", "i")).alias("p"), F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1))
    met = lists.join(pivots, "tok").filter(
        (F.col("f") != F.col("p.f")) & _possible(F.col("n"), F.col("i"), F.col("p.n"), F.col("p.i"))
    )
    first = met.select(F.col("f").alias("x"), F.col("p.f").alias("y")).distinct()
    bounds = stored(_bounded(first, classes))
    near = bounds.filter(7 * F.col("least") <= F.col("nx") + F.col("ny")).select("x", "y")
    links = stored(_verified(near, _tokens(_ends(near), texts, classes)), wide=True)
    roots = stored(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))))

    # Members that did not link to their list's pivot ask others of its largest component, in a few turns: most
    # members at the edge of a family link to some of it, and then need no pair with the rest. What the turns leave is compared below.
    members = _crowded_lists(lists, roots).join(pivots.select("tok", "c"), "tok")
    later, tested = [], bounds.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    for turn in range(TURNS):
        asked = stored(_asked(members, turn).join(tested, ["x", "y"], "left_anti"))
        tested = tested.unionByName(asked)
        likely = stored(_bounded(asked, classes).filter(7 * F.col("least") <= F.col("nx") + F.col("ny")).select("x", "y"))
        if likely.isEmpty():
            break
        later.append(stored(_verified(likely, _tokens(_ends(likely), texts, classes)), wide=True))
        if later[-1].isEmpty():
            break
        roots = _joined_roots(roots, later[-1])
        members = _crowded_lists(members.drop("root", "home"), roots)

    # What is left of each list: members of different components, the pivot apart, with a lower bound of
    # their distance to the pivot and, for linked ones, the distance itself.
    least = (F.col("nx") + F.col("ny") - F.col("least")) / 2
    far = bounds.select("x", "y", _distance(least, F.col("nx"), F.col("ny")).alias("low"))
    known = links.select("x", "y", _distance(F.col("common"), F.col("nx"), F.col("ny")).alias("high"))
    seen = stored(far.join(known, ["x", "y"], "left"))
    member = lists.join(pivots.select("tok", F.col("p.f").alias("y"), "c"), "tok").filter(F.col("f") != F.col("y"))
    member = _rooted(member, roots).join(seen.withColumnRenamed("x", "f"), ["f", "y"], "left")
    member = member.select(
        "tok", "c", "f", "n", "i", "root",
        F.coalesce("high", "low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high"),
    )
    open_lists = member.groupBy("tok").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter(F.col("_a") != F.col("_b"))
    member = member.join(open_lists.select("tok"), "tok", "left_semi")
    place_block = F.floor(F.log2(F.col("i") + 1.0)).cast("int")
    salt = F.pmod(F.xxhash64("f"), F.ceil(F.col("c") / BLOCK_ROWS))
    blocks = stored(member.groupBy("tok", place_block.alias("at"), salt.alias("salt")).agg(
        F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.max(F.col("n") - F.col("i")).alias("rest"),
        F.min("root").alias("root_min"), F.max("root").alias("root_max"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sort_array(F.collect_list(F.struct("f", "n", "i", "root", "low", "high"))).alias("rows"),
    ))
    left = blocks.select("tok", *[F.col(c).alias(f"l_{c}") for c in blocks.columns if c != "tok"])
    block_pairs = left.join(blocks, "tok").filter(
        (F.struct("l_at", "l_salt") <= F.struct("at", "salt"))
        & (4 * F.col("l_n_max") >= 3 * F.col("n_min")) & (4 * F.col("n_max") >= 3 * F.col("l_n_min"))
        & (7 * F.least("l_rest", "rest") >= 3 * (F.col("l_n_min") + F.col("n_min")))
        & ~((F.col("l_root_min") == F.col("root_max")) & (F.col("l_root_max") == F.col("root_min")))
    )

    def open_pair(p, q):
        derived = F.greatest(p["low"] - q["high"], q["low"] - p["high"])
        return (p["root"] != q["root"]) & _possible(p["n"], p["i"], q["n"], q["i"]) & (derived <= 0.25 + 1e-9)

    def named(p, q):
        return F.struct(F.least(p["f"], q["f"]).alias("x"), F.greatest(p["f"], q["f"]).alias("y"))

    met_in = F.transform("l_rows", lambda p: F.transform(F.filter("rows", lambda q: open_pair(p, q)), lambda q: named(p, q)))
    other = block_pairs.select(F.explode_outer(F.flatten(met_in)).alias("e")).select("e.*").filter(F.col("x").isNotNull()).distinct()
    last = stored(_bounded(other, classes).filter(7 * F.col("least") <= F.col("nx") + F.col("ny")).select("x", "y"))
    for more in (*later, stored(_verified(last, _tokens(_ends(last), texts, classes)), wide=True)):
        links = links.unionByName(more)
    return rows, classes, links


def rooted(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, own): rows (doc_id, t, f, n) and, per class, (f, least, root): its smallest id and its component."""
    rows, classes, links = class_links(documents)
    roots = stored(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    own = classes.join(roots.withColumnRenamed("node", "f"), "f", "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    return rows, own


def similar_components(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows, own = rooted(documents)
    named = own.groupBy("root").agg(F.min("least").alias("component_id"))
    of = own.select("f", "root").join(named, "root").select("f", "component_id")
    found = rows.join(of, "f", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_per_component(documents: DataFrame) -> DataFrame:
    """One document of each component, all columns kept: smallest id first (null last), then the text's hash.

    Of repeated rows one stays; documents without words all stay.
    """
    rows, own = rooted(documents)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(-1)).alias("_k"), F.col("t").alias("_t"))
    first = rows.join(own.select("f", "root"), "f").groupBy("root").agg(F.min(order).alias("o"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = documents.select(
        F.struct(*documents.columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_k"),
        F.xxhash64(text).alias("_t"), text.rlike(r"[^\x20\x09-\x0D]").alias("_worded"),
    )
    again = F.row_number().over(W.partitionBy("_k", "_t").orderBy(F.lit(0)))
    found = keyed.filter("_worded").join(first.select("o._k", "o._t"), ["_k", "_t"], "left_semi").withColumn("_n", again).filter("_n = 1")
    # Blank texts are told apart by nothing and all stay, so they meet in no window.
    return found.select("_row.*").unionByName(keyed.filter(~F.col("_worded")).select("_row.*"))
