"""Spelling variants: words one inserted, deleted or replaced code point apart, by pairs of trie nodes.

A word with one code point skipped is a prefix and a suffix. Prefixes are nodes of the trie of all words,
suffixes are nodes of the trie of all reversed words, and each trie's nodes are numbered, so that a skipped
word is a pair of integers. Two words are one replacement apart if they share a skipped pair of one position;
one deletion apart if a skipped pair of the longer is a gap (two adjoining nodes) of the shorter. All words
that meet at a pair are therefore near each other: at most one per letter and one with the gap. They are
counted and their most frequent is taken per pair; no pairs of words are made.

Tries are numbered without holding one: words are sorted in ranges (`PART_WORDS` each, dealt by Spark), a word
shares with its predecessor the nodes of their common prefix and numbers the rest. Only the nodes on the way
to the ends of a range can come from an earlier range; the driver hands those on, from two words per range.
Numbers are exact, no hashes are compared.

`word_counts` makes the table of words from texts: maximal runs of [A-Za-z] and U+00C0 to U+00FF, A-Z
lower-cased, and one code point deleted from the runs of a document whose crc32 says so. `variants` takes any
table of distinct words and counts.

Defined cases: null and empty texts have no words; a null id counts as an empty one; repeated rows count
again; words under `SHORTEST` code points or `SELDOM` occurrences are no words; of near words with equal
counts the smaller in code-point order is the form; a deletion inside a run of equal letters is one
neighbour, though it can be made at several places; an empty table gives no rows. Texts are read in blocks;
a word may be of any length, its nodes are held as one list.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmatch.llm.common import arrow_rows, stored

SHORTEST = 5
SELDOM = 3
RATIO = 2
EVERY = 97
PART_WORDS = 100_000
BLOCK = 1 << 20
#: Distinct words held by a task before they go on as rows.
HELD = 200_000
#: Numbers of a range of sorted words, and where those of the way to its last word begin.
STRIDE, LAST_WAY = 1 << 42, 1 << 41
SKIP, FIRST_SKIP, GAP = 0, 1, 2

#: Latin-1 bytes: A-Z to a-z, letters as they are, the rest to blanks.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_in(text: str) -> Iterator[list[bytes]]:
    """The runs of a text as Latin-1 bytes, in blocks that end between runs."""
    coded = text.encode("latin-1", "replace").translate(_LETTERS)
    at = 0
    while at < len(coded):
        end = at + BLOCK
        if end < len(coded):
            end = coded.rfind(b" ", at, end) + 1 or coded.find(b" ", end) + 1 or len(coded)
        yield coded[at:end].split()
        at = end


def spelled(run: bytes, seed: int) -> bytes:
    """The run, or what is left of it where its crc32 (`seed`: of what stands before it) asks for a deletion."""
    drawn = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if drawn % EVERY:
        return run
    at = drawn % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}

    def rows() -> pa.RecordBatch:
        return arrow_rows(word=pa.array([w.decode("latin-1") for w in held], pa.string()), n=pa.array(list(held.values()), pa.int64()))

    for batch in batches:
        for number, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            text = batch.column("text")[number].as_py()
            seed = zlib.crc32(f"{doc_id}:".encode())
            for runs in runs_in(text or ""):
                for run, n in Counter(runs).items():
                    if len(run) >= SHORTEST:
                        word = spelled(run, seed)
                        held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield rows()
                held.clear()
    yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    parts = texts.mapInArrow(_counted, "word string, n long")
    return parts.filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= SELDOM)


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def ways(ends: list[tuple[int, str, str]]) -> dict[int, tuple[str, list[int], str]]:
    """For each range: its first word, the numbers that earlier ranges gave to beginnings of it, its last word."""
    out = {}
    before, way = "", [0]
    for part, first, last in ends:
        known = way[: shared(before, first) + 1]
        out[part] = (first, known, last)
        kept = known[: shared(first, last) + 1]
        before, way = last, kept + [part * STRIDE + LAST_WAY + d for d in range(len(kept), len(last) + 1)]
    return out


class Numbering:
    """Numbers the nodes of sorted words of one range after the other."""

    def __init__(self, known: dict[int, tuple[str, list[int], str]]):
        self.known, self.part = known, None

    def nodes(self, part: int, word: str) -> list[int]:
        if part != self.part:
            self.part, self.next = part, 1
            self.before, self.way, self.last = self.known[part]
        kept = self.way[: shared(self.before, word) + 1]
        if len(kept) <= len(word):
            base, onward = part * STRIDE, shared(word, self.last)
            while len(kept) <= min(onward, len(word)):
                kept.append(base + LAST_WAY + len(kept))
            fresh = len(word) + 1 - len(kept)
            kept.extend(range(base + self.next, base + self.next + fresh))
            self.next += fresh
        self.before, self.way = word, kept
        return kept


def _lists(rows: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array([x for row in rows for x in row], np.int64)))


def _in_ranges(rows: DataFrame, key: str, emit: Callable[[pa.RecordBatch, list[list[int]]], pa.RecordBatch], schema: str) -> DataFrame:
    """`emit` over sorted ranges of the rows, with the trie nodes of their keys. Keys are distinct."""
    parts = rows.count() // PART_WORDS + 1
    cut = stored(rows.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()))
    ends = cut.groupBy("part").agg(F.min(key).alias("a"), F.max(key).alias("b")).orderBy("part").collect()  # two words per range
    known = ways([(r["part"], r["a"], r["b"]) for r in ends])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering = Numbering(known)
        for batch in batches:
            yield emit(batch, [numbering.nodes(p, k) for p, k in zip(batch.column("part").to_pylist(), batch.column(key).to_pylist(), strict=True)])

    return cut.repartition(parts, "part").sortWithinPartitions("part", key).mapInArrow(numbered, schema)


def _with_prefixes(batch: pa.RecordBatch, nodes: list[list[int]]) -> pa.RecordBatch:
    return arrow_rows(rank=batch.column("rank"), word=batch.column("word"), prefixes=_lists(nodes))


def _pairs(batch: pa.RecordBatch, nodes: list[list[int]]) -> pa.RecordBatch:
    """All skipped pairs and gaps of the words."""
    words = batch.column("word").to_pylist()
    long = np.array([len(w) for w in words], np.int64)
    prefixes = batch.column("prefixes").flatten().to_numpy(zero_copy_only=False)
    suffixes = np.array([x for row in nodes for x in row], np.int64)
    starts = np.cumsum(long + 1) - (long + 1)  # of the word's nodes, one more than letters
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    word = np.repeat(np.arange(len(words)), long)
    at = np.arange(len(letters)) - np.repeat(np.cumsum(long) - long, long)
    first = np.ones(len(letters), bool)
    first[1:] = (letters[1:] != letters[:-1]) | (at[1:] == 0)
    word_of_gap = np.repeat(np.arange(len(words)), long + 1)
    gap_at = np.arange(len(prefixes)) - starts[word_of_gap]
    rank = batch.column("rank").to_numpy()
    return arrow_rows(
        prefix=np.concatenate([prefixes[starts[word] + at], prefixes]),
        suffix=np.concatenate([suffixes[starts[word] + long[word] - at - 1], suffixes[starts[word_of_gap] + long[word_of_gap] - gap_at]]),
        tag=np.concatenate([rank[word] * 4 + np.where(first, FIRST_SKIP, SKIP), rank[word_of_gap] * 4 + GAP]),
    )


def neighbours(ranked: DataFrame) -> DataFrame:
    """(rank, n_near, best): for words with near words, their number and the smallest rank among those before the word."""
    forward = _in_ranges(ranked.select("rank", "word"), "word", _with_prefixes, "rank long, word string, prefixes array<long>")
    backward = forward.withColumn("reversed", F.reverse("word"))
    # Few bytes a row, so that the sort below stays in memory: two nodes, and the word's rank with what it does here.
    pairs = _in_ranges(stored(backward), "reversed", _pairs, "prefix long, suffix long, tag long")
    kind, rank = F.pmod("tag", F.lit(4)), F.shiftright("tag", 2)
    here = W.partitionBy("prefix", "suffix")  # at most one word per letter, and one with the gap
    met = pairs.select(
        kind.alias("kind"), rank.alias("rank"), F.count(F.lit(1)).over(here).alias("all"), F.min(rank).over(here).alias("best"),
        F.sum((kind == GAP).cast("int")).over(here).alias("gaps"), F.sum((kind == FIRST_SKIP).cast("int")).over(here).alias("firsts"),
    ).filter(F.col("all") > 1)
    near = F.when(F.col("kind") == GAP, F.col("firsts")).when(F.col("kind") == FIRST_SKIP, F.col("all") - 1).otherwise(F.col("all") - F.col("gaps") - 1)
    return met.groupBy("rank").agg(F.sum(near).alias("n_near"), F.min(F.when(F.col("best") < F.col("rank"), F.col("best"))).alias("best"))


def roots(steps: DataFrame) -> DataFrame:
    """(rank, up): the end of each chain of (rank, up) steps. Counts double along a chain, so a few jumps end it."""
    reached = stored(steps.select("rank", "up", F.lit(True).alias("moved")))
    while True:
        ahead = reached.select(F.col("rank").alias("up"), F.col("up").alias("further"))
        reached = stored(reached.join(ahead, "up", "left").select("rank", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")))
        if reached.filter("moved").isEmpty():
            return reached.select("rank", "up")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words with counts.

    Words are ranked by count, then code points, so the best of several near words is the smallest rank. A form
    must have `ratio` times the count; a near word of rank behind the word cannot, so only those before it are kept.
    """
    ranked = stored(words.select("word", "n").orderBy(F.col("n").desc(), "word").withColumn("rank", F.monotonically_increasing_id()))
    near = neighbours(ranked)
    named = ranked.select(F.col("rank").alias("up"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    linked = ranked.join(near, "rank", "left").withColumnRenamed("best", "up").join(named, "up", "left")
    enough = F.col("form_n") >= ratio * F.col("n")
    linked = stored(linked.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(enough, F.col(c)).alias(c) for c in ("up", "form", "form_n")]))
    ends = roots(linked.filter(F.col("up").isNotNull()).select("rank", "up"))
    last = ends.join(ranked.select(F.col("rank").alias("up"), F.col("word").alias("root")), "up").select("rank", "root")
    whole = linked.join(last, "rank", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Words meet by their text with one letter left out; crc32 is computed by its table.
SQL = """
with recursive tab as (
  select list(c order by i) as crcs
  from (select i, list_reduce(list_prepend(i, range(8)), lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
runs as (
  select doc_id, r, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) as r from documents)
  where length(r) >= 5 group by all),
coded as (
  select r, n, flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || r, ''),
    lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [192 + (unicode(x) >> 6)::bigint, 128 + (unicode(x) & 63)::bigint] end)) as bytes
  from runs),
drawn as (
  select r, n, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295::bigint) as h
  from coded, tab),
spelled as (
  select case when h % 97 = 0 then substr(r, 1, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) else r end as word, n from drawn),
words as (select word, cast(sum(n) as bigint) as n from spelled where length(word) >= 5 group by word having sum(n) >= 3),
skips as (select word, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, unnest(range(length(word))) as i from words)),
near as (
  select a.word, b.word as other from skips a join skips b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select s.word, w.word from skips s join words w on s.rest = w.word
  union select w.word, s.word from skips s join words w on s.rest = w.word),
best as (
  select e.word, count(*) as n_near, arg_min(o.word, (-o.n, o.word)) as other, max(o.n) as other_n
  from near e join words o on o.word = e.other group by e.word),
formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * w.n then other end as form, case when other_n >= 2 * w.n then other_n end as form_n
  from words w left join best b on b.word = w.word),
walk as (
  select word, word as at from formed
  union all select walk.word, f.form from walk join formed f on f.word = walk.at where f.form is not null),
ends as (select walk.word, walk.at as root from walk join formed f on f.word = walk.at where f.form is null)
select f.word, form, root, n, n_near, form_n from formed f join ends e on e.word = f.word
"""
