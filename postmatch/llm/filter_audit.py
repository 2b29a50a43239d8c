"""Audit of how document filters interact in every order of application.

Each text is read once and gives a mask of the filters that it fails (`failures`); documents are then only
counts per (part, mask). For a mask, the documents leave at step k of an order exactly if the order begins with
k - 1 filters that they pass and goes on with one that they fail. The orders with a given beginning of k
filters are a run of (n - k)! neighbours in lexicographic order, which starts at the Lehmer rank of the
beginning. So a mask adds its count to an array of differences at both ends of each such run (`steps_of`),
and one prefix sum over the ranks gives the documents removed for every order and step (`audit`): no order is
ever replayed over documents.

The filters of `failures`: A under 200 words; B fewer than half of the words distinct; C over 3 % of the code
points in [A-Z]; D one of #$%&*|; E same text as a document of smaller id. Words are runs of other bytes than
ASCII white space.

Defined cases: a null text is empty; an empty text fails A alone (and E, where a smaller id has an empty
text); a null lang is the part named ''; a null id is neither smaller nor larger than another, so it never
fails E; repeated rows of one id fail E only by a smaller id; a document with several label rows is good
(toxic) if one of them says so, without a row it is neither; an empty table has no parts and gives no rows.
Texts of any length are read in blocks; of a long text only a hash of 8 bytes for each distinct word of a
block is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmatch.llm.common import arrow_rows, utf8

FILTERS = "ABCDE"
LEAST_WORDS = 200
BLOCK = 4 << 20
UPPER = bytes(range(65, 91))
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#$%&*|"
SPACES = b" \t\n\x0b\x0c\r"


def _whole_words(text: memoryview) -> Iterator[bytes]:
    """The text in blocks that end where a word ends."""
    rest = b""
    for at in range(0, len(text), BLOCK):
        block = rest + bytes(text[at : at + BLOCK])
        end = len(block) if at + BLOCK >= len(text) else max(block.rfind(bytes([c])) for c in SPACES) + 1
        rest = block[end:]
        yield block[:end]


def judge(text: memoryview) -> tuple[int, bytes]:
    """Mask of the filters A to D that a text fails, and its digest."""
    digest = hashlib.sha256(text)
    words = upper = points = 0
    symbol = False
    kinds = []
    for block in _whole_words(text):
        found = block.split()
        words += len(found)
        kinds.append(set(found))
        if len(text) > BLOCK:
            kinds[-1] = np.fromiter(map(hash, kinds[-1]), np.int64, len(kinds[-1]))
        upper += len(block) - len(block.translate(None, UPPER))
        points += len(block.translate(None, CONTINUATION))
        symbol = symbol or len(block.translate(None, SYMBOLS)) < len(block)
    distinct = len(kinds[0]) if len(kinds) == 1 else len(np.unique(np.concatenate(kinds))) if kinds else 0
    failed = (words < LEAST_WORDS, 100 * distinct < 50 * words, 100 * upper > 3 * points, symbol)
    return sum(bit << i for i, bit in enumerate(failed)), digest.digest()


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, starts = utf8(batch.column("text"))
        view = memoryview(np.ascontiguousarray(raw))
        rows = [judge(view[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        yield arrow_rows(
            doc_id=batch.column("doc_id"), part=batch.column("part"), mask=pa.array([m for m, _ in rows], pa.int32()), digest=pa.array([d for _, d in rows], pa.binary()),
        )


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): how many documents of a part fail exactly the filters of the mask.

    Copies are counted per (text, part, labels) before they meet by text, so a text that a third of the table
    shares is a few rows by then.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text"))
    judged = texts.mapInArrow(_judged, "doc_id long, part string, mask int, digest binary")
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
    )
    labelled = judged.join(marked, "doc_id", "left").fillna(0, ["good", "toxic"])
    kinds = ["digest", "part", "mask", "good", "toxic"]
    ids = labelled.groupBy(*kinds, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    smallest = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = ids.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"), smallest.alias("first"))
    first = F.min("first.doc_id").over(W.partitionBy("digest"))
    firsts = F.when(F.col("first.doc_id") == first, F.col("first.n")).otherwise(0)
    split = groups.withColumn("passing", firsts + F.col("free"))
    copy = F.lit(1 << FILTERS.index("E"))
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct(F.col("mask").bitwiseOR(copy).alias("mask"), (F.col("n") - F.col("passing")).alias("n"))))
    cells = split.select("part", "good", "toxic", both.alias("c")).filter("c.n > 0")
    times = lambda name: F.sum(F.col("c.n") * F.col(name)).alias(name)
    return cells.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("docs"), times("good"), times("toxic"))


def steps_of(mask: int, n: int) -> Iterator[tuple[int, int, int]]:
    """(step, first rank, rank behind the last) of every run of orders that remove the mask's documents at that step."""
    for step in range(1, n + 1):
        passed = [f for f in range(n) if not mask >> f & 1]
        for before in permutations(passed, step - 1):
            for last in (f for f in range(n) if mask >> f & 1):
                begun = (*before, last)
                rank = sum(sum(1 for f in range(at_f) if f not in begun[:at]) * factorial(n - 1 - at) for at, at_f in enumerate(begun))
                yield step, rank, rank + factorial(n - step)


def audit(cells: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, docs, good, toxic); bit i of a mask is filter i.

    Work and rows depend on the number of parts alone. The tables of runs and orders are constants of the number
    of filters, which must be in ascending order.
    """
    spark, n = cells.sparkSession, len(filters)
    counted = ["docs", "good", "toxic"]
    runs = [(mask, *run) for mask in range(1, 1 << n) for run in steps_of(mask, n)]
    runs = F.broadcast(spark.createDataFrame(runs, "mask int, step int, begin int, behind int"))
    orders = F.broadcast(spark.createDataFrame([(i, "".join(p)) for i, p in enumerate(permutations(filters))], "rank int, filter_order string"))

    ends = F.explode(F.array(F.struct(F.col("begin").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("behind").alias("rank"), F.lit(-1).alias("sign"))))
    signed = cells.join(runs, "mask").select("part", "step", *counted, ends.alias("e"))
    differences = signed.groupBy("part", "step", F.col("e.rank").alias("rank")).agg(*[F.sum(F.col(c) * F.col("e.sign")).alias(c) for c in counted])
    parts = cells.groupBy("part").agg(F.sum("docs").alias("total"))
    grid = parts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))))
    along = W.partitionBy("part", "step").orderBy("rank")
    filled = grid.join(differences, ["part", "step", "rank"], "left").fillna(0, counted)
    removed = filled.select("part", "total", "step", "rank", *[F.sum(c).over(along).alias(c) for c in counted])

    named = removed.join(orders, "rank").withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    bit = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    failing = F.explode(F.array_compact(F.array(*[F.when(bit(i), F.struct(F.lit(f).alias("letter"), (F.col("mask") == 1 << i).alias("only"))) for i, f in enumerate(filters)])))
    alone: Column = F.sum(F.when(F.col("f.only"), F.col("docs")).otherwise(0))
    fails = cells.select("part", "docs", failing.alias("f")).groupBy("part", F.col("f.letter").alias("letter")).agg(F.sum("docs").alias("fails"), alone.alias("unique_fails"))
    whole = named.join(fails, ["part", "letter"], "left").fillna(0, ["fails", "unique_fails"])
    return whole.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("docs").over(W.partitionBy("part", "rank").orderBy("step"))).alias("kept"),
        F.col("docs").alias("removed"),
        (F.col("fails") - F.col("docs")).alias("redundant"),
        "unique_fails",
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("docs").over(W.partitionBy("part", "letter")).alias("shapley"),
    )


#: The same counts by replaying every order over the masks.
SQL = r"""
with recursive d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
l as (select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as toxic from labels group by 1),
m as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         (case when len(w) < 200 then 'A' else '' end)
         || (case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end)
         || (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end)
         || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end)
         || (case when d.doc_id > min(d.doc_id) over (partition by t) then 'E' else '' end) as fails
  from d left join l on d.doc_id = l.doc_id),
cells as (select part, fails, count(*) as docs, sum(good) as good, sum(toxic) as toxic from m group by 1, 2),
orders(o) as (
  select '' union all
  select o || f from orders, (values ('A'), ('B'), ('C'), ('D'), ('E')) v(f) where length(o) < 5 and not contains(o, f)),
steps as (select o, unnest(range(1, 6)) as step from orders where length(o) = 5),
removed as (
  select c.part, o as filter_order, cast(step as int) as step, substr(o, step, 1) as letter, sum(docs) as total,
         coalesce(sum(docs) filter (where translate(fails, substr(o, 1, step - 1), '') = fails and contains(fails, substr(o, step, 1))), 0) as removed,
         coalesce(sum(docs) filter (where contains(fails, substr(o, step, 1))), 0) as failing,
         coalesce(sum(docs) filter (where fails = substr(o, step, 1)), 0) as alone,
         coalesce(sum(good) filter (where translate(fails, substr(o, 1, step - 1), '') = fails and contains(fails, substr(o, step, 1))), 0) as good,
         coalesce(sum(toxic) filter (where translate(fails, substr(o, 1, step - 1), '') = fails and contains(fails, substr(o, step, 1))), 0) as toxic
  from cells c, steps group by all)
select part, filter_order, step,
       cast(total - sum(removed) over (partition by part, filter_order order by step) as bigint) as kept,
       cast(removed as bigint) as removed, cast(failing - removed as bigint) as redundant, cast(alone as bigint) as unique_fails,
       cast(good as bigint) as good_lost, cast(toxic as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from removed
"""
