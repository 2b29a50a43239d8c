"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of `LENGTH` bytes that covers it also starts anywhere else, in the same text or
another one. Texts are taken as UTF-8 bytes; strings never cross a text and are judged on the input.

How it runs. Every string of `LENGTH` bytes has an anchor: the `ANCHOR` bytes in it with the smallest hash
(the leftmost, if equal). Equal strings have equal anchors in the same place, so only strings with the same
anchor need to be compared. Neighbouring strings with the same anchor form a segment. Segments whose anchor
occurs once are done. Equal segments are counted and one of each goes on. Anchors with several different
segments are dealt to shards of bounded size; in each, a suffix array is built by Larsson-Sadakane
refinement and Kasai's walk gives common prefixes. An anchor with very many segments is dealt to several
shards, whose sorted strings are merged by binary search.

Defined cases: null is empty; texts shorter than `LENGTH` lose nothing; of repeated rows each loses all its
bytes (from `LENGTH` bytes on), and each gives a row; rows are told apart by id and text, so null or
repeated ids do no harm; other columns are ignored or, in `without_repeats`, kept as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmatch.llm.common import BYTE_CODES, all_span_hashes, arrow_rows, pieces, prefix_sums, span_hash, stored, utf8

LENGTH = 200
ANCHOR = 64
BLOCK = 1 << 20
#: A task holds about 120 bytes per byte of its shard.
SHARD_BYTES = 1 << 20
#: Segments of one anchor in a shard; each has under 2 * LENGTH bytes.
SHARD_SEGMENTS = 3000
#: Shards that are dealt by one running sum of sizes.
TOGETHER = 16
_PLACE = np.uint64(2 * BLOCK - 1)
DEPTH = 7
SPANS = "doc_id long, t long, begin long, until long"


def anchored_segments(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(anchor hash, segment hash, first start, last start) of all segments, as positions in `raw`."""
    begin, end = offsets[:-1], offsets[1:]
    long = end - begin >= length
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, begin[long], 1)
    np.add.at(edge, end[long] - length + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    grams = length - anchor + 1
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(raw) - length + 1, BLOCK):
        sums = prefix_sums(BYTE_CODES[raw[at : at + BLOCK + length - 1]])
        hashes = all_span_hashes(sums, anchor)
        least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while width * 2 <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < grams:
            least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
        place = (least & _PLACE).astype(np.int64)
        ok = valid[at : at + len(place)]
        cut = ~ok[:-1] | ~ok[1:] | (place[1:] != place[:-1])
        first, last = ok.copy(), ok.copy()
        first[1:] &= cut
        last[:-1] &= cut
        low, high = np.flatnonzero(first), np.flatnonzero(last)
        found.append((hashes[place[low]], span_hash(sums, low, high + length), low + at, high + at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def suffix_array(words: np.ndarray, unique: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by Larsson-Sadakane refinement.

    `words` holds the next `DEPTH` symbols of every position, a separator being smaller than any byte and
    than every later separator; positions in `unique` see one. Groups of equal rank are refined by the
    rank `depth` positions on, which doubles the sorted depth; positions alone in their group drop out.
    """
    n = len(words)
    small = np.int32 if n < 2**31 else np.int64
    order = np.argsort(words, kind="stable").astype(small)
    words = words[order]
    opens = np.ones(n, bool)
    opens[1:] = (words[1:] != words[:-1]) | unique[order[1:]] | unique[order[:-1]]
    del words
    rank = np.empty(n, small)
    rank[order] = np.maximum.accumulate(np.where(opens, np.arange(n, dtype=small), small(0)))
    depth = DEPTH
    while True:
        closes = np.append(opens[1:], True)
        slots = np.flatnonzero(~(opens & closes))
        if not len(slots):
            return order, rank
        active = order[slots]
        key = rank[active] * np.int64(n + 1) + rank[np.minimum(active.astype(np.int64) + depth, n - 1)]
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[slots] = active[by]
        opens[slots] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[slots]] = np.maximum.accumulate(np.where(opens[slots], slots, 0))
        depth *= 2


def common_prefixes(words: np.ndarray, order: np.ndarray, rank: np.ndarray, ends: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Kasai's walk: common prefix of each start with its predecessor in the suffix array.

    The starts of one segment are walked in order, so that each begins from its neighbour's length less
    one; all segments take their steps side by side. `ends` is where the text of a position stops.
    Starts are numbered segment after segment.
    """
    lengths = np.zeros(int(count.sum()), np.int64)
    base = np.cumsum(count) - count
    held = np.zeros(len(begin), np.int64)
    for step in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > step)
        at = begin[live] + step
        place = rank[at]
        other = order[np.maximum(place - 1, 0)]
        limit = np.where(place > 0, np.minimum(ends[at] - at, ends[other] - other), 0)
        have = np.minimum(np.maximum(held[live] - 1, 0), limit)
        going = np.flatnonzero(have < limit)
        while len(going):
            differ = words[at[going] + have[going]] ^ words[other[going] + have[going]]
            same = np.full(len(going), 8, np.int64)
            some = differ != 0
            high = np.frexp(differ[some].astype(np.float64))[1]
            high -= (differ[some] >> np.minimum(high - 1, 63).astype(np.uint64)) == 0
            same[some] = (64 - high) // 8
            have[going] = np.minimum(have[going] + same, limit[going])
            going = going[(same == 8) & (have[going] < limit[going])]
        held[live] = have
        lengths[base[live] + step] = have
    return lengths


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all starts of the segments, in order: does its string occur again, and the number of its string.

    Also the count of starts per segment. Equal strings have equal numbers.
    """
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    raw = np.frombuffer(b"\0".join(segments) + b"\0" * 9, np.uint8)
    n = int(sizes.sum()) + len(segments)
    begin = np.cumsum(sizes + 1) - sizes - 1
    ends = np.repeat(begin + sizes, sizes + 1)
    symbols = np.zeros(n, np.uint64)
    left = ends - np.arange(n)
    for k in range(DEPTH):
        symbols |= np.where(left > k, raw[k : k + n].astype(np.uint64) + np.uint64(1), np.uint64(0)) << np.uint64(9 * (DEPTH - 1 - k))
    order, rank = suffix_array(symbols, left < DEPTH)
    del symbols, left
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words |= raw[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    count = np.maximum(sizes - length + 1, 0)
    lengths = common_prefixes(words, order, rank, ends, begin, count)
    starts = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    with_previous = np.zeros(n + 1, bool)
    with_previous[rank[starts]] = lengths >= length
    again = with_previous[rank[starts]] | with_previous[rank[starts] + 1]
    del words, ends, order
    number = np.cumsum(~with_previous[:n])
    return again, number[rank[starts]], count


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def _segments(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """(a, s, doc_id, t, low, high) of every segment of every text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            ids, t = batch.column("doc_id").to_numpy(), batch.column("t").to_numpy()
            for x, y in pieces(offsets, 4 << 20):
                own = offsets[x : y + 1] - offsets[x]
                a, s, low, high = anchored_segments(raw[offsets[x] : offsets[y]], own, length, anchor)
                row = np.searchsorted(own, low, side="right") - 1
                yield arrow_rows(
                    a=a.view(np.int64), s=s.view(np.int64), doc_id=ids[x + row], t=t[x + row], low=low - own[row], high=high - own[row]
                )

    return rows.mapInArrow(cut, "a long, s long, doc_id long, t long, low long, high long")


def _anchor_counts(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for x, y in pieces(offsets, 4 << 20):
                a = anchored_segments(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], length, anchor)[0]
                values, n = np.unique(a, return_counts=True)
                yield arrow_rows(a=values.view(np.int64), n=n)

    found = rows.select("text").mapInArrow(counted, "a long, n long")
    return found.groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") > 1).select("a")


def _shard_spans(table: pa.Table, length: int) -> pa.Table:
    """Spans of one shard, and for anchors in several shards one row per distinct string with its digest."""
    segments = table.column("piece").to_pylist()
    again, number, count = repeated_starts(segments, length)
    n = np.repeat(table.column("n").to_numpy(), count)
    split = np.repeat(table.column("split").to_numpy(zero_copy_only=False), count)
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    ids, t, low = (table.column(c).to_numpy()[row] for c in ("doc_id", "t", "low"))
    hit = again & (n == 1)
    opens = hit & ~np.concatenate([[False], hit[:-1] & (row[1:] == row[:-1])])
    closes = hit & ~np.concatenate([hit[1:] & (row[1:] == row[:-1]), [False]])
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    _, lead = np.unique(np.where(split, number, -1), return_index=True)
    lead = lead[split[lead]]
    digests = [hashlib.blake2b(segments[row[i]][at[i] : at[i] + length], digest_size=16).digest() for i in lead]
    open_yet = (n == 1) & ~again
    return pa.table({
        "doc_id": np.concatenate([ids[first], ids[lead]]), "t": np.concatenate([t[first], t[lead]]),
        "begin": np.concatenate([(low + at)[first], (low + at)[lead]]),
        "until": np.concatenate([(low + at)[last] + length, (low + at)[lead] + length]),
        "digest": pa.array([None] * len(first) + digests, pa.binary()),
        "open": np.concatenate([np.ones(len(first), bool), open_yet[lead]]),
    })


def _merge(table: pa.Table) -> pa.Table:
    """Strings that several shards hold: each is looked up in the sorted list of all by binary search."""
    digests = np.array(table.column("digest").to_pylist(), dtype="S16")
    ordered = np.sort(digests)
    n = np.searchsorted(ordered, digests, side="right") - np.searchsorted(ordered, digests, side="left")
    keep = pa.array((n > 1) & table.column("open").to_numpy(zero_copy_only=False))
    return table.select(["doc_id", "t", "begin", "until"]).filter(keep)


def repeated_spans(documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """SPANS of the bytes to remove; spans of a text may overlap."""
    rows = _keyed(documents)
    # Counts are tables before they are joined: then Spark can split a hot anchor's rows in the join.
    repeated = stored(_anchor_counts(rows, length, anchor))
    segments = stored(_segments(rows, length, anchor).join(repeated, "a", "left_semi"))
    first = F.min(F.struct("doc_id", "t", "low", "high")).alias("at")
    kinds = stored(segments.groupBy("a", "s").agg(F.count(F.lit(1)).alias("n"), first))
    copied = segments.join(kinds.filter(F.col("n") > 1).select("a", "s"), ["a", "s"], "left_semi")
    whole = copied.select("doc_id", "t", F.col("low").alias("begin"), (F.col("high") + length).alias("until"))

    bytes_of = F.col("at.high") - F.col("at.low") + length
    several = stored(kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds"), F.sum(bytes_of).alias("bytes")).filter(F.col("kinds") > 1))
    # Anchors are packed by their sizes: a running sum in each of many groups of anchors is cut into shards.
    size = several.select(F.sum("bytes").alias("n")).first()["n"] or 0
    groups = max(1, math.ceil(size / (TOGETHER * shard_bytes)))
    group = F.pmod(F.xxhash64("a"), F.lit(groups))
    until_here = F.sum("bytes").over(W.partitionBy("group").orderBy("a").rowsBetween(W.unboundedPreceding, W.currentRow))
    packed = several.withColumn("group", group).withColumn("place", F.floor(until_here / F.lit(shard_bytes)))
    packed = stored(packed.select("a", "kinds", F.xxhash64(F.lit("packed"), "group", "place").alias("own")))
    compared = stored(kinds.join(packed, "a").select("a", "s", "n", "kinds", "own", "at.*"))
    parts = F.ceil(F.col("kinds") / shard_segments)
    shard = F.when(parts > 1, F.xxhash64("a", F.pmod(F.col("s"), parts))).otherwise(F.col("own"))
    wanted = compared.select("doc_id", "t", F.struct(shard.alias("shard"), (parts > 1).alias("split"), "n", "low", "high").alias("w"))
    by_text = wanted.groupBy("doc_id", "t").agg(F.collect_list("w").alias("w"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            whole_text = raw.tobytes()
            lists = batch.column("w")
            w, ends = lists.flatten(), np.cumsum(np.diff(lists.offsets.to_numpy()))
            row = np.searchsorted(ends, np.arange(len(w)), side="right")
            begin = offsets[row] + w.field("low").to_numpy()
            until = offsets[row] + w.field("high").to_numpy() + length
            yield arrow_rows(
                shard=w.field("shard"), split=w.field("split"), n=w.field("n"), low=w.field("low"),
                doc_id=batch.column("doc_id").to_numpy()[row], t=batch.column("t").to_numpy()[row],
                piece=pa.array([whole_text[x:y] for x, y in zip(begin.tolist(), until.tolist(), strict=True)], pa.binary()),
            )

    once = rows.join(by_text, ["doc_id", "t"]).select("doc_id", "t", "text", "w")
    cut_schema = "shard long, split boolean, n long, low long, doc_id long, t long, piece binary"
    shards_in = once.mapInArrow(cut, cut_schema)
    judged = stored(
        shards_in.groupBy("shard").applyInArrow(lambda table: _shard_spans(table, length), f"{SPANS}, digest binary, open boolean")
    )
    inside = judged.filter(F.col("digest").isNull()).select("doc_id", "t", "begin", "until")
    strings = judged.filter(F.col("digest").isNotNull())
    buckets = max(1, math.ceil(strings.count() / 500_000))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets))
    across = strings.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_merge, SPANS)
    return whole.unionByName(inside).unionByName(across)


def _joined_spans(documents: DataFrame, **options) -> DataFrame:
    """(_row, _bytes, _spans) of every row: its columns as a struct, its text and the spans to remove."""
    spans = stored(repeated_spans(documents, **options))
    lists = spans.groupBy("doc_id", "t").agg(F.collect_set(F.struct("begin", "until")).alias("_spans"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_k"), F.xxhash64(text).alias("_t"), text.alias("_bytes")]
    rows = documents.select(F.struct(*documents.columns).alias("_row"), *keys)
    return rows.join(lists.withColumnRenamed("doc_id", "_k").withColumnRenamed("t", "_t"), ["_k", "_t"], "left").select("_row", "_bytes", "_spans")


def _kept(value: bytes, spans) -> tuple[bytes, int]:
    """Bytes outside the spans, and the number of maximal removed runs."""
    if not spans:
        return value, 0
    kept, at, runs = [], 0, 0
    reach = -1
    for begin, until in sorted((s["begin"], s["until"]) for s in spans):
        if begin > reach:
            if runs:
                at = reach
            kept.append(value[at:begin])
            runs += 1
            reach = until
        else:
            reach = max(reach, until)
    kept.append(value[reach:])
    return b"".join(kept), runs


def repeat_report(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, runs, digest = [], [], [], []
            raw, offsets = utf8(batch.column("_bytes"))
            data = raw.tobytes()
            for i, spans in enumerate(batch.column("_spans").to_pylist()):
                value = data[offsets[i] : offsets[i + 1]]
                kept, n = _kept(value, spans)
                size.append(len(value))
                removed.append(len(value) - len(kept))
                runs.append(n)
                digest.append(hashlib.sha256(kept).hexdigest())
            yield arrow_rows(
                doc_id=batch.column("_row").field("doc_id"), n_bytes=np.array(size, np.int64), n_removed=np.array(removed, np.int64),
                n_spans=np.array(runs, np.int64), kept_sha256=pa.array(digest, pa.string()),
            )

    rows = _joined_spans(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)
    return rows.mapInArrow(told, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame, **options) -> DataFrame:
    """The documents with `text` less its repeated bytes; what is left of a cut character is dropped too.

    A null text stays null.
    """
    schema, names = documents.schema, documents.columns

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, spans in zip(batch.column("_bytes").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                texts.append(_kept(value.encode(), spans)[0].decode("utf-8", "ignore") if spans else value)
            columns = batch.column("_row").flatten()
            at = names.index("text")
            columns[at] = pc.if_else(columns[at].is_null(), pa.scalar(None, pa.string()), pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return _joined_spans(documents, **options).mapInArrow(replaced, schema)
