"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (one to three letters, words padded by a boundary) of a
language; a document takes the language whose profile is nearest by out-of-place distance: the sum over
its own most frequent n-grams of the difference in rank, or the largest difference where the profile
lacks the n-gram.

Defined cases: a null text or one without a letter gives `und` and score 0, as does every text while no
language was learned; ties go to the first language in code point order; rows with null lang teach
nothing; every input row gives one output row, null ids included (their id text counts as empty).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmatch.llm.common import arrow_rows, fold_of, scramble
from postmatch.operators.keyed import top_per_key

PROFILE = 300
#: Expected number of training documents per language; they are drawn by a hash of the id.
SAMPLE_PER_LANGUAGE = 2000
MAX_LANGUAGES = 10_000
CHUNK_CHARS = 1 << 20
GRAM_BITS = np.uint64(24)
GRAM_MASK = np.uint64((1 << 24) - 1)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    held, size, first = [], 0, 0
    for n, text in enumerate(texts):
        held.append(" " + (text or "").lower() + " ")
        size += len(held[-1])
        if size >= CHUNK_CHARS:
            yield first, held
            held, size, first = [], 0, n + 1
    if held:
        yield first, held


def ranked_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document number, n-gram code, rank, count) of all n-grams, most frequent first within a document.

    Texts come with a blank at both ends. Counts beyond 2**24 - 1 tie; ties rank by n-gram code.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True
    at = np.flatnonzero(keep)
    symbol = np.where(letter[at], codes[at], 0).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)[at]
    second, third = symbol * np.uint64(0x10FFFF1), symbol * np.uint64(0x100000001B3)
    grams = []
    one = symbol != 0
    grams.append((doc[one] << GRAM_BITS) | (scramble(symbol[one] + np.uint64(1 << 60)) >> np.uint64(40)))
    if len(symbol) > 1:
        pair = doc[:-1] == doc[1:]
        two = scramble(symbol[:-1] + second[1:] + np.uint64(2 << 60)) >> np.uint64(40)
        grams.append(((doc[:-1] << GRAM_BITS) | two)[pair])
    if len(symbol) > 2:
        same = (doc[:-2] == doc[2:]) & one[1:-1]
        three = scramble(symbol[:-2] + second[1:-1] + third[2:] + np.uint64(3 << 60)) >> np.uint64(40)
        grams.append(((doc[:-2] << GRAM_BITS) | three)[same])
    keys = np.sort(np.concatenate(grams))
    if not len(keys):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    below = np.uint64((1 << 24) - 1) - np.minimum(counts, (1 << 24) - 1).astype(np.uint64)
    number = keys >> GRAM_BITS
    order = np.argsort((number << np.uint64(48)) | (below << GRAM_BITS) | (keys & GRAM_MASK), kind="stable")
    number = number[order].astype(np.int64)
    begin = np.searchsorted(number, np.arange(len(texts)))
    return number, (keys & GRAM_MASK)[order], np.arange(len(number)) - begin[number], counts[order]


def profiles(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, top: int = PROFILE) -> dict[str, dict[int, int]]:
    """Rank of each profile n-gram by language, from (doc_id, text, lang) rows.

    About `sample` documents of each language are drawn by a hash of their ids (all, if fewer). What
    comes to the driver is one count per language and `top` n-grams per language.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = usable.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    if not sizes:
        return {}
    shares = usable.sparkSession.createDataFrame([(r["lang"], sample / r["count"]) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit("profile"), "doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    drawn = usable.join(F.broadcast(shares), "lang").filter(draw < F.col("share")).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = batch.column("lang").to_pylist()
            names = sorted(set(languages))
            codes = np.array([names.index(x) for x in languages])
            for first, texts in _chunks(batch.column("text").to_pylist()):
                doc, gram, _, count = ranked_grams(texts)
                key = (codes[first : first + len(texts)][doc].astype(np.uint64) << GRAM_BITS) | gram
                key, place = np.unique(key, return_inverse=True)
                total = np.bincount(place, weights=count, minlength=len(key)).astype(np.int64)
                yield arrow_rows(
                    lang=[names[i] for i in (key >> GRAM_BITS).astype(np.int64)],
                    gram=(key & GRAM_MASK).astype(np.int64), n=total,
                )

    sums = drawn.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = top_per_key(sums, ["lang"], [F.col("n").desc(), F.col("gram")], top)
    found: dict[str, dict[int, int]] = {}
    for row in ranked.collect():
        found.setdefault(row["lang"], {})[row["gram"]] = row["_rank"] - 1
    return found


def nearest_language(texts: list[str | None], known: dict[str, dict[int, int]], top: int = PROFILE) -> tuple[list[str], np.ndarray]:
    """Language and score (1 at distance 0, 0 at the largest distance) of each text."""
    names = sorted(known)
    vocabulary = np.array(sorted({g for ranks in known.values() for g in ranks}), np.uint64)
    places = np.full((len(names), len(vocabulary) + 1), -1, np.int64)
    for row, name in enumerate(names):
        codes = np.fromiter(known[name], np.uint64, len(known[name]))
        places[row, np.searchsorted(vocabulary, codes)] = list(known[name].values())
    labels, scores = [], []
    for _, chunk in _chunks(texts):
        doc, gram, rank, _ = ranked_grams(chunk)
        used = rank < top
        doc, gram, rank = doc[used], gram[used], rank[used]
        n = np.bincount(doc, minlength=len(chunk))
        column = np.full(len(gram), len(vocabulary))
        if len(vocabulary):
            near = np.minimum(np.searchsorted(vocabulary, gram), len(vocabulary) - 1)
            column = np.where(vocabulary[near] == gram, near, column)
        distance = np.empty((len(names), len(chunk)))
        for row in range(len(names)):
            place = places[row, column]
            step = np.where(place < 0, top, np.abs(place - rank))
            distance[row] = np.bincount(doc, weights=step, minlength=len(chunk))
        best = distance.argmin(axis=0) if names else np.zeros(len(chunk), int)
        for i in range(len(chunk)):
            known_text = names and n[i]
            labels.append(names[best[i]] if known_text else "und")
            scores.append(1 - distance[best[i], i] / (n[i] * top) if known_text else 0.0)
    return labels, np.clip(np.array(scores, float), 0, 1)


def identify(documents: DataFrame, known: dict[str, dict[int, int]]) -> DataFrame:
    """(doc_id, lang_pred, score) of every row. The profiles are a few hundred n-grams per language."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = nearest_language(batch.column("text").to_pylist(), known)
            yield arrow_rows(doc_id=batch.column("doc_id"), lang_pred=pa.array(labels, pa.string()), score=pa.array(scores, pa.float64()))

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def languages(documents: DataFrame) -> DataFrame:
    """Learns from rows outside the held-out fold and predicts every row."""
    taught = documents.filter(fold_of(F.col("doc_id")) != 0).select("doc_id", "text", "lang")
    found = identify(documents, profiles(taught))
    return found.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
