"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into probes of `PROBE` bytes that start every `STRIDE` bytes (a shorter item is one
probe), so a word-for-word passage of `PROBE` bytes lacks at most half a stride of some probe, which the
budget covers wherever the passage begins. A document leaks an
item if some region of it is within the edit budget of a probe: a tenth of the probe's bytes. With k edits
at most, a probe of m bytes and its region share m - q + 1 - k q q-grams, all on k + 1 neighbouring
diagonals. So the shared q-grams of each document and item are counted in overlapping bands of 2 (k + 1)
diagonals; in bands that reach the bound, each probe with enough of them inside it is verified by banded
alignment. Nothing within the budget is missed.

Texts are lower-cased, runs of white space count as one blank; edits are bytes of UTF-8.

The benchmark is a parameter: its index is sent to the tasks in blocks of `BLOCK_BYTES`, one pass each.

Defined cases: null and empty texts leak nothing; null items and items of fewer than `Q` bytes are ignored;
probes too short for their budget get a smaller one (the largest for which the lemma holds); repeated
documents each give their rows, repeated items too; an empty benchmark gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmatch.llm.common import MIX, arrow_rows, pieces, utf8

Q = 8
PROBE = 100
STRIDE = 10
BUDGET = 0.1
BLOCK_BYTES = 4 << 20
TABLE_BITS = 22
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FOUND = "item_id long, n_probes int, edits int, begin long"


def normalized(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with single blanks, end to end, and where each text starts."""
    raw, offsets = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    space = _SPACE[raw]
    keep = ~space
    if len(raw):
        keep[1:] |= ~space[:-1]
        keep[0] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return np.where(space, 32, raw)[keep].astype(np.uint8), at[offsets]


def grams_of(raw: np.ndarray) -> np.ndarray:
    """The q bytes from each position on, as one number."""
    n = max(0, len(raw) - Q + 1)
    out = np.empty(n, np.uint64)
    for k in range(min(Q, n)):
        own = out[k::Q]
        own[:] = raw[k : k + len(own) * Q].view(np.uint64)
    return out


def budget_of(size: int, share: float = BUDGET) -> int:
    return max(0, min(int(size * share), (size - Q) // Q))


class Probes:
    """The q-gram index of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = [(item, text) for item, text in items if len(text) >= Q]
        self.probes, self.least = [], []
        self.edits = 0
        for _, text in self.items:
            starts = list(range(0, max(1, len(text) - PROBE + 1), STRIDE))
            if len(text) > PROBE and starts[-1] + PROBE < len(text):
                starts.append(len(text) - PROBE)
            own = [(s, text[s : s + PROBE], budget_of(len(text[s : s + PROBE]))) for s in starts]
            self.probes.append(own)
            self.least.append(min(len(p) - Q + 1 - k * Q for _, p, k in own))
            self.edits = max(self.edits, max(k for _, _, k in own))
        self.width = 2 * (self.edits + 1)
        self.least = np.array(self.least, np.int64)
        # All probes end to end: where each begins in its item, its q-grams' last place and its own bound.
        of = np.array([len(own) for own in self.probes], np.int64)
        self.of, self.first_probe = of, np.cumsum(of) - of
        flat = [(s, s + len(p) - Q, len(p) - Q + 1 - k * Q) for own in self.probes for s, p, k in own]
        self.begin, self.end, self.bound = np.array(flat, np.int64).reshape(-1, 3).T
        size = np.array([max(0, len(t) - Q + 1) for _, t in self.items], np.int64)
        grams = np.concatenate([np.zeros(0, np.uint64), *[grams_of(np.frombuffer(t, np.uint8)) for _, t in self.items]])
        place = np.arange(len(grams)) - np.repeat(np.cumsum(size) - size, size)
        order = np.argsort(grams, kind="stable")
        self.item, self.place = np.repeat(np.arange(len(size)), size)[order], place[order]
        self.grams, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.gap = 2 * (max([len(t) for _, t in self.items], default=0) + self.width)
        self.seen = np.zeros(1 << TABLE_BITS, bool)
        self.seen[self._cell(self.grams)] = True

    @staticmethod
    def _cell(grams: np.ndarray) -> np.ndarray:
        return (grams * MIX) >> np.uint64(64 - TABLE_BITS)

    def bands(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(text, item, first diagonal, probe) of all bands with enough shared q-grams, and of the probes in which enough of them lie."""
        none = np.zeros((0, 4), np.int64)
        grams = grams_of(raw)
        if not len(grams) or not len(self.grams):
            return none
        at = np.flatnonzero(self.seen[self._cell(grams)])
        near = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        exact = self.grams[near] == grams[at]
        at, near = at[exact], near[exact]
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + Q <= offsets[text + 1]
        at, near, text = at[inside], near[inside], text[inside]
        n = self.count[near]
        entry = np.repeat(self.first[near] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        if not len(entry):
            return none
        # A gap between texts keeps the diagonals of one text out of another's bands.
        diagonal = np.repeat(at + (text + 1) * self.gap, n) - self.place[entry]
        item, half, items = self.item[entry], self.width // 2, len(self.items)
        out = []
        place = self.place[entry]
        for shift in (0, half):
            key = (diagonal + shift) // self.width * items + item
            kinds, number, c = np.unique(key, return_inverse=True, return_counts=True)
            enough = np.flatnonzero(c >= self.least[kinds % items])
            if not len(enough):
                continue
            band = np.full(len(kinds), -1)
            band[enough] = np.arange(len(enough))
            inner = band[number] >= 0
            # Of a band that passes, every probe is counted for itself: distinct places of its item that lie inside.
            span = int(place.max()) + 2
            places = np.unique(band[number[inner]] * span + place[inner])
            kinds = kinds[enough]
            probes = self.of[kinds % items]
            here = np.repeat(np.arange(len(kinds)), probes)
            probe = np.arange(len(here)) - np.repeat(np.cumsum(probes) - probes, probes)
            at_probe = np.repeat(self.first_probe[kinds % items], probes) + probe
            held = np.searchsorted(places, here * span + np.minimum(self.end[at_probe], span - 1), side="right") - np.searchsorted(places, here * span + np.minimum(self.begin[at_probe], span - 1))
            fine = held >= self.bound[at_probe]
            kinds, probe = kinds[here[fine]], probe[fine]
            out.append(np.stack([kinds // items * self.width - shift, kinds % items, probe], axis=1))
        if not out:
            return none
        found = np.unique(np.concatenate(out), axis=0)
        shifted = offsets[:-1] + (np.arange(len(offsets) - 1) + 1) * self.gap
        row = np.clip(np.searchsorted(shifted - self.gap // 2, found[:, 0], side="right") - 1, 0, len(shifted) - 1)
        return np.stack([row, found[:, 1], found[:, 0] - (row + 1) * self.gap - offsets[row], found[:, 2]], axis=1)

    def leaks(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, number of probes met, fewest edits, where the first begins) of all leaks of a column."""
        raw, offsets = normalized(column)
        for x, y in pieces(offsets):
            own, part = offsets[x : y + 1] - offsets[x], raw[offsets[x] : offsets[y]]
            found: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
            jobs = []
            for row, item, low, number in self.bands(part, own).tolist():
                start, probe, k = self.probes[item][number]
                jobs.append((row, item, number, low + start - k, probe, k))
            for at in range(0, len(jobs), 2000):
                chunk = jobs[at : at + 2000]
                for job, edits in zip(chunk, self._align(part, own, chunk), strict=True):
                    if edits <= job[5]:
                        best = found.setdefault((job[0], job[1]), {})
                        best[job[2]] = min(best.get(job[2], (PROBE, 0)), (int(edits), max(0, job[3])))
            for (row, item), met in found.items():
                yield x + row, self.items[item][0], len(met), min(e for e, _ in met.values()), min(b for _, b in met.values())

    def _align(self, raw: np.ndarray, offsets: np.ndarray, jobs: list[tuple]) -> np.ndarray:
        """Fewest edits between each probe and any part of its region, all jobs side by side."""
        band = self.width + 2 * self.edits + 1
        longest = max(len(j[4]) for j in jobs)
        pattern = np.zeros((len(jobs), longest), np.uint8)
        region = np.full((len(jobs), longest + band), 255, np.uint8)  # 255 is in no UTF-8 text
        size = np.array([len(j[4]) for j in jobs])
        for i, (row, _, _, begin, probe, _) in enumerate(jobs):
            pattern[i, : len(probe)] = np.frombuffer(probe, np.uint8)
            low, high = int(offsets[row]), int(offsets[row + 1])
            a, b = max(low, low + begin), min(high, low + begin + longest + band)
            if a < b:
                region[i, a - low - begin : b - low - begin] = raw[a:b]
        step = np.arange(band)
        cost = np.zeros((len(jobs), band), np.int64)
        best = np.full(len(jobs), longest, np.int64)
        for i in range(longest):
            here = cost + (region[:, i : i + band] != pattern[:, i : i + 1])
            here[:, :-1] = np.minimum(here[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(here - step, axis=1) + step
            best = np.where(size == i + 1, cost.min(axis=1), best)
        return best


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Probes]:
    """The index of each block of items; a block holds about `block_bytes`."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    total = items.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        texts = pa.array([r["text"] for r in rows], pa.string())
        raw, offsets = normalized(texts)
        yield Probes([(r["item_id"], raw[offsets[i] : offsets[i + 1]].tobytes().strip()) for i, r in enumerate(rows)])


def leaks(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_probes, edits, begin) of every document and item it leaks. No shuffle."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = []
    for probes in benchmark_blocks(benchmark, block_bytes):

        def found(batches: Iterator[pa.RecordBatch], probes: Probes = probes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(probes.leaks(batch.column("text")))
                row, item, n, edits, begin = zip(*hits, strict=True) if hits else ([],) * 5
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(n, pa.int32()),
                    pa.array(edits, pa.int32()), pa.array(begin, pa.int64()),
                ], ["doc_id", "item_id", "n_probes", "edits", "begin"])

        parts.append(rows.mapInArrow(found, f"doc_id long, {FOUND}"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def without_leaks(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that leak no item, all columns kept."""
    kept, at = documents, documents.columns.index("text")
    for probes in benchmark_blocks(benchmark, block_bytes):

        def clean(batches: Iterator[pa.RecordBatch], probes: Probes = probes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[hit[0] for hit in probes.leaks(batch.column(at).cast(pa.string()))]] = False
                yield batch.filter(pa.array(good))

        kept = kept.mapInArrow(clean, documents.schema)
    return kept
