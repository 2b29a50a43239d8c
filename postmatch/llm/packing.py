"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Pieces are placed longest first into the open sequence with the
least room that still holds them, whatever its length. Where none holds a piece, a new sequence is opened
with the length of least cost per token, judged by what the pieces still to come could fill; at the end
each sequence is cut down to the shortest permitted length that holds its contents.

Pieces are dealt by hash into shards of about `SHARD_TOKENS` tokens and each shard is packed by itself, so
no task grows with the corpus. A text longer than the longest sequence is cut into pieces first.

Defined cases: null, empty and blank texts have no tokens and get one row without a sequence; repeated
rows are packed each; ties are broken by id and piece, null ids first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_TOKENS = 4_000_000
PACKED = "doc_id long, piece int, first_token long, n_tokens int, shard int, bin int, capacity int, position int"


def attention_cost(capacity: int) -> float:
    """Work of one sequence: a fixed part, one per token, and one that grows with the square."""
    return 64 + capacity + capacity * capacity / 16384


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = attention_cost):
    """Bin, position in it and final capacity of each length; lengths must be sorted, longest first.

    Open bins are kept by their room: a bit set finds the least room that is large enough.
    """
    lengths = np.asarray(lengths, np.int64)
    sizes = sorted(capacities)
    later = np.append(np.cumsum(lengths[::-1])[::-1], 0)
    falling = -lengths
    rooms: dict[int, list[int]] = {}
    open_rooms, used = 0, []
    bins, positions = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        above = open_rooms >> length
        if above:
            room = length + (above & -above).bit_length() - 1
            number = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            fitting = [c for c in sizes if c >= length]
            fill = {c: min(c, length + later[max(i + 1, int(np.searchsorted(falling, length - c)))]) for c in fitting}
            room = min(fitting, key=lambda c: (cost(c) / fill[c], c))
            number = len(used)
            used.append(0)
        bins[i], positions[i] = number, used[number]
        used[number] += length
        rest = room - length
        if rest:
            rooms.setdefault(rest, []).append(number)
            open_rooms |= 1 << rest
    final = np.array(sizes)[np.searchsorted(sizes, used)] if used else np.zeros(0, np.int64)
    return bins, positions, final[bins] if len(bins) else bins


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def best_fit(documents: DataFrame, n_tokens: Column | None = None, capacities: Sequence[int] = CAPACITIES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Rows of PACKED for all documents; `n_tokens` defaults to the number of words."""
    longest = max(capacities)
    counted = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (word_count(F.col("text").cast("string")) if n_tokens is None else n_tokens).cast("long").alias("_n"),
        F.monotonically_increasing_id().alias("_row"),  # the same when a task runs again
    )
    total = counted.select(F.sum("_n").alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(total / shard_tokens))
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_n") / longest) - 1).cast("int"))
    cut = counted.select("doc_id", "_n", "_row", F.explode(parts).alias("piece")).select(
        "doc_id", "piece", "_row", (F.col("piece") * F.lit(longest).cast("long")).alias("first_token"),
        F.least(F.lit(longest).cast("long"), F.col("_n") - F.col("piece") * F.lit(longest).cast("long")).cast("int").alias("n_tokens"),
    )
    # The row's place spreads documents without an id, or with one id, as well.
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "_row"), F.lit(shards)).cast("int")).drop("_row")

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], na_position="first", ignore_index=True)
        filled = rows["n_tokens"].to_numpy() > 0
        number, position, capacity = pack(rows["n_tokens"].to_numpy()[filled], capacities)
        for name, values in (("bin", number), ("capacity", capacity), ("position", position)):
            column = pd.array([None] * len(rows), dtype="Int32")
            column[filled] = values
            rows[name] = column
        return rows[[part.split()[0] for part in PACKED.split(", ")]]

    return cut.groupBy("shard").applyInPandas(packed, PACKED)
