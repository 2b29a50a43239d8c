"""Helpers shared by the corpus operators: tables, written intermediates, vectorised text spans."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmatch.session import cut_lineage

#: Odd, so that it can be inverted modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS: dict[int, np.ndarray] = {}
BYTE_CODES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column) -> Column:
    """The remainder that splits labelled rows: 0 is held out. A null id is its own text: empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster names in spark.checkpoint.dir."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut_lineage(spark.range(0))  # sets the configured folder, or one of our own in a local session
    return f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"


#: Rows that go to Python at once where a row may hold thousands of numbers.
WIDE_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, partition_by: Sequence[str] = (), wide: bool = False) -> DataFrame:
    """The rows as a written table in the shared folder: cuts lineage and survives lost executors.

    `wide`: Python gets rows in small batches while this table is made.
    """
    path = shared_folder(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    conf = df.sparkSession.conf
    before = conf.get(_BATCH)
    try:
        if wide:
            conf.set(_BATCH, str(WIDE_ROWS))
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        conf.set(_BATCH, before)
    df.sparkSession.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files behind the table
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a column end to end, and where each starts (n + 1 offsets). Null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    first = int(starts[0]) if len(starts) else 0
    last = int(starts[-1]) if len(starts) else 0
    return raw[first:last], starts - first


def pieces(offsets: np.ndarray, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text is a range of its own."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(rows, max(end, at + 1))
        yield at, end
        at = end


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[size]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums; span_hash reads the hash of any span from them."""
    up, _ = _powers(len(codes) + 1)
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return sums


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, the same wherever the same codes stand."""
    _, down = _powers(len(sums))
    return scramble((sums[ends] - sums[starts]) * down[starts])


def all_span_hashes(sums: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the spans of one length at every position."""
    n = max(0, len(sums) - length)
    _, down = _powers(len(sums))
    return scramble((sums[length:] - sums[:n]) * down[:n])


def runs_of(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; no run crosses one of the sorted `breaks`."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    inner = breaks[(breaks > 0) & (breaks < len(mask))]
    first[inner] = mask[inner]
    last[inner - 1] = mask[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def arrow_rows(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in columns.values()], list(columns))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over undirected edges (a, b), for all nodes on an edge.

    Labels pass along edges and then jump to their label's label, so the number of rounds grows with the
    logarithm of a chain's length. Each round is a written table.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        offers = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("offer"))
        moved = labels.join(offers, "node").select("node", F.col("root").alias("before"), F.least("root", "offer").alias("root"))
        jumps = labels.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        step = stored(moved.join(jumps, "root", "left").select("node", "before", F.least("root", F.coalesce("jump", "root")).alias("root")))
        labels = step.select("node", "root")
        if step.filter(F.col("before") != F.col("root")).isEmpty():
            return labels
