"""Per-key building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmatch.session import cut_lineage


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key.

    The rank filter lets Spark cut every map task to k rows per key before the shuffle
    (WindowGroupLimit), so a hot key never travels whole.
    """
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1).drop("_rank")


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    steps: Sequence[Column],
    name: str = "position",
) -> DataFrame:
    """Exact 1-based position of every row within its key, without sorting a key in one task.

    `steps` are coarse, order-preserving parts of `order` (a leading sort column, or a number
    divided into ranges). Rows are numbered inside (key, steps) and shifted by the running
    count of the earlier steps, which is a small aggregate. Keys and steps must not be null.
    """
    names = [f"_step{i}" for i in range(len(steps))]
    stepped = df.select("*", *[step.alias(n) for step, n in zip(steps, names, strict=True)])
    cells = list(keys) + names
    counts = stepped.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(*cells, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = stepped.withColumn("_local", F.row_number().over(W.partitionBy(*cells).orderBy(*order)))
    joined = local.join(shifts, cells)
    return joined.withColumn(name, F.col("_local") + F.col("_shift")).drop("_local", "_shift", *names)


def range_step(order: Column, rows: int = 1_000_000) -> Column:
    """A numeric arrival order cut into ranges of at most `rows` values."""
    return F.floor(order / F.lit(rows))


def exact_median(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "median") -> DataFrame:
    """Exact continuous median of a whole-number column, per key.

    Values are counted once (value, count); three passes over the counts (value >> 40, value >> 20,
    value) locate the middle ranks, each aggregated map-side, so no task ever holds the values
    themselves. Null values are ignored, keys must not be null, and a key without values gives no row;
    without keys there is always one row.
    """
    keys = list(keys)
    present = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias("_v"))
    counts = cut_lineage(present.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    middle = F.array(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)
    targets = total.select(*keys, F.explode(middle).alias("_rank"), F.lit(0).cast("long").alias("_prefix"))
    shift_before = 63
    for shift in (40, 20, 0):
        prefix = F.lit(0).cast("long") if shift_before == 63 else F.shiftright("_v", shift_before)
        within = counts.select(*keys, prefix.alias("_prefix"), F.shiftright("_v", shift).alias("_cell"), "_c")
        wanted = targets.select(*keys, "_prefix").distinct()
        chosen = within.join(wanted, [*keys, "_prefix"], "left_semi")
        cells = chosen.groupBy(*keys, "_prefix", "_cell").agg(F.sum("_c").alias("_c"))
        upto = W.partitionBy(*keys, "_prefix").orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow)
        running = cells.withColumn("_upto", F.sum("_c").over(upto))
        hit = targets.join(running, [*keys, "_prefix"]).filter(
            (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_c"))
        )
        rank_inside = F.col("_rank") - (F.col("_upto") - F.col("_c"))
        # At most two rows per key; each pass reads them twice.
        targets = cut_lineage(hit.select(*keys, rank_inside.alias("_rank"), F.col("_cell").alias("_prefix")))
        shift_before = shift
    return targets.groupBy(*keys).agg(F.avg(F.col("_prefix").cast("double")).alias(name))


#: Rows that one task of a spread join makes at most, about.
TASK_ROWS = 4_000_000


def dealt_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: Column, right_id: Column, rows: int = 4096, spread: bool = False
) -> DataFrame:
    """Inner equi-join whose hot keys are dealt over cells of at most about `rows` x `rows`.

    Rows of a key are counted on both sides first. A key with more than `rows` on a side is cut there by a hash of
    the row's id, and the other side's rows go to every cut; so the copies made are the least that bounded cells
    need, and keys that are not hot make none. Null keys meet nothing.

    With `spread`, for joins that make many more rows than they read, cells are dealt to as many tasks as the counted
    result needs: by the bytes read, Spark would give it to few.
    """
    keys = list(keys)
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    counts = count(left, "_l").join(count(right, "_r"), keys)
    if spread:
        counts = cut_lineage(counts)
    hot = counts.select(*keys, F.ceil(F.col("_l") / rows).alias("_m"), F.ceil(F.col("_r") / rows).alias("_n"))
    hot = cut_lineage(hot.filter((F.col("_m") > 1) | (F.col("_n") > 1)))  # at most one row per `rows` rows

    def cells(df: DataFrame, own: str, other: str, own_cut: str, other_cut: str, row_id: Column) -> DataFrame:
        mine, theirs = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        cut = F.pmod(F.xxhash64(row_id), mine).alias(own_cut)
        return df.join(hot, keys, "left").select(*df.columns, cut, F.explode(F.sequence(F.lit(0).cast("long"), theirs - 1)).alias(other_cut))

    one = cells(left, "_m", "_n", "_i", "_j", left_id)
    two = cells(right, "_n", "_m", "_j", "_i", right_id)
    on = [*keys, "_i", "_j"]
    if spread:
        made = counts.agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0.0
        least = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(least, min(100_000, math.ceil(made / TASK_ROWS)))
        one, two = one.repartition(tasks, *on), two.repartition(tasks, *on)
    return one.join(two, on).drop("_i", "_j")
