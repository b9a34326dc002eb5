"""Sharding by minimax contiguous partition.

Atomic groups (rows with equal texts) stand in the order of a 64-bit hash of their
text. The smallest feasible capacity of a shard is found by binary search, each
capacity checked greedily, and the order is cut within it: each cut as near as it can be to an
equal share of what is left, as long as the rest still fits. The driver sees hash
*segments*, never groups: a segment starts as one of 2**12 equal hash ranges and only the
segments that a cut may fall into are split further, by one job a round, until each of
those holds a single group. What the driver holds does not grow with the input.

Rules: a null text counts as the empty text; null ids are kept; repeated rows stay together
and get slots of their own; an empty table gives an empty result; other columns of the
input are carried by ``assign`` (which overwrites its own three names).
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, fresh, table

BITS = 64
FIRST_BITS = 12
STEP_BITS = 8


def group_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _greedy(sizes: list[int], total: list[int], cap: int, shards: int) -> list[int] | None:
    """Indices where shards begin if every item fits; None if more shards are needed."""
    cuts, at = [], 0
    for _ in range(shards):
        base = total[at - 1] if at else 0
        to = bisect_right(total, base + cap, at)
        if to == len(sizes):
            return cuts
        cuts.append(to)
        at = to
    return None


def _search(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """Smallest capacity and the cuts for items that cannot be split."""
    total = list(accumulate(sizes))
    low, high = max(max(sizes), -(-total[-1] // shards)), total[-1]
    while low < high:
        middle = (low + high) // 2
        if _greedy(sizes, total, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, _greedy(sizes, total, low, shards)


def _fluid(segments: list[tuple], shards: int) -> int:
    """A capacity that no cut can go below: only the largest groups are atomic."""
    whole = sum(s[2] for s in segments)
    return max(max(s[4] for s in segments), -(-whole // shards))


def _touched(segments: list[tuple], shards: int, low: int, high: int) -> list[int]:
    """Segments holding the greedy cuts of fluid capacities low and high, and all between them."""
    ends = list(accumulate(s[2] for s in segments))
    starts = [0, *ends[:-1]]

    def walk(cap: int, fluid: bool) -> list[int]:
        out, base = [], 0
        for _ in range(shards - 1):
            i = bisect_right(ends, base + cap)
            if i >= len(segments):
                break
            out.append(i)
            base = base + cap if fluid and segments[i][3] > 1 else starts[i]
        return out

    slow, fast = walk(low, False), walk(high, True)
    fast += [len(segments) - 1] * (len(slow) - len(fast))
    found: set[int] = set()
    for a, b in zip(slow, fast):
        found.update(range(min(a, b), max(a, b) + 1))
    return sorted(i for i in found if segments[i][3] > 1)


def _level(segments: list[tuple], shards: int, cap: int) -> tuple[list[int], list[int]]:
    """Cuts near equal shares under a feasible capacity, and the segments with several groups into which a share's end falls."""
    sizes = [s[2] for s in segments]
    ends = list(accumulate(sizes))
    cuts, coarse, at = [], [], 0
    for left in range(shards - 1, 0, -1):
        if at == len(segments):
            break
        base = ends[at - 1] if at else 0
        goal = base + (ends[-1] - base) / (left + 1)
        near = bisect_right(ends, goal, at)
        if near < len(segments) and segments[near][3] > 1:
            coarse.append(near)
        last = bisect_right(ends, base + cap, at)
        for i in sorted({near, near + 1, last}, key=lambda i: abs((ends[i - 1] if i else 0) - goal)):
            if at < i <= last and _greedy(sizes[i:], list(accumulate(sizes[i:])), cap, left) is not None:
                break
        cuts.append(i)
        at = i
    return cuts, coarse


def plan_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Minimax capacity and the first hash of each shard but the first.

    groups: columns h (signed 64-bit hash), b (bytes), one row a group or several.
    """
    unsigned = F.shiftrightunsigned(F.col("h"), BITS - FIRST_BITS)
    spark = groups.sparkSession
    per_group = kept = table(spark, groups.groupBy("h").agg(F.sum("b").alias("b")), "groups")
    found = per_group.groupBy(unsigned.alias("k")).agg(F.sum("b").alias("b"), F.count("*").alias("n"), F.max("b").alias("m"), F.min("h").alias("one")).orderBy("k").collect()
    segments = [(r.k, FIRST_BITS, r.b, r.n, r.m, r.one & (2**BITS - 1)) for r in found]
    if not segments:
        drop_table(spark, kept)
        return 0, []
    while True:
        high, _ = _search([s[2] for s in segments], shards)
        low = _fluid(segments, shards)
        split = _touched(segments, shards, low, high)
        cuts: list[int] = []
        if not split:
            high, _ = _search([s[2] for s in segments], shards)
            cuts, split = _level(segments, shards, high)
        if not split:
            drop_table(spark, kept)
            ends = [segments[i][5] if segments[i][3] == 1 else segments[i][0] << (BITS - segments[i][1]) for i in cuts if i < len(segments)]
            return high, ends
        parts = []
        for bits in sorted({segments[i][1] for i in split}):
            keys = [segments[i][0] for i in split if segments[i][1] == bits]
            now = min(BITS, bits + STEP_BITS)
            mine = per_group.filter(F.shiftrightunsigned("h", BITS - bits).isin(keys)) if bits < BITS else per_group.filter(F.col("h").isin(keys))
            rows = mine.groupBy(F.shiftrightunsigned("h", BITS - now).alias("k")).agg(F.sum("b").alias("b"), F.count("*").alias("n"), F.max("b").alias("m"), F.min("h").alias("one")).collect()
            parts += [(r.k & (2**now - 1), now, r.b, r.n, r.m, r.one & (2**BITS - 1)) for r in rows]
        gone = set(split)
        segments = sorted([s for i, s in enumerate(segments) if i not in gone] + parts, key=lambda s: s[0] << (BITS - s[1]))


def assign(df: DataFrame, id_col: str, text_col: str, shards: int = 24, slot_rows: int = 20_000) -> DataFrame:
    """df with shard (int), slot (long, gapless from 0 in its shard) and size (long)."""
    df = df.drop("shard", "slot", "size")
    h, b, s, c, o, r = fresh(df, "__h", "__b", "__s", "__c", "__o", "__r")
    seen = df.select(group_hash(F.col(text_col)).alias("h"), row_size(F.col(text_col)).alias("b"))
    _, cuts = plan_cuts(seen, shards)
    # In unsigned order; flipping the top bit makes signed comparison do it.
    flipped = F.col(h).bitwiseXOR(F.lit(-(2**63)))
    shard = F.lit(0)
    for cut in cuts:
        cut = (cut ^ 2**63) & (2**BITS - 1)
        shard = shard + F.when(flipped >= F.lit(cut - 2**BITS if cut >= 2**63 else cut), 1).otherwise(0)
    rows = df.withColumn(h, group_hash(F.col(text_col))).withColumn("shard", shard.cast("int")).withColumn("size", row_size(F.col(text_col)))
    return _slots(rows, id_col, slot_rows, (h, b, s, c, o, r)).drop(h)


def _slots(rows: DataFrame, id_col: str, slot_rows: int, names: tuple) -> DataFrame:
    """Gapless slots by (hash bucket of the id, id): counts a bucket, then ranks inside small buckets."""
    from pyspark.sql import Window

    h, b, s, c, o, r = names
    total = rows.count()
    n = max(1, -(-total // (24 * slot_rows)), min(256, -(-total // 256)))
    rows = rows.withColumn(b, F.pmod(F.xxhash64(F.col(id_col), F.col(h)), F.lit(n)).cast("int"))
    counts = rows.groupBy("shard", b).count()
    before = Window.partitionBy("shard").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias(s), F.col(b).alias(c), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(o))
    inside = Window.partitionBy("shard", b).orderBy(F.col(id_col).asc_nulls_last(), h)
    ranked = rows.withColumn(r, F.row_number().over(inside))
    return ranked.join(offsets, (F.col("shard") == F.col(s)) & (F.col(b) == F.col(c))).withColumn("slot", (F.col(r) - 1 + F.col(o)).cast("long")).drop(r, o, s, c, b)
