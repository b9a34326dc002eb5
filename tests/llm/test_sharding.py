"""Minimax contiguous partition against plain binary search over all groups."""

import random

import pytest
from pyspark.sql import functions as F

from heliodor.llm import sharding


def shards_needed(sizes, cap):
    n, have = 1, 0
    for s in sizes:
        if s > cap:
            return 10**9
        if have + s > cap:
            n, have = n + 1, 0
        have += s
    return n


def smallest(sizes, shards):
    return next(c for c in range(max(sizes), sum(sizes) + 1) if shards_needed(sizes, c) <= shards)


@pytest.mark.parametrize("seed,shards", [(1, 24), (2, 3), (3, 7), (4, 1)])
def test_minimal(spark, monkeypatch, seed, shards):
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "STEP_BITS", 3)
    rng = random.Random(seed)
    texts = []
    for _ in range(120):
        texts += ["x" * rng.choice([1, 5, 40, rng.randint(0, 300)]) + str(rng.random())] * rng.choice([1, 1, 1, 6])
    texts += [None, "", ""]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, shard int").repartition(3)
    rows = sharding.assign(df, "doc_id", "text", shards, slot_rows=10).select("*", F.hex(sharding.group_hash(F.col("text"))).alias("h")).collect()
    assert len(rows) == len(texts) and all(r.size == len((texts[r.doc_id] or "").encode()) + 8 for r in rows)
    groups, where, slots = {}, {}, {}
    for r in rows:
        groups[r.h] = groups.get(r.h, 0) + r.size
        where.setdefault(r.h, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(w) == 1 for w in where.values())
    order = sorted(groups, key=lambda h: int(h, 16))
    assert [min(where[h]) for h in order] == sorted(min(where[h]) for h in order)
    loads = {}
    for h in order:
        loads[min(where[h])] = loads.get(min(where[h]), 0) + groups[h]
    assert max(loads.values()) <= smallest([groups[h] for h in order], shards)
    assert max(loads) < shards
    # Near equal shares where no group stands in the way.
    assert min(loads.values()) >= sum(loads.values()) / shards - 2 * max(groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_large_group_leaves_no_shard_empty(spark):
    rng = random.Random(9)
    texts = ["copy " * 400] * 40 + ["x" * rng.randint(50, 400) + str(i) for i in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    loads = {r.shard: r.n for r in sharding.assign(df, "doc_id", "text", 24).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert len(loads) == 24
    largest = 40 * (2000 + 8)
    rest = sorted(loads.values())[:-1]
    # The shard before the large group holds what is left over.
    assert max(loads.values()) >= largest and rest[1] > 0.5 * sum(rest) / 23


def test_rules(spark):
    df = spark.createDataFrame([(None, "a"), (1, None), (1, None)], "doc_id long, text string")
    got = sharding.assign(df, "doc_id", "text", 24).collect()
    assert len(got) == 3 and len({(r.shard, r.slot) for r in got}) == 3
    assert sharding.assign(df.limit(0), "doc_id", "text", 24).count() == 0
