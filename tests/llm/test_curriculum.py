"""Mixing: targets, nearness, order and copies."""

import random

from pyspark.sql import functions as F

from heliodor.llm import curriculum


def water(sizes):
    """Targets of sources in order, resharing the excess until none is above its cap."""
    weight = [i % 3 + 1 for i in range(len(sizes))]
    fixed, left = {}, float(sum(sizes))
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        total = sum(weight[i] for i in free)
        share = {i: left * weight[i] / total for i in free}
        above = [i for i in free if share[i] > 3 * sizes[i]]
        if not above:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        for i in above:
            fixed[i] = 3.0 * sizes[i]
            left -= fixed[i]


def corpus(seed):
    rng = random.Random(seed)
    rows, number = [], 0
    for source, n in (("a", 3), ("B", 400), (None, 30), ("ä", 60), ("hot", 900), ("zz", 1), ("empty", 2)):
        for _ in range(n):
            words = 0 if source == "empty" else rng.choice([1, 10, 100])
            rows.append((number, " ".join(["w"] * words) or None, source, 0))
            number += 1
    return rows


def test_mix(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)
    got = {r.doc_id: r for r in curriculum.mix(df).collect()}
    size = {i: len((t or "").split()) for i, t, _, _ in rows}
    sources = sorted({s for _, _, s, _ in rows if s is not None}) + [None]
    total = {s: sum(size[i] for i, _, x, _ in rows if x == s) for s in sources}
    want = dict(zip(sources, water([total[s] for s in sources])))
    assert len(got) == len(rows)
    taken = dict.fromkeys(sources, 0)
    for i, _, s, _ in rows:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], total[s]) and abs(r.target - want[s]) < 1e-6
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size and (r.first_position is None) == (r.copies == 0)
        taken[s] += r.taken
    for s in sources:
        assert abs(taken[s] - want[s]) <= 51, s
    again = {r.doc_id: r.taken for r in curriculum.mix(df.repartition(5)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_rows_and_schedule(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)
    copies = {r.doc_id: r.copies for r in curriculum.mix(df).collect()}
    mixed = curriculum.mixed_rows(df)
    assert mixed.columns == df.columns
    out = [r.doc_id for r in mixed.collect()]
    assert {i: out.count(i) for i in set(out)} == {i: n for i, n in copies.items() if n}
    # a fading source (rank 0) sits early, a growing one (rank 2) late.
    t = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
    fade, even, grow = (t.select(curriculum.position(F.col("u"), F.lit(k)).alias("p")).agg(F.avg("p"), F.min("p"), F.max("p")).first() for k in (0, 1, 2))
    assert fade[0] < even[0] < grow[0]
    assert all(abs(x[1]) < 1e-9 and abs(x[2] - 1) < 1e-9 for x in (fade, even, grow))


def test_repeated_and_null_rows(spark):
    df = spark.createDataFrame([(7, "a b", "s"), (7, "a b", "s"), (7, "c", "s"), (None, "d e f", "t"), (8, None, None)], "doc_id long, text string, source string")
    assert curriculum.mix(df).count() == 5
    got = sorted(curriculum.mixed_rows(df).collect(), key=str)
    want = sum(r.copies for r in curriculum.mix(df).collect())
    assert len(got) == want
    assert curriculum.mix(df.limit(0)).count() == 0 and curriculum.mixed_rows(df.limit(0)).count() == 0


def test_mixed_rows_take_null_ids_and_clashing_columns(spark):
    rows = [(None, f"w{i} " * (1 + i % 4), "a", i) for i in range(60)] + [(7, "x y", "b", 1), (7, "y x", "b", 2), (8, None, None, 3), (7, "x y", "b", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __at long").withColumnRenamed("__at", "__m")
    plan = {(r.source_size, r.target) for r in curriculum.mix(df).collect()}
    out = curriculum.mixed_rows(df)
    assert out.columns == df.columns
    got = out.collect()
    words = sum(len(r.text.split()) for r in got if r.source == "a")
    size, target = next(x for x in plan if x[0] == sum(1 + i % 4 for i in range(60)))
    assert abs(words - target) <= 4 and {r["__m"] for r in got if r.source == "a"} <= set(range(60))
    assert {r["__m"] for r in got if r.source == "b"} == {1, 2, 4}
    again = curriculum.mixed_rows(df.repartition(5)).collect()
    assert [(r.doc_id, r.text) for r in again] == [(r.doc_id, r.text) for r in got]
