"""Fingerprints: the edited ring, likeness, and neighbours against all pairs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from heliodor.llm import simhash


@pytest.mark.parametrize("n", [1, 2, 57])
def test_ring(spark, n):
    rng = random.Random(n)
    texts = [None, "", "é"] + ["".join(rng.choice("abc é\U0001f600 \n") for _ in range(rng.randint(0, 200))) for _ in range(n)]
    texts = texts[-n:] if n < 3 else texts
    rows = [(i * 3 - 5, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3)
    got = {r.doc_id: r for r in simhash.with_next(df).collect()}
    assert len(got) == len(rows)
    for i, (doc, text, _) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (got[doc].n_chars, got[doc].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        following = got[rows[(i + 1) % len(rows)][0]]
        assert (got[doc].next_hi, got[doc].next_lo) == (following.hi, following.lo)
    plain = {r.doc_id: (r.hi, r.lo) for r in simhash.fingerprint(df).collect()}
    assert plain == {k: (r.hi, r.lo) for k, r in got.items()}


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "abcd"), (None, "xy"), (4, "pqrs"), (9, "tuvw")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in simhash.with_next(df).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([("4", 4, sha("pqtu")), ("9", 4, sha("tupq")), ("None", 4, sha("ab")), ("None", 2, sha("x"))])
    assert simhash.with_next(df.limit(0)).count() == 0


def test_likeness_follows_the_text(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
    base = [word() for _ in range(200)]
    near = base[:190] + [word() for _ in range(10)]
    half = base[:100] + [word() for _ in range(100)]
    far = [word() for _ in range(200)]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((base, near, half, far))], "doc_id long, text string")
    f = {r.doc_id: (r.hi % 2**64) << 64 | (r.lo % 2**64) for r in simhash.fingerprint(df).collect()}
    d = [(f[0] ^ f[i]).bit_count() for i in range(4)]
    assert d[0] == 0 and d[1] < 25 < d[2] < d[3]


@pytest.mark.parametrize("radius,spare", [(3, 2), (1, 1), (6, 3)])
def test_neighbours(spark, radius, spare):
    rng = random.Random(radius)
    prints = [rng.getrandbits(128) for _ in range(20)]
    for p in list(prints):
        for _ in range(4):
            for bit in rng.sample(range(128), rng.randint(0, radius + 2)):
                p ^= 1 << bit
            prints.append(p)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(i, signed(p >> 64), signed(p % 2**64)) for i, p in enumerate(prints)], "doc_id long, hi long, lo long")
    got = {((r.hi % 2**64) << 64 | r.lo % 2**64, (r.hi2 % 2**64) << 64 | r.lo2 % 2**64) for r in simhash.within(df, df.filter("doc_id % 5 = 0"), radius, spare).collect()}
    assert got == {(p, q) for i, p in enumerate(prints) if i % 5 == 0 for q in prints if (p ^ q).bit_count() <= radius}
    if radius == 3:
        counts = {r.doc_id: r.n_near for r in simhash.near_counts(df, F.col("doc_id") % 5 == 0).collect()}
        assert counts == {i: sum((p ^ q).bit_count() <= 3 for q in prints) - 1 for i, p in enumerate(prints) if i % 5 == 0}


@pytest.mark.parametrize("radius", [3, 7, 14])
def test_wide_neighbours(spark, radius):
    rng = random.Random(radius)
    prints = [rng.getrandbits(128) for _ in range(20)]
    for p in list(prints):
        for distance in range(radius - 2, radius + 3):
            q = p
            for bit in rng.sample(range(128), distance):
                q ^= 1 << bit
            prints.append(q)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(i, signed(p >> 64), signed(p % 2**64)) for i, p in enumerate(prints)], "doc_id long, hi long, lo long")
    rows = simhash.probed(df.groupBy("hi", "lo").agg(F.count("*").alias("n")), df.filter("doc_id % 5 = 0"), radius).collect()
    got = [((r.hi % 2**64) << 64 | r.lo % 2**64, (r.hi2 % 2**64) << 64 | r.lo2 % 2**64) for r in rows]
    assert len(got) == len(set(got)) and set(got) == {(p, q) for i, p in enumerate(prints) if i % 5 == 0 for q in prints if (p ^ q).bit_count() <= radius}


def test_query_counts_near_copies(spark, tmp_path):
    from heliodor.llm import queries

    rng = random.Random(3)
    docs = []
    for i in range(0, 400, 20):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(100)]
        copy = list(words)
        copy[30], copy[70] = "changed", "words"
        docs += [(i, " ".join(words)), (i + 1, " ".join(copy))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (int(r.fingerprint, 16), r.n_near) for r in queries.op7_simhash(spark, str(tmp_path)).collect()}
    for i, (p, near) in got.items():
        assert near == (sum((p ^ q).bit_count() <= simhash.NEAR for q, _ in got.values()) - 1 if i % 20 == 0 else None)
    # Similarity 0.81 and more: the radius is met by nearly all.
    assert sum(near == 1 for i, (_, near) in got.items() if i % 20 == 0) >= 19
