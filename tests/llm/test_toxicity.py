"""Weak supervision: held-out accuracy and rules."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from heliodor.llm import toxicity


def corpus(n=1500, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(2, 5)):
                bad = rng.choice(["Idiot,", "moron", "zork" + rng.choice("xyz") + "l", "blarghs"])
                words.insert(rng.randrange(len(words) + 1), bad)
        docs.append((i, " ".join(words), "x", rng.random()))
        if rng.random() < 0.6:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, marks, ~toxicity.held_out(F.col("doc_id")))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [(got[i], t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    hit = sum((s >= 0.7) == bool(t) for s, t in held) / len(held)
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    assert hit > 0.97, hit
    clean = toxicity.keep_clean(df, model)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, s in got.items() if s < 0.7}


def test_rules(spark):
    marks = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    df = spark.createDataFrame([(None, "you idiot and moron stupid"), (1, None), (1, ""), (2, "fine day " * 5000), (3, "Stupid pathetic loser!")], "doc_id long, text string")
    model = toxicity.fit(df, marks, ~toxicity.held_out(F.col("doc_id")))
    got = sorted((r.doc_id or 0, r.score) for r in toxicity.score(df, model).collect())
    assert [s >= 0.7 for _, s in got] == [True, False, False, False, True]
    empty = df.limit(0)
    model = toxicity.fit(empty, marks.limit(0), F.lit(True))
    assert toxicity.score(empty, model).count() == 0


def test_correlated_voters_are_discounted():
    votes = np.array([[1, 1, 0], [1, 0, 1]])
    p1, p0 = np.full(3, 0.3), np.full(3, 0.05)
    alike = np.eye(3)
    alike[0, 1] = alike[1, 0] = 0.95
    a, b = toxicity.posterior(votes, p1, p0, alike, 0.1)
    assert a < b


def test_labelled_rows_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    ids = [*range(300), *range(40), None, None]
    marks = [(rng.choice([*range(350), None]), rng.random() < 0.3) for _ in range(200)] + [(7, True)] * 50
    for bits in (64, toxicity.SIEVE):
        monkeypatch.setattr(toxicity, "SIEVE", bits)
        for kind, label_kind in (("long", "long"), ("int", "long"), ("string", "string"), ("decimal(9,2)", "long")):
            docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string").select(F.col("id").cast(kind), "text")
            admitted = spark.createDataFrame(marks, "i long, toxic boolean").select(F.col("i").cast(label_kind), "toxic")
            got = sorted((int(r.id), r.text, r.yes, r.no) for r in toxicity.labelled(docs, admitted).collect())
            count = lambda i, toxic: sum(a == i and b == toxic for a, b in marks)
            assert got == sorted((i, f"t{i}", count(i, True), count(i, False)) for i in ids if i is not None and any(a == i for a, _ in marks))


def test_texts_without_a_label_are_not_dealt(spark):
    rng = random.Random(6)
    docs = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz 0123456789") for _ in range(4000))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).localCheckpoint()
    marks = spark.createDataFrame([(i, int(i % 60 == 0)) for i in range(0, 600, 30)], "doc_id long, toxic int")

    def dealt():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before, limit = dealt(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        toxicity.fit(df, marks, F.lit(True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert dealt() - before < 600 * 4000 / 4
