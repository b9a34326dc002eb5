"""Decontamination: planted copies and paraphrases against brute force, and the decomposition against numpy."""

import random
import re

import numpy as np

from heliodor.llm import decontaminate as d
from heliodor.llm.common import Block


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def make(seed=4):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    weights = [1 / (i + 2) for i in range(len(vocab))]
    say = lambda n: " ".join(rng.choices(vocab, weights, k=n))
    items = [(i, say(rng.choice([15, 20, 34, 50, 60, 120])) + ". " + say(4) + ".") for i in range(20)] + [(90, None), (91, ""), (None, "x y")]
    docs, truth = [], set()
    for i in range(200):
        words = say(rng.choice([0, 3, 40, 300, 900])).split()
        if i % 9 == 0:
            item, text = rng.choice(items[:20])
            copy = text.split()
            if i % 2:
                for j in range(0, len(copy) - 5, 8):
                    copy[j] = rng.choice(vocab)
            at = rng.randint(0, len(words))
            words[at:at] = copy
            truth.add((i, item))
        docs.append((i, " ".join(words), "x"))
    return docs, items, truth


def test_planted(spark):
    docs, items, truth = make()
    df = spark.createDataFrame(docs + [(1000, None, "x"), (None, None, "x")], "doc_id long, text string, cosine string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.search(df, bench).collect()}
    assert got == truth
    kept = d.keep_clean(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == ({i for i, _, _ in docs} | {1000, None}) - {i for i, _ in truth}
    assert d.search(df.limit(0), bench).count() == 0
    assert d.search(df, bench.limit(0)).count() == 0


def test_lcs():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 30))] for _ in "ab")
        assert d.common(a, d._masks(b), len(b)) == lcs(a, b)


def test_singular_values(spark):
    docs, _, _ = make()
    df = spark.createDataFrame(docs, "id long, text string, x string").repartition(3)
    weights = d.term_weights(df)
    rows = []
    for _, text, _ in docs:
        _, term, _ = d._terms(Block(__import__("pyarrow").array([text])))
        for at in range(0, len(term), d.PASSAGE):
            row = np.zeros(1 << d.TERM_BITS)
            np.add.at(row, term[at : at + d.PASSAGE], weights[term[at : at + d.PASSAGE]])
            rows.append(row)
    a = np.array(rows)
    seen = (a > 0).sum(axis=0)
    assert np.allclose(weights, np.log((1 + len(a)) / (1 + seen)), atol=1e-5)
    vectors, values = d.basis(df, weights, rank=300)
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(values[:3], want[:3], rtol=0.1)
    assert np.linalg.norm(a - a @ vectors @ vectors.T) < np.linalg.norm(a)


def test_all_accepted_paraphrases_are_found(spark):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    weights = [1 / (i + 2) for i in range(len(vocab))]
    say = lambda n: " ".join(rng.choices(vocab, weights, k=n))
    items = [(i, say(rng.choice([11, 16, 30, 60, 120])) + ". " + say(4) + ".") for i in range(20)]
    docs, truth = [], set()
    for i in range(400):
        item, text = rng.choice(items)
        words, copy, answer = say(rng.choice([150, 400])).split(), text.split(), text.split()[-4:]
        for j in range(len(copy)):
            if rng.random() < 0.3:
                copy[j] = rng.choice(vocab)
        if lcs(copy, text.split()) >= d.LCS * len(copy) and lcs(copy, answer) >= d.ANSWER * len(answer):
            at = rng.randint(0, len(words))
            words[at:at] = copy
            truth.add((i, item))
        docs.append((i, " ".join(words)))
    assert len(truth) > 100
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in d.search(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert truth <= got


def test_text_ids_and_many_items_in_one_pass(spark):
    docs, items, truth = make(6)
    df = spark.createDataFrame(docs, "doc_id long, text string, cosine string").repartition(2)
    rng = random.Random(3)
    other = [(f"o{i}", " ".join("".join(rng.choice("nopqrstuvwxyz") for _ in range(6)) for _ in range(20))) for i in range(2000)]
    bench = spark.createDataFrame([(None if i is None else f"i{i}", t) for i, t in items] + other, "item_id string, text string")
    found = d.search(df, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, f"i{x}") for i, x in truth}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
