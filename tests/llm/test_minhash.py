"""MinHash components against all pairs."""

import random
import re

import numpy as np

from heliodor.llm import minhash


def sets_of(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute(texts):
    sets = [sets_of(t) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [(len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"W{i}" for i in range(300)]
    out = [None, "", " \n", "a b", "A  b", "a b c d e", "a b c d", "É x y z w", "é x y z w"]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 300))]
        for _ in range(rng.choice([1, 2, 5, 20])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(rng.choice([" ", "\t", "\n "]).join(copy))
    rng.shuffle(out)
    return out


def test_components(spark, monkeypatch):
    for seed, block in ((1, 400), (2, 3)):
        monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
        texts = corpus(seed)
        df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, band string").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.components_of(df).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts)


def test_rules(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.components_of(empty).count() == 0
    text = " ".join(map(str, range(50)))
    rows = [(None, text), (3, text), (3, text), (9, text.upper()), (1, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in minhash.components_of(df).collect())
    assert got == [("1", 0, 1, True), ("2", 0, 2, True), ("3", 46, 3, True), ("3", 46, 3, True), ("9", 46, 3, False), ("None", 46, None, False)]
    assert sorted(str(r.doc_id) for r in minhash.keep_one(df).collect()) == ["1", "2", "3", "3", "None"]


def test_circulant_estimates_similarity():
    rng = np.random.RandomState(5)
    common, a, b = (rng.randint(0, 2**62, n).astype(np.uint64) for n in (800, 100, 100))
    sets = [np.unique(np.concatenate([common, x])) for x in (a, b)]
    sig = minhash.signatures(np.concatenate(sets), np.array([0, len(sets[0])]), 320)
    assert abs((sig[:, 0] == sig[:, 1]).mean() - 0.8) < 0.08


def test_chains_and_large_groups_by_stars(spark, monkeypatch):
    """Components larger than a unit: chains of middling similarity, one large group of near copies, stragglers."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 6)
    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(10_000)}"
    common = [word() for _ in range(60)]
    texts = [" ".join(common + [word() for _ in range(rng.choice([8, 12, 20, 60]))]) for _ in range(60)]
    base = [word() for _ in range(120)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 4])):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.components_of(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
