"""The corpus pipeline against brute-force versions of its decisions."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heliodor.llm import curriculum, toxicity


def corpus(seed=6):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(30)) + ".") for i in range(8)]
    docs, labels, kinds = [], [], {}
    for i in range(240):
        words, kind = say(rng.choice([6, 60, 200])), "clean"
        if i % 8 == 1:
            words[2:2] = ["idiot", "moron", "stupid", "scum"]
            kind = "toxic"
        elif i % 8 == 2 and i > 10:
            words = docs[i - 2][1].split()
            if len(words) > 100:
                words[50] = "changed"
            kind = "copy"
        elif i % 8 == 3:
            words[3:3] = rng.choice(items)[1].split()
            kind = "leak"
        docs.append((i, " ".join(words), rng.choice(["en", None]), rng.choice(["s1", "s2", "s3", None]), 1))
        kinds[i] = kind
        if rng.random() < 0.7:
            labels.append((i, 1, int(kind == "toxic")))
    return docs, labels, items, kinds


def near(docs):
    """Components of similarity 0.85 by all pairs; the ids that stay."""
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i for i in ids if find(i) == i}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage written and read again, as the driver does."""
    root = tmp_path_factory.mktemp("pipeline")
    docs, labels, items, kinds = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    out, now = {}, spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(root)).write.parquet(f"{root}/{name}.parquet")
        now = spark.read.parquet(f"{root}/{name}.parquet")
        out[name] = now
    return str(root), docs, labels, items, kinds, out


def test_stages(spark, stages):
    root, docs, labels, items, kinds, out = stages
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert out[name].columns == columns
    text = {i: t for i, t, *_ in docs}
    kept = {r.doc_id for r in out["toxicity"].collect()}
    assert kept == {i for i in kinds if not re.search("idiot|moron|stupid|scum", text[i])}
    unique = {r.doc_id for r in out["near_dedup"].collect()}
    assert unique == near([(i, text[i]) for i in kept])
    clean = {r.doc_id for r in out["decontaminate"].collect()}
    assert clean == {i for i in unique if not any(t in text[i] for _, t in items)}
    copies = {r.doc_id: r.copies for r in curriculum.mix(out["decontaminate"]).collect()}
    mixed = [r.doc_id for r in out["mix"].collect()]
    assert {i: mixed.count(i) for i in set(mixed)} == {i: n for i, n in copies.items() if n}
    rows = out["shard"].collect()
    assert sorted(r.doc_id for r in rows) == sorted(mixed) and {r.shard for r in rows} <= set(range(24))
    homes = {}
    for r in rows:
        homes.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_run_agrees_with_the_stages(spark, stages):
    root, *_, out = stages
    key = lambda rows: sorted((r.doc_id, r.size, r.shard, r.slot) for r in rows)
    assert key(corpus_pipeline.run(spark, root).collect()) == key(out["shard"].collect())


def test_held_out_labels_are_not_learned(spark, stages):
    root = stages[0]
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    held = toxicity.held_out(F.col("doc_id"))
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x, ~held) for x in (labels, flipped))
    assert (a.weight == b.weight).all() and a.bias == b.bias


def test_near_dedup_takes_copies_from_80(spark):
    rng = random.Random(9)
    docs = []
    for i in range(0, 120, 2):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(100)]
        copy = list(words)
        for j in [20, 60, 80][: 1 + i // 2 % 3]:
            copy[j] = "changed"
        docs += [(i, " ".join(words)), (i + 1, " ".join(copy))]
    sets = [{tuple(w[j : j + 5]) for j in range(96)} for w in (t.split() for _, t in docs)]
    shares = {i: len(sets[i - 1] & sets[i]) / len(sets[i - 1] | sets[i]) for i, _ in docs if i % 2}
    assert {i % 6 for i, x in shares.items() if 0.8 <= x < 0.85} == {3} and {i % 6 for i, x in shares.items() if x < 0.8} == {5}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()}
    assert kept == {i for i, _ in docs if i % 2 == 0 or shares[i] < 0.8}
