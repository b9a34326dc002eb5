"""License scan: base places against brute force, and verified templates."""

import math
import random
import re

from heliodor.llm import licenses as L

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def base(text):
    w, starts, labels = words(text), [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def found(texts):
    """Templates by relative position, in plain Python."""
    vocab = {x for _, n, _ in L.TEMPLATES for x in n.split()}
    held = [set(words(t)) & vocab for t in texts]
    idf = {v: math.log((1 + len(texts)) / (1 + sum(v in h for h in held))) + 1e-3 for v in vocab}
    out = []
    for text in texts:
        w = words(text)
        labels, best = set(), 0.0
        for label, notice, phrase in L.TEMPLATES:
            n, p = notice.split(), phrase.split()
            at = next(i for i in range(len(n)) if n[i : i + len(p)] == p)
            whole = sum(idf[x] for x in n)
            for shift in range(-len(n), len(w)):
                same = [i for i in range(len(n)) if 0 <= shift + i < len(w) and w[shift + i] == n[i]]
                met = sum(idf[n[i]] for i in same)
                if set(range(at, at + len(p))) <= set(same) and met >= L.LEAST * whole:
                    labels.add(label)
                    best = max(best, min(1.0, met / whole))
        out.append((labels, best))
    return out


def test_scan(spark):
    rng = random.Random(8)
    pieces = ["MIT License", "mit  license", "Mit-LICENSE", "summit license", "mit licenses", "Apache\nLicense", "GNU General Public License", "general public", "license", "MİT license", "mit licenſe", "K mit license", "émit license", "mit licenseé"]
    pieces += [n for _, n, _ in L.TEMPLATES] + [n.upper().replace(" ", ", ") for _, n, _ in L.TEMPLATES] + [" ".join(n.split()[1:]) for _, n, _ in L.TEMPLATES]
    texts = [None, "", "...", "mit license", "mit license mit license"]
    for _ in range(250):
        texts.append(rng.choice([" ", "\n", ". "]).join(rng.choice(pieces) if rng.random() < 0.25 else "".join(rng.choice("abcé") for _ in range(4)) for _ in range(rng.randint(0, 14))))
    texts.append("word " * 30_000 + "mit license" + " word" * 30_000)
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    got = {r.doc_id: r for r in L.scan(df).collect()}
    assert len(got) == len(texts)
    for i, (text, (labels, best)) in enumerate(zip(texts, found(texts))):
        r, want = got[i], base(text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, text
        assert r.labels == ",".join(sorted(labels | set(filter(None, want[4].split(","))))), text
        assert abs(r.score - max(best, 1.0 if want[1] else 0.0)) < 1e-9


def test_native_plan_and_rules(spark):
    df = spark.createDataFrame([(None, "mit license"), (1, "x"), (1, "x")], "doc_id long, text string")
    out = L.scan(df)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    assert sorted((str(r.doc_id), r.labels) for r in out.collect()) == [("1", ""), ("1", ""), ("None", "mit")]
    assert L.scan(df.limit(0)).count() == 0


def test_copies_keep_index_labels(spark):
    texts = ["x redistribution and use in source and binary forms with or without modification are permitted y"] * 2
    texts += ["Licensed under CC BY-NC 4.0"] * 500 + ["licensed under cc by nc 4 0 once"] + ["other words"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.labels, r.score) for r in L.scan(df).collect()}
    assert len(got) == len(texts)
    for i, (labels, best) in enumerate(found(texts)):
        assert labels == ({"bsd"} if i < 2 else {"cc-by-nc"} if i < 503 else set())
        assert got[i][0] == ",".join(labels) and abs(got[i][1] - best) < 1e-9


def test_files_of_many_licence_words(spark):
    notices = [n for _, n, _ in L.TEMPLATES]
    texts = [" ".join(notices), "all rights reserved no part may be reproduced without permission " + " ".join(notices[:9]) + " cc by nc"]
    texts += ["licensed under cc by nc 4 0 " + " filler ".join(sorted(L.vocabulary()))]
    texts += ["of and in the use by is all " + n for n in notices] + ["of and in the use by is all"] * 30 + ["x"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.labels.split(",") for r in L.scan(df).collect()}
    assert set(got[0]) == {label for label, _, _ in L.TEMPLATES}
    assert {"proprietary", "mit", "apache", "gpl", "lgpl", "agpl", "bsd"} <= set(got[1])
    assert got[2] == ["cc-by-nc"]
