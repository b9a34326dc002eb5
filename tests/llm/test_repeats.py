"""Substring and suffix deduplication against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from heliodor.llm import substrings, suffixes
from heliodor.llm.paths import cut
from heliodor.llm.suffixes import cover


def brute(units, width, glue):
    seen = Counter(tuple(u[i : i + width]) for u in units for i in range(len(u) - width + 1))
    out = []
    for u in units:
        gone = set()
        for i in range(len(u) - width + 1):
            if seen[tuple(u[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(u), len(gone), glue([x for i, x in enumerate(u) if i not in gone])))
    return out


def texts(seed, words, n):
    rng = random.Random(seed)
    bits = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(6)]
    out = [None, "", "  ", "one", "a\tb\nc \x0b d"]
    for _ in range(n):
        parts = [rng.choice(bits) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))]
        text = rng.choice([" ", "  ", "\n"]).join(parts)
        if rng.random() < 0.3:
            at = rng.randint(0, len(text))
            text = text[:at] + "é" + text[at:]
        out += [text] * rng.choice([1, 1, 1, 2, 4])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, th string").repartition(3)


@pytest.mark.parametrize("seed,width,k", [(1, 7, 3), (2, 12, 5), (3, 5, 5)])
def test_words(spark, seed, width, k):
    rows = texts(seed, "the of and a big x ye zu".split(), 40)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup(frame(spark, rows), width=width, k=k).collect()}
    want = brute([re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in rows], width, " ".join)
    assert [got[i] for i in range(len(rows))] == want


@pytest.mark.parametrize("seed,width,k,most", [(1, 40, 9, 200), (2, 100, 16, 2), (3, 70, 64, 1000), (4, 70, 20, 1), (5, 60, 11, 4), (6, 20, 20, 1)])
def test_bytes(spark, seed, width, k, most):
    rows = texts(seed, "the of and a big x ye zu".split(), 40)
    found = suffixes.dedup(frame(spark, rows), width=width, k=k, most=most).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in found}
    want = brute([(t or "").encode() for t in rows], width, bytes)
    assert [got[i] for i in range(len(rows))] == want
    for r in found:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup(empty).count() == 0 and suffixes.dedup(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e"), (8, None)], "doc_id long, text string")
    assert sorted(str((r.doc_id, r.n_removed, r.kept)) for r in substrings.dedup(rows, width=5, k=2).collect()) == ["(7, 5, '')", "(8, 0, '')", "(None, 6, '')", "(None, 6, '')"]
    assert sorted(r.n_removed for r in suffixes.dedup(rows, width=9, k=3).collect()) == [0, 9, 11, 11]


def test_cover():
    for period in (16, 32, 64):
        c = cover(period)
        assert {(a - b) % period for a in c for b in c} == set(range(period))


def test_production_width(spark):
    """Width 400 and minimizers of 64 bytes: passages whose edges are buckets of many different paths."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghij \u00e9") for _ in range(n))
    shared = [noise(n) for n in (390, 420, 700)]
    rows = [noise(rng.randint(0, 600)) + rng.choice(shared) + noise(rng.randint(0, 600)) for _ in range(40)]
    rows += [rows[3], shared[2], None, ""]
    want = brute([(t or "").encode() for t in rows], 400, bytes)
    for most in (1024, 3):
        got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffixes.dedup(frame(spark, rows), most=most).collect()}
        assert [got[i] for i in range(len(rows))] == want


def test_long_texts_are_cut_in_segments():
    rng = np.random.RandomState(3)
    values = rng.randint(0, 3, 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bounds = np.array([0, 0, 40, 4000, 5000])
    of, start, n, *_ = cut(values, bounds, 30, 7, place_bits=7)
    windows = [(t, a + i) for t, a, m in zip(of.tolist(), start.tolist(), n.tolist()) for i in range(m)]
    assert windows == [(t, i) for t in range(4) for i in range(max(0, bounds[t + 1] - bounds[t] - 29))]
    whole = cut(values, bounds, 30, 7)
    place = lambda c: {(t, a + i): (m, a + p) for t, a, c, m, p in zip(c[0], c[1], c[2], c[3], c[5]) for i in range(c)}
    # The first of equal minimizers is taken in both.
    assert place(cut(values, bounds, 30, 7, place_bits=7)) == place(whole)
