"""Benchmark decontamination by latent semantic retrieval.

Passages of PASSAGE words are rows of a TF-IDF matrix over hashed terms. One pass counts
terms (IDF over all passages), one pass forms A'A times a random matrix, block by block on the
executors; from that product a randomised Nystrom decomposition gives the leading right singular
vectors and values, by which passages are folded in. Benchmark items and sliding windows of all documents (several
scales, one fitting each item) are projected and compared by cosine, where the text around holds enough of an
item's terms for the subsequence; each such window of the least cosine or more is checked by the longest common subsequence of words with the item and by its answer (the
item's last sentence), which also finds paraphrases with words put in, left out or replaced.

What the driver holds is terms x rank, whatever the input; the benchmark, a query
set, is sent to the tasks in pieces of BENCH_BYTES and looked for in blocks of BENCH_BLOCK items. Rules: null or wordless texts and items match nothing; rows with a null id are searched
and reported with a null id; repeated rows are reported each; empty tables give
an empty result; other columns are ignored by ``search`` and carried by ``keep_clean``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Block, blocks, fresh, ranges

TERM_BITS, RANK = 12, 96
PASSAGE, STEP = 32, 8
SCALES = (16, 32, 64)
#: Least cosine (of 5097 planted paraphrases that the exact checks accept, 1 lies below 0, 4 below 0.1 and 101 below 0.5), least shares of words and of the answer's words.
COSINE, LCS, ANSWER = 0.0, 0.7, 0.5
#: Words of a piece of text for which items that it and its neighbours cannot hold are ruled out.
REGION = 128
#: Items looked for at once, and bytes of items sent with one pass over the documents.
BENCH_BLOCK, BENCH_BYTES = 512, 32 << 20
#: Prepared blocks of items that a task keeps (16 MB each); further ones are prepared anew.
PREPARED = 8
_TERMS = 1 << TERM_BITS
_CHUNK = 64
GROUP = 16
MOST = max(SCALES) // STEP


def _terms(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, _, _, bounds = block.words(lower=True)
    return words, (words >> np.uint64(64 - TERM_BITS)).astype(np.uint16), bounds


def _pieces(bounds: np.ndarray, size: int, pad: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each non-empty piece of ``size`` words, its number, and each text's first piece; pad empty ones end a text."""
    counts = np.diff(bounds)
    pieces = -(-counts // size)
    first = np.concatenate([[0], np.cumsum(pieces + np.where(pieces > 0, pad, 0))])
    text = np.repeat(np.arange(len(counts)), pieces)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return bounds[text] + inner * size, first[text] + inner, first


def _sums(table: np.ndarray, index: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Sums of table[index] over the pieces that begin at start and hold up to size entries; the table's last row is zero.

    A column of entries at a time: far faster than reduceat for short pieces.
    """
    lengths = np.diff(np.append(start, len(index)))
    out = np.zeros((len(start), table.shape[1]), dtype=table.dtype)
    for j in range(size):
        out += np.take(table, np.where(j < lengths, index[np.minimum(start + j, len(index) - 1)], len(table) - 1), axis=0)
    return out


def _presence(batches):
    total = np.zeros(_TERMS, dtype=np.int64)
    passages = 0
    for _, block in blocks(batches, "text", 1 << 20):
        _, term, bounds = _terms(block)
        start, _, _ = _pieces(bounds, PASSAGE)
        if len(start):
            at = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(term))))
            flags = np.zeros((len(start), _TERMS), dtype=bool)
            flags[at, term] = True
            total += flags.sum(axis=0)
            passages += len(start)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(_TERMS + 1)), pa.array(np.append(total, passages))], ["t", "n"])


def term_weights(docs: DataFrame) -> np.ndarray:
    """IDF of each hashed term over all passages of docs(text)."""
    rows = docs.select("text").mapInArrow(_presence, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(_TERMS + 1)
    for r in rows:
        counts[r.t] = r.n
    return np.log((1 + counts[-1]) / (1 + counts[:-1])).astype(np.float32)


def _sum_arrays(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, v in zip(batch.column("c").to_pylist(), batch.column("v")):
            got = np.asarray(v.values, dtype=np.float64)
            sums[c] = sums[c] + got if c in sums else got
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["c", "v"])


def basis(docs: DataFrame, weights: np.ndarray, rank: int = RANK, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (terms x rank) and singular values of the TF-IDF passages of docs(text)."""
    omega = np.linalg.qr(np.random.RandomState(seed).standard_normal((_TERMS, rank)))[0].astype(np.float32)

    def multiply(batches):
        out = np.zeros((_TERMS, rank), dtype=np.float64)
        weighted = np.append(omega * weights[:, None], np.zeros((1, rank), np.float32), axis=0)
        for _, block in blocks(batches, "text", 1 << 20):
            _, term, bounds = _terms(block)
            start, _, _ = _pieces(bounds, PASSAGE)
            if not len(start):
                continue
            projected = np.append(_sums(weighted, term.astype(np.int64), start, PASSAGE), np.zeros((1, rank), np.float32), axis=0)
            passage = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(term))))
            order = np.argsort(term, kind="stable")
            ordered = term[order]
            edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            # Each term's passages, first in pieces of GROUP, then the pieces.
            begin, _, first = _pieces(np.append(edge, len(ordered)), GROUP)
            out[ordered[edge]] += np.add.reduceat(_sums(projected, passage[order], begin, GROUP), first[:-1], axis=0)
        out *= weights[:, None]
        flat = out.astype(np.float32).reshape(_TERMS // _CHUNK, -1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), lists], ["c", "v"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = docs.select("text").mapInArrow(multiply, "c int, v array<float>").repartition(min(n, _TERMS // _CHUNK), "c")
    y = np.zeros((_TERMS, rank))
    for r in parts.mapInArrow(_sum_arrays, "c int, v array<double>").collect():
        y[r.c * _CHUNK : (r.c + 1) * _CHUNK] = np.array(r.v).reshape(_CHUNK, rank)
    # Nystrom: A'A ~ Y (W'Y)^-1 Y', shifted for stability.
    shift = 1e-6 * max(np.linalg.norm(y), 1e-12)
    y = y + shift * omega
    core = omega.T.astype(np.float64) @ y
    chol = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * shift * np.eye(rank))
    v, s, _ = np.linalg.svd(np.linalg.solve(chol, y.T).T, full_matrices=False)
    return v.astype(np.float32), np.sqrt(np.maximum(s * s - shift, 0))


def common(a: list[int], masks: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence of a and a word list given as bit masks."""
    full = (1 << n) - 1
    row = full
    for x in a:
        m = masks.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | (1 << i)
    return out


class Items:
    """Benchmark items: words, answers, and for each scale the projected passages."""

    def __init__(self, rows: list[tuple], weights: np.ndarray, vectors: np.ndarray):
        self.ids, self.masks, self.sizes, self.answers = [], [], [], []
        queries: dict[int, list] = {s: [] for s in SCALES}
        bits: list[np.ndarray] = []
        for item, text in rows:
            block = Block(pa.array([text], pa.string()))
            words, term, _ = _terms(block)
            if not len(words):
                continue
            sentences = [s for s in re.split(r"(?<=[.?!])\s+", text.strip()) if s]
            answer = Block(pa.array(sentences[-1:], pa.string())).words(lower=True)[0].tolist()
            scale = next((s for s in SCALES if len(words) <= 1.3 * s), SCALES[-1])
            for at in range(0, max(1, len(words) - scale // 2), scale):
                v = (vectors[term[at : at + scale]] * weights[term[at : at + scale], None]).sum(axis=0)
                norm = np.linalg.norm(v)
                if norm > 0:
                    queries[scale].append((v / norm, len(self.ids), at))
            # A bit for each of the first 64 distinct terms: an item's terms that a region lacks bound its subsequence.
            own = np.zeros(_TERMS, dtype=np.uint64)
            distinct = np.unique(term)[:64]
            own[distinct] = np.uint64(1) << np.arange(len(distinct), dtype=np.uint64)
            bits.append(own)
            self.ids.append(item)
            self.masks.append(_masks(words.tolist()))
            self.sizes.append(len(words))
            self.answers.append((_masks(answer), len(answer)))
        self.bits = np.array(bits, dtype=np.uint64).reshape(len(bits), _TERMS)
        self.distinct = np.bitwise_count(np.bitwise_or.reduce(self.bits, axis=1)).astype(np.int64) if bits else np.zeros(0, np.int64)
        self.queries = {s: (np.array([q[0] for q in qs], dtype=np.float32), np.array([q[1:] for q in qs], dtype=np.int64)) for s, qs in queries.items() if qs}


def _able(items: Items, term: np.ndarray, bounds: np.ndarray, lcs: float) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of REGION words x items: whether the piece and its neighbours, as far as a region reaches, hold enough of the item's terms; and each text's first piece."""
    start, _, first = _pieces(bounds, REGION)
    text, ends = np.repeat(np.arange(len(bounds) - 1), np.diff(first)), np.append(start, len(term))
    bits, held = np.ascontiguousarray(items.bits.T), np.empty((len(start), len(items.ids)), dtype=np.uint64)
    for a in range(0, len(start), 32):
        b = min(a + 32, len(start))
        held[a:b] = np.bitwise_or.reduceat(bits[term[ends[a] : ends[b]]], start[a:b] - ends[a], axis=0)
    near = held.copy()
    for k in range(1, -(-(max(items.sizes) + 2 * max(SCALES) + STEP) // REGION) + 1):
        same = (text[k:] == text[:-k])[:, None]
        near[k:] |= np.where(same, held[:-k], np.uint64(0))
        near[:-k] |= np.where(same, held[k:], np.uint64(0))
    return np.bitwise_count(near) >= items.distinct - (1 - lcs) * np.array(items.sizes), first


def _search(parts, weights, vectors, item_type, cosine: float, lcs: float, answer: float):
    """parts: a broadcast list of lists of (item, text)."""

    def run(batches):
        projector = np.append(vectors * weights[:, None], np.zeros((1, vectors.shape[1]), np.float32), axis=0)
        prepared: dict[int, Items] = {}
        for batch, block in blocks(batches, "text", 1 << 19):
            words, term, bounds = _terms(block)
            if not len(words):
                continue
            start, place, first = _pieces(bounds, STEP, MOST - 1)
            half = np.zeros((int(first[-1]) + MOST, projector.shape[1]), dtype=np.float32)
            half[place] = _sums(projector, term.astype(np.int64), start, STEP)
            windows, window, have = {}, half, 1
            for scale in SCALES:
                while have * STEP < scale:
                    window = window[:-have] + window[have:]
                    have *= 2
                windows[scale] = window, np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), np.float32(1e-30))
            for i, rows in enumerate(parts.value):
                items = prepared.get(i) or Items(rows, weights, vectors)
                if len(prepared) < PREPARED:
                    prepared[i] = items
                best = _best(items, words, term, bounds, first, windows, cosine, lcs, answer)
                keys = sorted(best)
                values = [best[k] for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array([t for t, _ in keys], pa.int64())), pa.array([items.ids[i] for _, i in keys], item_type)]
                    + [pa.array([v[j] for v in values], pa.float64()) for j in (1, 0, 2)] + [pa.array([v[3] for v in values], pa.int64())],
                    ["id", "item_id", "cosine", "lcs_share", "answer_share", "first_word"],
                )

    return run


def _best(items: Items, words, term, bounds, first, windows, cosine: float, lcs: float, answer: float) -> dict[tuple[int, int], tuple]:
    """For each (text, item) found: subsequence share, cosine, answer share and first word of its best place."""
    best: dict[tuple[int, int], tuple] = {}
    if not items.ids:
        return best
    able_in, piece = _able(items, term, bounds, lcs)
    if not able_in.any():
        return best
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    inner = np.minimum((np.arange(len(text_of)) - first[text_of]) * STEP // REGION, np.diff(piece)[text_of] - 1)
    piece_of = piece[text_of] + inner
    for scale, (matrix, names) in items.queries.items():
        window, norm = windows[scale]
        # Windows near which some item of this scale can be at all.
        some = np.flatnonzero(able_in[:, names[:, 0]].any(axis=1)[piece_of])
        close = window[some] @ matrix.T
        w, q = np.nonzero(able_in[:, names[:, 0]][piece_of[some]])
        cosines = close[w, q] / norm[some[w]]
        passed = cosines >= cosine
        w, q, cosines = some[w[passed]], q[passed], cosines[passed]
        if not len(w):
            continue
        item_of, text = names[q, 0], text_of[w]
        size_of = np.array(items.sizes)[item_of]
        begin = bounds[text] + (w - first[text]) * STEP - names[q, 1]
        lows = np.minimum(np.maximum(bounds[text], begin - scale // 2), bounds[text + 1] - 1)
        highs = np.maximum(lows + 1, np.minimum(bounds[text + 1], begin + size_of + scale // 2 + STEP))
        # Necessary for the subsequence: few of the item's terms are missing.
        lengths = highs - lows
        inside = items.bits[np.repeat(item_of, lengths), term[ranges(lows, lengths)]]
        held = np.bitwise_count(np.bitwise_or.reduceat(inside, np.cumsum(lengths) - lengths))
        able = np.flatnonzero(held >= items.distinct[item_of] - (1 - lcs) * size_of)
        for c in able.tolist():
            item, n, at = int(item_of[c]), int(size_of[c]), int(text[c])
            region = words[lows[c] : highs[c]].tolist()
            share = common(region, items.masks[item], n) / n
            if share < lcs:
                continue
            masks, size = items.answers[item]
            told = common(region, masks, size) / size if size else 1.0
            if told < answer:
                continue
            found = (share, float(cosines[c]), told, int(lows[c] - bounds[at]))
            if found > best.get((at, item), (0.0,)):
                best[at, item] = found
    return best


def search(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER, rank: int = RANK) -> DataFrame:
    """One row for each document and benchmark item found in it: id, item_id, cosine, lcs_share, answer_share, first_word of the place.

    One pass over the documents serves BENCH_BYTES of items. Ids of items are of any type; items without id are ignored.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = bench.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).filter("item is not null and text is not null").distinct()
    item = asked.schema["item"].dataType
    schema = f"id {docs.schema['id'].dataType.simpleString()}, item_id {item.simpleString()}, cosine double, lcs_share double, answer_share double, first_word long"
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0]
    if not size:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    weights = term_weights(docs)
    # Folding in divides by the singular values, so that what all passages share does not drown the rest.
    vectors, values = basis(docs, weights, rank)
    vectors = vectors / np.maximum(values, 1e-6 * max(values.max(), 1e-12)).astype(np.float32)
    out, passes = None, -(-size // BENCH_BYTES)
    for part in range(passes):
        # The query set, in pieces of bounded size.
        rows = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == part).orderBy("item", "text").collect()
        rows = [(r.item, r.text) for r in rows]
        parts = spark.sparkContext.broadcast([rows[i : i + BENCH_BLOCK] for i in range(0, len(rows), BENCH_BLOCK)])
        found = docs.mapInArrow(_search(parts, weights, vectors, to_arrow_type(item), cosine, lcs, answer), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of df in which no benchmark item is found, with all columns. Rows with a null id stay."""
    (mine,) = fresh(df, "__found")
    found = search(df, bench, id_col, text_col).select(F.col(id_col).alias(mine)).distinct()
    return df.join(found, df[id_col] == F.col(mine), "left_anti")
