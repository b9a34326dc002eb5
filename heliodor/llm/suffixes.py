"""Byte-substring deduplication with a blockwise suffix array built by difference covers.

Only suffixes that can matter are sorted: those whose ``width`` bytes hold a minimizer seen
with different surroundings (see ``paths``); of equal surroundings one copy is sorted, with a mark that it has
others. The suffix buckets are these minimizers and the distance to them; a task gets
its buckets in order, lays the bytes of some of them into one block of bounded size and sorts
one bucket after another. In a block, positions whose residue modulo ``PERIOD`` lies in a
difference cover are ranked first, by sorting their first PERIOD bytes and doubling. A
bucket's suffixes then compare by the few bytes up to their next cover position and by its rank, so
a tie costs one look-up however long it is, and memory is bounded by the block. Spans are laid
out with their minimizers at multiples of PERIOD, so suffixes that can be equal have one residue and
one distance to the cover.

A minimizer with more than ``MOST`` different paths would make a bucket too large for a block (the edge of a
passage shared by a third of all texts). It is split by a deeper prefix, the bytes that neighbouring windows share, and its
parts are sorted in the same way; in the last split a part holds one string.

Rules: null text is empty; null ids are kept; repeated rows count as separate texts; matches
never cross texts; every byte covered by a repeated string is removed, the first place included; what is kept is
binary, since a cut may split a character; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paths import removed, repeated, split_at

WIDTH = 400
MINIMIZER = 64
PERIOD = 64
#: Most different paths of a bucket that is sorted; it fits a block. Fuller ones are split by a deeper prefix.
MOST = 1024
BLOCK = 1 << 20


def cover(period: int) -> np.ndarray:
    """A difference cover: every d is a difference of two members modulo period."""
    r = int(np.ceil(np.sqrt(period)))
    return np.unique(np.concatenate([np.arange(r), np.arange(0, period, r)]) % period)


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by keys, first key first; equal rows share a rank."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), dtype=np.int64)
    for key in keys:
        sorted_key = key[order]
        step[1:] |= sorted_key[1:] != sorted_key[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(step)
    return out


class Block:
    """Bytes laid out for sorting, with the ranks of its cover sample at depths PERIOD, 2*PERIOD, ..."""

    def __init__(self, pieces: list[bytes], leads: list[int], width: int, period: int = PERIOD):
        self.width, self.period = width, period
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        pads = (-np.asarray(leads, dtype=np.int64)) % period
        room = -(-(pads + sizes) // period) * period
        base = np.concatenate([[0], np.cumsum(room)])
        self.start = base[:-1] + pads
        depth = period
        while depth < width:
            depth *= 2
        text = np.zeros(int(base[-1]) + 2 * depth + 16, dtype=np.uint8)
        for at, piece in zip(self.start.tolist(), pieces):
            text[at : at + len(piece)] = np.frombuffer(piece, dtype=np.uint8)
        self.words = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
        inside = np.zeros(period, dtype=bool)
        inside[cover(period)] = True
        self.gap = np.array([next(d for d in range(period) if inside[(r + d) % period]) for r in range(period)])
        n = len(text) - depth - 16
        sample = np.flatnonzero(np.resize(inside, n))
        words = [self.words[sample + 8 * j].astype(np.uint64) for j in range(period // 8)]
        rank = np.full(len(text), -1, dtype=np.int64)
        rank[sample] = _dense(*words)
        self.ranks = {period: rank}
        step = period
        while step < width:
            new = np.full(len(text), -1, dtype=np.int64)
            new[sample] = _dense(rank[sample], rank[sample + step])
            rank, step = new, step * 2
            self.ranks[step] = rank
        self.depth = step

    def equal(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the width bytes from p and q agree; p and q have one residue each."""
        gap = self.gap[p % self.period]
        head = np.uint64(0xFFFFFFFFFFFFFFFF)
        shift = (64 - 8 * gap).astype(np.uint64)
        mask = np.where(gap == 0, np.uint64(0), head << np.minimum(shift, np.uint64(63)))
        out = ((self.words[p].astype(np.uint64) ^ self.words[q].astype(np.uint64)) & mask) == 0
        at, step = gap.copy(), self.depth
        while step >= self.period:
            fits = at + step <= self.width
            same = self.ranks[step][p + np.where(fits, at, gap)] == self.ranks[step][q + np.where(fits, at, gap)]
            out &= ~fits | same
            at = np.where(fits, at + step, at)
            step //= 2
        for j in range(0, self.period, 8):
            place = np.minimum(at + j, self.width - 8)
            out &= self.words[p + place] == self.words[q + place]
        return out

    def repeated(self, bucket: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the width bytes at each position also start at another position of its bucket (one residue a bucket)."""
        gap = self.gap[position % self.period]
        shift = (64 - 8 * gap).astype(np.uint64)
        head = np.where(gap == 0, np.uint64(0), self.words[position].astype(np.uint64) >> np.minimum(shift, np.uint64(63)))
        order = np.lexsort((self.ranks[self.depth][position + gap], head, bucket))
        p, q = position[order[:-1]], position[order[1:]]
        both = np.flatnonzero(bucket[order[:-1]] == bucket[order[1:]])
        both = both[self.equal(p[both], q[both])]
        out = np.zeros(len(position), dtype=bool)
        out[order[both]] = True
        out[order[both + 1]] = True
        return out


def sort_buckets(width: int):
    """mapInArrow function over different paths (key, sk, lead, copied, span), sorted by key: their repeated windows as runs."""

    def solve(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        pieces, leads = [r[4] for r in rows], np.array([r[2] for r in rows], dtype=np.int64)
        copied = np.array([r[3] for r in rows], dtype=bool)
        block = Block(pieces, leads, width)
        counts = np.array([len(p) - width + 1 for p in pieces], dtype=np.int64)
        names: dict[int, int] = {}
        group = np.array([names.setdefault(r[0], len(names)) for r in rows], dtype=np.int64)
        owner = np.repeat(np.arange(len(pieces)), counts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        bucket = group[owner] * (4 * width) + offset - leads[owner] + width
        hit = block.repeated(bucket, block.start[owner] + offset) | copied[owner]
        edge = np.zeros(len(hit) + 1, dtype=bool)
        edge[np.concatenate([[0], np.cumsum(counts)])] = True
        begin = np.flatnonzero(hit & (~np.concatenate([[False], hit[:-1]]) | edge[:-1]))
        stop = np.flatnonzero(hit & (~np.concatenate([hit[1:], [False]]) | edge[1:])) + 1
        return owner[begin], offset[begin], stop - begin

    def run(batches):
        def emit(rows):
            owner, offset, n = solve(rows)
            keys, sks = (np.array([r[i] for r in rows], dtype=np.int64)[owner] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sks), pa.array(offset.astype(np.int32)), pa.array(n.astype(np.int32))], ["key", "sk", "from", "n"])

        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                # A new block begins with a new bucket only.
                if size > BLOCK and row[0] != last:
                    yield emit(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[4]), row[0]
        if held:
            yield emit(held)

    return run


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = MINIMIZER, most: int = MOST) -> DataFrame:
    """id, n_bytes, n_removed, spans (removed byte ranges: start, end), kept (binary)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    k = min(k, width)
    docs, marks, _ = repeated(rows, "bytes", width, k, split_at(width, k), sort_buckets(width), most)
    out = removed(docs, marks, "bytes", width)
    return out.select(F.col("id").alias(id_col), F.col("n_units").alias("n_bytes"), "n_removed", "spans", "kept")
