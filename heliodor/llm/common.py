"""Shared pieces: shared-folder tables, Arrow text blocks and vectorised hashing.

All hashes are functions of content only, so a task that is run again on another
executor gives the same rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
#: Bytes that end a word under [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that end a word under [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
MARKS = np.ones(256, dtype=bool)
MARKS[0x30:0x3A] = MARKS[0x41:0x5B] = MARKS[0x61:0x7B] = MARKS[0x80:] = False
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.RandomState(20011).randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE_LOWER = _BYTE[_FOLD]
_tables: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "/tmp/checkpoints"
    return folder.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever they start; on a cluster it is installed or sent with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [have, root]))


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/heliodor-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._heliodor_path = path
    return out


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by table() once nothing reads it any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._heliodor_path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    have = {c.lower() for c in df.columns}
    longest = max(map(len, have), default=0)
    return [n if n.lower() not in have else n + "_" * (longest + 1 - len(n)) for n in names]


def regrouped(df: DataFrame, column: str) -> DataFrame:
    """The same rows, dealt anew by the next join.

    A join reads an aggregate where it lies; Spark can then not split a key that is hot on the other side. This hides
    that the rows are dealt by the column already.
    """
    return df.withColumn(column, F.greatest(column, column))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    have = _tables.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _INVERSE)):
                out = np.full(size, base, dtype=np.uint64)
                out[0] = 1
                _tables[key] = np.multiply.accumulate(out)
    return _tables["up"][:n], _tables["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Prefix:
    """Hashes of any span of a sequence of 64-bit values, from one running sum."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
            np.cumsum(values * up[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.down[start]
            return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all spans of k values; k is fixed, so no length is mixed in."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


class Block:
    """The UTF-8 bytes of some texts, end to end. Null texts are empty."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0]
        self.offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)

    def words(self, lower: bool, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first byte, byte after the end of each word, and each text's first word (with a last bound)."""
        n = len(self.data)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = ~breaks[self.data]
        starts = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        edges = self.offsets[:-1]
        edges = edges[edges < n]
        starts[edges] = inside[1:-1][edges]
        cut = edges[edges > 0] - 1
        ends[cut] = inside[1:-1][cut]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.prefix = Prefix((_BYTE_LOWER if lower else _BYTE)[self.data])
        hashes = self.prefix.spans(starts, ends)
        return hashes, starts, ends, np.searchsorted(starts, self.offsets)


def hash_of(word: str) -> int:
    """The hash that Block.words gives a lower-case word, signed."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(Prefix(_BYTE_LOWER[data]).spans(np.array([0]), np.array([len(data)])).view(np.int64)[0])


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Batches cut so that their texts hold at most that many bytes (or one text)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        total, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
            part = batch.slice(at, to - at)
            yield part, Block(part.column(part.schema.get_field_index(text)))
            at = to


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] of them), then the same for the next."""
    total = int(count.sum())
    step = np.ones(total, dtype=np.int64)
    if not total:
        return step
    keep = count > 0
    first, count = first[keep], count[keep]
    at = np.cumsum(count)[:-1]
    step[0] = first[0]
    step[at] = first[1:] - (first[:-1] + count[:-1] - 1)
    return np.cumsum(step)


def in_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)
