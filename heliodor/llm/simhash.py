"""Document fingerprints by SimHash.

Every word votes on BITS signed bits by its hash, once for each place and as heavily as it is long
(long words are rare ones); a bit is set where the votes are positive. Neighbours
within a Hamming radius are found by permuted block tables: the bits are split into
radius + SPARE blocks, and for every choice of SPARE blocks a table is keyed by those
blocks (the permutation that brings them to the front). Two fingerprints within the radius agree on SPARE
blocks at least, so some table brings them together, and the distance is then checked in full.
Choices of blocks grow too many for wide radii: there one table is keyed by each of PROBED blocks, and asked
fingerprints are looked up with every change of a block's share of the radius (shares add up so that not
all blocks can exceed theirs); the guarantee is the same.

Rules: null and wordless texts have the fingerprint 0; equal texts have equal ones; ties of ids are
broken by text; rows with a null id have no next document (their edited text is their first half); a single document is its own next one;
repeated rows each count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Block, blocks, mix, table

BITS = 128
RADIUS, SPARE = 3, 2
#: Radius of near copies (5-word Jaccard similarity of 0.8 or more): at sf0.1 their fingerprints are up to 14 bits apart.
NEAR, PROBED = 14, 6
HEAVIEST = 16
#: Most texts whose votes are summed at once: VOTE_TEXTS x 4096 numbers.
VOTE_TEXTS = 1024
#: Most texts and characters that a task holds.
HOLD_TEXTS, HOLD_CHARS = 4096, 1 << 18
RANGES = 4
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def fingerprints(block: Block) -> np.ndarray:
    """Texts x 2 unsigned 64-bit numbers."""
    words, start, end, bounds = block.words(lower=True)
    out = np.zeros((len(bounds) - 1, 2), dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    weight = np.minimum(end - start, HEAVIEST)
    for a in range(0, len(full), VOTE_TEXTS):
        some = full[a : a + VOTE_TEXTS]
        low, high = bounds[some[0]], bounds[some[-1] + 1]
        out[some] = _votes(words[low:high], weight[low:high], np.append(bounds[some], high) - low)
    return out


def _votes(words: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprints of texts of at least one word each."""
    n = len(bounds) - 1
    both = np.stack([words, mix(words ^ np.uint64(0xA0761D6478BD642F))], axis=1).astype(">u8")
    # Votes are summed for every value of every hash byte, then turned into votes on bits.
    planes = both.view(np.uint8).reshape(len(words), 16)
    row = np.repeat(np.arange(n), np.diff(bounds))
    cell = (row[:, None] * 16 + np.arange(16)) * 256 + planes
    sums = np.bincount(cell.reshape(-1), np.repeat(weight, 16), minlength=n * 4096).reshape(n * 16, 256)
    votes = (sums @ _BYTE_BITS).reshape(n, BITS)
    whole = np.add.reduceat(weight, bounds[:-1])
    return np.packbits(2 * votes > whole[:, None], axis=1).view(">u8").astype(np.uint64)


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hi, lo (signed halves of the fingerprint) for every row of df."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch, block in blocks(batches, "text", 1 << 19):
            f = fingerprints(block).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(f[:, 0]), pa.array(f[:, 1])], ["id", "hi", "lo"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, hi long, lo long").withColumnRenamed("id", id_col)


def text_of(hi: Column, lo: Column) -> Column:
    """32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    """1 less the share of bits that differ."""
    return 1 - (F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))) / float(BITS)


def _block(hi: Column, lo: Column, low: int, high: int) -> Column:
    """Bits low to high - 1 of the fingerprint, from its right end."""

    def part(c: Column, a: int, b: int) -> Column:
        return F.shiftrightunsigned(c, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1))

    if high <= 64:
        return part(lo, low, high)
    if low >= 64:
        return part(hi, low - 64, high - 64)
    return F.shiftleft(part(hi, 0, high - 64), 64 - low).bitwiseOR(part(lo, low, 64))


def tables(prints: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """prints(hi, lo, ...) with one row for each permuted block table: table, key."""
    n = radius + spare
    edges = [round(i * BITS / n) for i in range(n + 1)]
    parts = [_block(F.col("hi"), F.col("lo"), a, b) for a, b in zip(edges, edges[1:])]
    rows = [F.struct(F.lit(t).alias("table"), F.xxhash64(*[parts[i] for i in chosen]).alias("key")) for t, chosen in enumerate(combinations(range(n), spare))]
    return prints.select("*", F.explode(F.array(*rows)).alias("__t")).select(*prints.columns, "__t.table", "__t.key")


def within(prints: DataFrame, asked: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """Pairs (hi, lo, hi2, lo2) of distinct fingerprints of asked and prints no more than radius bits apart, themselves included."""
    left = tables(asked.select("hi", "lo").distinct(), radius, spare)
    right = tables(prints.select("hi", "lo").distinct(), radius, spare).select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), "table", "key")
    far = F.bit_count(F.col("hi").bitwiseXOR(F.col("hi2"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("lo2")))
    return left.join(right, ["table", "key"]).filter(far <= radius).select("hi", "lo", "hi2", "lo2").distinct()


def probed(prints: DataFrame, asked: DataFrame, radius: int, n: int = PROBED) -> DataFrame:
    """As within, for wide radii and prints(hi, lo, n) of one row a fingerprint: pairs (hi, lo, hi2, lo2, n), each made once.

    Asked fingerprints are changed in one block by up to its share of bits and looked up.
    """
    edges = [round(i * BITS / n) for i in range(n + 1)]
    # Were more bits than its share changed in each block, these would be radius + 1 at least.
    shares = [(radius + 1 + i) // n - 1 for i in range(n)]
    blocks_of = lambda hi, lo: [_block(hi, lo, a, b) for a, b in zip(edges, edges[1:])]
    parts = F.array(*blocks_of(F.col("hi"), F.col("lo")))
    changes = [(t, sum(1 << b for b in bits)) for t, share in enumerate(shares) for k in range(share + 1) for bits in combinations(range(edges[t + 1] - edges[t]), k)]
    # As many as the constants say.
    changes = F.broadcast(asked.sparkSession.createDataFrame(changes, "table int, change long"))
    key = lambda change: F.xxhash64("table", F.get(F.col("parts"), F.col("table")).bitwiseXOR(change)).alias("key")
    left = asked.select("hi", "lo").distinct().withColumn("parts", parts).crossJoin(changes).select("hi", "lo", "table", key(F.col("change")))
    right = prints.withColumn("parts", parts).withColumn("table", F.explode(F.array(*[F.lit(t) for t, share in enumerate(shares) if share >= 0])))
    right = right.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), "n", key(F.lit(0).cast("long")))
    hi, lo = F.col("hi").bitwiseXOR(F.col("hi2")), F.col("lo").bitwiseXOR(F.col("lo2"))
    # Of the tables in which a pair meets, the first one makes it.
    first = F.coalesce(*[F.when(F.bit_count(x) <= share, t) for t, (x, share) in enumerate(zip(blocks_of(hi, lo), shares))])
    near = left.join(right, "key").filter((F.bit_count(hi) + F.bit_count(lo) <= radius) & (F.col("table") == first))
    return near.select("hi", "lo", "hi2", "lo2", "n")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, n_chars, edited_sha256, the fingerprints of the text, its edited text and the next text (hi/lo pairs).

    Texts are dealt once, by ranges of (numeric) ids; the first text of each range is sent to the range before too.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type, id_arrow_type = docs.schema["id"].dataType.simpleString(), to_arrow_type(docs.schema["id"].dataType)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Several ranges a task, so that hashing them to tasks evens out.
    m = RANGES * n
    bounds = np.array(sorted(set(docs.filter("id is not null").approxQuantile("id", [i / m for i in range(1, m)], 1 / (4 * m)))), dtype=np.float64)

    def part_of(column: pa.Array) -> np.ndarray:
        """Number of the range of each id, -1 for null."""
        ids = pc.fill_null(column.cast(pa.float64(), safe=False), 0).to_numpy(zero_copy_only=False)
        return np.where(pc.is_null(column).to_numpy(zero_copy_only=False), -1, np.searchsorted(bounds, ids)).astype(np.int32)

    def smallest(batches):
        for batch in batches:
            parts = part_of(batch.column("id"))
            rows = pa.table([pa.array(parts), batch.column("id")], ["part", "first"]).filter(pa.array(parts >= 0))
            least = rows.group_by("part").aggregate([("first", "min")]).select(["part", "first_min"]).rename_columns(["part", "first"])
            yield from least.combine_chunks().to_batches()

    # One row a range.
    firsts = docs.select("id").mapInArrow(smallest, f"part int, first {id_type}").groupBy("part").agg(F.min("first").alias("first")).orderBy("part").collect()
    before = {r.first: firsts[i - 1].part for i, r in enumerate(firsts)}

    def deal(batches):
        known = pa.array(list(before), id_arrow_type)
        for batch in batches:
            columns = [batch.column("id"), batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(part_of(columns[0])), pa.array(np.zeros(batch.num_rows, np.int32)), *columns], ["part", "ghost", "id", "text"])
            first = pc.fill_null(pc.is_in(columns[0], value_set=known), False)
            ids, texts = (c.filter(first) for c in columns)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([before[i] for i in ids.to_pylist()], pa.int32()), pa.array(np.ones(len(ids), np.int32)), ids, texts], ["part", "ghost", "id", "text"])

    dealt = docs.select("id", "text").mapInArrow(deal, f"part int, ghost int, id {id_type}, text string")
    dealt = dealt.repartition(n, "part").sortWithinPartitions("part", "ghost", "id", "text")

    def run(batches):
        held = None

        def rows():
            nonlocal held
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if held is not None and not held[1]:
                        # Only the first ghost of a range is the next text of its last row.
                        yield held[2], held[3], row[3] if row[0] == held[0] and row[0] >= 0 else ""
                    held = row
            if held is not None and not held[1]:
                yield held[2], held[3], ""

        def emit(ids, texts, edited, following):
            f = [fingerprints(Block(pa.array(x, pa.string()))).view(np.int64) for x in (texts, edited)]
            # The next text is mostly the next row.
            after = np.roll(f[0], -1, axis=0)
            other = [i for i, x in enumerate(following) if i + 1 == len(texts) or x is not texts[i + 1]]
            after[other] = fingerprints(Block(pa.array([following[i] for i in other], pa.string()))).view(np.int64)
            f.append(after)
            columns = [pa.array(ids, id_arrow_type), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited])]
            columns += [pa.array(x[:, j]) for x in f for j in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "edited_sha256", "hi", "lo", "edited_hi", "edited_lo", "next_hi", "next_lo"])

        ids, texts, edited, following, size = [], [], [], [], 0
        for i, text, after in rows():
            half = len(text) // 2
            ids.append(i)
            texts.append(text)
            edited.append(text[: len(text) - half] + after[:half])
            following.append(after)
            size += len(text)
            if size > HOLD_CHARS or len(ids) == HOLD_TEXTS:
                yield emit(ids, texts, edited, following)
                ids, texts, edited, following, size = [], [], [], [], 0
        if ids:
            yield emit(ids, texts, edited, following)

    out = dealt.mapInArrow(run, f"id {id_type}, n_chars long, edited_sha256 string, hi long, lo long, edited_hi long, edited_lo long, next_hi long, next_lo long")
    return out.withColumnRenamed("id", id_col)


def near_counts(prints: DataFrame, asked: Column, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """id, n_near for the rows of prints(id, hi, lo) that satisfy asked: how many other rows lie within the radius."""
    classes = prints.groupBy("hi", "lo").agg(F.count("*").alias("n"))
    if radius > RADIUS:
        sized = probed(classes, prints.filter(asked), radius)
    else:
        pairs = within(classes, prints.filter(asked), radius)
        sized = pairs.join(classes.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), "n"), ["hi2", "lo2"])
    totals = sized.groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    return prints.filter(asked).join(totals, ["hi", "lo"]).select(id_col, (F.col("n") - 1).alias("n_near"))
