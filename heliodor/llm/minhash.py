"""Near-duplicate documents by circulant MinHash.

Two permutations of a universe of 2**UNIVERSE_BITS shingle codes make all coordinates: the
first shuffles the codes once, the second is shifted circularly by 0, 1, 2, ... for the
coordinates. They are banded; documents that share a band are candidates; candidates are
confirmed on their full shingle sets.

Documents with equal sets form one class, of which one member goes on. In each band bucket the
smallest id is the centre, and star edges lead to it, so no bucket is expanded into pairs. The stars'
components that fit a unit of work (BLOCK_DOCS documents) are decided there, every pair on full sets. A larger one is
decided by its stars (a centre and all that share a bucket with it; every pair with a common bucket lies in one): first
slices of a star with the centre in each, at a cost linear in the star; then, only in stars whose members are still in
several components, pairs of blocks that are not of one component. So a large group of copies costs linear work, and a
chain of documents of middling similarity costs what its stars hold, not the square of the whole chain. A unit gives back a
spanning forest of its links, not the links. A link can be missed only if no band agrees:
with 40 bands of 8 rows, at most 3 in a million at a similarity of 0.85; with 56 bands
of 7 rows, 2 in a million at 0.8.

Rules: null or wordless texts have an empty set and are linked with nothing; a text of fewer words than a
shingle has its whole sequence as its one shingle; rows with equal ids are one document of
the graph; rows with a null id take part in nothing (component_id null, kept false); an empty
table gives an empty result; other columns are ignored by ``components_of`` and carried by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Prefix, blocks, drop_table, fresh, mix, regrouped, table
from .graph import components

SHINGLE = 5
BANDS, ROWS = 40, 8
UNIVERSE_BITS = 18
#: Per cent.
LEAST = 85
#: Documents and bytes in one block of a candidate component.
BLOCK_DOCS, BLOCK_TEXT = 400, 4 << 20

_D = 1 << UNIVERSE_BITS
_FIRST = np.random.RandomState(7001).permutation(_D)
_SECOND = np.random.RandomState(7002).permutation(_D).astype(np.uint32)


def shingle_sets(block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and the bounds of the texts."""
    hashes, _, _, bounds = block.words(lower=True)
    counts = np.diff(bounds)
    prefix = Prefix(hashes)
    n = len(hashes) - size + 1
    text = np.repeat(np.arange(len(counts)), counts)
    if n > 0:
        start = np.flatnonzero(text[:n] == text[size - 1 :])
    else:
        start = np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    values = np.concatenate([prefix.spans(start, start + size), prefix.spans(bounds[short], bounds[short + 1])])
    owner = np.concatenate([text[start] if len(start) else start, short])
    if len(short):
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    edges = np.searchsorted(owner, np.arange(len(counts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        values[a:b].sort()
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], np.searchsorted(owner[keep], np.arange(len(counts) + 1))


def signatures(values: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinates x sets; first: where each (non-empty) set begins."""
    codes = _FIRST[(values & np.uint64(_D - 1)).astype(np.int64)]
    around = np.concatenate([_SECOND, np.resize(_SECOND, coordinates)])
    out = np.empty((coordinates, len(first)), dtype=np.uint32)
    room = np.empty(len(codes), dtype=np.uint32)
    for shift in range(coordinates):
        np.take(around[shift:], codes, out=room, mode="clip")
        np.minimum.reduceat(room, first, out=out[shift])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Sets x bands: a 64-bit key of each band's rows and number."""
    out = np.empty((signature.shape[1], bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(signature.shape[1], b + 1, dtype=np.uint64)
            for r in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[b * rows + r])
            out[:, b] = key
    return out


def _sketch(bands: int, rows: int):
    def run(batches):
        for batch, block in blocks(batches, "text", 1 << 20):
            values, bounds = shingle_sets(block)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            one, two = np.zeros((2, len(n)), dtype=np.uint64)
            keys = np.zeros((0, bands), dtype=np.uint64)
            if len(full):
                first = bounds[full]
                with np.errstate(over="ignore"):
                    one[full] = np.add.reduceat(values, first)
                    two[full] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), first)
                keys = band_keys(signatures(values, first, bands * rows), bands, rows)
            lists = pa.ListArray.from_arrays(pa.array((np.searchsorted(full, np.arange(len(n) + 1)) * bands).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], ["id", "n", "f1", "f2", "bands"])

    return run


def _forest(adjacent: np.ndarray) -> np.ndarray:
    """Smallest index that each row reaches in a symmetric matrix."""
    label = np.arange(len(adjacent))
    while True:
        new = np.where(adjacent, label[None, :], len(label)).min(axis=1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(sets: list[np.ndarray], least: int) -> np.ndarray:
    """Matrix of 100 * intersection >= least * union."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    if m <= 4:
        both = np.zeros((m, m))
        for i in range(m):
            for j in range(i):
                a, b = sorted((len(sets[i]), len(sets[j])))
                if 100 * a >= least * b:
                    both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        flat = np.concatenate(sets)
        _, code, df = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), sizes.astype(np.int64))
        keep = df[code] > 1
        shared = np.cumsum(df > 1) - 1
        code, row = shared[code[keep]], row[keep]
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        both = np.zeros((m, m), dtype=np.float32)
        step = max(256, (32 << 20) // (4 * m))
        for low in range(0, int(code[-1]) + 1 if len(code) else 0, step):
            a, b = np.searchsorted(code, [low, low + step])
            dense = np.zeros((m, min(step, int(code[-1]) + 1 - low)), dtype=np.float32)
            dense[row[a:b], code[a:b] - low] = 1
            both += dense @ dense.T
        both = both.astype(np.float64)
    out = (both > 0) & (100 * both >= least * (sizes[:, None] + sizes[None, :] - both))
    np.fill_diagonal(out, False)
    return out


def _units(least: int):
    def decide(ids, texts, id_type):
        sets, names = [], []
        for part, block in blocks(iter([pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(texts, pa.string())], ["id", "text"])]), "text", 1 << 20):
            values, bounds = shingle_sets(block)
            sets += [values[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            names += part.column("id").to_pylist()
        label = _forest(links(sets, least))
        return [(names[i], names[j]) for i, j in enumerate(label.tolist()) if i != j]

    def run(batches):
        unit, ids, texts, id_type = None, [], [], None
        out: list[tuple] = []

        def record():
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], id_type), pa.array([b for _, b in out], id_type)], ["a", "b"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for u, i, t in zip(batch.column("unit").to_pylist(), batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if u != unit:
                    if len(ids) > 1:
                        out += decide(ids, texts, id_type)
                    unit, ids, texts = u, [], []
                    if len(out) > 10_000:
                        yield record()
                        out = []
                ids.append(i)
                texts.append(t)
        if len(ids) > 1:
            out += decide(ids, texts, id_type)
        if out:
            yield record()

    return run


def components_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n_shingles, component_id, kept for every row of df."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    sets = table(spark, docs.mapInArrow(_sketch(bands, rows), f"id {id_type}, n long, f1 long, f2 long, bands array<long>"), "sets")
    named = sets.filter("n > 0 and id is not null")
    classes = named.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("c"))
    member = table(spark, named.join(regrouped(classes, "f1"), ["f1", "f2"]).select("id", "rep", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")), "classes")
    buckets = member.filter("bands is not null").select("rep", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("rep").alias("p"), F.max("rep").alias("q")).filter("p < q").select("band", "p")
    near = buckets.join(regrouped(shared, "band"), "band").filter("rep <> p").select(F.col("rep").alias("a"), F.col("p").alias("b"))
    links_found = components(_confirmed(docs, table(spark, near.distinct(), "near"), id_type, least), "linked")
    whole = member.select("id", "rep").distinct().join(links_found, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("label", "rep").alias("component"))
    # Rows with equal ids and different texts are one document: the smallest of what they reach.
    whole = whole.groupBy("id").agg(F.min("component").alias("component")).withColumnRenamed("id", "i")
    out = sets.select("id", "n").join(whole, F.col("id") == F.col("i"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _decided(rows: DataFrame, id_type: str, least: int) -> DataFrame:
    """Spanning forests (a, b) of the links inside each unit of rows(unit, id, text)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "unit").sortWithinPartitions("unit")
    return ordered.mapInArrow(_units(least), f"a {id_type}, b {id_type}")


def _parts(m: str, size: str) -> Column:
    """Blocks for so many documents and bytes."""
    return F.greatest(F.ceil(F.col(m) / BLOCK_DOCS), F.ceil(F.col(size) / BLOCK_TEXT)).cast("int")


def _confirmed(docs: DataFrame, near: DataFrame, id_type: str, least: int) -> DataFrame:
    """Confirmed links (a, b) that connect all that is linked among the star edges near(a, b)."""
    spark = docs.sparkSession
    candidates = components(near, "candidates")
    # The same plan at every size: texts are dealt by id, never joined to a broadcast table.
    rows = candidates.join(docs.hint("merge"), F.col("node") == F.col("id")).select("label", "id", "text")
    rows = table(spark, rows.withColumn("size", F.octet_length("text")), "texts")
    sizes = rows.groupBy("label").agg(F.count("*").alias("m"), F.sum("size").alias("bytes")).filter("m > 1")
    sizes = table(spark, sizes.select("label", _parts("m", "bytes").alias("parts")), "sizes")
    small = rows.join(regrouped(sizes.filter("parts = 1").select("label"), "label"), "label").select(F.xxhash64("label").alias("unit"), "id", "text")
    found = table(spark, _decided(small, id_type, least), "links")
    wide = sizes.filter("parts > 1").select("label")
    if wide.isEmpty():
        return found
    # A component too large for a unit: its star groups, which hold every pair that shares a band.
    texts = rows.join(regrouped(wide, "label"), "label").select("id", "text", "size", F.xxhash64("text").alias("h"))
    stars = near.select(F.col("b").alias("p"), F.col("a").alias("id")).union(near.select("b", "b")).distinct()
    members = table(spark, stars.join(regrouped(texts, "id").hint("merge"), "id").select("p", "id", "size", "h"), "stars")
    # First each star's slices with its centre, which joins what belongs together at linear cost.
    sizes = members.groupBy("p").agg(F.count("*").alias("m"), F.sum("size").alias("bytes")).select("p", _parts("m", "bytes").alias("parts"))
    slices = members.join(regrouped(sizes, "p"), "p")
    own = F.explode(F.when(F.col("p") == F.col("id"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod("h", "parts").cast("int"))))
    slices = slices.select("p", "id", "h", own.alias("slice")).select(F.xxhash64("p", "slice").alias("unit"), "id", "h")
    found = found.unionByName(table(spark, _decided(_texts(slices, texts), id_type, least), "links"))
    # Then, where a star still holds several components, the pairs of blocks that are not of one component.
    now = components(found, "linked")
    placed = members.join(regrouped(now, "node").hint("merge"), F.col("id") == F.col("node"), "left").select("p", "id", "size", "h", F.coalesce("label", "id").alias("c"))
    shares = placed.groupBy("p", "c").agg(F.count("*").alias("m"), F.sum("size").alias("bytes")).withColumn("parts", _parts("m", "bytes"))
    # A component of a block or more has blocks of its own; smaller ones share.
    shares = table(spark, shares.withColumn("solid", F.col("m") >= BLOCK_DOCS), "shares")
    stars = shares.groupBy("p").agg(F.count("*").alias("comps"), F.sum(F.when(F.col("solid"), 0).otherwise(F.col("m"))).alias("m"), F.sum(F.when(F.col("solid"), 0).otherwise(F.col("bytes"))).alias("bytes"))
    stars = stars.filter("comps > 1").select("p", _parts("m", "bytes").alias("shared"))
    shares = shares.join(regrouped(stars, "p"), "p")
    none = F.lit(None).cast(id_type)
    blocks_of = shares.filter("solid").select("p", F.col("c").alias("of"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("n"))
    blocks_of = blocks_of.union(stars.filter("shared > 0").select("p", none, F.explode(F.sequence(F.lit(0), F.col("shared") - 1))))
    alone = blocks_of.groupBy("p").agg((F.count("*") == 1).alias("alone"))
    blocks_of = table(spark, blocks_of.join(alone, "p"), "blocks")
    block = F.when(F.col("solid"), F.pmod("h", "parts")).otherwise(F.pmod(F.xxhash64("c"), "shared")).cast("int")
    placed = placed.join(regrouped(shares.select("p", "c", "solid", "parts", "shared"), "p"), ["p", "c"])
    placed = placed.select("p", "id", "h", F.when(F.col("solid"), F.col("c")).alias("mine"), block.alias("b"))
    pairs = placed.join(regrouped(blocks_of, "p"), "p").filter(F.coalesce(F.col("mine") != F.col("of"), F.lit(True)))
    here, there = F.struct("mine", "b"), F.struct(F.col("of").alias("mine"), F.col("n").alias("b"))
    same = F.col("mine").isNull() & F.col("of").isNull() & (F.col("b") == F.col("n"))
    key = lambda x: F.xxhash64(x["mine"], x["b"])
    unit = F.xxhash64("p", F.least(key(here), key(there)), F.greatest(key(here), key(there)))
    pairs = pairs.filter(~same | F.col("alone")).select(unit.alias("unit"), "id", "h")
    return found.unionByName(_decided(_texts(pairs, texts), id_type, least))


def _texts(units: DataFrame, texts: DataFrame) -> DataFrame:
    """unit, id, text for units(unit, id, h)."""
    u = units.select("unit", F.col("id").alias("i"), F.col("h").alias("g"))
    return u.join(texts.hint("merge"), (F.col("i") == F.col("id")) & (F.col("g") == F.col("h"))).select("unit", "id", "text").distinct()


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Rows of df without the near copies: of each component the row with its smallest id stays. Rows with a null id stay."""
    kept = components_of(df, id_col, text_col, least, bands, rows).filter("kept")
    (mine,) = fresh(df, "__kept")
    kept = kept.select(F.col(id_col).alias(mine)).distinct()
    return df.join(kept, df[id_col] == F.col(mine), "left").filter(F.col(mine).isNotNull() | df[id_col].isNull()).drop(mine)
