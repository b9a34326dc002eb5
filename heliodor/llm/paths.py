"""Windows of W units that stand in more than one place: the shared part of both substring deduplicators.

The windows of a text are the edges of a de Bruijn graph (its nodes are the spans of W-1
units). Each window belongs to its minimizer: the smallest hash among its spans of k
units. Neighbouring windows with one minimizer form a *path*, which is compacted at once
where it is made, so the graph is handled by its paths (about 2 / (W-k+2) of the
windows) rather than edge by edge. Equal windows have the same minimizer at the same place,
so a minimizer is a bucket of windows, and:

* a bucket with one path: nothing in it is repeated;
* a bucket whose paths are all equal (no branch): all its windows are repeated;
* a bucket with a few different paths: ``solve`` (if given) compares them, one row a different path;
* a bucket with more than ``most`` of them is split by a deeper prefix, and so are its parts.

The split: a window stands r units before its minimizer, 0 <= r <= W-k. All windows with lo <= r <= hi hold the
same W-(hi-lo) units around the minimizer, their *core*. A path gives each range of r the piece with these windows, and
ranges are bucketed by their core. The ranges get narrower from level to level; in the last one each holds a single
window, which is its own core. So every bucket ends in one of the first three ways, at any size.

Counts are pre-aggregated; marks come back by joins that Spark may split, so a passage found in a third of the texts is
no hot group. Paths, pieces and windows are told apart by two 64-bit hashes (of the bucket and of all units), texts by
id and a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, Block, Prefix, blocks, drop_table, mix, ranges, regrouped, table

#: Bits of a packed minimizer that hold its place; longer blocks are cut in segments.
PLACE_BITS = 26
WINDOW_BLOCK = 1 << 20
#: Bytes of spans that one task of ``solve`` gets.
TASK_BYTES = 16 << 20


def units(block: Block, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of the words or bytes of a block, and the bounds of its texts."""
    if kind == "words":
        hashes, _, _, bounds = block.words(lower=False)
        return hashes, bounds
    return _BYTE[block.data], block.offsets


def _minima(grams: np.ndarray, span: int, place_bits: int) -> np.ndarray:
    """Index of the smallest of each span of grams; the first one of equals. At most 2**place_bits grams."""
    place = np.uint64((1 << place_bits) - 1)
    low = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if span > have:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    return (low & place).astype(np.int64)


def cut(values: np.ndarray, bounds: np.ndarray, width: int, k: int, place_bits: int = PLACE_BITS) -> tuple[np.ndarray, ...]:
    """Text, first window, number of windows, minimizer, hash of all units and minimizer's place (from the first window) of each path."""
    n = len(values) - width + 1
    if n <= 0:
        return (*(np.zeros(0, np.int64),) * 3, *(np.zeros(0, np.uint64),) * 2, np.zeros(0, np.int64))
    prefix = Prefix(values)
    grams = prefix.windows(k)
    span = width - k + 1
    room = (1 << place_bits) - span
    owner = np.concatenate([a + _minima(grams[a : a + room + span - 1], span, place_bits) for a in range(0, n, room)])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    valid = np.zeros(n + 2, dtype=bool)
    valid[1:-1] = text[:n] == text[width - 1 :]
    other = np.ones(n + 1, dtype=bool)
    other[1:-1] = owner[1:] != owner[:-1]
    first = np.flatnonzero(valid[1:-1] & (~valid[:-2] | other[:-1]))
    last = np.flatnonzero(valid[1:-1] & (~valid[2:] | other[1:]))
    of = text[first]
    return of, first - bounds[of], last - first + 1, grams[owner[first]], prefix.spans(first, last + width), owner[first] - first


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _whole(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _lists(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Row of each entry of the batch's ``paths``, and the named fields of the entries."""
    lists = batch.column("paths")
    flat = lists.flatten()
    of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
    return [of, *(np.asarray(flat.field(name)) for name in names)]


def split_at(width: int, k: int) -> list[int]:
    """Widths of the ranges of r, level by level."""
    span = width - k + 1
    return sorted({span, -(-span // 16), 1}, reverse=True)


def repeated(df: DataFrame, kind: str, width: int, k: int, steps: list[int], solve: Callable | None = None, most: int = 1) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """For df(id, text): docs(id, th, text), marks(id, th, spans of repeated windows), and the tables to drop in the end.

    steps: widths of the ranges of r of each level; the first holds all of them, the last one is 1. solve: mapInArrow
    function from rows(key, sk, lead, copied, span), sorted by key, to the runs (key, sk, from, n) of repeated windows.
    """
    spark = df.sparkSession
    docs = df.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    id_type = df.schema["id"].dataType.simpleString()
    item = f"key long, sk long, lead int, id {id_type}, th long, start int, n int"
    names = ["key", "sk", "lead", "id", "th", "start", "n"]

    def minimizers(batches):
        for _, block in blocks(batches, "text", WINDOW_BLOCK):
            _, _, _, m, sk, _ = cut(*units(block, kind), width, k)
            yield pa.RecordBatch.from_arrays([_signed(m), _signed(sk)], ["key", "sk"])

    def places(batches):
        for batch, block in blocks(batches, "text", WINDOW_BLOCK):
            of, start, n, m, sk, lead = cut(*units(block, kind), width, k)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([_signed(m), _signed(sk), _whole(lead), batch.column("id").take(take), batch.column("th").take(take), _whole(start), _whole(n)], names)

    def pieces(batch, block, step):
        """The deep paths of each row, cut at every ``step`` of r, bucketed by bucket and core."""
        values, bounds = units(block, kind)
        of, start, n, lead, key, deep = _lists(batch, "start", "n", "lead", "key", "deep")
        of, start, n, lead, key = (x[deep] for x in (of, start, n, lead, key))
        low, high = (lead - n + 1) // step, lead // step
        count = (high - low + 1).astype(np.int64)
        part, at = ranges(low.astype(np.int64), count), np.repeat(np.arange(len(of)), count)
        of, start, n, lead = of[at], start[at].astype(np.int64), n[at].astype(np.int64), lead[at].astype(np.int64)
        lo, hi = part * step, np.minimum((part + 1) * step, width - k + 1) - 1
        far, near = np.minimum(hi, lead), np.maximum(lo, lead - n + 1)
        middle = bounds[of] + start + lead
        prefix = Prefix(values)
        with np.errstate(over="ignore"):
            bucket = mix(key[at].view(np.uint64) + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        core = mix(bucket ^ prefix.spans(middle - lo, middle + width - hi))
        whole = prefix.spans(middle - far, middle - near + width)
        take, empty = pa.array(of), pa.nulls(len(of))
        return [_signed(core), _signed(whole), _whole(far), batch.column("id").take(take), batch.column("th").take(take), _whole(middle - far - bounds[of]), _whole(far - near + 1), empty.cast(pa.bool_()), empty.cast(pa.binary())]

    def bytes_of(batch, block):
        """The bytes of the paths of each row that are to be sorted."""
        of, start, n, lead, key, sk, copied, deep = _lists(batch, "start", "n", "lead", "key", "sk", "copied", "deep")
        mine = ~deep
        data, begin = block.data.tobytes(), (start + block.offsets[of])[mine].tolist()
        spans = [data[a : a + c + width - 1] for a, c in zip(begin, n[mine].tolist())]
        take = pa.array(of[mine])
        return [pa.array(key[mine]), pa.array(sk[mine]), _whole(lead[mine]), batch.column("id").take(take), batch.column("th").take(take), _whole(start[mine]), _whole(n[mine]), pa.array(copied[mine].tolist(), pa.bool_()), pa.array(spans, pa.binary())]

    def unfold(step):
        def run(batches):
            for batch, block in blocks(batches, "text", WINDOW_BLOCK):
                yield pa.RecordBatch.from_arrays(pieces(batch, block, step), [*names, "copied", "span"])
                if solve is not None:
                    yield pa.RecordBatch.from_arrays(bytes_of(batch, block), [*names, "copied", "span"])

        return run

    def with_text(entries: DataFrame) -> DataFrame:
        """docs that have such entries, with the list of these. The same plan at every size: texts are never joined to a broadcast table."""
        some = entries.groupBy("id", "th").agg(F.collect_set(F.struct("start", "n", "lead", "key", "sk", "copied", "deep")).alias("paths"))
        return docs.join(some.hint("merge"), docs["id"].eqNullSafe(some["id"]) & (docs["th"] == some["th"])).select(docs["id"], docs["th"], "text", "paths")

    def again(rows: DataFrame) -> DataFrame:
        """Buckets with several rows; plain: these are all equal."""
        seen = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("sk").alias("a"), F.max("sk").alias("b"))
        return seen.filter("c > 1").select("key", (F.col("a") == F.col("b")).alias("plain"))

    def mark(items: DataFrame, start="start") -> DataFrame:
        return items.select("id", "th", F.struct(F.expr(f"{start} as start"), "n").alias("p"))

    buckets = table(spark, again(docs.select("text").mapInArrow(minimizers, "key long, sk long")), "minimizers")
    items = table(spark, docs.mapInArrow(places, item).join(regrouped(buckets, "key").hint("merge"), "key"), "paths")
    drop_table(spark, buckets)
    tables, found = [items], mark(items.filter("plain"))
    for step in steps[1:]:
        wide = items.filter("not plain")
        entries = None
        if solve is not None:
            groups = wide.groupBy("key", "sk").agg((F.count("*") > 1).alias("copied"), F.min(F.struct("id", "th", "start", "n", "lead")).alias("r"))
            groups = table(spark, groups.select("key", "sk", "copied", "r.*"), "groups")
            sizes = table(spark, groups.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.col("n") + width).alias("size")), "sizes")
            tables += [groups, sizes]
            few, many = sizes.filter(F.col("m") <= most), sizes.filter(F.col("m") > most).select("key")
            load = few.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first().size
            parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-load // TASK_BYTES))
            entries = groups.join(regrouped(few.select("key"), "key").hint("merge"), "key").withColumn("deep", F.lit(False))
            wide = wide.join(regrouped(many, "key"), "key")
        deep = wide.select("key", "sk", F.lit(None).cast("boolean").alias("copied"), "id", "th", "start", "n", "lead", F.lit(True).alias("deep"))
        entries = deep if entries is None else entries.unionByName(deep)
        rows = table(spark, with_text(entries).mapInArrow(unfold(step), f"{item}, copied boolean, span binary"), "pieces")
        edges = rows.filter("span is null")
        tables.append(rows)
        if solve is not None:
            spans = rows.filter("span is not null").select("key", "sk", "lead", "copied", "span")
            runs = spans.repartition(parts, "key").sortWithinPartitions("key", "sk").mapInArrow(solve, "key long, sk long, from int, n int")
            runs = table(spark, runs, "runs")
            tables.append(runs)
            found = found.unionByName(mark(items.drop("n").join(regrouped(runs, "key").hint("merge"), ["key", "sk"]), "start + from"))
            if many.isEmpty():
                break
        if step == 1:
            # One window each: equal if both hashes are.
            twice = edges.groupBy("key", "sk").agg(F.count("*").alias("c")).filter("c > 1").select("key", "sk")
            found = found.unionByName(mark(edges.join(regrouped(twice, "key").hint("merge"), ["key", "sk"])))
        else:
            items = regrouped(edges.join(regrouped(again(edges), "key").hint("merge"), "key"), "key")
            found = found.unionByName(mark(items.filter("plain")))
    marks = found.groupBy("id", "th").agg(F.collect_set("p").alias("spans"))
    return docs, marks, tables


def removed(docs: DataFrame, marks: DataFrame, kind: str, width: int) -> DataFrame:
    """id, n_units, n_removed, spans (array of start, end), kept (binary) for every row of docs."""
    id_type = docs.schema["id"].dataType.simpleString()

    def apply(batches):
        for batch, block in blocks(batches, "text", WINDOW_BLOCK):
            if kind == "words":
                _, first, last, bounds = block.words(lower=False)
            else:
                bounds = block.offsets
            lists = batch.column("spans")
            counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            flat = lists.flatten()
            of = np.repeat(np.arange(batch.num_rows), counts)
            start = np.asarray(flat.field("start")).astype(np.int64) + bounds[of]
            end = start + np.asarray(flat.field("n")) + width - 1
            depth = np.zeros(int(bounds[-1]) + 1, dtype=np.int64)
            np.add.at(depth, start, 1)
            np.add.at(depth, end, -1)
            out = np.cumsum(depth)[:-1] > 0
            text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            total = np.diff(bounds)
            gone = np.bincount(text[out], minlength=batch.num_rows)
            # Maximal removed runs; a run ends with its text.
            edge = np.zeros(len(out) + 1, dtype=bool)
            edge[bounds] = True
            begin = np.flatnonzero(out & (~np.concatenate([[False], out[:-1]]) | edge[:-1])) if len(out) else np.zeros(0, np.int64)
            stop = np.flatnonzero(out & (~np.concatenate([out[1:], [False]]) | edge[1:])) + 1 if len(out) else np.zeros(0, np.int64)
            owner = text[begin] if len(begin) else begin
            runs = pa.StructArray.from_arrays([pa.array(begin - bounds[owner]), pa.array(stop - bounds[owner])], ["start", "end"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)), runs)
            keep = np.flatnonzero(~out)
            if kind == "words":
                sizes = last[keep] - first[keep]
                room = np.cumsum(sizes + 1)
                joined = np.full(int(room[-1]) if len(room) else 0, 0x20, dtype=np.uint8)
                joined[ranges(room - sizes - 1, sizes)] = block.data[ranges(first[keep], sizes)]
                edges = np.concatenate([[0], room])[np.searchsorted(keep, bounds)]
                joined = joined.tobytes()
                kept = [joined[a : b - 1] if b > a else b"" for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            else:
                joined = block.data[keep].tobytes()
                edges = np.searchsorted(keep, bounds).tolist()
                kept = [joined[a:b] for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total), pa.array(gone), runs, pa.array(kept, pa.binary())], ["id", "n_units", "n_removed", "spans", "kept"])

    rows = docs.join(marks.hint("merge"), docs["id"].eqNullSafe(marks["id"]) & (docs["th"] == marks["th"]), "left").select(docs["id"], "text", "spans")
    return rows.mapInArrow(apply, f"id {id_type}, n_units long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
