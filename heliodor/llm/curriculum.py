"""Mixing sources to target weights with a time-varying curriculum.

Sources in code point order (null last) weigh 1, 2, 3, repeating. Targets share all words
by weight, but stop at 3 times a source's own words; the excess goes to the others
by weight (the water level is found in one pass over the sources, one row each).

Each source has a linear schedule over training time t in [0, 1]: its demand at t is its
target times 1 + a * (2t - 1), with a of -1/2, 0, 1/2 by rank: some sources fade, some
grow. The integral is a*t^2 + (1-a)*t; its inverse turns a document's place in its
source's token stream into a training position, by which documents are range-sorted.

A source's stream is its documents in the order of md5 of the id, as many whole passes
as fit into the target and then a part of one pass, to the nearest document.
Running totals are made in two levels (4096 hash buckets a source, then within a
bucket), so no task gets a whole source.

Rules: null text has size 0; null ids are ordered by text; equal ids are ordered by
size and text (copies of one row are alike, so which one is taken does not matter); a source
without words has target 0 and is not taken; an empty table gives an empty result. Other
columns of the input are ignored by ``mix`` and carried by ``mixed_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, n_words, table

MOST = 3
BUCKET_HEX = 3


def targets(sizes: DataFrame) -> DataFrame:
    """sk, source, source_size, rank, target for sizes(sk, source, size)."""
    per = sizes.groupBy("sk", "source").agg(F.sum("size").alias("source_size"))
    # One row a source from here on.
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", (F.col("rank") % 3 + 1).cast("double")).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("whole", F.sum("source_size").over(everything).cast("double"))
    level = (F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("capped", F.col("cap") / F.col("weight") <= level)
    taken = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise((F.col("whole") - taken) * F.col("weight") / free)
    return per.select("sk", "source", "source_size", "rank", target.alias("target"))


def position(progress: Column, rank: Column) -> Column:
    """Training time at which a source of that rank has served this share of its target."""
    a = (rank % 3 - 1) / 2
    root = (F.sqrt((1 - a) * (1 - a) + 4 * a * progress) - (1 - a)) / (2 * a)
    return F.when(rank % 3 == 1, progress).otherwise(root)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _plan(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source = F.col(source_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), source.alias("source"), _source_key(source).alias("sk"), n_words(F.col(text_col)).alias("size"), _text_hash(text_col).alias("h"))
    rows = table(df.sparkSession, rows, "sizes")
    # Null ids are spread by text, so that many of them make no hot bucket.
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null"), F.col("h").cast("string"))))
    rows = rows.withColumn("key", key).withColumn("bucket", F.substring("key", 1, BUCKET_HEX))
    buckets = rows.groupBy("sk", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("sk", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    info = targets(rows).select("sk", "source_size", "rank", "target")
    buckets = buckets.join(info, "sk")
    inside = Window.partitionBy("sk", "bucket").orderBy("key", "id", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(buckets, ["sk", "bucket"])
    rows = rows.withColumn("at", F.col("at") + F.col("start"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    extra = F.col("target") - F.col("passes") * F.col("source_size")
    rows = rows.withColumn("passes", passes)
    return rows.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + (F.col("at") + F.col("size") / 2 <= extra).cast("long")).otherwise(F.lit(0).cast("long")))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: id, size, source_size, target, taken, copies, first_position (null if not taken), range-sorted by it."""
    rows = _plan(df, id_col, text_col, source_col)
    progress = (F.col("at") + F.col("size") / 2) / F.col("target")
    first = F.when(F.col("copies") > 0, position(progress, F.col("rank")))
    out = rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", first.alias("first_position"))
    return out.orderBy(F.col("first_position").asc_nulls_last(), id_col)


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of df, each as often as the mix takes it, range-sorted by training position. Rows are known by id (null too), text and source."""
    plan = _plan(df, id_col, text_col, source_col)
    each = ["id", "h", "sk"]
    plan = plan.withColumn("n", F.row_number().over(Window.partitionBy(*each).orderBy("at"))).filter("copies > 0")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    places = plan.select(*each, "n", "rank", "at", "size", "source_size", "target", copy.alias("copy"))
    progress = (F.col("copy") * F.col("source_size") + F.col("at") + F.col("size") / 2) / F.col("target")
    places = places.select(*each, "n", position(progress, F.col("rank")).alias("p")).groupBy(*each, "n").agg(F.sort_array(F.collect_list("p")).alias("places"))
    i, h, k, n, at, many = fresh(df, "__i", "__h", "__k", "__n", "__at", "__places")
    places = places.toDF(i, h, k, n, many)
    mine = [F.col(id_col), _text_hash(text_col), _source_key(F.col(source_col))]
    m, g = fresh(df, "__m", "__g")
    rows = df.withColumn(g, mine[1]).withColumn(m, F.row_number().over(Window.partitionBy(*mine).orderBy(F.lit(0))))
    rows = rows.join(places, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(g) == F.col(h)) & (mine[2] == F.col(k)) & (F.col(m) == F.col(n)))
    rows = rows.withColumn(at, F.explode(many)).orderBy(at, id_col, g)
    return rows.select(*df.columns)
