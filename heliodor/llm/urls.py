"""URL filters: fixed host and path rules, and association rules mined by FP-growth.

The longest fixed rule that fits decides. Other urls are decided by the method: urls of labelled rows become baskets
of tokens (parts of the host, words of the path, names of the query); Spark's FP-growth
mines token combinations frequent among urls with a bad label; a combination becomes a block rule
if enough labelled urls hold it and enough of those are bad (support, confidence), and if no part
of it is a rule already. Rules are matched by an inverted index: a rule is posted under its
rarest token only and the rest of it is checked on the url's token set. A url without a matching rule is allowed.

Rules for input: a null url, or one without ://, has an empty host and path and is allowed; null ids are kept; repeated rows give
repeated rows; a url of any length is one basket (its combinations are never listed: see ``mine``); null labels are ignored; without labels nothing is mined; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

# Verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Least share of bad baskets that hold a combination, least number of labelled urls, least share of bad ones among them.
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.005, 20, 0.6


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed(host_col: Column, path_col: Column) -> tuple[Column, Column]:
    """The longest fitting rule (as text) and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: h:part, p:word, q:name."""
    hosts = F.transform(F.split(host(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(path(url), r"[^A-Za-z0-9]+"), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.filter(F.array_distinct(F.concat(hosts, words, names)), lambda x: F.length(x) > 2)


def _match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url key and rule for every rule whose tokens all stand in the url: urls(key, tokens), rules(rule, anchor, items)."""
    posted = urls.select("key", "tokens", F.explode("tokens").alias("anchor"))
    return posted.join(rules.select("rule", "anchor", "items"), "anchor").filter(F.size(F.array_except("items", "tokens")) == 0).select("key", "rule")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules (rule, anchor, items, n, confidence) from labelled(key, tokens, bad), one row a labelled url, and names(token, item).

    An item stands for all tokens that the same labelled urls hold, so a long token set that many urls share is one item
    and not an exponential number of combinations; a rule of items is a rule for every choice of their tokens. Tokens that are
    rules alone, and tokens that too few bad urls hold for any rule, never reach FP-growth.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule long, anchor string, items array<string>, n long, confidence double"), spark.createDataFrame([], "token string, item string")
    n_bad = labelled.filter("bad and size(tokens) > 0").count()
    if not n_bad:
        return empty
    # A rule holds min_rows labelled urls, so this many bad ones.
    least = max(ceil(min_support * n_bad - 1e-9), ceil(min_rows * min_confidence - 1e-9), 1)
    h = F.xxhash64("key", "tokens", "bad")
    counts = labelled.select(h.alias("h"), F.col("bad").cast("int").alias("bad"), F.explode("tokens").alias("token"))
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), "h").cast("decimal(38,0)")).alias(f"s{seed}")
    counts = counts.groupBy("token").agg(F.count("*").alias("c"), F.sum("bad").alias("b"), wide(1), wide(2)).filter(F.col("b") >= least)
    names = counts.groupBy("c", "b", "s1", "s2").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    # As many rows as tokens with enough bad urls: n_bad / least tokens a basket place at most.
    names = table(spark, names.select("item", "c", "b", F.explode("tokens").alias("token")), "items")
    alone = (F.col("c") >= min_rows) & (F.col("b") >= min_confidence * F.col("c"))
    single = names.filter(alone).select("item", "c", (F.col("b") / F.col("c")).alias("confidence")).distinct()
    single = single.select(F.xxhash64(F.array("item")).alias("rule"), F.col("item").alias("anchor"), F.array("item").alias("items"), F.col("c").alias("n"), "confidence")
    open_names = names.filter(~alone)
    rows = named(labelled.select(F.struct("key", "bad", h.alias("h")).alias("key"), "tokens"), open_names)
    rows = table(spark, rows, "baskets")
    baskets = rows.filter("key.bad and size(tokens) > 1").select(F.col("tokens").alias("items"))
    size = baskets.count()
    found = single
    if size >= least:
        sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / size).fit(baskets).freqItemsets
        sets = sets.filter("size(items) > 1").select(F.sort_array("items").alias("items"), F.col("freq").alias("b"))
        # Post each set under its rarest item.
        each = sets.withColumn("rule", F.xxhash64("items")).select("rule", "items", "b", F.explode("items").alias("item")).join(open_names.select("item", "c").distinct(), "item")
        sets = each.groupBy("rule", "items", "b").agg(F.min(F.struct("c", "item")).alias("least")).select("rule", "items", "b", F.col("least.item").alias("anchor"))
        held = _match(rows, sets).groupBy("rule").agg(F.count("*").alias("n"))
        strong = sets.join(held, "rule").withColumn("confidence", F.col("b") / F.col("n"))
        strong = strong.filter((F.col("n") >= min_rows) & (F.col("confidence") >= min_confidence))
        found = found.unionByName(strong.select("rule", "anchor", "items", "n", "confidence"))
    rules = table(spark, found, "rules")
    # A rule that holds a shorter rule adds nothing.
    wider = _match(rules.select(F.col("rule").alias("key"), F.col("items").alias("tokens")), rules).filter("key <> rule").select(F.col("key").alias("rule")).distinct()
    return rules.join(wider, "rule", "left_anti").select("rule", "anchor", "items", "n", "confidence"), names.select("token", "item")


def named(urls: DataFrame, names: DataFrame) -> DataFrame:
    """urls(key, tokens) with items in place of tokens; tokens without an item go, and urls without any."""
    each = urls.select("key", F.explode("tokens").alias("token")).join(names.select("token", "item"), "token")
    return each.groupBy("key").agg(F.collect_set("item").alias("tokens"))


def judge(df: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", **limits) -> DataFrame:
    """id, host, path, rule, verdict, mined_rule (number of the association rule that blocks, else null).

    labels(label_id, quality, toxic): a row of df is labelled by the label of its id, bad if toxic or of no quality.
    """
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    marks = labels.filter(F.col(label_id).isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).select(F.col(label_id).alias("i"), bad.alias("bad"))
    labelled = pages.join(marks, F.col("id") == F.col("i")).select(F.col("id").alias("key"), tokens(F.col("url")).alias("tokens"), "bad")
    rules, names = mine(labelled, **limits)
    rule, verdict = fixed(F.col("host"), F.col("path"))
    rows = pages.select("id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("rule", rule).withColumn("verdict", verdict)
    open_urls = rows.filter("rule is null and url is not null").select(F.col("url").alias("key")).distinct().withColumn("tokens", tokens(F.col("key")))
    blocked = _match(named(open_urls, names), rules).groupBy("key").agg(F.min("rule").alias("mined_rule"))
    out = rows.join(blocked, (F.col("url") == F.col("key")) & F.col("rule").isNull(), "left")
    method = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "mined_rule")
