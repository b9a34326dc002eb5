"""Substring deduplication by de Bruijn compaction of token k-mers.

Windows of ``width`` words are the edges of a de Bruijn graph over all texts. Neighbouring
edges that share a minimizer are compacted into paths where they are made (see
``paths``); paths that repeat without a branch are found by Spark joins on their minimizer; at
branches, edges are compared one by one. The source coordinates (id, first window, number of
windows) that each path keeps are then checked against the text: a path counts as repeated only
if a second, independent hash over all its words agrees, an edge only by a hash over its own words.

Every word covered by a repeated window is removed, the first place included; windows are judged
on the input. Rules: null text has no words; null ids are kept and equal to one another; repeated rows count as
separate texts (so long ones remove each other); texts shorter than a window keep all; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paths import removed, repeated

WIDTH = 35
MINIMIZER = 16


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = MINIMIZER) -> DataFrame:
    """id, n_words, n_removed, spans (removed word ranges: start, end), kept (string: kept words joined by a space)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    k = min(k, width)
    docs, marks, _ = repeated(rows, "words", width, k, sorted({width - k + 1, 1}, reverse=True))
    out = removed(docs, marks, "words", width)
    return out.select(F.col("id").alias(id_col), F.col("n_units").alias("n_words"), "n_removed", "spans", F.col("kept").cast("string").alias("kept"))
