"""SELECT as a DataFrame: scan, filter, order, limit, project. Catalyst plans the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import DataType, kind
from ..plans.bind import Condition, Table, bind, bound_column, key_bounds, mismatch
from ..plans.syntax import Statement
from ..sources import segments

MOST_LIMIT = 2**31 - 1


@dataclass
class Plan:
    """rows has visible and scale columns by physical name; picks are the places of the result's columns."""

    rows: DataFrame
    picks: list[int]
    names: list[str]
    types: list[DataType]
    #: The same rows in the same order, as parts to be read one after another without a shuffle; None where there is no such cut.
    parts: list[DataFrame] | None = None

    def frame(self) -> DataFrame:
        """The result under its own column names (a repeated column gets its place added)."""
        seen: dict[str, int] = {}
        out = []
        for at, name in zip(self.picks, self.names):
            seen[name] = seen.get(name, 0) + 1
            out.append(F.col(f"c{at}").alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
        return self.rows.select(*out)


def raise_lazily(scan: DataFrame, condition: Condition, key: int, descending: bool = False) -> None:
    """Raise the error of the first row, in scan order, that meets one."""
    if not condition.errors:
        return
    met = [F.coalesce(when, F.lit(False)) for _, when in condition.errors]
    some = met[0]
    for m in met[1:]:
        some = some | m
    order = F.col(f"c{key}").desc() if descending else F.col(f"c{key}").asc()
    row = scan.filter(some).orderBy(order).select(F.array(*met).alias("met")).first()
    if row is not None:
        raise condition.errors[row.met.index(True)][0]


def select(spark: SparkSession, root: str, table: Table, s: Statement) -> Plan:
    sort = None if s.order is None else table.place(s.order[0])
    descending = bool(s.order and s.order[1])
    by_key = sort is None or sort == table.key
    backwards = by_key and descending
    scan = segments.read(spark, root, table)
    bounds = key_bounds(s.where, table)
    start, end = (bounds.high, bounds.low) if backwards else (bounds.low, bounds.high)
    wanted = table.key_column.type.name
    wrong = lambda b: b is not None and kind(b[1]) != wanted
    if wrong(start) and not scan.isEmpty():
        raise mismatch(f"the key holds {wanted}")
    picks = [table.place(c) for c in s.columns] if s.columns else list(range(len(table.columns)))
    reached = scan
    if start is not None and not wrong(start):
        reached = reached.filter(bound_column(start, table))
    condition = bind(s.where, table)
    if s.limit != 0:
        if wrong(end) and not reached.isEmpty():
            raise mismatch(f"the key holds {wanted}")
        if end is not None and not wrong(end):
            reached = reached.filter(bound_column(end, table))
        raise_lazily(reached, condition, table.key, backwards)
    rows = reached if s.where is None else reached.filter(condition.column)
    key = F.col(f"c{table.key}")
    unsorted = rows
    if by_key:
        rows = rows.orderBy(key.desc() if descending else key.asc())
    else:
        column = F.col(f"c{sort}")
        rows = rows.orderBy(column.desc_nulls_first() if descending else column.asc_nulls_last(), key.asc())
    if s.limit is not None and s.limit <= MOST_LIMIT:
        rows = rows.limit(s.limit)
    kept = []
    for at in dict.fromkeys(picks):
        kept += [f"c{at}"] + ([f"s{at}"] if table.columns[at].type.name == "DECIMAL" else [])
    parts = None
    if by_key and s.limit is None:
        parts = [p.select(*kept) for p in _cut(unsorted, table, descending)] or None
    return Plan(rows.select(*kept), picks, [table.columns[i].name for i in picks], [table.columns[i].type for i in picks], parts)


def _cut(rows: DataFrame, table: Table, descending: bool) -> list[DataFrame]:
    """A stored table in key order: one part for each file of its most cut segment. Key ranges are pushed to the scan, so a part reads that file and what overlaps it."""
    if any("path" in s for s in table.segments):
        return []
    cuts = max((s.get("starts", []) for s in table.segments), key=len, default=[])[1:]
    if not cuts:
        return []
    key = F.col(f"c{table.key}")
    order = key.desc() if descending else key.asc()
    out = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows if low is None else rows.filter(key >= F.lit(low))
        part = part if high is None else part.filter(key < F.lit(high))
        out.append(part.coalesce(1).sortWithinPartitions(order))
    return out[::-1] if descending else out
