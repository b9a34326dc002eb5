"""INSERT, UPDATE and DELETE as new segment lists. Nothing is published here."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import DbError
from ..functions.values import Number
from ..plans.bind import Table, Value, bind, compare, compare_values, mismatch, unknown_column
from ..plans.syntax import Statement
from ..sources import segments
from .select import raise_lazily

#: Keys looked up by an IN list; more are joined.
IN_LIST = 1000
#: Segments a table may have before a write merges the small ones.
MOST_SEGMENTS = 24
SMALL_ROWS = 100_000


def check(table: Table, at: int, value: Any) -> None:
    column = table.columns[at]
    if value is None:
        if column.not_null:
            raise DbError("NOT_NULL_VIOLATION", f"column {column.name} takes no NULL")
    elif not column.type.admits(value):
        raise mismatch(f"column {column.name} holds {column.type}")


def _row(table: Table, values: list) -> tuple:
    out: list = []
    for column, value in zip(table.columns, values):
        out.append(column.type.stored(value))
        if column.type.name == "DECIMAL":
            out.append(None if value is None else value.scale)
    return tuple(out)


def _same(value: Any) -> Any:
    return value.reduced() if isinstance(value, Number) else value


def _key_is(table: Table, value: Any):
    t = table.key_column.type
    return compare("=", Value(t.name, F.col(f"c{table.key}"), type=t), Value(t.name, None, value, True))


def _entry(spark: SparkSession, root: str, table: Table, name: str, rows: int) -> dict:
    return {"dir": name, "rows": rows} | ({"starts": segments.starts(spark, root, table, name)} if rows > SMALL_ROWS else {})


def _add(spark: SparkSession, root: str, table: Table, frame: DataFrame, rows: int, stage: Callable[[], str]) -> None:
    name = stage()
    segments.write(frame, root, name, table.key, rows > SMALL_ROWS)
    table.segments = [*table.segments, _entry(spark, root, table, name, rows)]
    small = [s for s in table.segments if s.get("rows", SMALL_ROWS) < SMALL_ROWS]
    if len(table.segments) > MOST_SEGMENTS and len(small) > 1:
        merged, total = stage(), sum(s["rows"] for s in small)
        segments.write(segments.read(spark, root, table, small), root, merged, table.key, total > SMALL_ROWS)
        table.segments = [s for s in table.segments if s not in small] + [_entry(spark, root, table, merged, total)]


def insert(spark: SparkSession, root: str, table: Table, s: Statement, stage: Callable[[], str]) -> int:
    places = []
    for name in s.columns:
        at = table.index(name)
        if at is None:
            raise unknown_column(name)
        if at in places:
            raise DbError("SYNTAX_ERROR", f"column {name} is named twice")
        places.append(at)
    rows = []
    for given in s.rows:
        if len(given) != len(places):
            raise DbError("SYNTAX_ERROR", f"{len(places)} columns are named and {len(given)} values given")
        values: list = [None] * len(table.columns)
        for at, value in zip(places, given):
            values[at] = value
        for at, value in enumerate(values):
            check(table, at, value)
        rows.append(values)
    keys = [r[table.key] for r in rows]
    twice = DbError("DUPLICATE_KEY", f"a row with this {table.key_column.name} exists")
    if len({_same(k) for k in keys}) < len(keys):
        raise twice
    frame = spark.createDataFrame([_row(table, r) for r in rows], segments.schema(table))
    if table.segments:
        now, key = segments.read(spark, root, table), f"c{table.key}"
        if len(keys) <= IN_LIST:
            t = table.key_column.type
            held = now.filter(F.col(key).isin([F.lit(t.stored(k)).cast(t.spark()) for k in keys]))
        else:
            # The statement's own rows are on the driver already.
            held = now.join(F.broadcast(frame.select(key)), key, "left_semi")
        if not held.isEmpty():
            raise twice
    _add(spark, root, table, frame, len(rows), stage)
    return len(rows)


def _rewrite(spark: SparkSession, root: str, table: Table, matched, change: Callable[[DataFrame], DataFrame], stage: Callable[[], str]) -> int:
    """Replace the files that hold matches by a new segment; all others stay as they are. One job counts, one writes."""
    counts = segments.count(spark, root, table, matched)
    touched = sorted(f for files in counts for f, (_, hits) in files.items() if hits)
    if not touched:
        return 0
    total = sum(hits for files in counts for _, hits in files.values())
    rows = sum(n for files in counts for n, hits in files.values() if hits)
    changed = change(segments.read(spark, root, table, [s for s, files in zip(table.segments, counts) if any(hits for _, hits in files.values())], touched))
    if isinstance(changed, tuple):
        changed, rows = changed[0], rows - total
    kept = []
    for s, files in zip(table.segments, counts):
        lost, left = sorted(f for f, (_, hits) in files.items() if hits), sum(n for n, hits in files.values() if not hits)
        if not lost:
            kept.append(s)
        elif left:
            kept.append({**s, "without": [*s.get("without", []), *lost]} | ({"rows": left} if "rows" in s else {}))
    if rows:
        name = stage()
        segments.write(changed, root, name, table.key, rows > SMALL_ROWS)
        kept.append(_entry(spark, root, table, name, rows))
    table.segments = kept
    return total


def delete(spark: SparkSession, root: str, table: Table, s: Statement, stage: Callable[[], str]) -> int:
    condition = bind(s.where, table)
    raise_lazily(segments.read(spark, root, table), condition, table.key)
    matched = F.coalesce(condition.column, F.lit(False))
    return _rewrite(spark, root, table, matched, lambda frame: (frame.filter(~matched), "rest"), stage)


def update(spark: SparkSession, root: str, table: Table, s: Statement, stage: Callable[[], str]) -> int:
    """Matching rows take the literals. A key update has a closed form: see _move."""
    new: dict[int, Any] = {}
    for name, value in s.columns:
        at = table.place(name)
        check(table, at, value)
        new[at] = value
    now = segments.read(spark, root, table)
    condition = bind(s.where, table)
    raise_lazily(now, condition, table.key)
    matched = F.coalesce(condition.column, F.lit(False))
    extra = _move(spark, now, table, new, matched, condition) if table.key in new else 0

    def change(frame: DataFrame) -> DataFrame:
        columns = []
        for i, c in enumerate(table.columns):
            value = F.lit(c.type.stored(new[i]) if i in new else None).cast(c.type.spark())
            columns.append((F.when(matched, value).otherwise(F.col(f"c{i}")) if i in new else F.col(f"c{i}")).alias(f"c{i}"))
            if c.type.name == "DECIMAL":
                scale = F.lit(new[i].scale if i in new and new[i] is not None else None).cast("byte")
                columns.append((F.when(matched, scale).otherwise(F.col(f"s{i}")) if i in new else F.col(f"s{i}")).alias(f"s{i}"))
        return frame.select(*columns)

    return _rewrite(spark, root, table, matched, change, stage) + extra


def _move(spark: SparkSession, now: DataFrame, table: Table, new: dict, matched, condition) -> int:
    """All matches would get one key, so two of them clash, and one must not meet a row that has it.

    A row that moves forward is met again by the walk in key order and counted again if it still matches: returns 1 then.
    """
    clash = DbError("DUPLICATE_KEY", f"a row with this {table.key_column.name} exists")
    hits = now.filter(matched).limit(2).collect()
    if len(hits) > 1:
        raise clash
    if not hits:
        return 0
    key, goal = f"c{table.key}", new[table.key]
    if not now.filter(_key_is(table, goal) & ~matched).isEmpty():
        raise clash
    t, row = table.key_column.type, hits[0].asDict()
    old = row[key] if t.name != "DECIMAL" else Number.parse(format(row[key], "f"))
    if not compare_values(">", goal, old):
        return 0
    for at, value in new.items():
        row[f"c{at}"] = table.columns[at].type.stored(value)
    moved = spark.createDataFrame([tuple(row[f.name] for f in segments.schema(table))], segments.schema(table))
    return 0 if moved.filter(condition.column).isEmpty() else 1
