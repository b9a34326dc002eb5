"""Results that arrive a partition at a time, never collected whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from ..functions.errors import DbError
from ..functions.values import from_stored
from ..operators.select import Plan


def rows(plan: Plan, cancelled: Callable[[], bool], done: Callable[[], None]) -> Iterator[tuple]:
    """Rows of Python values in result order; done is called at the end, however it comes."""
    try:
        at = {name: i for i, name in enumerate(plan.rows.columns)}
        places = [(at[f"c{p}"], at.get(f"s{p}")) for p in plan.picks]
        for part in plan.parts or [plan.rows]:
            for row in part.toLocalIterator(prefetchPartitions=False):
                if cancelled():
                    raise DbError("CANCELLED", "the statement was cancelled")
                yield tuple(from_stored(row[c], None if s is None else row[s]) for c, s in places)
    except DbError:
        raise
    except Exception as e:
        if cancelled():
            raise DbError("CANCELLED", "the statement was cancelled") from e
        raise DbError("STORAGE_FULL", str(e).split("\n")[0]) from e
    finally:
        done()
