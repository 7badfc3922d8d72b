"""Presence tests.

Two different questions are asked of a value and must not be mixed up: *is it
null* (does a provider value take part in the merge) and *is it falsy* (does it
count as a gap).  Falsy means null, empty text, zero, false or an empty list; a
blank such as ``' '`` and NaN are truthy.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F


def falsy(col: Column, kind: str) -> Column:
    """Never null itself, so it is safe under ``~`` and in filters."""
    if kind.startswith("array"):
        empty = F.size(col) == 0
    elif kind == "string":
        empty = col == ""
    elif kind == "boolean":
        empty = ~col
    else:
        empty = col == 0
    return col.isNull() | empty


def truthy(col: Column, kind: str) -> Column:
    return ~falsy(col, kind)


def present(*texts: Column) -> Column:
    """The texts that are neither NULL nor empty, as a list.

    Unlike ``array_compact``, which walks its elements outside generated code.
    """
    return F.array_remove(F.array(*[F.coalesce(t, F.lit("")) for t in texts]), "")


def names_where(tests: Mapping[str, Column]) -> Column:
    """The names whose test holds, in the mapping's order."""
    return present(*[F.when(test, F.lit(name)) for name, test in tests.items()])


def entries_where(entries: Iterable[tuple[Column, Column]], ddl: str) -> Column:
    """The structs whose test holds, in order, as a list of type ``ddl``."""
    none = F.array().cast(ddl)
    return F.concat(*[F.when(test, F.array(entry).cast(ddl)).otherwise(none) for test, entry in entries])
