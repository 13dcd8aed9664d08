"""Lookups in documents of unknown shape, as VARIANT columns: dotted paths, the first of several names, values by position. What isn't there is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document(text: Column) -> Column:
    """A JSON text as a document; null where it is broken or null."""
    return F.try_parse_json(text)


def path_of(dotted: str) -> str:
    """"a.b.0" as a path of keys and, for whole numbers, positions; a last part in parentheses stands as it is, dots and all: "metrics.(mAP50.95)"."""
    parts, rest = [], dotted
    while rest:
        if rest[0] == "(":
            # up to the last parenthesis, as names may have their own
            part, _, rest = rest[1:].rpartition(")")
            rest = rest.removeprefix(".")
        else:
            part, _, rest = rest.partition(".")
        if "'" in part or not part:
            raise ValueError(f"no path: {dotted!r}")
        parts.append(f"[{part}]" if part.isdigit() else f"['{part}']")
    return "$" + "".join(parts)


def at(doc: Column, dotted: str, kind: str = "double") -> Column:
    """The value at a dotted path, as kind; null if the path isn't there, leads to null or to something of another kind."""
    return F.try_variant_get(doc, path_of(dotted), kind)


def first_of(doc: Column, paths: tuple[str, ...], kind: str = "double") -> Column:
    """The value at the first path that has one."""
    return F.coalesce(*[at(doc, p, kind) for p in paths])


def by_position(doc: Column, paths: tuple[str, ...], position: Column, kind: str = "double") -> Column:
    """The value at a position (from 0) of the first list that has one there."""
    return F.coalesce(*[F.get(at(doc, p, f"array<{kind}>"), position.cast("int")) for p in paths])


def count_at(doc: Column, dotted: str) -> Column:
    """How many values a list has; 0 where there is none."""
    return F.coalesce(F.size(at(doc, dotted, "array<variant>")), F.lit(0))


def counted(doc: Column, paths: tuple[str, ...]) -> Column:
    """A count under the first name that has one: a histogram's values added up, or a single number; null where there is none."""
    one = lambda p: F.coalesce(F.aggregate(at(doc, p, "array<double>"), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), at(doc, p, "double"))
    return F.coalesce(*[one(p) for p in paths]).cast("long")
