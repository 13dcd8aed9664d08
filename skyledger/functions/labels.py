"""Label and name scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_label(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(raw)), "[- ]", "_")


def slug(text: Column, longest: int = 60) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    s = F.regexp_replace(F.substring(s, 1, longest), "_+$", "")
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, F.lit("unnamed")).otherwise(s)
