"""Hexadecimal identifiers, whose case and surrounding blanks carry no meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_id(c: Column | str) -> Column:
    """Lower-case, trimmed; a blank is null."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(F.trim(c))
    return F.when(t != "", t)
