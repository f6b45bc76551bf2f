"""Surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def surrogate_key(*parts: Column | str) -> Column:
    """Hex MD5 over the ``|``-joined text of the parts; NULL parts hash as ``_null_``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("_null_")) for c in cols]))
