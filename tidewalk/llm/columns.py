"""Names of columns that can't clash with those of an input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` behind so many underscores that no column of ``df`` begins with them."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return [prefix + name for name in names]
