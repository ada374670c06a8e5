"""Columns that are worked out once per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns through a one-element ``inline``. The optimizer copies a plain projected expression into every filter
    and join condition that reads it; a generated column it reads by name. Worth it for long expressions only, such as
    a rule cascade, that many later steps refer to."""
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
