"""File-name columns: path parts, version-free base names, revision marks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docket import fixed_values as fv

HAS_SUFFIX = r"^.+\.[^.]+$"


def py(pattern: str, fold: bool = False) -> str:
    """A pattern under the flags that give Unicode classes, Unicode case folding and newline-only line ends."""
    return f"(?{'i' if fold else ''}duU){pattern}"


def suffix(name: Column) -> Column:
    """Lower-case extension with its dot; '' for names without one or with only a leading dot."""
    return F.when(name.rlike(HAS_SUFFIX), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))).otherwise("")


def stem(name: Column) -> Column:
    return F.when(name.rlike(HAS_SUFFIX), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def norm_basename(name: Column, keep_empty: bool = False) -> Column:
    """The name all versions of a file share. A name made of marks only keeps its lower-case stem, so that unrelated
    files called 'Final' or 'Draft' are not taken for versions of each other; ``keep_empty`` switches that off."""
    low = F.lower(stem(name))
    base = reduce(lambda c, p: F.regexp_replace(c, py(p), ""), fv.VERSION_MARKS, low)
    return base if keep_empty else F.when(base == "", low).otherwise(base)


def is_revised(text: Column) -> Column:
    return F.lower(text).rlike(py(fv.REVISED))


def is_marked(name: Column) -> Column:
    return F.lower(name).contains("marked")


def revision_base(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(stem(name)), py(fv.REVISION_MARKS), ""), F.lit(" \t\n\r\f\u000b"))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w\s\-.]", "_")
