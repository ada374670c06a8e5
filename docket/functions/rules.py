"""Filename rules as data, compiled to one column expression.

A rule pack is a list of rules in priority order; the first that matches wins. Compiling gives a single CASE over the
name, folder and stem columns, evaluated in one pass over the rows: no join against the rules and no Python per row. Rules in
a table are matched by ``docket.operators.search`` instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket import fixed_values as fv
from docket.functions import names
from docket.functions.once import once

# Rules of one CASE expression; a longer pack is several, and the first that finds a rule counts.
CASE_RULES = 300


class Rule(NamedTuple):
    prio: int
    scope: str  # image, divider, name, folder, camera: which text the pattern reads, on which files
    pattern: str
    category: str
    subcategory: str | None
    confidence: float
    sort_order: int | None
    reason: str


RULE_FIELDS = ["category", "subcategory", "confidence", "sort_order", "reason"]
RULE_SCHEMA = (
    "prio int, scope string, pattern string, category string, subcategory string, confidence double, "
    "sort_order int, reason string"
)


def standard_rules() -> list[Rule]:
    """The standard pack, strongest first."""
    letters = "abcdef"
    found: list[tuple] = []
    found += [("image", p, c, s, 0.92, None, f"Image file + filename match: {r}") for p, c, s, r in fv.IMAGE_RULES]
    found += [("image", "", "APPENDIX_E", None, 0.90, None, "Image file — supporting evidence")]
    found += [
        ("divider", rf"^appendix\s*{x}\b", f"APPENDIX_{x.upper()}", None, 0.95, -1, "Appendix cover/divider page")
        for x in letters
    ]
    quals = "Filename indicates Appendix F - Qualifications"
    found += [("name", r"^appendix.*qualifications", "APPENDIX_F", None, 0.95, None, quals)]
    found += [
        ("name", rf"^appendix {x}", f"APPENDIX_{x.upper()}", None, 0.90, None, f"Filename starts with 'appendix {x}'")
        for x in letters
    ]
    found += [("name", p, c, s, 0.90, None, f"Filename pattern match: {r}") for p, c, s, r in fv.NAME_RULES]
    found += [("folder", p, "REPORTS_AFTER_E", None, 0.85, None, f"Folder pattern match: {r}") for p, r in fv.FOLDER_RULES]
    found += [("body", r"esai.*\.(docx|pdf)$", "COVER_WRITEUP", None, 0.80, None, "ESAI report document (main body)")]
    found += [("camera", p, "APPENDIX_B", None, 0.90, None, "Generic camera photo filename") for p in fv.CAMERA_NAMES]
    return [Rule(i + 1, *r) for i, r in enumerate(found)]


def _quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else repr(value)


def rule_texts(name: str, path: str, size: str | None) -> dict[str, Column]:
    """What the patterns read, and which files each scope is for."""
    file, low = F.col(name), F.lower(name)
    divider = ~low.contains("qualifications")
    if size is not None:
        at = F.col(size)
        divider = (divider & (at == 0)) | ((at > 0) & (at < fv.DIVIDER_MAX_BYTES))
    for word in fv.DIVIDER_WORDS:
        divider = divider | low.contains(word)
    image = names.suffix(file).isin(*fv.IMAGE_EXTENSIONS)
    return {
        "__low": low,
        "__folder": F.lower(F.coalesce(F.col(path), F.lit(""))),
        "__stem": F.lower(names.stem(file)),
        "__image": image,
        "__divider": ~image & divider,
        "__body": ~image & ~low.rlike(names.py(fv.BODY_EXCLUDES)),
    }


# scope -> (which files, which text)
SCOPES = {
    "image": ("__image", "__low"),
    "divider": ("__divider", "__low"),
    "name": ("NOT __image", "__low"),
    "folder": ("NOT __image", "__folder"),
    "body": ("__body", "__low"),
    "camera": ("NOT __image", "__stem"),
}


def first_match(rules: Sequence[Rule]) -> Column:
    """1-based place of the first matching rule, null when none matches."""
    cases: list[str] = []
    for at, rule in enumerate(rules, 1):
        files, text = SCOPES[rule.scope]
        hit = f" AND {text} RLIKE {_quoted(names.py(rule.pattern))}" if rule.pattern else ""
        cases.append(f"WHEN {files}{hit} THEN {at}")
    packs = [cases[i : i + CASE_RULES] for i in range(0, len(cases), CASE_RULES)]
    return F.expr(f"COALESCE({', '.join(f'CASE {" ".join(p)} END' for p in packs)}, NULL)")


def first_rule(rules: Sequence[Rule]) -> Column:
    """The first matching rule as a struct of its fields, over the columns of ``rule_texts``."""
    rows = ", ".join(f"struct({', '.join(map(_quoted, r))})" for r in rules)
    kind = f"struct<{', '.join(f'{f.split()[0]}: {f.split()[1]}' for f in RULE_SCHEMA.split(', '))}>"
    if not rules:
        return F.lit(None).cast(kind)
    return F.get(F.expr(f"array({rows})").cast(f"array<{kind}>"), first_match(rules) - 1)


def rule_columns(df: DataFrame, rules: Sequence[Rule], name: str, path: str, size: str | None, prefix: str) -> DataFrame:
    """Add the winning rule's fields as ``prefix``-columns. The texts and the rule's place are worked out once per row;
    the fields are looked up in literal arrays."""
    texts = rule_texts(name, path, size)
    found = once(once(df, texts), {"__rule": first_match(rules)}).drop(*texts)

    def field(values, kind: str) -> Column:
        return F.expr(f"CAST(get(array({', '.join(map(_quoted, values))}), __rule - 1) AS {kind})")

    return found.withColumns(
        {
            f"{prefix}category": field([r.category for r in rules], "string"),
            f"{prefix}subcategory": field([r.subcategory for r in rules], "string"),
            f"{prefix}confidence": field([float(r.confidence) for r in rules], "double"),
            f"{prefix}sort_order": field([r.sort_order for r in rules], "int"),
            f"{prefix}reason": field([r.reason for r in rules], "string"),
        }
    ).drop("__rule")
