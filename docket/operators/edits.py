"""Edits of structured text: paragraphs made of runs, kept as nested arrays. All of them work inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks_to_html(df: DataFrame, paras: str = "paras", tables: str = "tables") -> DataFrame:
    """Paragraphs (text, style) and tables (rows of cells) as HTML. A heading's level is the last character of its style
    where that is a digit."""
    level = lambda p: F.when(
        F.substring(p.style, -1, 1).rlike("[0-9]"), F.regexp_extract(p.style, r"(\S+)\s*$", 1)
    ).otherwise("1")

    def para(p: Column) -> Column:
        tag = F.when(p.style.contains("Heading"), F.concat(F.lit("h"), level(p))).otherwise("p")
        return F.concat(F.lit("<"), tag, F.lit(' class="docx-para">'), p.text, F.lit("</"), tag, F.lit(">"))

    def row(cells: Column) -> Column:
        body = F.transform(cells, lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>")))
        return F.concat(F.array(F.lit("<tr>")), body, F.array(F.lit("</tr>")))

    def table(rows: Column) -> Column:
        return F.concat(F.array(F.lit('<table class="docx-table">')), F.flatten(F.transform(rows, row)), F.array(F.lit("</table>")))

    parts = F.concat(
        F.array(F.lit('<div class="docx-preview">')),
        F.transform(paras, para),
        F.flatten(F.transform(tables, table)),
        F.array(F.lit("</div>")),
    )
    return df.withColumn("html", F.array_join(parts, "\n"))


def text_replace(df: DataFrame, find: str, replace: str, paras: str = "paras") -> DataFrame:
    """Replace text within runs; text that spans runs is left. ``replacements`` counts changed runs."""

    def edit(p: Column) -> Column:
        runs = F.transform(p.runs, lambda r: F.struct(F.replace(r.text, F.lit(find), F.lit(replace)).alias("text"), r.bold.alias("bold"), r.italic.alias("italic")))
        text = F.array_join(F.transform(runs, lambda r: r.text), "")
        return F.struct(text.alias("text"), p.style.alias("style"), runs.alias("runs"))

    hits = F.transform(paras, lambda p: F.size(F.filter(p.runs, lambda r: r.text.contains(find))))
    return df.withColumns(
        {"replacements": F.aggregate(hits, F.lit(0), lambda a, x: a + x), paras: F.transform(paras, edit)}
    )


def rewrite_runs(df: DataFrame, edits: str = "edits", paras: str = "paras") -> DataFrame:
    """Rewrite paragraphs by place: with as many runs as before, run by run (null bold and italic keep the old ones);
    otherwise the whole text goes into the first run and the rest are emptied. Edits beyond the last paragraph are
    dropped, paragraphs without an edit stay."""

    def run(old: Column, new: Column) -> Column:
        return F.struct(
            new.text.alias("text"), F.coalesce(new.bold, old.bold).alias("bold"), F.coalesce(new.italic, old.italic).alias("italic")
        )

    def whole(old: Column, text: Column) -> Column:
        first = F.transform(
            old.runs,
            lambda r, i: F.struct(F.when(i == 0, text).otherwise("").alias("text"), r.bold.alias("bold"), r.italic.alias("italic")),
        )
        added = F.array(F.struct(text.alias("text"), F.lit(None).cast("boolean").alias("bold"), F.lit(None).cast("boolean").alias("italic")))
        return F.when((F.size(old.runs) == 0) & (text != ""), added).otherwise(first)

    def para(old: Column, new: Column) -> Column:
        runs = F.when(F.size(old.runs) == F.size(new.runs), F.zip_with(old.runs, new.runs, run)).otherwise(whole(old, new.text))
        runs = F.when(new.isNull(), old.runs).otherwise(runs)
        text = F.array_join(F.transform(runs, lambda r: r.text), "")
        return F.struct(F.when(new.isNull(), old.text).otherwise(text).alias("text"), old.style.alias("style"), runs.alias("runs"))

    same_length = F.slice(F.col(edits), 1, F.size(paras))
    return df.withColumn(paras, F.zip_with(F.col(paras), same_length, para))
