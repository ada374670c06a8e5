"""Table schemas and the small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket import fixed_values as fv

MANIFEST = (
    "report_id bigint, pos bigint, doc_id bigint, filename string, category string, subcategory string, "
    "start_page bigint, end_page bigint, page_count bigint"
)
FILINGS = (
    "doc_id bigint, report_id bigint, original_filename string, original_path string, ext string, file_size bigint, "
    "page_count int, category string, subcategory string, confidence double, reasoning string, sort_order int, "
    "status string, is_included boolean, modified_at timestamp, created_at timestamp"
)
MANIFEST_JSON = (
    "array<struct<doc_id:bigint,filename:string,category:string,subcategory:string,"
    "start_page:bigint,end_page:bigint,page_count:bigint>>"
)
VERDICT = "category string, subcategory string, confidence double, reasoning string"
PARAMS = "struct<doc_ids:array<bigint>,target_section:string,reason:string,query:string>"
ACTIONS = f"array<struct<action:string,params:{PARAMS}>>"

SECTION_NAMES = [name for name, _ in fv.SECTIONS]
ALL_SECTIONS = [*SECTION_NAMES, fv.UNCLASSIFIED[0]]


def section_dim(spark: SparkSession, unclassified: bool = True) -> DataFrame:
    rows = [(n, i + 1, label) for i, (n, label) in enumerate(fv.SECTIONS)]
    if unclassified:
        rows.append((fv.UNCLASSIFIED[0], len(rows) + 1, fv.UNCLASSIFIED[1]))
    return spark.createDataFrame(rows, "section string, section_pos int, display string")


def section_range(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        fv.SECTION_RANGES, "section string, min_pages int, max_pages int, min_docs int, max_docs int"
    )


def section_alias(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.SECTION_ALIASES, "alias string, section string")


def ext_dim(spark: SparkSession) -> DataFrame:
    """Extension, converter and next step: already pages, convert, or left to the caller (archives)."""
    rows = [(e, c, "ready" if c is None else "convert") for e, c in fv.SUPPORTED_EXTENSIONS]
    rows += [(e, None, "expand") for e in fv.ARCHIVE_EXTENSIONS]
    return spark.createDataFrame(rows, "ext string, converter string, action string")


def position_of(column: Column, values: list[str], otherwise: int | None = None) -> Column:
    """1-based place of a value in a short fixed list."""
    where = F.array_position(F.array(*[F.lit(v) for v in values]), column).cast("int")
    return F.when(F.coalesce(where, F.lit(0)) > 0, where).otherwise(F.lit(otherwise).cast("int"))


def known_section(column: Column) -> Column:
    return column.isin(*ALL_SECTIONS)
