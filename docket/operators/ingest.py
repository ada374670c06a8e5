"""Getting files in: eligibility, upsert by name, conversion routing, page counts, retries, JSON text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket import fixed_values as fv
from docket.functions import names
from docket.functions.rules import standard_rules, rule_columns
from docket.operators.scan import group_join
from docket.schema import ext_dim


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Recursive listing without contents: only path, size and time are read. Eligible files only."""
    return listed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), path)


def stream_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The same of files that arrive anywhere below a folder, as a stream: each file once, ``max_files`` per batch."""
    shape = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(shape).option("recursiveFileLookup", True)
    return listed(reader.option("maxFilesPerTrigger", max_files).load(path), path)


def listed(files: DataFrame, path: str) -> DataFrame:
    """Eligible files of a listing of whole files below ``path``; contents are not read, as nothing asks for them. Files
    of no bytes, which hold nothing to take in, are passed over by Spark's reader."""
    listing = files.select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"))
    # Paths come back with the scheme and host spelled otherwise than asked for.
    root = files.sparkSession._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")
    rel = F.regexp_replace("path", r"^.*?" + names_literal(root) + "/", "")
    files = listing.select(
        F.element_at(F.split("path", "/"), -1).alias("original_filename"), rel.alias("original_path"), "file_size", "modified_at"
    )
    return eligible(files)


def names_literal(text: str) -> str:
    """``text`` as a literal inside a pattern."""
    return r"\Q" + text + r"\E"


def eligible(files: DataFrame, exts: DataFrame | None = None) -> DataFrame:
    """Files worth taking in: no folders, no resource forks, known extension and not on the skip list."""
    name, path = F.col("original_filename"), F.coalesce(F.col("original_path"), F.lit(""))
    kept = files.withColumn("ext", names.suffix(name)).filter(
        (name != "")
        & ~name.startswith("._")
        & ~path.endswith("/")
        & ~path.contains("__MACOSX")
        & ~F.col("ext").isin(*fv.SKIPPED_EXTENSIONS)
    )
    known = (exts if exts is not None else ext_dim(files.sparkSession)).select("ext")
    return kept.join(F.broadcast(known), "ext", "left_semi")


def upsert_filings(base: DataFrame, batch: DataFrame) -> DataFrame:
    """Replace by (report, name). The first filing of a name keeps its id, inclusion and order and takes the new size,
    path and name-rule section; new names become new filings under the batch's ids. Within a batch the last one wins.

    The result has all columns of ``base``: a replaced filing keeps its page count, dates and whatever else the upload does
    not say, and a new one has nulls there, and its extension, and the batch's ``modified_at`` and ``created_at`` where it has
    them.

    Both sides of the matching join are unique on the key, so many copies of one name cannot pile up in it."""
    key = ["report_id", "original_filename"]
    dates = [c for c in ("modified_at", "created_at") if c in batch.columns]
    latest = batch.groupBy(*key).agg(
        F.max_by(F.struct("doc_id", "original_path", "file_size", *dates), F.col("seq")).alias("new")
    )
    fields = {"doc_id": "new_id", "original_path": "new_path", "file_size": "new_size", **{c: f"new_{c}" for c in dates}}
    latest = latest.select(*key, *[F.col(f"new.{c}").alias(n) for c, n in fields.items()])
    latest = rule_columns(latest, standard_rules(), "original_filename", "new_path", None, "rule_")
    first = base.groupBy(*key).agg(F.min("doc_id").alias("old_id"))
    change = latest.join(first, key, "left").select(
        *key,
        F.coalesce("old_id", "new_id").alias("doc_id"),
        F.col("old_id").isNull().alias("is_new"),
        "new_path",
        "new_size",
        *[f"new_{c}" for c in dates],
        "rule_category",
        "rule_subcategory",
        "rule_confidence",
        "rule_reason",
    )
    placed = {
        "category": F.coalesce("rule_category", F.lit(fv.UNCLASSIFIED[0])),
        "subcategory": F.col("rule_subcategory"),
        "confidence": F.col("rule_confidence"),
        "reasoning": F.col("rule_reason"),
        "status": F.lit("uploaded"),
    }
    columns = base.columns
    hit = F.col("is_new").isNotNull()
    kept = (
        base.join(change.filter(~F.col("is_new")).drop(*key), "doc_id", "left")
        .withColumns(
            {
                "original_path": F.when(hit & (F.coalesce("new_path", F.lit("")) != ""), F.col("new_path")).otherwise(
                    F.col("original_path")
                ),
                "file_size": F.when(hit, F.col("new_size")).otherwise(F.col("file_size")),
                **{c: F.when(hit, v).otherwise(F.col(c)) for c, v in placed.items()},
            }
        )
        .select(*columns)
    )
    added = change.filter("is_new").select(
        "doc_id", *key, F.expr("nullif(new_path, '')").alias("original_path"), F.col("new_size").alias("file_size"),
        *[v.alias(c) for c, v in placed.items()], F.lit(0).alias("sort_order"), F.lit(True).alias("is_included"),
        *[F.col(f"new_{c}").alias(c) for c in dates if c in columns],
        *([names.suffix(F.col("original_filename")).alias("ext")] if "ext" in columns else []),
    )
    return kept.unionByName(added, allowMissingColumns=True)


def conversion_plan(filings: DataFrame) -> DataFrame:
    """Converter and next step by extension; an unknown extension is an error."""
    dim = F.broadcast(ext_dim(filings.sparkSession).filter("action <> 'expand'"))
    return filings.join(dim, "ext", "left").withColumn("next_step", F.coalesce("action", F.lit("error"))).drop("action")


def page_counts(doc_pages: DataFrame, filings: DataFrame) -> DataFrame:
    """Pages per filing, 0 for those without a readable page."""
    counted = doc_pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    return filings.select("doc_id").join(counted, "doc_id", "left").withColumn(
        "pages", F.coalesce("pages", F.lit(0).cast("long"))
    )


def output_name(reports: DataFrame) -> DataFrame:
    """File name of a report's output: project number, else name, made safe."""
    base = F.coalesce(F.expr("nullif(project_number, '')"), F.col("name"))
    return reports.withColumn("output_name", names.safe_file_name(F.concat(base, F.lit("_assembled.pdf"))))


def write_outputs(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per report. Reports are gathered into few files each, and a big one is split by its bytes over several."""
    df.hint("rebalance", "report_id").write.mode("overwrite").partitionBy("report_id").format(fmt).save(path)


def to_json_col(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Fold ``fields`` into one JSON text column."""
    return df.withColumn(column, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).drop(*fields)


def from_json_col(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Read a JSON text column; unreadable text gives nulls."""
    return df.withColumn(column, F.from_json(column, schema, {"mode": "PERMISSIVE"}))


def retry_queue(filings: DataFrame, sources: DataFrame) -> DataFrame:
    """Filings in error whose source file is still there."""
    return filings.filter("status = 'error'").join(sources.select("doc_id"), "doc_id", "left_semi")


def apply_retry(filings: DataFrame, results: DataFrame) -> DataFrame:
    """Filings after a retry; ``results`` lists (doc_id, pages) of the conversions that worked."""
    fixed = results.select("doc_id", F.col("pages").alias("new_pages"))
    ok = (F.col("status") == "error") & F.col("new_pages").isNotNull()
    return (
        filings.join(fixed, "doc_id", "left")
        .withColumns(
            {
                "retried": ok,
                "page_count": F.when(ok, F.col("new_pages")).otherwise(F.col("page_count")),
                "status": F.when(ok, "ready").otherwise(F.col("status")),
            }
        )
        .drop("new_pages")
    )


def retry_summary(filings: DataFrame, results: DataFrame) -> DataFrame:
    after = apply_retry(filings, results)
    return after.groupBy("report_id").agg(
        F.count_if("retried").alias("fixed"), F.count_if(F.col("status") == "error").alias("remaining_errors")
    )


def cascade_delete(children: DataFrame, deleted_reports: DataFrame) -> DataFrame:
    """Rows whose report is still there."""
    return group_join(children, deleted_reports.select("report_id").distinct(), ["report_id"], "left_anti")

