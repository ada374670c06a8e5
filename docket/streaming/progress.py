"""Incremental forms: arriving files, repeated arrivals, progress figures, state per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docket import fixed_values as fv
from docket.operators.classify import classify_by_name
from docket.operators.ingest import eligible, stream_files
from docket.operators.scan import group_join, ordered_scan

ARRIVAL = "report_id bigint, original_filename string, original_path string, file_size bigint, arrived_at timestamp"


def stream_ingest(spark: SparkSession, path: str, schema: str = ARRIVAL, max_files: int = 1000) -> DataFrame:
    """Files arriving as rows of a parquet folder, filtered and placed by their names as they come. Stateless."""
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    placed = classify_by_name(eligible(arrivals))
    return placed.withColumns(
        {"category": F.coalesce("rule_category", F.lit(fv.UNCLASSIFIED[0])), "status": F.lit("uploaded")}
    )


def stream_folder(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Files arriving anywhere below a folder, filtered and placed by their names and folders as they come, contents unread."""
    placed = classify_by_name(stream_files(spark, path, max_files))
    return placed.withColumns({"category": F.coalesce("rule_category", F.lit(fv.UNCLASSIFIED[0])), "status": F.lit("uploaded")})


def stream_dedupe(stream: DataFrame, horizon: str = "1 hour", at: str = "arrived_at") -> DataFrame:
    """One arrival per (report, name) within the horizon; state older than that is dropped."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark(["report_id", "original_filename"])


def progress_windows(events: DataFrame, watermark: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per report, phase and time window; the same on a stream and on a table."""
    timed = events.withWatermark("ts", watermark) if events.isStreaming else events
    return (
        timed.groupBy("report_id", "phase", F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
        .select("report_id", "phase", F.col("w.start").alias("window_start"), "n", "last_ts")
    )


def state_writer(path: str, key: list[str], order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that folds each batch into a parquet table of the latest row per key; of rows with equal
    ``order`` the one with the larger other columns counts.

    Keys are dealt into buckets by hash. A batch reads and writes the buckets that its keys fall into and no others, under a
    folder named by the batch, so a replayed batch writes its own folder again from the versions before it. A bucket's two
    last versions are kept."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        touched = [r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        versions = state_versions(spark, path, upto=batch_id)
        held = [f"{path}/v={versions[b][-1]}/bucket={b}" for b in touched if b in versions]
        rows = spark.read.schema(batch.schema).parquet(*held).unionByName(batch) if held else batch
        others = [order, *[c for c in rows.columns if c not in key and c != order]]
        latest = rows.groupBy(*key).agg(F.max(F.struct(*others)).alias("r")).select(*key, "r.*").select(*batch.columns)
        dealt = latest.withColumn("bucket", bucket).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={batch_id}")
        _, fs = _files(spark, path)
        for b in touched:
            for old in versions.get(b, [])[:-1]:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={old}/bucket={b}"), True)

    return write


def _files(spark: SparkSession, pattern: str):
    """What matches a pattern, through the file system of the path, and that file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(f.getPath()) for f in fs.globStatus(at) or []], fs


def state_versions(spark: SparkSession, path: str, upto: int | None = None) -> dict[int, list[int]]:
    """bucket -> its versions in order. A version counts once its success marker is there."""
    done = {m.split("/v=")[-1].split("/")[0] for m in _files(spark, f"{path}/v=*/_SUCCESS")[0]}
    out: dict[int, list[int]] = {}
    for folder in _files(spark, f"{path}/v=*/bucket=*")[0]:
        version, bucket = folder.split("/v=")[-1].split("/bucket=")
        if version in done and (upto is None or int(version) < upto):
            out.setdefault(int(bucket), []).append(int(version))
    return {bucket: sorted(versions) for bucket, versions in out.items()}


def read_state(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The state as it is now: the last version of every bucket."""
    folders = [f"{path}/v={v[-1]}/bucket={b}" for b, v in state_versions(spark, path).items()]
    reader = spark.read.schema(schema)
    return reader.parquet(*folders) if folders else spark.createDataFrame([], schema)


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()


def progress_running(events: DataFrame, phase: str = "classified", group_rows: int | None = None) -> DataFrame:
    """Done so far and in all, per report, as each document is finished."""
    done = events.filter(F.col("phase") == phase).select("report_id", "ts", "event_id", "filename")
    totals = done.groupBy("report_id").agg(F.count(F.lit(1)).alias("total"))
    numbered = ordered_scan(done, ["report_id"], ["ts", "event_id"], position="current", group_rows=group_rows)
    return group_join(numbered, totals, ["report_id"])


def progress_log(events: DataFrame, group_rows: int | None = None) -> DataFrame:
    """The log a user sees: of 'classifying' lines in a row only the last stays, and the log starts afresh when
    classification is entered from another phase."""
    order = ["ts", "event_id"]
    slim = events.select("report_id", *order, "phase", "filename")
    steps = ordered_scan(slim, ["report_id"], order, lags={"prev_phase": F.col("phase")}, group_rows=group_rows)
    enters = (F.col("phase") == "classifying") & ~F.coalesce("prev_phase", F.lit("")).isin("classifying", "classified")
    resets = steps.filter(enters).groupBy("report_id").agg(F.max(F.struct(*order)).alias("reset"))
    lines = slim.filter(F.col("phase").isin("classifying", "classified", "processed"))
    near = ordered_scan(lines, ["report_id"], order, leads={"next_phase": F.col("phase")}, group_rows=group_rows)
    hidden = (F.col("phase") == "classifying") & (F.coalesce("next_phase", F.lit("")) == "classifying")
    return (
        group_join(near, resets, ["report_id"], "left")
        .filter(~hidden & (F.col("reset").isNull() | (F.struct(*order) >= F.col("reset"))))
        .select("report_id", "event_id", "phase", "filename")
    )
