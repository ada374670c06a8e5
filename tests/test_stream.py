import datetime as dt

from docket.operators import ingest
from docket.streaming import progress

T0 = dt.datetime(2024, 1, 1)


def arrivals(spark, rows, path):
    data = [(1, n, f"in/{n}", 10, T0 + dt.timedelta(minutes=m)) for n, m in rows]
    spark.createDataFrame(data, progress.ARRIVAL).write.mode("append").parquet(path)


def test_ingest_classifies_new_files_only_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    arrivals(spark, [("sanborn.pdf", 0), ("x.mov", 1), ("._y.pdf", 2)], src)
    progress.start(progress.stream_ingest(spark, src), out, ck).awaitTermination()
    arrivals(spark, [("radius.pdf", 3)], src)
    progress.start(progress.stream_ingest(spark, src), out, ck).awaitTermination()
    got = sorted((r.original_filename, r.category) for r in spark.read.parquet(out).collect())
    assert got == [("radius.pdf", "APPENDIX_C"), ("sanborn.pdf", "APPENDIX_D")]


def test_repeated_arrivals(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    arrivals(spark, [("a.pdf", 0), ("a.pdf", 10), ("b.pdf", 5)], src)
    stream = spark.readStream.schema(progress.ARRIVAL).parquet(src)
    progress.start(progress.stream_dedupe(stream), out, ck).awaitTermination()
    assert sorted(r.original_filename for r in spark.read.parquet(out).collect()) == ["a.pdf", "b.pdf"]


EVENTS = "report_id bigint, event_id bigint, ts timestamp, phase string, filename string"


def test_windows_on_a_stream_and_a_table(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    rows = [(1, i, T0 + dt.timedelta(hours=i), "classified", f"f{i}") for i in range(100)]
    df = spark.createDataFrame(rows, EVENTS)
    df.write.parquet(src)
    stream = spark.readStream.schema(EVENTS).parquet(src)
    progress.start(progress.progress_windows(stream), out, ck).awaitTermination()
    whole = {r.window_start: r.n for r in progress.progress_windows(df).collect()}
    closed = {r.window_start: r.n for r in spark.read.parquet(out).collect()}
    assert closed and closed.items() <= whole.items()


def test_state_versions_survive_a_replayed_batch(spark, tmp_path):
    path = str(tmp_path / "state")
    write = progress.state_writer(path, ["report_id", "doc_id"], "seq")
    schema = "report_id int, doc_id int, seq int, status string"
    write(spark.createDataFrame([(1, 1, 1, "uploaded"), (1, 2, 1, "uploaded")], schema), 0)
    second = spark.createDataFrame([(1, 1, 2, "ready")], schema)
    write(second, 1)
    write(second, 1)
    write(spark.createDataFrame([(1, 1, 3, "done"), (1, 1, 3, "abc")], schema), 2)
    got = sorted((r.doc_id, r.status) for r in progress.read_state(spark, path, schema).collect())
    assert got == [(1, "done"), (2, "uploaded")]
    # The third batch has touched one bucket, and left its first version behind.
    versions = sorted(progress.state_versions(spark, path).values())
    assert versions == [[0], [1, 2]]


def test_log(spark):
    phases = ["processed", "classifying", "classifying", "classified", "validating", "classifying", "classified"]
    rows = [(1, i, T0 + dt.timedelta(minutes=i), p, f"f{i}") for i, p in enumerate(phases)]
    for limit in (None, 2):
        got = progress.progress_log(spark.createDataFrame(rows, EVENTS), group_rows=limit)
        assert sorted(r.event_id for r in got.collect()) == [5, 6]


def test_folder_listing(spark, tmp_path):
    for name in ("a.pdf", "sub/b.docx", "sub/c.mov", "sub/._d.pdf", "notes.xyz"):
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_bytes(b"12345")
    df = ingest.list_files(spark, str(tmp_path))
    assert sorted((r.original_filename, r.original_path, r.file_size) for r in df.collect()) == [("a.pdf", "a.pdf", 5), ("b.docx", "sub/b.docx", 5)]
    assert "content" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_outputs_by_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "report_id int, name string")
    ingest.write_outputs(df, str(tmp_path / "o"), "json")
    assert sorted(p.name for p in (tmp_path / "o").glob("report_id=*")) == ["report_id=1", "report_id=2"]


def test_a_folder_as_a_stream(spark, tmp_path):
    """Files below a folder, each taken once, by name and folder; the folder may be named with a scheme."""
    src, out, ck = (tmp_path / x for x in ("src", "out", "ck"))
    (src / "box" / "old").mkdir(parents=True)
    for name, text in (("sanborn.pdf", "x" * 7), ("box/old/radius.PDF", "y"), ("box/._z.pdf", "z"), ("box/film.mov", "z"), ("box/a b [1].txt", "q"), ("none.txt", "")):
        (src / name).write_text(text)
    progress.start(progress.stream_folder(spark, f"file://{src}"), str(out), str(ck)).awaitTermination()
    (src / "box" / "late.pdf").write_text("late")
    progress.start(progress.stream_folder(spark, f"file://{src}"), str(out), str(ck)).awaitTermination()
    got = sorted((r.original_path, r.original_filename, r.file_size, r.category) for r in spark.read.parquet(str(out)).collect())
    assert [g[:3] for g in got] == [("box/a b [1].txt", "a b [1].txt", 1), ("box/late.pdf", "late.pdf", 4), ("box/old/radius.PDF", "radius.PDF", 1), ("sanborn.pdf", "sanborn.pdf", 7)]
    assert [g[3] for g in got][2:] == ["APPENDIX_C", "APPENDIX_D"]
    assert "content" not in ingest.list_files(spark, str(src))._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_a_big_report_is_written_by_many_tasks(spark):
    """The texts of one report, however many, do not pass one task on their way into its folder."""
    from pathlib import Path

    from docket.catalog import QUERIES
    from docket.session import scratch_dir

    place = Path(scratch_dir(spark).removeprefix("file:"))
    before = set(place.glob("*/in"))
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10k",
        "spark.sql.autoBroadcastJoinThreshold": -1, "spark.sql.adaptive.autoBroadcastJoinThreshold": -1,
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        got = QUERIES["stream_folder"](spark, "/root/testdata/sf0.01").collect()
    finally:
        for key in small:
            spark.conf.unset(key)
    (folder,) = set(place.glob("*/in")) - before
    files = list((folder / "report_id=0").glob("*.txt"))
    assert len(files) > 2 and {r.report_id: r.bytes for r in got}[0] == sum(f.stat().st_size for f in files)
