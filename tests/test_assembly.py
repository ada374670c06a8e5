import random

from pyspark.sql import functions as F

from docket.operators import assemble, curate

GOLDEN = [
    ("EO_INSURANCE", 1, 1), ("COVER_WRITEUP", 46, 2), ("APPENDIX_A", 3, 48), ("APPENDIX_B", 7, 51), ("APPENDIX_C", 1257, 58),
    ("APPENDIX_D", 188, 1315), ("APPENDIX_E", 196, 1503), ("APPENDIX_F", 4, 1699),
]


def reports_of(spark, reliance=True, n=1):
    return spark.createDataFrame([(i + 1, reliance) for i in range(n)], "report_id bigint, has_reliance_letter boolean")


def test_golden_report(spark, filings):
    rows = [{"original_filename": f"{s}.pdf", "category": s, "page_count": n} for s, n, _ in reversed(GOLDEN)]
    got = assemble.manifest(filings(*rows), reports_of(spark)).orderBy("pos").collect()
    assert [(r.category, r.page_count, r.start_page) for r in got] == GOLDEN
    assert got[-1].end_page == 1702


def test_order_within_sections(spark, filings):
    df = filings(
        {"original_filename": "z.pdf", "category": "APPENDIX_D", "subcategory": "sanborn"},
        {"original_filename": "a.pdf", "category": "APPENDIX_D", "subcategory": "topos"},
        {"original_filename": "b.pdf", "category": "APPENDIX_D"},
        {"original_filename": "letter.pdf", "sort_order": 0},
        {"original_filename": "Property Profile.pdf", "sort_order": 1},
        {"original_filename": "Appendix E.pdf", "sort_order": -1},
        {"original_filename": "x.pdf", "category": "REPORTS_AFTER_E", "original_path": "GeoTracker/x.pdf"},
        {"original_filename": "y.pdf", "category": "REPORTS_AFTER_E", "original_path": "BLA-1/y.pdf"},
    )
    names = lambda **kw: [r.original_filename for r in assemble.assembly_order(df, reports_of(spark), **kw).orderBy("pos").collect()]
    head, tail = ["z.pdf", "a.pdf", "b.pdf"], ["y.pdf", "x.pdf"]
    assert names() == [*head, "Appendix E.pdf", "Property Profile.pdf", "letter.pdf", *tail]
    assert names(strict=True) == [*head, "Appendix E.pdf", "letter.pdf", "Property Profile.pdf", *tail]


def test_natural_order(spark, filings):
    df = filings(*[{"original_filename": f"DSCN{n}.pdf", "category": "APPENDIX_B"} for n in (1595, 322, 99)])
    got = [r.original_filename for r in assemble.assembly_order(df, reports_of(spark), natural=True).orderBy("pos").collect()]
    assert got == ["DSCN99.pdf", "DSCN322.pdf", "DSCN1595.pdf"]


def test_everything_is_placed_or_omitted(spark, filings):
    rnd = random.Random(3)
    sections = ["RELIANCE_LETTER", "COVER_WRITEUP", "APPENDIX_D", "UNCLASSIFIED"]
    df = filings(*[{"category": rnd.choice(sections), "report_id": rnd.randrange(1, 4), "status": rnd.choice(["ready", "error"])} for _ in range(80)])
    reports = reports_of(spark, False, 3)
    placed, left = assemble.assembly_order(df, reports), assemble.omitted(df, reports)
    ids = [r.doc_id for r in placed.collect()] + [r.doc_id for r in left.collect()]
    assert sorted(ids) == sorted(r.doc_id for r in assemble.assembly_candidates(df).collect())


def test_manifest_of_a_hot_report_is_the_same_in_slices(spark, filings):
    rnd = random.Random(5)
    df = filings(*[{"report_id": 1 if i % 3 else 2, "original_filename": f"{rnd.randrange(50)}.pdf", "page_count": rnd.randrange(0, 9)} for i in range(400)])
    reports = reports_of(spark, n=2)
    plain, sliced = assemble.manifest(df, reports), assemble.manifest(df, reports, group_rows=20)
    assert sorted(map(str, plain.collect())) == sorted(map(str, sliced.collect()))
    rows = plain.filter("report_id = 1").orderBy("pos").collect()
    assert rows[0].start_page == 1 and all(b.start_page == a.end_page + 1 for a, b in zip(rows, rows[1:]))
    near = assemble.manifest_neighbours(plain, group_rows=20).filter("report_id = 1").orderBy("pos").collect()
    assert [r.prev_start for r in near[1:]] == [r.start_page for r in near[:-1]]


def test_page_stream_tiles_the_report(spark, filings):
    df = filings(*[{"original_filename": f"{i}.{'docx' if i % 2 else 'pdf'}"} for i in range(12)])
    df = df.withColumn("ext", F.regexp_extract("original_filename", r"(\.\w+)$", 1))
    pages = spark.createDataFrame(
        [(d, p, "long enough text" if p < 2 else " ", "", 10) for d in range(1, 13) for p in range(d % 5 + 1)],
        "doc_id bigint, page_no int, txt string, ocr_txt string, n_bytes bigint",
    )
    m = assemble.manifest(df, reports_of(spark), pages)
    stream = assemble.assembled_pages(m, pages)
    got = [r.global_page for r in stream.orderBy("global_page").collect()]
    assert got == list(range(1, m.agg(F.sum("page_count")).first()[0] + 1))
    refs = stream.select("report_id", F.col("global_page").alias("page"))
    assert assemble.page_lookup(m, refs, block=4).count() == len(got)


def test_dedupe_is_idempotent_and_skew_safe(spark, filings):
    rows = [{"original_filename": f"plan_v{i}.pdf"} for i in range(60)] + [{"original_filename": "other.pdf"}]
    df = filings(*rows).withColumn("modified_at", F.timestamp_seconds(F.pmod(F.col("doc_id") * 7, F.lit(61))))
    once = curate.dedupe_versions(df)
    assert once.filter("is_included").count() == 2
    assert sorted(map(str, curate.dedupe_versions(once).collect())) == sorted(map(str, once.collect()))
    assert sorted(map(str, curate.dedupe_versions(df).collect())) == sorted(map(str, once.collect()))


def test_supersede(spark, filings):
    df = filings(
        {"original_filename": "plan rev.pdf"}, {"original_filename": "plan.pdf"}, {"original_filename": "plan_draft.pdf"},
        {"original_filename": "other.pdf"}, {"original_filename": "plan-revised.pdf", "report_id": 2}, {"original_filename": "plan.pdf", "report_id": 2},
        {"original_filename": "plan_rev.pdf", "report_id": 3}, {"original_filename": "plan.pdf", "report_id": 3},
    )
    for limit in (None, 2):
        got = {r.doc_id for r in curate.supersede_revised(df).filter("superseded").collect()}
        assert got == {2, 3, 6}


def test_corrections(spark, filings):
    df = filings(
        {"confidence": 0.89}, {"confidence": 0.90}, {"category": "APPENDIX_A"}, {}, {"confidence": 0.5}, {"confidence": 0.5},
    )
    fixes = [
        (1, 1, "APPENDIX_D"), (2, 2, "APPENDIX_D"), (3, 3, "APPENDIX_A"), (4, 4, "COVER_WRITEUP"), (5, 99, "APPENDIX_D"),
        (6, 4, "NOWHERE"), (7, 5, "APPENDIX_B"), (8, 5, "APPENDIX_C"), (9, 5, "APPENDIX_C"), (10, 6, "APPENDIX_B"), (11, 6, "APPENDIX_E"),
    ]
    table = spark.createDataFrame([(1, s, d, c, f"why {s}") for s, d, c in fixes], "report_id bigint, seq int, doc_id bigint, suggested_section string, reason string")
    for limit in (None, 1):
        got = {r.doc_id: (r.category, r.confidence, r.reasoning, r.n_applied) for r in curate.apply_corrections(df, table, group_rows=limit).collect()}
        assert got[1] == ("APPENDIX_D", 0.85, "AI validator: why 1", 1)
        assert got[2][:2] == ("APPENDIX_E", 0.90) and got[3][3] == 0 and got[4][0] == "APPENDIX_E"
        assert got[5] == ("APPENDIX_C", 0.85, "AI validator: why 8", 2)
        assert got[6] == ("APPENDIX_E", 0.85, "AI validator: why 11", 2)


def replayed(order, moves):
    ids = list(order)
    for doc, kind, over in moves:
        at = ids.index(doc)
        to = at - 1 if kind == "up" else at + 1 if kind == "down" else ids.index(over)
        if 0 <= to < len(ids):
            ids.insert(to, ids.pop(at))
    return ids


def test_a_log_of_moves_equals_a_list(spark, filings, monkeypatch):
    monkeypatch.setattr(assemble, "PLACES", 7)
    r = random.Random(4)
    rows = [{"report_id": 1 + i % 2, "category": r.choice(["APPENDIX_A", "APPENDIX_B"]), "sort_order": r.randrange(20), "is_included": i % 9 > 0} for i in range(240)]
    df = filings(*rows)
    order, section = {}, {}
    for d in sorted(df.filter("is_included").collect(), key=lambda d: (d.sort_order, d.doc_id)):
        order.setdefault((d.report_id, d.category), []).append(d.doc_id)
        section[d.doc_id] = d.report_id, d.category
    log = [(r.choice(list(section)), r.choice(["up", "down", "to"]), r.choice(list(section))) for _ in range(900)]
    log += [(1, "up", None), (2, "sideways", None), (10**6, "down", None), (3, "to", None), (3, "to", 10**6)]
    table = spark.createDataFrame([(section.get(d, (1,))[0], i, d, k, o) for i, (d, k, o) in enumerate(log)], "report_id long, seq int, doc_id long, kind string, over_id long")
    want = {
        (*s, doc, i)
        for s, ids in order.items()
        for i, doc in enumerate(replayed(ids, [m for m in log if section.get(m[0]) == s and (m[1] in ("up", "down") or (m[1] == "to" and section.get(m[2]) == s and m[0] != m[2]))]))
    }
    assert {tuple(x) for x in assemble.move_log(df, table).collect()} == want


def test_a_log_on_a_long_section_knows_runs_only():
    got = assemble._replayer()([(10**9 - 1, "up", None), (5, "to", 10**8), (7, "down", None)], 10**9)
    assert sum(hi - lo for lo, hi, _ in got) == 10**9 and len(got) < 12
    assert {(lo, at) for lo, hi, at in got if hi - lo == 1} >= {(10**9 - 1, 10**9 - 2), (5, 10**8), (7, 7)}


def test_a_long_log_of_one_section_takes_no_time_per_place():
    """Every row of a long section moves: a walk over the section per move would take minutes."""
    import time

    n = 200_000
    log = [(p, "up", None) for p in range(1, n, 2)] + [(p, "down", None) for p in range(0, n, 3)] + [(0, "to", n - 1)]
    began = time.process_time()
    got = assemble._replayer()(log, n)
    assert time.process_time() - began < 12
    assert sum(hi - lo for lo, hi, _ in got) == n and sorted(at for _, _, at in got)[0] == 0


def test_logs_on_many_small_sections_equal_a_list():
    r = random.Random(11)
    for n in (1, 2, 3, 40, 700):
        named = r.sample(range(n), max(1, n // 3))
        for count in (n, 4 * n):
            log = [(r.choice(named), r.choice(["up", "down", "to"]), r.choice(named)) for _ in range(count)]
            want = replayed(range(n), [m for m in log if m[1] != "to" or m[0] != m[2]])
            got = [0] * n
            for lo, hi, at in assemble._replayer()(log, n):
                got[at : at + hi - lo] = range(lo, hi)
            assert got == want


def test_sections_that_go_over_many_batches(spark, filings):
    """Sections share a call, and the moves of one may come in several batches."""
    df = filings(*[{"report_id": i % 5, "category": "APPENDIX_A", "sort_order": 0} for i in range(60)])
    shown = sorted((d.report_id, d.doc_id) for d in df.collect())
    moves = [(r, s, d, "down", None) for s, (r, d) in enumerate(shown)]
    table = spark.createDataFrame(moves, "report_id long, seq int, doc_id long, kind string, over_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        log = assemble.move_log(df, table)
        assert "FlatMapGroups" not in log._jdf.queryExecution().optimizedPlan().toString()
        got = {tuple(x) for x in log.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for report in range(5):
        ids = [d for r, d in shown if r == report]
        want |= {(report, "APPENDIX_A", d, i) for i, d in enumerate(replayed(ids, [(d, "down", None) for d in ids]))}
    assert got == want
