import pytest
from pyspark.sql import functions as F

from docket.functions import metrics, names
from docket.functions.rules import RULE_SCHEMA, Rule, rule_columns, standard_rules
from docket.operators import search
from docket.operators.search import required
from docket.operators import classify
from docket.operators.assemble import natural_key

CASES = [
    ("Site Plot Plan.vsd", "", "APPENDIX_A", None, 0.90, None),
    ("aerial_1950.jpg", "", "APPENDIX_D", "aerials", 0.92, None),
    ("IMG_0001.jpg", "", "APPENDIX_E", None, 0.90, None),
    ("Appendix C divider.pdf", "", "APPENDIX_C", None, 0.95, -1),
    ("Appendix F - Qualifications.pdf", "", "APPENDIX_F", None, 0.95, None),
    ("appendix abc.pdf", "", "APPENDIX_A", None, 0.90, None),
    ("7001234-ESAI-Aerials_1.pdf", "", "APPENDIX_D", "aerials", 0.90, None),
    ("7001234-ESAI-Report.pdf", "", "COVER_WRITEUP", None, 0.90, None),
    ("7001234 ESAI - address.docx", "", "COVER_WRITEUP", None, 0.80, None),
    ("E&O 2025-26.pdf", "", "EO_INSURANCE", None, 0.90, None),
    ("reliance letter.pdf", "", "RELIANCE_LETTER", None, 0.90, None),
    ("reliance_letter.pdf", "", None, None, None, None),
    ("case #12345.pdf", "", "APPENDIX_E", None, 0.90, None),
    ("q3.pdf", "GeoTracker/2003", "REPORTS_AFTER_E", None, 0.85, None),
    ("IMG_1234.pdf", "", "APPENDIX_B", None, 0.90, None),
    ("misc.pdf", "", None, None, None, None),
    ("ESAI topo.docx", "", "APPENDIX_D", "topos", 0.90, None),
    ("sanborn.jpg", "geotracker", "APPENDIX_D", "sanborn", 0.92, None),
]


def test_name_rules(spark):
    df = spark.createDataFrame([c[:2] for c in CASES], "original_filename string, original_path string")
    got = classify.classify_by_name(df).collect()
    want = {c[0]: c[2:] for c in CASES}
    for r in got:
        assert (r.rule_category, r.rule_subcategory, r.rule_confidence, r.rule_sort_order) == want[r.original_filename]


# A name (and folder) for every rule of the standard pack, in order; None where stronger rules always win.
FIRES = [
    "aerial.png", "sanborn.png", "topo.tif", "location map.jpg", "plot_plan.gif", "site map.bmp", "x.png",
    "Appendix A.pdf", "appendix b.pdf", "APPENDIX C.docx", "appendixd.pdf", "appendix e tab.pdf", "appendix f.pdf",
    "Appendix Z qualifications.pdf",
    "appendix ab.pdf", "appendix bc.pdf", "appendix cd.pdf", "appendix de.pdf", "appendix ef.pdf", "appendix fg.pdf",
    "sanborn.pdf", "esai-aerial.pdf", "aerials_2.pdf", "aerial view.txt", None, "esai_topo1.pdf", "topo.pdf", "esai-city-dir.pdf",
    "city dir.pdf", "esai-radius.pdf", "esai_report.pdf", "radius.pdf", "site-location-map.pdf", "plot plan.pdf", "photo appendix.pdf",
    "errors and omissions.pdf", "a reliance b.pdf", "cover.pdf", "my qualification.pdf", "property detail.pdf", "records request.pdf",
    "bldg permit.pdf", "dtsc response.pdf", "baaqmd.pdf", "case # 1234.pdf",
    ("x.pdf", "BLA-12/x.pdf"), ("x.pdf", "EC_Attachments/x.pdf"), ("x.pdf", "smeh_1/x.pdf"), ("x.pdf", "GeoTracker/x.pdf"), ("x.pdf", "site documents/x.pdf"),
    "my esai text.docx",
    "20240101_1.pdf", "IMG_1.pdf", "DSC12.pdf", "P1234567.pdf", "photo1.pdf", "PXL_2.pdf",
]


def test_each_rule_fires(spark):
    rules = standard_rules()
    assert len(rules) == len(FIRES)
    rows = [(r.reason, *((n, "") if isinstance(n, str) else n)) for r, n in zip(rules, FIRES) if n]
    df = spark.createDataFrame(rows, "want string, original_filename string, original_path string")
    wrong = classify.classify_by_name(df).filter("rule_reason <> want OR rule_reason IS NULL")
    assert wrong.select("want", "original_filename", "rule_reason").collect() == []


@pytest.mark.parametrize("size, want", [(0, "APPENDIX_C"), (10_000, "APPENDIX_C"), (900_000, "APPENDIX_C")])
def test_divider_by_size(spark, size, want):
    df = spark.createDataFrame([("Appendix C list.pdf", "", size)], "original_filename string, original_path string, file_size bigint")
    row = classify.classify_by_name(df, size="file_size").first()
    assert row.rule_category == want
    assert row.rule_sort_order == (-1 if size < 50 * 1024 else None)


def test_rule_table_with_quotes(spark):
    table = spark.createDataFrame([Rule(1, "name", r"o'brien\d+", "APPENDIX_F", None, 0.7, None, "it's O'Brien")], RULE_SCHEMA)
    df = spark.createDataFrame([("O'Brien12.pdf", "")], "original_filename string, original_path string")
    row = classify.classify_by_table(df, table).first()
    assert (row.rule_category, row.rule_reason) == ("APPENDIX_F", "it's O'Brien")


def test_prefilter(spark):
    df = spark.createDataFrame([("a.HEIC",), ("b.vsdx",), ("c.pdf",)], "original_filename string")
    assert [r.pre_confidence for r in classify.prefilter(df).orderBy("original_filename").collect()] == [0.99, 0.99, None]


BASES = [
    ("Report_v2.pdf", "report"), ("Report.docx", "report"), ("Plan-rev1.pdf", "plan"), ("Plan (Revised).pdf", "plan"),
    ("X (1).pdf", "x"), ("X_FINAL.pdf", "x"), ("photo-rev-mam.pdf", "photo"), ("well v10 copy.pdf", "well"),
    ("dev12 notes.pdf", "de notes"), ("Final.pdf", "final"),
]


def test_base_names(spark):
    df = spark.createDataFrame(BASES, "n string, want string")
    assert df.filter(names.norm_basename(F.col("n")) != F.col("want")).count() == 0
    assert df.select(names.norm_basename(F.col("n"), keep_empty=True).alias("b")).filter("b = ''").count() == 1


def test_suffix_and_stem(spark):
    rows = [(".bashrc", "", ".bashrc"), ("a.b.C", ".c", "a.b"), ("plain", "", "plain"), ("x.", "", "x."), ("r.PDF", ".pdf", "r")]
    df = spark.createDataFrame(rows, "n string, e string, s string")
    assert df.filter((names.suffix(F.col("n")) != F.col("e")) | (names.stem(F.col("n")) != F.col("s"))).count() == 0


def test_sizes(spark):
    df = spark.createDataFrame([(5, "5 B"), (1280, "1.2 KB"), (1792, "1.8 KB"), (5 << 20, "5.0 MB")], "n bigint, want string")
    assert df.filter(metrics.size_display(F.col("n")) != F.col("want")).count() == 0


def test_alias(spark):
    df = spark.createDataFrame([(" EDR ",), ("Photos",), ("nope",)], "w string")
    got = {r.w: r.alias_section for r in classify.resolve_alias(df, "w").collect()}
    assert got == {" EDR ": "APPENDIX_C", "Photos": "APPENDIX_B", "nope": None}


def test_model_hook(spark):
    prompts = spark.createDataFrame([(i, f"Filename: {i}") for i in range(20)], "doc_id bigint, prompt string")
    answer = '{"category": "APPENDIX_C", "confidence": 0.9}'
    verdicts = classify.model_verdicts(prompts, lambda p: p.map(lambda _: answer), tasks=2)
    parsed = classify.parse_verdicts(verdicts)
    assert parsed.filter("ai_category = 'APPENDIX_C' AND ai_confidence = 0.9 AND ai_reasoning = 'AI classification'").count() == 20


def test_needs_verdict(spark, filings):
    df = filings({"original_filename": "a.heic"}, {"original_filename": "sanborn.pdf"}, {"original_filename": "misc.pdf"})
    names_of = lambda p: sorted(r.original_filename for r in classify.needs_verdict(df, p).collect())
    assert names_of("none") == []
    assert names_of("name-first") == ["misc.pdf"]
    assert names_of("content-first") == ["misc.pdf", "sanborn.pdf"]


def test_rule_table_of_any_length(spark):
    """Five thousand rules, with and without runs of characters, against the same rules as one expression."""
    patterns = [(f"^file{i}_", "name") for i in range(4000)] + [(rf"part {i}\b.*\.pdf$", "name") for i in range(700)]
    patterns += [(rf"^f.?{i}[ab]", "name") for i in range(200)] + [("box(es)?/old", "folder"), ("scan|photo", "camera"), ("", "image"), ("map", "image")]
    patterns += [(r"^appendix\s*c", "divider"), ("(?i)PLAN", "body"), ("é+tude", "name"), (r"a{2}b\+c", "name"), ("[x]yz|uvw", "name")]
    table = [
        ((i * 7919) % 5003, scope, p, "APPENDIX_A" if i % 2 else "APPENDIX_B", "sub" if i % 3 else None, 0.5 + i % 5 / 10, i % 4 or None, f"rule {i}")
        for i, (p, scope) in enumerate(patterns)
    ]
    names = [f"file{i}_x.pdf" for i in (7, 77, 3999)] + ["File7_part 12.pdf", "nothing.pdf", "f3a.txt", "fx3a file3_", "part 7 of it.PDF", "boxes.jpg", "map.png"]
    names += ["scanned.tif", "photo 1.jpeg", "Appendix C.pdf", "site plan.pdf", "éétude.doc", "aab+c", "xyz", "auvw", "", None, "file7_x.pdf"]
    rows = [(i, n, "box/old" if i % 4 == 0 else None, i * 10_000) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id int, original_filename string, original_path string, file_size long")
    rules = spark.createDataFrame(table, RULE_SCHEMA)
    compiled = sorted((Rule(*r) for r in table), key=lambda r: r.prio)
    for size in (None, "file_size"):
        want = rule_columns(df, compiled, "original_filename", "original_path", size, "rule_")
        got = classify.classify_by_table(df, rules, size=size)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_required_runs():
    held = {
        r"^file12_": "file12_", r"abc?def": "def", r"ab|cdef": None, r"(?i)abcdef": None, r"(abc)+xy": None, r"abc\.pdf$": "abc.pdf", r"[abc]def": "def",
        r"ab{2}cde": "cde", "(": None, "": None, r"appendix\s*a\b": "appendix",
    }
    assert {p: required(p) for p in held} == held


def test_many_searches(spark, filings):
    names = ["Sanborn Map.pdf", "map of site.pdf", "sAN.txt", "b", "", None, "Étude 1.pdf", "a%b_c.pdf", "xxmapxx"] * 2
    df = filings(*[{"original_filename": n, "report_id": 1 + i % 2} for i, n in enumerate(names)])
    asked = ["map", "SAN", "a", "pd", "", None, "étude", "%b_", "nowhere", "map of site.pdf", "xx", "b"]
    queries = [(2 * i + j, r, q) for i, q in enumerate(asked) for j, r in enumerate([None, 2])]
    got = search.search_names(df, spark.createDataFrame(queries, "query_id int, report_id bigint, query string"))
    want = {
        (n, d.doc_id)
        for n, r, q in queries for d in df.collect()
        if q is not None and d.original_filename is not None and r in (None, d.report_id) and q.lower() in d.original_filename.lower()
    }
    assert sorted((r.query_id, r.doc_id) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_one_text_asked_often_is_dealt_out(spark, filings):
    """Searches times files of one report are made by many tasks, each text is looked up once, and no row is lost."""
    df = filings(*[{"original_filename": f"Map {i % 7}.pdf", "report_id": i % 10 // 9} for i in range(150)])
    asked = [(i, 0 if i % 3 else None, ("MAP", "", "map 3", "Map")[i % 4]) for i in range(120)]
    queries = spark.createDataFrame(asked, "query_id int, report_id bigint, query string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = search.search_names(df, queries, cell=16).select("query_id", "query", "doc_id", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = df.collect()
    want = [(n, q, d.doc_id) for n, r, q in asked for d in files if r in (None, d.report_id) and q.lower() in d.original_filename.lower()]
    assert sorted((r.query_id, r.query, r.doc_id) for r in got) == sorted(want)
    often = [r.task for r in got if r.query.lower() == "map" and r.query_id % 3]
    assert max(often.count(t) for t in set(often)) < len(often) / 2


def test_rows_of_a_search_asked_often_come_file_by_file(spark, filings):
    """Written, the rows are runs of one file, which take little room; and exploded names are not broadcast."""
    df = filings(*[{"original_filename": f"Map {i}.pdf", "report_id": 0} for i in range(90)])
    queries = spark.createDataFrame([(i, 0, "map") for i in range(90)], "query_id int, report_id bigint, query string")
    found = search.search_names(df, queries, cell=30)
    tasks = found.select("doc_id", F.spark_partition_id().alias("task")).collect()
    assert len(tasks) == 90 * 90
    assert sum(one != other for one, other in zip(tasks, tasks[1:])) < 90 * 90 / 8
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "gram" in line and "Inner" in line]


def test_verdicts_that_fail(spark):
    answers = [
        '{"category": "APPENDIX_A"}', '{"category": "APPENDIX_A", "confidence": "0.5"}', '{"category": "APPENDIX_A", "confidence": "high"}',
        '{"category": "APPENDIX_A", "confidence": null}', '{"category": "APPENDIX_A", "reasoning": null}', '{"category": "APPENDIX_A"} done',
        '{"category": "APPENDIX_A", "subcategory": 4}', '[{"category": "APPENDIX_A"}]', '{"category": "APPENDIX_A"}, {"a": 1}', "", None,
        '```json\n{"category": "APPENDIX_A", "confidence": 1, "reasoning": "r", "subcategory": null}\n```',
    ]
    df = spark.createDataFrame(list(enumerate(answers)), "doc_id int, response_text string")
    got = {r.doc_id: (r.ai_subcategory, r.ai_confidence, r.ai_reasoning) for r in classify.parse_verdicts(df).collect()}
    assert got == {0: (None, 0.8, "AI classification"), 1: (None, 0.5, "AI classification"), 11: (None, 1.0, "r")}


def test_natural_order_keeps_all_digits(spark):
    names = ["img20240101123456.jpg", "img20240101123411.jpg", "img7.jpg", "img007b.jpg", "img.jpg", "a12345678901234567890.x", "a2.x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(natural_key(F.col("n"))).collect()]
    twice = ["photo 1 (10).jpg", "photo 1 (9).jpg", "photo 01 (9).jpg", "photo 10 (1).jpg", "photo 2 (100).jpg", "photo.jpg"]
    df2 = spark.createDataFrame([(n,) for n in twice], "n string")
    assert [r.n for r in df2.orderBy(natural_key(F.col("n"))).collect()] == [
        "photo 01 (9).jpg", "photo 1 (9).jpg", "photo 1 (10).jpg", "photo 2 (100).jpg", "photo 10 (1).jpg", "photo.jpg"
    ]
    assert got == ["a2.x", "a12345678901234567890.x", "img7.jpg", "img007b.jpg", "img20240101123411.jpg", "img20240101123456.jpg", "img.jpg"]
