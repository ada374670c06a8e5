import pytest
from pyspark.sql import functions as F

from docket.operators import classify, edits, evidence, excerpt


def pages_table(spark, counts, text=lambda d, p: f"doc {d} page {p}"):
    return spark.createDataFrame(
        [(d, p, text(d, p), None) for d, n in counts.items() for p in range(n)], "doc_id bigint, page_no int, txt string, ocr_txt string"
    )


SAMPLES = {
    50: [], 100: [], 101: [50], 150: [50, 51, 52, 53, 54], 400: [50, 54, 58, 62, 66], 1257: [50, 62, 74, 86, 98], 18000: [50, 230, 410],
}


def test_sampled_pages(spark):
    sizes = spark.createDataFrame([(n,) for n in SAMPLES], "n bigint")
    pages = sizes.withColumn("doc_id", F.col("n")).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("page_no"))
    got = excerpt.page_sample(pages.withColumn("txt", F.lit("x")))
    rows = got.collect()
    for n, want in SAMPLES.items():
        mine = [r for r in rows if r.doc_id == n]
        assert sorted(r.page_no for r in mine if r.part == "sample") == want
        assert sorted(r.page_no for r in mine if r.part == "head") == [0, 1, 2, 3, 4]
        assert sorted(r.page_no for r in mine if r.part == "tail") == [n - 3, n - 2, n - 1]


def test_smart_excerpt_text(spark):
    df = pages_table(spark, {1: 3, 2: 600}, lambda d, p: f"<{p}>" * 200)
    got = {r.doc_id: r.excerpt for r in excerpt.smart_excerpt(df).collect()}
    assert got[1] == "\n".join(f"<{p}>" * 200 for p in range(3))
    parts = [
        "\n".join(f"<{p}>" * 200 for p in range(5))[:3000], "\n".join(f"<{p}>" * 200 for p in (597, 598, 599))[:2000],
        *[(f"<{p}>" * 200)[:500] for p in (50, 56, 62, 68, 74)],
    ]
    assert got[2] == "\n[SAMPLE PAGE]\n".join(parts)[:8000]


def test_large_documents_reach_the_scan_as_page_filters(spark, tmp_path):
    pages_table(spark, {1: 5}).write.parquet(str(tmp_path / "p"))
    df = excerpt.excerpt_first(spark.read.parquet(str(tmp_path / "p")), 5, 100)
    assert "LessThan(page_no,5)" in df._jdf.queryExecution().executedPlan().toString()


def test_paginate(spark):
    text = "\n".join(["x" * 120] + ["line"] * 99)
    rows = excerpt.paginate(spark.createDataFrame([(1, text), (2, "")], "doc_id bigint, text string")).orderBy("doc_id", "page_no").collect()
    assert [(r.doc_id, r.page_no, r.txt.count("\n") + 1) for r in rows] == [(1, 0, 47), (1, 1, 47), (1, 2, 6), (2, 0, 1)]
    assert rows[0].txt.startswith("x" * 100 + "...\n")


def test_blank_tail(spark):
    df = pages_table(spark, {1: 4, 2: 4, 3: 2}, lambda d, p: "real content here" if p == 1 and d != 3 else " \n")
    word = spark.createDataFrame([(1, ".docx"), (2, ".pdf"), (3, ".doc")], "doc_id bigint, ext string")
    got = sorted((r.doc_id, r.page_no) for r in excerpt.strip_blank_tail(df, word).collect())
    assert got == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3)]


def test_hint_tie_goes_to_the_last_name(spark):
    df = pages_table(spark, {1: 1, 2: 1}, lambda d, p: "Sanborn aerial topographic" if d == 1 else "nothing")
    filings = spark.createDataFrame([(1, "APPENDIX_D"), (2, "APPENDIX_D")], "doc_id bigint, category string")
    got = {r.doc_id: r.hint for r in evidence.ordering_hint(df, filings).collect()}
    assert got == {1: "topos", 2: None}


@pytest.mark.parametrize(
    "text, want",
    [
        ("Project Number: 7001234\nx", ("7001234", None, None)),
        ("BLA-0000014401\n12 Main Street", ("0000014401", "12 Main St", None)),
        ("© Acme Ltd", (None, None, "Acme Ltd")),
        ("Environmental Consulting Group", (None, None, "Consulting Group")),
        ("71234567 report", ("71234567", None, None)),
    ],
)
def test_identity(spark, text, want):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, header_footer string")
    r = evidence.extract_identity(df).first()
    got = (r.found_project_id, r.found_address, r.found_company)
    assert got[0] == want[0] and got[2] == want[2]
    assert (got[1] or "").startswith(want[1] or "")


def test_delete_pages_ignores_unknown_indexes(spark):
    df = pages_table(spark, {1: 4, 2: 2})
    asked = spark.createDataFrame([(1, [0, 2, 77])], "doc_id bigint, pages array<int>")
    got = sorted((r.doc_id, r.page_no, r.new_page_no) for r in excerpt.delete_pages(df, asked).collect())
    assert got == [(1, 1, 0), (1, 3, 1), (2, 0, 0), (2, 1, 1)]


def test_many_deleted_pages(spark):
    """A document of 300,000 pages loses half of them, and other pages keep their columns."""
    pages = spark.range(300_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page_no"), F.lit("x").alias("before"))
    asked = spark.range(300_000).filter("pmod(hash(id), 2) = 0").groupBy(F.lit(1).cast("long").alias("doc_id")).agg(F.collect_list("id").alias("pages"))
    gone = set(asked.first().pages)
    got = excerpt.delete_pages(pages, asked).orderBy("page_no").collect()
    assert [(r.page_no, r.new_page_no, r.before) for r in got] == [(p, i, "x") for i, p in enumerate(p for p in range(300_000) if p not in gone)]


PARAS = "doc_id int, paras array<struct<text:string,style:string,runs:array<struct<text:string,bold:boolean,italic:boolean>>>>"


def test_replace_counts_runs_and_does_not_cross_them(spark):
    runs = [("aa a", True, None), ("b", None, None), ("xa", None, True)]
    df = spark.createDataFrame([(1, [("aa abxa", "Normal", runs)])], PARAS)
    row = edits.text_replace(df, "a", "Q").first()
    assert row.replacements == 2 and [r.text for r in row.paras[0].runs] == ["QQ Q", "b", "xQ"]
    assert edits.text_replace(df, "ab", "Z").first().replacements == 0


def test_rewrite(spark):
    edit = "edits array<struct<text:string,runs:array<struct<text:string,bold:boolean,italic:boolean>>>>"
    old = [("ab", "N", [("a", True, None), ("b", None, None)]), ("cd", "N", [("c", None, None), ("d", None, None)]), ("e", "N", [("e", None, None)])]
    new = [("xy", [("x", None, True), ("y", False, None)]), ("one", [("one", None, None)])]
    row = edits.rewrite_runs(spark.createDataFrame([(1, old, new)], PARAS + ", " + edit)).first()
    assert [[(r.text, r.bold, r.italic) for r in p.runs] for p in row.paras] == [
        [("x", True, True), ("y", False, None)], [("one", None, None), ("", None, None)], [("e", None, None)],
    ]


def test_html_of_blocks(spark):
    df = spark.createDataFrame([(1, [("T", "Heading 2", []), ("p", "Normal", [])], [[["a", "b"]]])], PARAS + ", tables array<array<array<string>>>")
    assert edits.blocks_to_html(df).first().html.split("\n")[1:4] == ['<h2 class="docx-para">T</h2>', '<p class="docx-para">p</p>', '<table class="docx-table">']


def test_page_choices_need_one_shuffle(spark, tmp_path):
    rows = [(d, p, 60 if d else 3, f"text {p} " * 50, 300) for d in (0, 1) for p in range(60 if d else 3)]
    spark.createDataFrame(rows, "doc_id bigint, page_no int, n_pages int, txt string, n_trimmed int").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    smart = plan(excerpt.smart_excerpt(pages))
    assert smart.count("Exchange hashpartitioning") == 1 and "Join" not in smart
    sample = plan(excerpt.page_sample(pages))
    assert "Exchange" not in sample
    # Counted, where pages do not carry their number, it is the same choice.
    counted = excerpt.page_sample(pages.drop("n_pages"))
    assert sorted(map(str, counted.collect())) == sorted(map(str, excerpt.page_sample(pages).collect()))
    docs = spark.createDataFrame([(0, ".docx"), (1, ".pdf")], "doc_id bigint, ext string")
    assert "txt" not in plan(excerpt.kept_pages(pages, docs)).split("ReadSchema")[1].split("\n")[0]


def test_deleted_pages_number_the_rest_again(spark):
    pages = spark.createDataFrame([(d, p, f"{d}-{p}") for d in (1, 2) for p in range(6)], "doc_id bigint, page_no int, txt string")
    asked = spark.createDataFrame([(1, [0, 3, 3, 9, -1]), (1, [4]), (3, [1])], "doc_id bigint, pages array<int>")
    got = sorted((r.doc_id, r.page_no, r.new_page_no) for r in excerpt.delete_pages(pages, asked).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 5, 2)] + [(2, p, p) for p in range(6)]


def test_facts_after_a_verdict(spark):
    placed = [
        (1, "APPENDIX_D", None, "map", None, True), (2, "APPENDIX_D", "topos", "map", None, True), (3, "APPENDIX_E", None, "x", None, True),
        (4, "APPENDIX_D", None, "[FALLBACK]", 2, False), (5, "COVER_WRITEUP", None, "y", None, True),
    ]
    df = spark.createDataFrame(placed, "doc_id bigint, category string, subcategory string, reasoning string, rule_sort_order int, from_model boolean")
    pages = [(1, 0, "Sanborn map of the site"), (3, 0, "Property Profile"), (4, 0, "Sanborn map"), (5, 0, "Project Number: 7001234\n12 Main Street")]
    facts = evidence.first_page_facts(spark.createDataFrame(pages, "doc_id bigint, page_no int, txt string"))
    got = {r.doc_id: r for r in classify.after_verdict(df, facts).collect()}
    assert got[1].subcategory == "sanborn" and got[1].reasoning == "map [Subcategory from content: sanborn]"
    assert got[2].subcategory == "topos" and got[2].reasoning == "map"
    assert got[3].is_profile and got[3].rule_sort_order == 1 and got[3].reasoning.endswith("ranked first in Appendix E]")
    assert got[4].subcategory is None and got[4].rule_sort_order == 2 and not got[4].is_profile
    assert got[5].metadata.found_project_id == "7001234" and got[5].metadata.found_address == "12 Main Street" and got[1].metadata is None
