import random

import numpy as np

from docket.llm import decontaminate

from .helpers import documents, edited, odd_rows, prose

ITEMS = "item_id long, text string, words string, at int"


def items(spark, rows):
    return spark.createDataFrame([(i, t, "w", 0) for i, t in rows], ITEMS)


def table_score(text, item):
    rows = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    best = 0
    for r, a in enumerate(item, 1):
        for c, b in enumerate(text, 1):
            rows[r][c] = max(0, rows[r - 1][c - 1] + (2 if a == b else -1), rows[r - 1][c] - 1, rows[r][c - 1] - 1)
            best = max(best, rows[r][c])
    return best


def test_alignment_equals_the_full_table():
    r = random.Random(5)
    make = lambda n: np.array([r.randint(1, 5) for _ in range(n)], np.uint64)
    texts, wanted = [make(r.randint(1, 30)) for _ in range(150)], [make(r.randint(1, 20)) for _ in range(150)]
    score, first, end = decontaminate.align(texts, wanted)
    for t, w, s, a, b in zip(texts, wanted, score, first, end):
        assert s == table_score(t.tolist(), w.tolist())
        # The span alone gives the whole score.
        assert table_score(t[a:b].tolist(), w.tolist()) == s


def test_planted_passages(spark):
    tests = [(i, prose(1000 + i, 40)) for i in range(6)] + [(6, "only three words"), (7, "pair here"), (8, "single"), (9, None), (10, "")]
    noise = prose(77, 300, 2000)
    rows = [(100 + i, f"{noise[:400]} {tests[i][1]} {noise[400:]}") for i in range(6)]
    rows += [(200 + i, f"{noise} {edited(tests[i][1], 5, i)} {noise}") for i in range(6)]
    rows += [(300, "so only three words here"), (301, f"x pair here {noise}"), (302, "a single one"), (400, noise), (401, noise.upper())]
    rows += [(500, f"{tests[0][1]} {noise} {tests[1][1]}"), (600, f"{tests[2][1]}"), (600, f"{tests[2][1]}")]
    rows += [(i, t) for i, t in odd_rows()]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contamination(documents(spark, rows), items(spark, tests)).collect()}
    expect = {(100 + i, i) for i in range(6)} | {(200 + i, i) for i in range(6)} | {(300, 6), (301, 7), (302, 8), (500, 0), (500, 1), (600, 2)}
    assert set(got) == expect
    assert all(got[100 + i, i].score == 1 for i in range(6)) and all(0.5 <= got[200 + i, i].score < 1 for i in range(6))
    words = dict(rows)[100].lower().split()
    assert words[got[100, 0].first_word : got[100, 0].end_word] == tests[0][1].split()
    kept = decontaminate.clean(documents(spark, rows), items(spark, tests))
    assert kept.columns == documents(spark, []).columns
    gone = {d for d, _ in expect}
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((i or -1, t or "") for i, t in rows if i not in gone)


def test_a_passage_in_most_documents_keeps_its_seeds(spark):
    item = prose(4, 40)
    rows = [(i, f"{prose(100 + i, 60)} {item} {prose(300 + i, 60)}") for i in range(60)] + [(100 + i, prose(500 + i, 100)) for i in range(20)]
    got = decontaminate.contamination(documents(spark, rows), items(spark, [(1, item)]))
    assert {r.doc_id for r in got.collect()} == set(range(60))


def test_empty_tables(spark):
    one = documents(spark, [(1, "some words in a row")])
    assert decontaminate.contamination(documents(spark, []), items(spark, [(1, "some words in a row")])).collect() == []
    assert decontaminate.contamination(one, items(spark, [])).collect() == []
    assert decontaminate.clean(one, items(spark, [])).count() == 1
