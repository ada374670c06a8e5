"""Collocations, near vectors and ranked search against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.llm import collocations, common, lexical_search, subspace_join

from .helpers import documents, odd_rows, prose


# -- collocations


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute_phrases(rows, support, inside, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= support}
    most = Counter()
    for (lang, q), b in found.items():
        for k in range(2, len(q)):
            for i in range(len(q) - k + 1):
                most[lang, q[i : i + k]] = max(most[lang, q[i : i + k]], b)
    out = defaultdict(list)
    for (lang, p), a in found.items():
        held = 100 * most[lang, p] >= inside * a
        if not held:
            score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, each in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(each)[:top])
    }


def phrase_rows():
    r = random.Random(3)
    text = lambda: " ".join(r.choice(["a", "b", "B", "c", "éa", "x.", "y,\t", "z\n", "dd  "]) for _ in range(60))
    return [(r.choice(["en", "de", None, "und", "", "a b"]), text()) for _ in range(60)] + [("en", None), ("en", ""), (None, None), ("de", "A a A a a a"), ("de", " \t. ")]


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_phrases_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", broadcast)
    rows = phrase_rows()
    docs = spark.createDataFrame([(lang, t, 1, 2) for lang, t in rows], "lang string, text string, piece long, id long")
    got = collocations.collocations(docs, support=4, inside=80, top=25).collect()
    assert {tuple(r) for r in got} == brute_phrases(rows, 4, 80, 25) and len(got) > 40


def test_phrases_of_odd_and_empty_tables(spark):
    docs = documents(spark, odd_rows())
    got = collocations.collocations(docs, support=2, top=50)
    assert {tuple(r) for r in got.collect()} == brute_phrases([("en", t) for _, t in odd_rows()], 2, 80, 50)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_word_ids_are_made_anew_when_two_words_share_one(spark, monkeypatch):
    plain, seeds = collocations.words, []

    def colliding(docs, seed=0):
        seeds.append(seed)
        return plain(docs, seed).withColumn("id", F.when(F.lit(seed == 0), F.lit(1)).otherwise(F.col("id")).cast("long"))

    monkeypatch.setattr(collocations, "words", colliding)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in collocations.collocations(docs, support=4, top=25).collect()} == brute_phrases(rows, 4, 80, 25)
    assert seeds == [0, 1]


def test_ids_of_groups_fit_in_half_a_long(spark):
    marked = collocations.frequent(spark.range(0, 3000, 1, 7).select(collocations.paired(F.col("id") % 50, F.lit(2**31 - 1)).alias("key")), 2)
    groups, size = marked[0].collect(), marked[1]
    assert sorted(g.id for g in groups) == list(range(50)) and size == 50
    assert sorted((g.g, g.h, g.a) for g in groups) == [(g, 2**31 - 1, 60) for g in range(50)]


@pytest.mark.parametrize("text", ["a b\tc", " a  b ", "a \tb", "a b c", "\t", "x"])
def test_words_stand_side_by_side_whatever_parts_them(spark, text):
    got = sorted((r.piece, r.pos, r.word) for r in collocations.words(spark.createDataFrame([("en", text)], "lang string, text string")).collect())
    assert [w.removeprefix("en ") for _, _, w in got] == text.split()
    assert [pos - got[0][1] for _, pos, _ in got] == list(range(len(got)))


# -- near vectors


def brute_vectors(rows, similar=0.93):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = defaultdict(set)
    for i in ok:
        for j in ok:
            a, b = rows[i], rows[j]
            if i < j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= similar:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((vec_id, len(near[i]), low, low == vec_id))
    return Counter(out)


VECTORS = "vec_id long, embedding array<float>, label int, node long, row int, block string"


def vector_rows(size, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, size))
    rows = []
    for i in range(240):
        v = centres[r.integers(6)] + r.normal(size=size) * r.choice([0.1, 0.25, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(2)), 1, 2, "b"))
    same = rows[0][1]
    rows += [(300 + i, same, 0, 1, 2, "b") for i in range(5)] + [(300, same, None, 1, 2, "b"), (None, same, 0, 1, 2, "b")]
    rows += [(400, None, 0, 1, 2, "b"), (401, [], 0, 1, 2, "b"), (402, [0.0] * size, 0, 1, 2, "b"), (403, [1.0, None], 0, 1, 2, "b")]
    rows += [(404, [float("nan")] * size, 0, 1, 2, "b"), (405, [float("inf")] * size, 0, 1, 2, "b"), (406, [1.0, 0.0], 0, 1, 2, "b"), (407, [2.0, -0.0], 0, 1, 2, "b")]
    return rows


@pytest.mark.parametrize(("size", "chunk"), [(64, 1024), (20, 16), (3, 7)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, size, chunk):
    monkeypatch.setattr(subspace_join, "CHUNK", chunk)
    rows = vector_rows(size, size)
    got = subspace_join.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    want = brute_vectors([r[:3] for r in rows])
    assert Counter(tuple(r) for r in got) == want
    assert any(n for _, n, _, _ in want)


@pytest.mark.parametrize(("strip", "chunk", "dense"), [(8, 9, 16), (100, 9, 0), (2000, 300, 10**9), (2000, 300, 0)])
def test_near_vectors_of_crowded_cells_in_small_chunks_and_strips(spark, monkeypatch, strip, chunk, dense):
    """Chunks of a few vectors, strips of a few pairs, all or none of them compared by products, links folded as they come,
    joins of components without broadcasts."""
    monkeypatch.setattr(subspace_join, "NUMBERS", 66 * chunk)
    monkeypatch.setattr(subspace_join, "DENSE", dense)
    monkeypatch.setattr(subspace_join, "STRIP", strip)
    monkeypatch.setattr(common, "BROADCAST", 0)
    rows = vector_rows(66, 5)
    got = subspace_join.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert Counter(tuple(r) for r in got) == brute_vectors([r[:3] for r in rows])


def test_near_vectors_are_copied_a_few_times_and_not_broadcast(spark, monkeypatch):
    """Vectors alike in all directions, one label: the copies dealt out to cells do not grow with the crowd, and Spark, which
    takes exploded rows for few, is kept from broadcasting them."""
    seen, linked = [], subspace_join.linked

    def watched(rows, *rest):
        seen.append((rows.count(), rows._jdf.queryExecution().executedPlan().toString()))
        return linked(rows, *rest)

    monkeypatch.setattr(subspace_join, "linked", watched)
    vectors = np.random.default_rng(1).normal(size=(4000, 64))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    assert subspace_join.near_vectors(df).count() == 4000
    [(copies, plan)] = seen
    assert copies < 12 * 4000
    assert "Generate explode" in plan and "Broadcast" not in plan


def test_near_vectors_of_an_empty_table_and_without_usable_ones(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert subspace_join.near_vectors(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, 1, 1, 1, ""), (2, [0.0], 1, 1, 1, "")], VECTORS)
    assert {tuple(r) for r in subspace_join.near_vectors(nothing).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}


# -- ranked search


def brute_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(i, Counter(term.findall(lower(t)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    count, words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item_id, text in items:
        asked = Counter(term.findall(lower(text)))
        found = []
        for i, b in bags:
            m = 100 - 25 + 25 * sum(b.values()) * count // words
            score = sum(
                q * math.floor(1000 * math.log((2.0 * count + 2) / (2.0 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 12 * m))
                for t, q in asked.items() if t in b
            )
            if score > 0:
                found.append((-score, i is not None, i, score))
        for rank, (_, _, i, score) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item_id, rank, i, score] += 1
    return out


@pytest.mark.parametrize(("k", "broadcast"), [(3, 200_000), (20, 200_000), (3, 0)])
def test_search_equals_brute_force(spark, monkeypatch, k, broadcast):
    monkeypatch.setattr(lexical_search, "BROADCAST_ROWS", broadcast)
    r = random.Random(5)
    vocabulary = [f"w{int(r.paretovariate(0.6))}" for _ in range(3000)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 120)))) for i in range(400)] + odd_rows()
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(12))) for i in range(15)]
    items += [(i + 20, docs[i][1]) for i in range(5)] + [(7, "one two THREE four"), (7, None), (8, ""), (None, "six"), (9, "nowhere_at_all")]
    table = spark.createDataFrame([(i, t, 1, 2, "n") for i, t in items], "item_id long, text string, item long, n long, term string")
    got = lexical_search.search(documents(spark, docs), table, k).collect()
    assert Counter(tuple(x) for x in got) == brute_search(docs, items, k)


def test_items_stop_creating_accumulators(spark, monkeypatch):
    """Copies of an item rank from its rare terms alone; the common terms then create nothing."""
    sizes, plain = [], lexical_search.stored

    def watched(df, *by):
        out = plain(df, *by)
        if out.columns == ["item", "row", "score"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(lexical_search, "stored", watched)
    common = "the of and to in"
    docs = [(i, f"{common} filler{i}") for i in range(500)] + [(500 + i, f"{common} rare words here x{i}") for i in range(4)]
    items = spark.createDataFrame([(1, "the of and rare words here")], "item_id long, text string")
    got = lexical_search.search(documents(spark, docs), items, 3).collect()
    assert [(r.rank, r.doc_id) for r in got] == [(1, 500), (2, 501), (3, 502)]
    assert sizes and max(sizes) == 4


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    docs = documents(spark, odd_rows())
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
