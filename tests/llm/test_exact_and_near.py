import hashlib
import re
from collections import Counter, defaultdict

import pytest

from docket.llm import block_dedup, jaccard_join
from docket.llm.common import components

from .helpers import documents, edited, odd_rows, prose


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("block", [1, 3, 512])
def test_exact_duplicates(spark, block):
    rows = odd_rows() if block == 512 else [r for r in odd_rows() if len(r[1] or "") < 100]
    rows += [(100 + i, "abc" * i + t) for i in range(6) for t in ("", "abc", "ab")]
    got = block_dedup.exact_duplicates(documents(spark, rows), block)
    assert Counter(map(tuple, got.collect())) == brute_exact(rows)


def test_exact_empty_table_and_kept_rows(spark):
    assert block_dedup.exact_duplicates(documents(spark, [])).collect() == []
    rows = odd_rows()
    docs = documents(spark, rows)
    kept = block_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in rows})


def shingle_set(text):
    w = re.findall(r"\w+", (text or "").lower())
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_near(rows, similar=0.8):
    sets = [shingle_set(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similar * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    order = lambda x: (x is not None, x or 0)
    first = {}
    for i, (doc, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), doc), doc, key=order)
    return Counter((doc, first[find(i)], links[i], len(sets[i])) for i, (doc, _) in enumerate(rows))


def near_rows():
    rows = odd_rows()
    base = prose(1, 120)
    rows += [(200 + i, edited(base, 60 + i, i)) for i in range(25)] + [(300 + i, edited(base, 12, i)) for i in range(5)]
    rows += [(400 + i, prose(50 + i, 80)) for i in range(10)] + [(500, base), (501, base.upper())]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    got = jaccard_join.near_duplicates(documents(spark, rows)).select("doc_id", "class_id", "n_links", "n_shingles")
    assert Counter(map(tuple, got.collect())) == brute_near(rows)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "VERIFY_SETS", 3)
    rows = near_rows()
    got = jaccard_join.near_duplicates(documents(spark, rows)).select("doc_id", "class_id", "n_links", "n_shingles")
    assert Counter(map(tuple, got.collect())) == brute_near(rows)


def test_near_empty_table_and_kept_rows(spark):
    assert jaccard_join.near_duplicates(documents(spark, [])).collect() == []
    rows = [r for r in near_rows() if r[0] != 2]
    docs = documents(spark, rows)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    expect = jaccard_join.near_duplicates(docs).filter("stays").count()
    assert kept.count() == expect


def test_bayesian_bound():
    # A pair that matches everywhere always lives, one that matches nowhere never does, and more values ask for more matches.
    least = [jaccard_join.needed(n, 0.8, 1e-5) for n in range(16, 129, 16)]
    assert least == sorted(least) and all(0 < m < 0.8 * n for m, n in zip(least, range(16, 129, 16)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (500, 499)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100, 499: 499, 500: 499}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_very_long_equal_texts_take_one_cut(spark):
    """Two equal texts of four million characters, one that differs at its end, characters beyond 16 bits among them."""
    long = "ab\n𝄞" * 1_000_000
    rows = spark.createDataFrame([(1, long), (2, long), (3, long[:-1] + "x"), (4, ""), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in block_dedup.exact_duplicates(rows).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (5, 2, False), 5: (5, 2, True)}


def test_edges_of_a_family_grow_with_its_members(spark, monkeypatch):
    """A family of several blocks that is alike in all bands: few edges per member, one cluster, links counted in full."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "VERIFY_SETS", 16)
    base = prose(5, 400).split()
    rows = [(i, " ".join([*base[:i % 7], f"w{i}", *base])) for i in range(200)] + [(500 + i, prose(900 + i, 60)) for i in range(40)]
    edges, plain = [], jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda e: edges.append(e.count()) or plain(e))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(documents(spark, rows)).select("doc_id", "class_id", "n_links").collect()}
    assert all(got[i] == (0, 199) for i in range(200)) and all(got[500 + i] == (500 + i, 0) for i in range(40))
    assert sum(edges[:3]) < 40 * 200  # the pairs of the family are 19,900 in each of 32 bands
