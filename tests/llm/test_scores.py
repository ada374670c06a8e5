import random
from collections import Counter
from zlib import crc32

import pytest

from docket.llm import importance, toxicity

from .helpers import documents, odd_rows, prose

LABELS = "doc_id long, quality int, toxic int, text string, score double"


def labels(spark, rows):
    return spark.createDataFrame([(i, q, t, "x", 0.1) for i, q, t in rows], LABELS)


def corpus(n=400):
    r = random.Random(2)
    insults = ["grumblefax", "snorkwit", "blatherkin"]
    rows, marks = [], []
    for i in range(n):
        words = prose(i + 1000, 60, 300).split()
        bad = i % 4 == 0
        if bad:
            for insult in r.sample(insults, 2):
                words.insert(r.randrange(len(words)), insult)
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_character_counts_equal_brute_force(spark):
    rows = [(1, "Abba ßé 1x"), (2, None), (3, "")]
    got = dict(map(tuple, toxicity.char_counts(documents(spark, rows)).collect()))
    texts = "\n".join(["", "", *(t or "" for _, t in rows), ""]).lower()
    classes = [toxicity.char_class(c) for c in texts]
    expect = Counter((a * toxicity.K + b) * toxicity.K + c for a, b, c in zip(classes, classes[1:], classes[2:]))
    # Tasks count on their own, so only triples inside texts have to agree.
    inside = {code: n for code, n in expect.items() if code % toxicity.K or code // toxicity.K % toxicity.K}
    assert {code: got.get(code, 0) for code in inside} == inside


def test_restores_and_scores(spark):
    rows, marks = corpus()
    hidden = ["gr0ode", "gr00mblefax"]
    disguises = ["grumbl3f@x", "g r u m b l e f a x", "sn0rkwit", "bl4therk1n", "snorkwiiiiit", "s.n.o.r.k.w.i.t", "SNORKWIT!!"]
    extra = [(1000 + i, f"{prose(3, 20)} {d} {prose(4, 20)} {'snorkwit' if i == 3 else 'blatherkin'}") for i, d in enumerate(disguises)]
    odd = [(i, t) for i, t in odd_rows() if i is None or i > 2]
    docs = documents(spark, rows + extra + odd + [(2000, hidden[0])])
    costs = toxicity.char_model(docs)
    words = toxicity.restorer(costs)
    assert [toxicity.decode(d.lower(), costs) for d in ("grumbl3f@x", "sn0rkwit", "bl4therk1n")] == ["grumblefax", "snorkwit", "blatherkin"]
    assert "grumblefax" in words("so g r u m b l e f a x then") and "snorkwit" in words("s.n.o.r.k.w.i.t") and "snorkwit" in words("snorkwiiiiit")
    assert words("plain words, here.") == {"plain", "words", "here"}
    got = toxicity.toxicity(docs, labels(spark, marks + [(None, 1, 1), (5000, None, None)])).collect()
    assert len(got) == len(rows) + len(extra) + len(odd) + 1
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].held_out == (crc32(str(i).encode()) % 3 == 1) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    wrong = [i for i, _, bad in marks if by_id[i].held_out and by_id[i].predicted != bad]
    assert len(wrong) <= 2
    assert [t for i, t in extra if not by_id[i].predicted] == []
    kept = toxicity.clean(docs, labels(spark, marks))
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)


def test_spelled_words_with_marks_and_wide_gaps(spark):
    rows, marks = corpus()
    disguises = ["s n o r k w i t.", "s n o r k w i t, of it", '"s n o r k w i t"', "(s n 0 r k w 1 t)!", "s  n  o  r  k  w  i  t", "s\tn\to\tr\tk\tw\ti\tt",
                 "s\nn\no\r\nr\nk\n\n\n\nw\ni\nt", "y o u  s n o r k w i t", "s. n. o. r. k. w. i. t.", "- s n o r k w i t !", "a s n o r k w i t",
                 "sn or kw it", "go sn or kw it.", "sn 0r kw 1t"]
    extra = [(1000 + i, f"{prose(3, 20)} {d} {prose(4, 20)}") for i, d in enumerate(disguises)]
    plain = [(2000 + i, f"{prose(3, 20)} {d} {prose(4, 20)}") for i, d in enumerate(["a b c d", "it is of no use", "! ! !", "1 2 3 4", "s n o r"])]
    both = [(3000, f"{prose(3, 20)} snorkwit {prose(4, 20)}"), (3001, f"{prose(3, 20)} {prose(4, 20)}")]
    by_id = {r.doc_id: r.score for r in toxicity.toxicity(documents(spark, rows + extra + plain + both), labels(spark, marks)).collect()}
    assert by_id[3000] > by_id[3001]
    assert [d for (i, _), d in zip(extra, disguises) if by_id[i] < by_id[3000] - 1e-9] == []
    assert [t for i, t in plain if by_id[i] > by_id[3001]] == []


def test_words_with_marks_inside(spark):
    rows, marks = corpus()
    disguises = ["sn.ork.wit", "sn-or-kw-it", "snork_wit", "s.nork.wit", "snork*wit!", "snork'wit", "sn--ork__wit", "sn-0rk-w1t", "blather-kin", "s.n.o.r.k.w.i.t",
                 "snorkwit-x", "SNORK-WIT", "go.sn.ork.wit.of"]
    extra = [(1000 + i, f"{prose(3, 20)} {d} {prose(4, 20)}") for i, d in enumerate(disguises)]
    plain = [(2000 + i, f"{prose(3, 20)} {d} {prose(4, 20)}") for i, d in enumerate(["by-nc", "a/b.c", "no_one.else", "don't"])]
    words = ["snorkwit", "blatherkin", ""]
    both = [(3000 + i, f"{prose(3, 20)} {w} {prose(4, 20)}") for i, w in enumerate(words)]
    docs = documents(spark, rows + extra + plain + both)
    by_id = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels(spark, marks)).collect()}
    least = min(by_id[3000], by_id[3001])
    assert least > by_id[3002]
    assert [d for (i, _), d in zip(extra, disguises) if by_id[i] < least - 1e-9] == []
    assert by_id[1010] <= by_id[3000] + 1e-9  # readings of one token do not bear each other out
    assert [t for i, t in plain if by_id[i] > by_id[3002]] == []
    found = toxicity.readings("snork-wit", toxicity.char_model(docs))
    assert ("snork-wit",) in found and ("snorkwit",) in found


def every_reading(text, costs):
    """Cost of every reading of a stretch: all choices for all characters, without a lattice."""
    def walk(at, read):
        if at == len(text):
            yield read, cost(costs, ("  " + read)[-2:], 0)
            return
        c = text[at]
        ways = [(" ", toxicity.BREAK), ("", 0.0)] if c in toxicity.GAPS else [(c, 0.0)]
        ways += [(x, toxicity.SUBSTITUTE) for x in toxicity.LEET.get(c, "") if c not in toxicity.GAPS]
        ways += [("", toxicity.REPEAT)] if at and c == text[at - 1] and c not in toxicity.GAPS else []
        for char, extra in ways:
            more = extra + (cost(costs, ("  " + read)[-2:], toxicity.char_class(char)) if char else 0)
            for whole, rest in walk(at + 1, read + char):
                yield whole, more + rest
    return walk(0, "")


def cost(costs, tail, then):
    a, b = map(toxicity.char_class, tail)
    return costs[(a * toxicity.K + b) * toxicity.K + then]


def test_decoder_finds_the_cheapest_reading():
    r = random.Random(1)
    costs = [r.random() * 4 for _ in range(toxicity.K**3)]
    for _ in range(300):
        text = "".join(r.choice("ab1160@@.- eé") for _ in range(r.randint(1, 7)))
        best = {}
        for whole, c in every_reading(text, costs):
            best[whole] = min(c, best.get(whole, c))
        assert best[toxicity.decode(text, costs)] == pytest.approx(min(best.values()))


def test_a_long_stretch_is_one_walk(monkeypatch):
    r = random.Random(2)
    costs = [r.random() * 4 for _ in range(toxicity.K**3)]
    text = "".join(r.choice("abcde10@.-") for _ in range(5000))
    whole = toxicity.decode(text, costs)
    monkeypatch.setattr(toxicity, "SETTLE", 7)
    assert toxicity.decode(text, costs) == whole
    monkeypatch.setattr(toxicity, "SETTLE", 10**9)
    assert toxicity.decode(text, costs) == whole


def test_runs_of_any_length_are_quick():
    costs = [1.0] * toxicity.K**3
    for text in (". " * 50_000, ".. " * 50_000, "." * 300_000, "ab " * 50_000, "a" + " " * 300_000 + "b", "a.b " * 50_000):
        assert all(len(w) > 1 for ways in toxicity.spelled(text, costs, {"snorkwit"}, 8) for way in ways for w in way)
    assert toxicity.joined(["go", "sn", "or", "kw", "it", "a"], {"snorkwit", "kwita"}, 8) == ("snorkwit",)


def test_toxicity_without_labels_or_rows(spark):
    docs = documents(spark, [(1, "some text"), (2, None)])
    assert [r.predicted for r in toxicity.toxicity(docs, labels(spark, [])).collect()] == [0, 0]
    assert toxicity.toxicity(documents(spark, []), labels(spark, [(1, 1, 1)])).collect() == []


def test_resampling_equals_brute_force(spark):
    good = [(i, prose(5, 40, 50) + f" w{i}") for i in range(30)]
    junk = [(100 + i, "&& %% " * 20 + f"x{i}") for i in range(30)]
    rows = good + junk + odd_rows()
    docs = documents(spark, rows)
    ratio = importance.log_ratio(
        importance.bucket_counts(documents(spark, good), 100), importance.bucket_counts(documents(spark, rows).fillna("", "text"), 100)
    )
    from docket.llm.common import word_hashes

    cache = word_hashes()
    got = importance.resample(docs, documents(spark, good), 0.5, buckets=100).collect()
    assert len(got) == len(rows)
    order = lambda pair: (pair[0] or -1, pair[1])
    weights = sorted(((i, sum(ratio[b] for b in importance.bucketed([t or ""], cache, 100)[0])) for i, t in rows), key=order)
    found = sorted(((r.doc_id, r.log_weight) for r in got), key=order)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 * (1 + abs(b[1])) for a, b in zip(found, weights))
    keys = sorted((r.key for r in got), reverse=True)
    bound = keys[-(-len(rows) // 2) - 1]
    assert all(r.kept == (r.key >= bound) for r in got)
    kept = {r.doc_id for r in got if r.kept}
    assert len(kept & {i for i, _ in good}) > 20 > len(kept & {i for i, _ in junk})
    assert importance.resample(documents(spark, []), documents(spark, good), 0.5, buckets=100).collect() == []


def test_top_bound_with_ties_and_signs(spark):
    values = [5, 5, 5, -7, -(2**40), 2**50, 0, 3, 3, -1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 4, 5, 8, 10):
        assert importance.top_bound(df, "v", k) == ordered[k - 1]


def test_good_rows_and_share(spark):
    docs = documents(spark, [(i, f"t{i}") for i in range(10)])
    marks = labels(spark, [(i, i % 2, 0) for i in range(10)] + [(None, 1, 0), (3, None, 0)])
    assert {r.doc_id for r in importance.good_rows(docs, marks).collect()} == {1, 3, 5, 7, 9}
    assert importance.good_rows(docs, marks, 2).count() == 2
    assert importance.good_share(labels(spark, [])) == 1.0
