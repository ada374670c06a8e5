"""Command replay and undo against a plain stack, on random logs."""

import random

import pytest

from docket.operators import actions as act

SECTIONS = ["APPENDIX_A", "APPENDIX_B", "APPENDIX_C", "BOGUS"]
LOG = "report_id bigint, seq bigint, action string, params struct<doc_ids:array<bigint>,target_section:string,reason:string,query:string>"


def random_log(rnd, reports=2, docs=6, n=60):
    kinds = ["move", "exclude", "include", "undo", "undo", "manual", "search"]
    out = []
    for seq in range(n):
        r = rnd.randrange(1, reports + 1)
        ids = [rnd.randrange(1, reports * docs + 1) for _ in range(rnd.randrange(0, 4))]
        out.append((r, seq, rnd.choice(kinds), (ids, rnd.choice(SECTIONS), rnd.choice([None, "why"]), None)))
    return out


def replay(docs, log, strict):
    """The rules as a plain loop: a stack of snapshots per report."""
    state = {d["doc_id"]: dict(d) for d in docs}
    stacks = {}
    for report, _, action, (ids, target, reason, _) in sorted(log, key=lambda x: x[1]):
        stack = stacks.setdefault(report, [])
        mine = [i for i in dict.fromkeys(ids) if i in state and state[i]["report_id"] == report]
        if action == "undo":
            for i, old in (stack.pop() if stack else {}).items():
                conf = state[i]["confidence"] if strict else old["confidence"]
                state[i] = {**old, "confidence": conf}
            continue
        if action in ("move", "manual") and target == "BOGUS":
            continue
        if action in ("move", "exclude", "include"):
            stack.append({i: dict(state[i]) for i in mine})
        for i in mine:
            s = state[i]
            if action == "move":
                s.update(category=target, reasoning="Moved via chat command", confidence=1.0)
            elif action == "manual":
                s.update(category=target, reasoning="Manually classified by user", confidence=1.0)
            elif action == "exclude":
                s.update(is_included=False, reasoning=(s["reasoning"] or "") + f" [{reason or 'Excluded via chat command'}]")
            elif action == "include":
                s.update(is_included=True)
    return state


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("strict", [False, True])
def test_undo_is_a_stack(spark, filings, seed, strict):
    rnd = random.Random(seed)
    df = filings(*[{"report_id": 1 + i // 6, "confidence": 0.5, "reasoning": None if i % 2 else "r"} for i in range(12)])
    log = random_log(rnd)
    want = replay([r.asDict() for r in df.collect()], log, strict)
    limit = 5 if seed == 3 else None
    got = act.undo_fold(df, spark.createDataFrame(log, LOG), strict=strict, group_rows=limit)
    for r in got.collect():
        assert r.asDict() == want[r.doc_id]


def test_undo_of_one_document(spark, filings):
    df = filings({"category": "APPENDIX_A"})
    move, out, edit, undo = ("move", "APPENDIX_B"), ("exclude", None), ("manual", "APPENDIX_C"), ("undo", None)
    log = [(1, i, k, ([1], t, None, None)) for i, (k, t) in enumerate([move, out, edit, undo, undo, undo])]
    row = act.undo_fold(df, spark.createDataFrame(log, LOG)).first()
    assert (row.category, row.is_included, row.reasoning) == ("APPENDIX_A", True, None)
    assert act.undo_pairs(spark.createDataFrame(log, LOG)).count() == 2


def test_commands_from_json(spark):
    text = '[{"action": "move", "params": {"doc_ids": [1, 2], "target_section": "APPENDIX_D"}}, {"action": "info", "params": {}}]'
    got = act.read_actions(spark.createDataFrame([(1, text), (2, "oops")], "m int, actions_json string")).collect()
    assert [(r.m, r.action, r.params.doc_ids) for r in got] == [(1, "move", [1, 2]), (1, "info", None)]


def test_snapshots_in_slices(spark, filings):
    rnd = random.Random(11)
    df = filings(*[{"report_id": 1 + i // 6} for i in range(12)])
    log = spark.createDataFrame(random_log(rnd), LOG)
    plain, sliced = act.action_snapshots(df, log), act.action_snapshots(df, log, group_rows=3)
    assert sorted(map(str, plain.collect())) == sorted(map(str, sliced.collect()))


def test_selection_toggle_twice_is_identity(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "report_id bigint, doc_id bigint")
    b = spark.createDataFrame([(1, 2), (1, 3)], "report_id bigint, doc_id bigint")
    toggled = act.selection_ops(a, b).filter("op = 'toggle'").drop("op")
    back = act.selection_ops(toggled, b).filter("op = 'toggle'").drop("op")
    assert sorted(map(tuple, back.collect())) == [(1, 1), (1, 2)]


def test_reorder_clears_the_profile_mark(spark, filings):
    from pyspark.sql import functions as F

    df = filings({}, {}).withColumn("is_profile", F.lit(True))
    asked = spark.createDataFrame([(1, 1, "APPENDIX_B", [2])], "report_id bigint, seq bigint, category string, doc_ids array<bigint>")
    got = {r.doc_id: (r.category, r.sort_order, r.is_profile) for r in act.reorder_section(df, asked).collect()}
    assert got == {1: ("APPENDIX_E", 0, True), 2: ("APPENDIX_B", 0, False)}


def test_messages_wait_for_a_confirmation(spark, filings):
    df = filings(*[{} for _ in range(12)])
    say = lambda ids, kind="exclude": '{"action": "%s", "params": {"doc_ids": %s, "target_section": "APPENDIX_A"}}' % (kind, ids)
    rows = [
        (1, 1, f"[{say([1, 2])}, {say([1], 'include')}]"), (1, 2, f"[{say(list(range(1, 12)))}]"),
        (1, 3, f"[{say([3] * 6)}, {say([4] * 5)}]"), (1, 4, f"[{say([5] * 10, 'move')}]"), (1, 5, "no list"), (1, 6, None),
    ]
    messages = spark.createDataFrame(rows, "report_id bigint, seq bigint, actions_json string")
    size = {r.seq: (r.affected, r.needs_confirmation) for r in act.message_footprint(act.read_actions(messages)).collect()}
    assert size == {1: (3, False), 2: (11, True), 3: (11, True), 4: (10, False)}
    got = {r.doc_id: (r.is_included, r.category) for r in act.apply_messages(df, messages).collect()}
    assert [d for d in got if not got[d][0]] == [2] and got[5][1] == "APPENDIX_A"
    sure = spark.createDataFrame([(1, 3)], "report_id bigint, seq bigint")
    got = {r.doc_id: r.is_included for r in act.apply_messages(df, messages, confirmed=sure).collect()}
    assert sorted(d for d in got if not got[d]) == [2, 3, 4]
