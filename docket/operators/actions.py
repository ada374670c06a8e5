"""Commands, manual edits and undo over an append-only action log.

Stored state is never updated in place: a base table and a log of events are folded to the current state. Every field of
a document is what its last surviving write says, so folding is a set of ``max_by`` aggregates. Undo is worked out on
the log alone: which commands were taken back, and which events of each document fall inside a taken-back span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docket.functions import metrics
from docket.operators.scan import biggest_group, group_join, ordered_scan
from docket.schema import ACTIONS, known_section
from docket.session import stored

SNAPSHOT_KINDS = ["move", "exclude", "include"]
DEFERRED_KINDS = ["assemble", "compress", "split", "undo", "text_replace", "delete_pages"]
CONFIRM_ABOVE = 10


def read_actions(messages: DataFrame, column: str = "actions_json") -> DataFrame:
    """One row per command of a message's JSON command list."""
    listed = F.from_json(column, ACTIONS, {"mode": "PERMISSIVE"})
    return messages.select("*", F.posexplode(listed).alias("action_no", "a")).select(
        *messages.columns, "action_no", "a.action", "a.params"
    )


def _valid(actions: DataFrame) -> DataFrame:
    """Commands that change documents."""
    is_move = F.col("action") == "move"
    return actions.filter(
        F.col("action").isin("exclude", "include", "manual") | (is_move & known_section(F.col("params.target_section")))
    )


def action_events(filings: DataFrame, actions: DataFrame) -> DataFrame:
    """Per-document events of commands. ``manual`` stands for an edit outside the command bar: it changes the section
    like a move but takes no snapshot."""
    named = _valid(actions).select(
        "report_id", "seq", "action", "params.target_section", "params.reason",
        F.explode(F.array_distinct("params.doc_ids")).alias("doc_id"),
    )
    known = named.join(filings.select("report_id", "doc_id"), ["report_id", "doc_id"])
    kind, target = F.col("action"), F.col("target_section")
    placed = (kind == "move") | ((kind == "manual") & known_section(target))
    why = F.coalesce("reason", F.lit("Excluded via chat command"))
    return known.select(
        "report_id",
        "doc_id",
        "seq",
        F.when(placed, target).alias("set_category"),
        F.when(placed, F.lit(1.0)).alias("set_confidence"),
        F.when(placed & (kind == "move"), "Moved via chat command").when(placed, metrics.MANUAL_REASON).alias("set_reason"),
        F.when(kind == "exclude", F.concat(F.lit(" ["), why, F.lit("]"))).alias("add_reason"),
        F.when(kind == "exclude", False).when(kind == "include", True).alias("set_included"),
        kind.alias("kind"),
    )


def fold_events(filings: DataFrame, events: DataFrame) -> DataFrame:
    """State after all events. Reasons appended since the last overwrite are strung together in order; they are the one
    thing gathered per document, and they are the cell that results."""
    key = ["report_id", "doc_id"]

    def last(column: str):
        return F.max_by(F.when(F.col(column).isNotNull(), F.struct("seq", column)), F.when(F.col(column).isNotNull(), F.col("seq")))

    folded = events.groupBy(*key).agg(*[last(c).alias(c) for c in ("set_category", "set_confidence", "set_reason", "set_included")])
    since = events.filter("add_reason IS NOT NULL").select(*key, "seq", "add_reason").join(
        folded.select(*key, F.col("set_reason.seq").alias("reset")), key
    )
    added = (
        since.filter(F.col("seq") > F.coalesce("reset", F.lit(-1).cast("long")))
        .groupBy(*key)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "add_reason"))), lambda x: x.add_reason), "").alias("added"))
    )
    base = F.coalesce("set_reason.set_reason", "reasoning")
    return (
        filings.join(folded, key, "left")
        .join(added, key, "left")
        .withColumns(
            {
                "category": F.coalesce("set_category.set_category", "category"),
                "confidence": F.coalesce("set_confidence.set_confidence", "confidence"),
                "reasoning": F.when(F.col("added").isNotNull(), F.concat(F.coalesce(base, F.lit("")), F.col("added"))).otherwise(base),
                "is_included": F.coalesce("set_included.set_included", "is_included"),
            }
        )
        .select(*filings.columns)
    )


def apply_actions(filings: DataFrame, actions: DataFrame) -> DataFrame:
    """State after the log's moves, exclusions and inclusions."""
    return fold_events(filings, action_events(filings, actions.filter(F.col("action").isin(*SNAPSHOT_KINDS))))


def message_footprint(commands: DataFrame, limit: int = CONFIRM_ABOVE) -> DataFrame:
    """Per message (report_id, seq) the ids its commands name, repetitions counted, and whether that many need a confirmation."""
    named = F.greatest(F.coalesce(F.size("params.doc_ids"), F.lit(0)), F.lit(0))
    out = commands.groupBy("report_id", "seq").agg(F.sum(named).alias("affected"))
    return out.withColumn("needs_confirmation", F.col("affected") > limit)


def apply_messages(filings: DataFrame, messages: DataFrame, limit: int = CONFIRM_ABOVE, confirmed: DataFrame | None = None) -> DataFrame:
    """State after messages (report_id, seq, actions_json) with command lists. A message that names more than ``limit`` ids is
    not carried out, unless ``confirmed`` lists its (report_id, seq). Commands act in the order of messages and lists."""
    commands = read_actions(messages)
    key = ["report_id", "seq"]
    waiting = message_footprint(commands, limit).filter("needs_confirmation").select(*key)
    if confirmed is not None:
        waiting = waiting.join(confirmed.select(*key), key, "left_anti")
    free = commands.join(waiting, key, "left_anti")
    # Message and place in its list as one number: a list has fewer than 2 ** 31 entries.
    place = F.col("seq").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(11,0)") + F.col("action_no")
    return apply_actions(filings, free.withColumn("seq", place))


def action_results(filings: DataFrame, actions: DataFrame) -> DataFrame:
    """What each command of the log answers: documents changed, an error, or deferred to another operator."""
    ids = actions.filter(F.col("action").isin(*SNAPSHOT_KINDS)).select(
        "report_id", "seq", F.explode(F.array_distinct("params.doc_ids")).alias("doc_id")
    )
    hit = ids.join(filings.select("report_id", "doc_id"), ["report_id", "doc_id"]).groupBy("report_id", "seq").agg(
        F.count(F.lit(1)).alias("changed")
    )
    kind, target = F.col("action"), F.coalesce("params.target_section", F.lit(""))
    bad_move = (kind == "move") & ~known_section(target)
    outcome = (
        F.when(bad_move, F.concat(F.lit("Invalid section: "), target))
        .when(kind.isin(*SNAPSHOT_KINDS, "search", "info"), "done")
        .when(kind.isin(*DEFERRED_KINDS), "deferred")
        .otherwise("Unknown action")
    )
    changed = F.when(kind.isin(*SNAPSHOT_KINDS) & ~bad_move, F.coalesce("changed", F.lit(0).cast("long")))
    return actions.join(hit, ["report_id", "seq"], "left").select("report_id", "seq", "action", outcome.alias("outcome"), changed.alias("changed"))


def action_snapshots(filings: DataFrame, actions: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Before-images: the state of every touched document just before each command. Each event is laid out as a read
    followed by a write; running maxima over the writes give what a read sees."""
    key = ["report_id", "doc_id"]
    events = action_events(filings, actions.filter(F.col("action").isin(*SNAPSHOT_KINDS)))
    marks = events.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1))))
    write = F.col("step") == 1
    fields = {"set_category": "w_category", "set_reason": "w_reason", "set_included": "w_included"}
    maxs = {w: F.when(write & F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v"))) for c, w in fields.items()}
    seen = ordered_scan(marks, key, ["seq", "step"], maxs=maxs, group_rows=group_rows)
    # Reasons appended since the overwrite a read sees: one ordered list per document and overwrite, of which each read takes
    # as many as were there before it.
    seen = seen.withColumn("epoch", F.coalesce("w_reason.seq", F.lit(-1).cast("long")))
    added = write & F.col("add_reason").isNotNull()
    before = Window.partitionBy(*key, "epoch").orderBy("seq", "step").rowsBetween(Window.unboundedPreceding, -1)
    reads = seen.withColumn("n_adds", F.count(F.when(added, 1)).over(before).cast("int")).filter("step = 0")
    lists = seen.filter(added).groupBy(*key, "epoch").agg(F.array_sort(F.collect_list(F.struct("seq", "add_reason"))).alias("adds"))
    reads = reads.join(lists, [*key, "epoch"], "left")
    text = F.array_join(F.transform(F.slice("adds", F.lit(1), F.col("n_adds")), lambda x: x.add_reason), "")
    reads = reads.withColumn("adds", F.coalesce(text, F.lit("")))
    base = F.coalesce("w_reason.v", "reasoning")
    return reads.join(filings.select(*key, "category", "subcategory", "is_included", "sort_order", "reasoning"), key).select(
        *key,
        "seq",
        F.coalesce("w_category.v", "category").alias("category"),
        "subcategory",
        F.coalesce("w_included.v", "is_included").alias("is_included"),
        "sort_order",
        F.when(F.col("adds") != "", F.concat(F.coalesce(base, F.lit("")), F.col("adds"))).otherwise(base).alias("reasoning"),
    )


def undo_pairs(actions: DataFrame, group_rows: int | None = None) -> DataFrame:
    """(report_id, push_seq, undo_seq): which command each undo takes back.

    Commands push, undos pop, and a pop on an empty stack does nothing. The stack height is a running sum of +1 and -1
    above its own running minimum; an undo belongs to the last push that reached the height it starts from, which is the
    row before it among the pushes and undos of that height."""
    size = biggest_group(actions, ["report_id"])
    log = _valid(actions).filter(F.col("action").isin(*SNAPSHOT_KINDS)).unionByName(actions.filter("action = 'undo'"))
    delta = F.when(F.col("action") == "undo", -1).otherwise(1).cast("long")
    steps = log.select("report_id", "seq", delta.alias("delta"))
    sums = ordered_scan(steps, ["report_id"], ["seq"], sums={"total": F.col("delta")}, group_rows=group_rows, size=size)
    before = F.col("total") - F.col("delta")
    low = ordered_scan(sums, ["report_id"], ["seq"], mins={"floor": before}, group_rows=group_rows, size=size)
    low = low.withColumn("floor", F.least("floor", F.lit(0).cast("long")))
    is_undo = F.col("delta") < 0
    live = low.filter(~is_undo | (before > F.col("floor")))
    level = F.when(is_undo, before - F.col("floor")).otherwise(F.col("total") - F.col("floor"))
    levelled = live.select("report_id", "seq", "delta", level.alias("level"))
    paired = ordered_scan(levelled, ["report_id", "level"], ["seq"], lags={"push_seq": F.col("seq")}, group_rows=group_rows, size=size)
    return paired.filter(is_undo).select("report_id", "push_seq", F.col("seq").alias("undo_seq"))


def surviving_events(events: DataFrame, pairs: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Events that no undo has taken back. An undo restores the documents of its command to the state before it, so it
    cancels all their events from the command on. Spans nest, so an event is cancelled while any span of its document
    is open."""
    key = ["report_id", "doc_id"]
    spans = pairs.join(
        events.filter(F.col("kind").isin(*SNAPSHOT_KINDS)).select(*key, F.col("seq").alias("push_seq")), ["report_id", "push_seq"]
    )
    ends = F.array(
        F.struct(F.col("push_seq").alias("seq"), F.lit(1).cast("long").alias("delta")),
        F.struct(F.col("undo_seq").alias("seq"), F.lit(-1).cast("long").alias("delta")),
    )
    marks = spans.select(*key, F.inline(ends)).withColumn("step", F.lit(0))
    own = events.withColumns({"step": F.lit(1), "delta": F.lit(0).cast("long")})
    line = own.unionByName(marks, allowMissingColumns=True)
    # A document's line holds its events and two ends per span, and spans come from its own events.
    top, total = biggest_group(events, key)
    open_ = ordered_scan(
        line, key, ["seq", "step"], sums={"open": F.col("delta")}, group_rows=group_rows, size=(3 * top, 3 * total)
    )
    return open_.filter("step = 1 AND open = 0").select(*events.columns)


def undo_fold(filings: DataFrame, actions: DataFrame, strict: bool = False, group_rows: int | None = None) -> DataFrame:
    """State after a log of commands, manual edits and undos. ``strict`` leaves the confidence as the last command set
    it, taken back or not."""
    events = action_events(filings, actions)
    # The log's survivors are folded more than once: keep them rather than the scans that found them.
    alive = stored(surviving_events(events, undo_pairs(actions, group_rows), group_rows))
    out = fold_events(filings, alive)
    if not strict:
        return out
    kept = fold_events(filings, events).select("report_id", "doc_id", F.col("confidence").alias("__confidence"))
    return out.join(kept, ["report_id", "doc_id"]).withColumn("confidence", F.col("__confidence")).select(*filings.columns)


def batch_update(filings: DataFrame, requests: DataFrame) -> DataFrame:
    """Many documents at once: requests (report_id, seq, doc_ids, category, is_included); nulls leave a field alone."""
    has = F.col("new_category").isNotNull()
    events = requests.select(
        "report_id", "seq", F.explode(F.array_distinct("doc_ids")).alias("doc_id"),
        F.col("category").alias("new_category"), F.col("is_included").alias("set_included"),
    ).select(
        "report_id", "doc_id", "seq",
        F.col("new_category").alias("set_category"),
        F.when(has, F.lit(1.0)).alias("set_confidence"),
        F.when(has, "Batch update by user").alias("set_reason"),
        F.lit(None).cast("string").alias("add_reason"),
        "set_included",
    )
    return fold_events(filings, events)


def manual_update(filings: DataFrame, requests: DataFrame) -> DataFrame:
    """One edit per document (report_id, doc_id, new_category, new_subcategory, new_sort_order, new_included); nulls
    leave a field alone and a new section is taken as certain."""
    placed = F.col("new_category").isNotNull()
    return (
        filings.join(requests, ["report_id", "doc_id"], "left")
        .withColumns(
            {
                "category": F.coalesce("new_category", "category"),
                "subcategory": F.coalesce("new_subcategory", "subcategory"),
                "sort_order": F.coalesce("new_sort_order", "sort_order"),
                "is_included": F.coalesce("new_included", "is_included"),
                "confidence": F.when(placed, F.lit(1.0)).otherwise(F.col("confidence")),
                "reasoning": F.when(placed, metrics.MANUAL_REASON).otherwise(F.col("reasoning")),
            }
        )
        .select(*filings.columns)
    )


def reorder_section(filings: DataFrame, requests: DataFrame) -> DataFrame:
    """Ordered id lists (report_id, seq, category, doc_ids): place in the list becomes the sort order, and the list's
    section the document's. The latest list that names a document counts; a profile mark does not survive it."""
    listed = requests.select("report_id", "seq", F.col("category").alias("to"), F.posexplode("doc_ids").alias("place", "doc_id"))
    last = listed.groupBy("report_id", "doc_id").agg(F.max_by(F.struct("place", "to"), F.struct("seq", "place")).alias("r"))
    hit = F.col("r").isNotNull()
    changes = {
        "sort_order": F.coalesce("r.place", "sort_order"),
        "category": F.coalesce("r.to", "category"),
    }
    if "is_profile" in filings.columns:
        changes["is_profile"] = F.when(hit, False).otherwise(F.col("is_profile"))
    return filings.join(last, ["report_id", "doc_id"], "left").withColumns(changes).select(*filings.columns)


def latest_action(actions: DataFrame) -> DataFrame:
    return actions.groupBy("report_id").agg(F.max("seq").alias("seq"), F.max_by("action", "seq").alias("action"))


def action_footprint(actions: DataFrame, limit: int = CONFIRM_ABOVE) -> DataFrame:
    """Documents named by a report's commands, and whether that many need a confirmation."""
    named = F.coalesce(F.size("params.doc_ids"), F.lit(0))
    out = actions.groupBy("report_id").agg(F.sum(F.greatest(named, F.lit(0))).alias("affected"))
    return out.withColumn("needs_confirmation", F.col("affected") > limit)


def search_filename(filings: DataFrame, queries: DataFrame) -> DataFrame:
    """Case-insensitive substring search: queries (report_id, query), one per report."""
    hit = F.lower("original_filename").contains(F.lower("query"))
    return group_join(filings, queries, ["report_id"]).filter(hit).select(
        "report_id", "query", "doc_id", "original_filename", "category", "page_count", "is_included"
    )


def selection_ops(selected: DataFrame, ids: DataFrame) -> DataFrame:
    """Selections after add (union), remove (difference) and toggle (symmetric difference) requests, as rows of
    (report_id, op, doc_id); all three from one outer join."""
    key = ["report_id", "doc_id"]
    both = (
        selected.select(*key).distinct().withColumn("had", F.lit(True))
        .join(ids.select(*key).distinct().withColumn("named", F.lit(True)), key, "full")
        .withColumns({"had": F.coalesce("had", F.lit(False)), "named": F.coalesce("named", F.lit(False))})
    )
    ops = F.filter(
        F.array(
            F.when(F.col("had") | F.col("named"), "add"),
            F.when(F.col("had") & ~F.col("named"), "remove"),
            F.when(F.col("had") != F.col("named"), "toggle"),
        ),
        lambda x: x.isNotNull(),
    )
    return both.select("report_id", "doc_id", F.explode(ops).alias("op"))
