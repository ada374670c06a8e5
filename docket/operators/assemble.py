"""Order, page manifest and page stream of the assembled report."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket import fixed_values as fv
from docket.functions import metrics, names
from docket.operators.excerpt import join_pages, kept_pages
from docket.operators.scan import biggest_group, group_join, ordered_scan
from docket.schema import SECTION_NAMES, position_of

Size = DataFrame | tuple[int, int] | None

PLACES = 1024  # places of a run that one row is spread to at most
ORDER = ["section_pos", "key1", "key2", "key3", "sort_name", "doc_id"]


def assembly_candidates(filings: DataFrame) -> DataFrame:
    return filings.filter(metrics.is_candidate(F.col("is_included"), F.col("status")))


def natural_key(name: Column) -> Column:
    """Sort key in which every number counts by value: the texts between numbers, each with the number after it as its length
    without leading zeros and its digits. No width is set, so no digits are lost; names of equal key go by their text."""
    part = r"(\D*)0*(\d*)"
    texts = F.regexp_extract_all(name, F.lit(part), F.lit(1))
    digits = F.regexp_extract_all(name, F.lit(part), F.lit(2))
    parts = F.zip_with(texts, digits, lambda t, d: F.struct(t.alias("text"), F.length(d).alias("size"), d.alias("digits")))
    return F.struct(parts.alias("parts"), name.alias("name"))


def sort_columns(df: DataFrame, strict: bool = False, natural: bool = False) -> DataFrame:
    """The columns a report is ordered by. Appendix D goes by sub-group, supporting reports by source; in Appendix E
    property profiles come first behind divider pages, unless ``strict``, where only the stored order counts."""
    section, order = F.col("category"), F.col("sort_order")
    low = F.lower("original_filename")
    sub = position_of(F.col("subcategory"), fv.SUBCATEGORIES, fv.OTHER_POSITION)
    group = metrics.source_group(F.col("original_filename"), F.col("original_path"))
    profile = F.col("is_profile") if "is_profile" in df.columns else low.rlike(fv.PROFILE_NAME)
    in_d, in_e, after = (section == s for s in ("APPENDIX_D", "APPENDIX_E", "REPORTS_AFTER_E"))
    zero = F.lit(0)
    key1, key2, key3 = F.when(in_d, sub), F.when(in_d, order).when(after, group), zero
    if not strict:
        key1 = key1.when(in_e, F.when(order < 0, 0).otherwise(1))
        key2 = key2.when(in_e, F.when(profile, 0).otherwise(1))
        key3 = F.when(in_e, order).otherwise(0)
    return df.withColumns(
        {
            "section_pos": position_of(section, SECTION_NAMES),
            "key1": key1.otherwise(order).cast("int"),
            "key2": key2.otherwise(0).cast("int"),
            "key3": key3.cast("int"),
            "sort_name": natural_key(low) if natural else low,
        }
    )


def _without_reliance(reports: DataFrame) -> DataFrame:
    """(report, section) pairs that are switched off."""
    return reports.filter(~F.col("has_reliance_letter")).select("report_id", F.lit("RELIANCE_LETTER").alias("category"))


def placeable(filings: DataFrame, reports: DataFrame) -> DataFrame:
    """Candidates that have a place in their report."""
    ready = assembly_candidates(filings).filter(F.col("category").isin(*SECTION_NAMES))
    return group_join(ready, _without_reliance(reports), ["report_id", "category"], "left_anti")


def omitted(filings: DataFrame, reports: DataFrame) -> DataFrame:
    """Candidates that drop out of assembly, with the reason."""
    off = _without_reliance(reports).withColumn("off", F.lit(True))
    why = F.when(~F.col("category").isin(*SECTION_NAMES), "unclassified").when(F.col("off"), "reliance letter not wanted")
    return (
        group_join(assembly_candidates(filings), off, ["report_id", "category"], "left")
        .withColumn("omitted_because", why)
        .filter("omitted_because IS NOT NULL")
        .drop("off")
    )


def assembly_order(
    filings: DataFrame, reports: DataFrame, strict: bool = False, natural: bool = False, group_rows: int | None = None,
    size: Size = None,
) -> DataFrame:
    """Place of every document in its report."""
    size = size if isinstance(size, tuple) else biggest_group(size or filings, ["report_id"])
    ready = sort_columns(placeable(filings, reports), strict, natural)
    return ordered_scan(ready, ["report_id"], ORDER, position="pos", group_rows=group_rows, size=size)


def manifest(
    filings: DataFrame, reports: DataFrame, doc_pages: DataFrame | None = None, strict: bool = False,
    natural: bool = False, group_rows: int | None = None, size: Size = None,
) -> DataFrame:
    """Page range of every document. Page counts are the stored ones, or what ``doc_pages`` really holds after blank
    tails are stripped. Report sizes are taken from all filings, which is cheaper than from the ones with a place."""
    slim = filings.select(
        "report_id", "doc_id", "original_filename", "original_path", "category", "subcategory", "sort_order", "status",
        "is_included", "page_count", *[c for c in ("ext", "is_profile") if c in filings.columns],
    )
    size = size if isinstance(size, tuple) else biggest_group(size or slim, ["report_id"])
    ready = sort_columns(placeable(slim, reports), strict, natural)
    if doc_pages is not None:
        counts = kept_pages(doc_pages, slim)
        ready = ready.drop("page_count").join(counts, "doc_id").withColumnRenamed("kept", "page_count")
    ready = ready.withColumn("page_count", metrics.pages_or_zero(F.col("page_count"))).select(
        "report_id", "original_filename", "category", "subcategory", "page_count", *ORDER
    )
    placed = ordered_scan(
        ready, ["report_id"], ORDER, position="pos", sums={"end_page": F.col("page_count")}, group_rows=group_rows,
        size=size,
    )
    return placed.select(
        "report_id",
        "pos",
        "doc_id",
        F.col("original_filename").alias("filename"),
        "category",
        "subcategory",
        (F.col("end_page") - F.col("page_count") + 1).alias("start_page"),
        "end_page",
        "page_count",
    )


def assembled_pages(manifest_rows: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """The page stream: global page, document, page within it. Kept pages are a document's first ones, so the global
    page is plain addition."""
    spans = manifest_rows.select("report_id", "doc_id", "start_page", "page_count")
    return (
        join_pages(doc_pages, spans, "page_count")
        .filter(F.col("page_no") < F.col("page_count"))
        .select(
            "report_id",
            (F.col("start_page") + F.col("page_no")).alias("global_page"),
            "doc_id",
            "page_no",
            "n_bytes",
        )
    )


def page_lookup(manifest_rows: DataFrame, page_refs: DataFrame, block: int = 256) -> DataFrame:
    """Manifest entry of each referred page. Entries are listed under every block of pages they touch and references
    look only into their own block, which holds at most ``block`` entries: a big report does not meet all its
    references."""
    spans = manifest_rows.filter("page_count > 0").withColumn(
        "__block",
        F.explode(F.sequence(F.floor((F.col("start_page") - 1) / block), F.floor((F.col("end_page") - 1) / block))),
    )
    refs = page_refs.withColumn("__block", F.floor((F.col("page") - 1) / block))
    return refs.join(spans, ["report_id", "__block"]).filter(F.col("page").between(F.col("start_page"), F.col("end_page"))).drop("__block")


def manifest_neighbours(manifest_rows: DataFrame, group_rows: int | None = None, size: Size = None) -> DataFrame:
    """First page of the document before and after each entry."""
    start = F.col("start_page")
    return ordered_scan(
        manifest_rows, ["report_id"], ["pos"], lags={"prev_start": start}, leads={"next_start": start}, group_rows=group_rows,
        size=size,
    )


def section_pages(manifest_rows: DataFrame) -> DataFrame:
    return manifest_rows.groupBy("report_id", "category").agg(
        F.sum("page_count").alias("pages"), F.count(F.lit(1)).alias("docs")
    )


def page_reconcile(filings: DataFrame, manifest_rows: DataFrame, tol: float = 1.1) -> DataFrame:
    """Stored against assembled page counts; a surplus beyond ``tol`` hints at duplicates."""
    expected = assembly_candidates(filings).groupBy("report_id").agg(
        F.sum(metrics.pages_or_zero(F.col("page_count"))).alias("expected_pages")
    )
    got = manifest_rows.groupBy("report_id").agg(F.sum("page_count").alias("assembled_pages"))
    both = expected.join(got, "report_id", "left").withColumn("assembled_pages", F.coalesce("assembled_pages", F.lit(0).cast("long")))
    e, a = F.col("expected_pages"), F.col("assembled_pages")
    return both.withColumns({"surplus": (e > 0) & (a > e * tol), "lost_pages": F.greatest(e - a, F.lit(0).cast("long"))})


def _replayer() -> Callable:
    """The replay of a log of moves, as a function that travels with the job, so workers need no copy of this package."""

    def replay(moves: Iterable[tuple[int, str, int | None]], size: int) -> list[tuple[int, int, int]]:
        """(lo, hi, at): where the rows that stood at places lo up to hi stand after a log of moves (place of the moved row at the
        start, kind, place at the start of the row it is dropped on), for a list of ``size`` rows.

        The list is kept as runs of rows that nobody has parted yet: rows that the log names stand alone from the start, and a
        neighbour that one of them steps over is parted from its run then. So the log's length counts, not the list's. Runs stand
        in chunks; a step looks into its own chunk and the one beside it, and a drop compares two places by their chunks' ranks."""
        moves = list(moves)
        most = 256
        lows, highs, homes = [], [], []

        def run(lo, hi):
            lows.append(lo)
            highs.append(hi)
            homes.append(None)
            return len(lows) - 1

        alone, order, end = {}, [], 0
        for place in sorted({m[0] for m in moves} | {m[2] for m in moves if m[1] == "to"}):
            if end < place:
                order.append(run(end, place))
            alone[place] = run(place, place + 1)
            order.append(alone[place])
            end = place + 1
        if end < size:
            order.append(run(end, size))

        class Chunk:
            __slots__ = ("runs", "rank")

            def __init__(self, held):
                self.runs = held
                for r in held:
                    homes[r] = self

        chunks = [Chunk(order[i : i + most // 2]) for i in range(0, len(order), most // 2)]

        def rank(start):
            for i in range(start, len(chunks)):
                chunks[i].rank = i

        rank(0)

        def put(r, home, at):
            home.runs.insert(at, r)
            homes[r] = home
            if len(home.runs) > most:
                chunks.insert(home.rank + 1, Chunk(home.runs[most // 2 :]))
                del home.runs[most // 2 :]
                rank(home.rank + 1)

        def step(r, by):
            """Let a run of one row change places with the row before or after it."""
            home = other = homes[r]
            beside = home.runs.index(r) + by
            if not 0 <= beside < len(home.runs):
                if not 0 <= home.rank + by < len(chunks):
                    return
                other = chunks[home.rank + by]
                beside = 0 if by > 0 else len(other.runs) - 1
            near = other.runs[beside]
            if highs[near] - lows[near] > 1:
                if by > 0:
                    row = run(lows[near], lows[near] + 1)
                    lows[near] += 1
                    put(row, other, beside)
                else:
                    row = run(highs[near] - 1, highs[near])
                    highs[near] -= 1
                    put(row, other, beside + 1)
                near = row
            one, two = homes[r], homes[near]
            i, j = one.runs.index(r), two.runs.index(near)
            one.runs[i], two.runs[j] = near, r
            homes[r], homes[near] = two, one

        def drop(r, over):
            if r == over:
                return
            home, there = homes[r], homes[over]
            later = home.rank < there.rank or (home is there and home.runs.index(r) < home.runs.index(over))
            home.runs.remove(r)
            if not home.runs:
                del chunks[home.rank]
                rank(home.rank)
            put(r, there, there.runs.index(over) + later)

        for place, kind, over in moves:
            if kind == "to":
                drop(alone[place], alone[over])
            else:
                step(alone[place], {"up": -1, "down": 1}[kind])
        out, at = [], 0
        for chunk in chunks:
            for r in chunk.runs:
                lo, hi = lows[r], highs[r]
                if out and out[-1][1] == lo:
                    out[-1] = (out[-1][0], hi, out[-1][2])
                else:
                    out.append((lo, hi, at))
                at += hi - lo
        return out

    return replay


def move_log(filings: DataFrame, moves: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Replay a log of moves (report_id, seq, doc_id, kind up/down/to, over_id), any number per section and in the order of
    ``seq``, and number the sections it touches from 0: (report_id, category, doc_id, sort_order). Each move goes by the order that
    those before it left. Moves at the edge of a section, or of or onto documents that it does not show, change nothing; a drop
    onto another section is no move within one (``move_in_section``).

    A section's moves are replayed in one task, small sections one after the other in the same call, but documents are not: the
    task knows their number, and gives back where runs of them stand. Runs are spread to places, and each document looks up its
    own."""
    placed = display_order(filings.select("report_id", "category", "sort_order", "doc_id", "is_included"), group_rows)
    at = placed.select("report_id", "doc_id", "category", "place")
    over = at.select("report_id", F.col("doc_id").alias("over_id"), F.col("category").alias("over_category"), F.col("place").alias("over"))
    sizes = placed.groupBy("report_id", "category").agg(F.count(F.lit(1)).alias("n"))
    asked = moves.select("report_id", "seq", "doc_id", "kind", "over_id").join(at, ["report_id", "doc_id"]).join(over, ["report_id", "over_id"], "left")
    onto = (F.col("kind") != "to") | ((F.col("over_category") == F.col("category")) & (F.col("over_id") != F.col("doc_id")))
    each = asked.filter(onto & F.col("kind").isin("up", "down", "to")).join(sizes, ["report_id", "category"])

    replay = _replayer()

    def runs(batches):
        """Sections come one after the other, each with its moves in order; one may go over many batches."""
        import pyarrow as pa

        names = ["report_id", "category", "lo", "hi", "start"]
        kinds = pa.schema([("report_id", pa.int64()), ("category", pa.string()), *[(n, pa.int64()) for n in names[2:]]])

        def listed(sections):
            rows = [(*key[:2], *r) for key, log in sections for r in replay(log, key[2])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

        section, log = None, []
        for batch in batches:
            done = []
            for *key, place, kind, over in zip(*[c.to_pylist() for c in batch.columns]):
                if key != section:
                    if log:
                        done.append((section, log))
                    section, log = key, []
                log.append((place, kind, over))
            if done:
                yield listed(done)
        if log:
            yield listed([(section, log)])

    dealt = each.repartition("report_id", "category").sortWithinPartitions("report_id", "category", "seq")
    found = dealt.select("report_id", "category", "n", "place", "kind", "over").mapInArrow(
        runs, "report_id long, category string, lo long, hi long, start long"
    )
    block = F.explode(F.sequence(F.floor(F.col("lo") / PLACES), F.floor((F.col("hi") - 1) / PLACES)))
    first, last = F.greatest("lo", F.col("block") * PLACES), F.least("hi", (F.col("block") + 1) * PLACES) - 1
    each_place = found.withColumn("block", block).withColumn("place", F.explode(F.sequence(first, last)))
    stands = each_place.select("report_id", "category", "place", (F.col("start") + F.col("place") - F.col("lo")).cast("int").alias("now"))
    met = placed.select("report_id", "category", "doc_id", F.col("place").cast("long")).join(stands, ["report_id", "category", "place"])
    return met.select("report_id", "category", "doc_id", F.col("now").alias("sort_order"))


# --- lists a user sees -----------------------------------------------------------------------------------------------


def document_list(filings: DataFrame) -> DataFrame:
    return filings.orderBy("report_id", "category", "sort_order", "doc_id")


def display_order(filings: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Place of included documents within their section on screen, from 0."""
    shown = filings.filter("is_included")
    placed = ordered_scan(shown, ["report_id", "category"], ["sort_order", "doc_id"], position="place", group_rows=group_rows, size=filings)
    return placed.withColumn("place", F.col("place") - 1)


def chat_history(messages: DataFrame, by: str = "conv_id", at: str = "turn") -> DataFrame:
    return messages.orderBy(by, at)


def select_range(filings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Included documents between two anchors (report_id, seq, from_id, to_id) in list order, either way round; a
    report's latest selection counts. List keys are compared with the two ends; nothing is numbered."""
    key = F.struct("category", "sort_order", "doc_id").alias("key")
    rows = filings.filter("is_included").select("report_id", "doc_id", key)
    ends = anchors.groupBy("report_id").agg(F.max_by(F.struct("from_id", "to_id"), "seq").alias("a")).select("report_id", "a.*")
    for side in ("from", "to"):
        at = rows.select("report_id", F.col("doc_id").alias(f"{side}_id"), F.col("key").alias(f"{side}_key"))
        ends = ends.join(at, ["report_id", f"{side}_id"])
    ends = ends.select("report_id", F.least("from_key", "to_key").alias("lo"), F.greatest("from_key", "to_key").alias("hi"))
    within = F.col("key").between(F.col("lo"), F.col("hi"))
    return group_join(rows, ends, ["report_id"]).filter(within).select("report_id", "doc_id")


def move_in_section(filings: DataFrame, moves: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Move one document of a section one place up or down, or to the place of another one, and number the section
    from 0. ``moves``: (report_id, doc_id, kind up/down/to, over_id), one move per section. A document dropped onto one of
    another section goes to that section and keeps its stored order; neither section is numbered again."""
    placed = display_order(filings.select("report_id", "category", "sort_order", "doc_id", "is_included"), group_rows)
    at = placed.select("report_id", "doc_id", "category", "sort_order", F.col("place").alias("src"))
    over = placed.select(
        "report_id", F.col("doc_id").alias("over_id"), F.col("category").alias("over_category"), F.col("place").alias("over_place")
    )
    sizes = placed.groupBy("report_id", "category").agg(F.count(F.lit(1)).alias("n"))
    both = moves.join(at, ["report_id", "doc_id"]).join(over, ["report_id", "over_id"], "left")
    crossing = (F.col("kind") == "to") & (F.col("over_category") != F.col("category"))
    dropped = both.filter(crossing).select("report_id", F.col("over_category").alias("category"), "doc_id", "sort_order")
    plan = (
        both.join(sizes, ["report_id", "category"])
        .withColumn(
            "dst",
            F.when(F.col("kind") == "up", F.col("src") - 1)
            .when(F.col("kind") == "down", F.col("src") + 1)
            .when(F.col("over_category") == F.col("category"), F.col("over_place")),
        )
        .filter((F.col("dst") >= 0) & (F.col("dst") < F.col("n")))
        .select("report_id", "category", F.col("doc_id").alias("moved"), "src", "dst")
    )
    p, src, dst = F.col("place"), F.col("src"), F.col("dst")
    new = (
        F.when(F.col("doc_id") == F.col("moved"), dst)
        .when((p > src) & (p <= dst), p - 1)
        .when((p < src) & (p >= dst), p + 1)
        .otherwise(p)
    )
    numbered = group_join(placed, plan, ["report_id", "category"]).select(
        "report_id", "category", "doc_id", new.cast("int").alias("sort_order")
    )
    return numbered.unionByName(dropped)
