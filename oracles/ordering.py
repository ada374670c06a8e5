"""Order, manifest, page stream, listings and split plans."""

from docket import fixed_values as fv
from docket.sources.corpus import PAGE_CHARS  # noqa: F401
from oracles.classification import PRE, named
from oracles.scalars import norm_base  # noqa: F401
from oracles.tables import with_tables
from oracles.texts import KEPT

PROFILE = f"regexp_matches(lower(original_filename), '{fv.PROFILE_NAME}')"
SUB = "CASE subcategory WHEN 'sanborn' THEN 1 WHEN 'aerials' THEN 2 WHEN 'topos' THEN 3 WHEN 'city_directory' THEN 4 ELSE 99 END"


def _has(text: str) -> str:
    return f"(contains(lower(original_filename), '{text}') OR contains(lower(coalesce(original_path, '')), '{text}'))"


SOURCE = "CASE " + " ".join(f"WHEN {_has(t)} THEN {g}" for t, g in fv.SOURCE_GROUPS) + " ELSE 99 END"


def ordered(source: str, strict: bool = False, name_key: str = "lower(original_filename)") -> str:
    """CTE ``placed``: documents with their place in the report."""
    e_keys = "(CASE WHEN category = 'APPENDIX_E' THEN sort_order END)"
    if not strict:
        e_keys = (
            f"(CASE WHEN category = 'APPENDIX_E' THEN (CASE WHEN sort_order < 0 THEN 0 ELSE 1 END) * 1000000 "
            f"+ (CASE WHEN {PROFILE} THEN 0 ELSE 1 END) * 100000 + sort_order + 50000 END)"
        )
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY section_pos,
    CASE WHEN category = 'APPENDIX_D' THEN {SUB} ELSE 0 END, {e_keys}, CASE WHEN category <> 'APPENDIX_E' THEN sort_order END,
    CASE WHEN category = 'REPORTS_AFTER_E' THEN {SOURCE} ELSE 0 END, {name_key}, doc_id) AS pos
  FROM (SELECT f.*, s.section_pos FROM {source} f JOIN sections s ON s.section = f.category
        WHERE f.category <> 'UNCLASSIFIED' AND f.is_included AND f.status IN ('ready', 'classified')
          AND NOT (f.category = 'RELIANCE_LETTER' AND f.report_id IN (SELECT report_id FROM reports WHERE NOT has_reliance_letter))))"""


def manifest(pages: str = "coalesce(page_count, 0)", join: str = "") -> str:
    return f"""man AS (SELECT report_id, pos, doc_id, original_filename AS filename, category, subcategory, e - n + 1 AS start_page, e AS end_page, n AS page_count
  FROM (SELECT p.*, CAST({pages} AS BIGINT) AS n, CAST(sum({pages}) OVER (PARTITION BY report_id ORDER BY pos) AS BIGINT) AS e FROM placed p {join}))"""


STORED = f"{ordered('filings')}, {manifest()}"
REAL = f"{ordered('filings')}, {KEPT}, {manifest('kept', 'JOIN kept USING (doc_id)')}"
STREAM = f"""{REAL}, stream AS (SELECT m.report_id, m.start_page + p.page_no AS global_page, p.doc_id, p.page_no, p.n_bytes
  FROM man m JOIN doc_pages p USING (doc_id) WHERE p.page_no < m.page_count)"""
_LOW = "lower(original_filename)"
# The texts between numbers, and each number's length and digits without leading zeros, as lists; then the name.
_PART = "'([^0-9]*)0*([0-9]*)'"
NATURAL = [
    f"list_transform(list_zip(regexp_extract_all({_LOW}, {_PART}, 1), regexp_extract_all({_LOW}, {_PART}, 2)), lambda x: "
    "{'text': x[1], 'size': length(x[2]), 'digits': x[2]})",
    _LOW,
]
ORDERS = "reports sections filings"


def _head(show: str) -> str:
    return f"""l AS (SELECT report_id, category, doc_id, original_filename, coalesce(page_count, 0) AS page_count,
      row_number() OVER (PARTITION BY report_id, category ORDER BY sort_order, doc_id) AS rn, count(*) OVER (PARTITION BY report_id, category) AS n
    FROM filings WHERE is_included),
    h AS (SELECT *, rn <= {show} AS shown FROM l)
    SELECT report_id, category, CAST(rn AS INTEGER) AS rank, doc_id, original_filename, CAST(page_count AS BIGINT) AS page_count FROM h WHERE shown
    UNION ALL SELECT report_id, category, CAST(min(rn) AS INTEGER), NULL, '(' || count(*) || ' more similar files)', CAST(sum(page_count) AS BIGINT)
    FROM h WHERE NOT shown GROUP BY report_id, category"""


CLASS = "CASE " + " ".join(f"WHEN regexp_matches(lower(original_filename), '{p}') THEN '{c}'" for c, p in fv.KEY_REPORT_CLASSES) + " ELSE 'other' END"
PART = "SELECT report_id, part_number, start_page, end_page, end_page - start_page + 1 AS page_count FROM parts"
PER = "greatest(1, CAST(floor({cap} / (size / pages) * 0.9) AS BIGINT))"
ESTIMATE = f"""tt AS (SELECT report_id, CAST(sum(coalesce(page_count, 0)) AS BIGINT) AS pages, CAST(sum(file_size) AS BIGINT) AS size FROM filings GROUP BY report_id),
  pp AS (SELECT report_id, pages, CASE WHEN size <= 20971520 THEN pages ELSE {PER.format(cap=20971520)} END AS per FROM tt WHERE pages > 0),
  parts AS (SELECT report_id, i + 1 AS part_number, i * per + 1 AS start_page, least((i + 1) * per, pages) AS end_page
            FROM (SELECT *, unnest(range(CAST(ceil(pages / per) AS BIGINT))) AS i FROM pp))"""

# Walk each report part by part: lengths of the ladder are tried in turn against byte sums.
WALK = """sz AS (SELECT report_id, global_page AS p, n_bytes, sum(n_bytes) OVER (PARTITION BY report_id ORDER BY global_page) AS e,
    count(*) OVER (PARTITION BY report_id) AS n, sum(n_bytes) OVER (PARTITION BY report_id) AS total FROM stream),
  reach AS (SELECT a.report_id, a.p, a.n, a.total, (SELECT count(*) FROM sz b WHERE b.report_id = a.report_id AND b.e <= a.e - a.n_bytes + {cap}) - a.p + 1 AS fits FROM sz a),
  nx AS ({next}),
  walk(report_id, part_number, start_page, end_page) AS (
    SELECT report_id, 1::BIGINT, p, p + len - 1 FROM nx WHERE p = 1
    UNION ALL SELECT w.report_id, w.part_number + 1, x.p, x.p + x.len - 1 FROM walk w JOIN nx x ON x.report_id = w.report_id AND x.p = w.end_page + 1),
  parts AS (SELECT * FROM walk)"""
GREEDY = WALK.format(cap=1_000_000, next="SELECT report_id, p, CAST(greatest(fits, 1) AS BIGINT) AS len FROM reach")
LADDER = """SELECT report_id, p, len FROM (
    SELECT report_id, p, fits, list_reduce(list_prepend(least(CASE WHEN total <= {cap} THEN n ELSE greatest(1, CAST(floor({cap} / (total / n) * 0.9) AS BIGINT)) END, n - p + 1),
      [CAST(fits AS BIGINT) FOR _ IN range(40)]), lambda l, f: CASE WHEN l > f AND l > 1 THEN l - greatest(1, l // 4) ELSE l END) AS len FROM reach)"""
ADAPTIVE = WALK.format(cap=1_000_000, next=LADDER.format(cap=1_000_000))

CHECKS = {
    "assembly_order": with_tables(ORDERS, f"{ordered('filings')} SELECT report_id, pos, doc_id, category FROM placed"),
    "assembly_order_strict": with_tables(ORDERS, f"{ordered('filings', strict=True)} SELECT report_id, pos, doc_id, category FROM placed"),
    "assembly_order_natural": with_tables(
        ORDERS, f"{ordered('filings', name_key=', '.join(NATURAL))} SELECT report_id, pos, doc_id, {_LOW} AS sort_name FROM placed"
    ),
    "natural_names": with_tables(
        ORDERS,
        f"""numbered AS (SELECT * REPLACE (regexp_replace(original_filename, '[0-9]{{4}}', '00', 'g') || ' (' || (doc_id * 7 % 23) || ')' AS original_filename)
        FROM filings), {ordered('numbered', name_key=', '.join(NATURAL))} SELECT report_id, pos, doc_id, {_LOW} AS sort_name FROM placed""",
    ),
    "omitted": with_tables(
        ORDERS,
        """SELECT report_id, doc_id, CASE WHEN category = 'UNCLASSIFIED' THEN 'unclassified' ELSE 'reliance letter not wanted' END AS omitted_because
        FROM filings f WHERE is_included AND status IN ('ready', 'classified') AND (category = 'UNCLASSIFIED' OR
          (category = 'RELIANCE_LETTER' AND report_id IN (SELECT report_id FROM reports WHERE NOT has_reliance_letter)))""",
    ),
    "manifest": with_tables(
        ORDERS,
        f"""{named('filings')}, {PRE},
        byname AS (SELECT f.* REPLACE (coalesce(pre_category, rule_category, 'UNCLASSIFIED') AS category,
            CASE WHEN pre_category IS NULL THEN rule_subcategory END AS subcategory,
            CASE WHEN pre_category IS NULL THEN coalesce(rule_sort_order, 0) ELSE 0 END AS sort_order)
          FROM filings f JOIN named USING (doc_id) JOIN pre USING (doc_id)),
        {ordered('byname')}, {manifest()} SELECT * FROM man""",
    ),
    "manifest_json": with_tables(ORDERS, f"{STORED} SELECT * FROM man"),
    "assembled_pages": with_tables(ORDERS + " doc_pages", f"{STREAM} SELECT * FROM stream"),
    "page_lookup": with_tables(
        ORDERS,
        f"""{STORED}, q AS (SELECT report_id, doc_id AS ref_id, doc_id * 17 % 5003 + 1 AS page FROM filings)
        SELECT q.report_id, q.ref_id, q.page, m.doc_id, m.start_page FROM q JOIN man m ON m.report_id = q.report_id AND q.page BETWEEN m.start_page AND m.end_page""",
    ),
    "page_reconcile": with_tables(
        ORDERS + " doc_pages",
        f"""{REAL}, ex AS (SELECT report_id, CAST(sum(coalesce(page_count, 0)) AS BIGINT) AS expected_pages FROM filings
             WHERE is_included AND status IN ('ready', 'classified') GROUP BY report_id),
        g AS (SELECT report_id, expected_pages, coalesce((SELECT CAST(max(end_page) AS BIGINT) FROM man WHERE man.report_id = ex.report_id), 0) AS assembled_pages FROM ex)
        SELECT *, expected_pages > 0 AND assembled_pages > expected_pages * 1.1 AS surplus, greatest(expected_pages - assembled_pages, 0) AS lost_pages FROM g""",
    ),
    "section_pages": with_tables(
        ORDERS, f"{STORED} SELECT report_id, category, CAST(sum(page_count) AS BIGINT) AS pages, count(*) AS docs FROM man GROUP BY ALL"
    ),
    "manifest_neighbours": with_tables(
        ORDERS,
        f"""{STORED} SELECT report_id, pos, doc_id, lag(start_page) OVER (PARTITION BY report_id ORDER BY pos) AS prev_start,
          lead(start_page) OVER (PARTITION BY report_id ORDER BY pos) AS next_start FROM man""",
    ),
    "section_head": with_tables("filings", _head("(CASE WHEN n <= 10 THEN 10 ELSE 5 END)")),
    "section_listing": with_tables("filings", _head("(CASE WHEN category = 'REPORTS_AFTER_E' THEN 15 ELSE 10 END)")),
    "display_order": with_tables(
        "filings",
        """SELECT report_id, category, doc_id, row_number() OVER (PARTITION BY report_id, category ORDER BY sort_order, doc_id) - 1 AS place
        FROM filings WHERE is_included""",
    ),
    "move_in_section": with_tables(
        "filings",
        """d AS (SELECT report_id, category, doc_id, row_number() OVER (PARTITION BY report_id, category ORDER BY sort_order, doc_id) - 1 AS place,
               count(*) OVER (PARTITION BY report_id, category) AS n FROM filings WHERE is_included),
        e0 AS (SELECT report_id, category, max(doc_id) AS moved, min(doc_id) AS first FROM d GROUP BY ALL),
        e AS (SELECT report_id, category, moved, CASE WHEN moved % 6 = 5 THEN min(first) OVER (PARTITION BY report_id) ELSE first END AS over_id FROM e0),
        m AS (SELECT e.*, b.category AS onto, a.place AS src, CASE moved % 3 WHEN 0 THEN a.place - 1 WHEN 1 THEN a.place + 1 ELSE b.place END AS dst, a.n
              FROM e JOIN d a ON a.doc_id = e.moved JOIN d b ON b.doc_id = e.over_id),
        k AS (SELECT d.*, CASE WHEN d.doc_id = m.moved THEN m.dst * 2 + CASE WHEN m.dst > m.src THEN 1 ELSE -1 END ELSE d.place * 2 END AS spot
              FROM d JOIN m USING (report_id, category) WHERE m.dst >= 0 AND m.dst < m.n AND (moved % 3 <> 2 OR onto = category))
        SELECT report_id, category, doc_id, CAST(row_number() OVER (PARTITION BY report_id, category ORDER BY spot) - 1 AS INTEGER) AS sort_order FROM k
        UNION ALL SELECT m.report_id, onto, moved, f.sort_order FROM m JOIN filings f ON f.doc_id = moved WHERE moved % 3 = 2 AND onto <> m.category""",
    ),
    "move_log": with_tables(
        "filings",
        """d AS (SELECT report_id, category, list(doc_id ORDER BY sort_order, doc_id) AS ids, list(doc_id ORDER BY doc_id) AS s
          FROM filings WHERE is_included GROUP BY report_id, category),
        m AS (SELECT *, list_transform(list_filter(s, lambda x: x % 2 = 1), lambda x: {'doc': x, 'kind': 'up'})
            || list_transform(list_filter(s, lambda x: x % 3 = 0), lambda x: {'doc': x, 'kind': 'down'})
            || CASE WHEN len(s) > 1 THEN [{'doc': s[1], 'kind': 'to'}] ELSE [] END AS log FROM d),
        w AS (SELECT report_id, category, ids, s, log, 0 AS i FROM m
          UNION ALL
          SELECT report_id, category, CASE WHEN q < 1 OR q > len(ids) OR q = p THEN ids ELSE r[:q - 1] || [doc] || r[q:] END, s, log, i + 1
          FROM (SELECT *, list_filter(ids, lambda x: x <> doc) AS r,
                  CASE kind WHEN 'up' THEN p - 1 WHEN 'down' THEN p + 1 ELSE list_position(ids, s[len(s)]) END AS q
                FROM (SELECT *, log[i + 1].doc AS doc, log[i + 1].kind AS kind, list_position(ids, log[i + 1].doc) AS p FROM w WHERE i < len(log))))
        SELECT report_id, category, unnest(ids) AS doc_id, CAST(generate_subscripts(ids, 1) - 1 AS INTEGER) AS sort_order
        FROM w WHERE i = len(log) AND i > 0""",
        recursive=True,
    ),
    "reorder_section": with_tables(
        "actions",
        """q AS (SELECT report_id, seq, target_section, unnest([doc_a, doc_b, doc_c]) AS doc_id, unnest([0, 1, 2]) AS place FROM actions WHERE target_section <> 'NOWHERE'),
        r AS (SELECT report_id, doc_id, arg_max(target_section, seq) AS t, arg_max(place, seq) AS p FROM q GROUP BY ALL)
        SELECT f.doc_id, coalesce(r.t, f.category) AS category, coalesce(r.p, f.sort_order) AS sort_order FROM filings f LEFT JOIN r USING (report_id, doc_id)""",
    ),
    "latest_action": with_tables(
        "actions", "SELECT report_id, seq, action FROM actions a WHERE seq = (SELECT max(seq) FROM actions b WHERE b.report_id = a.report_id)"
    ),
    "curate_after_e": with_tables(
        "filings",
        f"""a AS (SELECT *, {CLASS} AS report_class FROM filings WHERE is_included AND category = 'REPORTS_AFTER_E' AND report_id IN (
              SELECT report_id FROM filings WHERE is_included AND category = 'REPORTS_AFTER_E' GROUP BY report_id HAVING sum(coalesce(page_count, 0)) > 50)),
        m AS (SELECT *, row_number() OVER (PARTITION BY report_id, report_class ORDER BY modified_at DESC NULLS LAST, doc_id) AS age FROM a),
        k AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY CASE report_class WHEN 'monitoring' THEN 0 WHEN 'closure' THEN 1
                WHEN 'tank_removal' THEN 2 ELSE 3 END, doc_id) AS rn FROM m
              WHERE report_class IN ('closure', 'tank_removal', 'initial') OR (report_class = 'monitoring' AND age = 1))
        SELECT report_id, doc_id, report_class, 'Over 50 pages of supporting reports: not among the key reports' AS reason FROM a
        WHERE doc_id NOT IN (SELECT doc_id FROM k WHERE rn <= 10)""",
    ),
    "progress_running": with_tables(
        "progress_events",
        """SELECT report_id, event_id, row_number() OVER (PARTITION BY report_id ORDER BY ts, event_id) AS current, count(*) OVER (PARTITION BY report_id) AS total
        FROM progress_events WHERE phase = 'classified'""",
    ),
    "progress_log": with_tables(
        "progress_events",
        """s AS (SELECT *, lag(phase) OVER (PARTITION BY report_id ORDER BY ts, event_id) AS prev, row_number() OVER (PARTITION BY report_id ORDER BY ts, event_id) AS rn FROM progress_events),
        r AS (SELECT report_id, max(rn) AS reset FROM s WHERE phase = 'classifying' AND (prev IS NULL OR prev NOT IN ('classifying', 'classified')) GROUP BY report_id),
        l AS (SELECT *, lead(phase) OVER (PARTITION BY report_id ORDER BY rn) AS nxt FROM s WHERE phase IN ('classifying', 'classified', 'processed'))
        SELECT l.report_id, l.event_id, l.phase, l.filename FROM l LEFT JOIN r USING (report_id)
        WHERE NOT (phase = 'classifying' AND nxt IS NOT DISTINCT FROM 'classifying') AND l.rn >= coalesce(r.reset, 0)""",
    ),
    "split_estimate": with_tables("filings", f"{ESTIMATE} {PART}"),
    "split_greedy": with_tables(ORDERS + " doc_pages", f"{STREAM}, {GREEDY} {PART}", recursive=True),
    "split_adaptive": with_tables(ORDERS + " doc_pages", f"{STREAM}, {ADAPTIVE} {PART}", recursive=True),
    "delivery_plan": with_tables(
        "reports",
        f"""{ESTIMATE}, pn AS (SELECT report_id, count(*) AS k FROM parts GROUP BY report_id),
        d AS (SELECT r.*, assembled_size <= 20971520 OR coalesce(k, 1) <= 1 AS single, k FROM reports r LEFT JOIN pn USING (report_id) WHERE assembled_filename IS NOT NULL)
        SELECT report_id, CASE WHEN single THEN 'single' ELSE 'bundle' END AS delivery, CASE WHEN single THEN 1 ELSE k END AS files,
          CASE WHEN single THEN assembled_filename ELSE replace(assembled_filename, '.pdf', '_split.zip') END AS file_name FROM d""",
    ),
}
