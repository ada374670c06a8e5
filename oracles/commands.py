"""Commands, edits and undo, replayed step by step."""

from docket.schema import ALL_SECTIONS
from oracles.tables import with_tables

KNOWN = ", ".join(f"'{s}'" for s in ALL_SECTIONS)
MANUAL = "Manually classified by user"
FIELDS = "category, confidence, reasoning, sort_order, is_included"

# Replay events of each document in order; ``ev`` has doc_id, seq, cat, conf, why, note, inc.
REPLAY = """evk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM ev),
st(doc_id, k, category, confidence, reasoning, is_included) AS (
  SELECT doc_id, CAST(0 AS BIGINT), category, confidence, reasoning, is_included FROM filings
  UNION ALL SELECT s.doc_id, e.k, coalesce(e.cat, s.category), coalesce(e.conf, s.confidence),
    CASE WHEN e.note IS NOT NULL THEN coalesce(s.reasoning, '') || e.note ELSE coalesce(e.why, s.reasoning) END, coalesce(e.inc, s.is_included)
  FROM st s JOIN evk e ON e.doc_id = s.doc_id AND e.k = s.k + 1)"""
LAST = f"""SELECT s.doc_id, s.category, s.confidence, s.reasoning, f.sort_order, s.is_included FROM st s JOIN filings f USING (doc_id)
  WHERE s.k = (SELECT max(k) FROM st t WHERE t.doc_id = s.doc_id)"""
EVENTS = f"""ev AS (SELECT doc_id, seq, action,
    CASE WHEN action IN ('move', 'manual') AND target_section IN ({KNOWN}) THEN target_section END AS cat,
    CASE WHEN action IN ('move', 'manual') AND target_section IN ({KNOWN}) THEN CAST(1 AS DOUBLE) END AS conf,
    CASE WHEN target_section IN ({KNOWN}) THEN CASE action WHEN 'move' THEN 'Moved via chat command' WHEN 'manual' THEN '{MANUAL}' END END AS why,
    CASE WHEN action = 'exclude' THEN ' [' || coalesce(reason, 'Excluded via chat command') || ']' END AS note,
    CASE action WHEN 'exclude' THEN false WHEN 'include' THEN true END AS inc
  FROM action_docs WHERE action IN ({{kinds}}))"""
SNAP = "'move', 'exclude', 'include'"

# The stack of each report: a list of pushed commands, walked one log line at a time.
STACK = f"""lg AS (SELECT report_id, seq, action, row_number() OVER (PARTITION BY report_id ORDER BY seq) AS k FROM actions
  WHERE action IN ('exclude', 'include', 'undo') OR (action = 'move' AND target_section IN ({KNOWN}))),
sk(report_id, k, stack, undo_seq, push_seq) AS (
  SELECT DISTINCT report_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM lg
  UNION ALL SELECT s.report_id, l.k, CASE WHEN l.action <> 'undo' THEN list_append(s.stack, l.seq) WHEN len(s.stack) > 0 THEN s.stack[1:len(s.stack) - 1] ELSE s.stack END,
    CASE WHEN l.action = 'undo' AND len(s.stack) > 0 THEN l.seq END, CASE WHEN l.action = 'undo' AND len(s.stack) > 0 THEN s.stack[len(s.stack)] END
  FROM sk s JOIN lg l ON l.report_id = s.report_id AND l.k = s.k + 1),
pairs AS (SELECT report_id, push_seq, undo_seq FROM sk WHERE undo_seq IS NOT NULL)"""

# Per document, walk own events and the undos that touch it, keeping every earlier state so that an undo can go back.
HISTORY = f"""own AS (SELECT doc_id, seq, action, cat, conf, why, note, inc, CAST(NULL AS BIGINT) AS back FROM ev
  UNION ALL SELECT a.doc_id, p.undo_seq, 'undo', NULL, NULL, NULL, NULL, NULL, p.push_seq
  FROM pairs p JOIN action_docs a ON a.report_id = p.report_id AND a.seq = p.push_seq),
ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM own),
hs(doc_id, k, category, confidence, reasoning, is_included, past) AS (
  SELECT doc_id, CAST(0 AS BIGINT), category, confidence, reasoning, is_included,
    [{{'seq': CAST(-1 AS BIGINT), 'c': category, 'f': confidence, 'r': reasoning, 'i': is_included}}] FROM filings
  UNION ALL SELECT doc_id, k, c, f, r, i, list_append(past, {{'seq': seq, 'c': c, 'f': f, 'r': r, 'i': i}}) FROM (
    SELECT h.doc_id, o.k, o.seq, h.past,
      CASE WHEN o.back IS NOT NULL THEN was.c ELSE coalesce(o.cat, h.category) END AS c,
      CASE WHEN o.back IS NOT NULL THEN was.f ELSE coalesce(o.conf, h.confidence) END AS f,
      CASE WHEN o.back IS NOT NULL THEN was.r WHEN o.note IS NOT NULL THEN coalesce(h.reasoning, '') || o.note ELSE coalesce(o.why, h.reasoning) END AS r,
      CASE WHEN o.back IS NOT NULL THEN was.i ELSE coalesce(o.inc, h.is_included) END AS i
    FROM (SELECT h0.*, o0.k AS ok, list_filter(h0.past, lambda x: x.seq < o0.back)[-1] AS was
          FROM hs h0 JOIN ok o0 ON o0.doc_id = h0.doc_id AND o0.k = h0.k + 1) h
    JOIN ok o ON o.doc_id = h.doc_id AND o.k = h.ok))"""

# The messages' commands, told from how they were written rather than from their text; ids are those a list names.
LISTED = """listed AS (SELECT report_id, seq, 0 AS action_no, action, [doc_a, doc_b, doc_c] AS ids, target_section, reason FROM actions
  UNION ALL SELECT report_id, seq, 1, 'include', [doc_a], NULL, NULL FROM actions WHERE seq % 4 = 2
  UNION ALL SELECT report_id, seq, 1, 'exclude', [1, 2, 3, 4, 5, 6, 7, 8], NULL, NULL FROM actions WHERE seq % 4 = 3)"""
GATED = f"""{LISTED}, action_docs AS (SELECT l.report_id, l.seq * 2 + action_no AS seq, l.action, l.target_section, l.reason, d.doc_id
  FROM (SELECT * EXCLUDE (ids), unnest(list_distinct(ids)) AS d_id FROM listed WHERE seq % 4 <> 3) l
  JOIN filings d ON d.doc_id = l.d_id AND d.report_id = l.report_id)"""

CHECKS = {
    "actions_from_json": with_tables(
        "actions", f"{LISTED} SELECT report_id, seq, action_no, action, array_to_string(ids, ',') AS doc_ids, target_section, reason FROM listed"
    ),
    "message_footprint": with_tables(
        "actions", f"{LISTED} SELECT report_id, seq, sum(len(ids)) AS affected, sum(len(ids)) > 10 AS needs_confirmation FROM listed GROUP BY ALL"
    ),
    "gated_actions": with_tables("actions filings", f"{GATED}, {EVENTS.format(kinds=SNAP)}, {REPLAY} {LAST}", recursive=True),
    "apply_actions": with_tables("action_docs", f"{EVENTS.format(kinds=SNAP)}, {REPLAY} {LAST}", recursive=True),
    "action_results": with_tables(
        "action_docs",
        f"""n AS (SELECT report_id, seq, count(*) AS k FROM action_docs GROUP BY ALL)
        SELECT a.report_id, a.seq, a.action, CASE WHEN action = 'move' AND target_section NOT IN ({KNOWN}) THEN 'Invalid section: ' || target_section
            WHEN action IN ({SNAP}, 'search', 'info') THEN 'done' WHEN action IN ('assemble', 'undo') THEN 'deferred' ELSE 'Unknown action' END AS outcome,
          CASE WHEN action IN ('exclude', 'include') OR (action = 'move' AND target_section IN ({KNOWN})) THEN n.k END AS changed
        FROM actions a LEFT JOIN n USING (report_id, seq)""",
    ),
    "action_snapshots": with_tables(
        "action_docs",
        f"""{EVENTS.format(kinds=SNAP)}, {REPLAY}
        SELECT f.report_id, e.doc_id, e.seq, s.category, s.is_included, s.reasoning FROM evk e JOIN st s ON s.doc_id = e.doc_id AND s.k = e.k - 1
        JOIN filings f ON f.doc_id = e.doc_id WHERE e.action <> 'move' OR e.cat IS NOT NULL""",
        recursive=True,
    ),
    "undo_pairs": with_tables("actions", f"{STACK} SELECT report_id, push_seq, undo_seq FROM pairs", recursive=True),
    "undo_fold": with_tables(
        "action_docs",
        f"""{EVENTS.format(kinds=SNAP + ", 'manual'")}, {STACK}, {HISTORY}
        SELECT h.doc_id, h.category, h.confidence, h.reasoning, f.sort_order, h.is_included FROM hs h JOIN filings f USING (doc_id)
        WHERE h.k = (SELECT max(k) FROM hs t WHERE t.doc_id = h.doc_id)""",
        recursive=True,
    ),
    "batch_update": with_tables(
        "action_docs",
        f"""ev AS (SELECT doc_id, seq, CASE WHEN target_section <> 'NOWHERE' THEN target_section END AS cat,
             CASE WHEN target_section <> 'NOWHERE' THEN CAST(1 AS DOUBLE) END AS conf,
             CASE WHEN target_section <> 'NOWHERE' THEN 'Batch update by user' END AS why, CAST(NULL AS VARCHAR) AS note,
             CASE action WHEN 'exclude' THEN false WHEN 'include' THEN true END AS inc FROM action_docs), {REPLAY} {LAST}""",
        recursive=True,
    ),
    "manual_update": with_tables(
        "requests",
        f"""SELECT f.doc_id, coalesce(r.target, f.category) AS category, CASE WHEN r.target IS NOT NULL THEN 1.0 ELSE f.confidence END AS confidence,
          CASE WHEN r.target IS NOT NULL THEN '{MANUAL}' ELSE f.reasoning END AS reasoning, coalesce(r.new_sort, f.sort_order) AS sort_order,
          coalesce(r.new_included, f.is_included) AS is_included, CASE WHEN r.target = 'APPENDIX_D' THEN 'topos' ELSE f.subcategory END AS subcategory
        FROM filings f JOIN requests r USING (report_id, doc_id)""",
    ),
}
