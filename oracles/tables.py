"""CTEs that derive the corpus tables in plain SQL."""

from docket import fixed_values as fv
from docket.sources import corpus as c


def _projection(name: str) -> str:
    source, columns = c.PROJECTIONS[name]
    return f"{name} AS (SELECT {', '.join(f'{e} AS {k}' for k, e in columns.items())} FROM {source})"


_PAGES = f"""doc_pages AS (
  SELECT doc_id, CAST(i AS INTEGER) AS page_no, CASE WHEN doc_id % 5 = 2 THEN '' ELSE chunk END AS txt,
         CASE WHEN doc_id % 5 = 2 THEN chunk END AS ocr_txt, length(chunk) * 512 AS n_bytes
  FROM (SELECT doc_id, i, substr(full_text, i * {c.PAGE_CHARS} + 1, {c.PAGE_CHARS}) AS chunk
        FROM (SELECT doc_id, full_text,
                     unnest(range(CAST(greatest(ceil(length(full_text) / {c.PAGE_CHARS}.0), 1) AS BIGINT))) AS i FROM doc_texts)))"""
_CORRECTIONS = """corrections AS (
  SELECT report_id, doc_id, seq1 AS seq, section1 AS suggested_section, reason1 AS reason FROM correction_pairs
  UNION ALL SELECT report_id, doc_id, seq2, section2, reason2 FROM correction_pairs)"""
_ACTIONS = "actions AS (SELECT {} FROM filings)".format(", ".join(f"{e} AS {k}" for k, e in c.ACTIONS_PROJECTION.items()))
_REPORTS = """reports AS (SELECT {} FROM (SELECT report_id, {} FROM filings GROUP BY report_id
  UNION ALL SELECT DISTINCT report_id + {}, 0, 0 FROM filings WHERE {}))""".format(
    ", ".join(f"{e} AS {k}" for k, e in c.REPORT_COLUMNS.items()), ", ".join(f"{e} AS {k}" for k, e in c.REPORT_AGGS.items()),
    c.EMPTY_REPORTS[1], c.EMPTY_REPORTS[0],
)
_RECOMMENDATIONS = """recommendations AS (
  SELECT report_id, doc_id, 'exclude' AS kind, CAST(NULL AS VARCHAR) AS suggested, 'routine monitoring' AS reason
  FROM filings WHERE category = 'REPORTS_AFTER_E'
  UNION ALL SELECT report_id, doc_id, 'reclassify', 'APPENDIX_E', 'low confidence' FROM filings WHERE confidence < 0.7)"""
_ACTION_DOCS = """action_docs AS (
  SELECT a.report_id, a.seq, a.action, a.target_section, a.reason, d.doc_id
  FROM (SELECT *, unnest([doc_a, doc_b, doc_c]) AS d_id FROM actions) a
  JOIN filings d ON d.doc_id = a.d_id AND d.report_id = a.report_id)"""
_SECTIONS = "sections AS (SELECT * FROM (VALUES {}) t(section, section_pos, display))".format(
    ", ".join(f"('{n}', {i + 1}, '{d}')" for i, (n, d) in enumerate([*fv.SECTIONS, fv.UNCLASSIFIED]))
)

TABLES = {
    **{name: (_projection(name), [c.PROJECTIONS[name][0]]) for name in c.PROJECTIONS},
    "doc_pages": (_PAGES, ["doc_texts"]),
    "corrections": (_CORRECTIONS, ["correction_pairs"]),
    "actions": (_ACTIONS, ["filings"]),
    "action_docs": (_ACTION_DOCS, ["actions"]),
    "reports": (_REPORTS, ["filings"]),
    "recommendations": (_RECOMMENDATIONS, ["filings"]),
    "sections": (_SECTIONS, []),
}


def with_tables(names: str, body: str, recursive: bool = False) -> str:
    """``body`` behind the CTEs it needs. ``body`` is either a SELECT or further CTEs ending in one."""
    done: list[str] = []

    def need(name: str) -> None:
        if name in done or name not in TABLES:
            return
        for other in TABLES[name][1]:
            need(other)
        done.append(name)

    for name in names.split():
        need(name)
    ctes = ",\n".join(TABLES[n][0] for n in done)
    body = body.strip()
    glue = " " if body.upper().startswith("SELECT") else ",\n"
    sql = f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{glue}{body}"
    return sql.replace("element_at(array(", "list_extract(list_value(")
