"""Scalars, filters, sources and simple joins."""

from docket import fixed_values as fv
from oracles.tables import with_tables

# Extension and stem of a file name column.
EXT = r"CASE WHEN regexp_matches({n}, '^.+\.[^.]+$') THEN lower(regexp_extract({n}, '(\.[^.]+)$', 1)) ELSE '' END"
STEM = r"CASE WHEN regexp_matches({n}, '^.+\.[^.]+$') THEN regexp_replace({n}, '\.[^.]+$', '') ELSE {n} END"
TRIM = "trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def ext(n: str = "original_filename") -> str:
    return EXT.format(n=n)


def stem(n: str = "original_filename") -> str:
    return STEM.format(n=n)


def strip(x: str) -> str:
    return TRIM.format(x=x)


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def norm_base(n: str = "original_filename") -> str:
    out = f"lower({stem(n)})"
    for pattern in fv.VERSION_MARKS:
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    return f"CASE WHEN {out} = '' THEN lower({stem(n)}) ELSE {out} END"


def revised(x: str) -> str:
    return f"regexp_matches(lower({x}), '{fv.REVISED}')"


def revision_base(n: str = "original_filename") -> str:
    return strip(f"regexp_replace(lower({stem(n)}), '{fv.REVISION_MARKS}', '', 'g')")


CONVERTER = "CASE " + " ".join(
    f"WHEN ext = '{e}' THEN '{c}'" for e, c in fv.SUPPORTED_EXTENSIONS if c
) + " END"
SUPPORTED = listed([e for e, _ in fv.SUPPORTED_EXTENSIONS] + fv.ARCHIVE_EXTENSIONS)


def size_text(x: str) -> str:
    return (
        f"CASE WHEN {x} < 1024 THEN {x} || ' B' WHEN {x} < 1048576 THEN printf('%.1f KB', {x} / 1024.0) "
        f"ELSE printf('%.1f MB', {x} / 1048576.0) END"
    )


CHECKS = {
    "ingest_eligible": with_tables(
        "filings",
        f"""SELECT doc_id, original_filename, ext FROM (SELECT *, {ext()} AS ext FROM filings)
        WHERE ext IN ({SUPPORTED}) AND original_filename NOT LIKE '.\\_%' ESCAPE '\\'
          AND coalesce(original_path, '') NOT LIKE '%\\_\\_MACOSX%' ESCAPE '\\'""",
    ),
    "conversion_plan": with_tables(
        "filings",
        f"""SELECT doc_id, ext, {CONVERTER} AS converter,
          CASE WHEN ext = '.pdf' THEN 'ready' WHEN {CONVERTER} IS NOT NULL THEN 'convert' ELSE 'error' END AS next_step
        FROM (SELECT *, {ext()} AS ext FROM filings)""",
    ),
    "output_name": with_tables(
        "reports",
        r"""SELECT report_id, regexp_replace(
              (CASE WHEN project_number IS NULL OR project_number = '' THEN name ELSE project_number END) || '_assembled.pdf',
              '[^\w\s\-.]', '_', 'g') AS output_name FROM reports""",
    ),
    "retry_errors": with_tables(
        "filings",
        f"""SELECT report_id, CAST(sum(CASE WHEN fixed THEN 1 ELSE 0 END) AS BIGINT) AS fixed,
          CAST(sum(CASE WHEN status = 'error' AND NOT fixed THEN 1 ELSE 0 END) AS BIGINT) AS remaining_errors
        FROM (SELECT report_id, status, status = 'error' AND {CONVERTER} IS NOT NULL
                     AND doc_id IN (SELECT doc_id FROM labels) AS fixed
              FROM (SELECT *, {ext()} AS ext FROM filings)) GROUP BY report_id""",
    ),
    "path_parts": with_tables(
        "filings",
        f"SELECT doc_id, {ext()} AS ext, {stem()} AS stem, lower(original_filename) LIKE '%.docx' AS has_docx_source FROM filings",
    ),
    "norm_basename": with_tables("filings", f"SELECT doc_id, {norm_base()} AS base_name FROM filings"),
    "revision_flags": with_tables(
        "filings",
        f"""SELECT doc_id, {revised('original_filename')} AS is_revised, lower(original_filename) LIKE '%marked%' AS is_marked,
          {revision_base()} AS revision_base FROM filings""",
    ),
    "confidence_band": with_tables(
        "filings",
        """SELECT doc_id,
          CASE WHEN confidence = 1 AND reasoning = 'Manually classified by user' THEN 'manual' WHEN confidence IS NULL THEN 'none'
               WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band,
          CASE WHEN confidence = 1 AND reasoning = 'Manually classified by user' THEN 'Manual' WHEN confidence IS NULL THEN '?'
               ELSE CAST(round(confidence * 100) AS INTEGER) || '%' END AS label FROM filings""",
    ),
    "size_display": f"SELECT doc_id, {size_text('n_chars')} AS small, {size_text('n_chars * 4096')} AS large FROM documents",
    "reason_short": with_tables(
        "filings",
        """SELECT doc_id, CASE WHEN reasoning IS NULL OR reasoning = '' THEN 'Not classified'
          WHEN length(reasoning) > 55 THEN left(reasoning, 52) || '...' ELSE reasoning END AS reason FROM filings""",
    ),
    "run_duration": with_tables(
        "reports", "SELECT report_id, date_diff('second', pipeline_start, pipeline_end) AS duration_seconds FROM reports"
    ),
    "assembly_candidates": with_tables(
        "filings", "SELECT report_id, doc_id FROM filings WHERE is_included AND status IN ('ready', 'classified')"
    ),
    "search_filename": with_tables(
        "actions",
        """SELECT f.report_id, q.query, f.doc_id, f.original_filename, f.category, f.page_count, f.is_included
        FROM filings f JOIN (SELECT report_id, arg_max(query, seq) AS query FROM actions GROUP BY report_id) q
          ON q.report_id = f.report_id WHERE strpos(lower(f.original_filename), lower(q.query)) > 0""",
    ),
    "search_names": with_tables(
        "actions",
        """SELECT false AS everywhere, q.query, f.report_id, f.doc_id, f.original_filename
        FROM filings f JOIN actions q ON q.report_id = f.report_id WHERE contains(lower(f.original_filename), lower(q.query))
        UNION ALL
        SELECT true, q.query, f.report_id, f.doc_id, f.original_filename
        FROM filings f, (SELECT DISTINCT left(query, n) AS query FROM actions, (VALUES (1), (2), (3), (4)) AS lengths(n) WHERE query <> '') q
        WHERE contains(lower(f.original_filename), lower(q.query))""",
    ),
    "cascade_delete": with_tables(
        "reports", "SELECT report_id, doc_id FROM filings WHERE report_id NOT IN (SELECT report_id FROM reports WHERE status = 'done')"
    ),
    "chat_history": "SELECT conv_id, turn, role, text FROM conversations",
    "document_list": with_tables("filings", "SELECT report_id, category, sort_order, doc_id FROM filings"),
    "section_alias": with_tables(
        "filings",
        f"""w AS (SELECT doc_id, regexp_extract(original_filename, '^([A-Za-z]+)', 1) AS word FROM filings)
        SELECT doc_id, word, CASE lower(word) {' '.join(f"WHEN '{a}' THEN '{s}'" for a, s in fv.SECTION_ALIASES)} END AS alias_section
        FROM w""",
    ),
    "remove_duplicates": with_tables(
        "filings",
        """SELECT report_id, doc_id, original_filename FROM filings f WHERE NOT EXISTS (SELECT 1 FROM filings g
          WHERE g.report_id = f.report_id AND g.original_filename = f.original_filename AND g.doc_id < f.doc_id)""",
    ),
    "duplicate_counts": with_tables(
        "filings",
        """SELECT report_id, count(*) - count(DISTINCT original_filename) AS removed,
          count(DISTINCT original_filename) AS remaining FROM filings GROUP BY report_id""",
    ),
    "selection_ops": with_tables(
        "filings",
        """s AS (SELECT report_id, doc_id FROM filings WHERE is_included),
        n AS (SELECT report_id, doc_id FROM filings WHERE doc_id IN (SELECT doc_id FROM labels))
        SELECT report_id, doc_id, 'add' AS op FROM (SELECT * FROM s UNION SELECT * FROM n)
        UNION ALL SELECT report_id, doc_id, 'remove' FROM (SELECT * FROM s EXCEPT SELECT * FROM n)
        UNION ALL SELECT report_id, doc_id, 'toggle' FROM
          ((SELECT * FROM s EXCEPT SELECT * FROM n) UNION (SELECT * FROM n EXCEPT SELECT * FROM s))""",
    ),
    "supersede_revised": with_tables(
        "filings",
        f"""m AS (SELECT *, lower({stem()}) AS st, {revision_base()} AS base, {revised('original_filename')} AS rev,
                  {revised(stem())} AS stem_rev FROM filings)
        SELECT doc_id, hit AS superseded, is_included AND NOT hit AS is_included,
          CASE WHEN hit THEN coalesce(reasoning, '') || ' [Superseded by revised version]' ELSE reasoning END AS reasoning
        FROM (SELECT o.*, o.is_included AND NOT o.stem_rev AND EXISTS (SELECT 1 FROM m r WHERE r.report_id = o.report_id
                AND r.base = o.base AND r.base <> '' AND r.rev AND r.is_included AND r.status <> 'error' AND r.st <> o.st) AS hit
              FROM m o)""",
    ),
    "dedupe_versions": with_tables(
        "filings",
        f"""k AS (SELECT *, {norm_base()} AS base FROM filings),
        r AS (SELECT *, row_number() OVER w AS rn, first_value(original_filename) OVER w AS winner FROM k WHERE is_included
              WINDOW w AS (PARTITION BY report_id, base ORDER BY modified_at DESC NULLS LAST, doc_id))
        SELECT f.doc_id, CASE WHEN r.rn > 1 THEN false ELSE f.is_included END AS is_included,
          CASE WHEN r.rn > 1 THEN 'Superseded by newer version: ' || r.winner ELSE f.reasoning END AS reasoning
        FROM filings f LEFT JOIN r USING (doc_id)""",
    ),
    "select_range": with_tables(
        "filings",
        """l AS (SELECT report_id, doc_id, row_number() OVER (PARTITION BY report_id ORDER BY category, sort_order, doc_id) AS rn
              FROM filings WHERE is_included),
        a AS (SELECT report_id, max(doc_id) AS from_id, max(doc_id) - 6 AS to_id FROM filings WHERE is_included GROUP BY report_id),
        b AS (SELECT a.report_id, least(x.rn, y.rn) AS lo, greatest(x.rn, y.rn) AS hi FROM a
              JOIN l x ON x.report_id = a.report_id AND x.doc_id = a.from_id
              JOIN l y ON y.report_id = a.report_id AND y.doc_id = a.to_id)
        SELECT l.report_id, l.doc_id FROM l JOIN b ON b.report_id = l.report_id WHERE l.rn BETWEEN b.lo AND b.hi""",
    ),
}
