"""Figures per report and section."""

from docket import fixed_values as fv
from oracles.tables import with_tables

P = "CAST(sum(coalesce(page_count, 0)) AS BIGINT)"
OK = "is_included AND status IN ('ready', 'classified')"
ORDERED = ", ".join(f"'{s}'" for s, _ in fv.SECTIONS)
RANGES = "rg AS (SELECT * FROM (VALUES {}) t(category, min_pages, max_pages, min_docs, max_docs))".format(
    ", ".join(f"('{r[0]}', {r[1]}, {r[2]}, {r[3]}, {r[4]})" for r in fv.SECTION_RANGES)
)
EXPECTED = ", ".join(f"('{s}', '{label}', {i})" for i, (s, label) in enumerate(fv.EXPECTED_SECTIONS))
GROUP = """CASE WHEN lower(coalesce(reasoning, '')) LIKE '%compiled%' OR lower(coalesce(reasoning, '')) LIKE '%appendix marker%' THEN 'compiled'
  WHEN lower(coalesce(reasoning, '')) LIKE '%superseded%' OR lower(coalesce(reasoning, '')) LIKE '%newer version%' THEN 'superseded'
  WHEN lower(coalesce(reasoning, '')) LIKE '%manually%' THEN 'manual' ELSE 'other' END"""
BAND = """CASE WHEN confidence = 1 AND reasoning = 'Manually classified by user' THEN 'manual' WHEN confidence IS NULL THEN 'none'
  WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END"""

CHECKS = {
    "section_summary": with_tables(
        "filings sections",
        f"""SELECT report_id, section_pos, category, display, count(*) AS docs, {P} AS pages FROM filings JOIN sections ON section = category
        WHERE is_included GROUP BY ALL""",
    ),
    "section_rollup": with_tables(
        "filings", f"SELECT report_id, category, count(*) AS docs, {P} AS pages FROM filings WHERE is_included GROUP BY ROLLUP (report_id, category)"
    ),
    "report_info": with_tables(
        "reports filings",
        """SELECT report_id, count(doc_id) AS total_docs, count(*) FILTER (is_included) AS included_docs, count(*) FILTER (NOT is_included) AS excluded_docs,
          count(*) FILTER (category <> 'UNCLASSIFIED') AS classified_docs, count(*) FILTER (status = 'error') AS error_docs,
          CAST(coalesce(sum(page_count) FILTER (is_included), 0) AS BIGINT) AS total_pages FROM (SELECT report_id FROM reports) LEFT JOIN filings USING (report_id) GROUP BY report_id""",
    ),
    "processing_status": with_tables(
        "reports filings",
        """SELECT report_id, count(doc_id) AS total, count(*) FILTER (f.status = 'uploaded') AS pending, count(*) FILTER (f.status IN ('ready', 'classified')) AS ready,
          count(*) FILTER (f.status = 'error') AS errors, count(*) FILTER (f.status = 'uploaded') = 0 AS complete
        FROM reports LEFT JOIN filings f USING (report_id) GROUP BY report_id""",
    ),
    "preflight": with_tables(
        "reports filings",
        f"""ok AS (SELECT * FROM filings WHERE {OK}),
        rp AS (SELECT report_id FROM reports),
        em AS (SELECT r.report_id, string_agg(label, ', ' ORDER BY i) AS empties FROM rp r, (VALUES {EXPECTED}) e(sec, label, i)
               WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.report_id = r.report_id AND ok.category = e.sec) GROUP BY r.report_id),
        g AS (SELECT r.report_id, count(o.doc_id) AS total_docs, CAST(coalesce(sum(o.page_count), 0) AS BIGINT) AS total_pages,
                count(*) FILTER (o.category = 'UNCLASSIFIED') AS un, count(*) FILTER (o.category = 'COVER_WRITEUP') AS cov,
                count(DISTINCT o.category) FILTER (o.category IN ({ORDERED})) AS filled
              FROM rp r LEFT JOIN ok o USING (report_id) GROUP BY r.report_id)
        SELECT report_id, cov > 0 AND total_pages <= 2000 AND total_docs > 0 AS can_assemble,
          concat_ws(' | ', CASE WHEN cov = 0 THEN 'Missing Cover / Write-Up — report has no main body document' END,
            CASE WHEN total_pages > 2000 THEN 'Report has ' || total_pages || ' pages — likely contains duplicates. Check documents before assembling.' END) AS errors,
          concat_ws(' | ', CASE WHEN un > 0 THEN un || ' document' || CASE WHEN un = 1 THEN '' ELSE 's' END || ' still unclassified' END,
            CASE WHEN empties IS NOT NULL THEN 'Empty sections: ' || empties END,
            CASE WHEN total_pages > 500 AND total_pages <= 2000 THEN 'Report has ' || total_pages || ' pages — verify this is expected' END) AS warnings,
          total_pages, total_docs, CAST(filled AS INTEGER) AS sections_filled, CAST(10 - filled AS INTEGER) AS sections_empty
        FROM g LEFT JOIN em USING (report_id)""",
    ),
    "section_flags": with_tables(
        "reports filings",
        f"""{RANGES}, rp AS (SELECT report_id FROM reports),
        g AS (SELECT rp.report_id, rg.*, coalesce((SELECT sum(page_count) FROM filings f WHERE f.report_id = rp.report_id AND f.category = rg.category AND f.is_included), 0) AS pages FROM rp, rg)
        SELECT report_id, category, CASE WHEN pages = 0 AND min_docs > 0 THEN category || ' is empty — expected ' || min_pages || '-' || max_pages || ' pages'
            ELSE category || ' has ' || pages || ' pages (typical max: ' || max_pages || ')' END AS issue,
          CASE WHEN pages = 0 AND min_docs > 0 AND category = 'COVER_WRITEUP' THEN 'error' ELSE 'warning' END AS severity
        FROM g WHERE (pages = 0 AND min_docs > 0) OR pages > max_pages * 2""",
    ),
    "report_health": with_tables(
        "reports filings",
        """SELECT *, CASE WHEN cover_pages = 0 THEN 'critical' WHEN pages >= 1000 AND pages <= 4000 THEN 'good' ELSE 'needs_attention' END AS health FROM (
          SELECT report_id, CAST(coalesce(sum(page_count) FILTER (is_included), 0) AS BIGINT) AS pages,
            CAST(coalesce(sum(page_count) FILTER (is_included AND category = 'COVER_WRITEUP'), 0) AS BIGINT) AS cover_pages FROM (SELECT report_id FROM reports) LEFT JOIN filings USING (report_id) GROUP BY report_id)""",
    ),
    "action_footprint": with_tables(
        "actions", "SELECT report_id, 3 * count(*) AS affected, 3 * count(*) > 10 AS needs_confirmation FROM actions GROUP BY report_id"
    ),
    "suggestions": with_tables(
        "reports",
        """g AS (SELECT r.report_id, r.assembled_filename AS af, r.assembled_size AS sz, count(*) FILTER (is_included) AS n_in, count(*) FILTER (NOT is_included) AS n_out,
              coalesce(sum(page_count) FILTER (is_included AND category = 'REPORTS_AFTER_E'), 0) AS ap, count(*) FILTER (is_included AND category = 'UNCLASSIFIED') AS un
              FROM reports r LEFT JOIN filings f USING (report_id) GROUP BY ALL)
        SELECT report_id, array_to_string(list_filter(['How many pages?', CASE WHEN n_in > 0 AND af IS NULL THEN 'Assemble report' END,
            CASE WHEN af IS NOT NULL AND sz > 20971520 THEN 'Split for email' END, CASE WHEN af IS NOT NULL THEN 'Compress for email' END,
            CASE WHEN n_out > 0 THEN 'Show ' || n_out || ' excluded docs' END, CASE WHEN ap > 500 THEN 'Trim supporting reports' END,
            CASE WHEN un > 0 THEN 'Classify ' || un || ' unclassified docs' END], lambda x: x IS NOT NULL)[1:5], ' | ') AS suggestions FROM g""",
    ),
    "exclusion_groups": with_tables(
        "filings",
        f"SELECT report_id, {GROUP} AS reason_group, count(*) AS docs FROM filings WHERE NOT is_included AND status <> 'error' GROUP BY ALL",
    ),
    "confidence_bands": with_tables("filings", f"SELECT report_id, {BAND} AS band, count(*) AS docs FROM filings GROUP BY ALL"),
    "curation_effect": with_tables(
        "reports filings recommendations",
        """x AS (SELECT f.*, f.doc_id IN (SELECT doc_id FROM recommendations WHERE kind = 'exclude') AS o,
              f.doc_id IN (SELECT doc_id FROM recommendations WHERE kind = 'reclassify') AS m FROM filings f WHERE is_included)
        SELECT report_id, count(*) FILTER (o) AS exclude_count, count(*) FILTER (m) AS reclassify_count, count(*) FILTER (NOT o) AS remaining_docs,
          CAST(coalesce(sum(page_count) FILTER (NOT o), 0) AS BIGINT) AS remaining_pages FROM (SELECT report_id FROM reports) LEFT JOIN x USING (report_id) GROUP BY report_id""",
    ),
    "report_list": with_tables(
        "reports", "SELECT report_id, name, status, (SELECT count(*) FROM filings f WHERE f.report_id = r.report_id) AS document_count FROM reports r"
    ),
    "ready_to_assemble": with_tables(
        "reports",
        f"""SELECT report_id, assembled_filename IS NULL AND EXISTS (SELECT 1 FROM filings f WHERE f.report_id = r.report_id AND {OK.replace('status', 'f.status')}
          AND f.category <> 'UNCLASSIFIED') AS ready FROM reports r""",
    ),
    "section_status": with_tables(
        "reports sections",
        """g AS (SELECT r.report_id, s.section AS category, r.has_reliance_letter AS rel,
               (SELECT count(*) FROM filings f WHERE f.report_id = r.report_id AND f.category = s.section AND f.is_included) AS docs,
               (SELECT count(*) FROM filings f WHERE f.report_id = r.report_id AND f.category = s.section AND f.is_included AND f.status = 'error') AS errs FROM reports r, sections s)
        SELECT report_id, category, CASE WHEN errs > 0 THEN 'error' WHEN docs > 0 THEN 'filled' ELSE 'empty' END AS state, docs FROM g
        WHERE (category <> 'RELIANCE_LETTER' OR rel) AND (category <> 'UNCLASSIFIED' OR docs > 0)""",
    ),
    "record_recommendations": with_tables(
        "filings recommendations",
        """n AS (SELECT doc_id, string_agg(CASE WHEN kind = 'exclude' THEN ' [DIRECTOR: recommend exclude — ' || reason || ']'
                ELSE ' [DIRECTOR: suggest ' || suggested || ' — ' || reason || ']' END, '' ORDER BY kind) AS note FROM recommendations GROUP BY doc_id)
        SELECT f.doc_id, CASE WHEN is_included AND note IS NOT NULL THEN coalesce(reasoning, '') || note ELSE reasoning END AS reasoning
        FROM filings f LEFT JOIN n USING (doc_id)""",
    ),
    "apply_recommendations": with_tables(
        "filings recommendations",
        "SELECT doc_id, is_included AND doc_id NOT IN (SELECT doc_id FROM recommendations WHERE kind = 'exclude') AS is_included FROM filings",
    ),
    "compression_report": with_tables(
        "reports",
        """c AS (SELECT report_id, assembled_size AS o, least(compressed_size, assembled_size) AS s FROM reports WHERE assembled_size IS NOT NULL)
        SELECT report_id, s AS chosen_size, CASE WHEN o > 0 THEN round((1 - s / o) * 100, 1) ELSE 0.0 END AS reduction_pct,
          CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0) ELSE printf('%.1f MB', s / 1048576.0) END AS size_text,
          s <= 10485760 AS meets_email, s <= 26214400 AS meets_standard FROM c""",
    ),
    "progress_windows": with_tables(
        "progress_events",
        "SELECT report_id, phase, strftime(ts, '%Y-%m-%d') AS window_start, count(*) AS n FROM progress_events GROUP BY ALL",
    ),
}
