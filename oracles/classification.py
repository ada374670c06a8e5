"""Name rules, verdicts, policies and what page text says."""

from docket import fixed_values as fv
from docket.sources.corpus import TEMPLATES  # noqa: F401
from oracles.scalars import SUPPORTED, ext, listed, norm_base, revised, revision_base, stem, strip
from oracles.tables import with_tables
from oracles.texts import HEADER, SMART
from oracles.totals import RANGES

LETTERS = "abcdef"


def _values(rows) -> str:
    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def named(source: str, name: str = "named", key: str = "doc_id", size: bool = False) -> str:
    """CTEs that find the winning rule of each file by joining rules and taking the strongest; ``source`` has the key,
    original_filename, original_path and file_size."""
    rules = []
    rules += [(i, "image", p, c, s, 0.92, None, f"Image file + filename match: {r}") for i, (p, c, s, r) in enumerate(fv.IMAGE_RULES)]
    rules += [(90, "image", ".*", "APPENDIX_E", None, 0.9, None, "Image file — supporting evidence")]
    rules += [(100 + i, "cover", f"^appendix\\s*{x}\\b", f"APPENDIX_{x.upper()}", None, 0.95, -1, "Appendix cover/divider page") for i, x in enumerate(LETTERS)]
    rules += [(150, "quals", "^appendix", "APPENDIX_F", None, 0.95, None, "Filename indicates Appendix F - Qualifications")]
    rules += [(160 + i, "plain", f"^appendix {x}", f"APPENDIX_{x.upper()}", None, 0.9, None, f"Filename starts with 'appendix {x}'") for i, x in enumerate(LETTERS)]
    rules += [(200 + i, "plain", p, c, s, 0.9, None, f"Filename pattern match: {r}") for i, (p, c, s, r) in enumerate(fv.NAME_RULES)]
    rules += [(300 + i, "folder", p, "REPORTS_AFTER_E", None, 0.85, None, f"Folder pattern match: {r}") for i, (p, r) in enumerate(fv.FOLDER_RULES)]
    rules += [(400, "body", "esai", "COVER_WRITEUP", None, 0.8, None, "ESAI report document (main body)")]
    rules += [(500 + i, "camera", p, "APPENDIX_B", None, 0.9, None, "Generic camera photo filename") for i, p in enumerate(fv.CAMERA_NAMES)]
    words = " OR ".join(f"low LIKE '%{w}%'" for w in fv.DIVIDER_WORDS)
    no_quals = "low NOT LIKE '%qualifications%'"
    cover = f"(({no_quals} AND file_size = 0) OR (file_size > 0 AND file_size < {fv.DIVIDER_MAX_BYTES}) OR {words})" if size else f"({no_quals} OR {words})"
    return f"""{name}_rules AS (SELECT * FROM (VALUES {_values(rules)}) t(prio, scope, pattern, r_category, r_sub, r_conf, r_sort, r_reason)),
{name}_files AS (SELECT {key}, file_size, lower(original_filename) AS low, lower(coalesce(original_path, '')) AS folder,
    lower({stem()}) AS st, {ext()} AS ex, {ext()} IN ({listed(fv.IMAGE_EXTENSIONS)}) AS img FROM {source}),
{name} AS (SELECT f.{key}, arg_min(r, r.prio).r_category AS rule_category, arg_min(r, r.prio).r_sub AS rule_subcategory,
    CAST(arg_min(r, r.prio).r_conf AS DOUBLE) AS rule_confidence, CAST(arg_min(r, r.prio).r_sort AS INTEGER) AS rule_sort_order,
    arg_min(r, r.prio).r_reason AS rule_reason
  FROM {name}_files f LEFT JOIN {name}_rules r ON CASE r.scope
    WHEN 'image' THEN img AND regexp_matches(low, r.pattern)
    WHEN 'cover' THEN NOT img AND regexp_matches(low, r.pattern) AND {cover}
    WHEN 'quals' THEN NOT img AND regexp_matches(low, r.pattern) AND low LIKE '%qualifications%'
    WHEN 'plain' THEN NOT img AND regexp_matches(low, r.pattern)
    WHEN 'folder' THEN NOT img AND regexp_matches(folder, r.pattern)
    WHEN 'body' THEN NOT img AND low LIKE '%esai%' AND ex IN ('.docx', '.pdf') AND NOT regexp_matches(low, '{fv.BODY_EXCLUDES}')
    ELSE NOT img AND regexp_matches(st, r.pattern) END
  GROUP BY f.{key})"""


PRE = f"""pre AS (SELECT doc_id, CASE WHEN ex IN ('.heic', '.heif') THEN 'APPENDIX_E' WHEN ex IN ('.vsd', '.vsdx') THEN 'APPENDIX_A' END AS pre_category,
  CASE WHEN ex IN ('.heic', '.heif', '.vsd', '.vsdx') THEN CAST(0.99 AS DOUBLE) END AS pre_confidence,
  CASE WHEN ex IN ('.heic', '.heif') THEN 'iPhone site photograph — supporting evidence' WHEN ex IN ('.vsd', '.vsdx') THEN 'Visio file — site map or plot plan' END AS pre_reason
  FROM (SELECT doc_id, {ext()} AS ex FROM filings))"""

ALL = listed([s for s, _ in fv.SECTIONS] + [fv.UNCLASSIFIED[0]])
AI = f"""ai AS (SELECT doc_id, json_extract_string(t, '$.category') AS ai_category, json_extract_string(t, '$.subcategory') AS ai_subcategory,
    CASE WHEN json_type(t, '$.confidence') IS NULL THEN 0.8 ELSE TRY_CAST(json_extract_string(t, '$.confidence') AS DOUBLE) END AS ai_confidence,
    CASE WHEN json_type(t, '$.reasoning') IS NULL THEN 'AI classification' ELSE json_extract_string(t, '$.reasoning') END AS ai_reasoning
  FROM (SELECT doc_id, CASE WHEN json_valid(x) THEN x END AS t FROM (SELECT doc_id,
      {strip("rtrim(CASE WHEN response_text LIKE '```%' THEN regexp_replace(response_text, '```(?:json)?', '', 'g') ELSE response_text END, '`')")} AS x FROM verdicts))
  WHERE json_extract_string(t, '$.category') IN ({ALL}) AND json_type(t, '$.category') = 'VARCHAR'
    AND coalesce(json_type(t, '$.confidence'), 'DOUBLE') NOT IN ('NULL', 'ARRAY', 'OBJECT')
    AND (json_type(t, '$.confidence') IS NULL OR TRY_CAST(json_extract_string(t, '$.confidence') AS DOUBLE) IS NOT NULL)
    AND coalesce(json_type(t, '$.reasoning'), 'VARCHAR') = 'VARCHAR' AND coalesce(json_type(t, '$.subcategory'), 'NULL') IN ('NULL', 'VARCHAR'))"""

CONTENT = f"""content AS (SELECT f.doc_id,
    CASE WHEN pre_category IS NOT NULL THEN pre_category WHEN ai_category IS NOT NULL THEN ai_category ELSE coalesce(rule_category, 'UNCLASSIFIED') END AS category,
    CASE WHEN pre_category IS NOT NULL THEN NULL WHEN ai_category IS NOT NULL THEN ai_subcategory ELSE rule_subcategory END AS subcategory,
    CASE WHEN pre_category IS NOT NULL THEN pre_confidence WHEN ai_category IS NOT NULL THEN ai_confidence ELSE coalesce(rule_confidence, 0.0) END AS confidence,
    CASE WHEN pre_category IS NOT NULL THEN pre_reason
      WHEN ai_category IS NOT NULL THEN ai_reasoning || CASE WHEN rule_confidence >= 0.85 AND rule_category <> ai_category
        THEN ' [NOTE: filename suggests ' || rule_category || ' — ' || rule_reason || ']' ELSE '' END
      WHEN rule_category IS NOT NULL THEN '[FALLBACK] ' || rule_reason || ' (AI classification unavailable)'
      ELSE 'Classification failed: AI unavailable and no filename match' END AS reasoning,
    CASE WHEN pre_category IS NULL AND ai_category IS NULL THEN rule_sort_order END AS rule_sort_order
  FROM filings f JOIN pre USING (doc_id) JOIN named USING (doc_id) LEFT JOIN ai USING (doc_id))"""

IDENTITY = r"""ident AS (SELECT doc_id,
  coalesce(nullif(regexp_extract(h, '(?i)project\s*(?:id|#|number)?:?\s*([0-9a-z\-]{4,})', 1), ''),
           nullif(regexp_extract(h, '(?i)(?:bla|ec|smeh|fa)\s*[-_]?\s*([0-9a-z]{7,})', 1), ''),
           nullif(regexp_extract(h, '(?i)^([0-9]{7,10})\b', 1), '')) AS found_project_id,
  nullif(regexp_extract(h, '(?i)(\d+\s+[\p{L}\p{N}_]+\s+(?:street|st|avenue|ave|road|rd|drive|dr|boulevard|blvd))', 1), '') AS found_address,
  coalesce(nullif(regexp_extract(h, '(?i)©\s*([\p{L}\p{N}_]+(?:\s+[\p{L}\p{N}_]+)*)', 1), ''),
           nullif(regexp_extract(h, '(?i)(environmental|engineering|consulting)\s+([\p{L}\p{N}_]+(?:\s+[\p{L}\p{N}_]+)*)', 2), '')) AS found_company
  FROM (SELECT doc_id, left(full_hf, 1000) AS h FROM hf))"""


def _count(text: str, patterns) -> str:
    return " + ".join(f"CAST(regexp_matches({text}, '{p}') AS INTEGER)" for p in patterns)


def _evidence() -> str:
    ranges = {r[0]: r for r in fv.SECTION_RANGES}
    rows = []
    for place, (section, words) in enumerate(fv.SECTION_EVIDENCE):
        hits = " + ".join(f"CAST(contains(low, '{w}') AS INTEGER)" for w in words)
        r = ranges.get(section)
        bonus = f"CASE WHEN n_pages BETWEEN {r[1]} AND {r[2]} THEN 1 ELSE 0 END" if r else "0"
        rows.append(
            f"SELECT doc_id, '{section}' AS section, {place} AS place, {len(words) + (1 if r else 0)} AS possible, "
            f"CASE WHEN {hits} > 0 THEN {hits} + {bonus} ELSE 0 END AS score FROM ex"
        )
    return " UNION ALL ".join(rows)


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(lower(txt), '{w}')" for w in words) + ")"


COMPILED = f"""comp AS (SELECT doc_id, CAST({' + '.join(f"max(CAST({_any(m)} AS INTEGER))" for m in fv.COMPILED_MARKERS)} AS INTEGER) AS markers,
    bool_or({_any([fv.COMPILED_TOC])}) AS toc, bool_or({_any(fv.COMPILED_PHASE)}) AS phase
  FROM doc_pages WHERE page_no < 30 AND doc_id IN (SELECT doc_id FROM filings WHERE {ext()} = '.pdf')
  GROUP BY doc_id)"""

RULED = "SELECT doc_id, rule_category, rule_subcategory, rule_confidence, rule_sort_order, rule_reason FROM named"

CHECKS = {
    "classify_filename": with_tables("filings", f"{named('filings')} {RULED}"),
    "classify_filename_join": with_tables("filings", f"{named('filings', size=True)} {RULED}"),
    "classify_prefilter": with_tables("filings", f"{PRE} SELECT doc_id, pre_category, pre_confidence, pre_reason FROM pre"),
    "classify_targets": with_tables(
        "filings", "SELECT doc_id, category, confidence FROM filings WHERE category = 'UNCLASSIFIED' OR confidence < 0.85"
    ),
    "parse_verdicts": with_tables("verdicts", f"{AI} SELECT * FROM ai"),
    "reconcile": with_tables("filings verdicts", f"{named('filings')}, {PRE}, {AI}, {CONTENT} SELECT * FROM content"),
    "route_policy": with_tables(
        "filings verdicts",
        f"""{named('filings')}, {PRE}, {AI}, {CONTENT}
        SELECT 'none' AS policy, doc_id, coalesce(rule_category, 'UNCLASSIFIED') AS category, coalesce(rule_confidence, 0.0) AS confidence FROM named
        UNION ALL SELECT 'content-first', doc_id, category, confidence FROM content
        UNION ALL SELECT 'name-first', doc_id,
          CASE WHEN rule_confidence >= 0.85 THEN rule_category ELSE coalesce(ai_category, rule_category, 'UNCLASSIFIED') END,
          CASE WHEN rule_confidence >= 0.85 THEN rule_confidence ELSE coalesce(ai_confidence, rule_confidence, 0.0) END
        FROM named LEFT JOIN ai USING (doc_id)""",
    ),
    "score_sections": with_tables(
        "doc_pages",
        f"""{SMART}, ex AS (SELECT doc_id, n_pages, lower(excerpt) AS low FROM smart), s AS ({_evidence()}),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS rn FROM s)
        SELECT doc_id, CASE WHEN score > 0 THEN section ELSE 'UNCLASSIFIED' END AS category, score,
          CASE WHEN score > 0 THEN score / possible ELSE 0.0 END AS confidence FROM b WHERE rn = 1""",
    ),
    "ordering_hint": with_tables(
        "filings doc_pages",
        f"""t AS (SELECT doc_id, lower(left(string_agg(txt, chr(10) ORDER BY page_no), 2000)) AS low FROM doc_pages
             WHERE page_no < 5 AND doc_id IN (SELECT doc_id FROM filings WHERE category = 'APPENDIX_D') GROUP BY doc_id),
        s AS ({' UNION ALL '.join(f"SELECT doc_id, '{g}' AS g, {_count('low', p)} AS score FROM t" for g, p in fv.HINT_PATTERNS.items())}),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, g DESC) AS rn FROM s)
        SELECT doc_id, CASE WHEN score > 0 THEN g END AS hint, score FROM b WHERE rn = 1""",
    ),
    "property_profile": with_tables(
        "filings doc_pages",
        f"""SELECT doc_id, regexp_matches(low, '{'|'.join(fv.PROFILE_PATTERNS)}') AS is_profile FROM (
          SELECT doc_id, lower(left(string_agg(txt, chr(10) ORDER BY page_no), 2000)) AS low FROM doc_pages
          WHERE page_no < 3 AND doc_id IN (SELECT doc_id FROM filings WHERE category = 'APPENDIX_E') GROUP BY doc_id)""",
    ),
    "extract_identity": with_tables("doc_pages", f"{HEADER}, {IDENTITY} SELECT * FROM ident"),
    "contamination": with_tables(
        "reports doc_pages",
        f"""{HEADER}, {IDENTITY},
        n AS (SELECT report_id, doc_id, found_project_id FROM filings JOIN ident USING (doc_id) WHERE found_project_id IS NOT NULL),
        c AS (SELECT report_id, lower(found_project_id) AS pid, count(*) AS k FROM n GROUP BY ALL),
        u AS (SELECT report_id, pid FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY k DESC, pid) AS rn FROM c) WHERE rn = 1)
        SELECT n.report_id, n.doc_id, n.found_project_id, coalesce(nullif(lower(r.project_number), ''), u.pid) AS expected_id,
          lower(n.found_project_id) <> coalesce(nullif(lower(r.project_number), ''), u.pid) AS is_foreign
        FROM n JOIN u USING (report_id) LEFT JOIN reports r USING (report_id)""",
    ),
    "compiled_report": with_tables(
        "filings doc_pages", f"{COMPILED} SELECT doc_id, markers, toc, phase, markers >= 3 AND toc AND phase AS is_compiled FROM comp"
    ),
    "auto_name": with_tables(
        "reports doc_pages",
        f"""cov AS (SELECT report_id, min(doc_id) AS doc_id FROM filings WHERE category = 'COVER_WRITEUP' AND is_included GROUP BY report_id),
        tx AS (SELECT c.report_id, string_agg(txt, chr(10) ORDER BY page_no) AS full_hf, c.doc_id FROM cov c JOIN doc_pages p USING (doc_id)
               JOIN filings f USING (doc_id) WHERE page_no < 5 AND {ext('f.original_filename')} IN ('.pdf', '.docx', '.doc') GROUP BY c.report_id, c.doc_id),
        hf AS (SELECT doc_id, left(full_hf, 4000) AS full_hf FROM tx WHERE length({strip('full_hf')}) >= 20),
        {IDENTITY.replace('left(full_hf, 1000)', 'full_hf')},
        g AS (SELECT report_id, ident.* FROM cov JOIN ident USING (doc_id))
        SELECT r.report_id, CASE WHEN r.name LIKE 'New Report%' THEN coalesce('Phase I ESA - ' || g.found_address, r.name) ELSE r.name END AS name,
          coalesce(nullif(r.address, ''), g.found_address, r.address) AS address,
          coalesce(nullif(r.project_number, ''), g.found_project_id, r.project_number) AS project_number
        FROM reports r LEFT JOIN g USING (report_id)""",
    ),
    "ingest_upsert": with_tables(
        "filings",
        f"""bt AS (SELECT doc_id + 1000000000 AS doc_id, report_id, doc_id AS seq,
              CASE WHEN is_included THEN original_filename ELSE 'new ' || original_filename END AS original_filename, original_path, file_size * 2 AS file_size, modified_at FROM filings),
        lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id, original_filename ORDER BY seq DESC) AS rn FROM bt) WHERE rn = 1),
        {named('lt')},
        ol AS (SELECT report_id, original_filename, min(doc_id) AS old_id FROM filings GROUP BY ALL),
        ch AS (SELECT lt.*, ol.old_id, n.* EXCLUDE (doc_id) FROM lt JOIN named n ON n.doc_id = lt.doc_id
               LEFT JOIN ol ON ol.report_id = lt.report_id AND ol.original_filename = lt.original_filename)
        SELECT f.doc_id, f.report_id, f.original_filename, coalesce(nullif(c.original_path, ''), f.original_path) AS original_path,
          coalesce(c.file_size, f.file_size) AS file_size,
          CASE WHEN c.doc_id IS NULL THEN f.category ELSE coalesce(c.rule_category, 'UNCLASSIFIED') END AS category,
          CASE WHEN c.doc_id IS NULL THEN f.subcategory ELSE c.rule_subcategory END AS subcategory,
          CASE WHEN c.doc_id IS NULL THEN f.confidence ELSE c.rule_confidence END AS confidence,
          CASE WHEN c.doc_id IS NULL THEN f.reasoning ELSE c.rule_reason END AS reasoning, f.sort_order,
          CASE WHEN c.doc_id IS NULL THEN f.status ELSE 'uploaded' END AS status, f.is_included,
          f.page_count, f.modified_at, f.created_at, {ext('f.original_filename')} AS ext
        FROM filings f LEFT JOIN ch c ON c.old_id = f.doc_id
        UNION ALL SELECT doc_id, report_id, original_filename, nullif(original_path, ''), file_size, coalesce(rule_category, 'UNCLASSIFIED'),
          rule_subcategory, rule_confidence, rule_reason, 0, 'uploaded', true, NULL, modified_at, NULL, {ext()} FROM ch WHERE old_id IS NULL""",
    ),
}

PREFER = f"""pf AS (SELECT *, {revised('original_filename')} AS rev, {revised(stem())} AS stem_rev, lower({stem()}) AS st, {revision_base()} AS base
  FROM fresh),
pc AS (SELECT * REPLACE (
    CASE WHEN rev AND live THEN least(1.0, (CASE WHEN coalesce(confidence, 0) = 0 THEN CAST(0.8 AS DOUBLE) ELSE confidence END) + CAST(0.05 AS DOUBLE)) ELSE confidence END AS confidence,
    CASE WHEN rev AND live THEN '[PREFERRED: revised version] ' || coalesce(reasoning, '') ELSE reasoning END AS reasoning,
    CASE WHEN live AND category = 'APPENDIX_D' AND lower(original_filename) LIKE '%marked%' THEN 0
         WHEN live AND category = 'APPENDIX_E' AND regexp_matches(lower(original_filename), '{fv.PROFILE_NAME}') THEN 1 ELSE sort_order END AS sort_order),
    live AND category = 'APPENDIX_E' AND regexp_matches(lower(original_filename), '{fv.PROFILE_NAME}') AS is_profile FROM pf),
sp AS (SELECT * REPLACE (is_included AND NOT hit AS is_included,
    CASE WHEN hit THEN coalesce(reasoning, '') || ' [Superseded by revised version]' ELSE reasoning END AS reasoning)
  FROM (SELECT o.*, o.is_included AND NOT o.stem_rev AND EXISTS (SELECT 1 FROM pc r WHERE r.report_id = o.report_id
          AND r.base = o.base AND r.base <> '' AND r.rev AND r.is_included AND r.status <> 'error' AND r.st <> o.st) AS hit FROM pc o))"""

CHECKS["preference_rules"] = with_tables(
    "filings",
    f"""fresh AS (SELECT *, true AS live FROM filings), {PREFER}
    SELECT doc_id, category, confidence, reasoning, sort_order, is_included, is_profile FROM sp""",
)

CORRECTED = """us AS (SELECT c.*, d.category AS c0 FROM corrections c JOIN target d ON d.report_id = c.report_id AND d.doc_id = c.doc_id
  WHERE d.is_included AND coalesce(d.confidence, 0) < 0.9 AND suggested_section <> 'COVER_WRITEUP' AND suggested_section IN ({all})),
sq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM us),
wk(doc_id, k, category, reason, n) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), c0, CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM sq
  UNION ALL SELECT s.doc_id, s.k, s.suggested_section, CASE WHEN s.suggested_section <> w.category THEN s.reason ELSE w.reason END,
    w.n + CASE WHEN s.suggested_section <> w.category THEN 1 ELSE 0 END
  FROM wk w JOIN sq s ON s.doc_id = w.doc_id AND s.k = w.k + 1),
fin AS (SELECT doc_id, arg_max(category, k) AS category, arg_max(reason, k) AS reason, max(n) AS n FROM wk GROUP BY doc_id),
corrected AS (SELECT d.doc_id, d.report_id, d.status, d.sort_order, d.is_included,
    CASE WHEN f.n > 0 THEN f.category ELSE d.category END AS category,
    CASE WHEN f.n > 0 THEN CAST(0.85 AS DOUBLE) ELSE d.confidence END AS confidence,
    CASE WHEN f.n > 0 THEN 'AI validator: ' || coalesce(f.reason, '') ELSE d.reasoning END AS reasoning, coalesce(f.n, 0) AS n_applied
  FROM target d LEFT JOIN fin f USING (doc_id))""".replace("{all}", ALL)

CHECKS["apply_corrections"] = with_tables(
    "filings corrections",
    f"target AS (SELECT * FROM filings), {CORRECTED} SELECT doc_id, category, confidence, reasoning, n_applied FROM corrected",
    recursive=True,
)
CHECKS["run_summary"] = with_tables(
    "reports filings corrections recommendations",
    f"""target AS (SELECT * FROM filings), {CORRECTED}
    SELECT report_id, count(doc_id) AS total, count(*) FILTER (status <> 'error') AS uploaded,
      count(*) FILTER (status <> 'error' AND is_included) AS classified, count(*) FILTER (status = 'error') AS errors,
      CAST(coalesce(sum(n_applied), 0) AS BIGINT) AS corrections_applied,
      (SELECT count(*) FROM recommendations x WHERE x.report_id = r.report_id AND x.kind = 'exclude') AS exclude_recommended
    FROM (SELECT report_id FROM reports) r LEFT JOIN corrected c USING (report_id) GROUP BY report_id""",
    recursive=True,
)
NOTED = f"""{HEADER}, {IDENTITY},
  front AS (SELECT doc_id, lower(left(string_agg(txt, chr(10) ORDER BY page_no), 2000)) AS low FROM doc_pages WHERE page_no < 5 GROUP BY doc_id),
  front3 AS (SELECT doc_id, lower(left(string_agg(txt, chr(10) ORDER BY page_no), 2000)) AS low FROM doc_pages WHERE page_no < 3 GROUP BY doc_id),
  hints AS ({' UNION ALL '.join(f"SELECT doc_id, '{g}' AS hint, {_count('low', p)} AS score FROM front" for g, p in fv.HINT_PATTERNS.items())}),
  hinted AS (SELECT doc_id, arg_max(hint, (score, hint)) FILTER (score > 0) AS hint FROM hints GROUP BY doc_id),
  noted AS (SELECT doc_id, category, CASE WHEN d THEN hint ELSE subcategory END AS subcategory, confidence,
      reasoning || CASE WHEN d THEN ' [Subcategory from content: ' || hint || ']' WHEN e THEN ' [Property Profile — ranked first in Appendix E]' ELSE '' END AS reasoning,
      CASE WHEN e THEN 1 ELSE rule_sort_order END AS rule_sort_order, e AS by_pages,
      CASE WHEN m THEN found_project_id END AS found_project_id,
      CASE WHEN m AND found_project_id IS NOT NULL THEN found_address END AS found_address,
      CASE WHEN m AND found_project_id IS NOT NULL THEN found_company END AS found_company
    FROM (SELECT *, m AND category = 'APPENDIX_D' AND coalesce(subcategory, '') = '' AND hint IS NOT NULL AS d, m AND category = 'APPENDIX_E' AND p AS e
      FROM (SELECT c.*, h.hint, i.* EXCLUDE (doc_id), pre_category IS NULL AND ai_category IS NOT NULL AS m,
              coalesce(regexp_matches(f3.low, '{'|'.join(fv.PROFILE_PATTERNS)}'), false) AS p
            FROM content c JOIN pre USING (doc_id) LEFT JOIN ai USING (doc_id) LEFT JOIN hinted h USING (doc_id)
            LEFT JOIN front3 f3 USING (doc_id) LEFT JOIN ident i USING (doc_id))))"""
CURATED = f"""{named('filings')}, {PRE}, {AI}, {CONTENT}, {COMPILED}, {NOTED},
    st0 AS (SELECT f.* REPLACE (CASE WHEN c.doc_id IS NULL THEN f.is_included ELSE false END AS is_included,
              CASE WHEN c.doc_id IS NULL THEN f.reasoning ELSE '{fv.COMPILED_REASON}' END AS reasoning)
            FROM filings f LEFT JOIN (SELECT doc_id FROM comp WHERE markers >= 3 AND toc AND phase) c USING (doc_id)),
    fresh AS (SELECT s.* REPLACE (CASE WHEN v THEN n.category ELSE s.category END AS category, CASE WHEN v THEN n.subcategory ELSE s.subcategory END AS subcategory,
                CASE WHEN v THEN n.confidence ELSE s.confidence END AS confidence, CASE WHEN v THEN n.reasoning ELSE s.reasoning END AS reasoning,
                CASE WHEN v THEN coalesce(n.rule_sort_order, s.sort_order) ELSE s.sort_order END AS sort_order,
                CASE WHEN v THEN 'classified' ELSE s.status END AS status), v AS live, v AND n.by_pages AS by_pages,
                CASE WHEN v THEN n.found_project_id END AS found_project_id, CASE WHEN v THEN n.found_address END AS found_address,
                CASE WHEN v THEN n.found_company END AS found_company
              FROM (SELECT *, is_included AND status <> 'error' AS v FROM st0) s JOIN noted n USING (doc_id)),
    {PREFER},
    kb AS (SELECT *, {norm_base()} AS nb FROM sp),
    rk AS (SELECT doc_id, row_number() OVER w AS rn, first_value(original_filename) OVER w AS winner FROM kb WHERE is_included
           WINDOW w AS (PARTITION BY report_id, nb ORDER BY modified_at DESC NULLS LAST, doc_id)),
    target AS (SELECT s.* REPLACE (CASE WHEN r.rn > 1 THEN false ELSE s.is_included END AS is_included,
                CASE WHEN r.rn > 1 THEN 'Superseded by newer version: ' || r.winner ELSE s.reasoning END AS reasoning)
               FROM sp s LEFT JOIN rk r USING (doc_id)),
    {CORRECTED}"""
CHECKS["curate_corpus"] = with_tables(
    "filings doc_pages verdicts corrections",
    f"""{CURATED}
    SELECT c.doc_id, c.category, c.confidence, c.reasoning, c.sort_order, c.is_included, c.status, t.subcategory,
      t.is_profile OR t.by_pages AS is_profile, t.found_project_id, t.found_address, t.found_company
    FROM corrected c JOIN target t USING (doc_id)""",
    recursive=True,
)
CHECKS["curate_flags"] = with_tables(
    "reports filings doc_pages verdicts corrections",
    f"""{CURATED},
    {RANGES},
    cur AS (SELECT c.report_id, c.category, coalesce(f.page_count, 0) AS n FROM corrected c JOIN filings f USING (doc_id) WHERE c.is_included),
    per AS (SELECT r.report_id, g.category, g.min_pages, g.max_pages, g.min_docs,
              coalesce((SELECT sum(n) FROM cur WHERE cur.report_id = r.report_id AND cur.category = g.category), 0) AS pages FROM reports r, rg g),
    bad AS (SELECT report_id, category, CASE WHEN pages = 0 AND min_docs > 0 THEN category || ' is empty — expected ' || min_pages || '-' || max_pages || ' pages'
              ELSE category || ' has ' || pages || ' pages (typical max: ' || max_pages || ')' END AS issue,
            CASE WHEN pages = 0 AND min_docs > 0 AND category = 'COVER_WRITEUP' THEN 'error' ELSE 'warning' END AS severity
            FROM per WHERE (pages = 0 AND min_docs > 0) OR pages > max_pages * 2),
    sums AS (SELECT report_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS pages,
               CAST(coalesce(sum(n) FILTER (category = 'COVER_WRITEUP'), 0) AS BIGINT) AS cover_pages
             FROM (SELECT report_id FROM reports) LEFT JOIN cur USING (report_id) GROUP BY report_id)
    SELECT s.*, CASE WHEN cover_pages = 0 THEN 'critical' WHEN pages BETWEEN 1000 AND 4000 THEN 'good' ELSE 'needs_attention' END AS health,
      category, issue, severity FROM sums s LEFT JOIN bad USING (report_id)""",
    recursive=True,
)
CHECKS["stream_ingest"] = with_tables(
    "filings",
    f"""{named('filings')}
    SELECT f.report_id, f.original_filename, f.original_path, f.file_size, coalesce(n.rule_category, 'UNCLASSIFIED') AS category, 'uploaded' AS status
    FROM (SELECT *, {ext()} AS e FROM filings) f JOIN named n USING (doc_id)
    WHERE e IN ({SUPPORTED}) AND original_filename NOT LIKE '.\\_%' ESCAPE '\\' AND coalesce(original_path, '') NOT LIKE '%\\_\\_MACOSX%' ESCAPE '\\'""",
)
CHECKS["stream_folder"] = with_tables(
    "filings",
    """SELECT report_id, '.txt' AS ext, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes
    FROM documents JOIN filings USING (doc_id) GROUP BY report_id""",
)
CHECKS["stream_dedupe"] = with_tables("filings", "SELECT DISTINCT report_id, original_filename FROM filings")
CHECKS["stream_state"] = with_tables(
    "progress_events",
    """SELECT report_id, event_id, phase, filename FROM (
      SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY event_id DESC) AS rn FROM progress_events) WHERE rn = 1""",
)
