"""Pages, excerpts, structured text."""

from oracles.scalars import ext, strip
from oracles.tables import with_tables

SMART = """nn AS (SELECT doc_id, count(*) AS n FROM doc_pages GROUP BY doc_id),
small AS (SELECT doc_id, n, left(string_agg(coalesce(txt, ''), chr(10) ORDER BY page_no), 10000) AS excerpt
          FROM doc_pages JOIN nn USING (doc_id) WHERE n < 50 GROUP BY doc_id, n),
head AS (SELECT doc_id, left(string_agg(txt, chr(10) ORDER BY page_no), 3000) AS h FROM doc_pages WHERE page_no < 5 GROUP BY doc_id),
tail AS (SELECT doc_id, left(string_agg(txt, chr(10) ORDER BY page_no), 2000) AS t
         FROM doc_pages JOIN nn USING (doc_id) WHERE page_no >= n - 3 GROUP BY doc_id),
picks AS (SELECT doc_id, page_no FROM (
            SELECT doc_id, unnest(range(50, least(n - 50, 500), greatest(1, n // 100))[1:5]) AS page_no FROM nn WHERE n >= 50)),
samples AS (SELECT doc_id, string_agg(chr(10) || '[SAMPLE PAGE]' || chr(10) || left(txt, 500), '' ORDER BY page_no) AS s
            FROM picks JOIN doc_pages USING (doc_id, page_no) GROUP BY doc_id),
smart AS (SELECT doc_id, n AS n_pages, excerpt FROM small
          UNION ALL SELECT doc_id, n, left(h || chr(10) || '[SAMPLE PAGE]' || chr(10) || t || coalesce(s, ''), 8000)
          FROM nn JOIN head USING (doc_id) JOIN tail USING (doc_id) LEFT JOIN samples USING (doc_id) WHERE n >= 50)"""

HEADER = """lines AS (SELECT doc_id, txt, string_split(txt, chr(10)) AS l FROM doc_pages WHERE page_no = 0),
hf AS (SELECT doc_id, CASE WHEN len(l) < 4 THEN txt ELSE array_to_string(l[1:3], chr(10)) || chr(10) || '---' || chr(10)
         || array_to_string(l[len(l) - 2:len(l)], chr(10)) END AS full_hf FROM lines)"""

KEPT = f"""kept AS (SELECT f.doc_id, coalesce(CASE WHEN {ext('f.original_filename')} IN ('.docx', '.doc') THEN c.filled ELSE c.n END, 0) AS kept
  FROM filings f LEFT JOIN (SELECT doc_id, count(*) AS n,
      coalesce(max(CASE WHEN length({strip('txt')}) >= 10 THEN page_no + 1 END), 0) AS filled FROM doc_pages GROUP BY doc_id) c USING (doc_id))"""

CHECKS = {
    "paginate": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
        SELECT doc_id, CAST(i // 47 AS INTEGER) AS page_no,
          string_agg(CASE WHEN length(line) > 100 THEN left(line, 100) || '...' ELSE line END, chr(10) ORDER BY i) AS txt
        FROM l GROUP BY doc_id, i // 47""",
    "page_count": with_tables(
        "filings doc_pages",
        "SELECT f.doc_id, (SELECT count(*) FROM doc_pages p WHERE p.doc_id = f.doc_id) AS pages FROM filings f",
    ),
    "paragraphs": f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
            generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        q AS (SELECT doc_id, i, {strip('raw')} AS para FROM p)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS para_no, para FROM q WHERE para <> ''""",
    "excerpt_first": with_tables(
        "doc_pages",
        """SELECT doc_id, left(string_agg(txt, chr(10) ORDER BY page_no), 700) AS excerpt FROM (
          SELECT *, coalesce(sum(length(txt)) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM doc_pages WHERE page_no < 5) WHERE before <= 700 GROUP BY doc_id""",
    ),
    "excerpt_last": with_tables(
        "doc_pages",
        """SELECT doc_id, left(string_agg(txt, chr(10) ORDER BY page_no), 500) AS excerpt FROM (
          SELECT *, coalesce(sum(length(txt)) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no DESC) AS rn FROM doc_pages) WHERE rn <= 3)
        WHERE before <= 500 GROUP BY doc_id""",
    ),
    "header_footer": with_tables("doc_pages", f"{HEADER} SELECT doc_id, left(full_hf, 500) AS header_footer FROM hf"),
    "smart_excerpt": with_tables("doc_pages", f"{SMART} SELECT doc_id, n_pages, excerpt FROM smart"),
    "page_sample": with_tables(
        "doc_pages",
        f"""{SMART} SELECT doc_id, page_no, 'whole' AS part FROM doc_pages JOIN nn USING (doc_id) WHERE n < 50
        UNION ALL SELECT doc_id, page_no, 'head' FROM doc_pages JOIN nn USING (doc_id) WHERE n >= 50 AND page_no < 5
        UNION ALL SELECT doc_id, page_no, 'tail' FROM doc_pages JOIN nn USING (doc_id) WHERE n >= 50 AND page_no >= n - 3
        UNION ALL SELECT doc_id, page_no, 'sample' FROM picks""",
    ),
    "text_source": with_tables(
        "doc_pages",
        f"""SELECT doc_id, page_no, CASE WHEN u THEN 'ocr' ELSE 'digital' END AS text_source,
          length(CASE WHEN u THEN ocr_txt ELSE txt END) AS n_chars
        FROM (SELECT *, length({strip('txt')}) < 50 AND length({strip("coalesce(ocr_txt, '')")}) > length({strip('txt')}) AS u FROM doc_pages)""",
    ),
    "strip_blank_tail": with_tables(
        "filings doc_pages", f"{KEPT} SELECT doc_id, page_no FROM doc_pages JOIN kept USING (doc_id) WHERE page_no < kept"
    ),
    "prompt_rows": with_tables(
        "filings doc_pages",
        f"""{SMART} SELECT doc_id, 'Filename: ' || original_filename || chr(10)
          || CASE WHEN original_path IS NULL THEN '' ELSE 'Path: ' || original_path || chr(10) END
          || 'Pages: ' || n_pages || ', Size: ' || (file_size // 1024) || 'KB' || chr(10)
          || CASE WHEN {strip('excerpt')} = '' THEN chr(10) || '(No text extracted — scanned document or image)'
             ELSE chr(10) || 'Text:' || chr(10) || left({strip('excerpt')}, 500) END AS prompt
        FROM filings JOIN smart USING (doc_id)""",
    ),
    "delete_pages": with_tables(
        "doc_pages",
        """SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS INTEGER) AS new_page_no
        FROM doc_pages WHERE page_no <> 1""",
    ),
    "delete_many_pages": with_tables(
        "doc_pages",
        """SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS INTEGER) AS new_page_no
        FROM doc_pages WHERE NOT ((doc_id % 3 = 0 AND page_no % 3 <> 1) OR (doc_id % 3 = 1 AND page_no % 2 = 0))""",
    ),
    "html_blocks": r"""WITH c AS (SELECT page_id, regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g') AS h FROM pages),
        o AS (SELECT page_id, h, regexp_extract_all(h, '(?i)<(h[1-6]|p|tr)(?:\s[^>]*)?>', 1) AS tags,
                     string_split_regex(h, '(?i)<(?:h[1-6]|p|tr)(?:\s[^>]*)?>') AS bodies FROM c),
        b AS (SELECT page_id, unnest(tags) AS tag, unnest(bodies[2:]) AS body, generate_subscripts(tags, 1) - 1 AS i FROM o)
        SELECT page_id, CAST(i AS INTEGER) AS block_no, (CASE WHEN lower(tag) = 'tr' THEN 't' ELSE 'p' END) || i AS block_id,
          CASE WHEN lower(tag) = 'tr' THEN 'table' WHEN lower(tag) = 'p' THEN 'paragraph' ELSE 'heading' END AS kind, lower(tag) AS tag,
          trim(regexp_replace(regexp_replace(body, '(?is)</(?:h[1-6]|p|tr|table|div|article|section|nav|body)>.*', '', 'g'), '(?s)<[^>]*>', '', 'g'),
               ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM b""",
    "blocks_to_html": """WITH l AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
        h AS (SELECT doc_id, lang, source, i, CASE i % 3 WHEN 0 THEN '<h2 class="docx-para">' || line || '</h2>'
               WHEN 1 THEN '<p class="docx-para">' || line || '</p>' ELSE '<h1 class="docx-para">' || line || '</h1>' END AS x FROM l)
        SELECT doc_id, '<div class="docx-preview">' || chr(10) || string_agg(x, chr(10) ORDER BY i) || chr(10)
          || array_to_string(['<table class="docx-table">', '<tr>', '<td>' || lang || '</td>', '<td>' || source || '</td>', '</tr>',
                              '<tr>', '<td>' || doc_id || '</td>', '</tr>', '</table>', '</div>'], chr(10)) AS html
        FROM h GROUP BY doc_id, lang, source""",
    "text_replace": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
        r AS (SELECT doc_id, i, regexp_extract(line, '^([^\s]*)', 1) AS a, substr(line, length(regexp_extract(line, '^([^\s]*)', 1)) + 1) AS b FROM l)
        SELECT doc_id, CAST(sum(CAST(contains(a, 'en') AS INT) + CAST(contains(b, 'en') AS INT)) AS INTEGER) AS replacements,
          string_agg(replace(a, 'en', 'EN') || '*/' || replace(b, 'en', 'EN'), chr(10) ORDER BY i) AS runs_text
        FROM r GROUP BY doc_id""",
    "rewrite_runs": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
        r AS (SELECT doc_id, i, line, regexp_extract(line, '^([^\s]*)', 1) AS a, substr(line, length(regexp_extract(line, '^([^\s]*)', 1)) + 1) AS b FROM l)
        SELECT doc_id, string_agg(CASE WHEN i % 2 = 0 THEN '<' || a || '>*/<' || b || '>' ELSE 'new ' || line || '*/' END, chr(10) ORDER BY i) AS runs_text
        FROM r GROUP BY doc_id""",
}
