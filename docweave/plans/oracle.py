"""SQL for DuckDB that gives the results of the catalogue, written apart from the Spark code."""

from __future__ import annotations

#: The patterns of docweave.functions.patterns in RE2's syntax, which has no lookahead.
ORDERED = r"^\s*([0-9]+[.．、)][^0-9]|[（(]\s*[0-9]+\s*[)）].|[①-⑳].)"
ORDERED_REST = r"^\s*(?:[0-9]+[.．、)]|[（(]\s*[0-9]+\s*[)）]|[①-⑳])\s*(.+)$"
BULLET = r"^\s*[•·●▪◦]\s*(.+)$"
PLUGIN = r"^\s*(plugin_[a-zA-Z0-9_]+)\s*[:：]\s*(.+)$"
SECTION = r"^\s*([一二三四五六七八九十百]+、|摘要(\s|$)|参考文献(\s|（|\(|$))"
SUBSECTION = r"^\s*[0-9]+\.[0-9]+(\s|$)"
NUMERIC = r"^\s*[0-9]+\.\s+\S+"
DOT = r"^\s*\.\s+"
TERMINAL = "[。！？!?；;：:.]$"
COLON = "[：:]$"
GARBLED = r"[\x{2E80}-\x{2FFF}\x{0B00}-\x{0D7F}\x{1200}-\x{137F}\x{1D400}-\x{1D7FF}\x{FB00}-\x{FB06}\x{FFFD}]"
URL = r"(?i)https?://\S+"


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


def formula(t: str) -> str:
    start = has(t, r"^\s*([A-Za-zα-ωΑ-Ω]|[0-9])")
    return f"""({has(t, r"(?i)^\s*(max|min|s\.\s*t\.)(\s|$)")} OR {has(t, r"^\s*[∑∏∫√∞∂∇∀∃]+")}
      OR ({start} AND {has(t, "[=≤≥≈]")} AND {has(t, "[A-Za-zα-ωΑ-Ω][₀-₉]?")}))"""


def space(a: str, b: str) -> str:
    return f"""coalesce({a} <> '' AND {b} <> '' AND ({has(f"right({a}, 1)", "^[-+=*/≤≥≈]$")}
      OR ({has(f"right({a}, 1)", "^[A-Za-z0-9]$")} AND {has(f"left({b}, 1)", "^[A-Za-z0-9]$")})), false)"""


LINES = """
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
l1 AS (SELECT doc_id, i, l, (doc_id*17 + i*i*3 + i) % 5 AS m, (doc_id*31 + i*i*7 + i*3) % 17 AS k, 36 + ((doc_id*13 + i*i*5 + i) % 7) * 6 AS x0 FROM l0),
l2 AS (SELECT doc_id, i AS line_no, x0, 40 + i * 14 AS top,
  CASE k WHEN 0 THEN '1. ' WHEN 1 THEN '• ' WHEN 2 THEN '2.1 ' WHEN 3 THEN '一、' WHEN 4 THEN 'plugin_x: ' WHEN 5 THEN '（3）' WHEN 6 THEN 'max ' ELSE '' END ||
  CASE WHEN m < 2 THEN substr(l, 1, length(l) - 1) WHEN m = 2 THEN substr(l, 1, length(l) - 1) || ':' ELSE l END AS text FROM l1),
lines AS (SELECT *, x0 + length(text) * 5 AS x1, top + 10 AS bottom FROM l2)"""

ROLES = f"""{LINES},
roles AS (SELECT *, CASE WHEN {has("text", SECTION)} THEN 'heading1' WHEN {has("text", SUBSECTION)} THEN 'heading2'
  WHEN {has("text", ORDERED)} THEN 'ordered' WHEN {has("text", BULLET)} THEN 'bullet' WHEN {has("text", PLUGIN)} THEN 'plugin'
  WHEN {formula("text")} THEN 'formula' WHEN line_no = 1 THEN 'title' ELSE 'body' END AS role FROM lines)"""

LAYOUT = f"""{LINES},
placed AS (SELECT *, x0 - min(x0) OVER (PARTITION BY doc_id) AS indent FROM lines),
roles AS (SELECT *, CASE WHEN {has("text", SECTION)} THEN 'heading1' WHEN {has("text", SUBSECTION)} THEN 'heading2'
  WHEN {has("text", NUMERIC)} AND indent <= 12 THEN 'heading1' WHEN {has("text", ORDERED)} THEN 'ordered' WHEN {has("text", DOT)} AND indent >= 12 THEN 'ordered'
  WHEN {has("text", BULLET)} THEN 'bullet' WHEN {has("text", PLUGIN)} THEN 'plugin' WHEN indent >= 22 THEN 'bullet'
  WHEN {formula("text")} THEN 'formula' WHEN line_no = 1 THEN 'title' ELSE 'body' END AS role FROM placed)"""

BLOCKS = f"""{ROLES},
stripped AS (SELECT * REPLACE (regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text) FROM roles),
ends AS (SELECT *, {has("text", TERMINAL)} AS fin, {has("text", COLON)} AS colon, role IN ('ordered', 'bullet', 'plugin') AS item FROM stripped WHERE text <> ''),
states AS (SELECT *, CASE WHEN item AND NOT (fin AND NOT colon) THEN 1 WHEN item OR role <> 'body' OR (fin AND NOT colon) THEN 0 END AS st FROM ends),
starts AS (SELECT *, role <> 'body' OR (coalesce(last_value(st IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
    AND NOT coalesce(lag(role = 'body' AND NOT fin) OVER (PARTITION BY doc_id ORDER BY line_no), false)) AS opens FROM states),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_id FROM starts),
pieces AS (SELECT *, lag(text) OVER (PARTITION BY doc_id, block_id ORDER BY line_no) AS before FROM numbered),
grouped AS (SELECT doc_id, block_id, arg_min(role, line_no) AS role, string_agg(CASE WHEN before IS NOT NULL AND {space("before", "text")} THEN ' ' ELSE '' END || text, '' ORDER BY line_no) AS t FROM pieces GROUP BY 1, 2),
blocks AS (SELECT doc_id, block_id, role, CASE WHEN role = 'ordered' AND {has("t", ORDERED)} THEN regexp_extract(t, '{ORDERED_REST}', 1) WHEN role = 'bullet' AND {has("t", BULLET)} THEN regexp_extract(t, '{BULLET}', 1)
  WHEN role = 'plugin' AND {has("t", PLUGIN)} THEN regexp_extract(t, '{PLUGIN}', 1) || '：' || regexp_extract(t, '{PLUGIN}', 2) ELSE t END AS text FROM grouped)"""

PAGES = """
pt AS (SELECT doc_id, source, text || CASE WHEN doc_id % 9 = 0 THEN '�' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' https://e.com/' || repeat('a', length(text) // 2) ELSE '' END AS text FROM documents),
im AS (SELECT doc_id, 1 AS images, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS full_images, CASE WHEN doc_id % 4 = 0 THEN 1224 * 1584 ELSE 10000 END AS max_pixels FROM documents WHERE doc_id % 4 < 2)"""


def counted(source: str, minimum: str) -> str:
    """Page quality of (doc, text, images, full_images) in source."""
    return f"""
{source}_c AS (SELECT *, length(regexp_replace(text, '\\s+', '', 'g')) AS chars, len(regexp_extract_all(text, '{GARBLED}')) AS garbled,
  coalesce(list_sum(list_transform(regexp_extract_all(text, '{URL}'), lambda u: length(u))), 0)::BIGINT AS url_chars FROM {source}),
{source}_s AS (SELECT *, greatest(0, 100 - CASE WHEN chars < {minimum} THEN 55 ELSE 0 END - CASE WHEN full_images > 0 THEN 45 ELSE 0 END - CASE WHEN garbled > 0 THEN 35 ELSE 0 END
  - CASE WHEN garbled * 100 > 5 * greatest(chars, 1) THEN 25 ELSE 0 END - CASE WHEN url_chars * 100 > 25 * greatest(chars, 1) THEN 15 ELSE 0 END
  - CASE WHEN images > 0 AND chars < greatest(5 * {minimum}, 100) THEN 15 ELSE 0 END) AS score FROM {source}_c),
{source}_q AS (SELECT *, chars >= {minimum} AND score >= 75 AS high_quality FROM {source}_s)"""


JOINED = f"""{PAGES},
pg AS (SELECT pt.*, coalesce(images, 0) AS images, coalesce(full_images, 0) AS full_images FROM pt LEFT JOIN im USING (doc_id))"""

MERGED = """
{n}_a AS (SELECT *, max(hi) OVER (PARTITION BY {k} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
{n}_b AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM {n}_a),
{n} AS (SELECT {k}, island, min(lo) AS lo, max(hi) AS hi FROM {n}_b GROUP BY ALL)"""
SEGMENTS = "seg AS (SELECT l_orderkey AS page, l_quantity * 3 AS lo, l_quantity * 3 + l_linenumber * 4 AS hi, l_linenumber * 2 AS top FROM lineitem)"
EVENTS = """ev AS (SELECT *, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' END AS status FROM events)"""
OCR = f"""o0 AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS texts FROM conversations),
o1 AS (SELECT *, list_transform(range(0, len(texts)), lambda i: (conv_id * 7 + turn * 3 + i * 11) % 100) AS s, list_transform(texts, lambda t: trim(regexp_replace(t, '[ \\t]+', ' ', 'g'))) AS t FROM o0),
o2 AS (SELECT conv_id, turn, role, len(texts) AS lines, len(list_filter(t, lambda x: x <> '')) AS non_empty, coalesce(list_sum(list_transform(t, lambda x: length(regexp_replace(x, '\\s+', '', 'g')))), 0)::BIGINT AS chars,
  len(list_filter(s, lambda x: x < 75)) AS low, coalesce(list_sum(list_transform(t, lambda x: len(regexp_extract_all(x, '[\\x{{FFFD}}\\x{{E000}}-\\x{{F8FF}}]')))), 0)::BIGINT AS suspicious, list_min(s) / 100.0 AS min, list_sum(s) AS total FROM o1),
ocr AS (SELECT *, lines = 0 OR non_empty = 0 OR low * 4 > lines OR total < 75 * lines OR suspicious * 20 > greatest(chars, 1) AS needs_review FROM o2)"""


def _route(doc: str, source: str, minimum: int) -> str:
    return f"""SELECT {doc} AS doc, {minimum}::BIGINT AS min_page_chars,
      CASE WHEN hq > 0 AND hq / n >= 0.8 THEN 'text' WHEN u > 0 AND ch >= {minimum} AND u / n >= 0.6 THEN 'page_image' ELSE 'ocr' END AS route,
      CASE WHEN hq > 0 AND hq / n >= 0.8 THEN 'text_layer_complete' WHEN u > 0 AND ch >= {minimum} AND u / n >= 0.6 THEN 'text_layer_incomplete' ELSE 'text_layer_not_usable' END AS reason
      FROM (SELECT {doc}, count(*) AS n, count(*) FILTER (high_quality) AS hq, count(*) FILTER (chars >= {minimum}) AS u, sum(chars) AS ch FROM {source} GROUP BY 1)"""


def _q08() -> str:
    parts = [JOINED, "talk AS (SELECT 'c' || conv_id AS doc, text, 0 AS images, 0 AS full_images FROM conversations)"]
    selects = []
    for n in (20, 200, 1000):
        parts += [f"a{n} AS (SELECT * FROM pg)", counted(f"a{n}", str(n)), f"t{n} AS (SELECT * FROM talk)", counted(f"t{n}", str(n))]
        selects += [_route("source", f"a{n}_q", n), _route("doc", f"t{n}_q", n)]
    return "WITH " + ",".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM ({s})" for s in selects)


SQL = {
    "q01_normalize_lines": f"""WITH {LINES}, parts AS (SELECT doc_id, line_no, trim(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ') AS t FROM lines)
      SELECT doc_id, coalesce(string_agg(t, chr(10) ORDER BY line_no) FILTER (t <> ''), '') AS text, greatest(count(*) FILTER (t <> ''), 1) AS n_lines FROM parts GROUP BY doc_id""",
    "q02_page_char_counts": "SELECT conv_id, turn, length(regexp_replace(text, '\\s+', '', 'g')) AS chars FROM conversations",
    "q03_garbled_counts": f"WITH {PAGES} SELECT doc_id, len(regexp_extract_all(text, '{GARBLED}')) AS garbled FROM pt",
    "q04_url_stats": f"WITH {PAGES} SELECT doc_id, len(regexp_extract_all(text, '{URL}')) AS url_count, coalesce(list_sum(list_transform(regexp_extract_all(text, '{URL}'), lambda u: length(u))), 0)::BIGINT AS url_chars FROM pt",
    "q05_image_page_stats": f"WITH {PAGES} SELECT doc_id, count(*) AS images, sum(full_images)::BIGINT AS full_images, max(max_pixels)::BIGINT AS max_pixels FROM im GROUP BY 1",
    "q06_page_quality": f"WITH {JOINED}, {counted('pg', '20')} SELECT doc_id, chars::BIGINT AS chars, score::BIGINT AS score, high_quality FROM pg_q",
    "q07_doc_quality": f"""WITH {JOINED}, {counted("pg", "20")} SELECT source, count(*) AS pages, count(*) FILTER (chars >= 20) AS usable, count(*) FILTER (high_quality) AS high_quality,
      sum(chars)::BIGINT AS chars, count(*) FILTER (full_images > 0) AS full_image_pages, sum(garbled)::BIGINT AS garbled, sum(url_chars)::BIGINT AS url_chars FROM pg_q GROUP BY 1""",
    "q08_doc_route": _q08(),
    "q09_line_roles_text": f"WITH {ROLES} SELECT doc_id, line_no, role FROM roles",
    "q10_line_roles_layout": f"WITH {LAYOUT} SELECT doc_id, line_no, role FROM roles",
    "q11_bullet_demotion": f"""WITH RECURSIVE {LAYOUT}, nx AS (SELECT *, lag(text) OVER w AS pt, lag(role) OVER w AS pr, lag(x0) OVER w AS px FROM roles WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
      f(doc_id, line_no, final_role) AS (SELECT doc_id, line_no, role FROM roles WHERE line_no = 1
        UNION ALL SELECT n.doc_id, n.line_no, CASE WHEN n.role = 'bullet' AND f.final_role = 'ordered' AND {has("n.pt", COLON)} AND n.x0 <= n.px + 14 THEN 'body'
          WHEN n.role = 'bullet' AND f.final_role = 'bullet' AND NOT {has("n.pt", TERMINAL)} AND NOT {has("n.text", BULLET)} THEN 'body' ELSE n.role END
          FROM f JOIN nx n ON n.doc_id = f.doc_id AND n.line_no = f.line_no + 1) SELECT * FROM f""",
    "q12_block_ids": f"WITH {BLOCKS} SELECT doc_id, line_no, block_id::BIGINT AS block_id FROM numbered",
    "q13_block_text": f"WITH {BLOCKS} SELECT doc_id, block_id::BIGINT AS block_id, role, text FROM blocks",
    "q14_list_instances": f"""WITH {BLOCKS}, k AS (SELECT *, CASE WHEN role = 'ordered' THEN 'o' WHEN role IN ('bullet', 'plugin') THEN 'b' END AS kind FROM blocks),
      c AS (SELECT *, kind IS NOT NULL AND kind <> coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY block_id), '') AS fresh FROM k),
      n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY block_id) AS list_id FROM c) SELECT doc_id, block_id::BIGINT AS block_id, list_id::BIGINT AS list_id FROM n WHERE kind IS NOT NULL""",
    "q15_role_histogram": f"WITH {BLOCKS} SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM blocks GROUP BY 1",
    "q16_word_space_join": f"WITH {LINES}, p AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM lines) SELECT doc_id, count(*) FILTER ({space('before', 'text')}) AS blanks, count(*) AS n FROM p GROUP BY 1",
    "q17_sentence_terminal_rate": f"SELECT lang, count(*) FILTER ({has('l', TERMINAL)}) AS terminal, count(*) AS total FROM (SELECT lang, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1",
    "q18_plugin_items": f"WITH {LINES} SELECT doc_id, line_no, regexp_extract(text, '{PLUGIN}', 1) AS name, regexp_extract(text, '{PLUGIN}', 2) AS value FROM lines WHERE {has('text', PLUGIN)}",
    "q19_formula_lines": f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE {formula('text')}",
    "q20_chain_clusters": """WITH r AS (SELECT DISTINCT p_brand AS page, p_size * 10 + (p_partkey % 3) AS x FROM part), g AS (SELECT *, x - lag(x) OVER (PARTITION BY page ORDER BY x) AS gap FROM r),
      c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x) AS cluster FROM g)
      SELECT page, cluster::BIGINT AS cluster, sum(x)::BIGINT AS total, count(*) AS n, min(x) AS lo, max(x) AS hi FROM c GROUP BY page, cluster""",
    "q21_interval_merge": f"WITH {SEGMENTS}, {MERGED.format(n='mg', k='page', src='seg')} SELECT page, island::BIGINT AS island, lo, hi FROM mg",
    "q22_interval_coverage": f"WITH {SEGMENTS}, cut AS (SELECT * FROM seg WHERE least(hi, 100) - greatest(lo, 20) > 0), {MERGED.format(n='mg', k='page', src='cut')} SELECT page, sum(least(hi, 100) - greatest(lo, 20)) AS covered FROM mg GROUP BY 1",
    "q23_band_coverage": f"""WITH {SEGMENTS}, band(rule, c0, c1) AS (VALUES (4.0::DOUBLE, 0.0::DOUBLE, 60.0::DOUBLE), (10.0, 30.0, 150.0)),
      cut AS (SELECT page, rule, c0, c1, lo, hi FROM seg JOIN band ON abs(top - rule) <= 2.5 WHERE least(hi, c1) - greatest(lo, c0) > 0), {MERGED.format(n="mg", k="page, rule, c0, c1", src="cut")}
      SELECT page, rule, sum(least(hi, c1) - greatest(lo, c0)) AS covered, sum(least(hi, c1) - greatest(lo, c0)) >= 0.6::DOUBLE * (c1 - c0) AS present FROM mg GROUP BY page, rule, c0, c1""",
    "q24_path_classify": """SELECT CASE WHEN h <= 2 AND w >= 20 THEN 'H' WHEN w <= 2 AND h >= 10 THEN 'V' ELSE 'none' END AS kind, count(*) AS n
      FROM (SELECT l_quantity * (l_linenumber % 2) * 2 AS w, l_orderkey % 25 AS h FROM lineitem) GROUP BY 1""",
    "q25_run_split": f"""WITH {LINES}, w0 AS (SELECT doc_id, line_no, string_split(text, ' ') AS ws FROM lines), w1 AS (SELECT doc_id, line_no, unnest(ws) AS word, unnest(range(0, len(ws))) AS j FROM w0),
      g AS (SELECT *, j * 45 + (j * j * doc_id) % 7 * 5 AS x0, j * 45 + (j * j * doc_id) % 7 * 5 + length(word) * 4 AS x1 FROM w1),
      h AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, line_no ORDER BY x0, x1) AS gap FROM g)
      SELECT doc_id, line_no, count(*) FILTER (gap IS NULL OR gap > 14) AS runs, count(*) AS words FROM h GROUP BY 1, 2""",
    "q26_column_boundaries": """WITH v AS (SELECT p_brand AS page, p_size * 10 + (p_partkey % 3) AS x, p_partkey % 30 AS top, p_partkey % 30 + p_size AS bottom FROM part),
      p AS (SELECT page, x FROM v WHERE x BETWEEN 50 AND 450 AND least(bottom, 40) - greatest(top, 0) >= 8 UNION ALL SELECT DISTINCT page, 50 FROM v UNION ALL SELECT DISTINCT page, 450 FROM v),
      g AS (SELECT *, x - lag(x) OVER (PARTITION BY page ORDER BY x) AS gap FROM p), c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x) AS cluster FROM g)
      SELECT page, cluster::BIGINT AS cluster, sum(x)::BIGINT AS total, count(*) AS n FROM c GROUP BY 1, 2""",
    "q27_lines_outside_tables": f"""WITH {LINES} SELECT doc_id, line_no FROM lines WHERE NOT ((x0 + x1) / 2 BETWEEN 29 AND 401 + doc_id % 300 AND (top + bottom) / 2 BETWEEN 109 AND 167)
      AND NOT ((x0 + x1) / 2 BETWEEN 29 AND 901 AND (top + bottom) / 2 BETWEEN 249 AND 301)""",
    "q28_cell_assignment": f"""WITH {LINES}, cell AS (SELECT c // 2 AS r, c % 2 AS col, 36 + (c % 2) * 300 AS cx0, 336 + (c % 2) * 900 AS cx1, 40 + (c // 2) * 42 AS ct, 82 + (c // 2) * 42 AS cb FROM range(6) t(c)),
      j AS (SELECT *, least(x1, cx1) - greatest(x0, cx0) AS ox, least(bottom, cb) - greatest(top, ct) AS oy FROM lines, cell),
      s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY greatest(ox, 0.1::DOUBLE) * greatest(oy, 0.1::DOUBLE) DESC, r, col) AS rn FROM j
        WHERE (ox > 0 OR (x0 + x1) / 2 BETWEEN cx0 AND cx1) AND (top + bottom) / 2 BETWEEN ct AND cb)
      SELECT doc_id, r::BIGINT AS "row", col::BIGINT AS col, string_agg(text, chr(10) ORDER BY top, x0, line_no) AS text FROM s WHERE rn = 1 GROUP BY 1, 2, 3""",
    "q29_table_continuation": """WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_no, 2 + l_orderkey % 2 AS n, (l_quantity * 11) % 400 AS top, 300 + (l_quantity * 7) % 480 AS bottom,
        36.0 + (l_linenumber % 2) * 12 AS x0, l_returnflag AS h
        FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)),
      p AS (SELECT *, lag(page_no) OVER w AS pp, lag(n) OVER w AS pn, lag(bottom) OVER w AS pb, lag(x0) OVER w AS px, lag(h) OVER w AS ph FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)),
      q AS (SELECT *, coalesce(page_no = pp + 1 AND n = pn AND pb / 792 >= 0.7 AND top / 792 <= 0.3 AND abs(x0 - px) / 612 <= 0.04
        AND greatest(abs((200 - x0) / (540 - x0) - (200 - px) / (540 - px)), abs((540 - 200) / (540 - x0) - (540 - 200) / (540 - px)) * (n = 2)::INT,
          abs(200 / (540 - x0) - 200 / (540 - px)) * (n = 3)::INT, abs(140 / (540 - x0) - 140 / (540 - px)) * (n = 3)::INT) <= 0.06, false) AS continued FROM p)
      SELECT doc_id, page_no, continued, CASE WHEN continued AND h <> ph THEN ph END AS carried, CASE WHEN continued AND h <> ph THEN 0 ELSE 1 END::BIGINT AS header_rows FROM q""",
    "q32_ocr_audit": f"WITH {OCR} SELECT conv_id, turn, lines::BIGINT AS lines, non_empty::BIGINT AS non_empty, chars, low::BIGINT AS low, suspicious, min, needs_review FROM ocr",
    "q33_ocr_needs_review": f"WITH {OCR} SELECT role, count(*) FILTER (needs_review) AS review, count(*) AS n FROM ocr GROUP BY 1",
    "q34_html_strip": r"SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS n FROM pages",
    "q35_html_rows": r"""WITH r AS (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS c FROM pages) SELECT page_id, i::BIGINT AS "row", 0::BIGINT AS col,
      trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM (SELECT page_id, unnest(c) AS x, unnest(range(0, len(c))) AS i FROM r)""",
    "q36_block_order": """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 2 <> 0, CASE WHEN turn % 2 = 0 THEN (conv_id * 3 + turn * 5) % 7 ELSE (turn * 37 + conv_id) % 11 END, turn) AS rank FROM conversations""",
    "q37_latest_event": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "q38_job_fold": f"WITH {EVENTS} SELECT user_id, coalesce(arg_min(status, event_id) FILTER (status IN ('succeeded', 'failed')), arg_max(status, event_id)) AS status, count(*) AS events FROM ev GROUP BY 1",
    "q39_retry_outcome": f"""WITH {EVENTS}, d AS (SELECT user_id, min(event_id) AS done, count(*) AS s FROM ev WHERE status = 'succeeded' GROUP BY 1),
      p AS (SELECT user_id, count(*) FILTER (status = 'failed' AND (done IS NULL OR event_id < done)) AS f, coalesce(max(s), 0) AS s FROM ev LEFT JOIN d USING (user_id) GROUP BY 1)
      SELECT user_id, least(f + (s > 0)::INT, 2)::BIGINT AS attempts, CASE WHEN f > 1 THEN 'failed' WHEN s > 0 THEN 'succeeded' ELSE 'queued' END AS final FROM p""",
    "q40_deadlines": """WITH e AS (SELECT *, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1e6 AS s FROM events)
      SELECT user_id, count(*) FILTER (s > CASE WHEN event_type = 'view' THEN 1500 ELSE 6000 END) AS late, count(*) AS n FROM e GROUP BY 1""",
    "q41_ttl_expiry": "SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND",
    "q42_admission_queue": """WITH f AS (SELECT user_id, min(ts) AS created, arg_min(event_type, (ts, event_id)) AS queue FROM events GROUP BY 1), p AS (SELECT user_id, queue, row_number() OVER (PARTITION BY queue ORDER BY created, user_id) AS position FROM f)
      SELECT *, position <= 4 AS admitted FROM p""",
    "q43_upsert_delete": """WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS state, o_custkey AS owner FROM orders),
      u AS (SELECT id, CASE WHEN id % 14 = 0 THEN 'Y' WHEN id % 7 = 0 THEN 'X' ELSE state END AS state FROM r UNION ALL SELECT -id, 'N' FROM r WHERE id % 11 = 0 AND id % 7 <> 0)
      SELECT state, count(*) AS n, sum(id)::BIGINT AS ids FROM u WHERE id NOT IN (SELECT id FROM r WHERE owner % 13 = 0) GROUP BY 1""",
    "q44_catalogue_default": "SELECT doc_id, coalesce(quality, -1)::BIGINT AS quality FROM documents LEFT JOIN labels USING (doc_id)",
    "q45_corpus_metrics": f"""WITH {BLOCKS} SELECT source, count(DISTINCT b.doc_id) AS docs, count(*) AS blocks, count(*) FILTER (role IN ('heading1', 'heading2', 'title')) AS headings, count(*) FILTER (role IN ('bullet', 'plugin')) AS bullets,
      count(*) FILTER (role = 'ordered') AS ordered, sum(length(b.text))::BIGINT AS chars, count(*) > 0 AS ok FROM blocks b JOIN documents d ON d.doc_id = b.doc_id GROUP BY 1""",
    "q46_page_size_scale": "SELECT p_partkey, least(1000000, 792000000 // greatest(p_size * 40 + 100, (p_partkey % 50) * 30 + 200))::BIGINT AS scale, trunc((p_size * 40 + 100) * 1000000 / 72)::BIGINT AS width_millionths FROM part",
    "q47_required_entries": f"""WITH {ROLES}, s AS (SELECT doc_id, 4 - count(DISTINCT role) FILTER (role IN ('body', 'bullet', 'heading1', 'ordered')) AS missing FROM roles GROUP BY 1) SELECT doc_id, missing, missing = 0 AS complete FROM s""",
    "q48_sanitize_names": r"""SELECT page_id, CASE WHEN n = '' THEN 'input.pdf' ELSE n END AS name FROM (SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), '[^0-9A-Za-z_.\-一-龥]', '_', 'g') AS n FROM pages)""",
    "q49_page_metrics": """WITH b AS (SELECT p_partkey, p_size::DOUBLE AS s, (p_partkey % 7) * 9 - 18.0 AS t, p_size * 40 + 100 AS w, (p_partkey % 50) * 30 + 200 AS h FROM part),
      g AS (SELECT *, [greatest(s, 0), greatest(t, 0), greatest(900 - t, 0)] AS hs FROM b),
      i AS (SELECT *, list_transform(hs, lambda x: greatest(x / 72, 0.2)) AS ws FROM g), k AS (SELECT *, least(1.0, 6.0 / greatest(list_sum(ws), 0.2)) AS sc FROM i)
      SELECT p_partkey, round(list_sum(hs) * 10)::BIGINT AS height, round(list_min(hs) * 10)::BIGINT AS least, round(list_sum(ws) * sc * 1000)::BIGINT AS width,
      round(list_sum(list_transform(hs, lambda x: greatest(x * sc, 6.0))) * 1000)::BIGINT AS rows, round(greatest(least(2.0, sqrt(1000000.0 / (w * h))), 0.1) * 100000)::BIGINT AS render,
      least(greatest(w - 150, 1), 100)::BIGINT AS quality FROM k""",
    "q50_stage_progress": """SELECT event_type, CASE event_type WHEN 'view' THEN 60 WHEN 'click' THEN 90 WHEN 'purchase' THEN 95
      ELSE least(80, 20 + floor(60 * (event_id % 9) / greatest(user_id % 5, 1))) END::BIGINT AS progress, count(*) AS n FROM events GROUP BY ALL""",
    "q51_job_lifecycle": """WITH j AS (SELECT o_orderkey AS id, ['queued', 'processing', 'succeeded', 'failed', 'timed_out', 'cancelled'][o_orderkey % 6 + 1] AS status, o_custkey % 4 AS attempt,
  o_orderkey % 5 > 0 AS has_input, o_custkey % 3 > 0 AS has_output, o_custkey % 7 = 0 AS late, o_orderdate AS created FROM orders) SELECT id,
      CASE WHEN status NOT IN ('queued', 'processing') THEN status WHEN NOT has_input OR attempt > 1 THEN 'failed' ELSE 'queued' END AS recovered,
      CASE WHEN status = 'succeeded' AND has_output THEN 'succeeded' WHEN status = 'cancelled' THEN 'cancelled' WHEN attempt <= 1 THEN 'queued' WHEN late OR status = 'timed_out' THEN 'timed_out' ELSE 'failed' END AS exited,
      CASE WHEN status IN ('queued', 'processing') THEN 'cancelled' ELSE status END AS cancelled, CASE WHEN status = 'processing' THEN 'queued' ELSE status END AS stopped,
      CASE WHEN status = 'succeeded' AND has_output THEN 200 ELSE 409 END::BIGINT AS download, CASE WHEN status = 'succeeded' THEN '/jobs/' || id || '/result' END AS url,
      CASE WHEN id % 10 = 0 OR attempt < 1 THEN 400 WHEN attempt > 2 THEN 413 ELSE 200 END::BIGINT AS pages FROM j""",
    "q52_latest_state": """WITH e AS (SELECT user_id, event_id, event_id % 11 = 0 AS bad, event_id % 11 <> 0 AND event_id % 5 = 0 AS a, event_id % 11 <> 0 AND event_id % 5 <> 0 AND event_id % 7 = 0 AS b, event_type FROM events),
      f AS (SELECT *, NOT bad AND NOT a AND NOT b AS c FROM e WHERE NOT bad)
      SELECT user_id, arg_max(event_type, event_id) FILTER (c) AS status, arg_max(event_id % 100, event_id) FILTER (b)::BIGINT AS progress, max(CASE WHEN a THEN 'ocr' END) AS route,
      max(CASE WHEN c THEN user_id % 4 END)::BIGINT AS table_count FROM f GROUP BY user_id""",
    "q53_scheduler": """WITH j AS (SELECT o_orderkey AS id, ['queued', 'processing', 'succeeded', 'failed', 'timed_out', 'cancelled'][o_orderkey % 6 + 1] AS status, o_custkey % 4 AS attempt,
  o_orderkey % 5 > 0 AS has_input, o_custkey % 3 > 0 AS has_output, o_custkey % 7 = 0 AS late, o_orderdate AS created FROM orders) SELECT id FROM j WHERE status = 'queued' ORDER BY created, id LIMIT 4""",
    "q54_page_events": f"""WITH {LINES}, t AS (SELECT DISTINCT doc_id, 30 AS x0, 400 + doc_id % 300 AS x1, 110 AS top, 166 AS bottom, 0 AS no FROM documents UNION ALL SELECT DISTINCT doc_id, 30, 900, 250, 300, 1 FROM documents),
      o AS (SELECT doc_id, 1 AS kind, top, line_no AS no FROM lines l WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = l.doc_id AND (l.x0 + l.x1) / 2 BETWEEN t.x0 - 1 AND t.x1 + 1 AND (l.top + l.bottom) / 2 BETWEEN t.top - 1 AND t.bottom + 1)),
      u AS (SELECT * FROM o UNION ALL SELECT doc_id, 0, top, no FROM t)
      SELECT doc_id, kind::BIGINT AS kind, no::BIGINT AS no, row_number() OVER w AS seq, count(*) FILTER (kind = 0) OVER (PARTITION BY doc_id ORDER BY top, kind, no ROWS UNBOUNDED PRECEDING) AS segment
      FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY top, kind, no)""",
    "q56_recognised_blocks": r"""WITH r AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS m, text FROM conversations),
      b AS (SELECT *, ['text', 'doc_title', 'abstract', 'abstract', 'table', 'text'][m + 1] AS label, CASE WHEN m = 3 THEN 'Summary' || chr(10) || text WHEN m = 5 AND turn % 4 = 0 THEN '<TABLE><tr><td>' || text || '</td></tr></TABLE>' ELSE text END AS content FROM r),
      k AS (SELECT *, CASE WHEN label = 'table' OR contains(lower(content), '<table') THEN 'table' WHEN label = 'doc_title' THEN 'title' ELSE 'text' END AS kind FROM b WHERE trim(content, E' \t\n\r') <> ''),
      l AS (SELECT conv_id, turn, kind, label, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM (SELECT *, CASE WHEN kind = 'text' THEN list_filter(list_transform(string_split(content, chr(10)), lambda y: trim(y, E' \t\r')), lambda y: y <> '') ELSE [trim(content, E' \t\n\r')] END AS ls FROM k))
      SELECT conv_id, turn, kind, count(*) AS lines, count(*) FILTER (kind = 'title' OR i = 0 AND label = 'abstract' AND kind = 'text' AND length(x) <= 24 AND NOT regexp_matches(x, '[：:。；;]')) AS heads,
      sum(length(CASE WHEN kind = 'table' THEN x ELSE trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) END))::BIGINT AS chars FROM l GROUP BY ALL""",
    "q57_page_sizes": """SELECT l_orderkey AS id, (l_linenumber - 1)::BIGINT AS page_no, max(round(greatest(((l_orderkey % 9) * 72.0 + least(l_linenumber - 1, l_orderkey % 3) * 36) / 72, 0.01) * 1000))::BIGINT AS milli_inches, count(*) AS n
      FROM lineitem JOIN (SELECT DISTINCT o_orderkey FROM orders) ON o_orderkey = l_orderkey GROUP BY ALL""",
    "q58_given_roles": f"WITH {ROLES} SELECT doc_id, line_no, CASE WHEN line_no = 1 THEN 'title' WHEN line_no = 2 AND doc_id % 2 = 0 THEN 'heading1' ELSE role END AS role FROM roles",
    "q59_render_deltas": f"""WITH {LINES}, s AS (SELECT doc_id, count(*) AS pages FROM lines GROUP BY 1)
      SELECT doc_id, pages, CASE WHEN doc_id % 3 = 0 THEN pages + doc_id % 4 - 1 END AS rendered, CASE WHEN doc_id % 3 = 0 THEN doc_id % 4 - 1 END AS delta FROM s""",
    "q60_recognition_stats": """WITH r AS (SELECT conv_id, turn, string_split(text, chr(10)) AS t FROM conversations)
      SELECT conv_id, turn, len(t)::BIGINT AS lines, list_sum(list_transform(t, lambda x: length(x)))::BIGINT AS chars,
      CASE WHEN turn % 5 > 0 THEN round(round(list_sum(list_transform(range(len(t)), lambda i: ((conv_id * 7 + turn * 3 + i * 11) % 100) / 128.0::DOUBLE)) / len(t), 4) * 10000)::BIGINT END AS mean FROM r""",
    "q61_first_keys": "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '')))[1:20], ' ') AS keys FROM documents",
    "q62_docx_round_trip": f"""WITH {BLOCKS} SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (role IN ('title', 'heading1', 'heading2')) AS headings, count(*) FILTER (role IN ('bullet', 'plugin')) AS bullets,
      count(*) FILTER (role = 'ordered') AS ordered, sum(length(regexp_replace(text, '\\s+', '', 'g')))::BIGINT AS text_chars, 0::BIGINT AS media_count, count(*) AS text_nodes, true AS complete, true AS zip_ok FROM blocks GROUP BY doc_id""",
    "q65_recognition_export": r"""WITH p AS (SELECT DISTINCT conv_id, turn AS page_no FROM conversations),
      k AS (SELECT conv_id, turn, CASE WHEN contains(lower(text), '<table') THEN 'table' ELSE 'line' END AS kind, text FROM conversations WHERE trim(text, E' \t\n\r') <> ''),
      l AS (SELECT conv_id, turn, kind, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM (SELECT *, CASE WHEN kind = 'line' THEN list_filter(list_transform(string_split(text, chr(10)), lambda y: trim(y, E' \t\r')), lambda y: y <> '') ELSE [trim(text, E' \t\n\r')] END AS ls FROM k))
      SELECT conv_id, 0::BIGINT AS part, page_no, 'image' AS kind, 0::BIGINT AS line_no, NULL AS text FROM p WHERE conv_id % 2 = 0
      UNION ALL SELECT conv_id, 1, page_no, 'heading2', -1, '第 ' || (page_no + 1) || ' 页' FROM p
      UNION ALL SELECT conv_id, 1, turn, kind, i, CASE WHEN kind = 'table' THEN x ELSE trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) END FROM l""",
    "q66_table_counts": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS tables FROM (SELECT DISTINCT doc_id FROM documents)""",
    "q67_settings": """SELECT * FROM (VALUES ('min_page_chars', '20'), ('usable_ratio', '0.6'), ('high_quality_ratio', '0.8'), ('full_page_pixels', '300000'), ('garbled_ratio', '0.05'), ('route_mode', 'auto'),
      ('max_pending', '4'), ('workers', '1'), ('task_timeout_s', '300'), ('ocr_budget_s', '60'), ('ttl_s', '3600'), ('max_retries', '1')) v(name, value)""",
    "q68_record_summaries": """SELECT conv_id, turn, 'k' || (turn % 4) || ',markdown,page_index' AS keys, CASE WHEN conv_id % 3 > 0 THEN length(text) END::BIGINT AS markdown_chars, turn::VARCHAR AS page_index FROM conversations""",
}
