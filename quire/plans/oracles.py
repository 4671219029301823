"""SQL of the registered queries for the test database."""

from __future__ import annotations

from ..sources import typeset

_B, _L, _G = (typeset.duck(n) for n in ("blocks", "lines", "glyphs"))
_GT = _G.replace("AS rune FROM lines)", "AS rune FROM lines WHERE page % 5 = 2)")  # the pages that hold tables
_Q = "round(size / 0.5) * 0.5"
_WORDS = r"len(regexp_extract_all(text, '[^ \t\n\r\x0B\f]+'))"
_ENDS = r"""regexp_matches(text, '[.!?…。！？]["''”’)\] \t\n]*$')"""

_BODY = f""", fonts AS (SELECT doc_id, family AS body_family, {_Q} AS body_size, bold AS body_bold, fixed AS body_fixed, CAST(sum(n_glyphs) AS BIGINT) AS body_glyphs FROM blocks GROUP BY ALL),
bodies AS (SELECT * EXCLUDE rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY body_glyphs DESC, body_size, body_family, body_bold, body_fixed) AS rank FROM fonts) WHERE rank = 1)"""
_HEADS = f"""{_BODY}, headlines AS (SELECT b.* FROM blocks b JOIN bodies USING (doc_id) WHERE ({_Q} >= round(body_size * 1.15 / 0.5) * 0.5 AND {_WORDS} <= 50) OR (bold AND NOT body_bold AND {_WORDS} < 15 AND NOT {_ENDS})),
levels AS (SELECT *, CAST(least(dense_rank() OVER (PARTITION BY doc_id ORDER BY {_Q} DESC, bold DESC), 6) AS INT) AS level FROM headlines)"""
_MARGINS = """, edges AS (SELECT doc_id, 'l' AS e, round(min_x) AS v FROM blocks WHERE n_lines >= 2 UNION ALL SELECT doc_id, 'r', round(max_x) FROM blocks WHERE n_lines >= 2),
modes AS (SELECT doc_id, e, v FROM (SELECT doc_id, e, v, row_number() OVER (PARTITION BY doc_id, e ORDER BY count(*) DESC, v) AS r FROM edges GROUP BY doc_id, e, v) WHERE r = 1),
margins AS (SELECT d.doc_id, coalesce(l.v, 0.0) AS left_margin, coalesce(r.v, 0.0) AS right_margin FROM (SELECT DISTINCT doc_id FROM blocks) d
  LEFT JOIN (SELECT * FROM modes WHERE e = 'l') l USING (doc_id) LEFT JOIN (SELECT * FROM modes WHERE e = 'r') r USING (doc_id))"""
_QUOTES = _MARGINS + ", quotes AS (SELECT b.* FROM blocks b JOIN margins USING (doc_id) WHERE n_lines >= 2 AND min_x >= left_margin + 1.5 * size AND max_x <= right_margin - 1.5 * size)"
_LETTERS = r"len(regexp_extract_all(text, '\p{L}'))"
_MARK = r"regexp_matches(text, '^(?:[•◦▪‣*-]|\(?(?:[0-9]{1,3}|[ivxlcdm]+|[A-Za-z])[.)\]])[ \t\n]+[^ \t\n]')"
_NOTES = rf""", notes AS (SELECT b.*, regexp_extract(text, '^([0-9]{{1,3}}|[*†‡])', 1) AS label FROM blocks b JOIN bodies USING (doc_id)
  WHERE min_y >= 792.0 * 0.8 AND size < body_size * 0.9 AND regexp_matches(text, '^(?:[0-9]{{1,3}}|[*†‡])[.)\]]?[ \t\n]+[^ \t\n]') AND {_LETTERS} >= 8)"""
_NAV = _HEADS + """, nav AS (SELECT l.doc_id, l.ord, l.level, l.text, (SELECT max(p.ord) FROM levels p WHERE p.doc_id = l.doc_id AND p.ord < l.ord AND p.level < l.level) AS parent FROM levels l)"""
_CHAPTERS = _HEADS + """, leveled AS (SELECT b.*, l.level FROM blocks b LEFT JOIN (SELECT doc_id, ord, level FROM levels) l ON b.doc_id = l.doc_id AND b.ord = l.ord),
chapters AS (SELECT *, CAST(sum(CASE WHEN level <= 2 AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chapter
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM leveled))"""
_SAMPLE = """, pg AS (SELECT doc_id, list_sort(list_distinct(list(page))) AS a FROM blocks GROUP BY doc_id),
sample AS (SELECT DISTINCT doc_id, a[1 + CAST(CASE WHEN len(a) <= 20 THEN i ELSE round(i * (len(a) - 1) / 19.0) END AS INT)] AS page FROM pg, range(20) t(i) WHERE len(a) > 20 OR i < len(a))"""
_FURNITURE = _SAMPLE + r""", band AS (SELECT doc_id, ord, page, regexp_matches(text, '^(?i:[ \t]*(?:page[ \t]+)?[-–—]?[ \t]*(?:[0-9]{1,4}|[ivxlcdm]{1,7})[ \t]*[-–—]?[ \t]*)$') AS folio,
  sha256(regexp_replace(lower(regexp_replace(text, '[0-9]', '#', 'g')), '[^\p{L}#]+', '', 'g'))[1:16] AS tk, concat_ws(':', CAST(round(min_y) AS BIGINT), CAST(round(max_y) AS BIGINT), CAST(round(min_x) AS BIGINT)) AS pk
  FROM blocks WHERE max_y <= 792.0 * 0.08 OR min_y >= 792.0 * (1 - 0.08)),
need AS (SELECT doc_id, greatest(2, ceil(count(*) * 0.6::DOUBLE)) AS need FROM sample GROUP BY doc_id HAVING count(*) >= 5),
seen AS (SELECT band.* FROM band JOIN sample USING (doc_id, page)),
nt AS (SELECT doc_id, tk, count(DISTINCT page) AS n_t FROM seen GROUP BY ALL), np AS (SELECT doc_id, pk, count(DISTINCT page) AS n_p FROM seen GROUP BY ALL)
SELECT doc_id, ord, reason FROM (SELECT band.doc_id, ord, CASE WHEN n_t >= need THEN 'text' WHEN folio THEN 'folio' WHEN n_p >= need THEN 'position' END AS reason
  FROM band JOIN need USING (doc_id) LEFT JOIN nt USING (doc_id, tk) LEFT JOIN np USING (doc_id, pk)) WHERE reason IS NOT NULL"""
_USUAL = "CASE WHEN list_aggregate(r.leads, 'median') > 0 THEN list_aggregate(r.leads, 'median') ELSE 1.2::DOUBLE * greatest(r.size, s.size) END"
#: Blocks by a recursion over the lines of each page.
_SEGMENTS = _L.replace("WITH ", "WITH RECURSIVE ", 1) + f""", s AS (SELECT doc_id, page, ord, baseline, size, family, min_x, max_x, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS k FROM lines),
r AS (SELECT doc_id, page, ord, k, baseline, size, family, min_x AS lo, max_x AS hi, CAST([] AS DOUBLE[]) AS leads, 0 AS block FROM s WHERE k = 1
  UNION ALL SELECT doc_id, page, ord, k, baseline, size, family, CASE WHEN opens THEN min_x ELSE least(lo, min_x) END, CASE WHEN opens THEN max_x ELSE greatest(hi, max_x) END,
    CASE WHEN opens THEN CAST([] AS DOUBLE[]) ELSE list_append(leads, gap) END, block + CASE WHEN opens THEN 1 ELSE 0 END
  FROM (SELECT s.*, r.lo, r.hi, r.leads, r.block, s.baseline - r.baseline AS gap,
      s.baseline < r.baseline OR s.baseline - r.baseline > 1.5 * {_USUAL} OR s.family <> r.family OR abs(s.size - r.size) > 0.15 * greatest(s.size, r.size)
      OR least(r.hi, s.max_x) <= greatest(r.lo, s.min_x) OR least(r.hi, s.max_x) - greatest(r.lo, s.min_x) < 0.5 * least(r.hi - r.lo, s.max_x - s.min_x) AS opens
    FROM r JOIN s ON s.doc_id = r.doc_id AND s.page = r.page AND s.k = r.k + 1))"""
#: Paragraphs by a recursion over the lines of each block.
_PARAGRAPHS = _L.replace("WITH ", "WITH RECURSIVE ", 1) + rf""", moved AS (SELECT doc_id, page, ord, ord // 4 AS line, size, baseline + CASE WHEN ord // 4 % 11 = 6 THEN 5.0 ELSE 0.0 END AS baseline,
    min_x + CASE WHEN ord // 4 % 7 = 3 THEN 18.0 WHEN ord // 4 % 13 = 4 THEN 6.0 ELSE 0.0 END AS min_x, CASE WHEN ord // 4 % 9 = 2 THEN 300.0 ELSE max_x END AS max_x,
    CASE WHEN ord // 4 % 9 = 2 THEN text || '.' WHEN ord // 4 % 5 = 1 THEN text || '-' WHEN ord // 4 % 17 = 9 THEN 'a) ' || text ELSE text END AS text
  FROM lines WHERE cls NOT IN ('running', 'folio')),
placed2 AS (SELECT *, CAST(line % 40 // 9 AS BIGINT) AS block FROM moved),
s AS (SELECT *, {_MARK} AS marked, {_ENDS} AS ends, max_x - min_x AS width, row_number() OVER w AS k, median(min_x) OVER b AS usual_x, max(max_x) OVER b - min(min_x) OVER b AS block_width
  FROM placed2 WINDOW w AS (PARTITION BY doc_id, page, block ORDER BY ord), b AS (PARTITION BY doc_id, page, block)),
r AS (SELECT doc_id, page, block, ord, k, baseline, size, ends, width, marked AS first_marked, min_x AS first_x, CAST([] AS DOUBLE[]) AS leads, 0 AS paragraph FROM s WHERE k = 1
  UNION ALL SELECT doc_id, page, block, ord, k, baseline, size, ends, width, CASE WHEN opens THEN marked ELSE first_marked END, CASE WHEN opens THEN min_x ELSE first_x END,
    CASE WHEN opens THEN CAST([] AS DOUBLE[]) ELSE list_append(leads, gap) END, paragraph + CASE WHEN opens THEN 1 ELSE 0 END
  FROM (SELECT s.*, r.leads, r.paragraph, r.first_marked, r.first_x, s.baseline - r.baseline AS gap,
      s.marked OR (NOT (r.first_marked AND s.min_x > r.first_x) AND (s.min_x - s.usual_x > 0.5 * s.size OR s.baseline - r.baseline > 1.25 * {_USUAL} OR (r.ends AND s.block_width > 0 AND r.width < 0.8 * s.block_width))) AS opens
    FROM r JOIN s ON s.doc_id = r.doc_id AND s.page = r.page AND s.block = r.block AND s.k = r.k + 1))"""
_PAGES = """, pages2 AS (SELECT doc_id, page, CAST(sum(n_glyphs) AS BIGINT) AS n_glyphs, CAST(sum(CASE WHEN page % 19 = 3 THEN n_glyphs // 50 ELSE 0 END) AS BIGINT) AS n_missing,
  CASE WHEN page % 7 = 6 THEN 792.004 ELSE 612.0 END AS width, CASE WHEN page % 7 = 6 THEN 612.0 ELSE 792.0 END AS height FROM lines GROUP BY doc_id, page)"""
_IMAGES = """, pgs AS (SELECT doc_id, page, CAST(sum(n_glyphs) AS BIGINT) AS page_glyphs FROM lines WHERE page % 3 = 0 GROUP BY doc_id, page),
images AS (SELECT doc_id, page, page_glyphs, 0 AS ord, CAST(page % 40 + 60 AS DOUBLE) AS min_x, 200.0::DOUBLE AS min_y, CAST(page % 40 + 280 AS DOUBLE) AS max_x, 350.0::DOUBLE AS max_y, 0 AS glyphs_before, 'd' || CAST((doc_id + page) % 5 AS VARCHAR) AS digest FROM pgs
  UNION ALL SELECT doc_id, page, page_glyphs, 1, 500.0, 700.0, 510.0, 740.0, page_glyphs, 'd' || CAST((doc_id + page + 1) % 5 AS VARCHAR) FROM pgs)"""
_RULES = """, tp AS (SELECT DISTINCT doc_id, page FROM lines WHERE page % 5 = 2), tops AS (SELECT doc_id, page, 180.0 AS top, 0 AS region FROM tp UNION ALL SELECT doc_id, page, 400.0, 1 FROM tp WHERE page % 10 = 2)"""
_CELLS = """, boxes AS (SELECT doc_id, page, region, r AS row_, c AS col_, 70.25 + 90.0 * c AS x0, 160.25 + 90.0 * c AS x1, top + 28.0 * r + 0.25 AS y0, top + 28.0 * r + 28.25 AS y1 FROM tops, range(4) a(r), range(3) b(c)),
texts AS (SELECT b.doc_id, b.page, region, row_, col_, trim(string_agg(rune, '' ORDER BY ord, x, seq)) AS text FROM boxes b JOIN glyphs g ON b.doc_id = g.doc_id AND b.page = g.page AND x + advance / 2 BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL),
cells AS (SELECT boxes.doc_id, boxes.page, region, row_ AS "row", col_ AS col, coalesce(text, '') AS text FROM boxes LEFT JOIN texts USING (doc_id, page, region, row_, col_))"""

ORACLE_SQL = {
    "typeset_lines": _L + " SELECT * FROM lines",
    "typeset_blocks": _B + " SELECT * FROM blocks",
    "body_font": _B + _BODY + " SELECT * FROM bodies",
    "modal_margins": _B + _MARGINS + " SELECT * FROM margins",
    "headings": _B + _HEADS + " SELECT doc_id, ord, text FROM headlines",
    "heading_levels": _B + _HEADS + " SELECT doc_id, ord, level FROM levels",
    "quotes": _B + _QUOTES + " SELECT doc_id, ord FROM quotes",
    "footnotes": _B + _BODY + _NOTES + " SELECT doc_id, ord, label FROM notes",
    "list_groups": _B + rf""", m AS (SELECT *, {_MARK} AS item, {_MARK} AND NOT regexp_matches(text, '^[•◦▪‣*-]') AS ordered FROM blocks),
r AS (SELECT *, CASE WHEN item AND lag(item) OVER w AND lag(ordered) OVER w = ordered AND lag(page) OVER w = page THEN 0 ELSE 1 END AS opens FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT doc_id, min(ord) AS first_ord, page, ordered, CAST(count(*) AS BIGINT) AS items, coalesce(TRY_CAST(regexp_extract(arg_min(text, ord), '^\(?([0-9]{{1,3}})[.)\]]', 1) AS INT), 0) AS start
FROM n WHERE item GROUP BY doc_id, run, ordered, page HAVING count(*) > 1 OR sum(n_lines) >= 2""",
    "block_kinds": _B + _HEADS + _NOTES + _QUOTES + f""" SELECT b.doc_id, b.ord, CASE WHEN l.level IS NOT NULL THEN 'heading' WHEN b.fixed AND NOT body_fixed THEN 'code' WHEN n.ord IS NOT NULL THEN 'footnote' WHEN {_MARK.replace('text', 'b.text')} THEN 'list' WHEN q.ord IS NOT NULL THEN 'blockquote' ELSE 'paragraph' END AS kind, coalesce(l.level, -1) AS level
FROM blocks b JOIN bodies ON b.doc_id = bodies.doc_id LEFT JOIN levels l ON l.doc_id = b.doc_id AND l.ord = b.ord LEFT JOIN notes n ON n.doc_id = b.doc_id AND n.ord = b.ord LEFT JOIN quotes q ON q.doc_id = b.doc_id AND q.ord = b.ord""",
    "block_ids": _B + """, h AS (SELECT doc_id, ord, 'b' || sha256(encode('paragraph') || unhex('00') || unhex(printf('%08x', page)) || encode(text))[1:8] AS base FROM blocks),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY ord) - 1 AS k FROM h) SELECT doc_id, ord, CASE WHEN k = 0 THEN base ELSE base || '-' || printf('%02x', k) END AS block_id FROM n""",
    "furniture": _B + _FURNITURE,
    "even_sample": _B + _SAMPLE + " SELECT doc_id, page FROM sample",
    "script_ratio": _B + rf""", s AS (SELECT doc_id, CAST(sum({_LETTERS}) AS BIGINT) AS letters, CAST(sum(len(regexp_extract_all(regexp_replace(text, '[^\p{{L}}]', '', 'g'), '[\x{{0590}}-\x{{08FF}}\x{{FB1D}}-\x{{FDFF}}\x{{FE70}}-\x{{FEFF}}]'))) AS BIGINT) AS rtl_letters FROM blocks GROUP BY doc_id)
SELECT *, letters > 0 AND rtl_letters >= 0.2 * letters AS right_to_left FROM s""",
    "page_sizes": _L + _PAGES + " SELECT doc_id, CAST(round(width, 2) AS DOUBLE) AS width, CAST(round(height, 2) AS DOUBLE) AS height, 0 AS rotate, count(*) AS n_pages, min(page) AS first_page FROM pages2 GROUP BY ALL",
    "quality_score": _L + _PAGES + """, q AS (SELECT doc_id, count(*) AS pages, CAST(sum(n_glyphs) AS BIGINT) AS glyphs, CAST(sum(n_missing) AS BIGINT) AS missing, sum(CASE WHEN n_glyphs = 0 THEN 1 ELSE 0 END) AS e FROM pages2 GROUP BY doc_id),
r AS (SELECT *, CASE WHEN glyphs > 0 THEN missing / CAST(glyphs AS DOUBLE) ELSE 0.0 END AS rate FROM q)
SELECT doc_id, pages, glyphs, missing, CAST(greatest(0, round(100 - least(40.0, rate * 800) - least(20.0, CASE WHEN rate > 0.05 THEN 2.0 ELSE 0.0 END) - CASE WHEN glyphs = 0 THEN 30.0 ELSE 0.0 END - least(20.0, e * 40.0 / pages))) AS BIGINT) AS score FROM r""",
    "scan_outcome": _L + _PAGES + """, v AS (SELECT doc_id, CASE WHEN doc_id % 13 = 5 THEN page % 10 ELSE n_glyphs END AS visible, CASE WHEN doc_id % 13 = 5 AND doc_id % 2 = 0 THEN 0.95 ELSE 0.1 END AS cover FROM pages2),
a AS (SELECT doc_id, median(visible) AS median_glyphs, avg(CASE WHEN cover >= 0.8 THEN 1.0 ELSE 0.0 END) AS p FROM v GROUP BY doc_id)
SELECT doc_id, CAST(median_glyphs AS DOUBLE) AS median_glyphs, round(p, 6) AS image_pages, CASE WHEN median_glyphs < 20 AND p > 0.8 THEN 'no_text_layer' WHEN median_glyphs < 20 THEN 'warn' ELSE 'ok' END AS outcome FROM a""",
    "image_cover": _L + _IMAGES + """, c AS (SELECT DISTINCT doc_id, page, cx, cy FROM images, range(32) a(cx), range(32) b(cy) WHERE cx >= floor(min_x / 612.0 * 32) AND cx <= ceil(max_x / 612.0 * 32) - 1 AND cy >= floor(min_y / 792.0 * 32) AND cy <= ceil(max_y / 792.0 * 32) - 1)
SELECT doc_id, page, round(count(*) / 1024.0::DOUBLE, 6) AS cover FROM c GROUP BY doc_id, page""",
    "nav_tree": _B + _NAV + " SELECT doc_id, ord, level, text, coalesce(parent, -1) AS parent FROM nav",
    "nav_depth2": _B + _NAV + " SELECT n.doc_id, n.ord, coalesce(n.parent, -1) AS parent, CASE WHEN n.parent IS NULL THEN 1 ELSE 2 END AS depth FROM nav n LEFT JOIN nav p ON p.doc_id = n.doc_id AND p.ord = n.parent WHERE n.parent IS NULL OR p.parent IS NULL",
    "chapter_titles": _B + _CHAPTERS + """ SELECT doc_id, chapter, coalesce(arg_min(CASE WHEN level IS NOT NULL AND trim(text) <> '' THEN text END, CASE WHEN level IS NOT NULL AND trim(text) <> '' THEN ord END), CASE WHEN chapter = 0 THEN 'Untitled' ELSE 'Page ' || CAST(min(page) + 1 AS VARCHAR) END) AS title, count(*) AS n_blocks FROM chapters GROUP BY doc_id, chapter""",
    "page_counts": _G + " SELECT doc_id, page, count(*) AS n_glyphs, CAST(sum(CASE WHEN render_mode NOT IN (3, 7) THEN 1 ELSE 0 END) AS BIGINT) AS n_visible, CAST(sum(CASE WHEN rotation > 5 THEN 1 ELSE 0 END) AS BIGINT) AS n_rotated, CAST(sum(CASE WHEN missing THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, NOT bool_or(render_mode NOT IN (3, 7)) AS used_invisible FROM glyphs GROUP BY doc_id, page",
    "line_text": _G + """, u AS (SELECT *, bool_or(render_mode NOT IN (3, 7)) OVER (PARTITION BY doc_id, page) AS any_seen FROM glyphs WHERE rotation <= 5),
v AS (SELECT * FROM u WHERE render_mode NOT IN (3, 7) OR NOT any_seen),
s AS (SELECT doc_id, page, ord, median(advance) AS step, median(size) AS line_size, median(y + rise) AS baseline, min(x) AS min_x, max(x + advance) AS max_x, min(y - 0.75 * size - rise) AS min_y, max(y + 0.25 * size - rise) AS max_y, count(*) AS n_glyphs FROM v GROUP BY doc_id, page, ord),
f AS (SELECT doc_id, page, ord, font_id, row_number() OVER (PARTITION BY doc_id, page, ord ORDER BY count(*) DESC, font_id) AS r FROM v GROUP BY doc_id, page, ord, font_id),
g AS (SELECT v.*, v.rise > 0 OR (baseline - y > 0.2 * line_size AND size < 0.85 * line_size) AS sup, step FROM v JOIN s USING (doc_id, page, ord)),
k AS (SELECT *, CASE WHEN x - lag(x + advance) OVER w > 0.25 * step AND rune <> ' ' AND lag(rune) OVER w <> ' ' THEN ' ' ELSE '' END AS sp, coalesce(lag(sup) OVER w, false) AS was, coalesce(lead(sup) OVER w, false) AS nxt FROM g WINDOW w AS (PARTITION BY doc_id, page, ord ORDER BY x, seq)),
t AS (SELECT doc_id, page, ord, rtrim(string_agg(sp || CASE WHEN sup AND NOT was THEN chr(57344) ELSE '' END || rune || CASE WHEN sup AND NOT nxt THEN chr(57345) ELSE '' END, '' ORDER BY x, seq)) AS text, bool_or(sup) AS has_superscript FROM k GROUP BY doc_id, page, ord)
SELECT doc_id, page, ord, md5(text) AS text_md5, has_superscript, line_size AS size, baseline, min_x, max_x, min_y, max_y, n_glyphs, font_id FROM t JOIN s USING (doc_id, page, ord) JOIN (SELECT * FROM f WHERE r = 1) USING (doc_id, page, ord) WHERE trim(translate(text, chr(57344) || chr(57345), '')) <> ''""",
    "reading_order": _L + """, c AS (SELECT doc_id, page, ord, CASE WHEN 208.0 > min_x AND 208.0 < max_x THEN -1 WHEN 208.0 <= (min_x + max_x) / 2 THEN 1 ELSE 0 END AS col FROM lines),
b AS (SELECT *, sum(CASE WHEN col = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY ord ROWS UNBOUNDED PRECEDING) AS band FROM c)
SELECT doc_id, page, ord, col, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY band, col <> -1, col, ord) AS INT) AS position FROM b""",
    "figures": _L + _IMAGES + " SELECT doc_id, page, ord, min_x, max_x FROM images WHERE least(max_x - min_x, max_y - min_y) >= 16 AND (max_x - min_x) * (max_y - min_y) / (612.0 * 792.0) >= 0.02",
    "image_ids": _L + _IMAGES + """, d AS (SELECT doc_id, digest, min(page * 10 + ord) AS at_, count(*) AS placements FROM images GROUP BY doc_id, digest)
SELECT doc_id, digest, 'img' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY at_) - 1 AS VARCHAR), 3, '0') AS image_id, placements FROM d""",
    "segments": _SEGMENTS + " SELECT doc_id, page, ord, CAST(block AS BIGINT) AS block FROM r",
    "paragraph_starts": _PARAGRAPHS + " SELECT doc_id, page, ord, block, CAST(paragraph AS BIGINT) AS paragraph FROM r",
    "paragraph_text": _PARAGRAPHS + r""", j AS (SELECT s.*, r.paragraph, trim(s.text, E' \t\n\r') AS piece FROM s JOIN r USING (doc_id, page, block, ord)),
l AS (SELECT *, lag(piece) OVER w AS behind, lead(piece) OVER w AS ahead FROM j WINDOW w AS (PARTITION BY doc_id, page, block, paragraph ORDER BY ord)),
p AS (SELECT *, CASE WHEN behind IS NULL OR (behind LIKE '%-' AND regexp_matches(piece, '^\p{L}')) THEN '' ELSE ' ' END || piece AS part, coalesce(piece LIKE '%-' AND regexp_matches(ahead, '^\p{L}'), false) AS broken FROM l)
SELECT doc_id, page, block, CAST(paragraph AS BIGINT) AS paragraph, min(ord) AS ord, count(*) AS n_lines, median(size) AS size, min(min_x) AS min_x, max(max_x) AS max_x, md5(string_agg(part, '' ORDER BY ord)) AS text_md5, CAST(sum(CASE WHEN broken THEN 1 ELSE 0 END) AS BIGINT) AS hyphens_kept
FROM p GROUP BY doc_id, page, block, paragraph""",
    "table_grids": _L + _RULES + " SELECT doc_id, page, CAST(region AS BIGINT) AS region, CAST(4 AS BIGINT) AS n_rows, CAST(3 AS BIGINT) AS n_cols FROM tops",
    "table_cells": _GT + _RULES + _CELLS + ' SELECT doc_id, page, region, "row", col, text FROM cells',
    "table_confidence": _GT + _RULES + _CELLS + """, c AS (SELECT doc_id, page, region, col, sum(CASE WHEN text <> '' THEN 1 ELSE 0 END) AS n FROM cells GROUP BY ALL),
a AS (SELECT doc_id, page, region, sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS aligned, count(*) AS n_cols FROM c GROUP BY ALL),
t AS (SELECT doc_id, page, region, count(DISTINCT "row") AS n_rows, count(*) AS n, CAST(sum(CASE WHEN text <> '' THEN 1 ELSE 0 END) AS BIGINT) AS filled, sum(CASE WHEN length(text) > 1 THEN 1 ELSE 0 END) AS long_ FROM cells GROUP BY ALL)
SELECT doc_id, page, region, n_rows, n_cols, filled, CASE WHEN aligned >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM t JOIN a USING (doc_id, page, region) WHERE filled >= 0.5 * n AND long_ >= 0.5 * filled AND filled > 0""",
    "footnote_links": _B + _BODY + _NOTES + """, r AS (SELECT doc_id, page, ord, CASE WHEN ord % 2 = 0 THEN '1' ELSE '2' END AS label FROM blocks WHERE cls = 'text' AND ord % 5 = 2)
SELECT r.doc_id, r.page, r.label, r.ord, coalesce(n.note_ord, -1) AS note_ord FROM r LEFT JOIN (SELECT doc_id, page, label, min(ord) AS note_ord FROM notes GROUP BY ALL) n USING (doc_id, page, label)""",
    "crossref_targets": _B + """, r AS (SELECT doc_id, ord AS seq, CAST(page + CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END AS INT) AS target_page, CASE WHEN ord % 4 = 1 THEN NULL ELSE CAST(ord * 37 % 792 AS DOUBLE) END AS target_y FROM blocks WHERE ord % 9 = 4),
j AS (SELECT r.*, b.ord, CASE WHEN b.ord IS NULL THEN NULL WHEN target_y IS NULL THEN 0.0 WHEN target_y < min_y THEN min_y - target_y WHEN target_y <= max_y THEN 0.0 ELSE target_y - max_y + 1e6 END AS gap FROM r LEFT JOIN blocks b ON b.doc_id = r.doc_id AND b.page = r.target_page)
SELECT doc_id, seq, target_page, target_y, coalesce(ord, -1) AS target_ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY gap, ord) AS k FROM j) WHERE k = 1""",
    "markup_columns": r"""WITH h AS (SELECT doc_id, text, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc:' || CAST(doc_id AS VARCHAR))) AS s FROM documents)
SELECT doc_id, md5(replace(replace(replace(replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_md5,
s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || substr('89ab89ab89ab89ab', CAST(strpos('0123456789abcdef', s[17:17]) AS INT), 1) || s[18:20] || '-' || s[21:32] AS uuid FROM h""",
    "page_range": _L + " SELECT doc_id, page, count(*) AS n_lines FROM lines WHERE page BETWEEN 1 AND 5 OR page = 8 OR page >= 11 GROUP BY doc_id, page",
    "style_runs": _G + """, g AS (SELECT *, seq BETWEEN 5 AND 11 AS bold_, seq BETWEEN 9 AND 20 AS italic_, row_number() OVER (PARTITION BY doc_id, page, ord ORDER BY x, seq) - 1 AS at_, count(*) OVER (PARTITION BY doc_id, page, ord) AS n FROM glyphs),
r AS (SELECT doc_id, page, ord, bold_ AS bold, italic_ AS italic, min(at_) AS start, max(at_) + 1 AS "end", max(n) AS n, sum(CASE WHEN regexp_matches(rune, '\\p{L}') THEN 1 ELSE 0 END) AS letters FROM g WHERE bold_ OR italic_ GROUP BY ALL)
SELECT doc_id, page, ord, start, "end", bold, italic FROM r WHERE "end" - start < n AND letters >= 2""",
    "marker_merge": _B + r""", cut AS (SELECT *, text LIKE '1 %' AND min_y > 600 AND ord % 2 = 0 AS parts FROM blocks),
split AS (SELECT doc_id, ord * 2 AS ord, page, CASE WHEN parts THEN substring(text, 3) ELSE text END AS text, size, min_x, min_y FROM cut
  UNION ALL SELECT doc_id, ord * 2 - 1, page, '1', size, min_x, min_y FROM cut WHERE parts),
told AS (SELECT *, regexp_matches(text, '^(?:[0-9]{1,3}|[*†‡])[.)\]]?$') AS lone, len(regexp_extract_all(text, '\p{L}')) >= 8 AS prose, min_y >= 633.6 AS low FROM split),
pairs AS (SELECT *, lone AND low AND lead(prose AND low) OVER w AND lead(page) OVER w = page AND lead(min_x) OVER w >= min_x - 1 AND abs(lead(min_y) OVER w - min_y) < 2 * greatest(size, lead(size) OVER w) AS goes FROM told WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
done AS (SELECT *, lag(goes) OVER w AS takes, lag(text) OVER w AS marker FROM pairs WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, ord, CASE WHEN takes THEN marker || ' ' || text ELSE text END AS text FROM done WHERE NOT coalesce(goes, false)""",
    "inline_figures": _B + _IMAGES + """ SELECT DISTINCT i.doc_id, i.page, i.ord FROM images i JOIN blocks b ON b.doc_id = i.doc_id AND b.page = i.page AND b.n_lines >= 2 AND b.min_y < 206.0 + i.page % 3 * 12 AND b.max_y > 216.0 + i.page % 3 * 12 WHERE i.ord = 0""",
    "upper_medians": _L + ", s AS (SELECT doc_id, page, list_sort(list(n_glyphs)) AS a FROM lines GROUP BY doc_id, page) SELECT doc_id, page, a[len(a) // 2 + 1] AS upper_median FROM s",
    "normalised_text": _L + " SELECT doc_id, ord, rtrim(CASE WHEN contains(text || '  ', '  ') THEN regexp_replace(text || '  ', '[ \\t\\n]+', ' ', 'g') END) AS text FROM lines",
    "small_values": "SELECT doc_id, CAST(CASE WHEN doc_id % 100 = 0 THEN -1 ELSE doc_id % 100 END AS INT) AS value, CAST(epoch(make_timestamp(2021, doc_id % 12 + 1, 15, 10, 30, 0.0)) AS BIGINT) - CASE WHEN doc_id % 2 = 0 THEN 7200 ELSE 0 END AS seconds FROM documents",
    "line_clusters": _G + """, u AS (SELECT doc_id, page, y, count(*) AS n FROM glyphs WHERE rotation <= 5 GROUP BY ALL)
SELECT doc_id, page, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY y) - 1 AS INT) AS line, n, y FROM u""",
    "split_lines": _G + """, d AS (SELECT *, x + CASE WHEN page % 4 = 1 AND x >= 180 THEN 120.0 ELSE 0.0 END AS xx FROM glyphs),
m AS (SELECT doc_id, page, ord, median(advance) AS step FROM d GROUP BY ALL),
g AS (SELECT d.*, step, lag(xx + advance) OVER (PARTITION BY d.doc_id, d.page, d.ord ORDER BY xx, seq) AS fx FROM d JOIN m USING (doc_id, page, ord)),
s AS (SELECT *, sum(CASE WHEN page % 4 = 1 AND 240.0 > fx AND 240.0 < xx AND xx - fx >= 0.5 * step THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, ord ORDER BY xx, seq ROWS UNBOUNDED PRECEDING) AS segment FROM g)
SELECT doc_id, page, ord, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(xx) AS min_x FROM s GROUP BY doc_id, page, ord, segment""",
    "chapter_parts": (_B + _CHAPTERS).replace("WITH ", "WITH RECURSIVE ", 1) + """, s AS (SELECT doc_id, chapter, ord, CAST(floor(strlen(text) * 12 / 10) + 32 AS BIGINT) AS size, row_number() OVER (PARTITION BY doc_id, chapter ORDER BY ord) AS k FROM chapters),
r AS (SELECT doc_id, chapter, ord, k, size AS used, 0 AS part FROM s WHERE k = 1
  UNION ALL SELECT s.doc_id, s.chapter, s.ord, s.k, CASE WHEN r.used > 0 AND r.used + s.size > 3584 THEN s.size ELSE r.used + s.size END, r.part + CASE WHEN r.used > 0 AND r.used + s.size > 3584 THEN 1 ELSE 0 END
  FROM r JOIN s ON s.doc_id = r.doc_id AND s.chapter = r.chapter AND s.k = r.k + 1)
SELECT doc_id, chapter, ord, part FROM r""",
}

_XML = r"""replace(replace(replace(replace(regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""
_KIND_IDS = ORACLE_SQL["block_ids"].replace("encode('paragraph')", "encode(kind)").replace("FROM blocks)", "FROM blocks JOIN kinds USING (doc_id, ord))")
ORACLE_SQL["block_html"] = (
    "WITH kinds AS (" + ORACLE_SQL["block_kinds"] + "), ids AS (" + _KIND_IDS + "), texts AS (" + _B + " SELECT doc_id, ord, text FROM blocks),"
    + r"""
c AS (SELECT t.*, kind, level, block_id, sum(CASE WHEN level BETWEEN 0 AND 2 AND k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS chapter
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM texts) t JOIN kinds USING (doc_id, ord) JOIN ids USING (doc_id, ord)),
o AS (SELECT *, CASE WHEN kind = 'list' THEN NOT regexp_matches(text, '^[•◦▪‣*-]') END AS ordered FROM c WHERE trim(text) <> ''),
n AS (SELECT *, lag(kind) OVER w AS kind_before, lag(ordered) OVER w AS ordered_before, lead(ordered) OVER w AS ordered_after, try_cast(regexp_extract(text, '^\(?([0-9]{1,3})[.)\]]', 1) AS INT) AS number FROM o WINDOW w AS (PARTITION BY doc_id, chapter ORDER BY ord))
SELECT doc_id, ord, CAST(chapter AS BIGINT) AS chapter, CASE kind
  WHEN 'heading' THEN '<h' || least(greatest(level, 1), 6) || ' id="' || block_id || '">' || XML_TEXT || '</h' || least(greatest(level, 1), 6) || '>' || chr(10)
  WHEN 'footnote' THEN '<aside epub:type="footnote" id="' || block_id || '">' || chr(10) || '  <p>' || XML_TEXT || '</p>' || chr(10) || '</aside>' || chr(10)
  WHEN 'code' THEN '<pre><code>' || XML_TEXT || '</code></pre>' || chr(10)
  WHEN 'blockquote' THEN '<blockquote><p>' || XML_TEXT || '</p></blockquote>' || chr(10)
  WHEN 'list' THEN CASE WHEN ordered IS NOT DISTINCT FROM ordered_before THEN '' WHEN NOT ordered THEN '<ul>' || chr(10) WHEN number > 1 THEN '<ol start="' || number || '">' || chr(10) ELSE '<ol>' || chr(10) END
    || '  <li>' || XML_ITEM || '</li>' || chr(10) || CASE WHEN ordered IS NOT DISTINCT FROM ordered_after THEN '' WHEN ordered THEN '</ol>' || chr(10) ELSE '</ul>' || chr(10) END
  ELSE '<p' || CASE WHEN kind_before = 'paragraph' THEN '' ELSE ' class="first"' END || '>' || XML_TEXT || '</p>' || chr(10) END AS html FROM n""".replace("XML_TEXT", _XML.format("text")).replace(
        "XML_ITEM", _XML.format(r"trim(regexp_replace(text, '^(?:[•◦▪‣*-]|\(?(?:[0-9]{1,3}|[ivxlcdm]+|[A-Za-z])[.)\]])[ \t\n]+', ''))")
    )
)
