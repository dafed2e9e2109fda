"""DuckDB SQL with the rows of the registered queries, on the same tables."""

from __future__ import annotations

import re

from marlgate.functions.patterns import CAPTIONS, CHAPTERS, FALLBACK_CHAPTERS, REFERENCE_RULES, SECTIONS
from marlgate.sources.fixtures import EVENTS_SQL, LAYOUTS_SQL, TEXTS_SQL

# The patterns are those of the operators, which the tests hold against hand-made cases; RE2 reads them alike on the fixture's texts.
_NUM = r"(\d+(?:\.\d+)?)"
_RULES = [f"(?i){p}" for p in REFERENCE_RULES]
_CAPTION = f"^(?i:{CAPTIONS[0]})"
_CHAPTER = f"^(?i:{'|'.join(p for p, _ in CHAPTERS)})"
_SECTION = f"^(?i:{'|'.join(SECTIONS)})"


def _first(patterns: list[str], group: int, anchor: str = "^") -> str:
    """A group of the first pattern that has it."""
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{anchor}(?i:{p})', {group}), '')" for p in patterns) + ")"


_CHAPTER_NUMBER, _CHAPTER_TITLE = (_first([p for p, _ in CHAPTERS], g) for g in (1, 2))
_LANGUAGE = "CASE " + " ".join(f"WHEN regexp_matches(text, '^(?i:{p})') THEN '{language}'" for p, language in CHAPTERS) + " END"
_SECTION_NAME = f"{_first(SECTIONS, 1)} || coalesce('.' || {_first(SECTIONS, 2)}, '')"
_SECTION_SUB = f"nullif({_first(SECTIONS, 3)}, '')"
_SECTION_TITLE = f"nullif(trim(CASE WHEN regexp_matches(text, '^(?i:{SECTIONS[0]})') THEN regexp_extract(text, '^(?i:{SECTIONS[0]})', 4) ELSE {_SECTION_SUB} END), '')"
# RE2 has ASCII letters only in \w; the operators have those of all scripts
_FALLBACK = _first([p.replace(r"\w", r"[\p{L}\p{N}_]") for p in FALLBACK_CHAPTERS], 1, "")
_INSIDE = "t.x0 >= l.x0 - {m} AND t.y0 >= l.y0 - {m} AND t.x1 <= l.x1 + {m} AND t.y1 <= l.y1 + {m}"
_TITLED = "EXISTS (SELECT 1 FROM layouts l WHERE l.doc_id = t.doc_id AND l.page_index = t.page_index AND lower(l.label) IN ('title', 'paragraph_title', 'header') AND " + _INSIDE + ")"
# a pattern that is a constant is compiled once
_FOUND = " UNION ALL ".join(f"SELECT *, {k} AS rule, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS ps, regexp_extract_all(text, '{p}', 1) AS one, {f"regexp_extract_all(text, '{p}', 2)" if k == 5 else "NULL"} AS two FROM texts WHERE regexp_matches(text, '{p}')" for k, p in enumerate(_RULES, 1))

_STEPS = f"""
WITH {TEXTS_SQL.replace("{lineitem}", "lineitem")}, {LAYOUTS_SQL},
pages AS (SELECT DISTINCT doc_id, page_index,
  CASE WHEN (doc_id + page_index) % 11 = 0 THEN 'error' WHEN (doc_id + page_index) % 13 = 0 THEN NULL ELSE 'success' END AS status,
  CASE WHEN (doc_id + page_index) % 11 = 0 OR (doc_id + page_index) % 13 = 0 THEN 'failed' END AS error FROM texts),
figures AS (SELECT *, 'fig_' || page_index || '_' || fig_idx AS figure_id0 FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY layout_idx) - 1 AS fig_idx FROM layouts
  WHERE lower(label) IN ('image', 'figure_title', 'chart', 'chart_title', 'header_image', 'footer_image'))),
heads AS (SELECT t.*, t.y0 < 200 AS at_top, (t.y1 - t.y0) > 1.5 * avg(t.y1 - t.y0) OVER (PARTITION BY doc_id, page_index) AS is_tall,
  NOT EXISTS (SELECT 1 FROM texts o WHERE o.doc_id = t.doc_id AND o.page_index = t.page_index AND o.text_idx <> t.text_idx
    AND abs((o.y0 + o.y1) / 2 - (t.y0 + t.y1) / 2) < (t.y1 - t.y0) / 2) AS is_isolated, {_TITLED.format(m=5)} AS is_title FROM texts t),
judged AS (SELECT *, at_top OR is_tall OR is_isolated AS is_heading, regexp_matches(text, '{_CHAPTER}') AND (is_title OR at_top OR is_tall OR is_isolated) AS is_chapter,
  regexp_matches(text, '{_SECTION}') AS like_section FROM heads),
structure AS (SELECT p.doc_id, p.page_index,
  max(CASE WHEN text_idx = ci THEN CAST({_CHAPTER_NUMBER} AS INTEGER) END) AS chapter,
  max(CASE WHEN text_idx = si THEN {_SECTION_NAME} END) AS section,
  max(CASE WHEN text_idx = si THEN {_SECTION_SUB} END) AS subsection,
  max(CASE WHEN text_idx = ci THEN nullif(trim({_CHAPTER_TITLE}), '') END) AS title,
  max(CASE WHEN text_idx = ci THEN {_LANGUAGE} END) AS language
  FROM pages p LEFT JOIN (SELECT *, max(text_idx) FILTER (WHERE is_chapter) OVER (PARTITION BY doc_id, page_index) AS ci,
    max(text_idx) FILTER (WHERE like_section AND is_title AND NOT is_chapter) OVER (PARTITION BY doc_id, page_index) AS si FROM judged) j USING (doc_id, page_index)
  GROUP BY p.doc_id, p.page_index),
carried AS (SELECT doc_id, page_index, c.chapter AS carried_chapter, c.section AS carried_section FROM (
  SELECT doc_id, page_index, last_value(CASE WHEN chapter IS NOT NULL THEN struct_pack(chapter := chapter, section := section) END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM structure)),
pairs AS (SELECT f.doc_id, f.page_index, f.fig_idx, t.text_idx, t.text, t.x0 AS tx0, t.y0 AS ty0, t.x1 AS tx1, t.y1 AS ty1, f.x0 AS fx0, f.y0 AS fy0, f.x1 AS fx1, f.y1 AS fy1
  FROM figures f JOIN texts t USING (doc_id, page_index)),
scored AS (SELECT *, CASE WHEN ty0 > fy1 OR ty1 < fy0 THEN greatest(0, 1 - abs((fx0 + fx1) / 2 - (tx0 + tx1) / 2) / (fx1 - fx0)) * 0.7
    + greatest(0, 1 - (CASE WHEN ty0 > fy1 THEN ty0 - fy1 ELSE fy0 - ty1 END) / 100) * 0.3 ELSE 0 END AS score FROM pairs WHERE regexp_matches(text, '{_CAPTION}')),
captions AS (SELECT *, CAST(regexp_extract(text, '{_CAPTION}', 1) AS INTEGER) AS figure_number, nullif(trim(regexp_extract(text, '{_CAPTION}', 2)), '') AS title FROM scored WHERE score > 0.5
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, fig_idx ORDER BY score DESC, text_idx) = 1),
below AS (SELECT doc_id, page_index, fig_idx, text_idx, ty0 - fy1 AS distance,
  CAST(coalesce(nullif(regexp_extract(text, '(?i)Fig(?:ure)?\\.?\\s*(\\d+)', 1), ''), nullif(regexp_extract(text, '그림\\s*(\\d+)', 1), '')) AS INTEGER) AS figure_number FROM pairs
  WHERE ty0 > fy1 AND ty0 - fy1 < 50 AND (least(fx1, tx1) - greatest(fx0, tx0)) / least(fx1 - fx0, tx1 - tx0) > 0.5
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, fig_idx ORDER BY ty0 - fy1, text_idx) = 1),
named AS (SELECT f.*, c.text AS caption, c.figure_number, s.chapter, s.section,
  CASE WHEN c.figure_number <> 0 AND s.chapter <> 0 THEN 'ch' || s.chapter || '_fig' || c.figure_number WHEN c.figure_number <> 0 THEN 'fig_' || c.figure_number ELSE f.figure_id0 END AS figure_id
  FROM figures f LEFT JOIN captions c USING (doc_id, page_index, fig_idx) LEFT JOIN structure s USING (doc_id, page_index)),
numbered AS (SELECT n.doc_id, n.page_index, n.fig_idx, n.figure_id, n.caption, r.carried_chapter AS chapter, r.carried_section AS section,
  coalesce(nullif(n.figure_number, 0), nullif(b.figure_number, 0)) AS figure_number
  FROM named n LEFT JOIN below b USING (doc_id, page_index, fig_idx) LEFT JOIN carried r USING (doc_id, page_index)),
keyed AS (SELECT *, CASE WHEN chapter <> 0 THEN 'ch' || chapter || '_fig' || figure_number ELSE 'fig_' || figure_number END AS registry_key,
  page_index * 1000000 + fig_idx AS pos FROM numbered WHERE figure_number IS NOT NULL),
placed AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, registry_key) AS first_pos, max(pos) OVER (PARTITION BY doc_id, registry_key) AS last_pos FROM keyed),
registry AS (SELECT doc_id, registry_key, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) - 1 AS ord, figure_id, figure_number, chapter, section, page_index, caption FROM placed WHERE pos = last_pos),
by_chapter AS (SELECT * FROM registry WHERE chapter IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, chapter, figure_number ORDER BY CASE WHEN registry_key = 'ch' || chapter || '_fig' || figure_number THEN 0 ELSE 1 END, ord) = 1),
by_number AS (SELECT * FROM registry QUALIFY row_number() OVER (PARTITION BY doc_id, figure_number ORDER BY CASE WHEN registry_key = 'fig_' || figure_number THEN 0 ELSE 1 END, ord) = 1),
by_position AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(chapter, 0), page_index, ord) AS n FROM registry),
found AS ({_FOUND}),
scan AS (SELECT doc_id, page_index, text_idx, text_id, x0, y0, x1, y1, text AS full_text, rule, part, ms[i] AS mention,
  CAST(list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0) AS BIGINT) AS start_pos,
  CAST(floor(CAST((CASE part WHEN 1 THEN one ELSE two END)[i] AS DOUBLE)) AS BIGINT) AS figure_number
  FROM found, unnest(range(1, len(ms) + 1)) AS r(i), (VALUES (1), (2)) AS q(part) WHERE part = 1 OR rule = 5),
refs AS (SELECT *, start_pos + length(mention) AS end_pos, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY text_idx, rule, start_pos, part) - 1 AS ref_idx FROM scan),
looked AS (SELECT r.*, o.carried_chapter AS own, CASE WHEN r.figure_number <> 0 THEN CASE WHEN a.doc_id IS NOT NULL THEN 'chapter' WHEN b.doc_id IS NOT NULL THEN 'global' WHEN c.doc_id IS NOT NULL THEN 'positional' ELSE 'unmapped' END ELSE 'zero' END AS tier,
  struct_pack(id := a.figure_id, page := a.page_index, chapter := a.chapter, caption := a.caption) AS fa, struct_pack(id := b.figure_id, page := b.page_index, chapter := b.chapter, caption := b.caption) AS fb,
  struct_pack(id := c.figure_id, page := c.page_index, chapter := c.chapter, caption := c.caption) AS fc
  FROM refs r LEFT JOIN carried o USING (doc_id, page_index)
  LEFT JOIN by_chapter a ON a.doc_id = r.doc_id AND a.figure_number = r.figure_number AND a.chapter = o.carried_chapter
  LEFT JOIN by_number b ON b.doc_id = r.doc_id AND b.figure_number = r.figure_number
  LEFT JOIN by_position c ON c.doc_id = r.doc_id AND c.n = r.figure_number),
chosen AS (SELECT *, CASE tier WHEN 'chapter' THEN fa WHEN 'global' THEN fb WHEN 'positional' THEN fc END AS f FROM looked),
mapped AS (SELECT *, f.id AS mapped_figure_id, f.page AS mapped_figure_page, f.chapter AS mapped_chapter,
  CASE WHEN tier = 'zero' THEN NULL WHEN tier = 'unmapped' THEN 0.0 ELSE greatest(0.0, least(1.0, CAST(0.5 AS DOUBLE) + CASE WHEN own = f.chapter THEN CAST(0.3 AS DOUBLE) ELSE 0.0 END + CASE WHEN f.caption <> '' THEN CAST(0.2 AS DOUBLE) ELSE 0.0 END
    - abs(page_index - f.page) * CASE WHEN own IS NOT DISTINCT FROM f.chapter THEN CAST(0.02 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END)) END AS mapping_confidence FROM chosen),
firsts AS (SELECT t.*, coalesce(mention, trim(text)) AS reference_text, coalesce(start_pos, 0) AS start_pos, coalesce(start_pos + length(mention), length(text)) AS end_pos, number AS first_number
  FROM texts t LEFT JOIN (SELECT doc_id, page_index, text_idx, arg_min(mention, rule * 1000000 + start_pos) AS mention, arg_min(start_pos, rule * 1000000 + start_pos) AS start_pos,
    arg_min(figure_number, rule * 1000000 + start_pos) AS number FROM scan WHERE part = 1 GROUP BY ALL) USING (doc_id, page_index, text_idx)),
shown AS (SELECT doc_id, page_index FROM pages WHERE status IS DISTINCT FROM 'error'),
ref_counts AS (SELECT doc_id, mapped_figure_id, count(*) AS reference_count FROM mapped WHERE mapped_figure_id <> '' GROUP BY ALL),
shown_counts AS (SELECT doc_id, mapped_figure_id AS figure_id, count(*) AS reference_count FROM mapped JOIN shown USING (doc_id, page_index) WHERE mapped_figure_id <> '' GROUP BY ALL),
counts AS (SELECT p.*, coalesce(nl, 0) AS n_layouts, coalesce(nf, 0) AS n_figures, coalesce(nt, 0) AS n_texts, coalesce(nr, 0) AS n_refs FROM pages p
  LEFT JOIN (SELECT doc_id, page_index, count(*) AS nl FROM layouts GROUP BY ALL) USING (doc_id, page_index)
  LEFT JOIN (SELECT doc_id, page_index, count(*) AS nf FROM figures GROUP BY ALL) USING (doc_id, page_index)
  LEFT JOIN (SELECT doc_id, page_index, count(*) AS nt FROM texts GROUP BY ALL) USING (doc_id, page_index)
  LEFT JOIN (SELECT doc_id, page_index, count(*) AS nr FROM refs GROUP BY ALL) USING (doc_id, page_index)),
chapters AS (SELECT doc_id, carried_chapter AS chapter, min(page_index) AS start_page, max(page_index) AS end_page,
  coalesce(string_agg(DISTINCT carried_section, '|' ORDER BY carried_section), '') AS sections FROM carried WHERE carried_chapter <> 0 GROUP BY ALL),
figure_rows AS (SELECT n.*, page_index * 1000000 + fig_idx AS pos FROM named n JOIN shown USING (doc_id, page_index)),
figure_list AS (SELECT f.*, coalesce(reference_count, 0) AS reference_count FROM figure_rows f LEFT JOIN shown_counts USING (doc_id, figure_id)
  QUALIFY pos = max(pos) OVER (PARTITION BY doc_id, figure_id)),
width AS (SELECT *, (x1 - x0) / length(full_text) AS cw FROM mapped),
boxed AS (SELECT *, greatest(x0, x0 + start_pos * cw - cw * 0.1) AS bx0, y0 - (y1 - y0) * 0.05 AS by0, least(x1, x0 + end_pos * cw + cw * 0.1) AS bx1, y1 + (y1 - y0) * 0.05 AS by1 FROM width),
ref_boxes AS (SELECT doc_id, page_index, greatest(x0, x0 + start_pos * cw - cw * 0.1) AS bx0, y0 - (y1 - y0) * 0.05 AS by0, least(x1, x0 + end_pos * cw + cw * 0.1) AS bx1, y1 + (y1 - y0) * 0.05 AS by1
  FROM (SELECT *, (x1 - x0) / length(full_text) AS cw FROM refs)),
elements AS (SELECT doc_id, page_index, 0 AS kind_ord, text_idx AS place, 'text' AS type, text, NULL AS figure_id, NULL AS figure_caption, NULL AS related_chapter, NULL AS related_section, NULL AS figure_number,
    NULL AS referenced_figure_id, NULL AS reference_text, CAST(NULL AS DOUBLE) AS confidence, x0 AS bx0, y0 AS by0, x1 AS bx1, y1 AS by1 FROM texts JOIN shown USING (doc_id, page_index)
  UNION ALL SELECT doc_id, page_index, 1, fig_idx, 'figure', NULL, figure_id, caption, chapter, section, figure_number, NULL, NULL, NULL, x0, y0, x1, y1 FROM named JOIN shown USING (doc_id, page_index)
  UNION ALL SELECT doc_id, page_index, 2, ref_idx, 'figure_reference', NULL, NULL, NULL, NULL, NULL, figure_number, mapped_figure_id, mention, mapping_confidence, bx0, by0, bx1, by1 FROM boxed JOIN shown USING (doc_id, page_index)),
full_texts AS (SELECT doc_id, page_index, trim(string_agg(text, ' ' ORDER BY text_idx)) AS full_text FROM texts GROUP BY ALL),
events_in AS ({EVENTS_SQL.replace("{events}", "events")}),
state AS (SELECT task_id, arg_max(status, struct_pack(ts := ts, id := event_id)) AS status, arg_max(current_page, struct_pack(ts := ts, id := event_id)) AS current_page,
  arg_max(total_pages, struct_pack(ts := ts, id := event_id)) AS total_pages, arg_max(progress, struct_pack(ts := ts, id := event_id)) AS progress, max(ts) AS last_update FROM events_in GROUP BY task_id)
"""
_PAGE, _TEXT, _FIG = "doc_id, page_index", "doc_id, page_index, text_idx", "doc_id, page_index, fig_idx"
_SCAN = f"SELECT {_TEXT}, rule, part, mention AS text, start_pos, end_pos, figure_number FROM refs WHERE rule = "
_COLORS = "CASE lower(label) WHEN 'text' THEN '0,255,0' WHEN 'title' THEN '255,0,255' WHEN 'paragraph_title' THEN '255,128,0' WHEN 'figure' THEN '255,0,0' WHEN 'table' THEN '0,255,255' WHEN 'abstract' THEN '128,128,255' WHEN 'header' THEN '255,128,255' ELSE '255,255,255' END"
_PIXELS = ", ".join(f"CAST(trunc({c} * 1.5) AS INTEGER) AS {c}" for c in ("x0", "y0", "x1", "y1"))
_QUARTER = _PIXELS.replace("1.5", "0.25")
_REF_PIXELS = ", ".join(f"CAST(trunc(b{c} * 1.5) AS INTEGER) AS {c}" for c in ("x0", "y0", "x1", "y1"))
_BOX = ", ".join(f"round({c}, 6) AS {c}" for c in ("bx0", "by0", "bx1", "by1"))

_SELECTS = {
    "figure_layout_filter": f"SELECT {_FIG}, layout_idx, label, figure_id0 AS figure_id, x0, y0 FROM figures",
    "text_region_filter": f"SELECT {_PAGE}, layout_idx, label FROM layouts WHERE lower(label) IN ('text', 'paragraph_title', 'abstract', 'content', 'reference', 'doc_title', 'footnote', 'header', 'aside_text')",
    "title_containment": f"SELECT {_TEXT}, text FROM heads WHERE is_title",
    "title_containment_exact": f"SELECT {_TEXT} FROM texts t WHERE {_TITLED.format(m=0)}",
    "heading_heuristic": f"SELECT {_TEXT}, at_top, is_tall, is_isolated, is_heading FROM judged",
    "chapter_extract": f"SELECT {_PAGE}, chapter, title, language FROM structure",
    "chapter_match": f"SELECT {_TEXT}, CAST({_CHAPTER_NUMBER} AS INTEGER) AS chapter, nullif(trim({_CHAPTER_TITLE}), '') AS title, {_LANGUAGE} AS language FROM texts WHERE regexp_matches(text, '{_CHAPTER}')",
    "section_extract": f"SELECT {_TEXT}, {_SECTION_NAME} AS section, {_SECTION_SUB} AS subsection, {_SECTION_TITLE} AS title FROM texts WHERE regexp_matches(text, '{_SECTION}')",
    "page_structure": "SELECT * FROM structure",
    "chapter_fill_forward": "SELECT * FROM carried",
    "chapter_fallback": f"""SELECT {_PAGE}, CAST(split_part(n, '.', 1) AS INTEGER) AS chapter, nullif(substr(n, length(split_part(n, '.', 1)) + 2), '') AS section FROM (
      SELECT *, {_FALLBACK} AS n FROM texts t WHERE {_TITLED.format(m=0).replace("lower(l.label)", "l.label")})
      WHERE n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY text_idx) = 1""",
    "box_normalize": f"""SELECT {_TEXT}, coalesce(len(b), 0) AS n, b[1] AS bx0, b[2] AS by0, b[3] AS bx1, b[4] AS by1 FROM (SELECT *, CASE WHEN kind % 3 = 0 THEN [least(x0, x1), least(y0, y1), greatest(x0, x1), greatest(y0, y1 + k)]
      WHEN kind % 3 = 1 THEN [x0, y0, x1, y1] END AS b FROM texts)""",
    "first_mention": f"SELECT {_TEXT}, reference_text, start_pos, end_pos FROM firsts",
    "mention_surroundings": f"SELECT {_TEXT}, trim(substr(text, CAST(greatest(0, start_pos - 10) AS BIGINT) + 1, CAST(least(length(text), end_pos + 10) - greatest(0, start_pos - 10) AS BIGINT))) AS surroundings FROM firsts",
    "number_or_guess": f"SELECT {_TEXT}, coalesce(first_number, CASE WHEN text_idx % 7 - 1.5 > 0 THEN CAST(round_even(text_idx % 7 - 1.5, 0) AS BIGINT) END) AS figure_number FROM firsts",
    "mention_page_context": f"SELECT {_PAGE}, ref_idx, chapter, section FROM refs JOIN structure USING (doc_id, page_index)",
    "display_nested_chapters": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chapter) - 1 AS place, 'Chapter ' || chapter AS title, chapter AS chapter_number, start_page, end_page, sections FROM chapters",
    "display_nested_pages": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1 AS place, page_index, CASE WHEN chapter <> 0 THEN CAST(chapter AS VARCHAR) END AS chapter, section,
      coalesce(full_text, '') AS full_text, 600 AS width, 2000 AS height FROM shown JOIN structure USING (doc_id, page_index) LEFT JOIN full_texts USING (doc_id, page_index)""",
    "display_nested_layouts": f"""SELECT {_PAGE}, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY kind_ord, place) - 1 AS place, type, text, figure_id, figure_caption, related_chapter, related_section, figure_number,
      referenced_figure_id, reference_text, {_BOX} FROM elements""",
    "display_nested_figures": f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) - 1 AS place, figure_id, page_index, caption, reference_count, x0 AS bx0, y0 AS by0, x1 AS bx1, y1 AS by1
      FROM figure_list JOIN (SELECT doc_id, figure_id, min(pos) AS first_pos FROM figure_rows GROUP BY ALL) USING (doc_id, figure_id)""",
    "raw_nested_references": f"SELECT {_PAGE}, ref_idx, mention AS text, text_id, figure_number, start_pos, end_pos, chapter, section, mapped_figure_id FROM mapped JOIN structure USING (doc_id, page_index)",
    "raw_default_ids": f"SELECT {_FIG}, figure_id0 AS figure_id FROM figures",
    "raw_page_fallback": f"SELECT {_PAGE}, fig_idx AS place, nullif(s.chapter, 0) AS related_chapter, s.section AS related_section FROM figures JOIN shown USING (doc_id, page_index) JOIN structure s USING (doc_id, page_index)",
    "detect_recognise": f"""SELECT {_PAGE}, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY text_idx) - 1 AS text_idx, 'text_' || text_idx AS text_id, concat_ws(',', cx0, cy0, cx1, cy1) AS text, CAST(0.5 AS DOUBLE) AS det_score, NULL AS error FROM (
      SELECT {_TEXT}, CAST(greatest(0, floor(x0)) AS INTEGER) AS cx0, CAST(greatest(0, floor(y0)) AS INTEGER) AS cy0, CAST(least(450, floor(x1)) AS INTEGER) AS cx1, CAST(least(300, floor(y1)) AS INTEGER) AS cy1 FROM texts
      QUALIFY count(*) OVER (PARTITION BY doc_id, page_index) % 7 <> 6) WHERE cx1 > cx0 AND cy1 > cy0
      UNION ALL SELECT {_PAGE}, NULL, NULL, NULL, NULL, 'cannot read a page of ' || count(*) FROM texts GROUP BY doc_id, page_index HAVING count(*) % 7 = 6""",
    "failed_pages": f"""SELECT {_PAGE}, CASE WHEN n % 7 = 6 THEN 'error' ELSE status END AS status, CASE WHEN n % 7 = 6 THEN 'cannot read a page of ' || n ELSE error END AS error
      FROM pages JOIN (SELECT doc_id, page_index, count(*) AS n FROM texts GROUP BY ALL) USING (doc_id, page_index)""",
    "page_position": "SELECT * FROM full_texts WHERE page_index % 2 = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_index) = 2",
    "page_bounds": """SELECT doc_id, doc_id % 14 AS page, CASE WHEN doc_id % 14 NOT BETWEEN 1 AND n THEN 'no page ' || doc_id % 14 || ': the document has pages 1 to ' || n END AS error
      FROM (SELECT doc_id, count(*) AS n FROM pages GROUP BY doc_id)""",
    "job_last_lines": """SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY event_id) - 1 AS place, event_id, type FROM (
      SELECT * FROM events_in QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY event_id DESC) <= 8)""",
    "caption_best_match": f"SELECT {_FIG}, text_idx, text AS caption, figure_number, title, round(score, 6) AS score, tx0 AS bx0, ty0 AS by0, tx1 AS bx1, ty1 AS by1 FROM captions",
    "caption_nearest_below": f"SELECT {_FIG}, text_idx, round(distance, 6) AS distance, figure_number FROM below",
    "figure_ids": f"SELECT {_FIG}, figure_id, figure_number, chapter, section, caption FROM named",
    "reference_scan_all": f"SELECT {_TEXT}, ref_idx, rule, part, mention AS text, start_pos, end_pos, figure_number, 'rule_based' AS method, CAST(0.95 AS DOUBLE) AS confidence FROM refs",
    "figure_number_parse": f"SELECT {_TEXT}, g, CAST(floor(CAST(g AS DOUBLE)) AS BIGINT) AS figure_number FROM (SELECT *, unnest(regexp_extract_all(text, '{_NUM}', 1)) AS g FROM texts)",
    "word_bbox": f"SELECT {_TEXT}, ref_idx, {_BOX} FROM boxed",
    "reference_context": f"SELECT {_TEXT}, ref_idx, substr(full_text, greatest(0, start_pos - 50) + 1, least(length(full_text), end_pos + 50) - greatest(0, start_pos - 50)) AS context, full_text FROM refs",
    "registry_upsert": "SELECT * FROM registry",
    "lookup_chapter": "SELECT doc_id, chapter, figure_number, registry_key, figure_id FROM by_chapter",
    "lookup_global": "SELECT doc_id, figure_number, registry_key, figure_id FROM by_number",
    "lookup_positional": "SELECT doc_id, n, registry_key, figure_id FROM by_position",
    "map_references": f"SELECT {_PAGE}, ref_idx, text_id, mention AS ref_text, figure_number, tier, mapped_figure_id, mapped_figure_page, mapped_chapter, round(mapping_confidence, 6) AS mapping_confidence FROM mapped",
    "mapping_confidence": "SELECT tier, round(mapping_confidence, 6) AS mapping_confidence, count(*) AS n FROM mapped WHERE mapping_confidence IS NOT NULL GROUP BY ALL",
    "doc_summary": """SELECT doc_id, total_pages, total_layouts, total_figures, total_texts, total_refs, error_pages, round((total_pages - error_pages) / total_pages * 100, 6) AS success_rate FROM (
      SELECT doc_id, count(*) AS total_pages, CAST(sum(CASE WHEN ok THEN n_layouts ELSE 0 END) AS BIGINT) AS total_layouts, CAST(sum(CASE WHEN ok THEN n_figures ELSE 0 END) AS BIGINT) AS total_figures,
      CAST(sum(CASE WHEN ok THEN n_texts ELSE 0 END) AS BIGINT) AS total_texts, CAST(sum(CASE WHEN ok THEN n_refs ELSE 0 END) AS BIGINT) AS total_refs, count(*) FILTER (WHERE NOT ok) AS error_pages
      FROM (SELECT *, status IS DISTINCT FROM 'error' AS ok FROM counts) GROUP BY doc_id)""",
    "chapter_summary": "SELECT c.*, coalesce(n, 0) AS figure_count FROM chapters c LEFT JOIN (SELECT doc_id, chapter, count(*) AS n FROM registry GROUP BY ALL) USING (doc_id, chapter)",
    "reference_counts": "SELECT * FROM ref_counts",
    "display_figures": "SELECT doc_id, figure_id, figure_number, page_index, chapter, section, caption, x0 AS bx0, y0 AS by0, x1 AS bx1, y1 AS by1, x1 - x0 AS width, y1 - y0 AS height, (x1 - x0) * (y1 - y0) AS area, reference_count, reference_count > 0 AS is_referenced FROM figure_list",
    "display_layouts": f"SELECT {_PAGE}, kind_ord, place, type, text, figure_id, figure_caption, related_chapter, figure_number, referenced_figure_id, reference_text, round(confidence, 6) AS confidence, {_BOX} FROM elements",
    "display_documents": """SELECT doc_id, coalesce(a.n, 0) AS n_chapters, coalesce(b.n, 0) AS n_pages, coalesce(c.n, 0) AS n_layouts, coalesce(b.s, 0) AS n_chars, coalesce(d.n, 0) AS n_figures, coalesce(d.n, 0) AS total_figures
      FROM (SELECT DISTINCT doc_id FROM pages) LEFT JOIN (SELECT doc_id, count(*) AS n FROM chapters GROUP BY ALL) a USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS n, CAST(sum(length(full_text)) AS BIGINT) AS s FROM shown JOIN full_texts USING (doc_id, page_index) GROUP BY ALL) b USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM elements GROUP BY ALL) c USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM figure_list GROUP BY ALL) d USING (doc_id)""",
    "raw_documents": """SELECT doc_id, total_pages, n_layouts, n_figures, n_texts, n_refs, coalesce(n, 0) AS n_chapters, error_pages FROM (
      SELECT doc_id, count(*) AS total_pages, CAST(sum(n_layouts) AS BIGINT) AS n_layouts, CAST(sum(n_figures) AS BIGINT) AS n_figures, CAST(sum(n_texts) AS BIGINT) AS n_texts, CAST(sum(n_refs) AS BIGINT) AS n_refs,
      count(*) FILTER (WHERE status = 'error') AS error_pages FROM counts GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM chapters GROUP BY doc_id) USING (doc_id)""",
    "page_full_text": "SELECT * FROM full_texts",
    "mapping_rate": "SELECT doc_id, count(*) AS total_refs, count(*) FILTER (WHERE mapped_figure_id <> '') AS mapped_refs, count(*) FILTER (WHERE coalesce(mapped_figure_id, '') = '') AS unmapped_refs, round(count(*) FILTER (WHERE mapped_figure_id <> '') / count(*) * 100, 6) AS mapping_rate FROM mapped GROUP BY doc_id",
    "layout_type_counts": "SELECT doc_id, count(*) FILTER (WHERE type = 'text') AS texts, count(*) FILTER (WHERE type = 'figure') AS figures, count(*) FILTER (WHERE type = 'figure_reference') AS figure_references FROM elements GROUP BY doc_id",
    "page_lookup": "SELECT * FROM full_texts WHERE page_index = 3",
    "page_range": f"SELECT {_PAGE}, n_layouts, n_figures, n_texts, n_refs FROM counts WHERE page_index BETWEEN 1 AND 3",
    "page_report": f"SELECT {_PAGE}, substr(full_text, 1, 50) AS full_text FROM full_texts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_index) <= 5",
    "pdf_chunks": "SELECT doc_id, s // 10 AS chunk_id, s + 1 AS start_page, least(s + 10, n) AS end_page FROM (SELECT doc_id, count(*) AS n FROM texts GROUP BY doc_id), unnest(range(0, n, 10)) AS r(s)",
    "merge_rule_model": f"""SELECT {_PAGE}, text_id, origin, ref_idx, figure_number, start_pos, method, round(final_confidence, 6) AS final_confidence,
      row_number() OVER (PARTITION BY doc_id, page_index ORDER BY final_confidence DESC, origin, ref_idx) - 1 AS place FROM (
      WITH one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY text_idx, start_pos, part) - 1 AS r FROM scan WHERE rule = 1),
      model AS (SELECT doc_id, page_index, text_id, text_idx * 3 + j AS mi, j, j * 15 AS s, CASE WHEN kind = 2 THEN k + 1 ELSE k END AS n, CAST((doc_id * 31 + text_idx + j * 17) % 100 AS DOUBLE) / 100.0 AS c FROM texts, (VALUES (0), (1), (2)) AS v(j) WHERE kind IN (1, 2, 4)),
      hit AS (SELECT m.doc_id, m.page_index, m.mi, m.j, m.s, m.text_id, m.n, m.c, min(o.r) AS r FROM model m LEFT JOIN one o ON o.doc_id = m.doc_id AND o.page_index = m.page_index AND o.text_id = m.text_id AND o.figure_number = m.n AND abs(o.start_pos - m.s) < 20 GROUP BY ALL),
      up AS (SELECT doc_id, page_index, r, max(c) AS c FROM hit WHERE r IS NOT NULL GROUP BY ALL),
      alone AS (SELECT a.*, b.c AS near_c, z.mi IS NOT NULL AS follows FROM hit a LEFT JOIN hit b ON a.j = 0 AND b.mi = a.mi + 1 AND b.doc_id = a.doc_id AND b.page_index = a.page_index AND b.r IS NULL
        LEFT JOIN hit z ON a.j = 1 AND z.mi = a.mi - 1 AND z.doc_id = a.doc_id AND z.page_index = a.page_index AND z.r IS NULL WHERE a.r IS NULL)
      SELECT o.doc_id, o.page_index, text_id, 0 AS origin, o.r AS ref_idx, figure_number, start_pos, CASE WHEN up.c > 0.95 THEN 'hybrid' ELSE 'rule_based' END AS method, CASE WHEN up.c > 0.95 THEN up.c ELSE CAST(0.95 AS DOUBLE) END AS final_confidence
        FROM one o LEFT JOIN up ON up.doc_id = o.doc_id AND up.page_index = o.page_index AND up.r = o.r
      UNION ALL SELECT doc_id, page_index, text_id, 1, mi, n, s, CASE WHEN near_c > c * CAST(0.9 AS DOUBLE) THEN 'hybrid' ELSE 'model' END, greatest(c * CAST(0.9 AS DOUBLE), coalesce(near_c, CAST(0 AS DOUBLE))) FROM alone
        WHERE NOT follows)""",
    "job_status": """SELECT task_id, status, CASE WHEN status = 'processing' THEN progress END AS progress, CASE WHEN status = 'processing' THEN current_page END AS current_page,
      CASE WHEN status = 'completed' THEN '/result/' || task_id END AS result_url, CASE WHEN status = 'failed' THEN 'failed' END AS error FROM state""",
    "job_state": "SELECT task_id, status, current_page, total_pages, round(progress, 6) AS progress, epoch_us(last_update) AS last_micros FROM state",
    "job_progress": """SELECT task_id, event_id, type, round(CAST(current_page AS DOUBLE) / total_pages * 100, 6) AS percent, type <> 'progress' AS is_final FROM (
      SELECT *, coalesce(sum(CASE WHEN type = 'progress' THEN 0 ELSE 1 END) OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
      FROM events_in WHERE type IN ('progress', 'completed', 'error')) WHERE ended = 0""",
    "job_result_access": "SELECT c_custkey AS task_id, CASE WHEN status IS NULL THEN 404 WHEN status <> 'completed' THEN 400 WHEN c_custkey % 2 <> 0 THEN 404 ELSE 200 END AS code FROM customer LEFT JOIN state ON task_id = c_custkey",
    "job_speed": "SELECT task_id, max(current_page) AS pages, round(CASE WHEN max(ts) > min(ts) THEN max(current_page) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) ELSE 0.0 END, 6) AS pages_per_second FROM events_in GROUP BY task_id",
    "job_running_totals": f"SELECT {_PAGE}, " + ", ".join(f"CAST(sum(CASE WHEN error IS NULL THEN n_{c} ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far_{c}" for c in ("figures", "refs", "texts")) + " FROM counts",
    "overlay_primitives": f"""SELECT {_PAGE}, 0 AS kind, layout_idx AS place, {_PIXELS}, label || ' (' || printf('%.2f', score) || ')' AS label, {_COLORS} AS color FROM layouts
      UNION ALL SELECT {_PAGE}, 1, text_idx, {_PIXELS}, CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '...' ELSE text END, '0,255,0' FROM texts
      UNION ALL SELECT {_PAGE}, 2, ref_idx, {_REF_PIXELS}, 'REF: ' || mention || CASE WHEN mapped_figure_id <> '' THEN ' -> ' || mapped_figure_id ELSE '' END, CASE WHEN mapped_figure_id <> '' THEN '0,255,0' ELSE '0,0,255' END FROM boxed""",
    "overlay_legend": """SELECT doc_id, page_index, place, label, CAST(600 - doc_id % 5 * 100 - 250 AS INTEGER) AS x, CAST(50 + 20 * place AS INTEGER) AS y, color FROM pages, (VALUES (0, 'Text', '0,255,0'), (1, 'Title', '255,0,255'), (2, 'Paragraph Title', '255,128,0'), (3, 'Figure', '255,0,0'),
      (4, 'Table', '0,255,255'), (5, 'Formula', '255,255,0'), (6, 'List', '128,255,128'), (7, 'Abstract', '128,128,255')) AS v(place, label, color) WHERE 600 - doc_id % 5 * 100 >= 260""",
    "overlay_images": f"""SELECT {_PAGE}, 150 AS width, 500 AS height, coalesce(n, 0) AS drawn, NULL AS error FROM pages LEFT JOIN (SELECT doc_id, page_index, count(*) AS n FROM (
      SELECT {_PAGE}, {_QUARTER} FROM layouts UNION ALL SELECT {_PAGE}, {_QUARTER} FROM texts UNION ALL SELECT {_PAGE}, {_QUARTER.replace("trunc(x", "trunc(bx").replace("trunc(y", "trunc(by")} FROM ref_boxes)
      WHERE x1 >= x0 AND y1 >= y0 AND x1 >= 0 AND y1 >= 0 AND x0 < 150 AND y0 < 500 GROUP BY ALL) USING (doc_id, page_index)""",
    "page_store": f"""SELECT {_PAGE}, n + CASE WHEN page_index % 3 = 0 THEN 1000 WHEN page_index % 2 = 0 THEN 100 ELSE 0 END AS n_texts, CASE WHEN page_index % 3 = 0 THEN 'third' WHEN page_index % 2 = 0 THEN 'second' ELSE 'first' END AS note
      FROM (SELECT {_PAGE}, count(*) AS n FROM texts GROUP BY ALL)""",
    "result_files": """SELECT doc_id, coalesce(a.n, 0) AS n_chapters, coalesce(b.n, 0) AS n_pages, coalesce(d.n, 0) AS n_figures FROM (SELECT DISTINCT doc_id FROM pages)
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM chapters GROUP BY ALL) a USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM shown GROUP BY ALL) b USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM figure_list GROUP BY ALL) d USING (doc_id)""",
    "job_client_view": """SELECT * FROM (WITH clients AS (SELECT event_id AS client_id, task_id AS task, ts AS joined FROM events_in WHERE event_id % 7 = 3),
      seen AS (SELECT client_id, joined, e.*, struct_pack(ts := ts, id := event_id) AS place_in FROM clients JOIN events_in e ON task_id = task),
      past AS (SELECT client_id, task_id, arg_max(status, place_in) AS status, arg_max(progress, place_in) AS progress FROM seen WHERE ts <= joined GROUP BY ALL),
      later AS (SELECT seen.*, coalesce(sum(CASE WHEN type = 'progress' THEN 0 ELSE 1 END) OVER (PARTITION BY client_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
        FROM seen WHERE ts > joined AND type IN ('progress', 'completed', 'error') AND client_id NOT IN (SELECT client_id FROM past WHERE status IN ('completed', 'failed', 'cancelled')))
      SELECT client_id, task_id, 0 AS place, NULL AS event_id, 'snapshot' AS type, round(coalesce(progress, 0), 6) AS percent, status, coalesce(status IN ('completed', 'failed', 'cancelled'), false) AS is_final FROM past
      UNION ALL SELECT client_id, task_id, 1, event_id, type, round(CAST(current_page AS DOUBLE) / total_pages * 100, 6), status, type <> 'progress' FROM later WHERE ended = 0)""",
    "streaming_expired_states": """SELECT * FROM (WITH gaps AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY task_id ORDER BY ts, event_id)) > 3600000000 AS gap FROM events_in),
      runs AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM gaps)
      SELECT task_id, arg_max(status, struct_pack(ts := ts, id := event_id)) AS status, arg_max(current_page, struct_pack(ts := ts, id := event_id)) AS current_page, arg_max(total_pages, struct_pack(ts := ts, id := event_id)) AS total_pages,
        epoch_ms(max(ts)) + 3600000 < (SELECT epoch_ms(max(ts)) FROM events_in) AS expired FROM (SELECT * FROM runs QUALIFY run = max(run) OVER (PARTITION BY task_id)) GROUP BY task_id)""",
    "streaming_running_totals": """SELECT doc_id, count(*) AS pages, CAST(sum(CASE WHEN error IS NULL THEN n_figures ELSE 0 END) AS BIGINT) AS so_far_figures, CAST(sum(CASE WHEN error IS NULL THEN n_refs ELSE 0 END) AS BIGINT) AS so_far_refs,
      CAST(sum(CASE WHEN error IS NULL THEN n_texts ELSE 0 END) AS BIGINT) AS so_far_texts FROM counts GROUP BY doc_id""",
    "published_events": "SELECT event_id, task_id, type, status, current_page, epoch_us(ts) AS micros FROM events_in",
    "observed_analysis": """SELECT 1 AS task_id, 'page_completed' AS type, NULL AS status, doc_id * 10 + page_index AS current_page, (SELECT count(*) FROM pages) AS total_pages FROM pages
      UNION ALL SELECT 1, 'completed', 'completed', count(*), count(*) FROM pages""",
    "streaming_job_state": "SELECT task_id, status, current_page FROM state",
    "event_rate": "SELECT task_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_micros, count(*) AS events FROM events_in GROUP BY ALL",
}

_SEGMENTS = """
WITH cut AS (SELECT doc_id, string_split_regex(text, '[.!?][ \\t\\n\\r]+') AS ps, regexp_extract_all(text, '[.!?][ \\t\\n\\r]+') AS gs FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, i, ps[i] AS piece, coalesce(list_sum(list_transform(ps[1:i - 1], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(gs[1:i - 1], lambda p: length(p))), 0) AS s
  FROM cut, unnest(range(1, len(ps) + 1)) AS r(i)),
wins AS (SELECT doc_id, i, w, piece, s FROM parts, unnest(CASE WHEN length(piece) > 100 THEN range(0, length(piece), 50) ELSE [CAST(0 AS BIGINT)] END) AS q(w) WHERE regexp_matches(piece, '[^ \\t\\n\\r]'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, w) - 1 AS seg_idx, CAST(s + w AS BIGINT) AS start_pos, CAST(s + least(w + 100, length(piece)) AS BIGINT) AS end_pos, substr(piece, w + 1, 100) AS segment FROM wins"""


def _steps() -> dict[str, tuple[str, str]]:
    """Name to (head, body) of each step, in order."""
    heads = list(re.finditer(r"(?m)^(?:WITH )?((\w+)(?:\(\w+(?:, \w+)*\))?) AS \(", _STEPS))
    ends = [h.start() for h in heads[1:]] + [len(_STEPS)]
    return {h.group(2): (h.group(1), _STEPS[h.end() : end].rstrip().rstrip(",")) for h, end in zip(heads, ends, strict=True)}


def _with_steps(select: str) -> str:
    """A query with those steps that it names, directly or not; each is worked out once."""
    steps, wanted = _steps(), {}
    for name in reversed(steps):
        if any(re.search(rf"\b{name}\b", text) for text in (select, *wanted.values())):
            wanted[name] = steps[name][1]
    listed = [f"{steps[n][0]} AS MATERIALIZED ({wanted[n]}" for n in steps if n in wanted]
    return "WITH " + ",\n".join(listed) + "\n" + select if listed else select


def oracle_sql() -> dict[str, str]:
    out = {name: _with_steps(select) for name, select in _SELECTS.items()}
    out |= {f"reference_scan_r{k}": _with_steps(_SCAN + str(k)) for k in range(1, len(_RULES) + 1)}
    out["text_segments"] = _SEGMENTS
    out["file_infos"] = """SELECT doc_id, CAST(ceil(length(text) / 1000) AS INTEGER) AS total_pages, coalesce(substr(text, 1, 1) IN ('A', 'E', 'I', 'O', 'U'), false) AS encrypted, nullif(substr(text, 1, 3), '') AS title,
      CASE WHEN text = '' THEN 'an empty file' END AS error FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL"""
    out["page_images"] = """SELECT doc_id, CAST(p AS INTEGER) AS page_index, length(substr(text, p * 1000 + 1, 1000)) AS n_chars, 200 AS width, CAST(p + 1 AS INTEGER) AS height, NULL AS error
      FROM documents, unnest(range(0, CAST(ceil(length(text) / 1000) AS BIGINT))) AS r(p) WHERE doc_id % 7 <> 0 AND substr(text, 1, 1) NOT IN ('A', 'E', 'I', 'O', 'U')"""
    out["model_segments"] = """SELECT doc_id, round(least(128, len(regexp_extract_all(regexp_replace(text, '[^A-Za-z ]', '', 'g'), '[A-Za-z]+'))) / 128, 6) AS probability FROM documents WHERE text IS NOT NULL"""
    return out
