"""Pieces of DuckDB SQL that several oracles share: the driver tables as the operators' inputs."""

RUNS = """
lines AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS n, unnest(a) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
runs_in AS (
  SELECT doc_id, CAST(1 + n // 40 AS INTEGER) AS page_number, CAST(n AS INTEGER) AS run_ord, text,
    CASE WHEN doc_id % 5 = 0 AND n % 2 = 1 THEN 332.0 ELSE 72.0 END::DOUBLE AS x,
    (720 - 14 * CASE WHEN doc_id % 5 = 0 THEN (n % 40) // 2 ELSE n % 40 END)::DOUBLE AS y,
    least(5 * length(text), 200)::DOUBLE AS width,
    CASE WHEN n = 0 THEN 16.0 WHEN (doc_id + n) % 29 = 0 THEN 1.5 ELSE 11.0 END::DOUBLE AS font_size,
    CASE WHEN doc_id % 7 = 0 THEN 'Times' ELSE 'Helvetica' END AS font_family, n = 0 AS bold, false AS italic,
    CASE WHEN (doc_id + n) % 13 = 0 THEN '#ffffff' WHEN (doc_id + n) % 17 = 0 THEN '#e6e6e6' ELSE '#000000' END AS color,
    CASE WHEN (doc_id + n) % 31 = 0 THEN 0.05 ELSE 1.0 END::DOUBLE AS alpha,
    CASE WHEN (doc_id + n) % 37 = 0 THEN 3 ELSE 0 END AS render_mode, CAST(10 + 2 * n AS INTEGER) AS paint_order
  FROM lines WHERE text <> ''),
"""
# contrast of the three run colours with the two backgrounds, decided by WCAG luminance
SCREENED = (
    RUNS
    + """
lum(color, l) AS (VALUES ('#ffffff', 1.0), ('#000000', 0.0), ('#e6e6e6', 0.7912979403326302), ('#1a1a33', 0.011709), ('#336699', 0.1264)),
seen AS (
  SELECT r.*, CASE
      WHEN page_number = 1 AND doc_id % 13 = 0 AND false THEN NULL
      WHEN page_number = 1 AND doc_id % 3 = 0 AND x + width / 2 BETWEEN 60 AND 400 AND y + 0.3 * font_size BETWEEN 600 AND 740 THEN '#1a1a33'
      WHEN page_number = 1 AND doc_id % 11 = 0 AND x + width / 2 BETWEEN 0 AND 612 AND y + 0.3 * font_size BETWEEN 0 AND 792 THEN NULL
      ELSE '#ffffff' END AS background
  FROM runs_in r),
reasoned AS (
  SELECT s.*, list_filter([
      CASE WHEN render_mode IN (3, 7) THEN 'invisible-mode' END, CASE WHEN alpha < 0.1 THEN 'transparent' END, CASE WHEN font_size <= 2 THEN 'tiny-font' END,
      CASE WHEN x < -1 OR x > 613 OR y < -1 OR y > 793 THEN 'off-page' END,
      CASE WHEN background IS NOT NULL AND (greatest(a.l, b.l) + 0.05) / (least(a.l, b.l) + 0.05) < 1.25 THEN 'low-contrast' END], lambda r: r IS NOT NULL) AS reasons
  FROM seen s JOIN lum a ON a.color = s.color LEFT JOIN lum b ON b.color = s.background),
ocr AS (SELECT doc_id, page_number, bool_and(list_contains(reasons, 'invisible-mode')) AND doc_id % 11 = 0 AND page_number = 1 AS ocr_layer FROM reasoned GROUP BY doc_id, page_number),
runs AS (
  SELECT r.*, CASE WHEN o.ocr_layer THEN list_filter(reasons, lambda x: x <> 'invisible-mode') ELSE reasons END AS hidden_reasons,
    len(CASE WHEN o.ocr_layer THEN list_filter(reasons, lambda x: x <> 'invisible-mode') ELSE reasons END) > 0 AS hidden, o.ocr_layer
  FROM reasoned r JOIN ocr o USING (doc_id, page_number)),
visible AS (SELECT *, length(regexp_replace(text, '\\s', '', 'g')) AS chars FROM runs WHERE NOT hidden AND trim(text) <> ''),
"""
)
SEPARATED = (
    SCREENED
    + """
sepd AS (
  SELECT *, CASE WHEN lag(run_ord) OVER w IS NULL THEN ''
    WHEN lag(page_number) OVER w <> page_number OR abs(y - lag(y) OVER w) > greatest(lag(font_size) OVER w, font_size, 1) * 0.5 THEN chr(10)
    WHEN x - (lag(x) OVER w + lag(width) OVER w) > greatest(lag(font_size) OVER w, font_size, 1) * 0.1 OR x - (lag(x) OVER w + lag(width) OVER w) < -greatest(lag(font_size) OVER w, font_size, 1) * 0.5 THEN ' ' ELSE '' END AS sep
  FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY run_ord)),
placed AS (
  SELECT *, CASE WHEN sep = ' ' AND (regexp_matches(coalesce(lag(text) OVER w, ''), '\\s$') OR regexp_matches(text, '^\\s')) THEN '' ELSE sep END AS lead
  FROM sepd WINDOW w AS (PARTITION BY doc_id ORDER BY run_ord)),
offs AS (
  SELECT *, sum(length(lead) + length(text)) OVER (PARTITION BY doc_id ORDER BY run_ord) AS text_end FROM placed),
raw AS (SELECT doc_id, string_agg(lead || text, '' ORDER BY run_ord) AS raw_text FROM placed GROUP BY doc_id),
"""
)
KEYWORDS = """
toks AS (SELECT posting_id, generate_subscripts(a, 1) AS pos, unnest(a) AS keyword FROM (SELECT item_id AS posting_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+.#-]*'), lambda t: regexp_replace(t, '[.]+$', '')) AS a FROM benchmark)),
segs AS (SELECT posting_id, generate_subscripts(a, 1) AS seg, unnest(a) AS part FROM (SELECT item_id AS posting_id, regexp_split_to_array(lower(text), '[,;:!?()\\[\\]{}|/\\\\•·\\n]+|\\.(\\s|$)|\\s[-\\x{2013}\\x{2014}]\\s') AS a FROM benchmark)),
st AS (SELECT posting_id, seg, list_transform(regexp_extract_all(part, '[a-z0-9][a-z0-9+.#-]*'), lambda t: regexp_replace(t, '[.]+$', '')) AS t FROM segs),
bi AS (SELECT posting_id, seg, unnest(range(1, len(t))) AS pos, t FROM st WHERE len(t) > 1),
kw0 AS (SELECT posting_id, keyword, 0 AS kind, 0 AS seg, pos FROM toks WHERE length(keyword) >= 2 AND NOT regexp_matches(keyword, '^[0-9]+$') AND keyword NOT IN (SELECT w FROM stop)
  UNION ALL SELECT posting_id, t[pos] || ' ' || t[pos + 1], 1, seg, pos FROM bi WHERE length(t[pos]) >= 2 AND length(t[pos + 1]) >= 2 AND NOT regexp_matches(t[pos], '^[0-9]+$') AND NOT regexp_matches(t[pos + 1], '^[0-9]+$') AND t[pos] NOT IN (SELECT w FROM stop) AND t[pos + 1] NOT IN (SELECT w FROM stop)),
keywords AS (SELECT posting_id, keyword, CAST(row_number() OVER (PARTITION BY posting_id ORDER BY kind, seg, pos) AS INTEGER) AS kw_ord FROM (SELECT posting_id, keyword, unnest(min(struct_pack(kind, seg, pos))) FROM kw0 GROUP BY posting_id, keyword)),
"""
