"""Queries of groups A to D: admission, hidden text, assembly, typography, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import assembly as A
from folioscope.operators import hidden as H
from folioscope.operators import typography as Y
from folioscope.plans.sql import RUNS, SCREENED, SEPARATED
from folioscope.sources import admission as M
from folioscope.sources import tables as S

BOOK: dict[str, tuple] = {}


def query(sql: str | None = None):
    def keep(f):
        BOOK[f.__name__.removeprefix("q_")] = (f, sql)
        return f

    return keep


def screened(spark: SparkSession, d: str) -> DataFrame:
    return H.screened_runs(S.runs_in(spark, d), S.shapes(spark, d), S.pages(spark, d))


def separated(spark: SparkSession, d: str) -> DataFrame:
    return A.run_separator(screened(spark, d))


def lines(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The visible runs with their lines, with these of their columns."""
    return Y.group_lines(Y.visible_runs(screened(spark, d)).select("doc_id", "page_number", "run_ord", "y", *columns))


# --- A ---
@query(f"WITH {RUNS} x AS (SELECT 1) SELECT doc_id, page_number, run_ord, text, x, y, width, font_size, font_family, bold, color, alpha, render_mode, paint_order FROM runs_in")
def q_scan_layout_tables(spark, d):
    return S.runs_in(spark, d).drop("italic")


@query("SELECT doc_id, octet_length(encode(text)) AS length, CASE WHEN octet_length(encode(text)) > 20000 THEN 'PDF_TOO_LARGE' WHEN NOT contains(left(text, 200), 'the') THEN 'PDF_INVALID' END AS error_code FROM documents")
def q_admit_files(spark, d):
    """The file gate over documents as files: a smaller limit, and a word of the data as the header mark."""
    docs = S.texts(spark, d)
    content = F.col("text").cast("binary")
    files = docs.select("doc_id", F.octet_length(content).cast("long").alias("length"), F.when(F.substring("text", 1, 200).contains("the"), F.lit("%PDF-").cast("binary")).otherwise(F.lit("x").cast("binary")).alias("content"))
    return M.admit_files(files, M.Admission(file_bytes=20_000)).drop("content")


@query(
    f"WITH {SCREENED} p AS (SELECT doc_id, count(DISTINCT page_number) AS n FROM runs GROUP BY doc_id), m AS (SELECT doc_id, max(c) AS c FROM (SELECT doc_id, page_number, count(*) AS c FROM runs GROUP BY doc_id, page_number) GROUP BY doc_id), "
    "t AS (SELECT doc_id, sum(chars) AS seen FROM visible GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN p.n > 2 THEN 'PDF_TOO_MANY_PAGES' WHEN m.c > 35 THEN 'PDF_TOO_COMPLEX' WHEN coalesce(t.seen, 0) < 400 THEN 'PDF_NO_TEXT_FOUND' END AS error_code FROM p JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)"
)
def q_admit_layout(spark, d):
    runs = screened(spark, d)
    seen = A.assemble_visible(A.run_separator(runs)).select("doc_id", F.col("visible_text").alias("text"))
    return M.admit_layout(S.pages(spark, d), runs, S.shapes(spark, d), seen, M.Admission(pages=2, runs_a_page=35, least_chars=400))


@query(
    f"WITH {RUNS} p AS (SELECT doc_id, sum(length(regexp_replace(text, '\\s', '', 'g'))) AS p FROM runs_in WHERE run_ord % 3 = doc_id % 3 GROUP BY doc_id), f AS (SELECT doc_id, sum(length(regexp_replace(text, '\\s', '', 'g'))) AS f FROM runs_in GROUP BY doc_id), "
    "c AS (SELECT doc_id, CASE WHEN f >= 50 AND coalesce(p, 0) < f * 0.5 THEN 'fallback' ELSE 'primary' END AS source FROM f LEFT JOIN p USING (doc_id)) "
    "SELECT r.doc_id, run_ord, source, CASE WHEN source = 'primary' THEN font_family ELSE 'Unknown' END AS font_family FROM runs_in r JOIN c USING (doc_id) WHERE source = 'fallback' OR run_ord % 3 = r.doc_id % 3"
)
def q_choose_text_source(spark, d):
    """A third of the runs as primary, all of them as fallback."""
    runs = S.runs_in(spark, d)
    fallback = M.fallback_runs(runs.select("doc_id", "run_ord", "text"))
    return M.choose_text_source(runs.where("run_ord % 3 = doc_id % 3").select("doc_id", "run_ord", "text", "font_family"), fallback).select("doc_id", "run_ord", "source", "font_family")


@query(f"WITH {RUNS} x AS (SELECT 1) SELECT doc_id, run_ord, text, 'Unknown' AS font_family, false AS bold, false AS hidden FROM runs_in")
def q_fallback_runs(spark, d):
    return M.fallback_runs(S.runs_in(spark, d).select("doc_id", "run_ord", "text")).select("doc_id", "run_ord", "text", "font_family", "bold", "hidden")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS page_number, least(CAST(l_quantity AS DOUBLE), CAST(l_partkey AS DOUBLE)) AS x0, greatest(CAST(l_quantity AS DOUBLE), CAST(l_partkey AS DOUBLE)) AS x1, CAST(CASE WHEN (((l_suppkey * 45 - 360) % 360) + 360) % 360 % 90 = 0 THEN (((l_suppkey * 45 - 360) % 360) + 360) % 360 ELSE 0 END AS INTEGER) AS rotation FROM lineitem")
def q_normalize_page(spark, d):
    """Lineitems as pages with corners in any order and any rotation."""
    li = S.table(spark, d, "lineitem")
    box = F.struct(F.col("l_quantity").cast("double").alias("x0"), F.lit(1.0).alias("y0"), F.col("l_partkey").cast("double").alias("x1"), F.lit(0.0).alias("y1"))
    pages = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"), box.alias("box"), (F.col("l_suppkey") * 45 - 360).alias("rotation"))
    return M.normalize_page(pages).select("doc_id", "page_number", "box.x0", "box.x1", "rotation")


REQUESTS_SQL = """
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'mode-x' WHEN doc_id % 2 = 0 THEN 'mode-a' ELSE 'mode-b' END AS mode, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE text END AS posting, left(text, CAST(doc_id % 300 AS BIGINT)) AS title, n_chars * 400 AS file_size FROM documents)
SELECT doc_id, mode, CASE WHEN mode = 'mode-x' THEN 'INVALID_INPUT' WHEN mode = 'mode-a' AND (trim(posting) = '' OR length(trim(posting)) > 20000) THEN 'INVALID_INPUT' WHEN length(title) > 200 THEN 'INVALID_INPUT' WHEN file_size = 0 THEN 'INVALID_INPUT' WHEN file_size > 4194304 THEN 'PDF_TOO_LARGE' END AS error_code,
  CASE WHEN mode <> 'mode-b' THEN title END AS title FROM r"""


@query(REQUESTS_SQL)
def q_validate_requests(spark, d):
    i = F.col("doc_id")
    docs = S.table(spark, d, "documents")
    reqs = docs.select("doc_id", F.when(i % 7 == 0, "mode-x").when(i % 2 == 0, "mode-a").otherwise("mode-b").alias("mode"), F.when(i % 11 == 0, " ").otherwise(F.col("text")).alias("posting"), F.substring("text", F.lit(1), (i % 300).cast("int")).alias("title"), F.lit("m").alias("model"), (F.col("n_chars") * 400).alias("file_size"))
    return M.validate_requests(reqs).select("doc_id", "mode", "error_code", "title")


PREFIX_SQL = """
WITH t AS (SELECT event_id, list_extract(['sk-or-1', 'sk-ant-1', 'gsk_1', 'sk-1', 'xx', 'hf_1', 'sk-proj-'], CAST(user_id % 7 + 1 AS BIGINT)) AS token, list_extract(['gpt-4', 'deepseek-x', 'org/gpt-4', 'mistral-s', 'o3', 'foo'], CAST(event_id % 6 + 1 AS BIGINT)) AS model FROM events)
SELECT event_id, CASE WHEN token LIKE 'sk-or-%' THEN 'openrouter' WHEN token LIKE 'sk-ant-%' THEN 'anthropic' WHEN token LIKE 'sk-proj-%' THEN 'openai' WHEN token LIKE 'gsk_%' THEN 'groq' WHEN token LIKE 'hf_%' THEN 'huggingface'
  WHEN token LIKE 'sk-%' THEN CASE WHEN model LIKE 'deepseek%' THEN 'deepseek' WHEN model IN ('gpt-4', 'o3') THEN 'openai' END WHEN model LIKE 'mistral%' THEN 'mistral' END AS provider FROM t"""


@query(PREFIX_SQL)
def q_classify_prefix(spark, d):
    e = S.table(spark, d, "events")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)
    tokens = e.select("event_id", pick(("sk-or-1", "sk-ant-1", "gsk_1", "sk-1", "xx", "hf_1", "sk-proj-"), F.col("user_id")).alias("token"), pick(("gpt-4", "deepseek-x", "org/gpt-4", "mistral-s", "o3", "foo"), F.col("event_id")).alias("model"))
    return M.classify_prefix(tokens).select("event_id", "provider")


@query(f"WITH r AS ({REQUESTS_SQL}) SELECT doc_id, error_code, CASE error_code WHEN 'PDF_TOO_LARGE' THEN 413 WHEN 'INVALID_INPUT' THEN 400 END AS status FROM r")
def q_error_catalog_join(spark, d):
    return M.error_catalog_join(q_validate_requests(spark, d), M.error_catalog(spark)).select("doc_id", "error_code", "status")


# --- B ---
@query(f"WITH {RUNS} x AS (SELECT 1) SELECT doc_id, run_ord, replace(regexp_replace(text, '[\\t\\r\\x0B\\f]', ' ', 'g'), '­', '') AS text FROM runs_in")
def q_clean_run_text(spark, d):
    return H.cleaned_runs(S.runs_in(spark, d)).select("doc_id", "run_ord", "text")


LUM_SQL = """
WITH c AS (SELECT user_id, event_id, '#' || lpad(hex((event_id * 7919) % 16777216), 6, '0') AS color FROM events),
v AS (SELECT event_id, color, list_transform([2, 4, 6], lambda i: CAST('0x' || substr(color, i, 2) AS INTEGER) / 255.0::DOUBLE) AS ch FROM c),
w AS (SELECT event_id, color, list_transform(ch, lambda x: CASE WHEN x <= 0.03928 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END) AS l FROM v),
r AS (SELECT event_id, l[1] * 0.2126 + l[2] * 0.7152 + l[3] * 0.0722 AS lum FROM w)
"""


def colours(spark, d):
    hexed = F.lpad(F.hex((F.col("event_id") * 7919) % 16777216), 6, "0")
    return S.table(spark, d, "events").select("event_id", F.concat(F.lit("#"), hexed).alias("color"))


@query(LUM_SQL + "SELECT event_id, floor(lum * 1e6 + 0.5) / 1e6 AS luminance FROM r")
def q_relative_luminance(spark, d):
    return colours(spark, d).select("event_id", T.rounded(T.relative_luminance(F.col("color")), 6).alias("luminance"))


@query(LUM_SQL + "SELECT event_id, floor((1.05 / (lum + 0.05)) * 1e4 + 0.5) / 1e4 AS contrast FROM r")
def q_contrast_ratio(spark, d):
    return colours(spark, d).select("event_id", T.rounded(T.contrast_ratio(F.col("color"), F.lit("#ffffff")), 4).alias("contrast"))


@query(f"WITH {SCREENED} z AS (SELECT 1) SELECT doc_id, run_ord, background FROM seen")
def q_background_at(spark, d):
    return H.background_at(S.runs_in(spark, d), S.shapes(spark, d)).select("doc_id", "run_ord", "background")


@query(f"WITH {SCREENED} z AS (SELECT 1) SELECT doc_id, run_ord, array_to_string(reasons, ',') AS reasons FROM reasoned")
def q_classify_visibility(spark, d):
    out = H.classify_visibility(S.runs_in(spark, d), S.shapes(spark, d), S.pages(spark, d))
    return out.select("doc_id", "run_ord", F.array_join("hidden_reasons", ",").alias("reasons"))


@query(f"WITH {SCREENED} z AS (SELECT 1) SELECT doc_id, page_number, ocr_layer FROM ocr")
def q_ocr_layer_pages(spark, d):
    seen = H.classify_visibility(S.runs_in(spark, d), S.shapes(spark, d), S.pages(spark, d))
    return H.ocr_layer_pages(seen, S.shapes(spark, d), S.pages(spark, d)).select("doc_id", "page_number", "ocr_layer")


@query(f"WITH {SCREENED} z AS (SELECT 1) SELECT doc_id, run_ord, hidden, array_to_string(hidden_reasons, ',') AS reasons FROM runs")
def q_apply_ocr_exception(spark, d):
    return screened(spark, d).select("doc_id", "run_ord", "hidden", F.array_join("hidden_reasons", ",").alias("reasons"))


SUMMARY = f"""WITH {SCREENED}
h AS (SELECT *, sum(CASE WHEN hidden AND NOT (coalesce(ph, false) AND pp = page_number) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY run_ord) AS grp
  FROM (SELECT *, lag(hidden) OVER (PARTITION BY doc_id ORDER BY run_ord) AS ph, lag(page_number) OVER (PARTITION BY doc_id ORDER BY run_ord) AS pp FROM runs)),
g AS (SELECT doc_id, grp, min(page_number) AS page, count(*) AS n, sum(length(regexp_replace(text, '\\s', '', 'g'))) AS chars, trim(string_agg(trim(text), ' ' ORDER BY run_ord)) AS text FROM h WHERE hidden GROUP BY doc_id, grp),
f AS (SELECT doc_id, sum(n) AS run_count, sum(chars) AS char_count, bool_or(regexp_matches(text, '[\\pL\\pN]')) AS has_words, string_agg(CASE WHEN k <= 3 THEN rtrim(left(text, 80)) || '@' || page END, '|' ORDER BY grp) AS samples
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY NOT regexp_matches(text, '[\\pL\\pN]'), grp) AS k FROM g) GROUP BY doc_id),
rs AS (SELECT doc_id, string_agg(r, ',' ORDER BY o, p) AS reasons FROM (SELECT doc_id, r, unnest(min(struct_pack(o, p))) FROM (SELECT doc_id, run_ord AS o, unnest(hidden_reasons) AS r, generate_subscripts(hidden_reasons, 1) AS p FROM runs) GROUP BY doc_id, r) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(run_count, 0) AS INTEGER) AS run_count, CAST(coalesce(char_count, 0) AS INTEGER) AS char_count, coalesce(has_words, false) AS has_words, coalesce(reasons, '') AS reasons, coalesce(samples, '') AS samples
FROM (SELECT DISTINCT doc_id FROM runs) d LEFT JOIN f USING (doc_id) LEFT JOIN rs USING (doc_id)"""


@query(SUMMARY)
def q_summarize_hidden(spark, d):
    out = H.summarize_hidden(screened(spark, d))
    told = F.array_join(F.transform("samples", lambda s: F.concat(T.trimmed(s["text"]), F.lit("@"), s["page"].cast("string"))), "|")
    return out.select("doc_id", "run_count", "char_count", "has_words", F.array_join("reasons", ",").alias("reasons"), told.alias("samples"))


@query("SELECT conv_id, turn, translate(text, '[]', '()') AS text FROM conversations")
def q_neutralize_markers(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", T.neutralize_markers(F.col("text")).alias("text"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, 'and', '[IGNORED]and[/IGNORED]'), '\\[IGNORED\\].*?\\[/IGNORED\\]', '', 'gs'), '[ \\t]{2,}', ' ', 'g'), '[ \\t]+(\\n|$)', '\\1', 'g') AS text FROM documents")
def q_strip_ignored(spark, d):
    marked = F.regexp_replace("text", "and", "[IGNORED]and[/IGNORED]")
    return S.texts(spark, d).select("doc_id", T.strip_ignored(marked).alias("text"))


# --- C ---
@query(f"WITH {SEPARATED} z AS (SELECT 1) SELECT doc_id, run_ord, replace(sep, chr(10), 'n') AS sep FROM sepd")
def q_run_separator(spark, d):
    return separated(spark, d).select("doc_id", "run_ord", F.replace("sep", F.lit("\n"), F.lit("n")).alias("sep"))


@query(f"WITH {SEPARATED} z AS (SELECT 1) SELECT doc_id, run_ord, CAST(text_end - length(text) AS INTEGER) AS text_start, CAST(text_end AS INTEGER) AS text_end, md5(raw_text) AS raw_md5 FROM offs JOIN raw USING (doc_id)")
def q_assemble_raw(spark, d):
    placed = A.assemble_raw(separated(spark, d))
    return placed.join(A.raw_text(placed), "doc_id").select("doc_id", "run_ord", "text_start", "text_end", F.md5("raw_text").alias("raw_md5"))


SANITIZED = f"""WITH {SEPARATED}
b AS (SELECT *, translate(text, '[]', '()') AS safe, coalesce(last_value(CASE WHEN trim(text) <> '' THEN hidden END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY run_ord ROWS UNBOUNDED PRECEDING), false) AS inside FROM sepd),
c AS (SELECT *, coalesce(lag(inside) OVER w, false) AS was, coalesce(lag(safe) OVER w, '') AS prev FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY run_ord)),
e AS (SELECT doc_id, run_ord, inside, CASE WHEN was AND NOT inside THEN '[/IGNORED]' ELSE '' END
  || CASE WHEN sep = ' ' AND ((regexp_matches(prev, '\\s$') AND NOT (was AND NOT inside)) OR (regexp_matches(safe, '^\\s') AND NOT (inside AND NOT was))) THEN '' ELSE sep END
  || CASE WHEN inside AND NOT was THEN '[IGNORED]' ELSE '' END || safe AS piece FROM c)
SELECT doc_id, string_agg(piece, '' ORDER BY run_ord) || CASE WHEN arg_max(inside, run_ord) THEN '[/IGNORED]' ELSE '' END AS sanitized_text FROM e GROUP BY doc_id"""


@query(SANITIZED)
def q_assemble_sanitized(spark, d):
    return A.assemble_sanitized(separated(spark, d))


VISIBLE = f"""{SEPARATED}
vg AS (SELECT *, coalesce(sum(CASE WHEN hidden THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY run_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since, CASE sep WHEN '' THEN 0 WHEN ' ' THEN 1 ELSE 2 END AS k FROM sepd),
vp AS (SELECT *, max(k) OVER (PARTITION BY doc_id, since ORDER BY run_ord) AS pend FROM vg),
vv AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY run_ord) AS prev FROM vp WHERE NOT hidden),
vis AS (SELECT doc_id, string_agg(CASE WHEN prev IS NULL OR pend = 0 THEN '' WHEN pend = 2 THEN chr(10) WHEN regexp_matches(prev, '\\s$') OR regexp_matches(text, '^\\s') THEN '' ELSE ' ' END || text, '' ORDER BY run_ord) AS visible_text FROM vv GROUP BY doc_id),
"""


@query(f"WITH {VISIBLE} z AS (SELECT 1) SELECT doc_id, coalesce(visible_text, '') AS visible_text FROM (SELECT DISTINCT doc_id FROM runs) LEFT JOIN vis USING (doc_id)")
def q_assemble_visible(spark, d):
    return A.assemble_visible(separated(spark, d))


SPANS = "spans AS (SELECT doc_id, page_number, min(text_end - length(text)) AS s, max(text_end) AS e FROM offs GROUP BY doc_id, page_number), pt AS (SELECT doc_id, page_number, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", trim(regexp_replace(substr(raw_text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)), '\\s+', ' ', 'g')) AS text FROM spans JOIN raw USING (doc_id)),"


@query(f"WITH {SEPARATED} {SPANS} z AS (SELECT 1) SELECT * FROM pt")
def q_page_spans(spark, d):
    placed = A.assemble_raw(separated(spark, d))
    return A.page_spans(placed, A.raw_text(placed))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations")
def q_collapse_ws(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", T.collapse_ws(F.col("text")).alias("text"))


# --- D ---
FONT_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'Unknown' WHEN p_partkey % 3 = 0 THEN 'Times New Roman' ELSE 'Arial' END AS family, p_partkey % 9 <> 0 AND p_partkey % 2 = 0 AS bold, p_partkey % 9 <> 0 AND p_partkey % 5 = 0 AS italic FROM part"""


@query(FONT_SQL)
def q_parse_font_name(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 9 == 0, "").otherwise(F.concat(F.when(k % 7 == 0, "ABCDEF+").otherwise(""), F.when(k % 3 == 0, "TimesNewRomanPS").otherwise("ArialMT"), F.when(k % 2 == 0, "-Bold").otherwise(""), F.when(k % 5 == 0, ",Italic").otherwise("")))
    return S.table(spark, d, "part").select("p_partkey", T.parse_font_name(name).alias("f")).select("p_partkey", "f.*")


FONTS = "fu AS (SELECT doc_id, font_family AS family, bold, italic, font_size AS size, sum(chars) AS char_count, min(run_ord) AS fr FROM visible GROUP BY ALL), fo AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY char_count DESC, fr) AS INTEGER) AS font_ord FROM fu), sz AS (SELECT doc_id, coalesce(arg_min(size, font_ord) FILTER (WHERE NOT bold AND NOT italic), max(size)) AS body_size, max(size) AS title_size FROM fo GROUP BY doc_id),"


def fonts(spark, d):
    return Y.font_usage(Y.visible_runs(screened(spark, d)))


@query(f"WITH {SCREENED} {FONTS} z AS (SELECT 1) SELECT doc_id, family, bold, italic, size, CAST(char_count AS BIGINT) AS char_count, font_ord FROM fo")
def q_font_usage(spark, d):
    return fonts(spark, d)


@query(f"WITH {SCREENED} {FONTS} z AS (SELECT 1) SELECT * FROM sz")
def q_body_title_size(spark, d):
    return Y.body_title_size(fonts(spark, d))


@query(f"WITH {SCREENED} {FONTS} s AS (SELECT doc_id, sum(chars) AS n, sum(CASE WHEN bold THEN chars ELSE 0 END) AS b, sum(CASE WHEN italic THEN chars ELSE 0 END) AS i FROM visible JOIN sz USING (doc_id) WHERE abs(font_size - body_size) <= 0.5 GROUP BY doc_id) SELECT doc_id, floor(b::DOUBLE / n * 1000 + 0.5) / 1000 AS bold_ratio, floor(i::DOUBLE / n * 1000 + 0.5) / 1000 AS italic_ratio FROM s")
def q_styled_share(spark, d):
    seen = Y.visible_runs(screened(spark, d)).select("doc_id", "run_ord", "font_size", "font_family", "bold", "italic", T.seen_chars(F.col("text")).alias("n_chars")).persist()  # a few numbers a run, read for the sizes and for the shares
    return Y.styled_share(seen, Y.body_title_size(Y.font_usage(seen)))


LINES = "ln AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id, page_number ORDER BY y DESC) - 1 AS INTEGER) AS line_no FROM visible), lt AS (SELECT doc_id, page_number, line_no, max(y) AS y, max(font_size) AS fs FROM ln GROUP BY ALL),"


@query(f"WITH {SCREENED} {LINES} z AS (SELECT 1) SELECT doc_id, page_number, run_ord, line_no FROM ln")
def q_group_lines(spark, d):
    """Baselines of the derived runs are 14 pt apart or equal, so ranks say what the fold says."""
    return lines(spark, d).drop("y")


@query(f"WITH {SCREENED} {LINES} g AS (SELECT doc_id, (lag(y) OVER w - y) / greatest(lag(fs) OVER w, fs) AS r FROM lt WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_no)), a AS (SELECT doc_id, list_sort(list(r)) AS l FROM g WHERE r BETWEEN 0.5 AND 3 GROUP BY doc_id) SELECT doc_id, floor(l[CAST(floor(0.25 * (len(l) - 1)) AS BIGINT) + 1] * 100 + 0.5) / 100 AS line_spacing FROM a")
def q_line_spacing(spark, d):
    return Y.line_spacing(lines(spark, d, "font_size"))


@query(f"WITH {SCREENED} z AS (SELECT 1) SELECT doc_id, floor(min(x) * 10 + 0.5) / 10 AS margin_left, floor(min(612 - (x + width)) * 10 + 0.5) / 10 AS margin_right, floor(min(792 - y) * 10 + 0.5) / 10 AS margin_top, floor(min(y) * 10 + 0.5) / 10 AS margin_bottom FROM visible GROUP BY doc_id")
def q_margins(spark, d):
    return Y.margins(Y.visible_runs(screened(spark, d)), S.pages(spark, d))


COLUMNS = f"""WITH {SCREENED} {LINES}
cl AS (SELECT DISTINCT doc_id, page_number, x, line_no, y FROM ln),
cs AS (SELECT doc_id, page_number, x, count(*) AS n, max(y) AS top, min(y) AS bottom FROM cl GROUP BY ALL HAVING count(*) >= 2),
pr AS (SELECT doc_id, page_number, unnest(arg_max(struct_pack(px := x, ptop := top, pbottom := bottom), (n, -x))) FROM cs GROUP BY doc_id, page_number),
ot AS (SELECT * FROM cs JOIN pr USING (doc_id, page_number) WHERE x <> px AND ptop > pbottom),
an AS (SELECT doc_id, page_number, x, list_sort(list(x + width)) AS e, count(*) AS n, count(*) FILTER (WHERE length(trim(text)) <= 30 AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])((19|20)[0-9]{{2}}|sekarang|saat ini|present|now|current)([^A-Za-z0-9_]|$)')) AS dates FROM ln GROUP BY ALL),
ok AS (SELECT o.doc_id, o.page_number, o.x FROM ot o JOIN an USING (doc_id, page_number, x)
  WHERE (SELECT count(*) FROM cl a JOIN cl b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.line_no = b.line_no WHERE a.doc_id = o.doc_id AND a.page_number = o.page_number AND a.x = o.x AND b.x = o.px) >= 2
    AND (o.top - o.bottom) / (o.ptop - o.pbottom) >= 0.5
    AND o.n / greatest((SELECT count(*) FROM cl b WHERE b.doc_id = o.doc_id AND b.page_number = o.page_number AND b.x = o.px AND b.y BETWEEN o.bottom AND o.top), 1) >= 0.35
    AND NOT an.dates >= an.n * 0.5),
pg AS (SELECT doc_id, page_number, count(*) AS n FROM ok GROUP BY ALL)
SELECT doc_id, CAST(coalesce(max(pg.n), 0) + 1 AS INTEGER) AS column_count FROM (SELECT DISTINCT doc_id FROM visible) LEFT JOIN pg USING (doc_id) GROUP BY doc_id"""


@query(COLUMNS)
def q_detect_columns(spark, d):
    return Y.detect_columns(lines(spark, d, "x", "width", "font_size", "text").persist())  # read by several joins


@query(f"WITH {SCREENED} {LINES} a AS (SELECT doc_id, page_number, x, count(*) AS n, count(*) FILTER (WHERE length(trim(text)) <= 30 AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])((19|20)[0-9]{{2}}|sekarang|saat ini|present|now|current)([^A-Za-z0-9_]|$)')) AS dates FROM ln GROUP BY ALL) SELECT doc_id, page_number, x, dates >= n * 0.5 AS annotation FROM a")
def q_annotation_clusters(spark, d):
    """Start positions as clusters: starts never differ inside one here."""
    return Y.annotation_clusters(lines(spark, d, "x", "width", "text"), ["doc_id", "page_number", "x"])


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 13 = 0 THEN 'bar' END, CASE WHEN doc_id % 11 = 0 THEN 'image' END], lambda x: x IS NOT NULL), ',') AS graphics FROM documents WHERE text <> '' AND (doc_id % 13 = 0 OR doc_id % 11 = 0)")
def q_classify_graphics(spark, d):
    return Y.classify_graphics(S.shapes(spark, d), S.pages(spark, d)).select("doc_id", F.array_join("graphics", ",").alias("graphics"))


@query(f"SELECT doc_id, column_count, doc_id % 13 = 0 OR doc_id % 11 = 0 AS has_graphics FROM ({COLUMNS})")
def q_layout_row(spark, d):
    runs = screened(spark, d).persist()  # read by several joins
    seen = H.classify_visibility(S.runs_in(spark, d), S.shapes(spark, d), S.pages(spark, d))
    pages = H.ocr_layer_pages(seen, S.shapes(spark, d), S.pages(spark, d))
    out = Y.layout_row(runs, S.shapes(spark, d), pages)
    return out.join(Y.visible_runs(runs).select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "column_count", "has_graphics")


def typography(spark: SparkSession, d: str) -> DataFrame:
    return Y.typography_row(screened(spark, d), S.pages(spark, d))
