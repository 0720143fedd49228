"""Queries of group E: document scoring against paired postings, with a lexicon of the data's words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import scoring as R
from folioscope.operators.hidden import summarize_hidden
from folioscope.operators.messages import Messages, message
from folioscope.plans.layout import SUMMARY, screened, typography
from folioscope.plans.sql import KEYWORDS, SCREENED
from folioscope.sources import tables as S

BOOK: dict[str, tuple] = {}
#: The driver documents have no headings and bullets, so lines that are one of these words play them.
HEADINGS = {"summary": ("the.",), "skills": ("and.",), "experience": ("of.",), "education": ("de.",)}
OTHERS = ("is.",)
STOP = ("the", "and", "of", "to", "de", "la")
STOP_SQL = "stop(w) AS (VALUES ('the'), ('and'), ('of'), ('to'), ('de'), ('la')),"


def query(sql: str | None = None):
    def keep(f):
        BOOK[f.__name__.removeprefix("q_")] = (f, sql)
        return f

    return keep


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with some of their lines made headings and bullets, by line number."""
    every = F.split("text", "\n")
    i = F.col("doc_id")
    made = F.transform(
        every,
        lambda line, n: F.when((n == 1) & (i % 3 != 0), "The.").when((n == 3) & (i % 4 != 0), "AND.:").when((n == 5) & (i % 5 != 0), "**Of.**").when((n == 7) & (i % 2 == 0), "# is.").when(n % 4 == 2, F.concat(F.lit("- "), line)).when((n % 9 == 4) & (i % 2 == 0), F.concat(F.lit("2. "), line)).otherwise(line),
    )
    return S.spread(S.texts(spark, d)).select("doc_id", F.array_join(made, "\n").alias("text"))


TEXTS = """
docs AS (SELECT doc_id, string_agg(CASE WHEN n = 1 AND doc_id % 3 <> 0 THEN 'The.' WHEN n = 3 AND doc_id % 4 <> 0 THEN 'AND.:' WHEN n = 5 AND doc_id % 5 <> 0 THEN '**Of.**' WHEN n = 7 AND doc_id % 2 = 0 THEN '# is.'
    WHEN n % 4 = 2 THEN '- ' || line WHEN n % 9 = 4 AND doc_id % 2 = 0 THEN '2. ' || line ELSE line END, chr(10) ORDER BY n) AS text
  FROM (SELECT doc_id, generate_subscripts(a, 1) - 1 AS n, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) GROUP BY doc_id),
tl AS (SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM docs)),
lex(heading, section) AS (VALUES ('the.', 'summary'), ('and.', 'skills'), ('of.', 'experience'), ('de.', 'education'), ('is.', 'other')),
hd AS (SELECT doc_id, line_no, line, lower(trim(regexp_replace(trim(regexp_replace(regexp_replace(trim(line), '^#+', ''), '[*_]', '', 'g')), ':+$', ''))) AS heading FROM tl),
hs AS (SELECT hd.*, section FROM hd LEFT JOIN lex USING (heading)),
flags AS (SELECT doc_id, coalesce(bool_or(section = 'summary'), false) AS has_summary, coalesce(bool_or(section = 'experience'), false) AS has_experience, coalesce(bool_or(section = 'education'), false) AS has_education, coalesce(bool_or(section = 'skills'), false) AS has_skills FROM hs GROUP BY doc_id),
bl AS (SELECT doc_id, line_no, trim(line) AS bullet FROM tl WHERE regexp_matches(trim(line), '^[-*•·●▪‣○◦■□◆◇►▸➢➤✓✔–»]') OR regexp_matches(trim(line), '^[0-9]+[.)]\\s+') OR regexp_matches(line, '[●•▪‣○◦■◆►➢]')),
ss AS (SELECT *, last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS state FROM hs),
a1 AS (SELECT bl.* FROM bl JOIN ss USING (doc_id, line_no) WHERE section IS NULL AND (state IS NULL OR state NOT IN ('skills', 'education'))),
ab AS (SELECT * FROM a1 UNION ALL SELECT * FROM bl WHERE doc_id NOT IN (SELECT doc_id FROM a1)),
"""


def section_sql(target: str) -> str:
    return f"""(SELECT f.doc_id, coalesce(lower(string_agg(trim(line), ' ' ORDER BY line_no) FILTER (WHERE line_no > f.first AND (stop IS NULL OR line_no < stop))), '') AS text
  FROM (SELECT a.doc_id, a.first, (SELECT min(b.line_no) FROM hs b WHERE b.doc_id = a.doc_id AND b.section NOT IN ('{target}', 'other') AND b.line_no > a.first) AS stop FROM (SELECT doc_id, min(line_no) AS first FROM hs WHERE section = '{target}' GROUP BY doc_id) a) f JOIN tl USING (doc_id) GROUP BY f.doc_id)"""


MATCH = f"""{TEXTS} {STOP_SQL} {KEYWORDS}
pairs AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS posting_id FROM documents),
sk AS {section_sql('skills')}, su AS {section_sql('summary')},
pk AS (SELECT * FROM pairs JOIN keywords USING (posting_id)),
low AS (SELECT doc_id, lower(text) AS text FROM docs),
"""


def hits_sql(texts: str) -> str:
    esc = "regexp_replace(keyword, '([+.#-])', '\\\\\\1', 'g')"
    return f"SELECT pk.doc_id, posting_id, keyword FROM pk JOIN {texts} t USING (doc_id) WHERE contains(t.text, keyword) AND regexp_matches(t.text, '(^|[^A-Za-z0-9_])' || {esc} || '([^A-Za-z0-9_]|$)')"


CHECKS = f"""{MATCH}
hit AS ({hits_sql('low')}), hsk AS ({hits_sql('sk')}), hsu AS ({hits_sql('su')}),
kc AS (SELECT pk.doc_id, pk.posting_id, count(*) AS n, count(hit.keyword) AS f, count(hsk.keyword) AS fs, sum(CASE WHEN hit.keyword IS NULL THEN 0 WHEN hsk.keyword IS NOT NULL THEN 12 WHEN hsu.keyword IS NOT NULL THEN 11 ELSE 10 END) AS credit
  FROM pk LEFT JOIN hit USING (doc_id, posting_id, keyword) LEFT JOIN hsk USING (doc_id, posting_id, keyword) LEFT JOIN hsu USING (doc_id, posting_id, keyword) GROUP BY 1, 2),
c1 AS (SELECT p.doc_id, p.posting_id, 'keyword' AS check_id, CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE least(100, floor(credit * 100.0 / (n * 12) + 0.5)) END AS score FROM pairs p LEFT JOIN kc USING (doc_id, posting_id)),
si AS (SELECT doc_id, text, len(list_filter(list_transform(regexp_split_to_array(text, '[,\\n|•·-]'), lambda i: regexp_replace(trim(i), '^[-*•·|]\\s*', '')), lambda i: length(i) >= 2)) AS items FROM sk),
c2 AS (SELECT p.doc_id, p.posting_id, 'skills', CASE WHEN coalesce(trim(text), '') = '' OR coalesce(n, 0) = 0 THEN 0 ELSE least(100, floor(fs * 100.0 / n + 0.5) + CASE WHEN items >= 15 THEN 5 WHEN items >= 10 THEN 3 ELSE 0 END) END FROM pairs p LEFT JOIN kc USING (doc_id, posting_id) LEFT JOIN si USING (doc_id)),
c3 AS (SELECT p.doc_id, p.posting_id, 'sections', 25 * (has_summary::INT + has_experience::INT + has_education::INT + has_skills::INT) FROM pairs p JOIN flags USING (doc_id)),
yr AS (SELECT doc_id, text, regexp_replace(text, '(?i)(^|[^A-Za-z0-9_])(19|20)[0-9]{{2}}\\s*[-/–—]\\s*((19|20)[0-9]{{2}}|sekarang|saat ini|present|now)', '\\1 ', 'g') AS t FROM docs),
tf AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n_words, regexp_matches(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}') AS has_email,
    len(list_filter(regexp_extract_all(t, '\\+?[0-9][0-9\\s().-]{{7,}}[0-9]'), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) >= 9)) > 0 AS has_phone FROM yr),
pp AS (SELECT doc_id, line_no, length(regexp_replace(line, '[^|]', '', 'g')) AS n FROM tl WHERE trim(line) <> ''),
tb AS (SELECT doc_id, bool_or(n >= 2 AND coalesce(b, 0) >= 2) AS has_table FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM pp) GROUP BY doc_id),
bw AS (SELECT doc_id, count(*) AS n_bullets, sum(len(list_filter(regexp_split_to_array(bullet, '\\s+'), lambda w: w <> ''))) AS words FROM bl GROUP BY doc_id),
c4 AS (SELECT p.doc_id, p.posting_id, 'formatting', greatest(0, 25 * (has_email::INT + has_phone::INT + (coalesce(n_bullets, 0) > 0)::INT + (n_words BETWEEN 50 AND 1200)::INT) - CASE WHEN coalesce(has_table, false) THEN 15 ELSE 0 END) FROM pairs p JOIN tf USING (doc_id) LEFT JOIN tb USING (doc_id) LEFT JOIN bw USING (doc_id)),
qn AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(bullet, '[0-9]')) AS q FROM ab GROUP BY doc_id),
c5 AS (SELECT p.doc_id, p.posting_id, 'quantified', CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE floor(q * 100.0 / n + 0.5) END FROM pairs p LEFT JOIN qn USING (doc_id)),
c6 AS (SELECT p.doc_id, p.posting_id, 'readability', 25 * (has_summary::INT + (coalesce(n_bullets, 0) > 0)::INT + (coalesce(words, 0) <= 25 * coalesce(n_bullets, 0))::INT + (n_words BETWEEN 50 AND 1200)::INT) FROM pairs p JOIN flags USING (doc_id) JOIN tf USING (doc_id) LEFT JOIN bw USING (doc_id)),
checks AS (SELECT doc_id, posting_id, check_id, CAST(score AS INTEGER) AS score, list_position(['keyword', 'skills', 'sections', 'formatting', 'quantified', 'readability'], check_id) - 1 AS ord
  FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4 UNION ALL SELECT * FROM c5 UNION ALL SELECT * FROM c6)),
banded AS (SELECT *, CASE WHEN check_id = 'formatting' THEN 'warn' WHEN score >= 80 THEN 'pass' WHEN score >= 60 THEN 'warn' ELSE 'fail' END AS status FROM checks),
overall AS (SELECT doc_id, posting_id, CAST(floor(sum(score * w) / sum(w)::DOUBLE + 0.5) AS INTEGER) AS overall_score FROM checks JOIN (VALUES ('keyword', 40), ('skills', 20), ('sections', 15), ('formatting', 10), ('quantified', 10), ('readability', 5)) AS v(check_id, w) USING (check_id) GROUP BY 1, 2),
weak AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, posting_id ORDER BY score, ord) AS INTEGER) AS sug_ord FROM banded WHERE score < 80),
"""


def lines(spark, d):
    return R.explode_lines(texts(spark, d))


def lexicon(spark):
    return R.lexicon(spark, HEADINGS, OTHERS)


def keywords(spark, d):
    return R.posting_keywords(S.postings(spark, d), STOP)


def hits(spark, d, where: str | None = None):
    body = texts(spark, d).select("doc_id", F.lower("text").alias("text")) if where is None else R.section_text(lines(spark, d), lexicon(spark), where)
    return R.keyword_match(S.pairs(spark, d), body, keywords(spark, d))


def checks(spark, d, pairs: DataFrame | None = None, fields: tuple[str, ...] = R.FIELDS):
    """The six checks of every pair, or of those given."""
    return R.score_documents(texts(spark, d), S.postings(spark, d), S.pairs(spark, d) if pairs is None else pairs, lexicon(spark), stopwords=STOP, fields=fields)


def one_check(name: str):
    return f"WITH {CHECKS} z AS (SELECT 1) SELECT doc_id, posting_id, score, status FROM banded WHERE check_id = '{name}'"


COLS = ["doc_id", "posting_id", "score", "status"]


@query(f"WITH {TEXTS} z AS (SELECT 1) SELECT doc_id, line_no, line FROM tl")
def q_explode_lines(spark, d):
    return lines(spark, d)


@query(f"WITH {TEXTS} z AS (SELECT 1) SELECT doc_id, line_no, heading FROM hd")
def q_normalize_heading(spark, d):
    return lines(spark, d).select("doc_id", "line_no", T.normalize_heading(F.col("line")).alias("heading"))


@query(f"WITH {TEXTS} z AS (SELECT 1) SELECT * FROM flags")
def q_detect_sections(spark, d):
    return R.detect_sections(lines(spark, d), lexicon(spark))


@query(f"WITH {TEXTS} z AS (SELECT 1) SELECT * FROM bl")
def q_bullet_lines(spark, d):
    return R.bullet_lines(lines(spark, d))


@query(f"WITH {TEXTS} z AS (SELECT 1) SELECT * FROM ab")
def q_achievement_bullets(spark, d):
    return R.achievement_bullets(lines(spark, d), lexicon(spark))


@query(f"WITH {TEXTS} sk AS {section_sql('skills')} SELECT * FROM sk")
def q_section_text(spark, d):
    return R.section_text(lines(spark, d), lexicon(spark), "skills")


@query("SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[,\\n|•·-]'), lambda i: regexp_replace(trim(i), '^[-*•·|]\\s*', '')), lambda i: length(i) >= 2)) AS INTEGER) AS items FROM documents")
def q_count_skill_items(spark, d):
    return S.texts(spark, d).select("doc_id", T.count_skill_items(F.col("text")).alias("items"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS n_words FROM documents")
def q_word_count(spark, d):
    return S.texts(spark, d).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query("SELECT item_id AS posting_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+.#-]*'), lambda t: regexp_replace(t, '[.]+$', '')), ' ') AS tokens FROM benchmark")
def q_posting_tokens(spark, d):
    return S.postings(spark, d).select("posting_id", F.array_join(T.posting_tokens(F.col("text")), " ").alias("tokens"))


@query(f"WITH {STOP_SQL} {KEYWORDS} z AS (SELECT 1) SELECT * FROM keywords")
def q_posting_keywords(spark, d):
    return keywords(spark, d)


@query(f"WITH {MATCH} hit AS ({hits_sql('low')}) SELECT * FROM hit")
def q_keyword_match(spark, d):
    return hits(spark, d)


@query(one_check("keyword"))
def q_check_keyword(spark, d):
    return R.check_keyword(texts(spark, d), S.postings(spark, d), S.pairs(spark, d), lexicon(spark), STOP).select(*COLS)


@query(one_check("skills"))
def q_check_skills(spark, d):
    skills = R.section_text(lines(spark, d), lexicon(spark), "skills")
    return R.check_skills(S.pairs(spark, d), S.postings(spark, d), keywords(spark, d), skills, hits(spark, d, "skills")).select(*COLS)


@query(one_check("sections"))
def q_check_sections(spark, d):
    return R.check_sections(S.pairs(spark, d), R.detect_sections(lines(spark, d), lexicon(spark))).select(*COLS)


@query(one_check("formatting"))
def q_check_formatting(spark, d):
    return R.check_formatting(S.pairs(spark, d), R.text_flags(texts(spark, d), lines(spark, d))).select(*COLS)


@query("SELECT doc_id, regexp_matches(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}') AS has_email FROM documents")
def q_has_email(spark, d):
    return S.texts(spark, d).select("doc_id", T.has_email(F.col("text")).alias("has_email"))


@query(f"WITH {CHECKS} z AS (SELECT 1) SELECT doc_id, has_phone FROM tf")
def q_has_phone(spark, d):
    return texts(spark, d).select("doc_id", T.has_phone(F.col("text")).alias("has_phone"))


@query(f"WITH {CHECKS} z AS (SELECT 1) SELECT doc_id, coalesce(has_table, false) AS has_table FROM docs LEFT JOIN tb USING (doc_id)")
def q_has_table(spark, d):
    return R.has_table(lines(spark, d))


@query(one_check("quantified"))
def q_check_quantified(spark, d):
    return R.check_quantified(S.pairs(spark, d), R.achievement_bullets(lines(spark, d), lexicon(spark))).select(*COLS)


@query(one_check("readability"))
def q_check_readability(spark, d):
    return R.check_readability(S.pairs(spark, d), R.text_flags(texts(spark, d), lines(spark, d)), R.detect_sections(lines(spark, d), lexicon(spark))).select(*COLS)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 2 >= 80 THEN 'pass' WHEN l_quantity * 2 >= 60 THEN 'warn' ELSE 'fail' END AS status FROM lineitem")
def q_status_band(spark, d):
    return S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.status_band(F.col("l_quantity") * 2).alias("status"))


@query(f"WITH {CHECKS} z AS (SELECT 1) SELECT * FROM overall")
def q_weighted_score(spark, d):
    return R.weighted_score(checks(spark, d))


@query(f"WITH {CHECKS} z AS (SELECT 1) SELECT doc_id, posting_id, overall_score, string_agg(check_id || '=' || score || ':' || status, ' ' ORDER BY ord) AS checks FROM banded JOIN overall USING (doc_id, posting_id) GROUP BY ALL")
def q_score_documents(spark, d):
    """The flagship: every document against its posting, six checks and their weighted score."""
    scored = checks(spark, d)
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("check_ord", "check_id", "score", "status"))), lambda c: F.concat(c["check_id"], F.lit("="), c["score"].cast("string"), F.lit(":"), c["status"])), " ")
    weight = F.coalesce(*(F.when(F.col("check_id") == c, w) for c, w in R.CHECK_WEIGHTS.items()))
    return scored.groupBy("doc_id", "posting_id").agg(T.rounded(F.sum(F.col("score") * weight) / F.sum(weight)).alias("overall_score"), told.alias("checks"))


@query(f"WITH {CHECKS} z AS (SELECT 1) SELECT doc_id, posting_id, check_id, score FROM banded WHERE score < 80")
def q_weak_checks(spark, d):
    return R.weak_checks(checks(spark, d), S.postings(spark, d)).select("doc_id", "posting_id", "check_id", "score")


@query(f"""WITH {CHECKS} pl AS (SELECT doc_id, arg_min(bullet, line_no) AS b FROM ab WHERE NOT regexp_matches(bullet, '[0-9]') GROUP BY doc_id)
SELECT doc_id, posting_id, sug_ord, 'sug-0' || sug_ord AS id, CASE WHEN score < 40 THEN 'high' WHEN score < 60 THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN check_id = 'quantified' THEN trim(left(trim(regexp_replace(regexp_replace(b, '^[-*•·●▪‣○◦■□◆◇►▸➢➤✓✔–»]\\s*', ''), '^[0-9]+[.)]\\s+', '')), 80)) END AS snippet FROM weak LEFT JOIN pl USING (doc_id) WHERE sug_ord <= 3""")
def q_rank_suggestions(spark, d):
    weak = R.weak_checks(checks(spark, d), S.postings(spark, d))
    return R.rank_suggestions(weak, R.achievement_bullets(lines(spark, d), lexicon(spark))).select("doc_id", "posting_id", "sug_ord", "id", "priority", "snippet")


def hidden_rows(spark, d):
    return R.hidden_suggestion(summarize_hidden(screened(spark, d)))


@query(f"SELECT doc_id, 'hidden-text' AS id, 'high' AS priority, 'Hidden text: ' || replace(reasons, ',', ', ') AS description FROM ({SUMMARY}) WHERE has_words")
def q_hidden_suggestion(spark, d):
    return hidden_rows(spark, d).select("doc_id", "id", "priority", "description")


FINDINGS = f"""WITH {SCREENED}
fu AS (SELECT doc_id, font_family AS family, bold, italic, font_size AS size, sum(chars) AS c, min(run_ord) AS fr FROM visible GROUP BY ALL), fo AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, fr) AS k FROM fu),
sz AS (SELECT doc_id, coalesce(arg_min(size, k) FILTER (WHERE NOT bold AND NOT italic), max(size)) AS body, max(size) AS title, bool_or(family = 'Times') AS times, max(size) FILTER (WHERE bold) AS bold_size FROM fo GROUP BY doc_id),
ln AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_number ORDER BY y DESC) AS line_no FROM visible), lt AS (SELECT doc_id, page_number, line_no, max(y) AS y, max(font_size) AS fs FROM ln GROUP BY ALL),
g AS (SELECT doc_id, (lag(y) OVER w - y) / greatest(lag(fs) OVER w, fs) AS r FROM lt WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_no)), a AS (SELECT doc_id, list_sort(list(r)) AS l FROM g WHERE r BETWEEN 0.5 AND 3 GROUP BY doc_id),
sp AS (SELECT doc_id, floor(l[CAST(floor(0.25 * (len(l) - 1)) AS BIGINT) + 1] * 100 + 0.5) / 100 AS spacing FROM a),
mg AS (SELECT doc_id, min(x) AS l, min(612 - x - width) AS r, min(792 - y) AS t, min(y) AS b FROM visible GROUP BY doc_id),
st AS (SELECT doc_id, floor(sum(CASE WHEN bold THEN chars ELSE 0 END)::DOUBLE / sum(chars) * 1000 + 0.5) / 1000 AS ratio FROM visible JOIN sz USING (doc_id) WHERE abs(font_size - body) <= 0.5 GROUP BY doc_id)
SELECT doc_id, unnest(list_filter([CASE WHEN times THEN 'typo-font-family' END, CASE WHEN title < 14 OR title > 16 THEN 'typo-title-size' END, CASE WHEN body < 10 OR body > 12 THEN 'typo-body-size' END,
  CASE WHEN spacing < 1.1 OR spacing > 1.45 THEN 'typo-line-spacing' END, CASE WHEN NOT (abs(l - 72) <= 18 AND abs(r - 72) <= 18 AND abs(t - 72) <= 18 AND abs(b - 72) <= 18) THEN 'typo-margins' END,
  CASE WHEN ratio > 0.3 THEN 'typo-bold-overuse' END, CASE WHEN title <> body AND coalesce(bold_size, 0) <> title THEN 'typo-bold-underuse' END], lambda x: x IS NOT NULL)) AS id
FROM sz LEFT JOIN sp USING (doc_id) LEFT JOIN mg USING (doc_id) LEFT JOIN st USING (doc_id)"""


@query(FINDINGS)
def q_typography_findings(spark, d):
    return R.typography_findings(typography(spark, d)).select("doc_id", "id")


@query(f"""WITH {CHECKS} hid AS (SELECT doc_id FROM ({SUMMARY}) WHERE has_words), fi AS ({FINDINGS}),
told AS (SELECT doc_id, posting_id, 0 AS part, 0 AS o, 'hidden-text' AS id FROM pairs JOIN hid USING (doc_id) UNION ALL SELECT doc_id, posting_id, 1, sug_ord, 'sug-0' || sug_ord FROM weak WHERE sug_ord <= 3
  UNION ALL SELECT doc_id, posting_id, 2, list_position(['typo-font-count', 'typo-font-family', 'typo-title-size', 'typo-body-size', 'typo-line-spacing', 'typo-margins', 'typo-bold-overuse', 'typo-italic-overuse', 'typo-bold-underuse'], id), id FROM pairs JOIN fi USING (doc_id)),
sgs AS (SELECT doc_id, posting_id, string_agg(id, ' ' ORDER BY part, o) AS suggestions FROM told GROUP BY ALL),
scs AS (SELECT doc_id, posting_id, string_agg(check_id || '=' || score || ':' || status, ' ' ORDER BY ord) AS checks FROM banded GROUP BY ALL)
SELECT doc_id, posting_id, checks, overall_score, coalesce(suggestions, '') AS suggestions FROM scs JOIN overall USING (doc_id, posting_id) LEFT JOIN sgs USING (doc_id, posting_id)""")
def q_assemble_report(spark, d):
    """Checks, suggestions, hidden text and typography in one row a pair."""
    scored = checks(spark, d).persist()  # read for the ranking and for the report
    ranked = R.rank_suggestions(R.weak_checks(scored, S.postings(spark, d)), R.achievement_bullets(lines(spark, d), lexicon(spark)))
    report = R.assemble_report(scored, ranked, hidden_rows(spark, d), R.typography_findings(typography(spark, d)))
    told = F.array_join(F.transform("checks", lambda c: F.concat(c["id"], F.lit("="), c["score"].cast("string"), F.lit(":"), c["status"])), " ")
    return report.select("doc_id", "posting_id", told.alias("checks"), "overall_score", F.array_join("suggestion_ids", " ").alias("suggestions"))


@query(f"WITH {CHECKS} z AS (SELECT 1) SELECT doc_id, check_id, check_id || ' hat ' || score || ' Punkte (' || score || ')' AS rendered FROM checks")
def q_render_text(spark, d):
    """Templates with repeated places over all check rows."""
    templates = spark.createDataFrame([("score", "de", "{0} hat {1} Punkte ({1})"), ("score", "en", "{0} has {1} points")], "key string, language string, template string")
    rows = checks(spark, d).select("doc_id", "check_id", F.lit("score").alias("key"), F.array(F.col("check_id"), F.col("score").cast("string")).alias("values"))
    return R.render_text(rows, templates, "de").select("doc_id", "check_id", "rendered")


MESSAGES = Messages({"en": {"keywords": "{name}: {count:number} words. Look for {items:list}."}, "id": {"keywords": "{name}: {count:number} kata. Cari {items:list}. {other}"}})


@query(
    f"""WITH {STOP_SQL} {KEYWORDS}
k AS (SELECT posting_id, count(*) AS n, string_agg(keyword, ', ' ORDER BY kw_ord) FILTER (WHERE kw_ord <= 15) AS shown FROM keywords GROUP BY posting_id),
v AS (SELECT doc_id, lang, doc_id * 987.25::DOUBLE AS x, doc_id % (SELECT count(*) FROM benchmark) AS posting_id, unnest(['en', 'id']) AS language FROM documents),
t AS (SELECT v.*, format('{{:,d}}', CAST(floor(x) AS BIGINT)) AS whole, rtrim(lpad(CAST(CAST((x - floor(x)) * 100 AS INTEGER) AS VARCHAR), 2, '0'), '0') AS part, coalesce(shown, '') AS shown, coalesce(n, 0) AS n FROM v LEFT JOIN k USING (posting_id)),
w AS (SELECT *, CASE language WHEN 'en' THEN whole || CASE part WHEN '' THEN '' ELSE '.' || part END ELSE replace(whole, ',', '.') || CASE part WHEN '' THEN '' ELSE ',' || part END END AS num,
  shown || CASE WHEN n <= 15 THEN '' WHEN language = 'en' THEN ', and ' || (n - 15) || ' more' ELSE ', dan ' || (n - 15) || ' lainnya' END AS items FROM t)
SELECT doc_id, language, lang || CASE language WHEN 'en' THEN ': ' || num || ' words. Look for ' || items || '.' ELSE ': ' || num || ' kata. Cari ' || items || '. {{other}}' END AS message FROM w"""
)
def q_render_messages(spark, d):
    """Every document's posting keywords, cut and counted, in both languages."""
    listed = keywords(spark, d).groupBy("posting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("kw_ord", "keyword"))), lambda k: k["keyword"]).alias("items"))
    rows = S.pairs(spark, d).join(listed, "posting_id", "left").join(S.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumn("language", F.explode(F.array(F.lit("en"), F.lit("id"))))
    lists = F.create_map(F.lit("items"), F.coalesce("items", F.array().cast("array<string>")))
    told = message(MESSAGES, F.lit("keywords"), F.col("language"), F.create_map(F.lit("name"), F.col("lang")), F.create_map(F.lit("count"), F.col("doc_id") * 987.25), lists)
    return rows.select("doc_id", "language", told.alias("message"))
