"""Queries over the engine's operators, each with the SQL that gives the same rows in another engine where there is one.

The tables hold no CVs, so CV lines, plans, words and images are made from them by the same expressions on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions import patterns as P
from veilwork.functions import predicates as Q
from veilwork.functions import spans as S
from veilwork.operators import audit, layout, names, redaction
from veilwork.plans import plan as plans
from veilwork.sources import files

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def re2(pattern: str) -> str:
    """A pattern in RE2's dialect, as an SQL string; for texts on which the dialects agree."""
    p = pattern.replace("(?iUd)", "(?i)").replace("(?Ud)", "").replace("(?U)", "").replace(r"\s\x1C-\x1F", r"\s").replace(r"\x00", "")
    return "'" + p.replace("'", "''") + "'"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- synthetic inputs, in SQL that both engines read

_KEY = "CAST(c_custkey AS STRING)"
_LINES = [
    "c_name || ' Rowe | Software Engineer'",
    f"'user' || {_KEY} || '@mail.example.com | +91 98' || lpad({_KEY}, 8, '0') || ' | ' || CASE c_nationkey % 4 WHEN 0 THEN 'Pune' WHEN 1 THEN 'Navi Mumbai' WHEN 2 THEN 'Indore' ELSE 'Jaipur' END || ', MH | LinkedIn'",
    "CASE c_custkey % 5 WHEN 0 THEN 'Date of Birth: 01/02/1990' WHEN 1 THEN 'Nationality: Indian | Gender: Female 28' WHEN 2 THEN 'Flat No 12, Green Colony, Pune 411001' WHEN 3 THEN '12/4 MG Road, Thane' ELSE '14 March 1991' END",
    "CASE c_custkey % 3 WHEN 0 THEN 'PROFESSIONAL SUMMARY' WHEN 1 THEN 'Education of a whole town' ELSE 'Work Experience' END",
    "CASE c_custkey % 2 WHEN 0 THEN 'Managed MP AS rollout 2018 - 2022 2023 at Northwind Ltd, Nagpur' ELSE 'Moved to Bhopal, MP in 2019, then 560001' END",
    f"CASE c_custkey % 2 WHEN 0 THEN 'linkedin.com/in/user' || {_KEY} || ' and https://example.org/u' || {_KEY} ELSE 'Node.js and ASP.NET' END",
    "CASE c_custkey % 6 WHEN 0 THEN 'LinkedIn | GitHub:' WHEN 1 THEN 'PHONE' WHEN 2 THEN 'Profile' WHEN 3 THEN '|' WHEN 4 THEN 'D A T A' ELSE 'LinkedIn | E-mail | GitHub' END",
    "CASE c_custkey % 4 WHEN 0 THEN 'Mysore College of Sample Studies' WHEN 1 THEN 'Visit My Website' WHEN 2 THEN 'View Certificate' ELSE 'Led a team of engineers who built a data platform for the retail group, Rowe' END",
]
_CV = f"cv AS (SELECT doc_id, CAST(i AS INT) AS idx, l[i + 1] AS text FROM (SELECT c_custkey AS doc_id, [{', '.join(_LINES)}] AS l, unnest(range({len(_LINES)})) AS i FROM customer))"


def cv_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey AS doc_id", f"posexplode(array({', '.join(_LINES)})) AS (idx, text)")


_WORDS = """words AS (SELECT conv_id AS doc_id, CAST(turn AS INT) AS page, CAST(n // 40 AS INT) AS block, CAST(n // 8 AS INT) AS line, CAST(n % 8 AS INT) AS word_no,
 50.0 * (n % 8) AS x0, 12.0 * (n // 8) AS y0, 50.0 * (n % 8) + 6.0 * length(t) AS x1, 12.0 * (n // 8) + 10.0 AS y1, t AS text
 FROM (SELECT conv_id, turn, unnest(w) AS t, unnest(range(len(w))) AS n FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations)))"""


def words_of(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("n", "text"))
    n = F.col("n")
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.floor(n / 40).cast("int").alias("block"), F.floor(n / 8).cast("int").alias("line"), (n % 8).cast("int").alias("word_no"), (F.lit(50.0) * (n % 8)).alias("x0"), (F.lit(12.0) * F.floor(n / 8)).alias("y0"), (F.lit(50.0) * (n % 8) + 6.0 * F.char_length("text")).alias("x1"), (F.lit(12.0) * F.floor(n / 8) + 10.0).alias("y1"), "text")


_PLAN = """plan AS (SELECT 'cv_' || CAST(s_suppkey AS STRING) || '.docx' AS filename,
 CASE WHEN s_suppkey % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['Rowe', 'Van ' || CAST(s_suppkey AS STRING)] END AS surnames,
 'Ada' || CAST(s_suppkey // 2 AS STRING) || '_Redacted.docx' AS output_name FROM supplier WHERE s_suppkey % 3 <> 0)"""
_FILES = "files AS (SELECT 'cv_' || CAST(s_suppkey AS STRING) || '.docx' AS filename, s_suppkey AS n FROM supplier)"


def plan_of(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").filter(k % 3 != 0).select(F.concat(F.lit("cv_"), k, F.lit(".docx")).alias("filename"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Rowe"), F.concat(F.lit("Van "), k.cast("string")))).alias("surnames"), F.concat(F.lit("Ada"), F.floor(k / 2), F.lit("_Redacted.docx")).alias("output_name"))


def files_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.concat(F.lit("cv_"), "s_suppkey", F.lit(".docx")).alias("filename"), F.col("s_suppkey").alias("n"))


_IMAGES = """images AS (SELECT p_partkey % 20 AS doc_id, CAST(p_partkey % 3 AS INT) AS page, CAST(p_partkey AS INT) AS pos, CAST(p_partkey // 2 AS INT) AS xref,
 CAST(p_partkey * 7 % 900 AS INT) AS width, CAST(p_partkey * 13 % 700 AS INT) AS height, (p_partkey % 10) / 10.0::DOUBLE AS page_fraction FROM part)"""


def images_of(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select((k % 20).alias("doc_id"), (k % 3).cast("int").alias("page"), k.cast("int").alias("pos"), F.floor(k / 2).cast("int").alias("xref"), (k * 7 % 900).cast("int").alias("width"), (k * 13 % 700).cast("int").alias("height"), ((k % 10) / F.lit(10.0)).alias("page_fraction"))


_PHOTO = "(width >= 150 AND height >= 150 AND width * 1.0 / height BETWEEN 0.5 AND 2.0 AND NOT page_fraction > 0.8)"


# --- patterns over the tables' own texts


def _values(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    found = F.transform(S.matches(S.clean(F.col(text)), pattern), lambda m: m["text"])
    return df.filter(F.col(text).rlike(pattern)).select(key, F.explode(found).alias("value"))


def _values_sql(source: str, key: str, text: str, pattern: str, cte: str = "") -> str:
    return f"{'WITH ' + cte if cte else ''} SELECT {key}, unnest(regexp_extract_all({text}, {re2(pattern)})) AS value FROM {source}"


@query(_values_sql("documents", "doc_id", "text", P.EMAIL))
def email_extract(spark, d):
    return _values(table(spark, d, "documents"), "doc_id", "text", P.EMAIL)


@query(_values_sql("pages", "page_id", "html", P.URL))
def url_extract_pages(spark, d):
    return _values(table(spark, d, "pages"), "page_id", "html", P.URL)


_PHONES = f"""list_filter(regexp_extract_all(text, {re2(P.PHONE_CANDIDATE)}), lambda x: len(regexp_replace(x, '\\D', '', 'g')) BETWEEN 10 AND 15 AND NOT
 (regexp_full_match(x, '[\\d\\s\\-.]+') AND len(regexp_replace(x, '\\D', '', 'g')) <= 12 AND len(regexp_extract_all(x, {re2(P.YEAR)})) >= 2))"""


@query(f"SELECT doc_id, unnest({_PHONES}) AS value FROM documents")
def phone_filter(spark, d):
    text = S.clean(F.col("text"))
    docs = table(spark, d, "documents").filter(F.col("text").rlike(P.PHONE_CANDIDATE))
    return docs.select("doc_id", F.explode(F.transform(Q.phone_spans(text), lambda m: F.substring(text, m["s"] + 1, m["e"] - m["s"]))).alias("value"))


def _cv_pattern(name: str, pattern: str) -> None:
    def f(spark, d):
        return _values(cv_lines(spark, d), "doc_id", "text", pattern)

    f.__name__ = name
    query(_values_sql("cv", "doc_id", "text", pattern, _CV))(f)


for _name, _rx in (("dob_lines", P.DOB), ("personal_field_lines", P.PERSONAL_LINE), ("gender_age", P.GENDER_AGE), ("pin_codes", P.PIN), ("cv_urls", P.URL), ("cv_emails", P.EMAIL), ("link_in_bytes", P.LINK_IN_BYTES), ("email_in_bytes", P.EMAIL_IN_BYTES)):
    _cv_pattern(_name, _rx)


def _cv_flag(name: str, column: Callable, sql: str) -> None:
    def f(spark, d):
        return cv_lines(spark, d).select("doc_id", "idx", column(S.clean(F.col("text"))).alias("flag"))

    f.__name__ = name
    query(f"WITH {_CV} SELECT doc_id, idx, {sql} AS flag FROM cv")(f)


def _m(pattern: str, x: str = "text") -> str:
    return f"regexp_matches({x}, {re2(pattern)})"


_ADDRESS = f"(length(text) <= 80 AND regexp_matches(text, '\\d') AND ({_m(P.STREET)} OR ({_m(P.PIN)} AND (contains(text, ',') OR {_m(P.CITY)})) OR ({_m(P.ADDRESS_NUM)} AND contains(text, ','))))"
_ROW = f"({_m(P.CONTACT_HINT)} OR {_m(P.STREET)})"
_TOKENS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
_ALNUMS = r"len(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
_GLYPH = lambda x: f"({_ALNUMS.format(x=x)} < 2 AND NOT regexp_matches({x}, '\\d'))"
_LABEL = lambda x: f"({_m(P.CONTACT_PLATFORM, x)} OR {_m(P.CONTACT_HEAD, x)} OR ({_m(P.CONTACT_LABEL, x)} AND NOT regexp_matches({x}, '^[\\p{{L}}\\p{{N}}]+$')))"
_LABEL_LINE = f"(len({_TOKENS}) > 0 AND len(list_filter({_TOKENS}, lambda x: NOT ({_GLYPH('x')} OR {_LABEL('x')}))) = 0 AND (len(list_filter({_TOKENS}, lambda x: NOT {_GLYPH('x')})) > 0 OR len({_TOKENS}) <= 3))"
_ANCHOR = "list_filter(regexp_split_to_array(text, '[^A-Za-z0-9]+'), lambda x: x <> '')"

for _name, _column, _sql in (
    ("street_lines", lambda t: Q.has(t, P.STREET), _m(P.STREET)),
    ("address_whole_line", lambda t: Q.address_like(t, F.lit(False)), _ADDRESS),
    ("contact_row_flag", Q.contact_row, _ROW),
    ("label_line_flag", Q.label_line, _LABEL_LINE),
    ("link_label_only", Q.link_label_only, f"(len({_ANCHOR}) > 0 AND len(list_filter({_ANCHOR}, lambda x: NOT ({_m(P.CONTACT_PLATFORM, 'x')} OR {_m(P.CONTACT_LABEL, 'x')} OR {_m(P.LINK_FILLER, 'x')}))) = 0)"),
    ("section_heading_flag", Q.section_head, _m(P.SECTION_HEAD)),
    ("expected_loss_flag", Q.expected_loss, _m(P.CONTACT_LINE)),
    ("boilerplate_flag", lambda t: Q.has(t, P.BOILERPLATE), _m(P.BOILERPLATE)),
    ("org_suffix_flag", lambda t: Q.has(t, P.ORG_SUFFIX), _m(P.ORG_SUFFIX)),
    ("state_codes_need_comma", lambda t: F.contains(t, F.lit(",")) & Q.has(t, P.STATE_ABBR), f"(contains(text, ',') AND regexp_matches(text, '(^|[^A-Za-z])({'|'.join(P.STATE_CODES)})([^A-Za-z]|$)'))"),
):
    _cv_flag(_name, _column, _sql)


@query(f"WITH {_CV}, t AS (SELECT doc_id, idx, unnest({_TOKENS}) AS token FROM cv) SELECT doc_id, idx, token, {_m(P.TITLE_WORD, 'trim(token, $$.,:;|()$$)')} AS flag FROM t")
def title_word_flag(spark, d):
    return cv_lines(spark, d).select("doc_id", "idx", F.explode(F.filter(F.split("text", r"\s+"), lambda t: t != "")).alias("token")).withColumn("flag", Q.title_word(F.col("token")))


@query(f"WITH {_CV}, t AS (SELECT doc_id, idx, unnest({_TOKENS}) AS token FROM cv) SELECT doc_id, idx, token, ({_ALNUMS.format(x='token')} > 1 OR regexp_matches(token, '\\d') OR lower(trim(token, '.,:;|()')) IN ('i', 'a')) AS flag FROM t")
def word_flag(spark, d):
    return cv_lines(spark, d).select("doc_id", "idx", F.explode(F.filter(F.split("text", r"\s+"), lambda t: t != "")).alias("token")).withColumn("flag", Q.is_word(F.col("token")))


# --- spans: in SQL, matches are put between marks and lengths are summed, as no function gives all offsets


def _spans_sql(pattern: str, cte: str, source: str, keys: str, then: str) -> str:
    return f"""WITH {cte}, a AS (SELECT {keys}, text, string_split(regexp_replace(text, '(' || {re2(pattern)} || ')', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM {source} WHERE regexp_matches(text, {re2(pattern)})),
 b AS (SELECT {keys}, text, p, unnest(range(1, len(p), 2)) AS k FROM a),
 found AS (SELECT {keys}, text, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) AS BIGINT) AS s, CAST(list_sum(list_transform(p[1:k + 1], lambda x: length(x))) AS BIGINT) AS e, p[k + 1] AS value FROM b) {then}"""


@query(_spans_sql(P.URL, _CV, "cv", "doc_id, idx", "SELECT doc_id, idx, s, e, value FROM found"))
def span_offsets(spark, d):
    return cv_lines(spark, d).select("doc_id", "idx", F.explode(S.matches(S.clean(F.col("text")), P.URL)).alias("m")).select("doc_id", "idx", F.col("m.s").cast("long").alias("s"), F.col("m.e").cast("long").alias("e"), F.col("m.text").alias("value"))


@query(_spans_sql(P.CITY, _CV, "cv", "doc_id, idx", f"SELECT doc_id, idx, s, e FROM found WHERE NOT regexp_matches(substring(text, CAST(e AS INT) + 1, 16), {re2(P.ORG_SUFFIX)})"))
def city_spans(spark, d):
    places = F.filter(Q.city_spans(S.clean(F.col("text"))), lambda m: m["kind"] == "CITY")
    return cv_lines(spark, d).select("doc_id", "idx", F.explode(places).alias("m")).select("doc_id", "idx", F.col("m.s").cast("long").alias("s"), F.col("m.e").cast("long").alias("e"))


@query(f"WITH {_CV} SELECT doc_id, idx, regexp_replace(text, {re2(P.EMAIL)}, '', 'g') AS redacted FROM cv")
def masked_text(spark, d):
    line = S.clean(F.col("text"))
    return cv_lines(spark, d).select("doc_id", "idx", S.deleted(S.mask(line, S.spans(line, P.EMAIL, "EMAIL"))).alias("redacted"))


@query(f"WITH {_CV}, c AS (SELECT doc_id, idx, unnest(regexp_extract_all(regexp_replace(text, {re2(P.EMAIL)}, chr(1), 'g'), '[^\\s\\x01]+')) AS chunk FROM cv) SELECT doc_id, idx, chunk FROM c")
def surviving_chunks(spark, d):
    line = S.clean(F.col("text"))
    return cv_lines(spark, d).select("doc_id", "idx", F.explode(S.chunks(S.mask(line, S.spans(line, P.EMAIL, "EMAIL")))).alias("c")).select("doc_id", "idx", F.col("c.text").alias("chunk"))


@query(f"WITH {_CV} SELECT doc_id, idx, regexp_replace(text, '(^|[^A-Za-z])rowe($|[^A-Za-z])', '\\1\\2', 'gi') AS redacted FROM cv")
def surname_redaction(spark, d):
    line = S.clean(F.col("text"))
    return cv_lines(spark, d).select("doc_id", "idx", S.deleted(S.mask(line, S.spans(line, S.surname_pattern(F.array(F.lit("Rowe"))), "NAME"))).alias("redacted"))


def _redacted(spark, d) -> DataFrame:
    lines = layout.header_flags(cv_lines(spark, d).withColumn("page", F.lit(0)))
    return redaction.redact_lines(lines.withColumn("tokens", F.array(F.lit("Rowe"))))


@query()
def redacted_lines(spark, d):
    return _redacted(spark, d).select("doc_id", "idx", "redacted", F.size("decision.spans").cast("long").alias("n_spans"), F.col("decision.whole").alias("whole"))


@query(f"WITH {_CV}, h AS (SELECT *, max(CAST({_m(P.SECTION_HEAD)} AS INT)) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) = 0 AND idx < 25 AS top FROM cv) SELECT doc_id, idx, top AND ({_LABEL_LINE}) AND NOT {_ROW} AS gone FROM h")
def label_lines_gone(spark, d):
    return _redacted(spark, d).select("doc_id", "idx", (F.col("top") & F.col("decision.whole") & Q.label_line(F.col("text")) & ~Q.contact_row(F.col("text"))).alias("gone"))


@query()
def residue_sweep(spark, d):
    rows = cv_lines(spark, d).withColumn("first", F.split_part("text", F.lit(" "), F.lit(1)))
    return redaction.redact_lines(rows.withColumn("header", F.lit(True))).select("doc_id", "idx", "redacted")


@query()
def documents_redacted(spark, d):
    """Every line of every document, whole; those that a search for any trace finds nothing in don't pay for the decision."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(audit.lines_in(F.col("text"))).alias("idx", "text"))
    return redaction.redact_lines(lines).filter(F.size("decision.spans") > 0).select("doc_id", "idx", "redacted")


@query(f"WITH {_CV} SELECT doc_id, idx, max(CAST({_m(P.SECTION_HEAD)} AS INT)) OVER w = 0 AND idx < 10 AS header, max(CAST({_m(P.SECTION_HEAD)} AS INT)) OVER w = 0 AND idx < 25 AS top FROM cv WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)")
def header_flags_window(spark, d):
    return layout.header_flags(cv_lines(spark, d).withColumn("page", F.lit(0))).select("doc_id", "idx", "header", "top")


@query(f"WITH {_CV} SELECT doc_id, idx, max(CAST({_m(P.SECTION_HEAD)} AS INT)) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) = 0 AND idx < 8 AS header FROM cv")
def docx_header_window(spark, d):
    return layout.docx_header_flags(cv_lines(spark, d).withColumn("part", F.lit("document"))).select("doc_id", "idx", "header")


# --- words


@query(f"WITH {_WORDS}, l AS (SELECT doc_id, page, block, line, string_agg(text, ' ' ORDER BY x0, word_no) || ' ' AS text, min(y0) AS y, min(x0) AS x FROM words GROUP BY ALL) SELECT doc_id, page, block, line, text, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y, x, block, line) - 1 AS BIGINT) AS idx FROM l".replace("GROUP BY ALL", "GROUP BY doc_id, page, block, line"))
def line_grouping(spark, d):
    return layout.lines_of(words_of(spark, d)).select("doc_id", "page", "block", "line", "text", F.col("idx").cast("long").alias("idx"))


@query(f"WITH {_WORDS} SELECT doc_id, page, line, word_no, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page, block, line ORDER BY x0, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM words")
def running_offsets(spark, d):
    return layout.running_offsets(words_of(spark, d)).select("doc_id", "page", "line", "word_no", "text", "s")


_OFFSETS = f"{_WORDS}, o AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page, block, line ORDER BY x0, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM words)"


@query(f"WITH {_OFFSETS} SELECT doc_id, page, line, word_no FROM o WHERE s < 30 + page AND 12 < s + length(text)")
def word_span_overlap_semi(spark, d):
    words = layout.running_offsets(words_of(spark, d)).withColumn("e", F.col("s") + F.char_length("text"))
    found = words.select("doc_id", "page", "line").distinct().select("doc_id", "page", "line", F.explode(F.array(F.struct(F.lit(12).alias("s"), F.lit(20).alias("e")), F.struct(F.lit(18).alias("s"), (F.lit(30) + F.col("page")).alias("e")))).alias("x")).select("doc_id", "page", "line", "x.s", "x.e")
    return layout.struck_words(words, found, ("doc_id", "page", "line")).select("doc_id", "page", "line", "word_no")


@query(f"WITH {_WORDS} SELECT doc_id, page, line, word_no FROM words WHERE (x0 + x1) / 2 BETWEEN 40 AND 170 AND (y0 + y1) / 2 BETWEEN 10 AND 40 + page")
def point_in_rect_semi(spark, d):
    words = words_of(spark, d)
    rects = words.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(40.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(170.0).alias("x1"), (F.lit(40.0) + F.col("page")).alias("y1"))
    return layout.words_in_rects(words, rects).select("doc_id", "page", "line", "word_no")


@query(f"WITH {_WORDS} SELECT doc_id, page, line, min(x0) - 1 AS band_x0, max(y1) - 1 AS band_y0, max(x1) + 1 AS band_x1, max(y1) + 4 AS band_y1 FROM words WHERE length(text) > 6 GROUP BY doc_id, page, block, line")
def underline_bands(spark, d):
    return layout.underline_bands(words_of(spark, d).filter(F.char_length("text") > 6)).select("doc_id", "page", "line", "band_x0", "band_y0", "band_x1", "band_y1")


@query(f"""WITH {_WORDS}, g AS (SELECT *, lag(line) OVER w AS pl, right(lag(text) OVER w, 1) AS pe FROM words WINDOW w AS (PARTITION BY doc_id, page, block ORDER BY line, word_no))
 SELECT doc_id, page, block, string_agg(CASE WHEN pl IS NOT NULL AND (pl = line OR contains(')],;:!?"''', pe)) THEN ' ' ELSE '' END || text, '' ORDER BY line, word_no) AS text FROM g GROUP BY doc_id, page, block""")
def wrapped_line_join(spark, d):
    return layout.wrapped_text(words_of(spark, d)).select("doc_id", "page", "block", "text")


@query(f"WITH {_WORDS} SELECT doc_id, page, line, word_no, y0 + 2.0 AS box_y0, y1 - 2.0 AS box_y1 FROM words")
def redaction_boxes(spark, d):
    return layout.inset_boxes(words_of(spark, d)).select("doc_id", "page", "line", "word_no", "box_y0", "box_y1")


@query(f"WITH {_WORDS} SELECT doc_id, page, line, word_no, CASE WHEN x0 < 100 THEN 0 WHEN x0 < 300 AND 90 < x1 THEN 1 END::BIGINT AS pos FROM words")
def first_font_span(spark, d):
    words = words_of(spark, d)
    fonts = words.select("doc_id", "page").distinct().select("doc_id", "page", F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(a).alias("x0"), F.lit(-1.0).alias("y0"), F.lit(b).alias("x1"), F.lit(1e9).alias("y1"), F.lit(10.0).alias("size"), F.lit(255).alias("color")) for i, a, b in ((0, -1.0, 100.0), (1, 90.0, 300.0))])).alias("f")).select("doc_id", "page", "f.*")
    return layout.first_font_span(words, fonts).select("doc_id", "page", "line", "word_no", F.col("font.pos").cast("long").alias("pos"))


@query("SELECT p_partkey, ((p_partkey * 7919 >> 16) & 255) / 255.0::DOUBLE AS r, ((p_partkey * 7919 >> 8) & 255) / 255.0::DOUBLE AS g, (p_partkey * 7919 & 255) / 255.0::DOUBLE AS b FROM part")
def rgb_unpack(spark, d):
    return table(spark, d, "part").select("p_partkey", layout.rgb(F.col("p_partkey") * 7919).alias("c")).select("p_partkey", "c.r", "c.g", "c.b")


# --- plans and joins


@query(f"WITH {_FILES}, {_PLAN} SELECT f.filename, coalesce(p.surnames, []) AS surnames, coalesce(p.output_name, f.filename) AS output_name, p.filename IS NOT NULL AS mapped FROM files f LEFT JOIN plan p USING (filename)")
def plan_left_join(spark, d):
    return plans.with_plan(files_of(spark, d), plan_of(spark, d)).select("filename", "surnames", "output_name", "mapped")


@query(f"WITH {_FILES}, {_PLAN} SELECT filename FROM files ANTI JOIN plan USING (filename)")
def unmapped_anti(spark, d):
    return plans.unmapped(files_of(spark, d), plan_of(spark, d)).select("filename")


@query(f"WITH {_FILES}, {_PLAN} SELECT f.filename FROM files f LEFT JOIN plan p USING (filename) WHERE len(coalesce(p.surnames, [])) = 0")
def unmapped_without_tokens(spark, d):
    return plans.without_tokens(plans.with_plan(files_of(spark, d), plan_of(spark, d))).select("filename")


@query(f"WITH {_PLAN}, back AS (SELECT output_name, max(filename) AS source FROM plan GROUP BY output_name) SELECT o.filename, b.source FROM (SELECT DISTINCT 'Ada' || CAST(s_suppkey AS STRING) || '_Redacted.docx' AS filename FROM supplier) o LEFT JOIN back b ON o.filename = b.output_name")
def reverse_map_join(spark, d):
    outputs = table(spark, d, "supplier").select(F.concat(F.lit("Ada"), "s_suppkey", F.lit("_Redacted.docx")).alias("filename")).distinct()
    return plans.by_output(outputs, plan_of(spark, d)).select("filename", "source")


@query(f"WITH {_PLAN} SELECT filename, split_part(split_part(output_name, '_', 1), '.', 1) AS first FROM plan")
def first_name_of_output(spark, d):
    return plan_of(spark, d).select("filename", plans.first_name_of(F.col("output_name")).alias("first"))


@query(f"WITH {_CV}, t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM cv) SELECT doc_id, token, trim(lower(token), '.,:;|') = 'rowe' AS kept FROM t")
def first_name_kept(spark, d):
    tokens = cv_lines(spark, d).select("doc_id", F.explode(F.split("text", r"\s+")).alias("token"))
    return tokens.select("doc_id", "token", Q.is_kept(F.col("token"), F.lit("Rowe")).alias("kept"))


_NAMES = "(SELECT c_custkey, replace(c_name, '#', '_') || CASE c_custkey % 3 WHEN 0 THEN '_Rowe_Resume.final.pdf' WHEN 1 THEN ' van Dyke (CV).docx' ELSE '-ada-rowe-2023.pdf' END AS name FROM customer)"


def _names(spark, d) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey", "replace(c_name, '#', '_') || CASE c_custkey % 3 WHEN 0 THEN '_Rowe_Resume.final.pdf' WHEN 1 THEN ' van Dyke (CV).docx' ELSE '-ada-rowe-2023.pdf' END AS name")


@query(f"SELECT c_custkey, list_filter(list_filter(regexp_split_to_array(regexp_replace(name, '\\.[^.]*$', ''), '[\\s_\\-.()\\[\\]]+'), lambda x: x <> '')[2:], lambda w: length(w) > 2 AND NOT list_contains({P.NOISE_WORDS!r}, lower(w)) AND NOT regexp_matches(w, '\\d')) AS surnames FROM {_NAMES}")
def suggest_surnames(spark, d):
    return _names(spark, d).select("c_custkey", plans.suggest_surnames(F.col("name")).alias("surnames"))


@query(f"SELECT c_custkey, regexp_extract(name, '^[^\\s_\\-.]+') || '_Redacted' || lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS output_name FROM {_NAMES}")
def output_name(spark, d):
    return _names(spark, d).select("c_custkey", plans.suggest_output_name(F.col("name")).alias("output_name"))


@query("SELECT n_nationkey, 'x.pdf' AS name FROM nation")
def safe_upload_names(spark, d):
    return table(spark, d, "nation").select("n_nationkey", plans.safe_name(F.concat(F.lit("../../"), "n_name", F.lit("/x.pdf"))).alias("name"))


@query("SELECT filename, output_name FROM (SELECT n_regionkey::VARCHAR || '.docx' AS filename, max(n_nationkey)::VARCHAR || '_out.docx' AS output_name, max(n_nationkey) FROM nation GROUP BY n_regionkey)")
def plan_json_parse(spark, d):
    one = F.struct(F.concat(F.col("n_regionkey").cast("string"), F.lit(".docx")).alias("filename"), F.array(F.lit("Rowe")).alias("surnames"), F.concat(F.col("n_nationkey").cast("string"), F.lit("_out.docx")).alias("output_name"))
    raw = table(spark, d, "nation").groupBy().agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("p")))), lambda x: x["p"])).alias("raw"))
    return plans.parse_plans(raw).select("filename", "output_name")


@query("SELECT s_suppkey, CAST(CASE s_suppkey % 4 WHEN 0 THEN s_suppkey WHEN 1 THEN 25 WHEN 2 THEN 25 ELSE -s_suppkey END AS BIGINT) AS setting FROM supplier")
def env_int_parse(spark, d):
    raw = "CASE s_suppkey % 4 WHEN 0 THEN ' ' || s_suppkey || ' ' WHEN 1 THEN '' WHEN 2 THEN 'x' || s_suppkey ELSE '-' || s_suppkey END AS raw"
    return table(spark, d, "supplier").selectExpr("s_suppkey", raw).select("s_suppkey", files.int_setting_column(F.col("raw"), 25).cast("long").alias("setting"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey > 50 THEN 'too large' WHEN s_suppkey % 2 = 0 THEN 'unsupported type' END AS error FROM supplier")
def upload_limits(spark, d):
    rows = table(spark, d, "supplier").selectExpr("s_suppkey", "s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.txt' ELSE '.PDF' END AS filename", "CASE WHEN s_suppkey > 50 THEN 30000000 ELSE 10 END AS length")
    return files.upload_errors(rows).select("s_suppkey", "error")


# --- images and OCR


@query(f"WITH {_IMAGES} SELECT doc_id, pos, coalesce({_PHOTO}, false) AS photo FROM images")
def photo_shape_filter(spark, d):
    return images_of(spark, d).select("doc_id", "pos", Q.photo_shaped(F.col("width"), F.col("height"), F.col("page_fraction")).alias("photo"))


@query(f"""WITH {_IMAGES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, xref ORDER BY page, pos) AS nth FROM images WHERE width > 0 AND height > 0),
 r AS (SELECT doc_id, xref, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_PHOTO} DESC, width * height DESC, page, pos, xref) AS BIGINT) AS rank FROM o WHERE nth = 1) SELECT * FROM r WHERE rank <= 24""")
def image_topk24(spark, d):
    return layout.images_shown(images_of(spark, d)).select("doc_id", "xref", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_IMAGES} SELECT doc_id, xref, page, pos FROM images WHERE xref IN (3, 4, 5)")
def photo_rects(spark, d):
    wanted = images_of(spark, d).select("doc_id").distinct().withColumn("photo_xrefs", F.array(*map(F.lit, (3, 4, 5, 3))))
    return layout.photo_rects(wanted, images_of(spark, d)).select("doc_id", "xref", "page", "pos")


@query("""WITH b AS (SELECT p_partkey, p_size * 1.0 AS l, p_size * 1.0 + 300 AS r, p_size * 2.0 AS t, p_size * 2.0 + 12 AS b FROM part)
 SELECT p_partkey, CAST(greatest(0, floor(l + 300 * 3 / 20 - 28)) AS BIGINT) AS px0, CAST(least(320, floor(l + 300 * 9 / 20 + 28)) AS BIGINT) AS px1, CAST(greatest(0, floor(t - 2)) AS BIGINT) AS py0, CAST(least(100, floor(b + 3)) AS BIGINT) AS py1 FROM b""")
def ocr_pixel_ranges(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", "double(p_size) AS l", "p_size + 300D AS r", "p_size * 2D AS t", "p_size * 2D + 12D AS b")
    made = layout.pixel_range(F.lit(3), F.lit(9), F.lit(20), F.col("l"), F.col("r"), F.col("t"), F.col("b"), F.lit(320), F.lit(100))
    return rows.withColumn("p", made).select("p_partkey", *[F.col(f"p.{k}").cast("long").alias(k) for k in ("px0", "px1", "py0", "py1")])


@query("SELECT p_partkey, p_partkey % 3 = 0 AND p_size < 22 AS header FROM part")
def ocr_header_flag(spark, d):
    return table(spark, d, "part").select("p_partkey", layout.ocr_header(F.col("p_size") * 1.0, F.lit(100.0), (F.col("p_partkey") % 3).cast("int")).alias("header"))


@query(_spans_sql(P.URL, _CV, "cv", "doc_id, idx", f"SELECT doc_id, idx, CASE WHEN {_m(P.CONTACT_HINT)} OR s <= 2 THEN 0 ELSE s END AS s, CASE WHEN {_m(P.CONTACT_HINT)} OR length(text) - e <= 2 THEN length(text) ELSE e END AS e FROM found").replace("SELECT doc_id, idx, CASE", "SELECT DISTINCT doc_id, idx, CASE"))
def blank_span_widening(spark, d):
    line = S.clean(F.col("text"))
    rows = cv_lines(spark, d).select("doc_id", "idx", F.explode(layout.ocr_spans(line, S.spans(line, P.URL, "URL"))).alias("x"))
    return rows.select("doc_id", "idx", F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e")).distinct()


# --- audit


@query(f"WITH {_CV}, f AS (SELECT doc_id, 'EMAIL' AS kind, unnest(regexp_extract_all(text, {re2(P.EMAIL)})) AS value FROM cv UNION ALL SELECT doc_id, 'URL', unnest(regexp_extract_all(text, {re2(P.URL)})) FROM cv UNION ALL SELECT doc_id, 'PHONE', unnest({_PHONES}) FROM cv UNION ALL SELECT doc_id, 'DOB', unnest(regexp_extract_all(text, {re2(P.DOB)})) FROM cv) SELECT DISTINCT doc_id, kind, value FROM f")
def findings_union_distinct(spark, d):
    return _findings(spark, d).select("doc_id", "kind", "value")


def _findings(spark, d) -> DataFrame:
    found = audit.text_findings(cv_lines(spark, d).select("doc_id", "text"))
    return audit.union_findings(found, found)


@query(f"WITH {_CV}, f AS (SELECT DISTINCT doc_id, 'E' || unnest(regexp_extract_all(text, {re2(P.EMAIL)})) AS v FROM cv UNION SELECT doc_id, 'U' || unnest(regexp_extract_all(text, {re2(P.URL)})) FROM cv UNION SELECT doc_id, 'P' || unnest({_PHONES}) FROM cv UNION SELECT doc_id, 'D' || unnest(regexp_extract_all(text, {re2(P.DOB)})) FROM cv) SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id")
def leaks_per_doc(spark, d):
    return audit.leaks(_findings(spark, d)).select("doc_id", "n")


@query(f"WITH {_CV} SELECT doc_id * 10 + idx AS doc_id, NOT ({_m(P.EMAIL)} OR {_m(P.URL)} OR {_m(P.DOB)} OR len({_PHONES}) > 0) AS passed FROM cv")
def audit_pass_flag(spark, d):
    lines = cv_lines(spark, d).select((F.col("doc_id") * 10 + F.col("idx")).alias("doc_id"), "text")
    return audit.audit_flags(lines, audit.text_findings(lines))


@query(r"SELECT 'd' || (doc_id % 50)::VARCHAR AS output_name, line FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS line FROM documents) WHERE length(line) > 45 AND NOT " + _m(P.CONTACT_LINE, "line") + r" AND 'd' || (doc_id % 50)::VARCHAR || line NOT IN (SELECT 'd' || (doc_id % 50)::VARCHAR || x FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS x FROM documents WHERE doc_id % 7 > 0))")
def content_loss_anti(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), (F.col("doc_id") % 50).cast("string")).alias("output_name"), F.explode(audit.lines_in(F.col("text"))).alias("line"))
    return audit.content_loss(rows, rows.filter("doc_id % 7 > 0")).select("output_name", "line")


_MANIFEST = "(SELECT s_suppkey, s_suppkey % 9 AS redactions, CASE WHEN s_suppkey % 11 = 0 THEN 'bad file' END AS error, s_suppkey % 5 = 0 AS unmapped, s_suppkey % 4 = 0 AS used_ocr FROM supplier)"


def _manifest(spark, d) -> DataFrame:
    return table(spark, d, "supplier").selectExpr("s_name AS filename", "s_suppkey % 9 AS redactions", "CASE WHEN s_suppkey % 11 = 0 THEN 'bad file' END AS error", "s_suppkey % 5 = 0 AS unmapped", "s_suppkey % 4 = 0 AS used_ocr")


@query(f"SELECT CAST(sum(redactions) AS BIGINT) AS total_redactions, count(error) AS failed, count(*) FILTER (unmapped) AS unmapped, count(*) AS files FROM {_MANIFEST}")
def manifest_totals(spark, d):
    return audit.manifest_totals(_manifest(spark, d))


@query(f"SELECT count(*) FILTER (error IS NULL) AS written, count(error) AS failed, count(*) FILTER (used_ocr) AS scanned FROM {_MANIFEST}")
def run_report(spark, d):
    return audit.run_report(_manifest(spark, d)).select("written", "failed", "scanned")


@query(r"SELECT conv_id AS doc_id, bool_or(regexp_matches(text, '\S')) AS has_text_layer FROM (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN ' ' || chr(10) ELSE text END AS text FROM conversations) GROUP BY conv_id")
def text_layer_probe(spark, d):
    return audit.text_layer(table(spark, d, "conversations").selectExpr("conv_id AS doc_id", "CASE WHEN conv_id % 3 = 0 THEN ' \n' ELSE text END AS text"))


@query(r"SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:14] AS header_lines FROM documents")
def header_top14(spark, d):
    return audit.header_preview(table(spark, d, "documents"))


@query("SELECT doc_id, 'METADATA author' AS kind, source AS value FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT page_id, 'LINK', url FROM pages")
def metadata_findings(spark, d):
    meta = table(spark, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 4 = 1 THEN 'producer' ELSE 'author' END AS key", "CASE WHEN doc_id % 2 = 0 THEN source WHEN doc_id % 4 = 3 THEN ' ' ELSE source END AS value")
    return audit.metadata_findings(meta, table(spark, d, "pages").selectExpr("page_id AS doc_id", "url AS uri")).select("doc_id", "kind", "value")


@query(f"SELECT page_id AS doc_id, 'EMAIL' AS kind, v AS value FROM (SELECT page_id, unnest(regexp_extract_all(html, {re2(P.EMAIL_IN_BYTES)})) AS v FROM pages) WHERE regexp_matches(v, '[a-z]') AND NOT {_m(P.BOILERPLATE, 'v')} UNION ALL SELECT page_id, 'URL', v FROM (SELECT page_id, unnest(regexp_extract_all(html, {re2(P.LINK_IN_BYTES)})) AS v FROM pages) WHERE NOT {_m(P.BOILERPLATE, 'v')}")
def byte_findings(spark, d):
    return audit.byte_findings(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.encode("html", "UTF-8").alias("data"))).select("doc_id", "kind", "value")


@query("SELECT conv_id, min(turn) AS first FROM conversations GROUP BY conv_id HAVING NOT bool_or(contains(lower(text), 'the'))")
def first_name_missing(spark, d):
    whole = table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("turn"), F.array_join(F.collect_list("text"), "\n").alias("text"))
    notes = audit.first_name_notes(whole.select(F.col("conv_id").alias("doc_id"), "text", F.lit("The").alias("first")))
    return whole.join(notes, whole.conv_id == notes.doc_id, "left_semi").select("conv_id", F.col("turn").alias("first"))


@query(f"WITH {_CV} SELECT doc_id, string_agg(regexp_replace(text, {re2(P.EMAIL)}, '', 'g'), '' ORDER BY idx) AS text FROM cv GROUP BY doc_id")
def runs_rejoined(spark, d):
    whole = cv_lines(spark, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: F.concat(x["text"], F.lit("\n"))).alias("runs"))
    line = S.clean(F.array_join("runs", ""))
    struck = redaction.struck_runs(F.col("runs"), S.mask(line, S.spans(line, P.EMAIL, "EMAIL")))
    return whole.select("doc_id", F.replace(F.array_join(struck, ""), F.lit("\n"), F.lit("")).alias("text"))


@query("SELECT n_nationkey, true AS whole, n_nationkey AS total FROM nation")
def manifest_read_back(spark, d):
    raw = table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").cast("long").alias("total_redactions"), F.lit(0).alias("failed"), F.array(F.struct(F.col("n_name").alias("filename"))).alias("files"))).alias("raw"))
    return files.manifest_of(raw).select("n_nationkey", F.col("manifest").isNotNull().alias("whole"), F.col("manifest.total_redactions").cast("int").alias("total"))


@query(f"WITH {_CV}, t AS (SELECT doc_id, idx, unnest({_TOKENS}) AS token FROM cv) SELECT doc_id, idx, token, substring(token, 1, 6) AS again FROM t WHERE starts_with(lower(token), 'linked') AND lower(token) <> 'linked' AND NOT contains(token, '@') AND NOT {_m(P.URL, 'token')}")
def names_to_reinsert(spark, d):
    tokens = cv_lines(spark, d).select("doc_id", "idx", F.explode(F.filter(F.split("text", r"\s+"), lambda t: t != "")).alias("token"))
    return names.to_reinsert(tokens.withColumn("keep", F.lit("Linked")), text="token").select("doc_id", "idx", "token", "again")


@query(f"WITH {_FILES}, {_PLAN} SELECT 'out_' || f.filename AS output_name, coalesce(p.surnames, []) AS surnames FROM files f LEFT JOIN plan p USING (filename)")
def results_rekeyed(spark, d):
    return names.rekeyed(files_of(spark, d).withColumn("output_name", F.concat(F.lit("out_"), "filename")), plan_of(spark, d))


@query("SELECT doc_id, count(*) FILTER (doc_id % 2 = 0) AS words_struck, count(*) AS spans_removed, count(*) FILTER (doc_id % 3 = 0) AS boxes_blanked FROM (SELECT p_partkey % 50 AS doc_id FROM part) GROUP BY doc_id")
def redaction_counts(spark, d):
    rows = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("doc_id"))
    return names.redaction_counts(rows.filter("doc_id % 2 = 0"), rows, rows.filter("doc_id % 3 = 0"))


@query("SELECT n_regionkey AS doc_id, 0 AS page, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS pos, n_name AS text FROM nation")
def font_spans_flattened(spark, d):
    span = lambda x: F.struct(x["n_name"].alias("text"))
    pages = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    lines = F.transform("ns", lambda x: F.struct(F.array(F.struct(F.array(span(x)).alias("spans"))).alias("lines")))
    return names.flat_font_spans(pages.select("doc_id", F.lit(0).alias("page"), lines.alias("blocks"))).select("doc_id", "page", "pos", "text")


@query("SELECT s_suppkey AS doc_id, CAST(unnest(range(s_suppkey % 4)) AS INT) AS page FROM supplier")
def document_pages(spark, d):
    return names.pages_of(table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), (F.col("s_suppkey") % 4).alias("n_pages")))


@query(f"WITH {_CV} SELECT doc_id, idx FROM cv WHERE NOT regexp_matches(regexp_replace(text, {re2(P.URL)}, '', 'g'), '[\\p{{L}}\\p{{N}}]')")
def dead_links(spark, d):
    line = S.clean(F.col("text"))
    return names.dead_link_bands(cv_lines(spark, d), S.deleted(S.mask(line, S.spans(line, P.URL, "URL")))).select("doc_id", "idx")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
