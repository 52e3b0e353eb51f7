"""The decision on lines of each kind, and against the plain model on many made-up lines: one query for each table."""

import random
import re

import pytest
from model import redacted
from pyspark.sql import functions as F

from veilwork import queries
from veilwork.functions import patterns as P
from veilwork.functions import predicates as Q
from veilwork.functions import spans as S
from veilwork.operators import audit
from veilwork.operators.redaction import redact_lines

SCHEMA = "id int, text string, header boolean, top boolean, first string, tokens array<string>"
#: text, header, first name, surnames, what must be left (joined by one space)
LINES = [
    ("ada77@example.com", True, None, [], ""), ("Email: work.ada@example.com", True, None, [], ""), ("ada77 @ example.com", True, None, [], ""),
    ("+91 9000000001", True, None, [], ""), ("+254 700 000 001", True, None, [], ""), ("(+91) 90000-00002", True, None, [], ""), ("9000000003", True, None, [], ""), ("+971 500000001/+91 9000000004", True, None, [], ""),
    ("https://github.com/ada", True, None, [], ""), ("linkedin.com/in/ada-1", True, None, [], ""), ("ada.vercel.app", True, None, [], ""), ("Node.js and ASP.NET", False, None, [], "Node.js and ASP.NET"),
    ("Date of Birth: 01/02/1990", True, None, [], ""), ("Marital Status - Single", True, None, [], ""), ("Nationality: X | Gender: Y", True, None, [], ""), ("Improved gender diversity in hiring", False, None, [], "Improved gender diversity in hiring"),
    ("ADA ROWE", True, None, ["Rowe"], "ADA"), ("MIRABEL Q", False, None, [r"re:(?<=MIRABEL\s)Q(?![A-Za-z])"], "MIRABEL"), ("Level Q of Cello", False, None, [r"re:(?<=MIRABEL\s)Q(?![A-Za-z])"], "Level Q of Cello"), ("Ada Van  Rowe", False, None, ["Van Rowe"], "Ada"), ("Ada (x.y) zed", False, None, ["(x.y)"], "Ada zed"),
    ("Pune, Maharashtra", True, None, [], ""), ("Northwind Traders Ltd, Nagpur", False, None, [], "Northwind Traders Ltd, Nagpur"), ("LinkedIn |", True, None, [], ""), ("E-MAIL", True, None, [], ""), ("Profile", True, None, [], "Profile"), ("D A T A  L E A D", True, None, [], "D A T A L E A D"),
    ("Riverbend, Kerala | mira@example.net | +91 9000000005 | Kaggle | Portfolio", True, None, [], ""), ("Kochi • Ready to relocate across four time zones", True, None, [], "Ready to relocate across four time zones"),
    ("GitLab: Mira | +44 9000000006", True, "Mira", [], "Mira"), ("Ada | Software Engineer | +91 9000000007", True, "Ada", [], "Ada | Software Engineer"), ("ada-rowe", True, "Ada", ["Rowe"], ""), ("§ ADA ROWE | +91 9000000008", True, "Ada", ["Rowe"], "ADA"),
    ("", True, None, [], ""), (None, True, None, [], ""), ("😀 mail ada@example.com then quite a lot of other words here", False, None, [], "mail then quite a lot of other words here"), ("a b@example.com and more words that stay in place", False, None, [], "a and more words that stay in place"),
]


def test_lines(spark):
    rows = [(i, t, h, None, f, s) for i, (t, h, f, s, _) in enumerate(LINES)]
    made = redact_lines(spark.createDataFrame(rows, SCHEMA)).select("id", S.joined(F.col("decision.mask")).alias("left")).collect()
    got = {r.id: r.left for r in made}
    assert {i: got[i] for i in got} == {i: x[4] for i, x in enumerate(LINES)}


def test_against_the_model(spark):
    rng = random.Random(9)
    parts = ["Ada", "Rowe", "ada@example.com", "+91 9000000001", "2018 - 2022", "|", "•", "LinkedIn", "GitHub:", "Email", "Pune", "Bhopal, MP", "Flat No 3", "411001", "Software Engineer", "at", "a", "I", "github.com/ada", "Gender: F", "12/4 Road", "Institute", "led teams, built tools", "(x)", "-", "é", "01/02/1990", "Male 31", "mobile", "Portfolio", "Remote", " ", "7+ years"]
    rows = []
    for i in range(400):
        text = rng.choice([" ", "  ", " | ", ", "]).join(rng.choices(parts, k=rng.randint(0, 7)))
        rows.append((i, text, rng.random() < 0.5, rng.choice([None, True, False]), rng.choice([None, "Ada", ""]), rng.choice([[], ["Rowe"], ["Rowe", "Van Dyke"]])))
    got = {r.id: r.redacted for r in redact_lines(spark.createDataFrame(rows, SCHEMA)).select("id", "redacted").collect()}
    bad = [(r, got[r[0]]) for r in rows if got[r[0]] != redacted(r[1], r[2], r[3], r[4], tuple(r[5]))]
    assert not bad[:3]


SF = "/root/testdata/sf0.001"
HEADING = re.compile(r"\W*(?:education|(?:professional )?summary|(?:work )?experience|skills|projects?|profile)\W*", re.I)


def test_queries_against_the_model(spark):
    """redacted_lines and residue_sweep over every line of every CV, documents_redacted over every line of every document."""
    under = {}
    got = {(r.doc_id, r.idx): (r.redacted, r.whole) for r in queries.redacted_lines(spark, SF).collect()}
    swept = {(r.doc_id, r.idx): r.redacted for r in queries.residue_sweep(spark, SF).collect()}
    bad, n = [], 0
    for doc, idx, text in queries.cv_lines(spark, SF).orderBy("doc_id", "idx").collect():
        under[doc] = under.get(doc, False) or bool(HEADING.fullmatch(text))
        left = redacted(text, idx < 10 and not under[doc], idx < 25 and not under[doc], None, ("Rowe",))
        bad += [(doc, idx, text, left, got[doc, idx])] * (left != got[doc, idx][0] or got[doc, idx][1] and left != "")
        left = redacted(text, True, None, text.split(" ")[0])
        bad += [(doc, idx, text, left, swept[doc, idx])] * (left != swept[doc, idx])
        n += 1
    assert bad[:3] == [] and n == len(got) == len(swept)
    lines = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.posexplode(audit.lines_in(F.col("text")))).collect()
    model = {(d, i): redacted(t) for d, i, t in lines}
    changed = {(d, i): model[d, i] for d, i, t in lines if model[d, i] != t}
    assert {(r.doc_id, r.idx): r.redacted for r in queries.documents_redacted(spark, SF).collect()} == changed


def test_pre_spans(spark):
    rows = spark.createDataFrame([("LinkedIn | GitHub", True, [(0, 8), (11, 17)])], "text string, header boolean, pre array<struct<s:int,e:int>>")
    assert redact_lines(rows).first().redacted.strip() == ""


@pytest.mark.parametrize(
    ("column", "yes", "no"),
    [
        (Q.label_line, ["LinkedIn |", "| GitHub:", "|", "PHONE", "E-MAIL", "LinkedIn | E-mail | GitHub"], ["Profile", "Summary", "Data Analyst", "D A T A  L E A D", ""]),
        (Q.link_label_only, ["GitHub", "View Profile", "Visit My Website"], ["View Certificate", "HarborApp", ""]),
        (Q.section_head, ["Education", "PROFESSIONAL SUMMARY", "Work Experience"], ["Education of a whole town"]),
        (Q.is_word, ["ab", "7", "I", "a,"], ["|", "x", "§", "()"]),
        (lambda t: F.size(Q.phone_spans(t)) == 0, ["2018 - 2022", "Mar 2011 - Nov 2015 2016", "1234567890123456"], ["9000000003"]),
        (lambda t: F.size(Q.city_spans(t)) == 0, ["Mysore College of Sample Studies", "Managed MP AS rollout", "M.P., x"], ["Bhopal, MP", "M.P.India"]),
        (lambda t: Q.has(t, P.PERSONAL_LINE), ["Marital Status - Single", "DOB - 01/02/1990", "Japan no: 1", "father's name: X"], ["Improved gender diversity in hiring", "D.O.B.: x", "father’s name: X"]),
    ],
)
def test_predicates(spark, column, yes, no):
    rows = spark.createDataFrame([(t, True) for t in yes] + [(t, False) for t in no], "t string, expected boolean")
    assert rows.withColumn("got", column(F.col("t"))).filter("NOT got <=> expected").collect() == []


def test_chunks_and_marks(spark):
    row = spark.range(1).select(
        S.chunks(S.mask(F.lit("abc def ghi"), F.array(F.struct(F.lit(4).alias("s"), F.lit(7).alias("e"))))).alias("a"),
        S.chunks(S.mask(F.lit("abcdef"), F.array(F.struct(F.lit(0).alias("s"), F.lit(3).alias("e")), F.struct(F.lit(2).alias("s"), F.lit(5).alias("e"))))).alias("b"),
        S.matches(S.clean(F.lit("﷐x@y.org 日")), P.EMAIL).alias("c"),
        S.matches(F.lit("AMP MP"), P.STATE_ABBR).alias("d"),
    ).first()
    assert [tuple(x) for x in row.a] == [(0, 3, "abc"), (8, 11, "ghi")] and [tuple(x) for x in row.b] == [(5, 6, "f")]
    assert [tuple(x) for x in row.c] == [(1, 8, "x@y.org")] and [tuple(x) for x in row.d] == [(4, 6, "MP")]


def test_residue_sweep_has_every_line(spark):
    from veilwork import queries

    d = "/root/testdata/sf0.001"
    lines = {(r.doc_id, r.idx): r.text for r in queries.cv_lines(spark, d).collect()}
    got = {(r.doc_id, r.idx): r.redacted for r in queries.queries()["residue_sweep"](spark, d).collect()}
    assert {i for _, i in got} == set(range(8))
    assert got == {k: redacted(t, header=True, first=t.split(" ")[0]) for k, t in lines.items()}


def test_default_places_are_whole(spark):
    assert len(set(P.PLACES)) == len(P.PLACES) == 218
    towns = ["Kolhapur", "Ujjain", "Sonargaon", "Nakuru", "Rajshahi", "Tiruchirappalli"]
    found = redact_lines(spark.createDataFrame([(t + " | ada@example.com", True) for t in towns], "text string, header boolean"))
    assert all(r.redacted.strip() == "" and "CITY" in {s.kind for s in r.decision.spans} for r in found.collect())
