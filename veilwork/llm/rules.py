"""Quality rules as a bitmask ledger, in DataFrame functions only.

Each rule is evaluated once for each document; the ledger keeps all measurements and one bit for each failed rule.
A policy is a mask of the rules that reject; applying a version, or comparing versions, only reads the ledger.

Defined results: null text counts as empty (no words, so it fails `min_words`); a null doc_id stays null; repeated rows
are judged one by one; texts of any length are judged whole; columns beside doc_id and text are not read by `ledger`.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.common import table

_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5

#: Bit, name and failure condition of each rule, over the measurements.
RULES = (
    (0, "min_words", lambda m: m["n_words"] < 10),
    (1, "repeated_windows", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 20),
    (2, "symbols", lambda m: m["n_symbols"] * 10 > m["n_words"] * 3),
    (3, "word_length", lambda m: m["word_chars"] > m["n_words"] * 20),
    (4, "duplicate_lines", lambda m: (m["n_lines"] >= 4) & (m["n_dup_lines"] * 10 > m["n_lines"] * 6)),
    (5, "shouting", lambda m: (m["n_words"] >= 10) & (m["n_shouts"] * 10 > m["n_words"] * 5)),
)
BIT = {name: 1 << bit for bit, name, _ in RULES}
BASE = BIT["min_words"] | BIT["repeated_windows"]
#: Versions of the policy: which rules reject.
POLICIES = {"v1": BASE, "v2": BASE | BIT["symbols"] | BIT["word_length"] | BIT["duplicate_lines"], "v3": BASE | BIT["symbols"] | BIT["word_length"] | BIT["duplicate_lines"] | BIT["shouting"]}
CURRENT = "v3"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value made once for each row however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _repeated_words(hashes: Column) -> Column:
    """Words in windows of WINDOW that occur twice or more, from the hashes of the words in order.

    Windows stand for their 64-bit hash. Where all are different, which is the rule, nothing is sorted; else equal
    windows are brought together by sorting (hash, place), and the union of the places they cover is summed up.
    """
    none = F.lit(0).cast("long")
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def covered(g: Column) -> Column:
        placed = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return _let(placed, summed)

    def summed(placed: Column) -> Column:
        at = lambda k: F.get(placed, k)["x"]
        twice = F.filter(placed, lambda p, k: (k > 0) & (at(F.greatest(k - 1, F.lit(0))) == p["x"]) | F.coalesce(at(k + 1) == p["x"], F.lit(False)))
        start = F.struct(none.alias("n"), F.lit(-WINDOW).alias("at"))
        total = F.aggregate(F.array_sort(F.transform(twice, lambda p: p["i"])), start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")))
        return total["n"]

    return F.when(F.size(hashes) <= WINDOW, none).otherwise(_let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), none).otherwise(covered(g))))


def judged(text: Column) -> Column:
    """A struct of all measurements of a text and `failed`: one expression, so that no reader makes it twice."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")

    def measured(t: Column) -> Column:
        return F.struct(
            F.size(t["words"]).cast("long").alias("n_words"),
            F.aggregate(t["words"], F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
            F.regexp_count(t["text"], F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(t["lines"]) - F.size(F.array_distinct(t["lines"]))).cast("long").alias("n_dup_lines"),
            _let(F.transform(t["words"], lambda x: F.xxhash64(x)), _repeated_words).alias("n_repeat_words"),
            F.size(t["lines"]).cast("long").alias("n_lines"),
            F.regexp_count(t["text"], F.lit(r"\p{Lu}{2}[^\x20\x09-\x0D]*!")).cast("long").alias("n_shouts"),
        )

    def with_bits(m: Column) -> Column:
        bits = [F.when(fails(m), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")) for bit, _, fails in RULES]
        return F.struct(*[m[x].alias(x) for x in MEASURES], functools.reduce(lambda a, b: a + b, bits).alias("failed"))

    return _let(F.struct(text.alias("text"), words.alias("words"), lines.alias("lines")), lambda t: _let(measured(t), with_bits))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, every measurement, and `failed`: a bit for each rule that the document fails."""
    return docs.select("doc_id", judged(F.col("text")).alias("judged")).select("doc_id", "judged.*")


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a version of the policy."""
    failed = F.col("failed")
    return rows.withColumns({"base_failed": failed.bitwiseAND(F.lit(BASE)) != 0, "kept": failed.bitwiseAND(F.lit(POLICIES[policy])) == 0})


def ablations(rows: DataFrame) -> DataFrame:
    """For each rule of the ledger: documents that fail it, and those that the current policy rejects for it alone."""
    active = F.col("failed").bitwiseAND(F.lit(POLICIES[CURRENT]))
    sums = [F.struct(F.lit(name).alias("rule"), F.sum(F.shiftright(F.col("failed"), bit).bitwiseAND(F.lit(1))).alias("n_failed"), F.count_if(active == F.lit(1 << bit)).alias("n_only")) for bit, name, _ in RULES]
    return rows.agg(F.array(*sums).alias("rules"), F.bit_or("failed").alias("ever_failed")).select(F.explode("rules").alias("r"), "ever_failed").select("r.rule", "r.n_failed", "r.n_only", "ever_failed")


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of docs, with their columns, that the policy keeps."""
    return docs.filter(judged(F.col("text"))["failed"].bitwiseAND(F.lit(POLICIES[policy])) == 0)


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule does to the documents of a corpus."""
    return ablations(ledger(table(spark, sf_dir, "documents")))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM t WHERE len(w) >= 5),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, CAST(sum(least(5, i - coalesce(before, -9))) AS BIGINT) AS n
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r) GROUP BY doc_id),
m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(regexp_extract_all(text, '\p{Lu}{2}[^\x20\x09-\x0D]*!')) AS BIGINT) AS n_shouts
      FROM t LEFT JOIN c USING (doc_id)),
f AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END
        + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines THEN 16 ELSE 0 END
        + CASE WHEN n_words >= 10 AND 10 * n_shouts > 5 * n_words THEN 32 ELSE 0 END AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed FROM f
"""

ABLATIONS_SQL = (
    SQL[: SQL.rindex("SELECT doc_id, n_words")]
    + "SELECT rule, CAST(sum((failed >> bit) & 1) AS BIGINT) AS n_failed, count(*) FILTER (failed = 1 << bit) AS n_only, CAST(bit_or(failed) AS BIGINT) AS ever_failed"
    + f" FROM f, (VALUES {', '.join(f'({bit}, {name!r})' for bit, name, _ in RULES)}) r(bit, rule) GROUP BY rule"
)
