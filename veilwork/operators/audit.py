"""The audit: findings as rows (doc_id, kind, value, ord), lost lines, and their totals."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.config import DEFAULT, Config
from veilwork.functions import patterns as P
from veilwork.functions import predicates as Q
from veilwork.functions import spans as S

#: All that ends a line, as one class.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
_EDGE = P.java(r"^\s+|\s+$", False)


def lines_in(text: Column) -> Column:
    """Stripped lines that are not blank."""
    stripped = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_ENDS, -1), lambda x: F.regexp_replace(x, _EDGE, ""))
    return F.filter(stripped, lambda x: x != "")


def text_findings(texts: DataFrame, strict: bool = False) -> DataFrame:
    """Direct identifiers in texts (doc_id, text, and surnames if there). Birth dates are looked for line by line. The
    audit is narrower than the redaction; strict adds declared fields, ages and six-digit codes."""
    text = S.clean(F.col("text"))
    kinds = [("EMAIL", S.spans(text, P.EMAIL, "EMAIL")), ("URL", S.spans(text, P.URL, "URL")), ("PHONE", Q.phone_spans(text))]
    named = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), m["text"].alias("value"))
    cut_out = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), F.substring(text, m["s"] + 1, m["e"] - m["s"]).alias("value"))
    in_lines = lambda k, rx: lambda line: F.transform(S.matches(line, rx), named(k))
    found = [F.transform(x, cut_out(k)) for k, x in kinds]
    by_line = [("DOB", P.DOB)] + ([("FIELD", P.PERSONAL_LINE), ("GENDER_AGE", P.GENDER_AGE), ("PIN", P.PIN)] if strict else [])
    for k, rx in by_line:
        found.append(F.flatten(F.transform(F.split(text, LINE_ENDS, -1), in_lines(k, rx))))
    if "surnames" in texts.columns:
        found.append(F.transform(S.matches(text, S.surname_pattern(F.col("surnames"))), named("NAME")))
    return texts.select("doc_id", F.posexplode(F.concat(*found)).alias("ord", "f")).select("doc_id", "f.kind", "f.value", "ord")


def byte_findings(blobs: DataFrame) -> DataFrame:
    """Identifiers in raw bytes (doc_id, data, and surnames if there): addresses with a small letter, links, plain tokens."""
    text = S.clean(F.decode("data", "ISO-8859-1"))
    mails = F.filter(S.matches(text, P.EMAIL_IN_BYTES), lambda m: Q.has(m["text"], r"\p{Ll}"))
    found = [("EMAIL", mails), ("URL", S.matches(text, P.LINK_IN_BYTES))]
    if "surnames" in blobs.columns:
        plain = F.transform(F.filter("surnames", lambda t: ~t.startswith("re:")), lambda t: F.decode(F.encode(t, "UTF-8"), "ISO-8859-1"))
        found.append(("NAME", S.matches(text, S.surname_pattern(plain))))
    named = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), m["text"].alias("value"))
    rows = F.concat(*[F.transform(x, named(k)) for k, x in found])
    return blobs.select("doc_id", F.posexplode(F.filter(rows, lambda r: ~Q.has(r["value"], P.BOILERPLATE))).alias("ord", "f")).select("doc_id", "f.kind", "f.value", "ord")


def metadata_findings(metadata: DataFrame, links: DataFrame) -> DataFrame:
    """Filled metadata fields and link targets that are still there."""
    kept = metadata.filter(F.col("key").isin("author", "title", "subject", "keywords") & (F.trim(F.coalesce("value", F.lit(""))) != ""))
    a = kept.select("doc_id", F.concat(F.lit("METADATA "), F.col("key")).alias("kind"), "value", F.lit(0).alias("ord"))
    b = links.filter(F.coalesce("uri", F.lit("")) != "").select("doc_id", F.lit("LINK").alias("kind"), F.col("uri").alias("value"), F.lit(0).alias("ord"))
    return a.unionByName(b)


def union_findings(*parts: DataFrame) -> DataFrame:
    """All findings once each, by their first place; parts count in their order."""
    rows = functools.reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    return rows.groupBy("doc_id", "kind", "value").agg(F.min(F.struct("part", "ord")).alias("at")).select("doc_id", "kind", "value", F.col("at.part").alias("part"), F.col("at.ord").alias("ord"))


def leaks(findings: DataFrame) -> DataFrame:
    """Findings of each document in order, as `KIND: value`. A document's findings are bounded by its text."""
    order = F.array_sort(F.collect_list(F.struct("part", "ord", "kind", "value")))
    return findings.groupBy("doc_id").agg(order.alias("f"), F.count(F.lit(1)).alias("n")).select("doc_id", F.transform("f", lambda x: F.concat(x["kind"], F.lit(": "), x["value"])).alias("leaks"), "n")


def first_name_notes(texts: DataFrame) -> DataFrame:
    """Documents whose first name is nowhere in the text: a substring test."""
    return texts.filter((F.coalesce("first", F.lit("")) != "") & ~F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower("first"))).select("doc_id", "first")


def content_loss(source: DataFrame, output: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Long source lines (output_name, line) that the output of the same name lacks and that held no contact data. Lines
    that the source repeats stay repeated; sources without an output are not looked at."""
    there = output.select("output_name").distinct()
    asked = source.filter((F.char_length("line") > config.lost_line_chars) & ~Q.expected_loss(F.col("line"))).join(there, "output_name", "left_semi")
    return asked.join(output.select("output_name", "line"), ["output_name", "line"], "left_anti").withColumn("shown", F.left("line", F.lit(90)))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.coalesce(F.sum("redactions"), F.lit(0)).alias("total_redactions"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if("unmapped").alias("unmapped"), F.count(F.lit(1)).alias("files"))


def run_report(manifest: DataFrame) -> DataFrame:
    """What a run did: counts, and names in the order of file names."""
    names = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.col("filename")))), lambda x: x)
    ok = F.col("error").isNull()
    return manifest.agg(F.count_if(ok).alias("written"), F.count_if(~ok).alias("failed"), F.count_if("used_ocr").alias("scanned"), names(F.col("unmapped")).alias("unmapped_names"), names(~ok).alias("failed_names"))


def audit_flags(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """Each document with `passed`: it has no finding."""
    return documents.select("doc_id").join(findings.select("doc_id").distinct().withColumn("leaks", F.lit(True)), "doc_id", "left").select("doc_id", F.col("leaks").isNull().alias("passed"))


def audit_totals(flags: DataFrame) -> DataFrame:
    return flags.agg(F.count(F.lit(1)).alias("checked"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))


def text_layer(pages: DataFrame) -> DataFrame:
    """Whether any page of a document has text."""
    return pages.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.regexp_replace(F.coalesce("text", F.lit("")), _EDGE, "") != ""), F.lit(False)).alias("has_text_layer"))


def header_preview(texts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return texts.select("doc_id", F.slice(lines_in(F.col("text")), 1, config.header_preview).alias("header_lines"))


def top_findings(findings: DataFrame, most: int = 8) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("part", "ord", "kind", "value")
    return findings.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
