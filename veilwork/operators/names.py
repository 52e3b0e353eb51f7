"""First names that a redaction took with a surname: which struck words have to be written again."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions import patterns as P
from veilwork.functions import predicates as Q


@F.pandas_udf(T.StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """Compatibility decomposition (NFKD), for which the JVM's functions have no name. Null stays null."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def to_reinsert(words: DataFrame, keep: str = "keep", text: str = "text") -> DataFrame:
    """Words that begin with the name to keep and go on after it, and are no contact data: (words' columns, `again`)."""
    name = F.lower(F.coalesce(keep, F.lit("")))
    plain = decomposed(F.lower(text))
    rows = words.filter(name != "").withColumn("plain", plain)
    contact = Q.has(F.col(text), P.EMAIL) | Q.has(F.col(text), P.URL) | F.contains(text, F.lit("@"))
    return rows.filter(F.startswith("plain", name) & (F.col("plain") != name) & ~contact).withColumn("again", F.col(text).substr(F.lit(1), F.char_length(name))).drop("plain")


def rekeyed(results: DataFrame, plan: DataFrame) -> DataFrame:
    """Results by output name, with the tokens of the plan that made them."""
    return results.join(plan.select("filename", "surnames"), "filename", "left").select("output_name", F.coalesce("surnames", F.array().cast("array<string>")).alias("surnames"))


def redaction_counts(struck: DataFrame, spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """The three units in which formats count: words struck, spans (overlaps counted), boxes blanked; by document."""
    parts = [df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.lit(k).alias("unit"), "n") for k, df in (("words_struck", struck), ("spans_removed", spans), ("boxes_blanked", boxes))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    total = lambda k: F.coalesce(F.sum(F.when(F.col("unit") == k, F.col("n"))), F.lit(0)).alias(k)
    return rows.groupBy("doc_id").agg(total("words_struck"), total("spans_removed"), total("boxes_blanked"))


def flat_font_spans(pages: DataFrame) -> DataFrame:
    """Font spans of nested blocks and lines, in order: doc_id, page, pos, and each span's fields."""
    lines = F.flatten(F.transform("blocks", lambda b: b["lines"]))
    return pages.select("doc_id", "page", F.posexplode(F.flatten(F.transform(lines, lambda x: x["spans"]))).alias("pos", "span")).select("doc_id", "page", "pos", "span.*")


def pages_of(documents: DataFrame) -> DataFrame:
    """A row for each page of documents with n_pages; none for 0."""
    return documents.filter("n_pages > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n_pages").cast("int") - 1)).alias("page"))


def dead_link_bands(links: DataFrame, left: Column) -> DataFrame:
    """Rectangles of links in which no letter or digit is left, whose underlines go too."""
    return links.filter(~Q.has(F.coalesce(left, F.lit("")), P.ALNUM))
