"""Plans: one row for each file with its surname tokens, output name and photos, and the joins that use them.

A plan is small beside the files but grows with them, so no join here asks for a broadcast: the optimiser picks one by size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions import patterns as P

PLAN = "filename string, surnames array<string>, output_name string, reinsert_first_name string, photo_xrefs array<int>"


def parse_plans(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Plans from JSON arrays; malformed JSON fails the query, a plan without a file name too; of repeated file names the
    last stands."""
    parsed = raw.select(F.from_json(F.col(column), f"array<struct<{PLAN}>>", {"mode": "FAILFAST"}).alias("plans"))
    rows = parsed.select(F.posexplode("plans").alias("pos", "p")).select("pos", "p.*")
    checked = rows.withColumn("filename", F.when(F.coalesce(F.col("filename"), F.lit("")) == "", F.raise_error(F.lit("a plan has no filename"))).otherwise(F.col("filename")))
    names = [c for c in rows.columns if c != "pos"]
    return checked.groupBy("filename").agg(F.max_by(F.struct(*names), "pos").alias("p")).select("p.*")


def with_plan(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Each file with its plan, or the defaults: no tokens, its own name."""
    joined = files.join(plan.select("filename", "surnames", F.col("output_name").alias("planned_name"), F.lit(True).alias("mapped"), *[c for c in ("reinsert_first_name", "photo_xrefs") if c in plan.columns]), "filename", "left")
    return joined.withColumns({"surnames": F.coalesce("surnames", F.array().cast("array<string>")), "output_name": safe_name(F.coalesce("planned_name", "filename")), "mapped": F.coalesce("mapped", F.lit(False))}).drop("planned_name")


def unmapped(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Files without a plan; one with an empty list of tokens is mapped."""
    return files.join(plan.select("filename"), "filename", "left_anti")


def without_tokens(planned: DataFrame) -> DataFrame:
    """The other meaning of unmapped: no tokens, with a plan or without."""
    return planned.filter(F.size("surnames") == 0)


def output_of(plan: DataFrame) -> Column:
    """The name under which a plan's file is written, as `with_plan` gives it."""
    return safe_name(F.coalesce(plan["output_name"], plan["filename"]))


def by_output(outputs: DataFrame, plan: DataFrame) -> DataFrame:
    """Output files with the source's name and tokens; where two plans share an output name, the last file name stands."""
    back = plan.groupBy(output_of(plan).alias("output")).agg(F.max_by(F.struct(F.col("filename").alias("source"), "surnames"), "filename").alias("p")).select(F.col("output").alias("filename"), "p.source", "p.surnames")
    return outputs.join(back, "filename", "left").withColumn("surnames", F.coalesce("surnames", F.array().cast("array<string>")))


def valid_tokens(tokens: list[str]) -> str | None:
    """What is wrong with a plan's own patterns, by the rules of the JVM; None if all is well."""
    from pyspark import SparkContext

    jvm = SparkContext._active_spark_context._jvm
    for t in tokens:
        if t.startswith("re:"):
            try:
                jvm.java.util.regex.Pattern.compile("(?iUd)(?<![A-Za-z])(?:" + t[3:] + ")(?![A-Za-z])")
            except Exception as e:  # the JVM's own message
                return f"{t}: {str(e).splitlines()[0][:200]}"
    return None


def checked_plan(spark: SparkSession, plan: DataFrame) -> DataFrame:
    """The plan with `error` for rows whose own patterns are not valid, and without their tokens, so that one bad row
    fails itself and not the query. Only rows with patterns of their own come to the driver: they are written by hand."""
    own = plan.filter(F.exists("surnames", lambda t: t.startswith("re:"))).select("filename", "surnames").toLocalIterator()
    bad = [(r.filename, e) for r in own if (e := valid_tokens(r.surnames))]
    errors = spark.createDataFrame(bad, "filename string, error string")
    return plan.join(errors, "filename", "left").withColumn("surnames", F.when(F.col("error").isNull(), F.col("surnames")).otherwise(F.array().cast("array<string>")))


def safe_name(path: Column) -> Column:
    """The last part of a client's path, with either slash."""
    last = F.element_at(F.filter(F.split(path, r"[/\\]"), lambda x: ~x.isin("", ".", "..")), -1)
    return F.coalesce(last, F.lit("file"))


def first_name_of(output_name: Column) -> Column:
    return F.split_part(F.split_part(output_name, F.lit("_"), F.lit(1)), F.lit("."), F.lit(1))


def first_name_from(name: Column) -> Column:
    """The first word of a name, or Candidate."""
    return F.coalesce(F.get(F.filter(F.split(name, r"[\s_\-.]+"), lambda x: x != ""), F.lit(0)), F.lit("Candidate"))


def suggest_output_name(name: Column) -> Column:
    return F.concat(first_name_from(_stem(name)), F.lit("_Redacted"), F.lower(F.regexp_extract(name, r"(\.[^.]*)\z", 1)))


def suggest_surnames(name: Column) -> Column:
    """Words of a file name after the first that may be surnames."""
    words = F.filter(F.split(_stem(name), r"[\s_\-.()\[\]]+"), lambda w: w != "")
    return F.filter(F.slice(words, 2, 1 << 20), lambda w: (F.char_length(w) > 2) & ~F.lower(w).isin(*P.NOISE_WORDS) & ~w.rlike(r"(?U)\d"))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*\z", "")
