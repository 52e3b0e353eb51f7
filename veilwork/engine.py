"""The engine's verbs on tables: scan, redact, verify and review; and on DOCX files. PDF files are read, not written."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.config import DEFAULT, Config
from veilwork.functions import patterns as P
from veilwork.functions import predicates as Q
from veilwork.functions import spans as S
from veilwork.operators import audit, layout, redaction
from veilwork.plans import plan as plans
from veilwork.sources import blobs, docx, pdf, sinks
from veilwork.sources import files as sources


class Engine:
    """One session's engine. Every method takes and returns DataFrames; nothing runs until they are read."""

    def __init__(self, spark: SparkSession, config: Config = DEFAULT, places: list[str] | None = None) -> None:
        self.spark, self.config = spark, config
        self.city = P.city_pattern(places) if places else P.CITY

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version}

    def paragraphs(self, files: DataFrame) -> DataFrame:
        """Paragraphs to redact of files (filename, content). A file that can't be, every PDF too, is one row with its error."""
        others = files.filter(~_is(".docx")).select(F.col("filename").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("part"), F.lit(None).cast("int").alias("idx"), F.array().cast("array<string>").alias("runs"), F.lit("only DOCX files can be written here").alias("error"))
        return docx.paragraphs(files.filter(_is(".docx"))).unionByName(others)

    def reading(self, files: DataFrame) -> DataFrame:
        """The same table to read only: pages of PDF files are paragraphs of their document."""
        found = pdf.facts(files.filter(_is(".pdf")))
        pages = pdf.pages(found).select("doc_id", F.lit("document").alias("part"), F.col("page").alias("idx"), F.array("text").alias("runs"), F.lit(None).cast("string").alias("error"))
        broken = pdf.errors(found).select("doc_id", F.lit(None).cast("string").alias("part"), F.lit(None).cast("int").alias("idx"), F.array().cast("array<string>").alias("runs"), "error")
        return functools.reduce(DataFrame.unionByName, [docx.paragraphs(files.filter(_is(".docx"))), pages, broken])

    def scan(self, files: DataFrame, paragraphs: DataFrame) -> DataFrame:
        """Each file (filename) with its first lines and what a plan for it might say. Files stay of which nothing was read."""
        texts = self._texts(paragraphs.filter("part = 'document'"))
        preview = audit.header_preview(texts, self.config).withColumnRenamed("doc_id", "filename")
        named = files.select("filename", plans.suggest_surnames(F.col("filename")).alias("suggested_surnames"), plans.suggest_output_name(F.col("filename")).alias("suggested_output_name"))
        return named.join(preview, "filename", "left")

    def redact(self, paragraphs: DataFrame, plan: DataFrame) -> DataFrame:
        """Paragraphs (doc_id: file name, part, idx, runs) with decision, redacted text and redacted runs."""
        checked = plans.checked_plan(self.spark, plan)
        planned = plans.with_plan(paragraphs.withColumnRenamed("doc_id", "filename"), checked).withColumnRenamed("filename", "doc_id")
        rows = planned.withColumn("text", F.array_join("runs", "")).withColumns({"tokens": F.col("surnames"), "first": plans.first_name_of(F.col("output_name"))})
        made = redaction.redact_lines(layout.docx_header_flags(rows, config=self.config), city=self.city, config=self.config)
        return made.withColumn("redacted_runs", redaction.struck_runs(F.col("runs"), F.col("decision.mask")))

    def manifest(self, files: DataFrame, redacted: DataFrame, plan: DataFrame) -> DataFrame:
        """One row for each file: output name, spans removed, whether it was mapped, and its error."""
        counts = redacted.groupBy(F.col("doc_id").alias("filename")).agg(F.sum(F.size("decision.spans")).alias("redactions"), F.max("error").alias("error"))
        return plans.with_plan(files.select("filename"), plan).join(counts, "filename", "left").select("filename", "output_name", F.coalesce("redactions", F.lit(0)).cast("long").alias("redactions"), F.lit(-1).alias("pages"), F.lit(False).alias("used_ocr"), (~F.col("mapped")).alias("unmapped"), "error")

    def redact_docx(self, files: DataFrame, plan: DataFrame) -> DataFrame:
        """(filename, content) to (output_name, content) of redacted files. A file's runs are gathered in one row."""
        redacted = self.redact(self.paragraphs(files), plan).filter("error is null")
        whole = redacted.groupBy("doc_id", "output_name").agg(F.collect_list(F.struct("part", "idx", F.col("redacted_runs").alias("runs"))).alias("changed"))
        joined = files.join(whole.withColumnRenamed("doc_id", "filename"), "filename").select("output_name", "content", "changed")

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, content, changed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data = docx.rewritten(content, {(x["part"], x["idx"]): x["runs"] for x in changed})
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([data], pa.binary())], ["output_name", "content"])

        return joined.mapInArrow(rows, "output_name string, content binary")

    def verify(self, outputs: DataFrame, plan: DataFrame, strict: bool = False) -> DataFrame:
        """Findings in output files (filename, content): in their text, their properties and links, and their bytes; a file
        that can't be read is a finding too."""
        named = plans.by_output(outputs, plan)
        tokens = named.select(F.col("filename").alias("doc_id"), "surnames")
        read, found = self.reading(outputs), pdf.facts(outputs.filter(_is(".pdf")))
        unread = read.filter("error is not null").select("doc_id", F.lit("UNREADABLE").alias("kind"), F.col("error").alias("value"), F.lit(0).alias("ord"))
        texts = self._texts(read.filter("part = 'document'")).join(tokens, "doc_id")
        raw = blobs.blobs(outputs, most=self.config.stream_bytes).join(tokens, "doc_id")
        return audit.union_findings(unread, audit.text_findings(texts, strict), audit.metadata_findings(pdf.metadata(found), pdf.links(found)), audit.byte_findings(raw))

    def notes(self, outputs: DataFrame) -> DataFrame:
        """What a person should look at, once each (doc_id, note): images that may be photos, files without a text layer,
        and first names (of the file's name) that the text lacks."""
        found = pdf.facts(outputs.filter(_is(".pdf")))
        shaped = Q.photo_shaped(F.col("width"), F.col("height"), F.col("page_fraction"), self.config)
        photos = pdf.images(found).filter(shaped).select("doc_id", F.format_string("an image of %d x %d may be a photo", "width", "height").alias("note"))
        bare = audit.text_layer(pdf.pages(found)).filter("not has_text_layer").select("doc_id", F.lit("no page has text: read it by OCR").alias("note"))
        texts = self._texts(self.reading(outputs).filter("part = 'document'")).join(bare, "doc_id", "left_anti")
        names = audit.first_name_notes(texts.withColumn("first", plans.first_name_of(F.col("doc_id")))).select("doc_id", F.format_string("the first name %s is not in the text", "first").alias("note"))
        return photos.unionByName(bare).unionByName(names).distinct()

    def lost(self, files: DataFrame, outputs: DataFrame, plan: DataFrame) -> DataFrame:
        """Long lines of source files that the output of their plan lacks though they held no contact data."""

        def lines(of: DataFrame) -> DataFrame:
            return self._texts(self.reading(of).filter("part = 'document'")).select(F.col("doc_id").alias("filename"), F.explode(audit.lines_in(F.col("text"))).alias("line"))

        named = plan.select("filename", plans.output_of(plan).alias("output_name"))
        return audit.content_loss(lines(files).join(named, "filename"), lines(outputs).withColumnRenamed("filename", "output_name"), self.config)

    def serve(self, uploaded: list[tuple[str, bytes]], plan: DataFrame) -> bytes:
        """One request: uploaded files to a zip of what could be redacted and a manifest that names each file's error. Number
        and size of the files are bounded by the configuration; beyond it the call fails."""
        given = sources.uploads(self.spark, uploaded, self.config)
        written = [(r.output_name, bytes(r.content)) for r in self.redact_docx(given, plan).toLocalIterator()]
        rows = [r.asDict() for r in self.manifest(given, self.redact(self.paragraphs(given), plan), plan).orderBy("filename").toLocalIterator()]
        totals = {"total_redactions": sum(r["redactions"] for r in rows), "failed": sum(r["error"] is not None for r in rows)}
        return sinks.bundle(written, totals | {"files": rows})

    def _texts(self, paragraphs: DataFrame) -> DataFrame:
        rows = paragraphs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "idx", "runs"))).alias("p"))
        return rows.select("doc_id", F.array_join(F.transform("p", lambda x: F.array_join(x["runs"], "")), "\n").alias("text"))

    def text_only(self, lines: DataFrame, text: str = "text") -> DataFrame:
        """Lines of any table, redacted: what the format adapters share."""
        return redaction.redact_lines(lines, text, self.city, self.config).withColumn("joined", S.joined(F.col("decision.mask")))


def _is(suffix: str):
    return F.coalesce(F.endswith(F.lower("filename"), F.lit(suffix)), F.lit(False))
