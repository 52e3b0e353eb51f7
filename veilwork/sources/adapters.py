"""PDF text and OCR stand behind adapters: their libraries are optional, and their absence is told, not hidden.

An adapter turns (filename, content) rows into the tables `words`, `links`, `images` or `ocr_boxes`; what follows works on
those tables alone.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WORDS = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, block int, line int, word_no int"


class MissingLibrary(RuntimeError):
    """A format's library is not installed."""


def need(name: str):
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise MissingLibrary(f"{name} is not installed; this format can't be read or written here") from e


def pdf_words(files: DataFrame, key: str = "filename") -> DataFrame:
    """Words with boxes of each page. Not exercised where the library is missing."""
    need("pymupdf")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pdf = need("pymupdf")
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with pdf.open(stream=content.as_py(), filetype="pdf") as opened:
                    for page in opened:
                        found = page.get_text("words")
                        columns = list(zip(*found, strict=True)) or [[]] * 8
                        kinds = [pa.float64()] * 4 + [pa.string()] + [pa.int32()] * 3
                        yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.string()), pa.array([page.number] * len(found), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], WORDS.replace(" string", "").replace(" int", "").replace(" double", "").split(", "))

    return files.selectExpr(f"cast({key} as string) k", "content").mapInArrow(rows, WORDS)


def ocr_boxes(files: DataFrame) -> DataFrame:
    """Recognised lines of scanned pages; needs an OCR engine."""
    need("rapidocr")
    raise MissingLibrary("no OCR adapter is set up")
