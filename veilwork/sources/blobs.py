"""What the structural audit reads: a file's bytes, the members of a zip, and every zlib stream that inflates."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from veilwork.config import DEFAULT

_STREAM = re.compile(rb"stream\r?\n")


def blobs_of(content: bytes, most: int = DEFAULT.stream_bytes) -> Iterator[tuple[str, bytes]]:
    """The bytes of a file, then what inflates from each stream in it. At most `most` compressed bytes of a stream are read,
    and all that they inflate to."""
    yield "raw", content
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for name in archive.namelist():
                try:
                    yield name, archive.read(name)
                except (zipfile.BadZipFile, zlib.error, RuntimeError):
                    continue
        return
    view = memoryview(content)
    for n, m in enumerate(_STREAM.finditer(content)):
        try:
            yield f"stream {n}", zlib.decompressobj().decompress(view[m.end() : m.end() + most])
        except zlib.error:
            continue


def blobs(files: DataFrame, key: str = "filename", most: int = DEFAULT.stream_bytes) -> DataFrame:
    """doc_id, place, data of every file (key, content)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for place, data in blobs_of(content.as_py() or b"", most):
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.string()), pa.array([place], pa.string()), pa.array([data], pa.binary())], ["doc_id", "place", "data"])

    return files.selectExpr(f"cast({key} as string) k", "content").mapInArrow(rows, "doc_id string, place string, data binary")
