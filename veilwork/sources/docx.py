"""DOCX by the standard library: paragraphs as rows, and the rewriting of a file with redacted runs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PART = re.compile(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml")
PARAGRAPHS = "doc_id string, part string, idx int, runs array<string>, error string"
CORE = ("creator", "lastModifiedBy", "title", "subject", "keywords", "description", "category")


def _parts(archive: zipfile.ZipFile) -> list[str]:
    return sorted(n for n in archive.namelist() if _PART.fullmatch(n))


def _own_texts(paragraph: ElementTree.Element) -> list[ElementTree.Element]:
    """Text nodes of a paragraph, those of hyperlinks too, but not those of paragraphs in it (text boxes), which are
    paragraphs by themselves and are counted once."""
    out, going = [], list(paragraph)[::-1]
    while going:
        node = going.pop()
        if node.tag == f"{_W}p":
            continue
        if node.tag == f"{_W}t":
            out.append(node)
        going += list(node)[::-1]
    return out


def paragraphs_of(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """Part, index in the part, and the text of each run of every paragraph."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for part in _parts(archive):
            for idx, p in enumerate(ElementTree.fromstring(archive.read(part)).iter(f"{_W}p")):
                yield part.removeprefix("word/").removesuffix(".xml"), idx, [t.text or "" for t in _own_texts(p)]


def rewritten(content: bytes, runs: dict[tuple[str, int], list[str]]) -> bytes:
    """The file with the runs of the given paragraphs; link targets and core properties are blank."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as archive, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for name in archive.namelist():
            data = archive.read(name)
            if _PART.fullmatch(name):
                root = ElementTree.fromstring(data)
                part = name.removeprefix("word/").removesuffix(".xml")
                for idx, p in enumerate(root.iter(f"{_W}p")):
                    for node, text in zip(_own_texts(p), runs.get((part, idx), ()), strict=False):
                        node.text = text
                data = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            elif name.endswith(".rels"):
                root = ElementTree.fromstring(data)
                for link in root:
                    if link.get("Type", "").endswith("/hyperlink"):
                        link.set("Target", "about:blank")
                data = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            elif name == "docProps/core.xml":
                root = ElementTree.fromstring(data)
                for node in root:
                    if node.tag.rpartition("}")[2] in CORE:
                        node.text = ""
                data = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            to.writestr(name, data)
    return out.getvalue()


def paragraphs(files: DataFrame, key: str = "filename") -> DataFrame:
    """Paragraphs of each file (key, content); a file that can't be read gives one row with its error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = [(doc, part, idx, runs, None) for part, idx, runs in paragraphs_of(content.as_py() or b"")]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                    found = [(doc, None, None, [], f"{type(e).__name__}: {e}")]
                columns = list(zip(*found, strict=True)) or [[]] * 5
                kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "part", "idx", "runs", "error"])

    return files.selectExpr(f"cast({key} as string) k", "content").mapInArrow(rows, PARAGRAPHS)
