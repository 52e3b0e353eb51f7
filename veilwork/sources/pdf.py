"""PDF by the standard library: page text, link targets, document properties and placed images, for the scan and the audit.

It reads what its objects say: Flate or plain streams, object streams, fonts with a ToUnicode map or one-byte Latin codes.
Text under other filters or encodings is not read, encrypted files are an error of their row, and nothing is written.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = "doc_id string, what string, page int, pos int, key string, value string, xref int, width int, height int, page_fraction double"
_COLUMNS = ["doc_id", "what", "page", "pos", "key", "value", "xref", "width", "height", "page_fraction"]
_KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]

_TOKEN = re.compile(
    rb"""[\x00\t\n\x0c\r ]+|%[^\r\n]*
    |(?P<ref>\d+\s+\d+\s+R(?![A-Za-z]))|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))
    |(?P<name>/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<open><<|\[)|(?P<close>>>|\])
    |(?P<hex><[0-9A-Fa-f\s]*>)|(?P<text>\()|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|.""",
    re.X | re.S,
)
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_STREAM = re.compile(rb"\s*stream\r?\n")
_PAREN = re.compile(rb"\\.|[()]", re.S)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|\n|\r)|(.))", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(NamedTuple):
    number: int


class Name(str):
    pass


class Word(str):
    """An operator or keyword."""


def _string_end(data: bytes, at: int) -> int:
    depth = 1
    for m in _PAREN.finditer(data, at):
        depth += {b"(": 1, b")": -1}.get(m[0], 0)
        if not depth:
            return m.start()
    return len(data)


def _unescaped(raw: bytes) -> bytes:
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else b"" if m[2] else _ESCAPED.get(m[3], m[3]), raw)


def values(data: bytes, at: int = 0) -> Iterator[tuple[Any, int]]:
    """Values and operators from a place on, each with its end."""
    open_: list[tuple[bytes, list]] = []
    while at < len(data):
        m = _TOKEN.match(data, at)
        at, kind = m.end(), m.lastgroup
        if kind is None:
            continue
        if kind == "open":
            open_.append((m[0], []))
            continue
        if kind == "close":
            if not open_:
                continue
            mark, inner = open_.pop()
            value: Any = inner if mark == b"[" else {str(k): v for k, v in zip(inner[::2], inner[1::2], strict=False)}
        elif kind == "ref":
            value = Ref(int(m[0].split()[0]))
        elif kind == "num":
            value = float(m[0]) if b"." in m[0] else int(m[0])
        elif kind == "name":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0][1:]).decode("latin-1"))
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", m[0][1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "text":
            end = _string_end(data, at)
            value, at = _unescaped(data[at:end]), end + 1
        else:
            value = Word(m[0].decode("latin-1"))
        if open_:
            open_[-1][1].append(value)
        else:
            yield value, at


class Document:
    """The objects of one file: number to value, and the bytes of streams. Later objects of a number replace earlier ones."""

    def __init__(self, content: bytes) -> None:
        if b"%PDF" not in content[:1024]:
            raise ValueError("no PDF")
        self.objects: dict[int, Any] = {}
        self.streams: dict[int, bytes] = {}
        self.trailer: dict[str, Any] = {}
        at = 0
        while m := _OBJECT.search(content, at):
            number = int(m[1])
            value, at = next(values(content, m.end()), (None, len(content)))
            self.objects[number] = value
            self.streams.pop(number, None)
            if isinstance(value, dict) and (s := _STREAM.match(content, at)):
                length = self.get(value.get("Length"))
                end = s.end() + length if isinstance(length, int) else -1
                if end < 0 or not content[end : end + 12].lstrip().startswith(b"endstream"):
                    found = content.find(b"endstream", s.end())
                    end = found if found >= 0 else len(content)
                self.streams[number], at = content[s.end() : end], end
                if value.get("Type") == "ObjStm":
                    self._packed(number, value)
                elif value.get("Type") == "XRef":
                    self._trailer(value)
        for m in re.finditer(rb"\btrailer\b", content):
            self._trailer(next(values(content, m.end()), (None, 0))[0])
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted PDF")

    def _trailer(self, value: Any) -> None:
        if isinstance(value, dict):
            self.trailer |= {k: value[k] for k in ("Root", "Info", "Encrypt") if k in value}

    def _packed(self, number: int, about: dict) -> None:
        data, first = self.data(number), self.get(about.get("First"))
        heads = [v for v, _ in values(data[:first])]
        for n, offset in zip(heads[::2], heads[1::2], strict=False):
            self.objects[n] = next(values(data, first + offset), (None, 0))[0]
            self.streams.pop(n, None)

    def get(self, value: Any) -> Any:
        for _ in range(32):  # a chain of references that does not end is null
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        return None

    def dict_of(self, value: Any) -> dict:
        found = self.get(value)
        return found if isinstance(found, dict) else {}

    def list_of(self, value: Any) -> list:
        found = self.get(value)
        return found if isinstance(found, list) else []

    def data(self, number: int) -> bytes:
        """A stream's bytes; empty under filters other than Flate."""
        filters = self.get(self.dict_of(Ref(number)).get("Filter"))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        data = self.streams.get(number, b"")
        for f in filters:
            if self.get(f) not in ("FlateDecode", "Fl"):
                return b""
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                return b""
        return data

    def pages(self) -> Iterator[dict]:
        """Pages in order, with what they inherit."""
        going, seen = [(self.dict_of(self.trailer.get("Root")).get("Pages"), {})], set()
        while going:
            ref, above = going.pop()
            if isinstance(ref, Ref):
                if ref in seen:
                    continue
                seen.add(ref)
            node = self.dict_of(ref)
            own = {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" in node:
                going += [(k, above | own) for k in self.list_of(node["Kids"])[::-1]]
            elif node:
                yield above | node

    def properties(self) -> dict[str, str]:
        return {k.lower(): text_string(v) for k, v in ((k, self.get(v)) for k, v in self.dict_of(self.trailer.get("Info")).items()) if isinstance(v, bytes)}

    def links(self, page: dict) -> Iterator[str]:
        for a in self.list_of(page.get("Annots")):
            uri = self.get(self.dict_of(self.dict_of(a).get("A")).get("URI"))
            if isinstance(uri, bytes) and uri:
                yield text_string(uri)


def text_string(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


class _Font:
    """How a font's codes read: by its ToUnicode map, else one byte a character."""

    def __init__(self, document: Document, about: dict) -> None:
        self.codes: dict[bytes, str] = {}
        self.wide = about.get("Subtype") == "Type0"
        if isinstance(ref := about.get("ToUnicode"), Ref):
            self._map(document.data(ref.number))

    def _map(self, data: bytes) -> None:
        pending: list = []
        for v, _ in values(data):
            if not isinstance(v, Word):
                pending.append(v)
                continue
            if v == "endbfchar":
                for code, to in zip(pending[::2], pending[1::2], strict=False):
                    if isinstance(code, bytes) and isinstance(to, bytes):
                        self.codes[code] = to.decode("utf-16-be", "replace")
            elif v == "endbfrange":
                for low, high, to in zip(pending[::3], pending[1::3], pending[2::3], strict=False):
                    self._range(low, high, to)
            pending = []

    def _range(self, low: Any, high: Any, to: Any) -> None:
        if not (isinstance(low, bytes) and isinstance(high, bytes) and 0 < len(low) <= 2):
            return
        first = int.from_bytes(low)
        for n in range(first, int.from_bytes(high[: len(low)]) + 1):
            if isinstance(to, list):
                if n - first < len(to) and isinstance(to[n - first], bytes):
                    self.codes[n.to_bytes(len(low))] = to[n - first].decode("utf-16-be", "replace")
            elif isinstance(to, bytes) and to:
                last = (int.from_bytes(to) + n - first) & (1 << 8 * len(to)) - 1
                self.codes[n.to_bytes(len(low))] = last.to_bytes(len(to)).decode("utf-16-be", "replace")

    def read(self, raw: bytes) -> str:
        if self.wide:
            return "".join(self.codes.get(raw[i : i + 2], "�") for i in range(0, len(raw), 2))
        return "".join(self.codes.get(raw[i : i + 1]) or raw[i : i + 1].decode("cp1252", "replace") for i in range(len(raw)))


def _times(a: tuple, b: tuple) -> tuple:
    """The transformation a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def shown(document: Document, page: dict) -> tuple[str, list[tuple[int, int, int, float]]]:
    """A page's text, a line for each change of height, and its images: number, width, height, share of the page."""
    box = [x if isinstance(x, int | float) else 0 for x in map(document.get, document.list_of(page.get("MediaBox")))]
    area = abs((box[2] - box[0]) * (box[3] - box[1])) if len(box) == 4 else 0
    out: list[str] = []
    images: list[tuple[int, int, int, float]] = []

    def gap(mark: str) -> None:
        if out and not out[-1].endswith(("\n", " ")):
            out.append(mark)
        elif mark == "\n" and out and not out[-1].endswith("\n"):
            out[-1] = out[-1].rstrip(" ") + "\n"

    def draw(data: bytes, resources: dict, matrix: tuple, inside: frozenset) -> None:
        fonts, objects = document.dict_of(resources.get("Font")), document.dict_of(resources.get("XObject"))
        known: dict[str, _Font] = {}
        font, kept, args, at = _Font(document, {}), [], [], None
        for v, _ in values(data):
            if not isinstance(v, Word):
                args.append(v)
                continue
            numbers = [x for x in args if isinstance(x, int | float)]
            if v == "q":
                kept.append(matrix)
            elif v == "Q" and kept:
                matrix = kept.pop()
            elif v == "cm" and len(numbers) == 6:
                matrix = _times(tuple(numbers), matrix)
            elif v == "Tf" and args and isinstance(args[0], Name):
                font = known.setdefault(args[0], _Font(document, document.dict_of(fonts.get(args[0]))))
            elif v in ("Td", "TD") and len(numbers) == 2:
                gap("\n" if numbers[1] else " ")
                at = None if at is None else at + numbers[1]
            elif v == "Tm" and len(numbers) == 6:
                gap(" " if at is not None and abs(numbers[5] - at) < 1 else "\n")
                at = numbers[5]
            elif v in ("T*", "'", '"', "BT"):
                gap("\n")
            if v in ("Tj", "'", '"'):
                out.extend(font.read(x) for x in args if isinstance(x, bytes))
            elif v == "TJ" and args and isinstance(args[0], list):
                for x in args[0]:
                    if isinstance(x, bytes):
                        out.append(font.read(x))
                    elif isinstance(x, int | float) and x < -200:
                        gap(" ")
            elif v == "Do" and args and isinstance(ref := objects.get(str(args[0])), Ref) and ref not in inside:
                about = document.dict_of(ref)
                if about.get("Subtype") == "Image":
                    w, h = document.get(about.get("Width")), document.get(about.get("Height"))
                    if isinstance(w, int) and isinstance(h, int):
                        images.append((ref.number, w, h, abs(matrix[0] * matrix[3] - matrix[1] * matrix[2]) / area if area else 0.0))
                elif about.get("Subtype") == "Form":
                    own = [x for x in document.list_of(about.get("Matrix")) if isinstance(x, int | float)]
                    draw(document.data(ref.number), document.dict_of(about.get("Resources")) or resources, _times(tuple(own), matrix) if len(own) == 6 else matrix, inside | {ref})
            args = []

    contents = page.get("Contents")
    parts = contents if isinstance(contents, Ref) and isinstance(document.get(contents), dict) else None
    refs = [parts] if parts else document.list_of(contents)
    draw(b"\n".join(document.data(r.number) for r in refs if isinstance(r, Ref)), document.dict_of(page.get("Resources")), (1, 0, 0, 1, 0, 0), frozenset())
    return "".join(out).strip("\n"), images


def facts_of(content: bytes) -> Iterator[tuple]:
    """What a file holds, without its id: (what, page, pos, key, value, xref, width, height, page_fraction)."""
    document = Document(content)
    for pos, (key, value) in enumerate(document.properties().items()):
        yield "metadata", None, pos, key, value, None, None, None, None
    for n, page in enumerate(document.pages()):
        text, images = shown(document, page)
        yield "page", n, 0, None, text, None, None, None, None
        for pos, uri in enumerate(document.links(page)):
            yield "link", n, pos, None, uri, None, None, None, None
        for pos, (xref, w, h, share) in enumerate(images):
            yield "image", n, pos, None, None, xref, w, h, share


def facts(files: DataFrame, key: str = "filename") -> DataFrame:
    """Facts of each PDF (key, content); a file that can't be read (null and empty ones too) gives one row `error`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = list(facts_of(content.as_py() or b""))
                except Exception as e:  # whatever a broken file makes of itself is its own row's error
                    found = [("error", None, 0, None, f"{type(e).__name__}: {e}", None, None, None, None)]
                columns = list(zip(*found, strict=True)) or [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.string()), *(pa.array(c, k) for c, k in zip(columns, _KINDS[1:], strict=True))], _COLUMNS)

    return files.selectExpr(f"cast({key} as string) k", "content").mapInArrow(rows, FACTS)


def pages(found: DataFrame) -> DataFrame:
    return found.filter("what = 'page'").select("doc_id", "page", F.col("value").alias("text"))


def metadata(found: DataFrame) -> DataFrame:
    return found.filter("what = 'metadata'").select("doc_id", "key", "value")


def links(found: DataFrame) -> DataFrame:
    return found.filter("what = 'link'").select("doc_id", "page", F.col("value").alias("uri"))


def images(found: DataFrame) -> DataFrame:
    return found.filter("what = 'image'").select("doc_id", "page", "pos", "xref", "width", "height", "page_fraction")


def errors(found: DataFrame) -> DataFrame:
    return found.filter("what = 'error'").select("doc_id", F.col("value").alias("error"))
