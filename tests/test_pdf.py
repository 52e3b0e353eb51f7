"""PDF reading by the standard library on files made here, the audit over both formats, and one request."""

import zlib

import pytest
from test_engine import CV, PLAN, docx_file

from veilwork.engine import Engine
from veilwork.plans import plan as plans
from veilwork.sources import files, pdf

FILES = "filename string, content binary"


def pdf_file(contents, info=b"", annots=b"", extra=(), resources=b"", trailer=b""):
    """A file with a page for each content stream; `extra` objects are numbered from 50 on."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    objects = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /MediaBox [0 0 600 800] /Kids [" + kids + b"] /Count %d >>" % len(contents)), (3, b"<< " + info + b" >>")]
    for i, content in enumerate(contents):
        packed = zlib.compress(content)
        objects.append((10 + 2 * i, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Annots [" % (11 + 2 * i) + annots + b"] /Resources << " + resources + b" >> >>"))
        objects.append((11 + 2 * i, b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream"))
    objects += [(50 + i, x) for i, x in enumerate(extra)]
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects)
    return b"%PDF-1.7\n" + body + b"trailer\n<< /Root 1 0 R /Info 3 0 R " + trailer + b" >>\n%%EOF"


def facts(content):
    return [tuple(x for x in f if x is not None) for f in pdf.facts_of(content)]


def test_text_lines():
    page = rb"BT /F1 12 Tf 72 700 Td (Ada \(A.\) Rowe) Tj 0 -14 Td [(Sen) -20 (ior) -300 (Engineer)] TJ 1 0 0 1 72 600 Tm (caf\351) Tj 1 0 0 1 200 600 Tm <617420776f726b> Tj T* (end) Tj ET"
    assert facts(pdf_file([page, b"", b"BT (two) Tj ET"])) == [("page", 0, 0, "Ada (A.) Rowe\nSenior Engineer\ncafé at work\nend"), ("page", 1, 0, ""), ("page", 2, 0, "two")]


def test_fonts_forms_and_packed_objects():
    cmap = b"1 beginbfchar <0001> <0041> endbfchar 2 beginbfrange <0002> <0003> <0064> <0004> <0005> [<00610021> <D83DDE00>] endbfrange"
    packed = b"70 0 71 40 " + b"<< /Subtype /Type0 /ToUnicode 50 0 R >>".ljust(40) + b"<< /F 70 0 R >>"
    form = b"BT /F 12 Tf <0001000200050009> Tj ET"
    extra = [
        b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream",
        b"<< /Type /ObjStm /N 2 /First 11 /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream",
        b"<< /Subtype /Form /Resources << /Font 71 0 R >> /Length %d >>\nstream\n" % len(form) + form + b"\nendstream",
    ]
    assert facts(pdf_file([b"/X Do"], extra=extra, resources=b"/XObject << /X 52 0 R >>")) == [("page", 0, 0, "Ad😀�")]


def test_links_properties_and_images():
    made = pdf_file(
        [b"q 300 0 0 400 0 0 cm /I Do Q"],
        info=rb"/Author (Ada Rowe) /Title <FEFF00C1> /Producer (x)",
        annots=b"<< /Subtype /Link /A << /S /URI /URI (mailto:ada@example.com) >> >> << /Subtype /Link >>",
        extra=[b"<< /Subtype /Image /Width 200 /Height 300 /Length 1 >>\nstream\nx\nendstream"],
        resources=b"/XObject << /I 50 0 R >>",
    )
    assert facts(made) == [("metadata", 0, "author", "Ada Rowe"), ("metadata", 1, "title", "Á"), ("metadata", 2, "producer", "x"), ("page", 0, 0, ""), ("link", 0, 0, "mailto:ada@example.com"), ("image", 0, 0, 50, 200, 300, 0.25)]


def test_later_objects_stand_and_loops_end():
    grown = pdf_file([b"BT (old) Tj ET"]) + b"\n11 0 obj\n<< /Length 14 >>\nstream\nBT (new) Tj ET\nendstream\nendobj\n"
    assert facts(grown) == [("page", 0, 0, "new")]
    looped = pdf_file([b"/X Do"], extra=[b"<< /Subtype /Form /Length 5 >>\nstream\n/X Do\nendstream"], resources=b"/XObject << /X 50 0 R >>")
    assert facts(looped.replace(b"/Kids [", b"/Kids [2 0 R ")) == [("page", 0, 0, "")]
    for bad in (b"", b"no pdf", pdf_file([b""], trailer=b"/Encrypt 4 0 R")):
        with pytest.raises(ValueError):
            list(pdf.facts_of(bad))


def test_audit_of_both_formats(spark):
    engine, plan = Engine(spark), spark.createDataFrame([*PLAN, ("bo.pdf", ["Rowe"], "x/Bo_Redacted.pdf", None, None)], plans.PLAN)
    lost = b"Built a data platform with ten engineers and many other people"
    source = pdf_file([b"BT (Bo Rowe) Tj 0 -14 Td (" + lost + b") Tj ET"])
    output = pdf_file([b"BT (Mr Rowe) Tj ET q 1 0 0 1 0 0 cm /I Do Q"], info=b"/Author (B)", annots=b"<< /A << /URI (https://example.org/bo) >> >>", extra=[b"<< /Subtype /Image /Width 200 /Height 200 >>"], resources=b"/XObject << /I 50 0 R >>")
    outputs = spark.createDataFrame([("Bo_Redacted.pdf", bytearray(output)), ("Scan_1.pdf", bytearray(pdf_file([b""]))), ("bad.pdf", None)], FILES)
    found = {(r.doc_id, r.kind, r.value) for r in engine.verify(outputs, plan).collect()}
    assert {("Bo_Redacted.pdf", "NAME", "Rowe"), ("Bo_Redacted.pdf", "METADATA author", "B"), ("Bo_Redacted.pdf", "LINK", "https://example.org/bo")} <= found
    assert [x[0] for x in found if x[1] == "UNREADABLE"] == ["bad.pdf"] and not [x for x in found if x[0] == "Scan_1.pdf"]
    notes = sorted((r.doc_id, r.note) for r in engine.notes(outputs).collect())
    assert notes == [("Bo_Redacted.pdf", "an image of 200 x 200 may be a photo"), ("Bo_Redacted.pdf", "the first name Bo is not in the text"), ("Scan_1.pdf", "no page has text: read it by OCR")]
    sources = spark.createDataFrame([("bo.pdf", bytearray(source)), ("cv.docx", bytearray(docx_file(CV)))], FILES)
    assert [(r.output_name, r.line) for r in engine.lost(sources, outputs, plan).collect()] == [("Bo_Redacted.pdf", lost.decode())]
    scanned = {r.filename: r.header_lines for r in engine.scan(sources, engine.reading(sources)).collect()}
    assert scanned["bo.pdf"][0] == "Bo Rowe" and scanned["cv.docx"][0] == "Ada Rowe"


def test_one_request(spark):
    plan = spark.createDataFrame(PLAN, plans.PLAN)
    bundle = Engine(spark).serve([("cv.docx", docx_file(CV)), ("bo.pdf", pdf_file([b""])), ("broken.docx", b"x")], plan)
    said = files.manifest_in(bundle)
    assert {f["filename"]: f["error"] is None for f in said["files"]} == {"cv.docx": True, "bo.pdf": False, "broken.docx": False}
    assert said["failed"] == 2 and said["total_redactions"] >= 3 and files.manifest_in(b"no zip") is None and files.manifest_in(b"") is None
