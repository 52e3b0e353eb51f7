"""Words with geometry: lines, offsets, header flags, struck words, bands, boxes and OCR ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.config import DEFAULT, Config
from veilwork.functions import patterns as P
from veilwork.functions import predicates as Q
from veilwork.functions import spans as S

PAGE = ("doc_id", "page")


def lines_of(words: DataFrame) -> DataFrame:
    """Words to lines in reading order. A line's words are ordered by x0 (ties by word number); its text has a space after
    each word; `words` holds each with its range of characters."""
    grouped = words.groupBy(*PAGE, "block", "line").agg(F.array_sort(F.collect_list(F.struct("x0", "word_no", "y0", "x1", "y1", "text"))).alias("ws"), F.min("y0").alias("min_y0"), F.min("x0").alias("min_x0"))
    placed = F.transform("ws", lambda w, i: F.struct(F.aggregate(F.slice("ws", F.lit(1), i), F.lit(0), lambda a, x: a + F.char_length(x["text"]) + 1).alias("s"), w.alias("w")))
    ranged = F.transform(placed, lambda p: F.struct(p["s"].alias("s"), (p["s"] + F.char_length(p["w"]["text"])).alias("e"), *[p["w"][k].alias(k) for k in ("x0", "y0", "x1", "y1", "text")]))
    order = Window.partitionBy(*PAGE).orderBy("min_y0", "min_x0", "block", "line")
    rows = grouped.select(*PAGE, "block", "line", "min_y0", "min_x0", F.concat(F.array_join(F.transform("ws", lambda w: w["text"]), " "), F.lit(" ")).alias("text"), ranged.alias("words"))
    return rows.withColumn("idx", (F.row_number().over(order) - 1).cast("int"))


def running_offsets(words: DataFrame) -> DataFrame:
    """The first character of each word in its line, as a window over rows."""
    before = Window.partitionBy(*PAGE, "block", "line").orderBy("x0", "word_no").rowsBetween(Window.unboundedPreceding, -1)
    return words.withColumn("s", F.coalesce(F.sum(F.char_length("text") + 1).over(before), F.lit(0)).cast("long"))


def header_flags(lines: DataFrame, text: str = "text", config: Config = DEFAULT) -> DataFrame:
    """`header` and `top`: the first lines of the first page, up to the first heading."""
    so_far = Window.partitionBy(*PAGE).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    above = (F.max(Q.section_head(F.col(text)).cast("int")).over(so_far) == 0) & (F.col("page") == 0)
    return lines.withColumn("above", above).withColumns({"header": F.col("above") & (F.col("idx") < config.header_lines), "top": F.col("above") & (F.col("idx") < config.top_lines)}).drop("above")


def docx_header_flags(paragraphs: DataFrame, text: str = "text", config: Config = DEFAULT) -> DataFrame:
    """`header` of DOCX paragraphs: counted anew in each part."""
    so_far = Window.partitionBy("doc_id", "part").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return paragraphs.withColumn("header", (F.max(Q.section_head(F.col(text)).cast("int")).over(so_far) == 0) & (F.col("idx") < config.docx_header_paragraphs))


def struck(words: Column, spans: Column) -> Column:
    """Words (s, e, ...) that a span overlaps, each once."""
    return F.filter(words, lambda w: F.exists(spans, lambda x: S.overlaps(w, x)))


def struck_words(words: DataFrame, spans: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The same for tables (keys, s, e): spans of a key are gathered first, so that no pair is made. A line's spans are few."""
    few = spans.groupBy(*keys).agg(F.collect_set(F.struct("s", "e")).alias("found"))
    return words.join(few, list(keys)).filter(F.exists("found", lambda x: (F.col("s") < x["e"]) & (x["s"] < F.col("e")))).drop("found")


def words_in_rects(words: DataFrame, rects: DataFrame) -> DataFrame:
    """Words whose centre lies in a rectangle of their page: `pre` spans of label links."""
    few = rects.groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("rects"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return words.join(few, list(PAGE)).filter(F.exists("rects", lambda r: x.between(r["x0"], r["x1"]) & y.between(r["y0"], r["y1"]))).drop("rects")


def wrapped_text(words: DataFrame) -> DataFrame:
    """A block's words in one text for finding what wraps over a line's end: (block keys, text, words with ranges).

    A space stands before a word of the same line, or of a new line after a mark that ends a phrase; else words join."""
    order = Window.partitionBy(*PAGE, "block").orderBy("line", "word_no")
    last = F.lag(F.right("text", F.lit(1))).over(order)
    gap = F.coalesce((F.lag("line").over(order) == F.col("line")) | (last != "") & F.contains(F.lit(")],;:!?\"'"), last), F.lit(False)).cast("int")
    rows = words.withColumn("gap", gap)
    end = F.sum(F.col("gap") + F.char_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("e", end.cast("int")).withColumn("s", (F.col("e") - F.char_length("text")).cast("int"))
    grouped = rows.groupBy(*PAGE, "block").agg(F.array_sort(F.collect_list(F.struct("line", "word_no", "s", "e", "text", "gap"))).alias("words"))
    return grouped.withColumn("text", F.array_join(F.transform("words", lambda w: F.concat(F.repeat(F.lit(" "), w["gap"]), w["text"])), ""))


def wrapped_matches(words: DataFrame) -> DataFrame:
    """Words of contact data that wraps over lines; bare marks stay."""
    text = S.clean(F.col("text"))
    found = F.concat(S.spans(text, P.EMAIL, "EMAIL"), S.spans(text, P.URL, "URL"), Q.phone_spans(text))
    rows = wrapped_text(words).withColumn("found", found).filter(F.size("found") > 0)
    hit = F.filter(struck(F.col("words"), F.col("found")), lambda w: Q.has(w["text"], P.ALNUM))
    return rows.select(*PAGE, "block", F.explode(hit).alias("w")).select(*PAGE, "block", "w.line", "w.word_no", "w.text")


def inset_boxes(words: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Redaction boxes: a fifth of the height off above and below, so that neighbouring lines stay."""
    inset = (F.col("y1") - F.col("y0")) * config.box_inset
    return words.withColumns({"box_y0": F.col("y0") + inset, "box_y1": F.col("y1") - inset})


def underline_bands(struck_: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The strip below the struck words of each line."""
    hull = struck_.groupBy(*PAGE, "block", "line").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return hull.select(*PAGE, "block", "line", (F.col("x0") - 1).alias("band_x0"), (F.col("y1") - 1).alias("band_y0"), (F.col("x1") + 1).alias("band_x1"), (F.col("y1") + config.underline_band).alias("band_y1"))


def first_font_span(words: DataFrame, font_spans: DataFrame) -> DataFrame:
    """Each word with the first font span (by pos) that its rectangle meets; null without one. A page's spans are gathered."""
    few = font_spans.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("pos", "x0", "y0", "x1", "y1", "size", "color"))).alias("fonts"))
    meets = F.filter("fonts", lambda f: (f["x0"] < F.col("x1")) & (F.col("x0") < f["x1"]) & (f["y0"] < F.col("y1")) & (F.col("y0") < f["y1"]))
    return words.join(few, list(PAGE), "left").withColumn("font", F.get(meets, F.lit(0))).drop("fonts")


def rgb(color: Column) -> Column:
    part = lambda shift: F.shiftright(color, shift).bitwiseAND(F.lit(255)) / 255.0
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def ocr_header(y_centre: Column, page_height: Column, page: Column, config: Config = DEFAULT) -> Column:
    return (page == 0) & (y_centre < page_height * config.ocr_header_share)


def ocr_spans(line: Column, spans: Column, config: Config = DEFAULT) -> Column:
    """Spans for pixels: a contact row goes whole; else a span near an end of the line goes on to it."""
    n = F.char_length(line)
    snap = lambda x: F.struct(F.when(x["s"] <= config.ocr_snap_chars, F.lit(0)).otherwise(x["s"]).alias("s"), F.when(n - x["e"] <= config.ocr_snap_chars, n).otherwise(x["e"]).alias("e"), x["kind"].alias("kind"))
    whole = F.array(F.struct(F.lit(0).alias("s"), n.alias("e"), F.lit("LINE").alias("kind")))
    return F.when(F.size(spans) == 0, spans).when(Q.has(line, P.CONTACT_HINT), whole).otherwise(F.transform(spans, snap))


def pixel_range(s: Column, e: Column, n: Column, left: Column, right: Column, top: Column, bottom: Column, page_w: Column, page_h: Column, config: Config = DEFAULT) -> Column:
    """The pixels of characters s to e of n in a box, padded and within the page."""
    width = right - left
    pad = width * config.ocr_pad_share + config.ocr_pad_pixels
    return F.struct(
        F.greatest(F.lit(0), F.floor(left + width * s / n - pad)).cast("int").alias("px0"),
        F.least(page_w, F.floor(left + width * e / n + pad)).cast("int").alias("px1"),
        F.greatest(F.lit(0), F.floor(top - 2)).cast("int").alias("py0"),
        F.least(page_h, F.floor(bottom + 3)).cast("int").alias("py1"),
    )


def images_shown(images: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Each image of a document once, by its first place; photo-shaped ones first, then by area; the first 24."""
    once = Window.partitionBy("doc_id", "xref").orderBy("page", "pos")
    shaped = Q.photo_shaped(F.col("width"), F.col("height"), F.col("page_fraction"), config)
    rows = images.filter("width > 0 and height > 0").withColumn("nth", F.row_number().over(once)).filter("nth = 1").withColumn("photo", shaped)
    order = Window.partitionBy("doc_id").orderBy(F.col("photo").desc(), (F.col("width").cast("long") * F.col("height")).desc(), "page", "pos", "xref")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.images_shown).drop("nth")


def photo_rects(plan: DataFrame, images: DataFrame) -> DataFrame:
    """Places of the images that a plan wants gone."""
    return images.join(plan.select("doc_id", F.explode("photo_xrefs").alias("xref")).distinct(), ["doc_id", "xref"])
