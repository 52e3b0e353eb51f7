"""Tests of tokens and lines as boolean columns, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.config import DEFAULT, Config
from veilwork.functions import patterns as P
from veilwork.functions import spans as S


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def n_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def phone_spans(line: Column) -> Column:
    """Candidates of 10 to 15 digits that are not two years or more."""
    digits = lambda t: n_of(t, P.DIGIT)
    years = lambda t: has(t, P.java(r"^[\d\s\-.]+\z", False)) & (digits(t) <= 12) & (n_of(t, P.YEAR) >= 2)
    good = F.filter(S.matches(line, P.PHONE_CANDIDATE), lambda m: digits(m["text"]).between(10, 15) & ~years(m["text"]))
    return F.transform(good, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lit("PHONE").alias("kind")))


def city_spans(line: Column, city: str = P.CITY) -> Column:
    """Places that no organisation's ending follows; state codes too if the line has a comma."""
    places = F.filter(S.spans(line, city, "CITY"), lambda m: ~has(F.substring(line, m["e"] + 1, F.lit(16)), P.ORG_SUFFIX))
    return F.when(F.contains(line, F.lit(",")), F.concat(places, S.spans(line, P.STATE_ABBR, "STATE"))).otherwise(places)


def link_label_only(anchor: Column) -> Column:
    words = F.filter(F.split(F.coalesce(anchor, F.lit("")), "[^A-Za-z0-9]+"), lambda w: w != "")
    return S.let(words, lambda ws: (F.size(ws) > 0) & F.forall(ws, lambda w: has(w, P.CONTACT_PLATFORM) | has(w, P.CONTACT_LABEL) | has(w, P.LINK_FILLER)))


def label_line(line: Column) -> Column:
    """Only labels and glyphs, with a label among them or three tokens at most."""
    tokens = F.filter(F.split(line, P.java(r"\s+", False)), lambda t: t != "")
    glyph = lambda t: (n_of(t, P.ALNUM) < 2) & ~has(t, P.DIGIT)
    spelled = lambda t: has(t, rf"{P.ALNUM}\z") & has(t, rf"^{P.ALNUM}+\z")
    label = lambda t: has(t, P.CONTACT_PLATFORM) | has(t, P.CONTACT_HEAD) | (has(t, P.CONTACT_LABEL) & ~spelled(t))
    return S.let(tokens, lambda ts: (F.size(ts) > 0) & F.forall(ts, lambda t: glyph(t) | label(t)) & (F.exists(ts, lambda t: ~glyph(t)) | (F.size(ts) <= 3)))


def is_word(token: Column) -> Column:
    return (n_of(token, P.ALNUM) > 1) | has(token, P.DIGIT) | F.lower(F.btrim(token, F.lit(".,:;|()"))).isin("i", "a")


def is_kept(token: Column, first: Column) -> Column:
    return F.btrim(F.lower(token), F.lit(".,:;|")) == F.coalesce(F.lower(first), F.lit(""))


def address_like(line: Column, top: Column, city: str = P.CITY, config: Config = DEFAULT) -> Column:
    comma = F.contains(line, F.lit(","))
    return (F.char_length(line) <= config.address_chars) & has(line, P.DIGIT) & (has(line, P.STREET) | (has(line, P.PIN) & (comma | has(line, city))) | (has(line, P.ADDRESS_NUM) & (top | comma)))


def contact_row(line: Column) -> Column:
    return has(line, P.CONTACT_HINT) | has(line, P.STREET)


def title_word(token: Column) -> Column:
    return has(F.btrim(token, F.lit(".,:;|()")), P.TITLE_WORD)


def section_head(line: Column) -> Column:
    return has(line, P.SECTION_HEAD)


def photo_shaped(width: Column, height: Column, page_share: Column, config: Config = DEFAULT) -> Column:
    ratio = F.try_divide(width.cast("double"), height.cast("double"))
    return F.coalesce((width >= config.photo_side) & (height >= config.photo_side) & ratio.between(config.photo_ratio_low, config.photo_ratio_high) & ~(page_share > config.photo_page_share), F.lit(False))


def supported(filename: Column) -> Column:
    return has(filename, r"(?i)\.(pdf|docx)\z")


def expected_loss(line: Column) -> Column:
    return has(line, P.CONTACT_LINE)
