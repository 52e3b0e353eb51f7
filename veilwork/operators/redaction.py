"""The span decision and the residue sweep, as columns of one line.

`decide` is a pure function of the line, its place (header, top), the plan's tokens and first name, and spans that were
decided outside the text (`pre`). Lines without any span skip the sweep, which is the costly part. `redact_lines` decides
only lines that one cheap search finds something in, or whose place or plan may give spans, and decides them once: the
decision comes out of a Generate, so what filters or reads it does not make it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.config import DEFAULT, Config
from veilwork.functions import patterns as P
from veilwork.functions import predicates as Q
from veilwork.functions import spans as S


def _chunk_spans(found: Column) -> Column:
    return F.transform(found, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.lit("RESIDUE").alias("kind")))


def _fragments(masked: Column, first: Column) -> Column:
    """Chunks that touch what is gone."""
    gone = lambda at: F.substring(masked, at, F.lit(1)) == S.GONE
    touching = F.filter(S.chunks(masked), lambda c: ~Q.is_kept(c["text"], first) & ((c["s"] > 0) & gone(c["s"]) | gone(c["e"] + 1)))
    return S.erase(masked, _chunk_spans(touching))


def _labels(masked: Column, first: Column) -> Column:
    def of(alive: Column) -> Column:
        follows = lambda i: F.coalesce(F.get(alive, i + 1)["text"], F.lit(""))
        loose = lambda c, i: ~Q.has(c["text"], rf"{P.ALNUM}\z") | ~Q.has(follows(i), P.ALNUM)
        gone = F.filter(alive, lambda c, i: ~Q.is_kept(c["text"], first) & (Q.has(c["text"], P.CONTACT_PLATFORM) | Q.has(c["text"], P.CONTACT_LABEL) & loose(c, i)))
        return S.erase(masked, _chunk_spans(gone))

    return S.let(S.chunks(masked), of)


def _separators(masked: Column) -> Column:
    """Chunks that are no words stay only between the first word and the last."""

    def of(alive: Column) -> Column:
        words = F.filter(alive, lambda c: Q.is_word(c["text"]))
        low, high = F.coalesce(F.array_min(F.transform(words, lambda c: c["s"])), F.lit(1 << 30)), F.coalesce(F.array_max(F.transform(words, lambda c: c["s"])), F.lit(-1))
        gone = F.filter(alive, lambda c: ~Q.is_word(c["text"]) & ~((c["s"] > low) & (c["s"] < high)))
        return S.erase(masked, _chunk_spans(gone))

    return S.let(S.chunks(masked), of)


def _remainder(masked: Column, first: Column, config: Config) -> Column:
    def of(words: Column) -> Column:
        few = F.size(words).between(1, config.residue_words) & ~F.exists(words, lambda c: Q.title_word(c["text"]))
        return F.when(few, S.erase(masked, _chunk_spans(F.filter(words, lambda c: ~Q.is_kept(c["text"], first))))).otherwise(masked)

    return S.let(F.filter(S.chunks(masked), lambda c: Q.is_word(c["text"])), of)


def residue(masked: Column, first: Column, sweep: Column, config: Config = DEFAULT) -> Column:
    """The mask after the sweep. A pass that changes nothing leaves the mask, so a fixed number of passes is the same as
    stopping early."""
    left = F.aggregate(S.chunks(masked), F.lit(0), lambda a, c: a + F.char_length(c["text"]) + 1)
    once = lambda m: S.let(_separators(m), lambda x: F.when(sweep, _remainder(x, first, config)).otherwise(x))
    start = S.let(_fragments(masked, first), lambda m: _labels(m, first))
    swept = F.aggregate(F.sequence(F.lit(1), F.lit(config.residue_passes)), start, lambda m, _: once(m))
    return F.when(left > config.residue_chars, masked).otherwise(swept)


def decide(line: Column, header: Column, top: Column | None = None, first: Column | None = None, tokens: Column | None = None, pre: Column | None = None, city: str = P.CITY, config: Config = DEFAULT) -> Column:
    """A struct of a line's decision: spans, contact (spans that are contact data), whole (the line goes whole), mask.

    A null line counts as empty, header as false, top as header, and a null first name keeps nothing but bare marks.
    """
    line, header = S.clean(line), F.coalesce(header, F.lit(False))
    top = header if top is None else F.coalesce(top, header)
    first = F.lit(None).cast("string") if first is None else first
    pre = S.none() if pre is None else F.coalesce(F.transform(pre, lambda p: F.struct(p["s"].cast("int").alias("s"), p["e"].cast("int").alias("e"), F.lit("PRE").alias("kind"))), S.none())
    direct = F.concat(pre, *[S.spans(line, rx, kind) for rx, kind in ((P.EMAIL, "EMAIL"), (P.URL, "URL"), (P.DOB, "DOB"), (P.PERSONAL_LINE, "FIELD"), (P.GENDER_AGE, "GENDER_AGE"))], Q.phone_spans(line))
    named = S.none() if tokens is None else S.spans(line, S.surname_pattern(tokens), "NAME")
    row = Q.contact_row(line)
    whole = F.array(F.struct(F.lit(0).alias("s"), F.char_length(line).alias("e"), F.lit("LINE").alias("kind")))

    def local(x: Column) -> Column:
        pins = F.when(top | row, S.spans(line, P.PIN, "PIN")).otherwise(S.none())
        cities = F.when(header | row, Q.city_spans(line, city)).otherwise(S.none())
        return S.let(F.struct(F.concat(x["direct"], x["named"], pins, cities).alias("spans"), (F.size(x["direct"]) + F.size(pins) + F.size(cities)).alias("contact")), swept)

    def swept(x: Column) -> Column:
        masked = S.mask(line, x["spans"])
        after = F.when(F.size(x["spans"]) == 0, line).otherwise(S.let(masked, lambda m: residue(m, first, (x["contact"] > 0) & (top | row), config)))
        return result(x["spans"], x["contact"], F.lit(False), after)

    def result(found: Column, contact: Column, all_: Column, masked: Column) -> Column:
        return F.struct(found.alias("spans"), contact.cast("int").alias("contact"), all_.alias("whole"), masked.alias("mask"))

    def of(x: Column) -> Column:
        bare = F.size(x["direct"]) + F.size(x["named"]) == 0
        gone = F.repeat(F.lit(S.GONE), F.char_length(line))
        return (
            F.when(top & bare & Q.label_line(line), result(whole, F.lit(0), F.lit(True), gone))
            .when(Q.address_like(line, top, city, config), result(F.concat(x["direct"], x["named"], whole), F.size(x["direct"]), F.lit(True), gone))
            .otherwise(local(x))
        )

    return S.let(F.struct(direct.alias("direct"), named.alias("named")), of)


def redact_lines(lines: DataFrame, text: str = "text", city: str = P.CITY, config: Config = DEFAULT) -> DataFrame:
    """lines with `decision` and `redacted`; columns header, top, first, tokens and pre are used where there."""
    get = lambda name: F.col(name) if name in lines.columns else None
    header = get("header")
    text_, top, tokens, pre = F.col(text), get("top"), get("tokens"), get("pre")
    decision = decide(text_, F.lit(False) if header is None else header, top, get("first"), tokens, pre, city, config)
    some = Q.has(text_, P.ANY_TRACE)
    for place in (header, top):
        some = some if place is None else some | F.coalesce(place, F.lit(False))
    for given in (tokens, pre):
        some = some if given is None else some | F.coalesce(F.size(given) > 0, F.lit(False))
    line = S.clean(text_)
    plain = F.struct(S.none().alias("spans"), F.lit(0).alias("contact"), F.lit(False).alias("whole"), line.alias("mask"))
    made = lines.select(*[c for c in lines.columns if c != "decision"], F.explode(F.array(F.when(some, decision).otherwise(plain))).alias("decision"))
    return made.withColumn("redacted", S.deleted(F.col("decision.mask")))


def struck_runs(runs: Column, masked: Column) -> Column:
    """A paragraph's mask dealt back to its runs, without what is gone."""
    lengths = F.transform(runs, lambda r: F.char_length(r))
    before = lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, n: a + n)
    return F.transform(runs, lambda r, i: S.deleted(F.substring(masked, before(i) + 1, F.char_length(r))))
