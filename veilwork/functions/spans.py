"""Spans: half-open ranges of characters as arrays of structs (s, e, kind), made and used as columns only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions import patterns as P

#: A Unicode noncharacter marks matches. A line that has it gets U+FFFD in its place, which keeps offsets.
MARK = "﷐"
GONE = "\x00"
SPAN = "array<struct<s:int,e:int,kind:string>>"
CHUNKS = "array<struct<s:int,e:int,text:string>>"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with value made once for each row."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def clean(line: Column) -> Column:
    """A line for the engine: null becomes empty, and the mark and NUL become U+FFFD."""
    return F.translate(F.coalesce(line, F.lit("")), MARK + GONE, "��")


def matches(line: Column, pattern: str | Column) -> Column:
    """All matches (s, e, text) of a pattern, from left to right; empty ones are dropped.

    Matches are put between marks, the line is split at them, and the lengths of the parts are summed up: odd parts are
    matches. Lines without a match, nearly all of them, cost one search.
    """
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern

    def found(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast(CHUNKS).alias("out"))

        def step(a: Column, part: Column) -> Column:
            end = a["at"] + F.char_length(part)
            one = F.struct(a["at"].alias("s"), end.alias("e"), part.alias("text"))
            return F.struct(end.alias("at"), (~a["hit"]).alias("hit"), F.when(a["hit"] & (part != ""), F.array_append(a["out"], one)).otherwise(a["out"]).alias("out"))

        return F.aggregate(parts, start, step)["out"]

    marked = F.regexp_replace(line, rx, F.lit(f"{MARK}$0{MARK}"))
    return F.when(F.coalesce(F.regexp_like(line, rx), F.lit(False)), let(F.split(marked, MARK, -1), found)).otherwise(F.array().cast(CHUNKS))


def spans(line: Column, pattern: str | Column, kind: str) -> Column:
    return F.transform(matches(line, pattern), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lit(kind).alias("kind")))


def none() -> Column:
    return F.array().cast(SPAN)


def mask(line: Column, found: Column) -> Column:
    """The line with NUL for each character of a span."""
    return F.aggregate(found, line, lambda m, x: F.when(x["e"] > x["s"], F.overlay(m, F.repeat(F.lit(GONE), x["e"] - x["s"]), x["s"] + 1, x["e"] - x["s"])).otherwise(m))


def chunks(masked: Column) -> Column:
    """Runs that are neither white space nor gone."""
    return matches(masked, P.CHUNK)


def erase(masked: Column, gone: Column) -> Column:
    return mask(masked, gone)


def deleted(masked: Column) -> Column:
    """The text that is left, its white space as it was."""
    return F.replace(masked, F.lit(GONE), F.lit(""))


def joined(masked: Column) -> Column:
    """The chunks that are left, with one space between."""
    return F.array_join(F.transform(chunks(masked), lambda c: c["text"]), " ")


def overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def surname_pattern(tokens: Column) -> Column:
    """A pattern of a row's own tokens: plain ones quoted, with any white space for a space, `re:` ones as they are; null
    without tokens. A row whose pattern is not valid must be told beforehand: see plans.plan.valid_tokens."""
    quoted = lambda t: F.regexp_replace(F.regexp_replace(t, r"([\\.\[\]{}()*+\-?^$|#/])", r"\\$1"), " ", r"[\\s\\x1C-\\x1F]+")
    parts = F.transform(tokens, lambda t: F.when(t.startswith("re:"), F.substr(t, F.lit(4))).otherwise(quoted(t)))
    return F.when(F.size(tokens) > 0, F.concat(F.lit(r"(?iUd)(?<![A-Za-z])(?:"), F.array_join(parts, "|"), F.lit(r")(?![A-Za-z])")))
