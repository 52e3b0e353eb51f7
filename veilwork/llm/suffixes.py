"""Exact removal of repeated byte strings with suffix arrays built by induced sorting.

A byte goes if a string of LENGTH bytes over it also starts earlier: in a document of smaller id, or earlier in the same
one. Two steps make this local. Each window of LENGTH bytes has a minimizer, its K-gram of least hash (the leftmost of
equals), so equal windows have equal minimizers; runs of windows with one minimizer are segments. Segments whose minimizer
occurs once are unique and go no further. Of equal segments (by two 64-bit hashes, of the minimizer and of all bytes) the
earliest stands for all: all windows of the others are repeats. Where a minimizer has different segments, their suffixes
are sorted, and the windows that share LENGTH bytes with an earlier one are marked. Shards are whole minimizer groups,
gathered up to SHARD_BYTES. A group of more than HOT different segments is split by further bytes: its segments are cut,
at equal distances from the minimizer, into narrower ones of NARROWER windows at most, and the bytes that all windows of a
narrower one share take the place of the minimizer. Those groups are sorted in shards as above; what is still hot is cut
into single windows, whose group is one class.

A shard's array is built by induced sorting: suffixes are classed as larger or smaller than the next, leftmost-smaller
substrings are sorted and named, their order is found on the string of names by the same means, however many names there
are, and all others are induced from it: a bucket at a time where letters are bytes, and where letters are names and a
bucket holds few, all buckets at once, by the letters up to the next suffix that is in order. Common prefixes are computed in
text order (permuted), against each suffix's predecessor in the array, eight bytes at a time, up to LENGTH.

Defined results: null text counts as empty; bytes that are no UTF-8 count as U+FFFD; texts under LENGTH bytes lose
nothing; rows without an id come after all others. Rows that share an id, or have none, and differ in text are documents
of their own, in the order of a hash of their texts; those of equal texts too are one document that is given more than
once, and lose the same. An empty table gives no rows; other columns are not read by `repeats` and stay in
`without_repeats`, which also drops what is left of a character that is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.common import blocks, map_arrow, mixed, prefix_hashes, stash, table, utf8, valid_utf8

LENGTH, K = 100, 24
SHARD_BYTES, PIECE_BYTES = 1 << 21, 1 << 20
#: Different segments with one minimizer that one task may sort, and windows of the segments that more are cut into.
HOT, NARROWER = 20_000, (8, 1)
#: Letters up to which induction goes by buckets.
BYTES = 256
_LAST = (1 << 63) - 1
_PLACE = np.uint64((1 << 22) - 1)


def _segments(part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Minimizer hash, content hash, row, first window and number of windows of each segment of the rows in part."""
    size = len(part)
    if size < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums, down = prefix_hashes(part)
    grams = mixed((sums[K:] - sums[:-K]) * down[: size - K + 1])
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, reach = LENGTH - K + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: reach - width], least[width - reach :])
    place = (least & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(own) - 1), np.diff(own))[: len(place)]
    valid = np.arange(len(place)) + LENGTH <= own[row + 1]
    turn = np.ones(len(place) + 1, bool)
    turn[1:-1] = (place[1:] != place[:-1]) | ~valid[1:] | ~valid[:-1]
    begin, last = np.flatnonzero(valid & turn[:-1]), np.flatnonzero(valid & turn[1:])
    content = mixed((sums[last + LENGTH] - sums[begin]) * down[begin]) ^ (last - begin).astype(np.uint64)
    return grams[place[begin]].view(np.int64), mixed(content).view(np.int64), row[begin], begin - own[row[begin]], last - begin + 1


SEGMENTS = "least long, content long, doc_id long, place long, twin long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, doc_id and, if there, twin."""
    for batch in batches:
        data, offsets = utf8(valid_utf8(batch.column(0)))
        keys = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
        for low, high in blocks(offsets, PIECE_BYTES):
            whole = offsets[high] - offsets[low]
            for base in range(0, whole if high - low == 1 else 1, PIECE_BYTES):
                part = data[offsets[low] + base : offsets[high]]
                if high - low == 1:
                    part = part[: PIECE_BYTES + LENGTH - 1]
                    own = np.array([0, len(part)])
                else:
                    own = offsets[low : high + 1] - offsets[low]
                least, content, row, first, n = _segments(part, own)
                if len(row):
                    doc_id, *twin = (pa.array(x[low + row]) for x in keys)
                    yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(content), doc_id, pa.array((first + base) * 128 + n), *twin], ["least", "content", "doc_id", "place", "twin"][: 4 + len(twin)])


def segments(docs: DataFrame) -> DataFrame:
    """least, content, doc_id, place (first window * 128 + number of windows) and twin of every segment; where no id stands
    twice, twin is a constant and not carried."""
    if "twin" in docs.columns:
        return map_arrow(docs.select("text", "doc_id", "twin"), _scan, SEGMENTS)
    return map_arrow(docs.select("text", "doc_id"), _scan, SEGMENTS.removesuffix(", twin long")).withColumn("twin", F.lit(0).cast("long"))


# --- suffix arrays


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last, a sentinel, counts as smaller."""
    n = len(t)
    rise = np.ones(n, bool)
    rise[:-1] = t[:-1] < t[1:]
    differs = np.ones(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    at = np.where(differs, np.arange(n), n)
    return rise[np.minimum.accumulate(at[::-1])[::-1]]


def _deal(to: list[list[np.ndarray]], where: np.ndarray, chars: np.ndarray) -> None:
    """Puts each suffix at the end of its character's bucket, in the order given."""
    if len(where) == 1:
        to[int(chars[0])].append(where)
        return
    order = np.argsort(chars, kind="stable")
    chars, where = chars[order], where[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    for part, c in zip(np.split(where, cuts), chars[np.concatenate([[0], cuts])].tolist()):
        to[c].append(part)


def _induced(t: np.ndarray, letters: int, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones, which are in order within each bucket."""
    larger_in: list[list[np.ndarray]] = [[] for _ in range(letters)]
    smaller_in: list[list[np.ndarray]] = [[] for _ in range(letters)]
    starts: list[list[np.ndarray]] = [[] for _ in range(letters)]
    _deal(starts, leftmost, t[leftmost])

    def on(now: np.ndarray, c: int, into: list[list[np.ndarray]], kind: bool) -> np.ndarray:
        """Deals out the suffixes of a kind that stand one before these; those of the same bucket come back."""
        back = now[now > 0] - 1
        back = back[smaller[back] == kind]
        if not len(back):
            return back
        chars = t[back]
        same = chars == c
        if same.any():
            away = ~same
            if away.any():
                _deal(into, back[away], chars[away])
            return back[same]
        _deal(into, back, chars)
        return back[:0]

    def bucket(c: int, of: list[list[np.ndarray]], kind: bool) -> None:
        """What other buckets have dealt to this one is all there; each round goes on with what the last one added."""
        done = [np.concatenate(of[c])] if len(of[c]) > 1 else of[c][:]
        while done and len(done[-1]):
            done.append(on(done[-1], c, of, kind))
        of[c] = done

    for c in range(letters):
        bucket(c, larger_in, False)
        for part in starts[c]:
            on(part, c, larger_in, False)
    smaller_in[int(t[-1])].append(np.array([len(t) - 1]))
    for c in range(letters - 1, -1, -1):
        bucket(c, smaller_in, True)
        if larger_in[c]:
            on(np.concatenate(larger_in[c])[::-1], c, smaller_in, True)
    return np.concatenate([x for c in range(letters) for x in (*larger_in[c], *(p[::-1] for p in reversed(smaller_in[c])))])


def _refined(at: np.ndarray, code: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings of codes, and a number for each string that equal ones share. String i begins at at[i] and ends
    with the first code after its own first one that is marked in stop. Only strings that are still equal go on."""
    order = np.argsort(code[at], kind="stable")
    own = code[at][order]
    group = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
    going, k = np.arange(len(at)), 0
    while True:
        alone = np.ones(len(going) + 1, bool)
        alone[1:-1] = group[going][1:] != group[going][:-1]
        going = going[~(alone[:-1] & alone[1:])]
        if k:
            going = going[~stop[at[order[going]] + k]]
        if not len(going):
            break
        k += 1
        own = code[at[order[going]] + k]
        when = np.lexsort((own, group[going]))
        order[going] = order[going[when]]
        own, held = own[when], group[going]
        new = np.zeros(len(group), np.int64)
        new[going[1:][(own[1:] != own[:-1]) & (held[1:] == held[:-1])]] = 1
        new[1:] += group[1:] != group[:-1]
        group = np.cumsum(new)
    number = np.empty(len(at), np.int64)
    number[order] = group
    return order, number


def _induced_by_runs(t: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """The same as `_induced`, all buckets at once: a larger suffix is in the order of its letters up to the next leftmost
    smaller one and that one's rank; a smaller suffix in that of its letters up to the next larger one and its rank."""
    n = len(t)
    rank = np.zeros(n, np.int64)
    rank[leftmost] = np.arange(1, len(leftmost) + 1)
    room = len(leftmost) + 1
    larger = np.flatnonzero(~smaller)
    larger = larger[_refined(larger, t * room + rank, rank > 0)[0]] if len(larger) else larger
    room = len(larger) + 1
    rank[:] = len(larger)
    rank[larger] = np.arange(len(larger))
    end = np.zeros(n, bool)
    end[larger] = True
    end[-1] = True
    lesser = np.flatnonzero(smaller)
    lesser = lesser[_refined(lesser, t * room + rank, end)[0]]
    return np.concatenate([larger, lesser])[np.argsort(np.concatenate([t[larger] * 2, t[lesser] * 2 + 1]), kind="stable")]


def suffix_array(t: np.ndarray, letters: int) -> np.ndarray:
    """The order of all suffixes of t, whose last letter is the only 0."""
    by_bucket = letters <= BYTES
    smaller = _smaller(t)
    first = smaller.copy()
    first[0] = False
    first[1:] &= ~smaller[:-1]
    leftmost = np.flatnonzero(first)

    def induced(ordered: np.ndarray) -> np.ndarray:
        return _induced(t, letters, smaller, ordered) if by_bucket else _induced_by_runs(t, smaller, ordered)

    if len(leftmost) < 2:
        return induced(leftmost)
    if by_bucket:
        end = np.full(len(t), len(t) - 1)
        end[leftmost[:-1]] = leftmost[1:]
        ordered = induced(leftmost)
        ordered = ordered[first[ordered]]
        a, b = ordered[:-1], ordered[1:]
        same = (end[a] - a) == (end[b] - b)
        going, k = np.flatnonzero(same), 0
        while len(going):  # letter by letter over those that are still equal
            at = a[going] + k
            equal = t[at] == t[b[going] + k]
            same[going[~equal]] = False
            going = going[equal & (at < end[a[going]])]
            k += 1
        name = np.empty(len(t), np.int64)
        name[ordered] = np.concatenate([[0], np.cumsum(~same)])
        names = name[leftmost]
    else:
        _, names = _refined(leftmost, t * 2 + smaller, first)
    if names.max() + 1 == len(names):
        inner = np.empty(len(names), np.int64)
        inner[names] = np.arange(len(names))
    else:
        inner = suffix_array(names, int(names.max()) + 1)
    return induced(leftmost[inner])


def common_prefixes(data: np.ndarray, at: np.ndarray, before: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Bytes, up to `most`, that the strings at `at` and `before` have in common. data has `most` bytes after each."""
    view = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    found = np.full(len(at), most, np.int64)
    going = np.arange(len(at))
    for k in range(0, most, 8):
        differ = view[at[going] + k] ^ view[before[going] + k]
        off = differ != 0
        low = differ[off] & (~differ[off] + np.uint64(1))
        found[going[off]] = np.minimum(most, k + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        going = going[~off]
        if not len(going):
            break
    return found


def repeated_windows(parts: list[bytes], ids: np.ndarray, firsts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Part and offset of each window of `length` bytes in parts that also stands earlier, by (id, first + offset)."""
    sizes = np.array([len(p) for p in parts])
    joined = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    t = np.where(joined == 255, 1, joined + np.uint8(2)).astype(np.uint8)  # UTF-8 has no byte over 0xf7
    t = np.concatenate([t, np.zeros(1, np.uint8)])
    places = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    of = np.repeat(np.arange(len(parts)), sizes + 1)
    left = np.repeat(places + sizes, sizes + 1) - np.arange(len(of))
    valid = np.append(left >= length, False)
    order = suffix_array(t, 256)
    order = order[valid[order]]
    if len(order) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    previous = np.full(len(t), -1)
    previous[order[1:]] = order[:-1]
    in_text = np.sort(order)
    some = in_text[previous[in_text] >= 0]
    permuted = np.zeros(len(t), np.int64)
    permuted[some] = common_prefixes(np.concatenate([t, np.zeros(length + 8, np.uint8)]), some, previous[some], length)
    new = permuted[order] < length
    group = np.cumsum(new) - 1
    when = np.lexsort((firsts[of[order]] + order - places[of[order]], ids[of[order]], group))
    group = group[when]
    at = order[when]
    key_id, key_at = ids[of[at]], firsts[of[at]] + at - places[of[at]]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
    later = (key_id != key_id[lead]) | (key_at != key_at[lead])
    at = at[later]
    return of[at], at - places[of[at]]


def _runs(part: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, first and number of windows of each run of neighbouring windows."""
    order = np.lexsort((offset, part))
    part, offset = part[order], offset[order]
    cut_ = np.ones(len(part) + 1, bool)
    cut_[1:-1] = (part[1:] != part[:-1]) | (offset[1:] != offset[:-1] + 1)
    begin, end = np.flatnonzero(cut_[:-1]), np.flatnonzero(cut_[1:])
    return part[begin], offset[begin], end - begin + 1


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[bytes] = []
    held: tuple[list[int], ...] = ([], [], [])  # doc_id, twin, first
    size, last = 0, None

    def ended() -> Iterator[pa.RecordBatch]:
        docs, twins, at = (np.array(x, np.int64) for x in held)
        order = np.lexsort((twins, docs))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum((docs[order][1:] != docs[order][:-1]) | (twins[order][1:] != twins[order][:-1]))])
        part, first, n = _runs(*repeated_windows(parts, rank, at))
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (docs[part], twins[part], at[part] + first, at[part] + first + n + LENGTH - 1)], ["doc_id", "twin", "low", "high"])
        for x in (parts, *held):
            x.clear()

    for batch in batches:
        for least, doc_id, twin, first, data in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
            if size >= SHARD_BYTES and least != last:
                yield from ended()
                size = 0
            parts.append(data.as_py())
            for x, value in zip(held, (doc_id, twin, first), strict=True):
                x.append(value)
            size += len(parts[-1])
            last = least
    if parts:
        yield from ended()


def _squeeze(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard frames, for joins that carry them."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        columns = list(batch.columns)
        columns[at] = pa.array([pack(x) if x is not None else None for x in valid_utf8(columns[at]).cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def _squeezed(df: DataFrame) -> DataFrame:
    at = df.columns.index("text")
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in df.schema.fields)
    return map_arrow(df, lambda batches: _squeeze(batches, at), schema)


def _data(value: pa.Scalar) -> bytes:
    """The bytes of a text that was squeezed; null counts as empty."""
    return zstandard.ZstdDecompressor().decompress(value.as_py()) if value.is_valid else b""


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, list[dict]]]:
    """doc_id, twin, bytes and wanted segments of each document that has some to give."""
    for batch in batches:
        for doc_id, twin, text, wanted in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), batch.column(3).to_pylist(), strict=True):
            yield doc_id, twin, _data(text), wanted


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments that a document has to give: least, doc_id, twin, first, data."""
    for doc_id, twin, data, wanted in _asked(batches):
        n = len(wanted)
        first = [w["place"] >> 7 for w in wanted]
        parts = [data[i : i + (w["place"] & 127) + LENGTH - 1] for i, w in zip(first, wanted, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([w["least"] for w in wanted], pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array([twin] * n, pa.int64()), pa.array(first, pa.int64()), pa.array(parts, pa.binary())], ["least", "doc_id", "twin", "first", "data"])


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _narrowed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The segments that a document has to give, cut into ones of `width` windows at most at multiples of the width from
    the minimizer, so equal windows are in pieces that begin alike. What stands for the minimizer is the bytes that all
    windows of a whole piece share."""
    for doc_id, twin, data, wanted in _asked(batches):
        rows = []
        for first, n, least in {(w["place"] >> 7, w["place"] & 127, w["least"]) for w in wanted}:
            gram = first
            if width > 1:
                part = np.frombuffer(data[first : first + n + LENGTH - 1], np.uint8)
                sums, down = prefix_hashes(part)
                gram += int(np.flatnonzero(mixed((sums[K:] - sums[:-K]) * down[: len(part) - K + 1]).view(np.int64) == least)[0])
            last = first + n - 1
            for block in range((gram - last) // width, (gram - first) // width + 1):
                low, high = gram - block * width - width + 1, gram - block * width  # windows of the whole piece
                core = data[high : low + LENGTH] + (b"%d" % block if width > 1 else b"")
                a, b = max(low, first), min(high, last)
                rows.append((_digest(core), _digest(data[a : b + LENGTH] + b"%d" % (a - low)), a * 128 + b - a + 1))
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([twin] * n, pa.int64())], ["least", "content", "doc_id", "place", "twin"])


def _later(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Spans of all segments that are not the first of their class."""
    many = classes.filter("n > 1").select("least", "content", "first")
    start = F.shiftright("place", 7)
    again = rows.join(many, ["least", "content"]).filter(F.struct("doc_id", "twin", "place") != F.col("first"))
    return again.select("doc_id", "twin", start.alias("low"), (start + F.col("place").bitwiseAND(F.lit(127)) + (LENGTH - 1)).alias("high"))


def _asking(texts: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, twin, text (squeezed) and `wanted`: the first segments of the classes in groups, gathered by document."""
    wanted = classes.join(groups, "least").groupBy("first.doc_id", "first.twin").agg(F.collect_list(F.struct("least", F.col("first.place").alias("place"))).alias("wanted"))
    return texts.join(wanted, ["doc_id", "twin"]).select("doc_id", "twin", "text", "wanted")


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column name + "id" (never null) and, if an id stands twice, which costs a join, name + "twin": a hash of
    the text where it does, else 0."""
    keyed = docs.withColumn(name + "id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    again = keyed.groupBy(name + "id").agg(F.count(F.lit(1)).alias(name + "twin")).filter(F.col(name + "twin") > 1)
    if not again.limit(1).count():
        return keyed
    return keyed.join(again, name + "id", "left").withColumn(name + "twin", F.when(F.col(name + "twin") > 1, F.xxhash64("text")).otherwise(F.lit(0)))


def repeats(own: DataFrame) -> DataFrame:
    """doc_id, twin and spans (low, high in bytes, which may overlap) of each document that has repeated windows; own:
    doc_id, text and, if an id stands twice, twin (see `_keyed`).

    Counting minimizers combines before it shuffles. What the segments with a shared minimizer are joined with has each of
    its keys once, and both sides are dealt for that join alone, so adaptive execution can split a minimizer of many rows.
    """
    found = segments(own)
    if "twin" not in own.columns:
        own = own.withColumn("twin", F.lit(0).cast("long"))
    shared = stash(found.groupBy("least").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("least"), "shared")
    rows = stash(found.join(shared, "least"), "segments")
    spans = None
    for width in (*NARROWER, None):
        classes = stash(rows.groupBy("least", "content").agg(F.min(F.struct("doc_id", "twin", "place")).alias("first"), F.count(F.lit(1)).alias("n")), "classes")
        groups = classes.groupBy("least").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        mixed, hot = groups.filter(F.col("size") <= HOT).select("least"), groups.filter(F.col("size") > HOT).select("least")
        given = map_arrow(_asking(_squeezed(own), classes, mixed), _cut_out, "least long, doc_id long, twin long, first long, data binary")
        now = _later(rows, classes).union(map_arrow(given.repartition("least").sortWithinPartitions("least"), _sorted_shards, "doc_id long, twin long, low long, high long"))
        spans = now if spans is None else spans.union(now)
        if width is None or not hot.limit(1).count():
            break
        rows = stash(map_arrow(_asking(_squeezed(own), classes, hot), lambda batches, width=width: _narrowed(batches, width), SEGMENTS), "segments")
    return spans.groupBy("doc_id", "twin").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


def merged(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted((s["low"], min(s["high"], size)) for s in spans or ()):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        elif low < high:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _kept(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """Every row, its text's place given by text_at and its spans last: with digests (text_at -1: doc_id, text, spans), or
    with the text that is left."""
    for batch in batches:
        rows, texts = [], []
        for value, spans in zip(batch.column(1 if text_at < 0 else text_at), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            data = _data(value)
            gone = merged(spans, len(data))
            left = data
            if gone:
                ends = [0, *(b for _, b in gone)]
                left = b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(data)], strict=True))
            if text_at < 0:
                rows.append((len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest()))
            else:
                texts.append(left.decode("utf-8", "ignore") if value.is_valid else None)
        if text_at < 0:
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        else:
            own = batch.columns[:-1]
            own[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(own, batch.schema.names[:-1])


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs, their text squeezed, and their spans in a last column."""
    name = "key_"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    keyed = _keyed(docs, name)
    key = [name + x for x in ("id", "twin") if name + x in keyed.columns]
    found = repeats(keyed.select(F.col("text").cast("string").alias("text"), F.col(key[0]).alias("doc_id"), *(F.col(x).alias("twin") for x in key[1:])))
    found = found.toDF(name + "id", name + "twin", name + "spans").select(*key, name + "spans")
    return _squeezed(keyed).join(found, key, "left").select(*docs.columns, name + "spans")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, with its columns; text is what is left of it, and n_chars, if there, its new length."""
    rows = _with_spans(docs)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index("text")
    out = map_arrow(rows, lambda b: _kept(b, at), schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return map_arrow(rows, lambda b: _kept(b, -1), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substring(h, CAST(2 * i + 1 AS INT), 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM w) WHERE nth > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
      FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i) AS before FROM f)),
r AS (SELECT doc_id, min(i) AS low, max(i) + 100 AS high FROM g GROUP BY doc_id, run),
p AS (SELECT r.doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY r.doc_id ORDER BY low), 0) AS since FROM r),
k AS (SELECT p.doc_id, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans, max(high) AS last,
        string_agg(substring(d.h, CAST(2 * since + 1 AS INT), CAST(2 * (low - since) AS INT)), '' ORDER BY low) AS kept
      FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substring(h, CAST(2 * coalesce(last, 0) + 1 AS INT)))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
