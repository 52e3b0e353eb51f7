"""License scans with a positional index of rare words.

Templates are licence texts, notices, titles and identifiers. The index lists, for each word of a key phrase, the
templates and places where it stands there (postings). Each file looks up its licence words of highest IDF (over all
documents), and the rarest word of each key phrase that it has; each posting fixes where its template would begin, and
the postings of a template's looked-up words are intersected by that relative position. What is left is verified: the
mandatory key phrase must stand word for word, and of the whole template a share of the words in their places, give or
take SHIFT words that a holder's name or the like may add. The base phrases are templates that are key phrases as a
whole, so all their places are found. The score is the largest share of a template that was found; a base phrase alone
counts as one half.

Words are found in blocks of bytes, and only licence words get numbers, so a block costs a few passes over its bytes.

Defined results: null text counts as empty; a file without licence words has empty labels, null places and score 0;
repeated rows are scanned one by one; other columns are not read; texts of any length are scanned whole; an empty table
gives no rows (and every word the same IDF).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.common import blocks, lowered, map_arrow, table, utf8, word_bounds

#: Label and words of the phrases that are searched for in full.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
# Words of public licence texts and notices, without marks and in lower case.
_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
_MIT_DISCLAIMER = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_DISCLAIMER = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_APACHE = "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation either version {1} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0}general public license for more details"
_MPL = "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"
_UNLICENSE = "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
_BOOST = "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"
_ZLIB = "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
_SPDX = ("mit", "isc", "unlicense", "zlib", "apache 2 0", "gpl 2 0", "gpl 3 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "bsd 2 clause", "bsd 3 clause", "mpl 2 0", "cc by 4 0", "cc by sa 4 0", "cc0 1 0", "bsl 1 0")


def _gnu(kind: str, version: str) -> str:
    return _GNU.format(kind, version)


#: Label, template, mandatory key phrase, and the share of the template's words that must stand in their places.
TEMPLATES = (
    ("mit-text", _MIT_GRANT, "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.7),
    ("mit-disclaimer", _MIT_DISCLAIMER, "the software is provided as is without warranty of any kind", 0.6),
    ("mit-title", "the mit license mit", "the mit license mit", 1.0),
    ("mit-notice", "released under the mit license", "mit license", 0.8),
    ("mit-notice", "licensed under the mit license", "mit license", 0.8),
    ("isc-text", _ISC, "permission to use copy modify and or distribute this software", 0.6),
    ("isc-title", "isc license", "isc license", 1.0),
    ("bsd-text", _BSD_GRANT, "redistribution and use in source and binary forms", 0.7),
    ("bsd-3-clause", _BSD_NAMES, "may be used to endorse or promote products derived from this software", 0.6),
    ("bsd-disclaimer", _BSD_DISCLAIMER, "as is and any express or implied warranties including but not limited to the implied warranties", 0.6),
    ("bsd-3-clause", "bsd 3 clause license", "bsd 3 clause", 0.7),
    ("bsd-2-clause", "bsd 2 clause license", "bsd 2 clause", 0.7),
    ("apache-2.0", _APACHE, "licensed under the apache license version 2 0", 0.6),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2", 0.8),
    ("apache-2.0", "apache license version 2 0", "apache license version 2 0", 1.0),
    ("gpl-3.0", _gnu("", "3"), "gnu general public license as published by the free software foundation either version 3", 0.6),
    ("gpl-2.0", _gnu("", "2"), "gnu general public license as published by the free software foundation either version 2", 0.6),
    ("lgpl", _gnu("lesser ", "3"), "gnu lesser general public license as published by the free software foundation", 0.6),
    ("agpl", _gnu("affero ", "3"), "gnu affero general public license as published by the free software foundation", 0.6),
    ("gpl-3.0", "gnu general public license version 3", "general public license version 3", 0.8),
    ("gpl-2.0", "gnu general public license version 2", "general public license version 2", 0.8),
    ("lgpl", "gnu lesser general public license", "lesser general public license", 0.8),
    ("agpl", "gnu affero general public license", "affero general public license", 0.8),
    ("mpl", _MPL, "terms of the mozilla public license", 0.6),
    ("mpl", "mozilla public license version 2 0", "mozilla public license", 0.8),
    ("unlicense", _UNLICENSE, "free and unencumbered software released into the public domain", 0.6),
    ("boost", _BOOST, "permission is hereby granted free of charge to any person or organization obtaining a copy", 0.6),
    ("zlib", _ZLIB, "in no event will the authors be held liable for any damages", 0.6),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0", 0.8),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", 0.8),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", 0.8),
    ("cc-by-4.0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0", 0.7),
    ("cc0", "creative commons cc0 1 0 universal", "cc0 1 0 universal", 0.8),
    *((f"spdx:{x.replace(' ', '-')}", f"spdx license identifier {x}", f"spdx license identifier {x}", 1.0) for x in _SPDX),
)
#: Words that a file looks up beside the rarest of each key phrase, and words by which a place may be off.
LOOKUPS, SHIFT = 16, 12
_IS_WORD = np.array([b >= 128 or chr(b).isdigit() or chr(b).isalpha() for b in range(256)])


@functools.cache
def _words() -> dict[str, int]:
    return {w: i for i, w in enumerate(sorted({w for _, p in PHRASES for w in p.split()} | {w for _, t, k, _ in TEMPLATES for w in (t + " " + k).split()}))}


def _mixed(head: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    h = (head * np.uint64(0x9E3779B97F4A7C15)) ^ (tail * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (length.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return h ^ (h >> np.uint64(31))


def _ends_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last eight bytes, and the length, of each word: all of a word of 16 bytes at most."""
    view = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    lengths = ends - starts
    mask = np.where(lengths >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(lengths, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1))
    return view[starts] & mask, view[np.maximum(starts, ends - 8)] & mask, lengths


@functools.cache
def _lookup() -> tuple[np.ndarray, ...]:
    """Keys of the licence words, ascending, with their words' ends, lengths and numbers."""
    words = [w.encode() for w in _words()]
    if max(map(len, words)) > 16:
        raise ValueError("licence words of up to 16 bytes are told apart by their ends")
    ends = np.cumsum([len(w) for w in words])
    head, tail, length = _ends_of(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    key = _mixed(head, tail, length)
    order = np.argsort(key)
    return key[order], head[order], tail[order], length[order], order.astype(np.int32)


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of each word that is a licence word, else -1."""
    keys, heads, tails, lengths, number = _lookup()
    head, tail, length = _ends_of(data, starts, ends)
    at = np.minimum(np.searchsorted(keys, _mixed(head, tail, length)), len(keys) - 1)
    return np.where((heads[at] == head) & (tails[at] == tail) & (lengths[at] == length), number[at], -1)


def _word_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows low to high, the numbers of their words, and the number of words before each row."""
    data, offsets = utf8(column)
    for low, high in blocks(offsets):
        part = lowered(data[offsets[low] : offsets[high]])
        starts, ends, before = word_bounds(_IS_WORD[part], offsets[low : high + 1] - offsets[low])
        yield low, high, numbered(part, starts, ends), before


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, n = np.zeros(len(_words()), np.int64), 0
    for batch in batches:
        for low, high, ids, before in _word_rows(batch.column(0)):
            n += high - low
            at = np.flatnonzero(ids >= 0)
            rows = np.searchsorted(before, at, "right") - 1
            pairs = np.unique(rows * len(count) + ids[at])
            count += np.bincount(pairs % len(count), minlength=len(count))
    yield pa.RecordBatch.from_arrays([pa.array([*range(len(count)), -1], pa.int32()), pa.array([*count, n], pa.int64())], ["word", "docs"])


def idf(docs: DataFrame) -> dict[str, float]:
    """IDF of each licence word over all documents; a row for each word and task is summed."""
    counts = {r.word: r.docs for r in map_arrow(docs.selectExpr("cast(text as string) text"), _frequencies, "word int, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()}
    n = counts.get(-1, 0)
    return {w: math.log((n + 1) / (counts.get(i, 0) + 1)) + 1 for w, i in _words().items()}


class Template(NamedTuple):
    base: bool
    label: str
    words: np.ndarray
    key_at: int
    key: np.ndarray
    share: float


@functools.cache
def _templates() -> list[Template]:
    out = []
    for base, (label, text, key, share) in [(True, (label, p, p, 1.0)) for label, p in PHRASES] + [(False, t) for t in TEMPLATES]:
        own, phrase = text.split(), key.split()
        at = next(k for k in range(len(own)) if own[k : k + len(phrase)] == phrase)
        out.append(Template(base, label, np.array([_words()[w] for w in own]), at, np.array([_words()[w] for w in phrase]), share))
    return out


class Index:
    """Postings of the words of key phrases: where each word's begin, then templates and places in the key phrase."""

    def __init__(self, weights: dict[str, float]) -> None:
        n = len(_words())
        self.idf = np.array([weights[w] for w in _words()])
        postings = sorted((int(w), t, k) for t, own in enumerate(_templates()) for k, w in enumerate(own.key))
        self.begin = np.searchsorted([p[0] for p in postings], np.arange(n + 1))
        self.template, self.place = (np.array([p[k] for p in postings]) for k in (1, 2))
        self.in_key = np.zeros((n, len(_templates())), np.int64)
        np.add.at(self.in_key, ([p[0] for p in postings], self.template), 1)
        self.anchor = np.zeros(n, bool)
        self.anchor[[max(own.key.tolist(), key=lambda w: (self.idf[w], w)) for own in _templates()]] = True

    def looked_up(self, row: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """A flag for each row and word: the rarest of the row's words in the index, and all that are a key phrase's rarest."""
        pairs = np.unique(row * len(self.idf) + word)
        row, word = pairs // len(self.idf), pairs % len(self.idf)
        known = self.begin[word + 1] > self.begin[word]
        row, word = row[known], word[known]
        order = np.lexsort((word, -self.idf[word], row))
        row, word = row[order], word[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        chosen = (rank < LOOKUPS) | self.anchor[word]
        out = np.zeros((n, len(self.idf)), bool)
        out[row[chosen], word[chosen]] = True
        return out

    def starts(self, ids: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each template: rows, and the words of the block at which its key phrase begins there."""
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return
        word, row = ids[at], np.searchsorted(before, at, "right") - 1
        chosen = self.looked_up(row, word, len(before) - 1)
        asks = chosen[row, word]
        at, word, row = at[asks], word[asks], row[asks]
        n = self.begin[word + 1] - self.begin[word]
        posting = np.repeat(self.begin[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        template, start, row = self.template[posting], np.repeat(at, n) - self.place[posting], np.repeat(row, n)
        whole = (start >= before[row]) & (start + np.array([len(t.key) for t in _templates()])[template] <= before[row + 1])
        key, votes = np.unique(template[whole] * (len(ids) + 1) + start[whole], return_counts=True)
        template, start = key // (len(ids) + 1), key % (len(ids) + 1)
        row = np.searchsorted(before, start, "right") - 1
        agreed = votes == (chosen @ self.in_key)[row, template]
        template, start, row = template[agreed], start[agreed], row[agreed]
        for t in np.unique(template).tolist():
            own = template == t
            phrase = _templates()[t].key
            sure = (ids[start[own][:, None] + np.arange(len(phrase))] == phrase).all(1)
            if sure.any():
                yield t, row[own][sure], start[own][sure]


def _share(ids: np.ndarray, template: Template, start: int, low: int, high: int) -> float:
    """The share of the template's words that stand in their places, give or take SHIFT, in the words from low to high."""
    first = start - template.key_at
    if len(template.words) <= len(template.key) + 4:
        shifts = np.zeros(1, np.int64)
    else:
        shifts = np.arange(-SHIFT, SHIFT + 1)
    places = first + np.arange(len(template.words))[:, None] + shifts
    inside = (places >= low) & (places < high)
    return float(((ids[np.clip(places, 0, len(ids) - 1)] == template.words[:, None]) & inside).any(1).mean())


def _scan(batches: Iterator[pa.RecordBatch], weights: dict[str, float]) -> Iterator[pa.RecordBatch]:
    index = Index(weights)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for batch in batches:
        columns: list[list] = [[] for _ in names[1:]]
        for low, high, ids, before in _word_rows(batch.column(1)):
            n = high - low
            places: list[list[int]] = [[] for _ in range(n)]
            base: list[set] = [set() for _ in range(n)]
            more: list[set] = [set() for _ in range(n)]
            score = np.zeros(n)
            for t, rows, starts in index.starts(ids, before):
                template = _templates()[t]
                for r, b in zip(rows.tolist(), starts.tolist(), strict=True):
                    if template.base:
                        places[r].append(b - int(before[r]))
                        base[r].add(template.label)
                        score[r] = max(score[r], 0.5)
                        continue
                    share = _share(ids, template, b, int(before[r]), int(before[r + 1]))
                    if share >= template.share:
                        more[r].add(template.label)
                        score[r] = max(score[r], share)
            columns[0] += np.diff(before).tolist()
            columns[1] += map(len, places)
            columns[2] += (min(p, default=None) for p in places)
            columns[3] += (max(p, default=None) for p in places)
            columns[4] += (",".join(sorted(b)) for b in base)
            columns[5] += (",".join(sorted(b | m)) for b, m in zip(base, more, strict=True))
            columns[6] += score.tolist()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


def scan(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Labels, places and score of each document; weights: see `idf` (a number for each licence word)."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), lambda b: _scan(b, weights), schema)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, idf(docs))
