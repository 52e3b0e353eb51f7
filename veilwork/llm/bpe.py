"""Byte-level BPE through a lazily determinised finite-state transducer.

A sequence of tokens is the encoding of its bytes exactly if each token encodes to itself and each two neighbours, put
together, encode to those two. (Merging is by lowest rank, leftmost first, so a stretch between two token borders is
merged as it would be alone, and the first merge over a border would also be the first over that border in the pair.)
So each prefix of a piece has one valid last token, and the encoder needs no merge queue: it reads bytes from left to
right and keeps, for each border from which a vocabulary entry may still run on, that entry's place in a trie and the
tokens not yet given out. These sets of threads are the states. A step is computed once, then kept as a transition in
flat arrays; the tokens that all threads have in common are emitted, after a lookahead of at most the longest vocabulary
entry. The different pieces of a batch go through the transducer side by side, a byte at a time.

Decoding is a table of bytes and an incremental UTF-8 state machine that holds back an unfinished character.

Defined results: null text counts as empty and has no ids (n_tokens 0, digests of the empty string); text of any length
and white space of any kind is encoded whole; bytes that are no UTF-8 count as U+FFFD; memory is bounded by the batch and by STEPS transitions, which are
dropped and built anew when there are more; equal rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from veilwork.llm.common import many_small_objects, map_arrow, table, utf8, valid_utf8

#: Transitions, and pairs of tokens, that are kept; pieces of a length that fewer share go on by themselves.
STEPS, PAIRS, SIDE_BY_SIDE = 1_000_000, 700_000, 12
_SLOTS, _MULTIPLIER = 1 << 22, 0x9E3779B97F4A7C15


def _slot(key: int) -> int:
    return ((key * _MULTIPLIER) & 0xFFFFFFFFFFFFFFFF) >> 42


class _Grown:
    """A flat array of numbers that grows."""

    def __init__(self, kind: type) -> None:
        self.room, self.size = np.zeros(1024, kind), 0

    def add(self, value: int) -> int:
        if self.size == len(self.room):
            self.room = np.concatenate([self.room, np.zeros_like(self.room)])
        self.room[self.size] = value
        self.size += 1
        return self.size - 1


class Transducer:
    """Encodes pieces of bytes by ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.trie: dict[int, int] = {}
        self.entry, self.inner = [-1], bytearray(1)
        size = 1
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                self.inner[node] = 1
                node = self.trie.get(key, 0)
                if not node:
                    node = self.trie[key] = size
                    self.entry.append(-1)
                    self.inner.append(0)
                    size += 1
            self.entry[node] = rank
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._history: dict[int, tuple] = {}
        self._reset()

    def _reset(self) -> None:
        self._states: dict[tuple, int] = {}
        self._threads: list[tuple] = []
        self._outputs: dict[tuple[int, ...], int] = {}
        self._steps: dict[int, int] = {}
        self._slot_key, self._slot_step = np.full(_SLOTS, -1), np.zeros(_SLOTS, np.int32)
        self._next, self._gives, self._rest = _Grown(np.int32), _Grown(np.int32), _Grown(np.int32)
        self._given, self._given_at, self._given_n = _Grown(np.int32), _Grown(np.int64), _Grown(np.int32)
        self._output(())
        self._state(((0, ()),))

    def _output(self, tokens: tuple[int, ...]) -> int:
        number = self._outputs.get(tokens)
        if number is None:
            number = self._outputs[tokens] = len(self._outputs)
            self._given_at.add(self._given.size)
            self._given_n.add(len(tokens))
            for t in tokens:
                self._given.add(t)
        return number

    def _state(self, threads: tuple) -> int:
        number = self._states.get(threads)
        if number is None:
            number = self._states[threads] = len(self._threads)
            self._threads.append(threads)
            self._rest.add(self._output(next(p for node, p in threads if not node)))
        return number

    def merged(self, piece: bytes) -> list[int]:
        """Encoding by repeated merging; used on pairs of tokens whose own merges are not of rising rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[x] for x in parts]

    def _edges(self, token: int) -> tuple[bool, list[tuple[bytes, float, float]], list[tuple[bytes, float, float]]]:
        """How the token's left and right edge came about: parts, each with the ranks of the merges that made and took it.

        First comes whether the token is reached at all, by merges of rising rank; else pairs with it are merged in full.
        """
        known = self._history.get(token)
        if known is not None:
            return known
        parts = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))]
        left, right, born, low, rising = [], [], [-1.0, -1.0], -1, True
        while len(parts) > 1:
            at = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            best = min(at)
            if best == 1 << 60:
                break
            rising, low, i = rising and best >= low, best, at.index(best)
            if i == 0:
                left.append((parts[0], born[0], best))
                born[0] = best
            if i == len(parts) - 2:
                right.append((parts[-1], born[1], best))
                born[1] = best
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        left.append((parts[0], born[0], float("inf")))
        right.append((parts[-1], born[1], float("inf")))
        known = self._history[token] = (rising, left, right)
        self._whole[token] = len(parts) == 1
        return known

    def _follows(self, left: int, right: int) -> bool:
        """Whether right can stand after left: the pair's border is never merged over. Two edge parts merge if they stand
        at the border at the same time and their merge comes before those that take either of them."""
        rising, opens, _ = self._edges(right)
        if left < 0 or not self._whole[right]:
            return self._whole[right]
        known = self._pairs.get(left << 20 | right)
        if known is None:
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            even, _, closes = self._edges(left)
            if not (rising and even):
                known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            else:
                known, i, j = True, 0, 0
                while True:
                    a, born_a, taken_a = closes[i]
                    b, born_b, taken_b = opens[j]
                    rank = self.ranks.get(a + b)
                    if rank is not None and rank < taken_a and rank <= taken_b:
                        known = False
                        break
                    if taken_a == taken_b == float("inf"):
                        break
                    if taken_a <= taken_b:  # of equal ranks the left one is merged first
                        i += 1
                    else:
                        j += 1
            self._pairs[left << 20 | right] = known
        return known

    def _step(self, key: int) -> int:
        """The number of a new transition: key is the state and the byte.

        Each prefix has exactly one valid last token, so of the threads that end here exactly one is valid. Pairs within
        the pending tokens are looked up; the thread that begins where the output ends is valid if no other is. So a state
        need not know the token before it, and states are few.
        """
        trie, entry, inner, byte = self.trie, self.entry, self.inner, key & 255
        on, ended, first = [], None, None
        for node, pending in self._threads[key >> 8]:
            child = trie.get(node << 8 | byte)
            if child is None:
                continue
            token = entry[child]
            if token >= 0 and ended is None:
                if not pending:
                    first = (token,) if self._follows(-1, token) else None
                elif self._follows(pending[-1], token):
                    ended = (*pending, token)
            if inner[child]:
                on.append((child, pending))
        ended = ended or first
        if ended is None:
            raise ValueError(f"byte {byte} has no encoding in this vocabulary")
        common = min((len(p) for _, p in on), default=len(ended))
        for _, p in on:
            while p[:common] != ended[:common]:
                common -= 1
        on.append((0, ended))
        step = self._next.add(self._state(tuple([(n, p[common:]) for n, p in on]) if common else tuple(on)))
        self._gives.add(self._output(ended[:common]))
        self._steps[key] = step
        slot = _slot(key)
        while self._slot_key[slot] >= 0:
            slot = (slot + 1) % _SLOTS
        self._slot_key[slot], self._slot_step[slot] = key, step
        return step

    def _taken(self, keys: np.ndarray) -> np.ndarray:
        """The transitions of keys; those not known yet are computed."""
        slots = ((keys.astype(np.uint64) * np.uint64(_MULTIPLIER)) >> np.uint64(42)).astype(np.int64)
        held = self._slot_key[slots]
        away = np.flatnonzero(held != keys)
        while len(away):
            new = away[held[away] < 0]
            if len(new):
                for key in np.unique(keys[new]).tolist():
                    self._step(key)
                slots[new] = ((keys[new].astype(np.uint64) * np.uint64(_MULTIPLIER)) >> np.uint64(42)).astype(np.int64)
            old = away[held[away] >= 0]
            slots[old] = (slots[old] + 1) % _SLOTS
            held[away] = self._slot_key[slots[away]]
            away = away[held[away] != keys[away]]
        return self._slot_step[slots]

    def encode_many(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and where each piece's ids begin. Piece i is data from offsets[i] to
        offsets[i + 1]."""
        if self._next.size > STEPS:
            self._reset()
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        starts, ordered = offsets[:-1][order], lengths[order]
        state = np.zeros(len(order), np.int64)
        pieces, outputs = [], []
        longest, k = int(ordered[0]) if len(ordered) else 0, 0
        while k < longest:
            n = int(np.searchsorted(-ordered, -k, "left"))
            if n < SIDE_BY_SIDE:
                break
            step = self._taken(state[:n] << 8 | data[starts[:n] + k])
            state[:n] = self._next.room[step]
            output = self._gives.room[step]
            some = np.flatnonzero(output)
            pieces.append(some)
            outputs.append(output[some])
            k += 1
        for i in range(n if k < longest else 0):  # few and long ones
            at, own = int(state[i]), []
            for byte in data[starts[i] + k : starts[i] + ordered[i]].tolist():
                key = at << 8 | byte
                step = self._steps.get(key)
                if step is None:
                    step = self._step(key)
                at = int(self._next.room[step])
                if self._gives.room[step]:
                    own.append(self._gives.room[step])
            state[i] = at
            pieces.append(np.full(len(own), i))
            outputs.append(np.array(own, np.int32))
        pieces.append(np.arange(len(order)))
        outputs.append(self._rest.room[state])
        piece, output = order[np.concatenate(pieces)], np.concatenate(outputs)
        when = np.argsort(piece, kind="stable")
        piece, output = piece[when], output[when]
        n_given = self._given_n.room[output]
        ends = np.cumsum(n_given)
        ids = self._given.room[np.repeat(self._given_at.room[output] - ends + n_given, n_given) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(piece, n_given, len(order)).astype(np.int64))])


class Utf8Stream:
    """Incremental UTF-8: text of what is complete so far; an unfinished last character waits for its other bytes."""

    def __init__(self) -> None:
        self._held = b""

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self._held + data
        keep = 0
        if not final:
            for back in range(1, min(3, len(data)) + 1):
                byte = data[-back]
                if byte & 0xC0 == 0x80:
                    continue
                need = 2 if byte & 0xE0 == 0xC0 else 3 if byte & 0xF0 == 0xE0 else 4 if byte & 0xF8 == 0xF0 else 1
                keep = back if need > back else 0
                break
        self._held = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep].decode("utf-8", "replace")


class Codec:
    """Whole texts to ids and back; the pattern splits a text into pieces, and each different piece of a batch is encoded.

    A lone space before a character that is not white space always begins a piece. So a text without other runs of space
    is cut there first, and only the different words of a batch are given to the pattern.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer = Transducer(ranks)
        self._split = regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self._decimal = pa.array([b"%d" % i for i in range(size)], pa.binary())
        self._entries = pa.array([self.transducer.tokens.get(i, b"") for i in range(size)], pa.binary())

    def _pieces(self, pieces: list[str], counts: np.ndarray) -> pa.ListArray:
        """Ids of groups of pieces, so many in each group."""
        held = pa.array(pieces, pa.string()).dictionary_encode()
        ids, starts = self.transducer.encode_many(*utf8(held.dictionary))
        taken = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids)).take(held.indices)
        ends = taken.offsets.to_numpy() - taken.offsets[0].as_py()
        return pa.ListArray.from_arrays(pa.array(ends[np.concatenate([[0], np.cumsum(counts)])], pa.int32()), taken.flatten())

    def _words(self, texts: pa.Array) -> pa.ListArray:
        """Ids of texts that may be cut at each space."""
        parts = pc.split_pattern(texts, " ")
        borders = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        held = parts.flatten().dictionary_encode()
        first = np.zeros(len(held), bool)
        first[borders[:-1]] = True
        different, places = np.unique(held.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + first, return_inverse=True)
        words = held.dictionary.to_pylist()
        later = [words[x >> 1] for x in different[different & 1 == 0].tolist()]
        early = [self._split(words[x >> 1]) for x in different[different & 1 == 1].tolist()]
        pieces = self._split(" " + " ".join(later)) if later else []
        opens = np.flatnonzero(np.fromiter((x[0] == " " for x in pieces), bool, len(pieces)))
        pieces += [x for own in early for x in own]
        counts = np.concatenate([np.diff(np.append(opens, len(pieces) - sum(map(len, early)))), np.fromiter(map(len, early), np.int64, len(early))])
        rank = np.empty(len(different), np.int64)
        rank[np.concatenate([np.flatnonzero(different & 1 == 0), np.flatnonzero(different & 1 == 1)])] = np.arange(len(different))
        taken = self._pieces(pieces, counts).take(pa.array(rank[places]))
        ends = taken.offsets.to_numpy() - taken.offsets[0].as_py()
        return pa.ListArray.from_arrays(pa.array(ends[borders], pa.int32()), taken.flatten())

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's ids begin; null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
        parts = []
        if not uneven.all():
            parts.append(self._words(texts.filter(pa.array(~uneven))))
        if uneven.any():
            pieces = [self._split(x) for x in texts.filter(pa.array(uneven)).to_pylist()]
            parts.append(self._pieces([x for own in pieces for x in own], np.fromiter(map(len, pieces), np.int64, len(pieces))))
        whole = pa.concat_arrays(parts)
        if len(parts) > 1:
            rank = np.empty(len(texts), np.int64)
            rank[np.concatenate([np.flatnonzero(~uneven), np.flatnonzero(uneven)])] = np.arange(len(texts))
            whole = whole.take(pa.array(rank))
        return whole.flatten().to_numpy(), whole.offsets.to_numpy().astype(np.int64) - whole.offsets[0].as_py()

    def decimal(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """For each row its ids in decimal, joined by commas."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), self._decimal.take(pa.array(ids))), b",")

    def encode(self, text: str) -> list[int]:
        return self.encode_column(pa.array([text], pa.string()))[0].tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return utf8(self._entries.take(pa.array(ids, pa.int32())))[0].tobytes()

    def decode(self, ids: np.ndarray, step: int = 1 << 16) -> Iterator[str]:
        """The text of ids, in parts."""
        stream = Utf8Stream()
        for low in range(0, len(ids), step):
            yield stream.feed(self.decode_bytes(ids[low : low + step]))
        yield stream.feed(b"", final=True)


#: A space before white space or at the end; more kinds of white space than any dialect knows do no harm.
_UNEVEN = r" ([\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"


@functools.lru_cache(maxsize=2)
def codec(content: str, pattern: str) -> Codec:
    """One for each Python worker; content is the rank file's text, or the name of a file added to the Spark context."""
    text = content if "\n" in content else open(SparkFiles.get(content)).read()
    own = Codec({base64.b64decode(a): int(b) for a, b in (x.split() for x in text.splitlines() if x)}, pattern)
    many_small_objects()
    return own


ENCODED = "doc_id long, n_tokens long, ids array<int>, decoded string"


def _rows(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str, digests: bool) -> Iterator[pa.RecordBatch]:
    own = codec(ranks, pattern)
    for batch in batches:
        ids, starts = own.encode_column(valid_utf8(batch.column(1)))
        n = np.diff(starts)
        rows = [ids[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        if digests:
            texts, decoded = own.decimal(ids, starts), []
            for row in rows:
                digest = hashlib.sha256()
                for part in own.decode(row):
                    digest.update(part.encode())
                decoded.append(digest.hexdigest())
            given = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in texts], pa.string())
        else:
            given, decoded = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids)), ["".join(own.decode(row)) for row in rows]
        names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), given, pa.array(decoded, pa.string())], names)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, digests: bool = False) -> DataFrame:
    """Ids and decoded text of every document, or their digests. ranks: a tiktoken rank file on the driver, which is sent
    to the executors once as a file of the Spark context."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(ranks)
    name = ranks.rsplit("/", 1)[-1]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else ENCODED
    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), lambda b: _rows(b, name, pattern, digests), schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
