"""Packing by powers of two: a document's tokens are split into pieces of binary length, and equal lengths share a bucket.

A document of n tokens gives n >> 11 pieces of 2048 and one piece for each lower bit of n. Each piece is a sequence by
itself, so no sequence crosses documents and none is padded; a batch takes its sequences from one bucket.

Defined results: null text counts as empty, so each document has its end token at least; a null doc_id stays null and
repeated rows are packed as often as they occur; equal texts give equal pieces; bytes that are no UTF-8 count as U+FFFD; other columns are not read; texts of any
length are packed whole. Sequence ids are unique within a result.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.common import Memo, many_small_objects, map_arrow, table, valid_utf8

MOST, END = 2048, 1
MEMO, MEMO_CHARS = 350_000, 48
#: Latin letters that are their own normal form and have one-character lower case, then ASCII marks but the apostrophe.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)").fullmatch


# What a vocabulary file says of itself if its words end at white space and letters are lower-cased one by one.
_NORMALS = ["NFC", "Replace", "Lowercase"]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _by_words(path: str) -> bool:
    """Whether words between white space can be encoded one by one; else texts take the whole way."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    normals = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
    splits = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    return normals == _NORMALS and len(splits) == 2 and splits[0].get("pattern") == {"Regex": _SPLIT} and splits[1]["type"] == "ByteLevel" and not splits[1]["add_prefix_space"] and told["model"]["type"] == "BPE" and not told["model"]["dropout"]


def _byte_chars() -> dict[int, int]:
    """The characters that stand for bytes in such vocabularies: printable ones for themselves, others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: b if b in own else 256 + k for b, k in ((b, sum(x not in own for x in range(b))) for b in range(256))}


_BYTE_CHARS = _byte_chars()


class Ids:
    """Ids of whole texts by a tokenizers file whose words end at white space; equal words are encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._model = self._tokenizer.model
        self._by_words = _by_words(path)
        self._kind = "<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self._memo = Memo(self._encode, MEMO, MEMO_CHARS)
        self._words = Memo(self._merged, MEMO // 2, MEMO_CHARS)

    def _merged(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
        return np.array([x.id for x in self._model.tokenize(mapped)], self._kind).tobytes()

    def _encode(self, part: str) -> bytes:
        """A part without white space. Plain letters with punctuation after them need no normalising but lower case, so
        they go to the merges directly; all else takes the whole way."""
        plain = _PLAIN(part)
        if plain:
            letters, marks = plain.groups()
            return (self._words[letters.lower()] if letters else b"") + (self._words[marks] if marks else b"")
        return np.array(self._tokenizer.encode(part, add_special_tokens=False).ids, self._kind).tobytes()

    def of(self, text: str) -> np.ndarray:
        """The ids of a text.

        Where the vocabulary drops white space and no entry goes over it, a text's ids are those of its parts between
        spaces and line ends, in order.
        """
        if not self._by_words:
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self._kind)
        memo = self._memo
        return np.frombuffer(b"".join([memo[x] for x in text.replace("\n", " ").split(" ")]), self._kind)


@functools.lru_cache(maxsize=2)
def _ids(name: str) -> Ids:
    own = Ids(SparkFiles.get(name))
    many_small_objects()
    return own


def pieces(n: int) -> Iterator[tuple[int, int]]:
    """Start and length of each piece of n tokens: whole sequences first, then the lower bits of n, highest first."""
    start = 0
    for _ in range(n // MOST):
        yield start, MOST
        start += MOST
    bit = MOST >> 1
    while bit:
        if n & bit:
            yield start, bit
            start += bit
        bit >>= 1


def _rows(batches: Iterator[pa.RecordBatch], name: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    own, end = _ids(name), np.array([END], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(x, "<i4") for x in columns[5]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        rows: list[tuple] = []
        for doc_id, ids in zip(batch.column(0).to_pylist(), map(own.of, (x.as_py() or "" for x in valid_utf8(batch.column(1)))), strict=True):
            ids = ids.astype("<u4").tobytes() + end
            n = len(ids) // 4
            for start, length in pieces(n):
                part = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, start, length, zlib.crc32(part), n, *([part] if with_ids else [])))
                if len(rows) >= 4096:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)


def pack_documents(docs: DataFrame, vocabulary: str, with_ids: bool = True) -> DataFrame:
    """One row for each piece; with_ids adds its ids. The bucket is the logarithm of the length: a reader of equal
    lengths asks for `bucket = k`, which `write_buckets` turns into a folder."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    rows = map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), lambda b: _rows(b, name, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)
    return rows.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences in one folder for each length; rows are not moved between tasks."""
    packed.write.partitionBy("bucket").parquet(path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
