"""Quality classifier: a factorisation machine over hashed words, structure statistics and text length.

A text's features are its hashed words (counts, scaled to length one) and DENSE statistics of its form, of which the
length in bytes and words is the only metadata: labels, language, source and id are never inputs. The score is

    sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))

which takes time in proportion to the number of features. The machine is fitted on the driver on at most SAMPLE labelled
rows (those of the smallest hashed id), never on rows whose crc32(id) mod 3 is 1; its weights have a fixed size and are
broadcast.

Defined results: null text counts as empty and gets a score like any other; a null id is not held out; repeated rows get
equal scores; rows with a null label are not learned from; without labelled rows of both kinds every score is the share of
label 1 (1 if there is none); texts of any length are scored whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.common import blocks, lowered, map_arrow, mixed, prefix_hashes, table, utf8, word_bounds

#: Labelled rows to fit on at most, buckets of hashed words, factors.
SAMPLE, BUCKETS, FACTORS = 3000, 1 << 15, 6
EPOCHS, STEP, L2, BATCH = 12, 0.05, 1e-4, 64
_CLASSES = 8


def _classes() -> np.ndarray:
    out = np.full(256, 5)  # ASCII marks
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 0
        elif c.isupper():
            out[b] = 1
        elif c.islower():
            out[b] = 2
        elif c.isdigit():
            out[b] = 3
        elif c in " \t\r\n\x0b\x0c":
            out[b] = 4
        elif c in ".,;:'\"-()":
            out[b] = 6
    out[ord("!")] = 7
    return out


_CLASS = _classes()
_NOT_SPACE = _CLASS != 4
DENSE = 12


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A bucket for each word, from all its bytes."""
    sums, down = prefix_hashes(data)
    return (mixed((sums[ends] - sums[starts]) * down[starts]) >> np.uint64(49)).astype(np.int64)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For rows low to high: where each row's hashed words begin, the words, their values, and the dense statistics."""
    data, offsets = utf8(column)
    for low, high in blocks(offsets, 1 << 20):
        n, own = high - low, offsets[low : high + 1] - offsets[low]
        part = data[offsets[low] : offsets[high]]
        size = np.diff(own)
        kinds = np.bincount(np.repeat(np.arange(n) * _CLASSES, size) + _CLASS[part], minlength=n * _CLASSES).reshape(n, _CLASSES) / np.maximum(size, 1)[:, None]
        starts, ends, before = word_bounds(_NOT_SPACE[part], own)
        words = np.diff(before)
        row = np.repeat(np.arange(n), words)
        found, counts = np.unique(row * BUCKETS + _hash(lowered(part), starts, ends), return_counts=True)
        row, bucket = found // BUCKETS, found % BUCKETS
        begin = np.searchsorted(row, np.arange(n + 1))
        norm = np.sqrt(np.bincount(row, counts.astype(float) ** 2, n))
        top = np.zeros(n)
        np.maximum.at(top, row, counts)
        some = np.maximum(words, 1)
        dense = np.column_stack([kinds, np.log1p(size), size / some, np.diff(begin) / some, top / some])
        yield low, high, begin, bucket, (counts / norm[row]).astype(np.float32), dense.astype(np.float32)


class Machine:
    """Weights, factors and the scale of the dense statistics; the last DENSE features are those."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.bias = np.float32(0)
        self.weights = np.zeros(BUCKETS + DENSE, np.float32)
        self.factors = rng.normal(0, 0.02, (BUCKETS + DENSE, FACTORS)).astype(np.float32)
        self.mean, self.scale = np.zeros(DENSE, np.float32), np.ones(DENSE, np.float32)
        self.constant: float | None = None

    def joined(self, begin: np.ndarray, bucket: np.ndarray, value: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature and value of everything that is not zero; dense statistics as within three deviations."""
        n = len(dense)
        scaled = np.clip((dense - self.mean) / self.scale, -3, 3) / np.float32(np.sqrt(DENSE))
        row = np.concatenate([np.repeat(np.arange(n), np.diff(begin)), np.repeat(np.arange(n), DENSE)])
        return row, np.concatenate([bucket, np.tile(np.arange(BUCKETS, BUCKETS + DENSE), n)]), np.concatenate([value, scaled.ravel().astype(np.float32)])

    def raw(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The machine's sum for each row, and the sums of factors, by the sum-of-squares identity."""
        linear = np.bincount(row, self.weights[feature] * value, n)
        sums, squares = np.empty((n, FACTORS)), np.zeros(n)
        for f in range(FACTORS):
            part = self.factors[feature, f] * value
            sums[:, f] = np.bincount(row, part, n)
            squares += np.bincount(row, part * part, n)
        return self.bias + linear + ((sums**2).sum(1) - squares) / 2, sums

    def scores(self, begin: np.ndarray, bucket: np.ndarray, value: np.ndarray, dense: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(dense), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.joined(begin, bucket, value, dense), len(dense))[0], -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], seed: int = 7) -> Machine:
    """A machine for (buckets, values, dense statistics, label) of labelled rows; both labels weigh the same in the end."""
    own = Machine(seed)
    label = np.array([r[3] for r in rows], np.float32)
    if not len(rows) or label.min() == label.max():
        own.constant = float(label.mean()) if len(rows) else 1.0
        return own
    dense = np.stack([r[2] for r in rows])
    own.mean, own.scale = dense.mean(0), dense.std(0) + np.float32(1e-3)
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    rng = np.random.default_rng(seed)
    g_w, g_v = np.full(BUCKETS + DENSE, 1e-2, np.float32), np.full((BUCKETS + DENSE, FACTORS), 1e-2, np.float32)
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            begin = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in at])])
            row, feature, value = own.joined(begin, np.concatenate([rows[i][0] for i in at]), np.concatenate([rows[i][1] for i in at]), dense[at])
            raw, sums = own.raw(row, feature, value, len(at))
            error = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[at]) * weight[at] / len(at)).astype(np.float32)
            e = error[row] * value
            touched, inverse = np.unique(feature, return_inverse=True)
            d_w = np.bincount(inverse, e, len(touched)).astype(np.float32) + L2 * own.weights[touched]
            g_w[touched] += d_w**2
            own.weights[touched] -= STEP * d_w / np.sqrt(g_w[touched])
            v = own.factors[feature]
            for f in range(FACTORS):
                d = np.bincount(inverse, e * (sums[row, f] - v[:, f] * value), len(touched)).astype(np.float32) + L2 * own.factors[touched, f]
                g_v[touched, f] += d**2
                own.factors[touched, f] -= STEP * d / np.sqrt(g_v[touched, f])
            own.bias -= np.float32(STEP * error.sum())
    return own


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, begin, bucket, value, dense in features(batch.column(0)):
            n = high - low
            parts = [[x[begin[i] : begin[i + 1]].astype(kind).tobytes() for i in range(n)] for x, kind in ((bucket, "<i4"), (value, "<f4"))]
            yield pa.RecordBatch.from_arrays([*(pa.array(p, pa.binary()) for p in parts), pa.array([d.tobytes() for d in dense], pa.binary()), batch.column(1).slice(low, n)], ["bucket", "value", "dense", "label"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits a machine on at most `sample` labelled rows of docs that are not held out. Of rows that repeat an id, the one of
    the least text counts, so the rows that reach the driver are bounded whatever the ids."""
    rows = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    few = rows.groupBy("doc_id").agg(F.max("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").cast("int").alias("label"))
    found = map_arrow(joined.select("text", "label"), _sampled, "bucket binary, value binary, dense binary, label int").collect()
    found.sort(key=lambda r: (r.bucket, r.value, r.dense, r.label))
    return fit([(np.frombuffer(r.bucket, "<i4").astype(np.int64), np.frombuffer(r.value, "<f4"), np.frombuffer(r.dense, "<f4"), int(r.label == 1)) for r in found])


def _score(batches: Iterator[pa.RecordBatch], machine: Machine, at: int, into: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.empty(batch.num_rows)
        for low, high, *found in features(batch.column(at)):
            score[low:high] = machine.scores(*found)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, into])


def score(docs: DataFrame, machine: Machine, into: str = "score") -> DataFrame:
    """docs, with its columns, and the score in a new one, which takes the place of one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.drop(into)
    at = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{into}` double"
    return map_arrow(docs, lambda b: _score(b, shared.value, at, into), schema)


def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs, with their columns, of a score of 0.5 or more; a column `score` of docs stays as it is."""
    into = "score_"
    while into in docs.columns:
        into += "_"
    return score(docs, machine, into).filter(F.col(into) >= 0.5).select(*docs.columns)
