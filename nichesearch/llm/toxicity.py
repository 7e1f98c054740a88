"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased and spaced at both ends; every run of 4 and of 6 characters (code points)
is a feature, hashed to 2^20 buckets and counted once a document. In a bounded sample of
about ``SAMPLE_DOCS`` labelled documents a class, chosen by hashed ids and read whole, each
bucket's smoothed log ratio of toxic to other documents is taken. All buckets are features: a
regularised logistic regression over their ratios is fitted, with a weight for each, and scores whole texts.

Defined cases: null and empty texts are scored by the intercept alone; repeated rows are
each scored; with labels of one class only, every score is nearly that class, with none nearly 0 (the
logistic function 500 from its middle); texts of any length are read whole; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, labelled

#: Bound of the training sample, documents of a class; bits of a bucket.
SAMPLE_DOCS, BITS = 1500, 20
LENGTHS = (4, 6)
#: Documents that the smoothing counts as seen in each bucket, dealt to the classes as the sample is; so rare buckets tell little.
SMOOTHING, L2, STEPS, RATE = 100.0, 1e-3, 60, 0.1
THRESHOLD = 0.5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


#: Characters whose n-grams are taken at once, by which a worker's memory is bounded; longer texts are cut, with the overlap that no n-gram is lost.
_AT_ONCE = 1 << 18


def _portions(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of lower-cased, spaced texts, and the text of each, some at a time."""
    owners: list[int] = []
    pieces: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        spaced = f" {(text or '').lower()} "
        for at in range(0, len(spaced), _AT_ONCE):
            pieces.append(spaced[at : at + _AT_ONCE + max(LENGTHS) - 1])
            owners.append(i)
            size += len(pieces[-1])
            if size >= _AT_ONCE:
                yield owners, pieces
                owners, pieces, size = [], [], 0
    if pieces:
        yield owners, pieces


def _grams(pieces: list[str]) -> list[np.ndarray]:
    """Buckets at each position of the joined pieces, for both lengths."""
    u = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    base, square = (np.uint64(0x100000001B3**i % 2**64) for i in (1, 2))
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    two = u[:-1] * base + u[1:]
    four = two[:-2] * square + two[2:] if len(two) > 2 else two[:0]
    six = four[:-2] * square + two[4:] if len(four) > 2 else two[:0]
    return [((x ^ x >> np.uint64(31)) * mix + np.uint64(i * int(mix) % 2**64) >> shift).astype(np.int32) for i, x in enumerate((four, six))]


class _Features:
    """The distinct buckets of texts, found by marking a table of all buckets."""

    def __init__(self) -> None:
        self.owner, self.last, self.texts = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int32), 0

    def of(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(text, buckets that it has not had yet), one text after the other; a long one comes several times."""
        for owners, pieces in _portions(texts):
            grams, begin = _grams(pieces), 0
            for i, piece in zip(owners, pieces, strict=True):
                end, mark = begin + len(piece), self.texts + i + 1
                found = np.concatenate([g[begin : max(begin, end - n + 1)] for n, g in zip(LENGTHS, grams, strict=True)])
                found = found[self.owner[found] != mark]
                place = np.arange(len(found), dtype=np.int32)
                self.last[found] = place
                found = found[self.last[found] == place]  # the last of equal ones
                self.owner[found] = mark
                yield i, found
                begin = end
        self.texts += len(texts)


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents by class and bucket, and of each class; at most 2^BITS rows are brought together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, features = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64), _Features()
        for batch in batches:
            label = batch.column("label").to_pylist()
            docs += np.bincount(np.array(label, np.int64), minlength=2)
            for i, found in features.of(batch.column("text").to_pylist()):
                counts[label[i]][found] += 1
        used = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1).astype(np.int32)), *(pa.array(np.append(counts[k][used], docs[k]).astype(np.int64)) for k in (0, 1))], names=["bucket", "n0", "n1"]
        )

    summed = sample.select("label", "text").mapInArrow(run, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    bucket, n0, n1 = (summed.column(c).to_numpy() for c in ("bucket", "n0", "n1"))
    counts, classes = np.zeros((2, 1 << BITS), np.float32), np.zeros(2)
    counts[:, bucket[bucket >= 0]] = np.array([n0, n1])[:, bucket >= 0]
    classes[:] = [n[bucket < 0].sum() for n in (n0, n1)]
    return counts, classes


def _sparse(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the sample's documents in turn, the number of each, and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features()
        for batch in batches:
            own: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for i, found in features.of(batch.column("text").to_pylist()):
                own[i].append(found)
            coded = [np.concatenate(x).astype("<u4").tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("doc_id"), pa.array(coded, pa.binary())], names=["label", "doc_id", "x"])

    rows = sample.mapInArrow(run, "label int, doc_id long, x binary").toArrow().sort_by("doc_id")
    features = [np.frombuffer(x.as_buffer(), "<u4") for x in rows.column("x")]
    return np.concatenate([np.zeros(0, np.uint32), *features]), np.array([len(x) for x in features], np.int64), rows.column("label").to_numpy().astype(np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Model from rows (doc_id, text) and (doc_id, toxic) that may be learned from."""
    common.small_batches(docs.sparkSession)
    sample = labelled.sample(docs, labels, "toxic", SAMPLE_DOCS).repartition(docs.sparkSession.sparkContext.defaultParallelism)
    sample = common.written(sample, "toxicity-sample")  # bounded; read twice
    counts, classes = _counts(sample)
    if not classes.all():
        return {"ratios": np.zeros(1 << BITS), "weights": np.zeros(1 << BITS), "bias": 500.0 if classes[1] else -500.0}
    prior = SMOOTHING * classes[:, None] / classes.sum()
    smooth = (counts + prior) / (classes[:, None] + prior)
    ratio = np.where(counts.any(axis=0), np.log(smooth[1] / smooth[0]), 0.0)
    feature, sizes, y = _sparse(sample)
    ends = np.cumsum(sizes)
    some = np.flatnonzero(sizes)  # of documents that have features
    weigh = (classes.sum() / (2 * classes))[y.astype(np.int64)]  # both classes as one
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(feature), _AT_ONCE * 4)), len(sizes)))
    w, bias = np.zeros(1 << BITS), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, STEPS + 1):  # Adam on the whole sample
        z = np.full(len(y), bias)
        if len(some):
            z[some] += np.add.reduceat((w * ratio)[feature], (ends - sizes)[some])
        error, slope = (_sigmoid(z) - y) * weigh, np.zeros(len(w))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = feature[ends[a] - sizes[a] : ends[b - 1]]
            slope += np.bincount(own, np.repeat(error[a:b], sizes[a:b]), len(w))
        slope = np.append(ratio * slope / len(y) + L2 * w, error.mean())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return {"ratios": ratio, "weights": w * ratio, "bias": float(bias)}


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``SCHEMA`` for each row of ``docs`` (doc_id, text); map-only."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.fold(5) == 0).alias("held_out"), "text")

    weights, bias = docs.sparkSession.sparkContext.broadcast(model["weights"]), model["bias"]  # 8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weight = _Features(), weights.value
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for i, found in features.of(batch.column("text").to_pylist()):
                z[i] += weight[found].sum()
            p = _sigmoid(z)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return rows.mapInArrow(run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on rows that are not held out, then score all."""
    return score(docs, fit(docs.filter(common.fold(5) != 0), labels.filter(common.fold(5) != 0)))
