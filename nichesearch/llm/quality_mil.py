"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Every passage is encoded by fixed
measures (a hashed byte-trigram profile, shares of character classes, diversity) and a
learned layer; gated attention, tanh(hV) * sigmoid(hU) against a vector w, weighs the
passages of a bag by softmax, and a logistic unit scores the weighted sum. All learned
parts are fitted to document labels only, by Adam on a bounded sample: about ``SAMPLE_DOCS``
documents of a class, chosen by hashed ids, whatever their length. A bag of more than ``SAMPLE_PASSAGES`` passages is
fitted by so many of them, chosen by hash from the whole text. Scores weigh every passage of
a text, some at a time, so that a text of any length takes bounded memory beside its own.

Defined cases: null and empty texts are one empty passage; repeated rows are each scored;
with labels of one class only every score is that class, with none 0; an empty table gives
none; passages of equal weight share the attention; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, labelled

PASSAGE, BUCKETS = 512, 256
#: Bounds of the training sample: documents of a class, passages of a document.
SAMPLE_DOCS, SAMPLE_PASSAGES = 3000, 32
HIDDEN, GATE, EPOCHS, BATCH, RATE, L2 = 32, 16, 16, 64, 3e-3, 1e-4
THRESHOLD = 0.7
WIDTH = BUCKETS + 8
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_CLASSES = np.zeros((7, 256), np.float32)
for _i, _of in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:'\"-!?()")):
    _CLASSES[_i, list(_of)] = 1
_CLASSES[6, :128] = 1 - _CLASSES[:6, :128].sum(axis=0)  # other ASCII characters


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Measures of all passages (passages x WIDTH), and each text's number of passages."""
    return measure([(x or "").encode("utf-8", "replace") for x in texts])


#: Bytes whose passages are measured at once, a multiple of a passage.
_AT_ONCE = 512 * PASSAGE


def _portions(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Pieces of coded texts, cut between passages, and the text of each; no text comes twice in a portion."""
    owners: list[int] = []
    pieces: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        coded = (text or "").encode("utf-8", "replace")
        for at in range(0, max(1, len(coded)), _AT_ONCE):
            pieces.append(coded[at : at + _AT_ONCE])
            owners.append(i)
            size += len(pieces[-1])
            if size >= _AT_ONCE:
                yield np.array(owners), pieces
                owners, pieces, size = [], [], 0
    if pieces:
        yield np.array(owners), pieces


def measure(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode``, of coded texts."""
    sizes = np.array([len(x) for x in coded], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    data = np.frombuffer(b"".join(coded), np.uint8)
    begins, firsts = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
    passage = (np.arange(len(data)) - np.repeat(begins, sizes)) // PASSAGE + np.repeat(firsts, sizes)
    n = int(counts.sum())
    out = np.zeros((n, WIDTH), np.float32)
    length = np.maximum(1, np.bincount(passage, minlength=n)).astype(np.float32)
    if len(data) > 2:
        u = data.astype(np.uint32)
        tri = ((u[:-2] * np.uint32(0x9E3779B1) + u[1:-1] * np.uint32(0x85EBCA77) + u[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(24)
        own = passage[:-2] == passage[2:]
        hist = np.bincount(passage[:-2][own] * BUCKETS + tri[own], minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:, BUCKETS + 7] = (hist > 0).sum(axis=1) / np.minimum(BUCKETS, length)
        profile = np.sqrt(hist, dtype=np.float32)
        out[:, :BUCKETS] = profile / np.maximum(1e-6, np.linalg.norm(profile, axis=1))[:, None]
    for i in range(7):
        out[:, BUCKETS + i] = np.bincount(passage, _CLASSES[i][data], n) / length
    return out, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _attended(p: dict, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hidden layer, both gates, and attention before the softmax, of passages."""
    h = np.tanh((x - p["mean"]) / p["sd"] @ p["w1"] + p["b1"])
    t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    return h, t, s, (t * s) @ p["w"]


def forward(p: dict, x: np.ndarray, counts: np.ndarray) -> dict:
    """Everything from passages to document scores; bags are consecutive rows."""
    at = np.cumsum(counts) - counts
    h, t, s, e = _attended(p, x)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
    a = e / np.repeat(np.add.reduceat(e, at), counts)
    z = np.add.reduceat(h * a[:, None], at)
    return {"at": at, "h": h, "t": t, "s": s, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["b"][0])}


def scores(p: dict, texts: list[str | None]) -> np.ndarray:
    """Of whole texts: their softmax and weighted sum are carried from portion to portion."""
    top, total, z = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros((len(texts), HIDDEN))
    for owners, pieces in _portions(texts):
        x, counts = measure(pieces)
        at = np.cumsum(counts) - counts
        h, _, _, e = _attended(p, x)
        before = top[owners]
        top[owners] = np.maximum(before, np.maximum.reduceat(e, at))
        kept, e = np.exp(before - top[owners]), np.exp(e - np.repeat(top[owners], counts))
        total[owners] = total[owners] * kept + np.add.reduceat(e, at)
        z[owners] = z[owners] * kept[:, None] + np.add.reduceat(h * e[:, None], at)
    return _sigmoid(z / total[:, None] @ p["c"] + p["b"][0])


def backward(p: dict, x: np.ndarray, counts: np.ndarray, f: dict, y: np.ndarray, weight: np.ndarray) -> dict:
    """Slopes of the weighted mean log loss."""
    d = (f["score"] - y) * weight / len(y)
    g = {"c": f["z"].T @ d, "b": np.array([d.sum()])}
    dz = np.repeat(d[:, None] * p["c"][None, :], counts, axis=0)
    da = (dz * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["at"]), counts))
    g["w"] = (f["t"] * f["s"]).T @ de
    dt = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
    ds = de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
    g["v"], g["u"] = f["h"].T @ dt, f["h"].T @ ds
    dh = (dz * f["a"][:, None] + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
    g["w1"], g["b1"] = ((x - p["mean"]) / p["sd"]).T @ dh, dh.sum(axis=0)
    return g


def train(bags: list[np.ndarray], y: np.ndarray, seed: int = 42) -> dict:
    rng = np.random.default_rng(seed)
    n = sum(map(len, bags))
    mean = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / n
    sd = np.sqrt(sum(((b - mean) ** 2).sum(axis=0) for b in bags) / n)
    p = {"mean": mean.astype(np.float32), "sd": (sd + 1e-3).astype(np.float32)}
    for name, shape in (("w1", (WIDTH, HIDDEN)), ("b1", HIDDEN), ("v", (HIDDEN, GATE)), ("u", (HIDDEN, GATE)), ("w", GATE), ("c", HIDDEN), ("b", 1)):
        p[name] = (rng.normal(size=shape) / np.sqrt(shape[0] if isinstance(shape, tuple) else HIDDEN)).astype(np.float32)
    learned = [k for k in p if k not in ("mean", "sd")]
    m, v, t = {k: 0.0 for k in learned}, {k: 0.0 for k in learned}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            x, counts = np.concatenate([bags[k] for k in own]).astype(np.float32), np.array([len(bags[k]) for k in own])
            g = backward(p, x, counts, forward(p, x, counts), y[own], np.ones(len(own)))
            t += 1
            for k in learned:
                slope = g[k] + L2 * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * slope, 0.999 * v[k] + 0.001 * slope**2
                p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return p


def fit(docs: DataFrame, labels: DataFrame) -> dict | float:
    """The model, or the one score there is to give."""
    common.small_batches(docs.sparkSession)
    sample = common.written(labelled.sample(docs, labels, "quality", SAMPLE_DOCS), "quality-sample")  # bounded

    def chosen(text: str | None, doc_id: int) -> list[bytes]:
        """A text's passages, or, of a long one, those with the least hashes."""
        coded = (text or "").encode("utf-8", "replace")
        n = max(1, -(-len(coded) // PASSAGE))
        own = range(n) if n <= SAMPLE_PASSAGES else sorted(sorted(range(n), key=lambda i: xxhash.xxh64_intdigest(f"{doc_id}:{i}"))[:SAMPLE_PASSAGES])
        return [coded[i * PASSAGE : (i + 1) * PASSAGE] for i in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [measure(chosen(text, doc_id))[0].astype(np.float16).tobytes() for text, doc_id in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("doc_id"), pa.array(bags, pa.binary())], names=["label", "doc_id", "x"])

    rows = sorted(map(tuple, sample.select("label", "doc_id", "text").mapInArrow(run, "label int, doc_id long, x binary").toLocalIterator()), key=lambda r: r[1])
    if len({r[0] for r in rows}) < 2:
        return float(rows[0][0]) if rows else 0.0
    return train([np.frombuffer(r[2], np.float16).reshape(-1, WIDTH) for r in rows], np.array([r[0] for r in rows], np.float32))


def score(docs: DataFrame, model: dict | float, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``SCHEMA`` for each row of ``docs`` (doc_id, text); map-only."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.fold(4) == 2).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float) or not batch.num_rows:
                p = np.full(batch.num_rows, model if isinstance(model, float) else 0.0)
            else:
                p = np.round(scores(model, batch.column("text").to_pylist()), 5)  # sums differ by batch beyond that
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return rows.mapInArrow(run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on rows that are not held out, then score all."""
    return score(docs, fit(docs.filter(common.fold(4) != 2), labels.filter(common.fold(4) != 2)))
