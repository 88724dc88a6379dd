"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are shares of character classes, word statistics
and repetition, its neighbours' features stand beside its own, and transitions link the
labels. Forward-backward gives each line's marginal; a document's quality is the mean of
its lines' marginals, weighted by length, put on the scale of the labels by a logistic
curve fitted on the training documents.

Labels exist for documents only, so training starts from each line having its document's
label; lines of bad documents that the model then finds good are relabelled, and the
model is fitted again. It is fitted on the driver on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import chunks, mix, text_buffers, words_of

_U = np.uint64
#: Bounds of the training sample: labelled documents (those of least hash), and lines of one.
TRAIN_DOCS, TRAIN_LINES = 3000, 300

_CLASSES = ["lower", "upper", "digit", "space", "point", "bang", "pipe", "symbol", "lead", "tail"]
_CLASS = np.full(256, _CLASSES.index("symbol"), np.uint8)
_CLASS[0x61:0x7B] = _CLASSES.index("lower")
_CLASS[0x41:0x5B] = _CLASSES.index("upper")
_CLASS[0x30:0x3A] = _CLASSES.index("digit")
_CLASS[[0x20, *range(0x09, 0x0E)]] = _CLASSES.index("space")
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = _CLASSES.index("point")
_CLASS[ord("!")] = _CLASSES.index("bang")
_CLASS[ord("|")] = _CLASSES.index("pipe")
_CLASS[0xC0:] = _CLASSES.index("lead")
_CLASS[0x80:0xC0] = _CLASSES.index("tail")


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x features), lengths in characters, and the index of each text's
    first line (one more at the end). A text has one line more than it has line ends."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    first = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    ends = np.empty(len(starts), np.int64)
    ends[:-1], ends[-1:] = starts[1:], offsets[-1:]
    line = np.repeat(np.arange(len(starts)), ends - starts)
    n_class = len(_CLASSES)
    count = np.bincount(line * n_class + _CLASS[data], minlength=len(starts) * n_class).reshape(-1, n_class).astype(np.float64)
    c = dict(zip(_CLASSES, count.T, strict=True))
    words, w_start, w_end, _ = words_of(data, offsets, lower=True)
    of = np.searchsorted(starts, w_start, "right") - 1
    n_words = np.bincount(of, minlength=len(starts)).astype(np.float64)
    in_words = np.bincount(of, weights=w_end - w_start, minlength=len(starts))
    seen = np.sort((of.astype(_U) << _U(40)) | (mix(words) >> _U(24)))
    new = np.concatenate(([True], seen[1:] != seen[:-1]))[: len(seen)]
    distinct = np.bincount((seen[new] >> _U(40)).astype(np.int64), minlength=len(starts)).astype(np.float64)
    chars = (ends - starts) - c["tail"]
    some, letters, words1 = np.maximum(chars, 1), np.maximum(c["lower"] + c["upper"], 1), np.maximum(n_words, 1)
    upper, symbol, pipe, bang = c["upper"] / letters, c["symbol"] / some, c["pipe"] / some, c["bang"] / some
    variety = distinct / words1
    long = n_words >= 8
    last = data[np.maximum(ends - 2, 0)] if len(data) else np.zeros(len(starts), np.uint8)
    f = [
        np.log1p(chars) / 5, upper, c["digit"] / some, np.minimum(5 * symbol, 2), np.minimum(20 * pipe, 2), np.minimum(10 * bang, 2), 5 * c["point"] / some, variety, np.minimum(in_words / words1 / 10, 3),
        c["lead"] / some, chars == 0, n_words < 3, upper > 0.5, symbol > 0.03, pipe > 0.01, bang > 0.03, long & (variety < 0.6), long & (variety < 0.3), (last == ord(".")) & (chars > 1),
    ]
    return np.stack([np.asarray(x, np.float64) for x in f], 1), chars, first


def _with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after it (0 outside the text), and 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate((x, before, after, np.ones((len(x), 1))), 1)


def _ordered(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts by falling number of lines, and how many have more than t lines, for each t."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    return order, np.searchsorted(-n[order], -np.arange(n.max(initial=0)), "left")


def marginals(unary: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line good) by forward-backward, all texts at once, and the expected number of
    transitions by (from, to). unary: log-odds of good; trans: 2 x 2 scores."""
    order, live = _ordered(first)
    start = first[:-1][order]
    e = np.exp(np.stack((np.minimum(-unary, 0), np.minimum(unary, 0)), 1))  # scaled, bad and good
    m = np.exp(trans - trans.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for t, k in enumerate(live):
        at = start[:k] + t
        a = e[at] if t == 0 else e[at] * (alpha[at - 1] @ m)
        alpha[at] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(len(live) - 1, 0, -1):
        at = start[: live[t]] + t
        right = e[at] * beta[at]
        joint = alpha[at - 1][:, :, None] * m[None] * right[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        pairs += joint.sum(0)
        b = right @ m.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(1), pairs


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    scale: tuple[float, float]

    def score(self, x: np.ndarray, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        p, _ = marginals(np.clip(_with_neighbours(x, first) @ self.weights, -30, 30), self.trans, first)
        good = document_quality(p, chars, first)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] + self.scale[1] * good, -30, 30)))


def document_quality(p: np.ndarray, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals; an empty line counts as one character."""
    w = np.maximum(chars, 1)
    return np.add.reduceat(p * w, first[:-1]) / np.add.reduceat(w, first[:-1])


def fit(x: np.ndarray, chars: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 3, steps: int = 80, ridge: float = 1e-3) -> Model:
    """Maximum likelihood by Adam. Classes weigh alike, whatever their shares."""
    z = _with_neighbours(x, first)
    doc = np.repeat(np.arange(len(label)), np.diff(first))
    y = label[doc].astype(np.float64)
    balance = np.where(label == 1, 0.5 / max(label.mean(), 1e-3), 0.5 / max(1 - label.mean(), 1e-3))
    inner = np.ones(len(z), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    w, trans = np.zeros(z.shape[1]), np.zeros((2, 2))
    for turn in range(rounds):
        m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1.0)
        for step in range(1, steps + 1):
            p, pairs = marginals(np.clip(z @ w, -30, 30), trans, first)
            g = np.concatenate((z.T @ ((p - y) * balance[doc]) / len(z) + ridge * w, ((pairs - seen) / len(z) + ridge * trans).ravel()))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w, trans = w - move[:-4], trans - move[-4:].reshape(2, 2)
        p, _ = marginals(np.clip(z @ w, -30, 30), trans, first)
        if turn < rounds - 1:  # a bad document's good lines, unless it has no others
            worst = np.minimum.reduceat(p, first[:-1])[doc]
            y = np.where(label[doc] == 1, 1.0, ((p > 0.5) & (p > worst)).astype(np.float64))
    good = document_quality(p, chars, first)
    a, b = 0.0, 1.0
    for _ in range(60):  # Newton's method for the logistic curve, with a little ridge
        q = 1 / (1 + np.exp(-np.clip(a + b * good, -30, 30)))
        g = np.array([(q - label).sum(), ((q - label) * good).sum() + 1e-2 * b])
        h = q * (1 - q)
        hess = np.array([[h.sum() + 1e-6, (h * good).sum()], [(h * good).sum(), (h * good * good).sum() + 1e-2]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, g)
    return Model(w, trans, (float(a), float(b)))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from labelled rows whose crc32(doc_id) mod 5 is not 0; None without any."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")  # TRAIN_DOCS rows at most
    rows = rows.filter(F.size(F.split("text", "\n")) <= TRAIN_LINES).dropDuplicates(["doc_id"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for a, b in chunks(offsets):
                x, chars, first = line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                cells = [pa.array([v[s:e].tobytes() for s, e in zip(first[:-1], first[1:], strict=True)], pa.binary()) for v in (x.astype(np.float32), chars.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column("quality").slice(a, b - a), *cells], names=["quality", "x", "chars"])

    sample = rows.select("quality", "text").mapInArrow(features, "quality int, x binary, chars binary").collect()
    if not sample:
        return None
    chars = [np.frombuffer(r["chars"], np.float32).astype(np.float64) for r in sample]
    first = np.concatenate(([0], np.cumsum([len(c) for c in chars])))
    x = np.concatenate([np.frombuffer(r["x"], np.float32) for r in sample]).astype(np.float64).reshape(first[-1], -1)
    return fit(x, np.concatenate(chars), first, np.array([r["quality"] for r in sample]))


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with a column score: 0.5 for all where there was nothing to learn from. A
    null text counts as empty. One pass, no shuffle."""
    if model is None:
        return docs.withColumn("score", F.lit(0.5))
    others = [c for c in docs.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            out = [np.zeros(0)]
            for a, b in chunks(offsets):
                out.append(model.score(*line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(np.concatenate(out))], names=[*others, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.select(*others, "text").mapInArrow(score, f"{schema}, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text).

    Null or empty texts are one empty line and get its score; repeated rows get equal
    scores; with a null doc_id held_out is false. Labels that are null or of no document
    teach nothing; of several labels of a document the higher counts. Without labels
    every score is 0.5. Other columns are not read; an empty table gives no rows.
    """
    scored = scores(docs.select("doc_id", "text"), train(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns. The
    score rides beside the text in one pass, so nothing is joined or shuffled.

    A null text scores as an empty one; repeated rows fare alike; without usable labels
    all rows stay, and an empty table gives no rows. A score at the threshold stays."""
    model = train(docs, labels)
    if model is None:
        return docs

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for a, b in chunks(offsets):
                s = model.score(*line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                yield batch.slice(a, b - a).filter(pa.array(s >= threshold))

    return docs.mapInArrow(kept, docs.schema)
