"""Document quality from lines: a linear-chain CRF tags every line good or bad.

A line's features are shares of signs in it (capitals, symbols, marks, digits), repeated
words, whether an earlier line equals it, and the same of the lines before and after
it. Forward-backward gives each line's probability of being good; their mean weighted by
length, set to a logistic curve, is the score.

Labels stand on documents, not on lines. Fitting starts with every line of a bad document
as bad and alternates: fit the chain, then tag the lines of bad documents again by their
marginals, with the likeliest bad line of each always bad. The fit takes a bounded
sample of labelled rows: about ``sample_docs`` of them by a hash of their id, without those of over
``sample_lines`` lines.

A text without lines scores as one with no good line. Null texts are empty. Repeated rows
give repeated rows. An empty table gives no rows; without labels every score is 0.5 at
most. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadframes.llm import crf
from roadframes.llm.common import hash_sample, one_text, over_batches, texts
from roadframes.llm.textscan import (
    DIGIT, LOWER, MIX_B, NOT_NEWLINE, NOT_SPACE, U64, UPPER, Chunk, byte_table, chunks, mixed)

MARKS = byte_table(b"!?")
SYMBOLS = byte_table(b"#*$%&|<>@^~=_+\\{}[]")
OWN = 9
NEIGHBOUR = slice(1, 7)
GOOD = 1


def line_features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length, and the offsets of the documents among the lines."""
    lines, words = chunk.runs(NOT_NEWLINE), chunk.runs(NOT_SPACE)
    n = len(lines)

    def of(table: np.ndarray) -> np.ndarray:
        total = chunk.totals(table)
        return (total[lines.end] - total[lines.start]).astype(np.float32)

    size = (lines.end - lines.start).astype(np.float32)
    upper, lower = of(UPPER), of(LOWER)
    inside = np.searchsorted(lines.end, words.start, "right")  # the line of each word
    n_words = np.bincount(inside, minlength=n).astype(np.float32)
    hashes = chunk.hasher()
    h = hashes(words.start, words.end)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (inside[1:] == inside[:-1])
    repeated = np.bincount(inside[again], minlength=n)
    key = mixed(hashes(lines.start, lines.end) + lines.doc.astype(U64) * U64(MIX_B))
    copied = np.ones(n, dtype=np.float32)
    copied[np.unique(key, return_index=True)[1]] = 0
    some = np.maximum(n_words, 1)
    own = np.empty((n, OWN), dtype=np.float32)
    own[:, 0] = 1
    own[:, 1] = upper / np.maximum(upper + lower, 1)
    own[:, 2] = np.minimum(of(SYMBOLS) / some, 3)
    own[:, 3] = np.minimum(of(MARKS) / some, 3)
    own[:, 4] = repeated / some
    own[:, 5] = copied
    own[:, 6] = of(DIGIT) / np.maximum(size, 1)
    own[:, 7] = np.log1p(n_words) / 4
    own[:, 8] = np.minimum(size / some, 40) / 10
    bounds = np.searchsorted(lines.doc, np.arange(chunk.n + 1), "left")
    before, after = np.zeros((n, 6), dtype=np.float32), np.zeros((n, 6), dtype=np.float32)
    same = lines.doc[1:] == lines.doc[:-1]
    before[1:][same] = own[:-1, NEIGHBOUR][same]
    after[:-1][same] = own[1:, NEIGHBOUR][same]
    return np.concatenate([own, before, after], axis=1), size, bounds


@dataclass
class QualityModel:
    chain: crf.Chain
    slope: float
    offset: float

    def score(self, share: np.ndarray) -> np.ndarray:
        x = self.slope * _logit(share) + self.offset
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def good_share(chain: crf.Chain, features: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' probabilities of being good; 0 without lines."""
    p = crf.marginals(chain, chain.scores(features), bounds)[:, GOOD]
    total = np.concatenate([[0], np.cumsum(size, dtype=np.float64)])
    good = np.concatenate([[0], np.cumsum(p * size, dtype=np.float64)])
    weight = total[bounds[1:]] - total[bounds[:-1]]
    return (good[bounds[1:]] - good[bounds[:-1]]) / np.maximum(weight, 1)


def training_lines(docs: DataFrame, labels: DataFrame, use: Column, sample_docs: int, sample_lines: int):
    """Label, line features and line lengths of the sampled documents."""
    chosen = labels.where(use).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("label"))
    # broadcast: about sample_docs rows by the bound of the sample
    sample = F.broadcast(hash_sample(chosen, "doc_id", sample_docs))

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, label = [], batch.column("label").to_numpy()
        for chunk in chunks(batch.column("text")):
            features, size, bounds = line_features(chunk)
            for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if 0 < b - a <= sample_lines:
                    out.append((int(label[chunk.first + d]), features[a:b].tobytes(), size[a:b].tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[k] for r in out], pa.binary()) for k in (1, 2))],
            ["label", "features", "size"])

    rows = over_batches(one_text(texts(docs).join(sample, "doc_id"), "lines"), lines, "label int, features binary, size binary").collect()
    rows.sort(key=lambda r: bytes(r["features"]))  # a fit must not depend on the order of tasks
    width = OWN + 12
    features = [np.frombuffer(r["features"], dtype=np.float32).reshape(-1, width).astype(np.float64) for r in rows]
    return (np.array([r["label"] for r in rows], dtype=np.int64), features,
            [np.frombuffer(r["size"], dtype=np.float32) for r in rows])


def fit_quality(docs: DataFrame, labels: DataFrame, use: Column, sample_docs: int = 4000, sample_lines: int = 1000,
                rounds: int = 3) -> QualityModel:
    """A model from labelled documents for which ``use`` holds."""
    label, features, sizes = training_lines(docs, labels, use, sample_docs, sample_lines)
    if not len(label):
        return QualityModel(crf.Chain(np.zeros((OWN + 12, 2)), np.zeros((2, 2)), np.zeros(2)), 1.0, 0.0)
    tags = [np.full(len(f), y) for f, y in zip(features, label, strict=True)]
    # features of equal spread fit in few steps; the scale then goes into the weights
    scale = np.maximum(np.concatenate(features).std(axis=0), 1e-2)
    scale[0] = 1
    features = [f / scale for f in features]
    bounds = np.concatenate([[0], np.cumsum([len(f) for f in features])])
    flat = np.concatenate(features)
    chain = None
    for _ in range(rounds):
        chain = crf.fit(features, tags, 2, start=chain, steps=60, rate=0.15, l2=1e-5)
        p = crf.marginals(chain, chain.scores(flat), bounds)[:, GOOD]
        for i in np.flatnonzero(label == 0):
            own = p[bounds[i] : bounds[i + 1]]
            tags[i] = (own > 0.5).astype(np.int64)
            tags[i][own.argmin()] = 0
    share = good_share(chain, flat, np.concatenate(sizes), bounds)
    curve = crf.platt(_logit(share), label)
    return QualityModel(crf.Chain(chain.weights / scale[:, None], chain.moves, chain.first), *curve)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score, good_share`` for every row."""

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        shares = [good_share(model.chain, *line_features(c)) for c in chunks(batch.column("text"))]
        share = np.concatenate(shares)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(model.score(share)), pa.array(share)], ["doc_id", "score", "good_share"])

    return over_batches(texts(docs), score, "doc_id long, score double, good_share double")


def keep_good(docs: DataFrame, model: QualityModel, cut: float) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, with all their columns and without a shuffle."""

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        share = np.concatenate([good_share(model.chain, *line_features(c)) for c in chunks(batch.column("text"))])
        return batch.filter(pa.array(model.score(share) >= cut))

    return over_batches(docs, keep, docs.schema)
