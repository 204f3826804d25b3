"""Secrets by fixed patterns and by a conditional random field over tokens.

Base patterns are assignments, access keys and long hexadecimal runs. A linear-chain CRF
tags every token (a run without white space) as B, I or O from its shape, its
neighbours and features of the file; Viterbi decodes it, and a span the CRF finds where
no base span lies is added with kind ``crf``. Base spans always stay.

The CRF learns from the base patterns, which serve as labels. Base spans are searched in all
documents; about ``marked_docs`` of those that have one give windows of tokens around them,
and about ``sample_docs`` of the others windows without, both by a hash of the id. So
secrets are learnt however rare they are; without any base span the CRF finds nothing. Shapes are described by shares of signs, so it also finds
secrets of other forms.

Decoding is exact without running the chain over every token: where a token's lead of O
is larger than all that two transitions can change, every best path has O there, and
the path falls into short stretches between such tokens.

Null texts are empty; empty texts have no spans. Repeated rows give repeated rows. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadframes.llm import crf
from roadframes.llm.common import hash_sample, over_batches, spread, texts
from roadframes.llm.textscan import DIGIT, FOLD, LOWER, NOT_SPACE, POINT, U64, UPPER, Chunk, HashIndex, byte_table, chunks, text_hash
from roadframes.session import materialise

ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = byte_table(b"0123456789abcdef")
CLUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "crf")
B, I, O = range(3)  # noqa: E741
ALNUM = DIGIT | LOWER | UPPER
HIGH = byte_table(bytes(range(128, 256)))
SETS = byte_table(b"=:")
# Words that often stand before a secret.
KEYWORDS = "password passwd pwd secret token apikey api_key key bearer auth authorization credential credentials private"
KEY_INDEX = HashIndex(np.array(sorted(text_hash(w) for w in KEYWORDS.split()), dtype=U64))
OWN, FILE = 12, 3
WIDTH = OWN + 6 + FILE


def _places(data: bytes, word: bytes) -> list[int]:
    out, at = [], data.find(word)
    while at >= 0:
        out.append(at)
        at = data.find(word, at + 1)
    return out


def base_spans(chunk: Chunk, points: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """Base spans of each document, by kind: kind, start, end in code points."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(chunk.n)]
    raw, folded = chunk.data.tobytes(), FOLD[chunk.data].tobytes()
    first = points[chunk.offsets[:-1]]

    def suspects(words: tuple[bytes, ...], within: bytes) -> np.ndarray:
        at = [p for w in words for p in _places(within, w)]
        return np.unique(np.searchsorted(chunk.offsets, np.array(at, dtype=np.int64), "right") - 1) if at else np.zeros(0, int)

    def text(d: int) -> str:
        return raw[chunk.offsets[d] : chunk.offsets[d + 1]].decode()

    for d in suspects(CLUES, folded):
        out[d] += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text(d)) if len(m[2]) >= 6]
    for d in suspects((b"AKIA",), raw):
        out[d] += [("access", m.start(), m.end()) for m in ACCESS.finditer(text(d)) if len(m[0]) >= 20]
    runs = chunk.runs(HEX)
    for k in np.flatnonzero(runs.end - runs.start >= 24):
        d = runs.doc[k]
        out[d].append(("hex", int(points[runs.start[k]] - first[d]), int(points[runs.end[k]] - first[d])))
    return out


class Tokens:
    """Tokens of a chunk and their feature arrays."""

    def __init__(self, chunk: Chunk):
        self.chunk, self.runs = chunk, chunk.runs(NOT_SPACE)
        runs, n = self.runs, len(self.runs)
        size = (runs.end - runs.start).astype(np.float32)

        def of(table: np.ndarray) -> np.ndarray:
            total = chunk.totals(table)
            return (total[runs.end] - total[runs.start]).astype(np.float32)

        alnum = ALNUM[chunk.data]
        at = np.arange(len(alnum))
        after = np.minimum.accumulate(np.where(alnum, at, len(alnum))[::-1])[::-1] if n else at
        before = np.maximum.accumulate(np.where(alnum, at, -1)) if n else at
        # the core of a token: from its first letter or digit to its last
        self.start = np.minimum(after[runs.start], runs.end) if n else runs.start
        self.stop = np.maximum(before[runs.end - 1] + 1, self.start) if n else runs.end
        digit, upper, lower, high, sets = of(DIGIT), of(UPPER), of(LOWER), of(HIGH), of(SETS)
        kind = DIGIT[chunk.data].astype(np.int8) + 2 * (LOWER | UPPER)[chunk.data]
        switch = np.zeros(len(kind) + 1, dtype=np.int64)
        if len(kind) > 1:
            np.cumsum((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0), out=switch[1:-1])
        switches = (switch[np.maximum(runs.end - 1, runs.start)] - switch[runs.start]).astype(np.float32)
        own = np.zeros((n, OWN), dtype=np.float32)
        own[:, 0] = 1
        own[:, 1] = np.minimum(np.log2(np.maximum(size, 1)) / 5, 2)
        own[:, 2], own[:, 3], own[:, 4], own[:, 5] = digit / size, upper / size, lower / size, high / size
        own[:, 6] = (size - digit - upper - lower - high) / size
        own[:, 7] = np.minimum(switches / 4, 3)
        mixed_up = (digit >= 3) & (upper + lower >= 3) & (size >= 16)
        own[:, 8] = mixed_up
        own[:, 9] = (size >= 20) & (high == 0)
        h = chunk.hasher(fold=True)(self.start, self.stop)
        own[:, 10] = KEY_INDEX.places(h) >= 0
        own[:, 11] = (sets > 0) & (high == 0)
        x = np.zeros((n, WIDTH), dtype=np.float32)
        x[:, :OWN] = own
        for k, (shift, column) in enumerate(((1, 10), (1, 11), (2, 10), (-1, 11), (-1, 8), (-2, 8))):
            same = self.runs.doc[abs(shift) :] == self.runs.doc[: n - abs(shift)]
            if shift > 0:
                x[shift:, OWN + k][same] = own[: n - shift, column][same]
            else:
                x[:shift, OWN + k][same] = own[-shift:, column][same]
        words = np.maximum(np.bincount(runs.doc, minlength=chunk.n), 1)
        for k, (value, scale) in enumerate(((digit, 5), (own[:, 11], 1), (own[:, 6], 1))):
            share = np.bincount(runs.doc, weights=value, minlength=chunk.n) / words / scale
            x[:, OWN + 6 + k] = np.minimum(share, 1)[runs.doc]
        self.features = x


def decode(tokens: Tokens, chain: crf.Chain) -> list[tuple[int, int, int]]:
    """Spans tagged B or I: document, first token, last token."""
    x, doc = tokens.features, tokens.runs.doc
    if not len(x):
        return []
    scores = chain.scores(x)
    into = np.vstack([chain.moves, chain.first])  # a tag before, or the beginning
    out = np.vstack([chain.moves.T, np.zeros(3)])  # a tag after, or the end
    sure = np.ones(len(x), dtype=bool)
    for tag in (B, I):
        gain = (into[:, tag] - into[:, O]).max() + (out[:, tag] - out[:, O]).max()
        sure &= scores[:, O] - scores[:, tag] > gain
    unsure = np.flatnonzero(~sure)
    if not len(unsure):
        return []
    breaks = np.flatnonzero((np.diff(unsure) != 1) | (np.diff(doc[unsure]) != 0)) + 1
    spans = []
    for part in np.split(unsure, breaks):
        a, b = int(part[0]), int(part[-1])
        before = O if a and doc[a - 1] == doc[a] else None
        after = O if b + 1 < len(doc) and doc[b + 1] == doc[b] else None
        tags = crf.viterbi(chain, scores[a : b + 1].astype(np.float64), before, after)
        open_at = None
        for k, tag in enumerate([*tags, O]):
            if tag != I and open_at is not None:
                spans.append((int(doc[a]), open_at, a + k - 1))
                open_at = None
            if tag == B or tag == I and open_at is None:
                open_at = a + k
    return spans


def _tags(tokens: Tokens, spans: list[list[tuple[str, int, int]]], points: np.ndarray) -> np.ndarray:
    """Tags of all tokens from base spans."""
    chunk, tags = tokens.chunk, np.full(len(tokens.runs), O)
    first = points[chunk.offsets[:-1]]
    start, end = points[tokens.runs.start], points[tokens.runs.end]
    for d in (d for d in range(chunk.n) if spans[d]):
        a, b = np.searchsorted(tokens.runs.doc, [d, d + 1])
        for _, s, e in sorted(spans[d], key=lambda v: (v[1], -v[2])):
            inside = np.flatnonzero((start[a:b] - first[d] < e) & (end[a:b] - first[d] > s)) + a
            if len(inside) and (tags[inside] == O).all():
                tags[inside], tags[inside[0]] = I, B
    return tags


def marked_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key`` of the rows of ``docs`` that have a base span."""

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        has = [bool(s) for c in chunks(batch.column("text")) for s in base_spans(c, c.totals(POINT))]
        return batch.select(["doc_id", "text_key"]).filter(pa.array(has, pa.bool_()))

    return over_batches(texts(docs).withColumn("text_key", F.xxhash64("text")), mark, "doc_id long, text_key long")


def strata(docs: DataFrame, sample_docs: int, marked_docs: int) -> DataFrame:
    """``doc_id, text, marked``: about ``marked_docs`` rows with a base span, and a uniform sample with about
    ``sample_docs`` rows without; its rows with one are not to be used."""
    marked, every = materialise(marked_rows(docs), "marked"), texts(docs)
    n, m = every.count(), marked.count()
    uniform = hash_sample(every, ["doc_id", "text"], -(-sample_docs * n // max(n - m, 1)))
    # broadcast: about marked_docs rows by the bound of the sample
    few = F.broadcast(hash_sample(marked, ["doc_id", "text_key"], marked_docs).toDF("id", "key"))
    same = every["doc_id"].eqNullSafe(few["id"]) & (F.xxhash64(every["text"]) == few["key"])
    again = every.join(few, same, "leftsemi").dropDuplicates(["doc_id", "text"])
    return spread(again.withColumn("marked", F.lit(True)).unionByName(uniform.withColumn("marked", F.lit(False))), "strata")


def fit_secrets(docs: DataFrame, sample_docs: int = 3000, around: int = 12, most_windows: int = 20,
                marked_docs: int = 300) -> crf.Chain:
    """A chain from windows of a bounded sample: one window without a secret from each of about ``sample_docs``
    documents without a base span, and that and up to ``most_windows`` with one from each of about
    ``marked_docs`` documents with one."""
    rows = strata(docs, sample_docs, marked_docs)

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = [], []
        wanted = np.array(batch.column("marked").to_pylist(), dtype=bool)
        for chunk in chunks(batch.column("text")):
            points, tokens = chunk.totals(POINT), Tokens(chunk)
            spans = base_spans(chunk, points)
            tags = _tags(tokens, spans, points)
            # documents of this row's stratum
            own_kind = np.array([bool(s) for s in spans]) == wanted[chunk.first : chunk.first + chunk.n]
            marked = np.flatnonzero(tags == B)
            nth = np.arange(len(marked)) - np.searchsorted(tokens.runs.doc[marked], tokens.runs.doc[marked])
            marked = marked[nth < most_windows]
            # one window without a secret for each document, where its shapes are least like words
            odd = np.lexsort((-tokens.features[:, 7] - tokens.features[:, 2], tokens.runs.doc))
            lead = odd[np.unique(tokens.runs.doc[odd], return_index=True)[1]] if len(odd) else odd
            chosen = np.concatenate([marked, lead[tags[lead] == O]]).astype(np.int64)
            for c in chosen[own_kind[tokens.runs.doc[chosen]]].tolist():
                a, b = np.searchsorted(tokens.runs.doc, [tokens.runs.doc[c], tokens.runs.doc[c] + 1])
                own = slice(max(a, c - around), min(b, c + around + 1))
                x.append(tokens.features[own].tobytes())
                y.append(tags[own].astype(np.int8).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["x", "y"])

    got = over_batches(rows, windows, "x binary, y binary").collect()
    got.sort(key=lambda r: bytes(r["x"]))
    x = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, WIDTH).astype(np.float64) for r in got]
    y = [np.frombuffer(r["y"], dtype=np.int8).astype(np.int64) for r in got]
    if not any((t == B).any() for t in y):
        return crf.Chain(np.eye(1, 3, O) * 10 * np.eye(WIDTH, 1), np.zeros((3, 3)), np.zeros(3))  # O everywhere
    return crf.fit(x, y, 3, steps=100, window=2 * around + 1)


def _all_spans(chunk: Chunk, chain: crf.Chain) -> list[list[tuple[str, int, int]]]:
    points, tokens = chunk.totals(POINT), Tokens(chunk)
    spans = base_spans(chunk, points)
    first = points[chunk.offsets[:-1]]
    for d, a, b in decode(tokens, chain):
        s, e = int(points[tokens.start[a]] - first[d]), int(points[tokens.stop[b]] - first[d])
        if e > s and not any(s < y and x < e for _, x, y in spans[d]):
            spans[d].append(("crf", s, e))
    for own in spans:
        own.sort(key=lambda v: (v[1], KINDS.index(v[0])))
    return spans


SPANS = "array<struct<kind:string,start:int,stop:int>>"


def find_secrets(docs: DataFrame, chain: crf.Chain) -> DataFrame:
    """``doc_id, spans``: kind, start, stop in code points, end exclusive, by start and kind."""

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [s for c in chunks(batch.column("text")) for s in _all_spans(c, chain)]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
        spans = pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in s] for s in found], pa.list_(kind))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], ["doc_id", "spans"])

    return over_batches(texts(docs), find, f"doc_id long, spans {SPANS}")


def redact_secrets(docs: DataFrame, chain: crf.Chain, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every span of ``text`` masked; ``n_chars``, if it is there, counts the new text."""
    schema = docs.schema

    def masked(batch: pa.RecordBatch) -> pa.RecordBatch:
        old, at = batch.column("text"), batch.schema.get_field_index("text")
        new = old.to_pylist()
        for chunk in chunks(old):
            for d, spans in enumerate(_all_spans(chunk, chain), chunk.first):
                out, end = [], 0
                for _, a, b in spans:
                    if b > end:
                        out += [new[d][end : max(a, end)], mask] if a >= end else []
                        end = b
                if spans:
                    new[d] = "".join(out) + new[d][end:]
        batch = batch.set_column(at, batch.schema.field(at), pa.array(new, old.type))
        place = batch.schema.get_field_index("n_chars")
        if place >= 0:
            size = pa.array([None if t is None else len(t) for t in new]).cast(batch.schema.field(place).type)
            batch = batch.set_column(place, batch.schema.field(place), size)
        return batch

    return over_batches(docs, masked, schema)
