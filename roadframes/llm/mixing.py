"""Mixing by soft membership: document rates whose expected domain tokens match targets.

A softmax classifier over hashed words, fitted on a bounded sample of the labelled
table, predicts for every document the probabilities p of its domains. With w the
document's share of all tokens, rates r >= 0 are sought that minimise
sum over domains of (sum over documents of r w p - target)**2, starting from rate 1.

The rates come from accelerated projected gradient steps. A step needs the domains'
totals only, so each pass over the documents sums r w p in Spark, and the few totals go
into the next step. A rate is a function of the document's probabilities and of the
totals so far, so tasks replay the steps and no state is kept between passes; a lost
executor costs its tasks alone. Replays make the arithmetic quadratic in the steps: tens of
them on even tables, some hundreds where a domain has a thousandth of the tokens.

Steps end when every domain has its target, or when a bound from below on the sum of squares
shows that no rates do better. If neither comes, the fit raises. Rates have no upper bound
unless the caller sets one with ``most``; then steps also end when ``STILL`` passes have moved
no share by more than ``close``.

A target for a domain without any probability cannot be reached and leaves its gap to the
others' best fit: ``mix`` returns target and reached share of each row's domain, ``Mixture.shares``
those of all, and domains that miss their target are named in a warning. Null and empty texts have no tokens and get the classifier's prior.
Repeated rows are mixed as often as they stand. An empty table gives no rows. Other
columns are read for the labels only.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadframes.llm.common import bounded_batches, hash_sample, one_text, over_batches, texts
from roadframes.llm.textscan import NOT_SPACE, U64, Chunk, chunks
from roadframes.session import materialise

SLOTS = 2048
#: Residuals of the domains' totals, and whether the step starts anew from the rates.
Step = tuple[np.ndarray, bool]
#: A warning names domains that miss their target share by more than this.
MISSED = 1e-3
#: Passes over which shares must not move where the caller has set a bound.
STILL = 50


def hashed_words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Words of each document, and the square roots of the shares of hashed words."""
    words = chunk.runs(NOT_SPACE)
    slot = (chunk.hasher(fold=True)(words.start, words.end) % U64(SLOTS)).astype(np.int64)
    n = np.bincount(words.doc, minlength=chunk.n)
    counts = np.bincount(words.doc * SLOTS + slot, minlength=chunk.n * SLOTS).reshape(chunk.n, SLOTS)
    return n, np.sqrt(counts.astype(np.float32) / np.maximum(n, 1)[:, None])


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray  # slots x domains
    prior: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.prior
        if not len(self.domains):
            return z
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, labels: DataFrame, domain: str | Column = "lang", sample_docs: int = 2000,
                steps: int = 150) -> DomainModel:
    """A classifier of the labelled documents' domains, from about ``sample_docs`` of them."""
    chosen = labels.where("doc_id is not null").select("doc_id").distinct()
    # broadcast: about sample_docs rows by the bound of the sample
    sample = F.broadcast(hash_sample(chosen, "doc_id", sample_docs))
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"),
                        (F.col(domain) if isinstance(domain, str) else domain).cast("string").alias("domain"))

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.concatenate([hashed_words(c)[1] for c in chunks(batch.column("text"))])
        return pa.RecordBatch.from_arrays(
            [batch.column("domain"), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], ["domain", "x"])

    rows = over_batches(one_text(named.where("domain is not null").join(sample, "doc_id", "leftsemi"), "domains"), vectors,
                        "domain string, x binary").collect()
    rows.sort(key=lambda r: bytes(r["x"]))
    domains = sorted({r["domain"] for r in rows})
    if not rows:
        return DomainModel([], np.zeros((SLOTS, 0), dtype=np.float32), np.zeros(0, dtype=np.float32))
    x = np.stack([np.frombuffer(r["x"], dtype=np.float16) for r in rows]).astype(np.float32)
    y = np.eye(len(domains), dtype=np.float32)[[domains.index(r["domain"]) for r in rows]]
    model = DomainModel(domains, np.zeros((SLOTS, len(domains)), dtype=np.float32), np.log(y.mean(axis=0)))
    for _ in range(steps):
        diff = (y - model.posteriors(x)) / len(x)
        model.weights += 20 * (x.T @ diff) - 1e-4 * model.weights
        model.prior += diff.sum(axis=0)
    return model


def memberships(docs: DataFrame, model: DomainModel) -> DataFrame:
    """``doc_id, n_tokens, p``: words and domain probabilities of every document."""

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, p = [], []
        for chunk in chunks(batch.column("text")):
            n, x = hashed_words(chunk)
            sizes.append(n)
            p.append(model.posteriors(x))
        flat = np.concatenate(p).astype(np.float64)
        k = len(model.domains)
        lists = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * k, pa.array(flat.ravel()))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.concatenate(sizes).astype(np.int64)), lists], ["doc_id", "n_tokens", "p"])

    return over_batches(texts(docs), predict, "doc_id long, n_tokens long, p array<double>")


def replay(p: np.ndarray, history: list[Step], rate: float, most: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the given steps, and the point at which the next one is taken.

    Accelerated: each step starts from a point a little beyond the last two rates, but for
    a fresh one, which starts from the rates themselves."""
    r = point = np.ones(len(p))
    weight = 1.0
    for residual, fresh in history:
        if fresh:
            point, weight = r, 1.0
        new = np.clip(point - rate * (p @ residual), 0.0, most)
        ahead = (1 + np.sqrt(1 + 4 * weight * weight)) / 2
        point = new + (weight - 1) / ahead * (new - r)
        r, weight = new, ahead
    return r, point


@dataclass
class Mixture:
    """The steps, step size, and the totals reached beside the targets."""

    history: list[Step]
    rate: float
    reached: np.ndarray
    target: np.ndarray

    def shares(self, domains: list[str]) -> dict[str, tuple[float, float]]:
        """Target and reached share of each domain."""
        return {d: (float(t), float(r)) for d, t, r in zip(domains, self.target, self.reached, strict=True)}


def _p(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("p").flatten().to_numpy().reshape(batch.num_rows, k)


def _above_least(residual: np.ndarray, target: np.ndarray, lowest: float, below: float, most: float | None) -> float:
    """How far half the sum of squares is above its least value, at most: the gap to the dual problem.

    ``lowest`` is the smallest product of a document's probabilities with the residual, ``below`` the
    weighed sum of the negative ones. Probabilities sum to 1, so a shift makes all products positive."""
    dual = residual + max(-lowest, 0.0) if most is None else residual
    bound = -(dual @ dual) / 2 - dual @ target
    if most is not None:
        bound += most * below
    return float(residual @ residual / 2 - bound)


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], most: float | None = None,
              steps: int = 2000, close: float = 1e-4, settled: float = 1e-6) -> Mixture:
    """Steps until every domain is within ``close`` of its target share, or half the sum of squares
    within ``settled`` of the least that any rates give; an error after ``steps`` of them."""
    k = len(domains)
    target = np.array([targets.get(d, 0.0) for d in domains], dtype=np.float64)
    target = target / target.sum() if target.sum() else target

    def totals(fn, size: int) -> tuple[np.ndarray, float]:
        """Sums over all documents, and the minimum of the value after the last sum."""
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            p, n = _p(batch, k), batch.column("n_tokens").to_numpy().astype(np.float64)
            v = fn(p, n)
            return pa.RecordBatch.from_pydict({"at": np.arange(len(v), dtype=np.int32), "value": v})

        parts = over_batches(members, run, "at int, value double").groupBy("at").agg(
            F.sum("value").alias("value"), F.min("value").alias("least"))
        out, least = np.zeros(size), 0.0
        for row in parts.collect():
            if row["at"] < size:
                out[row["at"]] = row["value"]
            else:
                least = row["least"]
        return out, least

    def moments(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.append(((p * n[:, None]).T @ p).ravel(), n.sum())

    first, _ = totals(moments, k * k + 1)
    if not k or not first[-1]:
        return Mixture([], 1.0, np.zeros(k), target)
    every = first[-1]
    rate = 1 / max(float(np.linalg.eigvalsh(first[:-1].reshape(k, k) / every).max()), 1e-12)
    history: list[Step] = []
    path: list[np.ndarray] = []
    last: np.ndarray | None = None  # residual of the rates one pass before
    while True:
        def weighed(p: np.ndarray, n: np.ndarray, history=tuple(history), last=last) -> np.ndarray:
            r, point = replay(p, list(history), rate, most)
            along = (p @ last)[n > 0] if last is not None else np.zeros(0)
            below = (n[n > 0] * np.minimum(along, 0)).sum() if len(along) else 0.0
            return np.concatenate([(r * n) @ p, (point * n) @ p, [below, along.min(initial=np.inf)]])

        both, lowest = totals(weighed, 2 * k + 1)
        both /= every
        reached, residual = both[:k], both[:k] - target
        if np.abs(residual).max() <= close:
            return Mixture(history, rate, reached, target)
        fresh = False
        if last is not None:
            # the bound is known for the rates of the last pass; rates that are as good or better share it
            worse = float(residual @ residual - last @ last) / 2
            if _above_least(last, target, lowest, both[2 * k], most) + worse <= settled:
                return Mixture(history, rate, reached, target)
            fresh = worse > 0  # the lead went too far
        # many rates at a bound make steps short: there, shares that hardly move have settled too
        path.append(reached)
        if most is not None and len(path) > STILL and np.ptp(path[-STILL:], axis=0).max() <= close:
            return Mixture(history, rate, reached, target)
        if len(history) >= steps:
            raise RuntimeError(f"rates have not settled after {steps} steps: target and reached shares "
                               f"{Mixture(history, rate, reached, target).shares(domains)}")
        history.append((residual if fresh else both[k : 2 * k] - target, fresh))
        last = residual


@dataclass
class Mixer:
    """A fitted classifier with the steps that give every document its rate."""

    model: DomainModel
    mixture: Mixture
    most: float | None

    def rates(self, p: np.ndarray) -> np.ndarray:
        return replay(p, self.mixture.history, self.mixture.rate, self.most)[0]


def fit_mixer(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str | Column = "lang",
              most: float | None = None, **fit) -> tuple[Mixer, DataFrame]:
    """The mixer, and the documents' memberships in the shared folder."""
    model = fit_domains(docs, labels, domain)
    members = materialise(memberships(docs, model), "memberships")
    mixture = fit_rates(members, model.domains, targets, most, **fit)
    if mixture.reached.any():
        shares = {d: (t, 0.0) for d, t in targets.items() if t} | mixture.shares(model.domains)
        missed = {d: s for d, s in shares.items() if abs(s[0] - s[1]) > MISSED}
        if missed:
            warnings.warn(f"domains miss their target shares (target, reached): {missed}", stacklevel=3)
    return Mixer(model, mixture, most), members


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str | Column = "lang",
        most: float | None = None, **fit) -> DataFrame:
    """``doc_id, n_tokens, domain, rate, target, reached, copies`` for every row; domain is the likeliest one,
    and has ``target`` and ``reached`` as its share of tokens asked for and expected.

    ``copies`` rounds the rate up or down by a hash of the id, so that its mean is the rate."""
    mixer, members = fit_mixer(docs, labels, targets, domain, most, **fit)
    domains = mixer.model.domains

    def rates(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = _p(batch, len(domains))
        at = p.argmax(axis=1) if domains else None
        own = [pa.array(v, pa.float64()).take(pa.array(at)) if domains else pa.nulls(len(p), pa.float64())
               for v in (mixer.mixture.target, mixer.mixture.reached)]
        name = [domains[i] for i in at] if domains else [None] * len(p)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_tokens"), pa.array(name, pa.string()), pa.array(mixer.rates(p)), *own],
            ["doc_id", "n_tokens", "domain", "rate", "target", "reached"])

    out = over_batches(members, rates,
                       "doc_id long, n_tokens long, domain string, rate double, target double, reached double")
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def draw(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str | Column = "lang",
         most: float | None = None, **fit) -> DataFrame:
    """The rows of ``docs``, each as often as ``copies`` of its rate says."""
    mixer, _ = fit_mixer(docs, labels, targets, domain, most, **fit)

    @F.pandas_udf("double")
    def rate(text: pd.Series) -> pd.Series:
        parts = [mixer.rates(mixer.model.posteriors(hashed_words(c)[1])) for c in chunks(pa.array(text, pa.string()))]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    bounded_batches(docs.sparkSession)
    often = copies(F.col("__rate"), docs["doc_id"])
    drawn = docs.withColumn("__rate", rate("text")).withColumn("__copies", often).where("__copies > 0")
    return drawn.withColumn("__copies", F.explode(F.sequence(F.lit(1), "__copies"))).select(docs.columns)


def copies(rate: Column, doc_id: Column) -> Column:
    part = F.pmod(F.xxhash64(F.lit("copies"), doc_id), F.lit(2**31)) / F.lit(float(2**31))
    return (F.floor(rate) + (part < rate - F.floor(rate)).cast("int")).cast("int")
