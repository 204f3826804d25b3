"""Toxicity by a weighted finite-state grammar over the words of a clause.

A clause (between line ends and the marks . ! ? ; :) is read as a string of word
classes: INSULT and THREAT lexemes with weights, MODAL, TARGET, NEGATION, REPORT, and
OTHER. Transducers for insult, threat, target, negation and reported speech are small
state machines that emit weights; they are composed into one product machine, whose
path weight is the clause's score. A lexeme alone gives its weight; near a target, read
before or after it, it weighs more; negated or reported it weighs less; a threat needs a modal or a target for
its full weight. Clauses without a lexeme emit nothing and are not run.

Lexemes are learnt: words and word beginnings (4 to 7 bytes) whose document frequency
among toxic rows of a bounded sample of labelled rows is far above that among the
others. The weight of a lexeme is the log-odds ratio. Lists of function words are
fixed. A document's clause scores (largest, and the number of matched clauses) pass a
logistic curve fitted on the same rows.

Null and empty texts have no clause and get the score of a text without a match. Repeated
rows give repeated rows; an empty table gives no rows; without labels no lexeme is
known. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadframes.llm.common import hash_sample, one_text, over_batches, texts
from roadframes.llm.crf import platt
from roadframes.llm.textscan import LETTER, MIX_B, U64, Chunk, HashIndex, Runs, byte_table, chunks, mixed, text_hash

OTHER, INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT = range(7)
STOP = byte_table(b".!?;:\n")
#: Lengths in bytes of the word beginnings that may become lexemes; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6, 7)

# Function words of the four languages.
WORDS = {
    TARGET: "you your yours he she they them him her people du dich dir sie ihr euch tu te toi vous ils elles tú "
            "usted ustedes ellos ellas vosotros",
    NEGATION: "not no never nobody none cannot without nicht kein keine nie niemals ohne ne pas jamais aucun sans "
              "nunca jamás ningún sin",
    REPORT: "said says say quoted reported according wrote called claims sagte sagt laut dit disait selon écrit dijo "
            "dice según escribió",
    MODAL: "will shall gonna must should werde wird soll muss vais va dois voy debe",
    THREAT: "kill hurt destroy shoot burn töten verletzen tuer brûler matar quemar",
}


@dataclass(frozen=True)
class Transducer:
    """Reads word classes; ``step`` maps (state, class) to (state, factor, bonus): the factor
    multiplies the weight of a lexeme read now, the bonus is added to it (``AIMED``: to the clause). Missing pairs go to ``rest`` of the state with factor 1 and no bonus."""

    step: dict[tuple[int, int], tuple[int, float, float]]
    rest: dict[int, int]


def memory(word: int, span: int, factor: float, bonus: float, on: tuple[int, ...]) -> Transducer:
    """Remembers a class for ``span`` words; a lexeme read meanwhile is weighted."""
    step = {(state, word): (span, 1.0, 0.0) for state in range(span + 1)}
    for state in range(1, span + 1):
        for lexeme in on:
            step[state, lexeme] = (state - 1, factor, bonus)
    return Transducer(step, {s: max(s - 1, 0) for s in range(span + 1)})


def pending(on: tuple[int, ...], span: int, word: int, bonus: float) -> Transducer:
    """Remembers a lexeme for ``span`` words; the first ``word`` read meanwhile gives a bonus."""
    step = {(state, lexeme): (span, 1.0, 0.0) for state in range(span + 1) for lexeme in on}
    step |= {(state, word): (0, 1.0, bonus) for state in range(1, span + 1)}
    return Transducer(step, {s: max(s - 1, 0) for s in range(span + 1)})


GRAMMAR = {
    "insult": Transducer({(0, INSULT): (1, 1.0, 0.0), (1, INSULT): (1, 1.0, 0.5)}, {0: 0, 1: 1}),
    "threat": memory(MODAL, 3, 1.5, 0.0, (THREAT,)),
    "target": memory(TARGET, 4, 1.0, 1.0, (INSULT, THREAT)),
    "negation": memory(NEGATION, 2, 0.5, 0.0, (INSULT, THREAT)),
    "reported": Transducer({(0, REPORT): (1, 1.0, 0.0), (1, INSULT): (1, 0.6, 0.0), (1, THREAT): (1, 0.6, 0.0)},
                           {0: 0, 1: 1}),
}


def compose(machines: list[Transducer]) -> dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], float, float]]:
    """The product machine: states run side by side, factors multiply, bonuses add."""
    out = {}
    for state in product(*(m.rest for m in machines)):
        for word in range(7):
            moves = [m.step.get((s, word), (m.rest[s], 1.0, 0.0)) for m, s in zip(machines, state, strict=True)]
            out[state, word] = (tuple(m[0] for m in moves), float(np.prod([m[1] for m in moves])), sum(m[2] for m in moves))
    return out


AIMED = pending((INSULT, THREAT), 3, TARGET, 1.0)
MACHINE = compose(list(GRAMMAR.values()))
START = tuple(0 for _ in GRAMMAR)


def clause_score(classes: list[int], weights: list[float]) -> float:
    """Weight of the machine's path over one clause."""
    state, total = START, 0.0
    for word, weight in zip(classes, weights, strict=True):
        state, factor, bonus = MACHINE[state, word]
        if word in (INSULT, THREAT):
            total += max(weight * factor + bonus, 0.0)
    return total


def aimed_score(classes: list[int]) -> float:
    """Weight that targets after a lexeme add: the path of ``AIMED`` alone, for it emits on other words than the product."""
    state, total = 0, 0.0
    for word in classes:
        state, _, bonus = AIMED.step.get((state, word), (AIMED.rest[state], 1.0, 0.0))
        total += bonus
    return total


def lexical_hashes(chunk: Chunk) -> tuple[Runs, list[np.ndarray]]:
    """Runs of letters, and the hashes of their beginnings: 0 where a word is shorter than the beginning."""
    words = chunk.runs(LETTER)
    hashes = chunk.hasher(fold=True)
    out = []
    for size in BEGINNINGS:
        end = np.minimum(words.start + size, words.end) if size else words.end
        h = mixed(hashes(words.start, end) + U64(size))
        if size:
            h[words.end - words.start < size] = 0
        out.append(h)
    return words, out


@dataclass
class ToxicModel:
    """Sorted hashes of lexemes with their weights, and the logistic curve."""

    keys: np.ndarray
    weights: np.ndarray
    curve: tuple[float, float]


_KINDS = {text_hash(word): kind for kind, words in WORDS.items() for word in words.split()}
_FIXED = np.array(list(_KINDS), dtype=U64)
_ORDER = np.argsort(mixed(_FIXED))
_FIXED_INDEX, _FIXED_KINDS = HashIndex(mixed(_FIXED)[_ORDER]), np.array(list(_KINDS.values()))[_ORDER]
#: Clause scores level off at this weight: many lexemes in one clause say little more than some.
LEVEL = 20.0


def evidence(chunk: Chunk, lexemes: HashIndex, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest clause score of each document and how many of its clauses matched."""
    words, hashes = lexical_hashes(chunk)
    weight = np.zeros(len(words))
    for h in hashes:
        at = lexemes.places(h)
        hit = at >= 0
        weight[hit] = np.maximum(weight[hit], weights[at[hit]])
    top, matched = np.zeros(chunk.n), np.zeros(chunk.n)
    fixed = _FIXED_INDEX.places(hashes[0])
    kind = np.where(fixed >= 0, _FIXED_KINDS[fixed], OTHER)
    lexeme = np.flatnonzero((weight > 0) | (kind == THREAT))
    if not len(lexeme):
        return top, matched
    stops = chunk.totals(STOP)
    clause = stops[words.start]  # grows at each clause end; a document's end is checked apart
    new = np.concatenate([[True], (clause[1:] != clause[:-1]) | (words.doc[1:] != words.doc[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(words))
    for c in np.unique(np.searchsorted(first, lexeme, "right") - 1):
        own = slice(first[c], last[c])
        classes = np.where(weight[own] > 0, np.where(kind[own] == THREAT, THREAT, INSULT), kind[own])
        threat_alone = np.where((classes == THREAT) & (weight[own] <= 0), 0.5, weight[own])
        score = clause_score(classes.tolist(), threat_alone.tolist()) + aimed_score(classes.tolist())
        d = words.doc[first[c]]
        top[d] = max(top[d], score / (1 + score / LEVEL))
        matched[d] += score > 0
    return top, matched


def _joint(top: np.ndarray, matched: np.ndarray) -> np.ndarray:
    return top + np.log1p(matched)


def labelled(docs: DataFrame, labels: DataFrame, use: Column, sample_docs: int) -> DataFrame:
    chosen = labels.where(use).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("label"))
    # broadcast: about sample_docs rows by the bound of the sample
    return one_text(texts(docs).join(F.broadcast(hash_sample(chosen, "doc_id", sample_docs)), "doc_id"), "labelled")


def learn_lexemes(rows: DataFrame, most: int = 4000, least_odds: float = 2.5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of lexemes: at most ``most``, from document frequencies by label.

    A lexeme's odds must stand out, and its frequencies must be too unlikely for chance: their
    log-likelihood ratio must exceed the logarithm of ten times the number of rows. It must
    also follow different words: what copies of one text share stands in one context only."""

    top, bottom = np.iinfo(np.int64).max, np.iinfo(np.int64).min

    def distinct(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Where each document has each hash first."""
        some = np.flatnonzero(h)
        _, first = np.unique(mixed(h[some] + doc[some].astype(U64) * U64(MIX_B)), return_index=True)
        return some[first]

    def frequencies(batch: pa.RecordBatch) -> pa.RecordBatch:
        label = batch.column("label").to_numpy()
        keys, toxic, before = [], [], []
        for chunk in chunks(batch.column("text")):
            words, hashes = lexical_hashes(chunk)
            context = np.zeros(len(words), dtype=np.int64)
            context[1:] = np.where(words.doc[1:] == words.doc[:-1], hashes[0][:-1].view(np.int64), 0)
            for h in hashes:
                own = distinct(words.doc, h)
                keys.append(h[own])
                toxic.append(label[chunk.first + words.doc[own]])
                before.append(context[own])
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        toxic, before = np.concatenate(toxic), np.concatenate(before)
        bad = np.bincount(at, weights=toxic, minlength=len(key)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(key)))
        low, high = (f.reduceat(np.where(toxic == 1, before, none)[order], first) if len(key) else before
                     for f, none in ((np.minimum, top), (np.maximum, bottom)))
        return pa.RecordBatch.from_pydict({
            "key": key.view(np.int64), "bad": bad, "fine": np.bincount(at, minlength=len(key)).astype(np.int64) - bad,
            "low": low, "high": high})

    sizes = rows.agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("fine")).first()
    if not sizes["bad"]:
        return np.zeros(0, dtype=U64), np.zeros(0)
    odds = (F.log((F.col("bad") + 0.5) / (sizes["bad"] + 1.0)) - F.log((F.col("fine") + 0.5) / ((sizes["fine"] or 0) + 1.0)))
    n = sizes["bad"] + (sizes["fine"] or 0)
    share, both = sizes["bad"] / n, F.col("bad") + F.col("fine")
    surprise = F.col("bad") * F.log(F.col("bad") / (both * share)) + F.when(
        F.col("fine") > 0, F.col("fine") * F.log(F.col("fine") / (both * max(1 - share, 1e-9)))).otherwise(0.0)
    found = over_batches(rows, frequencies, "key long, bad long, fine long, low long, high long").groupBy(
        "key").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = found.where((F.col("bad") > 2) & (F.col("bad") > 2 * F.col("fine")) & (F.col("low") < F.col("high")))
    found = found.withColumn("odds", odds).where((F.col("odds") >= least_odds) & (surprise >= float(np.log(10 * n))))
    best = found.orderBy(F.desc(F.col("odds") * F.log1p("bad")), "key").limit(most).collect()
    key = np.array([r["key"] for r in best], dtype=np.int64).view(U64)
    weight = np.array([r["odds"] for r in best])
    order = np.argsort(key)
    return key[order], weight[order]


def _evidence_rows(rows: DataFrame, keys: np.ndarray, weights: np.ndarray) -> DataFrame:
    index = HashIndex(keys)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [evidence(c, index, weights) for c in chunks(batch.column("text"))]
        return pa.RecordBatch.from_arrays(
            [batch.column("label"), *(pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1))],
            ["label", "top", "matched"])

    return over_batches(rows, run, "label int, top double, matched double")


def fit_toxicity(docs: DataFrame, labels: DataFrame, use: Column, sample_docs: int = 20000) -> ToxicModel:
    """Lexemes and the curve from the labelled rows for which ``use`` holds, about ``sample_docs`` of them."""
    rows = labelled(docs, labels, use, sample_docs)
    keys, weights = learn_lexemes(rows)
    # equal evidence is counted in Spark, so that few rows come back whatever the sample
    seen = _evidence_rows(rows, keys, weights).groupBy(
        "label", F.round(F.col("top") + F.log1p("matched"), 1).alias("x")).count().collect()
    x = np.repeat([r["x"] for r in seen], [r["count"] for r in seen])
    label = np.repeat([r["label"] for r in seen], [r["count"] for r in seen])
    return ToxicModel(keys, weights, platt(x, label) if len(x) else (1.0, -4.0))


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``doc_id, score, clause_score, n_clauses`` for every row."""

    index = HashIndex(model.keys)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [evidence(c, index, model.weights) for c in chunks(batch.column("text"))]
        top, matched = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        x = np.clip(model.curve[0] * _joint(top, matched) + model.curve[1], -30, 30)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-x))), pa.array(top), pa.array(matched.astype(np.int64))],
            ["doc_id", "score", "clause_score", "n_clauses"])

    return over_batches(texts(docs), score, "doc_id long, score double, clause_score double, n_clauses long")
