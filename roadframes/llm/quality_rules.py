"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Each rule looks at the documents that no earlier rule has rejected. A sample of the
documents (``sample_rows``, by a hash of the id) is run through every rule to measure
its cost and the share it rejects; rules then run in the order of rejected documents
per second. The order changes the work, never the verdict: a document is kept if no
rule rejects it.

Null and empty texts have no words, so they fail the base rule. Repeated rows give
repeated rows. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadframes.llm.common import hash_sample, over_batches, texts
from roadframes.llm.textscan import (
    DIGIT, LETTER, MIX_B, NOT_NEWLINE, NOT_SPACE, POINT, U64, UPPER, Chunk, byte_table, chunks, count, mixed)

SYMBOL = byte_table(b"#*$%&|<>")
SHOUT = byte_table(b"!?")
LATIN = byte_table(bytes(range(65, 91)) + bytes(range(97, 123)))


def distinct_per_doc(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each document; keys already mix in the document."""
    _, first = np.unique(key, return_index=True)
    return count(doc[first], n)


def word_counts(chunk: Chunk) -> np.ndarray:
    return count(chunk.runs(NOT_SPACE).doc, chunk.n)


def word_points(chunk: Chunk) -> np.ndarray:
    return chunk.per_doc(chunk.totals(NOT_SPACE & POINT))


def symbols(chunk: Chunk) -> np.ndarray:
    return chunk.per_doc(chunk.totals(SYMBOL))


def worded_lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and how many of them equal an earlier line of their document."""
    lines, inside = chunk.runs(NOT_NEWLINE), chunk.totals(NOT_SPACE)
    has = inside[lines.end] > inside[lines.start]
    start, end, doc = lines.start[has], lines.end[has], lines.doc[has]
    key = mixed(chunk.hasher()(start, end) + doc.astype(U64) * U64(MIX_B))
    total = count(doc, chunk.n)
    return total, total - distinct_per_doc(doc, key, chunk.n)


def repeated_words(chunk: Chunk) -> np.ndarray:
    """Words in windows of three words that the document has twice or more."""
    words = chunk.runs(NOT_SPACE)
    if len(words) < 3:
        return np.zeros(chunk.n, dtype=np.int64)
    h = chunk.hasher()(words.start, words.end)
    same = words.doc[2:] == words.doc[:-2]
    at = np.flatnonzero(same)
    key = mixed(mixed(mixed(h[:-2][at]) + h[1:-1][at]) + h[2:][at] + words.doc[at].astype(U64) * U64(MIX_B))
    order = np.argsort(key)
    key = key[order]
    equal = key[1:] == key[:-1]
    twice = at[order[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]]
    marked = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        marked[twice + shift] = True
    return count(words.doc[marked], chunk.n)


@dataclass(frozen=True)
class Rule:
    """``rejects`` tells which documents of a chunk fail."""

    name: str
    rejects: Callable[[Chunk], np.ndarray]


def few_words(least: int = 50) -> Rule:
    return Rule("few_words", lambda c: word_counts(c) < least)


def much_repetition(percent: int = 50) -> Rule:
    return Rule("much_repetition", lambda c: 100 * repeated_words(c) > percent * word_counts(c))


def many_symbols(percent: int = 10) -> Rule:
    return Rule("many_symbols", lambda c: 100 * symbols(c) > percent * word_counts(c))


def shouting(percent: int = 20) -> Rule:
    return Rule("shouting", lambda c: 100 * c.per_doc(c.totals(SHOUT)) > percent * word_counts(c))


def many_capitals(percent: int = 40) -> Rule:
    return Rule("many_capitals", lambda c: 100 * c.per_doc(c.totals(UPPER)) > percent * c.per_doc(c.totals(LATIN)))


def odd_word_length(least: int = 2, most: int = 16) -> Rule:
    def rejects(c: Chunk) -> np.ndarray:
        n, points = word_counts(c), word_points(c)
        return (points < least * n) | (points > most * n)

    return Rule("odd_word_length", rejects)


def copied_lines(percent: int = 40) -> Rule:
    def rejects(c: Chunk) -> np.ndarray:
        total, again = worded_lines(c)
        return 100 * again > percent * total

    return Rule("copied_lines", rejects)


def few_letters(percent: int = 50) -> Rule:
    return Rule("few_letters", lambda c: 100 * c.per_doc(c.totals(LETTER)) < percent * c.per_doc(c.totals(NOT_SPACE)))


def many_digits(percent: int = 30) -> Rule:
    return Rule("many_digits", lambda c: 100 * c.per_doc(c.totals(DIGIT)) > percent * c.per_doc(c.totals(NOT_SPACE)))


RULES = (few_words(), much_repetition(), many_symbols(), shouting(), many_capitals(), odd_word_length(),
         copied_lines(), few_letters(), many_digits())


def cascade(chunk: Chunk, rules: list[Rule]) -> np.ndarray:
    """Documents that pass every rule; a rule sees only what the earlier ones left."""
    left = np.arange(chunk.n)
    part = chunk
    for rule in rules:
        fails = rule.rejects(part)
        if fails.any():
            left = left[~fails]
            if not len(left):
                break
            part = chunk.take(left)
    kept = np.zeros(chunk.n, dtype=bool)
    kept[left] = True
    return kept


def rule_profile(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """Rule, documents seen, documents rejected and seconds spent on the sample."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen, lost, spent = (np.zeros(len(rules)) for _ in range(3))
        for chunk in chunks(batch.column("text")):
            for k, rule in enumerate(rules):
                began = time.perf_counter()
                lost[k] += rule.rejects(chunk).sum()
                spent[k] += time.perf_counter() - began
                seen[k] += chunk.n
        return pa.RecordBatch.from_pydict({
            "rule": [r.name for r in rules], "seen": seen.astype(np.int64), "rejected": lost.astype(np.int64),
            "seconds": spent})

    sample = hash_sample(texts(docs), ["doc_id", "text"], sample_rows)
    return over_batches(sample, measure, "rule string, seen long, rejected long, seconds double").groupBy("rule").agg(
        F.sum("seen").alias("seen"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))


def by_rejection_per_cost(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> list[Rule]:
    """The rules, those that reject most per second first; unmeasured ones stay behind in their order."""
    worth = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in rule_profile(docs, rules, sample_rows).collect()}
    return sorted(rules, key=lambda r: -worth.get(r.name, 0.0))


COLUMNS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000,
                  least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """The counts of every document, whether it fails the base rules, and the cascade's verdict."""
    ordered = by_rejection_per_cost(docs, rules, sample_rows)

    def verdicts(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for chunk in chunks(batch.column("text")):
            words, again = word_counts(chunk), repeated_words(chunk)
            failed = (words < least_words) | (100 * again > most_repeated * words)
            kept = np.zeros(chunk.n, dtype=bool)
            passed = np.flatnonzero(~failed)
            if len(passed):
                kept[passed] = cascade(chunk.take(passed), ordered)
            parts.append((words, word_points(chunk), symbols(chunk), worded_lines(chunk)[1], again, failed, kept))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(np.concatenate(p)) for p in zip(*parts, strict=True))],
            ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return over_batches(texts(docs), verdicts, COLUMNS)
