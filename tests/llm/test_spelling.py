"""Spelling variants beside plain counting and plain edit distances."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadframes.llm import spelling
from roadframes.llm.catalog import op13_spelling_variants
from roadframes.llm.textscan import chunks

RUN = re.compile("[A-Za-zÀ-ÿ]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def plain_counts(rows, least_points=5):
    out = Counter()
    for i, t in rows:
        for w in RUN.findall((t or "").translate(ASCII_LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least_points:
                out[w] += 1
    return out


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows, least_points=5, least_n=3):
    n = {w: k for w, k in plain_counts(rows, least_points).items() if k >= least_n}
    by_cut = {}
    for w in n:
        for c in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by_cut.setdefault(c, set()).add(w)
    out, form = {}, {}
    for w in n:
        maybe = set().union(*(by_cut[c] for c in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}))
        near = [v for v in maybe if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(near)
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


ODD_WORDS = [
    (30, "Maße maße MASSE masse Naïve naïve Éclair éclair ×÷×÷× ×÷×÷× ×÷×÷×"), (31, "aaaaaa aaaaaa aaaaaa aaaaa aaaaa aaaaa aaaaaaa " * 3),
    (32, "colour color " * 9 + "colours " * 3), (32, "colour color " * 9 + "colours " * 3), (None, "colour colur colur colur"),
    (33, "y" * 3000 + " " + "y" * 3001 + " " + "y" * 3000), (34, ("y" * 3001 + "—") * 4 + "y" * 3000),
    (35, "chain chains " * 3 + "chainsa " * 12 + "chainsab " * 40 + "chainsabc " * 90)]


@pytest.mark.parametrize("symbols", [2, 16])
def test_like_plain(spark, both, all_texts, symbols):
    more = spark.createDataFrame([(i, t, "x", "y") for i, t in ODD_WORDS], "doc_id long, text string, lang string, source string")
    got = rows_of(spelling.spelling_variants(both.unionByName(more), symbols=symbols))
    assert got == plain(all_texts + ODD_WORDS)
    assert any(r[1] != r[2] for r in got if r[1])


def test_query(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(op13_spelling_variants(spark, "/root/testdata/sf0.001")) == plain(rows)


def test_clashing_columns(spark):
    rows = [(1, "gross gross gross grosz grosz grosz", "a", 1, "b", 2)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n long, near string, key long")
    assert rows_of(spelling.spelling_variants(df)) == plain([r[:2] for r in rows])


def test_empty(none):
    assert spelling.spelling_variants(none).count() == 0


def test_long_text_in_pieces():
    """5 MB in pieces, with one word longer than a piece; the memory of a piece does not grow with the text."""
    text = "Wörter über Wörter, vielé " * 120_000 + "z" * 2_500_000 + " " + "—über " * 300_000
    rows, words = [(7, text)], Counter()
    made = 0
    for chunk in chunks(pa.array([text])):
        for piece in spelling._pieces(chunk, 1 << 20):
            made += 1
            assert len(piece.data) < (4 << 20)
            spelling.count_words(piece, np.array([zlib.crc32(b"7:")], dtype=np.uint32), 5, words)
    assert made > 4
    assert {w.decode(): n for w, n in words.items()} == plain_counts(rows)


@settings(max_examples=300, deadline=None)
@given(a=st.binary(max_size=20), b=st.binary(max_size=spelling.TABLE_BYTES))
def test_joined_checksums(a, b):
    first, second = (np.array([zlib.crc32(x)], dtype=np.uint32) for x in (a, b))
    assert spelling.crc_joined(first, second, np.array([len(b)]))[0] == zlib.crc32(a + b)


@settings(max_examples=300, deadline=None)
@given(words=st.lists(st.text(alphabet="abcdeé", min_size=1, max_size=7), min_size=1, max_size=5), symbols=st.sampled_from([2, 3, 16]))
def test_neighbourhood_is_full_and_without_repeats(words, symbols):
    reduced = spelling.Reduced(words, symbols)
    got = [set() for _ in words]
    for own, keys in reduced.neighbours():
        for w, k in zip(own.tolist(), keys.tolist(), strict=True):
            assert k not in got[w]
            got[w].add(k)
    for w, found in zip(words, got, strict=True):
        s = spelling.symbol_of(np.array([ord(c) for c in w]), symbols).tolist()
        want = {tuple(s)} | {tuple(s[:k] + s[k + 1 :]) for k in range(len(s))}
        want |= {tuple(s[:k] + [t] + s[k + 1 :]) for k in range(len(s)) for t in range(symbols)}
        want |= {tuple(s[:k] + [t] + s[k:]) for k in range(len(s) + 1) for t in range(symbols)}
        key = lambda r: int(spelling.mixed(np.array([sum((x + 1) * pow(spelling.BASE, i, 2**64) for i, x in enumerate(r)) % 2**64], dtype=np.uint64))[0])
        assert found == {key(r) for r in want}
