"""Token files and packing beside whole-text encoding and plain packing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roadframes.llm import packing, token_files, tokenids
from roadframes.llm.tokenids import Encoder


def whole(kind):
    t = Tokenizer.from_file(public_tokenizers.path({"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}[kind]))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ENCODERS = {k: (Encoder(k), whole(k)) for k in ("word", "byte")}


@pytest.mark.parametrize("kind", ["word", "byte"])
@settings(max_examples=600, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("aAzZéÉßÀµªºÿ0 9  \n\n.,!'s_-|<>\t\r ́İΣς你🙂٣"), max_size=24))
def test_pieces_encode_like_the_whole(kind, text):
    ours, theirs = ENCODERS[kind]
    assert np.frombuffer(ours.encode(text), dtype="<u4").tolist() == theirs(text)


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_small_cache_starts_anew(kind, monkeypatch):
    monkeypatch.setattr(tokenids, "POOL", 40)
    ours, theirs = Encoder(kind), whole(kind)
    texts = [" ".join(f"{a}{b}" for b in ("one", "Two,", "thrée", "J̌k", "x" * 70)) for a in "abcdefgh"] * 3 + ["", None]
    got = [np.frombuffer(x, dtype="<u4").tolist() for t in texts for x in ours.encode_all(pa.array([t], pa.string()))]
    assert got == [theirs(t) for t in texts]


@pytest.fixture(scope="module")
def files(spark, both, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files") / "tokens")
    token_files.write_token_files(both, path, block_tokens=20_000, shard_bytes=300_000)
    return path


def test_token_files(spark, all_texts, files):
    encode, want, start = whole("word"), [], 0
    for i, t in sorted(all_texts, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = encode(t) + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.read_token_files(spark, files).orderBy("start").collect()]
    assert got == want
    assert spark.read.parquet(files).count() > 3


def test_random_access(spark, all_texts, files):
    encode = whole("word")
    texts = defaultdict(list)
    for i, t in all_texts:
        texts[i].append(encode(t) + [2])
    for row in spark.read.parquet(files).limit(3).collect():
        block = row.asDict()
        ids = np.frombuffer(block["doc_ids"], dtype="<i8")
        for at in range(0, len(ids), 7):
            if (texts.get(int(ids[at])) or [[], []])[1:]:
                continue
            want = texts[int(ids[at]) if ids[at] != np.iinfo(np.int64).min else None][0]
            assert token_files.read_document(block, at).tolist() == want
            for place in {0, len(want) // 2, len(want) - 1}:
                assert token_files.token_at(block, at, place) == want[place]


@settings(max_examples=150, deadline=None)
@given(docs=st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=6))
def test_repair_round_trip(docs):
    flat = np.concatenate([np.array([*d, token_files.WALL], dtype=np.uint32) for d in docs])
    rules, symbols = token_files.repair(flat, 10, least=2, per_round=3)
    lengths = token_files.rule_lengths(rules, 10)
    parts = np.split(symbols, np.flatnonzero(symbols == token_files.WALL) + 1)[:-1]
    assert [token_files.expand(p[:-1], rules, lengths, 10).tolist() for p in parts] == docs
    assert len(symbols) <= len(flat)
    for k in range(len(rules)):
        assert len(token_files.expand(np.array([10 + k], dtype=np.uint32), rules, lengths, 10)) == lengths[k]


def test_repair_goes_on_until_no_pair_is_frequent():
    """A run of 2**14 equal pairs needs more rounds than ten."""
    flat = np.append(np.tile(np.array([1, 2], dtype=np.uint32), 1 << 14), token_files.WALL)
    rules, symbols = token_files.repair(flat, 10, least=2)
    assert len(rules) >= 13 and len(symbols) <= 4
    _, n = np.unique(np.stack([symbols[:-1], symbols[1:]]), axis=1, return_counts=True)
    assert n.max() < 2


def test_repair_counts_again_only_where_a_pair_may_be_frequent(monkeypatch):
    """Rounds that replace little look at little: counting all places in every round would be some ten times as many."""
    rng = np.random.default_rng(3)
    rare = rng.permutation(50_000).astype(np.uint32) + 10
    flat = np.concatenate([rare, np.tile(np.array([1, 2], dtype=np.uint32), 1 << 10), [token_files.WALL]]).astype(np.uint32)
    seen, bincount = [], np.bincount

    def counted(x, minlength=0, **options):
        if minlength == 1 << token_files.SLOT_BITS:
            seen.append(len(x))
        return bincount(x, minlength=minlength, **options)

    monkeypatch.setattr(token_files.np, "bincount", counted)
    rules, symbols = token_files.repair(flat, 1 << 17, least=2)
    assert len(rules) >= 9 and len(seen) >= 9
    assert sum(seen) < 2 * len(flat)
    lengths = token_files.rule_lengths(rules, 1 << 17)
    assert (token_files.expand(symbols[:-1], rules, lengths, 1 << 17) == flat[:-1]).all()


@settings(max_examples=100, deadline=None)
@given(docs=st.lists(st.lists(st.integers(0, 4), max_size=60), min_size=1, max_size=4))
def test_repair_leaves_no_frequent_pair(docs):
    flat = np.concatenate([np.array([*d, token_files.WALL], dtype=np.uint32) for d in docs])
    _, symbols = token_files.repair(flat, 10, least=3, per_round=2)
    pairs = [p for p in zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True) if int(token_files.WALL) not in p]
    assert all(n < 3 for n in Counter(pairs).values())


@pytest.mark.parametrize("kind", ["word", "byte"])
def test_many_new_words_encode_like_the_whole(kind):
    """More new words than go to the model at once, with letters beyond ASCII, line breaks and tails among them."""
    rng = np.random.default_rng(5)
    letters = list("abcxyzABCXYZàéîõüßÿÀÉÎÕÜÞ×÷µ")
    words = ["".join(rng.choice(letters, rng.integers(1, 9))) + rng.choice(["", "", "", ",", ".)", "1"]) for _ in range(3000)]
    text = "".join(w + rng.choice([" ", " ", "\n"]) for w in words) + "end"
    ours, theirs = Encoder(kind), whole(kind)
    for _ in range(2):
        assert np.frombuffer(ours.encode(text), dtype="<u4").tolist() == theirs(text)


def test_repair_shrinks_repetition():
    rules, symbols = token_files.repair(np.tile(np.arange(64, dtype=np.uint32), 64), 100, least=4)
    assert len(symbols) + 2 * len(rules) < 64 * 64 / 8


def test_empty_tables(spark, none, tmp_path):
    token_files.write_token_files(none, str(tmp_path / "t"))
    assert token_files.read_token_files(spark, str(tmp_path / "t")).count() == 0
    assert packing.best_fit_packing(none).count() == 0


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(both, all_texts, capacity):
    encode, want = whole("byte"), []
    for i, t in all_texts:
        ids = encode(t) + [0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((i, n, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    got = packing.best_fit_packing(both, capacity=capacity, with_ids=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=lambda r: (r[0] is not None, *map(str, r))) == sorted(
        want, key=lambda r: (r[0] is not None, *map(str, r)))
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) == best_fit_decreasing([r["length"] for r in got], capacity)
    assert len(places) <= 1.02 * -(-sum(r["length"] for r in got) // capacity) + 1


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps[gaps.index(min(fits))] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@settings(max_examples=2000, deadline=None)
@example(runs={3: 3, 11: 11, 14: 10, 1: 1, 4: 30})
@given(runs=st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=8))
def test_sweep_is_best_fit_decreasing(runs):
    ranges = packing.sweep(runs, 20)
    assert sum(r[2] for r in ranges.tolist()) == sum(runs.values())
    used = {s for r in ranges.tolist() for s in range(r[3], r[3] + r[2])}
    assert len(used) == best_fit_decreasing([n for n, k in runs.items() for _ in range(k)], 20)
