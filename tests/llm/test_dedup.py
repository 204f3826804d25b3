"""Near-duplicates beside brute force."""

import random
import re

import numpy as np
import pytest

from roadframes.llm import embedding_dedup, minhash_dedup
from roadframes.llm.components import components


def smallest_reachable(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)]
    links += [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    links = [(a, b) for a, b in links if a != b]
    want = smallest_reachable({n for pair in links for n in pair}, links)
    assert got == want


def test_no_links(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if len(words) >= 5 else frozenset([tuple(words)])


def brute(texts, percent):
    own = {i: sets(t) for i, t in texts}
    ids = sorted(i for i in own if own[i])
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(own[a]), len(own[b])))
            if 100 * small >= percent * large:
                n = len(own[a] & own[b])
                if 100 * n >= percent * (len(own[a]) + len(own[b]) - n):
                    links.append((a, b))
    label = smallest_reachable(own, links)
    return {i: (len(own[i]), label[i]) for i in own}


def near_copies(n, seed):
    """A family of copies with a few changed words each, and chains of copies of copies."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    out, chain = [], list(base)
    for i in range(n):
        own = list(base if i % 2 else chain)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        if not i % 2:
            chain = own
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash(spark, docs, percent):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    texts += [(10_000 + i, t) for i, t in enumerate(near_copies(150, 1) + near_copies(60, 2))]
    texts += [(20_000, None), (20_001, ""), (20_002, "A b"), (20_003, "a B"), (20_004, "a b c"), (20_005, "z " * 3000)]
    random.Random(3).shuffle(texts)
    df = spark.createDataFrame([(i, t, i, "n") for i, t in texts], "doc_id long, text string, node long, digest string")
    got = {r["doc_id"]: r for r in minhash_dedup.minhash_dedup(df, percent=percent).collect()}
    want = brute(texts, percent)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_tiles_of_open_buckets(spark, monkeypatch):
    """Small tiles: many pairs of tiles, the same result."""
    monkeypatch.setattr(minhash_dedup._tiled, "__defaults__", (16,))
    texts = list(enumerate(near_copies(200, 4)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.minhash_dedup(df, percent=85).collect()}
    assert got == brute(texts, 85)


def test_minhash_odd_rows(odd, none):
    got = minhash_dedup.minhash_dedup(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[4]) == 2 and all(r["component_id"] == 4 for r in by[4])
    assert by[22][0]["component_id"] == 22 and by[23][0]["component_id"] == 22
    assert by[1][0]["n_shingles"] == 0 and by[1][0]["component_id"] == 1 and not by[None][0]["kept"]
    assert minhash_dedup.minhash_dedup(none).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[0] + 0.12 * rng.normal(size=(60, 16)) * np.abs(x[0]).mean()
    x[200:210] = x[5] * 3.0
    rows = [(i, [float(v) for v in x[i]], 1, "k") for i in range(300)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [float("inf")] + [1.0] * 15), (1004, []),
           (1005, [None] + [1.0] * 15), (1006, [1.0] * 8), (1007, [2.0] * 8), (0, rows[0][1]), (None, rows[7][1])]
    df = spark.createDataFrame(rows + [(i, v, 2, "k") for i, v in odd], "vec_id long, embedding array<double>, n long, key string")
    got = embedding_dedup.embedding_dedup(df, 0.95, tile=37).collect()
    assert len(got) == 310
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    links = {i: int(near[i].sum()) - 1 for i in range(300)}
    label = smallest_reachable(range(300), list(zip(*np.nonzero(near), strict=True)))
    twice = {i for i in range(300) if near[0][i]}
    for r in got:
        i = r["vec_id"]
        if i is not None and i < 300:
            extra = (i in twice) + bool(near[7][i])
            assert r["n_links"] == links[i] + extra and r["component_id"] == label[i]
        elif i in (1006, 1007):
            assert r["n_links"] == 1 and r["component_id"] == 1006
        elif i is not None:
            assert r["n_links"] == 0 and r["component_id"] == i and r["kept"]
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_bound_holds():
    rng = np.random.default_rng(2)
    a, b = (embedding_dedup.Quantised(rng.normal(size=(200, 32)) ** 3) for _ in range(2))
    product = (a.codes.astype(float) @ b.codes.T.astype(float)) * a.scale[:, None] * b.scale
    bound = (a.norm + a.error)[:, None] * b.error + a.error[:, None] * b.norm
    assert (np.abs(a.unit @ b.unit.T - product) <= bound + 1e-12).all()


def test_texts_of_one_id(spark):
    """An id on several rows: each of its texts is linked by its own set, and none unlike all others is lost."""
    import corpus_pipeline

    words = lambda c, n=60: [f"{c}{k}" for k in range(n)]
    near = lambda c: " ".join([*words(c, 59), "other"])
    whole = {c: " ".join(words(c)) for c in "abcd"}
    rows = [(1, whole["a"]), (2, near("a")), (2, whole["b"]), (3, near("b")), (4, whole["c"]), (4, near("c")),
            (5, whole["d"]), (5, whole["d"]), (6, ""), (6, near("d")), (None, whole["a"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    for c in "abcd":  # one text of each family
        assert sum(i is not None and t.startswith(f"{c}0 ") for i, t in left) == 1, c
    assert (6, "") in left and (None, whole["a"]) in left and len(left) == 6
    assert (1, whole["a"]) in left and (5, whole["d"]) in left
    got = minhash_dedup.minhash_dedup(df, percent=80)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == len(rows)


@pytest.mark.parametrize("first", ["a", "b"])
def test_component_has_the_smallest_id_in_it(spark, first):
    """An id on rows with different texts names the components of each of them, whichever text comes first."""
    second = "b" if first == "a" else "a"
    words = lambda c, last=None: " ".join([f"{c}{k}" for k in range(60)] + [last or f"{c}60"])
    rows = [(5, words(first)), (5, words(second)), (11, words("b", "other")), (7, words("a", "else")), (3, words("c")), (9, words("c")),
            (3, words("d")), (4, words("d", "one")), (2, words("d", "two"))]
    got = minhash_dedup.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got)
    assert found == sorted([(5, 5, True), (5, 5, True), (11, 5, False), (7, 5, False), (3, 3, True), (9, 3, False),
                            (3, 2, False), (4, 2, False), (2, 2, True)])
