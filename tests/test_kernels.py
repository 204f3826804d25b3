"""The edge map against a per-pixel version of its definition, and the score fixtures."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadframes.functions import kernels
from roadframes.operators import metrics as mt


def edges_by_definition(img, low, high):
    h, w = len(img), len(img[0])

    def v(r, c):
        return int(img[min(max(r, 0), h - 1)][min(max(c, 0), w - 1)])

    mag, kind = {}, {}
    for r in range(h):
        for c in range(w):
            gx = sum(k * (v(r + d, c + 1) - v(r + d, c - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(k * (v(r + 1, c + d) - v(r - 1, c + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            mag[r, c] = abs(gx) + abs(gy)
            if abs(gy) * 100000 < abs(gx) * 41421:
                kind[r, c] = (0, 1)
            elif abs(gy) * 100000 > abs(gx) * 241421:
                kind[r, c] = (1, 0)
            else:
                kind[r, c] = (1, 1) if gx * gy >= 0 else (1, -1)
    kept = set()
    for (r, c), m in mag.items():
        dr, dc = kind[r, c]
        a, b = mag.get((r - dr, c - dc), 0), mag.get((r + dr, c + dc), 0)
        straight = dr == 0 or dc == 0
        if m > low and m > a and (m >= b if straight else m > b):
            kept.add((r, c))
    found = {p for p in kept if mag[p] > high}
    todo = list(found)
    while todo:
        r, c = todo.pop()
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                p = (r + dr, c + dc)
                if p in kept and p not in found:
                    found.add(p)
                    todo.append(p)
    return found


@settings(max_examples=40, deadline=None)
@given(
    h=st.integers(1, 9), w=st.integers(1, 9), seed=st.integers(0, 9999), low=st.integers(0, 300),
    smooth=st.booleans())
def test_edge_map_is_the_definition(h, w, seed, low, smooth):
    rng = np.random.default_rng(seed)
    stack = rng.integers(0, 256, (3, h, w))
    if smooth:
        stack = stack // 64 * 64
    got = kernels.edge_map(stack, low, 2 * low)
    for img, edges in zip(stack, got):
        assert {tuple(map(int, p)) for p in np.argwhere(edges)} == edges_by_definition(img, low, 2 * low)


def test_growth_does_not_reach_the_next_frame():
    one = np.zeros((1, 8, 8), dtype=int)
    one[0, :, 4:] = 255
    stack = np.concatenate([one, np.full((1, 8, 8), 77), one])
    counts = kernels.edge_map(stack, 50, 100).sum(axis=(1, 2))
    assert counts.tolist() == [8, 0, 8]


def test_resize_keeps_constants_and_size():
    out = kernels.resize(np.full((2, 5, 7, 3), 9.0), 4, 6)
    assert out.shape == (2, 4, 6, 3) and np.allclose(out, 9.0)
    same = np.random.default_rng(0).random((1, 5, 7, 1))
    assert np.allclose(kernels.resize(same, 5, 7), same)


HALVES = [0, 0, 0, 0, 255, 255, 255, 255] * 8


def score(df, **options):
    return [r.asDict() for r in mt.analyze(df, by_channel=True, **options).orderBy("frame_id").collect()]


def test_fixture_scores(frames):
    rows = score(frames(
        ([128] * 64, 8, 8, 1, "HWC"),
        (HALVES, 8, 8, 1, "HWC"),
        ([v / 255 for v in HALVES], 8, 8, 1, "HWC"),
        ([v / 255 / 255 for v in HALVES], 8, 8, 1, "HWC")))
    flat, halves, unit, dark = rows
    assert flat["valid"] and flat["edge_density"] == 0 and flat["congestion"] == 0 and flat["traffic_level"] == 0
    assert halves["edge_px"] == 8 and halves["density"] == 0.25 and halves["congestion"] == 1.0
    assert halves["traffic_level"] == 4 and halves["flow_rate"] == halves["edge_density"]
    assert unit["density"] == halves["density"] and unit["traffic_level"] == 4
    assert dark["px_sum"] == 32, "1/255 is stretched to 1"


def test_nearly_black_bytes_are_stretched(frames):
    (row,) = score(frames(([0, 1] * 32, 8, 8, 1, "HWC")))
    assert row["px_sum"] == 32 * 255


def test_unusable_frames_are_kept_with_a_reason(frames):
    bad = [
        (None, 8, 8, 1, "HWC"), ([], 0, 0, 1, "HWC"), ([float("nan")] + [1] * 63, 8, 8, 1, "HWC"),
        ([None] + [1] * 63, 8, 8, 1, "HWC"), ([1] * 63, 8, 8, 1, "HWC"), ([1] * 64, 8, 8, None, None),
        ([1] * 128, 8, 8, 2, "HWC")]
    rows = score(frames(*bad, (HALVES, 8, 8, 1, "HWC")))
    for row in rows[:-1]:
        assert row["valid"] is False and row["reason"] == "Failed to process image"
        assert row["density"] == row["congestion"] == row["traffic_score"] == 0 and row["traffic_level"] == 0
    assert rows[-1]["valid"] and rows[-1]["reason"] is None


def test_layouts_agree_and_missing_layout_is_guessed(frames):
    rng = np.random.default_rng(1)
    hwc = rng.integers(0, 256, (6, 5, 3))
    chw = hwc.transpose(2, 0, 1)
    a, b, c, d = score(frames(
        (hwc.ravel(), 6, 5, 3, "HWC"), (chw.ravel(), 6, 5, 3, "CHW"), (chw.ravel(), 6, 5, 3, None),
        (rng.integers(0, 256, 27), 3, 3, 3, None)))
    keys = ("edge_px", "px_sum", "px_sumsq", "r_sum", "g_sum", "b_sum", "traffic_score")
    assert [a[k] for k in keys] == [b[k] for k in keys] == [c[k] for k in keys]
    assert d["valid"]


def test_alpha_is_ignored(frames):
    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 256, (4, 4, 3))
    rgba = np.concatenate([rgb, rng.integers(0, 256, (4, 4, 1))], axis=2)
    a, b = score(frames((rgb.ravel(), 4, 4, 3, "HWC"), (rgba.ravel(), 4, 4, 4, "HWC")))
    assert a["px_sum"] == b["px_sum"] and a["edge_px"] == b["edge_px"] and a["b_sum"] == b["b_sum"]


def test_overflow_policies_differ_on_negatives(frames):
    df = frames(([-0.5, 0.5] * 32, 8, 8, 1, "HWC"))
    (clamped,), (wrapped,) = score(df), score(df, overflow="wrap")
    assert clamped["px_sum"] == 32 * 127
    assert wrapped["px_sum"] == 32 * (127 + 129)


def test_turning_a_frame_keeps_its_spread(frames):
    px = list(np.random.default_rng(3).integers(0, 256, 64))
    a, b = score(frames((px, 8, 8, 1, "HWC"), (px[::-1], 8, 8, 1, "HWC")))
    assert a["congestion"] == b["congestion"]


def test_one_batch_of_many_shapes(frames):
    rng = np.random.default_rng(4)
    shapes = [(4, 5, 1), (8, 8, 3), (4, 5, 1), (2, 9, 4), (8, 8, 3)]
    data = [rng.integers(0, 256, h * w * c) for h, w, c in shapes]
    together = score(frames(*[(d, *s, "HWC") for d, s in zip(data, shapes)]))
    for i, (d, s) in enumerate(zip(data, shapes)):
        (alone,) = score(frames((d, *s, "HWC")))
        for key in ("edge_px", "px_sum", "px_sumsq", "g_sum", "r_sumsq"):
            assert alone[key] == together[i][key]


def test_large_frames_are_worked_on_in_parts(frames, monkeypatch):
    monkeypatch.setattr(kernels, "PIXELS_PER_STACK", 100)
    rng = np.random.default_rng(5)
    data = [(rng.integers(0, 256, 64), 8, 8, 1, "HWC") for _ in range(5)]
    got = score(frames(*data))
    monkeypatch.undo()
    assert [r["edge_px"] for r in got] == [r["edge_px"] for r in score(frames(*data))]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_partitions_do_not_matter(frames, parts):
    rng = np.random.default_rng(6)
    df = frames(*[(rng.integers(0, 256, 64), 8, 8, 1, "HWC") for _ in range(40)])
    whole = mt.analyze(df).groupBy("traffic_level").count()
    cut = mt.analyze(df.repartition(parts)).groupBy("traffic_level").count()
    assert sorted(whole.collect()) == sorted(cut.collect())
