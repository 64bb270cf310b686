import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.operators import blake3, kernels


def grid(w, h, f):
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    return (f(x, y) % 256).astype(np.uint8)


def test_phash_golden():
    assert kernels.phash(grid(32, 32, lambda x, y: 7 * x + 11 * y)) == "7987c03a8fff3bff"


def test_ssim_golden():
    left = grid(17, 13, lambda x, y: 17 * x + 29 * y + (x * y) % 31)
    right = grid(17, 13, lambda x, y: 11 * x + 37 * y + ((x + 3) * (y + 5)) % 43)
    assert abs(kernels.ssim(left, right) - 0.383446772514431) < 1e-12


def test_ssim_extremes():
    gray = np.full((16, 16), 127, np.uint8)
    assert abs(kernels.ssim(gray, gray) - 1) < 1e-12
    c1 = (0.01 * 255) ** 2
    assert abs(kernels.ssim(np.zeros((16, 16), np.uint8), np.full((16, 16), 255, np.uint8)) - c1 / (255**2 + c1)) < 1e-12
    assert kernels.ssim(grid(32, 32, lambda x, y: x + y), grid(32, 32, lambda x, y: 3 * x + y)) < 0.95


@pytest.mark.parametrize("w,h", [(1, 1), (1, 9), (9, 1), (3, 17), (17, 3), (13, 13)])
def test_ssim_small_sizes(w, h):
    s = kernels.ssim(grid(w, h, lambda x, y: 31 * x + 7 * y), grid(w, h, lambda x, y: 5 * x + 91 * y))
    assert np.isfinite(s) and s <= 1 + 1e-12


def test_ssim_refuses():
    with pytest.raises(ValueError):
        kernels.ssim(np.zeros((2, 2), np.uint8), np.zeros((2, 3), np.uint8))
    with pytest.raises(ValueError):
        kernels.ssim(np.zeros((0, 2), np.uint8), np.zeros((0, 2), np.uint8))


def test_target_sizes():
    assert kernels.target_size((1280, 1051), (1280, 1051), 512) == (512, 420)
    assert kernels.target_size((4000, 3000), (4000, 3000)) == (4000, 3000)
    assert kernels.target_size((4000, 3000), (4000, 3000), 1600) == (1600, 1200)
    assert kernels.target_size((4000, 3000), (1000, 750)) == kernels.target_size((1000, 750), (4000, 3000)) == (1000, 750)
    assert kernels.target_size((2000, 1000), (2000, 1000), 200) == (200, 100)
    assert kernels.target_size((160, 120), (160, 120), 200) == (160, 120)
    assert kernels.target_size((100, 200), (200, 100)) == (100, 200)


def test_regions():
    mask = np.zeros((18, 24), bool)
    mask[6:11, 8:15] = True
    (r,) = kernels.regions(mask, 9)
    assert (r["x0"], r["y0"], r["x1"], r["y1"], len(r["pixels"])) == (8, 6, 14, 10, 35)
    one = np.zeros((18, 24), bool)
    one[3, 3] = True
    assert kernels.regions(one, 9) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32))
def test_regions_against_flood_fill(w, h, seed):
    mask = np.random.default_rng(seed).random((h, w)) < 0.5
    seen, expected = set(), []
    for start in range(w * h):
        if not mask.flat[start] or start in seen:
            continue
        todo, own = [start], {start}
        while todo:
            y, x = divmod(todo.pop(), w)
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    j = (y + dy) * w + x + dx
                    if 0 <= y + dy < h and 0 <= x + dx < w and mask.flat[j] and j not in own:
                        own.add(j)
                        todo.append(j)
        seen |= own
        expected.append(sorted(own))
    assert [sorted(r["pixels"].tolist()) for r in kernels.regions(mask, 1)] == expected


def test_difference_preview():
    a = np.zeros((18, 24, 4), np.uint8)
    a[..., 3] = 255
    b = a.copy()
    b[6:11, 8:15, 3] = 0
    found = kernels.difference_preview(a, b)
    assert len(found["regions"]) == 1 and found["regions"][0]["area"] == 35
    assert np.array_equal(kernels.read_png(found["left_png"]), a)
    assert kernels.difference_preview(a, a)["changed_ratio"] == 0
    big = np.lib.stride_tricks.as_strided(np.zeros(1, np.uint8), (6000, 6000), (0, 0))
    with pytest.raises(ValueError):
        kernels.difference_preview(big, a)
    with pytest.raises(ValueError):
        kernels.difference_preview(a, a, 101)


def test_sensitivity():
    assert [kernels.threshold(s) for s in (0, 50, 100, 200)] == [56, 32, 8, 8]


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.sampled_from([0, 3, 4]), st.integers(0, 2**32))
def test_png_round_trip(w, h, n, seed):
    a = np.random.default_rng(seed).integers(0, 256, (h, w, n) if n else (h, w), dtype=np.uint8)
    assert np.array_equal(kernels.read_png(kernels.png(a)), a)


def test_png_refuses():
    for data in (b"", b"GIF89a", kernels.png(np.zeros((2, 2), np.uint8))[:-30]):
        with pytest.raises(ValueError):
            kernels.read_png(data)


def test_blake3():
    # published test vectors: byte i is i mod 251
    data = bytes(i % 251 for i in range(4096))
    assert blake3.hexdigest(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3.hexdigest(data[:1]) == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert blake3.hexdigest(data[:1024]) == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert blake3.hexdigest(data[:2049]) == "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030"
