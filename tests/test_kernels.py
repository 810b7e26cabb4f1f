"""Kernels against scenes whose truth is known."""

import numpy as np
import pytest

from frameloom.operators import kernels as K


def scene(h=64, w=64, stars=12, seed=1, noise=0.05):
    rnd = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    img = np.full((h, w), 100.0)
    at = []
    for _ in range(stars):
        cy, cx, a = rnd.uniform(12, h - 12), rnd.uniform(12, w - 12), rnd.uniform(20, 60)
        img += a * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * 1.5**2))
        at.append((cy, cx, a))
    return img + rnd.normal(0, noise, (h, w)), at


def test_shifts_are_recovered():
    img, _ = scene()
    moved = K.shift_integer(img, -3, 5)
    assert K.grid_shift(img, moved, 10)[:2] == (3, -5)
    dy, dx = K.phase_shift(img, moved)
    assert abs(dy - 3) < 0.6 and abs(dx + 5) < 0.6
    f = np.fft.fft2(img - 100)
    ky, kx = np.meshgrid(np.fft.fftfreq(64), np.fft.fftfreq(64), indexing="ij")
    sub = np.fft.ifft2(f * np.exp(-2j * np.pi * (ky * 1.3 + kx * -0.7))).real
    dy, dx = K.upsampled_shift(img - 100, sub, 10)
    assert abs(dy + 1.3) < 0.11 and abs(dx - 0.7) < 0.11


def test_rotation_is_recovered():
    img, _ = scene(128, 128, 40, 3)
    turned = K.transform(img, rotation_deg=-4.0)
    angle, r = K.rotation_between(img, turned)
    assert abs(angle - 4.0) < 1.1 and r > 0.5


def test_stars_triangles_and_photometry():
    img, at = scene(160, 160, 10, 4, noise=0.2)
    stars = K.detect_stars(img, 8.0, 3.0)
    near = [min(np.hypot(s["y"] - y, s["x"] - x) for s in stars) for y, x, _ in at]
    assert sum(d < 1.0 for d in near) >= 7
    other = [{**s, "x": 1.01 * (s["x"] * np.cos(0.1) - s["y"] * np.sin(0.1)) + 4, "y": 1.01 * (s["x"] * np.sin(0.1) + s["y"] * np.cos(0.1)) - 2} for s in stars]
    m = K.match_triangles(stars, other)
    assert m["scale"] == pytest.approx(1.01, abs=1e-3) and m["rotation_deg"] == pytest.approx(np.degrees(0.1), abs=0.05) and m["points"] >= 5
    assert K.match_triangles(stars[:2], other) is None
    flux = K.aperture_fluxes(img, stars[:1], 6.0)[0][0]
    assert flux == pytest.approx(stars[0]["flux"], rel=0.2)
    assert 0.8 <= K.elongation(img, stars) <= 1.0
    assert K.detect_stars(np.full((9, 9), 3.0)) == []


def test_gradient_is_fitted_around_stars():
    y, x = np.mgrid[0:64, 0:64] / 63
    img, _ = scene(stars=6)
    fit = K.gradient_fit(img + 30 * x - 10 * y * y, 2, 16)
    model = K.gradient_model((64, 64), fit["coefficients"])
    truth = 100 + 30 * x - 10 * y * y
    assert np.abs(model - truth)[8:-8, 8:-8].max() < 1.5
    assert K.gradient_fit(np.ones((2, 2)), 2, 2)["coefficients"] is None
    assert K.polynomial_terms(2) == [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]


def test_blur_keeps_the_sum_and_is_a_gaussian():
    img = np.zeros((41, 41))
    img[20, 20] = 1
    b = K.gaussian_blur(img, 2.0)
    assert b.sum() == pytest.approx(1) and b[20, 22] / b[20, 20] == pytest.approx(np.exp(-0.5), rel=1e-3)
    assert np.allclose(K.gaussian_blur(np.full((9, 9), 3.0), 3.0), 3.0)


def test_demosaicing_keeps_samples_and_flat_fields():
    rnd = np.random.default_rng(2)
    img = rnd.uniform(0, 1, (10, 12))
    for f in (K.bilinear, K.malvar):
        out = f(img)
        assert np.array_equal(out[0::2, 0::2, 0], img[0::2, 0::2]) and np.array_equal(out[1::2, 1::2, 2], img[1::2, 1::2])
        assert np.allclose(f(np.full((10, 12), 2.0)), 2.0)
    assert K.superpixel(img).shape == (5, 6, 3)
    with pytest.raises(ValueError):
        K.superpixel(img[:5])


def test_pixel_repairs():
    img = np.random.default_rng(3).normal(100, 1, (16, 16))
    hot = img.copy()
    hot[5, 7] = 1000
    assert K.hot_pixel_clip(hot)[5, 7] == np.median(hot) and K.hot_pixel_clip(hot)[0, 0] == hot[0, 0]
    block = img.copy()
    block[4:7, 4:7] = 1000
    assert np.array_equal(K.hot_pixel_clip(block), block)
    assert abs(K.neighbour_median(hot)[5, 7] - 100) < 3


def test_labels_and_enhancement_and_kernels():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1]], bool)
    assert len(np.unique(K.label_regions(mask))) == 4
    flat = np.full((8, 8), 5.0)
    assert np.array_equal(K.structure_enhancement(flat), flat)
    img, _ = scene()
    assert (K.structure_enhancement(img) >= 0).all()
    assert K.kernel_weight(np.array([0.0, 3.0]), "lanczos3", 1).tolist() == [1.0, 0.0]
    assert K.kernel_weight(np.array([0.0, 9.0]), "tophat", 1).tolist() == [1.0, 0.0]
    assert K.pearson(flat, img[:8, :8]) == 0.0


def flood(mask):
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if not out[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                    out[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


def test_regions_equal_a_flood_fill():
    rnd = np.random.default_rng(4)
    for h, w, share in ((1, 1, 1), (7, 9, 0.4), (30, 41, 0.3), (30, 41, 0.5), (25, 25, 0.7), (5, 5, 0), (40, 3, 0.6)):
        mask = rnd.random((h, w)) < share
        assert (K.label_regions(mask) == flood(mask)).all()
    spiral = np.zeros((21, 21), bool)
    for k in range(0, 10, 2):
        spiral[k, k : 21 - k] = spiral[k : 21 - k, 20 - k] = spiral[20 - k, k : 21 - k] = spiral[k + 2 : 21 - k, k] = True
    assert (K.label_regions(spiral) == flood(spiral)).all()


def test_regions_of_a_large_frame_are_quick():
    import time

    mask = np.random.default_rng(5).random((540, 960)) < 0.5
    t = time.perf_counter()
    K.label_regions(mask)
    assert time.perf_counter() - t < 1.0  # 0.1 s on an idle machine


def test_elongation_needs_ten_stars():
    img = np.zeros((60, 120))
    y, x = np.indices(img.shape)
    for i in range(12):
        img += 100 * np.exp(-(((y - 10 - 20 * (i // 6)) / 1.3) ** 2) - ((x - 10 - 20 * (i % 6)) / 2.6) ** 2)
    stars = K.detect_stars(img + np.random.default_rng(6).normal(0, 0.5, img.shape))
    assert len(stars) >= 12 and K.elongation(img, stars) == 0.6
    assert K.elongation(img, stars[:9]) is None


def test_bad_pixels_take_good_neighbours():
    img = np.arange(100, dtype=float).reshape(10, 10)
    bad = np.zeros(img.shape, bool)
    bad[4, 4] = bad[4, 6] = True
    img[bad] = 1e6
    out, values, good = K.fill_bad(img, bad)
    assert good.tolist() == [7, 7] and out.max() < 100 and (out[~bad] == img[~bad]).all()
    whole = np.ones((4, 4), bool)
    assert K.fill_bad(np.full((4, 4), 3.0), whole)[0].tolist() == np.full((4, 4), 3.0).tolist()


def test_stars_align_turned_and_shifted_scenes():
    from frameloom.plans.config import Registration
    from frameloom.plans.pipeline import align

    img, _ = scene(96, 96, 18, 3)
    moved = K.transform(img, 3.0, -2.0, 1.2)
    m = align(img, moved, Registration(method="stars"))
    back = K.transform(moved, m["dy"], m["dx"], m["rotation_deg"], m["scale"])
    assert K.pearson(img[12:-12, 12:-12], back[12:-12, 12:-12]) > 0.9


def test_centroids_and_photometry():
    img, _ = scene(64, 64, 8, 9)
    moved = K.shift_integer(img, 3, -4)
    blob = np.zeros((40, 40))
    blob[10:14, 20:24] = 50.0
    assert K.centroid_shift(blob, K.shift_integer(blob, -3, 5)) == (3.0, -5.0, "centroid")
    assert K.centroid_shift(img, moved, least=10_000)[2] == "phase"
    assert K.photometry(np.dstack([img] * 3), min_stars=500) == []


def test_cells_that_stand_out_locally_leave_the_fit():
    y, x = np.mgrid[0:128, 0:128]
    plane = 100 + 0.2 * x + 0.1 * y
    img = plane + np.random.default_rng(3).normal(0, 0.2, plane.shape)
    img[40:48, 64:72] += 6  # one cell, less than the slope over the picture
    pts = np.array(K.gradient_cells(img, 16))
    out = K._stands_out(pts[:, :2], pts[:, 2], np.ones(len(pts), bool), 3.0)
    assert out[5 * 16 + 8] and out.sum() < 8
    assert not K._stands_out(pts[:, :2], np.ones(len(pts)), np.ones(len(pts), bool), 3.0).any()
    fit = K.gradient_fit(img, 1, 16)
    assert np.abs(K.gradient_model(img.shape, fit["coefficients"], 1) - plane).max() < 0.5 and fit["cells_used"] < 256


def test_rotations_are_found_under_a_shift():
    for seed, turn, shift in ((18, 1.5, (0, 0)), (19, -2.25, (3, -2)), (20, 0.0, (0, 4))):
        img, _ = scene(96, 110, 25, seed)
        found, r = K.rotation_between(img, K.transform(img, *shift, rotation_deg=-turn), 5.0)
        assert abs(found - turn) <= 0.25 and r > 0.5


def test_registration_with_a_rotation():
    from frameloom.plans.config import Registration
    from frameloom.plans.pipeline import align

    img, _ = scene(96, 96, 25, 21)
    moved = K.transform(img, 2.0, 3.0, -1.5)
    m = align(img, moved, Registration(method="rotation_fft"))
    back = K.transform(moved, m["dy"], m["dx"], m["rotation_deg"])
    assert K.pearson(img[12:-12, 12:-12], back[12:-12, 12:-12]) > 0.8
