"""Extraction on small generated images."""

import numpy as np
import pytest

from nearfold.functions import sift
from nearfold.operators import extract


def _picture(h, w, seed=0):
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[0:h, 0:w]
    img = np.full((h, w), 128.0)
    for _ in range(120):
        x, y, r, v = rng.integers(0, w), rng.integers(0, h), rng.integers(2, 6), rng.integers(-110, 110)
        img += v * np.exp(-((xx - x) ** 2 + (yy - y) ** 2 * rng.uniform(0.5, 2)) / (2.0 * r * r))
    return np.clip(img, 0, 255).astype(np.uint8)


def test_gray_and_resize():
    assert np.allclose(sift.gray(np.full((2, 2, 3), 100, np.uint8)), 100, atol=1e-3)
    with pytest.raises(ValueError):
        sift.gray(np.zeros((2, 2, 2)))
    assert extract.fit(np.zeros((100, 500)), longest=250)[0].shape == (50, 250)
    assert extract.fit(np.zeros((40, 20)), shortest=80)[0].shape == (160, 80)


def test_smooth_keeps_mass():
    img = np.zeros((41, 41))
    img[20, 20] = 1
    out = sift.smooth(img, 2.0)
    assert abs(out.sum() - 1) < 1e-9 and out.argmax() == 20 * 41 + 20


def test_features_survive_a_crop():
    img = _picture(160, 200).astype(np.float32)
    whole, part = sift.extract(img, peak=1.0, min_entropy=0), sift.extract(img[16:144, 16:184], peak=1.0, min_entropy=0)
    # Only features whose surroundings are inside the crop can stay the same.
    part = [f for f in part if 4 * f[2] < min(f[0], f[1], 168 - f[0], 128 - f[1])]
    assert len(whole) > 10 and len(part) > 3
    d = np.stack([f[4] for f in whole])
    best = [float(np.linalg.norm(d - f[4], axis=1).min()) for f in part]
    assert np.median(best) < 0.1
    assert all(abs(np.linalg.norm(np.minimum(f[4] / 2, 1)) - 1) < 0.35 for f in whole)


def test_records_from_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(extract.png(_picture(120, 150)))
    (tmp_path / "b.png").write_bytes(extract.png(np.stack([_picture(90, 90, 1)] * 3, axis=2)))
    (tmp_path / "small.png").write_bytes(extract.png(_picture(30, 30)))
    (tmp_path / "bad.png").write_bytes(b"no image")
    got = {r.url.rsplit("/", 1)[1]: r for r in extract.extract(extract.read_images(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.png", "b.png"}
    assert (got["a.png"].width, got["a.png"].height) == (150, 120)
    assert all(len(f) == 16 for f in got["a.png"].features) and len(got["a.png"].features) == len(got["a.png"].regions) > 0
    asked = extract.extract(extract.read_images(spark, str(tmp_path)), query=True)
    assert asked.count() == 3


def test_gradients_once_a_level_and_no_descriptor_for_orientations(monkeypatch):
    img, seen, real = _picture(160, 200).astype(np.float64), [], sift.gradient
    monkeypatch.setattr(sift, "gradient", lambda im: seen.append(im.shape) or real(im))
    whole = sift.extract(img, peak=1.0, min_entropy=0)
    assert len(whole) > 2 * len(seen) > 0 and len(seen) <= (sift.LEVELS + 3) * len(set(seen))
    monkeypatch.setattr(sift, "descriptor", None)
    assert [k[-1] / (2 * np.pi) for k in sift.keypoints(img, 1.0)] == [f[3] for f in whole]
