"""Scale-space keypoints and descriptors in numpy.

Parameters follow the data model: base blur 1.6 * 2**(1/3), nominal blur 0.5,
three levels an octave, edge threshold 10, 36 orientation bins, 4 x 4 x 8
descriptors, magnification 3, entropy filter on the quantised descriptor.
Results agree with other implementations up to tolerance, not bit by bit.
"""

from __future__ import annotations

import numpy as np

LEVELS, NOMINAL = 3, 0.5
BASE = 1.6 * 2 ** (1 / 3)
EDGE, BINS, SMOOTHINGS, MAGNIFY = 10.0, 36, 6, 3.0


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luma of an (h, w, 3) raster in 0..255; one channel is taken as it is; others are refused."""
    if rgb.ndim == 2:
        return rgb.astype(np.float32)
    if rgb.shape[2] == 1:
        return rgb[:, :, 0].astype(np.float32)
    if rgb.shape[2] != 3:
        raise ValueError("one or three channels only")
    return rgb.astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)


def resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest sample."""
    h, w = img.shape[:2]
    return img[(np.arange(height) * h // height)[:, None], np.arange(width) * w // width]


def smooth(img: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian of half width ceil(4 sigma); edges are repeated."""
    if sigma <= 0:
        return img
    half = int(np.ceil(4 * sigma))
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        padded = np.pad(img, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        img = sum(k[i] * (padded[i : i + img.shape[0]] if axis == 0 else padded[:, i : i + img.shape[1]]) for i in range(2 * half + 1))
    return img


def gradient(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude and angle by central differences, one-sided at the borders."""
    dy, dx = np.gradient(img)
    return np.hypot(dx, dy), np.arctan2(dy, dx) % (2 * np.pi)


def scale_space(img: np.ndarray) -> list[list[np.ndarray]]:
    """Octaves of LEVELS + 3 blurred images; each next octave takes every second pixel."""
    octaves, base = [], smooth(img, np.sqrt(max(BASE**2 * 2 ** (-2 / LEVELS) - NOMINAL**2, 0)))
    while min(base.shape) >= 16:
        rows, blur = [base], BASE * 2 ** (-1 / LEVELS)
        for _ in range(LEVELS + 2):
            wider = blur * 2 ** (1 / LEVELS)
            rows.append(smooth(rows[-1], np.sqrt(wider**2 - blur**2)))
            blur = wider
        octaves.append(rows)
        base = rows[LEVELS][::2, ::2]
    return octaves


def extrema(rows: list[np.ndarray], peak: float) -> list[tuple[float, float, float]]:
    """(x, y, level) of refined extrema of the difference images."""
    dog = np.stack([b - a for a, b in zip(rows, rows[1:])])
    inner = dog[1:-1, 1:-1, 1:-1]
    s, h, w = dog.shape
    near = np.stack([dog[1 + i : s - 1 + i, 1 + j : h - 1 + j, 1 + k : w - 1 + k] for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if i or j or k])
    hit = ((inner > near.max(axis=0)) & (inner > 0.8 * peak)) | ((inner < near.min(axis=0)) & (inner < -0.8 * peak))
    out = []
    for z, y, x in np.argwhere(hit) + 1:
        for _ in range(5):
            d = dog[z - 1 : z + 2, y - 1 : y + 2, x - 1 : x + 2]
            g = 0.5 * np.array([d[1, 1, 2] - d[1, 1, 0], d[1, 2, 1] - d[1, 0, 1], d[2, 1, 1] - d[0, 1, 1]])
            hess = np.array(
                [
                    [d[1, 1, 2] + d[1, 1, 0] - 2 * d[1, 1, 1], 0.25 * (d[1, 2, 2] + d[1, 0, 0] - d[1, 2, 0] - d[1, 0, 2]), 0.25 * (d[2, 1, 2] + d[0, 1, 0] - d[2, 1, 0] - d[0, 1, 2])],
                    [0, d[1, 2, 1] + d[1, 0, 1] - 2 * d[1, 1, 1], 0.25 * (d[2, 2, 1] + d[0, 0, 1] - d[2, 0, 1] - d[0, 2, 1])],
                    [0, 0, d[2, 1, 1] + d[0, 1, 1] - 2 * d[1, 1, 1]],
                ]
            )
            hess = hess + np.triu(hess, 1).T
            try:
                move = -np.linalg.solve(hess, g)
            except np.linalg.LinAlgError:
                move = np.full(3, np.inf)
            step = np.array([int(np.sign(m)) if abs(m) > 0.6 else 0 for m in move[:2]])
            nx, ny = x + step[0], y + step[1]
            if not step.any() or not (1 <= nx < w - 1 and 1 <= ny < h - 1):
                break
            x, y = nx, ny
        if not np.all(np.abs(move) < 1.5):
            continue
        value = d[1, 1, 1] + 0.5 * float(g @ move)
        trace, det = hess[0, 0] + hess[1, 1], hess[0, 0] * hess[1, 1] - hess[0, 1] ** 2
        if abs(value) > peak and det > 0 and trace * trace / det < (EDGE + 1) ** 2 / EDGE:
            out.append((x + float(move[0]), y + float(move[1]), z + float(move[2])))
    return out


def _patch(shape, x: float, y: float, radius: int):
    x0, x1, y0, y1 = max(int(x) - radius, 0), min(int(x) + radius + 1, shape[1]), max(int(y) - radius, 0), min(int(y) + radius + 1, shape[0])
    yy, xx = np.mgrid[y0:y1, x0:x1]
    return (slice(y0, y1), slice(x0, x1)), xx - x, yy - y


def orientations(mag: np.ndarray, ang: np.ndarray, x: float, y: float, sigma: float) -> list[float]:
    """At most four peaks of the smoothed, weighted orientation histogram."""
    wide = 1.5 * sigma
    at, dx, dy = _patch(mag.shape, x, y, int(np.floor(3 * wide)) or 1)
    r2 = dx * dx + dy * dy
    weight = mag[at] * np.exp(-r2 / (2 * wide * wide)) * (r2 < (3 * wide) ** 2 + 0.6)
    hist = np.bincount((BINS * ang[at] / (2 * np.pi)).astype(int).ravel() % BINS, weights=weight.ravel(), minlength=BINS)
    for _ in range(SMOOTHINGS):
        hist = (np.roll(hist, 1) + hist + np.roll(hist, -1)) / 3
    out = []
    for i in np.flatnonzero((hist > 0.8 * hist.max()) & (hist > np.roll(hist, 1)) & (hist > np.roll(hist, -1))):
        a, b, c = hist[i - 1], hist[i], hist[(i + 1) % BINS]
        out.append(2 * np.pi * (i + 0.5 + 0.5 * (a - c) / (a - 2 * b + c)) / BINS % (2 * np.pi))
    return out[:4]


def descriptor(mag: np.ndarray, ang: np.ndarray, x: float, y: float, sigma: float, turn: float) -> np.ndarray:
    """128 values: 4 x 4 cells of 8 directions, trilinear shares, clipped at 0.2 between two normalisations."""
    cell = MAGNIFY * sigma
    at, dx, dy = _patch(mag.shape, x, y, int(np.ceil(np.sqrt(2) * cell * 2.5)))
    c, s = np.cos(turn), np.sin(turn)
    u, v = (c * dx + s * dy) / cell, (-s * dx + c * dy) / cell
    bu, bv = np.floor(u - 0.5), np.floor(v - 0.5)
    near = (bu >= -3) & (bu < 2) & (bv >= -3) & (bv < 2)  # of the others no cell has a share
    u, v, bu, bv = u[near], v[near], bu[near], bv[near]
    weight = mag[at][near] * np.exp(-(u * u + v * v) / 8)
    o = ((ang[at][near] - turn) % (2 * np.pi)) * 8 / (2 * np.pi)
    bo, cells, shares = np.floor(o), [], []
    for i in (0, 1):
        cu, by_u = bu + i, weight * np.abs(1 - i - (u - 0.5 - bu))
        for j in (0, 1):
            cv = bv + j
            ok = (cu >= -2) & (cu < 2) & (cv >= -2) & (cv < 2)
            by_v, cell, turned = (by_u * np.abs(1 - j - (v - 0.5 - bv)))[ok], ((cv + 2) * 4 + cu + 2)[ok] * 8, bo[ok]
            for k in (0, 1):
                cells.append((cell + (turned + k) % 8).astype(int))
                shares.append(by_v * np.abs(1 - k - (o[ok] - turned)))
    flat = np.bincount(np.concatenate(cells), weights=np.concatenate(shares), minlength=128)
    for clip in (0.2, None):
        norm = np.linalg.norm(flat)
        flat = flat / norm if norm else flat
        flat = np.minimum(flat, clip) if clip else flat
    return flat.astype(np.float32)


def entropy(desc: np.ndarray) -> float:
    """Bits of the histogram of values rounded to 0..255."""
    n = np.bincount(np.minimum(np.round(desc * 255).astype(int), 255), minlength=256)
    p = n[n > 0] / n.sum()
    return float(-(p * np.log2(p)).sum())


def keypoints(img: np.ndarray, peak: float):
    """(octave, x, y, sigma, magnitudes, angles, turn) of each keypoint and orientation."""
    for o, rows in enumerate(scale_space(img.astype(np.float64))):
        grads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for x, y, level in extrema(rows, peak):
            k = int(np.clip(round(level), 0, LEVELS + 2))
            if k not in grads:
                grads[k] = gradient(rows[k])
            sigma = BASE * 2 ** ((level - 1) / LEVELS)
            for turn in orientations(*grads[k], x, y, sigma):
                yield o, x, y, sigma, *grads[k], turn


def extract(img: np.ndarray, peak: float = 3.0, min_entropy: float = 4.4) -> list[tuple[float, float, float, float, np.ndarray]]:
    """(x, y, r, t, descriptor): radius r in pixels of the image, t as fraction of a turn; values doubled and cut at 1."""
    out = []
    for o, x, y, sigma, mag, ang, turn in keypoints(img, peak):
        desc = np.minimum(descriptor(mag, ang, x, y, sigma, turn) * 2, 1)
        if entropy(desc) >= min_entropy:
            out.append((x * 2**o, y * 2**o, MAGNIFY * sigma * 2**o, turn / (2 * np.pi), desc))
    return out
