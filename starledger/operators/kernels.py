"""Whole-frame operators in numpy, over Arrow batches of frames."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def over_frames(frames: DataFrame, height: int, width: int, kernel: Callable[[np.ndarray], list[tuple]], schema: str, values: str = "values") -> DataFrame:
    """Rows that ``kernel`` makes of each frame, with the frame's number before them."""
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, *r) for f, v in zip(b["frame"], b[values], strict=True) for r in kernel(np.asarray(v, dtype=np.float64).reshape(height, width))]
            yield pd.DataFrame(rows, columns=columns)

    return frames.select("frame", values).mapInPandas(run, schema)


def windows(a: np.ndarray, k: int) -> np.ndarray:
    """All k x k neighbourhoods, edges repeated."""
    p = k // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, p, mode="edge"), (k, k))


def median_filter(a: np.ndarray, k: int = 3) -> np.ndarray:
    """N31."""
    return np.median(windows(a, k), axis=(2, 3))


def gaussian_filter(a: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """N31."""
    r = max(1, int(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return (windows(a, 2 * r + 1) * (np.outer(w, w) / w.sum() ** 2)).sum(axis=(2, 3))


def bilateral_filter(a: np.ndarray, k: int = 5, space: float = 1.5, tone: float = 20.0) -> np.ndarray:
    """N31."""
    r = k // 2
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / space) ** 2)
    v = windows(a, k)
    w = np.outer(g, g) * np.exp(-0.5 * ((v - a[:, :, None, None]) / tone) ** 2)
    return (v * w).sum(axis=(2, 3)) / w.sum(axis=(2, 3))


def adaptive_blend(a: np.ndarray, smooth: np.ndarray, k: int = 3) -> np.ndarray:
    """The smoothed frame where the local variance is low, the frame itself where it is high."""
    var = windows(a, k).var(axis=(2, 3))
    share = np.clip(1 - var / (var.mean() + 1e-9), 0, 1)
    return share * smooth + (1 - share) * a


def sharpen(a: np.ndarray, amount: float = 1.0) -> np.ndarray:
    """What the smoothed frame lacks, added."""
    return np.clip(a + amount * (a - gaussian_filter(a)), 0, 255)


def equalize(a: np.ndarray, tiles: int = 2, clip: float = 2.0, levels: int = 256) -> np.ndarray:
    """Contrast-limited equalisation by tiles, blended between the tiles' middles."""
    h, w = a.shape
    th, tw = h // tiles, w // tiles
    luts = np.zeros((tiles, tiles, levels))
    for i in range(tiles):
        for j in range(tiles):
            part = np.clip(a[i * th : (i + 1) * th, j * tw : (j + 1) * tw], 0, levels - 1).astype(int)
            hist = np.bincount(part.ravel(), minlength=levels).astype(float)
            limit = max(1.0, clip * part.size / levels)
            spare = np.maximum(hist - limit, 0).sum()
            luts[i, j] = np.cumsum(np.minimum(hist, limit) + spare / levels) * (levels - 1) / part.size
    ys, xs = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.clip(np.floor(ys).astype(int), 0, tiles - 1), np.clip(np.floor(xs).astype(int), 0, tiles - 1)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = np.clip(ys - y0, 0, 1)[:, None], np.clip(xs - x0, 0, 1)[None, :]
    v = np.clip(a, 0, levels - 1).astype(int)
    look = lambda yy, xx: luts[yy[:, None], xx[None, :], v]
    return np.floor(np.round((1 - fy) * ((1 - fx) * look(y0, x0) + fx * look(y0, x1)) + fy * ((1 - fx) * look(y1, x0) + fx * look(y1, x1)), 6))


def debayer(a: np.ndarray) -> np.ndarray:
    """Three channels of a red-first mosaic, each missing value the mean of its neighbours of that colour."""
    yy, xx = np.indices(a.shape)
    masks = [(yy % 2 == 0) & (xx % 2 == 0), (yy + xx) % 2 == 1, (yy % 2 == 1) & (xx % 2 == 1)]
    out = []
    for m in masks:
        num = np.where(m, a, 0.0)
        sums = np.lib.stride_tricks.sliding_window_view(np.pad(num, 1), (3, 3)).sum(axis=(2, 3))
        counts = np.lib.stride_tricks.sliding_window_view(np.pad(m.astype(float), 1), (3, 3)).sum(axis=(2, 3))
        out.append(np.where(m, a, sums / np.maximum(counts, 1)))
    return np.stack(out, axis=2)


def background(a: np.ndarray, mesh: int) -> np.ndarray:
    """The medians of tiles of about ``mesh`` pixels, blended between the tiles' middles."""
    def axis(n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        parts = np.array_split(np.arange(n), max(1, n // mesh))
        middles = np.array([p.mean() for p in parts])
        at = np.clip(np.searchsorted(middles, np.arange(n), side="right") - 1, 0, max(0, len(parts) - 2))
        after = np.minimum(at + 1, len(parts) - 1)
        span = np.where(after > at, middles[after] - middles[at], 1)
        return parts, at, after, np.clip((np.arange(n) - middles[at]) / span, 0, 1)

    ys, y0, y1, fy = axis(a.shape[0])
    xs, x0, x1, fx = axis(a.shape[1])
    m = np.array([[np.median(a[np.ix_(p, q)]) for q in xs] for p in ys])
    fy, fx = fy[:, None], fx[None, :]
    look = lambda i, j: m[i[:, None], j[None, :]]
    return (1 - fy) * ((1 - fx) * look(y0, x0) + fx * look(y0, x1)) + fy * ((1 - fx) * look(y1, x0) + fx * look(y1, x1))


def blobs(a: np.ndarray, sigmas: float = 2.0, least: float = 10.0, mesh: int = 64, area: int = 1) -> list[tuple[float, float, float]]:
    """X, y and flux of the connected bright areas over the background, brightest first.

    The background is that of tiles, so a gradient of the sky is none of it; areas of less than
    ``area`` pixels are noise.
    """
    d = a - background(a, mesh)
    noise = 1.4826 * np.median(np.abs(d - np.median(d)))
    bright = d > max(least, sigmas * noise)
    label = np.where(bright, np.arange(1, a.size + 1).reshape(a.shape), 0)
    while True:  # the least number spreads over each area; areas are small
        spread = np.where(label > 0, label, a.size + 1)
        near = np.pad(spread, 1, constant_values=a.size + 1)
        best = np.minimum.reduce([near[1 + i : 1 + i + a.shape[0], 1 + j : 1 + j + a.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1)])
        new = np.where(bright, np.minimum(best, spread), 0)
        if (new == label).all():
            break
        label = new
    out = []
    for k in np.unique(label[label > 0]):
        y, x = np.nonzero(label == k)
        if len(y) < area:
            continue
        f = d[y, x]
        out.append((float((x * f).sum() / f.sum()), float((y * f).sum() / f.sum()), float(f.sum())))
    return sorted(out, key=lambda s: (-s[2], s[1], s[0]))


def template_hits(a: np.ndarray, template: np.ndarray, least: float = 0.6, apart: float = 2.0) -> list[tuple[int, int, float]]:
    """Places where the normalised correlation is high, in row order, none near one taken before."""
    k = template.shape[0]
    v = np.lib.stride_tricks.sliding_window_view(a, (k, k))
    v = v - v.mean(axis=(2, 3), keepdims=True)
    t = template - template.mean()
    score = (v * t).sum(axis=(2, 3)) / (np.sqrt((v**2).sum(axis=(2, 3)) * (t**2).sum()) + 1e-12)
    taken: list[tuple[int, int, float]] = []
    for y, x in zip(*np.nonzero(score >= least), strict=True):
        if all((x - p) ** 2 + (y - q) ** 2 > apart**2 for p, q, _ in taken):
            taken.append((int(x), int(y), float(score[y, x])))
    return taken


def lines(a: np.ndarray, low: float, high: float, votes: int, angles: int = 36) -> list[tuple[float, int, int]]:
    """Angle (degrees), distance and votes of every line through at least ``votes`` edge pixels.

    Edges are thin: pixels whose gradient is at least that of both neighbours across it, above
    ``high``, or above ``low`` and joined to one above ``high``. The line of most votes is taken
    first, the first of equals; pixels on it or beside it vote for no other.
    """
    y, x = np.nonzero(thin_edges(a, low, high))
    theta = np.arange(angles) * np.pi / angles
    reach = int(np.hypot(*a.shape)) + 1
    rho = np.floor(np.outer(x, np.cos(theta)) + np.outer(y, np.sin(theta)) + 0.5).astype(int) + reach
    out = []
    while len(rho) >= votes:
        count = np.stack([np.bincount(rho[:, i], minlength=2 * reach + 1) for i in range(angles)])
        i, r = np.unravel_index(count.argmax(), count.shape)
        if count[i, r] < votes:
            break
        out.append((float(np.degrees(theta[i])), int(r) - reach, int(count[i, r])))
        rho = rho[np.abs(rho[:, i] - r) > 1]
    return out


def thin_edges(a: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edge pixels by the gradient's size and direction, with two thresholds."""
    gy, gx = np.gradient(a)
    size = np.hypot(gx, gy)
    padded = np.pad(size, 1)
    octant = np.round(np.degrees(np.arctan2(gy, gx)) / 45).astype(int) % 4
    steps = [(0, 1), (1, 1), (1, 0), (1, -1)]
    near = lambda dy, dx: padded[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]]
    ahead = np.select([octant == k for k in range(4)], [near(*s) for s in steps])
    behind = np.select([octant == k for k in range(4)], [near(-s[0], -s[1]) for s in steps])
    thin = (size >= ahead) & (size > behind) & (size > low)
    strong = thin & (size > high)
    while True:  # weak edges beside strong ones
        grown = thin & (np.lib.stride_tricks.sliding_window_view(np.pad(strong, 1), (3, 3)).any(axis=(2, 3)))
        if (grown == strong).all():
            return strong
        strong = grown


def filled(a: np.ndarray, holes: np.ndarray, most: int = 50_000) -> np.ndarray:
    """Each hole takes the greater of the values two above and two to the left, in row order.

    At the edge the value two below or to the right stands in. A hole filled before counts as
    filled. Frames of more than ``most`` holes stay as they are.
    """
    out = a.copy()
    at = np.argwhere(holes)
    if len(at) <= most:
        for y, x in at:
            out[y, x] = max(out[y - 2 if y >= 2 else y + 2, x], out[y, x - 2 if x >= 2 else x + 2])
    return out


def difference_blobs(a: np.ndarray, fine: float, coarse: float, least: float) -> list[tuple[int, int, float]]:
    """X, y and strength of peaks of the difference of two Gaussians, in row order."""
    d = gaussian_filter(a, fine) - gaussian_filter(a, coarse)
    d = np.round(d, 9)
    y, x = np.nonzero((d == windows(d, 3).max(axis=(2, 3))) & (d > least))
    return [(int(i), int(j), float(d[j, i])) for j, i in zip(y, x, strict=True)]


def wavelet_denoise(a: np.ndarray, levels: int = 2, factor: float = 1.0) -> np.ndarray:
    """Haar wavelets, soft thresholds from the finest details' median deviation, put together again."""
    h, w = a.shape
    low, details = a.astype(float), []
    for _ in range(levels):
        if low.shape[0] % 2 or low.shape[1] % 2:
            break
        p, q, r, s = low[0::2, 0::2], low[0::2, 1::2], low[1::2, 0::2], low[1::2, 1::2]
        details.append(((p - q + r - s) / 2, (p + q - r - s) / 2, (p - q - r + s) / 2))
        low = (p + q + r + s) / 2
    if not details:
        return a
    limit = factor * np.median(np.abs(details[0][2])) / 0.6745 * math.sqrt(2 * math.log(h * w))
    soft = lambda d: np.sign(d) * np.maximum(np.abs(d) - limit, 0)
    for across, down, both in reversed([tuple(map(soft, d)) for d in details]):
        up = np.empty((low.shape[0] * 2, low.shape[1] * 2))
        up[0::2, 0::2], up[0::2, 1::2] = (low + across + down + both) / 2, (low - across + down - both) / 2
        up[1::2, 0::2], up[1::2, 1::2] = (low + across - down - both) / 2, (low - across - down + both) / 2
        low = up
    return low


def shift_between(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Whole-pixel offset of b against a, from the phases of their spectra."""
    f = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    r = np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)).real
    y, x = np.unravel_index(r.argmax(), r.shape)
    return int(-y if y <= a.shape[0] // 2 else a.shape[0] - y), int(-x if x <= a.shape[1] // 2 else a.shape[1] - x)


def protection_mask(a: np.ndarray, sigmas: float = 2.0, grow: int = 1) -> np.ndarray:
    """Bright small things and a rim around them, which denoising leaves alone."""
    bright = a - median_filter(a) > sigmas * a.std()
    return windows(bright.astype(float), 2 * grow + 1).max(axis=(2, 3)) > 0
