"""Array kernels for neighbourhood operations, one image at a time.

Plain numpy; `per_frame` runs them over tensor rows in Arrow batches, so that a
stencil needs no shuffle. Images are (h, w) or (h, w, c) in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.robust import MAD_SCALE


def per_frame(df: DataFrame, keep: list[str], schema: str, fn: Callable[..., dict], extra: list[str] | None = None) -> DataFrame:
    """Apply fn(image, *extra) to each tensor row (h, w, ch, data); fn gives a dict of the columns in `schema`.

    Rows whose data is null or doesn't fill h·w·ch give null columns.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",") if " " in part.strip() and "<" not in part.split(" ")[0]]
    types = dict(df.dtypes)
    full = ", ".join([f"{k} {types[k]}" for k in keep] + [schema])
    more = extra or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for values in zip(*[pdf[c] for c in pdf.columns]):
                row = dict(zip(pdf.columns, values))
                rec = {k: row[k] for k in keep}
                shape, data = (row["h"], row["w"], row["ch"]), row["data"]
                if data is not None and not any(pd.isna(s) for s in shape) and len(data) == int(np.prod(shape)):
                    img = np.asarray(data, dtype=np.float64).reshape([int(s) for s in shape])
                    rec |= fn(img[:, :, 0] if img.shape[2] == 1 else img, *[row[m] for m in more])
                out.append(rec)
            yield pd.DataFrame(out, columns=[*keep, *names])

    cols = list(dict.fromkeys([*keep, "h", "w", "ch", "data", *more]))
    return df.select(*cols).mapInPandas(run, full)


def flat(img: np.ndarray) -> list[float]:
    return np.asarray(img, dtype=np.float64).ravel().tolist()


def neighbour_median(img: np.ndarray) -> np.ndarray:
    """Median of the eight neighbours at distance 2 (the same colour of a Bayer mosaic), edges reflected."""
    p = np.pad(img, 2, mode="reflect")
    h, w = img.shape
    near = [p[dy : dy + h, dx : dx + w] for dy in (0, 2, 4) for dx in (0, 2, 4) if (dy, dx) != (2, 2)]
    return np.median(np.stack(near), axis=0)


def fill_bad(img: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bad pixels by the median of good neighbours of their colour, of all eight if fewer than two are good.

    Gives the repaired image and, per bad pixel in reading order, its value and
    number of good neighbours. Edges reflected.
    """
    y, x = np.nonzero(bad)
    pv, pm = np.pad(img, 2, mode="reflect"), np.pad(bad, 2, mode="reflect")
    near = [(dy, dx) for dy in (0, 2, 4) for dx in (0, 2, 4) if (dy, dx) != (2, 2)]
    values = np.stack([pv[y + dy, x + dx] for dy, dx in near]) if len(y) else np.zeros((8, 0))
    flags = np.stack([pm[y + dy, x + dx] for dy, dx in near]) if len(y) else np.zeros((8, 0), dtype=bool)
    good = (~flags).sum(axis=0)
    masked = np.where(flags & (good >= 2), np.nan, values)
    new = np.nanmedian(masked, axis=0) if len(y) else np.zeros(0)
    out = img.copy()
    out[y, x] = new
    return out, new, good


def hot_pixel_clip(img: np.ndarray, k: float = 5.0, most: int = 3) -> np.ndarray:
    """Single outliers to the image's median; clusters of more than `most` (3 × 3, with the pixel) stay. Wraps at the edges."""
    med = np.median(img)
    sigma = MAD_SCALE * np.median(np.abs(img - med))
    cand = np.abs(img - med) > k * sigma if sigma > 0 else np.zeros(img.shape, bool)
    count = sum(np.roll(cand, (dy, dx), (0, 1)).astype(int) for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    return np.where(cand & (count <= most), med, img)


def superpixel(img: np.ndarray) -> np.ndarray:
    """RGGB mosaic to half size: R, mean of both G, B."""
    h, w = img.shape
    if h % 2 or w % 2:
        raise ValueError("a mosaic has even sides")
    return np.dstack([img[0::2, 0::2], (img[0::2, 1::2] + img[1::2, 0::2]) / 2, img[1::2, 1::2]])


def bayer_masks(shape: tuple[int, int], pattern: str = "RGGB") -> dict[str, np.ndarray]:
    y, x = np.indices(shape)
    at = np.array(list(pattern))[(y % 2) * 2 + x % 2]
    return {c: at == c for c in "RGB"}


def _filter(img: np.ndarray, kernel: np.ndarray, mode: str) -> np.ndarray:
    r = kernel.shape[0] // 2
    p = np.pad(img, r, mode=mode)
    h, w = img.shape
    out = np.zeros(img.shape)
    for (dy, dx), k in np.ndenumerate(kernel):
        if k:
            out += k * p[dy : dy + h, dx : dx + w]
    return out


def bilinear(img: np.ndarray, pattern: str = "RGGB") -> np.ndarray:
    """Bilinear demosaicing: known samples stay, others are the weighted mean of known neighbours."""
    kernel = np.array([[0, 0.25, 0], [0.25, 1.0, 0.25], [0, 0.25, 0]])
    out = []
    for c, mask in bayer_masks(img.shape, pattern).items():
        # Where the cross holds no sample of the colour, the corners do.
        for kern in (kernel, np.ones((3, 3))):
            num, den = _filter(np.where(mask, img, 0), kern, "constant"), _filter(mask.astype(float), kern, "constant")
            plane = np.divide(num, den, out=np.zeros(img.shape), where=den > 0)
            if kern is kernel:
                first, known = plane, den > 0
        out.append(np.where(mask, img, np.where(known, first, plane)))
    return np.dstack(out)


# 5 × 5 kernels of the gradient-corrected demosaicing of Malvar, He and Cutler (2004), times 8.
MALVAR_G = np.array([[0, 0, -1, 0, 0], [0, 0, 2, 0, 0], [-1, 2, 4, 2, -1], [0, 0, 2, 0, 0], [0, 0, -1, 0, 0]]) / 8
MALVAR_ROW = np.array([[0, 0, 0.5, 0, 0], [0, -1, 0, -1, 0], [-1, 4, 5, 4, -1], [0, -1, 0, -1, 0], [0, 0, 0.5, 0, 0]]) / 8
MALVAR_DIAG = np.array([[0, 0, -1.5, 0, 0], [0, 2, 0, 2, 0], [-1.5, 0, 6, 0, -1.5], [0, 2, 0, 2, 0], [0, 0, -1.5, 0, 0]]) / 8


def malvar(img: np.ndarray, pattern: str = "RGGB") -> np.ndarray:
    """Gradient-corrected linear demosaicing; edges reflected."""
    m = bayer_masks(img.shape, pattern)
    y = np.indices(img.shape)[0]
    g = np.where(m["G"], img, _filter(img, MALVAR_G, "reflect"))
    row, col, diag = (_filter(img, k, "reflect") for k in (MALVAR_ROW, MALVAR_ROW.T, MALVAR_DIAG))
    out = {}
    for c, o in (("R", "B"), ("B", "R")):
        rows_with = np.array([m[c][i].any() for i in range(img.shape[0])])
        in_row = rows_with[y]
        out[c] = np.where(m[c], img, np.where(m[o], diag, np.where(in_row, row, col)))
    return np.dstack([out["R"], g, out["B"]])


def gaussian_blur(img: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, cut off at 4 sigma, edges mirrored with the edge pixel repeated."""
    r = int(4.0 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = img
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        p = np.pad(out, pad, mode="symmetric")
        out = np.apply_along_axis(lambda v: np.convolve(v, k, mode="valid"), axis, p)
    return out


def label_regions(mask: np.ndarray) -> np.ndarray:
    """8-connected regions numbered from 1 in reading order; 0 outside.

    Rows are cut into runs; runs that touch in neighbouring rows are united, all
    pairs at once, until each points to the first run of its region.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    n = len(row)
    if n == 0:
        return np.zeros((h, w), dtype=np.int64)
    # Places of the row before that touch a run, diagonals included: runs ending at its start or later, beginning at its end or before.
    wide = w + 2
    first = np.searchsorted(row * wide + end, (row - 1) * wide + start, side="left")
    last = np.searchsorted(row * wide + start, (row - 1) * wide + end, side="right")
    many = np.maximum(last - first, 0)
    below = np.repeat(np.arange(n), many)
    above = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    root = np.arange(n)
    while True:
        a, b = root[above], root[below]
        if (a == b).all():
            break
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]
    number = np.unique(root, return_inverse=True)[1] + 1
    flat = np.zeros(h * w + 1, dtype=np.int64)
    np.add.at(flat, row * w + start, number)
    np.add.at(flat, row * w + end, -number)
    return np.cumsum(flat[:-1]).reshape(h, w)


def detect_stars(img: np.ndarray, k: float = 5.0, floor: float = 2.0, min_area: int = 3) -> list[dict]:
    """Stars: regions over median + floor sigma that hold a strict local maximum over median + k sigma.

    Each has x, y (flux-weighted), flux over the background, peak, area and fwhm
    (2.355 times the median distance of its pixels); brightest first.
    """
    med = np.median(img)
    sigma = MAD_SCALE * np.median(np.abs(img - med))
    if sigma <= 0:
        return []
    p = np.pad(img, 1, constant_values=-np.inf)
    h, w = img.shape
    around = np.stack([p[dy : dy + h, dx : dx + w] for dy in (0, 1, 2) for dx in (0, 1, 2) if (dy, dx) != (1, 1)])
    seeds = (img > around.max(axis=0)) & (img > med + k * sigma)
    lab = label_regions(img > med + floor * sigma)
    wanted = np.zeros(int(lab.max()) + 1, dtype=bool)
    wanted[lab[seeds]] = True
    wanted[0] = False
    at = np.flatnonzero(wanted[lab.ravel()])
    at = at[np.argsort(lab.ravel()[at], kind="stable")]
    out = []
    for part in np.split(at, np.flatnonzero(np.diff(lab.ravel()[at])) + 1) if len(at) else []:
        if len(part) < min_area:
            continue
        y, x = np.divmod(part, w)
        v = img[y, x] - med
        flux = v.sum()
        cy, cx = (y * v).sum() / flux, (x * v).sum() / flux
        out.append({"x": float(cx), "y": float(cy), "flux": float(flux), "peak": float(img[y, x].max()), "area": len(part), "fwhm_est": float(2.355 * np.median(np.hypot(y - cy, x - cx)))})
    return sorted(out, key=lambda s: (-s["flux"], s["y"], s["x"]))


def elongation(img: np.ndarray, stars: list[dict], min_stars: int = 10) -> float | None:
    """Ratio of the shorter to the longer median width at half maximum over all stars; None under min_stars.

    The widths are those of the maximum profiles of a box of 1.5 star widths
    (at least 3 pixels) around each star.
    """
    widths: list[tuple[int, int]] = []
    for s in stars:
        y, x = round(s["y"]), round(s["x"])
        r = max(round(1.5 * s["fwhm_est"]), 3)
        box = img[max(0, y - r) : max(0, y + r + 1), max(0, x - r) : max(0, x + r + 1)]
        if not box.size or box.max() <= 0:
            continue
        along = [box.max(axis=axis) for axis in (0, 1)]
        widths.append(tuple(int((p >= p.max() / 2).sum()) for p in along))
    if len(widths) < min_stars:
        return None
    a, b = np.median(np.array(widths), axis=0)
    return float(min(a, b) / max(a, b))


def polynomial_terms(degree: int) -> list[tuple[int, int]]:
    """Exponents of x and y, by total degree: (0,0), (1,0), (0,1), (2,0), ..."""
    return [(d - j, j) for d in range(degree + 1) for j in range(d + 1)]


def gradient_cells(img: np.ndarray, cells: int) -> list[tuple[float, float, float]]:
    """Centre and median of each cell of a grid."""
    h, w = img.shape
    ch, cw = -(-h // cells), -(-w // cells)
    out = []
    for y in range(0, h, ch):
        for x in range(0, w, cw):
            part = img[y : y + ch, x : x + cw]
            out.append(((x + (part.shape[1] - 1) / 2) / max(w - 1, 1), (y + (part.shape[0] - 1) / 2) / max(h - 1, 1), float(np.median(part))))
    return out


def _stands_out(at: np.ndarray, value: np.ndarray, use: np.ndarray, k: float) -> np.ndarray:
    """Cells in use more than k local sigma off the median of the used cells around them (3 × 3): rims of soft objects.

    Fewer than two neighbours, or neighbours without spread, judge nothing.
    """
    xs, ys = (np.unique(at[:, i], return_inverse=True)[1] for i in (0, 1))
    grid = np.full((ys.max() + 3, xs.max() + 3), np.nan)
    grid[ys[use] + 1, xs[use] + 1] = value[use]
    near = np.stack([grid[ys + dy, xs + dx] for dy in (0, 1, 2) for dx in (0, 1, 2) if (dy, dx) != (1, 1)])
    many = (~np.isnan(near)).sum(axis=0) >= 2
    near[:, ~many] = 0.0
    middle = np.nanmedian(near, axis=0)
    sigma = MAD_SCALE * np.nanmedian(np.abs(near - middle), axis=0)
    return use & many & (sigma > 1e-12) & (np.abs(value - middle) > k * sigma)


def gradient_fit(img: np.ndarray, degree: int = 2, cells: int = 16, k: float = 3.0, rounds: int = 5) -> dict:
    """Polynomial background fitted to cell medians; cells off by more than k sigma leave the fit, and those that stand out from the cells around them.

    Gives coefficients, cells used and rms; null coefficients with too few cells.
    """
    pts = np.array(gradient_cells(img, cells))
    terms = polynomial_terms(degree)
    design = np.stack([pts[:, 0] ** a * pts[:, 1] ** b for a, b in terms], axis=1)
    med = np.median(pts[:, 2])
    sigma = MAD_SCALE * np.median(np.abs(pts[:, 2] - med))
    use = pts[:, 2] <= med + k * sigma if sigma > 0 else np.ones(len(pts), bool)
    coef = None
    for _ in range(rounds):
        if use.sum() < len(terms):
            return {"coefficients": None, "cells_used": int(use.sum()), "rms": None}
        coef = np.linalg.lstsq(design[use], pts[use, 2], rcond=None)[0]
        res = pts[:, 2] - design @ coef
        s = MAD_SCALE * np.median(np.abs(res[use] - np.median(res[use])))
        keep = use & (np.abs(res) <= k * s) if s > 1e-12 else use
        keep = keep & ~_stands_out(pts[:, :2], pts[:, 2], keep, k)
        if (keep == use).all():
            break
        use = keep
    res = pts[use, 2] - design[use] @ coef
    return {"coefficients": coef.tolist(), "cells_used": int(use.sum()), "rms": float(np.sqrt(np.mean(res**2)))}


def gradient_model(shape: tuple[int, int], coefficients: list[float], degree: int = 2) -> np.ndarray:
    h, w = shape
    y, x = np.mgrid[0:h, 0:w]
    x, y = x / max(w - 1, 1), y / max(h - 1, 1)
    return sum(c * x**a * y**b for c, (a, b) in zip(coefficients, polynomial_terms(degree)))


def pearson(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    d = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / d) if d > 1e-12 else 0.0


def phase_shift(ref: np.ndarray, img: np.ndarray) -> tuple[float, float]:
    """Shift (dy, dx) that moves img onto ref: peak of the phase correlation, refined by a parabola."""
    win = np.outer(np.hanning(ref.shape[0]), np.hanning(ref.shape[1]))
    cross = np.fft.fft2((ref - ref.mean()) * win) * np.conj(np.fft.fft2((img - img.mean()) * win))
    r = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
    peak = np.unravel_index(np.argmax(r), r.shape)
    out = []
    for axis in (0, 1):
        n = r.shape[axis]
        i = list(peak)
        vals = []
        for k in (-1, 0, 1):
            i[axis] = (peak[axis] + k) % n
            vals.append(r[tuple(i)])
        den = vals[0] - 2 * vals[1] + vals[2]
        frac = 0.5 * (vals[0] - vals[2]) / den if abs(den) > 1e-12 else 0.0
        p = peak[axis] + float(np.clip(frac, -0.5, 0.5))
        out.append(float(p - n if p > n / 2 else p))
    return out[0], out[1]


def upsampled_shift(ref: np.ndarray, img: np.ndarray, factor: int = 10) -> tuple[float, float]:
    """Shift to 1/factor pixel by a matrix-multiply DFT around the coarse peak (Guizar-Sicairos et al. 2008)."""
    f = np.fft.fft2(ref) * np.conj(np.fft.fft2(img))
    r = np.abs(np.fft.ifft2(f))
    shift = np.array(np.unravel_index(np.argmax(r), r.shape), dtype=float)
    size = np.array(r.shape)
    shift = np.where(shift > size // 2, shift - size, shift)
    span = int(np.ceil(factor * 1.5))
    off = span // 2 - shift * factor
    freq = [np.fft.fftfreq(n) for n in r.shape]
    ky = np.exp(2j * np.pi / factor * np.outer(np.arange(span) - off[0], freq[0]))
    kx = np.exp(2j * np.pi / factor * np.outer(freq[1], np.arange(span) - off[1]))
    up = np.abs(ky @ f @ kx)
    p = np.array(np.unravel_index(np.argmax(up), up.shape), dtype=float)
    fine = (p - off) / factor
    return float(fine[0]), float(fine[1])


def shift_integer(img: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """Moved by whole pixels; edges repeat."""
    y = np.clip(np.arange(img.shape[0]) - dy, 0, img.shape[0] - 1)
    x = np.clip(np.arange(img.shape[1]) - dx, 0, img.shape[1] - 1)
    return img[np.ix_(y, x)]


def grid_shift(ref: np.ndarray, img: np.ndarray, reach: int = 125) -> tuple[int, int, float]:
    """Shift with the best correlation, searched on every 4th, then 2nd, then each pixel: dy, dx, r."""

    def score(dy: int, dx: int, step: int) -> float:
        h, w = ref.shape
        y0, y1, x0, x1 = max(0, dy), min(h, h + dy), max(0, dx), min(w, w + dx)
        if (y1 - y0) * (x1 - x0) < max(16, 0.1 * h * w):
            return -2.0
        return pearson(ref[y0:y1:step, x0:x1:step], img[y0 - dy : y1 - dy : step, x0 - dx : x1 - dx : step])

    best, at = -2.0, (0, 0)
    reach = min(reach, max(ref.shape) - 1)
    step = 4 if min(ref.shape) >= 64 else 1
    area = [(dy, dx) for dy in range(-reach, reach + 1, step) for dx in range(-reach, reach + 1, step)]
    while True:
        for dy, dx in area:
            s = score(dy, dx, step)
            if s > best + 1e-12:
                best, at = s, (dy, dx)
        if step == 1:
            return at[0], at[1], best
        step //= 2
        area = [(at[0] + a * step, at[1] + b * step) for a in (-2, -1, 0, 1, 2) for b in (-2, -1, 0, 1, 2)]
        best = -2.0


def sample(img: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at real positions; edges repeat."""
    h, w = img.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = y - y0, x - x0
    return (img[y0, x0] * (1 - fx) + img[y0, x1] * fx) * (1 - fy) + (img[y1, x0] * (1 - fx) + img[y1, x1] * fx) * fy


def transform(img: np.ndarray, dy: float = 0.0, dx: float = 0.0, rotation_deg: float = 0.0, scale: float = 1.0) -> np.ndarray:
    """Rotated and scaled about the centre, then shifted; bilinear."""
    h, w = img.shape
    cy, cx = (h - 1) / 2, (w - 1) / 2
    yy, xx = np.mgrid[0:h, 0:w].astype(float)
    yy, xx = yy - dy - cy, xx - dx - cx
    a = np.radians(-rotation_deg)
    return sample(img, cy + (np.sin(a) * xx + np.cos(a) * yy) / scale, cx + (np.cos(a) * xx - np.sin(a) * yy) / scale)


def polar_spectrum(img: np.ndarray, angles: int = 720, radii: int = 64) -> np.ndarray:
    """Magnitudes of the spectrum over half a turn and log radius, each radius less its mean over the angles.

    A round window keeps the frame's sides out of the spectrum; the innermost
    frequencies, where the pixel grid shows, are left out.
    """
    h, w = img.shape
    y, x = np.mgrid[0:h, 0:w]
    r = np.hypot((y - (h - 1) / 2) / (h / 2), (x - (w - 1) / 2) / (w / 2))
    win = np.where(r < 1, np.cos(np.pi * np.minimum(r, 1) / 2) ** 2, 0.0)
    mag = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2((img - (img * win).sum() / win.sum()) * win))))
    # Frequencies per axis, so that a circle is one on oblong frames too.
    most = 0.5 * (1 - 2 / min(h, w))
    t = np.linspace(0, np.pi, angles, endpoint=False)[:, None]
    f = np.exp(np.linspace(np.log(min(5 / min(h, w), most / 2)), np.log(most), radii))[None, :]
    out = sample(mag, h // 2 + f * h * np.sin(t), w // 2 + f * w * np.cos(t))
    return out - out.mean(axis=0)


def rotation_between(ref: np.ndarray, img: np.ndarray, most: float = 30.0) -> tuple[float, float]:
    """Rotation in degrees that turns img onto ref and the correlation there.

    The polar spectra, which a shift leaves alone, give a coarse angle by their
    circular correlation. Angles around it and around zero, in steps of 0.25 degrees, are
    compared by the correlation of the images after the shift that is left between them.
    """
    a, b = polar_spectrum(ref), polar_spectrum(img)
    score = np.fft.ifft((np.fft.fft(a, axis=0) * np.conj(np.fft.fft(b, axis=0))).sum(axis=1)).real
    turn = np.arange(len(score)) * 180.0 / len(score)
    turn = np.where(turn >= 90, turn - 180, turn)
    coarse = float(turn[np.argmax(np.where(np.abs(turn) <= most, score, -np.inf))])
    tries = {0.0} | {round((c + 0.25 * k) * 4) / 4 for c in (coarse, -coarse) for k in range(-3, 4)}
    best = []
    for t in sorted(x for x in tries if abs(x) <= most):
        turned = transform(img, rotation_deg=t)
        dy, dx = phase_shift(ref, turned)
        moved = transform(turned, dy, dx)
        best.append((max(pearson(ref, turned), pearson(ref, moved)), -abs(t), t))
    r, _, t = max(best)
    return float(t), float(r)


def match_triangles(a: list[dict], b: list[dict], most: int = 50, tolerance: float = 0.01) -> dict | None:
    """Similarity that maps star list a onto b by triangles of the brightest stars (`most` control points).

    Each star makes triangles with its five nearest neighbours, so their number
    grows with the stars and not with their cube. Triangles agree if their side ratios do; votes for star pairs select control
    points, and a least-squares similarity is fitted to them. None with fewer
    than three pairs.
    """
    from itertools import combinations

    def triangles(stars: list[dict]) -> list[tuple[float, float, tuple[int, ...]]]:
        p = np.array([(s["x"], s["y"]) for s in stars[:most]])
        out = []
        near = np.argsort(np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)), axis=1, kind="stable")[:, :6] if len(p) else []
        # The ten brightest stars are joined to each other as well: they are in both lists most surely.
        every = {c for own in near for c in combinations(sorted(own.tolist()), 3)} | set(combinations(range(min(len(p), 10)), 3))
        for idx in sorted(every):
            sides = sorted((float(np.hypot(*(p[idx[i]] - p[idx[j]]))), 3 - i - j) for i, j in ((0, 1), (0, 2), (1, 2)))
            if sides[0][0] > 1e-9:
                # Vertices in the order of their opposite sides.
                out.append((sides[0][0] / sides[2][0], sides[1][0] / sides[2][0], tuple(idx[s[1]] for s in sides)))
        return out

    ta, tb = triangles(a), triangles(b)
    if not ta or not tb:
        return None
    kb = np.array([t[:2] for t in tb])
    votes: dict[tuple[int, int], int] = {}
    for r0, r1, ia in ta:
        for k in np.flatnonzero((np.abs(kb[:, 0] - r0) < tolerance) & (np.abs(kb[:, 1] - r1) < tolerance)):
            for u, v in zip(ia, tb[k][2]):
                votes[u, v] = votes.get((u, v), 0) + 1
    pairs, seen_a, seen_b = [], set(), set()
    for (u, v), _ in sorted(votes.items(), key=lambda t: (-t[1], t[0])):
        if u not in seen_a and v not in seen_b:
            pairs.append((u, v))
            seen_a.add(u)
            seen_b.add(v)
    for _ in range(3):
        if len(pairs) < 3:
            return None
        p = np.array([complex(a[u]["x"], a[u]["y"]) for u, _ in pairs])
        q = np.array([complex(b[v]["x"], b[v]["y"]) for _, v in pairs])
        m = np.linalg.lstsq(np.stack([p, np.ones(len(p))], axis=1), q, rcond=None)[0]
        err = np.abs(m[0] * p + m[1] - q)
        good = err <= max(2.0, 3 * np.median(err))
        if good.all():
            break
        pairs = [x for x, g in zip(pairs, good) if g]
    return {"scale": float(abs(m[0])), "rotation_deg": float(np.degrees(np.angle(m[0]))), "dx": float(m[1].real), "dy": float(m[1].imag), "points": len(pairs)}


def structure_enhancement(img: np.ndarray, amount: float = 0.5, radius: float = 2.0) -> np.ndarray:
    """Unsharp mask where the signal lies between the background and the brightest half per cent."""
    med = np.median(img)
    floor, ceil = med + 2 * np.median(np.abs(img - med)), np.quantile(img, 0.995)
    if ceil <= floor:
        return img
    t = np.clip((img - floor) / (ceil - floor), 0, 1)
    gate = 1 - np.abs(2 * t - 1)
    return np.maximum(img + amount * gate * (img - gaussian_blur(img, radius)), 0)


def aperture_fluxes(img: np.ndarray, stars: list[dict], radius: float) -> list[list[float]]:
    """Sum per channel within a circle around each star, background (median) removed; only a box around each is looked at."""
    planes = img[:, :, None] if img.ndim == 2 else img
    h, w = planes.shape[:2]
    med = np.median(planes.reshape(-1, planes.shape[2]), axis=0)
    out = []
    for s in stars:
        y0, y1 = max(0, int(np.floor(s["y"] - radius))), min(h, int(np.ceil(s["y"] + radius)) + 1)
        x0, x1 = max(0, int(np.floor(s["x"] - radius))), min(w, int(np.ceil(s["x"] + radius)) + 1)
        y, x = np.mgrid[y0:y1, x0:x1]
        inside = np.hypot(y - s["y"], x - s["x"]) <= radius
        out.append((planes[y0:y1, x0:x1] - med)[inside].sum(axis=0).tolist())
    return out


def photometry(img: np.ndarray, k: float = 3.0, min_area: int = 5, min_stars: int = 5) -> list[dict]:
    """x, y, r, g, b of the stars of a colour image; none with fewer than min_stars.

    Stars are found on the mean of the channels; the aperture's radius is the root of their median area, at least 3.
    """
    stars = detect_stars(img.mean(axis=2), k, k, min_area)
    if len(stars) < min_stars:
        return []
    radius = max(3.0, float(np.sqrt(np.median([s["area"] for s in stars]))))
    return [{"x": s["x"], "y": s["y"], **dict(zip("rgb", f))} for s, f in zip(stars, aperture_fluxes(img, stars, radius))]


def centroid_shift(ref: np.ndarray, img: np.ndarray, quantile: float = 0.999, least: int = 10) -> tuple[float, float, str]:
    """dy, dx that move img onto ref by the centres of their brightest pixels; by phase correlation if either has too few."""
    ends = []
    for a in (ref, img):
        y, x = np.nonzero(a >= np.quantile(a, quantile))
        if len(y) < least:
            return (*phase_shift(ref, img), "phase")
        ends.append((y.mean(), x.mean()))
    return float(ends[0][0] - ends[1][0]), float(ends[0][1] - ends[1][1]), "centroid"


def kernel_weight(d: np.ndarray, kind: str, radius: float) -> np.ndarray:
    """Weight at a distance: lanczos3, gaussian or tophat."""
    if kind == "lanczos3":
        return np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0.0)
    if kind == "gaussian":
        return np.exp(-0.5 * (d / max(radius / 2, 1e-9)) ** 2)
    return (np.abs(d) <= radius).astype(float)


def tensors_of_vectors(df: DataFrame, keep: list[str], data: str, h: int, w: int, ch: int = 1) -> DataFrame:
    """Fixed-size arrays as tensor rows."""
    return df.select(*keep, F.lit(h).alias("h"), F.lit(w).alias("w"), F.lit(ch).alias("ch"), F.col(data).alias("data"))
