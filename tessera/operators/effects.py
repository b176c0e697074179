"""Further per-pixel and per-image effects.

What is a function of a pixel, of its place or of a small neighbourhood is an expression; what walks over
a whole image (edge-preserving filters, thinning, distances, error diffusion) runs in numpy, many whole images a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.core import QR, column
from tessera.functions import colors
from tessera.stacks import by_image, stacks, whole_images

from .geometry import sizes
from .windows import blur, convolve, near


def whole(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], key: str = "image_id") -> DataFrame:
    """A function of the whole image, a float array. A task takes many images at a time; those in STACKED do so too."""
    many = f in STACKED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_images(batches, key):
            for ids, a in stacks(table, key, ["v"]):
                a = a[..., 0]
                out = [np.asarray(o, dtype=float) for o in (f(a) if many else map(f, a))]
                y, x = (np.concatenate([np.indices(o.shape, np.int32)[i].ravel() for o in out]) for i in (0, 1))
                of = ids.take(pa.array(np.repeat(np.arange(len(out)), [o.size for o in out])))
                yield pa.RecordBatch.from_arrays([of.cast(pa.int64()), pa.array(y), pa.array(x), pa.array(np.concatenate([o.ravel() for o in out]), from_pandas=True)], names=[key, "y", "x", "v"])

    return by_image(df.select(key, "y", "x", F.col("v").cast("double").alias("v")), key).mapInArrow(run, f"{key} long, y int, x int, v double")


def _windows(a: np.ndarray, r: int) -> np.ndarray:
    """The (2r+1)^2 neighbours of each pixel, edges repeated."""
    n = 2 * r + 1
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, r, mode="edge"), (n, n)).reshape(*a.shape, n * n)


def _soft(a: np.ndarray, r: int, sigma: float) -> np.ndarray:
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    k = np.outer(k, k).ravel()
    return _windows(a, r) @ (k / k.sum())


def bilateral(a: np.ndarray, r: int = 1, tone: float = 0.1, space: float = 1.0) -> np.ndarray:
    near = _windows(a, r) / QR
    d = np.arange(-r, r + 1)
    w = np.exp(-(d[:, None] ** 2 + d[None] ** 2) / (2 * space * space)).ravel() * np.exp(-((near - a[..., None] / QR) ** 2) / (2 * tone * tone))
    return (near * w).sum(-1) / w.sum(-1) * QR


def selective_blur(a: np.ndarray, r: int = 1, sigma: float = 1.0, threshold: float = 0.1) -> np.ndarray:
    near = _windows(a, r)
    d = np.arange(-r, r + 1)
    w = np.exp(-(d[:, None] ** 2 + d[None] ** 2) / (2 * sigma * sigma)).ravel() * (np.abs(near - a[..., None]) < threshold * QR)
    return (near * w).sum(-1) / w.sum(-1)


def adaptive_blur(a: np.ndarray, sigma: float = 1.0, sharpen: bool = False) -> np.ndarray:
    """Blurs flat places more than edges, or sharpens edges more than flat places."""
    edge = np.abs(np.gradient(a, axis=0)) + np.abs(np.gradient(a, axis=1)) if min(a.shape) > 1 else np.zeros_like(a)
    share = edge / edge.max() if edge.max() else edge
    soft = _soft(a, 2, sigma)
    return a + (a - soft) * share if sharpen else a * share + soft * (1 - share)


def motion_blur(a: np.ndarray, length: int = 3, angle: float = 0.0) -> np.ndarray:
    dy, dx = math.sin(math.radians(angle)), math.cos(math.radians(angle))
    w = np.exp(-np.arange(length) ** 2 / 2.0)
    y, x = np.indices(a.shape)
    at = [a[np.clip(np.rint(y - k * dy).astype(int), 0, a.shape[0] - 1), np.clip(np.rint(x - k * dx).astype(int), 0, a.shape[1] - 1)] for k in range(length)]
    return sum(k * v for k, v in zip(w / w.sum(), at, strict=True))


def rotational_blur(a: np.ndarray, degrees: float = 20.0, steps: int = 9) -> np.ndarray:
    cy, cx = (a.shape[0] - 1) / 2, (a.shape[1] - 1) / 2
    y, x = np.indices(a.shape)
    out = np.zeros_like(a)
    for t in np.radians(np.linspace(-degrees / 2, degrees / 2, steps)):
        sy, sx = cy + (y - cy) * np.cos(t) - (x - cx) * np.sin(t), cx + (y - cy) * np.sin(t) + (x - cx) * np.cos(t)
        out += a[np.clip(np.rint(sy).astype(int), 0, a.shape[0] - 1), np.clip(np.rint(sx).astype(int), 0, a.shape[1] - 1)]
    return out / steps


def kuwahara(a: np.ndarray, r: int = 1) -> np.ndarray:
    """The mean of the least varying of the four quadrants around a pixel."""
    p = np.pad(a, r, mode="edge")
    w = np.lib.stride_tricks.sliding_window_view(p, (r + 1, r + 1))
    mean, var = w.mean((-1, -2)), w.var((-1, -2))
    h, n = a.shape
    corners = [(0, 0), (0, r), (r, 0), (r, r)]
    best = np.argmin([var[dy : dy + h, dx : dx + n] for dy, dx in corners], axis=0)
    return np.choose(best, [mean[dy : dy + h, dx : dx + n] for dy, dx in corners])


def oil_paint(a: np.ndarray, r: int = 1, levels: int = 16) -> np.ndarray:
    """The first neighbour of the most frequent intensity."""
    near = _windows(a, r)
    bins = np.minimum((near / QR * levels).astype(int), levels - 1)
    count = (bins[..., :, None] == bins[..., None, :]).sum(-1)
    return np.take_along_axis(near, count.argmax(-1)[..., None], -1)[..., 0]


def despeckle(a: np.ndarray) -> np.ndarray:
    """One round of moving each pixel towards its neighbours in four directions, up and down."""
    out = a.copy()
    step = QR / 128
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        for sign in (1, -1):
            p = np.pad(out, 1, mode="edge")
            b = p[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]] * sign
            c = p[1 - dy : 1 - dy + a.shape[0], 1 - dx : 1 - dx + a.shape[1]] * sign
            o = out * sign
            o = np.where(b >= o + 2 * step, o + step, o)
            o = np.where((c >= o + 2 * step) & (b > o), o + step, o)
            out = o * sign
    return out


def local_contrast(a: np.ndarray, r: int = 2, strength: float = 0.5) -> np.ndarray:
    soft = _soft(a, r, max(r / 2, 0.5))
    return a + (a - soft) * strength


def clahe(a: np.ndarray, tile: int = 4, bins: int = 32, clip: float = 2.0) -> np.ndarray:
    """Equalisation by tile with clipped histograms, mapped tile by tile."""
    out = a.copy()
    for y in range(0, a.shape[0], tile):
        for x in range(0, a.shape[1], tile):
            part = a[y : y + tile, x : x + tile]
            b = np.minimum((np.clip(part, 0, QR) / QR * bins).astype(int), bins - 1)
            h = np.bincount(b.ravel(), minlength=bins).astype(float)
            most = max(1.0, clip * h.sum() / bins)
            over = np.maximum(h - most, 0).sum()
            cdf = np.cumsum(np.minimum(h, most) + over / bins)
            out[y : y + tile, x : x + tile] = cdf[b] / cdf[-1] * QR
    return out


def canny(a: np.ndarray, sigma: float = 1.0, low: float = 0.1, high: float = 0.3) -> np.ndarray:
    """Edges: gradient, thinning along it, and growth from strong to weak ones."""
    soft = np.pad(_soft(a, 1, sigma), 1, mode="edge")
    gy, gx = (soft[2:, 1:-1] - soft[:-2, 1:-1]) / 2, (soft[1:-1, 2:] - soft[1:-1, :-2]) / 2
    m = np.hypot(gy, gx)
    d = (np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int)) % 4
    p = np.pad(m, 1)
    ahead = [(0, 1), (1, 1), (1, 0), (1, -1)]
    keep = np.zeros(m.shape, bool)
    for k, (dy, dx) in enumerate(ahead):
        b, c = p[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]], p[1 - dy : 1 - dy + m.shape[0], 1 - dx : 1 - dx + m.shape[1]]
        keep |= (d == k) & (m >= b) & (m >= c)
    m = np.where(keep, m, 0)
    strong, weak = m > high * m.max() if m.max() else keep & False, m > low * m.max()
    while True:
        grown = weak & (np.lib.stride_tricks.sliding_window_view(np.pad(strong, 1), (3, 3)).any((-1, -2)))
        if (grown == strong).all():
            return grown * QR
        strong = grown | strong


def mean_shift(a: np.ndarray, r: int = 1, distance: float = 0.1, rounds: int = 10) -> np.ndarray:
    out = a.copy()
    for _ in range(rounds):
        near = _windows(out, r)
        ok = np.abs(near - out[..., None]) <= distance * QR
        out = (near * ok).sum(-1) / ok.sum(-1)
    return out


def wavelet_denoise(a: np.ndarray, threshold: float = 0.05, levels: int = 3) -> np.ndarray:
    """Holes in a dyadic smoothing; details below the threshold go."""
    out, rest = np.zeros_like(a), a.copy()
    for k in range(levels):
        s = 1 << k
        p = np.pad(rest, ((s, s), (0, 0)), mode="edge")
        soft = (p[: -2 * s] + 2 * p[s:-s] + p[2 * s :]) / 4
        p = np.pad(soft, ((0, 0), (s, s)), mode="edge")
        soft = (p[:, : -2 * s] + 2 * p[:, s:-s] + p[:, 2 * s :]) / 4
        detail = rest - soft
        out += np.sign(detail) * np.maximum(np.abs(detail) - threshold * QR, 0)
        rest = soft
    return out + rest


def distance(a: np.ndarray, euclidean: bool = False) -> np.ndarray:
    """How far each bright pixel is from the next dark one or the outside, in whole steps or as the crow flies."""
    dark = np.argwhere(np.pad(a <= QR / 2, 1, constant_values=True))
    at = np.argwhere(np.ones(a.shape, bool)) + 1
    d = at[:, None] - dark[None]
    far = np.sqrt((d**2).sum(-1)) if euclidean else np.abs(d).max(-1)
    return far.min(1).reshape(a.shape)


def hit_and_miss(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """max(0, least of the cells of 1 - largest of the cells of 0); cells of NaN don't count. One image or a stack of them."""
    r = kernel.shape[0] // 2
    h, w = a.shape[-2:]
    p = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(r, r)] * 2, mode="edge")
    fore, back = np.full(a.shape, QR), np.zeros(a.shape)
    for side, cells, best in ((fore, kernel > 0.7, np.minimum), (back, kernel < 0.3, np.maximum)):
        for i, (dy, dx) in enumerate(np.argwhere(cells)):
            own = p[..., dy : dy + h, dx : dx + w]
            side[...] = best(side, own) if i else own
    return np.maximum(0, fore - back)


_X = np.nan
_EDGE = np.array([[0, 0, 0], [_X, 1, _X], [1, 1, 1]])
_CORNER = np.array([[_X, 0, 0], [1, 1, 0], [_X, 1, _X]])


def thinning(a: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Peels edges off until only lines are left. One image or a stack of them; what a round leaves as it was, later ones do too."""
    out = a.copy()
    for _ in range(rounds):
        before = out.copy()
        for k in range(4):
            for kernel in (_EDGE, _CORNER):
                out = out - hit_and_miss(out, np.rot90(kernel, k))
        if (before == out).all():
            break
    return out


def diffuse(a: np.ndarray, levels: int = 2) -> np.ndarray:
    """Fewer levels with the error passed on to the right and below."""
    out = a.astype(float).copy()
    h, w = out.shape
    for y in range(h):
        for x in range(w):
            old = out[y, x]
            new = np.floor(np.clip(old, 0, QR) / QR * (levels - 1) + 0.5) / (levels - 1) * QR
            out[y, x] = new
            for dy, dx, k in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                if y + dy < h and 0 <= x + dx < w:
                    out[y + dy, x + dx] += (old - new) * k / 16
    return out


def seam_carve(a: np.ndarray, columns: int = 1) -> np.ndarray:
    """Takes the seams of least energy out, one column at a time."""
    for _ in range(columns):
        e = np.abs(np.diff(a, axis=1, append=a[:, -1:])) + np.abs(np.diff(a, axis=0, append=a[-1:]))
        cost = e.copy()
        for y in range(1, len(a)):
            p = np.pad(cost[y - 1], 1, constant_values=np.inf)
            cost[y] += np.minimum(np.minimum(p[:-2], p[1:-1]), p[2:])
        x = int(cost[-1].argmin())
        keep = np.ones(a.shape, bool)
        for y in reversed(range(len(a))):
            keep[y, x] = False
            if y:
                low = max(0, x - 1)
                x = low + int(cost[y - 1, low : x + 2].argmin())
        a = a[keep].reshape(a.shape[0], -1)
    return a


#: Effects that see a whole image.
WHOLE: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "bilateral_blur": bilateral, "selective_blur": selective_blur, "adaptive_blur": adaptive_blur, "adaptive_sharpen": lambda a: adaptive_blur(a, sharpen=True), "motion_blur": motion_blur, "rotational_blur": rotational_blur, "kuwahara": kuwahara, "oil_paint": oil_paint,
    "despeckle": despeckle, "local_contrast": local_contrast, "clahe": clahe, "canny": canny, "mean_shift": mean_shift, "wavelet_denoise": wavelet_denoise, "distance_chebyshev": distance, "distance_euclidean": lambda a: distance(a, True), "thinning": thinning, "diffuse": diffuse, "seam_carve": seam_carve,
}


#: Those of them that take a stack of images.
STACKED = {thinning}


def gradient(df: DataFrame, radial: bool = False) -> DataFrame:
    """From 0 at the top to QR at the bottom, or from QR in the middle outwards."""
    s = sizes(df)
    if not radial:
        return s.withColumn("v", QR * F.col("y") / F.greatest(F.col("h") - 1, F.lit(1))).drop("h", "w")
    d = F.sqrt(F.pow((F.col("x") - (F.col("w") - 1) / 2.0) / (F.col("w") / 2.0), F.lit(2.0)) + F.pow((F.col("y") - (F.col("h") - 1) / 2.0) / (F.col("h") / 2.0), F.lit(2.0)))
    return s.withColumn("v", QR * F.greatest(1 - d, F.lit(0.0))).drop("h", "w")


def noise(df: DataFrame, kind: str, attenuate: float = 1.0, seed: int = 1) -> DataFrame:
    """Seeded noise: the same rows in the same partitions get the same samples."""
    u, n = F.rand(seed), F.randn(seed + 1)
    out = {
        "uniform": F.col("v") + attenuate * 4000 * (u - 0.5), "gaussian": F.col("v") + attenuate * 1500 * n, "multiplicative": F.col("v") * (1 + attenuate * 0.1 * n), "laplacian": F.col("v") - attenuate * 1500 * F.signum(u - 0.5) * F.log(1 - 2 * F.abs(u - 0.5) + 1e-9),
        "impulse": F.when(u < 0.05 * attenuate, 0.0).when(u > 1 - 0.05 * attenuate, QR).otherwise(F.col("v")), "poisson": F.col("v") + attenuate * n * F.sqrt(F.greatest(F.col("v"), F.lit(0.0)) * 16), "random": u * QR,
    }[kind]
    return df.withColumn("v", out)


def spread(df: DataFrame, radius: int = 1, seed: int = 1, key: str = "image_id") -> DataFrame:
    """Each pixel from a random place near it."""
    s = sizes(df, key).withColumns({"ry": F.floor(F.rand(seed) * (2 * radius + 1)) - radius, "rx": F.floor(F.rand(seed + 1) * (2 * radius + 1)) - radius})
    at = s.select(key, "y", "x", F.expr("int(greatest(0, least(h - 1, y + ry)))").alias("ny"), F.expr("int(greatest(0, least(w - 1, x + rx)))").alias("nx"))
    there = df.select(key, F.col("y").alias("ny"), F.col("x").alias("nx"), "v")
    return at.join(there, [key, "ny", "nx"]).select(key, "y", "x", "v")


#: Threshold maps: rows of thresholds, and what they are divided by.
DITHERS = {"checks": ([[1, 2], [2, 1]], 3), "o2x2": ([[1, 3], [4, 2]], 5), "o3x3": ([[3, 7, 4], [6, 1, 9], [2, 8, 5]], 10), "o4x4": ([[1, 9, 3, 11], [13, 5, 15, 7], [4, 12, 2, 10], [16, 8, 14, 6]], 17)}


def ordered_dither(df: DataFrame, name: str) -> DataFrame:
    rows, divisor = DITHERS[name]
    n = len(rows)
    cells = F.array(*(F.lit(t / divisor) for row in rows for t in row))
    at = F.get(cells, (F.col("y") % n * n + F.col("x") % n).cast("int"))
    return df.withColumn("v", F.when(F.col("v") / QR > at, QR).otherwise(0.0))


def clut(df: DataFrame, table: list[float]) -> DataFrame:
    """Samples through a lookup table, interpolated."""
    cells = F.array(*(F.lit(float(t)) for t in table))
    place = F.least(F.greatest(F.col("v") / QR, F.lit(0.0)), F.lit(1.0)) * (len(table) - 1)
    low = F.least(F.floor(place), F.lit(max(0, len(table) - 2))).cast("int")
    return df.withColumn("v", F.get(cells, low) + (place - low) * (F.get(cells, F.least(low + 1, F.lit(len(table) - 1))) - F.get(cells, low)))


def modulate(df: DataFrame, brightness: float, saturation: float, hue: float) -> DataFrame:
    """r, g, b (0 to 1) through HSL: hue turned, saturation and lightness scaled, all in percent."""
    h, s, l = (F.expr(e) for e in colors.forward("hsl"))  # noqa: E741
    turned = df.withColumns({"c0": (h + hue / 200.0 - 0.5) - F.floor(h + hue / 200.0 - 0.5), "c1": F.least(s * (saturation / 100.0), F.lit(1.0)), "c2": F.least(l * (brightness / 100.0), F.lit(1.0))})
    return turned.withColumns(dict(zip("rgb", map(F.expr, colors.inverse("hsl")), strict=True))).drop("c0", "c1", "c2")


def magnify(df: DataFrame, key: str = "image_id") -> DataFrame:
    """Scale2x: each pixel becomes four, that take after the neighbours where these agree."""
    pixels, samples = near(df, [(-1, 0), (0, 1), (0, -1), (1, 0), (0, 0)], key=key)
    p = pixels.select(key, "y", "x", *(s["n"].alias(n) for s, n in zip(samples, "abcdp", strict=True)))
    pick = lambda s, t, u, w: F.when((F.col(s) == F.col(t)) & (F.col(s) != F.col(w)) & (F.col(t) != F.col(u)), F.col(t)).otherwise(F.col("p"))
    four = F.array(
        F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dx"), pick("c", "a", "b", "d").alias("v")), F.struct(F.lit(0).alias("dy"), F.lit(1).alias("dx"), pick("a", "b", "d", "c").alias("v")),
        F.struct(F.lit(1).alias("dy"), F.lit(0).alias("dx"), pick("d", "c", "a", "b").alias("v")), F.struct(F.lit(1).alias("dy"), F.lit(1).alias("dx"), pick("b", "d", "c", "a").alias("v")),
    )
    return p.select(key, "y", "x", F.explode(four).alias("f")).select(key, (F.col("y") * 2 + F.col("f.dy")).alias("y"), (F.col("x") * 2 + F.col("f.dx")).alias("x"), F.col("f.v").alias("v"))


def vignette(df: DataFrame, inner: float = 0.5) -> DataFrame:
    """Darkens towards the corners from a share of the way out."""
    d = F.sqrt(F.pow((F.col("x") - (F.col("w") - 1) / 2.0) / (F.col("w") / 2.0), F.lit(2.0)) + F.pow((F.col("y") - (F.col("h") - 1) / 2.0) / (F.col("h") / 2.0), F.lit(2.0)))
    return sizes(df).withColumn("v", F.col("v") * F.least(F.greatest((1.5 - d) / (1.5 - inner), F.lit(0.0)), F.lit(1.0))).drop("h", "w")


def charcoal(df: DataFrame, key: str = "image_id") -> DataFrame:
    """Edges, blurred, stretched and inverted."""
    edges = convolve(df, [[-1.0] * 3, [-1.0, 8.0, -1.0], [-1.0] * 3], key)
    soft = blur(edges.withColumn("v", F.abs(F.col("v"))), 1, 1.0, key)
    m = soft.groupBy(key).agg(F.max("v").alias("m"))
    return soft.join(m, key).withColumn("v", QR - F.when(F.col("m") > 0, QR * F.col("v") / F.col("m")).otherwise(0.0)).drop("m")


def stegano(df: DataFrame, mark: Column) -> DataFrame:
    """The lowest of 16 bits of each sample becomes a bit of the mark."""
    return df.withColumn("v", (F.floor(F.col("v") / 2) * 2 + mark.cast("int")).cast("double"))


def sepia(threshold: float, r: str = "r", g: str = "g", b: str = "b") -> tuple[Column, Column, Column]:
    """Brown tones by intensity (0 to 1)."""
    i = f"(0.212656 * {r} + 0.715158 * {g} + 0.072186 * {b})"
    return tuple(column(t, i=i, t=threshold) for t in ("CASE WHEN {i} > {t} THEN 1.0 ELSE {i} + 1.0 - {t} END", "CASE WHEN {i} > 7.0 * {t} / 6.0 THEN 1.0 ELSE {i} + 1.0 - 7.0 * {t} / 6.0 END", "CASE WHEN {i} < {t} / 6.0 THEN 0.0 ELSE {i} - {t} / 6.0 END"))
