"""Scale-invariant local features of grey images in numpy, after Lowe (2004), and PCA descriptors after Ke and Sukthankar (2004)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

#: Fixed values of the detector and the descriptor.
INTERVALS, SIGMA, INITIAL_SIGMA = 3, 1.6, 0.5
CONTRAST, CURVATURE, BORDER, STEPS = 0.04, 10.0, 5, 5
BINS, ORIENTATION_SIGMA, PASSES, PEAK = 36, 1.5, 2, 0.8
GRID, DIRECTIONS, CELL, CLIP, SCALE = 4, 8, 3.0, 0.2, 512.0
PATCH, COMPONENTS = 39, 36
#: The bins before and after each one of the circle.
BEFORE, AFTER = np.roll(np.arange(BINS), 1), np.roll(np.arange(BINS), -1)


@dataclass
class Keypoint:
    octave: int
    interval: int
    row: int
    column: int
    sub: float
    x: float
    y: float
    scale: float
    in_octave: float
    contrast: float
    curvature: float
    orientation: float = 0.0


def decode_pnm(data: bytes) -> np.ndarray:
    """Grey samples from 0 to 1 of a binary PGM or PPM image."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    kind, (width, height, top) = fields[0], map(int, fields[1:])
    bands = {b"P5": 1, b"P6": 3}[kind]
    pixels = np.frombuffer(data, "u1" if top < 256 else ">u2", width * height * bands, at + 1).reshape(height, width, bands).astype(float)
    grey = pixels[:, :, 0] if bands == 1 else pixels @ np.array([0.299, 0.587, 0.114])
    return grey / top


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, int(np.ceil(4 * sigma)))
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    for axis in (0, 1):
        n = image.shape[axis]
        wide = np.take(image, np.minimum(np.maximum(np.arange(-radius, n + radius), 0), n - 1), axis)
        windows = np.ndarray((*image.shape, len(kernel)), wide.dtype, wide, strides=(*wide.strides, wide.strides[axis]))
        image = windows @ kernel
    return image


def doubled(image: np.ndarray) -> np.ndarray:
    """Twice the size, linear between pixel centers."""
    for axis in (0, 1):
        n = image.shape[axis]
        place = np.clip((np.arange(2 * n) + 0.5) / 2 - 0.5, 0, n - 1)
        low = np.floor(place).astype(int)
        share = (place - low).reshape([-1 if a == axis else 1 for a in (0, 1)])
        image = np.take(image, low, axis) * (1 - share) + np.take(image, np.minimum(low + 1, n - 1), axis) * share
    return image


def pyramid(image: np.ndarray, double: bool = True) -> list[np.ndarray]:
    """Octaves of INTERVALS + 3 blurred images."""
    start = doubled(image) if double else image
    known = INITIAL_SIGMA * (2 if double else 1)
    base = blur(start, max(0.01, SIGMA**2 - known**2) ** 0.5)
    step, out = 2 ** (1 / INTERVALS), []
    for _ in range(max(1, int(np.log2(min(base.shape))) - 2)):
        octave = [base]
        for i in range(1, INTERVALS + 3):
            octave.append(blur(octave[-1], SIGMA * step ** (i - 1) * (step * step - 1) ** 0.5))
        out.append(np.stack(octave))
        base = octave[INTERVALS][::2, ::2]
        if min(base.shape) < 2 * BORDER + 3:
            break
    return out


#: The 27 places of a 3 x 3 x 3 cube as steps from its middle.
CUBE = np.stack(np.meshgrid(*[np.arange(-1, 2)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)


def _cubes(dog: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Points x 27: the values around places (i, r, c)."""
    steps = np.array([dog.shape[1] * dog.shape[2], dog.shape[2], 1])
    return dog.reshape(-1)[(at @ steps)[:, None] + CUBE @ steps]


def _tops(dog: np.ndarray) -> np.ndarray:
    """Places (i, r, c), in order, whose value is the largest over 0 or the least under 0 of its cube and strong enough; most fail by a neighbour along an axis."""
    middle = dog[1:-1, 1:-1, 1:-1]
    strong = np.abs(middle) > 0.5 * CONTRAST / INTERVALS
    high, low = strong & (middle > 0), strong & (middle < 0)
    for axis in range(3):
        for side in (slice(None, -2), slice(2, None)):
            near = dog[tuple(side if a == axis else slice(1, -1) for a in range(3))]
            high &= middle >= near
            low &= middle <= near
    at = np.argwhere(high | low) + 1
    around = _cubes(dog, at)
    value = around[:, 13:14]
    return at[np.where(value[:, 0] > 0, (value >= around).all(axis=1), (value <= around).all(axis=1))]


def _refined(dog: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, np.ndarray, float] | None]:
    """Sub-pixel positions of extrema by Newton steps on the quadratic fit, all of them a step at a time."""
    out, now, left = [None] * len(at), at.copy(), np.arange(len(at))
    for _ in range(STEPS):
        if not len(left):
            break
        d = _cubes(dog, now[left]).reshape(-1, 3, 3, 3)
        g = np.stack([d[:, 1, 1, 2] - d[:, 1, 1, 0], d[:, 1, 2, 1] - d[:, 1, 0, 1], d[:, 2, 1, 1] - d[:, 0, 1, 1]], axis=1) / 2
        twice = 2 * d[:, 1, 1, 1]
        xx, yy, ss = d[:, 1, 1, 2] + d[:, 1, 1, 0] - twice, d[:, 1, 2, 1] + d[:, 1, 0, 1] - twice, d[:, 2, 1, 1] + d[:, 0, 1, 1] - twice
        xy = (d[:, 1, 2, 2] - d[:, 1, 2, 0] - d[:, 1, 0, 2] + d[:, 1, 0, 0]) / 4
        xs = (d[:, 2, 1, 2] - d[:, 2, 1, 0] - d[:, 0, 1, 2] + d[:, 0, 1, 0]) / 4
        ys = (d[:, 2, 2, 1] - d[:, 2, 0, 1] - d[:, 0, 2, 1] + d[:, 0, 0, 1]) / 4
        curves = np.stack([xx, xy, xs, xy, yy, ys, xs, ys, ss], axis=1).reshape(-1, 3, 3)
        offset = (-np.linalg.pinv(curves) @ g[:, :, None])[:, :, 0]
        done = (np.abs(offset) < 0.5).all(axis=1)
        for k in np.flatnonzero(done):
            out[left[k]] = (*now[left[k]].tolist(), offset[k], float(d[k, 1, 1, 1] + g[k] @ offset[k] / 2))
        now[left] += np.clip(np.rint(offset), -9, 9).astype(int)[:, ::-1]
        i, r, c = now[left].T
        inside = (i >= 1) & (i <= INTERVALS) & (r >= BORDER) & (r < dog.shape[1] - BORDER) & (c >= BORDER) & (c < dog.shape[2] - BORDER)
        left = left[~done & inside]
    return out


def _around(dog: np.ndarray, most: np.ufunc) -> np.ndarray:
    """The largest or least value of the 3 x 3 x 3 cube around each inner place, axis by axis: what ``_tops`` compares with, for every place."""
    rows = most(most(dog[:, :, :-2], dog[:, :, 1:-1]), dog[:, :, 2:])
    planes = most(most(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])
    return most(most(planes[:-2], planes[1:-1]), planes[2:])


def extrema(octaves: list[np.ndarray], double: bool = True) -> list[Keypoint]:
    """Stable extrema of the differences of neighbouring scales."""
    out = []
    for o, octave in enumerate(octaves):
        dog = np.diff(octave, axis=0)
        if min(dog.shape[1:]) <= 2 * BORDER:
            continue
        found = _tops(dog)
        found = found[((found[:, 1:] >= BORDER) & (found[:, 1:] < np.array(dog.shape[1:]) - BORDER)).all(axis=1)]
        seen = set()
        for at in _refined(dog, found):
            if at is None:
                continue
            i, r, c, offset, value = at
            if abs(value) < CONTRAST / INTERVALS or (i, r, c) in seen:
                continue
            d = dog[i]
            xx, yy = d[r, c + 1] + d[r, c - 1] - 2 * d[r, c], d[r + 1, c] + d[r - 1, c] - 2 * d[r, c]
            xy = (d[r + 1, c + 1] - d[r + 1, c - 1] - d[r - 1, c + 1] + d[r - 1, c - 1]) / 4
            det, trace = xx * yy - xy * xy, xx + yy
            if det <= 0 or trace * trace / det >= (CURVATURE + 1) ** 2 / CURVATURE:
                continue
            seen.add((i, r, c))
            half = 0.5 if double else 1.0
            inside = SIGMA * 2 ** ((i + offset[2]) / INTERVALS)
            out.append(Keypoint(o, int(i), int(r), int(c), float(offset[2]), float((c + offset[0]) * 2**o * half), float((r + offset[1]) * 2**o * half), float(inside * 2**o * half), float(inside), abs(value), float(trace * trace / det)))
    return out


def selected(points: list[Keypoint], most: int, weight: float = 0.5, seed: int = 0) -> list[Keypoint]:
    """The ``most`` points with the least weighted, normalised 1/contrast and curvature; a weight of -1 takes a random set."""
    if len(points) <= most:
        return points
    if weight == -1:
        return [points[i] for i in sorted(np.random.default_rng(seed).permutation(len(points))[:most])]

    def normal(v):
        v = np.asarray(v) - np.mean(v)
        size = np.sqrt((v * v).sum())
        return (v / (size or 1) + 1) / 2

    score = weight * normal([1 / p.contrast for p in points]) + (1 - weight) * normal([p.curvature for p in points])
    return [points[i] for i in np.lexsort((np.arange(len(points)), score))[:most]]


@cache
def _grid(radius: int) -> tuple[np.ndarray, np.ndarray]:
    r, c = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return r, c


def _gradient(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dx, dy = np.zeros_like(image), np.zeros_like(image)
    dx[1:-1, 1:-1] = image[1:-1, 2:] - image[1:-1, :-2]
    dy[1:-1, 1:-1] = image[:-2, 1:-1] - image[2:, 1:-1]
    return np.hypot(dx, dy), np.arctan2(dy, dx)


def orientations(point: Keypoint, size: np.ndarray, angle: np.ndarray) -> list[float]:
    """Angles of the smoothed histogram's peaks, the strongest first, down to PEAK of it."""
    sigma = ORIENTATION_SIGMA * point.in_octave
    radius = int(round(3 * sigma))
    r, c = _grid(radius)
    y, x = point.row + r, point.column + c
    use = (y > 0) & (y < size.shape[0] - 1) & (x > 0) & (x < size.shape[1] - 1)
    weight = np.exp(-(r[use] ** 2 + c[use] ** 2) / (2 * sigma * sigma)) * size[y[use], x[use]]
    place = np.rint(BINS * (angle[y[use], x[use]] + np.pi) / (2 * np.pi)).astype(int) % BINS
    h = np.bincount(place, weights=weight, minlength=BINS)
    for _ in range(PASSES):
        h = 0.25 * h[BEFORE] + 0.5 * h + 0.25 * h[AFTER]
    left, right = h[BEFORE], h[AFTER]
    peaks = np.flatnonzero((h > left) & (h > right) & (h >= PEAK * h.max()))
    out = []
    for k in sorted(peaks, key=lambda k: (-h[k], k)):
        exact = (k + 0.5 * (left[k] - right[k]) / (left[k] - 2 * h[k] + right[k])) % BINS
        out.append(float(2 * np.pi * exact / BINS - np.pi))
    return out


def descriptor(point: Keypoint, size: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """GRID x GRID x DIRECTIONS histogram of gradients around a keypoint, as whole numbers up to 255."""
    cell = CELL * point.in_octave
    radius = int(cell * 2**0.5 * (GRID + 1) * 0.5 + 0.5)
    r, c = _grid(radius)
    cos, sin = np.cos(point.orientation), np.sin(point.orientation)
    cr, rr = (c * cos - r * sin) / cell, (c * sin + r * cos) / cell
    rb, cb = rr + GRID / 2 - 0.5, cr + GRID / 2 - 0.5
    y, x = point.row + r, point.column + c
    use = (rb > -1) & (rb < GRID) & (cb > -1) & (cb < GRID) & (y > 0) & (y < size.shape[0] - 1) & (x > 0) & (x < size.shape[1] - 1)
    rb, cb = rb[use], cb[use]
    turn = np.mod(angle[y[use], x[use]] - point.orientation, 2 * np.pi) * DIRECTIONS / (2 * np.pi)
    mass = size[y[use], x[use]] * np.exp(-(cr[use] ** 2 + rr[use] ** 2) / (0.5 * GRID * GRID))
    r0, c0, d0 = np.floor(rb).astype(int), np.floor(cb).astype(int), np.floor(turn).astype(int)
    rows, columns, turns = ([np.abs(1 - i - (x - x0)) for i in (0, 1)] for x, x0 in ((rb, r0), (cb, c0), (turn, d0)))
    first = ((r0 + 1) * (GRID + 2) + c0 + 1) * DIRECTIONS
    ways = d0 % DIRECTIONS, (d0 + 1) % DIRECTIONS
    cells, shares = np.empty((8, len(first)), "int64"), np.empty((8, len(first)))
    for i in (0, 1):
        for j in (0, 1):
            corner, both = first + (i * (GRID + 2) + j) * DIRECTIONS, rows[i] * columns[j]
            for k in (0, 1):
                np.add(corner, ways[k], out=cells[4 * i + 2 * j + k])
                np.multiply(mass, both * turns[k], out=shares[4 * i + 2 * j + k])
    h = np.bincount(cells.reshape(-1), shares.reshape(-1), (GRID + 2) ** 2 * DIRECTIONS).reshape(GRID + 2, GRID + 2, DIRECTIONS)
    return whole_numbers(h[1:-1, 1:-1].reshape(-1))


def whole_numbers(v: np.ndarray) -> np.ndarray:
    """A histogram of unit length, clipped, of unit length again, as whole numbers up to 255."""
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    return np.minimum(255, (SCALE * unit(np.minimum(unit(v), CLIP))).astype(int))


def gradient_patch(point: Keypoint, image: np.ndarray) -> np.ndarray:
    """Unit vector of the 39 x 39 x 2 gradients of the turned patch around a keypoint."""
    half = (PATCH + 1) // 2
    grid = np.arange(-half, half + 1) * point.in_octave * 2 / half * 1.5
    cos, sin = np.cos(point.orientation), np.sin(point.orientation)
    x, y = np.meshgrid(grid, grid)
    px = np.clip(point.column + x * cos + y * sin, 0, image.shape[1] - 1.001)
    py = np.clip(point.row - x * sin + y * cos, 0, image.shape[0] - 1.001)
    x0, y0 = px.astype(int), py.astype(int)
    fx, fy = px - x0, py - y0
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    patch = image[y0, x0] * (1 - fx) * (1 - fy) + image[y0, x1] * fx * (1 - fy) + image[y1, x0] * (1 - fx) * fy + image[y1, x1] * fx * fy
    v = np.concatenate([(patch[1:-1, 2:] - patch[1:-1, :-2]).reshape(-1), (patch[2:, 1:-1] - patch[:-2, 1:-1]).reshape(-1)])
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def learn_basis(patches: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal directions of gradient patches."""
    mean = patches.mean(axis=0)
    return mean, np.linalg.svd(patches - mean, full_matrices=False)[2][:components]


def features(image: np.ndarray, most: int = 100, weight: float = 0.5, double: bool = True, kind: str = "sift", basis: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[Keypoint, np.ndarray]]:
    """Keypoints with descriptors, the largest scale first.

    Every keypoint has its strongest orientation; further peaks make keypoints only while there are fewer than ``most``.
    Kinds: ``sift``, ``patch`` (the gradient patch itself) and ``pca`` (the patch on ``basis``).
    """
    octaves = pyramid(image, double)
    points, gradients, main, more = selected(extrema(octaves, double), most, weight), {}, [], []
    for p in points:
        if (p.octave, p.interval) not in gradients:
            gradients[p.octave, p.interval] = _gradient(octaves[p.octave][p.interval])
        for k, angle in enumerate(orientations(p, *gradients[p.octave, p.interval]) or [0.0]):
            (more if k else main).append(Keypoint(**{**p.__dict__, "orientation": angle}))
    chosen = main + more[: max(0, most - len(main))]
    chosen.sort(key=lambda p: (-p.scale, p.y, p.x, p.orientation))
    out = []
    for p in chosen:
        if kind == "sift":
            out.append((p, descriptor(p, *gradients[p.octave, p.interval])))
        else:
            patch = gradient_patch(p, octaves[p.octave][p.interval])
            out.append((p, patch if kind == "patch" else basis[1] @ (patch - basis[0])))
    return out
