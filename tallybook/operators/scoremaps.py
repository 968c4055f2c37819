"""Text boxes from a detector's score maps: connected regions over a threshold, their smallest rectangles, widened.

One Arrow-batched pass over maps, each an array of scores by rows; a region is kept when its rectangle is thick enough and
its scores are high on average.  Maps are independent; a task holds one batch of them.  The runs of all maps of a slice are
found and joined together, upright rectangles at once; only regions of another shape are looked at one by one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Score of a pixel and of a region, widening, least side in pixels, most regions of a map (fixed values).
PIXEL, REGION, WIDEN, SIDE, MOST = 0.3, 0.6, 1.5, 3.0, 1000
#: Pixels of the maps that are looked at together.
SLICE = 1 << 20


def joined(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each run, by row and start, the first run of its 8-connected region."""
    step = int(end.max(initial=0)) + 3
    low = np.searchsorted(row * step + end, (row - 1) * step + start - 1, "left")
    high = np.searchsorted(row * step + start, (row - 1) * step + end + 1, "right")
    n = np.maximum(high - low, 0)
    below = np.repeat(np.arange(len(row)), n)
    above = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    owner = np.arange(len(row))
    while True:
        a, b = owner[above], owner[below]
        apart = a != b
        if not apart.any():
            return owner
        np.minimum.at(owner, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = owner[owner]
            if np.array_equal(up, owner):
                break
            owner = up


def regions(lit: np.ndarray) -> list[np.ndarray]:
    """For each 8-connected region of one map the ends of its runs (x, y), regions in the order of their first pixel."""
    edge = np.diff(np.pad(lit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1] - 1
    names = joined(y, start, end)
    order = np.argsort(names, kind="stable")
    cuts = np.flatnonzero(np.diff(names[order])) + 1
    return [np.concatenate([np.stack([start[g], y[g]], 1), np.stack([end[g], y[g]], 1)]).astype(float) for g in np.split(order, cuts)] if len(y) else []


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise, without points on its edges."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(sequence: np.ndarray) -> list:
        out: list = []
        for p in sequence.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def smallest_rectangle(points: np.ndarray) -> np.ndarray | None:
    """The corners of the smallest rectangle around ``points``, which has a side on an edge of their hull (ties: the first edge's)."""
    border = hull(points)
    if len(border) < 3:
        return None
    along = np.roll(border, -1, 0) - border
    u = along / np.hypot(*along.T)[:, None]
    v = np.stack([-u[:, 1], u[:, 0]], 1)
    a, b = u @ border.T, v @ border.T
    best = int(np.argmin(np.round((a.max(1) - a.min(1)) * (b.max(1) - b.min(1)), 9)))
    low, high, near, far = a[best].min(), a[best].max(), b[best].min(), b[best].max()
    return np.array([s * u[best] + t * v[best] for s, t in ((low, near), (high, near), (high, far), (low, far))])


def mean_score(scores: np.ndarray, quad: np.ndarray) -> float:
    """The mean of the scores whose pixel centres lie in a convex quad; 0 without any."""
    h, w = scores.shape
    x0, y0 = np.maximum(np.floor(quad.min(0)), 0).astype(int)
    x1, y1 = np.minimum(np.ceil(quad.max(0)).astype(int), (w - 1, h - 1))
    if x1 < x0 or y1 < y0:
        return 0.0
    x, y = np.meshgrid(np.arange(x0, x1 + 1) + 0.5, np.arange(y0, y1 + 1) + 0.5)
    side = np.stack([(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(quad, np.roll(quad, -1, 0), strict=True)])
    inside = (side >= -1e-7).all(0) | (side <= 1e-7).all(0)
    return float(scores[y0 : y1 + 1, x0 : x1 + 1][inside].mean()) if inside.any() else 0.0


def sides(quad: np.ndarray) -> tuple[float, float]:
    return float(np.hypot(*(quad[1] - quad[0]))), float(np.hypot(*(quad[2] - quad[1])))


def widened(quad: np.ndarray, ratio: float = WIDEN) -> np.ndarray:
    """The rectangle with every side moved out by its area over its perimeter times ``ratio``."""
    w, h = sides(quad)
    out = w * h * ratio / (2 * (w + h))
    u, v = (quad[1] - quad[0]) / w, (quad[2] - quad[1]) / h
    return quad + out * np.array([-u - v, u - v, u + v, v - u])


def ordered(quad: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left."""
    total, apart = quad.sum(1), quad[:, 1] - quad[:, 0]
    return quad[[int(np.argmin(total)), int(np.argmin(apart)), int(len(quad) - 1 - np.argmax(total[::-1])), int(len(quad) - 1 - np.argmax(apart[::-1]))]]


def kept(scores: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, float] | None:
    """The widened rectangle of a region of any shape, and its score; None for one that is thin or faint."""
    quad = smallest_rectangle(points)
    if quad is None or min(sides(quad)) < SIDE:
        return None
    score = mean_score(scores, quad)
    wide = widened(quad)
    return None if score < REGION or min(sides(wide)) < SIDE + 2 else (wide, score)


def found(scores: np.ndarray, starts: np.ndarray, wide: np.ndarray, tall: np.ndarray, width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maps laid end to end in ``scores`` (each from ``starts`` on, ``wide`` by ``tall``; ``width`` and ``height`` of its image): the map,
    the number, the corners in pixels of the image and the score of each box, maps in order and boxes by their first pixel."""
    size = wide * tall
    lit = np.flatnonzero(scores > PIXEL)
    of = np.searchsorted(starts, lit, "right") - 1
    y, x = np.divmod(lit - starts[of], wide[of])
    first = np.ones(len(lit), bool)
    first[1:] = (np.diff(lit) > 1) | (x[1:] == 0) | (np.diff(of) > 0)
    last = np.append(first[1:], True) if len(lit) else first
    at, of, y, start, end = lit[first], of[first], y[first], x[first], x[last]
    # a row of air between maps, so that none touches the next
    owner = joined((np.cumsum(tall + 1) - tall - 1)[of] + y, start, end)
    order = np.argsort(owner, kind="stable")
    begins = np.flatnonzero(np.diff(owner[order], prepend=-1))
    n = np.diff(np.append(begins, len(order)))
    head, tail = order[begins], order[begins + n - 1]
    # runs alike in rows that follow each other: an upright rectangle, whose pixel centres are those left of and above its far sides
    alike = (start[order] == np.repeat(start[head], n)) & (end[order] == np.repeat(end[head], n))
    upright = (np.add.reduceat(alike, begins, dtype=np.int64) == n) & (y[tail] - y[head] + 1 == n) if len(n) else np.zeros(0, bool)
    w, h = (end[head] - start[head]).astype(float), (y[tail] - y[head]).astype(float)
    thick = upright & (np.minimum(w, h) >= SIDE)
    inside = np.repeat(thick, n)
    inside[(begins + n - 1)[thick]] = False
    rows = order[inside]
    score = np.zeros(len(n))
    if len(rows):
        cuts = np.stack([at[rows], at[rows] + end[rows] - start[rows]], 1).ravel()
        sums = np.add.reduceat(scores, cuts)[::2]
        many = n[thick] - 1
        score[thick] = np.add.reduceat(sums, np.cumsum(many) - many) / (w * h)[thick]
    out = w * h * WIDEN / np.maximum(2 * (w + h), 1)
    good = thick & (score >= REGION) & (np.minimum(w, h) + 2 * out >= SIDE + 2)
    left, right, top, bottom = start[head] - out, end[head] + out, y[head] - out, y[tail] + out
    corners = np.stack([np.stack([a, b], 1) for a, b in ((left, top), (right, top), (right, bottom), (left, bottom))], 1)
    for k in np.flatnonzero(~upright & (n > 1)).tolist():
        g, m = order[begins[k] : begins[k] + n[k]], of[head[k]]
        points = np.concatenate([np.stack([start[g], y[g]], 1), np.stack([end[g], y[g]], 1)]).astype(float)
        one = kept(scores[starts[m] : starts[m] + size[m]].reshape(tall[m], wide[m]), points)
        if one:
            corners[k], score[k], good[k] = one[0], one[1], True
    of, corners, score, upright = of[head][good], corners[good], score[good], upright[good]
    ratio = np.stack([wide / width, tall / height], 1)[of][:, None, :]
    corners = np.clip(corners / ratio, 0, np.stack([width, height], 1)[of][:, None, :])
    for k in np.flatnonzero(~upright).tolist():
        corners[k] = ordered(corners[k])
    box = np.arange(len(of)) - np.searchsorted(of, of, "left")
    few = box < MOST
    return of[few], box[few], corners[few], score[few]


def slices(size: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Ranges of maps of up to ``SLICE`` pixels together, a larger map by itself."""
    begin = held = 0
    for k, n in enumerate(size):
        if held and held + n > SLICE:
            yield begin, k
            begin, held = k, 0
        held += n
    if begin < len(size):
        yield begin, len(size)


def detected(maps: DataFrame) -> DataFrame:
    """maps (map_id, scores array<float> by rows, columns int, width, height: of the image) to map_id, box (from 0, in the order of first
    pixels), points (four corners from the top left, clockwise) and score.  A null or empty map has no boxes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, (wide, width, height) = batch.column(1), (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3, 4))
            length = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
            some = np.flatnonzero((length > 0) & (np.nan_to_num(wide) > 0))
            for a, b in slices(length[some].tolist()):
                maps_ = some[a:b]
                columns, size = wide[maps_].astype(np.int64), length[maps_].astype(np.int64)
                if (size % columns).any():
                    raise ValueError("a score map whose rows are not all as long")
                scores = lists.take(pa.array(maps_)).flatten().to_numpy(zero_copy_only=False).astype(float)
                of, box, corners, score = found(scores, np.cumsum(size) - size, columns, size // columns, width[maps_], height[maps_])
                pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * len(of) + 1, 2, dtype=np.int32)), pa.array(corners.ravel()))
                points = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(of) + 1, 4, dtype=np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(maps_[of])), pa.array(box.astype(np.int32)), points, pa.array(score)], ["map_id", "box", "points", "score"])

    kind = dict(maps.dtypes)["map_id"]
    ready = maps.select("map_id", "scores", F.col("columns").cast("int"), F.col("width").cast("double"), F.col("height").cast("double"))
    return ready.mapInArrow(run, f"map_id {kind}, box int, points array<array<double>>, score double")
