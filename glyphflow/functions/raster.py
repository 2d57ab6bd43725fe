"""Pixel kernels in numpy, for use inside Arrow stages. Images are uint8 (height, width, 3), blue first."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from glyphflow.config import DEFAULTS, Settings

# ---- sampling ------------------------------------------------------------------------------------------------


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values at real places; beyond the edge the edge goes on."""
    h, w = image.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    pixels = image.astype(np.float64)
    top = pixels[y0, x0] * (1 - fx) + pixels[y0, x1] * fx
    low = pixels[y1, x0] * (1 - fx) + pixels[y1, x1] * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


@lru_cache(maxsize=1024)
def _places(size: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both neighbours and their weights on one axis, for each of the wanted places."""
    at = np.clip((np.arange(wanted) + 0.5) * (size / wanted) - 0.5, 0, size - 1)
    low = np.floor(at).astype(np.int64)
    share = at - low
    return low, np.minimum(low + 1, size - 1), 1 - share, share


_BLOCK = 1 << 14  # values that are worked on at a time, so that they stay in the cache


def _resized_rows(image: np.ndarray, width: int, height: int) -> Iterator[tuple[int, np.ndarray]]:
    """Whole values (float64) of the resized image in blocks of rows, each with its first row's number; a row has one channel after the other.

    The sums are those of ``sample``, which mixes columns before rows: columns
    are mixed once for a row of the image, not once for each row that is made of
    it.  A block is overwritten by the next.
    """
    x0, x1, left, right = _places(image.shape[1], width)
    y0, y1, upper, lower = _places(image.shape[0], height)
    pixels = image.transpose(0, 2, 1).astype(np.float64, order="C")
    mixed = pixels.take(x0, axis=2, mode="clip")
    mixed *= left
    other = pixels.take(x1, axis=2, mode="clip")
    other *= right
    mixed += other
    mixed = mixed.reshape(len(mixed), -1)
    upper, lower = upper[:, None], lower[:, None]
    step = min(height, max(1, _BLOCK // mixed.shape[1]))
    first, second = np.empty((2, step, mixed.shape[1]))
    for at in range(0, height, step):
        rows = slice(at, min(at + step, height))
        block, other = first[: rows.stop - at], second[: rows.stop - at]
        mixed.take(y0[rows], axis=0, out=block, mode="clip")
        block *= upper[rows]
        mixed.take(y1[rows], axis=0, out=other, mode="clip")
        other *= lower[rows]
        block += other
        yield at, np.rint(block, out=block)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear; weights add up to 1, so that no value leaves the range of bytes."""
    channels = image.shape[2]
    out = np.empty((height, width, channels), np.uint8)
    for at, block in _resized_rows(image, width, height):
        out[at : at + len(block)] = block.reshape(-1, channels, width).transpose(0, 2, 1)
    return out


def straighten(image: np.ndarray, quad: np.ndarray, s: Settings = DEFAULTS) -> np.ndarray:
    """The quadrilateral (top left, top right, bottom right, bottom left) as an upright crop; tall ones are turned by a quarter."""
    q = np.asarray(quad, np.float64)

    def side(a: int, b: int, c: int, d: int) -> int:
        return max(1, int(max(np.hypot(*(q[a] - q[b])), np.hypot(*(q[c] - q[d])))))

    w, h = side(0, 1, 2, 3), side(0, 3, 1, 2)
    corners = np.array([[0, 0], [w, 0], [w, h], [0, h]], np.float64)
    # Eight equations for the projective map from crop to image, whose last coefficient is 1.
    rows, right = [], []
    for (u, v), (x, y) in zip(corners, q, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        right += [x, y]
    m = np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0]
    u, v = np.meshgrid(np.arange(w, dtype=np.float64), np.arange(h, dtype=np.float64))
    scale = m[6] * u + m[7] * v + 1
    scale = np.where(np.abs(scale) < 1e-12, 1e-12, scale)
    crop = sample(image, (m[0] * u + m[1] * v + m[2]) / scale, (m[3] * u + m[4] * v + m[5]) / scale)
    return np.rot90(crop, -1).copy() if h > s.upright_ratio * w else crop


def turned(image: np.ndarray) -> np.ndarray:
    return image[::-1, ::-1]


# ---- network inputs ------------------------------------------------------------------------------------------


def _fill(out: np.ndarray, image: np.ndarray, mean: tuple[float, ...], std: tuple[float, ...]) -> None:
    """The image at the size of ``out`` (3, H, W), over 255, less the mean and by the deviation of each channel, as 32-bit floats."""
    channels, height, width = out.shape
    mean, std = np.repeat(np.array(mean, np.float32), width), np.array(std, np.float32)[:, None, None]
    for at, block in _resized_rows(image, width, height):
        values = block.astype(np.float32)
        values /= np.float32(255)
        values -= mean
        np.divide(values.reshape(-1, channels, width).transpose(1, 0, 2), std, out=out[:, at : at + len(values)])


def detector_input(image: np.ndarray, s: Settings = DEFAULTS) -> tuple[np.ndarray, int, int]:
    """The tensor (1, 3, H, W) and the sides of the (padded) image it stands for."""
    h, w = image.shape[:2]
    if h + w < s.tiny_sum:
        grown = np.zeros((max(s.tiny_side, h), max(s.tiny_side, w), 3), np.uint8)
        grown[:h, :w] = image
        image, (h, w) = grown, grown.shape[:2]
    ratio = s.limit_side / min(h, w) if min(h, w) < s.limit_side else 1.0
    sides = [int(h * ratio), int(w * ratio)]
    if max(sides) > s.max_side:
        shrink = s.max_side / max(sides)
        sides = [int(v * shrink) for v in sides]
    rh, rw = (max(int(round(v / s.side_step) * s.side_step), s.side_step) for v in sides)
    out = np.empty((1, 3, rh, rw), np.float32)
    _fill(out[0], image, s.det_mean, s.det_std)
    return out, h, w


def classifier_input(crops: list[np.ndarray], s: Settings = DEFAULTS) -> np.ndarray:
    w, h = s.cls_size
    out = np.empty((len(crops), 3, h, w), np.float32)
    for own, crop in zip(out, crops, strict=True):
        _fill(own, crop, s.det_mean, s.det_std)
    return out


def recogniser_input(crops: list[np.ndarray], s: Settings = DEFAULTS) -> np.ndarray:
    """A batch; its width is that of its widest crop, narrower ones have zeros to their right."""
    channels, height, width = s.rec_shape
    ratios = [c.shape[1] / c.shape[0] for c in crops]
    whole = int(height * max(width / height, *ratios))
    out = np.empty((len(crops), channels, height, whole), np.float32)
    half = (0.5,) * channels
    for own, crop, ratio in zip(out, crops, ratios, strict=True):
        used = min(whole, math.ceil(height * ratio))
        own[:, :, used:] = 0
        _fill(own[:, :, :used], crop, half, half)
    return out


# ---- shapes --------------------------------------------------------------------------------------------------


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one places of the runs of each row, in the flat mask; a mask whose first and last columns are unset."""
    flat = mask.ravel()
    turns = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    return turns[::2], turns[1::2]


def _components(starts: np.ndarray, ends: np.ndarray, width: int, diagonal: bool) -> tuple[np.ndarray, int, int]:
    """A number from 1 of each run's connected part, in scan order, how many parts there are, and how many pairs of runs touch."""
    begin, end, n = starts.tolist(), ends.tolist(), len(starts)
    parent, pairs, reach, i = list(range(n)), 0, int(diagonal), 0
    for j in range(n):
        # Where this run would be in the row above.
        a, b = begin[j] - width - reach, end[j] - width + reach
        while end[i] <= a:
            i += 1
        k = i
        while begin[k] < b:
            pairs += 1
            p, q = k, j
            while parent[p] != p:
                parent[p] = p = parent[parent[p]]
            while parent[q] != q:
                parent[q] = q = parent[parent[q]]
            if p < q:
                parent[q] = p
            elif q < p:
                parent[p] = q
            k += 1
    number, of = 0, [0] * n
    for j in range(n):  # a parent comes before its children
        if parent[j] == j:
            number += 1
            of[j] = number
        else:
            of[j] = of[parent[j]]
    return np.array(of, np.int64), number, pairs


def contours(mask: np.ndarray) -> list[np.ndarray]:
    """Points (x, y) on the outline of each part of a mask and around each of its holes."""
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(rows):
        return []
    # Only what lies between the first and the last cells that are set is looked at.
    corner = np.array([columns[0], rows[0]])
    return [points + corner for points in _contours(mask[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1])]


def contours_of(masks: np.ndarray) -> list[list[np.ndarray]]:
    """``contours`` of each of many small masks (N, H, W), which are looked at as one, an empty row apart."""
    n, h, w = masks.shape
    tall = np.zeros((n, h + 1, w), bool)
    tall[:, :h] = masks
    found: list[list[np.ndarray]] = [[] for _ in range(n)]
    for points in _contours(tall.reshape(-1, w)):
        k = int(points[0, 1]) // (h + 1)
        points[:, 1] -= k * (h + 1)
        found[k].append(points)
    return found


def _contours(mask: np.ndarray) -> list[np.ndarray]:
    h, w = mask.shape
    grown = np.zeros((h + 2, w + 4), bool)
    grown[1:-1, 2:-2] = mask
    width, flat = w + 4, grown.ravel()
    starts, ends = _runs(grown)
    if not len(starts):
        return []
    part, n, pairs = _components(starts, ends, width, True)
    inner = grown[:-2, 2:-2] & grown[2:, 2:-2] & grown[1:-1, 1:-3] & grown[1:-1, 3:-1]
    ys, xs = np.nonzero(mask & ~inner)
    at, points = (ys + 1) * width + xs + 2, np.stack([xs, ys], axis=1)
    found = []
    for k, rows in _split(part[starts.searchsorted(at, "right") - 1], n):
        found.append((at[rows[0]], k, points[rows]))
    # Runs that touch are a graph, each of whose independent cycles goes around a hole.
    if pairs - len(starts) + n:
        # What lies between the runs of a row is a hole's unless it leads to what lies beside them.
        row = starts // width
        same = row[1:] == row[:-1]
        low, high, row_of = ends[:-1][same], starts[1:][same], row[:-1][same]
        first, last = np.full(h + 2, width), np.zeros(h + 2, np.int64)
        first[row[::-1]], last[row] = (starts - row * width)[::-1], ends - row * width
        left, right = low - row_of * width, high - row_of * width
        leads = (left < first[row_of - 1]) | (right > last[row_of - 1]) | (left < first[row_of + 1]) | (right > last[row_of + 1])
        part, n, _ = _components(low, high, width, False)
        hole = np.ones(n + 1, bool)
        hole[part[leads]] = False
        part *= hole[part]
        beside = at + np.array([[1], [-1], [width], [-width]])
        _, point = unset = np.nonzero(~flat[beside])
        place = beside[unset]
        gap = low.searchsorted(place, "right") - 1
        owner = np.where((gap >= 0) & (place < high[gap]), part[gap], 0)
        # One number a hole and point, in the order of both.
        size = len(at)
        keys = np.unique((owner * size + point)[owner > 0])
        for k, rows in _split(keys // size, n):
            own = keys[rows] % size
            found.append((at[own[0]], -k, points[own]))
    return [own for *_, own in sorted(found, key=lambda f: f[:2])]


def _split(owner: np.ndarray, n: int):
    if n == 1:
        yield 1, np.arange(len(owner))
        return
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(1, n + 2))
    for k in range(1, n + 1):
        rows = order[cuts[k - 1] : cuts[k]]
        if len(rows):
            yield k, rows


def _ends(points: np.ndarray, axis: int) -> np.ndarray:
    """The first and the last of the points with the same coordinate on an axis, in its order."""
    order = np.lexsort((points[:, 1 - axis], points[:, axis]))
    own = points[order, axis]
    ends = np.empty(len(own) + 1, bool)
    ends[0] = ends[-1] = True
    np.not_equal(own[1:], own[:-1], out=ends[1:-1])
    return points[order[ends[1:] | ends[:-1]]]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, by Andrew's monotone chains over points that end both their row and their column."""
    p = np.asarray(points, np.float64)
    p = _ends(_ends(p, 1) if len(p) > 8 else p, 0)
    rows = list(dict.fromkeys(map(tuple, p.tolist())))
    if len(rows) < 3:
        return np.array(rows)

    def chain(rows):
        out: list[tuple[float, float]] = []
        for x, y in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out[:-1]

    return np.array(chain(rows) + chain(rows[::-1]))


def least_rectangle(points: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Corners, and both sides, of the rectangle of least area around points; one side lies on a side of the hull."""
    p = hull(points)
    if len(p) == 1:
        return np.repeat(p, 4, axis=0), 0.0, 0.0
    edges = p[[*range(1, len(p)), 0]] - p
    edges = edges / np.hypot(edges[:, 0], edges[:, 1])[:, None]
    normals = edges[:, ::-1] * (-1.0, 1.0)
    along, across = p @ edges.T, p @ normals.T
    a0, a1, b0, b1 = along.min(0), along.max(0), across.min(0), across.max(0)
    k = int(np.argmin((a1 - a0) * (b1 - b0)))
    e, n = edges[k], normals[k]
    low, high, top, end = a0[k], a1[k], b0[k], b1[k]
    corners = np.array([[low], [high], [high], [low]]) * e + np.array([[top], [top], [end], [end]]) * n
    return corners, float(a1[k] - a0[k]), float(b1[k] - b0[k])


def corners(points: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left; see geometry.corner_order."""
    first, second, third, last = sorted(points.tolist(), key=lambda p: p[0])
    tl, bl = (first, second) if second[1] > first[1] else (second, first)
    tr, br = (third, last) if last[1] > third[1] else (last, third)
    return np.array([tl, tr, br, bl], points.dtype)


def mini_box(points: np.ndarray) -> tuple[np.ndarray, float]:
    found, w, h = least_rectangle(points)
    return corners(found), min(w, h)


def inside(polygon: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels of a canvas whose centres are in a polygon or on its outline; of each side only the rows and columns that it spans are looked at."""
    p = np.asarray(polygon, np.float64).tolist()
    xs, ys = np.arange(width), np.arange(height)[:, None]
    odd, edge = np.zeros((height, width), bool), np.zeros((height, width), bool)
    for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
        top, low = min(ay, by), max(ay, by)
        y0, y1, y2 = max(0, math.ceil(top)), min(height, math.ceil(low)), min(height, math.floor(low) + 1)
        if y0 >= y2:
            continue
        cross = (bx - ax) * (ys[y0:y2] - ay) - (by - ay) * (xs - ax)
        x0, x1 = max(0, math.ceil(min(ax, bx))), max(0, math.floor(max(ax, bx)) + 1)
        edge[y0:y2, x0:x1] |= np.abs(cross[:, x0:x1]) <= 0.5 * max(abs(bx - ax), abs(by - ay), 1e-9)
        if y0 < y1:
            odd[y0:y1] ^= cross[: y1 - y0] > 0 if by < ay else cross[: y1 - y0] <= 0
    odd |= edge
    return odd


def inside_of(polygons: np.ndarray, width: int, height: int) -> np.ndarray:
    """``inside`` for each of many small polygons of as many corners (N, corners, 2), on canvases of one size."""
    p = np.asarray(polygons, np.float64)[..., None, None]
    x, y = np.arange(width), np.arange(height)[:, None]
    odd, edge = np.zeros((2, len(p), height, width), bool)
    for k in range(p.shape[1]):
        (ax, ay), (bx, by) = p[:, k - 1].swapaxes(0, 1), p[:, k].swapaxes(0, 1)
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        odd ^= ((ay > y) != (by > y)) & ((cross > 0) == (by < ay))
        near = np.abs(cross, out=cross) <= 0.5 * np.maximum(np.maximum(np.abs(bx - ax), np.abs(by - ay)), 1e-9)
        near &= (x >= np.minimum(ax, bx)) & (x <= np.maximum(ax, bx))
        near &= (y >= np.minimum(ay, by)) & (y <= np.maximum(ay, by))
        edge |= near
    odd |= edge
    return odd


def spans(polygon: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a grid that a convex polygon of whole corners covers, and the first and last column of each, outline included.

    A steep side passes through one column of a row; a flat one through all
    columns at which it is nearer to this row than to the next.
    """
    p = np.asarray(polygon, np.float64).tolist()
    levels = [y for _, y in p]
    top = max(0, int(min(levels)))
    ys = np.arange(top, min(height - 1, int(max(levels))) + 1, dtype=np.float64)
    first, last = np.full(len(ys), np.inf), np.full(len(ys), -np.inf)
    for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
        if by < ay:
            ax, ay, bx, by = bx, by, ax, ay
        met = slice(max(0, math.ceil(ay) - top), max(0, math.floor(by) + 1 - top))
        own = ys[met]
        if not len(own):
            continue
        if ay == by or ax == bx:
            low, high = float(round(min(ax, bx))), float(round(max(ax, bx)))
        else:
            slope = (bx - ax) / (by - ay)
            reach = 0.5 if abs(bx - ax) > by - ay else 0.0
            ends = tuple(ax + (np.clip(own + r, ay, by) - ay) * slope for r in (-reach, reach))
            low, high = np.rint(np.minimum(*ends)), np.rint(np.maximum(*ends))
        first[met], last[met] = np.minimum(first[met], low), np.maximum(last[met], high)
    some = first <= last
    return ys[some].astype(np.int64), np.clip(first[some], 0, width - 1).astype(np.int64), np.clip(last[some], 0, width - 1).astype(np.int64)


def box_score(prob: np.ndarray, box: np.ndarray) -> float:
    """Mean probability within a rectangle, whose corners count as the cells of the map that they lie in; 0 outside the map."""
    rows, first, last = spans(np.floor(box), *prob.shape)
    if not len(rows):
        return 0.0
    left = int(first.min())
    part = prob[rows[0] : rows[-1] + 1, left : int(last.max()) + 1]
    ends = np.zeros((part.shape[0], part.shape[1] + 1))
    np.cumsum(part, axis=1, dtype=np.float64, out=ends[:, 1:])
    k = rows - rows[0]
    return float((ends[k, last + 1 - left] - ends[k, first - left]).sum() / (last + 1 - first).sum())


def grow(box: np.ndarray, s: Settings = DEFAULTS) -> np.ndarray:
    """A rectangle whose sides have moved outwards by its area over its perimeter times the ratio."""
    found, w, h = least_rectangle(box)
    if w < 1e-6 or h < 1e-6:
        return np.asarray(box, np.float64)
    distance = w * h * s.unclip_ratio / (2 * (w + h)) * s.unclip_extra
    centre = found.mean(axis=0)
    e, n = (found[1] - found[0]) / w, (found[3] - found[0]) / h
    across, down = e * (w / 2 + distance), n * (h / 2 + distance)
    return np.array([centre - across - down, centre + across - down, centre + across + down, centre - across + down])


def boxes_of_map(prob: np.ndarray, height: int, width: int, s: Settings = DEFAULTS) -> tuple[list[np.ndarray], list[float]]:
    """Quadrilaterals (int, in image pixels) and scores of a probability map (H, W) for an image of the given sides.

    Three gates: the short side, the score, and the short side once more after the rectangle has grown.
    """
    outlined = [mini_box(points) for points in contours(prob > s.binarise_above)[: s.most_contours]]
    rated = [(box, box_score(prob, box)) for box, short in outlined if short >= s.short_side]
    grown = [(*mini_box(grow(box, s)), score) for box, score in rated if score >= s.box_score]
    final = [(box, score) for box, short, score in grown if short >= s.short_side_after]
    if not final:
        return [], []
    sides = np.array([width, height])
    placed = np.stack([box for box, _ in final]) / prob.shape[::-1] * sides
    return list(np.clip(np.rint(placed), 0, sides).astype(np.int32)), [score for _, score in final]


# ---- rendering -----------------------------------------------------------------------------------------------

# BGR of each score band, for upright and for turned text.
BOX_COLOURS = {
    0: {"high": (0, 200, 0), "mid": (0, 200, 255), "low": (0, 0, 255)},
    1: {"high": (200, 0, 200), "mid": (200, 100, 200), "low": (200, 0, 100)},
}


def draw_boxes(image: np.ndarray, items: list[dict], s: Settings = DEFAULTS) -> np.ndarray:
    """Faint fills with outlines two pixels wide: all are drawn on one layer, which is blended in once."""
    layer = image.copy()
    h, w = image.shape[:2]
    for item in items:
        p = np.asarray(item["polygon"], np.int64)
        band = "high" if item["score"] >= s.high_score else "mid" if item["score"] >= s.mid_score else "low"
        colour = np.array(BOX_COLOURS[1 if item["angle"] == 1 else 0][band], np.uint8)
        corners = p.tolist()
        xs, ys = zip(*corners, strict=True)
        x0, y0 = (max(0, min(v) - 2) for v in (xs, ys))
        x1, y1 = (min(most, max(v) + 3) for most, v in ((w, xs), (h, ys)))
        if x0 >= x1 or y0 >= y1:
            continue
        shape = inside(p - (x0, y0), x1 - x0, y1 - y0)
        # The line, then the same one pixel to the right and one further down.
        at = np.concatenate([_line(a, b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]) - (x0, y0)
        x, y = (at[None] + _PEN).reshape(-1, 2).T
        if x0 > min(xs) or y0 > min(ys) or x1 < max(xs) + 2 or y1 < max(ys) + 2:
            within = (x >= 0) & (x < x1 - x0) & (y >= 0) & (y < y1 - y0)
            x, y = x[within], y[within]
        shape[y, x] = True
        layer[y0:y1, x0:x1][shape] = colour
    return np.rint(layer * s.fill + image * (1 - s.fill)).astype(np.uint8)


_PEN = np.array([[[0, 0]], [[1, 0]], [[0, 1]]])


@lru_cache(maxsize=256)
def _shares(n: int) -> np.ndarray:
    return np.linspace(0, 1, n + 1)[:, None]


def _line(a: list[int], b: list[int]) -> np.ndarray:
    """Points from one corner to another."""
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1)
    return np.rint(np.array(a) + np.array([b[0] - a[0], b[1] - a[1]]) * _shares(n)).astype(np.int64)


def png(image: np.ndarray) -> bytes:
    """A PNG file of a BGR image."""
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image[:, :, ::-1].reshape(h, -1)], axis=1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
