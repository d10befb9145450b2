"""Scanned pages: boxes of words, lines and their texts behind a pluggable recogniser.

Image filters are limited to what numpy gives (grey values, Otsu's threshold, skew by projection profiles, scaling); a
recogniser is any object with ``recognize(image) -> (text, confidence)``.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame

from .geometry import TOKEN_SCHEMA

LEAST_DPI, MOST_DPI, DEFAULT_DPI, TARGET_DPI = 150.0, 200.0, 175.0, 400.0
KEEP_CONFIDENCE, MAX_ASPECT, MAX_SKEW = 0.25, 8.0, 15.0


class Recognizer(Protocol):
    def recognize(self, image: np.ndarray) -> tuple[str, float]: ...


def working_dpi(dpi: float | None) -> float:
    """Outside 150 to 200 the default."""
    return dpi if dpi and LEAST_DPI <= dpi <= MOST_DPI else DEFAULT_DPI


def native_dpi(images: list[tuple[float, float]], floor: float = 96.0, cap: float = 400.0) -> float:
    """Of (covered share of the page, dpi) the dpi of the largest image, the first of equals, within bounds."""
    best, dpi = 0.0, DEFAULT_DPI
    for cover, d in images:
        if cover > best:
            best, dpi = cover, d
    return min(cap, max(floor, dpi))


def otsu(gray: np.ndarray) -> int:
    counts = np.bincount(gray.ravel(), minlength=256).astype(float)
    w = np.cumsum(counts)
    m = np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m * w[-1]) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def rotate(image: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Nearest-neighbour rotation about the centre."""
    h, w = image.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w]
    dx, dy = x - w / 2, y - h / 2
    sx, sy = np.rint(np.cos(a) * dx + np.sin(a) * dy + w / 2).astype(int), np.rint(-np.sin(a) * dx + np.cos(a) * dy + h / 2).astype(int)
    ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    return np.where(ok, image[sy.clip(0, h - 1), sx.clip(0, w - 1)], fill)


def estimate_skew(gray: np.ndarray, most: float = MAX_SKEW) -> float:
    """The turn (whole degrees, then tenths around the best) whose rows of ink vary most; the first of equals."""
    step = max(1, int(np.ceil(max(gray.shape) / 512)))
    small = gray[::step, ::step]
    ink = (small <= otsu(small)).astype(np.uint8)
    score = lambda a: float(np.var(rotate(ink, a, 0).sum(axis=1)))
    best = max(np.arange(-most, most + 1), key=score)
    return float(round(max(np.arange(best - 1, best + 1.05, 0.1), key=score), 1))


def preprocess(image: np.ndarray, dpi: float | None = None) -> tuple[np.ndarray, float]:
    """(black-and-white page upright and scaled to the target, its dpi)."""
    gray = image if image.ndim == 2 else image[..., :3].mean(axis=2).astype(np.uint8)
    angle = min(MAX_SKEW, max(-MAX_SKEW, estimate_skew(gray)))
    if abs(angle) >= 0.3:
        gray = rotate(gray, angle)
    source = working_dpi(dpi)
    scale = TARGET_DPI / source
    if scale > 1.05:
        h, w = (int(round(n * scale)) for n in gray.shape)
        gray = gray[(np.arange(h) / scale).astype(int).clip(0, gray.shape[0] - 1)][:, (np.arange(w) / scale).astype(int).clip(0, gray.shape[1] - 1)]
        source = TARGET_DPI
    return np.where(gray <= otsu(gray), 0, 255).astype(np.uint8), source


Box = tuple[int, int, int, int]  # x0, y0, x1, y1


def _near(a: Box, b: Box, gap: float) -> bool:
    least = min(a[3] - a[1], b[3] - b[1])
    apart = max(a[0], b[0]) - min(a[2], b[2])
    shared = min(a[3], b[3]) - max(a[1], b[1])
    return apart <= gap * least and shared > 0.5 * least


def merge_boxes(boxes: list[Box], gap: float = 0.10) -> list[Box]:
    """Neighbours on one line become one box, until none are left."""
    boxes = list(boxes)
    k = 0
    while k < len(boxes):
        hit = next((j for j in range(len(boxes)) if j != k and _near(boxes[k], boxes[j], gap)), None)
        if hit is None:
            k += 1
            continue
        a, b = boxes[k], boxes.pop(hit)
        k -= hit < k
        boxes[k] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
        k = 0
    return sorted(boxes, key=lambda b: ((b[1] + b[3]) / 2, b[0]))


def word_boxes(binary: np.ndarray) -> list[Box]:
    """Connected ink (after closing gaps of two pixels sideways), without specks, merged."""
    ink = binary == 0
    closed = ink.copy()
    for d in (1, 2):
        closed[:, d:] |= ink[:, :-d]
    labels = np.where(closed, np.arange(1, closed.size + 1).reshape(closed.shape), 0)
    while True:
        grown = labels.copy()
        for axis in (0, 1):
            for shift in (1, -1):
                moved = np.roll(labels, shift, axis)
                edge = (0 if shift == 1 else -1,)
                moved[edge if axis == 0 else (slice(None), *edge)] = 0
                grown = np.where(closed, np.maximum(grown, moved), 0)
        if (grown == labels).all():
            break
        labels = grown
    out = []
    for n in np.unique(labels[labels > 0]):
        y, x = np.nonzero(labels == n)
        w, h = x.max() - x.min() + 1, y.max() - y.min() + 1
        if h >= 12 and w >= 4 and w * h >= 80:
            out.append((int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1))
    return merge_boxes(out)


def group_lines(boxes: list[Box], factor: float = 0.6) -> list[list[Box]]:
    """Rows by the running mean of their members' centres, within max(6, 0.6 of the upper median height)."""
    if not boxes:
        return []
    heights = sorted(b[3] - b[1] for b in boxes)
    tol = max(6.0, factor * heights[len(heights) // 2])
    lines: list[tuple[float, list[Box]]] = []
    for b in sorted(boxes, key=lambda b: ((b[1] + b[3]) / 2, b[0])):
        y = (b[1] + b[3]) / 2
        if lines and abs(y - lines[-1][0] / len(lines[-1][1])) <= tol:
            lines[-1] = (lines[-1][0] + y, [*lines[-1][1], b])
        else:
            lines.append((y, [b]))
    return [sorted(members, key=lambda b: b[0]) for _, members in lines]


def chunk_line(line: list[Box], most: float = MAX_ASPECT) -> list[list[Box]]:
    """Parts of a line that are at most so many times as wide as high, cut between words."""
    parts: list[list[Box]] = []
    for b in line:
        now = [*parts[-1], b] if parts else [b]
        wide, high = b[2] - now[0][0], max(x[3] for x in now) - min(x[1] for x in now)
        if parts and wide <= most * high:
            parts[-1] = now
        else:
            parts.append([b])
    return parts


def spread_text(text: str, boxes: list[Box]) -> list[tuple[str, Box]]:
    """Each word to the box whose centre is nearest to its place in the text; words of one box are joined."""
    words, x0, x1 = text.split(), boxes[0][0], boxes[-1][2]
    out: dict[int, list[str]] = {}
    at = 0
    for w in words:
        at = text.index(w, at)
        x = x0 + (x1 - x0) * (at + len(w) / 2) / max(1, len(text))
        at += len(w)
        out.setdefault(min(range(len(boxes)), key=lambda k: abs((boxes[k][0] + boxes[k][2]) / 2 - x)), []).append(w)
    return [(" ".join(ws), boxes[k]) for k, ws in sorted(out.items())]


def page_tokens(image: np.ndarray, recognizer: Recognizer, dpi: float | None = None) -> list[tuple]:
    """(text, x0, y0, x1, y1, confidence) in points, in reading order; weak tokens stay."""
    binary, scale = preprocess(image, dpi)
    out = []
    for line in group_lines(word_boxes(binary)):
        for part in chunk_line(line):
            box = part[0][0], min(b[1] for b in part), part[-1][2], max(b[3] for b in part)
            text, confidence = recognizer.recognize(binary[box[1] : box[3], box[0] : box[2]])
            out += [(w, *(v * 72 / scale for v in b), round(confidence, 4)) for w, b in spread_text(text, part)] if text.strip() else []
    return sorted(out, key=lambda t: ((t[2] + t[4]) / 2, t[1]))


def scan_tokens(pages: DataFrame, make_recognizer) -> DataFrame:
    """Tokens of page images (doc_id, page, width, height, pixels: grey bytes, dpi); one recogniser for each task."""

    def run(batches):
        import pandas as pd

        names = [f.strip().split(" ")[0] for f in TOKEN_SCHEMA.split(",")]
        recognizer = make_recognizer()
        for batch in batches:
            for r in batch.itertuples():
                image = np.frombuffer(bytes(r.pixels), np.uint8).reshape(int(r.height), int(r.width))
                found = page_tokens(image, recognizer, r.dpi)
                yield pd.DataFrame([(r.doc_id, r.page, k, t[0], *t[1:5], "RASTER", t[5], None) for k, t in enumerate(found)], columns=names).astype({"font_size": "float64"})

    return pages.mapInPandas(run, TOKEN_SCHEMA)


def check_regions(boxes: list[Box], width: int, height: int) -> list[Box]:
    """Boxes that can be checks: in the lowest two fifths of the page, two fifths of its width, 120 pixels high."""
    return [b for b in boxes if b[1] >= 0.6 * height and b[2] - b[0] >= 0.4 * width and b[3] - b[1] >= 120]


def mean_confidence(values: list[float]) -> float:
    kept = [v for v in values if v > 0]
    return round(sum(kept) / len(kept), 4) if kept else 0.0


def sequence_confidence(steps: list[float]) -> float:
    """The geometric mean of the steps' best probabilities."""
    return float(np.exp(np.mean(np.log(np.maximum(steps, 1e-12))))) if steps else 0.0
