"""Parts of images that are never made whole.

A view knows its size and makes any window of its pixels from the windows below it that the window
needs, so a rectangle of a very large image costs memory for the rectangle. Every view gives the
pixels that the function of the same name in ``raster_kernel`` gives for the whole image.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Box:
    """Columns ``x0`` to ``x1`` and rows ``y0`` to ``y1``, ends not included."""

    x0: int
    y0: int
    x1: int
    y1: int

    @property
    def w(self) -> int:
        return self.x1 - self.x0

    @property
    def h(self) -> int:
        return self.y1 - self.y0


class Whole:
    """An image at hand."""

    def __init__(self, img: np.ndarray):
        self.h, self.w = img.shape[:2]
        self.img = img

    def window(self, box: Box) -> np.ndarray:
        return self.img[box.y0 : box.y1, box.x0 : box.x1]


def _taps(size: int, out: int, low: int, high: int) -> tuple[int, np.ndarray]:
    """(first input, weights): the inputs that outputs ``low`` to ``high`` of an axis draw from."""
    i = np.arange(low, high, dtype=np.int64)[:, None]
    if out <= size:
        first, last = low * size // out, -(-high * size // out)
        j = np.arange(first, last, dtype=np.int64)[None, :]
        overlap = np.minimum((i + 1) * size, (j + 1) * out) - np.maximum(i * size, j * out)
        return first, np.maximum(overlap, 0).astype(np.float64)
    numerator = (2 * i[:, 0] + 1) * size - out
    left = numerator // (2 * out)
    part = numerator - left * 2 * out
    near, far = np.clip(left, 0, size - 1), np.clip(left + 1, 0, size - 1)
    first = int(near[0])
    weights = np.zeros((len(i), int(far[-1]) + 1 - first))
    rows = np.arange(len(i))
    np.add.at(weights, (rows, near - first), 2 * out - part)
    np.add.at(weights, (rows, far - first), part)
    return first, weights


class Smooth:
    """``view`` resized to ``w`` x ``h`` by the smooth filter."""

    def __init__(self, view, w: int, h: int):
        self.view, self.w, self.h = view, w, h

    def window(self, box: Box) -> np.ndarray:
        if (self.view.w, self.view.h) == (self.w, self.h):
            same = self.view.window(box).copy()
            same[same[..., 3] == 0] = 0
            return same
        x, wx = _taps(self.view.w, self.w, box.x0, box.x1)
        y, wy = _taps(self.view.h, self.h, box.y0, box.y1)
        given = self.view.window(Box(x, y, x + wx.shape[1], y + wy.shape[1]))
        alpha = given[..., 3].astype(np.float64)
        planes = np.stack([alpha, *(given[..., c] * alpha for c in range(3))])
        sums = np.rint(wy @ planes @ wx.T).astype(np.int64)
        total = _axis_total(self.view.w, self.w) * _axis_total(self.view.h, self.h)
        sa = sums[0]
        out = np.zeros((box.h, box.w, 4), np.uint8)
        safe = np.where(sa > 0, sa, 1)
        for c in range(3):
            out[..., c] = np.where(sa > 0, (sums[c + 1] + sa // 2) // safe, 0)
        out[..., 3] = (sa + total // 2) // total
        return out


def _axis_total(size: int, out: int) -> int:
    return size if out <= size else 2 * out


class Centred:
    """``view`` in the middle of a transparent canvas."""

    def __init__(self, view, w: int, h: int):
        self.view, self.w, self.h = view, w, h
        self.x, self.y = int((w - view.w) / 2), int((h - view.h) / 2)

    def window(self, box: Box) -> np.ndarray:
        out = np.zeros((box.h, box.w, 4), np.uint8)
        x0, y0 = max(box.x0, self.x, 0), max(box.y0, self.y, 0)
        x1, y1 = min(box.x1, self.x + self.view.w), min(box.y1, self.y + self.view.h)
        if x1 > x0 and y1 > y0:
            inner = self.view.window(Box(x0 - self.x, y0 - self.y, x1 - self.x, y1 - self.y))
            out[y0 - box.y0 : y1 - box.y0, x0 - box.x0 : x1 - box.x0] = inner
        return out


class Flipped:
    def __init__(self, view, across: bool, down: bool):
        self.view, self.w, self.h, self.across, self.down = view, view.w, view.h, across, down

    def window(self, box: Box) -> np.ndarray:
        x0, x1 = (self.w - box.x1, self.w - box.x0) if self.across else (box.x0, box.x1)
        y0, y1 = (self.h - box.y1, self.h - box.y0) if self.down else (box.y0, box.y1)
        found = self.view.window(Box(x0, y0, x1, y1))
        found = found[:, ::-1] if self.across else found
        return found[::-1] if self.down else found


class Turned:
    """A quarter turn, clockwise or back."""

    def __init__(self, view, clockwise: bool):
        self.view, self.w, self.h, self.clockwise = view, view.h, view.w, clockwise

    def window(self, box: Box) -> np.ndarray:
        # Clockwise, (x, y) shows (y, h' - 1 - x) of the view, whose height h' is this one's width.
        if self.clockwise:
            inner = Box(box.y0, self.view.h - box.x1, box.y1, self.view.h - box.x0)
            return np.rot90(self.view.window(inner), -1)
        inner = Box(self.view.w - box.y1, box.x0, self.view.w - box.y0, box.x1)
        return np.rot90(self.view.window(inner), 1)


def resize_overlay(view, width: int, height: int, keep_aspect: bool, overlay_scale: float):
    if not (keep_aspect or overlay_scale < 1.0):
        return Smooth(view, width, height)
    ratio = min(int(width * overlay_scale) / view.w, int(height * overlay_scale) / view.h)
    return Centred(Smooth(view, max(1, int(view.w * ratio)), max(1, int(view.h * ratio))), width, height)


def region_patch(
    source: np.ndarray,
    width: int,
    height: int,
    flip_tag: str | None,
    rotate_tag: str | None,
    keep_aspect: bool,
    overlay_scale: float,
):
    """A view of ``source`` made to cover one region."""
    how = flip_tag or ""
    view = resize_overlay(Whole(source), width, height, keep_aspect, overlay_scale)
    if "h" in how or "v" in how:
        view = Flipped(view, "h" in how, "v" in how)
    if rotate_tag in ("cw", "ccw"):
        view = Turned(view, rotate_tag == "cw")
    if (view.w, view.h) != (width, height):
        view = resize_overlay(view, width, height, keep_aspect, overlay_scale)
    return view
