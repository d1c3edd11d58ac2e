"""NumPy twin of the pixel operators for packed rasters inside a task.

Arrays are ``(h, w, 4)`` uint8, RGBA. The smooth filter's integer sums stay below 2**53, so
the float64 matrix products are exact and equal the relational definition.
"""

from __future__ import annotations

import numpy as np

THUMB = 148  # fixed value: side of the preview square


def unpack(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, 4)


_WEIGHTS: dict[tuple[int, int], np.ndarray] = {}
MAX_CACHED_WEIGHTS = 256


def axis_weights(size: int, out: int) -> np.ndarray:
    """``(out, size)`` integer weights as float64; each row sums to the axis total."""
    found = _WEIGHTS.get((size, out))
    if found is None:
        if len(_WEIGHTS) >= MAX_CACHED_WEIGHTS:
            _WEIGHTS.clear()
        found = _WEIGHTS[(size, out)] = _axis_weights(size, out)
    return found


def _axis_weights(size: int, out: int) -> np.ndarray:
    i = np.arange(out, dtype=np.int64)[:, None]
    j = np.arange(size, dtype=np.int64)[None, :]
    if out <= size:
        overlap = np.minimum((i + 1) * size, (j + 1) * out) - np.maximum(i * size, j * out)
        return np.maximum(overlap, 0).astype(np.float64)
    numerator = (2 * i[:, 0] + 1) * size - out
    left = numerator // (2 * out)
    part = numerator - left * 2 * out
    weights = np.zeros((out, size))
    np.add.at(weights, (i[:, 0], np.clip(left, 0, size - 1)), 2 * out - part)
    np.add.at(weights, (i[:, 0], np.clip(left + 1, 0, size - 1)), part)
    return weights


def smooth_resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = img.shape[:2]
    if (w, h) == (width, height):
        # The unit weights leave visible pixels as they are and blank the invisible ones.
        same = img.copy()
        same[img[..., 3] == 0] = 0
        return same
    wy, wx = axis_weights(h, height), axis_weights(w, width)
    alpha = img[..., 3].astype(np.float64)
    planes = np.stack([alpha, *(img[..., c] * alpha for c in range(3))])
    sums = np.rint(wy @ planes @ wx.T).astype(np.int64)
    total = int(wy[0].sum()) * int(wx[0].sum())
    sa = sums[0]
    out = np.zeros((height, width, 4), np.uint8)
    safe = np.where(sa > 0, sa, 1)
    for c in range(3):
        out[..., c] = np.where(sa > 0, (sums[c + 1] + sa // 2) // safe, 0)
    out[..., 3] = (sa + total // 2) // total
    return out


def nearest_resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = img.shape[:2]
    ys = np.arange(height) * h // height
    xs = np.arange(width) * w // width
    return img[ys][:, xs]


def upscale(img: np.ndarray, scale: int) -> np.ndarray:
    return img.repeat(scale, axis=0).repeat(scale, axis=1)


def centred(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """``img`` in the middle of a transparent canvas, clipped; offsets truncate toward zero."""
    h, w = img.shape[:2]
    ox, oy = int((width - w) / 2), int((height - h) / 2)
    canvas = np.zeros((height, width, 4), np.uint8)
    x0, y0 = max(ox, 0), max(oy, 0)
    x1, y1 = min(ox + w, width), min(oy + h, height)
    if x1 > x0 and y1 > y0:
        canvas[y0:y1, x0:x1] = img[y0 - oy : y1 - oy, x0 - ox : x1 - ox]
    return canvas


def resize_overlay(
    img: np.ndarray, width: int, height: int, keep_aspect: bool, overlay_scale: float
) -> np.ndarray:
    if not (keep_aspect or overlay_scale < 1.0):
        return smooth_resize(img, width, height)
    h, w = img.shape[:2]
    ratio = min(int(width * overlay_scale) / w, int(height * overlay_scale) / h)
    return centred(smooth_resize(img, max(1, int(w * ratio)), max(1, int(h * ratio))), width, height)


def fixed_size(img: np.ndarray, size: int, keep_aspect: bool) -> np.ndarray:
    """A source pre-resized to a ``size`` square, letterboxed if its aspect is kept."""
    if not keep_aspect:
        return smooth_resize(img, size, size)
    h, w = img.shape[:2]
    fit_w, fit_h = (size, max(1, h * size // w)) if w >= h else (max(1, w * size // h), size)
    return centred(smooth_resize(img, fit_w, fit_h), size, size)


def flip(img: np.ndarray, how: str | None) -> np.ndarray:
    how = how or ""
    img = img[:, ::-1] if "h" in how else img
    return img[::-1] if "v" in how else img


def rotate(img: np.ndarray, how: str | None) -> np.ndarray:
    turns = {"cw": -1, "ccw": 1}.get(how or "", 0)
    return np.rot90(img, turns) if turns else img


def blend(base: np.ndarray, over: np.ndarray, alpha: float) -> None:
    """Blend in place; the base alpha is kept."""
    unit = np.float32(np.float32(alpha) / np.float32(255.0))
    weight = over[..., 3:4].astype(np.float32) * unit
    inverse = np.float32(1.0) - weight
    mixed = base[..., :3].astype(np.float32) * inverse + over[..., :3].astype(np.float32) * weight
    base[..., :3] = mixed.astype(np.uint8)


def region_patch(
    source: np.ndarray,
    width: int,
    height: int,
    flip_tag: str | None,
    rotate_tag: str | None,
    keep_aspect: bool,
    overlay_scale: float,
) -> np.ndarray:
    """A source made to cover one region: resize, flip, turn, refit."""
    patch = rotate(
        flip(resize_overlay(source, width, height, keep_aspect, overlay_scale), flip_tag), rotate_tag
    )
    if patch.shape[:2] != (height, width):
        patch = resize_overlay(patch, width, height, keep_aspect, overlay_scale)
    return patch
