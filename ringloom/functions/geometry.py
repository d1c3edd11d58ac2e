"""Rectangle, fit-box and face arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_count(width: Column, height: Column, animated: Column) -> Column:
    """Square frames stacked in a strip; one frame if not animated or not decodable."""
    usable = F.coalesce(animated, F.lit(False)) & (F.coalesce(width, F.lit(0)) > 0)
    return F.when(usable, F.greatest(F.lit(1), F.floor(height / width).cast("int"))).otherwise(1)


def region_bounds(
    x: Column,
    y: Column,
    width: Column,
    height: Column,
    image_w: Column,
    frame_h: Column,
    image_h: Column,
    canonical_w: Column,
    canonical_h: Column,
    scale: Column,
    frame: Column,
) -> Column:
    """Struct ``(xs, ys, xe, ye)`` of a region on the upscaled strip; null if degenerate.

    Coordinates are rounded half away from zero, shifted by the frame, and the origin is
    clamped before the far edge is worked out, so a negative origin moves the rectangle
    instead of cutting it.
    """
    sx = image_w.cast("double") / canonical_w
    sy = frame_h.cast("double") / canonical_h
    full_w = image_w * scale
    full_h = image_h * scale

    def rounded(v: Column, ratio: Column) -> Column:
        return F.round(v * ratio * scale).cast("int")

    def clamp(v: Column, top: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0)), top)

    ws, hs = rounded(width, sx), rounded(height, sy)
    xs = clamp(rounded(x, sx), full_w)
    ys = clamp(rounded(y, sy) + frame * frame_h * scale, full_h)
    xe, ye = clamp(xs + ws, full_w), clamp(ys + hs, full_h)
    keep = (ws != 0) & (hs != 0) & (xe > xs) & (ye > ys)
    return F.when(keep, F.struct(xs.alias("xs"), ys.alias("ys"), xe.alias("xe"), ye.alias("ye")))


def fit_box(
    source_w: Column,
    source_h: Column,
    target_w: Column,
    target_h: Column,
    keep_aspect: Column,
    overlay_scale: Column,
) -> Column:
    """Struct ``(fit_w, fit_h, off_x, off_y)`` of the drawn source inside the target.

    Fitted and centred when the aspect is kept or the overlay scale is below one,
    otherwise stretched over the whole target. Offsets truncate toward zero.
    """
    scaled_w = (target_w * overlay_scale).cast("int")
    scaled_h = (target_h * overlay_scale).cast("int")
    ratio = F.least(
        F.try_divide(scaled_w.cast("double"), source_w),
        F.try_divide(scaled_h.cast("double"), source_h),
    )
    fit = keep_aspect | (overlay_scale < 1.0)
    fit_w = F.when(fit, F.greatest(F.lit(1), (source_w * ratio).cast("int"))).otherwise(target_w)
    fit_h = F.when(fit, F.greatest(F.lit(1), (source_h * ratio).cast("int"))).otherwise(target_h)
    return F.struct(
        fit_w.alias("fit_w"),
        fit_h.alias("fit_h"),
        ((target_w - fit_w) / 2).cast("int").alias("off_x"),
        ((target_h - fit_h) / 2).cast("int").alias("off_y"),
    )


def cuboid_faces(u: Column, v: Column, sx: Column, sy: Column, sz: Column) -> Column:
    """Array of the six unfolded faces of a box, in sheet order; callers drop empty ones."""

    def face(ord_: int, name: str, x: Column, y: Column, w: Column, h: Column) -> Column:
        return F.struct(
            F.lit(ord_).alias("face_ord"),
            F.lit(name).alias("face"),
            x.alias("x"),
            y.alias("y"),
            w.alias("width"),
            h.alias("height"),
        )

    side_y = v + sz
    return F.array(
        face(0, "top", u + sz, v, sx, sz),
        face(1, "bottom", u + sz + sx, v, sx, sz),
        face(2, "right", u, side_y, sz, sy),
        face(3, "front", u + sz, side_y, sx, sy),
        face(4, "left", u + sz + sx, side_y, sz, sy),
        face(5, "back", u + sz + sx + sz, side_y, sx, sy),
    )


def quad_rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Rectangle of a UV quad; null when thinner than half a unit in either axis.

    Rounds half to even. Reversed axes become a flip tag.
    """
    w, h = F.abs(x2 - x1), F.abs(y2 - y1)
    flip = (
        F.when((x1 > x2) & (y1 > y2), F.lit("hv"))
        .when(x1 > x2, F.lit("h"))
        .when(y1 > y2, F.lit("v"))
    )

    def even(c: Column) -> Column:
        return F.bround(c).cast("int")

    return F.when(
        (w >= 0.5) & (h >= 0.5),
        F.struct(
            even(F.least(x1, x2)).alias("x"),
            even(F.least(y1, y2)).alias("y"),
            even(w).alias("width"),
            even(h).alias("height"),
            flip.alias("flip"),
        ),
    )


def base_part(region_name: Column) -> Column:
    """Part a region belongs to: face suffix off, then a numeric cuboid index off."""
    return F.regexp_replace(region_name, "(_[0-9]+)?_[^_]*$", "")


def face_region_name(part: Column, index: Column, cuboids_in_part: Column, face: Column) -> Column:
    return F.when(cuboids_in_part == 1, F.concat_ws("_", part, face)).otherwise(
        F.concat_ws("_", part, index.cast("string"), face)
    )


def element_region_name(
    template: Column, element: Column, direction: Column, several: Column
) -> Column:
    own = F.concat(F.lit("elem"), element.cast("string"), F.lit("_"), direction)
    return F.when(several, F.concat(F.lit("t"), template.cast("string"), F.lit("_"), own)).otherwise(own)
