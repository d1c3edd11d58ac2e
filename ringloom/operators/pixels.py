"""Raster operators over a pixel relation.

``pixels(img, w, h, x, y, r, g, b, a)``: one row per pixel of a ``w`` by ``h`` raster; a
missing pixel is transparent. This layer defines the semantics and is what the SQL oracle
checks; :mod:`ringloom.operators.raster_kernel` computes the same on packed rasters.

The smooth filter is defined in integers so that every engine agrees: per axis, a shrinking
resize weighs source pixels by overlapped length, a growing one interpolates linearly
between pixel centres, edges clamped. Colours are averaged weighted by alpha.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringloom.functions.colour import blend_channel, blend_weight
from ringloom.functions.geometry import fit_box

CHANNELS = ("r", "g", "b", "a")
PIXEL_COLUMNS = ["img", "w", "h", "x", "y", *CHANNELS]


def nearest_upscale(pixels: DataFrame, scale: int | str) -> DataFrame:
    """Each pixel becomes a ``scale`` by ``scale`` block (a number or a column name)."""
    s = F.col(scale) if isinstance(scale, str) else F.lit(scale)
    steps = F.sequence(F.lit(0), s - 1)
    rest = [c for c in pixels.columns if c not in ("w", "h", "x", "y")]
    spread = pixels.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return spread.select(
        *rest,
        (F.col("w") * s).alias("w"),
        (F.col("h") * s).alias("h"),
        (F.col("x") * s + F.col("_dx")).alias("x"),
        (F.col("y") * s + F.col("_dy")).alias("y"),
    ).select(*pixels.columns)


def _exact_div(a: Column, b: Column) -> Column:
    """Integer quotient rounded toward minus infinity."""
    return ((a - F.pmod(a, b)) / b).cast("bigint")


def _taps(at: Column, size: Column, out: Column) -> Column:
    """Array of ``(i, weight)``: outputs the source pixel ``at`` contributes to on one axis."""
    j, s, d = (c.cast("bigint") for c in (at, size, out))
    zero = F.lit(0).cast("bigint")

    def clip(c: Column) -> Column:
        return F.greatest(zero, F.least(c, d - 1))

    def shrink(i: Column) -> Column:
        return F.least((i + 1) * s, (j + 1) * d) - F.greatest(i * s, j * d)

    def grow(i: Column) -> Column:
        numerator = (i * 2 + 1) * s - d
        left = _exact_div(numerator, d * 2)
        part = numerator - left * d * 2

        def inside(c: Column) -> Column:
            return F.greatest(zero, F.least(c, s - 1))

        return F.when(inside(left) == j, d * 2 - part).otherwise(0) + F.when(
            inside(left + 1) == j, part
        ).otherwise(0)

    shrinking = d <= s
    first = F.when(shrinking, _exact_div(j * d, s)).otherwise(
        _exact_div((j - 1) * d * 2 + d - s, s * 2)
    )
    last = F.when(shrinking, _exact_div((j + 1) * d - 1, s)).otherwise(
        _exact_div((j + 1) * d * 2 + d - s, s * 2) + 1
    )
    taps = F.transform(
        F.sequence(clip(first), clip(last)),
        lambda i: F.struct(i.alias("i"), F.when(shrinking, shrink(i)).otherwise(grow(i)).alias("weight")),
    )
    return F.filter(taps, lambda t: t["weight"] > 0)


def _axis_total(size: Column, out: Column) -> Column:
    return F.when(out <= size, size).otherwise(out * 2).cast("bigint")


def smooth_resize(pixels: DataFrame, out_w: str, out_h: str) -> DataFrame:
    """Resize each raster to its ``out_w`` by ``out_h`` columns.

    One shuffle: every source pixel is scattered to the outputs it touches and summed with
    map-side combine.
    """
    extra = [c for c in pixels.columns if c not in (*PIXEL_COLUMNS, out_w, out_h)]
    dims = {"w": F.col("w"), "h": F.col("h")}
    spread = (
        pixels.withColumn("_tx", F.explode(_taps(F.col("x"), dims["w"], F.col(out_w))))
        .withColumn("_ty", F.explode(_taps(F.col("y"), dims["h"], F.col(out_h))))
        .withColumn("_wt", F.col("_tx.weight") * F.col("_ty.weight"))
        .withColumn("_wa", F.col("_wt") * F.col("a"))
        .withColumn("_total", _axis_total(dims["w"], F.col(out_w)) * _axis_total(dims["h"], F.col(out_h)))
        .withColumn("_x", F.col("_tx.i").cast("int"))
        .withColumn("_y", F.col("_ty.i").cast("int"))
    )
    sums = spread.groupBy("img", *extra, out_w, out_h, "_total", "_x", "_y").agg(
        F.sum("_wa").alias("_sa"), *[F.sum(F.col("_wa") * F.col(c)).alias(f"_s{c}") for c in "rgb"]
    )

    def rounded(total: Column, parts: Column) -> Column:
        return _exact_div(total + _exact_div(parts, F.lit(2)), parts).cast("int")

    return sums.select(
        "img",
        *extra,
        F.col(out_w).alias("w"),
        F.col(out_h).alias("h"),
        F.col("_x").alias("x"),
        F.col("_y").alias("y"),
        *[F.when(F.col("_sa") > 0, rounded(F.col(f"_s{c}"), F.col("_sa"))).otherwise(0).alias(c) for c in "rgb"],
        rounded(F.col("_sa"), F.col("_total")).alias("a"),
    )


def resize_overlay(
    pixels: DataFrame, out_w: str, out_h: str, keep_aspect: Column, overlay_scale: Column
) -> DataFrame:
    """Stretch to ``out_w`` by ``out_h``, or fit, centre and clip (see ``fit_box``)."""
    box = fit_box(F.col("w"), F.col("h"), F.col(out_w), F.col(out_h), keep_aspect, overlay_scale)
    boxed = pixels.withColumn("_box", box)
    carried = boxed.select(
        *PIXEL_COLUMNS,
        *[c for c in pixels.columns if c not in PIXEL_COLUMNS],
        F.col("_box.fit_w").alias("_fw"),
        F.col("_box.fit_h").alias("_fh"),
        F.col("_box.off_x").alias("_ox"),
        F.col("_box.off_y").alias("_oy"),
    )
    drawn = smooth_resize(carried, "_fw", "_fh")
    placed = (
        drawn.withColumn("x", F.col("x") + F.col("_ox"))
        .withColumn("y", F.col("y") + F.col("_oy"))
        .withColumn("w", F.col(out_w))
        .withColumn("h", F.col(out_h))
        .drop("_ox", "_oy", out_w, out_h)
    )
    return placed.filter("x >= 0 and y >= 0 and x < w and y < h")


def flip(pixels: DataFrame, how: Column) -> DataFrame:
    """Mirror left-right if ``how`` contains ``h``, top-bottom if it contains ``v``."""
    tag = F.coalesce(how, F.lit(""))
    return pixels.withColumn(
        "x", F.when(F.contains(tag, F.lit("h")), F.col("w") - 1 - F.col("x")).otherwise(F.col("x"))
    ).withColumn("y", F.when(F.contains(tag, F.lit("v")), F.col("h") - 1 - F.col("y")).otherwise(F.col("y")))


def rotate(pixels: DataFrame, how: Column) -> DataFrame:
    """Quarter turn ``cw`` or ``ccw``; any other value leaves the raster alone."""
    cw, ccw = F.coalesce(how == "cw", F.lit(False)), F.coalesce(how == "ccw", F.lit(False))
    turned = F.struct(
        F.when(cw | ccw, F.col("h")).otherwise(F.col("w")).alias("w"),
        F.when(cw | ccw, F.col("w")).otherwise(F.col("h")).alias("h"),
        F.when(cw, F.col("h") - 1 - F.col("y")).when(ccw, F.col("y")).otherwise(F.col("x")).alias("x"),
        F.when(cw, F.col("x")).when(ccw, F.col("w") - 1 - F.col("x")).otherwise(F.col("y")).alias("y"),
    )
    moved = pixels.withColumn("_t", turned)
    return moved.select(*[F.col(f"_t.{c}").alias(c) if c in ("w", "h", "x", "y") else F.col(c) for c in pixels.columns])


def rotate_to_fit(
    pixels: DataFrame, how: Column, out_w: str, out_h: str, keep_aspect: Column, overlay_scale: Column
) -> DataFrame:
    """Quarter turn, then refit to ``out_w`` by ``out_h`` where the turn changed the size."""
    turned = rotate(pixels, how)
    off = (F.col("w") != F.col(out_w)) | (F.col("h") != F.col(out_h))
    refit = resize_overlay(turned.filter(off), out_w, out_h, keep_aspect, overlay_scale)
    return turned.filter(~off).drop(out_w, out_h).unionByName(refit)


def blend(base: DataFrame, over: DataFrame, alpha: float | Column) -> DataFrame:
    """Blend ``over(img, x, y, ...)`` onto ``base``; the base alpha is kept."""
    o = over.select("img", "x", "y", *[F.col(c).alias(f"_{c}") for c in CHANNELS])
    joined = base.join(o, ["img", "x", "y"], "left")
    weight = blend_weight(F.coalesce(F.col("_a"), F.lit(0)), alpha)
    mixed = joined.withColumn("_k", weight)
    return mixed.select(
        *[
            blend_channel(F.col(c), F.coalesce(F.col(f"_{c}"), F.lit(0)), F.col("_k")).alias(c)
            if c in ("r", "g", "b")
            else F.col(c)
            for c in base.columns
        ]
    )


def cover(rectangles: DataFrame) -> DataFrame:
    """Rectangles ``(xs, ys, xe, ye)`` exploded to the pixels they contain.

    Makes point-in-rectangle an equi-join on (img, x, y): the output is as large as the
    covered area, never pixels times rectangles.
    """
    return (
        rectangles.withColumn("x", F.explode(F.sequence(F.col("xs"), F.col("xe") - 1)))
        .withColumn("y", F.explode(F.sequence(F.col("ys"), F.col("ye") - 1)))
    )


def fold_regions(base: DataFrame, patches: DataFrame, alpha: float) -> DataFrame:
    """Blend ``patches(img, x, y, ord, r, g, b, a)`` onto ``base`` pixel by pixel, in ``ord``.

    The blend truncates, so order matters: the layers over one pixel are sorted before they
    are folded. A pixel has at most as many layers as its target has regions.
    """
    layers = patches.groupBy("img", "x", "y").agg(
        F.array_sort(F.collect_list(F.struct("ord", *CHANNELS))).alias("_layers")
    )
    joined = base.join(layers, ["img", "x", "y"], "left")

    def step(acc: Column, layer: Column) -> Column:
        k = blend_weight(layer["a"], alpha)
        return F.struct(*[blend_channel(acc[c], layer[c], k).alias(c) for c in ("r", "g", "b")])

    start = F.struct(*[F.col(c).cast("int").alias(c) for c in ("r", "g", "b")])
    folded = joined.withColumn(
        "_out", F.when(F.col("_layers").isNull(), start).otherwise(F.aggregate("_layers", start, step))
    )
    return folded.select(*[F.col(f"_out.{c}").alias(c) if c in ("r", "g", "b") else F.col(c) for c in base.columns])
