"""The pixel relation and the packed kernel compute the same."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringloom.operators import pixels as px
from ringloom.operators import raster_kernel as kernel
from ringloom.plans import compose

SIZES = [(1, 1, 5, 4), (5, 3, 2, 2), (3, 7, 9, 2), (4, 4, 4, 4), (2, 5, 5, 11), (6, 1, 1, 3)]


def image(seed, w, h):
    img = np.random.default_rng(seed).integers(0, 256, (h, w, 4)).astype(np.uint8)
    img[::2, ::2, 3] = 0
    return img


def relation(spark, images):
    rows = [
        (k, img.shape[1], img.shape[0], x, y, *map(int, img[y, x]))
        for k, img in images.items() for y in range(img.shape[0]) for x in range(img.shape[1])
    ]
    return spark.createDataFrame(rows, "img int, w int, h int, x int, y int, r int, g int, b int, a int")


def packed(df):
    out = {}
    for r in df.collect():
        img = out.setdefault(r["img"], np.zeros((r["h"], r["w"], 4), np.uint8))
        img[r["y"], r["x"]] = [r["r"], r["g"], r["b"], r["a"]]
    return out


@pytest.fixture(scope="module")
def images():
    return {i: image(i, w, h) for i, (w, h, _, _) in enumerate(SIZES)}


def sized(spark, images):
    dims = spark.createDataFrame([(i, a, b) for i, (_, _, a, b) in enumerate(SIZES)], "img int, ow int, oh int")
    return relation(spark, images).join(F.broadcast(dims), "img")


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert np.array_equal(got[k], want[k]), k


def test_smooth_resize(spark, images):
    got = packed(px.smooth_resize(sized(spark, images), "ow", "oh"))
    same(got, {i: kernel.smooth_resize(images[i], a, b) for i, (_, _, a, b) in enumerate(SIZES)})


@pytest.mark.parametrize("keep,scale", [(False, 1.0), (True, 1.0), (False, 0.5), (True, 2.0), (False, 2.0)])
def test_resize_overlay(spark, images, keep, scale):
    got = packed(px.resize_overlay(sized(spark, images), "ow", "oh", F.lit(keep), F.lit(scale)))
    same(got, {i: kernel.resize_overlay(images[i], a, b, keep, scale) for i, (_, _, a, b) in enumerate(SIZES)})


@pytest.mark.parametrize("turn", ["cw", "ccw", None, "half"])
@pytest.mark.parametrize("flip", ["h", "v", "hv", None])
def test_flip_and_rotate(spark, images, turn, flip):
    got = packed(px.rotate(px.flip(relation(spark, images), F.lit(flip).cast("string")), F.lit(turn).cast("string")))
    same(got, {i: kernel.rotate(kernel.flip(img, flip), turn) for i, img in images.items()})


def test_turns_and_flips_undo(images):
    for img in images.values():
        assert np.array_equal(kernel.rotate(kernel.rotate(img, "cw"), "ccw"), img)
        assert np.array_equal(kernel.flip(kernel.flip(img, "hv"), "hv"), img)


@pytest.mark.parametrize("alpha", [0.0, 0.3, 0.75, 1.0])
def test_blend(spark, images, alpha):
    over = {i: image(100 + i, img.shape[1], img.shape[0]) for i, img in images.items()}
    got = packed(px.blend(relation(spark, images), relation(spark, over), alpha))
    want = {}
    for i, img in images.items():
        want[i] = img.copy()
        kernel.blend(want[i], over[i], alpha)
        assert np.array_equal(want[i][..., 3], img[..., 3])
        if alpha == 0.0:
            assert np.array_equal(want[i], img)
    same(got, want)


def test_nearest_upscale(spark, images):
    same(packed(px.nearest_upscale(relation(spark, images), 3)), {i: kernel.upscale(img, 3) for i, img in images.items()})


def patches(spark):
    rows = [
        ("t0", 0, 0, 0, 6, 6, "s0", None, None), ("t0", 1, 2, 1, 4, 5, "s1", "h", "cw"), ("t0", 2, 3, 3, 3, 3, "s0", "v", "ccw"),
        ("t1", 0, 0, 0, 4, 8, "s0", None, None),
    ]
    df = spark.createDataFrame(rows, "target string, ord bigint, xs int, ys int, ws int, hs int, overlay string, flip string, rotate string")
    return rows, df.selectExpr("*", "2 AS scale", "0.6D AS alpha", "1D AS overlay_scale", "false AS keep_aspect", "IF(ws = 6, 7, 0) AS fast_overlay_size")


@pytest.mark.parametrize("limit", [None, 0])
def test_composites_agree_broadcast_or_salted(spark, limit):
    sources = {"s0": image(50, 5, 5), "s1": image(51, 3, 4)}
    targets = {"t0": image(60, 3, 3), "t1": image(61, 2, 4), "bare": image(62, 2, 2)}

    def table(d, name):
        return spark.createDataFrame([(k, v.shape[1], v.shape[0], bytearray(v.tobytes())) for k, v in d.items()], f"{name} string, w int, h int, data binary")

    rows, df = patches(spark)
    out = compose.composite_patches(table(targets, "target").withColumn("scale", F.lit(2)), df, table(sources, "path"), max_broadcast_bytes=limit, patches_per_salt=1)
    got = {r["target"]: kernel.unpack(bytes(r["data"]), r["w"], r["h"]) for r in out.collect()}
    want = {k: kernel.upscale(v, 2).copy() for k, v in targets.items()}
    for t, _, xs, ys, w, h, s, flip, turn in rows:
        source = kernel.fixed_size(sources[s], 7, False) if w == 6 else sources[s]
        kernel.blend(want[t][ys : ys + h, xs : xs + w], kernel.region_patch(source, w, h, flip, turn, False, 1.0), 0.6)
    same(got, want)


def test_entity_preview_is_fitted_and_centred(spark):
    base, source = image(70, 8, 4), image(71, 3, 3)
    targets = spark.createDataFrame([("t", True, "tex", "s", 8, 4, 8, 4, bytearray(base.tobytes()))], "target string, is_entity boolean, texture string, overlay string, w int, h int, tex_w int, tex_h int, data binary")
    faces = spark.createDataFrame([("tex", 0, "s", 0, 0, 4, 4, "h", None), ("tex", 1, "s", 7, 3, 9, 9, None, None)], "texture string, region_ord bigint, overlay string, x int, y int, width int, height int, flip string, rotate string")
    sources = spark.createDataFrame([("s", 3, 3, bytearray(source.tobytes()))], "path string, w int, h int, data binary")
    knobs = {"alpha": 0.5, "overlay_scale": 1.0, "keep_aspect": False}
    row = compose.thumbnails(targets, compose.preview_patches(targets, faces, knobs), sources).first()
    want = kernel.nearest_resize(base, 148, 74).copy()
    kernel.blend(want[0:74, 0:74], kernel.region_patch(source, 74, 74, "h", None, False, 1.0), 0.5)
    # 7 * 18.5 = 129.5 and 3 * 18.5 = 55.5, rounded away from zero, then cut at the edge.
    kernel.blend(want[56:74, 130:148], kernel.region_patch(source, 18, 18, None, None, False, 1.0), 0.5)
    assert np.array_equal(kernel.unpack(bytes(row["data"]), 148, 148), kernel.centred(want, 148, 148))
