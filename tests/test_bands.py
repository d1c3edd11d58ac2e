"""Images drawn in bands, against the same images drawn whole."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ringloom.operators import raster_kernel as kernel
from ringloom.operators import raster_view as views
from ringloom.plans import compose


def image(seed: int, w: int, h: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    img = draw.integers(0, 256, (h, w, 4)).astype(np.uint8)
    img[draw.random((h, w)) < 0.2, 3] = 0
    return img


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_any_window_equals_the_whole(data):
    size = st.integers(1, 24)
    source = image(data.draw(st.integers(0, 99)), data.draw(size), data.draw(size))
    w, h = data.draw(size), data.draw(size)
    how = (w, h, data.draw(st.sampled_from([None, "h", "v", "hv"])), data.draw(st.sampled_from([None, "cw", "ccw"])),
           data.draw(st.booleans()), data.draw(st.sampled_from([0.3, 1.0, 1.7])))
    whole, view = kernel.region_patch(source, *how), views.region_patch(source, *how)
    assert (view.h, view.w) == whole.shape[:2] == (h, w)
    x0, y0 = data.draw(st.integers(0, w - 1)), data.draw(st.integers(0, h - 1))
    box = views.Box(x0, y0, data.draw(st.integers(x0 + 1, w)), data.draw(st.integers(y0 + 1, h)))
    assert np.array_equal(view.window(box), whole[box.y0 : box.y1, box.x0 : box.x1])


@pytest.mark.parametrize("band_bytes, most", [(1, None), (4 * 60 * 7, None), (4 * 60 * 7, 0), (1 << 20, None)])
def test_bands_equal_whole_images(spark, band_bytes, most):
    draw = np.random.default_rng(3)
    sources = {f"s{i}": image(i, 5 + i, 9 - i) for i in range(4)}
    targets, patches = {}, []
    for n, (w, h, scale) in enumerate([(20, 11, 3), (7, 30, 2), (1, 1, 5), (4, 4, 1)]):
        targets[f"t{n}"] = (image(40 + n, w, h), scale)
        for order in range(4 if n < 3 else 0):
            xs, ys = int(draw.integers(0, w * scale)), int(draw.integers(0, h * scale))
            ws, hs = int(draw.integers(1, w * scale - xs + 1)), int(draw.integers(1, h * scale - ys + 1))
            patches.append((f"t{n}", order, xs, ys, ws, hs, f"s{order % 5}" if order < 3 else "none", [None, "h", "v", "hv"][order], [None, "cw", "ccw", None][n],
                            scale, 0.6, 0.8 if order == 1 else 1.0, order == 2, 40 if order == 0 else 0))
    t = spark.createDataFrame([(k, i.shape[1], i.shape[0], i.tobytes(), s) for k, (i, s) in targets.items()], "target string, w int, h int, data binary, scale int")
    p = spark.createDataFrame(patches, "target string, ord bigint, xs int, ys int, ws int, hs int, overlay string, flip string, rotate string, "
                              "scale int, alpha double, overlay_scale double, keep_aspect boolean, fast_overlay_size int")  # fmt: skip
    s = spark.createDataFrame([(k, i.shape[1], i.shape[0], i.tobytes()) for k, i in sources.items()], "path string, w int, h int, data binary")
    want = {r["target"]: (r["w"], r["h"], bytes(r["data"])) for r in compose.composite_patches(t, p, s).collect()}
    made = compose.composite_bands(t, p, s, band_bytes=band_bytes, max_broadcast_bytes=most, patches_per_salt=2).collect()
    got = {}
    for r in sorted(made, key=lambda r: (r["target"], r["y"])):
        assert len(r["data"]) <= max(band_bytes, 4 * r["w"])
        w, h, data = got.get(r["target"], (r["w"], r["h"], b""))
        assert r["y"] * r["w"] * 4 == len(data)
        got[r["target"]] = (w, h, data + bytes(r["data"]))
    assert got == want
