"""Compositing: from assignments and rasters to output rasters.

Everything drawn is a patch: one source made to cover one rectangle of one target. A regular
target has a patch per frame, an entity target one per region and frame. Patches are small
rows until they meet their source.

* A target with one patch meets its source raster directly and is finished in that task; its
  pixels move once.
* A target with several patches: each patch meets its source, is resized there, and only the
  resized rectangles travel to the target, where they are blended in order.
* A target that is too large for one row once it is upscaled is drawn in bands of rows, see
  :func:`composite_bands`.

Source rasters are broadcast if they were measured to fit; otherwise the join is salted, so
a source that serves a large share of all patches is spread over tasks. Either way a source
enters a task's Python once, not once per patch, and equal rectangles are drawn once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringloom.functions.geometry import region_bounds
from ringloom.operators import raster_kernel as kernel
from ringloom.operators import raster_view as views
from ringloom.operators import sizing
from ringloom.operators.rows import map_rows, map_rows_many

PARAMETERS = ["scale", "alpha", "overlay_scale", "keep_aspect", "fast_overlay_size"]
PATCHES_PER_SALT = 20_000
DRAWN_BYTES = 64 << 20
SOURCE_BYTES = 256  # what a broadcast source takes beside its pixels
RASTERS = "target string, w int, h int, data binary"
DRAWN = "target string, ord bigint, xs int, ys int, ws int, hs int, alpha double, pixels binary"
BAND_BYTES = 16 << 20
BASE_BANDS = "target string, band int, w int, h int, y int, rows int, scale int, skip int, data binary"
DRAWN_BANDS = "target string, band int, ord bigint, xs int, ys int, ws int, hs int, alpha double, pixels binary"
BANDS = "target string, w int, h int, y int, data binary"
VERSIONS = "overlay string, size int, sw int, sh int, sdata binary"


def regular_patches(frames: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Patches of ``frames(target, w, h, frames, frame, overlay, *parameters)``.

    A strip whose height is no multiple of its frame count keeps its trailing rows as they are.
    ``keep`` names further columns to carry, such as the raster itself.
    """
    frame_h = F.floor(F.col("h") / F.col("frames")).cast("int") * F.col("scale")
    return frames.select(
        "target",
        F.col("frame").cast("bigint").alias("ord"),
        F.lit(0).alias("xs"),
        (F.col("frame") * frame_h).alias("ys"),
        (F.col("w") * F.col("scale")).alias("ws"),
        frame_h.alias("hs"),
        "overlay",
        F.lit(None).cast("string").alias("flip"),
        F.lit(None).cast("string").alias("rotate"),
        *PARAMETERS,
        *keep,
    )


def entity_patches(targets: DataFrame, faces: DataFrame) -> DataFrame:
    """Patches of entity targets.

    ``targets(target, texture, w, h, has_anim, tex_w, tex_h, *parameters)``;
    ``faces(texture, region_ord, overlay, x, y, width, height, flip, rotate)``. Every frame
    of an animated target gets the same faces. Degenerate rectangles are dropped.
    """
    frame_h = F.when(F.col("has_anim"), F.col("w")).otherwise(F.col("h"))
    frames = F.greatest(F.lit(1), F.floor(F.col("h") / F.col("frame_h")).cast("int"))
    framed = targets.withColumn("frame_h", frame_h).withColumn(
        "frame", F.explode(F.sequence(F.lit(0), frames - 1))
    )
    box = region_bounds(
        *[F.col(c) for c in ("x", "y", "width", "height", "w", "frame_h", "h", "tex_w", "tex_h", "scale", "frame")]
    )
    placed = framed.join(faces, "texture").withColumn("box", box).filter("box is not null")
    return placed.select(
        "target",
        (F.col("frame").cast("bigint") * 4294967296 + F.col("region_ord")).alias("ord"),
        F.col("box.xs").alias("xs"),
        F.col("box.ys").alias("ys"),
        (F.col("box.xe") - F.col("box.xs")).alias("ws"),
        (F.col("box.ye") - F.col("box.ys")).alias("hs"),
        "overlay",
        "flip",
        "rotate",
        *PARAMETERS,
    )


def _fixed_size() -> Column:
    """Pre-resize size a patch draws from: used only if it covers both sides, else 0."""
    size = F.col("fast_overlay_size")
    return F.when((size > 0) & (size >= F.col("ws")) & (size >= F.col("hs")), size).otherwise(0)


def source_versions(patches: DataFrame, sources: DataFrame, keep_aspect: bool) -> DataFrame:
    """``(overlay, size, sw, sh, sdata)``: each source once per size in use, 0 = as it is.

    Only (source, size) pairs some patch draws from are made, each exactly once.
    """
    wanted = patches.select("overlay", _fixed_size().alias("size")).distinct()
    raw = sources.select(
        F.col("path").alias("overlay"), F.col("w").alias("sw"), F.col("h").alias("sh"), F.col("data").alias("sdata")
    )

    def resize(row: dict) -> dict:
        size = row["size"]
        if size == 0:
            return row
        img = kernel.fixed_size(kernel.unpack(row["sdata"], row["sw"], row["sh"]), size, keep_aspect)
        return {**row, "sw": size, "sh": size, "sdata": img.tobytes()}

    pairs = wanted.join(raw, "overlay").select("overlay", "size", "sw", "sh", "sdata")
    return map_rows(pairs, resize, VERSIONS)


def _source_bytes(sources: DataFrame, sizes: DataFrame) -> int:
    """Upper bound of all versions' bytes: every source raw and at every size in use."""
    raw = sources.agg(F.coalesce(F.sum(F.col("w").cast("bigint") * F.col("h") * 4), F.lit(0)), F.count(F.lit(1))).first()
    of_size = F.col("size").cast("bigint") * F.col("size") * 4 + SOURCE_BYTES
    fixed = sizes.agg(F.coalesce(F.sum(of_size), F.lit(0))).first()[0]
    return raw[0] + raw[1] * fixed


class Painter:
    """Turns patch rows into drawn rectangles inside one task.

    A rectangle that was drawn before from the same source in the same way is reused; the
    store is bounded in bytes and emptied when full.
    """

    def __init__(self, find: Callable[[dict], tuple | None]):
        self.find = find
        self.drawn: dict[tuple, np.ndarray] = {}
        self.held = 0

    def patch(self, row: dict) -> np.ndarray | None:
        found = self.find(row)
        if found is None:
            return None
        how = [row[c] for c in ("ws", "hs", "flip", "rotate", "keep_aspect", "overlay_scale")]
        key = (row["overlay"], row["size"], *how)
        img = self.drawn.get(key)
        if img is None:
            width, height, data = found
            img = kernel.region_patch(kernel.unpack(data, width, height), *how)
            if self.held > DRAWN_BYTES:
                self.drawn, self.held = {}, 0
            self.drawn[key] = img
            self.held += img.nbytes
        return img


class LastSource:
    """The source of a run of rows that share it; only the run's first row carries it."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.source: tuple | None = None

    def __call__(self, row: dict) -> tuple | None:
        key = (row["overlay"], row["size"], row["salt"])
        if key != self.key:
            data = row["sdata"]
            self.key, self.source = key, None if data is None else (row["sw"], row["sh"], data)
        return self.source


def map_patches(
    patches: DataFrame,
    sources: DataFrame,
    draw: Callable[[dict, Painter], dict | None],
    schema: str,
    keep_aspect: bool,
    max_broadcast_bytes: int | None = None,
    patches_per_salt: int = PATCHES_PER_SALT,
    tie: tuple[str, ...] = ("target", "ord"),
) -> DataFrame:
    """``draw`` over all patches, each with its source at hand.

    Sources measured to fit are broadcast to the tasks and the patches stay where they are.
    Otherwise patches and sources meet in a salted join; rows of one (source, salt) follow
    each other and only the first carries the source's pixels into Python. ``tie`` tells rows apart.
    """
    sized = patches.withColumn("size", _fixed_size())
    versions = source_versions(patches, sources, keep_aspect)
    bound = _source_bytes(sources, sized.select("size").distinct())
    if bound <= (sizing.BROADCAST_MAX_BYTES if max_broadcast_bytes is None else max_broadcast_bytes):
        rows = versions.collect()  # at most ``bound`` bytes
        shared = patches.sparkSession.sparkContext.broadcast(
            {(r["overlay"], r["size"]): (r["sw"], r["sh"], bytes(r["sdata"])) for r in rows}
        )
        painter = Painter(lambda row: shared.value.get((row["overlay"], row["size"])))
        return map_rows(sized, lambda row: draw(row, painter), schema)
    many, one = sizing.salt_hot_keys(sized, versions, "overlay", list(tie), patches_per_salt)
    runs = Window.partitionBy("overlay", "salt", "size").orderBy(*tie)
    met = many.join(one, ["overlay", "salt", "size"], "left").withColumn("_nth", F.row_number().over(runs))
    first_only = met.withColumn("sdata", F.when(F.col("_nth") == 1, F.col("sdata"))).drop("_nth")
    painter = Painter(LastSource())
    return map_rows(first_only, lambda row: draw(row, painter), schema)


def _upscaled(row: dict) -> np.ndarray:
    return kernel.upscale(kernel.unpack(row["data"], row["w"], row["h"]), row["scale"])


def _raster(target: str, img: np.ndarray) -> dict:
    return {"target": target, "w": img.shape[1], "h": img.shape[0], "data": img.tobytes()}


def _area(img: np.ndarray, at: dict) -> np.ndarray:
    return img[at["ys"] : at["ys"] + at["hs"], at["xs"] : at["xs"] + at["ws"]]


def _finish_single(row: dict, painter: Painter) -> dict:
    img, patch = _upscaled(row), painter.patch(row)
    if patch is not None:
        kernel.blend(_area(img, row), patch, row["alpha"])
    return _raster(row["target"], img)


def _draw_patch(row: dict, painter: Painter) -> dict | None:
    patch = painter.patch(row)
    if patch is None:
        return None
    kept = {c: row[c] for c in ("target", "ord", "xs", "ys", "ws", "hs", "alpha")}
    return {**kept, "pixels": patch.tobytes()}


def _blend_layers(img: np.ndarray, layers: list[dict] | None) -> None:
    for layer in sorted(layers or [], key=lambda p: p["ord"]):
        over = kernel.unpack(layer["pixels"], layer["ws"], layer["hs"])
        kernel.blend(_area(img, layer), over, layer["alpha"])


def _finish_layers(row: dict) -> dict:
    img = _upscaled(row)
    _blend_layers(img, row["layers"])
    return _raster(row["target"], img)


def _with_layers(targets: DataFrame, patches: DataFrame, sources: DataFrame, keep_aspect: bool, **sizes) -> DataFrame:
    """``targets`` plus their drawn patches as one array: what makes up one output image."""
    drawn = map_patches(patches, sources, _draw_patch, DRAWN, keep_aspect, **sizes)
    layers = drawn.groupBy("target").agg(
        F.collect_list(F.struct("ord", "xs", "ys", "ws", "hs", "alpha", "pixels")).alias("layers")
    )
    return targets.join(layers, "target", "left")


def composite_single(
    patches: DataFrame, sources: DataFrame, keep_aspect: bool = False, **sizes
) -> DataFrame:
    """Output rasters of targets that have exactly one patch each.

    ``patches`` carry ``(w, h, data)`` of their target, so with broadcast sources no pixel is
    shuffled at all.
    """
    return map_patches(patches, sources, _finish_single, RASTERS, keep_aspect, **sizes)


def composite_patches(
    targets: DataFrame, patches: DataFrame, sources: DataFrame, keep_aspect: bool = False, **sizes
) -> DataFrame:
    """Output rasters of targets with any number of patches, blended by ``ord``.

    ``targets(target, w, h, data, scale)``. A target without patches is only upscaled.
    """
    base = targets.select("target", "w", "h", "data", "scale")
    return map_rows(_with_layers(base, patches, sources, keep_aspect, **sizes), _finish_layers, RASTERS)


# Large images -------------------------------------------------------------------------------


def _bands(row: dict, band_bytes: int) -> list[dict]:
    """A target cut into bands of output rows, each with the input rows that it shows."""
    img, scale = kernel.unpack(row["data"], row["w"], row["h"]), row["scale"]
    wide, high = row["w"] * scale, row["h"] * scale
    step = rows_in_band(wide, band_bytes)
    made = []
    for n, y in enumerate(range(0, high, step)):
        stop = min(high, y + step)
        first, last = y // scale, -(-stop // scale)
        band = {"target": row["target"], "band": n, "w": wide, "h": high, "y": y, "rows": stop - y}
        made.append({**band, "scale": scale, "skip": y - first * scale, "data": img[first:last].tobytes()})
    return made


def rows_in_band(width: int, band_bytes: int) -> int:
    return max(1, band_bytes // (4 * width))


def _draw_window(row: dict, painter: Painter) -> dict | None:
    """The part of a patch inside one band, made without the rest of the patch."""
    found = painter.find(row)
    if found is None:
        return None
    width, height, data = found
    how = [row[c] for c in ("ws", "hs", "flip", "rotate", "keep_aspect", "overlay_scale")]
    top, stop = max(row["ys"], row["y"]), min(row["ys"] + row["hs"], row["y"] + row["rows"])
    box = views.Box(0, top - row["ys"], row["ws"], stop - row["ys"])
    pixels = views.region_patch(kernel.unpack(data, width, height), *how).window(box)
    kept = {c: row[c] for c in ("target", "band", "ord", "xs", "ws", "alpha")}
    return {**kept, "ys": top - row["y"], "hs": stop - top, "pixels": pixels.tobytes()}


def _finish_band(row: dict) -> dict:
    scale, wide = row["scale"], row["w"]
    shown = kernel.unpack(row["data"], wide // scale, len(row["data"]) * scale // (4 * wide))
    img = np.ascontiguousarray(kernel.upscale(shown, scale)[row["skip"] : row["skip"] + row["rows"]])
    _blend_layers(img, row["layers"])
    return {**{c: row[c] for c in ("target", "w", "h", "y")}, "data": img.tobytes()}


def composite_bands(
    targets: DataFrame,
    patches: DataFrame,
    sources: DataFrame,
    keep_aspect: bool = False,
    band_bytes: int = BAND_BYTES,
    **sizes,
) -> DataFrame:
    """Output rasters as bands ``(target, w, h, y, data)`` of up to ``band_bytes``, for images too large
    to be one row once they are upscaled.

    A patch becomes a row for each band it touches; there only the rows of it that lie in the band
    are drawn, so neither the image nor a patch is ever whole. Bands are folded apart from each other.
    The rasters are those of :func:`composite_patches`.
    """
    base = map_rows_many(
        targets.select("target", "w", "h", "data", "scale"), lambda row: _bands(row, band_bytes), BASE_BANDS
    )
    width = targets.select("target", (F.col("w") * F.col("scale")).alias("_wide"), (F.col("h") * F.col("scale")).alias("_high"))
    step = F.greatest(F.lit(1), F.floor(F.lit(band_bytes) / (F.lit(4) * F.col("_wide"))).cast("int"))
    cut = patches.join(width, "target").withColumn("_step", step).where("ws > 0 AND hs > 0")
    first = F.floor(F.col("ys") / F.col("_step")).cast("int")
    last = F.floor((F.least(F.col("ys") + F.col("hs"), F.col("_high")) - 1) / F.col("_step")).cast("int")
    cut = cut.withColumn("band", F.explode(F.sequence(first, last)))
    cut = cut.withColumn("y", F.col("band") * F.col("_step")).withColumn("rows", F.least(F.col("_step"), F.col("_high") - F.col("y")))
    drawn = map_patches(
        cut.drop("_wide", "_high", "_step"), sources, _draw_window, DRAWN_BANDS, keep_aspect, tie=("target", "ord", "band"), **sizes
    )
    layers = drawn.groupBy("target", "band").agg(
        F.collect_list(F.struct("ord", "xs", "ys", "ws", "hs", "alpha", "pixels")).alias("layers")
    )
    return map_rows(base.join(layers, ["target", "band"], "left"), _finish_band, BANDS)


def thumbnails(targets: DataFrame, patches: DataFrame, sources: DataFrame, **sizes) -> DataFrame:
    """Preview squares.

    ``targets(target, is_entity, w, h, data)`` and ``patches`` from :func:`preview_patches`.
    """
    base = targets.select("target", "is_entity", "w", "h", "data")
    return map_rows(_with_layers(base, patches, sources, False, **sizes), _preview, RASTERS)


def preview_patches(targets: DataFrame, faces: DataFrame, params: dict[str, object]) -> DataFrame:
    """Patches on the preview square; per-path rules and sidecars play no part.

    ``targets(target, is_entity, texture, overlay, w, h, tex_w, tex_h)``. A regular target is
    one patch over the whole square; an entity's regions are scaled into its fitted size and
    are at least one pixel before clamping.
    """
    side = F.lit(kernel.THUMB)
    fit = F.least(side / F.col("w"), side / F.col("h"))

    def fitted(c: str) -> Column:
        return F.greatest(F.lit(1), (F.col(c) * fit).cast("int"))

    knobs = [
        F.lit(1).alias("scale"),
        F.lit(params["alpha"]).cast("double").alias("alpha"),
        F.lit(params["overlay_scale"]).cast("double").alias("overlay_scale"),
        F.lit(params["keep_aspect"]).alias("keep_aspect"),
        F.lit(0).alias("fast_overlay_size"),
    ]
    none = F.lit(None).cast("string")
    regular = targets.filter("not is_entity").select(
        "target", F.lit(0).cast("bigint").alias("ord"), F.lit(0).alias("xs"), F.lit(0).alias("ys"),
        side.alias("ws"), side.alias("hs"), "overlay", none.alias("flip"), none.alias("rotate"), *knobs,
    )

    def canonical(c: str) -> Column:
        return F.greatest(F.lit(1), F.col(c))

    entity = targets.filter("is_entity").drop("overlay").join(faces, "texture")
    sx = F.col("w") / canonical("tex_w") * fit
    sy = F.col("h") / canonical("tex_h") * fit

    def origin(c: str, ratio: Column, top: str) -> Column:
        return F.least(F.greatest(F.round(F.col(c) * ratio).cast("int"), F.lit(0)), F.col(top))

    def extent(c: str, ratio: Column, start: str, top: str) -> Column:
        return F.least(F.greatest(F.lit(1), F.round(F.col(c) * ratio).cast("int")), F.col(top) - F.col(start))

    boxed = (
        entity.withColumn("_tw", fitted("w"))
        .withColumn("_th", fitted("h"))
        .withColumn("xs", origin("x", sx, "_tw"))
        .withColumn("ys", origin("y", sy, "_th"))
        .withColumn("ws", extent("width", sx, "xs", "_tw"))
        .withColumn("hs", extent("height", sy, "ys", "_th"))
        .filter("ws > 0 and hs > 0")
        .select(
            "target", F.col("region_ord").cast("bigint").alias("ord"), "xs", "ys", "ws", "hs",
            "overlay", "flip", "rotate", *knobs,
        )
    )
    return regular.unionByName(boxed)


def _preview(row: dict) -> dict:
    side, w, h = kernel.THUMB, row["w"], row["h"]
    img = kernel.unpack(row["data"], w, h)
    if row["is_entity"]:
        fit = min(side / w, side / h)
        img = kernel.nearest_resize(img, max(1, int(w * fit)), max(1, int(h * fit)))
    else:
        img = kernel.nearest_resize(img[:w] if h > w else img, side, side)
    _blend_layers(img, row["layers"])
    return _raster(row["target"], img if img.shape[:2] == (side, side) else kernel.centred(img, side, side))
