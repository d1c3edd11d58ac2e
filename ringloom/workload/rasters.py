"""Queries over rasters: every embedding is an 8x8 image, or a 4x16 strip of four frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.operators import pixels as px
from ringloom.operators.assign import assign_frames, assign_targets
from ringloom.operators.lineage import cut_lineage
from ringloom.operators.ring import prepare_ring
from ringloom.operators.search import priority_top
from ringloom.plans import compose
from ringloom.workload.tables import SEED, placed_sql, position_sql, ring_sql, table

ALPHA = 0.75


def _level(index: str) -> str:
    return f"CAST(least(greatest(floor(CAST(embedding[{index}] AS DOUBLE) * 220 + 128), 0), 255) AS INT)"


def _pixels(spark: SparkSession, sf_dir: str, width: int = 8) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings", "vec_id", "embedding").selectExpr(
        "vec_id AS img", "embedding", "explode(sequence(0, 63)) AS i"
    )
    return cells.selectExpr(
        "img",
        f"{width} AS w",
        f"{64 // width} AS h",
        f"CAST(i % {width} AS INT) AS x",
        f"CAST(i div {width} AS INT) AS y",
        f"{_level('i')} AS r",
        f"{_level('63 - i')} AS g",
        f"({_level('i')} * 3 + i) % 256 AS b",
        f"({_level('(i * 7) % 64')} * 5) % 256 AS a",
    )


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", "vec_id", "label").selectExpr("vec_id AS img", "label")


def _labelled(spark: SparkSession, sf_dir: str, width: int = 8) -> DataFrame:
    return _pixels(spark, sf_dir, width).join(_labels(spark, sf_dir), "img")


def _ring(spark: SparkSession, sf_dir: str):
    sources = table(spark, sf_dir, "embeddings", "vec_id").selectExpr(
        "concat('v', vec_id) AS source", "concat('v', vec_id) AS rel"
    )
    return prepare_ring(sources, SEED)


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "embeddings", "vec_id", "label").selectExpr(
        "vec_id AS img", "label", "concat('t', vec_id) AS rel"
    )
    return assign_targets(targets, _ring(spark, sf_dir), SEED)


def _over(spark: SparkSession, sf_dir: str, width: int = 8) -> DataFrame:
    """Pixels of the source each image was assigned."""
    drawn = _assigned(spark, sf_dir).selectExpr("img AS target", "CAST(substring(overlay, 2) AS BIGINT) AS img")
    return _pixels(spark, sf_dir, width).join(drawn, "img").drop("img").withColumnRenamed("target", "img")


def _out(df: DataFrame) -> DataFrame:
    return df.select(*px.PIXEL_COLUMNS)


def nearest_upscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(px.nearest_upscale(_pixels(spark, sf_dir), 2))


def _resize(width: int, height: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sized = _pixels(spark, sf_dir).withColumn("ow", F.lit(width)).withColumn("oh", F.lit(height))
        return _out(px.smooth_resize(sized, "ow", "oh"))

    return run


def _scale_of_label() -> Column:
    third = F.pmod("label", F.lit(3))
    return F.when(third == 0, F.lit(0.5)).when(third == 1, F.lit(1.0)).otherwise(F.lit(1.5))


def fit_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = (
        _labelled(spark, sf_dir)
        .withColumn("ow", F.lit(12))
        .withColumn("oh", F.lit(6))
        .withColumn("keep", F.pmod("label", F.lit(2)) == 0)
        .withColumn("ov", _scale_of_label())
    )
    return _out(px.resize_overlay(sized, "ow", "oh", F.col("keep"), F.col("ov")))


def _turn() -> Column:
    third = F.pmod("label", F.lit(3))
    return F.when(third == 0, F.lit("cw")).when(third == 1, F.lit("ccw"))


def flip_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.element_at(F.array(*[F.lit(t) for t in ("", "h", "v", "hv")]), F.pmod("label", F.lit(4)) + 1)
    return _out(px.rotate(px.flip(_labelled(spark, sf_dir, 4), tag), _turn()))


def rotate_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _labelled(spark, sf_dir, 4).withColumn("ow", F.lit(4)).withColumn("oh", F.lit(16))
    return _out(px.rotate_to_fit(sized, _turn(), "ow", "oh", F.lit(False), F.lit(1.0)))


def blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(px.blend(_pixels(spark, sf_dir), _over(spark, sf_dir), ALPHA))


def composite_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of another shape are resized to the target before they are blended."""
    over = _over(spark, sf_dir, 4).withColumn("ow", F.lit(8)).withColumn("oh", F.lit(8))
    return _out(px.blend(_pixels(spark, sf_dir), px.smooth_resize(over, "ow", "oh"), 0.4))


def region_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping regions per image, blended in order."""
    rectangles = _labels(spark, sf_dir).select(
        "img",
        F.inline(
            F.expr(
                "array(struct(0 AS ord, 0 AS xs, 0 AS ys, 5 AS xe, 6 AS ye),"
                "struct(1 AS ord, CAST(pmod(label, 4) AS INT) AS xs, 2 AS ys, 7 AS xe, 8 AS ye),"
                "struct(2 AS ord, 3 AS xs, CAST(pmod(label, 3) AS INT) AS ys, 8 AS xe, 5 AS ye))"
            )
        ),
    )
    covered = px.cover(rectangles).withColumn("sx", F.col("x") - F.col("xs")).withColumn("sy", F.col("y") - F.col("ys"))
    over = _over(spark, sf_dir).selectExpr("img", "x AS sx", "y AS sy", "r", "g", "b", "a")
    patches = covered.join(over, ["img", "sx", "sy"]).select("img", "x", "y", "ord", "r", "g", "b", "a")
    return _out(px.fold_regions(_pixels(spark, sf_dir), patches, ALPHA))


def frame_strip_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of four frames has its own source, resized to the frame."""
    strips = table(spark, sf_dir, "embeddings", "vec_id").selectExpr(
        "vec_id AS target", "concat('s', vec_id) AS rel", "4 AS frames"
    )
    framed = assign_frames(strips, _ring(spark, sf_dir), SEED).selectExpr(
        "target", "frame", "CAST(substring(overlay, 2) AS BIGINT) AS source"
    )
    over = _pixels(spark, sf_dir).withColumnRenamed("img", "source").join(framed, "source")
    # One raster per (target, frame): the frame is part of the raster's identity.
    sized = over.select(
        F.struct("target", "frame").alias("img"), *px.PIXEL_COLUMNS[1:], F.lit(4).alias("ow"), F.lit(4).alias("oh")
    )
    small = px.smooth_resize(sized, "ow", "oh").select(
        F.col("img.target").alias("img"), "x", (F.col("y") + F.col("img.frame") * 4).alias("y"), "r", "g", "b", "a"
    )
    return _out(px.blend(_pixels(spark, sf_dir, 4), small, ALPHA))


# Packed rasters ------------------------------------------------------------------------


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    i = np.arange(64)
    for batch in batches:
        if not len(batch):
            continue
        e = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
        q = np.clip(np.floor(e * 220 + 128), 0, 255).astype(np.int64)
        rgba = np.stack([q, q[:, ::-1], (q * 3 + i) % 256, (q[:, (i * 7) % 64] * 5) % 256], axis=-1).astype(np.uint8)
        yield pd.DataFrame({"vec_id": batch["vec_id"], "data": [r.tobytes() for r in rgba]})


def _rasters(spark: SparkSession, sf_dir: str, width: int = 8, only: DataFrame | None = None) -> DataFrame:
    """Packed rasters, of the images ``only`` (vec_id) if they are given."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    if only is not None:
        vectors = vectors.join(only, "vec_id", "left_semi")
    packed = vectors.mapInPandas(_pack, "vec_id bigint, data binary")
    return packed.selectExpr("vec_id", f"{width} AS w", f"{64 // width} AS h", "data")


def _sources(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    return _rasters(spark, sf_dir, 8, only).selectExpr("concat('v', vec_id) AS path", "w", "h", "data")


def _checksums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            img = np.frombuffer(row.data, np.uint8).reshape(row.h, row.w, 4).astype(np.int64)
            at = np.arange(1, row.w * row.h + 1).reshape(row.h, row.w)
            rows.append((row.target, row.w, row.h, *(int((img[..., c] * at).sum()) for c in range(4))))
        yield pd.DataFrame(rows, columns=["target", "w", "h", "r", "g", "b", "a"])


def _band_checksums(bands: DataFrame) -> DataFrame:
    """The same sums from the bands of each output raster."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                img = np.frombuffer(row.data, np.uint8).reshape(-1, row.w, 4).astype(np.int64)
                at = np.arange(1, img.shape[0] * row.w + 1).reshape(-1, row.w) + row.y * row.w
                rows.append((row.target, row.w, row.h, *(int((img[..., c] * at).sum()) for c in range(4))))
            yield pd.DataFrame(rows, columns=["target", "w", "h", "r", "g", "b", "a"])

    parts = bands.mapInPandas(partial, "target string, w int, h int, r bigint, g bigint, b bigint, a bigint")
    return parts.groupBy("target", "w", "h").agg(*[F.sum(c).alias(c) for c in "rgba"])


def checksums(rasters: DataFrame) -> DataFrame:
    """Position-weighted channel sums of each output raster."""
    return rasters.mapInPandas(
        _checksums, "target string, w int, h int, r bigint, g bigint, b bigint, a bigint"
    )


def _with_parameters(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        "*", "2 AS scale", f"CAST({ALPHA} AS DOUBLE) AS alpha", "CAST(1 AS DOUBLE) AS overlay_scale",
        "false AS keep_aspect", "IF(pmod(label, 2) = 0, 20, 0) AS fast_overlay_size",
    )


def bulk_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upscale by two, one source per image; half the images draw from pre-resized sources."""
    assigned = _with_parameters(_assigned(spark, sf_dir)).join(
        _rasters(spark, sf_dir).withColumnRenamed("vec_id", "img"), "img"
    )
    frames = assigned.selectExpr("*", "rel AS target", "1 AS frames", "0 AS frame")
    patches = compose.regular_patches(frames, keep=("w", "h", "data"))
    return checksums(compose.composite_single(patches, _sources(spark, sf_dir)))


REGIONS = (
    # (region_ord, name, x, y, width, height, flip, rotate) on an 8x8 canonical image
    (0, "head", 0, 0, 4, 4, None, None),
    (1, "body", 2, 3, 5, 3, "h", None),
    (2, "leg", 5, 1, 3, 6, None, "cw"),
    (3, "tail", -1, 6, 4, 4, "v", "ccw"),
)


def _entity_images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every image as an entity texture: four regions, each with its own source."""
    targets = _with_parameters(_labels(spark, sf_dir)).selectExpr("*", "concat('t', img) AS target", "concat('t', img) AS texture")
    names = ("region_ord", "name", "x", "y", "width", "height", "flip", "rotate")
    regions = ", ".join(
        "struct(" + ", ".join(f"{'CAST(NULL AS STRING)' if v is None else repr(v)} AS {n}" for n, v in zip(names, r)) + ")"
        for r in REGIONS
    )
    keyed = targets.selectExpr("texture", f"inline(array({regions}))").withColumn("rel", F.concat_ws(":", "texture", "name"))
    faces = assign_targets(keyed, _ring(spark, sf_dir), SEED).drop("rel", "name")
    images = targets.join(_rasters(spark, sf_dir).withColumnRenamed("vec_id", "img"), "img").selectExpr(
        "*", "false AS has_anim", "8 AS tex_w", "8 AS tex_h"
    )
    return images, compose.entity_patches(images.drop("data"), faces)


def bulk_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, patches = _entity_images(spark, sf_dir)
    return checksums(compose.composite_patches(images, patches, _sources(spark, sf_dir)))


def banded_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in bands of three rows: the way of images too large for one row."""
    images, patches = _entity_images(spark, sf_dir)
    bands = compose.composite_bands(images, patches, _sources(spark, sf_dir), band_bytes=3 * 4 * 16)
    return _band_checksums(bands)


def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews of the first fifty images in priority order; the limit comes before the pixels."""
    listed = _assigned(spark, sf_dir).selectExpr("img", "overlay", "rel AS target")
    top = priority_top(listed, "img", 50, ("77", "9"))
    top = cut_lineage(top)  # fifty rows; only their pixels and those of their sources are packed
    pixels = _rasters(spark, sf_dir, 4, top.select(F.col("img").alias("vec_id"))).withColumnRenamed("vec_id", "img")
    drawn_from = top.selectExpr("CAST(substring(overlay, 2) AS BIGINT) AS vec_id").distinct()
    images = top.join(pixels, "img").selectExpr(
        "*", "false AS is_entity", "'' AS texture", "4 AS tex_w", "16 AS tex_h"
    )
    no_faces = spark.sql(
        "SELECT '' AS texture, 0L AS region_ord, '' AS overlay, 0 AS x, 0 AS y, 0 AS width, 0 AS height, '' AS flip, '' AS rotate"
    ).limit(0)
    knobs = {"alpha": ALPHA, "overlay_scale": 0.5, "keep_aspect": False}
    patches = compose.preview_patches(images.drop("data"), no_faces, knobs)
    return checksums(compose.thumbnails(images, patches, _sources(spark, sf_dir, drawn_from)))


QUERIES = {
    "nearest_upscale": nearest_upscale,
    "area_resize": _resize(5, 3),
    "bilinear_resize": _resize(11, 9),
    "fit_resize": fit_resize,
    "flip_rotate": flip_rotate,
    "rotate_refit": rotate_refit,
    "blend": blend,
    "composite_overlay": composite_overlay,
    "region_blend_fold": region_fold,
    "frame_strip_blend": frame_strip_blend,
    "bulk_composite": bulk_composite,
    "bulk_regions": bulk_regions,
    "banded_regions": banded_regions,
    "thumbnails": thumbnails,
}

# Oracle ------------------------------------------------------------------------------


def _level_sql(index: str) -> str:
    return f"least(greatest(floor(embedding[{index} + 1]::DOUBLE * 220 + 128), 0), 255)::INTEGER"


def _pixels_sql(width: int = 8) -> str:
    return (
        f"SELECT vec_id AS img, label, {width} AS w, {64 // width} AS h, (i % {width})::INTEGER AS x, (i // {width})::INTEGER AS y, "
        f"{_level_sql('i')} AS r, {_level_sql('(63 - i)')} AS g, (({_level_sql('i')} * 3 + i) % 256)::INTEGER AS b, "
        f"(({_level_sql('(i * 7) % 64')} * 5) % 256)::INTEGER AS a FROM (SELECT *, unnest(range(64)) AS i FROM embeddings)"
    )


def _taps_sql(pairs: list[tuple[int, int]]) -> str:
    listed = ", ".join(f"({s}, {d})" for s, d in pairs)
    return (
        "SELECT s, d, i::INTEGER AS i, j::INTEGER AS j, CASE WHEN d <= s THEN s ELSE 2 * d END::BIGINT AS tot, "
        "CASE WHEN d <= s THEN greatest(0, least((i + 1) * s, (j + 1) * d) - greatest(i * s, j * d)) "
        "ELSE CASE WHEN greatest(0, least(l, s - 1)) = j THEN 2 * d - (n - l * 2 * d) ELSE 0 END "
        "+ CASE WHEN greatest(0, least(l + 1, s - 1)) = j THEN n - l * 2 * d ELSE 0 END END::BIGINT AS wt FROM ("
        "SELECT *, floor(n / (2.0::DOUBLE * d))::BIGINT AS l FROM (SELECT *, (2 * i + 1) * s - d AS n FROM ("
        f"SELECT s, d, i, unnest(range(s)) AS j FROM (SELECT s, d, unnest(range(d)) AS i FROM (VALUES {listed}) v(s, d)))))"
    )


def _resize_sql(pixels: str, keep: str = "") -> str:
    """``pixels`` carry (ow, oh); ``keep`` lists further columns of a raster."""
    also = f", {keep}" if keep else ""
    rounded = ", ".join(f"CASE WHEN sa > 0 THEN (s{c} + sa // 2) // sa ELSE 0 END::INTEGER AS {c}" for c in "rgb")
    sums = ", ".join(f"sum(tx.wt * ty.wt * p.a * p.{c})::BIGINT AS s{c}" for c in "rgb")
    return (
        f"SELECT img{also}, ow AS w, oh AS h, x, y, {rounded}, ((sa + tot // 2) // tot)::INTEGER AS a FROM ("
        f"SELECT img{also}, ow, oh, tx.i AS x, ty.i AS y, tx.tot * ty.tot AS tot, sum(tx.wt * ty.wt * p.a)::BIGINT AS sa, {sums} "
        f"FROM ({pixels}) p JOIN taps tx ON tx.s = p.w AND tx.d = p.ow AND tx.j = p.x AND tx.wt > 0 "
        "JOIN taps ty ON ty.s = p.h AND ty.d = p.oh AND ty.j = p.y AND ty.wt > 0 GROUP BY ALL)"
    )


def _with_taps(pairs: list[tuple[int, int]], rest: str = "") -> str:
    return f"WITH taps AS MATERIALIZED ({_taps_sql(pairs)}){rest} "


_P8 = _pixels_sql(8)
_P4 = _pixels_sql(4)
_COLUMNS = "img, w, h, x, y, r, g, b, a"
_RING = ring_sql("'v' || vec_id", "'v' || vec_id", "embeddings")


def _assigned_sql(columns: str = "vec_id AS img, label", rel: str = "'t' || vec_id", source: str = "embeddings") -> str:
    names = ", ".join("k." + c.split(" AS ")[-1].strip() for c in columns.split(", "))
    keys = f"SELECT {columns}, {position_sql(repr(f'{SEED}:') + ' || ' + rel)} AS pos FROM {source}"
    return f"SELECT * EXCLUDE (overlay), substr(overlay, 2)::BIGINT AS src FROM ({placed_sql(keys, names, _RING)})"


def _over_sql(pixels: str) -> str:
    return f"SELECT s.img, p.w, p.h, p.x, p.y, p.r, p.g, p.b, p.a FROM ({_assigned_sql()}) s JOIN ({pixels}) p ON p.img = s.src"


def _mix(c: str, base: str, over: str, k: str) -> str:
    """Blend of one channel in 32-bit floats."""
    return f"trunc(({base}{c}::REAL * (1::REAL - {k})) + ({over}{c}::REAL * {k}))::INTEGER"


def _weight(a: str, alpha: float) -> str:
    return f"({a}::REAL * ({alpha}::REAL / 255::REAL)::REAL)"


def _blend_sql(base: str, over: str, alpha: float) -> str:
    mixed = ", ".join(_mix(c, "base_", "over_", "k") + f" AS {c}" for c in "rgb")
    # An uncovered pixel blends with weight zero.
    pair = ", ".join(f"b.{c} AS base_{c}, coalesce(o.{c}, 0) AS over_{c}" for c in "rgb")
    return (
        f"SELECT img, w, h, x, y, {mixed}, a FROM (SELECT b.img, b.w, b.h, b.x, b.y, {pair}, b.a, "
        f"{_weight('coalesce(o.a, 0)', alpha)} AS k FROM ({base}) b LEFT JOIN ({over}) o ON o.img = b.img AND o.x = b.x AND o.y = b.y)"
    )


def _checksum_sql(pixels: str) -> str:
    sums = ", ".join(f"sum({c}::BIGINT * (y * w + x + 1))::BIGINT AS {c}" for c in "rgba")
    return f"SELECT 't' || img AS target, w, h, {sums} FROM ({pixels}) GROUP BY ALL"


def _upscaled_sql(pixels: str, scale: int) -> str:
    return (
        f"SELECT img, label, (w * {scale})::INTEGER AS w, (h * {scale})::INTEGER AS h, (x * {scale} + dx)::INTEGER AS x, (y * {scale} + dy)::INTEGER AS y, r, g, b, a "
        f"FROM ({pixels}), range({scale}) u(dx), range({scale}) v(dy)"
    )


_FIT = (
    "SELECT *, trunc((12 - ow) / 2.0)::INTEGER AS ox, trunc((6 - oh) / 2.0)::INTEGER AS oy FROM (SELECT *, "
    "CASE WHEN fit THEN greatest(1, trunc(8 * s)::INTEGER) ELSE 12 END AS ow, CASE WHEN fit THEN greatest(1, trunc(8 * s)::INTEGER) ELSE 6 END AS oh FROM ("
    "SELECT *, least(trunc(12 * k)::INTEGER::DOUBLE / 8, trunc(6 * k)::INTEGER::DOUBLE / 8) AS s, label % 2 = 0 OR k < 1 AS fit FROM ("
    f"SELECT *, CASE label % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS k FROM ({_P8}))))"
)


def _turn_sql(pixels: str, tag: str) -> str:
    return (
        f"SELECT * REPLACE (CASE WHEN t IN ('cw', 'ccw') THEN h ELSE w END AS w, CASE WHEN t IN ('cw', 'ccw') THEN w ELSE h END AS h, "
        "CASE t WHEN 'cw' THEN h - 1 - y WHEN 'ccw' THEN y ELSE x END AS x, CASE t WHEN 'cw' THEN x WHEN 'ccw' THEN w - 1 - x ELSE y END AS y) "
        f"FROM (SELECT *, {tag} AS t FROM ({pixels}))"
    )


def _flip_sql(pixels: str, tag: str) -> str:
    return (
        "SELECT * REPLACE (CASE WHEN contains(f, 'h') THEN w - 1 - x ELSE x END AS x, CASE WHEN contains(f, 'v') THEN h - 1 - y ELSE y END AS y) "
        f"FROM (SELECT *, coalesce({tag}, '') AS f FROM ({pixels}))"
    )


_LABEL_TURN = "CASE label % 3 WHEN 0 THEN 'cw' WHEN 1 THEN 'ccw' ELSE '' END"
_RECTANGLES = (
    "SELECT vec_id AS img, unnest([{'ord': 0, 'xs': 0, 'ys': 0, 'xe': 5, 'ye': 6}, {'ord': 1, 'xs': label % 4, 'ys': 2, 'xe': 7, 'ye': 8}, "
    "{'ord': 2, 'xs': 3, 'ys': label % 3, 'xe': 8, 'ye': 5}], recursive := true) FROM embeddings"
)


def _fold_sql(base: str, patches: str, orders: int, alpha: float) -> str:
    """Blend patch layers one ``ord`` after the other."""
    current = base
    for i in range(orders):
        current = f"SELECT b.* FROM ({_blend_sql(current, f'SELECT * FROM ({patches}) WHERE ord = {i}', alpha)}) b"
    return current


_FRAMED = _assigned_sql("vec_id AS img, frame", "'s' || vec_id || CASE WHEN frame = 0 THEN '' ELSE ':' || frame END", "(SELECT vec_id, unnest(range(4))::INTEGER AS frame FROM embeddings)")
_STRIP_OVER = (
    "SELECT img, x, (y + frame * 4)::INTEGER AS y, r, g, b, a FROM ("
    + _resize_sql(
        f"SELECT f.img, f.frame, p.w, p.h, p.x, p.y, p.r, p.g, p.b, p.a, 4 AS ow, 4 AS oh FROM ({_FRAMED}) f JOIN ({_P8}) p ON p.img = f.src",
        "frame",
    )
    + ")"
)

# Sources at the size they are drawn from: as they are, or pre-resized to 20.
_VERSIONS = (
    f", p8 AS MATERIALIZED ({_P8}), fixed AS MATERIALIZED ("
    + _resize_sql("SELECT *, 20 AS ow, 20 AS oh FROM p8")
    + "), versions AS (SELECT 0 AS size, img, w, h, x, y, r, g, b, a FROM p8 UNION ALL SELECT 20, img, w, h, x, y, r, g, b, a FROM fixed) "
)
_BULK_OVER = _resize_sql(
    f"SELECT s.img, v.w, v.h, v.x, v.y, v.r, v.g, v.b, v.a, 16 AS ow, 16 AS oh FROM ({_assigned_sql()}) s "
    "JOIN versions v ON v.img = s.src AND v.size = CASE WHEN s.label % 2 = 0 THEN 20 ELSE 0 END"
)
_REGION_VALUES = ", ".join(
    # Origin and size on the doubled 16x16 image, the origin clamped to zero.
    f"({o}, '{n}', {max(x * 2, 0)}, {y * 2}, {min(max(x * 2, 0) + w * 2, 16) - max(x * 2, 0)}, {min(y * 2 + h * 2, 16) - y * 2}, '{f or ''}', '{r or ''}')"
    for o, n, x, y, w, h, f, r in REGIONS
)
_REGION_SIZES = sorted(
    {
        pair
        for _, _, x, y, w, h, _, _ in REGIONS
        for pw, ph in [(min(max(x * 2, 0) + w * 2, 16) - max(x * 2, 0), min(y * 2 + h * 2, 16) - y * 2)]
        for pair in [(8, 20), (8, pw), (8, ph), (20, pw), (20, ph), (pw, ph), (ph, pw), (pw, pw), (ph, ph)]
    }
)
_REGION_KEYS = (
    f"(SELECT e.vec_id, e.label, v.* FROM embeddings e, (VALUES {_REGION_VALUES}) v(ord, name, xs, ys, ws, hs, flip, rotate))"
)
_PLACED = _assigned_sql("vec_id AS img, label, ord, xs, ys, ws, hs, flip, rotate", "'t' || vec_id || ':' || name", _REGION_KEYS)
_REGION_DRAWN = _resize_sql(
    f"SELECT s.img, s.ord, s.xs, s.ys, s.ws, s.hs, s.flip, s.rotate, v.w, v.h, v.x, v.y, v.r, v.g, v.b, v.a, s.ws AS ow, s.hs AS oh FROM ({_PLACED}) s "
    "JOIN versions v ON v.img = s.src AND v.size = CASE WHEN s.label % 2 = 0 THEN 20 ELSE 0 END",
    "ord, xs, ys, ws, hs, flip, rotate",
)
_REGION_TURNED = _turn_sql(_flip_sql(_REGION_DRAWN, "flip"), "rotate")
_REGION_PATCHES = (
    "SELECT img, ord, (x + xs)::INTEGER AS x, (y + ys)::INTEGER AS y, r, g, b, a FROM ("
    "SELECT img, ord, xs, ys, x, y, r, g, b, a FROM turned WHERE w = ws AND h = hs UNION ALL SELECT img, ord, xs, ys, x, y, r, g, b, a FROM ("
    + _resize_sql("SELECT *, ws AS ow, hs AS oh FROM turned WHERE w <> ws OR h <> hs", "ord, xs, ys")
    + "))"
)

_TOP = (
    "SELECT *, CASE WHEN contains('t' || img, '77') THEN 0 WHEN contains('t' || img, '9') THEN 1 ELSE 2 END AS score "
    f"FROM ({_assigned_sql()}) ORDER BY score, img LIMIT 50"
)
_THUMB_BASE = (
    f"SELECT p.img, 148 AS w, 148 AS h, tx::INTEGER AS x, ty::INTEGER AS y, p.r, p.g, p.b, p.a FROM (SELECT * FROM range(148) a(tx), range(148) b(ty)) "
    f"JOIN ({_P4}) p ON p.x = tx * 4 // 148 AND p.y = ty * 4 // 148 WHERE p.img IN (SELECT img FROM top)"
)
_THUMB_OVER = (
    "SELECT img, (x + 37)::INTEGER AS x, (y + 37)::INTEGER AS y, r, g, b, a FROM ("
    + _resize_sql(f"SELECT t.img, p.w, p.h, p.x, p.y, p.r, p.g, p.b, p.a, 74 AS ow, 74 AS oh FROM top t JOIN ({_P8}) p ON p.img = t.src")
    + ")"
)

ORACLE = {
    "nearest_upscale": f"SELECT {_COLUMNS} FROM ({_upscaled_sql(_P8, 2)})",
    "area_resize": _with_taps([(8, 5), (8, 3)]) + _resize_sql(f"SELECT *, 5 AS ow, 3 AS oh FROM ({_P8})"),
    "bilinear_resize": _with_taps([(8, 11), (8, 9)]) + _resize_sql(f"SELECT *, 11 AS ow, 9 AS oh FROM ({_P8})"),
    "fit_resize": (
        _with_taps([(8, d) for d in range(1, 19)])
        + "SELECT img, 12 AS w, 6 AS h, x, y, r, g, b, a FROM (SELECT img, (x + ox)::INTEGER AS x, (y + oy)::INTEGER AS y, r, g, b, a FROM ("
        + _resize_sql(_FIT, "ox, oy")
        + ")) WHERE x BETWEEN 0 AND 11 AND y BETWEEN 0 AND 5"
    ),
    "flip_rotate": (
        f"SELECT {_COLUMNS} FROM ({_turn_sql(_flip_sql(_P4, '''CASE label % 4 WHEN 1 THEN 'h' WHEN 2 THEN 'v' WHEN 3 THEN 'hv' ELSE '' END'''), _LABEL_TURN)})"
    ),
    "rotate_refit": (
        _with_taps([(16, 4), (4, 16)])
        + f", turned AS ({_turn_sql(_P4, _LABEL_TURN)}) "
        + f"SELECT {_COLUMNS} FROM turned WHERE w = 4 UNION ALL SELECT {_COLUMNS} FROM ("
        + _resize_sql("SELECT *, 4 AS ow, 16 AS oh FROM turned WHERE w <> 4")
        + ")"
    ),
    "blend": _blend_sql(_P8, _over_sql(_P8), ALPHA),
    "composite_overlay": (
        _with_taps([(4, 8), (16, 8)])
        + _blend_sql(_P8, _resize_sql(f"SELECT *, 8 AS ow, 8 AS oh FROM ({_over_sql(_P4)})"), 0.4)
    ),
    "region_blend_fold": (
        f"WITH over AS MATERIALIZED ({_over_sql(_P8)}), patches AS MATERIALIZED (SELECT o.img, r.ord, (o.x + r.xs)::INTEGER AS x, (o.y + r.ys)::INTEGER AS y, o.r, o.g, o.b, o.a "
        f"FROM ({_RECTANGLES}) r JOIN over o ON o.img = r.img AND o.x + r.xs < r.xe AND o.y + r.ys < r.ye) "
        + _fold_sql(_P8, "SELECT * FROM patches", 3, ALPHA)
    ),
    "frame_strip_blend": _with_taps([(8, 4)]) + _blend_sql(_P4, _STRIP_OVER, ALPHA),
    "bulk_composite": (
        _with_taps([(8, 20), (8, 16), (20, 16)], _VERSIONS)
        + _checksum_sql(_blend_sql(_upscaled_sql("SELECT * FROM p8", 2), _BULK_OVER, ALPHA))
    ),
    "bulk_regions": (
        _with_taps(_REGION_SIZES, _VERSIONS)
        + f", turned AS MATERIALIZED ({_REGION_TURNED}), patches AS MATERIALIZED ({_REGION_PATCHES}) "
        + _checksum_sql(_fold_sql(_upscaled_sql("SELECT * FROM p8", 2), "SELECT * FROM patches", 4, ALPHA))
    ),
    "thumbnails": (
        _with_taps([(8, 74)], f", top AS MATERIALIZED ({_TOP})")
        + _checksum_sql(_blend_sql(_THUMB_BASE, _THUMB_OVER, ALPHA))
    ),
}
ORACLE["banded_regions"] = ORACLE["bulk_regions"]
