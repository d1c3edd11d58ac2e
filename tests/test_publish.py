"""A whole run over generated image files, checked against a per-image recomputation."""

from __future__ import annotations

import json
import os
import pathlib
import struct
import zlib

import numpy as np
import pytest

from ringloom.functions.hashing import literal_state
from ringloom.operators import raster_kernel as kernel
from ringloom.operators.lineage import shared_folder
from ringloom.plans import compose
from ringloom.plans.publish import composite_inputs, publish, stage_inputs, undecodable
from ringloom.sources import files, store
from ringloom.sources.params import RunParameters, read_parameters


def png(kind: int, width: int, height: int, rows: np.ndarray, *chunks: tuple[bytes, bytes]) -> bytes:
    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    raw = b"".join(b"\0" + bytes(r.astype(np.uint8).ravel().tolist()) for r in rows)
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    body = b"".join(chunk(n, b) for n, b in chunks)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + body + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def rgba(seed: int, width: int, height: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, (height, width, 4)).astype(np.uint8)


CATALOGUE = {
    "cat": {
        "texture_size": [8, 8],
        "regions": [
            {"name": "head", "x": 0, "y": 0, "width": 4, "height": 4},
            {"name": "body", "x": 2, "y": 2, "width": 6, "height": 3, "flip": "h"},
            {"name": "leg", "x": -1, "y": 5, "width": 3, "height": 3, "rotate": "cw"},
        ],
        "textures": ["entity/cat.png"],
    }
}


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    sources, targets, catalogue = root / "sources", root / "targets", root / "catalogue"
    for d in (sources / "deep", targets / "entity", targets / "block", catalogue):
        d.mkdir(parents=True)
    pixels = {}

    def put(folder, rel, img):
        path = folder / rel
        path.write_bytes(png(6, img.shape[1], img.shape[0], img))
        pixels[str(path)] = img

    for i, (w, h) in enumerate([(6, 6), (9, 5), (4, 12), (16, 16)]):
        put(sources, f"s{i}.png", rgba(i, w, h))
    put(sources, "deep/UPPER.PNG", rgba(9, 7, 7))
    put(sources, "my overlay+50%.png", rgba(10, 6, 6))
    put(sources, "p%C3 x.png", rgba(11, 6, 5))
    put(targets, "block/a b.png", rgba(25, 5, 5))
    put(targets, "block/e%20f+g é.png", rgba(26, 4, 5))
    put(targets, "entity/cat.png", rgba(20, 8, 8))
    put(targets, "block/plain.png", rgba(21, 5, 4))
    put(targets, "block/strip.png", rgba(22, 3, 9))
    put(targets, "block/ragged.png", rgba(23, 3, 10))
    put(targets, "block/still.png", rgba(24, 3, 9))
    (targets / "block/strip.png.mcmeta").write_text('{"animation": {}}')
    (targets / "block/ragged.png.mcmeta").write_text('{"animation": {"frametime": 2}}')
    (targets / "block/still.png.mcmeta").write_text('{"other": 1}')
    (targets / "notes.txt").write_text("keep me")
    (targets / "broken.png").write_bytes(b"no image")
    (catalogue / "cat.json").write_text(json.dumps(CATALOGUE))
    return root, pixels


def final(h: int) -> int:
    h = (h ^ (h >> 16)) * 73244475 & 0xFFFFFFFF
    return h ^ (h >> 16)


def place(key: str, sources: list[str], root: str, seed: int) -> str:
    pos = final(literal_state(f"{seed}:{key}"))
    ring = sorted((final(literal_state(f"{seed}:overlay:{os.path.relpath(s, root)}")), s) for s in sources)
    return next((s for p, s in ring if p >= pos), ring[0][1])


def draw(source, w, h, size, keep, over, flip=None, turn=None):
    if size and size >= w and size >= h:
        source = kernel.fixed_size(source, size, keep)
    return kernel.region_patch(source, w, h, flip, turn, keep, over)


@pytest.mark.parametrize(
    "params",
    [
        RunParameters(seed=42, scale=2, fast_overlay_size=0, per_frame=True),
        RunParameters(seed=7, scale=3, fast_overlay_size=16, alpha=0.4, keep_aspect=True, entity_face_mode="different",
                      entity_texture_mode="separate", path_config='{"block/p": {"scale": 1, "alpha": 1.0}}'),
    ],
)
def test_run_matches_per_image_recomputation(spark, folders, tmp_path, params):
    root, pixels = folders
    params = RunParameters(**{
        **params.__dict__, "overlay_dir": str(root / "sources"), "texture_dir": str(root / "targets"),
        "entity_regions": str(root / "catalogue"), "output_dir": str(tmp_path / "out"),
    })
    got = {r["rel"]: r for r in composite_inputs(stage_inputs(spark, params, str(tmp_path / "stage"), str(tmp_path / "rejects")), params).collect()}
    sources = [p for p in pixels if "/sources/" in p]
    src_root, dst_root = str(root / "sources"), str(root / "targets")

    def source_for(key):
        return pixels[place(key, sources, src_root, params.seed)]

    assert sorted(got) == [
        "block/a b.png", "block/e%20f+g é.png", "block/plain.png", "block/ragged.png", "block/still.png", "block/strip.png", "entity/cat.png",
    ]
    for rel, row in got.items():
        img = pixels[os.path.join(dst_root, rel)]
        override = params.path_config and rel.startswith("block/p")
        scale, alpha = (1, 1.0) if override else (params.scale, params.alpha)
        size, keep = params.fast_overlay_size, params.keep_aspect
        want = kernel.upscale(img, scale).copy()
        h, w = img.shape[:2]
        if rel.startswith("entity/"):
            for region in CATALOGUE["cat"]["regions"]:
                key = "cat"
                if params.entity_texture_mode == "separate":
                    key += ":entity/cat.png"
                if params.entity_face_mode == "different":
                    key += f":{region['name']}"
                xs, ys = max(0, region["x"] * scale), max(0, region["y"] * scale)
                xe, ye = min(xs + region["width"] * scale, w * scale), min(ys + region["height"] * scale, h * scale)
                patch = draw(source_for(key), xe - xs, ye - ys, size, keep, 1.0, region.get("flip"), region.get("rotate"))
                kernel.blend(want[ys:ye, xs:xe], patch, alpha)
        else:
            frames = 3 if rel in ("block/strip.png", "block/ragged.png") else 1
            fh = h // frames * scale
            for f in range(frames):
                key = f"{rel}:{f}" if f and params.per_frame else rel
                kernel.blend(want[f * fh : (f + 1) * fh], draw(source_for(key), w * scale, fh, size, keep, 1.0), alpha)
        assert (row["w"], row["h"]) == (w * scale, h * scale)
        assert np.array_equal(kernel.unpack(row["data"], row["w"], row["h"]), want), rel


def test_publish_writes_images_copies_and_manifest(spark, folders, tmp_path):
    root, _ = folders
    params = RunParameters(
        overlay_dir=str(root / "sources"), texture_dir=str(root / "targets"), entity_regions=str(root / "catalogue"),
        output_dir=str(tmp_path / "out"), scale=2, path_config='{"block/p":{"scale":1}}',
    ).with_seed("spring")
    publish(spark, params, png=True, staging=str(tmp_path / "stage"), skip_undecodable=True)
    assert {r["rel"] for r in spark.read.parquet(str(tmp_path / "out" / "rejects")).collect()} == {"broken.png"}
    tree = tmp_path / "out/tree"
    assert (tree / "notes.txt").read_text() == "keep me"
    assert (tree / "block/strip.png.mcmeta").exists()
    written = {r["rel"]: r for r in spark.read.parquet(str(tmp_path / "out/rasters")).collect()}
    again = {r["rel"]: r for r in files.read_rasters(spark, str(tree)).collect()}
    assert {k: bytes(v["data"]) for k, v in again.items()} == {k: bytes(v["data"]) for k, v in written.items()}
    assert read_parameters(spark, str(tmp_path / "out/manifest")) == params
    # A second run without overwrite adds nothing.
    publish(spark, params, overwrite=False, skip_undecodable=True)
    assert not any(p.name.startswith("staged-") for p in pathlib.Path(shared_folder(spark)).iterdir())
    assert spark.read.parquet(str(tmp_path / "out/rasters")).count() == len(written)
    assert [r["rel"] for r in undecodable(spark, params.texture_dir).collect()] == ["broken.png"]


def test_large_images_are_drawn_in_bands(spark, folders, tmp_path):
    """Everything above some pixels counts as large: the same pixels come out, in files too."""
    root, _ = folders
    base = RunParameters(overlay_dir=str(root / "sources"), texture_dir=str(root / "targets"), entity_regions=str(root / "catalogue"),
                         seed=5, scale=3, per_frame=True, fast_overlay_size=0, entity_face_mode="different")
    runs = {}
    for name, limit in (("whole", 1 << 30), ("bands", 800)):
        params = RunParameters(**{**base.__dict__, "output_dir": str(tmp_path / name)})
        publish(spark, params, png=True, skip_undecodable=True, large_bytes=limit, band_bytes=250)
        tree = {str(p.relative_to(tmp_path / name)): p for p in (tmp_path / name / "tree").rglob("*") if p.is_file()}
        runs[name] = ({r["rel"]: bytes(r["data"]) for r in files.read_rasters(spark, str(tmp_path / name / "tree")).collect()}, sorted(tree))
    assert runs["whole"] == runs["bands"]
    bands = spark.read.parquet(str(tmp_path / "bands/bands"))
    assert bands.select("rel").distinct().count() >= 4 and spark.read.parquet(str(tmp_path / "bands/rasters")).count() >= 1
    assert bands.groupBy("rel").count().agg({"count": "max"}).first()[0] > 5
    publish(spark, params, overwrite=False, skip_undecodable=True, large_bytes=800)
    assert spark.read.parquet(str(tmp_path / "bands/bands")).count() == bands.count()


def test_empty_inputs_are_errors(spark, folders, tmp_path):
    root, _ = folders
    (tmp_path / "none").mkdir()
    bad = RunParameters(overlay_dir=str(tmp_path / "none"), texture_dir=str(root / "targets"), output_dir=str(tmp_path / "o"))
    with pytest.raises(ValueError, match="No overlay images found"):
        publish(spark, bad)
    with pytest.raises(ValueError, match="output_dir"):
        publish(spark, RunParameters(overlay_dir=str(root / "sources"), texture_dir=str(root / "targets")))


def test_decoding_palette_and_gray(spark, tmp_path):
    palette = (b"PLTE", bytes([10, 20, 30, 200, 100, 50])), (b"tRNS", bytes([0, 128]))
    (tmp_path / "pal.png").write_bytes(png(3, 2, 1, np.array([[0, 1]]), *palette))
    (tmp_path / "gray.png").write_bytes(png(0, 2, 1, np.array([[7, 250]])))
    got = {r["rel"]: list(r["data"]) for r in files.read_rasters(spark, str(tmp_path)).collect()}
    assert got == {"pal.png": [10, 20, 30, 0, 200, 100, 50, 128], "gray.png": [7, 7, 7, 255, 250, 250, 250, 255]}


def test_faults_are_said(spark, folders, tmp_path):
    root, _ = folders
    params = RunParameters(overlay_dir=str(root / "sources"), texture_dir=str(root / "targets"), output_dir=str(tmp_path / "out"))
    with pytest.raises(ValueError, match="broken.png"):
        publish(spark, params, staging=str(tmp_path / "stage"))
    with pytest.raises(ValueError, match="no folder"):
        publish(spark, RunParameters(**{**params.__dict__, "texture_dir": str(tmp_path / "absent")}))


def test_names_that_spark_passes_over_are_drawn(spark, folders, tmp_path):
    """Files and folders that begin with an underscore, as images, strips with sidecars and others."""
    root, _ = folders
    sources, targets = tmp_path / "src", tmp_path / "dst"
    for rel in ("_s.png", "deep/_d/t.png", "u_v.png"):
        (sources / rel).parent.mkdir(parents=True, exist_ok=True)
        (sources / rel).write_bytes(png(6, 4, 4, rgba(len(rel), 4, 4)))
    for rel in ("_a.png", "_x/b.png", "y/_c=1.png", "plain.png", "_x/strip.png"):
        (targets / rel).parent.mkdir(parents=True, exist_ok=True)
        (targets / rel).write_bytes(png(6, 3, 9, rgba(30 + len(rel), 3, 9)))
    (targets / "_x/strip.png.mcmeta").write_text('{"animation": {}}')
    (targets / "_x/_note.txt").write_text("copied")
    (targets / ".secret.png").write_bytes(b"passed over")
    params = RunParameters(overlay_dir=str(sources), texture_dir=str(targets), output_dir=f"file://{tmp_path}/out", scale=1, alpha=1.0, fast_overlay_size=0)
    publish(spark, params, png=True)
    drawn = {r["rel"]: r for r in spark.read.parquet(str(tmp_path / "out/rasters")).collect()}
    assert sorted(drawn) == ["_a.png", "_x/b.png", "_x/strip.png", "plain.png", "y/_c=1.png"]
    listed = [str(p.relative_to(sources)) for p in sources.rglob("*.png")]
    for rel, row in drawn.items():
        frames = 3 if rel == "_x/strip.png" else 1
        img = rgba(30 + len(rel), 3, 9).copy()
        for f in range(frames):
            pos = final(literal_state(f"{params.seed}:{rel}" + (f":{f}" if f and params.per_frame else "")))
            ring = sorted((final(literal_state(f"{params.seed}:overlay:{s}")), s) for s in listed)
            chosen = next((s for p, s in ring if p >= pos), ring[0][1])
            h = 9 // frames
            kernel.blend(img[f * h : (f + 1) * h], draw(rgba(len(chosen), 4, 4), 3, h, 0, False, 1.0), 1.0)
        assert np.array_equal(kernel.unpack(row["data"], 3, 9), img), rel
    tree = tmp_path / "out/tree"
    found = sorted(str(p.relative_to(tree)) for p in tree.rglob("*") if p.is_file())
    assert found == ["_a.png", "_x/_note.txt", "_x/b.png", "_x/strip.png", "_x/strip.png.mcmeta", "plain.png", "y/_c=1.png"]
    listing = store.list_tree(spark, f"file://{tree}")
    shown = files.reveal(spark, str(tree), listing, str(tmp_path / "shown"))
    again = {r["rel"]: bytes(r["data"]) for r in files.read_rasters(spark, str(tree), shown).collect()}
    assert again == {k: bytes(v["data"]) for k, v in drawn.items()}


def filtered(rows: np.ndarray, step: int, draw) -> bytes:
    """Scan lines of a PNG, each with a filter drawn anew (1 left, 2 up, 3 mean, 4 nearest of three)."""
    out, above = b"", np.zeros(rows.shape[1], np.int64)
    for row in rows.astype(np.int64):
        kind = int(draw.integers(0, 5))
        left, corner = np.r_[[0] * step, row[:-step]], np.r_[[0] * step, above[:-step]]
        guess = left + above - corner
        by = [abs(guess - left), abs(guess - above), abs(guess - corner)]
        nearest = np.where((by[0] <= by[1]) & (by[0] <= by[2]), left, np.where(by[1] <= by[2], above, corner))
        near = [0 * row, left, above, (left + above) // 2, nearest][kind]
        out += bytes([kind]) + ((row - near) % 256).astype(np.uint8).tobytes()
        above = row
    return out


@pytest.mark.parametrize("depth", [8, 16])
def test_gray_with_alpha_keeps_its_alpha(spark, tmp_path, depth):
    draw_ = np.random.default_rng(depth)
    w, h, step = 7, 23, depth // 4
    values = draw_.integers(0, 256, (h, w * step)).astype(np.uint8)

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    raw = zlib.compress(filtered(values, step, draw_))
    head = struct.pack(">IIBBBBB", w, h, depth, 4, 0, 0, 0)
    content = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", raw[:9]) + chunk(b"IDAT", raw[9:]) + chunk(b"IEND", b"")
    (tmp_path / "ga.png").write_bytes(content)
    (tmp_path / "woven.png").write_bytes(content[:28] + b"\x01" + content[29:])  # interlaced: not decoded
    (tmp_path / "cut.png").write_bytes(content[:60])
    (tmp_path / "rgba.png").write_bytes(png(6, 2, 2, rgba(1, 2, 2)))
    got = {r["rel"]: r for r in files.read_rasters(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["ga.png", "rgba.png"]
    levels = values.reshape(h, w, 2, step // 2)
    flat = levels[..., 0] if depth == 8 else ((levels[..., 0].astype(int) * 256 + levels[..., 1] + 128) // 257).astype(np.uint8)
    want = np.stack([flat[..., 0]] * 3 + [flat[..., 1]], axis=2)
    assert np.array_equal(np.frombuffer(got["ga.png"]["data"], np.uint8).reshape(h, w, 4), want)


def test_failed_write_leaves_nothing(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "d").mkdir(parents=True)
    (root / "d/a.txt").write_text("old")
    good = [(f"d/{i}.txt", f"new {i}".encode(), None) for i in range(20)]
    bad = spark.createDataFrame([*good, ("d/x.txt", None, "absent.txt")], store.FILE_COLUMNS)
    with pytest.raises(Exception, match="absent"):
        store.write_files(bad.repartition(4), str(root), str(tmp_path))
    assert [str(p.relative_to(root)) for p in root.rglob("*")] == ["d", "d/a.txt"]
    (tmp_path / "big.bin").write_bytes(bytes(range(256)) * 100_000)
    rows = [*good, ("d/a.txt", b"", None), ("e/big.bin", None, "big.bin")]
    store.write_files(spark.createDataFrame(rows, store.FILE_COLUMNS).repartition(4), f"file://{root}", str(tmp_path))
    found = {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}
    assert found == {r[0]: r[1] for r in good} | {"d/a.txt": b"", "e/big.bin": (tmp_path / "big.bin").read_bytes()}
    store.write_files(spark.createDataFrame([], store.FILE_COLUMNS), str(root))
    assert not any(p.name.startswith(".") for p in root.iterdir())


def test_small_files_share_tasks(spark, tmp_path):
    """Spark would take some thirty small files to a task."""
    for i in range(600):
        (tmp_path / f"n{i}.txt").write_bytes(b"x")
    found = files.read_other_files(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert found.count() == 600


def shaped(kind: int, depth: int, seed: int, *chunks: bytes, woven: int = 0) -> tuple[bytes, np.ndarray]:
    """A PNG of 9 by 7 whose scan lines have drawn filters, ``chunks`` before its pixels, and its samples."""
    draw_, channels = np.random.default_rng(seed), {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    step = channels * depth // 8
    values = draw_.integers(0, 2 if kind == 3 else 256, (7, 9 * step)).astype(np.uint8)
    head = files._chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 7, depth, kind, 0, 0, woven))
    raw = zlib.compress(filtered(values, step, draw_))
    body = files._chunk(b"IDAT", raw[:20]) + files._chunk(b"IDAT", raw[20:]) + files._chunk(b"IEND", b"")
    return files.PNG_SIGNATURE + head + b"".join(chunks) + body, values.reshape(7, 9, step)


PALETTE = files._chunk(b"PLTE", bytes([10, 20, 30, 200, 100, 50]))


def test_plain_images_are_as_spark_decodes_them(spark, tmp_path, monkeypatch):
    made = {"rgba.png": shaped(6, 8, 1)[0], "rgb.png": shaped(2, 8, 2)[0], "said.png": shaped(6, 8, 3, files._chunk(b"tEXt", b"a\0b"))[0]}
    other = {"gray.png": shaped(0, 8, 4)[0], "pal.png": shaped(3, 8, 5, PALETTE)[0], "deep.png": shaped(6, 16, 6)[0]}
    for name, content in (made | other).items():
        (tmp_path / name).write_bytes(content)
    for content in made.values():
        assert files.plain_raster(content) is not None
        for bad in (content[:-1], content[:60], content[:28] + b"\1" + content[29:], content[:-20] + b"?" + content[-19:]):
            assert files.plain_raster(bad) is None
    for content in [*other.values(), shaped(6, 8, 7, files._chunk(b"gAMA", bytes(4)))[0], shaped(4, 8, 8)[0], b"", b"no image"]:
        assert len(content) < 29 or files.plain_raster(content) is None

    def rasters():
        return sorted((r["rel"], r["w"], r["h"], bytes(r["data"])) for r in files.read_rasters(spark, str(tmp_path)).collect())

    here = rasters()
    monkeypatch.setattr(files, "SMALL_RASTER", 0)
    assert here == rasters() and len(here) == 6


def test_the_driver_lists_no_folder(spark, tmp_path, monkeypatch):
    """Spark's file sources keep the status of each file on the driver: they are given lots of those images only
    that need their decoder, whatever the names."""
    root, want = tmp_path / "t", {}
    (root / "_h/d").mkdir(parents=True)
    for i in range(40):
        rel = f"{['', '_h/d/', '_h/'][i % 3]}{['p', '_p'][i % 2]}{i}.png"
        (root / rel).write_bytes(png(6, 2, 2, rgba(i, 2, 2)))
        want[rel] = rgba(i, 2, 2).tobytes()
    for i, name in enumerate(["a[1]", "b{x,y}", "c*", "d?", "e\\f", "g+h %41", "é", "_u", "_h/[v]", "_h/d/_w", "x"]):
        values = np.random.default_rng(i).integers(0, 256, (3, 2))
        (root / f"{name}.png").write_bytes(png(0, 2, 3, values))
        want[f"{name}.png"] = np.concatenate([np.repeat(values[..., None], 3, 2), np.full((3, 2, 1), 255)], 2).astype(np.uint8).tobytes()
    (root / "_h/p2.png.mcmeta").write_text('{"animation": {}}')
    (root / "n.mcmeta").write_text("{}")
    (root / "n.txt").write_text("n")
    (root / "void.txt").write_text("")
    given, source = [], files._image_source
    monkeypatch.setattr(files, "LOT_FILES", 3)
    monkeypatch.setattr(files, "_image_source", lambda spark, paths: given.append(paths) or source(spark, paths))
    listing = store.list_tree(spark, str(root))
    shown = files.reveal(spark, str(root), listing, str(tmp_path / "shown"))
    assert sorted(p.name for p in (tmp_path / "shown").rglob("*.png")) == ["v[v].png", "v_u.png", "v_w.png"]
    found = files.read_rasters(spark, str(root), shown, listing)
    assert {r["rel"]: bytes(r["data"]) for r in found.collect()} == want
    assert {r["path"] for r in found.collect()} == {f"{root}/{rel}" for rel in want}
    assert len(given) >= 3 and sum(map(len, given)) == 11 and not found.inputFiles()
    plain = {r["rel"]: bytes(r["data"]) for r in files.read_rasters(spark, str(root)).collect()}
    assert plain == {rel: data for rel, data in want.items() if "_" not in rel}
    others, sidecars = files.read_other_files(spark, str(root), shown), files.read_sidecars(spark, str(root), shown)
    assert sorted(r["rel"] for r in others.collect()) == ["_h/p2.png.mcmeta", "n.mcmeta", "n.txt"]
    assert sorted(r["rel"] for r in files.read_other_files(spark, str(root)).collect()) == ["n.mcmeta", "n.txt"]
    assert {(r["path"], r["has_anim"]) for r in sidecars.collect()} == {(f"{root}/_h/p2.png.mcmeta", True), (f"{root}/n.mcmeta", False)}
    assert not others.inputFiles() and not sidecars.inputFiles()


def test_sources_are_measured_with_what_they_take_beside_their_pixels(spark):
    sources = spark.range(100).selectExpr("CAST(id AS string) AS path", "2 AS w", "3 AS h")
    sizes = spark.createDataFrame([(0,), (4,)], "size int")
    assert compose._source_bytes(sources, sizes) == 100 * (24 + 2 * compose.SOURCE_BYTES + 4 * 4 * 4)
