"""Catalogue sources, merges, derivation and run parameters on small inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ringloom.operators import derive
from ringloom.operators.assign import assign_entities
from ringloom.operators.catalog import texture_owners
from ringloom.operators.ring import prepare_ring
from ringloom.plans.assign import zip_faces
from ringloom.plans.publish import load_catalogue, load_rules
from ringloom.sources import catalog_json as cj
from ringloom.sources.files import sidecar_flags
from ringloom.sources.params import RunParameters, parse_parameters


def region(name, **more):
    return {"name": name, "x": 1, "y": 2, "width": 3, "height": 4, **more}


FILES = {
    "bed_head.json": {"bed_head": {"texture_size": [32, 16], "regions": [region("top", flip="v"), region("side", rotate="cw")], "textures": ["bed/red.png", "bed/blue.png"]}},
    "bed_foot.json": {"bed_foot": {"regions": [region("top")], "textures": ["bed/blue.png", "bed/green.png"]}},
    "cat.json": {"cat": {"regions": [region("head")], "textures": ["shared.png"]}},
    "Zoo.json": {"ape": {"texture_size": [128], "regions": [], "textures": ["shared.png", "ape.png"]}},
}


@pytest.fixture()
def folder(tmp_path):
    for name, body in FILES.items():
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "readme.txt").write_text("not a catalogue")
    return str(tmp_path)


def test_catalogue_sizes_and_merge(spark, folder):
    catalogue = load_catalogue(spark, folder)
    sizes = {r["entity_id"]: (r["tex_w"], r["tex_h"]) for r in catalogue.entities.collect()}
    assert sizes == {"bed": (32, 16), "cat": (64, 64), "ape": (128, 64)}
    bed = catalogue.regions.filter("entity_id = 'bed'").orderBy("ord").collect()
    assert [(r["name"], r["flip"], r["rotate"]) for r in bed] == [("head_top", "v", None), ("head_side", None, "cw"), ("foot_top", None, None)]
    textures = catalogue.textures.filter("entity_id = 'bed'").orderBy("ord").collect()
    assert [r["texture"] for r in textures] == ["bed/red.png", "bed/blue.png", "bed/green.png"]
    # File names are compared without case, so Zoo.json claims after cat.json.
    owners = {r["texture"]: r["entity_id"] for r in texture_owners(catalogue).collect()}
    assert owners == {"bed/red.png": "bed", "bed/blue.png": "bed", "bed/green.png": "bed", "shared.png": "ape", "ape.png": "ape"}


def test_malformed_catalogue_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"cat": {"regions": [')
    with pytest.raises(Exception, match="MALFORMED|malformed|parse"):
        cj.read_catalogue(spark, str(tmp_path)).regions.collect()


def test_write_skip_overwrite_and_read_back(spark, folder, tmp_path):
    catalogue = cj.read_catalogue(spark, folder)
    out = str(tmp_path / "written")
    cj.write_catalogue(catalogue, out)
    assert sorted(r["entity_id"] for r in cj.existing_entities(spark, out).collect()) == ["ape", "bed_foot", "bed_head", "cat"]
    back = cj.read_written_catalogue(spark, out)
    columns = ["entity_id", "ord", "name", "x", "y", "width", "height", "flip", "rotate"]
    assert sorted(map(tuple, back.regions.select(*columns).collect()), key=str) == sorted(map(tuple, catalogue.regions.select(*columns).collect()), key=str)
    assert cj.write_catalogue(catalogue, out).count() == 0
    assert cj.read_written_catalogue(spark, out).entities.count() == 4
    cj.write_catalogue(catalogue, out, overwrite=True)
    assert cj.read_written_catalogue(spark, out).entities.count() == 4
    document = json.loads(cj.entity_documents(catalogue).filter("entity_id = 'bed_head'").first()["value"])
    assert document == FILES["bed_head.json"]


def test_same_shared_gives_one_overlay_per_entity(spark, folder):
    sources = spark.createDataFrame([(f"s{i}", f"s{i}") for i in range(50)], "source string, rel string")
    catalogue = load_catalogue(spark, folder)
    faces = assign_entities(catalogue, prepare_ring(sources, 1), 1)
    assert faces.groupBy("entity_id").agg(F.count_distinct("overlay").alias("n")).filter("n > 1").isEmpty()
    with pytest.raises(ValueError, match="Invalid face_mode"):
        assign_entities(catalogue, prepare_ring(sources, 1), 1, "both")
    with pytest.raises(ValueError, match="Invalid texture_mode"):
        assign_entities(catalogue, prepare_ring(sources, 1), 1, "same", "none")


@pytest.mark.parametrize("text,animated", [('{"animation":{}}', True), ('{"animation":{"frametime":3}}', True), ('{"animation":null}', True), ('{"other":1}', False), ("[1]", False), ("{oops", False), ("", False)])
def test_sidecars(spark, text, animated):
    assert sidecar_flags(spark.createDataFrame([("p", text)], "path string, value string")).first()["has_anim"] is animated


def test_rules_and_parameters(spark):
    rules = {r["key"]: r for r in load_rules(spark, '{"a":{"scale":2,"keep-aspect":true,"odd":1},"b":{"overlay-scale":0.5,"fast-overlay-size":9}}').collect()}
    assert (rules["a"]["scale"], rules["a"]["keep_aspect"], rules["a"]["alpha"]) == (2, True, None)
    assert (rules["b"]["overlay_scale"], rules["b"]["fast_overlay_size"]) == (0.5, 9)
    assert load_rules(spark, "").count() == 0
    stored = spark.createDataFrame([('{"target_dir":"old","seed":12,"alpha":1}',)], "value string")
    row = parse_parameters(stored).first()
    assert (row["texture_dir"], row["seed"], row["alpha"], row["fast_overlay_size"], row["overlay_dir"]) == ("old", 12, 1.0, 0, "dataset/")
    assert 0 <= RunParameters().with_random_seed().seed < 2**32 - 1
    assert RunParameters().fast_overlay_size == 512


def test_zip_faces_stops_at_the_shorter_list(spark):
    nested = spark.createDataFrame([("t", ["r0", "r1", "r2"], ["a", "b"])], "target string, regions array<string>, overlays array<string>")
    assert [tuple(r) for r in zip_faces(nested).orderBy("region_ord").collect()] == [("t", 0, "r0", "a"), ("t", 1, "r1", "b")]


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_carry_forward_is_independent_of_the_segment_width(spark, width):
    rows = [(g, i, (i if i % 7 == g else None)) for g in (0, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, i int, u int")
    got = derive.carry_forward(df, ["g"], "i", ["u"], {"u": -1}, F.floor(F.col("i") / width)).collect()
    last, want = {}, {}
    for g, i, u in rows:
        last[g] = u if u is not None else last.get(g, -1)
        want[(g, i)] = last[g]
    assert {(r["g"], r["i"]): r["u"] for r in got} == want


def test_parent_chains(spark):
    chain = [(f"block/n{i}", f"minecraft:block/n{i + 1}", False) for i in range(40)] + [("n40", "block/block", True)]
    odd = [("loop1", "loop2", False), ("loop2", "loop3", False), ("loop3", "loop1", False), ("tail", "loop1", False), ("lost", "missing", False), ("top", "block/block", False), ("bare", None, False)]
    owners = {r["name"]: r["owner"] for r in derive.elements_owner(spark.createDataFrame(chain + odd, "name string, parent string, has_elements boolean")).collect()}
    assert all(owners[f"n{i}"] == "n40" for i in range(41))
    assert all(owners[n] is None for n, _, _ in odd)


def test_texture_tiers(spark):
    files = ["root/cow/b.png", "root/cow/a.PNG", "root/cow/cold_x.png", "root/cow/deep/c.png", "root/pig_a.png", "root/pig_b.png.mcmeta", "root/cow/cold_cow.png", "root/chest/x_left.png", "root/chest/x.png"]
    entities = [("cow", "cow", None), ("pig", "pig", None), ("cold_cow", "none", "cow"), ("chest_left", "chest", None), ("chest", "chest", None)]
    got = derive.choose_textures(
        spark.createDataFrame([(f,) for f in files], "path string"),
        spark.createDataFrame(entities, "entity_id string, folder string, fallback_folder string"),
        spark.createDataFrame([("cow", "cold_")], "entity_id string, prefix string"),
        spark.createDataFrame([("chest_left", "suffix", "_left.png", True), ("chest", "suffix", "_left.png", False)], "entity_id string, kind string, text string, wanted boolean"),
        "root",
    ).collect()
    found = sorted((r["entity_id"], r["texture"]) for r in got)
    assert found == [
        ("chest", "root/chest/x.png"), ("chest_left", "root/chest/x_left.png"), ("cold_cow", "root/cow/cold_cow.png"),
        ("cow", "root/cow/a.PNG"), ("cow", "root/cow/b.png"), ("cow", "root/cow/deep/c.png"), ("pig", "root/pig_a.png"),
    ]


def test_block_models_from_files(spark, tmp_path):
    models = {
        "template_a": {"parent": "block/block", "elements": [{"faces": {"up": {"uv": [0, 0, 6, 7]}, "down": {"uv": [6, 7, 0, 0]}, "thin": {"uv": [0, 0, 0.4, 5]}, "none": {}}}]},
        "child": {"parent": "minecraft:block/template_a", "textures": {"all": "minecraft:block/lamp", "bare": "block/still"}},
        "broken": None,
    }
    for name, body in models.items():
        (tmp_path / f"{name}.json").write_text("{" if body is None else json.dumps(body))
    read = cj.read_models(spark, str(tmp_path))
    assert sorted(r["name"] for r in read.collect()) == ["child", "template_a"]
    templates = spark.createDataFrame([("lamp", 0, "block/child"), ("lamp", 1, "template_a"), ("one", 0, "template_a")], "entity_id string, template_ord int, template string")
    found = derive.regions_of_models(templates, read, derive.elements_owner(read)).orderBy("name").collect()
    assert [(r["name"], r["x"], r["width"], r["height"], r["flip"]) for r in found] == [
        ("elem0_down", 0, 6, 7, "hv"), ("elem0_up", 0, 6, 7, None), ("t0_elem0_down", 0, 6, 7, "hv"), ("t0_elem0_up", 0, 6, 7, None),
    ]
    files = spark.createDataFrame([(p,) for p in ("tex/lamp.png", "tex/lamp.png.mcmeta", "tex/still.png")], "path string")
    used = derive.animated_model_textures(read, spark.createDataFrame([("template_a",)], "template string"), files, "tex")
    assert [r["texture"] for r in used.collect()] == ["tex/lamp.png"]


def test_a_written_catalogue_is_read_and_rewritten_by_entity(spark, tmp_path):
    from ringloom.sources.catalog_json import parse_catalogue, read_catalogue, write_catalogue

    def one(entity, side):
        value = json.dumps({entity: {"texture_size": [side, side], "textures": [f"{entity}.png"], "regions": [{"name": "r", "x": 1, "y": 1, "width": 2, "height": 2}]}})
        return parse_catalogue(spark.createDataFrame([(f"{entity}.json", value)], "file string, value string"))

    folder = str(tmp_path / "cat")
    for entity, side in (("a b+c", 16), ("b", 32), ("b", 64)):
        write_catalogue(one(entity, side), folder, overwrite=True)
    got = read_catalogue(spark, folder)
    assert {(r["entity_id"], r["tex_w"]) for r in got.entities.collect()} == {("a b+c", 16), ("b", 64)}
    assert got.regions.count() == 2 and got.textures.count() == 2


def test_merging_replaces_an_entity_of_the_merged_name(spark):
    from ringloom.operators.catalog import merge_halves
    from ringloom.sources.catalog_json import parse_catalogue

    region = {"name": "r", "x": 1, "y": 1, "width": 2, "height": 2}
    value = json.dumps({e: {"textures": [f"{e}.png"], "regions": [region]} for e in ("bed", "bed_head", "bed_foot")})
    rules = spark.createDataFrame([("bed", "bed_head", "bed_foot", "head_", "foot_")], "merged string, first string, second string, first_prefix string, second_prefix string")
    got = merge_halves(parse_catalogue(spark.createDataFrame([("x.json", value)], "file string, value string")), rules)
    assert [r["entity_id"] for r in got.entities.collect()] == ["bed"]
    assert sorted(r["name"] for r in got.regions.collect()) == ["foot_r", "head_r"]
    assert sorted(r["texture"] for r in got.textures.collect()) == ["bed_foot.png", "bed_head.png"]


def test_mirroring_joins_only_the_names_that_rules_ask_for(spark):
    shape = ("*", "0 AS x", "0 AS y", "2 AS width", "2 AS height", "CAST(NULL AS STRING) AS flip", "CAST(NULL AS STRING) AS rotate")
    rows = [("e", 0, "arm_top"), ("e", 1, "arm_left"), ("e", 2, "leg_left"), ("f", 0, "arm_top"), ("f", 1, "done"), (None, 0, "arm_top")]
    regions = spark.createDataFrame(rows, "entity_id string, ord long, name string").selectExpr(*shape)
    rules = [(e, old, "new_", True, unless) for e in ("e", "f", None) for old, unless in (("arm_", "done"), ("leg_", None))]
    rules = spark.createDataFrame(rules, "entity_id string, old string, new string, mirror boolean, unless string")
    entities = spark.createDataFrame([("e", 10), ("f", 10)], "entity_id string, tex_w int")
    made = derive.mirror_parts(regions, rules, entities)
    assert sorted(r["name"] for r in made.collect() if r["name"].startswith("new_")) == ["new_left", "new_top"]
    joined = made._jdf.queryExecution().analyzed().toString()
    assert joined.count("Join LeftSemi") == 3  # the rules, and both times the names


def test_ordinals_that_do_not_fit_are_an_error(spark):
    from ringloom.operators.derive import faces_of_cuboids

    def faces(ord_):
        row = ("e", ord_, "p", 0, 0, 0, 2, 2, 2)
        schema = "entity_id string, ord long, part string, idx int, u int, v int, sx int, sy int, sz int"
        return faces_of_cuboids(spark.createDataFrame([row], schema)).collect()

    assert faces(700_000_000)
    with pytest.raises(Exception, match="too large"):
        faces(800_000_000)
