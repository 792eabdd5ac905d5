import dataclasses
import datetime
import json

import pytest
from pyspark.sql import functions as F

from draper.functions import rulebook, settings
from draper.functions import vocab as V
from draper.operators import prompts, reports
from draper.operators.metrics import rank_auc
from draper.plans import stages
from draper.plans.registry import Registry
from draper.sources import folders, labels, records, splits
from draper.streaming.resume import LastWins, latest, pending


def test_labels(spark, tmp_path):
    p = tmp_path / "shape.txt"
    p.write_text("﻿img_0.jpg 3 2 1 1\t2 1 0 1 1 0 1 0\r\n\nimg_1.jpg 5 4 3 2 4 2 2 2 4 6 2 2\n")
    rows = {r["image_id"]: r for r in labels.read_labels(spark, str(p), V.SHAPE_CODES).collect()}
    r = rows["img_0"]
    assert (r["sleeve_length"], r["lower_length"], r["socks"], r["hat"], r["glasses"], r["neckwear"], r["wrist"], r["cardigan"], r["neckline"]) == (
        "long", "three_quarter", "socks", "yes", "sunglasses", "yes", "no", "no", "v_shape")
    assert set(rows["img_1"][c] for c in V.SHAPE_CODES) == {"na"}


@pytest.mark.parametrize("body", ["a.jpg 1 2\n", "a.jpg 0 1 x\n", "a.jpg 0 1 9\n", "a.jpg 0 -1 2\n", "a.jpg 0 1 2\na.jpg 0 1 2\n"])
def test_bad_labels(spark, tmp_path, body):
    p = tmp_path / "fabric.txt"
    p.write_text(body)
    with pytest.raises(Exception):
        labels.read_labels(spark, str(p), labels.FABRIC).collect()


def test_captions(spark, tmp_path):
    p = tmp_path / "captions.json"
    p.write_text(json.dumps({"a.jpg": "one", "b.jpg": ["two", "three"], "c.png": {"description": "four"}}))
    assert dict(map(tuple, labels.read_captions(spark, str(p)).collect())) == {"a": "one", "b": "two three", "c": "four"}


def test_captions_that_are_no_text(spark, tmp_path):
    for n, bad in enumerate(({"a": 3.5, "b": {"title": "x"}}, {"a": ["x", " "]}, {"a.jpg": "x", "a.png": "y"})):
        p = tmp_path / f"c{n}.json"
        p.write_text(json.dumps(bad))
        with pytest.raises(Exception, match="caption is not text|not unique"):
            labels.read_captions(spark, str(p)).collect()


ID = "WOMEN-Shirts-id_0000000{}-02_4_full"


def label_files(folder, n=3, shapes=(1,)):
    folder.mkdir(parents=True)
    (folder / "a_fabric_ann.txt").write_text("\ufeff\n" + "".join(f"{ID.format(i)}.jpg 0 1 7\n" for i in range(n)))
    (folder / "b_Colour_ann.txt").write_text("".join(f"{ID.format(i)}.jpg 0 1 7\n" for i in range(n)))
    (folder / "c_shape.txt").write_text("".join(f"{ID.format(i)}.jpg 0 0 0 0 0 0 0 0 0 0 0 0\n" for i in shapes))
    (folder / "notes.txt").write_text("nothing of use\n")


def test_label_folders_to_outfits(spark, tmp_path):
    label_files(tmp_path / "labels")
    assert {k: v.split("/")[-1] for k, v in folders.find_label_files(spark, str(tmp_path / "labels")).items()} == {"fabric": "a_fabric_ann.txt", "pattern": "b_Colour_ann.txt", "shape": "c_shape.txt"}
    table = folders.read_label_folder(spark, str(tmp_path / "labels"))
    rows = {r.image_id: r for r in table.collect()}
    assert len(rows) == 3 and rows[ID.format(0)].hat is None and rows[ID.format(1)].hat == "no" and rows[ID.format(2)].lower_fabric == "cotton"
    assert folders.missing_label_kinds(spark, str(tmp_path)) == []
    caps = spark.createDataFrame([(ID.format(0), "x")], ["image_id", "caption"])
    masks = spark.createDataFrame([(ID.format(0) + "_segm",)], ["image_id"])
    t = labels.outfit_table(table, caps, masks)
    assert len(t.columns) == 26 and labels.unmatched_names(table.unionByName(table.limit(1).withColumn("image_id", F.lit("bad")))).first()[0] == 1
    r = t.where(F.col("image_id") == ID.format(0)).first()
    assert (r["garment_id"], r["gender"], r["has_shape"], r["has_parsing"], r["is_full_body"], r["hat"]) == ("WOMEN-Shirts-id_00000000", "women", False, True, True, "na")
    out = str(tmp_path / "outfits")
    assert labels.write_outfits(t, out) == {"rows": 3, "captions": 1}
    assert labels.read_outfits(spark, out).count() == 3
    with pytest.raises(ValueError, match="no caption"):
        labels.write_outfits(t.withColumn("caption", F.lit("")), out)
    assert labels.read_outfits(spark, out).where("caption = 'x'").count() == 1 and sorted(p.name for p in tmp_path.iterdir()) == ["labels", "outfits"]


def test_label_folders_that_disagree(spark, tmp_path):
    with pytest.raises(ValueError, match="no shape, fabric, pattern"):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "x.txt").write_text("a b\n")
        folders.find_label_files(spark, str(tmp_path / "none"))
    label_files(tmp_path / "more", shapes=(1, 9))
    with pytest.raises(Exception, match="shape annotates an image without textures"):
        folders.read_label_folder(spark, str(tmp_path / "more")).collect()
    label_files(tmp_path / "less")
    (tmp_path / "less" / "b_Colour_ann.txt").write_text(f"{ID.format(0)}.jpg 0 1 7\n")
    with pytest.raises(Exception, match="do not cover the images exactly"):
        folders.read_label_folder(spark, str(tmp_path / "less")).collect()


def test_inventory(spark, tmp_path):
    raw = tmp_path / "raw"
    label_files(raw / "labels")
    (raw / "images").mkdir()
    (raw / "images" / "a.jpg").write_bytes(b"x" * 1500)
    (raw / "captions.json").write_text(json.dumps({"a": "one", "b": "two"}))
    assert folders.find_caption_file(spark, str(raw)).endswith("captions.json")
    seen = {r.relpath: r for r in folders.inventory(spark, str(raw)).collect()}
    assert (seen["images/"].sample, seen["images/"].shown, seen["captions.json"].entries, seen["labels/notes.txt"].lines) == ("1 files", "1.5 KB", 2, 1)
    have = lambda *ids: spark.createDataFrame([(i,) for i in ids], "image_id string")
    assert tuple(folders.input_report(have("a", "b", "c"), have("a", "b"), have("a")).first()) == (3, 1, 2, ["b", "c"])
    with pytest.raises(ValueError, match="first missing: b"):
        folders.require_inputs(have("a", "b"), have("a"), have("a", "b"))
    folders.require_inputs(have("a"), have("a"), have("a"))


def outfits(spark, groups=9, blank=None):
    rows = [(f"WOMEN-Shirts-id_{g:08d}-0{k}_full", "" if g == blank else "women", "Shirts", True) for g in range(groups) for k in range(1 + g % 3)]
    return spark.createDataFrame([*rows, ("odd", "women", "Shirts", True), ("MEN-X-id_99999999-1_back", "men", "X", False)], "image_id string, gender string, category_from_filename string, is_full_body boolean")


def test_splits_and_their_manifest(spark, tmp_path):
    folder = str(tmp_path / "splits")
    m = splits.write_splits(outfits(spark), folder)
    assert sum(m["counts"].values()) == 18 and m["n_groups"] == 9
    assert splits.verify_split_manifest(spark, folder)["group_disjoint"]
    assert splits.read_split(spark, folder, "test").count() == m["counts"]["test"]
    ids = splits.read_split(spark, folder, "train")
    assert splits.ids_digest(ids, "image_id").first() == splits.ids_digest(ids.repartition(5), "image_id").first()
    with pytest.raises(ValueError, match="unknown split"):
        splits.read_split(spark, folder, "dev")
    (tmp_path / "splits" / "val.txt" / "part-x.txt").write_text("WOMEN-Shirts-id_00000077-01_full\n")
    with pytest.raises(ValueError, match="manifest says"):
        splits.verify_split_manifest(spark, folder)
    with pytest.raises(ValueError, match="7 are needed"):
        splits.write_splits(outfits(spark, 4), str(tmp_path / "few"))
    with pytest.raises(Exception, match="no gender or category"):
        splits.write_splits(outfits(spark, blank=3), str(tmp_path / "blank"))
    torn = spark.createDataFrame([("a", "g", "s"), ("b", "g", "t")], "image_id string, group string, stratum string")
    with pytest.raises(Exception, match="spans strata"):
        splits.grouped_splits(torn).collect()


def test_predictions(spark, tmp_path):
    schema = "image_id string, caption string"
    df = spark.createDataFrame([("b", "x\u2028y"), ("a", "z"), ("c", None)], schema).repartition(3)
    path = str(tmp_path / "m_test.jsonl")
    m = records.write_predictions(df, path, "m", "test", {"k": 1}, df.select("image_id"))
    assert m["n_records"] == 3 and records.read_predictions(spark, path, schema).count() == 3
    sidecar = tmp_path / "m_test.manifest.json"
    for change in ({"n_records": 4}, {"sha256": "0"}, {"manifest_version": 2}, {"manifest_version": True}, {"predictions_file": "other.jsonl"}):
        sidecar.write_text(json.dumps(m | change))
        with pytest.raises(ValueError):
            records.read_predictions(spark, path, schema)
    assert m["inputs"] is None and set(m) == {"manifest_version", "model", "split", "n_records", "sha256", "predictions_file", "config_hash", "seed", "inputs", "git_sha", "schema_version"}
    sidecar.write_text(json.dumps(m))
    part = next(p for p in sorted((tmp_path / "m_test.jsonl").glob("part-*.json")) if p.stat().st_size)
    body = part.read_bytes()
    part.write_bytes(body.replace(b"z", b"Z", 1) if b"z" in body else body.replace(b"x", b"X", 1))
    (tmp_path / "m_test.jsonl" / f".{part.name}.crc").unlink()
    with pytest.raises(ValueError, match="sha256"):
        records.read_predictions(spark, path, schema)
    part.write_bytes(body)
    assert records.read_predictions(spark, path, schema).count() == 3
    bad = {"empty": df.limit(0), "twice": df.unionByName(df), "unnamed": spark.createDataFrame([("in_memory", "x")], schema), "short": df.where("image_id <> 'a'")}
    for name, rows in bad.items():
        with pytest.raises(ValueError):
            records.write_predictions(rows, str(tmp_path / f"{name}.jsonl"), "m", "test", expected=df.select("image_id"))
        assert not (tmp_path / f"{name}.jsonl").exists()
    for folder, split in ((str(tmp_path / "x.json"), "test"), (str(tmp_path / "x.jsonl"), "dev")):
        with pytest.raises(ValueError):
            records.write_predictions(df, folder, "m", split)


def test_predictions_out_of_order_and_rollback(spark, tmp_path, monkeypatch):
    schema = "image_id string, caption string"
    rows = tmp_path / "r.jsonl"
    rows.mkdir()
    (rows / "part-0.json").write_text('{"image_id":"b"}\n{"image_id":"c"}\n')
    (rows / "part-1.json").write_text('{"image_id":"c"}\n{"image_id":"a"}\n')
    assert records.out_of_order(records.read_jsonl(spark, str(rows), schema)) == 2
    records.write_json_atomic(str(tmp_path / "r.manifest.json"), records.prediction_manifest(spark, str(rows), "m", "test", {}, None))
    with pytest.raises(ValueError, match="strictly ascending"):
        records.read_predictions(spark, str(rows), schema)
    monkeypatch.setattr(records, "write_json_atomic", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        records.write_predictions(spark.createDataFrame([("a", "x")], schema), str(tmp_path / "n.jsonl"), "m", "test")
    assert not (tmp_path / "n.jsonl").exists()


def test_export_splits(spark, tmp_path):
    photos = spark.createDataFrame([("a",), ("b",), ("c",)], "image_id string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "image_id string")
    say = lambda df: df.withColumn("caption", F.lit("x"))
    got = records.export_splits(say, spark, "org/m", {"train": ids("a", "b"), "val": ids("c")}, photos, str(tmp_path), limit=1)
    assert {k: v["n_records"] for k, v in got.items()} == {"train": 1, "val": 1} and (tmp_path / "org_m_train.jsonl").exists()
    with pytest.raises(FileNotFoundError, match="no photograph of z"):
        records.export_splits(lambda df: 1 / 0, spark, "m", {"train": ids("a", "z")}, photos, str(tmp_path))


def test_cache_and_probes(spark, tmp_path):
    p = tmp_path / "cache.jsonl"
    p.write_text('{"image_id":"a","caption":"1"}\n\n{"image_id":"b","caption":"2"}\n{"image_id":"a","caption":"3"}\n{"image_id":"c","cap')
    assert {r.image_id: r.caption for r in records.read_cache(spark, str(p), "image_id string, caption string").collect()} == {"a": "3", "b": "2"}
    probes = tmp_path / "probes.jsonl"
    probes.write_text('{"probe_id":"p","text":"x","must_flag":false}\n')
    assert records.read_probes(spark, str(probes)).count() == 1
    probes.write_text("")
    with pytest.raises(ValueError, match="empty"):
        records.read_probes(spark, str(probes))


def test_metric_record(tmp_path):
    now = datetime.datetime.now(datetime.UTC)
    base = dict(stage="scoring", model="m", split="test", n_items=3, metrics={"a": records.undefined("too few")}, config={"c": 2}, stamp=now)
    r = records.metric_record(**base)
    assert len(r["config_hash"]) == 8 and r["timestamp"].endswith("Z") and r["metrics"]["a"]["value"] is None
    records.write_metric_record(r, str(tmp_path / "r.json"))
    assert records.read_json(str(tmp_path / "r.json"))["stage"] == "scoring"
    for change in ({"stage": "x"}, {"metrics": {}}, {"stamp": now.replace(tzinfo=None)}, {"model": " "}, {"n_items": 0}, {"provenance": ""}):
        with pytest.raises(ValueError):
            records.metric_record(**(base | change))
    with pytest.raises(ValueError):
        records.undefined(" ")
    with pytest.raises(ValueError):
        records.write_json_atomic(str(tmp_path / "n.json"), {"a": float("nan")})
    assert not (tmp_path / "n.json").exists()


CONFIG = {
    "color": {"achromatic_chroma": 5.0, "analogous_max": 30, "complementary_tolerance": 20, "triadic_tolerance": 20, "hue_separation": 30, "max_hue_families": 3},
    "formality": {"levels": {"t shirt": 1}, "max_spread": 2, "major_spread": 4}, "weights": dict.fromkeys(settings.AXES, 1.0), "penalties": {("formality_mismatch_per_level" if k == "formality_per_level" else k): v for k, v in V.PENALTY.items()},
    "harmony": {"min_lightness_contrast": 15.0, "monochrome_lightness_contrast": 8.0, "max_patterns": 1}, "defaults": {"base": 100.0, "unscorable": 50.0, "max_issue_refs": 5},
    "proportion": {"accessory_slots": V.ACCESSORIES, "dominant_slots": V.DOMINANT, "core_slots": V.CORE, "max_accessories": 3, "max_single_area": 0.6, "max_upper_lower_ratio": 3.0,
                   "min_measured_areas": 3, "min_garments_for_footwear": 2},
    "season": {"fabric_warmth": {"denim": 0.4}, "sleeve_exposure": {"long": -0.4}, "length_exposure": {"long": -0.4}, "heavy_warmth": 0.7, "summer_exposure": 0.6, "max_fabric_warmth_spread": 1.2},
    "palette": V.PALETTE,
}


def test_settings(tmp_path):
    book = rulebook.compile_rules(CONFIG)
    assert book.levels == {"t shirt": 1} and dataclasses.replace(book, **{k: getattr(rulebook.DEFAULT, k) for k in ("levels", "warmth", "sleeves", "lengths")}) == rulebook.DEFAULT
    assert settings.check(CONFIG, settings.PALETTE) is CONFIG
    bad = {
        "color.analogous_max": 181, "color.max_hue_families": True, "color.hue_separation": float("nan"), "formality.levels": {"T-Shirt": 1}, "formality.major_spread": 1,
        "season.fabric_warmth": {"na": 1.0}, "season.length_exposure": {}, "weights": dict.fromkeys(settings.AXES, 0.0), "penalties": {"hue_clash": 1.0},
        "harmony.max_patterns": 0, "proportion.accessory_slots": ["hat"], "proportion.core_slots": [], "proportion.max_single_area": 0, "proportion.max_upper_lower_ratio": 0.5,
        "defaults.base": 101, "defaults.max_issue_refs": 0, "defaults.unscorable": -1,
    }
    for path, value in bad.items():
        section, _, key = path.partition(".")
        changed = CONFIG | {section: (CONFIG[section] | {key: value} if key else value)}
        with pytest.raises(settings.ConfigError, match=section):
            settings.scoring_settings(changed)
    p = tmp_path / "c.yaml"
    p.write_text("a: {b: 1}\n")
    assert settings.option(settings.load_config(str(p)), "a.b") == 1
    (tmp_path / "d.yaml").write_text("- 1\n")
    (tmp_path / "e.yaml").write_text("a: [\n")
    for name in ("d.yaml", "e.yaml", "f.yaml"):
        with pytest.raises(settings.ConfigError):
            settings.load_config(str(tmp_path / name))


def test_stages_prompts_and_reports(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    p.write_text('{"image_id":"a","caption":"1"}\n{"image_id":"a","caption":"2"}\n')
    predict = stages.resolve(None, stages.PERCEPTION, "replay", spark, str(p), "image_id string, caption string")
    assert predict(spark.createDataFrame([("a",)], "image_id string")).first().caption == "2"
    with pytest.raises(Exception, match="no fixture for b"):
        predict(spark.createDataFrame([("b",)], "image_id string")).collect()
    row = ("a", "rules say", ["tip"], "gentle", "", "", [("upper_0", "red", "top", "na", "na")], [("season_mismatch", "major", "too warm", ["upper_0"])])
    made = spark.createDataFrame([row, ("b", *row[1:4], "", "a cap", row[6], [])], "image_id string, roast string, suggestions array<string>, tone string, safety_flags string, caption string, "
                                 "garments array<struct<ref:string,color:string,category:string,pattern:string,fabric:string>>, issues array<struct<code:string,severity:string,message:string,garment_refs:array<string>>>")
    told = {r.image_id: r.prompt for r in prompts.prompts(made, "P", "{tone}|{caption}|{garments}|{issues}").collect()}
    assert told["a"] == "P\n\ngentle|(no caption)|- upper_0: red top, pattern=na, fabric=na|- major / season_mismatch: too warm (garments: upper_0)" and told["b"].endswith("- No issues were reported.")
    with pytest.raises(KeyError):
        prompts.prompts(made, "P", "{nobody}")
    answers = [("a", json.dumps({"roast": "hosted", "suggestions": ["one"]})), ("b", json.dumps({"roast": "damn", "suggestions": ["one"]}))]
    got = {r.image_id: r for r in prompts.accept(made, spark.createDataFrame(answers, "image_id string, answer string")).collect()}
    assert (got["a"].roast, got["a"].source) == ("hosted", "hosted") and (got["b"].roast, got["b"].source, got["b"].safety_flags) == ("rules say", "rules", "safety:profanity")
    broken = [("a", "{"), ("b", json.dumps({"roast": "x" * 1001, "suggestions": ["one"]}))]
    assert {r.source for r in prompts.accept(made, spark.createDataFrame(broken, "image_id string, answer string")).collect()} == {"rules"}
    m = spark.createDataFrame([("b", 0.5, None), ("a", 0.25, 3)], "field string, accuracy double, n int")
    assert [r.line for r in reports.lines(m, "metrics", "field").collect()] == ["metrics field=a accuracy=0.250000 n=3", "metrics field=b accuracy=0.500000 n=undefined"]
    assert json.loads(reports.records(m, "roast", "m").first().record)["stage"] == "roast"
    c = spark.createDataFrame([("A Navy coat", "/r/x/y"), ("bored", "/d/raw/z"), (None, "/other"), ("redress", "x\\y")], "c string, p string")
    assert [r[0] for r in c.select(reports.mentions_color(F.col("c"))).collect()] == [True, False, False, False]
    assert [r[0] for r in c.select(reports.export_path(F.col("p"), "/r", "/d")).collect()] == ["x/y", "data/raw/z", "", "x/y"]


def test_command_line(capsys):
    from draper.__main__ import main

    assert main(["list"]) == 0 and "rule_score" in capsys.readouterr().out
    assert main(["sql", "top_longest"]) == 0 and "ORDER BY" in capsys.readouterr().out


@pytest.mark.parametrize("rows,auc", [([(1, 0.9), (0, 0.1)], 1.0), ([(1, 0.1), (0, 0.9)], 0.0), ([(1, 0.5), (0, 0.5)], 0.5), ([(1, 0.5)], None)])
def test_auc(spark, rows, auc):
    assert rank_auc(spark.createDataFrame(rows, "label int, score double")).first()[0] == auc


def test_registry():
    r = Registry()
    r.register("a", lambda: 1)
    assert r.create("a") == 1
    with pytest.raises(ValueError):
        r.register("a", lambda: 2)
    with pytest.raises(KeyError):
        r.create("b")


def test_resume(spark, tmp_path):
    log = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "n long, id string, v string")
    assert {(r["id"], r["v"]) for r in latest(log, "id", "n").collect()} == {("a", "y"), ("b", "z")}
    assert [r["id"] for r in pending(spark.createDataFrame([("a",), ("c",)], ["id"]), log, "id").collect()] == ["c"]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    log.write.parquet(src)
    for _ in range(2):  # a restart adds nothing
        stream = spark.readStream.schema(log.schema).parquet(src)
        store = LastWins(spark, out, log.schema, "id", "n")
        store.follow(stream, str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in store.read().collect()} == {(2, "a", "y"), (3, "b", "z")}
