"""The command lines from a raw folder to a checked training set, with their exit codes."""

import json

import numpy as np
from test_files import png

from draper.__main__ import main
from draper.plans import configured


def raw_folder(raw, n=12):
    for name in ("labels", "images", "parsing"):
        (raw / name).mkdir(parents=True)
    names = [f"WOMEN-Tees_Tanks-id_{i:08}-01_1_full" for i in range(n)]
    codes = {"shape": "3 3 0 0 0 0 0 0 0 2 1 0", "fabric": "1 0 7", "pattern": "2 3 7"}
    for kind, code in codes.items():
        (raw / "labels" / f"{kind}_ann.txt").write_text("".join(f"{x}.jpg {code}\n" for x in names))
    (raw / "captions.json").write_text(json.dumps({x: "a tee" for x in names}))
    red = np.zeros((8, 8, 3)) + [255, 0, 0]
    for x in names:
        (raw / "images" / f"{x}.png").write_bytes(png(red))
        (raw / "parsing" / f"{x}_segm.png").write_bytes(png(np.repeat([[1] * 8, [3] * 8], 4, axis=0)))
    return names


def test_from_raw_files_to_a_checked_set(spark, tmp_path, capsys):
    raw, outfits, splits, report = tmp_path / "raw", str(tmp_path / "outfits"), str(tmp_path / "splits"), tmp_path / "report.json"
    names = raw_folder(raw)
    assert main(["build", str(raw), outfits]) == 0 and json.loads(capsys.readouterr().out) == {"captions": 12, "rows": 12}
    assert main(["splits", outfits, splits]) == 0 and sum(json.loads(capsys.readouterr().out).values()) == 12
    asked = ["preflight", str(raw), outfits, splits, "--json", str(report)]
    assert main(asked) == 0 and capsys.readouterr().out.startswith("preflight: PASS")
    first = json.loads(report.read_text())["counts"]
    assert {r["split"] for r in first} == {"train", "val"} and all(r["kind"] is None and r["built"] == r["requested"] for r in first)
    for x in names:
        (raw / "images" / f"{x}.png").write_bytes(b"broken")
    assert main(asked) == 1
    said = capsys.readouterr().out
    assert said.startswith("preflight: FAIL") and "image_decode" in said
    assert {r["kind"] for r in json.loads(report.read_text())["counts"]} == {"image_decode"}
    assert main(["preflight", str(raw), outfits, splits, "--split", "dev"]) == 2 and "unknown split" in capsys.readouterr().err


def test_scores_under_other_rules_and_digests(spark, tmp_path, capsys):
    from pathlib import Path

    from test_rules import garments

    garments(spark, [{"pos": 0, "color": "red"}, {"pos": 1, "slot": "lower", "color": "cyan"}]).write.parquet(str(tmp_path / "g"))
    other = str(Path(configured.__file__).with_name("other_rules.json"))
    assert main(["score", str(tmp_path / "g"), str(tmp_path / "a")]) == 0 and main(["score", str(tmp_path / "g"), str(tmp_path / "b"), "--rules", other]) == 0
    own, changed = (spark.read.parquet(str(tmp_path / x)).first() for x in "ab")
    assert own.color_harmony == 100.0 and changed.color_harmony == 66.0
    (tmp_path / "bad.json").write_text("{}")
    assert main(["score", str(tmp_path / "g"), str(tmp_path / "c"), "--rules", str(tmp_path / "bad.json")]) == 2
    capsys.readouterr()
    assert main(["digest", str(tmp_path / "g")]) == 0 and len(capsys.readouterr().out.split()[0]) == 64
    assert main(["run", "nothing", "--tables", "x"]) == 2
