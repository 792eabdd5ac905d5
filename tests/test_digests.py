"""Merkle digests of files and folders against a plain script; changes that have to show."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from draper.sources import digests


def H(x):
    return hashlib.sha256(x).digest()


def script(folder, block):
    """What a reader without Spark would run."""
    def root(level):
        while len(level) > 1:
            level = [H(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    groups = defaultdict(list)
    for p in folder.rglob("*"):
        if p.is_file() and p.name[0] not in "_." and p.stat().st_size:
            body, name = p.read_bytes(), str(p.relative_to(folder)).encode()
            leaf = H(b"\0" + name + b"\0" + root([H(b"\0" + body[i : i + block]) for i in range(0, len(body), block)]))
            key = hashlib.sha256(name).hexdigest()
            groups[key[:3]].append((key, leaf))
    return root([root([leaf for _, leaf in sorted(groups[g])]) for g in sorted(groups)]).hex()


def of(spark, folder, block=64):
    return digests.folder_digest(digests.file_digests(spark, str(folder), block)).first()


def test_a_plain_script_gives_the_same_and_changes_show(spark, tmp_path):
    rng = random.Random(5)
    folder = tmp_path / "deep" / "folder"
    (folder / "sub").mkdir(parents=True)
    for i, n in enumerate([0, 1, 63, 64, 65, 128, 129, 700, 5000]):
        (folder / ("sub" if i % 3 == 0 else ".") / f"part-{i}.json").write_bytes(rng.randbytes(n))
    lines = [f"line {i}\n".encode() for i in range(40)]
    (folder / "lines.jsonl").write_bytes(b"".join(lines))
    (folder / "_SUCCESS").write_bytes(b"")
    (folder / ".hidden").write_bytes(b"x")
    whole = of(spark, folder)
    assert (whole["n_files"], whole["sha256"]) == (9, script(folder, 64)) and whole["n_bytes"] == 6150 + sum(map(len, lines))
    seen = {whole["sha256"]}
    (folder / "lines.jsonl").write_bytes(b"".join([*lines[:3], lines[4], lines[3], *lines[5:]]))  # two lines swapped
    seen.add(of(spark, folder)["sha256"])
    body = bytearray(b"".join(lines))
    body[-2] ^= 1
    (folder / "lines.jsonl").write_bytes(body)  # one bit
    seen.add(of(spark, folder)["sha256"])
    (folder / "lines.jsonl").write_bytes(b"".join(lines))
    assert of(spark, folder)["sha256"] == whole["sha256"]
    (folder / "part-1.json").rename(folder / "part-1b.json")
    seen.add(of(spark, folder)["sha256"])
    (folder / "part-1b.json").unlink()  # a lost part
    lost = of(spark, folder)
    seen.add(lost["sha256"])
    assert len(seen) == 5 and lost["sha256"] == script(folder, 64)


def test_trees_of_every_small_size(spark):
    rows = [(n, [H(bytes([i])) for i in range(n)]) for n in range(1, 34)]
    df = spark.createDataFrame(rows, "n int, leaves array<binary>")
    for r in df.select("n", "leaves", digests.tree_root(F.col("leaves")).alias("root")).collect():
        assert bytes(r["root"]) == digests.plain_root([bytes(x) for x in r["leaves"]])
    assert spark.sql("SELECT cast(null as binary) AS c").select(digests.content_root(F.col("c")).alias("d")).first()["d"] is None
