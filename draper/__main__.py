"""``python -m draper``: queries over tables, and the jobs from raw folders to checked training sets.

Exit codes: 0 done, 1 a check has findings, 2 wrong arguments or inputs.
"""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="draper", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, told: str, *paths: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=told)
        for path in paths:
            c.add_argument(path)
        return c

    command("list", "names of the queries")
    run = command("run", "run a query over a folder of tables", "query")
    run.add_argument("--tables", required=True)
    run.add_argument("--out", help="write Parquet here; without it the first rows are shown")
    command("sql", "print a query's SQL", "query")
    command("inventory", "what lies in a folder of raw files", "folder")
    build = command("build", "labels, captions and masks of a raw folder to the table of outfits", "raw", "out")
    build.add_argument("--limit", type=int, help="the first ids only")
    command("splits", "deal the outfits into splits and write their manifest", "outfits", "out")
    check = command("preflight", "check photographs, masks, labels and targets of frozen splits", "raw", "outfits", "splits")
    check.add_argument("--split", action="append", help="train and val without it")
    check.add_argument("--json", help="write the report here")
    score = command("score", "rule scores of a table of garments", "garments", "out")
    score.add_argument("--rules", help="a configuration of the rules (YAML or JSON)")
    command("digest", "the Merkle digest of a folder's files", "folder")
    return p


def build(spark, args) -> int:
    from pyspark.sql import functions as F

    from draper.sources import folders, labels

    names = folders.files(spark, f"{args.raw}/parsing", "*.png").select(F.regexp_replace("name", r"\.png$", "").alias("image_id"))
    table = labels.outfit_table(folders.read_label_folder(spark, f"{args.raw}/labels"), labels.read_captions(spark, folders.find_caption_file(spark, args.raw)), names)
    print(json.dumps(labels.write_outfits(table, args.out, args.limit), sort_keys=True))
    return 0


def preflight(spark, args) -> int:
    from pyspark.sql import functions as F

    from draper.operators import preflight as op
    from draper.operators.preflight_files import check_folders
    from draper.sources import labels, records, splits, storage

    manifest = splits.verify_split_manifest(spark, args.splits)
    wanted = None
    for name in dict.fromkeys(args.split or ["train", "val"]):
        ids = splits.read_split(spark, args.splits, name).select(F.lit(name).alias("split"), "image_id")
        wanted = ids if wanted is None else wanted.unionByName(ids)
    found = check_folders(spark, wanted, labels.read_outfits(spark, args.outfits), f"{args.raw}/images", f"{args.raw}/parsing")
    at = storage.fresh_dir(spark, "preflight")
    found.write.parquet(at)  # checked once, reported several times
    found = spark.read.parquet(at)
    gaps = [r.asDict() for r in op.coverage_findings(op.target_counts(found)).collect()]
    report = {
        "manifest": manifest, "counts": [r.asDict() for r in op.error_counts(found).orderBy("split", "kind").collect()],
        "examples": [r.asDict() for r in op.error_examples(found).orderBy("split", "kind").collect()], "coverage": gaps,
    }
    storage.remove(spark, at)
    wrong = any(r["kind"] for r in report["counts"]) or any(g["severity"] == "error" for g in gaps)
    if args.json:
        records.write_json_atomic(args.json, report)
    print(f"preflight: {'FAIL' if wrong else 'PASS'}")
    for r in report["counts"]:
        print(f"{r['split']}: {r['built']} of {r['requested']} built" + (f", {r['errors']} {r['kind']}" if r["kind"] else ""))
    for g in gaps:
        print(f"{g['severity']}: val has {g['field']} value(s) absent from train: {g['found']}")
    return int(wrong)


def score(spark, args) -> int:
    from draper.functions.rulebook import DEFAULT, load_rules
    from draper.operators.rules import rule_score

    rule_score(spark.read.parquet(args.garments), book=load_rules(args.rules) if args.rules else DEFAULT).write.mode("error").parquet(args.out)
    return 0


def inventory(spark, args) -> int:
    from draper.sources import folders

    folders.inventory(spark, args.folder).orderBy("relpath").show(1000, False)
    return 0


def digest(spark, args) -> int:
    from draper.sources.digests import file_digests, folder_digest

    r = folder_digest(file_digests(spark, args.folder)).first()
    print(f"{r['sha256']}  {r['n_files']} files, {r['n_bytes']} bytes")
    return 0


def deal(spark, args) -> int:
    from draper.sources import labels, splits

    print(json.dumps(splits.write_splits(labels.read_outfits(spark, args.outfits), args.out)["counts"], sort_keys=True))
    return 0


def run(spark, args) -> int:
    from draper.plans import catalogue

    if args.query not in catalogue.QUERIES:
        raise ValueError(f"unknown query {args.query!r}")
    found = catalogue.QUERIES[args.query](spark, args.tables)
    if args.out:
        found.write.mode("error").parquet(args.out)
    else:
        found.show(20, False)
    return 0


JOBS = {"run": run, "inventory": inventory, "build": build, "splits": deal, "preflight": preflight, "score": score, "digest": digest}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command in ("list", "sql"):
        from draper.plans import catalogue

        print("\n".join(sorted(catalogue.QUERIES)) if args.command == "list" else catalogue.ORACLE.get(args.query, "no SQL"))
        return 0
    from pyspark.sql import SparkSession

    try:
        return JOBS[args.command](SparkSession.builder.appName("draper").getOrCreate(), args)
    except (OSError, ValueError) as x:
        print(f"draper {args.command}: {x}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
