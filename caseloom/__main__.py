"""Command line: list-adapters, init, build, verify, stats, tokenize, prepare, calibrate, evaluate."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

_EXAMPLE = {"id": "r1", "group": "g1", "type": "noul", "state": {"text": "患者口干。"}, "instruction": "是否提到口干？", "criteria": {"false": "没有", "true": "有"}, "label": "true"}


def _session(name: str):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _setting(text: str) -> tuple[str, object]:
    name, found, value = text.partition("=")
    if not found:
        raise SystemExit(f"--set {text}: NAME=VALUE is needed")
    try:
        return name, json.loads(value)
    except json.JSONDecodeError:
        return name, value


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="caseloom", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list-adapters")
    verbs.add_parser("init").add_argument("folder")
    build = verbs.add_parser("build")
    build.add_argument("config")
    build.add_argument("output")
    build.add_argument("--plugin", action="append", default=[], help="trusted Python file with a dictionary ADAPTERS")
    verbs.add_parser("verify").add_argument("folder")
    stats = verbs.add_parser("stats")
    stats.add_argument("folder")
    stats.add_argument("--head", type=int, default=192)
    tokenize = verbs.add_parser("tokenize")
    tokenize.add_argument("folder")
    tokenize.add_argument("output")
    tokenize.add_argument("--head", type=int, default=192)
    tokenize.add_argument("--tokenizer", help="vocabulary file of a public library; one token a character without it")
    tokenize.add_argument("--special", nargs=4, metavar=("CLS", "SEP", "MASK", "PAD"), default=["[CLS]", "[SEP]", "[MASK]", "[PAD]"])
    evaluate = verbs.add_parser("evaluate")
    evaluate.add_argument("predictions", help="Parquet table with split, qtype, logits and target")
    evaluate.add_argument("--calibrate-on", default="calibration", help="split that the temperatures are fitted on")
    evaluate.add_argument("--calibration", help="file of a calibrate run, whose temperatures are taken")
    prepare = verbs.add_parser("prepare")
    prepare.add_argument("config", help="settings of a run in JSON")
    prepare.add_argument("output")
    prepare.add_argument("--set", action="append", default=[], dest="changes", metavar="NAME=VALUE", help="a setting in place of the file's; the value is JSON, or else a text")
    calibrate = verbs.add_parser("calibrate")
    calibrate.add_argument("predictions")
    calibrate.add_argument("output", help="file for the temperatures")
    calibrate.add_argument("--on", default="calibration")
    calibrate.add_argument("--most", type=int, default=2_000)
    chosen = parser.parse_args(args)
    if chosen.verb == "list-adapters":
        from .sources.adapters import Registry

        print("\n".join(Registry().names()))
    elif chosen.verb == "init":
        folder = Path(chosen.folder)
        folder.mkdir(parents=True, exist_ok=False)
        (folder / "raw.jsonl").write_text(json.dumps(_EXAMPLE, ensure_ascii=False) + "\n", encoding="utf-8")
        source = {"name": "example", "adapter": "project_jsonl", "paths": ["raw.jsonl"], "split": "train", "url": "local:example", "revision": "v1", "license": "own", "source_family": "example", "task_family": "example", "domain": "example"}
        (folder / "config.json").write_text(json.dumps({"format_version": 1, "seed": 0, "test_fraction": 0.1, "sources": [source]}, ensure_ascii=False, indent=2), encoding="utf-8")
    elif chosen.verb == "build":
        import runpy

        from .plans.build import build_release
        from .sources.adapters import Registry

        registry = Registry()
        for path in chosen.plugin:
            registry.load(runpy.run_path(path))
        config = Path(chosen.config)
        manifest = build_release(_session("caseloom build"), json.loads(config.read_text(encoding="utf-8")), str(config.parent.resolve()), str(Path(chosen.output).resolve()), registry)
        print(json.dumps(manifest["counts"], ensure_ascii=False, indent=2))
    elif chosen.verb == "verify":
        from .plans.build import verify_release

        print(json.dumps(verify_release(_session("caseloom verify"), chosen.folder), ensure_ascii=False, indent=2))
    elif chosen.verb == "tokenize":
        from .operators.compiling import character_tokens, library_tokens
        from .plans.build import read_cases
        from .plans.prepare import write_items

        spark = _session("caseloom tokenize")
        tok = library_tokens(chosen.tokenizer, *chosen.special) if chosen.tokenizer else character_tokens()
        write_items(read_cases(spark, chosen.folder), tok, chosen.head, chosen.output)
    elif chosen.verb == "prepare":
        from .plans.prepare import prepare as run_prepare

        config = json.loads(Path(chosen.config).read_text(encoding="utf-8")) | dict(_setting(x) for x in chosen.changes)
        print(json.dumps(run_prepare(_session("caseloom prepare"), config, str(Path(chosen.output).resolve())), ensure_ascii=False, indent=2))
    elif chosen.verb == "calibrate":
        from .plans.prepare import calibration

        found = calibration(_session("caseloom calibrate").read.parquet(chosen.predictions), chosen.on, chosen.most)
        Path(chosen.output).write_text(json.dumps(found, ensure_ascii=False, indent=2), encoding="utf-8")
    elif chosen.verb == "evaluate":
        from .plans.prepare import evaluation_report

        known = json.loads(Path(chosen.calibration).read_text(encoding="utf-8"))["temperatures"] if chosen.calibration else None
        print(json.dumps(evaluation_report(_session("caseloom evaluate").read.parquet(chosen.predictions), chosen.calibrate_on, known), ensure_ascii=False, indent=2))
    else:
        from .plans.prepare import length_report

        print(json.dumps(length_report(_session("caseloom stats"), chosen.folder, chosen.head), ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
