"""From configured sources to a verified release."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cases as C
from ..operators import merge as M
from ..operators.validation import REQUIRED_META, case_reason, gold_reason, question_reason
from ..sources import readers
from ..sources.adapters import Registry
from .config import check_build
from .shared import Scratch

_META = ("source_family", "task_family", "domain", "revision", "license")


def convert_sources(spark: SparkSession, config: Mapping, base: str, registry: Registry | None = None) -> DataFrame:
    """All sources' decision rows in one relation, with ``arrival``, the source's fields and ``reason``.

    One large source is as parallel as many small ones, since files split. Arrival is the place of the source in the
    configuration, then of the row: its file by name, its record there, its place in the record. It depends on neither
    partitions nor the order in which files are listed. Rows of an adapter that tells no ``place`` arrive in the order of
    a digest of their content; rows of equal content are interchangeable."""
    registry, parts = registry or Registry(), []
    for number, source in enumerate(config["sources"]):
        at = lambda p: f"{base}/{p}"
        paths = source["paths"]
        paths = {k: at(v) for k, v in paths.items()} if isinstance(paths, Mapping) else [at(p) for p in ([paths] if isinstance(paths, str) else paths)]
        if source.get("auxiliary_paths"):
            paths = (paths if isinstance(paths, Mapping) else {"paths": paths}) | {k: at(v) for k, v in source["auxiliary_paths"].items()}
        told = {"original_split": source["original_split"]} if "original_split" in source else {}
        rows = registry.convert(spark, source["adapter"], paths, told | dict(source.get("params") or {}))
        fixed = {k: F.lit(source.get(k)).cast("string") for k in _META}
        rows = rows.drop("source", "raw_no", "arrival", *_META).withColumns(
            fixed
            | {
                "source": F.lit(source["name"]), "source_url": F.lit(source["url"]), "source_split": F.lit(source["split"]), "original_split": F.lit(source.get("original_split", source["split"])),
                "arrival": F.struct(F.lit(number).alias("source_no"), *(["place.file", "place.line", "place.at"] if "place" in rows.columns else [F.lit("").alias("file"), F.lit(0).cast("long").alias("line"), F.array().cast("array<int>").alias("at")]), X.digest(X.json_list(*[F.coalesce(F.col(c), F.lit("")) for c in ("source_id", "state", "questions", "gold", "group_key")])).alias("content"), F.monotonically_increasing_id().alias("tie")),
            }
        )
        if "review" not in rows.columns:
            rows = rows.withColumn("review", F.lit(None).cast("string"))
        parts.append(rows.drop("place"))
    return reduce(DataFrame.unionByName, parts)


def validated(rows: DataFrame) -> DataFrame:
    """Decision rows with the first reason that the adapter, the case, the question or the gold gives, or that there is
    no group: the merge would lose such a row and its copies."""
    exploded = C.explode_decisions(rows.withColumnRenamed("qtype", "_declared").where("reason is null"))
    seen = exploded.withColumn("reason", F.coalesce(case_reason(), question_reason(), gold_reason(), F.when(~X.non_blank(F.col("group_key")), "no group"))).withColumn("label_key", M.label_key(F.col("option_keys"), F.col("gold_probs")))
    keep = [*rows.columns, "label_key"]
    lost = rows.where("reason is not null").withColumn("label_key", F.lit(None).cast("string"))
    # A row whose questions can't be read unfolds to nothing; it comes back with its case's reason.
    unread = rows.where("reason is null").where("from_json(questions, 'map<string,string>') is null or size(from_json(questions, 'map<string,string>')) = 0")
    unread = unread.withColumns({"reason": F.coalesce(case_reason(), F.lit("questions can't be read")), "label_key": F.lit(None).cast("string")})
    return seen.drop("_declared").select(*keep).unionByName(lost.select(*keep)).unionByName(unread.select(*keep))


def build_release(spark: SparkSession, config: Mapping, base: str, output: str, registry: Registry | None = None) -> dict:
    """Builds a release folder and returns its manifest. An existing folder is refused; the manifest is written last
    and marks the release as whole."""
    check_build(config)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(output)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(fs_path):
        raise FileExistsError(output)
    scratch = Scratch(spark, "build")
    rows = validated(convert_sources(spark, config, base, registry))
    rows = scratch.keep(
        rows.withColumns({
            "id": F.concat(F.col("source"), F.lit(":"), C.case_digest(F.col("source_id"), F.col("state"), F.get_json_object("questions", "$.decision"))),
            "input_key": C.input_key(F.col("state"), F.col("questions")), "gold_key": X.digest(F.col("gold")),
            "grp": F.col("group_key"), "split": F.col("source_split"),
        }), "converted")
    good, bad, asked = rows.where("reason is null"), rows.where("reason is not null and review is null"), rows.where("review is not null")
    if not good.limit(1).count():
        raise ValueError("no valid cases")
    merged = scratch.keep(M.merge_cases(good, scratch, config.get("seed", 0), *[float(config.get(f"{s}_fraction", 0)) for s in ("calibration", "validation", "test")]), "merged")
    kept = merged.where("fate = 'kept'")
    staging = f"{output}.staging"
    packed = "gzip" if config.get("compression") == "gzip" else "none"
    lines = case_lines(kept)
    for split in M.SPLITS:
        part = lines.where(F.col("split") == split).orderBy("input_key").select("value")
        part.write.option("compression", packed).text(f"{staging}/{split}")
    if config.get("write_notebooks"):
        notebook = kept.select("split", F.to_json(F.struct("id", "state", "questions", "gold")).alias("value"))
        notebook.write.partitionBy("split").option("compression", packed).text(f"{staging}/notebooks")
    bad.select(F.to_json(F.struct("source", "source_id", "reason")).alias("value")).write.text(f"{staging}/rejected")
    asked.select(F.to_json(F.struct("source", "source_id", "source_split", "group_key", F.from_json("review", "map<string,string>").alias("review"))).alias("value")).write.text(f"{staging}/review")
    counters = {r.key: r.n for r in M.named_counters(merged, good, bad).orderBy("key").collect()}  # sources x kinds x labels
    counters |= {f"review:{r.source}": r.n for r in asked.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    units = M.unit_counts(good.select("source", F.lit("converted").alias("stage"), "split", "original_id", "grp")).unionByName(
        M.unit_counts(kept.select("source", F.lit("output").alias("stage"), "split", "original_id", "grp"))
    )
    listed = [at for s in config["sources"] for at in ([s["paths"]] if isinstance(s["paths"], str) else s["paths"].values() if isinstance(s["paths"], Mapping) else s["paths"])]
    listed += [at for s in config["sources"] for at in (s.get("auxiliary_paths") or {}).values()]
    inputs = readers.file_inventory(spark, [f"{base}/{p}" for p in dict.fromkeys(listed)]).collect()
    manifest = {
        "format_version": 1,
        "files": _split_files(spark, staging),
        "config": dict(config),
        "inputs": sorted(({"file": r.path.rsplit("/", 1)[-1], "bytes": r.bytes, "sha256": r.sha256} for r in inputs), key=lambda x: x["file"]),
        "counts": counters,
        "split_policy": "components of linked groups by hash; the highest official split of a component wins, lower rows are left out",
        "dedup_policy": "equal state and ordered questions are one input; inputs with different gold are left out",
        "source_units": [r.asDict() for r in units.orderBy("source", "stage", "split").collect()],
        "adapter_sha256": {"adapters": hashlib.sha256(Path(__file__).parents[1].joinpath("sources/adapters.py").read_bytes()).hexdigest()},
    }
    _write_json(spark, f"{staging}/manifest.json", manifest)
    if not fs.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging), fs_path):
        raise OSError(f"{output} can't be made")
    scratch.close()
    return manifest


def case_lines(kept: DataFrame) -> DataFrame:
    """``(split, input_key, value)``: each kept case as a line of JSON with its provenance; the group key becomes the
    component, the earlier key stays beside it."""
    meta = F.struct(
        "source", "source_id", "original_id", "original_split", "source_split", F.col("component").alias("group_key"), F.col("group_key").alias("source_group_key"), "source_url",
        *_META, "supervision", "split",
    )
    tail = F.to_json(meta)
    value = F.concat(F.lit('{"id":'), X.json_quote(F.col("id")), F.lit(',"state":'), F.col("state"), F.lit(',"questions":'), F.col("questions"), F.lit(',"gold":'), F.col("gold"), F.lit(',"_meta":'), tail, F.lit("}"))
    return kept.select("split", "input_key", value.alias("value"))


def read_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of a release with the split of their file."""
    parts = []
    for split in M.SPLITS:
        lines = spark.read.text(f"{folder}/{split}")
        parsed = F.from_json("value", "id string, state string, questions string, gold string, _meta map<string,string>")
        parts.append(lines.select(F.lit(split).alias("file_split"), parsed.alias("c"), "value").select("file_split", "c.*"))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("state", F.when(F.ltrim("state").rlike(r"^[\[{]"), F.col("state")).otherwise(X.json_quote(F.col("state"))))


def release_problems(cases: DataFrame) -> DataFrame:
    """``(problem, n)`` of a release's cases; no rows for a sound one.

    Checks every case's rules and single decision, its provenance, its file, unique ids, groups within one split,
    unique inputs and one gold for each. All are aggregates that combine before their shuffle."""
    decisions = C.explode_decisions(cases)
    rules = decisions.select(F.coalesce(case_reason(), question_reason(), gold_reason()).alias("problem")).where("problem is not null")
    several = cases.where(F.size(F.json_object_keys("questions")) != 1).select(F.lit("not one decision").alias("problem"))
    missing = cases.select(F.explode(F.array_compact(F.array(*[F.when(~X.non_blank(F.element_at("_meta", F.lit(k))), F.lit(f"missing {k}")) for k in REQUIRED_META]))).alias("problem"))
    moved = cases.where(~F.element_at("_meta", F.lit("split")).eqNullSafe(F.col("file_split"))).select(F.lit("split differs from its file").alias("problem"))
    one = F.count(F.lit(1))
    ids = cases.groupBy("id").agg(one.alias("n")).where("n > 1").select(F.lit("repeated id").alias("problem"))
    by_group = cases.groupBy(F.element_at("_meta", F.lit("group_key")).alias("g")).agg(F.min("file_split").alias("a"), F.max("file_split").alias("b"))
    leaks = by_group.where("a <> b").select(F.lit("group leakage").alias("problem"))
    key = C.input_key(F.col("state"), F.col("questions"))
    by_input = cases.groupBy(key.alias("k")).agg(one.alias("n"), F.min("gold").alias("a"), F.max("gold").alias("b"))
    copies = by_input.where("n > 1").select(F.when(F.col("a") != F.col("b"), "conflicting gold").otherwise("repeated input").alias("problem"))
    found = reduce(DataFrame.unionByName, [rules, several, missing, moved, ids, leaks, copies])
    return found.groupBy("problem").agg(one.alias("n"))


def _split_files(spark: SparkSession, folder: str) -> list[dict]:
    """Case files of a folder with their sizes and digests, in order."""
    files = readers.file_inventory(spark, [f"{folder}/{s}/part-*" for s in M.SPLITS]).collect()
    return sorted(({"file": "/".join(r.path.rsplit("/", 2)[1:]), "bytes": r.bytes, "sha256": r.sha256} for r in files), key=lambda x: x["file"])


def _write_json(spark: SparkSession, path: str, value: Mapping) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    stream.close()


def release_counts(cases: DataFrame) -> dict[str, int]:
    """Cases by split, and in each by kind, source family and task family, in one pass over grouping sets."""
    table = C.explode_decisions(cases).select("file_split", "qtype", F.element_at("_meta", F.lit("source_family")).alias("source"), F.element_at("_meta", F.lit("task_family")).alias("task"))
    names = {"split": [], "type": ["qtype"], "source": ["source"], "task": ["task"]}
    sets = [[F.col("file_split"), *[F.col(c) for c in more]] for more in names.values()]
    rows = table.groupingSets(sets, "file_split", "qtype", "source", "task").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n")).collect()
    kinds = {7: "split", 3: "type", 5: "source", 6: "task"}  # bits of qtype, source and task that are summed over
    return dict(sorted((":".join([kinds[r.g], *[x for x in (r.file_split, r.qtype, r.source, r.task) if x is not None]]), r.n) for r in rows))


def verify_release(spark: SparkSession, folder: str, write_report: bool = True) -> dict:
    """Reads a release again and returns its report, which is also written beside it; raises where it isn't sound, or
    where a file isn't the one that its manifest names."""
    cases = read_cases(spark, folder)
    problems = {r.problem: r.n for r in release_problems(cases).collect()}
    if problems:
        raise ValueError("; ".join(f"{k}: {v}" for k, v in sorted(problems.items())))
    files = _split_files(spark, folder)
    manifest = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])
    told, there = ({f["file"]: f["sha256"] for f in x} for x in (manifest["files"], files))
    changed = sorted(k for k in told.keys() | there.keys() if told.get(k) != there.get(k))
    if changed:
        raise ValueError(f"files that aren't those of the manifest: {', '.join(changed[:5])}")
    totals = cases.agg(F.count_distinct("id").alias("ids"), F.count_distinct(F.element_at("_meta", F.lit("group_key"))).alias("groups")).first()
    report = {"format_version": 1, "status": "verified", "counts": release_counts(cases), "unique_ids": totals.ids, "unique_groups": totals.groups, "files": files}
    if write_report:
        _write_json(spark, f"{folder}/verification.json", report)
    return report
