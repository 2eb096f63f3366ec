"""From a release to a table of items: tokens, lengths, recommendations."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cases as C
from ..operators import compiling as T
from ..operators import lengths as L
from ..operators import scoring as S
from .build import _write_json, read_cases
from .config import check_run, reusable_cache
from .shared import Scratch


def decision_table(cases: DataFrame) -> DataFrame:
    """Decision rows with targets and ``state_text``, the state as a layout reads it: a text as it is, structure as
    JSON."""
    text = F.when(F.col("state").startswith('"'), F.get(F.from_json(F.concat(F.lit("["), F.col("state"), F.lit("]")), "array<string>"), F.lit(0))).otherwise(F.col("state"))
    return C.compiled_targets(C.explode_decisions(cases.withColumn("state_text", text)))


def write_items(cases: DataFrame, tok: T.Tokens, head_cap: int, folder: str) -> None:
    """Items by split, one row each, arrays at their own length, and skipped rows with their reasons beside them."""
    rows = T.lenient_prompts(decision_table(cases), tok, head_cap)
    good = rows.where("reason is null").withColumns({"prompt_len": F.size("prompt"), "state_len": F.size("state_ids"), "n_options": F.size("target")})
    keep = ["id", "question_id", "kind_no", "label", "n_options", "target", "prompt", "markers", "state_ids", "prompt_len", "state_len", "state_cut", "file_split"]
    good.select(*keep).write.partitionBy("file_split").parquet(f"{folder}/items")
    rows.where("reason is not null").select("id", "question_id", "reason").write.parquet(f"{folder}/skipped")


def read_items(spark: SparkSession, folder: str, cap: int, whole_state: bool = True) -> DataFrame:
    """Items that fit the cap; the filter on two numbers reaches the Parquet scan before any array is read."""
    rows = spark.read.parquet(f"{folder}/items")
    fits = L.keeps_whole(F.col("prompt_len"), F.col("state_len"), cap) if whole_state else L.keeps_prompt(F.col("prompt_len"), cap)
    return rows.where(fits)


def length_report(spark: SparkSession, folder: str, head_cap: int, tok: T.Tokens | None = None) -> dict:
    """Lengths of a release's items: percentiles, histogram, retention, recommended cap."""
    rows = T.lenient_prompts(decision_table(read_cases(spark, folder)), tok or T.character_tokens(), head_cap).where("reason is null")
    sized = rows.select((F.size("prompt") + F.size("state_ids") + 1).alias("length"))
    length = F.col("length")
    return {
        "summary": L.length_summary(sized, length).first().asDict(),
        "histogram": {str(r.bin): r.n for r in L.length_histogram(sized, length).collect()},
        "retention": {str(r.cap): r.share for r in L.retention(sized, length).collect()},
        "recommended_cap": L.recommended_cap(sized, length).first().cap,
    }


def dataset_descriptor(spark: SparkSession, items: str, config: dict, fingerprint: str) -> dict:
    """What a training run needs to know of an item table: rows by split, kind and number of options, longest parts,
    the tokenizer. Settings that the configuration leaves null are filled with measured values."""
    table = spark.read.parquet(f"{items}/items")
    one = F.count(F.lit(1)).alias("n")
    kinds = {f"{r.file_split}:{r.kind_no}:{r.n_options}": r.n for r in table.groupBy("file_split", "kind_no", "n_options").agg(one).collect()}  # splits x kinds x options
    longest = table.agg(F.max("prompt_len").alias("prompt"), F.max("state_len").alias("state")).first()
    length = F.col("prompt_len") + F.col("state_len") + 1
    measured = {"head_max_len": longest.prompt, "max_len": L.recommended_cap(table, length).first().cap}
    filled = {k: measured.get(k) if v is None else v for k, v in config.items()}
    return {"items": kinds, "longest_prompt": longest.prompt, "longest_state": longest.state, "tokenizer": fingerprint, "config": filled}


def prepare(spark: SparkSession, config: dict, output: str, tok: T.Tokens | None = None, fingerprint: str = "characters") -> dict:
    """Items of a run's releases with their manifest and descriptor; an output that was prepared with equal settings is
    used again, another one is refused.

    ``config`` is a run's (:func:`check_run`): ``dataset`` names folders of releases under ``releases``, and parameters
    of theirs. ``head_max_len`` counts for the prompts."""
    check_run(config)
    if config.get("dataset") is None:
        raise ValueError("a run is prepared from dataset; dataset_info names one that is")
    head = config.get("head_max_len") or 192
    manifest = {"head_max_len": config.get("head_max_len"), "adapter_params": dict(config["dataset"]), "tokenizer": fingerprint}
    scratch = Scratch(spark, "prepare", output)
    if scratch.has("manifest.json"):
        known = json.loads(spark.read.text(f"{output}/manifest.json", wholetext=True).first()[0])
        if known.get("tokenizer") != fingerprint or not reusable_cache(known, {"head_max_len": config.get("head_max_len"), "adapter_params": config["dataset"]}):
            raise FileExistsError(f"{output} was prepared with other settings")
        return json.loads(spark.read.text(f"{output}/dataset.json", wholetext=True).first()[0])
    releases = config["dataset"]["releases"]
    cases = reduce(DataFrame.unionByName, [read_cases(spark, r) for r in ([releases] if isinstance(releases, str) else releases)])
    write_items(cases, tok or T.character_tokens(), head, output)
    descriptor = dataset_descriptor(spark, output, {"head_max_len": config.get("head_max_len"), "max_len": config.get("max_len")}, fingerprint)
    _write_json(spark, f"{output}/dataset.json", descriptor)
    _write_json(spark, f"{output}/manifest.json", manifest)  # last: the output is whole
    return descriptor


def calibration(predictions: DataFrame, calibrate_on: str = "calibration", most: int = 2_000) -> dict:
    """Temperatures fitted on at most ``most`` predictions of a split, those with the smallest hashes, with how many of
    each kind there were."""
    chosen = predictions.where(F.col("split") == calibrate_on).orderBy(F.xxhash64("qtype", "logits", "target")).limit(most)
    counts = {r.qtype: r.n for r in chosen.groupBy("qtype").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"split": calibrate_on, "items": counts, "temperatures": S.fit_temperatures(chosen)}


def evaluation_report(predictions: DataFrame, calibrate_on: str = "calibration", temperatures: dict[str, float] | None = None) -> dict:
    """Temperatures given, or fitted on one split's predictions ``(split, qtype, logits, target)``, and what they give on
    the others: items, accuracy, mean log score and confidence, calibration error, by split and kind."""
    temperatures = temperatures or S.fit_temperatures(predictions.where(F.col("split") == calibrate_on))
    scored = S.with_temperatures(predictions.where(F.col("split") != calibrate_on), temperatures)
    errors = {(r.split, r.qtype): r.ece for by in ((), ("qtype",)) for r in _with_kind(S.calibration_error(scored, "split", *by)).collect()}
    out: dict = {"temperatures": temperatures, "splits": {}}
    for r in S.evaluation(scored, "split").orderBy("split", "qtype").collect():  # splits x kinds
        entry = {k: r[k] for k in ("items", "accuracy", "mean_log_score", "mean_confidence")} | {"ece": errors[r.split, r.qtype]}
        own = out["splits"].setdefault(r.split, {"by_type": {}})
        if r.qtype is None:
            own |= entry
        else:
            own["by_type"][r.qtype] = entry
    return out


def _with_kind(errors: DataFrame) -> DataFrame:
    return errors if "qtype" in errors.columns else errors.withColumn("qtype", F.lit(None).cast("string"))


def tokenizer_fingerprint(vocabulary: dict[str, int], special: dict[str, int]) -> str:
    """SHA-256 over the sorted vocabulary and the special ids: equal tokenizers, equal fingerprints."""
    return hashlib.sha256(json.dumps([sorted(vocabulary.items()), sorted(special.items())], ensure_ascii=False).encode()).hexdigest()
