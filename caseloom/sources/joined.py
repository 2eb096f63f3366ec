"""Adapters that need more than one record at a time: candidates of a question, lookup tables, gold files, templates,
published partitions, sessions that continue each other, second modes.

Each prepares records by DataFrame operators and hands them to a shape. ``paths`` is the main files, or a mapping with
them under ``paths`` and auxiliary files by name."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import batches, joins, sequences
from . import adapters as A
from . import readers

# Words of a closed vocabulary that a source must come with.
VOCABULARIES = {"cblue_ctc": 44, "tcm_sd": 148, "dialmed_recorded": 70, "tnews": 15, "cail2019_elements": 20}
# The published partition of a corpus of dialogues, shuffled with this seed.
REMEDI_PARTS, REMEDI_SEED = {"train": 657, "dev": 100, "test": 800}, 5
#: Records of one question that come as candidates.
CANDIDATES = 5


def main_files(paths):
    return paths["paths"] if isinstance(paths, Mapping) else paths


def _auxiliary(paths, adapter: str, *names: str) -> list:
    missing = [n for n in names if not isinstance(paths, Mapping) or n not in paths]
    if missing:
        raise ValueError(f"{adapter} needs the auxiliary files {', '.join(missing)}")
    return [paths[n] for n in names]


def _mode(params: Mapping, allowed: tuple[str, ...], name: str = "mode") -> str:
    found = str(params.get(name, allowed[0]))
    if found not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return found


def _stop(found: DataFrame, what: str) -> None:
    A._none(found, what)


def convert_webmedqa(spark: SparkSession, paths, params) -> DataFrame:
    """Five answers to a question, one of them right: a choice among them (``mode`` choice), or a decision for each
    (noul). Their order is that of a digest that no label shows. ``link_shared_answers`` links questions by all answers,
    the right one or none. A line of other than five fields stops the build: its question can't be told."""
    mode, linked = _mode(params, ("choice", "noul")), _mode(params, ("all", "positive", "none"), "link_shared_answers")
    lines = readers.numbered_tsv(spark, main_files(paths), "department string, label string, qid string, query string, answer string")
    _stop(lines.where("reason is not null").select("file", "line", "reason"), "lines that can't be told")
    rows = lines.select("file", "line", "row.*")
    told = rows.groupBy("file", "qid").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n"))
    fives = rows.drop("line").join(told.where(F.col("n") == CANDIDATES), ["file", "qid"])  # so that no list grows with a question
    candidate = F.struct(X.digest(X.json_list(F.coalesce("query", F.lit("")), F.coalesce("answer", F.lit("")))).alias("place"), "answer", "label")
    grouped = fives.groupBy("file", "qid").agg(
        F.min("line").alias("line"), F.min("department").alias("department"), F.min("query").alias("query"), F.array_sort(F.collect_list(candidate)).alias("candidates"),
        (F.count_distinct("department", "query") != 1).alias("torn"),
    )
    others = told.where(F.col("n") != CANDIDATES)
    row = lambda c: F.struct("qid", *c)
    records = grouped.select("file", "line", row(["department", "query", "candidates", "torn"]).alias("row"), F.lit(None).cast("string").alias("spoilt"))
    empty = [F.lit(None).cast(grouped.schema[c].dataType).alias(c) for c in ("department", "query", "candidates", "torn")]
    records = records.unionByName(others.select("file", "line", row(empty).alias("row"), F.lit(f"not {CANDIDATES} candidates").alias("spoilt")))
    rules = (
        ("trim(coalesce(qid, '')) = '' or trim(coalesce(department, '')) = '' or trim(coalesce(query, '')) = ''", "no question or department"), ("torn", "candidates of different questions"),
        ("exists(candidates, c -> c.label is null or c.label not in ('0', '1'))", "unknown label"), ("size(filter(candidates, c -> c.label = '1')) <> 1", "not one right answer"),
        ("size(array_distinct(transform(candidates, c -> trim(coalesce(c.answer, ''))))) < size(candidates)", "repeated candidates"),
    )
    links = {"all": "concat(array(query), transform(candidates, c -> c.answer))", "positive": "array(query, filter(candidates, c -> c.label = '1')[0].answer)", "none": "array(query)"}[linked]
    right = "array_position(transform(candidates, c -> c.label), '1') - 1"
    if mode == "choice":
        state = "concat('问题：', query, '\\n\\n候选回答：\\n', array_join(transform(candidates, (c, i) -> concat(char(65 + i), '：', c.answer)), '\\n\\n'))"
        shape = A.Shape("tsv", "", "choice", state, "'{prompt}'", right, "transform(candidates, (c, i) -> concat('回答 ', char(65 + i)))", group=("medical_text", "query"), links=links, rules=rules, part="qid", defaults={"prompt": "选择与问题匹配的原始回答。"})
    else:
        shape = A.Shape("tsv", "", "noul", "concat('问题：', query, '\\n回答：', c.answer)", "'{prompt}'", "c.label = '1'", "array('原数据中不匹配', '原数据中匹配')", group=("medical_text", "query"), links=links, rules=rules, part="qid", unfold=(("if(torn is null, array(null), candidates)", "candidate_no", "c"),), defaults={"prompt": "该回答是否与问题匹配？"})
    return A.decision_rows(records, shape, _wording(params))


def convert_cmedqa2(spark: SparkSession, paths, params) -> DataFrame:
    """Candidates of questions whose texts stand in tables of their own: ``questions`` and ``answers``. A file of training
    triples gives one right and one wrong answer a line; equal pairs are one, and a pair with two labels is told of. The
    build stops at a question that comes again after another, and at repeated keys of the tables."""
    questions, answers = (readers.numbered_csv(spark, p).select("row.*") for p in _auxiliary(paths, "cmedqa2_matching", "questions", "answers"))
    questions, answers = questions.select("question_id", F.col("content").alias("question")), answers.select("ans_id", F.col("content").alias("answer"))
    _stop(joins.repeated_keys(questions, "question_id"), "repeated questions")
    _stop(joins.repeated_keys(answers, "ans_id"), "repeated answers")
    parts = []
    for path in readers._list(main_files(paths)):
        rows = readers.numbered_csv(spark, path).select("file", "line", "row.*")
        if {"pos_ans_id", "neg_ans_id"} <= set(rows.columns):
            pairs = F.explode(F.expr("array(named_struct('ans_id', pos_ans_id, 'label', '1'), named_struct('ans_id', neg_ans_id, 'label', '0'))"))
            rows = rows.select("file", "line", "question_id", pairs.alias("p")).select("file", "line", "question_id", "p.*")
        elif not {"ans_id", "label"} <= set(rows.columns):
            raise ValueError(f"{path} names no candidates")
        parts.append(rows.select("file", "line", "question_id", "ans_id", "label"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    _stop(sequences.broken_runs(rows, "question_id", "file", ["line"]), "questions that come again after another")
    pairs = rows.groupBy("file", "question_id", "ans_id").agg(F.min("line").alias("line"), F.min("label").alias("label"), (F.min("label") != F.max("label")).alias("torn"))
    asked = joins.lookup_or_reason(pairs, questions, "question_id", "question", "question is missing").withColumnRenamed("reason", "unknown")
    found = joins.lookup_or_reason(asked, answers, "ans_id", "answer", "answer is missing")
    reason = F.coalesce("unknown", F.when(F.col("torn"), "candidate of two labels"), "reason")
    records = found.select("file", "line", F.struct("question_id", "ans_id", "label", "question", "answer").alias("row"), reason.alias("spoilt"))
    shape = A.Shape(
        "csv", "", "noul", "concat('问题：', question, '\\n候选回答：', answer)", "'{prompt}'", "case label when '1' then true when '0' then false end", "array('原数据中的不匹配候选', '原数据中的匹配回答')",
        group=("medical_text", "question"), links="array(question)", part="concat_ws(':', question_id, ans_id)", defaults={"prompt": "根据原问答匹配任务，该候选回答是否与问题匹配？"},
    )
    return A.decision_rows(records, shape, _wording(params))


def convert_cdn_pairs(spark: SparkSession, paths, params) -> DataFrame:
    """Retrieved standard terms of diagnoses, each label held against the original gold file ``original_gold``. Labels of
    a hidden test split are no labels, so such a split stops the build."""
    if str(params.get("original_split", "")).lower() in ("test", "official_test"):
        raise ValueError("labels of the hidden test split are placeholders")
    (gold_path,) = _auxiliary(paths, "cdn_retrieved_pairs", "original_gold")
    gold = readers.read_json_records(spark, gold_path, "text string, normalized_result string").where("reason is null").select(F.trim("row.text").alias("text_a"), F.col("row.normalized_result").alias("result"))
    lines = readers.numbered_tsv(spark, main_files(paths), "text_a string, text_b string, label string")
    _stop(lines.where("line = 1 and not (row.text_a <=> 'text_a' and row.text_b <=> 'text_b' and row.label <=> 'label')").select("file"), "files without the columns text_a, text_b, label")
    rows = lines.where("line > 1").select("file", "line", "row.*", F.col("reason").alias("broken"))
    rows = rows.withColumn("told", F.col("label").try_cast("int"))
    agreed = joins.membership_agrees(rows, gold, "text_a", "text_b", "told")
    known = agreed.join(gold.select("text_a").distinct().withColumn("known", F.lit(True)), "text_a", "left")
    reason = F.coalesce("broken", F.when(F.col("known").isNull() | ~F.coalesce(F.col("label").isin("0", "1"), F.lit(False)), "no gold diagnosis or label").when(~F.col("agrees"), "label contradicts the gold"))
    records = known.select("file", "line", F.struct("text_a", "text_b", "label").alias("row"), reason.alias("spoilt"))
    shape = replace(A.SHAPES["cdn_retrieved_pairs"], supervision="source_gold_verified_retrieved_candidates")
    return A.decision_rows(records, shape, _wording(params))


def template_texts(spark: SparkSession, path: str, task: str) -> list[str]:
    """Prompt templates of a task: a JSON dictionary of lists. Written line breaks are line breaks; what only asks for the
    answer at the end is no part."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])  # a few templates
    out = []
    for template in found[task]:
        template = template.replace("\\\\n", "\n").replace("\\n", "\n").strip()
        out.append(template.removesuffix("\n答：").strip())
    return out


def _unprompted(task: str, shape: str) -> Callable[..., DataFrame]:
    def convert(spark: SparkSession, paths, params) -> DataFrame:
        """Documents taken out of the prompts of the author's ``templates`` before they are read as their shape."""
        (templates,) = _auxiliary(paths, shape, "templates")
        found = A._read(spark, A.SHAPES[shape], main_files(paths), "utf-8")
        document = F.trim(readers.template_capture(F.trim("row.input"), template_texts(spark, templates, task)))
        spoilt = F.coalesce("spoilt", F.when(F.col("row.task_dataset") != task, "another task"), F.when(~X.non_blank(document), "no template fits the prompt"))
        return A.decision_rows(found.select("file", "line", F.col("row").withField("input", document).alias("row"), spoilt.alias("spoilt")), A.SHAPES[shape], _wording(params))

    return convert


def convert_psy_insight(spark: SparkSession, paths, params) -> DataFrame:
    """Strategies of the supporter's turns and emotions of the seeker's. A session that continues the one before it links
    to that one's group; sessions that can't be read are no predecessors."""
    schema = "dialog_id string, is_same_session int, is_same_qa int, dialog array<struct<speaker string, content string, strategy array<string>, `emotional label` array<string>>>"
    rows = readers.read_json_array(spark, main_files(paths), schema).select("file", "line", "row.*")
    good = F.expr("size(dialog) > 0 and forall(dialog, t -> trim(coalesce(t.speaker, '')) <> '' and trim(coalesce(t.content, '')) <> '')")
    rows = rows.withColumns({"dialog_id": F.coalesce("dialog_id", F.lit("unknown")), "continues": F.expr("coalesce(is_same_session = 1, false) or coalesce(is_same_qa = 1, false)")})
    rows = sequences.last_good_before(rows, "file", ["line"], F.coalesce(good, F.lit(False)), "dialog_id", "before")
    spoilt = F.when(~F.coalesce(good, F.lit(False)), "no dialogue").when(F.col("continues") & F.col("before").isNull(), "continues nothing")
    dialog = F.expr("transform(dialog, t -> named_struct('speaker', t.speaker, 'content', t.content, 'told', case t.speaker when 'Supporter' then t.strategy when 'Seeker' then t.`emotional label` end))")
    records = rows.select("file", "line", F.struct("dialog_id", F.when(F.col("continues"), F.col("before")).alias("before"), dialog.alias("dialog")).alias("row"), spoilt.alias("spoilt"))
    shape = A.Shape(
        "array", "", "noul", "turns", "concat(if(turn.speaker = 'Seeker', '{emotion_prompt}', '{prompt}'), word)", "array_contains(turn.told, word)", group=("dialogue", "dialog_id"), links="array(before, whole)",
        unfold=(("dialog", "turn_no", "turn"), ("if(turn.speaker = 'Seeker', {emotions}, {labels})", "label_no", "word")), supervision="source_model_assisted_annotation",
        derive=(("turns", "array_join(transform(slice(dialog, 1, turn_no + 1), t -> concat(t.speaker, '：', t.content)), '\\n')"), ("whole", "array_join(transform(dialog, t -> concat(t.speaker, '：', t.content)), '\\n')")),
        rules=(("turn.speaker not in ('Supporter', 'Seeker')", "unknown speaker"), ("turn.told is null", "unlabelled turn"), ("size(array_except(turn.told, if(turn.speaker = 'Seeker', {emotions}, {labels}))) > 0", "label outside the vocabulary")),
        defaults={"prompt": "最后一句用了这个策略吗：", "emotion_prompt": "最后一句有这种情绪吗（不是诊断）："},
    )
    return A.decision_rows(records, shape, _wording(params))


def convert_squad(spark: SparkSession, paths, params) -> DataFrame:
    """Questions about a context: rows for people to review (``mode`` review), or whether the context answers them
    (answerability). Answers that don't stand at their place spoil a question."""
    shape, mode = A.SHAPES["squad"], _mode(params, ("review", "answerability"))
    records = A._read(spark, shape, main_files(paths), "utf-8")
    if mode == "answerability":
        return A.decision_rows(records, shape, _wording(params))
    away = "exists(answers, a -> a.answer_start < 0 or substring(context, a.answer_start + 1, length(a.text)) <> a.text)"
    rows = A.decision_rows(records, replace(shape, answer="true", rules=((f"coalesce({away}, true)", "answer isn't at its place"),)), _wording(params))
    asked = records.select(A._base().alias("original_id"), F.to_json(F.struct("row.context", "row.question", F.col("row.answers").alias("reference_answers"), F.lit("needs_candidates_and_reviewed_labels").alias("status"))).alias("review"))
    found = rows.join(asked, "original_id")
    return found.withColumns({"review": F.when(F.col("reason").isNull(), F.col("review")), "reason": F.coalesce("reason", F.lit("needs review"))})


def convert_imcs21(spark: SparkSession, paths, params) -> DataFrame:
    """The act of every turn, and the state of every symptom that a turn mentions. Names and states of a turn's symptoms
    must be as many, and one symptom has one state."""
    act = A.SHAPES["imcs21_clinical"]
    schema = "dialogue array<struct<speaker string, sentence string, dialogue_act string, symptom_norm array<string>, symptom_type array<string>>>"
    records = A._read(spark, replace(act, schema=schema), main_files(paths), "utf-8")
    pairs = "array_distinct(transform(turn.symptom_norm, (s, i) -> named_struct('name', s, 'state', turn.symptom_type[i])))"
    none = "array(named_struct('name', cast(null as string), 'state', cast(null as string)))"
    symptoms = replace(
        act, ask="concat('{symptom_prompt}', s.name)", answer="try_cast(s.state as int)", options="{states}",
        unfold=(*act.unfold, (f"if(turn.symptom_norm is null or turn.symptom_type is null or size(turn.symptom_norm) <> size(turn.symptom_type), {none}, {pairs})", "symptom_no", "s")), part="'symptom'",
        rules=(("s.name is null or trim(s.name) = ''", "names and states of symptoms differ"), ("s.state is null or not s.state rlike '^[0-9]+$' or try_cast(s.state as int) >= size({states})", "unknown state"),
               (f"size(filter({pairs}, x -> x.name = s.name)) > 1", "symptom of two states")),
        defaults=dict(act.defaults) | {"symptom_prompt": "根据最后一句及此前语境，这个症状被表述为何种状态：", "states": ["没有", "有", "不确定"]},
    )
    return A.decision_rows(records, replace(act, part="'act'"), _wording(params)).unionByName(A.decision_rows(records, symptoms, _wording(params)))


def convert_remedi(spark: SparkSession, paths, params) -> DataFrame:
    """The split of a corpus that was published as a seeded shuffle of all its records; another number of records than
    was published stops the build."""
    split, shape = str(params.get("original_split")), A.SHAPES["remedi_human"]
    parts = dict(params.get("partition_sizes") or REMEDI_PARTS)
    if split not in parts:
        raise ValueError(f"original_split must be one of {', '.join(parts)}")
    records = A._read(spark, shape, main_files(paths), "utf-8")
    counts = records.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != sum(parts.values()))
    _stop(counts, f"files of other than {sum(parts.values())} records")
    wanted = [n + 1 for n, s in batches.published_partition(parts, REMEDI_SEED).items() if s == split]  # as many as were published
    return A.decision_rows(records.where(F.col("line").isin(wanted)), shape, _wording(params))


def convert_cail2018(spark: SparkSession, paths, params) -> DataFrame:
    """Accusations or articles (``task``) of a fact: a decision for each of the vocabulary (``mode`` noul), or a choice
    where a fact has one (single_choice)."""
    shape, mode, task = A.SHAPES["cail2018"], _mode(params, ("noul", "single_choice")), _mode(params, ("accusation", "articles"), "task")
    if task == "articles" and any(not (str(w).isascii() and str(w).isdecimal()) for w in params.get("labels", [])):
        raise ValueError("articles are decimal numbers")
    if mode == "single_choice":
        shape = replace(shape, kind="choice", unfold=(), ask="'{prompt}'", answer="array_position({labels}, {task}[0]) - 1", options="{labels}", part="", rules=(*shape.rules, ("size({task}) <> 1", "several labels")))
    rows = A._read(spark, shape, main_files(paths), "utf-8")
    return A.decision_rows(rows, shape, _wording(params) | {"task": {"accusation": "meta.accusation", "articles": "meta.relevant_articles"}[task]})


def convert_tnews(spark: SparkSession, paths, params) -> DataFrame:
    """The class of a headline (``mode`` choice), whether it is of one class, ``binary`` (sports_noul), or both."""
    shape, mode = A.SHAPES["tnews"], _mode(params, ("choice", "sports_noul", "both"))
    rows = A._read(spark, shape, main_files(paths), "utf-8")
    whole, parts = _wording(params), []
    if mode != "sports_noul":
        parts.append(A.decision_rows(rows, replace(shape, part="'choice'"), whole))
    if mode != "choice":
        binary = replace(shape, kind="noul", ask="'{binary_prompt}'", answer="if(array_contains({ids}, label), label = '{binary}', null)", options="array('其他新闻类别', '体育新闻类别')", part="'sports_noul'", supervision="derived_from_source_topic_label", defaults=dict(shape.defaults) | {"binary_prompt": "这则标题是否属于体育类别？", "binary": "103"})
        parts.append(A.decision_rows(rows, binary, whole))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def convert_dureader(spark: SparkSession, paths, params) -> DataFrame:
    """Yes and no answers as decisions (``mode`` noul), as a choice with *depends* (choice), or both."""
    mode, parts = _mode(params, ("noul", "choice", "both")), []
    for name, wanted in (("dureader_yesno", "noul"), ("dureader_three_way", "choice")):
        if mode in (wanted, "both"):
            shape = replace(A.SHAPES[name], part=f"'{wanted}'")
            parts.append(A.decision_rows(A._read(spark, shape, main_files(paths), "utf-8"), shape, _wording(params)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _wording(params: Mapping) -> dict:
    """What a shape's expressions may name."""
    return {k: v for k, v in params.items() if k not in ("mode", "original_split", "partition_sizes", "link_shared_answers", "task", "charset")}


def with_vocabulary(spark: SparkSession, adapter: str, paths, params: Mapping) -> tuple[object, dict]:
    """``paths`` without an auxiliary file of labels, and ``params`` with its words: a vocabulary is read once, and one
    of another size than its source has stops the build."""
    params = dict(params)
    if isinstance(paths, Mapping) and "labels" in paths:
        params["labels"] = readers.read_vocabulary(spark, paths["labels"])
        wanted = VOCABULARIES.get(adapter)
        if wanted and len(params["labels"]) != wanted:
            raise ValueError(f"{adapter} has {wanted} labels, the file {len(params['labels'])}")
        paths = {k: v for k, v in paths.items() if k != "labels"}
    if isinstance(paths, Mapping) and set(paths) == {"paths"}:
        paths = paths["paths"]
    return paths, params


JOINED: dict[str, Callable[..., DataFrame]] = {
    "webmedqa": convert_webmedqa, "cmedqa2": convert_cmedqa2, "cdn_retrieved_pairs": convert_cdn_pairs, "alternatecd_mdcf": _unprompted("CHIP-MDCFNPC", "alternatecd_mdcf"),
    "alternatecd_causal_pair": _unprompted("CMedCausal", "alternatecd_causal_pair"), "psy_insight_cn": convert_psy_insight, "squad": convert_squad, "imcs21_clinical": convert_imcs21, "remedi_human": convert_remedi,
    "cail2018": convert_cail2018, "tnews": convert_tnews, "dureader_yesno": convert_dureader,
}
