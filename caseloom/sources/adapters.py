"""Adapters: from raw deliveries of a known shape to decision rows.

An adapter is a :class:`Shape`, a record of SQL expressions: how files are read, how a record is unfolded, what the
state, question, options, answer, group and links are, and what spoils a row. One converter turns any shape into rows,
so a new source needs a record and no code; a source that can't be put this way registers a function instead.

A row that breaks a rule keeps a ``reason`` and goes to the audit; what spoils a whole file stops the build. Options
and wording are parameters of the source's configuration (``{name}`` in an expression)."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import text as X
from ..operators import cases as C
from . import readers


@dataclass(frozen=True)
class Shape:
    """``read``: reader's name. ``schema``: fields of a record. ``unfold``: array expressions exploded in turn, each as
    (expression, name of the place, name of the entry). ``derive``: columns computed in turn. ``kind``: choice, noul
    or score. ``answer``: place of the right option, a boolean, or the level. ``group``: kind and text of the group;
    ``links``: array of link keys. ``rules``: (condition that spoils a row, reason).

    The kind ``exam`` is a choice where one answer is right and a binary decision for each option where several are:
    ``ask`` is the question, ``options`` entries of letter and text, ``answer`` the letters. ``prefix``: text of an exam
    question, linked by itself and by its first 80 signs that are no white space where it has 100 or more."""

    read: str
    schema: str
    kind: str
    state: str
    ask: str
    answer: str
    options: str = ""
    keys: str = ""
    group: tuple[str, str] = ("text", "state")
    links: str = "array()"
    unfold: tuple[tuple[str, str, str], ...] = ()
    derive: tuple[tuple[str, str], ...] = ()
    rules: tuple[tuple[str, str], ...] = ()
    part: str = ""
    prefix: str = ""
    supervision: str = "source_hard_label"
    defaults: Mapping[str, str] = field(default_factory=dict)


def _words(vocabulary: list[str]) -> str:
    return "array(" + ",".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in vocabulary) + ")"


def _read(spark: SparkSession, shape: Shape, paths, charset: str) -> DataFrame:
    """``(file, line, row[, spoilt])`` of a source's records."""
    if shape.read == "jsonl":
        return readers.sound_jsonl(spark, paths, shape.schema).select("file", "line", "row")
    if shape.read == "lists":
        lines = readers.read_lines(spark, paths)
        lines = lines.where(readers.sound(F.json_array_length("value").isNotNull(), F.col("file"), F.lit("line"), F.col("line")))
        return lines.select("file", "line", F.from_json("value", f"array<struct<{_fields(shape.schema)}>>").alias("entries")).select("file", "line", F.struct("entries").alias("row"))
    if shape.read == "array":
        return readers.read_json_array(spark, paths, shape.schema).select("file", "line", "row")
    if shape.read == "tuples":
        rows = readers.read_json_array(spark, paths)
        return rows.select("file", "line", F.struct(F.from_json("value", "array<string>").alias("parts")).alias("row"))
    if shape.read == "records":
        rows = readers.read_json_records(spark, paths, shape.schema).where(readers.sound(readers.known_json(), F.col("file"), F.lit("line"), F.col("line")))
        return rows.select("file", "line", "row", F.col("reason").alias("spoilt"))
    if shape.read == "dictionary":
        return readers.read_json_dictionary(spark, paths, shape.schema).select("file", "line", F.struct("key", "row.*").alias("row"))
    if shape.read == "nested":
        rows = readers.read_nested_questions(spark, paths)
        return rows.select("file", "line", F.struct(*[c for c in rows.columns if c not in ("file", "line")]).alias("row"))
    if shape.read == "csv":
        return readers.numbered_csv(spark, paths, charset)
    if shape.read == "tsv":
        return readers.numbered_tsv(spark, paths, shape.schema).withColumnRenamed("reason", "spoilt")
    if shape.read == "pickle":
        return readers.read_pickled_lists(spark, paths).select("file", "line", F.from_json("value", shape.schema).alias("row"))
    raise ValueError(f"unknown reader {shape.read}")


def _fields(schema: str) -> str:
    return ", ".join(p.strip().replace(" ", ": ", 1) for p in _top_level(schema))


def _top_level(schema: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


def decision_rows(rows: DataFrame, shape: Shape, params: Mapping[str, object] | None = None) -> DataFrame:
    """Decision rows of records ``(file, line, row[, spoilt])``: ``source_id``, ``original_id``, ``qtype``, ``state``,
    ``questions``, ``gold`` (JSON), ``group_key``, ``link_keys``, ``supervision``, ``reason`` and ``place``, the row's
    file, record and places inside it, by which rows arrive whatever the layout. A record with what ``spoilt`` it is one
    row without content."""
    if "spoilt" in rows.columns:
        good = decision_rows(rows.where("spoilt is null").drop("spoilt"), shape, params)
        return good.unionByName(_spoilt_rows(rows.where("spoilt is not null"), "choice" if shape.kind == "exam" else shape.kind, good))
    if shape.kind == "exam":
        return _exam_rows(rows, shape, params)
    filled = {k: _words(v) if isinstance(v, (list, tuple)) else str(v) for k, v in (dict(shape.defaults) | dict(params or {})).items()}

    def sql(expression: str) -> str:
        for k, v in filled.items():
            expression = expression.replace("{" + k + "}", v)
        return expression

    flat = rows.select("file", "line", "row.*")
    for expression, place, entry in shape.unfold:
        flat = flat.select("*", F.posexplode(F.expr(sql(expression))).alias(place, entry))
    for name, expression in shape.derive:
        flat = flat.withColumn(name, F.expr(sql(expression)))
    base = _base()
    parts = [F.col(p).cast("string") for _, p, _ in shape.unfold] + ([F.expr(sql(shape.part)).cast("string")] if shape.part else [])
    out = flat.withColumns({"original_id": base, "source_id": F.concat_ws(":", base, *parts), "state": F.expr(sql(shape.state)), "_ask": F.expr(sql(shape.ask)), "_answer": F.expr(sql(shape.answer))})
    reason = F.coalesce(*[F.when(F.coalesce(F.expr(sql(c)), F.lit(True)), r) for c, r in shape.rules], F.when(~X.non_blank(F.col("state")), "blank state"), F.when(~X.non_blank(F.col("_ask")), "blank question"), F.when(~X.non_blank(F.expr(sql(shape.group[1]))), "no group"))
    if shape.kind == "noul":
        keys, texts = F.array(F.lit("false"), F.lit("true")), F.expr(sql(shape.options or "array('不成立', '成立')"))
        place, reason = F.col("_answer").cast("int"), F.coalesce(reason, F.when(F.col("_answer").isNull(), "no label"))
    elif shape.kind == "score":
        texts = F.expr(sql(shape.options))
        keys = F.transform(texts, lambda t, i: i.cast("string"))
        place, reason = F.col("_answer").cast("int"), F.coalesce(reason, F.when(F.col("_answer").isNull() | (F.col("_answer") < 0) | (F.col("_answer") >= F.size(texts)), "level out of range"))
    else:
        texts = F.expr(sql(shape.options))
        keys = F.expr(sql(shape.keys)) if shape.keys else C.lettered_options(texts)
        place, reason = F.col("_answer").cast("int"), F.coalesce(reason, C.option_reason(texts, F.col("_answer")))
    out = out.withColumns({"_keys": keys, "_texts": texts, "_place": place, "reason": reason})
    gold = D.one_hot(F.col("_keys"), F.get(F.col("_keys"), F.col("_place")))
    decision = lambda j: F.concat(F.lit('{"decision":'), j, F.lit("}"))
    kind, text = shape.group
    key = X.group_key(kind, F.expr(sql(text)))
    links = F.transform(F.array_compact(F.expr(sql(shape.links)).cast("array<string>")), lambda x: F.concat(F.lit(f"{kind}:"), X.digest(X.json_quote(X.collapse_space(x)))))
    if shape.prefix:
        compact = F.regexp_replace(F.expr(sql(shape.prefix)), f"{X.SPACE}+", "")
        start = F.when(F.length(compact) >= 100, X.group_key("medical_exam_prefix80", F.substring(compact, 1, 80)))
        links = F.array_compact(F.array(key, start))
    return out.select(
        "source_id",
        "original_id",
        F.lit(shape.kind).alias("qtype"),
        X.json_quote(F.col("state")).alias("state"),
        decision(C.question_json(shape.kind, F.col("_ask"), F.col("_keys"), F.col("_texts"))).alias("questions"),
        decision(C.gold_json(shape.kind, F.col("_keys"), gold)).alias("gold"),
        key.alias("group_key"),
        links.alias("link_keys"),
        F.lit(shape.supervision).alias("supervision"),
        "reason",
        arrival_place(*[F.col(p) for _, p, _ in shape.unfold]).alias("place"),
    )


#: What spoils an exam question with ``query``, ``entries`` (letter and text, in order) and ``picked`` letters.
_EXAM_RULES = (
    ("size(entries) not between 2 and 26", "not 2 to 26 options"), ("transform(entries, e -> e.key) <> transform(entries, (e, i) -> char(65 + i))", "options aren't lettered in order"), ("exists(entries, e -> trim(coalesce(e.value, '')) = '')", "blank option"),
    ("size(array_distinct(transform(entries, e -> trim(e.value)))) < size(entries)", "repeated options"), ("picked is null", "no answer letters"), ("size(array_except(picked, transform(entries, e -> e.key))) > 0", "answer out of range"),
)


def _exam_rows(rows: DataFrame, shape: Shape, params) -> DataFrame:
    """Rows of exam questions: one choice, or a binary decision for each option of a question with several answers."""
    flat = rows.select("file", "line", "row.*")
    for name, expression in shape.derive:
        flat = flat.withColumn(name, F.expr(expression))
    flat = flat.withColumns({"query": F.expr(shape.ask), "entries": F.array_sort(F.expr(shape.options)), "picked": X.answer_letters(X.strip_space(F.expr(shape.answer)))})
    rules = (*shape.rules, *_EXAM_RULES)
    fine = F.coalesce(*[F.when(F.coalesce(F.expr(c), F.lit(True)), r) for c, r in rules]).isNull()
    several = F.coalesce(fine & (F.size("picked") > 1), F.lit(False))
    ready = flat.select("file", "line", several.alias("several"), F.struct(*[c for c in flat.columns if c not in ("file", "line")]).alias("row"))
    one = replace(
        shape, kind="choice", ask="query", derive=(), rules=rules, group=("medical_text", "query"), prefix="query",
        answer="array_position(transform(entries, e -> e.key), picked[0]) - 1", options="transform(entries, e -> e.value)", keys="transform(entries, e -> e.key)",
    )
    each = replace(
        one, kind="noul", state="concat(query, '\\n\\n原题全部选项：\\n', array_join(transform(entries, e -> concat(e.key, '：', e.value)), '\\n'))", ask="replace('{each}', '%', o.key)",
        unfold=(("entries", "option_no", "o"),), answer="array_contains(picked, o.key)", options="array('原答案未选择此选项', '原答案选择此选项')", defaults=dict(shape.defaults) | {"each": "这是多项选择题。依据原题完整选项，选项 % 是否应被选中？"},
    )
    return decision_rows(ready.where("not several").drop("several"), one, params).unionByName(decision_rows(ready.where("several").drop("several"), each, params))


def _file() -> Column:
    """The file's own name; packed or not makes no difference."""
    return F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.gz$", "")


def _base() -> Column:
    return F.concat_ws(":", _file(), F.col("line").cast("string"))


def arrival_place(*inside: Column) -> Column:
    """A row's place among those of its source: file, record, and the places it was unfolded from."""
    at = F.array(*[c.cast("int") for c in inside]) if inside else F.array().cast("array<int>")
    return F.struct(_file().alias("file"), F.col("line").cast("long").alias("line"), at.alias("at"))


def _spoilt_rows(rows: DataFrame, kind: str, like: DataFrame) -> DataFrame:
    """Rows for the audit in the columns of ``like``, of records ``(file, line, spoilt)`` that can't be converted."""
    told = {"source_id": _base(), "original_id": _base(), "qtype": F.lit(kind), "reason": F.col("spoilt"), "place": arrival_place()}
    return rows.select(*[(told[f.name] if f.name in told else F.lit(None).cast(f.dataType)).alias(f.name) for f in like.schema.fields])


_LETTER = "array_position(array('A','B','C','D','E'), upper(trim({0}))) - 1"
_EXAM_GROUP = ("medical_text", "question")
_LINES = "filter(split(coalesce(options, ''), '\\\\r?\\\\n'), x -> trim(x) <> '')"
_UNLETTER = "transform({0}, x -> regexp_replace(x, '^\\\\s*[A-Z][\\\\s.．、:：]+', ''))"
_TURNS = (("turns", "array_join(transform(slice(dialogue, 1, turn_no + 1), t -> concat(t.speaker, '：', t.sentence)), '\\n')"),)
_PAIR = dict(read="array", group=("question", "left"), links="array(left, right)")
_SPAN = dict(read="records", kind="choice", group=_EXAM_GROUP)
_CAUSAL = "array('因果关系','上下位关系')"
#: Lines like ``A，B：因果关系`` of a target, each once; a line otherwise keeps its text as subject, and a blank target is one entry without a label.
_PAIR_LINES = "array_distinct(transform(if(trim(coalesce(target, '')) = '', array(''), filter(split(target, '\\r?\\n'), x -> trim(x) <> '')), x -> named_struct('subject', if(x rlike '^[^，]*，[^，]*：[^：]*$', trim(split(regexp_extract(x, '^(.*)：[^：]*$', 1), '，')[0]), x), 'object', if(x rlike '^[^，]*，[^，]*：[^：]*$', trim(split(regexp_extract(x, '^(.*)：[^：]*$', 1), '，')[1]), null), 'label', if(x rlike '：', regexp_extract(x, '：([^：]*)$', 1), null))))"

#: Shapes of known sources by the adapter's name.
SHAPES: dict[str, Shape] = {
    # Reading comprehension and general exams.
    "c3": Shape("tuples", "", "choice", "context", "q.question", "array_position(q.choice, q.answer) - 1", "q.choice", group=("context", "context"), unfold=(("from_json(parts[1], 'array<struct<question string, choice array<string>, answer string>>')", "question_no", "q"),), derive=(("context", "array_join(from_json(parts[0], 'array<string>'), '\\n')"),), rules=(("size(parts) <> 3", "not a document of three parts"), ("size(filter(q.choice, o -> o = q.answer)) <> 1", "answer isn't one option"))),
    "exam_csv": Shape("csv", "", "choice", "'{prompt}'", "question", _LETTER.format("answer"), "array(A, B, C, D)", group=("question", "question"), rules=(("not answer rlike '^[ABCD]$'", "no single answer"),), defaults={"prompt": "请回答下面的题目。"}),
    "dureader_yesno": Shape("jsonl", "question string, answer string, yesno_answer string", "noul", "concat(question, '\\n', answer)", "'{prompt}'", "yesno_answer = 'Yes'", group=("question", "question"), rules=(("yesno_answer not in ('Yes', 'No')", "depends or unlabelled"),), defaults={"prompt": "回答是否表示肯定？"}),
    "dureader_three_way": Shape("jsonl", "question string, answer string, yesno_answer string", "choice", "concat(question, '\\n', answer)", "'{prompt}'", "array_position(array('Yes','No','Depends'), yesno_answer) - 1", "array('肯定','否定','视情况')", group=("question", "question"), defaults={"prompt": "回答表示哪种态度？"}),
    "squad": Shape("nested", "", "noul", "concat(context, '\\n', question)", "'{prompt}'", "not impossible", group=("context", "context"), part="id", rules=(("impossible = (size(answers) > 0)", "answers contradict the flag"), ("exists(answers, a -> substring(context, a.answer_start + 1, length(a.text)) <> a.text)", "answer isn't at its place")), defaults={"prompt": "材料能否回答这个问题？"}),
    # Medical language understanding.
    "cblue_qic": Shape("array", "id string, query string, label string", "choice", "query", "'{prompt}'", "array_position({labels}, label) - 1", "{labels}", group=("question", "query"), links="array(query)", defaults={"prompt": "这个问题属于哪一类？"}),
    "cblue_sts": Shape(schema="id string, text1 string, text2 string, label string", kind="noul", state="concat(left, '\\n', right)", ask="'{prompt}'", answer="case label when '1' then true when '0' then false end", derive=(("left", "text1"), ("right", "text2")), defaults={"prompt": "两句话意思相同吗？"}, **_PAIR),
    "cblue_qtr": Shape(schema="id string, query string, title string, label string", kind="score", state="concat(left, '\\n', right)", ask="'{prompt}'", answer="try_cast(label as int)", options="array('无关','略相关','相关','完全相关')", derive=(("left", "query"), ("right", "title")), defaults={"prompt": "标题与问题的相关程度。"}, **_PAIR),
    "cblue_qqr": Shape(schema="id string, query1 string, query2 string, label string", kind="choice", state="concat(left, '\\n', right)", ask="'{prompt}'", answer="try_cast(label as int)", options="array('无关','前者包含后者','语义相同')", derive=(("left", "query1"), ("right", "query2")), defaults={"prompt": "两个问题是什么关系？"}, **_PAIR),
    "cblue_ctc": Shape("array", "id string, text string, label string", "choice", "text", "'{prompt}'", "array_position({labels}, label) - 1", "{labels}", group=("context", "text"), defaults={"prompt": "这条标准属于哪一类？"}),
    "cmexam": Shape("csv", "", "choice", "'{prompt}'", "question", _LETTER.format("answer"), _UNLETTER.format(_LINES), group=("question", "question"), rules=(("not trim(answer) rlike '^[A-E]$'", "no single answer"),), defaults={"prompt": "请回答下面的题目。"}),
    "cmexam_full": Shape("csv", "", "exam", "'{prompt}'", "question", "answer", "transform(" + _LINES + ", x -> named_struct('key', regexp_extract(x, '^\\\\s*([A-Z])[\\\\s.．、:：]+(.*)$', 1), 'value', trim(regexp_extract(x, '^\\\\s*([A-Z])[\\\\s.．、:：]+(.*)$', 2))))", rules=(("question rlike '如图|下图|見圖|如圖'", "needs a picture"),), defaults={"prompt": "请回答下面的题目。"}),
    "medqa_cn": Shape("jsonl", "question string, options map<string,string>, answer_idx string, answer string", "choice", "'{prompt}'", "question", "array_position(map_keys(options), answer_idx) - 1", "map_values(options)", keys="map_keys(options)", group=("question", "question"), rules=(("options[answer_idx] <> answer", "answer and its letter differ"),), defaults={"prompt": "请回答下面的题目。"}),
    "cmid_coarse": Shape("records", "originalText string, label_4class array<string>", "choice", "text", "'{prompt}'", "array_position({labels}, trim(both '\\'' from label_4class[0])) - 1", "{labels}", group=("medical_text", "text"), derive=(("text", "originalText"),), rules=(("size(label_4class) <> 1", "not one label"),), defaults={"prompt": "这句话的意图是？"}),
    "explain_cpe": Shape("records", "question string, options map<string,string>, answer string", "choice", "'{prompt}'", "question", "array_position(map_keys(options), answer) - 1", "map_values(options)", keys="map_keys(options)", group=_EXAM_GROUP, rules=(("question rlike '如图|下图|見圖|如圖'", "needs a picture"), ("not answer rlike '^[A-Z]$'", "no single answer")), defaults={"prompt": "请回答下面的题目。"}),
    "cmb_exam": Shape("records", "question string, option map<string,string>, answer string, question_type string", "choice", "'{prompt}'", "question", "array_position(map_keys(option), answer) - 1", "map_values(option)", keys="map_keys(option)", group=_EXAM_GROUP, rules=(("length(answer) <> 1", "several answers"),), defaults={"prompt": "请回答下面的题目。"}),
    "cmb_exam_each": Shape("records", "question string, option map<string,string>, answer string, question_type string", "noul", "concat(question, '\\n', o.value)", "'{prompt}'", "contains(answer, o.key)", group=_EXAM_GROUP, links="array(question)", unfold=(("map_entries(option)", "option_no", "o"),), rules=(("not answer rlike '^[A-Z]+$'", "no answer letters"),), defaults={"prompt": "这个选项正确吗？"}),
    "webmedqa_each": Shape("tsv", "department string, label string, question_id string, query string, answer string", "noul", "concat(query, '\\n', answer)", "'{prompt}'", "case label when '1' then true when '0' then false end", group=("medical_text", "query"), links="array(query, answer)", part="question_id", defaults={"prompt": "这个回答适合问题吗？"}),
    "tcm_sd": Shape("records", "user_id string, chief_complaint string, description string, detection string, norm_syndrome string", "choice", "record", "'{prompt}'", "array_position({labels}, norm_syndrome) - 1", "{labels}", group=("case", "user_id"), links="array(record)", derive=(("record", "array_join(filter(array(chief_complaint, description, detection), x -> trim(x) <> ''), '\\n')"),), defaults={"prompt": "病历的证型是？"}),
    "cmedqa2_matching": Shape("csv", "", "noul", "concat(question, '\\n', answer)", "'{prompt}'", "case label when '1' then true when '0' then false end", group=("medical_text", "question"), links="array(answer)", defaults={"prompt": "这个回答适合问题吗？"}),
    "cmb_exam_full": Shape("records", "id string, question string, option map<string,string>, answer string, exam_type string, exam_class string, exam_subject string, question_type string", "exam", "'{prompt}'", "question", "answer", "filter(given, (x, i) -> exists(slice(given, i + 1, size(given)), y -> y.value is null or trim(y.value) <> ''))", derive=(("given", "array_sort(map_entries(option))"),), rules=(("question_type not in ('单项选择题', '多项选择题', 'C型选择题')", "unknown kind of question"), ("exists(array(exam_type, exam_class, exam_subject), x -> trim(coalesce(x, '')) = '')", "no exam or subject"), ("(question_type = '多项选择题') <> (size(picked) > 1)", "kind of question and number of answers differ")), defaults={"prompt": "请回答下面的题目。"}),
    "medqa_full": Shape("records", "question string, options map<string,string>, answer_idx string, answer string", "exam", "'{prompt}'", "question", "answer_idx", "map_entries(options)", rules=(("options[answer_idx] <> answer", "answer and its letter differ"), ("size(picked) <> 1", "no single answer")), defaults={"prompt": "请回答下面的题目。"}),
    "mlec_qa": Shape("records", "qid string, qtype string, qtext string, options map<string,string>, answer string", "exam", "'{prompt}'", "qtext", "if(answer like '[%', if(forall(from_json(answer, 'array<string>'), x -> length(x) = 1), array_join(from_json(answer, 'array<string>'), ''), null), answer)", "map_entries(options)", defaults={"prompt": "请回答下面的题目。"}),
    "cnmleqa": Shape("records", "id string, question string, opa string, opb string, opc string, opd string, ope string, answer string", "exam", "'{prompt}'", "question", "get(array('A','B','C','D','E'), cast(array_position(array('opa','opb','opc','opd','ope'), answer) - 1 as int))", "transform(array(opa, opb, opc, opd, ope), (x, i) -> named_struct('key', char(65 + i), 'value', x))", rules=(("answer not in ('opa','opb','opc','opd','ope')", "answer out of range"),), defaults={"prompt": "请回答下面的题目。"}),
    "empec": Shape("records", "year string, subject string, profession string, question string, answer string", "exam", "'{prompt}'", "stem", "answer", "transform(slice(parts, 2, 4), (x, i) -> named_struct('key', char(65 + i), 'value', x))", derive=(("parts", "transform(split(question, '\\\\s*[A-D][.．]\\\\s*'), x -> trim(x))"), ("stem", "parts[0]")), rules=(("size(parts) <> 5", "not four options"), ("size(picked) <> 1", "no single answer")), defaults={"prompt": "请回答下面的题目。"}),
    # Dialogues and records.
    "imcs21_clinical": Shape("dictionary", "dialogue array<struct<speaker string, sentence string, dialogue_act string>>", "choice", "turns", "'{prompt}'", "array_position({labels}, turn.dialogue_act) - 1", "{labels}", group=("dialogue", "key"), links="array(array_join(transform(dialogue, t -> t.sentence), '\\n'))", unfold=(("dialogue", "turn_no", "turn"),), derive=_TURNS, defaults={"prompt": "最后一句的对话行为是？"}),
    "dialmed_recorded": Shape("records", "dialog array<string>, label array<string>", "noul", "whole", "concat('{prompt}', word)", "array_contains(label, word)", group=("dialogue", "whole"), unfold=(("{labels}", "label_no", "word"),), derive=(("whole", "array_join(dialog, '\\n')"),), rules=(("size(array_except(label, {labels})) > 0", "label outside the vocabulary"),), defaults={"prompt": "对话推荐了这种药吗："}),
    "remedi_human": Shape("array", "dialogue string, information array<struct<role string, sentence string, actions array<struct<intent string>>>>", "noul", "turns", "concat('{prompt}', word)", "exists(turn.actions, a -> a.intent = word)", group=("dialogue", "dialogue"), unfold=(("information", "turn_no", "turn"), ("{labels}", "label_no", "word")), derive=(("turns", "array_join(transform(slice(information, 1, turn_no + 1), t -> concat(t.role, '：', t.sentence)), '\\n')"),), defaults={"prompt": "最后一句有这个意图吗："}),
    "psy_insight_cn": Shape("array", "dialog_id string, dialog array<struct<speaker string, content string, strategy array<string>>>", "noul", "turns", "concat('{prompt}', word)", "array_contains(turn.strategy, word)", group=("dialogue", "dialog_id"), unfold=(("dialog", "turn_no", "turn"), ("{labels}", "label_no", "word")), derive=(("turns", "array_join(transform(slice(dialog, 1, turn_no + 1), t -> concat(t.speaker, '：', t.content)), '\\n')"),), rules=(("turn.strategy is null", "unlabelled turn"),), supervision="human_annotation", defaults={"prompt": "最后一句用了这个策略吗："}),
    "medical_ds_disease": Shape("pickle", "consult_id string, disease_tag string, goal struct<explicit_inform_slots map<string,string>, implicit_inform_slots map<string,string>>", "choice", "record", "'{prompt}'", "array_position({labels}, disease_tag) - 1", "{labels}", group=("medical_text", "record"), derive=(("record", "to_json(map_concat(coalesce(goal.explicit_inform_slots, map()), map_filter(coalesce(goal.implicit_inform_slots, map()), (k, v) -> not array_contains(map_keys(coalesce(goal.explicit_inform_slots, map())), k))))"),), rules=(("exists(map_keys(coalesce(goal.explicit_inform_slots, map())), k -> coalesce(goal.implicit_inform_slots[k] <> goal.explicit_inform_slots[k], false))", "slots contradict"),), defaults={"prompt": "可能是哪种疾病？"}),
    "lcmdc_triage": Shape("csv", "", "choice", "concat_ws('\\n', titles, infos)", "'{prompt}'", "try_cast(labels_1 as int)", "{labels}", group=("medical_text", "concat_ws('\\n', titles, infos)"), rules=(("get({labels}, try_cast(labels_1 as int)) <> labels_1_word", "number and word of the label differ"),), defaults={"prompt": "应当去哪个科室？"}),
    "meddg_entity_type": Shape("pickle", "id string, Sentence string, Symptom array<string>, Medicine array<string>, Examination array<string>, Attribute array<string>, Disease array<string>", "choice", "Sentence", "concat('{prompt}', entity.name)", "entity.type_no", "array('症状','药物','检查','属性','疾病')", group=("dialogue", "id"), unfold=(("array_distinct(flatten(transform(array(Symptom, Medicine, Examination, Attribute, Disease), (a, i) -> transform(a, x -> named_struct('name', x, 'type_no', i)))))", "entity_no", "entity"),), rules=(("size(array_distinct(flatten(transform(array(Symptom, Medicine, Examination, Attribute, Disease), (a, i) -> transform(a, x -> named_struct('name', x, 'type_no', i)))))) > size(array_distinct(transform(flatten(transform(array(Symptom, Medicine, Examination, Attribute, Disease), (a, i) -> transform(a, x -> named_struct('name', x, 'type_no', i)))), e -> e.name)))", "entity of two types in the turn"),), defaults={"prompt": "这个词属于哪一类："}),
    # Spans, relations, findings.
    "cmeee_typing": Shape(schema="text string, entities array<struct<start_idx int, end_idx int, type string, entity string>>", state="text", ask="concat('{prompt}', e.entity)", answer="array_position({labels}, e.type) - 1", options="{labels}", unfold=(("array_sort(entities)", "span_no", "e"),), derive=(("question", "text"),), rules=(("substring(text, e.start_idx + 1, e.end_idx - e.start_idx + 1) <> e.entity", "entity isn't at its place"), ("size(array_distinct(transform(filter(entities, x -> x.start_idx = e.start_idx and x.end_idx = e.end_idx), x -> x.type))) > 1", "span of two types")), defaults={"prompt": "这个词属于哪一类："}, **_SPAN),
    "cmeie_typing": Shape(schema="text string, spo_list array<struct<subject string, predicate string, object map<string,string>>>", state="text", ask="concat('{prompt}', r.subject, '、', r.object)", answer="array_position({labels}, told[0]) - 1", options="{labels}", unfold=(("array_sort(array_distinct(transform(spo_list, x -> named_struct('subject', trim(x.subject), 'object', trim(x.object['@value'])))))", "pair_no", "r"),), derive=(("question", "text"), ("told", "array_distinct(transform(filter(spo_list, x -> trim(x.subject) = r.subject and trim(x.object['@value']) = r.object), x -> x.predicate))")), rules=(("exists(spo_list, x -> not (contains(text, trim(x.subject)) and contains(text, trim(x.object['@value']))))", "entity isn't in the text"), ("size(told) <> 1", "pair of several relations"), ("not array_contains({labels}, told[0])", "relation outside the schema")), defaults={"prompt": "两个词是什么关系："}, **_SPAN),
    "text2dt_typing": Shape(schema="text string, tree array<struct<triples array<array<string>>>>", state="text", ask="concat('{prompt}', r.subject, '、', r.object)", answer="array_position({labels}, told[0]) - 1", options="{labels}", unfold=(("array_sort(array_distinct(transform(flatten(transform(tree, t -> t.triples)), x -> named_struct('subject', x[0], 'object', x[2]))))", "pair_no", "r"),), derive=(("question", "text"), ("triples", "flatten(transform(tree, t -> t.triples))"), ("told", "array_distinct(transform(filter(triples, x -> x[0] = r.subject and x[2] = r.object), x -> x[1]))")), rules=(("exists(triples, x -> size(x) <> 3 or exists(x, v -> trim(coalesce(v, '')) = ''))", "not a triple"), ("size(told) <> 1", "pair of several relations"), ("not array_contains({labels}, told[0])", "relation outside the schema")), defaults={"prompt": "两个词是什么关系："}, **_SPAN),
    "cdn_retrieved_pairs": Shape("tsv", "text_a string, text_b string, label string", "noul", "concat(text_a, '\\n', text_b)", "'{prompt}'", "case label when '1' then true when '0' then false end", group=("medical_text", "text_a"), defaults={"prompt": "后者是前者的标准说法之一吗？"}),
    "alternatecd_mdcf": Shape("records", "task_dataset string, answer_choices array<string>, input string, target string, sample_id string", "choice", "input", "concat('{prompt}', parts[1])", "array_position(answer_choices, parts[2]) - 1", "answer_choices", group=("medical_text", "input"), unfold=(("array_distinct(filter(split(target, '\\n'), x -> trim(x) <> ''))", "finding_no", "entry"),), derive=(("parts", "array('', trim(regexp_extract(entry, '^(.*)：([^：]*)$', 1)), regexp_extract(entry, '^(.*)：([^：]*)$', 2))"),), rules=(("not contains(entry, '：')", "no finding and state"), ("parts[1] = '' or not array_contains(answer_choices, parts[2]) or not contains(input, parts[1])", "finding isn't in the dialogue"), ("exists(split(target, '\\n'), x -> trim(regexp_extract(x, '^(.*)：([^：]*)$', 1)) = parts[1] and not endswith(x, concat('：', parts[2])))", "finding of several states")), defaults={"prompt": "这个发现的性质是："}),
    "alternatecd_causal_pair": Shape("records", "task_dataset string, answer_choices array<string>, input string, target string, sample_id string", "choice", "input", "concat('{prompt}', r.subject, '、', r.object)", "array_position(" + _CAUSAL + ", r.label) - 1", _CAUSAL, group=("medical_text", "input"), unfold=((_PAIR_LINES, "pair_no", "r"),), rules=(("task_dataset <> 'CMedCausal' or array_sort(array_distinct(answer_choices)) <> array_sort(array_append(" + _CAUSAL + ", '条件关系'))", "another task or vocabulary"), ("r.label is null", "no labelled pair"), ("r.label = '条件关系'", "conditional triple"), ("r.object is null or not array_contains(" + _CAUSAL + ", r.label)", "ambiguous pair"), ("r.subject = '' or r.object = '' or not (contains(input, r.subject) and contains(input, r.object))", "mention isn't in the document"), ("size(array_distinct(transform(filter(" + _PAIR_LINES + ", x -> x.subject = r.subject and x.object = r.object and array_contains(" + _CAUSAL + ", x.label)), x -> x.label))) > 1", "pair of several relations")), defaults={"prompt": "两件事是什么关系："}),
    "psyqa_strategy": Shape("records", "question string, description string, questionID string, answers array<struct<has_label boolean, answer_text string, labels_sequence array<struct<start int, end int, type string>>>>", "choice", "concat_ws('\\n', question, description, substring(a.answer_text, 1, s.start), substring(a.answer_text, s.start + 1, s.end - s.start))", "'{prompt}'", "array_position({labels}, s.type) - 1", "{labels}", group=("medical_text", "concat_ws('\n', question, description)"), links="array(question)", unfold=(("answers", "answer_no", "a"), ("if(coalesce(a.has_label, false) and size(a.labels_sequence) > 0, a.labels_sequence, array(named_struct('start', cast(null as int), 'end', cast(null as int), 'type', cast(null as string))))", "span_no", "s")), rules=(("not coalesce(a.has_label, false)", "answer without strategies"), ("s.start < 0 or s.start >= s.end or s.end > length(a.answer_text)", "span out of the answer"), ("not array_contains({labels}, s.type)", "unknown strategy")), defaults={"prompt": "最后一段用了什么策略？"}),
    # Law.
    "cail2019_elements": Shape("lists", "sentence string, labels array<string>", "noul", "e.sentence", "concat('{prompt}', word)", "array_contains(e.labels, word)", group=("law_document", "to_json(entries)"), unfold=(("entries", "sentence_no", "e"), ("{labels}", "label_no", "word")), rules=(("exists(entries, x -> size(array_except(x.labels, {labels})) > 0)", "label outside the vocabulary"),), defaults={"prompt": "这句话含有这个要素吗："}),
    "jec_qa": Shape("jsonl", "statement string, option_list map<string,string>, answer array<string>", "choice", "'{prompt}'", "statement", "array_position(map_keys(option_list), answer[0]) - 1", "map_values(option_list)", keys="map_keys(option_list)", group=("law_question", "statement"), rules=(("size(answer) <> 1", "several answers"),), defaults={"prompt": "请回答下面的题目。"}),
    "jec_qa_each": Shape("jsonl", "statement string, option_list map<string,string>, answer array<string>", "noul", "concat(statement, '\\n', o.value)", "'{prompt}'", "array_contains(answer, o.key)", group=("law_question", "statement"), unfold=(("map_entries(option_list)", "option_no", "o"),), rules=(("size(answer) < 1", "no answer"),), defaults={"prompt": "这个选项正确吗？"}),
    "cail2018": Shape("jsonl", "fact string, meta struct<accusation array<string>, relevant_articles array<string>>", "noul", "fact", "concat('{prompt}', word)", "array_contains({task}, word)", group=("law_fact", "fact"), unfold=(("{labels}", "label_no", "word"),), rules=(("size(array_except({task}, {labels})) > 0", "label outside the vocabulary"),), defaults={"prompt": "事实符合这一项吗：", "task": "meta.accusation"}),
    "cail2019_scm": Shape("jsonl", "A string, B string, C string, label string", "choice", "A", "'{prompt}'", "array_position(array('B','C'), label) - 1", "array(B, C)", group=("law_query", "A"), rules=(("size(array_distinct(array(A, B, C))) < 3", "equal texts"),), defaults={"prompt": "哪一个案件更相似？"}),
    "lcr_cn": Shape("jsonl", "content string, title string, high_level_laws array<string>, conflict_type string, url string", "choice", "concat_ws('\\n', title, content, array_join(high_level_laws, '\\n'))", "'{prompt}'", "array_position({labels}, conflict_type) - 1", "{labels}", group=("law_document", "concat(lower(try_parse_url(url, 'HOST')), try_parse_url(url, 'PATH'), coalesce(concat('?id=', try_parse_url(url, 'QUERY', 'id')), ''))"), defaults={"prompt": "属于哪一种冲突？"}),
    # Everyday texts.
    "finfe": Shape("tuples", "", "choice", "parts[0]", "'{prompt}'", "if(parts[1] rlike '^[0-9]+$', try_cast(parts[1] as int), null)", "array('消极','中性','积极')", defaults={"prompt": "这句话的情绪是？"}),
    "finnsp": Shape("tuples", "", "noul", "concat_ws('\\n', parts[1], parts[2], parts[3])", "'{prompt}'", "case parts[4] when '1' then true when '0' then false end", group=("text", "parts[2]"), rules=(("parts[0] = 'id'", "header within the data"),), defaults={"prompt": "对该主体是负面消息吗？"}),
    "tnews": Shape("jsonl", "id string, sentence string, label string, label_desc string", "choice", "sentence", "'{prompt}'", "array_position({ids}, label) - 1", "{labels}", group=("text", "sentence"), rules=(("get({labels}, cast(array_position({ids}, label) as int) - 1) <> label_desc", "number and word of the label differ"),), defaults={"prompt": "这条新闻属于哪一类？"}),
    "chnsenticorp_htl": Shape("csv", "", "noul", "review", "'{prompt}'", "case label when '1' then true when '0' then false end", group=("text", "review"), defaults={"prompt": "评价是正面的吗？"}),
}

Converter = Callable[..., DataFrame]


class Registry:
    """Shapes and functions by name. A name can be given once; the built-in names can't be replaced."""

    def __init__(self):
        self._own: dict[str, Shape | Converter] = {}

    def register(self, name: str, adapter: Shape | Converter) -> None:
        if name in SHAPES or name in built_in() or name in self._own:
            raise ValueError(f"adapter {name} exists")
        self._own[name] = adapter

    def names(self) -> list[str]:
        return sorted({*SHAPES, *built_in(), *self._own})

    def load(self, namespace: Mapping[str, object]) -> None:
        """Adds the ``ADAPTERS`` of a plug-in module."""
        if not isinstance(namespace.get("ADAPTERS"), dict):
            raise ValueError("a plug-in needs a dictionary ADAPTERS")
        for name, adapter in namespace["ADAPTERS"].items():
            self.register(name, adapter)

    def convert(self, spark: SparkSession, name: str, paths, params: Mapping[str, object] | None = None) -> DataFrame:
        """Decision rows of a source's files. A mapping of ``paths`` may name a file of ``labels``, which fills that
        parameter; ``limit`` takes the first so many rows by their place."""
        from .joined import with_vocabulary

        found = self._own.get(name) or built_in().get(name) or SHAPES.get(name)
        if found is None:
            raise ValueError(f"no adapter {name}")
        paths, params = with_vocabulary(spark, name, paths, params or {})
        limit = params.pop("limit", None)
        rows = self._rows(spark, found, paths, params)
        if limit is None:
            return rows
        return rows.orderBy(*(["place"] if "place" in rows.columns else ["source_id"]), "source_id").limit(int(limit))

    @staticmethod
    def _rows(spark: SparkSession, found: Shape | Converter, paths, params: dict) -> DataFrame:
        if not isinstance(found, Shape):
            return found(spark, paths, params)
        return decision_rows(_read(spark, found, paths, str(params.pop("charset", "utf-8"))), found, params)


def convert_native(spark: SparkSession, paths, params) -> DataFrame:
    """Cases of the engine's own form, one row for each question; fields written as JSON texts are read as JSON."""
    schema = "id string, state string, questions string, gold string, _meta struct<group_key string, link_keys array<string>, supervision string>"
    rows = readers.sound_jsonl(spark, paths, schema).select("file", "line", "row.*")
    asked = F.from_json("questions", "map<string,string>")
    each = rows.select("*", F.posexplode(F.map_entries(asked)).alias("q_no", "q"), F.size(asked).alias("n"))
    told = F.element_at(F.from_json("gold", "map<string,string>"), F.col("q.key"))
    named = lambda j: F.concat(F.lit("{"), X.json_quote(F.col("q.key")), F.lit(":"), j, F.lit("}"))
    state = F.when(F.ltrim("state").rlike(r"^[\[{]"), F.col("state")).otherwise(X.json_quote(F.col("state")))
    key = F.coalesce("_meta.group_key", X.group_key("state", F.col("state")))
    return each.select(
        F.concat("id", F.when(F.col("n") > 1, F.concat(F.lit(":"), F.col("q.key"))).otherwise("")).alias("source_id"),
        F.col("id").alias("original_id"),
        F.get_json_object(F.col("q.value"), "$.type").alias("qtype"),
        state.alias("state"),
        named(F.col("q.value")).alias("questions"),
        named(told).alias("gold"),
        key.alias("group_key"),
        F.coalesce("_meta.link_keys", F.array().cast("array<string>")).alias("link_keys"),
        F.coalesce("_meta.supervision", F.lit("source_hard_label")).alias("supervision"),
        F.when(told.isNull(), "no gold").alias("reason"),
        arrival_place(F.col("q_no")).alias("place"),
    )


def raw_record_rows(raw: DataFrame, link_keys: Column | None = None, need_group: bool = False) -> DataFrame:
    """Decision rows of plug-in records ``(id, grp, type, state, instruction, criteria, label)``: a choice by key, a
    binary decision by true or false, a score by level. A label that isn't among the criteria gets a reason, and so does
    a null or blank group where builds ``need_group``; the SQL of the queries over raw has no such reason."""
    crit, levels = F.from_json("criteria", "map<string,string>"), F.from_json("criteria", "array<string>")
    keys = F.when(F.col("type") == "score", F.transform(levels, lambda x, i: i.cast("string"))).when(F.col("type") == "noul", F.array(F.lit("false"), F.lit("true"))).otherwise(F.map_keys(crit))
    rows = raw.withColumn("_keys", keys)
    gold = D.one_hot(F.col("_keys"), F.col("label"))
    pairs = F.zip_with("_keys", gold, lambda k, p: F.concat(X.json_quote(k), F.lit(":"), p.cast("string")))
    told = F.concat(F.lit('{"decision":{"type":'), X.json_quote(F.col("type")), F.lit(',"probabilities":{'), F.array_join(pairs, ","), F.lit("}}}"))
    asked = F.concat(F.lit('{"decision":{"type":'), X.json_quote(F.col("type")), F.lit(',"instructions":'), X.json_quote(F.col("instruction")), F.lit(',"criteria":'), F.col("criteria"), F.lit("}}"))
    reason = (
        F.when(~F.col("type").isin(*D.KINDS), "unknown kind of decision")
        .when(~X.non_blank(F.col("instruction")), "blank instructions")
        .when(F.col("_keys").isNull() | (F.size("_keys") < 2), "no criteria")
        .when(~F.coalesce(F.array_contains("_keys", F.col("label")), F.lit(False)), "label isn't among the criteria")
        .when(~(X.non_blank(F.col("state.text")) | X.non_blank(F.col("state.question"))), "blank state")
        .when(F.lit(need_group) & ~X.non_blank(F.col("grp")), "no group")
    )
    return rows.select(
        F.col("id").alias("source_id"), F.col("id").alias("original_id"), F.col("type").alias("qtype"), F.to_json("state").alias("state"), asked.alias("questions"), told.alias("gold"),
        X.group_key("raw_parent", F.col("grp"), compose=False).alias("group_key"), (link_keys if link_keys is not None else F.array().cast("array<string>")).alias("link_keys"),
        F.lit("source_hard_label").alias("supervision"), reason.alias("reason"), *[c for c in ("raw_no", "source", "place") if c in raw.columns],
    )


def convert_raw_jsonl(spark: SparkSession, paths, params) -> DataFrame:
    """Plug-in records in JSON lines."""
    schema = "id string, group string, type string, state struct<text string, question string, slots array<struct<name string, value string>>>, instruction string, criteria string, label string"
    rows = readers.sound_jsonl(spark, paths, schema).select("row.*", arrival_place().alias("place")).withColumnRenamed("group", "grp")
    return raw_record_rows(rows, need_group=True)


def _none(found: DataFrame, what: str) -> None:
    """Stops the build where there is a row, naming the first few."""
    rows = found.limit(3).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def convert_judged_pairs(spark: SparkSession, paths: Mapping[str, object], params) -> DataFrame:
    """Graded relevance of passages to queries from three files: ``queries``, ``judgements``, ``passages``. Unjudged
    pairs are no cases. ``keep`` takes a share of the queries by the hash of their group.

    Each file may begin with its known header. The build stops at any other line that can't be read, at a query or a
    wanted passage without text or with two lines, at a judged query or passage that is missing, and at two grades of
    one pair; a judgement given twice is one."""
    from ..operators.joins import judged_pairs, missing_references, repeated_keys

    def texts(name, key, value):
        rows = readers.read_two_columns(spark, paths[name], key, value)
        return rows.where(~((F.col("line") == 1) & F.col(key).eqNullSafe(F.lit(key)) & F.col(value).eqNullSafe(F.lit("text"))))

    queries, passages = texts("queries", "qid", "query"), texts("passages", "pid", "passage")
    judgements = readers.read_judgements(spark, paths["judgements"])
    judgements = judgements.where(~((F.col("line") == 1) & (F.col("qid") == "qid") & (F.col("pid") == "pid") & F.col("reason").eqNullSafe(F.lit("grade out of range")) & F.col("grade").isNull()))
    _none(judgements.where("reason is not null").select("file", "line", "reason"), "bad judgements")
    _none(queries.where(~X.non_blank(F.col("qid")) | ~X.non_blank(F.col("query"))).select("file", "line"), "queries without id or text")
    _none(passages.where("passage is null").select("file", "line"), "passages without a tab")
    _none(repeated_keys(queries, "qid"), "repeated queries")
    pairs = judgements.select("qid", "pid", "grade")
    _none(missing_references(pairs, queries, "qid"), "judged queries are missing")
    queries = queries.select("qid", "query", X.group_key("question", F.col("query")).alias("group_key"))
    if "keep" in params:
        queries = queries.where(X.hash_fraction(F.col("group_key"), params.get("seed", 0)) < float(params["keep"]))
        pairs = pairs.join(queries.select("qid"), "qid", "left_semi")
    _none(pairs.groupBy("qid", "pid").agg(F.min("grade").alias("low"), F.max("grade").alias("high")).where("low <> high"), "two grades for one pair")
    wanted = passages.join(pairs.select("pid").distinct(), "pid", "left_semi")
    _none(repeated_keys(wanted, "pid"), "repeated passages")
    _none(wanted.where(~X.non_blank(F.col("passage"))).select("file", "line", "pid"), "passages without text")
    _none(missing_references(pairs, passages, "pid"), "judged passages are missing")
    judged = judged_pairs(pairs.distinct(), queries, passages.select("pid", "passage"))
    levels = F.array(*[F.lit(x) for x in ("无关", "略相关", "相关", "完全相关")])
    keys = F.transform(levels, lambda t, i: i.cast("string"))
    gold = D.one_hot(keys, F.col("grade").cast("string"))
    wrap = lambda j: F.concat(F.lit('{"decision":'), j, F.lit("}"))
    return judged.select(
        F.concat_ws(":", "qid", "pid").alias("source_id"), F.col("qid").alias("original_id"), F.lit("score").alias("qtype"),
        X.json_quote(F.concat_ws("\n", "query", "passage")).alias("state"),
        wrap(C.question_json("score", F.lit(params.get("prompt", "段落与问题的相关程度。")), keys, levels)).alias("questions"),
        wrap(C.gold_json("score", keys, gold)).alias("gold"), "group_key", F.array().cast("array<string>").alias("link_keys"), F.lit("source_hard_label").alias("supervision"), F.lit(None).cast("string").alias("reason"),
    )


def convert_cmb_exam_full(spark: SparkSession, paths, params) -> DataFrame:
    """Exam questions with their answers in their own records, or in a file of their own: ``questions``, ``answers``."""
    from ..operators.joins import matched_answers

    shape = SHAPES["cmb_exam_full"]
    if not isinstance(paths, Mapping):
        return decision_rows(_read(spark, shape, paths, "utf-8"), shape, params)
    read = _read(spark, shape, paths["questions"], "utf-8").select("file", "line", "spoilt", "row.*")
    answers = _read(spark, shape, paths["answers"], "utf-8").select("row.id", "row.answer", *[f"row.{c}" for c in _CMB_AGREE])
    joined = matched_answers(read.withColumnRenamed("answer", "own"), answers, "id", "answer", _CMB_AGREE)
    spoilt = F.coalesce("spoilt", "reason", F.when(F.col("own") != F.col("answer"), "answers differ"))
    fields = [c for c in read.columns if c not in ("file", "line", "spoilt")]
    return decision_rows(joined.select("file", "line", F.struct(*fields).alias("row"), spoilt.alias("spoilt")), shape, params)


@cache
def built_in() -> dict[str, Converter]:
    """Adapters that are functions, by name; they go before shapes of the same name."""
    from .joined import JOINED

    return BUILT_IN | JOINED


_CMB_AGREE = ["exam_type", "exam_class", "exam_subject", "question_type"]
BUILT_IN: dict[str, Converter] = {"cmb_exam_full": convert_cmb_exam_full, "native": convert_native, "project_jsonl": convert_raw_jsonl, "t2ranking": convert_judged_pairs}
