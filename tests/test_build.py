"""Readers, adapters, configurations and whole builds in temporary folders."""

import gzip
import json
import pickle

import pytest
from pyspark.sql import functions as F

from caseloom.plans import build as P
from caseloom.plans.config import ConfigError, check_build, check_run, reusable_cache
from caseloom.sources import readers as R
from caseloom.sources.adapters import SHAPES, Registry, Shape, decision_rows


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_line_readers(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '﻿{"a":1}\n\n  \nnot json\n{"a":2,"a":3}\n')
    rows = R.read_jsonl(spark, path, "a int").orderBy("line").collect()
    assert [(r.line, r.broken, r.row.a if r.row and not r.broken else None) for r in rows] == [(1, False, 1), (4, True, None), (5, False, 3)]
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"a":7}\n')
    assert R.read_jsonl(spark, str(tmp_path / "b.jsonl.gz"), "a int").first().row.a == 7
    array = write(tmp_path / "c.json", '[{"a":1}, {"a":2,"b":3,"b":4}]')
    assert [(r.line, r.reason) for r in R.read_json_records(spark, [array], "a int").orderBy("line").collect()] == [(1, None), (2, "repeated field")]
    assert R.read_json_records(spark, [path.replace("a.jsonl", "a.jsonl")], "a int").count() == 3
    with pytest.raises(ValueError):
        R.read_json_records(spark, [write(tmp_path / "d.txt", "hello")], "a int")
    keyed = write(tmp_path / "e.json", '{"z":{"a":1},"b":{"a":2}}')
    assert [(r.line, r.key, r.row.a) for r in R.read_json_dictionary(spark, keyed, "a int").orderBy("line").collect()] == [(1, "z", 1), (2, "b", 2)]


def test_table_readers(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'q,a\n"line\nbreak","say ""x"""\n')
    assert R.read_csv(spark, path).first()[:] == ("line\nbreak", 'say "x"')
    (tmp_path / "g.csv").write_bytes("标题,值\n医生,1\n".encode("gb18030"))
    assert R.read_csv(spark, str(tmp_path / "g.csv"), charset="gb18030").first().asDict() == {"标题": "医生", "值": "1"}
    tsv = write(tmp_path / "t.tsv", 'a\t"b\tc\n')
    assert R.read_tsv(spark, tsv, "x string, y string, z string").first()[:] == ("a", '"b', "c")
    two = write(tmp_path / "q.tsv", "qid\tquery\nq1\ta\tb\n")
    assert [(r.qid, r.query) for r in R.read_two_columns(spark, two, "qid", "query", header=True).collect()] == [("q1", "a\tb")]
    grades = write(tmp_path / "j.txt", "q1 0 p1 2\nq1  0\tp2 9\nq1 0 p3\n")
    assert [r.reason for r in R.read_judgements(spark, grades).orderBy("line").collect()] == [None, "grade out of range", "not four fields"]
    assert R.read_words(spark, write(tmp_path / "w.txt", "b\na\n\n")) == ["b", "a"]
    with pytest.raises(ValueError):
        R.read_words(spark, write(tmp_path / "w2.txt", "b\nb\n"))
    info = R.file_inventory(spark, [two]).first()
    assert info.bytes == len("qid\tquery\nq1\ta\tb\n")


def test_pickles(spark, tmp_path):
    (tmp_path / "p.pk").write_bytes(pickle.dumps([{"a": "x"}, {"a": "y"}]))
    assert [json.loads(r.value)["a"] for r in R.read_pickled_lists(spark, str(tmp_path / "p.pk")).orderBy("line").collect()] == ["x", "y"]
    (tmp_path / "bad.pk").write_bytes(pickle.dumps([print]))
    with pytest.raises(Exception, match="not allowed"):
        R.read_pickled_lists(spark, str(tmp_path / "bad.pk")).collect()


def test_templates(spark):
    df = spark.createDataFrame([("前[1]: abc 后",), ("no",), ("前[1]: a\nb 后",)], "t string")
    assert [r[0] for r in df.select(R.template_capture(F.col("t"), ["前[1]: [INPUT_TEXT] 后", "[INPUT_TEXT]!"])).collect()] == ["abc", None, "a\nb"]


def _rows(spark, name, record, params=None, file="f.json"):
    """Decision rows of one record of a shape."""
    shape = SHAPES[name]
    df = spark.createDataFrame([(file, 1, json.dumps(record, ensure_ascii=False))], "file string, line long, j string")
    fields = shape.schema or params.pop("fields")
    return decision_rows(df.select("file", "line", F.from_json("j", fields).alias("row")), shape, params).collect()


def _label(row):
    probs = json.loads(row.gold)["decision"]["probabilities"]
    return max(probs, key=probs.get)


def test_shapes_of_each_kind(spark):
    r = _rows(spark, "cblue_sts", {"id": "1", "text1": "a", "text2": "b", "label": "1"})[0]
    assert r.reason is None and _label(r) == "true" and len(r.link_keys) == 2
    assert _rows(spark, "cblue_sts", {"id": "1", "text1": "a", "text2": "b", "label": "x"})[0].reason == "no label"
    r = _rows(spark, "cblue_qtr", {"id": "1", "query": "a", "title": "b", "label": "3"})[0]
    assert r.qtype == "score" and _label(r) == "3"
    assert _rows(spark, "cblue_qtr", {"id": "1", "query": "a", "title": "b", "label": "7"})[0].reason == "level out of range"
    r = _rows(spark, "cblue_qic", {"id": "1", "query": "q", "label": "乙"}, {"labels": ["甲", "乙"]})[0]
    assert _label(r) == "B" and r.reason is None
    r = _rows(spark, "medqa_cn", {"question": "q", "options": {"A": "x", "B": "y"}, "answer_idx": "B", "answer": "y"})[0]
    assert _label(r) == "B"
    assert _rows(spark, "medqa_cn", {"question": "q", "options": {"A": "x", "B": "y"}, "answer_idx": "B", "answer": "x"})[0].reason == "answer and its letter differ"
    rows = _rows(spark, "cmb_exam_each", {"question": "q", "option": {"A": "x", "B": "y", "C": "z"}, "answer": "AC"})
    assert [_label(r) for r in rows] == ["true", "false", "true"] and len({r.source_id for r in rows}) == 3


def test_unfolded_shapes(spark):
    turns = {"key": "d1", "dialogue": [{"speaker": "医", "sentence": "好", "dialogue_act": "问"}, {"speaker": "患", "sentence": "疼", "dialogue_act": "答"}]}
    shape = SHAPES["imcs21_clinical"]
    df = spark.createDataFrame([("f", 1, json.dumps(turns, ensure_ascii=False))], "file string, line long, j string")
    rows = decision_rows(df.select("file", "line", F.from_json("j", "key string, " + shape.schema).alias("row")), shape, {"labels": ["问", "答"]}).collect()
    assert [json.loads(r.state) for r in rows] == ["医：好", "医：好\n患：疼"] and [_label(r) for r in rows] == ["A", "B"]
    rows = _rows(spark, "cmeee_typing", {"text": "头痛两天", "entities": [{"start_idx": 0, "end_idx": 1, "type": "sym", "entity": "头痛"}, {"start_idx": 2, "end_idx": 3, "type": "dur", "entity": "一天"}]}, {"labels": ["sym", "dur"]})
    assert [r.reason for r in rows] == [None, "entity isn't at its place"]
    law = [{"sentence": "甲", "labels": ["L1"]}, {"sentence": "乙", "labels": []}]
    shape = SHAPES["cail2019_elements"]
    df = spark.createDataFrame([("f", 1, json.dumps(law, ensure_ascii=False))], "file string, line long, j string")
    entries = df.select("file", "line", F.struct(F.from_json("j", "array<struct<sentence: string, labels: array<string>>>").alias("entries")).alias("row"))
    rows = decision_rows(entries, shape, {"labels": ["L1", "L2"]}).collect()
    assert [_label(r) for r in rows] == ["true", "false", "false", "false"]
    rows = _rows(spark, "psyqa_strategy", {"question": "q", "description": "d", "questionID": "1", "answers": [{"has_label": True, "answer_text": "abcd", "labels_sequence": [{"start": 0, "end": 2, "type": "x"}, {"start": 2, "end": 4, "type": "y"}]}]}, {"labels": ["x", "y"]})
    assert [json.loads(r.state).split("\n")[2:] for r in rows] == [["", "ab"], ["ab", "cd"]]


EXAM = {"id": "7", "question": "首选药物是？", "opa": "甲", "opb": "乙", "opc": "丙", "opd": "丁", "ope": "戊"}


def test_exam_answers_named_by_their_field(spark):
    rows = [_rows(spark, "cnmleqa", EXAM | {"answer": a})[0] for a in ("opa", "ope", "B")]
    assert [r.reason for r in rows] == [None, None, "answer out of range"]
    assert [_label(r) for r in rows[:2]] == ["A", "E"]


OPTIONS = {"A": "甲", "B": "乙", "C": "丙"}
CMB = {"question": "问", "option": OPTIONS | {"D": "丁", "E": " "}, "exam_type": "t", "exam_class": "c", "exam_subject": "s", "question_type": "多项选择题"}


def test_exams_with_several_answers(spark):
    rows = _rows(spark, "mlec_qa", {"qid": "1", "qtype": "A1型题", "qtext": "问", "options": OPTIONS, "answer": ["A", "C"]})
    assert [(r.qtype, r.reason, _label(r)) for r in rows] == [("noul", None, x) for x in ("true", "false", "true")]
    assert json.loads(rows[1].state) == "问\n\n原题全部选项：\nA：甲\nB：乙\nC：丙" and "选项 B 是否" in rows[1].questions and len({r.source_id for r in rows}) == 3
    one = _rows(spark, "mlec_qa", {"qid": "1", "qtext": "问", "options": OPTIONS, "answer": ["B"]})
    assert [(r.qtype, r.reason, _label(r)) for r in one] == [("choice", None, "B")]
    assert [r.reason for r in _rows(spark, "mlec_qa", {"qtext": "问", "options": OPTIONS, "answer": "AD"})] == ["answer out of range"]
    assert [_label(r) for r in _rows(spark, "cmexam_full", {"question": "问", "options": "A 甲\nB 乙\nC 丙", "answer": "AB"}, {"fields": "question string, options string, answer string"})] == ["true", "true", "false"] if SHAPES["cmexam_full"].schema else True
    assert [_label(r) for r in _rows(spark, "cmb_exam_full", CMB | {"answer": "BD"})] == ["false", "true", "false", "true"]
    assert [r.reason for r in _rows(spark, "cmb_exam_full", CMB | {"answer": "B"})] == ["kind of question and number of answers differ"]
    assert [r.reason for r in _rows(spark, "medqa_full", {"question": "q", "options": OPTIONS, "answer_idx": "AB", "answer": "x"})] == ["answer and its letter differ"]


def test_exam_answers_of_their_own_file(spark, tmp_path):
    questions = [CMB | {"id": str(i)} for i in range(4)]
    kinds = {k: CMB[k] for k in ("exam_type", "exam_class", "exam_subject", "question_type")}
    answers = [kinds | {"id": "0", "answer": "AC"}, kinds | {"id": "1", "answer": "AC", "exam_type": "x"}, kinds | {"id": "2", "answer": "AZ"}]
    paths = {k: write(tmp_path / f"{k}.json", json.dumps(v, ensure_ascii=False)) for k, v in (("questions", questions), ("answers", answers))}
    rows = sorted(Registry().convert(spark, "cmb_exam_full", paths).collect(), key=lambda r: r.source_id)
    assert [r.reason for r in rows] == [None] * 4 + ["fields differ", "answer out of range", "no answer"] and [_label(r) for r in rows[:4]] == ["true", "false", "true", "false"]


def test_exam_links(spark):
    """Equal starts link questions of every exam, white space aside."""
    long = "患者男，五十岁。" * 13
    a = _rows(spark, "medqa_full", {"question": long + "甲？", "options": OPTIONS, "answer_idx": "A", "answer": "甲"})[0]
    b = _rows(spark, "cnmleqa", EXAM | {"question": " " + long.replace("，", "，\n") + "乙？", "answer": "opb"})[0]
    c = _rows(spark, "mlec_qa", {"qtext": "短", "options": OPTIONS, "answer": "A"})[0]
    d = _rows(spark, "empec", {"question": long + "丁？\nA. 甲\nB. 乙\nC. 丙\nD. 丁", "answer": "D"})[0]
    assert [r.reason for r in (a, b, c, d)] == [None] * 4 and c.link_keys == [c.group_key]
    assert all(r.group_key in r.link_keys for r in (a, b, d)) and len(set(a.link_keys) & set(b.link_keys) & set(d.link_keys)) == 1


CAUSAL = {"task_dataset": "CMedCausal", "answer_choices": ["因果关系", "条件关系", "上下位关系"], "input": "着凉引起咳嗽，咳嗽是症状，多喝水。", "sample_id": "9"}


def test_causal_pairs_of_one_target(spark):
    target = "着凉，咳嗽：因果关系\n咳嗽，症状：上下位关系\n着凉，咳嗽：因果关系\n着凉，[喝水，咳嗽]：条件关系\n着凉，喝水，咳嗽：因果关系\n着凉，发热：因果关系\n无\n水，症状：因果关系\n水，症状：上下位关系"
    rows = _rows(spark, "alternatecd_causal_pair", CAUSAL | {"target": target})
    none, several = [None] * 2, ["pair of several relations"] * 2
    assert [r.reason for r in rows] == [*none, "conditional triple", "ambiguous pair", "mention isn't in the document", "no labelled pair", *several]
    assert [_label(r) for r in rows[:2]] == ["A", "B"] and "着凉、咳嗽" in rows[0].questions and len({r.source_id for r in rows}) == 8
    assert [r.reason for r in _rows(spark, "alternatecd_causal_pair", CAUSAL | {"target": " "})] == ["no labelled pair"]
    assert [r.reason for r in _rows(spark, "alternatecd_causal_pair", CAUSAL | {"task_dataset": "x", "target": "着凉，咳嗽：因果关系"})] == ["another task or vocabulary"]


def test_every_shape_parses(spark):
    """Each shape's expressions resolve over its schema; an empty input gives no rows."""
    extra = {
        "c3": "parts array<string>", "finfe": "parts array<string>", "finnsp": "parts array<string>", "exam_csv": "question string, A string, B string, C string, D string, answer string",
        "cmexam": "question string, options string, answer string", "cmexam_full": "question string, options string, answer string", "cmedqa2_matching": "question string, answer string, label string",
        "lcmdc_triage": "titles string, infos string, labels_1 string, labels_1_word string", "chnsenticorp_htl": "label string, review string",
        "squad": "title string, context string, id string, question string, answers array<struct<text string, answer_start int>>, impossible boolean",
    }
    for name, shape in SHAPES.items():
        fields = extra.get(name, shape.schema)
        if shape.read == "dictionary":
            fields = "key string, " + fields
        if shape.read == "lists":
            fields = "entries array<struct<sentence: string, labels: array<string>>>"
        rows = spark.createDataFrame([], "file string, line long, j string").select("file", "line", F.from_json("j", fields).alias("row"))
        assert decision_rows(rows, shape, {"labels": ["甲", "乙"], "ids": ["1", "2"]}).count() == 0, name
    assert len(Registry().names()) >= 50


def test_registry(spark):
    registry = Registry()
    with pytest.raises(ValueError):
        registry.register("c3", SHAPES["c3"])
    own = Shape("jsonl", "t string, y boolean", "noul", "t", "'ok?'", "y")
    registry.load({"ADAPTERS": {"own": own}})
    with pytest.raises(ValueError):
        registry.load({"ADAPTERS": {"own": own}})
    with pytest.raises(ValueError):
        registry.load({})
    with pytest.raises(ValueError):
        registry.convert(spark, "nobody", [])


def test_judged_pairs_files(spark, tmp_path):
    paths = {
        "queries": write(tmp_path / "q.tsv", "q1\thow\n"),
        "judgements": write(tmp_path / "j.tsv", "q1 0 p1 3\n"),
        "passages": write(tmp_path / "p.tsv", "p1\tthus\np2\tnever\n"),
    }
    rows = Registry().convert(spark, "t2ranking", paths).collect()
    assert len(rows) == 1 and _label(rows[0]) == "3" and json.loads(rows[0].state) == "how\nthus"


JUDGED = {"queries": "qid\ttext\nq1\thow\nq2\twhy\n", "judgements": "qid\t-\tpid\trel\nq1\t0\tp1\t3\nq1\t0\tp1\t3\nq2\t0\tp2\t0\n", "passages": "pid\ttext\np1\tthus\np2\tso\np3\t \n"}


def _judged(spark, tmp_path, **more):
    return Registry().convert(spark, "t2ranking", {k: write(tmp_path / f"{k}.tsv", v + more.get(k, "")) for k, v in JUDGED.items()})


def test_judged_pairs_accept_headers_and_repeats(spark, tmp_path):
    assert sorted((r.source_id, _label(r)) for r in _judged(spark, tmp_path).collect()) == [("q1:p1", "3"), ("q2:p2", "0")]


@pytest.mark.parametrize(
    "more, message",
    [
        ({"judgements": "q1 0 p2\n"}, "bad judgements.*not four fields"), ({"judgements": "q1 0 p2 4\n"}, "bad judgements.*out of range"), ({"judgements": "qid - pid rel\n"}, "bad judgements"),
        ({"judgements": "q3 0 p1 1\n"}, "judged queries are missing.*q3"), ({"judgements": "q1 0 p9 1\n"}, "judged passages are missing.*p9"), ({"judgements": "q1 0 p1 2\n"}, "two grades for one pair.*p1"),
        ({"queries": "q2\twhy\n"}, "repeated queries.*q2"), ({"passages": "p2\tso\n"}, "repeated passages.*p2"), ({"judgements": "q1 0 p3 1\n"}, "passages without text.*p3"), ({"queries": "q7\n"}, "queries without"),
    ],
)
def test_judged_pairs_stop(spark, tmp_path, more, message):
    with pytest.raises(ValueError, match=message):
        _judged(spark, tmp_path, **more)


RECORD = {"id": "r1", "group": "g1", "type": "noul", "state": {"text": "患者口干。"}, "instruction": "口干？", "criteria": {"false": "否", "true": "是"}, "label": "true"}


def config(**changes):
    source = {"name": "s1", "adapter": "project_jsonl", "paths": ["raw.jsonl"], "split": "train", "url": "local:x", "revision": "v1", "license": "own", "source_family": "f", "task_family": "t", "domain": "d"}
    return {"format_version": 1, "seed": 3, "test_fraction": 0.2, "sources": [source | changes.pop("source", {})]} | changes


@pytest.mark.parametrize(
    "bad, message",
    [
        ({"format_version": 2}, "format_version"), ({"sources": []}, "sources"), ({"source": {"task_family": ""}}, "task_family"), ({"mirror": {"proxy_password": ""}}, "secret"),
        *[({"source": {"paths": [p]}}, "leads out") for p in ("/srv/raw.jsonl", "a/../../raw.jsonl", "sub\\..\\raw.jsonl", "D:raw.jsonl", "\\\\host\\raw.jsonl", "", None)],
        ({"source": {"url": "https://u:p@e.org"}}, "credentials"), ({"test_fraction": 1.0}, "fractions"), ({"prepartitioned": True}, "prepartitioned"), ({"source": {"paths": ["a/x.j", "b/x.j"]}}, "one name"),
    ],
)
def test_bad_builds(bad, message):
    with pytest.raises(ConfigError, match=message):
        check_build(config(**bad))
    check_build(config())


@pytest.mark.parametrize("bad", [{"unknown": 1}, {"batch_size": True}, {"batch_size": 0}, {"overflow": "wrap"}, {"dataset_info": "x"}, {"dataset": None}])
def test_bad_runs(bad):
    with pytest.raises(ConfigError):
        check_run({"dataset": {"train": "x"}} | bad)
    check_run({"dataset": {"train": "x"}, "batch_size": 4})


def test_cache_reuse():
    assert reusable_cache({"head_max_len": 64}, {"head_max_len": 64, "adapter_params": {"a": 1}})
    assert not reusable_cache({"head_max_len": 64, "adapter_params": {}}, {"head_max_len": 64, "adapter_params": {"a": 1}})
    assert not reusable_cache({"head_max_len": 32}, {"head_max_len": 64})


def test_build_and_verify(spark, tmp_path):
    records = [RECORD | {"id": f"r{i}", "group": f"g{i % 7}", "state": {"text": f"患者 {i // 2}"}} for i in range(40)]
    records += [
        RECORD | {"id": "c1", "type": "choice", "criteria": {"A": "甲", "B": "乙"}, "label": "B"},
        RECORD | {"id": "s1", "type": "score", "criteria": ["低", "高"], "label": "1"},
        RECORD | {"id": "bad", "label": "maybe"},
        RECORD | {"id": "conflict", "state": {"text": "患者 0"}, "label": "false"},
    ]
    write(tmp_path / "raw.jsonl", "\n".join(json.dumps(r, ensure_ascii=False) for r in records))
    out = str(tmp_path / "release")
    manifest = P.build_release(spark, config(write_notebooks=True), str(tmp_path), out)
    counts = manifest["counts"]
    assert counts["rejected:s1:label isn't among the criteria"] == 1
    assert counts["conflicting_inputs_excluded"] == 1 and counts["duplicate_inputs"] == 21
    assert sum(n for k, n in counts.items() if k.startswith("output:")) == 21
    report = P.verify_release(spark, out)
    assert report["status"] == "verified" and report["unique_ids"] == 21
    with pytest.raises(FileExistsError):
        P.build_release(spark, config(), str(tmp_path), out)
    again = str(tmp_path / "again")
    assert P.build_release(spark, config(), str(tmp_path), again)["counts"] == counts
    a, b = (sorted(map(str, P.read_cases(spark, x).collect())) for x in (out, again))
    assert a == b
    from caseloom.plans.prepare import length_report

    assert length_report(spark, out, 192)["summary"]["n"] == 21


@pytest.mark.parametrize(
    "adapter, text, place",
    [
        ("project_jsonl", json.dumps(RECORD) + "\n" + json.dumps(RECORD)[:40] + "\n", "raw.jsonl line 2"), ("native", "{}\nnot json\n", "raw.jsonl line 2"), ("tnews", '{"id":"1"}\n{"id":\n', "raw.jsonl line 2"),
        ("tcm_sd", '{"user_id":"1"}\n{"user_id":\n', "raw.jsonl line 2"), ("cail2019_elements", '[]\n[{"sentence":\n', "raw.jsonl line 2"), ("tcm_sd", '[{"user_id":"1"}, {"user_id":', "raw.jsonl"),
        ("cblue_qic", '[{"id":"1","query":"q","label":"x"}, {"id"', "raw.jsonl"), ("imcs21_clinical", '{"d1":{"dialogue":[]},"d2"', "raw.jsonl"), ("finfe", '[["a", "1"], ["b"', "raw.jsonl"), ("jec_qa_each", '{"statement":"s"}\n{"statement":\n', "raw.jsonl line 2"),
    ],
)
def test_broken_files_stop_a_build(spark, tmp_path, adapter, text, place):
    write(tmp_path / "raw.jsonl", text)
    source = {"adapter": adapter, "params": {"labels": ["x", "y"], "ids": ["1", "2"]}}
    with pytest.raises(Exception, match=place + " can't be parsed"):
        P.build_release(spark, config(source=source), str(tmp_path), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_broken_nested_questions_stop(spark, tmp_path):
    with pytest.raises(Exception, match="n.json can't be parsed"):
        R.read_nested_questions(spark, write(tmp_path / "n.json", '{"data":[{"title":"t"')).collect()


def test_repeated_fields_are_audited(spark, tmp_path):
    path = write(tmp_path / "a.json", '\ufeff[{"user_id":"1","chief_complaint":"咳","norm_syndrome":"x"},{"user_id":"2","user_id":"3","chief_complaint":"热","norm_syndrome":"y"}]')
    rows = P.validated(Registry().convert(spark, "tcm_sd", [path], {"labels": ["x", "y"]})).collect()
    assert sorted((r.source_id, r.reason) for r in rows) == [("a.json:1", None), ("a.json:2", "repeated field")]


def test_rows_without_a_group_are_counted(spark, tmp_path):
    """The first copy of an input has no group: its other copy stays."""
    records = [RECORD | {"group": g, "id": f"n{i}", "state": {"text": f"患者 {t}"}} for i, (g, t) in enumerate([(None, 0), ("g1", 0), (" ", 1), ("g2", 2)])]
    write(tmp_path / "raw.jsonl", "\n".join(json.dumps(r, ensure_ascii=False) for r in records))
    counts = P.build_release(spark, config(), str(tmp_path), str(tmp_path / "out"))["counts"]
    assert counts["rejected:s1:no group"] == 2 and counts["converted"] == 2 and counts["duplicate_inputs"] == 0
    assert sorted(r.id for r in P.read_cases(spark, str(tmp_path / "out")).select(F.element_at("_meta", F.lit("source_id")).alias("id")).collect()) == ["n1", "n3"]
    row = ("x", '"s"', json.dumps({"decision": {"type": "noul", "instructions": "i", "criteria": {"false": "n", "true": "y"}}}), json.dumps({"decision": {"type": "noul", "probabilities": {"false": 0, "true": 1}}}), "noul", None, None)
    own = spark.createDataFrame([row], "source_id string, state string, questions string, gold string, qtype string, group_key string, reason string")
    assert [r.reason for r in P.validated(own).collect()] == ["no group"]


def test_leaks_are_found(spark, tmp_path):
    meta = {"source": "s", "source_id": "1", "original_id": "1", "original_split": "train", "source_split": "train", "group_key": "g", "source_family": "f", "task_family": "t", "domain": "d"}
    question = {"decision": {"type": "noul", "instructions": "q", "criteria": {"false": "n", "true": "y"}}}
    gold = {"decision": {"type": "noul", "probabilities": {"false": 0.0, "true": 1.0}}}
    for split in ("train", "calibration", "validation", "test"):
        (tmp_path / split).mkdir()
        line = {"id": f"i-{split}", "state": f"s {split}", "questions": question, "gold": gold, "_meta": meta | {"split": split}}
        write(tmp_path / split / "part-0.txt", json.dumps(line) + "\n" if split in ("train", "test") else "")
    with pytest.raises(ValueError, match="group leakage"):
        P.verify_release(spark, str(tmp_path))


def test_native_cases(spark, tmp_path):
    case = {"id": "x", "state": "文", "questions": {"q1": {"type": "choice", "instructions": "i", "criteria": {"A": None, "B": None}}, "q2": {"type": "noul", "instructions": "i", "criteria": {"false": "n", "true": "y"}}}, "gold": {"q1": {"type": "choice", "probabilities": {"A": 1, "B": 0}}, "q2": {"type": "noul", "probabilities": {"false": 0.5, "true": 0.5}}}, "_meta": {"group_key": "g"}}
    path = write(tmp_path / "n.jsonl", json.dumps(case, ensure_ascii=False) + "\n")
    rows = P.validated(Registry().convert(spark, "native", [path])).collect()
    assert sorted(r.source_id for r in rows) == ["x:q1", "x:q2"] and all(r.reason is None and r.group_key == "g" for r in rows)


def test_command_line(tmp_path, capsys):
    from caseloom.__main__ import main

    assert main(["init", str(tmp_path / "new")]) == 0
    check_build(json.loads((tmp_path / "new" / "config.json").read_text()))
    assert main(["list-adapters"]) == 0
    assert "tnews" in capsys.readouterr().out


def test_streamed_conversion(spark, tmp_path):
    from caseloom.streaming.ingest import stream_conversion, windowed_counts

    schema = "raw_no long, id string, grp string, type string, state struct<text string, question string>, instruction string, criteria string, label string"
    row = (1, "r", "g", "noul", ("t", None), "i", '{"false":"n","true":"y"}', "true")
    spark.createDataFrame([row], schema).write.parquet(str(tmp_path / "in/1"))
    spark.createDataFrame([(2, *row[1:7], "no")], schema).write.parquet(str(tmp_path / "in/2"))
    for _ in range(2):  # a second run converts nothing twice
        stream_conversion(spark, str(tmp_path / "in/*"), schema, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    found = {r.raw_no: r.reason for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {1: None, 2: "label isn't among the criteria"}
    events = spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert windowed_counts(events, "ts", "1 minute", "1 minute", "k").first().n == 2


HOTEL = "label,review\n1,很好\n0,\"差\n极了\"\n1,还行\n"


def _ids(rows):
    return sorted((r.source_id, r.state, r.place.file, r.place.line) for r in rows.collect())


def test_ids_do_not_follow_the_layout(spark, tmp_path):
    """Records are named by their file and their number in it: in any order of files, packed or not."""
    a, b = write(tmp_path / "a.csv", HOTEL), write(tmp_path / "b.csv", "label,review\n0,一般\n")
    one, two = (_ids(Registry().convert(spark, "chnsenticorp_htl", p)) for p in ([a, b], [b, a]))
    assert one == two and [x[0] for x in one] == ["a.csv:1", "a.csv:2", "a.csv:3", "b.csv:1"] and "极了" in one[1][1]
    (tmp_path / "packed").mkdir()
    with gzip.open(tmp_path / "packed/a.csv.gz", "wt") as f:
        f.write(HOTEL)
    assert _ids(Registry().convert(spark, "chnsenticorp_htl", str(tmp_path / "packed/a.csv.gz"))) == one[:3]
    tsv = write(tmp_path / "w.tsv", "内科\t1\tq1\t头疼？\t\"多喝水\n内科\t0\tq1\t头疼？\n内科\t0\tq1\t头疼？\t\t\n")
    rows = sorted((r.source_id, r.reason) for r in Registry().convert(spark, "webmedqa_each", tsv).collect())
    assert rows == [("w.tsv:1:q1", None), ("w.tsv:2", "not 5 fields"), ("w.tsv:3", "not 5 fields")]
    nested = {"data": [{"title": "t", "paragraphs": [{"context": "天晴", "qas": [{"id": "x", "question": "雨？", "answers": [], "is_impossible": True}]}, {"context": "雨", "qas": None}]}, {"title": "u", "paragraphs": [{"context": "风", "qas": [{"id": "y", "question": "风？", "answers": [], "is_impossible": True}]}]}]}
    path = write(tmp_path / "n.json", json.dumps(nested))
    assert [(r.line, r.id) for r in R.read_nested_questions(spark, path).orderBy("line").collect()] == [(1, "x"), (2, "y")]


def test_release_does_not_follow_the_layout(spark, tmp_path):
    """Equal copies in two files, in both orders of files and with one or seven partitions: the same survivors and bytes."""
    lines = [json.dumps({"id": f"r{i}", "group": f"g{i % 5}", "type": "noul", "state": {"text": f"t{i % 9}", "question": None, "slots": None}, "instruction": "Is it?", "criteria": '{"false":"n","true":"y"}', "label": "true"}) for i in range(24)]
    write(tmp_path / "x.jsonl", "\n".join(lines[:13]))
    write(tmp_path / "y.jsonl", "\n".join(lines[13:]))
    source = {"name": "s", "adapter": "project_jsonl", "split": "train", "url": "https://a.example", "revision": "1", "license": "l", "source_family": "f", "task_family": "t", "domain": "d"}
    found = []
    for number, (paths, parts) in enumerate([(["x.jsonl", "y.jsonl"], 1), (["y.jsonl", "x.jsonl"], 7)]):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1g" if parts == 1 else "700")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            P.build_release(spark, {"format_version": 1, "sources": [source | {"paths": paths}]}, str(tmp_path), str(tmp_path / f"out{number}"))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        found.append([r.value for r in spark.read.text(str(tmp_path / f"out{number}/train")).orderBy("value").collect()])
    assert found[0] == found[1] and len(found[0]) == 9


def _convert(spark, tmp_path, name, files, params=None):
    """Decision rows of an adapter over files written for it, in the order of their places."""
    paths = {k: write(tmp_path / f"{k}.{'csv' if v[:2] in ('qu', 'an') else 'txt'}", v) for k, v in files.items()}
    rows = Registry().convert(spark, name, paths, params).collect()
    return sorted(rows, key=lambda r: (r.place.file, r.place.line, list(r.place.at), r.source_id))


def _web(qid, labels, answers, query="头疼？"):
    return "".join(f"内科\t{x}\t{qid}\t{query}\t{a}\n" for x, a in zip(labels, answers))


def test_webmedqa_candidates(spark, tmp_path):
    five = ["多喝水", "休息", "吃药", "复查", "锻炼"]
    text = _web("q1", "10000", five) + _web("q2", "11000", five) + _web("q3", "1000", five[:4]) + _web("q4", "10000", [*five[:4], " 多喝水"]) + _web("q5", "1", five[:1], "甲") + _web("q5", "0000", five[1:])
    rows = _convert(spark, tmp_path, "webmedqa", {"paths": text})
    assert [r.reason for r in rows] == [None, "not one right answer", "not 5 candidates", "repeated candidates", "candidates of different questions"]
    state = json.loads(rows[0].state)
    assert f"{_label(rows[0])}：多喝水" in state and len(rows[0].link_keys) == 6 and rows[0].source_id == "paths.txt:1:q1"
    # The order of candidates doesn't tell the label.
    moved = _convert(spark, tmp_path, "webmedqa", {"paths": _web("q1", "00001", [*five[1:], five[0]])})
    assert moved[0].state == rows[0].state and _label(moved[0]) == _label(rows[0])
    each = _convert(spark, tmp_path, "webmedqa", {"paths": text}, {"mode": "noul", "link_shared_answers": "none"})
    assert [r.reason for r in each[:5]] == [None] * 5 and sorted(_label(r) for r in each[:5]) == ["false"] * 4 + ["true"] and len(each[0].link_keys) == 1
    assert [r.reason for r in each if r.reason == "not 5 candidates"] == ["not 5 candidates"]
    with pytest.raises(ValueError, match="can't be told"):
        _convert(spark, tmp_path, "webmedqa", {"paths": text + "a\tb\n"})
    with pytest.raises(ValueError, match="mode"):
        _convert(spark, tmp_path, "webmedqa", {"paths": text}, {"mode": "both"})


def test_matching_with_tables(spark, tmp_path):
    tables = {"questions": "question_id,content\n1,头疼\n2,发热\n3,\n", "answers": "ans_id,question_id,content\n10,1,多喝水\n11,1,休息\n"}
    triples = "question_id,pos_ans_id,neg_ans_id\n1,10,11\n1,10,12\n2,10,10\n3,10,11\n4,11,10\n"
    rows = _convert(spark, tmp_path, "cmedqa2", {"paths": triples} | tables)
    found = {r.source_id.split(":", 2)[2]: (r.reason, _label(r)) for r in rows if r.reason is None}
    assert found["1:10"] == (None, "true") and found["1:11"] == (None, "false")
    reasons = [r.reason for r in rows]
    assert reasons.count("answer is missing") == 1 and reasons.count("candidate of two labels") == 1 and reasons.count("question is missing") == 4
    labelled = _convert(spark, tmp_path, "cmedqa2", {"paths": "question_id,ans_id,cnt,label\n1,10,1,1\n1,11,2,0\n1,11,2,0\n2,11,1,7\n"} | tables)
    assert [(r.reason, r.reason or _label(r)) for r in labelled] == [(None, "true"), (None, "false"), ("no label", "no label")]
    with pytest.raises(ValueError, match="come again"):
        _convert(spark, tmp_path, "cmedqa2", {"paths": "question_id,ans_id,label\n1,10,1\n2,10,1\n1,11,0\n"} | tables)
    with pytest.raises(ValueError, match="repeated answers"):
        _convert(spark, tmp_path, "cmedqa2", {"paths": triples} | tables | {"answers": tables["answers"] + "10,1,x\n"})
    with pytest.raises(ValueError, match="auxiliary files"):
        _convert(spark, tmp_path, "cmedqa2", {"paths": triples})


def test_terms_held_against_the_gold(spark, tmp_path):
    gold = json.dumps([{"text": "左肾囊肿", "normalized_result": "肾囊肿##囊肿"}, {"text": "\"热\"", "normalized_result": "发热"}], ensure_ascii=False)
    head = "text_a\ttext_b\tlabel\n"
    text = head + '左肾囊肿\t肾囊肿\t1\n左肾囊肿\t囊肿\t0\n"热"\t发热\t1\n无\t发热\t1\n"热"\t发热\tx\n左肾囊肿\t发热\t0\n'
    rows = _convert(spark, tmp_path, "cdn_retrieved_pairs", {"paths": text, "original_gold": gold})
    assert [r.reason for r in rows] == [None, "label contradicts the gold", None, *["no gold diagnosis or label"] * 2, None] and [_label(r) for r in (rows[0], rows[2], rows[5])] == ["true", "true", "false"]
    for more, params, message in ((text[len(head) :], {}, "columns"), (text, {"original_split": "test"}, "hidden")):
        with pytest.raises(ValueError, match=message):
            _convert(spark, tmp_path, "cdn_retrieved_pairs", {"paths": more, "original_gold": gold}, params)


def test_documents_out_of_their_prompts(spark, tmp_path):
    templates = json.dumps({"CHIP-MDCFNPC": ["对话：[INPUT_TEXT]\\\\n状态选自[LIST_LABELS]。\\\\n答：", "[INPUT_TEXT]\\n请标注"], "CMedCausal": ["读：[INPUT_TEXT]"]}, ensure_ascii=False)
    record = {"task_dataset": "CHIP-MDCFNPC", "answer_choices": ["阳性", "阴性", "其他", "不标注"], "sample_id": "1"}
    target = "头疼：阳性\n发热：阴性\n发热：阳性\n咳嗽：阳性\n无\n头疼：阳性"
    records = [record | {"input": "对话：头疼，不发热。\n状态选自阳性、阴性。", "target": target}, record | {"input": "别的", "target": target}, record | {"task_dataset": "x", "input": "对话：头疼。", "target": target}]
    rows = _convert(spark, tmp_path, "alternatecd_mdcf", {"paths": json.dumps(records, ensure_ascii=False), "templates": templates})
    assert [r.reason for r in rows] == [None, *["finding of several states"] * 2, "finding isn't in the dialogue", "no finding and state", "no template fits the prompt", "another task"]
    assert json.loads(rows[0].state) == "头疼，不发热。" and _label(rows[0]) == "A"
    causal = [CAUSAL | {"input": "读：" + CAUSAL["input"], "target": "着凉，咳嗽：因果关系"}]
    rows = _convert(spark, tmp_path, "alternatecd_causal_pair", {"paths": json.dumps(causal, ensure_ascii=False), "templates": templates})
    assert [r.reason for r in rows] == [None] and json.loads(rows[0].state) == CAUSAL["input"]


def test_sessions_that_continue(spark, tmp_path):
    say = lambda who, words, **k: {"speaker": who, "content": words} | k
    session = lambda i, *turns, **k: {"dialog_id": i, "dialog": list(turns)} | k
    sessions = [
        session("a", say("Supporter", "你好", strategy=["x"]), is_same_session=1),
        session("b", say("Seeker", "难过", **{"emotional label": ["sad"]}), say("Supporter", "嗯", strategy=["x", "z"])),
        session("c"),
        session("d", say("Supporter", "再见", strategy=["y"]), say("Other", "?"), is_same_qa=1),
    ]
    rows = _convert(spark, tmp_path, "psy_insight_cn", {"paths": json.dumps(sessions, ensure_ascii=False)}, {"labels": ["x", "y"], "emotions": ["glad", "sad", "calm"]})
    by = {}
    for r in rows:
        by.setdefault(r.place.line, []).append(r)
    assert [r.reason for r in by[1]] == ["continues nothing"] and [r.reason for r in by[3]] == ["no dialogue"]
    assert [(r.reason, _label(r)) for r in by[2][:3]] == [(None, x) for x in ("false", "true", "false")] and {r.reason for r in by[2][3:]} == {"label outside the vocabulary"}
    good = [r for r in by[4] if r.reason is None]
    assert [_label(r) for r in good] == ["false", "true"] and by[2][0].group_key in good[0].link_keys and {r.reason for r in by[4]} == {None, "unknown speaker"}


def test_review_rows(spark, tmp_path):
    answer = lambda at, text: {"text": text, "answer_start": at}
    asked = [{"id": "x", "question": "天气？", "answers": [answer(2, "晴")], "is_impossible": False}, {"id": "y", "question": "谁？", "answers": [answer(0, "晴")], "is_impossible": False}, {"id": "z", "question": "何时？", "answers": [], "is_impossible": True}]
    text = json.dumps({"data": [{"title": "t", "paragraphs": [{"context": "今天晴", "qas": asked}]}]}, ensure_ascii=False)
    rows = _convert(spark, tmp_path, "squad", {"paths": text})
    assert [(r.reason, r.review is not None) for r in rows] == [("needs review", True), ("answer isn't at its place", False), ("needs review", True)]
    assert json.loads(rows[0].review)["reference_answers"][0]["text"] == "晴"
    rows = _convert(spark, tmp_path, "squad", {"paths": text}, {"mode": "answerability"})
    assert [(r.reason, r.reason or _label(r)) for r in rows] == [(None, "true"), ("answer isn't at its place",) * 2, (None, "false")]
    write(tmp_path / "raw.jsonl", json.dumps(RECORD))
    base = config()
    review = base["sources"][0] | {"name": "q", "adapter": "squad", "paths": ["paths.txt"]}
    counts = P.build_release(spark, base | {"sources": [*base["sources"], review]}, str(tmp_path), str(tmp_path / "out"))["counts"]
    assert counts["review:q"] == 2 and counts["rejected:q:answer isn't at its place"] == 1
    kept = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/review")).collect()]
    assert {k["source"] for k in kept} == {"q"} and all(k["group_key"] for k in kept)


def test_symptoms_of_turns(spark, tmp_path):
    turn = lambda words, names, states: {"speaker": "医", "sentence": words, "dialogue_act": "问", "symptom_norm": names, "symptom_type": states}
    text = json.dumps({"d1": {"dialogue": [turn("发热吗", ["发热"], ["2"]), turn("咳", ["咳嗽", "发热", "咳嗽"], ["1", "0", "1"]), turn("痛", ["痛"], []), turn("热", ["热", "热"], ["0", "1"]), turn("x", ["x"], ["9"]), turn("好", [], [])]}}, ensure_ascii=False)
    rows = [r for r in _convert(spark, tmp_path, "imcs21_clinical", {"paths": text}, {"labels": ["问", "答"]}) if ":symptom" in r.source_id]
    assert [(r.reason, r.reason or _label(r)) for r in rows] == [(None, "C"), (None, "B"), (None, "A"), *[("names and states of symptoms differ",) * 2], *[("symptom of two states",) * 2] * 2, *[("unknown state",) * 2]]


def test_published_partition_of_a_corpus(spark, tmp_path):
    talk = lambda i: {"dialogue": str(i), "information": [{"role": "医", "sentence": f"句{i}", "actions": [{"intent": "问"}]}]}
    text = json.dumps([talk(i) for i in range(10)], ensure_ascii=False)
    sizes, seen = {"train": 6, "dev": 1, "test": 3}, []
    for split, n in sizes.items():
        rows = _convert(spark, tmp_path, "remedi_human", {"paths": text}, {"original_split": split, "partition_sizes": sizes, "labels": ["问", "答"]})
        assert len({r.group_key for r in rows}) == n
        seen += {r.group_key for r in rows}
    assert len(set(seen)) == 10
    with pytest.raises(ValueError, match="1557"):
        _convert(spark, tmp_path, "remedi_human", {"paths": text}, {"original_split": "train", "labels": ["问"]})


def test_second_modes(spark, tmp_path):
    fact = lambda x, *a: json.dumps({"fact": x, "meta": {"accusation": list(a), "relevant_articles": [264]}}, ensure_ascii=False)
    text = fact("偷", "盗窃") + "\n" + fact("偷抢", "盗窃", "抢劫") + "\n" + fact("打", "伤害") + "\n"
    labels = {"labels": ["盗窃", "抢劫"]}
    rows = _convert(spark, tmp_path, "cail2018", {"paths": text}, labels | {"mode": "single_choice"})
    assert [r.reason for r in rows] == [None, "several labels", "label outside the vocabulary"] and _label(rows[0]) == "A"
    assert [_label(r) for r in _convert(spark, tmp_path, "cail2018", {"paths": text}, labels)[:4]] == ["true", "false", "true", "true"]
    articles = _convert(spark, tmp_path, "cail2018", {"paths": text}, {"labels": ["264", "263"], "task": "articles"})
    assert [_label(r) for r in articles[:2]] == ["true", "false"]
    with pytest.raises(ValueError, match="decimal"):
        _convert(spark, tmp_path, "cail2018", {"paths": text}, labels | {"task": "articles"})
    news = "".join(json.dumps({"id": str(i), "sentence": f"题{i}", "label": x, "label_desc": d}) + "\n" for i, (x, d) in enumerate([("103", "sports"), ("100", "story"), ("100", "sports"), ("9", "x")]))
    both = _convert(spark, tmp_path, "tnews", {"paths": news}, {"ids": ["100", "103"], "labels": ["story", "sports"], "mode": "both"})
    assert [r.reason or _label(r) for r in both if r.qtype == "noul"] == ["true", "false", "number and word of the label differ", "number and word of the label differ"]
    assert [r.reason or _label(r) for r in both if r.qtype == "choice"][:2] == ["B", "A"]
    yes = "".join(json.dumps({"question": "行？", "answer": f"答{i}", "yesno_answer": a}) + "\n" for i, a in enumerate(("Yes", "Depends")))
    three = _convert(spark, tmp_path, "dureader_yesno", {"paths": yes}, {"mode": "both"})
    assert [(r.qtype, r.reason or _label(r)) for r in sorted(three, key=lambda r: r.source_id)] == [("choice", "A"), ("noul", "true"), ("choice", "C"), ("noul", "depends or unlabelled")]


def test_vocabularies(spark, tmp_path):
    assert R.read_vocabulary(spark, write(tmp_path / "a.json", '{"乙": 1, "甲": 0}')) == ["甲", "乙"]
    assert R.read_vocabulary(spark, write(tmp_path / "b.json", '{"甲": "one", "乙": "two"}')) == ["甲", "乙"]
    assert R.read_vocabulary(spark, write(tmp_path / "c.json", '["甲", "乙"]')) == R.read_vocabulary(spark, write(tmp_path / "c.txt", "甲\n乙\n\n")) == ["甲", "乙"]
    for text in ('{"甲": 0, "乙": 2}', '{"甲": "x", "乙": "x"}', '["甲", "甲"]', '["甲", " "]', '{"甲": 0, "甲": 1}'):
        with pytest.raises(ValueError):
            R.read_vocabulary(spark, write(tmp_path / "d.json", text))
    with pytest.raises(ValueError, match="44 labels"):
        Registry().convert(spark, "cblue_ctc", {"paths": write(tmp_path / "e.json", "[]"), "labels": str(tmp_path / "a.json")})
    rows = Registry().convert(spark, "cblue_qic", {"paths": write(tmp_path / "f.json", '[{"id":"1","query":"q","label":"乙"},{"id":"2","query":"r","label":"甲"}]'), "labels": str(tmp_path / "a.json")}, {"limit": 1}).collect()
    assert [(r.source_id, _label(r)) for r in rows] == [("f.json:1", "B")]


def test_pairs_of_several_relations(spark):
    spo = lambda s, p, o: {"subject": s, "predicate": p, "object": {"@value": o}}
    labels = {"labels": ["因", "果"]}
    rows = _rows(spark, "cmeie_typing", {"text": "甲乙丙", "spo_list": [spo("甲", "因", "乙"), spo("甲", "因", "乙"), spo("甲", "果", "丙"), spo("甲", "因", "丙"), spo("乙", "无", "丙")]}, labels)
    assert sorted((r.reason or _label(r)) for r in rows) == ["A", "pair of several relations", "relation outside the schema"]
    assert [r.reason for r in _rows(spark, "cmeie_typing", {"text": "甲乙", "spo_list": [spo("甲", "因", "乙"), spo("甲", "果", "丙")]}, labels)] == ["entity isn't in the text"] * 2
    rows = _rows(spark, "text2dt_typing", {"text": "甲乙丙", "tree": [{"triples": [["甲", "因", "乙"], ["甲", "果", "丙"]]}, {"triples": [["甲", "因", "丙"]]}]}, labels)
    assert [r.reason or _label(r) for r in rows] == ["pair of several relations", "A"]
    turn = {"id": "1", "Sentence": "s", "Symptom": ["热", "热"], "Medicine": [], "Examination": [], "Attribute": [], "Disease": ["痛"]}
    assert [r.reason for r in _rows(spark, "meddg_entity_type", turn)] == [None] * 2
    assert {r.reason for r in _rows(spark, "meddg_entity_type", turn | {"Medicine": ["热"]})} == {"entity of two types in the turn"}
    spans = [{"start": 0, "end": 9, "type": "x"}, {"start": 0, "end": 1, "type": "w"}, {"start": 0, "end": 1, "type": "x"}]
    rows = _rows(spark, "psyqa_strategy", {"question": "q", "description": "d", "answers": [{"has_label": True, "answer_text": "abcd", "labels_sequence": spans}, {"has_label": False, "answer_text": "e"}]}, {"labels": ["x", "y"]})
    assert [r.reason for r in rows] == ["span out of the answer", "unknown strategy", None, "answer without strategies"]


def test_verification_holds_files_against_the_manifest(spark, tmp_path):
    write(tmp_path / "raw.jsonl", "\n".join(json.dumps(RECORD | {"id": f"r{i}", "group": f"g{i}", "state": {"text": f"患者 {i}"}}, ensure_ascii=False) for i in range(12)))
    out = tmp_path / "release"
    P.build_release(spark, config(), str(tmp_path), str(out))
    report = P.verify_release(spark, str(out))
    assert json.loads((out / "verification.json").read_text()) == report
    counts = report["counts"]
    assert sum(n for k, n in counts.items() if k.startswith("split:")) == 12 == sum(n for k, n in counts.items() if k.startswith("type:"))
    assert {k.split(":")[0] for k in counts} == {"split", "type", "source", "task"} and all(k.endswith((":noul", ":f", ":t")) for k in counts if not k.startswith("split:"))
    manifest = json.loads((out / "manifest.json").read_text())
    manifest["files"][0]["sha256"] = "0" * 64
    (out / ".manifest.json.crc").unlink(missing_ok=True)
    (out / "manifest.json").write_text(json.dumps(manifest))
    with pytest.raises(ValueError, match="aren't those of the manifest"):
        P.verify_release(spark, str(out))


def test_prepared_runs(spark, tmp_path):
    from caseloom.plans.prepare import calibration, evaluation_report, prepare

    write(tmp_path / "raw.jsonl", "\n".join(json.dumps(RECORD | {"id": f"r{i}", "group": f"g{i}", "state": {"text": f"患者 {i}"}}, ensure_ascii=False) for i in range(9)))
    P.build_release(spark, config(), str(tmp_path), str(tmp_path / "release"))
    run = {"dataset": {"releases": str(tmp_path / "release")}, "head_max_len": 64}
    made = prepare(spark, run, str(tmp_path / "items"))
    assert sum(made["items"].values()) == 9 and made["config"] == {"head_max_len": 64, "max_len": made["config"]["max_len"]} and made["config"]["max_len"] > 0
    assert prepare(spark, run, str(tmp_path / "items")) == made  # used again
    with pytest.raises(FileExistsError):
        prepare(spark, run | {"head_max_len": 80}, str(tmp_path / "items"))
    rows = [(s, "choice", [3.0 * (i % 2), 1.0], [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(60) for s in ("calibration", "test")]
    predictions = spark.createDataFrame(rows, "split string, qtype string, logits array<double>, target array<double>")
    found = calibration(predictions)
    assert found["items"] == {"choice": 60} and calibration(predictions, most=30)["items"] == {"choice": 30}
    assert evaluation_report(predictions, temperatures=found["temperatures"])["temperatures"] == found["temperatures"]


def test_first_lines_of_a_split(spark, tmp_path):
    with gzip.open(tmp_path / "train.cases.jsonl.gz", "wt") as f:
        f.write("a\n\nb\nc\n")
    assert [r.value for r in R.read_split(spark, str(tmp_path), "train", limit=2).orderBy("line").collect()] == ["a", "b"]
    write(tmp_path / "train.txt", "x\ny\n")
    assert R.read_split(spark, str(tmp_path), "train", "{split}.txt").count() == 2
    with pytest.raises(FileNotFoundError):
        R.read_split(spark, str(tmp_path), "test")


def test_settings_on_the_command_line():
    from caseloom.__main__ import _setting

    assert [_setting(x) for x in ("a=1", "b=x=y", 'c=["z"]', "d=null")] == [("a", 1), ("b", "x=y"), ("c", ["z"]), ("d", None)]
    with pytest.raises(SystemExit):
        _setting("a")


TWO = {"A": "甲", "B": "乙"}
#: Shape, parameters, and records with what comes of them: the labels of their rows, or the reason.
RECORDS = [
    ("cblue_qqr", {}, [({"query1": "a", "query2": "b", "label": "1"}, ["B"]), ({"query1": "a", "query2": "b", "label": "3"}, ["answer out of range"]), ({"query1": " ", "query2": None, "label": "1"}, ["blank state"])]),
    ("cblue_ctc", {"labels": ["x", "y"]}, [({"text": "t", "label": "y"}, ["B"]), ({"text": "t", "label": "z"}, ["answer out of range"])]),
    ("cmid_coarse", {"labels": ["病症", "药物"]}, [({"originalText": "t", "label_4class": ["'药物'"]}, ["B"]), ({"originalText": "t", "label_4class": ["药物", "病症"]}, ["not one label"])]),
    ("explain_cpe", {}, [({"question": "q", "options": TWO, "answer": "B"}, ["B"]), ({"question": "如图，q", "options": TWO, "answer": "B"}, ["needs a picture"]), ({"question": "q", "options": TWO, "answer": "AB"}, ["no single answer"])]),
    ("cmb_exam", {}, [({"question": "q", "option": TWO, "answer": "A"}, ["A"]), ({"question": "q", "option": TWO, "answer": "AB"}, ["several answers"])]),
    ("tcm_sd", {"labels": ["气虚", "血瘀"]}, [({"user_id": "1", "chief_complaint": "c", "description": " ", "norm_syndrome": "血瘀"}, ["B"]), ({"user_id": "1", "chief_complaint": "", "norm_syndrome": "血瘀"}, ["blank state"]), ({"user_id": "", "chief_complaint": "c", "norm_syndrome": "血瘀"}, ["no group"])]),
    ("dialmed_recorded", {"labels": ["a", "b", "c"]}, [({"dialog": ["问", "答"], "label": ["c", "a"]}, ["true", "false", "true"]), ({"dialog": ["问"], "label": ["z"]}, ["label outside the vocabulary"] * 3)]),
    ("medical_ds_disease", {"labels": ["感冒", "胃炎"]}, [({"disease_tag": "胃炎", "goal": {"explicit_inform_slots": {"吐": "1"}, "implicit_inform_slots": {"痛": "0"}}}, ["B"]), ({"disease_tag": "胃炎", "goal": {"explicit_inform_slots": {"吐": "1"}, "implicit_inform_slots": {"吐": "1"}}}, ["B"]), ({"disease_tag": "胃炎", "goal": {"explicit_inform_slots": {"吐": "1"}, "implicit_inform_slots": {"吐": "0"}}}, ["slots contradict"]), ({"disease_tag": "x", "goal": {"explicit_inform_slots": {"吐": "1"}, "implicit_inform_slots": {"痛": "0"}}}, ["answer out of range"])]),
    ("jec_qa", {}, [({"statement": "s", "option_list": TWO, "answer": ["B"]}, ["B"]), ({"statement": "s", "option_list": TWO, "answer": ["A", "B"]}, ["several answers"])]),
    ("jec_qa_each", {}, [({"statement": "s", "option_list": TWO | {"C": "丙"}, "answer": ["A", "C"]}, ["true", "false", "true"]), ({"statement": "s", "option_list": TWO, "answer": []}, ["no answer"] * 2)]),
    ("cail2019_scm", {}, [({"A": "a", "B": "b", "C": "c", "label": "C"}, ["B"]), ({"A": "a", "B": "b", "C": "a", "label": "C"}, ["equal texts"]), ({"A": "a", "B": "b", "C": "c", "label": "D"}, ["answer out of range"])]),
    ("lcr_cn", {"labels": ["x", "y"]}, [({"content": "c", "title": "t", "high_level_laws": ["h"], "conflict_type": "y", "url": "https://Example.org/a?id=3&p=1"}, ["B"]), ({"content": "c", "title": "t", "high_level_laws": [], "conflict_type": "z", "url": "https://example.org/a"}, ["answer out of range"])]),
    ("dureader_yesno", {}, [({"question": "q", "answer": "a", "yesno_answer": "No"}, ["false"]), ({"question": "q", "answer": "a", "yesno_answer": "Depends"}, ["depends or unlabelled"])]),
    ("webmedqa_each", {}, [({"query": "q", "answer": "a", "label": "0", "question_id": "1"}, ["false"]), ({"query": "q", "answer": "a", "label": "2", "question_id": "1"}, ["no label"])]),
    ("remedi_human", {"labels": ["问", "答"]}, [({"dialogue": "1", "information": [{"role": "医", "sentence": "s", "actions": [{"intent": "答"}]}]}, ["false", "true"])]),
    ("cmb_exam_each", {}, [({"question": "q", "option": TWO, "answer": "x"}, ["no answer letters"] * 2)]),
]
READ = [
    ("c3", "array", [["d1", [{"question": "q", "choice": ["x", "y"], "answer": "y"}, {"question": "q", "choice": ["x", "x"], "answer": "x"}], "1"]], {}, None),
    ("exam_csv", "csv", "question,A,B,C,D,answer\nq,1,2,3,4,C\nq,1,2,3,4,E\n", {}, ["C", "no single answer"]),
    ("cmexam", "csv", 'question,options,answer\nq,"A 甲\nB 乙",B\nq,"A 甲\nB 乙",AB\n', {}, ["B", "no single answer"]),
    ("lcmdc_triage", "csv", "titles,infos,labels_1,labels_1_word\nt,i,1,骨科\nt,i,0,骨科\nt,i,9,骨科\n", {"labels": ["内科", "骨科"]}, ["B", "number and word of the label differ", "number and word of the label differ"]),
    ("chnsenticorp_htl", "csv", "label,review\n1,好\n2,差\n", {}, ["true", "no label"]),
    ("finfe", "array", [["好", "2"], ["差", "true"]], {}, ["C", "answer out of range"]),
    ("finnsp", "array", [["1", "t", "c", "e", "1"], ["id", "title", "content", "entity", "negative"]], {}, ["true", "header within the data"]),
    ("dureader_three_way", "jsonl", '{"question": "q", "answer": "a", "yesno_answer": "Depends"}\n', {}, ["C"]),
]


@pytest.mark.parametrize("name, params, records", RECORDS, ids=[r[0] for r in RECORDS])
def test_records_of_every_shape(spark, name, params, records):
    for record, expected in records:
        assert [r.reason or _label(r) for r in _rows(spark, name, record, dict(params))] == expected, record


@pytest.mark.parametrize("name, kind, content, params, expected", READ, ids=[r[0] for r in READ])
def test_files_of_every_shape(spark, tmp_path, name, kind, content, params, expected):
    if name == "c3":
        content = [[["文", "章"], content[0][1], "1"]]
        expected = ["B", "answer isn't one option"]
    text = content if isinstance(content, str) else json.dumps(content, ensure_ascii=False)
    rows = Registry().convert(spark, name, write(tmp_path / f"f.{kind}", text), params).collect()
    assert [r.reason or _label(r) for r in sorted(rows, key=lambda r: (r.place.line, list(r.place.at)))] == expected


def test_every_adapter_has_records():
    here = open(__file__, encoding="utf-8").read()
    assert [n for n in Registry().names() if f'"{n}"' not in here.replace('"c3": "parts', "")] == []
