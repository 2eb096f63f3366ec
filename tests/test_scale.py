"""Hot keys, layouts and the remaining helpers."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import batches as B
from caseloom.operators import cases as C
from caseloom.operators import components as G
from caseloom.operators import joins as J
from caseloom.operators import scoring as S
from caseloom.plans import shared
from caseloom.plans.prepare import dataset_descriptor, evaluation_report, read_items, tokenizer_fingerprint, write_items


@pytest.fixture
def eager_salts(monkeypatch):
    """Keys with more than three rows count as hot."""
    monkeypatch.setattr(shared.hot_keys, "__defaults__", (None, 3, 512))
    monkeypatch.setattr(shared.heaviest, "__defaults__", (3, 512))


def test_hot_keys_are_bounded(spark):
    df = spark.createDataFrame([(k,) for k in [1] * 9 + [2] * 5 + [3] * 4 + [None] * 20 + [4]], "k int")
    assert [r.k for r in shared.hot_keys(df, "k", least=3)] == [1, 2, 3]
    assert [r.k for r in shared.hot_keys(df, "k", least=3, most=2)] == [1, 2]
    assert shared.hot_keys(df, "k", rows=3, least=3) == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup_is_a_join(spark, eager_salts, how):
    rng = random.Random(2)
    facts = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, 9, None]), i) for i in range(300)], "k int, i int")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k int, v string")
    hot = shared.hot_keys(facts, "k")
    assert len(hot) == 4
    found = shared.salted_lookup(facts, table, "k", hot, F.col("i"), how)
    expected = facts.join(table, "k", how)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found.select("k", "i", "v").collect()), key=key) == sorted(map(tuple, expected.select("k", "i", "v").collect()), key=key)


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_under_skew(spark, eager_salts, monkeypatch, few):
    """One anchor holds a third of all groups; with and without the finishing task."""
    monkeypatch.setattr(G, "FEW_EDGES", few)
    members = [(f"n{i:03d}", "hot") for i in range(60)] + [(f"n{i:03d}", f"a{i // 3}") for i in range(180)] + [(f"n{i:03d}", f"b{i // 4}") for i in range(100, 180)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    by = {}
    for g, a in members:
        by.setdefault(a, []).append(g)
    for gs in by.values():
        for g in gs:
            a, b = sorted((root(g), root(gs[0])))
            parent[b] = a
    found = {r.grp: r.root for r in G.connected_groups(spark.createDataFrame(members, "grp string, anchor string"), shared.Scratch(spark, "t")).collect()}
    assert found == {g: root(g) for g, _ in members}


def test_large_components_have_a_name(spark, monkeypatch):
    roots = spark.createDataFrame([(f"g{i}", "g0") for i in range(5)] + [("x", "x")], "grp string, root string")
    exact = {r.root: r.component for r in G.component_names(roots).collect()}
    monkeypatch.setattr(G, "NAMED_BY_ALL", 3)
    by_count = {r.root: (r.component, r.groups) for r in G.component_names(roots).collect()}
    assert by_count["x"] == (exact["x"], 1) and by_count["g0"][0] != exact["g0"] and by_count["g0"][1] == 5


def test_scratch_tables(spark):
    scratch = shared.Scratch(spark, "t")
    kept = scratch.keep(spark.range(3).toDF("x"), "a")
    assert kept.count() == 3
    scratch.keep(spark.range(3).toDF("x"), "b")
    scratch.drop("b")
    scratch.close()
    with pytest.raises(Exception):
        spark.read.parquet(f"{scratch.root}/a").count()


def test_shared_folder_is_read_from_the_session(spark):
    class Named:
        """A session whose cluster names a folder."""

        class conf:
            get = staticmethod(lambda key, default: "file:///shared/folder/" if key == "spark.checkpoint.dir" else default)

    assert shared.shared_folder(Named()) == "file:///shared/folder"
    assert shared.shared_folder(spark) == shared.shared_folder(spark)


def test_matched_answers(spark):
    questions = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x"), (5, None)], "id int, kind string")
    answers = spark.createDataFrame([(1, "A", "x"), (1, "A", "x"), (2, "A", "x"), (2, "B", "x"), (3, "A", "y"), (5, "C", None)], "id int, answer string, kind string")
    found = {r.id: (r.answer, r.reason) for r in J.matched_answers(questions, answers, "id", "answer", ["kind"]).collect()}
    assert found == {1: ("A", None), 2: ("A", "answers contradict"), 3: ("A", "fields differ"), 4: (None, "no answer"), 5: ("C", None)}


def test_published_partition():
    found = B.published_partition({"train": 657, "validation": 100, "test": 800}, 5)
    order = list(range(1557))
    random.Random(5).shuffle(order)
    assert len(found) == 1557 and all(found[i] == "train" for i in order[:657]) and found[order[-1]] == "test"


def test_normalized_criteria(spark):
    df = spark.createDataFrame([("choice", '["a","b"]'), ("noul", '{"True":"y","FALSE":null}'), ("score", '["a","b"]'), ("choice", '{"A":"x"}')], "kind string, c string")
    assert [r[0] for r in df.select(C.normalized_criteria(F.col("kind"), F.col("c"))).collect()] == ['{"a":null,"b":null}', '{"true":"y","false":null}', '["a","b"]', '{"A":"x"}']


def test_collected_logits(spark):
    items = spark.createDataFrame([(f"i{k}", "q", list(range(k % 7 + 1)), [0] * (k % 3 + 1)) for k in range(50)], "id string, question_id string, ids array<int>, markers array<int>")
    load = lambda: lambda ids, markers: [[float(len(i))] * len(m) for i, m in zip(ids, markers)]
    found = {r.id: r.logits for r in S.collected_logits(items, load, 8).collect()}
    assert found == {f"i{k}": [float(k % 7 + 1)] * (k % 3 + 1) for k in range(50)}


def test_item_tables(spark, tmp_path):
    from caseloom.operators.compiling import character_tokens

    question = '{"decision":{"type":"noul","instructions":"q","criteria":{"false":"n","true":"y"}}}'
    gold = '{"decision":{"type":"noul","probabilities":{"false":0.25,"true":0.75}}}'
    cases = spark.createDataFrame([(f"c{i}", '"' + "s" * i + '"', question, gold, "train") for i in range(1, 200)], "id string, state string, questions string, gold string, file_split string")
    write_items(cases, character_tokens(), 64, str(tmp_path / "t"))
    assert read_items(spark, str(tmp_path / "t"), 10_000).count() == 199
    short = read_items(spark, str(tmp_path / "t"), 100)
    assert 0 < short.count() < 199 and "PushedFilters: [IsNotNull" in short._jdf.queryExecution().toString()
    assert read_items(spark, str(tmp_path / "t"), 100, whole_state=False).count() == 199
    told = dataset_descriptor(spark, str(tmp_path / "t"), {"max_len": None, "seed": 4}, tokenizer_fingerprint({"a": 1}, {"pad": 0}))
    assert told["items"] == {"train:2:2": 199} and told["config"] == {"max_len": 1024, "seed": 4} and told["longest_state"] == 199


def test_evaluation_report(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        k = rng.randrange(3)
        gold = k if rng.random() < 0.8 else rng.randrange(3)
        rows.append((rng.choice(["calibration", "test"]), rng.choice(["choice", "score"]), [5.0 * (j == k) for j in range(3)], [float(j == gold) for j in range(3)]))
    df = spark.createDataFrame(rows, "split string, qtype string, logits array<double>, target array<double>")
    report = evaluation_report(df)
    assert set(report["temperatures"]) == {"choice", "score"} and set(report["splits"]) == {"test"}
    test = report["splits"]["test"]
    assert test["items"] == sum(r[0] == "test" for r in rows) == sum(x["items"] for x in test["by_type"].values())
    assert abs(test["accuracy"] - 0.87) < 0.1 and test["ece"] < 0.12
