"""Validation, merge, joins, ordered rows, lengths, layouts, batches and scores on small tables."""

import hashlib
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from caseloom.operators import batches as B
from caseloom.operators import cases as C
from caseloom.operators import compiling as T
from caseloom.operators import joins as J
from caseloom.operators import lengths as L
from caseloom.operators import merge as M
from caseloom.operators import scoring as S
from caseloom.operators import sequences as W
from caseloom.operators import validation as V
from caseloom.operators.components import connected_groups
from caseloom.plans.shared import Scratch


def case(no, question, probabilities, state='"s"', kind=None):
    gold = {"decision": {"type": kind or question.get("type"), "probabilities": probabilities}}
    return (no, state, json.dumps({"decision": question}, ensure_ascii=False), json.dumps(gold))


CHOICE = {"type": "choice", "instructions": "pick", "criteria": {"B": "x", "A": None}}
SCORE = {"type": "score", "instructions": "rate", "criteria": ["low", "mid", "high"]}
NOUL = {"type": "noul", "instructions": "true?", "criteria": {"true": "y", "false": "n"}}
CASES = [
    (case(1, CHOICE, {"A": 0.2, "B": 0.8}), None, [0.8, 0.2]),
    (case(2, SCORE, {"2": 0.1, "0": 0.2, "1": 0.7}), None, [0.2, 0.7, 0.1]),
    (case(3, NOUL, {"true": 0.2, "false": 0.8}), None, [0.8, 0.2]),
    (case(4, CHOICE | {"criteria": {"A": "x"}}, {"A": 1}), "choice needs two options", None),
    (case(5, CHOICE | {"criteria": {"A": "x", "B": "x"}}, {"A": 1, "B": 0}), "equal option descriptions", None),
    (case(6, CHOICE | {"criteria": {"A": "x", " ": "y"}}, {"A": 1, " ": 0}), "blank option key", None),
    (case(7, SCORE | {"criteria": ["a", "a"]}, {"0": 1, "1": 0}), "equal levels", None),
    (case(8, SCORE | {"criteria": ["a", " "]}, {"0": 1, "1": 0}), "blank level", None),
    (case(9, NOUL | {"criteria": {"true": "y", "no": "n"}}, {"true": 1, "false": 0}), "binary decision needs false and true", None),
    (case(10, NOUL | {"instructions": " "}, {"true": 1, "false": 0}), "blank instructions", None),
    (case(11, NOUL | {"type": "other"}, {"true": 1, "false": 0}), "unknown kind of decision", None),
    (case(12, NOUL, {"true": 1}), "probabilities of other keys", None),
    (case(13, NOUL, {"true": 0.7, "false": 0.7}), "no distribution", None),
    (case(14, NOUL, {"true": True, "false": 0}), "no distribution", None),
    (case(15, NOUL, {"true": 1, "false": 0}, kind="choice"), "gold of another kind", None),
    (case(16, NOUL, {"true": 1, "false": 0}, state='""'), "empty state", None),
    (case(17, NOUL, {"true": 1, "false": 0}, state="5"), "state is no text, object or list", None),
    (case(18, NOUL, {"true": 1, "false": 0}, state="{ }"), "empty state", None),
]


def test_case_rules(spark):
    df = spark.createDataFrame([c for c, _, _ in CASES], "case_no int, state string, questions string, gold string")
    rows = C.explode_decisions(df).withColumn("reason", F.coalesce(V.case_reason(), V.question_reason(), V.gold_reason())).collect()
    found = {r.case_no: (r.reason, r.gold_probs) for r in rows}
    for (no, *_), reason, probs in CASES:
        assert found[no][0] == reason, no
        if probs:
            assert found[no][1] == pytest.approx(probs)
    good, bad = V.quarantine(df, F.when(F.col("case_no") > 3, F.lit("late")))
    assert good.count() == 3 and bad.count() == 15
    assert V.single_decision(df).count() == 18


def test_question_sets_differ(spark):
    df = spark.createDataFrame([('"s"', '{"q1":{}}', '{"q2":{}}'), ('"s"', "{}", "{}"), ('"s"', '{"q1":{}}', '{"q1":{}}')], "state string, questions string, gold string")
    assert [r[0] for r in df.select(V.case_reason()).collect()] == ["questions and gold differ", "no questions", None]


def test_json_builders(spark):
    df = spark.createDataFrame([(["A", "B"], ['q"1', None], [1.0, 0.0])], "k array<string>, d array<string>, p array<double>")
    row = df.select(C.question_json("choice", F.lit("i"), F.col("k"), F.col("d")).alias("q"), C.gold_json("choice", F.col("k"), F.col("p")).alias("g")).first()
    assert json.loads(row.q) == {"type": "choice", "instructions": "i", "criteria": {"A": 'q"1', "B": None}}
    assert json.loads(row.g) == {"type": "choice", "probabilities": {"A": 1.0, "B": 0.0}}


def _plain_merge(rows, seed, cal, val, test):
    """Union-find, first survivors and fractions in plain Python."""
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        for a in [("g", r["grp"])] + [("l", k) for k in r["link_keys"] if k and k.strip()]:
            parent[root(a)] = root(("g", r["grp"]))
    members, priority = defaultdict(set), defaultdict(int)
    rank = {s: i for i, s in enumerate(M.SPLITS)}
    for r in rows:
        c = root(("g", r["grp"]))
        members[c].add(r["grp"])
        priority[c] = max(priority[c], rank[r["split"]])
    name = {c: "component:" + hashlib.sha256(json.dumps(sorted(m), ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for c, m in members.items()}
    out, by = {}, defaultdict(list)
    for r in rows:
        by[r["input_key"]].append(r)
    for key, copies in by.items():
        best = min(copies, key=lambda r: (-rank[r["split"]], r["arrival"]))
        c = root(("g", best["grp"]))
        fate, split = "kept", best["split"]
        if len({r["gold_key"] for r in copies}) > 1:
            fate, split = "conflict", None
        elif rank[best["split"]] < priority[c]:
            fate, split = "cross_split", None
        elif split == "train":
            u = int(hashlib.sha256(json.dumps([str(seed), name[c]], separators=(",", ":")).encode()).hexdigest()[:16], 16) / 2**64
            split = "calibration" if u < cal else "validation" if u < cal + val else "test" if u < cal + val + test else "train"
        out[key] = (best["arrival"], name[c], fate, split, len(copies))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_against_plain_python(spark, seed):
    rng = random.Random(seed)
    rows = [
        {"arrival": i, "input_key": f"i{rng.randrange(70)}", "gold_key": rng.choice("aaaab"), "grp": f"g{rng.randrange(40)}", "link_keys": rng.choice([[], [f"k{rng.randrange(30)}"], ["", " "], [f"k{rng.randrange(30)}", f"k{rng.randrange(30)}"]]), "split": rng.choice(["train"] * 8 + ["test", "validation"])}
        for i in range(120)
    ]
    expected = _plain_merge(rows, 7, 0.2, 0.2, 0.2)
    schema = "arrival long, input_key string, gold_key string, grp string, link_keys array<string>, split string"
    for parts in (1, 5):
        df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(parts)
        merged = M.merge_cases(df, Scratch(spark, "t"), 7, 0.2, 0.2, 0.2).collect()
        assert {r.input_key: (r.arrival, r.component, r.fate, r.split, r.copies) for r in merged} == expected
    assert {f for _, _, f, _, _ in expected.values()} == {"kept", "conflict", "cross_split"}


def test_transitive_links(spark):
    """A bridge ties a training group to a held-out one; only the safe training group stays."""
    rows = [(1, "i1", "a", "left", ["L"], "train"), (2, "i2", "a", "bridge", ["L", "R"], "train"), (3, "i3", "a", "safe", ["S"], "train"), (4, "i4", "a", "right", ["R"], "test")]
    df = spark.createDataFrame(rows, "arrival long, input_key string, gold_key string, grp string, link_keys array<string>, split string")
    fate = {r.grp: (r.fate, r.split) for r in M.merge_cases(df, Scratch(spark, "t")).collect()}
    assert fate == {"left": ("cross_split", None), "bridge": ("cross_split", None), "safe": ("kept", "train"), "right": ("kept", "test")}


def test_long_chain(spark):
    members = [(f"n{i:03d}", f"a{i}") for i in range(120)] + [(f"n{i + 1:03d}", f"a{i}") for i in range(119)] + [("lonely", None), (None, "a1")]
    found = {r.grp: r.root for r in connected_groups(spark.createDataFrame(members, "grp string, anchor string"), Scratch(spark, "t")).collect()}
    assert found == {f"n{i:03d}": "n000" for i in range(120)} | {"lonely": "lonely"}
    assert connected_groups(spark.createDataFrame([], "grp string, anchor string"), Scratch(spark, "t")).count() == 0


def test_joins(spark):
    pairs = spark.createDataFrame([("q1", "p1", 2), ("q1", "p9", 0)], "qid string, pid string, grade int")
    queries, passages = spark.createDataFrame([("q1", "?")], "qid string, query string"), spark.createDataFrame([("p1", "x"), ("p2", "y")], "pid string, passage string")
    assert [(r.qid, r.pid, r.passage) for r in J.judged_pairs(pairs, queries, passages).collect()] == [("q1", "p1", "x")]
    assert [r.pid for r in J.missing_references(pairs, passages, "pid").collect()] == ["p9"]
    assert {r.pid: r.reason for r in J.lookup_or_reason(pairs, passages, "pid", "passage", "missing").collect()} == {"p1": None, "p9": "missing"}
    assert [r.pid for r in J.repeated_keys(passages.union(passages.limit(1)), "pid").collect()] == ["p1"]
    candidates = spark.createDataFrame([("k", "a", 1), ("k", "c", 1), ("k", "d", 0)], "k string, v string, label int")
    gold = spark.createDataFrame([("k", "a##b")], "k string, result string")
    assert {r.v: r.agrees for r in J.membership_agrees(candidates, gold, "k", "v", "label").collect()} == {"a": True, "c": False, "d": True}
    rows = spark.createDataFrame([(1, ["x"]), (2, None)], "id int, labels array<string>")
    assert [(r.id, r.label_name, r.holds) for r in J.fan_out(rows, F.col("labels"), ["x", "y"]).orderBy("id", "label_name").collect()] == [(1, "x", True), (1, "y", False), (2, "x", False), (2, "y", False)]
    assert rows.select(J.outside_vocabulary(F.col("labels"), ["y"]).alias("o")).first().o == ["x"]


def test_ordered_rows(spark):
    turns = spark.createDataFrame([("d", 1, "a"), ("d", 2, None), ("d", 3, "c")], "d string, t int, x string")
    assert [r.prefix for r in W.dialogue_prefixes(turns, "d", "t", "x").orderBy("t").collect()] == ["a", "a", "a\nc"]
    runs = spark.createDataFrame([(1, "f", 1, "a"), (2, "f", 2, "b"), (3, "f", 3, "a"), (4, "f", 4, "c"), (5, "f", 5, "c")], "event_id int, f string, n int, k string")
    assert [(r.k, r.runs) for r in W.broken_runs(runs, "k", "f", ["n"]).collect()] == [("a", 2)]
    assert [r.prev for r in W.last_good_before(runs, "f", ["n"], F.col("k") != "b", "k", "prev").orderBy("n").collect()] == [None, "a", "a", "a", "c"]
    assert [(r.entry_no, r.e) for r in W.enumerated(turns.limit(1), F.array(F.lit("b"), F.lit("a"), F.lit("b")), "e").collect()] == [(1, "a"), (2, "b")]


def test_physical_lines(spark, tmp_path):
    path = tmp_path / "f.txt"
    path.write_text("".join(f"line {i}\n" for i in range(1, 501)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = W.physical_lines(spark.read.text(str(path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.value == f"line {r.line}" for r in rows) and len(rows) == 500


def test_lengths(spark):
    rows = spark.createDataFrame([(n,) for n in [10, 100, 1000, 5000]], "n int")
    row = L.length_summary(rows, F.col("n")).first()
    assert (row.n, row.largest, row.p50) == (4, 5000, 550) and row.p99_9 in (4987, 4988)  # cut, not rounded
    assert {r.bin: r.n for r in L.length_histogram(rows, F.col("n")).collect()}[1024] == 3
    assert {r.cap: r.share for r in L.retention(rows, F.col("n")).collect()}[1024] == 0.75
    assert L.recommended_cap(rows, F.col("n")).first().cap == 6144
    assert L.recommended_cap(rows, F.lit(10**6)).first().cap is None


#: (kind, instructions, keys, descriptions, state, cap, head cap, cut state) and the layout's reason.
LAYOUTS = [
    ("choice", "挑一个", ["A", "B"], ["x", None], "状态😀", 200, 100, False, None),
    ("noul", "[MASK]?", ["false", "true"], [None, "好"], "a[MASK]b", 200, 160, False, None),
    ("score", "rate", ["0", "1"], ["低", "高"], "s" * 150, 100, 80, False, "state_truncated"),
    ("score", "rate", ["0", "1"], ["低", "高"], "s" * 150, 100, 80, True, None),
    ("choice", "q", ["A", "B"], ["y" * 50, "z"], "s", 300, 200, False, "option_text_truncated"),
    ("choice", "i" * 200, ["A", "B"], ["y", "z"], "s", 400, 64, False, "question_instruction_truncated"),
    ("choice", "q", ["A", "B"], ["y", "z"], "", 300, 200, False, "empty_state_tokens"),
]


@pytest.mark.parametrize("kind, ask, keys, desc, state, cap, head, cut, reason", LAYOUTS)
def test_layouts(spark, kind, ask, keys, desc, state, cap, head, cut, reason):
    from caseloom.functions.decisions import FALSE_TEXT

    df = spark.createDataFrame([(kind, ask, keys, desc, state)], "qtype string, instructions string, option_keys array<string>, option_desc array<string>, state_text string")
    row = T.strict_items(df, T.character_tokens(), cap, head, cut).first()
    assert row.reason == reason
    enc = lambda t: [ord(c) + 10 for c in t.replace("[MASK]", " ")]
    texts = {"choice": [k if d is None else f"{k}: {d}" for k, d in zip(keys, desc)], "score": [f"level {i}: {d}" for i, d in enumerate(desc)], "noul": [f"false: {desc[0] or FALSE_TEXT}", f"true: {desc[1]}"]}[kind]
    prefix = [1, *enc(f"{kind} question: {ask}"), 2]
    markers = []
    for t in texts:
        markers.append(len(prefix))
        prefix += [3, *enc(" " + t)]
    prefix.append(2)
    if reason is None:
        body = enc(state)[: cap - len(prefix) - 1]
        assert row.ids == [*prefix, *body, 2] and row.markers == markers
        assert row.state_tokens == len(enc(state)) and row.state_cut == (len(body) < row.state_tokens)
        lenient = T.lenient_prompts(df, T.character_tokens(), head).first()
        assert lenient.prompt == prefix and lenient.markers == markers and lenient.state_ids == enc(state)
        again = df.sparkSession.createDataFrame([(lenient.prompt, lenient.state_ids)], "p array<int>, s array<int>").select(T.rebuilt(F.col("p"), F.col("s"), F.lit(cap), 2)).first()[0]
        assert again == row.ids
    else:
        assert row.ids is None and row.markers is None


def test_many_options_are_skipped(spark):
    keys = [f"k{i}" for i in range(60)]
    df = spark.createDataFrame([("choice", "q", keys, ["text"] * 0 + [f"d{i}" for i in range(60)], "s")], "qtype string, instructions string, option_keys array<string>, option_desc array<string>, state_text string")
    assert T.lenient_prompts(df, T.character_tokens(), 64).first().reason == "head too small for its options"
    assert T.strict_items(df, T.character_tokens(), 900, 64).first().reason == "option_text_truncated"


def test_rebuilding_and_padding(spark):
    df = spark.createDataFrame([([1, 9, 2], [5, 6, 7, 8])], "p array<int>, s array<int>")
    at = lambda cap, left=False: df.select(T.rebuilt(F.col("p"), F.col("s"), F.lit(cap), 2, left)).first()[0]
    assert at(20) == [1, 9, 2, 5, 6, 7, 8, 2] and at(6) == [1, 9, 2, 5, 6, 2] and at(6, True) == [1, 9, 2, 7, 8, 2] and at(4) == at(4, True) == [1, 9, 2, 2] and at(3) is None
    assert df.select(T.padded(F.col("p"), F.lit(5), 0), T.marker_mask(F.col("p"), F.lit(4))).first()[:] == ([1, 9, 2, 0, 0], [1, 1, 1, 0])


def test_library_tokens(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    tok = T.library_tokens(path, *["<|endoftext|>"] * 4)
    df = spark.createDataFrame([("choice", "pick", ["A", "B"], ["one", None], "state text")], "qtype string, instructions string, option_keys array<string>, option_desc array<string>, state_text string")
    row = T.strict_items(df, tok, 100, 64).first()
    from tokenizers import Tokenizer

    known, end = Tokenizer.from_file(path), 50256
    ids = lambda t: known.encode(t, add_special_tokens=False).ids
    assert row.ids == [end, *ids("choice question: pick"), end, end, *ids(" A: one"), end, *ids(" B"), end, *ids("state text"), end]


@pytest.mark.parametrize("parts", [1, 7])
def test_batches(spark, parts):
    items = spark.createDataFrame([(i, (i * 37) % 500 + 1) for i in range(3000)], "item long, length long").repartition(parts)
    plan = B.fixed_batches(items, "item", "length", 16, 3).collect()
    assert sorted(r.item for r in plan) == list(range(3000))
    sizes = defaultdict(list)
    for r in plan:
        sizes[r.batch].append(r.length)
    assert max(map(len, sizes.values())) == 16
    spread = sum(max(x) - min(x) for x in sizes.values()) / len(sizes)
    assert spread < 30  # batches hold like lengths
    packed = B.token_batches(items, "item", "length", 1000, 512, 3).collect()
    totals = defaultdict(int)
    for r in packed:
        totals[r.window, r.batch] += r.length
    assert sorted(r.item for r in packed) == list(range(3000)) and max(totals.values()) <= 1000
    assert sorted(B.seeded_subset(items, "item", 10, 1).collect()) == sorted(B.seeded_subset(items.repartition(3), "item", 10, 1).collect())


@pytest.mark.parametrize("world", [1, 2, 3, 8])
def test_shards(spark, world):
    plan = spark.createDataFrame([(i,) for i in range(103)], "batch long")
    rows = B.shards(plan, "batch", world).collect()
    assert sorted(r.batch for r in rows) == list(range(103))
    even = [r for r in rows if r.even]
    assert len(even) == 103 // world * world
    assert len({(r.shard, r.step) for r in rows}) == 103


def test_temperature_and_evaluation(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        k = rng.randrange(3)
        logits = [rng.gauss(0, 1) + 6 * (j == k) for j in range(3)]
        gold = k if rng.random() < 0.7 else rng.randrange(3)
        rows.append(("choice", logits, [float(j == gold) for j in range(3)]))
    rows += [("noul", [1.0, 0.0], [1.0, 0.0])] * 5
    df = spark.createDataFrame(rows, "qtype string, logits array<double>, target array<double>")
    fitted = S.fit_temperatures(df)
    assert fitted["noul"] == 1.0

    def loss(t):
        import math

        total = 0.0
        for _, z, y in rows[:400]:
            top = max(z) / t
            total -= sum(w * (x / t - top - math.log(sum(math.exp(v / t - top) for v in z))) for w, x in zip(y, z))
        return total

    best = min((loss(x / 50), x / 50) for x in range(5, 500))[1]
    assert abs(fitted["choice"] - best) < 0.05
    report = {r.qtype: r for r in S.evaluation(S.with_temperatures(df, fitted)).collect()}
    assert report[None]["items"] == 405 and report["noul"].accuracy == 1.0 and report["choice"].mean_confidence < 0.95
    errors = {r.qtype: r.ece for r in S.calibration_error(S.scored(df), "qtype").collect()}
    better = {r.qtype: r.ece for r in S.calibration_error(S.with_temperatures(df, fitted), "qtype").collect()}
    assert better["choice"] < errors["choice"]
