"""Tokens, containers and reading levels."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm.bpe import Encoder
from caseloom.llm.levels import fit_levels, level_profile, reading_levels
from caseloom.llm.packing import pack_tokens, plan_packing
from caseloom.llm.readability import isotonic, measures, syllables
from caseloom.llm.tokens import VOCABULARY, count_tokens, encode_texts
from caseloom.plans.shared import Scratch

DOCUMENTS = "doc_id long, text string, lang string, source string, kind string, ids string, tokens string, estimate string"


def _documents(spark, texts):
    return spark.createDataFrame([(i, t, "zh", None, "note", "c", "c", "c") for i, t in enumerate(texts, 1)], DOCUMENTS)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(VOCABULARY)
    found.encode_special_tokens = True
    return lambda t: found.encode(t, add_special_tokens=False).ids


TEXTS = ["", "a", "hello  world\n\n x", "<|endoftext|> is text", "患者口干，血压12.5kPa。", "=" * 5000, "啊" * 3000, "ab" * 4000, "\t\r\n ", "Ñandu's 😀👩‍👩‍👧 café", " " * 300 + "x"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_library(encoder, reference, text):
    assert encoder.encode_batch([text])[0].tolist() == reference(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab =中。e\n'st"), st.characters(exclude_categories=["Cs"])), max_size=120))
def test_ids_of_any_text(encoder, reference, text):
    assert encoder.encode_batch([text, None, text])[0].tolist() == reference(text)


def test_both_trees_agree(encoder):
    rng = random.Random(1)
    words = ["".join(rng.choice("aabthe中国=") for _ in range(rng.randint(1, 200))).encode() for _ in range(60)]
    assert [x.tolist() for x in encoder.vocabulary.merge_many(words)] == [encoder.vocabulary.merge_one(w).tolist() for w in words]


def test_encode_table(spark, reference):
    df = _documents(spark, [None, *TEXTS])
    found = {r.doc_id: list(r.ids) for r in encode_texts(df).collect()}
    assert found == {1: []} | {i: reference(t) for i, t in enumerate(TEXTS, 2)}
    counts = {r.doc_id: r.tokens for r in count_tokens(df).collect()}
    assert counts == {k: len(v) for k, v in found.items()}
    assert encode_texts(df.limit(0)).count() == 0
    assert encode_texts(df.union(df)).count() == 2 * len(found)


def _bins(plan, histogram):
    """The containers' contents, and a check that every item has one place."""
    ranks, bins = {s: set() for s in histogram}, {}
    for size, start, each, first, count in plan.entries:
        for r in range(start, min(start + each * count, histogram[size])):
            assert r not in ranks[size]
            ranks[size].add(r)
            bins.setdefault(first + (r - start) // each, []).append(size)
    assert all(len(ranks[s]) == n for s, n in histogram.items())
    assert sorted(bins) == list(range(plan.containers))
    return bins


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=12))
def test_plans_are_whole(histogram):
    bins = _bins(plan_packing(histogram, 60), histogram)
    assert all(sum(b) <= 60 for b in bins.values())
    assert all(sum(s > 20 for s in b) <= 2 for b in bins.values())
    # Best fit after matching: no two containers could be one.
    assert sum(sum(b) <= 30 for b in bins.values()) <= 1


def test_plan_does_not_grow_with_the_corpus():
    small = {s: 3 + s % 7 for s in range(1, 2049)}
    large = {s: n * 100_000 for s, n in small.items()}
    a, b = plan_packing(small, 2048), plan_packing(large, 2048)
    assert len(b.entries) < 8 * 2048
    total = sum(s * n for s, n in large.items())
    assert b.containers < 1.02 * total / 2048 and a.containers < 1.03 * sum(s * n for s, n in small.items()) / 2048


def test_pack_table(spark, reference):
    rng = random.Random(2)
    texts = [None, "", *(" ".join(rng.choice(["cat", "血压", "x"]) for _ in range(rng.choice([3, 30, 200, 900]))) for _ in range(120)), "one two " * 5000]
    df = _documents(spark, texts)
    rows = pack_tokens(df, Scratch(spark, "t")).collect()
    sizes = {i: len(reference(t)) for i, t in enumerate(texts, 1) if t}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
        by_bin[r.container_no] = by_bin.get(r.container_no, 0) + r.tokens
    assert by_doc.keys() == sizes.keys()
    for i, pieces in by_doc.items():
        at = 0
        for first, n in sorted(pieces):
            assert first == at
            at += n
        assert at == sizes[i]
        assert len(pieces) == -(-sizes[i] // 2048)
    assert max(by_bin.values()) <= 2048
    assert len(by_bin) <= -(-sum(sizes.values()) // 2048) + 2
    again = pack_tokens(df.repartition(3), Scratch(spark, "t")).collect()
    assert sorted(rows) == sorted(again)
    assert pack_tokens(df.limit(0), Scratch(spark, "t")).count() == 0
    assert pack_tokens(df.union(df), Scratch(spark, "t")).count() == 2 * len(rows)


@pytest.mark.parametrize("word, n", [("cat", 1), ("table", 2), ("receive", 2), ("reading", 2), ("patient", 2), ("jurisprudential", 6), ("asked", 1), ("requires", 2), ("idea", 2), ("contract", 2)])
def test_syllables(word, n):
    assert abs(syllables(word) - n) <= 1


# Ordinary words and medical ones with their syllables, chosen after the patterns were written; 98.6 % of the list they
# are from came out right before its faults were mended too.
COUNTED = """
after:2 again:2 against:2 almost:2 already:3 although:2 always:2 among:2 another:3 answer:2 appear:2 around:2 arrive:2 article:3 available:4 average:3
became:2 become:2 begin:2 behind:2 better:2 between:2 bottle:2 brother:2 building:2 camera:3 capital:3 center:2 certain:2 chair:1 children:2 church:1
clothes:1 common:2 company:3 complete:2 condition:3 consider:3 control:2 country:2 decision:3 delivery:4 describe:2 despite:2 detail:2 develop:3
difficult:3 dinner:2 direction:3 discover:3 distance:2 during:2 early:2 economy:4 effect:2 either:2 energy:3 enough:2 entire:2 evidence:3 exactly:3
explain:2 express:2 factory:3 famous:2 farmer:2 feature:2 figures:2 final:2 follow:2 forgotten:3 fortune:2 freedom:2 garden:2 general:3 glasses:2
grammar:2 guess:1 heavy:2 history:3 however:3 human:2 image:2 imagine:3 include:2 increase:2 indicate:3 industry:3 injury:3 invoice:2 island:2
judgment:2 kitchen:2 knowledge:2 labels:2 languages:3 leader:2 leather:2 legal:2 library:3 listen:2 little:2 machines:2 magazine:3 manager:3 market:2
material:4 meaning:2 mention:2 method:2 middle:2 minute:2 missing:2 model:2 modern:2 money:2 morning:2 mother:2 mountain:2 natural:3 necessary:4
neighbor:2 neither:2 never:2 north:1 notice:2 number:2 object:2 office:2 officer:3 often:2 opened:2 operate:3 orange:2 order:2 outside:2 package:2
painting:2 parents:2 particular:4 payment:2 perhaps:2 personal:3 pieces:2 pleasure:2 police:2 popular:3 position:3 possible:3 practice:2 prepare:2
president:3 private:2 problem:2 process:2 product:2 program:2 project:2 promise:2 public:2 window:2 winter:2 without:2 woman:2 wonder:2 writing:2
written:2 yellow:2 achieve:2 biological:5 cardiovascular:6 chronic:2 clinical:3 coronary:4 deteriorate:5 dosage:2 electrolyte:4 evaluation:5 hepatic:3
inflammation:4 intravenous:4 jurisdiction:4 laboratory:5 litigation:4 metabolism:5 neurological:5 obstetric:3 pediatric:4 physiological:6
prescription:3 prognosis:3 pulmonary:4 radiotherapy:6 residual:4 stipulate:3 subsequently:4 therapeutic:4 ultrasound:3 vascular:3 ventilation:4
"""


def test_syllables_of_ordinary_words():
    words = [w.split(":") for w in COUNTED.split()]
    wrong = [w for w, n in words if syllables(w) != int(n)]
    assert len(wrong) <= 0.03 * len(words), wrong


@pytest.mark.parametrize("word, n", [("statement", 2), ("something", 2), ("careful", 2), ("science", 2), ("conscience", 2), ("create", 2), ("people", 2), ("area", 3), ("lion", 2), ("fluid", 2), ("don't", 1), ("Müller", 2), ("l", 1), ("y", 1)])
def test_syllables_at_seams_and_between_vowels(word, n):
    assert syllables(word) == n


def test_measures_by_hand():
    found = measures("甲：今天下雨，路滑。小心！\nDr. Lee said 3.5 mg is fine. It isn't... much", {})
    assert (found["words"], found["han"]) == (9, 8)
    assert found["sentence_syllables"] == 4 and found["clause_syllables"] == 8 / 3
    assert abs(found["automated"] - (4.71 * 28 / 9 + 0.5 * 9 / 4 - 21.43)) < 1e-9


def test_measures_of_a_batch_are_those_of_each():
    from caseloom.llm.readability import NAMES, measure_many

    texts = [None, "", "  ", EASY, HARD, "1. 头晕\n2. 口干", "x￾y.", "...", ".", EASY + HARD]
    rows = measure_many(texts, {})
    for t, row in zip(texts, rows):
        one = measures(t or "", {})
        assert {n: x for n, x in zip(NAMES, row) if x == x} == (one or {"words": 0.0, "han": 0.0})


def test_isotonic_is_monotone():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random(500)
    _, y = isotonic(x, x + rng.normal(0, 0.3, 500))
    assert (np.diff(y) >= 0).all()


EASY = "下雨了。小猫躲在树下。我们去玩。The cat sat. It is red. We go home."
HARD = "鉴于其活性代谢产物之半衰期较长且抑制呈浓度依赖性故于肝功能减退者须审慎权衡蓄积毒性与治疗获益。Notwithstanding methodological heterogeneity, extrapolation of pharmacokinetic concentrations remains epistemologically indefensible."


def test_levels(spark):
    zh = lambda t: t.split("The" if "The" in t else "Not")[0]
    en = lambda t: t[len(zh(t)) :]
    texts = [part(t) * (1 + i % 3) for i in range(12) for t in (EASY, HARD) for part in (zh, en)] + [None, "", " \n", "=====", "长" * 30000, "сложный текст"]
    df = _documents(spark, texts)
    grades = [(i, "a", 1 if t and t[:3] in (zh(EASY)[:3], en(EASY)[:3]) else 5) for i, t in enumerate(texts[:48], 1)] + [(1, "b", None), (999, "a", 3)]
    fitted = fit_levels(df, spark.createDataFrame(grades, "doc_id long, rater string, reading_level int"))
    found = {r.doc_id: r.reading_level for r in reading_levels(df, fitted).collect()}
    assert all(found[i] == g for i, _, g in grades[:48])
    assert [found[i] for i in range(49, 53)] == [None] * 4
    assert found[53] == 5 and found.keys() == set(range(1, len(texts) + 1))
    profile = level_profile(df, reading_levels(df, fitted)).collect()
    assert sum(r.documents for r in profile) == len(texts)
    none = fit_levels(df, spark.createDataFrame([], "doc_id long, rater string, reading_level int"))
    assert reading_levels(df, none).where("reading_level is not null").count() == 0
    assert reading_levels(df.limit(0), fitted).count() == 0
    assert measures("===", {}) is None


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/documents.parquet"), reason="needs the test tables")
def test_held_out_accuracy(spark):
    """Fitted on half of the graded documents, the levels of the other half agree with the raters about as often as
    two raters agree."""
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    grades = spark.read.parquet("/root/testdata/sf0.1/doc_grades.parquet")
    fitted = fit_levels(documents, grades.where("doc_id % 2 = 0"))
    held = reading_levels(documents, fitted).withColumnRenamed("reading_level", "found").join(grades.where("doc_id % 2 = 1 and reading_level is not null"), "doc_id").where("found is not null")
    rows = held.select("found", "reading_level").collect()
    assert sum(a == b for a, b in rows) / len(rows) > 0.72
    assert sum(abs(a - b) <= 1 for a, b in rows) / len(rows) > 0.97
