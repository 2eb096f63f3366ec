"""Look forms, copies and near-duplicates against plain versions over all pairs."""

import itertools
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm.copies import collapsed, copy_groups, copy_pairs
from caseloom.llm.lookforms import CLASS_OF, DOUBTFUL, LookForm, content
from caseloom.llm.neardups import NearDuplicates, exact_similarity, similar_groups, similar_pairs
from caseloom.llm.textforms import canonical_texts, raw_bigrams, same_look_pairs
from caseloom.plans.shared import Scratch

from .samples import RAW, raw_rows

form = LookForm()  # the samples hold no word of another script, so counts change nothing


@pytest.fixture(scope="module")
def rows():
    return raw_rows()


@pytest.fixture(scope="module")
def raw(spark, rows):
    return spark.createDataFrame(rows, RAW).repartition(5)


@pytest.mark.parametrize(
    "a, b",
    [
        ("Ａ１，", "A1,"), ("é", "é"), ("е​́", "é"), ("раураl", "paypal"), ("ΝOΤ", "NOT"), ("5㎎ Ⅱ ﬁ ℃", "5mg II fi °C"), ("㎡", "m²"),
        ("a b　c", "a b c"), ("⻔⼀", "门一"), ("soft­hy⁠phen﻿", "softhyphen"), ("里", "里"), ("ӏine", "line"), ("…", "..."), ("口⼝", "口口"),
    ],
)
def test_same_look(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a, b", [("I", "l"), ("O", "0"), ("x²", "x2"), ("①", "1"), ("é", "e"), ("藥", "药"), ("a b", "ab"), ("a\tb", "a b"), ("a\nb", "a b"), ("a  b", "a b"), ("未", "末")])
def test_other_look(a, b):
    assert form(a) != form(b)


def test_lattice_keeps_real_scripts():
    assert form("Москва") == "Москва"
    assert form("Моcквa") == "Москва"
    assert form("ロシア 出口") == "ロシア 出口"
    assert LookForm({"ta": 5, "ab": 5, "bl": 9, "bI": 1, "le": 9, "Ie": 1})("tabӀe") == "table"
    greek = LookForm({"ΤΟ": 9, " Τ": 9})
    assert greek("TO") == greek("ΤΟ") == "ΤΟ"


MEMBERS = "".join(CLASS_OF) + "".join(DOUBTFUL) + "μµΣλкшдMmÑñüé́̃ ."


def test_members_of_a_class_look_the_same():
    for group in set(CLASS_OF.values()):
        assert len({form(ch) for ch in group}) == 1, group


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=st.sampled_from(MEMBERS), max_size=8)))
def test_form_is_stable_and_composed(text):
    once = form(text)
    assert form(once) == once
    assert unicodedata.is_normalized("NFC", once)


def test_null_and_empty():
    assert form(None) is None and content(None) is None
    assert form("") == "" and content("") == ""
    assert content(form("  「。」 ")) == ""
    assert content(form("Ａ, 3.5 mg. 2×10⁹/L (Ⅱ)")) == "a3.5mg2×10⁹/lii"


def _content(rows):
    return {r[0]: tuple(content(form(t)) for t in (r[3][0], r[3][1], r[4])) for r in rows}


def _has(c):
    return bool((c[0] or "") + (c[1] or ""))


def _pairs(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_same_look_pairs(spark, raw, rows):
    parts = {r[0]: (r[3][0], r[3][1], r[4]) for r in rows}
    looks, contents = {k: tuple(form(t) for t in v) for k, v in parts.items()}, _content(rows)
    keep = [k for k in parts if _has(contents[k])]
    expected = {(a, b) for a, b in itertools.combinations(keep, 2) if looks[a] == looks[b] and parts[a] != parts[b]}
    assert len(expected) > 10
    assert _pairs(same_look_pairs(raw, Scratch(spark, "t"))) == expected
    assert _pairs(same_look_pairs(raw.union(raw), Scratch(spark, "t"))) == expected  # repeated rows
    assert canonical_texts(raw).count() == len(rows)


def test_copies(spark, raw, rows):
    contents = _content(rows)
    key = {}
    for r in rows:
        slots = None if r[3][2] is None else frozenset((content(form(n)), content(form(v))) for n, v in r[3][2])
        key[r[0]] = (r[2], contents[r[0]], slots)
    keep = [k for k in key if _has(contents[k])]
    expected = {(a, b) for a, b in itertools.combinations(keep, 2) if key[a] == key[b]}
    assert len(expected) > 20
    assert _pairs(copy_pairs(raw, Scratch(spark, "t"))) == expected
    assert _pairs(copy_pairs(raw.union(raw), Scratch(spark, "t"))) == expected
    found = {r.raw_no: r.copies for r in collapsed(raw, Scratch(spark, "t")).collect()}
    assert sum(found.values()) == len(rows)
    groups = {r.raw_no: r.first_no for r in copy_groups(raw, Scratch(spark, "t")).collect()}
    assert all(groups[b] == groups[a] for a, b in expected)


def test_copies_survive_collisions(spark, raw, monkeypatch):
    from pyspark.sql import functions as F

    import caseloom.llm.copies as module

    expected = _pairs(copy_pairs(raw, Scratch(spark, "t")))
    monkeypatch.setattr(module, "fingerprint", lambda lane: F.length(F.coalesce("text", F.lit(""))) % 40)
    assert _pairs(copy_pairs(raw, Scratch(spark, "t"))) == expected


def _similarity(a, b, n=4):
    s, t = ({x[i : i + n] for i in range(len(x) - n + 1)} for x in (a, b))
    return len(s & t) / len(s | t) if s | t else 0.0


def test_near_duplicates(spark, raw, rows):
    whole = {k: (c[0] or "") + (c[1] or "") for k, c in _content(rows).items()}
    whole = {k: c for k, c in whole.items() if c}
    scores = {(a, b): _similarity(whole[a], whole[b]) for a, b in itertools.combinations(whole, 2) if whole[a] != whole[b]}
    must = {p for p, s in scores.items() if s >= 0.65}
    may = {p for p, s in scores.items() if s >= 0.6}
    found = _pairs(similar_pairs(raw, Scratch(spark, "t")))
    assert len(must) > 10
    assert must <= found <= may
    assert _pairs(similar_pairs(raw.union(raw), Scratch(spark, "t"))) == found
    groups = {r.raw_no: r for r in similar_groups(raw, Scratch(spark, "t")).collect()}
    assert groups.keys() == whole.keys()
    assert all(groups[a].group_no == groups[b].group_no for a, b in found)
    assert all(groups[a].class_no == groups[b].class_no for a, b in itertools.combinations(whole, 2) if whole[a] == whole[b])
    linked = {x for p in found for x in p}
    assert all((groups[k].links > 0) == (k in linked) for k in whole)


def test_pruning_bounds():
    p = NearDuplicates()
    assert p.recall(0.65) > 0.999
    bounds = p.bounds()
    assert [n for n, _ in bounds] == [32, 64, 96, 128, 160]
    assert all(0 < m < 0.6 * n for n, m in bounds)
    assert all(a[1] / a[0] <= b[1] / b[0] for a, b in zip(bounds, bounds[1:]))


def test_exact_similarity(spark):
    df = spark.createDataFrame([("abcdef", "abcdex"), ("abc", "abc"), ("abcd", "abcd")], "a string, b string")
    assert [r[0] for r in df.select(exact_similarity(4)("a", "b")).collect()] == [0.5, 0.0, 1.0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], RAW)
    for run in (same_look_pairs, copy_pairs, collapsed, similar_pairs, similar_groups):
        assert run(none, Scratch(spark, "t")).count() == 0
    assert raw_bigrams(none) == {}


def test_blocks_of_a_large_group(spark, monkeypatch):
    import caseloom.llm.grouping as module

    monkeypatch.setattr(module, "BLOCK", 7)
    df = spark.createDataFrame([("k", i) for i in range(60)] + [("j", i) for i in range(3)] + [("alone", 1), (None, 1), (None, 2)], "k string, i long")
    found = sorted(tuple(r) for r in module.pairs_within(df, None, "k", "i", Scratch(spark, "t")).collect())
    assert found == sorted([*itertools.combinations(range(60), 2), *itertools.combinations(range(3), 2)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20), st.text(alphabet=st.sampled_from(MEMBERS + "1.٣ ￾"), max_size=8)), max_size=6))
def test_many_texts_as_one_by_one(texts):
    from caseloom.llm.lookforms import contents

    looks = [form(t) for t in texts]
    assert form.many(texts) == looks
    assert contents(looks) == [content(x) for x in looks]
