"""A third of all rows in one group of copies, one key, one text: the same results when every path for hot groups is taken."""

import itertools

import pytest
from pyspark.sql import functions as F

import caseloom.llm.grouping as grouping
from caseloom.llm.copies import copy_pairs
from caseloom.llm.linked import assign_splits, case_components, spanning_components
from caseloom.llm.components import components_by_decomposition, components_by_stars
from caseloom.llm.neardups import similar_pairs
from caseloom.llm.sampling import grown_sample
from caseloom.llm.textforms import same_look_pairs
from caseloom.plans import shared
from caseloom.plans.shared import Scratch

from .samples import CASES, RAW, case_rows, plain_components, raw_rows


@pytest.fixture
def eager(monkeypatch):
    """Keys with more than three rows are hot, blocks hold seven rows."""
    monkeypatch.setattr(shared.hot_keys, "__defaults__", (None, 3, 512))
    monkeypatch.setattr(shared.heaviest, "__defaults__", (3, 512))
    monkeypatch.setattr(grouping, "BLOCK", 7)


def _raw(spark):
    rows = raw_rows(seed=8, count=100)
    text = "患者口干三天，血压12.5kPa，建议复查并多喝水。"
    hot = [(1000 + i, "same", "noul", (text if i % 2 else text.replace("，", " , "), None, None), "Rate it.", 1, *["c"] * 2, 1, *["c"] * 2) for i in range(50)]
    near = [(2000 + i, "near", "noul", (text + "另行通知", None, None), "Rate it.", 1, *["c"] * 2, 1, *["c"] * 2) for i in range(6)]
    return spark.createDataFrame(rows + hot + near, RAW).repartition(3)


def _pairs(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_copies_of_a_third(spark, eager):
    found = _pairs(copy_pairs(_raw(spark), Scratch(spark, "t")))
    assert set(itertools.combinations(range(1000, 1050), 2)) <= found
    assert not {p for p in found if (p[0] < 1000) != (p[1] < 1000)}


def test_near_copies_of_a_third(spark, eager):
    found = _pairs(similar_pairs(_raw(spark), Scratch(spark, "t")))
    expected = {(a, b) for a in range(1000, 1050) for b in range(2000, 2006)}
    assert expected == {p for p in found if p[0] >= 1000}


def test_looks_of_a_third(spark, eager):
    text = "cox paid the HE note"
    rows = [(i, "x", "noul", (text.replace("o", "ο") if i % 3 == 0 else text, None, None), None, 1, *["c"] * 2, 1, *["c"] * 2) for i in range(60)]
    found = _pairs(same_look_pairs(spark.createDataFrame(rows, RAW), Scratch(spark, "t")))
    assert found == {(a, b) for a, b in itertools.combinations(range(60), 2) if (a % 3 == 0) != (b % 3 == 0)}


def test_one_key_of_a_third(spark, eager):
    rows = case_rows(seed=3, count=120) + [(1000 + i, ("hot" if i % 2 else None, ["k1"] if i % 9 == 0 else [f"own{i}"]), "", "", "") for i in range(60)]
    cases, expected = spark.createDataFrame(rows, CASES).repartition(3), plain_components(rows)
    for find in (components_by_decomposition, components_by_stars):
        assert {r.case_no: r.component_no for r in case_components(cases, Scratch(spark, "t"), find).collect()} == expected
    assert {r.case_no for r in spanning_components(cases, Scratch(spark, "t")).collect()} <= set(expected)
    split = {r.group_key: r for r in assign_splits(cases, Scratch(spark, "t")).collect()}
    by = {}
    for no, (g, _), *_ in rows:
        if g is not None:
            by.setdefault(expected[no], set()).add(split[g].split)
    assert all(len(s) == 1 for s in by.values())


def test_one_identifier_of_a_third(spark, eager):
    rows = [("hot" if i % 3 == 0 else f"i{i}", i) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, raw_no long")
    found = {r.raw_no for r in grown_sample(df, [F.lit(True)], F.col("id"), F.col("raw_no"), 0.5, Scratch(spark, "t"), 3).collect()}
    hot = {i for k, i in rows if k == "hot"}
    assert hot <= found or not hot & found


def test_one_spelling_never_meets_itself(spark, monkeypatch):
    """5,000 rows of one spelling and one of another: two classes meet once, not 12 million rows."""
    import caseloom.llm.textforms as module

    met = []
    paired = module.pairs_within
    monkeypatch.setattr(module, "pairs_within", lambda *a, **k: met.append(paired(*a, **k)) or met[-1])
    rows = [(i, "x", "noul", ("cοx paid" if i == 7 else "cox paid", None, None), None, 1, *["c"] * 2, 1, *["c"] * 2) for i in range(5000)]
    found = _pairs(same_look_pairs(spark.createDataFrame(rows, RAW), Scratch(spark, "t")))
    assert found == {(min(i, 7), max(i, 7)) for i in range(5000) if i != 7}
    assert met[0].count() == 1


def test_hub_of_near_copies(spark, eager, monkeypatch):
    """A text with 300 near copies that aren't close to each other is spread, and each link comes out once."""
    import caseloom.llm.neardups as module

    taken = []
    lookup = module.salted_lookup
    monkeypatch.setattr(module, "salted_lookup", lambda *a, **k: taken.append((a[2], [r[0] for r in a[3]])) or lookup(*a, **k))
    base = "".join(chr(0x4E00 + 37 * i % 9000) for i in range(240))
    texts = [base] + [base[: 3 * (i % 20)] + "".join(chr(0x5000 + (911 * i + 53 * k) % 8000) for k in range(30)) + base[3 * (i % 20) + 30 :] for i in range(1, 300)]
    rows = [(i, "x", "noul", (t, None, None), None, 1, *["c"] * 2, 1, *["c"] * 2) for i, t in enumerate(texts)]
    found = _pairs(similar_pairs(spark.createDataFrame(rows, RAW).repartition(3), Scratch(spark, "t")))
    assert {(0, i) for i in range(1, 300)} <= found
    assert any(key == "id_a" and 0 in hot for key, hot in taken)


def test_hot_bands_are_dealt_out(spark, monkeypatch):
    """Keys that tasks tell of go through blocks of their own; the pairs are the same."""
    import caseloom.llm.neardups as module

    raw = _raw(spark)
    expected = _pairs(similar_pairs(raw, Scratch(spark, "t")))
    monkeypatch.setattr(module, "TOLD", 1)
    monkeypatch.setattr(shared.heaviest, "__defaults__", (2, 512))
    monkeypatch.setattr(grouping, "BLOCK", 2)
    dealt = []
    banded = module.banded
    monkeypatch.setattr(module, "banded", lambda classes, p, hot, buckets: dealt.append(len(hot)) or banded(classes, p, hot, buckets))
    assert _pairs(similar_pairs(raw, Scratch(spark, "t"))) == expected
    assert dealt[0] > 0
