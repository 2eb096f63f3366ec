"""Components, splits and samples."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from caseloom.llm.components import components_by_decomposition, components_by_stars
from caseloom.llm.linked import assign_splits, case_components, split_conflicts, spanning_components
from caseloom.llm.sampling import PermanentSample, grown_sample
from caseloom.plans.shared import Scratch

from .samples import CASES, RAW, case_rows, plain_components, raw_rows

BOTH = pytest.mark.parametrize("find", [components_by_decomposition, components_by_stars])


@pytest.fixture(scope="module")
def rows():
    return case_rows()


@pytest.fixture(scope="module")
def cases(spark, rows):
    return spark.createDataFrame(rows, CASES).repartition(4)


@BOTH
def test_components_of_shapes(spark, find):
    """A path, a star, a clique, self loops, repeated and reversed edges, null ends."""
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(a, b) for a in range(200, 206) for b in range(200, 206)]
    edges += [(300, 301), (301, 300), (300, 301), (400, 400), (None, 5), (7, None)]
    found = {r.node: r.component for r in find(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    expected = {i: 100 for i in range(100, 141)} | {i: 1 for i in range(1, 60)} | {i: 200 for i in range(200, 206)} | {300: 300, 301: 300}
    assert found == expected


@BOTH
def test_components_of_random_graphs(spark, find):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)]
    parent = {i: i for i in range(400)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    found = {r.node: r.component for r in find(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert found == {x: root(x) for x in nodes}


@BOTH
def test_no_edges(spark, find):
    assert find(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_case_components(spark, cases, rows):
    expected = plain_components(rows)
    for find in (components_by_decomposition, components_by_stars):
        assert {r.case_no: r.component_no for r in case_components(cases, Scratch(spark, "t"), find).collect()} == expected
    keys = defaultdict(set)
    for no, (group, _), *_ in rows:
        keys[expected[no]].add(group if group is not None else no)
    spanning = {(no, c) for no, c in expected.items() if len(keys[c]) > 1}
    for table in (cases, cases.union(cases)):
        assert {tuple(r) for r in spanning_components(table, Scratch(spark, "t")).collect()} == spanning
    assert spanning and len(spanning) < len(rows)


def test_splits(spark, cases, rows):
    expected = plain_components(rows)
    found = {r.group_key: r for r in assign_splits(cases, Scratch(spark, "t")).collect()}
    assert found.keys() == {g for _, (g, _), *_ in rows if g is not None}
    by_component = defaultdict(set)
    for no, (g, _), *_ in rows:
        if g is not None:
            by_component[expected[no]].add(found[g].split)
    assert all(len(s) == 1 for s in by_component.values())
    again = {r.group_key: r.split for r in assign_splits(cases.repartition(1), Scratch(spark, "t")).collect()}
    assert again == {k: r.split for k, r in found.items()}


def test_shares_hold_beside_a_giant(spark):
    """One component has a third of the cases; the shares still come out."""
    rows = [(i, ("giant" if i % 3 == 0 else f"g{i}", None), "", "", "") for i in range(1, 6001)]
    cases = spark.createDataFrame(rows, CASES)
    split = {r.group_key: r.split for r in assign_splits(cases, Scratch(spark, "t")).collect()}
    got = Counter(split[r[1][0]] for r in rows)
    assert split["giant"] == "train"
    for s, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(got[s] / 6000 - share) < 0.015


def test_split_conflicts(spark, cases, rows):
    rng = random.Random(4)
    spelled = ["train", "Train ", " TRAIN", "test", None, "", "  ", "validation\t"]
    recorded = [(f"g{rng.randrange(110)}", rng.choice(spelled)) for _ in range(150)] + [(None, "train"), (None, "test"), ("nobody", "train"), ("nobody", "test"), ("lonely", " train"), ("lonely", "TRAIN")]
    component = plain_components(rows)
    of_key = {g: component[no] for no, (g, _), *_ in rows if g is not None}
    splits = defaultdict(set)
    for g, s in recorded:
        if g is not None and s and s.strip():
            splits[of_key.get(g, g)].add(s.strip().lower())
    expected = {g for g, _ in recorded if g is not None and len(splits[of_key.get(g, g)]) > 1}
    groups = spark.createDataFrame(recorded, "grp string, split string").withColumn("component_no", F.lit("clash"))
    found = [r.grp for r in split_conflicts(cases, groups, Scratch(spark, "t")).collect()]
    assert sorted(found) == sorted(expected) and "nobody" in expected and "lonely" not in expected


def test_empty_cases(spark):
    none, groups = spark.createDataFrame([], CASES), spark.createDataFrame([("a", "train"), ("a", "test")], "grp string, split string")
    assert case_components(none, Scratch(spark, "t")).count() == 0
    assert spanning_components(none, Scratch(spark, "t")).count() == 0
    assert assign_splits(none, Scratch(spark, "t")).count() == 0
    assert [r.grp for r in split_conflicts(none, groups, Scratch(spark, "t")).collect()] == ["a"]


def _sample(df, arrivals, spark, share=0.4):
    rows = grown_sample(df, arrivals, F.col("id"), F.col("raw_no"), share, Scratch(spark, "t"), 7).collect()
    return {r.raw_no for r in rows}


def test_sample_grows_and_repeats(spark):
    rows = raw_rows()
    df = spark.createDataFrame(rows, RAW)
    whole = _sample(df, [F.lit(True)], spark)
    assert whole == _sample(df.repartition(9), [F.col("delivery") <= k for k in (3, 6, 12)] + [F.lit(True)], spark)
    chosen_before = set()
    for k in (2, 5, 9, 12):
        now = _sample(df.where(F.col("delivery") <= k), [F.lit(True)], spark)
        assert chosen_before <= now
        chosen_before = now
    ids = {r[0]: r[1] for r in rows}
    for i in {x for x in ids.values() if x is not None}:
        assert len({no in whole for no, x in ids.items() if x == i}) == 1  # wholly or not at all
    assert 0.25 < len(whole) / len(rows) < 0.6


def test_threshold_never_falls(spark):
    df = spark.createDataFrame([(f"i{k}", k) for k in range(500)], "id string, raw_no long")
    sample = PermanentSample(Scratch(spark, "t"), 1)
    with pytest.raises(ValueError):
        sample.select(0.1)
    sample.insert(df.where("raw_no < 250"), F.col("id"), F.col("raw_no"))
    first = {r.identity for r in sample.select(0.5).collect()}
    assert {r.identity for r in sample.select(0.2).collect()} == first
    sample.insert(df, F.col("id"), F.col("raw_no"))
    assert first < {r.identity for r in sample.select(0.2).collect()}
    assert sample.known.count() == sample.known.select("identity").distinct().count() == 500


def test_sample_goes_on_where_it_was(spark, tmp_path):
    """Another session opens the folder: values and threshold are there, a broken batch is repeated."""
    df = spark.createDataFrame([(f"i{k}", k) for k in range(300)], "id string, raw_no long")
    folder = Scratch(spark, "t", str(tmp_path / "sample"))
    first = PermanentSample(folder, 1)
    first.insert(df.where("raw_no < 100"), F.col("id"), F.col("raw_no"))
    chosen = {r.identity for r in first.select(0.6).collect()}
    (tmp_path / "sample/numbers/batch=1").mkdir()  # an insert that broke off
    again = PermanentSample(Scratch(spark, "t", str(tmp_path / "sample")), 1)
    assert again.threshold == 0.6 and again.batches == 1
    again.insert(df, F.col("id"), F.col("raw_no"))
    assert chosen < {r.identity for r in again.select(0.1).collect()}
    assert again.known.count() == 300
    # The value of first sight stays, whatever the seed is later.
    other = PermanentSample(Scratch(spark, "t", str(tmp_path / "sample")), 99)
    assert {r.identity: r.u for r in other.known.collect()} == {r.identity: r.u for r in again.known.collect()}


def _shapes(size):
    path = [(i, i + 1) for i in range(size)]
    star = [(0, i) for i in range(1, size)]
    side = int(size**0.5)
    grid = [(a * side + b, a * side + b + 1) for a in range(side) for b in range(side - 1)] + [(a * side + b, a * side + side + b) for a in range(side - 1) for b in range(side)]
    return {"path": path, "star": star, "grid": grid}


@pytest.mark.parametrize("shape", ["path", "star", "grid"])
def test_a_level_leaves_few_edges(spark, shape):
    """Growth is not cut off: about RATE of the edges at most lie between clusters, and clusters hang together."""
    import caseloom.llm.components as module

    edges = _shapes(900)[shape]
    df = spark.createDataFrame(edges, "u long, v long")
    clusters, nodes, _ = module._grown(df, Scratch(spark, "t"), "grown", 5)
    of = {r.u: r.c for r in clusters.collect()}
    assert len(of) == nodes == len({x for e in edges for x in e})
    cut = sum(of[a] != of[b] for a, b in edges)
    assert cut <= (module.RATE + module.STILL) * len(edges)
    inside = defaultdict(list)
    for a, b in edges:
        if of[a] == of[b]:
            inside[a].append(b)
            inside[b].append(a)
    for c in set(of.values()):
        members, seen = {x for x in of if of[x] == c}, set()
        todo = [min(members)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += inside[x]
        assert seen == members


@pytest.mark.parametrize("small", [0, 30])
def test_growth_with_larger_tables(spark, monkeypatch, small):
    """The shuffled steps, and those that write their changes only, give the same components."""
    import caseloom.llm.components as module

    monkeypatch.setattr(module, "SMALL", small)
    monkeypatch.setattr(module, "MERGED", 3)
    edges = [(i, i + 1) for i in range(400) if i % 67] + [(1000 + i % 3, 1003 + i) for i in range(40)]
    found = {r.node: r.component for r in components_by_decomposition(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    expected = {r.node: r.component for r in components_by_stars(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert found == expected and len(set(found.values())) > 5


def test_splits_do_not_move_as_data_grow(spark, rows):
    """Later deliveries move no group key whose component keeps its number: by the hash alone, and where giants were
    placed and remembered."""
    cases = spark.createDataFrame(rows, CASES)
    for more in ({"giant": None}, {"giant": 1 / 20, "memory": Scratch(spark, "lasting")}):
        before = {r.group_key: r for r in assign_splits(cases.where(F.col("case_no") % 10 > 2), Scratch(spark, "t"), **more).collect()}
        after = {r.group_key: r for r in assign_splits(cases, Scratch(spark, "t"), **more).collect()}
        same = [g for g, r in before.items() if after[g].component_no == r.component_no]
        assert len(same) > 20 and all(after[g].split == before[g].split for g in same)
        assert {r.split for r in after.values()} == {"train", "validation", "test"}


def test_hashed_shares(spark):
    """Fixed ranges: many small components come out in the given shares."""
    cases = spark.createDataFrame([(i, (f"g{i // 2}", None), "", "", "") for i in range(6000)], CASES)
    split = Counter(r.split for r in assign_splits(cases, Scratch(spark, "t"), giant=None).collect())
    assert abs(split["train"] / 3000 - 0.8) < 0.03 and abs(split["test"] / 3000 - 0.1) < 0.02


def test_batches_of_a_sample_are_merged(spark, tmp_path, monkeypatch):
    import caseloom.llm.sampling as module

    monkeypatch.setattr(module, "MERGED", 2)
    df = spark.createDataFrame([(f"i{k}", k) for k in range(120)], "id string, raw_no long")
    folder = str(tmp_path / "sample")
    sample = PermanentSample(Scratch(spark, "t", folder), 1)
    for k in range(1, 7):
        sample.insert(df.where(F.col("raw_no") < 20 * k), F.col("id"), F.col("raw_no"))
    assert sorted(p.name for p in (tmp_path / "sample/merged").iterdir()) == ["upto=4"] and len(list((tmp_path / "sample/numbers").iterdir())) == 2
    again = PermanentSample(Scratch(spark, "t", folder), 1)
    whole = PermanentSample(Scratch(spark, "t"), 1)
    whole.insert(df, F.col("id"), F.col("raw_no"))
    for found in (sample, again):
        assert sorted(map(tuple, found.known.collect())) == sorted(map(tuple, whole.known.collect()))
    (tmp_path / "sample/merged/upto=9").mkdir()  # a merge that broke off
    assert PermanentSample(Scratch(spark, "t", folder), 1).known.count() == 120
