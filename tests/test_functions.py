"""Text and decision functions against plain Python."""

import hashlib
import json
import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from caseloom.functions import decisions as D
from caseloom.functions import text as X


def one(spark, column, **values):
    """A column's value over one row of the given values."""
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first().r


TEXTS = ["plain", "", " a\tb　c \n", "引号\"反斜\\/", "é é", "line\nbreak", "😀 ok"]


@pytest.mark.parametrize("text", TEXTS)
def test_text_functions(spark, text):
    value = {"t": ("string", text)}
    assert one(spark, X.json_quote(F.col("t")), **value) == json.dumps(text, ensure_ascii=False)
    assert one(spark, X.collapse_space(F.col("t")), **value) == " ".join(text.split())
    assert one(spark, X.non_blank(F.col("t")), **value) == bool(text.strip())
    expected = "k:" + hashlib.sha256(json.dumps(" ".join(unicodedata.normalize("NFC", text).split()), ensure_ascii=False).encode()).hexdigest()
    assert one(spark, X.group_key("k", F.col("t")), **value) == expected
    h = hashlib.sha256(json.dumps(["5", text], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, X.hash_fraction(F.col("t"), 5), **value) == int(h[:16], 16) / 2**64


def test_nulls(spark):
    value = {"t": ("string", None)}
    assert one(spark, X.json_quote(F.col("t")), **value) is None
    assert one(spark, X.non_blank(F.col("t")), **value) is False
    assert one(spark, X.group_key("k", F.col("t")), **value) is None
    assert one(spark, X.canonical_json(F.col("t")), **value) is None


@pytest.mark.parametrize("text, compact, readable", [('{ "b" :1, "a":[1, 2.50]}', '{"b":1,"a":[1,2.5]}', '{"b": 1, "a": [1, 2.5]}'), ("[NaN]", None, None), ("{", None, None), ('"é"', '"é"', '"é"')])
def test_canonical_json(spark, text, compact, readable):
    value = {"t": ("string", text)}
    assert one(spark, X.canonical_json(F.col("t")), **value) == compact
    assert one(spark, X.canonical_json(F.col("t"), "readable"), **value) == readable


def test_repeated_fields(spark):
    assert one(spark, X.has_repeated_fields(F.col("t")), t=("string", '{"a":1,"a":2}')) is True
    assert one(spark, X.has_repeated_fields(F.col("t")), t=("string", '{"a":1,"b":2}')) is False


@pytest.mark.parametrize("i, key", [(0, "A"), (25, "Z"), (26, "option_26")])
def test_option_letter(spark, i, key):
    assert one(spark, X.option_letter(F.col("i")), i=("int", i)) == key


@pytest.mark.parametrize("names, expected", [(("cmedqa2_train", None), "cmedqa2"), (("dialmed", None), "dialmed"), (("", None), "unknown"), ((None, "x_dev"), "x")])
def test_source_names(spark, names, expected):
    assert one(spark, X.source_family_of(F.col("a"), F.col("b")), a=("string", names[0]), b=("string", names[1])) == expected


@pytest.mark.parametrize("n, bucket", [(1, 128), (128, 128), (129, 256)])
def test_length_bucket(spark, n, bucket):
    assert one(spark, X.length_bucket(F.col("n")), n=("int", n)) == bucket


@pytest.mark.parametrize("text, letters", [("A", ["A"]), ("A、C", ["A", "C"]), ("BD", ["B", "D"]), ("AA", None), ("a", None), ("A;B", None), (None, None)])
def test_answer_letters(spark, text, letters):
    assert one(spark, X.answer_letters(F.col("t")), t=("string", text)) == letters


def test_url_document(spark):
    assert one(spark, X.url_document(F.col("u")), u=("string", "https://Law.Example.org/a/b?x=1&id=7&y=2#z")) == "law.example.org/a/b?id=7"
    assert one(spark, X.url_document(F.col("u")), u=("string", "https://e.org/a")) == "e.org/a"


def test_spans(spark):
    assert one(spark, X.span_matches(F.col("t"), F.lit(2), F.lit("😀b")), t=("string", "啊a😀b")) is True
    assert one(spark, X.span_matches(F.col("t"), F.lit(1), F.lit("😀b")), t=("string", "啊a😀b")) is False


def test_options(spark):
    def texts(kind, keys, desc):
        return one(spark, D.option_texts(F.lit(kind), F.col("k"), F.col("d")), k=("array<string>", keys), d=("array<string>", desc))

    assert texts("choice", ["A", "B"], ["x", None]) == ["A: x", "B"]
    assert texts("score", ["0", "1"], ["low", "high"]) == ["level 0: low", "level 1: high"]
    assert texts("noul", ["false", "true"], [None, "y"]) == ["false: " + D.FALSE_TEXT, "true: y"]


def test_distributions(spark):
    value = lambda p: {"p": ("array<double>", p)}
    for p, good in (([0.5, 0.5], True), ([0.5, 0.50005], True), ([0.5, 0.6], False), ([1.5, -0.5], False), ([float("nan"), 1.0], False), ([None, 1.0], False), (None, False)):
        assert one(spark, D.is_distribution(F.col("p")), **value(p)) is good
    assert one(spark, D.first_largest(F.col("p")), **value([0.2, 0.4, 0.4])) == 1
    assert one(spark, D.normalized(F.col("p")), **value([0.0, 0.0])) is None
    m = {"m": ("map<string,double>", {"A": 0.2, "B": 0.8})}
    assert one(spark, D.target_of(F.array(F.lit("B"), F.lit("A"), F.lit("C")), F.col("m")), **m) == [0.8, 0.2, 0.0]


def test_scores(spark):
    logits, target = [0.3, -1.2, 2.0, 700.0], [0.1, 0.2, 0.3, 0.4]
    top = max(logits)
    e = [math.exp(x / 2 - top / 2) for x in logits]
    p = [x / sum(e) for x in e]
    row = {"l": ("array<double>", logits), "t": ("array<double>", target)}
    soft = D.softmax(F.col("l"), 2.0)
    assert one(spark, soft, **row) == pytest.approx(p)
    logs = sum(t * max(math.log(max(x, 1e-12)), -9.21) for t, x in zip(target, p))
    sph = sum(t * x for t, x in zip(target, p)) / math.sqrt(sum(x * x for x in p))
    run = [sum(p[: i + 1]) - sum(target[: i + 1]) for i in range(4)]
    rps = sum(x * x for x in run) / 3
    assert one(spark, D.proper_reward(F.lit("score"), soft, F.col("t")), **row) == pytest.approx(logs + 0.5 * sph - rps)
    assert one(spark, D.proper_reward(F.lit("choice"), soft, F.col("t")), **row) == pytest.approx(logs + 0.5 * sph)
    assert one(spark, D.entropy_confidence(F.array(F.lit(0.5), F.lit(0.5)))) == pytest.approx(0.0)
    assert one(spark, D.entropy_confidence(F.array(F.lit(1.0)))) == 1.0


@pytest.mark.parametrize("c, bin_", [(0.0, 1), (1 / 15, 1), (0.0667, 2), (1.0, 15), (0.5, 8)])
def test_bins(spark, c, bin_):
    assert one(spark, D.calibration_bin(F.lit(c))) == bin_
