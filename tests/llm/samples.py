"""Small tables in the shape of the project's, made from a seed, and the plain versions the operators are held against."""

from __future__ import annotations

import random

from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()
SLOT = T.StructType([T.StructField("name", _S), T.StructField("value", _S)])
STATE = T.StructType([T.StructField("text", _S), T.StructField("question", _S), T.StructField("slots", T.ArrayType(SLOT))])
#: Extra columns have names that the operators use inside.
RAW = T.StructType(
    [T.StructField(n, t) for n, t in (("raw_no", _L), ("id", _S), ("type", _S), ("state", STATE), ("instruction", _S), ("delivery", T.IntegerType()), ("text", _S), ("content", _S), ("n", _L), ("u", _S), ("identity", _S))]
)
META = T.StructType([T.StructField("group_key", _S), T.StructField("link_keys", T.ArrayType(_S))])
CASES = T.StructType([T.StructField("case_no", _L), T.StructField("_meta", META), T.StructField("node", _S), T.StructField("key", _S), T.StructField("component", _S)])

_WORDS = "头晕 患者 合同 租客 退款 血压 Ñandu paid cox HE AOP 12.5mg Ⅱ型 °C x² note of the driver 口干 门诊".split()


def variants(rng: random.Random, text: str) -> str:
    """Another spelling of the same look."""
    swap = {"a": "а", "o": "ο", "e": "е", "H": "Н", "A": "Α", "P": "Р", " ": " ", "口": "⼝", "门": "⻔", "C": "С"}
    out = []
    for ch in text:
        x = rng.random()
        out.append(swap[ch] if ch in swap and x < 0.4 else chr(ord(ch) + 0xFEE0) if "!" < ch < "~" and x > 0.8 else ch + "​" if x > 0.75 else ch)
    return "".join(out)


def untidy(rng: random.Random, text: str) -> str:
    """Another format of the same content."""
    return "".join(rng.choice([ch, ch.upper(), ch.lower()]) + rng.choice(["", "", "", " ", "，"]) * (not ch.isdigit() and ch != ".") for ch in text)


def raw_rows(seed: int = 5, count: int = 260) -> list[tuple]:
    rng = random.Random(seed)
    rows: list[tuple] = []
    for no in range(1, count + 1):
        x = rng.random()
        if rows and x < 0.45:
            _, _, kind, (text, question, slots), instruction, *_ = rng.choice(rows)
            change = rng.random()
            if change < 0.35:
                text, question = (variants(rng, t) if t else t for t in (text, question))
            elif change < 0.7:
                text, question = (untidy(rng, t) if t else t for t in (text, question))
                slots = rng.sample(slots, len(slots)) if slots else slots
            elif text:
                at = rng.randrange(len(text) + 1)
                text = text[:at] + rng.choice(_WORDS) + text[at + 2 :]
        else:
            text = None if x > 0.95 else "".join(rng.choice(["", " "]) + rng.choice(_WORDS) for _ in range(rng.choice([0, 3, 12, 25, 25, 25])))
            question = rng.choice([None, "", " ", rng.choice(_WORDS) + "?"])
            slots = rng.choice([None, [], [("dept", "7"), ("药名", None)], [(None, "x"), ("dept", rng.choice("12")), ("dept", "1")]])
            kind, instruction = rng.choice([None, "noul", "score"]), rng.choice([None, "", "Rate it.", "rate  it"])
        rows.append((no, rng.choice([None, "r1", f"r{no}", f"r{no}", "r2"]), kind, (text, question, slots), instruction, rng.randint(1, 12), "clash", "clash", 1, "clash", "clash"))
    long = "长文本 long " * 4000
    rows += [(count + 1, "x", "noul", (long, None, None), None, 1, *["c"] * 2, 1, *["c"] * 2), (count + 2, "x", "noul", (long + "!", None, None), None, 1, *["c"] * 2, 1, *["c"] * 2)]
    rows.append((count + 3, None, None, (None, None, None), None, None, None, None, None, None, None))
    return rows


def case_rows(seed: int = 9, count: int = 200) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for no in range(1, count + 1):
        group = rng.choice([None, "hot", *(f"g{rng.randrange(90)}" for _ in range(6))])
        links = rng.choice([None, [], ["", None, " ", "\t"], [f"k{rng.randrange(120)}"], [f"k{rng.randrange(120)}", f"k{rng.randrange(120)}", None], ["g1", "g1"]])
        out.append((no, (group, links), "clash", "clash", "clash"))
    return out


def plain_components(rows: list[tuple]) -> dict[int, int]:
    """Smallest case number of each case's component, by union-find."""
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for no, (group, links), *_ in rows:
        keys = ([("g", group)] if group is not None else []) + [("l", k) for k in links or [] if k is not None and k.strip()]
        root(no)
        for k in keys:
            parent[root(k)] = root(no)
    least: dict = {}
    for no, *_ in rows:
        r = root(no)
        least[r] = min(least.get(r, no), no)
    return {no: least[root(no)] for no, *_ in rows}
