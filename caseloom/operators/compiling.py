"""Token sequences of decisions: a strict layout that rejects what doesn't fit, a lenient one that clips, rebuilding at
another length, padding. Layouts are array expressions over token arrays; only real tokenizers need Python.

Layout: [CLS] kind and instruction [SEP] ([MASK] option)* [SEP] state [SEP]; markers are the places of the masks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decisions as D
from .lengths import HEAD_ROOM, OPTION_TOKENS

#: Longest state that the lenient layout keeps, in tokens.
STATE_CAP = 65_536


@dataclass(frozen=True)
class Tokens:
    """What a layout needs of a tokenizer: column functions from a text and from a list of texts to ids, and the
    special ids."""

    encode: Callable[[Column], Column]
    encode_all: Callable[[Column], Column]
    cls: int = 1
    sep: int = 2
    mask: int = 3
    pad: int = 0
    mask_text: str = "[MASK]"

    def clean(self, text: Column) -> Column:
        """A mask's text within data becomes a blank."""
        return F.replace(text, F.lit(self.mask_text), F.lit(" "))


def character_tokens() -> Tokens:
    """One token for each character: its code point plus 10. Native, for tests and length planning."""
    empty = F.array().cast("array<int>")

    def encode(t: Column) -> Column:
        return F.when(F.length(t) > 0, F.transform(F.split(t, ""), lambda c: (F.ascii(c) + 10).cast("int"))).otherwise(empty)

    return Tokens(encode, lambda texts: F.transform(texts, encode))


def library_tokens(path: str, cls: str, sep: str, mask: str, pad: str) -> Tokens:
    """A tokenizer file of a public library, loaded once in each Python worker."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)

    loaded: dict = {}

    def tokenizer() -> Tokenizer:
        if "t" not in loaded:
            loaded["t"] = Tokenizer.from_file(path)
        return loaded["t"]

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([e.ids for e in tokenizer().encode_batch(texts.fillna("").tolist(), add_special_tokens=False)])

    @F.pandas_udf("array<array<int>>")
    def lists(texts: pd.Series) -> pd.Series:
        return pd.Series([None if ts is None else [e.ids for e in tokenizer().encode_batch(list(ts), add_special_tokens=False)] for ts in texts])

    return Tokens(ids, lists, *[known.token_to_id(x) for x in (cls, sep, mask, pad)], mask)


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, n: a + n)


def option_lengths(options: Column) -> Column:
    return F.transform(options, F.size)


def _encoded(rows: DataFrame, tok: Tokens, state: str) -> DataFrame:
    """``_head``, ``_options`` (each with its marker) and ``_body`` of rows with ``qtype``, ``instructions``,
    ``option_keys``, ``option_desc`` and a state text."""
    texts = D.option_texts(F.col("qtype"), F.col("option_keys"), F.col("option_desc"))
    with_texts = rows.withColumn("_texts", texts)
    coded = tok.encode_all(F.transform("_texts", lambda t: F.concat(F.lit(" "), tok.clean(t))))
    marked = F.transform(coded, lambda ids: F.concat(F.array(F.lit(tok.mask)), ids))
    return with_texts.withColumns(
        {
            "_head": tok.encode(F.concat(F.col("qtype"), F.lit(" question: "), tok.clean(F.col("instructions")))),
            "_options": F.when(F.size("_texts") > 0, marked),
            "_body": tok.encode(tok.clean(F.col(state))),
        }
    )


def _prefix(tok: Tokens, head: Column, options: Column) -> tuple[Column, Column]:
    """Tokens up to the second separator, and the places of the markers."""
    prefix = F.concat(F.array(F.lit(tok.cls)), head, F.array(F.lit(tok.sep)), F.flatten(options), F.array(F.lit(tok.sep)))
    start = F.struct((F.size(head) + 2).alias("at"), F.array().cast("array<int>").alias("places"))
    step = lambda a, o: F.struct((a["at"] + F.size(o)).alias("at"), F.concat(a["places"], F.array(a["at"])).alias("places"))
    return prefix, F.aggregate(options, start, step, lambda a: a["places"])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it; plain columns would be copied into
    each other by the optimizer."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _with(struct: Column, names: str, **more: Column) -> Column:
    return F.struct(*[struct[n].alias(n) for n in names.split()], *[v.alias(k) for k, v in more.items()])


def _parts() -> Column:
    return F.struct(F.col("_head").alias("head"), F.col("_options").alias("options"), F.col("_body").alias("body"))


def strict_items(rows: DataFrame, tok: Tokens, cap: int, head_cap: int, cut_state: bool = False, state: str = "state_text") -> DataFrame:
    """Compiled items, or a reason. Adds ``ids``, ``markers``, ``state_tokens``, ``state_kept``, ``state_cut`` and
    ``reason``; where there is a reason, ids and markers are null. The gold plays no part in the layout."""

    def clipped(a: Column) -> Column:
        clip = F.transform(a["options"], lambda o: F.slice(o, 1, OPTION_TOKENS + 1))
        return _with(a, "head options body", clip=clip, budget=F.lit(head_cap) - _sum(option_lengths(clip)))

    def narrowed(a: Column) -> Column:
        """Where the options leave too little, they are clipped further, which always shows as a cut option."""
        narrow = F.greatest(F.lit(4), F.floor(F.lit(head_cap - HEAD_ROOM) / F.greatest(F.size(a["clip"]), F.lit(1))).cast("int"))
        clip = F.when(a["budget"] < HEAD_ROOM, F.transform(a["clip"], lambda o: F.slice(o, F.lit(1), narrow))).otherwise(a["clip"])
        return let(clip, lambda c: _with(a, "head options body", clip=c, budget=F.lit(head_cap) - _sum(option_lengths(c))))

    def laid_out(a: Column) -> Column:
        prefix, places = _prefix(tok, a["head"], a["clip"])
        room = lambda p: F.greatest(F.lit(0), F.lit(cap - 1) - F.size(p))
        return let(prefix, lambda p: _with(a, "head options body clip budget", prefix=p, places=places, room=room(p), tokens=F.size(a["body"])))

    def judged(a: Column) -> Column:
        reason = (
            F.when(a["options"].isNull(), "no_candidate_options")
            .when(a["clip"] != a["options"], "option_text_truncated")
            .when(F.size(a["head"]) > F.greatest(F.lit(8), a["budget"]), "question_instruction_truncated")
            .when((a["tokens"] > a["room"]) & F.lit(not cut_state), "state_truncated")
            .when((a["tokens"] == 0) | (a["room"] == 0), "empty_state_tokens")
        )
        ids = F.concat(a["prefix"], F.slice(a["body"], F.lit(1), a["room"]), F.array(F.lit(tok.sep)))
        return let(reason, lambda r: F.struct(
            r.alias("reason"), F.when(r.isNull(), ids).alias("ids"), F.when(r.isNull(), a["places"]).alias("markers"),
            a["tokens"].alias("state_tokens"), F.least(a["tokens"], a["room"]).alias("state_kept"), (a["tokens"] > a["room"]).alias("state_cut"),
        ))

    item = let(let(let(let(_parts(), clipped), narrowed), laid_out), judged)
    return _encoded(rows, tok, state).withColumn("_item", item).select(*rows.columns, "_item.*")


def lenient_prompts(rows: DataFrame, tok: Tokens, head_cap: int, state: str = "state_text") -> DataFrame:
    """Prompt and state apart, for rebuilding at any length. Adds ``prompt``, ``markers``, ``state_ids``,
    ``state_cut`` and ``reason``: options that leave the instruction fewer than 16 tokens would be clipped beyond
    recognition, so such a row is skipped; long options and instructions are clipped."""

    def clipped(a: Column) -> Column:
        clip = F.transform(a["options"], lambda o: F.slice(o, 1, OPTION_TOKENS + 1))
        return _with(a, "head options body", clip=clip, budget=F.lit(head_cap) - _sum(option_lengths(clip)))

    def laid_out(a: Column) -> Column:
        prefix, places = _prefix(tok, F.slice(a["head"], F.lit(1), F.greatest(F.lit(8), a["budget"])), a["clip"])
        reason = F.when(a["options"].isNull(), "no options").when(a["budget"] < HEAD_ROOM, "head too small for its options")
        return let(reason, lambda r: F.struct(
            r.alias("reason"), F.when(r.isNull(), prefix).alias("prompt"), F.when(r.isNull(), places).alias("markers"),
            F.slice(a["body"], 1, STATE_CAP).alias("state_ids"), (F.size(a["body"]) > STATE_CAP).alias("state_cut"),
        ))

    item = let(let(_parts(), clipped), laid_out)
    return _encoded(rows, tok, state).withColumn("_item", item).select(*rows.columns, "_item.*")


def rebuilt(prompt: Column, state: Column, cap: Column, sep: int, left: bool = False) -> Column:
    """The sequence at a length: prompt, as much state as fits (its end with ``left``) and a separator; null where the
    prompt itself doesn't fit."""
    room = F.greatest(F.lit(0), cap - F.size(prompt) - 1)
    kept = F.slice(state, F.greatest(F.lit(1), F.size(state) - room + 1), room) if left else F.slice(state, F.lit(1), room)
    return F.when(F.size(prompt) + 1 <= cap, F.concat(prompt, kept, F.array(F.lit(sep))))


def padded(ids: Column, width: Column, pad: int) -> Column:
    """Ids filled up to the batch's width."""
    return F.concat(ids, F.array_repeat(F.lit(pad), (width - F.size(ids)).cast("int")))


def marker_mask(markers: Column, width: Column) -> Column:
    """1 for each marker, then 0 up to the batch's most markers."""
    return F.concat(F.transform(markers, lambda m: F.lit(1)), F.array_repeat(F.lit(0), (width - F.size(markers)).cast("int")))
