"""Column functions on text: white space, JSON quoting, digests, group keys and hash fractions.

All are native expressions but :func:`nfc` and :func:`canonical_json`, which need Arrow UDFs."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split sees it.
SPACE = r"[\x09-\x0d\x1c-\x1f\x{85}\p{Z}]"


def collapse_space(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def non_blank(text: Column) -> Column:
    """True for a text with anything but white space; false for null."""
    return F.coalesce(text.rlike(r"[^\x09-\x0d\x1c-\x1f\x{85}\p{Z}]"), F.lit(False))


def json_quote(text: Column) -> Column:
    """A text as a JSON string. Null for null."""
    quoted = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def json_list(*texts: Column) -> Column:
    """A compact JSON array of texts."""
    return F.to_json(F.array(*texts))


def digest(text: Column) -> Column:
    """SHA-256 of a text, in hex."""
    return F.sha2(text, 256)


def hash_fraction(key: Column, seed: int | str) -> Column:
    """A place in [0, 1) fixed by key and seed: the first 64 bits of the digest of both over 2^64."""
    h = digest(json_list(F.lit(str(seed)), key))
    return F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)


def nfc(text: Column) -> Column:
    """Canonical composition; null for null."""

    @F.pandas_udf("string")
    def composed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))

    return composed(text)


def group_key(kind: str, text: Column, compose: bool = True) -> Column:
    """``kind:digest`` of the text, composed and with collapsed white space, as a JSON string."""
    value = nfc(text) if compose else text
    return F.concat(F.lit(kind + ":"), digest(json_quote(collapse_space(value))))


def canonical_json(text: Column, style: str = "compact") -> Column:
    """JSON written again in insertion order without white space (``compact``) or with a blank after commas and colons
    (``readable``). Null for null, for what is no JSON and for NaN or infinite numbers. Last of equal keys wins."""
    separators = {"compact": (",", ":"), "readable": (", ", ": ")}[style]

    def write(value):
        try:
            return json.dumps(json.loads(value), ensure_ascii=False, allow_nan=False, separators=separators)
        except (TypeError, ValueError):
            return None

    @F.pandas_udf("string")
    def written(values: pd.Series) -> pd.Series:
        return values.map(write)

    return written(text)


def has_repeated_fields(text: Column) -> Column:
    """Whether a JSON object has a key twice at its top level."""
    keys = F.json_object_keys(text)
    return F.coalesce(F.size(keys) != F.size(F.array_distinct(keys)), F.lit(False))


def option_letter(index: Column) -> Column:
    """A to Z, then option_26 and so on."""
    return F.when(index < 26, F.char((index + 65).cast("int"))).otherwise(F.concat(F.lit("option_"), index.cast("string")))


def source_family_of(*names: Column) -> Column:
    """First non-empty name, less one ending that names a split; ``unknown`` without any."""
    first = F.coalesce(*[F.when(n != "", n) for n in names], F.lit("unknown"))
    return F.regexp_replace(first, "(_train|_validation|_val|_test|_dev)$", "")


def length_bucket(length: Column, width: int = 128) -> Column:
    """Upper end of the bucket of ``width`` that holds a length of at least 1."""
    return (F.floor((length - 1) / width) * width + width).cast("long")


def url_document(url: Column) -> Column:
    """Host and path of a URL and its query's id: what names a document. Null where the URL can't be read."""
    host, path, key = (F.try_parse_url(url, F.lit(p)) for p in ("HOST", "PATH", "QUERY"))
    return F.concat(F.lower(host), F.coalesce(path, F.lit("")), F.coalesce(F.concat(F.lit("?id="), F.nullif(F.regexp_extract(F.coalesce(key, F.lit("")), r"(?:^|&)id=([^&]*)", 1), F.lit(""))), F.lit("")))


def answer_letters(text: Column) -> Column:
    """Letters of an answer like ``A、C`` or ``BD``; null where it is none or repeats a letter."""
    found = F.regexp_extract_all(text, F.lit("([A-Z])"), F.lit(1))
    good = text.rlike(r"^[A-Z](?:[A-Z]|[,，、\s]+[A-Z])*$") & (F.size(found) == F.size(F.array_distinct(found)))
    return F.when(good, found)


def span_matches(text: Column, start: Column, entity: Column) -> Column:
    """Whether ``entity`` stands at code point ``start`` (from 0) of the text."""
    return F.coalesce(F.substring(text, (start + 1).cast("int"), F.length(entity)) == entity, F.lit(False))
