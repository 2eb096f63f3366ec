"""Problem 4: near-duplicate records by banded signatures, sequential Bayesian pruning and exact checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Scratch, heaviest, hot_keys, salted_lookup
from . import grouping
from .components import components_by_decomposition
from .lookforms import LookForm, contents
from .textforms import raw_bigrams


@dataclass(frozen=True)
class NearDuplicates:
    """``threshold``: least similarity (shared over all distinct pieces of ``piece`` characters). :meth:`recall` tells how
    surely a pair of some similarity is found; just above the threshold it is less than for pairs of 0.65 and more.
    ``rows`` x ``bands`` minimum hashes: a pair of similarity s becomes a candidate with 1 - (1 - s^rows)^bands. More
    rows leave far fewer chance candidates, whose number grows with the square of the corpus; more bands make up for
    the recall. ``kept`` hashes serve the comparison of candidates. ``miss``: a candidate is dropped only if, after a
    batch of ``batch`` hashes, its posterior probability of reaching the threshold is below this."""

    threshold: float = 0.6
    piece: int = 4
    rows: int = 5
    bands: int = 64
    kept: int = 160
    batch: int = 32
    miss: float = 1e-4
    seed: int = 20_04

    def recall(self, similarity: float) -> float:
        return 1 - (1 - similarity**self.rows) ** self.bands

    def bounds(self) -> list[tuple[int, int]]:
        """For each batch end, the least number of equal one-byte hashes that keeps a candidate.

        Posterior of the similarity s under a uniform prior when m of n hashes agree; a hash agrees with probability
        s + (1 - s) / 256."""
        grid = (np.arange(4000) + 0.5) / 4000
        agree = grid + (1 - grid) / 256
        out = []
        for n in range(self.batch, self.kept + 1, self.batch):
            m = np.arange(n + 1)[:, None]
            weight = m * np.log(agree) + (n - m) * np.log1p(-agree)
            weight = np.exp(weight - weight.max(axis=1, keepdims=True))
            above = weight[:, grid >= self.threshold].sum(axis=1) / weight.sum(axis=1)
            out.append((n, int(np.argmax(above >= self.miss))))
        return out


_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xBF58476D1CE4E5B9)
#: Code points that are hashed at once; one hash of them all stays in a core's own cache.
_AT_ONCE = 60_000
#: Band keys of which a task keeps a count, and how often a batch of texts must hold one. A key that no task tells of is
#: in fewer than TOLD texts of every batch, so in less than one in a thousand of all with batches of 10,000.
COUNTED, TOLD = 1 << 16, 8
#: Pairs of one Arrow batch.
_PAIRS = 1 << 18
#: Band rows of a bucket, as far as BUCKETS buckets are enough; band rows that a task deals out to buckets at once.
PER_BUCKET, BUCKETS, _DEALT = 1 << 18, 1 << 16, 1 << 22


def _pieces(texts: list[str], piece: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all pieces of ``piece`` characters, text after text, and where each text starts. Every text has
    at least one piece; a piece that a text repeats is there as often, which changes no minimum."""
    lengths = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    count = len(codes) - piece + 1
    h = codes[:count] * _MIX
    for k in range(1, piece):
        h ^= codes[k : count + k]
        h *= _MIX
        h ^= h >> np.uint64(29)
    h *= _END
    whole = np.ones(count, dtype=bool)
    ends = np.cumsum(lengths)[:-1]
    for k in range(1, piece):
        whole[ends - k] = False
    own = lengths - piece + 1
    return (h[whole] >> np.uint64(32)).astype(np.uint32), np.cumsum(own) - own


def signatures(texts: list[str], p: NearDuplicates) -> np.ndarray:
    """Minimum hashes, one row of rows x bands 32-bit values for each text; every text has at least one piece."""
    count = p.rows * p.bands
    rng = np.random.default_rng(p.seed)
    factors = rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 2**32, count, dtype=np.uint32)
    out = np.empty((len(texts), count), dtype=np.uint32)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < _AT_ONCE):
            size += len(texts[end])
            end += 1
        flat, starts = _pieces(texts[at:end], p.piece)
        h = np.empty_like(flat)
        for k in range(count):  # linear permutations of hashes that are mixed well
            np.multiply(flat, factors[k], out=h)
            np.add(h, shifts[k], out=h)
            out[at:end, k] = np.minimum.reduceat(h, starts)
        at = end
    return out


def band_keys(sig: np.ndarray, p: NearDuplicates) -> np.ndarray:
    """One key of 48 bits for each band, the band's number mixed in: short keys travel cheaper, and where two fall
    together by chance, that is one candidate more."""
    parts = sig.reshape(len(sig), p.bands, p.rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64) * _MIX, parts.shape[:2]).copy()
    for k in range(p.rows):
        h = (h ^ parts[:, :, k]) * _END
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(16)).view(np.int64)


class _Frequent:
    """Counts of keys that a batch holds ``least`` times or more, of at most COUNTED keys."""

    def __init__(self, least: int):
        self.least, self.counts = least, {}

    def add(self, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        last = keys[self.least - 1 :]
        often = np.unique(last[last == keys[: len(last)]])
        found = np.searchsorted(keys, often, "right") - np.searchsorted(keys, often)
        for key, n in zip(often.tolist(), found.tolist()):
            self.counts[key] = self.counts.get(key, 0) + n
        if len(self.counts) > COUNTED:
            self.counts = dict(sorted(self.counts.items(), key=lambda x: -x[1])[: COUNTED // 2])


def sign_texts(classes: DataFrame, p: NearDuplicates) -> DataFrame:
    """``(id, signature, key, n)``: of each text with a piece one byte of each of its first ``kept`` minimum hashes, and
    in rows of their own, without id, the band keys that a task saw often, with how often."""

    def run(batches):
        seen = _Frequent(TOLD)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = signatures(batch.column(1).to_pylist(), p)
            seen.add(band_keys(sig, p).ravel())
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(p.kept), len(sig), [None, pa.py_buffer((sig[:, : p.kept] & 0xFF).astype(np.uint8).tobytes())])
            none = pa.nulls(len(sig), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw.cast(pa.binary()), none, none], ["id", "signature", "key", "n"])
        keys, counts = (pa.array(list(x), pa.int64()) for x in (seen.counts.keys(), seen.counts.values()))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.binary()), keys, counts], ["id", "signature", "key", "n"])

    return classes.where(F.length("content") >= p.piece).select("id", "content").mapInArrow(run, "id long, signature binary, key long, n long")


def banded(classes: DataFrame, p: NearDuplicates, hot: dict[int, int], buckets: int) -> DataFrame:
    """``(bucket, hot, base, keys, ids)``: the band keys of the texts, dealt out to buckets by their hash and packed, many
    to a row: a key takes six bytes, an id four as far as the ids of a row lie close enough to its ``base``. Rows of hot
    keys are packed apart and spread over all buckets by their ids."""
    hot_keys_ = np.array(sorted(hot), dtype=np.int64)

    def packed(bucket: np.ndarray, is_hot: bool, keys: np.ndarray, ids: np.ndarray):
        if not len(keys):
            return
        order = np.argsort(bucket, kind="stable")
        keys, ids = keys[order], ids[order]
        cuts = np.cumsum(np.bincount(bucket, minlength=buckets))
        rows: dict[str, list] = {"bucket": [], "hot": [], "base": [], "keys": [], "ids": []}
        for at, (first, past) in enumerate(zip([0, *cuts[:-1].tolist()], cuts.tolist())):
            if first == past:
                continue
            k, i = keys[first:past], ids[first:past]
            base = int(i.min())
            near = int(i.max()) - base < 1 << 32
            rows["bucket"].append(at)
            rows["hot"].append(is_hot)
            rows["base"].append(base if near else None)
            rows["keys"].append((k & 0xFFFFFFFF).astype(np.uint32).tobytes() + (k >> 32).astype(np.uint16).tobytes())
            rows["ids"].append((i - base).astype(np.uint32).tobytes() if near else i.tobytes())
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), ("base", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary())]))

    def dealt(held: list[tuple[np.ndarray, np.ndarray]]):
        keys, ids = np.concatenate([k for k, _ in held]), np.concatenate([i for _, i in held])
        often = np.isin(keys, hot_keys_) if len(hot_keys_) else np.zeros(len(keys), dtype=bool)
        narrow = np.uint16 if buckets <= BUCKETS else np.int64
        where = lambda x: ((x.astype(np.uint64) * _MIX >> np.uint64(32)) % np.uint64(buckets)).astype(narrow)
        yield from packed(where(keys[~often]), False, keys[~often], ids[~often])
        yield from packed(where(ids[often]), True, keys[often], ids[often])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = band_keys(signatures(batch.column(1).to_pylist(), p), p).ravel()
            held.append((keys, np.repeat(batch.column(0).to_numpy(), p.bands)))
            size += len(keys)
            if size >= _DEALT:
                yield from dealt(held)
                held, size = [], 0
        if held:
            yield from dealt(held)

    return classes.where(F.length("content") >= p.piece).select("id", "content").mapInArrow(run, "bucket int, hot boolean, base long, keys binary, ids binary")


def _unpacked(base: int | None, keys: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(keys) // 6
    low, high = np.frombuffer(keys, dtype=np.uint32, count=n), np.frombuffer(keys, dtype=np.uint16, offset=4 * n)
    found = np.frombuffer(ids, dtype=np.int64) if base is None else np.frombuffer(ids, dtype=np.uint32).astype(np.int64) + base
    return low.astype(np.int64) | high.astype(np.int64) << 32, found


def _run_pairs(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Pairs inside runs of ``ids``, as arrays of at most about _PAIRS pairs."""
    for size in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(size, 1)
        own = starts[sizes == size]
        each = max(1, _PAIRS // len(i))
        for at in range(0, len(own), each):
            some = own[at : at + each, None]
            a, b = ids[(some + i).ravel()], ids[(some + j).ravel()]
            differ = a != b
            yield np.minimum(a, b)[differ], np.maximum(a, b)[differ]


def met_in_bands(bands: DataFrame, hot: dict[int, int]) -> DataFrame:
    """``(id_a, id_b, key, n)`` from packed bands: the pairs of ids that share a key, without key and n; and the rows of
    keys with more than BLOCK rows, ``id_a`` alone with the key and about how many rows it has.

    A task sorts one bucket at a time, and nothing is written for keys that one text has alone. Rows of hot keys only
    pass through, wherever they lie."""
    block, schema = grouping.BLOCK, ["id_a", "id_b", "key", "n"]

    def lone(keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(keys), pa.array(n)], schema)

    def met(parts: list[tuple[np.ndarray, np.ndarray]]):
        keys, ids = np.concatenate([k for k, _ in parts]), np.concatenate([i for _, i in parts])
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        many = np.repeat(sizes, sizes)
        if (many > block).any():
            yield lone(keys[many > block], ids[many > block], many[many > block])
        small = sizes <= block
        for a, b in _run_pairs(ids, starts[small], sizes[small]):
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], schema)

    def run(batches):
        now, held = None, []
        for batch in batches:
            for bucket, is_hot, base, keys, ids in zip(*(c.to_pylist() for c in batch.columns)):
                keys, ids = _unpacked(base, keys, ids)
                if is_hot:
                    yield lone(keys, ids, np.array([hot[k] for k in keys.tolist()]))
                    continue
                if bucket != now and held:
                    yield from met(held)
                    held = []
                now = bucket
                held.append((keys, ids))
        if held:
            yield from met(held)

    return bands.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "id_a long, id_b long, key long, n long")


def candidate_pairs(classes: DataFrame, signed: DataFrame, texts: int, p: NearDuplicates, scratch: Scratch) -> DataFrame:
    """``(id_a, id_b)``, each once, of classes that share a band; ``texts`` is the number of signed ones."""
    told = signed.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"))
    hot = {r[0]: r.n for r in heaviest(told, "key")}
    buckets = max(1, min(BUCKETS, -(-texts * p.bands // PER_BUCKET)))
    met = scratch.keep(met_in_bands(banded(classes, p, hot, buckets), hot), "met")
    pairs, large = met.where("key is null").select("id_a", "id_b"), met.where("key is not null")
    if large.limit(1).count():
        pairs = pairs.unionByName(grouping.paired_blocks(large.select("key", F.col("id_a").alias("id"), "n").dropDuplicates(["key", "id"]), "key", "id"))
    found = scratch.keep(pairs.distinct(), "candidates")
    scratch.drop("met")
    return found


def _at_both_ends(pairs: DataFrame, table: DataFrame, value: Column, hot: dict[str, list]) -> DataFrame:
    """``pairs`` with ``a`` and ``b``, the value of ``table(id, ...)`` at either end; ids with very many pairs, ``hot`` by
    end, are spread, and only what the table has for them is repeated."""
    for end, other in ("ab", "ba"):
        own = table.select(F.col("id").alias(f"id_{end}"), value.alias(end))
        pairs = salted_lookup(pairs, own, f"id_{end}", hot[end], F.xxhash64(f"id_{other}"))
    return pairs


def prune(pairs: DataFrame, p: NearDuplicates, past: int = 0, until: int | None = None) -> DataFrame:
    """Candidates left after the sequential comparison of hashes ``past`` to ``until``: ``(id_a, id_b, equal)``. Input
    ``(id_a, id_b, equal, a, b)``: ``a`` and ``b`` are these hashes, ``equal`` counts the equal ones before."""
    until = p.kept if until is None else until
    bounds, width = [x for x in p.bounds() if past < x[0] <= until], until - past

    def bytes_of(column: pa.Array) -> np.ndarray:
        column = column.cast(pa.binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = bytes_of(batch.column(3)), bytes_of(batch.column(4))
            alive, equal, before = np.arange(batch.num_rows), batch.column(2).to_numpy(), past
            for n, least in bounds:
                equal = equal + (a[alive, before - past : n - past] == b[alive, before - past : n - past]).sum(axis=1, dtype=np.int32)
                stays = equal >= least
                alive, equal, before = alive[stays], equal[stays], n
            kept = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(equal.astype(np.int32))], ["id_a", "id_b", "equal"])

    return pairs.select("id_a", "id_b", "equal", "a", "b").mapInArrow(run, "id_a long, id_b long, equal int")


def exact_similarity(piece: int):
    """A pandas UDF: shared over all distinct pieces of two texts; 0 where neither has a piece."""

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        out, sets = [], {}  # of one batch
        for x, y in zip(a, b):
            for z in (x, y):
                if z not in sets:
                    sets[z] = {z[i : i + piece] for i in range(len(z) - piece + 1)}
            s, t = sets[x], sets[y]
            both = len(s & t)
            out.append(both / (len(s) + len(t) - both) if s or t else 0.0)
        return pd.Series(out, dtype="float64")

    return similarity


def record_contents(raw: DataFrame, bigrams: dict[str, int] | None = None) -> DataFrame:
    """``(raw_no, content, digest)`` of rows with any content: that of the text followed by that of the question."""
    form = LookForm(raw_bigrams(raw) if bigrams is None else bigrams)

    def run(batches):
        for batch in batches:
            text, question = (contents(form.many(batch.column(k).to_pylist())) for k in (1, 2))
            found = [(x or "") + (y or "") for x, y in zip(text, question)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["raw_no", "content"])

    made = raw.select("raw_no", F.col("state.text").alias("text"), F.col("state.question").alias("question")).mapInArrow(run, "raw_no long, content string")
    return made.where("content <> ''").withColumn("digest", F.substring(F.unhex(F.sha2("content", 256)), 1, 16))


def similar_classes(raw: DataFrame, scratch: Scratch, p: NearDuplicates = NearDuplicates(), bigrams: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Membership ``(raw_no, id)`` of every row with content in the class of its content, whose id is its smallest
    raw_no, and links ``(id_a, id_b, similarity)`` between classes of at least the threshold.

    Copies are one class before anything is paired. Bands shared by many classes are paired in blocks, and a class with
    very many partners is spread. Contents shorter than a piece have no links. Null texts count as nothing; a repeated
    row counts once; extra columns don't matter."""
    rows = scratch.keep(record_contents(raw, bigrams), "contents")
    first = rows.groupBy("digest").agg(F.min("raw_no").alias("id"), F.min_by("content", "raw_no").alias("content"), F.count(F.lit(1)).alias("n"))
    classes = scratch.keep(first, "classes")
    members = scratch.keep(salted_lookup(rows.select("raw_no", "digest"), classes.select("digest", "id"), "digest", heaviest(classes, "digest"), F.xxhash64("raw_no")).select("raw_no", "id").distinct(), "members")
    scratch.drop("contents")
    signed, seen = scratch.keep_counted(sign_texts(classes, p), "signed", texts=F.count("id"))
    left = candidate_pairs(classes, signed, seen["texts"], p, scratch).withColumn("equal", F.lit(0))
    sigs = signed.where("id is not null")
    # The first batches decide about most candidates, so only those are carried to all of them.
    hot = {end: hot_keys(left, f"id_{end}") for end in "ab"}  # of all candidates, so of those left as well
    cuts, before = [0, min(2 * p.batch, p.kept), p.kept], "candidates"
    for past, until in zip(cuts, cuts[1:]):
        if past < until:
            left = scratch.keep(prune(_at_both_ends(left, sigs, F.substring("signature", past + 1, until - past), hot), p, past, until), f"pruned{until}")
            scratch.drop(before)
            before = f"pruned{until}"
    scratch.drop("signed")
    scored = _at_both_ends(left, classes, F.col("content"), hot).select("id_a", "id_b", exact_similarity(p.piece)("a", "b").alias("similarity"))
    links = scratch.keep(scored.where(F.col("similarity") >= p.threshold), "links")
    scratch.drop("classes")
    return members, links


def similar_pairs(raw: DataFrame, scratch: Scratch, p: NearDuplicates = NearDuplicates(), bigrams: dict[str, int] | None = None) -> DataFrame:
    """All pairs ``(raw_a, raw_b)`` of rows with different contents and at least the threshold's similarity."""
    members, links = similar_classes(raw, scratch, p, bigrams)
    hot, met = hot_keys(members, "id"), links.select("id_a", "id_b")
    for end in "ab":  # a class of copies with many rows is spread; what meets it is repeated, far less than comes out
        rows = members.select(F.col("id").alias(f"id_{end}"), F.col("raw_no").alias(end))
        met = salted_lookup(rows, met, f"id_{end}", hot, F.xxhash64(end))
    return met.select(F.least("a", "b").alias("raw_a"), F.greatest("a", "b").alias("raw_b"))


def similar_groups(raw: DataFrame, scratch: Scratch, p: NearDuplicates = NearDuplicates(), bigrams: dict[str, int] | None = None) -> DataFrame:
    """``(raw_no, class_no, group_no, links)`` of every row with content: the class of equal contents, the group of
    classes linked directly or through others (both named by their smallest raw_no), and the class's number of links."""
    members, links = similar_classes(raw, scratch, p, bigrams)
    ends = links.select(F.col("id_a").alias("id")).unionByName(links.select(F.col("id_b").alias("id")))
    degrees = ends.groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    groups = components_by_decomposition(links.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")), scratch)
    known = scratch.keep(degrees.join(groups.withColumnRenamed("node", "id"), "id"), "known")
    out = members.join(known, "id", "left")
    return out.select("raw_no", F.col("id").alias("class_no"), F.coalesce("component", "id").alias("group_no"), F.coalesce("links", F.lit(0)).alias("links"))
