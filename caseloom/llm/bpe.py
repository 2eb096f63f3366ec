"""Byte-pair encoding by segment trees over the ranks of neighbouring pairs. Plain numpy and Python, no Spark.

A word (a piece of text between two cuts of the pattern) starts as its bytes. A segment tree holds, at each leaf, the
rank of the pair that starts there together with its place; the root is so the leftmost pair of the lowest rank. A
merge writes three leaves (the merged place, the place that vanished, the place before) and repairs their paths, which
takes logarithmic time. When the root holds no pair, the word is done.

Many words of like length are merged side by side: the trees are the rows of one matrix, and each step merges the root
of every row that still has one. Very long words run alone in a scalar tree."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

# Fixed value: the public pattern that cuts text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words longer than this many bytes run alone.
ALONE = 1024
#: Trees of one matrix hold at most this many leaves together.
LEAVES = 1 << 20
_NONE32 = np.uint32(0xFFFFFFFF)


def byte_letters() -> dict[str, int]:
    """The printable letter by which vocabulary files write each byte: printable Latin-1 bytes stand for themselves,
    the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges of a byte-level vocabulary file (``vocab`` and ``merges`` as public tokenizer files have them).

    A pair's rank is its place in the list of merges. ``ids`` maps our node numbers (bytes, then merges by rank) to the
    file's ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        node = {letter: b for letter, b in letters.items()}
        ids = np.empty(256 + len(merges), dtype=np.int32)
        for letter, b in letters.items():
            ids[b] = vocab[letter]
        keys = np.empty(len(merges), dtype=np.int64)
        for rank, (a, b) in enumerate(merges):
            keys[rank] = node[a] << 20 | node[b]
            node[a + b] = 256 + rank
            ids[256 + rank] = vocab[a + b]
        self.ids, self.merges = ids, len(merges)
        self._fill(keys)
        self.ranks = {int(k): r for r, k in enumerate(keys)}

    def _fill(self, keys: np.ndarray) -> None:
        """An open hash table with linear probing, filled round by round."""
        bits = max(8, int(len(keys)).bit_length() + 3)
        self.mask, self.down = (1 << bits) - 1, np.uint64(64 - bits)
        self.slots, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, _NONE32, dtype=np.uint32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slots[at] == -1
            place, first = np.unique(at[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.slots[place], self.values[place] = keys[left[taken]], left[taken].astype(np.uint32)
            stays = np.ones(len(left), dtype=bool)
            stays[taken] = False
            left, at = left[stays], (at[stays] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.down).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of nodes; _NONE32 where no merge exists."""
        keys = left.astype(np.int64) << 20 | right.astype(np.int64)
        at = self._slot(keys)
        seen = self.slots[at]
        out = np.where(seen == keys, self.values[at], _NONE32)
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            seen = self.slots[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """File ids of each word; words of at most ALONE bytes, taken by like length."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            width = max(2, 1 << (len(words[order[at]]) - 1).bit_length())
            end = at
            while end < len(order) and len(words[order[end]]) <= width and (end - at) * width < LEAVES:
                end += 1
            chosen = order[at:end]
            for i, found in zip(chosen, self._merge_rows([words[i] for i in chosen], width)):
                out[i] = found
            at = end
        return out

    def _merge_rows(self, words: list[bytes], width: int) -> list[np.ndarray]:
        count = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=count)
        node = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(count, width).astype(np.int32)
        place = np.arange(width)
        inside = place[None, :] < lengths[:, None]
        # One column more than the width: a border whose links may be written and are never read as a pair.
        follow = np.minimum(np.broadcast_to(place + 1, (count, width)), lengths[:, None]).astype(np.int32)
        ahead = np.zeros((count, width + 1), dtype=np.int32)
        ahead[:, :width] = place - 1
        pairs = place[None, : width - 1] < lengths[:, None] - 1
        leaf = np.full((count, width), np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
        r, c = np.nonzero(pairs)
        rank = self.rank(node[r, c], node[r, c + 1])
        real = rank != _NONE32
        leaf[r[real], c[real]] = rank[real].astype(np.uint64) << np.uint64(20) | c[real].astype(np.uint64)
        none = np.uint64(0xFFFFFFFFFFFFFFFF)
        tree = np.full((count, 2 * width), none, dtype=np.uint64)
        tree[:, width:] = leaf
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        gone = ~inside
        flat_tree, flat_node, flat_next, flat_ahead, flat_gone = tree.reshape(-1), node.reshape(-1), follow.reshape(-1), ahead.reshape(-1), gone.reshape(-1)
        rows = np.arange(count)
        while True:
            root = flat_tree[rows * (2 * width) + 1]
            live = root != none
            rows, root = rows[live], root[live]
            if not len(rows):
                break
            here = (root & np.uint64((1 << 20) - 1)).astype(np.int64)
            merged = (root >> np.uint64(20)).astype(np.int32) + 256
            nodes, links = rows * width, rows * (width + 1)
            right = flat_next[nodes + here].astype(np.int64)
            after = flat_next[nodes + right].astype(np.int64)
            flat_node[nodes + here] = merged
            flat_next[nodes + here] = after
            flat_ahead[links + after] = here
            flat_gone[nodes + right] = True
            before = flat_ahead[links + here].astype(np.int64)
            length = lengths[rows]
            has_after, has_before = after < length, before >= 0
            new_here = self._leaf(merged, flat_node[nodes + np.where(has_after, after, here)], here, has_after)
            new_before = self._leaf(flat_node[nodes + np.where(has_before, before, here)], merged, np.maximum(before, 0), has_before)
            base = rows * (2 * width)
            at = [width + here, width + right, width + np.where(has_before, before, here)]
            flat_tree[base + at[1]] = none
            flat_tree[base + at[2]] = new_before
            flat_tree[base + at[0]] = new_here  # last: it is also the stand-in where nothing is before
            for _ in range(width.bit_length() - 1):
                for k in range(3):
                    at[k] = at[k] >> 1
                    low = base + 2 * at[k]
                    flat_tree[base + at[k]] = np.minimum(flat_tree[low], flat_tree[low + 1])
        ids = self.ids[node]
        kept = ~gone
        counts = kept.sum(axis=1)
        return np.split(ids[kept], np.cumsum(counts)[:-1])

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, exists: np.ndarray) -> np.ndarray:
        rank = self.rank(left, right)
        value = rank.astype(np.uint64) << np.uint64(20) | place.astype(np.uint64)
        return np.where(exists & (rank != _NONE32), value, np.uint64(0xFFFFFFFFFFFFFFFF))

    def merge_one(self, word: bytes) -> np.ndarray:
        """File ids of one word of any length, by a scalar tree."""
        n = len(word)
        width = max(2, 1 << (n - 1).bit_length())
        node, follow, ahead = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, none = self.ranks, (1 << 62)
        shift = width.bit_length()
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = ranks.get(node[i] << 20 | node[i + 1])
            if rank is not None:
                tree[width + i] = rank << shift | i
        for k in range(width - 1, 0, -1):
            tree[k] = tree[2 * k] if tree[2 * k] < tree[2 * k + 1] else tree[2 * k + 1]
        low = (1 << shift) - 1
        while tree[1] != none:
            here, merged = tree[1] & low, (tree[1] >> shift) + 256
            right = follow[here]
            after, before = follow[right], ahead[here]
            node[here], follow[here], node[right] = merged, after, -1
            changed = {width + right: none, width + here: none}
            if after < n:
                ahead[after] = here
                rank = ranks.get(merged << 20 | node[after])
                if rank is not None:
                    changed[width + here] = rank << shift | here
            if before >= 0:
                rank = ranks.get(node[before] << 20 | merged)
                changed[width + before] = none if rank is None else rank << shift | before
            for k, value in changed.items():
                tree[k] = value
                k >>= 1
                while k:
                    best = tree[2 * k] if tree[2 * k] < tree[2 * k + 1] else tree[2 * k + 1]
                    if tree[k] == best:
                        break
                    tree[k] = best
                    k >>= 1
        return self.ids[np.array([x for x in node if x >= 0], dtype=np.int64)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once in each Python worker."""
    return Vocabulary(path)


class Encoder:
    """Ids of texts. Words met before are looked up in a cache of bounded size, which only saves work."""

    def __init__(self, path: str, cache_size: int = 300_000):
        self.vocabulary, self.cut = vocabulary(path), regex.compile(PATTERN)
        self.cache: dict[str, np.ndarray] = {}
        self.cache_size = cache_size

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; no ids for null and ''. Strings that look like special tokens are ordinary text. Lone
        surrogates can't be in a Spark string."""
        words = [self.cut.findall(t) if t else [] for t in texts]
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        cache = self.cache
        fresh = list({w for ws in words for w in ws if w not in cache})
        coded = [w.encode("utf-8") for w in fresh]
        short = [i for i, b in enumerate(coded) if len(b) <= ALONE]
        for i, ids in zip(short, self.vocabulary.merge_many([coded[i] for i in short])):
            cache[fresh[i]] = ids
        for i, b in enumerate(coded):
            if len(b) > ALONE:
                cache[fresh[i]] = self.vocabulary.merge_one(b)
        empty = np.empty(0, dtype=np.int32)
        return [np.concatenate([cache[w] for w in ws]) if ws else empty for ws in words]
