"""One form for texts that look the same, and the *content* of a text.

Everything here is plain Python over one text at a time; ``textforms.py`` runs it inside Arrow batches.

The look form of a text is made in three steps.

1. *Compatibility step.* Each character is replaced by what it is drawn like: full- and half-width forms, ligatures,
   units, numerals, compatibility ideographs and radicals.  Raised, lowered, circled and fraction signs stay.  Every
   blank becomes U+0020 and characters without a mark of their own are deleted.  Tabs and line breaks stay.
2. *Skeleton.* Each character of a look-alike class becomes the class's first member, so that two spellings of one
   look become the same skeleton.
3. *Lattice.* Each token of the skeleton opens a lattice: every position offers the members of its class.  Viterbi
   keeps the path with the fewest changes of script inside the token and, among those, the best score by character
   bigrams counted over the corpus.  The lattice depends on the skeleton alone, so equal looks get equal forms.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import cache

import numpy as np

# Letters of other scripts drawn like a Latin letter (Latin letter, then its doubles).
LATIN_DOUBLES = """
AАΑᎪ BВΒᏴ CСϹᏟ DᎠ EЕΕᎬ FϜ GԌᏀ HНΗᎻ IІΙ JЈͿᎫ KКΚᏦ LᏞ MМΜᎷ NΝ OОΟՕ PРΡᏢ QԚ RᎡ SЅՏᏚ TТΤᎢ UՍ VѴᏙ WԜᎳ XХΧ YҮΥУᎽ ZΖᏃ
aаɑ cсϲ dԁ eе gɡ hһ iіᎥ jјϳ lӏ oоοօ pр qԛ sѕ uս vѵν wԝ xх yу
"""
# Han characters and the kana drawn like them; hiragana and the katakana drawn like them.
KANA_DOUBLES = "一ー 二ニ 八ハ 力カ 千チ 卜ト 口ロ 夕タ 工エ 才オ へヘ べベ ぺペ"
# Characters drawn like several Latin letters at once.
DOUBTFUL = {"Ӏ": "Il", "ǀ": "Il"}
# CJK radicals (U+2E81 to U+2EF3) and the unified ideographs they are drawn like.
RADICALS = """
⺁厂 ⺂乛 ⺃乚 ⺄乙 ⺅亻 ⺆冂 ⺉刂 ⺊卜 ⺋㔾 ⺌小 ⺍小 ⺎兀 ⺏尣 ⺐尢 ⺒巳 ⺓幺 ⺔彑 ⺕彐 ⺖忄 ⺗㣺 ⺘扌 ⺙攵 ⺛旡 ⺜日 ⺝月 ⺞歺 ⺠民 ⺡氵 ⺢氺 ⺣灬 ⺤爫 ⺥爫
⺦丬 ⺧牛 ⺨犭 ⺩王 ⺫罒 ⺬示 ⺭礻 ⺯糹 ⺰纟 ⺱罓 ⺲罒 ⺳㓁 ⺴冈 ⺶羊 ⺸羊 ⺹耂 ⺺肀 ⺻聿 ⺼肉 ⺽臼 ⺾艹 ⺿艹 ⻀艹 ⻁虎 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻇角 ⻈讠 ⻉贝
⻋车 ⻌辶 ⻍辶 ⻎辶 ⻏阝 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 ⻖阝 ⻗雨 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻟飠 ⻠饣 ⻡首 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻪黾 ⻫斉 ⻬齐
⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻱龜 ⻲亀 ⻳龟
"""
# Kinds of compatibility mapping whose sign does not look like the plain characters.
KEPT_KINDS = {"<super>", "<sub>", "<circle>", "<fraction>"}
# Blanks outside the space separators, visible format characters, marks that are never drawn.
OTHER_BLANKS = "⠀ㅤﾠ"
VISIBLE_FORMAT = "؀؁؂؃؄؅۝܏࢐࢑࣢"
UNDRAWN = "͏ᅟᅠ឴឵"
# Signs that belong to the content of a text, beside letters, marks and digits.
CONTENT_SIGNS = "+<>=%/°×"
RAISED = str.maketrans("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")


def _classes() -> dict[str, str]:
    """Each member of a look-alike class and the whole class; the first member stands for the class."""
    return {ch: group for group in (LATIN_DOUBLES + KANA_DOUBLES).split() for ch in group}


CLASS_OF = _classes()
RADICAL_OF = {pair[0]: pair[1] for pair in RADICALS.split()}


@cache
def script(ch: str) -> str:
    """The script that counts for consistency: the first word of the character's name."""
    name = unicodedata.name(unicodedata.normalize("NFD", ch)[0], "")
    return "CJK" if name.startswith("CJK") else name.split(" ", 1)[0]


def _plain(ch: str) -> str:
    """What one character is drawn like, before look-alike classes; '' for a character without a mark."""
    if ch in CLASS_OF:
        return ch  # some members have a compatibility mapping of another look
    if ch in OTHER_BLANKS:
        return " "
    category = unicodedata.category(ch)
    if category == "Zs" and ch != " ":
        return " "
    if category == "Cf" and ch not in VISIBLE_FORMAT or ch in UNDRAWN or category == "Cc" and ch not in "\t\n\v\f\r\x85":
        return ""
    if 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF or 0x180B <= ord(ch) <= 0x180F:
        return ""
    if ch in "‐‑":
        return "-"
    if ch in RADICAL_OF:
        return RADICAL_OF[ch]
    kind, _, rest = unicodedata.decomposition(ch).partition(" ")
    if kind.startswith("<"):
        if kind in KEPT_KINDS:
            return ch
        parts = "".join(_plain(chr(int(x, 16))) for x in rest.split())
        if kind == "<square>":  # m2 in one sign is drawn with a raised 2
            parts = re.sub(r"(?<=[A-Za-z])\d+", lambda m: m[0].translate(RAISED), parts)
        return parts
    return unicodedata.normalize("NFC", ch)


def _skeleton(ch: str) -> str:
    """The skeleton of one character; composed characters keep their marks over the skeleton of the base."""
    out = []
    for x in _plain(ch):
        parts = unicodedata.normalize("NFD", x)
        base = parts[0] if len(parts) == 1 or 0xAC00 <= ord(x) <= 0xD7A3 else None
        if base is not None:
            out.append(CLASS_OF.get(x, x)[0])
        else:
            out.append(unicodedata.normalize("NFC", CLASS_OF.get(parts[0], parts[0])[0] + parts[1:]))
    return "".join(out)


class _Lazy(dict):
    """A table for str.translate that works each character out at its first use."""

    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, code):
        found = self[code] = self.rule(chr(code))
        return found


def _content_char(ch: str) -> str:
    if unicodedata.category(ch)[0] in "LMN" or ch in CONTENT_SIGNS or ch == ".":
        return ch.lower()
    return ""


#: A noncharacter between the texts of a batch.
SEPARATOR = "\ufffe"
#: Characters of the texts that go through the tables at once.
_AT_ONCE = 2_000_000


class _Codes:
    """A rule from a character to a text over whole arrays of code points, worked out at a character's first use."""

    _UNKNOWN, _GONE, _SEVERAL = -3, -2, -1

    def __init__(self, rule: Callable[[str], str]):
        self.rule, self.several = rule, {}
        self.table = np.full(0x110000, self._UNKNOWN, dtype=np.int32)
        self.table[ord(SEPARATOR)] = ord(SEPARATOR)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        to = self.table[codes]
        lowest = to.min(initial=0)
        if lowest >= 0:
            return to
        if lowest == self._UNKNOWN:
            for code in np.unique(codes[to == self._UNKNOWN]).tolist():
                found = self.rule(chr(code))
                self.table[code] = ord(found) if len(found) == 1 else self._SEVERAL if found else self._GONE
                if len(found) > 1:
                    self.several[code] = _codes(found)
            to = self.table[codes]
        wide = np.flatnonzero(to == self._SEVERAL)
        if not len(wide):
            return to[to >= 0]
        lengths = (to != self._GONE).astype(np.int64)
        lengths[wide] = [len(self.several[c]) for c in codes[wide].tolist()]
        ends = np.cumsum(lengths)
        out = np.empty(ends[-1], dtype=np.int32)
        out[ends[to >= 0] - 1] = to[to >= 0]
        for at, code in zip(wide.tolist(), codes[wide].tolist()):
            out[ends[at] - lengths[at] : ends[at]] = self.several[code]
        return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _joined(texts: Sequence[str | None]) -> Iterator[tuple[int, int, str | None]]:
    """Runs of texts as ``(first, past, joined)``, nulls as nothing; ``joined`` is None for a run whose texts hold the
    separator themselves."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < _AT_ONCE):
            size += len(texts[end] or "")
            end += 1
        whole = SEPARATOR.join([t or "" for t in texts[at:end]])
        yield at, end, whole if whole.count(SEPARATOR) == end - at - 1 else None
        at = end


@cache
def _movable() -> np.ndarray:
    """Marks each code point that can compose with what stands before it, or change places with it."""
    found = np.zeros(0x110000, dtype=bool)
    for code in range(0x30000):
        ch = chr(code)
        if unicodedata.combining(ch):
            found[code] = True
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and parts[0][0] != "<":
            found[int(parts[1], 16)] = True
    found[0x1161:0x11C3] = True  # vowels and ends of Hangul syllables
    found[0x30000:] = True
    return found


def _composed(codes: np.ndarray) -> str:
    """The run of texts, each in NFC. Every code point is in NFC by itself, so only texts with one that moves change."""
    joined = codes.tobytes().decode("utf-32-le", "surrogatepass")
    moved = np.flatnonzero(_movable()[codes])
    if not len(moved):
        return joined
    texts = joined.split(SEPARATOR)
    for at in np.unique(np.searchsorted(np.flatnonzero(codes == ord(SEPARATOR)), moved)).tolist():
        texts[at] = unicodedata.normalize("NFC", texts[at])
    return SEPARATOR.join(texts)


_SKELETONS = _Lazy(_skeleton)
_CONTENTS = _Lazy(_content_char)
_SKELETON_CODES = _Codes(_skeleton)
_CONTENT_CODES = _Codes(_content_char)
_DECIMALS = _Codes(lambda ch: "1" if ch.isdecimal() else "0")
_OPEN = {ch for group in set(CLASS_OF.values()) for ch in group}
#: A Latin letter outside every class leaves a token of ASCII letters, with or without accents, no other script.
_LATIN_ONLY = {ch for ch in map(chr, [*range(65, 91), *range(97, 123)]) if ch not in CLASS_OF}
_DOUBLE = re.compile("[" + "".join(ch for group in sorted(set(CLASS_OF.values())) for ch in group[1:]) + "]")
_TOKEN = re.compile("[A-Za-zÀ-ɏɐ-ʯǀ̀-ͯͰ-֏Ꭰ-᏿Ḁ-῿]+")
_KANA = re.compile("[ぁ-ゖァ-ヺ]")
_OPEN_HAN = re.compile("[" + "".join(sorted(ch for ch in CLASS_OF if ch > "\u2fff")) + "]+")
_KANA_TOKEN = re.compile("[぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]+")
_POINT = re.compile(r"(?<!\d)\.|\.(?!\d)")


class LookForm:
    """Callable that gives a text's look form.

    ``bigrams`` counts neighbouring characters over the corpus (see :func:`bigram_counts`); without it the first
    member of each class wins ties.  Results are remembered by token in a cache of at most ``cache_size`` entries; the
    cache only saves work.
    """

    def __init__(self, bigrams: Mapping[str, int] | None = None, cache_size: int = 200_000):
        self.bigrams = dict(bigrams or {})
        self.cache: dict[str, str] = {}
        self.cache_size = cache_size

    def __call__(self, text: str | None) -> str | None:
        """The look form; null for null, '' for ''."""
        if text is None:
            return None
        if not text.isascii() or not text.isprintable():
            text = text.translate(_SKELETONS)
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
        text = _TOKEN.sub(self._token, text)
        if _KANA.search(text):
            text = _KANA_TOKEN.sub(self._token, text)
        return text

    def many(self, texts: Sequence[str | None]) -> list[str | None]:
        """The look forms of many texts, each as by a call of its own; the tables run over all of them at once."""
        out: list[str | None] = []
        for first, past, joined in _joined(texts):
            if joined is None:
                out += [self(t) for t in texts[first:past]]
                continue
            if not joined.isascii():
                joined = _composed(_SKELETON_CODES(_codes(joined)))
            looks = _TOKEN.sub(self._token, joined).split(SEPARATOR)
            if _KANA.search(joined):
                looks = [_KANA_TOKEN.sub(self._token, x) if _KANA.search(x) else x for x in looks]
            out += [None if t is None else x for t, x in zip(texts[first:past], looks)]
        return out

    def _token(self, match: re.Match) -> str:
        token = match[0]
        found = self.cache.get(token)
        if found is None:
            plain = token if token.isascii() else "".join(ch for ch in unicodedata.normalize("NFD", token) if not unicodedata.combining(ch))
            if plain.isascii() and not _LATIN_ONLY.isdisjoint(plain):
                found = token
            else:
                found = self.decode(token)
            if len(self.cache) >= self.cache_size:
                self.cache.clear()
            self.cache[token] = found
        return found

    def _score(self, a: str, b: str) -> float:
        """Logarithm of how often b follows a. The paths of a lattice have one length, so no normalization is needed."""
        return math.log1p(self.bigrams.get(a + b, 0))

    def decode(self, token: str) -> str:
        """Viterbi over the token's lattice: fewest changes of script, then the best sum of bigram scores, then the
        earliest members of the classes."""
        # A state is what is shown at a place and the script so far; marks have the script of what they stand on.
        previous: dict[tuple[str, str], tuple] = {("", ""): (0, 0.0, 0)}
        back: list[dict] = []
        for ch in token:
            base, marks = ch, ""
            if ch not in CLASS_OF and ch not in DOUBTFUL and len(parts := unicodedata.normalize("NFD", ch)) > 1 and parts[0] in CLASS_OF:
                base, marks = parts[0], parts[1:]
            options = "".join(CLASS_OF[x] for x in DOUBTFUL.get(base, "")) or CLASS_OF.get(base, base)
            states: dict[tuple[str, str], tuple] = {}
            links: dict = {}
            for rank, option in enumerate(options):
                shown = unicodedata.normalize("NFC", option + marks) if marks else option
                own = "" if unicodedata.combining(shown[0]) else script(option)
                for key, (changes, cost, ranks) in previous.items():
                    now = own or key[1]
                    entry = (changes + (key[1] not in ("", now)), cost - self._score(key[0][-1:] or " ", shown[0]), ranks + rank)
                    to = (shown, now)
                    if to not in states or (entry, key) < (states[to], links[to]):
                        states[to], links[to] = entry, key
            back.append(links)
            previous = states
        last = min(previous, key=lambda s: (previous[s], s))
        path = []
        for links in reversed(back):
            path.append(last[0])
            last = links[last]
        return unicodedata.normalize("NFC", "".join(reversed(path)))


def _without_strays(text: str) -> str:
    """Doubles of a script of which the text has fewer than two letters of its own count as what they stand for."""
    own: dict[str, set[str]] = {}
    for ch in set(text) - _OPEN:
        if ch.isalpha():
            own.setdefault(script(ch), set()).add(ch)
    strays = {ch for ch in set(text) & _OPEN if CLASS_OF[ch][0] != ch and len(own.get(script(ch), ())) < 2}
    return text.translate({ord(ch): CLASS_OF[ch][0] for ch in strays})


def bigram_counts(texts: Iterable[str | None]) -> Counter:
    """Counts of neighbouring letters of a token, stray doubles put right, of which at least one is a member of a
    look-alike class; a member at the head of a token, or after a mark, counts as its start.

    Letters beside members count below U+2000 only, so the table has at most 2 x members x 8192 entries, a bound that
    does not depend on the corpus."""
    tokens: Counter = Counter()
    for _, _, joined in _joined([t.replace(SEPARATOR, " ") for t in texts if t]):
        if _DOUBLE.search(joined):
            joined = SEPARATOR.join([_without_strays(t) if not t.isascii() and _DOUBLE.search(t) else t for t in joined.split(SEPARATOR)])
        tokens.update(_TOKEN.findall(joined))
        tokens.update(_OPEN_HAN.findall(joined))
    kept: Counter = Counter()
    for token, n in tokens.items():
        for a, b in zip(" " + token, token):
            if b in _OPEN or a in _OPEN and b.isalpha():
                kept[(a if a.isalpha() else " ") + b] += n
    return kept


def content(look: str | None) -> str | None:
    """The content of a look form: lower case, without white space and signs; a point stays between two digits.
    Null for null."""
    if look is None:
        return None
    text = _POINT.sub("", look) if "." in look else look
    text = text.translate(_CONTENTS)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def contents(looks: Sequence[str | None]) -> list[str | None]:
    """:func:`content` of many look forms; the tables run over all of them at once."""
    out: list[str | None] = []
    for first, past, joined in _joined(looks):
        if joined is None:
            out += [content(x) for x in looks[first:past]]
            continue
        codes = _codes(joined)
        points = np.flatnonzero(codes == ord("."))
        if len(points):
            beside = np.concatenate([[ord(SEPARATOR)], codes, [ord(SEPARATOR)]])
            digit = lambda at: _DECIMALS(beside[at]) == ord("1")
            codes = np.delete(codes, points[~(digit(points) & digit(points + 2))])
        found = _composed(_CONTENT_CODES(codes)).split(SEPARATOR)
        out += [None if x is None else y for x, y in zip(looks[first:past], found)]
    return out
